"""Named datasets, and reading many small files as few partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.files import Files

#: Formats a dataset can have.
FORMATS = ("parquet", "orc", "json", "csv", "text")
#: Batched reading aims at partitions between these sizes.
MIN_BATCH, MAX_BATCH = 255 * 1024 * 1024, 765 * 1024 * 1024
#: Most files of one partition, by the cost that opening one counts as.
MAX_FILES = 2000


@dataclass(frozen=True)
class Dataset:
    """A name, a place (``root`` and ``relative`` joined as they are), a schema and a format."""

    name: str
    root: str
    relative: str
    schema: str | None = None
    format: str = "parquet"

    def __post_init__(self) -> None:
        if None in (self.name, self.root, self.relative):
            raise ValueError("name, root and relative path are needed")
        if self.format not in FORMATS:
            raise NotImplementedError(f"no such format: {self.format}")

    @property
    def path(self) -> str:
        return self.root + self.relative

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.format(self.format)
        return (reader.schema(self.schema) if self.schema else reader).load(self.path)

    def write(self, df: DataFrame, mode: str = "overwrite") -> None:
        df.write.mode(mode).format(self.format).save(self.path)

    def size(self, spark: SparkSession) -> int:
        """Bytes in its folder."""
        return Files(spark).size(self.path)


class DatasetRegistry:
    def __init__(self, root: str):
        self.root = root
        self._known: dict[str, Dataset] = {}

    def add(self, name: str, relative: str, schema: str | None = None, format: str = "parquet") -> Dataset:
        if name in self._known:
            raise ValueError(f"{name} is registered")
        self._known[name] = Dataset(name, self.root, relative, schema, format)
        return self._known[name]

    def __getitem__(self, name: str) -> Dataset:
        return self._known[name]

    def __iter__(self) -> Iterator[Dataset]:
        return iter(self._known.values())


@contextmanager
def batched_reads(spark: SparkSession, max_batch: int = MAX_BATCH, max_files: int = MAX_FILES, min_batch: int = MIN_BATCH, paths: Sequence[str] = ()) -> Iterator[None]:
    """Plans made *and run* inside pack small files into partitions of up to ``max_batch`` bytes and ``max_files`` files.

    The file count is bounded by what opening a file counts as.  With the
    ``paths`` that will be read there is a partition for every core, unless these
    would have less than ``min_batch`` bytes; without, partitions are full.
    """
    if not 0 < min_batch <= max_batch:
        raise ValueError("the least batch must be positive and no more than the most")
    total = sum(Files(spark).size(p) for p in paths)
    least = max(1, min(spark.sparkContext.defaultParallelism, total // min_batch))
    keys = {"spark.sql.files.maxPartitionBytes": str(max_batch), "spark.sql.files.openCostInBytes": str(max(1, max_batch // max_files)), "spark.sql.files.minPartitionNum": str(least)}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
