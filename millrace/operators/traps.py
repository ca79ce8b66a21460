"""Bad rows go to a place of their own instead of ending the run."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ERROR = "__error"


def trap_where(df: DataFrame, good: Column, path: str) -> DataFrame:
    """Rows for which ``good`` is true; all others, null ones too, are written to ``path`` first."""
    kept = F.coalesce(good, F.lit(False))
    df.filter(~kept).write.mode("overwrite").parquet(path)
    return df.filter(kept)


def trap_map(df: DataFrame, inputs: Sequence[str], function: Callable[..., tuple], output: str, path: str) -> DataFrame:
    """Call ``function`` on the input columns of each row and add its tuple as ``output`` columns.

    A row for which it raises goes to ``path/bad`` instead, as it is, with the
    error's text in :data:`ERROR`.  Every row is processed once: results are
    written below ``path`` and read from there.
    """
    fields = list(T.StructType.fromDDL(output))
    taken = {f.name.lower() for f in fields}
    kept = [f for f in df.schema if f.name.lower() not in taken]
    schema = T.StructType([*kept, *fields, T.StructField(ERROR, T.StringType()), T.StructField("__part", T.StringType())])
    arrow = to_arrow_schema(T.StructType(fields))
    names = [f.name for f in kept]
    source = df.select(*[F.col(f"`{c}`") for c in names], *[F.col(f"`{c}`").alias(f"__in_{i}") for i, c in enumerate(inputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = [b.column(len(names) + i).to_pylist() for i in range(len(inputs))]
            made, errors = [], []
            for i in range(b.num_rows):
                try:
                    row = tuple(function(*[c[i] for c in given]))
                    [pa.scalar(v, f.type) for v, f in zip(row, arrow, strict=True)]
                    made.append(row)
                    errors.append(None)
                except Exception as e:
                    made.append((None,) * len(fields))
                    errors.append(f"{type(e).__name__}: {e}")
            columns = [pa.array([r[k] for r in made], f.type) for k, f in enumerate(arrow)]
            part = pa.array(["good" if e is None else "bad" for e in errors], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *columns, pa.array(errors, pa.string()), part], names=schema.names)

    source.mapInArrow(run, schema).write.mode("overwrite").partitionBy("__part").parquet(path)
    stored = df.sparkSession.read.schema(schema).parquet(path)
    return stored.filter("__part = 'good'").drop(ERROR, "__part")


def trapped(df: DataFrame, path: str) -> DataFrame:
    """The bad rows of :func:`trap_map`: the columns that ``df`` has, and the error."""
    stored = df.sparkSession.read.option("mergeSchema", "true").parquet(path)
    return stored.filter("__part = 'bad'").select(*[F.col(f"`{c}`") for c in df.columns if c in stored.columns], ERROR)
