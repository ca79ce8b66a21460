"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from millrace.session import shared_folder

_made: list[str] = []
#: Folders made in the innermost :func:`passing` block of this thread.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path that nothing has; what is written there goes when the driver ends, also after a failure."""
    top = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    files, at = _file_system(spark, top)
    files.mkdirs(at)
    files.deleteOnExit(at)
    _made.append(top)
    if (inner := _passing.get()) is not None:
        inner.append(top)
    return f"{top}/{label}"


def materialized(df: DataFrame, label: str) -> DataFrame:
    """Written once as Parquet and read back: the lineage ends here, and a lost executor costs only its running tasks."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables made inside are deleted at the end, but for those put into the list; nothing lazy may read the others then.

    After an error all go.
    """
    inner: list[str] = []
    kept: list[DataFrame] = []
    token = _passing.set(inner)
    try:
        yield kept
    except BaseException:
        kept = []
        raise
    finally:
        _passing.reset(token)
        stays = {df._written.rpartition("/")[0] for df in kept}
        for path in set(inner) - stays:
            files, at = _file_system(spark, path)
            files.delete(at, True)
        if (outer := _passing.get()) is not None:
            outer.extend(stays)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialized` that nothing will read again; others are left alone."""
    for df in tables:
        if path := getattr(df, "_written", None):
            files, at = _file_system(df.sparkSession, path.rpartition("/")[0])
            files.delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process, once results that read them have been written."""
    for path in _made:
        files, at = _file_system(spark, path)
        files.delete(at, True)
    _made.clear()
