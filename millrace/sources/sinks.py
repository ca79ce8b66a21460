"""Sinks and literal sources."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession


@dataclass(frozen=True)
class NullSink:
    """Runs a plan and keeps nothing; reading it back gives no rows."""

    identifier: str = field(default_factory=lambda: f"null-sink-{uuid.uuid4()}")

    def write(self, df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], "`null` string")

    def exists(self) -> bool:
        return True


def rows_source(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Literal rows; the schema is given, never guessed."""
    return spark.createDataFrame(list(rows), schema)


def write_rows(spark: SparkSession, rows: Sequence[tuple], schema: str, path: str, format: str = "parquet") -> None:
    rows_source(spark, rows, schema).write.mode("overwrite").format(format).save(path)


def read_rows(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> list[Row]:
    """All rows, on the driver: for small results and tests."""
    return spark.read.format(format).schema(schema).load(path).collect()
