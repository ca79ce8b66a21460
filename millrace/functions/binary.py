"""Rows as bytes, and the order of bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Times to the microsecond, as Spark holds them.
_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def row_bytes(columns: Sequence[str]) -> Column:
    """The columns of a row as bytes that :func:`row_from_bytes` turns back into them: JSON, nulls and types' precision kept.

    Binary columns and those inside others are in base64.  Without columns, an empty object.
    """
    if not columns:
        return F.encode(F.lit("{}"), "UTF-8")
    return F.encode(F.to_json(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in columns]), _OPTIONS), "UTF-8")


def row_from_bytes(data: str | Column, schema: StructType) -> Column:
    """A struct of the written columns; null for null, an error for bytes that are no such row."""
    return F.from_json(F.decode(data, "UTF-8"), schema, {**_OPTIONS, "mode": "FAILFAST"})


def compare_bytes(left: str | Column, right: str | Column) -> Column:
    """-1, 0 or 1 by unsigned bytes from the left, a beginning before what it begins, null before all; nulls are equal."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (left, right))
    return F.when(a.eqNullSafe(b), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).otherwise(1)


def in_byte_order(df: DataFrame, *columns: str) -> DataFrame:
    """All rows sorted by binary columns as :func:`compare_bytes` orders them, which is Spark's own order of binary values."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in columns])
