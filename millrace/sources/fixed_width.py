"""Fixed-width text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.metrics import INPUT, REJECTED, Counters


def check_layout(fields: Sequence[str], widths: Sequence[int]) -> None:
    if len(fields) != len(widths):
        raise ValueError(f"{len(fields)} fields but {len(widths)} widths")
    if not fields or any(w <= 0 for w in widths):
        raise ValueError("widths must be positive")


def split_fixed_width(lines: DataFrame, fields: Sequence[str], widths: Sequence[int], line: str = "value") -> DataFrame:
    """String columns cut from a line column by character widths."""
    check_layout(fields, widths)
    at, out = 1, []
    for name, width in zip(fields, widths, strict=True):
        out.append(F.substring(line, at, width).alias(name))
        at += width
    return lines.select(*out)


def read_fixed_width(spark: SparkSession, path: str, fields: Sequence[str], widths: Sequence[int], charset: str = "UTF-8", strict: bool = True, counters: Counters | None = None) -> DataFrame:
    """Read lines of fixed-width string columns.

    Strict: lines of another length raise, at once, in a pass that only counts
    them (a check inside the plan would be pruned away with its column).
    Lenient: they are skipped, and counted if ``counters`` are given.
    """
    check_layout(fields, widths)
    if charset.upper().replace("_", "-") in ("UTF-8", "UTF8", "US-ASCII"):
        lines = spark.read.text(path)
    else:
        lines = spark.read.option("encoding", charset).option("sep", "\x00").option("quote", "").schema("value string").csv(path)
    fits = F.length("value") == sum(widths)
    if strict:
        if bad := lines.filter(~fits).count():
            raise ValueError(f"{bad} lines of {path} don't have {sum(widths)} characters")
        return split_fixed_width(lines, fields, widths)
    if counters is not None:
        lines = counters.observe(lines, {("FixedWidth", INPUT): F.count(F.lit(1)), ("FixedWidth", REJECTED): F.count_if(~fits)})
    return split_fixed_width(lines.filter(fits), fields, widths)


def write_fixed_width(*_: object, **__: object) -> None:
    """The format is read-only."""
    raise NotImplementedError("fixed-width text can't be written")
