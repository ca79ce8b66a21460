"""Row operators: renames, null padding, batched functions, wide emission."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.hashing import key_columns


def rename_in_place(df: DataFrame, fields: Sequence[str], old: Sequence[str] | str, new: Sequence[str] | str) -> DataFrame:
    """Project to ``fields``, in that order, with ``old`` renamed to ``new`` where they stand."""
    old, new = ([x] if isinstance(x, str) else list(x) for x in (old, new))
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    if missing := [c for c in old if c not in fields]:
        raise ValueError(f"not among the fields: {missing}")
    names = dict(zip(old, new, strict=True))
    return df.select([F.col(c).alias(names.get(c, c)) for c in fields])


def append_nulls(df: DataFrame, columns: Mapping[str, str | T.DataType]) -> DataFrame:
    """Add typed null columns; refuses a name that is taken."""
    if taken := sorted({c.lower() for c in columns} & {c.lower() for c in df.columns}):
        raise ValueError(f"columns exist already: {taken}")
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()})


def remove_where(df: DataFrame, condition: Column) -> DataFrame:
    """Drop rows for which ``condition`` is true; rows where it is null stay."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def key_hash(df: DataFrame, keys: Sequence[str], name: str = "key_hash", types: Sequence[str] | None = None) -> DataFrame:
    """One 64-bit column for a key tuple; ``types`` brings keys of two inputs to common types first."""
    return df.withColumn(name, F.xxhash64(*key_columns(keys, types)))


def emit_wide(parts: Mapping[str, DataFrame], tag: str = "part") -> DataFrame:
    """Stack named parts into one wide table: a part fills its own columns, the others are null."""
    frames = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    if not frames:
        raise ValueError("no parts")
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.select(tag, *[c for c in out.columns if c != tag])


def batch_map(
    df: DataFrame,
    column: str,
    apply: Callable[[list], list],
    output: str,
    output_type: str,
    batch_size: int,
    flush_empty: bool = False,
) -> DataFrame:
    """Call ``apply`` on lists of ``batch_size`` values of one column, and on what is left.

    ``apply`` may return any number of values.  Batches are cut within a
    partition, so their edges depend on the partitioning; ``coalesce(1)`` after
    a sort fixes them.  With ``flush_empty`` a partition that ends on a full
    batch gets one more call with an empty list.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list = []
        for frame in frames:
            done: list = []
            waiting += frame[column].tolist()
            while len(waiting) >= batch_size:
                done += apply(waiting[:batch_size])
                del waiting[:batch_size]
            if done:
                yield pd.DataFrame({output: done})
        if waiting or flush_empty:
            if last := apply(waiting):
                yield pd.DataFrame({output: last})

    return df.select(column).mapInPandas(run, f"`{output}` {output_type}")
