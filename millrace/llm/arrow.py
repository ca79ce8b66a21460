"""Arrow helpers: row-preserving maps, bounded slices of batches, whole groups of sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of a batch that are turned into Python values at once; a row of more is taken alone.
SLICE = 4 << 20


def row_slices(b: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes, so that Python objects of a few megabytes live at a time."""
    rows = max(1, b.num_rows * most // max(1, b.nbytes))
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def add_columns(df: DataFrame, inputs: Sequence[Column], fields: str, start: Callable[[], Callable[..., list]]) -> DataFrame:
    """``df`` with columns computed from Arrow arrays.

    ``start()`` is called once per task and returns a function of the input
    arrays of a part of a batch that returns one array per new field.  A column of ``df``
    with a new field's name is replaced.
    """
    new = T.StructType.fromDDL(fields)
    taken = {f.name.lower() for f in new}
    kept = [c for c in df.columns if c.lower() not in taken]
    tmp = [f"__in_{i}" for i in range(len(inputs))]
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(t) for c, t in zip(inputs, tmp, strict=True)])
    schema = T.StructType([source.schema[c] for c in kept] + list(new))
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for whole in batches:
            for b in row_slices(whole):
                cols = b.columns
                yield pa.RecordBatch.from_arrays([*cols[:width], *f(*cols[width:])], names=schema.names)

    return source.mapInArrow(run, schema)


def byte_values(array: pa.Array) -> list[bytes | None]:
    """Strings as their UTF-8 bytes, without decoding."""
    return (array.cast(pa.binary()) if not pa.types.is_binary(array.type) else array).to_pylist()


def numbers(array: pa.Array, dtype: str = "<i8") -> np.ndarray:
    return array.to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def rebatched(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches joined to at least ``rows`` rows, but for the last."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, cap: int, target: int = 50_000) -> Iterator[tuple[bool, pa.Table]]:
    """Rows sorted by an integer ``key``, in tables of whole groups: (False, table).

    A group of more than ``cap`` rows comes as (True, table) pieces instead, as
    it is read, so no more than ``cap`` rows and a batch are held for it.
    """
    held: list[pa.RecordBatch] = []
    n, large = 0, None
    for b in batches:
        if b.num_rows and large is not None:
            k = numbers(b.column(b.schema.get_field_index(key)))
            same = int(np.argmax(k != large)) if k[-1] != large else len(k)
            if same:
                yield True, pa.Table.from_batches([b.slice(0, same)])
            if same == len(k):
                continue
            b, large = b.slice(same), None
        held.append(b)
        n += b.num_rows
        if n < target:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k = column(t, key)
        last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if last:
            yield from _capped(t.slice(0, last), key, cap)
        if n - last > cap:
            yield True, t.slice(last)
            held, n, large = [], 0, int(k[-1])
        else:
            held, n = t.slice(last).to_batches(), n - last
    if n:
        yield from _capped(pa.Table.from_batches(held).combine_chunks(), key, cap)


def _capped(t: pa.Table, key: str, cap: int) -> Iterator[tuple[bool, pa.Table]]:
    k = column(t, key)
    edges = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]
    start = 0
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > cap:
            if a > start:
                yield False, t.slice(start, a - start)
            yield True, t.slice(a, b - a)
            start = b
    if len(k) > start:
        yield False, t.slice(start)


def column(t: pa.Table, name: str, dtype: str = "<i8") -> np.ndarray:
    c = t.column(name)
    return numbers(c.chunk(0) if c.num_chunks == 1 else c.combine_chunks(), dtype)
