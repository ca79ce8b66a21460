"""N-way full-outer co-groups without a cross product."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = "__source"
_FIRST = "__first"
#: Rows of results that go back to Spark at once.
_ROWS = 10_000
#: Types whose column can be made for many keys at once.
_PLAIN = (T.NumericType, T.BooleanType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.NullType)


def _tagged(frames: Sequence[DataFrame], keys: Sequence[Sequence[str]], key_names: Sequence[str] | None) -> tuple[DataFrame, list[str], list[list[str]]]:
    """One table: the key, which input a row is from, and each input's own columns (null in the others')."""
    if len(frames) < 2 or len(frames) != len(keys):
        raise ValueError("two or more inputs with a key list each are needed")
    names = list(key_names or keys[0])
    if any(len(k) != len(names) for k in keys):
        raise ValueError("all inputs need the same number of keys")
    out, own = None, []
    for i, (df, k) in enumerate(zip(frames, keys, strict=True)):
        fields = [f"__{i}_{c}" for c in df.columns]
        own.append(fields)
        part = df.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(k, names, strict=True)], F.lit(i).alias(SOURCE), *[F.col(f"`{c}`").alias(f) for c, f in zip(df.columns, fields, strict=True)])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, names, own


def multi_group(
    frames: Sequence[DataFrame],
    keys: Sequence[str | Sequence[str]],
    aggregates: Mapping[str, Callable[..., Column]],
    key_names: Sequence[str] | None = None,
) -> DataFrame:
    """One row for every key of any input, aggregated over all inputs at once.

    The inputs are tagged, stacked and grouped once, so a key costs the sum of
    its rows and not their product, and partial aggregation runs before the one
    shuffle.  Each aggregate gets one accessor per input: ``lambda a, b:
    F.sum(a("x")) + F.coalesce(F.sum(b("y")), F.lit(0))``.  An accessor yields
    null on other inputs' rows, which aggregates skip; ``a()`` is a column that
    is 1 on the input's own rows.
    """
    ks = [[k] if isinstance(k, str) else list(k) for k in keys]
    stacked, names, _ = _tagged(frames, ks, key_names)

    def accessor(i: int) -> Callable[..., Column]:
        return lambda name=None: F.when(F.col(SOURCE) == i, F.lit(1)) if name is None else F.col(f"`__{i}_{name}`")

    at = [accessor(i) for i in range(len(frames))]
    return stacked.groupBy(*names).agg(*[f(*at[: len(inspect.signature(f).parameters) or None] if not _varargs(f) else at).alias(n) for n, f in aggregates.items()])


def _varargs(f: Callable) -> bool:
    return any(p.kind is p.VAR_POSITIONAL for p in inspect.signature(f).parameters.values())


def multi_group_apply(
    frames: Sequence[DataFrame],
    keys: Sequence[str | Sequence[str]],
    buffer: Callable[[tuple, list[pd.DataFrame]], pd.DataFrame],
    output: str | T.StructType,
    key_names: Sequence[str] | None = None,
) -> DataFrame:
    """The same co-group for logic that no expression says.

    ``buffer(key, [rows of input 0, rows of input 1, ...])`` is called once per
    key of any input, inputs without rows being empty frames with their own
    columns; it returns the result columns of ``output``, and the key is put
    before them.  Rows are turned to pandas and back for many keys at once; a
    column's type in a frame follows from that frame's rows alone.  Inputs with
    arrays, maps or structs go key by key, at several times the cost.  A key's
    rows must fit in one task's memory: use :func:`multi_group` for keys that
    may be hot.
    """
    ks = [[k] if isinstance(k, str) else list(k) for k in keys]
    stacked, names, own = _tagged(frames, ks, key_names)
    columns = [list(df.columns) for df in frames]
    result = T.StructType.fromDDL(output) if isinstance(output, str) else output
    schema = T.StructType([stacked.schema[n] for n in names] + list(result))
    if set(names) & set(result.names):
        raise ValueError("results and keys need different names")
    if all(isinstance(f.dataType, _PLAIN) for f in stacked.schema):
        return _by_batches(stacked, names, own, columns, buffer, result, schema)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [rows.loc[rows[SOURCE] == i, own[i]].set_axis(columns[i], axis=1).reset_index(drop=True) for i in range(len(own))]
        out = buffer(key, parts)
        for at, (name, value) in enumerate(zip(names, key, strict=True)):
            out.insert(at, name, [value] * len(out))
        return out

    return stacked.groupBy(*names).applyInPandas(run, schema)


def _by_batches(
    stacked: DataFrame, names: list[str], own: list[list[str]], columns: list[list[str]], buffer: Callable[[tuple, list[pd.DataFrame]], pd.DataFrame], result: T.StructType, schema: T.StructType
) -> DataFrame:
    """A window marks each key's first row, by Spark's own notion of equal keys, and leaves the rows sorted by key and input.

    In pandas one null makes floats of all integers and objects of all booleans
    of a column.  So these come filled, with a flag for what was null, as do
    keys, where NaN must not become null.
    """
    fields = {f.name: f.dataType for f in stacked.schema}
    filled = {n: t for n, t in fields.items() if n != SOURCE and isinstance(t, (T.IntegralType, T.BooleanType) + ((T.FractionalType,) if n in names else ())) and not isinstance(t, T.DecimalType)}
    by_key = Window.partitionBy(*[F.col(f"`{n}`") for n in names]).orderBy(SOURCE)
    marked = stacked.withColumn(_FIRST, F.row_number().over(by_key) == 1)
    cols = [F.coalesce(F.col(f"`{n}`"), F.lit(0).cast(filled[n])).alias(n) if n in filled else F.col(f"`{n}`") for n in fields]
    flags = [F.col(f"`{n}`").isNull().alias(_flag(n)) for n in filled]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_keys(batches):
            first = np.flatnonzero(rows[_FIRST].to_numpy())
            group_keys = [_KeyColumn(rows, n, first, n in filled) for n in names]
            inputs = [_Input(rows, i, first, own[i], columns[i], [c in filled for c in own[i]]) for i in range(len(own))]
            yield from _collected(((g, buffer(key, [x.part(g) for x in inputs])) for g, key in enumerate(zip(*[k.shown for k in group_keys], strict=True))), group_keys, result.names)

    return marked.select(*cols, F.col(_FIRST), *flags).mapInPandas(run, schema)


def _flag(name: str) -> str:
    return f"__null_{name}"


def _whole_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows, cut before a key's first row."""
    held: list[pd.DataFrame] = []
    for b in batches:
        first = np.flatnonzero(b[_FIRST].to_numpy())
        if held and len(first):
            yield pd.concat([*held, b.iloc[: first[-1]]], ignore_index=True)
            held = [b.iloc[first[-1] :]]
        elif len(first) and first[-1]:
            yield b.iloc[: first[-1]]
            held = [b.iloc[first[-1] :]]
        elif len(b):
            held.append(b)
    if held:
        yield pd.concat(held, ignore_index=True)


class _KeyColumn:
    """One column of the keys of some groups: as the buffer gets it and as it is returned."""

    def __init__(self, rows: pd.DataFrame, name: str, first: np.ndarray, filled: bool):
        self.name = name
        self._values = rows[name].iloc[first].reset_index(drop=True)
        self._null = rows[_flag(name)].to_numpy()[first] if filled else None
        self.shown = list(self._values.to_numpy() if filled else self._values)
        if filled:
            for g in np.flatnonzero(self._null):
                self.shown[g] = None if self._values.dtype == bool else np.float64("nan")

    def repeated(self, groups: np.ndarray) -> pd.Series:
        values = self._values.take(groups).reset_index(drop=True)
        if self._null is None:
            return values
        return pd.Series(pd.arrays.ArrowExtensionArray(pa.array(values.to_numpy(), mask=self._null[groups])))


class _Input:
    """The rows of one input, from which each group's are cut."""

    def __init__(self, rows: pd.DataFrame, i: int, first: np.ndarray, own: list[str], columns: list[str], filled: list[bool]):
        at = np.flatnonzero(rows[SOURCE].to_numpy() == i)
        self._edges = np.searchsorted(at, [*first, len(rows)]).tolist()
        self._rows = rows[own].take(at).set_axis(columns, axis=1)
        flags = [(c, rows[_flag(name)].to_numpy()[at]) for c, (name, f) in enumerate(zip(own, filled, strict=True)) if f]
        self._null = [(c, null) for c, null in flags if null.any()]

    def part(self, g: int) -> pd.DataFrame:
        a, b = self._edges[g], self._edges[g + 1]
        out = self._rows.iloc[a:b].reset_index(drop=True)
        for c, null in self._null:
            if null[a:b].any():
                values = out.iloc[:, c].to_numpy()
                values = values.astype(object if values.dtype == bool else np.float64)
                values[null[a:b]] = None if values.dtype == object else np.nan
                out.isetitem(c, values)
        return out


def _collected(outs: Iterator[tuple[int, pd.DataFrame]], group_keys: list[_KeyColumn], names: list[str]) -> Iterator[pd.DataFrame]:
    """Results of many groups in one frame, those apart whose columns have other types."""
    alike: dict[tuple, list[tuple[int, int, list[pd.Series]]]] = {}
    n_rows = 0

    def joined(held: list[tuple[int, int, list[pd.Series]]]) -> pd.DataFrame:
        groups, sizes, found = zip(*held, strict=True)
        at = np.repeat(groups, sizes)
        return pd.DataFrame({k.name: k.repeated(at) for k in group_keys} | {n: pd.concat(c, ignore_index=True) for n, c in zip(names, zip(*found, strict=True), strict=True)})

    for g, out in outs:
        if not isinstance(out, pd.DataFrame):
            raise TypeError(f"a buffer returns a pandas.DataFrame, not {type(out).__name__}")
        if not len(out) and not len(out.columns):
            continue
        if len(out.columns) != len(names) or set(out.columns) != set(names):
            raise ValueError(f"a buffer returned the columns {list(out.columns)}, not {names}")
        if not len(out):
            continue
        found = [out[n] for n in names]
        alike.setdefault(tuple(x.dtype for x in found), []).append((g, len(out), found))
        n_rows += len(out)
        if n_rows >= _ROWS:
            yield from map(joined, alike.values())
            alike.clear()
            n_rows = 0
    yield from map(joined, alike.values())
