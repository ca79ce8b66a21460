"""Grouped aggregation: in one go, in stored partial and final steps, and many groupings at once."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions.hashing import name_id
from millrace.operators.aggregates import Aggregate
from millrace.operators.metrics import EVICTED, INPUT, OUTPUT, Counters
from millrace.session import fresh_path

#: Names the definition that a row of a combined result belongs to.
SPEC_ID = "__combiner_id"


@dataclass(frozen=True)
class AggregationSpec:
    """A named grouping with its aggregates.

    ``keep_null_groups=False`` drops rows whose group columns are *all* null.
    ``item_limit`` and ``memory_limit`` bound the cache of the bounded partial
    form; elsewhere Spark's own hash tables spill, so they are only checked.
    """

    name: str
    group_by: Sequence[str]
    aggregates: Sequence[Aggregate]
    keep_null_groups: bool = True
    item_limit: int = 100_000
    memory_limit: int | None = None
    id: int = field(init=False)

    def __post_init__(self) -> None:
        if self.item_limit <= 0 and not (self.memory_limit and self.memory_limit > 0):
            raise ValueError("one of the limits must be positive")
        names = [*self.group_by, *self.outputs]
        if len({n.lower() for n in names}) != len(names):
            raise ValueError(f"{self.name}: group and output columns overlap in {names}")
        object.__setattr__(self, "id", name_id(self.name))

    @property
    def outputs(self) -> list[str]:
        return [o for a in self.aggregates for o in a.outputs]


def stack(frames: DataFrame | Sequence[DataFrame]) -> DataFrame:
    """One input of several with the same columns."""
    return frames if isinstance(frames, DataFrame) else reduce(lambda a, b: a.unionByName(b), frames)


def _with_groups(df: DataFrame, keys: Sequence[str], keep_null_groups: bool) -> DataFrame:
    return df if keep_null_groups or not keys else df.dropna("all", subset=list(keys))


def _finished(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Aggregate]) -> DataFrame:
    return df.select(*keys, *[c.alias(n) for a in aggregates for n, c in a.finish.items()])


def combine(frames: DataFrame | Sequence[DataFrame], group_by: Sequence[str], aggregates: Sequence[Aggregate], keep_null_groups: bool = True) -> DataFrame:
    """Group one or several inputs and aggregate; Spark pre-aggregates before the one shuffle."""
    df = _with_groups(stack(frames), group_by, keep_null_groups)
    partial = [c.alias(n) for a in aggregates for n, c in a.partial.items()]
    return _finished(df.groupBy(*group_by).agg(*partial), group_by, aggregates)


def combine_partial(df: DataFrame, group_by: Sequence[str], aggregates: Sequence[Aggregate], keep_null_groups: bool = True) -> DataFrame:
    """One partial row per key and input partition, to be stored or stacked, then finished by :func:`combine_final`.

    Grouping by the partition id first keeps every partial where its rows are
    read from; keys may repeat, as partials do.
    """
    df = _with_groups(df, group_by, keep_null_groups).withColumn("__partition", F.spark_partition_id())
    partial = [c.alias(n) for a in aggregates for n, c in a.partial.items()]
    return df.groupBy("__partition", *group_by).agg(*partial).drop("__partition")


def combine_final(partials: DataFrame | Sequence[DataFrame], group_by: Sequence[str], aggregates: Sequence[Aggregate]) -> DataFrame:
    """Merge partial rows of a key, whichever run or partition they came from, and finish them."""
    merged = [merge(F.col(n)).alias(n) for a in aggregates for n, merge in a.merge.items()]
    return _finished(stack(partials).groupBy(*group_by).agg(*merged), group_by, aggregates)


class EvictionError(RuntimeError):
    """A strict bounded partial had to evict."""


def combine_partial_bounded(
    df: DataFrame,
    group_by: Sequence[str],
    inputs: Sequence[str],
    zero: Callable[[], Any],
    update: Callable[[Any, tuple], Any],
    emit: Callable[[Any], tuple],
    output: str,
    item_limit: int = 100_000,
    memory_limit: int | None = None,
    size_of: Callable[[tuple, Any], int] | None = None,
    evict_when: Callable[[Any], bool] | None = None,
    strict: bool = False,
    keep_null_groups: bool = True,
    counters: Counters | None = None,
    label: str = "combiner",
) -> DataFrame:
    """Partial rows by user code, from a least-recently-used cache per task.

    A key that is pushed out by ``item_limit`` or ``memory_limit`` (bytes, as
    ``size_of(key, state)`` tells them), or whose state satisfies
    ``evict_when``, is emitted early and may come again: results are exact only
    after a merge.  ``strict`` raises at the first eviction of either kind.
    ``counters`` gets the rows taken, evicted and put out, under ``label``.
    Aggregates that are expressions belong in :func:`combine_partial`.
    """
    if item_limit <= 0 and not memory_limit:
        raise ValueError("one of the limits must be positive")
    if memory_limit and size_of is None:
        raise ValueError("a memory limit needs size_of")
    keys, fields = list(group_by), list(inputs)
    df = _with_groups(df, keys, keep_null_groups)
    schema = T.StructType([df.schema[k] for k in keys] + list(T.StructType.fromDDL(output)))
    if counters is not None:
        df = counters.observe(df, {(label, INPUT): F.count(F.lit(1))})
    flagged = T.StructType([*schema, T.StructField("__evicted", T.BooleanType())]) if counters is not None else schema
    told = counters is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: OrderedDict[tuple, Any] = OrderedDict()
        sizes: dict[tuple, int] = {}
        held, out = 0, []
        for key, values, last in _keyed_rows(batches, len(keys)):
            state = update(cache.pop(key) if key in cache else zero(), values)
            held -= sizes.pop(key, 0)
            if evict_when is not None and evict_when(state):
                if strict:
                    raise EvictionError(f"the state of {key} is to be evicted")
                out.append(key + emit(state) + ((True,) if told else ()))
            else:
                cache[key] = state
                if memory_limit:
                    sizes[key] = size_of(key, state)
                    held += sizes[key]
                while (item_limit > 0 and len(cache) > item_limit) or (memory_limit and held > memory_limit and cache):
                    if strict:
                        raise EvictionError(f"more than {item_limit} keys or {memory_limit} bytes")
                    old, state = cache.popitem(last=False)
                    held -= sizes.pop(old, 0)
                    out.append(old + emit(state) + ((True,) if told else ()))
            if last and out:
                yield _batch(out, flagged)
                out = []
        if cache:
            yield _batch([k + emit(s) + ((False,) if told else ()) for k, s in cache.items()], flagged)

    made = _positional(df, keys, fields).mapInArrow(run, flagged)
    if counters is None:
        return made
    return counters.observe(made, {(label, EVICTED): F.count_if(F.col("__evicted")), (label, OUTPUT): F.count(F.lit(1))}).drop("__evicted")


def _positional(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Keys, then fields, by place: a column may be both."""
    return df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)], *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(fields)])


#: One NaN for all, which is found in a dict by identity.
_NAN = float("nan")


def _keyed_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, tuple, bool]]:
    """(key, values, whether the row ends a batch) of rows whose first ``width`` columns are the key."""
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for i in range(b.num_rows):
            key = tuple(_NAN if c[i] != c[i] else c[i] for c in columns[:width])
            yield key, tuple(c[i] for c in columns[width:]), i == b.num_rows - 1


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def combine_final_ordered(
    partials: DataFrame | Sequence[DataFrame],
    group_by: Sequence[str],
    inputs: Sequence[str],
    zero: Callable[[], Any],
    merge: Callable[[Any, tuple], Any],
    emit: Callable[[Any], tuple],
    output: str,
    order_by: Sequence[str | Column] = (),
) -> DataFrame:
    """Merge partial rows of a key by user code, in the order of ``order_by`` within the key.

    Rows are dealt by key and sorted within their partition, so a task holds
    one state at a time however many rows a key has.  Without a group all rows
    are merged in one task: give it partials, as :func:`combine_partial_bounded`
    makes them.  No rows give no result, with or without a group.  Merges that
    are expressions belong in :func:`combine_final`.
    """
    df, keys = stack(partials), list(group_by)
    schema = T.StructType([df.schema[k] for k in keys] + list(T.StructType.fromDDL(output)))
    dealt = df.repartition(*[F.col(f"`{k}`") for k in keys]) if keys else df.repartition(1)
    by = [*[F.col(f"`{k}`") for k in keys], *order_by]
    ordered = dealt.sortWithinPartitions(*by) if by else dealt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        state: Any = None
        out: list[tuple] = []
        for key, values, last in _keyed_rows(batches, len(keys)):
            if key != current:
                if current is not None:
                    out.append(current + emit(state))
                current, state = key, zero()
            state = merge(state, values)
            if last and out:
                yield _batch(out, schema)
                out = []
        if current is not None:
            yield _batch([current + emit(state)], schema)

    return _positional(ordered, keys, list(inputs)).mapInArrow(run, schema)


def _check_specs(specs: Sequence[AggregationSpec]) -> None:
    if not specs:
        raise ValueError("no definitions")
    seen: dict[int, str] = {}
    for s in specs:
        if s.id in seen:
            raise ValueError(f"definitions {seen[s.id]!r} and {s.name!r} have the same id {s.id}")
        seen[s.id] = s.name


def multi_aggregate(frames: DataFrame | Sequence[DataFrame], specs: Sequence[AggregationSpec], reduce_first: bool = False) -> DataFrame:
    """Many independent groupings from one scan and one shuffle.

    They are the grouping sets of one aggregation: rows are expanded, with the
    columns that some definition needs only, and partially aggregated before
    they are shuffled.  ``reduce_first`` aggregates by all group columns together
    before that, so that only these rows are expanded: one more, small, shuffle,
    which pays if all groups together are far fewer than the rows.

    The result has :data:`SPEC_ID`, then all group and output columns, nulls
    where a definition has none of them.  Outputs of the same name must agree in
    type.  Without rows there is no result row, also of a definition without groups.
    """
    _check_specs(specs)
    df = stack(frames)
    groups = list(dict.fromkeys(g for s in specs for g in s.group_by))
    outputs = list(dict.fromkeys(o for s in specs for o in s.outputs))
    if both := set(groups) & set(outputs):
        raise ValueError(f"columns are groups in one definition and outputs in another: {sorted(both)}")

    # One aggregate per distinct expression: definitions that ask for the same share it.
    partial: dict[str, Column] = {}
    merges: dict[str, Callable[[Column], Column]] = {}
    shared: dict[str, str] = {}
    slots: dict[tuple[int, str], str] = {}
    for s in specs:
        for a in s.aggregates:
            for name, c in a.partial.items():
                text = str(c)
                if text not in shared:
                    shared[text] = f"__p_{len(shared)}"
                    partial[shared[text]], merges[shared[text]] = c, a.merge[name]
                slots[(s.id, name)] = shared[text]
    aggregated = [c.alias(n) for n, c in partial.items()] or [F.count(F.lit(1)).alias("__p_none")]
    if reduce_first and groups and partial:
        df = df.groupBy(*[F.col(f"`{g}`") for g in groups]).agg(*aggregated)
        aggregated = [merge(F.col(n)).alias(n) for n, merge in merges.items()]

    # Definitions with the same groups are one set; which they are is told by the columns that a row's set leaves out.
    sets: dict[tuple[str, ...], list[AggregationSpec]] = {}
    for s in specs:
        sets.setdefault(tuple(g for g in groups if g in s.group_by), []).append(s)
    if groups:
        cols = {g: F.col(f"`{g}`") for g in groups}
        merged = df.groupingSets([[cols[g] for g in key] for key in sets], *cols.values()).agg(F.grouping_id(), *aggregated)
    else:
        merged = df.groupBy(F.lit(0).cast("bigint")).agg(*aggregated)
    merged = merged.toDF(*[f"__g_{g}" for g in groups], "__set", *merged.columns[len(groups) + 1 :])
    ids = F
    for key, same in sets.items():
        left_out = sum(1 << (len(groups) - 1 - i) for i, g in enumerate(groups) if g not in key)
        wanted = []
        for s in same:
            keep = s.keep_null_groups or not key or reduce(lambda a, b: a | b, [F.col(f"`__g_{g}`").isNotNull() for g in key])
            wanted.append(F.lit(s.id) if keep is True else F.when(keep, F.lit(s.id)))
        ids = ids.when(F.col("__set") == left_out, wanted[0] if len(sets) == len(specs) else F.array_compact(F.array(*wanted)))
    ids = ids if len(sets) == len(specs) else F.explode(ids)

    # Each definition finishes its own rows.  Definitions whose intermediates don't share a name with another
    # meaning are finished in one step, as every step of a plan costs analysis.
    steps: list[tuple[dict[str, str], dict[str, Column]]] = []
    for i, s in enumerate(specs):
        need = {n: slots[(s.id, n)] for a in s.aggregates for n in a.partial}
        done = {f"__o_{i}_{o}": F.when(F.col(SPEC_ID) == s.id, c) for a in s.aggregates for o, c in a.finish.items()}
        for bound, finish in steps:
            if all(bound.get(n, slot) == slot for n, slot in need.items()):
                bound |= need
                finish |= done
                break
        else:
            steps.append((need, done))
    out = merged.withColumns({SPEC_ID: ids} | {n: F.col(slot) for n, slot in steps[0][0].items()})
    if not all(s.keep_null_groups for s in specs):
        out = out.filter(F.col(SPEC_ID).isNotNull())
    for (_, finish), (bound, _) in zip(steps, steps[1:], strict=False):
        out = out.withColumns(finish).withColumns({n: F.col(slot) for n, slot in bound.items()})
    last = steps[-1][1]
    made = {o: [last.get(f"__o_{i}_{o}", F.col(f"`__o_{i}_{o}`")) for i, s in enumerate(specs) if o in s.outputs] for o in outputs}
    return out.select(SPEC_ID, *[F.col(f"`__g_{g}`").alias(g) for g in groups], *[(F.coalesce(*c) if len(c) > 1 else c[0]).alias(o) for o, c in made.items()])


def multi_aggregate_tails(frames: DataFrame | Sequence[DataFrame], specs: Sequence[AggregationSpec], path: str | None = None, reduce_first: bool = False) -> dict[str, DataFrame]:
    """The same, as one DataFrame per definition with its own columns.

    The wide result is written once, by definition, to ``path`` (a folder of its
    own below the session's shared one unless given), and each tail reads its
    part: the input is read and shuffled once, however many tails are read.
    """
    _check_specs(specs)
    wide = multi_aggregate(frames, specs, reduce_first)
    spark = wide.sparkSession
    path = path or fresh_path(spark, "tails")
    wide.write.mode("overwrite").partitionBy(SPEC_ID).parquet(path)
    schema = T.StructType([f for f in wide.schema if f.name != SPEC_ID] + [wide.schema[SPEC_ID]])
    back = spark.read.schema(schema).parquet(path)
    return {s.name: back.filter(F.col(SPEC_ID) == s.id).select(*s.group_by, *s.outputs) for s in specs}
