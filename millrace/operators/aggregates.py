"""Mergeable aggregates, declared once as (partial, merge, finish) column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregate:
    """One aggregate over a group.

    ``partial`` maps intermediate names to aggregates over input rows, ``merge``
    to aggregates over partial rows (of the intermediate columns), and
    ``finish`` output names to scalar expressions over the intermediates.  One
    ``groupBy().agg()`` needs only ``partial`` and ``finish``; ``merge`` serves
    partials that were stored.
    """

    partial: dict[str, Column]
    merge: dict[str, Callable[[Column], Column]]
    finish: dict[str, Column] = field(default_factory=dict)

    @property
    def outputs(self) -> list[str]:
        return list(self.finish)


def _simple(name: str, partial: Column, merge: Callable[[Column], Column]) -> Aggregate:
    return Aggregate({name: partial}, {name: merge}, {name: F.col(name)})


def total(column: str, name: str) -> Aggregate:
    """Sum: bigint of integral, double of floating columns; nulls are skipped, a group of nulls sums to null."""
    return _simple(name, F.sum(column), F.sum)


def count_rows(name: str = "count") -> Aggregate:
    """Rows, null ones too; none merged from no partials are 0."""
    return Aggregate({name: F.count(F.lit(1))}, {name: F.sum}, {name: F.coalesce(F.col(name), F.lit(0))})


def minimum(column: str, name: str) -> Aggregate:
    return _simple(name, F.min(F.col(column).cast("bigint")), F.min)


def maximum(column: str, name: str) -> Aggregate:
    return _simple(name, F.max(F.col(column).cast("bigint")), F.max)


def average(column: str, sum_name: str = "sum", count_name: str = "count", name: str = "average") -> Aggregate:
    """Sum, number of values and their mean, from the first two."""
    return Aggregate(
        {sum_name: F.sum(column), count_name: F.count(column)},
        {sum_name: F.sum, count_name: F.sum},
        {sum_name: F.col(sum_name), count_name: F.coalesce(F.col(count_name), F.lit(0)), name: F.when(F.col(count_name) > 0, F.col(sum_name).cast("double") / F.col(count_name))},
    )


def distinct_sketch(columns: list[str], sketch_name: str = "hll_sketch", estimate_name: str | None = "cardinality", precision: int = 16) -> Aggregate:
    """Approximate number of distinct tuples, with the mergeable sketch (BINARY) it came from.

    Either name may be left out: ``estimate_name=None`` keeps only the sketch.
    """
    value = F.col(columns[0]) if len(columns) == 1 else F.xxhash64(*columns)
    finish = {sketch_name: F.col(sketch_name)}
    if estimate_name:
        finish[estimate_name] = F.hll_sketch_estimate(sketch_name)
    return Aggregate({sketch_name: F.hll_sketch_agg(value, precision)}, {sketch_name: lambda c: F.hll_union_agg(c)}, finish)


def approx_distinct(columns: list[str], name: str = "cardinality", precision: int = 16) -> Aggregate:
    """Only the estimate."""
    base = distinct_sketch(columns, f"__{name}", None, precision)
    return Aggregate(base.partial, base.merge, {name: F.hll_sketch_estimate(f"__{name}")})


def quantile_sketch(column: str, sketch_name: str = "quantiles", at: dict[str, float] | None = None, k: int = 1000) -> Aggregate:
    """A mergeable quantile sketch of longs (BINARY), and the quantiles named in ``at``."""
    finish = {sketch_name: F.col(sketch_name)}
    for name, q in (at or {}).items():
        finish[name] = F.kll_sketch_get_quantile_bigint(F.col(sketch_name), F.lit(q))
    return Aggregate({sketch_name: F.kll_sketch_agg_bigint(F.col(column).cast("bigint"), k)}, {sketch_name: lambda c: F.kll_merge_agg_bigint(c)}, finish)


def transformed(base: Aggregate, **finish: Column) -> Aggregate:
    """``base`` with further outputs computed from its intermediates."""
    return Aggregate(base.partial, base.merge, {**base.finish, **finish})
