"""Key joins, semi-join filters and joins with a per-key row limit."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.bloom import BloomSettings, runtime_filter
from millrace.operators.metrics import FILTERED, INPUT, Counters

#: Joins of (large, small) that keep all rows of the large side, or of both: no filter may drop rows of it then.
_KEEPS_LARGE = {"left", "full"}


def _names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _condition(left: DataFrame, lk: Sequence[str], right: DataFrame, rk: Sequence[str], null_safe: bool) -> Column:
    if len(lk) != len(rk) or not lk:
        raise ValueError("both sides need the same, positive number of keys")
    out = None
    for a, b in zip(lk, rk, strict=True):
        one = left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b]
        out = one if out is None else out & one
    return out


def _renamed(first: DataFrame, second: DataFrame, rename: Sequence[str] | None, suffix: str) -> tuple[DataFrame, DataFrame]:
    """Both inputs with names that don't clash: all given, or the second's own with a suffix where taken."""
    width = len(first.columns)
    if rename is not None:
        names = list(rename)
        if len(names) != width + len(second.columns):
            raise ValueError("rename needs a name for every column of both sides")
        if len({n.lower() for n in names}) != len(names):
            raise ValueError("rename has a name twice")
        return first.toDF(*names[:width]), second.toDF(*names[width:])
    taken = {c.lower() for c in first.columns}
    names = []
    for c in second.columns:
        while c.lower() in taken:
            c += suffix
        taken.add(c.lower())
        names.append(c)
    return first, second.toDF(*names)


def key_join(
    large: DataFrame,
    large_keys: str | Sequence[str],
    small: DataFrame,
    small_keys: str | Sequence[str],
    how: str = "inner",
    order: str = "large_first",
    rename: Sequence[str] | None = None,
    suffix: str = "_right",
    null_safe: bool = False,
    bloom: BloomSettings | None = None,
    counters: Counters | None = None,
) -> DataFrame:
    """Join a large with a small input on equal keys.

    ``how`` names the rows that stay: ``inner``, ``keep_large`` (all rows of the
    large side), ``keep_small`` or ``full``.  ``order`` puts the columns of the
    large side first (``large_first``) or last (``small_first``).  Names that
    clash get ``suffix``, or all columns get ``rename``.

    Catalyst picks the join and adds its own runtime filter where one pays.
    ``bloom`` adds an explicit one before the shuffle, for inputs whose sizes
    Catalyst can't know; it is left out where it could lose rows of the large
    side (``keep_large``, ``full``) or under ``null_safe``, whose null keys no
    filter holds, and where it can't pay (see :class:`BloomSettings`).
    ``counters`` gets the large side's rows and those that the filter drops.
    """
    kinds = {"inner": "inner", "keep_large": "left", "keep_small": "right", "full": "full"}
    if how not in kinds:
        raise ValueError(f"how must be one of {sorted(kinds)}")
    if order not in ("large_first", "small_first"):
        raise ValueError("order must be large_first or small_first")
    lk, sk = _names(large_keys), _names(small_keys)
    kind = kinds[how]
    if bloom is not None and kind not in _KEEPS_LARGE and not null_safe:
        if bloom.force or bloom.num_bits is not None or kind != "inner" or not _broadcast(small):
            large = _filtered(large, lk, small, sk, bloom, counters)
    flip = order == "small_first"
    first, second = (small, large) if flip else (large, small)
    fk, rk = (sk, lk) if flip else (lk, sk)
    fi, ri = ([df.columns.index(k) for k in ks] for df, ks in ((first, fk), (second, rk)))
    a, b = _renamed(first, second, rename, suffix)
    on = _condition(a, [a.columns[i] for i in fi], b, [b.columns[i] for i in ri], null_safe)
    if flip:
        kind = {"left": "right", "right": "left"}.get(kind, kind)
    return a.join(b, on, kind)


def _broadcast(small: DataFrame) -> bool:
    """Whether Spark will broadcast the table by its own estimate of the size."""
    size = int(str(small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= small.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def _filtered(large: DataFrame, lk: Sequence[str], small: DataFrame, sk: Sequence[str], settings: BloomSettings, counters: Counters | None) -> DataFrame:
    types = _common_types(large, lk, small, sk)
    test = runtime_filter(small, sk, settings, types)
    if test is None:
        return large
    hit = test(large, lk)
    if counters is not None:
        large = counters.observe(large, {("BloomJoin", INPUT): F.count(F.lit(1)), ("BloomJoin", FILTERED): F.count_if(~hit)})
    return large.filter(hit)


#: Spark types by width, for keys that are compared by hash.
_WIDTH = ["tinyint", "smallint", "int", "bigint"]


def _decimal(kind: str) -> tuple[int, int] | None:
    """(digits before the point, digits after it) of a decimal or integral type."""
    if kind in _WIDTH:
        return 20, 0
    if m := re.fullmatch(r"decimal\((\d+),(\d+)\)", kind):
        return int(m[1]) - int(m[2]), int(m[2])
    return None


def _common_types(large: DataFrame, lk: Sequence[str], small: DataFrame, sk: Sequence[str]) -> list[str]:
    """One type per key that both sides are cast to, so that equal keys hash alike."""
    out = []
    for a, b in zip(lk, sk, strict=True):
        x, y = dict(large.dtypes)[a], dict(small.dtypes)[b]
        if x == y:
            out.append(x)
        elif x in _WIDTH and y in _WIDTH:
            out.append(max(x, y, key=_WIDTH.index))
        elif {x, y} <= {*_WIDTH, "float", "double"}:
            out.append("double")
        elif (p := _decimal(x)) and (q := _decimal(y)) and max(p[0], q[0]) + max(p[1], q[1]) <= 38:
            out.append(f"decimal({max(p[0], q[0]) + max(p[1], q[1])},{max(p[1], q[1])})")
        else:
            raise TypeError(f"keys {a} and {b} have types {x} and {y}")
    return out


def semi_filter(
    large: DataFrame,
    large_keys: str | Sequence[str],
    small: DataFrame,
    small_keys: str | Sequence[str],
    exact: bool = True,
    null_safe: bool = False,
    bloom: BloomSettings | None = None,
    counters: Counters | None = None,
) -> DataFrame:
    """Rows of ``large`` whose key occurs in ``small``; each row once, however often the key does.

    Exact: a left-semi join.  Inexact: only a Bloom filter is asked, the large
    side is not shuffled, no member is lost and a few strangers may stay; rows
    with a null key go.  If the filter would let most strangers pass, none is
    made and all rows stay.
    """
    lk, sk = _names(large_keys), _names(small_keys)
    if not exact:
        return _filtered(large, lk, small, sk, bloom or BloomSettings(), counters)
    names = [f"__key_{i}" for i in range(len(sk))]
    keys = small.select([F.col(k).alias(n) for k, n in zip(sk, names, strict=True)])
    return large.join(keys, _condition(large, lk, keys, names, null_safe), "left_semi")


def _first_rows(df: DataFrame, keys: Sequence[str], limit: int | None, order_by: Sequence[str | Column]) -> DataFrame:
    if limit is None:
        return df
    if limit < 0:
        raise ValueError("a limit must not be negative")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= limit).drop("__rank")


def limit_join(
    left: DataFrame,
    left_keys: str | Sequence[str],
    right: DataFrame,
    right_keys: str | Sequence[str],
    limits: tuple[int | None, int | None],
    left_order: Sequence[str | Column],
    right_order: Sequence[str | Column],
    suffix: str = "_right",
) -> DataFrame:
    """Inner join to which each side gives at most ``limits`` rows per key.

    The orders say which rows those are, so that the result is fixed; ``None``
    stands for no limit.  The rank filter becomes a window group limit, which
    cuts hot keys before they are shuffled, and the join reuses the windows'
    partitioning.
    """
    lk, rk = _names(left_keys), _names(right_keys)
    a = _first_rows(left, lk, limits[0], left_order)
    b = _first_rows(right, rk, limits[1], right_order)
    return key_join(a, lk, b, rk, suffix=suffix)
