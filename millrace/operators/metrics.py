"""Row counters that ride along with a plan, and wrappers that count what a step takes and gives.

Counters are observed metrics: they cost no extra pass, are exact under task
retries, and are filled by the first action on the plan.  A plan that runs twice
counts once per run, so read them after one action.
"""

from __future__ import annotations

import inspect
import os
from collections import defaultdict
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: The counters' names.
INPUT, OUTPUT, KEPT, REMOVED, GROUPS = "Input records", "Output records", "Kept records", "Removed records", "Input groups"
EVICTED, FILTERED, REJECTED = "Evicted records", "Filtered records", "Rejected records"


@dataclass(frozen=True, order=True)
class Counter:
    group: str
    name: str
    value: int


def caller_label(operation: str, depth: int = 2) -> tuple[str, str]:
    """(source file, "<line> - <operation>") of the code that called the caller."""
    frame = inspect.stack()[depth]
    return os.path.splitext(os.path.basename(frame.filename))[0] or "Stats", f"{frame.lineno} - {operation}"


class Counters:
    """The counters of one run.  ``group`` defaults to the empty string."""

    def __init__(self) -> None:
        self._pending: list[tuple[Observation, dict[str, tuple[str, str, int]]]] = []
        self._known: dict[tuple[str, str], int] = defaultdict(int)

    def observe(self, df: DataFrame, counters: Mapping[tuple[str, str], Column], signs: Mapping[tuple[str, str], int] | None = None) -> DataFrame:
        """Attach aggregates to ``df``; each becomes a counter."""
        seen = Observation()
        names = {f"c{i}": (g, n, (signs or {}).get((g, n), 1)) for i, (g, n) in enumerate(counters)}
        self._pending.append((seen, names))
        return df.observe(seen, *[c.alias(f"c{i}") for i, c in enumerate(counters.values())])

    def add(self, group: str, name: str, value: int) -> None:
        self._known[(group, name)] += value

    def increment(self, df: DataFrame, name: str, group: str = "") -> DataFrame:
        """One per row."""
        return self.observe(df, {(group, name): F.count(F.lit(1))})

    def increment_for_values(self, df: DataFrame, values: Mapping[str, Any], name: str, group: str = "") -> DataFrame:
        """One per row whose fields all equal the given values; null equals null."""
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in values.items()])
        return self.observe(df, {(group, name): F.count_if(same)})

    def sum_of(self, df: DataFrame, column: str, name: str, group: str = "") -> DataFrame:
        """The sum of an integral column, nulls counting nothing."""
        return self.observe(df, {(group, name): F.coalesce(F.sum(F.col(column).cast("bigint")), F.lit(0))})

    def stats_filter(self, df: DataFrame, keep: Column, label: tuple[str, str] | None = None) -> DataFrame:
        """Filter, counting input, kept and removed rows in one observation before the filter."""
        group, name = label or caller_label("Filter")
        kept = F.count_if(keep)
        counters = {(group, f"{name} - {INPUT}"): F.count(F.lit(1)), (group, f"{name} - {KEPT}"): kept, (group, f"{name} - {REMOVED}"): F.count(F.lit(1)) - kept}
        return self.observe(df, counters).filter(keep)

    def stats_map(self, df: DataFrame, function: Callable[[DataFrame], DataFrame], label: tuple[str, str] | None = None) -> DataFrame:
        """Apply a row function (0 to n rows per row), counting rows before and after."""
        group, name = label or caller_label("Function")
        before = self.observe(df, {(group, f"{name} - {INPUT}"): F.count(F.lit(1))})
        return self.observe(function(before), {(group, f"{name} - {OUTPUT}"): F.count(F.lit(1))})

    def stats_aggregate(self, df: DataFrame, function: Callable[[DataFrame], DataFrame], label: tuple[str, str] | None = None) -> DataFrame:
        """Aggregate, counting rows in and rows out."""
        group, name = label or caller_label("Aggregator")
        before = self.observe(df, {(group, f"{name} - {INPUT}"): F.count(F.lit(1))})
        return self.observe(function(before), {(group, f"{name} - Total output records"): F.count(F.lit(1))})

    def stats_groups(self, df: DataFrame, keys: list[str], function: Callable[[DataFrame], DataFrame], label: tuple[str, str] | None = None) -> DataFrame:
        """Run a whole-group function, counting groups in and rows out.

        Groups can't be counted by an observation over rows, so a key aggregate
        counts them, in a job of its own.
        """
        group, name = label or caller_label("Buffer")
        self.add(group, f"{name} - {GROUPS}", df.select(*keys).distinct().count())
        return self.observe(function(df), {(group, f"{name} - {OUTPUT}"): F.count(F.lit(1))})

    def collect(self) -> list[Counter]:
        """All counters, sorted.  Waits for plans that haven't run."""
        for seen, names in self._pending:
            got = seen.get
            for c, (group, name, sign) in names.items():
                self._known[(group, name)] += sign * int(got.get(c) or 0)
        self._pending.clear()
        return sorted(Counter(g, n, v) for (g, n), v in self._known.items())

    def get(self, name: str, group: str = "") -> int:
        return {(c.group, c.name): c.value for c in self.collect()}.get((group, name), 0)

    def by_group(self) -> dict[str, dict[str, int]]:
        out: dict[str, dict[str, int]] = {}
        for c in self.collect():
            out.setdefault(c.group, {})[c.name] = c.value
        return out


def humanised(n: int) -> str:
    """Bytes in the largest unit that leaves at least one."""
    value = float(n)
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if value < 1024 or unit == "TB":
            return f"{value:.0f} {unit}" if unit == "B" else f"{value:.1f} {unit}"
        value /= 1024
    raise AssertionError


def report(counters: Mapping[str, Mapping[str, int]], read: str = "Tuples Read", written: str = "Tuples Written") -> str:
    """Counters as text, by group; names with "bytes" are humanised.

    A run that read rows and wrote none gets a warning line: it is a black hole.
    """
    lines = []
    for group in sorted(counters):
        lines.append(group or "(no group)")
        for name, value in sorted(counters[group].items()):
            lines.append(f"  {name}: {humanised(value) if 'bytes' in name.lower() else value}")
    flat: dict[str, int] = defaultdict(int)
    for group in counters.values():
        for name, value in group.items():
            flat[name] += value
    if flat.get(read, 0) > 0 and flat.get(written, 0) == 0:
        lines.append("*** BLACK HOLE WARNING *** rows were read, none were written")
    return "\n".join(lines)
