"""Quality rules as a short-circuit cascade, ordered by what a sample says of their cost and rejections."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import materialized

#: Rows of the sample that orders the rules, and bytes of its texts, both as expected; the order changes the cost,
#: never a verdict.
SAMPLE_ROWS, SAMPLE_BYTES = 1_000, 32 << 20
_SPACE = r"[\x20\x09-\x0D]+"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed once: what a lambda names but doesn't bind is evaluated at every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("bigint")


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint")


def duplicate_lines(text: Column) -> Column:
    r"""\n-split lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words inside windows of ``width`` words that the text has twice or more, the first included.

    Windows are compared by 64-bit hashes within their text, made by doubling:
    a run's hash is that of the hashes of two shorter runs that cover it.  Only
    a text with two equal ones sorts them; then each window that has an equal
    neighbour covers the words up to its end that none before it did.
    """

    def windows(h: Column, size: int) -> Column:
        if size == width:
            return _bound(F.slice(h, 1, F.size(h) - (width - 1)), _covered(width))
        step = min(size, width - size)
        return _bound(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))), lambda g: windows(g, size + step))

    inside = _bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: windows(h, 1))
    return F.when(F.size(words) < width + 1, F.lit(0)).otherwise(inside).cast("bigint")


def _covered(width: int) -> Callable[[Column], Column]:
    def f(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bound(order, count))

    def count(order: Column) -> Column:
        hit = F.transform(order, lambda x, k: F.when(F.coalesce(x["h"] == F.get(order, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(order, k + 1)["h"], F.lit(False)), x["i"]))
        at = F.array_sort(F.array_compact(hit))
        return F.aggregate(at, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")), lambda s, x: F.struct((s["sum"] + x + width - F.greatest(x, s["end"])).alias("sum"), (x + width).alias("end")), lambda s: s["sum"])

    return f


def measured(docs: DataFrame, text: str) -> DataFrame:
    """Add word_chars, n_words, n_symbols, n_dup_lines and n_repeat_words (all bigint), computed within the row."""
    taken = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "__words")
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])
    base = base.withColumn("__words", words_of(F.col(f"`{text}`")))
    return base.withColumns(
        {
            "n_words": F.size("__words").cast("bigint"),
            "word_chars": word_chars(F.col("__words")),
            "n_symbols": symbols(F.coalesce(F.col(f"`{text}`"), F.lit(""))),
            "n_dup_lines": duplicate_lines(F.col(f"`{text}`")),
            "n_repeat_words": repeated_words(F.col("__words")),
        }
    ).drop("__words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets a column with the fields ``text`` and ``words``; true means that the text must go, null counts as false."""

    name: str
    rejects: Callable[[Column], Column]


def _parts(text: Column) -> Column:
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), words_of(text).alias("words"))


#: The base rules, and rules for text that is no prose.  Thresholds leave prose of any of the languages alone.
RULES = (
    Rule("too_few_words", lambda d: F.size(d["words"]) < 20),
    Rule("repeated_windows", lambda d: repeated_words(d["words"]) * 100 > F.size(d["words"]) * 30),
    Rule("symbols", lambda d: symbols(d["text"]) * 5 > F.size(d["words"])),
    Rule("duplicate_lines", lambda d: duplicate_lines(d["text"]) * 10 > F.size(F.split(d["text"], "\n")) * 5),
    Rule("word_length", lambda d: _bound(word_chars(d["words"]), lambda n: (n < F.size(d["words"]) * 2) | (n > F.size(d["words"]) * 20))),
)
#: What is left to the method where the base rules are decided already.
EXTRA = tuple(r for r in RULES if r.name not in ("too_few_words", "repeated_windows"))


def drawn(docs: DataFrame, text: str, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(t), about ``rows`` of the texts, drawn at random from all partitions without a shuffle; null is empty.

    Texts of any length are as likely; if so many take more than ``most_bytes``,
    fewer are drawn.  They are written where tasks read them, so none reaches
    the driver.
    """
    texts = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    n, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    share = min(1.0, rows / max(1, n), most_bytes / max(1, size))
    return materialized(texts.sample(share, seed=42) if share < 1 else texts, "sample")


#: Times that a rule is run over the sample, the fastest of which counts; bytes of texts that one run sees about, by
#: copies of a smaller sample.
RUNS, RUN_BYTES = 2, 4 << 20


def _seconds(sample: DataFrame, condition: Column, copies: int) -> float:
    """The fastest of some runs of one condition over copies of a kept sample, after one that compiles its code.

    Each run is a query of its own: one that is collected again skips the stage
    before its shuffle, which is where the condition is.
    """
    took = []
    for _ in range(1 + RUNS):
        began = time.perf_counter()
        sample.select("d", F.explode(F.sequence(F.lit(1), F.lit(copies)))).agg(F.count_if(condition)).collect()
        took.append(time.perf_counter() - began)
    return min(took[1:])


def measured_rules(docs: DataFrame, text: str, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], dict[int, int]]:
    """(seconds of each rule over the sample, number of sampled texts by the set of rules that reject them).

    A rule's time is what it takes beyond a condition that looks at nothing, so
    neither the start of a job nor splitting into words, which rules share, is
    in it.  Sets of rules are numbers with a bit per rule.
    """
    sample = drawn(docs, text, sample_rows).select(_parts(F.col("t")).alias("d")).persist()
    try:
        hits = [F.when(F.coalesce(r.rejects(F.col("d")), F.lit(False)), 1 << i).otherwise(0) for i, r in enumerate(rules)]
        sets = sample.groupBy(sum(hits, F.lit(0)).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col("d")["text"])).alias("bytes")).collect()
        copies = min(64, max(1, RUN_BYTES // max(1, sum(r["bytes"] for r in sets))))
        idle = _seconds(sample, F.size(F.col("d")["words"]) < 0, copies)
        return {r.name: max(1e-6, (_seconds(sample, r.rejects(F.col("d")), copies) - idle) / copies) for r in rules}, {r["k"]: r["n"] for r in sets}
    finally:
        sample.unpersist()


def by_rejections(rules: Sequence[Rule], seconds: Mapping[str, float], sets: Mapping[int, int]) -> list[Rule]:
    """The rules, each time the one that rejects most per second of the texts that those before it left.

    Where none rejects any more, and among equals, the cheapest goes first, then
    the one that stands first in ``rules``.
    """
    left, out, texts = dict(enumerate(rules)), [], dict(sets)
    while left:
        rejected = {i: sum(n for k, n in texts.items() if k >> i & 1) for i in left}
        best = max(left, key=lambda i: (rejected[i] / seconds[left[i].name], -seconds[left[i].name], -i))
        out.append(left.pop(best))
        texts = {k: n for k, n in texts.items() if not k >> best & 1}
    return out


def ordered(docs: DataFrame, text: str, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost, from a random sample of about ``sample_rows`` texts."""
    return by_rejections(rules, *measured_rules(docs, text, rules, sample_rows)) if len(rules) > 1 else list(rules)


def verdict(text: Column, rules: Sequence[Rule]) -> Column:
    """False as soon as a rule rejects: later rules aren't evaluated.  A text is split into words once for all rules."""

    def of(d: Column) -> Column:
        out = F
        for r in rules:
            out = out.when(F.coalesce(r.rejects(d), F.lit(False)), False)
        return out.otherwise(True) if rules else F.lit(True)

    return _bound(_parts(text), of)


def keep_good(docs: DataFrame, text: str, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, unchanged.  Null texts count as empty, and so have too few words."""
    return docs.filter(verdict(F.col(f"`{text}`"), ordered(docs, text, rules, sample_rows)))
