"""Long repeated byte strings, found with run-length indexes and removed.

Anchors bring candidates together: in every string of ``length`` bytes, the gram
with the smallest hash (the leftmost of equals) is its anchor, so two equal
strings have equal anchors at equal places.  The strings that share an anchor
occurrence lie side by side in one *context*, and a string belongs to one
context of its text only.  Contexts are compared where their anchors' hash sends
them, by a run-length compressed Burrows-Wheeler index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.arrow import byte_values, column, row_slices, whole_groups
from millrace.llm.store import materialized, passing

#: Bytes of text whose anchors are found at once.
CHUNK = 1 << 17
#: Symbols of one index, unless a single anchor has more; below 2**16 ranks sort as 16-bit integers.
INDEX = 60_000
#: Distinct contexts of one anchor that are indexed together; more are compared string by string, by hash.
ANCHOR_CONTEXTS = 1_000

_C = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def gram_size(length: int) -> int:
    """The anchors' gram: the largest power of two up to a quarter of the length."""
    if length < 32:
        raise ValueError("strings must have 32 bytes at least")
    return 1 << ((length // 4).bit_length() - 1)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each position on."""
    h = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)) * _C[0]
    h ^= h >> np.uint64(29)
    step = 8
    while step < size:
        n = len(h) - step
        x = h[:n] * _C[1]
        x += h[step:] * _C[2]
        x ^= x >> np.uint64(32)
        x *= _C[3]
        x ^= x >> np.uint64(29)
        h, step = x, 2 * step
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])


def contexts(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor hash, first, last) of each context: the strings that begin at first..last share an anchor.

    ``data`` holds texts one after another, ``ends`` where each ends.
    """
    size = gram_size(length)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    h = gram_hashes(data, size)
    place = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    anchor = (sliding_least(place, length - size + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(anchor)), "right")
    starts = np.flatnonzero(np.arange(len(anchor)) + length <= ends[text])
    if not len(starts):
        return none, none, none, none
    anchor, text = anchor[starts], text[starts]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[starts[new[1:] - 1], starts[-1]]
    return text[new], h[anchor[new]].view(np.int64), starts[new], last


OCCURRENCES = "t1 bigint, t2 bigint, anchor bigint, c1 bigint, c2 bigint, start bigint, size bigint, step bigint, times bigint"


def occurrences(texts: DataFrame, length: int) -> DataFrame:
    """The contexts of all texts: (t1, t2) names the text, (c1, c2) is the context's 128-bit hash.

    Equal contexts at an even distance, as periodic text has, are one row with
    ``step`` and ``times``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashed = xxhash.xxh3_128_digest
        for b in (part for whole in batches for part in row_slices(whole)):
            t1, t2 = b.column(0), b.column(1)
            values = byte_values(b.column(2))
            i = 0
            while i < len(values):
                k, total = i, 0
                while k < len(values) and (k == i or total < CHUNK):
                    total += len(values[k] or b"")
                    k += 1
                raw = b"".join(v or b"" for v in values[i:k])
                ends = np.cumsum([len(v or b"") for v in values[i:k]])
                text, anchor, first, last = contexts(np.frombuffer(raw, np.uint8), ends, length)
                if len(text):
                    size = last - first + length
                    c = np.frombuffer(b"".join([hashed(raw[a : a + n]) for a, n in zip(first.tolist(), size.tolist(), strict=True)]), "<i8").reshape(-1, 2)
                    start = first - (ends - np.diff(ends, prepend=0))[text]
                    rows = _periods(text, anchor, c, start, size)
                    at = pa.array(rows[0] + i)
                    yield pa.RecordBatch.from_arrays([t1.take(at), t2.take(at), *[pa.array(x) for x in rows[1:]]], names=[f.split()[0] for f in OCCURRENCES.split(", ")])
                i = k

    return texts.select("t1", "t2", "text").mapInArrow(run, OCCURRENCES)


def _periods(text: np.ndarray, anchor: np.ndarray, c: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    same = (text[1:] == text[:-1]) & (c[1:] == c[:-1]).all(1)
    gap = np.diff(start)
    # A row goes on with the one before if they are equal and, unless it is the second of its run, as far apart.
    joins = same.copy()
    for k in np.flatnonzero(same[1:] & same[:-1] & (gap[1:] != gap[:-1])).tolist():
        joins[k + 1] = not joins[k]
    head = np.flatnonzero(np.r_[True, ~joins])
    times = np.diff(np.r_[head, len(text)])
    step = np.where(times > 1, gap[np.minimum(head, max(len(gap) - 1, 0))] if len(gap) else 0, 0)
    return [text[head], anchor[head], c[head, 0], c[head, 1], start[head], size[head], step, times]


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array by prefix doubling, and the ranks by the first 1, 2, 4, ... symbols on the way."""
    n = len(symbols)
    kind = np.uint16 if n < 1 << 16 else np.int64
    _, rank = np.unique(symbols, return_inverse=True)
    ranks, order, h = [rank.astype(kind)], None, 1
    while True:
        rank = ranks[-1]
        second = np.zeros(n, kind)
        if h < n:
            second[: n - h] = rank[h:]
            second[: n - h] += 1
        if kind is np.uint16:
            by = np.argsort(second, kind="stable")
            order = by[np.argsort(rank[by], kind="stable")]
        else:
            order = np.argsort(rank * (n + 1) + second, kind="stable")
        a, b = rank[order], second[order]
        new = np.zeros(n, kind)
        new[order] = np.cumsum(np.r_[False, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]).astype(kind)
        if int(new[order[-1]]) == n - 1:
            return order, ranks
        ranks.append(new)
        h *= 2


class RunLengthIndex:
    """A run-length compressed Burrows-Wheeler transform with samples at the runs' ends.

    ``position`` holds the text positions at run heads, ``before`` the suffix
    that sorts just before each (the end of the run before), ``matched`` their
    common prefix.  Between two samples, in text order, the neighbour moves along
    with the position and the match shrinks by one, so matching statistics of
    every position stream from one sample per run.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        symbols = np.empty(int(sizes.sum()) + len(texts), np.int64)
        ends = np.cumsum(sizes + 1) - 1
        inside = np.ones(len(symbols), bool)
        inside[ends] = False
        symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + len(texts)
        symbols[ends] = np.arange(len(texts))
        self.size, self.starts = len(symbols), ends - sizes
        order, ranks = suffix_array(symbols)
        transform = symbols[order - 1]
        heads = np.flatnonzero(np.r_[True, transform[1:] != transform[:-1]])
        self.runs, self.run_symbols = len(heads), transform[heads]
        heads = heads[heads > 0]
        position, before = order[heads], order[heads - 1]
        by_text = np.argsort(position)
        self.position, self.before = position[by_text], before[by_text]
        self.matched = self._common(ranks, self.position, self.before)

    def _common(self, ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            x, y = a + out, b + out
            ok = (x < self.size) & (y < self.size)
            same = ok & (ranks[level][np.minimum(x, self.size - 1)] == ranks[level][np.minimum(y, self.size - 1)])
            out[same] += 1 << level
        return out

    def matching_statistics(self) -> np.ndarray:
        """For every position, how long it matches the suffix sorting before it, streamed from the samples."""
        at = np.searchsorted(self.position, np.arange(self.size), "right") - 1
        out = self.matched[at] - (np.arange(self.size) - self.position[at])
        out[at < 0] = 0
        return np.maximum(out, 0)

    def repeated(self, length: int) -> np.ndarray:
        """Which bytes of the concatenated texts lie in a match of ``length`` or more, on either side of it."""
        long = self.matched >= length
        change = np.zeros(self.size + 1, np.int64)
        n = self.matched[long]
        for start in (self.position[long], self.before[long]):
            np.add.at(change, start, 1)
            np.add.at(change, start + n, -1)
        return np.cumsum(change[:-1]) > 0


def spans_of(flags: np.ndarray) -> np.ndarray:
    """(start, end) rows of the runs of true."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return edge.reshape(-1, 2)


def _indexed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for _, t in whole_groups(batches, "anchor", 1 << 62, target=400):
        anchor = column(t, "anchor")
        texts = t.column("context").to_pylist()
        c1, c2 = column(t, "c1"), column(t, "c2")
        edges = np.r_[np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]), len(anchor)].tolist()
        i = 0
        while i < len(edges) - 1:
            k, total = i, 0
            while k < len(edges) - 1:
                more = sum(len(x) + 1 for x in texts[edges[k] : edges[k + 1]])
                if k > i and total + more > INDEX:
                    break
                total += more
                k += 1
            lo, hi = edges[i], edges[k]
            index = RunLengthIndex(texts[lo:hi])
            flags = index.repeated(length)
            at, spans = [], []
            for j, s in enumerate(index.starts.tolist()):
                own = spans_of(flags[s : s + len(texts[lo + j])])
                if len(own):
                    at.append(lo + j)
                    spans.append(own.astype("<i4").tobytes())
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(c1[at]), pa.array(c2[at]), pa.array(spans, pa.binary())], names=["c1", "c2", "spans"])
            i = k


def _string_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        t = pa.Table.from_batches([b])
        c1, c2, n = column(t, "c1"), column(t, "c2"), column(t, "n")
        for i, x in enumerate(b.column(b.schema.get_field_index("context")).to_pylist()):
            k = len(x) - length + 1
            s = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x[j : j + length]) for j in range(k)]), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(np.full(k, c1[i])), pa.array(np.full(k, c2[i])), pa.array(np.arange(k)), pa.array(np.full(k, n[i]))], names=["s1", "s2", "c1", "c2", "at", "n"])


def repeated_contexts(found: DataFrame, texts: DataFrame, length: int, most: int = ANCHOR_CONTEXTS) -> DataFrame:
    """(c1, c2, spans): which bytes of each distinct context repeat; spans are pairs of 32-bit integers, null for all of it.

    Contexts that occur twice repeat as a whole.  Others repeat in part if
    another context of their anchor shares a string: these, one copy each, are
    indexed where their anchor sends them.  Anchors with more than ``most``
    distinct contexts don't go to one task: their strings are hashed and counted
    one by one instead, over all tasks.
    """
    distinct = found.groupBy("anchor", "c1", "c2").agg(F.sum("times").alias("n"), F.min(F.struct("t1", "t2", "start", "size")).alias("one"))
    distinct = materialized(distinct, "contexts")
    per_anchor = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    wanted = distinct.join(per_anchor, "anchor").select("anchor", "c1", "c2", "n", "kinds", F.col("one.t1").alias("t1"), F.col("one.t2").alias("t2"), F.col("one.start").alias("start"), F.col("one.size").alias("size"))
    # Written for the same reason as the spans below: AQE splits only joins whose two sides come from their own shuffles.
    wanted = materialized(wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("anchor", "c1", "c2", "n", "kinds", "start", "size")).alias("cells")), "wanted")
    cut = F.transform("cells", lambda c: F.struct(c["anchor"].alias("anchor"), c["c1"].alias("c1"), c["c2"].alias("c2"), c["n"].alias("n"), c["kinds"].alias("kinds"), F.substring("raw", (c["start"] + 1).cast("int"), c["size"].cast("int")).alias("context")))
    bodies = texts.join(wanted, ["t1", "t2"]).select(F.col("text").cast("binary").alias("raw"), "cells").select(F.inline(cut)).dropDuplicates(["anchor", "c1", "c2"])
    bodies = materialized(bodies, "bodies")
    indexed = bodies.filter(F.col("kinds") <= most).select("anchor", "c1", "c2", "context").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: _indexed(b, length), "c1 bigint, c2 bigint, spans binary")
    strings = bodies.filter(F.col("kinds") > most).select("c1", "c2", "n", "context").mapInArrow(lambda b: _string_rows(b, length), "s1 bigint, s2 bigint, c1 bigint, c2 bigint, at bigint, n bigint")
    twice = strings.groupBy("s1", "s2").agg(F.sum("n").alias("total")).filter("total > 1")
    hashed = strings.join(twice, ["s1", "s2"]).groupBy("c1", "c2").agg(F.collect_list("at").alias("at"))
    hashed = hashed.mapInArrow(lambda b: _united(b, length), "c1 bigint, c2 bigint, spans binary")
    whole = distinct.filter("n > 1").select("c1", "c2", F.lit(None).cast("binary").alias("spans"))
    part = indexed.unionByName(hashed).join(whole.select("c1", "c2"), ["c1", "c2"], "left_anti")
    return whole.unionByName(part)


def _united(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for at in b.column(2).to_pylist():
            flags = np.zeros(max(at) + length + 1, np.int64)
            np.add.at(flags, at, 1)
            np.add.at(flags, np.array(at) + length, -1)
            out.append(spans_of(np.cumsum(flags) > 0).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["c1", "c2", "spans"])


def text_names(text: str) -> list:
    """Two 64-bit hashes that together name a text."""
    return [F.xxhash64(F.col(text)).alias("t1"), F.xxhash64(F.lit(7), F.col(text)).alias("t2")]


def remove_repeats(docs: DataFrame, text: str, length: int = 400, most: int = ANCHOR_CONTEXTS, characters: bool = False) -> DataFrame:
    """Add ``kept`` (binary) and ``removed``, without the bytes that strings of ``length`` cover which occur elsewhere too.

    Texts are UTF-8 bytes; null counts as empty.  A string occurs elsewhere if it
    starts at another place of any text, its own included, so of repeated rows
    with ``length`` bytes or more nothing is kept.  Overlaps count, matches never
    cross texts, and all is judged on the input.  ``removed`` is an array of
    (start, end) structs in bytes, maximal and ascending.  Columns of these names
    are replaced, all others and all rows stay.  With ``characters``, spans are
    extended to the ends of characters that they cut.

    Equal texts are indexed once, under their hash and with their number.
    """
    names = [c for c in docs.columns if c.lower() not in ("kept", "removed")]
    plain = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(plain.alias("text")).select("text", *text_names("text"))
    with passing(docs.sparkSession) as stay:
        found = materialized(occurrences(texts, length), "occurrences")
        spans = repeated_contexts(found, texts, length, most)
        hits = found.join(spans, ["c1", "c2"]).select("t1", "t2", "start", "size", "step", "times", "spans").dropDuplicates(["t1", "t2", "start"])
        # Written, so that the join below reads both sides from shuffles of its own and AQE may split a text with many copies.
        per_text = materialized(hits.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "size", "step", "times", "spans")).alias("hits")), "hits")
        stay.append(per_text)
    named = docs.select(*[F.col(f"`{c}`") for c in names], plain.alias("__text")).withColumns({"__t1": F.xxhash64("__text"), "__t2": F.xxhash64(F.lit(7), F.col("__text"))})
    joined = named.join(per_text, (F.col("__t1") == F.col("t1")) & (F.col("__t2") == F.col("t2")), "left").drop("t1", "t2", "__t1", "__t2")
    schema = joined.select(*[F.col(f"`{c}`") for c in names]).schema.add("kept", T.BinaryType()).add("removed", T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType())))
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in row_slices(whole)):
            kept, removed = [], []
            for value, hits in zip(byte_values(b.column(width)), b.column(width + 1).to_pylist(), strict=True):
                own = _removal(len(value), hits)
                if characters:
                    own = _whole_characters(value, own)
                removed.append([{"start": s, "end": e} for s, e in own])
                if not own:
                    kept.append(value)
                else:
                    edges = [0, *[x for span in own for x in span], len(value)]
                    kept.append(b"".join(value[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=schema.names)

    return joined.mapInArrow(run, schema)


def _removal(size: int, hits: list[dict] | None) -> list[tuple[int, int]]:
    if not hits:
        return []
    change = np.zeros(size + 1, np.int32)
    for h in hits:
        spans = np.array([[0, h["size"]]]) if h["spans"] is None else np.frombuffer(h["spans"], "<i4").reshape(-1, 2).astype(np.int64)
        shifts = h["start"] + h["step"] * np.arange(h["times"])
        for s, e in spans.tolist():
            np.add.at(change, shifts + s, 1)
            np.add.at(change, shifts + e, -1)
    return [tuple(x) for x in spans_of(np.cumsum(change[:-1]) > 0).tolist()]


def _whole_characters(value: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans with the rest of each character that an end of theirs cuts; those that then touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        first = s
        while first > 0 and s - first < 3 and value[first] & 0xC0 == 0x80:
            first -= 1
        # Continuation bytes after a shorter character, or after none, belong to no character that could be cut.
        lead = value[first]
        if first < s and s - first < (4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1):
            s = first
        most = min(len(value), e + 3)
        last = e - 1
        while last > 0 and e - last < 4 and value[last] & 0xC0 == 0x80:
            last -= 1
        lead = value[last]
        whole = last + (4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1)
        while e < min(whole, most) and value[e] & 0xC0 == 0x80:
            e += 1
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out
