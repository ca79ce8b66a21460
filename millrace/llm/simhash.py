"""SimHash fingerprints of word shingles, and near duplicates by multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import add_columns, byte_values, column, whole_groups
from millrace.llm.components import connected_components, join_labels
from millrace.llm.store import materialized, passing

#: Rows of a table key that one task compares at once; a larger key is split into blocks, pair by pair.
KEY_ROWS = 20_000
#: Rows of a candidate component that one task compares by their shingles; a larger one is dealt to blocks, as
#: many as the square root of its rows over ``BLOCK_ROOT``, or as bytes of shingle hashes over ``BLOCK_BYTES``.
GROUP_ROWS, BLOCK_ROOT, BLOCK_BYTES = 200, 5, 16 << 20


@dataclass(frozen=True)
class Scheme:
    """How texts become fingerprints, and which fingerprints link.

    Fingerprints have ``bits`` bits and link at ``radius`` or fewer differing
    ones.  They are cut into segments, and pairs are looked up that agree in one
    of them but for one bit at most.  If the segments cover all bits and
    ``radius < 2 * segments``, that finds every pair; for larger radii it finds a
    pair with the chance that one of its segments is that close.  More segments
    than the bits have room for are cut from further, random orders of the bits.

    With a ``similarity``, fingerprints are of distinct shingles, pairs within
    the radius are only candidates, and those link whose sets of shingles have
    that Jaccard similarity or more.
    """

    shingle: int = 5
    bits: int = 64
    radius: int = 3
    segments: int = 2
    segment_bits: int = 32
    seed: int = 42
    similarity: float | None = None

    def __post_init__(self) -> None:
        if self.bits % 64 or not 2 <= self.segment_bits <= min(48, self.bits) or self.segment_bits % 2 or not 0 < self.segments < 1 << 14:
            raise ValueError("bits must be a multiple of 64, and segments have an even number of them, 48 at most")

    @property
    def words(self) -> list[str]:
        return [f"f{i}" for i in range(self.bits // 64)]

    @property
    def node(self) -> list[str]:
        """The columns that make texts one node: what is compared of them is equal."""
        return self.words if self.similarity is None else [*self.words, "shingles"]

    def places(self) -> list[np.ndarray]:
        """The bits of each segment."""
        r = np.random.default_rng(self.seed)
        fit, order, out = self.bits // self.segment_bits, np.arange(self.bits), []
        while len(out) < self.segments:
            out += np.split(order[: fit * self.segment_bits], fit)
            order = r.permutation(self.bits)
        return out[: self.segments]


#: Near copies of 0.8 similarity or more on five-word shingles.  At a Jaccard similarity of 0.8 vectors of
#: shingles are about 0.476 radians apart, so 0.1515 of 256 bits (39 of them) differ, give or take 6; 61 leaves
#: room for nearly all.  What else is as near, as are some texts that are 0.65 alike, the shingle sets rule out.
NEAR_COPIES = Scheme(shingle=5, bits=256, radius=61, segments=16, segment_bits=16, similarity=0.8)
#: The share of pairs at the similarity itself that the segments should find, and unlike texts that a text may meet in
#: them by chance, on average.
RECALL, MEETINGS = 0.97, 1000


def expected_recall(similarity: float, bits: int, segment_bits: int, segments: int) -> float:
    """The share of pairs of such a Jaccard similarity of which some segment differs in one bit at most.

    Over the binomial number of bits that differ in all; segments are taken as
    drawn at random, each with its own order of the bits.
    """
    differ = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    out = 0.0
    for d in range(bits + 1):
        chance = math.comb(bits, d) * differ**d * (1 - differ) ** (bits - d)
        close = (math.comb(bits - d, segment_bits) + d * math.comb(bits - d, segment_bits - 1)) / math.comb(bits, segment_bits)
        out += chance * (1 - (1 - close) ** segments)
    return out


def sized(scheme: Scheme, texts: int, recall: float = RECALL, meetings: int = MEETINGS) -> Scheme:
    """The scheme with the shortest segments in which texts meet few others by chance, and as many as find ``recall`` of the pairs.

    So the comparisons grow in proportion to the texts, and the table rows of one
    text with about the fourth root of their number.
    """
    out = scheme
    for bits in range(16, 50, 2):
        segments = 1
        while expected_recall(scheme.similarity, scheme.bits, bits, segments) < recall:
            segments += max(1, segments // 20)
        out = replace(scheme, segment_bits=bits, segments=segments)
        if chance_meetings(out, texts) <= meetings:
            break
    return out


def chance_meetings(scheme: Scheme, texts: int) -> float:
    """How many unlike texts a text is compared with on average."""
    return texts * scheme.segments * (scheme.segment_bits + 1) / 2.0**scheme.segment_bits

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: bytes, size: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``size`` lower-cased words, or of all words where there are fewer; none for no words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    one = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([one(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - size].tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    return np.array([one(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)


def majority(h: np.ndarray, words: int) -> np.ndarray:
    """The bits that are set in over half of the hashes; further words of 64 bits are mixed from each hash."""
    counts = np.zeros(64 * words, np.int64)
    for k in range(0, len(h), 255 * 64):
        part = h[k : k + 255 * 64]
        rows = part[:, None] if words == 1 else np.concatenate([part[:, None], _mixed(part[:, None] + _MIX[0] * np.arange(1, words, dtype=np.uint64))], 1)
        bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        whole = len(part) // 255
        if whole:
            counts += bits[: whole * 255].reshape(whole, 255, -1).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        counts += bits[whole * 255 :].sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, text: str, scheme: Scheme) -> DataFrame:
    """Add the fingerprint as ``bigint`` columns f0, f1, ...; null, empty and wordless texts get all zeros.

    For a scheme with a similarity, ``shingles`` is added too, a hash of the set of shingles.
    """
    named = scheme.node

    def start() -> Callable[..., list]:
        import xxhash

        def run(texts: pa.Array) -> list:
            out = np.zeros((len(texts), len(named)), np.uint64)
            for i, t in enumerate(byte_values(texts)):
                if t and len(h := shingle_hashes(t, scheme.shingle, scheme.seed)):
                    if scheme.similarity is not None:
                        h = np.unique(h)
                        out[i, -1] = xxhash.xxh64_intdigest(h.tobytes())
                    out[i, : len(scheme.words)] = majority(h, len(scheme.words))
            return [pa.array(np.ascontiguousarray(out[:, w]).view(np.int64)) for w in range(out.shape[1])]

        return run

    return add_columns(docs, [F.col(text)], ", ".join(f"{w} bigint" for w in named), start)


def table_rows(fps: DataFrame, scheme: Scheme) -> DataFrame:
    """Each fingerprint once per segment and half of it: (route, rest, id, f0...).

    Two segments that differ in one bit at most agree in one of their halves, so
    a table is keyed by (segment, half) and the balls of radius one are walked
    in the other half, where the key's rows are.
    """
    half = scheme.segment_bits // 2
    mask = np.uint64((1 << half) - 1)
    places = np.concatenate(scheme.places())
    names = ["route", "rest", "id", *scheme.words]
    rows = max(1, 40_000 // (2 * scheme.segments))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, rows) for whole in batches for k in range(0, whole.num_rows, rows)):
            n = b.num_rows
            x = np.stack([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in b.columns[1:]], 1)
            bits = np.unpackbits(x.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")[:, places].reshape(n, scheme.segments, -1)
            value = np.zeros((n, scheme.segments, 8), np.uint8)
            packed = np.packbits(bits, axis=2, bitorder="little")
            value[:, :, : packed.shape[2]] = packed
            value = value.view(np.uint64)[:, :, 0]
            ends = np.stack([value & mask, value >> np.uint64(half)], 2)
            table = np.arange(2 * scheme.segments, dtype=np.uint64).reshape(scheme.segments, 2) << np.uint64(half)
            at = pa.array(np.repeat(np.arange(n), 2 * scheme.segments))
            cols = [pa.array((ends + table).ravel().view(np.int64)), pa.array(np.ascontiguousarray(ends[:, :, ::-1]).ravel().view(np.int64)), *[c.take(at) for c in b.columns]]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return fps.select("id", *scheme.words).mapInArrow(run, "route bigint, rest bigint, id bigint, " + ", ".join(f"{w} bigint" for w in scheme.words))


def ball_pairs(at: np.ndarray, bits: int, block: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions of a sorted array whose values are equal or differ in one of the low ``bits``, in blocks."""
    n = len(at)
    if not n:
        return
    edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
    values = at[edges[:-1]]
    for flip in [0, *[1 << k for k in range(bits)]]:
        if flip:
            # Each pair is met once, from the value without the bit.
            low = np.flatnonzero(values & np.uint64(flip) == 0)
            to = np.searchsorted(values, values[low] | np.uint64(flip))
            met = to < len(values)
            met[met] = values[to[met]] == values[low[met]] | np.uint64(flip)
            low, to = low[met], to[met]
            size = edges[low + 1] - edges[low]
            rows = np.repeat(edges[low] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            lo, counts = np.repeat(edges[to], size), np.repeat(edges[to + 1] - edges[to], size)
        else:
            rows = np.arange(n)
            lo = rows + 1
            counts = np.repeat(edges[1:], np.diff(edges)) - lo
            some = counts > 0
            rows, lo, counts = rows[some], lo[some], counts[some]
        ends = np.cumsum(counts)
        row = 0
        while row < len(rows):
            stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + block, "right")))
            c = counts[row:stop]
            yield np.repeat(rows[row:stop], c), np.repeat(lo[row:stop] - np.cumsum(c) + c, c) + np.arange(int(c.sum()))
            row = stop


def _linker(scheme: Scheme, cap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["a", "b", "key", "rest", *scheme.words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large, t in whole_groups(batches, "route", cap):
            ids = column(t, "id")
            if large:
                cols = [ids, ids, column(t, "route"), column(t, "rest"), *[column(t, w) for w in scheme.words]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)
                continue
            route = column(t, "route")
            place = np.cumsum(np.r_[0, route[1:] != route[:-1]]).astype(np.uint64) << np.uint64(32)
            at = place | column(t, "rest").astype(np.uint64)
            order = np.argsort(at, kind="stable")
            at, ids = at[order], ids[order]
            x = np.stack([column(t, w).view(np.uint64)[order] for w in scheme.words], 1)
            labels = np.arange(len(ids))
            for i, j in ball_pairs(at, scheme.segment_bits // 2):
                differ = np.bitwise_count(x[i] ^ x[j]).sum(1, dtype=np.int32)
                near = (differ <= scheme.radius) & (ids[i] != ids[j])
                if near.any():
                    labels = join_labels(labels, i[near], j[near])
            moved = np.flatnonzero(labels != np.arange(len(ids)))
            if len(moved):
                none = pa.nulls(len(moved), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[labels[moved]]), *[none] * (len(names) - 2)], names=names)

    return run


def links(fps: DataFrame, scheme: Scheme, cap: int = KEY_ROWS) -> DataFrame:
    """Edges (a, b) that connect the same fingerprints as all pairs within the radius do.

    ``fps`` has one row per distinct fingerprint, with an ``id``.  A task holds
    whole table keys and returns a row per fingerprint that has a partner there,
    never pairs.  Keys of more than ``cap`` rows come back as they are and are
    split: their rows are dealt to blocks, and each pair of blocks is compared
    by a task of its own, so that no pair is lost and no task holds more.
    """
    schema = "a bigint, b bigint, key bigint, rest bigint, " + ", ".join(f"{w} bigint" for w in scheme.words)
    run = _linker(scheme, cap)
    found = materialized(table_rows(fps, scheme).repartition("route").sortWithinPartitions("route").mapInArrow(run, schema), "links")
    edges = found.filter("key IS NULL").select("a", "b")
    large = found.filter("key IS NOT NULL").select("key", "rest", F.col("a").alias("id"), *scheme.words)
    if large.isEmpty():
        return edges
    sizes = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) * 3 / cap).cast("int").alias("blocks"))
    dealt = large.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    route = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    blocks = dealt.select(route.alias("route"), "rest", "id", *scheme.words)
    more = blocks.repartition("route").sortWithinPartitions("route").mapInArrow(_linker(scheme, 1 << 40), schema)
    return edges.unionByName(more.select("a", "b"))


def alike(sets: list[np.ndarray], x: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect what all pairs do that are within the radius and whose sets are as similar.

    ``sets`` has no empty ones, and no set has an element twice.  Breadth first:
    each position is compared with all those that none before it reached, so
    close copies cost little and every pair that could join two components is
    compared.
    """
    sizes = np.array([len(h) for h in sets], np.int64)
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(kinds), bool)
    left = np.arange(len(sets))
    a, b, queue = [], [], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        i = queue.pop()
        near = np.flatnonzero(np.bitwise_count(x[left] ^ x[i]).sum(1, dtype=np.int32) <= radius)
        n, least, most = sizes[left[near]], np.minimum(sizes[left[near]], sizes[i]), np.maximum(sizes[left[near]], sizes[i])
        near, n = near[least >= similarity * most], n[least >= similarity * most]
        if not len(near):
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        ends = np.cumsum(n)
        at = np.repeat(starts[left[near]] - (ends - n), n) + np.arange(ends[-1])
        common = np.add.reduceat(mark[flat[at]], ends - n, dtype=np.int64)
        mark[own] = False
        # An error of rounding mustn't lose a pair at the very limit.
        linked = near[common >= similarity * (n + sizes[i] - common) - 1e-9]
        found = left[linked]
        a += [i] * len(found)
        b += found.tolist()
        queue += found.tolist()
        left = np.delete(left, linked)
    return np.array(a, np.int64), np.array(b, np.int64)


def _sets(scheme: Scheme) -> Callable[[], Callable[..., list]]:
    def start() -> Callable[..., list]:
        def run(texts: pa.Array) -> list:
            sets, fps = [], []
            for t in byte_values(texts):
                h = np.unique(shingle_hashes(t or b"", scheme.shingle, scheme.seed))
                sets.append(h.tobytes())
                fps.append(majority(h, len(scheme.words)).tobytes() if len(h) else b"")
            return [pa.array(sets, pa.binary()), pa.array(fps, pa.binary())]

        return run

    return start


def similar_links(docs: DataFrame, candidates: DataFrame, scheme: Scheme) -> DataFrame:
    """Edges (a, b) that connect ids as all pairs of one candidate component do that are within the radius and as similar.

    ``docs`` has (id, text), ``candidates`` (node, component).  A component is
    compared in one task if it is small; the rows of a larger one are dealt to
    blocks, and each pair of blocks is a task, so that no pair is lost.  Blocks
    grow with the square root of the component, and shrink if its texts are long.
    """
    found = docs.join(candidates, F.col("id") == F.col("node")).select("id", "component", "text")
    found = add_columns(found, [F.col("text")], "hashes binary, fp binary", _sets(scheme)).select("id", "component", "hashes", "fp")
    found = materialized(found.filter(F.length("hashes") > 0), "sets")
    blocks = F.greatest(F.ceil(F.sqrt(F.count(F.lit(1))) / BLOCK_ROOT), F.ceil(F.sum(F.length("hashes")) / BLOCK_BYTES)).cast("int")
    blocks = F.when(F.count(F.lit(1)) <= GROUP_ROWS, F.ceil(F.sum(F.length("hashes")) / BLOCK_BYTES).cast("int")).otherwise(blocks)
    sizes = found.groupBy("component").agg(blocks.alias("blocks"))
    dealt = found.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    route = F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other"))
    rows = dealt.select(route.alias("route"), "id", "hashes", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in whole_groups(batches, "route", 1 << 62, target=GROUP_ROWS):
            route, ids = column(t, "route"), column(t, "id")
            hashes, fps = t.column("hashes").to_pylist(), t.column("fp").to_pylist()
            edges = np.r_[0, np.flatnonzero(route[1:] != route[:-1]) + 1, len(route)].tolist()
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                x = np.frombuffer(b"".join(fps[lo:hi]), np.uint64).reshape(hi - lo, -1)
                i, j = alike([np.frombuffer(h, np.uint64) for h in hashes[lo:hi]], x, scheme.radius, scheme.similarity)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo + i]), pa.array(ids[lo + j])], names=["a", "b"])

    return rows.repartition("route").sortWithinPartitions("route").mapInArrow(run, "a bigint, b bigint")


def _components(fps: DataFrame, scheme: Scheme, texts: DataFrame, cap: int) -> DataFrame:
    """``fps`` (id, the node's columns, ...) with ``component``, the smallest id that links reach."""
    nodes = fps.groupBy(*scheme.node).agg(F.min("id").alias("id"))
    labels = connected_components(links(nodes.filter("id IS NOT NULL"), scheme, cap))
    if scheme.similarity is not None:
        labels = connected_components(similar_links(texts, labels, scheme))
    named = nodes.join(labels, F.col("id") == F.col("node"), "left").select(*scheme.node, F.coalesce("component", "id").alias("component"))
    return fps.join(named, scheme.node, "left")


def groups(docs: DataFrame, key: str, text: str, scheme: Scheme, cap: int = KEY_ROWS) -> DataFrame:
    """(key, f0..., component): documents whose fingerprints link, directly or by others, share the smallest key.

    ``key`` must be integral.  Equal fingerprints are one node, so copies, however
    many, cost nothing; with a similarity, equal sets of shingles are one.  Rows
    with a null key get a component only from others.  No rows give no rows.
    """
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    fps = materialized(fingerprints(texts, "text", scheme).select("id", *scheme.node), "fingerprints")
    return _components(fps, scheme, texts, cap).select(F.col("id").alias(key), *scheme.words, "component")


def drop_near_copies(docs: DataFrame, key: str, text: str, scheme: Scheme = NEAR_COPIES) -> DataFrame:
    """One row of each group of near copies: the one with the smallest key, columns as they are.

    Segments are sized for the table.  Keys should be unique: where several rows
    have that key, one stays for each of their texts, of rows with the same text
    the one with the smallest hash of all its columns, and of rows that are equal
    throughout one.  Rows with a null key stay, and count as a copy of none.  Null
    and empty texts are copies of one another.
    """
    every = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() != "map"])
    marked = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), every.alias("row"))
    with passing(docs.sparkSession) as stay:
        fps = materialized(fingerprints(marked, "text", scheme).withColumn("body", F.xxhash64("text")).select("id", "row", "body", *scheme.node), "fingerprints")
        found = _components(fps, sized(scheme, fps.count()), marked.select("id", "text"), KEY_ROWS)
        kept = found.filter("id = component").groupBy("id", "body", "row").agg(F.count(F.lit(1)).alias("times")).groupBy("id", "body").agg(F.min(F.struct("row", "times")).alias("it"))
        kept = materialized(kept.select(F.col("id").alias("__id"), F.col("it.row").alias("__row"), F.col("it.times").alias("__times")), "kept")
        stay.append(kept)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumns({"__own": F.col(f"`{key}`").cast("bigint"), "__mark": every}).filter("__own IS NOT NULL")

    def of(some: DataFrame) -> DataFrame:
        return rows.join(some, (F.col("__own") == F.col("__id")) & (F.col("__mark") == F.col("__row")))

    out = of(kept.filter("__times = 1")).select(*columns).unionByName(docs.filter(F.col(f"`{key}`").cast("bigint").isNull()))
    # Only rows that are there several times are dealt once more, so that one of them stays.
    several = kept.filter("__times > 1")
    return out if several.isEmpty() else out.unionByName(of(several).dropDuplicates(["__id", "__row"]).select(*columns))
