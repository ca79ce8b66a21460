"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.arrow import column
from millrace.llm.chunks import TextEncoder, slices
from millrace.llm.store import materialized


class CapacityTree:
    """Counts of open bins by remaining capacity, in a segment tree: the tightest fit is found in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << max(0, capacity).bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        i = remaining + self.size
        while i:
            self.tree[i] += bins
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that an open bin has."""
        i = least + self.size
        if self.tree[i]:
            return least
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pack ``histogram[length]`` items of each length into bins.

    Items go by falling length, each to the open bin with the least room that
    takes it.  Items of one length and bins of one remaining capacity are alike,
    so they are placed by runs: the work depends on the number of lengths, not
    of items.  Returns (length, first item, items, first bin, offset) runs: item
    ``first + i`` of that length goes to bin ``first bin + i``.
    """
    tree = CapacityTree(capacity)
    spans: dict[int, list[list[int]]] = {}
    placed: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(remaining: int, first: int, n: int) -> None:
        held = spans.setdefault(remaining, [])
        if held and held[-1][0] + held[-1][1] == first:
            held[-1][1] += n
        else:
            held.append([first, n])
        tree.add(remaining, n)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"no bin takes {length}")
        left, item = histogram[length], 0
        while left:
            room = tree.tightest(length)
            per = (capacity if room is None else room) // length
            if room is None:
                room, first, n = capacity, opened, -(-left // per)
                opened += n
            else:
                first, n = spans[room].pop()
                tree.add(room, -n)
            # The bin that has just got an item is the tightest as long as it takes another: bins fill one by one.
            full = min(n, left // per)
            part = left - full * per if full < n else 0
            for k in range(per):
                if full:
                    placed.append((length, item, full, first, capacity - room + k * length))
                    item += full
                if k < part:
                    placed.append((length, item, 1, first + full, capacity - room + k * length))
                    item += 1
            left -= full * per + part
            used = full + (part > 0)
            if full and room - per * length:
                put(room - per * length, first, full)
            if part and room - part * length:
                put(room - part * length, first + full, 1)
            if n > used:
                put(room, first + used, n - used)
    return placed


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Piece lengths of ``n`` tokens: one piece if they fit, else full pieces after a first that may be shorter."""
    first = n % capacity or capacity
    return [first] + [capacity] * ((n - first) // capacity) if n else []


def pieces(docs: DataFrame, key: str, text: str, tokenizer_file: str, end_id: int, capacity: int, with_ids: bool) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of at most ``capacity``; ranks number a task's pieces of a length."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    source = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    key_type = source.schema["key"].dataType.simpleString()
    schema = f"key {key_type}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder.of(tokenizer_file)
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for b in batches:
            texts, done = b.column(1).cast(pa.binary()), 0
            for part in slices(texts):
                ids, at = encoder.encode(part)
                of, piece, start, length, crc, rank, raw = [], [], [], [], [], [], []
                for d in range(len(part)):
                    own = np.append(ids[at[d] : at[d + 1]].astype("<u4"), np.uint32(end_id))
                    begin = 0
                    for k, n in enumerate(cut_lengths(len(own), capacity)):
                        data = own[begin : begin + n].tobytes()
                        of.append(done + d)
                        piece.append(k)
                        start.append(begin)
                        length.append(n)
                        crc.append(zlib.crc32(data))
                        rank.append(seen[n])
                        seen[n] += 1
                        begin += n
                        if with_ids:
                            raw.append(data)
                done += len(part)
                cols = [b.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(of), pa.int32()), pa.array(rank, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(raw, pa.binary())] if with_ids else []), names=[f.split()[0] for f in schema.split(", ")])

    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, key: str, text: str, tokenizer_file: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into as few sequences of ``capacity`` tokens as best-fit decreasing needs.

    Each document is its ids (``tokenizers`` file, no special tokens) and
    ``end_id``; null texts count as empty, so every row has one piece at least,
    and equal keys are separate documents.  Only documents longer than a
    sequence are cut.  Returns a row per piece: the key, piece, start, length,
    ids_crc32, sequence_id, offset, and the ids with ``with_ids``.  No rows give
    no pieces.

    The packing depends on lengths only.  The driver gets their histogram (at
    most ``capacity`` rows), packs it by runs, and sends the runs back; pieces
    find their place by their rank among those of their length, which comes from
    their task's own count and the counts of the tasks before it.  No document
    and no length, however common, is gathered in one place.
    """
    made = materialized(pieces(docs, key, text, tokenizer_file, end_id, capacity, with_ids), "pieces")
    counts = made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = sorted(best_fit_decreasing(histogram, capacity))
    shared = docs.sparkSession.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = made.join(bases, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "task")
    order = ["key", "piece", "start", "length", "ids_crc32", "rank", *(["ids"] if with_ids else [])]
    key_type = made.schema["key"].dataType.simpleString()
    schema = f"`{key}` {key_type}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + (", ids binary" if with_ids else "")
    names = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        most = int(table[:, 2].sum()) + 1 if len(table) else 1
        keys = table[:, 0] * most + table[:, 1]
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                rank = column(t, "rank")
                run = table[np.searchsorted(keys, column(t, "length") * most + rank, "right") - 1]
                cols = [*b.columns[:5], pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4]), *b.columns[6:]]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return ranked.select(*order).mapInArrow(place, schema)
