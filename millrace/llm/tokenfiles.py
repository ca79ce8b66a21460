"""Token-id files with keyed access.

A folder has shards of raw ids, in ascending key order, and an index of minimal
perfect hash files that say where a key's documents are.

Shard: ``MRTK``, u32 bytes per id, then the ids of all documents, then u64
positions (in ids) where documents begin and the last ends, then a footer of
u64 documents, u64 ids and ``MRTE``.  Index part: the hash, then for each of its
numbers u32 fingerprint, u32 shard, u64 first document and u64 documents.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.arrow import column, rebatched, whole_groups
from millrace.llm.chunks import TextEncoder, slices
from millrace.llm.mph import MinimalPerfectHash
from millrace.llm.store import materialized

#: Keys of one index part, about.
PART_KEYS = 1 << 14
_HEAD, _FOOT = "<4sI", "<QQ4s"
_HEAD_SIZE, _FOOT_SIZE = struct.calcsize(_HEAD), struct.calcsize(_FOOT)
_ENTRY = np.dtype([("mark", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("n", "<u8")])


@dataclass(frozen=True)
class TokenFolder:
    """A written folder: its path, the shards' documents, ids and ids before them, and the index's parts."""

    path: str
    shards: DataFrame
    parts: int


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _commit(uri: str, write) -> None:
    """Write under another name, then rename: a retried or speculative task replaces a file by the same one."""
    files, path = _open(uri)
    tmp = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(tmp) as out:
        write(out)
    files.move(tmp, path)


def _hashes(keys: list[bytes], seed: int) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(k, seed) for k in keys], np.uint64)


def _marks(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh32_intdigest(k, 7) for k in keys], np.uint32)


#: Keys as text; null has a text that no number or encoded key has.
def _key_text(key: str):
    return F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\x00null"))


def write_folder(docs: DataFrame, key: str, text: str, tokenizer_file: str, path: str, end_id: int = 2, shards: int | None = None) -> TokenFolder:
    """Encode whole texts, append ``end_id`` to each, and write shards and index below ``path``.

    Documents are range-partitioned by key, a shard each, and sorted within (by
    text among equal keys), so ids lie in ascending key order over all shards;
    null keys come first, null texts count as empty, and equal keys stay
    separate documents of one index entry.  Texts are shuffled once; ids never.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), _key_text(key).alias("name"))
    source = source.repartitionByRange(n, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text").select("name", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder.of(tokenizer_file)
        shard = TaskContext.get().partitionId()
        names: list[pa.Array] = []
        sizes: list[np.ndarray] = []

        def put(out) -> None:
            out.write(struct.pack(_HEAD, b"MRTK", encoder.dtype.itemsize))
            for b in batches:
                names.append(b.column(0))
                for part in slices(b.column(1).cast(pa.binary())):
                    ids, at = encoder.encode(part)
                    sizes.append(np.diff(at) + 1)
                    out.write(np.insert(ids, at[1:], end_id).tobytes())
            ends = np.r_[0, np.cumsum(np.concatenate(sizes))] if sizes else np.zeros(1, np.int64)
            out.write(ends.astype("<u8").tobytes())
            out.write(struct.pack(_FOOT, len(ends) - 1, int(ends[-1]), b"MRTE"))

        _commit(f"{path}/shard-{shard:06d}.ids", put)
        done = 0
        for a in names:
            k = len(a)
            n_tokens = np.concatenate(sizes)[done : done + k] if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([a, pa.array(np.full(k, shard, np.int32)), pa.array(np.arange(done, done + k)), pa.array(n_tokens)], names=["name", "shard", "document", "n_tokens"])
            done += k

    _make(spark, path)
    entries = materialized(source.mapInArrow(write, "name string, shard int, document bigint, n_tokens bigint"), "entries")
    totals = entries.groupBy("shard").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialized(totals.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0))), "shards")
    documents = placed.agg(F.sum("documents")).first()[0] or 0
    parts = max(1, -(-documents // PART_KEYS))
    _write_index(entries, path, parts)
    return TokenFolder(path, placed, parts)


def _make(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def _part(parts: int):
    return F.pmod(F.xxhash64("name"), F.lit(parts)).cast("bigint")


def _write_index(entries: DataFrame, path: str, parts: int) -> None:
    keys = entries.groupBy("name").agg(F.min("shard").alias("shard"), F.min("document").alias("first"), F.count(F.lit(1)).alias("n"))
    keys = keys.withColumn("part", _part(parts)).repartition("part").sortWithinPartitions("part").select("part", "name", "shard", "first", "n")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in whole_groups(batches, "part", 1 << 62):
            part = column(t, "part")
            for p in np.unique(part).tolist():
                own = t.filter(pa.array(part == p))
                names = own.column("name").cast(pa.binary()).to_pylist()
                seed = 0
                while len(np.unique(h := _hashes(names, seed))) < len(names):
                    seed += 1
                mph = MinimalPerfectHash.build(h, seed)
                table = np.zeros(len(names), _ENTRY)
                at = mph.lookup(h)
                table["mark"][at] = _marks(names)
                for field in ("shard", "first", "n"):
                    table[field][at] = own.column(field).to_numpy()
                _commit(f"{path}/index-{p:06d}.mph", lambda out, m=mph, e=table: out.write(m.to_bytes() + e.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([len(names)], pa.int64())], names=["part", "keys"])

    materialized(keys.mapInArrow(build, "part bigint, keys bigint"), "index")


def find(folder: TokenFolder, keys: DataFrame, key: str) -> DataFrame:
    """Where the documents of each distinct key are: (key, name, shard, document).  Unknown keys give no rows."""
    path, parts = folder.path, folder.parts
    key_type = keys.schema[key].dataType.simpleString()
    asked = keys.select(F.col(f"`{key}`").alias("key"), _key_text(key).alias("name")).distinct().withColumn("part", _part(parts))
    asked = asked.repartition("part").sortWithinPartitions("part").select("part", "key", "name")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, mph, table = -1, None, None
        for t in rebatched(batches, 10_000):
            part = column(t, "part")
            edges = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if part[a] != loaded:
                    loaded = int(part[a])
                    files, base = _open(f"{path}/index-{loaded:06d}.mph")
                    from pyarrow import fs

                    if files.get_file_info(base).type == fs.FileType.NotFound:
                        mph = None
                        continue
                    with files.open_input_stream(base) as f:
                        data = f.read()
                    mph, end = MinimalPerfectHash.from_bytes(data)
                    table = np.frombuffer(data, _ENTRY, len(mph), end)
                if mph is None or not len(mph):
                    continue
                own = t.slice(a, b - a)
                names = own.column("name").cast(pa.binary()).to_pylist()
                at = mph.lookup(_hashes(names, mph.seed))
                entry = table[np.maximum(at, 0)]
                hit = np.flatnonzero((at >= 0) & (entry["mark"] == _marks(names)))
                n = entry["n"][hit].astype(np.int64)
                rows = np.repeat(hit, n)
                document = np.repeat(entry["first"][hit].astype(np.int64), n) + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                shard = np.repeat(entry["shard"][hit].astype(np.int32), n)
                yield pa.RecordBatch.from_arrays([own.column("key").take(pa.array(rows)).combine_chunks(), pa.array(shard), pa.array(document)], names=["key", "shard", "document"])

    return asked.mapInArrow(look, f"key {key_type}, shard int, document bigint")


def read_documents(folder: TokenFolder, keys: DataFrame, key: str) -> DataFrame:
    """(key, start, n_tokens, ids) of the documents of each distinct key, read from the files.

    ``start`` counts the ids of all documents before it; ``ids`` is binary,
    little-endian unsigned 32-bit.  Index parts and shards are each opened by
    the tasks that have their keys; neighbours in a shard are read together.
    """
    path = folder.path
    key_type = keys.schema[key].dataType.simpleString()
    places = find(folder, keys, key).join(folder.shards.select("shard", "before"), "shard")
    places = places.repartition("shard").sortWithinPartitions("shard", "document").select("key", "shard", "document", "before")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file, ends, width = -1, None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            shard, document, before = column(t, "shard"), column(t, "document"), column(t, "before")
            edges = np.r_[0, np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)]
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if shard[a] != opened:
                    opened = int(shard[a])
                    files, base = _open(f"{path}/shard-{opened:06d}.ids")
                    file = files.open_input_file(base)
                    size = file.size()
                    documents, total, magic = struct.unpack(_FOOT, file.read_at(_FOOT_SIZE, size - _FOOT_SIZE))
                    head, width = struct.unpack(_HEAD, file.read_at(_HEAD_SIZE, 0))
                    if head != b"MRTK" or magic != b"MRTE":
                        raise ValueError(f"{base} is no shard")
                    ends = np.frombuffer(file.read_at(8 * (documents + 1), _HEAD_SIZE + total * width), "<u8").astype(np.int64)
                for i in range(a, z, 2000):
                    k = min(z, i + 2000)
                    raw = []
                    starts, stops = ends[document[i:k]], ends[document[i:k] + 1]
                    dense = int(stops[-1] - starts[0]) <= 2 * int((stops - starts).sum()) + 65536
                    block = file.read_at(int(stops[-1] - starts[0]) * width, _HEAD_SIZE + int(starts[0]) * width) if dense else None
                    for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
                        x = block[(s - int(starts[0])) * width : (e - int(starts[0])) * width] if dense else file.read_at((e - s) * width, _HEAD_SIZE + s * width)
                        raw.append(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes())
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, k - i), pa.array(before[i:k] + starts), pa.array(stops - starts), pa.array(raw, pa.binary())], names=[key, "start", "n_tokens", "ids"])

    return places.mapInArrow(read, f"`{key}` {key_type}, start bigint, n_tokens bigint, ids binary")
