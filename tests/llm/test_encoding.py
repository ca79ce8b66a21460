import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from millrace.llm import bpe, tokenfiles
from millrace.llm.chunks import TextEncoder
from millrace.llm.mph import MinimalPerfectHash
from millrace.llm.packing import CapacityTree, best_fit_decreasing, cut_lengths, pack
from millrace.llm.store import fresh_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n", "a", "é", "a  b \n c\u00a0 d\u3000 e", "don't I'll\n\nx  ", "<|endoftext|> a", "abc <|endoftext|> def", "abc<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\n y", "glued<|endoftext|>words <|endoftext", "é <|endoftext|>\u00a0 <|endoftext|>", "<|endoftext|>", "日本語 テスト\u2003 x", "x" * 3000, " " * 3000, "ab1" * 2000 + " \n" * 50, "à la\u0085 é  \t z", "the cat sat on the mat. " * 400]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "k") for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens string").repartition(3)


def test_bpe_round_trip(odd):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decode(bpe.encode(odd, "text", RANKS, public_tokenizers.PATTERN, limit=100), "ids", RANKS)
    rows = out.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = ODD[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference.encode_ordinary(text) and r["n_tokens"] == len(r["ids"]) // 4
        assert bytes(r["decoded"]) == text.encode()
    assert bpe.encode(odd.limit(0), "text", RANKS, public_tokenizers.PATTERN).count() == 0


def test_safe_parts():
    assert list(bpe.safe_parts("aaaa bbbb cccc", 3)) == ["aaaa", " bbbb", " cccc"]
    assert list(bpe.safe_parts("x" * 50, 3)) == ["x" * 50] and list(bpe.safe_parts("", 3)) == [""]


def test_text_encoder(library):
    encoder = TextEncoder.of(FILE)
    r = random.Random(3)
    texts = ODD + ["".join(r.choice([" ", "\n", "a", "é", "B,", "\u00a0", "1", "'s"]) for _ in range(200)) for _ in range(50)]
    for _ in range(2):
        ids, at = encoder.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == library(t), repr(t)[:80]
    sliced = pa.array(texts).slice(3, 9)
    ids, at = encoder.encode(sliced)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(9)] == [library(t) for t in texts[3:12]]


def test_added_tokens_with_white_space(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(FILE)
    t.add_tokens([AddedToken("<a b>"), AddedToken("<r>", rstrip=True), AddedToken("<l>", lstrip=True), AddedToken("<é>")])
    t.save(str(tmp_path / "more.json"))
    texts = ["the <a b> cat", "x <r>   y", "x   <l> y z", "a <é> b <é>", "plain words here", None, ""]
    for some in (texts, texts[3:], texts[2:3]):
        ids, at = TextEncoder.of(str(tmp_path / "more.json")).encode(pa.array(some))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(some))] == [t.encode(x or "", add_special_tokens=False).ids for x in some]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        TextEncoder(public_tokenizers.path("word_bpe_49k.json"))


def test_minimal_perfect_hash():
    for n in (0, 1, 2, 1000, 30_000):
        h = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        m, size = MinimalPerfectHash.from_bytes(MinimalPerfectHash.build(h).to_bytes())
        assert sorted(m.lookup(h).tolist()) == list(range(len(h))) and len(m) == len(h)
    with pytest.raises(ValueError):
        MinimalPerfectHash.build(np.array([1, 1], np.uint64))


def test_token_files(spark, library):
    texts = ODD + ["word " * i for i in range(300)]
    rows = [(i * 7 - 50, t) for i, t in enumerate(texts)] + [(None, "null key"), (6, "same key"), (6, "same key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = tokenfiles.write_folder(df, "doc_id", "text", FILE, fresh_path(spark, "t"), shards=4)
    got = tokenfiles.read_documents(folder, df, "doc_id").collect()
    want, start = [], 0
    for key, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array([*library(text), 2], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in got), key=lambda x: x[1]) == want
    strange = spark.createDataFrame([(10**9,), (13,)], "doc_id long")
    assert [r["doc_id"] for r in tokenfiles.read_documents(folder, strange, "doc_id").collect()] == [13]
    empty = tokenfiles.write_folder(df.limit(0), "doc_id", "text", FILE, fresh_path(spark, "t"), shards=2)
    assert tokenfiles.read_documents(empty, df, "doc_id").count() == 0


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def test_best_fit_decreasing():
    r = random.Random(5)
    for _ in range(60):
        capacity = r.choice([7, 30, 100])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 200))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        used, seen = {}, {n: [] for n in histogram}
        for length, item, n, first, offset in best_fit_decreasing(histogram, capacity):
            for i in range(n):
                used.setdefault(first + i, []).append((offset, length))
                seen[length].append(item + i)
        assert all(sorted(v) == list(range(histogram[k])) for k, v in seen.items())
        for spans in used.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(used) == plain_best_fit(lengths, capacity)


def test_capacity_tree():
    t = CapacityTree(10)
    t.add(4, 2)
    t.add(9, 1)
    assert [t.tightest(x) for x in (1, 4, 5, 9, 10)] == [4, 4, 9, 9, None]
    t.add(4, -2)
    assert t.tightest(1) == 9
    assert cut_lengths(10, 4) == [2, 4, 4] and cut_lengths(8, 4) == [4, 4] and cut_lengths(3, 4) == [3]


def test_pack(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash")).repartition(4)
    out = pack(df, "doc_id", "text", FILE, capacity=64, with_ids=True).collect()
    by_bin, by_doc = {}, {}
    for r in out:
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for spans in by_bin.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_bin) == plain_best_fit([r["length"] for r in out], 64)
    for key, text in rows:
        if key != 3:
            ids = b"".join(bytes(r["ids"]) for r in sorted(by_doc[key], key=lambda r: r["piece"]))
            assert np.frombuffer(ids, "<u4").tolist() == [*library(text), 2]
            assert [r["start"] for r in sorted(by_doc[key], key=lambda r: r["piece"])][0] == 0
    assert pack(df.limit(0), "doc_id", "text", FILE).count() == 0


def test_digest_is_of_bytes(odd):
    row = bpe.encode(odd, "text", RANKS, public_tokenizers.PATTERN).filter("doc_id = 4").select(F.sha2("ids", 256)).first()[0]
    assert len(row) == len(hashlib.sha256().hexdigest())
