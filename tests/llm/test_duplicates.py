import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import caps, repeats, simhash
from millrace.llm.components import connected_components
from millrace.llm.queries import FINGERPRINTS

R = random.Random(11)
VOCABULARY = ["".join(R.choice("abcdefgh") for _ in range(R.randint(1, 7))) for _ in range(300)]


def prose(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


def smallest(n, pairs, names):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in pairs:
        label[root(i)] = root(j)
    best = {}
    for i in range(n):
        best[root(i)] = min(best.get(root(i), 10**18), names[i])
    return [best[root(i)] for i in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (300, 100), (7, 7), (500, 1000)] + [(2000, i) for i in range(2001, 2100)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    nodes = sorted({x for e in edges for x in e})
    want = dict(zip(nodes, smallest(len(nodes), [(nodes.index(a), nodes.index(b)) for a, b in edges], nodes), strict=True))
    assert got == want
    assert connected_components(df.limit(0)).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.fixture(scope="module")
def copies(spark):
    texts = [None, "", " \t\n", "One", "one", "A b", prose(300), "\u00a0x\u2003y z w"]
    base = [prose(R.randint(3, 400)) for _ in range(60)]
    for t in base:
        words = t.split(" ")
        for _ in range(R.randint(0, 4)):
            w = list(words)
            for _ in range(R.randint(0, 2)):
                w[R.randrange(len(w))] = R.choice(VOCABULARY)
            texts.append(" ".join(w))
    hot = prose(120).split(" ")
    for i in range(80):
        w = list(hot)
        w[i] = "changed"
        texts.append(" ".join(w))
    texts += base + base[:10]
    rows = [(5 * i + 3, t) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumn("f0", F.lit("clash")).repartition(5)


@pytest.mark.parametrize("cap", [20_000, 10])
def test_fingerprint_groups(copies, cap):
    rows, df = copies
    fps = [plain_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = dict(zip([k for k, _ in rows], zip(fps, smallest(len(rows), pairs, [k for k, _ in rows]), strict=True), strict=True))
    got = {r["doc_id"]: (r["f0"] % 2**64, r["component"]) for r in simhash.groups(df, "doc_id", "text", FINGERPRINTS, cap).collect()}
    assert got == want


def test_fingerprint_edges(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (9, "a b c d"), (9, "a b c d"), (4, "zz yy xx")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component"]) for r in simhash.groups(df, "doc_id", "text", FINGERPRINTS).collect()), key=repr)
    assert got == [(4, 4), (9, 9), (9, 9), (None, 9), (None, 9)]
    assert simhash.groups(df.limit(0), "doc_id", "text", FINGERPRINTS).count() == 0


def test_near_copies_go(spark):
    rows, originals = [], 150
    for k in range(originals):
        words = prose(250).split(" ")
        rows.append((k, " ".join(words)))
        w = list(words)
        for i in R.sample(range(250), 4):
            w[i] = R.choice(VOCABULARY)
        rows.append((1000 + k, " ".join(w).upper()))
        rows.append((2000 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    kept = [r["doc_id"] for r in simhash.drop_near_copies(df, "doc_id", "text").collect()]
    assert set(range(originals)) <= set(kept) and not [k for k in kept if k >= 2000]
    assert len([k for k in kept if 1000 <= k < 2000]) <= 0.05 * originals


def test_one_row_of_each_group_stays(spark):
    a, b = prose(80), prose(80)
    rows = [(5, a, "x"), (5, a, "x"), (5, a, "y"), (7, a, "x"), (5, b, "z"), (9, b, "z"), (9, b, "z"), (None, a, "n"), (None, a, "n"), (11, None, "e"), (12, "", "e")]
    df = spark.createDataFrame(rows, "doc_id int, text string, times string").repartition(4)
    got = [tuple(r) for r in simhash.drop_near_copies(df, "doc_id", "text").collect()]
    again = [tuple(r) for r in simhash.drop_near_copies(df.repartition(2), "doc_id", "text").collect()]
    assert sorted(got, key=repr) == sorted(again, key=repr)
    assert sorted(((k, t) for k, t, _ in got), key=repr) == sorted([(5, a), (5, b), (None, a), (None, a), (11, None)], key=repr)
    assert simhash.drop_near_copies(df.limit(0), "doc_id", "text").columns == df.columns


def test_meetings_stay_bounded_and_recall_high():
    for texts in (10, 1 << 14, 10**5, 3 * 10**5, 10**6, 10**9, 10**11):
        assert simhash.chance_meetings(simhash.sized(simhash.NEAR_COPIES, texts), texts) <= simhash.MEETINGS
    r = np.random.default_rng(5)
    pairs = []
    for _ in range(400):
        common = r.integers(0, 2**63, 267, dtype=np.uint64)
        pairs.append([simhash.majority(np.r_[common, r.integers(0, 2**63, 33, dtype=np.uint64)], 4) for _ in range(2)])
    differ = np.unpackbits(np.array([x ^ y for x, y in pairs]).view(np.uint8).reshape(400, -1), axis=1, bitorder="little")
    for texts in (1000, 10**6, 10**8):
        scheme = simhash.sized(simhash.NEAR_COPIES, texts)
        found = np.stack([differ[:, p].sum(1) <= 1 for p in scheme.places()], 1).any(1) & (differ.sum(1) <= scheme.radius)
        # 267 of 333 hashes are common: a similarity of 0.802.
        assert found.mean() >= 0.9, texts


def test_ball_pairs():
    at = np.sort(np.random.default_rng(2).integers(0, 64, 300).astype(np.uint64)) | np.uint64(1 << 40)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if int(at[i] ^ at[j]).bit_count() <= 1}
    got = [p for i, j in simhash.ball_pairs(at, 6, block=100) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert {(min(p), max(p)) for p in got} == want and len(got) == len(want)
    assert list(simhash.ball_pairs(at[:0], 6)) == []


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("rows_in_task", [200, 20])
def test_pages_of_one_template_stay(spark, monkeypatch, rows_in_task):
    monkeypatch.setattr(simhash, "GROUP_ROWS", rows_in_task)
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    template = [r.choice(words) for _ in range(250)]
    pages = [" ".join([*template, *[r.choice(words) for _ in range(54)]]) for _ in range(120)]
    # Copies with their last 20 words anew are about 0.87 alike.
    edited = [" ".join([*p.split(" ")[:-20], *[r.choice(words) for _ in range(20)]]) for p in pages[:60]]
    sets = [shingle_set(p) for p in pages]
    assert max(len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]) < 0.8
    assert all(len(a & b) / len(a | b) > 0.8 for a, b in zip(sets, map(shingle_set, edited), strict=False))
    df = spark.createDataFrame(list(enumerate(pages + edited)), "doc_id long, text string").repartition(4)
    kept = {x["doc_id"] for x in simhash.drop_near_copies(df, "doc_id", "text").collect()}
    assert set(range(120)) <= kept and len(kept) <= 122


@pytest.mark.parametrize("radius", [512, 60])
def test_alike(radius):
    r = np.random.default_rng(3)
    sets, base = [], r.integers(0, 1 << 63, 100, dtype=np.uint64)
    for k in range(60):
        n = int(r.integers(20, 120))
        h = np.r_[base[: max(1, n - k % 7)], r.integers(0, 1 << 63, k % 7, dtype=np.uint64)]
        sets.append(np.unique(h))
    x = np.stack([simhash.majority(h, 8) for h in sets])
    plain = [set(h.tolist()) for h in sets]
    pairs = [(i, j) for i in range(60) for j in range(i) if len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j]) and int(np.bitwise_count(x[i] ^ x[j]).sum()) <= radius]
    a, b = simhash.alike(sets, x, radius, 0.8)
    names = list(range(60))
    assert smallest(60, list(zip(a.tolist(), b.tolist(), strict=True)), names) == smallest(60, pairs, names)
    assert set(zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist(), strict=True)) <= set(pairs)


def plain_removed(texts, length):
    at = {}
    raw = [(t or "").encode() for t in texts]
    for d, x in enumerate(raw):
        for i in range(len(x) - length + 1):
            at.setdefault(x[i : i + length], []).append((d, i))
    flags = [bytearray(len(x)) for x in raw]
    for places in at.values():
        if len(places) > 1:
            for d, i in places:
                flags[d][i : i + length] = b"\1" * length
    return raw, flags


@pytest.fixture(scope="module")
def passages():
    shared = [prose(n) for n in (12, 20, 30, 60)]
    texts = [None, "", "x" * 500, "ab" * 300, "Are. " * 120, "é" * 90, prose(5)]
    for _ in range(60):
        parts = [prose(R.randint(0, 40))]
        for _ in range(R.randint(0, 3)):
            parts += [R.choice(shared), prose(R.randint(0, 15))]
        texts.append(" ".join(parts))
    long = prose(400)
    texts += [long, long[:500] + "Z" + long[501:], long[3:], texts[20], texts[21], texts[21], "x" * 450 + prose(20), prose(30) + "ab" * 200]
    return texts


@pytest.mark.parametrize("length,most", [(64, 4000), (100, 1), (400, 4000), (400, 2)])
def test_repeats_removed(spark, passages, length, most):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(passages)], "doc_id long, text string, kept string").repartition(6)
    raw, flags = plain_removed(passages, length)
    for r in repeats.remove_repeats(df, "text", length, most).collect():
        x, f = raw[r["doc_id"]], flags[r["doc_id"]]
        want = bytes(b for b, gone in zip(x, f, strict=True) if not gone)
        assert bytes(r["kept"]) == want, r["doc_id"]
        assert [(s["start"], s["end"]) for s in r["removed"]] == [tuple(s) for s in repeats.spans_of(np.frombuffer(bytes(f), np.uint8)).tolist()]
    assert repeats.remove_repeats(df.limit(0), "text", length, most).count() == 0


def test_run_length_index():
    texts = [b"banana", b"ananas", b"banana bandana", b"", b"x"]
    index = repeats.RunLengthIndex(texts)
    joined = [(t, i) for t in range(len(texts)) for i in range(len(texts[t]) + 1)]
    suffix = sorted(range(len(joined)), key=lambda p: (tuple(x + 10 for x in texts[joined[p][0]][joined[p][1] :]) + (joined[p][0],)))
    statistics = index.matching_statistics()
    for before, p in zip(suffix, suffix[1:], strict=False):
        a, b = texts[joined[before][0]][joined[before][1] :], texts[joined[p][0]][joined[p][1] :]
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert statistics[p] == n
    assert index.runs < index.size


def test_samples_mark_what_streamed_statistics_mark():
    base = prose(60).encode()
    texts = [base, base[20:90] + b"#" + base[:70], b"ab" * 60, base[5:80], b"", b"x" * 90]
    index = repeats.RunLengthIndex(texts)
    statistics = index.matching_statistics()
    at = np.searchsorted(index.position, np.arange(index.size), "right") - 1
    want = np.zeros(index.size, bool)
    for p in np.flatnonzero(statistics >= 32).tolist():
        other = index.before[at[p]] + p - index.position[at[p]]
        for start in (p, other):
            want[start : start + statistics[p]] = True
    assert want.any() and np.array_equal(index.repeated(32), want)


def plain_links(vectors, labels, cosine):
    n = len(vectors)
    unit = []
    for v in vectors:
        x = np.array([np.nan if c is None else c for c in v], float) if v is not None and len(v) else None
        ok = x is not None and np.isfinite(x).all() and np.abs(x).max() > 0
        unit.append(x / np.linalg.norm(x) if ok else None)
    return [(i, j) for i in range(n) for j in range(i) if labels[i] is not None and labels[i] == labels[j] and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine]


@pytest.mark.parametrize("dim,cap", [(64, 4000), (64, 30), (8, 4000), (2, 4000), (1, 4000)])
def test_near_vectors(spark, dim, cap):
    r = np.random.default_rng(dim)
    vectors, labels = [], []
    for k in range(120):
        x = r.standard_normal(dim)
        for _ in range(int(r.integers(1, 4))):
            vectors.append([float(c) for c in np.float32(x + 0.12 * r.standard_normal(dim))])
            labels.append(int(k % 3))
    for _ in range(80):
        vectors.append([float(c) for c in np.float32(np.ones(dim) + 0.05 * r.standard_normal(dim))])
        labels.append(1)
    vectors += [vectors[0], vectors[0], None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] * dim, vectors[0] + [1.0], vectors[1]]
    labels += [labels[0], labels[0], 0, 0, 0, 0, 0, 0, labels[0], None]
    rows = [(3 * i + 1, v, y) for i, (v, y) in enumerate(zip(vectors, labels, strict=True))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit(1)).repartition(4)
    got = {g["vec_id"]: g for g in caps.near_vectors(df, "vec_id", "embedding", "label", 0.98, cap=cap).collect()}
    pairs = plain_links(vectors, labels, 0.98)
    links = [0] * len(rows)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    assert len(got) == len(rows)
    found = sum(g["n_links"] for g in got.values())
    assert found >= 0.98 * sum(links) and all(got[k]["n_links"] <= n for (k, _, _), n in zip(rows, links, strict=True))
    if found == sum(links):
        assert [got[k]["component_id"] for k, _, _ in rows] == smallest(len(rows), pairs, [k for k, _, _ in rows])
    assert all(g["kept"] == (g["vec_id"] == g["component_id"]) for g in got.values())
    assert caps.near_vectors(df.limit(0), "vec_id", "embedding", "label").count() == 0


@pytest.mark.parametrize("cap", [4000, 40])
def test_many_near_vectors(spark, cap):
    """12,000 vectors of 64 dimensions; a third lie at 0.98 to 1.0 of another, 300 round one point, most labels are one."""
    r = np.random.default_rng(9)
    n, dim = 12_000, 64
    x = r.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at, of = r.permutation(n)[:4000], r.integers(0, n, 4000)
    c = r.uniform(0.98, 1.0, 4000)[:, None]
    aside = r.standard_normal((4000, dim))
    aside -= (aside * x[of]).sum(1, keepdims=True) * x[of]
    x[at] = c * x[of] + np.sqrt(1 - c * c) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    x[:300] = x[0] + 0.012 * r.standard_normal((300, dim))
    x = np.float32(x * r.uniform(0.1, 9, (n, 1)))
    label = np.where(r.random(n) < 0.7, 0, r.integers(1, 5, n))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int").repartition(8)
    got = {g["vec_id"]: g["n_links"] for g in caps.near_vectors(df, "vec_id", "embedding", "label", 0.98, cap=cap).collect()}
    links = near.sum(1)
    single = np.arange(n) >= 300
    found = np.array([got[i] for i in range(n)])
    recall = found[single].sum() / links[single].sum()
    print("recall", recall, "of", links[single].sum() // 2, "pairs; in the large group", found[~single].sum() / links[~single].sum())
    assert (found <= links).all() and recall >= 0.97 and found[~single].sum() >= 0.97 * links[~single].sum()


def test_directions_follow_the_vectors():
    assert caps.directions_for(0) == caps.FEWEST and caps.directions_for(1 << 22) == 1 << 18 and caps.directions_for((1 << 22) + 1) == 1 << 19
    assert caps.directions_for(1 << 60) == caps.MOST


def test_digest(spark):
    df = spark.createDataFrame([(1, "a" * 10)], "doc_id long, text string")
    assert repeats.remove_repeats(df, "text", 400).select(F.sha2("kept", 256)).first()[0] == hashlib.sha256(b"a" * 10).hexdigest()
