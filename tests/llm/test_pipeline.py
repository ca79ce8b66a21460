import collections
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import repeats


def test_stages(spark, tmp_path):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = prose(60)
    rows = [(i, prose(100), "en", "s", 0) for i in range(30)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, rows[1][1].upper(), "en", "s", 0), (102, "too short", "en", "s", 0), (103, "### " * 60, "en", "s", 0)]
    rows += [(200 + i, f"{prose(50)} {passage} {prose(50)}", "en", "s", 0) for i in range(3)]
    rows += [(None, prose(60), None, None, None), (300, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        steps.append({x["doc_id"]: x["text"] for x in docs.collect()})
    assert not {103, 300} & steps[0].keys() and steps[0][102] == "too short" and len(steps[0]) == len(rows) - 2
    assert not {100, 101} & steps[1].keys() and len(steps[1]) == len(steps[0]) - 2
    assert all(passage not in t for t in steps[2].values()) and steps[2][5] == rows[5][1] and len(steps[2]) == len(steps[1])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {x["doc_id"] for x in packed.collect()} == set(steps[2])


def plain_stages(rows):
    """The first three stages over (doc_id, text) rows, by sets and windows of every text."""
    sets, kept = {}, []
    for k, t in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {i + j for i in range(len(words) - 7) for j in range(8) if windows[tuple(words[i : i + 8])] > 1}
        lines = [x for x in (t or "").split("\n") if x.split()]
        chars = sum(map(len, words))
        junk = [not words, 100 * len(inside) > 30 * len(words), 5 * sum(c in "#*$%&|<>" for c in t or "") > len(words), 10 * (len(lines) - len(set(lines))) > 5 * len((t or "").split("\n")), not 2 * len(words) <= chars <= 20 * len(words)]
        if not any(junk):
            kept.append((k, t))
            lower = [w.lower() for w in words]
            sets[k] = {tuple(lower[i : i + 5]) for i in range(max(1, len(lower) - 4))}
    group = {k: k for k, _ in kept}
    for i, (a, _) in enumerate(kept):
        for b, _ in kept[:i]:
            if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    left = [(k, t) for k, t in kept if group[k] == k]
    seen = collections.Counter(t.encode()[i : i + 200] for _, t in left for i in range(len(t.encode()) - 199))
    out = {}
    for k, t in left:
        raw, gone = t.encode(), set()
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                gone.update(range(i, i + 200))
        out[k] = bytes(b for i, b in enumerate(raw) if i not in gone).decode()
    return {k for k, _ in kept}, {k for k, _ in left}, out


def test_stages_equal_a_plain_version(spark):
    """Plain letters only, so that no cut falls into a character; near copies are well above or below the limit."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(500)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [prose(50) for _ in range(3)]
    rows = [(i, " ".join([prose(r.randint(1, 60)), *r.sample(passages, r.randint(0, 2)), prose(r.randint(5, 60))])) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    for i in range(6, 14):
        w = rows[i][1].split(" ")
        w[len(w) // 2] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, "x " * 60), (301, "### a " * 30), (302, "a line\n" * 9), (303, " \n"), (304, None), (305, "short"), (306, "short"), (307, "w" * 900), (308, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).repartition(5)
    want = plain_stages(rows)
    for (_, stage), expected in zip(corpus_pipeline.STAGES, want, strict=False):
        docs = stage(spark, docs, "")
        assert {x["doc_id"] for x in docs.collect()} == set(expected)
    assert {x["doc_id"]: x["text"] for x in docs.collect()} == want[2]


def test_empty_table_and_long_texts(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    long = " ".join(r.choice(words) for _ in range(150_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "kept as it is")], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").count() == 0, name
        docs = stage(spark, docs, "")
    assert {x["doc_id"]: x["text"] for x in docs.collect()} == {1: long, 3: "kept as it is"}
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs.limit(0), "").count() == 0 and last(spark, docs, "").count() > 100


def test_cuts_leave_other_characters(spark):
    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = prose(50)
    # "é" and "è" share a first byte, "é" and "ĩ" a last one, so the common string begins and ends within them.
    texts = [f"{prose(9)} \ufffd kept é{passage}é end \ufffd.", f"{prose(9)} ĩ{passage}è other"]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {x["doc_id"]: (x["text"], x["n_chars"]) for x in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    want = [texts[0].replace(f"é{passage}é", ""), texts[1].replace(f"ĩ{passage}è", "")]
    assert got == {i: (t, len(t)) for i, t in enumerate(want)}


def test_whole_characters():
    value = "aé€😀b".encode()
    assert repeats._whole_characters(value, [(2, 4)]) == [(1, 6)]
    assert repeats._whole_characters(value, [(0, 2), (7, 8)]) == [(0, 3), (6, 10)]
    assert repeats._whole_characters(value, [(1, 2), (5, 6)]) == [(1, 6)]
    assert repeats._whole_characters(value, [(0, 1), (10, 11)]) == [(0, 1), (10, 11)]
    assert repeats._whole_characters(b"a\x80\x80b", [(2, 3)]) == [(2, 3)]
