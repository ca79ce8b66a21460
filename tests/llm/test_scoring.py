import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from millrace.llm import cascade, hosts, lattice, licences
from millrace.llm import queries as Q
from tests.compare import DATA, oracle_rows, spark_rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    names, rows = spark_rows(Q.queries()[name](spark, DATA))
    want_names, want = oracle_rows(Q.oracle_sql()[name])
    assert names == want_names
    assert rows == want


def plain_marginal(word, weights):
    text = b" " + word
    p = [1.0] + [0.0] * len(text)
    for e in range(1, len(text) + 1):
        p[e] = sum(p[s] * weights[text[s:e]] for s in range(max(0, e - 60), e) if text[s:e] in weights)
    return p[-1]


def test_lattice_is_a_distribution_over_segmentations():
    pieces, scores = lattice.piece_bytes(MODEL)
    table = lattice.PieceTable(pieces)
    weights = np.log(np.full(len(pieces), 1.0 / len(pieces)))
    words = [b"the", b"cat", "é".encode(), b"\xff\xfe", b"internationalisation", b"a" * 47, b"ab" * 40, b"z"]
    got, counts = lattice.lattice(table, words, weights, np.ones(len(words)))
    plain = {p: 1.0 / len(pieces) for p in pieces}
    assert np.allclose(got, [math.log(plain_marginal(w, plain)) for w in words])
    assert np.isclose(sum(n * len(p) for n, p in zip(counts, pieces, strict=True)), sum(len(w) + 1 for w in words))


def plain_model(texts, rounds):
    """Log10 scores of all texts by a model of the training ones, (text, held out) pairs, with plain dictionaries."""
    pieces, scores = lattice.piece_bytes(MODEL)
    rank = {p: i for i, p in enumerate(pieces[k] for k in np.argsort(-scores, kind="stable"))}
    weights = {p: 1.0 / (r + 10.0) for p, r in rank.items()}
    train = [w for t, held in texts if not held for w in (t or "").encode().lower().split()]
    ends = sum(not held for _, held in texts)

    def scaled(counts, end):
        total = sum(counts.values())
        return {p: c / total * (1 - end) for p, c in counts.items()}

    end = (ends + 1.0) / (ends + 1.0 + len(train) * 3.0 + 1.0)
    weights = scaled(weights, end)
    reached = -math.inf
    for _ in range(rounds if train else 0):
        counts = dict.fromkeys(pieces, lattice.PRIOR)
        before, reached = reached, 0.0
        for w in train:
            s = b" " + w
            ahead, behind = [1.0] + [0.0] * len(s), [0.0] * len(s) + [1.0]
            cuts = [(a, b) for b in range(1, len(s) + 1) for a in range(b) if s[a:b] in weights]
            for a, b in cuts:
                ahead[b] += ahead[a] * weights[s[a:b]]
            for a, b in sorted(cuts, reverse=True):
                behind[a] += weights[s[a:b]] * behind[b]
            for a, b in cuts:
                counts[s[a:b]] += ahead[a] * weights[s[a:b]] * behind[b] / ahead[-1]
            reached += math.log(ahead[-1]) / len(train)
        end = (ends + 1.0) / (ends + 1.0 + sum(counts.values()))
        weights = scaled(counts, end)
        if reached - before < lattice.MOVED:
            break
    words = lambda t: (t or "").encode().lower().split()
    return [sum(math.log10(plain_marginal(w, weights)) for w in words(t)) + math.log10(end) for t, _ in texts]


@pytest.mark.parametrize("rounds", [4, 40])
def test_scores_equal_a_plain_model(spark, rounds):
    texts = ["the cat sat on the mat", "The mat, the hat; a bat", None, "catalogue of hats", "internationalisation été", "unseen zebra words", "the the the"]
    held = [False, False, False, False, False, True, True]
    df = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, h boolean").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lattice.score(df, "text", F.col("h"), MODEL, rounds=rounds).collect()}
    want = plain_model(list(zip(texts, held, strict=True)), rounds)
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-9)


def test_scores(spark):
    texts = [None, "", "The cat sat", "the CAT sat on the mat\u00a0x", "zebra " * 3, "été Été", "a" * 5000] + [f"common words here {i % 7}" for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the"), (2, "The cat sat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    out = {}
    for frequent in (100_000, 3):
        got = lattice.score(df, "text", held, MODEL, frequent=frequent).collect()
        assert len(got) == len(rows)
        out[frequent] = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 8), round(r["score"], 8)) for r in got), key=repr)
    assert out[100_000] == out[3]
    counts, n, ends = {}, 0, 0
    for k, t in rows:
        if k is None or zlib.crc32(str(k).encode()) % 7 != 2:
            for w in (t or "").encode().lower().split():
                counts[w] = counts.get(w, 0) + 1
                n += 1
            ends += 1
    total, kinds = n + ends, len(counts) + 1
    want = []
    for k, t in rows:
        words = (t or "").encode().lower().split()
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + kinds + 1)) for w in words) + math.log10((ends + 1) / (total + kinds + 1))
        want.append((k, len(words) + 1, sum(w in counts for w in words) + 1, round(base, 8)))
    assert [x[:4] for x in out[3]] == sorted(want, key=repr)
    assert all(r["train_tokens"] == total for r in got) and all(r["score"] < 0 for r in got)
    assert lattice.score(df.limit(0), "text", held, MODEL).count() == 0


def test_licence_rules(spark):
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.'
    rows = [(1, None), (2, ""), (3, "Text.\nReleased under the MIT License."), (4, "All rights reserved."), (5, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License. Released under the MIT license!"), (6, apache), (7, "the licensed software rights")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licences", F.lit(0))
    got = {r["doc_id"]: (r["licences"], r["n_unmatched"]) for r in licences.scan(df, "text").collect()}
    assert got == {1: ("", 0), 2: ("", 0), 3: ("MIT", 0), 4: ("", 1), 5: ("MIT,CC-BY-NC-4.0", 0), 6: ("Apache-2.0", 0), 7: ("", 0)}
    assert all(__import__("re").search(licences.TRIGGER, s) or "cc by" in s for s in licences.SENTENCES)
    assert {i for _, ids in licences.RULES for i in ids} <= set(licences.SENTENCES.values())
    assert licences.scan(df.limit(0), "text").count() == 0


BSD_2 = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
GPL = "This program is free software{} you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation{} either version {} of the License, or\n(at your option) any later version.\n"
HEADERS = [
    ("GPL-3.0-or-later", GPL.format(":", ",", 3)),
    ("GPL-3.0-or-later", GPL.format(":", ";", 3)),
    ("GPL-2.0-or-later", GPL.format(";", ";", 2)),
    ("GPL-2.0-or-later", GPL.format(";", ",", 2)),
    ("GPL-2.0-only", "This work is licensed under the\nGnu General Public License version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the\nApache License, Version 2.0."),
    ("Apache-2.0", "A title\nLicensed under the Apache License, Version 2.0"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of\nthis software and associated documentation files (the \"Software\"), to deal in the\nSoftware without restriction, including without limitation the rights to use,\ncopy, modify, merge, publish, distribute, sublicense, and/or sell copies of the\nSoftware, and to permit persons to whom the Software is furnished to do so,\nsubject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."),
    ("MIT", "Released under the\nMIT License."),
    ("BSD-2-Clause", BSD_2),
    ("BSD-3-Clause", BSD_2 + "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a\nCreative Commons Attribution 4.0 International License."),
    *[(f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k in ("BY", "BY-SA", "BY-NC", "BY-NC-SA")],
]


def test_standard_headers(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(HEADERS)], "doc_id long, text string")
    got = {r["doc_id"]: (r["licences"], r["n_unmatched"]) for r in licences.scan(df, "text").collect()}
    assert got == {i: (name, 0) for i, (name, _) in enumerate(HEADERS)}
    assert {name for name, _ in HEADERS} == {name for name, _ in licences.RULES}


def test_hosts(spark):
    pages = [(i, f"https://bad.spam.co.uk/en/{i}", 1, 1) for i in range(60)] + [(100 + i, f"http://Good{i % 3}.fine.org:80/x?y#z", 1, 0) for i in range(60)] + [(200, None, None, None), (201, "nothing", 0, 0), (202, "ftp://new.spam.co.uk", 0, 0), (203, "http://www.example.com/en/a", 0, 0), (204, "http://a.example.com/en/a", 0, 0), (205, "x://b.net/es/1", 0, 0), (206, "x://b.com?/en/", 1, 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, labelled int, bad int").withColumn("host", F.lit(3))
    got = {r["page_id"]: r for r in hosts.judge(df, "url", "labelled", "bad").collect()}
    assert len(got) == len(pages)
    assert got[0]["verdict"] == "block" and got[100]["verdict"] == "allow" and got[100]["host"] == "good0.fine.org:80" and got[100]["path"] == "/x"
    assert (got[200]["host"], got[200]["path"], got[200]["rule"]) == ("", "", None) and got[201]["host"] == ""
    assert [(got[k]["rule"], got[k]["verdict"]) for k in (203, 204, 205)] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("net/es/", "block")]
    assert got[206]["rule"] is None and got[206]["path"] == ""
    parts = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "b.co.uk", "a.b.com", "com", "", "x.y.z.org:8")], "h string").select(*hosts.domain_parts(F.col("h"))).collect()
    assert [tuple(p) for p in parts] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("b.com", "com"), ("com", "com"), ("", ""), ("z.org", "org")]
    assert hosts.judge(df.limit(0), "url", "labelled", "bad").count() == 0


def test_threshold_follows_the_labels(spark):
    """Both verdicts come from the labels where hosts differ, none is blocked where they don't, whatever the overall rate."""
    for good, bad in ((0.05, 0.6), (0.6, 0.99)):
        pages = [(f"http://h{h}.d{h % 5}.org/{i}", 1, int((i * 7 + h) % 100 < 100 * (bad if h == 3 else good))) for h in range(20) for i in range(200)]
        df = spark.createDataFrame([(*p,) for p in pages], "url string, labelled int, bad int")
        got = {r["host"]: r["verdict"] for r in hosts.judge(df, "url", "labelled", "bad").select("host", "verdict").distinct().collect()}
        assert {h for h, v in got.items() if v == "block"} == {"h3.d3.org"}
        even = df.withColumn("bad", (F.pmod(F.xxhash64("url"), F.lit(100)) < int(100 * good)).cast("int"))
        assert hosts.judge(even, "url", "labelled", "bad").filter("verdict = 'block'").count() == 0
    assert hosts.most_bad(0.5) == 0.6 and 0 < hosts.most_bad(0.01) < 0.015 and hosts.most_bad(0.99) < 1


def plain_measures(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_measures(spark):
    texts = [None, "", " \t\x0b", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 30, "x " * 8, "l1 a\nl1 a\n\n \nl1 a", "é# $*\u00a0é <|>", "w1 w2 w3 w4 w5 w6 w7 w8 w9 zz w2 w3 w4 w5 w6 w7 w8 w9 q w1 w2 w3 w4 w5 w6 w7 w8", " ".join(str(i % 50) for i in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    for r in cascade.measured(df, "text").collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_measures(texts[r["doc_id"]]), r["doc_id"]
    kept = [r["doc_id"] for r in cascade.keep_good(df, "text").collect()]
    assert kept == []
    good = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(40)))], "doc_id long, text string")
    assert cascade.keep_good(good, "text").count() == 1 and cascade.keep_good(good.limit(0), "text").count() == 0
    orders = {tuple(r.name for r in cascade.ordered(df, "text"))}
    assert all(sorted(o) == sorted(r.name for r in cascade.RULES) for o in orders)


def test_rules_go_by_rejections_of_what_is_left():
    rules = [cascade.Rule(n, None) for n in "abcd"]
    seconds = {"a": 1.0, "b": 1.0, "c": 0.1, "d": 0.05}
    # a rejects 10, b 9 of them and one more, c 2 others, d none.
    assert [r.name for r in cascade.by_rejections(rules, seconds, {0: 50, 0b0011: 9, 0b0001: 1, 0b0010: 1, 0b0100: 2})] == ["c", "a", "b", "d"]
    # Ties: the cheaper one, then the one that stands first.
    assert [r.name for r in cascade.by_rejections(rules, seconds, {0: 5})] == ["d", "c", "a", "b"]
    assert cascade.by_rejections([], {}, {}) == []


def test_costs_are_of_rules(spark):
    cheap = cascade.Rule("cheap", lambda d: F.size(d["words"]) < 3)
    dear = cascade.Rule("dear", lambda d: cascade.repeated_words(d["words"]) > 10**9)
    df = spark.range(400).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.xxhash64("id", i).cast("string"))).alias("text"))
    seconds, sets = cascade.measured_rules(df, "text", [dear, cheap])
    assert seconds["dear"] > 3 * seconds["cheap"] and sets == {0: 400}
    assert [r.name for r in cascade.ordered(df, "text", [dear, cheap])] == ["cheap", "dear"]


def test_long_and_repeated_texts(spark):
    long = " ".join(f"word{i} is number {i * 7919}" for i in range(60_000))
    again = "the same nine words stand here twice over now " * 2 + " ".join(f"w{i}" for i in range(30))
    rows = [(1, long), (1, long), (2, again), (2, again), (3, "Released under the MIT License. " + long), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rule": F.lit(1), "n_symbols": F.lit("x")})
    for r in cascade.measured(df, "text").collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_measures(dict(rows)[r["doc_id"]]), r["doc_id"]
    assert sorted(r["doc_id"] for r in cascade.keep_good(df, "text").collect()) == [1, 1, 3]
    got = sorted((r["doc_id"], r["licences"]) for r in licences.scan(df, "text").collect())
    assert got == [(1, ""), (1, ""), (2, ""), (2, ""), (3, "MIT"), (4, "")]
    pages = spark.createDataFrame([(1, "http://a.org/" + "x" * 2_000_000, 1, 0), (2, "http://b.org/1", 1, 1), (2, "http://b.org/1", 1, 1)], "page_id long, url string, labelled int, bad int")
    judged = sorted((r["page_id"], r["host"], len(r["path"])) for r in hosts.judge(pages, "url", "labelled", "bad").collect())
    assert judged == [(1, "a.org", 2_000_001), (2, "b.org", 2), (2, "b.org", 2)]


def test_sample_is_of_all_partitions(spark):
    rows = spark.range(0, 8000, 1, 8).select("id", F.when(F.col("id") % 100 == 0, F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), 9000)).otherwise(F.col("id").cast("string")).alias("text"))
    got = [r["t"] for r in cascade.drawn(rows, "text", rows=1000).collect()]
    assert 800 <= len(got) <= 1200 and len(set(got)) == len(got)
    assert {int(t.split()[0]) // 1000 for t in got} == set(range(8))
    assert sum(len(t) > 1 << 15 for t in got) >= 3
    assert sum(map(len, (r["t"] for r in cascade.drawn(rows, "text", rows=1000, most_bytes=1 << 20).collect()))) < 1 << 22
    assert cascade.drawn(rows, "text", rows=8000).count() == 8000
