"""Language-model scores by a subword lattice: the likelihood of a text over all its segmentations.

A word is written as a space and its bytes.  The pieces of an existing
vocabulary, its single bytes included, have weights; a word's probability is the
sum over all ways to cut it into pieces of the product of their weights, which
a forward recursion in log space gives.  A text's probability is the product
over its words and of the end's, so the probabilities of all texts sum to one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.arrow import byte_values, column, rebatched
from millrace.llm.store import materialized

#: Rounds of expectation maximisation over all training words at most, and the count that each piece has besides.
ROUNDS, PRIOR = 4, 0.01
#: Rounds end early when the training words' mean log likelihood rises by less than this.
MOVED = 0.01
#: Words that are scored together, and the longest that are scored in columns.
ROWS, COLUMNS = 60_000, 48
#: Most frequent words whose scores are broadcast, none longer than 64 bytes: 12 MB at most.
FREQUENT, FREQUENT_BYTES = 100_000, 64
#: Distinct words that a counting task holds before it passes its counts on.
HELD = 400_000

_P, _C = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_SPACE = "▁"


def piece_bytes(model_file: str) -> tuple[list[bytes], np.ndarray]:
    """(pieces as bytes, their existing scores) of a sentencepiece vocabulary, a word's start being a space.

    Only pieces that a lower-cased word can hold count: those with a space
    beyond the start, or upper-case letters, are left out.
    """
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    best: dict[bytes, float] = {}
    for i in range(sp.vocab_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        piece = sp.id_to_piece(i)
        raw = bytes([int(piece[3:-1], 16)]) if sp.is_byte(i) else piece.replace(_SPACE, " ").encode()
        if b" " in raw[1:] or raw != raw.lower():
            continue
        best[raw] = max(best.get(raw, -1e18), sp.get_score(i))
    for byte in range(256):
        best.setdefault(bytes([byte]), -1e9)
    return list(best), np.array(list(best.values()))


class PieceTable:
    """Finds pieces, and beginnings of pieces, by a rolling 64-bit hash in an open table."""

    def __init__(self, pieces: list[bytes]):
        self.longest = max(map(len, pieces))
        known: dict[int, int] = {}
        for i, p in enumerate(pieces):
            h = 0
            for k, byte in enumerate(p, 1):
                h = (h * int(_P) + byte + 1) & (2**64 - 1)
                if k < len(p):
                    known.setdefault(h, -2)
            if known.get(h, -2) >= 0:
                raise ValueError("pieces collide")
            known[h] = i
        self.shift = np.uint64(64 - (len(known) * 4).bit_length())
        size = 1 << (64 - int(self.shift))
        self.keys, self.ids = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        for h, i in known.items():
            at = ((h * int(_C)) & (2**64 - 1)) >> int(self.shift)
            while self.ids[at] != -1:
                at = (at + 1) & (size - 1)
            self.keys[at], self.ids[at] = h, i

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, -2 for what only begins a piece, -1 for what doesn't."""
        at = ((h * _C) >> self.shift).astype(np.int64)
        out = self.ids[at]
        open_ = np.flatnonzero((self.keys[at] != h) & (out != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            out[open_] = self.ids[at[open_]]
            open_ = open_[(self.keys[at[open_]] != h[open_]) & (out[open_] != -1)]
        return out


def lattice(table: PieceTable, words: list[bytes], weights: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """(natural log of each word's marginal probability, expected piece counts weighted by ``counts``).

    ``weights`` has a log weight per piece.  Words of a length are taken
    together; from each start only those go on whose letters so far begin a piece.
    """
    out = np.zeros(len(words))
    expected = np.zeros(len(weights)) if counts is not None else None
    sizes = np.array([len(w) + 1 for w in words])
    for n in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == n)
        if n > COLUMNS:
            for i in own.tolist():
                out[i] = _long(table, b" " + words[i], weights, expected, counts[i] if counts is not None else 0)
            continue
        text = np.frombuffer(b"".join([b" " + words[i] for i in own]), np.uint8).reshape(len(own), n).T.astype(np.uint64) + np.uint64(1)
        alpha = np.full((n + 1, len(own)), -np.inf)
        alpha[0] = 0.0
        spans = []
        for s in range(n):
            row, h = np.arange(len(own)), np.zeros(len(own), np.uint64)
            for e in range(s + 1, min(n, s + table.longest) + 1):
                h = h * _P + text[e - 1, row]
                found = table.find(h)
                goes_on = found != -1
                if not goes_on.all():
                    row, h, found = row[goes_on], h[goes_on], found[goes_on]
                if not len(row):
                    break
                is_piece = found >= 0
                at, piece = (row, found) if is_piece.all() else (row[is_piece], found[is_piece])
                if len(at):
                    alpha[e, at] = np.logaddexp(alpha[e, at], alpha[s, at] + weights[piece])
                    if expected is not None:
                        spans.append((s, e, at, piece))
        out[own] = alpha[n]
        if expected is not None:
            beta = np.full((n + 1, len(own)), -np.inf)
            beta[n] = 0.0
            for s, e, at, piece in reversed(spans):
                through = weights[piece] + beta[e, at]
                beta[s, at] = np.logaddexp(beta[s, at], through)
                expected += np.bincount(piece, np.exp(alpha[s, at] + through - alpha[n, at]) * counts[own[at]], len(weights))
    return out, expected


def _long(table: PieceTable, word: bytes, log: np.ndarray, expected: np.ndarray | None, count: float) -> float:
    """One word by position: pieces of each length are looked up for all starts at once."""
    n = len(word)
    text = np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    starts, stops, pieces = [], [], []
    for size in range(1, min(n, table.longest) + 1):
        h = h[: n - size + 1] * _P + text[size - 1 :]
        found = table.find(h)
        at = np.flatnonzero(found >= 0)
        starts.append(at)
        stops.append(at + size)
        pieces.append(found[at])
    s, e, p = np.concatenate(starts), np.concatenate(stops), np.concatenate(pieces)
    w = log[p]
    alpha = np.full(n + 1, -np.inf)
    alpha[0] = 0.0
    order = np.argsort(e, kind="stable")
    edges = np.searchsorted(e[order], np.arange(n + 2))
    for end in range(1, n + 1):
        k = order[edges[end] : edges[end + 1]]
        x = alpha[s[k]] + w[k]
        top = x.max()
        alpha[end] = top + math.log(np.exp(x - top).sum())
    if expected is not None and count:
        beta = np.full(n + 1, -np.inf)
        beta[n] = 0.0
        order = np.argsort(s, kind="stable")
        edges = np.searchsorted(s[order], np.arange(n + 2))
        for start in range(n - 1, -1, -1):
            k = order[edges[start] : edges[start + 1]]
            x = beta[e[k]] + w[k]
            top = x.max()
            beta[start] = top + math.log(np.exp(x - top).sum())
        expected += np.bincount(p, np.exp(alpha[s] + w + beta[e] - alpha[n]) * count, len(expected))
    return float(alpha[n])


def count_words(docs: DataFrame, text: str, held_out: Column) -> DataFrame:
    """(word binary, c): lower-cased words of all texts with their counts in those not held out.

    Counts are made where texts are read and merged by word; a task passes its
    counts on when it holds many words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: dict[bytes, int] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(train.keys(), pa.binary()), pa.array(train.values(), pa.int64())], names=["word", "c"])

        for b in batches:
            get = train.get
            for value, held in zip(byte_values(b.column(0)), b.column(1).to_pylist(), strict=True):
                words = value.lower().split() if value else ()
                if held:
                    for w in words:
                        if w not in train:
                            train[w] = 0
                else:
                    for w in words:
                        train[w] = get(w, 0) + 1
                if len(train) > HELD:
                    yield rows()
                    train.clear()
        if train:
            yield rows()

    parts = docs.select(F.col(f"`{text}`").alias("text"), held_out.alias("held")).mapInArrow(run, "word binary, c bigint")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


def learn(words: DataFrame, model_file: str, texts: int, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Log weights of the pieces, the end's last, from all training words by expectation maximisation.

    The first weights fall with a piece's rank by the vocabulary's own scores.
    Each round sums the expected counts of every distinct word; only these, one
    per piece, and the likelihood reach the driver.  Rounds end when the
    likelihood stops moving.
    """
    pieces, scores = piece_bytes(model_file)
    rank = np.empty(len(pieces))
    rank[np.argsort(-scores, kind="stable")] = np.arange(len(pieces))
    counts = 1.0 / (rank + 10.0)
    counts *= 1.0 / counts.sum()
    spark = words.sparkSession
    train = words.filter("c > 0").select("word", "c")
    total, known = train.agg(F.sum("c"), F.count(F.lit(1))).first()
    end = (texts + 1.0) / (texts + 1.0 + (total or 0) * 3.0 + 1.0)
    likelihood = -math.inf
    for _ in range(rounds if known else 0):
        shared = spark.sparkContext.broadcast(np.log(counts / counts.sum() * (1.0 - end)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table = PieceTable(piece_bytes(model_file)[0])
            out, reached = np.zeros(len(shared.value)), 0.0
            for t in rebatched(batches, ROWS):
                c = column(t, "c").astype(float)
                log, expected = lattice(table, t.column("word").to_pylist(), shared.value, c)
                out += expected
                reached += float(log @ c)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[out[at], reached])], names=["piece", "n"])

        got = train.mapInArrow(run, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        counts, before = np.full(len(pieces), prior), likelihood
        for r in got:
            if r["piece"] >= 0:
                counts[r["piece"]] += r["n"]
            else:
                likelihood = r["n"] / total
        end = (texts + 1.0) / (texts + 1.0 + counts.sum())
        if likelihood - before < MOVED:
            break
    return np.r_[np.log(counts / counts.sum() * (1.0 - end)), math.log(end)]


def score(docs: DataFrame, text: str, held_out: Column, model_file: str, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """Score each row: its columns but the text, then held_out, n_tokens, n_known, train_tokens, base_score and score.

    Texts are scored by a model that learns from those not held out (null:
    learned from).  Tokens are the words, lower-cased in A-Z and split at ASCII
    white space, and one end; null texts are empty.  ``base_score`` is the
    add-one unigram log10 probability, ``score`` the lattice model's.  Columns of
    these names are replaced, all rows stay; no rows give no rows.

    Each distinct word is scored once.  The most frequent ones, a bounded
    number, are broadcast; for the others each text sends its words and their
    number to where the word's score is, and gets their sums back.
    """
    spark = docs.sparkSession
    added = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    held = F.coalesce(held_out, F.lit(False))
    words = materialized(count_words(docs, text, held), "words")
    texts = docs.filter(~held).count()
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n, v = total + texts, distinct + (1 if texts else 0)
    weights = learn(words, model_file, texts, rounds)
    shared = spark.sparkContext.broadcast(weights)
    floor = math.log10(n + v + 1)
    ten = math.log(10.0)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(piece_bytes(model_file)[0])
        for t in rebatched(batches, ROWS):
            c = column(t, "c")
            p = lattice(table, t.column("word").to_pylist(), shared.value[:-1])[0] / ten
            cols = [t.column("word").combine_chunks(), t.column("c").combine_chunks(), pa.array(np.log10(c + 1.0) - floor), pa.array(p)]
            yield pa.RecordBatch.from_arrays(cols, names=["word", "c", "base", "p"])

    scored = materialized(words.select("word", "c").mapInArrow(likelihood, "word binary, c bigint, base double, p double"), "scored")
    # The smallest count that at most `frequent` words reach, from a histogram of the counts' sizes.
    sizes = scored.filter((F.col("c") > 0) & (F.length("word") <= FREQUENT_BYTES)).groupBy(F.floor(F.log2("c") * 8).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).orderBy(F.desc("k")).collect()
    least, reached = None, 0
    for r in sizes:
        reached += r["n"]
        if reached > frequent:
            break
        least = r["least"]
    top = F.lit(False) if least is None else (F.col("c") >= least) & (F.length("word") <= FREQUENT_BYTES)
    common = {bytes(r["word"]): (r["c"] > 0, r["base"], r["p"]) for r in scored.filter(top).collect()}
    known = spark.sparkContext.broadcast(common)
    end_base = (math.log10(texts + 1.0) - floor, weights[-1] / ten)
    kept = [c for c in docs.columns if c.lower() not in added and c != text]
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").alias("text"), held.alias("held"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)])
    schema = T.StructType.fromDDL("row bigint, word binary, times bigint, n_tokens bigint, n_known bigint, base double, p double, held boolean")
    for i in range(len(kept)):
        schema = schema.add(f"k{i}", source.schema[f"k{i}"].dataType)
    names = schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = known.value
        get = have.get
        for b in batches:
            row, word, times, tokens, found, base, p = [], [], [], [], [], [], []
            for r, value in zip(b.column(0).to_pylist(), byte_values(b.column(1)), strict=True):
                own = value.lower().split() if value else ()
                hits, sum_base, sum_p = int(texts > 0), end_base[0], end_base[1]
                rare: dict[bytes, int] = {}
                for w in own:
                    if (x := get(w)) is not None:
                        hits += 1
                        sum_base += x[1]
                        sum_p += x[2]
                    else:
                        rare[w] = rare.get(w, 0) + 1
                row.append(r)
                word.append(None)
                times.append(0)
                tokens.append(len(own) + 1)
                found.append(hits)
                base.append(sum_base)
                p.append(sum_p)
                k = len(rare)
                if k:
                    row += [r] * k
                    word += rare.keys()
                    times += rare.values()
                    tokens += [0] * k
                    found += [0] * k
                    base += [0.0] * k
                    p += [0.0] * k
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            cols = [pa.array(x, kind) for x, kind in zip((row, word, times, tokens, found, base, p), kinds, strict=True)]
            # A text's own row carries its columns, its words' rows have nulls there.
            at = np.full(len(row), -1)
            at[[i for i, w in enumerate(word) if w is None]] = np.arange(b.num_rows)
            yield pa.RecordBatch.from_arrays([*cols, *[c.take(pa.array(at, mask=at < 0)) for c in b.columns[2:]]], names=names)

    sums = materialized(source.mapInArrow(read, schema), "texts")
    rest = scored.filter(~top).select("word", F.col("c").alias("wc"), F.col("base").alias("wb"), F.col("p").alias("wp"))
    joined = sums.filter("word IS NOT NULL").select("row", "word", "times").join(rest, "word")
    back = joined.groupBy("row").agg(F.sum(F.when(F.col("wc") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("wb") * F.col("times")).alias("more_base"), F.sum(F.col("wp") * F.col("times")).alias("more_p"))
    out = sums.filter("word IS NULL").join(back, "row", "left")
    return out.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)],
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("p") + F.coalesce("more_p", F.lit(0.0))).alias("score"),
    )
