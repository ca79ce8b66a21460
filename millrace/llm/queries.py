"""The registered queries of the training-data operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, caps, cascade, hosts, lattice, licences, packing, repeats, simhash, tokenfiles
from millrace.llm.store import fresh_path

Query = Callable[[SparkSession, str], DataFrame]

#: The contract of the fingerprint query: three-word shingles, 64 bits, links at three bits.
FINGERPRINTS = simhash.Scheme(shingle=3, bits=64, radius=3, segments=2, segment_bits=32)


def _file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def op1_bpe(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    ranks = _file("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(_documents(spark, d), "text", ranks, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids")
    return bpe.decode(encoded, "ids", ranks).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_lattice(spark: SparkSession, d: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lattice.score(_documents(spark, d), "text", held_out, _file("piece_bpe_32k.model"))


def op3_licences(spark: SparkSession, d: str) -> DataFrame:
    return licences.scan(_documents(spark, d), "text").select("doc_id", F.array_join("sentence_ids", " ").alias("sentences"), "licences", "n_unmatched")


def op4_token_files(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    folder = tokenfiles.write_folder(docs, "doc_id", "text", _file("byte_bpe_50k.json"), fresh_path(spark, "tokens"), end_id=2)
    found = tokenfiles.read_documents(folder, docs.select("doc_id"), "doc_id")
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_simhash(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.groups(_documents(spark, d), "doc_id", "text", FINGERPRINTS)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_documents(spark, d), "doc_id", "text", _file("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op7_repeats(spark: SparkSession, d: str) -> DataFrame:
    cut = repeats.remove_repeats(_documents(spark, d), "text", length=400)
    size = F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    digest = [(F.length("kept") + size).cast("bigint").alias("n_bytes"), size.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]
    # What is left, as text: bytes of a character that a span cut become U+FFFD here, and only here.
    return cut.select("doc_id", *digest, F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op8_caps(spark: SparkSession, d: str) -> DataFrame:
    return caps.near_vectors(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", "label", 0.98)


def _labelled_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the outcome of the document that their url's number names: bad if of no quality, or toxic."""
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/?#]*/[a-z][a-z]/(\d{1,18})(?:[^0-9]|$)", 1)
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", F.when(number != "", number).cast("bigint").alias("number"))
    labels = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    joined = pages.join(labels, pages["number"] == labels["doc_id"], "left")
    return joined.select("page_id", "url", F.when(F.col("doc_id").isNotNull(), 1).otherwise(0).alias("labelled"), F.coalesce("bad", F.lit(0)).alias("bad"))


def op9_hosts(spark: SparkSession, d: str) -> DataFrame:
    return hosts.judge(_labelled_pages(spark, d), "url", "labelled", "bad").select("page_id", "host", "path", "rule", "verdict")


def op10_cascade(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    order = cascade.ordered(docs, "text", cascade.EXTRA)
    found = cascade.measured(docs, "text")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    kept = F.when(F.col("base_failed"), False).otherwise(cascade.verdict(F.col("text"), order))
    return found.withColumn("base_failed", failed).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


def queries() -> dict[str, Query]:
    named = [op1_bpe, op2_lattice, op3_licences, op4_token_files, op5_simhash, op6_packing, op7_repeats, op8_caps, op9_hosts, op10_cascade, pipeline]
    return {f.__name__: f for f in named}


_SECOND = "|".join(hosts.SECOND_LEVEL)
_RULES_SQL = sorted(hosts.RULES, key=lambda r: -len(r[1] + r[2]))
_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (_, h, p) in enumerate(_RULES_SQL))

_HOSTS_SQL = rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, coalesce(regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1), '') AS rest,
  regexp_extract(coalesce(url, ''), '://[^/?#]*/[a-z][a-z]/(\d{{1,18}})(?:[^0-9]|$)', 1) AS num FROM pages),
b AS (SELECT page_id, num, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h0 AS (SELECT host, sum(CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS n, sum(coalesce(bad, 0)) AS k FROM b LEFT JOIN l ON (CASE WHEN num <> '' THEN CAST(num AS BIGINT) END) = l.doc_id GROUP BY host),
h1 AS (SELECT *, regexp_replace(regexp_replace(host, ':\d*$', ''), '\.+$', '') AS nm FROM h0),
h AS (SELECT host, n, k, coalesce(nullif(regexp_extract(nm, '([^.]*\.(?:(?:{_SECOND})\.[a-z][a-z]|[^.]*))$', 1), ''), nm) AS domain, regexp_extract(nm, '((?:(?:{_SECOND})\.[a-z][a-z])|[^.]*)$', 1) AS suffix FROM h1),
d0 AS (SELECT domain, suffix, sum(n) AS dn, sum(k) AS dk FROM h GROUP BY domain, suffix),
s0 AS (SELECT suffix, sum(dn) AS sn, sum(dk) AS sk FROM d0 GROUP BY suffix),
o AS (SELECT (coalesce(sum(sk), 0) + 1.0::DOUBLE) / (coalesce(sum(sn), 0) + 2.0::DOUBLE) AS m FROM s0),
ws AS (SELECT {{weight:sn:sk:m}} AS w FROM (SELECT s0.*, m FROM s0 CROSS JOIN o) WHERE sn > 0),
s AS (SELECT suffix, (sk + w * m) / (sn + w) AS sm FROM s0 CROSS JOIN o CROSS JOIN ws),
d1 AS (SELECT d0.*, sm FROM d0 JOIN s USING (suffix)),
wd AS (SELECT {{weight:dn:dk:sm}} AS w FROM d1 WHERE dn > 0),
d2 AS (SELECT domain, suffix, (dk + w * sm) / (dn + w) AS dm FROM d1 CROSS JOIN wd),
h2 AS (SELECT h.*, dm FROM h JOIN d2 USING (domain, suffix)),
wh AS (SELECT {{weight:n:k:dm}} AS w FROM h2 WHERE n > 0),
h3 AS (SELECT host, n, w, (k + w * dm) / (n + w) AS mean FROM h2 CROSS JOIN wh),
v AS (SELECT host, CASE WHEN mean - {hosts.DEVIATIONS} * sqrt(mean * (1 - mean) / (n + w + 1)) > {hosts.ODDS} * m / (1 - m + {hosts.ODDS} * m) THEN 'block' ELSE 'allow' END AS judged FROM h3 CROSS JOIN o)
SELECT page_id, host, path, CASE {{rules:name}} END AS rule, coalesce(CASE {{rules:verdict}} END, judged) AS verdict FROM b LEFT JOIN v USING (host)
"""


def _hosts_sql() -> str:
    sql = _HOSTS_SQL
    for n, k, m in (("sn", "sk", "m"), ("dn", "dk", "sm"), ("n", "k", "dm")):
        spread = f"sum({n} * pow({k}::DOUBLE / {n} - {m}, 2) / ({m} * (1 - {m})))"
        excess = f"(({spread} - count(*)) / (sum({n}) - count(*)))"
        most, least = hosts.MOST_WEIGHT, hosts.LEAST_WEIGHT
        text = f"CASE WHEN count(*) = 0 OR sum({n}) <= count(*) THEN {most}::DOUBLE WHEN {excess} <= {1 / (1 + most)!r} THEN {most}::DOUBLE ELSE greatest({least}::DOUBLE, (1 - {excess}) / {excess}) END"
        sql = sql.replace(f"{{weight:{n}:{k}:{m}}}", text)
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in _RULES_SQL]
    sql = sql.replace("{rules:name}", " ".join(f"WHEN {f} THEN '{name}'" for f, name, _ in fits))
    return sql.replace("{rules:verdict}", " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits))


_CASCADE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 9)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS covered FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines FROM w LEFT JOIN n ON w.doc_id = n.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols * 5 > n_words OR n_dup_lines * 10 > n_lines * 5 OR word_chars < n_words * 2 OR word_chars > n_words * 20) AS kept FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_licences": licences.scan_sql("documents", "doc_id", "text"), "op9_hosts": _hosts_sql(), "op10_cascade": _CASCADE_SQL}
