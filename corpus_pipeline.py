"""A corpus from raw documents to packed sequences: quality rules, near copies, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import cascade, packing, repeats, simhash
from millrace.llm.store import materialized

#: A passage of 50 words takes 200 bytes at least, but for the shortest words.
PASSAGE_BYTES = 200
#: The rules for junk, but not the one for short texts: nine of ten labelled texts of fewer than 20 words are good ones
#: (sf0.1), and short texts were nearly all of the good ones that it and the others took.
RULES = (cascade.Rule("no_words", lambda d: F.size(d["words"]) == 0), *[r for r in cascade.RULES if r.name != "too_few_words"])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null and empty texts, and those without a word, go."""
    return cascade.keep_good(docs, "text", RULES)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies: five-word shingles, a similarity of 0.8 or more."""
    return simhash.drop_near_copies(docs, "doc_id", "text", simhash.NEAR_COPIES)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur elsewhere too, nor characters that such a passage cuts.

    Every document stays, one that was nothing but such passages with an empty text.
    """
    cut = repeats.remove_repeats(docs, "text", PASSAGE_BYTES, characters=True)
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.col("kept").cast("string"))
    return cut.select(*[text.alias("text") if c == "text" else F.length(text).cast("bigint").alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("packing", sequences)]

#: SQL has no SimHash, suffix structures or tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
