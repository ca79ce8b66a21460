"""A join whose larger side a Bloom filter thins out first: ``python -m millrace.examples.bloom_join OUTPUT``."""

import sys

from pyspark.sql import DataFrame, SparkSession

from millrace import build_session, key_join
from millrace.examples.tables import people, visits
from millrace.operators.bloom import BloomSettings
from millrace.plans.runner import Runner


def joined(spark: SparkSession) -> DataFrame:
    """So few rows need no filter, so it has to be forced."""
    return key_join(visits(spark), "visitor", people(spark), "person", bloom=BloomSettings(force=True))


def run(spark: SparkSession, output: str) -> DataFrame:
    Runner(spark).run("bloom join", lambda: joined(spark).write.mode("errorifexists").parquet(output))
    return spark.read.parquet(output)


if __name__ == "__main__":
    if len(sys.argv) != 2:
        sys.exit(__doc__)
    run(build_session("bloom join"), sys.argv[1]).show()
