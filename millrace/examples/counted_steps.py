"""A filter and a count, with counters and a report: ``python -m millrace.examples.counted_steps OUTPUT``."""

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace import Counters, build_session, combine, count_rows
from millrace.examples.tables import visits
from millrace.plans.runner import Runner


def run(spark: SparkSession, output: str) -> str:
    """The run's report; the counts of visits per visitor go to ``output``."""
    counters = Counters()
    known = counters.stats_filter(visits(spark), F.col("visitor") < 9, ("visits", "known"))
    counts = combine(known, ["visitor"], [count_rows("n")])
    return Runner(spark).run("counted steps", lambda: counts.write.mode("errorifexists").parquet(output), counters)[1]


if __name__ == "__main__":
    if len(sys.argv) != 2:
        sys.exit(__doc__)
    print(run(build_session("counted steps"), sys.argv[1]))
