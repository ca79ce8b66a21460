"""A session with settings of its own, some of them refused: ``python -m millrace.examples.own_settings``."""

from pyspark.sql import SparkSession

from millrace import build_session
from millrace.session import REQUIRED

#: Set for every run, unless a caller gives another value.
PROPERTIES = {"spark.sql.shuffle.partitions": "4", "spark.scheduler.pool": "reports"}
#: What a run must name, and what it may not use.
RULES = {"spark.scheduler.pool": REQUIRED, "spark.sql.ansi.enabled": "false"}


def session(**more: str) -> SparkSession:
    return build_session("own settings", properties={**PROPERTIES, **more}, rules=RULES)


if __name__ == "__main__":
    print(session().conf.get("spark.sql.shuffle.partitions"))
