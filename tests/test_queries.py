import pytest

from millrace import queries
from tests.compare import DATA, oracle_rows, spark_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    names, rows = spark_rows(queries.queries()[name](spark, DATA))
    want_names, want = oracle_rows(queries.oracle_sql()[name])
    assert names == want_names
    assert rows == want


def test_inexact_filter_keeps_members_and_drops_most_others(spark):
    kept = queries.queries()["semi_filter_inexact_rows"](spark, DATA).count()
    members = len(oracle_rows(queries.oracle_sql()["semi_filter_exact"])[1])
    everything = spark.read.parquet(f"{DATA}/orders.parquet").count()
    assert members <= kept < members + 0.1 * (everything - members)
