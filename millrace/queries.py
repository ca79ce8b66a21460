"""The library's operators applied to the benchmark tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.examples import bloom_join, counted_steps, own_settings
from millrace.functions.binary import compare_bytes, in_byte_order, row_bytes, row_from_bytes
from millrace.functions.hashing import MURMUR3, XXHASH64, HashFunction, false_positive_rate, hash_function, name_id, optimal_hashes, register_hash
from millrace.operators import aggregates as A
from millrace.operators.bloom import BitSet, BloomFilter, BloomSettings, build_bloom, might_contain
from millrace.operators.cogroup import multi_group, multi_group_apply
from millrace.operators.combine import SPEC_ID, AggregationSpec, EvictionError, combine, combine_final, combine_final_ordered, combine_partial, combine_partial_bounded, multi_aggregate, multi_aggregate_tails, stack
from millrace.operators.joins import key_join, limit_join, semi_filter
from millrace.operators.metrics import Counters, caller_label, report
from millrace.operators.rows import append_nulls, batch_map, emit_wide, key_hash, remove_where, rename_in_place
from millrace.operators.traps import ERROR, trap_map, trap_where, trapped
from millrace.plans.naming import checked_name, job_name, leaf
from millrace.plans.runner import NoRecorder, Runner, check_serialises
from millrace.session import REQUIRED, check_properties, fresh_path, merge_properties
from millrace.sources.datasets import Dataset, DatasetRegistry, batched_reads
from millrace.sources.files import Files
from millrace.sources.fixed_width import read_fixed_width, write_fixed_width
from millrace.sources.json_objects import read_json, read_object, read_object_column, read_object_with, write_entries, write_json, write_object
from millrace.sources.sinks import NullSink, read_rows, write_rows

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share."""
    return fresh_path(spark, "scratch")


def _checks(spark: SparkSession, found: Mapping[str, bool]) -> DataFrame:
    return spark.createDataFrame(sorted((k, bool(v)) for k, v in found.items()), "name string, holds boolean")


def _checks_sql(*names: str) -> str:
    return "SELECT name, true AS holds FROM (VALUES " + ", ".join(f"('{n}')" for n in names) + ") AS v(name)"


def _raises(kind: type[BaseException] | tuple[type[BaseException], ...], action: Callable[[], object]) -> bool:
    try:
        action()
    except kind:
        return True
    return False


def _rich(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter("c_acctbal > 5000")


# Joins and semi-joins

_SEMI = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)"
_BIG_ORDERS = "(SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 150000)"


@query("semi_filter_exact", _SEMI)
def semi_filter_exact(spark: SparkSession, d: str) -> DataFrame:
    return semi_filter(table(spark, d, "orders"), "o_custkey", _rich(spark, d), "c_custkey").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("semi_filter_inexact_no_false_negatives", "SELECT CAST(0 AS BIGINT) AS missing")
def semi_filter_inexact_no_false_negatives(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    kept = semi_filter(orders, "o_custkey", _rich(spark, d), "c_custkey", exact=False)
    members = semi_filter(orders, "o_custkey", _rich(spark, d), "c_custkey")
    return members.join(kept.select("o_orderkey"), "o_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("missing"))


@query("semi_filter_inexact_rows")
def semi_filter_inexact_rows(spark: SparkSession, d: str) -> DataFrame:
    return semi_filter(table(spark, d, "orders"), "o_custkey", _rich(spark, d), "c_custkey", exact=False).select("o_orderkey", "o_custkey")


def _joined(spark: SparkSession, d: str, how: str, **more: object) -> DataFrame:
    orders = table(spark, d, "orders").filter("o_totalprice > 150000").select("o_orderkey", "o_custkey")
    return key_join(orders, "o_custkey", _rich(spark, d).select("c_custkey", "c_name"), "c_custkey", how=how, **more)


def _join_sql(kind: str) -> str:
    return f"SELECT o_orderkey, o_custkey, c_custkey, c_name FROM {_BIG_ORDERS} o {kind} JOIN (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000) c ON o_custkey = c_custkey"


for _how, _kind in (("inner", ""), ("keep_large", "LEFT"), ("keep_small", "RIGHT"), ("full", "FULL")):
    query(f"key_join_{_how}", _join_sql(_kind))(lambda spark, d, how=_how: _joined(spark, d, how))

query("key_join_bloom", _join_sql(""))(lambda spark, d: _joined(spark, d, "inner", bloom=BloomSettings()))
query("key_join_bloom_forced", _join_sql(""))(lambda spark, d: _joined(spark, d, "inner", bloom=BloomSettings(force=True)))
query("key_join_bloom_sized", _join_sql("RIGHT"))(lambda spark, d: _joined(spark, d, "keep_small", bloom=BloomSettings(num_bits=4096)))


@query(
    "key_join_bloom_counters",
    "SELECT 'Input records' AS name, count(*) AS value, true AS holds FROM orders UNION ALL SELECT 'Filtered records', NULL, true",
)
def key_join_bloom_counters(spark: SparkSession, d: str) -> DataFrame:
    """The large side's rows, and whether the filter dropped nine tenths of the strangers and no member."""
    c = Counters()
    orders, rich = table(spark, d, "orders"), _rich(spark, d)
    NullSink().write(key_join(orders, "o_custkey", rich, "c_custkey", bloom=BloomSettings(force=True), counters=c))
    strangers = orders.join(rich, orders["o_custkey"] == rich["c_custkey"], "left_anti").count()
    n, dropped = c.get("Input records", "BloomJoin"), c.get("Filtered records", "BloomJoin")
    return spark.createDataFrame([("Input records", n, True), ("Filtered records", None, 0.9 * strangers <= dropped <= strangers)], "name string, value bigint, holds boolean")


#: Items of large orders, joined where neither side is small enough to be broadcast: what the benchmark times.
_SHUFFLED = "SELECT l_orderkey, l_linenumber, l_extendedprice, o_custkey FROM lineitem JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 480000) ON l_orderkey = o_orderkey"


def shuffled_join(spark: SparkSession, d: str, bloom: BloomSettings | None) -> DataFrame:
    orders = table(spark, d, "orders").filter("o_totalprice > 480000").select("o_orderkey", "o_custkey").hint("merge")
    joined = key_join(table(spark, d, "lineitem"), "l_orderkey", orders, "o_orderkey", bloom=bloom)
    return joined.select("l_orderkey", "l_linenumber", "l_extendedprice", "o_custkey")


query("key_join_shuffled", _SHUFFLED)(lambda spark, d: shuffled_join(spark, d, None))
query("key_join_shuffled_bloom", _SHUFFLED)(lambda spark, d: shuffled_join(spark, d, BloomSettings(force=True)))
query("key_join_small_first", _join_sql("RIGHT"))(lambda spark, d: _joined(spark, d, "keep_small", order="small_first"))


@query(
    "key_join_null_safe",
    "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS k FROM orders), c AS (SELECT c_custkey, CASE WHEN c_custkey = 1 THEN NULL ELSE c_custkey END AS ck FROM customer)"
    " SELECT o_orderkey, k, c_custkey FROM o JOIN c ON k IS NOT DISTINCT FROM ck",
)
def key_join_null_safe(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")).alias("k"))
    customers = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") != 1, F.col("c_custkey")).alias("ck"))
    return key_join(orders, "k", customers, "ck", null_safe=True).drop("ck")


@query(
    "limit_join",
    "WITH o AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2),"
    " c AS (SELECT c_custkey, c_nationkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 3)"
    " SELECT o_custkey, o_orderkey, c_nationkey FROM o JOIN c ON o_custkey = c_custkey",
)
def limit_join_query(spark: SparkSession, d: str) -> DataFrame:
    customers = limit_join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", table(spark, d, "nation").select("n_nationkey"), "n_nationkey", (3, 1), ["c_custkey"], ["n_nationkey"])
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return limit_join(orders, "o_custkey", customers, "c_custkey", (2, None), ["o_orderkey"], ["c_custkey"]).select("o_custkey", "o_orderkey", "c_nationkey")


# Co-groups

_GROUP2 = (
    "SELECT coalesce(o.k, c.k) AS k, coalesce(o.n, 0) AS n_orders, coalesce(c.n, 0) AS n_customers, o.last AS last_order FROM"
    " (SELECT o_custkey AS k, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1) o FULL JOIN (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON o.k = c.k"
)


@query("multi_group_two_inputs", _GROUP2)
def multi_group_two_inputs(spark: SparkSession, d: str) -> DataFrame:
    return multi_group(
        [table(spark, d, "orders").select("o_custkey", "o_orderkey"), table(spark, d, "customer").select("c_custkey")],
        ["o_custkey", "c_custkey"],
        {"n_orders": lambda o: F.count(o()), "n_customers": lambda _, c: F.count(c()), "last_order": lambda o: F.max(o("o_orderkey"))},
        ["k"],
    )


_GROUP3 = (
    "SELECT k, sum(o) AS n_orders, sum(l) AS n_items, sum(e) AS n_events FROM (SELECT o_custkey AS k, 1 AS o, 0 AS l, 0 AS e FROM orders UNION ALL SELECT l_suppkey, 0, 1, 0 FROM lineitem"
    " UNION ALL SELECT user_id, 0, 0, 1 FROM events) GROUP BY k"
)
_GROUP3 = _GROUP3.replace("sum(o)", "CAST(sum(o) AS BIGINT)").replace("sum(l)", "CAST(sum(l) AS BIGINT)").replace("sum(e)", "CAST(sum(e) AS BIGINT)")


def _three(spark: SparkSession, d: str) -> tuple[list[DataFrame], list[str]]:
    return [table(spark, d, "orders").select("o_custkey"), table(spark, d, "lineitem").select("l_suppkey"), table(spark, d, "events").select("user_id")], ["o_custkey", "l_suppkey", "user_id"]


@query("multi_group_three_inputs", _GROUP3)
def multi_group_three_inputs(spark: SparkSession, d: str) -> DataFrame:
    frames, keys = _three(spark, d)
    return multi_group(frames, keys, {"n_orders": lambda o: F.count(o()), "n_items": lambda _, i: F.count(i()), "n_events": lambda _, __, e: F.count(e())}, ["k"])


@query("multi_group_apply_three_inputs", _GROUP3)
def multi_group_apply_three_inputs(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    frames, keys = _three(spark, d)
    return multi_group_apply(frames, keys, lambda _, parts: pd.DataFrame({n: [len(p)] for n, p in zip(("n_orders", "n_items", "n_events"), parts, strict=True)}), "n_orders bigint, n_items bigint, n_events bigint", ["k"])


# Aggregation


@query(
    "combine_sum_count_min_max",
    "SELECT l_returnflag, sum(l_quantity) AS quantity, count(*) AS n, min(l_linenumber)::BIGINT AS low, max(l_linenumber)::BIGINT AS high FROM lineitem GROUP BY 1",
)
def combine_sum_count_min_max(spark: SparkSession, d: str) -> DataFrame:
    return combine(table(spark, d, "lineitem"), ["l_returnflag"], [A.total("l_quantity", "quantity"), A.count_rows("n"), A.minimum("l_linenumber", "low"), A.maximum("l_linenumber", "high")])


@query("combine_average", "SELECT l_linestatus, sum(l_quantity) AS total, count(l_quantity) AS n, sum(l_quantity) / count(l_quantity) AS mean FROM lineitem GROUP BY 1")
def combine_average(spark: SparkSession, d: str) -> DataFrame:
    return combine(table(spark, d, "lineitem"), ["l_linestatus"], [A.average("l_quantity", "total", "n", "mean")])


@query(
    "combine_composite",
    "SELECT l_suppkey, sum(l_quantity) AS a, CAST(sum(l_linenumber) AS BIGINT) AS b, sum(l_quantity + l_linenumber) AS both, 2 * sum(l_quantity + l_linenumber) AS doubled FROM lineitem GROUP BY 1",
)
def combine_composite(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").withColumn("both_in", F.col("l_quantity") + F.col("l_linenumber"))
    both = A.transformed(A.total("both_in", "both"), doubled=F.col("both") * 2)
    return combine(df, ["l_suppkey"], [A.total("l_quantity", "a"), A.total("l_linenumber", "b"), both])


@query("combine_multi_input", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")
def combine_multi_input(spark: SparkSession, d: str) -> DataFrame:
    return combine([table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))], ["k"], [A.count_rows("n")])


_NULLS = "(SELECT CASE WHEN l_linenumber > 2 THEN l_returnflag END AS a, CASE WHEN l_linenumber > 4 THEN l_linestatus END AS b, l_quantity FROM lineitem)"


def _with_nulls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).alias("a"), F.when(F.col("l_linenumber") > 4, F.col("l_linestatus")).alias("b"), "l_quantity")


@query("combine_drop_null_groups", f"SELECT a, b, count(*) AS n FROM {_NULLS} WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY 1, 2")
def combine_drop_null_groups(spark: SparkSession, d: str) -> DataFrame:
    return combine(_with_nulls(spark, d), ["a", "b"], [A.count_rows("n")], keep_null_groups=False)


@query("combine_keep_null_groups", f"SELECT a, b, count(*) AS n FROM {_NULLS} GROUP BY 1, 2")
def combine_keep_null_groups(spark: SparkSession, d: str) -> DataFrame:
    return combine(_with_nulls(spark, d), ["a", "b"], [A.count_rows("n")])


@query("combine_partial_then_final", "SELECT l_returnflag, sum(l_quantity) AS total, count(l_quantity) AS n, sum(l_quantity) / count(l_quantity) AS mean, count(*) AS n_rows FROM lineitem GROUP BY 1")
def combine_partial_then_final(spark: SparkSession, d: str) -> DataFrame:
    parts = [A.average("l_quantity", "total", "n", "mean"), A.count_rows("n_rows")]
    return combine_final(combine_partial(table(spark, d, "lineitem"), ["l_returnflag"], parts), ["l_returnflag"], parts)


@query("combine_partial_bounded_then_final", "SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def combine_partial_bounded_then_final(spark: SparkSession, d: str) -> DataFrame:
    partial = combine_partial_bounded(table(spark, d, "lineitem"), ["l_suppkey"], ["l_linenumber"], lambda: 0, lambda s, row: s + int(row[0]), lambda s: (s,), "total bigint", item_limit=20)
    return combine_final(partial, ["l_suppkey"], [A.total("total", "total")])


@query(
    "combine_final_ordered",
    "SELECT user_id, CAST(count_if(event_type <> before) AS BIGINT) AS changes, count(*) AS n FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1",
)
def combine_final_ordered_query(spark: SparkSession, d: str) -> DataFrame:
    def merge(state: tuple, row: tuple) -> tuple:
        changes, n, before = state
        return changes + (n > 0 and row[0] != before), n + 1, row[0]

    return combine_final_ordered(table(spark, d, "events"), ["user_id"], ["event_type"], lambda: (0, 0, None), merge, lambda s: s[:2], "changes bigint, n bigint", order_by=["ts", "event_id"])


def _specs() -> list[AggregationSpec]:
    return [
        AggregationSpec("by_flag", ["l_returnflag"], [A.total("l_quantity", "quantity"), A.count_rows("n")]),
        AggregationSpec("by_flag_status", ["l_returnflag", "l_linestatus"], [A.total("l_quantity", "quantity")]),
        AggregationSpec("by_line", ["l_linenumber"], [A.average("l_quantity", "total", "m", "mean")]),
        AggregationSpec("all", [], [A.count_rows("n")]),
    ]


def _wide_sql() -> str:
    ids = {n: name_id(n) for n in ("by_flag", "by_flag_status", "by_line", "all")}
    null = {"l_returnflag": "NULL::VARCHAR", "l_linestatus": "NULL::VARCHAR", "l_linenumber": "NULL::INTEGER", "quantity": "NULL::DOUBLE", "n": "NULL::BIGINT", "total": "NULL::DOUBLE", "m": "NULL::BIGINT", "mean": "NULL::DOUBLE"}
    parts = []
    for name, have, group in (
        ("by_flag", {"l_returnflag": "l_returnflag", "quantity": "sum(l_quantity)", "n": "count(*)"}, "GROUP BY l_returnflag"),
        ("by_flag_status", {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus", "quantity": "sum(l_quantity)"}, "GROUP BY l_returnflag, l_linestatus"),
        ("by_line", {"l_linenumber": "l_linenumber", "total": "sum(l_quantity)", "m": "count(l_quantity)", "mean": "sum(l_quantity) / count(l_quantity)"}, "GROUP BY l_linenumber"),
        ("all", {"n": "count(*)"}, ""),
    ):
        parts.append(f"SELECT ({ids[name]})::INTEGER AS {SPEC_ID}, " + ", ".join(f"{have.get(c, x)} AS {c}" for c, x in null.items()) + f" FROM lineitem {group}")
    return " UNION ALL ".join(parts)


@query("multi_aggregate_wide", _wide_sql())
def multi_aggregate_wide(spark: SparkSession, d: str) -> DataFrame:
    return multi_aggregate(table(spark, d, "lineitem"), _specs())


@query("multi_aggregate_reduced", _wide_sql())
def multi_aggregate_reduced(spark: SparkSession, d: str) -> DataFrame:
    return multi_aggregate(table(spark, d, "lineitem"), _specs(), reduce_first=True)


def tails(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return multi_aggregate_tails(table(spark, d, "lineitem"), _specs(), reduce_first=True)


for _name, _sql in {
    "by_flag": "SELECT l_returnflag, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY 1",
    "by_flag_status": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2",
    "by_line": "SELECT l_linenumber, sum(l_quantity) AS total, count(l_quantity) AS m, sum(l_quantity) / count(l_quantity) AS mean FROM lineitem GROUP BY 1",
    "all": "SELECT count(*) AS n FROM lineitem",
}.items():
    query(f"multi_aggregate_tail_{_name}", _sql)(lambda spark, d, name=_name: tails(spark, d)[name])


@query("hll_within_tolerance", "SELECT l_returnflag, true AS close FROM lineitem GROUP BY 1")
def hll_within_tolerance(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    parts = [A.distinct_sketch(["l_partkey"])]
    merged = combine_final(combine_partial(df, ["l_returnflag"], parts), ["l_returnflag"], parts)
    exact = df.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"))
    return merged.join(exact, "l_returnflag").select("l_returnflag", (F.abs(F.col("cardinality") - F.col("exact")) <= 0.02 * F.col("exact")).alias("close"))


@query("quantile_within_tolerance", "SELECT true AS close")
def quantile_within_tolerance(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select(F.col("o_totalprice").cast("bigint").alias("v"))
    parts = [A.quantile_sketch("v", at={"median": 0.5})]
    merged = combine_final(combine_partial(df, [], parts), [], parts)
    below = df.join(F.broadcast(merged.select("median"))).agg((F.count_if(F.col("v") <= F.col("median")) / F.count(F.lit(1))).alias("rank"))
    return below.select((F.abs(F.col("rank") - 0.5) < 0.02).alias("close"))


# Counters


def _counted(spark: SparkSession, counters: Counters, df: DataFrame) -> DataFrame:
    NullSink().write(df)
    return spark.createDataFrame([(c.group, c.name, c.value) for c in counters.collect()], "`group` string, name string, value bigint")


@query(
    "stats_filter_counters",
    "SELECT 'q' AS \"group\", name, value FROM (SELECT 'f - Input records' AS name, count(*) AS value FROM lineitem UNION ALL SELECT 'f - Kept records', count(*) FROM lineitem WHERE l_quantity > 25"
    " UNION ALL SELECT 'f - Removed records', count(*) FROM lineitem WHERE l_quantity <= 25)",
)
def stats_filter_counters(spark: SparkSession, d: str) -> DataFrame:
    c = Counters()
    return _counted(spark, c, c.stats_filter(table(spark, d, "lineitem"), F.col("l_quantity") > 25, ("q", "f")))


@query(
    "counters",
    "SELECT '' AS \"group\", 'all' AS name, count(*) AS value FROM orders UNION ALL SELECT 'g', 'open', count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'g', 'keys', CAST(sum(o_custkey) AS BIGINT) FROM orders",
)
def counters_query(spark: SparkSession, d: str) -> DataFrame:
    c = Counters()
    df = c.increment(table(spark, d, "orders"), "all")
    df = c.increment_for_values(df, {"o_orderstatus": "O"}, "open", "g")
    return _counted(spark, c, c.sum_of(df, "o_custkey", "keys", "g"))


@query(
    "stats_steps",
    "SELECT 'q' AS \"group\", 'agg - Input records' AS name, count(*) AS value FROM orders UNION ALL SELECT 'q', 'agg - Total output records', count(DISTINCT o_orderstatus) FROM orders"
    " UNION ALL SELECT 'q', 'map - Input records', count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'q', 'map - Output records', 2 * count(DISTINCT o_orderstatus) FROM orders",
)
def stats_steps(spark: SparkSession, d: str) -> DataFrame:
    c = Counters()
    df = c.stats_aggregate(table(spark, d, "orders"), lambda x: x.groupBy("o_orderstatus").count(), ("q", "agg"))
    return _counted(spark, c, c.stats_map(df, lambda x: x.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")), ("q", "map")))


# Rows


@query("rename_in_place", "SELECT n_name, n_nationkey AS id FROM nation")
def rename_query(spark: SparkSession, d: str) -> DataFrame:
    return rename_in_place(table(spark, d, "nation"), ["n_name", "n_nationkey"], "n_nationkey", "id")


@query("append_nulls", "SELECT *, NULL::BIGINT AS x, NULL::VARCHAR AS y FROM region")
def append_nulls_query(spark: SparkSession, d: str) -> DataFrame:
    return append_nulls(table(spark, d, "region"), {"x": "bigint", "y": "string"})


@query("remove_where", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O')")
def remove_where_query(spark: SparkSession, d: str) -> DataFrame:
    return remove_where(table(spark, d, "orders"), F.col("o_orderstatus") == "O").select("o_orderkey")


@query("key_hash_groups", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def key_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    return key_hash(table(spark, d, "nation"), ["n_regionkey"], types=["bigint"]).groupBy("key_hash").agg(F.first("n_regionkey").alias("n_regionkey"), F.count(F.lit(1)).alias("n")).drop("key_hash")


@query("emit_wide", "SELECT 'n' AS part, n_name, NULL::VARCHAR AS r_name FROM nation UNION ALL SELECT 'r', NULL, r_name FROM region")
def emit_wide_query(spark: SparkSession, d: str) -> DataFrame:
    return emit_wide({"n": table(spark, d, "nation").select("n_name"), "r": table(spark, d, "region").select("r_name")})


@query("merge_inputs", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def merge_inputs(spark: SparkSession, d: str) -> DataFrame:
    return stack([table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), table(spark, d, "region").select(F.col("r_regionkey").alias("k"))])


@query(
    "batch_map_sizes",
    "WITH t AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation)"
    " SELECT CAST(n_nationkey AS VARCHAR) || '-' || CAST(least(4, n - (i // 4) * 4) AS VARCHAR) AS label FROM t",
)
def batch_map_sizes(spark: SparkSession, d: str) -> DataFrame:
    ordered = table(spark, d, "nation").orderBy("n_nationkey").coalesce(1)
    return batch_map(ordered, "n_nationkey", lambda xs: [f"{x}-{len(xs)}" for x in xs], "label", "string", 4)


# Sources and sinks


@query("fixed_width_roundtrip", "SELECT rpad(n_name, 20, ' ') AS name, lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS id FROM nation")
def fixed_width_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch(spark)}/fixed"
    table(spark, d, "nation").select(F.concat(F.rpad("n_name", 20, " "), F.lpad(F.col("n_nationkey").cast("string"), 4, "0")).alias("value")).write.text(path)
    return read_fixed_width(spark, path, ["name", "id"], [20, 4])


@query("json_object_entries", "SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events")
def json_object_entries(spark: SparkSession, d: str) -> DataFrame:
    return read_object_column(table(spark, d, "events").select("event_id", "props"), "props", "bigint")


@query("json_object_roundtrip", "SELECT n_name AS key, CAST(n_nationkey AS BIGINT) AS value FROM nation")
def json_object_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch(spark)}/objects"
    write_object(table(spark, d, "nation"), "n_name", "n_nationkey", path, ["a", "b"], compress=True)
    return read_object(spark, f"{path}/part-*", "bigint", ["a", "b"])


@query("null_sink", "SELECT CAST(0 AS BIGINT) AS n_rows")
def null_sink_query(spark: SparkSession, d: str) -> DataFrame:
    sink = NullSink()
    sink.write(table(spark, d, "lineitem"))
    return sink.read(spark).agg(F.count(F.lit(1)).alias("n_rows"))


# Several operators in one plan


@query(
    "flagship",
    "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000) GROUP BY 1",
)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    kept = semi_filter(table(spark, d, "orders"), "o_custkey", _rich(spark, d), "c_custkey")
    return combine(kept, ["o_orderstatus"], [A.count_rows("n"), A.total("o_orderkey", "keys")])


# What the tables above don't show: refusals, limits, storage, run tooling

_FILTER_CHECKS = ("union_has_both", "intersection_has_common", "sizes_must_agree", "stored_is_equal", "key_count_is_near", "bits_work", "rates")


@query("bloom_filter_object", _checks_sql(*_FILTER_CHECKS))
def bloom_filter_object(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select("c_custkey")
    settings = BloomSettings(num_bits=1 << 16)
    low, high = (build_bloom(customers.filter(f), "c_custkey", settings) for f in ("c_custkey <= 1000", "c_custkey > 900"))
    of = lambda b: customers.filter(might_contain(customers, "c_custkey", b))
    n = customers.count()
    bits = BitSet(11)
    bits.fill()
    bits.unset(3)
    bits.flip()
    again = BloomFilter.from_bytes(low.to_bytes())
    return _checks(
        spark,
        {
            "union_has_both": of(low.union(high)).count() == n,
            "intersection_has_common": of(low.intersection(high)).filter("c_custkey > 900 AND c_custkey <= 1000").count() == customers.filter("c_custkey > 900 AND c_custkey <= 1000").count(),
            "sizes_must_agree": _raises(ValueError, lambda: low.union(BloomFilter(64, low.num_hashes))),
            "stored_is_equal": again.bits == low.bits and again.num_hashes == low.num_hashes,
            "key_count_is_near": abs(low.num_keys - min(n, 1000)) <= 0.05 * min(n, 1000),
            "bits_work": bits.count() == 1 and bits.get(3),
            "rates": round(false_positive_rate(3, 100, 20), 3) == 0.092 and round(false_positive_rate(2, 100, 50), 3) == 0.4 and optimal_hashes(100, 10, 1, 6)[1] == 6,
        },
    )


def _bounded(df: DataFrame, **limits: object) -> DataFrame:
    return combine_partial_bounded(df, ["l_suppkey"], ["l_linenumber"], lambda: 0, lambda s, row: s + int(row[0]), lambda s: (s,), "total bigint", **limits)


_BY_SUPPLIER = "SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1"


@query("combine_bounded_by_memory", _BY_SUPPLIER)
def combine_bounded_by_memory(spark: SparkSession, d: str) -> DataFrame:
    partial = _bounded(table(spark, d, "lineitem"), item_limit=0, memory_limit=1000, size_of=lambda key, state: 60)
    return combine_final(partial, ["l_suppkey"], [A.total("total", "total")])


@query("combine_bounded_evict_when", _BY_SUPPLIER)
def combine_bounded_evict_when(spark: SparkSession, d: str) -> DataFrame:
    return combine_final(_bounded(table(spark, d, "lineitem"), evict_when=lambda state: state > 50), ["l_suppkey"], [A.total("total", "total")])


@query("combine_bounded_drop_null_groups", "SELECT a, count(*) AS n FROM (SELECT CASE WHEN l_linenumber > 2 THEN l_returnflag END AS a FROM lineitem) WHERE a IS NOT NULL GROUP BY 1")
def combine_bounded_drop_null_groups(spark: SparkSession, d: str) -> DataFrame:
    partial = combine_partial_bounded(_with_nulls(spark, d), ["a"], ["l_quantity"], lambda: 0, lambda s, _: s + 1, lambda s: (s,), "n bigint", keep_null_groups=False)
    return combine_final(partial, ["a"], [A.total("n", "n")])


@query("combine_counters", "SELECT 'Input records' AS name, count(*) AS value FROM orders UNION ALL SELECT 'Output records', count(*) FROM orders UNION ALL SELECT 'Evicted records', count(*) - 1 FROM orders")
def combine_counters(spark: SparkSession, d: str) -> DataFrame:
    """A cache of one entry, over keys that never repeat: all but the last are pushed out."""
    c = Counters()
    df = table(spark, d, "orders").select("o_orderkey").coalesce(1)
    NullSink().write(combine_partial_bounded(df, ["o_orderkey"], ["o_orderkey"], lambda: 0, lambda s, _: s + 1, lambda s: (s,), "n bigint", item_limit=1, counters=c, label="q"))
    return spark.createDataFrame([(x.name, x.value) for x in c.collect()], "name string, value bigint")


_REFUSED = ("strict_limit", "strict_eviction", "id_collision", "no_limit", "overlapping_names", "memory_without_size")


@query("combine_refusals", _checks_sql(*_REFUSED))
def combine_refusals(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.errors import PythonException

    items = table(spark, d, "lineitem")
    return _checks(
        spark,
        {
            "strict_limit": _raises((PythonException, EvictionError), lambda: NullSink().write(_bounded(items, item_limit=1, strict=True))),
            "strict_eviction": _raises((PythonException, EvictionError), lambda: NullSink().write(_bounded(items, evict_when=lambda s: s > 3, strict=True))),
            "id_collision": _raises(ValueError, lambda: multi_aggregate(items, [AggregationSpec("Aa", ["l_suppkey"], []), AggregationSpec("BB", ["l_partkey"], [])])),
            "no_limit": _raises(ValueError, lambda: _bounded(items, item_limit=0)),
            "overlapping_names": _raises(ValueError, lambda: AggregationSpec("x", ["l_tax"], [A.total("l_quantity", "l_tax")])),
            "memory_without_size": _raises(ValueError, lambda: _bounded(items, memory_limit=10)),
        },
    )


@query("multi_aggregate_null_groups", "SELECT 'ab' AS spec, a, b, count(*) AS n FROM " + _NULLS + " WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY 2, 3 UNION ALL SELECT 'b', NULL, b, count(*) FROM " + _NULLS + " GROUP BY 3 UNION ALL SELECT 'b2', NULL, b, count(*) FROM " + _NULLS + " WHERE b IS NOT NULL GROUP BY 3")
def multi_aggregate_null_groups(spark: SparkSession, d: str) -> DataFrame:
    specs = [AggregationSpec("ab", ["a", "b"], [A.count_rows("n")], keep_null_groups=False), AggregationSpec("b", ["b"], [A.count_rows("n")]), AggregationSpec("b2", ["b"], [A.count_rows("n")], keep_null_groups=False)]
    names = F.create_map(*[x for s in specs for x in (F.lit(s.id), F.lit(s.name))])
    return multi_aggregate(_with_nulls(spark, d), specs).select(names[F.col(SPEC_ID)].alias("spec"), "a", "b", "n")


@query("stats_groups", "SELECT 'q' AS \"group\", 'b - Input groups' AS name, count(DISTINCT o_orderstatus) AS value FROM orders UNION ALL SELECT 'q', 'b - Output records', 2 * count(DISTINCT o_orderstatus) FROM orders")
def stats_groups_query(spark: SparkSession, d: str) -> DataFrame:
    c = Counters()
    return _counted(spark, c, c.stats_groups(table(spark, d, "orders"), ["o_orderstatus"], lambda x: x.select("o_orderstatus").distinct().select(F.explode(F.array("o_orderstatus", "o_orderstatus"))), ("q", "b")))


@query("counter_null_equals_null", "SELECT '' AS \"group\", 'n' AS name, count(*) AS value FROM " + _NULLS + " WHERE a IS NULL AND l_quantity = 7")
def counter_null_equals_null(spark: SparkSession, d: str) -> DataFrame:
    c = Counters()
    return _counted(spark, c, c.increment_for_values(_with_nulls(spark, d), {"a": None, "l_quantity": 7.0}, "n"))


@query("counter_reports", _checks_sql("black_hole", "no_black_hole", "bytes_are_humanised", "label_has_line"))
def counter_reports(spark: SparkSession, d: str) -> DataFrame:
    group, name = caller_label("Filter", depth=1)
    return _checks(
        spark,
        {
            "black_hole": "BLACK HOLE" in report({"g": {"Tuples Read": 5}}),
            "no_black_hole": "BLACK HOLE" not in report({"g": {"Tuples Read": 5, "Tuples Written": 1}}),
            "bytes_are_humanised": "2.0 KB" in report({"g": {"Bytes read": 2048}}),
            "label_has_line": group == "queries" and name.endswith(" - Filter") and name.split(" ")[0].isdigit(),
        },
    )


def _lines(spark: SparkSession, d: str) -> str:
    """Nation names at ten characters, longer ones cut at twelve, shorter ones left short."""
    path = f"{scratch(spark)}/lines"
    table(spark, d, "nation").select(F.substring("n_name", 1, 12).alias("value")).write.text(path)
    return path


@query("fixed_width_lenient", "SELECT substr(n_name, 1, 4) AS a, substr(n_name, 5, 3) AS b FROM nation WHERE length(n_name) = 7")
def fixed_width_lenient(spark: SparkSession, d: str) -> DataFrame:
    return read_fixed_width(spark, _lines(spark, d), ["a", "b"], [4, 3], strict=False)


@query("fixed_width_rejects", "SELECT 'Input records' AS name, count(*) AS value FROM nation UNION ALL SELECT 'Rejected records', count(*) FROM nation WHERE length(n_name) <> 7")
def fixed_width_rejects(spark: SparkSession, d: str) -> DataFrame:
    c = Counters()
    NullSink().write(read_fixed_width(spark, _lines(spark, d), ["a", "b"], [4, 3], strict=False, counters=c))
    return spark.createDataFrame([(x.name, x.value) for x in c.collect()], "name string, value bigint")


@query("fixed_width_refusals", _checks_sql("strict_lines", "widths_and_fields", "no_sink"))
def fixed_width_refusals(spark: SparkSession, d: str) -> DataFrame:
    path = _lines(spark, d)
    return _checks(
        spark,
        {
            "strict_lines": _raises(ValueError, lambda: read_fixed_width(spark, path, ["a", "b"], [4, 3])),
            "widths_and_fields": _raises(ValueError, lambda: read_fixed_width(spark, path, ["a", "b"], [4])),
            "no_sink": _raises(NotImplementedError, write_fixed_width),
        },
    )


@query("json_custom_reader", "SELECT lower(n_name) AS name, n_nationkey * 2 AS twice FROM nation")
def json_custom_reader(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch(spark)}/objects"
    write_object(table(spark, d, "nation"), "n_name", "n_nationkey", path, ["x"])
    return read_object_with(spark, f"{path}/part-*", lambda k, v: (k.lower(), 2 * v), "name string, twice int", ["x"])


@query("json_written_entry_by_entry", "SELECT n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS value FROM nation")
def json_written_entry_by_entry(spark: SparkSession, d: str) -> DataFrame:
    """A small table's rows, streamed to the driver and on to one packed file; values may be null."""
    path = f"{scratch(spark)}/entries.json"
    rows = table(spark, d, "nation").select("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey"))).toLocalIterator()
    write_entries(spark, path, ((r[0], r[1]) for r in rows), ["a", "b"], compress=True)
    return read_object(spark, path, "int", ["a", "b"])


@query("json_values", _checks_sql("read_is_written", "null_key_refused_local", "null_key_refused", "no_such_object"))
def json_values(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark)
    value = {"key1": "ignore", "key2": {"deepKey1": 1, "deepKey2": [1, {"x": None}]}}
    write_json(spark, f"{folder}/one.json", value)
    named = table(spark, d, "nation").select(F.when(F.col("n_nationkey") > 3, F.col("n_name")).alias("k"), "n_nationkey")
    return _checks(
        spark,
        {
            "read_is_written": read_json(spark, f"{folder}/one.json") == value,
            "null_key_refused_local": _raises(ValueError, lambda: write_entries(spark, f"{folder}/bad.json", [(None, 1)])) and not Files(spark).exists(f"{folder}/bad.json"),
            "null_key_refused": _raises(Exception, lambda: write_object(named, "k", "n_nationkey", f"{folder}/bad")),
            "no_such_object": _raises(Exception, lambda: NullSink().write(read_object(spark, f"{folder}/one.json", "string", ["key1"]))),
        },
    )


@query("dataset_roundtrip", "SELECT r_regionkey, r_name FROM region")
def dataset_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    registry = DatasetRegistry(scratch(spark))
    store = registry.add("regions", "/regions", "r_regionkey int, r_name string")
    store.write(table(spark, d, "region"))
    return registry["regions"].read(spark)


@query("batched_reads", "SELECT count(*) AS n, true AS few FROM orders")
def batched_reads_query(spark: SparkSession, d: str) -> DataFrame:
    """Forty files are read as one partition, and as several where these may be small."""
    path = f"{scratch(spark)}/many"
    table(spark, d, "orders").repartition(40).write.parquet(path)
    with batched_reads(spark, paths=[path]):
        one = spark.read.parquet(path)
        parts, n = one.rdd.getNumPartitions(), one.count()
    with batched_reads(spark, min_batch=1, paths=[path]):
        several = spark.read.parquet(path).rdd.getNumPartitions()
    return spark.createDataFrame([(n, parts == 1 and several >= min(2, spark.sparkContext.defaultParallelism))], "n bigint, few boolean")


@query("rows_written_and_read", "SELECT 1 AS k, 'a' AS v UNION ALL SELECT 2, NULL")
def rows_written_and_read(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch(spark)}/rows"
    write_rows(spark, [(1, "a"), (2, None)], "k int, v string", path)
    return spark.createDataFrame(read_rows(spark, path, "k int, v string"), "k int, v string")


@query("unique_partial", "SELECT DISTINCT o_custkey FROM orders")
def unique_partial(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keys out of bounded partials, which may emit a key several times."""
    partial = combine_partial_bounded(table(spark, d, "orders"), ["o_custkey"], ["o_custkey"], lambda: None, lambda s, _: s, lambda s: (1,), "seen int", item_limit=100)
    return partial.select("o_custkey").distinct()


@query("trap_rows", "SELECT 'good' AS part, o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderkey % 7 <> 0 UNION ALL SELECT 'bad', o_orderkey FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'cheap', o_orderkey FROM orders WHERE o_totalprice <= 1000 AND o_orderkey % 7 <> 0")
def trap_rows(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark)
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    good = trap_map(orders, ["o_orderkey"], lambda k: (1 // (k % 7),), "x bigint", f"{folder}/map")
    dear = trap_where(good.drop("x"), F.col("o_totalprice") > 1000, f"{folder}/cheap")
    bad = trapped(orders, f"{folder}/map").filter(F.col(ERROR).startswith("ZeroDivisionError"))
    parts = {"good": dear, "bad": bad, "cheap": spark.read.parquet(f"{folder}/cheap")}
    return stack([df.select(F.lit(name).alias("part"), "o_orderkey") for name, df in parts.items()])


_TOOLING = ("caller_wins", "required_property", "forbidden_property", "job_names", "checkpoint_names", "steps_resume", "functions_are_checked", "recorder_is_told", "files", "trash_or_delete", "registry_names", "formats")


@query("run_tooling", _checks_sql(*_TOOLING))
def run_tooling(spark: SparkSession, d: str) -> DataFrame:
    folder, told, built = scratch(spark), [], []

    class Recorder(NoRecorder):
        def on_finished(self, name: str, seconds: float, error: str | None) -> None:
            told.append((name, error is None))

    def build() -> DataFrame:
        built.append(1)
        return table(spark, d, "region")

    runner = Runner(spark, recorder=Recorder())
    steps = [runner.step("regions", build, folder).count() for _ in range(2)]
    failed = _raises(ZeroDivisionError, lambda: runner.run("bad", lambda: 1 // 0))
    files = Files(spark)
    files.make_directory(f"{folder}/a")
    files.write(f"{folder}/a/x", b"abc")
    files.rename(f"{folder}/a/x", f"{folder}/a/y")
    registry = DatasetRegistry(folder)
    registry.add("n", "/n")
    return _checks(
        spark,
        {
            "caller_wins": merge_properties({"a": "1"}, {"a": "2"}) == {"a": "2"},
            "required_property": _raises(ValueError, lambda: check_properties({}, {"queue": REQUIRED})),
            "forbidden_property": _raises(ValueError, lambda: check_properties({"queue": "default"}, {"queue": "default"})),
            "job_names": job_name("flow", 1, 2, ["/a/b", "/a/c"], ["/d"]) == "flow [(1/2) b, c] -> d" and leaf("/data/in/2020") == "in/2020",
            "checkpoint_names": _raises(ValueError, lambda: checked_name("a b")),
            "steps_resume": steps[0] == steps[1] and len(built) == 1,
            "functions_are_checked": _raises(TypeError, lambda: check_serialises(lambda x, s=spark.sparkContext: s)),
            "recorder_is_told": failed and told == [("regions", True), ("bad", False)],
            "files": files.read(f"{folder}/a/y") == b"abc" and files.size(f"{folder}/a") == 3 and len(files.list(f"{folder}/a")) == 1,
            "trash_or_delete": files.delete(f"{folder}/a", use_trash=True) and files.delete(f"{folder}/a") and not files.exists(f"{folder}/a"),
            "registry_names": _raises(ValueError, lambda: registry.add("n", "/m")),
            "formats": _raises(NotImplementedError, lambda: Dataset("x", folder, "/x", format="sequence")),
        },
    )


# Hash functions, bytes, examples


_HASH_CHECKS = ("members_are_found", "most_strangers_are_not", "functions_must_agree", "function_is_stored", "unknown_is_refused", "name_is_given_once")


@query("hash_functions", _checks_sql(*_HASH_CHECKS))
def hash_functions(spark: SparkSession, d: str) -> DataFrame:
    """Filters of the orders' even keys by another hash function than the usual one."""
    keys = table(spark, d, "orders").select("o_orderkey")
    even, odd = keys.filter("o_orderkey % 2 = 0"), keys.filter("o_orderkey % 2 = 1")
    settings = BloomSettings(function=MURMUR3)
    built = build_bloom(even, "o_orderkey", settings)
    passing = odd.filter(might_contain(odd, "o_orderkey", built)).count()
    other = BloomFilter(built.num_bits, built.num_hashes)
    return _checks(
        spark,
        {
            "members_are_found": semi_filter(keys, "o_orderkey", even, "o_orderkey", exact=False, bloom=settings).filter("o_orderkey % 2 = 0").count() == even.count(),
            "most_strangers_are_not": passing <= 0.1 * odd.count(),
            "functions_must_agree": _raises(ValueError, lambda: built.union(other)),
            "function_is_stored": BloomFilter.from_bytes(built.to_bytes()).function is MURMUR3 and BloomFilter.from_bytes(other.to_bytes()).function is XXHASH64,
            "unknown_is_refused": _raises(ValueError, lambda: hash_function("md5")),
            "name_is_given_once": _raises(ValueError, lambda: register_hash(HashFunction("murmur3", lambda keys, seed: F.xxhash64(*keys)))),
        },
    )


@query("row_bytes", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def row_bytes_query(spark: SparkSession, d: str) -> DataFrame:
    """Orders as bytes and back."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return orders.select(row_bytes(orders.columns).alias("data")).select(row_from_bytes("data", orders.schema).alias("r")).select("r.*")


_BYTES = "(SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey * 7 % 256 END AS k FROM customer)"


@query("byte_compare", f"SELECT c_custkey, CAST(CASE WHEN k IS NULL OR k < 128 THEN -1 WHEN k = 128 THEN 0 ELSE 1 END AS INTEGER) AS against FROM {_BYTES}")
def byte_compare(spark: SparkSession, d: str) -> DataFrame:
    """A byte of each customer's key against 0x80, the lowest one that is negative if signed."""
    return _bytes(spark, d).select("c_custkey", compare_bytes("k", F.unhex(F.lit("80"))).alias("against"))


@query("byte_order", f"SELECT printf('%02X', k) AS k, c_custkey FROM {_BYTES} WHERE k >= 126 ORDER BY k, c_custkey LIMIT 20")
def byte_order(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 customers in byte order from 0x7E on (a top-k report), which reach 0x80 and more."""
    return in_byte_order(_bytes(spark, d).filter(compare_bytes("k", F.unhex(F.lit("7e"))) >= 0), "k", "c_custkey").limit(20).select(F.hex("k").alias("k"), "c_custkey")


def _bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.unhex(F.lpad(F.hex(F.col("c_custkey") * 7 % 256), 2, "0"))).alias("k"))


_EXAMPLES = ("bloom_join_rows", "counted_steps_report", "own_settings_apply")


@query("examples", _checks_sql(*_EXAMPLES))
def examples(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark)
    joined = bloom_join.run(spark, f"{folder}/joined")
    steps = counted_steps.run(spark, f"{folder}/counted")
    return _checks(
        spark,
        {
            "bloom_join_rows": sorted((r.name, r.place) for r in joined.collect()) == [("ada", "harbour"), ("ada", "museum"), ("cleo", "tower")],
            "counted_steps_report": "known - Removed records" in steps and spark.read.parquet(f"{folder}/counted").count() == 2,
            "own_settings_apply": own_settings.PROPERTIES["spark.sql.shuffle.partitions"] == "4" and _raises(ValueError, lambda: check_properties({}, own_settings.RULES)),
        },
    )
