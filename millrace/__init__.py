"""Spark-native batch dataflow operators over DataFrames.

Every operator is a plain function ``DataFrame(s) -> DataFrame`` (or a dict of
DataFrames where one pass feeds several outputs).  Nothing here schedules work:
plans are declared with the DataFrame API, and Catalyst, AQE and Tungsten decide
how they run.
"""

from millrace.operators.aggregates import (
    Aggregate,
    approx_distinct,
    average,
    count_rows,
    distinct_sketch,
    maximum,
    minimum,
    quantile_sketch,
    total,
    transformed,
)
from millrace.operators.bloom import BitSet, BloomFilter, build_bloom, might_contain
from millrace.operators.cogroup import multi_group, multi_group_apply
from millrace.operators.combine import (
    AggregationSpec,
    combine,
    combine_final,
    combine_final_ordered,
    combine_partial,
    combine_partial_bounded,
    multi_aggregate,
    multi_aggregate_tails,
)
from millrace.operators.joins import key_join, limit_join, semi_filter
from millrace.operators.metrics import Counters
from millrace.operators.rows import append_nulls, batch_map, emit_wide, key_hash, remove_where, rename_in_place
from millrace.session import build_session

__all__ = [
    "Aggregate",
    "AggregationSpec",
    "BitSet",
    "BloomFilter",
    "Counters",
    "append_nulls",
    "approx_distinct",
    "average",
    "batch_map",
    "build_bloom",
    "build_session",
    "combine",
    "combine_final",
    "combine_final_ordered",
    "combine_partial",
    "combine_partial_bounded",
    "count_rows",
    "distinct_sketch",
    "emit_wide",
    "key_hash",
    "key_join",
    "limit_join",
    "maximum",
    "might_contain",
    "minimum",
    "multi_aggregate",
    "multi_aggregate_tails",
    "multi_group",
    "multi_group_apply",
    "quantile_sketch",
    "remove_where",
    "rename_in_place",
    "semi_filter",
    "total",
    "transformed",
]
