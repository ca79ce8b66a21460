import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import (
    AggregationSpec,
    BitSet,
    BloomFilter,
    Counters,
    average,
    batch_map,
    build_bloom,
    combine,
    combine_final,
    combine_final_ordered,
    combine_partial,
    combine_partial_bounded,
    count_rows,
    key_join,
    limit_join,
    might_contain,
    multi_aggregate,
    multi_aggregate_tails,
    multi_group,
    multi_group_apply,
    rename_in_place,
    semi_filter,
    total,
    transformed,
)
from millrace.functions.binary import compare_bytes, row_bytes, row_from_bytes
from millrace.functions.hashing import HashFunction, false_positive_rate, name_id, optimal_hashes
from millrace.operators.bloom import BloomSettings
from millrace.operators.combine import EvictionError
from millrace.operators.metrics import report


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def bloom_sides(spark):
    left = [("1", "11", "w-lhs"), ("2", "12", "x-lhs"), *[(str(i), str(i + 10), "y-lhs") for i in range(4, 22)]]
    right = [("1", "11", "a"), ("1", "11", "b"), ("2", "12", "c"), ("3", "13", "d")]
    return spark.createDataFrame(left, "key string, key2 string, lhs_value string"), spark.createDataFrame(right, "key string, key2 string, rhs_value string")


def test_semi_filters(bloom_sides):
    a, b = bloom_sides
    assert [r[2] for r in rows(semi_filter(a, ["key", "key2"], b, ["key", "key2"]))] == ["w-lhs", "x-lhs"]
    loose = rows(semi_filter(a, "key", b, "key", exact=False, bloom=BloomSettings(num_bits=10)))
    assert {"w-lhs", "x-lhs"} <= {r[2] for r in loose} and len(loose) > 2


@pytest.mark.parametrize("bloom", [None, BloomSettings(num_bits=10)])
@pytest.mark.parametrize(
    "how,order,n,first", [("inner", "large_first", 3, "key"), ("inner", "small_first", 3, "key"), ("keep_small", "small_first", 4, "key"), ("keep_small", "large_first", 4, "key"), ("keep_large", "large_first", 21, "key"), ("full", "large_first", 22, "key")]
)
def test_joins(bloom_sides, how, order, n, first, bloom):
    a, b = bloom_sides
    out = key_join(a, ["key", "key2"], b, ["key", "key2"], how=how, order=order, bloom=bloom)
    assert out.count() == n
    assert out.columns[2] == ("lhs_value" if order == "large_first" else "rhs_value")


def test_chained_joins(bloom_sides):
    a, b = bloom_sides
    one = key_join(a, ["key", "key2"], b, ["key", "key2"], rename=["key", "k2", "l", "rk", "rk2", "r"])
    assert key_join(one, "key", one.toDF(*[f"{c}_2" for c in one.columns]), "key_2").count() == 5


def test_null_keys(spark):
    a, b = spark.createDataFrame([(1,), (None,)], "k int"), spark.createDataFrame([(1,), (None,)], "j bigint")
    assert key_join(a, "k", b, "j").count() == 1
    assert key_join(a, "k", b, "j", null_safe=True).count() == 2
    assert semi_filter(a, "k", b, "j", exact=False).count() == 1
    with pytest.raises(TypeError):
        semi_filter(a, "k", b.selectExpr("cast(j as string) j"), "j", exact=False)


def test_limit_join(spark):
    a = spark.createDataFrame([("1", x) for x in "ABC"] + [("2", x) for x in "DHI"], "a string, b string")
    b = spark.createDataFrame([("1", "E"), ("2", "F"), ("2", "G")], "c string, d string")
    assert rows(limit_join(a, "a", b, "c", (2, 1), ["b"], ["d"])) == [("1", "A", "1", "E"), ("1", "B", "1", "E"), ("2", "D", "2", "F"), ("2", "H", "2", "F")]


@pytest.fixture(scope="module")
def groups(spark):
    one = spark.createDataFrame([(1, 1), (1, 3), (1, 2), (2, 5), (3, 3), (3, 3)], "key int, num int")
    two = spark.createDataFrame([(1, 101, 1), (5, 5, 2), (3, 0, 0)], "key int, num1 int, num2 int")
    return one, two


def test_multi_group(groups):
    want = [(1, 108), (2, 5), (3, 6), (5, 7)]
    native = multi_group(groups, ["key", "key"], {"s": lambda a, b: F.coalesce(F.sum(a("num")), F.lit(0)) + F.coalesce(F.sum(b("num1") + b("num2")), F.lit(0))})
    assert rows(native) == want
    custom = multi_group_apply(groups, ["key", "key"], lambda _, p: pd.DataFrame({"s": [int(p[0]["num"].sum() + p[1]["num1"].sum() + p[1]["num2"].sum())]}), "s bigint")
    assert rows(custom) == want


def test_multi_group_apply_goes_by_batches(spark):
    """Many keys a batch and keys of many batches; what a frame holds is what its own rows have."""
    big = 2**53 + 1
    one = spark.createDataFrame([(1.0, big, True, "x"), (1.0, None, None, None), (2.0, big, False, "y"), (None, big, True, None), *[(5.0, i, True, "z") for i in range(10)]], "k double, n bigint, b boolean, s string")
    two = spark.createDataFrame([(float("nan"), 1), (float("nan"), 2), (2.0, 3), (-0.0, 4), (0.0, 5), (7.0, 0)], "j double, m int")

    def buffer(key, parts):
        a, b = parts
        assert list(a.columns) == ["k", "n", "b", "s"] and list(b.columns) == ["j", "m"] and list(a.index) == list(range(len(a))) and len(key) == 1
        kinds = f"{a['n'].dtype} {a['b'].dtype} {b['m'].dtype}"
        n = int(a["n"].max()) if len(a) else None
        out = pd.DataFrame({"size": [len(a), len(b)], "kinds": kinds, "n": [n, n]})[["n", "size", "kinds"]]
        return out.iloc[:0] if key[0] == 7 else out

    plain = "int64 bool int32"
    want = [(-0.0, None, 0, plain), (-0.0, None, 2, plain), (1.0, 2**53, 0, "float64 object int32"), (1.0, 2**53, 2, "float64 object int32"), (2.0, big, 1, plain), (2.0, big, 1, plain)]
    want += [(5.0, 9, 0, plain), (5.0, 9, 10, plain), (None, big, 0, plain), (None, big, 1, plain), (float("nan"), None, 0, plain), (float("nan"), None, 2, plain)]
    try:
        for most in ("3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            out = multi_group_apply([one, two], ["k", "j"], buffer, "n bigint, size int, kinds string").select(F.col("k") + 0.0, "n", "size", "kinds")
            assert repr(rows(out)) == repr(sorted(((k if k is None else k + 0.0, *r) for k, *r in want), key=repr))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        multi_group_apply([one, two], ["k", "j"], buffer, "k int")
    assert multi_group_apply([one, two], ["k", "j"], lambda *_: pd.DataFrame(), "y int").count() == 0
    with pytest.raises(Exception, match="a buffer returned the columns"):
        multi_group_apply([one, two], ["k", "j"], lambda *_: pd.DataFrame({"x": [1]}), "y int").collect()


def test_multi_group_apply_of_lists(spark):
    """Lists, whose nulls pandas mixes within a batch, go key by key."""
    one = spark.createDataFrame([(1, [1, 2]), (2, [3, None])], "k int, a array<int>")
    out = multi_group_apply([one, one], ["k", "k"], lambda _, p: pd.DataFrame({"n": [sum(len(x) for x in p[0]["a"])], "kind": [str(p[0]["a"][0].dtype)]}), "n int, kind string")
    assert rows(out) == [(1, 2, "int32"), (2, 2, "float64")]


def test_multi_group_apply_key_types(spark):
    one = spark.sql("SELECT * FROM VALUES (DATE'1600-01-01', 1.10BD, TIMESTAMP'2020-01-01 01:02:03.000004', X'00', true, 1S), (NULL, NULL, NULL, NULL, NULL, NULL) AS t(d, e, t, b, f, s)")
    out = multi_group_apply([one, one.filter("f")], [one.columns] * 2, lambda key, p: pd.DataFrame({"n": [len(p[0]) + len(p[1])], "nulls": [sum(bool(pd.isna(x)) for x in key)]}), "n int, nulls int")
    assert [f.dataType for f in out.schema][:6] == [f.dataType for f in one.schema]
    assert rows(out) == rows(one.withColumn("n", F.expr("if(f, 2, 1)")).withColumn("nulls", F.expr("if(f, 0, 6)")))


def test_combine_average(spark):
    df = spark.createDataFrame([("k0", 1), ("k0", 2), ("k1", 1), ("k1", 4), ("k1", 10)], "key string, value int")
    assert rows(combine(df, ["key"], [average("value")])) == [("k0", 3, 2, 1.5), ("k1", 15, 3, 5.0)]


def test_composite(spark):
    df = spark.createDataFrame([("k0", 1, 1), ("k0", 2, 5), ("k1", 1, 7), ("k1", -2, 10), ("k1", -2, -9)], "key string, a int, b int").withColumn("c", F.expr("a + b"))
    out = combine(df, ["key"], [total("a", "sa"), total("b", "sb"), transformed(total("c", "sc"), double=F.col("sc") * 2)])
    assert rows(out) == [("k0", 3, 6, 9, 18), ("k1", -3, 8, 5, 10)]


def bounded(df, **limits):
    return combine_partial_bounded(df, ["key"], ["value"], lambda: 0, lambda s, r: s + r[0], lambda s: (s,), "value bigint", **limits)


def test_bounded_partials(spark):
    df = spark.createDataFrame([("key0", 1), ("key0", 2), ("key1", 1), ("key1", -3), ("key0", 10)], "key string, value int").coalesce(1)
    want = [("key0", 10), ("key0", 3), ("key1", -2)]
    assert rows(bounded(df, item_limit=1)) == want
    assert rows(bounded(df, item_limit=0, memory_limit=100, size_of=lambda k, s: 60)) == want
    assert rows(bounded(df)) == [("key0", 13), ("key1", -2)]
    assert ("key0", 3) in rows(bounded(df, evict_when=lambda s: s == 3))
    with pytest.raises(Exception, match=EvictionError.__name__):
        bounded(df, item_limit=1, strict=True).collect()


def test_bounded_partials_keep_types(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(None, 1.5, big), (1, float("nan"), None), (1, float("nan"), big), (None, 1.5, big)], "key bigint, x double, value bigint").coalesce(1)
    got = combine_partial_bounded(df, ["key", "x"], ["value", "key"], list, lambda s, r: [*s, r[0]], lambda s: (len(s), s[-1]), "n int, last bigint").collect()
    assert sorted((r["key"] or 0, r["n"], r["last"]) for r in got) == [(0, 2, big), (1, 2, big)]


def test_ordered_merge(spark):
    data = [("b", 3, "z"), ("a", 2, "y"), ("a", 1, "x"), (None, 5, "n"), ("b", 1, None), ("a", 3, "w"), (None, 4, "m")]
    df = spark.createDataFrame(data, "key string, place int, value string").repartition(3)
    join = {"inputs": ["value"], "zero": str, "merge": lambda s, r: s + (r[0] or "-"), "emit": lambda s: (s,), "output": "joined string", "order_by": ["place"]}
    assert set(rows(combine_final_ordered(df, ["key"], **join))) == {("a", "xyw"), ("b", "-z"), (None, "mn")}
    assert rows(combine_final_ordered([df, df.limit(0)], [], **join | {"order_by": ["place", "value"]})) == [("-xywzmn",)]
    assert combine_final_ordered(df.limit(0), ["key"], **join).count() == 0
    counts = [count_rows("n"), average("place", "total", "m", "mean")]
    assert rows(combine_final(combine_partial(df.limit(0), [], counts), [], counts)) == [(0, None, 0, None)]


def test_multi_aggregate(spark):
    data = [("A", "D1", "day1")] * 3 + [("A", "D1", "day2"), ("A", "D2", "day2"), ("A", "D2", "day2"), ("A", "D2", "day1"), ("B", "D1", "day1"), ("B", "D1", "day2"), ("B", "D1", "day2"), ("C", "D2", "day2")]
    df = spark.createDataFrame([(*r, 1) for r in data], "partner string, destination string, date string, requests int")
    specs = [AggregationSpec(n, g, [total("requests", "r")]) for n, g in {"p": ["partner"], "pd": ["partner", "destination"], "pdd": ["partner", "destination", "date"], "t": ["date"], "d": ["destination"]}.items()]
    wide = multi_aggregate(df, specs)
    assert wide.count() == 18
    assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    tails = multi_aggregate_tails(df, specs)
    assert rows(tails["p"]) == [("A", 7), ("B", 3), ("C", 1)]
    assert rows(tails["t"]) == [("day1", 5), ("day2", 6)]
    assert rows(tails["pd"]) == [("A", "D1", 4), ("A", "D2", 3), ("B", "D1", 3), ("C", "D2", 1)]
    with pytest.raises(ValueError, match="same id"):
        multi_aggregate(df, [AggregationSpec("Aa", ["partner"], []), AggregationSpec("BB", ["date"], [])])
    with pytest.raises(ValueError):
        AggregationSpec("x", ["a"], [total("b", "a")])


def test_multi_aggregate_of_group_columns(spark):
    """A column is summed by one definition and grouped by in another; names of intermediates are group columns elsewhere."""
    df = spark.createDataFrame([(1, 2, "x"), (1, 3, "x"), (2, 5, None), (None, 7, None)], "a int, count int, c string")
    specs = [AggregationSpec("s", ["c"], [total("a", "sa")]), AggregationSpec("t", ["a"], [average("count", "s", "n", "mean")]), AggregationSpec("u", ["count"], [count_rows("k")]), AggregationSpec("w", [], [total("a", "all"), average("a", "s", "n", "mean")])]
    for first in (False, True):
        got = {name: rows(tail) for name, tail in multi_aggregate_tails(df, specs[:2] + specs[3:], reduce_first=first).items()}
        assert got == {"s": [("x", 2), (None, 2)], "t": [(1, 5, 2, 2.5), (2, 5, 1, 5.0), (None, 7, 1, 7.0)], "w": [(4, 4, 3, 4 / 3)]}
        assert rows(multi_aggregate_tails(df, specs[2:3], reduce_first=first)["u"]) == [(2, 1), (3, 1), (5, 1), (7, 1)]
    assert rows(multi_aggregate(df, specs[3:]).select("all", "n")) == [(4, 3)]
    assert multi_aggregate(df.limit(0), specs[:2]).count() == 0


def test_useless_and_large_filters(spark):
    a, b = spark.range(1000).withColumnRenamed("id", "k"), spark.range(0, 1000, 2).withColumnRenamed("id", "j")
    small = BloomSettings(max_bits=64, force=False)
    assert semi_filter(a, "k", b, "j", exact=False, bloom=small).count() == 1000
    assert "might_contain" not in key_join(a, "k", b, "j", bloom=BloomSettings())._jdf.queryExecution().toString()
    forced = key_join(a, "k", b, "j", bloom=BloomSettings(force=True))
    assert "might_contain" in forced._jdf.queryExecution().toString() and forced.count() == 500
    assert semi_filter(a, "k", b.limit(0), "j", exact=False).count() == 0
    with pytest.raises(ValueError):
        BloomSettings(num_bits=1 << 30)
    c, e = (spark.range(5).select(F.col("id").cast(t).alias("k")) for t in ("decimal(10,2)", "decimal(12,4)"))
    assert semi_filter(c, "k", e, "k", exact=False).count() == 5 and key_join(c, "k", e, "k", bloom=BloomSettings(force=True)).count() == 5


def test_name_id():
    assert name_id("") == 0 and name_id("Aa") == name_id("BB") == 2112 and name_id("polygenelubricants") == -(2**31)


def test_bloom(spark):
    assert round(false_positive_rate(3, 100, 20), 3) == 0.092 and round(false_positive_rate(2, 100, 50), 3) == 0.400
    assert optimal_hashes(100, 10, 1, 6)[1] == 6
    keys = spark.createDataFrame([("1",), ("2",), ("red",), ("blue",)], "key string")
    built = build_bloom(keys, "key")
    probe = spark.createDataFrame([(x,) for x in ("1", "2", "red", "blue", "3", "4", "green", "yellow", None)], "key string")
    kept = {r[0] for r in probe.filter(might_contain(probe, "key", built)).collect()}
    assert {"1", "2", "red", "blue"} <= kept and len(kept) < 8
    again = BloomFilter.from_bytes(built.to_bytes())
    assert again.bits == built.bits and again.num_hashes == built.num_hashes
    a, b = BloomFilter(64, 1), BloomFilter(64, 1)
    a.add_indices([3])
    b.add_indices([9])
    assert a.union(b).test_indices([3]) and a.union(b).num_keys == 2 and not a.intersection(b).test_indices([3])
    with pytest.raises(ValueError):
        a.union(BloomFilter(32, 1))


def test_filters_of_different_tables_merge(spark):
    """One size, tables of 20 and of 2,000 keys: the best number of hashes differs."""
    keys = spark.range(2010).withColumnRenamed("id", "k")
    few, many = (build_bloom(keys.filter(f), "k", BloomSettings(num_bits=4096)) for f in ("k < 20", "k >= 10"))
    assert (few.num_hashes, many.num_hashes) == (4, 1)
    for a, b in ((few, many), (many, few)):
        both = BloomFilter.from_bytes(a.union(b).to_bytes())
        assert keys.filter(might_contain(keys, "k", both)).count() == 2010
        common = keys.filter(might_contain(keys, "k", a.intersection(b)))
        assert common.filter("k >= 10 AND k < 20").count() == 10 and common.count() < 200
    strangers = spark.range(10_000, 20_000).withColumnRenamed("id", "k")
    assert abs(strangers.filter(might_contain(strangers, "k", both)).count() / 10_000 - both.false_positive_rate()) < 0.02
    a, b = BloomFilter(64, 2), BloomFilter(64, 1)
    a.add_indices([3, 7])
    b.add_indices([9])
    assert a.union(b).test_indices([3]) and a.union(b).test_indices([9, 40]) and not a.union(b).test_indices([4, 7]) and a.union(b).false_positive_rate() == 3 / 64
    with pytest.raises(ValueError):
        a.test_indices([3])


def test_bitset():
    b = BitSet(11)
    b.set(3)
    b.set(10)
    assert b.get(3) and not b.get(4) and b.count() == 2
    b.unset(4)
    b.unset(3)
    assert not b.get(3) and not b.get(4)
    b.fill()
    assert b.count() == 11
    b.flip()
    assert b.count() == 0
    with pytest.raises(IndexError):
        b.get(11)


def test_counters(spark):
    c = Counters()
    df = spark.createDataFrame([(1,), (2,), (None,)], "field int")
    df = c.increment(df, "before")
    df = c.stats_filter(df, F.col("field").isNotNull(), ("t", "1"))
    c.increment(df, "after").collect()
    assert (c.get("before"), c.get("after"), c.get("1 - Removed records", "t")) == (3, 2, 1)
    c = Counters()
    df = c.increment_for_values(spark.createDataFrame([(1, 1), (1, 2), (1, 1), (None, 2)], "key int, value int"), {"key": None, "value": 2}, "n")
    c.sum_of(df, "value", "s").collect()
    assert (c.get("n"), c.get("s")) == (1, 6)
    c = Counters()
    df = spark.createDataFrame([(1,), (2,), (1,)], "field int")
    c.stats_groups(df, ["field"], lambda x: x.distinct().select(F.explode(F.array("field", "field"))), ("t", "b")).collect()
    assert (c.get("b - Input groups", "t"), c.get("b - Output records", "t")) == (2, 4)
    assert "BLACK HOLE" in report({"g": {"Tuples Read": 5}}) and "BLACK HOLE" not in report({"g": {"Tuples Read": 5, "Tuples Written": 1}})


def test_row_operators(spark):
    df = spark.createDataFrame([(x,) for x in "123456"], "x string").coalesce(1)
    assert [r[0] for r in batch_map(df, "x", lambda v: [f"{i}-{len(v)}" for i in v], "out", "string", 4).collect()] == ["1-4", "2-4", "3-4", "4-4", "5-2", "6-2"]
    assert rename_in_place(spark.createDataFrame([(3, 4)], "key int, num int"), ["key", "num"], "key", "key2").columns == ["key2", "num"]


def test_rows_as_bytes(spark):
    df = spark.sql("SELECT 1 AS `a.b`, 0.1D AS x, CAST(NULL AS STRING) AS s, TIMESTAMP'2020-02-29 01:02:03.000004' AS t, X'00ff' AS b, 1.10BD AS d, array(named_struct('k', 1L)) AS n UNION ALL SELECT NULL, double('NaN'), '', NULL, X'', -1.25BD, NULL")
    back = df.select(row_bytes(df.columns).alias("data")).select(row_from_bytes("data", df.schema).alias("r")).select("r.*")
    assert repr(rows(back)) == repr(rows(df))
    assert df.select(row_bytes([]).alias("e")).first().e == b"{}"
    with pytest.raises(Exception, match="MALFORMED"):
        spark.sql("SELECT X'7b' AS data").select(row_from_bytes("data", df.schema)).collect()


def test_bytes_compare(spark):
    df = spark.sql("SELECT * FROM VALUES (X'01', X'0100', -1), (X'80', X'7f', 1), (X'', X'', 0), (NULL, X'', -1), (X'', NULL, 1), (NULL, NULL, 0) AS t(a, b, want)")
    assert df.filter(compare_bytes("a", "b") != F.col("want")).count() == 0


def test_hash_function_names():
    for name in ("", "x" * 17):
        with pytest.raises(ValueError):
            HashFunction(name, lambda keys, seed: F.xxhash64(*keys))
    with pytest.raises(ValueError):
        BloomFilter.from_bytes(b"MRBF")
