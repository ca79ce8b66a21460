import random

import pytest

from millrace.plans.naming import checked_name, job_name, leaf
from millrace.plans.runner import NoRecorder, Runner, check_serialises
from millrace.session import REQUIRED, check_properties, merge_properties
from millrace.operators.aggregates import count_rows
from millrace.operators.combine import combine_final
from millrace.operators.metrics import Counters
from millrace.sources.datasets import DatasetRegistry, batched_reads
from millrace.sources.files import Files
from millrace.sources.fixed_width import read_fixed_width, write_fixed_width
from millrace.sources.json_objects import JsonObjectWriter, entries_of, read_json, read_object, read_object_with, write_entries, write_json, write_object
from millrace.sources.sinks import NullSink
from millrace.streaming import partials_stream


def test_fixed_width(spark, tmp_path):
    good = tmp_path / "good.txt"
    good.write_text("012345\nabcdef\nFIRsTH\n")
    names = ["first", "second", "third"]
    assert [tuple(r) for r in read_fixed_width(spark, str(good), names, [3, 1, 2]).collect()] == [("012", "3", "45"), ("abc", "d", "ef"), ("FIR", "s", "TH")]
    bad = tmp_path / "bad.txt"
    bad.write_text("012345\nLengthy\nNormal\nShort\nNormal\nTiny\n")
    with pytest.raises(ValueError):
        read_fixed_width(spark, str(bad), names, [3, 1, 2])
    assert read_fixed_width(spark, str(bad), names, [3, 1, 2], strict=False).count() == 3
    for fields, widths in ((["a", "b"], [1]), (["a"], [0])):
        with pytest.raises(ValueError):
            read_fixed_width(spark, str(good), fields, widths)
    with pytest.raises(NotImplementedError):
        write_fixed_width()


def test_json(spark, tmp_path):
    path = str(tmp_path / "one.json")
    write_json(spark, path, {"key1": "ignore", "key2": {"deepKey1": 1, "deepKey2": 2}})
    assert read_json(spark, path)["key1"] == "ignore"
    assert sorted(map(tuple, read_object(spark, path, "bigint", ["key2"]).collect())) == [("deepKey1", 1), ("deepKey2", 2)]
    r = random.Random(1)
    for depth in (0, 3, 20):
        entries = {f"k{r.random()}": r.randrange(10**6) for _ in range(r.randrange(1, 300))}
        inside = [str(i) for i in range(depth)]
        packed = str(tmp_path / f"packed{depth}.json")
        write_entries(spark, packed, entries.items(), inside, compress=True)
        assert dict(map(tuple, read_object(spark, packed, "bigint", inside).collect())) == entries
    assert read_object_with(spark, path, lambda k, v: (k.upper(), v + 1), "k string, v bigint", ["key2"]).count() == 2
    df = spark.createDataFrame([(f'k"{i}', i) for i in range(50)], "k string, v int").repartition(3)
    write_object(df, "k", "v", str(tmp_path / "objects"), ["a"])
    assert sorted(map(tuple, read_object(spark, str(tmp_path / "objects") + "/part-*", "int", ["a"]).collect())) == sorted(map(tuple, df.collect()))


def test_entries_are_read_one_by_one():
    text = ' {"skip" : {"x":[1,{"y":2}]}, "in" : { "a" : 1 , "b":"}{\\"", "c": {"d": null}, "e":[ ] } , "later": 3} '
    assert [(k, t) for k, t, _ in entries_of(text, ["in"])] == [("a", "1"), ("b", '"}{\\""'), ("c", '{"d": null}'), ("e", "[ ]")]
    assert [k for k, _, _ in entries_of(text)] == ["skip", "in", "later"] and list(entries_of("{}")) == [] and list(entries_of('{"a":{}}', ["a"])) == []
    first = next(entries_of('{"a":1,"b":', []))
    assert first[0] == "a"
    for bad, inside in (("[1]", []), ('{"a":1', []), ('{"a":1}', ["a"]), ('{"a":1}', ["b"]), ("", []), ('{"a" 1}', [])):
        with pytest.raises(ValueError):
            list(entries_of(bad, inside))


def test_json_nulls_and_failures(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", [1, None]), ("c\"}", [])], "k string, v array<int>")
    write_object(df, "k", "v", str(tmp_path / "nulls"))
    assert sorted(map(tuple, read_object(spark, f"{tmp_path}/nulls/part-*", "array<int>").collect())) == [("a", None), ("b", [1, None]), ('c"}', [])]
    with pytest.raises(ValueError), JsonObjectWriter(spark, f"{tmp_path}/half.json") as out:
        out.write("a", 1)
        out.write(None, 2)
    assert [p.name for p in tmp_path.iterdir() if "half" in p.name and not p.name.endswith(".crc")] == []
    with JsonObjectWriter(spark, f"{tmp_path}/large.json", compress=True) as out:
        for i in range(200_000):
            out.write(f"key {i}", "x" * 10)
            assert out._size <= 1 << 21
    assert read_object(spark, f"{tmp_path}/large.json", "string").count() == 200_000


def test_datasets_and_files(spark, tmp_path):
    registry = DatasetRegistry(str(tmp_path))
    store = registry.add("numbers", "/numbers", "id bigint")
    with batched_reads(spark):
        store.write(spark.range(10))
        assert store.read(spark).count() == 10
    assert store.size(spark) > 0 and registry["numbers"].path.endswith("/numbers")
    with pytest.raises(NotImplementedError):
        registry.add("x", "/x", format="sequence")
    files = Files(spark)
    files.make_directory(f"{tmp_path}/a")
    files.write(f"{tmp_path}/a/x", b"abc")
    files.rename(f"{tmp_path}/a/x", f"{tmp_path}/a/y")
    assert files.read(f"{tmp_path}/a/y") == b"abc" and len(files.list(f"{tmp_path}/a")) == 1 and files.list(f"{tmp_path}/none") == []
    assert files.delete(f"{tmp_path}/a") and files.delete(f"{tmp_path}/a") and not files.exists(f"{tmp_path}/a")
    sink = NullSink()
    sink.write(spark.range(3))
    assert sink.read(spark).count() == 0 and sink.exists()


def test_session_properties():
    assert merge_properties({"a": "1", "b": "2"}, {"b": "3"}) == {"a": "1", "b": "3"}
    with pytest.raises(ValueError):
        check_properties({}, {"queue": REQUIRED})
    with pytest.raises(ValueError):
        check_properties({"queue": "default"}, {"queue": "default"})
    check_properties({"queue": "mine"}, {"queue": ["default", ""]})


def test_names():
    assert leaf("/data/in/2020") == "in/2020" and leaf("/data/out_1_" + "a" * 32) == "out"
    assert job_name("flow", 1, 2, ["/a/b", "/a/c"], ["/d"]) == "flow [(1/2) b, c] -> d"
    assert len(job_name("f", 1, 1, ["/x" + "y" * 300], ["/z" * 300])) <= 175
    with pytest.raises(ValueError):
        checked_name("a b")


def test_runner(spark):
    told = []

    class Recorder(NoRecorder):
        def on_finished(self, name, seconds, error):
            told.append((name, error is None))

    counters = Counters()
    df = counters.increment(spark.range(5), "n")
    result, text = Runner(spark, recorder=Recorder()).run("five", df.count, counters)
    assert result == 5 and "n: 5" in text
    with pytest.raises(ZeroDivisionError):
        Runner(spark, recorder=Recorder()).run("bad", lambda: 1 / 0)
    assert told == [("five", True), ("bad", False)]
    with pytest.raises(TypeError):
        check_serialises(lambda x, s=spark.sparkContext: s)


def test_streamed_partials(spark, tmp_path):
    spark.range(10).selectExpr("id % 2 as k").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k bigint").parquet(f"{tmp_path}/in")
    partials_stream(stream, ["k"], [count_rows("n")], f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted(map(tuple, combine_final(spark.read.parquet(f"{tmp_path}/out"), ["k"], [count_rows("n")]).collect())) == [(0, 5), (1, 5)]
