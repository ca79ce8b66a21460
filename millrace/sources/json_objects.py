"""Whole JSON files, and JSON objects of many entries read and written as (key, value) rows."""

from __future__ import annotations

import contextlib
import gzip
import itertools
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.files import Files

#: The first two bytes of gzip data.
GZIP_MAGIC = b"\x1f\x8b"


def unpacked(data: bytes) -> bytes:
    """Decompress what begins as gzip data does, whatever its file is called."""
    return gzip.decompress(data) if data[:2] == GZIP_MAGIC else data


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """One object as one small file."""
    Files(spark).write(path, json.dumps(value).encode())


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(unpacked(Files(spark).read(path)))


#: Bytes that a writer holds, and entries of one batch that a reader passes on.
HELD, BATCH = 1 << 20, 10_000


class JsonObjectWriter:
    """Writes entries of one (nested) object one by one, as they come; use it as a context manager.

    About a megabyte is held; after an error there is no file.  Keys are text:
    null is refused.
    """

    def __init__(self, spark: SparkSession, path: str, inside: Sequence[str] = (), compress: bool = False):
        self._open = contextlib.ExitStack()
        self._put = self._open.enter_context(Files(spark).writing(path))
        self._packer = zlib.compressobj(wbits=31) if compress else None
        self._depth, self._count, self._size = len(inside), 0, 0
        self._parts = ["{" + "".join(f"{json.dumps(p)}:{{" for p in inside)]

    def write(self, key: str, value: Any) -> None:
        if key is None:
            raise ValueError("a key must not be null")
        part = f"{',' if self._count else ''}{json.dumps(str(key))}:{json.dumps(value)}"
        self._parts.append(part)
        self._count += 1
        self._size += len(part)
        if self._size > HELD:
            self._flush()

    def _flush(self) -> None:
        data = "".join(self._parts).encode()
        if data := self._packer.compress(data) if self._packer else data:
            self._put(data)
        self._parts, self._size = [], 0

    def close(self) -> None:
        self._parts.append("}" * (self._depth + 1))
        self._flush()
        if self._packer:
            self._put(self._packer.flush())
        self._open.close()

    def __enter__(self) -> JsonObjectWriter:
        return self

    def __exit__(self, kind: object, error: object, trace: object) -> None:
        if kind is None:
            self.close()
        else:
            with contextlib.suppress(kind):
                self._open.__exit__(kind, error, trace)


def write_entries(spark: SparkSession, path: str, entries: Iterable[tuple[str, Any]], inside: Sequence[str] = (), compress: bool = False) -> None:
    """Local (key, value) pairs as one nested object, e.g. ``{"a":{"b":{key:value,...}}}`` inside ``("a", "b")``."""
    with JsonObjectWriter(spark, path, inside, compress) as out:
        for k, v in entries:
            out.write(k, v)


def write_object(df: DataFrame, key: str, value: str, path: str, inside: Sequence[str] = (), compress: bool = False) -> None:
    """A DataFrame's (key, value) rows as nested objects, one file per partition.

    Every file is an object of its own; :func:`read_object` reads a folder of
    them as it reads one.  Nothing is gathered: partitions are as large as the
    caller makes them.  A null key is refused, a null value is written as null.
    """
    head = "{" + "".join(f"{json.dumps(p)}:{{" for p in inside)
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.raise_error(F.lit("a key must not be null")).cast("string"))
    # to_json writes arrays: the brackets go.
    bare = [F.to_json(F.array(c), {"ignoreNullFields": "false"}) for c in (name, F.col(f"`{value}`"))]
    key_text, value_text = (F.substring(c, F.lit(2), F.length(c) - 2) for c in bare)
    entries = df.select(F.concat(key_text, F.lit(":"), value_text).alias("entry"))

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"value": [(head if first else ",") + ",".join(frame["entry"])]})
                first = False
        if not first:
            yield pd.DataFrame({"value": ["}" * (len(inside) + 1)]})

    lines = entries.mapInPandas(join, "value string")
    lines.write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


_BLANK = re.compile(r"[ \t\n\r]*")
_DECODER = json.JSONDecoder()


def entries_of(text: str, inside: Sequence[str] = ()) -> Iterator[tuple[str, str, Any]]:
    """(key, value as text, value) of the object inside ``inside``, one at a time; only one value exists at once."""

    def mark(at: int, sign: str) -> int:
        at = _BLANK.match(text, at).end()
        if text[at : at + 1] not in sign or at >= len(text):
            raise ValueError(f"{sign} is missing at {at}")
        return at

    at, steps = 0, list(inside)
    while True:
        start = _BLANK.match(text, at).end()
        if text[start : start + 1] != "{":
            raise ValueError(f"no object at {list(inside)}")
        at = mark(at, "{") + 1
        if text[mark(at, '"}')] == "}":
            if steps:
                raise ValueError(f"no object at {list(inside)}")
            return
        while True:
            name, at = _DECODER.raw_decode(text, mark(at, '"'))
            at = _BLANK.match(text, mark(at, ":") + 1).end()
            if steps and name == steps[0]:
                steps.pop(0)
                break
            value, end = _DECODER.raw_decode(text, at)
            if not steps:
                yield name, text[at:end], value
            at = mark(end, ",}")
            if text[at] == "}":
                if steps:
                    raise ValueError(f"no object at {list(inside)}")
                return
            at += 1


def _texts(content: bytes) -> str:
    return unpacked(bytes(content)).decode()


def read_object(spark: SparkSession, path: str, value_type: str, inside: Sequence[str] = ()) -> DataFrame:
    """The entries of the object found inside ``inside``, as (key string, value ``value_type``) rows.

    Gzip is told by the data's first bytes, not by the name.  A file is one
    task's work, entry by entry; a folder's files are read in parallel.  A key
    that a file has twice gives two rows.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    steps = list(inside)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = entries_of(_texts(b.column(0)[i].as_py()), steps)
                while some := list(itertools.islice(found, BATCH)):
                    keys, values, _ = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], names=["key", "value"])

    # A value is parsed inside an array, as bare scalars are no JSON documents to Spark.
    parsed = F.get(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<{value_type}>"), F.lit(0))
    return files.mapInArrow(texts, "key string, value string").select("key", parsed.alias("value"))


def read_object_column(df: DataFrame, column: str, value_type: str, inside: Sequence[str] = ()) -> DataFrame:
    """The same for small objects in a string column: all other columns, then key and value.

    Spark's own parser reads them.  Null, text that is no object and objects
    without the path have no entries; a key must not come twice.
    """
    kind = f"map<string,{value_type}>"
    for step in reversed(inside):
        kind = f"struct<`{step}`:{kind}>"
    found = F.from_json(F.col(f"`{column}`"), kind)
    for step in inside:
        found = found.getField(step)
    others = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*others, F.explode(found).alias("key", "value"))


def read_object_with(spark: SparkSession, path: str, read: Callable[[str, Any], tuple], output: str, inside: Sequence[str] = ()) -> DataFrame:
    """The same entries, each turned into one row by the caller's ``read(key, value)``, one at a time."""
    files = spark.read.format("binaryFile").load(path).select("content")
    steps = list(inside)
    names = T.StructType.fromDDL(output).names

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x in frame["content"]:
                made = (read(k, v) for k, _, v in entries_of(_texts(x), steps))
                while some := list(itertools.islice(made, BATCH)):
                    yield pd.DataFrame(some, columns=names)

    return files.mapInPandas(rows, output)
