"""Byte-level BPE with a local rank file: encoding to ids and decoding to the exact bytes."""

from __future__ import annotations

import array
import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import add_columns

#: Texts of more characters are encoded in parts.
LONG = 1 << 16
#: Where no match of the usual byte-level patterns can span: between a character that surely
#: isn't white space and a space or newline, and between an ASCII letter and a digit.
_SAFE = re.compile(r"(?<=[!-~¡-ɏͰ-ᙿᚁ-῿ぁ-﫿])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def safe_parts(text: str, limit: int = LONG) -> Iterator[str]:
    """The text in parts of about ``limit`` characters, cut only where encoding is unaffected.

    Text without such a place stays whole, as one part.
    """
    start = 0
    while len(text) - start > limit and (cut := _SAFE.search(text, start + limit)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def encode(docs: DataFrame, text: str, rank_file: str, pattern: str, ids: str = "ids", count: str = "n_tokens", limit: int = LONG) -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit) and their ``count``.

    Special tokens' strings are ordinary text.  Null and empty texts give no
    ids.  Rows stay as they are; columns of these names are replaced.  The rank
    file is read once per task from its local path.
    """

    def start() -> Callable[..., list]:
        import tiktoken

        one = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=read_ranks(rank_file), special_tokens={}).encode_ordinary

        def run(texts: pa.Array) -> list:
            out = []
            for t in texts.to_pylist():
                if not t:
                    out.append(b"")
                elif len(t) <= limit:
                    out.append(array.array("I", one(t)).tobytes())
                else:
                    out.append(b"".join(array.array("I", one(p)).tobytes() for p in safe_parts(t, limit)))
            return [pa.array(out, pa.binary()), pa.array([len(x) >> 2 for x in out], pa.int64())]

        return run

    return add_columns(docs, [F.col(text)], f"`{ids}` binary, `{count}` bigint", start)


def decode(df: DataFrame, ids: str, rank_file: str, out: str = "decoded") -> DataFrame:
    """Add the bytes (binary) that the ids of :func:`encode` stand for; they need not be valid UTF-8.

    Null ids give null.  An id without a rank raises.
    """

    def start() -> Callable[..., list]:
        ranks = sorted((v, k) for k, v in read_ranks(rank_file).items())
        size = ranks[-1][0] + 1
        lengths = np.zeros(size, np.int64)
        lengths[[v for v, _ in ranks]] = [len(k) for _, k in ranks]
        starts = np.zeros(size, np.int64)
        starts[[v for v, _ in ranks]] = np.cumsum([0, *[len(k) for _, k in ranks]])[:-1]
        blob = np.frombuffer(b"".join(k for _, k in ranks), np.uint8)

        def one(x: bytes | None) -> bytes | None:
            if not x:
                return x
            i = np.frombuffer(x, "<u4")
            if i.max() >= size or not (n := lengths[i]).all():
                raise ValueError("an id has no rank")
            ends = np.cumsum(n)
            return blob[np.repeat(starts[i] - ends + n, n) + np.arange(ends[-1])].tobytes()

        return lambda x: [pa.array([one(v) for v in x.to_pylist()], pa.binary())]

    return add_columns(df, [F.col(ids)], f"`{out}` binary", start)
