"""Bloom filters: sizing, distributed building, membership, set operations, storage."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import XXHASH64, HashFunction, bit_index, bits_for, false_positive_rate, hash_function, key_columns, optimal_hashes

#: Most bits that one bitset can have: 8 per byte of the largest array.
MAX_BITS = 8 * (2**31 - 1)
#: Bits of one row of a bitmap aggregate.
_BUCKET = 32768


@dataclass(frozen=True)
class BloomSettings:
    """How large a filter may get and how many hashes it may use.

    ``num_bits`` fixes the size; else it follows from the approximate number of
    distinct keys and ``rate``, up to ``max_bits`` (8 MiB by default, as the
    filter is broadcast).  The number of hashes is the best for that size.  A
    join leaves a filter out that can't pay: where Spark broadcasts the small
    side, so that the large one isn't shuffled, and where more than ``useless``
    of the strangers would pass; ``force`` keeps it.  ``function`` is the hash
    function; one of the caller's own must be registered.
    """

    num_bits: int | None = None
    rate: float = 0.03
    max_bits: int = 67_108_864
    min_hashes: int = 1
    max_hashes: int = 4
    count_error: float = 0.01
    useless: float = 0.5
    force: bool = False
    function: HashFunction = XXHASH64

    def __post_init__(self) -> None:
        if self.num_bits is not None and not 0 < self.num_bits <= self.max_bits:
            raise ValueError(f"a filter has 1 to {self.max_bits} bits, as it is broadcast; max_bits may be raised")


class BitSet:
    """A fixed number of bits, the lowest bit of a byte first."""

    def __init__(self, num_bits: int, data: bytes | None = None):
        if not 0 < num_bits <= MAX_BITS:
            raise ValueError(f"a bitset has 1 to {MAX_BITS} bits")
        size = (num_bits + 7) // 8
        if data is not None and len(data) != size:
            raise ValueError(f"{num_bits} bits take {size} bytes, not {len(data)}")
        self.num_bits = num_bits
        self._bytes = np.frombuffer(data, np.uint8).copy() if data is not None else np.zeros(size, np.uint8)

    def _check(self, i: int) -> tuple[int, int]:
        if not 0 <= i < self.num_bits:
            raise IndexError(i)
        return i >> 3, 1 << (i & 7)

    def get(self, i: int) -> bool:
        at, bit = self._check(i)
        return bool(self._bytes[at] & bit)

    def set(self, i: int) -> None:
        at, bit = self._check(i)
        self._bytes[at] |= bit

    def unset(self, i: int) -> None:
        at, bit = self._check(i)
        self._bytes[at] &= ~bit & 0xFF

    def clear(self) -> None:
        self._bytes[:] = 0

    def fill(self) -> None:
        self._bytes[:] = 255
        self._trim()

    def flip(self) -> None:
        self._bytes ^= 255
        self._trim()

    def _trim(self) -> None:
        if tail := self.num_bits & 7:
            self._bytes[-1] &= (1 << tail) - 1

    def _same(self, other: BitSet) -> None:
        if other.num_bits != self.num_bits:
            raise ValueError("bitsets differ in size")

    def or_(self, other: BitSet) -> None:
        self._same(other)
        self._bytes |= other._bytes

    def and_(self, other: BitSet) -> None:
        self._same(other)
        self._bytes &= other._bytes

    def xor(self, other: BitSet) -> None:
        self._same(other)
        self._bytes ^= other._bytes

    def get_many(self, at: np.ndarray) -> np.ndarray:
        return (self._bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def count(self) -> int:
        return int(np.bitwise_count(self._bytes).sum())

    def to_bytes(self) -> bytes:
        return self._bytes.tobytes()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, BitSet) and self.num_bits == other.num_bits and np.array_equal(self._bytes, other._bytes)

    __hash__ = None


class BloomFilter:
    """A filter over key tuples, filled from a DataFrame by :func:`build_bloom`.

    Bits are chosen by the hash function modulo ``num_bits``, which Spark
    computes; the object itself only holds, merges and stores them.  The i-th
    bit of a key doesn't depend on the number of hashes, so filters of one size
    and function merge whatever that number, which :func:`build_bloom` fits to
    the keys: the result tests as many hashes as both have.
    """

    _HEAD = struct.Struct("<4sIQQ16s")

    def __init__(self, num_bits: int, num_hashes: int, bits: BitSet | None = None, num_keys: int = 0, function: HashFunction = XXHASH64):
        if num_hashes < 1:
            raise ValueError("at least one hash is needed")
        self.num_bits, self.num_hashes, self.num_keys = num_bits, num_hashes, num_keys
        self.bits = bits or BitSet(num_bits)
        self.function = function

    def false_positive_rate(self) -> float:
        """By the number of keys, or by the bits set if those say more: keys put in with more hashes than are tested have set more bits."""
        return max(false_positive_rate(self.num_hashes, self.num_bits, self.num_keys), (self.bits.count() / self.num_bits) ** self.num_hashes)

    def add_indices(self, indices: Sequence[int]) -> None:
        """Add one key, given by the bits that its hashes choose."""
        if len(indices) != self.num_hashes:
            raise ValueError("as many indices as hashes are needed")
        for i in indices:
            self.bits.set(i)
        self.num_keys += 1

    def test_indices(self, indices: Sequence[int]) -> bool:
        """Whether the key may be in; of more indices than hashes the first ones count."""
        if len(indices) < self.num_hashes:
            raise ValueError("as many indices as hashes are needed")
        return all(self.bits.get(i) for i in indices[: self.num_hashes])

    def _merged(self, other: BloomFilter, merge: Callable[[BitSet, BitSet], None], num_keys: int) -> BloomFilter:
        if (other.num_bits, other.function.name) != (self.num_bits, self.function.name):
            raise ValueError("filters differ in size or hash function")
        bits = BitSet(self.num_bits, self.bits.to_bytes())
        merge(bits, other.bits)
        return BloomFilter(self.num_bits, min(self.num_hashes, other.num_hashes), bits, num_keys, self.function)

    def union(self, other: BloomFilter) -> BloomFilter:
        """Keys of either; their number is at most the sum."""
        return self._merged(other, BitSet.or_, self.num_keys + other.num_keys)

    def intersection(self, other: BloomFilter) -> BloomFilter:
        """Keys of both, and some more; their number is at most the smaller one."""
        return self._merged(other, BitSet.and_, min(self.num_keys, other.num_keys))

    def to_bytes(self) -> bytes:
        return self._HEAD.pack(b"MRB2", self.num_hashes, self.num_bits, self.num_keys, self.function.name.encode()) + self.bits.to_bytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BloomFilter:
        """The stored filter; its hash function must be known here."""
        if data[:4] != b"MRB2" or len(data) < cls._HEAD.size:
            raise ValueError("not a stored Bloom filter")
        _, hashes, bits, keys, name = cls._HEAD.unpack_from(data)
        return cls(bits, hashes, BitSet(bits, data[cls._HEAD.size :]), keys, hash_function(name.rstrip(b"\0").decode()))


def approximate_count(hashes: Column, error: float) -> Column:
    """About how many different 64-bit hashes there are, to a relative standard error; a sketch whose size the error bounds."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(hashes, min(21, max(4, math.ceil(2 * math.log2(1.04 / error))))))


def bloom_table(df: DataFrame, keys: Sequence[str], num_bits: int, num_hashes: int, types: Sequence[str] | None = None, function: HashFunction = XXHASH64) -> DataFrame:
    """The set bits as (bucket, bits) rows, built where the keys are and merged by one small shuffle."""
    cols = key_columns(keys, types)
    indices = F.array(*[bit_index(cols, i, num_bits, function) for i in range(num_hashes)])
    at = df.select(F.explode(indices).alias("i")).filter("i IS NOT NULL")
    return at.groupBy(F.floor(F.col("i") / _BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.col("i") % _BUCKET).alias("bits"))


def build_bloom(df: DataFrame, keys: str | Sequence[str], settings: BloomSettings = BloomSettings(), types: Sequence[str] | None = None) -> BloomFilter:
    """A filter of all key tuples of ``df`` without nulls.

    Keys are counted approximately first, so size and hashes fit them; the
    bitmap is then made in one pass.  The driver gets the set buckets only, at
    most ``max_bits / 8`` bytes.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = key_columns(keys, types)
    n = df.select(approximate_count(F.xxhash64(*cols), settings.count_error)).first()[0] or 0
    bits = settings.num_bits or bits_for(n, settings.rate, settings.max_bits)
    _, hashes = optimal_hashes(bits, max(n, 1), settings.min_hashes, settings.max_hashes)
    data = np.zeros((bits + 7) // 8 + _BUCKET // 8, np.uint8)
    for row in bloom_table(df, keys, bits, hashes, types, settings.function).collect():
        at = row["bucket"] * (_BUCKET // 8)
        data[at : at + len(row["bits"])] = np.frombuffer(bytes(row["bits"]), np.uint8)[: len(data) - at]
    return BloomFilter(bits, hashes, BitSet(bits, data[: (bits + 7) // 8].tobytes()), n, settings.function)


def might_contain(df: DataFrame, keys: str | Sequence[str], bloom: BloomFilter, types: Sequence[str] | None = None) -> Column:
    """Whether each row's key may be in the filter; false where a key is null.

    Hashes are computed by Spark; only the bit test is an Arrow function, over a
    broadcast whose size the settings bound.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = key_columns([df[k] for k in keys], types)
    shared = df.sparkSession.sparkContext.broadcast(bloom.bits)

    @F.pandas_udf("boolean")
    def test(*at: pd.Series) -> pd.Series:
        bits, out = shared.value, None
        for one in at:
            missing = one.isna().to_numpy()
            hit = bits.get_many(one.fillna(0).to_numpy(np.int64)) & ~missing
            out = hit if out is None else out & hit
        return pd.Series(out)

    return test(*[bit_index(cols, i, bloom.num_bits, bloom.function) for i in range(bloom.num_hashes)])


def runtime_filter(small: DataFrame, keys: Sequence[str], settings: BloomSettings, types: Sequence[str]) -> Callable[[DataFrame, Sequence[str]], Column] | None:
    """A condition on another table's keys that keeps all of ``small``'s and few others; None if too many others would pass.

    Built and tested by Spark's own Bloom filter, which runs inside generated
    code; only a size or a hash function of the caller's takes the filter above.  Null keys don't pass.
    """
    if settings.num_bits is not None or settings.function is not XXHASH64:
        built = build_bloom(small, keys, settings, types)
        if settings.num_bits is None and built.false_positive_rate() > settings.useless and not settings.force:
            return None
        return lambda df, names: might_contain(df, names, built, types)
    cols = key_columns(keys, types)
    n = small.select(approximate_count(F.xxhash64(*cols), settings.count_error)).first()[0]
    if not n:
        return lambda df, names: F.lit(False)
    bits = bits_for(n, settings.rate, settings.max_bits)
    if optimal_hashes(bits, n, settings.min_hashes, settings.max_hashes)[0] > settings.useless and not settings.force:
        return None
    spark = small.sparkSession
    # Nulls make no key; others are known by one hash.
    hashed = small.dropna("any", subset=list(keys)).select(F.xxhash64(*cols).alias("h"))
    out = spark._jvm.java.io.ByteArrayOutputStream()
    hashed._jdf.stat().bloomFilter("h", n, bits).writeTo(out)
    data = F.lit(bytes(out.toByteArray()))

    def test(df: DataFrame, names: Sequence[str]) -> Column:
        own = key_columns([df[k] for k in names], types)
        jvm = spark._jvm
        expression = jvm.org.apache.spark.sql.classic.ExpressionUtils
        hit = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(expression.expression(data._jc), expression.expression(F.xxhash64(*own)._jc))
        return reduce(lambda a, b: a & b, [c.isNotNull() for c in own]) & Column(expression.column(hit))

    return test
