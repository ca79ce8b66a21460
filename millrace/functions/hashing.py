"""Key hashing and the arithmetic behind Bloom filters."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_id(name: str) -> int:
    """A stable signed 32-bit id of a definition's name: h = 31 * h + code unit."""
    h = 0
    for unit in memoryview(name.encode("utf-16-le")).cast("H"):
        h = (31 * h + unit) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def key_columns(keys: Sequence[str | Column], types: Sequence[str] | None = None) -> list[Column]:
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return [c.cast(t) for c, t in zip(cols, types, strict=True)] if types else cols


@dataclass(frozen=True)
class HashFunction:
    """A family of 64-bit hashes of key tuples, one per seed; stored filters carry its ``name`` (ASCII, 16 characters at most)."""

    name: str
    hashed: Callable[[Sequence[Column], int], Column]

    def __post_init__(self) -> None:
        if not 0 < len(self.name) <= 16 or not self.name.isascii():
            raise ValueError("a hash function's name has 1 to 16 ASCII characters")


XXHASH64 = HashFunction("xxhash64", lambda keys, seed: F.xxhash64(*keys, F.lit(seed)))
#: Two 32-bit hashes, with the seed after and before the keys.
MURMUR3 = HashFunction(
    "murmur3",
    lambda keys, seed: F.shiftleft(F.hash(*keys, F.lit(seed)).cast("bigint"), 32).bitwiseOR(F.hash(F.lit(seed), *keys).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))),
)
_FUNCTIONS = {f.name: f for f in (XXHASH64, MURMUR3)}


def register_hash(function: HashFunction) -> HashFunction:
    """Make a function known to filters that were stored under its name; a name is given once."""
    if _FUNCTIONS.setdefault(function.name, function) is not function:
        raise ValueError(f"there is another hash function {function.name}")
    return function


def hash_function(name: str) -> HashFunction:
    if name not in _FUNCTIONS:
        raise ValueError(f"no hash function {name} is known")
    return _FUNCTIONS[name]


def bit_index(keys: Sequence[Column], i: int, num_bits: int, function: HashFunction = XXHASH64) -> Column:
    """The i-th bit of a key tuple; null as soon as one key is null."""
    hashed = F.pmod(function.hashed(keys, i), F.lit(num_bits).cast("bigint"))
    present = keys[0].isNotNull()
    for k in keys[1:]:
        present = present & k.isNotNull()
    return F.when(present, hashed)


def false_positive_rate(num_hashes: int, num_bits: int, num_keys: int) -> float:
    """(1 - e^(-kn/m))^k."""
    return (1.0 - math.exp(-num_hashes * num_keys / num_bits)) ** num_hashes


def optimal_hashes(num_bits: int, num_keys: int, least: int = 1, most: int = 4) -> tuple[float, int]:
    """(rate, hashes) with the lowest false-positive rate; ties go to more hashes."""
    return min(((false_positive_rate(k, num_bits, num_keys), k) for k in range(least, most + 1)), key=lambda x: (x[0], -x[1]))


def bits_for(num_keys: int, rate: float, most: int) -> int:
    """Bits that reach ``rate`` for ``num_keys`` keys, at most ``most`` and at least 64."""
    ideal = math.ceil(-max(num_keys, 1) * math.log(rate) / math.log(2) ** 2)
    return max(64, min(ideal, most))
