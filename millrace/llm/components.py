"""Connected components of an edge table, by alternating stars; nothing is gathered."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import discard, materialized


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; a component is named by its smallest node.

    Each round links every node to the smallest of its neighbours (large star,
    then small star) until all edges are stars.  A hub is only ever the hot key
    of a join with one row per key, which AQE splits.  Edges that touch null,
    and loops, are ignored.  Rounds grow with the logarithm of the longest path.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"`{a}` <> `{b}`").distinct()
    e = materialized(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, F.col("u") == F.col("k"))
        small = small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        old, e = e, materialized(small.distinct(), "edges")
        discard(old)
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(e: DataFrame) -> tuple[int, int]:
    return tuple(e.select(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Local components after adding edges (i, j): every position's smallest connected position."""
    while len(i):
        x, y = labels[i], labels[j]
        apart = x != y
        if not apart.any():
            break
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        labels = labels.copy()
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels = jumped
    return labels
