"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two shuffles of the edge table; the smallest id of a component becomes its label. Hubs meet
their edges in sort-merge joins, which adaptive execution may split; nothing is gathered in one task or on
the driver but the count and checksum that tell when the edges no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
    return tuple(row)


def _with_min(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with m, the smallest of a and its neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return edges.join(least.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a")).drop("_a")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in the edges; ids are bigint. Loops, repeated edges and nulls do no harm."""
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    now = cut(now)
    state = _state(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_min(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = _with_min(large)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = cut(small)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
