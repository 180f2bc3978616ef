"""Connected components of an edge table: large-star and small-star rounds until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, spread_join


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(node, component) for each node of edges (a, b); component is the least node reachable.

    Every round is two aggregations with map-side sums and two joins on a node, in which the centre of a star is
    split; no node's neighbours are ever gathered, and each round's edges are written, so lost executors cost one round."""
    e = tables.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    before, k = None, 0
    while True:
        state = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if (mark := tuple(state)) == before or not state[0]:
            break
        before, k = mark, k + 1
        total = 2 * state[0]
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("count"))
        # large star: every larger neighbour turns to the least node around
        large = spread_join(both, least, "a", total, "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours turn to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("count"))
        small = spread_join(large, low, "a", total, "b").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = tables.put(small.where("a <> b").distinct(), f"{name}-{k}")
        tables.drop(f"{name}-{k - 1}")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
