"""Joins whose keys may be hot on either side, and tables that are written once and read several times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.session import scratch_path

#: A key is dealt over several parts if a side has more than a HEAVY_KEYSth of its rows there; so at most so many keys of a side are, at any size.
HEAVY_KEYS = 5_000


#: The session's setting by which an execution's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as written to the shared folder and read back: what several branches read is computed once, and a lost executor costs tasks and no lineage.

    The shuffle files that made it go with the write, which nobody runs again; else they would stay beside the table until the driver collects garbage."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def degrees(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows of each key."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def heavy_keys(left: DataFrame, right: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """(keys, __pl, __pr): the keys with more than a parts-th of a side's rows, and over how many parts each side's rows of it are dealt. Below 2 * parts rows."""
    found = []
    for df, name in ((left, "__pl"), (right, "__pr")):
        n = degrees(df, keys, "__n")
        limit = F.greatest(F.ceil(F.col("__all") / parts), F.lit(1))
        hot = n.crossJoin(F.broadcast(n.agg(F.sum("__n").alias("__all")))).where(F.col("__n") > limit)  # one row
        found.append(hot.select(*keys, F.ceil(F.col("__n") / limit).cast("int").alias(name)))
    return found[0].join(found[1], keys, "full").na.fill(1, ["__pl", "__pr"])


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], left_by: str, right_by: str, parts: int | None = None) -> DataFrame:
    """The inner join on keys, many to many, with hot keys of either side laid out as a grid.

    The rows of a heavy key are dealt into __pl parts of the left side, by a hash of left_by, and __pr parts of the right one, by right_by; each of the __pl x __pr pairs of parts
    meets in a task of its own, so a row is copied as often as the other side has parts, and no task gets more than one part of each. Light keys
    are joined as usual. Both sides are read twice: give stored() ones. Nulls match nothing."""
    heavy = F.broadcast(heavy_keys(left, right, keys, parts or HEAVY_KEYS))
    part = lambda by, n: F.pmod(F.xxhash64(by), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)
    dealt = left.join(heavy, keys, "left").withColumn("__a", part(left_by, F.col("__pl"))).withColumn("__b", F.explode(every(F.col("__pr")))).drop("__pl", "__pr")
    other = right.join(heavy, keys, "left").withColumn("__b", part(right_by, F.col("__pr"))).withColumn("__a", F.explode(every(F.col("__pl")))).drop("__pl", "__pr")
    return dealt.join(other, [*keys, "__a", "__b"]).drop("__a", "__b")



def global_numbers(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """df with `name`, 0-based numbers in the given order (nulls first), without a task that sees all rows: sorted ranges are stored, and a row's number is
    its place in its range plus the rows of the ranges before, of which the driver holds one count each."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id holds the range above bit 33 and the place in it below
    ranged = stored(ranged.withColumn("__id", F.monotonically_increasing_id()), "ranged").withColumn("__range", F.shiftright("__id", 33))
    starts, at = [], 0
    for r in sorted(ranged.groupBy("__range").count().collect(), key=lambda r: r["__range"]):
        starts.append((r["__range"], at))
        at += r["count"]
    before = df.sparkSession.createDataFrame(starts, "__range long, __start long")
    placed = ranged.join(F.broadcast(before), "__range")
    return placed.withColumn(name, F.col("__start") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__range", "__start")
