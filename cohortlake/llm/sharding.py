"""Sharding by a Feistel permutation of global row numbers, with DataFrame functions alone.

Every row gets its number in key order; a keyed permutation of 0..n-1 gives its place in the
shuffle; place mod shards is the shard and place div shards the slot. Shard sizes differ by one
at most, slots have no gaps, and both follow from a row number, n and the seed, so a reader can
compute where a row went, and which row fills a slot, without an index.

The permutation works on pairs (left, right) below (a, b) with a = ceil(sqrt(n)) and
b = ceil(n / a), so its domain holds fewer than n + a values; a value that leaves 0..n-1 is
permuted again until it is back (cycle walking), which almost no value needs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Tables

ROUNDS = 6
#: A walk leaves the range with probability below 1 / sqrt(n) a step; one that long fails the query.
WALKS = 64


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _mixed(x: Column, seed: int, k: int, size: int) -> Column:
    return F.pmod(F.xxhash64(x, F.lit(seed), F.lit(k)), F.lit(size))


def _once(x: Column, n: int, seed: int) -> Column:
    """One pass of the rounds over (left, right); adds the hash of one side to the other."""
    a, b = _sides(n)
    s = F.struct(((x - x % F.lit(b)) / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).alias("r"))
    for k in range(ROUNDS):
        # a lambda over one element names the pair once, so that the expression stays linear in the rounds
        step = (lambda p, k=k: F.struct(F.pmod(p["l"] + _mixed(p["r"], seed, k, a), F.lit(a)).alias("l"), p["r"].alias("r"))) if k % 2 == 0 else (lambda p, k=k: F.struct(p["l"].alias("l"), F.pmod(p["r"] + _mixed(p["l"], seed, k, b), F.lit(b)).alias("r")))
        s = F.transform(F.array(s), step)[0]
    return F.transform(F.array(s), lambda p: p["l"] * F.lit(b) + p["r"])[0]


def permuted(row: Column, n: int, seed: int = 0) -> Column:
    """The place of row number `row` of n in the shuffle."""
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), _once(row, n, seed), lambda x, _: F.when(x < n, x).otherwise(_once(x, n, seed)))
    first = _once(row, n, seed)
    out = F.when(first < n, first).otherwise(walked)
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("cycle walking took too long")).cast("long"))


def global_row_numbers(df: DataFrame, keys: list[str], tables: Tables, name: str = "ranged", number: str = "row") -> tuple[DataFrame, int]:
    """Adds `number`, 0-based in the order of keys, without a task that sees all rows: range partitions
    are sorted and written; each row's number is its place in its file plus the rows of earlier files."""
    pid, seq = "__pid", "__seq"
    # rows that agree in all keys, however many, are told apart by where they were read, so that they need not share a partition
    order = [F.col(k).asc_nulls_first() for k in (*keys, "__tie")]
    ranged = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie")
    # the id holds the partition above bit 33 and the place in it below
    ranged = tables.put(ranged.withColumn("__id", F.monotonically_increasing_id()), name)
    ranged = ranged.withColumn(pid, F.shiftright("__id", 33)).withColumn(seq, F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id")
    # a row for each partition
    counts = ranged.groupBy(pid).agg(F.count("*").alias("__n"))
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    return ranged.join(starts.select(pid, "__start"), pid).withColumn(number, F.col("__start") + F.col(seq)).drop(pid, seq, "__start"), n


def shard(df: DataFrame, shards: int, keys: list[str], seed: int = 0) -> DataFrame:
    """Adds `shard` (int) and `slot` (long) to df.

    keys order the rows before the shuffle; rows that agree in all keys are told apart by their
    place after sorting, which matters only if their other columns differ. Nulls sort first. An
    empty table gives an empty table. Columns named shard or slot are replaced; texts are not read."""
    kept = df.drop("shard", "slot")
    numbered, n = global_row_numbers(kept, keys, Tables(df.sparkSession, "sharding"), number="__row")
    at = F.col("__row")
    numbered = numbered.withColumn("__row", permuted(at, max(n, 1), seed))
    return numbered.withColumn("shard", (at % shards).cast("int")).withColumn("slot", ((at - at % shards) / shards).cast("long")).drop("__row")
