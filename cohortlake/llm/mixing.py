"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and `most` that meet every source's token target, those nearest to one in
relative entropy, sum of r log r - r + 1 over documents, are sought. The dual is convex with one
multiplier for each source's constraint, and its solution tilts documents exponentially by their size: r = min(most,
exp(x_s * size / mean size of s)). Newton's steps find all x_s at once: each aggregates, over the documents, the tokens that the
rates take and their derivative, with sums that combine before the shuffle; one row for each source stays.
Documents of one source and size share a rate, so they are counted together first. A step that leaves the bracket known
so far is replaced by its middle; steps end when all constraints hold to TOLERANCE, or when doubles hold no number between the ends of the bracket. Sums are decimal, of
shares of the source's size, so that neither rows' order nor partitions change a bit of the result and small sources are summed as finely as large ones.

Each rate is rounded into whole copies: floor(r + u) with u from a hash of the row's key, so that
reruns agree. u times each of DRAWS odd numbers, less its whole part, gives as many roundings; each source takes the one
that brings its tokens nearest to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Tables, guarded, with_group

#: Relative distance of each source's expected tokens from its target at which Newton's steps end.
TOLERANCE = 1e-9
#: Far more than Newton's steps and the bracket's halvings need; a dual that is not solved by then fails the query.
MOST_STEPS = 400
#: Newton's steps after which every second step halves the bracket.
NEWTON_STEPS = 20
#: Roundings of each source that are compared.
DRAWS = 64
NAMES = ["size", "source_size", "target", "rate", "copies"]


def token_size(text: Column) -> Column:
    """The white-space words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")).cast("long"), F.lit(0).cast("long"))


def capped_targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """sources (source, source_size), one row each, with `target`: sources in order, null last, weigh `weights`
    in turn and share `share` of all tokens; a target stops at most x source_size and the excess goes
    to the others by weight until none is above."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    df = sources.withColumn("__w", w).withColumn("__cap", F.lit(float(most)) * F.col("source_size"))
    # those with the least room for each unit of weight fill first; the level at which the rest stands is tried at each
    by_room = Window.orderBy((F.col("__cap") / F.col("__w")).asc(), F.col("source").asc_nulls_last())
    before, rest = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("__level", (F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(rest))
    full = F.col("__level") * F.col("__w") > F.col("__cap")
    # once one is not full, none after it is
    level = F.min(F.when(~full, F.struct(F.col("__cap") / F.col("__w"), F.col("__level")))).over(Window.partitionBy())
    return df.withColumn("__l", level[f"__level"]).withColumn("target", F.when(F.col("__l").isNull(), F.col("__cap")).otherwise(F.least(F.col("__l") * F.col("__w"), F.col("__cap")))).drop("__w", "__cap", "__level", "__l")


def tilted_rate(size: Column, x: Column, mean: Column, most: float) -> Column:
    """The rate of a document of this size where its source's multiplier is x; documents without tokens have rate 1."""
    return F.when(size > 0, F.least(F.exp(x * size / mean), F.lit(float(most)))).otherwise(F.lit(1.0))


def solve_dual(counts: DataFrame, sources: DataFrame, most: float, tables: Tables, n_sources: int) -> DataFrame:
    """sources (key, source_size, n_sized, target) with `mean` and `x` from counts (key, size, n): the multipliers that meet the targets.

    A target of most x source_size is met at rate `most` (x infinite), and one of 0 at rate 0."""
    start = F.when(F.col("target") >= most * F.col("source_size") * (1 - 1e-12), F.lit(float("inf"))).when(F.col("target") <= 0, F.lit(float("-inf"))).otherwise(F.lit(0.0))
    mean = F.when(F.col("n_sized") > 0, F.col("source_size") / F.col("n_sized")).otherwise(F.lit(1.0))
    none = F.lit(None).cast("double")
    state = tables.put(sources.withColumns({"mean": mean, "x": start, "low": none, "high": none}), "dual-0")
    open_ = F.col("x").isin(float("inf"), float("-inf"))
    for k in range(1, MOST_STEPS + 1):
        params = state.where(~open_).select("key", "mean", "x", "source_size")
        rate = tilted_rate(F.col("size"), F.col("x"), F.col("mean"), most)
        weight = F.col("n") * F.col("size") / F.col("source_size") * rate
        exact = lambda c: F.sum(c.cast("decimal(38,24)")).cast("double") * F.first("source_size")
        slope = F.when(rate < most, weight * F.col("size") / F.col("mean")).otherwise(F.lit(0.0))
        sums = with_group(counts, params, ["key"], n_sources).groupBy("key").agg(exact(weight).alias("taken"), exact(slope).alias("slope"))
        now = state.join(sums, "key", "left")
        off = F.log(F.col("taken") / F.col("target"))
        low = F.when(off < 0, F.col("x")).otherwise(F.col("low"))
        high = F.when(off >= 0, F.col("x")).otherwise(F.col("high"))
        middle = F.when(high.isNull(), 2 * F.abs(low) + 1).when(low.isNull(), -2 * F.abs(high) - 1).otherwise((low + high) / 2)
        step = F.col("x") - off * F.col("taken") / F.col("slope")
        inside = (F.col("slope") > 0) & (low.isNull() | (step > low)) & (high.isNull() | (step < high))
        if k > NEWTON_STEPS and k % 2:
            inside = inside & (low.isNull() | high.isNull())
        # a bracket whose middle is one of its ends cannot shrink any more
        tight = F.coalesce((middle <= low) | (middle >= high), F.lit(False))
        gap = F.when(tight, F.lit(0.0)).otherwise(F.coalesce(F.abs(F.col("taken") / F.col("target") - 1), F.lit(0.0)))
        done = gap <= TOLERANCE
        new = {"x": F.when(done, F.col("x")).otherwise(F.when(inside, step).otherwise(middle)), "low": low, "high": high, "gap": gap}
        state = tables.put(now.withColumns(new).select(*sources.columns, "mean", "x", "low", "high", "gap"), f"dual-{k}")
        tables.drop(f"dual-{k - 1}")
        if not (state.agg(F.max("gap")).first()[0] or 0.0) > TOLERANCE:
            return state.select(*sources.columns, "mean", "x")
    raise ArithmeticError("the dual was not solved")


def _unit(key: list[str], seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) / F.lit(float(1 << 53))


def _copies(rate: Column, unit: Column, times: Column, most: int) -> Column:
    u = unit * times
    return F.least(F.floor(rate + (u - F.floor(u))), F.lit(most)).cast("int")


def mix(df: DataFrame, weights: list[float], key: list[str], share: float = 1.0, most: int = 3, seed: int = 0, text: str = "text", source: str = "source") -> DataFrame:
    """Adds size, source_size, target, rate and copies to each row of df.

    Rows that agree in key get the same u. A null source is a source of its own; a null text has no
    tokens, and rows without tokens have rate 1 and stay once. A source of few or short documents is solved like others, but whole copies
    may not come nearer to its target than half of a document. An empty table stays empty.
    Columns of these names are replaced."""
    spark = df.sparkSession
    tables = Tables(spark, "mixing")
    kept = df.drop(*NAMES)
    size = token_size(F.col(text))
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))
    sizes = tables.put(kept.select(F.col(source).alias("source"), name.alias("key"), size.alias("size"), _unit(key, seed).alias("unit")), "sizes")
    counts = tables.put(sizes.groupBy("source", "key", "size").agg(F.count("*").alias("n")), "counts")
    sources = counts.groupBy("source", "key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("n_sized"))
    sources = tables.put(capped_targets(sources, weights, share, most), "sources")
    n_sources = sources.count()
    solved = tables.put(solve_dual(counts.where("size > 0").drop("source"), sources, most, tables, n_sources), "solved")
    rate = tilted_rate(F.col("size"), F.col("x"), F.col("mean"), most)
    draws = range(1, 2 * DRAWS, 2)
    taken = with_group(sizes.drop("source"), solved.select("key", "target", "mean", "x"), ["key"], n_sources).withColumn("rate", rate)
    taken = taken.groupBy("key").agg(F.first("target").alias("target"), *(F.sum(F.col("size") * _copies(F.col("rate"), F.col("unit"), F.lit(k), most)).alias(f"t{k}") for k in draws))
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("times")) for k in draws)))
    chosen = solved.join(taken.select("key", best["times"].alias("__times")), "key")
    chosen = tables.put(chosen.select(F.col("key").alias("__key"), "source_size", "target", F.col("mean").alias("__mean"), F.col("x").alias("__x"), "__times"), "chosen")
    tables.keep("chosen")
    out = with_group(kept.withColumn("__key", name), chosen, ["__key"], n_sources, "left").withColumn("size", size)
    out = out.withColumn("rate", tilted_rate(F.col("size"), F.col("__x"), F.col("__mean"), most))
    return out.withColumn("copies", _copies(F.col("rate"), _unit(key, seed), F.col("__times"), most)).select(*kept.columns, *NAMES)


def expanded(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as its copies, without the columns of the mix."""
    columns = [c for c in mixed.columns if c not in NAMES]
    return mixed.where("copies > 0").withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)


def mixed_rows(df: DataFrame, weights: list[float], key: list[str], **how) -> DataFrame:
    """The rows of df as often as the mix takes them, with their own columns, whatever their names. Handles all that mix() does."""
    return guarded(df, NAMES, lambda d: expanded(mix(d, weights, key, **how)))
