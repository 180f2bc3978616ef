"""Near-duplicate detection with bottom-k sketches of one hash function.

1. Each document becomes its set of hashed word shingles, the digest of that set, and its bottom-k
   sketch: the k least hashes. Documents of one digest are one class; what follows sees classes.
2. A class can only have a link if enough of its least 32 hashes are retained by other classes.
3. For the rest, inverted lists of the retained values count in how many sketches each occurs. A link at
   the threshold shares at least `common` of k values (all but 1e-10 of the links; a set that fits into its
   sketch surely shares what the sketch of the largest set that it can link to must show), so a class whose values are rarer than that has none, and the others must
   meet in one of their rarest values.
4. The classes that do meet, a small part, are listed once more by the values of their whole sets. There the bounds are exact.
5. In each list the classes are compared with a few pivots, and in short lists with each other. A pair
   is estimated from the bottom-k sketch of its union and then verified on the whole sets. Linked
   classes contract into components; what is left are pairs in a list from different
   components, which are all compared where their sizes and the values from there on allow a link. So no list of
   similar texts is expanded into all its pairs, and no link that joins two components is missed. (Many classes that share
   all their values with others, yet are unlike each other, remain to be compared.)

Keys that many rows share, a common value, a digest of many copies, a pivot or the centre of a star, are split over tasks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .sharding import global_row_numbers
from .shared import WHITE_WORD, Tables, passes, runs, small_batches, spread_join, words_of

SKETCH = 256
LOW = 32
TAIL = 1e-10
PIVOT_ROUNDS = 1
#: Lists of so many classes are compared in full at once.
SHORT_LIST = 6
#: Classes of a long list that a task compares with the whole list.
LIST_PART = 1000
#: Ids that are broadcast at most: some 16 MB.
BROADCAST_IDS = 1_000_000

LONGS = T.ArrayType(T.LongType())


def least_common(k: int, num: int, den: int, tail: float = TAIL) -> int:
    """The most values t such that k draws, each common with probability num/den, have fewer than t common ones at most with probability `tail`."""
    p, total = num / den, 0.0
    for x in range(k + 1):
        total += math.comb(k, x) * p**x * (1 - p) ** (k - x)
        if total > tail:
            return x
    return k


def _at_least(num: int, den: int):
    """The least intersection of a set of n values with a set that it links to: n * num / den, rounded up."""
    up = F.col("n") * num + (den - 1)
    return (up - up % den) / den


def _shown(num: int, den: int, kept: int):
    """The least values that a set of n <= kept values shares with the `kept` least ones of a set that it links to. That one has
    m <= n * den / num values, of which m - kept are cut; those in common, at least (n + m) * num / (num + den), grow slower than m."""
    most = F.col("n") * den
    most = (most - most % num) / num
    common = F.ceil((F.col("n") + most) * num / (num + den))
    return F.least(_at_least(num, den), common - (most - kept))


def _sets(batch: pa.RecordBatch, text: str, shingle: int):
    """The sorted set of 63-bit shingle hashes of each document."""
    words = words_of(batch, WHITE_WORD, lower=True, column=text)
    h = words.hashes()
    r = runs(h, shingle) >> np.uint64(1)
    for a, c in zip(words.first, words.counts, strict=False):
        if c >= shingle:
            yield np.unique(r[a : a + c - shingle + 1])
        elif c:
            yield runs(h[a : a + c], int(c), seed=int(c) + 1) >> np.uint64(1)
        else:
            yield r[:0]


def _longs(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)))


def sketches(docs: DataFrame, doc_id: str, text: str, shingle: int, k: int) -> DataFrame:
    """(id, n, digest, low, rest): the size and digest of each document's set, and its k least hashes in two arrays."""
    small_batches(docs.sparkSession)
    out = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("low", LONGS), T.StructField("rest", LONGS)])

    def run(batches):
        for whole in batches:
            for b in passes(whole, text):
                sets = list(_sets(b, text, shingle))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(doc_id), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), _longs([s[:LOW] for s in sets]), _longs([s[LOW:k] for s in sets])], names=out.names)

    return docs.select(doc_id, text).mapInArrow(run, out)


def whole_sets(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    out = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("set", LONGS)])

    def run(batches):
        for whole in batches:
            for b in passes(whole, text):
                sets = list(_sets(b, text, shingle))
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), _longs(sets)], names=out.names)

    return docs.select(text).mapInArrow(run, out)


def _shared_values(near: DataFrame, tables: Tables, column: str, need, name: str) -> DataFrame:
    """(v, node, n, lone, left): for each class that can have links, those of its rarest values in one of which any link must meet.

    A class's values are ordered by how many classes have them; lone counts those that no other has, left the values from v on."""
    values = near.select("node", "n", F.size(column).alias("size"), F.explode(column).alias("v"))
    often = values.groupBy("v").count().where("count > 1")
    total = near.agg(F.coalesce(F.sum(F.size(column)), F.lit(0))).first()[0]
    per = spread_join(values, often, "v", total, "node").groupBy("node", "n", "size").agg(F.sort_array(F.collect_list(F.struct("count", "v"))).alias("common"))  # a class's own values
    per = per.withColumn("prefix", (F.size("common") - need + 1).cast("int")).where("prefix >= 1")  # the lone values of the class come first in its order
    each = per.select("node", "n", "size", F.size("common").alias("m"), F.posexplode(F.slice("common", 1, F.col("prefix"))).alias("i", "x"))
    return tables.put(each.select(F.col("x.v").alias("v"), "node", "n", (F.col("size") - F.col("m")).cast("int").alias("lone"), (F.col("m") - F.col("i")).cast("int").alias("left")), name)


class _Verifier:
    """Keeps the pairs whose sets reach num/den: sketches first, then the whole sets."""

    def __init__(self, near: DataFrame, sets: DataFrame, k: int, num: int, den: int, common: int):
        self.near, self.sets, self.k, self.num, self.den, self.common = near, sets, k, num, den, common

    def _sized(self, a: str, b: str):
        return F.lit(self.den) * F.least(a, b) >= F.lit(self.num) * F.greatest(a, b)

    def possible(self, na, nb, left_a, left_b):
        """Whether sets of these sizes can link if the first value that they share has so many values from it on in each: a link's
        intersection is at least num / (num + den) of the sum of the sizes."""
        low, high = F.least(na, nb), F.greatest(na, nb)
        needed = F.lit(self.num) * (low + high)
        return (F.lit(self.den) * low >= F.lit(self.num) * high) & (F.lit(self.num + self.den) * F.least(left_a, left_b) >= needed)

    def _with_side(self, pairs: DataFrame, x: str, by: str, total: int, side: DataFrame) -> DataFrame:
        """pairs with the columns of side, whose key is x; a pivot of a long list is in many pairs and is split."""
        counted = pairs.groupBy(x).count()
        return spread_join(pairs, side.join(counted, x), x, total, by).drop("count")

    def links(self, pairs: DataFrame, tables: Tables, name: str) -> DataFrame:
        side = lambda x: self.near.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        total = pairs.count()
        both = self._with_side(self._with_side(pairs, "a", "b", total, side("a")), "b", "a", total, side("b")).where(self._sized("na", "nb"))
        inter = F.array_intersect("sa", "sb")
        whole = F.greatest("na", "nb") <= self.k
        exact = F.lit(self.den) * F.size(inter) >= F.lit(self.num) * (F.col("na") + F.col("nb") - F.size(inter))
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, self.k)
        estimate = F.size(F.array_intersect(inter, union)) >= self.common
        passed = tables.put(both.where(F.when(whole, exact).otherwise(estimate)).select("a", "b", "na", "nb", whole.alias("whole")), f"{name}-estimated")
        sets = lambda x: self.sets.select(F.col("node").alias(x), F.col("set").alias(f"s{x}"))
        large = passed.where("not whole")
        large = self._with_side(self._with_side(large, "a", "b", total, sets("a")), "b", "a", total, sets("b")).where(exact).select("a", "b")
        return tables.put(passed.where("whole").select("a", "b").union(large), f"{name}-links")


def _small(ids: DataFrame) -> DataFrame:
    """ids to be broadcast if they are at most BROADCAST_IDS, which spares a shuffle of the texts; else as they are."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text", k: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; links are pairs with den * intersection >= num * union.

    A text of fewer than `shingle` words is one shingle; without words (or null) it has none, links to nothing and is
    its own component. component_id is the least doc_id reachable; kept is doc_id = component_id. A null doc_id takes
    part and is kept only if no doc_id of its component is not null. Rows that repeat a doc_id are
    rows of their own; equal texts are one class, whatever their number. Very long texts are taken whole. An empty table gives an empty table."""
    spark = docs.sparkSession
    tables = Tables(spark, "neardup")
    low_common, common = least_common(LOW, num, den, 1e-9), least_common(k, num, den)
    need = F.when(F.col("n") <= k, _shown(num, den, k)).otherwise(F.lit(common)).cast("int")
    rows = tables.put(sketches(docs, doc_id, text, shingle, k), "sketches")
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("low").alias("low"), F.count("*").alias("copies"))
    classes = tables.put(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    values = classes.select("node", "n", F.explode("low").alias("v"))
    often = values.groupBy("v").count().where("count > 1")
    total, members = classes.agg(F.coalesce(F.sum(F.size("low")), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    found = spread_join(values, often, "v", total, "node").groupBy("node", "n").agg(F.count("*").alias("c")).where(F.col("c") >= F.when(F.col("n") <= LOW, _shown(num, den, LOW)).otherwise(F.lit(low_common)))
    near = classes.join(found.select("node"), "node", "left_semi").select("node", "digest", "first")
    sketch = F.concat("low", "rest")
    near = near.join(rows.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & F.col("first").eqNullSafe(F.col("id"))).select("node", "n", "digest", F.col("id").alias("first"), sketch.alias("sketch"))
    near = tables.put(near.dropDuplicates(["node"]), "near")
    rows = tables.put(rows.select("id", "n", "digest"), "digests")
    tables.drop("sketches")

    first = _shared_values(near, tables, "sketch", need, "sketch-lists")
    met = first.groupBy("v").count().where("count > 1")
    near = tables.put(near.join(spread_join(first, met, "v", first.count(), "node").select("node").distinct(), "node", "left_semi"), "candidates")
    tables.drop("near")
    tables.drop("sketch-lists")
    large = near.where(F.col("n") > k)
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    texts = texts.join(_small(large.select("first").distinct()), F.col("__id").eqNullSafe(F.col("first")), "left_semi")
    sets = whole_sets(texts, "__text", shingle).join(large.select("node", "n", "digest"), "digest").select("node", "n", "set").dropDuplicates(["node"])
    sets = tables.put(near.where(F.col("n") <= k).select("node", "n", F.col("sketch").alias("set")).union(sets), "sets")
    lists = _shared_values(sets, tables, "set", _at_least(num, den).cast("int"), "lists")
    labels = _search(lists, _Verifier(near, sets, k, num, den, common), tables)

    firsts = classes.select("node", "digest", "first", "copies").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = firsts.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("count"))
    member = spread_join(firsts, least, "component", members, "node").select("digest", "component_id", F.col("copies").alias("count"))
    member = tables.put(member, "members")
    tables.keep("members", "digests")
    out = spread_join(rows.where("n > 0"), member, "digest", members, "id").select("id", "n", "component_id")
    out = out.union(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _search(lists: DataFrame, verifier: _Verifier, tables: Tables) -> DataFrame:
    labels, links, tested, total = None, None, None, lists.count()
    ordered = lambda df: df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda df, s, *c: df.select(*c, *(F.col(n).alias(f"{n}{s}") for n in ("node", "n", "left", "component")))
    possible = verifier.possible(F.col("nx"), F.col("ny"), F.col("leftx"), F.col("lefty"))
    nodes = [F.col("nodex").alias("x"), F.col("nodey").alias("y")]
    for k in range(PIVOT_ROUNDS + 1):
        now = lists.withColumn("component", F.col("node")) if labels is None else lists.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # pivots are the classes with the fewest values of their own, which are alike to most others; more loosely in each round
        rank = F.struct(F.floor(F.col("lone") / F.lit(1 << k)).alias("r"), F.xxhash64("node", F.lit(k)).alias("h"), "node", "component", "n", "left")
        mixed = now.groupBy("v").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("count"), F.min(rank).alias("p")).where("c0 <> c1")
        met = tables.put(spread_join(now, mixed.select("v", "count", "p"), "v", total, "node"), f"met-{k}")
        if k == PIVOT_ROUNDS:
            # a long list is dealt over parts by one side, and each part sees the other
            parts = F.ceil(F.col("count") / LIST_PART).cast("int")
            x = side(met.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")), "x", "v", "part")
            y = side(met.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))), "y", "v", "part")
            pairs = x.join(y, ["v", "part"]).where((F.col("componentx") < F.col("componenty")) & possible).select(*nodes)
        else:
            pairs = met.where("component <> p.component").where(verifier.possible(F.col("n"), F.col("p.n"), F.col("left"), F.col("p.left"))).select(F.col("p.node").alias("x"), F.col("node").alias("y"))
            if k == 0:
                short = met.where(F.col("count") <= SHORT_LIST)
                pairs = pairs.union(side(short, "x", "v").join(side(short, "y", "v"), "v").where((F.col("nodex") < F.col("nodey")) & possible).select(*nodes))
        pairs = ordered(pairs)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = tables.put(pairs, f"pairs-{k}")
        new = verifier.links(pairs, tables, f"round-{k}")
        tested = pairs if tested is None else tested.union(pairs)
        links = new if links is None else links.union(new)
        labels = tables.put(components(links, tables, f"components-{k}"), f"labels-{k}")
    return labels


def keep_first(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near duplicates: of each component one row stays, that of the least doc_id (nulls last), then the least text.

    Where rows repeat a doc_id, rows are numbered in that order and judged by their numbers, so each counts by its own text. All else as
    near_duplicates() has it: texts without words stay, all columns stay, an empty table stays empty."""
    tables = Tables(docs.sparkSession, "keep")
    repeated = docs.groupBy(doc_id).count().where("count > 1").limit(1).count()
    if not repeated:
        found = tables.put(near_duplicates(docs, shingle, num, den, doc_id, text), "found")
        return docs.join(_small(found.where("not kept").select(F.col(doc_id).alias("__id"))), F.col(doc_id).eqNullSafe(F.col("__id")), "left_anti")
    keyed = docs.withColumn("__null", F.col(doc_id).isNull())
    numbered, _ = global_row_numbers(keyed, ["__null", doc_id, text], tables, number="__row")
    numbered = tables.put(numbered.drop("__null"), "numbered")
    tables.keep("numbered")
    gone = tables.put(near_duplicates(numbered, shingle, num, den, "__row", text).where("not kept").select("__row"), "gone")
    return numbered.join(_small(gone), "__row", "left_anti").select(*docs.columns)
