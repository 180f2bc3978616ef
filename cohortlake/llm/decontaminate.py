"""Benchmark decontamination with suffix arrays over shards of the training words.

Each task gathers its documents into shards of about SHARD_BYTES of text and builds the suffix array of each:
all word positions (but those of words that no benchmark text has, which begin no match), sorted by the words from there to the
end of their document, by prefix doubling. Then every benchmark suffix that can hold a window is binary-searched in it, one
word deeper at a time, so that its interval holds the places that share so many words with it. The benchmark's suffixes are sorted too, and
those that agree so far are searched as one: a group is an interval of them, and splits where their next words differ. So a passage that
thousands of items share, at thousands of places, costs one search, and a match is kept for a place and not for each pair.

Where a group is a window long, its places are hit, by all items of the group. Where the interval of places narrows, those that drop out have found their longest match;
of a document's longest matches those that no other covers are returned, each with one item that has it and the place in that item; and beside them the ids of all
items with a window in the document. A window is `window` words, or the whole item where it is shorter.

The benchmark goes to the tasks in blocks of about BLOCK_BYTES of text, one after the other: a block is collected,
indexed and broadcast, its matches are written, and it is freed before the next one. So neither the driver nor a task holds more than one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ALNUM_WORD, Tables, gathered, guarded, sha256, small_batches, words_of

BLOCK_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("doc_word", T.LongType()), T.StructField("n_words", T.LongType())]))
FIELDS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("matches", MATCHES)]
#: What a block of a benchmark of several finds in a document.
PARTIAL = [("n_words", T.LongType()), ("matches", MATCHES), ("items", T.ArrayType(T.StringType())), ("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]


def _separated(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word ids of texts with a 0 behind each text; first[k] is the first word of text k. Word i of text k stands at i + k."""
    out = np.zeros(len(ids) + len(first), np.int64)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = ids
    return out


def suffix_array(e: np.ndarray, depth: int) -> np.ndarray:
    """The places of e's nonzero values (e ends with 0), sorted by what follows up to the next 0, or by `depth` values at least."""
    at = np.flatnonzero(e)
    if not len(at):
        return at
    base = int(e.max()) + 1
    key = e[at] * base + e[at + 1]
    place, zeros = np.arange(len(at)), np.flatnonzero(e == 0)
    stop = zeros[np.cumsum(e == 0) - (e == 0)]
    order, rank, open_, length = at, np.zeros(len(e), np.int64), np.ones(len(at), bool), 1
    while True:
        o = np.argsort(key)
        key, idx = key[o], place[open_]
        order[idx] = pos = order[idx][o]
        new = np.append(True, key[1:] != key[:-1])
        rank[pos] = np.maximum.accumulate(np.where(new, idx, 0)) + 1
        # groups of one are settled, and so are those whose suffixes end here
        open_[idx] = ~(new & np.append(new[1:], True)) & (key % base != 0)
        length *= 2
        if length >= depth or not open_.any():
            return order
        pos, base = order[open_], len(e) + 1
        inside = pos + length < stop[pos]
        key = rank[pos] * base + np.where(inside, rank[np.where(inside, pos + length, 0)], 0)


def _bound(e: np.ndarray, order: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray, word: np.ndarray, above: bool) -> np.ndarray:
    """For each interval of the suffix array the first place whose word at `depth` is not below (or is above) `word`."""
    low, high = low.copy(), high.copy()
    while len(at := np.flatnonzero(low < high)):
        mid = (low[at] + high[at]) >> 1
        found = e[order[mid] + depth]
        up = found <= word[at] if above else found < word[at]
        low[at[up]] = mid[up] + 1
        high[at[~up]] = mid[~up]
    return low


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which interval, and the place, for each place of each interval."""
    n = high - low
    return np.repeat(np.arange(len(low)), n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Found:
    """What a benchmark has in a shard: hits (place, words, group) of windows, the groups' intervals among the benchmark's suffixes, and longest matches (place, words, suffix)."""

    def __init__(self, hits, groups, longest):
        none = np.zeros(0, np.int64)
        joined = lambda parts, k: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none,) * k
        self.place, self.size, self.group = joined(hits, 3)
        self.low, self.high = joined(groups, 2)
        self.longest = joined(longest, 3)


class Benchmark:
    """A block of items: the word ids of its distinct texts, the ids of the items that have each, and the suffixes that begin a window, sorted."""

    def __init__(self, item_ids: list, texts: list, window: int):
        owners: dict[str, list[str]] = {}
        for i, t in sorted(zip(map(str, item_ids), texts, strict=True), key=lambda x: (x[0], x[1] or "")):
            owners.setdefault(t or "", []).append(i)
        w = words_of(pa.RecordBatch.from_arrays([pa.array(list(owners), pa.string())], names=["text"]), ALNUM_WORD, lower=True)
        h = w.hashes()
        self.window = window
        self.vocabulary = np.unique(h)
        self.words = _separated(self.word_ids(h), w.first)
        self.depth = int(w.counts.max(initial=0))
        size = np.repeat(w.counts, w.counts + 1)
        self.text = np.repeat(np.arange(len(w.counts)), w.counts + 1)
        self.place = np.arange(len(self.text)) - (w.first[:-1] + np.arange(len(w.counts)))[self.text]
        need = np.where(self.place + window <= size, window, np.where((size < window) & (self.place == 0), size, 0))
        order = suffix_array(self.words, self.depth)
        self.suffixes = order[need[order] > 0]
        self.need = need
        self.owners = list(owners.values())

    def word_ids(self, h: np.ndarray) -> np.ndarray:
        """1 and above for words of the benchmark, 0 for others."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        k = np.searchsorted(self.vocabulary, h)
        k[k == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[k] == h, k + 1, 0)

    def search(self, words) -> Found:
        """All windows in the words of a shard, and the longest match of each place that has one. Places count the words with one more behind each document."""
        e = _separated(self.word_ids(words.hashes()), words.first)
        order = suffix_array(e, self.depth)
        hits, groups, longest, n_groups, depth = [], [], [], 0, 0
        low, high = np.zeros(min(1, len(self.suffixes)), np.int64), np.full(min(1, len(self.suffixes)), len(self.suffixes))
        first, last = np.zeros(len(low), np.int64), np.full(len(low), len(order))
        while len(low):
            # each group by the next words of its suffixes, which are sorted by them; those that end here come first, with a 0
            group, at = _ranges(low, high)
            word = self.words[self.suffixes[at] + depth]
            new = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (word[1:] != word[:-1])))
            end = np.append(new[1:], len(at))
            group, word, sub_low, sub_high = group[new], word[new], at[new], at[end - 1] + 1
            ended = np.flatnonzero(word == 0)
            if 0 < depth < self.window and len(ended):  # whole items shorter than a window
                g, k = _ranges(first[group[ended]], last[group[ended]])
                hits.append((order[k], np.full(len(k), depth), n_groups + g))
                groups.append((sub_low[ended], sub_high[ended]))
                longest.append((order[k], np.full(len(k), depth), self.suffixes[sub_low[ended]][g]))
                n_groups += len(ended)
            more = np.flatnonzero(word)
            inner = _bound(e, order, depth, first[group[more]], last[group[more]], word[more], False)
            outer = _bound(e, order, depth, inner, last[group[more]], word[more], True)
            if depth >= self.window:
                # the places of a group that none of its parts takes on
                ends = np.ones(int((last - first).sum()) + 1, np.int64)
                shift = np.cumsum(last - first) - (last - first) - first
                np.add.at(ends, inner + shift[group[more]], -1)
                np.add.at(ends, outer + shift[group[more]], 1)
                ends[1:] -= 1
                g, k = _ranges(first, last)
                out = np.cumsum(ends)[:-1] > 0
                longest.append((order[k[out]], np.full(int(out.sum()), depth), self.suffixes[low][g[out]]))
            alive = outer > inner
            low, high, first, last, depth = sub_low[more][alive], sub_high[more][alive], inner[alive], outer[alive], depth + 1
            if depth == self.window and len(low):
                g, k = _ranges(first, last)
                hits.append((order[k], np.full(len(k), depth), n_groups + g))
                groups.append((low, high))
                n_groups += len(low)
        return Found(hits, groups, longest)

    def items_of(self, found: Found, groups: np.ndarray) -> list[str]:
        """The sorted ids of the items that have one of the groups of windows."""
        _, at = _ranges(found.low[groups], found.high[groups])
        return sorted({i for t in np.unique(self.text[self.suffixes[at]]).tolist() for i in self.owners[t]})


def covering(found: Found, words) -> tuple[np.ndarray, ...]:
    """(document, place in it, words, suffix) of the longest matches that no other of their document covers, in order."""
    place, n, suffix = found.longest
    order = np.lexsort((suffix, -n, place))
    place, n, suffix = place[order], n[order], suffix[order]
    end = place + n  # stays within its document, whose places come before those of the next one
    reach = np.concatenate(([-1], np.maximum.accumulate(end)))[:-1] if len(end) else end
    keep = end > reach
    begin = words.first[:-1] + np.arange(len(words.counts))
    doc = np.searchsorted(begin, place[keep], "right") - 1
    return doc, place[keep] - begin[doc], n[keep], suffix[keep]


def _blocks(benchmark: DataFrame, item: str, text: str):
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        yield n, [r.i for r in block], [r.t for r in block]


def _cover(low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    """How many of 0..k - 1 lie in an interval, for each k up to size."""
    change = np.bincount(low, minlength=size + 1) - np.bincount(high, minlength=size + 1)
    return np.concatenate(([0], np.cumsum(np.cumsum(change)[:-1] > 0)))


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", bench_text: str = "text") -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256, contaminated and matches (longest matches, with places and an item of each) to each row.

    Null or wordless texts have no words and are never hit; an item without words has no window. A
    null item_id is listed as `None`; items that share an id count once, and rows that repeat stand alike. Very long texts are a shard of
    their own. An empty benchmark leaves all clean; an empty table stays empty. Columns of these names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = docs.drop(*(n for n, _ in FIELDS))
    out = T.StructType([*kept.schema.fields, *(T.StructField(*f) for f in FIELDS)])
    numbered, parts, tables = None, [], None
    for k, (n, ids, texts) in enumerate(_blocks(benchmark, item, bench_text)):
        shared = spark.sparkContext.broadcast(Benchmark(ids, texts, window))
        if n == 1:
            return kept.mapInArrow(_finder(shared, text, out), out)
        if k == 0:
            tables = Tables(spark, "decontaminate")
            numbered = tables.put(kept.withColumn("__row", F.monotonically_increasing_id()), "documents")
        partial = T.StructType([T.StructField("__row", T.LongType()), *(T.StructField(*f) for f in PARTIAL)])
        parts.append(tables.put(numbered.select("__row", F.col(text).alias("__text")).mapInArrow(_finder(shared, "__text", partial), partial).where((F.size("hits") > 0) | F.lit(k == 0)), f"matches-{k}"))
        shared.destroy()
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p.withColumn("n_words", F.lit(0).cast("long")))
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("matches", "items", "hits")]  # one document's
    found = found.groupBy("__row").agg(F.sum("n_words").alias("n_words"), *lists).withColumn("items", F.array_sort(F.array_distinct("items")))
    joined = numbered.join(found, "__row").withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.concat_ws(",", "items"), 256), "contaminated": F.size("hits") > 0})
    return joined.withColumn("n_hit", _n_hit()).select(*out.names)


def _n_hit():
    """The words in the sorted intervals `hits`."""
    step = lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["at"]), F.lit(0))).cast("long").alias("n"), F.greatest(a["at"], x["end"]).alias("at"))
    zero = F.lit(0).cast("long")
    return F.aggregate(F.array_sort("hits"), F.struct(zero.alias("n"), zero.alias("at")), step)["n"]


def _listed(doc: np.ndarray, rows: int, fields: list[tuple[str, pa.Array]]) -> pa.Array:
    """A list of structs for each document, in order."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([a for _, a in fields], names=[n for n, _ in fields]))


def _finder(shared, text, schema):
    """The columns of schema: those of the input, and those of FIELDS or PARTIAL that it has."""
    names = schema.names

    def run(batches):
        bench = shared.value
        for b in gathered(batches, text, SHARD_BYTES):
            words = words_of(b, ALNUM_WORD, lower=True, column=text)
            found, rows = bench.search(words), b.num_rows
            begin = words.first + np.arange(rows + 1)
            hit_doc = np.searchsorted(begin, found.place, "right") - 1
            order = np.lexsort((found.group, hit_doc))
            cuts = np.searchsorted(hit_doc[order], np.arange(rows + 1))
            # documents with the same groups have the same items
            lists, known = [[]] * rows, {}
            for d in np.flatnonzero(np.diff(cuts)).tolist():
                groups = np.unique(found.group[order[cuts[d] : cuts[d + 1]]])
                lists[d] = known.setdefault(groups.tobytes(), groups)
            digests = {k: (len(ids := bench.items_of(found, g)), sha256(",".join(ids).encode()), ids if "items" in names else None) for k, g in known.items()}
            none = (0, sha256(b""), [])
            of_doc = [digests[g.tobytes()] if len(g) else none for g in lists]
            hit = _cover(found.place, found.place + found.size, int(begin[-1]))[begin]
            doc, at, n, suffix = covering(found, words)
            item = pa.array([bench.owners[t][0] for t in bench.text[suffix].tolist()], pa.string())
            whole = lambda x: pa.array(np.asarray(x), pa.int64())
            made = {"n_words": whole(words.counts), "matches": _listed(doc, rows, [("item_id", item), ("item_word", whole(bench.place[suffix])), ("doc_word", whole(at)), ("n_words", whole(n))])}
            if "n_hit" in names:
                made |= {"n_hit": whole(hit[1:] - hit[:-1]), "n_items": whole([x[0] for x in of_doc]), "items_sha256": pa.array([x[1] for x in of_doc], pa.string()), "contaminated": pa.array([x[0] > 0 for x in of_doc], pa.bool_())}
            else:
                made |= {"items": pa.array([x[2] for x in of_doc], pa.list_(pa.string())), "hits": _listed(doc, rows, [("start", whole(at)), ("end", whole(at + n))])}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else b.column(c) for c in names], names=names)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any benchmark window, with their own columns, whatever their names. Handles all that find() does."""
    return guarded(docs, [n for n, _ in FIELDS], lambda d: find(d, benchmark, window).where(~F.col("contaminated")))
