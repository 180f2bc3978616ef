"""Importance resampling of documents towards a target distribution over hashed n-grams.

The features of a text are all runs of 1 to ORDERS consecutive words, joined by one space; a feature's bucket is its crc32 modulo
BUCKETS. Corpus and target each give a smoothed distribution over the buckets; a bucket's gain is the floored logarithm of
their ratio, a document's weight the sum of the gains of its features. Gumbel noise from a hash of the id, added to the
weight, makes the highest scores a draw without replacement in proportion to the ratio of the likelihoods.

Both passes over the texts intern the n-grams of a batch in an open-addressed table in NumPy: all are hashed by xxhash64 at once, each
claims the slot of its hash, and those that find it taken by other bytes (the bytes are compared, so that equal hashes do no harm) go on to the next slot. A
slot holds its n-gram's bucket, whose crc32 is so computed once a batch, and its count. The first pass adds the counts of the slots into
buckets, the second gathers the gains of the slots by the occurrences' slot ids. Tasks return a sum for each
bucket, or a few numbers for each document; the driver holds BUCKETS gains and nothing else.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sharding import global_row_numbers
from .shared import ALNUM_WORD, Tables, Words, gathered, guarded, small_batches, words_of

ORDERS = 3
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Text bytes of a batch: its table then fits into a core's cache.
BATCH_BYTES = 1 << 19
#: Bytes up to which n-grams are hashed and compared side by side; longer ones, of which a batch holds few, one by one.
SIDE_BY_SIDE = 256
NAMES = ["n_words", "n_features", "weight", "score"]

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lanes(data: np.ndarray, width: int) -> np.ndarray:
    """The little-endian integer of `width` bytes that begins at each byte of data, which has 8 bytes to spare at its end."""
    return np.ndarray((len(data) - 7,), f"<u{width}", data, strides=(1,))


def xxhash64(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """xxhash64 with seed 0 of data[start:start + length] for each pair; data ends with 8 bytes to spare."""
    eight, four = _lanes(data, 8), _lanes(data, 4)
    out = np.full(len(start), _P5, np.uint64)
    at = start.copy()
    if len(wide := np.flatnonzero((length >= 32) & (length <= SIDE_BY_SIDE))):
        with np.errstate(over="ignore"):
            v = [np.full(len(wide), x, np.uint64) for x in (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)]
        stripes, p = length[wide] // 32, start[wide]
        for s in range(int(stripes.max())):
            live = np.flatnonzero(stripes > s)
            for j in range(4):
                v[j][live] = _turned(v[j][live] + eight[p[live] + (32 * s + 8 * j)] * _P2, 31) * _P1
        acc = _turned(v[0], 1) + _turned(v[1], 7) + _turned(v[2], 12) + _turned(v[3], 18)
        for x in v:
            acc = (acc ^ (_turned(x * _P2, 31) * _P1)) * _P1 + _P4
        out[wide] = acc
        at[wide] += stripes * 32
    out += length.astype(np.uint64)
    left = np.where(length > SIDE_BY_SIDE, 0, length - (at - start))
    for _ in range(3):
        k = np.flatnonzero(left >= 8)
        out[k] = _turned(out[k] ^ (_turned(eight[at[k]] * _P2, 31) * _P1), 27) * _P1 + _P4
        at[k] += 8
        left[k] -= 8
    k = np.flatnonzero(left >= 4)
    out[k] = _turned(out[k] ^ (four[at[k]] * _P1), 23) * _P2 + _P3
    at[k] += 4
    left[k] -= 4
    for _ in range(3):
        k = np.flatnonzero(left > 0)
        out[k] = _turned(out[k] ^ (data[at[k]] * _P5), 11) * _P1
        at[k] += 1
        left[k] -= 1
    out = (out ^ (out >> np.uint64(33))) * _P2
    out = (out ^ (out >> np.uint64(29))) * _P3
    out ^= out >> np.uint64(32)
    whole = memoryview(data)
    for i in np.flatnonzero(length > SIDE_BY_SIDE).tolist():
        out[i] = xxhash.xxh64_intdigest(whole[start[i] : start[i] + length[i]])
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the `length` bytes of data at a and at b agree, for each pair of places."""
    eight, out = _lanes(data, 8), np.ones(len(a), bool)
    short = np.flatnonzero(length <= SIDE_BY_SIDE)
    for j in range(0, SIDE_BY_SIDE, 8):
        short = short[length[short] > j]
        if not len(short):
            break
        unlike = eight[a[short] + j] ^ eight[b[short] + j]
        beyond = np.maximum(0, 8 - (length[short] - j)).astype(np.uint64) * np.uint64(8)
        out[short] &= (unlike << beyond) == 0
    whole = memoryview(data)
    for i in np.flatnonzero(length > SIDE_BY_SIDE).tolist():
        out[i] = whole[a[i] : a[i] + length[i]] == whole[b[i] : b[i] + length[i]]
    return out


def _behind_zeros() -> np.ndarray:
    """What n zero bytes, n up to SIDE_BY_SIDE, make of a crc32 register: for each n four tables by the register's bytes, in one row of 1,024."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1).astype(np.uint32)
    rows = [(np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()]
    for _ in range(SIDE_BY_SIDE):
        rows.append((rows[-1] >> 8) ^ byte[rows[-1] & 255])
    return np.concatenate(rows)


BEHIND_ZEROS = _behind_zeros()


def _joined(register: np.ndarray, size: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """The crc32 register behind `size` more bytes, which alone would leave `alone` in a register of zeros."""
    at = size.astype(np.int64) << 10
    return BEHIND_ZEROS[at + (register & 255)] ^ BEHIND_ZEROS[at + 256 + ((register >> 8) & 255)] ^ BEHIND_ZEROS[at + 512 + ((register >> 16) & 255)] ^ BEHIND_ZEROS[at + 768 + (register >> 24)] ^ alone


class Grams:
    """The n-grams of a batch, interned: `slot` of each occurrence, its document, and `count` and `bucket` of each used slot."""

    def __init__(self, words: Words, orders: int = ORDERS, buckets: int = BUCKETS):
        # the words again with one space behind each, so that an n-gram is a run of bytes
        size = words.ends - words.starts
        begin = np.cumsum(size + 1) - size - 1
        self.data = np.full(int(size.sum()) + len(size) + 8, 0x20, np.uint8)
        inside = np.ones(len(self.data), bool)
        inside[begin + size] = False
        inside[-8:] = False
        mask = np.zeros(len(words.data) + 1, np.int8)
        mask[words.starts] = 1
        mask[words.ends] -= 1
        self.data[inside] = words.data[np.cumsum(mask[:-1], dtype=np.int8).view(bool)]
        whole = np.int32 if len(self.data) < 1 << 31 else np.int64
        firsts, ends, docs = [], [], []
        for k in range(1, orders + 1):
            doc = words.of_doc(k)
            first = np.flatnonzero(doc >= 0)
            firsts.append(first)
            ends.append((begin + size)[first + k - 1])
            docs.append(doc[first])
        first = np.concatenate(firsts)
        self.start, self.doc = begin[first].astype(whole), np.concatenate(docs).astype(whole)
        self.length = np.concatenate(ends).astype(whole) - self.start
        self._intern()
        self.used = np.flatnonzero(self.owner >= 0)
        self.count = np.bincount(self.slot, minlength=len(self.owner))[self.used]
        self.bucket = self._crc(first, size, np.repeat(np.arange(1, orders + 1), [len(f) for f in firsts])) % buckets

    def _intern(self) -> None:
        n = len(self.start)
        size = 1 << max(4, (2 * n).bit_length())
        key = xxhash64(self.data, self.start, self.length)
        # a slot's n-gram is known by one of its occurrences
        self.owner = np.full(size, -1, self.start.dtype)
        self.slot = (key & np.uint64(size - 1)).astype(self.start.dtype)
        open_ = np.arange(n, dtype=self.start.dtype)
        while len(open_):
            s = self.slot[open_]
            free = self.owner[s] < 0
            self.owner[s[free]] = open_[free]  # of several that claim one slot, one gets it
            own = self.owner[s]
            same = (key[own] == key[open_]) & (self.length[own] == self.length[open_])
            rest = np.flatnonzero(same & (own != open_))
            same[rest] = same_bytes(self.data, self.start[own[rest]], self.start[open_[rest]], self.length[open_[rest]])
            open_ = open_[~same]
            self.slot[open_] = (self.slot[open_] + 1) & (size - 1)

    def _crc(self, first: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The unsigned crc32 of the n-gram of each used slot: zlib's of its words, each distinct one once, joined by table."""
        at, whole = self.owner[self.used], memoryview(self.data)
        words = self.slot[: len(size)]  # the occurrences begin with the single words
        single = at < len(size)
        slots, begin, bytes_ = self.used[single], self.start[at[single]], self.length[at[single]]
        full = np.uint32(0xFFFFFFFF)
        crc = [zlib.crc32(whole[a:z]) for a, z in zip(begin.tolist(), (begin + bytes_).tolist(), strict=True)]
        head, tail = np.zeros(len(self.owner), np.uint32), np.zeros(len(self.owner), np.uint32)
        head[slots] = np.array(crc, np.uint32) ^ full
        # what a word adds behind a space, from its own register: registers are linear in what they hold
        near = np.flatnonzero(bytes_ < SIDE_BY_SIDE)
        alone = _joined(np.full(len(near), full), bytes_[near], head[slots[near]])
        tail[slots[near]] = _joined(np.full(len(near), zlib.crc32(b" ", 0xFFFFFFFF), np.uint32) ^ full, bytes_[near], alone)
        crc, word, n, short = head[words[first[at]]], first[at], order[at], self.length[at] <= SIDE_BY_SIDE
        for k in range(1, int(n.max(initial=0))):
            some = np.flatnonzero((n > k) & short)
            crc[some] = _joined(crc[some], size[word[some] + k] + 1, tail[words[word[some] + k]])
        crc = (crc ^ full).astype(np.int64)
        for i in np.flatnonzero(~short).tolist():
            crc[i] = zlib.crc32(whole[self.start[at[i]] : self.start[at[i]] + self.length[at[i]]])
        return crc

    def gathered(self, gains: np.ndarray, rows: int) -> np.ndarray:
        """The sum of the gains of each document's occurrences."""
        of_slot = np.zeros(len(self.owner))
        of_slot[self.used] = gains[self.bucket]
        return np.bincount(self.doc, of_slot[self.slot], rows).astype(np.int64)  # whole numbers, exact in doubles


def bucket_counts(texts: DataFrame, text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the occurrences of all features of all texts in each bucket that has any; nulls have none."""
    small_batches(texts.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in gathered(batches, text, BATCH_BYTES):
            g = Grams(words_of(b, ALNUM_WORD, lower=True, column=text), orders, buckets)
            total += np.bincount(g.bucket, g.count, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, s of S features of docs and t of T of the target."""
    counts = []
    for df, column in ((docs, text), (target, target_text)):
        c = np.zeros(buckets, np.int64)
        for r in bucket_counts(df, column, orders, buckets).collect():  # at most `buckets` rows
            c[r.bucket] = r.n
        counts.append(c.tolist())
    s, t = counts
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((y + 1) * (all_s + buckets) / ((x + 1) * (all_t + buckets)))) for x, y in zip(s, t, strict=True)], np.float64)


def _noise(doc_id: str, seed: int):
    """Gumbel noise times 1000 from the first 32 bits of sha256(`seed:doc_id`)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, orders: int = ORDERS) -> DataFrame:
    """Adds n_words, n_features, weight and score (long) to each row.

    Null, empty and wordless texts have no features and weight 0. Very long texts are a batch of their own, and words of any length are whole. A null id's
    noise is that of `null`; rows that repeat an id share it. An empty table stays empty. Columns of these names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = docs.drop(*NAMES)
    made = T.StructType([*kept.schema.fields, *(T.StructField(n, T.LongType()) for n in NAMES[:3])])
    buckets = len(gains)

    def run(batches):
        for b in gathered(batches, text, BATCH_BYTES):
            words = words_of(b, ALNUM_WORD, lower=True, column=text)
            g = Grams(words, orders, buckets)
            new = [words.counts, np.bincount(g.doc, minlength=b.num_rows), g.gathered(gains, b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in new)], names=made.names)

    return kept.mapInArrow(run, made).withColumn("score", F.col("weight") + _noise(doc_id, seed))


def ranked(rows: DataFrame, doc_id: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds rank (long) to scored rows, which are narrow: 1, 2, 3... of the floor(percent * N / 100) highest scores among the N rows of at least
    min_words words, null for others. Ties go to the smaller id, null ids first, and rows that share an id to the smaller n_features.

    The place of a row comes from sorted ranges of all rows and the sizes of the ranges before, so no task sees all rows."""
    tables = Tables(rows.sparkSession, "resampling")
    keyed = rows.withColumns({"__short": F.col("n_words") < min_words, "__down": -F.col("score")})
    placed, _ = global_row_numbers(keyed, ["__short", "__down", doc_id, "n_features"], tables, number="__place")
    drawn = placed.where(~F.col("__short")).count() * percent // 100
    return placed.withColumn("rank", F.when(F.col("__place") < drawn, F.col("__place") + 1)).drop("__short", "__down", "__place")


def importance(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs; handles all that scored() and ranked() do. An empty target leaves a uniform one."""
    gains = bucket_gains(docs, target, text, target_text)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return ranked(scored(narrow, gains, "doc_id", "text", seed).drop("text"), "doc_id", percent, min_words)


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of docs that are drawn, with their own columns, whatever their names.

    The scores are written without the texts; the lowest drawn (score, id) is then held against the scores, and the drawn few
    are matched by id, score and n_features, so texts are never shuffled. Rows that agree in these with a drawn one are drawn with it."""
    tables = Tables(docs.sparkSession, "resample")
    drawn = tables.put(importance(docs, target, doc_id, text, target_text, percent, min_words, seed).where("rank is not null"), "drawn")
    gains = bucket_gains(docs, target, text, target_text)

    def make(d):
        keys = drawn.select(F.col("doc_id").alias("__id"), F.col("score").alias("__score"), F.col("n_features").alias("__n")).distinct()
        on = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("score") == F.col("__score")) & (F.col("n_features") == F.col("__n"))
        return scored(d, gains, doc_id, text, seed).join(keys, on, "left_semi")

    return guarded(docs, NAMES, make)
