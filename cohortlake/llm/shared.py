"""Shared helpers: tables in the cluster's shared folder, and byte-level word splitting and
hashing of Arrow text columns with numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.session import scratch_path, ship

#: Bytes that separate words in the white-space word rule: space and 0x09-0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
WHITE_WORD = ~WHITE
#: ASCII letters, digits and every byte above 0x7F: the word rule of decontamination.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Text bytes that one numpy pass takes; a longer document is a pass of its own.
PASS_BYTES = 1 << 20


class Tables:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and outlive any executor.

    Those that the result does not read are dropped by its operator; the others stay until their folder is cleared."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.names = spark, scratch_path(spark, name), set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(conf).delete(at, True)
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Drops all tables but these, which the result reads."""
        self.drop(*(self.names - set(names)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def guarded(df: DataFrame, names: Iterable[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(df) with df's own columns alone, those unharmed whose names make() uses for its results."""
    own = {c: f"__own_{c}" for c in df.columns if c in set(names)}
    return make(df.withColumnsRenamed(own)).select(*(F.col(own.get(c, c)).alias(c) for c in df.columns))


#: Rows of parameters that are broadcast at most, some hundred bytes each.
BROADCAST_GROUPS = 50_000
SALTS = 64


def with_group(rows: DataFrame, params: DataFrame, keys: list[str], n_groups: int, how: str = "inner") -> DataFrame:
    """rows with the columns of params (one row for each group; n_groups is their number): broadcast up to BROADCAST_GROUPS rows, else
    joined with salted keys, so that a hot group is spread in both cases. Nulls in keys match nothing."""
    if n_groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(params), keys, how)
    salted = params.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*(c for c in rows.columns if c not in keys)), F.lit(SALTS)).cast("int")
    return rows.withColumn("__salt", salt).join(salted, [*keys, "__salt"], how).drop("__salt")


#: A key is split in spread_join if it has more than this part of all rows; so at most so many keys are broadcast, at any size.
HEAVY_KEYS = 10_000


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, total: int, by: str) -> DataFrame:
    """rows with the columns of per_key, which has one row for each key and in `count` the key's rows among the `total` rows.

    Keys of more than a HEAVY_KEYSth of all rows, of which there are fewer than HEAVY_KEYS, are dealt, by a hash of the column `by`, over
    as many parts as they exceed that; so no task gets a hot key whole. Nulls in key match nothing."""
    limit = max(1, -(-total // HEAVY_KEYS))
    parts = F.ceil(F.col("count") / limit).cast("int")
    heavy = F.broadcast(per_key.where(F.col("count") > limit).select(key, parts.alias("__parts")))
    salt = F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.col("__parts"))).cast("int")
    left = rows.join(heavy, key, "left").withColumn("__salt", salt).drop("__parts")
    right = per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col("count") > limit, parts - 1).otherwise(F.lit(0)))))
    return left.join(right, [key, "__salt"]).drop("__salt")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of an Arrow batch, as one row may be a very long text; and sends the package to the workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift-multiply), bijective."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, PASS_BYTES), b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers


def _byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed * 2 + 1))


class Words:
    """The words of some documents: bytes, start and end of each word, and first[d]:first[d + 1] as the words of document d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        inside = is_word[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside[:-1])) if len(data) else inside
        after = np.concatenate((inside[1:], [False])) if len(data) else inside
        self.data, self.offsets = data, offsets
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, seed: int = 1) -> np.ndarray:
        n = len(self.data)
        power, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_byte_codes(seed)[self.data] * power[:n], out=sums[1:], dtype=np.uint64)
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def kept(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept words of each document joined by one space: bytes and offsets."""
        inside = np.zeros(len(self.data) + 1, np.int32)
        starts = self.starts[keep]
        inside[starts] = 1
        inside[self.ends[keep]] -= 1
        mask = np.cumsum(inside[:-1]) > 0
        doc = np.searchsorted(self.first, np.flatnonzero(keep), "right") - 1
        # the byte before a word separates it from what came before; a document's first kept word needs none
        spaces = starts[np.append(False, doc[1:] == doc[:-1])] - 1 if len(starts) else starts
        data = self.data.copy()
        data[spaces] = 0x20
        mask[spaces] = True
        return data[mask], np.concatenate(([0], np.cumsum(mask)))[self.offsets]

    def of_doc(self, k: int) -> np.ndarray:
        """The document of each start of a run of k words within one document; -1 where the run would leave it."""
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        doc[np.arange(len(doc)) + k > self.first[1:][doc]] = -1
        return doc


def runs(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A hash of each k consecutive values, in order."""
    n = max(0, len(h) - k + 1)
    factor, out = np.uint64((0xA0761D6478BD642F + 16 * seed) | 3), np.zeros(n, np.uint64)
    for j in range(k):
        out = out * factor + h[j : j + n]
    return mix(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)), offsets - offsets[0]


def passes(batch: pa.RecordBatch, column: str = "text", most: int = PASS_BYTES):
    """Splits a batch so that each piece has about `most` bytes of text, or one row."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def gathered(batches, column: str, most: int):
    """Batches of about `most` bytes of text, or one row that has more: small ones are joined, large ones split."""
    held, size = [], 0

    def joined():
        table = pa.Table.from_batches(held).combine_chunks()
        return passes(table.to_batches()[0], column, most)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += int(text_bytes(b.column(column))[1][-1])
        if size >= most:
            yield from joined()
            held, size = [], 0
    if held:
        yield from joined()


def words_of(batch: pa.RecordBatch, is_word: np.ndarray, lower: bool = False, column: str = "text") -> Words:
    data, offsets = text_bytes(batch.column(column))
    return Words(LOWER[data] if lower else data, offsets, is_word)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def white_words(text):
    """The white-space words of a text column as an array, null for null: for the native operators."""
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
