"""Removal of passages that repeat across a corpus, with a count-min prefilter.

A window is `window` consecutive words of one document. Documents are dealt by a hash of their id into
chunks of CHUNK_BYTES of text or more; what repeats inside a chunk is settled there, so a passage
reaches the other steps once for each chunk at most, however often it occurs.

1. Each chunk sends a partial sketch of its distinct windows: the cells of a count-min row they fall into,
   in slices of the cell space, as packed gaps. Where merged partial sketches count a cell once, its
   windows occur in no other chunk; all others are estimated to repeat. One row of CELLS cells for each
   window is enough, as counts are only held against one; it lets 1 in CELLS windows through in vain.
2. A second pass groups exactly those windows by 128-bit hash over all chunks and finds the chunk of the
   least doc_id for each; the other chunks learn that theirs starts earlier elsewhere. The sketch
   never counts too little, so no repeated window is lost.
3. A third pass removes every word covered by a window that starts earlier.

The passes read one shuffle of the texts by chunk; the sketch's shuffle is about 1.5 bytes a window.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .sharding import global_row_numbers
from .shared import WHITE_WORD, Tables, passes, runs, small_batches, words_of

#: Bytes of text of a chunk, and cells of a slice, which one task merges (2 ** 26 cells hold about 4 million windows), for up to SMALL bytes of
#: text. Both grow with the square root of larger inputs, to 8 and 4 times that, so that the parts that a chunk sends to a
#: slice do not get small: at 100 TB they still hold some ten windows. Results do not depend on them.
CHUNK_BYTES = 8 << 20
SLICE_BITS = 26
SMALL = 100 << 30
CELLS = 16

PACKED = T.StructType([T.StructField("slice", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("packed", T.BinaryType())])


def _pack(x: np.ndarray) -> bytes:
    """Integers as byte planes, compressed; with the number of planes first."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def _rows(found: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*found, strict=True)) if found else [[], [], [], []]
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=PACKED.names)


class _Chunk:
    """The documents of a chunk in order, and their windows' hashes: first[i] is the first window of the i-th distinct hash."""

    def __init__(self, table: pa.Table, window: int, doc_id: str, text: str):
        self.table = table.sort_by(doc_id)
        self.ids = np.asarray(self.table.column(doc_id), np.int64)
        self.words, parts, at, doc = [], [], 0, 0
        for batch in self.table.select([text]).combine_chunks().to_batches():
            for b in passes(batch, text):
                w = words_of(b, WHITE_WORD, column=text)
                start = w.of_doc(window)
                ok = np.flatnonzero(start >= 0)
                a, z = runs(w.hashes(1), window, 1)[ok], runs(w.hashes(2), window, 2)[ok]
                parts.append((a, z, ok + at, start[ok] + doc))
                self.words.append(w)
                at, doc = at + len(w.starts), doc + b.num_rows
        self.h1, self.h2, self.word, self.doc = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        order, new = _grouped(self.h1, self.h2)
        self.first = np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order

    def sliced(self, bits: tuple[int, int]):
        """(slice, indices into first of its distinct hashes, in order of their cell, and the cells in the slice); bits of all cells, and of a slice's."""
        cell = self.h1[self.first] >> np.uint64(64 - bits[0])  # first is in order of h1
        piece = (cell >> np.uint64(bits[1])).astype(np.int64) if bits[0] > bits[1] else np.zeros(len(cell), np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, piece[1:] != piece[:-1])), len(piece)) if len(piece) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(piece[a]), np.arange(a, b), cell[a:b]


def _grouped(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal 128-bit hashes together, and where each new one begins."""
    order = np.argsort(h1)
    a = h1[order]
    new = np.append(True, a[1:] != a[:-1]) if len(a) else np.zeros(0, bool)
    other = h2[order]
    if len(a) and (~new[1:] & (other[1:] != other[:-1])).any():  # two hashes agree in one half
        order = np.lexsort((h2, h1))
        a, other = h1[order], h2[order]
        new = np.append(True, (a[1:] != a[:-1]) | (other[1:] != other[:-1]))
    return order, new


def _sketch(window, bits, doc_id, text):
    def run(table):
        number, chunk = table.column("__chunk")[0].as_py(), _Chunk(table, window, doc_id, text)
        return _rows([(s, number, 0, _pack(np.diff(np.unique(cells), prepend=np.uint64(0)))) for s, _, cells in chunk.sliced(bits)])

    return run


def _merge(table):
    """For each chunk one bit for each of its cells in the slice: another chunk has it too."""
    cells = [np.cumsum(_unpack(p), dtype=np.uint64) for p in table.column("packed").to_pylist()]
    every = np.sort(np.concatenate(cells))
    repeated = np.unique(every[1:][every[1:] == every[:-1]])
    found = []
    for s, c, x in zip(table.column("slice").to_pylist(), table.column("chunk").to_pylist(), cells, strict=True):
        at = np.minimum(np.searchsorted(repeated, x), max(len(repeated) - 1, 0))
        found.append((s, c, 0, np.packbits(repeated[at] == x if len(repeated) else np.zeros(len(x), bool)).tobytes()))
    return _rows(found)


def _estimated(chunk: _Chunk, bits: tuple[int, int], flags: dict[int, bytes]):
    """(slice, indices into first) of the windows that the merged sketch counts more than once."""
    for s, index, cells in chunk.sliced(bits):
        new = np.append(True, cells[1:] != cells[:-1])
        flag = np.unpackbits(np.frombuffer(flags[s], np.uint8), count=int(new.sum())).astype(bool)
        kept = index[flag[np.cumsum(new) - 1]]
        if len(kept):
            yield s, kept


def _kinds(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {s: p for s, k, p in zip(table.column("slice").to_pylist(), table.column("kind").to_pylist(), table.column("packed").to_pylist(), strict=True) if k == kind}


def _candidates(window, bits, doc_id, text):
    def run(docs, flags):
        if not docs.num_rows:
            return _rows([])
        number, chunk = docs.column("__chunk")[0].as_py(), _Chunk(docs, window, doc_id, text)
        found = []
        for s, kept in _estimated(chunk, bits, _kinds(flags, 0)):
            at = chunk.first[kept]
            ids = np.diff(chunk.ids[chunk.doc[at]].view(np.uint64), prepend=np.uint64(0))
            body = np.concatenate((chunk.h1[at], chunk.h2[at], ids)).tobytes()
            found.append((s, number, 1, zstandard.ZstdCompressor(level=1).compress(body)))
        return _rows(found)

    return run


def _exact(table):
    """For each chunk one bit for each of its candidates in the slice: another chunk has the window in a document of lesser id."""
    parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(p), np.uint64).reshape(3, -1) for p in table.column("packed").to_pylist()]
    ids = np.concatenate([np.cumsum(p[2], dtype=np.uint64).view(np.int64) for p in parts])
    order, new = _grouped(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    later = np.zeros(len(ids), bool)
    later[order] = ids[order] > least
    cuts = np.cumsum([0, *(p.shape[1] for p in parts)])
    return _rows([(s, c, 1, np.packbits(later[a:z]).tobytes()) for s, c, a, z in zip(table.column("slice").to_pylist(), table.column("chunk").to_pylist(), cuts[:-1], cuts[1:], strict=True)])


def _remove(window, bits, doc_id, text, schema, columns):
    spans = pa.list_(pa.struct([("word", pa.int64()), ("n_words", pa.int64())]))

    def run(docs, marks):
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in schema.types], schema=schema)
        chunk = _Chunk(docs, window, doc_id, text)
        earlier = np.ones(len(chunk.h1), bool)  # all but the first of each hash in the chunk
        earlier[chunk.first] = False
        later = _kinds(marks, 1)
        for s, kept in _estimated(chunk, bits, _kinds(marks, 0)):
            earlier[chunk.first[kept]] = np.unpackbits(np.frombuffer(later[s], np.uint8), count=len(kept)).astype(bool)
        n = sum(len(w.starts) for w in chunk.words)
        cover = np.zeros(n + 1, np.int32)
        at = chunk.word[earlier]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
        gone = np.cumsum(cover[:n]) > 0
        texts, counts, removed, begins, sizes, per_doc, at = [], [], [], [], [], [], 0
        for w in chunk.words:
            mine = gone[at : at + len(w.starts)]
            at += len(w.starts)
            data, offsets = w.kept(~mine)
            texts.append(pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)))
            counts.append(w.counts)
            total = np.concatenate(([0], np.cumsum(mine)))
            removed.append(total[w.first[1:]] - total[w.first[:-1]])
            edge = np.zeros(len(mine) + 1, bool)
            edge[w.first] = True
            begin = np.flatnonzero(mine & (~np.concatenate(([False], mine[:-1])) | edge[:-1]))
            end = np.flatnonzero(mine & (~np.concatenate((mine[1:], [False])) | edge[1:])) + 1
            d = np.searchsorted(w.first, begin, "right") - 1
            begins.append(begin - w.first[d])
            sizes.append(end - begin)
            per_doc.append(np.bincount(d, minlength=len(w.counts)))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.concatenate(per_doc)))).astype(np.int32)), pa.StructArray.from_arrays([pa.array(np.concatenate(begins), pa.int64()), pa.array(np.concatenate(sizes), pa.int64())], names=["word", "n_words"]))
        new = [pa.array(np.concatenate(counts), pa.int64()), pa.array(np.concatenate(removed), pa.int64()), pa.chunked_array(texts).cast(pa.string()), lists.cast(spans)]
        return pa.table([*(chunk.table.column(c) for c in columns), *new], names=schema.names)

    return run


def remove_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds n_words, n_removed, kept_text and removed (runs of removed words) to each row.

    A word goes if some window of `window` words covers it whose words also start earlier: in a document of lesser id, or
    before in the same one. A null id is less than all others. Rows that repeat an id count in
    order of their text; where ids repeat, are null or are no integers, rows are numbered in that order first, so that equal ids
    need not share a task. Null texts have no words and an empty kept_text; texts shorter than a window keep all; very long ones are taken
    whole. An empty table stays empty. Columns of these names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("n_words", T.LongType())])))]
    kept = docs.drop(*(f.name for f in fields))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    growth = math.sqrt(max(1.0, size / SMALL))
    chunks = max(1, -(-size // int(CHUNK_BYTES * min(8.0, growth))))
    bits = min(60, max(16, math.ceil(math.log2(max(1, size / 6) * CELLS)))), SLICE_BITS + int(math.log2(min(4.0, growth)))
    columns, order = kept.columns, doc_id
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType) or docs.groupBy(doc_id).count().where(F.col(doc_id).isNull() | (F.col("count") > 1)).limit(1).count():
        order = "__row"
        kept, _ = global_row_numbers(kept, [doc_id, text], Tables(spark, "substrings"), number=order)
    dealt = kept.withColumn("__chunk", F.pmod(F.xxhash64(order), F.lit(chunks)))
    by_chunk = lambda df, c="chunk": df.groupBy(c)
    flags = dealt.groupBy("__chunk").applyInArrow(_sketch(window, bits, order, text), PACKED).groupBy("slice").applyInArrow(_merge, PACKED)
    found = dealt.groupBy("__chunk").cogroup(by_chunk(flags)).applyInArrow(_candidates(window, bits, order, text), PACKED)
    marks = flags.union(found.groupBy("slice").applyInArrow(_exact, PACKED))
    out = T.StructType([*(kept.schema[c] for c in columns), *fields])
    return dealt.groupBy("__chunk").cogroup(by_chunk(marks)).applyInArrow(_remove(window, bits, order, text, to_arrow_schema(out), columns), out)
