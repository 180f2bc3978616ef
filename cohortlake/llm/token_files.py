"""Token ids in files of compressed byte or bit planes.

Documents are dealt by range of their key and sorted, so that the files follow each other in key order. Each
task encodes its texts and writes files of at most FILE_IDS ids. Ids are cut into blocks of
BLOCK_IDS; a block is transposed into its byte planes (all lowest bytes, then all next, ...) or bit
planes, and each plane is compressed with zstandard. The footer holds the chunk index (place,
ids, compressed size of each plane and checksum of each block) and the documents with their token
counts, so that any span of ids is read by fetching its blocks alone.

Layout: MAGIC, planes of block 0, planes of block 1, ..., footer, length of the footer (8 bytes), MAGIC.

Files go to the shared folder under names of their own for each attempt; the manifest that Spark commits
names those that count, so what a lost executor left behind is never read.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LOWER, WHITE_WORD, Tables, Words, passes, small_batches, text_bytes

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 24
END_ID = 1
#: Distinct pieces of text whose ids a worker remembers before it starts anew.
CACHE = 1_500_000

# --- planes -----------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, kind: str, width: int) -> list[bytes]:
    """Planes of uint32 ids below 2 ** (8 * width): kind `byte` or `bit`."""
    octets = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width])
    if kind == "byte":
        return [np.ascontiguousarray(octets[:, k]).tobytes() for k in range(width)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(8 * width)]


def from_planes(planes: list[bytes], kind: str, n: int) -> np.ndarray:
    octets = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, p in enumerate(planes):
            octets[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        octets[:, : len(planes) // 8] = np.packbits(bits, axis=1, bitorder="little")
    return octets.view("<u4").ravel()


class PlaneWriter:
    """Writes one file; ids come in any portions, with the documents they belong to."""

    def __init__(self, fs: pafs.FileSystem, path: str, kind: str = "byte"):
        self.fs, self.path, self.kind = fs, path, kind
        self.out = fs.open_output_stream(path)
        self.out.write(MAGIC)
        self.at, self.n_ids, self.rest, self.index, self.docs = len(MAGIC), 0, np.zeros(0, np.uint32), [], []
        self.codec = zstandard.ZstdCompressor(level=1)

    def write(self, ids: np.ndarray, docs: pa.RecordBatch) -> None:
        self.docs.append(docs)
        self.n_ids += len(ids)
        ids = np.concatenate((self.rest, ids)) if len(self.rest) else ids
        whole = len(ids) - len(ids) % BLOCK_IDS
        for k in range(0, whole, BLOCK_IDS):
            self._block(ids[k : k + BLOCK_IDS])
        self.rest = ids[whole:].copy()

    def _block(self, ids: np.ndarray) -> None:
        width = max(1, (int(ids.max()).bit_length() + 7) // 8)
        planes = [self.codec.compress(p) for p in to_planes(ids, self.kind, width)]
        self.index.append({"at": self.at, "n": len(ids), "sizes": [len(p) for p in planes], "crc": zlib.crc32(ids.astype("<u4").tobytes())})
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.docs[0].schema) as stream:
            for d in self.docs:
                stream.write_batch(d)
        head = json.dumps({"kind": self.kind, "n_ids": self.n_ids, "blocks": self.index}).encode()
        footer = self.codec.compress(len(head).to_bytes(8, "little") + head + sink.getvalue().to_pybytes())
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()


class PlaneReader:
    """Reads the footer of a file, then any span of its ids."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a file of id planes")
        n = int.from_bytes(tail[:8], "little")
        footer = zstandard.ZstdDecompressor().decompress(self.file.read_at(n, size - 16 - n))
        cut = 8 + int.from_bytes(footer[:8], "little")
        head = json.loads(footer[8:cut])
        self.kind, self.n_ids, self.blocks = head["kind"], head["n_ids"], head["blocks"]
        self.docs = pa.ipc.open_stream(footer[cut:]).read_all()
        self.starts = np.cumsum([0, *(b["n"] for b in self.blocks)])

    def block(self, k: int) -> np.ndarray:
        b, codec = self.blocks[k], zstandard.ZstdDecompressor()
        data = self.file.read_at(sum(b["sizes"]), b["at"])
        cuts = np.cumsum([0, *b["sizes"]])
        ids = from_planes([codec.decompress(data[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)], self.kind, b["n"])
        if zlib.crc32(ids.tobytes()) != b["crc"]:
            raise ValueError(f"block {k} is damaged")
        return ids

    def ids(self, start: int, stop: int) -> np.ndarray:
        first, last = int(np.searchsorted(self.starts, start, "right")) - 1, int(np.searchsorted(self.starts, stop, "left"))
        parts = [self.block(k) for k in range(first, last)] if stop > start else []
        return np.concatenate(parts)[start - self.starts[first] : stop - self.starts[first]] if parts else np.zeros(0, np.uint32)


# --- encoding ---------------------------------------------------------------------------------

_LETTER, _DIGIT, _OTHER = 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_CLASS[[*range(0x30, 0x3A)]] = _DIGIT
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
#: Bytes that make a word opaque: controls, the apostrophe (contractions), `<` (strings of special tokens).
_ODD = np.zeros(256, bool)
_ODD[[*range(0, 9), *range(0x0E, 0x20), 0x7F, 0x27, 0x3C]] = True


# The normalizer and splitter of a tokenizer whose texts may be cut as WordEncoder does.
CUT_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}


class WordEncoder:
    """Encodes texts with any tokenizer of the library; by pieces where it splits at white space and, inside words, between
    letters, digits and other signs (CUT_RULES, a BPE model with an end-of-word mark, and special tokens that hold `<`).

    Texts are then cut into pieces that the tokenizer would never join: words at white space, and plain words
    (ASCII and Latin-1 letters, no apostrophe) also where the kind of sign changes. Each distinct
    piece is encoded once by the library and looked up by hash afterwards; all other words go to the library whole.
    With other tokenizers whole texts go to the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules, vocabulary = json.loads(self.tokenizer.to_str()), self.tokenizer.get_vocab()
        model = rules["model"]
        self.by_pieces = all(rules[k] == v for k, v in CUT_RULES.items()) and (model["type"], model["dropout"], model["end_of_word_suffix"]) == ("BPE", None, "</w>") and all("<" in t["content"] for t in rules["added_tokens"])
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.h1 = self.h2 = np.zeros(0, np.uint64)
        self.at = self.n = np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(0, np.uint32), 0

    def _encode_new(self, pieces: list[str], plain: np.ndarray) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        simple = np.flatnonzero(plain)
        for k in range(0, len(simple), 4096):
            part = simple[k : k + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces[i] for i in part)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.is_end[ids]) + 1
            if len(cuts) == len(part):
                for i, x in zip(part, np.split(ids, cuts[:-1]), strict=True):
                    out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False) if rest else [], strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with END_ID behind it, and the number of ids of each."""
        if not self.by_pieces:
            return self._plainly(column)
        raw, offsets = text_bytes(column)
        words = Words(raw, offsets, WHITE_WORD)
        if not len(words.starts):
            return np.full(len(words.counts), END_ID, np.uint32), np.ones(len(words.counts), np.int64)
        lead = np.concatenate(([False], raw[:-1] == 0xC3))
        odd = _ODD[raw] | ((raw >= 0x80) & ~((raw == 0xC3) | (lead & (raw < 0xC0) & (raw != 0x97) & (raw != 0xB7))))
        count = np.concatenate(([0], np.cumsum(odd)))
        opaque = count[words.ends] > count[words.starts]
        span = np.zeros(len(raw) + 1, np.int32)
        span[words.starts[opaque]] += 1
        span[words.ends[opaque]] -= 1
        inside = np.cumsum(span[:-1]) > 0
        kind = np.where(inside, np.uint8(_LETTER), _CLASS[raw])
        new = np.zeros(len(raw) + 1, bool)
        new[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] > 0)
        new[words.starts] = True
        starts = np.flatnonzero(new)
        nearest = np.searchsorted(words.starts, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], len(raw)), words.ends[nearest])
        pieces = Words.__new__(Words)
        pieces.data, pieces.starts, pieces.ends = np.where(inside, raw, LOWER[raw]), starts, ends
        h1, h2 = pieces.hashes(1), pieces.hashes(2)
        unique, index, inverse = np.unique(h1, return_index=True, return_inverse=True)
        u2 = h2[index]
        where = self._find(unique)
        known = (where >= 0) & (self.h2[where] == u2 if len(self.h2) else False)
        if (u2[inverse] != h2).any() or ((where >= 0) & ~known).any():  # two pieces share a hash
            return self._plainly(column)
        if not known.all():
            fresh = np.flatnonzero(~known)
            if len(self.h1) + len(fresh) > CACHE:
                self._reset()
                fresh = np.arange(len(unique))
            self._learn(pieces, unique[fresh], u2[fresh], index[fresh], (~opaque[nearest] & (kind[starts] != _DIGIT))[index[fresh]])
            where = self._find(unique)
        at, n = self.at[where][inverse], self.n[where][inverse]
        first = np.searchsorted(starts, offsets)
        total = np.concatenate(([0], np.cumsum(n)))
        sizes = total[first[1:]] - total[first[:-1]] + 1
        out = np.full(int(total[-1]) + len(sizes), END_ID, np.uint32)
        doc = np.repeat(np.arange(len(sizes)), np.diff(first))
        place = np.arange(int(total[-1])) - np.repeat(total[:-1], n)
        out[np.arange(int(total[-1])) + np.repeat(doc, n)] = self.ids[np.repeat(at, n) + place]
        return out, sizes

    def _find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.h1):
            return np.full(len(h), -1)
        k = np.minimum(np.searchsorted(self.h1, h), len(self.h1) - 1)
        return np.where(self.h1[k] == h, k, -1)

    def _learn(self, pieces, h1, h2, index, plain) -> None:
        data = pieces.data.tobytes()
        texts = [data[a:z].decode() for a, z in zip(pieces.starts[index].tolist(), pieces.ends[index].tolist(), strict=True)]
        found = self._encode_new(texts, plain)
        n = np.array([len(x) for x in found], np.int64)
        flat = np.concatenate(found)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(max(len(flat), self.used), np.uint32)))
        self.ids[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(n) - n
        self.used += len(flat)
        h1, h2, at, n = (np.concatenate(x) for x in ((self.h1, h1), (self.h2, h2), (self.at, at), (self.n, n)))
        order = np.argsort(h1)
        self.h1, self.h2, self.at, self.n = h1[order], h2[order], at[order], n[order]

    def _plainly(self, column) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array([*e.ids, END_ID], np.uint32) for e in self.tokenizer.encode_batch_fast([x or "" for x in column.to_pylist()], add_special_tokens=False)]
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# --- jobs -------------------------------------------------------------------------------------

MANIFEST = T.StructType([T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])


def write_ids(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", kind: str = "byte") -> DataFrame:
    """Encodes and writes all documents in ascending order of doc_id; returns the manifest, a row for each file, with `start`, the ids in files before it.

    tokenizer is a file that all workers can open. Null texts are empty and hold END_ID alone; null ids come first; rows
    that repeat an id follow in order of a hash of their text. An empty table gives an empty manifest."""
    spark = docs.sparkSession
    small_batches(spark)
    tables = Tables(spark, "token-ids")
    # rows that share an id, however many, are dealt over ranges by a hash of their text, and equal ones by where they were read
    tied = docs.select(doc_id, text).withColumns({"__hash": F.xxhash64(text), "__tie": F.monotonically_increasing_id()})
    key = [F.col(doc_id).asc_nulls_first(), F.col("__hash").asc(), F.col("__tie").asc()]
    ranged = tied.repartitionByRange(*key).sortWithinPartitions(*key).select(doc_id, text)
    root = tables.path("files")

    def run(batches):
        fs, at = pafs.FileSystem.from_uri(root)
        fs.create_dir(at, recursive=True)
        encode, part, seq, writer, n_docs = _encoder(tokenizer), TaskContext.get().partitionId(), 0, None, 0
        done = []

        def close():
            writer.close()
            done.append((part, seq, writer.path, n_docs, writer.n_ids))

        for whole in batches:
            for b in passes(whole, text):
                ids, sizes = encode(b.column(text))
                if writer is None:
                    writer, n_docs = PlaneWriter(fs, f"{at}/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids", kind), 0
                writer.write(ids, pa.RecordBatch.from_arrays([b.column(doc_id), pa.array(sizes)], names=["doc_id", "n_tokens"]))
                n_docs += b.num_rows
                if writer.n_ids >= FILE_IDS:
                    close()
                    writer, seq = None, seq + 1
        if writer is not None:
            close()
        cols = list(zip(*done, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=MANIFEST.names)

    manifest = tables.put(ranged.mapInArrow(run, MANIFEST), "manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn("root", F.lit(root))


def read_documents(manifest: DataFrame, doc_id_type: T.DataType, partitions: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    out = T.StructType([T.StructField("doc_id", doc_id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        for m in batches:
            for row in m.to_pylist():
                fs, _ = pafs.FileSystem.from_uri(row["root"])
                reader = PlaneReader(fs, row["path"])
                sizes = np.asarray(reader.docs.column("n_tokens"), np.int64)
                cuts = np.concatenate(([0], np.cumsum(sizes)))
                step, k = max(1, BLOCK_IDS * 16), 0
                keys = reader.docs.column("doc_id").combine_chunks()
                while k < len(sizes):  # as many documents at a time as fill some blocks
                    z = max(k + 1, int(np.searchsorted(cuts, cuts[k] + step, "right")) - 1)
                    ids = memoryview(reader.ids(int(cuts[k]), int(cuts[z]))).cast("B")
                    edge = (cuts[k : z + 1] - cuts[k]) * 4
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([keys.slice(k, z - k), pa.array(row["start"] + cuts[k:z]), pa.array(sizes[k:z]), pa.array(crc, pa.int64())], names=out.names)
                    k = z

    return manifest.repartition(partitions, "path").mapInArrow(run, out)
