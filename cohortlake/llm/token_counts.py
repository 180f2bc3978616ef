"""Token counts of a unigram tokenizer without building its tokens.

The tokenizer is the Unigram model of the tokenizers library over a vocabulary of pieces with scores, behind
its Metaspace splitter (each space begins a new word, written as U+2581) and with byte fallback. For each
distinct word an Aho-Corasick automaton enumerates the pieces that end at each place, and dynamic programming
carries the best score and its number of pieces. The library's rules on ties hold: a path replaces another
only if its score is greater, and candidates come from the earliest start on, so of equal paths the one
with the longest last piece stays; a sign that is no piece costs the least score minus 10 and
counts as its UTF-8 bytes.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import Words, passes, small_batches, text_bytes

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 1_500_000
_NOT_SPACE = np.arange(256) != 0x20


def vocabulary_of(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece file, in the order of their ids."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, p.score) for p in model.pieces]


class CountingViterbi:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(vocabulary).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY

    def __call__(self, word: str) -> tuple[int, float]:
        """The pieces of the best path through word, and its score."""
        n = len(word)
        scores, counts = [0.0] * (n + 1), [0] * (n + 1)
        matches = self.automaton.iter(word)
        at, found = next(matches, (n, None))
        unknown = self.unknown
        for end in range(n):
            best, count, single = None, 0, False
            while at == end:  # the longest first
                size, score = found
                start = end + 1 - size
                total = scores[start] + score
                if best is None or total > best:
                    best, count = total, counts[start] + 1
                single = single or size == 1
                at, found = next(matches, (n, None))
            if not single and (best is None or scores[end] + unknown > best):
                best, count = scores[end] + unknown, counts[end] + len(word[end].encode())
            scores[end + 1], counts[end + 1] = best, count
        return counts[n], scores[n]


class _Counter:
    """Counts texts word by word; remembers the distinct words of the last texts by hash."""

    def __init__(self, path: str):
        self.viterbi = CountingViterbi(vocabulary_of(path))
        self.empty = self.viterbi(MARK)
        self._reset()

    def _reset(self) -> None:
        self.h1 = self.h2 = np.zeros(0, np.uint64)
        self.known = np.zeros((0, 2))

    def _find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.h1):
            return np.full(len(h), -1)
        k = np.minimum(np.searchsorted(self.h1, h), len(self.h1) - 1)
        return np.where(self.h1[k] == h, k, -1)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens and the score of each text."""
        data, offsets = text_bytes(pc.replace_substring(column, MARK, " "))
        words = Words(data, offsets, _NOT_SPACE)
        h1, h2 = words.hashes(1), words.hashes(2)
        unique, index, inverse = np.unique(h1, return_index=True, return_inverse=True)
        where, u2 = self._find(unique), h2[index]
        fresh = np.flatnonzero((where < 0) | ((self.h2[where] != u2) if len(self.h2) else True))
        values = np.zeros((len(unique), 2))
        old = np.setdiff1d(np.arange(len(unique)), fresh)
        values[old] = self.known[where[old]]
        if len(fresh):
            values[fresh] = self._count(words, index[fresh])
            new = fresh[where[fresh] < 0]
            if len(self.h1) + len(new) > CACHE:
                self._reset()
            h, z, v = (np.concatenate(x) for x in ((self.h1, unique[new]), (self.h2, u2[new]), (self.known, values[new])))
            order = np.argsort(h)
            self.h1, self.h2, self.known = h[order], z[order], v[order]
        each = values[inverse]
        other = np.flatnonzero(u2[inverse] != h2)  # a second word with the same hash
        if len(other):
            each[other] = self._count(words, other)
        # document by document, so that no score depends on the texts beside it
        total, some = np.zeros((len(words.counts), 2)), words.counts > 0
        if some.any():
            total[some] = np.add.reduceat(each, words.first[:-1][some], axis=0)
        # empty words: between spaces, and at an end; none before a first space
        spaces = np.concatenate(([0], np.cumsum(data == 0x20)))[offsets]
        lead = (np.diff(offsets) == 0) | (np.append(data, 0)[offsets[:-1]] == 0x20)
        empty = np.diff(spaces) + 1 - words.counts - lead
        total += empty[:, None] * np.array(self.empty)
        return total[:, 0].astype(np.int64), total[:, 1]

    def _count(self, words: Words, index: np.ndarray) -> list[tuple[int, float]]:
        data = words.data.tobytes()
        return [self.viterbi(MARK + data[a:z].decode()) for a, z in zip(words.starts[index].tolist(), words.ends[index].tolist(), strict=True)]


@cache
def _counter(path: str) -> _Counter:
    return _Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Adds n_tokens (long) and score (double) to each row; existing columns of these names are replaced.

    vocabulary is a sentencepiece file that all workers can open. Null and empty texts have no tokens and score 0. Very long
    texts are counted whole; equal texts get equal counts and scores, wherever they stand. An empty table stays empty."""
    small_batches(docs.sparkSession)
    kept = docs.drop("n_tokens", "score")
    columns = kept.columns
    out = T.StructType([*kept.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        count = _counter(vocabulary)
        for whole in batches:
            for b in passes(whole, text):
                n, score = count(b.column(text))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(n), pa.array(score)], names=out.names)

    return kept.mapInArrow(run, out)
