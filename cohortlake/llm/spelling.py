"""Spelling variants: words of a corpus that differ by one letter, found by search schemes over FM-indexes of its vocabulary.

The vocabulary (frequent words with their occurrences) is written once. Two words at one inserted, deleted or replaced letter agree in
the first half of the word searched for, or else in the rest of it. So each word is searched twice: its first half is matched exactly and
extended to the right, its second half is matched exactly and extended to the left, with one error in the other half.
For each of the two a word is dealt by the half it shows exactly, with its length; and it is indexed under the halves that a word
searched for, of its length or one letter off, would show. So tasks get words that can meet, whatever the size of the vocabulary.

A task indexes its words in a bidirectional FM-index: the text of all words with a delimiter around each, and the text read backwards, each
as its letters in the order of their suffixes. An interval of suffix ranks stands for all places of a match; a letter more to
the left (in the one) or to the right (in the other) narrows it, for all words searched for at once. Where an interval
may take its error, each letter that stands there is tried. A match that reaches the delimiter is a word, since delimiters rank as their words do.
Matches are summed up where they are found: a task returns for each word searched for the number of its near words and the best one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Tables, small_batches

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 6
MIN_COUNT = 5
#: A word's form has at least so many times its occurrences.
RATIO = 5
#: One in so many distinct (document, word) loses a letter.
DAMAGE = 199
#: Words of a task, about; a half that more words show is indexed in parts of so many, and all its words searched for in each part.
TASK_WORDS = 20_000
#: Words searched for, and states of the search, that numpy holds at once.
PORTION = 4096
STATES = 1 << 20


def damaged(word: Column, doc_id: Column, rate: int = DAMAGE) -> Column:
    """The word without one letter where the crc32 h of `<doc_id>:<word>` is divisible by rate: the one at h % length."""
    h = F.crc32(F.encode(F.concat(doc_id.cast("string"), F.lit(":"), word), "UTF-8"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % rate == 0, F.concat(F.substring(word, F.lit(1), at), F.substr(word, at + 2))).otherwise(word)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: int = DAMAGE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words of min_length letters or more with n >= min_count occurrences; null texts have none, a null id counts as `null`."""
    id_ = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    runs = docs.select(id_.alias("i"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("w"))
    # a shorter run gives no such word
    runs = runs.where(F.length("w") >= min_length)
    ascii_ = F.octet_length("w") == F.length("w")
    lower = F.when(ascii_, F.lower("w")).otherwise(F.translate("w", UPPER, LOWER))
    words = runs.select(damaged(lower, F.col("i"), rate).alias("word")) if rate else runs.select(lower.alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


# --- the index -----------------------------------------------------------------------------------


class Letters:
    """Words as letter codes, one after the other: `code` (1 and above), `start` and `size` of each word."""

    def __init__(self, column: pa.Array, alphabet: np.ndarray | None = None):
        points = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), "<u4")
        self.alphabet = np.unique(points) if alphabet is None else alphabet
        self.code = np.searchsorted(self.alphabet, points).astype(np.int64) + 1
        self.size = pa.compute.utf8_length(column).to_numpy().astype(np.int64)
        self.start = np.cumsum(self.size) - self.size


def _suffix_ranks(code: np.ndarray, n_words: int) -> np.ndarray:
    """The places of a text in the order of their suffixes, by prefix doubling. Its delimiters have codes 0..n_words, all unlike, so suffixes are too."""
    rank, length, n = code, 1, len(code)
    while True:
        following = np.zeros(n, np.int64)
        following[: n - length] = rank[length:] + 1
        key = rank * (int(rank.max()) + 2) + following
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
        if length >= n or new[order[-1]] == n - 1:
            return order
        rank, length = new, 2 * length


class Index:
    """One direction of the FM-index over words in sorted order: a match grows to the left. Rank 0..n_words are the delimiters', in the words' order."""

    def __init__(self, code: np.ndarray, start: np.ndarray, size: np.ndarray, sigma: int):
        n, self.sigma = len(size), sigma
        # delimiter, word, delimiter, word, ..., delimiter; delimiter k stands before word k
        text = np.zeros(len(code) + n + 1, np.int64)
        at = np.arange(len(code)) + np.repeat(np.arange(n) + 1, size)
        text[at] = code
        unlike = text + n
        begin = start + np.arange(n)
        unlike[begin] = np.arange(n)
        unlike[-1] = n
        order = _suffix_ranks(unlike, n)
        before = text[order - 1]
        self.rows, self.n_words = len(text), n
        # (letter, rank) of all ranks, sorted: how often a letter precedes the suffixes below a rank, plus all smaller letters, is one search
        self.places = np.sort(before * self.rows + np.arange(self.rows))
        self.before = before

    def grown(self, low: np.ndarray, high: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches with one letter more on the left; letter 0 is the delimiter."""
        key = letter * self.rows
        return np.searchsorted(self.places, key + low), np.searchsorted(self.places, key + high)

    def any_grown(self, low: np.ndarray, high: np.ndarray):
        """(which, letter, low, high) of each letter, not the delimiter, that stands on the left of each interval: tried one by one in wide intervals, read off in narrow ones."""
        narrow = high - low <= self.sigma
        some = np.flatnonzero(narrow)
        n = high[some] - low[some]
        which = np.repeat(some, n)
        ranks = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[some], n)
        pair = np.unique(which * (self.sigma + 1) + self.before[ranks]) if len(ranks) else np.zeros(0, np.int64)
        wide = np.flatnonzero(~narrow)
        pair = np.concatenate((pair, (wide[:, None] * (self.sigma + 1) + np.arange(1, self.sigma + 1)).ravel()))
        which, letter = pair // (self.sigma + 1), pair % (self.sigma + 1)
        real = letter > 0
        which, letter = which[real], letter[real]
        a, z = self.grown(low[which], high[which], letter)
        there = z > a
        return which[there], letter[there], a[there], z[there]


class Search:
    """One half of the scheme over distinct words in the order of their letters: `side` 0 matches first halves and grows to the right, 1 second halves and to the left."""

    def __init__(self, indexed: pa.Array, side: int):
        words = Letters(indexed)
        self.alphabet, self.side = words.alphabet, side
        # growing to the right is growing to the left in the words read backwards, which are sorted anew
        if side == 0:
            backwards = pa.compute.utf8_reverse(indexed)
            self.word_of = np.argsort(np.array(backwards.to_pylist(), object), kind="stable")
            words = Letters(backwards.take(pa.array(self.word_of)), self.alphabet)
        else:
            self.word_of = np.arange(len(indexed))
        self.index = Index(words.code, words.start, words.size, len(self.alphabet))

    def near(self, queries: pa.Array):
        """Portions of (query, indexed word) of all pairs at one error in the half that is not matched exactly; the exact one may be repeated there."""
        for k in range(0, len(queries), PORTION):
            part = queries.slice(k, PORTION)
            for q, w in self._portion(part):
                yield q + k, w

    def _portion(self, part: pa.Array):
        ix, q = self.index, Letters(part if self.side else pa.compute.utf8_reverse(part), None)
        # letters that the index lacks match nothing
        code = np.searchsorted(self.alphabet, q.alphabet)
        code[code == len(self.alphabet)] = 0
        code = np.append(0, np.where(self.alphabet[code] == q.alphabet, code + 1, len(self.alphabet) + 1))[q.code]
        # the letters are matched from the last to the first; those before `border` may hold the error
        first = q.size // 2
        border = q.size - first if self.side == 0 else first
        low, high = np.zeros(len(part), np.int64), np.full(len(part), ix.n_words + 1)
        at, live = q.size.copy(), np.arange(len(part))
        while len(live := live[(at[live] > border[live]) & (high[live] > low[live])]):
            at[live] -= 1
            low[live], high[live] = ix.grown(low[live], high[live], code[q.start[live] + at[live]])
        live = np.flatnonzero(high > low)
        pending, held = [], 0
        while len(live):
            # an error here: a letter of the word is missing, another stands for it, or one more stands before the next
            which, letter, a, z = ix.any_grown(low[live], high[live])
            w = live[which]
            pending.append((w, at[w], a, z))
            held += len(w)
            here = at[live] > 0
            replaced = here[which]
            own = code[q.start[w] + np.maximum(at[w] - 1, 0)]
            other = replaced & (letter != own)
            pending.append((w[other], at[w[other]] - 1, a[other], z[other]))
            left = live[here]
            pending.append((left, at[left] - 1, low[left], high[left]))
            held += int(other.sum()) + len(left)
            # no error here
            at[left] -= 1
            low[left], high[left] = ix.grown(low[left], high[left], code[q.start[left] + at[left]])
            live = left[high[left] > low[left]]
            if held > STATES:
                yield from self._finished(pending, q, code)
                pending, held = [], 0
        if pending:
            yield from self._finished(pending, q, code)

    def _finished(self, pending, q: Letters, code: np.ndarray):
        """States (query, letters left, interval) that have had their error, grown to their words."""
        word, at, low, high = (np.concatenate(x) for x in zip(*pending, strict=True))
        live = np.arange(len(word))
        while len(live := live[(at[live] > 0) & (high[live] > low[live])]):
            at[live] -= 1
            low[live], high[live] = self.index.grown(low[live], high[live], code[q.start[word[live]] + at[live]])
        done = high > low
        word, low, high = word[done], low[done], high[done]
        low, high = self.index.grown(low, high, np.zeros(len(word), np.int64))
        done = high > low  # one rank: words are unlike
        yield word[done], self.word_of[low[done] - 1]  # the first delimiter, before which nothing stands, counts as one that follows another


# --- jobs ----------------------------------------------------------------------------------------


def _dealt(vocabulary: DataFrame, tables: Tables) -> tuple[DataFrame, int]:
    """(side, part of a half, word, n, searched, indexed): a row for each half under which a word is searched for or indexed, and their number."""
    m = F.length("word")
    # (length of the word searched for, whether it is this one)
    roles = F.array(F.struct(m.alias("m"), F.lit(True).alias("searched")), F.struct((m - 1).alias("m"), F.lit(False).alias("searched")), F.struct((m + 1).alias("m"), F.lit(False).alias("searched")))
    each = vocabulary.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.m", "r.searched", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    first = F.floor(F.col("m") / 2).cast("int")
    half = F.when(F.col("side") == 0, F.substr("word", F.lit(1), first)).otherwise(F.substr("word", first + F.length("word") - F.col("m") + 1, F.col("m") - first))
    rows = tables.put(each.withColumn("half", half), "halves")
    limit = TASK_WORDS
    many = rows.groupBy("side", "m", "half").agg(F.count("*").alias("c")).where(F.col("c") > limit)
    # at most a limit-th of all rows are such halves
    wide = tables.put(many.select("side", "m", "half", F.ceil(F.col("c") / limit).cast("int").alias("parts")), "wide")
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("word"), parts).cast("int")
    spread = rows.join(wide, ["side", "m", "half"], "left").withColumn("own", own)
    spread = spread.withColumn("part", F.explode(F.when(F.col("searched"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array("own"))))
    return spread.select("side", "m", "half", "part", "word", "n", "searched", (F.col("part") == F.col("own")).alias("indexed")), rows.count()


FOUND = "word string, n long, n_near long, form_n long, form string"


def _searcher(ratio: int):
    """For each word searched for in a task: the number of its near words there, and the best of those with `ratio` times its occurrences."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        for side in (0, 1):
            mine = rows.filter(pa.compute.equal(rows["side"], side))
            if not mine.num_rows:
                continue
            indexed = mine.filter(mine["indexed"]).group_by("word").aggregate([("n", "max")]).sort_by("word").combine_chunks()
            asked = mine.filter(mine["searched"]).group_by("word").aggregate([("n", "max")]).combine_chunks()
            if not asked.num_rows:
                continue
            queries, own = asked["word"].combine_chunks(), asked["n_max"].to_numpy()
            count, best = np.zeros(len(queries), np.int64), np.full(len(queries), -1, np.int64)
            if indexed.num_rows:
                words, n = indexed["word"].combine_chunks(), indexed["n_max"].to_numpy()
                # words are sorted, so of those with the same n the first is the smallest
                order = np.lexsort((np.arange(len(n)), -n))
                place = np.empty(len(n), np.int64)
                place[order] = np.arange(len(n))
                none = len(n)
                top, search = np.full(len(queries), none, np.int64), Search(words, side)
                for q, w in search.near(queries):
                    pair = np.unique(q * none + w)
                    q, w = pair // none, pair % none
                    keep = _counted(queries, words, q, w, side)
                    q, w = q[keep], w[keep]
                    count += np.bincount(q, minlength=len(queries))
                    np.minimum.at(top, q, place[w])
                best = np.where(top < none, order[np.minimum(top, none - 1)], -1)
                good = (best >= 0) & (n[best] >= ratio * own)
                form = words.take(pa.array(np.where(good, best, 0), mask=~good))
                form_n = pa.array(n[best], mask=~good)
            else:
                form, form_n = pa.nulls(len(queries), pa.string()), pa.nulls(len(queries), pa.int64())
            yield pa.RecordBatch.from_arrays([queries, pa.array(own), pa.array(count), form_n, form], names=["word", "n", "n_near", "form_n", "form"])

    return run


def _counted(queries: pa.Array, words: pa.Array, q: np.ndarray, w: np.ndarray, side: int) -> np.ndarray:
    """Whether a pair is no word with itself, and one that its side counts: an error in a run of like letters may be told as one in either half, and is one of the second."""
    a, b = queries.take(pa.array(q)), words.take(pa.array(w))
    unlike = pa.compute.not_equal(a, b).to_numpy(zero_copy_only=False)
    if side == 0:
        return unlike
    half = pa.compute.utf8_length(a).to_numpy() // 2
    agree = np.fromiter((x[:h] == y[:h] for x, y, h in zip(a.to_pylist(), b.to_pylist(), half.tolist(), strict=True)), bool, len(half))
    return unlike & ~agree


def near_words(vocabulary: DataFrame, tables: Tables, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of each word of a vocabulary (word, n) without repeated words; words of fewer than 4 letters are not to be in it."""
    spark = vocabulary.sparkSession
    small_batches(spark, 10_000)
    dealt, n = _dealt(vocabulary, tables)
    tasks = max(1, -(-n // TASK_WORDS), min(-(-n // 256), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = dealt.repartition(tasks, "side", "m", "half", "part").mapInArrow(_searcher(ratio), FOUND)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))))
    out = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n", "n_near", F.col("b.form").alias("form"), (-F.col("b.n")).alias("form_n"))


def with_roots(forms: DataFrame, tables: Tables, ratio: int = RATIO) -> DataFrame:
    """Adds root: the last word that forms lead to; a word without a form is its own.

    Each step follows twice as many forms as the one before. Occurrences grow by `ratio` with each form, so steps are few; a word is the form
    of no more words than have one letter unlike, so no key is hot."""
    edges = forms.where("form is not null").select("word", F.col("form").alias("root"))
    edges = tables.put(edges, "roots-0")
    depth = math.log(max(2, forms.agg(F.max("n")).first()[0] or 2), ratio)
    for k in range(1, max(1, math.ceil(math.log2(max(2.0, depth)))) + 1):
        further = edges.select(F.col("word").alias("root"), F.col("root").alias("next"))
        edges = tables.put(edges.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"roots-{k}")
        tables.drop(f"roots-{k - 1}")
    return forms.join(edges, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: int = DAMAGE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word of docs; no other column of docs is read.

    Null, empty and wordless texts add nothing, very long texts and words are whole, rows that repeat count as often, a null id damages
    as `null`, and an empty table gives no words. With rate=0 no letter is deleted. min_length is 4 at least, so that halves are not empty."""
    if min_length < 4:
        raise ValueError("min_length must be 4 at least")
    tables = Tables(docs.sparkSession, "spelling")
    vocabulary = tables.put(word_counts(docs, doc_id, text, rate, min_length, min_count), "vocabulary")
    forms = tables.put(near_words(vocabulary, tables, ratio), "forms")
    out = tables.put(with_roots(forms, tables, ratio).select("word", "form", "root", "n", "n_near", "form_n"), "variants")
    tables.keep("variants")
    return out
