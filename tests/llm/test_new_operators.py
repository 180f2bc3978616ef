"""Importance resampling, pairwise quality and spelling variants against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlake.llm import queries, ranking, resampling, shared, spelling
from cohortlake.llm.shared import Tables

from . import brute
from .test_operators import TEXTS
from .test_queries import ITEMS, ROWS, _by_id, sf  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string"


# --- 11 -----------------------------------------------------------------------------------------


def test_vector_hashes():
    r = random.Random(1)
    blobs = [r.randbytes(n) for n in [*range(300), 1000]]
    size = np.array([len(b) for b in blobs])
    data = np.frombuffer(b"".join(blobs) + bytes(8), np.uint8).copy()
    start = np.cumsum(size) - size
    assert resampling.xxhash64(data, start, size).tolist() == [xxhash.xxh64_intdigest(b) for b in blobs]
    twice = np.frombuffer(b"".join(blobs) * 2 + bytes(8), np.uint8).copy()
    other = start + len(data) - 8
    assert resampling.same_bytes(twice, start, other, size).all()
    twice[other[1:] + size[1:] - 1] ^= 1  # the last byte of each but the empty one
    assert not resampling.same_bytes(twice, start, other, size)[1:].any()


def _features(text):
    w = brute.ALNUM.findall(brute.lower(text))
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab é.", max_size=30), max_size=6))
def test_interned_grams(texts):
    """Counts, buckets and sums by slot are those of the features one by one."""
    words = shared.words_of(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), shared.ALNUM_WORD, lower=True)
    g = resampling.Grams(words)
    want = Counter(f for t in texts for f in _features(t)[0])
    got = Counter()
    for slot, n in zip(g.used, g.count, strict=True):
        o = g.owner[slot]
        got[bytes(g.data[g.start[o] : g.start[o] + g.length[o]]).decode()] = int(n)
    assert got == want
    gains = np.arange(resampling.BUCKETS) % 91 - 45.0
    assert g.gathered(gains, len(texts)).tolist() == [sum(int(gains[zlib.crc32(f.encode()) % 10_000]) for f in _features(t)[0]) for t in texts]


def test_equal_hashes_are_told_apart(monkeypatch):
    """N-grams whose hashes agree keep slots of their own, since their bytes are compared."""
    monkeypatch.setattr(resampling, "xxhash64", lambda data, start, length: np.full(len(start), 7, np.uint64))
    words = shared.words_of(pa.RecordBatch.from_arrays([pa.array(["a b a c b a", "c b " + "x" * 400])], names=["text"]), shared.ALNUM_WORD)
    g = resampling.Grams(words)
    assert len(g.used) == len(set(_features("a b a c b a")[0]) | set(_features("c b " + "x" * 400)[0]))
    assert g.count.sum() == len(g.start)


def _resampled(rows, items):
    """doc_id -> (n_features, weight, score, rank)."""
    f = [_features(t) for _, t, *_ in rows]
    s, t = Counter(zlib.crc32(x.encode()) % 10_000 for y, _ in f for x in y), Counter(zlib.crc32(x.encode()) % 10_000 for _, y in items for x in _features(y)[0])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    out = []
    for (i, *_), (x, n) in zip(rows, f, strict=True):
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[zlib.crc32(y.encode()) % 10_000] for y in x)
        out.append([i, len(x), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    order = sorted((k for k in range(len(out)) if out[k][4] >= 20), key=lambda k: (-out[k][3], out[k][0] is not None, out[k][0] or 0, out[k][1]))
    rank = {k: r + 1 for r, k in enumerate(order[: len(order) * 5 // 100])}
    return sorted((str(x[0]), *x[1:4], rank.get(k)) for k, x in enumerate(out))


def test_op11(spark, sf):  # noqa: F811
    got = queries.op11_interned_resampling(spark, sf).collect()
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score, r["rank"]) for r in got) == _resampled(ROWS, ITEMS)


def test_resampling_of_odd_rows(spark):
    """Null and repeated ids, equal rows, clashing columns, texts of one huge word, empty tables and an empty target; and the drawn rows themselves."""
    rows = [(None, TEXTS[7], "x"), (3, TEXTS[7], "x"), (3, TEXTS[7], "y"), (4, None, "x"), (5, "w" * 5000 + " a " + "w" * 5000, "x")] + [(100 + i, f"{TEXTS[7]} {i} {i * i}", "z") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    target = spark.createDataFrame([(TEXTS[8],), (None,), ("",)], "text string")
    got = resampling.importance(docs, target).collect()
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score, r["rank"]) for r in got) == _resampled(rows, [(0, TEXTS[8])])
    drawn = resampling.resample(docs, target)
    assert drawn.columns == docs.columns
    first = {str(r.doc_id) for r in got if r["rank"]}
    assert {str(r.doc_id) for r in drawn.collect()} == first and first
    none = resampling.importance(docs, target.limit(0)).collect()
    assert len(none) == len(rows) and all(r.n_features for r in none if r.doc_id != 4)
    assert resampling.importance(docs.limit(0), target).count() == 0


# --- 12 -----------------------------------------------------------------------------------------


def _quality_rows():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(r.randint(30, 90))) + "."
    bad = [lambda: " ".join(f"{word()}###" for _ in range(40)), lambda: " ".join([word()] * 50), lambda: " | ".join(word() for _ in range(20))]
    return [(i, *((good(), 1) if i % 3 else (r.choice(bad)(), 0))) for i in range(900)]


def test_op12(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = _quality_rows()
    odd = [(5000, None), (5001, ""), (5002, "x " * 30_000), (None, "no id here")]
    pq.write_table(pa.table({"doc_id": [i for i, *_ in rows] + [i for i, _ in odd], "text": [t for _, t, _ in rows] + [t for _, t in odd], "score": ["x"] * (len(rows) + 4)}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [i for i, *_ in rows] + [99_999], "quality": [q for *_, q in rows] + [1]}), tmp_path / "labels.parquet")
    got = queries.op12_pairwise_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 4
    label = {i: q for i, _, q in rows}
    held = [r for r in got if r.doc_id in label and r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len(held) > 100 and sum(r.predicted == label[r.doc_id] for r in held) >= 0.98 * len(held)
    better = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in held if label[a.doc_id] for b in held if not label[b.doc_id]]
    assert sum(better) >= 0.99 * len(better)
    again = {r.doc_id: r.score for r in queries.op12_pairwise_quality(spark, str(tmp_path)).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-6) for r in got)


def test_held_out_labels_teach_nothing(spark):
    """Turned labels of held-out documents change no score; source, lang and ids are not read."""
    rows = _quality_rows()[:300]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t, _ in rows], SCHEMA)
    true = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    turned = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, _, q in rows], "doc_id long, quality int")
    a, b = ({r.doc_id: r.score for r in ranking.score(docs, x).collect()} for x in (true, turned))
    assert a == pytest.approx(b, abs=1e-9)


def test_ranking_without_both_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    for labels in ([], [(i, 1) for i in range(20)], [(i, None) for i in range(20)]):
        got = ranking.score(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(got) == 20 and len({r.score for r in got}) == 1
    assert ranking.score(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_preferences_meet_partners(spark):
    """Each row of the sample meets PARTNERS rows of the other label; a sample of one class meets none."""
    rows = [(i, int(i % 4 > 0), [float(i)]) for i in range(80)]
    pairs = ranking.preferences(spark.createDataFrame(rows, "id long, label int, z array<double>"), Tables(spark, "test")).collect()
    assert len(pairs) == 80 * ranking.PARTNERS and all(p.better[0] % 4 > 0 and p.worse[0] % 4 == 0 for p in pairs)
    met = Counter(p.better[0] for p in pairs)
    assert all(met[i] >= ranking.PARTNERS for i in range(80) if i % 4)


def _labelled(spark, n):
    """Rows (id, label, x) whose features are hashes, higher for label 1; and the same as arrays."""
    label = (F.col("id") % 7 > 0).cast("int")
    x = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1_000_003)) / 1e6 + 0.2 * (i % 3) * label for i in range(len(ranking.FEATURES))]
    df = spark.range(0, n, 1, 4).select("id", label.alias("label"), F.array(*x).alias("x"))
    rows = df.collect()
    return df, np.array([r.x for r in rows]), np.array([r.label for r in rows])


def _columns(x, bends):
    """Features, their excesses over their bends."""
    return np.column_stack([x, *(np.maximum(x[:, i] - q, 0) for i, qs in enumerate(bends) for q in qs)])


def _preferred(z, label, w):
    """Mean loss of all pairs one by one, and its gradient."""
    good, bad = z[label == 1], z[label == 0]
    off = (bad @ w)[None, :] - (good @ w)[:, None]
    p = 0.5 * (1 + np.tanh(off / 2))
    return np.logaddexp(0, off).mean(), (p.mean(0) @ bad) / len(bad) - (p.mean(1) @ good) / len(good)


def test_bends_and_cut_are_of_all_labels(spark):
    """More labelled rows than were once learned from: each is in the quantiles of the features and of the scores."""
    n = 45_000
    df, x, label = _labelled(spark, n)
    model = ranking.fit(df, Tables(spark, "test"))
    for i, bends in enumerate(model.bends):
        assert [q for q, _ in bends] == [np.sort(x[:, i])[math.ceil(q * n - 1e-9) - 1] for q in ranking.BENDS]
    raw = np.sort(_columns(x, [[q for q, _ in b] for b in model.bends]) @ np.array(model.slopes + [w for b in model.bends for _, w in b]))
    low = int((label == 0).sum())
    assert model.cut == pytest.approx((raw[low - 1] + raw[low]) / 2, abs=1e-9)


def test_all_preferences_teach(spark):
    """The weights are the optimum over all pairs of unlike labels, not over some of them."""
    df, x, label = _labelled(spark, 500)
    model = ranking.fit(df, Tables(spark, "test"))
    z = _columns(x, [[q for q, _ in b] for b in model.bends])
    scale = z.std(0)
    w = np.array(model.slopes + [w for b in model.bends for _, w in b]) * scale
    assert np.abs(w).max() > 0.1
    assert np.abs(_preferred(z / scale, label, w)[1] + ranking.REGULARIZATION * w).max() < 1e-6


@pytest.mark.parametrize("spread", [0.0, 1.0, 30.0])
def test_counted_scores_give_loss_and_slope(spark, spread):
    """Bins of scores against all pairs one by one; with all scores alike, and with bins wider than WIDTH."""
    df, x, label = _labelled(spark, 300)
    bends = [[0.3, 0.6]] * len(ranking.FEATURES)
    z = _columns(x, bends)
    w = np.random.default_rng(5).normal(size=z.shape[1]) * spread
    scores = ranking.Scores(df, ranking.Expansion(bends, np.ones(len(w))), w)
    assert (scores.width > ranking.WIDTH) == (spread > 1)
    slope, curve = scores.slope_and_curve()
    loss, want = _preferred(z, label, w)
    assert scores.loss == pytest.approx(loss, rel=1e-6) and slope == pytest.approx(want, abs=1e-6)
    step = np.random.default_rng(6).normal(size=len(w)) * 1e-5
    if spread < 2:
        turned = (_preferred(z, label, w + step)[1] - _preferred(z, label, w - step)[1]) / 2
        assert curve @ step == pytest.approx(turned, abs=1e-2 * np.abs(turned).max())


# --- 13 -----------------------------------------------------------------------------------------


def _near(vocabulary):
    by = defaultdict(set)
    for w in vocabulary:
        for i in range(len(w)):
            by[i, w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for w in vocabulary:
        for i in range(len(w)):
            near[w] |= by[i, w[:i], w[i + 1 :]]
            if (d := w[:i] + w[i + 1 :]) in vocabulary:
                near[w].add(d)
                near[d].add(w)
        near[w].discard(w)
    return near


@settings(max_examples=80, deadline=None)
@given(st.sets(st.text("abé", min_size=4, max_size=9), min_size=1, max_size=60))
def test_search_finds_all_near_words(words):
    """Each pair at one inserted, deleted or replaced letter once, over both halves of the scheme; letters, lengths and runs of like letters."""
    words = sorted(words)
    column, got = pa.array(words), []
    for side in (0, 1):
        for q, w in spelling.Search(column, side).near(column):
            pair = np.unique(q * len(words) + w)
            q, w = pair // len(words), pair % len(words)
            keep = spelling._counted(column, column, q, w, side)
            got += [(words[a], words[b]) for a, b in zip(q[keep].tolist(), w[keep].tolist(), strict=True)]
    near = _near(set(words))
    assert sorted(got) == sorted((a, b) for a in words for b in near[a])


def test_search_in_small_states(monkeypatch):
    """Many states are finished in portions; very long words; letters that the index lacks."""
    monkeypatch.setattr(spelling, "STATES", 50)
    monkeypatch.setattr(spelling, "PORTION", 7)
    words = sorted({"a" * 3000, "a" * 3001, "a" * 1500 + "b" + "a" * 1500, *(f"word{x}{y}" for x in "abcd" for y in "efgh")})
    asked = pa.array([*words, "wordzz", "wordaz"])
    found = set()
    for side in (0, 1):
        for q, w in spelling.Search(pa.array(words), side).near(asked):
            found.update(zip(q.tolist(), w.tolist(), strict=True))
    assert {words[w] for q, w in found if q == len(words)} == set() and {words[w] for q, w in found if q == len(words) + 1} == {f"worda{y}" for y in "efgh"}
    long = {words[w] for q, w in found if words[min(q, len(words) - 1)] == "a" * 3000} - {"a" * 3000}
    assert long == {"a" * 3001, "a" * 1500 + "b" + "a" * 1500}


RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def _variants(rows, rate=199):
    count = Counter()
    for i, t, *_ in rows:
        for w in RUNS.findall(brute.lower(t)):
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if rate and h % rate == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += len(w) >= 6
    n = {w: c for w, c in count.items() if c >= 5}
    near, form = _near(set(n)), {}
    for w in n:
        if near[w] and n[best := min(near[w], key=lambda x: (-n[x], x))] >= 5 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def _variant_rows():
    r = random.Random(7)
    base = ["straße", "Éclairs", "wording", "wordings", "abcdefgh", "zzzzzz", "Ünderlay"]
    edit = lambda w: (lambda i: r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("aeé") + w[i:], w[:i] + r.choice("aeé") + w[i + 1 :]]))(r.randrange(len(w)))
    pool = [w for b in base for w in [b] * 200 + [edit(b) for _ in range(6)] * 8 + [edit(edit(b)) for _ in range(3)] * 6]
    r.shuffle(pool)
    rows = [(k, " ".join(pool[40 * k : 40 * k + 40]) + ", x1y", "en", "s") for k in range(len(pool) // 40)]
    return [*rows, rows[0], (None, rows[1][1], "en", "s"), (9000, None, "en", "s"), (9001, "", "en", "s"), (9002, "q" * 100_000 + " " + "wording;" * 3000, "en", "s"), *[(9100 + k, "y" * 2000 + " " + "y" * 2001, None, None) for k in range(6)]]


def _as_rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_op13(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = _variant_rows()
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "word": ["x"] * len(rows)}), tmp_path / "documents.parquet")
    want = _variants(rows)
    assert _as_rows(queries.op13_fm_variants(spark, str(tmp_path))) == want
    assert len(want) > 30 and sum(x[1] is not None for x in want) > 10 and any(x[2] != (x[1] or x[0]) for x in want)


def test_variants_over_many_tasks(spark, monkeypatch):
    """Halves of more words than a task takes are indexed in parts; the words searched for meet all of them."""
    monkeypatch.setattr(spelling, "TASK_WORDS", 8)
    rows = _variant_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    assert _as_rows(spelling.variants(docs, rate=0)) == _variants(rows, 0)
    assert spelling.variants(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(docs, min_length=3)
