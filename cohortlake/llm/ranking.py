"""Quality scores learned from preferences: a Bradley-Terry model over text statistics.

Of two labelled documents of unlike quality the better one is preferred. The model gives each document a score such that a preference has probability
1 / (1 + exp(-(score of the preferred - score of the other))). Its weights minimize the mean logistic loss of all preferences, each labelled document of the one
label against each of the other, plus a penalty. All labelled documents are learned from, and no list of pairs is made: what a document adds depends on the others by their scores alone, so
these are counted by label in narrow bins with their first two moments, and Newton's steps sum over documents what the counts of the other label tell for each. The passes
grow with the labelled documents, not with their pairs; what reaches the driver is bounded by BINS and the number of weights.

Features are statistics of the text alone, each with bends at its quantiles, so a score is a sum of piecewise
linear functions. They are computed by DataFrame functions for every document.
The threshold is a quantile of the scores of the labelled documents: the share of those of the lower quality. It and the bends are exact, found by place in sorted ranges. A last logistic curve puts scores
between 0 and 1, the threshold at THRESHOLD.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.session import ship

from .quality import STATISTICS, statistics
from .sharding import global_row_numbers
from .shared import Tables

#: Partners of each row where preferences are listed.
PARTNERS = 4
#: Quantiles of each feature at which its weight may change.
BENDS = [0.1, 0.25, 0.5, 0.75, 0.9]
THRESHOLD = 0.3
REGULARIZATION = 1e-3
#: Scores are counted in bins of WIDTH, or of a BINS-th of their range where that is more.
WIDTH = 1 / 16
BINS = 2048
#: Newton's steps end when the next would lessen the loss by less; a step may raise the loss by ROUGH, which is above what bins leave open.
TOLERANCE = 1e-12
ROUGH = 1e-7
#: Far more than Newton's steps need; a model that is not solved by then fails the query.
MOST_STEPS = 100
#: One in so many ids is held out.
FOLDS = 5
FEATURES = ["words", "word_length", "symbols", "repeats", "dup_lines", "distinct", "digits", "uppers", "stops", "lines", "others"]


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether the crc32 of the id as text is divisible by `folds`; false for null."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == 0, F.lit(False))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds x, an array of FEATURES (doubles); null counts as empty, and all are 0 without words."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, "[ \\t-\\r]+"), lambda w: w != "")
    kinds = F.size(F.array_distinct(words))
    rows = docs.withColumns({"__s": statistics(F.col(text)), "__kinds": kinds, "__digits": F.regexp_count(t, F.lit("[0-9]")), "__uppers": F.regexp_count(t, F.lit("[A-Z]")), "__stops": F.regexp_count(t, F.lit("[.!?,;:]")), "__lines": F.regexp_count(t, F.lit("\\n")), "__others": F.regexp_count(t, F.lit("[\\x00-\\x08\\x0E-\\x1F\"'()+/=@\\[\\\\\\]^_`{}~\\u007F-\\u00BF\\u2000-\\u2BFF\\uFFFD-]"))})
    s = {c: F.col(f"__s.{c}").cast("double") for c in STATISTICS}
    n, chars = F.greatest(s["n_words"], F.lit(1.0)), F.greatest(s["word_chars"], F.lit(1.0))
    made = [
        F.log1p(s["n_words"]),
        F.log(chars / n),
        F.log1p(10 * s["n_symbols"] / n),
        s["n_repeat_words"] / n,
        F.log1p(s["n_dup_lines"]),
        F.col("__kinds") / n,
        F.log1p(10 * F.col("__digits") / chars),
        F.log1p(10 * F.col("__uppers") / n),
        F.log1p(10 * F.col("__stops") / n),
        F.log1p(10 * F.col("__lines") / n),
        F.log1p(10 * F.col("__others") / chars),
    ]
    helpers = ["__s", "__kinds", "__digits", "__uppers", "__stops", "__lines", "__others"]
    return rows.withColumn("x", F.array(*(f.cast("double") for f in made))).drop(*helpers)


@dataclass
class Model:
    """Weights of each feature, and of its excess over each bend; the quantile of the labelled scores."""

    slopes: list[float]
    bends: list[list[tuple[float, float]]]
    cut: float = 0.0

    def raw(self, x: Column) -> Column:
        """The Bradley-Terry score of an array of features."""
        parts = [F.get(x, F.lit(i)) * w for i, w in enumerate(self.slopes)]
        parts += [F.greatest(F.get(x, F.lit(i)) - q, F.lit(0.0)) * w for i, bends in enumerate(self.bends) for q, w in bends]
        return sum(parts, F.lit(0.0))

    def score(self, x: Column) -> Column:
        """Between 0 and 1, THRESHOLD at the cut."""
        return 1 / (1 + F.exp(F.lit(self.cut) - self.raw(x) - math.log(THRESHOLD / (1 - THRESHOLD))))


def _expanded(x: Column, quantiles: list[list[float]]) -> list[Column]:
    """The features and their excesses over their bends."""
    return [F.get(x, F.lit(i)) for i in range(len(quantiles))] + [F.greatest(F.get(x, F.lit(i)) - q, F.lit(0.0)) for i, qs in enumerate(quantiles) for q in qs]


@dataclass
class Expansion:
    """_expanded() in an Arrow batch, each column times its factor."""

    quantiles: list[list[float]]
    factors: np.ndarray

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(self.quantiles))
        return np.hstack([x, *(np.maximum(x[:, [i]] - np.array(qs), 0.0) for i, qs in enumerate(self.quantiles) if qs)]) * self.factors


def preferences(sample: DataFrame, tables: Tables, partners: int = PARTNERS) -> DataFrame:
    """(better, worse), for learners that need a list of preferences, as fit() does not: arrays z of rows (id, label, z) of the sample. Each row meets `partners` rows of the other label, found by their numbers."""
    sides = []
    for label in (1, 0):
        rows, n = global_row_numbers(sample.where(F.col("label") == label).select("id", "z"), ["id"], tables, f"label-{label}", "row")
        sides.append((rows, n))
    (good, n_good), (bad, n_bad) = sides
    out = None
    for mine, other, n, mine_is in ((good, bad, n_bad, "better"), (bad, good, n_good, "worse")):
        theirs = "worse" if mine_is == "better" else "better"
        asked = mine.select(F.col("z").alias(mine_is), "row", F.explode(F.sequence(F.lit(1), F.lit(partners))).alias("k"))
        asked = asked.select(mine_is, F.pmod(F.xxhash64("row", "k", F.lit(mine_is)), F.lit(max(n, 1))).alias("row"))
        pairs = asked.join(other.select(F.col("z").alias(theirs), "row"), "row").select("better", "worse")
        out = pairs if out is None else out.union(pairs)
    return out


def _at_places(ranged: DataFrame, places: set[int]) -> DataFrame:
    """The rows of those numbers."""
    return ranged.where(F.col("row").isin([F.lit(p).cast("long") for p in places]))


def _bends(rows: DataFrame, n: int, tables: Tables) -> list[list[float]]:
    """Of each feature the distinct values at BENDS, exact: all values of the n rows lie in one order, by feature and value."""
    ranged, _ = global_row_numbers(rows.select(F.posexplode("x").alias("i", "v")), ["i", "v"], tables, "values")
    ranks = {max(0, math.ceil(q * n - 1e-9) - 1) for q in BENDS}
    found = _at_places(ranged, {i * n + r for i in range(len(FEATURES)) for r in ranks}).collect()
    return [sorted({r.v for r in found if r.i == i}) for i in range(len(FEATURES))]


def _summed(rows: DataFrame, task: Callable, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The arrays (keys, a row of `width` values for each) that task(batches) returns, summed by key over all tasks."""
    names = [f"v{i}" for i in range(width)]

    def run(batches):
        keys, values = task(batches)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(v, pa.float64()) for v in np.ascontiguousarray(values.T))], names=["key", *names])

    sums = rows.mapInArrow(run, ", ".join(["key int", *(f"{c} double" for c in names)])).groupBy("key").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    return sums.column("key").to_numpy(), np.column_stack([sums.column(c).to_numpy() for c in names])


def _logistic(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The logistic function and its first three derivatives."""
    p = 0.5 * (1 + np.tanh(0.5 * d))
    s = p * (1 - p)
    return p, s, s * (1 - 2 * p), s * (1 - 6 * s)


class Scores:
    """The scores of rows (x, label) under weights, counted in bins by label: what each row's preferences add to the loss.

    A bin stands for its rows by their number, mean and variance, and the values between its ends come from cubics through values and slopes. At WIDTH the errors
    are below 1e-7 of a preference's; they grow with the third power of the width."""

    def __init__(self, rows: DataFrame, expand: Expansion, weights: np.ndarray):
        self.rows, self.expand, self.weights = rows, expand, weights

        def ends(batches):
            s = [f(z) for b in batches if b.num_rows for z in (expand(b) @ weights,) for f in (np.min, np.max)]
            yield pa.RecordBatch.from_arrays([pa.array([min(s)] if s else [], pa.float64()), pa.array([max(s)] if s else [], pa.float64())], names=["low", "high"])

        low, high = rows.mapInArrow(ends, "low double, high double").agg(F.min("low"), F.max("high")).first()
        width = max(WIDTH, (high - low) / BINS)
        bins = int((high - low) / width) + 1
        self.low, self.width = low, width
        k = len(weights)

        def counted(batches):
            sums = np.zeros((2 * bins, 3 + k))
            for b in batches:
                if b.num_rows:
                    z = expand(b)
                    s = z @ weights - low
                    at = np.clip((s / width).astype(np.int64), 0, bins - 1)
                    off = s - (at + 0.5) * width
                    key = at + bins * (b.column("label").to_numpy(zero_copy_only=False) == 1)
                    order = np.argsort(key, kind="stable")
                    used, first = np.unique(key[order], return_index=True)
                    sums[used] += np.add.reduceat(np.column_stack([np.ones(len(s)), off, off * off, z])[order], first)
            used = np.flatnonzero(sums[:, 0])
            return used, sums[used]

        keys, sums = _summed(rows, counted, 3 + k)
        # for label 0 and 1: the share of the label's rows, mean and variance of their scores, and sums of z over the label's rows
        self.sides, self.n = [], []
        for label in (0, 1):
            mine = keys // bins == label
            n, off, square = sums[mine, :3].T
            mean = off / n
            self.n.append(n.sum())
            self.sides.append((n / n.sum(), low + (keys[mine] % bins + 0.5) * width + mean, np.maximum(square / n - mean * mean, 0.0), sums[mine, 3:] / n.sum()))
        nodes = low + width * np.arange(bins + 1)
        (n0, m0, v0, _), (n1, m1, v1, _) = self.sides
        p, s, t, u = _logistic(m0 - m1[:, None])
        self.loss = float(n1 @ (np.logaddexp(0.0, m0 - m1[:, None]) + 0.5 * s * (v0 + v1[:, None])) @ n0)
        self.slopes = s
        # for label 0 and 1, at the ends of the bins: the mean probability that a row loses as the worse, or should win as the better, and its derivative
        p, s, t, u = _logistic(nodes[:, None] - m1)
        worse = ((p + 0.5 * v1 * t) @ n1, (s + 0.5 * v1 * u) @ n1)
        p, s, t, u = _logistic(m0 - nodes[:, None])
        better = ((p + 0.5 * v0 * t) @ n0, -(s + 0.5 * v0 * u) @ n0)
        self.tables = (worse, better)

    def slope_and_curve(self) -> tuple[np.ndarray, np.ndarray]:
        """The gradient and the Hessian of the mean loss."""
        expand, weights, low, width, tables, k = self.expand, self.weights, self.low, self.width, self.tables, len(self.weights)

        def task(batches):
            sums = np.zeros((2, k, k + 1))
            for b in batches:
                if b.num_rows:
                    z = expand(b)
                    place = (z @ weights - low) / width
                    label = b.column("label").to_numpy(zero_copy_only=False)
                    for side, (value, slope) in enumerate(tables):
                        mine = label == side
                        zs, at = z[mine], np.clip(place[mine].astype(np.int64), 0, len(value) - 2)
                        r = place[mine] - at
                        start, end, rise, last = value[at], value[at + 1], width * slope[at], width * slope[at + 1]
                        level = start + r * (rise + r * (3 * (end - start) - 2 * rise - last + r * (2 * (start - end) + rise + last)))
                        steep = np.abs(rise + r * (last - rise)) / width
                        sums[side, :, :k] += zs.T @ (zs * steep[:, None])
                        sums[side, :, k] += zs.T @ level
            return np.arange(2 * k), sums.reshape(2 * k, k + 1)

        keys, sums = _summed(self.rows, task, k + 1)
        sums = sums[np.argsort(keys)].reshape(2, k, k + 1)
        sums = sums / np.array(self.n)[:, None, None]
        mixed = self.sides[1][3].T @ self.slopes @ self.sides[0][3]
        return sums[0, :, k] - sums[1, :, k], sums[0, :, :k] + sums[1, :, :k] - mixed - mixed.T


def _solve(rows: DataFrame, expand: Expansion) -> np.ndarray:
    """The weights of expand's columns that minimize the mean loss of all preferences among rows (x, label), with the penalty REGULARIZATION / 2 times the sum of their squares."""
    weights = np.zeros(len(expand.factors))
    step, gain, loss = weights, 0.0, math.inf
    for _ in range(MOST_STEPS):
        scores = Scores(rows, expand, weights + step)
        now = scores.loss + REGULARIZATION / 2 * float((weights + step) @ (weights + step))
        if now > loss + ROUGH:
            step = step / 2
            continue
        weights, loss = weights + step, now
        slope, curve = scores.slope_and_curve()
        slope = slope + REGULARIZATION * weights
        # no curvature is below the penalty's, whatever the bins leave open
        values, vectors = np.linalg.eigh(curve + REGULARIZATION * np.eye(len(weights)))
        step = -vectors @ (vectors.T @ slope / np.maximum(values, REGULARIZATION))
        gain = -float(slope @ step)
        if gain < TOLERANCE:
            return weights + step
    raise ArithmeticError("the preferences were not solved")


def fit(labelled: DataFrame, tables: Tables) -> Model:
    """The model of rows (id, x, label), all of them; null labels are left out, and without both labels all scores are alike."""
    ship(labelled.sparkSession)
    rows = tables.put(labelled.where("label is not null").select("x", "label"), "labelled")
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if good in (0, n):
        return Model([0.0] * len(FEATURES), [[] for _ in FEATURES])
    quantiles = _bends(rows, n, tables)
    scale = rows.select(*(F.stddev_pop(z).alias(f"s{i}") for i, z in enumerate(_expanded(F.col("x"), quantiles)))).first()
    factors = np.array([1 / s if s and s > 1e-9 else 0.0 for s in scale])
    weights = (_solve(rows, Expansion(quantiles, factors)) * factors).tolist()
    at, bends = len(FEATURES), []
    for qs in quantiles:
        bends.append([(q, weights[at + k]) for k, q in enumerate(qs)])
        at += len(qs)
    fitted = Model(weights[: len(FEATURES)], bends)
    # as many scores as there are rows of label 0 are at or below the quantile
    ranged, _ = global_row_numbers(rows.select(fitted.raw(F.col("x")).alias("raw")), ["raw"], tables, "scores")
    at = _at_places(ranged, {n - good - 1}).first()["raw"]
    above = ranged.where(F.col("raw") > at).agg(F.min("raw")).first()[0]
    fitted.cut = at if above is None else (at + above) / 2  # between the quantile and the score above it
    return fitted


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality", folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Learns from all labels (label_id, label 0 or 1) of ids that are not held out; labels of unknown ids, null ones and null ids teach nothing, an id labelled twice
    teaches twice, and rows that repeat an id are each learned from. Null and empty texts have features 0 and a score like others; very long texts are read whole.
    Without labels of both kinds all scores are equal. An empty table stays empty. No other column is read."""
    tables = Tables(docs.sparkSession, "ranking")
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = tables.put(features(narrow).select("doc_id", "x", held_out(F.col("doc_id"), folds).alias("held_out")), "features")
    taught = labels.select(F.col(label_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    learned = rows.where(~F.col("held_out")).join(taught, "doc_id").select(F.col("doc_id").alias("id"), "x", "label")
    model = fit(learned, tables)
    tables.keep("features")
    out = rows.withColumn("score", model.score(F.col("x")))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
