"""Principal components of tens of thousands of columns, by subspace iteration with distributed products.

No matrix of columns x columns exists. A block Q of k directions (columns x k) goes to the tasks; each multiplies its centred rows X with it and sums X^T (X Q), and
sums are dealt by blocks of columns, so that the driver gets one columns x k product, however many tasks there are. Its
orthonormal basis is the next Q; Q^T X^T X Q holds the Ritz values, which end the iteration when they stand still. As long as the directions so far do not
hold the share that is asked for, k doubles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.session import ship

#: Columns of a block of sums, and values of a row that carries a part of a block.
BLOCK = 512
PARTIAL = "block long, values array<double>"
#: Directions to begin with, and those beyond the needed ones, which let the needed ones settle sooner.
START, SPARE = 16, 8


@dataclass
class Components:
    """mean (columns), directions (columns x components), the variance along each, the variance of all columns, and how many directions exceed the variance 1."""

    mean: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    total: float
    kaiser: int

    @property
    def shares(self) -> np.ndarray:
        return self.variances / self.total if self.total > 0 else self.variances


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch of arrays as a matrix; a null or one of another length is an error, null values too."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(column.flatten(), np.float64)
    if column.null_count or len(values) != width * len(column) or np.isnan(values).any():
        raise ValueError(f"every row needs {width} values")
    return values.reshape(len(column), width)


def _summed(rows: DataFrame, width: int, shape: tuple[int, int], add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches x of add(x), of a fixed shape: summed in the tasks, then block by block, each by one task."""
    n, k = shape

    def partial(batches):
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += add(_matrix(b.column(0), width))
        for at in range(0, n, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK]), pa.array([total[at : at + BLOCK].ravel()], pa.list_(pa.float64()))], names=["block", "values"])

    def merged(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.asarray(v.values, np.float64)
                sums[block] = sums[block] + x if block in sums else x
        for block, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([x], pa.list_(pa.float64()))], names=["block", "values"])

    blocks = -(-n // BLOCK)
    out = np.zeros(shape)
    for r in rows.mapInArrow(partial, PARTIAL).repartition(min(blocks, 64), "block").mapInArrow(merged, PARTIAL).collect():  # one product
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.asarray(r["values"]).reshape(-1, k)
    return out


def principal_components(df: DataFrame, share: float = 0.95, features: str = "features", kaiser: bool = False, tolerance: float = 1e-10, most_passes: int = 100, seed: int = 0) -> Components:
    """F13 for arrays of any width: the fewest components that hold `share` of the variance.

    df is read once for each pass: give a stored table. With kaiser=True all directions of a variance above 1 are found and counted; else those among the found ones. An empty table and one of
    equal rows have no components. The driver and each task hold columns x components numbers; components never exceed rows - 1 or columns."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(features).cast("array<double>").alias("x"))
    first = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = first.n, first.d or 0
    none = Components(np.zeros(d), np.zeros((d, 0)), np.zeros(0), 0.0, 0)
    if n < 2 or not d:
        return none
    moments = _summed(rows, d, (d, 1), lambda x: x.sum(0)[:, None])
    mean = moments[:, 0] / n
    total = float(_summed(rows, d, (d, 1), lambda x: ((x - mean) ** 2).sum(0)[:, None]).sum()) / (n - 1)
    if total <= 0:
        return none
    rank, r = min(d, n - 1), np.random.default_rng(seed)
    k = min(rank, START)
    q = np.linalg.qr(r.normal(size=(d, k)))[0]
    before = np.zeros(0)
    for _ in range(most_passes):
        shared = spark.sparkContext.broadcast(q)

        def product(x):
            c = x - mean
            return c.T @ (c @ shared.value)

        y = _summed(rows, d, (d, q.shape[1]), product) / (n - 1)
        shared.destroy()
        values, turn = np.linalg.eigh(q.T @ y)
        order = np.argsort(-values)
        values, directions = values[order].clip(0), q @ turn[:, order]
        held = np.cumsum(values) / total
        need = int(np.searchsorted(held, share - 1e-12)) + 1
        wide = len(values) == rank
        enough = wide or (need + SPARE <= len(values) and not (kaiser and values[-1 - SPARE // 2] > 1))
        need = min(need, len(values))
        still = len(before) >= need and np.abs(values[:need] - before[:need]).max() <= tolerance * values[0]
        if enough and (still or len(values) == d):
            return Components(mean, directions[:, :need], values[:need], total, int((values > 1).sum()))
        q = np.linalg.qr(y)[0]
        if not enough and (still or held[-1] < share):
            more = min(rank, 2 * q.shape[1]) - q.shape[1]
            q = np.linalg.qr(np.concatenate((q, r.normal(size=(d, more))), axis=1))[0]
        before = values
    raise ArithmeticError("the components did not settle")


def project(df: DataFrame, c: Components, features: str = "features", name: str = "pca") -> DataFrame:
    """Adds `name`, the row's coordinates along the components."""
    ship(df.sparkSession)
    width, shared = len(c.mean), df.sparkSession.sparkContext.broadcast((c.mean, c.directions))
    kept = df.drop(name)
    out = T.StructType([*kept.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    at = kept.columns.index(features)

    def run(batches):
        mean, directions = shared.value
        for b in batches:
            y = (_matrix(b.column(at).cast(pa.list_(pa.float64())), width) - mean) @ directions if b.num_rows else np.zeros((0, directions.shape[1]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(y), pa.list_(pa.float64()))], names=out.names)

    return kept.mapInArrow(run, out)
