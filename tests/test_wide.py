"""Tables of many columns, against the forms with a column of its own for each value."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import cohort as C
from cohortlake.operators import features as X
from cohortlake.operators import pca as PC
from cohortlake.operators import stats as A
from cohortlake.operators import wide as W

COLUMNS = 4384


def _cells(r, samples=30, genes=6):
    return [(f"s{i}", f"g{g}", [float(r.randint(0, 9)), None if r.random() < 0.2 else r.random()]) for i in range(samples) for g in range(genes) if r.random() < 0.6]


def test_vectors_are_pivots(spark):
    """gene_vectors() holds what pivot_features() puts into columns; repeated cells, missing genes, samples without and with all genes."""
    r = random.Random(1)
    rows = _cells(r) + [("all", f"g{g}", [float(g), 0.5]) for g in range(6)] + [("s0", "other", [1.0, 1.0])]
    genes = [f"g{g}" for g in range(6)]
    df = spark.createDataFrame(rows, "ID string, gene string, values array<double>")
    ids = spark.createDataFrame([(f"s{i}",) for i in range(32)] + [("all",)], "ID string")
    long = df.select("ID", "gene", F.get("values", F.lit(0)).alias("a"), F.get("values", F.lit(1)).alias("b"))
    pivot = {x.ID: x for x in C.pivot_features(long, genes, ["a", "b"]).collect()}
    got = {x.ID: x.features for x in W.gene_vectors(df, genes, 2, ids=ids).collect()}
    assert len(got) == 33
    names = W.vector_columns(genes, ["a", "b"])
    for i, v in got.items():
        assert v == ([pivot[i][n] for n in names] if i in pivot else [None] * 12)
    twice = df.unionByName(df.select("ID", "gene", F.transform("values", lambda x: x + 100).alias("values")))
    assert {x.ID: x.features for x in W.gene_vectors(twice, genes, 2, ids=ids).collect()} == got
    defaults = spark.createDataFrame([("g1", [7.0, 8.0]), ("g5", [9.0, None])], "gene string, values array<double>")
    base = [None, None, 7.0, 8.0, None, None, None, None, None, None, 9.0, None]
    with_defaults = {x.ID: x.features for x in W.gene_vectors(df, genes, 2, ids=ids, defaults=defaults).collect()}
    have = {(i, int(g[1:])) for i, g, _ in rows if g != "other"}
    for i, v in with_defaults.items():
        assert v == [got[i][k] if (i, k // 2) in have else base[k] for k in range(12)]
    assert W.gene_vectors(df.limit(0), genes, 2).count() == 0


def test_saac_vectors(spark):
    """F1 with WT defaults is the pivot of all cells."""
    r = random.Random(2)
    genes = [f"g{g}" for g in range(5)]
    cells = [(f"s{i}", "abc"[i % 3], g, r.choice(["WT", "WT", "A1T", "nan", None])) for i in range(25) for g in genes]
    long = spark.createDataFrame(cells, "ID string, SUBCLASS string, gene string, mutation_str string")
    table = spark.createDataFrame([(g, m, [float(k), float(len(m or ""))]) for k, g in enumerate(genes) for m in ("WT", "A1T", "nan") if (g, m) != ("g3", "nan")], "gene string, mutation_str string, values array<double>")
    got = {x.ID: (x.SUBCLASS, x.features) for x in W.saac_vectors(long, table, genes, 2).collect()}
    value = {(x.gene, x.mutation_str): x["values"] for x in table.collect()}
    for i in range(25):
        mine = {g: m for s, _, g, m in cells if s == f"s{i}"}
        assert got[f"s{i}"] == ("abc"[i % 3], [v for g in genes for v in value.get((g, mine[g]), [None, None])])


def test_thousands_of_columns(spark, tmp_path):
    """4,384 columns from a Parquet file: constants and scaling agree with numpy, within three minutes."""
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    names = [f"c{k}" for k in range(COLUMNS)]
    x = np.random.default_rng(3).normal(size=(60, COLUMNS)).round(3)
    x[:, 5] = 2.5
    x[0, 7] = np.nan
    pq.write_table(pa.Table.from_pandas(pd.DataFrame({"ID": range(60), **{n: pd.Series(x[:, k]) for k, n in enumerate(names)}}), preserve_index=False), tmp_path / "wide.parquet")
    df = spark.read.parquet(str(tmp_path / "wide.parquet"))
    began = time.time()
    assert [c[0] for c in W.constant_columns_wide(df, names).collect()] == ["c5"]
    scaled = W.standardize_wide(df, df, names)[0]
    got = np.array([[np.nan if v is None else v for v in y.features] for y in sorted(scaled.collect(), key=lambda y: y.ID)], float)
    mean, dev = np.nanmean(x, 0), np.nanstd(x, 0, ddof=1)
    dev[dev < 1e-12] = 1
    assert np.allclose(got, (x - mean) / dev, equal_nan=True)
    assert time.time() - began < 180


def test_wide_forms_are_the_narrow_ones(spark):
    rows = [("1", 1.0, None, 3.0), ("2", 4.0, 2.0, 3.0), ("3", None, 5.0, 3.0)]
    df = spark.createDataFrame(rows, "ID string, a double, b double, c double")
    names = ["a", "b", "c"]
    for narrow, broad in ((X.min_max_scale, W.min_max_scale_wide), (X.standardize, W.standardize_wide)):
        for one, other in zip(narrow(df, df, names), broad(df, df, names), strict=True):
            got = {x.ID: x.features for x in other.collect()}
            for x in one.collect():
                assert got[x.ID] == pytest.approx([x.a, x.b, x.c])
    assert {x[0] for x in W.constant_columns_wide(df, names).collect()} == {x[0] for x in C.constant_columns(df, names).collect()} == {"c"}
    strings = df.select("ID", *(F.col(c).cast("string").alias(c) for c in names))
    flags = {x.ID: x.flags for x in W.binarize_wide(strings.withColumn("a", F.lit("WT")), names).collect()}
    assert flags == {i: [0, 1, 1] for i in "123"}
    assert sorted(map(tuple, W.unpivot_wide(strings).collect())) == sorted(map(tuple, C.unpivot_cohort(strings).collect()))
    assert W.min_max_scale_wide(df.limit(0), df, names)[1].first().features == [None, None, None]


def _array_rows(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i int, features array<double>").repartition(3)


def test_components_are_those_of_mllib(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 12)) @ r.normal(size=(12, 12)) + 3
    rows = _array_rows(spark, x)
    columns = [f"x{k}" for k in range(12)]
    train = rows.select("i", *(F.get("features", F.lit(k)).alias(c) for k, c in enumerate(columns)))
    out, _, kaiser = X.pca_variance(train, train, columns)
    c = PC.principal_components(rows, kaiser=True)
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(c.variances, want[: len(c.variances)], rtol=1e-6) and c.kaiser == kaiser == (want > 1).sum()
    got = {y.i: y.pca for y in PC.project(rows, c).collect()}
    mine = {y.i: y.pca for y in out.collect()}
    assert len(c.variances) == len(mine[0])
    # MLlib projects without centring, and signs are free
    shift = c.mean @ c.directions
    a, b = (np.array([v[i] for i in range(300)]) for v in (got, mine))
    assert np.allclose(np.abs(a + shift), np.abs(b), atol=1e-5)


def test_components_of_twenty_thousand_columns(spark):
    r = np.random.default_rng(5)
    x = (r.normal(size=(60, 6)) * [9, 7, 5, 4, 3, 2]) @ r.normal(size=(6, 20_000)) + r.normal(size=(60, 20_000)) * 0.3
    c = PC.principal_components(_array_rows(spark, x), 0.95)
    values = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2 / 59
    need = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.95)) + 1
    assert len(c.variances) == need and np.allclose(c.shares, values[:need] / values.sum(), atol=1e-6)
    assert c.directions.shape == (20_000, need)


def test_components_of_odd_tables(spark):
    assert len(PC.principal_components(_array_rows(spark, np.ones((5, 3)))).variances) == 0
    assert len(PC.principal_components(spark.createDataFrame([], "features array<double>")).variances) == 0
    one = PC.principal_components(_array_rows(spark, [[1.0, 0.0], [3.0, 0.0]]))
    assert one.variances.tolist() == pytest.approx([2.0]) and one.shares.tolist() == pytest.approx([1.0])


def test_codes_and_correlation(spark):
    r = random.Random(6)
    rows = [(i, r.choice("abc"), None if r.random() < 0.3 else str(r.randint(0, 40)), "k") for i in range(200)]
    df = spark.createDataFrame(rows, "row long, a string, b string, c string")
    got = {x.row: (x.a, x.b, x.c) for x in A.factorize(df, ["a", "b", "c"], "row").collect()}
    want = []
    for k in (1, 2, 3):
        seen = {}
        want.append([-1 if x[k] is None else seen.setdefault(x[k], len(seen)) for x in rows])
    assert [got[i] for i in range(200)] == list(zip(*want, strict=True))
    long = df.select("row", F.explode(F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b"), F.lit("c"), F.col("c"))).alias("column", "value"))
    x = A.vector_correlation(A.code_vectors(A.factorize_long(long), ["a", "b", "c"]), ["a", "b", "c"])
    r = {(y.a, y.b): y.r for y in x.collect()}
    assert r["a", "b"] == pytest.approx(np.corrcoef(want[0], want[1])[0, 1]) and r["a", "c"] is None and len(r) == 3


def test_pca_query(spark):
    import pyarrow.parquet as pq

    from cohortlake.plans import catalog

    x = np.array(pq.read_table("/root/testdata/sf0.001/embeddings.parquet")["embedding"].to_pylist(), float)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    shares = values / values.sum()
    got = [r.share for r in catalog.QUERIES["pca_subspace"](spark, "/root/testdata/sf0.001").orderBy("component").collect()]
    assert len(got) == int(np.searchsorted(np.cumsum(shares), 0.95)) + 1 and np.allclose(got, shares[: len(got)], atol=2e-6)
