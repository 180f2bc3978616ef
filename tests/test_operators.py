"""Operators that the SQL comparison leaves out, and traps of the data model."""

import math

import numpy as np
from pyspark.sql import functions as F

from cohortlake.functions import mutations as M
from cohortlake.operators import cohort as C
from cohortlake.operators import embeddings as E
from cohortlake.operators import features as X
from cohortlake.operators import samples as S
from cohortlake.operators import sequences as Q
from cohortlake.operators import stats as A

LONG = "ID string, SUBCLASS string, gene string, mutation_str string"


def cohort(spark):
    return spark.createDataFrame([("1", "x", "WT", "A1T"), ("2", "y", None, "WT"), ("3", "x", "A1T Q5*", "WT")], "ID string, SUBCLASS string, g1 string, g2 string")


def test_missing_cells(spark):
    long = C.unpivot_cohort(cohort(spark))
    assert long.where("mutation_str = 'nan'").count() == 1
    null = C.unpivot_cohort(cohort(spark), null_as=None)
    assert C.mutated_only(null).count() == 3  # null is not WT
    assert {tuple(r) for r in A.mutation_frequency(null).collect()} == {("g1", 1, 2, 0.5), ("g2", 1, 3, 1 / 3)}
    assert {tuple(r) for r in A.label_mutation_counts(null).collect()} == {("x", "g1", 1), ("y", "g1", 1), ("x", "g2", 1), ("y", "g2", 0)}


def test_choice_of_isoform(spark):
    iso = [
        ("uniprot", "a", "P1", 0, "ACD"), ("uniprot", "a", "P2", 1, "ACDE"),
        ("uniprot", "b", "P1", 0, "ACD"), ("uniprot", "b", "P2", 1, "GGGGG"),
        ("uniprot", "c", "P1", 0, "ACD"), ("uniprot", "c", "P2", 1, "ACE"),
        ("uniprot", "d", "P1", 0, "ACD"), ("ncbi", "d", "NP_1", 0, "ACDEF"),
    ]
    isoforms = spark.createDataFrame(iso, "db string, gene string, isoform_id string, isoform_ord int, wt_seq string")
    keys = [(g, m) for g in "abcde" for m in ("A1T", "WT", "-1fs")]
    got = {(r.gene, r.mutation_str): (r.isoform_id, r.mut_seq) for r in Q.add_mutated_sequences(spark.createDataFrame(keys, "gene string, mutation_str string"), isoforms).collect()}
    assert got[("a", "A1T")] == ("P2", "TCDE")
    assert got[("b", "A1T")] == ("P2", "GGGGG")
    assert got[("c", "A1T")] == ("P1", "TCD")
    assert got[("d", "A1T")] == ("P1", "TCD")
    assert got[("a", "WT")] == ("P2", "ACDE")
    assert got[("a", "-1fs")] == got[("e", "A1T")] == (None, None)
    best = {(r.db, r.gene): r.isoform_id for r in Q.select_longest_isoform(isoforms.union(spark.createDataFrame([("ensembl", "a", "ENSP1.2", 0, "AAAA"), ("ensembl", "a", "ENSP1.10", 1, "A"), ("ensembl", "b", "X", 0, "A"), ("other", "a", "Z", 0, "AC")], isoforms.schema))).collect()}
    assert best[("uniprot", "b")] == "P2" and best[("ensembl", "a")] == "ENSP1.10" and best[("ensembl", "b")] == "X" and best[("other", "a")] == "Z"


def test_match_pair_within_cross(spark):
    long = spark.createDataFrame([("1", "x", "g1", "A1T"), ("1", "x", "g2", "C2D"), ("2", "y", "g1", "WT")], LONG)
    full = spark.createDataFrame([("g1", "A1T"), ("g1", "C2D"), ("g2", "C2D"), ("g2", "E9E")], "gene string, mutation_str string")
    cross = {tuple(r) for r in S.sample_mutation_match(long, full).select("ID", "gene", "mutation_str").collect()}
    pair = {tuple(r) for r in S.sample_mutation_match(long, full, "pair").select("ID", "gene", "mutation_str").collect()}
    assert pair == {("1", "g1", "A1T"), ("1", "g2", "C2D")} and cross == pair | {("1", "g1", "C2D")}


def test_records_and_vectors(spark):
    long = spark.createDataFrame([("1", "x", "g1", "A1T"), ("1", "x", "g2", "C2D"), ("2", "y", "g1", "WT")], LONG)
    enc = C.encode_mutations(C.mutation_dictionary(long))
    full = C.full_feature_table(enc, enc.select("gene", "mutation_str", F.concat(F.lit("I"), "gene").alias("isoform_id"), F.lit("ACD").alias("wt_seq"), F.lit("TCD").alias("mut_seq")))
    store = spark.createDataFrame([("Ig1", [1.0, 2.0]), ("Ig1_A1T", [2.0, 4.0]), ("Ig2", [0.0, 0.0]), ("Ig2_C2D", [3.0, -1.0])], "key string, embedding array<float>")
    records = S.sample_records(long, full, E.embedding_differences(full, store, 2))
    one = records.where("ID = '1'").first()
    assert one.mutation_stats.num_mutated_genes == 2 and one.mutation_stats.mutation_type_freq == {"Missense": 2}
    assert one.embedding_stats["mean"] == [2.0, 0.5] and [round(x, 6) for x in one.embedding_stats["std"]] == [round(math.sqrt(2), 6), round(math.sqrt(4.5), 6)]
    two = records.where("ID = '2'").first()
    assert two.mutation_stats is None and two.embedding_stats is None
    vectors = {r.ID: r.features for r in S.record_vector(records, 2).collect()}
    assert len(vectors["1"]) == len(vectors["2"]) == 3 + 20 + 8 + 11 + 2
    assert vectors["2"][0] == 1 and sum(vectors["2"]) == 1
    assert vectors["1"][3 + 20 + 8 + M.TYPES.index("Missense")] == 1.0


def test_single_difference_has_no_deviation(spark):
    d = spark.createDataFrame([("g", "m", [1.0, 2.0])], "gene string, mutation_str string, diff array<float>")
    m = spark.createDataFrame([("1", "g", "m")], "ID string, gene string, mutation_str string")
    assert S.sample_embedding_stats(m, d).first()["std"] == [0.0, 0.0]


def test_tensor(spark):
    rows = spark.createDataFrame([("1", "g1", "m", "Missense", 3, 0, [7, 9, 11, 1, 2, 5], 0.5), ("1", "g2", "m", "Delins", 1, 1, [2], None)], "ID string, gene string, mutation_str string, type string, mut_num int, status int, position array<int>, hydrophobicity_mean double")
    rows = rows.withColumns({f"{p}_mean": F.lit(1.0) for p in M.PROPERTIES[1:]})
    long = S.normalize_positions(S.sample_rows(rows, X.index_genes(spark, ["g1", "g2"]), 2))
    t = {r.ID: r.tensor for r in S.sample_tensor(long, spark.createDataFrame([("1",), ("2",)], "ID string"), 3).collect()}
    assert t["2"] == [[0.0] * 14] * 3
    assert t["1"] == [[1, 1, 3, 0, 0.5, 1, 1, 1, 1, 1, 1, 1, 1, 1], [2, 0, 1, 1, 0, 1, 1, 1, 1, 2 / 7, 0, 0, 0, 0], [0.0] * 14]


def test_failing_batches_are_reported(spark):
    def encoder():
        def encode(seqs):
            if any("X" in s for s in seqs):
                raise ValueError("bad letter")
            return np.array([[len(s)] for s in seqs])

        return encode

    df = spark.createDataFrame([("a", "AC"), ("b", "X"), ("c", "ACD")], "key string, seq string").coalesce(1)
    got = {r.key: (r.embedding, r.error) for r in E.embed_sequences(df, encoder, batch_size=1).collect()}
    assert got == {"a": ([2.0], None), "b": (None, "ValueError: bad letter"), "c": ([3.0], None)}


def test_pooling(spark):
    df = spark.createDataFrame([([[1.0, -5.0], [3.0, -7.0], [100.0, 100.0]], [1, 1, 0])], "t array<array<float>>, m array<int>")
    pool = lambda s: df.select(E.pool_token_embeddings(F.col("t"), F.col("m"), s).alias("v")).first().v
    assert pool("mean_max_cls") == [2, -6, 3, -5, 1, -5]
    assert pool("preserve_length") == [-2, -2, 100, 1, 3, 100]
    assert pool("full") == [1, -5, 3, -7, 100, 100]


def test_pca_and_forest(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(200, 1))
    x = np.hstack([a * 3, a * 3 + rng.normal(size=(200, 1)) * 0.01, rng.normal(size=(200, 1)) * 0.5])
    df = spark.createDataFrame([(i, *map(float, r), int(r[0] > 0)) for i, r in enumerate(x)], "ID int, x0 double, x1 double, x2 double, y int")
    train, _, kaiser = X.pca_variance(df, df, ["x0", "x1", "x2"])
    assert len(train.first().pca) == 1 and kaiser == 1
    binary = df.select((F.col("x0") > 0).cast("int").alias("x0"), (F.col("x2") > 0).cast("int").alias("x2"), "y")
    assert X.rf_importance(binary, ["x0", "x2"], "y", 10).where("rank = 1").first().feature == "x0"


def test_cramers_v_with_two_labels(spark):
    """Two labels: Yates' correction; 10:2 against 3:9 gives chi-square 6.0419."""
    rows = [(str(i), "x" if i < 12 else "y", "g", "A1T" if i < 10 or 12 <= i < 15 else "WT") for i in range(24)]
    o, e = np.array([[10, 2], [3, 9]]), np.array([[6.5, 5.5], [6.5, 5.5]])
    want = math.sqrt((((abs(o - e) - 0.5) ** 2 / e).sum()) / 24)
    never = [(str(i), "x" if i % 2 else "y", "h", "WT") for i in range(6)]
    got = {r.gene: r.v for r in A.cramers_v(spark.createDataFrame(rows + never, LONG)).collect()}
    assert abs(got["g"] - want) < 1e-12 and got["h"] is None


def test_saac_regions_sum_to_100(spark):
    df = spark.createDataFrame([("ACDEFGHIKLMNPQRSTVWY" * k, "A1T") for k in range(1, 6)], "seq string, mutation_str string")
    for r in Q.saac_sweep(df).collect():
        for k in range(3):
            assert round(sum(r.saac[21 * k : 21 * k + 21]), 9) in (0, 100)


def test_no_python_in_plans(spark):
    """Only sequence edits, pooling and encoders run in Python; nothing is a cartesian product."""
    long = spark.createDataFrame([("1", "x", "g1", "A1T")], LONG)
    enc = C.encode_mutations(C.mutation_dictionary(long))
    for df in (enc, C.attach_encoding(long, enc), A.hotspots(long), A.cramers_v(long), S.sample_records(long, enc.withColumn("status_prot", F.lit(0)))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_pooling_of_odd_tokens(spark):
    """Nulls, empty and ragged lists, nulls in the mask, all masked, and rows of several widths in one batch."""
    rows = [
        (0, [[1.0, 2.0], [3.0, 0.0]], [True, True]), (1, None, [True]), (2, [], []), (3, [[1.0], [1.0, 2.0]], [True, True]), (4, [[1.0, 2.0, 3.0]], [True]),
        (5, [[1.0, 5.0], [9.0, 9.0]], [True, None]), (6, [[1.0, 2.0]], [False]), (7, [[1.0, None]], [True]), (8, [[1.0, 2.0]], None), (9, [None, [1.0]], [True, True]), (10, [[]], [True]),
    ]
    df = spark.createDataFrame(rows, "i int, t array<array<float>>, m array<boolean>").coalesce(1)
    got = {r.i: r.v for r in df.select("i", E.pool_token_embeddings(F.col("t"), F.col("m")).alias("v")).collect()}
    assert got[0] == [2.0, 1.0, 3.0, 2.0, 1.0, 2.0] and got[4] == [1.0, 2.0, 3.0] * 3 and got[5] == [1.0, 5.0, 1.0, 5.0, 1.0, 5.0]
    assert got[6] == [0.0, 0.0, -1e9, -1e9, 1.0, 2.0] and got[7] == [1.0, 0.0, 1.0, 0.0, 1.0, 0.0]
    assert [got[i] for i in (1, 2, 3, 8, 9, 10)] == [None] * 6
    other = {r.i: (r.p, r.f) for r in df.select("i", E.pool_token_embeddings(F.col("t"), F.col("m"), "preserve_length").alias("p"), E.pool_token_embeddings(F.col("t"), F.col("m"), "full").alias("f")).collect()}
    assert other[3] == ([1.0, 1.5, 1.0, 2.0], [1.0, 1.0, 2.0]) and other[1] == other[2] == (None, None) and other[10] == ([None, None], [])


def test_first_sequences(spark):
    """Train before test, the least isoform, null keys, equal rows; and no sequence is dealt before the winners are known."""
    schema = "gene string, mutation_str string, isoform_id string, wt_seq string, mut_seq string"
    train = spark.createDataFrame([("g", "A1T", "I2", "W", "M2"), ("g", "A1T", "I1", "W", "M1"), ("g", "WT", "I1", "W", "x"), (None, None, "I1", "W", "N"), ("g", "A1T", "I1", "W", "M1")], schema)
    test = spark.createDataFrame([("g", "A1T", "I0", "W", "M0"), ("h", "Q2*", "I5", "W", None)], schema)
    got = {(r.gene, r.mutation_str): (r.isoform_id, r.seq) for r in C.full_sequence_table(train, test).collect()}
    assert got == {("g", "A1T"): ("I1", "M1"), ("g", "WT"): ("I1", "W"), (None, None): ("I1", "N"), ("h", "Q2*"): ("I5", None)}
    assert C.full_sequence_table(train, test).count() == 4
