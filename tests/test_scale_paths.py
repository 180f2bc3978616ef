"""Ways that are chosen by size, skew or kind of row give what the plain way gives."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import proteins as P
from cohortlake.operators import cohort as C
from cohortlake.operators import features as X
from cohortlake.operators import joins as J
from cohortlake.operators import samples as S
from cohortlake.operators import sequences as Q

LONG = "ID string, SUBCLASS string, gene string, mutation_str string"


def _edits(r):
    letters = "ACDE"
    one = lambda: r.choice(letters)

    def token():
        a, b = r.randint(0, 14), r.randint(0, 14)
        return r.choice([f"{r.choice(letters + '*')}{a}{r.choice(letters + '*')}", f"{one()}{a}del", f"{r.choice(letters + '-')}{a}fs", f"{a}fs", f"{one()}{a}delins{one()}{one()}", f"{one()}{a}_{one()}{b}del", f"{one()}{a}_{one()}{b}ins{one()}A", f"{a}_{b}{one()}{one()}>AC", f"{one()}{a}_{b}insQ", f"{one()}{a}_{one()}{b}delinsAC", f"{one()}{a}{one()}fs", "WT", "junk"])

    rows = []
    for i in range(3000):
        wild = None if i % 60 == 0 else "".join(r.choice(letters + ("*" if r.random() < 0.03 else "")) for _ in range(r.randint(0, 12)))
        m = " ".join(token() for _ in range(r.choice([1, 1, 1, 2, 3]))) if i % 3 else " ".join(f"{one()}{r.randint(1, 12)}{one()}" for _ in range(r.randint(1, 3)))
        rows.append((i, wild, m))
    return rows


def test_simple_edits(spark):
    """Edits by string functions against the list of letters, for all strings that they take."""
    rows = _edits(random.Random(1))
    d = spark.createDataFrame(rows, "i int, wt_seq string, mutation_str string").where(F.col("mutation_str").rlike(P.SIMPLE) & ~F.coalesce(F.col("wt_seq").contains("*"), F.lit(False)))
    got = {x.i: (x.n, x.s) for x in d.select("i", P.simple_length(F.col("wt_seq"), F.col("mutation_str")).alias("n"), P.simple_mutated(F.col("wt_seq"), F.col("mutation_str")).alias("s")).collect()}
    assert len(got) > 1000
    for i, wild, m in rows:
        if i in got:
            want = wild if m == "WT" else P.mutated(wild, m)
            assert got[i] == (None if want is None else len(want), want), (wild, m)


def test_isoform_choice_over_both_ways(spark):
    iso = spark.createDataFrame([("uniprot", "g", "P1", 0, "ACDE"), ("uniprot", "g", "P2", 1, "AC*DEAC"), ("ncbi", "g", "N", 2, "ACDEACDE")], "db string, gene string, isoform_id string, isoform_ord int, wt_seq string")
    words = ["WT", "A1C", "A1del", "C2*", "A1_C2insDD", "1_2AC>E", "A1C C2A", "nan", "A1C 1_2CC>A"]
    got = {r.mutation_str: (r.isoform_id, r.mut_seq) for r in Q.add_mutated_sequences(spark.createDataFrame([("g", w) for w in words] + [("none", "WT")], "gene string, mutation_str string"), iso).where("gene = 'g'").collect()}
    for w in words:
        made = [(name, seq if w == "WT" else P.mutated(seq, w)) for name, seq in (("P1", "ACDE"), ("P2", "AC*DEAC"))]
        assert got[w] == max((x for x in made if x[1]), key=lambda x: len(x[1])), w


def test_parse_edit(spark):
    tokens = {"A5T": ("substitution", "A", 5, None, "T"), "*5A": ("substitution", "*", 5, None, "A"), "A5*": ("stop", "A", 5, None, "*"), "A5del": ("deletion", "A", 5, None, None), "62fs": ("frameshift", None, 62, None, None), "A5delinsGG": ("replacement", "A", 5, None, "GG"), "12_14AA>AG": ("range_swap", "AA", 12, 14, "AG"), "A1_C9del": ("range_deletion", None, 1, 9, None), "A1_C2insQ": ("insertion", None, 1, 2, "Q"), "A123_124insQ": ("half_insertion", "A", 123, 124, "Q"), "A1_C2delinsQ": ("range_replacement", None, 1, 2, "Q"), "D9Tfs": ("changed_frameshift", "D", 9, None, None), "292_293del": None, "WT": None}
    got = {r.t: None if r.e is None else tuple(r.e) for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", P.parse_edit(F.col("t")).alias("e")).collect()}
    assert got == tokens


def test_sweep_counts(spark):
    r = random.Random(2)
    rows = [(i, None if i % 50 == 0 else "".join(r.choice(P.STANDARD + "X") for _ in range(r.choice([0, 1, 4, 5, 6, 7, 9, 10, 25, 60]))), r.choice(["A1fs", "A1T", None])) for i in range(150)]
    q, cuts = spark.createDataFrame(rows, "i int, seq string, mutation_str string"), [0.05, 0.1, 0.2, 0.3, 0.5]
    got = {(x.i, x.cutoff): x.saac for x in Q.saac_sweep(q, cuts).collect()}
    for c in cuts:
        for x in q.select("i", P.saac(F.col("seq"), F.col("mutation_str"), c).alias("s")).collect():
            assert got[x.i, c] == pytest.approx(x.s)


def test_cross_match_ways(spark):
    """A string of very many genes goes by the genes, others by the strings."""
    r = random.Random(3)
    cells = [(str(i), "x", f"g{g}", r.choice(["nan", "WT", f"A{r.randint(1, 3)}T"])) for i in range(40) for g in r.sample(range(30), 4)]
    full = [(f"g{g}", m, g) for g in range(30) for m in ("nan", "A1T", "A2T", "A9T")]
    long, table = spark.createDataFrame(cells, LONG), spark.createDataFrame(full, "gene string, mutation_str string, k int")
    got = sorted((x.ID, x.gene, x.mutation_str, x.k) for x in S.sample_mutation_match(long, table).collect())
    mine = {i: ({g for j, _, g, m in cells if j == i and m != "WT"}, {m for j, _, _, m in cells if j == i and m != "WT"}) for i, *_ in cells}
    assert got == sorted((i, g, m, k) for i, (genes, words) in mine.items() for g, m, k in full if g in genes and m in words)


def test_cross_match_with_hot_keys(spark, monkeypatch):
    """A string of a tenth of the samples and a gene of half of them, cut into a grid, give what small keys give."""
    r = random.Random(5)
    cells = [(str(i), "x", f"g{g}", "hot" if r.random() < 0.1 else f"A{r.randint(1, 9)}T") for i in range(300) for g in {0 if i % 2 else 1, *r.sample(range(40), 3)}]
    full = [(f"g{g}", m) for g in range(40) for m in ("hot", "A1T", "A2T", "A9T", "A99T")] + [("g0", None)]
    long, table = spark.createDataFrame(cells, LONG), spark.createDataFrame(full, "gene string, mutation_str string")
    monkeypatch.setattr(J, "HEAVY_KEYS", 50)
    got = sorted(map(tuple, S.sample_mutation_match(long, table).select("ID", "gene", "mutation_str").collect()))
    genes, words = {}, {}
    for i, _, g, m in cells:
        genes.setdefault(i, set()).add(g)
        words.setdefault(i, set()).add(m)
    assert got == sorted((i, g, m) for i in genes for g, m in full if g in genes[i] and m in words[i])


def test_grid_join_is_even(spark):
    """A key of half of both sides: the same rows as a plain join, and no task with many more than others."""
    left = J.stored(spark.range(6000).select(F.when(F.col("id") % 2 == 0, "h").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("a")), "left")
    right = J.stored(spark.range(600).select(F.when(F.col("id") % 2 == 0, "h").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("b")), "right")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    made = J.grid_join(left, right, ["k"], "a", "b", parts=20)
    tasks = [x["count"] for x in made.groupBy(F.spark_partition_id()).count().collect()]
    assert made.exceptAll(left.join(right, "k")).count() == 0 and sum(tasks) == 3000 * 300 + 300
    for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.unset(c)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(tasks) == 16 and max(tasks) < 3 * sum(tasks) / 16


def test_attach_matches_nulls(spark):
    long = spark.createDataFrame([("1", "x", "g", None), ("2", "x", "g", "WT"), ("3", "x", "g", "nan"), ("4", "x", "g", "A1T"), ("5", "x", "h", "WT")], LONG)
    table = spark.createDataFrame([("g", None, 0), ("g", "WT", 1), ("g", "nan", 2), ("g", "A1T", 3)], "gene string, mutation_str string, v int")
    assert {r.ID: r.v for r in C.attach(long, table).collect()} == {"1": 0, "2": 1, "3": 2, "4": 3, "5": None}
    assert {r.ID: r.code for r in X.label_encode_cells(long).collect()} == {"1": 0, "4": 1, "2": 2, "3": 3, "5": 0}


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
def test_split_is_exact(spark, share):
    from pyspark.sql import Window

    rows = [(str(i), None if i % 9 == 0 else "abc"[i % 3] if i else "lone") for i in range(400)]
    df = spark.createDataFrame([*rows, ("only", "one")], "ID string, SUBCLASS string")
    want = df.withColumn("is_val", F.percent_rank().over(Window.partitionBy("SUBCLASS").orderBy(F.sha2("ID", 256), "ID")) < share)
    assert sorted(map(str, X.train_val_split(df, share).collect())) == sorted(map(str, want.collect()))


def test_score_parts(spark, monkeypatch):
    """Running sums over many or two parts of the scores, ties and classes without a positive included."""
    r = random.Random(4)
    rows = [("ab"[i % 2], round(r.random(), 2), int(r.random() < 0.3)) for i in range(2000)] + [("none", 0.5, 0), ("all", 0.1, 1)]
    df = spark.createDataFrame(rows, "class string, score double, positive int")
    got = {x["class"]: (x.roc_auc, x.average_precision) for x in X.roc_pr_by_class(df).collect()}
    monkeypatch.setattr(X, "SCORE_PARTS", 2)
    two = {x["class"]: (x.roc_auc, x.average_precision) for x in X.roc_pr_by_class(df).collect()}
    for c in "ab":
        mine = [(s, p) for k, s, p in rows if k == c]
        pos, neg = [s for s, p in mine if p], [s for s, p in mine if not p]
        area = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert got[c] == pytest.approx(two[c]) and got[c][0] == pytest.approx(area)
    assert got["none"] == (None, None) and got["all"] == (None, 1.0)
