"""What keeps the work and the disk in proportion to the input."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import proteins as P
from cohortlake.operators import cohort as C
from cohortlake.operators import joins as J
from cohortlake.operators import samples as S
from cohortlake.operators import sequences as Q
from cohortlake.plans import adapters as D

ISOFORMS = "db string, gene string, isoform_id string, isoform_ord int, wt_seq string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_sequence_is_shuffled_with_the_dictionary(spark):
    """Isoforms travel once, and nothing travels after mutated sequences are made."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    plan = plan_of(D.full(spark, "/root/testdata/sf0.001"))
    for k in settings:
        spark.conf.unset(k)
    # lines, orders, the heads of isoforms, cells to their gene, and the isoforms
    assert plan.count("Exchange hashpartitioning") == 5, plan


def test_isoforms_in_chunks(spark, monkeypatch):
    """Rows of a gene over several chunks, swapped ranges and bare positions included, choose what the list of letters gives; so do genes with a stop in a sequence."""
    monkeypatch.setattr(Q, "CHUNK", 3)
    r = random.Random(7)
    word = lambda: "".join(r.choice("ACDE") for _ in range(r.randint(0, 9)))
    iso = [(r.choice(Q.DATABASES), f"g{k % 12}", f"i{k}", k, None if k % 9 == 0 else word() + ("*A" if k % 17 == 0 else "")) for k in range(60)]
    token = lambda: r.choice(["WT", f"p.{r.randint(1, 9)}", f"{r.choice('ACDE')}{r.randint(1, 9)}{r.choice('ACDE*')}", f"{(a := r.randint(1, 7))}_{a + r.randint(0, 2)}{r.choice('ACDE')}{r.choice('ACDE')}>{r.choice(['A', 'ACD', 'A*'])}", f"A{r.randint(1, 9)}del A1C"])
    rows = sorted({(f"g{r.randint(0, 12)}", token()) for _ in range(300)})
    got = {(x.gene, x.mutation_str): (x.isoform_id, x.wt_seq, x.mut_seq) for x in Q.add_mutated_sequences(spark.createDataFrame(rows, "gene string, mutation_str string"), spark.createDataFrame(iso, ISOFORMS)).collect()}
    assert len(got) == len(rows)
    for g, m in rows:
        made = [(Q.DATABASES.index(db), -len(s), o, i, w, s) for db, h, i, o, w in iso if h == g and w is not None for s in [w if m == "WT" else P.mutated(w, m)] if s]
        assert got[g, m] == (min(made)[3:] if made else (None, None, None)), (g, m)


@pytest.mark.parametrize("pairs, least", [(4096, 1000), (4096, 0), (20, 0), (0, 1000)])
def test_cross_match_by_pairs_and_degrees(spark, monkeypatch, pairs, least):
    """Samples of few and of many genes and strings, genes dealt over parts or not, a row of full that repeats, and nulls."""
    monkeypatch.setattr(S, "PAIRS", pairs)
    monkeypatch.setattr(S, "LEAST_HEAVY", least)
    monkeypatch.setattr(J, "HEAVY_KEYS", 30)
    r = random.Random(8)
    cells = [(str(i), f"g{g}", r.choice([None, "WT", "hot", f"A{r.randint(1, 5)}T"])) for i in range(80) for g in {0 if i % 2 else 1, *r.sample(range(20), 1 + i % 7)}]
    full = [(f"g{g}", m, g) for g in range(25) for m in ("hot", "A1T", "A2T", "A9T", None, "A1T")]
    got = sorted(tuple(x) for x in S.sample_mutation_match(spark.createDataFrame(cells, "ID string, gene string, mutation_str string"), spark.createDataFrame(full, "gene string, mutation_str string, k int")).select("ID", "gene", "mutation_str", "k").collect())
    genes, words = {}, {}
    for i, g, m in cells:
        if m is not None and m != "WT":
            words.setdefault(i, set()).add(m)
        if m != "WT":
            genes.setdefault(i, set()).add((g, m))
    mine = {i: {g for g, _ in v} for i, v in genes.items()}
    assert got == sorted((i, g, m, k) for i in words for g, m, k in full if m in words[i] and g in mine[i])
