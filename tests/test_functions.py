"""Golden values of the mutation and sequence functions, traced by hand."""

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import mutations as M
from cohortlake.functions import proteins as P

TYPES = {
    "A123T": "Missense", "L145L": "Silent_Missense", "Q581*": "Nonsense", "*363*": "Silent_Nonsense",
    **dict.fromkeys(["P34fs", "-62fs", "34fs", "A123fs*5", "D989Tfs", "AKL23fs"], "Frameshift"),
    **dict.fromkeys(["490del", "A123del", "N162_Q172del", "292_293del"], "Deletion"),
    **dict.fromkeys(["C1479_T1480insFND", "A123_124insQ"], "Insertion"),
    **dict.fromkeys(["L12delinsRV", "D401_L713delinsG"], "Delins"),
    "12_13AA>AG": "Missense", "12_13AA>AA": "Missense", "12_13AA>**": "Nonsense", "49_50WE>*K": "Complex_mutation",
    "*123A": "Unknown", "A123": "Unknown", "nan": "Unknown", "WT": "WT", "": "WT", "WT A1T": "Missense", "A1T A1T": "Missense", "A123T Q581*": "Complex_mutation",
}
PARSED = {
    "A123T 1499_1500HL>HL Q581*": ("AHLQ", [123, 1499, 1500, 581], ["T", "H", "L", "*"]),
    "A123T L123K L123K": ("AL", [123, 123], ["T", "K"]),
    "WT": ("", [], []), "nan": ("", [], []),
    "P34fs": ("P", [34], ["fs"]), "P34fs*12": ("P", [34], ["fs*12"]), "-62fs": ("-", [62], ["fs"]),
    "AKL23fs": (["AKL"], [23], ["fs"]), "A123": ("A", [123], []), "A123del": ("A", [123], ["-"]), "490del": ("", [490], ["-"]),
    "490del A123T": ("A", [490, 123], ["-", "T"]), "292_293del": ("", [292, 293], ["-", "-"]),
    "N162_Q172del": ("NQ", list(range(162, 173)), ["-"] * 11), "L12delinsRV": ("L", [12], ["-", "R", "V"]),
    "C1479_T1480insFND": ("CT", [1479, 1480], list("CFNDT")), "A123_124insQ": ("AA", [123, 124], list("AQA")),
    "D401_L403delinsG": ("DL", [401, 402, 403], list("---G")), "D989Tfs": ("", [], []), "A0T": ("A", [], ["T"]),
}
ERRORS = ["12_14AA>AG", "62fs", "WT A1T", "*"]
DELTAS = {
    "WT": (0, None, None, None, 0), "A123T": (0, -2.5, -2.5, -2.5, 0), "A123T L145L": (0, -2.5, 0, -1.25, 1.25), "Q581*": (1, None, None, None, 0),
    "A123T Q581*": (1, -2.5, -2.5, -2.5, 0), "490del": (0, None, None, None, 0), "490del A123T": (1, None, None, None, 0), "C1479_T1480insFND": (0, 0, 3.5, 1.75, 1.75),
}
WILD = "ACDEFGHIKL"
MUTATED = {
    "A1T": "TCDEFGHIKL", "A1T C2W": "TWDEFGHIKL", **dict.fromkeys(["C1T", "L12K", "foo", "3fs", "*11*", "3_5del", "D3_4insW"], WILD),
    **dict.fromkeys(["D3*", "D3fs", "-3fs", "*3*", "D3Wfs", "3_4DE>*W", "D3* A1T"], "AC"), "-1fs": "", "*3W": "ACWEFGHIKL", "D3del": "ACEFGHIKL",
    "D3del F5W": "ACEFGHIKL", "D3_F5del": "ACGHIKL", "D3_E4insWW": "ACDEWWFGHIKL", "D3delinsWY": "ACWYEFGHIKL", "D3delinsWY F5W": "ACWYEWGHIKL",
    "D3_F5delinsW": "ACWGHIKL", "3_4DE>WW": "ACWWFGHIKL", "A1T D3*": "TC", "L0T": "ACDEFGHIKT",
}


def rows(spark, values, **columns):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return {r.s: r for r in df.select("s", *(c.alias(n) for n, c in columns.items())).collect()}


def test_classify(spark):
    got = rows(spark, TYPES, kind=M.classify_mutations(F.col("s")))
    assert {k: v.kind for k, v in got.items()} == TYPES


def test_positions(spark):
    got = rows(spark, ["A123T", "N162_Q164del", "A123_129insQ", "5_3AA>AG", "WT", "fsX", "490del"], p=M.mutation_positions(F.col("s")))
    assert [got[k].p for k in ("A123T", "N162_Q164del", "A123_129insQ", "5_3AA>AG", "WT", "fsX", "490del")] == [[123], [162, 163, 164], [123, 129], [], None, None, [490]]


def test_parse(spark):
    got = rows(spark, [*PARSED, *ERRORS], p=M.parse_mutations(F.col("s")))
    for s, (origin, position, mutant) in PARSED.items():
        p = got[s].p
        assert (p.origin, p.position, p.mutant, p.parse_error) == (list(origin), position, mutant, None), s
    for s in ERRORS:
        p = got[s].p
        assert p.parse_error and (p.origin, p.position, p.mutant) == ([], [], []), s


def test_deltas(spark):
    p = M.parse_mutations(F.col("s"))
    change = M.aa_changes(M.classify_mutations(F.col("s")), p["origin"], p["mutant"])
    got = rows(spark, DELTAS, status=change["status"], **M.aa_change_stats(change["deltas"], "hydrophobicity"))
    for s, (status, *stats) in DELTAS.items():
        assert got[s].status == status
        assert list(got[s])[2:] == [x if x is None else pytest.approx(x) for x in stats], s


def test_names_and_digits(spark):
    got = rows(spark, ["A", "*", "x", "12_14AA>AG Q5* fs Q5*"], name=M.aa_name(F.col("s")), digits=M.digits_positions(F.col("s")))
    assert [got[k].name for k in ("A", "*", "x")] == ["Alanine", "Stop Codon", "Unknown"]
    assert got["12_14AA>AG Q5* fs Q5*"].digits == [1214, 5, 5]


def test_mutate(spark):
    got = rows(spark, MUTATED, m=P.mutate_sequence(F.lit(WILD), F.col("s")))
    assert {k: v.m for k, v in got.items()} == MUTATED


def test_long_cells(spark):
    """A cell of 20,000 substitutions, and one that ends in a token of another kind: no pattern goes deeper with each token."""
    import random

    r = random.Random(6)
    wild = "".join(r.choice(P.STANDARD) for _ in range(3000))
    points = [f"{wild[k % 3000]}{k % 3000 + 1}{P.STANDARD[k % 20]}" for k in range(20_000)]
    cells = [" ".join(points), " ".join([*points[:5000], "x"])]
    df = spark.createDataFrame([(wild, c) for c in cells], "w string, m string")
    got = df.select(F.col("m").rlike(P.SIMPLE).alias("simple"), P.simple_mutated(F.col("w"), F.col("m")).alias("s"), P.simple_length(F.col("w"), F.col("m")).alias("n")).collect()
    assert [x.simple for x in got] == [True, False]
    assert got[0].s == P.mutated(wild, cells[0]) and got[0].n == len(got[0].s)


def test_saac(spark):
    cases = [("ACDEF", "A1T", 0.2), ("ACDEF", "A1fs", 0.2), ("ACDEF", "A1T", 0.1), ("ACD", "x", 0.2), (None, "A1fs", 0.2)]
    df = spark.createDataFrame(cases, "seq string, m string, cut double")
    got = [{c: round(x, 2) for c, x in zip(P.SAAC_COLUMNS, r.a, strict=True) if x} for r in df.select(P.saac(F.col("seq"), F.col("m"), F.col("cut")).alias("a")).collect()]
    mid = {"mid_C": 33.33, "mid_D": 33.33, "mid_E": 33.33}
    assert got == [{"n_term_A": 100, **mid, "c_term_F": 100}, {"n_term_A": 100, **mid, "c_term_F": 50, "c_term_fs": 50}, {f"c_term_{c}": 20 for c in "ACDEF"}, {f"n_term_{c}": 33.33 for c in "ACD"}, {}]
