"""Functions of mutation strings (`A123T Q58*`) as Spark columns.

All run on the distinct (gene, mutation_str) dictionary and need no Python. Digits and white space are the
ASCII ones. Cells that are null give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of the type classifier, in the order in which it is tried.
NONSENSE = r"^[A-Z]\d+\*$"
SUBSTITUTION = r"^[A-Z]\d+[A-Z]$"
SILENT_NONSENSE = r"^\*\d+\*$"
FRAMESHIFT = r"^[A-Z\-]?\d+fs.*$"
DELETION = r"^[A-Z]?\d+del$"
RANGE_DELETION = r"^[A-Z](\d+)_[A-Z](\d+)del$"
PLAIN_RANGE_DELETION = r"^(\d+)_(\d+)del$"
INSERTION = r"^[A-Z](\d+)_[A-Z](\d+)ins[A-Z]+$"
HALF_INSERTION = r"^[A-Z](\d+)_(\d+)ins[A-Z]+$"
DELINS = r"^[A-Z]\d+delins[A-Z]+$"
RANGE_DELINS = r"^[A-Z](\d+)_[A-Z](\d+)delins[A-Z]+$"
RANGE_SUBSTITUTION = r"^(\d+)_(\d+)[A-Z*]+>([A-Z*]+)$"
CHANGED_FRAMESHIFT = r"^[A-Z]\d+[A-Z]fs$"

# The grammar of the parser; the last three are open at the end.
P_POSITION_DELETION = r"^(\d+)del$"
P_SINGLE = r"^([A-Z*-]+)(\d+)([A-Z*]?|fs\*\d*|fs|del)?$"
P_RANGE = r"^(\d+)_(\d+)([A-Z*]{2,})>([A-Z*]{2,})$"
P_RANGE_DELETION = r"^([A-Z])(\d+)_([A-Z])(\d+)del$"
P_PLAIN_RANGE_DELETION = r"^(\d+)_(\d+)del$"
P_CHANGED_FRAMESHIFT = r"^([A-Z])(\d+)([A-Z])fs$"
P_INSERTION = r"^([A-Z])(\d+)_([A-Z])(\d+)ins([A-Z]+)$"
P_HALF_INSERTION = r"^([A-Z])(\d+)_(\d+)ins([A-Z]+)"
P_DELINS = r"^([A-Z])(\d+)delins([A-Z]+)"
P_RANGE_DELINS = r"^([A-Z])(\d+)_([A-Z])(\d+)delins([A-Z]+)"

# Amino acids with name, hydrophobicity, polarity, molecular weight, isoelectric point, charge.
AMINO_ACIDS = {
    "A": ("Alanine", 1.8, 0, 89.1, 6.0, 0),
    "R": ("Arginine", -4.5, 1, 174.2, 10.8, 1),
    "N": ("Asparagine", -3.5, 1, 132.1, 5.4, 0),
    "D": ("Aspartic Acid", -3.5, 1, 133.1, 2.8, -1),
    "C": ("Cysteine", 2.5, 0, 121.2, 5.1, 0),
    "Q": ("Glutamine", -3.5, 1, 146.2, 5.7, 0),
    "E": ("Glutamic Acid", -3.5, 1, 147.1, 3.2, -1),
    "G": ("Glycine", -0.4, 0, 75.1, 6.0, 0),
    "H": ("Histidine", -3.2, 1, 155.2, 7.6, 0),
    "I": ("Isoleucine", 4.5, 0, 131.2, 6.0, 0),
    "L": ("Leucine", 3.8, 0, 131.2, 6.0, 0),
    "K": ("Lysine", -3.9, 1, 146.2, 9.7, 1),
    "M": ("Methionine", 1.9, 0, 149.2, 5.7, 0),
    "F": ("Phenylalanine", 2.8, 0, 165.2, 5.5, 0),
    "P": ("Proline", -1.6, 0, 115.1, 6.3, 0),
    "S": ("Serine", -0.8, 1, 105.1, 5.7, 0),
    "T": ("Threonine", -0.7, 1, 119.1, 5.6, 0),
    "W": ("Tryptophan", -0.9, 0, 204.2, 5.9, 0),
    "Y": ("Tyrosine", -1.3, 0, 181.2, 5.7, 0),
    "V": ("Valine", 4.2, 0, 117.1, 6.0, 0),
}
STOP_NAME = "Stop Codon"
PROPERTIES = ["hydrophobicity", "polarity", "mw", "pI", "charge"]
STATISTICS = ["min", "max", "mean", "std"]

# The vocabularies of type codes; in the short one 0 is any other type.
TYPES = ["WT", "Silent_Missense", "Missense", "Nonsense", "Complex_mutation", "Frameshift", "Silent_Nonsense", "Deletion", "Insertion", "Delins", "Unknown"]
SHORT_TYPES = ["Missense", "Nonsense", "Frameshift", "Silent_Nonsense", "Silent_Missense", "Deletion", "Complex_mutation"]


def _strings(*items: Column | str) -> Column:
    return F.array(*(x if isinstance(x, Column) else F.lit(x) for x in items)).cast("array<string>")


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _group(t: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(t, pattern, k)


def _number(t: Column, pattern: str, k: int) -> Column:
    # no cast of '', which costs an exception a row
    return F.nullif(_group(t, pattern, k), F.lit("")).try_cast("int")


def _signs(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit("."), F.lit(0))


def _range(a: Column, b: Column) -> Column:
    """a..b, empty if a > b; null if either is null."""
    return F.when(a <= b, F.sequence(a, b)).when(a > b, _none("int"))


def split_mutations(s: Column) -> Column:
    """M1: the distinct tokens in their first order."""
    return F.array_distinct(F.filter(F.split(s, r"\s+"), lambda x: x != ""))


def classify_mutation(t: Column) -> Column:
    """M3: the type of one token; the first pattern that fits decides."""
    new = _group(t, RANGE_SUBSTITUTION, 3)
    in_range = F.when(~new.contains("*"), "Missense").when(new.rlike(r"^\*+$"), "Nonsense").otherwise("Complex_mutation")
    chain = F.when(t == "WT", "WT").when(t.rlike(NONSENSE), "Nonsense")
    chain = chain.when(t.rlike(SUBSTITUTION), F.when(F.substring(t, 1, 1) == F.substring(t, -1, 1), "Silent_Missense").otherwise("Missense"))
    for pattern, name in [(SILENT_NONSENSE, "Silent_Nonsense"), (FRAMESHIFT, "Frameshift"), (DELETION, "Deletion"), (RANGE_DELETION, "Deletion"), (PLAIN_RANGE_DELETION, "Deletion"), (INSERTION, "Insertion"), (HALF_INSERTION, "Insertion"), (DELINS, "Delins"), (RANGE_DELINS, "Delins")]:
        chain = chain.when(t.rlike(pattern), name)
    chain = chain.when(t.rlike(RANGE_SUBSTITUTION), in_range).when(t.rlike(CHANGED_FRAMESHIFT) | t.contains("fs"), "Frameshift")
    return F.when(t.isNotNull(), chain.otherwise("Unknown"))


def mutation_positions(t: Column) -> Column:
    """M4: the positions of one token (array of int); null where its type has none."""
    single = F.array(_number(t, r"(\d+)", 1))
    both = lambda p: F.array(_number(t, p, 1), _number(t, p, 2))
    span = lambda p: _range(_number(t, p, 1), _number(t, p, 2))
    out = F.when(t.rlike(NONSENSE) | t.rlike(SUBSTITUTION) | t.rlike(SILENT_NONSENSE) | t.rlike(FRAMESHIFT) | t.rlike(DELETION) | t.rlike(DELINS) | t.rlike(CHANGED_FRAMESHIFT), single)
    for p in (RANGE_DELETION, PLAIN_RANGE_DELETION, INSERTION, RANGE_DELINS, RANGE_SUBSTITUTION):
        out = out.when(t.rlike(p), span(p))
    return out.when(t.rlike(HALF_INSERTION), both(HALF_INSERTION))


def classify_mutations(s: Column) -> Column:
    """M5: the type of a whole cell: that of its tokens if they agree, WT if there is no other, else Complex_mutation."""
    types = F.array_distinct(F.filter(F.transform(split_mutations(s), classify_mutation), lambda x: x != "WT"))
    return F.when(F.size(types) == 0, "WT").when(F.size(types) == 1, F.get(types, 0)).when(F.size(types) > 1, "Complex_mutation")


def parse_mutation(t: Column) -> Column:
    """M6: struct(orig, pos, mut) of one simple token; all null for WT, nan and what does not fit."""
    mut = _group(t, P_SINGLE, 3)
    simple = F.struct(_group(t, P_SINGLE, 1).alias("orig"), _number(t, P_SINGLE, 2).alias("pos"), F.when(mut == "del", "-").when(mut != "", mut).alias("mut"))
    deletion = F.struct(F.lit(None).cast("string").alias("orig"), _number(t, P_POSITION_DELETION, 1).alias("pos"), F.lit("-").alias("mut"))
    nothing = F.struct(F.lit(None).cast("string").alias("orig"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("mut"))
    return F.when(t.rlike(P_POSITION_DELETION), deletion).when(t.rlike(P_SINGLE), simple).otherwise(nothing)


def _parts(origin: Column, position: Column, mutant: Column, error: Column | None = None) -> Column:
    return F.struct(origin.alias("origin"), position.alias("position"), mutant.alias("mutant"), (F.lit(None).cast("string") if error is None else error).alias("error"))


def _parse_token(t: Column) -> Column:
    """The three lists of one token inside a cell, or an error."""
    one = parse_mutation(t)
    listed = lambda x, kind: F.when(x.isNotNull(), F.array(x)).otherwise(_none(kind))
    single = _parts(listed(one["orig"], "string"), F.when(one["pos"] != 0, F.array(one["pos"])).otherwise(_none("int")), listed(one["mut"], "string"))
    g, n = (lambda p, k: _group(t, p, k)), (lambda p, k: _number(t, p, k))
    dashes = lambda span: F.array_repeat(F.lit("-"), F.size(span))
    fail = F.concat(F.lit("Invalid mutation format: "), t)
    none = lambda error: _parts(_none("string"), _none("int"), _none("string"), error)

    old, new, span = _signs(g(P_RANGE, 3)), _signs(g(P_RANGE, 4)), _range(n(P_RANGE, 1), n(P_RANGE, 2))
    swapped = F.when((F.size(old) == F.size(new)) & (F.size(old) == F.size(span)), _parts(old, span, new)).otherwise(none(F.concat(F.lit("Mismatch in mutation lengths: "), t)))
    p = P_RANGE_DELETION
    cut = _range(n(p, 2), n(p, 4))
    deleted = _parts(_strings(g(p, 1), g(p, 3)), cut, dashes(cut))
    plain = _range(n(P_PLAIN_RANGE_DELETION, 1), n(P_PLAIN_RANGE_DELETION, 2))
    i, h, d, r = P_INSERTION, P_HALF_INSERTION, P_DELINS, P_RANGE_DELINS
    inserted = _parts(_strings(g(i, 1), g(i, 3)), F.array(n(i, 2), n(i, 4)), F.concat(_strings(g(i, 1)), _signs(g(i, 5)), _strings(g(i, 3))))
    half = _parts(_strings(g(h, 1), g(h, 1)), F.array(n(h, 2), n(h, 3)), F.concat(_strings(g(h, 1)), _signs(g(h, 4)), _strings(g(h, 1))))
    replaced = _parts(_strings(g(d, 1)), F.array(n(d, 2)), F.concat(_strings("-"), _signs(g(d, 3))))
    wide = _range(n(r, 2), n(r, 4))
    replaced_range = _parts(_strings(g(r, 1), g(r, 3)), wide, F.concat(dashes(wide), _signs(g(r, 5))))
    chain = F.when(t.isin("WT", "nan"), none(fail)).when(t.rlike(P_POSITION_DELETION) | t.rlike(P_SINGLE), single).when(t.rlike(P_RANGE), swapped).when(t.rlike(p), deleted)
    chain = chain.when(t.rlike(P_PLAIN_RANGE_DELETION), _parts(_none("string"), plain, dashes(plain))).when(t.rlike(P_CHANGED_FRAMESHIFT), none(F.lit(None).cast("string")))
    return chain.when(t.rlike(i), inserted).when(t.rlike(h), half).when(t.rlike(d), replaced).when(t.rlike(r), replaced_range).otherwise(none(fail))


def parse_mutations(s: Column) -> Column:
    """M7: struct(origin, position, mutant, parse_error) of a cell.

    The lists grow token by token and independently of each other. A cell `WT` or `nan` gives empty lists. A token
    that cannot be parsed makes the cell an error: parse_error holds the first one and the lists are empty."""
    tokens = F.when(s.isin("WT", "nan"), _none("string")).otherwise(split_mutations(s))
    parsed = F.transform(F.array(F.transform(tokens, _parse_token)), lambda parts: F.struct(F.flatten(F.transform(parts, lambda x: x["origin"])).alias("origin"), F.flatten(F.transform(parts, lambda x: x["position"])).alias("position"), F.flatten(F.transform(parts, lambda x: x["mutant"])).alias("mutant"), F.get(F.filter(F.transform(parts, lambda x: x["error"]), lambda e: e.isNotNull()), 0).alias("parse_error")))[0]
    return F.transform(F.array(parsed), lambda x: F.when(x["parse_error"].isNull(), x).otherwise(F.struct(_none("string").alias("origin"), _none("int").alias("position"), _none("string").alias("mutant"), x["parse_error"].alias("parse_error"))))[0]


def _property_map() -> Column:
    entries = [x for code, (_, *values) in AMINO_ACIDS.items() for x in (F.lit(code), F.struct(*(F.lit(float(v)).alias(p) for p, v in zip(PROPERTIES, values, strict=True))))]
    return F.create_map(*entries)


def aa_diff(origin: Column, mutant: Column) -> Column:
    """M9: struct of the five property differences mutant - origin; null unless both are amino acids."""
    a, b = F.try_element_at(_property_map(), origin), F.try_element_at(_property_map(), mutant)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(*((b[p] - a[p]).alias(p) for p in PROPERTIES)))


def aa_changes(kind: Column, origin: Column, mutant: Column) -> Column:
    """struct(status, deltas): the differences of the lists pair by pair, up to the first pair that has none, which sets status 1."""
    k = F.least(F.size(origin), F.size(mutant))
    paired = F.transform(F.arrays_zip(F.slice(origin, 1, k).alias("o"), F.slice(mutant, 1, k).alias("m")), lambda x: aa_diff(x["o"], x["m"]))
    bad = lambda d: F.array_min(F.filter(F.transform(d, lambda x, i: F.when(x.isNull(), i)), lambda i: i.isNotNull()))
    found = F.transform(F.array(paired), lambda d: F.struct(F.when(bad(d).isNull(), 0).otherwise(1).alias("status"), F.slice(d, F.lit(1), F.coalesce(bad(d), F.size(d))).alias("deltas")))[0]
    empty = F.struct(F.lit(0).alias("status"), F.slice(paired, 1, 0).alias("deltas"))
    return F.when(kind == "WT", empty).otherwise(found)


def aa_change_stats(deltas: Column, prop: str) -> dict[str, Column]:
    """Min, max, mean (null when empty) and population standard deviation (0 up to one value) of one property."""
    v = F.transform(deltas, lambda x: x[prop])
    n = F.size(v)
    mean = F.when(n > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n)
    off = F.transform(F.array(F.struct(v.alias("v"), mean.alias("m"))), lambda s: F.aggregate(s["v"], F.lit(0.0), lambda a, x: a + (x - s["m"]) * (x - s["m"])))[0]
    return {f"{prop}_min": F.array_min(v), f"{prop}_max": F.array_max(v), f"{prop}_mean": mean, f"{prop}_std": F.when(n > 1, F.sqrt(off / n)).otherwise(F.lit(0.0))}


def aa_name(code: Column) -> Column:
    """The name of an amino acid, Stop Codon for `*`, else Unknown."""
    names = F.create_map(*(F.lit(x) for c, (name, *_) in AMINO_ACIDS.items() for x in (c, name)), F.lit("*"), F.lit(STOP_NAME))
    return F.coalesce(F.try_element_at(names, code), F.lit("Unknown"))


def digits_positions(s: Column) -> Column:
    """For each token, repeated ones too, all its digits as one number; tokens without digits go."""
    digits = F.transform(F.split(s, r"\s+"), lambda t: F.regexp_replace(t, "[^0-9]", ""))
    return F.transform(F.filter(digits, lambda d: d != ""), lambda d: d.try_cast("bigint"))
