"""Functions of protein sequences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The codes of the composition columns, in their order.
CODES = ["A", "C", "D", "E", "F", "G", "H", "I", "K", "L", "M", "N", "P", "Q", "R", "S", "T", "V", "W", "Y", "fs"]
REGIONS = ["n_term", "mid", "c_term"]
SAAC_COLUMNS = [f"{r}_{c}" for r in REGIONS for c in CODES]
STANDARD = "ACDEFGHIKLMNPQRSTVWY"

# The grammar of sequence edits, which is not that of the encoder. Positions are ASCII digits here, as columns and Python then agree.
E_POINT = re.compile(r"^([A-Z*])([0-9]+)([A-Z*])$")
E_DELETE = re.compile(r"^([A-Z])([0-9]+)del$")
E_SHIFT = re.compile(r"^([A-Z-]?)([0-9]+)fs$")
E_SWAP_RANGE = re.compile(r"^([0-9]+)_([0-9]+)([A-Z*]{2,})>([A-Z*]+)$")
E_DELETE_RANGE = re.compile(r"^[A-Z]([0-9]+)_[A-Z]([0-9]+)del$")
E_INSERT = re.compile(r"^[A-Z]([0-9]+)_[A-Z]([0-9]+)ins([A-Z]+)$")
E_HALF_INSERT = re.compile(r"^([A-Z])([0-9]+)_([0-9]+)ins([A-Z]+)$")
E_REPLACE_RANGE = re.compile(r"^[A-Z]([0-9]+)_[A-Z]([0-9]+)delins([A-Z]+)$")
E_CHANGED_SHIFT = re.compile(r"^([A-Z])([0-9]+)[A-Z]fs$")


def clean_sequence(s: Column) -> Column:
    """Q5: upper case, the 20 standard letters only."""
    return F.regexp_replace(F.upper(s), f"[^{STANDARD}]", "")


def saac(seq: Column, mutation_str: Column, cutoff: Column | float = 0.2) -> Column:
    """Q6: the 63 composition percentages as one array, in the order of SAAC_COLUMNS.

    The ends are rint(cutoff * length) long each. Under 5 letters all is n_term, without fs. If the ends are empty, the whole
    sequence is c_term. `fs` counts as one more code of c_term if the mutation string holds it. Null gives zeros."""
    cutoff = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
    s = F.coalesce(seq, F.lit(""))
    n = F.length(s)
    t = F.rint(cutoff * n).cast("int")
    sub = lambda at, k: F.substring(s, at, F.greatest(k, F.lit(0)))
    nothing = F.lit("")
    first = F.when(n < 5, s).when(t == 0, nothing).otherwise(sub(F.lit(1), t))
    mid = F.when((n < 5) | (t == 0), nothing).otherwise(sub(t + 1, n - 2 * t))
    last = F.when(n < 5, nothing).when(t == 0, s).otherwise(F.substring(s, F.greatest(n - t, F.lit(0)) + 1, n))
    shift = F.when((n >= 5) & F.coalesce(mutation_str.contains("fs"), F.lit(False)), 1).otherwise(0)
    regions = F.array(*(F.struct(x.alias("s"), k.alias("fs")) for x, k in ((first, F.lit(0)), (mid, F.lit(0)), (last, shift))))
    codes = F.array(*map(F.lit, CODES))

    def shares(r: Column) -> Column:
        size = F.length(r["s"]) + r["fs"]
        count = lambda c: F.when(c == "fs", r["fs"]).otherwise(F.length(r["s"]) - F.length(F.replace(r["s"], c, F.lit(""))))
        return F.transform(codes, lambda c: F.when(size > 0, count(c) / size * 100).otherwise(F.lit(0.0)))

    return F.flatten(F.transform(regions, shares))


def _ends(cutoff: Column, n: Column) -> Column:
    return F.rint(cutoff * n).cast("int")


def cut_counts(seq: Column, cutoffs: list[float]) -> Column:
    """(at, counts): the places where any cutoff parts a sequence, 0 and its length among them, and how often each standard letter stands before each."""
    s = F.coalesce(seq, F.lit(""))
    n = F.length(s)
    ends = [_ends(F.lit(c), n) for c in cutoffs]
    at = F.array_sort(F.array_distinct(F.array(F.lit(0), n, *(F.least(e, n) for e in ends), *(F.greatest(n - e, F.lit(0)) for e in ends))))
    letters = F.array(*map(F.lit, CODES[:-1]))
    zeros = F.array_repeat(F.lit(0), len(CODES) - 1)

    def counted(piece: Column) -> Column:
        return F.transform(letters, lambda c: F.length(piece) - F.length(F.replace(piece, c, F.lit(""))))

    def sums(at: Column) -> Column:
        # the pieces are made before their letters are counted, else each would be cut out again for each letter
        cut = F.transform(F.slice(at, 2, F.size(at)), lambda z, i: F.substring(s, F.get(at, i) + 1, z - F.get(at, i)))
        pieces = F.transform(cut, counted)
        step = lambda a, x: F.array_append(a, F.zip_with(F.element_at(a, -1), x, lambda p, q: p + q))
        return F.struct(at.alias("at"), F.aggregate(pieces, F.array(zeros), step).alias("counts"))

    return F.transform(F.array(at), sums)[0]


def saac_of_counts(seq: Column, mutation_str: Column, cutoff: Column, cuts: Column) -> Column:
    """Q6 from cut_counts(): the same array as saac() for one of its cutoffs of at most one half."""
    n = F.length(F.coalesce(seq, F.lit("")))
    t = _ends(cutoff, n)
    shift = F.when((n >= 5) & F.coalesce(mutation_str.contains("fs"), F.lit(False)), 1).otherwise(0)
    before = lambda p: F.get(cuts["counts"], F.array_position(cuts["at"], p).cast("int") - 1)
    part = lambda a, z, fs: F.struct(F.zip_with(before(z), before(a), lambda x, y: x - y).alias("c"), (z - a).alias("n"), fs.alias("fs"))
    none, zero = F.lit(0), F.lit(0)
    first = F.when(n < 5, n).otherwise(t)
    last = F.when(n < 5, n).when(t == 0, zero).otherwise(n - t)
    regions = F.array(part(zero, first, none), part(F.least(first, last), last, none), part(last, n, shift))

    def shares(r: Column) -> Column:
        size = r["n"] + r["fs"]
        return F.transform(F.array_append(r["c"], r["fs"]), lambda k: F.when(size > 0, k / size * 100).otherwise(F.lit(0.0)))

    return F.flatten(F.transform(regions, shares))


def saac_columns(array: Column) -> dict[str, Column]:
    return {c: F.get(array, k) for k, c in enumerate(SAAC_COLUMNS)}


def _edit(seq: list[str], token: str) -> tuple[list[str], bool] | None:
    """The sequence after one token, and whether it ends there; None if the token does not apply."""
    single = E_POINT.match(token) or E_DELETE.match(token) or E_SHIFT.match(token)
    swap = re.match(r"^([A-Z])([0-9]+)delins([A-Z]+)$", token)
    if single or swap:
        m = single or swap
        old, at = m[1], int(m[2])
        if at > len(seq) or not seq or (old not in "-*" or not old) and seq[at - 1] != old:
            return None
        before = seq[: at - 1]
        if E_SHIFT.match(token) or (single and m.re is E_POINT and m[3] == "*"):
            return [*before, "*"], True
        if m.re is E_DELETE:
            return before + seq[at:], False
        changed = list(seq)
        changed[at - 1] = m[3]  # letters that replace one stay one element, so later positions do not move
        return changed, False
    if m := E_SWAP_RANGE.match(token):
        a, z = int(m[1]), int(m[2])
        if z > len(seq) or "".join(seq[a - 1 : z]) != m[3]:
            return None
        changed = list(seq)
        changed[a - 1 : z] = m[4]
        return changed, False
    if m := E_DELETE_RANGE.match(token):
        a, z = int(m[1]), int(m[2])
        return (seq[: a - 1] + seq[z:], False) if z <= len(seq) else None
    if m := E_INSERT.match(token):
        z = int(m[2])
        return (seq[:z] + list(m[3]) + seq[z:], False) if z <= len(seq) else None
    if m := E_HALF_INSERT.match(token):
        a, z = int(m[2]), int(m[3])
        return (seq[:z] + list(m[4]) + seq[z:], False) if z <= len(seq) and "".join(seq[a - 1 : z]) == m[1] else None
    if m := E_REPLACE_RANGE.match(token):
        a, z = int(m[1]), int(m[2])
        return (seq[: a - 1] + list(m[3]) + seq[z:], False) if z <= len(seq) else None
    if m := E_CHANGED_SHIFT.match(token):
        at = int(m[2])
        return (seq[: at - 1], True) if at <= len(seq) and "".join(seq[at - 1 : at]) == m[1] else None
    return None


#: Kinds of edits by their patterns, for columns: (kind, pattern, groups of residue, first and last place, and new letters; 0 for none).
EDITS = [
    ("substitution", r"^([A-Z*])([0-9]+)([A-Z])$", 1, 2, 0, 3),
    ("stop", r"^([A-Z*])([0-9]+)([*])$", 1, 2, 0, 3),
    ("deletion", E_DELETE.pattern, 1, 2, 0, 0),
    ("frameshift", E_SHIFT.pattern, 1, 2, 0, 0),
    ("replacement", r"^([A-Z])([0-9]+)delins([A-Z]+)$", 1, 2, 0, 3),
    ("range_swap", E_SWAP_RANGE.pattern, 3, 1, 2, 4),
    ("range_deletion", E_DELETE_RANGE.pattern, 0, 1, 2, 0),
    ("insertion", E_INSERT.pattern, 0, 1, 2, 3),
    ("half_insertion", E_HALF_INSERT.pattern, 1, 2, 3, 4),
    ("range_replacement", E_REPLACE_RANGE.pattern, 0, 1, 2, 3),
    ("changed_frameshift", E_CHANGED_SHIFT.pattern, 1, 2, 0, 0),
]


def parse_edit(token: Column) -> Column:
    """Q1: (kind, residue, first, last, letters) of one token in the grammar of sequence edits; all null if it is none.

    last is null for edits of one place, residue and letters where the kind has none; places beyond the range of a long are null."""
    part = lambda p, g: F.nullif(F.regexp_extract(token, p, g), F.lit("")) if g else F.lit(None).cast("string")
    out = F.lit(None)
    for kind, p, old, a, z, new in reversed(EDITS):
        made = F.struct(F.lit(kind).alias("kind"), part(p, old).alias("residue"), part(p, a).try_cast("long").alias("first"), part(p, z).try_cast("long").alias("last"), part(p, new).alias("letters"))
        out = F.when(token.rlike(p), made).otherwise(out)
    return out


_PLACE = "0*[1-9][0-9]{0,8}"
#: Mutation strings that plain string functions apply: substitutions, or one other edit that needs no list of letters, or a position alone, which no
#: edit is. The group that repeats is possessive, as the matcher would go one call deeper for each token that it could give back.
SIMPLE = f"^(WT|p[.][0-9]+|[A-Z*]{_PLACE}[A-Z](?: [A-Z*]{_PLACE}[A-Z])*+|[A-Z*]{_PLACE}[*]|[A-Z]{_PLACE}del|[A-Z-]{_PLACE}fs|[A-Z]{_PLACE}delins[A-Z]+|[A-Z]{_PLACE}_[A-Z]{_PLACE}(del|ins[A-Z]+)|{_PLACE}_{_PLACE}[A-Z]{{2,}}>[A-Z]+)$"


def simple_edit(m: Column) -> Column:
    """(kind, at, z, old, new) of the edit of a SIMPLE string: all that its effect on a sequence's length depends on, but for the sequence."""
    kind = F.when((m == "WT") | m.startswith("p."), "none").when(m.contains(">"), "swap").when(m.contains("_") & m.endswith("del"), "range").when(m.contains("_"), "insertion")
    kind = kind.when(m.endswith("*") | m.endswith("fs"), "end").when(m.endswith("del"), "deletion").when(m.contains("delins"), "replacement").otherwise("substitutions")
    # no cast of '', which costs an exception a row
    number = lambda p: F.nullif(F.regexp_extract(m, p, 1), F.lit("")).try_cast("int")
    swap = m.contains(">")
    old = F.when(swap, F.regexp_extract(m, "([A-Z]+)>", 1)).otherwise(F.substring(m, 1, 1))
    new = F.when(swap, F.substring_index(m, ">", -1)).otherwise(F.regexp_extract(m, "ins([A-Z]+)$", 1))
    return F.struct(kind.alias("kind"), number("([0-9]+)").alias("at"), number("_[A-Z]?([0-9]+)").alias("z"), old.alias("old"), new.alias("new"))


def _applies(wild: Column, n: Column, e: Column) -> Column:
    """Whether an edit's places are there and its residues stand there."""
    here = lambda k: F.substring(wild, e["at"], k) == e["old"]
    swapped = (e["z"] <= n) & (F.length(e["old"]) == e["z"] - e["at"] + 1) & here(F.length(e["old"]))
    return F.when(e["kind"] == "swap", swapped).when(e["kind"].isin("range", "insertion"), e["z"] <= n).otherwise((e["at"] <= n) & (e["old"].isin("-", "*") | here(F.lit(1))))


def edited_length(wild: Column, n: Column, e: Column) -> Column:
    """The length of a sequence of n letters without `*` after a simple_edit(), from position and residues alone."""
    kind, added = e["kind"], F.length(e["new"])
    after = F.when(kind == "range", F.least(e["at"] - 1, n) + n - e["z"]).when(kind == "insertion", n + added).when(kind == "swap", n - F.length(e["old"]) + added)
    after = after.when(kind == "end", e["at"] - 1).when(kind == "deletion", n - 1).when(kind == "replacement", n - 1 + added)
    return F.when(kind.isin("none", "substitutions"), n).when(_applies(wild, n, e), after).otherwise(n)


def simple_length(wild: Column, mutation_str: Column) -> Column:
    """The length of a sequence without `*` after a SIMPLE mutation string."""
    return edited_length(wild, F.length(wild), simple_edit(mutation_str))


def simple_mutated(wild: Column, mutation_str: Column, edit: Column | None = None) -> Column:
    """A sequence without `*` after a SIMPLE mutation string; edit: its simple_edit(), if a column has it."""
    n, m = F.length(wild), mutation_str
    e = simple_edit(m) if edit is None else edit
    before = lambda k: F.substring(wild, F.lit(1), k)
    after = lambda k: F.substring(wild, k + 1, n)

    def substituted(s: Column, t: Column) -> Column:
        at, old = F.regexp_extract(t, "([0-9]+)", 1).try_cast("int"), F.substring(t, 1, 1)
        fits = (at <= n) & ((old == "*") | (F.substring(s, at, F.lit(1)) == old))
        return F.when(fits, F.concat(F.substring(s, F.lit(1), at - 1), F.right(t, F.lit(1)), F.substring(s, at + 1, n))).otherwise(s)

    kind, at, z, new = e["kind"], e["at"], e["z"], e["new"]
    edited = F.when(kind == "range", F.concat(before(at - 1), after(z))).when(kind == "insertion", F.concat(before(z), new, after(z))).when(kind == "swap", F.concat(before(at - 1), new, after(z)))
    edited = edited.when(kind == "end", before(at - 1)).when(kind == "deletion", F.concat(before(at - 1), after(at))).when(kind == "replacement", F.concat(before(at - 1), new, after(at)))
    points = F.aggregate(F.array_distinct(F.split(m, " ")), wild, substituted)
    return F.when(kind == "none", wild).when(kind == "substitutions", points).when(_applies(wild, n, e), edited).otherwise(wild)


def mutated(wild: str | None, mutation_str: str | None) -> str | None:
    """Q2 for one sequence: tokens in order on a growing list; one that does not fit is skipped; a stop or frameshift ends it."""
    if wild is None or mutation_str is None:
        return None
    seq = list(wild)
    for token in dict.fromkeys(mutation_str.split()):
        done = _edit(seq, token)
        if done is not None:
            seq, over = done
            if over:
                break
    return "".join(seq[: seq.index("*")] if "*" in seq else seq)


@F.pandas_udf(T.StringType())
def mutate_sequence(wild: pd.Series, mutation_str: pd.Series) -> pd.Series:
    """Q2: the sequence of each row after its mutations."""
    return pd.Series([mutated(a, b) for a, b in zip(wild, mutation_str, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("seq", T.StringType())])))
def best_mutated(wild: pd.Series, ranks: pd.Series, mutation_strs: pd.Series) -> pd.Series:
    """Q2 over several sequences and mutation strings a row: for each string the place (from 0) of the sequence of least rank that is not empty after it, the longest of
    these and the first on ties, and what it is then; nulls if there is none. WT keeps sequences as they are. Rows without sequences are null."""

    def best(seqs, ranks, m):
        made = [(r, s if m == "WT" else mutated(s, m), k) for k, (s, r) in enumerate(zip(seqs, ranks, strict=True)) if s is not None and m is not None]
        r = min(((r, -len(s), k, s) for r, s, k in made if s), default=None, key=lambda x: x[:3])
        return {"at": None, "seq": None} if r is None else {"at": r[2], "seq": r[3]}

    return pd.Series([None if s is None or ms is None else [best(s, r, m) for m in ms] for s, r, ms in zip(wild, ranks, mutation_strs, strict=True)], dtype=object)
