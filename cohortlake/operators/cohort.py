"""Reshaping, joining and choosing rows of cohorts, dictionaries and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions import mutations as M

IDS = ["ID", "SUBCLASS"]
KEYS = ["gene", "mutation_str"]
WILD = "WT"


def is_mutated(c: Column | str = "mutation_str") -> Column:
    """True for every cell but WT, null included."""
    return ~(F.col(c) if isinstance(c, str) else c).eqNullSafe(WILD)


def unpivot_cohort(df: DataFrame, id_cols: list[str] | None = None, genes: list[str] | None = None, null_as: str | None = "nan") -> DataFrame:
    """One row for each sample and gene; null cells become `nan` unless null_as is None."""
    ids = [c for c in (id_cols or IDS) if c in df.columns]
    long = df.unpivot(ids, genes or [c for c in df.columns if c not in ids], "gene", "mutation_str")
    return long if null_as is None else long.withColumn("mutation_str", F.coalesce("mutation_str", F.lit(null_as)))


def mutation_dictionary(long: DataFrame) -> DataFrame:
    """The distinct (gene, mutation_str)."""
    return long.select(*KEYS).distinct()


def mutated_only(long: DataFrame) -> DataFrame:
    """Without WT cells; null cells stay."""
    return long.where(is_mutated())


def binarize(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """WT to 0, all else to 1, in the given columns (mutation_str by default)."""
    return df.withColumns({c: is_mutated(c).cast("int") for c in cols or ["mutation_str"]})


def transpose_cohort(df: DataFrame, samples: list[str], id_col: str = "ID") -> DataFrame:
    """P5: genes as rows, the named samples as columns. The long form holds the same for any number of samples."""
    long = unpivot_cohort(df.where(F.col(id_col).isin(samples)), null_as=None)
    return long.groupBy("gene").pivot(id_col, samples).agg(F.first("mutation_str"))


def wide_cohort(long: DataFrame, genes: list[str], fill: str = WILD) -> DataFrame:
    """The wide form of a long cohort over the named genes; absent cells are WT."""
    ids = [c for c in IDS if c in long.columns]
    wide = long.groupBy(*ids).pivot("gene", genes).agg(F.min("mutation_str"))
    return wide.select(*ids, *(F.coalesce(F.col(f"`{g}`"), F.lit(fill)).alias(g) for g in genes))


def protein_status(df: DataFrame) -> DataFrame:
    """status_prot 1 for a frameshift, a complex mutation with an element `fs`, or a missing isoform; else 0."""
    shifted = (F.col("type") == "Frameshift") | ((F.col("type") == "Complex_mutation") & F.array_contains("mutant", "fs"))
    return df.withColumn("status_prot", F.when(F.coalesce(shifted, F.lit(False)) | F.col("isoform_id").isNull(), 1).otherwise(0))


def constant_columns(train: DataFrame, cols: list[str]) -> DataFrame:
    """The names of columns with exactly one distinct non-null value, in one pass over all."""
    one = train.agg(*(F.struct(F.min(c).eqNullSafe(F.max(c)).alias("same"), (F.count(c) > 0).alias("any")).alias(c) for c in cols))
    long = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (F.col(f"`{c}`.same") & F.col(f"`{c}`.any")).alias("constant")) for c in cols))).alias("x"))
    return long.select("x.*").where("constant").select("column")


def drop_constant_columns(train: DataFrame, test: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    gone = [r[0] for r in constant_columns(train, cols).collect()]  # at most the columns
    return train.drop(*gone), test.drop(*gone)


def fill_missing(df: DataFrame, numbers: float = 0, strings: str = "Unknown") -> DataFrame:
    """P10."""
    return df.na.fill(numbers).na.fill(strings)


def pivot_features(long: DataFrame, genes: list[str], features: list[str], id_col: str = "ID", keep_all_ids: bool = True) -> DataFrame:
    """(ID, gene) rows to columns {gene}_{feature}, the first non-null of each.

    Without keep_all_ids samples go that have no value at all."""
    wide = long.groupBy(id_col).pivot("gene", genes).agg(*(F.first(c, ignorenulls=True).alias(c) for c in features))
    names = [f"{g}_{c}" for g in genes for c in features]
    if len(features) == 1:
        wide = wide.select(id_col, *(F.col(f"`{g}`").alias(f"{g}_{features[0]}") for g in genes))
    return wide if keep_all_ids else wide.where(F.coalesce(*(F.col(f"`{n}`").cast("string") for n in names)).isNotNull())


def duplicate_mutations(long: DataFrame) -> DataFrame:
    """M2: tokens that occur more than once in a cell, with their count."""
    keys = [c for c in ("ID", "gene", "mutation_str") if c in long.columns]
    tokens = long.select(*keys, F.explode(F.filter(F.split("mutation_str", r"\s+"), lambda x: x != "")).alias("token"))
    return tokens.groupBy(*keys, "token").agg(F.count("*").alias("n")).where("n > 1")


def encode_mutations(dictionary: DataFrame, failfast: bool = False) -> DataFrame:
    """Type, lists, count, property statistics and status of each dictionary row.

    Rows that cannot be parsed carry parse_error and empty lists, or fail the query if failfast. Other columns of the dictionary stay behind these: a dictionary with
    its sequences gives J1 without a join."""
    more = [c for c in dictionary.columns if c not in KEYS]
    parsed = dictionary.select(*KEYS, *more, M.classify_mutations(F.col("mutation_str")).alias("type"), M.parse_mutations(F.col("mutation_str")).alias("p"))
    if failfast:
        parsed = parsed.withColumn("p", F.when(F.col("p.parse_error").isNull(), F.col("p")).otherwise(F.raise_error(F.col("p.parse_error")).cast(parsed.schema["p"].dataType)))
    lists = parsed.select(*KEYS, *more, "type", "p.origin", "p.position", "p.mutant", F.size("p.position").alias("mut_num"), "p.parse_error")
    changed = lists.withColumn("c", M.aa_changes(F.col("type"), F.col("origin"), F.col("mutant")))
    stats = {n: c for p in M.PROPERTIES for n, c in M.aa_change_stats(F.col("c.deltas"), p).items()}
    encoded = changed.withColumns(stats).withColumn("status", F.col("c.status")).drop("c")
    return encoded.select(*(c for c in encoded.columns if c not in more), *more)


# --- joins --------------------------------------------------------------------------------------


def full_feature_table(enc: DataFrame, seqs: DataFrame) -> DataFrame:
    """The encoding with isoform and sequences, and status_prot."""
    columns = [c for c in ("isoform_id", "wt_seq", "mut_seq") if c in seqs.columns]
    return protein_status(enc.drop(*columns).join(seqs.select(*KEYS, *columns), KEYS, "left"))


def attach(long: DataFrame, table: DataFrame, salts: int = 16) -> DataFrame:
    """long left join table, which has one row for each of KEYS; null strings match null.

    `WT`, `nan` and null hold most cells of a gene, so their keys are salted."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    common = F.coalesce(F.col("mutation_str").isin(WILD, "nan"), F.lit(True))
    by = [c for c in ("ID", "gene") if c in long.columns]
    left = long.withColumn("__salt", F.when(common, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(0)).withColumn("__key", key(F.col("mutation_str")))
    right = table.withColumn("__salt", F.explode(F.when(common, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    right = right.withColumn("__key", key(F.col("mutation_str"))).drop("mutation_str")
    return left.join(right, ["gene", "__key", "__salt"], "left").select(*long.columns, *(c for c in table.columns if c not in KEYS))


def attach_encoding(long: DataFrame, enc: DataFrame) -> DataFrame:
    """Mutated cells with their encoding."""
    return attach(mutated_only(long), enc)


def attach_saac(long: DataFrame, saac: DataFrame, salts: int = 16) -> DataFrame:
    """All cells with their composition, WT included."""
    return attach(long, saac, salts)


def attach_labels(cohort: DataFrame, features: DataFrame) -> DataFrame:
    """Every sample of the cohort with its label, and its features if it has any."""
    return cohort.select(*IDS).distinct().join(features, "ID", "left")


def unseen_variants(train: DataFrame, test: DataFrame) -> DataFrame:
    """For each gene the variants of test cells that no train cell has, WT aside."""
    new = mutation_dictionary(mutated_only(test)).join(mutation_dictionary(train), KEYS, "left_anti")
    return new.groupBy("gene").agg(F.sort_array(F.collect_set("mutation_str")).alias("variants"), F.count("*").alias("n_variants"))


def patch_table(base: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """Base with the non-null values of fixes; no new rows."""
    cols = [c for c in fixes.columns if c != key and c in base.columns]
    renamed = fixes.select(key, *(F.col(c).alias(f"__{c}") for c in cols))
    return base.join(renamed, key, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in cols else F.col(c) for c in base.columns))


def attach_gene_info(long: DataFrame, info: DataFrame) -> DataFrame:
    """Cells of genes that have info."""
    return long.join(info, "gene")


# --- windows, order, sets -----------------------------------------------------------------------


def top_k(df: DataFrame, by: str, k: int, tie: str = "gene") -> DataFrame:
    """The k rows of the highest `by`; ties in order of `tie`."""
    return df.orderBy(F.col(by).desc(), F.col(tie)).limit(k)


def high_frequency_genes(counts: DataFrame, ratio: float = 0.2, count: str = "n") -> DataFrame:
    """In each SUBCLASS the genes with more than rint(ratio x its highest count)."""
    highest = F.max(count).over(Window.partitionBy("SUBCLASS"))
    return counts.withColumn("threshold", F.rint(highest * ratio)).where(F.col(count) > F.col("threshold"))


def _rank(keys: list[str], order: list) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def top_mutations_per_sample(m: DataFrame, k: int = 128) -> DataFrame:
    """The k rows of each sample with the most mutations; ties by gene, then mutation_str."""
    return m.withColumn("rn", _rank(["ID"], [F.col("mut_num").desc_nulls_last(), F.col("gene"), F.col("mutation_str")])).where(F.col("rn") <= k)


def max_row(df: DataFrame, key: str, tie: list) -> DataFrame:
    """The row with the highest key; the first in order of tie."""
    return df.orderBy(F.col(key).desc_nulls_last(), *tie).limit(1)


def dedupe_keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of the rows that agree in keys the first in the given order."""
    return df.withColumn("__rn", _rank(keys, order)).where("__rn = 1").drop("__rn")


def dedupe_keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return dedupe_keep_first(df, keys, [F.col(c).desc() for c in order])


def sequence_of() -> Column:
    """The wild type for WT rows, else the mutated sequence."""
    return F.when(is_mutated(), F.col("mut_seq")).otherwise(F.col("wt_seq"))


def full_sequence_table(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train, then test, first of each key by isoform_id; seq is the wild type for WT rows, else the mutated sequence.

    One aggregation, which combines before the shuffle, or in place if the tables are dealt by gene. Null keys are keys like others; of rows that agree in key, table and
    isoform the one with the least hash of its sequences stays."""
    both = train.withColumn("__source", F.lit(0)).unionByName(test.withColumn("__source", F.lit(1)), allowMissingColumns=True)
    more = [c for c in both.columns if c not in (*KEYS, "__source")]
    order = F.struct("__source", "isoform_id", F.xxhash64("wt_seq", "mut_seq").alias("h"))
    first = both.groupBy(*KEYS).agg(F.min_by(F.struct(*more), order).alias("x")).select(*KEYS, "x.*").select(*(c for c in both.columns if c != "__source"))
    return first.withColumn("seq", sequence_of())


def variant_difference(test: DataFrame, train: DataFrame) -> DataFrame:
    """The (gene, mutation_str) of test that train lacks."""
    return test.select(*KEYS).subtract(train.select(*KEYS))


def union_distinct(first: DataFrame, *others: DataFrame) -> DataFrame:
    """U3."""
    for o in others:
        first = first.union(o)
    return first.distinct()
