"""Isoforms, mutated sequences and their composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import proteins as P
from cohortlake.operators.cohort import KEYS
from cohortlake.session import ship

# The databases in the order in which they are asked, and the cutoffs of the sweep.
DATABASES = ["uniprot", "ncbi", "pdb", "ensembl"]
CUTOFFS = [0.10, 0.15, 0.20, 0.25, 0.30]
#: Dictionary rows of a gene that meet its isoforms as one row.
CHUNK = 64


def _db_rank():
    return F.array_position(F.array(*map(F.lit, DATABASES)), F.col("db"))


def add_mutated_sequences(dictionary: DataFrame, isoforms: DataFrame) -> DataFrame:
    """Q3: for each dictionary row the isoform of the first database that has a usable one: the longest mutated sequence, the first on ties.

    WT rows keep the wild type; empty sequences do not count; rows without any keep nulls. A gene's isoforms are one row, as in the files, and meet the gene's
    dictionary rows, CHUNK of them in a row, in one join by gene: each sequence is shuffled once, and no mutated one is. Only lengths are compared, which for most kinds of
    edits follow from a position and some residues; the other edits, and genes with a `*` in a sequence, go to Python, all other rows as nulls."""
    ship(dictionary.sparkSession)
    m, iso, flat = F.col("mutation_str"), F.col("__iso"), F.coalesce(F.col("__flat"), F.lit(True))
    each = F.struct(_db_rank().alias("r"), F.col("isoform_ord").alias("o"), "isoform_id", F.length("wt_seq").alias("n"), "wt_seq")
    packed = isoforms.groupBy("gene").agg(F.array_sort(F.collect_list(each)).alias("__iso")).withColumn("__flat", ~F.exists(iso, lambda x: F.coalesce(x["wt_seq"].contains("*"), F.lit(False))))
    # the number only says which rows of a gene go together
    rows = dictionary.select(*KEYS).sortWithinPartitions("gene").withColumn("__chunk", F.floor(F.monotonically_increasing_id() / CHUNK))
    rows = rows.select(*KEYS, "__chunk", F.when(m.rlike(P.SIMPLE), P.simple_edit(m)).alias("e"))
    rows = rows.groupBy("gene", "__chunk").agg(F.collect_list(F.struct(m.alias("m"), "e")).alias("__m")).join(packed, "gene", "left")
    listed = lambda x: x["e"].isNull() | ~flat
    seqs = F.when(F.exists("__m", listed), iso)
    made = P.best_mutated(seqs["wt_seq"], seqs["r"], F.when(seqs.isNotNull(), F.transform("__m", lambda x: F.when(listed(x), x["m"]))))
    lengths = lambda e: F.transform(iso, lambda x, k: F.struct(x["r"].alias("r"), (-P.edited_length(x["wt_seq"], x["n"], e)).alias("l"), x["o"].alias("o"), k.alias("k")))
    least = lambda e: F.array_min(F.filter(lengths(e), lambda x: x["l"] < 0))["k"]
    rows = rows.withColumn("__made", made)
    at = F.transform("__m", lambda x, i: F.struct(x["m"].alias("m"), x["e"].alias("e"), F.get("__made", i).alias("made"), F.when(listed(x), F.get("__made", i)["at"]).otherwise(least(x["e"])).alias("k")))
    best = F.transform(at, lambda x: F.struct(x["m"].alias("mutation_str"), x["e"].alias("e"), x["made"]["seq"].alias("made"), F.get(iso, x["k"])["isoform_id"].alias("isoform_id"), F.get(iso, x["k"])["wt_seq"].alias("wt_seq")))
    rows = rows.select("gene", F.explode(best).alias("x")).select("gene", "x.*")
    return rows.select(*KEYS, "isoform_id", "wt_seq", F.when(F.col("wt_seq").isNotNull(), F.coalesce("made", P.simple_mutated(F.col("wt_seq"), m, F.col("e")))).alias("mut_seq"))


def not_found(seqs: DataFrame) -> DataFrame:
    """The keys without a sequence."""
    return seqs.where(F.col("wt_seq").isNull()).select(*KEYS)


def select_longest_isoform(isoforms: DataFrame) -> DataFrame:
    """Q4: for each database and gene the preferred isoform.

    uniprot takes ids with P, ncbi NP_ then XP_, pdb four signs, `_` and digits: of these the longest, first on ties. ensembl takes
    the ENSP id with the highest number after its last dot (0 without a dot). Where none fits, and in other
    databases, the longest of all."""
    i, db = F.col("isoform_id"), F.lower("db")
    fits = F.when((db == "uniprot") & i.startswith("P"), 0).when((db == "ncbi") & i.startswith("NP_"), 0).when((db == "ncbi") & i.startswith("XP_"), 1).when((db == "pdb") & i.rlike(r"^[0-9A-Za-z]{4}_\d+$"), 0).when((db == "ensembl") & i.startswith("ENSP"), 0).otherwise(2)
    version = F.when(i.contains("."), F.coalesce(F.substring_index("isoform_id", ".", -1).try_cast("long"), F.lit(0))).otherwise(0)
    weight = F.when((db == "ensembl") & (fits == 0), -version).otherwise(-F.length("wt_seq").cast("long"))
    order = F.struct(fits.alias("f"), weight.alias("w"), F.col("isoform_ord").alias("o"))
    return isoforms.groupBy("db", "gene").agg(F.min_by(F.struct("isoform_id", "wt_seq"), order).alias("x")).select("db", "gene", "x.*")


def saac_table(seq_df: DataFrame, cutoff: float = 0.2) -> DataFrame:
    """Q6: the rows with the 63 composition columns."""
    with_array = seq_df.withColumn("__saac", P.saac(F.col("seq"), F.col("mutation_str"), cutoff))
    return with_array.withColumns(P.saac_columns(F.col("__saac"))).drop("__saac")


def saac_sweep(seq_df: DataFrame, cutoffs: list[float] | None = None) -> DataFrame:
    """Q7: one row for each sequence and cutoff, with the composition as one array. Letters are counted once, between all cuts."""
    all_cuts = [float(c) for c in cutoffs or CUTOFFS]
    seq = seq_df.withColumn("__c", P.cut_counts(F.col("seq"), all_cuts))
    swept = seq.withColumn("cutoff", F.explode(F.array(*map(F.lit, all_cuts))))
    return swept.withColumn("saac", P.saac_of_counts(F.col("seq"), F.col("mutation_str"), F.col("cutoff"), F.col("__c"))).drop("__c")


def with_lengths(seq_df: DataFrame) -> DataFrame:
    """Q8: seq_len, null for a missing sequence."""
    return seq_df.withColumn("seq_len", F.length("seq"))


def length_summary(seq_df: DataFrame) -> DataFrame:
    """Q8: count, mean, sample deviation, least, greatest."""
    n = F.length("seq")
    return seq_df.agg(F.count(n).alias("n"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"), F.min(n).alias("min"), F.max(n).alias("max"))


def length_histogram(seq_df: DataFrame, low: int = 0, high: int = 2000, bins: int = 50) -> DataFrame:
    """Q8: counts of lengths in equal bins; the last one includes `high`."""
    n, width = F.length("seq"), (high - low) / bins
    bin_ = F.least(F.floor((n - low) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return seq_df.where(n.between(low, high)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
