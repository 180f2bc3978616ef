"""Cohort statistics on the long form, and summaries of bulk gene tables."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions import mutations as M
from cohortlake.operators.cohort import is_mutated
from cohortlake.operators.joins import global_numbers, grid_join, stored


def label_distribution(df: DataFrame) -> DataFrame:
    """A1: samples and share of each SUBCLASS."""
    counts = df.select("ID", "SUBCLASS").distinct().groupBy("SUBCLASS").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each label


def mutation_frequency(long: DataFrame) -> DataFrame:
    """A2: the share of non-null cells of each gene that are not WT."""
    n, m = F.count("mutation_str"), F.count_if(F.col("mutation_str") != "WT")
    return long.groupBy("gene").agg(m.alias("n_mutated"), n.alias("n"), F.when(n > 0, m / n).alias("frequency"))


def label_mutation_counts(long: DataFrame) -> DataFrame:
    """A3: mutated cells of each (SUBCLASS, gene); null cells count as mutated."""
    return long.groupBy("SUBCLASS", "gene").agg(F.count_if(is_mutated()).alias("n"))


def frequency_shift(train: DataFrame, test: DataFrame) -> DataFrame:
    """A4: the absolute difference of the two frequencies of each gene; a gene that one side lacks has none."""
    a, b = (mutation_frequency(x).select("gene", F.col("frequency").alias(n)) for x, n in ((train, "freq_train"), (test, "freq_test")))
    return a.join(b, "gene", "full").withColumn("shift", F.abs(F.col("freq_train") - F.col("freq_test")))


def cramers_v(long: DataFrame) -> DataFrame:
    """A5: Cramér's V between SUBCLASS and the mutated flag of each gene; null where it is 0/0.

    With two labels (one degree of freedom) differences shrink by up to 0.5, Yates' correction."""
    cells = long.groupBy("gene", "SUBCLASS").agg(F.count("*").alias("r"), F.count_if(is_mutated()).alias("m"))
    by_gene = Window.partitionBy("gene")
    total, mutated, labels = F.sum("r").over(by_gene), F.sum("m").over(by_gene), F.count("*").over(by_gene)
    t = cells.withColumns({"total": total, "mutated": mutated, "labels": labels})
    parts = F.array(*(F.struct(o.alias("o"), (F.col("r") * c / F.col("total")).alias("e")) for o, c in ((F.col("m"), F.col("mutated")), (F.col("r") - F.col("m"), F.col("total") - F.col("mutated")))))
    each = t.select("gene", "total", "labels", F.explode(parts).alias("x"))
    off = F.abs(F.col("x.o") - F.col("x.e"))
    off = F.when(F.col("labels") == 2, off - F.least(F.lit(0.5), off)).otherwise(off)
    # a zero expectation comes of a gene that is never or always mutated
    chi = each.groupBy("gene", "total", "labels").agg(F.sum(F.when(F.col("x.e") > 0, off * off / F.col("x.e"))).alias("chi2"), F.min("x.e").alias("least"))
    dim = F.least("labels", F.lit(2)) - 1
    return chi.select("gene", F.when((F.col("least") > 0) & (dim > 0), F.sqrt(F.col("chi2") / (F.col("total") * dim))).alias("v"))


def all_wt_genes(train: DataFrame, test: DataFrame) -> DataFrame:
    """Genes of which every cell of both is empty or WT."""
    both = train.select("gene", "mutation_str").union(test.select("gene", "mutation_str"))
    plain = F.coalesce(F.col("mutation_str").isin("", "WT"), F.lit(False))
    return both.groupBy("gene").agg(F.bool_and(plain).alias("plain")).where("plain").select("gene")


def hotspots(long: DataFrame) -> DataFrame:
    """How often each position of a gene is mutated, Overall and by SUBCLASS, by grouping sets over one explode."""
    each = long.select("gene", "SUBCLASS", F.explode(M.digits_positions(F.col("mutation_str"))).alias("position"))
    sets = each.groupingSets([["gene", "position"], ["gene", "SUBCLASS", "position"]], "gene", "SUBCLASS", "position")
    counted = sets.agg(F.grouping("SUBCLASS").alias("g"), F.count("*").alias("n"))
    return counted.select("gene", F.when(F.col("g") == 1, "Overall").otherwise(F.col("SUBCLASS")).alias("subclass"), "position", "n")


def nonempty_counts(long: DataFrame) -> DataFrame:
    """Cells other than '' of each (SUBCLASS, gene); WT and null count."""
    return long.groupBy("SUBCLASS", "gene").agg(F.count_if(~F.col("mutation_str").eqNullSafe("")).alias("n"))


def interaction_summary(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """For each gene its edges, best score and partner (first of equals by ord), distinct partners but itself, and whether any type names a complex."""
    partner = F.when(F.col("partner_a") == F.col("gene"), F.col("partner_b")).otherwise(F.col("partner_a"))
    t = edges.withColumn("partner", partner)
    order = F.struct("score", -F.col("ord"))
    stats = t.groupBy("gene").agg(F.count("*").alias("n_edges"), F.max("score").alias("top_score"), F.max_by("partner", order).alias("top_partner"), F.count_distinct(F.when(F.col("partner") != F.col("gene"), F.col("partner"))).alias("n_partners"), F.bool_or(F.lower("interaction_type").contains("complex")).alias("in_complex"))
    return genes.select("gene").distinct().join(stats, "gene", "left").na.fill({"n_edges": 0, "top_score": 0.0, "top_partner": "", "n_partners": 0, "in_complex": False})


def annotation_summary(annotations: DataFrame, genes: DataFrame, categories: list[str]) -> DataFrame:
    """For each gene its distinct labels of each category, sorted; ['Unknown'] if it has none."""
    wide = annotations.groupBy("gene").agg(*(F.sort_array(F.collect_set(F.when(F.col("category") == c, F.col("label")))).alias(c) for c in categories))
    unknown = F.array(F.lit("Unknown"))
    return genes.select("gene").distinct().join(wide, "gene", "left").select("gene", *(F.when(F.size(c) > 0, F.col(c)).otherwise(unknown).alias(c) for c in categories))


def pathway_summary(pathways: DataFrame) -> DataFrame:
    """Pathways of each gene and the first of them by ord."""
    return pathways.groupBy("gene").agg(F.count("*").alias("n_pathways"), F.min_by("pathway", "ord").alias("first_pathway"))


def variant_summary(variants: DataFrame) -> DataFrame:
    """Variants of each gene and whether any is pathogenic."""
    return variants.groupBy("gene").agg(F.count("*").alias("n_variants"), F.bool_or(F.lower("significance").contains("pathogenic")).alias("has_pathogenic"))


def filter_hits(hsps: DataFrame, identity: float, coverage: float) -> DataFrame:
    """Hits with identity and coverage (percent) of at least the thresholds; of those that share (gene, hit_id) the last by ord."""
    t = hsps.withColumn("identity", F.col("identities") / F.col("align_length") * 100).withColumn("coverage", F.col("align_length") / F.col("query_len") * 100)
    kept = t.where((F.col("identity") >= identity) & (F.col("coverage") >= coverage))
    names = [c for c in kept.columns if c not in ("gene", "hit_id")]
    return kept.groupBy("gene", "hit_id").agg(F.max_by(F.struct(*names), "ord").alias("x")).select("gene", "hit_id", "x.*")


#: Codes that are broadcast at most.
MANY_CODES = 50_000


def factorize_long(rows: DataFrame, order: str = "row") -> DataFrame:
    """(order, column, code) of rows (order, column, value): the codes 0, 1, ... of each column's values in order of first appearance; null is -1.

    All columns are coded at once: their distinct values are numbered over sorted ranges, and a column's codes begin at its first number."""
    firsts = rows.where("value is not null").groupBy("column", "value").agg(F.min(order).alias("__first"))
    numbered = stored(global_numbers(firsts, ["column", "__first"], "__number"), "codes")
    begin = numbered.groupBy("column").agg(F.min("__number").alias("__begin"))  # a row for each column
    codes = numbered.join(F.broadcast(begin), "column").select("column", "value", (F.col("__number") - F.col("__begin")).alias("code"))
    some = rows.where("value is not null")
    joined = some.join(F.broadcast(codes), ["column", "value"]) if numbered.count() <= MANY_CODES else grid_join(some, codes, ["column", "value"], order, "code")
    none = rows.where("value is null").select(order, "column", F.lit(-1).cast("long").alias("code"))
    return joined.select(order, "column", "code").unionByName(none)


def factorize(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Each column as codes 0, 1, ... in order of first appearance; null is -1. `order` is unique."""
    names = F.array(*map(F.lit, columns))
    long = df.select(order, F.posexplode(F.array(*(F.col(c).cast("string") for c in columns))).alias("place", "value")).select(order, F.get(names, F.col("place")).alias("column"), "value")
    codes = factorize_long(long, order)
    wide = codes.groupBy(order).agg(*(F.max(F.when(F.col("column") == c, F.col("code"))).alias(c) for c in columns))
    return df.drop(*columns).join(wide, order).select(*df.columns)


def code_vectors(codes: DataFrame, columns: list[str], order: str = "row") -> DataFrame:
    """(order, features): the codes of factorize_long() as one array of doubles in the order of columns; a row dealt by `order` once."""
    places = codes.sparkSession.createDataFrame([(c, k) for k, c in enumerate(columns)], "column string, place int")
    placed = codes.join(F.broadcast(places), "column")
    return placed.groupBy(order).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("code").cast("double").alias("v")))), lambda x: x["v"]).alias("features"))


def feature_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson's correlation of each pair of columns, all in one aggregation."""
    return vector_correlation(df.select(F.array(*(F.col(c).cast("double") for c in columns)).alias("features")), columns)


def vector_correlation(df: DataFrame, names: list[str], features: str = "features") -> DataFrame:
    """(a, b, r) of each pair of the values of an array without nulls, from one pass that sums their products; r is null where one is constant.

    The driver holds the names x names matrix."""
    vectors = df.select(array_to_vector(features).alias("v"))
    if vectors.isEmpty():
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    pairs = [(a, b, None if math.isnan(r := float(matrix[i, j])) else r) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    return df.sparkSession.createDataFrame(pairs, "a string, b string, r double")
