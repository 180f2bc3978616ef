"""Tables of thousands of columns: one array for each sample, and statistics of all columns from the long form.

A column of its own for each of thousands of values makes plans that Spark cannot compile, and aggregates with a buffer for each; here rows are
(ID, position, value) or (ID, array), and the plan is the same for 12 columns and 20,000."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.cohort import IDS, KEYS, WILD, attach, is_mutated

VALUES = "array<double>"


def _places(spark, genes: list[str]) -> DataFrame:
    """(gene, place): 0-based places in the given order."""
    return spark.createDataFrame([(g, k) for k, g in enumerate(genes)], "gene string, place int")


def vector_columns(genes: list[str], features: list[str]) -> list[str]:
    """The names of the values of gene_vectors(), as pivot_features() names its columns."""
    return [f"{g}_{f}" for g in genes for f in features]


def gene_vectors(cells: DataFrame, genes: list[str], width: int, values: str = "values", id_col: str = "ID", ids: DataFrame | None = None, defaults: DataFrame | None = None) -> DataFrame:
    """P11 for any number of genes: (ID, features), an array of len(genes) x width doubles, gene by gene.

    cells: (ID, gene, values) with `width` values each; of repeated cells the least counts, and genes that are not named go. A gene without a cell has the
    values of `defaults` (gene, values), one row for each gene at most, or nulls. ids: a table of all samples; without it those of cells. Rows are dealt by ID once, cells
    of a sample are gathered after that (at most one for each gene), and the defaults are one broadcast row of the result's size."""
    spark = cells.sparkSession
    places = _places(spark, genes)
    blank = F.array_repeat(F.lit(None).cast("double"), width)
    own = places if defaults is None else places.join(defaults.select("gene", F.col(values).cast(VALUES).alias("v")), "gene", "left")
    base = F.coalesce("v", blank) if defaults is not None else blank
    # one row: the defaults of all genes in order
    base = own.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("place", base.alias("v")))), lambda x: x["v"]).alias("base"))
    placed = cells.select(id_col, "gene", F.col(values).cast(VALUES).alias("v")).join(F.broadcast(places), "gene").repartition(id_col)
    single = placed.groupBy(id_col, "place").agg(F.min("v").alias("v"))
    rows = single.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("cells"))
    if ids is not None:
        rows = ids.select(id_col).distinct().join(rows, id_col, "left")
    some = F.coalesce("cells", F.array().cast(f"array<struct<place:int,v:{VALUES}>>"))
    filled = F.transform(F.array(F.struct(F.map_from_entries(some).alias("m"), F.col("base").alias("b"))), lambda x: F.transform(x["b"], lambda b, k: F.coalesce(F.try_element_at(x["m"], k), b)))[0]
    # samples with a cell of every gene need no look-up
    full = F.when(F.size(some) == len(genes), F.transform(some, lambda x: F.coalesce(x["v"], blank))).otherwise(filled)
    return rows.crossJoin(F.broadcast(base)).select(id_col, F.flatten(full).alias("features"))


def saac_vectors(long: DataFrame, table: DataFrame, genes: list[str], width: int, values: str = "values") -> DataFrame:
    """F1 for any number of genes and features: (ID, [SUBCLASS], features) of every sample of a long cohort.

    table: (gene, mutation_str, values). WT cells, which are nearly all, are neither joined nor shuffled: they have the values of their gene's WT row, which the
    other cells replace. A cell that table lacks, or whose gene lacks a WT row, has nulls."""
    ids = [c for c in IDS if c in long.columns]
    mutated = attach(long.where(is_mutated()), table.select(*KEYS, values))
    mutated = mutated.withColumn(values, F.coalesce(F.col(values).cast(VALUES), F.array_repeat(F.lit(None).cast("double"), width)))
    samples = long.select(*ids).distinct()
    vectors = gene_vectors(mutated, genes, width, values, ids=samples, defaults=table.where(F.col("mutation_str") == WILD).select("gene", values))
    return samples.join(vectors, "ID") if len(ids) > 1 else vectors


def weighted_sum(array: Column, period: int = 97) -> Column:
    """The sum of an array with the weights 1, 2, ..., period, 1, 2, ...: nulls count as 0."""
    return F.aggregate(F.transform(array, lambda x, k: F.coalesce(x, F.lit(0.0)) * (k % period + 1)), F.lit(0.0), lambda a, x: a + x)


# --- statistics of columns ---------------------------------------------------------------------


def _named(df: DataFrame, columns: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def long_form(df: DataFrame, columns: list[str], type_: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep.., place, value): a row for each value of the given columns, with the column's place. One expression for all of them, not a projection for each."""
    return df.select(*keep, F.posexplode(F.array(*(c.cast(type_) for c in _named(df, columns)))).alias("place", "value"))


def unpivot_wide(df: DataFrame, id_cols: list[str] | None = None, genes: list[str] | None = None, null_as: str | None = "nan") -> DataFrame:
    """P1 for thousands of genes: the rows of unpivot_cohort()."""
    ids = [c for c in (id_cols or IDS) if c in df.columns]
    names = genes or [c for c in df.columns if c not in ids]
    rows = long_form(df, names, "string", tuple(ids))
    value = F.col("value") if null_as is None else F.coalesce("value", F.lit(null_as))
    return rows.crossJoin(F.broadcast(_name_row(df, names))).select(*ids, F.get("names", F.col("place")).alias("gene"), value.alias("mutation_str"))


def _name_row(df: DataFrame, names: list[str]) -> DataFrame:
    """One row with the array of names."""
    return df.sparkSession.createDataFrame([(names,)], "names array<string>")


def binarize_wide(df: DataFrame, columns: list[str]) -> DataFrame:
    """P4 for thousands of columns: (other columns, flags), flags an array of 0 for WT and 1 for all else, in the order of columns."""
    gone = set(columns)
    flags = F.transform(F.array(*(c.cast("string") for c in _named(df, columns))), lambda x: (~x.eqNullSafe(F.lit(WILD))).cast("int"))
    return df.select(*(f"`{c}`" for c in df.columns if c not in gone), flags.alias("flags"))


def constant_columns_wide(train: DataFrame, columns: list[str]) -> DataFrame:
    """P9 for thousands of columns: the names of those with exactly one distinct non-null value."""
    stats = long_form(train, columns, "string").groupBy("place").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where(F.col("lo") == F.col("hi"))
    return stats.crossJoin(F.broadcast(_name_row(train, columns))).select(F.get("names", F.col("place")).alias("column"))


def _by_column(df: DataFrame, columns: list[str], **made: Column) -> DataFrame:
    """One row with an array for each of `made`, an aggregate of `value`, in the order of columns."""
    # every column has a row, also in an empty table
    every = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("place"))
    stats = long_form(df, columns, "double").groupBy("place").agg(*(c.alias(n) for n, c in made.items()))
    whole = every.join(stats, "place", "left").groupBy().agg(F.array_sort(F.collect_list(F.struct("place", *made))).alias("s"))
    return whole.select(*(F.col("s").getField(n).alias(f"__{n}") for n in made))


def _scaled(df: DataFrame, columns: list[str], stats: DataFrame, value) -> DataFrame:
    """(other columns, features): value(x, statistics of its column) of each of columns."""
    gone, names = set(columns), stats.columns
    zipped = F.arrays_zip(F.array(*(c.cast("double") for c in _named(df, columns))).alias("x"), *(F.col(n) for n in names))
    return df.crossJoin(F.broadcast(stats)).select(*(f"`{c}`" for c in df.columns if c not in gone), F.transform(zipped, value).alias("features"))  # one row of statistics


def min_max_scale_wide(train: DataFrame, test: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """F9 for thousands of columns, as one array `features`: both scaled by train's least and greatest; null where they are equal or missing."""
    stats = _by_column(train, columns, lo=F.min("value"), hi=F.max("value"))
    scale = lambda x: F.when(x["__hi"] > x["__lo"], (x["x"] - x["__lo"]) / (x["__hi"] - x["__lo"]))
    return tuple(_scaled(df, columns, stats, scale) for df in (train, test))


def standardize_wide(train: DataFrame, test: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """F10 for thousands of columns, as one array `features`: by train's mean and sample deviation; a deviation of 0 counts as 1."""
    deviation = F.coalesce(F.nullif(F.stddev_samp("value"), F.lit(0.0)), F.lit(1.0))
    stats = _by_column(train, columns, mean=F.avg("value"), dev=deviation)
    return tuple(_scaled(df, columns, stats, lambda x: (x["x"] - x["__mean"]) / F.coalesce(x["__dev"], F.lit(1.0))) for df in (train, test))
