"""Codes, scaling, splits, MLlib steps and evaluation: tables in, tables out."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions import mutations as M
from cohortlake.operators.cohort import attach, attach_labels, attach_saac, pivot_features, unpivot_cohort
from cohortlake.operators.joins import global_numbers

#: Strata or classes whose rows of parameters are broadcast at most.
MANY_STRATA = 50_000
#: Parts into which the scores of a class are cut.
SCORE_PARTS = 256


def saac_features(cohort: DataFrame, saac: DataFrame, genes: list[str], features: list[str], is_train: bool = True) -> DataFrame:
    """the wide feature table: unpivot, join the composition, pivot to {gene}_{feature}, and for train the labels."""
    wide = pivot_features(attach_saac(unpivot_cohort(cohort, genes=genes), saac), genes, features)
    return attach_labels(cohort, wide) if is_train else wide


def index_labels(df: DataFrame, col: str, order: str | None = None) -> DataFrame:
    """the distinct values of col with index 0, 1, ...: sorted, or by first appearance in `order`."""
    by = F.min(order) if order else F.first(col)
    return global_numbers(df.groupBy(col).agg(by.alias("__o")), ["__o", col], "index").select(col, F.col("index").cast("int").alias("index"))


def type_index(c: Column, short: bool = False) -> Column:
    """the code of a mutation type: of 11 (null if unknown), or of 7 from 1 on, 0 for all others."""
    vocabulary, first = (M.SHORT_TYPES, 1) if short else (M.TYPES, 0)
    code = F.try_element_at(F.create_map(*(F.lit(x) for k, t in enumerate(vocabulary) for x in (t, k + first))), c)
    return F.coalesce(code, F.lit(0)) if short else code


def index_genes(spark, genes: list[str]) -> DataFrame:
    """1-based codes in column order; 0 is padding."""
    return spark.createDataFrame([(g, k + 1) for k, g in enumerate(genes)], "gene string, gene_id int")


def label_encode_cells(long: DataFrame) -> DataFrame:
    """code: the place of each cell's value among the sorted distinct ones of its gene."""
    codes = long.select("gene", "mutation_str").distinct().withColumn("code", F.dense_rank().over(Window.partitionBy("gene").orderBy("mutation_str")) - 1)
    return attach(long, codes)


def one_hot(c: Column, size: int) -> Column:
    """an array of size with 1 at the index."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (k == c).cast("int"))


def min_max_scale(train: DataFrame, test: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """both scaled by train's least and greatest; null where they are equal."""
    span = train.agg(*(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"__{c}") for c in columns))
    scaled = {c: F.when(F.col(f"__{c}.hi") > F.col(f"__{c}.lo"), (F.col(c) - F.col(f"__{c}.lo")) / (F.col(f"__{c}.hi") - F.col(f"__{c}.lo"))) for c in columns}
    return tuple(df.crossJoin(F.broadcast(span)).withColumns(scaled).drop(*(f"__{c}" for c in columns)) for df in (train, test))  # one row


def standardize(train: DataFrame, test: DataFrame, columns: list[str], exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """both by train's mean and sample deviation; a deviation of 0 counts as 1; excluded columns stay."""
    columns = [c for c in columns if c not in exclude]
    deviation = lambda c: F.when(F.coalesce(F.stddev_samp(c), F.lit(0.0)) == 0, 1.0).otherwise(F.stddev_samp(c))
    stats = train.agg(*(F.struct(F.avg(c).alias("m"), deviation(c).alias("s")).alias(f"__{c}") for c in columns))
    scaled = {c: (F.col(c) - F.col(f"__{c}.m")) / F.col(f"__{c}.s") for c in columns}
    return tuple(df.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*(f"__{c}" for c in columns)) for df in (train, test))  # one row


def train_val_split(df: DataFrame, share: float = 0.2, stratify: str = "SUBCLASS", key: str = "ID") -> DataFrame:
    """is_val for `share` of each stratum, by the order of a hash of the key: exact and the same on each run.

    Rows are counted in 65,536 buckets by the hash's first signs; only those of the bucket in which a stratum's share
    ends are ranked, so no task sees a whole stratum. A null stratum is one of its own."""
    digest = F.sha2(F.col(key).cast("string"), 256)
    name = F.coalesce(F.concat(F.lit("="), F.col(stratify).cast("string")), F.lit("-"))
    rows = df.withColumn("__digest", digest).withColumn("__stratum", name).withColumn("__bucket", F.conv(F.substring("__digest", 1, 4), 16, 10).cast("int"))
    counts = rows.groupBy("__stratum", "__bucket").agg(F.count("*").alias("__n"))
    by_stratum = Window.partitionBy("__stratum")
    counts = counts.withColumn("__before", F.sum("__n").over(by_stratum.orderBy("__bucket")) - F.col("__n")).withColumn("__all", F.sum("__n").over(by_stratum))
    # percent_rank is the rows before over all but one; the last bucket that begins below the share holds its end
    below = counts.where(F.coalesce(F.try_divide(F.col("__before"), F.col("__all") - 1), F.lit(0.0)) < share)
    ends = below.groupBy("__stratum").agg(F.max("__bucket").alias("__end"), F.max("__before").alias("__before"), F.max("__all").alias("__all"))
    joined = rows.join(F.broadcast(ends) if ends.count() <= MANY_STRATA else ends, "__stratum", "left")
    edge = joined.where("__bucket = __end").withColumn("__rank", F.rank().over(Window.partitionBy("__stratum").orderBy("__digest", key)) - 1 + F.col("__before"))
    edge = edge.withColumn("is_val", F.coalesce(F.try_divide(F.col("__rank"), F.col("__all") - 1), F.lit(0.0)) < share)
    rest = joined.where("__bucket <> __end or __end is null").withColumn("is_val", F.coalesce(F.col("__bucket") < F.col("__end"), F.lit(False)))
    return rest.select(*df.columns, "is_val").unionByName(edge.select(*df.columns, "is_val"))


def pca_variance(train: DataFrame, test: DataFrame, columns: list[str], share: float = 0.95) -> tuple[DataFrame, DataFrame, int]:
    """`pca` (array) with the fewest components that hold `share` of train's variance, and how many eigenvalues exceed 1.

    MLlib keeps the columns x columns covariance on the driver: some thousands of columns at most; drop constants first."""
    assemble = VectorAssembler(inputCols=columns, outputCol="__x")
    a, b = assemble.transform(train), assemble.transform(test)
    model = PCA(k=len(columns), inputCol="__x", outputCol="__p").fit(a)
    ratios = list(model.explainedVariance)
    total, k = 0.0, 0
    while k < len(ratios) and total < share - 1e-12:
        total, k = total + ratios[k], k + 1
    variance = train.agg(sum((F.var_samp(c) for c in columns), F.lit(0.0)).alias("v")).first()["v"]
    kaiser = sum(r * variance > 1 for r in ratios)
    out = tuple(model.transform(x).withColumn("pca", F.slice(vector_to_array("__p"), 1, k)).drop("__x", "__p") for x in (a, b))
    return (*out, kaiser)


def rf_importance(df: DataFrame, columns: list[str], label: str, trees: int = 100, seed: int = 42) -> DataFrame:
    """the columns by importance in a forest on 0/1 columns."""
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(df).select("features", F.col(label).cast("double").alias("label"))
    model = RandomForestClassifier(numTrees=trees, seed=seed).fit(rows)
    scores = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(scores, "feature string, importance double").withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """F15."""
    return pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """precision, recall, f1 and support of each class, with accuracy and macro_f1 (a plain mean) beside; 0 where undefined."""
    cells = confusion_matrix(pred, label, prediction)
    both = cells.select(F.explode(F.array(F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    per = both.groupBy("class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    per = per.withColumn("precision", ratio(F.col("hit"), F.col("predicted"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    per = per.withColumn("f1", ratio(2 * F.col("hit"), F.col("predicted") + F.col("support")))
    all_ = Window.partitionBy()  # a row for each class
    return per.select("class", "precision", "recall", "f1", "support", (F.sum("hit").over(all_) / F.sum("support").over(all_)).alias("accuracy"), F.avg("f1").over(all_).alias("macro_f1"))


def roc_pr_by_class(scores: DataFrame, by: str = "class", score: str = "score", positive: str = "positive") -> DataFrame:
    """F16: ROC AUC and average precision of each class, from (class, score, positive 0/1) rows; equal scores are one threshold.

    Scores are counted first. Each class's distinct scores are cut at approximate quantiles into SCORE_PARTS; running sums are those of a
    part plus the totals of the parts above it, so that no task sees a whole class. Where the cuts lie changes no result."""
    t = scores.groupBy(by, score).agg(F.sum(positive).alias("p"), F.count("*").alias("n"))
    cuts = t.groupBy(by).agg(F.percentile_approx(score, [k / SCORE_PARTS for k in range(1, SCORE_PARTS)], 10_000).alias("__cuts"))
    cuts = F.broadcast(cuts) if cuts.count() <= MANY_STRATA else cuts
    t = t.join(cuts, by).withColumn("part", F.size(F.filter("__cuts", lambda c: c < F.col(score)))).drop("__cuts")
    totals = t.groupBy(by, "part").agg(F.sum("p").alias("pp"), F.sum("n").alias("pn"))
    above = Window.partitionBy(by).orderBy(F.col("part").desc())  # a row for each part
    whole = Window.partitionBy(by)
    totals = totals.select(by, "part", (F.sum("pp").over(above) - F.col("pp")).alias("p0"), (F.sum("pn").over(above) - F.col("pn")).alias("n0"), F.sum("pp").over(whole).alias("pos"), F.sum(F.col("pn") - F.col("pp")).over(whole).alias("neg"))
    down = Window.partitionBy(by, "part").orderBy(F.col(score).desc())
    t = t.join(totals, [by, "part"]).withColumns({"tp": F.sum("p").over(down) + F.col("p0"), "k": F.sum("n").over(down) + F.col("n0")})
    # pairs of a negative here and a positive above, ties counting half
    area = F.sum((F.col("n") - F.col("p")) * (F.col("tp") - F.col("p") / 2))
    precision = F.sum(F.col("p") * F.col("tp") / F.col("k"))
    return t.groupBy(by, "pos", "neg").agg(area.alias("a"), precision.alias("ap")).select(by, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("a") / (F.col("pos") * F.col("neg"))).alias("roc_auc"), F.when(F.col("pos") > 0, F.col("ap") / F.col("pos")).alias("average_precision"))


def roc_pr_micro(scores: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """F16: the same over all classes' rows at once."""
    return roc_pr_by_class(scores.withColumn("__all", F.lit("micro")), "__all", score, positive).withColumnRenamed("__all", "class")


def decode_predictions(pred: DataFrame, vocabulary: DataFrame, col: str = "prediction", label: str = "label") -> DataFrame:
    """(ID, label) by the index table of F2."""
    return pred.join(vocabulary.select(F.col("index").alias("__i"), F.col(vocabulary.columns[0]).alias("__label")), F.col(col) == F.col("__i"), "left").select("ID", F.col("__label").alias(label))
