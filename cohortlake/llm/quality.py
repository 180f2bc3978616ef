"""Quality rules: text statistics, fixed base rules, and robust multivariate outliers, with DataFrame functions alone.

The statistics of a document are transformed (ratios, logarithms) into a vector. For each language and source
the minimum covariance determinant estimator finds centre and scatter of the most concentrated
three quarters of the vectors: from a robust start (medians and median deviations by feature) each step takes
the three quarters nearest by Mahalanobis distance and estimates anew, which never raises the
determinant. A document is rejected if its distance passes a quantile of the chi-square law.

Each step is one pass over a narrow table: a histogram of the logarithms of the distances gives the
nearest three quarters (to a bin of 1/32), sums give mean and scatter; both combine before the shuffle, so a
hot source costs no more than others. Languages, and all rows, are estimated in the same passes. The
estimate of a language and source with n rows is blended with that of its language, and this with
that of all rows, as mean and scatter of a mixture in which the wider one weighs PRIOR_ROWS rows against n: there is no size
at which the method changes, and a source of few rows leans on its language.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Tables, guarded, with_group

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rows of its own at which a language and source counts as much as its language, and a language as much as all.
PRIOR_ROWS = 200
STEPS = 4
CORE = 0.75
#: Share of normal vectors that the cut rejects.
TAIL = 1e-7
#: Least standard deviation of each feature: differences below are not worth a rejection.
FLOORS = [0.08, 0.15, 0.35, 0.5]
P = len(FLOORS)
BINS = 32
window_hash = F.xxhash64


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body names it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in 3-word windows found twice or more.

    Window hashes carry their place in the low bits, are sorted and neighbours compared by their high bits, which every
    repeated window passes; those that pass are sorted once more by their words, so that the count is exact for texts of any length."""
    bits = F.ceil(F.log2(n + F.lit(1))).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: window_hash(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    nowhere = F.lit(False)

    def repeated(b: Column, h: Column) -> Column:
        same = lambda x, y: F.coalesce(F.call_function("shiftright", x, b) == F.call_function("shiftright", y, b), nowhere)
        keyed = F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", x, b).bitwiseOR(i.cast("long"))))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1
        likely = _let(keyed, lambda s: F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x.bitwiseAND(mask).cast("int")))
        exact = F.sort_array(F.transform(likely, lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))))
        alike = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), nowhere)
        found = _let(exact, lambda s: F.transform(F.filter(s, lambda x, i: alike(x, F.get(s, i - 1)) | alike(x, F.get(s, i + 1))), lambda x: x["i"]))
        covered = lambda d: F.aggregate(F.transform(d, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(d, i - 1)))), F.lit(0).cast("long"), lambda a, x: a + x)
        return _let(F.sort_array(found), covered)

    some = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(bits, lambda b: repeated(b, h))))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(some)


def statistics(text: Column) -> Column:
    """A struct of STATISTICS (long) of a text; null counts as empty, and all are 0 without words."""
    t = F.coalesce(text, F.lit(""))
    words = F.split(F.btrim(t, F.lit(WHITE)), "[ \\t-\\r]+")
    bare = F.length(F.translate(t, WHITE, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    dups = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    full = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w, F.size(w)).alias("r")))
    counted = F.when(bare == 0, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("r"))).otherwise(full)
    symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    return _let(counted, lambda c: F.struct(c["n"].alias("n_words"), bare.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), dups.cast("long").alias("n_dup_lines"), c["r"].alias("n_repeat_words")))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _features() -> list[Column]:
    n = F.greatest("n_words", F.lit(1))
    return [F.log(F.greatest("word_chars", F.lit(1)) / n), F.log1p(10 * F.col("n_symbols") / n), F.log1p(10 * F.col("n_repeat_words") / n), F.log1p(F.col("n_dup_lines"))]


def _chi_square(x: float, dof: int) -> float:
    """The distribution function for even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def _chi_square_cut(share: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - _chi_square(mid, dof) > share else (low, mid)
    return high


#: The scatter of the nearest three quarters of normal vectors is smaller than that of all by this factor.
CONSISTENCY = CORE / _chi_square(_chi_square_cut(1 - CORE, P), P + 2)


def _distance(x: list[str]) -> Column:
    """The squared Mahalanobis distance of features x to mean m0.. with scatter s00.., by Cholesky's factors computed in the row of parameters."""
    z: list[Column] = []
    for i in range(P):
        rest = F.col(x[i]) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in z), F.lit(0.0))


def _factors(params: DataFrame) -> DataFrame:
    """Adds the lower triangle l of the scatter s = l l^T."""
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"s{j}{i}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return params


def _quantile_bin(df: DataFrame, by: list[str], bin_: str, share: float) -> DataFrame:
    """For each `by` the first bin at which at least `share` of the rows are at or below."""
    counts = df.groupBy(*by, bin_).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by)
    running = counts.withColumn("__run", F.sum("__c").over(w.orderBy(bin_))).withColumn("__all", F.sum("__c").over(w))
    return running.where(F.col("__run") >= F.col("__all") * share).groupBy(*by).agg(F.min(bin_).alias(bin_))


MEANS = [f"m{i}" for i in range(P)]
PAIRS = list(combinations_with_replacement(range(P), 2))


def fit(rows: DataFrame, tables: Tables, n_groups: int) -> DataFrame:
    """(group, n, m0.., s00..) from rows (group, x0..): minimum covariance determinant estimates of each group."""
    x = [f"x{i}" for i in range(P)]
    long = rows.select("group", F.posexplode(F.array(*x)).alias("i", "v")).withColumn("bin", F.floor(F.col("v") * BINS))
    median = tables.put(_quantile_bin(long, ["group", "i"], "bin", 0.5).select("group", "i", ((F.col("bin") + 0.5) / BINS).alias("m")), "medians")
    off = with_group(long.drop("bin"), median, ["group", "i"], n_groups * P).withColumn("bin", F.floor(F.abs(F.col("v") - F.col("m")) * BINS)).select("group", "i", "m", "bin")
    spread = _quantile_bin(off, ["group", "i", "m"], "bin", 0.5).withColumn("s", 1.4826 * (F.col("bin") + 0.5) / BINS)
    at = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    start = [at(i, "m").alias(f"m{i}") for i in range(P)] + [(F.pow(at(i, "s"), 2) + FLOORS[i] ** 2).alias(f"s{i}{i}") for i in range(P)]
    params = spread.groupBy("group").agg(*start)
    params = tables.put(params.select("*", *(F.lit(0.0).alias(f"s{i}{j}") for i, j in PAIRS if i != j)), "fit-0")
    for k in range(STEPS):
        near = with_group(rows, _factors(params), ["group"], n_groups).withColumn("bin", F.floor(F.log(_distance(x) + 1e-6) * BINS))
        cut = _quantile_bin(near.select("group", "bin"), ["group"], "bin", CORE).withColumnRenamed("bin", "cut")
        core = with_group(near, cut, ["group"], n_groups).where("bin <= cut")
        scatter = [(CONSISTENCY * F.covar_pop(f"x{i}", f"x{j}") + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"s{i}{j}") for i, j in PAIRS]
        params = tables.put(core.groupBy("group").agg(*(F.avg(f"x{i}").alias(f"m{i}") for i in range(P)), *scatter), f"fit-{k + 1}")
    return params


def _blended(own: str, wide: str, n: Column) -> list[Column]:
    """Mean and scatter of a mixture of the estimates `own`, with n rows, and `wide`, with PRIOR_ROWS."""
    w = n / (n + F.lit(float(PRIOR_ROWS)))
    at = lambda side, c: F.col(f"{side}.{c}")
    means = [(w * at(own, m) + (1 - w) * at(wide, m)).alias(m) for m in MEANS]
    apart = lambda i: at(own, f"m{i}") - at(wide, f"m{i}")
    return means + [(w * at(own, f"s{i}{j}") + (1 - w) * at(wide, f"s{i}{j}") + w * (1 - w) * apart(i) * apart(j)).alias(f"s{i}{j}") for i, j in PAIRS]


def estimates(good: DataFrame, tables: Tables) -> tuple[DataFrame, int]:
    """(__lang, __source, m.., l..) for each language and source of rows (__lang, __source, x0..), and their number."""
    groups = tables.put(good.groupBy("__lang", "__source").agg(F.count("*").alias("n")), "groups")
    n_groups = groups.count()
    levels = [F.struct(F.lit(0).alias("level"), F.concat(F.length("__lang").cast("string"), F.lit(":"), F.col("__lang"), F.col("__source")).alias("group")), F.struct(F.lit(1).alias("level"), F.col("__lang").alias("group")), F.struct(F.lit(2).alias("level"), F.lit("").alias("group"))]
    named = lambda at: F.concat(at["level"].cast("string"), at["group"])
    vectors = tables.put(good.select(F.explode(F.array(*map(named, levels))).alias("group"), *(f"x{i}" for i in range(P))), "vectors")
    params = fit(vectors, tables, 2 * n_groups + 1)
    every = params.where(F.col("group") == "2").alias("every")
    langs = groups.groupBy("__lang").agg(F.sum("n").alias("nl"))
    langs = langs.join(params.alias("own"), named(levels[1]) == F.col("own.group")).crossJoin(F.broadcast(every))  # one row
    langs = langs.select("__lang", *_blended("own", "every", F.col("nl")))
    langs = tables.put(langs, "languages").alias("wide")
    both = groups.join(params.alias("own"), named(levels[0]) == F.col("own.group")).join(langs, "__lang").select("__lang", "__source", *_blended("own", "wide", F.col("n")))
    return tables.put(_factors(both).select("__lang", "__source", *MEANS, *(f"l{i}{j}" for i in range(P) for j in range(i + 1))), "parameters"), n_groups


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = True) -> DataFrame:
    """Adds STATISTICS, base_failed and kept to each row.

    Null texts count as empty and fail the base rules; null languages and sources are values of their own. Very long
    texts are judged whole. Rows that repeat count as often. An empty table stays empty. With keep_text=False the text goes,
    which saves writing it. Existing columns of these names are replaced."""
    tables = Tables(docs.sparkSession, "quality")
    names = [*STATISTICS, "base_failed", "kept"]
    kept = docs.drop(*names)
    columns = [c for c in kept.columns if keep_text or c != text]
    df = kept.withColumn("__s", statistics(F.col(text))).select(*columns, F.col("__s.*")).withColumn("base_failed", base_failed())
    df = tables.put(df, "statistics")
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    keyed = df.withColumn("__lang", key(lang)).withColumn("__source", key(source))
    good = keyed.where(~F.col("base_failed")).select("__lang", "__source", *(f.alias(f"x{i}") for i, f in enumerate(_features())))
    params, n_groups = estimates(good, tables)
    tables.keep("statistics", "parameters")
    judged = with_group(keyed, params, ["__lang", "__source"], n_groups, "left").select("*", *(f.alias(f"x{i}") for i, f in enumerate(_features())))
    inside = F.coalesce(_distance([f"x{i}" for i in range(P)]) <= _chi_square_cut(TAIL, P), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & inside).select(*columns, *names)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their own columns, whatever their names. Handles all that judge() does."""
    return guarded(docs, [*STATISTICS, "base_failed", "kept"], lambda d: judge(d).where("kept"))
