"""Secret scanning with a random forest that removes false positives, with DataFrame functions and MLlib alone.

Candidates are runs of 16 or more key signs, runs behind known prefixes, and values of any length and signs that are assigned to
a credential's name or stand as the password in a url. Each becomes a row with features: its length and mix of signs; how likely its signs
follow each other (transitions) in the words of the corpus; the share of it in words of the corpus's dictionary; the path of its
document; and the words around it. Dictionary (words in MIN_DOCS documents or more) and transitions (36 x 36 counts of
signs in dictionary words, by their documents) are counted over all documents.

The forest is trained on labelled findings: those of the caller, or planted ones. Planting puts values whose nature is known by
how they are made, credentials of many forms and hashes, numbers, names, paths, prose and placeholders that are none, into
passages sampled from the corpus, and scans these as any document; so no label is a rule over the features. held_out() measures a
forest on planted findings that it has not seen.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Tables, spread_join

MIN_LENGTH = 16
#: Issuers' prefixes, behind which fewer signs and dots are taken as well.
PREFIX = "(?<![A-Za-z0-9])(?:AKIA|ASIA|AIza|eyJ|gh[pousr]_|github_pat_|glpat-|xox[a-z]-|[sr]k_live_|sk-|hf_|npm_|SG\\.)"
# a group that repeats is possessive: the matcher would go one call deeper for each part that it could give back
CANDIDATE = f"{PREFIX}[A-Za-z0-9_-]{{8,}}(?:\\.[A-Za-z0-9_-]++)*+|[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}={{0,2}}"
#: Octets of the shortest candidate by its form.
SHORTEST = 11
MIN_DOCS = 5
#: About so many findings are planted, and at most about so many distinct feature vectors of each label are trained on.
PLANTED = 30_000
TRAIN_ROWS = 20_000
TRAIN_TASKS = 4
TREES, DEPTH = 40, 10
#: Names that go with credentials, those of placeholders, and those of values that only look like keys.
CREDENTIAL = "(?i)(token|secret|passw|pwd|api.?key|auth|bearer|credential|private.?key|access.?key)"
PLACEHOLDER = "(?i)(example|sample|dummy|placeholder|changeme|your.?|xxxx|test|[$]\\{|<|environ|getenv)"
DIGEST = "(?i)(sha\\d*|md5|checksum|digest|commit|revision|hash|uuid|guid|etag|fingerprint|\\bids?\\b|number|order|card|base64)"
SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Signs of an assigned value that are taken at most; so values that each reach over the next ones take no more than so many times the text.
MOST_SIGNS = 4096
#: What stands before an assigned value (group 1: to its quote, or to white space, a quote or the next assignment behind one of ;,&) or before the password of a url (group 2); values
#: are looked at and not consumed, so that one which names the next is no obstacle.
ASSIGNED = (
    "(?i)(?:token|secret|passw|pwd|api.?key|auth(?!or(?!i))|bearer|credential|private.?key|access.?key)[\\w.\\-]*+[\"'`\\])]*+[ \\t-\\r]*+(?::=|=>|[=:])[ \\t-\\r]*+(?:(?:bearer|basic)[ \\t-\\r]++)?+[\"'`]?+"
    f"(?=((?<=\")[^\"\\r\\n]{{1,{MOST_SIGNS}}}|(?<=')[^'\\r\\n]{{1,{MOST_SIGNS}}}|(?<=`)[^`\\r\\n]{{1,{MOST_SIGNS}}}|(?<![\"'`])(?:[^ \\t-\\r\"'`;,&]|[;,&](?![\\w.\\-]{{1,99}}[=:])){{1,{MOST_SIGNS}}}+))"
    f"|://[^ \\t-\\r/:@\"'`]*+:(?=([^ \\t-\\r@\"'`]{{1,{MOST_SIGNS}}})@)"
)
FEATURES = ["length", "digits", "uppers", "others", "distinct", "switches", "transitions", "hex", "words", "placeholder", "named", "assigned", "quoted", "named_near", "digest_near", "path_depth", "path_test"]


def _word(w: Column, i: Column) -> Column:
    return F.coalesce(F.get(w, i), F.lit(""))


#: Signs of each neighbouring word, and of what stands before a candidate in its word, that features see.
NEAR = 200
#: Stands for the place of a value while words are counted; in texts another one stands for it.
MARK, NO_MARK = "\ue000", "\ue001"


def _packed(word: Column, token: Column, start: Column | None = None) -> Column:
    """A candidate as one string, since arrays of strings are told apart by hashing and those of structs by comparing all pairs."""
    return F.concat(word.cast("string"), F.lit(":"), F.length(token).cast("string"), F.lit(":"), token, *([] if start is None else [start]))


def _unpacked(x: Column, start: Column | None) -> Column:
    """(word, token, start): what stands behind the token in x, or the given start."""
    parts = F.transform(F.array(F.split(x, ":", 3)), lambda p: F.struct(p[0].cast("int").alias("word"), F.left(p[2], p[1].cast("int")).alias("token"), (F.substr(p[2], p[1].cast("int") + 1) if start is None else start).alias("start")))
    return parts[0]


def _assigned(t: Column) -> Column:
    """An array of (word, token, start), packed: assigned values, the place of their first word, and what they are assigned to. In time proportional to the text."""
    value = F.zip_with(F.regexp_extract_all(t, F.lit(ASSIGNED), F.lit(1)), F.regexp_extract_all(t, F.lit(ASSIGNED), F.lit(2)), lambda x, y: F.concat(x, y))
    # a mark before each value tells its word; a word has as many values as marks
    marked = F.split(F.regexp_replace(F.replace(t, F.lit(MARK), F.lit(NO_MARK)), F.lit(ASSIGNED), F.lit("$0" + MARK)), "[ \\t-\\r]+")
    place = F.flatten(F.transform(marked, lambda w, i: F.array_repeat(i, F.length(w) - F.length(F.replace(w, F.lit(MARK), F.lit(""))))))
    each = F.arrays_zip(place.alias("word"), F.regexp_extract_all(t, F.lit(ASSIGNED), F.lit(0)).alias("start"), value.alias("token"))
    some = F.filter(each, lambda x: F.trim(x["token"]) != "")
    return F.when(t.rlike(ASSIGNED), F.array_distinct(F.transform(some, lambda x: _packed(x["word"], x["token"], F.right(x["start"], F.lit(NEAR)))))).otherwise(F.array().cast("array<string>"))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """(doc_id, path, word, before, after, token, start): each candidate with the place of its (first) word, the NEAR signs next to it of the words around and
    what stands before it in its word, or what it is assigned to."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.split(t, "[ \\t-\\r]+")
    place = lambda w: F.filter(F.transform(w, lambda x, i: F.when((F.octet_length(x) >= SHORTEST) & x.rlike(CANDIDATE), i)), lambda i: i.isNotNull())
    by_form = lambda w: F.flatten(F.transform(place(w), lambda i: F.transform(F.array_distinct(F.regexp_extract_all(F.get(w, i), F.lit(CANDIDATE), F.lit(0))), lambda x: _packed(i, x))))
    of_values = lambda v: F.transform(v, lambda x: F.transform(F.array(_unpacked(x, None)), lambda y: _packed(y["word"], y["token"]))[0])
    ahead = lambda w, x: F.right(F.call_function("substring_index", F.get(w, x["word"]), x["token"], F.lit(1)), F.lit(NEAR))
    rest = lambda w, v: F.transform(F.array_except(by_form(w), of_values(v)), lambda x: F.transform(F.array(_unpacked(x, F.lit(""))), lambda y: F.struct(y["word"].alias("word"), y["token"].alias("token"), ahead(w, y).alias("start")))[0])
    before = lambda w, i: F.concat_ws(" ", *(F.right(_word(w, i - k), F.lit(NEAR)) for k in (3, 2, 1)))
    after = lambda w, i: F.concat_ws(" ", *(F.left(_word(w, i + k), F.lit(NEAR)) for k in (1, 2)))
    near = lambda w, x: F.struct(x["word"].alias("word"), before(w, x["word"]).alias("before"), after(w, x["word"]).alias("after"), x["token"].alias("token"), x["start"].alias("start"))
    both = F.transform(F.array(F.struct(words.alias("w"), _assigned(t).alias("v"))), lambda d: F.transform(F.concat(F.transform(d["v"], lambda x: _unpacked(x, None)), rest(d["w"], d["v"])), lambda x: near(d["w"], x)))[0]
    return docs.select(F.col(doc_id).alias("doc_id"), (F.col(path) if path else F.lit(None)).cast("string").alias("path"), F.explode(both).alias("x")).select("doc_id", "path", "x.*")


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(piece, n): lower-case words of 3 to 15 ASCII letters and digits that stand in n >= MIN_DOCS documents."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+"))
    each = docs.select(F.explode(F.filter(words, lambda w: F.length(w).between(3, 15))).alias("piece"))
    return each.groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS)


def transitions(words: DataFrame) -> DataFrame:
    """One row with `t`: the logarithms of the probabilities that one of SIGNS follows another in words (piece, n), row by row; add-one smoothed."""
    code = lambda c: F.locate(c, F.lit(SIGNS)) if isinstance(c, str) else F.instr(F.lit(SIGNS), c)
    signs = F.split("piece", "")
    pairs = words.select("n", F.explode(F.transform(F.slice(signs, 1, F.size(signs) - 1), lambda c, i: F.struct(code(c).alias("a"), code(F.get(signs, i + 1)).alias("b")))).alias("x"))
    counts = {(r.a, r.b): r.n for r in pairs.groupBy("x.a", "x.b").agg(F.sum("n").alias("n")).collect()}  # at most 36 x 36 rows
    size = range(1, len(SIGNS) + 1)
    total = {a: sum(counts.get((a, b), 0) for b in size) + len(SIGNS) for a in size}
    return words.sparkSession.createDataFrame([([math.log((counts.get((a, b), 0) + 1) / total[a]) for a in size for b in size],)], "t array<double>")


def _token_features(found: DataFrame, words: DataFrame, chances: DataFrame, tables: Tables) -> DataFrame:
    """A row for each distinct token, with its count and the features that rest on it alone."""
    t, n = F.col("token"), F.length("token")
    tokens = tables.put(found.groupBy("token").count(), "tokens")
    pieces = tokens.select("token", F.explode(F.array_distinct(F.split(F.lower("token"), "[^a-z0-9]+"))).alias("piece")).where(F.length("piece") >= 3)
    shared_words = words.select("piece").join(pieces.groupBy("piece").count(), "piece")
    known = spread_join(pieces, shared_words, "piece", tokens.count(), "token").groupBy("token").agg(F.sum(F.length("piece")).alias("__known"))
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    code = lambda c: F.instr(F.lit(SIGNS), c)
    signs = F.split(F.lower("token"), "")
    follow = lambda a, b: F.when((code(a) > 0) & (code(b) > 0), F.get("t", (code(a) - 1) * len(SIGNS) + code(b) - 1))
    steps = F.filter(F.transform(signs, lambda c, i: follow(c, F.get(signs, i + 1))), lambda x: x.isNotNull())
    mean = F.transform(F.array(steps), lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / F.size(x)).otherwise(F.lit(-math.log(len(SIGNS)))))[0]
    made = {
        "length": n.cast("double"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "others": share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(t, ""))) / n,
        "switches": share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "transitions": mean,
        "hex": t.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"),
        "words": F.least(F.coalesce("__known", F.lit(0)) / n, F.lit(1.0)),
        "placeholder_token": t.rlike(PLACEHOLDER),
    }
    return tokens.join(known, "token", "left").crossJoin(F.broadcast(chances)).withColumns(made).drop("__known", "t")  # one row of chances


def features(found: DataFrame, words: DataFrame, chances: DataFrame, tables: Tables) -> DataFrame:
    """Adds FEATURES (doubles) to candidates."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    start, path = F.col("start"), F.coalesce("path", F.lit(""))
    around = F.concat_ws(" ", F.substring_index("before", " ", -2), start)
    made = {
        "placeholder": flag(F.col("placeholder_token") | F.col("before").rlike(PLACEHOLDER)),
        "named": flag(around.rlike(CREDENTIAL)),
        "assigned": flag(F.concat(F.col("before"), start).rlike("[=:>][ \\t-\\r]*[\"'`]?$")),
        "quoted": flag(start.rlike("[\"'`]$")),
        "named_near": flag(F.concat_ws(" ", "before", "after").rlike(CREDENTIAL)),
        "digest_near": flag(around.rlike(DIGEST)),
        "path_depth": F.regexp_count(path, F.lit("/")).cast("double"),
        "path_test": flag(path.rlike("(?i)(test|example|sample|doc)")),
    }
    per_token = tables.put(_token_features(found, words, chances, tables), "token-features")
    return spread_join(found, per_token, "token", found.count(), "before").withColumns(made).drop("placeholder_token", "count")


# --- labelled findings ------------------------------------------------------------------------

NAMES = ["token", "api_key", "secret", "access_key", "auth_token", "client_secret", "password", "passwd", "db.password", "API_TOKEN", "private_key", "bearer"]
LOOKS = ["commit", "sha256", "md5", "checksum", "etag", "revision", "digest", "uuid", "id", "key", "ref", "build"]


def _kinds(h: Column, words: Column) -> list[tuple[int, Column, Column, Column]]:
    """(label, what stands before, the value, what stands behind) of each kind of planted finding, from a hash and the words around."""
    L = F.lit
    hexes = F.concat(F.sha2(h.cast("string"), 512), F.sha2(F.concat(h.cast("string"), L("+")), 512))
    base = F.base64(F.unhex(hexes))
    letters = F.regexp_replace(base, "[+/=\\r\\n]", "")
    digits = F.translate(hexes, "abcdef", "172839")
    pick = lambda options, salt: F.get(F.array(*map(L, options)), F.pmod(F.xxhash64(h, L(salt)), L(len(options))).cast("int"))
    size = lambda low, high, salt: (F.pmod(F.xxhash64(h, L(salt)), L(high - low + 1)) + low).cast("int")
    cut = lambda x, n, at=1: F.substring(x, L(at), n if isinstance(n, Column) else L(n))
    name, look = pick(NAMES, 1), pick(LOOKS, 2)
    word = lambda k: F.regexp_replace(F.coalesce(F.get(words, F.pmod(F.xxhash64(h, L(90 + k)), F.greatest(F.size(words), L(1))).cast("int")), L("")), "[^A-Za-z0-9]", "")
    plain = [F.when(F.length(word(k)) > 1, word(k)).otherwise(L("value")) for k in range(6)]
    glued = lambda sign, n=5: F.concat_ws(sign, *plain[:n])
    camel = F.concat(*(F.initcap(x) for x in plain[:5]))
    uuid = F.concat_ws("-", cut(hexes, 8), cut(hexes, 4, 9), cut(hexes, 4, 13), cut(hexes, 4, 17), cut(hexes, 12, 21))
    symbols = F.concat(cut(letters, size(3, 6, 3)), pick(list("!@%^&*#?~."), 4), cut(letters, size(3, 7, 5), 20), pick(list("!@%^&*#?~"), 6))
    fixed = ["changeme", "your-api-key-here", "YOUR_TOKEN_HERE_1234", "xxxxxxxxxxxxxxxx", "example-secret-value", "${DB_PASSWORD}", "<your-token-goes-here>", "placeholder-token-0000", "test-test-test-test", "os.environ['API_TOKEN']", "getenv('SECRET_KEY')", "null", "true", "none", "required"]
    q = pick(['"', "'", ""], 7)
    gap = pick([" = ", "=", ": ", ":", " := "], 8)
    return [
        (1, F.concat(name, gap, q), cut(hexes, pick([32, 40, 64], 9)), q),
        (1, F.concat(name, gap, q), cut(letters, size(20, 60, 10)), q),
        (1, F.concat(name, gap, q), cut(base, size(24, 80, 11)), q),
        (1, F.concat(L("export "), F.upper(name), L("=")), cut(letters, size(16, 48, 12)), L("")),
        (1, F.concat(name, gap, L('"')), symbols, L('"')),
        (1, F.concat(name, gap, L("'")), cut(letters, size(8, 15, 13)), L("'")),
        (1, L("Authorization: Bearer "), cut(letters, size(24, 64, 14)), L("")),
        (1, pick(["", "key ", "see ", "use "], 15), F.concat(pick(["AKIA", "ASIA"], 16), F.upper(cut(letters, 16))), L("")),
        (1, pick(["", "with ", "my "], 17), F.concat(pick(["ghp_", "gho_", "glpat-", "sk_live_", "hf_", "npm_", "xoxb-", "sk-"], 18), cut(letters, size(20, 40, 19))), L("")),
        (1, L("cookie "), F.concat(L("eyJ"), cut(letters, 20), L(".eyJ"), cut(letters, 40, 30), L("."), cut(letters, 43, 70)), L("")),
        (1, F.concat(pick(["postgres", "mysql", "amqp", "https"], 20), L("://"), plain[0], L(":")), F.regexp_replace(symbols, "[@/:#?]", "_"), F.concat(L("@"), plain[1], L(".net/db"))),
        (1, F.concat(L("the "), name, L(" is ")), cut(letters, size(20, 48, 21)), L(" now")),
        (0, F.concat(look, pick([" ", ": ", "=", ":"], 22)), cut(hexes, pick([32, 40, 64], 23)), L("")),
        (0, F.concat(look, L(' = "')), cut(hexes, pick([32, 40, 64], 24)), L('"')),
        (0, pick(["id ", "request-id: ", 'uuid = "', "session "], 25), uuid, L("")),
        (0, pick(["order ", "number ", "card ", "", "call ", "paid with "], 26), cut(digits, size(16, 19, 27)), L("")),
        (0, L(""), glued(""), L("")),
        (0, L(""), glued("-"), L("")),
        (0, L(""), glued("_"), L("")),
        (0, pick(["", "see ", "in "], 28), F.concat(L("src/"), glued("/")), L(".py")),
        (0, pick(["", "class ", "call "], 29), camel, L("()")),
        (0, L(""), F.upper(glued("_", 4)), L("")),
        (0, L(""), F.repeat(F.concat(plain[0], plain[1]), 3), L("")),
        (0, F.concat(name, gap, q), pick(fixed, 30), q),
        (0, F.concat(name, gap, q), glued("-", 3), q),
        (0, F.concat(name, pick([": ", " = "], 31)), plain[2], F.concat(L(" "), plain[3])),
        (0, F.concat(name, L(': "')), glued(" ", 4), L('"')),
        (0, pick(["data:image/png;base64,", "base64 ", "content = "], 32), F.base64(F.encode(glued(" ", 6), "UTF-8")), L("")),
    ]


def planted(docs: DataFrame, tables: Tables, text: str = "text", path: str | None = "source", total: int = PLANTED) -> DataFrame:
    """Candidates, as candidates() has them, with `label`: about `total` findings planted into passages of documents.

    Passages come from a hash sample of the distinct texts, several from each where there are few."""
    n = max(1, docs.count())
    each = math.ceil(total / n)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(11), F.coalesce(F.col(text), F.lit(""))), 11) / F.lit(float(1 << 53))
    sample = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"), (F.col(path) if path else F.lit(None)).cast("string").alias("path"))
    sample = tables.put(sample.where(u < min(1.0, total / (n * each))).distinct(), "passages")
    rows = sample.select("path", F.split("t", "[ \\t-\\r]+").alias("w"), F.xxhash64("t", "path").alias("key"), F.explode(F.sequence(F.lit(1), F.lit(each))).alias("k"))
    rows = rows.withColumn("h", F.xxhash64("key", "k"))
    at = F.pmod(F.xxhash64("h", F.lit(5)), F.size("w")).cast("int") + 1
    # words that name a credential belong to values of their own
    other = lambda w: F.filter(w, lambda x: ~x.rlike(CREDENTIAL))
    rows = rows.select("path", "h", other(F.slice("w", at, 6)).alias("ahead"), other(F.slice("w", F.greatest(at - 3, F.lit(1)), 12)).alias("w"))
    kinds = _kinds(F.col("h"), F.col("w"))
    chosen = F.get(F.array(*(F.struct(F.lit(float(label)).alias("label"), a.alias("a"), v.alias("v"), z.alias("z")) for label, a, v, z in kinds)), F.pmod(F.xxhash64("h", F.lit(6)), F.lit(len(kinds))).cast("int"))
    rows = rows.withColumn("x", chosen).select(F.struct("h", F.col("x.label").alias("label"), F.col("x.v").alias("value")).alias("id"), "path", F.concat_ws(" ", F.array_join(F.slice("w", 1, 4), " "), F.concat("x.a", "x.v", "x.z"), F.array_join("ahead", " ")).alias("t"))
    rows = tables.put(rows, "planted")
    found = candidates(rows, "id", "t", "path")
    same = (F.col("token") == F.col("doc_id.value")) | (F.contains("token", "doc_id.value") & (F.length("doc_id.value") >= 8))
    return found.where(same).withColumn("label", F.col("doc_id.label")).withColumn("doc_id", F.col("doc_id.h"))


def train(labelled: DataFrame, seed: int = 7):
    """A forest from rows with FEATURES and label (0.0 or 1.0); None if one label is missing. Equal rows become one with their number as weight; of
    these a hash sample of about TRAIN_ROWS of each label is written, ordered, and then read by few tasks, as each of the forest's many small
    stages would run on all partitions."""
    tables = Tables(labelled.sparkSession, "forest")
    vectors = tables.put(labelled.groupBy(*FEATURES, "label").agg(F.count("*").cast("double").alias("weight")), "vectors")
    counts = {r["label"]: r["count"] for r in vectors.groupBy("label").count().collect()}  # two rows
    if not counts.get(0.0) or not counts.get(1.0):
        return None
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *FEATURES), 11) / F.lit(float(1 << 53))
    bound = F.when(F.col("label") == 1, F.lit(TRAIN_ROWS / counts[1.0])).otherwise(F.lit(TRAIN_ROWS / counts[0.0]))
    dealt = vectors.where(u < bound).repartition(TRAIN_TASKS, *FEATURES).sortWithinPartitions(*FEATURES, "label")
    sample = tables.put(dealt, "sample")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("features", "label", "weight")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt", weightCol="weight").fit(rows)
    tables.drop("vectors", "sample")
    return model


def _scored(model, rows: DataFrame) -> DataFrame:
    return model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)).withColumn("probability", vector_to_array("probability")[1])


def held_out(docs: DataFrame, text: str = "text", path: str | None = "source", total: int = PLANTED) -> DataFrame:
    """(n, secrets, precision, recall) of a forest trained on four fifths of the planted findings, on the other fifth."""
    tables = Tables(docs.sparkSession, "held-out")
    words = tables.put(dictionary(docs, text), "dictionary")
    found = tables.put(planted(docs, tables, text, path, total), "found")
    rows = tables.put(features(found, words, transitions(words), tables), "features")
    fifth = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5))
    out = _scored(train(rows.where(fifth > 0)), rows.where(fifth == 0)).withColumn("said", F.col("probability") >= 0.5)
    both = F.count_if(F.col("said") & (F.col("label") == 1))
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("secrets"), (both / F.count_if("said")).alias("precision"), (both / F.count_if(F.col("label") == 1)).alias("recall"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """doc_id, path, word (place in the text), token, before, FEATURES, probability, secret: a row for each candidate.

    labelled: findings with FEATURES and label; by default planted ones. If the caller's lack a label, every candidate has that of the
    others, and without any counts as a secret. Null and empty texts have no candidates, very long ones are scanned whole; an
    empty table gives none. Of an assigned value of more than MOST_SIGNS signs these are taken. A candidate that repeats in its word counts once for each thing that it is assigned to, else once, in the context of
    its first place. Ids may repeat or be null: rows that repeat are scanned alike. Other columns of docs are not read, whatever their names."""
    tables = Tables(docs.sparkSession, "secrets")
    found = tables.put(candidates(docs, doc_id, text, path), "candidates")
    words = tables.put(dictionary(docs, text), "dictionary")
    chances = transitions(words)
    made = Tables(docs.sparkSession, "secrets-made")
    found = tables.put(features(found, words, chances, made), "features")
    if labelled is None:
        labelled = made.put(features(made.put(planted(docs, made, text, path), "found"), words, chances, made), "labelled")
    model = train(labelled)
    if model is None:
        scored = found.withColumn("probability", F.lit(labelled.agg(F.coalesce(F.max("label"), F.lit(1.0))).first()[0]))
    else:
        scored = _scored(model, found)
    made.keep()
    tables.keep("features")
    return scored.withColumn("secret", F.col("probability") >= 0.5).select("doc_id", "path", "word", "token", "before", *FEATURES, "probability", "secret")
