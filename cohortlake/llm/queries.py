"""The registered queries of this subpackage: opN_<name>(spark, sf_dir) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .decontaminate import find
from .mixing import mix
from .neardup import near_duplicates
from .quality import STATISTICS
from .quality import judge as judge_quality
from .ranking import score
from .resampling import importance
from .secrets import scan
from .sharding import shard
from .shared import read
from .spelling import variants
from .substrings import remove_repeats
from .token_counts import count_tokens
from .token_files import read_documents, write_ids
from .url_filter import Rule, judge, site_rule

SHARDS = 8


def op1_feistel_shards(spark, sf_dir):
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: all documents in shards 0 to 7, counts at most one apart."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = shard(docs, SHARDS, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bit_plane_ids(spark, sf_dir):
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files written."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = write_ids(docs, tokenizer_file("word_bpe_49k.json"))
    return read_documents(manifest, docs.schema["doc_id"].dataType, int(spark.conf.get("spark.sql.shuffle.partitions")))


def op3_bottom_k_neardup(spark, sf_dir):
    """doc_id, n_shingles, component_id, kept of every document: 3-word shingles, Jaccard similarity of 0.85 or more."""
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=3, num=85)


def op4_count_min_substrings(spark, sf_dir):
    """doc_id, n_words, n_removed, kept_sha256 of every document: windows of 20 words."""
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op5_count_viterbi(spark, sf_dir):
    """doc_id, n_tokens, score of every document under a unigram vocabulary of 32,000 pieces."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer_file("piece_bpe_32k.model")).select("doc_id", "n_tokens", "score")


def op6_mcd_quality(spark, sf_dir):
    """doc_id, the statistics, base_failed and kept of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge_quality(docs, keep_text=False).select("doc_id", *STATISTICS, "base_failed", "kept")


def op7_forest_secrets(spark, sf_dir):
    """doc_id, word, token_sha256, length, probability (to 6 places), secret: every candidate of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return scan(docs).select("doc_id", "word", F.sha2("token", 256).alias("token_sha256"), F.length("token").alias("length"), F.round("probability", 6).alias("probability"), "secret")


#: The rules that the query states; the longest that fits wins.
SITE_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: The method's own rules, for urls that none of the above fits: hosts with such a label are blocked.
BLOCKED_HOSTS = ["adult", "ads", "bets", "casino", "pills", "porn", "spam", "track"]


def url_rules() -> list[Rule]:
    words = [g for w in BLOCKED_HOSTS for g in (f"{w}-~", f"~.{w}-~", f"~-{w}.~", f"~-{w}-~")]
    return [r for text, verdict in SITE_RULES for r in site_rule(text, verdict)] + [Rule(g + end, "block") for g in words for end in ("", "/*")]


def op8_url_automaton(spark, sf_dir):
    """page_id, host, path, rule, verdict of every page."""
    return judge(read(spark, sf_dir, "pages"), url_rules()).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
WITH a AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(rule, h, p, v) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM a JOIN r ON (a.host = r.h OR ends_with(a.host, '.' || r.h)) AND starts_with(a.path, r.p) GROUP BY page_id)
SELECT a.page_id, host, path, m.rule, coalesce(m.v, CASE WHEN regexp_matches(host, '(^|[.])(adult|ads|bets|casino|pills|porn|spam|track)-') OR regexp_matches(host, '-(adult|ads|bets|casino|pills|porn|spam|track)[.-]') THEN 'block' ELSE 'allow' END) AS verdict
FROM a LEFT JOIN m ON a.page_id = m.page_id
"""


def op9_entropy_mix(spark, sf_dir):
    """doc_id, size, source_size, target, taken of every document; sources weigh 5, 2, 1 in turn and no document is taken over 3 times."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mix(docs, [5.0, 2.0, 1.0], key=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def op10_suffix_arrays(spark, sf_dir):
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document, against the whole benchmark."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, read(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_interned_resampling(spark, sf_dir):
    """doc_id, n_features, weight, score, rank of every document: 5 % are drawn towards the benchmark's n-grams."""
    return importance(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_pairwise_quality(spark, sf_dir):
    """doc_id, held_out, score, predicted of every document, learned from the quality labels that are not held out."""
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_fm_variants(spark, sf_dir):
    """word, form, root, n, n_near, form_n of every frequent word of the documents."""
    return variants(read(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The table of crc32 by its rule; and the crc32 of the UTF-8 bytes of a string whose hexadecimal form is x.
_CRC_TABLE = "bits(v, k, r) AS (SELECT i, 0, i FROM generate_series(CAST(0 AS BIGINT), 255) AS s(i) UNION ALL SELECT v, k + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM bits WHERE k < 8), crc AS (SELECT list(r ORDER BY v) AS t FROM bits WHERE k = 8)"
_DIGIT = "CAST(strpos('0123456789ABCDEF', substr(x, {}, 1)) - 1 AS BIGINT)"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [16 * {_DIGIT.format('2 * j + 1')} + {_DIGIT.format('2 * j + 2')} FOR j IN range(0, length(x) // 2)]), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295)"

OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS w FROM documents),
each AS (SELECT w, count(*) AS k, hex(CAST(doc_id AS VARCHAR) || ':' || w) AS x FROM runs WHERE length(w) >= 6 GROUP BY doc_id, w),
hashed AS (SELECT w, k, {_CRC} AS h FROM each, crc),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed),
vocabulary AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM vocabulary, unnest(range(1, length(word) + 1)) AS u(i)),
near AS (SELECT p.word, q.word AS other FROM cut p JOIN cut q USING (i, a, b) WHERE p.word <> q.word UNION SELECT c.word, v.word FROM cut c JOIN vocabulary v ON v.word = c.a || c.b UNION SELECT v.word, c.word FROM cut c JOIN vocabulary v ON v.word = c.a || c.b),
best AS (SELECT near.word, count(*) AS n_near, first(other ORDER BY v.n DESC, other) AS other, max(v.n) AS other_n FROM near JOIN vocabulary v ON v.word = other GROUP BY near.word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form, CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n FROM vocabulary v LEFT JOIN best USING (word)),
chain(word, last, k) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT chain.word, forms.form, k + 1 FROM chain JOIN forms ON forms.word = last WHERE forms.form IS NOT NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(last, k) AS root FROM chain GROUP BY word) USING (word)
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(_UPPER, _LOWER)
_GRAMS = " UNION ALL ".join(f"SELECT id, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM {{0}}, unnest(range(1, len(w) + {2 - k})) AS u(i)" for k in (1, 2, 3))

OP11_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
dw AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents), bw AS (SELECT 0 AS id, {_WORDS} AS w FROM benchmark),
dg AS (SELECT id, g, count(*) AS n FROM ({_GRAMS.format('dw')}) GROUP BY ALL), bg AS (SELECT g, count(*) AS n FROM ({_GRAMS.format('bw')}) GROUP BY ALL),
hashed AS (SELECT g, {_CRC} % 10000 AS b FROM (SELECT g, hex(g) AS x FROM dg UNION SELECT g, hex(g) FROM bg), crc),
counts AS (SELECT b, CAST(sum(s) AS BIGINT) AS s, CAST(sum(t) AS BIGINT) AS t FROM (SELECT b, n AS s, 0 AS t FROM dg JOIN hashed USING (g) UNION ALL SELECT b, 0, n FROM bg JOIN hashed USING (g)) GROUP BY b),
gains AS (SELECT b, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM counts) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT sum(t) FROM counts) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM counts),
weights AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM dg JOIN hashed USING (g) JOIN gains USING (b) GROUP BY id),
noise AS (SELECT id, len(w) AS n_words, list_reduce([CAST(0 AS BIGINT)] || [CAST(strpos('0123456789abcdef', substr(sha256('42:' || id), j, 1)) - 1 AS BIGINT) FOR j IN range(1, 9)], lambda a, b: 16 * a + b) AS h FROM dw),
scores AS (SELECT id AS doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM noise LEFT JOIN weights USING (id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM drawn) * 5 // 100 THEN rank END AS rank FROM scores LEFT JOIN drawn USING (doc_id)
"""

QUERIES = {f.__name__: f for f in (op1_feistel_shards, op2_bit_plane_ids, op3_bottom_k_neardup, op4_count_min_substrings, op5_count_viterbi, op6_mcd_quality, op7_forest_secrets, op8_url_automaton, op9_entropy_mix, op10_suffix_arrays, op11_interned_resampling, op12_pairwise_quality, op13_fm_variants)}
ORACLE_SQL: dict[str, str] = {"op8_url_automaton": OP8_SQL, "op11_interned_resampling": OP11_SQL, "op13_fm_variants": OP13_SQL}
