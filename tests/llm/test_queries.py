"""The registered queries on built tables, each row against a plain version of its contract; and the SQL of those that have one."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from cohortlake.llm import queries
from cohortlake.llm.shared import read

from . import brute
from .test_operators import TEXTS


def _documents():
    r = random.Random(8)
    rows = [(3 * i, t, ["en", "de", None][i % 3], None if i % 7 == 0 else f"s{i % 4}") for i, t in enumerate(TEXTS)]
    shared = " ".join(f"p{k}" for k in range(60))
    for i in range(60):
        words = " ".join(r.choice("abcdefgh") * r.randint(1, 6) + str(r.randrange(40)) for _ in range(r.randint(60, 120)))
        rows.append((1000 + i, f"{words} {shared}" if i % 9 == 0 else words, "en", f"s{i % 4}"))
    rows.append((5000, f'say token = "{hashlib.sha256(b"x").hexdigest()[:40]}" now', "en", "s1"))
    return rows


ROWS = _documents()
ITEMS = [(0, " ".join(TEXTS[7].split()[10:40])), (1, "p3 p4, p5! P6 p7 p8 p9 p10 p11 p12 p13"), (2, "one two"), (3, None), (4, "not there at all in any of the documents that are")]
URLS = [None, "", "x", "http://a.ORG/", "https://example.org/es/1", "https://x.example.org/en/1?q", "http://www.net.com/fr/a", "http://com/de/", "http://casino-x.net/", "http://my-pills.io/a", "http://pills.io/", "ftp://x.com/de?/fr/", "http://org", "a://b.org/c://d.com/de/"]


def _write(at, rows, extra=None):
    cols = dict(zip(("doc_id", "text", "lang", "source"), map(list, zip(*rows, strict=True)), strict=True)) if rows else dict.fromkeys(("doc_id", "text", "lang", "source"), [])
    types = {"doc_id": pa.int64()}
    table = {c: pa.array(v, types.get(c, pa.string())) for c, v in cols.items()} | {"n_chars": pa.array([len(t or "") for t in cols["text"]], pa.int64())}
    pq.write_table(pa.table(table | (extra or {})), at / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in ITEMS], pa.int64()), "text": pa.array([t for _, t in ITEMS], pa.string())}), at / "benchmark.parquet")
    pq.write_table(pa.table({"page_id": pa.array(range(len(URLS)), pa.int64()), "url": pa.array(URLS, pa.string()), "html": pa.array(["x"] * len(URLS))}), at / "pages.parquet")
    return str(at)


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    return _write(tmp_path_factory.mktemp("tables"), ROWS)


def _by_id(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *columns).collect()}


def test_op1(spark, sf):
    got = queries.op1_feistel_shards(spark, sf).toPandas().sort_values("doc_id")
    assert got["doc_id"].tolist() == sorted(r[0] for r in ROWS)
    text = {r[0]: (r[1] or "").encode() for r in ROWS}
    assert all(s == len(text[i]) + 1 and c == zlib.crc32(text[i]) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True))
    assert set(got.law) == {"rows"} and got.grown_shard.isna().all()
    counts = got.groupby("shard").size()
    assert set(counts.index) == set(range(8)) and counts.max() - counts.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_op2(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    want, at = {}, 0
    for i, x, *_ in sorted(ROWS, key=lambda r: r[0]):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert _by_id(queries.op2_bit_plane_ids(spark, sf), "start", "n_tokens", "ids_crc32") == want


def test_op3(spark, sf):
    label, sizes = brute.components([r[1] for r in ROWS], 3, 85, 100)
    want = {r[0]: (sizes[k], min(ROWS[j][0] for j in range(len(ROWS)) if label[j] == label[k])) for k, r in enumerate(ROWS)}
    assert _by_id(queries.op3_bottom_k_neardup(spark, sf), "n_shingles", "component_id", "kept") == {i: (*x, i == x[1]) for i, x in want.items()}


def test_op4(spark, sf):
    ordered = sorted(ROWS, key=lambda r: r[0])
    want = {r[0]: (n, n - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for r, (k, n) in zip(ordered, brute.kept_words(ordered, 20), strict=True)}
    assert _by_id(queries.op4_count_min_substrings(spark, sf), "n_words", "n_removed", "kept_sha256") == want


def test_op5(spark, sf):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from cohortlake.llm import token_counts

    vocabulary = token_counts.vocabulary_of(queries.tokenizer_file("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram(vocabulary, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    scores, least = dict(vocabulary), min(s for _, s in vocabulary)
    got = _by_id(queries.op5_count_viterbi(spark, sf), "n_tokens", "score")
    for i, x, *_ in ROWS:
        e = t.encode(x or "", add_special_tokens=False)
        assert got[i][0] == len(e.ids)
        if "<0x" not in "".join(e.tokens):
            assert got[i][1] == pytest.approx(sum(scores[p] for p in e.tokens))
        else:
            assert got[i][1] < least


def test_op6(spark, sf):
    got = _by_id(queries.op6_mcd_quality(spark, sf), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, x, *_ in ROWS:
        s = brute.statistics(x)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        assert got[i][:6] == (*s, failed) and not (failed and got[i][6])
    assert all(got[1000 + k][6] for k in range(60) if not got[1000 + k][5])


def test_op7(spark, sf):
    got = queries.op7_forest_secrets(spark, sf).toPandas()
    assert list(got.columns) == ["doc_id", "word", "token_sha256", "length", "probability", "secret"]
    mine = got[got.doc_id == 5000]
    token = hashlib.sha256(b"x").hexdigest()[:40]
    assert mine.values.tolist() == [[5000, 3, hashlib.sha256(token.encode()).hexdigest(), 40, mine.probability.iloc[0], True]]
    assert ((got.probability >= 0.5) == got.secret).all() and got[got.doc_id != 5000].secret.sum() == 0


def test_sql(spark, sf):
    """Queries with SQL: ops 8, 11 and 13."""
    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in queries.ORACLE_SQL:
        rows = con.sql(queries.ORACLE_SQL[name])
        df = queries.QUERIES[name](spark, sf)
        assert sorted(rows.columns) == sorted(df.columns)
        assert sorted(map(str, map(tuple, df.select(*rows.columns).collect()))) == sorted(map(str, rows.fetchall()))


def test_op9(spark, sf):
    got = queries.op9_entropy_mix(spark, sf).toPandas().set_index("doc_id")
    size, target = brute.mixing_targets([(r[3], len(brute.WHITE.findall(r[1] or ""))) for r in ROWS], [5, 2, 1], 3)
    taken = dict.fromkeys(size, 0)
    for i, x, _, s in ROWS:
        g = got.loc[i]
        n = len(brute.WHITE.findall(x or ""))
        assert (g["size"], g.source_size) == (n, size[s]) and g.target == pytest.approx(target[s])
        assert g.taken <= 3 * n and g.taken == n * g.copies
        taken[s] += g.taken
    largest = {s: max(len(brute.WHITE.findall(r[1] or "")) for r in ROWS if r[3] == s) for s in size}
    assert all(abs(taken[s] - target[s]) <= max(0.05 * target[s], largest[s] / 2) for s in size)
    again = queries.op9_entropy_mix(spark, sf).toPandas().set_index("doc_id")
    assert (again.loc[got.index].taken == got.taken).all()


def test_op10(spark, sf):
    want = {}
    for i, x, *_ in ROWS:
        n, hit, found = brute.contamination(x, ITEMS, 10)
        want[i] = (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0)
    assert _by_id(queries.op10_suffix_arrays(spark, sf), "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert sum(x[4] for x in want.values()) > 5


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, and columns whose names stages use: each stage against a plain version."""
    rows = [*ROWS, *ROWS[-20:], (1001, ROWS[-9][1], "en", "s0"), (None, "no id " + " ".join(f"q{k}" for k in range(70)), None, None), (7000, " ".join(f"z{k % 5000}y{k // 3}" for k in range(60_000)), "en", "s2")]
    names = ["kept", "size", "row", "rate", "n_words", "matches", "component_id", "token"]
    extra = {c: pa.array([f"{c}{k}" for k in range(len(rows))]) for c in names}
    at = _write(tmp_path, rows, extra)
    docs = read(spark, at, "documents")
    columns = docs.columns
    full = [tuple(r) for r in docs.collect()]
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, at).write.parquet(path)
        docs = spark.read.parquet(path)
        after[name] = [tuple(r) for r in docs.collect()]
        assert docs.columns == (columns if name != "sharding" else [*columns, "shard", "slot"])
    good = after["quality rules"]
    assert set(good) <= set(full)
    failed = lambda s: s[0] < 50 or 100 * s[4] > 50 * s[0]
    assert not any(failed(brute.statistics(r[1])) for r in good)
    assert len(good) > 0.8 * sum(not failed(brute.statistics(r[1])) for r in full)
    ordered = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    label, _ = brute.components([r[1] for r in ordered], 5, 80, 100)
    unique = after["near duplicates"]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(key, unique)) == sorted(key(ordered[k]) for k in set(label)) and set(unique) <= set(good)
    clean = after["benchmark decontamination"]
    assert sorted(clean, key=str) == sorted((r for r in unique if not brute.contamination(r[1], ITEMS, corpus_pipeline.WINDOW)[1]), key=str)
    mixed = after["mixing sources"]
    assert set(mixed) <= set(clean) and max(mixed.count(r) for r in set(mixed)) <= 3
    shards = after["sharding"]
    assert sorted((r[:-2] for r in shards), key=str) == sorted(mixed, key=str)
    assert sorted(map(str, (tuple(r) for r in corpus_pipeline.run(spark, at).collect()))) == sorted(map(str, shards))


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, _write(tmp_path, [])).count() == 0


def test_pipeline_with_small_sources(spark, tmp_path):
    """Sources of one short document each, whose targets no whole copies meet: the pipeline ends and keeps their documents within what the mix allows."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(50 + i % 3)), "en", f"only{i}") for i in range(9)] + [(100 + i, " ".join(f"v{i}y{k}" for k in range(60)), "en", "big") for i in range(30)]
    got = corpus_pipeline.run(spark, _write(tmp_path, rows)).collect()
    assert got and {r.doc_id for r in got} <= {r[0] for r in rows}
    counts = {i: sum(r.doc_id == i for r in got) for i in {r.doc_id for r in got}}
    assert max(counts.values()) <= 3 and sorted((r.shard, r.slot) for r in got) == sorted((p % 8, p // 8) for p in range(len(got)))


def test_shared_folder(spark, monkeypatch):
    """Without spark.checkpoint.dir a cluster gets an error, not a folder of one machine."""
    from cohortlake import session

    class Far:
        conf = spark.conf
        sparkContext = type("Context", (), {"master": "spark://far:7077", "applicationId": "x"})

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError):
            session.shared_dir(Far)
        assert session.shared_dir(spark).startswith("file:")
