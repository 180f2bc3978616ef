"""The pipeline's stages, each against a plain version on its own input, and the guard of the entry module."""

import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from cohortlake.llm import quality
from cohortlake.llm.shared import Tables, read

from . import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first and after each stage."""
    tables = Tables(spark, "test")
    out = [read(spark, SF, "documents")]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out.append(tables.put(f(spark, out[-1], SF), f"s{k}"))
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, stages):
    assert [d.columns for d in stages[:-1]] == [COLUMNS] * 5
    assert stages[-1].columns == [*COLUMNS, "shard", "slot"]
    docs, good, unique, clean = map(by_id, stages[:4])
    for i, r in docs.items():
        n, _, _, _, repeated = brute.statistics(r.text)
        if n < 50 or 100 * repeated > 50 * n:
            assert i not in good
    assert set(good) == {r.doc_id for r in quality.judge(stages[0]).where("kept").collect()}
    ids = sorted(good)
    label, _ = brute.components([good[i].text for i in ids], 5, 80, 100)
    assert set(unique) == {ids[k] for k in set(label)}
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    assert set(clean) == {i for i in unique if not brute.contamination(unique[i].text, items, corpus_pipeline.WINDOW)[1]}
    mixed = [r.doc_id for r in stages[4].collect()]
    assert set(mixed) <= set(clean)
    assert max(mixed.count(i) for i in set(mixed)) <= 3
    words = lambda ids: sum(len(brute.WHITE.findall(clean[i].text)) for i in ids)
    assert words(mixed) == pytest.approx(words(clean), rel=0.05)
    shards = stages[5].collect()
    assert sorted(r.doc_id for r in shards) == sorted(mixed)
    for s in range(corpus_pipeline.SHARDS):
        mine = sorted(r.slot for r in shards if r.shard == s)
        assert mine == list(range(len(mine)))


def test_run(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[-1].collect()))


def test_entry_without_this_part():
    """The entry module works where the pipeline and this subpackage are gone."""
    code = "import sys; sys.modules['cohortlake.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2])
