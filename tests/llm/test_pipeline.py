"""The pipeline on the smallest tables, each stage against its own rules."""

from collections import Counter

import duckdb
import pytest

from tests.llm.fixtures import ROWS, documents
from tests.llm.test_dedup import brute_components, brute_fingerprint, near


@pytest.fixture(scope="module")
def stages(spark, sf):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in cp.STAGES:
        docs = cp.shared_table(stage(spark, docs, sf), f"test-{name}")
        out.append((name, docs))
    return dict(out)


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_stages_keep_the_columns(stages):
    cols = stages["documents"].columns
    assert all(df.columns == cols for name, df in stages.items() if name != "training_order")


def test_quality_stage(stages, sf):
    lab = dict(duckdb.connect().execute(f"select doc_id, max(quality) from read_parquet('{sf}/labels.parquet') group by 1").fetchall())
    before, after = set(ids(stages["documents"])), set(ids(stages["quality"]))
    assert after < before
    good = [d for d, q in lab.items() if q == 1]
    bad = [d for d, q in lab.items() if q == 0]
    assert sum(d in after for d in good) >= 0.97 * len(good) and sum(d in after for d in bad) <= 0.4 * len(bad)


def test_near_duplicate_stage(stages):
    rows = stages["quality"].select("doc_id", "text").collect()
    fp = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    root = brute_components(set(fp.values()), near)
    least = {}
    for d, f in fp.items():
        least[root[f]] = min(d, least.get(root[f], d))
    assert sorted(ids(stages["near_duplicates"])) == sorted(least.values())


def test_decontamination_stage(stages, sf):
    bench = [" ".join(t.split()) for t, in duckdb.connect().execute(f"select text from read_parquet('{sf}/benchmark.parquet')").fetchall()]
    before = {r.doc_id: " ".join(r.text.split()) for r in stages["near_duplicates"].select("doc_id", "text").collect()}
    after = set(ids(stages["decontamination"]))
    holds = {d for d, t in before.items() if any(f" {b} " in f" {t} " for b in bench)}
    assert not holds & after and len(after) >= len(before) - len(holds) - 2


def test_mixing_stage(stages):
    before, n = set(ids(stages["decontamination"])), Counter(ids(stages["mixing"]))
    assert set(n) <= before and max(n.values()) <= 5


def test_training_order_stage(spark, stages):
    from ticketscope.llm.training_order import read_slots
    got = {r.doc_id for r in read_slots(stages["training_order"]).select("doc_id").distinct().collect()}
    assert got == set(ids(stages["mixing"]))


def test_run(spark, sf):
    import corpus_pipeline as cp
    assert cp.run(spark, sf).count() >= 1


def test_stages_on_awkward_and_empty_tables(spark, sf):
    import corpus_pipeline as cp
    for rows in (ROWS, []):
        docs = documents(spark, rows)
        for name, stage in cp.STAGES:
            got = cp.shared_table(stage(spark, docs, sf), "test-awkward")
            if name != "training_order":
                assert got.columns == docs.columns
                assert got.count() <= max(1, 6 * docs.count()) * bool(rows)
                if rows:
                    docs = got
