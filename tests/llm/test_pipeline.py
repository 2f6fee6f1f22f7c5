"""The pipeline against a plain version of its stages, and the contracts of the query functions."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tests.llm.test_decontaminate import brute
from tests.llm.test_near_copies import slow_groups
from tests.llm.test_simhash import slow_components, slow_fingerprint
from tidemark.llm import mixing, quality_rules, queries
from tidemark.llm.common import Scratch

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark):
    """The result of each stage on the smallest tables."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialise(stage(spark, docs, d), f"test{k}")
        out.append(docs)
    return d, out


def test_stages_are_the_dealt_ones():
    assert [name.split()[0] for name, _ in corpus_pipeline.STAGES] == ["quality", "SimHash", "benchmark", "mixing", "token-ID"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_all_but_the_last_return_documents(stages):
    _, out = stages
    for before, after in zip(out[:4], out[1:5]):
        assert after.columns == before.columns
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    assert out[5].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality_stage(spark, stages):
    d, out = stages
    model = quality_rules.train(out[0], spark.read.parquet(f"{d}/labels.parquet"))
    want = {r.doc_id for r in quality_rules.score(out[0], model).collect() if r.score >= 0.3}
    assert {r.doc_id for r in out[1].collect()} == want
    good = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1").collect()}
    assert len(good & want) / len(good) > 0.95


def test_dedup_stage(stages):
    _, out = stages
    rows = sorted(out[1].select("doc_id", "text").collect())
    group = slow_groups([r.text for r in rows])
    assert sorted(r.doc_id for r in out[2].collect()) == sorted({g: r.doc_id for r, g in reversed(list(zip(rows, group)))}.values())


def test_dedup_stage_links_fingerprints(stages):
    """Against all pairs of plain fingerprints of the stage's rows: of each group the row with the least id."""
    _, out = stages
    rows = sorted(out[1].select("doc_id", "text").collect())
    group = slow_components([slow_fingerprint(r.text) for r in rows], 2)
    assert sorted(r.doc_id for r in out[2].collect()) == sorted({g: r.doc_id for r, g in reversed(list(zip(rows, group)))}.values())


def test_dedup_stage_never_broadcasts_probes(spark, stages, monkeypatch):
    """Probes are some 34 rows of each fingerprint, which Spark takes to be as small as one: the stage joins them by sort and merge."""
    _, out = stages
    plans, write = {}, Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and write(self, df, name))
    corpus_pipeline.near_dedup(spark, out[1], None)
    assert "SortMergeJoin" in plans["met"] and "Broadcast" not in plans["met"]


def test_decontamination_stage(spark, stages):
    d, out = stages
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in brute([(r.doc_id, r.text) for r in out[2].collect()], items) if not r["contaminated"]}
    assert {r.doc_id for r in out[3].collect()} == clean


def test_mixing_stage(spark, stages):
    d, out = stages
    rates = mixing.mix(out[3], mixing.domain_of(spark.read.parquet(f"{d}/labels.parquet")))
    want = {r.doc_id: r.n for r in rates.select("doc_id", mixing.copies_of(rates.rate, rates.doc_id).alias("n")).collect()}
    got = {r.doc_id: r["count"] for r in out[4].groupBy("doc_id").count().collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_token_stage(stages):
    from tokenizers import Tokenizer

    _, out = stages
    whole = Tokenizer.from_file(queries.tokenizer_file())
    rows = out[4].select("doc_id", "text").collect()
    ids = [np.array(whole.encode(r.text, add_special_tokens=False).ids + [queries.END_ID], "<u4").tobytes() for r in rows]
    want = sorted((r.doc_id, len(x) // 4, zlib.crc32(x)) for r, x in zip(rows, ids))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in out[5].collect()) == want


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [n for n in names if n.startswith("op")] and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
    assert "pipeline" in names


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns with clashing names pass all stages."""
    d = "/root/testdata/sf0.001"
    docs = cases.documents(spark, 12).withColumns({"mix_key": F.lit(1), "quality_score": F.lit("q"), "row_key": F.lit(2), "stat_n_chars": F.lit(0)})
    rows = docs.unionByName(docs.limit(7))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()}
        rows = corpus_pipeline.materialise(stage(spark, rows, d), f"odd{k}")
        assert rows.columns == docs.columns
        assert {(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()} <= before
    out = corpus_pipeline.STAGES[-1][1](spark, rows, d).collect()
    assert len(out) == rows.count() and all(r.n_tokens >= 1 for r in out)


def test_stages_take_empty_tables(spark):
    d, rows = "/root/testdata/sf0.001", cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, d)
        assert rows.columns == cases.empty(spark).columns and rows.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, rows, d).count() == 0
