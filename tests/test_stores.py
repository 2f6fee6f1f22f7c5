"""Runs and responses as partitioned tables."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.sources import ledger, runs

HEADS = "label string, saved_at timestamp, model string, settings map<string,string>, event_dates array<date>, control_dates array<date>, measures map<string,map<string,double>>, warnings array<string>"
TOLD = "run_id string, window_id string, kind string, driver_identified boolean, confidence string, summary string, mechanism string, claims array<struct<claim:string,item_ids:array<string>>>"


def head(label, day, **measures):
    return (label, dt.datetime(2026, 8, day, 12), "m", {"window_days": "14", "controls_per_event": "2"}, [dt.date(2020, 3, 3)], [dt.date(2020, 5, 12)], measures, ["a warning worth keeping"])


def told(run, *windows):
    return [(run, w, "transition", True, "high", f"of {w}", "m", [("c", ["1"])]) for w in windows]


def saved(spark, path, *rows, parts=()):
    store = runs.RunStore(spark, str(path))
    store.save(spark.createDataFrame(list(rows), HEADS), narratives=spark.createDataFrame(list(parts), TOLD))
    return store


def test_a_run_comes_back_whole(spark, tmp_path):
    rid = "20260822-120000_my-run"
    store = saved(spark, tmp_path / "s", head("my run", 22, retrieval={"total_items": 12.0}, fisher={"p": 1.0}), parts=told(rid, "a", "b"))
    again = runs.RunStore(spark, str(tmp_path / "s")).load(rid)
    (r,) = again["runs"].collect()
    assert (r.run_id, r.label, r.model, r.event_dates, r.control_dates) == (rid, "my run", "m", [dt.date(2020, 3, 3)], [dt.date(2020, 5, 12)])
    assert r.settings["window_days"] == "14" and r.measures["retrieval"]["total_items"] == 12 and r.warnings == ["a warning worth keeping"]
    assert {(x.window_id, x.summary, x.claims[0].item_ids[0]) for x in again["narratives"].collect()} == {("a", "of a", "1"), ("b", "of b", "1")}
    assert again["records"].collect() == [] and again["windows"].collect() == []
    (s,) = store.list().collect()
    assert (s.n_events, s.n_controls, s.n_narratives, s.window_days, s.model) == (1, 1, 2, 14, "m")


def test_newest_first_and_deleting(spark, tmp_path):
    store = saved(spark, tmp_path / "s", head("oldest", 20), head("newest", 22), head("middle", 21), parts=told("20260821-120000_middle", "w"))
    assert [r.label for r in store.list().collect()] == ["newest", "middle", "oldest"]
    assert store.delete("20260821-120000_middle") and not store.delete("20260821-120000_middle") and not store.delete("nope") and not store.delete("../x")
    assert [r.label for r in store.list().collect()] == ["newest", "oldest"]
    assert store.load("20260821-120000_middle") is None and store.load("nope") is None
    assert store.table("narratives").collect() == []


def test_saving_again_replaces_a_run_and_no_other(spark, tmp_path):
    store = saved(spark, tmp_path / "s", head("a", 20), head("b", 21), parts=[*told("20260820-120000_a", "x", "y"), *told("20260821-120000_b", "z")])
    store.save(spark.createDataFrame([head("a", 20)], HEADS), narratives=spark.createDataFrame([], TOLD))
    assert {r.label: r.n_narratives for r in store.list().collect()} == {"a": 0, "b": 1}
    with pytest.raises(ValueError):
        store.save(spark.createDataFrame([head("a", 20)], HEADS), per_item=spark.range(1))
    with pytest.raises(ValueError):
        store.save(spark.createDataFrame([head("a", 20)], HEADS).withColumn("run_id", F.lit("../../etc")))


def test_a_damaged_run_hurts_no_other(spark, tmp_path):
    store = saved(spark, tmp_path / "s", head("good", 20), head("bad", 21), parts=[*told("20260820-120000_good", "x"), *told("20260821-120000_bad", "z")])
    for name in ("runs", "narratives"):
        for f in (tmp_path / "s" / name / "run_id=20260821-120000_bad").iterdir():
            f.write_bytes(b"not a table")
    other = tmp_path / "s" / "runs" / "run_id=20260101-000000_half"
    other.mkdir()
    (other / "part-0.parquet").write_bytes(b"")
    assert [(r.label, r.n_narratives) for r in store.list().collect()] == [("good", 1)]
    assert store.load("20260820-120000_good")["narratives"].count() == 1
    assert store.delete("20260821-120000_bad")


def test_labels_of_all_kinds_and_runs_of_one_second(spark, tmp_path):
    store = saved(spark, tmp_path / "s", head("../../etc/passwd  &  <script>", 20), head("alpha", 20), head("beta", 20), head("", 20))
    ids = {r.run_id: r.label for r in store.list().collect()}
    assert len(ids) == 4 and all("/" not in i and "<" not in i for i in ids)
    assert all(store.load(i)["runs"].first().label == label for i, label in ids.items())


def test_tables_of_the_catalogue(spark, tmp_path):
    store = saved(spark, tmp_path / "s", head("one", 20), head("two", 21), parts=told("20260820-120000_one", "x"))
    store.register("stored")
    try:
        assert spark.sql("SELECT count(*) FROM stored.runs").first()[0] == 2
        assert [r[0] for r in spark.sql("SELECT window_id FROM stored.narratives WHERE run_id = '20260820-120000_one'").collect()] == ["x"]
        store.delete("20260820-120000_one")
        store.register("stored")
        assert spark.sql("SELECT label FROM stored.runs").collect()[0][0] == "two" and spark.sql("SHOW PARTITIONS stored.runs").count() == 1
    finally:
        spark.sql("DROP DATABASE stored CASCADE")
    assert [r.label for r in store.list().collect()] == ["two"]  # the files are the store's own


ENTRY = "window_id string, input_hash string, label string, answered_at timestamp, response_text string, extra int"


def entry(w, h, second, text, label="primary"):
    return (w, h, label, dt.datetime(2026, 1, 1, 0, 0, second) if second is not None else None, text, 1)


def rows_of(book):
    return sorted((r.window_id, r.input_hash, r.label, r.answered_at.second if r.answered_at else None, r.response_text) for r in book.read().collect())


def test_keys_are_digests_of_what_was_asked(spark):
    df = spark.createDataFrame([("w", "m", "p", "t", None), ("w", "m", "p", None, "x"), ("w", "m", "p", "t", " ")], "window_id string, model string, prompt_sha16 string, text string, label string")
    got = ledger.keyed(df).collect()
    assert got[0].input_hash == hashlib.sha256(b"m|p|t").hexdigest()[:16] and got[1].input_hash is None
    assert [r.label for r in got] == ["primary", "x", "primary"]
    assert ledger.keyed(df.drop("label")).first().label == "primary"


def test_merging_keeps_the_newest_in_any_order_and_twice(spark, tmp_path):
    batches = [
        [entry("w1", "aa1", 1, "old"), entry("w1", "aa1", 3, "new"), entry("w2", "bb1", 1, "x"), entry(None, "cc", 1, "no window")],
        [entry("w1", "aa1", 2, "between"), entry("w2", "bb1", 5, "later"), entry("w3", "aa2", None, "no time"), entry("w1", "aa1", 1, "again", "again")],
        [entry("w3", "aa2", 0, "timed"), entry("w4", "cc9", 4, "b"), entry("w4", "cc9", 4, "a")],
    ]
    tables = []
    for k, order in enumerate(((0, 1, 2), (2, 1, 0, 1, 2), (1, 1, 0, 2))):
        book = ledger.Ledger(spark, str(tmp_path / f"l{k}"), digits=1)
        for i in order:
            book.merge(spark.createDataFrame(batches[i], ENTRY))
        tables.append(rows_of(book))
    want = [("w1", "aa1", "again", 1, "again"), ("w1", "aa1", "primary", 3, "new"), ("w2", "bb1", "primary", 5, "later"), ("w3", "aa2", "primary", 0, "timed"), ("w4", "cc9", "primary", 4, "b")]
    assert tables == [want] * 3
    requests = spark.createDataFrame([("w1", "aa1", "primary"), ("w1", "aa1", "primary"), ("w1", "zz", "primary"), ("w1", "zz", "primary"), ("w2", "bb1", "other")], "window_id string, input_hash string, label string")
    assert sorted(map(tuple, book.pending(requests).collect())) == [("w1", "zz", "primary"), ("w2", "bb1", "other")]
    assert {r.response_text for r in book.answered(requests).collect()} == {"new"}


def test_a_merge_touches_only_its_partitions(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "l"), digits=1)
    assert book.read().collect() == [] and book.pending(spark.createDataFrame([("w", "a", "p")], "window_id string, input_hash string, label string")).count() == 1
    book.merge(spark.createDataFrame([entry("w1", "aa", 1, "x"), entry("w2", "bb", 1, "y")], ENTRY))
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "l" / "part=a").iterdir()}
    book.merge(spark.createDataFrame([entry("w2", "bb", 2, "z")], ENTRY))
    book.merge(spark.createDataFrame([], ENTRY))
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "l" / "part=a").iterdir()} == before
    assert rows_of(book) == [("w1", "aa", "primary", 1, "x"), ("w2", "bb", "primary", 2, "z")]
