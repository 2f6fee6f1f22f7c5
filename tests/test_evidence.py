from __future__ import annotations

import datetime as dt
import itertools
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import tails, text
from tidemark.operators import audit, bm25, inference, windows
from tidemark.plans import evidence
from tidemark.sources import inputs, store, wikitext

B = dt.date(2020, 3, 3)


def items(spark, stamps):
    rows = [(f"i{k}", dt.datetime.fromisoformat(s)) for k, s in enumerate(stamps)]
    return spark.createDataFrame(rows, "item_id string, published timestamp")


def boundary(spark, *days):
    return spark.createDataFrame([(d,) for d in days or (B,)], "boundary date")


def test_window_edges(spark):
    got = windows.items_in_windows(items(spark, ["2020-03-03 23:59:59", "2020-03-03 23:59:59.5", "2020-03-04 00:00:00", "2020-02-19 00:00:00", "2020-02-18 23:59:59"]), boundary(spark), 14).collect()
    assert {(r.item_id, r.day_index) for r in got} == {("i0", 14), ("i3", 1)}


def test_drop_counts_add_up(spark):
    stamps = [f"2020-{m:02d}-{d:02d} 12:00:00" for m in (1, 2, 3) for d in range(1, 29)] + ["2020-03-03 23:59:59.9"]
    (r,) = windows.dropped_counts(items(spark, stamps), boundary(spark), 14).collect()
    assert (r.n_before, r.n_in, r.n_after) == (46, 13, 26)
    assert r.n_before + r.n_in + r.n_after == len(stamps)


def test_no_item_after_its_boundary_for_any_length(spark):
    stamps = [(dt.datetime(2020, 1, 1) + dt.timedelta(days=k)).isoformat(" ") for k in range(120)]
    for days in (1, 3, 14, 60):
        got = windows.items_in_windows(items(spark, stamps), boundary(spark), days)
        assert windows.check_closed(got).count() == min(days, 63)
    late = items(spark, ["2020-03-04 00:00:01"]).withColumn("boundary", F.lit(B))
    with pytest.raises(Exception, match="boundary"):
        windows.check_closed(late).collect()
    with pytest.raises(ValueError):
        windows.window_days(boundary(spark), 0)


def test_zones(spark):
    df = spark.createDataFrame([("2020-03-04 08:00:00", "Asia/Tokyo"), ("2020-03-03 12:00:00", None)], "raw string, zone string")
    got = windows.normalise_time(df, "raw", "zone").collect()
    assert [(r.published.isoformat(), r.tz_assumed) for r in got] == [("2020-03-03T23:00:00", False), ("2020-03-03T12:00:00", True)]


def test_holdout_is_stable_and_never_empty(spark):
    df = windows.items_in_windows(items(spark, [f"2020-03-0{1 + k % 3} {k:02d}:00:00" for k in range(20)]), boundary(spark))
    a = {(r.item_id, r.role) for r in windows.holdout_split(df).collect()}
    b = {(r.item_id, r.role) for r in windows.holdout_split(df.orderBy(F.desc("published"))).collect()}
    assert a == b and sum(r == "holdout" for _, r in a) == 10
    one = windows.holdout_split(df.limit(1), 0.5).collect()
    assert [r.role for r in one] == ["holdout"]
    for f in (0, 1):
        with pytest.raises(ValueError):
            windows.holdout_split(df, f)


def test_even_truncation_matches_numpy(spark):
    import numpy as np

    for n, most in ((57, 10), (10, 10), (5, 10), (33, 2), (12, 1)):
        df = spark.createDataFrame([(B, k, f"{k:03d}") for k in range(n)], "boundary date, published int, item_id string")
        got = sorted(r.published for r in windows.truncate_evenly(df, most).collect())
        want = list(range(n)) if n <= most else sorted(set(np.round(np.linspace(0, n - 1, most)).astype(int).tolist()))
        assert got == want


def test_bm25_orders_and_skips_unknown_terms(spark):
    docs = spark.createDataFrame([("a", ["oil", "price", "oil"]), ("b", ["oil", "vote"]), ("c", ["vote"]), ("d", [])], "doc_id string, terms array<string>")
    q = spark.createDataFrame([("q", ["oil", "unknown"]), ("e", []), ("r", ["oil", "oil"])], "query_id string, terms array<string>")
    got = {(r.query_id, r.doc_id): r.score for r in bm25.scores(q, docs).collect()}
    assert got["q", "a"] > got["q", "b"] > 0 and ("q", "c") not in got and not any(k[0] == "e" for k in got)
    assert got["r", "a"] == pytest.approx(2 * got["q", "a"])


def test_blind_match_finds_topics_and_not_boilerplate(spark):
    topics = ["oil drill rig", "vote poll seat", "bank loan rate", "storm rain wind", "court judge trial"]
    mk = lambda ids, texts, name: spark.createDataFrame([(i, t.split()) for i, t in zip(ids, texts)], f"{name} string, terms array<string>")
    ids = list("abcde")
    ranks = bm25.match_ranks(mk(ids, topics, "query_id"), mk(ids, topics, "doc_id"))
    (s,) = bm25.match_summary(ranks).collect()
    assert s.accuracy == 1 and s.mrr == 1 and s.chance == pytest.approx(0.2)
    (p,) = bm25.permutation_p(ranks, 400).collect()
    assert p.p < 0.05
    same = bm25.match_ranks(mk(ids, ["same words here"] * 5, "query_id"), mk(ids, ["same words here"] * 5, "doc_id"))
    (s,) = bm25.match_summary(same).collect()
    assert s.accuracy == pytest.approx(0.2)
    assert sorted(r["rank"] for r in same.collect()) == [1, 2, 3, 4, 5]
    extra = bm25.match_ranks(mk(["a"], ["nothing shared"], "query_id"), mk(ids, topics, "doc_id")).collect()
    assert [(r["rank"], r.predicted, r.n_candidates) for r in extra] == [(1, "a", 5)]


def test_nearest_pools_match_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(i, B + dt.timedelta(days=rng.choice([0, 0, 0, 1, 3, 9, 30]))) for i in range(40)]
    df = spark.createDataFrame(rows, "window_id int, d date")
    for k in (1, 3, 5):
        got = {(r.pool, r.window_id) for r in bm25.nearest_pools(df, k).collect()}
        want = {(i, j) for i, d in rows for _, j in sorted((abs((e - d).days), j) for j, e in rows)[:k]}
        assert got == want


def test_scrubbing(spark):
    df = spark.createDataFrame([("On 2020-03-03 and 3/3/2020 in March, Q1 of 2019: x",)], "t string")
    r = df.select(text.strip_identifying(F.col("t")).alias("a"), text.strip_dates(F.lit("On 3 March 2020, May 5th; may rise last year, in June 2019-01-02")).alias("b")).first()
    assert r.a == "On -03-03 and 3/3/ in , of : x"
    assert r.b == "On [date] [year], [date]; may rise [relative period], in [month] [date]"


def test_wiki_lines(spark):
    page = ";Business and economy\n*Oil\n**Prices of [[crude oil|oil]] fall by ''ten'' per cent. [https://www.a.com/x (A News)]\n*A standalone item that is long enough to stay. [https://b.org/y]\n*short\n'''Law'''\n* Topic\n** {{x|{{y}}}}Court rules on the <b>case</b> &amp; adjourns for today"
    got = wikitext.parse_items(spark.createDataFrame([("p", page)], "page string, wikitext string")).orderBy("n").collect()
    assert [(r.section, r.topic, r.text) for r in got] == [
        ("Business and economy", "Oil", "Prices of oil fall by ten per cent."),
        ("Business and economy", "", "A standalone item that is long enough to stay."),
        ("Law", "Topic", "Court rules on the case & adjourns for today"),
    ]
    assert [(s.publisher, s.url) for s in got[0].sources] == [("A News", "https://www.a.com/x")] and got[1].sources[0].publisher == "b.org"
    old = wikitext.parse_items(spark.createDataFrame([("p", page)], "page string, wikitext string"), legacy_sections=True).orderBy("n").collect()
    assert {r.section for r in old} == {"Business and economy"}


def test_claim_statuses(spark):
    claims = spark.createDataFrame([(1, 1, "central bank raised interest rates", ["x"]), (1, 2, "central bank", ["zz"]), (1, 3, "central bank", []), (1, 4, "wheat harvest failed badly", ["x", "zz"])], "window_id int, claim_id int, claim string, item_ids array<string>")
    its = spark.createDataFrame([(1, "x", "The central bank has raised rates"), (2, "zz", "central bank")], "window_id int, item_id string, text string")
    got = {r.claim_id: r for r in audit.audit_claims(claims, its).collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["grounded", "fabricated_citation", "uncited", "ungrounded"]
    assert got[1].overlap == pytest.approx(4 / 5) and got[4].n_fabricated == 1
    (f,) = audit.faithfulness(audit.audit_claims(claims, its)).collect()
    assert f.n_with_fabricated == 2 and f.n_fabricated_only == 1


def test_golden_inference(spark):
    t = spark.createDataFrame([(16, 4, 8, 5), (20, 0, 10, 3), (0, 0, 3, 1)], "a long, b long, c long, d long")
    p = [r.p for r in inference.fisher_exact(t).orderBy("a").collect()]
    assert p[0] is None and p[1] == pytest.approx(0.42514, abs=1e-5) and p[2] == pytest.approx(0.05242, abs=1e-5)
    n = inference.newcombe(spark.createDataFrame([(16, 20, 8, 13), (16, 20, 26, 40)], "x1 int, n1 int, x0 int, n0 int"), "x1", "n1", "x0", "n0").orderBy("n0").collect()
    assert [round(100 * v, 1) for r in n for v in (r.low, r.high)] == [-11.5, 47.1, -10.1, 34.6]
    s = inference.binomial_tail(spark.createDataFrame([(18, 20)], "k int, n int"), "k", "n", two_sided=True).first()
    assert s.p == pytest.approx(4.0245e-4, rel=1e-4)
    b = inference.binomial_tail(spark.createDataFrame([(43, 60, 1 / 3), (37, 60, 0.2)], "k int, n int, q double"), "k", "n", "q").orderBy("k").collect()
    assert b[0].p == pytest.approx(2.2309e-12, rel=1e-3) and b[1].p == pytest.approx(1.4775e-9, rel=1e-3)
    assert inference.signed_rank_p([-1, -2, 3, -4] + [5.0 + i for i in range(16)]) == pytest.approx(38 / 2**20)  # 19 sets of ranks sum to 7 at most
    assert inference.signed_rank_p([float(i) for i in range(1, 21)]) == pytest.approx(2 / 2**20)
    j = inference.jeffreys(spark.createDataFrame([(16, 20, 8, 13)], "x1 int, n1 int, x0 int, n0 int"), "x1", "n1", "x0", "n0").first()
    assert j.p_higher == pytest.approx(0.877, abs=0.01) and j.p_margin == pytest.approx(0.693, abs=0.01)


def test_kappa_is_null_where_chance_is_one(spark):
    df = spark.createDataFrame([(True, True)] * 5, "a boolean, b boolean")
    assert inference.cohen_kappa(df, "a", "b").first().kappa is None


def test_power_sums_over_outcomes(spark):
    r = inference.power_of_fisher(spark.createDataFrame([(6, 6, 0.9, 0.1)], "n1 int, n0 int, p1 double, p0 double"), "n1", "n0", "p1", "p0").first()
    assert 0.5 < r.power < 1


def test_power_leaves_out_a_p_that_is_alpha(spark):
    """Of 23 and 2 trials with six successes in all, both of the two: 15 of 300 arrangements, which is 0.05 and not less."""
    r = inference.power_of_fisher(spark.createDataFrame([(23, 2, 0.2, 0.9)], "n1 int, n0 int, p1 double, p0 double"), "n1", "n0", "p1", "p0").first()
    want = 0.0
    for x1, x0 in itertools.product(range(24), range(3)):
        ways = [math.comb(23, i) * math.comb(2, x1 + x0 - i) for i in range(max(0, x1 + x0 - 2), min(23, x1 + x0) + 1)]
        own = math.comb(23, x1) * math.comb(2, x0)
        if 20 * sum(w for w in ways if w <= own) < sum(ways):
            want += math.comb(23, x1) * 0.2**x1 * 0.8 ** (23 - x1) * math.comb(2, x0) * 0.9**x0 * 0.1 ** (2 - x0)
    assert r.power == pytest.approx(want, rel=1e-9)


def test_tails():
    assert tails.t_tail(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert tails.f_tail(4.0, 1, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert tails.beta_inc(2, 3, 0.5) == pytest.approx(0.6875)


def test_runs_survive_broken_lines(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = [(dt.datetime(2024, 1, k), f"My Run! {k}", "m", {"a": "1"}, {"x": 1.0}) for k in (1, 2)]
    store.save_runs(spark.createDataFrame(rows, "saved_at timestamp, label string, model string, config map<string,string>, summary map<string,double>"), path)
    (tmp_path / "runs" / "bad.json").write_text("{not json\n[1,2]\n")
    got = store.list_runs(spark, path).collect()
    assert [r.run_id for r in got] == ["20240102-000000_my-run-2", "20240101-000000_my-run-1"]
    assert store.load_run(spark, path, got[0].run_id).count() == 1 and store.load_run(spark, path, "none").count() == 0


def test_narratives_are_parsed_or_marked(spark):
    raw = ['```json\n{"driver_identified": true, "confidence": "HIGH", "claims": [{"claim": "c", "item_ids": ["1"]}]}\n```', "no json", 'text {"summary": "s"} more']
    got = store.parse_narratives(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, response_text string")).orderBy("i").collect()
    assert [r.parse_ok for r in got] == [True, False, True]
    assert got[0].is_confident and got[0].claims[0].item_ids == ["1"] and got[1].confidence == "none" and got[2].summary == "s" and got[2].claims == []


def test_columns_are_found(spark):
    df = spark.createDataFrame([(f"n{i}", f"2020-01-{i + 1:02d}" if i else "bad", i % 2) for i in range(10)], "name string, when string, regime int")
    found = inputs.infer_columns(df)
    assert found.day == "when" and found.state == "regime" and found.shares["when"] == pytest.approx(0.9)
    assert inputs.days_and_states(df).count() == 9
    with pytest.raises(ValueError):
        inputs.days_and_states(spark.createDataFrame([("x",)], "a string"))


def test_prices_from_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date,SPY,VIX\n2020-01-02,100,12\n2020-01-03,,13\n2020-01-06,101,14\n")
    wide = store.read_prices(spark, str(tmp_path / "p.csv"), {"VIX": "vix", "SPY": "equity"})
    assert wide.columns == ["d", "vix", "equity"] and wide.count() == 2
    assert store.long_prices(wide).count() == 4
    with pytest.raises(KeyError):
        store.read_prices(spark, str(tmp_path / "p.csv"), {"QQQ": "q"})


def test_settings_are_checked():
    with pytest.raises(ValueError):
        evidence.Settings(window_days=0)
    assert evidence.estimate_cost(10, evidence.Settings())["pages"] == 140
