"""Quantiles, tails, matched sets and posterior chances against plain Python; the evidence measures on constructed windows."""

from __future__ import annotations

import datetime as dt
import hashlib
import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_study import plain_bm25
from tidemark.functions import normal
from tidemark.functions import text as T
from tidemark.operators import bm25, ceiling, inference, windows
from tidemark.plans import evidence

NORMAL = statistics.NormalDist()


def test_normal_quantile_and_tails(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.02425, 0.075, 0.3, 0.5, 0.6, 0.925, 0.975, 0.999999, 1 - 1e-12]
    df = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, -1.0, None]], "p double")
    got = {r.p: r.z for r in df.select("p", normal.quantile(F.col("p")).alias("z")).collect()}
    assert all(got[p] == pytest.approx(NORMAL.inv_cdf(p), rel=1e-12, abs=1e-12) for p in ps)
    assert [got[p] for p in (0.0, 1.0, -1.0, None)] == [None] * 4
    assert spark.range(1).select(normal.quantile(0.975).alias("z")).first().z == pytest.approx(inference.Z_975, abs=1e-14)
    zs = [-9.0, -4.6, -1.0, 0.0, 1e-8, 0.5, 1.96, 4.4999, 4.5, 4.6, 8.0, 30.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in df.select("z", normal.upper_tail(F.col("z")).alias("p"), normal.two_sided(F.col("z")).alias("q")).collect():
        assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)) / 2, rel=1e-9, abs=1e-300)
        assert r.q == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-9)


def test_chi_square_tails(spark):
    """One and two degrees of freedom in closed form, more by the recursion over two degrees."""

    def slow(x, df):
        if df == 1:
            return math.erfc(math.sqrt(x / 2))
        if df == 2:
            return math.exp(-x / 2)
        return slow(x, df - 2) + math.exp((df / 2 - 1) * math.log(x / 2) - x / 2 - math.lgamma(df / 2))

    cases = [(x, df) for x in (0.01, 1.0, 3.367, 12.0, 60.0) for df in range(1, 12)]
    rows = spark.createDataFrame([*cases, (0.0, 3), (-1.0, 4), (2.0, 0)], "x double, df int")
    for r in rows.select("x", "df", normal.chi_square_tail(F.col("x"), F.col("df")).alias("p")).collect():
        if r.df < 1:
            assert r.p is None
        else:
            assert r.p == pytest.approx(1.0 if r.x <= 0 else slow(r.x, r.df), rel=1e-9)


def test_golden_mantel_haenszel_and_levels(spark):
    t = spark.createDataFrame([(16, 4, 8, 5), (20, 0, 10, 3)], "a long, b long, c long, d long")
    r = inference.mantel_haenszel(t).first()
    assert (round(r.odds_ratio, 3), round(r.chi2, 3), round(r.p, 4)) == (4.375, 3.367, 0.0665)
    # The variance of Robins, Breslow and Greenland, by hand.
    big, small = (16 * 5 + 20 * 3) / 33, 4 * 8 / 33
    pr, mixed, qs = (21 * 80 + 23 * 60) / 33**2, (21 * 32 + 12 * 80 + 10 * 60) / 33**2, 12 * 32 / 33**2
    se = math.sqrt(pr / (2 * big**2) + mixed / (2 * big * small) + qs / (2 * small**2))
    assert (r.low, r.high) == (pytest.approx(4.375 * math.exp(-inference.Z_975 * se)), pytest.approx(4.375 * math.exp(inference.Z_975 * se)))
    wide = inference.mantel_haenszel(t, alpha=0.01).first()
    assert wide.low < r.low < r.high < wide.high and wide.p == r.p
    n = spark.createDataFrame([(16, 20, 8, 13, 0.05), (16, 20, 8, 13, 0.2)], "x1 int, n1 int, x0 int, n0 int, alpha double")
    a, b = inference.newcombe(n, "x1", "n1", "x0", "n0", alpha=F.col("alpha")).orderBy("alpha").collect()
    assert [round(100 * v, 1) for v in (a.low, a.high)] == [-11.5, 47.1] and a.low < b.low < b.high < a.high
    assert inference.newcombe(n, "x1", "n1", "x0", "n0", alpha=0.2).first().low == pytest.approx(b.low)


def test_jeffreys_chances_are_exact():
    assert inference.jeffreys_chance(16, 20, 8, 13) == pytest.approx(0.877, abs=2e-3) and inference.jeffreys_chance(16, 20, 8, 13, 0.1) == pytest.approx(0.693, abs=2e-3)
    for x, n in ((0, 1), (3, 7), (500, 1000), (99_999, 100_000)):
        assert inference.jeffreys_chance(x, n, x, n) == pytest.approx(0.5, abs=1e-8)
    for a, b in (((3, 9), (1, 4)), ((0, 5), (2, 2)), ((700, 1000), (650, 1000))):
        assert inference.jeffreys_chance(*a, *b) + inference.jeffreys_chance(*b, *a) == pytest.approx(1, abs=1e-8)
    rng = np.random.default_rng(3)
    drawn = rng.beta(3.5, 6.5, 400_000) - rng.beta(1.5, 3.5, 400_000)
    assert inference.jeffreys_chance(3, 9, 1, 4, 0.1) == pytest.approx((drawn > 0.1).mean(), abs=4e-3)
    assert inference.jeffreys_chance(3, 9, 1, 4, 1.0) == 0


def test_jeffreys_chances_have_no_bend_at_the_margin():
    """Against two million steps of the angle; few trials without a success have a root where the rate is the margin."""
    steps = 2_000_000
    angle = (np.arange(steps) + 0.5) * math.pi / 2 / steps
    sin2 = np.sin(angle) ** 2

    def mass(x, n):
        a, b = x + 0.5, n - x + 0.5
        return np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (2 * a - 1) * np.log(np.sin(angle)) + (2 * b - 1) * np.log(np.cos(angle))) * math.pi / steps

    for one, other, margin in (((4, 34), (0, 5), 0.1), ((5, 37), (1, 9), 0.1), ((0, 3), (4, 4), -0.2), ((3, 9), (40_000, 100_000), 0.1)):
        upto = np.concatenate([[0.0], np.cumsum(mass(*other))])
        at = np.arcsin(np.sqrt(np.clip(sin2 - margin, 0, 1))) * 2 * steps / math.pi
        want = (mass(*one) * np.interp(at, np.arange(steps + 1), upto)).sum()
        assert inference.jeffreys_chance(*one, *other, margin) == pytest.approx(want, abs=1e-7)


def slow_matched(sets):
    """(n_cases, expected, p_upper, p) by going through all choices of one case from each set; sets of flags, the case first."""
    observed = sum(s[0] for s in sets)
    counts = {}
    for pick in itertools.product(*(range(len(s)) for s in sets)):
        t = sum(s[i] for s, i in zip(sets, pick))
        counts[t] = counts.get(t, 0) + 1
    total = sum(counts.values())
    upper = sum(c for t, c in counts.items() if t >= observed) / total
    p = sum(c for c in counts.values() if c <= counts[observed] * (1 + 1e-7)) / total
    return observed, sum(sum(s) / len(s) for s in sets), upper, p


def test_matched_sets_equal_all_arrangements(spark):
    rng = random.Random(4)
    groups = {g: [[rng.random() < 0.3 + 0.3 * (i == 0) for i in range(rng.choice([2, 3, 3, 4]))] for _ in range(6)] for g in "abc"}
    groups["all"] = [[True, True], [True, True, True]]
    groups["none"] = [[False, False]]
    rows = [(g, k, i == 0, flag) for g, sets in groups.items() for k, s in enumerate(sets) for i, flag in enumerate(s)]
    rows += [("a", 90, True, True), ("a", 91, False, True), ("a", 91, False, None), ("a", 92, True, True), ("a", 92, True, False), ("odd", 1, None, None)]
    df = spark.createDataFrame(rows, "g string, k int, is_case boolean, flag boolean").repartition(3)
    got = {r.g: r for r in inference.matched_set_test(df, "is_case", "flag", ["k"], ["g"]).collect()}
    assert got["a"].n_left_out == 3 and got["odd"].n_sets == 0 and got["odd"].p is None
    for g, sets in groups.items():
        observed, expected, upper, p = slow_matched(sets)
        r = got[g]
        assert (r.n_sets, r.n_cases) == (len(sets), observed)
        assert (r.expected, r.p_upper, r.p) == (pytest.approx(expected), pytest.approx(upper), pytest.approx(p))
    many = spark.createDataFrame([(k, i == 0, (k + i) % 3 == 0) for k in range(400) for i in range(3)], "k int, is_case boolean, flag boolean")
    r = inference.matched_set_test(many, "is_case", "flag", ["k"]).first()
    assert r.n_sets == 400 and 0 < r.p <= 1 and r.expected == pytest.approx(400 / 3)


def test_matched_chances_are_exact_and_take_no_square_time(spark):
    """Against whole numbers; and on so many sets that squared sums would not end."""
    ways = [1]
    for share, m in ((1, 40), (2, 20)):
        one = [math.comb(m, k) * share**k * (3 - share) ** (m - k) for k in range(m + 1)]
        ways = [sum(ways[j] * one[i - j] for j in range(max(0, i - m), min(i, len(ways) - 1) + 1)) for i in range(len(ways) + m)]
    for n in (0, 5, 27, 30, 55, 60):
        upper, p = inference.matched_chances([(40, 1 / 3), (20, 2 / 3)], n)
        assert upper == pytest.approx(sum(ways[n:]) / sum(ways), rel=1e-9) and p == pytest.approx(sum(w for w in ways if w <= ways[n]) / sum(ways), rel=1e-9)
    n = 300_000
    many = spark.range(3 * n).select(F.floor(F.col("id") / 3).alias("k"), (F.col("id") % 3 == 0).alias("is_case"), (F.col("id") % 6 < 2).alias("flag"))
    r = inference.matched_set_test(many, "is_case", "flag", ["k"]).first()  # half of the sets have two flags, one of them the case's
    assert (r.n_sets, r.n_cases) == (n, n // 2) and r.p == pytest.approx(0, abs=1e-300)
    assert inference.matched_chances([(n, 1 / 3)], n // 3)[0] == pytest.approx(0.5, abs=2e-3)


# Windows of two kinds, whose items hold a few topics; the third window has no held-out text.
DAYS = [(dt.date(2024, 1, d), "transition" if d % 2 else "control") for d in range(1, 7)]
TOPICS = ["crude barrels drilling", "harvest wheat drought", "ballot vote coalition", "bank lending rates", "flood river levee", "metal copper smelter"]


@pytest.fixture(scope="module")
def windowed(spark):
    rows = []
    for (day, kind), topic in zip(DAYS, TOPICS):
        for k in range(4):
            role = "generation" if k < 2 else "holdout"
            text = f"{topic} report number{k} {day.day}" if not (day.day == 3 and role == "holdout") else " "
            rows.append((day, kind, f"{day.day}-{k}", role, "Business" if k % 2 else "Sport", text, f"Title {topic.split()[0]}" if day.day == 5 else None))
    return spark.createDataFrame(rows, "boundary date, kind string, item_id string, role string, section string, text string, title string")


def narratives(spark):
    rows = []
    for (day, _), topic in zip(DAYS, TOPICS):
        d = day.day
        claims = [(f"{topic} moved", [f"{d}-0", f"{d}-2"]), (topic, [f"{d}-3"]), ("unrelated gossip entirely", [f"{d}-1"])]
        summary, mechanism = (None, "January 2024") if d == 2 else ("nothing", "said")
        rows.append((day, summary, mechanism, [] if d == 2 else claims, d != 4, True, "high"))
    return spark.createDataFrame(rows, "boundary date, summary string, mechanism string, claims array<struct<claim:string,item_ids:array<string>>>, is_confident boolean, driver_identified boolean, confidence string")


def test_measures_of_an_evidence_run(spark, windowed):
    days = spark.createDataFrame(DAYS, "boundary date, kind string")
    got = evidence.measure(days, windowed, narratives(spark), evidence.Settings(permutations=200))
    # A held-out item that is cited is a fabrication, and the claim's words are looked for in the generation half alone.
    claims = {(r.window_id.day, r.claim_id[-1]): r for r in got["claims"].collect()}
    assert (claims[1, "0"].n_cited, claims[1, "0"].n_fabricated, claims[1, "0"].status) == (2, 1, "grounded")
    assert (claims[1, "1"].status, claims[1, "2"].status) == ("fabricated_citation", "ungrounded")
    (f,) = got["fisher"].collect()
    assert (f.a, f.b, f.c, f.d) == (3, 0, 2, 1) and f.p == pytest.approx(1.0)
    # Window 2 says nothing once its dates are scrubbed, window 3 has no held-out text.
    ranks = {}
    for r in got["match"].collect():
        ranks.setdefault(r.arm, {})[r.query_id] = (r["rank"], r.n_candidates)
    words = lambda t: [w for w in T_tokens(t)]
    text = {(r.boundary, r.section, r.role, r.kind): [] for r in windowed.collect()}
    for r in windowed.collect():
        text[r.boundary, r.section, r.role, r.kind].append("\n".join(x for x in (r.title or "", r.text) if x).strip())
    for arm, keep in {
        "all_windows": lambda s, k: True, "transitions_all_sections": lambda s, k: k == "transition",
        "transitions_business_only": lambda s, k: k == "transition" and s == "Business",
    }.items():
        docs = {}
        for (b, s, role, k), parts in text.items():
            if role == "holdout" and keep(s, k) and any(p.strip() for p in parts) and b.day not in (2, 3):
                docs.setdefault(b.isoformat(), []).extend(w for p in parts for w in words(p))
        told = {r.boundary.isoformat(): words(" ".join([r.summary or "", r.mechanism or "", *(c.claim for c in r.claims)])) for r in narratives(spark).collect()}
        assert ranks[arm] == plain_bm25({q: w for q, w in told.items() if q in docs}, docs), arm
    assert {r.arm: r.n for r in got["match_summary"].collect()} == {"all_windows": 4, "transitions_all_sections": 2, "transitions_business_only": 2}
    assert {r.arm for r in got["permutation"].collect()} == set(ranks)


def T_tokens(text):
    import re

    return [w for w in re.findall(r"[a-z][a-z0-9\-']+", text.lower()) if w not in T.STOP_WORDS]


def test_prompts_have_a_heading_and_tell_of_empty_windows(spark):
    rows = [(dt.date(2024, 1, 2), "a", dt.datetime(2024, 1, 1), 1, "Law", "ruled in May 2020", "T"), (dt.date(2024, 1, 2), "b", dt.datetime(2024, 1, 2), 2, None, "", "Only a title")]
    df = spark.createDataFrame(rows, "boundary date, item_id string, published timestamp, day_index int, section string, text string, title string")
    days = spark.createDataFrame([(dt.date(2024, 1, 2),), (dt.date(2024, 5, 5),)], "boundary date")
    got = {r.boundary.month: r for r in evidence.render(df, window_days=2, days=days).collect()}
    assert got[1].prompt == "There are 2 items, covering a window of 2 days. Day 2 is the day the model flagged.\n[a] Day 1 | Law\nruled in [month] [year]\n\n[b] Day 2\nOnly a title"
    assert (got[5].n_items, got[5].prompt) == (0, "(no items were published in this window)")


def test_digests_are_those_of_the_prompts(spark):
    """Items in the very minute, in one second, late on a boundary, without text, section or time; no plan collects a window."""
    rng = random.Random(2)
    rows = [(f"i{k}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.choice([k % 7 * 86400, rng.randrange(7 * 86400)])), rng.choice(["Law", "", None]), f"ruled é {k} in May 2020" if k % 5 else None, f"T{k}") for k in range(300)]
    rows += [("late", dt.datetime(2024, 1, 3, 23, 59, 59, 500_000), "x", "y", None), ("last", dt.datetime(2024, 1, 3, 23, 59, 59), "x", "y", None), ("never", None, "x", "y", None)]
    df = spark.createDataFrame(rows, "item_id string, published timestamp, section string, text string, title string").repartition(5)
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 3, 4, 4, 9)] + [(dt.date(2024, 5, 5),)], "boundary date")
    whole = evidence.render(windows.items_in_windows(df, days, 3), window_days=3)
    want = {(r.boundary, r.n_items, hashlib.md5(r.prompt.encode()).hexdigest()) for r in whole.collect()}
    got = evidence.prompt_digests(df, days, window_days=3)
    assert len(want) == 4 and sorted(map(tuple, got.collect())) == sorted(want)


def test_windows_are_truncated_and_say_so(spark):
    items = spark.createDataFrame([(f"i{k:02d}", dt.datetime(2024, 1, 1 + k % 3, 12), "x", "t") for k in range(30)] + [("z", dt.datetime(2024, 3, 1), "x", "t")], "item_id string, published timestamp, section string, text string")
    days = spark.createDataFrame([(dt.date(2024, 1, 3), "transition"), (dt.date(2024, 3, 1), "control")], "boundary date, kind string")
    got = evidence.build_windows(days, items, evidence.Settings(window_days=3, max_items=10))
    sizes = {r.boundary.month: (r.n, r.t) for r in got.groupBy("boundary").agg(F.count("*").alias("n"), F.max("truncated_from").alias("t")).collect()}
    assert sizes == {1: (10, 30), 3: (1, None)}
    assert {r.published.day for r in got.filter("month(boundary) = 1").collect()} == {1, 2, 3}
    with pytest.raises(ValueError):
        evidence.Settings(max_items=-1)


def test_large_scores_that_differ_by_their_sums_order_are_ties(spark, monkeypatch):
    """Windows of the same held-out texts: what the order of a sum leaves in the eighth place doesn't rank them."""
    rows = [(b, f"{b}{role}", 0, role, "crude barrels") for b in (1, 2, 3) for role in ("generation", "holdout")]
    df = spark.createDataFrame(rows, "boundary int, item_id string, published int, role string, text string")
    scored = spark.createDataFrame([("all", 0, q, d, 90000.0 + d * 1e-8) for q in (1, 2, 3) for d in (1, 2, 3)], "arm string, words int, query_id int, doc_id int, score double")
    monkeypatch.setattr(bm25, "scores", lambda *_, **__: scored)
    got = ceiling.length_sweep(df, (None,)).collect()
    assert sorted((r.query_id, r["rank"], r.predicted) for r in got) == [(1, 1, 1), (2, 2, 1), (3, 3, 1)]


def test_pools_and_lengths_share_an_index(spark):
    """Each arm's ranks are those of the arm alone."""
    rng = random.Random(8)
    vocabulary = [f"word{chr(97 + i)}" for i in range(20)]
    rows = [(b, f"i{k}", k, "generation" if k % 2 else "holdout", "transition" if b % 2 else "control", " ".join(rng.choices(vocabulary[b : b + 9], k=12))) for b in range(7) for k in range(6)]
    df = spark.createDataFrame(rows, "boundary int, item_id string, published int, role string, kind string, text string")
    got = {(r.arm, r.words, r.query_id): (r.n_candidates, r["rank"], r.predicted) for r in ceiling.pools(df, lengths=(10, None)).collect()}
    assert len(got) == 2 * (7 + 3 + 4)
    for arm, keep in (("all_windows", "true"), ("transitions_only", "kind = 'transition'"), ("placebos_only", "kind = 'control'")):
        part = df.filter(keep)
        held = part.filter("role = 'holdout'").select(F.col("boundary").alias("doc_id"), T.tokens(F.col("text")).alias("terms"))
        for words in (10, None):
            asked = ceiling.proxy_terms(part.filter("role = 'generation'"), words).withColumnRenamed("boundary", "query_id")
            for r in bm25.match_ranks(asked, held).collect():
                assert got[arm, words, r.query_id] == (r.n_candidates, r["rank"], r.predicted)
    summary = {(r.arm, r.words): r for r in ceiling.summary(ceiling.pools(df, lengths=(10, None)), 100).collect()}
    assert len(summary) == 6 and all(0 < r.p <= 1 and r.n == r.n_candidates for r in summary.values())


def test_texts_are_read_a_few_times_for_all_arms_and_lengths(spark):
    """Words are counted once by the set of arms, and slices take again only what they need: what is read of texts doesn't grow with arms and lengths."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    rows = [(b, f"i{k}", k, "generation" if k % 2 else "holdout", "transition" if b % 2 else "control", f"worda{b} wordb{k} wordc") for b in range(4) for k in range(6)]
    df = spark.createDataFrame(rows, "boundary int, item_id string, published int, role string, kind string, text string").withColumn("text", counted("text"))
    assert ceiling.pools(df, lengths=(2, 3, 4, 5, None)).count() == 5 * (4 + 2 + 2)
    assert read.value <= 6 * len(rows)


def test_slices_of_rows_that_repeat_or_have_no_date(spark):
    """Each copy of a row is part of its window's text; rows without a date come first."""
    rows = [(1, "b", 5, "bba bbb"), (1, "a", 2, "aaa aab aac"), (1, "a", 2, "aaa aab aac"), (1, "c", None, "cca"), (1, "d", 1, " ")]
    df = spark.createDataFrame(rows, "boundary int, item_id string, published int, text string")
    whole = "cca aaa aab aac aaa aab aac bba bbb".split()
    (r,) = ceiling.proxy_terms(df, 9).collect()
    assert r.terms == whole
    (r,) = ceiling.proxy_terms(df, 7).collect()
    assert r.terms in [whole[k : k + 7] for k in range(3)]


def test_counts_of_the_ceiling_are_never_broadcast(spark, monkeypatch):
    """Windows with both halves come from an aggregate; no join has all counts on the side that is broadcast."""
    plans, write = {}, ceiling.Scratch.write
    monkeypatch.setattr(ceiling.Scratch, "write", lambda self, df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and write(self, df, name))
    df = spark.createDataFrame([(b, f"i{b}{r}", 0, r, "crude barrels") for b in (1, 2) for r in ("generation", "holdout")], "boundary int, item_id string, published int, role string, text string")
    assert ceiling.length_sweep(df, (None,)).count() == 2
    assert "Join" not in plans["both"] and "SortMergeJoin" in plans["scores"]
