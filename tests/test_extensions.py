"""Vendor layouts, quarantine, covariance forms, generalisation rows and histograms against plain Python."""

from __future__ import annotations

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_regimes import two_regimes
from tidemark.operators import generalise, hmm, regimes
from tidemark.sources import quarantine, store
from tidemark.sources.tables import materialise

WANT = [(dt.date(2020, 1, 2), 100.0, 12.0), (dt.date(2020, 1, 6), 101.0, 14.0)]
LAYOUTS = {
    "plain": "Date,SPY,^VIX\n2020-01-02,100,12\n2020-01-03,,13\n2020-01-06,101,14\n",
    "field over ticker": "Price,Close,Close,Open,Open\nTicker,^VIX,SPY,^VIX,SPY\nDate,,,,\n2020-01-02,12,100,1,2\n2020-01-03,13,,1,2\n2020-01-06,14,101,1,2\n",
    "ticker over field": ",SPY,SPY,^VIX,^VIX\n,Open,Close,Open,Close\n2020-01-02 00:00:00+00:00,1,100,1,12\n2020-01-03 00:00:00+00:00,1,n/a,1,13\n2020-01-06 00:00:00+00:00,1,101,1,14\n",
    "merged cells": ",SPY,,,^VIX,\nDate,Open,High,close,Open,close\n2020-01-02,1,2,100,1,12\n2020-01-06,1,2,101,1,14\n",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_vendor_layouts(spark, tmp_path, layout):
    (tmp_path / "p.csv").write_text(LAYOUTS[layout])
    got = store.read_vendor_prices(spark, str(tmp_path / "p.csv"), {"SPY": "spy", "^VIX": "vix"})
    assert got.columns == ["d", "spy", "vix"] and [tuple(r) for r in got.orderBy("d").collect()] == WANT


def test_fields_of_a_single_ticker_and_datasets(spark, tmp_path):
    (tmp_path / "dax.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,3,100,9\n2020-01-03,1,2,3,,9\n2020-01-06,1,2,3,101,9\n")
    got = store.load_dataset(spark, str(tmp_path), "dax")
    assert got.columns == ["d", "dax"] and [r.dax for r in got.orderBy("d").collect()] == [100.0, 101.0]
    with pytest.raises(KeyError):
        store.load_dataset(spark, str(tmp_path), "nowhere")
    with pytest.raises(KeyError):
        store.read_vendor_prices(spark, str(tmp_path / "dax.csv"), {"SPY": "spy", "TLT": "tlt"})
    (tmp_path / "p.csv").write_text(LAYOUTS["field over ticker"])
    with pytest.raises(KeyError):
        store.read_vendor_prices(spark, str(tmp_path / "p.csv"), {"SPY": "spy"}, field="Adj Close")
    opened = store.read_vendor_prices(spark, str(tmp_path / "p.csv"), {"SPY": "spy"}, field="Open")
    assert {r.spy for r in opened.collect()} == {2.0}


def test_quarantine_and_good_rows_are_the_input(spark):
    raw = ['{"summary": "s", "confidence": "high"}', "", None, "no object", '{"summary": " "}', '```json\n{"summary": "fenced"}\n```', '{"summary": "cut']
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, response_text string")
    got = quarantine.responses(rows)
    assert {r.i for r in quarantine.good(got).collect()} == {0, 5}
    bad = {r.key: (r.reason, json.loads(r.raw)["i"]) for r in quarantine.quarantined(got, "answers", "i").collect()}
    assert bad == {"1": ("empty response", 1), "2": ("empty response", 2), "3": ("no object", 3), "4": ("no summary", 4), "6": ("no object", 6)}
    assert {r.reason: r.n for r in quarantine.balance(got, "answers").collect()} == {None: 2, "empty response": 2, "no object": 2, "no summary": 1}
    days = quarantine.days(spark.createDataFrame([(1, "2020-03-03"), (2, "3 March 2020"), (3, "soon"), (4, " "), (5, None), (6, "3020-01-01")], "k int, when string"), "when")
    assert {r.k: r.d for r in quarantine.good(days).collect()} == {1: dt.date(2020, 3, 3), 2: dt.date(2020, 3, 3)}
    assert {(r.key, r.reason) for r in quarantine.quarantined(days, "days", "k").collect()} == {("3", "unreadable day"), ("4", "no day"), ("5", "no day"), ("6", "unreadable day")}
    b = dt.date(2020, 3, 3)
    times = [(1, dt.datetime(2020, 3, 3, 23, 59, 59), b), (2, dt.datetime(2020, 3, 4), b), (3, None, b), (4, dt.datetime(2020, 1, 1), None)]
    late = quarantine.revisions(spark.createDataFrame(times, "k int, ts timestamp, boundary date"))
    assert [r.k for r in quarantine.good(late).collect()] == [1]
    assert {(r.key, r.reason) for r in quarantine.quarantined(late, "pages", "k", "boundary").collect()} == {("2:2020-03-03", "later than its boundary"), ("3:2020-03-03", "no time"), ("4:", "no boundary")}
    assert quarantine.quarantined(quarantine.judged(rows, {}), "x", "i").count() == 0


@pytest.mark.parametrize("form", hmm.FORMS)
def test_likelihood_never_falls_and_covariances_keep_their_form(form):
    x, s = two_regimes()
    model = hmm.GaussianHmm.fit(x, 2, 3, form=form)
    steps = np.diff(model.log_likelihoods)
    assert (steps > -1e-2).all()
    agree = (model.viterbi(x) == s).mean()
    assert max(agree, 1 - agree) > 0.95
    one, two = model.covs
    if form == "tied":
        assert np.allclose(one, two)
    if form in ("diag", "spherical"):
        assert one[0, 1] == two[0, 1] == 0
    if form == "spherical":
        assert one[0, 0] == one[1, 1]
    if form == "full":
        assert abs(one[0, 1]) > 0


def test_one_step_of_each_form_is_the_best_of_its_form():
    """The expected log density of a step's covariances against others of their form, found by scaling and rotating them."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 3)) @ rng.standard_normal((3, 3))
    gamma = rng.dirichlet([1, 1], 300)
    weight = gamma.sum(0)
    means = gamma.T @ x / weight[:, None]
    scatters = np.stack([(gamma[:, k, None] * (x - means[k])).T @ (x - means[k]) for k in range(2)])

    def value(covs):
        return sum(-0.5 * weight[k] * np.linalg.slogdet(covs[k])[1] - 0.5 * np.trace(np.linalg.solve(covs[k], scatters[k])) for k in range(2))

    for form in hmm.FORMS:
        best = hmm.shaped(scatters, weight, form, 0.0)
        for _ in range(40):
            if form == "full":
                noise = np.stack([np.eye(3) + 0.05 * rng.standard_normal((3, 3)) for _ in range(2)])
                other = noise @ best @ noise.transpose(0, 2, 1)
            elif form == "tied":
                noise = np.eye(3) + 0.05 * rng.standard_normal((3, 3))
                other = np.stack([noise @ best[0] @ noise.T] * 2)
            elif form == "diag":
                other = best * np.exp(0.1 * rng.standard_normal((2, 3)))[:, :, None]
            else:
                other = best * np.exp(0.1 * rng.standard_normal(2))[:, None, None]
            assert value(other) <= value(best) + 1e-9, form
    with pytest.raises(ValueError):
        hmm.GaussianHmm.fit(x, 2, form="banded")


def test_unknown_forms_are_refused_before_anything_runs(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0)], "asset string, d date, v double")
    with pytest.raises(ValueError):
        hmm.walk_forward(df, ["v"], "v", 2, 1, form="round")


def test_generalisation_has_a_row_for_each_asset(spark):
    rng = np.random.default_rng(4)
    rows, shared = [], []
    start = dt.date(2015, 1, 1)
    for i in range(420):
        day = start + dt.timedelta(days=i)
        shared.append((day, float(15 + 10 * ((i // 60) % 2) + rng.normal()), float(100 + rng.normal())))
    for asset, n, keep in (("calendar", 420, 1), ("gaps", 420, 2), ("short", 60, 1)):
        px = 100.0
        for i in range(n):
            px *= 1 + rng.normal(0, 0.005 * (1 + 3 * ((i // 60) % 2)))
            if i % 7 < 7 // keep:
                rows.append((asset, start + dt.timedelta(days=i), px))
    rows += [("elsewhere", dt.date(1990, 1, 1) + dt.timedelta(days=i), 100.0 + i % 5) for i in range(300)]
    prices = spark.createDataFrame(rows, "asset string, d date, px double")
    levels = spark.createDataFrame(shared, "d date, level double, credit double")
    out = generalise.generalisation(prices, levels, lambda x: materialise(x, "walk"), 80, 30, draws=60)
    got = {r.asset: r for r in out.collect()}
    assert set(got) == {"calendar", "gaps", "short", "elsewhere"}
    for asset in ("calendar", "gaps"):
        r = got[asset]
        assert r.error is None and r.n_folds == (r.n_days - 110) // 30 + 1 and r.n_calm + r.n_stressed <= r.n_folds * 30 and r.vol_stressed > 0
        assert r.ratio_oos == pytest.approx(r.vol_stressed / r.vol_calm)
    assert "days are needed" in got["short"].error and got["short"].ratio_oos is None and got["elsewhere"].n_days == 0 and got["elsewhere"].error
    (s,) = generalise.summary(out).collect()
    assert (s.n_assets, s.n_failed) == (2, 2)


def test_log_histogram_equals_numpy(spark):
    lengths = {0: [1, 1, 2, 3, 5, 8, 30, 44, 100, 365], 1: [4, 4, 4], 2: [1], 3: [7, 90]}
    rows = [("a", s, n) for s, v in lengths.items() for n in v] + [("a", 0, None), ("a", 0, 0)]
    df = spark.createDataFrame(rows, "asset string, state int, length int")
    got = {}
    for r in regimes.log_histogram(df).orderBy("state", "bin").collect():
        got.setdefault(r.state, []).append(r)
    for s, v in lengths.items():
        low, high = max(1, min(v)), max(2, max(v))
        edges = np.logspace(math.log10(low), math.log10(high), 18)
        assert len(got[s]) == 17 and sum(r.n for r in got[s]) == len(v)
        assert np.allclose([r.low for r in got[s]], edges[:-1]) and np.allclose([r.high for r in got[s]], edges[1:])
        if low < high:
            assert [r.n for r in got[s]] == np.histogram(v, bins=edges * np.where(np.arange(18) == 17, 1 + 1e-12, np.where(np.arange(18) == 0, 1 - 1e-12, 1)))[0].tolist()
    assert regimes.log_histogram(df.filter(F.lit(False))).count() == 0
    with pytest.raises(ValueError):
        regimes.log_histogram(df, 0)
