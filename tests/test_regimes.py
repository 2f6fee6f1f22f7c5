from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import hmm, placebo, regimes, series, separation

DAY0 = dt.date(2020, 1, 1)


def frame(spark, states, asset="a", **more):
    rows = [{"asset": asset, "d": DAY0 + dt.timedelta(days=i), "state": int(s)} | {k: float(v[i]) for k, v in more.items()} for i, s in enumerate(states)]
    return spark.createDataFrame(pd.DataFrame(rows))


def slow_filter(states, least):
    """The rule told row by row: find runs anew after each merge."""
    s = list(states)
    while True:
        runs, i = [], 0
        while i < len(s):
            j = i
            while j < len(s) and s[j] == s[i]:
                j += 1
            runs.append((i, j - i))
            i = j
        short = [(n, at) for at, n in runs if n < least]
        if len(runs) == 1 or not short:
            return s
        n, at = min(short)
        k = [r[0] for r in runs].index(at)
        left = runs[k - 1] if k else None
        right = runs[k + 1] if k + 1 < len(runs) else None
        take = right if left is None or (right is not None and right[1] > left[1]) else left
        s[at : at + n] = [s[take[0]]] * n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 8))
def test_merging_runs_equals_merging_rows(states, least):
    runs = [[states[0], 1]]
    for s in states[1:]:
        if s == runs[-1][0]:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    new = regimes.merge_short_runs([r[0] for r in runs], [r[1] for r in runs], least)
    assert [s for s, (_, n) in zip(new, runs) for _ in range(n)] == (slow_filter(states, least) if least > 1 else states)


def test_golden_runs(spark):
    out = regimes.persistence_filter(frame(spark, [0, 0, 1, 0, 0, 0, 1, 1, 1]), 2).orderBy("d").collect()
    assert [r.filtered for r in out] == [0] * 6 + [1] * 3
    assert [r.filtered for r in regimes.persistence_filter(frame(spark, [0, 1, 0]), 1).orderBy("d").collect()] == [0, 1, 0]


def test_transitions_skip_fold_starts(spark):
    df = frame(spark, [0] * 5 + [1] * 5 + [0] * 5, fold=[0] * 5 + [1] * 5 + [2] * 5)
    kept = regimes.extract_transitions(df, "state", fold="fold").collect()
    assert kept == []
    both = regimes.extract_transitions(df, "state", fold="fold", at_fold_starts=True).orderBy("d").collect()
    assert [(r.from_state, r.to_state, r.direction, r.dwell_before, r.dwell_after) for r in both] == [(0, 1, "calm->stressed", 5, 5), (1, 0, "stressed->calm", 5, 5)]


def test_leaders_do_not_chain(spark):
    days = [1, 3, 6, 7, 12, 13, 20]
    df = spark.createDataFrame([("a", 1, DAY0 + dt.timedelta(days=i)) for i in days], "asset string, to_state int, d date")
    out = regimes.leader_clusters(df, 5).collect()
    assert sorted({(r.leader - DAY0).days for r in out}) == [1, 7, 13, 20]


def test_stability_takes_upper_median_and_support(spark):
    rows = [("a", s, DAY0 + dt.timedelta(days=d), 1, 10 + s) for s, d in [(1, 0), (2, 2), (3, 4), (3, 40)]]
    df = spark.createDataFrame(rows, "asset string, seed int, d date, to_state int, dwell_after int")
    (r,) = regimes.stable_transitions(df, 5, 0.6, n_seeds=4).collect()
    assert (r.d - DAY0).days == 2 and r.support == 0.75 and r.n_members == 3 and r.dwell_after == 12


def test_fold_golden(spark):
    df = spark.createDataFrame([("a", i) for i in range(4164)], "asset string, i int")
    folds = series.folds(df, 756, 126).collect()
    assert len(folds) == 27 and sum(f.test_end - f.test_start for f in folds) == 3402
    fan = series.fan_out(df, 756, 126).groupBy("fold").count().collect()
    assert {r["count"] for r in fan} == {882} and len(fan) == 27
    with pytest.raises(ValueError):
        series.folds(df, 0, 126)


def test_forward_volatility_sees_only_the_future(spark):
    rng = np.random.default_rng(1)
    ret = rng.standard_normal(60)
    df = series.forward_vol(frame(spark, [0] * 60, ret=ret), rows=20).orderBy("d").collect()
    assert df[10].fvol == pytest.approx(np.std(ret[11:31], ddof=1))
    assert all(r.fvol is None for r in df[40:])


def two_regimes(n=400, seed=1):
    rng = np.random.default_rng(seed)
    s = (np.arange(n) // 50) % 2
    x = np.column_stack([rng.normal(s * 4, 1), rng.normal(s * 2, 1)])
    return x, s


def test_em_rises_and_recovers_regimes():
    x, s = two_regimes()
    model = hmm.GaussianHmm.fit(x, 2, 3)
    steps = np.diff(model.log_likelihoods)
    assert (steps > -1e-3).all()
    path = model.viterbi(x)
    agree = (path == s).mean()
    assert max(agree, 1 - agree) > 0.97


def test_filter_is_causal_and_a_distribution():
    x, _ = two_regimes()
    model = hmm.GaussianHmm.fit(x, 2, 3)
    p = model.filtered(x)
    y = x.copy()
    y[200:] += 100
    q = model.filtered(y)
    assert np.allclose(p[:200], q[:200]) and np.allclose(p.sum(1), 1)


def test_filter_matches_brute_force_over_paths():
    import itertools

    x, _ = two_regimes(40)
    model = hmm.GaussianHmm.fit(x, 2, 3)
    dens = np.exp(hmm.log_density(x[:8], model.means, model.covs))
    weight = np.zeros(2)
    for path in itertools.product(range(2), repeat=8):
        w = model.start[path[0]] * dens[0, path[0]]
        for t in range(1, 8):
            w *= model.move[path[t - 1], path[t]] * dens[t, path[t]]
        weight[path[-1]] += w
    assert np.allclose(model.filtered(x[:8])[-1], weight / weight.sum())


def test_walk_forward_records_failures(spark):
    x, s = two_regimes(300)
    df = frame(spark, s, vol=x[:, 0], mom=x[:, 1])
    out = hmm.walk_forward(df, ["vol", "mom"], "vol", train=100, test=50, seeds=[1, 2], rounds=30).toPandas()
    assert out.groupby(["seed", "fold"]).size().tolist() == [50] * 8
    truth = df.toPandas().set_index("d")["state"]
    good = out[out["seed"] == 1]
    assert (good["state"].to_numpy() == truth.loc[good["d"]].to_numpy()).mean() > 0.9
    flat = frame(spark, s, vol=np.full(300, np.nan), mom=x[:, 1])
    bad = hmm.walk_forward(flat, ["vol", "mom"], "vol", train=100, test=50, rounds=5).collect()
    assert all(r.error for r in bad)


def test_controls_keep_their_distance(spark):
    rng = random.Random(2)
    states = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=i), 0) for i in range(1500) if rng.random() < 0.7], "asset string, d date, state int")
    tr = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=i)) for i in (200, 500, 800)], "asset string, d date")
    cand = placebo.control_candidates(tr, states)
    taken = placebo.nearest_transition(placebo.sample_controls(cand), tr).collect()
    days = sorted(r.d for r in taken)
    assert all((b - a).days >= 20 for a, b in zip(days, days[1:]))
    assert all(30 <= abs(r.offset_days) <= 90 and r.days_to_nearest >= 14 for r in taken)
    assert len(taken) == 6
    again = placebo.sample_controls(cand).collect()
    assert {r.d for r in again} == set(days)
    with pytest.raises(ValueError):
        placebo.control_candidates(tr, states, window=30, low=30)


def test_bootstrap_never_draws_the_last_row(spark):
    n = 100
    df = frame(spark, [i % 2 for i in range(n)], ret=[0.001 * (i % 7) for i in range(n - 1)] + [1000.0])
    ratios = [r.ratio for r in separation.block_bootstrap(df, draws=50).collect()]
    assert len(ratios) == 50 and max(ratios) < 10
