"""Queries and operators that SQL can't express, against plain Python; stores, manifests and prompts as files."""

from __future__ import annotations

import datetime as dt
import hashlib
import itertools
import math
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_regimes import slow_filter
from tidemark.functions import text as T
from tidemark.operators import bm25, ceiling, hmm, inference, placebo, regimes, windows
from tidemark.plans import bindings, catalogue, evidence, series_queries
from tidemark.sources import inputs, store, timed


@pytest.fixture(scope="module")
def states(spark, sf):
    """asset -> [(day, state)] in order."""
    out = {}
    for r in bindings.states(spark, sf).select("asset", "d", "state").orderBy("asset", "d").collect():
        out.setdefault(r.asset, []).append((r.d, r.state))
    return out


def runs_of(values):
    return [(k, len(list(g))) for k, g in itertools.groupby(values)]


def run(spark, sf, name):
    return catalogue.queries()[name](spark, sf).collect()


def test_persistence_filter_query(spark, sf, states):
    got = {(r.asset, r.d): r.filtered for r in run(spark, sf, "persistence_filter")}
    want = {(a, d.isoformat()): s for a, rows in states.items() for (d, _), s in zip(rows, slow_filter([s for _, s in rows], 10))}
    assert got == want and want


def test_persistent_transitions_query(spark, sf, states):
    want = set()
    for a, rows in states.items():
        at, before = 0, None
        for s, n in runs_of(slow_filter([s for _, s in rows], 10)):
            if before:
                want.add((a, rows[at][0].isoformat(), before[0], s, "calm->stressed" if s == 1 else "stressed->calm", before[1], n))
            at, before = at + n, (s, n)
    got = {tuple(r) for r in run(spark, sf, "persistent_transitions")}
    assert got == want and want


def test_dwell_sensitivity_query(spark, sf, states):
    want = {}
    for a, rows in states.items():
        for least in (1, 5, 10, 20):
            runs = runs_of(slow_filter([s for _, s in rows], least))
            lengths = [n for _, n in runs]
            want[a, least] = (len(runs) - 1, sum(s == 1 for s, _ in runs[1:]), sum(s == 0 for s, _ in runs[1:]), statistics.median(lengths), statistics.mean(lengths), max(lengths))
    got = {(r.asset, r.min_dwell): (r.n_transitions, r.n_to_stressed, r.n_to_calm, r.median_dwell, r.mean_dwell, r.max_dwell) for r in run(spark, sf, "dwell_sensitivity")}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_merging_many_runs_takes_no_square_time():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 6, 60_000).tolist()
    out = regimes.merge_short_runs([k % 2 for k in range(len(lengths))], lengths, 40)
    merged = [sum(n for _, n in g) for _, g in itertools.groupby(zip(out, lengths), key=lambda x: x[0])]
    assert len(out) == len(lengths) and (len(merged) == 1 or min(merged) >= 40)


def greedy(candidates, per, apart, seed=7):
    """(asset, matched_to, day) taken, in the order of transitions and of the hash."""
    taken, counts, out = {}, {}, set()
    digest = lambda a, m, d: hashlib.sha256(f"{seed}:{a}:{m}:{d}".encode()).hexdigest()
    for a, m, d in sorted(candidates, key=lambda x: (x[0], x[1], digest(*x))):
        if counts.get((a, m), 0) < per and all(abs((d - t).days) >= apart for t in taken.get(a, [])):
            taken.setdefault(a, []).append(d)
            counts[a, m] = counts.get((a, m), 0) + 1
            out.add((a, m.isoformat(), d.isoformat()))
    return out


def test_placebo_queries(spark, sf, states):
    tr = {}
    for r in series_queries._transitions(spark, sf).collect():
        tr.setdefault(r.asset, []).append(r.d)
    day = dt.timedelta(days=1)
    clear = lambda a, d: all(abs((d - t).days) >= 14 for t in tr[a])
    observed = {a: {d for d, _ in rows} for a, rows in states.items()}
    every = [(a, m, m + k * day) for a, ms in tr.items() for m in ms for k in [*range(-90, -29), *range(30, 91)]]
    bare = [c for c in every if clear(c[0], c[2])]
    with_states = [c for c in bare if c[2] in observed[c[0]]]
    got = run(spark, sf, "placebo_greedy")
    assert {(r.asset, r.matched_to, r.d) for r in got} == greedy(with_states, 2, 20) and got
    state = {(a, d.isoformat()): s for a, rows in states.items() for d, s in rows}
    for r in got:
        near = min(abs((dt.date.fromisoformat(r.d) - t).days) for t in tr[r.asset])
        assert (r.state, r.days_to_nearest) == (state[r.asset, r.d], near)
        assert r.stratum == ("clean" if r.state == 0 and near >= 30 else "contaminated")
    assert {(r.asset, r.matched_to, r.d) for r in run(spark, sf, "bare_date_controls")} == greedy(bare, 2, 20)
    balance = {r.asset: r for r in run(spark, sf, "placebo_balance")}
    for a, ms in tr.items():
        own = [r for r in got if r.asset == a]
        assert (balance[a].n_transitions, balance[a].n_controls) == (len(ms), len(own))
        assert balance[a].n_uncovered == len({m.isoformat() for m in ms} - {r.matched_to for r in own})
        assert balance[a].n_clean == sum(r.stratum == "clean" for r in own)
    pairs = {(r.asset, r.d): r for r in run(spark, sf, "matched_pairs")}
    assert len(pairs) == sum(map(len, tr.values()))
    for (a, m), r in pairs.items():
        own = sorted(x.d for x in got if (x.asset, x.matched_to) == (a, m))
        assert (r.n_controls, r.first_control) == (len(own), own[0] if own else None)


def test_bare_candidates_keep_to_a_universe(spark):
    dates = spark.createDataFrame([("a", dt.date(2020, 6, 1))], "asset string, d date")
    days = spark.createDataFrame([("a", dt.date(2020, 7, 10)), ("a", dt.date(2020, 6, 5)), ("b", dt.date(2020, 7, 11))], "asset string, d date")
    assert [(r.d, r.offset_days) for r in placebo.bare_candidates(dates, days).collect()] == [(dt.date(2020, 7, 10), 39)]
    assert placebo.bare_candidates(dates).count() == 2 * 61


def test_input_column_inference_query(spark, sf):
    want = {r.d for r in spark.read.parquet(f"{sf}/orders.parquet").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).collect()}
    got = [r.d for r in run(spark, sf, "input_column_inference")]
    assert set(got) == want and len(got) == len(want)


def test_log_density_of_any_covariance():
    rng = np.random.default_rng(5)
    x, means = rng.standard_normal((50, 3)), rng.standard_normal((2, 3))
    a = rng.standard_normal((3, 3))
    cov = a @ a.T + np.eye(3)
    got = hmm.log_density(x, means, np.stack([cov, np.diag([1.0, 4.0, 0.25])]))
    r = x - means[0]
    want = -0.5 * (np.einsum("ij,jk,ik->i", r, np.linalg.inv(cov), r) + np.log(np.linalg.det(2 * np.pi * cov)))
    assert np.allclose(got[:, 0], want, atol=1e-6)
    flat = hmm.log_density(x, means[:1], np.ones((1, 3, 3)))
    assert np.isfinite(flat).all()
    with pytest.raises(np.linalg.LinAlgError):
        hmm.log_density(x, means[:1], -100.0 * np.eye(3)[None])


def test_hmm_queries(spark, sf):
    """A fit to a whole series: likelihoods rise, and the path is labelled by the level; walk-forward states follow their probabilities."""
    rows = bindings.features(spark, sf).na.drop(subset=["vol", "mom"]).orderBy("asset", "d").toPandas()
    got = {(r.asset, r.d): r.state for r in run(spark, sf, "hmm_in_sample")}
    assert len(got) == len(rows)
    for asset, part in rows.groupby("asset"):
        x = part[["vol", "mom"]].to_numpy(float)
        model = hmm.GaussianHmm.fit((x - x.mean(0)) / x.std(0), 2, 42, series_queries.ROUNDS)
        assert all(b > a - 1e-2 for a, b in zip(model.log_likelihoods, model.log_likelihoods[1:]))
        mine = np.array([got[asset, d.isoformat()] for d in part["d"]])
        if 0 < mine.sum() < len(mine):
            assert part["vol"][mine == 1].mean() > part["vol"][mine == 0].mean()
    walk = run(spark, sf, "hmm_walk_forward")
    assert walk and all(r.error is not None or (0 <= r.stressed_prob <= 1 and r.state == (r.stressed_prob >= 0.5)) for r in walk)
    assert len({(r.asset, r.seed, r.d) for r in walk if r.d}) == sum(r.d is not None for r in walk)


def plain_bm25(queries, docs):
    """Rank of each query's own document, of all documents by score and then id."""
    n, lens = len(docs), {d: len(t) for d, t in docs.items()}
    mean = sum(lens.values()) / n
    out = {}
    for q, terms in queries.items():
        score = {}
        for d, held in docs.items():
            s = 0.0
            for w in terms:
                tf, df = held.count(w), sum(w in t for t in docs.values())
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * lens[d] / mean)) if tf else 0
            score[d] = round(s, 9)
        order = sorted(docs, key=lambda d: (-score[d], d))
        if q in docs:
            out[q] = (order.index(q) + 1, n)
    return out


def test_match_arm_equals_whole_texts(spark):
    """Texts of a window's items are ranked as if they were put together, without being one row."""
    vocabulary = ["market", "crude", "harvest", "strike", "vote", "flood", "bank", "metal"]
    rng = np.random.default_rng(2)
    day = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(6)]
    rows = [(b, f"i{k}", "holdout" if k % 2 else "generation", " ".join(rng.choice(vocabulary[j % 4 :], 9))) for j, b in enumerate(day) for k in range(6)]
    windowed = spark.createDataFrame(rows, "boundary date, item_id string, role string, text string")
    told = [(b, " ".join(rng.choice(vocabulary[j % 4 :], 7))) for j, b in enumerate(day)] + [(dt.date(2020, 1, 1), "market")]
    got = {r.query_id: (r.rank, r.n_candidates) for r in evidence.match_arm(spark.createDataFrame(told, "boundary date, explanation string"), windowed).collect()}
    words = lambda t: [w for w in t.split() if w not in T.STOP_WORDS]
    docs = {b.isoformat(): words(" ".join(t for d, _, role, t in rows if d == b and role == "holdout")) for b in day}
    assert got == plain_bm25({b.isoformat(): words(t) for b, t in told if b in day}, docs)


def test_evidence_query_counts_add_up(spark, sf):
    got = run(spark, sf, "evidence_e2e")
    assert got and all(r.n_holdout == max(1, round(r.n_items / 2)) for r in got)
    assert {r.n_candidates for r in got if r["rank"]} == {sum(r["rank"] is not None for r in got)}
    assert all(1 <= r["rank"] <= r.n_candidates for r in got if r["rank"])


def test_evidence_query_equals_plain_python(spark, tmp_path, monkeypatch):
    """Ranks, sizes and audits, with ids that repeat or are missing and texts that are null or blank; no table of windows holds a text, and what is counted of a text doesn't depend on how many windows hold it."""
    rng = np.random.default_rng(5)
    vocabulary = [f"word{chr(97 + k)}{chr(97 + j)}" for k in range(6) for j in range(10)]
    docs = [(k, "en" if k % 3 else "business", ". ".join(" ".join(rng.choice(vocabulary[k % 30 : k % 30 + 25], 6)) for _ in range(5))) for k in range(240)]
    docs = [(k, s, None if k % 50 == 7 else " \n\t" if k % 50 == 8 else t) for k, s, t in docs]
    docs[3] = (3, None, "the of and")
    more = [(None, "en", "worda wordb"), (5, "zz", "last of all"), (6, None, vocabulary[2]), (6, None, vocabulary[1]), (40, "business", "aaa bbb"), (40, "business", "aaa bbb")]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(docs + more, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/sf/documents.parquet")
    written, write, counted, count = {}, evidence.materialise, [], bm25.count_terms
    monkeypatch.setattr(evidence, "materialise", lambda df, name: written.setdefault(name, write(df, name)))
    monkeypatch.setattr(bm25, "count_terms", lambda *a: counted.append(count(*a)) or counted[-1])
    got = {r.boundary: r for r in run(spark, str(tmp_path / "sf"), "evidence_e2e")}
    # Of rows that share an id the least counts, null first.
    order = lambda r: (r[1] is not None, r[1] or "", r[2] is not None, r[2] or "")
    one = {}
    for r in docs + more:
        if r[0] is not None and (r[0] not in one or order(r) < order(one[r[0]])):
            one[r[0]] = r
    day = lambda k: dt.date(2024, 1, 1 + k)
    words = lambda t: [w for w in re.findall(r"[a-z][a-z0-9\-']+", (t or "").lower()) if len(w) > 2 and w not in T.STOP_WORDS]
    asked, held, sizes = {}, {}, {}
    for b in range(30):
        ids = sorted((k for k in one if b - 2 <= k % 30 <= b), key=lambda k: (hashlib.sha256(f"7:{k}".encode()).hexdigest(), k))
        keep = max(1, round(len(ids) / 2))
        first = one[min(ids[keep:], key=lambda k: (k % 30, k))]
        sizes[day(b).isoformat()] = (len(ids), keep)
        told = " ".join(["" if first[2] is None else first[2], "", ".".join((first[2] or "").split(".")[:2])])
        held[day(b).isoformat()] = [w for k in ids[:keep] for w in words(one[k][2])]
        if told.strip(" \n\t"):
            asked[day(b).isoformat()] = words(told)
    ranks = plain_bm25(asked, {b: held[b] for b in asked})
    assert {b: (r.n_items, r.n_holdout) for b, r in got.items()} == sizes
    assert {b: (r["rank"], r.n_candidates) for b, r in got.items() if r["rank"] is not None} == ranks and len(ranks) < 30
    assert all(r.grounded_rate == 1 for b, r in got.items() if asked.get(b)) and {r.n_claims for r in got.values()} == {1}
    assert "text" not in written["windows"].columns
    assert len(counted) == 1 and counted[0].agg(F.sum("tf")).first()[0] == sum(len(words(one[k][2])) for k in {k for b in range(30) for k in sorted((k for k in one if b - 2 <= k % 30 <= b), key=lambda k: hashlib.sha256(f"7:{k}".encode()).hexdigest())[: sizes[day(b).isoformat()][1]]})


@pytest.mark.parametrize("bound", [0, 500_000])
def test_match_arms_with_texts_apart(spark, monkeypatch, bound):
    """The same ranks, whether texts are in the windows or apart, and whether what is asked is broadcast or not."""
    rng = np.random.default_rng(3)
    items = {f"i{k}": (" ".join(rng.choice(["crude", "harvest", "strike", "vote", "flood", "bank", "metal", "river"][k % 4 :], 8)) if k % 9 else " ", f"title{chr(97 + k % 5)}" if k % 2 else None) for k in range(40)}
    rows = [(dt.date(2024, 1, 1 + b), "transition" if b % 2 else "control", f"i{k}", "holdout" if k % 3 else "generation", "Business" if k % 5 else "Sport") for b in range(8) for k in range(b * 4, min(b * 4 + 12, 40))]
    windowed = spark.createDataFrame(rows, "boundary date, kind string, item_id string, role string, section string")
    texts = spark.createDataFrame([(k, *v) for k, v in items.items()], "item_id string, text string, title string")
    told = spark.createDataFrame([(dt.date(2024, 1, 1 + b), " ".join(rng.choice(["crude", "harvest", "vote", "bank", "titlea"], 4)) if b != 4 else "May 2024") for b in range(9)], "boundary date, explanation string")
    monkeypatch.setattr(bm25, "BROADCAST", bound)
    with_texts, apart = (
        sorted((r.arm, r.query_id, r.n_candidates, r["rank"], r.predicted, round(r.score, 6)) for r in evidence.match_arms(told, w, evidence.standard_arms(), texts=t).collect())
        for w, t in ((windowed.join(texts, "item_id"), None), (windowed, texts))
    )
    assert with_texts == apart and len({r[0] for r in apart}) == 3 and {r[1] for r in apart if r[0] == "all_windows"} == {f"2024-01-0{b}" for b in (1, 2, 3, 4, 6, 7, 8)}


def test_proxy_slices_are_words_in_a_row(spark):
    rows = [(b, f"i{k}", k, " ".join(f"w{b}x{k}y{j}" for j in range(7))) for b in range(3) for k in range(5)]
    df = spark.createDataFrame(rows, "boundary int, item_id string, published int, text string")
    for r in ceiling.proxy_terms(df, 12).collect():
        whole = [w for b, _, _, t in rows if b == r.boundary for w in t.split()]
        at = whole.index(r.terms[0])
        assert r.terms == whole[at : at + 12]
    assert {len(r.terms) for r in ceiling.proxy_terms(df, 900).collect()} == {35}
    assert {len(r.terms) for r in ceiling.proxy_terms(df, None).collect()} == {7}


def test_ranked_equals_one_sort(spark):
    rows = [(k % 3, f"i{k:03d}", dt.datetime(2024, 1, 1 + k % 5, k % 24, k % 60)) for k in range(200)] + [(None, "x", dt.datetime(2024, 1, 1)), (2, "late", None)]
    df = spark.createDataFrame(rows, "boundary int, item_id string, published timestamp")
    got = {(r.boundary, r.item_id): (r._i, r._n) for r in windows.ranked(df, F.date_trunc("minute", "published"), ["published", "item_id"]).collect()}
    for b in (0, 1, 2, None):
        own = sorted((t is not None, t, i) for x, i, t in rows if x == b)
        assert [got[b, i] for *_, i in own] == [(k, len(own)) for k in range(len(own))]


def test_wilcoxon_p_counts_all_signs(spark):
    values = [0.5, -0.2, 0.9, 0.9, -1.4, 2.0, 0.0]
    df = spark.createDataFrame([("a", v) for v in values], "asset string, v double")
    r = inference.wilcoxon(df, "v", ["asset"]).first()
    x = [v for v in values if v]
    ranks = [statistics.mean([k + 1 for k, a in enumerate(sorted(map(abs, x))) if a == abs(v)]) for v in x]
    plus = sum(k for k, v in zip(ranks, x) if v > 0)
    low = min(plus, sum(ranks) - plus)
    ways = [sum(k for k, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=len(x))]
    assert (r.n, r.w_plus) == (6, plus) and r.p == pytest.approx(min(1, 2 * sum(w <= low for w in ways) / len(ways)))


def test_agreement_and_told_on(spark):
    one = spark.createDataFrame([(1, True, None), (2, False, True), (3, True, True), (9, True, True)], "window_id int, driver boolean, confident boolean")
    two = spark.createDataFrame([(1, True, True), (2, True, True), (3, True, False), (8, True, True)], "window_id int, driver boolean, confident boolean")
    got = {r.flag: (r.n, r.n_agree) for r in inference.agreement(one, two, ["driver", "confident"]).collect()}
    assert got == {"driver": (3, 2), "confident": (2, 1)}
    days = spark.createDataFrame([(dt.date(2020, 1, 1), 5), (dt.date(2020, 1, 2), 6)], "d date, px int")
    told = spark.createDataFrame([(dt.date(2020, 1, 2), "b", "late", True), (dt.date(2020, 1, 2), "a", "first", False)], "boundary date, window_id string, summary string, is_confident boolean")
    rows = {r.d.day: r for r in inference.told_on(days, told).collect()}
    assert (rows[1].told, rows[1].summary, rows[1].px) == (False, None, 5) and (rows[2].told, rows[2].summary, rows[2].window_id) == (True, "first", "a")


def test_runs_can_be_deleted(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = [(dt.datetime(2024, 1, k, 12), f"Run {k}", "m", {"a": "b"}, {"x": 1.0}) for k in (1, 2, 3)]
    store.save_runs(spark.createDataFrame(rows, "saved_at timestamp, label string, model string, config map<string,string>, summary map<string,double>"), path)
    ids = [r.run_id for r in store.list_runs(spark, path).collect()]
    assert store.delete_run(spark, path, ids[1]) and not store.delete_run(spark, path, "none")
    assert [r.run_id for r in store.list_runs(spark, path).collect()] == [ids[0], ids[2]]


def test_manifest_states_and_prompt(spark, tmp_path):
    px = spark.createDataFrame([(dt.date(2024, 1, k), 1.0) for k in (1, 2, 5)], "d date, px double")
    path = str(tmp_path / "manifest")
    store.record_manifest(px.limit(1), "daily", path)
    store.record_manifest(px, "daily", path)
    (r,) = store.read_manifest(spark, path).collect()
    assert (r.dataset, r.n_rows, r.actual_start, r.actual_end) == ("daily", 3, dt.date(2024, 1, 1), dt.date(2024, 1, 5))
    states = px.select(F.lit("a").alias("asset"), "d", F.lit(1).alias("state"))
    for kind in ("parquet", "csv"):
        store.save_states(states, str(tmp_path / kind), kind)
        back = spark.read.option("header", True).format(kind).load(str(tmp_path / kind))
        assert back.count() == 3 and set(back.columns) == {"asset", "d", "state"}
    prompt = tmp_path / "prompt.md"
    prompt.write_text("---\nversion: 2\n---\nSay why.\n")
    (r,) = store.load_prompt(spark, str(prompt)).collect()
    assert r.prompt == "Say why." and r.sha16 == hashlib.sha256(prompt.read_bytes()).hexdigest()[:16]
    with pytest.raises(FileNotFoundError):
        store.load_prompt(spark, str(tmp_path / "none.md"))


def test_scores_of_documents_in_several_rows(spark):
    docs = [(1, ["a", "b", "a"]), (2, ["c"]), (3, [])]
    apart = [(1, ["a"]), (1, ["b", "a"]), (1, []), (2, ["c"]), (3, [])]
    asked = spark.createDataFrame([(7, ["a", "c", "zz"]), (8, ["b"])], "query_id int, terms array<string>")
    kind = "doc_id int, terms array<string>"
    one, two = ({(r.query_id, r.doc_id): r.score for r in bm25.scores(asked, spark.createDataFrame(d, kind)).collect()} for d in (docs, apart))
    assert one.keys() == two.keys() == {(7, 1), (7, 2), (8, 1)} and all(one[k] == pytest.approx(two[k]) for k in one)


def test_timed_rows_and_pasted_days(spark):
    text = "# t\n| **0:00\u20130:10** | a | one two *three* |\n| **0:12-0:20** | 3 seconds of silence | `x` \u2026 y |\n| not timed | a | b |\n| **0:20-0:21** | c | four | five six |"
    df = spark.createDataFrame([(1, text), (2, "none")], "script_id int, text string")
    rows = timed.timed_rows(df)
    got = [(r.start, r.end, r.words, r.seconds, r.gap, r.too_fast) for r in rows.orderBy("pos").collect()]
    assert got == [(0, 10, 3, 10, False, False), (12, 20, 2, 5, True, False), (20, 21, 4, 1, False, True)]
    (r,) = timed.script_summary(rows).collect()
    assert (r.n_rows, r.runtime, r.n_gaps, r.n_too_fast, r.ok) == (3, 21, 1, 1, False)
    days = inputs.pasted_days(spark, "2020-03-03, 3/4/2020;5 March 2020\nno day\t2020-03-03")
    assert {r.d for r in days.collect()} == {dt.date(2020, 3, 3), dt.date(2020, 3, 4), dt.date(2020, 3, 5)}
