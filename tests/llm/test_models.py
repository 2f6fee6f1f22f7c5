"""Scoring, search, classification and mixing: brute force, held-out accuracy, and odd rows."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import ann, langid, licenses, lm_scoring, mixing, quality_rules, queries, url_filter


def slow_lm(rows, prior, smooth):
    """(loss_target, loss_background) of each row (words, marked), token by token, the token itself left out of the counts."""
    models = []
    for part in (rows, [r for r in rows if r[1]]):
        words, pairs = Counter(), Counter()
        for t, _ in part:
            if t:
                words.update([*t, None])
                pairs.update(zip(["<s>", *t], [*t, None]))
        words["<s>"] = words[None]
        models.append((words, pairs, sum(n for w, n in words.items() if w != "<s>")))
    vocabulary = max(1, len(models[0][0]) - 1)
    out = []
    for t, marked in rows:
        loss = [0.0, 0.0]
        for v, w in zip(["<s>", *t], [*t, None]) if t else ():
            for k, (words, pairs, total) in enumerate(models):
                less = 1 if k == 0 or marked else 0
                p = (words[w] - less + smooth) / (total - less + smooth * vocabulary)
                loss[k] -= math.log((pairs[v, w] - less + prior * p) / (words[v] - less + prior))
        out.append((loss[1] / (len(t) + 1), loss[0] / (len(t) + 1)) if t else (None, None))
    return out


def check_lm(spark, docs, **options):
    got = {(r.doc_id, r.n_tokens): r for r in lm_scoring.lm_score(docs, "is_target", prior=5.0, **options).collect()}
    rows = [(r.doc_id, (r.text or "").lower().split(), bool(r.is_target)) for r in docs.collect()]
    for (doc, t, _), (target, background) in zip(rows, slow_lm([r[1:] for r in rows], 5.0, 0.1)):
        r = got[doc, len(t)]
        if target is None:
            assert r.score is None and r.loss_target is None and r.loss_background is None
            continue
        assert r.loss_background == pytest.approx(background, abs=1e-4)
        assert r.loss_target == pytest.approx(target, abs=1e-4)
        assert r.score == pytest.approx(r.loss_target - r.loss_background, abs=1e-9)


def test_lm_score_matches_brute_force(spark):
    shared = [(200 + i, " ".join(["the of"] * (i % 3) + [cases.words(9, i % 4), "the", cases.words(4, i)]), "en", "s", 1, "x", "y", "z", "w", 3) for i in range(20)]
    docs = cases.documents(spark, 12, extra=shared).withColumn("is_target", F.expr("CASE WHEN doc_id IS NULL THEN NULL ELSE doc_id % 2 = 0 END"))
    check_lm(spark, docs)
    check_lm(spark, docs, hot=0.5, part_events=500, chunk_rows=4, chunk_events=50)
    check_lm(spark, docs, hot=1e-4, part_events=10_000, chunk_rows=3)


def test_a_thousand_tied_words_are_all_in_the_vocabulary(spark):
    rows = [(i, " ".join(f"word{j}" for j in range(40 * i, 40 * i + 40)), i % 2 == 0) for i in range(25)]
    check_lm(spark, spark.createDataFrame(rows, "doc_id long, text string, is_target boolean"), part_events=300)


def test_lm_score_of_an_empty_table_and_without_target(spark):
    assert lm_scoring.lm_score(cases.empty(spark).withColumn("m", F.lit(True)), "m").collect() == []
    got = lm_scoring.lm_score(cases.documents(spark, 4).withColumn("m", F.lit(False)), "m").collect()
    assert all(r.score is None or math.isfinite(r.score) for r in got) and len(got) == 13


def test_mark_target_keeps_rows(spark):
    docs = cases.documents(spark)
    got = lm_scoring.mark_target(docs, cases.labels(spark), "m").collect()
    assert len(got) == docs.count() and {r.doc_id for r in got if r.m} == {i for i in range(30) if i % 4} | {100}
    clash = docs.withColumn("target_id", F.lit(1)).withColumn("_target_id", F.lit(2))
    assert lm_scoring.mark_target(clash, cases.labels(spark), "m").columns == [*clash.columns, "m"]
    least, lm_scoring.BROADCAST = lm_scoring.BROADCAST, 0
    try:
        joined = lm_scoring.mark_target(clash, cases.labels(spark), "m").collect()
    finally:
        lm_scoring.BROADCAST = least
    assert cases.key(joined, "doc_id", "m") == cases.key(got, "doc_id", "m")


def slow_search(rows, k, every):
    """(query id, rank, id, score) of rows (id, vector), each row for itself."""
    fine = []
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v) or len(v) != 7:
            continue
        fine.append((i, [float(x) for x in v]))
    out = []
    for at, (q, x) in enumerate(fine):
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, v)), i) for m, (i, v) in enumerate(fine) if m != at)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(7).astype(np.float32)]) for i in range(300)]
    rows += [(1000 + i, rows[20][1]) for i in range(60)] + [(20, rows[20][1]), (40, rows[41][1])]
    rows += [(None, rows[0][1]), (500, None), (501, [0.0] * 7), (502, [1.0, None] + [0.0] * 5), (503, [float("nan")] + [1.0] * 6), (504, [float("inf")] + [1.0] * 6), (505, []), (506, [1.0] * 3)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, id string")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(table, k=5, every=20, code_block=64, query_block=10).collect()]
    want = slow_search(rows, 5, 20)
    assert [g[:3] for g in sorted(got)] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in sorted(got)], [w[3] for w in want], atol=1e-12)


@pytest.mark.parametrize("kind", ["small", "large", "unequal norms", "near copies", "clusters"])
def test_scan_prunes_and_keeps_the_nearest(kind):
    """Blocks far larger than what is scored again: the 20 nearest of 20,000 stay among 64."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((20_000, 64))
    if kind in ("small", "large"):
        x *= 1e-9 if kind == "small" else 1e6
    elif kind == "unequal norms":
        x *= np.exp(2 * rng.standard_normal((len(x), 1)))
    elif kind == "near copies":
        x[:7000] = x[0] + 1e-4 * x[:7000]
    else:
        x += 3 * rng.standard_normal((50, 64))[rng.integers(0, 50, len(x))]
    x = x.astype(np.float32).astype(float)
    u, norm = ann.directions(x)
    q = ann.train(u[::5], rounds=4)
    code = q.pack(np.concatenate([q.encode(u[i : i + 4096]) for i in range(0, len(u), 4096)]))
    cs = pd.DataFrame({"row": np.arange(len(x)), "id": np.arange(len(x)), "norm": norm, "code": [r.tobytes() for r in code], "copy": [r.tobytes() for r in u.astype(np.float32)]})
    at = np.arange(0, 7000, 350)
    got = ann.scan_block(q, pd.DataFrame({"row": at, "v": list(x[at])}), cs, 64)
    assert got.groupby("query").size().max() == 64
    hits = 0
    for i in at:
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(set(np.lexsort((np.arange(len(x)), -s))[:20]) & set(got["row"][got["query"] == i]))
    assert hits / (20 * len(at)) > 0.97


def test_search_recall_on_the_supplied_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.toPandas().sort_values("vec_id")
    x, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    got = ann.search(table).toPandas().groupby("query_id")["vec_id"].apply(set)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        hits, total = hits + len(best & got[ids[i]]), total + 20
    assert hits / total >= 0.9


def test_search_of_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], kind)).collect() == []
    assert ann.search(spark.createDataFrame([(1, [1.0, 2.0])], kind)).collect() == []
    got = ann.search(spark.createDataFrame([(0, [1.0, 2.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0])], kind)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 2, 1.0), (0, 2, 3, 1.0)]
    same = ann.search(spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0])], kind)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in same) == [(0, 1, 0, 1.0), (0, 1, 1, 2.0), (0, 2, 0, 1.0), (0, 2, 1, 0.0)]


def test_anisotropic_codes_have_less_parallel_error():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = ann.train(x, threshold=0.6)

    def parallel(weight):
        code = ann.Quantiser(q.centres, weight, 16).encode(x)
        r = q.pad(x) - q.centres[np.arange(8)[None], code]
        return (((r.reshape(len(x), -1)) * x).sum(1) ** 2).mean()

    assert q.weight > 1 and parallel(q.weight) < parallel(1.0)


def test_quality_is_learnt_and_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = queries.op5_quality(spark, d).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_quality_of_odd_rows_and_without_labels(spark):
    docs = cases.documents(spark)
    got = quality_rules.classify(docs, cases.labels(spark)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    none = quality_rules.classify(docs, cases.empty(spark, cases.LABELS)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_rules.classify(cases.empty(spark), cases.labels(spark)).collect() == []
    assert quality_rules.good_only(docs, cases.labels(spark)).columns == docs.columns


def test_rules_as_columns_equal_rules_in_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.6)).astype(float)
    model = quality_rules.fit_rules(x, y, ["a", "b", "c"])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = np.array([r.s for r in df.select(model.score().alias("s")).collect()])
    total = np.full(len(x), model.intercept)
    for r in model.rules:
        total += r.weight * np.all([x[:, "abc".index(n)] <= v if up else x[:, "abc".index(n)] > v for n, up, v in r.bounds], axis=0)
    assert np.allclose(got, 1 / (1 + np.exp(-total)))
    assert ((got > 0.5) == (y > 0.5)).mean() > 0.97


def test_language_is_learnt_and_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op9_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_language_of_odd_rows(spark):
    docs = cases.documents(spark, extra=[(300, "12 !? 3", "en", "s", 0, "x", "y", "z", "w", 1)])
    got = {r.doc_id: r for r in langid.identify(docs, width=1 << 10).collect() if r.doc_id is not None}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 102, 300))
    assert got[104].lang_pred in ("en", "de", "fr")
    assert langid.identify(cases.empty(spark)).collect() == []
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(bare).collect()} == {"und"}


def test_weights_equal_kernels_times_landmark_weights():
    """The folded matrix gives the decision values of ridge regression on the kernel with the landmarks, from plain sets of n-grams."""
    texts = [cases.words(30, i) + (" the cat" if i % 3 == 0 else " die katze" if i % 3 == 1 else " le chat") for i in range(45)]
    langs = np.array([["en", "de", "fr"][i % 3] for i in range(45)], dtype=object)
    present = langid.grams(texts, 1 << 10, 3)
    model = langid.fit(present, langs, 3, landmarks=12, ridge=1e-2)
    sets = [set(np.flatnonzero(r)) for r in present]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    marks = [next(i for i in range(45) if i // 3 == k // 3 and i % 3 == j) for k in range(0, 12, 3) for j in (1, 0, 2)]
    marks = sorted(marks, key=lambda i: (i // 3, i))
    k = np.array([[kernel(a, sets[m]) for m in marks] for a in sets])
    zz = np.array([[kernel(sets[a], sets[m]) for m in marks] for a in marks])
    y = np.where(langs[:, None] == np.array(["de", "en", "fr"])[None, :], 1.0, -1.0)
    alpha = np.linalg.solve(k.T @ k + 1e-2 * len(texts) * zz + 1e-8 * np.eye(12), k.T @ y)
    assert np.allclose(model.decide(present), k @ alpha, atol=1e-4)


def test_language_sample_of_hot_and_null_ids(spark):
    """Rows that share an id, or have none, are sampled like any other; so are rows that repeat."""
    rows = [(7 if i % 2 else None, f"{cases.words(12, i)} {'the' if i % 4 < 2 else 'der'}", "en" if i % 4 < 2 else "de") for i in range(400)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, lang string")
    seen = []
    fit = langid.fit
    langid.fit = lambda present, langs, *a: seen.append(Counter(langs)) or fit(present, langs, *a)
    try:
        langid.train(docs, per_language=60, width=1 << 10)
        langid.train(docs, per_language=1000, width=1 << 10)
        langid.train(docs, per_language=60, width=1 << 10, languages=1)
    finally:
        langid.fit = fit
    assert seen == [{"en": 60, "de": 60}, {"en": 200, "de": 200}, {"en": 60}]


def test_grams_are_presence_of_orders_one_to_three():
    one, two = langid.grams(["abc", "abcabcabc"], 1 << 12, 3)
    assert one.sum() == 6 and two.sum() == 9 and (one <= two).all()
    assert langid.grams(["", "A"], 64, 3).sum(axis=1).tolist() == [0, 1]


def test_mixing_meets_targets(spark):
    d = "/root/testdata/sf0.01"
    docs, marked = spark.read.parquet(f"{d}/documents.parquet"), mixing.domain_of(spark.read.parquet(f"{d}/labels.parquet"))
    got = mixing.mix(docs, marked, {"good": 0.9, "low": 0.06, "toxic": 0.04}).toPandas()
    names = ["p_good", "p_low", "p_toxic"]
    assert np.allclose(got[names].sum(axis=1), 1) and (got["rate"] >= 0).all()
    totals = {n: (got[n] * got["n_tokens"] * got["rate"]).sum() for n in names}
    assert totals["p_low"] / totals["p_good"] == pytest.approx(0.06 / 0.9, rel=5e-4)
    assert totals["p_toxic"] / totals["p_good"] == pytest.approx(0.04 / 0.9, rel=5e-4)
    assert totals["p_good"] == pytest.approx((got["p_good"] * got["n_tokens"]).sum(), rel=5e-4)


def slow_rates(p, n, goal, rounds):
    """Plain projected gradient on the same objective, far beyond what the operator takes; the objective reached."""
    b = p / np.sqrt(goal)
    step = 1 / np.linalg.eigvalsh((b * n[:, None]).T @ b).max()
    r = np.ones(len(n))
    for _ in range(rounds):
        r = np.maximum(0, r - step * (b @ ((n * r) @ b - np.sqrt(goal))))
    return (((n * r) @ b - np.sqrt(goal)) ** 2).sum() / 2


def rates_of(spark, p, n, goal, **options):
    rows = [(i, int(k), *map(float, r)) for i, (k, r) in enumerate(zip(n, p))]
    names = [f"p{j}" for j in range(p.shape[1])]
    table = spark.createDataFrame(rows, "i long, n long, " + ", ".join(f"{c} double" for c in names))
    out, fit = mixing.fit_rates(table, "n", names, list(goal), **options)
    return out.toPandas().sort_values("i")["rate"].to_numpy(), fit


def test_rates_meet_feasible_targets(spark):
    rng = np.random.default_rng(2)
    p, n = rng.dirichlet([1, 1, 1], 200), rng.integers(1, 50, 200)
    goal = (p * n[:, None]).sum(0) * [1.0, 0.3, 1.5]
    rate, fit = rates_of(spark, p, n, goal)
    assert (rate >= 0).all() and fit.converged and fit.rounds < 60
    assert np.allclose((n * rate) @ p, goal, rtol=1e-4) and np.allclose(fit.totals, (n * rate) @ p)
    assert slow_rates(p, n, goal, 20_000) < 1e-6


def test_rates_of_infeasible_targets_are_least_squares(spark):
    rng = np.random.default_rng(3)
    share = rng.choice([0.35, 0.5, 0.6], 60)
    p, n = np.column_stack([share, 1 - share]), rng.integers(1, 50, 60)
    goal = (p * n[:, None]).sum(0) * [0.1, 3.0]  # no document holds so little of the first domain
    rate, fit = rates_of(spark, p, n, goal, tolerance=1e-7, rounds=60)
    best = slow_rates(p, n, goal, 100_000)
    assert (rate >= 0).all() and best > 1
    assert fit.objective == pytest.approx(best, rel=1e-3)
    assert ((((n * rate) @ p - goal) ** 2 / goal).sum() / 2) == pytest.approx(fit.objective, rel=1e-9)


def test_rates_never_diverge(spark):
    rng = np.random.default_rng(0)
    p, n = rng.dirichlet([3, 3, 3], 300), rng.integers(1, 50, 300)
    now = (p * n[:, None]).sum(0)
    goal = now * [0.02, 1, 4]
    rate, fit = rates_of(spark, p, n, goal, rounds=40)
    first = ((now - goal) ** 2 / goal).sum() / 2
    assert not fit.converged and fit.objective < 0.1 * first and np.isfinite(rate).all()
    assert fit.objective <= slow_rates(p, n, goal, 40) * 1.0001


def test_posteriors_match_naive_bayes_in_numpy(spark):
    """Words and bands counted in Spark columns against a plain recount of the same model's tables."""
    d = "/root/testdata/sf0.001"
    docs, marked = spark.read.parquet(f"{d}/documents.parquet"), mixing.domain_of(spark.read.parquet(f"{d}/labels.parquet"))
    model = mixing.train(docs, marked)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kinds = marked.collect()
    sets = {i: set(w for w in re.split(r"[\s!-/:-@\[-`{-~]+", (t or "").lower()) if w) for i, t in texts.items()}
    for w, odds in list(model.words.items())[:20]:
        for k, domain in enumerate(model.domains):
            own = [r.k for r in kinds if r.domain == domain and r.k in texts]
            share = (sum(w in sets[i] for i in own) + 0.5) / (len(own) + 1.0)
            assert odds[k] == pytest.approx(math.log(share / (1 - share)))
    got = mixing.mix(docs, marked).toPandas().set_index("doc_id")
    rows = mixing._features(docs, "text", "f_", list(model.words)).select("doc_id", "f_bands").collect()
    for r in rows:
        total = np.array(model.prior)
        for w in sets[r.doc_id] & set(model.words):
            total = total + model.words[w]
        for band in r.f_bands:
            total = total + np.array(model.bands.get(band, np.zeros(len(total))))
        want = np.exp(total - total.max())
        assert np.allclose(got.loc[r.doc_id, [f"p_{x}" for x in model.domains]].to_numpy(float), want / want.sum())


def test_copies_keep_the_totals_of_the_rates(spark):
    rates = [0.0, 0.02, 0.07, 0.13, 0.93, 0.97, 1.0, 1.06, 1.5, 2.08]
    rows = spark.range(200_000).select("id", F.array(*map(F.lit, rates))[F.col("id").cast("int") % len(rates)].alias("rate"))
    got = {r.rate: (r.n, r.least, r.most) for r in rows.withColumn("n", mixing.copies_of(F.col("rate"), F.col("id"))).groupBy("rate").agg(F.avg("n").alias("n"), F.min("n").alias("least"), F.max("n").alias("most")).collect()}
    for rate, (n, least, most) in got.items():
        assert n == pytest.approx(rate, abs=0.015) and (least, most) == (math.floor(rate), math.ceil(rate))


def test_mixing_of_odd_rows(spark):
    docs = cases.documents(spark)
    marked = mixing.domain_of(cases.labels(spark))
    rows = mixing.mix(docs, marked).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    out = mixing.apply_mix(docs, marked)
    assert out.columns == docs.columns
    bare = mixing.mix(docs, mixing.domain_of(cases.empty(spark, cases.LABELS))).collect()
    assert {r.rate for r in bare} == {1.0} and len(bare) == docs.count()
    assert mixing.mix(cases.empty(spark), marked).collect() == []
    assert mixing.apply_mix(docs, mixing.domain_of(cases.empty(spark, cases.LABELS))).count() == docs.count()


def slow_licenses(text, templates, threshold):
    """Best coefficient of all windows for each licence that reaches the threshold."""
    split = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.translate({c: c + 32 for c in range(65, 91)}))
    words, best = split(text or ""), {}
    grams = list(zip(words, words[1:]))
    for name, _, template in templates:
        t = split(template)
        want = Counter(zip(t, t[1:]))
        for i in range(len(grams)):
            held = Counter()
            for j in range(i, len(grams)):
                held[grams[j]] += 1
                value = 2 * (held & want).total() / (j - i + 1 + want.total())
                if value >= threshold and value > best.get(name, 0):
                    best[name] = value
    return best


def test_licenses_match_brute_force(spark):
    mit = licenses.TEMPLATES[0][2]
    lines = [" ".join(mit.split()[i : i + 9]) for i in range(0, len(mit.split()), 9)]
    wrapped = "\n".join(lines)
    prose = "\n".join(f"In the {w} of the story, one word is provided to the {w}." for w in ("north", "south", "east", "west") * 10)
    texts = [
        None, "", "Released under the MIT License.", "x\nlicensed under the apache license version 2.0\ny z",
        f"intro words here\n{wrapped}\n\noutro", mit.replace("\n", " "), "Licensed under some other terms entirely",
        wrapped + "\nReleased under the MIT License.", f"{prose}\n\n{wrapped}", f"An introduction of the thing on one line {mit}",
        "\n".join([*lines[:9], "word", *lines[9:]]), "Terms: Released under the MIT License. See file.",
        f"{mit} {prose} {mit}", "the the the of the of the",
    ]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, found string, id string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    names = [None, None, "MIT", "Apache-2.0", "MIT", "MIT", None, "MIT", "MIT", "MIT", "MIT", "MIT", "MIT", None]
    assert [got[i].license for i in range(len(texts))] == names
    assert got[2].dice == 1.0 and got[6].dice == 0.0 and min(got[i].dice for i in (4, 5, 8, 9, 10, 11, 12)) > 0.98
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_all_windows_match_brute_force(spark):
    """Short templates and random texts over few words, so that windows of all sizes and repeated bigrams occur."""
    rng = np.random.default_rng(6)
    templates = [("a", "x", "a b c d e f"), ("b", "x", "a b a b a c"), ("c", "y", "d d d e d d"), ("a", "y", "c c b a"), ("one", "x", "a")]
    texts = [" ".join(rng.choice(list("abcdef"), n)) for n in rng.integers(0, 40, 120)] + ["a b c d e f", "x a b c y d e f", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.5, 0.8, 1.0):
        for r in licenses.license_spans(docs, templates, threshold).collect():
            want = slow_licenses(texts[r.doc_id], templates, threshold)
            assert {x.license: pytest.approx(x.dice) for x in r.found} == want
            words = (texts[r.doc_id] or "").split()
            for x in r.found:
                part = " ".join(words[x.first_word : x.last_word + 1])
                assert slow_licenses(part, [t for t in templates if t[0] == x.license], threshold)[x.license] == pytest.approx(x.dice)


SLOW_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def slow_judge(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), h + p, a) for h, p, a in SLOW_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, "allow")


def test_url_rules_match_brute_force(spark):
    urls = [
        None, "", "no scheme", "http://", "http://EXAMPLE.org/es/1", "https://a.b.example.org/es/x?y=/en/1", "http://example.org/en/12", "http://example.org/EN/12", "http://notexample.org/es/", "http://org/", "http://org", "http://x.org?q=/a",
        "http://m.site.com/fr/1", "http://m.site.com/de/1#top", "http://m.site.com/en/", "http://com/de/", "http://site.com.net/de/", "x://y://z.com/de/", "http://example.org:80/es/", "http://u@example.org/es/", "http://x.net/?u=http://a.com/de/",
        "http://x.net/a\nb", "http://example.org/es", "//example.org/es/", "http://a.example.org/en/1#x", "ftp://A.COM/fr/", "http://x.org/\u00fc",
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls + urls[4:6])], "page_id long, url string, token string, best string")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        host, path, (rule, verdict) = slow_judge(r.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), r.url


@pytest.mark.parametrize("name", ["op2_url_filter", "op4_decontamination"])
def test_queries_equal_their_sql(spark, name):
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    got, want = queries.queries()[name](spark, d).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert list(got.columns) == list(want.columns) and len(got) > 0
    plain = lambda df: sorted(tuple(None if pd.isna(v) else str(v) for v in r) for r in df.itertuples(index=False))
    assert [str(r) for r in plain(got)] == [str(r) for r in plain(want)]


def test_url_patterns(spark):
    urls = ["http://x.net/ads/1", "http://x.net/loads/1", "http://casino.net/", "http://x.net/login", "http://x.net/login/new/help/", "http://x.net/Robots.txt", "http://x.org/ads/"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: (r.verdict, r.pattern) for r in url_filter.judge(pages).collect()}
    assert [got[u][0] for u in urls] == ["block", "allow", "block", "block", "allow", "block", "allow"]
    assert got[urls[6]][1] is None
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
    with pytest.raises(ValueError):
        url_filter.rule_table(spark, [], [url_filter.PatternRule("*abc*", "block")])


def colliding(n, seed=7):
    """Different vectors of three dimensions whose XXH64, as Spark chains it over their components, is one number: the last component undoes what the others did."""
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    mask = (1 << 64) - 1
    rol = lambda x, r: ((x << r) | (x >> (64 - r))) & mask
    ror = lambda x, r: rol(x, 64 - r)

    def step(bits, h):
        h = (h + p5 + 8) & mask
        h ^= rol(bits * p2 & mask, 31) * p1 & mask
        h = (rol(h, 27) * p1 + p4) & mask
        h = (h ^ (h >> 33)) * p2 & mask
        h = (h ^ (h >> 29)) * p3 & mask
        return h ^ (h >> 32)

    def unstep(out, h):
        """The bits that lead from h to out."""
        x = out ^ (out >> 32)
        x = x * pow(p3, -1, 1 << 64) & mask
        x = x ^ (x >> 29) ^ (x >> 58)
        x = x * pow(p2, -1, 1 << 64) & mask
        x = x ^ (x >> 33)
        x = ror((x - p4) * pow(p1, -1, 1 << 64) & mask, 27)
        x = (x ^ ((h + p5 + 8) & mask)) * pow(p1, -1, 1 << 64) & mask
        return ror(x, 31) * pow(p2, -1, 1 << 64) & mask

    rng, found = np.random.default_rng(seed), []
    target = 0x0123456789ABCDEF
    while len(found) < n:
        a, b = rng.normal(size=2).tolist()
        h = step(int(np.float64(b).view(np.uint64)), step(int(np.float64(a).view(np.uint64)), 42))
        c = float(np.uint64(unstep(target, h)).view(np.float64))
        if 0.05 < abs(c) < 20:
            found.append([a, b, c])
    return found


def test_vectors_whose_hashes_collide_are_all_found(spark):
    vectors = colliding(60)
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(4)
    assert table.select(F.xxhash64("embedding")).distinct().count() == 1
    got = {}
    for r in ann.search(table).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = np.array(vectors)
    assert set(got) == {0, 20, 40}
    for q, rows in got.items():
        score = v @ v[q]
        order = sorted((i for i in range(60) if i != q), key=lambda i: (-score[i], i))[:20]
        assert [i for _, i, _ in sorted(rows)] == order
