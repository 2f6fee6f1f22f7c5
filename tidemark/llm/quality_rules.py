"""Quality classifier: a sparse rule ensemble, compiled into Spark column expressions.

Small regression trees are boosted on statistics of a bounded sample of labelled texts; every path from a root to a
node is a rule (a conjunction of bounds on statistics). A lasso logistic regression keeps few of the rules with a
weight each. The statistics are counted once a row, in Arrow batches; the kept rules become one column expression over
them, so that scoring reads each text once, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, fresh, text_of
from tidemark.llm.textstats import NAMES, with_stats


@dataclass(frozen=True)
class Rule:
    """All of the bounds (name, is_upper, value) hold: name <= value if is_upper, else name > value."""

    bounds: tuple[tuple[str, bool, float], ...]
    weight: float

    def holds(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for name, upper, value in self.bounds:
            c = F.col(prefix + name)
            out = out & (c <= value if upper else c > value)
        return out


@dataclass(frozen=True)
class RuleModel:
    """Logistic score of an intercept and weighted rules."""

    intercept: float
    rules: tuple[Rule, ...]

    def score(self, prefix: str = "") -> Column:
        total = F.lit(float(self.intercept))
        for r in self.rules:
            total = total + F.when(r.holds(prefix), F.lit(float(r.weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _paths(x: np.ndarray, names: list[str], cuts: list[np.ndarray], target: np.ndarray, depth: int, leaf: int) -> tuple[list, np.ndarray]:
    """Paths of one regression tree, and its fit to the target."""
    fit, out = np.zeros(len(target)), []

    def grow(rows: np.ndarray, path: tuple, left: int) -> None:
        if path:
            out.append(path)
        fit[rows] = target[rows].mean()
        best = (1e-9, None)
        if left and len(rows) >= 2 * leaf:
            t, total = target[rows], target[rows].sum()
            for j, values in enumerate(cuts):
                if not len(values):
                    continue
                at = np.searchsorted(values, x[rows, j], "left")
                n = np.cumsum(np.bincount(at, minlength=len(values) + 1))[:-1]
                s = np.cumsum(np.bincount(at, weights=t, minlength=len(values) + 1))[:-1]
                m = len(rows) - n
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((n >= leaf) & (m >= leaf), s * s / n + (total - s) ** 2 / m - total * total / len(rows), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, float(values[k])))
        if best[1] is None:
            return
        j, value = best[1]
        below = x[rows, j] <= value
        for upper, part in ((True, rows[below]), (False, rows[~below])):
            grow(part, (*path, (names[j], upper, value)), left - 1)

    grow(np.arange(len(target)), (), depth)
    return out, fit


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, leaf: int = 20, penalty: float = 0.002, steps: int = 400) -> RuleModel:
    """Rules from boosted trees, weighted by lasso logistic regression (accelerated proximal gradient). Without both
    classes the score is the share of ones, smoothed."""
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    if len(y) < 10 or y.min() == y.max():
        return RuleModel(base, ())
    leaf = max(2, min(leaf, len(y) // 20))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64), method="lower")) for j in range(x.shape[1])]
    rng, total, found = np.random.default_rng(7), np.full(len(y), base), {}
    for _ in range(trees):
        rows = np.sort(rng.permutation(len(y))[: max(10, len(y) // 2)])
        rest = y - 1 / (1 + np.exp(-total))
        paths, _ = _paths(x[rows], names, cuts, rest[rows], depth, leaf)
        for p in paths:
            found.setdefault(tuple(sorted(p)), p)
        _, fit = _paths(x, names, cuts, rest, depth, leaf)
        total += fit
    at = {n: j for j, n in enumerate(names)}
    z = np.ones((len(y), len(found)))
    for k, p in enumerate(found.values()):
        for name, upper, value in p:
            z[:, k] *= x[:, at[name]] <= value if upper else x[:, at[name]] > value
    mean = z.mean(axis=0)
    use = np.flatnonzero((mean > 0) & (mean < 1))
    rules, z = [list(found.values())[k] for k in use], z[:, use]
    scale = np.sqrt(z.mean(axis=0) * (1 - z.mean(axis=0)))
    a = z / scale
    step = 4 * len(y) / np.linalg.norm(np.column_stack([a, np.ones(len(y))]), 2) ** 2
    w, b = np.zeros(a.shape[1]), base
    vw, vb, t = w, b, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(a @ vw + vb))) - y
        nw = vw - step * (a.T @ g) / len(y)
        nw = np.sign(nw) * np.maximum(0, np.abs(nw) - step * penalty)
        nb = vb - step * g.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    kept = [Rule(p, float(v / s)) for p, v, s in zip(rules, w, scale) if v]
    return RuleModel(float(b), tuple(kept))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = 12_000, folds: int = 5,
) -> RuleModel:
    """Fit on at most `sample` labelled ids whose crc32(id as text) mod folds is not 0, taken by a hash of the id, and at
    most twice as many rows (ids may repeat, with texts or labels of their own), taken by a hash of id and text. Rows
    without an id, or with a label other than 0 and 1, are left out. An id with both labels counts once for each."""
    good = F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (crc_mod(id_col, folds) != 0)
    marked = labels.filter(good).select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y"))
    chosen = marked.distinct().orderBy(F.xxhash64("k"), "k", "y").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("k"), text_of(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("k", "text")).join(F.broadcast(chosen), "k")
    stats = ["s_" + n for n in NAMES]
    got = with_stats(rows, "text", "s_").select("h", "k", "y", *stats)
    got = got.orderBy("h", "k", "y", *stats).limit(2 * sample).toPandas()
    return fit_rules(got[stats].to_numpy(float).reshape(-1, len(NAMES)), got["y"].to_numpy(float), NAMES)


def score(docs: DataFrame, model: RuleModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score of each whole text. Null and blank texts are scored like empty ones; repeated rows are kept."""
    prefix = "stat_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    out = with_stats(docs, text_col, prefix).withColumn(score_col, model.score(prefix))
    return out.drop(*[prefix + n for n in NAMES])


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.3, folds: int = 5, sample: int = 12_000,
) -> DataFrame:
    """Per row of docs: id, held_out (the label was not to be learnt), score (nearer 1: likelier good) and predicted. An empty
    table gives an empty result; without labels every score is one half. Null and blank texts are scored by statistics of zero; a text of any length
    is counted whole, in one task. Repeated rows are each scored. Equal scores are equal predictions. Other columns are not looked at, whatever
    their names."""
    model = train(docs, labels, id_col, text_col, label_col, sample, folds)
    rows = score(docs.select(id_col, text_col), model, text_col, "score")
    held, predicted = crc_mod(id_col, folds) == 0, (F.col("score") >= threshold).cast("int")
    return rows.select(F.col(id_col), held.alias("held_out"), "score", predicted.alias("predicted"))


def good_only(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.3, sample: int = 12_000,
) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier doesn't reject.

    Null, blank and very long texts, repeated rows and rows without an id are scored like any other, and a row stays where its score is the
    threshold or more. Columns of the statistics have names that docs doesn't use. An empty table gives an empty result."""
    mark = fresh(docs, "quality_score")
    scored = score(docs, train(docs, labels, id_col, text_col, label_col, sample), text_col, mark)
    return scored.filter(F.col(mark) >= threshold).drop(mark)
