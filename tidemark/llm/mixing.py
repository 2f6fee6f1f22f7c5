"""Mixing documents to target weights by soft membership, in DataFrame operations alone.

A naive Bayes classifier is counted from the labelled table: which of a set of telling words and of bands of text
statistics occur in the documents of each domain. It gives every document a posterior p for each domain. A document of n
tokens adds n p to the domains' expected totals, and nonnegative rates r (how often each document is to be used) are
sought for which those totals meet the targets T: least squares on the gaps e = sum(r n p) - T, each weighed by 1 / T,

    f(r) = 1/2 sum_k e_k^2 / T_k,   r >= 0,

by accelerated projected gradient from r = 1, so that documents that need no change stay near 1. Distances between rates
are weighed by tokens, so that documents of one kind get one rate whatever their length: with b = p / sqrt(T) and
g = e / sqrt(T) a step is r <- max(0, y - (b . g) / L), where y carries the last move on and L is the largest eigenvalue of
sum(n b b') over all documents, which is the Lipschitz constant in that metric. Where f would rise, the momentum starts
anew, so f never does. All that a round needs of the documents is one aggregate of a sum for each domain.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, fresh, materialise, text_of
from tidemark.llm.textstats import STOP_WORDS

#: Share of all tokens for each domain of domain_of in the production query.
TARGETS = {"good": 0.93, "low": 0.05, "toxic": 0.02}
_SYMBOLS = r"[!$%&*#|]"
_CAPITALS = "[A-Z]"
#: Upper bounds of the bands of each statistic.
BANDS = {"symbols": [0.0, 0.005, 0.02, 0.06], "capitals": [0.005, 0.03, 0.1, 0.3], "words": [5, 20, 100, 500], "distinct": [0.3, 0.45, 0.55, 0.65, 0.8], "stops": [0.02, 0.05, 0.08, 0.12, 0.2]}


def domain_of(labels: DataFrame) -> DataFrame:
    """(k, domain) from labels (doc_id, quality, toxic): toxic, else low where quality is 0, else good. Labels that are null, or an
    id that is null, have no domain."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "good")
    return labels.select(F.col("doc_id").cast("long").alias("k"), domain.alias("domain")).filter("k IS NOT NULL AND domain IS NOT NULL").distinct()


def _features(df: DataFrame, text_col: str, p: str, telling: Sequence[str] = ()) -> DataFrame:
    """df with p+set (distinct words of ASCII letters, digits and characters beyond, lower-cased), p+hits (those of them that are function words or in
    `telling`), p+tokens (how many words) and p+bands (a number for each statistic)."""
    text = p + "text"
    known = F.array(*[F.lit(w) for w in dict.fromkeys([*STOP_WORDS, *telling])])
    df = df.withColumn(text, text_of(text_col))
    df = df.withColumn(p + "words", F.array_remove(F.split(F.lower(text), r"[\s!-/:-@\[-`{-~]+"), ""))
    df = df.withColumns({p + "tokens": F.size(p + "words").cast("long"), p + "set": F.array_distinct(p + "words")}).withColumn(p + "hits", F.array_intersect(p + "set", known))
    t, n = F.col(text), F.greatest(F.length(text), F.lit(1))
    value = {
        "symbols": F.regexp_count(t, F.lit(_SYMBOLS)) / n,
        "capitals": F.regexp_count(t, F.lit(_CAPITALS)) / n,
        "words": F.col(p + "tokens"),
        "distinct": F.size(p + "set") / F.greatest(p + "tokens", F.lit(1)),
        "stops": F.size(F.array_intersect(p + "hits", F.array(*[F.lit(w) for w in STOP_WORDS]))) / F.greatest(F.least(p + "tokens", F.lit(len(STOP_WORDS))), F.lit(1)),
    }
    df = df.withColumns({p + "of_" + name: c for name, c in value.items()})
    bands = []
    for i, (name, bounds) in enumerate(BANDS.items()):
        band = F.lit(10 * i + len(bounds))
        for k, most in reversed(list(enumerate(bounds))):
            band = F.when(F.col(p + "of_" + name) <= most, 10 * i + k).otherwise(band)
        bands.append(band)
    return df.withColumn(p + "bands", F.array(*bands)).drop(text, *[p + "of_" + name for name in value])


@dataclass(frozen=True)
class DomainModel:
    """For each domain, the log of its prior with none of the words, of the odds that each word occurs, and of the chance of each band."""

    domains: tuple[str, ...]
    prior: tuple[float, ...]
    words: dict[str, tuple[float, ...]]
    bands: dict[int, tuple[float, ...]]

    def posteriors(self, p: str) -> list[Column]:
        """A column for each domain, over the columns of _features."""
        if not self.domains:
            return []
        row = lambda v: F.array(*[F.lit(float(x)) for x in v])
        add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
        total = row(self.prior)
        if self.words:
            known = F.array(*[F.lit(w) for w in self.words])
            table = F.create_map(*[x for w, v in self.words.items() for x in (F.lit(w), row(v))])
            total = F.aggregate(F.array_intersect(F.col(p + "hits"), known), total, lambda a, w: add(a, table[w]))
        table = F.create_map(*[x for b, v in self.bands.items() for x in (F.lit(b), row(v))])
        total = F.aggregate(F.filter(F.col(p + "bands"), lambda b: F.map_contains_key(table, b)), total, lambda a, b: add(a, table[b]))
        most = F.array_max(total)
        odds = F.transform(total, lambda x: F.exp(x - most))
        whole = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
        shares = F.transform(odds, lambda x: x / whole)
        return [shares[k] for k in range(len(self.domains))]


def train(docs: DataFrame, marked: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 12_000, words: int = 64, lift: float = 4.0) -> DomainModel:
    """Count a naive Bayes classifier on at most `sample` rows of marked (k, domain), taken by a hash of the id. The words are those at least
    `lift` times as frequent in a domain as in the rest that tell most of it (documents times the log of that ratio), `words` at most."""
    chosen = marked.orderBy(F.xxhash64("k"), "k", "domain").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "k")
    rows = materialise(_features(rows, "text", "f_").select("domain", "f_set", "f_bands"), "labelled")
    sizes = {r.domain: r.n for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = tuple(sorted(sizes))
    if not domains:
        return DomainModel((), (), {}, {})
    total = sum(sizes.values())
    per = [F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)]
    counts = rows.select("domain", F.explode("f_set").alias("w")).groupBy("w").agg(*per, F.count("*").alias("n")).filter(F.col("n") >= 5)
    gain = F.lit(0.0)
    for k, d in enumerate(domains):
        n, m = sizes[d], total - sizes[d]
        if m:
            a, b = F.col(f"n{k}"), F.col("n") - F.col(f"n{k}")
            ratio = (a + 0.5) / (n + 1.0) * (m + 1.0) / (b + 0.5)
            gain = F.greatest(gain, F.when(ratio >= lift, a * F.log(ratio)).otherwise(0.0))
    best = counts.withColumn("gain", gain).filter("gain > 0").orderBy(F.desc("gain"), "w").limit(words).collect()
    log = lambda x, d: float(np.log((x + 0.5) / (sizes[d] + 1.0)))
    chance = {r.w: np.exp([log(r[f"n{k}"], d) for k, d in enumerate(domains)]) for r in best}
    word_table = {w: tuple(float(x) for x in np.log(c / (1 - c))) for w, c in chance.items()}
    without = sum((np.log(1 - c) for c in chance.values()), np.zeros(len(domains)))
    bands = rows.select("domain", F.explode("f_bands").alias("b")).groupBy("b").agg(*per).collect()
    band_table = {r.b: tuple(log(r[f"n{k}"], d) for k, d in enumerate(domains)) for r in bands}
    return DomainModel(domains, tuple(float(np.log(sizes[d] / total) + x) for d, x in zip(domains, without)), word_table, band_table)


@dataclass(frozen=True)
class Fit:
    """totals: the domains' expected tokens at the rates found; objective: f there; converged: whether all totals are
    within the tolerance, or no step can lower f any more (targets that can't be met together)."""

    totals: tuple[float, ...]
    objective: float
    rounds: int
    converged: bool


#: Rounds between two written states of the rates.
KEEP = 5


def fit_rates(
    table: DataFrame, tokens: str, posteriors: list[str], targets: list[float], rate: str = "rate", rounds: int = 100,
    tolerance: float = 1e-4,
) -> tuple[DataFrame, Fit]:
    """table with a column `rate` whose expected totals over the posterior columns meet the targets, and how well they do.

    A domain with a target of 0 or less is left alone. Ends when all totals are within `tolerance` of their targets, when the
    projected gradient is `tolerance` of what it was, or after `rounds`; f is never higher than at rates of 1."""
    live = [k for k, t in enumerate(targets) if t > 0]
    root = np.sqrt([targets[k] for k in live])
    b = [F.col(posteriors[k]) / F.lit(float(x)) for k, x in zip(live, root)]
    n, before = F.coalesce(F.col(tokens).cast("double"), F.lit(0.0)), rate + "_before"
    pairs = [(i, j) for i in range(len(live)) for j in range(i, len(live))]
    start = table.agg(
        *[F.sum(F.col(tokens) * F.col(c)).alias(f"t{k}") for k, c in enumerate(posteriors)],
        *[F.sum(n * b[i] * b[j]).alias(f"g{i}_{j}") for i, j in pairs],
    ).first()
    gram = np.zeros((len(live), len(live)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = start[f"g{i}_{j}"] or 0.0
    bound = float(np.linalg.eigvalsh(gram).max(initial=0.0))
    totals = np.array([float(start[f"t{k}"] or 0.0) for k in range(len(posteriors))])
    state = table.withColumns({rate: F.lit(1.0), before: F.lit(1.0)})
    gap = lambda t: (t[live] - root**2) / root
    e = gap(totals)
    ahead, momentum, speed, first, done, k = e, 0.0, 1.0, None, not live or bound <= 0, 0
    with Scratch(table.sparkSession, "rates") as scratch:
        kept = None
        while not done and k < rounds and np.abs(e / root).max(initial=0.0) > tolerance:
            k += 1
            y = F.col(rate) + F.lit(float(momentum)) * (F.col(rate) - F.col(before))
            for c, x in zip(b, ahead / bound):
                y = y - c * F.lit(float(x))
            moved = state.withColumn("moved_", F.greatest(F.lit(0.0), y))
            if k % KEEP == 0:
                moved, last = scratch.write(moved, "state"), kept
                if last is not None:
                    scratch.drop(last)
                kept = moved
            at = F.col("moved_")
            sums = moved.agg(
                *[F.sum(n * at * F.col(c)).alias(f"t{i}") for i, c in enumerate(posteriors)],
                F.sum(n * (at - F.col(rate)) ** 2).alias("move"),
            ).first()
            there = np.array([float(sums[f"t{i}"] or 0.0) for i in range(len(posteriors))])
            new = gap(there)
            if new @ new > e @ e and momentum > 0:  # start anew from the last rates
                state = moved.drop("moved_") if k % KEEP == 0 else state
                ahead, momentum, speed = e, 0.0, 1.0
                continue
            move = float(np.sqrt(sums["move"] or 0.0)) if momentum == 0 else None
            first = first if first is not None else move
            done = move is not None and (not first or move <= tolerance * first)
            faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
            momentum, speed = (speed - 1) / faster, faster
            state = moved.withColumns({before: F.col(rate), rate: at}).drop("moved_")
            ahead, e, totals = new + momentum * (new - e), new, there
        met = bool(np.abs(e / root).max(initial=0.0) <= tolerance)
        out = materialise(state.drop(before), "rates")
    return out, Fit(tuple(totals.tolist()), float(e @ e / 2), k, met or bool(done))


def mix(
    docs: DataFrame, marked: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text",
    sample: int = 12_000, rounds: int = 100,
) -> DataFrame:
    """One row per row of docs: id, text hash h, n_tokens, a posterior p_<domain> for each labelled domain, and the rate.

    targets: shares for domains. They are scaled so that the domain with most expected tokens keeps what it has: to gain share the
    others are used more often, to lose it less. Domains without a target keep theirs. Targets that can't be met together
    are met as nearly as `rounds` allow, with a warning. Null and blank texts have no tokens and the rate of their
    posteriors. Without labels, or with an empty table, all rates are 1. Repeated rows are kept, each with the same rate. Of
    domains with equally many tokens the first by name keeps what it has. A text of any length is counted whole. Other columns of docs are not
    looked at, whatever their names."""
    model = train(docs, marked, id_col, text_col, sample)
    p = "f_"
    names = [f"p_{d}" for d in model.domains]
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    rows = _features(rows, "text", p, list(model.words))
    own = [F.xxhash64(text_of("text")).alias("h"), F.col(p + "tokens").alias("n_tokens")]
    rows = rows.select(id_col, *own, *[c.alias(n) for c, n in zip(model.posteriors(p), names)])
    if not names:
        return rows.withColumn("rate", F.lit(1.0))
    with Scratch(docs.sparkSession, "posteriors") as scratch:
        rows = scratch.write(rows, "posteriors")
        now = rows.agg(*[F.sum(F.col("n_tokens") * F.col(c)).alias(c) for c in names]).first()
        have = [float(now[c] or 0.0) for c in names]
        wish = [targets.get(d, 0.0) for d in model.domains]
        most = max(range(len(names)), key=lambda k: (have[k] if wish[k] else 0.0))
        scale = have[most] / wish[most] if wish[most] else 0.0
        goal = [w * scale if w and h else h for w, h in zip(wish, have)]
        out, fit = fit_rates(rows, "n_tokens", names, goal, "rate", rounds)
    if not fit.converged:
        warnings.warn(f"rates are not settled after {fit.rounds} rounds: totals {fit.totals} for targets {goal}", stacklevel=2)
    return out


def copies_of(rate: Column, key: Column) -> Column:
    """How often a document is used: the rate rounded up or down by a hash of the key in proportion, so that the expected totals stay those of the rates."""
    share = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return F.floor(rate + share).cast("int")


#: Keys of rows that aren't used just once are broadcast if they are at most so many, else joined by shuffle.
BROADCAST = 2_000_000


def apply_mix(
    docs: DataFrame, marked: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text",
    **options,
) -> DataFrame:
    """The rows of docs, with all their columns, each as often as copies_of its rate. Rows that repeat are each used so often.
    Null, blank and very long texts are rows like any other, and so are rows without an id. Columns that the join needs have names that docs
    doesn't use. An empty table gives an empty result."""
    rates = mix(docs, marked, targets, id_col, text_col, **options)
    key, often = fresh(docs, "mix_key"), fresh(docs, "mix_copies")
    own = F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_of(text_col)))
    used = copies_of(F.col("rate"), F.coalesce(F.col(id_col), F.col("h")))
    rates = rates.select(F.xxhash64(F.col(id_col), F.col("h")).alias(key), used.alias(often)).filter(F.col(often) != 1)
    rates = materialise(rates.groupBy(key).agg(F.max(often).alias(often)), "copies")
    rates = F.broadcast(rates) if rates.count() <= BROADCAST else rates
    out = docs.join(rates, own == rates[key], "left").withColumn(often, F.coalesce(F.col(often), F.lit(1)))
    out = out.filter(F.col(often) > 0)
    return out.withColumn(often, F.explode(F.sequence(F.lit(1), F.col(often)))).drop(key, often)
