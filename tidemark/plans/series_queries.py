"""Queries on series, states and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import generalise, hmm, placebo, regimes, separation, series
from tidemark.plans import bindings as B
from tidemark.plans.registry import places, query, text_days
from tidemark.sources.tables import materialise


@query(f"WITH {B.FEAT} SELECT asset, CAST(d AS VARCHAR) AS d, px, round(ret, 6) AS ret, round(mom, 6) AS mom, round(vol, 6) AS vol, round(fvol, 6) AS fvol FROM feat")
def daily_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.features(spark, sf_dir).select("asset", *text_days("d"), "px", *places("ret", "mom", "vol", "fvol"))


@query(f"""WITH {B.PX}, {B.LEVELS},
days AS (SELECT * FROM px JOIN levels USING (d)),
ret AS (SELECT *, px / nullif(lag(px) OVER (PARTITION BY asset ORDER BY d), 0) - 1 AS ret FROM days),
f AS (SELECT asset, d, level, CASE WHEN count(ret) OVER t = 20 THEN stddev_samp(ret) OVER t END AS vol, px / nullif(lag(px, 20) OVER w, 0) - 1 AS mom, credit / nullif(lag(credit, 20) OVER w, 0) - 1 AS credit_ret
      FROM ret WINDOW w AS (PARTITION BY asset ORDER BY d), t AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT asset, CAST(d AS VARCHAR) AS d, round(vol, 6) AS vol, round(mom, 6) AS mom, round(level, 6) AS level, round(credit_ret, 6) AS credit_ret
FROM f WHERE vol IS NOT NULL AND mom IS NOT NULL AND level IS NOT NULL AND credit_ret IS NOT NULL""")
def calendar_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, lv = B.prices(spark, sf_dir), B.levels(spark, sf_dir)
    days = px.join(lv, "d")
    out = series.assemble_features(days.select("asset", "d", "px"), days.select("asset", "d", "level"), days.select("asset", "d", "credit"))
    return out.select("asset", *text_days("d"), *places("vol", "mom", "level", "credit_ret"))


_SEP = """SELECT asset, count(ret) FILTER (state = 0) AS n0, count(ret) FILTER (state = 1) AS n1, avg(ret) FILTER (state = 0) AS mean0, avg(ret) FILTER (state = 1) AS mean1,
  stddev_samp(ret) FILTER (state = 0) AS std0, stddev_samp(ret) FILTER (state = 1) AS std1 FROM st WHERE ret IS NOT NULL GROUP BY asset"""


@query(f"WITH {B.STATES}, sep AS ({_SEP}) SELECT asset, n0, n1, round(mean0, 6) AS mean0, round(mean1, 6) AS mean1, round(std0 * sqrt(252), 6) AS vol0, round(std1 * sqrt(252), 6) AS vol1, round(std1 / nullif(std0, 0), 6) AS ratio FROM sep")
def state_vol_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separation.vol_separation(B.states(spark, sf_dir)).select("asset", "n0", "n1", *places("mean0", "mean1", "vol0", "vol1", "ratio"))


@query(f"""WITH {B.STATES}, sep AS ({_SEP}),
m AS (SELECT asset, state, median(ret) AS m FROM st WHERE ret IS NOT NULL GROUP BY asset, state),
z AS (SELECT asset, state, abs(ret - m) AS z FROM st JOIN m USING (asset, state) WHERE ret IS NOT NULL),
g AS (SELECT asset, avg(z) FILTER (state = 0) AS z0, avg(z) FILTER (state = 1) AS z1, avg(z) AS zz, var_pop(z) FILTER (state = 0) AS v0, var_pop(z) FILTER (state = 1) AS v1 FROM z GROUP BY asset)
SELECT asset, round((n0 + n1 - 2) * (n0 * (z0 - zz) ** 2 + n1 * (z1 - zz) ** 2) / nullif(n0 * v0 + n1 * v1, 0), 5) AS levene_w,
  round((mean1 - mean0) / nullif(sqrt(std0 ** 2 / n0 + std1 ** 2 / n1), 0), 5) AS welch_t,
  round((std0 ** 2 / n0 + std1 ** 2 / n1) ** 2 / ((std0 ** 2 / n0) ** 2 / (n0 - 1) + (std1 ** 2 / n1) ** 2 / (n1 - 1)), 4) AS welch_df
FROM sep JOIN g USING (asset)""")
def welch_levene_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separation.vol_separation(B.states(spark, sf_dir)).select("asset", *places("levene_w", "welch_t", n=5), *places("welch_df", n=4))


@query()
def welch_levene_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separation.with_p_values(separation.vol_separation(B.states(spark, sf_dir))).select("asset", "levene_w", "levene_p", "welch_t", "welch_p")


@query(f"""WITH {B.STATES} SELECT asset, n0, n1, round(mean1 / nullif(mean0, 0), 6) AS mean_ratio, round(median1 / nullif(median0, 0), 6) AS median_ratio FROM (
  SELECT asset, count(fvol) FILTER (state = 0) AS n0, count(fvol) FILTER (state = 1) AS n1, avg(fvol) FILTER (state = 0) AS mean0, avg(fvol) FILTER (state = 1) AS mean1,
    median(fvol) FILTER (state = 0) AS median0, median(fvol) FILTER (state = 1) AS median1 FROM st GROUP BY asset)""")
def forward_vol_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separation.forward_separation(B.states(spark, sf_dir)).select("asset", "n0", "n1", *places("mean_ratio", "median_ratio"))


def _fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.fan_out(series.number_rows(B.states(spark, sf_dir)), 252, 63)


@query(f"WITH {B.FOLDED} SELECT asset, CAST(fold AS INT) AS fold, part, count(*) AS n, CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day FROM fan GROUP BY ALL")
def fold_fanout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _fan(spark, sf_dir).groupBy("asset", "fold", "part").agg(F.count("*").alias("n"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))
    return out.select("asset", "fold", "part", "n", *text_days("first_day", "last_day"))


@query(f"WITH {B.FOLDED} SELECT asset, CAST(fold AS INT) AS fold, round(avg(vol), 6) AS vol_mean, round(stddev_pop(vol), 6) AS vol_std, round(avg(mom), 6) AS mom_mean, round(stddev_pop(mom), 6) AS mom_std FROM fan WHERE part = 'train' GROUP BY ALL")
def scaler_params_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.scaler_params(_fan(spark, sf_dir), ["vol", "mom"]).select("asset", "fold", *places("vol_mean", "vol_std", "mom_mean", "mom_std"))


_RATIOS = """ratios AS (SELECT asset, fold, min(d) AS s, max(d) AS e, count(ret) FILTER (state = 0) AS n0, count(ret) FILTER (state = 1) AS n1,
  stddev_samp(ret) FILTER (state = 0) AS std0, stddev_samp(ret) FILTER (state = 1) AS std1 FROM fan WHERE part = 'test' AND ret IS NOT NULL GROUP BY asset, fold),
rr AS (SELECT *, CASE WHEN n0 >= 2 AND n1 >= 2 AND std0 > 0 THEN std1 / std0 END AS ratio FROM ratios)"""


@query(f"""WITH {B.FOLDED}, {_RATIOS} SELECT asset, CAST(fold AS INT) AS fold, CAST(s AS VARCHAR) AS "start", CAST(e AS VARCHAR) AS "end", n0, n1, round(ratio, 6) AS ratio FROM rr""")
def per_fold_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = separation.per_fold_ratios(_fan(spark, sf_dir).filter("part = 'test'"))
    return out.select("asset", "fold", *text_days("start", "end"), "n0", "n1", *places("ratio"))


@query(f"WITH {B.FOLDED}, {_RATIOS} SELECT asset, count(ratio) AS n_folds, round(median(ratio), 6) AS median_ratio, round(avg(ratio), 6) AS mean_ratio, count(*) FILTER (ratio > 1) AS n_above_one FROM rr GROUP BY asset")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = separation.fold_summary(separation.per_fold_ratios(_fan(spark, sf_dir).filter("part = 'test'")))
    return out.select("asset", "n_folds", *places("median_ratio", "mean_ratio"), "n_above_one")


@query(f"""WITH {B.EPISODES} SELECT asset, CAST(run AS BIGINT) AS run, state, CAST(s AS VARCHAR) AS "start", CAST(e AS VARCHAR) AS "end", length FROM episodes""")
def run_length_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.episodes(B.states(spark, sf_dir)).select("asset", "run", "state", *text_days("start", "end"), "length")


@query(f"""WITH {B.EPISODES} SELECT asset, CAST(run AS BIGINT) AS run, state, CAST(s AS VARCHAR) AS "start", CAST(coalesce(lead(s) OVER (PARTITION BY asset ORDER BY run), e) AS VARCHAR) AS until FROM episodes""")
def shading_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.shading_spans(B.states(spark, sf_dir)).select("asset", "run", "state", *text_days("start", "until"))


@query(f"""WITH {B.STATES}, two AS (SELECT *, CASE WHEN mom > 0 THEN 1 ELSE 0 END AS up FROM st)
SELECT asset, count(*) FILTER (a) AS state_flips, count(*) FILTER (b) AS up_flips
FROM (SELECT asset, state <> lag(state) OVER w AS a, up <> lag(up) OVER w AS b FROM two WINDOW w AS (PARTITION BY asset ORDER BY d)) GROUP BY asset""")
def flip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.states(spark, sf_dir).withColumn("up", F.when(F.col("mom") > 0, 1).otherwise(0))
    return series.flip_counts(df, ["state", "up"])


@query(f"""WITH {B.STATES}, q AS (SELECT *, CASE WHEN mom IS NULL THEN 0 WHEN mom < -0.3 THEN 1 WHEN mom > 0.3 THEN 3 ELSE 2 END AS label FROM st),
flag AS (SELECT *, coalesce(label <> lag(label) OVER (PARTITION BY asset ORDER BY d), false) AS changed FROM q),
runs AS (SELECT *, sum(changed::INT) OVER (PARTITION BY asset ORDER BY d) AS run FROM flag),
sized AS (SELECT *, count(*) OVER (PARTITION BY asset, run) AS run_length FROM runs)
SELECT asset, CAST(d AS VARCHAR) AS d, label, run_length FROM sized WHERE changed AND run_length >= 3""")
def multi_state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("mom").isNull(), 0).when(F.col("mom") < -0.3, 1).when(F.col("mom") > 0.3, 3).otherwise(2)
    out = regimes.multi_state_changes(B.states(spark, sf_dir).withColumn("label", label), 3, "label")
    return out.select("asset", *text_days("d"), "label", "run_length")


@query()
def persistence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.persistence_filter(B.states(spark, sf_dir), 10).select("asset", *text_days("d"), "state", "filtered")


@query()
def persistent_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = regimes.persistence_filter(B.states(spark, sf_dir), 10)
    return regimes.extract_transitions(df).select("asset", *text_days("d"), "from_state", "to_state", "direction", "dwell_before", "dwell_after")


@query()
def dwell_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.dwell_sensitivity(B.states(spark, sf_dir), [1, 5, 10, 20])


_CLUSTERS = f"""WITH RECURSIVE {B.EPISODES},
days AS (SELECT DISTINCT asset, state AS to_state, s AS d FROM episodes WHERE run > 0),
lead(asset, to_state, leader) AS (
  SELECT asset, to_state, min(d) FROM days GROUP BY ALL
  UNION ALL
  SELECT l.asset, l.to_state, (SELECT min(d) FROM days x WHERE x.asset = l.asset AND x.to_state = l.to_state AND x.d > l.leader + 5)
  FROM lead l WHERE EXISTS (SELECT 1 FROM days x WHERE x.asset = l.asset AND x.to_state = l.to_state AND x.d > l.leader + 5))
SELECT asset, to_state, CAST(d AS VARCHAR) AS d, CAST((SELECT max(leader) FROM lead l WHERE l.asset = days.asset AND l.to_state = days.to_state AND l.leader <= days.d) AS VARCHAR) AS leader FROM days"""


@query(_CLUSTERS)
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = regimes.extract_transitions(B.states(spark, sf_dir), "state").select("asset", "to_state", "d")
    return regimes.leader_clusters(days, 5).select("asset", "to_state", *text_days("d", "leader"))


@query(f"""WITH {B.PX}, alldays AS (SELECT DISTINCT d FROM px), assets AS (SELECT DISTINCT asset FROM px)
SELECT asset, CAST(d AS VARCHAR) AS d, last_value(px IGNORE NULLS) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px
FROM alldays CROSS JOIN assets LEFT JOIN px USING (asset, d)""")
def ffill_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = B.prices(spark, sf_dir)
    assets = px.agg(F.collect_set("asset").alias("assets"))  # one row
    days = px.select("d").distinct().crossJoin(F.broadcast(assets)).select("d", F.explode("assets").alias("asset"))
    return series.onto_days(days, px, "px", fill=True).select("asset", *text_days("d"), "px")


_DRAWS = 2000
_BOOT = f"""WITH {B.STATES},
pos AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY d) - 1 AS i, ret, state FROM st WHERE ret IS NOT NULL),
n AS (SELECT asset, count(*) AS n FROM pos GROUP BY asset),
blocks AS (SELECT asset, n, b, unnest(range(0, CAST(ceil(n / 20.0) AS BIGINT))) AS j FROM (SELECT asset, n, unnest(range(0, {_DRAWS})) AS b FROM n WHERE n > 20)),
starts AS (SELECT *, CAST(('0x' || substr(md5('7:' || asset || ':' || b || ':' || j), 1, 8)) AS BIGINT) % (n - 20) AS s FROM blocks),
rows AS (SELECT asset, b, j, n, s + o AS i FROM (SELECT *, unnest(range(0, 20)) AS o FROM starts) WHERE j * 20 + o < n),
sums AS (SELECT asset, b, count(*) FILTER (state = 0) AS n0, count(*) FILTER (state = 1) AS n1, stddev_samp(ret) FILTER (state = 0) AS s0, stddev_samp(ret) FILTER (state = 1) AS s1 FROM rows JOIN pos USING (asset, i) GROUP BY asset, b),
ratios AS (SELECT asset, CASE WHEN n0 >= 2 AND n1 >= 2 AND s0 > 0 THEN s1 / s0 END AS ratio FROM sums)
SELECT asset, count(ratio) AS n, CASE WHEN count(ratio) >= 50 THEN round(quantile_cont(ratio, 0.025), 6) END AS low, CASE WHEN count(ratio) >= 50 THEN round(quantile_cont(ratio, 0.975), 6) END AS high FROM ratios GROUP BY asset"""


@query(_BOOT)
def block_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = separation.block_bootstrap(B.states(spark, sf_dir), draws=_DRAWS)
    return separation.quantile_interval(ratios, "ratio", ["asset"]).select("asset", "n", *places("low", "high"))


@query(f"WITH {B.FEAT} SELECT asset, count(ret) AS n, round(quantile_cont(ret, 0.025), 6) AS low, round(quantile_cont(ret, 0.975), 6) AS high FROM feat GROUP BY asset")
def percentile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separation.quantile_interval(B.features(spark, sf_dir), "ret", ["asset"], least=1).select("asset", "n", *places("low", "high"))


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.episodes(B.states(spark, sf_dir)).filter("run > 0 AND length >= 30").select("asset", F.col("start").alias("d"))


@query(f"""WITH {B.EPISODES}, tr AS (SELECT asset, s AS d FROM episodes WHERE run > 0 AND length >= 30),
cand AS (SELECT tr.asset, tr.d AS matched_to, st.d, date_diff('day', tr.d, st.d) AS off FROM tr JOIN st USING (asset) WHERE abs(date_diff('day', tr.d, st.d)) BETWEEN 30 AND 90)
SELECT asset, CAST(matched_to AS VARCHAR) AS matched_to, CAST(d AS VARCHAR) AS d, off AS offset_days,
  (SELECT min(abs(date_diff('day', x.d, cand.d))) FROM tr x WHERE x.asset = cand.asset) AS days_to_nearest
FROM cand WHERE NOT EXISTS (SELECT 1 FROM tr x WHERE x.asset = cand.asset AND abs(date_diff('day', x.d, cand.d)) < 14)""")
def control_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr, st = _transitions(spark, sf_dir), B.states(spark, sf_dir)
    out = placebo.nearest_transition(placebo.control_candidates(tr, st), tr)
    return out.select("asset", *text_days("matched_to", "d"), F.col("offset_days").cast("long").alias("offset_days"), F.col("days_to_nearest").cast("long").alias("days_to_nearest"))


@query()
def placebo_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr, st = _transitions(spark, sf_dir), B.states(spark, sf_dir)
    taken = placebo.sample_controls(placebo.control_candidates(tr, st))
    out = placebo.nearest_transition(taken, tr).join(st.select("asset", "d", "state"), ["asset", "d"])
    return out.withColumn("stratum", placebo.stratum()).select("asset", *text_days("matched_to", "d"), "offset_days", "state", "days_to_nearest", "stratum")


@query()
def placebo_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr, st = _transitions(spark, sf_dir), B.states(spark, sf_dir)
    taken = placebo.nearest_transition(placebo.sample_controls(placebo.control_candidates(tr, st)), tr).join(st.select("asset", "d", "state"), ["asset", "d"])
    return placebo.balance_report(taken.withColumn("stratum", placebo.stratum()), tr)


#: Fits end when the likelihood rises by less than the tolerance, long before this.
ROUNDS = 1000


def _grid(spark: SparkSession, sf_dir: str, seeds: list[int]) -> DataFrame:
    df = B.features(spark, sf_dir).na.drop(subset=["vol", "mom"])
    return materialise(hmm.walk_forward(df, ["vol", "mom"], "vol", train=126, test=42, seeds=seeds, rounds=ROUNDS), "walk")


@query()
def hmm_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, [42]).select("asset", "seed", "fold", *text_days("d"), *places("stressed_prob"), "state", "converged", "error")


@query()
def hmm_in_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.features(spark, sf_dir).na.drop(subset=["vol", "mom"])
    return hmm.in_sample(df, ["vol", "mom"], "vol", rounds=ROUNDS).select("asset", *text_days("d"), "state")


@query()
def stable_regimes_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From prices to transitions that most seeds agree on."""
    seeds = list(range(42, 52))
    got = _grid(spark, sf_dir, seeds).filter("d IS NOT NULL")
    by = ["asset", "seed"]
    kept = regimes.persistence_filter(got, 5, by=by)
    tr = regimes.extract_transitions(kept, by=by, fold="fold")
    return regimes.stable_transitions(tr, n_seeds=len(seeds)).select("asset", *text_days("d"), "to_state", *places("support"), "n_members", "dwell_after")


@query()
def hmm_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward states with each form of the covariances."""
    df = materialise(B.features(spark, sf_dir).na.drop(subset=["vol", "mom"]).select("asset", "d", "vol", "mom"), "features")
    out = None
    for form in hmm.FORMS:
        one = hmm.walk_forward(df, ["vol", "mom"], "vol", train=126, test=42, rounds=ROUNDS, form=form).withColumn("form", F.lit(form))
        out = one if out is None else out.unionByName(one)
    return out.select("form", "asset", "fold", *text_days("d"), *places("stressed_prob"), "state", "error")


@query()
def generalisation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series of daily totals by priority, and one too short for a fold, met with the shared level and credit series."""
    px = B.prices(spark, sf_dir)
    short = px.filter("d < DATE '1995-03-01'").withColumn("asset", F.lit("short"))
    short = short.groupBy("asset", "d").agg(F.sum(F.col("px").cast("decimal(18,2)")).cast("double").alias("px"))
    out = generalise.generalisation(px.unionByName(short), B.levels(spark, sf_dir), lambda x: materialise(x, "walk"), 126, 42, rounds=ROUNDS)
    measures = [c for c in generalise.MEASURES if not c.startswith("n_")]
    return out.select("asset", "n_days", "n_folds", "n_calm", "n_stressed", *places(*measures), "error")


@query(f"""WITH {B.EPISODES}, e AS (SELECT asset, state, length::DOUBLE AS x FROM episodes), m AS (SELECT asset, state, min(x) AS low, greatest(max(x), 2) AS high FROM e GROUP BY ALL),
c AS (SELECT asset, state, CASE WHEN high > low THEN least(floor(17 * ln(x / low) / ln(high / low) + 1e-9), 16) ELSE 16 END AS bin, count(*) AS n FROM e JOIN m USING (asset, state) GROUP BY ALL)
SELECT m.asset, m.state, CAST(b.bin AS INT) AS bin, round(low * exp(ln(high / low) * b.bin / 17), 6) AS low, round(low * exp(ln(high / low) * (b.bin + 1) / 17), 6) AS high, coalesce(n, 0) AS n
FROM m CROSS JOIN range(0, 17) AS b(bin) LEFT JOIN c ON c.asset = m.asset AND c.state = m.state AND c.bin = b.bin""")
def episode_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode lengths in bins that are equal in the logarithm."""
    out = regimes.log_histogram(series.episodes(B.states(spark, sf_dir)))
    return out.select("asset", "state", "bin", *places("low", "high"), "n")
