"""Supplied tables as the series, windows and claims that the operators work on, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import series, windows
from tidemark.plans.registry import table

#: px: daily order totals by priority. feat: returns, momentum, trailing and forward volatility. st: state 1 above the asset's median volatility.
PX = """px AS (
  SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS px
  FROM orders GROUP BY ALL)"""
FEAT = (
    PX
    + """,
ret AS (SELECT *, px / nullif(lag(px) OVER (PARTITION BY asset ORDER BY d), 0) - 1 AS ret FROM px),
feat AS (
  SELECT *, px / nullif(lag(px, 20) OVER (PARTITION BY asset ORDER BY d), 0) - 1 AS mom,
    CASE WHEN count(ret) OVER t = 20 THEN stddev_samp(ret) OVER t END AS vol,
    CASE WHEN count(ret) OVER f = 20 THEN stddev_samp(ret) OVER f END AS fvol
  FROM ret WINDOW t AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), f AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING))"""
)
STATES = (
    FEAT
    + """,
med AS (SELECT asset, median(vol) AS m FROM feat GROUP BY asset),
st AS (SELECT f.*, CASE WHEN vol > m THEN 1 ELSE 0 END AS state FROM feat f JOIN med USING (asset) WHERE vol IS NOT NULL)"""
)
FOLDED = (
    STATES
    + """,
num AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY d) - 1 AS i FROM st),
cnt AS (SELECT asset, count(*) AS n FROM num GROUP BY asset),
folds AS (SELECT asset, unnest(range(0, CAST(floor((n - 252) / 63.0) AS BIGINT) + 1)) AS fold FROM (SELECT asset, n - 0 AS n FROM cnt) WHERE n >= 315),
fan AS (SELECT num.*, fold, CASE WHEN i < fold * 63 + 252 THEN 'train' ELSE 'test' END AS part
        FROM num JOIN folds USING (asset) WHERE i >= fold * 63 AND i < fold * 63 + 315)"""
).replace("floor((n - 252) / 63.0)", "floor((n - 315) / 63.0)")
EPISODES = (
    STATES
    + """,
flag AS (SELECT *, CASE WHEN state <> lag(state) OVER (PARTITION BY asset ORDER BY d) THEN 1 ELSE 0 END AS changed FROM st),
numbered AS (SELECT *, sum(changed) OVER (PARTITION BY asset ORDER BY d) AS run FROM flag),
episodes AS (SELECT asset, run, min(state) AS state, min(d) AS s, max(d) AS e, count(*) AS length FROM numbered GROUP BY asset, run)"""
)
#: items: events as dated items. bounds: every day with events.
ITEMS = """items AS (SELECT event_id AS item_id, CAST(ts AS TIMESTAMP) AS published, event_type AS source, value FROM events),
bounds AS (SELECT DISTINCT CAST(published AS DATE) AS boundary FROM items),
win AS (
  SELECT i.*, b.boundary, date_diff('day', b.boundary - 13, CAST(published AS DATE)) + 1 AS day_index
  FROM items i JOIN bounds b ON CAST(published AS DATE) BETWEEN b.boundary - 13 AND b.boundary AND published <= CAST(b.boundary AS TIMESTAMP) + INTERVAL 86399 SECONDS)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("d")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("px"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series.simple_return(prices(spark, sf_dir))
    df = series.simple_return(df, lag=20, name="mom")
    return series.forward_vol(series.trailing_vol(df))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features(spark, sf_dir)
    medians = df.groupBy("asset").agg(F.median("vol").alias("m"))
    return df.join(medians, "asset").filter("vol IS NOT NULL").withColumn("state", (F.col("vol") > F.col("m")).cast("int")).drop("m")


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, level, credit): daily mean discount and shipped value."""
    x = table(spark, sf_dir, "lineitem")
    total = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return x.groupBy(F.to_date("l_shipdate").alias("d")).agg((F.sum(F.col("l_discount").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("level"), total.alias("credit"))


LEVELS = """levels AS (
  SELECT CAST(l_shipdate AS DATE) AS d, CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS level, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS credit
  FROM lineitem GROUP BY ALL)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.col("ts").cast("timestamp").alias("published"), F.col("event_type").alias("source"), "value")


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select(F.to_date("published").alias("boundary")).distinct()


#: claims: sentences of the benchmark items; each cites documents of its own window, of another, unknown ones, or none. claim_items: documents dealt to the windows by number.
CLAIMS = """nb AS (SELECT count(*) AS n FROM benchmark),
ib AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k, text FROM benchmark),
sentences AS (SELECT k AS window_id, trim(s) AS claim, pos FROM (SELECT k, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) AS pos FROM ib) WHERE trim(s) <> ''),
claims AS (
  SELECT window_id, window_id * 1000 + pos AS claim_id, claim, CASE WHEN window_id % 2 = 0 THEN 'transition' ELSE 'placebo' END AS kind,
    CASE (window_id + pos) % 4 WHEN 0 THEN [] WHEN 1 THEN [-1] WHEN 2 THEN [window_id, window_id + n, -1] ELSE [window_id + n * 2, window_id + 1] END AS item_ids
  FROM sentences, nb),
claim_items AS (SELECT doc_id % n AS window_id, doc_id AS item_id, text FROM documents, nb)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    n = F.col("n")
    numbered = windows.ranked(b.select("item_id", "text"), windows.id_bucket(b, "item_id"), ["item_id"], by=[])
    numbered = numbered.select("item_id", "text", F.col("_i").cast("long").alias("window_id"))
    numbered = numbered.crossJoin(F.broadcast(b.agg(F.count("*").alias("n"))))  # one row
    s = numbered.select("window_id", "n", F.posexplode(F.split("text", r"\.")).alias("pos", "s")).withColumn("pos", F.col("pos") + 1)
    s = s.select("window_id", "n", "pos", F.trim("s").alias("claim")).filter("claim <> ''")
    w, of = F.col("window_id"), (F.col("window_id") + F.col("pos")) % 4
    ids = (
        F.when(of == 0, F.array().cast("array<long>"))
        .when(of == 1, F.array(F.lit(-1).cast("long")))
        .when(of == 2, F.array(w, w + n, F.lit(-1).cast("long")))
        .otherwise(F.array(w + 2 * n, w + 1))
    )
    return s.select("window_id", (w * 1000 + F.col("pos")).alias("claim_id"), "claim", F.when(w % 2 == 0, "transition").otherwise("placebo").alias("kind"), ids.alias("item_ids"))


def claim_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "benchmark").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "documents").crossJoin(F.broadcast(n)).select((F.col("doc_id") % F.col("n")).alias("window_id"), F.col("doc_id").alias("item_id"), "text")
