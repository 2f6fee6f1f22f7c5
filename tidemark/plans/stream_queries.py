"""Queries whose result comes out of a stream: the supplied events in a shuffled order, as files that arrive one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import bindings as B
from tidemark.plans.registry import query, text_days
from tidemark.sources.tables import Scratch, materialise
from tidemark.streaming import closing


def _streamed(spark: SparkSession, sf_dir: str, scratch: Scratch, delay: str) -> DataFrame:
    """The rows that the stream gives for every day with events, and an item long after all others for each source."""
    items = B.items(spark, sf_dir).select("source", "published")
    days = [r.boundary for r in B.boundaries(spark, sf_dir).collect()]  # days of the calendar
    last = items.select("source").distinct().withColumn("published", F.lit("2099-01-01").cast("timestamp"))
    shuffled = items.withColumn("_k", F.xxhash64("source", "published")).repartition(6, "_k").drop("_k")
    scratch.write(shuffled, "arriving")
    folder = f"{scratch.path}/{scratch.count}-arriving"
    last.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 3).parquet(folder)
    name, conf = "spark.sql.streaming.stateStore.providerClass", spark.conf
    before = conf.get(name)
    closing.use_rocksdb(spark)
    try:
        out = closing.closed_windows(stream, days, delay=delay)
        sink = out.writeStream.format("parquet").option("path", f"{scratch.path}/closed").option("checkpointLocation", f"{scratch.path}/state")
        sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(name, before)
    return spark.read.schema(out.schema).parquet(f"{scratch.path}/closed")


_COUNTED = f"""WITH {B.ITEMS}, srcs AS (SELECT DISTINCT source FROM items)"""


@query(_COUNTED + """
SELECT s.source, CAST(boundary AS VARCHAR) AS boundary, count(*) FILTER (CAST(published AS DATE) < boundary - 13) AS n_before,
  count(*) FILTER (CAST(published AS DATE) >= boundary - 13 AND published <= CAST(boundary AS TIMESTAMP) + INTERVAL 86399 SECONDS) AS n_in,
  count(*) FILTER (published > CAST(boundary AS TIMESTAMP) + INTERVAL 86399 SECONDS) + 1 AS n_after
FROM bounds, srcs s JOIN items i ON i.source = s.source GROUP BY ALL""")
def streamed_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that close once all has arrived: what the batch counts, and the last item after them."""
    with Scratch(spark, "stream") as scratch:
        rows = _streamed(spark, sf_dir, scratch, "3650 days").filter("kind = 'closed'")
        return materialise(rows.select("source", *text_days("boundary"), "n_before", "n_in", "n_after"), "closed")


@query(_COUNTED + """
SELECT s.source, CAST(boundary AS VARCHAR) AS boundary, 1 AS n_closed,
  count(*) FILTER (CAST(published AS DATE) >= boundary - 13 AND published <= CAST(boundary AS TIMESTAMP) + INTERVAL 86399 SECONDS) AS n_in
FROM bounds, srcs s JOIN items i ON i.source = s.source GROUP BY ALL""")
def streamed_late_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that close a day after their boundary, while items still come in no order: each closes once, and with the late ones none is lost."""
    with Scratch(spark, "stream") as scratch:
        rows = _streamed(spark, sf_dir, scratch, "1 day")
        sums = rows.groupBy("source", "boundary").agg(F.count_if(F.col("kind") == "closed").alias("n_closed"), F.sum("n_in").alias("n_in"))
        return materialise(sums.select("source", *text_days("boundary"), "n_closed", "n_in"), "closed")
