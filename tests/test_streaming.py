from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

from tests.test_regimes import two_regimes
from tidemark.operators.hmm import GaussianHmm
from tidemark.streaming import closing, live


def test_live_filter_equals_the_batch_filter(spark, tmp_path):
    x, _ = two_regimes(120)
    model = GaussianHmm.fit(x, 2, 3)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(120)]
    source = tmp_path / "in"
    frame = pd.DataFrame({"asset": "a", "d": days, "u": x[:, 0], "v": x[:, 1]})
    schema = "asset string, d date, u double, v double"
    for k, part in enumerate((frame[:50], frame[50:90], pd.concat([frame[90:], frame[10:11]]))):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source / f"p{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    out = live.live_filter(stream, {"a": model}, ["u", "v"], {"a": 1})
    q = out.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("live").toPandas()
    on_time = got[~got["late"]].sort_values("d")
    assert len(on_time) == 120 and got["late"].sum() == 1
    assert np.allclose(on_time["stressed_prob"].to_numpy(), model.filtered(x)[:, 1])


def arrive(spark, folder, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "source string, published timestamp").coalesce(1).write.parquet(f"{folder}/p{k}")
    return spark.readStream.schema("source string, published timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def finished(spark, stream, path, **options):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    closing.use_rocksdb(spark)
    try:
        out = closing.closed_windows(stream, **options)
        q = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{path}/out").collect()


def test_each_window_closes_once_and_late_items_are_counted(spark, tmp_path):
    day = lambda d, h=12, m=0: dt.datetime(2020, 3, d, h, m)
    edge = dt.datetime(2020, 3, 5, 23, 59, 59, 500_000)
    batches = [
        [("a", day(5)), ("a", day(1)), ("a", edge), ("b", day(2)), ("a", None)],
        [("a", day(7, 0, 1)), ("b", day(3))],
        [("a", day(4)), ("a", day(5, 1)), ("a", day(1)), ("a", edge), ("b", day(9))],
        [("a", day(20))],
    ]
    bounds = [dt.date(2020, 3, 5), dt.date(2020, 3, 5), dt.date(2020, 3, 8), dt.date(2020, 4, 1)]
    got = finished(spark, arrive(spark, str(tmp_path / "in"), batches), tmp_path, boundaries=bounds, days=3, delay="1 day")
    rows = sorted((r.source, r.boundary.day, r.kind, r.n_before, r.n_in, r.n_after) for r in got)
    assert rows == [
        ("a", 5, "closed", 1, 1, 2),  # when the 7th comes: the 1st before; the 5th in; half a second before midnight, and the 7th, after
        ("a", 5, "late", 0, 2, 0),  # the 4th and the 5th again; the 1st and the edge are in no closed window
        ("a", 8, "closed", 7, 1, 1),
        ("b", 5, "closed", 1, 1, 1),  # the 2nd before, the 3rd in, the 9th after
    ]


def test_silent_keys_close_by_a_timer(spark, tmp_path):
    processor = closing.Closing([18322, 18330], 3, 86400.0, 50)
    assert processor.boundaries.tolist() == [18322, 18330] and processor.idle == 50
