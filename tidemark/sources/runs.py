"""Runs as partitioned tables: what produced a result, the windows it looked at, what was said of them, and what was measured.

A store is a folder with one table for each of TABLES, partitioned by run_id. Runs are written by dynamic partition
overwrite, so that a run replaces only itself, whatever else is written at the same time; the table `runs` comes last, and
a run is there once its row is, and not before all its parts are. Deleting a run drops its partitions, that of `runs` first. A run whose files are damaged
doesn't keep others from being listed or loaded.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import slug
from tidemark.sources.tables import remove

_CLAIMS = "array<struct<claim: string, item_ids: array<string>>>"
#: Columns of each table besides run_id. measures: numbers by name for each measure, such as blind_match.all_windows -> accuracy; no rows by item or window.
TABLES = {
    "windows": "window_id string, kind string, boundary date, n_items long, n_generation long, n_holdout long, window_start timestamp, window_end timestamp, dropped_post_boundary long",
    "narratives": f"window_id string, kind string, driver_identified boolean, confidence string, summary string, mechanism string, claims {_CLAIMS}",
    "records": "window_id string, kind string, boundary date, n_items long, n_holdout long, confidence string, n_claims long, summary string, grounded_rate double, mean_overlap double",
    "runs": "label string, saved_at timestamp, model string, settings map<string, string>, event_dates array<date>, control_dates array<date>, measures map<string, map<string, double>>, warnings array<string>",
}
_ID = re.compile(r"[0-9]{8}-[0-9]{6}_[a-z0-9_-]+")


def run_id(saved_at: Column, label: Column) -> Column:
    """YYYYmmdd-HHMMSS_slug: safe as the name of a folder, and in order of time."""
    return F.concat(F.date_format(saved_at, "yyyyMMdd-HHmmss"), F.lit("_"), slug(label))


class RunStore:
    """Runs under a folder of any store that Spark reaches.

    >>> store = RunStore(spark, "s3a://results/runs")
    >>> store.save(runs, windows=windows, narratives=narratives, records=records)
    >>> store.list().show()
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str, run: str | None = None) -> str:
        return f"{self.root}/{name}" + (f"/run_id={run}" if run is not None else "")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return bool(at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at))

    def table(self, name: str, skip_damaged: bool = False) -> DataFrame:
        """A table of the store with run_id; without rows where nothing has been saved. skip_damaged: files that can't be read count as empty."""
        schema = TABLES[name] + ", run_id string"
        if not self._exists(self._path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("ignoreCorruptFiles", skip_damaged).parquet(self._path(name))

    def save(self, runs: DataFrame, **parts: DataFrame) -> None:
        """Write runs, any number of them at once, with their windows, narratives and records (rows with run_id). runs: the columns of TABLES["runs"], of
        which all but label and saved_at may be missing; run_id is made of these two unless there is one. A run that is there already is replaced as
        a whole: what a part doesn't bring for it is gone."""
        if unknown := parts.keys() - TABLES.keys():
            raise ValueError(f"no such tables: {sorted(unknown)}")
        if "run_id" not in runs.columns:
            runs = runs.withColumn("run_id", run_id(F.col("saved_at"), F.col("label")))
        for old in [r.run_id for r in runs.select("run_id").distinct().collect()]:
            self._check(old)
            self.delete(old)
        for name in [n for n in TABLES if n in parts] + ["runs"]:
            self._write(runs if name == "runs" else parts[name], name)

    def _write(self, rows: DataFrame, name: str) -> None:
        kinds = self.spark.createDataFrame([], TABLES[name]).schema
        columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds]
        # A run's rows come together, but a large run is not one task.
        out = rows.select(*columns, F.col("run_id").cast("string").alias("run_id")).hint("rebalance", "run_id")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(self._path(name))

    @staticmethod
    def _check(run: str) -> None:
        if not _ID.fullmatch(run or ""):
            raise ValueError(f"not the id of a run: {run!r}")

    def list(self) -> DataFrame:
        """(run_id, label, saved_at, model, window_days, n_events, n_controls, n_narratives), newest first."""
        told = self.table("narratives", True).groupBy("run_id").agg(F.count("*").alias("n_narratives"))
        size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
        dates = [F.when(F.col(c).isNull(), 0).otherwise(size(c)).alias(n) for c, n in (("event_dates", "n_events"), ("control_dates", "n_controls"))]
        days = F.element_at("settings", F.lit("window_days")).cast("int").alias("window_days")
        rows = self.table("runs", True).filter(F.col("run_id").rlike(f"^{_ID.pattern}$")).select("run_id", "label", "saved_at", "model", days, *dates)
        out = rows.join(told, "run_id", "left").na.fill(0, ["n_narratives"])
        return out.orderBy(F.desc("saved_at"), F.desc("run_id"))

    def load(self, run: str) -> dict[str, DataFrame] | None:
        """The tables of a run, read from its partitions alone; None if there is no such run."""
        if not _ID.fullmatch(run or "") or not self._exists(self._path("runs", run)):
            return None
        return {name: self.table(name).filter(F.col("run_id") == run) for name in TABLES}

    def delete(self, run: str) -> bool:
        """Drop the partitions of a run; whether there was one."""
        if not _ID.fullmatch(run or "") or not self._exists(self._path("runs", run)):
            return False
        for name in reversed(TABLES):
            remove(self.spark, self._path(name, run))
        return True

    def register(self, database: str) -> None:
        """The tables as tables of the catalogue; to be called again for runs that came or went since."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        for name, schema in TABLES.items():
            if self._exists(self._path(name)):
                at = f"`{database}`.`{name}`"
                self.spark.sql(f"CREATE TABLE IF NOT EXISTS {at} ({schema}, run_id string) USING parquet PARTITIONED BY (run_id) LOCATION '{self._path(name)}'")
                self.spark.sql(f"MSCK REPAIR TABLE {at} SYNC PARTITIONS")
