"""A ledger of stored responses, addressed by what was asked.

An entry's key is the window, a digest of model, prompt and text, and a label that keeps repeated runs apart. What is asked
again with the same words finds its answer, and what has none is a left anti join. Responses come in batches; a merge keeps
the newest entry of each key, reads and rewrites only the partitions (by the digest's first digits) that the batch touches,
and gives the same table however often a batch is merged, in whatever order batches come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import Scratch

KEY = ["window_id", "input_hash", "label"]
LEDGER = "window_id string, input_hash string, label string, answered_at timestamp, response_text string"


def input_hash(model: Column, prompt_sha: Column, text: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of model|prompt|text; null where any is."""
    return F.substring(F.sha2(F.concat(model, F.lit("|"), prompt_sha, F.lit("|"), text).cast("binary"), 256), 1, 16)


def keyed(requests: DataFrame, model: str = "model", prompt_sha: str = "prompt_sha16", text: str = "text", label: str = "label") -> DataFrame:
    """requests with the rest of their key: input_hash, and the label (primary where it is null, blank or missing)."""
    own = F.col(label) if label in requests.columns else F.lit(None)
    name = F.coalesce(F.nullif(F.trim(own.cast("string")), F.lit("")), F.lit("primary"))
    return requests.withColumn("input_hash", input_hash(F.col(model), F.col(prompt_sha), F.col(text))).withColumn("label", name)


def newest(entries: DataFrame) -> DataFrame:
    """One entry of each key: the newest, of equally new ones the greatest text. Entries without a time are the oldest; those without a whole key are left out."""
    order = F.struct(F.col("answered_at").isNotNull(), "answered_at", F.coalesce("response_text", F.lit("")))
    whole = entries.filter(" AND ".join(f"{c} IS NOT NULL" for c in KEY))
    last = F.max_by(F.struct("answered_at", "response_text"), order).alias("e")
    return whole.groupBy(*KEY).agg(last).select(*KEY, "e.*")


class Ledger:
    """The ledger under a folder, partitioned by the first `digits` hex digits of the inputs' digests."""

    def __init__(self, spark: SparkSession, root: str, digits: int = 2):
        self.spark, self.root, self.digits = spark, root.rstrip("/"), digits

    def read(self) -> DataFrame:
        """LEDGER rows; none where nothing has been merged."""
        return self._rows().drop("part")

    def _rows(self) -> DataFrame:
        schema = LEDGER + ", part string"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.root)

    def merge(self, responses: DataFrame) -> None:
        """Take in responses (window_id, input_hash, label, answered_at, response_text; other columns are left out)."""
        columns = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in LEDGER.split(", ")]
        part = F.substring("input_hash", 1, self.digits).alias("part")
        with Scratch(self.spark, "ledger") as scratch:
            new = scratch.write(newest(responses.select(*columns)).select("*", part), "new")
            touched = new.select("part").distinct()  # at most 16 to the power of digits
            held = self._rows().join(F.broadcast(touched), "part", "left_semi").select(*new.columns)
            rows = scratch.write(newest(held.unionByName(new)).select("*", part), "merged")
            if rows.isEmpty():
                return
            out = rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            out.partitionBy("part").parquet(self.root)

    def answered(self, requests: DataFrame) -> DataFrame:
        """requests (with their keys) that have a response, with it."""
        return requests.join(self.read(), KEY)

    def pending(self, requests: DataFrame) -> DataFrame:
        """requests (with their keys) that still lack a response, each key once."""
        return requests.dropDuplicates(KEY).join(self.read().select(*KEY), KEY, "left_anti")
