"""Timed rows of scripts (tables with a span of minutes in each row), and whether they can be spoken at that pace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A timed row, and what isn't spoken in it.
ROW = r"^\|\s*\*\*(\d):(\d\d)[–-](\d):(\d\d)\*\*\s*\|(.*?)\|(.*?)\|\s*$"
MARKS = r"\*|`|…"
SILENCE, SILENT_SECONDS = "seconds of silence", 3


def timed_rows(scripts: DataFrame, key: str = "script_id", text: str = "text", fastest: float = 120.0) -> DataFrame:
    """(key, pos, start, end, words, seconds, wpm, gap, too_fast) of each timed row: seconds speaking (a written silence is taken off), words a minute (null
    without any seconds), gap: whether it doesn't begin where the row before it ended. Scripts without timed rows give none."""
    lines = scripts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).filter(F.rlike("line", F.lit(ROW)))
    part = lambda k: F.regexp_extract("line", ROW, k)
    at = lambda m, s: part(m).cast("int") * 60 + part(s).cast("int")
    spoken = F.filter(F.split(F.regexp_replace(part(6), MARKS, " "), r"\s+"), lambda w: w != "")
    pause = F.when(F.contains(part(5), F.lit(SILENCE)), SILENT_SECONDS).otherwise(0)
    rows = lines.select(key, "pos", at(1, 2).alias("start"), at(3, 4).alias("end"), F.size(spoken).alias("words"), (at(3, 4) - at(1, 2) - pause).alias("seconds"))
    before = F.lag("end").over(Window.partitionBy(key).orderBy("pos"))
    rows = rows.withColumns({"wpm": F.when(F.col("seconds") > 0, F.col("words") * 60 / F.col("seconds")), "gap": F.coalesce(before != F.col("start"), F.lit(False))})
    return rows.withColumn("too_fast", F.coalesce(F.col("wpm") > fastest, F.lit(True)))


def script_summary(rows: DataFrame, key: str = "script_id", limit: int = 420) -> DataFrame:
    """Per script: rows, the end of the last in seconds, gaps, rows that are too fast, and ok where none of these is amiss."""
    out = rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.max_by("end", "pos").alias("runtime"), F.count_if("gap").alias("n_gaps"), F.count_if("too_fast").alias("n_too_fast"))
    return out.withColumn("ok", (F.col("runtime") <= limit) & (F.col("n_gaps") == 0) & (F.col("n_too_fast") == 0))
