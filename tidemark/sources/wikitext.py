"""Pages of current events: revisions as of a day, and their lines as items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import clean_markup, links, page_title

#: Shape of a landed API response; other fields are ignored.
RESPONSE = """query struct<pages array<struct<pageid bigint, title string, missing boolean,
revisions array<struct<revid bigint, parentid bigint, timestamp string, size bigint, slots struct<main struct<content string>>>>>>>"""


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(title, missing, revid, ts, size, content) from landed JSON responses, one file each; files that aren't such JSON give no rows."""
    raw = spark.read.schema(RESPONSE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    pages = raw.select(F.explode("query.pages").alias("p"))
    rows = pages.select("p.title", F.coalesce("p.missing", F.lit(False)).alias("missing"), F.explode_outer("p.revisions").alias("r"))
    content = F.col("r.slots.main.content")
    return rows.select("title", "missing", F.col("r.revid").alias("revid"), F.try_to_timestamp("r.timestamp").alias("ts"), F.coalesce("r.size", F.length(content).cast("long")).alias("size"), content.alias("content"))


def lines_of(pages: DataFrame, key: str = "page", text: str = "wikitext") -> DataFrame:
    """(key, n, line): the lines that aren't blank, numbered within each page, trimmed."""
    rows = pages.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n", "line"))
    return rows.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).filter(F.col("line") != "")


def parse_items(pages: DataFrame, key: str = "page", text: str = "wikitext", least: int = 25, legacy_sections: bool = False) -> DataFrame:
    """(key, n, section, topic, text, sources): the news items of each page. A line that starts with ; opens a section (without legacy_sections also one that is bold as a whole);
    a line with one * is a topic if the next has more, else an item; deeper lines are items under the topic above. Items shorter than `least` characters go."""
    rows = lines_of(pages, key, text)
    bold = F.lit(False) if legacy_sections else F.rlike("line", F.lit(r"^'''[^']+'''$"))
    heading = F.startswith("line", F.lit(";")) | bold
    depth = F.length(F.regexp_extract("line", r"^(\**)", 1))
    rows = rows.withColumns({"_head": heading, "_depth": depth, "_body": F.regexp_replace("line", r"^[*;]+\s*", "")}).filter(F.col("_head") | (F.col("_depth") > 0))
    up = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_block", F.sum(F.col("_head").cast("int")).over(up)).withColumn("section", F.coalesce(F.last(F.when(F.col("_head"), clean_markup(F.col("_body"))), True).over(up), F.lit("")))
    within = Window.partitionBy(key, "_block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_topic", F.coalesce(F.last(F.when(F.col("_depth") == 1, clean_markup(F.col("_body"))), True).over(within), F.lit("")))
    items = rows.filter(~F.col("_head"))
    deeper = F.coalesce(F.lead("_depth").over(Window.partitionBy(key).orderBy("n")) > 1, F.lit(False))
    items = items.withColumn("_parent", (F.col("_depth") == 1) & deeper).filter(~F.col("_parent"))
    items = items.withColumns({"text": clean_markup(F.col("_body")), "sources": links(F.col("_body")), "topic": F.when(F.col("_depth") > 1, F.col("_topic")).otherwise("")})
    return items.filter(F.length("text") >= least).select(key, "n", "section", "topic", "text", "sources")


def day_pages(days: DataFrame, day: str = "day") -> DataFrame:
    """days with the title of each day's page."""
    return days.withColumn("page", page_title(F.col(day)))


def as_news(items: DataFrame, day: str = "day", source: str = "current events") -> DataFrame:
    """Parsed items as dated items: published at noon UTC of their day, title from topic or section, url from the first source."""
    title = F.substring(F.coalesce(F.nullif("topic", F.lit("")), F.nullif("section", F.lit("")), F.lit("Current events")), 1, 200)
    noon = F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 12:00:00")))
    return items.withColumns({"source": F.lit(source), "published": noon, "title": title, "url": F.coalesce(F.get("sources", F.lit(0))["url"], F.lit(""))})
