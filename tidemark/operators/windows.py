"""Windows of dated items that end at a boundary, closed to everything after it.

A boundary's window is `days` calendar days long and ends with the last second of the boundary's day (UTC). Items and
windows meet on the day: each boundary is laid out as its days, so that the join is on equal keys and not on a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def window_days(boundaries: DataFrame, days: int, boundary: str = "boundary") -> DataFrame:
    """(boundary, day): the days of each distinct boundary's window."""
    if days < 1:
        raise ValueError("a window has at least one day")
    dates = boundaries.select(boundary).filter(F.col(boundary).isNotNull()).distinct()
    return dates.withColumn("day", F.explode(F.sequence(F.date_sub(boundary, days - 1), F.col(boundary))))


def last_instant(boundary: Column) -> Column:
    """23:59:59 on the boundary: what is published in the fraction of a second after it is out."""
    return F.to_timestamp(F.concat(F.date_format(boundary, "yyyy-MM-dd"), F.lit(" 23:59:59")))


def items_in_windows(items: DataFrame, boundaries: DataFrame, days: int = 14, published: str = "published", boundary: str = "boundary") -> DataFrame:
    """Items with each boundary whose window holds them, and day_index (1 for the window's first day). An item is in as many windows as hold it."""
    spread = window_days(boundaries, days, boundary)
    out = items.withColumn("day", F.to_date(published)).join(spread, "day")
    out = out.filter(F.col(published) <= last_instant(F.col(boundary)))
    return out.withColumn("day_index", F.datediff("day", F.date_sub(boundary, days - 1)) + 1).drop("day")


def dropped_counts(items: DataFrame, boundaries: DataFrame, days: int = 14, published: str = "published", boundary: str = "boundary") -> DataFrame:
    """For each boundary how many items come before its window, in it and after it. Counted from daily totals, so that items and boundaries aren't crossed."""
    late = F.col(published) > last_instant(F.to_date(published))
    daily = items.filter(F.col(published).isNotNull()).groupBy(F.to_date(published).alias("day")).agg(F.count("*").alias("n"), F.count_if(late).alias("late"))
    whole = F.broadcast(daily.agg(F.sum("n").alias("total")))
    before = daily.withColumn("run", F.sum("n").over(Window.orderBy("day"))).select("day", "run", "late")
    ends = boundaries.select(boundary).distinct().filter(F.col(boundary).isNotNull())
    marks = ends.select(boundary, F.explode(F.array(F.date_sub(boundary, days), F.col(boundary))).alias("at"))
    # The running count up to the last day with items at or before each mark: days and marks in one order.
    both = before.select(F.col("day").alias("at"), "run", "late", F.lit(None).cast("date").alias(boundary)).unionByName(marks.select("at", F.lit(None).cast("long").alias("run"), F.lit(None).cast("long").alias("late"), boundary))
    ordered = Window.orderBy("at", F.col(boundary).isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("upto", F.coalesce(F.last("run", True).over(ordered), F.lit(0))).filter(F.col(boundary).isNotNull())
    out = seen.groupBy(boundary).agg(F.min("upto").alias("n_before"), F.max("upto").alias("_in"))
    out = out.join(daily.select(F.col("day").alias(boundary), "late"), boundary, "left").crossJoin(whole)
    late_here = F.coalesce("late", F.lit(0))
    return out.select(boundary, "n_before", (F.col("_in") - F.col("n_before") - late_here).alias("n_in"), (F.coalesce("total", F.lit(0)) - F.col("_in") + late_here).alias("n_after"))


def check_closed(windowed: DataFrame, published: str = "published", boundary: str = "boundary") -> DataFrame:
    """The rows as they are; reading one that lies after its boundary raises an error."""
    late = F.col(published) > last_instant(F.col(boundary))
    return windowed.filter(F.when(late, F.raise_error(F.lit("an item lies after its window's boundary"))).otherwise(F.lit(True)))


def normalise_time(df: DataFrame, raw: str, zone: str, name: str = "published") -> DataFrame:
    """A timestamp in UTC from local text and the name of its zone; without a zone UTC is assumed, and tz_assumed says so."""
    local = F.try_to_timestamp(raw)
    return df.withColumns({name: F.when(F.col(zone).isNull(), local).otherwise(F.to_utc_timestamp(local, F.coalesce(zone, F.lit("UTC")))), "tz_assumed": F.col(zone).isNull()})


def first_of_each(windowed: DataFrame, item: str = "item_id", published: str = "published", by: Sequence[str] = ("boundary",), ties: Sequence[str] = ()) -> DataFrame:
    """One row for each item of a window: the earliest, of equal ones by `ties`."""
    w = Window.partitionBy(*by, item).orderBy(published, *ties)
    return windowed.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def ranked(windowed: DataFrame, bucket: Column, order: Sequence[Column | str], by: Sequence[str] = ("boundary",)) -> DataFrame:
    """windowed with _i (place in its window from 0) and _n (size of the window). bucket must not fall along `order`: rows are only
    counted by bucket, buckets are put in order, and rows are ordered within a bucket, so that no task sorts a whole window."""
    rows = windowed.withColumn("_b", bucket)
    counts = rows.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    run = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    places = counts.withColumns({"_before": F.sum("_c").over(run) - F.col("_c"), "_n": F.sum("_c").over(Window.partitionBy(*by))}).drop("_c")
    names = {c: f"_p_{c}" for c in (*by, "_b")}
    places = places.withColumnsRenamed(names)
    same = F.lit(True)
    for c, p in names.items():
        same = same & F.col(c).eqNullSafe(F.col(p))
    joined = rows.join(places, same)
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order))
    return joined.withColumn("_i", F.col("_before") + inside - 1).drop("_b", "_before", *names.values())


def holdout_split(windowed: DataFrame, fraction: float = 0.5, seed: int = 7, item: str = "item_id", by: Sequence[str] = ("boundary",)) -> DataFrame:
    """windowed with `role`: of each window max(1, round(n fraction)) items, first by a hash of seed and item, are held out, the rest is for generation.
    The order of rows plays no part. With one item, it is held out."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string")), 256)
    keep = F.greatest(F.lit(1), F.bround(F.col("_n") * fraction).cast("long"))
    rows = ranked(windowed, F.substring(digest, 1, 3), [digest, item], by)
    return rows.withColumn("role", F.when(F.col("_i") < keep, "holdout").otherwise("generation")).drop("_i", "_n")


def id_bucket(df: DataFrame, item: str) -> Column:
    """A bucket that does not fall along the order of ids: ranges of numbers, prefixes of text."""
    kind = df.schema[item].dataType
    if isinstance(kind, T.NumericType):
        return F.floor(F.col(item) / 4096)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("month", item)
    return F.substring(item, 1, 7) if isinstance(kind, T.StringType) else F.lit(0)


def time_bucket(df: DataFrame, order: Sequence[str]) -> Column:
    """A bucket for `order`: the minute, and for rows on the very minute (news that has a day alone is all at noon) ranges of what comes next."""
    if not isinstance(df.schema[order[0]].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.col(order[0])
    minute = F.date_trunc("minute", order[0])
    same = F.col(order[0]) == minute
    return F.struct(minute, ~same, F.when(same, id_bucket(df, order[1]) if len(order) > 1 else F.lit(0)))


def truncate_evenly(windowed: DataFrame, most: int, by: Sequence[str] = ("boundary",), order: Sequence[str] = ("published", "item_id")) -> DataFrame:
    """At most `most` rows of each window, evenly spread: those at the rounded points (half to even) of a line from the first to the last."""
    if most < 1:
        raise ValueError("most must be positive")
    rows = ranked(windowed, time_bucket(windowed, order), order, by)
    if most == 1:
        return rows.filter("_i = 0").drop("_i", "_n")
    # Row i is chosen if some k has bround(k (n-1) / (most-1)) = i: one of the two next to i (most-1) / (n-1).
    k = F.floor(F.col("_i") * (most - 1) / (F.col("_n") - 1))
    at = lambda j: F.bround(j * (F.col("_n") - 1) / (most - 1)).cast("long")
    chosen = (at(k) == F.col("_i")) | ((k + 1 <= most - 1) & (at(k + 1) == F.col("_i")))
    return rows.filter((F.col("_n") <= most) | chosen).drop("_i", "_n")


def as_of(revisions: DataFrame, boundaries: DataFrame, key: str = "page", time: str = "ts", boundary: str = "boundary", payload: Sequence[str] = ()) -> DataFrame:
    """(key, boundary, time, *payload): for each pair of a key and a boundary the last revision at or before the end of the boundary's day, of equal ones the
    largest payload. boundaries has the pairs. Revisions and boundaries are put in one order by key, and the last revision is carried on: no range join."""
    value = F.struct(time, *payload)
    marks = boundaries.select(key, boundary).distinct()
    none = F.lit(None)
    both = revisions.select(key, F.col(time).alias("_t"), value.alias("_v"), none.cast("date").alias(boundary)).unionByName(
        marks.select(key, last_instant(F.col(boundary)).alias("_t"), none.cast(revisions.select(value.alias("v")).schema["v"].dataType).alias("_v"), boundary)
    )
    w = Window.partitionBy(key).orderBy("_t", F.col(boundary).isNotNull(), "_v").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_v", F.last("_v", True).over(w)).filter(F.col(boundary).isNotNull() & F.col("_v").isNotNull())
    return seen.select(key, boundary, *[F.col(f"_v.{c}").alias(c) for c in (time, *payload)])


def hindsight_leak(pinned: DataFrame, latest: DataFrame, key: str = "page", size: str = "size") -> DataFrame:
    """How much of the latest revision was added after the boundary, in per cent of it."""
    now = latest.select(key, F.col(size).alias("latest_size"))
    out = pinned.join(now, key).withColumnRenamed(size, "pinned_size")
    return out.withColumn("pct_added", F.bround(100 * (F.col("latest_size") - F.col("pinned_size")) / F.when(F.col("latest_size") != 0, F.col("latest_size")), 1))


def ordered_text(windowed: DataFrame, text: str, by: Sequence[str] = ("boundary",), order: Sequence[str] = ("published", "item_id"), name: str = "text", sep: str = " ") -> DataFrame:
    """The texts of each window in order, put together."""
    rows = windowed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text")))).alias("_all"))
    return rows.select(*by, F.array_join(F.transform("_all", lambda x: x["_text"]), sep).alias(name))


def manifest(windowed: DataFrame, by: Sequence[str] = ("boundary",), published: str = "published", item: str = "item_id", assumed: str | None = None) -> DataFrame:
    """Per window: items, first and last time, the ids in order, and n_tz_assumed, how many times are in a zone that was assumed (column `assumed`, else 0)."""
    flag = F.count_if(F.col(assumed)) if assumed else F.lit(0).cast("long")
    out = windowed.groupBy(*by).agg(
        F.count("*").alias("n_items"), F.min(published).alias("first_published"), F.max(published).alias("last_published"),
        flag.alias("n_tz_assumed"), F.array_sort(F.collect_list(F.struct(published, item))).alias("_ids"),
    )
    return out.withColumn("item_ids", F.transform("_ids", lambda x: x[item])).drop("_ids")


def page_counts(pages: DataFrame, found: str, by: Sequence[str] = ("boundary",)) -> DataFrame:
    """Per window: pages asked for, and how many are there and missing (null counts as missing)."""
    there = F.coalesce(F.col(found), F.lit(False))
    return pages.groupBy(*by).agg(F.count("*").alias("n_pages"), F.count_if(there).alias("n_ok"), F.count_if(~there).alias("n_missing"))
