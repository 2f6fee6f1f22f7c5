"""Whether claims rest on the items they cite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import content_tokens

THRESHOLDS = (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5)


def cited_items(claims: DataFrame, items: DataFrame, cited: str = "item_ids", item: str = "item_id", window: str = "window_id", claim: str = "claim_id") -> DataFrame:
    """(window, claim, item, valid): each citation, and whether the item is in the claim's window."""
    each = claims.select(window, claim, F.explode(cited).alias(item)).distinct()
    known = items.select(window, item).distinct().withColumn("valid", F.lit(True))
    return each.join(known, [window, item], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def audit_claims(claims: DataFrame, items: DataFrame, threshold: float = 0.25, text: str = "text", claim_text: str = "claim", cited: str = "item_ids", item: str = "item_id", window: str = "window_id", claim: str = "claim_id") -> DataFrame:
    """(window, claim, n_cited, n_fabricated, overlap, status). overlap: share of the claim's content words that the valid cited items hold (0 without such words).
    status: uncited without citations, fabricated_citation where none is valid, grounded from the threshold on, else ungrounded."""
    links = cited_items(claims, items, cited, item, window, claim)
    needed = links.filter("valid").select(window, item).distinct()
    words = items.join(needed, [window, item], "left_semi").select(window, item, content_tokens(F.col(text)).alias("_w"))
    held = links.filter("valid").join(words, [window, item]).groupBy(window, claim).agg(F.array_distinct(F.flatten(F.collect_list("_w"))).alias("_held"))
    counts = links.groupBy(window, claim).agg(F.count("*").alias("n_cited"), F.count_if(~F.col("valid")).alias("n_fabricated"))
    out = claims.select(window, claim, content_tokens(F.col(claim_text)).alias("_c")).join(counts, [window, claim], "left").join(held, [window, claim], "left")
    n = F.size("_c")
    overlap = F.when((n > 0) & F.col("_held").isNotNull(), F.size(F.array_intersect("_c", "_held")) / n).otherwise(F.lit(0.0))
    out = out.select(window, claim, F.coalesce("n_cited", F.lit(0)).alias("n_cited"), F.coalesce("n_fabricated", F.lit(0)).alias("n_fabricated"), overlap.alias("overlap"))
    return out.withColumn("status", status_of(threshold))


def status_of(threshold: float | Column) -> Column:
    return F.when(F.col("n_cited") == 0, "uncited").when(F.col("n_fabricated") == F.col("n_cited"), "fabricated_citation").when(F.col("overlap") >= threshold, "grounded").otherwise("ungrounded")


def faithfulness(audited: DataFrame, by: Sequence[str] = ("window_id",)) -> DataFrame:
    """Counts by status, rates and mean overlap. n_with_fabricated counts claims with any unknown citation; n_fabricated_only those without a known one."""
    of = lambda s: F.count_if(F.col("status") == s)
    return audited.groupBy(*by).agg(
        F.count("*").alias("n_claims"), of("grounded").alias("n_grounded"), of("ungrounded").alias("n_ungrounded"), of("uncited").alias("n_uncited"), of("fabricated_citation").alias("n_fabricated_only"),
        F.count_if(F.col("n_fabricated") > 0).alias("n_with_fabricated"), F.avg((F.col("status") == "grounded").cast("int")).alias("grounded_rate"), F.avg("overlap").alias("mean_overlap"),
    )


def pooled(audited: DataFrame, kind: str = "kind") -> DataFrame:
    """faithfulness over all claims and for each kind, in one pass; the total has the kind `all`."""
    name = F.when(F.grouping(kind) == 1, "all").otherwise(F.col(kind))
    of = lambda s: F.count_if(F.col("status") == s)
    return (
        audited.groupingSets([[], [kind]], kind)
        .agg(name.alias("pool"), F.count("*").alias("n_claims"), of("grounded").alias("n_grounded"), F.avg((F.col("status") == "grounded").cast("int")).alias("grounded_rate"), F.avg("overlap").alias("mean_overlap"))
        .drop(kind)
    )


def threshold_sweep(audited: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Claims grounded at each threshold; overlaps are taken once."""
    each = audited.drop("status").withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return each.withColumn("status", status_of(F.col("threshold"))).groupBy("threshold").agg(F.count("*").alias("n_claims"), F.count_if(F.col("status") == "grounded").alias("n_grounded"), F.avg((F.col("status") == "grounded").cast("int")).alias("grounded_rate"))


def random_citation_floor(claims: DataFrame, items: DataFrame, draws: int = 10, seed: int = 7, threshold: float = 0.25, text: str = "text", claim_text: str = "claim", item: str = "item_id", window: str = "window_id", claim: str = "claim_id") -> DataFrame:
    """(window, claim, draw, overlap, grounded): the overlap of claims with one item of their own window chosen by a hash, `draws` times; claims without content words are left out."""
    ranked = items.select(window, item, content_tokens(F.col(text)).alias("_w"))
    number = F.row_number().over(Window.partitionBy(window).orderBy(item))
    ranked = ranked.withColumn("_k", number - 1)
    sizes = ranked.groupBy(window).agg(F.count("*").alias("_n"))
    each = claims.select(window, claim, content_tokens(F.col(claim_text)).alias("_c")).filter(F.size("_c") > 0).join(sizes, window)
    each = each.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    key = F.concat_ws(":", F.lit(str(seed)), F.col(window).cast("string"), F.col(claim).cast("string"), F.col("draw").cast("string"))
    each = each.withColumn("_k", F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % F.col("_n"))
    out = each.join(ranked.select(window, "_k", "_w"), [window, "_k"])
    return out.select(window, claim, "draw", (F.size(F.array_intersect("_c", "_w")) / F.size("_c")).alias("overlap")).withColumn("grounded", F.col("overlap") >= threshold)
