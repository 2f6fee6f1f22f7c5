"""The evidence pipeline: from days and dated items to windows, a holdout split, stored explanations and what is measured on them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import audit, bm25, inference, windows
from tidemark.plans import bindings as B
from tidemark.plans.registry import places, query, text_days
from tidemark.sources.tables import materialise


@dataclass(frozen=True)
class Settings:
    """Parameters of a run."""

    window_days: int = 14
    fraction: float = 0.5
    seed: int = 7
    threshold: float = 0.25
    permutations: int = 10_000
    sections: Sequence[str] = field(default_factory=tuple)
    max_items: int | None = None

    def __post_init__(self) -> None:
        if self.window_days < 1 or not 0 < self.fraction < 1 or self.permutations < 1 or (self.max_items or 1) < 1:
            raise ValueError("window_days, permutations and max_items must be positive, fraction between 0 and 1")


def in_sections(section: Column, names: Sequence[str], inside: bool = True) -> Column:
    """Whether an item's section is one of the names, whatever their case."""
    found = F.lower(F.coalesce(section, F.lit(""))).isin([n.lower() for n in names])
    return found if inside else ~found


def build_windows(days: DataFrame, items: DataFrame, settings: Settings, ties: Sequence[str] = ()) -> DataFrame:
    """Items of each window once, in roles generation and holdout. days: (boundary, kind); the section filter comes before the windows. With max_items a
    window has that many at most, evenly spread, and truncated_from says how many there were (null where nothing was left out). ties: columns that decide between rows of one item and time.
    Items without texts will do: what is measured on the windows takes texts apart (see `match_arms`), so that a text isn't copied to each window that holds it."""
    if settings.sections:
        items = items.filter(in_sections(F.col("section"), settings.sections))
    windowed = windows.items_in_windows(items, days, settings.window_days)
    windowed = windows.first_of_each(windowed, ties=ties)
    if settings.max_items:
        sizes = windowed.groupBy("boundary").agg(F.count("*").alias("_n"))
        windowed = windows.truncate_evenly(windowed, settings.max_items).join(sizes, "boundary")
        windowed = windowed.withColumn("truncated_from", F.when(F.col("_n") > settings.max_items, F.col("_n"))).drop("_n")
    return windows.holdout_split(windowed, settings.fraction, settings.seed).join(days.dropDuplicates(["boundary"]), "boundary")


def _said(df: DataFrame, text: str, title: str) -> Column:
    """An item's text, or its title where it has none."""
    own = F.coalesce(F.col(text), F.lit(""))
    return F.when(own != "", own).otherwise(F.coalesce(F.col(title), F.lit(""))) if title in df.columns else own


def _whole(df: DataFrame, text: str, title: str = "title") -> Column:
    own = F.coalesce(F.col(text), F.lit(""))
    return F.concat_ws("\n", F.coalesce(F.col(title), F.lit("")), own) if title in df.columns else own


def body(df: DataFrame, text: str = "text", title: str = "title") -> Column:
    """Title and text of an item, as a matcher reads it."""
    return F.regexp_replace(_whole(df, text, title), r"^\s+|\s+$", "")


#: What a prompt begins with, and what stands between its items. Fixed values.
HEADING, BETWEEN = "There are %d items, covering a window of {days} days. Day {days} is the day the model flagged.\n", "\n\n"


def _line(df: DataFrame, text: str, section: str, title: str) -> tuple[Column, Column]:
    """What stands before and after the day in an item's lines."""
    mark = F.when(F.coalesce(F.col(section), F.lit("")) != "", F.concat(F.lit(" | "), F.col(section))).otherwise("")
    return F.concat(F.lit("["), F.col("item_id").cast("string"), F.lit("] Day ")), F.concat(mark, F.lit("\n"), T.strip_dates(_said(df, text, title)))


def render(windowed: DataFrame, text: str = "text", section: str = "section", title: str = "title", window_days: int = 14, days: DataFrame | None = None) -> DataFrame:
    """(boundary, n_items, prompt): a heading and the items of each window as they are shown, without dates; an item without text shows its title. days: all
    boundaries, of which those without items are told so. A prompt is one row, as a model is asked; for windows beyond that, see `prompt_digests`."""
    before, after = _line(windowed, text, section, title)
    line = F.concat(before, F.col("day_index").cast("string"), after)
    shown = windows.ordered_text(windowed.withColumn("_line", line), "_line", name="_shown", sep=BETWEEN)
    out = shown.join(windowed.groupBy("boundary").agg(F.count("*").alias("n_items")), "boundary")
    if days is not None:
        out = days.select("boundary").distinct().join(out, "boundary", "left").na.fill(0, ["n_items"])
    heading = F.format_string(HEADING.format(days=window_days), F.col("n_items"))
    prompt = F.when(F.col("n_items") > 0, F.concat(heading, F.col("_shown"))).otherwise("(no items were published in this window)")
    return out.select("boundary", "n_items", prompt.alias("prompt"))


def prompt_digests(items: DataFrame, boundaries: DataFrame, text: str = "text", section: str = "section", title: str = "title", window_days: int = 14) -> DataFrame:
    """(boundary, n_items, h): the MD5 of each prompt that `render` gives for the windows of these items; windows without items give no row.

    No window is ever one row: an item is written once, among those of its minute; a minute goes as one text to each window that holds it, and a task
    that reads a window's minutes in order keeps nothing but the state of the digest. What is broadcast are the windows' days."""
    late = F.col("published") > windows.last_instant(F.to_date("published"))
    dated = items.filter(F.col("published").isNotNull()).withColumns({"day": F.to_date("published"), "_late": late})
    # On its own day a boundary's window ends before what is late.
    here = ~F.col("_late") | (F.col("day") < F.col("boundary"))
    spread = windows.window_days(boundaries, window_days)
    totals = dated.groupBy("day", "_late").agg(F.count("*").alias("_n")).join(spread, "day").filter(here).groupBy("boundary").agg(F.sum("_n").alias("n_items"))
    before, after = _line(dated, text, section, title)
    row = F.struct("published", "item_id", before.alias("before"), after.alias("after"))
    minutes = dated.groupBy("day", windows.time_bucket(dated, ["published", "item_id"]).alias("_minute"), "_late").agg(F.array_sort(F.collect_list(row)).alias("_all"))
    placed = minutes.join(F.broadcast(spread.join(totals, "boundary")), "day").filter(here)
    day = (F.datediff("day", F.date_sub("boundary", window_days - 1)) + 1).cast("string")
    shown = F.array_join(F.transform("_all", lambda x: F.concat(x["before"], day, x["after"])), BETWEEN)
    parts = placed.select("boundary", "day", "_minute", "_late", "n_items", shown.alias("_shown")).repartition("boundary").sortWithinPartitions("boundary", "day", "_minute", "_late")
    heading = HEADING.format(days=window_days)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, state = None, 0, None
        row = lambda: pa.RecordBatch.from_pydict({"boundary": pa.array([now], pa.date32()), "n_items": pa.array([n], pa.int64()), "h": [state.hexdigest()]})
        for b in batches:
            for boundary, size, said in zip(*(c.to_pylist() for c in b.columns)):
                if boundary != now:
                    if state:
                        yield row()
                    now, n, state = boundary, size, hashlib.md5((heading % size).encode())
                else:
                    state.update(BETWEEN.encode())
                state.update(said.encode())
        if state:
            yield row()

    return parts.select("boundary", "n_items", "_shown").mapInArrow(digests, "boundary date, n_items long, h string")


def explanation() -> Column:
    """What is matched of a narrative: summary, mechanism and the text of its claims."""
    claims = F.transform(F.coalesce(F.col("claims"), F.array().cast("array<struct<claim:string,item_ids:array<string>>>")), lambda c: F.coalesce(c["claim"], F.lit("")))
    return F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("mechanism", F.lit("")), F.array_join(claims, " "))


#: Sections of the arm that keeps to business, in lower case. Fixed values.
BUSINESS = ("business and economy", "economics and business", "business")


def one_text_each(texts: DataFrame) -> DataFrame:
    """The row of each item_id that is least by the other columns, in their order."""
    first, *rest = [c for c in texts.columns if c != "item_id"]
    return windows.first_of_each(texts, published=first, by=(), ties=rest)


def match_arms(explanations: DataFrame, windowed: DataFrame, arms: Column, text: str = "text", texts: DataFrame | None = None) -> DataFrame:
    """(arm, query_id, n_candidates, rank, predicted, score) of each window's explanation (boundary, explanation) among the held-out texts of an arm. arms: the names
    of the arms (an array) that an item is in. Windows without held-out text, or whose explanation says nothing once it is scrubbed, leave
    the pool. All arms share one index, with the arm in its key. texts: item_id with its text, and title if it has one, where windowed has
    none (see `one_text_each` for ids with several rows). A text's words are taken once, whatever the number of its arms, and, where texts are given, of its windows."""
    key = F.date_format("boundary", "yyyy-MM-dd")
    asked = explanations.withColumn("_scrubbed", T.strip_identifying(F.coalesce("explanation", F.lit("")))).filter(F.trim("_scrubbed") != "")
    asked = asked.select(key.alias("query_id"), T.tokens(F.col("_scrubbed")).alias("terms"))
    held = windowed.filter("role = 'holdout'")
    if texts is None:
        held = held.withColumn("places", F.transform(arms, lambda a: F.struct(a.alias("arm"), key.alias("doc_id"))))
    else:
        each = held.select("item_id", key.alias("doc_id"), F.explode(arms).alias("arm"))
        held = materialise(each.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("arm", "doc_id"))).alias("places")), "held")
    # Many items are part of the same documents: such a set of documents has a number, by which terms are counted.
    sets = materialise(held.select("places").distinct().withColumn("_set", F.monotonically_increasing_id()), "sets")
    few = (sets.agg(F.sum(F.size("places"))).first()[0] or 0) <= bm25.BROADCAST
    held = held.join(sets.hint("broadcast" if few else "merge"), "places").drop("places")
    if texts is not None:
        held = held.join(one_text_each(texts), "item_id")
    # What `body` trims holds no words, and a text with nothing else is none.
    said = held.withColumn("_whole", _whole(held, text)).filter(F.col("_whole").rlike(r"\S"))
    # A window's text is never one row: its items bring their terms, and are counted together.
    counts = bm25.count_terms(said.select("_set", T.tokens(F.col("_whole")).alias("terms")), asked, "_set")
    docs = counts.join(sets, "_set").select(F.inline("places"), "term", "tf").join(asked.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi")
    docs = materialise(docs.groupBy("arm", "doc_id", "term").agg(F.sum("tf").alias("tf")), "counts")
    told = materialise(asked.join(docs.select("arm", F.col("doc_id").alias("query_id")).distinct(), "query_id"), "asked")
    scored = materialise(bm25.scores(told, docs, by=["arm"], counted=True), "scores")
    return bm25.match_ranks(told, docs, by=["arm"], scored=scored)


def match_arm(explanations: DataFrame, windowed: DataFrame, text: str = "text") -> DataFrame:
    """match_arms over all items of all windows, in one arm."""
    return match_arms(explanations, windowed, F.array(F.lit("all")), text).drop("arm")


def standard_arms(business: Sequence[str] = BUSINESS) -> Column:
    """Transitions with all sections, transitions with business sections alone, all windows."""
    transition, inside = F.col("kind") == "transition", in_sections(F.col("section"), business)
    names = F.array(
        F.when(transition, "transitions_all_sections"), F.when(transition & inside, "transitions_business_only"), F.lit("all_windows")
    )
    return F.array_compact(names)


def confident_test(narratives: DataFrame, kind: str = "kind", flag: str = "is_confident") -> DataFrame:
    """(a, b, c, d, p): transitions that are confident and not, controls that are and not, and Fisher's p (null where either kind is missing)."""
    transition, on = F.col(kind) == "transition", F.coalesce(F.col(flag), F.lit(False))
    cells = [(transition & on, "a"), (transition & ~on, "b"), (~transition & on, "c"), (~transition & ~on, "d")]
    return inference.fisher_exact(narratives.agg(*[F.count_if(c).alias(n) for c, n in cells]))


def measure(days: DataFrame, windowed: DataFrame, narratives: DataFrame, settings: Settings, text: str = "text", business: Sequence[str] = BUSINESS, texts: DataFrame | None = None) -> dict[str, DataFrame]:
    """match, match_summary and permutation (by arm), claims, faithfulness, rates and fisher. narratives: (boundary, summary, mechanism, claims, is_confident). Claims
    are audited against the generation half, which is all that an explanation was made from: a held-out item can't be cited. texts: see `match_arms`."""
    ranks = match_arms(narratives.withColumn("explanation", explanation()), windowed, standard_arms(business), text, texts)
    each = narratives.select("boundary", F.posexplode("claims").alias("pos", "c"))
    claims = each.select(F.col("boundary").alias("window_id"), F.concat_ws(":", F.date_format("boundary", "yyyy-MM-dd"), F.col("pos").cast("string")).alias("claim_id"), F.col("c.claim").alias("claim"), F.col("c.item_ids").alias("item_ids"))
    shown = windowed.filter("role = 'generation'")
    items = shown.select(F.col("boundary").alias("window_id"), F.col("item_id").cast("string").alias("item_id"), *([text] if texts is None else []))
    if texts is not None:
        # Of all texts only those that a claim cites are looked up.
        cited = bm25.if_small(claims.select("window_id", F.explode("item_ids").alias("item_id")).distinct())
        own = one_text_each(texts.withColumn("item_id", F.col("item_id").cast("string")).join(cited, "item_id", "left_semi"))
        items = materialise(items.join(cited, ["window_id", "item_id"], "left_semi").join(own.select("item_id", text), "item_id"), "cited")
    audited = audit.audit_claims(claims, items, settings.threshold, text=text)
    told = narratives.join(days, "boundary")
    return {
        "match": ranks,
        "match_summary": bm25.match_summary(ranks, by=["arm"]),
        "permutation": bm25.permutation_p(ranks, settings.permutations, settings.seed, by=["arm"]),
        "claims": audited,
        "faithfulness": audit.faithfulness(audited),
        "rates": inference.rates(told, "is_confident", ["kind"]),
        "fisher": confident_test(told),
    }


def run(days: DataFrame, items: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """Retrieval and what needs no explanation: `windowed` (items in roles), `manifest`, and `targets`: every date asked for, once, with its
    kind, how many items it has, and a warning where its window is empty. A date that is both a transition and a control is a
    transition."""
    kind = F.when(F.max((F.col("kind") == "transition").cast("int")) == 1, "transition").otherwise(F.min("kind"))
    asked = days.filter(F.col("boundary").isNotNull()).groupBy("boundary").agg(kind.alias("kind"))
    windowed = build_windows(asked, items, settings)
    late = F.count_if(F.col("published") > windows.last_instant(F.col("boundary")))
    held = F.count_if(F.col("role") == "holdout")
    sizes = windowed.groupBy("boundary").agg(F.count("*").alias("n_items"), held.alias("n_holdout"), late.alias("n_late"))
    targets = asked.join(sizes, "boundary", "left").na.fill(0, ["n_items", "n_holdout", "n_late"])
    targets = targets.withColumn("warning", F.when(F.col("n_items") == 0, F.lit("window is empty; skipped")))
    return {"windowed": windowed, "manifest": windows.manifest(windowed), "targets": targets}


def to_records(days: DataFrame, windowed: DataFrame, narratives: DataFrame, faithful: DataFrame) -> DataFrame:
    """One flat row per window, by kind and day; windows without a narrative or audit are kept."""
    sizes = windowed.groupBy("boundary").agg(F.count("*").alias("n_items"), F.count_if(F.col("role") == "holdout").alias("n_holdout"))
    told = narratives.select("boundary", "driver_identified", "confidence", "summary", "mechanism", F.size("claims").alias("n_claims"))
    out = days.join(sizes, "boundary", "left").join(told, "boundary", "left").join(faithful.select(F.col("window_id").alias("boundary"), "grounded_rate", "mean_overlap"), "boundary", "left")
    return out.withColumn("window_id", F.concat_ws("_", "kind", F.date_format("boundary", "yyyy-MM-dd"))).orderBy("kind", "boundary")


def estimate_cost(windows_: int, settings: Settings, per_page: float = 1.15, per_call: float = 35.0, tokens_in: int = 5300, tokens_out: int = 1500) -> dict[str, float]:
    """Pages, seconds and tokens of retrieving and explaining so many windows."""
    pages = windows_ * settings.window_days
    return {"pages": pages, "seconds": pages * per_page + windows_ * per_call, "tokens_in": windows_ * tokens_in, "tokens_out": windows_ * tokens_out}


@query()
def evidence_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over documents dealt to 30 days, with the first item of each window's generation half as its explanation."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id IS NOT NULL")
    items = docs.select(F.col("doc_id").alias("item_id"), F.expr("timestamp_seconds(1704067200 + doc_id % 30 * 86400 + 43200)").alias("published"), F.col("lang").alias("section"), "text")
    days = items.select(F.to_date("published").alias("boundary")).distinct().withColumn("kind", F.when(F.dayofmonth("boundary") % 2 == 0, "transition").otherwise("placebo"))
    days = materialise(days, "days")
    settings = Settings(window_days=3)
    # Windows hold no texts. Of rows that share an id the least counts, here as there.
    windowed = materialise(build_windows(days, items.drop("text"), settings, ties=["section"]), "windows")
    first = windowed.filter("role = 'generation'").groupBy("boundary").agg(F.min_by("item_id", F.struct("published", "item_id")).alias("item_id"))
    first = first.join(one_text_each(items.join(bm25.if_small(first.select("item_id")), "item_id", "left_semi")), "item_id")
    claim = F.array(F.struct(F.substring_index("text", ".", 2).alias("claim"), F.array(F.col("item_id").cast("string")).alias("item_ids")))
    told = first.select("boundary", F.col("text").alias("summary"), F.lit("").alias("mechanism"), claim.alias("claims"), F.lit(True).alias("driver_identified"), F.lit("high").alias("confidence"), F.lit(True).alias("is_confident"))
    told = materialise(told, "told")
    got = measure(days, windowed, told, settings, texts=items)
    out = to_records(days, windowed, told, got["faithfulness"]).drop("summary")
    ranks = got["match"].filter("arm = 'all_windows'").select(F.to_date("query_id").alias("boundary"), "rank", "n_candidates")
    return out.join(ranks, "boundary", "left").select(*text_days("boundary"), "kind", "window_id", "n_items", "n_holdout", "confidence", "n_claims", *places("grounded_rate", "mean_overlap"), "rank", "n_candidates")


@query(f"WITH {B.ITEMS} SELECT CAST(boundary AS VARCHAR) AS boundary, count(*) AS n_items, CAST(min(published) AS VARCHAR)[1:19] AS first_published, CAST(max(published) AS VARCHAR)[1:19] AS last_published FROM win GROUP BY boundary")
def window_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = windows.items_in_windows(B.items(spark, sf_dir), B.boundaries(spark, sf_dir))
    m = windows.manifest(win)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return m.select(*text_days("boundary"), "n_items", stamp("first_published"), stamp("last_published"))
