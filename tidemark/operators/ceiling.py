"""The ceiling of the blind match: how well a perfect explanation could do. Each window's own generation half, scrubbed of
what identifies its time, stands in for its explanation, at several lengths and by section."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import squeeze, strip_identifying, tokens
from tidemark.operators import bm25
from tidemark.sources.tables import Scratch, materialise

#: Words of the stand-in; None is the whole half.
LENGTHS = (60, 120, 200, 400, 800, None)


def proxy_terms(
    generation: DataFrame, words: int | None, text: str = "text", by: str = "boundary", order: Sequence[str] = ("published", "item_id"), seed: int = 7, arms: Sequence[str] = (),
) -> DataFrame:
    """(*arms, by, terms): for each window, within columns that tell arms apart, terms of `words` words in a row of each window's items in order, from a place that a hash of seed, words and window
    chooses; of all where words is None or there are no more. Items are cut where the slice begins and ends, so that a window's text is
    never one row unless the slice is short; whole halves stay one row an item."""
    if words is None:
        return generation.select(*arms, by, _whole_terms(text).alias("terms"))
    return _slices(generation, [words], text, by, order, seed, arms, materialise).drop("words")


def _plain(text: str) -> Column:
    return squeeze(F.coalesce(F.col(text), F.lit("")))


def _whole_terms(text: str) -> Column:
    return tokens(strip_identifying(_plain(text)))


def _slices(generation: DataFrame, lengths: Sequence[int], text: str, by: str, order: Sequence[str], seed: int, arms: Sequence[str], write: Callable[[DataFrame, str], DataFrame], spread: Column | None = None) -> DataFrame:
    """(*arms, by, words, terms) of each length. Places come from the numbers of words, without the texts; only texts of items that a slice is part of are
    taken again, which are told by window, order and digest. Rows that share all of these have one text, and each is a copy of its own. spread: an array of
    arms that a row is in, as the column arms[0]."""
    plain = _plain(text)
    key = F.struct(by, *order, F.sha2(plain, 256).alias("digest")).alias("_key")
    n = F.when(plain != "", F.size(F.split(plain, " "))).otherwise(0).alias("_n")
    own = [spread.alias("_in")] if spread is not None else arms
    each = generation.select(*own, key, n).filter("_n > 0").groupBy(*(["_in"] if spread is not None else arms), "_key", "_n").agg(F.count("*").cast("int").alias("_c"))
    if spread is not None:
        each = each.withColumn(arms[0], F.explode("_in")).drop("_in")
    each = each.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_c")))).withColumn(by, F.col(f"_key.{by}"))
    run = Window.partitionBy(*arms, by).orderBy("_key", "_copy").rowsBetween(Window.unboundedPreceding, 0)
    sized = each.withColumns({"_to": F.sum("_n").over(run), "_all": F.sum("_n").over(Window.partitionBy(*arms, by))})
    sized = sized.withColumn("words", F.explode(F.array(*[F.lit(k) for k in lengths])))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("words").cast("string"), F.col(by).cast("string")))
    spare = F.col("_all") - F.col("words")
    start = F.when(spare > 0, F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.greatest(spare, F.lit(1))).otherwise(0)
    before = F.col("_to") - F.col("_n")
    cut = sized.withColumns({"_s": F.greatest(start - before, F.lit(0)), "_e": F.least(start + F.col("words") - before, F.col("_n"))}).filter("_s < _e")
    # At most `words` items of each window and length.
    cut = write(cut.select(*arms, by, "words", "_key", "_copy", "_s", "_e"), "cut")
    cut = F.broadcast(cut) if cut.count() <= bm25.BROADCAST else cut.hint("merge")
    said = generation.select(key, plain.alias("_plain")).join(cut, "_key")
    part = F.array_join(F.slice(F.split("_plain", " "), (F.col("_s") + 1).cast("int"), (F.col("_e") - F.col("_s")).cast("int")), " ")
    parts = said.select(*arms, by, "words", "_key", "_copy", part.alias("_p")).distinct()
    # At most `words` words of each window: put in order, so that dates that two items share are found.
    whole = parts.groupBy(*arms, by, "words").agg(F.array_sort(F.collect_list(F.struct("_key", "_copy", "_p"))).alias("_all"))
    return whole.select(*arms, by, "words", tokens(strip_identifying(F.array_join(F.transform("_all", lambda x: x["_p"]), " "))).alias("terms"))


def ranks(windowed: DataFrame, arms: Column, lengths: Sequence[int | None] = LENGTHS, text: str = "text", by: str = "boundary", seed: int = 7) -> DataFrame:
    """(arm, words, query_id, n_candidates, rank, predicted) for stand-ins of each length (null: the whole half) in each arm; windowed has a role for each
    item, and arms gives the names of the arms (an array) that a row is in. Windows without text in either half leave an arm's pool. All arms and
    lengths share one index: the arm is part of its key, and the lengths of a window's stand-in meet the same documents. Scores equal in single precision
    are ties, and go to the least window.

    A text's words are counted once, by the set of arms it is in; counts are dealt to arms. The result is written, and counts are deleted."""
    said = F.trim(F.coalesce(F.col(text), F.lit(""))) != ""
    rows = windowed.filter(F.col("role").isin("generation", "holdout") & said)
    told = F.col("role") == "generation"
    terms = F.when(~told, tokens(F.col(text)))
    if None in lengths:
        terms = F.when(told, _whole_terms(text)).otherwise(tokens(F.col(text)))
    with Scratch(windowed.sparkSession, "ceiling") as scratch:
        # The null term stands for rows without terms, whose window takes part.
        counts = rows.select(arms.alias("_in"), by, "role", F.explode_outer(terms).alias("term")).groupBy("_in", by, "role", "term").agg(F.count("term").alias("tf"))
        counts = scratch.write(counts, "counts").withColumn("arm", F.explode("_in"))
        counts = counts.groupBy("arm", by, "role", "term").agg(F.sum("tf").alias("tf"))
        halves = {role: counts.filter(F.col("role") == role).drop("role") for role in ("generation", "holdout")}
        both = scratch.write(counts.groupBy("arm", by).agg(F.min("role").alias("_a"), F.max("role").alias("_z")).filter("_a <> _z").select("arm", by), "both")
        asked = [halves["generation"].withColumn("words", F.lit(0)).withColumnRenamed("tf", "qf")] if None in lengths else []  # 0: a key can't be null
        some = [n for n in lengths if n is not None]
        if some:
            cut = _slices(rows.filter(told), some, text, by, ("published", "item_id"), seed, ["arm"], scratch.write, arms)
            asked.append(cut.select("arm", by, "words", F.explode_outer("terms").alias("term")).groupBy("arm", by, "words", "term").agg(F.count("term").alias("qf")))
        asked = scratch.write(reduce(DataFrame.unionByName, asked).join(both, ["arm", by], "left_semi").withColumnRenamed(by, "query_id"), "asked")
        docs = scratch.write(halves["holdout"].join(both, ["arm", by], "left_semi").withColumnRenamed(by, "doc_id"), "docs")
        scored = scratch.write(bm25.scores(asked, docs, by=["arm"], per=["words"], counted=True, asked_counted=True), "scores")
        out = bm25.match_ranks(asked, docs, by=["arm"], digits=None, per=["words"], scored=scored)
        out = out.select("arm", F.when(F.col("words") > 0, F.col("words")).alias("words"), "query_id", "n_candidates", "rank", "predicted")
        return materialise(out, "ceiling")


def summary(ranked: DataFrame, draws: int = 4000, seed: int = 7) -> DataFrame:
    """Per arm and length: accuracy, chance, mean reciprocal rank, share in the top three, and the permutation p (ranks: see `ranks`)."""
    by = ["arm", "words"]
    rows = ranked.withColumn("words", F.coalesce("words", F.lit(0)))
    p = bm25.permutation_p(rows, draws, seed, by=by).select(*by, "n_as_good", "p")
    out = bm25.match_summary(rows, by=by).join(p, by)
    return out.withColumn("words", F.when(F.col("words") > 0, F.col("words")))


def length_sweep(windowed: DataFrame, lengths: Sequence[int | None] = LENGTHS, text: str = "text", by: str = "boundary", seed: int = 7) -> DataFrame:
    """(words, query_id, n_candidates, rank, predicted) for stand-ins of each length (null: the whole half)."""
    return ranks(windowed, F.array(F.lit("all")), lengths, text, by, seed).drop("arm")


def section_arms(windowed: DataFrame, inside: Column, text: str = "text", by: str = "boundary") -> DataFrame:
    """(arm, query_id, n_candidates, rank, predicted) with whole halves of all items, of those `inside` holds for, and of the rest."""
    side = F.when(F.coalesce(inside, F.lit(False)), "inside").otherwise("outside")
    return ranks(windowed, F.array(F.lit("all"), side), (None,), text, by).drop("words")


def pools(windowed: DataFrame, kind: str = "kind", lengths: Sequence[int | None] = LENGTHS, text: str = "text", by: str = "boundary") -> DataFrame:
    """(arm, words, query_id, n_candidates, rank, predicted) with transitions alone, controls alone, and all windows."""
    own = F.when(F.col(kind) == "transition", "transitions_only").otherwise("placebos_only")
    return ranks(windowed, F.array(F.lit("all_windows"), own), lengths, text, by)
