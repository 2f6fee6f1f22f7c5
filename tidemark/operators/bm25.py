"""BM25 by joins on terms, and what is measured with it: blind matches and their significance.

Documents are bags of terms; postings, document frequencies and lengths are tables. The score of a query and a document
is a sum over their common terms, so that only pairs with a common term are ever made; the rest scores zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import id_bucket, ranked


def postings(docs: DataFrame, terms: str = "terms", doc: str = "doc_id", by: Sequence[str] = ()) -> DataFrame:
    """(*by, doc, term, tf) of array columns."""
    return docs.select(*by, doc, F.explode(terms).alias("term")).groupBy(*by, doc, "term").agg(F.count("*").alias("tf"))


#: Asked terms are broadcast if they are at most so many rows, else joined by shuffle.
BROADCAST = 500_000


def if_small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST rows."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def count_terms(docs: DataFrame, queries: DataFrame, key: str = "doc_id", terms: str = "terms") -> DataFrame:
    """(key, term, tf): how often rows with the same key have each term that a query asks for; the null term has all others, and none where a key has no
    terms at all. The key may stand for several documents that its rows are part of, so that their terms are taken once."""
    wanted = queries.select(F.explode(terms).alias("term")).distinct().withColumn("_asked", F.lit(True))
    small = wanted.count() <= BROADCAST
    each = docs.select(key, F.explode_outer(terms).alias("term")).withColumn("tf", F.col("term").isNotNull().cast("long"))
    if not small:
        each = each.groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    each = each.join(F.broadcast(wanted) if small else wanted, "term", "left")
    return each.groupBy(key, F.when(F.col("_asked"), F.col("term")).alias("term")).agg(F.sum("tf").alias("tf"))


def scores(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75, query: str = "query_id", doc: str = "doc_id", terms: str = "terms", by: Sequence[str] = (), per: Sequence[str] = (), counted: bool = False, asked_counted: bool = False) -> DataFrame:
    """(*by, *per, query, doc, score) for pairs with a common term. per: columns of queries alone, such as variants of a query that meet the same documents. idf = ln(1 + (N - df + 0.5) / (df + 0.5)) with N documents of the pool (`by`); a term that a
    query repeats counts as often; a document without terms counts in N and in the mean length. A query or document may be spread over several rows,
    whose terms are its own. Only terms that a query asks for are counted in documents. counted: docs has term and tf instead of an array, as `count_terms` gives them; asked_counted:
    queries has one row for each term, with qf."""
    by, per = list(by), list(per)
    if asked_counted:
        asked = queries.filter("term IS NOT NULL").select(*by, *per, query, "term", "qf")
    else:
        asked = postings(queries, terms, query, [*by, *per]).withColumnRenamed("tf", "qf")
    small = asked.count() <= BROADCAST
    asked = F.broadcast(asked) if small else asked
    if counted:
        post = docs.filter("term IS NOT NULL").groupBy(*by, doc, "term").agg(F.sum("tf").alias("tf"))
        sizes = docs.groupBy(*by, doc).agg(F.sum("tf").alias("dl"))
    else:
        wanted = asked.select(*by, "term").distinct()
        said = docs.select(*by, doc, F.explode(terms).alias("term")).join(F.broadcast(wanted) if small else wanted, [*by, "term"], "left_semi")
        post = said.groupBy(*by, doc, "term").agg(F.count("*").alias("tf"))
        sizes = docs.groupBy(*by, doc).agg(F.sum(F.size(terms)).alias("dl"))
    pool = sizes.groupBy(*by).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    often = post.groupBy(*by, "term").agg(F.count("*").alias("df"))
    if asked_counted:
        # Written counts are compressed, so that Spark takes them to be smaller than they are: they are never broadcast by its estimate.
        post, often = post.hint("merge"), often if small else often.hint("merge")
    rows = post.join(asked.join(often, [*by, "term"]), [*by, "term"]).join(sizes, [*by, doc])
    rows = rows.join(pool, by) if by else rows.crossJoin(F.broadcast(pool))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    return rows.groupBy(*by, *per, query, doc).agg(F.sum(F.col("qf") * idf * F.col("tf") * (k1 + 1) / norm).alias("score"))


def top_k(scored: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id", by: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """The k best documents of each query; scores equal to `digits` places are ties, and go to the least document."""
    w = Window.partitionBy(*by, query).orderBy(F.desc(F.round("score", digits)), doc)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _places(ids: DataFrame, doc: str, by: Sequence[str]) -> DataFrame:
    """(*by, doc, place, n_candidates) of distinct ids, counted by ranges of ids, so that no task orders a whole pool."""
    return ranked(ids, id_bucket(ids, doc), [doc], by).select(*by, doc, (F.col("_i") + 1).alias("place"), F.col("_n").alias("n_candidates"))


def match_ranks(queries: DataFrame, docs: DataFrame, query: str = "query_id", doc: str = "doc_id", by: Sequence[str] = (), digits: int | None = 9, per: Sequence[str] = (), scored: DataFrame | None = None) -> DataFrame:
    """(*by, *per, query, n_candidates, rank, predicted, score): for each query whose id is also a document's, where that document ranks among all documents of
    the pool by score and then id, and which comes first. Documents without a common term have score zero and are ranked without being paired: the rank
    follows from the better ones and from how many ids come before. per: columns of queries alone, not null: variants that share the pool's documents.
    Scores equal to `digits` places are ties; where digits is None, those equal in single precision: scores of long texts are so large that the order of
    their sums shows in the ninth place. scored: what `scores` gives, where it is at hand; it is read twice."""
    by, per = list(by), list(per)
    same = F.col("score").cast("float").cast("double") if digits is None else F.round("score", digits)
    s = scored if scored is not None else scores(queries, docs, query=query, doc=doc, by=by, per=per)
    s = s.withColumn("score", same).filter(F.col("score") > 0)
    ids = docs.select(*by, doc).distinct()
    keys = [*by, *per, query]
    own = queries.select(*keys).distinct().join(_places(ids, doc, by).withColumnRenamed(doc, query), [*by, query])
    truth = s.filter(F.col(query) == F.col(doc)).select(*keys, F.col("score").alias("own"))
    own = own.join(truth, keys, "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    pairs = s.join(own.select(*keys, "own"), keys)
    better = pairs.groupBy(*keys).agg(
        F.count_if((F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col(doc) < F.col(query)))).alias("above"),
        F.count_if(F.col(doc) < F.col(query)).alias("scored_before"),
        F.min(F.struct(-F.col("score"), doc)).alias("best"),
    )
    out = own.join(better, keys, "left")
    zero_before = F.when(F.col("own") > 0, F.lit(0)).otherwise(F.col("place") - 1 - F.coalesce("scored_before", F.lit(0)))
    first = ids.groupBy(*by).agg(F.min(doc).alias("_first"))
    out = out.join(first, by) if by else out.crossJoin(F.broadcast(first))
    return out.select(*keys, "n_candidates", (F.coalesce("above", F.lit(0)) + zero_before + 1).alias("rank"), F.coalesce(F.col(f"best.{doc}"), F.col("_first")).alias("predicted"), F.col("own").alias("score"))


def match_summary(ranks: DataFrame, by: Sequence[str] = (), query: str = "query_id") -> DataFrame:
    """Accuracy, chance, mean reciprocal rank and share in the top three; needs two candidates."""
    hit = (F.col("rank") == 1).cast("int")
    return ranks.filter(F.col("n_candidates") >= 2).groupBy(*by).agg(
        F.count("*").alias("n"), F.max("n_candidates").alias("n_candidates"), F.sum(hit).alias("n_correct"), F.avg(hit).alias("accuracy"), (1 / F.max("n_candidates")).alias("chance"),
        F.avg(1 / F.col("rank")).alias("mrr"), F.avg((F.col("rank") <= 3).cast("int")).alias("top3"),
    )


def permutation_p(ranks: DataFrame, draws: int = 1000, seed: int = 7, query: str = "query_id", by: Sequence[str] = ()) -> DataFrame:
    """(*by, n, n_correct, n_as_good, p): predictions stay, the true ids are shuffled by the order of a hash; p = (as good + 1) / (draws + 1). Draws are rows dealt out over
    the cluster; a draw needs only the queries (ids and predictions), and is summed before draws meet."""
    by = list(by)
    # The draw's number leads both windows, so that each draw is a group of its own.
    base = ranks.select(*by, query, "predicted").withColumn("_slot", F.row_number().over(Window.partitionBy(*by).orderBy(query)))
    each = base.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("_draw").cast("string"), F.col(query).cast("string")), 256)
    dealt = each.withColumn("_to", F.row_number().over(Window.partitionBy(*by, "_draw").orderBy(order, query)))
    truth = base.select(*by, F.col("_slot").alias("_to"), F.col(query).alias("_truth"))
    counts = dealt.join(truth, [*by, "_to"]).groupBy(*by, "_draw").agg(F.count_if(F.col("predicted") == F.col("_truth")).alias("hits"))
    real = base.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col(query)).alias("n_correct"))
    joined = counts.join(real, by) if by else counts.crossJoin(F.broadcast(real))
    out = joined.groupBy(*by).agg(F.first("n").alias("n"), F.first("n_correct").alias("n_correct"), F.count_if(F.col("hits") >= F.col("n_correct")).alias("n_as_good"))
    return out.withColumn("p", (F.col("n_as_good") + 1) / (draws + 1))


def nearest_pools(dates: DataFrame, k: int, window: str = "window_id", day: str = "d") -> DataFrame:
    """(pool, window): for each window the k windows nearest in time, itself among them; of equal distances the least id. Of a day only its k least ids can be chosen, and only
    days among the k before and after: so windows meet a bounded number of others, and not all."""
    kept = dates.select(F.col(window), F.col(day).alias("_near")).withColumn("_r", F.row_number().over(Window.partitionBy("_near").orderBy(window))).filter(F.col("_r") <= k).drop("_r")
    days = dates.select(day).distinct()
    near = days.withColumn("_all", F.collect_list(day).over(Window.orderBy(day).rowsBetween(-k, k))).select(day, F.explode("_all").alias("_near"))
    each = dates.select(F.col(window).alias("pool"), day).join(near, day).join(kept, "_near").withColumn("_far", F.abs(F.datediff("_near", day)))
    rank = F.row_number().over(Window.partitionBy("pool").orderBy("_far", window))
    return each.withColumn("_r", rank).filter(F.col("_r") <= k).select("pool", window)


def hard_negatives(dates: DataFrame, queries: DataFrame, docs: DataFrame, k: int, window: str = "window_id", day: str = "d") -> DataFrame:
    """match_ranks of each window's query within its own pool of the k nearest windows; document frequencies are those of the pool."""
    pools = nearest_pools(dates, k, window, day)
    asked = queries.select(F.col("query_id").alias("pool"), "query_id", "terms")
    held = pools.join(docs.withColumnRenamed("doc_id", window), window).select("pool", F.col(window).alias("doc_id"), "terms")
    return match_ranks(asked, held, by=["pool"]).drop("pool")
