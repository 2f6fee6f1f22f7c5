"""Queries on windows of dated text, on retrieval, claims and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import audit, bm25, inference, windows
from tidemark.plans import bindings as B
from tidemark.plans.registry import places, query, table, text_days
from tidemark.sources import inputs, wikitext

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(T.STOP_WORDS))
_CLAIM_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(T.CLAIM_STOP_WORDS))
_PATTERN = r"[a-z][a-z0-9\-'']+"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '{_PATTERN}'), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))"


def _content(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '{_PATTERN}'), lambda w: length(w) > 3 AND w NOT IN ({_CLAIM_STOP})))"


@query(f"WITH {B.ITEMS} SELECT item_id, CAST(boundary AS VARCHAR) AS boundary, day_index FROM win")
def window_items_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.items_in_windows(B.items(spark, sf_dir), B.boundaries(spark, sf_dir))
    return out.select("item_id", *text_days("boundary"), F.col("day_index").cast("long").alias("day_index"))


@query(f"WITH {B.ITEMS} SELECT day_index, source, count(*) AS n FROM win GROUP BY ALL")
def relative_day_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.items_in_windows(B.items(spark, sf_dir), B.boundaries(spark, sf_dir))
    return out.groupBy(F.col("day_index").cast("long").alias("day_index"), "source").agg(F.count("*").alias("n"))


@query(f"""WITH {B.ITEMS}
SELECT CAST(boundary AS VARCHAR) AS boundary, count(*) FILTER (CAST(published AS DATE) < boundary - 13) AS n_before,
  count(*) FILTER (CAST(published AS DATE) >= boundary - 13 AND published <= CAST(boundary AS TIMESTAMP) + INTERVAL 86399 SECONDS) AS n_in,
  count(*) FILTER (published > CAST(boundary AS TIMESTAMP) + INTERVAL 86399 SECONDS) AS n_after
FROM bounds, items GROUP BY boundary""")
def boundary_drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.dropped_counts(B.items(spark, sf_dir), B.boundaries(spark, sf_dir)).select(*text_days("boundary"), "n_before", "n_in", "n_after")


@query("""SELECT h, doc_id FROM (SELECT md5(text) AS h, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def item_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return windows.first_of_each(docs, item="h", published="doc_id", by=[]).select("h", "doc_id")


@query("""SELECT substr(sha256(source || '|' || strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') || '+00:00' || '|' || coalesce(url, '') || '|' || title), 1, 16) AS item_id, event_id
FROM (SELECT event_id, ts, 'events' AS source, 'https://www.example.org/' || user_id AS url, event_type AS title FROM events)""")
def item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("published", F.col("ts").cast("timestamp"))
    url = F.concat(F.lit("https://www.example.org/"), F.col("user_id").cast("string"))
    return e.select(T.item_id(F.lit("events"), F.col("published"), url, F.col("event_type")).alias("item_id"), "event_id")


@query(f"""WITH {B.ITEMS}, r AS (SELECT item_id, boundary, row_number() OVER (PARTITION BY boundary ORDER BY sha256('7:' || item_id), item_id) AS k, count(*) OVER (PARTITION BY boundary) AS n FROM win)
SELECT item_id, CAST(boundary AS VARCHAR) AS boundary, CASE WHEN k <= greatest(1, CAST(round_even(n * 0.5, 0) AS BIGINT)) THEN 'holdout' ELSE 'generation' END AS role FROM r""")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = windows.items_in_windows(B.items(spark, sf_dir), B.boundaries(spark, sf_dir))
    return windows.holdout_split(win).select("item_id", *text_days("boundary"), "role")


@query(f"""WITH {B.ITEMS}, r AS (SELECT item_id, boundary, row_number() OVER (PARTITION BY boundary ORDER BY published, item_id) - 1 AS i, count(*) OVER (PARTITION BY boundary) AS n FROM win),
sizes AS (SELECT boundary, max(n) AS n FROM r GROUP BY boundary),
pick AS (SELECT DISTINCT boundary, CAST(round_even(k * (n - 1) / 99.0, 0) AS BIGINT) AS i FROM sizes, range(0, 100) AS g(k) WHERE n > 100)
SELECT item_id, CAST(r.boundary AS VARCHAR) AS boundary FROM r JOIN pick p ON p.boundary = r.boundary AND p.i = r.i
UNION ALL SELECT item_id, CAST(boundary AS VARCHAR) AS boundary FROM r WHERE n <= 100""")
def even_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = windows.items_in_windows(B.items(spark, sf_dir), B.boundaries(spark, sf_dir))
    return windows.truncate_evenly(win, 100).select("item_id", *text_days("boundary"))


@query("""WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, value, event_id FROM events), b AS (SELECT DISTINCT user_id, CAST(ts AS DATE) - 1 AS boundary FROM e)
SELECT user_id, CAST(boundary AS VARCHAR) AS boundary, event_id FROM (
  SELECT b.user_id, b.boundary, e.event_id, row_number() OVER (PARTITION BY b.user_id, b.boundary ORDER BY e.ts DESC, e.event_id DESC) AS r
  FROM b JOIN e ON e.user_id = b.user_id AND e.ts <= CAST(b.boundary AS TIMESTAMP) + INTERVAL 86399 SECONDS) WHERE r = 1""")
def asof_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    b = e.select("user_id", F.date_sub(F.to_date("ts"), 1).alias("boundary"))
    return windows.as_of(e, b, key="user_id", payload=["event_id"]).select("user_id", *text_days("boundary"), "event_id")


@query("""WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, event_id FROM events), s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS size FROM e),
last AS (SELECT user_id, max(size) AS latest_size FROM s GROUP BY user_id), b AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS boundary FROM e),
pin AS (SELECT b.user_id, b.boundary, max(size) AS pinned_size FROM b JOIN s ON s.user_id = b.user_id AND s.ts <= CAST(b.boundary AS TIMESTAMP) + INTERVAL 86399 SECONDS GROUP BY ALL)
SELECT user_id, CAST(boundary AS VARCHAR) AS boundary, CAST(pinned_size AS BIGINT) AS pinned_size, CAST(latest_size AS BIGINT) AS latest_size, round_even(100 * (latest_size - pinned_size) / latest_size, 1) AS pct_added FROM pin JOIN last USING (user_id)""")
def hindsight_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumn("size", F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)").cast("long"))
    pinned = windows.as_of(e, e.select("user_id", F.to_date("ts").alias("boundary")), key="user_id", payload=["size"])
    latest = e.groupBy("user_id").agg(F.max("size").alias("size"))
    return windows.hindsight_leak(pinned, latest, key="user_id").select("user_id", *text_days("boundary"), "pinned_size", "latest_size", "pct_added")


@query("""SELECT conv_id, string_agg(trim(regexp_replace(role || chr(10) || text, '^\\s+|\\s+$', '', 'g')), ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def ordered_body_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("b", T.body(F.col("role"), F.col("text")))
    return windows.ordered_text(c, "b", by=["conv_id"], order=["turn"])


@query(f"SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, CAST(len(list_distinct(t)) AS INT) AS n_distinct FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)")
def tokenise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"WITH c AS (SELECT conv_id, turn, {_content('text')} AS w, lag({_content('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, turn, CAST(len(w) AS INT) AS n_words, CAST(len(list_intersect(w, p)) AS INT) AS n_shared FROM c WHERE p IS NOT NULL")
def content_overlap_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.content_tokens(F.col("text")).alias("w"))
    c = c.withColumn("p", F.expr("lag(w) OVER (PARTITION BY conv_id ORDER BY turn)")).filter("p IS NOT NULL")
    return c.select("conv_id", "turn", F.size("w").alias("n_words"), F.size(F.array_intersect("w", "p")).alias("n_shared"))


_DATED = "'On 3 March 2020, May 5th, Q1, 2019-05-30, last year (2018), 3/3/2020 and in June: '"


@query(f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(d,
  '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b', '[date]', 'g'), '(?i)\\b(?:{T.MONTHS})\\s+\\d{{1,2}}(?:st|nd|rd|th)?\\b', '[date]', 'g'), '(?i)\\b\\d{{1,2}}(?:st|nd|rd|th)?\\s+(?:{T.MONTHS})\\b', '[date]', 'g'),
  '\\b(?:{T.MONTHS}|{T.SHORT_MONTHS})\\b', '[month]', 'g'), '(?i)\\b(?:last|next|this|the following|the previous)\\s+(?:year|month|week|quarter)\\b', '[relative period]', 'g'), '\\b(?:19|20)\\d{{2}}\\b', '[year]', 'g')) AS h
FROM (SELECT doc_id, {_DATED} || text AS d FROM documents)""")
def strip_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.concat(F.lit(_DATED.strip("'")), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_dates(d).cast("binary")).alias("h"))


@query(f"""SELECT item_id, len(regexp_extract_all(d, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b')) AS iso, len(regexp_extract_all(d, '(?i)\\b(?:{T.MONTHS})\\s+\\d{{1,2}}(?:st|nd|rd|th)?\\b')) AS month_day,
  len(regexp_extract_all(d, '(?i)\\b\\d{{1,2}}(?:st|nd|rd|th)?\\s+(?:{T.MONTHS})\\b')) AS day_month, len(regexp_extract_all(d, '\\b(?:{T.MONTHS}|{T.SHORT_MONTHS})\\b')) AS month,
  len(regexp_extract_all(d, '(?i)\\b(?:last|next|this|the following|the previous)\\s+(?:year|month|week|quarter)\\b')) AS relative, len(regexp_extract_all(d, '\\b(?:19|20)\\d{{2}}\\b')) AS year
FROM (SELECT item_id, {_DATED} || text AS d FROM benchmark)""")
def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.concat(F.lit(_DATED.strip("'")), F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", *[c.cast("long").alias(k) for k, c in T.date_leaks(d).items()])


@query(f"""SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(d, '\\b(?:19|20)\\d\\d\\b', ' ', 'g'),
  '(?i)\\b(?:{T.MONTHS}|{T.SHORT_MONTHS})\\b', ' ', 'g'), '(?i)\\bQ[1-4]\\b', ' ', 'g'), '\\b\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}\\b', ' ', 'g'), '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS text
FROM (SELECT item_id, {_DATED} || text AS d FROM benchmark)""")
def strip_identifying(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.concat(F.lit(_DATED.strip("'")), F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.strip_identifying(d).alias("text"))


@query(r"""WITH raw AS (SELECT conv_id, turn, trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) AS plain, role FROM conversations)
SELECT conv_id, turn, trim(regexp_replace(role || ' ' || plain || ' in bold & more - ' || turn, '\s+', ' ', 'g')) AS text, CAST(2 AS INT) AS n_links,
  'Src ' || turn AS first_publisher, 'https://www.example.org/' || conv_id AS first_url, 'x' || turn || '.example.net' AS second_publisher FROM raw""")
def html_clean_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wiki markup of all kinds around the turns of conversations, cleaned, and its links."""
    c = table(spark, sf_dir, "conversations")
    plain, turn, conv = F.trim(F.regexp_replace("text", "[^A-Za-z0-9]+", " ")), F.col("turn").cast("string"), F.col("conv_id").cast("string")
    raw = F.concat(
        F.lit("* <!-- hidden\n[[x]] -->[[Portal:Role|"), F.col("role"), F.lit("]] [[Some page|"), plain,
        F.lit("]]<ref name=a>cite {{x}}</ref> ''in'' {{cite|{{deep|{{er}}}}}} '''bold''' &amp;&nbsp;<b>more</b> &ndash; "), turn,
        F.lit(" [https://www.example.org/"), conv, F.lit(" (Src "), turn, F.lit(")] <ref/>[https://x"), turn, F.lit(".example.net/]"),
    )
    found = T.links(raw)
    publisher = lambda k: F.get(found, F.lit(k))["publisher"]
    return c.select(
        "conv_id", "turn", T.clean_markup(raw).alias("text"), F.size(found).alias("n_links"), publisher(0).alias("first_publisher"),
        F.get(found, F.lit(0))["url"].alias("first_url"), publisher(1).alias("second_publisher"),
    )


@query("""WITH lines AS (
  SELECT conv_id AS page, turn AS n, CASE turn % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS depth,
    regexp_replace(trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), '^[ *;:\\-]+|[ *;:\\-]+$', '', 'g') AS body FROM conversations),
marked AS (SELECT *, sum((depth = 0)::INT) OVER (PARTITION BY page ORDER BY n) AS block,
  coalesce(last_value(CASE WHEN depth = 0 THEN body END IGNORE NULLS) OVER (PARTITION BY page ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM lines),
topics AS (SELECT *, coalesce(last_value(CASE WHEN depth = 1 THEN body END IGNORE NULLS) OVER (PARTITION BY page, block ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS above FROM marked),
items AS (SELECT *, depth = 1 AND coalesce(lead(depth) OVER (PARTITION BY page ORDER BY n) > 1, false) AS parent FROM topics WHERE depth > 0)
SELECT page, section, CASE WHEN depth > 1 THEN above ELSE '' END AS topic, body AS text FROM items WHERE NOT parent AND length(body) >= 25""")
def section_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    plain = F.regexp_replace("text", r"[^A-Za-z0-9 ]", " ")
    mark = F.when(F.col("turn") % 4 == 0, ";").when(F.col("turn") % 4 == 1, "* ").otherwise("** ")
    pages = windows.ordered_text(c.withColumn("line", F.concat(mark, plain)), "line", by=["conv_id"], order=["turn"], name="wikitext", sep="\n")
    return wikitext.parse_items(pages, key="conv_id").select(F.col("conv_id").alias("page"), "section", "topic", "text")


@query()
def input_column_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("when"), F.col("o_orderstatus").alias("note"))
    return inputs.days_and_states(o).select(*text_days("d"))


_SCORES = """post AS (SELECT doc_id, term, count(*) AS tf FROM docs, unnest(terms) AS u(term) GROUP BY ALL),
sizes AS (SELECT doc_id, len(terms) AS dl FROM docs), pool AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sizes),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term), asked AS (SELECT query_id, term, count(*) AS qf FROM queries, unnest(terms) AS u(term) GROUP BY ALL),
scores AS (SELECT query_id, doc_id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM asked JOIN df USING (term) JOIN post USING (term) JOIN sizes USING (doc_id), pool GROUP BY ALL)"""


@query(f"""WITH docs AS (SELECT doc_id, {_tokens('text')} AS terms FROM documents), queries AS (SELECT item_id AS query_id, {_tokens('text')} AS terms FROM benchmark), {_SCORES}
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores) WHERE rank <= 3""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("terms"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("terms"))
    return bm25.top_k(bm25.scores(queries, docs), 3).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), *places("score"))


_HALVES = f"""halves AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
queries AS (SELECT item_id AS query_id, {_tokens("array_to_string(w[1 : len(w) // 2], ' ')")} AS terms FROM halves),
docs AS (SELECT item_id AS doc_id, {_tokens("array_to_string(w[len(w) // 2 + 1 :], ' ')")} AS terms FROM halves)"""
_RANKS = """ranked AS (SELECT q.query_id, d.doc_id, coalesce(round(score, 9), 0) AS score FROM (SELECT query_id FROM queries) q CROSS JOIN (SELECT doc_id FROM docs) d LEFT JOIN scores USING (query_id, doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS n_candidates FROM ranked),
ranks AS (SELECT query_id, n_candidates, max(CASE WHEN query_id = doc_id THEN rank END) AS rank, max(CASE WHEN rank = 1 THEN doc_id END) AS predicted FROM placed GROUP BY ALL)"""


def _half(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = table(spark, sf_dir, "benchmark").withColumn("w", F.split("text", " "))
    part = lambda first, n: T.tokens(F.array_join(F.slice("w", first, n), " "))
    half = F.floor(F.size("w") / 2).cast("int")
    return b.select(F.col("item_id").alias("query_id"), part(F.lit(1), half).alias("terms")), b.select(F.col("item_id").alias("doc_id"), part(half + 1, F.size("w")).alias("terms"))


@query(f"WITH {_HALVES}, {_SCORES}, {_RANKS} SELECT query_id, n_candidates, rank, predicted FROM ranks")
def bm25_half_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.match_ranks(*_half(spark, sf_dir)).select("query_id", "n_candidates", F.col("rank").cast("long").alias("rank"), "predicted")


@query(f"""WITH {_HALVES}, {_SCORES}, {_RANKS} SELECT count(*) AS n, max(n_candidates) AS n_candidates, count(*) FILTER (rank = 1) AS n_correct, round(avg((rank = 1)::INT), 6) AS accuracy,
  round(1.0 / max(n_candidates), 6) AS chance, round(avg(1.0 / rank), 6) AS mrr, round(avg((rank <= 3)::INT), 6) AS top3 FROM ranks""")
def bm25_match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.match_summary(bm25.match_ranks(*_half(spark, sf_dir))).select("n", "n_candidates", "n_correct", *places("accuracy", "chance", "mrr", "top3"))


_PERMS = 10_000


@query(f"""WITH {_HALVES}, {_SCORES}, {_RANKS},
base AS (SELECT query_id, predicted, row_number() OVER (ORDER BY query_id) AS slot FROM ranks),
dealt AS (SELECT draw, predicted, row_number() OVER (PARTITION BY draw ORDER BY sha256('7:' || draw || ':' || query_id), query_id) AS slot FROM base, range(1, {_PERMS + 1}) AS r(draw)),
hits AS (SELECT draw, count(*) FILTER (d.predicted = b.query_id) AS hits FROM dealt d JOIN base b USING (slot) GROUP BY draw),
own AS (SELECT count(*) AS n, count(*) FILTER (predicted = query_id) AS n_correct FROM base)
SELECT n, n_correct, count(*) FILTER (hits >= n_correct) AS n_as_good, round((count(*) FILTER (hits >= n_correct) + 1) / {_PERMS + 1}.0, 6) AS p FROM hits, own GROUP BY n, n_correct""")
def bm25_permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.permutation_p(bm25.match_ranks(*_half(spark, sf_dir)), _PERMS).select("n", "n_correct", "n_as_good", *places("p"))


@query(f"""WITH halves AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
dates AS (SELECT item_id AS window_id, DATE '2024-01-01' + CAST(item_id * item_id % 211 AS INT) AS d FROM benchmark),
pools AS (SELECT pool, window_id FROM (SELECT a.window_id AS pool, b.window_id, row_number() OVER (PARTITION BY a.window_id ORDER BY abs(date_diff('day', a.d, b.d)), b.window_id) AS r FROM dates a, dates b) WHERE r <= 5),
queries AS (SELECT item_id AS query_id, {_tokens("array_to_string(w[1 : len(w) // 2], ' ')")} AS terms FROM halves),
docs AS (SELECT pool, window_id AS doc_id, {_tokens("array_to_string(w[len(w) // 2 + 1 :], ' ')")} AS terms FROM halves JOIN pools ON item_id = window_id),
post AS (SELECT pool, doc_id, term, count(*) AS tf FROM docs, unnest(terms) AS u(term) GROUP BY ALL), sizes AS (SELECT pool, doc_id, len(terms) AS dl FROM docs),
pool AS (SELECT pool, count(*) AS n, avg(dl) AS avgdl FROM sizes GROUP BY pool), df AS (SELECT pool, term, count(*) AS df FROM post GROUP BY ALL),
asked AS (SELECT query_id AS pool, query_id, term, count(*) AS qf FROM queries, unnest(terms) AS u(term) GROUP BY ALL),
scores AS (SELECT query_id, doc_id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM asked JOIN df USING (pool, term) JOIN post USING (pool, term) JOIN sizes USING (pool, doc_id) JOIN pool USING (pool) GROUP BY ALL),
ranked AS (SELECT pool AS query_id, doc_id, coalesce(round(score, 9), 0) AS score FROM sizes LEFT JOIN scores ON scores.query_id = pool AND scores.doc_id = sizes.doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS n_candidates FROM ranked)
SELECT query_id, n_candidates, max(CASE WHEN query_id = doc_id THEN rank END) AS rank, max(CASE WHEN rank = 1 THEN doc_id END) AS predicted FROM placed GROUP BY ALL
HAVING max(CASE WHEN query_id = doc_id THEN rank END) IS NOT NULL""".replace("SELECT pool AS query_id, doc_id, coalesce", "SELECT sizes.pool AS query_id, sizes.doc_id, coalesce").replace("scores.query_id = pool AND", "scores.query_id = sizes.pool AND"))
def hard_negative_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = _half(spark, sf_dir)
    dates = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("window_id"), F.expr("date_add(DATE '2024-01-01', cast(item_id * item_id % 211 as int))").alias("d"))
    return bm25.hard_negatives(dates, q, d, 5).select("query_id", "n_candidates", F.col("rank").cast("long").alias("rank"), "predicted")


_AUDIT = f"""{B.CLAIMS},
cited AS (SELECT DISTINCT window_id, claim_id, unnest(item_ids) AS item_id FROM claims),
linked AS (SELECT c.*, i.text IS NOT NULL AS valid, i.text FROM cited c LEFT JOIN claim_items i USING (window_id, item_id)),
held AS (SELECT window_id, claim_id, count(*) AS n_cited, count(*) FILTER (NOT valid) AS n_fabricated, flatten(list({_content("text")}) FILTER (valid)) AS held FROM linked GROUP BY ALL),
base AS (SELECT c.window_id, c.claim_id, c.kind, coalesce(n_cited, 0) AS n_cited, coalesce(n_fabricated, 0) AS n_fabricated, {_content("claim")} AS w, held FROM claims c LEFT JOIN held USING (window_id, claim_id)),
scored AS (SELECT *, CASE WHEN len(w) > 0 AND held IS NOT NULL THEN len(list_intersect(w, held)) / len(w) ELSE 0.0 END AS overlap FROM base),
audited AS (SELECT *, CASE WHEN n_cited = 0 THEN 'uncited' WHEN n_fabricated = n_cited THEN 'fabricated_citation' WHEN overlap >= 0.25 THEN 'grounded' ELSE 'ungrounded' END AS status FROM scored)"""


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_claims(B.claims(spark, sf_dir), B.claim_items(spark, sf_dir))


@query(f"WITH {_AUDIT} SELECT window_id, claim_id, n_cited, n_fabricated, round(overlap, 6) AS overlap, status FROM audited")
def claim_citation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).select("window_id", "claim_id", "n_cited", "n_fabricated", *places("overlap"), "status")


@query(f"""WITH {_AUDIT} SELECT window_id, count(*) AS n_claims, count(*) FILTER (status = 'grounded') AS n_grounded, count(*) FILTER (status = 'uncited') AS n_uncited,
  count(*) FILTER (status = 'fabricated_citation') AS n_fabricated_only, count(*) FILTER (n_fabricated > 0) AS n_with_fabricated, round(avg(overlap), 6) AS mean_overlap FROM audited GROUP BY window_id""")
def window_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.faithfulness(_audited(spark, sf_dir)).select("window_id", "n_claims", "n_grounded", "n_uncited", "n_fabricated_only", "n_with_fabricated", *places("mean_overlap"))


@query(f"""WITH {_AUDIT}, t AS (SELECT unnest([0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5])::DOUBLE AS threshold)
SELECT threshold, count(*) AS n_claims, count(*) FILTER (n_fabricated < n_cited AND overlap >= threshold) AS n_grounded FROM scored, t GROUP BY threshold""")
def grounding_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.threshold_sweep(_audited(spark, sf_dir)).select("threshold", "n_claims", "n_grounded")


@query(f"WITH {_AUDIT} SELECT CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS pool, count(*) AS n_claims, count(*) FILTER (status = 'grounded') AS n_grounded, round(avg(overlap), 6) AS mean_overlap FROM audited GROUP BY GROUPING SETS ((), (kind))")
def pooled_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _audited(spark, sf_dir).join(B.claims(spark, sf_dir).select("claim_id", "kind"), "claim_id")
    return audit.pooled(rows).select("pool", "n_claims", "n_grounded", *places("mean_overlap"))


@query(f"""WITH {B.CLAIMS}, it AS (SELECT window_id, item_id, {_content("text")} AS held, row_number() OVER (PARTITION BY window_id ORDER BY item_id) - 1 AS k, count(*) OVER (PARTITION BY window_id) AS n FROM claim_items),
cl AS (SELECT window_id, claim_id, {_content("claim")} AS w FROM claims), dr AS (SELECT *, unnest(range(1, 11)) AS draw FROM cl WHERE len(w) > 0),
k AS (SELECT d.window_id, claim_id, draw, w, CAST(('0x' || substr(md5('7:' || d.window_id || ':' || claim_id || ':' || draw), 1, 8)) AS BIGINT) % s.n AS k FROM dr d JOIN (SELECT DISTINCT window_id, n FROM it) s USING (window_id))
SELECT claim_id, CAST(draw AS INT) AS draw, round(len(list_intersect(w, held)) / len(w), 6) AS overlap FROM k JOIN it USING (window_id, k)""")
def random_citation_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.random_citation_floor(B.claims(spark, sf_dir), B.claim_items(spark, sf_dir), draws=10).select("claim_id", "draw", *places("overlap"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS n_true, round(count(*) FILTER (quality = 1) / count(*), 6) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def confident_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return inference.rates(rows, "quality", ["lang"]).select("lang", "n", "n_true", *places("rate"))


_TABLES = "t AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d FROM labels JOIN documents USING (doc_id) GROUP BY lang)"


def _two_by_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    n = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    return rows.groupBy("lang").agg(n(1, 1).alias("a"), n(1, 0).alias("b"), n(0, 1).alias("c"), n(0, 0).alias("d"))


@query(f"""WITH {_TABLES}, m AS (SELECT *, a + b AS r1, c + d AS r2, a + c AS k FROM t), x AS (SELECT *, unnest(range(greatest(0, k - r2), least(k, r1) + 1)) AS x FROM m),
lp AS (SELECT *, lgamma(r1 + 1) - lgamma(x + 1) - lgamma(r1 - x + 1) + lgamma(r2 + 1) - lgamma(k - x + 1) - lgamma(r2 - k + x + 1) - lgamma(r1 + r2 + 1) + lgamma(k + 1) + lgamma(r1 + r2 - k + 1) AS lp FROM x),
own AS (SELECT lang, lp AS own FROM lp WHERE x = a)
SELECT lang, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, CASE WHEN any_value(r1) > 0 AND any_value(r2) > 0 THEN round(least(1, sum(exp(lp)) FILTER (exp(lp) <= exp(own) * (1 + 1e-7))), 6) END AS p FROM lp JOIN own USING (lang) GROUP BY lang""")
def fisher_exact_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.fisher_exact(_two_by_two(spark, sf_dir)).select("lang", "a", "b", "c", "d", *places("p"))


_Z = "1.959963984540054"


@query(f"""WITH {_TABLES}, w AS (SELECT lang, a AS x1, a + b AS n1, c AS x0, c + d AS n0, {_Z} AS z FROM t WHERE a + b > 0 AND c + d > 0), p AS (SELECT *, x1 / n1 AS p1, x0 / n0 AS p0 FROM w),
i AS (SELECT *, (p1 + z*z/(2*n1)) / (1 + z*z/n1) AS m1, z * sqrt(p1*(1-p1)/n1 + z*z/(4*n1*n1)) / (1 + z*z/n1) AS h1, (p0 + z*z/(2*n0)) / (1 + z*z/n0) AS m0, z * sqrt(p0*(1-p0)/n0 + z*z/(4*n0*n0)) / (1 + z*z/n0) AS h0 FROM p)
SELECT lang, round(p1 - p0, 6) AS diff, round(p1 - p0 - sqrt((p1 - (m1 - h1)) ** 2 + (m0 + h0 - p0) ** 2), 6) AS low, round(p1 - p0 + sqrt((m1 + h1 - p1) ** 2 + (p0 - (m0 - h0)) ** 2), 6) AS high FROM i""")
def newcombe_diff_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _two_by_two(spark, sf_dir).select("lang", F.col("a").alias("x1"), (F.col("a") + F.col("b")).alias("n1"), F.col("c").alias("x0"), (F.col("c") + F.col("d")).alias("n0")).filter("n1 > 0 AND n0 > 0")
    return inference.newcombe(t, "x1", "n1", "x0", "n0").select("lang", *places("diff", "low", "high"))


@query("""WITH r AS (SELECT lang, avg((quality = toxic)::INT) AS po, avg(quality) AS a, avg(toxic) AS b, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, n, round(po, 6) AS agreement, CASE WHEN a*b + (1-a)*(1-b) < 1 THEN round((po - (a*b + (1-a)*(1-b))) / (1 - (a*b + (1-a)*(1-b))), 6) END AS kappa FROM r""")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return inference.cohen_kappa(rows, "quality", "toxic", ["lang"]).select("lang", "n", *places("agreement", "kappa"))


@query(f"""WITH {_TABLES}, x AS (SELECT a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d, (a + b + c + d)::DOUBLE AS n FROM t WHERE a + b + c + d > 1),
s AS (SELECT count(*) AS n_strata, sum(a*d/n) AS r, sum(b*c/n) AS s, sum(a - (a+b)*(a+c)/n) AS gap, sum((a+b)*(c+d)*(a+c)*(b+d)/(n*n*(n-1))) AS v FROM x)
SELECT n_strata, round(r / nullif(s, 0), 6) AS odds_ratio, round(greatest(0, abs(gap) - 0.5) ** 2 / nullif(v, 0), 6) AS chi2 FROM s""")
def mantel_haenszel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.mantel_haenszel(_two_by_two(spark, sf_dir)).select("n_strata", *places("odds_ratio", "chi2"))


@query(f"""WITH {_TABLES}, s AS (SELECT lang, a + c AS k, a + b + c + d AS n FROM t), x AS (SELECT *, unnest(range(greatest(k, n - k), n + 1)) AS x FROM s)
SELECT lang, any_value(k) AS k, any_value(n) AS n, round(least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + n * ln(0.5)))), 6) AS p FROM x GROUP BY lang""")
def sign_test_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _two_by_two(spark, sf_dir).select("lang", (F.col("a") + F.col("c")).alias("k"), (F.col("a") + F.col("b") + F.col("c") + F.col("d")).alias("n"))
    return inference.binomial_tail(t, "k", "n", two_sided=True).select("lang", "k", "n", *places("p"))
