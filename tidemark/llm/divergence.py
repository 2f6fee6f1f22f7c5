"""How the sources of a language differ in their use of terms: DuckDB over hash shards, merged by Spark.

Tasks that scan texts count terms in Arrow batches, so that a term of a source is one row for each task however often it
occurs. These rows are dealt into shards by language and term; a shard has all that is known of its terms, and DuckDB runs
over it in one task, twice. First it adds the counts up and keeps the terms that enough documents of the language hold.
With the totals of all shards it then gives the shard's part of every pair of sources, and the shard's leading terms of each
source. Spark adds the parts up and ranks what the shards have brought.

All is in whole numbers. With N occurrences of V kept terms in a group, a term that occurs n times there has
p = 1 + floor(10^9 (n + 1) / (N + V)), and two groups differ in it by f(p, q) = floor((p - q)^2 / q). Of a pair of
sources, terms that neither has all give the same f; so a shard only joins terms that both have, counts those that one of them has by
their p, and the rest follows from how many there are: the work follows the counted rows and not terms times pairs.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, buffers, distinct_spans, map_texts, materialise, pieces, text_of, word_spans

#: Bytes of lower-cased terms: ASCII letters and all of UTF-8 beyond ASCII; the rest becomes a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TABLE = np.frombuffer(TERM_BYTES, dtype=np.uint8)
#: Counted rows that a task gathers before it gives them out.
FLUSH = 1 << 20
#: Bytes of text for each shard.
SHARD_BYTES = 8 << 20
SCALE = 1_000_000_000
COUNTS = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, source string, term string, n long, head int, shard int"
PARTS = "lang string, source string, part string, item string, value decimal(38,0)"


def _duckdb(tables: dict[str, pa.Table], sql: str, setup: str = "") -> pa.Table:
    """The result of a query over Arrow tables, in a DuckDB of this task alone."""
    import duckdb

    with tempfile.TemporaryDirectory() as folder, duckdb.connect() as db:
        db.execute(f"SET threads = 1; SET memory_limit = '600MB'; SET temp_directory = '{folder}'; SET preserve_insertion_order = false; {setup}")
        for name, table in tables.items():
            db.register(name, table)
        return db.execute(sql).to_arrow_table()


def _count_piece(lang: pa.Array, source: pa.Array, data: np.ndarray, at: np.ndarray) -> pa.Table:
    """COUNTS of the rows of a piece."""
    lang, source = (c.dictionary_encode() for c in (lang, source))
    pairs = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
    starts, ends, owner = word_spans(data, at)
    codes, first = distinct_spans(data, starts, ends)
    terms = max(1, len(first))
    of, each = np.unique(owner * terms + codes, return_counts=True)  # a row for each document and term
    key, back = np.unique(pairs[of // terms] * terms + of % terms, return_inverse=True)
    n = np.bincount(back, weights=each, minlength=len(key)).astype(np.int64)
    docs = np.bincount(back, minlength=len(key)).astype(np.int64)
    raw = data.tobytes()
    named = pa.array([raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())], pa.binary()).cast(pa.string())
    pair, term = key // terms, key % terms
    langs, sources = (pa.array(x) for x in np.divmod(pair, max(1, len(source.dictionary))))
    columns = [lang.dictionary.take(langs), source.dictionary.take(sources), named.take(pa.array(term)), pa.array(n), pa.array(docs)]
    return pa.table(columns, names=[c.split()[0] for c in COUNTS.split(", ")])


def local_counts(docs: DataFrame) -> DataFrame:
    """COUNTS of rows (lang, source, t), added up within each task: once, or each time that FLUSH rows have come together."""

    def combined(tables: list[pa.Table]) -> pa.Table:
        keys = ["lang", "source", "term"]
        out = pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")])
        return out.select([*keys, "n_sum", "docs_sum"]).rename_columns([*keys, "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            data, at = buffers(b.column(2))
            data = _TABLE[data]
            for s, e in pieces(at):
                held.append(_count_piece(b.column(0).slice(s, e - s), b.column(1).slice(s, e - s), data[at[s] : at[e]], at[s : e + 1] - at[s]))
                rows += held[-1].num_rows
                if rows > FLUSH:
                    held = [combined(held)]
                    rows = held[0].num_rows
                    if 2 * rows > FLUSH:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from combined(held).to_batches()

    return map_texts(docs, run, COUNTS)


def kept_counts(counts: DataFrame, shards: int, least: int) -> DataFrame:
    """KEPT: counts of the terms that at least so many documents of their language hold; head is 1 in one row of each language and term."""
    sql = f"""
        SELECT lang, source, term, n, CAST(row_number() OVER (PARTITION BY lang, term) = 1 AS INT) AS head, shard
        FROM (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs, any_value(shard) AS shard
              FROM counted GROUP BY lang, source, term)
        QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {least}"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := list(batches):
            yield from _duckdb({"counted": pa.Table.from_batches(got)}, sql).to_batches()

    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard")
    return counts.select("*", shard).repartition(shards, "shard").mapInArrow(run, KEPT)


_MACROS = f"""
    CREATE MACRO share(n, total) AS 1 + ({SCALE}::HUGEINT * (n + 1)) // total;
    CREATE MACRO f(p, q) AS ((p - q) * (p - q)) // q;"""
#: Parts of a shard: groups has lang, source, total (N + V of the source) and whole (of the language); kept is KEPT.
_SHARD_SQL = """
    WITH g AS MATERIALIZED (SELECT lang, source, share(0, total) AS zero FROM groups WHERE total > 0),
    k AS MATERIALIZED (SELECT lang, source, term, n, share(n, total) AS p, share(0, total) AS zero FROM kept JOIN groups USING (lang, source)),
    h AS MATERIALIZED (SELECT lang, source, p, zero, count(*) AS terms FROM k GROUP BY ALL),
    pairs AS (
        SELECT a.lang, a.source, b.source AS item, sum(f(a.p, b.p) - f(a.p, b.zero) - f(a.zero, b.p) + f(a.zero, b.zero)) AS value
        FROM k a JOIN k b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        UNION ALL
        SELECT h.lang, h.source, g.source, sum(terms * (f(h.p, g.zero) - f(h.zero, g.zero)))
        FROM h JOIN g ON h.lang = g.lang AND h.source <> g.source GROUP BY ALL
        UNION ALL
        SELECT h.lang, g.source, h.source, sum(terms * (f(g.zero, h.p) - f(g.zero, h.zero)))
        FROM h JOIN g ON h.lang = g.lang AND h.source <> g.source GROUP BY ALL),
    q AS (SELECT lang, term, share(sum(n), any_value(whole)) AS q FROM kept JOIN groups USING (lang, source) GROUP BY ALL),
    terms AS (
        SELECT lang, source, term AS item, f(p, q) AS value FROM k JOIN q USING (lang, term) WHERE p > q
        QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f(p, q) DESC, term) <= {top})
    SELECT lang, source, 'pair' AS part, item, CAST(sum(value) AS DECIMAL(38, 0)) AS value FROM pairs GROUP BY ALL
    UNION ALL SELECT lang, source, 'term', item, CAST(value AS DECIMAL(38, 0)) FROM terms"""


def shard_parts(kept: DataFrame, groups: DataFrame, shards: int, top: int) -> DataFrame:
    """PARTS of each shard: for pairs of sources what its terms add to those of terms that neither has, and the leading terms of a source."""
    names = [c.split()[0] for c in PARTS.split(", ")]
    kinds = pa.schema([*[(n, pa.string()) for n in names[:4]], (names[4], pa.decimal128(38, 0))])

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return kinds.empty_table()
        return _duckdb({"kept": rows, "groups": known}, _SHARD_SQL.replace("{top}", str(top)), _MACROS).cast(kinds)

    each = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    return kept.groupBy("shard").cogroup(each.groupBy("shard")).applyInArrow(run, PARTS)


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top: int = 200,
) -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: each other source of the language and the sum of f(p, q) over all kept terms, q
    the other's. Part `term`: the leading `top` terms that the source has and uses more than its language (q), and their f.

    A null text, language or source counts as ''; a row is a document, also one that repeats an id or a text or has no id. Terms are runs of ASCII
    letters and of all beyond ASCII, only A-Z lower-cased. Sources without a term (empty texts, only rare terms) take part; a language
    without kept terms has pairs of value 0. Ties are ranked by the item's UTF-8 bytes. A term that holds a large share of all text is
    one row for each task and source; a long text is counted in one task. An empty table gives an empty result; other columns are not looked at,
    whatever their names."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text_of(text_col).alias("t"))
    with Scratch(docs.sparkSession, "divergence") as scratch:
        sources = rows.groupBy("lang", "source").agg(F.sum(F.octet_length("t")).alias("bytes"))
        sources = scratch.write(sources, "sources")
        shards = 1 + (sources.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES
        kept = scratch.write(kept_counts(local_counts(rows), shards, least_docs), "kept")
        langs = kept.groupBy("lang").agg(F.sum("head").alias("v"), F.sum("n").alias("all"))
        own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
        groups = sources.select("lang", "source").join(langs, "lang", "left").join(own, ["lang", "source"], "left").fillna(0)
        groups = groups.select("lang", "source", "v", (F.col("own") + F.col("v")).alias("total"), (F.col("all") + F.col("v")).alias("whole"))
        groups = scratch.write(groups, "groups")
        parts = scratch.write(shard_parts(kept, groups, shards, top), "parts")

        # What a term that neither source has gives, for all kept terms.
        share = F.when(F.col("v") > 0, F.expr(f"1 + {SCALE} div total")).alias("zero")
        one = groups.select("lang", "v", "source", share)
        other = one.select("lang", F.col("source").alias("item"), F.col("zero").alias("q"))
        f = F.expr("((zero - q) * (zero - q)) div q")
        none = F.coalesce(f, F.lit(0)).cast("decimal(19,0)") * F.col("v").cast("decimal(18,0)")
        base = one.join(other, "lang").filter("source <> item")
        base = base.select("lang", "source", F.lit("pair").alias("part"), "item", none.cast("decimal(38,0)").alias("value"))
        pairs = parts.filter("part = 'pair'").unionByName(base)
        pairs = pairs.groupBy("lang", "source", "part", "item").agg(F.sum("value").cast("long").alias("value"))
        ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        place = F.row_number().over(ranked).alias("rank")
        terms = parts.filter("part = 'term'").withColumn("value", F.col("value").cast("long")).select("*", place).filter(F.col("rank") <= top)
        return materialise(pairs.select("*", place).unionByName(terms), "divergence")
