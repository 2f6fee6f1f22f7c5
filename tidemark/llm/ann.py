"""Maximum-inner-product search with score-aware quantisation.

A vector is its norm and a direction. Directions are cut into parts of two dimensions with a codebook of 16 centres each
(four bits). Centres and codes are chosen for the anisotropic loss: the part of the residual that is parallel to the
vector, which changes its inner products most where they are large, costs more than the rest. Since norms are kept apart,
codes serve vectors of any scale. Queries make a table of inner products with all centres, blocks of codes are scanned with
those tables, and what can be among the best of a block is scored again: first on copies of the directions in single
precision that lie beside the codes (the members of a large group of near copies differ by less than four-bit codes can
tell), then, for the best of all blocks, on the original vectors in double precision.

The codebooks are fitted on a bounded sample, every vector is encoded. Queries go in blocks of a bounded size to the tasks that
read the written codes, so that codes are never shuffled; a task gives back a few candidates for each query. Each block of
queries meets all codes, as an answer for a stated query set asks for: what is read grows with rows times queries /
query_block, what is shuffled with queries times tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, materialise

PART, CENTRES = 2, 16


@dataclass(frozen=True)
class Quantiser:
    """centres: parts x 16 x 2; weight: of the parallel residual against the rest; dims: of the vectors."""

    centres: np.ndarray
    weight: float
    dims: int
    error: float = 0.0  # standard deviation of the error of an inner product with a vector of length one

    def pad(self, x: np.ndarray) -> np.ndarray:
        parts = len(self.centres)
        return np.pad(x, ((0, 0), (0, parts * PART - x.shape[1]))).reshape(len(x), parts, PART)

    def encode(self, x: np.ndarray, rounds: int = 3) -> np.ndarray:
        """Codes of rows by coordinate descent on |r|^2 + (weight - 1) (r.u)^2 with r the residual and u the direction of the row."""
        v = self.pad(x)
        u = self.pad(x / np.linalg.norm(x, axis=1, keepdims=True))
        parts = len(self.centres)
        plain = np.stack([((v[:, m, None, :] - self.centres[m]) ** 2).sum(-1) for m in range(parts)], 1)
        along = np.stack([((v[:, m, None, :] - self.centres[m]) * u[:, m, None, :]).sum(-1) for m in range(parts)], 1)
        codes = plain.argmin(-1)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(rounds):
            for m in range(parts):
                rest = total - along[rows, m, codes[:, m]]
                codes[:, m] = (plain[:, m] + (self.weight - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
                total = rest + along[rows, m, codes[:, m]]
        return codes.astype(np.uint8)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return codes[:, ::2] | (codes[:, 1::2] << 4)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query with each pair of centres: queries x bytes x 256."""
        t = np.einsum("qmd,mcd->qmc", self.pad(queries), self.centres).astype(np.float32)
        if t.shape[1] % 2:
            t = np.concatenate([t, np.zeros((len(t), 1, CENTRES), np.float32)], 1)
        low, high = t[:, ::2], t[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(t), -1, CENTRES * CENTRES)


def train(x: np.ndarray, threshold: float = 0.2, rounds: int = 8, seed: int = 11) -> Quantiser:
    """Codebooks for the rows of x. threshold: share of a vector's norm that inner products of interest exceed; with d dimensions
    the parallel residual weighs (d - 1) t^2 / (1 - t^2) against the rest, 1 at least."""
    n, d = x.shape
    weight = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    parts = -(-d // PART)
    q = Quantiser(np.zeros((parts, CENTRES, PART)), weight, d)
    v = q.pad(x)
    rng = np.random.default_rng(seed)
    centres = v[rng.integers(0, n, CENTRES)].transpose(1, 0, 2).copy() + 1e-6 * rng.standard_normal((parts, CENTRES, PART))
    for m in range(parts):  # a plain k-means start
        for _ in range(rounds):
            near = ((v[:, m, None, :] - centres[m]) ** 2).sum(-1).argmin(1)
            for c in np.unique(near):
                centres[m, c] = v[near == c, m].mean(0)
    q = Quantiser(centres, weight, d)
    u = q.pad(x / np.linalg.norm(x, axis=1, keepdims=True))
    for _ in range(rounds // 2):
        codes = q.encode(x, 1)
        centres = q.centres.copy()
        r = v - centres[np.arange(parts)[None, :], codes]
        along = (r * u).sum(-1)
        total = along.sum(1)
        for m in range(parts):
            rest = total - along[:, m]
            for c in np.unique(codes[:, m]):
                at = codes[:, m] == c
                a = at.sum() * np.eye(PART) + (weight - 1) * u[at, m].T @ u[at, m]
                b = v[at, m].sum(0) + (weight - 1) * (u[at, m] * ((v[at, m] * u[at, m]).sum(1) + rest[at])[:, None]).sum(0)
                centres[m, c] = np.linalg.solve(a + 1e-9 * np.eye(PART), b)
        q = Quantiser(centres, weight, d)
    r = v - centres[np.arange(parts)[None, :], q.encode(x)]
    return Quantiser(centres, weight, d, float(np.sqrt((r**2).sum() / len(x) / d)))


def usable(col: Column) -> Column:
    """Not null, not empty, no component null or not finite, not all zero."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(col.isNotNull() & (F.size(col) > 0) & ~bad & F.exists(col, lambda x: x != 0), F.lit(False))


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, id, v): the rows with a usable vector and an id, and a number for each row, which holds once this is written."""
    v = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "v")


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and norms of rows of any scale."""
    most = np.abs(x).max(axis=1, keepdims=True)
    u = x / most
    norm = np.linalg.norm(u, axis=1, keepdims=True)
    return u / norm, (most * norm)[:, 0]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def encoded(base: DataFrame, quantiser: Quantiser) -> DataFrame:
    """(row, id, norm, code, copy) of (row, id, v)."""
    sent = base.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for whole in batches:
            for first in range(0, whole.num_rows, 4096):
                b = whole.slice(first, 4096)
                u, norm = directions(_matrix(b.column(2), q.dims))
                packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (q.pack(q.encode(u)), u.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(norm), *packed], names=["row", "id", "norm", "code", "copy"])

    return base.select("row", "id", "v").mapInArrow(run, "row long, id long, norm double, code binary, copy binary")


def scan_block(q: Quantiser, qs: pd.DataFrame, cs: pd.DataFrame, candidates: int) -> pd.DataFrame:
    """(query, row, id, approx): for each query (row, v) the best `candidates` of a block of codes (row, id, norm, code, copy), the
    query's own row left out. The table scan picks at least that many and all that its error leaves in question."""
    out = [pd.DataFrame({"query": np.zeros(0, np.int64), "row": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "approx": np.zeros(0)})]
    if len(qs) and len(cs):
        cs = cs.sort_values(["id", "row"])
        rows, ids, norm = (cs[c].to_numpy() for c in ("row", "id", "norm"))
        code = np.frombuffer(b"".join(cs["code"]), np.uint8).reshape(len(cs), -1)
        copy = np.frombuffer(b"".join(cs["copy"]), np.float32).reshape(len(cs), -1)
        columns = [np.ascontiguousarray(code[:, m]) for m in range(code.shape[1])]
        depth = min(len(cs), 2 * candidates)
        for at in range(0, len(qs), 32):
            part = qs.iloc[at : at + 32]
            u, _ = directions(np.stack(part["v"].to_numpy()))
            tables = q.tables(u)
            for j, query in enumerate(part["row"].tolist()):
                score = np.zeros(len(cs), np.float32)
                for m, c in enumerate(columns):
                    score += tables[j, m].take(c)
                score = score * norm
                least = np.partition(score, len(cs) - depth)[len(cs) - depth]
                near = np.flatnonzero((score + 3 * q.error * norm >= least) & (rows != query))
                fine = (copy[near] @ u[j].astype(np.float32)) * norm[near]
                best = np.argsort(-fine, kind="stable")[:candidates]
                pick = near[best]
                out.append(pd.DataFrame({"query": query, "row": rows[pick], "id": ids[pick], "approx": fine[best]}))
    return pd.concat(out, ignore_index=True)


def _best(found: list[pd.DataFrame], keep: int) -> pd.DataFrame:
    """The best `keep` of each query, of equal ones the least id."""
    rows = pd.concat(found, ignore_index=True).sort_values(["query", "approx", "id", "row"], ascending=[True, False, True, True], kind="stable")
    return rows.groupby("query", sort=False).head(keep)


def scan(codes: DataFrame, quantiser: Quantiser, queries: list[Row], candidates: int, keep: int, code_block: int) -> DataFrame:
    """(query, row, id, approx): what each task that reads codes has for each of a bounded block of queries (row, v)."""
    block = pd.DataFrame({"row": [r.row for r in queries], "v": [np.array(r.v) for r in queries]})
    sent = codes.sparkSession.sparkContext.broadcast((quantiser, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, qs = sent.value
        held, size = [scan_block(q, qs.iloc[:0], qs.iloc[:0], candidates)], 0
        for b in batches:
            for at in range(0, b.num_rows, code_block):
                held.append(scan_block(q, qs, b.slice(at, code_block).to_pandas(), candidates))
                size += len(held[-1])
            if size > 4 * keep * len(qs):
                held = [_best(held, keep)]
                size = len(held[0])
        yield pa.RecordBatch.from_pandas(_best(held, keep), preserve_index=False)

    return codes.mapInArrow(run, "query long, row long, id long, approx double")


def search(
    table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    candidates: int = 64, sample: int = 8_000, query_block: int = 4096, code_block: int = 16_384,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by `every`, its k nearest of all others by inner product in
    double precision, nearest first, of equal ones the least id.

    Vectors that are null, empty or zero, or that hold a null or a value that isn't finite, take no part, nor do rows without an
    id or of a dimension other than the most common one. Every row is a candidate for every query but itself: rows that repeat
    an id are rows of their own, as queries and as candidates. Of vectors that are equal only the k + 1 least ids can be
    among the nearest, so that only those are searched for. With fewer than k candidates all are returned; an empty table gives an
    empty result. candidates: how many of each block of codes, and then of all, are scored again on copies and on the vectors. Extra columns
    of any name are not looked at."""
    spark = table.sparkSession
    with Scratch(spark, "vectors") as scratch:
        rows = scratch.write(vectors(table, id_col, vector_col), "rows")
        common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        if common is None:
            return empty
        rows = rows.filter(F.size("v") == common.d)
        # Equal vectors (their hashes only make comparing them cheap): the least ids of each of 64 shares of them, then the least of those.
        base = rows.select("row", "id", "v", F.xxhash64("v").alias("g"), F.expr("pmod(xxhash64(row), 64)").alias("s"))
        for keys in (["g", "v", "s"], ["g", "v"]):
            place = F.row_number().over(Window.partitionBy(*keys).orderBy("id", "row"))
            base = base.withColumn("r", place).filter(F.col("r") <= k + 1)
        base = rows.join(base.select("row"), "row", "left_semi")

        part = rows.select("v").orderBy(F.xxhash64("v"), "row").limit(sample)
        quantiser = train(directions(np.array([r.v for r in part.collect()]))[0])
        codes = scratch.write(encoded(base, quantiser), "codes")
        queries = scratch.write(rows.filter(F.pmod("id", F.lit(every)) == 0), "queries")
        n_queries = queries.count()
        if not n_queries:
            return empty
        blocks = -(-n_queries // query_block)
        found = None
        for block in range(blocks):
            asked = queries.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "v").collect()
            if asked:
                part = scratch.write(scan(codes, quantiser, asked, candidates, min(candidates, 2 * k), code_block), "found")
                found = part if found is None else found.unionByName(part)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("approx"), "id", "row"))
        best = scratch.write(found.withColumn("r", place).filter(F.col("r") <= candidates).select("query", "row"), "best")
        exact = best.join(rows.select("row", F.col("id").alias("vec_id"), F.col("v").alias("x")), "row")
        exact = exact.join(queries.select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("q")), "query")
        score = F.aggregate(F.zip_with("x", "q", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
        exact = exact.select("query", "query_id", "row", "vec_id", score.alias("score")).withColumn("rank", F.row_number().over(ranked))
        return materialise(exact.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest")
