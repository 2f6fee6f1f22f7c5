"""Whitening of embeddings from an exact scatter matrix.

Vectors become whole numbers, x = floor(256 c). The scatter of the fit list (each distinct x once) is added up in residues:
every partition multiplies its rows, and a column of ones, by themselves modulo several primes, in blocks whose products a
double holds exactly; Spark adds the residues of all partitions, and the Chinese remainder theorem gives back the whole
numbers, since the product of the primes exceeds twice what the largest entry can be. Counts, sums and second moments are
exact, whatever the number of rows or the order in which they are added, and so is the covariance's numerator
n XX' - S S'. It is rounded once, to a double, and decomposed (eigh).

What comes to the driver are (d + 1)(d + 2) / 2 residues a prime for vectors of d dimensions, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, materialise

#: Rows of a product: with residues of at most half a prime under 2^21 its sums stay under 2^53.
BLOCK = 1 << 13
LIMIT = 1 << 21
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def primes(above: int) -> list[int]:
    """The largest primes under LIMIT, so many that their product exceeds `above`."""
    found, product, p = [], 1, LIMIT - 1
    while product <= above:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def from_residues(residues: list[int], moduli: list[int]) -> int:
    """The whole number nearest to zero with these residues."""
    product = int(np.prod([1], dtype=object))
    for p in moduli:
        product *= p
    x = sum(r * (product // p) * pow(product // p, -1, p) for r, p in zip(residues, moduli)) % product
    return x - product if 2 * x > product else x


def fixed_point(vector: Column) -> Column:
    """floor(256 c) of each entry as a long; beyond a long's range the nearest long."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * 256).cast("long"))


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the rows whose vector is neither null nor empty and holds no null and nothing that isn't finite."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad, F.lit(False))
    return table.filter(good).select(F.col(id_col).cast("long").alias("id"), fixed_point(F.col(vector_col)).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most BLOCK rows and their last column as a matrix."""
    for whole in batches:
        for first in range(0, whole.num_rows, BLOCK):
            b = whole.slice(first, BLOCK)
            yield b, b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def scatter_residues(fit: DataFrame, dims: int, moduli: list[int]) -> DataFrame:
    """(q, i, j, r): for each prime (by its number) the residue of entry i <= j of the scatter of (x, 1), added up over fit (x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(moduli), dims + 1, dims + 1), np.int64)
        for _, x in _matrices(batches, dims):
            for q, p in enumerate(moduli):
                r = x % p
                r = np.column_stack([np.where(r > p // 2, r - p, r), np.ones(len(x), np.int64)]).astype(np.float64)
                total[q] = (total[q] + (r.T @ r).astype(np.int64)) % p
        i, j = np.triu_indices(dims + 1)
        q = np.repeat(np.arange(len(moduli)), len(i))
        columns = [q.astype(np.int32), np.tile(i, len(moduli)).astype(np.int32), np.tile(j, len(moduli)).astype(np.int32), total[:, i, j].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "i", "j", "r"])

    sums = fit.select("x").mapInArrow(run, "q int, i int, j int, r long").groupBy("q", "i", "j").agg(F.sum("r").alias("r"))
    return sums.withColumn("r", F.pmod("r", F.element_at(F.array(*[F.lit(p).cast("long") for p in moduli]), F.col("q") + 1)))


@dataclass(frozen=True)
class Whitening:
    """n: vectors of the fit list; sums: their exact sums by dimension; values, vectors: of the covariance, falling, those that are kept (the
    vectors as columns); trace: of the covariance; largest: no entry of the fit list exceeds it in absolute value."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    largest: int

    @property
    def rank(self) -> int:
        """Of the kept components those with an eigenvalue above rounding."""
        return int((self.values > len(self.sums) * np.finfo(float).eps * max(self.trace, 0)).sum())

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S: exact, as int64 where that can't overflow, else as Python's whole numbers."""
        if 4 * self.n * self.largest < 1 << 62:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def squares(self, deviations: np.ndarray) -> list[int | None]:
        """Exact sums of squares by row; None where a long can't hold it."""
        if len(self.sums) * (2 * self.n * self.largest) ** 2 < 1 << 62:
            return (deviations.astype(np.int64) ** 2).sum(axis=1).tolist()
        sums = [sum(int(v) ** 2 for v in row) for row in deviations]
        return [s if s < 1 << 63 else None for s in sums]

    def project(self, deviations: np.ndarray) -> np.ndarray:
        """(x - S/n) on each component, over the root of its eigenvalue; NaN where that is zero."""
        out = np.full((len(deviations), len(self.values)), np.nan)
        k = self.rank
        centred = (deviations / self.n).astype(np.float64)
        out[:, :k] = centred @ self.vectors[:, :k] / np.sqrt(self.values[:k])
        return out


def decompose(n: int, sums: list[int], scatter: list[list[int]], keep: int, largest: int) -> Whitening:
    """The leading components of the covariance (n XX' - S S') / n^2 of whole numbers."""
    d = len(sums)
    v = np.array([[(n * scatter[i][j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    trace = sum(n * scatter[i][i] - sums[i] ** 2 for i in range(d)) / (n * n)
    return Whitening(n, sums, values[::-1][:keep].copy(), vectors[:, ::-1][:, :keep].copy(), trace, largest)


def fit(vectors: DataFrame, dims: int, components: int = 4) -> Whitening | None:
    """Components of vectors (x), each of them taken once as it is; None without vectors. Their distinct rows are the caller's to take."""
    ends = vectors.agg(F.count("*").alias("n"), F.max(F.array_max("x")).alias("most"), F.min(F.array_min("x")).alias("least")).first()
    if not ends.n:
        return None
    largest = max(1, abs(ends.most), abs(ends.least))
    moduli = primes(2 * ends.n * largest**2)
    found: dict[tuple[int, int], list[int]] = {}
    for r in scatter_residues(vectors, dims, moduli).collect():
        found.setdefault((r.i, r.j), [0] * len(moduli))[r.q] = r.r
    exact = {at: from_residues(residues, moduli) for at, residues in found.items()}
    scatter = [[exact[min(i, j), max(i, j)] for j in range(dims)] for i in range(dims)]
    return decompose(exact[dims, dims], [exact[i, dims] for i in range(dims)], scatter, min(components, dims), largest)


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened vectors (x) less the identity, over components with an eigenvalue
    above zero; None if there are none. Two passes: means, then products of what is left."""
    d, k = len(model.sums), model.rank
    if not k:
        return None

    def over(mean: np.ndarray | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k if mean is None else k * k)
            for _, x in _matrices(batches, d):
                z = model.project(model.deviations(x))[:, :k]
                total += z.sum(axis=0) if mean is None else ((z - mean).T @ (z - mean)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

        sums = vectors.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i")
        return np.array([r.v for r in sums.collect()]) / model.n

    return float(np.abs(over(over(None)).reshape(k, k) - np.eye(k)).max())


def transform(rows: DataFrame, model: Whitening, error: float | None) -> DataFrame:
    """SCHEMA for each row (id, x) and component of the model."""
    d, keep = len(model.sums), len(model.values)
    explained = [float(v) / model.trace if model.trace > 0 else None for v in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _matrices(batches, d):
            deviations, rows = model.deviations(x), len(x)
            white = model.project(deviations).ravel()
            columns = [
                b.column(0).take(pa.array(np.repeat(np.arange(rows), keep))),
                pa.array(np.tile(np.arange(1, keep + 1), rows), pa.int32()),
                pa.array(np.full(rows * keep, model.n), pa.int64()),
                pa.array(model.squares(deviations), pa.int64()).take(pa.array(np.repeat(np.arange(rows), keep))),
                pa.array(white, pa.float64(), mask=np.isnan(white)),
                pa.array(explained * rows, pa.float64()),
                pa.array([error] * (rows * keep), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.select("id", "x").mapInArrow(run, SCHEMA)


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and each of the leading components.

    Rows whose vector is null or empty, or holds a null or a value that isn't finite, are left out, and so are those of other
    than the most common dimension (of equally common ones the least). Rows that repeat an id or a vector, or have no id, are all
    returned, while equal vectors count once in the fit. Entries beyond the range of a long are the nearest long; a deviation that a long
    can't hold is null. Where a component's eigenvalue is zero whitened is null, and with a covariance of zero so are
    explained and identity_error. Equal eigenvalues leave the choice of their vectors open; all rows share it. Vectors of fewer
    dimensions have fewer components; an empty table gives an empty result. Other columns are not looked at, whatever their names."""
    spark = table.sparkSession
    with Scratch(spark, "whitening") as scratch:
        rows = scratch.write(whole_vectors(table, id_col, vector_col), "rows")
        common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if common is None:
            return spark.createDataFrame([], SCHEMA)
        rows = rows.filter(F.size("x") == common.d)
        fitted = scratch.write(rows.select("x").distinct(), "fit")
        model = fit(fitted, common.d, components)
        return materialise(transform(rows, model, identity_error(fitted, model)), "whitened")
