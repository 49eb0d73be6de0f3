"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest distance with one more coordinate: with M the largest norm,
a vector x goes to (x, sqrt(M^2 - |x|^2)) / M and a query q to (q, 0) / |q|. A table hashes by some
Gaussian projections, shifted and cut into cells. A query visits its own cell and the perturbed
ones around it in the order of their estimated success, that is of the sum of squared distances
to the cells. Members of the visited cells are ranked by exact inner products on the original vectors.

The number of probes is set on a bounded sample: up to ``tuned_on`` queries are answered by brute
force over all vectors, and the fewest probes that find the wanted share of their neighbours are
taken. If no number of probes does, the cells are widened.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siftline.llm.common import written
from siftline.llm.ngram_join import whole_groups


@dataclass(frozen=True)
class Search:
    k: int = 20
    tables: int = 6
    hashes: int = 5
    #: Width of a cell, in standard deviations of the projections.
    width: float = 2.0
    wanted_recall: float = 0.96
    tuned_on: int = 64
    #: Vectors of a cell in one block; larger cells are cut, so that no task holds one whole.
    block: int = 2048
    seed: int = 5


@dataclass
class Tables:
    planes: np.ndarray
    shifts: np.ndarray
    width: float
    largest: float
    probes: int = 1
    #: Share of the sampled neighbours that these probes find.
    recall: float = 1.0

    def __post_init__(self) -> None:
        m = self.planes.shape[1]
        #: All perturbations by at most one cell in each direction.
        self.steps = np.array(list(product((0, -1, 1), repeat=m)), np.int64)

    def places(self, lifted: np.ndarray) -> np.ndarray:
        """Projections in units of cells: rows, tables, hashes."""
        return np.einsum("nd,thd->nth", lifted, self.planes) / self.width + self.shifts

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest**2 - (x * x).sum(1), 0))
        return np.concatenate((x, rest[:, None]), 1) / self.largest

    @staticmethod
    def lift_queries(q: np.ndarray) -> np.ndarray:
        return np.concatenate((q / np.linalg.norm(q, axis=1)[:, None], np.zeros((len(q), 1))), 1)

    def costs(self, place: np.ndarray) -> np.ndarray:
        """Cost of each perturbation for each row and table: the sum of squared distances to the cell."""
        inside = place - np.floor(place)
        down, up = (inside**2), (1 - inside) ** 2
        return down @ (self.steps == -1).T.astype(float) + up @ (self.steps == 1).T.astype(float)

    def codes(self, table: int, cells: np.ndarray) -> np.ndarray:
        code = np.full(cells.shape[:-1], table + 1, np.int64)
        for i in range(cells.shape[-1]):
            code = (code ^ cells[..., i]) * np.int64(6364136223846793005 & 0x7FFFFFFFFFFFFFFF)
            code ^= code >> np.int64(29)
        return code


def usable(vector: Column) -> Column:
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.ListArray) -> np.ndarray:
    values, offsets = column.values.to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    return values[offsets[0] : offsets[-1]].reshape(len(column), -1).astype(np.float64)


def _best(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, own: int, k: int, rough: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids and exact scores of the k best, ties to smaller ids; ``rough``: scores up to rounding."""
    rough = np.where(ids == own, -np.inf, rough)
    if len(rough) > k:
        edge = np.partition(rough, len(rough) - k)[len(rough) - k]
        at = np.flatnonzero(rough >= edge - 1e-9 * (1 + abs(edge)))
    else:
        at = np.arange(len(rough))
    at = at[ids[at] != own]
    exact = (vectors[at] * query).sum(1)
    order = np.lexsort((ids[at], -exact))[:k]
    return ids[at][order], exact[order]


def _top(rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of each query's best rows; a vector found more than once counts once."""
    once = rows.dropDuplicates(["query_id", "vec_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_FOUND = "query_id long, vec_id long, score double"


def _found(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    queries = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(queries), pa.array(np.concatenate([r[1] for r in rows]).astype(np.int64)), pa.array(np.concatenate([r[2] for r in rows]))], ["query_id", "vec_id", "score"])


def brute_force(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Exact neighbours of a stated, bounded set of queries among all vectors, in blocks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = batch.column(0).to_numpy(), _matrix(batch.column(1)) if len(batch) else None
            if x is not None:
                rough = queries @ x.T
                yield _found([(int(q), *_best(own, x, v, int(q), k, r)) for q, v, r in zip(ids, queries, rough, strict=True)])

    return _top(vectors.select("vec_id", "embedding").mapInArrow(scan, _FOUND), k)


def tuned(vectors: DataFrame, queries: DataFrame, how: Search) -> Tables | None:
    """Tables whose probes reach the wanted recall on the sample; None without vectors."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    largest, dim = vectors.agg(F.max(norm), F.max(F.size("embedding"))).first()
    sample = queries.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id", F.lit(how.seed)), "vec_id").limit(how.tuned_on).collect()
    if not largest or not sample:
        return None
    ids, q = np.array([r.vec_id for r in sample]), np.array([list(r.embedding) for r in sample], np.float64)
    exact = written(brute_force(vectors, ids, q, how.k), "exact")
    near = exact.join(vectors, "vec_id").select("query_id", "vec_id", "embedding").collect()  # tuned_on * k rows at most
    rng = np.random.Generator(np.random.PCG64(how.seed))
    planes = rng.standard_normal((how.tables, how.hashes, dim + 1))
    shifts = rng.random((how.tables, how.hashes))
    tables = Tables(planes, shifts, 1.0, float(largest))
    if not near:
        return tables
    lifted = tables.lift_queries(q)
    tables.width = how.width * float(np.std(np.einsum("nd,thd->nth", lifted, planes)))
    place = {int(i): n for n, i in enumerate(ids)}
    rows = np.array([place[r.query_id] for r in near])
    x = tables.lift(np.array([list(r.embedding) for r in near], np.float64))
    while True:
        at, own = tables.places(lifted)[rows], tables.places(x)
        moved = np.floor(own) - np.floor(at)
        reach = (np.abs(moved) <= 1).all(2)
        digit = np.where(moved == -1, 1, np.where(moved == 1, 2, 0)).astype(np.int64)
        which = (digit * 3 ** np.arange(how.hashes - 1, -1, -1)).sum(2)
        costs = tables.costs(at)
        cost = np.take_along_axis(costs, which[:, :, None], 2)
        rank = np.where(reach, (costs < cost).sum(2) + 1, np.iinfo(np.int64).max).min(1)
        needed = np.sort(rank)[min(len(rank) - 1, int(np.ceil(how.wanted_recall * len(rank))) - 1)]
        if needed <= len(tables.steps) // 3 or tables.width > 64 * np.abs(planes).sum():
            tables.probes = int(min(needed, len(tables.steps)))
            tables.recall = float((rank <= tables.probes).mean())
            return tables
        tables.width *= 1.25


def _ranked(stored: DataFrame, probing: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of the vectors that share a cell and block with a query."""
    met = stored.unionByName(probing).repartition("cell", "block").sortWithinPartitions("cell", "block", "asks")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in whole_groups(batches, 2):
            asks, ids, x = batch.column(2).to_numpy(), batch.column(3).to_numpy(), _matrix(batch.column(4))
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                m = a + int(np.searchsorted(asks[a:b], 1))
                for lo in range(m, b if m > a else m, 512):
                    hi = min(b, lo + 512)
                    rough = x[lo:hi] @ x[a:m].T
                    out += [(int(ids[i]), *_best(ids[a:m], x[a:m], x[i], int(ids[i]), k, rough[i - lo])) for i in range(lo, hi)]
            out = [r for r in out if len(r[1])]
            if out:
                yield _found(out)

    return _top(met.mapInArrow(rank, _FOUND), k).select(F.col("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _all_pairs(vectors: DataFrame, queries: DataFrame, blocks: int, parts: int, k: int) -> DataFrame:
    """Exact neighbours of distinct queries, every part of them against every block of the vectors."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = vectors.select("*", every(parts).alias("cell")).select(F.col("cell").cast("long").alias("cell"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "vec_id", "embedding")
    probing = queries.select("*", every(blocks).alias("block")).select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("long").alias("cell"), "block", F.lit(1).alias("asks"), "vec_id", "embedding")
    return _ranked(stored, probing, k)


def _one_row_an_id(vectors: DataFrame) -> DataFrame:
    """Usable vectors; single precision stays as it is until a task computes with it."""
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", "embedding")
    if rows.schema["embedding"].dataType.elementType.typeName() != "float":
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def search(vectors: DataFrame, queries: DataFrame, how: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k nearest found by largest inner product.

    Both tables have vec_id and embedding. Vectors that are null, zero, or hold null or non-finite
    components take no part, nor do those of another length than the most frequent one (ties: the
    smaller), nor does a vector under its own id as query. Equal scores go to smaller
    ids. Fewer candidates than k give all of them; a list that comes out shorter is answered by brute
    force, at the cost of its query times all vectors; empty tables an empty table. Rows that repeat an
    id count once, with the smallest of its vectors.
    """
    spark = vectors.sparkSession
    # Distinct ids before any list is cut to k: copies of one vector share every cell and would fill its places.
    length = F.size("embedding")
    common = vectors.where(usable(F.col("embedding"))).groupBy(length.alias("length")).count().orderBy(F.desc("count"), "length").first()
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return nothing
    valid = written(_one_row_an_id(vectors.where(length == common.length)), "vectors")
    asked = _one_row_an_id(queries.where(length == common.length))
    tables = tuned(valid, asked, how)
    if tables is None:
        return nothing
    if tables.recall < how.wanted_recall:
        warnings.warn(f"no number of probes finds more than {tables.recall:.3f} of the sampled neighbours", stacklevel=2)

    def cells(as_query: bool):  # noqa: ANN202
        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                x = _matrix(batch.column(1))
                place = tables.places(tables.lift_queries(x) if as_query else tables.lift(x))
                base = np.floor(place).astype(np.int64)
                order = np.argsort(tables.costs(place), axis=2, kind="stable")[:, :, : tables.probes] if as_query else None
                for t in range(how.tables):
                    found = base[:, t][:, None] + tables.steps[order[:, t]] if as_query else base[:, t][:, None]
                    code = tables.codes(t, found)
                    rows = pa.array(np.repeat(np.arange(len(x)), code.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(code.ravel()), batch.column(0).take(rows), batch.column(1).take(rows)], ["cell", "vec_id", "embedding"])

        return hashed

    schema = f"cell long, vec_id long, embedding {valid.schema['embedding'].dataType.simpleString()}"
    members = valid.mapInArrow(cells(False), schema)
    sizes = written(members.select("cell").groupBy("cell").agg(F.count("*").alias("size")), "cells").withColumn("blocks", F.ceil(F.col("size") / how.block).cast("int"))
    stored = members.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("asks"), "vec_id", "embedding")
    probing = asked.mapInArrow(cells(True), schema).join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "vec_id", "embedding")
    found = written(_ranked(stored, probing, how.k), "found")

    # Lists that the probes left short are answered anew from all vectors.
    n = valid.count()
    own = valid.select("vec_id", F.lit(1).alias("own"))
    sized = asked.join(found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("found")), "vec_id", "left").join(own, "vec_id", "left")
    all_there = F.least(F.lit(how.k), F.lit(n) - F.coalesce("own", F.lit(0)))
    short = written(sized.where(F.coalesce("found", F.lit(0)) < all_there).select("vec_id", "embedding"), "short")
    if (n_short := short.count()) == 0:
        return found
    whole = _all_pairs(valid, short, -(-n // how.block), -(-n_short // how.block), how.k)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(whole)
