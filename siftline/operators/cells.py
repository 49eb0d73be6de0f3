"""Exact vector search that visits only cells whose bound can reach the first k.

Vectors are grouped by direction around centres found by k-means on a bounded sample, and a large cell
is cut into blocks. A block knows the largest angle to its centre and the range of each component, so a
question's inner product with any of its vectors has two bounds: by the triangle inequality of angles,
and by the range of each component. A first pass compares each question with the blocks of
the highest bounds and gives it a threshold; a second visits the blocks whose bound reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.sources.scratch import written

#: Vectors that the centres are sought on, at most, and rounds of k-means.
SAMPLED, ROUNDS = 8192, 6
#: Slack of the bounds for rounding.
SLACK = 1e-8


@dataclass
class CellIndex:
    #: block, chunk_id, idx, value and boost.
    vectors: DataFrame
    #: block, n, boost (the largest), radius, centre, and lo and hi of the components.
    blocks: DataFrame
    n_blocks: int
    block: int


def dense(ids: list, values: list, dim: int) -> np.ndarray:
    """Rows of a sparse matrix (components and values of each row) as a dense one."""
    out = np.zeros((len(ids), dim))
    rows = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    if len(rows):
        out[rows, np.concatenate(ids)] = np.concatenate(values)
    return out


def _centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def build_cells(vectors: DataFrame, cells: int = 512, block: int = 64, dim: int = 256, seed: int = 7) -> CellIndex:
    """An index of normalized sparse vectors (chunk_id, idx, value, and boost if the scores have one)."""
    if "boost" not in vectors.columns:
        vectors = vectors.withColumn("boost", F.lit(1.0))
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("chunk_id", F.lit(seed)), "chunk_id").limit(SAMPLED).select("idx", "value").toPandas()
    x = dense(sample["idx"].to_list(), sample["value"].to_list(), dim)
    centres = _centres(x, max(1, min(cells, len(x) // 4, n // block)), seed) if len(x) else np.zeros((1, dim))
    # Cells are cut into blocks by a hash, from their exact sizes.

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = dense(batch.column(1).to_pylist(), batch.column(2).to_pylist(), dim)
            own = (rows @ centres.T).argmax(1) if len(rows) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), *batch.columns], ["cell", "chunk_id", "idx", "value", "boost"])

    celled = written(vectors.select("chunk_id", "idx", "value", F.col("boost").cast("double").alias("boost")).mapInArrow(placed, "cell long, chunk_id string, idx array<int>, value array<double>, boost double"), "cells")
    sizes = F.broadcast(celled.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("slices")))  # one row a cell
    number = F.col("cell") * 2**32 + F.pmod(F.xxhash64("chunk_id"), F.col("slices"))
    # Rows in order of block, so that a reader of few blocks skips most row groups.
    rows = written(celled.join(sizes, "cell").select(number.alias("block"), "chunk_id", "idx", "value", "boost").repartition("block").sortWithinPartitions("block"), "blocks")

    def summary(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        y = dense(part["idx"].to_list(), part["value"].to_list(), dim)
        cell = int(key[0]) >> 32
        radius = float(np.arccos(np.clip(y @ centres[cell], -1, 1)).max())
        return pd.DataFrame({"block": [int(key[0])], "n": [len(y)], "boost": [part["boost"].max()], "radius": [radius], "cell": [cell], "lo": [y.min(0)], "hi": [y.max(0)]})

    blocks = written(rows.groupBy("block").applyInPandas(summary, "block long, n long, boost double, radius double, cell long, lo array<double>, hi array<double>"), "summaries")
    centre = vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell long, centre array<double>")
    blocks = written(blocks.join(F.broadcast(centre), "cell").drop("cell"), "summaries")  # at most `cells` centres
    return CellIndex(rows, blocks, blocks.count(), block)


#: Questions, and summaries of blocks, that meet in one group.
_AT_ONCE = 1024


def _every(n: int) -> Column:
    """One row for each number below n, as long: both sides of a group are dealt by its hash, and that of an int is another."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _bounds(questions: DataFrame, index: CellIndex, most: int | None, dim: int) -> DataFrame:
    """query_id, block and bound of the blocks that reach each question's ``least``; with ``most``, of so many with the highest bounds."""
    nq, nb = (max(1, -(-c // _AT_ONCE)) for c in (questions.count(), index.n_blocks))
    left = questions.select("query_id", "idx", "value", "least", F.pmod(F.xxhash64("query_id"), F.lit(nq)).alias("a")).withColumn("b", _every(nb))
    right = index.blocks.withColumn("b", F.pmod(F.xxhash64("block"), F.lit(nb))).withColumn("a", _every(nq))

    def compare(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(s):
            return pd.DataFrame({"query_id": [], "block": [], "bound": []})
        x = dense(q["idx"].to_list(), q["value"].to_list(), dim)
        lo, hi, centre = (np.stack(s[c].to_list()) for c in ("lo", "hi", "centre"))
        box = np.maximum(x, 0) @ hi.T + np.minimum(x, 0) @ lo.T
        angle = np.arccos(np.clip(x @ centre.T, -1, 1))
        bound = np.minimum(box, np.cos(np.maximum(0, angle - s["radius"].to_numpy()[None])))
        bound = np.maximum(bound + SLACK, 0) * s["boost"].to_numpy()[None] + SLACK
        fits = bound >= q["least"].to_numpy()[:, None]
        if most is not None and bound.shape[1] > most:
            edge = np.partition(bound, -most, axis=1)[:, -most][:, None]
            fits &= bound >= edge
        i, j = np.nonzero(fits)
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[i], "block": s["block"].to_numpy()[j], "bound": bound[i, j]})

    kind = dict(questions.dtypes)["query_id"]
    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(compare, f"query_id {kind}, block long, bound double")
    if most is None:
        return found
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    return found.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def _visited(visits: DataFrame, questions: DataFrame, index: CellIndex, k: int, dim: int) -> DataFrame:
    """query_id, chunk_id and score: the k best of each question in each block that it visits, among vectors that share a component with it."""
    nq = max(1, -(-questions.count() // _AT_ONCE))
    left = visits.select("query_id", "block").join(questions.select("query_id", "idx", "value"), "query_id").withColumn("a", F.pmod(F.xxhash64("query_id"), F.lit(nq)))
    right = index.vectors.join(visits.select("block").distinct(), "block", "left_semi").withColumn("a", _every(nq))

    kind = dict(questions.dtypes)["query_id"]

    def compare(q: pa.Table, c: pa.Table) -> pa.Table:
        c = c.sort_by("b_chunk_id")
        x, y = (dense(t[f"{side}_idx"].to_pylist(), t[f"{side}_value"].to_pylist(), dim) for t, side in ((q, "a"), (c, "b")))
        score = np.floor(np.floor(np.maximum(x @ y.T, 0) * 1e9 + 0.5) / 1e9 * c["b_boost"].to_numpy()[None, :] * 1e9 + 0.5) / 1e9  # as scores.places()
        shared = ((x != 0).astype(np.float32) @ (y != 0).T.astype(np.float32)) > 0
        if len(c) > k:
            place = np.argsort(np.where(shared, -score, np.inf), axis=1, kind="stable")[:, :k]
            chosen = np.zeros(shared.shape, bool)
            np.put_along_axis(chosen, place, True, axis=1)
            shared &= chosen
        i, j = np.nonzero(shared)
        return pa.Table.from_arrays([q["a_query_id"].take(pa.array(i)), c["b_chunk_id"].take(pa.array(j)), pa.array(score[i, j])], ["query_id", "chunk_id", "score"])

    left = left.select("block", "a", *[F.col(c).alias(f"a_{c}") for c in ("query_id", "idx", "value")])
    right = right.select("block", "a", *[F.col(c).alias(f"b_{c}") for c in ("chunk_id", "idx", "value", "boost")])
    return left.groupBy("block", "a").cogroup(right.groupBy("block", "a")).applyInArrow(compare, f"query_id {kind}, chunk_id string, score double")


def nearest(questions: DataFrame, index: CellIndex, k: int, dim: int = 256) -> DataFrame:
    """query_id, rank, chunk_id and score: the k best chunks of each question (query_id, idx, value) by inner product, negative ones 0,
    times the boost, among those that share a component with it; ties go to the smaller chunk_id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    first_k = lambda rows: rows.withColumn("rank", rank).where(F.col("rank") <= k)
    asked = questions.select("query_id", "idx", "value")
    heads = written(_bounds(asked.withColumn("least", F.lit(-1.0)), index, max(2, -(-2 * k // index.block)), dim), "heads")
    first = written(first_k(_visited(heads, asked, index, k, dim)), "first")
    least = first.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("least"))
    again = asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-1.0)))
    visits = written(_bounds(again, index, None, dim).join(heads.select("query_id", "block"), ["query_id", "block"], "left_anti"), "visits")
    rest = _visited(visits, asked, index, k, dim)
    return first_k(first.drop("rank").unionByName(rest)).select("query_id", "rank", "chunk_id", "score")
