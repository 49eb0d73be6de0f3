"""Exact vector comparison of a stated query set with all vectors, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_sides(queries: DataFrame, vectors: DataFrame, query_key: str, vector_key: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the numbers a and b of the blocks that meet, the columns prefixed by a_ and b_ (the keys: a_id and b_id)."""

    def side(df: DataFrame, key: str, count: int, name: str) -> DataFrame:
        # Fresh names: both sides may come from one table.
        rest = [F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key]
        return df.select(F.col(key).alias(f"{name}_id"), *rest, F.pmod(F.xxhash64(key), F.lit(count)).alias(name))

    # Both sides number the blocks as long: rows are dealt by the hash of a number, and that of an int is another.
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    nq, nv = (max(1, -(-df.count() // block)) for df in (queries, vectors))
    left = side(queries, query_key, nq, "a").withColumn("b", every(nv))
    right = side(vectors, vector_key, nv, "b").withColumn("a", every(nq))
    return left, right


def block_pairs(queries: DataFrame, vectors: DataFrame, block: int = 1024) -> DataFrame:
    """query_id, vec_id and cosine (negative ones 0, zero vectors 0) of every query with every vector.

    Both sides are cut into blocks; a pair of blocks meets in one group, so that no task holds a side whole.
    """
    left, right = block_sides(queries, vectors, "vec_id", "vec_id", block)

    def compare(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, y = (np.stack(column.to_list()).astype(np.float64) for column in (q["a_embedding"], v["b_embedding"]))
        norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
        score = np.floor(np.maximum(np.divide(x @ y.T, norm, out=np.zeros_like(norm), where=norm > 0), 0) * 1e9 + 0.5) / 1e9
        return pd.DataFrame({"query_id": np.repeat(q["a_id"].to_numpy(), len(v)), "vec_id": np.tile(v["b_id"].to_numpy(), len(q)), "score": score.ravel()})

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(compare, "query_id long, vec_id long, score double")


def sparse_block_scores(queries: DataFrame, chunks: DataFrame, k: int | None = None, block: int = 1024, dim: int = 256) -> DataFrame:
    """query_id, chunk_id and cosine (negative ones 0) of normalized sparse vectors (idx, value) that share a component.

    Blocks of both sides meet in one group each. With ``k``, a block gives only its k best of each question (ties to the
    smaller chunk_id), so that the rows grow with the questions and not with the pairs. A column boost of chunks multiplies their scores.
    """
    left, right = block_sides(queries, chunks, "query_id", "chunk_id", block)

    def dense(ids: pd.Series, values: pd.Series) -> np.ndarray:
        out = np.zeros((len(ids), dim))
        rows = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        if len(rows):
            out[rows, np.concatenate(ids.to_list())] = np.concatenate(values.to_list())
        return out

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        q, c = q.sort_values("a_id"), c.sort_values("b_id")
        x, y = dense(q["a_idx"], q["a_value"]), dense(c["b_idx"], c["b_value"])
        score = np.floor(np.maximum(x @ y.T, 0) * 1e9 + 0.5) / 1e9  # as scores.places()
        if "b_boost" in c.columns:
            score = np.floor(score * c["b_boost"].to_numpy()[None, :] * 1e9 + 0.5) / 1e9
        shared = ((x != 0).astype(np.float32) @ (y != 0).T.astype(np.float32)) > 0
        if k is not None and len(c) > k:
            place = np.argsort(np.where(shared, -score, np.inf), axis=1, kind="stable")[:, :k]
            chosen = np.zeros(shared.shape, bool)
            np.put_along_axis(chosen, place, True, axis=1)
            shared &= chosen
        i, j = np.nonzero(shared)
        return pd.DataFrame({"query_id": q["a_id"].to_numpy()[i], "chunk_id": c["b_id"].to_numpy()[j], "score": score[i, j]})

    kind = dict(queries.dtypes)["query_id"]
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(compare, f"query_id {kind}, chunk_id string, score double")
