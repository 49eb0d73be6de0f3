"""Operators that call a function of the user's over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def embed_with(rows: DataFrame, key: str, embed_batch: Callable[[list[str]], list[list[float]]], batch_size: int = 32) -> DataFrame:
    """key, embedding and error: a failing batch gives rows with the error, never a failed job."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for i in range(0, len(frame), batch_size):
                part = frame.iloc[i : i + batch_size]
                try:
                    vectors, error = embed_batch([t or "" for t in part["text"]]), None
                    if len(vectors) != len(part):
                        raise ValueError("as many vectors as texts are needed")
                except Exception as problem:
                    vectors, error = [None] * len(part), f"{type(problem).__name__}: {problem}"
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": vectors, "error": error})

    return rows.select(key, "text").mapInPandas(run, f"{key} {kind}, embedding array<double>, error string")


def rerank_with(ranked: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None, own: float = 0.55) -> DataFrame:
    """query_id, chunk_id, rerank, rerank_score, status and error: ranks by 0.55 of the scorer's score for (question, text) and 0.45 of the row's.

    The scorer gets a question's candidates together, which are few. If it fails for a question, that question keeps the order of
    its own scores, with the status fallback and the error; no scorer keeps all orders (disabled). Scores that are null or not finite are failures.
    """
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "chunk_id"))
    if scorer is None:
        rows = ranked.select("query_id", "chunk_id", F.col("score").alias("rerank_score"), F.lit("disabled").alias("status"), F.lit(None).cast("string").alias("error"))
        return rows.select("query_id", "chunk_id", order.alias("rerank"), "rerank_score", "status", "error")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        status, error, score = "success", None, rows["score"].astype("float64")
        try:
            external = pd.Series(scorer(rows["question"], rows["text"])).astype("float64").to_numpy()
            if len(external) != len(rows) or not np.isfinite(external).all():
                raise ValueError("a score for each candidate is needed")
            score = (own * external + (1 - own) * score).round(9)
        except Exception as problem:
            status, error = "fallback", f"{type(problem).__name__}: {problem}"
        return pd.DataFrame({"query_id": rows["query_id"], "chunk_id": rows["chunk_id"], "rerank_score": score, "status": status, "error": error})

    kinds = dict(ranked.dtypes)
    rows = ranked.select("query_id", "chunk_id", "score", "question", "text").groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, rerank_score double, status string, error string")
    return rows.select("query_id", "chunk_id", order.alias("rerank"), "rerank_score", "status", "error")


def mmr_select(candidates: DataFrame, weight: float = 0.78, limit: int = 10) -> DataFrame:
    """Greedy choice by weight * score - (1 - weight) * largest Jaccard similarity to those chosen.

    ``candidates``: query_id, chunk_id, score, tokens; a bounded list for each question.
    """

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["score", "chunk_id"], ascending=[False, True]).to_dict("records")
        sets, left, chosen = [set(r["tokens"]) for r in rows], list(range(len(rows))), []
        while left and len(chosen) < limit:
            def value(i: int) -> float:
                near = max((len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] and sets[j] else 0.0 for j in chosen), default=0.0)
                return weight * rows[i]["score"] - (1 - weight) * near

            best = max(left, key=lambda i: (value(i), -i))
            chosen.append(best)
            left.remove(best)
        return pd.DataFrame([(rows[i]["query_id"], n + 1, rows[i]["chunk_id"]) for n, i in enumerate(chosen)], columns=["query_id", "rank", "chunk_id"])

    return candidates.groupBy("query_id").applyInPandas(choose, "query_id long, rank int, chunk_id string")


def generate_with(rows: DataFrame, generate: Callable[[str, str], str]) -> DataFrame:
    """query_id, answer and fallback: where the generator fails, the row's template stays, with the reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            answers, reasons = [], []
            for question, template in zip(frame["question"], frame["template"], strict=True):
                try:
                    answer, reason = generate(question or "", template or ""), None
                except Exception as problem:
                    answer, reason = template, f"{type(problem).__name__}: {problem}"
                answers.append(answer)
                reasons.append(reason)
            yield pd.DataFrame({"query_id": frame["query_id"], "answer": answers, "fallback": reasons})

    return rows.select("query_id", "question", "template").mapInPandas(run, "query_id long, answer string, fallback string")


def enrich_with(misses: DataFrame, enrich: Callable[[dict], str], limits: dict[str, int]) -> DataFrame:
    """key, payload (JSON) and error of requests that a cache lacks; the fields handed on are cut to their limits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            payloads, errors = [], []
            for row in frame[list(limits)].to_dict("records"):
                try:
                    payload, error = enrich({k: str(row[k] or "")[:n] for k, n in limits.items()}), None
                except Exception as problem:
                    payload, error = None, f"{type(problem).__name__}: {problem}"
                payloads.append(payload)
                errors.append(error)
            yield pd.DataFrame({"key": frame["key"], "payload": payloads, "error": errors})

    return misses.select("key", *limits).mapInPandas(run, "key string, payload string, error string")
