"""Exact keyword search that reads only what can reach the first k: an inverted index by token and block of chunks.

A block holds chunks of like length and boost, about ``block`` of them. The index knows the largest part that a
token adds to a score in each block, so that a question's score in a block has a bound. A first pass scores
the blocks with the highest bounds and gives each question a threshold. A second reads the
blocks whose bound reaches it, and there only the postings of tokens that a chunk must have to reach it (those
left over when the smallest bounds together stay below); chunks whose bound still reaches it are scored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import scores as sc
from siftline.sources.scratch import written

#: Slack of the bounds for rounding.
SLACK = 1e-8
#: Blocks that the first pass scores for each question, and one more for each four results.
HEADS = 8
#: Question tokens up to which they are broadcast (about 40 bytes each).
BROADCAST_TERMS = 200_000


def small(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


@dataclass
class InvertedIndex:
    #: token, block, chunk_id and part (what one occurrence of the token in a question adds, without its idf).
    postings: DataFrame
    #: token, block, top (the largest part) and n, the postings.
    tops: DataFrame
    #: block and boost (the largest of its chunks).
    blocks: DataFrame
    #: token and idf.
    weights: DataFrame
    #: chunk_id and boost, or None.
    boosts: DataFrame | None


def build_index(post: DataFrame, boosts: DataFrame | None = None, k1: float = 1.5, b: float = 0.75, block: int = 32) -> InvertedIndex:
    """An index of postings (chunk_id, len, token, tf) with one row without a token for each chunk, as question_postings() gives them."""
    chunks = post.where("token IS NULL").select("chunk_id", "len")
    chunks = chunks.join(boosts, "chunk_id", "left").na.fill(1.0, ["boost"]) if boosts is not None else chunks.withColumn("boost", F.lit(1.0))
    # Classes of length and boost: at most four for each power of two of the length, sixteen for each unit of the boost, so that their table is small.
    kind = F.floor(F.log2(F.col("len") + 1) * 4).cast("long") * 1024 + F.least(F.floor(F.col("boost") * 16), F.lit(1023))
    chunks = chunks.withColumn("kind", kind)
    classes = F.broadcast(chunks.groupBy("kind").agg(F.ceil(F.count("*") / block).alias("slices")))
    placed = chunks.join(classes, "kind").select("chunk_id", "boost", (F.col("kind") * 2**32 + F.pmod(F.xxhash64("chunk_id"), F.col("slices"))).alias("block"))
    stats = F.broadcast(chunks.agg(F.count("*").alias("n"), F.greatest(F.avg("len"), F.lit(1.0)).alias("avg_len")))  # one row
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    postings = written(post.where("token IS NOT NULL").join(placed, "chunk_id").crossJoin(stats).select("token", "block", "chunk_id", part.alias("part")), "index")
    tops = written(postings.groupBy("token", "block").agg(F.max("part").alias("top"), F.count("*").alias("n")), "tops")
    df = tops.groupBy("token").agg(F.sum("n").alias("df")).crossJoin(stats.select("n"))  # one row
    weights = df.select("token", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return InvertedIndex(postings, tops, placed.groupBy("block").agg(F.max("boost").alias("boost")), weights, boosts)


def _scored(parts: DataFrame, index: InvertedIndex) -> DataFrame:
    """query_id, chunk_id and score of parts (query_id, chunk_id, part)."""
    found = parts.groupBy("query_id", "chunk_id").agg(sc.places(F.sum("part")).alias("score")).withColumn("score", sc.places(sc.squash(F.col("score"))))
    if index.boosts is None:
        return found
    return found.join(index.boosts, "chunk_id", "left").withColumn("score", sc.places(F.col("score") * F.coalesce("boost", F.lit(1.0)))).drop("boost")


def _first(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def top_chunks(terms: DataFrame, index: InvertedIndex, k: int) -> DataFrame:
    """query_id, rank, chunk_id and score: the k best chunks of each question's terms (query_id, token, qf), exactly."""
    asked = written(terms.join(index.weights, "token").select("query_id", "token", (F.col("qf") * F.col("idf")).alias("w")), "asked")
    wide = small(asked)
    reach = index.tops.join(wide, "token").select("query_id", "block", "token", "w", (F.col("w") * F.col("top")).alias("most"))
    bound = F.round(sc.squash(F.col("raw")) * F.col("boost") + SLACK, 9)
    bounds = reach.groupBy("query_id", "block").agg(F.sum("most").alias("raw")).join(index.blocks, "block")
    bounds = written(bounds.select("query_id", "block", "boost", bound.alias("bound")), "bounds")

    n_heads = HEADS + k // 4
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    heads = written(bounds.withColumn("nth", nth).where(F.col("nth") <= n_heads).select("query_id", "block"), "heads")
    pairs = index.postings.join(heads.join(wide, "query_id").select("query_id", "block", "token", "w"), ["token", "block"])
    first = written(_first(_scored(pairs.select("query_id", "chunk_id", (F.col("w") * F.col("part")).alias("part")), index), k), "first")

    # A score below the k-th of the first pass cannot count; a question with fewer rows needs all.
    least = first.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("least"))
    open_ = bounds.join(heads, ["query_id", "block"], "left_anti").join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).where(F.col("bound") >= F.col("least"))
    share = F.least((F.col("least") - SLACK) / F.col("boost"), F.lit(1 - 1e-12))
    needed = F.greatest(share / (1 - share), F.lit(0.0)) * (1 - 1e-9) - SLACK
    open_ = open_.select("query_id", "block", needed.alias("needed"))
    order = Window.partitionBy("query_id", "block").orderBy("most", "token").rowsBetween(Window.unboundedPreceding, 0)
    tokens = reach.join(open_, ["query_id", "block"]).withColumn("so_far", F.sum("most").over(order)).withColumn("must", F.col("so_far") >= F.col("needed"))
    rest = F.sum(F.when(~F.col("must"), F.col("most")).otherwise(0.0)).over(Window.partitionBy("query_id", "block"))
    must = tokens.withColumn("rest", rest).where("must").select("query_id", "block", "token", "w", "rest", "needed")
    met = index.postings.join(must, ["token", "block"]).groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("part")).alias("own"), F.max("rest").alias("rest"), F.max("needed").alias("needed"))
    chosen = written(met.where(F.col("own") + F.col("rest") >= F.col("needed")).select("query_id", "chunk_id"), "chosen")
    parts = chosen.join(index.postings, "chunk_id").join(wide, ["query_id", "token"])
    more = _scored(parts.select("query_id", "chunk_id", (F.col("w") * F.col("part")).alias("part")), index)
    return _first(first.drop("rank").unionByName(more), k).select("query_id", "rank", "chunk_id", "score")


def exact_scores(pairs: DataFrame, terms: DataFrame, index: InvertedIndex) -> DataFrame:
    """query_id, chunk_id and score of given pairs (query_id, chunk_id) that share a token."""
    asked = terms.join(index.weights, "token").select("query_id", "token", (F.col("qf") * F.col("idf")).alias("w"))
    parts = pairs.join(index.postings, "chunk_id").join(asked, ["query_id", "token"])
    return _scored(parts.select("query_id", "chunk_id", (F.col("w") * F.col("part")).alias("part")), index)
