"""Operators that prepare documents: splitting, statistics, hash embeddings, quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.functions.words import splitter
from siftline.sources.scratch import written


def hard_split(docs: DataFrame, size: int = 520, overlap: int = 90) -> DataFrame:
    """Fixed windows over each text; an empty text has none."""
    starts = F.posexplode(tx.window_starts(F.length("text"), size, overlap)).alias("chunk_index", "start")
    rows = docs.where(F.length("text") > 0).select("document_id", "text", starts)
    return rows.select(F.concat_ws(":", "document_id", "chunk_index").alias("chunk_id"), "document_id", "chunk_index", F.col("text").substr(F.col("start") + 1, F.lit(size)).alias("text"))


def postings(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, token and its frequency."""
    return chunks.select(key, F.explode(tx.tokenize(F.col("text"))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("token").agg(F.count("*").alias("df"))


def word_rows(chunks: DataFrame) -> DataFrame:
    """chunk_id, len, and token and tf of its distinct words, and one row without a token for each chunk; a null text has only that, without a len.

    A chunk is one row (chunk_id is a key), so its words are counted where it is read, and no row of a word is shuffled.
    """
    counted = chunks.select("chunk_id", tx.token_counts(F.col("text")).alias("c"))
    none = F.struct(F.lit(None).cast("string").alias("token"), F.lit(1).cast("long").alias("tf"))
    rows = counted.select("chunk_id", F.col("c.len").alias("len"), F.explode(F.array_append(F.coalesce("c.words", F.array().cast("array<struct<token: string, tf: bigint>>")), none)).alias("w"))
    return rows.select("chunk_id", "len", "w.token", "w.tf")


def batch_counts(chunks: DataFrame) -> DataFrame:
    """token, df, occurrences and total of batches of chunks (one row each): how many hold the token, how often it stands in them, and 0.

    A row without a token has the number of the batch's chunks and, as total, that of their words; a null text counts as a chunk only.
    """
    split = splitter(tx.STOPWORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = split(batch.column(0))
            coded = lists.flatten().dictionary_encode()
            k, code = len(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            pairs = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(k, 1) + code)
            df, occurrences = np.bincount(pairs % max(k, 1), minlength=k), np.bincount(code, minlength=k)
            token = pa.concat_arrays([coded.dictionary, pa.nulls(1, pa.string())])
            columns = [token, *(pa.array(np.append(x, last), pa.int64()) for x, last in ((df, len(sizes)), (occurrences, 0), (np.zeros(k, np.int64), len(code))))]
            yield pa.RecordBatch.from_arrays(columns, ["token", "df", "occurrences", "total"])

    return chunks.select("text").mapInArrow(run, "token string, df long, occurrences long, total long")


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """token, df and occurrences, with the number of chunks and their mean length in tokens, empty ones included.

    One row without a token for each batch of chunks goes along, so that the texts are read and tokenized once.
    """
    counts = written(batch_counts(chunks).groupBy("token").agg(*[F.sum(c).alias(c) for c in ("df", "occurrences", "total")]), "counts")
    stats = counts.where("token IS NULL").select(F.col("df").alias("n"), (F.col("total") / F.col("df")).alias("avg_len"))
    return counts.where("token IS NOT NULL").select("token", "df", "occurrences").crossJoin(F.broadcast(stats))  # one row


def hash_embed(chunks: DataFrame, key: str, dim: int = 256) -> DataFrame:
    """Signed feature hashing, normalized: key, idx and value of the non-zero components."""
    digest = F.sha2("token", 256)
    index = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(dim))
    sign = F.when(F.pmod(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int"), F.lit(2)) == 0, 1).otherwise(-1)
    # Tokens are counted first, so that each distinct one is hashed once a chunk.
    parts = postings(chunks, key).select(key, index.alias("idx"), (sign * F.col("tf")).alias("v")).groupBy(key, "idx").agg(F.sum("v").alias("v")).where("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return parts.select(key, "idx", (F.col("v") / norm).alias("value"))


def keywords(docs: DataFrame, key: str, n: int = 16) -> DataFrame:
    post = postings(docs, key).where(F.length("token") >= 2)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("tf"), "token"))
    return post.withColumn("rank", rank).where(F.col("rank") <= n).select(key, "rank", "token", "tf")


def duplicate_chunk_ratio(chunks: DataFrame) -> DataFrame:
    flat = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    return chunks.groupBy("document_id").agg((1 - F.count_distinct(flat) / F.count("*")).alias("duplicate_ratio"))


def document_quality(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Points from 100 down, with a fixed deduction for each sign of a bad document, its signs and up to four suggestions.

    ``docs``: document_id, text, pages, ocr (its status) and indexed; null is unknown and costs nothing.
    """
    parts = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.avg(F.length("text")).alias("mean_length"))
    rows = docs.join(parts, "document_id", "left").join(duplicate_chunk_ratio(chunks), "document_id", "left")
    text = F.trim(F.coalesce("text", F.lit("")))
    n, mean = F.coalesce("n_chunks", F.lit(0)), F.coalesce("mean_length", F.lit(0.0))
    signs = [  # sign, points, condition, suggestion; of one name the first that holds counts
        ("no_text", 45, text == "", "import the text again"), ("short_text", 10, (text != "") & (F.length(text) < 200), "add more material"),
        ("no_chunk", 35, n == 0, "split the document"), ("short_chunks", 8, (n > 0) & (mean < 120), "join small chunks"), ("long_chunks", 8, (n > 0) & (mean > 900), "split long chunks"),
        ("no_page", 8, F.col("pages") == 0, "keep page numbers"), ("strange_characters", 14, tx.weird_ratio(F.col("text")) > 0.08, "check the encoding"),
        ("repetitions", 10, F.col("duplicate_ratio") > 0.25, "remove repeated parts"), ("ocr", 12, F.col("ocr") != "ok", "repeat the recognition"), ("not_indexed", 22, ~F.col("indexed"), "index the document"),
    ]
    holds = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(name).alias("sign"), F.lit(p).alias("points"), F.lit(advice).alias("advice"))) for name, p, c, advice in signs]))
    rows = rows.select("document_id", n.alias("n_chunks"), holds.alias("signs"))
    score = F.greatest(F.lit(0), 100 - F.aggregate("signs", F.lit(0), lambda total, x: total + x["points"]))
    level = F.when(score >= 85, "excellent").when(score >= 70, "good").when(score >= 50, "fair").otherwise("poor")
    return rows.select("document_id", "n_chunks", score.alias("score"), level.alias("level"), F.transform("signs", lambda x: x["sign"]).alias("signals"), F.slice(F.transform("signs", lambda x: x["advice"]), 1, 4).alias("suggestions"))
