"""Loaders of the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores, if its files are too small to give each of them a split (a row group is never cut); else as it is."""
    spark = df.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split else df


def parts_for(df: DataFrame, each: int = 8 << 20) -> int:
    """Parts for rows that grow with the files of df: one for each 8 MB, so that the memory of a task stays the same; at least as many as the session's shuffles have."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def scan_documents(spark: SparkSession, sf_dir: str, knowledge_bases: list[str] | None = None) -> DataFrame:
    """The documents schema, with the language as knowledge base and the source as file name."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("lang").alias("knowledge_base_id"), F.col("source").alias("file_name"), "text")
    return docs.where(F.col("knowledge_base_id").isin(knowledge_bases)) if knowledge_bases else docs


def url_list_candidates(urls: DataFrame, max_items: int) -> DataFrame:
    """Trimmed, non-blank, distinct URLs by their first place; those over the cap are failures."""
    from pyspark.sql import Window

    first = urls.select("page_id", F.trim("url").alias("url")).where("url <> ''").groupBy("url").agg(F.min("page_id").alias("first_seen"))
    n = F.row_number().over(Window.orderBy("first_seen", "url"))
    # Only the first max_items + 1 places can decide, and a limit finds them without one task seeing all.
    head = first.orderBy("first_seen", "url").limit(max_items).withColumn("position", n)
    rest = first.join(head.select("url"), "url", "left_anti").select("url", "first_seen", F.lit(None).cast("int").alias("position"))
    return head.unionByName(rest).select("url", "first_seen", "position", F.col("position").isNull().alias("over_cap"))


def blob_inventory(blobs: DataFrame, references: DataFrame) -> DataFrame:
    """One row for each content of blobs (doc_id, text): key, size, blobs and references (doc_id) to them."""
    keyed = blobs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    named = references.select("doc_id").join(keyed, "doc_id").groupBy("sha256").agg(F.count("*").alias("n"))
    rows = keyed.groupBy("sha256").agg(F.count("*").alias("n_blobs"), F.max("size").alias("size_bytes")).join(named, "sha256", "left")
    key = F.concat(F.substring("sha256", 1, 2), F.lit("/"), F.col("sha256"))
    return rows.select("sha256", key.alias("object_key"), "size_bytes", "n_blobs", F.coalesce("n", F.lit(0)).alias("n_references"), F.col("n").isNull().alias("unreferenced"))


def questions(spark: SparkSession, sf_dir: str, words: int = 12) -> DataFrame:
    """query_id and question: the first tokens of each benchmark passage."""
    passages = table(spark, sf_dir, "benchmark")
    return passages.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(tx.tokenize(F.col("text")), 1, words), " ").alias("question"))


def chunk_table(spark: SparkSession, sf_dir: str, size: int = 520, overlap: int = 90) -> DataFrame:
    """chunk_id, document_id, chunk_index and text of fixed windows over every document."""
    from siftline.operators.corpus import hard_split

    return hard_split(dealt(scan_documents(spark, sf_dir)), size, overlap)
