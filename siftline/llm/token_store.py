"""Token ids in Parquet files with list columns, for selective reads of tokens and metadata.

A row holds one document: its id, its place in its file, the number of its ids and the ids as a
list column. Ids, their numbers and the files' are dictionary-encoded (a vocabulary of up to 64 k fits the
dictionary page), doc_id and row delta-encoded by the version 2 writer; row groups and pages have fixed sizes, and the
column and page indexes of the files let a reader fetch the pages of a document range or only the
metadata columns. Files hold contiguous ranges of doc_id, in ascending order of their numbers.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.bpe import PieceMemory, small_slices
from siftline.llm.common import fresh_path

STORED = "doc_id long, file int, row long, n_tokens long, ids array<int>"
#: Sizes in bytes: row group, page, dictionary page.
LAYOUT = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "v2",
    "compression": "zstd",
}


class LibraryBPE(PieceMemory):
    """The tokenizers library, which sees each distinct piece once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        super().__init__()

    def learn(self, pieces: list[bytes], together: int = 512) -> tuple[np.ndarray, np.ndarray]:
        words = [p.decode() for p in pieces]
        lines = [words[i : i + together] for i in range(0, len(words), together)]
        found = self.library.encode_batch([" ".join(x) for x in lines], add_special_tokens=False)
        ids, counts = [], []
        for line, one in zip(lines, found, strict=True):
            ids.append(np.array(one.ids, np.int32))
            begins = np.cumsum([0, *(len(w) + 1 for w in line)])
            at = np.array([a for a, _ in one.offsets], np.int64)
            counts.append(np.bincount(np.searchsorted(begins, at, "right") - 1, minlength=len(line))[: len(line)])
        return np.concatenate(ids), np.cumsum(np.concatenate(counts))


_LOADED: dict[str, LibraryBPE] = {}


def _loaded(path: str) -> LibraryBPE:
    if path not in _LOADED:
        _LOADED[path] = LibraryBPE(path)
    return _LOADED[path]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int, files: int | None = None) -> None:
    """Encode the whole text of all documents, append end_id to each, and write them in ascending doc_id order.

    Null and empty texts give just the end id. Repeated rows are all written; rows that share a
    doc_id stand side by side, ordered by the hash of their text, and may spread over several files.
    A null doc_id sorts first. An empty table gives a folder without rows. Further columns of docs are not stored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = files or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, row = _loaded(tokenizer), 0
        for batch in batches:
            for part, texts in small_slices(batch, 1):
                flat, starts = bpe.encode(texts)
                own = np.insert(flat, starts[1:], end_id)
                starts = starts + np.arange(len(starts))
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(own.astype(np.int32)))
                counts = np.diff(starts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(row + np.arange(len(counts))), pa.array(counts), lists],
                    ["doc_id", "file", "row", "n_tokens", "ids"],
                )
                row += len(counts)

    (
        rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
        .withColumn("file", F.spark_partition_id())
        .mapInArrow(encode, STORED)
        .write.options(**LAYOUT)
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Rows of a token store: only the named columns' pages are read, and only row groups and pages that
    can satisfy ``where`` (a condition on doc_id, file, row or n_tokens)."""
    stored = spark.read.schema(STORED).parquet(path)
    stored = stored if where is None else stored.where(where)
    return stored.select(*columns) if columns else stored


def token_starts(stored: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Add start: the ids of all documents before each one. Files' totals give the offsets of the later files;
    ``counts``: the columns file and n_tokens of the store, where ``stored`` is dearer to compute."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (stored if counts is None else counts).groupBy("file").agg(F.sum("n_tokens").alias("__n")).select("file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        stored.join(offsets, "file")
        .withColumn("start", (F.col("__offset") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).cast("long"))
        .drop("__offset")
    )


def ids_checksums(stored: DataFrame) -> DataFrame:
    """doc_id, file, row, n_tokens (as read from the list) and the CRC-32 of the ids as little-endian 32-bit integers."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends = np.asarray(lists.offsets)
            raw = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "file", "row", "n_tokens", "ids_crc32"])

    return stored.select("doc_id", "file", "row", "ids").mapInArrow(checked, "doc_id long, file int, row long, n_tokens long, ids_crc32 long")


def store_report(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the store, read its files back, and report doc_id, start, n_tokens and ids_crc32 of each document."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    write_tokens(docs, tokenizer, path, end_id)
    counts = read_tokens(spark, path, ["file", "n_tokens"])
    return token_starts(ids_checksums(read_tokens(spark, path)), counts).select("doc_id", "start", "n_tokens", "ids_crc32")
