"""The text functions as temporary SQL functions, so that SQL users run no Python for each row."""

from __future__ import annotations

from pyspark.sql import SparkSession

from siftline.functions.text import HAN, LONG_STOP, LOWER, MARK, SHORT_RUN, TOKENS, UPPER


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\") + "'"


def register(spark: SparkSession) -> None:
    """siftline_tokens, siftline_squash, siftline_jaccard and siftline_cosine."""
    low = f"translate(t, '{UPPER}{MARK}', '{LOWER} ')"
    marked = f"regexp_replace(regexp_replace({low}, {_quoted(LONG_STOP)}, ' '), {_quoted(SHORT_RUN)}, '$1{MARK}$1{MARK}')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION siftline_tokens(t STRING) RETURNS ARRAY<STRING> RETURN CASE WHEN t RLIKE {_quoted(HAN)} THEN regexp_extract_all({marked}, {_quoted(TOKENS)}, 1) ELSE regexp_extract_all({low}, '[a-z0-9_]+', 0) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION siftline_squash(s DOUBLE) RETURNS DOUBLE RETURN CASE WHEN s > 0 THEN s / (s + 1) ELSE 0D END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION siftline_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE RETURN CASE WHEN size(a) > 0 AND size(b) > 0 THEN size(array_intersect(a, b)) / size(array_union(a, b)) ELSE 0D END")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION siftline_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN coalesce(greatest(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v), "
        "sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v))), 0D), 0D)"
    )
