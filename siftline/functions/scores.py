"""Score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squash(score: Column) -> Column:
    return F.when(score > 0, score / (score + 1)).otherwise(0.0)


def places(x: Column) -> Column:
    """Nine decimals of the double times 10**9, halves away from zero, as the SQL rounds. F.round() goes by the shortest decimal of the
    double, and so parts from it where a product lies on a half, which moves ranks of close rows."""
    return F.signum(x) * F.floor(F.abs(x) * 1e9 + 0.5) / 1e9


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Negative values count as 0, and so does a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(dot(a, b) / norm, F.lit(0.0))).otherwise(0.0)


def resolve_weights(mode: Column, keyword: Column, vector: Column) -> Column:
    total = keyword + vector
    even = F.struct(F.lit(0.62).alias("bm25"), F.lit(0.38).alias("vector"))
    share = F.struct(F.bround(F.try_divide(keyword, total), 4).alias("bm25"), F.bround(F.try_divide(vector, total), 4).alias("vector"))
    pair = lambda a, b: F.struct(F.lit(a).alias("bm25"), F.lit(b).alias("vector"))
    return F.when(mode == "keyword", pair(1.0, 0.0)).when(mode == "semantic", pair(0.0, 1.0)).when(total <= 0, even).otherwise(share)


def mmr_lambda(profile: Column, given: Column) -> Column:
    return F.coalesce(given, F.when(profile == "precision", 0.9).when(profile == "recall", 0.62).otherwise(0.78))


def candidate_k(profile: Column, top_k: Column, given: Column, n: Column) -> Column:
    wanted = F.when(given.isNotNull(), F.greatest(top_k, F.least(given, n))).when(profile == "precision", top_k * 2).when(profile == "recall", F.greatest(top_k * 6, F.lit(24))).otherwise(24)
    return F.when(n == 0, 0).otherwise(F.greatest(top_k, F.least(wanted, n)))


def document_boost(quality: Column, priority: Column) -> Column:
    q = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(quality, F.lit(80.0))))
    p = F.coalesce(F.when(priority != 0, priority), F.lit(1.0))
    return F.bround((0.94 + q / 1000) * F.greatest(F.lit(0.7), F.least(F.lit(1.3), p)), 4)


def trust_label(confidence: Column, evidence: Column, coverage: Column, grounding: Column) -> Column:
    def reaches(c: float, e: int, v: float, g: float) -> Column:
        return (confidence >= c) & (evidence >= e) & (coverage >= v) & (grounding >= g)

    return F.when(evidence == 0, "unknown").when(reaches(0.35, 3, 0.65, 0.65), "strong").when(reaches(0.16, 2, 0.45, 0.45), "medium").otherwise("weak")


def lifecycle_event(stage: Column, start: Column, stop: Column, error: Column, retries: Column) -> Column:
    """stage, duration in ms (two decimals, 0 at least and if there is no end), error and retries of one step."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    duration = F.floor((F.greatest(F.lit(0), F.coalesce(micros(stop) - micros(start), F.lit(0))) + 5) / 10) / 100.0
    return F.struct(stage.alias("stage"), duration.alias("duration_ms"), error.alias("error"), retries.alias("retries"))
