"""Queries over entities, markers, hooks and evaluation by profile."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.operators import entities, hooks
from siftline.operators.entities import ENTITY_STOPWORDS
from siftline.plans.ranking_queries import BASE, KEYWORD, chunks, keyword
from siftline.plans.registry import query
from siftline.plans.sql import tok
from siftline.sources.scratch import written
from siftline.sources.tables import questions, table

S = SparkSession
_STOP = "[" + ", ".join(f"'{w}'" for w in ENTITY_STOPWORDS) + "]"
_ENTITY = rf"""e AS (SELECT doc_id, regexp_replace(e, '[.\-_]+$', '') AS entity, i FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.-]{{1,63}}')) AS e, generate_subscripts(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.-]{{1,63}}'), 1) AS i FROM documents)),
named AS (SELECT doc_id, entity, min(i) AS i FROM e WHERE regexp_matches(entity, '^[A-Z]|[0-9_.\-]') AND length(entity) >= 2 AND NOT list_contains({_STOP}, lower(entity)) GROUP BY 1, 2)"""


@query("TOP-04", f"WITH {_ENTITY} SELECT doc_id, n - 1 AS place, entity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM named) WHERE n <= 32")
def top04(spark: S, sf: str) -> DataFrame:
    return entities.top_entities(table(spark, sf, "documents"))


_MARKED = "replace(text, '. ', '. [' || doc_id || '] [' || (doc_id + 1) || ', ' || (doc_id + 2) || '] ')"


@query("TXT-23", rf"""SELECT doc_id, list_transform(flatten(list_transform(regexp_extract_all({_MARKED}, '\[([0-9]+(?:\s*,\s*[0-9]+)*)\]', 1), lambda g: regexp_split_to_array(g, '\s*,\s*'))), lambda x: x::INT) AS markers FROM documents""")
def txt23(spark: S, sf: str) -> DataFrame:
    """Markers put after the sentences of the documents."""
    return table(spark, sf, "documents").withColumn("text", F.expr(_MARKED)).select("doc_id", entities.citation_markers(F.col("text")).alias("markers"))


def hash_batch(texts: list[str]) -> list[list[float]]:
    """A small deterministic embedding, the default of embed_with."""
    return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:8]] for t in texts]


@query("UDF-01", "SELECT doc_id, list_transform(range(0, 8), lambda i: ('0x' || substr(sha256(coalesce(text, '')), (2 * i + 1)::BIGINT, 2))::INT / 255.0::DOUBLE) AS embedding, NULL AS error FROM documents")
def udf01(spark: S, sf: str) -> DataFrame:
    return hooks.embed_with(table(spark, sf, "documents"), "doc_id", hash_batch)


def overlap(asked: pd.Series, texts: pd.Series) -> pd.Series:
    """Share of the question's words that the text holds, a small default of rerank_with."""
    return pd.Series([len(set(q.split()) & set((t or "").lower().split())) / max(len(set(q.split())), 1) for q, t in zip(asked, texts, strict=True)])


_SHARED = r"len(list_intersect(list_distinct(list_filter(regexp_split_to_array(question, '\s+'), lambda x: x <> '')), list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')))) / greatest(len(list_distinct(list_filter(regexp_split_to_array(question, '\s+'), lambda x: x <> ''))), 1)"


def moody(asked: pd.Series, texts: pd.Series) -> pd.Series:
    """overlap() that fails for some questions."""
    if len(asked.iloc[0]) % 5 == 0:
        raise RuntimeError("the model is away")
    return overlap(asked, texts)


@query("RET-06", f"""WITH {BASE}, {KEYWORD}, c AS (SELECT query_id, chunk_id, score, question, text, length(question) % 5 = 0 AS away FROM ranked JOIN chunks USING (chunk_id) JOIN questions USING (query_id) WHERE rank <= 20),
s AS (SELECT query_id, chunk_id, false AS off, CASE WHEN away THEN score ELSE round(0.55 * {_SHARED} + 0.45 * score, 9) END AS rerank_score, CASE WHEN away THEN 'fallback' ELSE 'success' END AS status, CASE WHEN away THEN 'RuntimeError: the model is away' END AS error FROM c
UNION ALL SELECT query_id, chunk_id, true, score, 'disabled', NULL FROM c) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id, off ORDER BY rerank_score DESC, chunk_id) AS rerank, rerank_score, status, error FROM s""")
def ret06(spark: S, sf: str) -> DataFrame:
    """A scorer that fails for some questions, and no scorer."""
    rows = written(keyword(spark, sf, 20).join(chunks(spark, sf), "chunk_id").join(questions(spark, sf), "query_id"), "candidates")
    return hooks.rerank_with(rows, moody).unionByName(hooks.rerank_with(rows, None))


def mmr_sql(limit: int, weight: float = 0.78) -> str:
    """Greedy choice among cand(query_id, chunk_id, score, w: distinct tokens), as mmr(query_id, k, chosen)."""
    return f"""sim AS (SELECT a.query_id, a.chunk_id, map_from_entries(list((b.chunk_id, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END))) AS near FROM cand a JOIN cand b USING (query_id) GROUP BY 1, 2),
placed AS (SELECT query_id, chunk_id, score, near, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM cand JOIN sim USING (query_id, chunk_id)),
mmr AS (SELECT query_id, 1 AS k, [chunk_id] AS chosen FROM placed WHERE place = 1 UNION ALL
SELECT query_id, k + 1, list_append(chosen, arg_max(chunk_id, (value, -place))) FROM (SELECT m.query_id, m.k, m.chosen, p.chunk_id, p.place, {weight}::DOUBLE * p.score - (1 - {weight}::DOUBLE) * list_max(list_transform(m.chosen, lambda x: p.near[x])) AS value
FROM mmr m JOIN placed p ON p.query_id = m.query_id AND NOT list_contains(m.chosen, p.chunk_id) WHERE m.k < {limit}) GROUP BY query_id, k, chosen),
picked AS (SELECT query_id, generate_subscripts(chosen, 1) AS rank, unnest(chosen) AS chunk_id FROM (SELECT query_id, arg_max(chosen, k) AS chosen FROM mmr GROUP BY 1))"""


@query("RET-04", f"WITH RECURSIVE {BASE}, {KEYWORD}, cand AS (SELECT query_id, chunk_id, score, list_distinct({tok('text')}) AS w FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 24), {mmr_sql(10)} SELECT * FROM picked")
def ret04(spark: S, sf: str) -> DataFrame:
    rows = keyword(spark, sf, 24).join(chunks(spark, sf), "chunk_id")
    return hooks.mmr_select(rows.select("query_id", "chunk_id", "score", F.array_distinct(tx.tokenize(F.col("text"))).alias("tokens")))


@query("GRF-01", f"WITH {_ENTITY}, told AS (SELECT doc_id, text, unnest(['Apache', lang, source, string_split(text, ' ')[1]]) AS entity FROM documents) SELECT doc_id, entity FROM named UNION SELECT doc_id, trim(entity) FROM told WHERE trim(entity) <> '' AND contains(text, trim(entity))")
def grf01(spark: S, sf: str) -> DataFrame:
    """Enrichment suggests a fixed name, the language, the source and the first word."""
    told = F.array(F.lit("Apache"), "lang", "source", F.get(F.split("text", " "), F.lit(0)))
    return entities.extract_entities(table(spark, sf, "documents").withColumn("enriched", told))
