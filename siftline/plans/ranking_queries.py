"""Queries over retrieval: keyword, vector and hybrid ranking, fusion, reranking, decisions, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import scores as sc
from siftline.functions import text as tx
from siftline.operators import corpus, ranking
from siftline.plans.registry import query
from siftline.plans.sql import BM25, COSINE, QUESTIONS, WHOLE, tok
from siftline.sources.scratch import written
from siftline.sources.tables import dealt, questions, table

S = SparkSession
BASE = f"{QUESTIONS}, {WHOLE}, {BM25}"
BOTH = f"{BASE}, {COSINE}"
SQUASH = "score / (score + 1)"
TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)"
BOOSTS = """boosts AS (SELECT d.doc_id::VARCHAR || ':0' AS chunk_id, round_even((0.94 + CASE quality WHEN 1 THEN 90.0 WHEN 0 THEN 60.0 ELSE 80.0 END / 1000) * CASE WHEN d.doc_id % 5 = 0 THEN 1.0 ELSE greatest(0.7, least(1.3, (d.doc_id % 5) / 2.0)) END, 4) AS boost FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
KEYWORD = f"{BOOSTS}, ranked AS (SELECT *, {TOP} AS rank FROM (SELECT query_id, chunk_id, round(round({SQUASH}, 9) * boost, 9) AS score, matched FROM bm25 JOIN boosts USING (chunk_id)))"
SEMANTIC = "semantic AS (SELECT query_id, chunk_id, round(score * boost, 9) AS score FROM cos JOIN boosts USING (chunk_id))"
HYBRID = """hybrid AS (SELECT query_id, chunk_id, keyword, vector, round(score * boost, 9) AS score FROM (SELECT query_id, chunk_id, coalesce(b.score / (b.score + 1), 0) AS keyword, coalesce(c.score, 0) AS vector,
round(0.62 * coalesce(b.score / (b.score + 1), 0) + 0.38 * coalesce(c.score, 0), 9) AS score FROM bm25 b FULL JOIN cos c USING (query_id, chunk_id)) JOIN boosts USING (chunk_id))"""


def boosts(spark: S, sf: str) -> DataFrame:
    """chunk_id and boost: quality from the labels, priority from the ids."""
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    quality = F.when(F.col("quality") == 1, 90.0).when(F.col("quality") == 0, 60.0)
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("chunk_id"), sc.document_boost(quality, (F.col("doc_id") % 5) / F.lit(2.0)).alias("boost"))


def chunks(spark: S, sf: str) -> DataFrame:
    """Every document as one chunk."""
    docs = dealt(table(spark, sf, "documents"))
    return docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), "text", F.col("source").alias("file_name"), "lang", F.array(F.regexp_extract("text", r"^[^\n]{0,40}", 0)).alias("heading_path"))


def keyword(spark: S, sf: str, k: int = 5) -> DataFrame:
    return ranking.keyword_search(questions(spark, sf), chunks(spark, sf), k, boosts(spark, sf))


@query("JN-01", f"WITH {BASE} SELECT query_id, chunk_id, token, tf FROM term JOIN posting USING (token)")
def jn01(spark: S, sf: str) -> DataFrame:
    terms = ranking.query_terms(questions(spark, sf))
    return ranking.match_postings(terms, corpus.postings(chunks(spark, sf))).select("query_id", "chunk_id", "token", "tf")


@query("AGG-01", f"WITH {BASE} SELECT query_id, chunk_id, round(score, 6) AS score, matched FROM bm25")
def agg01(spark: S, sf: str) -> DataFrame:
    return ranking.bm25(questions(spark, sf), chunks(spark, sf)).withColumn("score", F.round("score", 6))


@query("RET-01", f"WITH {BASE}, {KEYWORD} SELECT query_id, rank, chunk_id, score, matched FROM ranked WHERE rank <= 5")
def ret01(spark: S, sf: str) -> DataFrame:
    return keyword(spark, sf)


@query("WIN-03", f"WITH {BASE}, {KEYWORD} SELECT query_id, chunk_id, rank FROM ranked")
def win03(spark: S, sf: str) -> DataFrame:
    """Base ranks of all scored chunks of each question."""
    return ranking.rank_base(questions(spark, sf), chunks(spark, sf), boosts(spark, sf))


@query("TOP-01", f"WITH {BASE}, {KEYWORD} SELECT query_id, rank, chunk_id FROM ranked WHERE rank <= 20")
def top01(spark: S, sf: str) -> DataFrame:
    return keyword(spark, sf, 20).select("query_id", "rank", "chunk_id")


_PROFILE = "CASE query_id % 3 WHEN 0 THEN 'precision' WHEN 1 THEN 'recall' ELSE 'balanced' END"


@query("TOP-03", f"""WITH {BASE}, c AS (SELECT query_id, count(*) AS n FROM bm25 GROUP BY 1), w AS (SELECT *, CASE WHEN query_id % 5 = 0 THEN greatest(5, least(12, n))
WHEN {_PROFILE} = 'precision' THEN 10 WHEN {_PROFILE} = 'recall' THEN 30 ELSE 24 END AS k FROM c) SELECT query_id, n, CASE WHEN n = 0 THEN 0 ELSE greatest(5, least(k, n)) END AS candidate_k FROM w""")
def top03(spark: S, sf: str) -> DataFrame:
    n = ranking.bm25(questions(spark, sf), chunks(spark, sf)).groupBy("query_id").agg(F.count("*").alias("n"))
    given = F.when(F.col("query_id") % 5 == 0, F.lit(12))
    return n.select("query_id", "n", sc.candidate_k(F.expr(_PROFILE), F.lit(5), given, F.col("n")).alias("candidate_k"))


_PAIRS = "SELECT q.vec_id AS query_id, c.vec_id, c.label, round(greatest(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 0), 9) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0"


def vector_pairs(spark: S, sf: str) -> DataFrame:
    """Stated queries (ids divisible by 50) against every vector: queries travel as one bounded array row a block."""
    from siftline.operators.vectors import block_pairs

    vectors = table(spark, sf, "embeddings")
    return block_pairs(vectors.where("vec_id % 50 = 0"), vectors)


@query("JN-02", f"SELECT query_id, vec_id, score FROM ({_PAIRS})")
def jn02(spark: S, sf: str) -> DataFrame:
    return vector_pairs(spark, sf)


@query("SET-01", rf"""WITH {BASE}, {KEYWORD}, n AS (SELECT r.query_id, r.chunk_id, score, row_number() OVER (PARTITION BY query_id, file_name, trim(regexp_replace(text, '\s+', ' ', 'g')) ORDER BY score DESC, chunk_id) AS nth
FROM ranked r JOIN chunks USING (chunk_id) WHERE rank <= 50) SELECT query_id, chunk_id, score FROM n WHERE nth = 1""")
def set01(spark: S, sf: str) -> DataFrame:
    rows = ranking.with_chunks(keyword(spark, sf, 50), chunks(spark, sf))
    return ranking.dedupe_candidates(rows).select("query_id", "chunk_id", "score")


@query("FLT-02", f"WITH {BASE}, {KEYWORD} SELECT query_id, chunk_id, score FROM ranked WHERE rank <= 20 AND score >= 0.9")
def flt02(spark: S, sf: str) -> DataFrame:
    return keyword(spark, sf, 20).where(F.coalesce(F.col("score"), F.lit(0.0)) >= 0.9).select("query_id", "chunk_id", "score")


_EVIDENCE = "evidence AS (SELECT query_id, chunk_id, 1 + abs(hash_id) % 7 AS graph_rank FROM (SELECT query_id, chunk_id, string_split(chunk_id, ':')[1]::BIGINT AS hash_id FROM ranked WHERE rank <= 20) WHERE hash_id % 3 = 0)"


@query("RET-07", f"""WITH {BASE}, {KEYWORD}, {_EVIDENCE}, m AS (SELECT r.query_id, r.chunk_id, score, rank AS base_rank, graph_rank, bool_or(graph_rank IS NOT NULL) OVER (PARTITION BY r.query_id) AS has
FROM (SELECT * FROM ranked WHERE rank <= 20) r LEFT JOIN evidence e ON r.query_id = e.query_id AND r.chunk_id = e.chunk_id)
SELECT query_id, chunk_id, base_rank, graph_rank, round(CASE WHEN has THEN 61 * (0.65 / (60 + base_rank) + coalesce(0.35 / (60 + graph_rank), 0)) ELSE score END, 9) AS fused FROM m""")
def ret07(spark: S, sf: str) -> DataFrame:
    ranked = written(keyword(spark, sf, 20), "ranked")
    doc = F.split("chunk_id", ":").getItem(0).cast("long")
    evidence = ranked.where(doc % 3 == 0).select("query_id", "chunk_id", (1 + doc % 7).alias("graph_rank"))
    return ranking.graph_rrf(ranked.select("query_id", "chunk_id", "score"), evidence)


#: The words of LOW_INFORMATION for SQL, and the reason of a refusal from top_score and the matched terms of the first row.
LOW_LIST = "[" + ", ".join(f"'{w}'" for w in ranking.LOW_INFORMATION) + "]"
REASON = f"CASE WHEN top_score IS NULL THEN 'no_evidence' WHEN top_score < 0.05 THEN 'below_threshold' WHEN len(list_filter(matched, lambda t: NOT list_contains({LOW_LIST}, lower(t)))) = 0 THEN 'weak_grounding' END"
_VAGUE = f"""asked AS (SELECT * FROM ({QUESTIONS.split('AS (', 1)[1]}), questions AS (SELECT query_id, CASE query_id % 5 WHEN 0 THEN 'api 系统 store' WHEN 1 THEN md5(question) WHEN 2 THEN question || ' api' ELSE question END AS question FROM asked),
{WHOLE.replace("text, source", "text || CASE doc_id % 4 WHEN 0 THEN ' API' WHEN 1 THEN ' 系统' ELSE '' END AS text, source")}, {BM25}"""


@query("EVL-01", f"""WITH {_VAGUE}, {KEYWORD}, t AS (SELECT query_id, score AS top_score, matched FROM ranked WHERE rank = 1), r AS (SELECT q.query_id, top_score, {REASON} AS reason FROM questions q LEFT JOIN t USING (query_id))
SELECT query_id, top_score, reason, CASE WHEN reason IS NULL THEN 'answered' ELSE 'refused' END AS decision FROM r""")
def evl01(spark: S, sf: str) -> DataFrame:
    """Half of the documents hold a word that says nothing; every fifth question has only such words, and every fifth one that nobody knows."""
    kind, doc = F.col("query_id") % 5, F.col("document_id").cast("long") % 4
    said = F.when(kind == 0, "api 系统 store").when(kind == 1, F.md5("question")).when(kind == 2, F.concat("question", F.lit(" api"))).otherwise(F.col("question"))
    asked = questions(spark, sf).withColumn("question", said)
    texts = chunks(spark, sf).withColumn("text", F.concat("text", F.when(doc == 0, " API").when(doc == 1, " 系统").otherwise("")))
    return ranking.refusal_decision(asked, ranking.keyword_search(asked, texts, 5, boosts(spark, sf)))


@query("TXT-14", f"""WITH {BASE}, {KEYWORD}, p AS (SELECT query_id, chunk_id, text, coalesce(list_min(list_filter(list_transform(matched, lambda t: position(t IN lower(text))), lambda x: x > 0)) - 1, 0) AS centre FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 5),
s AS (SELECT *, greatest(centre - 60, 0) AS a, least(greatest(centre - 60, 0) + 180, length(text)) AS b FROM p)
SELECT query_id, chunk_id, CASE WHEN a > 0 THEN '...' ELSE '' END || trim(substr(text, a + 1, b - a)) || CASE WHEN b < length(text) THEN '...' ELSE '' END AS snippet FROM s""")
def txt14(spark: S, sf: str) -> DataFrame:
    rows = ranking.with_chunks(keyword(spark, sf), chunks(spark, sf))
    return rows.select("query_id", "chunk_id", tx.snippet(F.col("text"), F.col("matched")).alias("snippet"))


@query("RET-02", f"WITH {QUESTIONS}, {WHOLE}, {COSINE}, {BOOSTS}, {SEMANTIC} SELECT * FROM (SELECT query_id, {TOP} AS rank, chunk_id, score FROM semantic) WHERE rank <= 5")
def ret02(spark: S, sf: str) -> DataFrame:
    return ranking.semantic_search(questions(spark, sf), chunks(spark, sf), boosts=boosts(spark, sf))


@query("RET-03", f"WITH {BOTH}, {BOOSTS}, {HYBRID} SELECT * FROM (SELECT query_id, {TOP} AS rank, chunk_id, round(keyword, 6) AS keyword, round(vector, 6) AS vector, round(score, 6) AS score FROM hybrid) WHERE rank <= 5")
def ret03(spark: S, sf: str) -> DataFrame:
    return ranking.hybrid_search(questions(spark, sf), chunks(spark, sf), boosts=boosts(spark, sf))


@query("TOP-02", f"""WITH p AS ({_PAIRS}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM p WHERE query_id % 100 <> 0 OR label IN (1, 2, 3)), k AS (SELECT * FROM r WHERE query_id % 100 = 0 OR place <= 24)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, score FROM k WHERE label <> 3""")
def top02(spark: S, sf: str) -> DataFrame:
    """Questions with a scope (labels 1 to 3) rank all vectors of it, the others their 24 nearest; one modality (label 3) goes after ranking."""
    pairs = vector_pairs(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    scoped = F.col("query_id") % 100 == 0
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    wide = pairs.where(scoped & F.col("label").isin(1, 2, 3))
    near = pairs.where(~scoped).withColumn("place", F.row_number().over(order)).where("place <= 24").drop("place")
    return wide.unionByName(near).where("label <> 3").withColumn("rank", F.row_number().over(order)).select("query_id", "vec_id", "rank", "score")


@query("FLT-01", "SELECT doc_id, lang, CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'image' END AS modality FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND coalesce(lang, 'default') IN ('en', 'de', 'default') AND doc_id % 3 < 2")
def flt01(spark: S, sf: str) -> DataFrame:
    """Documents of good quality, two languages and the default, and two modalities."""
    modality = F.when(F.col("doc_id") % 3 == 0, "text").when(F.col("doc_id") % 3 == 1, "table").otherwise("image")
    rows = table(spark, sf, "documents").select("doc_id", "lang", modality.alias("modality"))
    wanted = lambda column, *values: spark.createDataFrame([(v,) for v in values], f"{column} string")
    return ranking.scoped(rows, doc_id=table(spark, sf, "labels").where("quality = 1").select("doc_id"), lang=wanted("lang", "en", "de", "default"), modality=wanted("modality", "text", "table"), source=None)


_HEAD = r"lower(regexp_extract(text, '^[^\n]{0,40}'))"
RERANK = f"""rr AS (SELECT r.query_id, r.chunk_id, round(0.72 * score + 0.2 * len(list_intersect(list_distinct({tok('question')}), list_distinct({tok('text')}))) / greatest(len(list_distinct({tok('question')})), 1)
+ CASE WHEN trim(question) <> '' AND contains(text, trim(question)) THEN 0.12 ELSE 0 END + CASE WHEN len(list_filter({tok('question')}, lambda t: contains({_HEAD}, t))) > 0 THEN 0.05 ELSE 0 END, 9) AS rerank_score FROM ranked r JOIN chunks USING (chunk_id) JOIN questions USING (query_id) WHERE rank <= 20)"""


@query("RET-05", f"WITH {BASE}, {KEYWORD}, {RERANK} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rerank, rerank_score FROM rr")
def ret05(spark: S, sf: str) -> DataFrame:
    return ranking.keyword_rerank(questions(spark, sf), ranking.with_chunks(keyword(spark, sf, 20), chunks(spark, sf)))


_RUNS = f"""p AS (SELECT 0 AS i, 'keyword' AS profile, query_id, chunk_id, score FROM ranked UNION ALL SELECT 1, 'semantic', query_id, chunk_id, score FROM semantic UNION ALL SELECT 2, 'hybrid', query_id, chunk_id, score FROM hybrid),
fr AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hybrid), hr AS ({RERANK.split('rr AS (', 1)[1][:-1].replace('FROM ranked r', 'FROM fr r')}),
runs AS (SELECT i, profile, query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY profile, query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT * FROM p UNION ALL SELECT 3, 'rerank', query_id, chunk_id, rerank_score FROM hr)) WHERE rank <= 5)"""
PROFILES = f"{BOTH}, {KEYWORD}, {SEMANTIC}, {HYBRID}, {_RUNS}"


def profile_runs(spark: S, sf: str, k: int = 5) -> tuple[dict[str, DataFrame], DataFrame]:
    """Four profiles' first rows (query_id, rank, chunk_id and score), and the chunks of these and of the rows that were reranked."""
    q, c = questions(spark, sf), chunks(spark, sf)
    return ranking.search_profiles(q, c, boosts(spark, sf), k)


@query("RET-10", f"""WITH {PROFILES}, t AS (SELECT i, profile, query_id, count(*) AS n, round(max(score), 6) AS top_score, max(chunk_id) FILTER (WHERE rank = 1) AS top_chunk FROM runs GROUP BY 1, 2, 3)
SELECT profile, query_id, n, top_score, top_chunk, file_name AS top_source, row_number() OVER (PARTITION BY query_id ORDER BY top_score DESC, i) = 1 AS best FROM t JOIN chunks ON chunk_id = top_chunk""")
def ret10(spark: S, sf: str) -> DataFrame:
    return ranking.compare_profiles(*profile_runs(spark, sf))


@query("EVL-09", f"""WITH {PROFILES}, cases AS (SELECT item_id AS query_id, CASE WHEN item_id % 8 = 3 THEN [] ELSE {tok('text')}[13:15] END AS keywords FROM benchmark),
x AS (SELECT f.profile, c.query_id, keywords, count(rank) AS n, count(*) FILTER (WHERE hit) AS relevant, min(rank) FILTER (WHERE hit) AS first, max(score) AS top FROM (SELECT DISTINCT profile FROM runs) f CROSS JOIN cases c LEFT JOIN
(SELECT r.*, len(list_filter((SELECT keywords FROM cases k WHERE k.query_id = r.query_id), lambda w: contains(lower(text), w))) > 0 AS hit FROM runs r JOIN chunks USING (chunk_id)) r ON f.profile = r.profile AND c.query_id = r.query_id GROUP BY 1, 2, 3),
y AS (SELECT *, len(keywords) = 0 AS none, coalesce(top < 0.05, true) AS silent FROM x)
SELECT profile, count(*) AS cases, round(avg(CASE WHEN none THEN silent ELSE first IS NOT NULL END::INT), 4) AS recall, round(avg(coalesce(1.0 / first, 0)), 4) AS mrr, round(avg(CASE WHEN none THEN silent::INT ELSE relevant / greatest(n, 1) END), 4) AS precision,
round(coalesce(count(*) FILTER (WHERE none AND silent) / nullif(count(*) FILTER (WHERE none), 0), 0), 4) AS no_answer FROM y GROUP BY 1""")
def evl09(spark: S, sf: str) -> DataFrame:
    """Cases expect three words of their passage; every eighth expects no answer."""
    words = F.when(F.col("item_id") % 8 == 3, F.array().cast("array<string>")).otherwise(F.slice(tx.tokenize(F.col("text")), 13, 3))
    cases = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("keywords"))
    rows, (runs, found) = None, profile_runs(spark, sf)
    for name, df in runs.items():
        one = df.select(F.lit(name).alias("profile"), "query_id", "rank", "chunk_id", "score")
        rows = one if rows is None else rows.unionByName(one)
    return ranking.profile_metrics(cases, rows.join(found.select("chunk_id", "text"), "chunk_id"))


@query("EVL-02", f"""WITH {BASE}, {KEYWORD} SELECT q.query_id, coalesce(string_agg('[' || rank || '] ' || CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 150 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE rtrim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 150)) || '...' END
|| ' (' || file_name || ', chunk ' || chunk_id || ', score ' || CAST(score AS DECIMAL(10, 4)) || ')', chr(10) ORDER BY rank), 'no evidence') AS answer
FROM questions q LEFT JOIN (SELECT * FROM ranked WHERE rank <= 3) r USING (query_id) LEFT JOIN chunks USING (chunk_id) GROUP BY 1""")
def evl02(spark: S, sf: str) -> DataFrame:
    return ranking.template_answers(questions(spark, sf), ranking.with_chunks(keyword(spark, sf, 3), chunks(spark, sf)))
