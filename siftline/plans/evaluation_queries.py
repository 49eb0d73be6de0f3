"""Queries that evaluate retrieval on cases made from the benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.operators import evaluation as ev
from siftline.operators import ranking
from siftline.plans.graph_queries import _PATHS, _SEARCH, graph_found
from siftline.plans.ranking_queries import REASON, KEYWORD, boosts, chunks
from siftline.plans.registry import query
from siftline.plans.sql import BM25, QUESTIONS, WHOLE, tok
from siftline.sources.scratch import written
from siftline.sources.tables import questions, table

S = SparkSession
CATEGORIES = ("table", "caption", "formula", "multihop-graph", "general")
_W = tok("text")
_CATEGORY = "CASE item_id % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORIES)) + " END"
_CASES = f"""cs AS (SELECT item_id AS query_id, item_id % 9 <> 4 AS should_answer, {_CATEGORY} AS category, CASE WHEN item_id % 5 < 3 THEN {_CATEGORY} END AS modality, CASE WHEN item_id % 4 = 0 THEN ['src0', 'src1', 'src2'] ELSE [] END AS sources,
CASE WHEN item_id % 6 = 5 THEN [] ELSE {_W}[13:15] END AS keywords, CASE WHEN item_id % 5 = 0 THEN {_W}[2:3] ELSE [] END AS cells, CASE WHEN item_id % 5 = 1 THEN {_W}[4:5] ELSE [] END AS caption,
CASE WHEN item_id % 5 = 2 THEN array_to_string({_W}[6:7], ' ') END AS formula, CASE WHEN item_id % 5 = 3 THEN {_W}[1:1] ELSE [] END AS path FROM benchmark)"""
_ASKED = QUESTIONS.replace("questions AS", "asked AS") + ", questions AS (SELECT query_id, CASE WHEN query_id % 9 = 4 THEN md5(question) ELSE question END AS question FROM asked)"
_CITED = f"{_ASKED}, {WHOLE}, {BM25}, {KEYWORD}, cited AS (SELECT query_id, chunk_id, rank, score, matched, file_name, text, document_id::BIGINT AS doc_id FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 5)"
_RIGHT = "(len(sources) = 0 OR list_contains(sources, file_name)) AND CASE WHEN len(keywords) = 0 THEN len(sources) > 0 ELSE len(list_filter(keywords, lambda w: contains(lower(text), lower(w)))) > 0 END"


def cases(spark: S, sf: str) -> DataFrame:
    """Each passage is a case whose words are expected; every ninth asks for what nobody knows."""
    item, words = F.col("item_id"), F.col("w")
    part = lambda of, rest, a, n: F.when(item % of == rest, F.slice(words, a, n)).otherwise(F.array().cast("array<string>"))
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (item % 5 + 1).cast("int"))
    rows = table(spark, sf, "benchmark").withColumn("w", tx.tokenize(F.col("text")))
    return rows.select(
        item.alias("query_id"), (item % 9 != 4).alias("should_answer"), category.alias("category"), F.when(item % 5 < 3, category).alias("modality"),
        F.when(item % 4 == 0, F.array(*[F.lit(f"src{i}") for i in range(3)])).otherwise(F.array().cast("array<string>")).alias("sources"),
        F.when(item % 6 == 5, F.array().cast("array<string>")).otherwise(F.slice(words, 13, 3)).alias("keywords"), part(5, 0, 2, 2).alias("cells"), part(5, 1, 4, 2).alias("caption"),
        F.when(item % 5 == 2, F.array_join(F.slice(words, 6, 2), " ")).alias("formula"), part(5, 3, 1, 1).alias("path"),
    )


def case_questions(spark: S, sf: str) -> DataFrame:
    return questions(spark, sf).select("query_id", F.when(F.col("query_id") % 9 == 4, F.md5("question")).otherwise(F.col("question")).alias("question"))


def case_citations(spark: S, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    found = ranking.with_chunks(ranking.keyword_search(case_questions(spark, sf), c, 5, boosts(spark, sf)), c)
    return written(found.select("query_id", "chunk_id", "rank", "score", "matched", "file_name", "text", F.col("document_id").cast("long").alias("doc_id")), "citations")


@query("EVL-05", f"WITH {_CITED}, {_CASES} SELECT query_id, chunk_id, rank, {_RIGHT} AS relevant FROM cited JOIN cs USING (query_id)")
def evl05(spark: S, sf: str) -> DataFrame:
    return ev.case_relevance(cases(spark, sf), case_citations(spark, sf))


_HOLDS = lambda words: f"bool_or(len(list_filter({words}, lambda w: NOT contains(lower(text), lower(w)))) = 0)"
_BARE = lambda t: rf"lower(regexp_replace({t}, '\s+', '', 'g'))"
_ROWS = f"""graph AS (SELECT * FROM (WITH RECURSIVE {_PATHS}, {_SEARCH} SELECT query_id, labels, coalesce(l, []) AS evidence FROM graph LEFT JOIN (SELECT query_id, list(doc_id) AS l FROM evidence GROUP BY 1) USING (query_id))),
t AS (SELECT query_id, score AS top_score, matched FROM cited WHERE rank = 1),
dec AS (SELECT q.query_id, CASE WHEN {REASON} IS NULL THEN 'answered' ELSE 'refused' END AS decision FROM questions q LEFT JOIN t USING (query_id)),
f AS (SELECT query_id, min(rank) FILTER (WHERE hit) AS first_rank, bool_or(rank = 1 AND hit) AS first_hit, max(score) AS top_score, {_HOLDS('cells')} AS cell, {_HOLDS('caption')} AS caption_hit, bool_or(contains({_BARE('text')}, {_BARE('formula')})) AS formula_hit, list(DISTINCT doc_id) AS cited
FROM (SELECT *, {_RIGHT} AS hit FROM cited JOIN cs USING (query_id)) GROUP BY 1),
result AS (SELECT query_id, category, modality, should_answer, sources, decision, CASE WHEN should_answer THEN decision <> 'refused' ELSE decision = 'refused' END AS decision_correct, CASE WHEN should_answer THEN first_rank IS NOT NULL END AS recall_hit, first_rank,
CASE WHEN should_answer THEN coalesce(first_hit, false) ELSE top_score IS NULL END AS citation_correct, coalesce(top_score, 0.0) AS top_score, CASE WHEN len(cells) > 0 THEN coalesce(cell, false) END AS table_cell_correct, CASE WHEN len(caption) > 0 THEN coalesce(caption_hit, false) END AS caption_aligned,
CASE WHEN formula IS NOT NULL THEN coalesce(formula_hit, false) END AS formula_correct, CASE WHEN category = 'multihop-graph' THEN coalesce(len(list_filter(labels, lambda p: len(list_filter(path, lambda w: len(list_filter(p, lambda x: contains(lower(x), lower(w)))) = 0)) = 0)) > 0, false) END AS graph_path_correct,
CASE WHEN category = 'multihop-graph' THEN round(coalesce(len(list_intersect(evidence, coalesce(cited, []))) / greatest(len(evidence), 1), 0), 9) END AS graph_evidence_coverage
FROM cs JOIN dec USING (query_id) LEFT JOIN f USING (query_id) LEFT JOIN graph USING (query_id))"""
_EVALUATED = f"{_CITED}, {_CASES}, {_ROWS}"


def evaluated(spark: S, sf: str) -> DataFrame:
    citations = case_citations(spark, sf)
    return ev.evaluate_cases(cases(spark, sf), citations, ranking.refusal_decision(case_questions(spark, sf), citations), *graph_found(spark, sf))


@query("EVL-06", f"WITH RECURSIVE {_EVALUATED} SELECT * FROM result")
def evl06(spark: S, sf: str) -> DataFrame:
    return evaluated(spark, sf)


_SHARE = lambda value, among: f"round(coalesce(sum(CASE WHEN {among} THEN coalesce(({value})::DOUBLE, 0) END) / nullif(count(*) FILTER (WHERE {among}), 0), 0), 4)"
_KNOWN = lambda name: _SHARE(name, f"{name} IS NOT NULL")
_METRICS = {
    "recall_at_5": _SHARE("recall_hit", "should_answer"), "mrr": _SHARE("1.0 / first_rank", "should_answer"), "citation_accuracy": _SHARE("citation_correct", "should_answer"), "refusal_accuracy": _SHARE("decision_correct", "NOT should_answer"),
    "answer_acceptance_accuracy": _SHARE("decision_correct", "should_answer"), "modality_recall_at_5": _SHARE("recall_hit", "should_answer AND modality IS NOT NULL"), "table_cell_accuracy": _KNOWN("table_cell_correct"), "caption_alignment": _KNOWN("caption_aligned"),
    "formula_accuracy": _KNOWN("formula_correct"), "graph_path_precision": _KNOWN("graph_path_correct"), "graph_evidence_coverage": _KNOWN("graph_evidence_coverage"), "multihop_recall_at_5": _SHARE("recall_hit", "should_answer AND category = 'multihop-graph'"),
}
_SUMMARY = f"""summary AS (SELECT count(*) AS cases, count(*) FILTER (WHERE should_answer) AS answerable_cases, count(*) FILTER (WHERE NOT should_answer) AS refusal_cases, {", ".join(f"{v} AS {k}" for k, v in _METRICS.items())},
(SELECT list_sort(list(c)) FROM (SELECT category || '=' || count(*) AS c FROM result GROUP BY category)) AS categories, (SELECT coalesce(list_sort(list(c)), []) FROM (SELECT s || '=' || count(*) AS c FROM (SELECT unnest(sources) AS s FROM result) GROUP BY s)) AS sources FROM result)"""


@query("AGG-14", f"WITH RECURSIVE {_EVALUATED}, {_SUMMARY} SELECT * FROM summary")
def agg14(spark: S, sf: str) -> DataFrame:
    return ev.evaluation_summary(written(evaluated(spark, sf), "evaluated"))


@query("EVL-08", f"WITH RECURSIVE {_EVALUATED}, {_SUMMARY} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS actual, {v} AS minimum, {m} >= {v} AS passed FROM summary" for m, v in ev.THRESHOLDS.items()))
def evl08(spark: S, sf: str) -> DataFrame:
    return ev.threshold_checks(agg14(spark, sf), ev.THRESHOLDS)


@query("EVL-07", f"WITH {_CITED}, {_CASES} SELECT query_id, CASE WHEN len(any_value(keywords)) = 0 THEN coalesce(max(score), 0) < 0.05 ELSE coalesce(bool_or(len(list_filter(keywords, lambda w: contains(lower(text), lower(w)))) > 0), false) END AS passed FROM cs LEFT JOIN cited USING (query_id) GROUP BY 1")
def evl07(spark: S, sf: str) -> DataFrame:
    return ev.keyword_checks(cases(spark, sf), case_citations(spark, sf))


_MARK = lambda c: f"CASE WHEN {c} IS NULL THEN '-' WHEN {c} THEN 'yes' ELSE 'no' END"
_JSON = lambda c, quoted=False: f"'\"{c}\":' || coalesce(" + (f"'\"' || {c} || '\"'" if quoted else f"({c})::VARCHAR") + ", 'null')"
_CHECKED = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS actual, {v}::DOUBLE AS minimum FROM summary" for m, v in ev.THRESHOLDS.items())


@query("SRC-15", f"""WITH RECURSIVE {_EVALUATED}, {_SUMMARY} SELECT 0 AS section, '' AS key, 'cases: ' || cases || ' (' || answerable_cases || ' to answer, ' || refusal_cases || ' to refuse)' AS line FROM summary
UNION ALL SELECT 1, metric, '| ' || metric || ' | ' || printf('%.4f', actual) || ' | ' || printf('%.4f', minimum) || ' | ' || CASE WHEN actual >= minimum THEN 'pass' ELSE 'fail' END || ' |' FROM ({_CHECKED})
UNION ALL SELECT 2, 'categories', '- categories: ' || array_to_string(categories, ', ') FROM summary UNION ALL SELECT 2, 'sources', '- sources: ' || array_to_string(sources, ', ') FROM summary
UNION ALL SELECT 3, query_id::VARCHAR, '| ' || query_id || ' | ' || decision || ' | ' || {_MARK('recall_hit')} || ' | ' || coalesce(first_rank::VARCHAR, '-') || ' | ' || {_MARK('citation_correct')} || ' |' FROM result
UNION ALL SELECT 4, query_id::VARCHAR, '- ' || query_id || ' (wanted: ' || CASE WHEN len(sources) > 0 THEN array_to_string(sources, ', ') WHEN should_answer THEN 'an answer' ELSE 'a refusal' END || '; was: ' || decision || ')' FROM result WHERE NOT decision_correct OR NOT citation_correct OR NOT coalesce(recall_hit, true)
UNION ALL SELECT 5, query_id::VARCHAR, '{{' || {_JSON('query_id')} || ',' || {_JSON('category', True)} || ',' || {_JSON('decision', True)} || ',' || {_JSON('decision_correct')} || ',' || {_JSON('citation_correct')} || ',' || {_JSON('recall_hit')} || ',' || {_JSON('first_rank')} || '}}' FROM result""")
def src15(spark: S, sf: str) -> DataFrame:
    rows = written(evaluated(spark, sf), "evaluated")
    summary = written(ev.evaluation_summary(rows), "summary")
    return ev.evaluation_report(rows, summary, ev.threshold_checks(summary, ev.THRESHOLDS))
