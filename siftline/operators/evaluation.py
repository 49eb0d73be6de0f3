"""Evaluation of answers and retrieval against cases with expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least values of the metrics.
THRESHOLDS = {
    "recall_at_5": 0.9, "mrr": 0.75, "citation_accuracy": 0.75, "refusal_accuracy": 0.8, "answer_acceptance_accuracy": 0.85, "modality_recall_at_5": 0.85,
    "table_cell_accuracy": 0.9, "caption_alignment": 0.9, "formula_accuracy": 0.9, "graph_path_precision": 0.9, "graph_evidence_coverage": 0.95, "multihop_recall_at_5": 0.85,
}


def relevant(text: Column, file_name: Column, sources: Column, keywords: Column) -> Column:
    """Whether a citation comes from an expected source, if there are any, and holds a keyword; without keywords the source decides."""
    right = (F.size(sources) == 0) | F.array_contains(sources, file_name)
    return F.when(F.size(keywords) == 0, F.size(sources) > 0).otherwise(F.exists(keywords, lambda w: F.contains(F.lower(text), F.lower(w)))) & right


def case_relevance(cases: DataFrame, citations: DataFrame) -> DataFrame:
    """query_id, chunk_id, rank and relevant of each citation (with file_name and text)."""
    rows = citations.join(cases.select("query_id", "sources", "keywords"), "query_id")
    return rows.select("query_id", "chunk_id", "rank", relevant(F.col("text"), F.col("file_name"), F.col("sources"), F.col("keywords")).alias("relevant"))


def evaluate_cases(cases: DataFrame, citations: DataFrame, decisions: DataFrame, graph: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row for each case: its decision, hits, ranks and what its modality asks for.

    ``cases``: query_id, should_answer, category, modality, sources, keywords, cells, caption, formula, path. ``citations``: the
    rows returned (rank, score, file_name, text, doc_id). ``graph``: labels of paths; ``evidence``: query_id and doc_id, distinct rows. What a case does not expect is null.
    """
    low = F.lower("text")
    holds = lambda words: F.forall(words, lambda w: F.contains(low, F.lower(w)))
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    rows = citations.join(cases, "query_id")
    rows = rows.withColumn("hit", relevant(F.col("text"), F.col("file_name"), F.col("sources"), F.col("keywords")))
    found = rows.groupBy("query_id").agg(
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_rank"), F.bool_or((F.col("rank") == 1) & F.col("hit")).alias("first_hit"), F.max("score").alias("top_score"),
        F.bool_or(holds("cells")).alias("cell"), F.bool_or(holds("caption")).alias("caption_hit"), F.bool_or(F.contains(bare(F.col("text")), bare(F.col("formula")))).alias("formula_hit"),
    )
    out = cases.join(decisions.select("query_id", "decision"), "query_id").join(found, "query_id", "left").join(graph.select("query_id", "labels"), "query_id", "left")
    # Only counts are gathered of the evidence: its rows, and those that a citation shows.
    cited = citations.select("query_id", "doc_id").distinct().withColumn("cited", F.lit(1))
    shares = evidence.join(cited, ["query_id", "doc_id"], "left").groupBy("query_id").agg((F.count("cited") / F.count("*")).alias("covered"))
    out = out.join(shares, "query_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    answer, asks_graph = F.col("should_answer"), F.col("category") == "multihop-graph"
    on_path = lambda labels: F.forall("path", lambda w: F.exists(labels, lambda x: F.contains(F.lower(x), F.lower(w))))
    refused = F.col("decision") == "refused"
    return out.select(
        "query_id", "category", "modality", "should_answer", "sources", "decision", F.when(answer, ~refused).otherwise(refused).alias("decision_correct"),
        F.when(answer, F.col("first_rank").isNotNull()).alias("recall_hit"), "first_rank", F.when(answer, no(F.col("first_hit"))).otherwise(F.col("top_score").isNull()).alias("citation_correct"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
        F.when(F.size("cells") > 0, no(F.col("cell"))).alias("table_cell_correct"), F.when(F.size("caption") > 0, no(F.col("caption_hit"))).alias("caption_aligned"), F.when(F.col("formula").isNotNull(), no(F.col("formula_hit"))).alias("formula_correct"),
        F.when(asks_graph, no(F.exists("labels", on_path))).alias("graph_path_correct"), F.when(asks_graph, F.round(F.coalesce("covered", F.lit(0.0)), 9)).alias("graph_evidence_coverage"),
    )


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """One row: the twelve metrics over evaluate_cases(), 0 without cases, and the numbers of cases of each category and source."""
    answer = F.col("should_answer")
    share = lambda value, among: F.round(F.coalesce(F.try_divide(F.sum(F.when(among, F.coalesce(value.cast("double"), F.lit(0.0)))), F.count_if(among)), F.lit(0.0)), 4)
    known = lambda name: share(F.col(name), F.col(name).isNotNull())
    one = rows.agg(
        F.count("*").alias("cases"), F.count_if(answer).alias("answerable_cases"), F.count_if(~answer).alias("refusal_cases"),
        share(F.col("recall_hit"), answer).alias("recall_at_5"), share(1.0 / F.col("first_rank"), answer).alias("mrr"), share(F.col("citation_correct"), answer).alias("citation_accuracy"),
        share(F.col("decision_correct"), ~answer).alias("refusal_accuracy"), share(F.col("decision_correct"), answer).alias("answer_acceptance_accuracy"),
        share(F.col("recall_hit"), answer & F.col("modality").isNotNull()).alias("modality_recall_at_5"), known("table_cell_correct").alias("table_cell_accuracy"), known("caption_aligned").alias("caption_alignment"),
        known("formula_correct").alias("formula_accuracy"), known("graph_path_correct").alias("graph_path_precision"), known("graph_evidence_coverage").alias("graph_evidence_coverage"),
        share(F.col("recall_hit"), answer & (F.col("category") == "multihop-graph")).alias("multihop_recall_at_5"),
    )

    def counted(key: Column, out: str) -> DataFrame:
        n = rows.select(key.alias("k")).groupBy("k").agg(F.count("*").alias("n"))  # few categories and sources
        return n.agg(F.array_sort(F.collect_list(F.concat("k", F.lit("="), F.col("n").cast("string")))).alias(out))

    return one.crossJoin(counted(F.col("category"), "categories")).crossJoin(counted(F.explode("sources"), "sources"))  # one row each


def threshold_checks(summary: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    rows = summary.select(F.lit(0).alias("one"), *[F.col(m).cast("double").alias(m) for m in thresholds]).unpivot("one", list(thresholds), "metric", "actual")
    least = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])[F.col("metric")]
    return rows.select("metric", "actual", least.alias("minimum"), (F.col("actual") >= least).alias("passed"))


def keyword_checks(cases: DataFrame, citations: DataFrame, refuse_below: float = 0.05) -> DataFrame:
    """Whether any keyword stands in the rows returned, or, for a case without keywords, their best score is low."""
    hit = F.exists("keywords", lambda w: F.contains(F.lower("text"), F.lower(w)))
    rows = cases.select("query_id", "keywords").join(citations.select("query_id", "text", "score"), "query_id", "left")
    found = rows.groupBy("query_id", "keywords").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("hit"), F.coalesce(F.max("score"), F.lit(0.0)).alias("top"))
    return found.select("query_id", F.when(F.size("keywords") == 0, F.col("top") < refuse_below).otherwise(F.col("hit")).alias("passed"))


def evaluation_report(rows: DataFrame, summary: DataFrame, checks: DataFrame) -> DataFrame:
    """section, key and line of the whole report: 0 its head, 1 the checks, 2 distributions, 3 a line for each case, 4 the cases that failed, 5 each case as JSON.

    Lines are rows, so that a report of many cases is written by many tasks; in order of section and key they are the Markdown text, the last section aside.
    """
    mark = lambda c: F.when(c.isNull(), "-").when(c, "yes").otherwise("no")
    number = lambda c: F.format_string("%.4f", F.col(c).cast("double"))
    part = lambda df, section, key, line: df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), line.alias("line"))
    key, text = F.col("query_id"), lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    head = F.concat(F.lit("cases: "), text("cases"), F.lit(" ("), text("answerable_cases"), F.lit(" to answer, "), text("refusal_cases"), F.lit(" to refuse)"))
    spread = F.explode(F.array(*[F.struct(F.lit(n).alias("key"), F.concat(F.lit(f"- {n}: "), F.array_join(n, ", ")).alias("line")) for n in ("categories", "sources")]))
    failed = ~F.col("decision_correct") | ~F.col("citation_correct") | ~F.coalesce("recall_hit", F.lit(True))
    wanted = F.when(F.size("sources") > 0, F.array_join("sources", ", ")).when(F.col("should_answer"), "an answer").otherwise("a refusal")
    told = F.to_json(F.struct("query_id", "category", "decision", "decision_correct", "citation_correct", "recall_hit", "first_rank"), {"ignoreNullFields": "false"})
    case = F.concat(F.lit("| "), F.concat_ws(" | ", text("query_id"), "decision", mark(F.col("recall_hit")), text("first_rank"), mark(F.col("citation_correct"))), F.lit(" |"))
    spreads = summary.select(spread.alias("d")).select(F.lit(2).alias("section"), "d.key", "d.line")
    return (
        part(summary, 0, F.lit(""), head)
        .unionByName(part(checks, 1, F.col("metric"), F.concat(F.lit("| "), F.concat_ws(" | ", "metric", number("actual"), number("minimum"), F.when(F.col("passed"), "pass").otherwise("fail")), F.lit(" |"))))
        .unionByName(spreads)
        .unionByName(part(rows, 3, key, case))
        .unionByName(part(rows.where(failed), 4, key, F.concat(F.lit("- "), text("query_id"), F.lit(" (wanted: "), wanted, F.lit("; was: "), "decision", F.lit(")"))))
        .unionByName(part(rows, 5, key, told))
    )
