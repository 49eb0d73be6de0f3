"""Seeds of any script, shortest paths against a plain search, whole evidence, and a hub."""

import itertools
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from siftline.operators import graph


def test_labels_of_several_words_and_of_han(spark, monkeypatch):
    monkeypatch.setattr(graph, "AUTOMATON", 2)
    monkeypatch.setattr(graph, "ASKED", 1)
    asked = spark.createDataFrame([(1, "How does the Vector Index of 数据库系统 work?"), (2, "index"), (3, ""), (4, None)], "query_id long, question string")
    nodes = spark.createDataFrame([(x,) for x in ("vector index", "数据库", "库系", "index", "ex of", "dex", "other label", "", "work?")], "label string")
    got = {(r.query_id, r.label) for r in graph.labels_inside(asked, nodes).collect()}
    assert got == {(1, x) for x in ("vector index", "数据库", "库系", "index", "ex of", "dex", "work?")} | {(2, "index"), (2, "dex")}
    assert (2, "vector index") in {(r.query_id, r.label) for r in graph.graph_seeds(asked, nodes).collect()}
    assert graph.labels_inside(asked.limit(0), nodes).count() == 0 and graph.labels_inside(asked, nodes.limit(0)).count() == 0


def shortest(edges, source, target, hops):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    paths = [[source]]
    for _ in range(hops):
        paths = [[*p, n] for p in paths for n in sorted(near[p[-1]]) if n not in p]
        if hit := [p for p in paths if p[-1] == target]:
            return min(hit)
    return None


def test_paths_of_four_hops_against_a_plain_search(spark):
    rng = np.random.default_rng(12)
    edges = sorted({tuple(sorted((f"n{a:02d}", f"n{b:02d}"))) for a, b in rng.integers(0, 40, (52, 2)) if a != b})
    sure = {e: round(0.5 + 0.01 * i, 3) for i, e in enumerate(edges)}
    pairs = [(f"n{a:02d}", f"n{b:02d}") for a, b in itertools.combinations(range(0, 40, 3), 2)]
    table = spark.createDataFrame([(b, a, sure[a, b]) for a, b in edges], "a string, b string, confidence double")
    asked = spark.createDataFrame(pairs, "source string, target string")
    for hops in (1, 2, 3, 4):
        got = {(r.source, r.target): (r.path, r.hops, r.score) for r in graph.bounded_paths(asked, table, hops).collect()}
        want = {}
        for s, t in pairs:
            if p := shortest(edges, s, t, hops):
                want[s, t] = p, len(p) - 1, round(sum(sure[tuple(sorted(x))] for x in itertools.pairwise(p)) / (len(p) - 1), 6)
        assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
        assert all(abs(got[k][2] - want[k][2]) < 1e-6 for k in want)


def test_hub_of_ten_thousand_edges_and_its_evidence(spark):
    spokes = spark.range(10_000).select(F.lit("hub").alias("a"), F.format_string("s%05d", "id").alias("b"), F.col("id").alias("doc_id"))
    many = spark.range(500).select(F.lit("s00001").alias("a"), F.lit("hub").alias("b"), (F.col("id") + 50_000).alias("doc_id"))
    ends = spark.createDataFrame([("x", "s00000", 1), ("y", "s09999", 2)], "a string, b string, doc_id long")
    relations = spokes.unionByName(many).unionByName(ends)
    pairs = spark.createDataFrame([("x", "y"), ("s00001", "s00002"), ("x", "hub"), ("x", "nowhere"), ("x", "x")], "source string, target string")
    paths = graph.bounded_paths(pairs, graph.sure_edges(relations), 4)
    got = {(r.source, r.target): r.path for r in paths.collect()}
    assert got == {("x", "y"): ["x", "s00000", "hub", "s09999", "y"], ("s00001", "s00002"): ["s00001", "hub", "s00002"], ("x", "hub"): ["x", "s00000", "hub"]}
    behind = {(r.target, r.doc_id): r.edge for r in graph.path_evidence(paths, relations).collect()}
    assert {d for t, d in behind if t == "s00002"} == {1, 2} | set(range(50_000, 50_500)) and behind["s00002", 2] == 2 and behind["y", 9999] == 3


def test_evidence_is_ranked_by_paths_then_by_documents(spark):
    relations = spark.createDataFrame([("a", "b", 9), ("a", "b", 4), ("b", "c", 4), ("c", "b", 7), ("q", "r", 3), ("q", "r", 2)], "a string, b string, doc_id long")
    seeds = spark.createDataFrame([(1, "a"), (1, "c"), (2, "q"), (3, "none")], "query_id long, label string")
    pairs = spark.createDataFrame([(1, "a", "c")], "query_id long, source string, target string")
    paths = graph.bounded_paths(pairs, graph.sure_edges(relations), 2)
    got = {(r.query_id, r.graph_rank): r.doc_id for r in graph.graph_evidence(seeds, pairs, paths, relations).collect()}
    assert got == {(1, 1): 4, (1, 2): 9, (1, 3): 7, (2, 1): 2, (2, 2): 3}


def test_second_steps_are_taken_for_open_pairs_only(spark, monkeypatch):
    """Ends around a hub meet at it; the few that do not are searched from their lighter side."""
    rows = {}
    kept = graph.written

    def counted(df, name):
        out = kept(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    spokes = spark.range(3000).select(F.lit("hub").alias("a"), F.format_string("s%04d", "id").alias("b"), F.lit(0.6).alias("confidence"))
    tail = spark.createDataFrame([("hub", "near", 0.9), ("near", "far", 0.7), ("lone", "own", 1.0)], "a string, b string, confidence double")
    pairs = [(f"s{i:04d}", f"s{i + 1:04d}") for i in range(100)] + [("far", "s0005"), ("s0006", "lone"), ("s0007", "unknown")]
    got = {(r.source, r.target): (r.path, r.score) for r in graph.bounded_paths(spark.createDataFrame(pairs, "source string, target string"), spokes.unionByName(tail), 4).collect()}
    assert len(got) == 101 and got["s0003", "s0004"] == (["s0003", "hub", "s0004"], 0.6)
    assert got["far", "s0005"] == (["far", "near", "hub", "s0005"], round((0.7 + 0.9 + 0.6) / 3, 6))
    assert max(n for name, n in rows.items() if name not in ("sure", "edges", "nodes", "placed")) < 10_000


def test_a_clause_over_a_line_break_is_that_of_the_sql(spark, tmp_path):
    import duckdb
    from oracle import spark_rows, sql_rows

    from siftline import catalog

    spark.createDataFrame([(1, "ab cd\nc ef gh"), (2, "2.0.\ncgh"), (3, "abcde\n c \n fgh\n\nabccd")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sql_rows(connection, catalog.oracle_sql()["GRF-03"])
    assert spark_rows(catalog.queries()["GRF-03"](spark, str(tmp_path))) == want and any("\n" in value for row in want[1] for value in row)


def test_edges_nodes_and_totals_over_given_parts(spark):
    """The rows that one task groups must not grow with the table."""
    from siftline.plans.graph_queries import edge_rows
    from siftline.sources.tables import parts_for

    rows = edge_rows(spark, "/root/testdata/sf0.001").cache()
    edges, nodes = graph.graph_edges(rows, 40), graph.graph_nodes(graph.graph_edges(rows), 40)
    assert edges.rdd.getNumPartitions() == nodes.rdd.getNumPartitions() == 40
    assert sorted(map(str, edges.collect())) == sorted(map(str, graph.graph_edges(rows).collect()))
    assert sorted(map(str, graph.graph_summary(rows, 40, edges).collect())) == sorted(map(str, graph.graph_summary(rows).collect()))
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert parts_for(docs, 100_000) > parts_for(docs, 1_000_000) >= 8


def test_all_names_of_an_element_are_mentioned(spark, tmp_path):
    """GRF-06 takes no first 32; its SQL does not either."""
    import duckdb
    from oracle import spark_rows, sql_rows

    from siftline import catalog

    text = " ".join(f"Name{i}" for i in range(90)) + " Name3 uses Late_1\nAn other line"
    spark.createDataFrame([(1, text, "en", "a", len(text)), (2, "Few Names", "en", "a", 9)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns, got = spark_rows(catalog.queries()["GRF-06"](spark, str(tmp_path)))
    assert (columns, got) == sql_rows(connection, catalog.oracle_sql()["GRF-06"])
    mentioned = {dict(zip(columns, row, strict=True))["target"] for row in got if "mentions" in row}
    assert {f"e:name{i}" for i in range(90)} | {"e:late_1"} <= mentioned
