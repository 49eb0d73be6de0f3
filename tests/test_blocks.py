"""Pairs of blocks that meet, however many tasks the groups are dealt over."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import cells, graph, ranking
from siftline.operators.vectors import block_pairs, sparse_block_scores


@pytest.fixture
def spread(spark):
    """Groups stay dealt over all shuffle partitions."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def test_every_query_meets_every_vector(spread):
    rng = np.random.default_rng(5)
    vectors = spread.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    assert block_pairs(vectors.where("vec_id % 4 = 0"), vectors, 8).count() == 15 * 60


def test_every_question_meets_every_chunk(spread):
    chunks = spread.createDataFrame([(f"c{i}", f"same word{i % 9}") for i in range(90)], "chunk_id string, text string")
    asked = spread.createDataFrame([(i, "same") for i in range(20)], "query_id long, question string")
    q = ranking.embedded(asked.select("query_id", F.col("question").alias("text")), "query_id")
    assert sparse_block_scores(q, ranking.embedded(chunks, "chunk_id"), None, 16).count() == 20 * 90
    index = cells.build_cells(ranking.embedded(chunks, "chunk_id"), block=4)
    assert cells.nearest(q, index, 50).count() == 20 * 50


def test_every_question_meets_every_automaton(spread, monkeypatch):
    monkeypatch.setattr(graph, "AUTOMATON", 3)
    monkeypatch.setattr(graph, "ASKED", 2)
    nodes = spread.createDataFrame([(f"l{i:02d}",) for i in range(30)], "label string")
    asked = spread.createDataFrame([(i, f"xl{i:02d}y l29") for i in range(12)], "query_id long, question string")
    assert graph.labels_inside(asked, nodes).count() == 24
