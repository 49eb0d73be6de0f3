import pandas as pd

from siftline.operators import hooks


def test_embed_with_keeps_failed_batches_as_rows(spark):
    def embed(texts):
        if "bad" in texts:
            raise RuntimeError("no model")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in hooks.embed_with(rows, "doc_id", embed, batch_size=1).collect()}
    assert got[1].embedding == [1.0] and got[3].embedding == [0.0] and got[2].embedding is None and "no model" in got[2].error


def test_mmr_prefers_new_words(spark):
    rows = [(1, "a", 0.9, ["x", "y"]), (1, "b", 0.89, ["x", "y"]), (1, "c", 0.7, ["z"])]
    got = hooks.mmr_select(spark.createDataFrame(rows, "query_id long, chunk_id string, score double, tokens array<string>"), 0.5)
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == ["a", "c", "b"]


def test_rerank_with_mixes_scores(spark):
    rows = spark.createDataFrame([(1, "a", 0.5, "q", "t"), (1, "b", 0.4, "q", "q t")], "query_id long, chunk_id string, score double, question string, text string")
    got = hooks.rerank_with(rows, lambda q, t: pd.Series([float(a in b) for a, b in zip(q, t, strict=True)]))
    assert [(r.chunk_id, r.status) for r in got.orderBy("rerank").collect()] == [("b", "success"), ("a", "success")]


def test_rerank_with_falls_back_for_the_question_that_fails(spark):
    rows = [(q, c, s, f"q{q}", t) for q in (1, 2, 3) for c, s, t in (("a", 0.5, "x"), ("b", 0.4, "y"))]
    ranked = spark.createDataFrame(rows, "query_id long, chunk_id string, score double, question string, text string")

    def scorer(asked, texts):
        if asked.iloc[0] == "q2":
            raise RuntimeError("away")
        return pd.Series([float("nan") if asked.iloc[0] == "q3" else float(t == "y") for t in texts])

    got = {(r.query_id, r.rerank): (r.chunk_id, r.status, r.error) for r in hooks.rerank_with(ranked, scorer).collect()}
    assert got[1, 1] == ("b", "success", None) and got[2, 1] == ("a", "fallback", "RuntimeError: away") and got[3, 1][:2] == ("a", "fallback")
    off = {(r.query_id, r.rerank): (r.chunk_id, r.status) for r in hooks.rerank_with(ranked, None).collect()}
    assert off[1, 1] == ("a", "disabled") and len(off) == 6
