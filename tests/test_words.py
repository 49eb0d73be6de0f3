"""Words of texts cut as arrays of bytes, against plain Python and against the regular expressions of the SQL function."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from oracle import spark_rows, sql_rows
from pyspark.sql import functions as F

from siftline import catalog
from siftline.functions import registered, words
from siftline.functions import text as tx
from siftline.operators import corpus

LOW = str.maketrans(tx.UPPER, tx.LOWER)


def plain(text):
    out = []
    for run in re.findall(r"[A-Za-z0-9_]+|[一-鿿]+", text):
        run = run.translate(LOW)
        if run in tx.STOPWORDS:
            continue
        if run[0] >= "一" and len(run) > 2:
            out += [p for p in (run[i : i + 2] for i in range(len(run) - 1)) if p not in tx.STOPWORDS]
            out += [run] if len(run) <= 6 else []
        else:
            out.append(run)
    return out


def texts(seed):
    rng = random.Random(seed)
    signs = "aZ_9 \n.é䷿一鿿ꀀİ\x01\U0001f600幂等键缺" + "".join(tx.STOPWORDS)
    some = ["".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 2, 3, 5, 20, 200]))) for _ in range(40)]
    return [None, "", *some, *(" ".join(rng.choice(tx.STOPWORDS) for _ in range(5)) for _ in range(5)), "有没有", "没有没有", "a" * 900, None]


@pytest.mark.parametrize("seed", range(20))
def test_splitter_equals_plain_words(seed, monkeypatch):
    monkeypatch.setattr(words, "SLICE", 300)  # many slices, some of a single text
    given = texts(seed)
    want = [None if t is None else plain(t) for t in given]
    split, count = words.splitter(tx.STOPWORDS), words.splitter(tx.STOPWORDS, counts=True)
    assert split(pa.array(given)).to_pylist() == want
    assert split(pa.array(["before", *given])[1:]).to_pylist() == want
    assert split(pa.array([], pa.string())).to_pylist() == [] and split(pa.array([None], pa.string())).to_pylist() == [None]
    got = count(pa.array(given)).to_pylist()
    assert [None if r is None else (r["len"], sorted((w["token"], w["tf"]) for w in r["words"])) for r in got] == [None if w is None else (len(w), sorted(Counter(w).items())) for w in want]


def test_words_equal_the_sql_function_and_need_no_expression_search(spark):
    rows = spark.createDataFrame(list(enumerate(texts(99))), "id int, text string")
    registered.register(spark)
    both = rows.select("id", tx.tokenize(F.col("text")).alias("a"), F.expr("siftline_tokens(text)").alias("b"))
    assert all(r.a == r.b for r in both.collect())
    plan = rows.select(tx.tokenize(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp" not in plan


def test_words_of_a_corpus_are_counted_by_batches(spark):
    texts = ["b a a", "a", "", None] + ["c d"] * 500
    chunks = spark.createDataFrame([(f"{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string").coalesce(1)
    assert {r.token: (r.df, r.occurrences, r.n, r.avg_len) for r in corpus.corpus_statistics(chunks).collect()} == {
        "a": (2, 3, 504, 1004 / 504), "b": (1, 1, 504, 1004 / 504), "c": (500, 500, 504, 1004 / 504), "d": (500, 500, 504, 1004 / 504),
    }
    assert corpus.batch_counts(chunks).where("token = 'c'").count() == 1


def with_aliases(text):
    out = plain(text)
    for phrase, aliases in tx.ALIASES.items():
        if phrase in text:
            out += [t for t in dict.fromkeys(w for a in aliases for w in plain(a)) if t not in out]
    return out


@pytest.mark.parametrize("seed", range(10))
def test_terms_of_phrases_stand_behind_the_words_that_lack_them(seed, monkeypatch):
    monkeypatch.setattr(words, "SLICE", 300)
    rng = random.Random(seed)
    signs = [*tx.ALIASES, "幂等", "等键", "幂等键", "幂", "键", " ", " ", "a", "B_1", "的", "é", "等"]
    given = [None, "", "重复提交", *("".join(rng.choice(signs) for _ in range(rng.choice([1, 2, 3, 5, 9, 150]))) for _ in range(80)), None]
    split = words.splitter(tx.STOPWORDS, added=tx.alias_words())
    assert split(pa.array(given)).to_pylist() == [None if t is None else with_aliases(t) for t in given]
    # Terms that differ are added one after the other, also to a text without words of its own.
    two = words.splitter((*tx.STOPWORDS, "甲"), added=((("甲", "z"), ("x", "y")), (("甲",), ("y", "w"))))
    assert two(pa.array(["甲", "甲 y", "z w", "q", "的", None])).to_pylist() == [["x", "y", "w"], ["y", "x", "w"], ["z", "w", "x", "y"], ["q"], [], None]


def test_retrieval_tokens_are_finished_in_the_batch_and_equal_the_sql(spark, tmp_path):
    rows = [(0, None), (1, None), (2, None), (3, ""), (4, "幂等 a"), (5, "重复提交 B"), (6, "İK ſ"), (8, "x"), (9, "等键 重复投递 重复提交"), (None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'a' AS source", "1L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.queries()["TXT-03"](spark, str(tmp_path))
    assert spark_rows(got) == sql_rows(connection, catalog.oracle_sql()["TXT-03"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "array_except" not in plan and "lower(" not in plan
