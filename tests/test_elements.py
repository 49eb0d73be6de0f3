"""Operators that SQL cannot express against plain Python, and fixed examples of paths, relations and rows that are awkward."""

import json

import pytest
from pyspark.sql import functions as F

from siftline.operators import answers, elements, graph, hooks, records
from siftline.sources import readers


def by_document(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["n"])):
        out.setdefault(r["doc_id"], []).append(r)
    return out


@pytest.fixture(scope="module")
def typed(spark, sf):
    from siftline.plans.element_queries import typed as build

    return build(spark, sf).cache()


def packed(items, size=520, overlap=90):
    out, current = [], ""
    for e in items:
        if e["kind"] in ("image", "table", "equation", "code") or len(e["text"]) > size:
            out += [current] if current else []
            current = ""
            text = e["text"]
            if e["kind"] in ("image", "table", "equation", "code"):
                out.append(text)
            else:
                starts = [0]
                while starts[-1] + size < len(text):
                    starts.append(starts[-1] + size - overlap)
                out += [text[s : s + size] for s in starts]
        elif not current or len(current) + 2 + len(e["text"]) <= size:
            current = f"{current}\n\n{e['text']}" if current else e["text"]
        else:
            out.append(current)
            current = f"{current[-overlap:]}\n\n{e['text']}"
    return out + ([current] if current else [])


def test_chunks(typed):
    want = {(d, i): t for d, items in by_document(typed.collect()).items() for i, t in enumerate(packed(items))}
    assert {(r["doc_id"], r["chunk_index"]): r["text"] for r in elements.split_chunks(typed).collect()} == want


def around(items, target, most):
    if target["page"] is None:
        near = [e for e in items if abs(e["n"] - target["n"]) <= 4]
    else:
        near = [e for e in items if e["page"] is not None and abs(e["page"] - target["page"]) <= 1]
    used, chosen = 0, []
    for e in sorted(near, key=lambda e: (abs(e["n"] - target["n"]), e["n"])):
        left = most - used - (2 if chosen else 0)
        text = e["text"][: max(left, 0)] if e["n"] == target["n"] else e["text"]
        if left > 0 and len(text) <= left:
            used += len(text) + (2 if chosen else 0)
            chosen.append(e["n"])
    return sorted(chosen), used


@pytest.mark.parametrize("most", [300, 2000])
def test_context(typed, most):
    got = {(r["doc_id"], r["n"]): (r["members"], r["chars"]) for r in elements.element_context(typed, max_chars=most).collect()}
    assert got == {(d, t["n"]): around(items, t, most) for d, items in by_document(typed.collect()).items() for t in items}


def test_heading_paths(spark):
    text = "### c\n\nx\n\n# a\n\n### b\n\n## d\n\ny\n\n\n#no\n\n###### e"
    rows = elements.text_elements(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("n").collect()
    assert [(r["text"], r["heading_path"]) for r in rows] == [
        ("### c", ["c"]), ("x", ["c"]), ("# a", ["a"]), ("### b", ["a", "b"]), ("## d", ["a", "d"]), ("y", ["a", "d"]), ("#no", ["a", "d"]), ("###### e", ["a", "d", "e"]),
    ]


def test_relations(spark):
    rows = spark.createDataFrame([(1, "Alpha depends  on Beta. Beta USES Gamma-1, x"), (2, "数据库支持索引。系统包含模块，其他")], "doc_id long, text string")
    got = {(r["source"], r["relation"], r["target"]) for r in graph.relations_en(rows, ["doc_id"]).collect()}
    assert got == {("Alpha", "depends_on", "Beta."), ("Beta", "uses", "Gamma-1")} or got == {("Alpha", "depends_on", "Beta"), ("Beta", "uses", "Gamma-1")}
    got = {(r["source"], r["relation"], r["target"]) for r in graph.relations_zh(rows, ["doc_id"]).collect()}
    assert got == {("数据库", "supports", "索引"), ("系统", "contains_explicit", "模块")}


def test_paths(spark):
    pairs = spark.createDataFrame([("a", "d"), ("a", "c"), ("a", "z")], "source string, target string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("c", "b", 0.5), ("c", "d", 1.0), ("a", "a", 1.0)], "a string, b string, confidence double")
    got = {r["target"]: (r["path"], r["score"]) for r in graph.bounded_paths(pairs, edges, 3).collect()}
    assert got == {"c": (["a", "b", "c"], 0.75), "d": (["a", "b", "c", "d"], 0.833333)}
    assert {r["target"] for r in graph.bounded_paths(pairs, edges, 2).collect()} == {"c"}


def test_sentences(spark):
    text = "答案：\n1.5 metres is long. [1] [2, 3] Next one is fine![4]\nshort.\n第一句很长很长很长。尾巴没有结束的句子"
    got = spark.createDataFrame([(text,)], "t string").select(answers.sentences(F.col("t"))).first()[0]
    assert got == ["1.5 metres is long. [1] [2, 3]", "Next one is fine![4]", "第一句很长很长很长。", "尾巴没有结束的句子"]


def test_audit_without_citations(spark):
    rows = spark.createDataFrame([(1, "A claim without marker."), (2, ""), (3, None)], "query_id long, answer string")
    none = spark.createDataFrame([], "query_id long, rank int, file_name string, text string, score double")
    got = {r["query_id"]: (r["n_sentences"], r["supported"], r["coverage"], r["trust"]) for r in answers.audit_citations(rows, none).collect()}
    assert got == {1: (1, 0, 0.0, "unknown"), 2: (0, 0, 0.0, "unknown"), 3: (0, 0, 0.0, "unknown")}


def test_hooks_report_failures(spark):
    rows = spark.createDataFrame([(1, "q", "a\nb"), (2, "q", "no evidence")], "query_id long, question string, template string")

    def fails(question, template):
        raise OSError("down")

    assert {(r["query_id"], r["answer"], r["fallback"]) for r in hooks.generate_with(rows, fails).collect()} == {(1, "a\nb", "OSError: down"), (2, "no evidence", "OSError: down")}
    misses = spark.createDataFrame([("k", "x" * 9)], "key string, text string")
    assert hooks.enrich_with(misses, lambda f: json.dumps(f), {"text": 4}).first()["payload"] == '{"text": "xxxx"}'


def test_sources(spark, sf, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one\r\n\n\n\ntwo ")
    (tmp_path / "sub" / "b.md").write_text("x" * 100)
    (tmp_path / "c.bin").write_text("no")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.scan_text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "one\n\ntwo", "b.md": "x" * 100}
    found = {r["path"]: (r["bytes"], r["failure"], r["sha256"] is None) for r in readers.discover_directory(spark, str(tmp_path), "*.{txt,md,bin}", 2, 50).collect()}
    assert found == {"a.txt": ((tmp_path / "a.txt").stat().st_size, None, False), "c.bin": (2, None, False), "sub/b.md": (100, "too_large", True)}


def test_public_metadata_keeps_order_of_nothing_private(spark):
    row = spark.sql("SELECT map('File_Path', 'x', 'lang', 'en') AS m").select(records.public_metadata(F.col("m"))).first()[0]
    assert row == {"lang": "en"}


def test_chunks_of_a_document_of_100_000_elements(spark):
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("n"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("element_id"), F.when(F.col("id") % 50 == 7, "table").otherwise("text").alias("kind"), F.format_string("text of element %06d", "id").alias("text"), (F.col("id") / 100).cast("int").alias("page"), F.array(F.lit("h")).alias("heading_path"))
    chunks = elements.split_chunks(rows.repartition(5)).collect()
    chunks.sort(key=lambda r: r.chunk_index)
    assert [c.chunk_index for c in chunks] == list(range(len(chunks))) and all(len(c.text) <= 520 for c in chunks)
    order = list(dict.fromkeys(e for c in chunks for e in c.element_ids))
    assert order == [f"e{i}" for i in range(100_000)] and sum(c.modality == "table" for c in chunks) == 2000
    assert elements.split_chunks(rows.limit(0)).count() == 0
