"""Typed elements of documents: splitting, heading paths, chunks, rendering, enrichment, quality."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import text as tx

HEADING = r"^(#{1,6})\s+([^\n]+)$"


def text_elements(docs: DataFrame) -> DataFrame:
    """doc_id, n, element_id, level (0: no heading), text and heading_path of blocks between blank lines.

    A heading cuts the path to its level and adds its title. Its depth is the least of level + headings since,
    over all headings so far, so running windows find it and no document is folded in one row.
    """
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    rows = docs.select("doc_id", F.posexplode(parts).alias("n", "text")).withColumn("level", F.length(F.regexp_extract("text", HEADING, 1)))
    so_far = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("level") > 0
    rows = rows.withColumn("i", F.sum(heading.cast("int")).over(so_far))
    rows = rows.withColumn("depth", F.when(heading, F.col("i") + F.least(F.lit(0), F.min(F.when(heading, F.col("level") - F.col("i"))).over(so_far))))
    title = F.regexp_extract("text", HEADING, 2)
    entries = [F.when(F.last("depth", True).over(so_far) >= k, F.last(F.when(F.col("depth") == k, title), True).over(so_far)) for k in range(1, 7)]
    element_id = F.concat_ws(":element:", F.col("doc_id").cast("string"), F.col("n").cast("string"))
    return rows.select("doc_id", "n", element_id.alias("element_id"), "level", "text", F.array_compact(F.array(*entries)).alias("heading_path"))


def prefix_headings(text: Column, path: Column) -> Column:
    """The path in front of the text, unless every heading occurs in it."""
    there = F.forall(path, lambda h: F.contains(F.lower(text), F.lower(h)))
    return F.when(there, text).otherwise(F.concat(F.array_join(path, " > "), F.lit("\n\n"), text))


def rendered(path: Column, text: Column, caption: Column, footnotes: Column) -> Column:
    lines = F.array(
        F.array_join(path, " > "), F.coalesce(text, F.lit("")),
        F.when((caption != "") & (caption != text), F.concat(F.lit("Caption: "), caption)).otherwise(""),
        F.when(F.size(footnotes) > 0, F.concat(F.lit("Footnotes: "), F.array_join(footnotes, " "))).otherwise(""),
    )
    return F.trim(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def enriched_text(text: Column, description: Column, keywords: Column) -> Column:
    """Text, the description if absent from it, and up to 16 keywords."""
    words = F.array_join(F.slice(keywords, 1, 16), ", ")
    more = F.when((description != "") & ~F.contains(text, description), description)
    return F.concat_ws("\n", text, more, F.when(words != "", F.concat(F.lit("Keywords: "), words)))


def distinct_words(words: Column, limit: int) -> Column:
    """The first of the words that differ in case only, up to a limit."""

    def step(out: Column, w: Column) -> Column:
        known = (F.size(out) >= limit) | (F.trim(w) == "") | F.exists(out, lambda x: F.lower(x) == F.lower(w))
        return F.when(known, out).otherwise(F.array_append(out, w))

    return F.aggregate(words, F.array().cast("array<string>"), step)


def template_enrichment(elements: DataFrame) -> DataFrame:
    """Description, keywords, entities, confidence and warnings from doc_id, n, kind, text, caption, latex, rows (the cells of a table) and context (the text beside it)."""
    cells = F.flatten("rows")
    headers = F.coalesce(F.get("rows", F.lit(0)), F.array().cast("array<string>"))
    said = F.coalesce(F.nullif("caption", F.lit("")), F.nullif("text", F.lit("")), F.lit("an image without text"))
    near = F.coalesce("context", F.lit(""))
    words = F.when(F.col("kind") == "table", F.concat(headers, tx.tokenize(F.col("text")))).when(F.col("kind") == "equation", tx.tokenize(F.concat_ws(" ", "latex", near)))
    words = words.otherwise(tx.tokenize(F.concat_ws(" ", "caption", "text", near)))
    columns = F.coalesce(F.array_max(F.transform("rows", lambda r: F.size(r))), F.lit(0)).cast("string")
    table = F.concat(F.size("rows").cast("string"), F.lit(" x "), columns, F.lit(": "), F.array_join(headers, ", "))
    beside = F.when((near != "") & ~F.contains(said, near), F.concat(said, F.lit(". beside it: "), F.substring(near, 1, 500))).otherwise(said)
    description = F.when(F.col("kind") == "table", table).when(F.col("kind") == "equation", F.trim(F.concat(F.lit("formula: "), F.coalesce(F.nullif("latex", F.lit("")), "text")))).otherwise(beside)
    known = (F.col("text") != "") | (F.size(cells) > 0) | (F.coalesce("latex", F.lit("")) != "")
    found = elements.select("doc_id", "n", F.substring(description, 1, 2000).alias("description"), distinct_words(words, 16).alias("keywords"), F.when(known, 1.0).otherwise(0.4).alias("confidence"), F.when(known, F.array().cast("array<string>")).otherwise(F.array(F.lit("no text was found"))).alias("warnings"))
    return found.withColumn("entities", F.slice(F.filter("keywords", lambda w: F.regexp_like(w, F.lit(r"^[A-Za-z][A-Za-z0-9_.-]{1,40}$"))), 1, 8))


def validate_enrichment(payloads: DataFrame) -> DataFrame:
    """Trimmed and capped fields of a JSON payload; relations need an evidence span and have capped fields; confidences lie in 0 to 1; where another
    provider stood in, its names and a reason that tells nothing private."""
    relation = "struct<source: string, relation: string, target: string, evidence_span: string, confidence: double>"
    schema = f"description string, keywords array<string>, entities array<string>, warnings array<string>, confidence double, relationships array<{relation}>, fallback struct<`from`: string, `to`: string, reason: string>"
    p = payloads.withColumn("p", F.from_json("payload", schema))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.coalesce(c, F.lit(0.0)), F.lit(1.0)))
    text = lambda c, default, most: F.substring(F.coalesce(F.nullif(c, F.lit("")), F.lit(default)), 1, most)
    none = F.array().cast("array<string>")
    words = lambda c: F.filter(F.transform(F.coalesce(c, none), lambda w: F.trim(w)), lambda w: w != "")
    told = F.filter(F.coalesce("p.warnings", none), lambda w: F.trim(w) != "")
    good = F.filter("p.relationships", lambda r: F.trim(F.coalesce(r["evidence_span"], F.lit(""))) != "")
    cut = F.transform(good, lambda r: F.struct(text(r["source"], "", 160).alias("source"), text(r["relation"], "related_to", 80).alias("relation"), text(r["target"], "", 160).alias("target"), F.substring(r["evidence_span"], 1, 1000).alias("evidence_span"), unit(r["confidence"]).alias("confidence")))
    shown = F.transform(F.slice(F.coalesce(cut, F.array().cast(f"array<{relation}>")), 1, 32), lambda r: F.concat_ws("|", r["source"], r["relation"], r["target"], r["evidence_span"], r["confidence"].cast("string")))
    stood_in = F.when(F.col("p.fallback").isNotNull(), F.concat_ws("|", text(F.col("p.fallback.from"), "unknown", 80), text(F.col("p.fallback.to"), "template", 80), F.lit("the provider is away")))
    return p.select(
        "doc_id", F.substring(F.trim(F.coalesce("p.description", F.lit(""))), 1, 4000).alias("description"), F.slice(words("p.keywords"), 1, 32).alias("keywords"), F.slice(words("p.entities"), 1, 32).alias("entities"), unit(F.col("p.confidence")).alias("confidence"),
        shown.alias("relations"), F.slice(F.transform(told, lambda w: F.substring(w, 1, 300)), 1, 20).alias("warnings"), stood_in.alias("fallback"),
    )


def multimodal_quality(elements: DataFrame) -> DataFrame:
    """Shares of sound elements for each document; without any, a share is 1."""
    share = lambda good, all_: F.coalesce(F.round(F.try_divide(F.count_if(good), F.count_if(all_)), 4), F.lit(1.0))
    kind = lambda k: F.col("kind") == k
    widths = F.size(F.array_distinct(F.transform("rows", lambda r: F.size(r))))
    return elements.groupBy("doc_id").agg(
        *[F.count_if(kind(k)).alias(f"n_{k}") for k in ("text", "heading", "image", "table", "equation")],
        share(F.col("page").isNotNull() & (F.size("bbox") == 4), F.col("page").isNotNull()).alias("bbox_coverage"),
        F.round(F.avg(F.when(kind("image"), F.col("confidence"))), 4).alias("image_confidence"),
        share(kind("image") & (F.trim("caption") != ""), kind("image")).alias("caption_alignment"),
        share(kind("table") & (widths == 1), kind("table")).alias("table_structure"),
        share(kind("equation") & (F.trim("formula") != ""), kind("equation")).alias("formula_share"),
        F.count_if(kind("image") & (F.trim("caption") == "")).alias("orphan_assets"),
        F.coalesce(F.round(F.try_divide(F.count_if("in_graph"), F.count("*")), 4), F.lit(0.0)).alias("graph_coverage"),
    )


def element_context(elements: DataFrame, pages: int = 1, places: int = 4, max_chars: int = 8000) -> DataFrame:
    """Neighbours of each element (pages away, or places where there is no page), nearest first while they fit.

    A neighbour too long for what is left is skipped; the element itself is cut. Windows hold a few pages at most.
    """
    item = F.struct("n", "text")
    by_place = Window.partitionBy("doc_id").orderBy("n").rowsBetween(-places, places)
    by_page = Window.partitionBy("doc_id").orderBy("page").rangeBetween(-pages, pages)
    near = F.when(F.col("page").isNull(), F.collect_list(item).over(by_place)).otherwise(F.collect_list(F.when(F.col("page").isNotNull(), item)).over(by_page))
    rows = elements.withColumn("near", near)
    ordered = F.array_sort(F.transform("near", lambda e: F.struct(F.abs(e["n"] - F.col("n")).alias("d"), e["n"].alias("n"), e["text"].alias("text"))))
    empty = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<n: int, text: string>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        gap = F.when(F.size(acc["out"]) > 0, 2).otherwise(0)
        left = max_chars - acc["used"] - gap
        text = F.when(e["d"] == 0, e["text"].substr(F.lit(1), F.greatest(left, F.lit(0)))).otherwise(e["text"])
        fits = (left > 0) & (F.length(text) <= left) & (e["text"] != "")
        taken = F.array_append(acc["out"], F.struct(e["n"].alias("n"), text.alias("text")))
        return F.struct(F.when(fits, acc["used"] + gap + F.length(text)).otherwise(acc["used"]).alias("used"), F.when(fits, taken).otherwise(acc["out"]).alias("out"))

    chosen = F.array_sort(F.aggregate(ordered, empty, step, lambda acc: acc["out"]))
    rows = rows.select("doc_id", "n", chosen.alias("chosen"))
    text = F.array_join(F.transform("chosen", lambda e: e["text"]), "\n\n")
    return rows.select("doc_id", "n", F.transform("chosen", lambda e: e["n"]).alias("members"), F.md5(text).alias("text_md5"), F.length(text).alias("chars"), F.ceil(F.length(text) / 4).alias("tokens"), (F.length(text) >= max_chars).alias("truncated"))


def block_elements(specs: DataFrame) -> DataFrame:
    """Elements of a JSON block list (heading, paragraph, table); empty rows of cells and empty blocks go."""
    schema = "array<struct<type: string, level: int, text: string, rows: array<array<string>>>>"
    rows = specs.select("doc_id", F.posexplode(F.from_json(F.get_json_object("spec", "$.blocks"), schema)).alias("n", "b"))
    cells = F.filter("b.rows", lambda r: F.exists(r, lambda c: F.trim(c) != ""))
    body = F.array_join(F.transform(cells, lambda r: F.array_join(F.transform(r, lambda c: F.trim(c)), " | ")), "\n")
    text = F.when(F.col("b.type") == "table", body).when(F.col("b.type") == "heading", F.concat(F.repeat(F.lit("#"), F.col("b.level")), F.lit(" "), F.trim("b.text"))).otherwise(F.trim("b.text"))
    kind = F.when(F.col("b.type").isin("table", "heading"), F.col("b.type")).otherwise("text")
    out = rows.select("doc_id", "n", kind.alias("kind"), text.alias("text"), F.when(kind == "table", F.size(cells)).alias("n_rows"), F.when(kind == "table", F.array_max(F.transform(cells, lambda r: F.size(r)))).alias("n_columns"))
    return out.where("text <> ''")


def content_elements(lists: DataFrame) -> DataFrame:
    """Elements of a JSON content list: text (a heading at levels 1 to 6), image, table, equation, or else text."""
    schema = "array<struct<type: string, text: string, text_level: int, page_idx: int, bbox: array<double>, image_caption: array<string>, table_body: string, latex: string>>"
    rows = lists.select("doc_id", F.posexplode(F.from_json("content", schema)).alias("n", "b"))
    is_text = F.lower(F.coalesce("b.type", F.lit("text"))) == "text"
    level = F.coalesce("b.text_level", F.lit(0))
    kind = F.when(is_text & level.between(1, 6), "heading").when(F.col("b.type").isin("image", "table"), F.col("b.type")).when(F.col("b.type").isin("equation", "formula"), "equation").otherwise("text")
    page = F.col("b.page_idx") + 1
    caption = F.array_join("b.image_caption", " ")
    text = (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.trim("b.text")))
        .when(kind == "image", F.coalesce(F.nullif(caption, F.lit("")), F.concat(F.lit("image on page "), F.coalesce(page, F.lit(1)).cast("string"))))
        .when(kind == "table", F.trim("b.table_body")).when(kind == "equation", F.trim(F.coalesce("b.latex", "b.text"))).otherwise(F.trim("b.text"))
    )
    n_cells = F.when(kind == "table", F.size(F.split(F.regexp_replace("b.table_body", r"\n", "|"), r"\|")))
    return rows.select("doc_id", "n", kind.alias("kind"), text.alias("text"), page.alias("page"), (F.size("b.bbox") == 4).alias("has_bbox"), n_cells.alias("n_cells")).where("text <> ''")


_CHUNK = "chunk_index int, text string, element_ids array<string>, modality string, page int, heading_path array<string>"


def split_chunks(elements: DataFrame, size: int = 520, overlap: int = 90) -> DataFrame:
    """Chunks of a document's elements (doc_id, n, element_id, kind, text, page, heading_path), packed greedily in order.

    Images, tables, equations and code stand alone; a longer text is cut into windows; the rest is joined by
    blank lines while it fits, and a full chunk hands its last characters on. A chunk names its elements in order (and those
    whose end it was handed), its modality (mixed if theirs differ), their first page and their last heading path. Elements
    pass by in order, a batch at a time, with one open chunk as state, so that the work grows with a document and its memory does not.
    """
    kind = dict(elements.dtypes)["doc_id"]
    rows = elements.select("doc_id", F.col("element_id").cast("string"), "kind", "text", F.col("page").cast("int").alias("page"), F.col("heading_path").cast("array<string>").alias("heading_path"), "n")
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "n").drop("n")
    step = size - overlap

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        doc, index, now, began = None, 0, None, False

        def close() -> None:
            nonlocal index, now
            if now is not None and now[0] != "":
                give(now)
            now = None

        def give(c: tuple) -> None:
            nonlocal index
            out.append((doc, index, c[0], c[1], c[2][0] if len(c[2]) == 1 else "mixed", c[3], c[4]))
            index += 1

        def added(text: str, e: tuple) -> tuple:
            union = lambda old, x: old if x in old else [*old, x]
            return text, union(now[1], e[0]), union(now[2], e[1]), e[3] if now[3] is None else now[3], e[4]

        for batch in batches:
            for key, *e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not began or key != doc:
                    close()
                    doc, index, began = key, 0, True
                text = e[2] or ""
                own = lambda t, e=e: (t, [e[0]], [e[1]], e[3], e[4])
                if e[1] in ("image", "table", "equation", "code"):
                    close()
                    give(own(text))
                elif len(text) > size:
                    close()
                    for i in range(-(-(len(text) - size) // step) + 1):
                        give(own(text[i * step : i * step + size]))
                elif now is None or now[0] == "":
                    now = own(text)
                elif len(now[0]) + 2 + len(text) <= size:
                    now = added(f"{now[0]}\n\n{text}", e)
                else:
                    give(now)
                    now = added(f"{now[0][-overlap:]}\n\n{text}", e)
            if len(out) >= 4096:
                yield packed(out)
                out = []
        close()
        if out:
            yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.from_numpy_dtype("int64") if kind == "bigint" else pa.int32() if kind == "int" else pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.list_(pa.string())]
        names = ["doc_id", "chunk_index", "text", "element_ids", "modality", "page", "heading_path"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return rows.mapInArrow(pack, f"doc_id {kind}, {_CHUNK}")
