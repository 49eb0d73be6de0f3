"""Queries over typed elements, which the documents' lines give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.operators import elements as el
from siftline.plans.registry import query
from siftline.plans.sql import tok
from siftline.sources.tables import table

S = SparkSession
#: Lines that start with a short word become headings, whose level its first letter gives.
LEVELS = {"A-H": "#", "I-P": "##", "Q-Z": "###"}
_MD = "replace(text, chr(10), chr(10) || chr(10))"
for _letters, _marks in LEVELS.items():
    _MD = rf"regexp_replace({_MD}, '(^|\n)([{_letters}][a-z]{{0,3}} )', '\1{_marks} \2', 'g')"
KIND = "CASE WHEN level > 0 THEN 'heading' WHEN contains(text, ' | ') THEN 'table' WHEN n % 7 = 3 THEN 'image' WHEN n % 11 = 4 THEN 'equation' ELSE 'text' END"
PAGE = "CASE WHEN doc_id % 3 <> 0 THEN CAST(floor(n / 6) AS INT) + 1 END"

ELEMENTS = rf"""part AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({_MD}, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents),
lev AS (SELECT doc_id, (generate_subscripts(p, 1) - 1)::INT AS n, unnest(p) AS text, length(regexp_extract(unnest(p), '^(#{{1,6}})\s+[^\n]+$', 1)) AS level FROM part),
hd AS (SELECT doc_id, list(struct_pack(level := level, title := title, path := [title]) ORDER BY n) AS hs, list(n ORDER BY n) AS ns FROM (SELECT *, regexp_extract(text, '^#{{1,6}}\s+([^\n]+)$', 1) AS title FROM lev WHERE level > 0) GROUP BY 1),
hp AS (SELECT doc_id, ns[k] AS n, list_reduce(hs[1:k], lambda a, b: struct_pack(level := b.level, title := b.title, path := list_append(a.path[1:b.level - 1], b.title))).path AS path FROM (SELECT *, unnest(range(1, len(ns) + 1)) AS k FROM hd)),
el AS (SELECT doc_id, n, doc_id::VARCHAR || ':element:' || n AS element_id, level, text, coalesce(last_value(path IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n), []) AS heading_path FROM lev LEFT JOIN hp USING (doc_id, n)),
typed AS (SELECT *, {KIND} AS kind, {PAGE} AS page FROM el)"""
#: Typed elements without their paths, for queries that do not need them.
PLAIN = ELEMENTS.split("hd AS")[0] + f"typed AS (SELECT *, {KIND} AS kind, {PAGE} AS page FROM lev)"


def marked(spark: S, sf: str) -> DataFrame:
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    for letters, marks in LEVELS.items():
        text = F.regexp_replace(text, rf"(^|\n)([{letters}][a-z]{{0,3}} )", f"$1{marks} $2")
    return table(spark, sf, "documents").select("doc_id", text.alias("text"))


def typed(spark: S, sf: str) -> DataFrame:
    return el.text_elements(marked(spark, sf)).withColumn("kind", F.expr(KIND)).withColumn("page", F.expr(PAGE))


def cells(df: DataFrame) -> DataFrame:
    """One row of cells for a table."""
    return df.withColumn("rows", F.when(F.col("kind") == "table", F.array(F.split("text", r" \| "))).otherwise(F.array().cast("array<array<string>>")))


@query("TXT-05", f"WITH {ELEMENTS} SELECT * FROM el")
def txt05(spark: S, sf: str) -> DataFrame:
    return el.text_elements(marked(spark, sf))


@query("TXT-06", f"WITH {ELEMENTS} SELECT doc_id, n, text || CASE WHEN contains(text, lang) THEN '' ELSE chr(10) || lang END || CASE WHEN len(heading_path) > 0 THEN chr(10) || 'Keywords: ' || array_to_string(heading_path, ', ') ELSE '' END AS text FROM el JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)")
def txt06(spark: S, sf: str) -> DataFrame:
    """The language stands for a description, the headings for keywords."""
    rows = typed(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return rows.select("doc_id", "n", el.enriched_text(F.col("text"), F.col("lang"), F.col("heading_path")).alias("text"))


_MADE = lambda t, ids, kinds, page: f"struct_pack(text := {t}, element_ids := {ids}, kinds := {kinds}, page := {page}, heading_path := heading_path)"
_ALONE = _MADE("e.text", "[element_id]", "[kind]", "page::INT")
_UNION = lambda l, x: f"CASE WHEN list_contains(now.{l}, {x}) THEN now.{l} ELSE list_append(now.{l}, {x}) END"
_JOINED = lambda t: f"CASE WHEN now.text = '' THEN {_ALONE} ELSE {_MADE(t, _UNION('element_ids', 'element_id'), _UNION('kinds', 'kind'), 'coalesce(now.page, page::INT)')} END"
_NOTHING = "struct_pack(text := '', element_ids := []::VARCHAR[], kinds := []::VARCHAR[], page := NULL::INT, heading_path := []::VARCHAR[])"


@query("TXT-07", f"""WITH RECURSIVE {ELEMENTS}, e AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k, element_id, kind, text, page, heading_path FROM typed),
fold AS (SELECT doc_id, 0::BIGINT AS k, [{_NOTHING}][1:0] AS out, {_NOTHING} AS now FROM e GROUP BY doc_id
UNION ALL SELECT f.doc_id, e.k, CASE WHEN alone THEN list_append(flushed, {_ALONE}) WHEN length(e.text) > 520 THEN list_concat(flushed, list_transform(range(0, (ceil((length(e.text) - 520) / 430.0))::BIGINT + 1), lambda i: {_MADE('substr(e.text, (i * 430)::BIGINT + 1, 520)', '[element_id]', '[kind]', 'page::INT')}))
WHEN fits THEN f.out ELSE flushed END, CASE WHEN alone OR length(e.text) > 520 THEN {_NOTHING} WHEN fits THEN {_JOINED("now.text || chr(10) || chr(10) || e.text")} ELSE {_JOINED("right(now.text, 90) || chr(10) || chr(10) || e.text")} END
FROM (SELECT *, CASE WHEN now.text <> '' THEN list_append(out, now) ELSE out END AS flushed FROM fold) f JOIN (SELECT *, kind IN ('image', 'table', 'equation', 'code') AS alone FROM e) e ON f.doc_id = e.doc_id AND e.k = f.k + 1,
LATERAL (SELECT length(CASE WHEN now.text = '' THEN e.text ELSE now.text || chr(10) || chr(10) || e.text END) <= 520 AS fits)),
done AS (SELECT doc_id, CASE WHEN now.text <> '' THEN list_append(out, now) ELSE out END AS out FROM fold WHERE (doc_id, k) IN (SELECT doc_id, max(k) FROM e GROUP BY 1)),
c AS (SELECT doc_id, (generate_subscripts(out, 1) - 1)::INT AS chunk_index, unnest(out) AS c FROM done)
SELECT doc_id, chunk_index, c.text AS text, c.element_ids AS element_ids, CASE WHEN len(c.kinds) = 1 THEN c.kinds[1] ELSE 'mixed' END AS modality, c.page AS page, c.heading_path AS heading_path FROM c""")
def txt07(spark: S, sf: str) -> DataFrame:
    return el.split_chunks(typed(spark, sf))


@query("TXT-09", f"WITH {ELEMENTS} SELECT doc_id, n, CASE WHEN len(list_filter(heading_path, lambda h: NOT contains(lower(text), lower(h)))) = 0 THEN text ELSE array_to_string(heading_path, ' > ') || chr(10) || chr(10) || text END AS text FROM el")
def txt09(spark: S, sf: str) -> DataFrame:
    return typed(spark, sf).select("doc_id", "n", el.prefix_headings(F.col("text"), F.col("heading_path")).alias("text"))


@query("TXT-30", f"""WITH {ELEMENTS} SELECT doc_id, n, CASE WHEN len(heading_path) > 0 THEN array_to_string(heading_path, ' > ') || chr(10) ELSE '' END || text || CASE WHEN kind = 'image' THEN chr(10) || 'Caption: image ' || n ELSE '' END
|| CASE WHEN kind = 'table' THEN chr(10) || 'Footnotes: p ' || coalesce(page, 0) ELSE '' END AS text FROM typed""")
def txt30(spark: S, sf: str) -> DataFrame:
    caption = F.when(F.col("kind") == "image", F.concat(F.lit("image "), F.col("n").cast("string"))).otherwise("")
    notes = F.when(F.col("kind") == "table", F.array(F.lit("p"), F.coalesce("page", F.lit(0)).cast("string"))).otherwise(F.array().cast("array<string>"))
    return typed(spark, sf).select("doc_id", "n", el.rendered(F.col("heading_path"), F.col("text"), caption, notes).alias("text"))


#: Each third element has a caption, each image but every fourth loses its text, formulas have one of their own, and the text before stands beside.
_RICH = f"""rich AS (SELECT doc_id, n, kind, CASE WHEN kind = 'image' AND n % 4 <> 0 THEN '' ELSE text END AS text, CASE WHEN n % 3 = 0 THEN 'Caption ' || n ELSE '' END AS caption, CASE WHEN kind = 'equation' AND n % 2 = 0 THEN 'x_' || n || ' = y' ELSE '' END AS latex,
coalesce(lag(text) OVER (PARTITION BY doc_id ORDER BY n), '') AS context FROM typed)"""
_SAID = "coalesce(nullif(caption, ''), nullif(text, ''), 'an image without text')"
_WORDS = f"CASE kind WHEN 'table' THEN list_concat(string_split(text, ' | '), {tok('text')}) WHEN 'equation' THEN {tok("latex || ' ' || context")} ELSE {tok("caption || ' ' || text || ' ' || context")} END"


def rich(spark: S, sf: str) -> DataFrame:
    before = F.coalesce(F.lag("text").over(Window.partitionBy("doc_id").orderBy("n")), F.lit(""))
    rows = cells(typed(spark, sf)).withColumn("context", before)
    rows = rows.withColumn("caption", F.when(F.col("n") % 3 == 0, F.concat(F.lit("Caption "), F.col("n").cast("string"))).otherwise("")).withColumn("latex", F.when((F.col("kind") == "equation") & (F.col("n") % 2 == 0), F.format_string("x_%d = y", "n")).otherwise(""))
    return rows.withColumn("text", F.when((F.col("kind") == "image") & (F.col("n") % 4 != 0), "").otherwise(F.col("text")))


@query("TXT-24", rf"""WITH {PLAIN}, {_RICH}, w AS (SELECT *, {_WORDS} AS w FROM rich), k AS (SELECT *, list_transform(w, lambda x: lower(x)) AS l FROM w),
d AS (SELECT *, list_filter(w, lambda x, i: trim(x) <> '' AND list_position(l, lower(x)) = i)[1:16] AS keywords FROM k)
SELECT doc_id, n, substr(CASE kind WHEN 'table' THEN '1 x ' || len(string_split(text, ' | ')) || ': ' || array_to_string(string_split(text, ' | '), ', ') WHEN 'equation' THEN trim('formula: ' || coalesce(nullif(latex, ''), text))
ELSE {_SAID} || CASE WHEN context <> '' AND NOT contains({_SAID}, context) THEN '. beside it: ' || substr(context, 1, 500) ELSE '' END END, 1, 2000) AS description,
keywords, CASE WHEN text <> '' OR latex <> '' THEN 1.0 ELSE 0.4 END::DOUBLE AS confidence, CASE WHEN text <> '' OR latex <> '' THEN [] ELSE ['no text was found'] END AS warnings, list_filter(keywords, lambda x: regexp_full_match(x, '[A-Za-z][A-Za-z0-9_.-]{{1,40}}'))[1:8] AS entities FROM d""")
def txt24(spark: S, sf: str) -> DataFrame:
    return el.template_enrichment(rich(spark, sf))


_PAYLOAD = """'{"description": "  about ' || source || ' ", "keywords": ["' || lang || '", "  ", " ' || source || '"], "entities": [" E' || doc_id || ' ", ""], "warnings": ["' || repeat('w', 299 + (doc_id % 3)::INT) || '", " "], "confidence": ' || ((doc_id % 7 - 2) * 0.5) || ', "relationships": [{"source": "a' || repeat('s', (100 + doc_id % 90)::INT) || '", "relation": "", "target": "b", "evidence_span": "' || CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE ' ' END || '", "confidence": ' || (doc_id % 3) || '}]' || CASE WHEN doc_id % 5 = 0 THEN ', "fallback": {"from": "vision", "reason": "/private/path"}' ELSE '' END || '}'"""


@query("TXT-25", """SELECT doc_id, 'about ' || source AS description, [lang, source] AS keywords, ['E' || doc_id] AS entities, [repeat('w', least(300, 299 + doc_id % 3))] AS warnings, greatest(0, least(1, (doc_id % 7 - 2) * 0.5))::DOUBLE AS confidence,
CASE WHEN doc_id % 2 = 0 THEN [substr('a' || repeat('s', 100 + doc_id % 90), 1, 160) || '|related_to|b|x|' || CASE WHEN doc_id % 3 = 0 THEN '0.0' ELSE '1.0' END] ELSE [] END AS relations, CASE WHEN doc_id % 5 = 0 THEN 'vision|template|the provider is away' END AS fallback FROM documents""")
def txt25(spark: S, sf: str) -> DataFrame:
    return el.validate_enrichment(table(spark, sf, "documents").select("doc_id", F.expr(_PAYLOAD).alias("payload")))


@query("AGG-05", f"""WITH {PLAIN}, r AS (SELECT *, page IS NOT NULL AND n % 2 = 0 AS box, kind = 'image' AND n % 3 = 0 AS cap FROM typed)
SELECT doc_id, count(*) FILTER (WHERE kind = 'text') AS n_text, count(*) FILTER (WHERE kind = 'heading') AS n_heading, count(*) FILTER (WHERE kind = 'image') AS n_image, count(*) FILTER (WHERE kind = 'table') AS n_table, count(*) FILTER (WHERE kind = 'equation') AS n_equation,
coalesce(round(count(*) FILTER (WHERE box) / nullif(count(page), 0), 4), 1.0)::DOUBLE AS bbox_coverage, round(avg((n % 10) / 10.0) FILTER (WHERE kind = 'image'), 4)::DOUBLE AS image_confidence,
coalesce(round(count(*) FILTER (WHERE cap) / nullif(count(*) FILTER (WHERE kind = 'image'), 0), 4), 1.0)::DOUBLE AS caption_alignment, 1.0::DOUBLE AS table_structure, coalesce(round(count(*) FILTER (WHERE kind = 'equation' AND n % 4 <> 0) / nullif(count(*) FILTER (WHERE kind = 'equation'), 0), 4), 1.0)::DOUBLE AS formula_share,
count(*) FILTER (WHERE kind = 'image' AND NOT cap) AS orphan_assets, round(count(*) FILTER (WHERE n % 5 <> 0) / count(*), 4)::DOUBLE AS graph_coverage FROM r GROUP BY 1""")
def agg05(spark: S, sf: str) -> DataFrame:
    rows = cells(typed(spark, sf)).withColumn("confidence", (F.col("n") % 10) / 10)
    bbox = F.when(F.col("page").isNotNull() & (F.col("n") % 2 == 0), F.array(*[F.lit(float(i)) for i in range(4)])).otherwise(F.array().cast("array<double>"))
    rows = rows.withColumn("formula", F.when(F.col("n") % 4 != 0, F.col("text")).otherwise("")).withColumn("in_graph", F.col("n") % 5 != 0)
    return el.multimodal_quality(rows.withColumn("bbox", bbox).withColumn("caption", F.when(F.col("n") % 3 == 0, F.col("text")).otherwise("")))


_LEFT = "(2000 - a.used - CASE WHEN len(a.out) > 0 THEN 2 ELSE 0 END)"
_SHOWN = f"CASE WHEN e.d = 0 THEN substr(e.text, 1, greatest({_LEFT}, 0)) ELSE e.text END"
_FITS = f"({_LEFT} > 0 AND length({_SHOWN}) <= {_LEFT} AND e.text <> '')"
_BLANK = "[]::STRUCT(n INT, text VARCHAR)[]"


@query("WIN-02", f"""WITH {ELEMENTS}, near AS (SELECT doc_id, n, CASE WHEN page IS NULL THEN list(struct_pack(n := n, text := text)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) ELSE list(struct_pack(n := n, text := text)) OVER (PARTITION BY doc_id ORDER BY page RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS l FROM typed),
o AS (SELECT doc_id, n, list_transform(list_sort(list_transform(l, lambda e: struct_pack(d := abs(e.n - n), n := e.n, text := e.text))), lambda e: struct_pack(d := e.d::INT, n := e.n, text := e.text, used := 0, out := {_BLANK})) AS l FROM near),
r AS (SELECT doc_id, n, list_reduce(list_concat([struct_pack(d := 0, n := 0, text := '', used := 0, out := {_BLANK})], l), lambda a, e: struct_pack(d := 0, n := 0, text := '',
used := (CASE WHEN {_FITS} THEN a.used + CASE WHEN len(a.out) > 0 THEN 2 ELSE 0 END + length({_SHOWN}) ELSE a.used END)::INT, out := CASE WHEN {_FITS} THEN list_append(a.out, struct_pack(n := e.n, text := {_SHOWN})) ELSE a.out END)).out AS c FROM o),
t AS (SELECT doc_id, n, list_transform(list_sort(c), lambda e: e.n) AS members, array_to_string(list_transform(list_sort(c), lambda e: e.text), chr(10) || chr(10)) AS text FROM r)
SELECT doc_id, n, members, md5(text) AS text_md5, length(text) AS chars, ceil(length(text) / 4)::BIGINT AS tokens, length(text) >= 2000 AS truncated FROM t""")
def win02(spark: S, sf: str) -> DataFrame:
    return el.element_context(typed(spark, sf), max_chars=2000)


@query("SRC-09", """WITH b AS (SELECT doc_id, unnest([0, 1, 2])::INT AS n, lang, source FROM documents) SELECT doc_id, n, CASE n WHEN 0 THEN 'heading' WHEN 1 THEN 'text' ELSE 'table' END AS kind,
CASE n WHEN 0 THEN '## ' || source WHEN 1 THEN lang ELSE 'id | lang' || chr(10) || doc_id || ' | ' || lang END AS text, CASE WHEN n = 2 THEN 2 END AS n_rows, CASE WHEN n = 2 THEN 2 END AS n_columns FROM b""")
def src09(spark: S, sf: str) -> DataFrame:
    spec = """'{"blocks": [{"type": "heading", "level": 2, "text": " ' || source || '"}, {"type": "paragraph", "text": "' || lang || ' "}, {"type": "table", "rows": [["id", " lang"], [" ", ""], ["' || doc_id || '", "' || lang || '"]]}, {"type": "paragraph", "text": " "}]}'"""
    return el.block_elements(table(spark, sf, "documents").select("doc_id", F.expr(spec).alias("spec")))


@query("SRC-08", """WITH b AS (SELECT doc_id, unnest(range(0, 6))::INT AS n, lang, source FROM documents)
SELECT doc_id, n, ['heading', 'text', 'image', 'image', 'table', 'equation'][n + 1] AS kind, CASE n WHEN 0 THEN '# ' || source WHEN 1 THEN lang WHEN 2 THEN 'cap ' || lang WHEN 3 THEN 'image on page ' || (doc_id % 5 + 1) WHEN 4 THEN 'a|b' || chr(10) || '1|' || lang ELSE 'x=' || doc_id END AS text,
CASE WHEN n = 3 THEN doc_id % 5 + 1 WHEN n < 2 THEN 1 END AS page, n = 2 AS has_bbox, CASE WHEN n = 4 THEN 4 END AS n_cells FROM b""")
def src08(spark: S, sf: str) -> DataFrame:
    content = (
        """'[{"type": "text", "text": "' || source || '", "text_level": 1, "page_idx": 0}, {"type": "text", "text": " ' || lang || '", "page_idx": 0}, {"type": "image", "image_caption": ["cap", "' || lang || '"], "bbox": [0, 1, 2, 3]}, """
        """{"type": "image", "page_idx": ' || (doc_id % 5) || ', "bbox": [1]}, {"type": "table", "table_body": "a|b\\\\n1|' || lang || '"}, {"type": "formula", "latex": "x=' || doc_id || '"}, {"type": "other", "text": " "}]'"""
    )
    rows = el.content_elements(table(spark, sf, "documents").select("doc_id", F.expr(content).alias("content")))
    return rows.withColumn("has_bbox", F.coalesce("has_bbox", F.lit(False)))
