"""Queries over sources with a format of their own; the given tables supply their contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import records
from siftline.plans import more_queries, text_queries  # noqa: F401  whose SQL is used here
from siftline.plans.registry import ORACLES, query
from siftline.sources import readers
from siftline.sources.tables import table
from siftline.sources.scratch import fresh_path

S = SparkSession


@query("SRC-02", "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS flat FROM documents")
def src02(spark: S, sf: str) -> DataFrame:
    """The documents as text files (up to 1,000 to a file, a line each) in the shared folder, read back whole."""
    path = f"{fresh_path(spark, 'files')}/texts"
    flat = F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " "))
    table(spark, sf, "documents").select(F.concat_ws("\t", F.col("doc_id").cast("string"), flat).alias("value")).write.option("maxRecordsPerFile", 1000).text(path)
    lines = readers.scan_text_files(spark, path).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.select(F.regexp_extract("line", r"^([0-9]+)", 1).cast("long").alias("doc_id"), F.regexp_replace("line", r"^[0-9]+\s?", "").alias("flat"))


@query("SRC-04", "SELECT doc_id::VARCHAR AS path, sha256(text) AS sha256 FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def src04(spark: S, sf: str) -> DataFrame:
    """The manifest holds the good documents; toxic ones have changed since."""
    files = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id", "toxic")
    manifest = files.join(good, "doc_id").select("path", F.when(F.col("toxic") == 1, "old").otherwise(F.col("sha256")).alias("sha256"))
    return readers.incremental_manifest(files.drop("doc_id"), manifest)


@query("SRC-06", "SELECT page_id AS feed_id, CASE page_id % 4 WHEN 1 THEN 'page ' || page_id ELSE 'Page ' || page_id END AS title, trim(url) AS url, CASE WHEN page_id % 4 = 2 THEN trim(url) ELSE 'id-' || page_id END AS external_id FROM pages WHERE page_id % 4 <> 3 AND trim(url) <> ''")
def src06(spark: S, sf: str) -> DataFrame:
    """A feed for each page: RSS, Atom, RSS without a guid, and one with a DTD."""
    url = "replace(url, '&', '&amp;')"
    rss = lambda guid: f"'<rss><channel><title>x</title><item><title> Page ' || page_id || '</title><link>' || {url} || '</link>{guid}</item><item><title>no link</title></item></channel></rss>'"
    guid = "<guid>id-' || page_id || '</guid>"
    atom = f"'<feed xmlns=\"http://www.w3.org/2005/Atom\"><entry><title>page ' || page_id || '</title><link href=\"' || {url} || '\"/><id>id-' || page_id || '</id></entry></feed>'"
    payload = f"CASE page_id % 4 WHEN 0 THEN {rss(guid)} WHEN 1 THEN {atom} WHEN 2 THEN {rss('')} ELSE '<!DOCTYPE x>' || {rss(guid)} END"
    return readers.feed_entries(table(spark, sf, "pages").select(F.col("page_id").alias("feed_id"), F.expr(payload).alias("payload")))


#: Planted at the end of pages: skipped tags inside each other, references of all kinds, an end tag too many, an attribute that holds a bracket.
PLANTED = (
    "<svg>a<svg>b</svg>c</svg><p>dash &#8212; and &#x2014; here</p>", "<noscript>x<noscript>y</noscript>z</noscript></svg>&eacute;&Omega; &unknown; &amp;lt;<br/>1 < 2 &#0;&#xD800;",
    """<script>if (a < b) { document.write("<p>no</p>") }</script><div title="a > b">shown&nbsp;text</div><!-- <p>no</p> -->end""", "<style>p { x }</style><title>late title</title>&copy;&apos;&quot;&#39",
)
_NAMED = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in readers.NAMED.items()) + "}"
_CODE = rf"coalesce(TRY_CAST('0x' || nullif(regexp_extract(p, '(?i)^&#x([0-9a-f]+)', 1), '') AS BIGINT), TRY_CAST(regexp_extract(p, '^&#([0-9]+)', 1) AS BIGINT), {_NAMED}[regexp_extract(p, '^&([A-Za-z][A-Za-z0-9]*);$', 1)]::BIGINT)"
_CHARACTER = f"list_transform([{_CODE}], lambda c: CASE WHEN NOT starts_with(p, '&') OR c IS NULL THEN p WHEN c > 0 AND c < 1114112 AND c NOT BETWEEN 55296 AND 57343 THEN chr(c::INT) ELSE chr(65533) END)[1]"
_PIECE = readers.PIECES.replace("'", "''")
_PAGES = "CASE page_id % 4 " + " ".join(f"WHEN {i} THEN '{x.replace(chr(39), chr(39) * 2)}'" for i, x in enumerate(PLANTED)) + " END"


@query("SRC-07", rf"""WITH h AS (SELECT page_id, url, regexp_extract_all(coalesce(html, '') || {_PAGES}, '{_PIECE}') AS l FROM pages),
q AS (SELECT page_id, unnest(l) AS piece, generate_subscripts(l, 1) AS place FROM h),
k AS (SELECT *, CASE WHEN regexp_matches(piece, '(?is)^<(?:script|style)\b') THEN '' ELSE lower(regexp_extract(piece, '(?s)^</?([A-Za-z][A-Za-z0-9]*)', 1)) END AS tag, NOT starts_with(piece, '</') AS opens FROM q),
r AS (SELECT *, sum(CASE WHEN tag IN ('noscript', 'svg') THEN CASE WHEN opens THEN 1 ELSE -1 END ELSE 0 END) OVER w AS s, coalesce(last_value(CASE WHEN tag = 'title' THEN opens END IGNORE NULLS) OVER w, false) AS in_title FROM k WINDOW w AS (PARTITION BY page_id ORDER BY place ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY place ROWS UNBOUNDED PRECEDING)) AS depth, regexp_matches(tag, '{readers.BLOCKS}') AND (tag <> 'br' OR opens) AS block FROM r),
e AS (SELECT page_id, place, in_title AND NOT block AS in_title, CASE WHEN block THEN chr(10) ELSE trim(regexp_replace(array_to_string(list_transform(regexp_extract_all(piece, '{readers.REFERENCES}'), lambda p: {_CHARACTER}), ''), '[\s\x{{a0}}]+', ' ', 'g')) END AS part
FROM d WHERE block OR (depth = 0 AND NOT regexp_matches(piece, '(?is)^<[a-z!?/]'))),
j AS (SELECT page_id, coalesce(string_agg(part, ' ' ORDER BY place) FILTER (WHERE in_title), '') AS title, coalesce(string_agg(part, ' ' ORDER BY place) FILTER (WHERE NOT in_title), '') AS text FROM e WHERE part <> '' GROUP BY 1),
t AS (SELECT h.page_id, CASE WHEN coalesce(title, '') = '' THEN regexp_extract(url, '://([^/?#]*)', 1) ELSE title END AS title, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\s*\n\s*', chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM h LEFT JOIN j USING (page_id)),
s AS (SELECT *, regexp_replace(regexp_replace(title, '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g') AS safe FROM t)
SELECT page_id, title, text, substr(CASE WHEN safe = '' THEN 'page' ELSE safe END, 1, 80) || '.url.txt' AS file_name FROM s""")
def src07(spark: S, sf: str) -> DataFrame:
    """The pages, each with one of four planted ends."""
    ends = F.element_at(F.array(*[F.lit(x) for x in PLANTED]), (F.col("page_id") % 4 + 1).cast("int"))
    return readers.extract_page_text(table(spark, sf, "pages").withColumn("html", F.concat(F.coalesce("html", F.lit("")), ends)))


_LINE_ID = "CASE WHEN doc_id % 5 > 0 THEN 'c' || (doc_id - doc_id % 7) || source END"


@query("SRC-10", f"""WITH r AS (SELECT doc_id AS line_no, coalesce({_LINE_ID}, 'line-' || doc_id) AS id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE lang END AS question, doc_id % 3 <> 0 AS should_answer FROM documents)
SELECT *, CASE WHEN question = '' THEN 'blank_question' WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate_id' END AS error FROM r""")
def src10(spark: S, sf: str) -> DataFrame:
    value = F.to_json(F.struct(F.expr(_LINE_ID).alias("id"), F.expr("CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE lang END").alias("question"), F.expr("CASE WHEN doc_id % 3 = 0 THEN false END").alias("should_answer")))
    return readers.eval_cases(table(spark, sf, "documents").select(F.col("doc_id").alias("line_no"), value.alias("value")))


@query("SRC-17", """SELECT doc_id, concat_ws(chr(10), '---', 'doc_id: ' || doc_id, 'lang: "' || lang || '"', 'source: "' || source || '"', '---', '', substr(text, 1, 120000)) AS text FROM documents""")
def src17(spark: S, sf: str) -> DataFrame:
    return readers.front_matter(table(spark, sf, "documents"), ["doc_id", "lang", "source"])


_REWRITES = "SELECT query_id, place, rewrite FROM (SELECT item_id AS query_id, unnest([3, 1, 2, 4]) AS place, unnest(['  ' || substr(text, 1, 30), lower(substr(text, 1, 30)) || ' ', '', substr(text, 1, 60)]) AS rewrite FROM benchmark)"


@query("SET-06", f"""WITH r AS (SELECT item_id AS query_id, 0 AS place, trim(substr(text, 1, 60)) AS text FROM benchmark UNION ALL SELECT query_id, place, trim(rewrite) FROM ({_REWRITES})),
f AS (SELECT query_id, text, min(place) AS place FROM r WHERE text <> '' GROUP BY 1, 2), n AS (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS nth FROM f) SELECT * FROM n WHERE nth <= 2""")
def set06(spark: S, sf: str) -> DataFrame:
    q = table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")
    start = F.substring("text", 1, 30)
    option = lambda place, text: F.struct(F.lit(place).alias("place"), text.alias("rewrite"))
    options = F.array(option(3, F.concat(F.lit("  "), start)), option(1, F.concat(F.lower(start), F.lit(" "))), option(2, F.lit("")), option(4, F.substring("text", 1, 60)))
    rewrites = q.select("query_id", F.inline(options))
    return records.query_rewrites(q.select("query_id", F.substring("text", 1, 60).alias("question")), rewrites, 2)


_META = """'{"Source_Path": "/x/' || page_id || '", "lang": "en", "parts": [{"OBJECT_KEY": "k", "page": ' || page_id || ', "box": [1, 2.5, null]}, [{"file_path": {"a": 1}}], "output_dir"], "nested": {"url": "' || url || '", "deep": {"image_path": "p", "ok": true}}}'"""


@query("SCL-06", """SELECT page_id, '{"lang":"en","parts":[{"page":' || page_id || ',"box":[1,2.5,null]},[{}],"output_dir"],"nested":{"url":"' || url || '","deep":{"ok":true}}}' AS metadata FROM pages""")
def scl06(spark: S, sf: str) -> DataFrame:
    """Private keys on three levels, inside a list and in a list of lists."""
    return table(spark, sf, "pages").select("page_id", records.public_json(F.expr(_META)).alias("metadata"))


@query("SCL-14", f"""SELECT page_id, ['X-Api-Key=[Filtered]', 'note=sent [REDACTED] on', 'status=ok', 'url=' || u.url] AS record FROM pages JOIN ({ORACLES['TXT-19']}) u USING (page_id)""")
def scl14(spark: S, sf: str) -> DataFrame:
    record = """'{"X-Api-Key": "k' || page_id || '", "note": "sent sk-abcdefgh' || page_id || ' on", "url": "' || url || '", "status": "ok"}'"""
    clean = records.scrub_record(F.from_json(F.expr(record), "map<string,string>"))
    shown = F.array_sort(F.transform(F.map_entries(clean), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(spark, sf, "pages").select("page_id", shown.alias("record"))


@query("SRC-03", """WITH f AS (SELECT 'lang=' || lang || '/source=' || source AS folder, string_agg(doc_id || chr(9) || trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY 1),
p AS (SELECT folder, strlen(content) AS bytes, sha256(content) AS sha256, row_number() OVER (ORDER BY folder || '/') AS place FROM f), r AS (SELECT folder, bytes, CASE WHEN bytes > 60000 THEN 'too_large' WHEN place > 12 THEN 'over_cap' END AS failure, sha256 FROM p)
SELECT folder, bytes, CASE WHEN failure IS NULL THEN sha256 END AS sha256, failure, (SELECT count(failure) = 0 FROM r) AS complete, (SELECT count(*) = count(failure) FROM r) AS empty_result FROM r""")
def src03(spark: S, sf: str) -> DataFrame:
    """A folder with a file for each language and source: large ones and those past the cap are failures."""
    root = fresh_path(spark, "folder")
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")))
    docs = table(spark, sf, "documents").select("lang", "source", "doc_id", line.alias("value"))
    docs.repartition("lang", "source").sortWithinPartitions("lang", "source", "doc_id").drop("doc_id").write.partitionBy("lang", "source").text(root)
    found = readers.discover_directory(spark, root, "*.txt", max_items=12, max_bytes=60_000)
    return found.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "bytes", "sha256", "failure", "complete", "empty_result")
