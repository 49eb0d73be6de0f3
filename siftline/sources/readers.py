"""Sources with a format of their own: folders, feeds, pages, evaluation cases, provenance headers."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions.text import normalize_text

#: Code points of the named references of HTML 4, from Python's table, and of the apostrophe.
NAMED = {**name2codepoint, "apos": 39}
#: Pieces of a page: comments and declarations, scripts and styles with all they hold (no tag in them counts), tags, texts, stray characters.
PIECES = r"""(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|<[!?][^>]*>|</?[a-z](?:"[^"]*"|'[^']*'|[^'">])*>|[^<]+|<"""
REFERENCES = r"(?i)&#[0-9]{1,7};?|&#x[0-9a-f]{1,6};?|&[a-z][a-z0-9]{1,31};|[^&]+|&"
BLOCKS = "^(?:p|div|section|article|h1|h2|h3|li|br)$"


def scan_text_files(spark: SparkSession, root: str) -> DataFrame:
    """path and text of the .txt and .md files below a folder, one row a file, normalized."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md,markdown}").text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), normalize_text(F.col("value")).alias("text"))


def incremental_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose path and hash are not in the manifest."""
    return files.join(manifest, ["path", "sha256"], "left_anti")


def feed_entries(feeds: DataFrame) -> DataFrame:
    """feed_id, title, url and external_id of the items of RSS and the entries of Atom feeds (payload).

    Entries without a link go; feeds with a DTD or an entity at their start give none.
    """
    safe = feeds.where(~F.regexp_like(F.upper(F.substring("payload", 1, 4096)), F.lit("<!(DOCTYPE|ENTITY)")))
    item = "array<struct<title: string, link: string, guid: string>>"
    entry = "array<struct<title: string, link: struct<_href: string>, id: string>>"
    rss = F.from_xml("payload", F.lit(f"channel struct<item: {item}>"))["channel"]["item"]
    atom = F.from_xml("payload", F.lit(f"entry {entry}"))["entry"]
    both = F.concat(
        F.coalesce(F.transform(rss, lambda e: F.struct(e["title"].alias("title"), e["link"].alias("url"), e["guid"].alias("key"))), F.array()),
        F.coalesce(F.transform(atom, lambda e: F.struct(e["title"].alias("title"), e["link"]["_href"].alias("url"), e["id"].alias("key"))), F.array()),
    )
    rows = safe.select("feed_id", F.explode(both).alias("e"))
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    out = rows.select("feed_id", clean(F.col("e.title")).alias("title"), clean(F.col("e.url")).alias("url"), clean(F.col("e.key")).alias("external_id"))
    return out.where("url <> ''").withColumn("external_id", F.when(F.col("external_id") == "", F.col("url")).otherwise(F.col("external_id")))


def unescaped(text: Column) -> Column:
    """Character references as characters: named ones of HTML 4 by a map, numeric ones by code point (those that are none: U+FFFD)."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def character(piece: Column) -> Column:
        digits = F.regexp_extract(piece, "(?i)^&#x([0-9a-f]+)", 1)
        number = F.when(digits != "", F.conv(digits, 16, 10).cast("long")).otherwise(F.regexp_extract(piece, "^&#([0-9]+)", 1).try_cast("long"))
        code = F.coalesce(number, F.try_element_at(names, F.regexp_extract(piece, "^&([A-Za-z][A-Za-z0-9]*);$", 1)).cast("long"))
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(code.isNull(), piece).when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")

    found = F.regexp_extract_all(text, F.lit(REFERENCES), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(found, lambda p: F.when(F.startswith(p, F.lit("&")), character(p)).otherwise(p)), "")).otherwise(text)


def page_parts(pages: DataFrame) -> DataFrame:
    """page_id, place, in_title and part: the texts of each page outside skipped tags, and a line break for each block tag.

    A page is a stream of tags and texts. The depth of skipped tags (noscript, svg; script and style are one piece each) is a running sum over
    the page that an end tag too many doesn't take below 0, so that a tag inside one of the same name does not end the skip.
    """
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(PIECES), F.lit(0))).alias("place", "piece"))
    tag = F.lower(F.regexp_extract("piece", r"(?s)^</?([A-Za-z][A-Za-z0-9]*)", 1))
    opens, closes = ~F.startswith("piece", F.lit("</")), F.startswith("piece", F.lit("</"))
    whole = F.regexp_like("piece", F.lit(r"(?is)^<(?:script|style)\b"))
    rows = rows.withColumn("tag", F.when(whole, "").otherwise(tag)).withColumn("is_text", ~F.regexp_like("piece", F.lit(r"(?is)^<[a-z!?/]")))
    order = Window.partitionBy("page_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("tag").isin("noscript", "svg"), F.when(opens, 1).otherwise(-1)).otherwise(0)
    rows = rows.withColumn("sum", F.sum(step).over(order))
    rows = rows.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(order)))
    rows = rows.withColumn("in_title", F.coalesce(F.last(F.when(F.col("tag") == "title", opens), ignorenulls=True).over(order), F.lit(False)))
    block = F.regexp_like("tag", F.lit(BLOCKS)) & ~((F.col("tag") == "br") & closes)
    text = F.trim(F.regexp_replace(unescaped(F.col("piece")), r"[\s\x{a0}]+", " "))
    rows = rows.where(block | (F.col("is_text") & (F.col("depth") == 0)))
    parts = rows.select("page_id", "place", (F.col("in_title") & ~block).alias("in_title"), F.when(block, "\n").otherwise(text).alias("part"))
    return parts.where(F.col("part") != "")


def extract_page_text(pages: DataFrame) -> DataFrame:
    """page_id, title (else the host), file_name and text of pages (page_id, url, html) with distinct ids; a page without html has no text."""
    joined = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("place", "part")))), lambda x: x["part"]), " ")
    parts = page_parts(pages).groupBy("page_id").agg(joined(F.col("in_title")).alias("title"), joined(~F.col("in_title")).alias("text"))
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    rows = pages.select("page_id", "url").join(parts, "page_id", "left").na.fill("", ["title", "text"])
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\s*\n\s*", "\n"), r"[ \t]{2,}", " "), r"^\s+|\s+$", "")
    rows = rows.select("page_id", F.when(F.col("title") == "", host).otherwise(F.col("title")).alias("title"), text.alias("text"))
    safe = F.regexp_replace(F.regexp_replace("title", r"[^A-Za-z0-9._-]+", "-"), r"^[.-]+|[.-]+$", "")
    return rows.withColumn("file_name", F.concat(F.substring(F.when(safe == "", "page").otherwise(safe), 1, 80), F.lit(".url.txt")))


def eval_cases(lines: DataFrame) -> DataFrame:
    """Cases of JSON lines (line_no, value): an id by default, and the error of a blank question or a repeated id."""
    case = F.from_json("value", "id string, question string, should_answer boolean, expected_sources array<string>")
    rows = lines.withColumn("c", case).select("line_no", F.coalesce("c.id", F.concat(F.lit("line-"), F.col("line_no").cast("string"))).alias("id"), F.trim(F.coalesce("c.question", F.lit(""))).alias("question"), F.coalesce("c.should_answer", F.lit(True)).alias("should_answer"))
    counts = rows.groupBy("id").agg(F.count("*").alias("n_same"))
    error = F.when(F.col("question") == "", "blank_question").when(F.col("n_same") > 1, "duplicate_id")
    return rows.join(counts, "id").select("line_no", "id", "question", "should_answer", error.alias("error"))


def front_matter(docs: DataFrame, fields: list[str], limit: int = 120_000) -> DataFrame:
    """doc_id and text: a header of ``key: json`` lines, then the body up to a limit (the format's)."""
    head = [F.concat(F.lit(f"{f}: "), F.to_json(F.array(f)).substr(F.lit(2), F.length(F.to_json(F.array(f))) - 2)) for f in fields]
    return docs.select("doc_id", F.concat_ws("\n", F.lit("---"), *head, F.lit("---"), F.lit(""), F.substring("text", 1, limit)).alias("text"))


def discover_directory(spark: SparkSession, root: str, pattern: str, max_items: int, max_bytes: int) -> DataFrame:
    """path (below the root), bytes, sha256 and failure (too_large, over_cap) of a folder's files in order of path, and of the whole
    run whether it is complete (no failure) and its result empty.

    Sizes and places come from the listing; only files within both caps are opened, ``max_items`` at most.
    """
    read = lambda path: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    listed = read(root).select("path", "length")
    inside = {r.path for r in listed.orderBy("path").limit(max_items).collect()}
    small = listed.where(F.col("path").isin(*inside) & (F.col("length") <= max_bytes))
    opened = [r.path for r in small.select("path").collect()]
    none = spark.createDataFrame([], "path string, sha256 string")
    hashes = read(opened).select("path", F.sha2("content", 256).alias("sha256")) if opened else none
    failure = F.when(F.col("length") > max_bytes, "too_large").when(~F.col("path").isin(*inside), "over_cap")
    rows = listed.join(F.broadcast(hashes), "path", "left").withColumn("failure", failure)  # max_items rows
    whole = rows.agg((F.count_if(F.col("failure").isNotNull()) == 0).alias("complete"), (F.count_if(F.col("failure").isNull()) == 0).alias("empty_result"))
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + root.rstrip("/").replace(".", r"\.") + "/", "")
    return rows.select(path.alias("path"), F.col("length").alias("bytes"), "sha256", "failure").crossJoin(F.broadcast(whole))  # one row
