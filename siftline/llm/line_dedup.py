"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

Rolling hashes over the hashes of the lines before and after a gap decide whether chunks may end
there, so that a passage brings the boundaries of both its ends along wherever it stands. From each
boundary a chunk reaches to the first one that is two lines or more away; chunks overlap, so that no
short tail is lost. Chunks whose hash occurs again anywhere are compared byte by byte; all but the
first occurrence are removed. long_lines() is an operator beside it for passages that are one line.

dedup_passages() leaves no chunk to chance: it compares every run of ``min_lines`` lines, from each
line on, so that a repeated passage goes whole, its ends and its single lines included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import drop_all, split_hot, written


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_hash(line: Column) -> Column:
    """28 bits of the MD5 of a line."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def passage(line: Column, min_words: int) -> Column:
    """Whether a line has as many words as a passage, that is one run of white space less at least."""
    gaps = rf"^(?:[^\x20\x09-\x0D]*+[\x20\x09-\x0D]++){{{min_words - 1}}}"
    return F.when(F.length(line) >= 2 * min_words - 1, F.regexp_like(line, F.lit(gaps))).otherwise(False)


def rolled(hashes: Column, start: Column, step: int, window: int) -> Column:
    """The sum of h[start + j * step] * 31 ** j over the ``window`` lines from ``start`` on, as far as there are lines."""
    at = lambda j: start + j * step
    return sum((F.when((at(j) >= 0) & (at(j) < F.size(hashes)), F.get(hashes, at(j))).otherwise(0) * 31**j for j in range(window)), F.lit(0))


def chunk_bounds(lines: Column, window: int, modulus: int) -> Column:
    """start and n of the chunks of an array of lines.

    The gap before line i is no boundary if the rolling hashes of the ``window`` lines before it and
    after it are both multiples of ``modulus``; the ends of the text are boundaries. A chunk goes from
    a boundary to the first one at two lines or more.
    """

    def of(hashes: Column) -> Column:
        inner = lambda i: (F.pmod(rolled(hashes, i - 1, -1, window), F.lit(modulus)) != 0) | (F.pmod(rolled(hashes, i, 1, window), F.lit(modulus)) != 0)
        return let(F.filter(F.sequence(F.lit(0), F.size(hashes)), lambda i: (i == 0) | (i == F.size(hashes)) | inner(i)), chunks)

    def chunks(ends: Column) -> Column:
        def chunk(start: Column, k: Column) -> Column:
            end = F.when(F.get(ends, k + 1) - start > 1, F.get(ends, k + 1)).otherwise(F.get(ends, k + 2))
            return F.struct(start.alias("start"), (end - start).alias("n"))

        return F.filter(F.transform(ends, chunk), lambda c: c["n"].isNotNull())

    return let(F.transform(lines, line_hash), of)


def long_lines(lines: Column, min_words: int) -> Column:
    """start and n of the lines that are passages by themselves: of ``min_words`` words or more."""
    found = F.transform(lines, lambda line, i: F.when(passage(line, min_words), F.struct(i.alias("start"), F.lit(1).alias("n"))))
    return F.filter(found, lambda c: c.isNotNull())


def piece(lines: Column, c: Column) -> Column:
    return F.array_join(F.slice(lines, c["start"] + 1, c["n"]), "\n")


def repeated_chunks(docs: DataFrame, window: int = 2, modulus: int = 8, min_words: int = 50) -> DataFrame:
    """doc_id, version and drop: the sorted numbers of each document's lines that are in a repeated chunk or repeated long line."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.col("text").cast("string").alias("text"))
    place = F.struct("doc_id", "version", "start", "n")
    word = F.lit(r"[^\x20\x09-\x0D]")

    def hashed(lines: Column) -> Column:
        found = F.transform(F.concat(chunk_bounds(lines, window, modulus), long_lines(lines, min_words)), lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), piece(lines, c).alias("chunk")))
        return F.transform(F.filter(found, lambda c: F.regexp_like(c["chunk"], word)), lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), F.xxhash64(c["chunk"]).alias("hash")))

    hashes = rows.where(F.col("text") != "").select("doc_id", "version", F.explode(let(F.split("text", "\n"), hashed)).alias("c"))
    hashes = written(hashes.select("doc_id", "version", "c.start", "c.n", "c.hash"), "chunks")
    # Rows that repeat a document's id and text are the same document: their chunks have the same place.
    again = hashes.groupBy("hash").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("places")).where(F.col("a") != F.col("b")).select("hash", "places")
    again = written(again, "again")
    spread, parts = split_hot(hashes, again, "hash", "places")
    marked = spread.join(parts, ["hash", "slice"]).groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "n", "slice", "slices")).alias("marked"))
    suspects = rows.join(marked, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"])
    found = suspects.select("doc_id", "version", F.explode(let(F.split("text", "\n"), lambda lines: F.transform("marked", lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), c["slice"].alias("slice"), c["slices"].alias("slices"), piece(lines, c).alias("chunk"))))).alias("c"))
    texts = written(found.select("doc_id", "version", "c.*"), "suspects")
    drop_all(hashes, again)
    # Both sides compare the bytes of the chunks; the owner of a hot chunk meets each slice of its places.
    owners = texts.groupBy("chunk", "slices").agg(F.min(place).alias("owner")).select("chunk", "owner", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    surplus = texts.join(owners, ["chunk", "slice"]).where(place != F.col("owner"))
    lines = surplus.select("doc_id", "version", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("line"))
    return lines.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("line")).alias("drop"))


def units(lines: Column, at: Column, min_lines: int, min_words: int) -> Column:
    """What may be a repetition from each place of ``at`` on: ``min_lines`` lines with a word, and one line as long as a passage."""

    def run(i: Column) -> Column:
        text = F.when(i + min_lines <= F.size(lines), F.array_join(F.slice(lines, i + 1, min_lines), "\n"))
        return F.struct(i.alias("ord"), F.lit(min_lines).alias("n"), text.alias("unit"))

    def line(i: Column) -> Column:
        return F.struct(i.alias("ord"), F.lit(1).alias("n"), F.get(lines, i).alias("unit"))

    runs = F.filter(F.transform(at, run), lambda u: F.coalesce(F.regexp_like(u["unit"], F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)))
    return F.concat(runs, F.filter(F.transform(at, line), lambda u: passage(u["unit"], min_words)))


def repeated_lines(docs: DataFrame, min_lines: int = 2, min_words: int = 50) -> DataFrame:
    """doc_id, version and drop: the numbers of each document's lines that belong to a repetition.

    A line does if ``min_lines`` lines around it, or it alone if it is as long as a passage, stand
    earlier (by doc_id and place). The first place of any line is in no such run, so it stays.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.col("text").cast("string").alias("text"))
    place = F.struct("doc_id", "version", "ord")

    def hashed(lines: Column) -> Column:
        found = units(lines, F.sequence(F.lit(0), F.size(lines) - 1), min_lines, min_words)
        return F.transform(found, lambda u: F.struct(u["ord"].alias("ord"), F.xxhash64(u["unit"]).alias("hash")))

    def digests(lines: Column) -> Column:
        found = units(lines, F.col("ords"), min_lines, min_words)
        return F.transform(found, lambda u: F.struct(u["ord"].alias("ord"), u["n"].alias("n"), F.unhex(F.sha2(u["unit"], 256)).alias("digest")))

    hashes = rows.where(F.col("text") != "").select("doc_id", "version", F.explode(let(F.split("text", "\n"), hashed)).alias("u"))
    hashes = written(hashes.select("doc_id", "version", "u.ord", "u.hash"), "units")
    again = hashes.groupBy("hash").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("places")).where(F.col("a") != F.col("b")).select("hash", "places")
    again = written(again, "again")
    spread, parts = split_hot(hashes, again, "hash", "places")
    marked = spread.join(parts, ["hash", "slice"]).groupBy("doc_id", "version").agg(F.collect_set("ord").alias("ords"))
    suspects = rows.join(marked, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"])
    found = suspects.select("doc_id", "version", F.explode(let(F.split("text", "\n"), digests)).alias("u"))
    found = written(found.select("doc_id", "version", "u.ord", "u.n", "u.digest"), "suspects")
    drop_all(hashes, again)
    # Equal SHA-256 digests stand for equal bytes: every line is in several runs, whose texts would move as often.
    owners = written(found.groupBy("digest").agg(F.min(place).alias("owner"), F.count("*").alias("places")).where("places > 1"), "owners")
    spread, parts = split_hot(found, owners, "digest", "places")
    surplus = spread.join(parts, ["digest", "slice"]).where(place != F.col("owner"))
    lines = surplus.select("doc_id", "version", F.explode(F.sequence(F.col("ord"), F.col("ord") + F.col("n") - 1)).alias("ord"))
    return lines.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("ord")).alias("drop"))


def dedup_passages(docs: DataFrame, min_lines: int = 2, min_words: int = 50, removed: str | None = None) -> DataFrame:
    """docs with the repeated lines (see repeated_lines()) taken out of text; in all else like dedup_lines()."""
    return without_lines(docs, repeated_lines(docs, min_lines, min_words), removed)


def dedup_lines(docs: DataFrame, window: int = 2, modulus: int = 8, min_words: int = 50, removed: str | None = None) -> DataFrame:
    """docs with the repeated chunks, and the repeated lines of ``min_words`` words or more, taken out of text; all rows and columns stay.

    The first occurrence, by doc_id and place, stays. The rest of a text keeps its order and line
    ends; a text of repetitions only becomes empty. Null and empty texts pass. Rows that repeat both
    doc_id and text are one document and keep the same lines; null ids pass unchanged. ``removed``
    adds a column with the number of lines taken out. An empty table gives an empty table.
    """
    return without_lines(docs, repeated_chunks(docs, window, modulus, min_words), removed)


def without_lines(docs: DataFrame, drop: DataFrame, removed: str | None) -> DataFrame:
    """docs without the lines that ``drop`` (doc_id, version, sorted line numbers) names."""

    def kept(lines: Column) -> Column:
        gone = F.col("__drop")
        before = lambda k: F.coalesce(F.when(k > 0, F.get(gone, k - 1)), F.lit(-1))
        stay = F.flatten(F.transform(F.concat(gone, F.array(F.size(lines))), lambda end, k: F.slice(lines, before(k) + 2, end - before(k) - 1)))
        return F.struct(F.array_join(stay, "\n").alias("text"), F.size(gone).alias("gone"))

    drop = drop.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("drop").alias("__drop"))
    joined = docs.join(drop, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__version")), "left")
    out = joined.withColumn("__new", F.when(F.col("__drop").isNotNull(), let(F.split("text", "\n"), kept)))
    columns = [F.coalesce(F.col("__new.text"), F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns if c != removed]
    return out.select(*columns, *([F.coalesce(F.col("__new.gone"), F.lit(0)).cast("long").alias(removed)] if removed else []))
