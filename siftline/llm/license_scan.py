"""License scans by diagonal voting.

The rolling hashes of k words of all texts are joined with the template positions that have the
same hash. Hits of a document and template vote for their offset diagonal. Diagonals of a band,
whose width a template's length bounds, are merged, as inserted and missing words move a text from
one to another; bands overlap by half, so that none cuts a text that moves by half a width. Spans
with enough votes are verified word by word.

Templates are phrases, which must stand word for word, and texts: notices, or whole licenses read
from files by read_templates(). k grows with the template, so that common pairs of words do not vote
for long texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.bpe import small_slices
from siftline.llm.common import Words, plain_words

#: Template grams up to which their table is broadcast (24 bytes each).
BROADCAST_GRAMS = 500_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases must stand word for word; notices may differ in some words.
    phrase: bool = True
    base: bool = False

    def words(self) -> list[bytes]:
        return plain_words(self.text)

    def gram(self) -> int:
        """Words of a gram: a phrase of up to four words votes once, notices by threes, texts from 100 words on by sixes."""
        n = len(self.words())
        return min(n, 4) if self.phrase else min(n, 3 if n < 100 else 6)

    def band(self) -> int:
        """Width of a band of diagonals: half the template."""
        return 1 if self.phrase else max(1, len(self.words()) // 2)

    def votes(self, least_score: float) -> int:
        """Grams that stay if the share 1 - ``least_score`` of the words is changed one by one; of long texts a tenth at least."""
        n, k = len(self.words()), self.gram()
        if self.phrase:
            return n - k + 1
        left = n - k + 1 - k * int((1 - least_score) * n)
        return max(1, left, n // 10 if n >= 100 else 1)


#: Phrases with their labels.
BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)
#: More phrases, and the opening words of public license notices.
MORE = (
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("bsd", "bsd license"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", False),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", False),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", False),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", False),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", False),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", False),
)


def read_templates(spark: SparkSession, folder: str) -> tuple[Template, ...]:
    """Whole texts from the files of a folder, labelled by the files' names up to their first dot; the driver holds them."""
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    return tuple(Template(r.name.split(".")[0].lower(), r.value, False) for r in files.orderBy("name").collect() if plain_words(r.value))


def word_grams(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, version, k, pos and gram: the hash of the k words from each place of every text on, for each size k."""

    def rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in small_slices(batch, 2, 1 << 20):
                words = Words([t or b"" for t in texts])
                bounds = words.bounds
                for k in sizes:
                    grams = words.grams(k)
                    counts = np.maximum(np.diff(bounds) - k + 1, 0)
                    row = np.repeat(np.arange(len(counts)), counts)
                    pos = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                    ids = [part.column(i).take(pa.array(row)) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(np.full(len(row), k, np.int32)), pa.array(pos.astype(np.int32)), pa.array(grams[bounds[row] + pos].view(np.int64))], ["doc_id", "version", "k", "pos", "gram"])

    return docs.mapInArrow(rolled, "doc_id long, version long, k int, pos int, gram long")


def template_positions(templates: tuple[Template, ...]) -> list[tuple[int, int, int, int, int]]:
    """Number, k, band width, position and gram of every k words of the templates."""
    out = []
    for i, t in enumerate(templates):
        grams = Words([t.text.encode()]).grams(t.gram()).view(np.int64)
        out += [(i, t.gram(), t.band(), j, int(g)) for j, g in enumerate(grams)]
    return out


def candidate_spans(docs: DataFrame, templates: tuple[Template, ...], least_score: float) -> DataFrame:
    """doc_id, version and spans: the bands with enough votes, as (template, first, last) word places."""
    spark = docs.sparkSession
    table = template_positions(templates)
    positions = spark.createDataFrame(table, "template int, k int, band int, tpos int, gram long")
    needs = spark.createDataFrame([(i, len(t.words()), t.votes(least_score), t.band() // 2) for i, t in enumerate(templates)], "template int, words int, need int, margin int")
    bounded = F.broadcast if len(table) <= BROADCAST_GRAMS else lambda df: df
    hits = word_grams(docs, sorted({t.gram() for t in templates})).join(bounded(positions), ["k", "gram"])
    diagonal = F.col("pos") - F.col("tpos")
    # Even numbers are bands from 0 on, odd ones those that begin half a width before.
    bands = F.array_distinct(F.array(2 * F.floor(diagonal / F.col("band")), F.when(F.col("band") > 1, 2 * F.floor((diagonal + F.floor(F.col("band") / 2)) / F.col("band")) + 1).otherwise(2 * F.floor(diagonal / F.col("band")))))
    key = ["doc_id", "version", "template", "place"]
    merged = (
        hits.select("doc_id", "version", "template", "tpos", diagonal.alias("diagonal"), F.explode(bands).alias("place"))
        .groupBy(*key)
        .agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.size(F.collect_set("tpos")).alias("votes"))
        .join(bounded(needs), "template")
        .where(F.col("votes") >= F.col("need"))
    )
    # Words put in or left out at the ends, which no gram shows, lie in a margin.
    span = F.struct("template", (F.col("low") - F.col("margin")).cast("long").alias("first"), (F.col("high") + F.col("words") + F.col("margin")).cast("long").alias("last"))
    return merged.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(span)).alias("spans"))


FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,score:double>>"


def in_order(template: list[bytes], words: list[bytes]) -> tuple[int, int, float] | None:
    """Where the template's words stand in order among the words, and their share of the longer of template and place."""
    blocks = [b for b in SequenceMatcher(None, template, words, False).get_matching_blocks() if b.size]
    if not blocks:
        return None
    first, last = blocks[0].b, blocks[-1].b + blocks[-1].size
    return first, last, sum(b.size for b in blocks) / max(len(template), last - first)


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = (*BASE, *MORE), least_score: float = 0.7) -> DataFrame:
    """doc_id, the counts and labels of each row's text, and the verified spans.

    Words are those of plain_words(). n_base counts the places where a base phrase stands word for
    word; first_word and last_word are the smallest and largest of their starts, null without any. A
    text counts if its words that stand in order are ``least_score`` of its own number and of that of
    the words from the first to the last of them. score is the best verified
    share, 0 without one. Null and empty texts have no words and no labels (empty strings). Repeated
    rows each get their row; an empty table gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.col("text").cast("string").alias("text"))
    # Rows that repeat an id and text vote once each for the same bands: the votes are distinct places of the template.
    spans = candidate_spans(rows, templates, least_score)
    known = [t.words() for t in templates]

    def verify(words: list[bytes], span: dict) -> tuple[str, int, int, float, bool] | None:
        t, template = templates[span["template"]], known[span["template"]]
        first, last = max(0, span["first"]), min(len(words), span["last"])
        if t.phrase:
            return (t.label, first, last, 1.0, t.base) if words[first:last] == template else None
        found = in_order(template, words[first:last])
        return (t.label, first + found[0], first + found[1], found[2], False) if found and found[2] >= least_score else None

    @F.pandas_udf(FOUND)
    def found(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, places in zip(texts, spans, strict=True):
            words = plain_words(text)
            good = sorted({x for x in (verify(words, s) for s in places) if x}) if places is not None else []
            starts = [x[1] for x in good if x[4]]
            out.append(
                (
                    len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x[0] for x in good if x[4]})),
                    ",".join(sorted({x[0] for x in good})), max((x[3] for x in good), default=0.0), [dict(zip(("label", "first", "last", "score"), x[:4], strict=True)) for x in good],
                )
            )
        frame = pd.DataFrame(out, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
        return frame.astype({"first_word": "Int64", "last_word": "Int64"})

    on = ["doc_id", "version"]
    joined = rows.join(spans.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "spans"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    return joined.select(*on, found("text", "spans").alias("found")).select("doc_id", "found.*")
