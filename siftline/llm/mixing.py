"""Mixing sources to target weights by systematic sampling.

Within a source, documents stand in order of size. Each expects target / source size copies; the
running sum of these, shifted by one random offset of the source, gives a document one copy for
each whole number that it crosses. Ordered by size, the words taken differ from the target by
about one document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siftline.llm.common import running_total, written


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; none in null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """__source, __sourceless, source_size and target of each source.

    ``sizes``: __source, __sourceless, size, n. Weights go round the sources by code point, null last. Targets
    share ``share`` times all sizes by weight; a target stops at ``most`` times its source's size,
    and what is left over goes to the others by weight until none is above. Sources without words get 0.
    """
    order = [F.col("__sourceless"), F.col("__source")]
    by_source = sizes.groupBy("__source", "__sourceless").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")).withColumn("one", F.lit(1))
    ranked = running_total(by_source, [], order, "one", "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    sources = written(ranked.select("__source", "__sourceless", "source_size", weight.alias("weight")), "sources")
    total, level, capped = sources.agg(F.sum("source_size")).first()[0] or 0, None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(float(most))
        held, free, n = sources.agg(
            F.sum(F.when(over, F.col("source_size") * F.lit(float(most)))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)
        ).first()
        if n == capped or not free:
            break
        capped, level = n, (share * total - (held or 0.0)) / free
    target = F.least(F.col("weight") * F.lit(float(level or 0.0)), F.col("source_size") * F.lit(float(most))) if level is not None else F.lit(0.0)
    return sources.select("__source", "__sourceless", "source_size", target.cast("double").alias("target"))


def _keys(size: Column) -> dict[str, Column]:
    return {"__id": F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "__source": F.coalesce(F.col("source"), F.lit("")), "__sourceless": F.col("source").isNull(), "__size": size}


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, prefix: str = "") -> DataFrame:
    """Add size, source_size, target and copies (each with ``prefix``) to every row of docs.

    Null and empty texts have size 0; a null source is a source of its own, last in order. Rows that
    agree in doc_id, source and size share their copies evenly. Reruns over the same rows agree. An empty
    table gives an empty table. Columns named like the new ones are replaced.
    """
    rest = docs.drop(*[prefix + c for c in ("size", "source_size", "target", "copies")])
    keys = _keys(word_count(F.col("text").cast("string")) if size is None else size)
    names = {"__id": "e_id", "__size": "size"}
    entries = written(rest.select(*[c.alias(names.get(k, k)) for k, c in keys.items()]), "sizes")
    entries = entries.groupBy("e_id", "__source", "__sourceless", "size").agg(F.count("*").alias("n"))
    sources = source_targets(entries, weights, share, most)
    placed = running_total(entries, ["__source", "__sourceless"], [F.desc("size"), F.xxhash64("e_id", F.lit(seed)), F.col("e_id")], "n", "before").join(sources, ["__source", "__sourceless"])
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64("__source", "__sourceless", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    placed = placed.withColumn("taken", (F.floor(factor * (F.col("before") + F.col("n")) + offset) - F.floor(factor * F.col("before") + offset)).cast("long"))
    placed = placed.select(
        F.col("e_id").alias("__id"), "__source", "__sourceless", F.col("size").alias("__size"), F.col("n").alias("__n"), F.col("taken").alias("__taken"),
        F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
    )
    on = list(keys)
    joined = rest.withColumns(keys).join(placed, on)
    nth = F.row_number().over(Window.partitionBy(*on).orderBy("__taken"))
    copies = F.when(F.col("__n") == 1, F.col("__taken")).otherwise(F.floor(F.col("__taken") / F.col("__n")) + F.when(nth <= F.pmod("__taken", F.col("__n")), 1).otherwise(0))
    new = {prefix + "size": F.col("__size"), prefix + "source_size": F.col("__source_size"), prefix + "target": F.col("__target"), prefix + "copies": copies.cast("long")}
    return joined.withColumns(new).select(*rest.columns, *new)


def mixed_rows(docs: DataFrame, **how: object) -> DataFrame:
    """The mix: each row as often as it has copies, with the columns of docs."""
    mixed = mix(docs, prefix="__", **how)
    each = F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))
    return mixed.where(F.col("__copies") > 0).select(*docs.columns, each.alias("__copy")).drop("__copy")


def mix_report(docs: DataFrame, **how: object) -> DataFrame:
    """doc_id, size, source_size, target, taken (size times copies) and source of each row."""
    slim = docs.select("doc_id", "source", word_count(F.col("text").cast("string")).alias("words"))
    slim = written(slim, "words")
    mixed = mix(slim, F.col("words"), **how)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")
