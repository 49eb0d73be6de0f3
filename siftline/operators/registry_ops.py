"""Relational operators over registry tables: upserts, differences, integrity, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.sources.scratch import written


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, where an incoming row replaces the one with its key."""
    return existing.join(incoming.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(incoming)


def index_mismatch(docs: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Documents whose index settings differ from those expected; blank and 0 are not compared."""
    differs = [F.when(~F.col(k).isin("", "0") & (F.col(k) != v), F.lit(k)) for k, v in sorted(expected.items()) if v not in ("", "0")]
    found = F.filter(F.array(*differs), lambda x: x.isNotNull())
    return docs.select("doc_id", found.alias("mismatches")).where(F.size("mismatches") > 0)


def diff_snapshot(items: DataFrame, candidates: DataFrame) -> DataFrame:
    both = items.withColumnRenamed("content_hash", "old").join(candidates.withColumnRenamed("content_hash", "new"), "doc_id", "full_outer")
    action = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "new").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    return both.select("doc_id", action.alias("action"))


def dedupe_against_index(docs: DataFrame) -> DataFrame:
    """The first document with the same text in the same knowledge base."""
    hashed = docs.select("doc_id", "lang", F.md5("text").alias("h"))
    first = hashed.groupBy("lang", "h").agg(F.min("doc_id").alias("existing_id"))
    return hashed.join(first, ["lang", "h"]).select("doc_id", "existing_id", (F.col("doc_id") != F.col("existing_id")).alias("duplicate"))


def referential_integrity(name: str, child: DataFrame, parent: DataFrame) -> DataFrame:
    rows = child.join(parent.withColumn("found", F.lit(1)), "k", "left")
    return rows.agg(F.count("*").alias("total"), F.count("found").alias("joined")).select(F.lit(name).alias("relation"), "total", "joined", (F.col("total") - F.col("joined")).alias("violations"))


def seed_pairs(seeds: DataFrame) -> DataFrame:
    """Unordered pairs of a knowledge base's seeds (a bounded list each)."""
    other = seeds.select("lang", F.col("source").alias("b"))
    return seeds.withColumnRenamed("source", "a").join(other, "lang").where("a < b").select("lang", "a", "b")


def match_hashes(indexed: DataFrame, manifest: DataFrame) -> DataFrame:
    a, b = indexed.distinct().withColumn("i", F.lit(1)), manifest.distinct().withColumn("m", F.lit(1))
    both = a.join(b, "h", "full_outer")
    return both.agg(F.count("*").alias("hashes"), F.count_if(F.col("i").isNull()).alias("only_manifest"), F.count_if(F.col("m").isNull()).alias("only_indexed"), F.bool_and(F.col("i").isNotNull() & F.col("m").isNotNull()).alias("same"))


def metric_counters(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("event_type").alias("name"), F.substring("props", 1, 80).alias("labels")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def expired(assets: DataFrame, now: str) -> DataFrame:
    at = F.try_to_timestamp("expires_at", F.lit("yyyy-MM-dd HH:mm:ss"))
    return assets.withColumn("expired", at.isNull() | (F.col("ts") <= F.lit(now).cast("timestamp_ntz")))


def upsert_vectors(existing: DataFrame, incoming: DataFrame, key: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """The index after batches of rows (key, embedding, batch and the rest), and the rows rejected.

    Of several writes of a key the one of the last batch stays. A row without a vector, or with one of another dimension, is rejected.
    """
    good = F.coalesce(F.size("embedding") == dim, F.lit(False)) & F.col("embedding").isNotNull()
    rows = existing.withColumn("batch", F.lit(0)).unionByName(incoming.select(*existing.columns, "batch")).where(good)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"), F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(key, "batch", "last.*"), incoming.where(~good)


def export_markdown(turns: DataFrame) -> DataFrame:
    """One text for each conversation: headings of roles, contents, and numbered citations (text, page) of up to 600 characters."""
    page = lambda c: F.when(c["page"].isNotNull(), F.concat(F.lit(" (page "), c["page"].cast("string"), F.lit(")"))).otherwise("")
    cite = lambda c, i: F.concat(F.lit("\n["), (i + 1).cast("string"), F.lit("] "), F.substring(c["text"], 1, 600), page(c))
    cited = F.array_join(F.transform(F.coalesce("citations", F.array().cast(turns.schema["citations"].dataType)), cite), "")
    part = F.concat(F.lit("## "), F.col("role"), F.lit("\n"), F.coalesce("text", F.lit("")), cited)
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts"))
    head = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n"))
    return rows.select("conv_id", F.concat(head, F.array_join(F.transform("parts", lambda p: p["part"]), "\n")).alias("markdown"))


def content_fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows, and a digest that does not depend on their order.

    Each row is JSON with its columns in order of their names, as text; the digest is the sums of five parts of the rows' SHA-256.
    """
    digest = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(df.columns)])), 256)
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return df.select(digest.alias("h")).agg(F.count("*").alias("rows"), F.concat_ws("-", *[part(i) for i in range(5)]).alias("digest"))


def copy_verified(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Copy by primary key and compare row counts and contents before and after; a second copy changes nothing."""
    copied = written(upsert(target, source, keys), "copied")

    def compared(step: str, other: DataFrame) -> DataFrame:
        a, b = content_fingerprint(source).toDF("source_rows", "a"), content_fingerprint(other.select(*source.columns)).toDF("target_rows", "b")
        return a.crossJoin(b).select(F.lit(step).alias("step"), "source_rows", "target_rows", ((F.col("a") == F.col("b")) & (F.col("source_rows") == F.col("target_rows"))).alias("same"))  # one row each

    return compared("before", target).unionByName(compared("after", copied))


def sync_run_summary(diff: DataFrame, failures: DataFrame) -> DataFrame:
    """Counts of a run (doc_id, action) of which some documents failed (doc_id), and its status."""
    rows = diff.join(failures.select("doc_id").distinct().withColumn("failed", F.lit(True)), "doc_id", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    n = lambda a: F.count_if((F.col("action") == a) & ~F.col("failed"))
    there = F.col("action") != "missing"
    out = rows.agg(F.count_if(there).alias("discovered"), n("unchanged").alias("unchanged"), n("updated").alias("updated"), n("new").alias("added"), F.count_if(there & F.col("failed")).alias("failed"), F.count_if(~there).alias("deletions"))
    return out.withColumn("status", F.when(F.col("failed") == 0, "succeeded").when(F.col("failed") < F.col("discovered"), "partial").otherwise("failed"))


def insert_new(existing: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of the batch whose key is not blank, not there and first in the batch, with the counts of created and dropped rows."""
    first = batch.where(F.trim(key) != "").groupBy(key).agg(F.min(order).alias(order))
    fresh = first.join(existing.select(key), key, "left_anti")
    n = fresh.agg(F.count("*").alias("created")).crossJoin(batch.agg(F.count("*").alias("all"))).select("created", (F.col("all") - F.col("created")).alias("deduped"))  # one row each
    return fresh.crossJoin(F.broadcast(n))


def first_of(rows: DataFrame, key: str, order: list[Column], value: str, n: int, out: str) -> DataFrame:
    """key and the list of its first n values in order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    few = rows.withColumn("place", place).where(F.col("place") <= n)
    return few.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", value))).alias("l")).select(key, F.transform("l", lambda x: x[value]).alias(out))


def corpus_overview(docs: DataFrame, labels: DataFrame, chunks: DataFrame, turns: DataFrame) -> DataFrame:
    """For each language counts, bands of quality, its five worst documents and twelve themes; the six last questions and a suggestion."""
    rows = docs.join(labels, "doc_id", "left").withColumn("q", F.when(F.col("quality") == 1, 90).when(F.col("quality") == 0, 60).otherwise(80))
    parts = chunks.groupBy(F.col("document_id").cast("long").alias("doc_id")).agg(F.count("*").alias("parts"))
    low = F.count_if(F.col("q") < 70)
    out = rows.join(parts, "doc_id", "left").groupBy("lang").agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("parts"), F.lit(0)).alias("chunks"), F.sum(F.length("text")).alias("chars"), F.round(F.avg("q"), 6).alias("mean_quality"),
        F.count_if(F.col("q") >= 85).alias("high"), F.count_if((F.col("q") >= 70) & (F.col("q") < 85)).alias("medium"), low.alias("low"), F.when(low > 0, "review low quality").otherwise("none").alias("suggestion"),
    )
    worst = first_of(rows.where("q < 70").select("lang", "q", "doc_id"), "lang", [F.col("q"), F.col("doc_id")], "doc_id", 5, "low_documents")
    words = docs.select("lang", F.explode(tx.tokenize(F.col("text"))).alias("token")).where("length(token) >= 2").groupBy("lang", "token").agg(F.count("*").alias("c"))
    themes = first_of(words, "lang", [F.desc("c"), F.col("token")], "token", 12, "themes")
    last = turns.where("role = 'user' AND text <> ''").orderBy(F.desc("conv_id"), F.desc("turn")).limit(6)
    recent = last.agg(F.array_sort(F.collect_list(F.struct((-F.col("conv_id")).alias("a"), (-F.col("turn")).alias("b"), "text"))).alias("l")).select(F.transform("l", lambda x: x["text"]).alias("recent"))
    return out.join(worst, "lang", "left").join(themes, "lang", "left").crossJoin(F.broadcast(recent))  # one row


def system_metrics(events: DataFrame, docs: DataFrame, turns: DataFrame, jobs: DataFrame, graph: DataFrame) -> DataFrame:
    """block, name and value: what is known, answered, ingested and linked, operations by type and level, and recommendations.

    ``graph``: nodes, edges, mentions and evidence of each knowledge base, as graph_summary() gives them.
    """

    def block(df: DataFrame, name: str, **values: Column) -> DataFrame:
        wide = df.agg(*[v.cast("double").alias(k) for k, v in values.items()]).withColumn("block", F.lit(name))
        return wide.unpivot("block", list(values), "name", "value")

    counted = lambda df, name, key: df.groupBy(key.alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("block"), "name", "value")
    answer, errors, retries = F.col("role") == "assistant", F.count_if(F.col("event_type") == "error"), F.sum(F.greatest(F.lit(0), F.col("attempts") - 1))
    level = F.when(F.col("value") < 1, "low").when(F.col("value") < 10, "normal").otherwise("high")
    blocks = [
        block(docs, "knowledge", documents=F.count("*"), characters=F.sum(F.length("text"))),
        block(turns, "answering", questions=F.count_if(F.col("role") == "user"), answers=F.count_if(answer), mean_length=F.round(F.avg(F.when(answer, F.length("text"))), 6)),
        block(events, "operations", total=F.count("*"), errors=errors, mean_value=F.round(F.avg("value"), 6), users=F.count_distinct("user_id")),
        counted(events, "type", F.col("event_type")),
        counted(events, "level", level),
        block(jobs, "ingestion", jobs=F.count("*"), retries=retries),
        block(graph, "graph", **{name: F.coalesce(F.sum(name), F.lit(0)) for name in ("nodes", "edges", "mentions", "evidence")}),
        block(events, "recommendation", check_errors=(errors * 20 > F.count("*")).cast("int")),
        block(jobs, "recommendation", check_retries=(retries > F.count("*")).cast("int")),
    ]
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Counts for each failure type, and its eight last rows."""
    rows = feedback.withColumn("failure_type", F.coalesce(F.nullif("failure_type", F.lit("")), F.lit("unclassified")))
    counts = rows.groupBy("failure_type").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("up"), F.count_if(F.col("quality") == 0).alias("down"))
    return counts.join(first_of(rows.select("failure_type", "doc_id"), "failure_type", [F.desc("doc_id")], "doc_id", 8, "recent"), "failure_type")


def conversation_metrics(messages: DataFrame, limit: int) -> DataFrame:
    """Of the last messages (conv_id, turn, text, meta, cancelled): their number, those cancelled and empty, and mean times."""
    last = messages.orderBy(F.desc("conv_id"), F.desc("turn")).limit(limit)
    first_token = F.get_json_object("meta", "$.timing.first_token_ms").cast("int")
    return last.agg(F.count("*").alias("messages"), F.count_if("cancelled").alias("cancelled"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("failed"), F.round(F.avg(first_token), 6).alias("mean_first_token_ms"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


def metric_histogram(events: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative counts by upper bound, with the sum of all values."""
    v = F.greatest(F.col("value"), F.lit(0.0))
    wide = events.groupBy("event_type").agg(*[F.count_if(v <= b).alias(str(b)) for b in bounds], F.count("*").alias("+Inf"), F.round(F.sum(v), 4).alias("total"))
    return wide.unpivot(["event_type", "total"], [F.col(f"`{n}`") for n in [*map(str, bounds), "+Inf"]], "le", "n")


def consistency_snapshot(vectors: DataFrame, docs: DataFrame, citations: DataFrame) -> DataFrame:
    """One row of counts, distinct ids and dimensions, citations with their document, and one document as a sample."""
    own = vectors.agg(F.count("*").alias("vectors"), F.count_distinct("vec_id").alias("ids"), F.array_sort(F.collect_set(F.size("embedding").cast("long"))).alias("dimensions"))
    known = docs.agg(F.count("*").alias("documents"), F.min("doc_id").alias("sample_id"), F.min_by(F.md5("text"), "doc_id").alias("sample_hash"))
    joined = citations.join(docs.select("doc_id"), "doc_id").agg(F.count("*").alias("joined_citations"))
    return own.crossJoin(known).crossJoin(joined)  # one row each


def compare_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """The later snapshot, and whether the earlier one is the same."""
    then = before.select(F.struct(*sorted(before.columns)).alias("then"))
    return after.crossJoin(then).withColumn("same_as_before", F.col("then").eqNullSafe(F.struct(*sorted(after.columns)))).drop("then")  # one row each


def knowledge_gaps(questions: DataFrame, docs: DataFrame, cited: DataFrame, feedback: DataFrame, topics: dict[str, list[str]], most: int = 8) -> DataFrame:
    """conv_id, turn, gap, words and suggestion of questions on topics that no document mentions, and of questions without citations: the
    first eight gaps of a question, with a suggestion for the first four.

    Down-rated feedback gives one row for each failure type, with conv_id -1 and its number as turn. The corpus is read once, and
    only its topics (a bounded list) leave the tasks.
    """
    hits = lambda text: F.filter(F.array(*[F.struct(F.lit(t).alias("topic"), F.filter(F.array(*[F.lit(w) for w in sorted(ws)]), lambda w: F.contains(text, w)).alias("words")) for t, ws in topics.items()]), lambda x: F.size(x["words"]) > 0)
    known = docs.select(F.explode(hits(F.lower(F.concat_ws("\n", "source", "text")))).alias("t")).select("t.topic").distinct()
    asked = questions.select("conv_id", "turn", F.explode(hits(F.lower("question"))).alias("t")).select("conv_id", "turn", F.col("t.topic").alias("topic"), F.col("t.words").alias("words"))
    missing = asked.join(F.broadcast(known), "topic", "left_anti").select("conv_id", "turn", F.col("topic").alias("gap"), "words", F.concat(F.lit("add material on "), "topic").alias("suggestion"), F.lit(0).alias("last"))
    bare = questions.join(cited, "conv_id", "left_anti").select("conv_id", "turn", F.lit("direct evidence").alias("gap"), F.slice(F.array_sort(F.array_distinct(tx.tokenize(F.lower("question")))), 1, 8).alias("words"), F.lit("import closer sources, or ask for one fact at a time").alias("suggestion"), F.lit(1).alias("last"))
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("last", "gap"))
    gaps = missing.unionByName(bare).withColumn("place", place).where(F.col("place") <= most).withColumn("suggestion", F.when(F.col("place") <= 4, F.col("suggestion"))).drop("last", "place")
    kind = F.coalesce(F.nullif("failure_type", F.lit("")), F.lit("unclassified"))
    told = feedback.where("rating = 'down'").groupBy(kind.alias("kind")).agg(F.count("*").cast("int").alias("turn"))
    advice = F.when(F.col("kind") == "retrieval_miss", "make cases of the misses and compare profiles").when(F.col("kind") == "wrong_citation", "check the context of citations")
    told = told.select(F.lit(-1).alias("conv_id"), "turn", F.concat(F.lit("feedback: "), "kind").alias("gap"), F.array().cast("array<string>").alias("words"), advice.alias("suggestion"))
    return gaps.unionByName(told)


def status_counts(jobs: DataFrame, statuses: list[str], waiting: tuple[str, ...], max_failures: int) -> DataFrame:
    """Jobs of each known status, none included, with the depth of the queue and the jobs that failed too often."""
    known = jobs.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    counts = jobs.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))
    depth = jobs.agg(F.count_if(F.col("event_type").isin(*waiting)).alias("queue_depth"))
    dead = jobs.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") >= max_failures).alias("dead_letters"))
    return known.join(counts, "status", "left").na.fill(0, ["n"]).crossJoin(depth).crossJoin(dead)  # one row each


def licensed_only(docs: DataFrame, allowed: list[str]) -> DataFrame:
    """docs with licensed: a license (license) of the list and its URL (license_url); for the others the failure."""
    name = F.lower(F.trim("license"))
    failure = F.when(name.isNull() | (name == ""), "no_license").when(~name.isin(*allowed), "not_allowed").when(F.coalesce(F.trim("license_url"), F.lit("")) == "", "no_url")
    return docs.withColumn("failure", failure).withColumn("license", name).withColumn("licensed", F.col("failure").isNull())


def real_usage(messages: DataFrame) -> DataFrame:
    """User messages with a text whose metadata (JSON) attest a human origin, a user and a workspace."""
    field = lambda name: F.coalesce(F.trim(F.get_json_object("meta", f"$.{name}")), F.lit(""))
    real = (field("origin") == "human") & (field("user_id") != "") & (field("workspace_id") != "")
    return messages.where((F.col("role") == "user") & real & (F.trim(F.coalesce("text", F.lit(""))) != "")).withColumn("user_id", field("user_id"))


def verify_manifest(manifest: DataFrame, least: int) -> DataFrame:
    """What is wrong with each row (declared, actual, url, license), and whether the manifest has rows enough."""
    same = lambda key, out: manifest.groupBy(key).agg(F.count("*").alias(out))
    rows = manifest.join(same("actual", "same"), "actual").join(same("url", "same_url"), "url").crossJoin(F.broadcast(manifest.agg((F.count("*") >= least).alias("enough"))))  # one row
    flags = {
        "checksum_mismatch": F.col("declared") != F.col("actual"), "duplicate_hash": F.col("same") > 1, "missing_url": F.col("url") == "",
        "duplicate_url": (F.col("url") != "") & (F.col("same_url") > 1), "missing_license": F.coalesce("license", F.lit("")) == "",
    }
    rows = rows.withColumns(flags)
    wrong = F.col("checksum_mismatch") | F.col("duplicate_hash") | F.col("missing_url") | F.col("duplicate_url") | F.col("missing_license")
    return rows.select("doc_id", *flags, "enough", (~wrong & F.col("enough")).alias("valid"))


def verify_copies(assets: DataFrame, objects: DataFrame) -> DataFrame:
    """Whether each asset's object (object_key) is safe to name, described alike by all assets, there, and of the same size and digest."""
    told = assets.groupBy("object_key").agg((F.count_distinct("size", "digest") == 1).alias("agrees"))
    rows = assets.join(told, "object_key").join(objects.select("object_key", F.col("size").alias("stored"), F.col("digest").alias("found")), "object_key", "left")
    size, digest = F.coalesce(F.col("stored") == F.col("size"), F.lit(False)), F.coalesce(F.col("found") == F.col("digest"), F.lit(False))
    unsafe = F.regexp_like("object_key", F.lit(r"\.\.|^/|\\\\"))
    return rows.select("doc_id", unsafe.alias("unsafe"), "agrees", F.col("stored").isNotNull().alias("present"), size.alias("same_size"), digest.alias("same_digest"), (~unsafe & F.col("agrees") & size & digest).alias("valid"))


def corpus_pick(files: DataFrame, per_source: int, target: int, least_sources: int) -> DataFrame:
    """The first files (source, path, doc_id) of each source, Chinese ones, docs and readmes first; then the first of all in turn.

    enough_sources: whether those taken come from so many sources.
    """
    has = lambda word: F.when(F.contains(F.lower("path"), F.lit(word)), 0).otherwise(1)
    n = F.row_number().over(Window.partitionBy("source").orderBy(has("zh-cn"), has("docs/"), has("readme"), "path", "doc_id"))
    taken = files.withColumn("n", n).where(F.col("n") <= per_source).orderBy("n", "source", "doc_id").limit(target)
    return taken.select("source", "doc_id", "n", (F.size(F.collect_set("source").over(Window.partitionBy())) >= least_sources).alias("enough_sources"))  # target rows
