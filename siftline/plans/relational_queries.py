"""Queries over joins, aggregates and set operations of the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.operators import registry_ops as ops
from siftline.operators.graph import graph_summary
from siftline.plans.graph_queries import _EDGES, edge_tables, parts
from siftline.plans.registry import query
from siftline.plans.sql import CHUNKS, tok
from siftline.sources.scratch import written
from siftline.sources.tables import chunk_table, parts_for, scan_documents, table

S = SparkSession


@query("SRC-13", f"WITH {CHUNKS} SELECT chunk_id, document_id FROM chunks WHERE document_id NOT IN (SELECT doc_id::VARCHAR FROM labels WHERE toxic = 1)")
def src13(spark: S, sf: str) -> DataFrame:
    toxic = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("document_id"))
    return chunk_table(spark, sf).join(toxic, "document_id", "left_anti").select("chunk_id", "document_id")


@query("JN-03", "SELECT n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name")
def jn03(spark: S, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").join(table(spark, sf, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.groupBy("n_name").agg(F.count("c_custkey").alias("customers"))


@query("JN-04", "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY 1 ORDER BY last_turn DESC, conv_id LIMIT 50")
def jn04(spark: S, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))
    return rows.orderBy(F.desc("last_turn"), "conv_id").limit(50)


@query("JN-05", f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE document_id NOT IN (SELECT doc_id::VARCHAR FROM labels)")
def jn05(spark: S, sf: str) -> DataFrame:
    known = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("document_id"))
    return chunk_table(spark, sf).join(known, "document_id", "left_anti").select("chunk_id")


@query("JN-06", "SELECT doc_id FROM documents WHERE lang <> 'de' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def jn06(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("lang <> 'de'").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("JN-07", """WITH d AS (SELECT doc_id, lang AS provider, source AS model, CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 4 = 1 THEN 128 ELSE 256 END AS dimension FROM documents)
SELECT doc_id, list_sort(list_filter([CASE WHEN provider <> '' AND provider <> 'en' THEN 'provider' END, CASE WHEN model <> '' AND model <> 'src0' THEN 'model' END, CASE WHEN dimension <> 0 AND dimension <> 256 THEN 'dimension' END], lambda x: x IS NOT NULL)) AS mismatches FROM d
WHERE provider <> 'en' OR model <> 'src0' OR dimension = 128""")
def jn07(spark: S, sf: str) -> DataFrame:
    dimension = F.when(F.col("doc_id") % 4 == 0, 0).when(F.col("doc_id") % 4 == 1, 128).otherwise(256)
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("provider"), F.col("source").alias("model"), dimension.cast("string").alias("dimension"))
    return ops.index_mismatch(docs, {"provider": "en", "model": "src0", "dimension": "256"})


_NEW = """items AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 4 <> 0), candidates AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5(text || 'x') ELSE md5(text) END AS h FROM documents WHERE doc_id % 5 <> 0),
diff AS (SELECT coalesce(i.doc_id, c.doc_id) AS doc_id, CASE WHEN c.doc_id IS NULL THEN 'missing' WHEN i.doc_id IS NULL THEN 'new' WHEN i.h = c.h THEN 'unchanged' ELSE 'updated' END AS action FROM items i FULL JOIN candidates c ON i.doc_id = c.doc_id)"""


def snapshots(spark: S, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    items = docs.where("doc_id % 4 <> 0").select("doc_id", F.md5("text").alias("content_hash"))
    fresh = F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text"))
    return ops.diff_snapshot(items, docs.where("doc_id % 5 <> 0").select("doc_id", fresh.alias("content_hash")))


@query("JN-08", f"WITH {_NEW} SELECT * FROM diff")
def jn08(spark: S, sf: str) -> DataFrame:
    return snapshots(spark, sf)


@query("JN-10", """WITH f AS (SELECT lang, md5(text) AS h, min(doc_id) AS first_id FROM documents GROUP BY 1, 2) SELECT d.doc_id, f.first_id AS existing_id, d.doc_id <> f.first_id AS duplicate FROM documents d JOIN f ON d.lang = f.lang AND md5(d.text) = f.h""")
def jn10(spark: S, sf: str) -> DataFrame:
    return ops.dedupe_against_index(table(spark, sf, "documents"))


@query("JN-11", """SELECT 'lineitem.orders' AS relation, count(*) AS total, count(o_orderkey) AS joined, count(*) - count(o_orderkey) AS violations FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'documents.labels', count(*), count(l.doc_id), count(*) - count(l.doc_id) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def jn11(spark: S, sf: str) -> DataFrame:
    a = ops.referential_integrity("lineitem.orders", table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")))
    b = ops.referential_integrity("documents.labels", table(spark, sf, "documents").select(F.col("doc_id").alias("k")), table(spark, sf, "labels").select(F.col("doc_id").alias("k")))
    return a.unionByName(b)


@query("JN-13", "SELECT l.doc_id, l.toxic, d.source FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id AND d.lang = 'en'")
def jn13(spark: S, sf: str) -> DataFrame:
    english = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", "source")
    return table(spark, sf, "labels").join(english, "doc_id", "left").select("doc_id", "toxic", "source")


@query("JN-14", "WITH s AS (SELECT DISTINCT lang, source FROM documents) SELECT a.lang, a.source AS a, b.source AS b FROM s a JOIN s b ON a.lang = b.lang AND a.source < b.source")
def jn14(spark: S, sf: str) -> DataFrame:
    return ops.seed_pairs(table(spark, sf, "documents").select("lang", "source").distinct())


@query("JN-15", "WITH a AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 3 <> 1) SELECT count(*) AS hashes, count(*) FILTER (WHERE a.h IS NULL) AS only_manifest, count(*) FILTER (WHERE b.h IS NULL) AS only_indexed, bool_and(a.h IS NOT NULL AND b.h IS NOT NULL) AS same FROM a FULL JOIN b ON a.h = b.h")
def jn15(spark: S, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return ops.match_hashes(docs.where("doc_id % 3 <> 0").select(F.md5("text").alias("h")), docs.where("doc_id % 3 <> 1").select(F.md5("text").alias("h")))


@query("SET-07", "SELECT 'indexed' AS side, h FROM (SELECT md5(text) AS h FROM documents WHERE doc_id % 3 <> 0 EXCEPT SELECT md5(text) FROM documents WHERE doc_id % 3 <> 1) UNION ALL SELECT 'manifest', h FROM (SELECT md5(text) AS h FROM documents WHERE doc_id % 3 <> 1 EXCEPT SELECT md5(text) FROM documents WHERE doc_id % 3 <> 0)")
def set07(spark: S, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    a, b = docs.where("doc_id % 3 <> 0").select(F.md5("text").alias("h")), docs.where("doc_id % 3 <> 1").select(F.md5("text").alias("h"))
    side = lambda df, name: df.select(F.lit(name).alias("side"), "h")
    return side(a.subtract(b), "indexed").unionByName(side(b.subtract(a), "manifest"))


@query("SET-02", "SELECT doc_id, 'saved' AS origin, quality::VARCHAR AS note FROM labels UNION ALL SELECT doc_id, 'feedback', NULL FROM documents WHERE source = 'src1'")
def set02(spark: S, sf: str) -> DataFrame:
    saved = table(spark, sf, "labels").select("doc_id", F.lit("saved").alias("origin"), F.col("quality").cast("string").alias("note"))
    return saved.unionByName(table(spark, sf, "documents").where("source = 'src1'").select("doc_id", F.lit("feedback").alias("origin")), allowMissingColumns=True)


@query("AGG-10", "SELECT count(*) AS questions, greatest(0, 1000 - count(*)) AS remaining, count(DISTINCT conv_id) AS conversations, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations WHERE role = 'user' AND length(text) > 0")
def agg10(spark: S, sf: str) -> DataFrame:
    asked = table(spark, sf, "conversations").where("role = 'user' AND length(text) > 0")
    return asked.agg(F.count("*").alias("questions"), F.greatest(F.lit(0), 1000 - F.count("*")).alias("remaining"), F.count_distinct("conv_id").alias("conversations"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("AGG-12", "SELECT event_type AS name, substr(props, 1, 80) AS labels, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def agg12(spark: S, sf: str) -> DataFrame:
    return ops.metric_counters(table(spark, sf, "events"))


_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


@query("FLT-05", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '\\.html$') AND NOT regexp_matches(url, '/(test|vendor|changelog)') AND strlen(html) BETWEEN 800 AND 200000")
def flt05(spark: S, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return pages.where(F.regexp_like("url", F.lit(r"\.html$")) & ~F.regexp_like("url", F.lit("/(test|vendor|changelog)")) & F.octet_length("html").between(800, 200_000)).select("page_id", "url")


@query("FLT-04", "WITH j AS (SELECT event_id, event_type, ts + to_seconds(3600) AS lease FROM events WHERE event_type IN ('view', 'click')) SELECT event_id, CASE WHEN event_type = 'click' THEN 'cancelled' ELSE 'queued' END AS next_status FROM j WHERE lease <= TIMESTAMP '2024-01-15 00:00:00'")
def flt04(spark: S, sf: str) -> DataFrame:
    jobs = table(spark, sf, "events").where(F.col("event_type").isin("view", "click")).withColumn("lease", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    return jobs.where("lease <= TIMESTAMP_NTZ'2024-01-15 00:00:00'").select("event_id", F.when(F.col("event_type") == "click", "cancelled").otherwise("queued").alias("next_status"))


@query("FLT-03", "SELECT event_id, try_cast(CASE WHEN event_id % 11 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) IS NULL OR ts <= TIMESTAMP '2024-01-10 00:00:00' AS expired FROM events")
def flt03(spark: S, sf: str) -> DataFrame:
    shown = F.when(F.col("event_id") % 11 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return ops.expired(table(spark, sf, "events").withColumn("expires_at", shown), "2024-01-10 00:00:00").select("event_id", "expired")


_SENT = """incoming AS (SELECT 1 AS batch, vec_id, label + 100 AS label, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN embedding[1:9] ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 3 = 0
UNION ALL SELECT 2, CASE WHEN vec_id % 12 = 0 THEN -1 - vec_id ELSE vec_id END, label + 200, embedding FROM embeddings WHERE vec_id % 6 = 0)"""


@query("SRC-12", f"""WITH {_SENT}, every AS (SELECT 0 AS batch, vec_id, label, embedding FROM embeddings UNION ALL SELECT * FROM incoming),
good AS (SELECT vec_id, batch, label FROM every WHERE len(embedding) = (SELECT max(len(embedding)) FROM embeddings))
SELECT vec_id, max(batch) AS batch, arg_max(label, batch) AS label, 'stored' AS status FROM good GROUP BY vec_id UNION ALL SELECT vec_id, batch, label, 'rejected' FROM incoming WHERE embedding IS NULL OR len(embedding) <> (SELECT max(len(embedding)) FROM embeddings)""")
def src12(spark: S, sf: str) -> DataFrame:
    """Two batches: in the first some vectors are short or absent, the second brings new ids as well."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    broken = F.when(F.col("vec_id") % 11 == 0, None).when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 9)).otherwise(F.col("embedding"))
    one = vectors.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"), broken.alias("embedding"), F.lit(1).alias("batch"))
    ident = F.when(F.col("vec_id") % 12 == 0, -1 - F.col("vec_id")).otherwise(F.col("vec_id"))
    two = vectors.where("vec_id % 6 = 0").select(ident.alias("vec_id"), (F.col("label") + 200).alias("label"), "embedding", F.lit(2).alias("batch"))
    dim = vectors.agg(F.max(F.size("embedding"))).first()[0]
    stored, rejected = ops.upsert_vectors(vectors, one.unionByName(two), "vec_id", dim or 0)
    return stored.select("vec_id", "batch", "label", F.lit("stored").alias("status")).unionByName(rejected.select("vec_id", "batch", "label", F.lit("rejected").alias("status")))


@query("SRC-14", """WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
m AS (SELECT conv_id, turn, '## ' || role || chr(10) || text || CASE WHEN before IS NULL THEN '' ELSE chr(10) || '[1] ' || substr(before, 1, 600) || CASE WHEN turn % 2 = 1 THEN ' (page ' || turn || ')' ELSE '' END || chr(10) || '[2] ' || substr(text, 1, 600) END AS part FROM t)
SELECT conv_id, '# Conversation ' || conv_id || chr(10) || string_agg(part, chr(10) ORDER BY turn) AS markdown FROM m GROUP BY conv_id""")
def src14(spark: S, sf: str) -> DataFrame:
    """Each turn after the first cites the turn before it, some with a page, and itself."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    cite = lambda text, page: F.struct(text.alias("text"), page.cast("int").alias("page"))
    page = F.when(F.col("turn") % 2 == 1, F.col("turn"))
    turns = table(spark, sf, "conversations").withColumn("before", before)
    cited = F.when(F.col("before").isNotNull(), F.array(cite(F.col("before"), page), cite(F.coalesce("text", F.lit("")), F.lit(None))))
    return ops.export_markdown(turns.withColumn("citations", cited))


_OLDER = "older AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), source AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders)"


@query("SRC-16", f"""WITH {_OLDER}, target AS (SELECT * FROM source UNION ALL SELECT * FROM older WHERE o_orderkey NOT IN (SELECT o_orderkey FROM source)),
same AS (SELECT NOT EXISTS (SELECT * FROM source EXCEPT SELECT * FROM older) AND NOT EXISTS (SELECT * FROM older EXCEPT SELECT * FROM source) AS a, NOT EXISTS (SELECT * FROM source EXCEPT SELECT * FROM target) AND NOT EXISTS (SELECT * FROM target EXCEPT SELECT * FROM source) AS b)
SELECT step, source_rows, target_rows, same FROM (SELECT 'before' AS step, (SELECT count(*) FROM source) AS source_rows, (SELECT count(*) FROM older) AS target_rows, a AS same FROM same UNION ALL SELECT 'after', (SELECT count(*) FROM source), (SELECT count(*) FROM target), b FROM same)""")
def src16(spark: S, sf: str) -> DataFrame:
    """The orders into an older copy, in which a third of them is absent and some prices differ."""
    source = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    price = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return ops.copy_verified(source, source.where("o_orderkey % 3 <> 0").withColumn("o_totalprice", price), ["o_orderkey"])


_ROW = """'{"o_custkey":"' || o_custkey || '","o_orderkey":"' || o_orderkey || '","o_orderstatus":"' || o_orderstatus || '","o_totalprice":"' || CAST(o_totalprice AS DECIMAL(18, 2)) || '"}'"""


@query("AGG-16", f"WITH h AS (SELECT sha256({_ROW}) AS h FROM orders) SELECT count(*) AS rows, " + " || '-' || ".join(f"coalesce(sum(('0x' || substr(h, {1 + 12 * i}, 12))::BIGINT)::HUGEINT, 0)::VARCHAR" for i in range(5)) + " AS digest FROM h")
def agg16(spark: S, sf: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return ops.content_fingerprint(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", price.alias("o_totalprice")))


@query("AGG-17", f"""WITH {_NEW}, f AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), d AS (SELECT diff.doc_id, action, f.doc_id IS NOT NULL AS failed FROM diff LEFT JOIN f ON diff.doc_id = f.doc_id),
c AS (SELECT count(*) FILTER (WHERE action <> 'missing') AS discovered, count(*) FILTER (WHERE action = 'unchanged' AND NOT failed) AS unchanged, count(*) FILTER (WHERE action = 'updated' AND NOT failed) AS updated, count(*) FILTER (WHERE action = 'new' AND NOT failed) AS added,
count(*) FILTER (WHERE action <> 'missing' AND failed) AS failed, count(*) FILTER (WHERE action = 'missing') AS deletions FROM d)
SELECT *, CASE WHEN failed = 0 THEN 'succeeded' WHEN failed < discovered THEN 'partial' ELSE 'failed' END AS status FROM c""")
def agg17(spark: S, sf: str) -> DataFrame:
    """Toxic documents could not be read."""
    return ops.sync_run_summary(snapshots(spark, sf), table(spark, sf, "labels").where("toxic = 1").select("doc_id"))


@query("AGG-06", f"""WITH {CHUNKS}, n AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1), q AS (SELECT d.doc_id, d.lang, length(text) AS n, CASE l.quality WHEN 1 THEN 90 WHEN 0 THEN 60 ELSE 80 END AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
worst AS (SELECT lang, list(doc_id ORDER BY r) AS low_documents FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY q, doc_id) AS r FROM q WHERE q < 70) WHERE r <= 5 GROUP BY 1),
theme AS (SELECT lang, list(token ORDER BY n) AS themes FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, token) AS n FROM (SELECT lang, token, count(*) AS c FROM (SELECT lang, unnest({tok('text')}) AS token FROM documents) WHERE length(token) >= 2 GROUP BY 1, 2)) WHERE n <= 12 GROUP BY 1),
asked AS (SELECT list(text ORDER BY conv_id DESC, turn DESC) AS recent FROM (SELECT * FROM conversations WHERE role = 'user' AND text <> '' ORDER BY conv_id DESC, turn DESC LIMIT 6))
SELECT q.lang, count(*) AS documents, coalesce(sum(n.n), 0)::BIGINT AS chunks, sum(q.n)::BIGINT AS chars, round(avg(q), 6) AS mean_quality, count(*) FILTER (WHERE q >= 85) AS high, count(*) FILTER (WHERE q >= 70 AND q < 85) AS medium, count(*) FILTER (WHERE q < 70) AS low,
any_value(low_documents) AS low_documents, any_value(themes) AS themes, (SELECT recent FROM asked) AS recent, CASE WHEN count(*) FILTER (WHERE q < 70) > 0 THEN 'review low quality' ELSE 'none' END AS suggestion
FROM q LEFT JOIN n ON q.doc_id::VARCHAR = n.document_id LEFT JOIN worst ON q.lang = worst.lang LEFT JOIN theme ON q.lang = theme.lang GROUP BY q.lang""")
def agg06(spark: S, sf: str) -> DataFrame:
    return ops.corpus_overview(table(spark, sf, "documents"), table(spark, sf, "labels"), chunk_table(spark, sf), table(spark, sf, "conversations"))


_JOBS = "jobs AS (SELECT user_id AS job_id, event_type AS status, count(*) AS attempts, max(event_id) AS last FROM events GROUP BY 1, 2)"


@query("AGG-07", f"""WITH {_JOBS} SELECT 'knowledge' AS block, 'documents' AS name, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'knowledge', 'characters', sum(length(text)) FROM documents
UNION ALL SELECT 'answering', 'questions', count(*) FILTER (WHERE role = 'user') FROM conversations UNION ALL SELECT 'answering', 'answers', count(*) FILTER (WHERE role = 'assistant') FROM conversations UNION ALL SELECT 'answering', 'mean_length', round(avg(length(text)) FILTER (WHERE role = 'assistant'), 6) FROM conversations
UNION ALL SELECT 'operations', 'total', count(*) FROM events UNION ALL SELECT 'operations', 'errors', count(*) FILTER (WHERE event_type = 'error') FROM events UNION ALL SELECT 'operations', 'mean_value', round(avg(value), 6) FROM events UNION ALL SELECT 'operations', 'users', count(DISTINCT user_id) FROM events
UNION ALL SELECT 'type', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'level', CASE WHEN value < 1 THEN 'low' WHEN value < 10 THEN 'normal' ELSE 'high' END, count(*) FROM events GROUP BY 2
UNION ALL SELECT 'ingestion', 'jobs', count(*) FROM jobs UNION ALL SELECT 'ingestion', 'retries', sum(greatest(0, attempts - 1)) FROM jobs UNION ALL SELECT 'graph', name, value FROM (UNPIVOT (SELECT sum(nodes)::DOUBLE AS nodes, sum(edges)::DOUBLE AS edges, sum(mentions)::DOUBLE AS mentions, sum(evidence)::DOUBLE AS evidence FROM (WITH {_EDGES} SELECT * FROM summary)) ON nodes, edges, mentions, evidence INTO NAME name VALUE value)
UNION ALL SELECT 'recommendation', 'check_errors', (count(*) FILTER (WHERE event_type = 'error') * 20 > count(*))::INT FROM events UNION ALL SELECT 'recommendation', 'check_retries', (sum(greatest(0, attempts - 1)) > count(*))::INT FROM jobs""")
def agg07(spark: S, sf: str) -> DataFrame:
    jobs = table(spark, sf, "events").groupBy(F.col("user_id").alias("job_id"), F.col("event_type").alias("status")).agg(F.count("*").alias("attempts"))
    rows, edges = edge_tables(spark, sf)
    return ops.system_metrics(table(spark, sf, "events"), table(spark, sf, "documents"), table(spark, sf, "conversations"), jobs, graph_summary(rows, parts(spark, sf), edges))


_KIND = "coalesce(nullif(CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'quality' ELSE '' END, ''), 'unclassified')"


@query("AGG-08", f"""WITH f AS (SELECT doc_id, quality, {_KIND} AS failure_type FROM labels), r AS (SELECT failure_type, list(doc_id ORDER BY n) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY failure_type ORDER BY doc_id DESC) AS n FROM f) WHERE n <= 8 GROUP BY 1)
SELECT failure_type, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS up, count(*) FILTER (WHERE quality = 0) AS down, any_value(recent) AS recent FROM f JOIN r USING (failure_type) GROUP BY 1""")
def agg08(spark: S, sf: str) -> DataFrame:
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "quality").otherwise("")
    return ops.feedback_stats(table(spark, sf, "labels").withColumn("failure_type", kind))


@query("AGG-09", """WITH m AS (SELECT *, '{"timing": {"first_token_ms": ' || (turn * 10 + length(coalesce(text, '')) % 7) || '}}' AS meta FROM conversations WHERE role = 'assistant' ORDER BY conv_id DESC, turn DESC LIMIT 100)
SELECT count(*) AS messages, count(*) FILTER (WHERE turn % 5 = 3) AS cancelled, count(*) FILTER (WHERE text IS NULL OR text = '') AS failed, round(avg((meta ->> '$.timing.first_token_ms')::INT), 6) AS mean_first_token_ms, round(avg(length(text)), 6) AS mean_chars FROM m""")
def agg09(spark: S, sf: str) -> DataFrame:
    """The last 100 answers; every fifth turn counts as cancelled, and the first token's time is in nested JSON."""
    timing = F.to_json(F.struct(F.struct((F.col("turn") * 10 + F.length(F.coalesce("text", F.lit(""))) % 7).alias("first_token_ms")).alias("timing")))
    status = F.when(F.col("turn") % 5 == 3, "cancelled").when(F.coalesce("text", F.lit("")) == "", "failed").otherwise("done")
    turns = table(spark, sf, "conversations").where("role = 'assistant'")
    return ops.conversation_metrics(turns.select("conv_id", "turn", "text", timing.alias("meta"), (F.col("turn") % 5 == 3).alias("cancelled"), status.alias("status")), 100)


@query("AGG-11", "SELECT count(*) AS total, count(*) FILTER (WHERE quality IS NULL) AS draft, count(*) FILTER (WHERE quality IS NOT NULL) AS reviewed, count(*) FILTER (WHERE quality IS NOT NULL AND toxic = 0) AS human_reviewed, greatest(0, 200 - count(*) FILTER (WHERE quality IS NOT NULL AND toxic = 0)) AS remaining FROM documents LEFT JOIN labels USING (doc_id)")
def agg11(spark: S, sf: str) -> DataFrame:
    """Labelled documents are reviewed cases, those not toxic by a person."""
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    human = F.count_if(F.col("quality").isNotNull() & (F.col("toxic") == 0))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("quality").isNull()).alias("draft"), F.count_if(F.col("quality").isNotNull()).alias("reviewed"), human.alias("human_reviewed"), F.greatest(F.lit(0), 200 - human).alias("remaining"))


@query("AGG-13", "WITH v AS (SELECT event_type, greatest(value, 0) AS v FROM events), b AS (" + " UNION ALL ".join(f"SELECT event_type, '{b}' AS le, count(*) FILTER (WHERE v <= {b}) AS n FROM v GROUP BY 1" for b in _BUCKETS) + " UNION ALL SELECT event_type, '+Inf', count(*) FROM v GROUP BY 1), s AS (SELECT event_type, round(sum(v), 4) AS total FROM v GROUP BY 1) SELECT event_type, le, n, total FROM b JOIN s USING (event_type)")
def agg13(spark: S, sf: str) -> DataFrame:
    return ops.metric_histogram(table(spark, sf, "events"), _BUCKETS)


_STATE = lambda vectors, docs: f"""SELECT (SELECT count(*) FROM {vectors}) AS vectors, (SELECT count(DISTINCT vec_id) FROM {vectors}) AS ids, (SELECT list_sort(list(DISTINCT len(embedding))) FROM {vectors}) AS dimensions, (SELECT count(*) FROM {docs}) AS documents,
(SELECT count(*) FROM labels JOIN {docs} USING (doc_id)) AS joined_citations, (SELECT min(doc_id) FROM {docs}) AS sample_id, (SELECT md5(text) FROM {docs} ORDER BY doc_id LIMIT 1) AS sample_hash"""  # noqa: E731


@query("AGG-15", f"""WITH fewer AS (SELECT * FROM embeddings WHERE vec_id % 50 <> 7), edited AS (SELECT doc_id, CASE WHEN doc_id = (SELECT min(doc_id) FROM documents) THEN text || '!' ELSE text END AS text FROM documents),
s AS (SELECT 'moved' AS change, * FROM ({_STATE('embeddings', 'documents')}) UNION ALL SELECT 'vectors lost', * FROM ({_STATE('fewer', 'documents')}) UNION ALL SELECT 'text edited', * FROM ({_STATE('embeddings', 'edited')})),
b AS (SELECT * FROM ({_STATE('embeddings', 'documents')})) SELECT s.*, EXISTS (SELECT 1 FROM b WHERE b.vectors = s.vectors AND b.ids = s.ids AND b.dimensions = s.dimensions AND b.documents = s.documents AND b.joined_citations = s.joined_citations AND b.sample_id = s.sample_id AND b.sample_hash = s.sample_hash) AS same_as_before FROM s""")
def agg15(spark: S, sf: str) -> DataFrame:
    """The state before, against that after the tables were written anew, after vectors were lost and after a text was edited."""
    vectors, docs, labels = table(spark, sf, "embeddings"), table(spark, sf, "documents"), table(spark, sf, "labels")
    before = written(ops.consistency_snapshot(vectors, docs, labels), "before")
    first = docs.agg(F.min("doc_id").alias("first"))
    edited = docs.crossJoin(F.broadcast(first)).withColumn("text", F.when(F.col("doc_id") == F.col("first"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))).drop("first")  # one row
    changes = {"moved": (written(vectors, "vectors"), written(docs.repartition(parts_for(docs)), "documents")), "vectors lost": (vectors.where("vec_id % 50 <> 7"), docs), "text edited": (vectors, edited)}
    out = None
    for change, (v, d) in changes.items():
        one = ops.compare_snapshots(before, ops.consistency_snapshot(v, d, labels)).withColumn("change", F.lit(change))
        out = one if out is None else out.unionByName(one)
    return out


_STATUSES = ("view", "click", "purchase", "error", "signup", "paused")


@query("AGG-20", "WITH s(status) AS (VALUES " + ", ".join(f"('{x}')" for x in _STATUSES) + "), d AS (SELECT count(*) FILTER (WHERE n >= 3) AS dead FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)) SELECT status, count(event_id) AS n, (SELECT count(*) FROM events WHERE event_type IN ('view', 'click')) AS queue_depth, (SELECT dead FROM d) AS dead_letters FROM s LEFT JOIN events ON event_type = status GROUP BY 1")
def agg20(spark: S, sf: str) -> DataFrame:
    """Users are jobs: views and clicks wait, and three errors make a dead letter."""
    return ops.status_counts(table(spark, sf, "events"), list(_STATUSES), ("view", "click"), 3)


#: Topics and the words that show them, in questions and in documents.
_TOPICS = {"deployment": ["docker", "there"], "database": ["schema", "thand"], "interface": ["api", "ering"], "performance": ["latency", "ation"], "tests": ["test", "recall"], "security": ["token", "der"], "media": ["ocr", "video"]}


_FAILED = "CASE WHEN toxic = 1 THEN 'wrong_citation' WHEN doc_id % 3 = 0 THEN 'retrieval_miss' ELSE 'unclassified' END"


@query("AGG-19", "WITH t(topic, word) AS (VALUES " + ", ".join(f"('{t}', '{w}')" for t, ws in _TOPICS.items() for w in ws) + """), q AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS question FROM conversations WHERE role = 'user'),
corpus AS (SELECT DISTINCT topic FROM t JOIN documents ON doc_id % 2 = 0 AND contains(lower(source || chr(10) || text), word)),
hit AS (SELECT conv_id, turn, topic, list_sort(list(word)) AS words FROM q JOIN t ON contains(question, word) GROUP BY 1, 2, 3),
cited AS (SELECT DISTINCT conv_id FROM conversations JOIN labels ON doc_id = conv_id),
g AS (SELECT conv_id, turn, topic AS gap, words, 'add material on ' || topic AS suggestion, 0 AS last FROM hit WHERE topic NOT IN (SELECT topic FROM corpus) UNION ALL SELECT conv_id, turn, 'direct evidence', list_sort(list_distinct(""" + tok("question") + """))[1:8], 'import closer sources, or ask for one fact at a time', 1 FROM q WHERE conv_id NOT IN (SELECT conv_id FROM cited)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY last, gap) AS place FROM g)
SELECT conv_id, turn, gap, words, CASE WHEN place <= 4 THEN suggestion END AS suggestion FROM p WHERE place <= 8
UNION ALL SELECT -1, count(*)::INT, 'feedback: ' || """ + _FAILED + """, [], CASE """ + _FAILED + """ WHEN 'retrieval_miss' THEN 'make cases of the misses and compare profiles' WHEN 'wrong_citation' THEN 'check the context of citations' END FROM labels WHERE quality = 0 GROUP BY """ + _FAILED)
def agg19(spark: S, sf: str) -> DataFrame:
    """User turns are questions, even documents the corpus, labels the feedback and, by number, the citations of a conversation."""
    asked = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"))
    labels = table(spark, sf, "labels")
    kind = F.when(F.col("toxic") == 1, "wrong_citation").when(F.col("doc_id") % 3 == 0, "retrieval_miss").otherwise("")
    feedback = labels.select(F.when(F.col("quality") == 0, "down").otherwise("up").alias("rating"), kind.alias("failure_type"))
    return ops.knowledge_gaps(asked, table(spark, sf, "documents").where("doc_id % 2 = 0"), labels.select(F.col("doc_id").alias("conv_id")).distinct(), feedback, _TOPICS)


_LICENSE = "CASE doc_id % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN ' apache-2.0 ' WHEN 2 THEN 'proprietary' END"
_LICENSE_URL = "CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'https://licenses.example/' || doc_id END"


@query("FLT-06", f"""WITH d AS (SELECT doc_id, lower(trim({_LICENSE})) AS license, {_LICENSE_URL} AS url FROM documents)
SELECT doc_id, license, coalesce(license IN ('mit', 'apache-2.0', 'bsd-3-clause', 'cc-by-4.0'), false) AND url <> '' AS licensed, CASE WHEN license IS NULL THEN 'no_license' WHEN license NOT IN ('mit', 'apache-2.0', 'bsd-3-clause', 'cc-by-4.0') THEN 'not_allowed' WHEN url = '' THEN 'no_url' END AS failure FROM d""")
def flt06(spark: S, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.expr(_LICENSE).alias("license"), F.expr(_LICENSE_URL).alias("license_url"))
    return ops.licensed_only(rows, ["mit", "apache-2.0", "bsd-3-clause", "cc-by-4.0"]).select("doc_id", "license", "licensed", "failure")


_META = """'{"origin": "' || CASE WHEN conv_id % 3 = 0 THEN 'human' ELSE 'test' END || '", "user_id": "' || CASE WHEN conv_id % 4 = 1 THEN '' ELSE 'u' || conv_id END || '", "workspace_id": "w' || turn || '"}'"""


@query("FLT-08", f"SELECT conv_id, turn, 'u' || conv_id AS user_id FROM conversations WHERE role = 'user' AND conv_id % 3 = 0 AND conv_id % 4 <> 1 AND trim(coalesce(text, '')) <> ''")
def flt08(spark: S, sf: str) -> DataFrame:
    """Metadata attest a human, a user and a workspace for some conversations."""
    return ops.real_usage(table(spark, sf, "conversations").withColumn("meta", F.expr(_META))).select("conv_id", "turn", "user_id")


_MANIFEST = "m AS (SELECT doc_id, md5(CASE WHEN doc_id % 50 = 3 THEN text || 'x' ELSE text END) AS declared, md5(text) AS actual, CASE WHEN doc_id % 20 = 7 THEN '' ELSE 'https://files.example/' || (doc_id - doc_id % 10 // 9) END AS url, CASE WHEN doc_id % 30 = 11 THEN NULL ELSE 'mit' END AS license FROM documents)"


@query("EVL-12", f"""WITH {_MANIFEST}, w AS (SELECT *, count(*) OVER (PARTITION BY actual) AS same, count(*) OVER (PARTITION BY url) AS same_url, (SELECT count(*) FROM m) >= 200 AS enough FROM m)
SELECT doc_id, declared <> actual AS checksum_mismatch, same > 1 AS duplicate_hash, url = '' AS missing_url, url <> '' AND same_url > 1 AS duplicate_url, license IS NULL AS missing_license, enough,
declared = actual AND same = 1 AND url <> '' AND same_url = 1 AND license IS NOT NULL AND enough AS valid FROM w""")
def evl12(spark: S, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    declared = F.md5(F.when(F.col("doc_id") % 50 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    url = F.when(F.col("doc_id") % 20 == 7, "").otherwise(F.concat(F.lit("https://files.example/"), (F.col("doc_id") - F.floor(F.col("doc_id") % 10 / 9)).cast("string")))
    license = F.when(F.col("doc_id") % 30 != 11, "mit")
    return ops.verify_manifest(docs.select("doc_id", declared.alias("declared"), F.md5("text").alias("actual"), url.alias("url"), license.alias("license")), 200)


_OBJECT = "CASE WHEN doc_id % 40 = 5 THEN '../' ELSE '' END || md5(text)"


@query("EVL-15", f"""WITH a AS (SELECT {_OBJECT} AS object_key, doc_id, length(text) AS size, sha256(CASE WHEN doc_id % 25 = 4 THEN text || 'x' ELSE text END) AS digest FROM documents), o AS (SELECT {_OBJECT} AS object_key, min(length(text)) AS size, min(sha256(text)) AS digest FROM documents WHERE doc_id % 9 <> 2 GROUP BY 1),
g AS (SELECT object_key, count(DISTINCT (size, digest)) = 1 AS agrees FROM a GROUP BY 1)
SELECT a.doc_id, contains(a.object_key, '..') AS unsafe, agrees, o.object_key IS NOT NULL AS present, coalesce(o.size = a.size, false) AS same_size, coalesce(o.digest = a.digest, false) AS same_digest, NOT contains(a.object_key, '..') AND agrees AND coalesce(o.size = a.size AND o.digest = a.digest, false) AS valid FROM a JOIN g USING (object_key) LEFT JOIN o USING (object_key)""")
def evl15(spark: S, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", F.expr(_OBJECT).alias("object_key"), F.length("text").alias("size"))
    told = F.sha2(F.when(F.col("doc_id") % 25 == 4, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256)
    objects = docs.where("doc_id % 9 <> 2").groupBy("object_key").agg(F.min("size").alias("size"), F.min(F.sha2("text", 256)).alias("digest"))
    return ops.verify_copies(docs.select("doc_id", "object_key", "size", told.alias("digest")), objects)


@query("JN-12", "SELECT l_orderkey, min(l_linenumber) AS first_rank FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) GROUP BY 1")
def jn12(spark: S, sf: str) -> DataFrame:
    wanted = table(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(wanted, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first_rank"))


_PATH = "CASE WHEN doc_id % 7 = 0 THEN 'zh-cn/' WHEN doc_id % 7 < 3 THEN 'docs/' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN 'README.md' ELSE 'page' || doc_id || '.md' END"
_ORDER = "CASE WHEN contains(lower(path), 'zh-cn') THEN 0 ELSE 1 END, CASE WHEN contains(lower(path), 'docs/') THEN 0 ELSE 1 END, CASE WHEN contains(lower(path), 'readme') THEN 0 ELSE 1 END, path, doc_id"


@query("TOP-05", f"""WITH f AS (SELECT doc_id, source, {_PATH} AS path FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_ORDER}) AS n FROM f), c AS (SELECT *, row_number() OVER (ORDER BY n, source, doc_id) AS place FROM r WHERE n <= 10)
SELECT source, doc_id, n, (SELECT count(DISTINCT source) FROM c WHERE place <= 60) >= 5 AS enough_sources FROM c WHERE place <= 60""")
def top05(spark: S, sf: str) -> DataFrame:
    """Ten files of a source at most, 60 in all, from five sources at least."""
    return ops.corpus_pick(table(spark, sf, "documents").select("doc_id", "source", F.expr(_PATH).alias("path")), 10, 60, 5)


@query("SET-03", """WITH b AS (SELECT CASE WHEN doc_id % 10 = 9 THEN ' ' ELSE md5(text) END AS h, doc_id FROM documents WHERE doc_id % 2 = 1), g AS (SELECT h, doc_id, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS n, trim(h) <> '' AND h NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0) AS fresh FROM b)
SELECT h AS candidate_id, doc_id, (SELECT count(*) FROM g WHERE fresh AND n = 1) AS created, (SELECT count(*) FROM g WHERE NOT (fresh AND n = 1)) AS deduped FROM g WHERE fresh AND n = 1""")
def set03(spark: S, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    batch = docs.where("doc_id % 2 = 1").select(F.when(F.col("doc_id") % 10 == 9, " ").otherwise(F.md5("text")).alias("candidate_id"), "doc_id")
    return ops.insert_new(docs.where("doc_id % 2 = 0").select(F.md5("text").alias("candidate_id")), batch, "candidate_id", "doc_id")
