"""Queries over text preparation and scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import scores as sc
from siftline.functions import text as tx
from siftline.operators import corpus
from siftline.plans.registry import query
from siftline.plans.sql import CHARACTERS, CHUNKS, HAN_TEXT, LETTERS, QUESTIONS, WHOLE, hashed, tok
from siftline.sources.tables import blob_inventory, chunk_table, dealt, questions, scan_documents, table, url_list_candidates

S = SparkSession


def docs(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def dealt_docs(spark: S, sf: str) -> DataFrame:
    """The documents for heavy work on each text."""
    return dealt(docs(spark, sf).select("doc_id", "text", "source"))


def han(text: str = "text") -> Column:
    return F.translate(F.lower(text), LETTERS, CHARACTERS[:26])


@query("SRC-01", "SELECT doc_id::VARCHAR AS document_id, lang AS knowledge_base_id, source AS file_name, text FROM documents WHERE lang IN ('en', 'fr')")
def src01(spark: S, sf: str) -> DataFrame:
    return scan_documents(spark, sf, ["en", "fr"])


@query("SRC-05", """WITH f AS (SELECT trim(url) AS url, min(page_id) AS first_seen FROM pages WHERE url <> '' GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY first_seen, url) AS n FROM f)
SELECT url, first_seen, CASE WHEN n <= 100 THEN n END AS position, n > 100 AS over_cap FROM r""")
def src05(spark: S, sf: str) -> DataFrame:
    return url_list_candidates(table(spark, sf, "pages"), 100)


@query("TXT-01", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents""")
def txt01(spark: S, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", tx.normalize_text(F.col("text")).alias("text"))


@query("TXT-02", f"SELECT doc_id, {tok('text')} AS tokens, {tok(HAN_TEXT)} AS han_tokens FROM documents")
def txt02(spark: S, sf: str) -> DataFrame:
    return dealt_docs(spark, sf).select("doc_id", tx.tokenize(F.col("text")).alias("tokens"), tx.tokenize(han()).alias("han_tokens"))


_PHRASE = "text || CASE WHEN doc_id % 3 = 0 THEN ' 重复提交' WHEN doc_id % 3 = 1 THEN ' 重复投递 幂等' ELSE '' END"


@query("TXT-03", f"""WITH t AS (SELECT doc_id, {_PHRASE} AS text FROM documents), k AS (SELECT doc_id, text, {tok('text')} AS t FROM t)
SELECT doc_id, list_concat(t, CASE WHEN contains(text, '重复提交') OR contains(text, '重复投递') THEN list_filter(['幂等', '等键', '幂等键'], lambda x: NOT list_contains(t, x)) ELSE [] END) AS tokens FROM k""")
def txt03(spark: S, sf: str) -> DataFrame:
    tokens = tx.retrieval_tokens(F.expr(_PHRASE))
    return dealt_docs(spark, sf).select("doc_id", F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))


@query("TXT-04", f"""WITH {CHUNKS}, w AS (SELECT chunk_id, {tok('text')} AS w FROM chunks), s AS (SELECT count(*) AS n, round(avg(len(w)), 6) AS avg_len FROM w)
SELECT token, count(DISTINCT chunk_id) AS df, count(*) AS occurrences, n, avg_len FROM (SELECT chunk_id, unnest(w) AS token FROM w), s GROUP BY token, n, avg_len""")
def txt04(spark: S, sf: str) -> DataFrame:
    return corpus.corpus_statistics(chunk_table(spark, sf)).withColumn("avg_len", F.round("avg_len", 6))


@query("TXT-08", f"WITH {CHUNKS} SELECT chunk_id, document_id, chunk_index, text FROM chunks")
def txt08(spark: S, sf: str) -> DataFrame:
    return chunk_table(spark, sf)


@query("TXT-10", f"WITH {WHOLE}, {hashed('v', 'chunks', 'chunk_id', 'text')} SELECT chunk_id, idx, round(value, 6) AS value FROM v")
def txt10(spark: S, sf: str) -> DataFrame:
    chunks = dealt_docs(spark, sf).select(F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("chunk_id"), "text")
    return corpus.hash_embed(chunks, "chunk_id").withColumn("value", F.round("value", 6))


@query("TXT-11", f"""WITH c AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS token FROM documents) WHERE length(token) >= 2 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, token) AS rank FROM c) SELECT doc_id, rank, token, tf FROM r WHERE rank <= 16""")
def txt11(spark: S, sf: str) -> DataFrame:
    return corpus.keywords(dealt_docs(spark, sf), "doc_id")


@query("TXT-12", r"""WITH p AS (SELECT doc_id, text, regexp_split_to_array(regexp_replace(text, '([。！？.!?])\s+', '\1' || chr(10), 'g'), '\n+') AS p FROM documents)
SELECT doc_id, coalesce(list_filter(list_transform(p, lambda x: regexp_replace(x, '^[ #*\-]+|[ #*\-]+$', '', 'g')), lambda x: length(x) >= 12)[1], substr(text, 1, 120)) AS sentence FROM p""")
def txt12(spark: S, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", tx.first_sentence(F.col("text")).alias("sentence"))


@query("TXT-13", r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 90 THEN t ELSE rtrim(substr(t, 1, 90)) || '...' END AS text FROM f""")
def txt13(spark: S, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", tx.truncate_text(F.col("text"), 90).alias("text"))


@query("TXT-15", rf"""WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id - 1, {HAN_TEXT} FROM documents)
SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}]')) / greatest(length(text), 1) >= 0.01 THEN 'zh' ELSE 'en' END AS language FROM t""")
def txt15(spark: S, sf: str) -> DataFrame:
    rows = docs(spark, sf).select("doc_id", "text").unionAll(docs(spark, sf).select((-F.col("doc_id") - 1).alias("doc_id"), han().alias("text")))
    return rows.select("doc_id", tx.detect_language(F.col("text")).alias("language"))


@query("TXT-16", r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(substr(text, 1, 200)), '[^A-Za-z0-9_\x{00c0}-\x{024f}\x{4e00}-\x{9fff}]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents),
c AS (SELECT doc_id, regexp_replace(substr(s, 1, 72), '^-+|-+$', '', 'g') AS s FROM s) SELECT doc_id, CASE WHEN s = '' THEN 'article' ELSE s END AS slug FROM c""")
def txt16(spark: S, sf: str) -> DataFrame:
    title = F.substring("text", 1, 200)  # a title, of which a slug keeps 72 characters
    return docs(spark, sf).select("doc_id", tx.slugify(title).alias("slug"))


@query("TXT-17", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS content_hash FROM documents""")
def txt17(spark: S, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.sha2(tx.normalize_text(F.col("text")), 256).alias("content_hash"))


@query("TXT-18", r"""WITH a AS (SELECT doc_id, regexp_replace(text, '(?i)(authorization\s*:\s*bearer)\s+[^\s,;]+', '\1 [REDACTED]', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '(?i)(["'']?[A-Za-z0-9_-]*(?:api[_-]?key|apikey|credential|token|password|secret)["'']?\s*[:=]\s*)(?:"[^"]*"|''[^'']*''|[^\s,;}\]]+)', '\1[REDACTED]', 'g') AS t FROM a)
SELECT doc_id, substr(regexp_replace(t, '\bsk-[A-Za-z0-9_-]{8,}\b', '[REDACTED]', 'g'), 1, 1000) AS message FROM b""")
def txt18(spark: S, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", tx.redact_secrets(F.col("text")).alias("message"))


_URL = r"'^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#@:]+)(:[0-9]+)?([^?#]*)'"


@query("TXT-19", f"""SELECT page_id, CASE WHEN regexp_matches(url, {_URL}) THEN lower(regexp_extract(url, {_URL}, 1)) || '://' || lower(regexp_extract(url, {_URL}, 2)) || regexp_extract(url, {_URL}, 3)
|| CASE WHEN regexp_extract(url, {_URL}, 4) = '' THEN '/' ELSE regexp_extract(url, {_URL}, 4) END ELSE '[invalid-url]' END AS url FROM pages""")
def txt19(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.sanitize_url(F.col("url")).alias("url"))


_ID = "'(?i)^(?:[0-9a-f]{8}-[0-9a-f-]{27,}|[0-9a-f]{24,}|[A-Za-z0-9_-]{36,}|[0-9]+)$'"


@query("TXT-20", f"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS p FROM pages)
SELECT page_id, '/' || array_to_string(list_transform(list_filter(string_split(string_split(p, '?')[1], '/'), lambda s: s <> ''),
lambda s: CASE WHEN regexp_matches(s, {_ID}) THEN ':id' WHEN length(s) > 80 THEN ':value' ELSE s END), '/') AS path_class FROM p""")
def txt20(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.path_class(F.regexp_replace("url", "^[a-z]+://[^/]*", "")).alias("path_class"))


@query("AGG-03", r"""SELECT doc_id, round(CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[\x{fffd}\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{80}-\x{9f}]')) / length(text) ELSE 0 END, 6) AS weird_ratio FROM documents""")
def agg03(spark: S, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.round(tx.weird_ratio(F.col("text")), 6).alias("weird_ratio"))


@query("AGG-04", rf"""WITH {CHUNKS} SELECT document_id, round(1 - count(DISTINCT trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) / count(*), 6) AS duplicate_ratio FROM chunks GROUP BY 1""")
def agg04(spark: S, sf: str) -> DataFrame:
    return corpus.duplicate_chunk_ratio(chunk_table(spark, sf)).withColumn("duplicate_ratio", F.round("duplicate_ratio", 6))


@query("SCL-01", "SELECT event_id, round(CASE WHEN value - 10 > 0 THEN (value - 10) / (value - 9) ELSE 0 END, 6) AS squashed FROM events")
def scl01(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(sc.squash(F.col("value") - 10), 6).alias("squashed"))


_MODE = "CASE WHEN event_type = 'view' THEN 'keyword' WHEN event_type = 'click' THEN 'semantic' ELSE 'hybrid' END"


@query("SCL-02", f"""WITH e AS (SELECT event_id, {_MODE} AS mode, floor(value / 10) AS a, floor(value / 7) AS b FROM events)
SELECT event_id, CASE mode WHEN 'keyword' THEN 1.0 WHEN 'semantic' THEN 0.0 ELSE CASE WHEN a + b <= 0 THEN 0.62 ELSE round_even(a / (a + b), 4) END END AS w_keyword,
CASE mode WHEN 'keyword' THEN 0.0 WHEN 'semantic' THEN 1.0 ELSE CASE WHEN a + b <= 0 THEN 0.38 ELSE round_even(b / (a + b), 4) END END AS w_vector FROM e""")
def scl02(spark: S, sf: str) -> DataFrame:
    weights = sc.resolve_weights(F.expr(_MODE), F.floor(F.col("value") / 10).cast("double"), F.floor(F.col("value") / 7).cast("double"))
    rows = table(spark, sf, "events").select("event_id", weights.alias("w"))
    return rows.select("event_id", F.col("w.bm25").alias("w_keyword"), F.col("w.vector").alias("w_vector"))


_PROFILE = "CASE lang WHEN 'en' THEN 'precision' WHEN 'fr' THEN 'recall' ELSE 'balanced' END"


@query("SCL-03", f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0.5 ELSE CASE {_PROFILE} WHEN 'precision' THEN 0.9 WHEN 'recall' THEN 0.62 ELSE 0.78 END END AS mmr_lambda FROM documents")
def scl03(spark: S, sf: str) -> DataFrame:
    given = F.when(F.col("doc_id") % 7 == 0, F.lit(0.5))
    return docs(spark, sf).select("doc_id", sc.mmr_lambda(F.expr(_PROFILE), given).alias("mmr_lambda"))


@query("SCL-04", """SELECT d.doc_id, round_even((0.94 + greatest(0, least(100, coalesce(CASE quality WHEN 1 THEN 90.0 WHEN 0 THEN 60.0 END, 80.0))) / 1000) * greatest(0.7, least(1.3, CASE WHEN d.doc_id % 5 = 0 THEN 1.0 ELSE (d.doc_id % 5) / 2.0 END)), 4) AS boost
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def scl04(spark: S, sf: str) -> DataFrame:
    rows = docs(spark, sf).select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    quality = F.when(F.col("quality") == 1, 90.0).when(F.col("quality") == 0, 60.0)
    return rows.select("doc_id", sc.document_boost(quality, (F.col("doc_id") % 5) / F.lit(2.0)).alias("boost"))


@query("SCL-07", """SELECT doc_id, sha256('{"content_hash":"' || sha256(text) || '","dimension":256,"document":"' || doc_id || '","source":"' || source || '"}') AS index_key FROM documents""")
def scl07(spark: S, sf: str) -> DataFrame:
    record = F.struct(F.sha2("text", 256).alias("content_hash"), F.lit(256).alias("dimension"), F.col("doc_id").cast("string").alias("document"), "source")
    return docs(spark, sf).select("doc_id", F.sha2(F.to_json(record), 256).alias("index_key"))


@query("SCL-08", """SELECT DISTINCT 'entity:' || lang || ':' || substr(sha256(lower(source)), 1, 24) AS entity_id, 'edge:' || substr(sha256(lang || '|' || source), 1, 32) AS edge_id FROM documents""")
def scl08(spark: S, sf: str) -> DataFrame:
    entity = F.concat(F.lit("entity:"), F.col("lang"), F.lit(":"), F.substring(F.sha2(F.lower("source"), 256), 1, 24))
    edge = F.concat(F.lit("edge:"), F.substring(F.sha2(F.concat_ws("|", "lang", "source"), 256), 1, 32))
    return docs(spark, sf).select(entity.alias("entity_id"), edge.alias("edge_id")).distinct()


@query("SCL-09", r"""SELECT doc_id, substr(regexp_replace(trim(regexp_replace(lower(substr(text, 1, 300)), '\s+', ' ', 'g')), '^[.,:;()\[\]{}]+|[.,:;()\[\]{}]+$', '', 'g'), 1, 240) AS label FROM documents""")
def scl09(spark: S, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", tx.normalize_label(F.substring("text", 1, 300)).alias("label"))


@query("SCL-10", "SELECT event_id, (props ->> '$.k')::INT AS k FROM events")
def scl10(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SCL-11", "SELECT doc_id, sha256('human-review-v1:' || sha256(text)) AS candidate_id FROM documents")
def scl11(spark: S, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.sha2(F.concat(F.lit("human-review-v1:"), F.sha2("text", 256)), 256).alias("candidate_id"))


@query("SCL-12", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id, round(sqrt(list_sum(list_transform(a.e, lambda x: x * x))), 6) AS norm, round(greatest(list_cosine_similarity(a.e, b.e), 0), 6) AS to_next FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def scl12(spark: S, sf: str) -> DataFrame:
    a = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("following"))
    return a.join(b, "vec_id").select("vec_id", F.round(F.sqrt(sc.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"), F.round(sc.cosine(F.col("embedding"), F.col("following")), 6).alias("to_next"))


@query("SCL-13", """WITH e AS (SELECT event_id, value / 50 AS c, event_id % 5 AS e, user_id / 150.0 AS v, (event_id % 10) / 10.0 AS g FROM events)
SELECT event_id, CASE WHEN e = 0 THEN 'unknown' WHEN c >= 0.35 AND e >= 3 AND v >= 0.65 AND g >= 0.65 THEN 'strong' WHEN c >= 0.16 AND e >= 2 AND v >= 0.45 AND g >= 0.45 THEN 'medium' ELSE 'weak' END AS trust FROM e""")
def scl13(spark: S, sf: str) -> DataFrame:
    label = sc.trust_label(F.col("value") / 50, F.col("event_id") % 5, F.col("user_id") / 150.0, (F.col("event_id") % 10) / F.lit(10.0))
    return table(spark, sf, "events").select("event_id", label.alias("trust"))


@query("SET-04", f"""WITH {QUESTIONS} SELECT query_id, doc_id, list_sort(list_intersect(list_distinct({tok('question')}), list_distinct({tok('text')}))) AS matched
FROM questions JOIN documents ON query_id = doc_id % 40""")
def set04(spark: S, sf: str) -> DataFrame:
    rows = questions(spark, sf).join(docs(spark, sf).withColumn("query_id", F.col("doc_id") % 40), "query_id")
    return rows.select("query_id", "doc_id", F.array_sort(F.array_intersect(tx.tokenize(F.col("question")), tx.tokenize(F.col("text")))).alias("matched"))


@query("SET-05", f"""WITH t AS (SELECT doc_id, source, list_distinct({tok('text')}) AS t FROM documents),
p AS (SELECT doc_id, t, lead(doc_id) OVER w AS other, lead(t) OVER w AS u FROM t WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT doc_id, other, round(CASE WHEN len(t) > 0 AND len(u) > 0 THEN len(list_intersect(t, u)) / (len(t) + len(u) - len(list_intersect(t, u))) ELSE 0 END, 6) AS jaccard FROM p WHERE other IS NOT NULL""")
def set05(spark: S, sf: str) -> DataFrame:
    # The neighbour's id first, so that a window holds ids alone; then the texts meet by id.
    after = docs(spark, sf).select("doc_id", F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("other")).where("other IS NOT NULL")
    words = dealt_docs(spark, sf).select("doc_id", F.array_distinct(tx.tokenize(F.col("text"))).alias("t"))
    rows = after.join(words, "doc_id").join(words.select(F.col("doc_id").alias("other"), F.col("t").alias("u")), "other")
    return rows.select("doc_id", "other", F.round(sc.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))


@query("UDF-04", f"SELECT doc_id, {tok('text')} AS tokens FROM documents")
def udf04(spark: S, sf: str) -> DataFrame:
    from siftline.functions.registered import register

    register(spark)
    dealt_docs(spark, sf).createOrReplaceTempView("siftline_documents")
    return spark.sql("SELECT doc_id, siftline_tokens(text) AS tokens FROM siftline_documents")


@query("SRC-11", """WITH k AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, '')) AS size FROM documents), r AS (SELECT sha256, count(*) AS n FROM labels JOIN k USING (doc_id) GROUP BY 1), b AS (SELECT sha256, max(size) AS size_bytes, count(*) AS n_blobs FROM k GROUP BY 1)
SELECT sha256, substr(sha256, 1, 2) || '/' || sha256 AS object_key, size_bytes, n_blobs, coalesce(n, 0) AS n_references, n IS NULL AS unreferenced FROM b LEFT JOIN r USING (sha256)""")
def src11(spark: S, sf: str) -> DataFrame:
    return blob_inventory(docs(spark, sf), table(spark, sf, "labels"))


_SIGNS = {
    "no_text": (45, "trim(coalesce(text, '')) = ''", "import the text again"), "short_text": (10, "trim(coalesce(text, '')) <> '' AND length(trim(text)) < 200", "add more material"),
    "no_chunk": (35, "coalesce(n, 0) = 0", "split the document"), "short_chunks": (8, "n > 0 AND m < 120", "join small chunks"), "long_chunks": (8, "n > 0 AND m > 900", "split long chunks"), "no_page": (8, "doc_id % 6 = 0", "keep page numbers"),
    "strange_characters": (14, r"length(text) > 0 AND len(regexp_extract_all(text, '[\x{fffd}\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{80}-\x{9f}]')) / length(text) > 0.08", "check the encoding"),
    "repetitions": (10, "d > 0.25", "remove repeated parts"), "ocr": (12, "doc_id % 7 = 2", "repeat the recognition"), "not_indexed": (22, "doc_id % 5 = 3", "index the document"),
}
_SIGNED = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN struct_pack(sign := '{n}', points := {p}, advice := '{a}') END" for n, (p, c, a) in _SIGNS.items()) + "], lambda x: x IS NOT NULL)"


@query("AGG-02", rf"""WITH {CHUNKS},
g AS (SELECT document_id, count(*) AS n, avg(length(text)) AS m, 1 - count(DISTINCT trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) / count(*) AS d FROM chunks GROUP BY 1),
p AS (SELECT doc_id::VARCHAR AS document_id, coalesce(n, 0) AS n_chunks, {_SIGNED} AS s FROM documents LEFT JOIN g ON doc_id::VARCHAR = g.document_id),
q AS (SELECT *, greatest(0, 100 - coalesce(list_sum(list_transform(s, lambda x: x.points)), 0)) AS score FROM p)
SELECT document_id, n_chunks, score, CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS level, list_transform(s, lambda x: x.sign) AS signals, list_transform(s, lambda x: x.advice)[1:4] AS suggestions FROM q""")
def agg02(spark: S, sf: str) -> DataFrame:
    """Every sixth document has no page, others failed recognition or are not indexed."""
    ident = F.col("document_id").cast("long")
    docs = scan_documents(spark, sf).withColumns({"pages": ident % 6, "ocr": F.when(ident % 7 == 2, "failed").otherwise("ok"), "indexed": ident % 5 != 3})
    return corpus.document_quality(docs, chunk_table(spark, sf))


@query("SCL-05", """SELECT event_id, event_type AS stage, floor((greatest(0, coalesce(date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0)) + 5) / 10) / 100.0 AS duration_ms,
CASE WHEN event_type = 'error' THEN 'failed' END AS error, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1)::INT AS retries FROM events""")
def scl05(spark: S, sf: str) -> DataFrame:
    """Each event lasts to the user's next one; the user's events of the same type before it are its retries."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    again = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 1
    rows = table(spark, sf, "events").withColumn("stop", F.lead("ts").over(order)).withColumn("retries", again)
    event = sc.lifecycle_event(F.col("event_type"), F.col("ts"), F.col("stop"), F.when(F.col("event_type") == "error", "failed"), F.col("retries"))
    return rows.select("event_id", event.alias("e")).select("event_id", "e.*")
