"""The queries opN_<name>: each applies its operator to a whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import ann, bpe, classifier, hard_negatives, license_scan, line_dedup, mixing, ngram_join, quality, sharding, spelling, token_store, url_filter


def tokenizer_file() -> str:
    """The vocabulary: CORPUS_TOKENIZER, or the public file of this machine."""
    if found := os.environ.get("CORPUS_TOKENIZER"):
        return found
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, removed="n_removed")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_report(table(spark, sf_dir, "documents"), tokenizer_file())


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_file())


def op11_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_line_dedup, op2_license_scan, op3_url_filter, op4_mixing, op5_sharding, op6_ngram_join, op7_quality, op8_ann, op9_token_store, op10_bpe,
            op11_classifier, op12_hard_negatives, op13_spelling,
        )
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP1 = r"""
WITH doc AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text <> ''
), line AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS size FROM doc
), hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM line
), gap AS (
  SELECT doc_id, i AS after, size, h + 31 * coalesce(lag(h) OVER w, 0) AS up,
    lead(h) OVER w + 31 * coalesce(lead(h, 2) OVER w, 0) AS down
  FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), bound AS (
  SELECT doc_id, 0 AS g FROM doc UNION ALL SELECT doc_id, after FROM gap WHERE after = size OR up % 8 <> 0 OR down % 8 <> 0
), span AS (
  SELECT doc_id, g AS s, CASE WHEN lead(g) OVER w > g + 1 THEN lead(g) OVER w ELSE lead(g, 2) OVER w END AS e
  FROM bound WINDOW w AS (PARTITION BY doc_id ORDER BY g)
), chunk AS (
  SELECT doc_id, s, e, array_to_string(lines[s + 1:e], chr(10)) AS chunk FROM span JOIN doc USING (doc_id) WHERE e IS NOT NULL
  UNION ALL
  SELECT doc_id, i - 1, i, line FROM line WHERE length(line) >= 99 AND len(regexp_split_to_array(line, '[\x20\x09-\x0D]+')) >= 50
), owned AS (
  SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, s) AS nth FROM chunk WHERE regexp_matches(chunk, '[^\x20\x09-\x0D]')
), gone AS (SELECT DISTINCT doc_id, unnest(range(s + 1, e + 1)) AS i FROM owned WHERE nth > 1
), kept AS (
  SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text, count(g.i) AS n_removed
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.text, d.text) AS text, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def _op3() -> str:
    url = f"translate(url, '{_UPPER}', '{_LOWER}')"
    fits, order = [], sorted(url_filter.HOST_RULES, key=lambda r: (-r.length, r.allow, r.name))
    for r in order:
        host, path = r.name.split("/", 1)
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')", r))
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r.name}'" for c, r in fits) + " END"
    allow = "CASE " + " ".join(f"WHEN {c} THEN {str(r.allow).lower()}" for c, r in fits) + " END"
    pattern = "CASE " + " ".join(f"WHEN regexp_matches({url}, '{r.pattern}') THEN '{r.name}'" for r in sorted(url_filter.PATTERN_RULES, key=lambda r: r.name)) + " END"
    return f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), part AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2), '') AS path FROM cut
), judged AS (SELECT page_id, host, path, {rule} AS rule, {allow} AS allowed, {pattern} AS pattern FROM part)
SELECT page_id, host, path, rule, CASE WHEN coalesce(allowed, pattern IS NULL) THEN 'allow' ELSE 'block' END AS verdict, pattern FROM judged
"""


_OP6 = rf"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM word WHERE len(w) > 0
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM shared s JOIN size x ON s.a = x.doc_id JOIN size y ON s.b = y.doc_id WHERE 5 * s.n >= 4 * (x.n + y.n - s.n)
), reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
class AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT d.doc_id, c.class_id, coalesce(g.n, 0) AS n_links
FROM documents d JOIN class c ON d.doc_id = c.a LEFT JOIN degree g ON d.doc_id = g.a
"""


_OP12 = """
WITH part AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, list_dot_product(a.v, x.v)::BIGINT AS score
  FROM part a JOIN part x ON a.vec_id % 100 = 0 AND a.vec_id <> x.vec_id
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


def oracle_sql() -> dict[str, str]:
    """The others use hashes, models or the tokenizer, which SQL cannot express; tests hold them against brute force."""
    return {"op1_line_dedup": _OP1, "op3_url_filter": _op3(), "op6_ngram_join": _OP6, "op12_hard_negatives": _OP12}
