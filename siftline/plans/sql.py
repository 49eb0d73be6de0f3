"""Pieces of the oracles' SQL (DuckDB)."""

from __future__ import annotations

from siftline.functions.text import STOPWORDS

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_HAN = r"[\x{4e00}-\x{9fff}]"


def tok(text: str) -> str:
    """A list of the tokens of a text expression."""
    pairs = f"list_filter(list_transform(range(1, length(r)), lambda i: substr(r, i, 2)), lambda p: NOT list_contains({_STOP}, p))"
    one = (
        f"CASE WHEN list_contains({_STOP}, r) THEN []::VARCHAR[] WHEN regexp_full_match(r, '{_HAN}+') AND length(r) > 2 "
        f"THEN list_concat({pairs}, CASE WHEN length(r) <= 6 THEN [r] ELSE []::VARCHAR[] END) ELSE [r] END"
    )
    runs = f"list_transform(regexp_extract_all({text}, '[A-Za-z0-9_]+|{_HAN}+'), lambda w: lower(w))"
    return f"flatten(list_transform({runs}, lambda r: {one}))"


#: Chinese text derived from the documents: letters stand for characters, so runs of all lengths occur.
LETTERS, CHARACTERS = "abcdefghijklmnopqrstuvwxyz", "的一是重复提交部署文档测试说明系统总结对比缺少工程性能"
HAN_TEXT = f"translate(lower(text), '{LETTERS}', '{CHARACTERS[:26]}')"

CHUNKS = """
chunks AS (
  SELECT doc_id::VARCHAR || ':' || i AS chunk_id, doc_id::VARCHAR AS document_id, i AS chunk_index, substr(text, i * 430 + 1, 520) AS text
  FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 520) / 430.0)::INT, 0) + 1))::INT AS i FROM documents WHERE length(text) > 0)
)"""
QUESTIONS = f"questions AS (SELECT item_id AS query_id, array_to_string({tok('text')}[1:12], ' ') AS question FROM benchmark)"
#: Whole documents as chunks.
WHOLE = "chunks AS (SELECT doc_id::VARCHAR || ':0' AS chunk_id, doc_id::VARCHAR AS document_id, text, source AS file_name, lang FROM documents)"
BM25 = f"""
word AS (SELECT chunk_id, {tok('text')} AS w FROM chunks),
stat AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM word),
posting AS (SELECT chunk_id, len(w) AS len, token, count(*) AS tf FROM (SELECT chunk_id, w, unnest(w) AS token FROM word) GROUP BY chunk_id, len(w), token),
df AS (SELECT token, count(*) AS df FROM posting GROUP BY token),
term AS (SELECT query_id, token, count(*) AS qf FROM (SELECT query_id, unnest({tok('question')}) AS token FROM questions) GROUP BY 1, 2),
bm25 AS (
  SELECT query_id, chunk_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / greatest(avg_len, 1.0)))), 9) AS score,
    list_sort(list(token)) AS matched
  FROM term JOIN df USING (token) JOIN posting USING (token), stat GROUP BY query_id, chunk_id
)"""


def hashed(name: str, source: str, key: str, text: str) -> str:
    """A table (key, idx, value) of normalized feature hashes."""
    return f"""
{name}_part AS (
  SELECT {key}, idx, sum(v) AS v FROM (
    SELECT {key}, ('0x' || substr(sha256(token), 1, 8))::BIGINT % 256 AS idx, CASE WHEN ('0x' || substr(sha256(token), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS v
    FROM (SELECT {key}, unnest({tok(text)}) AS token FROM {source})) GROUP BY 1, 2 HAVING sum(v) <> 0
), {name} AS (SELECT {key}, idx, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS value FROM {name}_part)"""


COSINE = f"""{hashed('qv', 'questions', 'query_id', 'question')}, {hashed('cv', 'chunks', 'chunk_id', 'text')},
cos AS (SELECT query_id, chunk_id, round(greatest(sum(q.value * c.value), 0.0), 9) AS score FROM qv q JOIN cv c USING (idx) GROUP BY 1, 2)"""
