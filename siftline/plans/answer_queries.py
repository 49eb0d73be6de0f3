"""Queries over answers and their evidence."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.operators import answers as an
from siftline.operators import corpus, hooks, ranking, records, windows
from siftline.operators import registry_ops as ops
from siftline.operators.elements import text_elements
from siftline.plans import evaluation_queries, more_queries, text_queries, window_queries  # noqa: F401  whose SQL is used here
from siftline.plans.element_queries import _MD, _RICH, KIND, PLAIN, marked, rich
from siftline.plans.graph_queries import _PATHS, _SEARCH, graph_found
from siftline.plans.more_queries import _MARKED, mmr_sql
from siftline.plans.ranking_queries import REASON, BASE, BOOSTS, KEYWORD, TOP, boosts, chunks, keyword
from siftline.plans.registry import ORACLES, QUERIES, query
from siftline.plans.sql import BM25, CHARACTERS, CHUNKS, COSINE, HAN_TEXT, LETTERS, QUESTIONS, WHOLE, tok
from siftline.sources.scratch import written
from siftline.sources.tables import chunk_table, questions, table

S = SparkSession
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"
_BEST = ", ".join(f"struct_pack(n := len(list_filter({_LIST(w)}, lambda t: contains(low, t) OR list_contains(w, t))), i := '{i}', t := list_filter({_LIST(w)}, lambda t: contains(low, t) OR list_contains(w, t)))" for i, w in an.INTENTS.items())


@query("TXT-21", f"""WITH q AS (SELECT doc_id AS query_id, {HAN_TEXT} AS low, list_distinct({tok(HAN_TEXT)}) AS w FROM documents), b AS (SELECT *, list_sort([{_BEST}], 'DESC')[1] AS b FROM q),
i AS (SELECT query_id, CASE WHEN b.n > 0 THEN b.i ELSE 'qa' END AS intent, CASE WHEN b.n > 0 THEN b.t ELSE [] END AS matched, list_sort(w)[1:16] AS query_terms, len(w) <= 2 AS short FROM b)
SELECT query_id, intent, matched, query_terms, CASE WHEN intent IN ('fact', 'implementation') OR intent = 'qa' AND short THEN 'precision' WHEN intent = 'qa' THEN 'balanced' ELSE 'recall' END AS profile,
CASE WHEN intent = 'qa' AND short THEN 'keyword' ELSE 'hybrid' END AS mode, CASE WHEN intent IN ('summary', 'comparison', 'gap') THEN 48 WHEN intent = 'qa' AND short THEN 16 ELSE 24 END AS candidate_k FROM i""")
def txt21(spark: S, sf: str) -> DataFrame:
    han = F.translate(F.lower("text"), LETTERS, CHARACTERS[:26])
    return an.analyze_query(table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), han.alias("question")))


def _sentences(text: str) -> str:
    strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    lines = f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: {strip('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '{an.LAYOUT}'))"
    ends = rf"regexp_replace(regexp_replace(x, '\.(\s|\[|$)', '.' || chr(2) || '\1', 'g'), '([。！？!?]|\.\x02)((?:\s*{an.MARKER})*)', '\1\2' || chr(1), 'g')"
    pieces = f"flatten(list_transform({lines}, lambda x: string_split(replace({ends}, chr(2), ''), chr(1))))"
    return f"list_filter(list_transform({pieces}, lambda x: {strip('x')}), lambda x: length(x) >= 8)"


@query("TXT-22", f"SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS place, unnest(s) AS sentence FROM (SELECT doc_id, {_sentences(_MARKED)} AS s FROM documents)")
def txt22(spark: S, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").withColumn("text", F.expr(_MARKED))
    return rows.select("doc_id", F.posexplode(an.sentences(F.col("text"))).alias("place", "sentence"))


_CUT = lambda t, n: f"CASE WHEN length({t}) <= {n} THEN {t} ELSE rtrim(substr({t}, 1, {n})) || '...' END"
_FLAT = lambda t: rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


@query("TXT-26", f"""WITH {CHUNKS}, p AS (SELECT document_id, list({_CUT(_FLAT('text'), 90)} ORDER BY chunk_index) AS key_points FROM chunks WHERE chunk_index < 4 GROUP BY 1),
k AS (SELECT doc_id::VARCHAR AS document_id, list(token ORDER BY rank) AS concepts FROM ({ORACLES['TXT-11']}) WHERE rank <= 10 GROUP BY 1),
s AS (SELECT doc_id::VARCHAR AS document_id, {_CUT(_FLAT('sentence'), 120)} AS one_sentence FROM ({ORACLES['TXT-12']}))
SELECT document_id, one_sentence, coalesce(key_points, []) AS key_points, coalesce(concepts, []) AS concepts, list_concat(['What is this document about?'], list_transform(coalesce(concepts, [])[1:3], lambda c: 'What does it say about ' || c || '?')) AS suggested_questions FROM s LEFT JOIN p USING (document_id) LEFT JOIN k USING (document_id)""")
def txt26(spark: S, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    point = F.struct("chunk_index", tx.truncate_text(F.col("text"), 90).alias("point"))
    points = chunk_table(spark, sf).where("chunk_index < 4").groupBy("document_id").agg(F.array_sort(F.collect_list(point)).alias("p"))
    points = points.select("document_id", F.transform("p", lambda x: x["point"]).alias("key_points"))
    words = corpus.keywords(docs, "doc_id").where("rank <= 10").groupBy(F.col("doc_id").cast("string").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("k"))
    words = words.select("document_id", F.transform("k", lambda x: x["token"]).alias("concepts"))
    head = docs.select(F.col("doc_id").cast("string").alias("document_id"), tx.truncate_text(tx.first_sentence(F.col("text")), 120).alias("one_sentence"))
    none = F.array().cast("array<string>")
    rows = head.join(points, "document_id", "left").join(words, "document_id", "left").select("document_id", "one_sentence", F.coalesce("key_points", none).alias("key_points"), F.coalesce("concepts", none).alias("concepts"))
    return rows.withColumn("suggested_questions", an.suggested_questions(F.col("concepts")))


_CITED = "cited AS (SELECT query_id, rank, score, chunk_id, file_name, text, matched FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 5)"
_ANSWER = f"answer AS ({ORACLES['EVL-02']})"


def cited(spark: S, sf: str) -> DataFrame:
    """The first five of each question with their texts."""
    return written(ranking.with_chunks(keyword(spark, sf), chunks(spark, sf)), "cited")


@query("TXT-28", f"""WITH {BASE}, {KEYWORD}, {_CITED}, {_ANSWER}, a AS (SELECT query_id, question, answer FROM questions JOIN answer USING (query_id)),
c AS (SELECT query_id, token, count(*) AS n FROM (SELECT query_id, unnest({tok("question || chr(10) || answer")}) AS token FROM a) WHERE length(token) >= 2 GROUP BY 1, 2),
t AS (SELECT query_id, list(token) AS auto FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, token) AS nth FROM c) WHERE nth <= 8 GROUP BY 1),
s AS (SELECT query_id, list_sort(list(DISTINCT file_name)) AS sources, least(count(*), 8) AS n_citations FROM cited GROUP BY 1)
SELECT query_id, substr(trim(question), 1, 42) AS title, coalesce(sources, []) AS sources, coalesce(n_citations, 0) AS n_citations, list_sort(list_distinct(list_concat(['corpus'], coalesce(auto, []))))[1:8] AS tags FROM a LEFT JOIN s USING (query_id) LEFT JOIN t USING (query_id)""")
def txt28(spark: S, sf: str) -> DataFrame:
    found = cited(spark, sf)  # one search; the answers are those of EVL-02
    rows = questions(spark, sf).join(ranking.template_answers(questions(spark, sf), found.where("rank <= 3")), "query_id")
    return an.knowledge_cards(rows, found.select("query_id", "file_name"), ["corpus"])


_TURNS = r"t AS (SELECT conv_id, turn, role, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS question, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS a FROM conversations)"
_BARE = rf"list_transform(list_filter(string_split(a, chr(10)), lambda x: length(trim(x)) >= 8), lambda x: regexp_replace(x, '^[ \-0-9.、]+|[ \-0-9.、]+$', '', 'g'))"
_BULLETS = lambda n: f"array_to_string(list_transform((CASE WHEN len({_BARE}) > 0 THEN {_BARE} ELSE [a] END)[1:{n}], lambda x: '- ' || {_CUT(_FLAT('x'), 120)}), chr(10))"
_PARTS = {"q": "question", "a": "a", "brief": _CUT(_FLAT("a"), 180), "less": _CUT(_FLAT("a"), 160), "topic": _CUT(_FLAT("question"), 60), "points": _BULLETS(4)}
_CITE = f"CASE WHEN turn > 0 THEN '- before: ' || {_CUT(_FLAT('question'), 86)} || chr(10) ELSE '' END || '- own: ' || {_CUT(_FLAT('a'), 86)}"


def _filled(template: str) -> str:
    pieces = re.split(r"\{(\w+)\}", template)
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    return " || ".join(_PARTS[p] if i % 2 else quoted(p) for i, p in enumerate(pieces) if i % 2 or p)


_STYLES = {"short": _BULLETS(3), "highlights": _CITE} | {s: _filled(t) for s, t in an.STYLES.items()}


@query("TXT-29", f"WITH {_TURNS} " + " UNION ALL ".join(f"SELECT conv_id, turn, '{s}' AS style, {text} AS rewritten FROM t WHERE role = 'assistant'" for s, text in _STYLES.items()))
def txt29(spark: S, sf: str) -> DataFrame:
    """Assistant turns as answers to the turns before them."""
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    rows = table(spark, sf, "conversations").withColumn("question", before).where("role = 'assistant'")
    own = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    cite = lambda name, text: F.struct(F.lit(name).alias("file_name"), text.alias("text"))
    both = F.when(F.col("turn") > 0, F.array(cite("before", F.col("question")), cite("own", own))).otherwise(F.array(cite("own", own)))
    return an.rewrite_answers(rows.select("conv_id", "turn", "question", F.coalesce("text", F.lit("")).alias("answer"), both.alias("citations")))


_SENT = f"""sent AS (SELECT query_id, {_sentences('answer')} AS l FROM answer), num AS (SELECT query_id, unnest(l) AS s, generate_subscripts(l, 1) AS place FROM sent),
n AS (SELECT query_id, count(*) AS n, max(score) AS top_score FROM cited GROUP BY 1),
m AS (SELECT num.*, coalesce(n, 0) AS n, list_distinct({tok(f"regexp_replace(s, '{an.MARKER}', '', 'g')")}) AS claim, list_transform(flatten(list_transform(regexp_extract_all(s, '\\[([0-9]+(?:\\s*,\\s*[0-9]+)*)\\]', 1), lambda g: regexp_split_to_array(g, '\\s*,\\s*'))), lambda x: x::INT) AS marks FROM num LEFT JOIN n USING (query_id)),
f AS (SELECT m.query_id, place, list(rank) FILTER (WHERE file_name <> '' AND contains(s, file_name)) AS named FROM m LEFT JOIN cited USING (query_id) GROUP BY 1, 2),
g AS (SELECT m.*, CASE WHEN len(marks) > 0 THEN marks WHEN len(named) > 0 THEN named WHEN regexp_matches(s, '{an.PLACE}') THEN range(1, n + 1) ELSE [] END AS refers FROM m JOIN f USING (query_id, place)),
o AS (SELECT g.query_id, g.place, any_value(s) AS s, any_value(len(refers) > 0 AND len(list_filter(refers, lambda r: r < 1 OR r > n)) = 0) AS valid, coalesce(max(len(list_intersect(claim, list_distinct({tok('text')}))) / greatest(len(claim), 1)) FILTER (WHERE list_contains(refers, rank)), 0) AS overlap
FROM g LEFT JOIN cited USING (query_id) GROUP BY 1, 2),
r AS (SELECT query_id, count(s) AS n_sentences, count(*) FILTER (WHERE valid) AS supported, count(*) FILTER (WHERE valid AND overlap >= 0.34) AS grounded, count(*) FILTER (WHERE valid AND overlap < 0.34) AS weak,
coalesce(list(s ORDER BY place) FILTER (WHERE NOT valid), [])[1:6] AS unsupported_claims, coalesce(list(s ORDER BY place) FILTER (WHERE valid AND overlap < 0.34), [])[1:6] AS weak_claims FROM o GROUP BY 1),
z AS (SELECT a.query_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(supported, 0) AS supported, coalesce(grounded, 0) AS grounded, coalesce(weak, 0) AS weak, coalesce(unsupported_claims, []) AS unsupported_claims, coalesce(weak_claims, []) AS weak_claims,
coalesce(supported / nullif(n_sentences, 0), 0)::DOUBLE AS cov, coalesce(grounded / nullif(supported, 0), 0)::DOUBLE AS gro, coalesce(n, 0) AS n, coalesce(top_score, 0) AS c FROM answer a LEFT JOIN r USING (query_id) LEFT JOIN n USING (query_id))"""


@query("EVL-03", f"""WITH {BASE}, {KEYWORD}, {_CITED}, {_ANSWER}, {_SENT} SELECT query_id, n_sentences, supported, grounded, weak, unsupported_claims, weak_claims, round(cov, 4) AS coverage, round(gro, 4) AS grounding,
CASE WHEN n = 0 THEN 'unknown' WHEN c >= 0.35 AND n >= 3 AND cov >= 0.65 AND gro >= 0.65 THEN 'strong' WHEN c >= 0.16 AND n >= 2 AND cov >= 0.45 AND gro >= 0.45 THEN 'medium' ELSE 'weak' END AS trust,
list_filter([CASE WHEN n = 0 THEN 'add sources' END, CASE WHEN supported < n_sentences THEN 'cite every sentence' END, CASE WHEN weak > 0 THEN 'check weak citations' END, CASE WHEN c < 0.12 THEN 'ask more narrowly' END], lambda x: x IS NOT NULL) AS recommendations FROM z""")
def evl03(spark: S, sf: str) -> DataFrame:
    found = cited(spark, sf)  # one search; the answers are those of EVL-02
    answers = written(ranking.template_answers(questions(spark, sf), found.where("rank <= 3")), "answers")
    return an.audit_citations(answers, found.select("query_id", "rank", "file_name", "text", "score"))


@query("RET-11", f"""WITH {BASE}, {KEYWORD}, t AS (SELECT query_id, max(score) AS best FROM ranked WHERE rank <= 5 GROUP BY 1), q AS (SELECT item_id AS query_id, substr(text, 1, 1 + item_id % 9) AS question FROM benchmark)
SELECT query_id, unnest(list_filter([CASE WHEN best IS NULL THEN 'nothing_above_threshold' WHEN best < 0.95 THEN 'low_confidence' END, CASE WHEN length(trim(question)) <= 4 THEN 'short_question' END, CASE WHEN best IS NULL THEN 'narrow_scope' END], lambda x: x IS NOT NULL)) AS finding FROM q LEFT JOIN t USING (query_id)""")
def ret11(spark: S, sf: str) -> DataFrame:
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.expr("substr(text, 1, 1 + item_id % 9)").alias("question"))
    return an.diagnose(q, keyword(spark, sf), chunks(spark, sf).agg(F.count("*").alias("n")), 0.95, True, "keyword")


_TEXT = lambda c: rf"""'"' || replace(replace(replace(replace({c}, '\', '\\'), '"', '\"'), chr(9), '\t'), chr(10), '\n') || '"'"""
_KEY = " || ',' || ".join(
    f"""'"{name}":' || {value}"""
    for name, value in {
        "caption": _TEXT("caption"), "context": _TEXT("context"), "kind": _TEXT("kind"), "latex": _TEXT("latex"), "model": """'"m' || doc_id % 2 || '"'""", "prompt_version": """'"1"'""", "provider": """'"template"'""",
        "rows": f"CASE WHEN kind = 'table' THEN '[[' || array_to_string(list_transform(string_split(text, ' | '), lambda x: {_TEXT('x')}), ',') || ']]' ELSE '[]' END", "text": _TEXT("text"),
    }.items()
)


@query("JN-09", f"""WITH {PLAIN}, {_RICH}, r AS (SELECT doc_id, n, sha256('{{' || {_KEY} || '}}') AS key FROM rich),
c AS (SELECT DISTINCT key FROM r JOIN labels USING (doc_id)) SELECT key, count(*) AS n_requests, bool_or(key IN (SELECT key FROM c)) AS hit, CASE WHEN key IN (SELECT key FROM c) THEN 0 ELSE 1 END AS computed FROM r GROUP BY key""")
def jn09(spark: S, sf: str) -> DataFrame:
    """The key holds all that an enrichment depends on: the element's kind, text, caption, cells and formula, its context, the provider, its model and the version of the prompt."""
    return requests(spark, sf).groupBy("key").agg(F.count("*").alias("n_requests"), F.bool_or("hit").alias("hit"), F.sum(F.col("first").cast("int")).alias("computed"))


FIELDS = ["kind", "text", "caption", "rows", "latex", "context", "provider", "model", "prompt_version"]


def requests(spark: S, sf: str) -> DataFrame:
    """Elements as requests to one of two models; those of labelled documents are in the cache."""
    rows = rich(spark, sf).withColumn("model", F.concat(F.lit("m"), (F.col("doc_id") % 2).cast("string"))).withColumn("provider", F.lit("template")).withColumn("prompt_version", F.lit("1"))
    cache = rows.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(records.cache_key(FIELDS).alias("key"))
    return records.cache_probe(rows, cache, FIELDS, ["doc_id", "n"])


@query("EVL-11", rf"""WITH d AS (SELECT doc_id, source AS title, CASE WHEN lang = 'de' THEN 'zh' ELSE lang END AS lang, {_MD} AS text FROM documents), h AS (SELECT *, regexp_extract(text, '(?:^|\n)#{{1,4}}[ \t]+([^\n]+)', 1) AS head FROM d),
t AS (SELECT *, substr(trim(CASE WHEN head = '' THEN title ELSE head END), 1, 160) AS topic FROM h)
SELECT doc_id, sha256('human-review-v1:' || sha256(text)) AS candidate_id, CASE WHEN lang = 'zh' THEN '《' || title || '》怎样谈“' || topic || '”？' ELSE 'What does ''' || title || ''' say on ''' || topic || '''?' END AS question, 'draft' AS status FROM t""")
def evl11(spark: S, sf: str) -> DataFrame:
    lang = F.when(F.col("lang") == "de", "zh").otherwise(F.col("lang"))
    return an.annotation_queue(marked(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), lang.alias("lang")), "doc_id"))


_NOW = "(SELECT max(ts) FROM events)"
_STATE = "s AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS id, max(ts) AS ts, count(*) AS n FROM events GROUP BY 1)"


@query("EVL-16", f"""WITH c AS ({ORACLES['WIN-07']}), {_STATE}, r AS (SELECT user_id, valid, epoch(date_trunc('second', {_NOW}))::BIGINT - epoch(date_trunc('second', ts))::BIGINT BETWEEN -5 AND 86400 AS fresh, user_id % 7 <> 0 AND id % 97 <> 5 AS consistent FROM c JOIN s USING (user_id))
SELECT *, valid AND fresh AND consistent AS eligible FROM r""")
def evl16(spark: S, sf: str) -> DataFrame:
    """Chains of users' events; the states of every seventh user are one event behind."""
    events = table(spark, sf, "events")
    own = F.sha2(F.concat_ws(":", "event_id", "event_type"), 256)
    told = F.when(F.col("event_id") % 97 == 5, "broken").otherwise(own)
    order = F.struct("ts", "event_id")
    latest = events.groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by(told, order).alias("last_hash"))
    state = events.groupBy("user_id").agg((F.count("*") - F.when(F.col("user_id") % 7 == 0, 1).otherwise(0)).alias("n"), F.max_by(own, order).alias("last_hash"))
    now = events.agg(F.max("ts").alias("now"))
    checked = QUERIES["WIN-07"](spark, sf).crossJoin(F.broadcast(now))  # one row
    return windows.verify_soak(checked, latest, state, F.col("now").cast("timestamp"), 86_400)




def shortest(question: str, template: str) -> str:
    """A small generator, the default of generate_with: the template's first line; without evidence it fails."""
    if template == "no evidence":
        raise ValueError("no evidence")
    return template.split("\n")[0]


@query("UDF-02", f"SELECT query_id, CASE WHEN answer = 'no evidence' THEN answer ELSE string_split(answer, chr(10))[1] END AS answer, CASE WHEN answer = 'no evidence' THEN 'ValueError: no evidence' END AS fallback FROM ({ORACLES['EVL-02']})")
def udf02(spark: S, sf: str) -> DataFrame:
    rows = questions(spark, sf).join(QUERIES["EVL-02"](spark, sf).withColumnRenamed("answer", "template"), "query_id")
    return hooks.generate_with(rows, shortest)


def counted(fields: dict) -> str:
    """A small enricher, the default of enrich_with."""
    return f'{{"description": "{fields["kind"]} of {len(fields["text"])}"}}'


@query("UDF-03", rf"""WITH j AS ({ORACLES['JN-09']}), {PLAIN}, {_RICH}, r AS (SELECT any_value(kind) AS kind, any_value(text) AS text, sha256('{{' || {_KEY} || '}}') AS key FROM rich GROUP BY 3)
SELECT key, '{{"description": "' || kind || ' of ' || least(length(text), 6000) || '"}}' AS payload, NULL AS error FROM j JOIN r USING (key) WHERE NOT hit""")
def udf03(spark: S, sf: str) -> DataFrame:
    return hooks.enrich_with(requests(spark, sf).where("first"), counted, {"kind": 200, "text": 6000})


@query("EVL-10", f"""WITH {BASE}, {KEYWORD}, c AS (SELECT query_id, token, min((rank, i)) AS first FROM (SELECT query_id, rank, unnest(matched) AS token, generate_subscripts(matched, 1) AS i FROM ranked WHERE rank <= 3) GROUP BY 1, 2), m AS (SELECT query_id, list(token ORDER BY first)[1:8] AS matched FROM c GROUP BY 1),
f AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN text ELSE ' ' END AS expected, CASE item_id % 4 WHEN 0 THEN 'wrong_citation' ELSE '' END AS kind FROM benchmark WHERE item_id % 2 = 0)
SELECT query_id, CASE WHEN len({tok('expected')}) > 0 THEN list_filter({tok('expected')}[1:8], lambda x, i: list_position({tok('expected')}, x) = i) ELSE coalesce(matched, []) END AS keywords, CASE WHEN kind = '' THEN 'bad_answer' ELSE kind END AS failure_type, 'draft' AS status FROM f LEFT JOIN m USING (query_id)""")
def evl10(spark: S, sf: str) -> DataFrame:
    """Answers to every second question are rated down; some come with the answer that was expected."""
    item = F.col("item_id")
    told = table(spark, sf, "benchmark").select(item.alias("query_id"), F.when(item % 2 == 0, "down").otherwise("up").alias("rating"), F.when(item % 3 == 0, F.col("text")).otherwise(" ").alias("expected_answer"), F.when(item % 4 == 0, "wrong_citation").otherwise("").alias("failure_type"))
    cited_terms = keyword(spark, sf, 3).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "matched"))).alias("l"))
    return an.feedback_cases(told.join(cited_terms.select("query_id", F.flatten(F.transform("l", lambda x: x["matched"])).alias("matched")), "query_id", "left"))


#: Part 0 is in order; in part 1 some events were tampered with and some documents are not in the index.
_SOAK = """chain AS (SELECT *, user_id % 2 AS part, sha256(event_id || ':' || event_type) AS own FROM events), links AS (SELECT *, CASE WHEN part = 1 AND event_id % 97 = 5 THEN 'broken' ELSE own END AS event_hash, coalesce(lag(own) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS previous_hash FROM chain),
checked AS (SELECT *, event_hash = own AND previous_hash = coalesce(lag(event_hash) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS good FROM links),
halves AS (SELECT * FROM events WHERE event_id % 2 = 0 UNION ALL SELECT * FROM events WHERE event_id % 2 = 1),
soak AS (SELECT part, bool_and(good) AS valid, epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 AS seconds, (SELECT NOT EXISTS (SELECT * FROM events EXCEPT ALL SELECT * FROM halves) AND NOT EXISTS (SELECT * FROM halves EXCEPT ALL SELECT * FROM events)) AS restored FROM checked GROUP BY part),
files AS (SELECT sha256(concat_ws(':', doc_id, text)) AS h, doc_id % 10 = 3 AS lost FROM documents),
held AS (SELECT 0 AS part, count(*) = count(DISTINCT h) AS whole, count(*) AS n FROM files UNION ALL SELECT 1, count(*) = count(DISTINCT h) AND count(*) FILTER (WHERE lost) = 0, count(*) FILTER (WHERE NOT lost) FROM files)"""


@query("EVL-14", f"""WITH {_SOAK} SELECT part, (SELECT count(DISTINCT source) FROM documents) AS licensed_materials, CASE WHEN whole THEN n ELSE 0 END AS non_fixture_documents, (SELECT count(*) FROM labels) AS annotated_questions,
(SELECT count(*) FROM conversations WHERE role = 'user') AS real_questions, round(CASE WHEN valid THEN seconds ELSE 0 END / 86400, 6) AS soak_days, restored::INT AS restore_drill, (restored AND valid AND seconds >= 14 * 86400)::INT AS no_data_loss FROM soak JOIN held USING (part)""")
def evl14(spark: S, sf: str) -> DataFrame:
    """Documents with their ids are the manifest; each user's events are a chain of hashes, checked as WIN-07 does, and are restored from two partial backups."""
    docs, events = table(spark, sf, "documents"), table(spark, sf, "events")
    hashed = docs.select("doc_id", F.sha2(F.concat_ws(":", "doc_id", "text"), 256).alias("sha256"), F.col("source").alias("license"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = F.sha2(F.concat_ws(":", "event_id", "event_type"), 256)
    chain = events.withColumn("part", F.col("user_id") % 2).withColumn("own", own).withColumn("previous_hash", F.coalesce(F.lag("own").over(w), F.lit("")))
    chain = chain.withColumn("event_hash", F.when((F.col("part") == 1) & (F.col("event_id") % 97 == 5), "broken").otherwise(F.col("own")))
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    drill = written(ops.copy_verified(events, events.where("event_id % 2 = 0"), ["event_id"]).where("step = 'after'").select(F.col("same").alias("restored")), "drill")
    out = None
    for part, indexed in ((0, hashed), (1, hashed.where("doc_id % 10 <> 3"))):
        here = chain.where(F.col("part") == part)
        valid = windows.verify_hash_chain(here).agg(F.bool_and("valid").alias("valid"))
        soak = here.agg((F.max(ts) - F.min(ts)).alias("seconds")).crossJoin(valid).crossJoin(drill)  # one row each
        one = an.release_evidence(hashed, indexed.select("sha256"), table(spark, sf, "labels"), table(spark, sf, "conversations").where("role = 'user'"), soak).withColumn("part", F.lit(part).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


_GATE = "MAP {" + ", ".join(f"'{g}': {v}" for g, v in an.GATES.items()) + "}"
_EVIDENCE = ["licensed_materials", "non_fixture_documents", "annotated_questions", "real_questions", "soak_days", "restore_drill", "no_data_loss"]
_MEASURED = {"recall_at_5": "recall_at_5", "mrr": "mrr", "citation_accuracy": "citation_accuracy", "refusal_accuracy": "refusal_accuracy", "answer_acceptance": "answer_acceptance_accuracy"}


@query("EVL-13", f"""WITH e AS (SELECT * FROM ({ORACLES['EVL-14']}) WHERE part = 0), m AS ({ORACLES['EVL-08']}), g AS ({" UNION ALL ".join(f"SELECT '{c}' AS gate, {c}::DOUBLE AS observed FROM e" for c in _EVIDENCE)}
UNION ALL {" UNION ALL ".join(f"SELECT '{g}', actual::DOUBLE FROM m WHERE metric = '{c}'" for g, c in _MEASURED.items())} UNION ALL SELECT 'citation_coverage', round(coalesce(avg(coverage), 0), 6) FROM ({ORACLES['EVL-03']})),
r AS (SELECT gate, observed, {_GATE}[gate]::DOUBLE AS required, observed >= {_GATE}[gate] AS passed FROM g) SELECT *, count(*) FILTER (WHERE passed) OVER () AS n_passed, bool_and(passed) OVER () AS ready FROM r""")
def evl13(spark: S, sf: str) -> DataFrame:
    metrics = QUERIES["EVL-08"](spark, sf)
    wide = metrics.agg(*[F.max(F.when(F.col("metric") == c, F.col("actual"))).alias(g) for g, c in _MEASURED.items()])
    coverage = QUERIES["EVL-03"](spark, sf).agg(F.round(F.coalesce(F.avg("coverage"), F.lit(0.0)), 6).alias("citation_coverage"))
    return an.release_gates(QUERIES["EVL-14"](spark, sf).where("part = 0").drop("part").crossJoin(F.broadcast(wide)).crossJoin(F.broadcast(coverage)))  # one row each


_ASKED = QUESTIONS.replace("questions AS", "asked AS")
_PIECES = CHUNKS.replace("chunks AS", "pieces AS") + ", chunks AS (SELECT p.*, source AS file_name, d.doc_id FROM pieces p JOIN documents d ON d.doc_id::VARCHAR = document_id WHERE lang IN ('en', 'fr'))"
_STAGES = f"""ev AS (SELECT * FROM (WITH RECURSIVE {_PATHS}, {_SEARCH} SELECT query_id, doc_id, graph_rank FROM evidence)), {_ASKED},
questions AS (SELECT query_id * 2 AS query_id, question FROM asked UNION ALL SELECT query_id * 2 + 1, array_to_string(string_split(question, ' ')[1:6], ' ') FROM asked), {_PIECES}, {BM25}, {COSINE}, {BOOSTS},
kb AS (SELECT query_id // 2 AS query_id, chunk_id, max(score) AS s FROM bm25 GROUP BY 1, 2), vb AS (SELECT query_id // 2 AS query_id, chunk_id, max(score) AS s FROM cos GROUP BY 1, 2),
base AS (SELECT query_id, chunk_id, keyword, vector, round(round(0.62 * keyword + 0.38 * vector, 9) * boost, 9) AS score FROM (SELECT query_id, chunk_id, coalesce(k.s / (k.s + 1), 0) AS keyword, coalesce(v.s, 0) AS vector FROM kb k FULL JOIN vb v USING (query_id, chunk_id)) JOIN chunks USING (chunk_id) JOIN boosts b ON b.chunk_id = document_id || ':0'),
fused AS (SELECT b.query_id, b.chunk_id, keyword, vector, row_number() OVER w AS base_rank, graph_rank, CASE WHEN bool_or(graph_rank IS NOT NULL) OVER (PARTITION BY b.query_id) THEN round(61 * (0.75 / (60 + row_number() OVER w) + coalesce(0.25 / (60 + graph_rank), 0)), 9) ELSE score END AS score
FROM base b JOIN chunks c ON b.chunk_id = c.chunk_id LEFT JOIN ev ON ev.query_id = b.query_id AND ev.doc_id = c.doc_id WINDOW w AS (PARTITION BY b.query_id ORDER BY score DESC, b.chunk_id)),
once AS (SELECT * FROM (SELECT f.*, file_name, text, row_number() OVER (PARTITION BY query_id, file_name, {_FLAT('text')} ORDER BY score DESC, f.chunk_id) AS nth FROM fused f JOIN chunks c ON f.chunk_id = c.chunk_id) WHERE nth = 1),
cand AS (SELECT query_id, chunk_id, score, text, list_distinct({tok('text')}) AS w FROM (SELECT *, {TOP} AS place FROM once) WHERE place <= 24), {mmr_sql(24)},
reranked AS (SELECT c.query_id, c.chunk_id, p.rank AS mmr_rank, round(0.72 * score + 0.2 * len(list_intersect(list_distinct({tok('question')}), w)) / greatest(len(list_distinct({tok('question')})), 1) + CASE WHEN contains(text, question) THEN 0.12 ELSE 0 END, 9) AS score FROM cand c JOIN picked p ON p.query_id = c.query_id AND p.chunk_id = c.chunk_id JOIN asked a ON a.query_id = c.query_id),
top5 AS (SELECT * FROM (SELECT *, {TOP} AS rank FROM reranked WHERE score >= 0.3) WHERE rank <= 5)"""


def search_stages(spark: S, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Counts of scored and of deduplicated rows, candidates in order of MMR, results, and all chunks in scope."""
    asked = questions(spark, sf)
    first = F.array_join(F.slice(F.split("question", " "), 1, 6), " ")
    rewrites = asked.select((F.col("query_id") * 2).alias("query_id"), "question").unionByName(asked.select((F.col("query_id") * 2 + 1).alias("query_id"), first.alias("question")))
    known = table(spark, sf, "documents").where(F.col("lang").isin("en", "fr")).select(F.col("doc_id").cast("string").alias("document_id"), "doc_id", F.col("source").alias("file_name"))
    scope = chunk_table(spark, sf).join(known, "document_id")
    weight = boosts(spark, sf).select(F.split("chunk_id", ":").getItem(0).alias("document_id"), "boost")
    return ranking.search_pipeline(asked, rewrites, 2, scope, weight, graph_found(spark, sf)[1], graph_weight=0.25, candidates=24, min_score=0.3, k=5)


@query("RET-08", f"""WITH RECURSIVE {_STAGES}, w AS (SELECT chunk_id, array_agg(chunk_id) OVER (PARTITION BY document_id ORDER BY chunk_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS window_ids FROM chunks)
SELECT query_id, chunk_id, rank, mmr_rank, round(score, 6) AS score, window_ids FROM top5 JOIN w USING (chunk_id)""")
def ret08(spark: S, sf: str) -> DataFrame:
    """Two languages, each question and its first six words: hybrid scores, boosts, graph fusion, deduplication, MMR, reranking, a least score and neighbours."""
    *_, found, scope = search_stages(spark, sf)
    around = windows.parent_context(scope, 1).select("chunk_id", F.col("ids").alias("window_ids"))
    return found.join(around, "chunk_id").select("query_id", "chunk_id", "rank", "mmr_rank", F.round("score", 6).alias("score"), "window_ids")


@query("RET-09", f"""WITH RECURSIVE {_STAGES}, n AS (SELECT query_id, count(*) FILTER (WHERE keyword > 0) AS keyword_hits, count(*) FILTER (WHERE vector > 0) AS vector_hits, count(*) AS scored FROM base GROUP BY 1),
o AS (SELECT query_id, count(*) AS deduped FROM once GROUP BY 1), p AS (SELECT query_id, count(*) AS selected FROM picked GROUP BY 1), t AS (SELECT query_id, count(*) AS returned FROM top5 GROUP BY 1)
SELECT query_id, (SELECT count(*) FROM pieces) AS total, (SELECT count(*) FROM chunks) AS available, coalesce(keyword_hits, 0) AS keyword_hits, coalesce(vector_hits, 0) AS vector_hits, coalesce(scored, 0) AS scored, coalesce(deduped, 0) AS deduped, coalesce(selected, 0) AS selected, coalesce(returned, 0) AS returned,
0.62::DOUBLE AS keyword_weight, 0.38::DOUBLE AS vector_weight, len(list_distinct({tok('question')})) AS query_tokens FROM asked LEFT JOIN n USING (query_id) LEFT JOIN o USING (query_id) LEFT JOIN p USING (query_id) LEFT JOIN t USING (query_id)""")
def ret09(spark: S, sf: str) -> DataFrame:
    """Rows at each stage of RET-08."""
    return ranking.search_trace(questions(spark, sf), *search_stages(spark, sf), chunk_table(spark, sf))


def search_citations(spark: S, sf: str) -> DataFrame:
    """The results of the whole search with their texts, files, and the tokens they share with the question."""
    *_, found, scope = search_stages(spark, sf)
    rows = ranking.with_chunks(found, scope.select("chunk_id", "file_name", "text")).join(questions(spark, sf), "query_id")
    shared = F.array_intersect(tx.tokenize(F.col("question")), tx.tokenize(F.col("text")))
    return written(rows.select("query_id", "rank", "chunk_id", "score", "file_name", "text", shared.alias("matched")), "citations")


_FOUND = f"{_STAGES}, cited AS (SELECT t.query_id, rank, t.chunk_id, t.score, file_name, text, list_intersect(list_distinct({tok('question')}), list_distinct({tok('text')})) AS matched FROM top5 t JOIN chunks c ON c.chunk_id = t.chunk_id JOIN asked a ON a.query_id = t.query_id)"
_TOLD = f"""answer AS (SELECT q.query_id, coalesce(string_agg('[' || rank || '] ' || {_CUT(_FLAT('text'), 150)} || ' (' || file_name || ', chunk ' || chunk_id || ', score ' || CAST(score AS DECIMAL(10, 4)) || ')', chr(10) ORDER BY rank), 'no evidence') AS answer FROM asked q LEFT JOIN (SELECT * FROM cited WHERE rank <= 3) c USING (query_id) GROUP BY 1)"""


@query("EVL-04", f"""WITH RECURSIVE {_FOUND}, {_TOLD}, {_SENT}, best AS (SELECT query_id, score AS best_score, matched FROM cited WHERE rank = 1),
d AS (SELECT query_id, {REASON.replace("top_score", "best_score")} AS reason FROM asked LEFT JOIN best b USING (query_id))
SELECT query_id, CASE WHEN reason IS NULL THEN 'answered' ELSE 'refused' END AS decision, reason, CASE WHEN reason IS NULL THEN answer END AS answer, round(cov, 4) AS coverage, round(gro, 4) AS grounding,
CASE WHEN z.n = 0 THEN 'unknown' WHEN c >= 0.35 AND z.n >= 3 AND cov >= 0.65 AND gro >= 0.65 THEN 'strong' WHEN c >= 0.16 AND z.n >= 2 AND cov >= 0.45 AND gro >= 0.45 THEN 'medium' ELSE 'weak' END AS trust FROM d JOIN answer USING (query_id) JOIN z USING (query_id)""")
def evl04(spark: S, sf: str) -> DataFrame:
    """The whole search, the decision, the answer and its audit."""
    found = search_citations(spark, sf)
    answer = ranking.template_answers(questions(spark, sf), found.where("rank <= 3"))
    rows = ranking.refusal_decision(questions(spark, sf), found).join(answer, "query_id").join(an.audit_citations(answer, found), "query_id")
    return rows.select("query_id", "decision", "reason", F.when(F.col("decision") == "answered", F.col("answer")).alias("answer"), "coverage", "grounding", "trust")


@query("RET-12", f"""WITH RECURSIVE {_FOUND}, around AS (SELECT chunk_id, string_agg(text, chr(10)) OVER (PARTITION BY document_id ORDER BY chunk_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM chunks),
p AS (SELECT *, coalesce(list_min(list_filter(list_transform(matched, lambda t: position(t IN lower(text))), lambda x: x > 0)) - 1, 0) AS centre FROM cited), s AS (SELECT *, greatest(centre - 60, 0) AS a, least(greatest(centre - 60, 0) + 180, length(text)) AS b FROM p)
SELECT query_id, chunk_id, rank, round(score, 4) AS score, CASE WHEN a > 0 THEN '...' ELSE '' END || trim(substr(text, a + 1, b - a)) || CASE WHEN b < length(text) THEN '...' ELSE '' END AS snippet, context, ['lang=' || lang] AS metadata FROM s JOIN around USING (chunk_id) JOIN (SELECT doc_id, lang FROM documents) ON doc_id::VARCHAR = string_split(chunk_id, ':')[1]""")
def ret12(spark: S, sf: str) -> DataFrame:
    """Public rows of the whole search: rounded scores, snippets, the context of neighbours, and metadata without private fields."""
    found = search_citations(spark, sf)
    around = windows.parent_context(chunk_table(spark, sf), 1).select("chunk_id", "context")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "lang")
    rows = found.withColumn("document_id", F.split("chunk_id", ":").getItem(0)).join(around, "chunk_id").join(docs, "document_id")
    meta = records.public_metadata(F.create_map(F.lit("lang"), F.col("lang"), F.lit("File_Path"), F.col("file_name")))
    shown = F.transform(F.map_entries(meta), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"), tx.snippet(F.col("text"), F.col("matched")).alias("snippet"), "context", shown.alias("metadata"))
