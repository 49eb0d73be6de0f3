"""Queries over windows: context, dialogue, runs, latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.operators import windows
from siftline.plans.registry import query
from siftline.plans.sql import CHUNKS
from siftline.sources.tables import chunk_table, table

S = SparkSession


@query("WIN-01", f"""WITH {CHUNKS} SELECT chunk_id, string_agg(text, chr(10)) OVER w AS context, array_agg(chunk_id) OVER w AS ids FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def win01(spark: S, sf: str) -> DataFrame:
    return windows.parent_context(chunk_table(spark, sf), 1)


@query("WIN-04", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS chars FROM conversations)
SELECT conv_id, turn, role, text FROM r WHERE back <= 12 AND chars <= 3000""")
def win04(spark: S, sf: str) -> DataFrame:
    return windows.dialogue_context(table(spark, sf, "conversations"), 6, 3000)


@query("WIN-05", """WITH c AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
l AS (SELECT *, least(n, 800) AS m, coalesce(sum(least(n, 800)) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c WHERE k <= 8)
SELECT conv_id, turn, least(m, 3000 - used) AS chars FROM l WHERE used < 3000""")
def win05(spark: S, sf: str) -> DataFrame:
    return windows.pack_evidence(table(spark, sf, "conversations"), 3000, 800, 8)


@query("WIN-06", f"WITH {CHUNKS} SELECT * FROM (SELECT document_id, chunk_id, lead(chunk_id) OVER (PARTITION BY document_id ORDER BY chunk_index) AS following FROM chunks) WHERE following IS NOT NULL")
def win06(spark: S, sf: str) -> DataFrame:
    return windows.adjacent(chunk_table(spark, sf))


_CHAIN = """chain AS (SELECT user_id, event_id, ts, event_type, coalesce(lag(sha256(event_id || ':' || event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS previous_hash,
CASE WHEN event_id % 97 = 5 THEN 'broken' ELSE sha256(event_id || ':' || event_type) END AS event_hash FROM events)"""


@query("WIN-07", f"""WITH {_CHAIN}, v AS (SELECT *, event_hash = sha256(event_id || ':' || event_type) AS own_ok, previous_hash = coalesce(lag(event_hash) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS link_ok FROM chain)
SELECT user_id, count(*) AS n, bool_and(own_ok AND link_ok) AS valid, min(event_id) FILTER (WHERE NOT (own_ok AND link_ok)) AS first_bad FROM v GROUP BY 1""")
def win07(spark: S, sf: str) -> DataFrame:
    """Chains of each user's events, some of them tampered with."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = F.sha2(F.concat_ws(":", "event_id", "event_type"), 256)
    chain = table(spark, sf, "events").withColumn("own", own).withColumn("previous_hash", F.coalesce(F.lag("own").over(w), F.lit("")))
    chain = chain.withColumn("event_hash", F.when(F.col("event_id") % 97 == 5, "broken").otherwise(F.col("own")))
    return windows.verify_hash_chain(chain)


@query("WIN-08", """WITH s AS (SELECT user_id, event_id, ts, event_type <> 'error' AS ok, lag(ts) OVER w AS prev, lag(event_type <> 'error') OVER w AS prev_ok FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(CASE WHEN prev IS NULL OR NOT prev_ok OR date_diff('microsecond', prev, ts) > 86400 * 1000000::BIGINT THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s WHERE ok)
SELECT user_id, run, count(*) AS samples, round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 3) AS seconds FROM i GROUP BY 1, 2""")
def win08(spark: S, sf: str) -> DataFrame:
    return windows.continuous_runs(table(spark, sf, "events"), 86_400)


@query("WIN-09", """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_question FROM conversations""")
def win09(spark: S, sf: str) -> DataFrame:
    return windows.previous_user_turn(table(spark, sf, "conversations"))


@query("TXT-27", r"""WITH p AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM conversations)
SELECT conv_id, turn, substr(CASE WHEN prev IS NOT NULL AND prev <> text AND regexp_matches(text, '(?i)\b(it|this|that|they|these|those|ce|cela|das|dies|eso|esto)\b') THEN text || chr(10) || substr(prev, 1, 1000) ELSE text END, 1, 4000) AS query FROM p WHERE role = 'user'""")
def txt27(spark: S, sf: str) -> DataFrame:
    return windows.followup_query(table(spark, sf, "conversations"))


@query("WIN-10", """WITH runs AS (SELECT DISTINCT date_trunc('day', ts) AS run FROM events), n AS (SELECT run, row_number() OVER (ORDER BY run) AS run_no FROM runs),
users AS (SELECT DISTINCT user_id FROM events), seen AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS run FROM events),
g AS (SELECT u.user_id, n.run_no, s.run IS NOT NULL AS seen FROM users u CROSS JOIN n LEFT JOIN seen s ON s.user_id = u.user_id AND s.run = n.run),
l AS (SELECT *, max(CASE WHEN seen THEN run_no END) OVER (PARTITION BY user_id ORDER BY run_no) AS last_seen FROM g)
SELECT user_id, run_no, run_no - last_seen AS missing, run_no - last_seen >= 2 AS deletion_candidate FROM l WHERE last_seen IS NOT NULL""")
def win10(spark: S, sf: str) -> DataFrame:
    """A run is a day; an item is a user."""
    events = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("run"))
    runs = events.select("run").distinct()
    return windows.missing_counter(events.distinct(), runs)


@query("WIN-11", "SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def win11(spark: S, sf: str) -> DataFrame:
    return windows.latest_per_key(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "ts")
