"""Queries over streams: the events table read as a stream of files, run until all is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.corpus import hard_split
from siftline.plans.registry import query
from siftline.plans.sql import CHUNKS
from siftline.sources.scratch import fresh_path
from siftline.sources.tables import table
from siftline.streaming import stateful, streams

S = SparkSession
#: In append mode a window comes out once the watermark, the latest time less an hour, has passed its end.
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("STR-03", f"SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= {_CLOSED}")
def str03(spark: S, sf: str) -> DataFrame:
    rows = streams.finished(streams.metric_windows(streams.event_stream(spark, sf)))
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("STR-04", f"""WITH e AS (SELECT user_id, ts, unnest(range(0, 6)) AS k FROM events), w AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS start FROM e)
SELECT start, user_id, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 4 AND start + INTERVAL 6 HOUR <= {_CLOSED}""")
def str04(spark: S, sf: str) -> DataFrame:
    rows = streams.finished(streams.rate_breaches(streams.event_stream(spark, sf), 4, "6 hours", "1 hour"))
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("STR-05", f"""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM events WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS stop, count(*) AS n FROM r GROUP BY user_id, run HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type <> 'error')""")
def str05(spark: S, sf: str) -> DataFrame:
    rows = streams.finished(streams.health_sessions(streams.event_stream(spark, sf), "12 hours"))
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("stop", F.col("stop").cast("timestamp_ntz"))


@query("STR-09", f"""WITH e AS (SELECT user_id, date_trunc('millisecond', ts) AS ts, event_id, event_type = 'view' AS queued FROM events WHERE event_type IN ('view', 'click') AND ts < (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type IN ('view', 'click'))),
g AS (SELECT *, count(*) FILTER (WHERE NOT queued) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS life FROM e), w AS (SELECT user_id, life, min(ts) FILTER (WHERE queued) AS start FROM g GROUP BY 1, 2),
t AS (SELECT w.user_id, start, stop FROM w LEFT JOIN (SELECT user_id, life, min(ts) AS stop FROM g WHERE NOT queued GROUP BY 1, 2) n ON n.user_id = w.user_id AND n.life = w.life + 1 WHERE start IS NOT NULL),
h AS (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM e)::TIMESTAMP, (SELECT max(ts) FROM e)::TIMESTAMP + INTERVAL 2 HOUR, INTERVAL 1 HOUR)) AS stop)
SELECT h.stop, count(*) AS depth, (epoch_ms(h.stop) - epoch_ms(min(t.start))) / 1000.0 AS age FROM h JOIN t ON t.start < h.stop AND (t.stop IS NULL OR t.stop >= h.stop) WHERE h.stop <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type IN ('view', 'click')) GROUP BY h.stop""")
def str09(spark: S, sf: str) -> DataFrame:
    """Users stand for jobs: a view queues one and a click starts it; depth and age at the end of each hour."""
    events = streams.event_stream(spark, sf).where("event_type IN ('view', 'click')")
    jobs = events.select(F.col("user_id").alias("job_id"), "ts", "event_id", F.when(F.col("event_type") == "view", "queued").otherwise("started").alias("what"))
    return stateful.index_lag(streams.finished(stateful.open_jobs(jobs), stateful.STORE)).withColumn("stop", F.col("stop").cast("timestamp_ntz"))


_WHAT = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'started' WHEN 'view' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'cancelled' END"


@query("STR-06", f"""WITH passed AS (SELECT epoch_ms(max(ts)) - 3600000 AS w FROM events), e AS (SELECT user_id AS job_id, ts, event_id, {_WHAT} AS what FROM events WHERE epoch_ms(ts) < (SELECT w FROM passed)), s AS (SELECT *, count(*) FILTER (WHERE what = 'queued') OVER (PARTITION BY job_id ORDER BY ts, event_id) AS life FROM e),
l AS (SELECT *, max(life) OVER (PARTITION BY job_id) AS last_life FROM s), c AS (SELECT *, count(*) FILTER (WHERE what IN ('succeeded', 'cancelled')) OVER (PARTITION BY job_id, life ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM l WHERE life = last_life),
o AS (SELECT job_id, arg_max(what, (ts, event_id)) AS status, max(ts) AS moved, count(*) FILTER (WHERE what = 'started')::INT AS attempts FROM c WHERE ended = 0 GROUP BY 1),
r AS (SELECT job_id, CASE WHEN status = 'started' AND epoch_us(moved + INTERVAL 6 HOUR) < (SELECT w FROM passed) * 1000 THEN 'failed' ELSE status END AS status, attempts FROM o)
SELECT *, CASE WHEN status = 'failed' AND attempts < 3 THEN least(pow(2.0, attempts - 1), 30.0) END AS delay, status = 'failed' AND attempts >= 3 AS dead FROM r""")
def str06(spark: S, sf: str) -> DataFrame:
    """Users stand for jobs, the types of their events for what befell them; what the watermark has not passed is not told yet."""
    events = streams.event_stream(spark, sf).withColumn("what", F.expr(_WHAT)).withColumnRenamed("user_id", "job_id")
    return streams.job_states(streams.finished(streams.job_transitions(events)))


#: A message's first piece comes at so many seconds, a piece each second, and a fourth of the messages has no end.
_SAID = "conv_id * 60 + turn * 5"


@query("STR-08", f"""WITH m AS (SELECT conv_id * 1000 + turn AS message_id, coalesce(text, '') AS text, turn % 4 AS kind, {_SAID} AS begins, ceil(length(coalesce(text, '')) / 20.0)::INT AS n FROM conversations),
e AS (SELECT *, begins + n + CASE WHEN kind < 3 THEN 1 ELSE 600 END AS ended, begins + n + CASE WHEN kind < 3 THEN 1 ELSE 0 END AS latest FROM m)
SELECT message_id, text, CASE kind WHEN 0 THEN 'completed' WHEN 1 THEN 'refused' WHEN 2 THEN 'failed' ELSE 'cancelled' END AS status, kind >= 2 AS partial FROM e WHERE ended < (SELECT max(latest) - 600 FROM e)""")
def str08(spark: S, sf: str) -> DataFrame:
    """Turns come as pieces of 20 characters, each twice, and an end that depends on the turn; what has not ended by the watermark is not told yet."""
    stream = streams.table_stream(spark, sf, "conversations")
    text = F.coalesce("text", F.lit(""))
    count = F.ceil(F.length(text) / 20).cast("int")
    end = F.when(F.col("turn") % 4 == 0, "done").when(F.col("turn") % 4 == 1, "refusal").when(F.col("turn") % 4 == 2, "error")
    numbers = F.sequence(F.lit(0), count)
    # A row holds its text only until its piece is cut from it.
    every = F.explode(F.concat(numbers, F.when(end.isNotNull(), F.array(count + 1)).otherwise(F.array().cast("array<int>")), numbers))
    rows = stream.select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.expr(_SAID).alias("begins"), text.alias("text"), count.alias("count"), end.alias("end"), every.alias("sequence"))
    last = F.col("sequence") > F.col("count")
    deltas = rows.select("message_id", "begins", "sequence", F.when(last, F.col("end")).otherwise("delta").alias("what"), F.when(last, "").otherwise(F.col("text").substr(F.col("sequence") * 20 + 1, F.lit(20))).alias("delta"))
    deltas = deltas.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("begins") + F.col("sequence")))
    return streams.finished(stateful.assembled_messages(deltas), stateful.STORE)


@query("STR-01", r"SELECT event_id, user_id, lower(trim(regexp_replace(props, '\s+', ' ', 'g'))) AS props, sha256(lower(trim(regexp_replace(props, '\s+', ' ', 'g')))) AS content_hash FROM events")
def str01(spark: S, sf: str) -> DataFrame:
    """Every event is delivered twice."""
    twice = streams.event_stream(spark, sf).withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).drop("delivery")
    return streams.finished(streams.ingest(twice, "props")).select("event_id", "user_id", "props", "content_hash")


@query("STR-02", f"WITH {CHUNKS} SELECT chunk_id, document_id, md5(text) AS text_md5 FROM chunks")
def str02(spark: S, sf: str) -> DataFrame:
    """The documents as a stream; every chunk comes in an older version as well."""
    stream = streams.table_stream(spark, sf, "documents")
    docs = stream.select(F.col("doc_id").cast("string").alias("document_id"), "text")
    versions = hard_split(docs).withColumn("version", F.explode(F.array(F.lit(2), F.lit(1))))
    text = F.when(F.col("version") == 1, F.concat(F.lit("~"), "text")).otherwise(F.col("text"))
    rows = versions.select("chunk_id", "document_id", "version", F.md5(text).alias("text_md5"))
    return streams.upserted(rows, "chunk_id", "version").select("chunk_id", "document_id", "text_md5")


_RUN_STATUS = "CASE WHEN day(run) % 6 = 0 THEN 'partial' WHEN day(run) % 7 = 1 THEN 'not_modified' WHEN day(run) % 11 = 5 THEN 'empty' ELSE 'complete' END"


@query("STR-07", f"""WITH r AS (SELECT user_id % 3 AS source, date_trunc('day', ts)::TIMESTAMP AS run, user_id AS item_id, arg_max(event_id, (ts, event_id)) AS version FROM events GROUP BY 1, 2, 3),
o AS (SELECT *, {_RUN_STATUS} AS status FROM r WHERE run < (SELECT max(run) FROM r)), d AS (SELECT DISTINCT source, run, status FROM o),
known AS (SELECT source, item_id, run, version, 0 AS missing FROM o WHERE status IN ('complete', 'partial') UNION ALL SELECT s, -1 - s, NULL, 7, 1 FROM range(3) t(s)),
l AS (SELECT source, item_id, max(run) AS run, arg_max(version, coalesce(run, '1970-01-01'::TIMESTAMP)) AS version, arg_max(missing, coalesce(run, '1970-01-01'::TIMESTAMP)) AS missing FROM known GROUP BY 1, 2),
n AS (SELECT source, item_id, version, missing + (SELECT count(*) FROM d WHERE d.source = l.source AND d.status = 'complete' AND (l.run IS NULL OR d.run > l.run)) AS missing FROM l)
SELECT source, item_id, version, missing, missing >= 2 AS deletion_candidate FROM n""")
def str07(spark: S, sf: str) -> DataFrame:
    """Users stand for items of three sources, days for runs; some runs are partial, not modified or empty. One item of each source is known from a snapshot only."""
    source, run = (F.col("user_id") % 3).alias("source"), F.date_trunc("day", "ts").alias("run")
    path = fresh_path(spark, "runs")
    runs = table(spark, sf, "events").select(source, F.date_trunc("day", F.col("ts").cast("timestamp")).alias("run")).distinct()
    ends = runs.select("source", (F.col("run") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MILLISECOND")).alias("ts"), "run", F.expr(_RUN_STATUS).alias("status"))
    ends.write.parquet(path)
    none = F.lit(None).cast("long")
    ended = spark.readStream.schema(ends.schema).parquet(path).select("source", "ts", "run", "status", none.alias("item_id"), none.alias("version"))
    seen = streams.event_stream(spark, sf).select(source, "ts", run, F.lit(None).cast("string").alias("status"), F.col("user_id").alias("item_id"), F.col("event_id").alias("version"))
    snapshot = spark.range(3).select(F.col("id").alias("source"), (-1 - F.col("id")).alias("item_id"), F.lit(7).cast("long").alias("version"), F.lit(1).cast("long").alias("missing"))
    moved = streams.finished(stateful.source_items(seen.unionByName(ended), snapshot), stateful.STORE)
    last = moved.groupBy("source", "item_id").agg(F.max_by(F.struct("version", "missing", "deletion_candidate"), "run").alias("s"))
    return last.select("source", "item_id", "s.*")
