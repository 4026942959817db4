"""Streams over events, run to their end: the batch table is read as a stream, so results can be held against SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..sources import tables as T
from ..streaming import metrics as M
from .catalog import query


def _to_table(spark, stream, mode="append"):
    """The rows of a stream that runs to its end, from a table in the session's checkpoint folder."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")
    last = []

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{at}/rows-{number}")
        last.append(number)

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows-{last[-1]}") if last else spark.createDataFrame([], stream.schema)


def _events(spark, sf_dir):
    """The events table as a stream of its files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_tumbling", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(avg(value), 8) AS mean FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    rows = _to_table(spark, M.tumbling_counts(_events(spark, sf_dir), "event_type", "ts", "value"), "complete")
    return rows.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 8).alias("mean"))


@query("stream_distinct", "SELECT count(DISTINCT event_id) AS n FROM events")
def stream_distinct(spark, sf_dir):
    return _to_table(spark, M.distinct_events(_events(spark, sf_dir).select("event_id", "ts"), "event_id", "ts")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_zscore", """WITH s AS (SELECT event_id, event_type, value, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS d FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS 99 PRECEDING)) SELECT event_type, event_id, round(CASE WHEN n >= 10 AND d > 0 THEN (value - m) / d ELSE 0 END, 4) AS z FROM s""")
def stream_zscore(spark, sf_dir):
    s = M.zscore_stream(_events(spark, sf_dir).select("event_type", "event_id", "value"), "event_type", "event_id", "value")
    return _to_table(spark, s).select("event_type", "event_id", F.round("z", 4).alias("z"))


@query("stream_price_changes", """WITH p AS (SELECT user_id AS item_id, event_id, value AS after, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE event_type = 'purchase') SELECT item_id, event_id, before, after FROM p WHERE before IS NOT NULL AND before <> after""")
def stream_price_changes(spark, sf_dir):
    e = _events(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("user_id").alias("item_id"), "event_id", F.col("value").alias("price"))
    return _to_table(spark, M.price_change_stream(e, "item_id", "event_id", "price"))


@query("stream_ema", """WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
e AS (SELECT user_id, i, n, value AS v FROM r WHERE i = 1 UNION ALL SELECT e.user_id, r.i, e.n, r.value * (2.0::DOUBLE / 11) + e.v * (1 - 2.0::DOUBLE / 11) FROM e JOIN r ON r.user_id = e.user_id AND r.i = e.i + 1)
SELECT user_id, round(v, 6) AS ema FROM e WHERE i = n""")
def stream_ema(spark, sf_dir):
    s = M.ema_stream(_events(spark, sf_dir).select("user_id", "event_id", "value"), "user_id", "event_id", "value")
    return _to_table(spark, s).groupBy("user_id").agg(F.round(F.max_by("ema", "event_id"), 6).alias("ema"))


@query("alert_cooldown", """WITH RECURSIVE r AS (SELECT event_type, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM events WHERE value > 90),
e AS (SELECT event_type, i, [t] AS sent, t AS fired FROM r WHERE i = 1 UNION ALL SELECT event_type, i, CASE WHEN ok THEN list_append(recent, t) ELSE sent END, CASE WHEN ok THEN t END FROM
 (SELECT *, t - list_last(sent) >= 300 AND len(recent) < 10 AS ok FROM (SELECT r.event_type, r.i, r.t, e.sent, list_filter(e.sent, lambda x: r.t - x < 3600) AS recent FROM e JOIN r ON r.event_type = e.event_type AND r.i = e.i + 1)))
SELECT event_type, fired AS seconds FROM e WHERE fired IS NOT NULL""")
def alert_cooldown(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").filter("value > 90").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    return M.alerts(e, "event_type", "seconds")


@query("rate_limit_bucket", """WITH RECURSIVE r AS (SELECT user_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
e AS (SELECT user_id, i, t, 2.0::DOUBLE AS level, true AS allowed FROM r WHERE i = 1 UNION ALL SELECT user_id, i, t, x - (x >= 1)::INT, x >= 1 FROM (SELECT r.*, least(3.0::DOUBLE, e.level + (r.t - e.t) * (1.0::DOUBLE / 3600)) AS x FROM e JOIN r ON r.user_id = e.user_id AND r.i = e.i + 1))
SELECT user_id, count(*) FILTER (WHERE allowed) AS allowed, count(*) AS n FROM e GROUP BY 1""")
def rate_limit_bucket(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    return M.token_bucket(e, "user_id", "seconds", rate=1 / 3600, capacity=3).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count(F.lit(1)).alias("n"))


@query("circuit_breaker", """WITH RECURSIVE r AS (SELECT user_id, event_id::DOUBLE AS t, value < 60 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
e AS (SELECT user_id, i, 'closed' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS bad, 0.0::DOUBLE AS since FROM r WHERE i = 1 UNION ALL SELECT user_id, i, CASE WHEN st = 'open' THEN 'open' WHEN ok THEN 'closed' WHEN trips THEN 'open' ELSE st END, bad, CASE WHEN trips THEN t ELSE since END FROM
 (SELECT *, st <> 'open' AND NOT ok AND (st = 'half_open' OR bad >= 2) AS trips FROM (SELECT user_id, i, t, ok, st, since, CASE WHEN st = 'open' THEN bad WHEN ok THEN 0 ELSE bad + 1 END AS bad FROM
  (SELECT r.*, e.bad, e.since, CASE WHEN e.state = 'open' AND r.t - e.since >= 500 THEN 'half_open' ELSE e.state END AS st FROM e JOIN r ON r.user_id = e.user_id AND r.i = e.i + 1))))
SELECT user_id, state, count(*) AS n FROM e GROUP BY 1, 2""")
def circuit_breaker(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("double").alias("t"), (F.col("value") < 60).alias("ok"))
    return M.circuit_breaker(e, "user_id", "t", "ok", failures=2, wait=500.0).groupBy("user_id", "state").agg(F.count(F.lit(1)).alias("n"))


@query("sliding_rate_limit", """WITH RECURSIVE r AS (SELECT user_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
e AS (SELECT user_id, i, [t] AS held, true AS allowed FROM r WHERE i = 1 UNION ALL SELECT user_id, i, CASE WHEN len(recent) < 3 THEN list_append(recent, t) ELSE recent END, len(recent) < 3 FROM (SELECT r.user_id, r.i, r.t, list_filter(e.held, lambda x: r.t - x < 86400) AS recent FROM e JOIN r ON r.user_id = e.user_id AND r.i = e.i + 1))
SELECT user_id, count(*) FILTER (WHERE allowed) AS allowed, count(*) AS n FROM e GROUP BY 1""")
def sliding_rate_limit(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    return M.sliding_limit(e, "user_id", "seconds", most=3, window=86400.0).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count(F.lit(1)).alias("n"))


@query("stream_filtered", """SELECT event_id, event_type, value FROM events WHERE value >= 50 AND event_type <> 'view'""")
def stream_filtered(spark, sf_dir):
    """A stream's rows that pass all tests, written batch by batch; a run that is broken off goes on from its checkpoint."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = _events(spark, sf_dir).select("event_id", "event_type", "value")
    q = M.filtered_sink(rows, [F.col("value") >= 50, F.col("event_type") != "view"], lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/rows/batch={n}"), f"{at}/checkpoint")
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/rows").select("event_id", "event_type", "value")
