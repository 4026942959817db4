"""Time series: rolling statistics, price changes, posting patterns, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import windows as W
from ..sources import tables as T
from .catalog import query

GROWTH = """SELECT year, count, CASE WHEN lag(count) OVER w > 0 THEN (count - lag(count) OVER w) * 100.0::DOUBLE / lag(count) OVER w ELSE 0.0::DOUBLE END AS growth_rate FROM (SELECT year(o_orderdate)::INT AS year, count(*) AS count FROM orders GROUP BY 1) WINDOW w AS (ORDER BY year)"""


@query("growth_direction", f"""WITH m AS (SELECT avg(round(growth_rate, 4)) AS m FROM (SELECT * FROM ({GROWTH}) ORDER BY year DESC LIMIT 3))
SELECT round(m, 4) AS mean_growth, CASE WHEN m > 10 THEN 'strong_growth' WHEN m > 2 THEN 'growth' WHEN m > -2 THEN 'stable' WHEN m > -10 THEN 'decline' ELSE 'strong_decline' END AS direction FROM m""")
def growth_direction(spark, sf_dir):
    return W.growth_direction(W.yearly_growth(T.table(spark, sf_dir, "orders").selectExpr("year(o_orderdate) AS year")))


@query("rolling_zscore", """WITH s AS (SELECT event_id, event_type AS metric, value, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS d FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 99 PRECEDING)),
z AS (SELECT event_id, metric, round(CASE WHEN n >= 10 AND d > 0 THEN (value - m) / d ELSE 0 END, 4) AS z FROM s)
SELECT event_id, metric, z, abs(z) >= 2.5 AS anomaly, CASE WHEN abs(z) >= 4 THEN 'critical' WHEN abs(z) >= 3 THEN 'high' WHEN abs(z) >= 2.5 THEN 'medium' WHEN abs(z) >= 2 THEN 'low' ELSE 'none' END AS severity, CASE WHEN z > 0 THEN 'spike' WHEN z < 0 THEN 'drop' ELSE 'flat' END AS kind FROM z""")
def rolling_zscore(spark, sf_dir):
    return W.rolling_zscore(T.metrics(spark, sf_dir), ["metric"], ["ts", "event_id"], "value").drop("ts", "value", "user_id")


@query("composite_rate_limit", """WITH s AS (SELECT event_id, user_id, value, (event_type = 'error')::INT::DOUBLE AS err, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS d, avg((event_type = 'error')::INT::DOUBLE) OVER w AS em, stddev_pop((event_type = 'error')::INT::DOUBLE) OVER w AS ed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 99 PRECEDING)),
z AS (SELECT event_id, user_id, round(CASE WHEN n >= 10 AND d > 0 THEN (value - m) / d ELSE 0 END, 4) AS latency_z, round(CASE WHEN n >= 10 AND ed > 0 THEN (err - em) / ed ELSE 0 END, 4) AS error_z FROM s)
SELECT *, latency_z > 2 AND error_z > 2 AS limited FROM z""")
def composite_rate_limit(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", (F.col("event_type") == "error").cast("double").alias("err"))
    a = W.rolling_zscore(e, ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", "ts", "err", F.col("z").alias("latency_z"))
    return W.rolling_zscore(a, ["user_id"], ["ts", "event_id"], "err").select("event_id", "user_id", "latency_z", F.col("z").alias("error_z"), ((F.col("latency_z") > 2) & (F.col("z") > 2)).alias("limited"))


@query("metric_window_stats", """WITH s AS (SELECT event_id, event_type AS metric, count(*) OVER w AS n, avg(value) OVER w AS m, min(value) OVER w AS low, max(value) OVER w AS high, (epoch_us(ts) - min(epoch_us(ts)) OVER w) / 1e6 AS span FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW))
SELECT event_id, metric, n, round(m, 8) AS mean, low, high, round(CASE WHEN n <= 1 OR span <= 0 THEN n * 60.0 / 300 ELSE n / span * 60 END, 4) AS rate_per_minute FROM s""")
def metric_window_stats(spark, sf_dir):
    return W.time_window_stats(T.metrics(spark, sf_dir), ["metric"], "ts", "value").drop("ts", "value", "user_id")


@query("ema_per_user", """WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
e AS (SELECT user_id, i, n, value AS v FROM r WHERE i = 1 UNION ALL SELECT e.user_id, r.i, e.n, r.value * (2.0::DOUBLE / 11) + e.v * (1 - 2.0::DOUBLE / 11) FROM e JOIN r ON r.user_id = e.user_id AND r.i = e.i + 1)
SELECT user_id, round(v, 6) AS ema FROM e WHERE i = n""")
def ema_per_user(spark, sf_dir):
    return W.ema(T.metrics(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value")


PRICES = "SELECT user_id AS item_id, ts, value AS price, event_id FROM events WHERE event_type = 'purchase'"


@query("price_changes", f"""WITH p AS (SELECT *, lag(price) OVER w AS b, first_value(price) OVER w AS f FROM ({PRICES}) WINDOW w AS (PARTITION BY item_id ORDER BY ts, event_id))
SELECT item_id, ts, event_id, b AS price_before, price AS price_after, round(price - b, 4) AS delta, round(CASE WHEN b > 0 THEN (price - b) * 100 / b ELSE 0 END, 4) AS delta_percent, round(price - f, 4) AS delta_from_initial,
 round(CASE WHEN f > 0 THEN (price - f) * 100 / f ELSE 0 END, 4) AS delta_from_initial_percent, CASE WHEN price > b THEN 'up' ELSE 'down' END AS direction, abs(CASE WHEN b > 0 THEN (price - b) * 100 / b ELSE 0 END) >= 20 AS is_significant FROM p WHERE b IS NOT NULL AND price <> b""")
def price_changes(spark, sf_dir):
    return W.price_changes(T.prices(spark, sf_dir))


@query("price_report", f"""WITH r AS (SELECT item_id, count(*) AS n, min_by(price, struct_pack(t := ts, e := event_id)) AS first_price, max_by(price, struct_pack(t := ts, e := event_id)) AS last_price, min(price) AS lowest, max(price) AS highest FROM ({PRICES}) GROUP BY 1)
SELECT *, round(last_price - first_price, 4) AS delta, round(CASE WHEN first_price > 0 THEN (last_price - first_price) * 100 / first_price ELSE 0 END, 4) AS delta_percent, CASE WHEN last_price > first_price THEN 'rise' WHEN last_price < first_price THEN 'fall' ELSE 'stable' END AS trend FROM r""")
def price_report(spark, sf_dir):
    return W.price_report(T.prices(spark, sf_dir))


@query("price_trend", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) AS r FROM ({PRICES})),
p AS (SELECT item_id, count(*) AS n, max(price) FILTER (WHERE r = 1) AS p1, max(price) FILTER (WHERE r = 2) AS p2, max(price) FILTER (WHERE r = 3) AS p3 FROM r WHERE r <= 3 GROUP BY 1)
SELECT item_id, CASE WHEN n < 2 THEN 'insufficient' WHEN p1 >= p2 AND coalesce(p2 >= p3, true) THEN 'rising' WHEN p1 <= p2 AND coalesce(p2 <= p3, true) THEN 'falling' ELSE 'fluctuating' END AS trend FROM p""")
def price_trend(spark, sf_dir):
    return W.last_three_trend(T.prices(spark, sf_dir))


@query("price_alerts", f"""WITH p AS (SELECT *, lag(price) OVER (PARTITION BY item_id ORDER BY ts, event_id) AS b FROM ({PRICES}))
SELECT event_id, item_id, price, price <= 10 AS hit_target, coalesce((b - price) * 100 / nullif(b, 0) >= 20, false) AS hit_threshold FROM p WHERE b IS NOT NULL AND price <> b AND (price <= 10 OR (b - price) * 100 / nullif(b, 0) >= 20)""")
def price_alerts(spark, sf_dir):
    c = W.price_changes(T.prices(spark, sf_dir))
    drop = F.coalesce((F.col("price_before") - F.col("price_after")) * 100 / F.nullif("price_before", F.lit(0.0)) >= 20, F.lit(False))
    return c.select("event_id", "item_id", F.col("price_after").alias("price"), (F.col("price_after") <= 10).alias("hit_target"), drop.alias("hit_threshold")).filter("hit_target OR hit_threshold")


@query("posting_intervals", """WITH i AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3.6e9 AS h FROM events),
s AS (SELECT user_id, count(*) AS n_intervals, avg(h) AS m, quantile_cont(h, 0.5) AS md, coalesce(stddev_samp(h), 0) AS sd, stddev_pop(h) AS sp FROM i WHERE h > 0 GROUP BY 1)
SELECT user_id, n_intervals, round(m, 4) AS mean_hours, round(md, 4) AS median_hours, round(sd, 4) AS deviation_hours, round(greatest(0.0, 1 - sp / m), 4) AS regularity, round((sp - m) / (sp + m), 4) AS burstiness FROM s""")
def posting_intervals(spark, sf_dir):
    return W.interval_stats(T.posts(spark, sf_dir), "user_id", "ts", "event_id")


@query("half_trend", """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
h AS (SELECT user_id, avg(value) FILTER (WHERE i <= n // 2) AS a, avg(value) FILTER (WHERE i > n // 2) AS b FROM r GROUP BY 1)
SELECT user_id, round(a, 9) AS first_half, round(b, 9) AS second_half, CASE WHEN b > a * 1.1 THEN 'increasing' WHEN b < a * 0.9 THEN 'decreasing' ELSE 'stable' END AS trend FROM h""")
def half_trend(spark, sf_dir):
    return W.half_trend(T.metrics(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value")


@query("numbering_gaps", """WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N'), n AS (SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS next_value FROM d)
SELECT *, (next_value - l_linenumber)::BIGINT AS gap FROM n WHERE next_value - l_linenumber > 1""")
def numbering_gaps(spark, sf_dir):
    return W.gaps(T.table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N'"), ["l_orderkey"], "l_linenumber")


@query("user_sessions", """WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 1800000000, true)::INT AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g) SELECT user_id, count(*) AS n_events, min(ts) AS session_start, max(ts) AS session_end FROM s GROUP BY user_id, sid""")
def user_sessions(spark, sf_dir):
    return W.sessions(T.posts(spark, sf_dir), "user_id", "ts")


@query("tumbling_hour_counts", """SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(value), 8) AS mean FROM events GROUP BY 1, 2""")
def tumbling_hour_counts(spark, sf_dir):
    rows = T.posts(spark, sf_dir).groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 8).alias("mean"))
    return rows.select("event_type", F.col("w.start").alias("hour"), "n", "mean")


@query("sliding_window_counts", """WITH x AS (SELECT event_type, unnest([date_trunc('minute', ts) - k * INTERVAL 1 MINUTE FOR k IN range(5)]) AS window_start FROM events) SELECT event_type, window_start, count(*) AS n FROM x GROUP BY 1, 2""")
def sliding_window_counts(spark, sf_dir):
    rows = T.posts(spark, sf_dir).groupBy("event_type", F.window("ts", "5 minutes", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("event_type", F.col("w.start").alias("window_start"), "n")


@query("next_post_prediction", """WITH i AS (SELECT user_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS d FROM events), m AS (SELECT user_id, max(ts) AS last_ts, quantile_cont(d, 0.5) FILTER (WHERE d > 0) AS md FROM i GROUP BY 1)
SELECT user_id, date_trunc('hour', make_timestamp((epoch_us(last_ts) + md)::BIGINT)) AS predicted_hour FROM m WHERE md IS NOT NULL""")
def next_post_prediction(spark, sf_dir):
    p = T.posts(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = p.withColumn("d", W.micros("ts") - W.micros(F.lag("ts").over(w)))
    m = d.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.percentile(F.when(F.col("d") > 0, F.col("d")), 0.5).alias("md")).filter("md IS NOT NULL")
    return m.select("user_id", F.date_trunc("hour", F.timestamp_micros((W.micros("last_ts") + F.col("md")).cast("long"))).cast("timestamp_ntz").alias("predicted_hour"))


@query("posting_regularity", """WITH h AS (SELECT user_id, hour(ts) AS k, count(*) AS c FROM events GROUP BY 1, 2), d AS (SELECT user_id, isodow(ts) AS k, count(*) AS c FROM events GROUP BY 1, 2), n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
he AS (SELECT user_id, -sum(c / n * log2(c / n)) AS e FROM h JOIN n USING (user_id) GROUP BY 1), de AS (SELECT user_id, -sum(c / n * log2(c / n)) AS e FROM d JOIN n USING (user_id) GROUP BY 1),
i AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3.6e9 AS h FROM events), s AS (SELECT user_id, greatest(0.0, 1 - stddev_samp(h) / avg(h)) AS r FROM i WHERE h > 0 GROUP BY 1 HAVING count(*) > 1),
x AS (SELECT n.user_id, 0.5 * (1 - he.e / log2(24)) + 0.35 * coalesce(s.r, 0) + 0.15 * (1 - de.e / log2(7)) AS r FROM n JOIN he USING (user_id) JOIN de USING (user_id) LEFT JOIN s USING (user_id))
SELECT user_id, round(r, 4) AS regularity, CASE WHEN round(r, 4) >= 0.6 THEN 'regular' WHEN round(r, 4) >= 0.3 THEN 'semi_regular' ELSE 'irregular' END AS user_type FROM x""")
def posting_regularity(spark, sf_dir):
    import math

    p = T.posts(spark, sf_dir)

    def evenness(part, slots):
        c = p.groupBy("user_id", part.alias("k")).agg(F.count(F.lit(1)).alias("c"))
        total = c.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy("user_id")))
        return total.groupBy("user_id").agg((1 + F.sum(F.col("share") * F.log2("share")) / math.log2(slots)).alias("x"))

    i = W.intervals(p, "user_id", "ts", "event_id").filter("hours > 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(0.0), 1 - F.stddev_samp("hours") / F.avg("hours")).alias("r")).filter("n > 1")
    rows = evenness(F.hour("ts"), 24).withColumnRenamed("x", "h").join(evenness(F.weekday("ts"), 7).withColumnRenamed("x", "d"), "user_id").join(i, "user_id", "left")
    r = F.round(0.5 * F.col("h") + 0.35 * F.coalesce("r", F.lit(0.0)) + 0.15 * F.col("d"), 4)
    return rows.select("user_id", r.alias("regularity"), F.when(r >= 0.6, "regular").when(r >= 0.3, "semi_regular").otherwise("irregular").alias("user_type"))
