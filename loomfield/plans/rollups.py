"""Rollups, order statistics, concentration and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators.windows import micros
from ..sources import tables as T
from .catalog import query

PAPERS = "SELECT o_orderkey AS paper_id, year(o_orderdate)::INT AS year, floor(o_totalprice / 1000)::BIGINT AS citation_count, c_mktsegment AS journal, o_orderpriority AS source_api FROM orders JOIN customer ON o_custkey = c_custkey"


@query("journal_metrics", f"""SELECT journal, year, count(*) AS n_papers, sum(citation_count)::BIGINT AS total_citations, round(avg(citation_count), 6) AS impact_factor,
 round(quantile_cont(citation_count, 0.25), 6) AS p25, round(quantile_cont(citation_count, 0.5), 6) AS median, round(quantile_cont(citation_count, 0.75), 6) AS p75, round(quantile_cont(citation_count, 0.9), 6) AS p90
FROM ({PAPERS}) GROUP BY journal, year""")
def journal_metrics(spark, sf_dir):
    return A.journal_metrics(T.papers(spark, sf_dir), ["journal", "year"])


@query("h_index", f"""WITH r AS (SELECT journal, citation_count, row_number() OVER (PARTITION BY journal ORDER BY citation_count DESC) AS rn FROM ({PAPERS}))
SELECT journal, count(*) FILTER (WHERE citation_count >= rn) AS h_index FROM r GROUP BY journal""")
def h_index(spark, sf_dir):
    return A.h_index(T.papers(spark, sf_dir), ["journal"])


@query("gini_standard", f"""WITH r AS (SELECT journal, citation_count::DOUBLE AS v, row_number() OVER (PARTITION BY journal ORDER BY citation_count) AS i, count(*) OVER (PARTITION BY journal) AS n FROM ({PAPERS}))
SELECT journal, round(sum((2 * i - n - 1) * v) / (max(n) * sum(v)), 6) AS gini FROM r GROUP BY journal""")
def gini_standard(spark, sf_dir):
    return A.gini(T.papers(spark, sf_dir), ["journal"], "citation_count")


@query("gini_cumulative", f"""WITH r AS (SELECT journal, sum(citation_count::DOUBLE) OVER (PARTITION BY journal ORDER BY citation_count, paper_id ROWS UNBOUNDED PRECEDING) AS cum, citation_count AS v FROM ({PAPERS}))
SELECT journal, round(greatest(0.0, least(1.0, 1 - sum(cum) / (count(*) * sum(v)::DOUBLE) + 1.0 / (2 * count(*))))::DOUBLE, 6) AS gini FROM r GROUP BY journal""")
def gini_cumulative(spark, sf_dir):
    return A.gini(T.papers(spark, sf_dir), ["journal"], "citation_count", variant="cumulative")


@query("top_share", f"""WITH r AS (SELECT journal, citation_count AS v, row_number() OVER (PARTITION BY journal ORDER BY citation_count DESC) AS i, count(*) OVER (PARTITION BY journal) AS n FROM ({PAPERS}))
SELECT journal, round(sum(v) FILTER (WHERE i <= greatest(1, floor(n * 10 / 100)))::DOUBLE / sum(v), 6) AS top_share FROM r GROUP BY journal""")
def top_share(spark, sf_dir):
    return A.top_share(T.papers(spark, sf_dir), ["journal"], "citation_count")


@query("immediacy_index", f"""SELECT journal, round(avg(citation_count) FILTER (WHERE year = 1997), 6) AS immediacy_index FROM ({PAPERS}) GROUP BY journal""")
def immediacy_index(spark, sf_dir):
    return T.papers(spark, sf_dir).groupBy("journal").agg(F.round(F.avg(F.when(F.col("year") == 1997, F.col("citation_count"))), 6).alias("immediacy_index"))


@query("funder_rollup", """SELECT n_name AS funder, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 8) AS mean, count(DISTINCT o_custkey) AS n_distinct
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def funder_rollup(spark, sf_dir):
    o, c, n = (T.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return A.rollup_report(rows.withColumnRenamed("n_name", "funder"), ["funder"], "o_totalprice", "o_custkey")


@query("funding_by_year_roi", """SELECT year(o_orderdate)::INT AS year, n_name AS funder, count(*) AS n_papers, sum(floor(o_totalprice / 1000))::BIGINT AS citations, round(sum(floor(o_totalprice / 1000)) / count(*), 6) AS citations_per_paper
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def funding_by_year_roi(spark, sf_dir):
    o, c, n = (T.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    cites = F.sum(F.floor(F.col("o_totalprice") / 1000))
    return rows.groupBy(F.year("o_orderdate").alias("year"), F.col("n_name").alias("funder")).agg(F.count(F.lit(1)).alias("n_papers"), cites.cast("long").alias("citations"), F.round(cites / F.count(F.lit(1)), 6).alias("citations_per_paper"))


@query("author_fold", """WITH a AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), t AS (SELECT l_suppkey, o_orderpriority AS topic, count(*) AS c, sum(floor(o_totalprice / 1000)) AS s FROM a JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY c DESC, topic) AS rn FROM t)
SELECT l_suppkey AS author_id, sum(c)::BIGINT AS n_papers, sum(s)::BIGINT AS citations, max(topic) FILTER (WHERE rn = 1) AS main_topic, string_agg(topic, ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS top_topics FROM r GROUP BY 1""")
def author_fold(spark, sf_dir):
    a, o = T.authors(spark, sf_dir), T.table(spark, sf_dir, "orders")
    t = a.join(o, a.paper_id == o.o_orderkey).groupBy("author_id", F.col("o_orderpriority").alias("topic")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.floor(F.col("o_totalprice") / 1000)).alias("s"))
    r = A.top_per_key(t, ["author_id"], [F.desc("c"), F.asc("topic")], 1 << 30, "rn")
    top = F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", "topic")))), lambda x: x["topic"])
    return r.groupBy("author_id").agg(F.sum("c").alias("n_papers"), F.sum("s").cast("long").alias("citations"), F.max(F.when(F.col("rn") == 1, F.col("topic"))).alias("main_topic"), F.array_join(top, ",").alias("top_topics"))


@query("follower_stats", """SELECT c_mktsegment AS platform, count(*) AS n_users, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 8) AS mean, min(c_acctbal) AS lowest, max(c_acctbal) AS highest FROM customer GROUP BY 1""")
def follower_stats(spark, sf_dir):
    return T.table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("platform")).agg(
        F.count(F.lit(1)).alias("n_users"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.round(F.avg("c_acctbal"), 8).alias("mean"), F.min("c_acctbal").alias("lowest"), F.max("c_acctbal").alias("highest"))


@query("success_rates", """SELECT user_id % 10 AS pattern_key, event_type AS audience, count(*) AS uses, count(*) FILTER (WHERE value > 50) AS wins, round(count(*) FILTER (WHERE value > 50) / count(*), 6) AS success_rate FROM events GROUP BY 1, 2""")
def success_rates(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    return A.success_rate(e.select((F.col("user_id") % 10).alias("pattern_key"), F.col("event_type").alias("audience"), "value"), ["pattern_key", "audience"], F.col("value") > 50)


@query("best_patterns", """SELECT user_id AS pattern_key, count(*) AS uses, count(*) FILTER (WHERE value > 50) AS wins, round(count(*) FILTER (WHERE value > 50) / count(*), 6) AS success_rate FROM events GROUP BY 1 ORDER BY success_rate DESC, pattern_key LIMIT 20""")
def best_patterns(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("pattern_key"), "value")
    return A.success_rate(e, ["pattern_key"], F.col("value") > 50).orderBy(F.desc("success_rate"), "pattern_key").limit(20)


@query("metric_stats", """SELECT event_type AS metric, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 8) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS deviation, max_by(value, struct_pack(ts := ts, id := event_id)) AS gauge FROM events GROUP BY 1""")
def metric_stats(spark, sf_dir):
    return T.metrics(spark, sf_dir).groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 8).alias("mean"),
        F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 4).alias("deviation"), F.max_by("value", F.struct("ts", "event_id")).alias("gauge"))


@query("collector_totals", """SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate,
 round(avg(value) FILTER (WHERE event_type <> 'error'), 8) AS mean_ok, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 4) AS uptime_hours FROM events GROUP BY 1""")
def collector_totals(spark, sf_dir):
    error = F.col("event_type") == "error"
    return T.table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(error).alias("errors"), F.round(F.count_if(error) / F.count(F.lit(1)), 6).alias("error_rate"),
        F.round(F.avg(F.when(~error, F.col("value"))), 8).alias("mean_ok"), F.round((micros(F.max("ts")) - micros(F.min("ts"))) / 3.6e9, 4).alias("uptime_hours"))


@query("model_accuracy", """WITH r AS (SELECT event_type AS model, value, (value > 50) = (user_id % 2 = 0) AS correct, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT model, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(value) FILTER (WHERE rn <= 1000), 8) AS mean_latency FROM r GROUP BY 1""")
def model_accuracy(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    e = T.table(spark, sf_dir, "events")
    recent = e.select("event_type", "ts", "event_id", "value").withColumn("rn", F.row_number().over(w)).filter("rn <= 1000").groupBy("event_type").agg(F.round(F.avg("value"), 8).alias("mean_latency"))
    correct = ((F.col("value") > 50) == (F.col("user_id") % 2 == 0)).cast("int")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(correct), 6).alias("accuracy")).join(recent, "event_type").withColumnRenamed("event_type", "model")


@query("parity_by_lang", """WITH p AS (SELECT lang, count(*) AS n, avg((quality = 1)::INT::DOUBLE) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT lang, n, round(rate, 6) AS rate, round((SELECT max(rate) - min(rate) FROM p), 6) AS gap, (SELECT max(rate) - min(rate) FROM p) > 0.2 AS biased FROM p""")
def parity_by_lang(spark, sf_dir):
    rows = T.table(spark, sf_dir, "labels").join(T.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return A.parity(rows, "lang", F.col("quality") == 1)


@query("ab_test", """WITH o AS (SELECT event_type AS test, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS variant, value FROM events),
m AS (SELECT test, count(*) FILTER (WHERE variant = 'a') AS n_a, count(*) FILTER (WHERE variant = 'b') AS n_b, avg(value) FILTER (WHERE variant = 'a') AS ma, avg(value) FILTER (WHERE variant = 'b') AS mb FROM o GROUP BY 1)
SELECT test, n_a, n_b, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, CASE WHEN n_a >= 100 AND n_b >= 100 AND abs(ma - mb) >= 0.01 THEN CASE WHEN ma > mb THEN 'a' ELSE 'b' END ELSE 'none' END AS winner FROM m""")
def ab_test(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("test"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("variant"), "value")
    return A.ab_test(e, "test", "variant", "value")


@query("ab_assignment", """SELECT user_id, ('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 100 AS bucket, CASE WHEN ('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 100 < 50 THEN 'a' ELSE 'b' END AS variant FROM (SELECT DISTINCT user_id FROM events)""")
def ab_assignment(spark, sf_dir):
    bucket = F.conv(F.substring(F.md5(F.col("user_id").cast("string")), 1, 8), 16, 10).cast("long") % 100
    return T.table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", bucket.alias("bucket"), F.when(bucket < 50, "a").otherwise("b").alias("variant"))


@query("hourly_histogram", """WITH c AS (SELECT hour(ts)::INT AS hour, count(*) AS c FROM events GROUP BY 1) SELECT h::INT AS hour, coalesce(c, 0) AS count, round(coalesce(c / (SELECT sum(c) FROM c), 0), 6) AS share FROM range(24) t(h) LEFT JOIN c ON c.hour = h""")
def hourly_histogram(spark, sf_dir):
    return A.histogram(T.posts(spark, sf_dir), F.hour("ts"), 24, "hour")


@query("weekday_histogram", """WITH c AS (SELECT (isodow(ts) - 1)::INT AS weekday, count(*) AS c FROM events GROUP BY 1) SELECT h::INT AS weekday, coalesce(c, 0) AS count, round(coalesce(c / (SELECT sum(c) FROM c), 0), 6) AS share FROM range(7) t(h) LEFT JOIN c ON c.weekday = h""")
def weekday_histogram(spark, sf_dir):
    return A.histogram(T.posts(spark, sf_dir), F.weekday("ts"), 7, "weekday")


@query("posting_peak", """WITH h AS (SELECT user_id, hour(ts) AS hour, count(*) AS c FROM events GROUP BY 1, 2), d AS (SELECT user_id, isodow(ts) - 1 AS day, count(*) AS c FROM events GROUP BY 1, 2)
SELECT user_id, peak_hour::INT AS peak_hour, peak_day::INT AS peak_day FROM (SELECT user_id, hour AS peak_hour FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, hour) = 1) JOIN (SELECT user_id, day AS peak_day FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, day) = 1) USING (user_id)""")
def posting_peak(spark, sf_dir):
    p = T.posts(spark, sf_dir)

    def peak(part, name):
        return p.groupBy("user_id", part.alias(name)).count().groupBy("user_id").agg(F.max_by(name, F.struct("count", -F.col(name))).alias(f"peak_{name}"))

    return peak(F.hour("ts"), "hour").join(peak(F.weekday("ts"), "day"), "user_id")


@query("spam_indicators", r"""SELECT source, lang, count(*) AS n_posts, round(sum(len(regexp_extract_all(text, '#[A-Za-z0-9_]+'))) / count(*), 6) AS hashtags_per_post, round(sum(len(regexp_extract_all(text, '@[A-Za-z0-9_]+'))) / count(*), 6) AS mentions_per_post,
 round(sum(len(regexp_extract_all(lower(text), '(free|buy|promo|discount|click)'))) / count(*), 6) AS promo_per_post, round(1 - count(DISTINCT text) / count(*), 6) AS duplicate_ratio FROM documents GROUP BY 1, 2""")
def spam_indicators(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    n = F.count(F.lit(1))

    def per(pattern, text=F.col("text")):
        return F.round(F.sum(F.regexp_count(text, F.lit(pattern))) / n, 6)

    return d.groupBy("source", "lang").agg(
        n.alias("n_posts"), per("#[A-Za-z0-9_]+").alias("hashtags_per_post"), per("@[A-Za-z0-9_]+").alias("mentions_per_post"),
        per("(free|buy|promo|discount|click)", F.lower("text")).alias("promo_per_post"), F.round(1 - F.count_distinct("text") / n, 6).alias("duplicate_ratio"))


@query("fake_follower_score", """WITH f AS (SELECT n_regionkey AS account, c_acctbal < 0 AS no_posts, c_name LIKE '%0' AS odd_name, c_custkey % 3 = 0 AS no_avatar, c_mktsegment = 'BUILDING' AS recent, c_acctbal > 9000 AS mass FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT account, round(avg(no_posts::INT) * 100, 4) AS no_posts_pct, round(avg(odd_name::INT) * 100, 4) AS odd_name_pct, round(avg(no_avatar::INT) * 100, 4) AS no_avatar_pct, round(avg(recent::INT) * 100, 4) AS recent_pct, round(avg(mass::INT) * 100, 4) AS mass_pct,
 round((avg(no_posts::INT) * 0.25 + avg(odd_name::INT) * 0.2 + avg(no_avatar::INT) * 0.2 + avg(recent::INT) * 0.2 + avg(mass::INT) * 0.15), 6) AS score FROM f GROUP BY 1""")
def fake_follower_score(spark, sf_dir):
    c, n = T.table(spark, sf_dir, "customer"), T.table(spark, sf_dir, "nation")
    f = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("n_regionkey").alias("account"), (F.col("c_acctbal") < 0).alias("no_posts"), F.col("c_name").endswith("0").alias("odd_name"), (F.col("c_custkey") % 3 == 0).alias("no_avatar"),
        (F.col("c_mktsegment") == "BUILDING").alias("recent"), (F.col("c_acctbal") > 9000).alias("mass"))
    weights = {"no_posts": 0.25, "odd_name": 0.2, "no_avatar": 0.2, "recent": 0.2, "mass": 0.15}
    share = {k: F.avg(F.col(k).cast("int")) for k in weights}
    return f.groupBy("account").agg(*(F.round(s * 100, 4).alias(f"{k}_pct") for k, s in share.items()), F.round(sum(share[k] * w for k, w in weights.items()), 6).alias("score"))


@query("engagement_profile", """SELECT user_id, count(*) AS n_posts, round(count(*) FILTER (WHERE event_type = 'click') / count(*), 6) AS engagement_ratio, count(DISTINCT hour(ts)) AS activity_hours, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS active_days FROM events GROUP BY 1""")
def engagement_profile(spark, sf_dir):
    return T.posts(spark, sf_dir).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_posts"), F.round(F.count_if(F.col("event_type") == "click") / F.count(F.lit(1)), 6).alias("engagement_ratio"),
        F.count_distinct(F.hour("ts")).alias("activity_hours"), F.datediff(F.max("ts"), F.min("ts")).cast("long").alias("active_days"))


@query("oa_ratio", """SELECT o_orderstatus AS stage, count(*) AS n, round(avg((o_orderpriority = '1-URGENT')::INT), 6) AS oa_ratio FROM orders GROUP BY ROLLUP (o_orderstatus)""")
def oa_ratio(spark, sf_dir):
    return T.table(spark, sf_dir, "orders").rollup(F.col("o_orderstatus").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int")), 6).alias("oa_ratio"))


@query("prisma_flow", """WITH s AS (SELECT doc_id, length(text) >= 200 AS long_enough, lang = 'en' AS in_language, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS first FROM documents)
SELECT count(*) AS identified, count(*) FILTER (WHERE first) AS after_duplicates, count(*) FILTER (WHERE first AND long_enough) AS screened, count(*) FILTER (WHERE first AND long_enough AND in_language) AS included FROM s""")
def prisma_flow(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"), F.length("text").alias("n"))
    first = d.groupBy("h").agg(F.min_by(F.struct("lang", "n"), "doc_id").alias("f"), F.count(F.lit(1)).alias("c"))
    keep = (F.col("f.n") >= 200)
    return first.agg(F.sum("c").alias("identified"), F.count(F.lit(1)).alias("after_duplicates"), F.count_if(keep).alias("screened"), F.count_if(keep & (F.col("f.lang") == "en")).alias("included"))


@query("author_diversity", """SELECT r_name AS topic, round(least(1.0, count(DISTINCT s_nationkey) / count(DISTINCT l_orderkey)), 6) AS diversity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def author_diversity(spark, sf_dir):
    li, s, n, r = (T.table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    j = li.select("l_orderkey", "l_suppkey").join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy(F.col("r_name").alias("topic")).agg(F.round(F.least(F.lit(1.0), F.count_distinct("s_nationkey") / F.count_distinct("l_orderkey")), 6).alias("diversity"))


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("customer", "orders", "lineitem", "events")))
def table_counts(spark, sf_dir):
    from functools import reduce

    parts = [T.table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("customer", "orders", "lineitem", "events")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("rank_videos", """SELECT p_partkey AS video_id, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS rank, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 8) AS mean_score FROM part""")
def rank_videos(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("p_brand")
    return T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("video_id"), "p_brand", F.rank().over(w.orderBy(F.desc("p_retailprice"))).alias("rank"), F.round(F.avg("p_retailprice").over(w), 8).alias("mean_score"))


@query("cube_report", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_report(spark, sf_dir):
    return T.table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
