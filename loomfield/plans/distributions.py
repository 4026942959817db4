"""Power laws, tails, outliers, entropy, regression and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geo as GEO
from ..operators import stats as S
from ..sources import tables as T
from .catalog import query
from .rollups import PAPERS


@query("powerlaw_fit", f"""WITH t AS (SELECT journal, citation_count::DOUBLE AS v FROM ({PAPERS}) WHERE citation_count >= 50) SELECT journal, count(*) AS n, round(1 + count(*) / sum(ln(v / 50)), 6) AS alpha FROM t GROUP BY 1""")
def powerlaw_fit(spark, sf_dir):
    return S.powerlaw_alpha(T.papers(spark, sf_dir), ["journal"], "citation_count", 50)


@query("powerlaw_ks", f"""WITH t AS (SELECT journal, citation_count::DOUBLE AS v, row_number() OVER (PARTITION BY journal ORDER BY citation_count) AS i, count(*) OVER (PARTITION BY journal) AS n FROM ({PAPERS}) WHERE citation_count >= 50), a AS (SELECT journal, 1 + count(*) / sum(ln(v / 50)) AS alpha FROM t GROUP BY 1),
d AS (SELECT journal, any_value(n) AS n, any_value(alpha) AS alpha, max(abs(i / n - (1 - pow(v / 50, 1 - alpha)))) AS d FROM t JOIN a USING (journal) GROUP BY 1) SELECT journal, n, round(alpha, 6) AS alpha, round(d, 6) AS ks, round(exp(-2 * n * d * d), 6) AS p_value FROM d""")
def powerlaw_ks(spark, sf_dir):
    return S.ks_statistic(T.papers(spark, sf_dir), ["journal"], "citation_count", 50)


@query("powerlaw_xmin", f"""WITH v AS (SELECT journal, citation_count::DOUBLE AS v FROM ({PAPERS}) WHERE citation_count > 0), u AS (SELECT journal, v AS xmin, row_number() OVER (PARTITION BY journal ORDER BY v) AS r, count(*) OVER (PARTITION BY journal) AS k FROM (SELECT DISTINCT journal, v FROM v)),
c AS (SELECT journal, xmin FROM u WHERE r <= greatest(1, k // 2) AND r <= 20), t AS (SELECT journal, xmin, v, row_number() OVER (PARTITION BY journal, xmin ORDER BY v) AS i, count(*) OVER (PARTITION BY journal, xmin) AS n, sum(ln(v / xmin)) OVER (PARTITION BY journal, xmin) AS s FROM v JOIN c USING (journal) WHERE v >= xmin),
d AS (SELECT journal, xmin, any_value(n) AS n, any_value(1 + n / s) AS alpha, round(max(abs(i / n - (1 - pow(v / xmin, 1 - (1 + n / s))))), 6) AS ks FROM t WHERE n >= 5 AND s > 0 GROUP BY 1, 2)
SELECT journal, xmin, n AS n_tail, round(alpha, 6) AS alpha, ks FROM d QUALIFY row_number() OVER (PARTITION BY journal ORDER BY ks, xmin) = 1""")
def powerlaw_xmin(spark, sf_dir):
    return S.xmin_scan(T.papers(spark, sf_dir), ["journal"], "citation_count", candidates=20)


@query("loglog_r2", f"""WITH c AS (SELECT journal, citation_count AS v, count(*) AS c FROM ({PAPERS}) WHERE citation_count >= 1 GROUP BY 1, 2), a AS (SELECT journal, avg(ln(c) + 1.5::DOUBLE * ln(v)) AS b, avg(ln(c)) AS m FROM c GROUP BY 1)
SELECT journal, round(greatest(0, 1 - sum(pow(ln(c) - (b - 1.5::DOUBLE * ln(v)), 2)) / sum(pow(ln(c) - m, 2))), 6) AS r_squared FROM c JOIN a USING (journal) GROUP BY 1""")
def loglog_r2(spark, sf_dir):
    return S.loglog_r2(T.papers(spark, sf_dir), ["journal"], "citation_count", 1.5)


@query("distribution_compare", f"""WITH a AS (SELECT journal, count(*) AS n, sum(ln(v)) AS sl, avg(v) AS m, sum(v) AS s, var_pop(ln(v)) AS vl FROM (SELECT journal, citation_count::DOUBLE AS v FROM ({PAPERS}) WHERE citation_count >= 10) GROUP BY 1), b AS (SELECT *, sl - n * ln(10) AS q FROM a),
c AS (SELECT journal, round(n * ln((n / q) / 10) - (1 + n / q) * q, 4) AS power_law, round(-n * ln(m) - s / m, 4) AS exponential, round(-sl - n / 2 * ln(2 * pi() * vl) - n / 2, 4) AS lognormal FROM b)
SELECT *, CASE WHEN power_law = greatest(power_law, exponential, lognormal) THEN 'power_law' WHEN exponential = greatest(power_law, exponential, lognormal) THEN 'exponential' ELSE 'lognormal' END AS best FROM c""")
def distribution_compare(spark, sf_dir):
    return S.compare_distributions(T.papers(spark, sf_dir), ["journal"], "citation_count", 10)


@query("hill_estimator", f"""WITH r AS (SELECT journal, citation_count::DOUBLE AS v, row_number() OVER (PARTITION BY journal ORDER BY citation_count DESC) AS i, floor(sqrt(count(*) OVER (PARTITION BY journal)))::BIGINT AS k FROM ({PAPERS}) WHERE citation_count > 0), x AS (SELECT journal, v AS x FROM r WHERE i = k + 1)
SELECT journal, any_value(k) AS k, round(any_value(k) / (sum(ln(v)) - any_value(k) * ln(any_value(x))), 6) AS hill FROM r JOIN x USING (journal) WHERE i <= k GROUP BY 1""")
def hill_estimator(spark, sf_dir):
    return S.hill(T.papers(spark, sf_dir), ["journal"], "citation_count")


@query("tail_metrics", """WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), u AS (SELECT event_type, v AS u FROM r WHERE i = floor(0.9 * n) + 1), e AS (SELECT event_type, avg(v - u) AS e FROM r JOIN u USING (event_type) WHERE v > u GROUP BY 1),
k AS (SELECT event_type, round(kurtosis_pop(v), 4) AS kurtosis FROM r GROUP BY 1) SELECT event_type, kurtosis, round(coalesce(e, 0), 4) AS mean_excess, CASE WHEN kurtosis > 3 THEN 'heavy' WHEN kurtosis > 0 THEN 'moderate' ELSE 'light' END AS tail FROM k LEFT JOIN e USING (event_type)""")
def tail_metrics(spark, sf_dir):
    return S.tail_metrics(T.posts(spark, sf_dir), ["event_type"], "value")


@query("outliers", """WITH m AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS sd, count(*) AS n FROM documents), p AS (SELECT doc_id, n_chars, cume_dist() OVER (ORDER BY n_chars) AS p FROM documents) SELECT doc_id, n_chars, round((n_chars - m) / sd, 4) AS z, round(p * 100, 4) AS percentile FROM p, m WHERE abs(n_chars - m) > 3 * sd""")
def outliers(spark, sf_dir):
    return S.outliers(T.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars")


@query("scaling_breaks", """WITH r AS (SELECT user_id % 5 AS g, value AS v FROM events WHERE value > 0), s AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, coalesce(sum(ln(v)) OVER (PARTITION BY g ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l, sum(ln(v)) OVER (PARTITION BY g) AS a, min(v) OVER (PARTITION BY g) AS lo FROM r),
d AS (SELECT g, i, v, abs(CASE WHEN l - i * ln(lo) > 1e-12 THEN 1 + i / (l - i * ln(lo)) ELSE 0 END - CASE WHEN a - l - (n - i) * ln(v) > 1e-12 THEN 1 + (n - i) / (a - l - (n - i) * ln(v)) ELSE 0 END) AS gap FROM s WHERE i >= 20 AND i < n - 20), m AS (SELECT g, avg(gap) + 2 * stddev_pop(gap) AS m FROM d GROUP BY 1)
SELECT g, i AS split, v AS value, round(gap, 4) AS alpha_gap FROM d JOIN m USING (g) WHERE gap > m""")
def scaling_breaks(spark, sf_dir):
    return S.scaling_breaks(T.posts(spark, sf_dir).select((F.col("user_id") % 5).alias("g"), "value"), ["g"], "value")


@query("posting_entropy", """WITH c AS (SELECT user_id, hour(ts) AS h, count(*) AS c FROM events GROUP BY 1, 2), n AS (SELECT user_id, sum(c) AS n FROM c GROUP BY 1) SELECT user_id, round(-sum(c / n * log2(c / n)), 6) AS entropy FROM c JOIN n USING (user_id) GROUP BY 1""")
def posting_entropy(spark, sf_dir):
    return S.entropy(T.posts(spark, sf_dir).select("user_id", F.hour("ts").alias("h")), ["user_id"], "h")


@query("citation_regression", f"""SELECT journal, round(coalesce(regr_slope(citation_count, year), 0), 6) AS slope, round(coalesce(regr_intercept(citation_count, year), avg(citation_count)), 6) AS intercept FROM ({PAPERS}) GROUP BY 1""")
def citation_regression(spark, sf_dir):
    return S.regression(T.papers(spark, sf_dir), ["journal"], "citation_count", "year")


HAV = "2 * 6371.0::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"
CITY_SQL = "(VALUES " + ", ".join(f"({i}, '{n}', {y}::DOUBLE, {x}::DOUBLE)" for i, (n, y, x) in enumerate(GEO.CITIES)) + ") AS c(i, name, cy, cx)"
POINTS = f"SELECT c_custkey AS id, round(cy + ((c_custkey * 7919) % 2001 - 1000) / 1000.0::DOUBLE, 6) AS lat, round(cx + ((c_custkey * 104729) % 2001 - 1000) / 1000.0::DOUBLE, 6) AS lng FROM customer JOIN {CITY_SQL} ON i = c_nationkey"


def points(spark, sf_dir):
    """Customers around the city that has their nation's number."""
    c = T.table(spark, sf_dir, "customer")
    ys, xs = (F.element_at(F.array(*(F.lit(v) for v in vs)), (F.col("c_nationkey") + 1).cast("int")) for vs in ([c[1] for c in GEO.CITIES], [c[2] for c in GEO.CITIES]))
    return c.select(
        F.col("c_custkey").alias("id"), F.round(ys + ((F.col("c_custkey") * 7919) % 2001 - 1000) / 1000.0, 6).alias("lat"), F.round(xs + ((F.col("c_custkey") * 104729) % 2001 - 1000) / 1000.0, 6).alias("lng"))


@query("nearest_city", f"""WITH p AS ({POINTS}), d AS (SELECT id, lat, lng, name, round({HAV.format(y1='lat', x1='lng', y2='cy', x2='cx')}, 6) AS d FROM p, {CITY_SQL}), b AS (SELECT id, lat, lng, name, d FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, name) = 1)
SELECT id, lat, lng, CASE WHEN d <= 100 THEN name END AS city, CASE WHEN d <= 100 THEN d END AS distance_km FROM b""")
def nearest_city(spark, sf_dir):
    return GEO.nearest_city(points(spark, sf_dir))


PAIRS = f"SELECT a.id AS a, b.id AS b, {HAV.format(y1='a.lat', x1='a.lng', y2='b.lat', x2='b.lng')} AS km FROM p a JOIN p b ON a.id < b.id"


@query("eps_join", f"""WITH p AS ({POINTS}) SELECT a, b, round(km, 6) AS km FROM ({PAIRS}) WHERE km <= 20""")
def eps_join(spark, sf_dir):
    return GEO.pairs_within(points(spark, sf_dir), "id", 20)


@query("dbscan", f"""WITH RECURSIVE p AS MATERIALIZED ({POINTS}), n AS MATERIALIZED (SELECT a, b FROM ({PAIRS}) WHERE km <= 15), s AS MATERIALIZED (SELECT a, b FROM n UNION ALL SELECT b, a FROM n), core AS MATERIALIZED (SELECT a AS id FROM s GROUP BY 1 HAVING count(*) + 1 >= 3),
r AS (SELECT id AS node, id AS label FROM core UNION SELECT s.b, r.label FROM r JOIN s ON s.a = r.node JOIN core ON core.id = s.b WHERE r.label < s.b), c AS (SELECT node, min(label) AS cluster FROM r GROUP BY 1), bd AS (SELECT s.a AS id, min(cluster) AS border FROM s JOIN c ON c.node = s.b GROUP BY 1)
SELECT p.id, coalesce(c.cluster, bd.border) AS cluster, c.cluster IS NOT NULL AS core FROM p LEFT JOIN c ON c.node = p.id LEFT JOIN bd ON bd.id = p.id""")
def dbscan(spark, sf_dir):
    return GEO.dbscan(points(spark, sf_dir), "id", 15, 3)


@query("modal_city", f"""WITH p AS ({POINTS}), d AS (SELECT id, name, {HAV.format(y1='lat', x1='lng', y2='cy', x2='cx')} AS d FROM p, {CITY_SQL}), b AS (SELECT id % 50 AS user_id, name FROM d WHERE d <= 100 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, name) = 1), c AS (SELECT user_id, name, count(*) AS c FROM b GROUP BY 1, 2)
SELECT user_id, name AS city, c AS n_posts, round(c / sum(c) OVER (PARTITION BY user_id), 6) AS confidence FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, name) = 1""")
def modal_city(spark, sf_dir):
    from pyspark.sql.window import Window

    c = GEO.nearest_city(points(spark, sf_dir)).filter("city IS NOT NULL").groupBy((F.col("id") % 50).alias("user_id"), "city").agg(F.count(F.lit(1)).alias("n_posts"))
    w = Window.partitionBy("user_id")
    return c.withColumn("confidence", F.round(F.col("n_posts") / F.sum("n_posts").over(w), 6)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n_posts"), "city"))).filter("r = 1").drop("r")
