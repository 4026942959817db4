"""Lookups, further payload dialects, checks, reports and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import extract as E
from ..operators import geo
from ..operators import nested as N
from ..operators import registers as R
from ..operators import text as X
from ..sources import sinks as K
from ..sources import tables as T
from . import catalog
from .catalog import query
from .distributions import POINTS, dbscan, points
from .records import PAPERS as EXPORTED
from .records import _exported


def _text(c):
    return F.col(c).cast("string")


@query("author_lookup", """SELECT s_suppkey AS author_id, s_name AS name, n_name AS country, count(DISTINCT l_orderkey) AS n_works FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey WHERE contains(lower(s_name), '000000003') GROUP BY 1, 2, 3""")
def author_lookup(spark, sf_dir):
    """Authors whose name holds a text, with their numbers of works."""
    s = T.table(spark, sf_dir, "supplier").filter(F.lower("s_name").contains("000000003")).join(F.broadcast(T.table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    works = T.authors(spark, sf_dir).join(s, F.col("author_id") == F.col("s_suppkey")).groupBy("author_id", F.col("s_name").alias("name"), F.col("n_name").alias("country"))
    return works.agg(F.count(F.lit(1)).alias("n_works"))


@query("journal_lookup", """SELECT c_mktsegment AS journal, substr(md5(c_mktsegment), 1, 4) || '-' || substr(md5(c_mktsegment), 5, 4) AS issn, count(*) AS n_works FROM orders JOIN customer ON o_custkey = c_custkey WHERE substr(md5(c_mktsegment), 1, 4) || '-' || substr(md5(c_mktsegment), 5, 4) = substr(md5('BUILDING'), 1, 4) || '-' || substr(md5('BUILDING'), 5, 4) GROUP BY 1, 2""")
def journal_lookup(spark, sf_dir):
    """A journal by its ISSN, with its number of works."""
    def issn(name):
        return F.concat(F.substring(F.md5(name), 1, 4), F.lit("-"), F.substring(F.md5(name), 5, 4))

    p = T.papers(spark, sf_dir).withColumn("issn", issn(F.col("journal"))).filter(F.col("issn") == issn(F.lit("BUILDING")))
    return p.groupBy("journal", "issn").agg(F.count(F.lit(1)).alias("n_works"))


@query("graph_users", """SELECT p_partkey, 'u' || p_partkey AS user_id, p_brand AS username, '' AS full_name, p_size % 2 = 0 AS is_private, false AS is_verified FROM part""")
def graph_users(spark, sf_dir):
    node = F.struct(F.concat(F.lit("u"), _text("p_partkey")).alias("id"), F.col("p_brand").alias("username"), F.when(F.col("p_size") % 2 == 0, True).alias("is_private"))
    edges = F.struct(F.array(F.struct(node.alias("node")), F.struct(F.lit(None).cast("struct<id:string,username:string,is_private:boolean>").alias("node"))).alias("edges"))
    body = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.struct(edges.alias("edge_follow")))).otherwise(F.to_json(F.struct(edges.alias("edge_followed_by"))))
    return E.graph_users(T.table(spark, sf_dir, "part").select("p_partkey", body.alias("body")), "p_partkey")


@query("page_info", """SELECT p_partkey, p_size % 3 = 0 AS has_next_page, CASE WHEN p_size % 3 = 0 THEN 'c' || p_partkey ELSE '' END AS end_cursor FROM part""")
def page_info(spark, sf_dir):
    info = F.struct(F.struct(F.lit(True).alias("has_next_page"), F.concat(F.lit("c"), _text("p_partkey")).alias("end_cursor")).alias("page_info"))
    body = F.when(F.col("p_size") % 3 == 0, F.to_json(F.struct(info.alias("edge_follow")))).otherwise("{}")
    return E.page_info(T.table(spark, sf_dir, "part").select("p_partkey", body.alias("body")), "p_partkey")


@query("grid_highlights", """SELECT 'highlight:' || p_partkey AS reel_id, CASE WHEN p_size % 4 = 0 THEN 'Untitled' ELSE p_name END AS title, CASE WHEN p_size % 2 = 0 THEN 'crop' ELSE 'thumb' END AS cover_url, p_size::INT AS n_items FROM part""")
def grid_highlights(spark, sf_dir):
    k, z = _text("p_partkey"), F.col("p_size")
    node = F.struct(
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("highlight:"), k)).otherwise(k).alias("id"), F.when(z % 4 > 0, F.col("p_name")).alias("title"), z.alias("media_count"), F.when(z % 2 == 0, F.struct(F.lit("crop").alias("url"))).alias("cover_media_cropped_thumbnail"), F.struct(F.lit("thumb").alias("thumbnail_src")).alias("cover_media"))
    edges = F.struct(F.array(F.struct(node.alias("node"))).alias("edges"))
    user = F.struct(F.struct(F.when(z % 3 == 0, edges).alias("edge_highlight_reels"), F.when(z % 3 > 0, edges).alias("highlight_reels")).alias("user"))
    return E.grid_highlights(T.table(spark, sf_dir, "part").select(F.to_json(F.struct(user.alias("data"))).alias("body")))


@query("plain_comments", """SELECT p_partkey, 'k' || p_partkey AS comment_id, 'hi @' || p_brand || ' and @b.c' AS text, p_brand AS author, '' AS author_id, p_size::BIGINT AS created, 0::BIGINT AS likes, regexp_replace(p_brand, '#.*', '') || ',b.c' AS mentions FROM part""")
def plain_comments(spark, sf_dir):
    item = F.struct(F.concat(F.lit("k"), _text("p_partkey")).alias("pk"), F.concat(F.lit("hi @"), "p_brand", F.lit(" and @b.c")).alias("text"), F.struct(F.col("p_brand").alias("username")).alias("user"), F.col("p_size").alias("created_at"))
    found = E.plain_comments(T.table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.array(item).alias("comments"))).alias("body")), "p_partkey")
    return found.withColumn("mentions", F.array_join("mentions", ","))


@query("many_citations", """SELECT o_orderkey AS id, unnest(['Smith', 'Jones & Lee']) AS author, unnest([year(o_orderdate)::VARCHAR, '2001a']) AS year FROM orders""")
def many_citations(spark, sf_dir):
    text = F.concat(F.lit("As known (Smith, "), F.year("o_orderdate").cast("string"), F.lit("; Jones & Lee, 2001a; Smith, "), F.year("o_orderdate").cast("string"), F.lit("), not (Alone, 1999)."))
    return E.many_citations(T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text")), "id")


@query("video_checks", """WITH v AS (SELECT p_partkey, p_size * 20 / 10 - 3 AS d, p_size * 40 AS w, p_size * 25 AS h, p_size AS f FROM part) SELECT p_partkey, d >= 1 AS valid, CASE WHEN d < 1 THEN 'too short' ELSE '' END AS errors, array_to_string(list_filter([CASE WHEN d > 90 THEN 'very long' END, CASE WHEN w < 320 OR h < 240 THEN 'low resolution' END, CASE WHEN f < 15 THEN 'low frame rate' END], lambda x: x IS NOT NULL), ',') AS warnings, round((least(1.0::DOUBLE, w * h / (1920 * 1080)) + CASE WHEN d BETWEEN 1 AND 60 THEN 1 ELSE 0.7::DOUBLE END) / 2, 6) AS quality FROM v""")
def video_checks(spark, sf_dir):
    z = F.col("p_size")
    c = C.video_check(z * 20 / 10 - 3, z * 40, z * 25, z, longest=90.0)
    rows = T.table(spark, sf_dir, "part").select("p_partkey", c.alias("c"))
    return rows.select("p_partkey", "c.valid", F.array_join("c.errors", ",").alias("errors"), F.array_join("c.warnings", ",").alias("warnings"), F.round("c.quality", 6).alias("quality"))


@query("profile_checks", """SELECT c_custkey, c_custkey % 5 > 0 AND c_acctbal >= 0 AS valid, concat_ws(',', CASE WHEN c_custkey % 5 = 0 THEN 'missing username' END, CASE WHEN c_acctbal < 0 THEN 'invalid follower count' END) AS errors FROM customer""")
def profile_checks(spark, sf_dir):
    c = C.profile_check(F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")), F.col("c_acctbal"), F.col("c_nationkey"))
    return T.table(spark, sf_dir, "customer").select("c_custkey", c.alias("c")).select("c_custkey", "c.valid", F.array_join("c.errors", ",").alias("errors"))


@query("sanitized_payloads", """SELECT event_id, '{"user":{"api_key":"[REDACTED]","name":"' || event_type || '","deep":{"list":[{"Password":"[REDACTED]","v":' || user_id || '},7]}}}' AS body FROM events""")
def sanitized_payloads(spark, sf_dir):
    deep = F.concat(F.lit('{"user": {"api_key": "x'), _text("user_id"), F.lit('", "name": "'), "event_type", F.lit('", "deep": {"list": [{"Password": 1, "v": '), _text("user_id"), F.lit("}, 7]}}}"))
    return T.table(spark, sf_dir, "events").select("event_id", C.sanitized()(deep).alias("body"))


@query("post_places", """SELECT event_id, 'L' || user_id AS location_id, 'Unknown' AS name, (user_id % 7)::DOUBLE AS lat, (event_id % 9)::DOUBLE AS lng FROM events WHERE user_id % 7 <> 0 OR event_id % 9 <> 0""")
def post_places(spark, sf_dir):
    a, b = (F.col("user_id") % 7).cast("double"), (F.col("event_id") % 9).cast("double")
    first = F.to_json(F.struct(F.concat(F.lit("L"), _text("user_id")).alias("id"), a.alias("lat"), b.alias("lng")))
    other = F.to_json(F.struct(F.concat(F.lit("L"), _text("user_id")).alias("id"), a.alias("latitude"), b.alias("longitude")))
    e = T.table(spark, sf_dir, "events")
    return C.places(e.select("event_id", F.when(F.col("event_id") % 2 == 0, first).otherwise(other).alias("location")), "event_id")


@query("paper_identities", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '10.1/' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'W' || o_orderkey ELSE o_orderpriority END AS identity FROM orders""")
def paper_identities(spark, sf_dir):
    m, k = F.col("o_orderkey") % 3, _text("o_orderkey")
    return T.table(spark, sf_dir, "orders").select("o_orderkey", C.paper_identity(F.when(m == 0, F.concat(F.lit("10.1/"), k)).otherwise(""), F.when(m == 1, F.concat(F.lit("W"), k)), F.col("o_orderpriority")).alias("identity"))


def _ladder_sql(value, steps, below):
    return "CASE " + " ".join(f"WHEN {value} >= {t} THEN {v!r}" for t, v in steps) + f" ELSE {below!r} END"


@query("impact_classes", f"""WITH s AS (SELECT p_partkey, (p_size % 21) / 20 AS score FROM part), p AS (SELECT p_partkey, score, {_ladder_sql('score', C.PERCENTILES, 5)} AS percentile FROM s) SELECT p_partkey, percentile, {_ladder_sql('percentile', C.IMPACT_CLASSES, 'below_average')} AS impact_class, {_ladder_sql('percentile', C.CITATIONS, 1)} AS citations FROM p""")
def impact_classes(spark, sf_dir):
    return T.table(spark, sf_dir, "part").select("p_partkey", C.impact_class(F.col("p_size") % 21 / 20).alias("x")).select("p_partkey", "x.*")


@query("markdown_review", f"""WITH p AS (SELECT e.*, o_custkey AS citation_count, o_orderkey % 3 = 0 AS is_open_access FROM ({EXPORTED}) e JOIN orders ON o_orderkey = paper_id), t AS (SELECT count(*) AS n, min(year) AS a, max(year) AS b, sum(citation_count) AS c, count(*) FILTER (WHERE is_open_access) AS oa FROM p)
SELECT unnest(['000', '001', '002', '003', '004']) AS ord, unnest(['# Literature review', '- papers: ' || n, '- years: ' || a || ' to ' || b, '- citations: ' || c, '- open access: ' || oa]) AS line FROM t
UNION ALL SELECT '1' || lpad((1000000000000000 - citation_count)::VARCHAR, 16, '0') || lpad(paper_id::VARCHAR, 20, '0'), '## ' || title || chr(10) || '**' || array_to_string(author_names, ', ') || '** (' || year || ')' || chr(10) || '*' || journal || '*, citations: ' || citation_count || chr(10) || 'DOI: ' || doi || chr(10) || '> ' || abstract FROM p""")
def markdown_review(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_custkey").alias("citation_count"), (F.col("o_orderkey") % 3 == 0).alias("is_open_access"))
    return K.markdown_review(_exported(spark, sf_dir).join(o, "paper_id"))


@query("map_lines", """SELECT l_partkey || chr(9) || l_suppkey || chr(9) || count(*) AS line FROM lineitem GROUP BY l_partkey, l_suppkey""")
def map_lines(spark, sf_dir):
    e = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    return K.map_tsv(e)


@query("network_objects", """SELECT '{"kind":"node","id":' || n_nationkey || '}' AS line FROM nation UNION ALL SELECT '{"kind":"link","source":' || n_regionkey || ',"target":' || n_nationkey || ',"weight":1}' FROM nation""")
def network_objects(spark, sf_dir):
    n = T.table(spark, sf_dir, "nation")
    return K.network_json(n.select(F.col("n_nationkey").alias("node")), n.select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst"), F.lit(1).alias("weight")))


@query("flattened_rows", """SELECT c_custkey AS id, c_name AS owner_name, c_nationkey AS owner_place_nation, c_mktsegment || '; ' || c_nationkey AS tags FROM customer""")
def flattened_rows(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer")
    nested = c.select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("place")).alias("owner"), F.array(F.col("c_mktsegment"), _text("c_nationkey")).alias("tags"))
    return K.flatten(nested)


@query("text_hashes", """SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents""")
def text_hashes(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("recent_anomalies", """WITH z AS (SELECT event_id, event_type AS metric, ts, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS d, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 99 PRECEDING)), s AS (SELECT event_id, metric, value, ts, round(CASE WHEN n >= 10 AND d > 0 THEN (value - m) / d ELSE 0 END, 4) AS z FROM z)
SELECT event_id, metric, value, z FROM s WHERE abs(z) >= 1.5 ORDER BY ts DESC, event_id DESC LIMIT 50""")
def recent_anomalies(spark, sf_dir):
    from ..operators import windows as W

    rows = W.rolling_zscore(T.metrics(spark, sf_dir), ["metric"], ["ts", "event_id"], "value", limit=1.5)
    return rows.filter("anomaly").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "metric", "value", "z")


@query("cluster_centroids", f"""SELECT cluster, count(*) AS size, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng, round(least(1.0, count(*) / 3), 6)::DOUBLE AS confidence FROM ({catalog._SQL['dbscan']}) JOIN ({POINTS}) p USING (id) WHERE cluster IS NOT NULL GROUP BY 1""")
def cluster_centroids(spark, sf_dir):
    """Centres of the clusters of customers' places, with a confidence that grows with their members."""
    p = points(spark, sf_dir)
    return geo.centroids(p, dbscan(spark, sf_dir), p.columns[0])


PROFILES = "w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM documents UNION ALL SELECT 'm' || item_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) FROM benchmark), c AS (SELECT source AS k, token, count(*) AS c FROM w GROUP BY 1, 2), l AS (SELECT k, sum(c) AS len FROM c GROUP BY 1), d AS (SELECT token, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(*) AS n FROM l), t AS MATERIALIZED (SELECT k, token, round(c / len * (ln(n / (1 + df)) + 1), 8) AS weight FROM c JOIN l USING (k) JOIN d USING (token), n)"


@query("expertise_match", f"""WITH {PROFILES}, z AS (SELECT k, sqrt(sum(weight * weight)) AS z FROM t GROUP BY 1), s AS (SELECT a.k AS manuscript, b.k AS candidate, sum(a.weight * b.weight) AS dot FROM t a JOIN t b USING (token) WHERE starts_with(a.k, 'm') AND NOT starts_with(b.k, 'm') GROUP BY 1, 2),
top AS (SELECT k, list(token) AS kw FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY weight DESC, token) <= 10) GROUP BY 1)
SELECT manuscript, candidate, round(0.7::DOUBLE * round(dot / (x.z * y.z), 6) + 0.3::DOUBLE * round(len(list_intersect(p.kw, q.kw)) / len(list_distinct(list_concat(p.kw, q.kw))), 6), 8) AS expertise FROM s JOIN z x ON x.k = manuscript JOIN z y ON y.k = candidate JOIN top p ON p.k = manuscript JOIN top q ON q.k = candidate""")
def expertise_match(spark, sf_dir):
    """Every benchmark text as a manuscript against every source's documents as a candidate's profile: cosine of TF-IDF weights
    and overlap of the ten heaviest words."""
    from ..operators.aggregates import top_per_key

    d = X.tokens(T.table(spark, sf_dir, "documents"), "source", least=4).select(F.col("source").alias("k"), "token")
    m = T.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("m"), _text("item_id")).alias("k"), "text")
    w = X.tfidf(d.unionByName(X.tokens(m, "k", least=4).select("k", "token")), "k").select("k", "token", "weight")
    mine = F.col("k").startswith("m")
    cosine = X.cosine_to(w.filter(~mine), w.filter(mine).select(F.col("k").alias("probe"), "token", "weight"), "k").select(F.col("probe").alias("manuscript"), F.col("k").alias("candidate"), "cosine")
    top = top_per_key(w, ["k"], [F.desc("weight"), F.asc("token")], 10).groupBy("k").agg(F.collect_list("token").alias("kw"))  # ten words a key
    pairs = cosine.join(top.select(F.col("k").alias("manuscript"), F.col("kw").alias("x")), "manuscript").join(top.select(F.col("k").alias("candidate"), F.col("kw").alias("y")), "candidate")
    words = pairs.select("manuscript", "candidate", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))
    return N.expertise(cosine, words, ["manuscript", "candidate"])


@query("profile_pages", """SELECT p_partkey, 'u' || p_partkey AS username, p_size::BIGINT AS followers, 7::BIGINT AS following, 3::BIGINT AS posts, ['shared', 'additional', 'definition', 'fields'][(p_partkey % 4 + 1)::INT] AS source FROM part""")
def profile_pages(spark, sf_dir):
    k, m = _text("p_partkey"), F.col("p_partkey") % 4
    counts = F.concat(F.lit('"edge_followed_by":{"count":'), _text("p_size"), F.lit('},"edge_follow":{"count":7},"edge_owner_to_timeline_media":{"count":3}'))
    user = F.concat(F.lit('{"username":"u'), k, F.lit('",'), counts, F.lit("}"))
    page = (
        F.when(m == 0, F.concat(F.lit('<script>window._sharedData = {"entry_data":{"ProfilePage":[{"graphql":{"user":'), user, F.lit("}}]}};</script>")))
        .when(m == 1, F.concat(F.lit('<script>window.__additionalDataLoaded("/p/", {"graphql":{"user":'), user, F.lit("}});</script>")))
        .when(m == 2, F.concat(F.lit('<script>require("x", {"user":'), user, F.lit("})</script>"))).otherwise(F.concat(F.lit("<script>odd "), counts, F.lit("</script>"))))
    found = E.profile_page(page, F.concat(F.lit("u"), k))
    return T.table(spark, sf_dir, "part").select("p_partkey", found.alias("x")).select("p_partkey", "x.*")


REGISTRY = "SELECT user_id AS model, event_id AS moved, event_id % 9 AS version, CASE event_type WHEN 'purchase' THEN 'promote' WHEN 'signup' THEN 'rollback' ELSE 'register' END AS action FROM events"


@query("model_registry", f"""WITH l AS ({REGISTRY}), g AS (SELECT model, count(DISTINCT version) FILTER (WHERE action = 'register') AS n_versions, max_by(version, moved) FILTER (WHERE action = 'register') AS latest, max_by(version, moved) FILTER (WHERE action <> 'register') AS production FROM l GROUP BY 1) SELECT *, coalesce(latest > production, latest IS NOT NULL) AS needs_update FROM g""")
def model_registry(spark, sf_dir):
    action = F.when(F.col("event_type") == "purchase", "promote").when(F.col("event_type") == "signup", "rollback").otherwise("register")
    return R.model_registry(T.table(spark, sf_dir, "events").select(F.col("user_id").alias("model"), F.col("event_id").alias("moved"), (F.col("event_id") % 9).alias("version"), action.alias("action")))


@query("harvest_marks", """WITH l AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'started' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'page' END AS mark, event_id % 50 AS rows, 'e' || event_id AS error FROM events), s AS (SELECT user_id, max(event_id) FILTER (WHERE mark = 'started') AS f FROM l GROUP BY 1), r AS (SELECT l.* FROM l JOIN s USING (user_id) WHERE f IS NULL OR event_id >= f)
SELECT user_id, max_by(mark, event_id) AS status, max(event_id) AS at, sum(rows)::BIGINT AS n_rows, CASE WHEN max_by(mark, event_id) = 'failed' THEN max_by(error, event_id) END AS error FROM r GROUP BY 1""")
def harvest_marks(spark, sf_dir):
    mark = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("page")
    log = T.table(spark, sf_dir, "events").select("user_id", "event_id", mark.alias("mark"), (F.col("event_id") % 50).alias("rows"), F.concat(F.lit("e"), _text("event_id")).alias("error"))
    return R.harvest_marks(log, "user_id", "event_id")
