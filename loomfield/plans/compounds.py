"""Compound operators: expertise, fusion, registries, tag clusters, depth-first order, captured snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import nested as N
from ..operators import scoring as S
from ..sources import tables as T
from .catalog import query
from .extracts import similar_tags
from .networks import BOTH, DOWN, edges


@query("tag_clusters", """WITH RECURSIVE b AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) || (p_size % 20) AS t FROM part), l AS MATERIALIZED (SELECT t, list_distinct(string_split(t, '')) AS s FROM b), p AS MATERIALIZED (SELECT x.t AS a, y.t AS b FROM l x JOIN l y ON left(x.t, 1) = left(y.t, 1) AND x.t < y.t WHERE contains(x.t, y.t) OR contains(y.t, x.t) OR len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) > 0.7),
e AS MATERIALIZED (SELECT a AS src, b AS dst FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT src AS node, src AS label FROM e UNION SELECT e.dst, r.label FROM r JOIN e ON e.src = r.node WHERE r.label < e.dst) SELECT node, min(label) AS component FROM r GROUP BY 1""")
def tag_clusters(spark, sf_dir):
    return G.components(similar_tags(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query("late_fusion", """SELECT user_id, round(CASE WHEN sum(value / 100) > 0 THEN sum((event_id % 10) / 10 * (value / 100)) / sum(value / 100) ELSE avg((event_id % 10) / 10) END, 6) AS fused, count(*) AS n_modalities FROM events GROUP BY 1""")
def late_fusion(spark, sf_dir):
    return N.late_fusion(T.table(spark, sf_dir, "events").select("user_id", ((F.col("event_id") % 10) / 10).alias("score"), (F.col("value") / 100).alias("confidence")), "user_id")


@query("padded_features", """SELECT vec_id, 96::BIGINT AS size, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings""")
def padded_features(spark, sf_dir):
    v = N.padded(F.col("embedding").cast("array<double>"), 96)
    return T.table(spark, sf_dir, "embeddings").select("vec_id", F.size(v).cast("long").alias("size"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


LOG = "SELECT user_id AS model, event_id AS moved, event_id % 9 AS version, CASE event_type WHEN 'purchase' THEN 'promote' WHEN 'signup' THEN 'rollback' ELSE 'register' END AS action FROM events"


@query("active_versions", f"""WITH m AS (SELECT * FROM ({LOG}) WHERE action <> 'register') SELECT model, version, lead(version) OVER (PARTITION BY model ORDER BY moved DESC) AS previous FROM m QUALIFY row_number() OVER (PARTITION BY model ORDER BY moved DESC) = 1""")
def active_versions(spark, sf_dir):
    action = F.when(F.col("event_type") == "purchase", "promote").when(F.col("event_type") == "signup", "rollback").otherwise("register")
    return N.active_versions(T.table(spark, sf_dir, "events").select(F.col("user_id").alias("model"), F.col("event_id").alias("moved"), (F.col("event_id") % 9).alias("version"), action.alias("action")), order="moved")


@query("depth_first_order", DOWN.replace("f AS (SELECT DISTINCT", "sz AS (SELECT DISTINCT") + """, o AS (SELECT t.*, coalesce(sum(z.reach + 1) OVER (PARTITION BY cascade_id, parent ORDER BY t.node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t JOIN sz z ON z.node = t.node),
q AS (SELECT cascade_id, node, 0::BIGINT AS position FROM o WHERE parent IS NULL UNION ALL SELECT o.cascade_id, o.node, (q.position + 1 + o.before)::BIGINT FROM q JOIN o ON o.cascade_id = q.cascade_id AND o.parent = q.node) SELECT cascade_id, node, position FROM q""")
def depth_first_order(spark, sf_dir):
    return N.preorder(T.tree(spark, sf_dir), 3)


@query("captured_snapshot", f"""WITH RECURSIVE e AS MATERIALIZED ({BOTH}), b AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 1), n AS (SELECT DISTINCT node FROM b) SELECT src, dst FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n) AND src < dst""")
def captured_snapshot(spark, sf_dir):
    e = G.undirected(edges(spark, sf_dir))
    seed = spark.range(1, 2).select(F.col("id").alias("node"))
    n = G.bfs(e, seed, 1).select("node").unionByName(seed)
    inside = e.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return inside.filter("src < dst").select("src", "dst")


@query("bot_networks", """WITH s AS (SELECT c_nationkey AS block, c_custkey, ((c_custkey * 31) % 100) / 100 AS score FROM customer) SELECT block, count(*) AS n_accounts, round(avg(score), 6) AS mean_score FROM s WHERE score > 0.6 GROUP BY 1 HAVING count(*) >= 3""")
def bot_networks(spark, sf_dir):
    s = T.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("block"), (((F.col("c_custkey") * 31) % 100) / 100).alias("score")).filter("score > 0.6")
    return s.groupBy("block").agg(F.count(F.lit(1)).alias("n_accounts"), F.round(F.avg("score"), 6).alias("mean_score")).filter("n_accounts >= 3")


@query("nested_key", """SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events""")
def nested_key(spark, sf_dir):
    body = F.concat(F.lit('{"a": [{"b": {"c": '), F.col("props"), F.lit("}}]}"))
    return T.table(spark, sf_dir, "events").select("event_id", N.find_key("k")(body).cast("long").alias("k"))


@query("highlight_items", """SELECT 'r' || p_partkey AS reel_id, p_name AS title, 2 AS n_items, (CASE WHEN p_size % 2 = 0 THEN 'video' ELSE 'carousel' END) AS first_type FROM part""")
def highlight_items(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    items = F.array(F.struct(F.concat(F.lit("a"), k).alias("id"), F.when(F.col("p_size") % 2 == 0, 2).otherwise(8).alias("media_type")), F.struct(F.concat(F.lit("b"), k).alias("id"), F.lit(1).alias("media_type")))
    reel = F.struct(F.concat(F.lit("r"), k).alias("id"), F.col("p_name").alias("title"), items.alias("items"))
    reels, rows = N.highlights(T.table(spark, sf_dir, "part").select(F.to_json(F.struct(F.array(reel).alias("tray"))).alias("body")))
    first = rows.groupBy("reel_id").agg(F.min_by("media_type", "item_id").alias("first_type"))
    return reels.join(first, "reel_id")


@query("discovered_ids", """WITH d AS (SELECT page_id, 'q' || (page_id % 7) AS name, (page_id * 3)::VARCHAR AS id, TIMESTAMP '2024-01-01' + page_id * INTERVAL 1 HOUR AS seen FROM pages), l AS (SELECT name, max_by(id, seen) AS id, max(seen) AS seen FROM d GROUP BY 1) SELECT name, id FROM l WHERE seen >= TIMESTAMP '2024-01-05'""")
def discovered_ids(spark, sf_dir):
    p = T.table(spark, sf_dir, "pages").select(
        F.concat(F.lit('x="1";queryId:"q'), (F.col("page_id") % 7).cast("string"), F.lit('",docId:"'), (F.col("page_id") * 3).cast("string"), F.lit('"')).alias("js"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("page_id").cast("int"))).alias("seen"))
    return N.discovered_ids(p, 'queryId:"([a-z0-9]+)",docId:"([0-9]+)"', "js", "seen", F.lit("2024-01-12").cast("timestamp"))


@query("synonym_lookup", """WITH s AS (SELECT * FROM (VALUES ('almond', ['nut', 'kernel']), ('red', ['crimson', 'scarlet'])) AS t(word, syn)), w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part) SELECT p_partkey, count(s.word) AS n_expanded, count(*) + coalesce(sum(len(syn)), 0)::BIGINT AS n_terms FROM w LEFT JOIN s USING (word) GROUP BY 1""")
def synonym_lookup(spark, sf_dir):
    syn = spark.createDataFrame([("almond", ["nut", "kernel"]), ("red", ["crimson", "scarlet"])], "word string, syn array<string>").withColumn("hit", F.lit(1))
    w = T.table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return w.join(F.broadcast(syn), "word", "left").groupBy("p_partkey").agg(F.count("hit").alias("n_expanded"), (F.count(F.lit(1)) + F.sum(F.when(F.col("hit").isNotNull(), F.size("syn")).otherwise(0))).alias("n_terms"))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    d = T.table(spark, sf_dir, "labels").join(T.table(spark, sf_dir, "documents"), "doc_id").select(F.col("toxic").cast("double").alias("label"), F.regexp_count(F.lower("text"), F.lit("stupid|worthless|idiot|pathetic|clown")).cast("double").alias("words"), F.col("n_chars").cast("double").alias("n"))
    return S.permutation_importance(d, lambda x: x.withColumn("prediction", (F.col("words") > 0).cast("double")), ["words", "n"], "label")
