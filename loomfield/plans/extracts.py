"""Extraction from texts and payloads, and what is left of small scalar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as E
from ..operators import graph as G
from ..sources import payloads as J
from ..sources import tables as T
from . import catalog
from .catalog import query
from .networks import BOTH, MEMBERS, edges, members

CITED = "SELECT o_orderkey AS id, 'As Smith (' || year(o_orderdate) || ') and (Jones, ' || year(o_orderdate) || ') say [' || (o_orderkey % 9) || '], see [' || (o_orderkey % 9) || '].' AS text FROM orders"


def cited(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    y, k = F.year("o_orderdate").cast("string"), (F.col("o_orderkey") % 9).cast("string")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("As Smith ("), y, F.lit(") and (Jones, "), y, F.lit(") say ["), k, F.lit("], see ["), k, F.lit("].")).alias("text"))


@query("citation_extraction", rf"""WITH d AS ({CITED}), c AS (SELECT id, text, 'numbered' AS style, unnest(regexp_extract_all(text, '\[[0-9][0-9, -]*\]')) AS citation FROM d UNION ALL SELECT id, text, 'apa', unnest(regexp_extract_all(text, '\([A-Z][A-Za-z]+(?: et al\.)?, [0-9]{{4}}\)')) FROM d UNION ALL SELECT id, text, 'narrative', unnest(regexp_extract_all(text, '[A-Z][A-Za-z]+(?: et al\.)? \([0-9]{{4}}\)')) FROM d)
SELECT id, style, citation, min(strpos(text, citation))::INT AS first FROM c GROUP BY 1, 2, 3""")
def citation_extraction(spark, sf_dir):
    return E.citations(cited(spark, sf_dir), "id")


@query("citation_style", f"""SELECT id, 'apa' AS style, true AS mixed FROM ({CITED})""")
def citation_style(spark, sf_dir):
    return E.citation_style(E.citations(cited(spark, sf_dir), "id"), "id")


@query("bibliography_entries", """SELECT o_orderkey AS id, e::INT AS entry, e::INT AS number, year(o_orderdate)::INT AS year, CASE WHEN e = 1 THEN '10.1234/x' || o_orderkey END AS doi FROM orders, (SELECT unnest([1, 2]) AS e)""")
def bibliography_entries(spark, sf_dir):
    y = F.year("o_orderdate").cast("string")
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("References\n[1] Smith, A. ("), y, F.lit("). Title one.\n  doi 10.1234/x"), F.col("o_orderkey").cast("string"), F.lit(".\n2. Lee, B. ("), y, F.lit("). Two.")).alias("text"))
    return E.bibliography(o, "id").select("id", "entry", "number", "year", "doi")


@query("funding_mentions", """SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'National Science Foundation (NSF)' WHEN 1 THEN 'German Research Foundation (DFG)' ELSE 'Wellcome Trust' END AS funder, 'AB-' || (1000 + p_partkey) || '.' AS grant_id FROM part""")
def funding_mentions(spark, sf_dir):
    name = F.element_at(F.array(F.lit("the NSF"), F.lit("the Deutsche Forschungsgemeinschaft"), F.lit("Wellcome")), (F.col("p_size") % 3 + 1).cast("int"))
    p = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Funded by "), name, F.lit(" under grant no. AB-"), (1000 + F.col("p_partkey")).cast("string"), F.lit(".")).alias("text"))
    return E.funding(p, "id")


@query("study_numbers", """SELECT p_partkey AS id, 'p_value' AS kind, (p_size % 9 + 1) / 100 AS value FROM part UNION ALL SELECT p_partkey, 'sample_size', p_size FROM part UNION ALL SELECT p_partkey, 'percentage', p_size % 90 FROM part UNION ALL SELECT p_partkey, 'interval_low', p_size FROM part UNION ALL SELECT p_partkey, 'interval_high', p_size + 0.5::DOUBLE FROM part""")
def study_numbers(spark, sf_dir):
    t = F.concat(F.lit("We found p < 0.0"), (F.col("p_size") % 9 + 1).cast("string"), F.lit(" with N = "), F.col("p_size").cast("string"), F.lit(" and "), (F.col("p_size") % 90).cast("string"), F.lit(" % response, CI ["), F.col("p_size").cast("string"), F.lit(", "), F.col("p_size").cast("string"), F.lit(".5]"))
    return E.study_numbers(T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), t.alias("text")), "id")


@query("embedded_json", """SELECT page_id, page_id AS user_id FROM pages""")
def embedded_json(spark, sf_dir):
    html = F.concat(F.when(F.col("page_id") % 2 == 0, '<script id="STATE" type="x">').otherwise('<script id="OLD_STATE">'), F.to_json(F.struct(F.struct(F.col("page_id").alias("id")).alias("user"))), F.lit("</script>"), F.col("html"))
    p = T.table(spark, sf_dir, "pages")
    return p.select("page_id", F.get_json_object(E.embedded_json(html, ["STATE", "OLD_STATE"]), "$.user.id").cast("long").alias("user_id"))


@query("graph_posts", """SELECT 'p' || p_partkey AS shortcode, p_name AS caption, p_size::BIGINT AS likes, CASE WHEN p_partkey % 5 = 0 THEN 'carousel' WHEN p_partkey % 2 = 0 THEN 'video' ELSE 'image' END AS post_type FROM part""")
def graph_posts(spark, sf_dir):
    k = F.col("p_partkey")
    node = F.struct(F.concat(F.lit("p"), k.cast("string")).alias("shortcode"), (k % 2 == 0).alias("is_video"), F.col("p_size").alias("likes"), F.col("p_name").alias("caption"), F.when(k % 5 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("children"))
    p = T.table(spark, sf_dir, "part").select(F.to_json(F.struct(F.array(F.struct(node.alias("node"))).alias("edges"))).alias("body"))
    return E.graph_posts(p)


@query("flat_comments", """SELECT 'c' || p_partkey AS comment_id, p_name AS text, NULL AS parent_id, false AS is_reply FROM part UNION ALL SELECT 'r' || p_partkey, p_brand, 'c' || p_partkey, true FROM part""")
def flat_comments(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    reply = F.struct(F.concat(F.lit("r"), k).alias("id"), F.col("p_brand").alias("text"))
    c = F.struct(F.concat(F.lit("c"), k).alias("id"), F.col("p_name").alias("text"), F.array(reply).alias("replies"))
    return E.flat_comments(T.table(spark, sf_dir, "part").select(F.to_json(F.struct(F.array(c).alias("comments"))).alias("body")))


@query("product_search", """SELECT p_partkey, p_retailprice FROM part WHERE p_name LIKE '%a%' AND p_retailprice BETWEEN 950 AND 1400 ORDER BY p_retailprice, p_partkey LIMIT 30 OFFSET 10""")
def product_search(spark, sf_dir):
    p = T.table(spark, sf_dir, "part").filter(F.col("p_name").contains("a") & F.col("p_retailprice").between(950, 1400))
    return p.select("p_partkey", "p_retailprice").orderBy("p_retailprice", "p_partkey").offset(10).limit(30)


@query("shortcode_ids", """SELECT p_partkey, (1 * 4096 + (p_partkey % 26) * 64 + (p_size % 26))::DECIMAL(38, 0) AS media_id FROM part""")
def shortcode_ids(spark, sf_dir):
    letter = [F.char((65 + F.col(c) % 26).cast("int")) for c in ("p_partkey", "p_size")]
    return T.table(spark, sf_dir, "part").select("p_partkey", J.shortcode_id(F.concat(F.lit("B"), *letter)).alias("media_id"))


@query("number_formats", """WITH n AS (SELECT o_orderkey, o_totalprice * 100 AS n FROM orders) SELECT o_orderkey, CASE WHEN n >= 1e9 THEN printf('%.1fB', n / 1e9) WHEN n >= 1e6 THEN printf('%.1fM', n / 1e6) WHEN n >= 1e3 THEN printf('%.1fK', n / 1e3) ELSE trunc(n)::BIGINT::VARCHAR END AS shown FROM n""")
def number_formats(spark, sf_dir):
    return T.table(spark, sf_dir, "orders").select("o_orderkey", J.short_number(F.col("o_totalprice") * 100).alias("shown"))


@query("redacted_payloads", """SELECT event_id, '[REDACTED]' AS api_token, event_type AS name FROM events""")
def redacted_payloads(spark, sf_dir):
    m = E.redacted(F.create_map(F.lit("api_token"), F.col("user_id").cast("string"), F.lit("name"), F.col("event_type")))
    return T.table(spark, sf_dir, "events").select("event_id", m.alias("m")).select("event_id", F.col("m")["api_token"].alias("api_token"), F.col("m")["name"].alias("name"))


@query("signatures")
def signatures(spark, sf_dir):
    return T.table(spark, sf_dir, "events").select("event_id", E.signature(F.col("props"), "a secret", F.col("event_id")).alias("signature"))


@query("crawl_schedule", """WITH h AS (SELECT user_id, hour(ts) AS h, count(*) AS c FROM events GROUP BY 1, 2), t AS (SELECT user_id, h FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, h) <= 3) SELECT user_id, TIMESTAMP '2024-01-01 00:00:00' + h * INTERVAL 1 HOUR AS at FROM t""")
def crawl_schedule(spark, sf_dir):
    from ..operators.aggregates import top_per_key

    h = T.posts(spark, sf_dir).groupBy("user_id", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("c"))
    hot = top_per_key(h, ["user_id"], [F.desc("c"), F.asc("h")], 3).groupBy("user_id").agg(F.collect_set("h").alias("hot_hours"))
    return E.schedule(hot, "user_id", F.lit("2024-01-01 00:00:00").cast("timestamp"), 24).select("user_id", F.col("at").cast("timestamp_ntz").alias("at"))


@query("checkpoint_ages", """WITH a AS (SELECT event_id, (event_id * 37) % 200000 AS s FROM events) SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age, s > 86400 AS stale FROM a""")
def checkpoint_ages(spark, sf_dir):
    s = (F.col("event_id") * 37) % 200000
    return T.table(spark, sf_dir, "events").select("event_id", E.age_text(s).alias("age"), (s > 86400).alias("stale"))


@query("similar_tags", """WITH b AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) || (p_size % 20) AS t FROM part), l AS (SELECT t, list_distinct(string_split(t, '')) AS s FROM b) SELECT x.t AS a, y.t AS b FROM l x JOIN l y ON left(x.t, 1) = left(y.t, 1) AND x.t < y.t WHERE contains(x.t, y.t) OR contains(y.t, x.t) OR len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) > 0.7""")
def similar_tags(spark, sf_dir):
    t = T.table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w"), "p_size").select(F.concat(F.lower("w"), (F.col("p_size") % 20).cast("string")).alias("t")).distinct()
    left, right = t.select(F.col("t").alias("a"), F.substring("t", 1, 1).alias("k")), t.select(F.col("t").alias("b"), F.substring("t", 1, 1).alias("k"))
    return left.join(right, "k").filter(F.col("a") < F.col("b")).filter(E.tag_similar(F.col("a"), F.col("b"))).select("a", "b")


@query("best_matches", """WITH l AS (SELECT p_partkey, p_brand, list_distinct(string_split(lower(p_name), ' ')) AS s FROM part), m AS (SELECT x.p_partkey AS a, y.p_partkey AS b, round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))), 6) AS s FROM l x JOIN l y USING (p_brand) WHERE x.p_partkey % 2 = 0 AND y.p_partkey % 2 = 1)
SELECT a AS p_partkey, b AS match, s AS score FROM m WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) = 1""")
def best_matches(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    return E.best_match(p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 2 = 1"), "p_brand", "p_partkey", "p_name", 0.3)


@query("self_citations", """SELECT o_orderkey AS id, round(CASE o_orderkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 ELSE 0 END::DOUBLE, 6) AS ratio, CASE o_orderkey % 3 WHEN 0 THEN 30.0 WHEN 1 THEN 5.0 ELSE 0.0 END::DOUBLE AS score FROM orders""")
def self_citations(spark, sf_dir):
    r = F.col("o_orderkey") % 3
    refs = F.array(F.when(r < 2, "Smith, Old work").otherwise("Li, Work"), F.when(r == 0, "A. Smith again").otherwise("Kim, B"), F.lit("Lee, C"), F.lit("Wu, D"))
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.lit("A. B. Smith")).alias("authors"), refs.alias("refs"))
    return E.self_citation(o, "id", "authors", "refs")


@query("community_stability", f"""WITH m AS ({MEMBERS}), s AS (SELECT community, snapshot, list(DISTINCT member) AS s FROM m GROUP BY 1, 2), j AS (SELECT *, lag(s) OVER (PARTITION BY community ORDER BY snapshot) AS p FROM s)
SELECT community, count(*) AS n_snapshots, round(avg(len(list_intersect(s, p)) / len(list_distinct(list_concat(s, p)))) FILTER (WHERE p IS NOT NULL), 8) AS stability, round(len(list_intersect(min_by(s, snapshot), max_by(s, snapshot))) / len(min_by(s, snapshot)), 8) AS loyalty FROM j GROUP BY 1""")
def community_stability(spark, sf_dir):
    return E.community_stability(members(spark, sf_dir))


@query("reviewer_profiles", """WITH a AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS x FROM lineitem), p AS (SELECT x, year(o_orderdate) AS y, floor(o_totalprice / 1000)::BIGINT AS c FROM a JOIN orders ON g = o_orderkey), h AS (SELECT x, count(*) FILTER (WHERE c >= rn) AS h FROM (SELECT x, c, row_number() OVER (PARTITION BY x ORDER BY c DESC) AS rn FROM p) GROUP BY 1)
SELECT x AS author_id, count(*) AS n_papers, count(*) FILTER (WHERE y >= 2000) AS recent, sum(c)::BIGINT AS citations, any_value(h) AS h_index FROM p JOIN h USING (x) GROUP BY 1""")
def reviewer_profiles(spark, sf_dir):
    from ..operators.aggregates import h_index

    a, o = T.authors(spark, sf_dir), T.table(spark, sf_dir, "orders")
    p = a.join(o, a.paper_id == o.o_orderkey).select("author_id", F.year("o_orderdate").alias("y"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("citation_count"))
    s = p.groupBy("author_id").agg(F.count(F.lit(1)).alias("n_papers"), F.count_if(F.col("y") >= 2000).alias("recent"), F.sum("citation_count").alias("citations"))
    return s.join(h_index(p, ["author_id"]), "author_id")


@query("mention_activity", """SELECT user_id, round(least(1.0, 0.4::DOUBLE * least(count(*) / 100, 1) + 0.3::DOUBLE * least(count(DISTINCT event_type) / 5, 1) + 0.3::DOUBLE * least(count(DISTINCT ts::DATE) / 30, 1)), 6) AS activity, round(count(*) * log10(greatest(count(*), 10)), 6) AS weight FROM events GROUP BY 1""")
def mention_activity(spark, sf_dir):
    n, one = F.count(F.lit(1)), F.lit(1.0)
    score = 0.4 * F.least(n / 100, one) + 0.3 * F.least(F.count_distinct("event_type") / 5, one) + 0.3 * F.least(F.count_distinct(F.to_date("ts")) / 30, one)
    return T.table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.least(one, score), 6).alias("activity"), F.round(n * F.log10(F.greatest(n, F.lit(10))), 6).alias("weight"))


@query("value_bins", """SELECT event_type, least(9, floor(value / 10))::INT AS bin, count(*) AS n FROM events GROUP BY 1, 2""")
def value_bins(spark, sf_dir):
    return T.table(spark, sf_dir, "events").groupBy("event_type", F.least(F.lit(9), F.floor(F.col("value") / 10)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("tag_normalisation", """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(['#' || p_brand, lower(p_brand), p_type], lambda x: lower(ltrim(trim(x), '#'))))), ',') AS tags FROM part""")
def tag_normalisation(spark, sf_dir):
    tags = F.transform(F.array(F.concat(F.lit("#"), F.col("p_brand")), F.lower("p_brand"), F.col("p_type")), lambda x: F.lower(F.ltrim(F.trim(x), F.lit("#"))))
    return T.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.sort_array(F.array_distinct(tags)), ",").alias("tags"))


@query("reference_ages", """SELECT l_orderkey AS paper_id, count(*) AS n_refs, round(avg(2001 - year(l_shipdate)), 6) AS mean_age, round(count(*) FILTER (WHERE 2001 - year(l_shipdate) > 4) / count(*), 6) AS old_share FROM lineitem GROUP BY 1""")
def reference_ages(spark, sf_dir):
    age = 2001 - F.year("l_shipdate")
    return T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.count(F.lit(1)).alias("n_refs"), F.round(F.avg(age), 6).alias("mean_age"), F.round(F.count_if(age > 4) / F.count(F.lit(1)), 6).alias("old_share"))


@query("citation_rings", """WITH g AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_suppkey % 12)), '+') AS team, count(DISTINCT l_suppkey % 12) AS k FROM lineitem GROUP BY 1) SELECT team, count(*) AS n FROM g WHERE k >= 2 GROUP BY 1 HAVING count(*) >= 3""")
def citation_rings(spark, sf_dir):
    g = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.col("l_suppkey") % 12)).alias("t")).filter(F.size("t") >= 2)
    return g.groupBy(F.array_join("t", "+").alias("team")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


@query("review_sections", """WITH p AS (SELECT year(o_orderdate)::INT AS year, o_orderkey, floor(o_totalprice / 1000)::BIGINT AS c FROM orders), y AS (SELECT year, count(*) AS n, sum(count(*)) OVER (ORDER BY year) AS upto, sum(count(*)) OVER () AS total FROM p GROUP BY 1), q AS (SELECT year, ((upto - n) * 4 // total + 1)::INT AS period FROM y)
SELECT period, min(year) AS first_year, max(year) AS last_year, count(*) AS n_papers, max_by(o_orderkey, struct_pack(a := c, b := -o_orderkey)) AS most_cited FROM p JOIN q USING (year) GROUP BY 1""")
def review_sections(spark, sf_dir):
    """All papers in up to four periods of whole years, each with its most cited one. The window is over one row a year."""
    from pyspark.sql.window import Window

    p = T.table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("c"))
    y = p.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("c", (-F.col("o_orderkey")).alias("k"))).alias("best"))
    before = F.sum("n").over(Window.orderBy("year")) - F.col("n")
    y = y.withColumn("period", (F.floor(before * 4 / F.sum("n").over(Window.partitionBy())) + 1).cast("int"))
    return y.groupBy("period").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum("n").alias("n_papers"), (-F.max("best")["k"]).alias("most_cited"))


@query("alert_rules", """WITH r AS (SELECT * FROM (VALUES ('any_error', ['error'], 2), ('all_high', ['*'], 3)) AS t(rule, types, level)), s AS (SELECT event_id, event_type, CASE event_type WHEN 'error' THEN CASE WHEN value > 50 THEN 3 ELSE 2 END ELSE 1 END AS level FROM events) SELECT event_id, rule FROM s JOIN r ON s.level >= r.level AND (list_contains(types, '*') OR list_contains(types, event_type))""")
def alert_rules(spark, sf_dir):
    rules = spark.createDataFrame([("any_error", ["error"], 2), ("all_high", ["*"], 3)], "rule string, types array<string>, least int")
    level = F.when(F.col("event_type") == "error", F.when(F.col("value") > 50, 3).otherwise(2)).otherwise(1)
    e = T.table(spark, sf_dir, "events").select("event_id", "event_type", level.alias("level"))
    return e.join(F.broadcast(rules), (F.col("level") >= F.col("least")) & (F.array_contains("types", "*") | F.expr("array_contains(types, event_type)"))).select("event_id", "rule")


@query("priority_levels", f"SELECT x.node, x.depth, x.parent, degree FROM ({catalog._SQL['bfs_levels']}) x JOIN (SELECT src AS node, count(*) AS degree FROM ({BOTH}) GROUP BY 1) d USING (node) ORDER BY depth, degree DESC, node LIMIT 20")
def priority_levels(spark, sf_dir):
    """Best-first within each level: the first 20 found nodes by degree."""
    e = edges(spark, sf_dir)
    found = G.bfs(e, spark.range(1, 2).select(F.col("id").alias("node")), 3)
    return found.join(G.degree(e).select("node", "degree"), "node").orderBy("depth", F.desc("degree"), "node").limit(20)
