"""Payload dialects, research gaps, lifecycles, registers, explanations, fused modalities, workflows and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explain as X
from ..operators import graph as G
from ..operators import nested as N
from ..operators import registers as R
from ..operators import text as X2
from ..operators import workflow as W
from ..sources import payloads as J
from ..sources import sinks as K
from ..sources import tables as T
from . import catalog, records, relations, texts  # noqa: F401  their SQL is used below
from .catalog import query
from .networks import FOLLOWS, MEMBERS, members


def _text(c):
    return F.col(c).cast("string")


@query("citation_contexts", """WITH p AS (SELECT p_partkey AS paper_id, 'c' || p_partkey AS citing_id, p_name AS title, p_size % 3 AS m, p_size, p_brand FROM part WHERE p_partkey % 13 <> 0), t AS (SELECT *, CASE m WHEN 0 THEN [p_brand] WHEN 1 THEN [p_brand, 'see ' || p_size] ELSE [NULL] END AS texts, CASE m WHEN 0 THEN ['Result'] WHEN 1 THEN ['motivation', 'methodology', 'background'] ELSE [] END AS labels FROM p)
SELECT paper_id, citing_id, title, unnest(texts) AS context, array_to_string(labels, ',') AS intents, CASE m WHEN 0 THEN 'support' WHEN 1 THEN 'background,methodology' ELSE '' END AS families, p_size % 2 = 0 AS is_influential FROM t""")
def citation_contexts(spark, sf_dir):
    k, m = F.col("p_partkey"), F.col("p_size") % 3
    none = F.lit(None).cast("array<string>")
    item = F.struct(
        F.struct(F.concat(F.lit("c"), _text("p_partkey")).alias("paperId"), F.when(k % 13 == 0, "").otherwise(F.col("p_name")).alias("title")).alias("citingPaper"),
        F.when(m == 0, F.array("p_brand")).when(m == 1, F.array(F.col("p_brand"), F.concat(F.lit("see "), _text("p_size")))).otherwise(none).alias("contexts"),
        F.when(m == 0, F.array(F.lit("Result"))).when(m == 1, F.array(F.lit("motivation"), F.lit("methodology"), F.lit("background"))).otherwise(none).alias("intents"), F.when(F.col("p_size") % 2 == 0, True).alias("isInfluential"))
    found = J.citation_contexts(T.table(spark, sf_dir, "part").select(k.alias("paper_id"), F.to_json(F.struct(F.array(item).alias("data"))).alias("body")), "paper_id")
    return found.withColumns({"intents": F.array_join("intents", ","), "families": F.array_join("families", ",")})


@query("payload_graph_works", """SELECT 'G' || o_orderkey AS paper_id, CASE WHEN o_orderkey % 2 = 0 THEN '10.2/' || o_orderkey ELSE '' END AS doi, o_orderpriority AS title, year(o_orderdate)::INT AS year, '' AS abstract, 'Ann' AS author_names, 'J' || o_orderkey % 7 AS journal, '3' AS volume, o_custkey AS citation_count, 0::BIGINT AS reference_count, 'Physics' AS fields, o_orderkey % 3 = 0 AS is_open_access FROM orders""")
def payload_graph_works(spark, sf_dir):
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(
        F.concat(F.lit("G"), _text("o_orderkey")).alias("paperId"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year"), F.array(F.struct(F.lit("Ann").alias("name")), F.struct(F.lit("").alias("name"))).alias("authors"), F.when(k % 2 == 0, F.struct(F.concat(F.lit("10.2/"), _text("o_orderkey")).alias("DOI"))).alias("externalIds"),
        F.struct(F.concat(F.lit("J"), (k % 7).cast("string")).alias("name"), F.lit("3").alias("volume")).alias("journal"), F.col("o_custkey").alias("citationCount"), F.array(F.struct(F.lit("Physics").alias("category"))).alias("s2FieldsOfStudy"), F.when(k % 3 == 0, True).alias("isOpenAccess")))
    w = J.graph_works(T.table(spark, sf_dir, "orders").select(body.alias("body")))
    return w.withColumns({"author_names": F.array_join("author_names", ","), "fields": F.array_join("fields", ",")}).drop("pages", "influential_count", "pdf_url")


@query("payload_registry_works", """SELECT '10.3/' || o_orderkey AS doi, o_orderpriority AS title, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE year(o_orderdate)::INT END AS year, 'text & more' AS abstract, 'Ann Lee,Bo' AS author_names, 'J' || o_orderkey % 7 AS journal, CASE WHEN o_orderkey % 2 = 0 THEN '1234-5678' ELSE '' END AS issn, o_custkey AS citation_count, 'https://doi.org/10.3/' || o_orderkey AS url, o_orderkey % 3 = 0 AS is_open_access FROM orders""")
def payload_registry_works(spark, sf_dir):
    k = F.col("o_orderkey")
    author = "struct<given:string,family:string>"
    body = F.to_json(F.struct(
        F.array("o_orderpriority").alias("title"), F.array(F.struct(F.lit("Ann").alias("given"), F.lit("Lee").alias("family")).cast(author), F.struct(F.lit("Bo").alias("given"), F.lit(None).cast("string").alias("family")).cast(author), F.struct(F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("family")).cast(author)).alias("author"),
        F.concat(F.lit("10.3/"), _text("o_orderkey")).alias("DOI"), F.when(k % 5 > 0, F.struct(F.array(F.array(F.year("o_orderdate"), F.lit(1))).alias("date-parts"))).alias("issued"), F.array(F.concat(F.lit("J"), (k % 7).cast("string"))).alias("container-title"), F.when(k % 2 == 0, F.array(F.lit("1234-5678"))).alias("ISSN"),
        F.lit("<jats:p>text & more</jats:p>").alias("abstract"), F.col("o_custkey").alias("is-referenced-by-count"), F.when(k % 3 == 0, F.array(F.struct(F.lit("x").alias("URL")))).alias("license")))
    w = J.registry_works(T.table(spark, sf_dir, "orders").select(body.alias("body")))
    return w.select("doi", "title", "year", "abstract", F.array_join("author_names", ",").alias("author_names"), "journal", "issn", "citation_count", "url", "is_open_access")


@query("oa_records", """SELECT p_partkey AS paper_id, p_size % 4 > 0 AS is_oa, CASE p_size % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'gold' ELSE 'green' END AS status, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'pdf' || p_partkey ELSE 'page' || p_partkey END AS oa_url, CASE WHEN p_size % 4 = 1 THEN 'cc-by' ELSE '' END AS license, CASE WHEN p_size % 4 > 0 THEN 'repository' ELSE '' END AS host_type, p_brand AS journal FROM part""")
def oa_records(spark, sf_dir):
    m, k = F.col("p_size") % 4, _text("p_partkey")
    best = F.struct(F.when(m == 1, F.concat(F.lit("pdf"), k)).otherwise("").alias("url_for_pdf"), F.concat(F.lit("page"), k).alias("url"), F.when(m == 1, "cc-by").alias("license"), F.lit("repository").alias("host_type"))
    body = F.to_json(F.struct(F.when(m > 0, True).alias("is_oa"), F.when(m == 1, "gold").when(m > 1, "green").alias("oa_status"), F.when(m > 0, best).alias("best_oa_location"), F.col("p_brand").alias("journal_name")))
    return J.oa_records(T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("paper_id"), body.alias("body")), "paper_id")


GAP_PAPERS = """SELECT p_partkey AS paper_id, (2000 + CASE WHEN p_size > 25 THEN p_size - 20 ELSE p_size % 3 END)::INT AS year, p_size * 3 AS citation_count, list_distinct(string_split(p_name, ' ')) AS keywords, p_brand || p_type AS label FROM part"""


@query("research_gap_report", f"""WITH p AS MATERIALIZED ({GAP_PAPERS}), y AS (SELECT year, lead(year) OVER (ORDER BY year) AS n FROM (SELECT DISTINCT year FROM p)), k AS (SELECT paper_id, year, citation_count, unnest(keywords) AS k FROM p), r AS (SELECT DISTINCT k FROM k WHERE year >= 2025)
SELECT 'publication_gap' AS rule, (year + 1)::VARCHAR AS subject, (n - 1)::VARCHAR AS detail FROM y WHERE n - year > 2 UNION ALL SELECT 'small_cluster', label, count(*)::VARCHAR FROM p GROUP BY 2 HAVING count(*) <= 2
UNION ALL SELECT 'no_follow_up', paper_id::VARCHAR, citation_count::VARCHAR FROM p WHERE citation_count > 50 AND year < 2022 AND NOT EXISTS (SELECT 1 FROM k JOIN r USING (k) WHERE k.paper_id = p.paper_id)
UNION ALL SELECT 'few_methods', '', n::VARCHAR FROM (SELECT count(DISTINCT lower(k)) AS n FROM k WHERE regexp_matches(lower(k), 'method|algorithm|framework|model|approach|technique|architecture')) WHERE n < 3 AND (SELECT count(*) FROM p) > 10""")
def research_gap_report(spark, sf_dir):
    z = F.col("p_size")
    p = T.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("paper_id"), (2000 + F.when(z > 25, z - 20).otherwise(z % 3)).cast("int").alias("year"), (z * 3).alias("citation_count"), F.array_distinct(F.split("p_name", " ")).alias("keywords"), F.concat("p_brand", "p_type").alias("label"))
    return X2.gap_report(p, p.select("label", "paper_id"), 2022, 2025)


@query("suspicion_report", r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\[[0-9, -]+\]|\([A-Z][a-z]+, [0-9]{4}\)')) AS inline, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents), s AS (SELECT doc_id, lower(trim(replace(x, chr(10), ' '))) AS s FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+')) AS x FROM documents)),
d AS (SELECT doc_id, count(*) - count(DISTINCT s) AS dup FROM s WHERE length(s) > 30 GROUP BY 1), p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents), v AS (SELECT doc_id, len(list_distinct(list_filter(string_split(lower(p), ' '), lambda x: x <> ''))) AS v FROM p WHERE length(trim(p)) > 50), u AS (SELECT doc_id, stddev_pop(v) > avg(v) * 0.6 AS uneven FROM v GROUP BY 1 HAVING count(*) >= 3),
o AS (SELECT doc_id, max(jaccard) AS j FROM (PROBES) GROUP BY 1), t AS (SELECT c.doc_id, CASE WHEN n > 2000 AND inline < 5 THEN 30 ELSE 0 END::DOUBLE AS citation_pattern, (CASE WHEN coalesce(uneven, false) THEN 15 ELSE 0 END + CASE WHEN coalesce(dup, 0) > 2 THEN 20 ELSE 0 END)::DOUBLE AS text_analysis,
 CASE WHEN c.doc_id % 100 >= 50 THEN 30 WHEN c.doc_id % 100 >= 30 THEN 15 WHEN c.doc_id % 100 >= 15 THEN 5 ELSE 0 END::DOUBLE AS self_citation, round(coalesce(j, 0) * 50, 6) AS text_comparison FROM c LEFT JOIN d USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN o USING (doc_id)),
r AS (SELECT *, least(100.0::DOUBLE, citation_pattern * 0.3::DOUBLE + text_analysis * 0.3::DOUBLE + self_citation * 0.25::DOUBLE + text_comparison * 0.15::DOUBLE) AS score FROM t) SELECT * REPLACE (round(score, 4) AS score), CASE WHEN score >= 50 THEN 'critical' WHEN score >= 30 THEN 'high' WHEN score >= 15 THEN 'medium' ELSE 'low' END AS risk FROM r""".replace("PROBES", catalog._SQL["probe_overlap"]))
def suspicion_report(spark, sf_dir):
    """All four parts; texts are compared with the benchmark's, and the share of self-citations is made up from ids, as documents have no references."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    density = catalog.queries()["citation_density"](spark, sf_dir).select("doc_id", "density_score")
    near = catalog.queries()["probe_overlap"](spark, sf_dir).groupBy("doc_id").agg(F.max("jaccard").alias("j"))
    rows = density.join(X2.duplicate_sentences(d, "doc_id").select("doc_id", "duplicates"), "doc_id", "left").join(X2.vocabulary_variance(d, "doc_id").select("doc_id", "uneven"), "doc_id", "left").join(near, "doc_id", "left")
    text = F.when(F.coalesce("uneven", F.lit(False)), 15.0).otherwise(0.0) + F.when(F.coalesce("duplicates", F.lit(0)) > 2, 20.0).otherwise(0.0)
    parts = {"citation_pattern": F.col("density_score"), "text_analysis": text, "self_citation": X2.self_citation_score(F.col("doc_id") % 100 / 100), "text_comparison": F.round(F.coalesce("j", F.lit(0.0)) * 50, 6)}
    rows = rows.select("doc_id", *(c.alias(k) for k, c in parts.items())).withColumn("score", X2.suspicion({k: F.col(k) for k in parts}))
    return rows.withColumn("risk", X2.risk_level(F.col("score"))).withColumn("score", F.round("score", 4))


@query("reference_relevance", """SELECT l_orderkey AS paper_id, count(*) AS n_references, count(*) FILTER (WHERE contains(lower(l_returnflag || l_linestatus), 'ro') OR contains(lower(l_returnflag || l_linestatus), 'rf')) AS n_relevant, CASE WHEN count(*) >= 3 AND count(*) FILTER (WHERE contains(lower(l_returnflag || l_linestatus), 'ro') OR contains(lower(l_returnflag || l_linestatus), 'rf')) / count(*) < 0.1 THEN 25.0 ELSE 0.0 END::DOUBLE AS score FROM lineitem GROUP BY 1""")
def reference_relevance(spark, sf_dir):
    return X2.reference_relevance(T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.concat("l_returnflag", "l_linestatus").alias("reference")), "paper_id", "reference", ["RO", "rf"], least=3)


@query("star_sentiment", """SELECT p_partkey, (p_size % 5 + 1 - 3) / 2 AS score, CASE WHEN p_size % 5 + 1 > 3 THEN 'positive' WHEN p_size % 5 + 1 < 3 THEN 'negative' ELSE 'neutral' END AS label FROM part""")
def star_sentiment(spark, sf_dir):
    return T.table(spark, sf_dir, "part").select("p_partkey", X2.star_sentiment(F.col("p_size") % 5 + 1).alias("x")).select("p_partkey", "x.*")


@query("cascade_timing", """WITH e AS (SELECT event_type AS cascade_id, epoch_us(ts) / 3.6e9::DOUBLE AS h FROM events), x AS (SELECT cascade_id, min(h) AS a, max(h) AS b, count(*) AS n FROM e GROUP BY 1), c AS (SELECT cascade_id, floor(h - a)::BIGINT AS hour, count(*) AS c FROM e JOIN x USING (cascade_id) GROUP BY 1, 2), p AS (SELECT cascade_id, hour FROM c QUALIFY row_number() OVER (PARTITION BY cascade_id ORDER BY c DESC, hour) = 1)
SELECT cascade_id, n AS n_events, round(b - a, 6) AS duration_hours, round(CASE WHEN n < 2 THEN 0 WHEN b = a THEN n ELSE n / (b - a) END, 6) AS speed, CASE WHEN n > 2 THEN hour ELSE 0 END AS peak_hour FROM x JOIN p USING (cascade_id)""")
def cascade_timing(spark, sf_dir):
    return G.cascade_timing(T.table(spark, sf_dir, "events").select(F.col("event_type").alias("cascade_id"), "ts"))


@query("cascade_export", """WITH t AS (SELECT r_regionkey AS cascade_id, 'r' || r_regionkey AS node, NULL AS parent, 0 AS depth FROM region UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation UNION ALL SELECT n_regionkey, 'c' || c_custkey, 'n' || n_nationkey, 2 FROM nation JOIN customer ON n_nationkey = c_nationkey UNION ALL SELECT n_regionkey, 'o' || o_orderkey, 'c' || c_custkey, 3 FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey)
SELECT cascade_id, '{"cascade_id":' || cascade_id || ',"node":"' || node || '","parent":' || coalesce('"' || parent || '"', 'null') || ',"depth":' || depth || '}' AS line FROM t""")
def cascade_export(spark, sf_dir):
    return G.cascade_lines(T.tree(spark, sf_dir))


@query("community_lifecycle", f"""WITH m AS ({MEMBERS}), z AS (SELECT community, snapshot, count(*) AS size FROM m GROUP BY 1, 2), l AS (SELECT community, min(snapshot) AS born, max(snapshot) AS last, count(*) AS n, avg(size) AS s, min_by(size, snapshot) AS f FROM z GROUP BY 1),
e AS (SELECT community, count(*) AS stayed FROM (SELECT community, member FROM m JOIN l USING (community) WHERE snapshot = born OR snapshot = last GROUP BY 1, 2 HAVING count(DISTINCT snapshot) = 2) GROUP BY 1)
SELECT community, born, last, n AS n_snapshots, round(s, 6) AS mean_size, last = (SELECT max(snapshot) FROM m) AS is_alive, round(CASE WHEN n > 1 THEN coalesce(stayed, 0) / f ELSE 0 END, 6) AS loyalty FROM l LEFT JOIN e USING (community)""")
def community_lifecycle(spark, sf_dir):
    return G.community_lifecycle(members(spark, sf_dir))


@query("modularity_trajectory", f"""WITH f AS ({FOLLOWS}), b AS (SELECT src, dst, snapshot FROM f UNION SELECT dst, src, snapshot FROM f), p AS (SELECT snapshot, src % 10 AS label, count(*) AS k, count(*) FILTER (WHERE src % 10 = dst % 10) AS i FROM b GROUP BY 1, 2), m AS (SELECT snapshot, sum(k) AS m FROM p GROUP BY 1) SELECT snapshot, round(sum(i / m - k * k / (m * m)), 4) AS modularity FROM p JOIN m USING (snapshot) GROUP BY 1""")
def modularity_trajectory(spark, sf_dir):
    f = T.follows(spark, sf_dir)
    nodes = f.select(F.col("src").alias("node")).unionByName(f.select(F.col("dst").alias("node"))).distinct()
    return G.modularity_trajectory(f, nodes.withColumn("label", F.col("node") % 10))


@query("weighted_mentions", """SELECT user_id, event_type AS target, round(count(*) * log10(greatest(count(*), 10)) * CASE WHEN user_id % 4 = 0 THEN 1.5::DOUBLE ELSE 1 END, 6) AS weight FROM events GROUP BY 1, 2""")
def weighted_mentions(spark, sf_dir):
    m = T.table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return m.select("user_id", "target", F.round(G.mention_weight(F.col("n"), F.col("user_id") % 4 == 0), 6).alias("weight"))


ACTIONS = {"purchase": "add", "view": "rename", "click": "activate", "signup": "deactivate", "error": "remove"}
LOG = "SELECT user_id AS item_id, event_id AS moved, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items()) + " END AS action, 'item ' || event_id AS name, ts, value AS price FROM events"


def _log(spark, sf_dir):
    action = F.element_at(F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv)), F.col("event_type"))
    return T.table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("moved"), action.alias("action"), F.concat(F.lit("item "), _text("event_id")).alias("name"), "ts", F.col("value").alias("price"))


@query("watch_list", f"""WITH l AS ({LOG}), e AS (SELECT item_id, max(moved) FILTER (WHERE action = 'add') AS added, max(moved) FILTER (WHERE action = 'remove') AS removed FROM l GROUP BY 1), k AS (SELECT * FROM e WHERE added IS NOT NULL AND (removed IS NULL OR added > removed)), s AS (SELECT l.* FROM l JOIN k USING (item_id) WHERE moved >= added)
SELECT item_id, max_by(name, moved) FILTER (WHERE action IN ('add', 'rename')) AS name, max_by(action <> 'deactivate', moved) FILTER (WHERE action IN ('add', 'activate', 'deactivate')) AS is_active, any_value(added) AS added, any_value(removed) AS removed FROM s JOIN k USING (item_id) GROUP BY 1""")
def watch_list(spark, sf_dir):
    return R.watch_list(_log(spark, sf_dir), order="moved")


KEPT = f"l AS ({LOG}), g AS (SELECT item_id, max(moved) AS gone FROM l WHERE action = 'remove' GROUP BY 1), h AS (SELECT item_id, ts, moved AS event_id, price FROM l LEFT JOIN g USING (item_id) WHERE action = 'add' AND (gone IS NULL OR moved > gone))"


def _kept(spark, sf_dir):
    log = _log(spark, sf_dir)
    return R.kept_history(log.filter("action = 'add'").select("item_id", "ts", "moved", "price"), log, order="moved").withColumnRenamed("moved", "event_id")


@query("watch_history", f"""WITH {KEPT}, r AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) <= 100), w AS (SELECT *, lag(price) OVER o AS b, first_value(price) OVER o AS f, row_number() OVER o AS snapshot FROM r WINDOW o AS (PARTITION BY item_id ORDER BY ts, event_id))
SELECT item_id, event_id, price, snapshot::INT AS snapshot, round(price - b, 4) AS delta, round(CASE WHEN b > 0 THEN (price - b) * 100 / b END, 4) AS delta_percent, round(price - f, 4) AS delta_from_first FROM w""")
def watch_history(spark, sf_dir):
    return R.price_history(_kept(spark, sf_dir)).drop("ts")


@query("watch_export", f"""WITH {KEPT}, p AS (SELECT item_id, count(*) AS n, min_by(price, struct_pack(a := ts, b := event_id)) AS f, max_by(price, struct_pack(a := ts, b := event_id)) AS c, min(price) AS lo, max(price) AS hi FROM h GROUP BY 1)
SELECT i.item_id, coalesce(n, 0) AS n_snapshots, f AS initial_price, c AS current_price, lo AS lowest_price, hi AS highest_price, round(c - f, 4) AS delta, round(CASE WHEN f > 0 THEN (c - f) * 100 / f END, 4) AS delta_percent FROM (SELECT DISTINCT user_id AS item_id FROM events) i LEFT JOIN p USING (item_id)""")
def watch_export(spark, sf_dir):
    items = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id")).distinct()
    return R.watch_export(items, _kept(spark, sf_dir))


@query("gauges", """SELECT event_type AS metric, round(sum(value), 4) AS counter, max_by(value, struct_pack(a := ts, b := event_id)) AS gauge, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS n_since, round(avg(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-15'), 6) AS mean_since FROM events GROUP BY 1""")
def gauges(spark, sf_dir):
    return R.gauges(T.metrics(spark, sf_dir), "metric", "ts", "event_id", "value", F.lit("2024-01-15").cast("timestamp"))


@query("last_averages", """WITH r AS (SELECT event_type AS metric, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100) SELECT metric, count(*) AS n, round(avg(value), 6) AS average FROM r GROUP BY 1""")
def last_averages(spark, sf_dir):
    return R.last_averages(T.metrics(spark, sf_dir), "metric", "ts", "event_id", "value")


@query("dashboard_reads", """SELECT 'total' AS view, event_type AS name, count(*)::DOUBLE AS value FROM events GROUP BY 2 UNION ALL SELECT 'mean', event_type, round(avg(value), 6) FROM events GROUP BY 2 UNION ALL SELECT 'last_day', event_type, count(*) FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 2 UNION ALL SELECT 'error_rate', 'all', round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) FROM events""")
def dashboard_reads(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("__last"))
    by = e.crossJoin(F.broadcast(last)).groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("ts") > F.col("__last") - F.expr("INTERVAL 1 DAY")).cast("double").alias("last_day"))
    views = by.select("name", F.explode(F.array(*(F.struct(F.lit(v).alias("view"), F.col(v).alias("value")) for v in ("total", "mean", "last_day")))).alias("x")).select("x.view", "name", "x.value").filter("view <> 'last_day' OR value > 0")
    rate = e.agg(F.round(F.count_if(F.col("event_type") == "error") / F.count(F.lit(1)), 6).alias("value")).select(F.lit("error_rate").alias("view"), F.lit("all").alias("name"), "value")
    return views.unionByName(rate)


@query("profile_report", """SELECT lpad((1000000000000000 - c_custkey * 7 % 1000)::VARCHAR, 16, '0') || ' ' || c_name AS ord, '@' || c_name || ': ' || (c_custkey * 7 % 1000) || ' followers, ' || c_nationkey || ' following, ' || c_custkey || ' posts' AS line FROM customer""")
def profile_report(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), (F.col("c_custkey") * 7 % 1000).alias("followers"), F.col("c_nationkey").alias("following"), F.col("c_custkey").alias("posts"))
    return K.profile_lines(c)


RANK = "0.6::DOUBLE * least({c} / 100, 10.0::DOUBLE) + 0.4::DOUBLE * greatest(0.0::DOUBLE, 1 - {a} / 20) * least({c} / 50, 1.0::DOUBLE)"


@query("shapley_values", f"""WITH p AS (SELECT o_orderkey AS paper_id, floor(o_totalprice / 1000)::DOUBLE AS c, (2001 - year(o_orderdate))::DOUBLE AS a FROM orders), m AS (SELECT avg(c) AS mc, avg(a) AS ma FROM p),
f AS (SELECT *, {RANK.format(c='c', a='a')} AS fca, {RANK.format(c='mc', a='a')} AS fa, {RANK.format(c='c', a='ma')} AS fc, {RANK.format(c='mc', a='ma')} AS f0 FROM p, m), s AS (SELECT paper_id, 'citations' AS feature, c AS value, round((fc - f0) / 2 + (fca - fa) / 2, 8) AS contribution FROM f UNION ALL SELECT paper_id, 'age', a, round((fa - f0) / 2 + (fca - fc) / 2, 8) FROM f)
SELECT *, CASE WHEN contribution > 0 THEN 'positive' WHEN contribution < 0 THEN 'negative' ELSE 'neutral' END AS direction FROM s""")
def shapley_values(spark, sf_dir):
    p = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("citations"), (2001 - F.year("o_orderdate")).cast("double").alias("age"))

    def score(x):
        return 0.6 * F.least(x["citations"] / 100, F.lit(10.0)) + 0.4 * F.greatest(F.lit(0.0), 1 - x["age"] / 20) * F.least(x["citations"] / 50, F.lit(1.0))

    return X.shapley(p, "paper_id", ["citations", "age"], score, p)


@query("counterfactuals", """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice::DOUBLE AS r FROM part) SELECT p_partkey, CASE WHEN 50 + r / 100 > 30 THEN 'size' ELSE 'price' END AS feature, CASE WHEN 50 + r / 100 > 30 THEN s ELSE r END AS value, CASE WHEN 1 + r / 100 > 30 THEN 1 WHEN 50 + r / 100 > 30 THEN 50 ELSE 0 END::DOUBLE AS changed FROM p WHERE 50 + r / 100 > 30""")
def counterfactuals(spark, sf_dir):
    p = T.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return X.counterfactual(p, "p_partkey", ["size", "price"], {"size": (1, 50)}, lambda x: F.when(x["size"] + x["price"] / 100 > 30, "large").otherwise("small"), "large")


@query("confidence_scores", """SELECT event_id, round(0.5::DOUBLE * value / 100 + 0.3::DOUBLE * (event_id % 10) / 10 + 0.2::DOUBLE * coalesce(CASE WHEN event_id % 3 > 0 THEN (event_id % 7) / 7 END, 0.8::DOUBLE), 6) AS overall, array_to_string([x FOR x IN [CASE WHEN value / 100 < 0.7 THEN 'low model confidence' END, CASE WHEN (event_id % 10) / 10 < 0.7 THEN 'low data quality' END, CASE WHEN event_id % 3 > 0 AND (event_id % 7) / 7 < 0.8 THEN 'limited past accuracy' END] IF x IS NOT NULL], ',') AS sources FROM events""")
def confidence_scores(spark, sf_dir):
    i = F.col("event_id")
    c = X.confidence(F.col("value") / 100, (i % 10) / 10, F.when(i % 3 > 0, (i % 7) / 7))
    return T.table(spark, sf_dir, "events").select("event_id", c.alias("c")).select("event_id", F.round("c.overall", 6).alias("overall"), F.array_join("c.sources", ",").alias("sources"))


@query("isolation_scores")
def isolation_scores(spark, sf_dir):
    """Accounts by an isolation forest over eight features made of their orders."""
    o = T.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("account")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_totalprice").alias("most"), F.min("o_totalprice").alias("least"), F.count_distinct("o_orderpriority").alias("kinds"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    f = o.select("account", F.log1p("n").alias("f1"), F.log1p("total").alias("f2"), F.log1p("most").alias("f3"), (F.col("least") / F.col("most")).alias("f4"), (F.col("total") / F.col("n")).alias("f5"), F.col("kinds").cast("double").alias("f6"), (F.col("done") / F.col("n")).alias("f7"), (F.col("account") % 2).cast("double").alias("f8"))
    return X.isolation_forest(f, "account", [f"f{k}" for k in range(1, 9)])


@query("early_fusion", """WITH e AS (SELECT vec_id, embedding[1:20]::DOUBLE[] AS a, embedding[21:40]::DOUBLE[] AS b, embedding[41:64]::DOUBLE[] AS c FROM embeddings), d AS (SELECT vec_id, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS ab, list_dot_product(a, c[1:20]) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(c[1:20], c[1:20]))) AS ac, list_dot_product(b, c[1:20]) / (sqrt(list_dot_product(b, b)) * sqrt(list_dot_product(c[1:20], c[1:20]))) AS bc FROM e)
SELECT vec_id, 64::INT AS size, round((0.9::DOUBLE + 0.4::DOUBLE + 0.6::DOUBLE) / 3, 6) AS confidence, round((ab + ac + bc) / 3, 5) AS consistency, array_to_string(['all modalities', CASE WHEN ab > 0.8 THEN 'high consistency: vision, audio' WHEN ab < 0.3 THEN 'low consistency: vision, audio' END, CASE WHEN ac > 0.8 THEN 'high consistency: vision, text' WHEN ac < 0.3 THEN 'low consistency: vision, text' END, CASE WHEN bc > 0.8 THEN 'high consistency: audio, text' WHEN bc < 0.3 THEN 'low consistency: audio, text' END, 'low confidence: audio'], '; ') AS insights FROM d""")
def early_fusion(spark, sf_dir):
    def part(at, n):
        return F.slice("embedding", at, n).cast("array<double>")

    fused = N.early_fusion({"vision": (part(1, 20), F.lit(0.9)), "audio": (part(21, 20), F.lit(0.4)), "text": (part(41, 24), F.lit(0.6))})
    rows = T.table(spark, sf_dir, "embeddings").select("vec_id", fused.alias("f"))
    return rows.select("vec_id", F.size("f.features").alias("size"), F.round("f.confidence", 6).alias("confidence"), F.round("f.consistency", 5).alias("consistency"), F.array_join("f.insights", "; ").alias("insights"))


@query("batch_results", """SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN (2 * p_size)::VARCHAR END AS result, CASE WHEN p_size % 5 = 0 THEN 'bad item ' || p_size END AS error FROM part""")
def batch_results(spark, sf_dir):
    def doubled(x):  # by value, as tasks have no session to import this module with
        if x % 5 == 0:
            raise ValueError(f"bad item {x}")
        return 2 * x

    return W.process_batch(T.table(spark, sf_dir, "part").select("p_partkey", "p_size"), doubled, "p_partkey", "p_size")


def _one(name, **metrics):
    """A step that reads one-row metrics off a registered query."""
    def run(given, _):
        spark, sf_dir = given
        return catalog.queries()[name](spark, sf_dir).agg(*(m.alias(k) for k, m in metrics.items()))

    return run


def _fails(given, _):
    raise ValueError("no source answers")


def _steps():
    rows = F.count(F.lit(1))
    return {
        "discovery": [W.Step("search", _one("rank_papers", papers=rows)), W.Step("frontier", _one("frontier_topics", topics=rows), ("search",)), W.Step("review", _one("abstract_screening", found=rows, included=F.count_if(F.col("decision") == "include"), excluded=F.count_if(F.col("decision") == "exclude")), ("search",))],
        "citation": [W.Step("graph", _one("citation_crawl", nodes=rows, depth=F.max("depth"))), W.Step("intents", _one("citation_intent", contexts=rows, positive=F.count_if(F.col("tone") == "positive")), ("graph",))],
        "forecast": [W.Step("impact", _one("impact_forecast", papers=rows, mean=F.round(F.avg("score"), 6))), W.Step("journals", _one("journal_ranking", journals=rows, best=F.max("rank_score")), ("impact",))],
        "recommend": [W.Step("similar", _one("recommend_min_year", papers=rows, most_shared=F.max("shared"))), W.Step("reviewers", _one("reviewer_ranking", reviewers=rows, best=F.max("score")), ("similar",))],
        "bulk": [W.Step("harvest", _one("federated_dedup", papers=rows)), W.Step("remote", _fails, (), 60.0, False), W.Step("open_access", _one("oa_compliance", checked=rows, compliant=F.count_if("compliant")), ("harvest",)), W.Step("map", _one("keyword_cooccurrence", edges=rows), ("harvest", "remote"))],
    }


_METRICS = {
    "discovery": [("search", "papers", "count(*)", "rank_papers"), ("frontier", "topics", "count(*)", "frontier_topics"), ("review", "found", "count(*)", "abstract_screening"), ("review", "included", "count(*) FILTER (WHERE decision = 'include')", "abstract_screening"), ("review", "excluded", "count(*) FILTER (WHERE decision = 'exclude')", "abstract_screening")],
    "citation": [("graph", "nodes", "count(*)", "citation_crawl"), ("graph", "depth", "max(depth)", "citation_crawl"), ("intents", "contexts", "count(*)", "citation_intent"), ("intents", "positive", "count(*) FILTER (WHERE tone = 'positive')", "citation_intent")],
    "forecast": [("impact", "papers", "count(*)", "impact_forecast"), ("impact", "mean", "round(avg(score), 6)", "impact_forecast"), ("journals", "journals", "count(*)", "journal_ranking"), ("journals", "best", "max(rank_score)", "journal_ranking")],
    "recommend": [("similar", "papers", "count(*)", "recommend_min_year"), ("similar", "most_shared", "max(shared)", "recommend_min_year"), ("reviewers", "reviewers", "count(*)", "reviewer_ranking"), ("reviewers", "best", "max(score)", "reviewer_ranking")],
    "bulk": [("harvest", "papers", "count(*)", "federated_dedup"), ("open_access", "checked", "count(*)", "oa_compliance"), ("open_access", "compliant", "count(*) FILTER (WHERE compliant)", "oa_compliance"), ("map", "edges", "count(*)", "keyword_cooccurrence")],
}


def _report_sql(name):
    rows = [f"SELECT '{name}' AS pipeline, '{stage}' AS stage, 'completed' AS status, '{metric}' AS metric, ({value})::DOUBLE AS value FROM ({catalog._SQL[source]})" for stage, metric, value, source in _METRICS[name]]
    return " UNION ALL ".join(rows + (["SELECT 'bulk', 'remote', 'failed', '', NULL"] if name == "bulk" else []))


for _name in _METRICS:

    def _plan(spark, sf_dir, name=_name):
        return W.report(spark, name, _steps()[name], (spark, sf_dir))

    _plan.__doc__ = f"The combined pipeline {_name}: its stages as a workflow, one row a metric."
    query(f"pipeline_{_name}", _report_sql(_name))(_plan)
