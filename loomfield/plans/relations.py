"""Joins, set operations and top-k over publications, products and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import graph as G
from ..operators import pairs as P
from ..sources import tables as T
from .catalog import query
from .rollups import PAPERS

REFS = "SELECT DISTINCT l_orderkey AS paper_id, l_partkey AS ref_id FROM lineitem"


@query("cocitation_pairs", f"""WITH r AS ({REFS}), t AS (SELECT ref_id FROM r GROUP BY 1 ORDER BY count(*) DESC, ref_id LIMIT 100), k AS (SELECT r.* FROM r SEMI JOIN t USING (ref_id))
SELECT x.ref_id AS a, y.ref_id AS b, count(*) AS weight FROM k x JOIN k y ON x.paper_id = y.paper_id AND x.ref_id < y.ref_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def cocitation_pairs(spark, sf_dir):
    return P.cooccurrence(T.refs(spark, sf_dir), "paper_id", "ref_id", 2, top=100)


@query("coupling_pairs", f"""WITH r AS ({REFS}) SELECT x.paper_id AS a, y.paper_id AS b, count(*) AS weight FROM r x JOIN r y ON x.ref_id = y.ref_id AND x.paper_id < y.paper_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def coupling_pairs(spark, sf_dir):
    return P.cooccurrence(T.refs(spark, sf_dir), "ref_id", "paper_id", 2)


@query("collab_edges", """WITH a AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS x, year(o_orderdate)::INT AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT p.x AS a, q.x AS b, count(*) AS weight, min(p.d) AS first, max(p.d) AS last FROM a p JOIN a q ON p.g = q.g AND p.x < q.x GROUP BY 1, 2""")
def collab_edges(spark, sf_dir):
    a, o = T.authors(spark, sf_dir), T.table(spark, sf_dir, "orders")
    return P.shared_neighbours(a.join(o, a.paper_id == o.o_orderkey), "paper_id", "author_id", F.year("o_orderdate"))


@query("keyword_cooccurrence", """WITH t AS (SELECT DISTINCT l_orderkey AS g, unnest(string_split(lower(p_name), ' ')) AS x FROM lineitem JOIN part ON l_partkey = p_partkey), f AS (SELECT x FROM t WHERE x <> '' GROUP BY 1 HAVING count(*) >= 2 ORDER BY count(*) DESC, x LIMIT 100), k AS (SELECT t.* FROM t SEMI JOIN f USING (x))
SELECT p.x AS a, q.x AS b, count(*) AS weight FROM k p JOIN k q ON p.g = q.g AND p.x < q.x GROUP BY 1, 2""")
def keyword_cooccurrence(spark, sf_dir):
    li, part = T.table(spark, sf_dir, "lineitem"), T.table(spark, sf_dir, "part")
    words = li.join(part, li.l_partkey == part.p_partkey).select("l_orderkey", F.explode(F.split(F.lower("p_name"), " ")).alias("word")).filter("word <> ''")
    return P.cooccurrence(words, "l_orderkey", "word", 1, top=100, least_freq=2)


def _themes(spark, sf_dir):
    """Users with the kinds and hours of their events."""
    return T.table(spark, sf_dir, "events").select("user_id", F.concat_ws("/", "event_type", F.hour("ts")).alias("t"))


@query("theme_pairs", """WITH t AS (SELECT DISTINCT user_id AS k, event_type || '/' || hour(ts) AS t FROM events), n AS (SELECT k, count(*) AS n FROM t GROUP BY 1),
s AS (SELECT x.k AS a, y.k AS b, count(*) AS shared FROM t x JOIN t y ON x.t = y.t AND x.k < y.k GROUP BY 1, 2) SELECT a, b, shared, round(shared / (p.n + q.n - shared), 8) AS jaccard FROM s JOIN n p ON p.k = a JOIN n q ON q.k = b WHERE shared / (p.n + q.n - shared) >= 0.3""")
def theme_pairs(spark, sf_dir):
    return P.jaccard_pairs(_themes(spark, sf_dir), "user_id", "t", 0.3)


@query("record_linkage", """SELECT x.c_custkey AS a, y.c_custkey AS b, round((CASE WHEN x.c_mktsegment = y.c_mktsegment THEN 0.4 ELSE 0 END + CASE WHEN floor(x.c_acctbal / 1000) = floor(y.c_acctbal / 1000) THEN 0.4 ELSE 0 END + CASE WHEN x.c_custkey % 7 = y.c_custkey % 7 THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS score
FROM customer x JOIN customer y ON x.c_nationkey = y.c_nationkey AND x.c_custkey < y.c_custkey WHERE (CASE WHEN x.c_mktsegment = y.c_mktsegment THEN 0.4 ELSE 0 END + CASE WHEN floor(x.c_acctbal / 1000) = floor(y.c_acctbal / 1000) THEN 0.4 ELSE 0 END + CASE WHEN x.c_custkey % 7 = y.c_custkey % 7 THEN 0.2 ELSE 0 END) >= 0.6""")
def record_linkage(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 1000).alias("band"), (F.col("c_custkey") % 7).alias("mod"))
    return P.linkage(c, "c_nationkey", "c_custkey", [("c_mktsegment", 0.4), ("band", 0.4), ("mod", 0.2)])


@query("coauthor_sets", """WITH a AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS x FROM lineitem) SELECT p.x AS author_id, count(DISTINCT q.x) AS n_coauthors, array_to_string(list_sort(list(DISTINCT q.x)), ',') AS coauthors FROM a p JOIN a q ON p.g = q.g AND p.x <> q.x GROUP BY 1""")
def coauthor_sets(spark, sf_dir):
    a = T.authors(spark, sf_dir)
    pairs = a.join(a.select("paper_id", F.col("author_id").alias("other")), "paper_id").filter("author_id <> other")
    return pairs.groupBy("author_id").agg(F.count_distinct("other").alias("n_coauthors"), F.array_join(F.sort_array(F.collect_set("other")), ",").alias("coauthors"))


@query("citation_validation", """WITH c AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS num FROM lineitem WHERE l_quantity > 20), b AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS num FROM lineitem WHERE l_discount < 0.08)
SELECT doc, num, CASE WHEN b.num IS NULL THEN 'missing_ref' ELSE 'matched' END AS status FROM c LEFT JOIN b USING (doc, num) UNION ALL SELECT doc, num, 'orphan_entry' FROM b ANTI JOIN c USING (doc, num)""")
def citation_validation(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("num"), "l_quantity", "l_discount")
    cited, listed = li.filter("l_quantity > 20").select("doc", "num").distinct(), li.filter("l_discount < 0.08").select("doc", "num").distinct()
    orphan = listed.join(cited, ["doc", "num"], "left_anti").withColumn("status", F.lit("orphan_entry"))
    return P.unmatched(cited, listed, ["doc", "num"]).unionByName(orphan)


@query("validation_report", """WITH c AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS num FROM lineitem WHERE l_quantity > 20), b AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS num FROM lineitem WHERE l_discount < 0.08)
SELECT doc, count(*) FILTER (WHERE b.num IS NOT NULL) AS matched, count(*) FILTER (WHERE b.num IS NULL) AS missing, round(count(*) FILTER (WHERE b.num IS NOT NULL) / greatest(count(*), 1), 6) AS accuracy FROM c LEFT JOIN b USING (doc, num) GROUP BY 1""")
def validation_report(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("num"), "l_quantity", "l_discount")
    v = P.unmatched(li.filter("l_quantity > 20").select("doc", "num").distinct(), li.filter("l_discount < 0.08"), ["doc", "num"])
    hit = F.count_if(F.col("status") == "matched")
    return v.groupBy("doc").agg(hit.alias("matched"), (F.count(F.lit(1)) - hit).alias("missing"), F.round(hit / F.count(F.lit(1)), 6).alias("accuracy"))


@query("bibliography_duplicates", """SELECT o_orderkey, o_custkey, year(o_orderdate)::INT AS year, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS occurrence FROM orders QUALIFY occurrence > 1""")
def bibliography_duplicates(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    return A.top_per_key(o, ["o_custkey", "year"], [F.asc("o_orderkey")], 1 << 30, "occurrence").filter("occurrence > 1")


SOURCES = "SELECT doc_id AS paper_id, CASE WHEN doc_id % 3 = 0 THEN 'DOI/' || upper(substr(md5(text), 1, 8)) ELSE '' END AS doi, text AS title, CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS abstract, n_chars AS citation_count, source AS source_api FROM documents"


def sources(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("paper_id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("DOI/"), F.upper(F.substring(F.md5("text"), 1, 8)))).otherwise("").alias("doi"), F.col("text").alias("title"),
        F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("abstract"), F.col("n_chars").alias("citation_count"), F.col("source").alias("source_api"))


@query("federated_dedup", rf"""WITH k AS (SELECT *, CASE WHEN trim(doi) <> '' THEN 'd:' || lower(trim(doi)) ELSE 't:' || trim(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) END AS key FROM ({SOURCES})),
b AS (SELECT key, paper_id, doi, title, source_api FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY source_api, paper_id) = 1), a AS (SELECT key, abstract FROM k WHERE abstract <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY source_api, paper_id) = 1),
m AS (SELECT key, max(citation_count) AS citation_count, count(*) AS n_sources FROM k GROUP BY 1) SELECT paper_id, doi, title, source_api, citation_count, coalesce(abstract, '') AS abstract, n_sources FROM b JOIN m USING (key) LEFT JOIN a USING (key)""")
def federated_dedup(spark, sf_dir):
    return P.federated_dedup(sources(spark, sf_dir), F.col("source_api"))


@query("title_dedup", f"""SELECT paper_id, title FROM ({SOURCES}) QUALIFY row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY paper_id) = 1""")
def title_dedup(spark, sf_dir):
    s = sources(spark, sf_dir)
    return s.groupBy(F.lower(F.trim("title")).alias("k")).agg(F.min(F.struct("paper_id", "title")).alias("x")).select("x.paper_id", "x.title")


@query("rank_papers", f"""SELECT paper_id, year, citation_count, round(0.6 * least(citation_count / 100, 10.0) + 0.4 * greatest(0.0, 1 - (2001 - year) / 20), 6)::DOUBLE AS score FROM ({PAPERS}) ORDER BY score DESC, paper_id LIMIT 50""")
def rank_papers(spark, sf_dir):
    p = T.papers(spark, sf_dir)
    return p.select("paper_id", "year", "citation_count", F.round(P.rank_score(F.col("citation_count"), 2001 - F.col("year")), 6).alias("score")).orderBy(F.desc("score"), "paper_id").limit(50)


@query("search_page", f"""SELECT paper_id, year, citation_count, count(*) OVER () AS total FROM ({PAPERS}) WHERE year BETWEEN 1996 AND 1998 AND source_api = '1-URGENT' ORDER BY citation_count DESC, paper_id LIMIT 25 OFFSET 25""")
def search_page(spark, sf_dir):
    p = T.papers(spark, sf_dir).filter(F.col("year").between(1996, 1998) & (F.col("source_api") == "1-URGENT"))
    total = p.agg(F.count(F.lit(1)).alias("total"))
    page = p.orderBy(F.desc("citation_count"), "paper_id").offset(25).limit(25)
    return page.crossJoin(F.broadcast(total)).select("paper_id", "year", "citation_count", "total")


@query("point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 32, 34)")
def point_lookup(spark, sf_dir):
    return T.table(spark, sf_dir, "orders").filter(F.col("o_orderkey").isin(1, 7, 32, 34)).select("o_orderkey", "o_custkey", "o_totalprice")


@query("citing_works", f"""SELECT r.paper_id, p.year, p.citation_count FROM ({REFS}) r JOIN ({PAPERS}) p USING (paper_id) WHERE ref_id = 1 ORDER BY citation_count DESC, paper_id LIMIT 50""")
def citing_works(spark, sf_dir):
    r = T.refs(spark, sf_dir).filter("ref_id = 1")
    return r.join(T.papers(spark, sf_dir), "paper_id").select("paper_id", "year", "citation_count").orderBy(F.desc("citation_count"), "paper_id").limit(50)


@query("count_by_year", "SELECT year(o_orderdate)::INT AS year, count(*) AS count FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def count_by_year(spark, sf_dir):
    return T.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("count"))


@query("recommend_min_year", f"""SELECT p.paper_id, any_value(p.year) AS year, count(*) AS shared FROM ({REFS}) x JOIN ({REFS}) y USING (ref_id) JOIN ({PAPERS}) p ON p.paper_id = y.paper_id WHERE x.paper_id = 1 AND y.paper_id <> 1 AND p.year >= 1997 GROUP BY 1 ORDER BY shared DESC, p.paper_id LIMIT 20""")
def recommend_min_year(spark, sf_dir):
    r = T.refs(spark, sf_dir)
    mine = r.filter("paper_id = 1").select("ref_id")
    p = T.papers(spark, sf_dir).filter("year >= 1997").select("paper_id", "year")
    return r.filter("paper_id <> 1").join(mine, "ref_id").join(p, "paper_id").groupBy("paper_id").agg(F.first("year").alias("year"), F.count(F.lit(1)).alias("shared")).orderBy(F.desc("shared"), "paper_id").limit(20)


@query("connection_caps", f"""SELECT src, dst, rank::INT AS rank FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rank FROM (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)) WHERE rank <= 15""")
def connection_caps(spark, sf_dir):
    e = T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return A.top_per_key(e, ["src"], [F.asc("dst")], 15)


@query("top_pairs", """WITH a AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS x FROM lineitem) SELECT p.x AS a, q.x AS b, count(*) AS weight FROM a p JOIN a q ON p.g = q.g AND p.x < q.x GROUP BY 1, 2 ORDER BY weight DESC, a, b LIMIT 25""")
def top_pairs(spark, sf_dir):
    return P.cooccurrence(T.authors(spark, sf_dir), "paper_id", "author_id", 1).orderBy(F.desc("weight"), "a", "b").limit(25)


@query("most_common_brands", "SELECT p_brand, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, p_brand LIMIT 10")
def most_common_brands(spark, sf_dir):
    return A.most_common(T.table(spark, sf_dir, "part"), ["p_brand"], 10)


@query("latest_versions", """WITH v AS (SELECT p_brand AS model, (p_size % 12) || '.' || (p_partkey % 23) || '.' || (p_partkey % 11) AS version FROM part) SELECT model, version FROM v QUALIFY row_number() OVER (PARTITION BY model ORDER BY list_transform(string_split(version, '.'), lambda x: x::INT) DESC) = 1""")
def latest_versions(spark, sf_dir):
    v = T.table(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), F.concat_ws(".", F.col("p_size") % 12, F.col("p_partkey") % 23, F.col("p_partkey") % 11).alias("version"))
    return P.latest_version(v, "model", "version")


@query("set_operations", """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def set_operations(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    flags = li.groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_returnflag") == "A").alias("b"))
    n = flags.agg(F.count_if(F.col("a") | F.col("b")).alias("union"), F.count_if(F.col("a") & F.col("b")).alias("intersect"), F.count_if(F.col("a") & ~F.col("b")).alias("except"))
    return n.select(F.explode(F.map_from_arrays(F.array(F.lit("union"), F.lit("intersect"), F.lit("except")), F.array("union", "intersect", "except"))).alias("op", "n"))


@query("keyword_novelty", """WITH w AS (SELECT DISTINCT p_size <= 25 AS recent, unnest(string_split(lower(p_name), ' ')) AS w FROM part), r AS (SELECT w FROM w WHERE recent), o AS (SELECT w FROM w WHERE NOT recent) SELECT (SELECT count(*) FROM r) AS recent, (SELECT count(*) FROM r ANTI JOIN o USING (w)) AS fresh, round((SELECT count(*) FROM r ANTI JOIN o USING (w)) / greatest((SELECT count(*) FROM r), 1), 6) AS novelty""")
def keyword_novelty(spark, sf_dir):
    w = T.table(spark, sf_dir, "part").select((F.col("p_size") <= 25).alias("recent"), F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    per = w.groupBy("w").agg(F.bool_or("recent").alias("r"), F.bool_or(~F.col("recent")).alias("o"))
    return per.agg(F.count_if("r").alias("recent"), F.count_if(F.col("r") & ~F.col("o")).alias("fresh")).withColumn("novelty", F.round(F.col("fresh") / F.greatest("recent", F.lit(1)), 6))


@query("hashtag_trend_shift", r"""WITH t AS (SELECT doc_id % 2 = 1 AS now, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS tag FROM documents), c AS (SELECT tag, count(*) FILTER (WHERE now) AS current, count(*) FILTER (WHERE NOT now) AS historical FROM t GROUP BY 1)
SELECT tag, current, historical, CASE WHEN historical = 0 THEN 'emerging' WHEN current < historical * 0.5 THEN 'declining' ELSE 'steady' END AS trend FROM c WHERE current > 0""")
def hashtag_trend_shift(spark, sf_dir):
    t = T.table(spark, sf_dir, "documents").select((F.col("doc_id") % 2 == 1).alias("now"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("tag"))
    c = t.groupBy("tag").agg(F.count_if("now").alias("current"), F.count_if(~F.col("now")).alias("historical")).filter("current > 0")
    return c.withColumn("trend", F.when(F.col("historical") == 0, "emerging").when(F.col("current") < F.col("historical") * 0.5, "declining").otherwise("steady"))


@query("research_gaps", f"""WITH k AS (SELECT p.paper_id, p.year, p.citation_count, r.ref_id AS kw FROM ({PAPERS}) p JOIN ({REFS}) r USING (paper_id)), recent AS (SELECT DISTINCT kw FROM k WHERE year >= 2001 AND citation_count > 400)
SELECT paper_id, any_value(year) AS year, any_value(citation_count) AS citation_count FROM k WHERE citation_count > 50 AND year < 2001 GROUP BY 1 HAVING count(*) FILTER (WHERE kw IN (SELECT kw FROM recent)) = 0""")
def research_gaps(spark, sf_dir):
    k = T.papers(spark, sf_dir).join(T.refs(spark, sf_dir), "paper_id")
    recent = k.filter("year >= 2001 AND citation_count > 400").select("ref_id").distinct().withColumn("hit", F.lit(1))
    old = k.filter("citation_count > 50 AND year < 2001").join(recent, "ref_id", "left")
    return old.groupBy("paper_id").agg(F.first("year").alias("year"), F.first("citation_count").alias("citation_count"), F.count("hit").alias("h")).filter("h = 0").drop("h")


@query("conflict_of_interest", """WITH a AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS x FROM lineitem), m AS (SELECT x FROM a WHERE g = 1), co AS (SELECT DISTINCT q.x FROM a p JOIN a q ON p.g = q.g WHERE p.x IN (SELECT x FROM m)), nat AS (SELECT DISTINCT s_nationkey FROM supplier WHERE s_suppkey IN (SELECT x FROM m))
SELECT s_suppkey AS candidate, s_suppkey IN (SELECT x FROM m) AS is_author, s_suppkey IN (SELECT x FROM co) AS is_coauthor, s_nationkey IN (SELECT s_nationkey FROM nat) AS same_institution FROM supplier""")
def conflict_of_interest(spark, sf_dir):
    a, s = T.authors(spark, sf_dir), T.table(spark, sf_dir, "supplier")
    mine = a.filter("paper_id = 1").select("author_id").distinct()
    co = a.join(a.join(mine, "author_id", "left_semi").select("paper_id").distinct(), "paper_id", "left_semi").select("author_id").distinct()
    nat = s.join(mine, s.s_suppkey == mine.author_id, "left_semi").select("s_nationkey").distinct().withColumn("i", F.lit(True))
    rows = s.join(mine.withColumn("m", F.lit(True)), s.s_suppkey == F.col("author_id"), "left").drop("author_id").join(co.withColumn("c", F.lit(True)), s.s_suppkey == F.col("author_id"), "left").join(nat, "s_nationkey", "left")
    return rows.select(F.col("s_suppkey").alias("candidate"), *(F.coalesce(x, F.lit(False)).alias(n) for x, n in (("m", "is_author"), ("c", "is_coauthor"), ("i", "same_institution"))))


def _ring_sql(names, virtual=150):
    return f"""WITH p AS (SELECT n || ':' || i AS v, n FROM (SELECT unnest({names!r}) AS n), range({virtual}) t(i)), r AS (SELECT ('0x' || substr(md5(v), 1, 8))::BIGINT AS pos, n FROM p), k AS (SELECT c_custkey AS key, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT AS position FROM customer),
o AS (SELECT key, position, min_by(n, pos) AS n FROM k LEFT JOIN r ON r.pos > k.position GROUP BY 1, 2) SELECT key, position, coalesce(n, (SELECT min_by(n, pos) FROM r)) AS node FROM o"""


@query("hash_ring", _ring_sql(["n1", "n2", "n3", "n4"]))
def hash_ring(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return P.ring_owner(c, "key", ["n1", "n2", "n3", "n4"])


@query("ring_distribution", f"SELECT node, count(*) AS n FROM ({_ring_sql(['n1', 'n2', 'n3', 'n4'])}) GROUP BY 1")
def ring_distribution(spark, sf_dir):
    return hash_ring(spark, sf_dir).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query("mention_edges", r"""WITH m AS (SELECT doc_id, source AS src, unnest(regexp_extract_all(text, '@([a-zA-Z0-9._]{1,30})', 1)) AS dst FROM documents) SELECT src, lower(dst) AS dst, count(*) AS frequency, count(DISTINCT doc_id) AS n_posts, min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM m WHERE lower(dst) <> lower(src) GROUP BY 1, 2""")
def mention_edges(spark, sf_dir):
    m = T.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("src"), F.explode(F.regexp_extract_all("text", F.lit("@([a-zA-Z0-9._]{1,30})"), F.lit(1))).alias("dst"))
    return m.select("doc_id", "src", F.lower("dst").alias("dst")).filter("dst <> lower(src)").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("frequency"), F.count_distinct("doc_id").alias("n_posts"), F.min("doc_id").alias("first_seen"), F.max("doc_id").alias("last_seen"))


@query("users_with_posts", "SELECT c_custkey AS user_id, count(*) AS n_posts, max(o_orderdate) AS last_post FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def users_with_posts(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    return o.join(T.table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("n_posts"), F.max("o_orderdate").alias("last_post"))


@query("theme_components", """WITH RECURSIVE e AS MATERIALIZED (WITH t AS (SELECT DISTINCT user_id AS k, event_type || '/' || hour(ts) AS t FROM events), n AS (SELECT k, count(*) AS n FROM t GROUP BY 1), s AS (SELECT x.k AS a, y.k AS b, count(*) AS shared FROM t x JOIN t y ON x.t = y.t AND x.k < y.k GROUP BY 1, 2), p AS (SELECT a, b FROM s JOIN n p ON p.k = a JOIN n q ON q.k = b WHERE shared / (p.n + q.n - shared) >= 0.3) SELECT a AS src, b AS dst FROM p UNION SELECT b, a FROM p),
r AS (SELECT src AS node, src AS label FROM e UNION SELECT e.dst, r.label FROM r JOIN e ON e.src = r.node WHERE r.label < e.dst) SELECT node, min(label) AS component FROM r GROUP BY 1""")
def theme_components(spark, sf_dir):
    return P.jaccard_components(_themes(spark, sf_dir), "user_id", "t", 0.3)
