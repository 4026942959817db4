"""Scores over feature rows, payload parsing, formatting and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import scoring as S
from ..sources import payloads as J
from ..sources import sinks as K
from ..sources import tables as T
from .catalog import query
from .rollups import PAPERS


@query("bot_scores", """WITH f AS (SELECT c_custkey, (c_custkey % 100) / 100 AS a, (c_custkey % 37) / 50 AS b, (c_custkey % 11) / 10 AS c, c_custkey % 15 AS d, c_custkey % 90 AS e, c_custkey % 13 AS g, c_custkey % 25 AS h FROM customer)
SELECT c_custkey AS account, round(least(1.0, CASE WHEN a > 0.9 THEN 0.3 ELSE 0 END + CASE WHEN b > 0.5 OR b < 0.001 THEN 0.2 ELSE 0 END + CASE WHEN c > 0.7 THEN 0.3 ELSE 0 END + CASE WHEN d > 10 THEN 0.2 ELSE 0 END + CASE WHEN e < 30 AND g > 10 THEN 0.2 ELSE 0 END + CASE WHEN h > 20 THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS bot_score FROM f""")
def bot_scores(spark, sf_dir):
    k = F.col("c_custkey")
    c = T.table(spark, sf_dir, "customer").select(
        k, ((k % 100) / 100).alias("posting_regularity"), ((k % 37) / 50).alias("engagement_ratio"), ((k % 11) / 10).alias("comment_similarity"), (k % 15).alias("following_ratio"), (k % 90).alias("account_age_days"), (k % 13).alias("posts_per_day"), (k % 25).alias("activity_hours"))
    return c.select(k.alias("account"), F.round(S.bot_score(), 6).alias("bot_score"))


@query("spam_scores", """SELECT c_custkey AS account, round(least(1.0, CASE WHEN (c_custkey % 10) / 10 > 0.5 THEN 0.25 ELSE 0 END + CASE WHEN (c_custkey % 7) / 10 > 0.3 THEN 0.25 ELSE 0 END + CASE WHEN c_custkey % 20 > 15 THEN 0.2 ELSE 0 END + CASE WHEN (c_custkey % 6) / 10 > 0.3 THEN 0.2 ELSE 0 END + CASE WHEN c_custkey % 5 > 3 THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS spam_score FROM customer""")
def spam_scores(spark, sf_dir):
    k = F.col("c_custkey")
    c = T.table(spark, sf_dir, "customer").select(k, ((k % 10) / 10).alias("link_frequency"), ((k % 7) / 10).alias("promo_frequency"), (k % 20).alias("hashtags_per_post"), ((k % 6) / 10).alias("duplicate_ratio"), (k % 5).alias("mention_frequency"))
    return c.select(k.alias("account"), F.round(S.spam_score(), 6).alias("spam_score"))


@query("simple_bots", """WITH f AS (SELECT c_custkey, c_name, c_custkey % 200 AS followers, (c_custkey * 13) % 3000 AS following, c_custkey % 3 > 0 AS av, c_custkey % 4 > 0 AS bio FROM customer), s AS (SELECT c_custkey AS account, CASE WHEN following / nullif(followers, 0) > 10 THEN 0.3 WHEN following / nullif(followers, 0) > 5 THEN 0.15 ELSE 0 END + CASE WHEN NOT av THEN 0.2 ELSE 0 END + CASE WHEN NOT bio THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(c_name, '[0-9]{5,}') THEN 0.2 ELSE 0 END + CASE WHEN following > 1000 AND followers < 100 THEN 0.25 ELSE 0 END AS s FROM f)
SELECT account, round(least(1.0, s)::DOUBLE, 6) AS score FROM s WHERE round(s::DOUBLE, 6) >= 0.5""")
def simple_bots(spark, sf_dir):
    k = F.col("c_custkey")
    c = T.table(spark, sf_dir, "customer").select(k, F.col("c_name").alias("username"), (k % 200).alias("followers"), ((k * 13) % 3000).alias("following"), (k % 3 > 0).alias("has_avatar"), (k % 4 > 0).alias("has_bio"))
    return c.select(k.alias("account"), F.round(S.simple_bot_score(), 6).alias("s")).filter("s >= 0.5").select("account", F.least(F.lit(1.0), "s").alias("score"))


@query("account_health", """SELECT c_custkey AS account, round(greatest(0, 1 - (0.4 * (c_custkey % 10) / 10 + 0.3 * (c_custkey % 7) / 7 + 0.3 * (c_custkey % 50) / 100))::DOUBLE, 6) AS authenticity FROM customer""")
def account_health(spark, sf_dir):
    k = F.col("c_custkey")
    return T.table(spark, sf_dir, "customer").select(k.alias("account"), F.round(S.account_health((k % 10) / 10, (k % 7) / 7, k % 50), 6).alias("authenticity"))


@query("virality_scores", """WITH f AS (SELECT p_partkey, p_size, p_partkey % 2 = 0 AS music, p_size + 5 AS duration, p_partkey % 3 AS faces, p_partkey % 5 = 0 AS overlay, p_partkey % 8 AS hashtags, p_partkey % 4 = 0 AS cta, length(p_name) * 5 AS cap, p_retailprice * 10 AS followers, (p_partkey % 20) / 100 AS engagement, p_partkey % 6 = 0 AS trending, (p_partkey % 10) / 10 AS sentiment FROM part),
s AS (SELECT p_partkey AS video_id, round(least(1.0, 0.2 + CASE WHEN music THEN 0.1 ELSE 0 END + CASE WHEN duration BETWEEN 15 AND 30 THEN 0.1 WHEN duration > 30 AND duration <= 60 THEN 0.05 ELSE 0 END + CASE WHEN faces > 0 THEN 0.1 ELSE 0 END + CASE WHEN overlay THEN 0.05 ELSE 0 END + CASE WHEN hashtags BETWEEN 3 AND 5 THEN 0.1 ELSE 0 END + CASE WHEN cta THEN 0.05 ELSE 0 END + CASE WHEN cap BETWEEN 50 AND 150 THEN 0.05 ELSE 0 END
 + CASE WHEN followers > 10000 THEN 0.15 WHEN followers > 1000 THEN 0.1 WHEN followers > 100 THEN 0.05 ELSE 0 END + CASE WHEN engagement > 0.1 THEN 0.1 ELSE 0 END + CASE WHEN trending THEN 0.05 ELSE 0 END + CASE WHEN sentiment > 0.5 THEN 0.05 ELSE 0 END)::DOUBLE, 6) AS probability FROM f) SELECT *, CASE WHEN probability >= 0.8 THEN 'viral' WHEN probability >= 0.5 THEN 'high' WHEN probability >= 0.25 THEN 'medium' ELSE 'low' END AS tier FROM s""")
def virality_scores(spark, sf_dir):
    p = F.col("p_partkey")
    rows = T.table(spark, sf_dir, "part").select(
        p, (p % 2 == 0).alias("has_music"), (F.col("p_size") + 5).alias("duration"), (p % 3).alias("faces"), (p % 5 == 0).alias("has_overlay"), (p % 8).alias("hashtags"), (p % 4 == 0).alias("has_cta"), (F.length("p_name") * 5).alias("caption_length"),
        (F.col("p_retailprice") * 10).alias("followers"), ((p % 20) / 100).alias("engagement"), (p % 6 == 0).alias("trending"), ((p % 10) / 10).alias("sentiment"))
    s = rows.select(p.alias("video_id"), F.round(S.virality(), 6).alias("probability"))
    return s.withColumn("tier", S.ladder(F.col("probability"), S.VIRALITY_TIERS, "low"))


JM = f"SELECT journal, count(*) AS n_papers, avg(citation_count) AS impact_factor, quantile_cont(citation_count, 0.5) AS median FROM ({PAPERS}) GROUP BY 1"
H5 = f"SELECT journal, count(*) FILTER (WHERE citation_count >= rn) AS h5 FROM (SELECT journal, citation_count, row_number() OVER (PARTITION BY journal ORDER BY citation_count DESC) AS rn FROM ({PAPERS})) GROUP BY 1"
GINI = f"SELECT journal, round(sum((2 * i - n - 1) * v) / (max(n) * sum(v)), 6) AS gini FROM (SELECT journal, citation_count::DOUBLE AS v, row_number() OVER (PARTITION BY journal ORDER BY citation_count) AS i, count(*) OVER (PARTITION BY journal) AS n FROM ({PAPERS})) GROUP BY 1"


@query("journal_ranking", f"""SELECT journal, round(greatest(0.0, least(1.0, least(round(impact_factor, 6) / 50, 1.0) * 0.25::DOUBLE + least(round(median, 6) / 30, 1.0) * 0.25::DOUBLE + least(h5 / 200, 1.0) * 0.2::DOUBLE + (1 - gini) * 0.15::DOUBLE + least(n_papers / 5000, 1.0) * 0.15::DOUBLE)), 6) AS rank_score FROM ({JM}) JOIN ({H5}) USING (journal) JOIN ({GINI}) USING (journal)""")
def journal_ranking(spark, sf_dir):
    p = T.papers(spark, sf_dir)
    m = A.journal_metrics(p, ["journal"]).join(A.h_index(p, ["journal"], name="h5"), "journal").join(A.gini(p, ["journal"], "citation_count"), "journal")
    return m.select("journal", F.round(S.journal_rank_score(), 6).alias("rank_score"))


@query("frontier_topics", f"""WITH p AS ({PAPERS}), y AS (SELECT journal AS topic, year, count(*) AS c FROM p GROUP BY 1, 2), g AS (SELECT topic, avg(c) FILTER (WHERE year >= 1999) AS r, avg(c) FILTER (WHERE year < 1999) AS o FROM y GROUP BY 1), v AS (SELECT journal AS topic, avg(citation_count / greatest(2001 - year, 1)) AS velocity FROM p WHERE year >= 1998 GROUP BY 1),
n AS (SELECT journal AS topic, count(DISTINCT source_api) FILTER (WHERE year >= 2000) / 10 AS novelty, least(1.0, count(DISTINCT paper_id % 50) / 100) AS diversity FROM p GROUP BY 1), f AS (SELECT topic, (r - o) / o AS growth, velocity, novelty, diversity FROM g JOIN v USING (topic) JOIN n USING (topic)),
s AS (SELECT topic, round(growth, 6) AS growth, round(velocity, 6) AS velocity, round(0.35::DOUBLE * least(greatest(growth, 0), 5) / 5 + 0.3::DOUBLE * least(velocity / 50, 1) + 0.2::DOUBLE * novelty + 0.15::DOUBLE * diversity, 6) AS score FROM f) SELECT *, CASE WHEN growth > 0.5 AND score > 0.4 THEN CASE WHEN growth > 1.5 THEN 'surging' ELSE 'emerging' END WHEN growth > 0.1 THEN 'growing' WHEN growth < -0.1 THEN 'declining' ELSE 'stable' END AS trajectory FROM s""")
def frontier_topics(spark, sf_dir):
    p = T.papers(spark, sf_dir).withColumnRenamed("journal", "topic")
    y = p.groupBy("topic", "year").agg(F.count(F.lit(1)).alias("c")).groupBy("topic").agg(F.avg(F.when(F.col("year") >= 1999, F.col("c"))).alias("r"), F.avg(F.when(F.col("year") < 1999, F.col("c"))).alias("o"))
    v = p.groupBy("topic").agg(
        F.avg(F.when(F.col("year") >= 1998, F.col("citation_count") / F.greatest(2001 - F.col("year"), F.lit(1)))).alias("velocity"), (F.count_distinct(F.when(F.col("year") >= 2000, F.col("source_api"))) / 10).alias("novelty"),
        F.least(F.lit(1.0), F.count_distinct(F.col("paper_id") % 50) / 100).alias("diversity"))
    f = y.join(v, "topic").withColumn("growth", (F.col("r") - F.col("o")) / F.col("o"))
    s = f.select("topic", F.round("growth", 6).alias("growth"), F.round("velocity", 6).alias("velocity"), F.round(S.frontier_score(), 6).alias("score"))
    return s.withColumn("trajectory", S.trajectory(F.col("growth"), F.col("score")))


@query("impact_forecast", """WITH f AS (SELECT p_partkey, p_partkey % 60 AS a, p_partkey % 300 AS b, (p_partkey * 7) % 20000 AS c, p_partkey % 9 AS n, p_size AS ifac, p_partkey % 400 AS h5, p_partkey % 30 AS med, p_partkey % 80 AS refs, p_partkey % 6 AS kw, p_partkey % 14 AS co, p_partkey % 70 AS early FROM part),
s AS (SELECT p_partkey AS paper_id, least(a / 50, 1) * 0.3::DOUBLE + least(b / 200, 1) * 0.15::DOUBLE + least(c / 10000, 1) * 0.2::DOUBLE + CASE WHEN n BETWEEN 3 AND 6 THEN 0.1 WHEN n > 6 THEN 0.07 WHEN n BETWEEN 1 AND 2 THEN 0.05 ELSE 0 END::DOUBLE AS author, least(ifac / 30, 1) * 0.35::DOUBLE + least(h5 / 300, 1) * 0.25::DOUBLE + least(med / 20, 1) * 0.1::DOUBLE + 0.02::DOUBLE AS journal,
 CASE WHEN refs BETWEEN 30 AND 60 THEN 0.15 WHEN refs > 60 THEN 0.12 WHEN refs > 15 THEN 0.08 ELSE 0.03 END::DOUBLE + CASE WHEN kw >= 4 THEN 0.08 WHEN kw >= 2 THEN 0.05 ELSE 0 END::DOUBLE AS paper, least(co / 10, 1) * 0.3::DOUBLE AS network, CASE WHEN early > 0 THEN least(ln(1 + early) / ln(51), 1) * 0.4::DOUBLE ELSE 0 END AS early FROM f)
SELECT paper_id, round(0.25::DOUBLE * least(author, 1) + 0.2::DOUBLE * least(journal, 1) + 0.25::DOUBLE * least(paper, 1) + 0.15::DOUBLE * least(network, 1) + 0.15::DOUBLE * least(early, 1), 6) AS score FROM s""")
def impact_forecast(spark, sf_dir):
    p = F.col("p_partkey")
    names = {"author_h_index": p % 60, "author_papers": p % 300, "author_citations": (p * 7) % 20000, "n_authors": p % 9, "impact_factor": F.col("p_size"), "journal_h5": p % 400, "journal_median": p % 30, "n_refs": p % 80, "n_keywords": p % 6, "n_coauthors": p % 14, "early_citations": p % 70}
    return T.table(spark, sf_dir, "part").select(p.alias("paper_id"), *(v.alias(k) for k, v in names.items())).select("paper_id", F.round(S.impact_score(), 6).alias("score"))


def _mandates_sql():
    rows = ", ".join(f"('{k}', {str(i).lower()}, {ls!r}, {m}, {str(g).lower()}, {str(b).lower()})" for k, i, ls, m, g, b in S.MANDATES)
    return f"(VALUES {rows}) AS m(funder, immediate, licenses, max_embargo, allows_green, binding)"


@query("oa_compliance", f"""WITH p AS (SELECT p_partkey AS paper_id, ['plan_s', 'nsf', 'nih', 'erc', 'ukri', 'gates', 'wellcome', 'dfg'][(p_partkey % 8 + 1)::INT] AS funder, p_partkey % 5 > 0 AS is_oa, ['gold', 'green', 'bronze', 'hybrid'][(p_partkey % 4 + 1)::INT] AS oa_status, ['cc-by', '', 'cc-by-nc', 'cc-by-nc-nd'][(p_size % 4 + 1)::INT] AS license, p_size % 18 AS embargo FROM part)
SELECT paper_id, funder, is_oa AND NOT ((immediate AND oa_status IN ('closed', 'bronze')) OR (oa_status = 'green' AND NOT allows_green) OR (binding AND license <> '' AND len(list_filter(licenses, lambda x: contains(license, x))) = 0) OR embargo > max_embargo) AS compliant FROM p JOIN {_mandates_sql()} USING (funder)""")
def oa_compliance(spark, sf_dir):
    p, z = F.col("p_partkey"), F.col("p_size")

    def pick(values, at):
        return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))

    rows = T.table(spark, sf_dir, "part").select(
        p.alias("paper_id"), pick([m[0] for m in S.MANDATES], p % 8).alias("funder"), (p % 5 > 0).alias("is_oa"), pick(["gold", "green", "bronze", "hybrid"], p % 4).alias("oa_status"), pick(["cc-by", "", "cc-by-nc", "cc-by-nc-nd"], z % 4).alias("license"), (z % 18).alias("embargo_months"))
    return S.oa_compliance(rows)


@query("reviewer_ranking", """WITH c AS (SELECT s_suppkey AS candidate, (s_suppkey % 17) / 17 AS expertise, s_suppkey % 23 AS papers, s_suppkey % 5 AS recent, s_suppkey % 31 AS h_index, s_suppkey % 9 = 0 AS conflict FROM supplier), m AS (SELECT max(papers) AS mp, max(recent) AS mr, max(h_index) AS mh FROM c), r AS (SELECT *, 0.5::DOUBLE * expertise + 0.2::DOUBLE * papers / mp + 0.15::DOUBLE * recent / mr + 0.15::DOUBLE * h_index / mh AS raw FROM c, m)
SELECT candidate, conflict, round(CASE WHEN conflict THEN raw * 0.1::DOUBLE ELSE raw END, 6) AS score FROM r ORDER BY conflict, score DESC, candidate LIMIT 10""")
def reviewer_ranking(spark, sf_dir):
    s = F.col("s_suppkey")
    c = T.table(spark, sf_dir, "supplier").select(s.alias("candidate"), ((s % 17) / 17).alias("expertise"), (s % 23).alias("papers"), (s % 5).alias("recent"), (s % 31).alias("h_index"), (s % 9 == 0).alias("conflict"))
    return S.reviewer_rank(c).select("candidate", "conflict", "score").orderBy("conflict", F.desc("score"), "candidate").limit(10)


@query("robust_anomaly", """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders) SELECT o_orderkey, round(1 / (1 + exp(-(abs(o_totalprice - b) / (c - a) - 3))), 6) AS anomaly FROM orders, q""")
def robust_anomaly(spark, sf_dir):
    return S.isolation_substitute(T.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).select("o_orderkey", "anomaly")


@query("classifier_accuracy")
def classifier_accuracy(spark, sf_dir):
    """Accuracy of the perceptron on toxicity labels by text counts, trained on three quarters of the texts and held against all,
    the rest apart."""
    d = T.table(spark, sf_dir, "labels").join(T.table(spark, sf_dir, "documents"), "doc_id").select(
        (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("held_out"), F.col("toxic").cast("double").alias("label"), F.col("n_chars").cast("double").alias("n"), F.regexp_count("text", F.lit("!")).cast("double").alias("marks"), F.regexp_count(F.lower("text"), F.lit("stupid|worthless|idiot|pathetic|clown")).cast("double").alias("words"))
    m = S.train_classifier(d.filter("NOT held_out"), ["n", "marks", "words"], "label", layers=[4])
    return m.transform(d).groupBy("held_out", "label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


@query("kmeans_topics")
def kmeans_topics(spark, sf_dir):
    return S.kmeans_topics(T.table(spark, sf_dir, "documents").select("doc_id", "text"), topics=4).select("doc_id", "topic")


@query("embedding_cosine", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 5) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def embedding_cosine(spark, sf_dir):
    e = T.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("v").alias("w")), "vec_id")
    return j.select("vec_id", "other", F.round(dot("v", "w") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("w", "w"))), 5).alias("cosine"))


@query("modality_consistency", """WITH e AS (SELECT label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e), m AS (SELECT label, count(*) AS n, i, avg(v[i]) AS a FROM u, range(1, 65) t(i) GROUP BY label, i) SELECT label, any_value(n) AS n, round(sum(a * a), 6) AS consistency FROM m GROUP BY 1""")
def modality_consistency(spark, sf_dir):
    e = T.table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    parts = e.select("label", F.posexplode(F.transform("v", lambda x: x / size)).alias("i", "x")).groupBy("label", "i").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("a"))
    return parts.groupBy("label").agg(F.first("n").alias("n"), F.round(F.sum(F.col("a") * F.col("a")), 6).alias("consistency"))


@query("event_props", """SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events""")
def event_props(spark, sf_dir):
    return T.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("payload_works", """SELECT 'W' || o_orderkey AS paper_id, '10.1/' || o_orderkey AS doi, o_orderpriority AS title, year(o_orderdate)::INT AS year, 'alpha beta alpha' AS abstract, o_custkey AS citation_count FROM orders""")
def payload_works(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    body = F.to_json(F.struct(
        F.concat(F.lit("W"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("https://doi.org/10.1/"), F.col("o_orderkey").cast("string")).alias("doi"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("publication_year"), F.col("o_custkey").alias("cited_by_count"),
        F.create_map(F.lit("alpha"), F.array(F.lit(0), F.lit(2)), F.lit("beta"), F.array(F.lit(1))).alias("abstract_inverted_index")))
    return J.works(o.select(body.alias("body"))).select("paper_id", "doi", "title", "year", "abstract", "citation_count")


@query("payload_products", """SELECT p_partkey AS item_id, p_size::BIGINT AS shop_id, round(p_retailprice, 2) AS price, round(p_retailprice * 1.25, 4) AS price_original, 20.0::DOUBLE AS discount_percent, p_brand || ' > ' || p_type AS category FROM part""")
def payload_products(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    minor = F.round(F.col("p_retailprice") * J.MINOR_UNITS).cast("long")
    body = F.to_json(F.struct(
        F.col("p_partkey").alias("itemid"), F.col("p_size").alias("shopid"), F.col("p_name").alias("name"), minor.alias("price"), F.round(F.col("p_retailprice") * J.MINOR_UNITS * 1.25).cast("long").alias("price_before_discount"),
        F.array(F.struct(F.col("p_brand").alias("display_name")), F.struct(F.col("p_type").alias("display_name"))).alias("categories")))
    return J.products(p.select(body.alias("body"))).select("item_id", "shop_id", F.round("price", 2).alias("price"), F.round("price_original", 4).alias("price_original"), "discount_percent", "category")


@query("localised_numbers", """SELECT p_partkey, (p_size * 1000 + 500)::DOUBLE AS price, (p_size * 1000 + 200)::BIGINT AS sold, 'Rp' || replace(format('{:,}', p_size * 1000 + 500), ',', '.') AS shown FROM part""")
def localised_numbers(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    shown = J.rupiah(F.col("p_size") * 1000 + 500)
    sold = F.concat(F.lit("Terjual "), F.col("p_size").cast("string"), F.lit(",2rb"))
    return p.select("p_partkey", J.price_text(shown).alias("price"), J.sold_text(sold).alias("sold"), shown.alias("shown"))


@query("product_addresses", """SELECT p_partkey, p_partkey AS item_id, p_size::BIGINT AS shop_id FROM part""")
def product_addresses(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    url = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://x.example/product/"), F.col("p_size").cast("string"), F.lit("/"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("https://x.example/a-b-i."), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"), F.lit("?x=1")))
    return p.select("p_partkey", J.product_ids(url).alias("x")).select("p_partkey", "x.item_id", "x.shop_id")


PAPERS = """SELECT o_orderkey AS paper_id, CASE WHEN o_orderkey % 7 = 0 THEN [] ELSE ['A Customer' || o_custkey % 5, 'B Second'] END AS author_names, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE split_part(o_orderpriority, '-', 2) || ' study' END AS title, year(o_orderdate)::INT AS year, 'J' || o_orderkey % 3 AS journal, (o_orderkey % 40)::VARCHAR AS volume,
 CASE WHEN o_orderkey % 2 = 0 THEN '4' ELSE '' END AS issue, CASE WHEN o_orderkey % 3 = 0 THEN '1 - 9' WHEN o_orderkey % 3 = 1 THEN '12' ELSE '' END AS pages, '10.1/' || o_orderkey AS doi, '{' || o_orderstatus || '}' AS abstract FROM orders"""


def _exported(spark, sf_dir):
    """Orders as papers with authors, pages and abstracts, some of them empty."""
    o, k = T.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    names = F.array(F.concat(F.lit("A Customer"), (F.col("o_custkey") % 5).cast("string")), F.lit("B Second"))
    return o.select(
        k.alias("paper_id"), F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(names).alias("author_names"),
        F.when(k % 11 == 0, "").otherwise(F.concat(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)), F.lit(" study"))).alias("title"), F.year("o_orderdate").alias("year"), F.concat(F.lit("J"), (k % 3).cast("string")).alias("journal"),
        (k % 40).cast("string").alias("volume"), F.when(k % 2 == 0, "4").otherwise("").alias("issue"), F.when(k % 3 == 0, "1 - 9").when(k % 3 == 1, "12").otherwise("").alias("pages"), F.concat(F.lit("10.1/"), k.cast("string")).alias("doi"),
        F.concat(F.lit("{"), F.col("o_orderstatus"), F.lit("}")).alias("abstract"))


@query("bibtex_export", rf"""WITH p AS ({PAPERS}), b AS (SELECT *, CASE WHEN len(author_names) > 0 THEN list_last(string_split(author_names[1], ' ')) ELSE 'unknown' END || year || CASE WHEN title = '' THEN 'untitled' ELSE lower(regexp_extract(trim(title), '^\S+')) END AS base FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY paper_id) - 1 AS n FROM b), k AS (SELECT *, base || CASE WHEN n > 26 THEN chr((96 + (n - 1) // 26)::INT) ELSE '' END || CASE WHEN n > 0 THEN chr((97 + (n - 1) % 26)::INT) ELSE '' END AS key FROM n)
SELECT paper_id, key, '@article{{' || key || ',' || chr(10) || '  title = {{' || title || '}},' || CASE WHEN len(author_names) > 0 THEN chr(10) || '  author = {{' || array_to_string(author_names, ' and ') || '}},' ELSE '' END || chr(10) || '  year = {{' || year || '}},' || chr(10) || '  journal = {{' || journal || '}},' || chr(10) || '  volume = {{' || volume || '}},'
 || CASE WHEN issue <> '' THEN chr(10) || '  number = {{' || issue || '}},' ELSE '' END || CASE WHEN pages <> '' THEN chr(10) || '  pages = {{' || pages || '}},' ELSE '' END || chr(10) || '  doi = {{' || doi || '}},' || chr(10) || '  abstract = {{' || replace(replace(abstract, '{{', '\{{'), '}}', '\}}') || '}},' || chr(10) || '}}' AS entry FROM k""")
def bibtex_export(spark, sf_dir):
    return K.bibtex(_exported(spark, sf_dir))


@query("ris_export", f"""WITH p AS ({PAPERS}) SELECT paper_id, 'TY  - JOUR' || chr(10) || 'TI  - ' || title || CASE WHEN len(author_names) > 0 THEN chr(10) || array_to_string(list_transform(author_names, lambda a: 'AU  - ' || a), chr(10)) ELSE '' END || chr(10) || 'PY  - ' || year || chr(10) || 'JO  - ' || journal || chr(10) || 'VL  - ' || volume
 || CASE WHEN issue <> '' THEN chr(10) || 'IS  - ' || issue ELSE '' END || CASE pages WHEN '1 - 9' THEN chr(10) || 'SP  - 1' || chr(10) || 'EP  - 9' WHEN '12' THEN chr(10) || 'SP  - 12' ELSE '' END || chr(10) || 'DO  - ' || doi || chr(10) || 'AB  - ' || abstract || chr(10) || 'ER  - ' AS entry FROM p""")
def ris_export(spark, sf_dir):
    return K.ris(_exported(spark, sf_dir))


@query("paper_table", f"""WITH p AS ({PAPERS}) SELECT paper_id, title, array_to_string(author_names, '; ') AS authors, year::VARCHAR AS year, journal, doi, '' AS citation_count, abstract, '' AS url, '' AS is_open_access, '' AS topics, '' AS keywords FROM p""")
def paper_table(spark, sf_dir):
    return K.paper_csv(_exported(spark, sf_dir))


@query("graphml_export", """SELECT '<node id="' || n_nationkey || '"/>' AS line FROM nation UNION ALL SELECT '<edge source="' || n_regionkey || '" target="' || n_nationkey || '"/>' FROM nation""")
def graphml_export(spark, sf_dir):
    n = T.table(spark, sf_dir, "nation")
    return K.graphml_lines(n.select(F.col("n_nationkey").alias("node")), n.select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst"))).select("line")


@query("state_delta", """WITH a AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 11 <> 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change, b.v FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v""")
def state_delta(spark, sf_dir):
    p = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    return K.state_delta(p.filter("k % 10 <> 0"), p.filter("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v"))), "k", "v")


@query("wishlist_current", """WITH l AS (SELECT user_id AS item_id, ts, event_id, value AS price, event_type = 'error' AS deleted FROM events) SELECT item_id, event_id, price FROM l QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY event_id DESC) = 1 AND NOT deleted""")
def wishlist_current(spark, sf_dir):
    l = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), "event_id", F.col("value").alias("price"), (F.col("event_type") == "error").alias("deleted"))
    return K.latest(l, "item_id", "event_id", "deleted").select("item_id", "event_id", "price")


@query("threshold_alerts", """WITH r AS (SELECT * FROM (VALUES ('high_value', 'gt', 95.0::DOUBLE), ('low_value', 'lt', 2.0::DOUBLE)) AS t(rule, op, bound)) SELECT event_id, rule, value FROM events JOIN r ON (op = 'gt' AND value > bound) OR (op = 'lt' AND value < bound)""")
def threshold_alerts(spark, sf_dir):
    rules = spark.createDataFrame([("high_value", "gt", 95.0), ("low_value", "lt", 2.0)], "rule string, op string, bound double")
    hit = ((F.col("op") == "gt") & (F.col("value") > F.col("bound"))) | ((F.col("op") == "lt") & (F.col("value") < F.col("bound")))
    return T.table(spark, sf_dir, "events").select("event_id", "value").join(F.broadcast(rules), hit).select("event_id", "rule", "value")


@query("severity_filter", """WITH s AS (SELECT * FROM (VALUES ('view', 0), ('click', 0), ('signup', 1), ('purchase', 1), ('error', 3)) AS t(event_type, level)) SELECT event_id, event_type, level FROM events JOIN s USING (event_type) WHERE level >= 1 ORDER BY event_id DESC LIMIT 100""")
def severity_filter(spark, sf_dir):
    levels = spark.createDataFrame([("view", 0), ("click", 0), ("signup", 1), ("purchase", 1), ("error", 3)], "event_type string, level int")
    return T.table(spark, sf_dir, "events").select("event_id", "event_type").join(F.broadcast(levels), "event_type").filter("level >= 1").orderBy(F.desc("event_id")).limit(100)


@query("filter_chain", """SELECT doc_id, source FROM documents WHERE n_chars >= 200 AND trim(text) <> '' AND lang <> ''""")
def filter_chain(spark, sf_dir):
    from functools import reduce

    tests = [F.coalesce("n_chars", F.lit(0)) >= 200, F.trim("text") != "", F.coalesce("lang", F.lit("")) != ""]
    return T.table(spark, sf_dir, "documents").filter(reduce(lambda a, b: a & b, tests)).select("doc_id", "source")
