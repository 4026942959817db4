"""Text analytics over documents, benchmark items, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as X
from ..sources import tables as T
from .catalog import query

CLEAN = r"trim(regexp_replace(regexp_replace(lower(text), 'https?://[^ ]+|[@#][a-z0-9_]+', ' ', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'))"


@query("text_features", rf"""SELECT doc_id, md5({CLEAN}) AS clean_md5, len(regexp_extract_all(text, '#[A-Za-z0-9_]+'))::INT AS n_hashtags, len(regexp_extract_all(text, '@[A-Za-z0-9_]+'))::INT AS n_mentions, len(regexp_extract_all(text, 'https?://'))::INT AS n_links, len(regexp_extract_all(text, '[^\s]+'))::INT AS n_words, len(regexp_extract_all(text, '[.!?]+'))::INT AS n_sentences,
 round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / length(text) ELSE 0 END, 6) AS alpha_ratio FROM documents""")
def text_features(spark, sf_dir):
    f = X.features(T.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return f.withColumn("clean_md5", F.md5("clean_text")).drop("text", "clean_text")


@query("text_validation", r"""WITH a AS (SELECT doc_id, text, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text) ELSE 0 END, 6) AS r FROM documents), e AS (SELECT doc_id, r, concat_ws(',', CASE WHEN length(trim(text)) = 0 THEN 'empty' END, CASE WHEN length(text) < 10 THEN 'too_short' END, CASE WHEN r < 0.3 THEN 'few_letters' END) AS errors FROM a)
SELECT doc_id, errors, errors = '' AS valid, round(least(1.0, r + 0.3::DOUBLE), 6) AS quality_score FROM e""")
def text_validation(spark, sf_dir):
    return X.validate(T.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "errors", "valid", "quality_score")


WORDS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM documents"
TFIDF = f"w AS ({WORDS}), c AS (SELECT doc_id, token, count(*) AS c FROM w GROUP BY 1, 2), l AS (SELECT doc_id, sum(c) AS len FROM c GROUP BY 1), d AS (SELECT token, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(*) AS n FROM l), t AS (SELECT doc_id, token, c / len AS tf, ln(n / (1 + df)) + 1 AS idf FROM c JOIN l USING (doc_id) JOIN d USING (token), n)"


def words(spark, sf_dir):
    return X.tokens(T.table(spark, sf_dir, "documents"), "doc_id", least=4)


@query("tfidf_weights", f"WITH {TFIDF} SELECT doc_id, token, round(tf, 8) AS tf, round(idf, 8) AS idf, round(tf * idf, 8) AS weight FROM t")
def tfidf_weights(spark, sf_dir):
    return X.tfidf(words(spark, sf_dir), "doc_id")


@query("tfidf_top_terms", f"WITH {TFIDF} SELECT doc_id, token, round(tf * idf, 8) AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * idf, 8) DESC, token)::INT AS rank FROM t QUALIFY rank <= 3")
def tfidf_top_terms(spark, sf_dir):
    from ..operators.aggregates import top_per_key

    return top_per_key(X.tfidf(words(spark, sf_dir), "doc_id").select("doc_id", "token", "weight"), ["doc_id"], [F.desc("weight"), F.asc("token")], 3)


@query("tfidf_cosine", f"""WITH {TFIDF}, s AS (SELECT doc_id, token, round(tf * idf, 8) AS weight FROM t), n AS MATERIALIZED (SELECT doc_id, sqrt(sum(weight * weight)) AS nd FROM s GROUP BY 1), p AS (SELECT doc_id AS probe, token, weight AS pw FROM s WHERE doc_id % 20 = 0)
SELECT probe, s.doc_id, round(sum(weight * pw) / (any_value(a.nd) * any_value(b.nd)), 6) AS cosine FROM s JOIN p USING (token) JOIN n a ON a.doc_id = s.doc_id JOIN n b ON b.doc_id = probe GROUP BY 1, 2""".replace("n AS MATERIALIZED (SELECT doc_id, sqrt", "nn AS MATERIALIZED (SELECT doc_id, sqrt").replace("JOIN n a", "JOIN nn a").replace("JOIN n b", "JOIN nn b"))
def tfidf_cosine(spark, sf_dir):
    w = X.tfidf(words(spark, sf_dir), "doc_id").select("doc_id", "token", "weight")
    return X.cosine_to(w, w.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("probe"), "token", "weight"), "doc_id")


SHINGLES = r"""SELECT DISTINCT id, sh AS shingle FROM (SELECT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM (SELECT id, list_filter(regexp_split_to_array(lower(t), '\s+'), lambda x: x <> '') AS w FROM {src}))"""


@query("probe_overlap", f"""WITH p AS ({SHINGLES.format(src='(SELECT item_id AS id, text AS t FROM benchmark)')}), d AS ({SHINGLES.format(src='(SELECT doc_id AS id, text AS t FROM documents)')}), a AS (SELECT id, count(*) AS n FROM p GROUP BY 1), b AS (SELECT id, count(*) AS n FROM d GROUP BY 1),
h AS (SELECT p.id AS probe, d.id AS doc_id, count(*) AS shared FROM p JOIN d USING (shingle) GROUP BY 1, 2) SELECT probe, doc_id, shared, round(shared / (a.n + b.n - shared), 8) AS jaccard, round(shared / least(a.n, b.n), 8) AS overlap FROM h JOIN a ON a.id = probe JOIN b ON b.id = doc_id""")
def probe_overlap(spark, sf_dir):
    p = X.shingles(T.table(spark, sf_dir, "benchmark"), "item_id", 5).withColumnRenamed("item_id", "probe")
    return X.probe_overlap(p, X.shingles(T.table(spark, sf_dir, "documents"), "doc_id", 5), "doc_id")


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SENTIMENT = f"""c AS (SELECT doc_id, source, len(list_intersect(list_distinct(string_split(lower(text), ' ')), {_list(X.POSITIVE)}))::INT AS n_positive, len(list_intersect(list_distinct(string_split(lower(text), ' ')), {_list(X.NEGATIVE)}))::INT AS n_negative FROM documents),
s AS (SELECT *, round(CASE WHEN n_positive + n_negative > 0 THEN (n_positive - n_negative) / (n_positive + n_negative) ELSE 0 END, 6) AS score FROM c), r AS (SELECT *, CASE WHEN score > 0.2 THEN 'positive' WHEN score < -0.2 THEN 'negative' ELSE 'neutral' END AS label, round(CASE WHEN n_positive + n_negative > 0 THEN least(1.0, (n_positive + n_negative) / 5) ELSE 0.5 END, 6)::DOUBLE AS confidence FROM s)"""


@query("sentiment", f"WITH {SENTIMENT} SELECT doc_id, n_positive, n_negative, score, label, confidence FROM r")
def sentiment(spark, sf_dir):
    return X.sentiment(T.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("sentiment_by_source", f"WITH {SENTIMENT} SELECT source, count(*) AS n, round(avg(score), 6) AS mean_score, count(*) FILTER (WHERE label = 'positive') AS positive, count(*) FILTER (WHERE label = 'negative') AS negative, max_by(doc_id, struct_pack(a := score, b := -doc_id)) AS most_positive, min_by(doc_id, struct_pack(a := score, b := doc_id)) AS most_negative FROM r GROUP BY 1")
def sentiment_by_source(spark, sf_dir):
    s = X.sentiment(T.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return s.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.count_if(F.col("label") == "positive").alias("positive"), F.count_if(F.col("label") == "negative").alias("negative"),
        F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("most_positive"), F.min_by("doc_id", F.struct("score", "doc_id")).alias("most_negative"))


def _intent_sql():
    t = "lower(coalesce(text, ''))"
    scores = ", ".join("(" + " + ".join(f"len(regexp_extract_all({t}, '{p}'))" for p in ps) + f") / {len(ps)}" for ps in X.INTENTS.values())
    names = _list(X.INTENTS)
    tone = "CASE intent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.INTENT_SENTIMENT.items()) + " END"
    return f"""WITH s AS (SELECT conv_id, turn, trim(coalesce(text, '')) = '' AS blank, [{scores}] AS s FROM conversations), b AS (SELECT *, list_max(s) AS best, list_sum(s) AS total FROM s),
i AS (SELECT conv_id, turn, CASE WHEN best > 0 THEN round(CASE WHEN best >= 2 THEN least(1.0::DOUBLE, least(1.0::DOUBLE, best / greatest(total, 1.0::DOUBLE)) + 0.2::DOUBLE) ELSE least(1.0::DOUBLE, best / greatest(total, 1.0::DOUBLE)) END, 3) WHEN blank THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END AS confidence,
 CASE WHEN best > 0 THEN {names}[list_position(s, best)] ELSE 'background' END AS intent FROM b) SELECT *, {tone} AS tone FROM i"""


@query("citation_intent", _intent_sql())
def citation_intent(spark, sf_dir):
    return X.intent(T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).drop("text")


@query("intent_summary", f"SELECT intent, count(*) AS n, round(least(1.0, greatest(0.0, (count(*) FILTER (WHERE tone = 'positive') + 0.5 * count(*) FILTER (WHERE tone = 'neutral') - 0.3 * count(*) FILTER (WHERE tone = 'negative')) / count(*)))::DOUBLE, 6) AS quality FROM ({_intent_sql()}) GROUP BY 1")
def intent_summary(spark, sf_dir):
    i = citation_intent(spark, sf_dir)

    def share(v):
        return F.count_if(F.col("tone") == v)

    q = (share("positive") + 0.5 * share("neutral") - 0.3 * share("negative")) / F.count(F.lit(1))
    return i.groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), q)), 6).alias("quality"))


STUDY = "CASE " + " ".join(f"WHEN regexp_matches(text, '{X.either(ps)}') THEN '{k}'" for k, ps in X.STUDY_TYPES.items()) + " ELSE 'unknown' END"


@query("study_types", f"SELECT {STUDY} AS study_type, count(*) AS n FROM documents GROUP BY 1")
def study_types(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").groupBy(X.study_type(F.col("text")).alias("study_type")).agg(F.count(F.lit(1)).alias("n"))


BONUS = "CASE study_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.EVIDENCE_BONUS.items()) + " ELSE 0 END"


@query("abstract_screening", f"""WITH s AS (SELECT doc_id, {STUDY} AS study_type, contains(lower(text), 'the')::INT + contains(lower(text), 'license')::INT AS inc, contains(lower(text), 'worthless')::INT + contains(lower(text), 'stupid')::INT AS exc, CASE WHEN contains(lower(text), 'ation') OR contains(lower(text), 'heit') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(text), 'ment') THEN 0.5 ELSE 0 END AS pico FROM documents), t AS (SELECT doc_id, study_type, exc, (inc - 2 * exc + pico + {BONUS})::DOUBLE AS score FROM s)
SELECT doc_id, study_type, score, CASE WHEN exc > 0 THEN 'exclude' WHEN score >= 2 THEN 'include' WHEN score >= 0.5 THEN 'uncertain' ELSE 'exclude' END AS decision FROM t""")
def abstract_screening(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    return X.screening(d, ["the", "license"], ["worthless", "stupid"], {"P": ["ation", "heit"], "I": ["ment"]}).drop("text")


def _bias_sql():
    def risk(signals):
        a, b = (f"regexp_matches(text, '{X.either(signals[k])}')" for k in ("low", "high"))
        return f"CASE WHEN {a} AND NOT {b} THEN 'low' WHEN {b} AND NOT {a} THEN 'high' ELSE 'unclear' END"

    cols = ", ".join(f"{risk(v)} AS {k}" for k, v in X.BIAS_DOMAINS.items())
    n = {v: " + ".join(f"({k} = '{v}')::INT" for k in X.BIAS_DOMAINS) for v in ("high", "low")}
    return f"WITH r AS (SELECT doc_id, {cols} FROM documents) SELECT *, CASE WHEN {n['high']} >= 3 THEN 'high' WHEN {n['low']} >= 4 THEN 'low' ELSE 'unclear' END AS overall FROM r"


@query("risk_of_bias", _bias_sql())
def risk_of_bias(spark, sf_dir):
    return X.risk_of_bias(T.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("duplicate_sentences", r"""WITH s AS (SELECT doc_id, lower(trim(replace(x, chr(10), ' '))) AS s FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+')) AS x FROM documents)) SELECT doc_id, count(*) AS n_sentences, count(*) - count(DISTINCT s) AS duplicates FROM s WHERE length(s) > 30 GROUP BY 1""")
def duplicate_sentences(spark, sf_dir):
    return X.duplicate_sentences(T.table(spark, sf_dir, "documents"), "doc_id")


@query("vocabulary_variance", r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents), v AS (SELECT doc_id, len(list_distinct(list_filter(string_split(lower(p), ' '), lambda x: x <> ''))) AS v FROM p WHERE length(trim(p)) > 50)
SELECT doc_id, count(*) AS n_paragraphs, round(avg(v), 6) AS mean_vocabulary, round(stddev_pop(v), 6) AS deviation, stddev_pop(v) > avg(v) * 0.6 AS uneven FROM v GROUP BY 1 HAVING count(*) >= 3""")
def vocabulary_variance(spark, sf_dir):
    return X.vocabulary_variance(T.table(spark, sf_dir, "documents"), "doc_id")


PHRASE_BONUS = " + ".join(f"CASE WHEN regexp_matches(lower(sentence), '{p}') THEN 0.15::DOUBLE ELSE 0 END" for p in X.PHRASES)


@query("key_sentences", rf"""WITH x AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: length(trim(x)) > 20) AS x FROM benchmark), s AS (SELECT item_id, len(x) AS o, unnest(x) AS sentence, generate_subscripts(x, 1) - 1 AS pos FROM x), w AS (SELECT *, regexp_extract_all(lower(sentence), '[a-z]{{3,}}') AS words FROM s),
d AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS token FROM benchmark) GROUP BY 1), n AS (SELECT count(*) AS n FROM benchmark), i AS (SELECT item_id, pos, avg(ln(n / df)) AS idf FROM (SELECT item_id, pos, unnest(list_distinct(words)) AS token FROM w) JOIN d USING (token), n GROUP BY 1, 2),
c AS (SELECT item_id, pos::INT AS pos, trim(sentence) AS sentence, round(coalesce(idf, 0) * CASE WHEN pos = 0 THEN 1.5::DOUBLE WHEN pos = o - 1 THEN 1.2::DOUBLE WHEN pos < o * 0.3::DOUBLE THEN 1.1::DOUBLE ELSE 1 END * CASE WHEN len(words) BETWEEN 15 AND 40 THEN 1 WHEN len(words) < 10 THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END * (1.0::DOUBLE + {PHRASE_BONUS}), 6) AS score FROM w LEFT JOIN i USING (item_id, pos))
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pos) <= 3""")
def key_sentences(spark, sf_dir):
    return X.key_sentences(T.table(spark, sf_dir, "benchmark"), "item_id")


@query("keyword_topics", f"""WITH w AS ({WORDS}), t AS (SELECT token AS word, count(DISTINCT doc_id) AS n_docs FROM w GROUP BY 1 ORDER BY n_docs DESC, word LIMIT 25) SELECT ((row_number() OVER (ORDER BY n_docs DESC, word) - 1) // 5)::INT AS topic, word, n_docs FROM t""")
def keyword_topics(spark, sf_dir):
    return X.keyword_topics(words(spark, sf_dir), "doc_id")


@query("hashtag_top", r"""SELECT lower(h) AS tag, count(*) AS count FROM (SELECT unnest(regexp_extract_all(text, '#([A-Za-z0-9_]+)', 1)) AS h FROM documents) GROUP BY 1 ORDER BY count DESC, tag LIMIT 20""")
def hashtag_top(spark, sf_dir):
    h = T.table(spark, sf_dir, "documents").select(F.explode(X.found(F.col("text"), "#([A-Za-z0-9_]+)", 1)).alias("h"))
    return h.groupBy(F.lower("h").alias("tag")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "tag").limit(20)


@query("numbers_in_text", r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(\.[0-9]+)?%?')) AS n FROM documents) SELECT doc_id, count(*) AS n_numbers, count(*) FILTER (WHERE n LIKE '%\%' ESCAPE '\') AS n_percentages, max(try_cast(replace(n, '%', '') AS DOUBLE)) AS largest FROM n GROUP BY 1""")
def numbers_in_text(spark, sf_dir):
    n = T.table(spark, sf_dir, "documents").select("doc_id", F.explode(X.found(F.col("text"), r"[0-9]+(\.[0-9]+)?%?")).alias("n"))
    return n.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_numbers"), F.count_if(F.col("n").endswith("%")).alias("n_percentages"), F.max(F.replace("n", F.lit("%"), F.lit("")).try_cast("double")).alias("largest"))


@query("page_fields", r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<a href='))::INT AS n_links, len(regexp_extract_all(html, '<p>'))::INT AS n_paragraphs, regexp_extract(url, '://([^/]*)', 1) AS host FROM pages""")
def page_fields(spark, sf_dir):
    p = T.table(spark, sf_dir, "pages")
    return p.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), X.hits(F.col("html"), "<a href=").alias("n_links"), X.hits(F.col("html"), "<p>").alias("n_paragraphs"),
        F.regexp_extract("url", "://([^/]*)", 1).alias("host"))


@query("endpoint_log", r"""SELECT split_part(url, '?', 1) AS endpoint, count(*) AS n, min(page_id) AS first_page FROM pages WHERE regexp_matches(url, '/(en|de)/') GROUP BY 1""")
def endpoint_log(spark, sf_dir):
    p = T.table(spark, sf_dir, "pages").filter(F.col("url").rlike("/(en|de)/"))
    return p.groupBy(F.split_part("url", F.lit("?"), F.lit(1)).alias("endpoint")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


@query("language_vote", r"""WITH v AS (SELECT doc_id, len(regexp_extract_all(' ' || lower(text) || ' ', ' (the|of|and)')) AS en, len(regexp_extract_all(' ' || lower(text) || ' ', ' (der|die|und)')) AS de, len(regexp_extract_all(' ' || lower(text) || ' ', ' (le|la|les|et)')) AS fr, len(regexp_extract_all(' ' || lower(text) || ' ', ' (el|los|que|un)')) AS es FROM documents)
SELECT doc_id, CASE WHEN greatest(en, de, fr, es) = 0 THEN 'unknown' WHEN en = greatest(en, de, fr, es) THEN 'en' WHEN de = greatest(en, de, fr, es) THEN 'de' WHEN fr = greatest(en, de, fr, es) THEN 'fr' ELSE 'es' END AS lang FROM v""")
def language_vote(spark, sf_dir):
    t = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    rows = T.table(spark, sf_dir, "documents").select("doc_id", *(X.hits(t, f" ({p})").alias(k) for k, p in (("en", "the|of|and"), ("de", "der|die|und"), ("fr", "le|la|les|et"), ("es", "el|los|que|un"))))
    best = F.greatest("en", "de", "fr", "es")
    return rows.select("doc_id", F.when(best == 0, "unknown").when(F.col("en") == best, "en").when(F.col("de") == best, "de").when(F.col("fr") == best, "fr").otherwise("es").alias("lang"))


@query("citation_density", r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\[[0-9, -]+\]|\([A-Z][a-z]+, [0-9]{4}\)')) AS inline, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents) SELECT doc_id, inline::INT AS n_citations, n::INT AS n_words, CASE WHEN n > 2000 AND inline < 5 THEN 30.0 ELSE 0.0 END::DOUBLE AS density_score FROM c""")
def citation_density(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", X.hits(F.col("text"), r"\[[0-9, -]+\]|\([A-Z][a-z]+, [0-9]{4}\)").alias("n_citations"), F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("n_words"))
    return d.withColumn("density_score", F.when((F.col("n_words") > 2000) & (F.col("n_citations") < 5), 30.0).otherwise(0.0))


@query("suspicion_score", r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\[[0-9, -]+\]|\([A-Z][a-z]+, [0-9]{4}\)')) AS inline, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents), s AS (SELECT doc_id, lower(trim(replace(x, chr(10), ' '))) AS s FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+')) AS x FROM documents)),
d AS (SELECT doc_id, count(*) - count(DISTINCT s) AS dup FROM s WHERE length(s) > 30 GROUP BY 1), p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents), v AS (SELECT doc_id, len(list_distinct(list_filter(string_split(lower(p), ' '), lambda x: x <> ''))) AS v FROM p WHERE length(trim(p)) > 50), u AS (SELECT doc_id, stddev_pop(v) > avg(v) * 0.6 AS uneven FROM v GROUP BY 1 HAVING count(*) >= 3),
t AS (SELECT c.doc_id, (0.3 * CASE WHEN n > 2000 AND inline < 5 THEN 30 ELSE 0 END + 0.3 * (CASE WHEN coalesce(uneven, false) THEN 15 ELSE 0 END + CASE WHEN coalesce(dup, 0) > 2 THEN 20 ELSE 0 END))::DOUBLE AS score FROM c LEFT JOIN d USING (doc_id) LEFT JOIN u USING (doc_id)) SELECT doc_id, round(score, 4) AS score, CASE WHEN score >= 50 THEN 'critical' WHEN score >= 30 THEN 'high' WHEN score >= 15 THEN 'medium' ELSE 'low' END AS risk FROM t""")
def suspicion_score(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = citation_density(spark, sf_dir).join(X.duplicate_sentences(d, "doc_id").select("doc_id", "duplicates"), "doc_id", "left").join(X.vocabulary_variance(d, "doc_id").select("doc_id", "uneven"), "doc_id", "left")
    score = 0.3 * F.col("density_score") + 0.3 * (F.when(F.coalesce("uneven", F.lit(False)), 15).otherwise(0) + F.when(F.coalesce("duplicates", F.lit(0)) > 2, 20).otherwise(0))
    return rows.select("doc_id", F.round(score, 4).alias("score"), F.when(score >= 50, "critical").when(score >= 30, "high").when(score >= 15, "medium").otherwise("low").alias("risk"))


@query("paper_theme_similarity")
def paper_theme_similarity(spark, sf_dir):
    """Fuzzy similarity of neighbouring benchmark texts (a fold over characters, which SQL has no table form for)."""
    b = T.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("t"))
    return b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u")), "item_id").select("item_id", F.round(X.fuzzy_similarity(F.col("t"), F.col("u")), 6).alias("similarity"))


@query("range_expansion", """WITH r AS (SELECT p_partkey, (p_size % 7 + 1) || ', ' || (p_size % 5 + 3) || '-' || (p_size % 5 + 6) AS raw FROM part) SELECT p_partkey, array_to_string(list_concat([p1::INT], range(lo::INT, hi::INT + 1)), ',') AS numbers FROM (SELECT p_partkey, split_part(raw, ', ', 1) AS p1, split_part(split_part(raw, ', ', 2), '-', 1) AS lo, split_part(raw, '-', 2) AS hi FROM r)""")
def range_expansion(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    raw = F.concat((F.col("p_size") % 7 + 1).cast("string"), F.lit(", "), (F.col("p_size") % 5 + 3).cast("string"), F.lit("-"), (F.col("p_size") % 5 + 6).cast("string"))
    return p.select("p_partkey", F.array_join(X.expand_ranges(raw), ",").alias("numbers"))
