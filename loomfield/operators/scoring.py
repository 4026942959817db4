"""Rule scores and small models over feature columns: accounts, virality, impact, journals, frontiers, open access."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def when_sum(*terms: tuple[Column, float]) -> Column:
    """The weights of all conditions that hold."""
    return reduce(lambda a, t: a + F.when(t[0], F.lit(t[1])).otherwise(F.lit(0.0)), terms, F.lit(0.0))


def ladder(value: Column, steps: list[tuple[float, object]], below: object) -> Column:
    """The label of the first threshold, from the highest, that value reaches."""
    return reduce(lambda c, s: c.when(value >= s[0], s[1]), steps, F).otherwise(below)


def bot_score() -> Column:
    """From posting_regularity, engagement_ratio, comment_similarity, following_ratio, account_age_days, posts_per_day, activity_hours."""
    c = F.col
    return F.least(F.lit(1.0), when_sum(
        (c("posting_regularity") > 0.9, 0.3), ((c("engagement_ratio") > 0.5) | (c("engagement_ratio") < 0.001), 0.2), (c("comment_similarity") > 0.7, 0.3), (c("following_ratio") > 10, 0.2),
        ((c("account_age_days") < 30) & (c("posts_per_day") > 10), 0.2), (c("activity_hours") > 20, 0.2)))


def spam_score() -> Column:
    """From link_frequency, promo_frequency, hashtags_per_post, duplicate_ratio, mention_frequency."""
    c = F.col
    return F.least(F.lit(1.0), when_sum((c("link_frequency") > 0.5, 0.25), (c("promo_frequency") > 0.3, 0.25), (c("hashtags_per_post") > 15, 0.2), (c("duplicate_ratio") > 0.3, 0.2), (c("mention_frequency") > 3, 0.1)))


def simple_bot_score() -> Column:
    """From followers, following, has_avatar, has_bio, username."""
    c = F.col
    ratio = c("following") / F.nullif("followers", F.lit(0))
    return when_sum((ratio > 10, 0.3), ((ratio > 5) & (ratio <= 10), 0.15), (~c("has_avatar"), 0.2), (~c("has_bio"), 0.15), (c("username").rlike("[0-9]{5,}"), 0.2), ((c("following") > 1000) & (c("followers") < 100), 0.25))


def account_health(bot: Column, spam: Column, fake_percent: Column) -> Column:
    """Authenticity: 1 - (0.4 bot + 0.3 spam + 0.3 fake share), not below 0."""
    return F.greatest(F.lit(0.0), 1 - (0.4 * bot + 0.3 * spam + 0.3 * fake_percent / 100))


def virality() -> Column:
    """From has_music, duration, faces, has_overlay, hashtags, has_cta, caption_length, followers, engagement, trending, sentiment."""
    c = F.col
    return F.least(F.lit(1.0), 0.2 + when_sum(
        (c("has_music"), 0.1), (c("duration").between(15, 30), 0.1), ((c("duration") > 30) & (c("duration") <= 60), 0.05), (c("faces") > 0, 0.1), (c("has_overlay"), 0.05), (c("hashtags").between(3, 5), 0.1), (c("has_cta"), 0.05),
        (c("caption_length").between(50, 150), 0.05), (c("followers") > 10000, 0.15), ((c("followers") > 1000) & (c("followers") <= 10000), 0.1), ((c("followers") > 100) & (c("followers") <= 1000), 0.05), (c("engagement") > 0.1, 0.1), (c("trending"), 0.05), (c("sentiment") > 0.5, 0.05)))


VIRALITY_TIERS = [(0.8, "viral"), (0.5, "high"), (0.25, "medium")]


def saturating(x: Column, top: float) -> Column:
    return F.least(x / top, F.lit(1.0))


def impact_score() -> Column:
    """0.25 author + 0.20 journal + 0.25 paper + 0.15 network + 0.15 early, each from its own columns (0 to 1)."""
    c = F.col
    author = saturating(c("author_h_index"), 50) * 0.30 + saturating(c("author_papers"), 200) * 0.15 + saturating(c("author_citations"), 10000) * 0.20 + when_sum((c("n_authors").between(3, 6), 0.10), (c("n_authors") > 6, 0.07), (c("n_authors").between(1, 2), 0.05))
    journal = saturating(c("impact_factor"), 30) * 0.35 + saturating(c("journal_h5"), 300) * 0.25 + saturating(c("journal_median"), 20) * 0.10 + F.lit(0.02)
    paper = when_sum((c("n_refs").between(30, 60), 0.15), (c("n_refs") > 60, 0.12), ((c("n_refs") > 15) & (c("n_refs") < 30), 0.08), (c("n_refs") <= 15, 0.03), (c("n_keywords") >= 4, 0.08), (c("n_keywords").between(2, 3), 0.05))
    network = saturating(c("n_coauthors"), 10) * 0.30
    early = F.when(c("early_citations") > 0, F.least(F.log1p("early_citations") / F.log1p(F.lit(50)), F.lit(1.0)) * 0.40).otherwise(0.0)
    return 0.25 * F.least(author, F.lit(1.0)) + 0.20 * F.least(journal, F.lit(1.0)) + 0.25 * F.least(paper, F.lit(1.0)) + 0.15 * F.least(network, F.lit(1.0)) + 0.15 * F.least(early, F.lit(1.0))


def journal_rank_score() -> Column:
    """From impact_factor, median, h5, gini, n_papers."""
    c = F.col
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), saturating(c("impact_factor"), 50) * 0.25 + saturating(c("median"), 30) * 0.25 + saturating(c("h5"), 200) * 0.20 + (1 - c("gini")) * 0.15 + saturating(c("n_papers"), 5000) * 0.15))


def frontier_score() -> Column:
    """0.35 growth (to 5), 0.30 velocity (to 50), 0.20 novelty, 0.15 diversity."""
    c = F.col
    return 0.35 * F.least(F.greatest(c("growth"), F.lit(0.0)), F.lit(5.0)) / 5 + 0.30 * saturating(c("velocity"), 50) + 0.20 * c("novelty") + 0.15 * c("diversity")


def trajectory(growth: Column, score: Column) -> Column:
    return F.when((growth > 0.5) & (score > 0.4), F.when(growth > 1.5, "surging").otherwise("emerging")).when(growth > 0.1, "growing").when(growth < -0.1, "declining").otherwise("stable")


#: Open-access mandates (fixed values): key, immediate access wanted, accepted licences, longest embargo, green allowed, licence binding.
MANDATES = [
    ("plan_s", True, ["cc-by", "cc-by-sa", "cc0"], 0, True, True),
    ("nsf", False, ["cc-by", "cc-by-sa", "cc-by-nc", "cc0"], 12, True, False),
    ("nih", False, ["cc-by", "cc-by-sa", "cc-by-nc", "cc0"], 12, True, False),
    ("erc", True, ["cc-by", "cc-by-sa", "cc0"], 6, True, True),
    ("ukri", True, ["cc-by", "cc-by-sa", "cc0"], 0, False, True),
    ("gates", True, ["cc-by"], 0, False, True),
    ("wellcome", True, ["cc-by"], 0, True, True),
    ("dfg", False, ["cc-by", "cc-by-sa", "cc-by-nc", "cc0"], 12, True, False),
]


def oa_compliance(papers: DataFrame) -> DataFrame:
    """(paper_id, funder, compliant) of papers (paper_id, funder, is_oa, oa_status, license, embargo_months) by their funder's mandate."""
    rules = papers.sparkSession.createDataFrame(MANDATES, "funder string, immediate boolean, licenses array<string>, max_embargo int, allows_green boolean, binding boolean")
    j = papers.join(F.broadcast(rules), "funder", "left")
    bad = (
        (F.col("immediate") & F.col("oa_status").isin("closed", "bronze")) | ((F.col("oa_status") == "green") & ~F.col("allows_green"))
        | (F.col("binding") & (F.col("license") != "") & ~F.exists("licenses", lambda x: F.lower("license").contains(x))) | (F.col("embargo_months") > F.col("max_embargo")))
    return j.select("paper_id", "funder", (F.col("is_oa") & ~F.coalesce(bad, F.lit(False))).alias("compliant"))


def reviewer_rank(candidates: DataFrame) -> DataFrame:
    """candidates with score .5 expertise + .2 productivity + .15 recency + .15 h-index (scaled by the largest), conflicts at a tenth and last."""
    top = candidates.agg(F.max("papers").alias("mp"), F.max("recent").alias("mr"), F.max("h_index").alias("mh"))

    def scaled(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    raw = 0.5 * F.col("expertise") + 0.2 * scaled("papers", "mp") + 0.15 * scaled("recent", "mr") + 0.15 * scaled("h_index", "mh")
    rows = candidates.crossJoin(F.broadcast(top))
    return rows.withColumn("score", F.round(F.when(F.col("conflict"), raw * 0.1).otherwise(raw), 6)).drop("mp", "mr", "mh")


def isolation_substitute(items: DataFrame, features: list[str]) -> DataFrame:
    """items with anomaly = sigmoid(mean robust z - 3): distance from the medians in units of the interquartile range."""
    q = items.agg(*(F.percentile(F.col(f).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{f}") for f in features))
    rows = items.crossJoin(F.broadcast(q))

    def z(f: str) -> Column:
        p = F.col(f"q_{f}")
        spread = p[2] - p[0]
        return F.when(spread > 0, F.abs(F.col(f) - p[1]) / spread).otherwise(0.0)

    mean = sum((z(f) for f in features), F.lit(0.0)) / len(features)
    return rows.withColumn("anomaly", F.round(1 / (1 + F.exp(-(mean - 3))), 6)).drop(*(f"q_{f}" for f in features))


def train_classifier(rows: DataFrame, features: list[str], label: str, layers: list[int] | None = None, seed: int = 7):
    """A multilayer perceptron on assembled, standardised features; returns the fitted pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="skip"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True),
        MultilayerPerceptronClassifier(featuresCol="__x", labelCol=label, layers=[len(features), *(layers or [16, 8]), 2], seed=seed, maxIter=40),
    ]).fit(rows)


def kmeans_topics(docs: DataFrame, text: str = "text", topics: int = 5, seed: int = 7) -> DataFrame:
    """docs with topic: k-means over TF-IDF of word counts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StopWordsRemover

    p = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"[^\p{L}]+", minTokenLength=3), StopWordsRemover(inputCol="__w", outputCol="__s"), HashingTF(inputCol="__s", outputCol="__t", numFeatures=1 << 12),
        IDF(inputCol="__t", outputCol="__f"), KMeans(featuresCol="__f", predictionCol="topic", k=topics, seed=seed)])
    return p.fit(docs).transform(docs).drop("__w", "__s", "__t", "__f")


def permutation_importance(rows: DataFrame, predict, features: list[str], label: str, seed: int = 7) -> DataFrame:
    """(feature, importance): loss of accuracy of predict(DataFrame) -> DataFrame with `prediction` when a feature's values
    are passed on to the next row in a seeded hash order. Values move by a join on positions within buckets of rows."""
    from pyspark.sql.window import Window

    spark = rows.sparkSession
    buckets = max(64, rows.count() // 100_000)
    base = rows.withColumn("__k", F.xxhash64(F.lit(seed), *features, label)).withColumn("__b", F.pmod("__k", F.lit(buckets)))

    def accuracy(df: DataFrame) -> float:
        return predict(df).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0] or 0.0

    whole = accuracy(rows)
    out = []
    for f in features:  # bounded by the number of features
        moved = base.withColumn(f, F.coalesce(F.lead(f).over(Window.partitionBy("__b").orderBy("__k")), F.first(f).over(Window.partitionBy("__b").orderBy("__k"))))
        out.append((f, round(whole - accuracy(moved.drop("__k", "__b")), 6)))
    return spark.createDataFrame(out, "feature string, importance double")
