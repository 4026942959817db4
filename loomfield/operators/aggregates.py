"""Aggregations: rollups, order statistics, concentration measures, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, or `empty` where b is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0)) != 0, a / b).otherwise(F.lit(empty))


def journal_metrics(papers: DataFrame, keys: list[str], value: str = "citation_count", places: int = 6) -> DataFrame:
    """Count, total, mean ("impact factor"), median and linear percentiles of citations per group."""
    p = F.percentile(value, F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75, 0.9))))
    return (
        papers.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_papers"), F.sum(value).alias("total_citations"), F.avg(value).alias("impact_factor"), p.alias("p"))
        .select(*keys, "n_papers", "total_citations", F.round("impact_factor", places).alias("impact_factor"), *(F.round(F.col("p")[i], places).alias(n) for i, n in enumerate(("p25", "median", "p75", "p90"))))
    )


def h_index(papers: DataFrame, keys: list[str], value: str = "citation_count", name: str = "h_index") -> DataFrame:
    """The largest h with h items of at least h; found from counts per value, so a hot group is summed map-side first."""
    counts = papers.filter(F.col(value) > 0).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0))
    best = counts.withColumn("above", above).groupBy(*keys).agg(F.max(F.least(value, "above")).alias("h"))
    return papers.select(*keys).distinct().join(best, keys, "left").select(*keys, F.coalesce("h", F.lit(0)).cast("long").alias(name))


def gini(items: DataFrame, keys: list[str], value: str, variant: str = "standard", places: int = 6) -> DataFrame:
    """Gini coefficient per group.

    `standard`: sum((2i - n - 1) v) / (n sum v), i from 1 in rising order. `cumulative`: 1 - sum(running totals) / (n total)
    + 1 / (2n), clamped to 0..1, which gives 0.5 for equal values. Equal values are summed before ranking.
    """
    counts = items.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    v, c = F.col(value).cast("double"), F.col("c")
    before_n, before_sum = F.coalesce(F.sum("c").over(w), F.lit(0)), F.coalesce(F.sum(v * c).over(w), F.lit(0.0))
    rows = counts.select(*keys, v.alias("v"), c, before_n.alias("bn"), before_sum.alias("bs"))
    n, total = F.sum("c"), F.sum(F.col("v") * F.col("c"))
    if variant == "standard":
        ranks = F.sum(F.col("v") * (F.col("c") * F.col("bn") + F.col("c") * (F.col("c") + 1) / 2))
        g = F.when((n == 0) | (total == 0), 0.0).otherwise((2 * ranks - (n + 1) * total) / (n * total))
    else:
        running = F.sum(F.col("c") * F.col("bs") + F.col("v") * F.col("c") * (F.col("c") + 1) / 2)
        g = F.when((n == 0) | (total == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - running / (n * total) + 1 / (2 * n))))
    return rows.groupBy(*keys).agg(F.round(g, places).alias("gini"))


def top_share(items: DataFrame, keys: list[str], value: str, percent: float = 10.0, places: int = 6) -> DataFrame:
    """The share of the total that the top percent of rows (at least one) have."""
    counts = items.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    every = Window.partitionBy(*keys)
    above = F.coalesce(F.sum("c").over(every.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = counts.select(*keys, F.col(value).cast("double").alias("v"), "c", above.alias("above"), F.sum("c").over(every).alias("n"))
    top = F.greatest(F.lit(1), F.floor(F.col("n") * percent / 100))
    used = F.greatest(F.lit(0), F.least(F.col("c"), top - F.col("above")))
    return rows.groupBy(*keys).agg(F.round(ratio(F.sum(F.col("v") * used), F.sum(F.col("v") * F.col("c"))), places).alias("top_share"))


def rollup_report(items: DataFrame, keys: list[str], value: str, distinct: str) -> DataFrame:
    """Rows, total, mean and distinct count per group."""
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total"), F.round(F.avg(value), 8).alias("mean"), F.count_distinct(distinct).alias("n_distinct")
    )


def success_rate(events: DataFrame, keys: list[str], success: Column) -> DataFrame:
    """Uses, wins and rate per key."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("uses"), F.count_if(success).alias("wins")).withColumn("success_rate", F.round(F.col("wins") / F.col("uses"), 6))


def parity(predictions: DataFrame, group: str, positive: Column, limit: float = 0.2) -> DataFrame:
    """Positive rate per group, with the largest gap between groups and whether it exceeds the limit."""
    rates = predictions.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(positive.cast("double")).alias("rate"))
    gap = rates.agg((F.max("rate") - F.min("rate")).alias("gap"))
    return rates.crossJoin(F.broadcast(gap)).select(group, "n", F.round("rate", 6).alias("rate"), F.round("gap", 6).alias("gap"), (F.col("gap") > limit).alias("biased"))


def ab_test(outcomes: DataFrame, test: str, variant: str, value: str, least: int = 100, gap: float = 0.01) -> DataFrame:
    """Means of variants a and b per test; the winner if both have enough outcomes and differ enough."""
    def of(v: str) -> Column:
        return F.when(F.col(variant) == v, F.col(value))

    m = outcomes.groupBy(test).agg(F.count(of("a")).alias("n_a"), F.count(of("b")).alias("n_b"), F.avg(of("a")).alias("ma"), F.avg(of("b")).alias("mb"))
    decided = (F.col("n_a") >= least) & (F.col("n_b") >= least) & (F.abs(F.col("ma") - F.col("mb")) >= gap)
    return m.select(test, "n_a", "n_b", F.round("ma", 6).alias("mean_a"), F.round("mb", 6).alias("mean_b"), F.when(decided & (F.col("ma") > F.col("mb")), "a").when(decided, "b").otherwise("none").alias("winner"))


def histogram(events: DataFrame, part: Column, slots: int, name: str) -> DataFrame:
    """Counts and shares of all slots 0..slots-1, empty ones too."""
    counts = events.groupBy(part.cast("int").alias(name)).agg(F.count(F.lit(1)).alias("c"))
    spine = events.sparkSession.range(slots).select(F.col("id").cast("int").alias(name))
    total = counts.agg(F.sum("c").alias("total"))
    joined = spine.join(counts, name, "left").crossJoin(F.broadcast(total))
    return joined.select(name, F.coalesce("c", F.lit(0)).cast("long").alias("count"), F.round(F.coalesce(F.col("c") / F.col("total"), F.lit(0.0)), 6).alias("share"))


def most_common(items: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """Values by falling count, ties by the values themselves."""
    counted = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), *keys).limit(n) if n else counted


def top_per_key(items: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark cuts to k in each task before the shuffle."""
    return items.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)
