"""Operators over ordered rows: growth, rolling statistics, change detection, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def yearly_growth(items: DataFrame, year: str = "year") -> DataFrame:
    """Rows per year with zero-filled gaps, growth in percent on the year before (0 after a year of 0), running total.

    The result has one row a year, so the one-partition window over it is bounded by the number of years.
    """
    counts = items.filter(F.col(year).isNotNull()).groupBy(F.col(year).cast("int").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    spine = counts.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).filter(F.col("lo").isNotNull()).select(F.explode(F.sequence("lo", "hi")).alias("year"))
    w = Window.orderBy("year")
    before = F.lag("count").over(w)
    return (
        spine.join(counts, "year", "left")
        .select("year", F.coalesce("n", F.lit(0)).cast("long").alias("count"))
        .select(
            "year",
            "count",
            F.when(before > 0, F.round((F.col("count") - before) * 100.0 / before, 4)).otherwise(F.lit(0.0)).alias("growth_rate"),
            F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"),
        )
    )


def growth_direction(growth: DataFrame, rate: str = "growth_rate", order: str = "year", last: int = 3) -> DataFrame:
    """Mean growth of the last rows and its label."""
    recent = growth.orderBy(F.desc(order)).limit(last).agg(F.avg(rate).alias("m"))
    label = F.when(F.col("m") > 10, "strong_growth").when(F.col("m") > 2, "growth").when(F.col("m") > -2, "stable").when(F.col("m") > -10, "decline").otherwise("strong_decline")
    return recent.select(F.round("m", 4).alias("mean_growth"), label.alias("direction"))


#: A window's series are cut into stretches of time so that one has about so many rows.
STRETCH_ROWS = 200_000


def _stretches(points: DataFrame, keys: list[str], at: Column, least: int = 1) -> tuple[DataFrame, int]:
    """points with `__s` (microseconds) and `__b`, the number of its stretch of time, and the stretches' width (0: one stretch)."""
    rows = points.withColumn("__s", at)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.min("__s").alias("lo"), F.max("__s").alias("hi")).first()
    if size["n"] <= STRETCH_ROWS or size["lo"] is None or size["hi"] == size["lo"]:
        return rows.withColumn("__b", F.lit(0).cast("long")), 0
    width = max(least, (size["hi"] - size["lo"]) * STRETCH_ROWS // size["n"] + 1)
    return rows.withColumn("__b", F.coalesce(F.floor(F.col("__s") / width), F.lit(-(1 << 60)))), width


def with_rows_before(rows: DataFrame, keys: list[str], order: list[str], count: int) -> DataFrame:
    """rows (with stretches `__b`) and, marked `__halo`, the `count` rows of a key before each of its stretches, dealt to it.

    So windows over the last rows run within stretches, and a key with a third of all rows is many tasks. Only the last rows
    of a stretch are dealt again; how many stretches need them follows from the stretches' sizes, a row a stretch.
    """
    tail = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*(F.desc(c) for c in order)))).filter(F.col("__r") <= count)
    sizes = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*keys).orderBy("__b")
    sizes = sizes.withColumns({"__i": F.row_number().over(w), "__upto": F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    ahead = sizes.select(*keys, "__b", F.col("__upto").alias("__own"), F.explode(F.sequence(F.col("__i") + 1, F.col("__i") + count)).alias("__i"))
    named = sizes.select(*keys, F.col("__b").alias("__to"), "__i", (F.col("__upto") - F.col("__c")).alias("__before"))
    dealt = ahead.join(named, [*keys, "__i"]).withColumn("__need", count - (F.col("__before") - F.col("__own"))).filter("__need > 0").select(*keys, "__b", "__to", "__need")
    halo = tail.join(dealt, [*keys, "__b"]).filter("__r <= __need").withColumn("__b", F.col("__to")).select(*rows.columns, F.lit(True).alias("__halo"))
    return rows.withColumn("__halo", F.lit(False)).unionByName(halo)


def rolling_zscore(points: DataFrame, keys: list[str], order: list[str], value: str, size: int = 100, least: int = 10, limit: float = 2.5) -> DataFrame:
    """z-score of each value against the last `size` values, itself included (population deviation), from `least` on.

    The first of the order columns is a time, by which long series are cut.
    """
    rows, width = _stretches(points, keys, micros(order[0]))
    rows = with_rows_before(rows, keys, order, size - 1) if width else rows.withColumn("__halo", F.lit(False))
    w = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(-(size - 1), 0)
    n, mean, dev = F.count(value).over(w), F.avg(value).over(w), F.stddev_pop(value).over(w)
    z = F.when((n >= least) & (dev > 0), (F.col(value) - mean) / dev).otherwise(F.lit(0.0))
    out = rows.withColumn("z", F.round(z, 4)).filter(~F.col("__halo")).drop("__s", "__b", "__halo")
    size_z = F.abs(F.col("z"))
    severity = F.when(size_z >= 4, "critical").when(size_z >= 3, "high").when(size_z >= 2.5, "medium").when(size_z >= 2, "low").otherwise("none")
    return out.withColumn("anomaly", size_z >= limit).withColumn("severity", severity).withColumn("kind", F.when(F.col("z") > 0, "spike").when(F.col("z") < 0, "drop").otherwise("flat"))


def time_window_stats(points: DataFrame, keys: list[str], ts: str, value: str, seconds: int = 300) -> DataFrame:
    """Count, mean, extremes and rate a minute over the last `seconds` up to each row's time (ties included).

    Long series are cut by time; the rows of the last `seconds` of a stretch are dealt to the next one too.
    """
    span = seconds * 1_000_000
    t, width = _stretches(points, keys, micros(ts), span)
    if width:
        late = t.filter(F.col("__s") >= (F.col("__b") + 1) * width - span).withColumn("__b", F.col("__b") + 1)
        t = t.withColumn("__halo", F.lit(False)).unionByName(late.withColumn("__halo", F.lit(True)))
    else:
        t = t.withColumn("__halo", F.lit(False))
    w = Window.partitionBy(*keys, "__b").orderBy("__s").rangeBetween(-span, 0)
    n, first = F.count(value).over(w), F.min("__s").over(w)
    passed = (F.col("__s") - first) / 1e6
    rate = F.when((n <= 1) | (passed <= 0), n * 60.0 / seconds).otherwise(n / passed * 60)
    return (
        t.withColumn("n", n).withColumn("mean", F.round(F.avg(value).over(w), 8)).withColumn("low", F.min(value).over(w)).withColumn("high", F.max(value).over(w))
        .withColumn("rate_per_minute", F.round(rate, 4)).filter(~F.col("__halo")).drop("__s", "__b", "__halo")
    )


def price_changes(prices: DataFrame, item: str = "item_id", order: tuple[str, ...] = ("ts", "event_id"), price: str = "price", significant: float = 20.0) -> DataFrame:
    """Snapshots whose price differs from the one before, against it and against the first."""
    w = Window.partitionBy(item).orderBy(*order)
    rows = prices.withColumn("price_before", F.lag(price).over(w)).withColumn("initial", F.first(price).over(w))
    rows = rows.filter(F.col("price_before").isNotNull() & (F.col(price) != F.col("price_before")))
    delta, from_first = F.col(price) - F.col("price_before"), F.col(price) - F.col("initial")
    percent = F.when(F.col("price_before") > 0, delta * 100 / F.col("price_before")).otherwise(F.lit(0.0))
    return rows.select(
        item, *order, "price_before", F.col(price).alias("price_after"), F.round(delta, 4).alias("delta"), F.round(percent, 4).alias("delta_percent"),
        F.round(from_first, 4).alias("delta_from_initial"), F.round(F.when(F.col("initial") > 0, from_first * 100 / F.col("initial")).otherwise(F.lit(0.0)), 4).alias("delta_from_initial_percent"),
        F.when(delta > 0, "up").otherwise("down").alias("direction"), (F.abs(percent) >= significant).alias("is_significant"),
    )


def price_report(prices: DataFrame, item: str = "item_id", price: str = "price") -> DataFrame:
    """First, last, lowest and highest price per item, with the change from first to last."""
    first, last = F.min_by(price, F.struct("ts", "event_id")), F.max_by(price, F.struct("ts", "event_id"))
    rows = prices.groupBy(item).agg(F.count(F.lit(1)).alias("n"), first.alias("first_price"), last.alias("last_price"), F.min(price).alias("lowest"), F.max(price).alias("highest"))
    delta = F.col("last_price") - F.col("first_price")
    return rows.withColumn("delta", F.round(delta, 4)).withColumn("delta_percent", F.round(F.when(F.col("first_price") > 0, delta * 100 / F.col("first_price")).otherwise(F.lit(0.0)), 4)).withColumn(
        "trend", F.when(delta > 0, "rise").when(delta < 0, "fall").otherwise("stable"))


def last_three_trend(prices: DataFrame, item: str = "item_id", price: str = "price") -> DataFrame:
    """rising, falling or fluctuating over an item's last three snapshots (non-strict; one snapshot: insufficient)."""
    ranked = prices.withColumn("r", F.row_number().over(Window.partitionBy(item).orderBy(F.desc("ts"), F.desc("event_id")))).filter("r <= 3")
    p = [F.max(F.when(F.col("r") == k, F.col(price))) for k in (1, 2, 3)]
    rows = ranked.groupBy(item).agg(F.count(F.lit(1)).alias("n"), *(x.alias(f"p{k}") for k, x in enumerate(p, 1)))
    up = (F.col("p1") >= F.col("p2")) & F.coalesce(F.col("p2") >= F.col("p3"), F.lit(True))
    down = (F.col("p1") <= F.col("p2")) & F.coalesce(F.col("p2") <= F.col("p3"), F.lit(True))
    return rows.select(item, F.when(F.col("n") < 2, "insufficient").when(up, "rising").when(down, "falling").otherwise("fluctuating").alias("trend"))


def ema(points: DataFrame, keys: list[str], order: list[str], value: str, span: int = 10) -> DataFrame:
    """Final exponential moving average per key, alpha = 2 / (span + 1), seeded with the first value.

    The weights alpha (1 - alpha)**age are negligible (below 1e-16) beyond a fixed age, so only that many last rows
    of a key are folded and a key's history is never gathered whole; the seed's weight is exact while it is among them.
    """
    import math

    alpha = 2 / (span + 1)
    horizon = math.ceil(math.log(1e-16) / math.log(1 - alpha)) if alpha < 1 else 1
    w = Window.partitionBy(*keys)
    age = F.row_number().over(w.orderBy(*(F.desc(c) for c in order)))
    rows = points.select(*keys, *order, value, age.alias("__age")).filter(F.col("__age") <= horizon)
    folded = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("__age")).alias("a"), F.col(value).cast("double").alias("v")))).alias("x"))
    out = F.aggregate(F.slice("x", 2, horizon), F.element_at("x", 1)["v"], lambda acc, p: acc * (1 - alpha) + p["v"] * alpha)
    return folded.select(*keys, F.round(out, 6).alias("ema"))


def intervals(events: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """(key, hours) between consecutive events of a key."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    return events.select(key, ((micros(ts) - micros(F.lag(ts).over(w))) / 3.6e9).alias("hours")).filter("hours IS NOT NULL")


def interval_stats(events: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Interval mean, median and deviation per key (positive intervals), posting regularity and burstiness."""
    rows = intervals(events, key, ts, tie).filter("hours > 0").groupBy(key).agg(
        F.count(F.lit(1)).alias("n_intervals"), F.avg("hours").alias("m"), F.percentile("hours", 0.5).alias("md"), F.coalesce(F.stddev_samp("hours"), F.lit(0.0)).alias("sd"), F.stddev_pop("hours").alias("sp"))
    return rows.select(
        key, "n_intervals", F.round("m", 4).alias("mean_hours"), F.round("md", 4).alias("median_hours"), F.round("sd", 4).alias("deviation_hours"),
        F.round(F.greatest(F.lit(0.0), 1 - F.col("sp") / F.col("m")), 4).alias("regularity"), F.round((F.col("sp") - F.col("m")) / (F.col("sp") + F.col("m")), 4).alias("burstiness"))


def half_trend(points: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Mean of the second half of a series against the first: up or down beyond 10 %, else stable."""
    w = Window.partitionBy(*keys)
    rows = points.select(*keys, value, F.row_number().over(w.orderBy(*order)).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    half = F.floor(F.col("n") / 2)
    first, second = F.avg(F.when(F.col("i") <= half, F.col(value))), F.avg(F.when(F.col("i") > half, F.col(value)))
    return rows.groupBy(*keys).agg(first.alias("a"), second.alias("b")).select(
        *keys, F.round("a", 9).alias("first_half"), F.round("b", 9).alias("second_half"),
        F.when(F.col("b") > F.col("a") * 1.1, "increasing").when(F.col("b") < F.col("a") * 0.9, "decreasing").otherwise("stable").alias("trend"))


def gaps(values: DataFrame, keys: list[str], value: str, beyond: int = 1) -> DataFrame:
    """Places where consecutive distinct values are more than `beyond` apart."""
    w = Window.partitionBy(*keys).orderBy(value)
    rows = values.select(*keys, value).distinct().withColumn("next_value", F.lead(value).over(w))
    return rows.filter(F.col("next_value") - F.col(value) > beyond).withColumn("gap", (F.col("next_value") - F.col(value)).cast("long"))


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Session windows: start, end (of the last event) and number of events."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("session_start"), F.max(ts).alias("session_end")).drop("w")
