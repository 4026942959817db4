"""Distribution statistics per group: power laws, tails, outliers. Equal values are counted before they are ranked, so
that a value common to a third of all rows is one row a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def value_counts(items: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, v, c) of positive values."""
    return items.filter(F.col(value) > 0).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))


def powerlaw_alpha(items: DataFrame, keys: list[str], value: str, xmin: float) -> DataFrame:
    """Maximum-likelihood exponent of values from xmin on: 1 + n / sum(ln(v / xmin))."""
    tail = items.filter(F.col(value) >= xmin)
    s = F.sum(F.ln(F.col(value) / F.lit(float(xmin))))
    return tail.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.when(s > 0, 1 + F.count(F.lit(1)) / s).otherwise(0.0), 6).alias("alpha"))


def ks_statistic(items: DataFrame, keys: list[str], value: str, xmin: float) -> DataFrame:
    """alpha, the largest distance between the tail's (i + 1) / n steps and the fitted law, and p = exp(-2 n D**2)."""
    counts = value_counts(items, keys, value).filter(F.col("v") >= xmin)
    w = Window.partitionBy(*keys)
    rows = counts.select(*keys, "v", "c", F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(w).alias("n"), F.sum(F.col("c") * F.ln(F.col("v") / xmin)).over(w).alias("s"))
    rows = rows.withColumn("alpha", F.when(F.col("s") > 0, 1 + F.col("n") / F.col("s")).otherwise(0.0))
    model = 1 - F.pow(F.col("v") / xmin, 1 - F.col("alpha"))
    first = (F.col("upto") - F.col("c") + 1) / F.col("n")
    gap = F.greatest(F.abs(F.col("upto") / F.col("n") - model), F.abs(first - model))
    d = rows.groupBy(*keys).agg(F.first("n").alias("n"), F.first("alpha").alias("alpha"), F.max(gap).alias("d"))
    return d.select(*keys, "n", F.round("alpha", 6).alias("alpha"), F.round("d", 6).alias("ks"), F.round(F.exp(-2 * F.col("n") * F.col("d") * F.col("d")), 6).alias("p_value"))


def xmin_scan(items: DataFrame, keys: list[str], value: str, candidates: int = 50, least_tail: int = 5) -> DataFrame:
    """The xmin with the smallest KS distance among the first `candidates` distinct values of the lower half.

    Candidates are bounded per group, so the range join multiplies the distinct values by a constant at most.
    """
    counts = value_counts(items, keys, value)
    w = Window.partitionBy(*keys).orderBy("v")
    ranked = counts.select(*keys, "v", "c", F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("k"))
    cand = ranked.filter((F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("k") / 2))) & (F.col("r") <= candidates)).select(*keys, F.col("v").alias("xmin"))
    j = ranked.select(*keys, "v", "c").join(cand, keys).filter(F.col("v") >= F.col("xmin"))
    w2 = Window.partitionBy(*keys, "xmin")
    rows = j.select(*keys, "xmin", "v", "c", F.sum("c").over(w2.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(w2).alias("n"), F.sum(F.col("c") * F.ln(F.col("v") / F.col("xmin"))).over(w2).alias("s"))
    rows = rows.filter((F.col("n") >= least_tail) & (F.col("s") > 0)).withColumn("alpha", 1 + F.col("n") / F.col("s"))
    model = 1 - F.pow(F.col("v") / F.col("xmin"), 1 - F.col("alpha"))
    gap = F.greatest(F.abs(F.col("upto") / F.col("n") - model), F.abs((F.col("upto") - F.col("c") + 1) / F.col("n") - model))
    d = rows.groupBy(*keys, "xmin").agg(F.first("n").alias("n"), F.first("alpha").alias("alpha"), F.round(F.max(gap), 6).alias("ks"))
    best = d.groupBy(*keys).agg(F.min(F.struct("ks", "xmin", "n", "alpha")).alias("b"))
    return best.select(*keys, F.col("b.xmin").alias("xmin"), F.col("b.n").alias("n_tail"), F.round("b.alpha", 6).alias("alpha"), F.col("b.ks").alias("ks"))


def loglog_r2(items: DataFrame, keys: list[str], value: str, alpha: float) -> DataFrame:
    """Fit of ln(count) on ln(integer value) with the slope fixed at -alpha."""
    c = items.filter(F.col(value) >= 1).groupBy(*keys, F.floor(value).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    x, y = F.ln("v"), F.ln("c")
    a = c.groupBy(*keys).agg(F.avg(y + alpha * x).alias("b"), F.avg(y).alias("m"))
    rows = c.join(a, keys)
    res, tot = F.sum(F.pow(y - (F.col("b") - alpha * x), 2)), F.sum(F.pow(y - F.col("m"), 2))
    return rows.groupBy(*keys).agg(F.round(F.when(tot > 0, F.greatest(F.lit(0.0), 1 - res / tot)).otherwise(0.0), 6).alias("r_squared"))


def compare_distributions(items: DataFrame, keys: list[str], value: str, xmin: float) -> DataFrame:
    """Log-likelihoods of power law, exponential and lognormal, and the best of them."""
    import math

    v = items.filter(F.col(value) >= xmin).select(*keys, F.col(value).cast("double").alias("v")).withColumn("l", F.ln("v"))
    a = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("sl"), F.avg("v").alias("m"), F.sum("v").alias("s"), F.avg("l").alias("ml"), F.var_pop("l").alias("vl"))
    a = a.filter((F.col("vl") > 0) & (F.col("m") > 0))
    s = F.col("sl") - F.col("n") * math.log(xmin)
    alpha = 1 + F.col("n") / s
    power = F.col("n") * F.ln((alpha - 1) / xmin) - alpha * s
    expo = -F.col("n") * F.ln("m") - F.col("s") / F.col("m")
    logn = -F.col("sl") - F.col("n") / 2 * F.ln(2 * math.pi * F.col("vl")) - F.col("n") / 2
    out = a.select(*keys, F.round(power, 4).alias("power_law"), F.round(expo, 4).alias("exponential"), F.round(logn, 4).alias("lognormal"))
    best = F.greatest("power_law", "exponential", "lognormal")
    return out.withColumn("best", F.when(F.col("power_law") == best, "power_law").when(F.col("exponential") == best, "exponential").otherwise("lognormal"))


def hill(items: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Hill estimator with the k = floor(sqrt(n)) largest values over the next one: k / sum(ln(x_i / x_(k+1)))."""
    rows = items.filter(F.col(value) > 0).select(*keys, F.col(value).cast("double").alias("v"))
    w = Window.partitionBy(*keys)
    counts = rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    r = counts.select(*keys, "v", "c", F.coalesce(F.sum("c").over(w.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"), F.sum("c").over(w).alias("n")).withColumn("k", F.floor(F.sqrt("n")))
    at = F.max(F.when((F.col("above") <= F.col("k")) & (F.col("k") < F.col("above") + F.col("c")), F.col("v")))
    used = F.greatest(F.lit(0), F.least("c", F.col("k") - F.col("above")))
    g = r.groupBy(*keys).agg(F.first("k").alias("k"), at.alias("x"), F.sum(used * F.ln("v")).alias("sl"))
    s = F.col("sl") - F.col("k") * F.ln("x")
    return g.select(*keys, F.col("k").cast("long").alias("k"), F.round(F.when(s > 0, F.col("k") / s).otherwise(0.0), 6).alias("hill"))


def tail_metrics(items: DataFrame, keys: list[str], value: str, quantile: float = 0.9) -> DataFrame:
    """Excess kurtosis, mean excess over the order statistic floor(q n) (from 0), and heavy, moderate or light."""
    rows = items.select(*keys, F.col(value).cast("double").alias("v"))
    w = Window.partitionBy(*keys)
    counts = rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    r = counts.select(*keys, "v", "c", F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(w).alias("n"))
    threshold = r.filter((F.col("upto") > F.floor(F.col("n") * quantile)) & (F.col("upto") - F.col("c") <= F.floor(F.col("n") * quantile))).select(*keys, F.col("v").alias("u"))
    over = counts.join(threshold, keys).filter(F.col("v") > F.col("u")).groupBy(*keys).agg((F.sum(F.col("c") * (F.col("v") - F.col("u"))) / F.sum("c")).alias("e"))
    k = rows.groupBy(*keys).agg(F.kurtosis("v").alias("k"))
    out = k.join(over, keys, "left").select(*keys, F.round("k", 4).alias("kurtosis"), F.round(F.coalesce("e", F.lit(0.0)), 4).alias("mean_excess"))
    return out.withColumn("tail", F.when(F.col("kurtosis") > 3, "heavy").when(F.col("kurtosis") > 0, "moderate").otherwise("light"))


#: Running totals over values go in so many stretches of values.
STRETCHES = 1024


def running_total(counts: DataFrame, keys: list[str], value: str, count: str, total: str) -> DataFrame:
    """counts with the sum of `count` up to each row's value within its keys: sums of stretches of values first, then
    within the stretches, so that no window spans more than a stretch or the stretches' sums (STRETCHES rows a key, broadcast:
    for few keys)."""
    ends = counts.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    at = F.least(F.lit(STRETCHES - 1), F.floor((F.col(value) - F.col("__lo")) * STRETCHES / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))))
    rows = counts.crossJoin(F.broadcast(ends)).withColumn("__at", F.coalesce(at, F.lit(0))).drop("__lo", "__hi")
    w = Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys, "__at").agg(F.sum(count).alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(w), F.lit(0)))
    inside = F.sum(count).over(Window.partitionBy(*keys, "__at").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__inside", inside).join(F.broadcast(before.drop("__sum")), [*keys, "__at"]).withColumn(total, F.col("__before") + F.col("__inside")).drop("__at", "__before", "__inside")


def outliers(items: DataFrame, value: str, threshold: float = 3.0) -> DataFrame:
    """Rows whose z-score over all rows exceeds the threshold, with their percentile rank (ties take the highest).

    Mean and deviation come from one aggregate; ranks from value counts, so no window spans all rows.
    """
    m = items.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n"))
    far = items.crossJoin(F.broadcast(m)).filter((F.col("sd") > 0) & (F.abs(F.col(value) - F.col("m")) > threshold * F.col("sd")))
    below = items.select(F.col(value).alias("x")).crossJoin(F.broadcast(m.select("m", "sd"))).filter(F.abs(F.col("x") - F.col("m")) <= threshold * F.col("sd")).agg(F.count(F.lit(1)).alias("inner"))
    counts = far.groupBy(value, "m").agg(F.count(F.lit(1)).alias("c"))
    side = F.col(value) > F.col("m")
    ranked = running_total(counts.withColumn("__side", side), ["__side"], value, "c", "cum")
    low = counts.filter(~side).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("low"))
    upto = ranked.crossJoin(F.broadcast(below)).crossJoin(F.broadcast(low)).select(F.col(value).alias("__v"), F.when(side, F.col("cum") + F.col("inner") + F.col("low")).otherwise(F.col("cum")).alias("upto"))
    return far.join(upto, F.col(value) == F.col("__v")).withColumn("z", F.round((F.col(value) - F.col("m")) / F.col("sd"), 4)).withColumn("percentile", F.round(F.col("upto") * 100 / F.col("n"), 4)).drop("m", "sd", "n", "__v", "upto")


#: Rows of one value are numbered in runs of so many.
RUN = 10_000


def scaling_breaks(items: DataFrame, keys: list[str], value: str, least: int = 20) -> DataFrame:
    """Split points of the sorted values (`least` away from the ends) where the exponents of both sides differ by more than
    mean + 2 deviations of all splits.

    Sums of ln v over the least value (from below) and under the split's (from above) are taken over value counts, so that
    what equal values add is 0 and not the rounding of long sums, which the exponents would divide by.
    """
    w = Window.partitionBy(*keys)
    up, down = (w.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("v"), F.desc("v")))
    counts = items.filter(F.col(value) > 0).select(*keys, F.col(value).cast("double").alias("v")).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    r = counts.withColumns({"rise": F.ln("v") - F.ln(F.min("v").over(w)), "fall": F.ln(F.max("v").over(w)) - F.ln("v"), "n": F.sum("c").over(w), "below": F.coalesce(F.sum("c").over(up), F.lit(0))})
    r = r.withColumns({"left": F.coalesce(F.sum(F.col("c") * F.col("rise")).over(up), F.lit(0.0)), "above": F.coalesce(F.sum(F.col("c") * F.col("fall")).over(down), F.lit(0.0))})
    runs = r.repartition(*keys, "v").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("c") - 1, F.lit(RUN))))
    i = F.explode(F.sequence(F.col("below") + F.col("at"), F.col("below") + F.least("c", F.col("at") + RUN) - 1))
    r = runs.withColumn("i", i).filter((F.col("i") >= least) & (F.col("i") < F.col("n") - least))
    sl = F.col("left") + (F.col("i") - F.col("below")) * F.col("rise")
    sr = (F.col("n") - F.col("below") - F.col("c")) * F.col("fall") - F.col("above")
    gap = F.abs(F.when(sl > 1e-12, 1 + F.col("i") / sl).otherwise(0.0) - F.when(sr > 1e-12, 1 + (F.col("n") - F.col("i")) / sr).otherwise(0.0))
    d = r.select(*keys, "i", "v", gap.alias("__gap"))
    limit = d.groupBy(*keys).agg((F.avg("__gap") + 2 * F.stddev_pop("__gap")).alias("limit"))
    return d.join(limit, keys).filter(F.col("__gap") > F.col("limit")).select(*keys, F.col("i").cast("long").alias("split"), F.col("v").alias("value"), F.round("__gap", 4).alias("alpha_gap"))


def entropy(items: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Shannon entropy in bits of a category per group."""
    c = items.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("__c"))
    total = c.groupBy(*keys).agg(F.sum("__c").alias("n"), F.sum(F.col("__c") * F.log2("__c")).alias("s"))
    return total.select(*keys, F.round(F.log2("n") - F.col("s") / F.col("n"), 6).alias("entropy"))


def regression(items: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Slope and intercept of y on x per group; without variance the slope is 0 and the intercept the mean."""
    g = items.groupBy(*keys).agg(F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), F.avg(y).alias("m"))
    return g.select(*keys, F.round(F.coalesce("s", F.lit(0.0)), 6).alias("slope"), F.round(F.coalesce("i", "m"), 6).alias("intercept"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance in km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
