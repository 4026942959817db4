"""Explanations of scores that are expressions of their features: Shapley values, counterfactuals, confidence; isolation forests."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A score as a function from feature columns by name to a column.
Score = Callable[[dict[str, Column]], Column]


def shapley(rows: DataFrame, key: str, features: list[str], score: Score, background: DataFrame | None = None) -> DataFrame:
    """(key, feature, value, contribution, direction): exact Shapley values of score against the background's mean values.

    All coalitions of the features are evaluated in the row (2 ** features expressions, so for up to ten features); a feature out of a
    coalition has its mean. Contributions sum to the score less the score of the means. Without a background the value
    itself counts, and its side of 0.5 is the direction.
    """
    if background is None:
        parts = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.col(f).cast("double").alias("contribution")) for f in features]
        side = F.col("contribution") - 0.5
        out = rows.select(key, F.explode(F.array(*parts)).alias("x")).select(key, "x.*")
        return out.withColumn("direction", F.when(side > 0, "positive").when(side < 0, "negative").otherwise("neutral"))
    if len(features) > 10:
        raise ValueError("exact Shapley values need at most ten features")
    means = background.agg(*(F.avg(f).alias(f"__mean_{f}") for f in features))
    wide = rows.crossJoin(F.broadcast(means))
    worth = {s: f"__worth_{'_'.join(map(str, s))}" for n in range(len(features) + 1) for s in combinations(range(len(features)), n)}
    wide = wide.withColumns({name: score({f: F.col(f).cast("double") if k in s else F.col(f"__mean_{f}") for k, f in enumerate(features)}) for s, name in worth.items()})
    parts = []
    for k, f in enumerate(features):
        terms = [(F.col(worth[tuple(sorted((*s, k)))]) - F.col(name)) / (len(features) * comb(len(features) - 1, len(s))) for s, name in worth.items() if k not in s]
        parts.append(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.round(reduce(lambda a, b: a + b, terms), 8).alias("contribution")))
    out = wide.select(key, F.explode(F.array(*parts)).alias("x")).select(key, "x.*")
    return out.withColumn("direction", F.when(F.col("contribution") > 0, "positive").when(F.col("contribution") < 0, "negative").otherwise("neutral"))


def counterfactual(rows: DataFrame, key: str, features: list[str], ranges: dict[str, tuple[float, float]], predict: Score, target: object) -> DataFrame:
    """(key, feature, value, changed): the first change of one feature that makes predict the target, for rows where there is one.

    Features are tried in order; candidates are the ends and middle of a feature's range, or 0, 0.5, 1, half and one and a
    half times its value. Several features are never changed at once.
    """
    tries = []
    for f in features:
        x = F.col(f).cast("double")
        if f in ranges:
            low, high = ranges[f]
            values = [F.lit(float(low)), F.lit(float(high)), F.lit((low + high) / 2)]
        else:
            values = [F.lit(0.0), F.lit(0.5), F.lit(1.0), x * 0.5, x * 1.5]
        for v in values:
            hit = predict({g: v if g == f else F.col(g).cast("double") for g in features}) == F.lit(target)
            tries.append(F.when(hit, F.struct(F.lit(f).alias("feature"), x.alias("value"), v.alias("changed"))))
    return rows.select(key, F.coalesce(*tries).alias("x")).filter("x IS NOT NULL").select(key, "x.*")


def confidence(model: Column, quality: Column, reliability: Column) -> Column:
    """struct(overall, sources): 0.5 of the model's confidence, 0.3 of the data's quality, 0.2 of past accuracy (0.8 if null)."""
    overall = 0.5 * model + 0.3 * quality + 0.2 * F.coalesce(reliability, F.lit(0.8))
    sources = F.array_compact(F.array(F.when(model < 0.7, "low model confidence"), F.when(quality < 0.7, "low data quality"), F.when(reliability < 0.8, "limited past accuracy")))
    return F.struct(overall.alias("overall"), sources.alias("sources"))


#: An isolation forest has so many trees, each of a sample of so many rows; so large a share counts as anomalous.
TREES, SAMPLE, CONTAMINATION = 100, 256, 0.1


def isolation_forest(items: DataFrame, key: str, features: list[str], seed: int = 42, contamination: float = CONTAMINATION) -> DataFrame:
    """(key, anomaly): probability 1 / (1 + exp(5 d)), d being how much less a row is isolated than the contamination's quantile.

    Trees are grown on the driver from one sample of at most TREES * SAMPLE rows (those of the smallest hashes), which is
    what the method asks for; scoring is row by row in Arrow batches. Nulls count as 0.
    """
    import numpy as np
    import pandas as pd

    values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    rows = items.select(F.col(key), *values)
    total = rows.count()
    share = min(1.0, 2 * TREES * SAMPLE / max(total, 1))
    sample = rows.select(F.xxhash64(F.lit(seed), key).alias("__h"), *features).filter(F.pmod("__h", F.lit(1 << 20)) < int(share * (1 << 20))).orderBy("__h").limit(TREES * SAMPLE).toPandas()[features].to_numpy()
    rng = np.random.RandomState(seed)

    def depth_left(n):
        return 0.0 if n <= 1 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0

    trees, top = [], int(np.ceil(np.log2(max(2, min(SAMPLE, len(sample))))))
    for t in range(TREES if len(sample) else 0):
        x = sample[rng.permutation(len(sample))[:SAMPLE]]
        nodes = []  # (feature, cut, left, right) or (-1, depth, 0, 0)

        def grow(x, depth):
            at = len(nodes)
            nodes.append(None)
            wide = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) else []
            if depth >= top or len(x) <= 1 or not len(wide):
                nodes[at] = (-1, depth + depth_left(len(x)), 0, 0)
                return at
            f = int(rng.choice(wide))
            cut = rng.uniform(x[:, f].min(), x[:, f].max())
            left, right = grow(x[x[:, f] < cut], depth + 1), grow(x[x[:, f] >= cut], depth + 1)
            nodes[at] = (f, cut, left, right)
            return at

        grow(x, 0)
        trees.append(np.array(nodes, dtype=float))

    def scores(x):
        deep = np.zeros(len(x))
        for tree in trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = tree[at, 0] >= 0
                if not inner.any():
                    break
                f = tree[at[inner], 0].astype(int)
                at[inner] = np.where(x[inner, f] < tree[at[inner], 1], tree[at[inner], 2], tree[at[inner], 3]).astype(np.int64)
            deep += tree[at, 1]
        return -(2.0 ** -(deep / max(len(trees), 1) / max(depth_left(min(SAMPLE, len(sample))), 1e-9)))

    offset = float(np.quantile(scores(sample), contamination)) if len(sample) else 0.0

    def score(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "anomaly": np.round(1 / (1 + np.exp(5 * (scores(pdf[features].to_numpy()) - offset))), 6)})

    return rows.mapInPandas(score, f"{key} {dict(rows.dtypes)[key]}, anomaly double")
