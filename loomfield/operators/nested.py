"""Nested payloads, registries and fused features."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def find_key(key: str, depth: int = 10, items: int = 10):
    """A vectorised function from JSON text to the JSON of the first value under key, at most so deep and so many list items in."""

    def search(x, left: int):
        if left < 0:
            return None
        if isinstance(x, dict):
            if key in x:
                return x[key]
            children = x.values()
        elif isinstance(x, list):
            children = x[:items]
        else:
            return None
        for c in children:
            found = search(c, left - 1)
            if found is not None:
                return found
        return None

    @F.pandas_udf("string")
    def run(bodies: pd.Series) -> pd.Series:
        def one(text):
            try:
                found = search(json.loads(text), depth)
            except (TypeError, ValueError):
                return None
            return None if found is None else json.dumps(found)

        return bodies.map(one)

    return run


def highlights(payloads: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Reels (reel_id, title, n_items) and their items (reel_id, item_id, media_type) of a tray payload."""
    schema = "struct<tray:array<struct<id:string,title:string,items:array<struct<id:string,media_type:int>>>>>"
    reels = payloads.select(F.explode(F.from_json(body, schema)["tray"]).alias("r"))
    parents = reels.select(F.col("r.id").alias("reel_id"), F.col("r.title").alias("title"), F.coalesce(F.size("r.items"), F.lit(0)).alias("n_items"))
    kind = F.when(F.col("i.media_type") == 2, "video").when(F.col("i.media_type") == 8, "carousel").otherwise("image")
    return parents, reels.select(F.col("r.id").alias("reel_id"), F.explode("r.items").alias("i")).select("reel_id", F.col("i.id").alias("item_id"), kind.alias("media_type"))


def discovered_ids(pages: DataFrame, pattern: str, text: str, seen_at: str, now: Column, days: int = 7) -> DataFrame:
    """(name, id): ids that a two-group pattern finds, the latest per name, unless it is older than the days of its life."""
    hit = pages.select(seen_at, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("m"))
    rows = hit.select(F.regexp_extract("m", pattern, 1).alias("name"), F.regexp_extract("m", pattern, 2).alias("id"), seen_at)
    last = rows.groupBy("name").agg(F.max_by("id", F.struct(seen_at, "id")).alias("id"), F.max(seen_at).alias("seen"))
    return last.filter(F.col("seen") >= now - F.expr(f"INTERVAL {days} DAYS")).select("name", "id")


def expertise(cosines: DataFrame, jaccards: DataFrame, keys: list[str]) -> DataFrame:
    """0.7 of the texts' cosine plus 0.3 of the keywords' Jaccard similarity; a missing side is 0."""
    j = cosines.join(jaccards, keys, "full_outer")
    return j.select(*keys, F.round(0.7 * F.coalesce("cosine", F.lit(0.0)) + 0.3 * F.coalesce("jaccard", F.lit(0.0)), 8).alias("expertise"))


def late_fusion(scores: DataFrame, key: str) -> DataFrame:
    """(key, fused): mean of modality scores weighted by confidence, the plain mean where all confidences are 0."""
    w = F.sum("confidence")
    return scores.groupBy(key).agg(F.round(F.when(w > 0, F.sum(F.col("score") * F.col("confidence")) / w).otherwise(F.avg("score")), 6).alias("fused"), F.count(F.lit(1)).alias("n_modalities"))


def early_fusion(parts: dict[str, tuple[Column, Column]]) -> Column:
    """struct(features, confidence, correlations, consistency, insights) of modalities (features, confidence) by name.

    Features are joined end to end; confidence is the plain mean. A correlation is the cosine of two modalities over the
    length they share (0 if one is zero); consistency is their mean (1 for a single modality).
    """
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)

    names = list(parts)
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    cosines = []
    for a, b in pairs:
        n = F.least(F.size(parts[a][0]), F.size(parts[b][0]))
        x, y = F.slice(parts[a][0], F.lit(1), n), F.slice(parts[b][0], F.lit(1), n)
        size = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
        cosines.append(F.when(size > 0, dot(x, y) / size).otherwise(0.0))
    alone = "all modalities" if len(names) == 3 else f"only {names[0]}" if len(names) == 1 else None
    weak = F.array_join(F.array_compact(F.array(*(F.when(parts[n][1] < 0.5, F.lit(n)) for n in names))), ", ")
    insights = F.array_compact(F.array(
        F.lit(alone).cast("string"), *(F.when(c > 0.8, F.lit(f"high consistency: {a}, {b}")).when(c < 0.3, F.lit(f"low consistency: {a}, {b}")) for (a, b), c in zip(pairs, cosines, strict=True)),
        F.when(weak != "", F.concat(F.lit("low confidence: "), weak))))
    mean = sum((parts[n][1] for n in names), F.lit(0.0)) / len(names)
    consistency = sum(cosines, F.lit(0.0)) / len(pairs) if pairs else F.lit(1.0)
    return F.struct(F.concat(*(parts[n][0] for n in names)).alias("features"), mean.alias("confidence"), F.array(*cosines).cast("array<double>").alias("correlations"), consistency.alias("consistency"), insights.alias("insights"))


def padded(values: Column, size: int = 64) -> Column:
    """An array cut or filled with zeros to a size."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), size)), 1, size)


def active_versions(log: DataFrame, name: str = "model", order: str = "at") -> DataFrame:
    """(name, version, previous): the version last promoted or rolled back to, and the one before it."""
    moves = log.filter(F.col("action").isin("promote", "rollback"))
    w = Window.partitionBy(name).orderBy(F.desc(order))
    rows = moves.withColumn("previous", F.lead("version").over(w)).withColumn("__r", F.row_number().over(w))
    return rows.filter(F.col("__r") == 1).select(name, "version", "previous")


def preorder(tree: DataFrame, depth: int) -> DataFrame:
    """(cascade_id, node, position): depth-first order of (cascade_id, node, parent, depth), siblings by name; positions are
    counted from subtree sizes, level by level, so no window spans a tree."""
    from .graph import downstream_reach

    size = downstream_reach(tree, depth).select("node", (F.col("reach") + 1).alias("size"))
    rows = tree.join(size, "node")
    w = Window.partitionBy("cascade_id", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))
    at = rows.filter("depth = 0").select("cascade_id", "node", F.lit(0).cast("long").alias("position"))
    out = at
    for level in range(1, depth + 1):
        at = rows.filter(F.col("depth") == level).join(at.select("cascade_id", F.col("node").alias("parent"), F.col("position").alias("p")), ["cascade_id", "parent"]).select("cascade_id", "node", (F.col("p") + 1 + F.col("before")).alias("position"))
        out = out.unionByName(at)
    return out
