"""Pairs from shared items: co-occurrence, coupling, similarity and linkage joins. All go through the shared item (an
inverted index), never through a cross join; candidates are cut by frequency where the operator's definition does so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from .graph import components

#: Up to so many keys with their classes (16 bytes each) may be broadcast; so many pairs of classes are one task.
BROADCAST_KEYS, PAIRS_IN_PARTITION = 500_000, 4_000


def cooccurrence(items: DataFrame, group: str, item: str, least_weight: int = 2, top: int | None = None, least_freq: int = 1) -> DataFrame:
    """(a, b, weight), a < b: items that share at least least_weight groups; only the `top` most frequent ones, ties by
    the item, that occur in least_freq groups at least.

    The top list is a bounded broadcast, and with one a group's set is bounded too, so pairs are made within rows. Without
    one, groups meet themselves in a join, which is quadratic in a group's size by nature.
    """
    rows = items.select(F.col(group).alias("g"), F.col(item).alias("x")).distinct()
    if top or least_freq > 1:
        freq = rows.groupBy("x").agg(F.count(F.lit(1)).alias("f")).filter(F.col("f") >= least_freq)
        if top:
            freq = F.broadcast(freq.orderBy(F.desc("f"), "x").limit(top).select("x"))
        rows = rows.join(freq.select("x"), "x", "left_semi")
    if top:
        sets = rows.groupBy("g").agg(F.sort_array(F.collect_set("x")).alias("s")).filter(F.size("s") > 1)
        pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.lit(top)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
        return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= least_weight)
    left, right = rows.select("g", F.col("x").alias("a")), rows.select("g", F.col("x").alias("b"))
    return left.join(right, "g").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= least_weight)


def shared_neighbours(items: DataFrame, group: str, item: str, detail: Column | None = None) -> DataFrame:
    """(a, b, weight, first, last): co-members of groups with the range of `detail` over the shared groups."""
    rows = items.select(F.col(group).alias("g"), F.col(item).alias("x"), (detail if detail is not None else F.lit(0)).alias("d")).distinct()
    pairs = rows.select("g", "d", F.col("x").alias("a")).join(rows.select("g", F.col("x").alias("b")), "g").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"), F.min("d").alias("first"), F.max("d").alias("last"))


def _token_sets(tokens: DataFrame, key: str, token: str) -> DataFrame:
    """(k, s, n): each key's distinct tokens in order of rising frequency, and their number."""
    rows = tokens.select(F.col(key).alias("k"), F.col(token).alias("t")).distinct()
    freq = rows.groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    ranked = rows.join(freq, "t").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("s"))
    return checkpointed(ranked.select("k", F.transform("s", lambda x: x["t"]).alias("s"), F.size("s").alias("n")))


def _classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (k, c) with the smallest key of those that have their set, and sets (k, s, n) of these."""
    sets = sets.filter("k IS NOT NULL")
    one = checkpointed(sets.groupBy("s", "n").agg(F.min("k").alias("k")).select("k", "s", "n"))
    return checkpointed(sets.join(one.select(F.col("k").alias("c"), "s"), "s").select("k", "c")), one


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    return sets.select("k", "n", F.explode(F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))).alias("t"))


def _confirmed(found: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, shared, jaccard) of the found (a, b) with at least that similarity, by their whole sets."""
    joined = found.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    out = joined.select("a", "b", shared.cast("long").alias("shared"), (shared / (F.col("na") + F.col("nb") - shared)).alias("j"))
    return out.filter(F.col("j") >= least).select("a", "b", "shared", F.round("j", 8).alias("jaccard"))


def jaccard_pairs(tokens: DataFrame, key: str, token: str, least: float, most_groups: int | None = None) -> DataFrame:
    """(a, b, shared, jaccard) of keys whose token sets have at least that similarity.

    Keys of equal sets are one class; classes are compared once, and pairs of members made last, from the similar classes.

    Prefix filtering: with tokens in order of rising frequency, two sets of Jaccard t share one of the first
    n - ceil(t n) + 1 tokens of either, so only those are joined; exact sets are then compared as arrays.
    """
    members, sets = _classes(_token_sets(tokens, key, token))
    prefix = _prefixes(sets, least)
    a, b = prefix.select(F.col("k").alias("a"), F.col("n").alias("na"), "t"), prefix.select(F.col("k").alias("b"), F.col("n").alias("nb"), "t")
    found = a.join(b, "t").filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least)).select("a", "b").distinct()
    same = sets.select(F.col("k").alias("a"), F.col("k").alias("b"), F.col("n").cast("long").alias("shared"), F.lit(1.0).alias("jaccard"))
    similar = checkpointed(_confirmed(found, sets, least).unionByName(same))
    left, right = members.select("k", F.col("c").alias("a")), members.select(F.col("k").alias("l"), F.col("c").alias("b"))
    if members.count() <= BROADCAST_KEYS:  # no pair of members then goes through a shuffle; the classes' pairs are dealt out before they multiply
        similar, left, right = similar.repartition(1 + similar.count() // PAIRS_IN_PARTITION, "a", "b"), F.broadcast(left), F.broadcast(right)
    pairs = similar.join(left, "a").join(right, "b").filter((F.col("a") < F.col("b")) | (F.col("k") < F.col("l")))
    return pairs.select(F.least("k", "l").alias("a"), F.greatest("k", "l").alias("b"), "shared", "jaccard")


def jaccard_components(tokens: DataFrame, key: str, token: str, least: float) -> DataFrame:
    """(node, component) of the keys that jaccard_pairs links with any, by the smallest key reachable; no pair of keys is made.

    Classes of equal sets are linked with one class of each of their prefix tokens before anything else, drawn by hash: the
    smallest ones are one for many tokens, and unlike larger sets. What is then compared are pairs that this leaves in
    different components: of each token, the classes outside of its largest component with all of its classes.
    """
    members, sets = _classes(_token_sets(tokens, key, token))
    prefix = checkpointed(_prefixes(sets, least))
    fits = F.least("na", "nb") >= F.greatest("na", "nb") * least
    pivot = prefix.groupBy("t").agg(F.min(F.struct(F.xxhash64("k", "t"), "n", "k")).alias("p")).select("t", F.col("p.k").alias("b"), F.col("p.n").alias("nb"))
    first = prefix.select(F.col("k").alias("a"), F.col("n").alias("na"), "t").join(pivot, "t").filter((F.col("a") != F.col("b")) & fits)
    links = checkpointed(_confirmed(first.select("a", "b").distinct(), sets, least).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    known = components(links)
    rows = checkpointed(prefix.join(known.withColumnRenamed("node", "k"), "k", "left").withColumn("component", F.coalesce("component", "k")))
    main = rows.groupBy("t", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("t").agg(F.max(F.struct("m", "component")).alias("p")).select("t", F.col("p.component").alias("main"))
    outside = rows.join(main, "t").filter("component <> main").select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), "t")
    across = outside.join(rows.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), "t"), "t").filter((F.col("ca") != F.col("cb")) & fits)
    found = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = _confirmed(found, sets, least).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    stars = members.filter("k <> c").select(F.col("c").alias("src"), F.col("k").alias("dst"))
    return components(known.select(F.col("component").alias("src"), F.col("node").alias("dst")).unionByName(more).unionByName(stars))


def linkage(records: DataFrame, block: str, key: str, signals: list[tuple[str, float]], least: float = 0.6, sure: str | None = None) -> DataFrame:
    """(a, b, score): records of a block whose equal signals weigh enough, or that share the non-null column `sure`."""
    columns = [c for c, _ in signals] + ([sure] if sure else [])
    left = records.select(block, F.col(key).alias("a"), *(F.col(c).alias(f"l_{c}") for c in columns))
    right = records.select(block, F.col(key).alias("b"), *(F.col(c).alias(f"r_{c}") for c in columns))
    score = sum((F.when(F.col(f"l_{c}") == F.col(f"r_{c}"), F.lit(w)).otherwise(F.lit(0.0)) for c, w in signals), F.lit(0.0))
    pairs = left.join(right, block).filter("a < b").withColumn("score", F.round(score, 6))
    same = F.coalesce(F.col(f"l_{sure}") == F.col(f"r_{sure}"), F.lit(False)) if sure else F.lit(False)
    return pairs.filter((F.col("score") >= least) | same).select("a", "b", "score")


def ring_owner(keys: DataFrame, key: str, node_names: list[str], virtual: int = 150) -> DataFrame:
    """(key, position, node) on a consistent-hash ring: the first virtual node strictly after the key's md5 position, or the
    first of all. The ring has len(node_names) * virtual points, a bounded array in the plan, searched by bisection."""
    import hashlib

    points = sorted((int(hashlib.md5(f"{n}:{i}".encode()).hexdigest()[:8], 16), n) for n in node_names for i in range(virtual))
    at = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    spark = keys.sparkSession
    bounds = [p for p, _ in points]
    ranges = [(-1, bounds[0], points[0][1])] + [(lo, hi, points[i + 1][1]) for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])) if hi > lo] + [(bounds[-1], 1 << 33, points[0][1])]
    table = F.broadcast(spark.createDataFrame(ranges, "lo long, hi long, node string"))
    # a coarse slot per range turns the interval lookup into an equi-join
    slots = 1 << 10
    width = (1 << 32) // slots
    table = table.withColumn("slot", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col("lo") / width)).cast("long"), F.least(F.lit(slots), F.floor(F.col("hi") / width)).cast("long"))))
    rows = keys.withColumn("position", at).withColumn("slot", F.floor(F.col("position") / width).cast("long"))
    return rows.join(F.broadcast(table), "slot").filter((F.col("position") >= F.col("lo")) & (F.col("position") < F.col("hi"))).drop("slot", "lo", "hi")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with `status`: matched or missing in right (an equi-join; right's keys are made distinct first)."""
    have = right.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return left.join(have, keys, "left").withColumn("status", F.when(F.col("__hit"), "matched").otherwise("missing_ref")).drop("__hit")


def federated_dedup(papers: DataFrame, priority: Column, doi: str = "doi", title: str = "title") -> DataFrame:
    """Two-stage dedup of a union of sources: by case-folded DOI, else by normalised title.

    The row of the first source stays (then the smallest id), with the largest citation count and the first non-empty
    abstract of its group. A row without DOI is not matched with one that has it.
    """
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    has = F.coalesce(F.trim(F.col(doi)), F.lit("")) != ""
    key = F.when(has, F.concat(F.lit("d:"), F.lower(F.trim(F.col(doi))))).otherwise(F.concat(F.lit("t:"), norm))
    rows = papers.withColumn("__key", key).withColumn("__p", priority)
    order = F.struct("__p", "paper_id")
    full = F.when(F.coalesce("abstract", F.lit("")) != "", F.struct("__p", "paper_id", "abstract"))
    g = rows.groupBy("__key").agg(F.min(F.struct(order.alias("o"), F.struct(doi, title, "source_api").alias("r"))).alias("b"), F.max("citation_count").alias("citation_count"), F.min(full).alias("f"), F.count(F.lit(1)).alias("n_sources"))
    return g.select(F.col("b.o.paper_id").alias("paper_id"), F.col(f"b.r.{doi}").alias("doi"), F.col(f"b.r.{title}").alias("title"), F.col("b.r.source_api").alias("source_api"), "citation_count", F.coalesce("f.abstract", F.lit("")).alias("abstract"), "n_sources")


def rank_score(citations: Column, age: Column) -> Column:
    """0.6 min(citations / 100, 10) + 0.4 max(0, 1 - age / 20)."""
    return 0.6 * F.least(citations / 100, F.lit(10.0)) + 0.4 * F.greatest(F.lit(0.0), 1 - age / 20)


def latest_version(versions: DataFrame, key: str, version: str) -> DataFrame:
    """The row's version that is largest by its numbers, not its text, per key."""
    parts = F.transform(F.split(version, r"\."), lambda x: x.try_cast("int"))
    return versions.groupBy(key).agg(F.max_by(version, parts).alias(version))
