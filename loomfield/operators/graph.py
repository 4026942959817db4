"""Graph operators over edge tables (src, dst). Iterative ones loop over joins and aggregations, with lineage cut by
reliable checkpoints; the driver holds a loop counter and single counts, never vertices or edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import checkpointed


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, without loops and repeats."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.filter("src <> dst").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree, centrality): neighbours of the undirected graph, and their share of all other nodes."""
    both = undirected(edges)
    n = nodes(edges).agg(F.count(F.lit(1)).alias("n"))
    d = both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return d.crossJoin(F.broadcast(n)).select("node", "degree", F.round(F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0), 8).alias("centrality"))


def density(edges: DataFrame) -> DataFrame:
    """Nodes, edges, and density of the directed and of the undirected graph."""
    n = nodes(edges).agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("n_edges"))
    u = undirected(edges).agg((F.count(F.lit(1)) / 2).cast("long").alias("n_links"))
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return n.crossJoin(e).crossJoin(u).select("n_nodes", "n_edges", "n_links", F.round(F.col("n_edges") / pairs, 8).alias("directed_density"), F.round(2 * F.col("n_links") / pairs, 8).alias("undirected_density"))


def bfs(edges: DataFrame, start: DataFrame, depth: int, per_node: int | None = None) -> DataFrame:
    """(node, depth, parent) of everything within `depth` steps of the start nodes (column node), starts excluded.

    parent is the smallest of the nodes of the level before that lead to it; per_node caps each node's edges by dst.
    """
    if per_node:
        edges = edges.withColumn("__r", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).filter(F.col("__r") <= per_node).drop("__r")
    seen = checkpointed(start.select("node").distinct().withColumn("depth", F.lit(0)).withColumn("parent", F.lit(None).cast(dict(edges.dtypes)["src"])))
    frontier = seen
    for level in range(1, depth + 1):
        found = frontier.select(F.col("node").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        frontier = checkpointed(found.join(seen.select("node"), "node", "left_anti").select("node", F.lit(level).alias("depth"), "parent"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def shortest_path(edges: DataFrame, a, b, longest: int = 6) -> DataFrame:
    """(step, node) of a shortest undirected path from a to b, none if there is none within `longest` steps.

    Searches from both ends by turns; levels meet half way. Of equal paths the smallest meeting node and parents count.
    """
    both = checkpointed(undirected(edges))
    spark = edges.sparkSession
    kind = dict(both.dtypes)["src"]
    one = spark.range(1)
    sides = [one.select(F.lit(x).cast(kind).alias("node"), F.array(F.lit(x).cast(kind)).alias("path")) for x in (a, b)]
    reached = [checkpointed(s) for s in sides]
    frontier = list(reached)
    meeting = None
    for turn in range(longest + 1):
        met = reached[0].join(reached[1].select("node", F.col("path").alias("back")), "node")
        found = met.orderBy(F.size("path") + F.size("back"), "node").limit(1)
        meeting = checkpointed(found)
        if not meeting.isEmpty() or turn == longest:
            break
        k = turn % 2
        grown = frontier[k].withColumnRenamed("node", "src").join(both, "src").groupBy(F.col("dst").alias("node")).agg(F.min("path").alias("before"))
        grown = grown.join(reached[k].select("node"), "node", "left_anti").select("node", F.concat("before", F.array("node")).alias("path"))
        frontier[k] = checkpointed(grown)
        reached[k] = reached[k].unionByName(frontier[k])
    whole = F.concat("path", F.slice(F.reverse("back"), 2, longest + 1))
    return meeting.select(F.posexplode(whole).alias("step", "node"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of rounds; what dangling nodes have is not passed on."""
    edges = edges.select("src", "dst").distinct()
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = checkpointed(edges.join(out, "src"))
    every = checkpointed(nodes(edges))
    n = every.count()
    rank = every.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for r in range(rounds):
        sent = links.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        rank = every.join(sent, "node", "left").select("node", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if r % 3 == 2:
            rank = checkpointed(rank)
    return rank


def label_propagation(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, label): synchronous rounds in which a node takes its neighbours' most frequent label, the smallest of ties."""
    both = checkpointed(undirected(edges))
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("c"))
        labels = checkpointed(votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct((-F.col("c")).alias("c"), "label")).alias("x")).select("node", F.col("x.label").alias("label")))
    return labels


def components(edges: DataFrame) -> DataFrame:
    """(node, component), the smallest node reachable: alternating large and small stars until nothing changes."""
    links = checkpointed(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    totals = F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    state = links.agg(*totals).first()  # stars are left as they are
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = checkpointed(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(*totals).first()
        if now == state:
            break
        state = now
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def modularity(edges: DataFrame, labels: DataFrame, variant: str = "standard") -> DataFrame:
    """Modularity of labels (node, label): per community (2 internal - degrees**2 / 2m) / 2m; `ordered_pairs` leaves the
    pairs of a node with itself out of the expected part."""
    both = undirected(edges)
    d = both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k")).join(labels, "node")
    per = d.groupBy("label").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    inside = both.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").filter("a = b").groupBy(F.col("a").alias("label")).agg(F.count(F.lit(1)).alias("inside"))
    total = both.agg(F.count(F.lit(1)).alias("mm"))
    expected = F.col("k") * F.col("k") - (F.col("kk") if variant == "ordered_pairs" else F.lit(0))
    rows = per.join(inside, "label", "left").crossJoin(F.broadcast(total))
    return rows.agg(F.round(F.sum((F.coalesce("inside", F.lit(0)) - expected / F.col("mm")) / F.col("mm")), 8).alias("modularity"))


def community_report(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per label: size, internal links, external links, and the member with most internal links (smallest of ties)."""
    both = undirected(edges).join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
    per_node = both.groupBy(F.col("a").alias("label"), F.col("src").alias("node")).agg(F.count_if(F.col("a") == F.col("b")).alias("i"), F.count_if(F.col("a") != F.col("b")).alias("e"))
    per = per_node.groupBy("label").agg((F.sum("i") / 2).cast("long").alias("internal"), F.sum("e").alias("external"), F.min(F.struct((-F.col("i")).alias("i"), "node")).alias("x"))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).join(per, "label").select("label", "size", "internal", "external", F.col("x.node").alias("centroid"))


def boundary_spanners(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes with neighbours in other communities: their number of such communities."""
    both = undirected(edges).join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
    return both.filter("a <> b").groupBy(F.col("src").alias("node")).agg(F.count_distinct("b").alias("n_communities"))


def snapshot_diff(edges: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """Per consecutive pair of snapshots: nodes and edges added and removed, churn and growth of edges.

    Each edge or node looks only at whether it also exists in the neighbouring snapshots, by one shuffle on itself.
    """
    steps = edges.select(F.col(snapshot).alias("s")).distinct().select("s", F.lead("s").over(Window.orderBy("s")).alias("s_next"), F.lag("s").over(Window.orderBy("s")).alias("s_prev"))

    def changes(items: DataFrame, keys: list[str], what: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("s")
        near = items.join(F.broadcast(steps), "s").select("s", "s_next", "s_prev", F.lead("s").over(w).alias("l"), F.lag("s").over(w).alias("p"))
        gone = near.filter("s_next IS NOT NULL").groupBy(F.col("s").alias("snapshot")).agg(F.count(F.lit(1)).alias(f"{what}_before"), F.count_if(~F.coalesce(F.col("l") == F.col("s_next"), F.lit(False))).alias(f"{what}_removed"))
        new = near.filter("s_prev IS NOT NULL").groupBy(F.col("s_prev").alias("snapshot")).agg(F.count(F.lit(1)).alias(f"{what}_after"), F.count_if(~F.coalesce(F.col("p") == F.col("s_prev"), F.lit(False))).alias(f"{what}_added"))
        return gone.join(new, "snapshot")

    e = edges.select("src", "dst", F.col(snapshot).alias("s")).distinct()
    n = e.select(F.col("src").alias("node"), "s").union(e.select("dst", "s")).distinct()
    out = changes(e, ["src", "dst"], "edges").join(changes(n, ["node"], "nodes"), "snapshot")
    return out.withColumn("churn", F.round(F.col("edges_removed") / F.col("edges_before"), 8)).withColumn("growth", F.round((F.col("edges_after") - F.col("edges_before")) / F.col("edges_before"), 8))


def persistence(edges: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """The share of edges ever present that are present in every snapshot."""
    total = edges.agg(F.count_distinct(snapshot).alias("n"))
    seen = edges.groupBy("src", "dst").agg(F.count_distinct(snapshot).alias("k")).crossJoin(F.broadcast(total))
    return seen.agg(F.count(F.lit(1)).alias("ever"), F.count_if(F.col("k") == F.col("n")).alias("always")).withColumn("persistence", F.round(F.col("always") / F.col("ever"), 8))


def temporal_centrality(edges: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """Per node: presence rate, mean degree centrality over its snapshots, and stability 1 / (1 + cv)."""
    e = edges.select("src", "dst", F.col(snapshot).alias("s")).distinct()
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "s")).filter("src <> dst").distinct()
    size = both.groupBy("s").agg(F.count_distinct("src").alias("n"))
    total = e.agg(F.count_distinct("s").alias("t"))
    c = both.groupBy("s", "src").agg(F.count(F.lit(1)).alias("d")).join(F.broadcast(size), "s").withColumn("c", F.col("d") / (F.col("n") - 1))
    per = c.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k"), F.avg("c").alias("m"), F.stddev_pop("c").alias("sd")).crossJoin(F.broadcast(total))
    return per.select("node", F.round(F.col("k") / F.col("t"), 6).alias("presence"), F.round("m", 8).alias("mean_centrality"), F.round(1 / (1 + F.when(F.col("m") > 0, F.col("sd") / F.col("m")).otherwise(0.0)), 6).alias("stability"))


def community_overlap(members: DataFrame, snapshot: str = "snapshot", merge: float = 0.3, split: float = 0.2, alive: float = 0.5) -> DataFrame:
    """From (snapshot, community, member): for each old and next community that share members, overlap, Jaccard, and
    whether the share of the new (merge) or of the old (split) is large."""
    steps = members.select(F.col(snapshot).alias("s")).distinct().select("s", F.lead("s").over(Window.orderBy("s")).alias("s_next")).filter("s_next IS NOT NULL")
    m = members.select(F.col(snapshot).alias("s"), "community", "member").distinct()
    size = m.groupBy("s", "community").agg(F.count(F.lit(1)).alias("size"))
    old = m.join(F.broadcast(steps), "s").withColumnRenamed("community", "old")
    new = m.select(F.col("s").alias("s_next"), F.col("community").alias("new"), "member")
    both = old.join(new, ["s_next", "member"]).groupBy("s", "s_next", "old", "new").agg(F.count(F.lit(1)).alias("shared"))
    both = both.join(size.select("s", F.col("community").alias("old"), F.col("size").alias("old_size")), ["s", "old"]).join(size.select(F.col("s").alias("s_next"), F.col("community").alias("new"), F.col("size").alias("new_size")), ["s_next", "new"])
    jaccard = F.col("shared") / (F.col("old_size") + F.col("new_size") - F.col("shared"))
    return both.select(
        F.col("s").alias("snapshot"), "old", "new", "old_size", "new_size", "shared", F.round(jaccard, 8).alias("jaccard"),
        (F.col("shared") / F.col("new_size") > merge).alias("merges"), (F.col("shared") / F.col("old_size") > split).alias("splits"), (jaccard > alive).alias("continues"))


def community_events(members: DataFrame, snapshot: str = "snapshot", change: float = 0.2) -> DataFrame:
    """Births, deaths, merges, splits, growth and shrinking between consecutive snapshots: (snapshot, event, community, detail)."""
    pairs = checkpointed(community_overlap(members, snapshot))
    times = members.select(F.col(snapshot).alias("s")).distinct().select("s", F.lead("s").over(Window.orderBy("s")).alias("s_next"), F.lag("s").over(Window.orderBy("s")).alias("s_prev"))
    all_c = members.select(F.col(snapshot).alias("s"), "community").distinct().join(F.broadcast(times), "s")
    kept = pairs.filter("continues")
    died = all_c.filter("s_next IS NOT NULL").join(kept.select(F.col("snapshot").alias("s"), F.col("old").alias("community")), ["s", "community"], "left_anti").select(F.col("s").alias("snapshot"), F.lit("death").alias("event"), "community", F.lit(0).cast("long").alias("detail"))
    born = all_c.filter("s_prev IS NOT NULL").join(kept.select(F.col("snapshot").alias("s_prev"), F.col("new").alias("community")), ["s_prev", "community"], "left_anti").select(F.col("s_prev").alias("snapshot"), F.lit("birth").alias("event"), "community", F.lit(0).cast("long").alias("detail"))
    merged = pairs.filter("merges").groupBy("snapshot", F.col("new").alias("community")).agg(F.count(F.lit(1)).alias("detail")).filter("detail > 1").select("snapshot", F.lit("merge").alias("event"), "community", "detail")
    parted = pairs.filter("splits").groupBy("snapshot", F.col("old").alias("community")).agg(F.count(F.lit(1)).alias("detail")).filter("detail > 1").select("snapshot", F.lit("split").alias("event"), "community", "detail")
    best = pairs.groupBy("snapshot", "new").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "old", "old_size", "new_size")).alias("b"))
    ratio = (F.col("b.new_size") - F.col("b.old_size")) / F.col("b.old_size")
    sized = best.select("snapshot", F.when(ratio > change, "growth").when(ratio < -change, "shrink").alias("event"), F.col("new").alias("community"), (F.col("b.new_size") - F.col("b.old_size")).cast("long").alias("detail")).filter("event IS NOT NULL")
    return died.unionByName(born).unionByName(merged).unionByName(parted).unionByName(sized)


def cascade_stats(tree: DataFrame) -> DataFrame:
    """Per cascade of (cascade_id, node, parent, depth): reach, depth, structural virality (mean depth), viral coefficient
    (mean children of nodes that have any) and largest branching."""
    children = tree.filter("parent IS NOT NULL").groupBy("cascade_id", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    per = children.groupBy("cascade_id").agg(F.avg("children").alias("viral_coefficient"), F.max("children").alias("max_branching"), F.count(F.lit(1)).alias("n_spreaders"))
    whole = tree.groupBy("cascade_id").agg(F.count(F.lit(1)).alias("reach"), F.max("depth").alias("max_depth"), F.avg("depth").alias("v"))
    return whole.join(per, "cascade_id", "left").select("cascade_id", "reach", "max_depth", F.round(F.when(F.col("reach") > 1, F.col("v")).otherwise(0.0), 6).alias("structural_virality"), F.round("viral_coefficient", 6).alias("viral_coefficient"), "max_branching", "n_spreaders")


def cascade_timing(events: DataFrame, ts: str = "ts") -> DataFrame:
    """(cascade_id, n_events, duration_hours, speed, peak_hour) of (cascade_id, ts): events an hour from first to last (their number
    if no time passes, 0 below two events), and the hour since the first with most events (the first such; 0 below three)."""
    hours = F.col("h") - F.col("first")
    rows = events.select("cascade_id", (F.unix_micros(F.col(ts).cast("timestamp")) / 3.6e9).alias("h"))
    ends = rows.groupBy("cascade_id").agg(F.min("h").alias("first"), F.max("h").alias("last"), F.count(F.lit(1)).alias("n_events"))
    hourly = rows.join(F.broadcast(ends) if ends.count() <= 10_000 else ends, "cascade_id").groupBy("cascade_id", F.floor(hours).alias("hour")).agg(F.count(F.lit(1)).alias("c"))
    peak = hourly.groupBy("cascade_id").agg(F.min(F.struct((-F.col("c")).alias("c"), "hour")).alias("p"))
    span = F.col("last") - F.col("first")
    return ends.join(peak, "cascade_id").select(
        "cascade_id", "n_events", F.round(span, 6).alias("duration_hours"), F.round(F.when(F.col("n_events") < 2, 0.0).when(span == 0, F.col("n_events").cast("double")).otherwise(F.col("n_events") / span), 6).alias("speed"),
        F.when(F.col("n_events") > 2, F.col("p.hour")).otherwise(0).cast("long").alias("peak_hour"))


def community_lifecycle(members: DataFrame) -> DataFrame:
    """Per community of (snapshot, community, member): first and last snapshot, in how many, mean size, whether it is in the last
    of all, and loyalty (the share of its first members that are in its last snapshot; 0 for one snapshot)."""
    sizes = members.groupBy("community", "snapshot").agg(F.count_distinct("member").alias("size"))
    life = sizes.groupBy("community").agg(F.min("snapshot").alias("born"), F.max("snapshot").alias("last"), F.count(F.lit(1)).alias("n_snapshots"), F.round(F.avg("size"), 6).alias("mean_size"), F.min_by("size", "snapshot").alias("first_size"))
    ends = members.distinct().join(life.select("community", "born", "last"), "community").filter("snapshot = born OR snapshot = last").groupBy("community", "member").agg(F.count_distinct("snapshot").alias("n"))
    stayed = ends.filter("n = 2").groupBy("community").agg(F.count(F.lit(1)).alias("stayed"))
    newest = members.agg(F.max("snapshot").alias("newest"))
    rows = life.join(stayed, "community", "left").crossJoin(F.broadcast(newest))
    return rows.select("community", "born", "last", "n_snapshots", "mean_size", (F.col("last") == F.col("newest")).alias("is_alive"), F.round(F.when(F.col("n_snapshots") > 1, F.coalesce("stayed", F.lit(0)) / F.col("first_size")).otherwise(0.0), 6).alias("loyalty"))


def modularity_trajectory(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(snapshot, modularity) of the undirected edges (src, dst, snapshot) under fixed labels (node, label), to four places."""
    both = edges.select("snapshot", "src", "dst").unionByName(edges.select("snapshot", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    of = both.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
    per = of.groupBy("snapshot", F.col("a").alias("label")).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("a") == F.col("b")).alias("i"))
    whole = per.groupBy("snapshot").agg(F.sum("k").alias("m"))
    return per.join(whole, "snapshot").groupBy("snapshot").agg(F.round(F.sum(F.col("i") / F.col("m") - F.col("k") * F.col("k") / (F.col("m") * F.col("m"))), 4).alias("modularity"))


def cascade_lines(tree: DataFrame) -> DataFrame:
    """(cascade_id, line): one JSON object a node of (cascade_id, node, parent, depth), the root's parent being null."""
    return tree.select("cascade_id", F.to_json(F.struct("cascade_id", "node", "parent", "depth"), {"ignoreNullFields": "false"}).alias("line"))


def mention_weight(times: Column, verified: Column) -> Column:
    """Mentions weighed by the logarithm of their number (of 10 at least), half as much again from verified accounts."""
    return times * F.log10(F.greatest(times, F.lit(10))) * F.when(verified, 1.5).otherwise(1.0)


def branching_distribution(tree: DataFrame) -> DataFrame:
    """Per cascade: how many nodes have how many children."""
    children = tree.filter("parent IS NOT NULL").groupBy("cascade_id", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("c"))
    return tree.select("cascade_id", "node").join(children, ["cascade_id", "node"], "left").groupBy("cascade_id", F.coalesce("c", F.lit(0)).alias("children")).agg(F.count(F.lit(1)).alias("n_nodes"))


def downstream_reach(tree: DataFrame, depth: int) -> DataFrame:
    """(node, reach): descendants of every node, summed over cascades; leaf counts are folded upwards level by level."""
    rows = tree.select("cascade_id", "node", "parent", "depth")
    total = None
    for level in range(depth, -1, -1):
        at = rows.filter(F.col("depth") == level)
        if total is None:
            here = at.select("cascade_id", "node", "parent", F.lit(0).cast("long").alias("reach"))
        else:
            below = total.groupBy("cascade_id", F.col("parent").alias("node")).agg(F.sum(F.col("reach") + 1).alias("r"))
            here = at.join(below, ["cascade_id", "node"], "left").select("cascade_id", "node", "parent", F.coalesce("r", F.lit(0)).alias("reach"))
        total = here
        out = here.select("node", "reach") if level == depth else out.unionByName(here.select("node", "reach"))
    return out.groupBy("node").agg(F.sum("reach").alias("reach"))


def random_walks(edges: DataFrame, starts: DataFrame, walks: int, steps: int) -> DataFrame:
    """(node, visits) of seeded walks: step k of walk w takes the edge number md5(w:k:node) modulo the out-degree."""
    ranked = edges.select("src", "dst").distinct().withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1)
    deg = ranked.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    ranked, deg = checkpointed(ranked), checkpointed(deg)
    walk = F.sequence(F.lit(1), F.lit(walks))
    at = starts.select(F.col("node").alias("src"), F.explode(walk).alias("w"), F.col("node").alias("origin"))
    visits = []
    for k in range(1, steps + 1):
        h = F.conv(F.substring(F.md5(F.concat_ws(":", "origin", "w", F.lit(k), "src")), 1, 8), 16, 10).cast("long")
        at = checkpointed(at.join(deg, "src").withColumn("r", (h % F.col("deg")).cast("int")).join(ranked, ["src", "r"]).select(F.col("dst").alias("src"), "w", "origin"))
        visits.append(at.select(F.col("src").alias("node")))
    out = visits[0]
    for v in visits[1:]:
        out = out.unionByName(v)
    return out.groupBy("node").agg(F.count(F.lit(1)).alias("visits"))


#: Operators that follow shortest paths from every node hold one graph in each task; larger graphs are refused.
MAX_LOCAL_EDGES = 2_000_000
#: closeness searches within components and holds one of them at a time besides the adjacency, so its graph may be larger.
MAX_CLOSENESS_EDGES = 20_000_000
#: Sources of one search of closeness, a bit each.
SOURCES = 512


def _local_graph(edges: DataFrame, what: str, most: int = MAX_LOCAL_EDGES):
    """The undirected graph as (broadcast of starts and targets by node number, nodes in order), its size checked first."""
    import numpy as np

    both = checkpointed(undirected(edges))
    if both.count() > most:
        raise ValueError(f"{what} needs the whole graph in each task; more than {most} edges")
    table = both.toArrow()
    src, dst = (table.column(k).to_numpy() for k in ("src", "dst"))
    nodes, at = np.unique(src, return_inverse=True)
    to = np.searchsorted(nodes, dst)
    order = np.lexsort((to, at))
    starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(nodes)))])
    return edges.sparkSession.sparkContext.broadcast((starts, to[order])), nodes, dict(both.dtypes)["src"], both


def _sources(both: DataFrame, nodes) -> DataFrame:
    """Every node as a source, in enough tasks that each has a few thousand at most."""
    parts = both.sparkSession.sparkContext.defaultParallelism
    return both.select(F.col("src").alias("node")).distinct().repartition(max(parts, 1 + len(nodes) // 1000), "node")


def closeness(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, reachable, closeness): nodes reachable (within depth, if given) over the sum of their distances, one search for SOURCES sources
    at a time, a share of them a task. The adjacency goes to every task, so its size is checked first; no pair of nodes is ever a row."""
    import numpy as np
    import pandas as pd

    shared, nodes, kind, both = _local_graph(edges, "closeness", MAX_CLOSENESS_EDGES)

    def levels(sources, starts, targets):
        """Reached nodes and sums of distances of up to SOURCES sources: bit k of a node's words tells whether source k has come there."""
        width = -(-len(sources) // 64)
        new = np.zeros((len(starts) - 1, width), np.uint64)
        k = np.arange(len(sources))
        new[sources, k // 64] = np.uint64(1) << (k % 64).astype(np.uint64)
        seen, reached, total, level = new.copy(), np.zeros(width * 64, np.int64), np.zeros(width * 64, np.int64), 0
        while level != depth:
            at = np.flatnonzero(new.any(axis=1))
            if not len(at):
                break
            # what the frontier's neighbours get from it; where it is small, others are not looked at
            n = starts[at + 1] - starts[at]
            if n.sum() * 4 < len(targets):
                near = np.unique(targets[np.repeat(starts[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())])
            else:
                near = np.arange(len(starts) - 1)
            got = np.empty((len(near), width), np.uint64)
            for low in range(0, len(near), 4096):
                part = near[low : low + 4096]
                n = starts[part + 1] - starts[part]
                ends = np.concatenate([[0], np.cumsum(n)[:-1]])
                got[low : low + 4096] = np.bitwise_or.reduceat(new[targets[np.repeat(starts[part] - ends, n) + np.arange(n.sum())]], ends, axis=0)
            got &= ~seen[near]
            new[:] = 0
            new[near] = got
            seen[near] |= got
            level += 1
            hit = np.zeros(width * 64, np.int64)
            came = got[got.any(axis=1)]
            for low in range(0, len(came), 8192):
                hit += np.unpackbits(came[low : low + 8192].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            reached += hit
            total += level * hit
        return reached[: len(sources)], total[: len(sources)]

    # sources of one component are searched together, so that a search stays within few components
    starts, targets = shared.value
    root, before = np.arange(len(nodes)), None
    while len(nodes) and (before is None or (root != before).any()):
        before = root
        root = np.minimum(root, np.minimum.reduceat(root[targets], starts[:-1]))
        root = root[root]
    # numbered by component, each is a stretch of the adjacency, and a search reads no other
    order = np.argsort(root, kind="stable")
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    degree, root = np.diff(starts), root[order]
    by_source = np.argsort(np.repeat(place, degree), kind="stable")
    shared.unpersist()
    shared = edges.sparkSession.sparkContext.broadcast((np.concatenate([[0], np.cumsum(degree[order])]), place[targets][by_source], np.searchsorted(root, root), np.searchsorted(root, root, "right"), nodes[order]))

    def search(batches):
        starts, targets, first, last, names = shared.value
        for pdf in batches:
            at = np.sort(pdf["id"].to_numpy())
            for low in range(0, len(at), SOURCES):
                part = at[low : low + SOURCES]
                x, y = first[part[0]], last[part[-1]]
                reached, total = levels(part - x, starts[x : y + 1] - starts[x], targets[starts[x] : starts[y]] - x)
                yield pd.DataFrame({"node": names[part], "reachable": reached, "closeness": reached / np.maximum(total, 1)})

    spark = edges.sparkSession
    sources = spark.range(0, len(nodes), 1, max(spark.sparkContext.defaultParallelism, 1 + len(nodes) // 2000))
    rows = sources.mapInPandas(search, f"node {kind}, reachable long, closeness double")
    return rows.filter("reachable > 0").select("node", "reachable", F.round("closeness", 8).alias("closeness"))


def betweenness(edges: DataFrame, doubled: bool = True) -> DataFrame:
    """(node, betweenness) by Brandes' accumulation, one task a share of the sources; doubled counts each pair both ways.

    Normalised by 2 / ((n - 1)(n - 2)). The adjacency goes to every task, so its size is checked first.
    """
    import numpy as np
    import pandas as pd

    shared, nodes, kind, both = _local_graph(edges, "betweenness")
    n = len(nodes)
    scale = (2.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * (1.0 if doubled else 0.5)

    def accumulate(batches):
        starts, targets = shared.value
        for pdf in batches:
            total = np.zeros(n)
            for s in np.searchsorted(nodes, pdf["node"].to_numpy()):
                depth, paths = np.full(n, -1, np.int64), np.zeros(n)
                depth[s], paths[s] = 0, 1.0
                frontier, levels = np.array([s]), []
                while len(frontier):
                    low, m = starts[frontier], starts[frontier + 1] - starts[frontier]
                    to = targets[np.repeat(low - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())]
                    by = np.repeat(frontier, m)
                    d = depth[frontier[0]] + 1
                    depth[to[depth[to] < 0]] = d
                    down = depth[to] == d
                    to, by = to[down], by[down]
                    paths += np.bincount(to, paths[by], n)
                    levels.append((to, by))
                    frontier = np.unique(to)
                owed = np.zeros(n)
                for to, by in reversed(levels):
                    owed += np.bincount(by, paths[by] / paths[to] * (1 + owed[to]), n)
                owed[s] = 0.0
                total += owed
            hit = np.flatnonzero(total)
            yield pd.DataFrame({"node": nodes[hit], "b": total[hit]})

    sums = _sources(both, nodes).mapInPandas(accumulate, f"node {kind}, b double").groupBy("node").agg(F.sum("b").alias("b"))
    every = both.select(F.col("src").alias("node")).distinct()
    return every.join(sums, "node", "left").select("node", F.round(F.coalesce("b", F.lit(0.0)) * scale, 8).alias("betweenness"))


def strongest_edges(edges: DataFrame, weight: str, k: int = 5) -> DataFrame:
    """Undirected edges that are among the k heaviest of either end."""
    both = edges.select("src", "dst", weight).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), weight))
    ranked = both.withColumn("__r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc(weight), "dst"))).filter(F.col("__r") <= k)
    return ranked.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), weight).distinct()


def growth_per_hour(before: Column, after: Column, hours: Column) -> Column:
    """Relative growth per hour."""
    return F.when((before > 0) & (hours > 0), (after - before) / before / hours).otherwise(F.lit(0.0))
