"""Readers of the base tables, and the adapter views that give them the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications: paper_id, year, citation_count, journal (the author's segment), source_api."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("paper_id"),
        F.year("o_orderdate").alias("year"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("citation_count"),
        F.col("c_mktsegment").alias("journal"),
        F.col("o_orderpriority").alias("source_api"),
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which work cites which: distinct (paper_id, ref_id)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("ref_id")).distinct()


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who wrote what: distinct (paper_id, author_id)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id")).distinct()


def follows(spark: SparkSession, sf_dir: str, snapshot: str | None = "year") -> DataFrame:
    """Directed edges (src, dst, snapshot): consecutive returned parts of an order, by ship year."""
    from pyspark.sql.window import Window

    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    edges = lines.select(F.col("l_partkey").alias("src"), following.alias("dst"), F.year("l_shipdate").alias("snapshot"))
    edges = edges.filter("dst IS NOT NULL AND src <> dst")
    return edges.distinct() if snapshot else edges.select("src", "dst").distinct()


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cascade per region as (cascade_id, node, parent, depth): region, nation, customer, order."""
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))

    def node(prefix: str, c):
        return F.concat(F.lit(prefix), c.cast("string"))

    nc = nation.join(customer, nation.n_nationkey == customer.c_nationkey)
    rows = region.select(F.col("r_regionkey").alias("cascade_id"), node("r", F.col("r_regionkey")).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    rows = rows.unionByName(nation.select(F.col("n_regionkey").alias("cascade_id"), node("n", F.col("n_nationkey")).alias("node"), node("r", F.col("n_regionkey")).alias("parent"), F.lit(1).alias("depth")))
    rows = rows.unionByName(nc.select(F.col("n_regionkey").alias("cascade_id"), node("c", F.col("c_custkey")).alias("node"), node("n", F.col("n_nationkey")).alias("parent"), F.lit(2).alias("depth")))
    nco = nc.join(orders, nc.c_custkey == orders.o_custkey)
    return rows.unionByName(nco.select(F.col("n_regionkey").alias("cascade_id"), node("o", F.col("o_orderkey")).alias("node"), node("c", F.col("c_custkey")).alias("parent"), F.lit(3).alias("depth")))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements: metric, ts, value, and event_id to order ties."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "ts", "value", "event_id", "user_id")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price snapshots: item_id, ts, price, event_id."""
    return table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("item_id"), "ts", F.col("value").alias("price"), "event_id")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts: user_id, ts, event_id."""
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
