"""Registers kept as logs: watch lists with updates and cascading removal, price histories, gauges, exports of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def watch_list(log: DataFrame, key: str = "item_id", order: str = "at") -> DataFrame:
    """(key, name, is_active, added, removed) as a log (key, order, action, name) leaves it.

    Actions: add (insert or replace), rename, activate, deactivate, remove. What came before an item's last removal, or its
    last add, is gone with it; updates of items that aren't there do nothing. Items that are removed last are left out.
    One aggregation with map-side partials and a join on the key; no item's log is gathered.
    """
    def last(*actions: str) -> Column:
        return F.max(F.when(F.col("action").isin(*actions), F.col(order)))

    ends = log.groupBy(key).agg(last("add").alias("added"), last("remove").alias("removed"))
    ends = ends.filter(F.col("added").isNotNull() & (F.col("removed").isNull() | (F.col("added") > F.col("removed"))))
    since = log.join(ends.select(F.col(key).alias("__key"), F.col("added").alias("__added")), F.col(key) == F.col("__key")).filter(F.col(order) >= F.col("__added"))
    state = since.groupBy(key).agg(
        F.max_by("name", F.when(F.col("action").isin("add", "rename"), F.col(order))).alias("name"),
        F.max_by(F.col("action") != "deactivate", F.when(F.col("action").isin("add", "activate", "deactivate"), F.col(order))).alias("is_active"))
    return state.join(ends, key).select(key, "name", "is_active", "added", "removed")


def kept_history(history: DataFrame, log: DataFrame, key: str = "item_id", order: str = "at") -> DataFrame:
    """The rows of a history that no later removal of their item has taken away."""
    gone = log.filter("action = 'remove'").groupBy(key).agg(F.max(order).alias("__gone"))
    return history.join(gone, key, "left").filter(F.col("__gone").isNull() | (F.col(order) > F.col("__gone"))).drop("__gone")


def price_history(prices: DataFrame, key: str = "item_id", limit: int = 100) -> DataFrame:
    """The newest `limit` snapshots of each item (key, ts, event_id, price), oldest first, with the change from the one before and
    from the oldest shown."""
    newest = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    rows = prices.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= limit)
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    before, first = F.lag("price").over(w), F.first("price").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(
        key, "ts", "event_id", "price", F.row_number().over(w).alias("snapshot"), F.round(F.col("price") - before, 4).alias("delta"), F.round(F.when(before > 0, (F.col("price") - before) * 100 / before), 4).alias("delta_percent"),
        F.round(F.col("price") - first, 4).alias("delta_from_first"))


def watch_export(items: DataFrame, prices: DataFrame, key: str = "item_id") -> DataFrame:
    """items with initial, current, lowest and highest price, their number, and the change from first to last in amount and percent."""
    first, last = F.min_by("price", F.struct("ts", "event_id")), F.max_by("price", F.struct("ts", "event_id"))
    p = prices.groupBy(key).agg(F.count(F.lit(1)).alias("n_snapshots"), first.alias("initial_price"), last.alias("current_price"), F.min("price").alias("lowest_price"), F.max("price").alias("highest_price"))
    delta = F.col("current_price") - F.col("initial_price")
    rows = items.join(p, key, "left").withColumn("n_snapshots", F.coalesce("n_snapshots", F.lit(0)))
    return rows.withColumn("delta", F.round(delta, 4)).withColumn("delta_percent", F.round(F.when(F.col("initial_price") > 0, delta * 100 / F.col("initial_price")), 4))


def gauges(points: DataFrame, name: str, ts: str, tie: str, value: str, since: Column) -> DataFrame:
    """(name, counter, gauge, n_since, mean_since): sum, last value, and number and mean of the values since a time."""
    new = F.col(ts) >= since
    return points.groupBy(name).agg(
        F.round(F.sum(value), 4).alias("counter"), F.max_by(value, F.struct(ts, tie)).alias("gauge"), F.count_if(new).alias("n_since"), F.round(F.avg(F.when(new, F.col(value))), 6).alias("mean_since"))


def last_averages(points: DataFrame, name: str, ts: str, tie: str, value: str, last: int = 100) -> DataFrame:
    """(name, n, average) over the last values of each name; partial limits run before the shuffle, so no name is gathered."""
    w = Window.partitionBy(name).orderBy(F.desc(ts), F.desc(tie))
    rows = points.select(name, ts, tie, value, F.row_number().over(w).alias("__r")).filter(F.col("__r") <= last)
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("average"))


def model_registry(log: DataFrame, model: str = "model", order: str = "moved") -> DataFrame:
    """(model, n_versions, latest, production, needs_update) of a log (model, order, version, action): versions registered, the one
    registered last, the one promoted or rolled back to last (null if none), and whether the former is a newer number."""
    registered = F.col("action") == "register"
    rows = log.groupBy(model).agg(
        F.count_distinct(F.when(registered, F.col("version"))).alias("n_versions"), F.max_by("version", F.when(registered, F.col(order))).alias("latest"),
        F.max_by("version", F.when(~registered, F.col(order))).alias("production"))
    return rows.withColumn("needs_update", F.coalesce(F.col("latest") > F.col("production"), F.col("latest").isNotNull()))


def harvest_marks(log: DataFrame, key: str, order: str) -> DataFrame:
    """(key, status, at, n_rows, error) of a harvest's log (key, order, mark, rows, error): its last mark, when, what it has fetched
    since it last started, and the error of a failure."""
    started = log.groupBy(key).agg(F.max(F.when(F.col("mark") == "started", F.col(order))).alias("__from"))
    rows = log.join(started, key).filter(F.col("__from").isNull() | (F.col(order) >= F.col("__from")))
    last = F.max(F.struct(F.col(order).alias("at"), F.col("mark").alias("status"), "error"))
    return rows.groupBy(key).agg(last.alias("x"), F.sum(F.coalesce("rows", F.lit(0))).alias("n_rows")).select(key, "x.status", "x.at", "n_rows", F.when(F.col("x.status") == "failed", F.col("x.error")).alias("error"))
