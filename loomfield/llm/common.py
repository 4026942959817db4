"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed

#: White space as the contracts count it: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table; the path goes to Spark's reader alone, so it may lie in any store."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Up to so many ids (of 8 bytes each, 16 with a hash) may be broadcast.
BROADCAST_IDS = 200_000


def text_hash(text_col: str) -> Column:
    """64 bits of a text; with the id they name a row, as far as the decision on it goes."""
    return F.xxhash64(F.col(text_col))


def without_rows(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose id and text_hash are not in dropped (two columns).

    Dropped keys are broadcast if they are counted to be few; else a Bloom filter of them, of bounded size, lets most other rows
    pass straight through, and only rows that may be dropped are shuffled. Ids may be null or repeat: of rows with one
    id only those with a dropped text go.
    """
    from .bloom import maybe_in

    keys = checkpointed(dropped.toDF("__dropped_id", "__dropped_hash").distinct())
    n = keys.count()

    def left(rows: DataFrame, keys: DataFrame) -> DataFrame:
        same = rows[id_col].eqNullSafe(keys["__dropped_id"]) & (F.xxhash64(rows[text_col]) == keys["__dropped_hash"])
        return rows.join(keys, same, "left_anti")

    if n <= BROADCAST_IDS:
        return left(docs, F.broadcast(keys))
    maybe = maybe_in(keys.select(F.xxhash64("__dropped_id", "__dropped_hash")), n)
    flag = "__maybe_dropped"
    while flag in docs.columns:
        flag = f"_{flag}"
    marked = docs.withColumn(flag, maybe(F.xxhash64(F.col(id_col), F.xxhash64(text_col))))
    return marked.filter(~F.col(flag)).drop(flag).unionByName(left(marked.filter(flag).drop(flag), keys.hint("shuffle_hash")))
