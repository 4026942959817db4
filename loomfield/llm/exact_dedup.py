"""Exact deduplication by two-pass Bloom filtering (operator 5).

Pass 1 folds the 64-bit hashes of all texts into a pair of Bloom filters, `once` and `twice`: a hash whose bits
are already in `once` sets its bits in `twice`. Merging is associative (`twice = t1 | t2 | (o1 & o2)`), so each
task sends what it has as a sparse partial filter (its distinct hashes, 8 bytes each, a hash that the task saw
repeatedly marked) to the task that owns the filter's segment. No repeated hash can be missing in `twice`.

Pass 2 tests every row against `twice`. Only rows that may be repeated are shuffled by their SHA-256 and grouped
exactly; all others pass straight through as groups of one. False positives only cost a shuffled row.

Size: a filter has 16 bits for each row, at most 2**29 bits (64 MB), which bounds what is collected and broadcast.
Beyond about 30 M rows false positives rise with the row count; results stay exact, and a row that is shuffled
has about 50 bytes, never its text. A hot text is one hash a task in pass 1, is counted with map-side partial
aggregation in pass 2, and its rows meet the one group row in a join that adaptive execution can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import MAX_BITS, SEGMENT_BITS, _segment, _test, filter_bits, repeated_filter  # noqa: F401
from .common import SPACE, checkpointed, text_hash, without_rows

def normalised(text: Column) -> Column:
    """The text without white space (`[\\x20\\x09-\\x0D]`); null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _decided(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """exact_dedup, with the rows' text_hash (raw)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    digests = checkpointed(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.char_length(text).alias("n"),
            F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha"),
            text_hash(text_col).alias("raw"),
        ).withColumn("h", F.xxhash64("sha"))
    )
    bits = repeated_filter(digests.select("h"), digests.count())
    shared = spark.sparkContext.broadcast(bits)
    segments = len(bits) * 8 // SEGMENT_BITS

    def flagged(batches):
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            base = _segment(h, segments).astype(np.int64) * SEGMENT_BITS
            yield batch.append_column("maybe", pa.array(_test(shared.value, base, h), pa.bool_()))

    schema = f"doc_id {dict(digests.dtypes)['doc_id']}, n int, sha binary, raw long, h long, maybe boolean"
    rows = digests.mapInArrow(flagged, schema).drop("h")
    alone = rows.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "raw")
    maybe = rows.filter("maybe").select("doc_id", "n", "sha", "raw")
    groups = maybe.groupBy("sha").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"))).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    )
    groups = checkpointed(groups.select("sha", F.col("best.id").alias("keep_id"), "group_size"))  # both sides of the join get an exchange, so a hot text can be split
    together = maybe.join(groups, "sha").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha", "raw"
    )
    return alone.unionByName(together).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "raw")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null is the empty text, and empty texts are equal.
    Of equal texts, the row with the most code points stays, then the smallest id (a null id comes last).
    Rows that repeat an id and its text share their decision. An empty table gives an empty result;
    further columns of the input are not read.
    """
    return _decided(docs, id_col, text_col).drop("raw")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    decided = _decided(docs, id_col, text_col)
    return without_rows(docs, decided.filter(~F.col("kept")).select("doc_id", "raw"), id_col, text_col)
