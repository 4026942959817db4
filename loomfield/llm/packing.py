"""Conflict-constrained best-fit packing (operator 10).

Documents, or the last pieces of documents longer than a bin, go by falling length into the tightest open bin that
has room and no conflict: no bin holds two pieces of one source or of one duplicate cluster. Open bins stand in
residual order, each with a source bitmap and a cluster bitmap; the search starts at the successor of the length
and goes on through larger residuals until a bin is compatible, or opens a new one.

Packing is sharded: each shard has about SHARD_ROWS documents by id hash (a hot source is spread evenly over all
shards), is packed by one task that streams shard after shard, and has bin numbers of its own. Only (id, length,
source, cluster), about 50 bytes a row, is shuffled; no text is.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

CAPACITY, SHARD_ROWS = 2048, 4096


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of the text; null has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def text_cluster(text: Column) -> Column:
    """A cluster for texts that are equal without white space; null for null or blank texts, which conflict with none."""
    bare = F.translate(text, SPACE, "")
    return F.when(F.length(bare) > 0, F.xxhash64(bare))


def best_fit(pieces: list[tuple], capacity: int) -> list[tuple[int, int]]:
    """Bin and start in the bin for each (length, source, cluster), given by falling length; null conflicts with none."""
    order: list[tuple[int, int]] = []  # (residual, bin), by residual
    sources: list[int] = []
    clusters: list[int] = []
    number: dict = {}

    def bit(kind: str, value) -> int:
        return 0 if value is None else 1 << number.setdefault((kind, value), len(number))

    placed = []
    for length, source, cluster in pieces:
        s, c = bit("s", source), bit("c", cluster)
        at = bisect_left(order, (length, -1))
        while at < len(order) and (sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        placed.append((b, capacity - residual))
        sources[b] |= s
        clusters[b] |= c
        insort(order, (residual - length, b))
    return placed


def _packed(capacity: int):
    names = ["doc_id", "piece", "piece_start", "piece_length", "bin_id", "bin_start"]

    def shard_rows(shard: int, rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        rows.sort(key=lambda r: (-(r[1] % capacity if r[1] > capacity else r[1]), -r[1], r[0] is None, r[0] if r[0] is not None else 0, str(r[2])))
        whole, last = [], []
        for i, length, source, cluster in rows:
            full = (length - 1) // capacity if length > capacity else 0
            whole += [(i, k, k * capacity, capacity) for k in range(full)]
            last.append((i, full, full * capacity, length - full * capacity, source, cluster))
        last.sort(key=lambda x: -x[3])
        found = best_fit([x[3:] for x in last], capacity)
        bins = 1 + max((b for b, _ in found), default=-1)
        table = [(*x[:4], b, at) for x, (b, at) in zip(last, found, strict=True)]
        table += [(*x, bins + k, 0) for k, x in enumerate(whole)]
        out = list(zip(*table, strict=True))
        out[4] = [(shard << 32) + b for b in out[4]]
        return pa.RecordBatch.from_arrays([pa.array(out[0], ids), *(pa.array(x, pa.int64()) for x in out[1:])], names)

    def run(batches):
        shard, rows, ids = None, [], None
        for batch in batches:
            ids = batch.schema.field(1).type
            for s, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if s != shard and rows:
                    yield shard_rows(shard, rows, ids)
                    rows = []
                shard = s
                rows.append(tuple(row))
        if rows:
            yield shard_rows(shard, rows, ids)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, source: Column | None = None, cluster: Column | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, piece_start, piece_length, bin_id, bin_start (all but the id long).

    length is in tokens (by default words of `text`), a document of more than capacity tokens is cut into full pieces
    that each fill a bin and a last piece that is packed. Source and cluster default to `source` and the hash of the
    text without white space; nulls conflict with nothing. Empty and null texts are one piece of length 0. Equal
    lengths go by id. Repeated rows are packed one by one. An empty table gives an empty result.
    """
    length = word_count(F.col("text")) if length is None else length
    source = F.col("source").cast("string") if source is None else source
    cluster = text_cluster(F.col("text")) if cluster is None else cluster
    shards = max(1, -(-docs.select(id_col).count() // shard_rows))
    rows = docs.select(
        F.pmod(F.when(F.col(id_col).isNull(), F.coalesce(cluster.cast("long"), F.lit(0))).otherwise(F.xxhash64(id_col)), F.lit(shards)).cast("int").alias("shard"),
        F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("n"), source.alias("source"), cluster.cast("long").alias("cluster"),
    )
    ids = dict(rows.dtypes)["doc_id"]
    longs = ", ".join(f"{n} long" for n in ("piece", "piece_start", "piece_length", "bin_id", "bin_start"))
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(_packed(capacity), f"doc_id {ids}, {longs}")
