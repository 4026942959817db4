"""Line deduplication by overlapping three-line windows (operator 2), in DataFrame functions only.

Every window of three consecutive lines (trimmed of blanks, tabs and carriage returns) has a 128-bit hash from two
seeded 64-bit ones. A window hash that occurs repeatedly in the whole corpus keeps its first occurrence (smallest
id, then position); every later occurrence marks its three lines. Marked positions of a document merge into ranges,
and the lines between the ranges stay.

Scale: what is shuffled for the search are hashes with (id, position), about 30 bytes a line; first occurrences come
from map-side partial aggregates, so a line common to a third of all rows is one row a task; its occurrences meet
the one group row in a join that adaptive execution can split (the group table is checkpointed, so both sides
have an exchange of their own). Positions are gathered per document only, which is bounded by that document. Texts are
not shuffled while the marks, which are counted first, are few enough to be broadcast; beyond, they meet their marks by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

WINDOW = 3
#: Up to so many documents with up to so many marked windows in all (4 bytes each) are broadcast.
BROADCAST_DOCS, BROADCAST_MARKS = 200_000, 4_000_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos and hash pair (a, b) of every three-line window that isn't wholly blank."""
    trimmed = docs.select(F.col(id_col).alias("id"), F.transform(_lines(F.col(text_col)), lambda x: F.trim(x, F.lit(" \t\r"))).alias("lines"))
    hashed = trimmed.filter(F.size("lines") >= WINDOW).select(
        "id",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size("lines") - (WINDOW - 1)),
                lambda i: F.struct(*(F.element_at("lines", i + k).alias(f"l{k}") for k in range(WINDOW))),
            )
        ).alias("pos", "w"),
    )
    three = [F.col(f"w.l{k}") for k in range(WINDOW)]
    return hashed.filter(F.concat(*three) != "").select("id", "pos", F.xxhash64(*three).alias("a"), F.xxhash64(F.lit(7), *reversed(three)).alias("b"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, text (what stays, joined by line feeds).

    A null text is an empty one: one empty line, nothing removed. Texts of fewer than three lines have no window.
    Windows of three blank lines are never counted. A text whose lines all go becomes empty. Rows that repeat an id
    are one document and share its positions. Other columns are not read.
    """
    found = windows(docs, id_col, text_col)
    first = checkpointed(
        found.groupBy("a", "b").agg(F.min(F.struct("id", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b", "first")
    )
    later = found.join(first, ["a", "b"]).filter(~(F.struct("id", "pos").eqNullSafe(F.col("first")))).select("id", "pos")
    marked = checkpointed(later.groupBy("id").agg(F.sort_array(F.collect_set("pos")).alias("marks")))
    size = marked.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size("marks")), F.lit(0)).alias("marks")).first()
    few = size["docs"] <= BROADCAST_DOCS and size["marks"] <= BROADCAST_MARKS
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("whole"))
    joined = rows.join(F.broadcast(marked) if few else marked.hint("shuffle_hash"), rows.doc_id.eqNullSafe(marked.id), "left")
    lines = _lines(F.col("whole"))
    none = F.array().cast("array<int>")
    marks = F.coalesce("marks", none)
    starts = F.concat(F.array(F.lit(0)), F.transform(marks, lambda p: p + WINDOW))
    ends = F.concat(marks, F.array(F.size("lines")))
    return (
        joined.select("doc_id", lines.alias("lines"), "marks")
        .select("doc_id", "lines", F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r: r["e"] > r["s"]).alias("ranges"))
        .select(
            "doc_id",
            F.size("lines").cast("long").alias("n_lines"),
            F.flatten(F.transform("ranges", lambda r: F.slice("lines", r["s"] + 1, r["e"] - r["s"]))).alias("kept"),
        )
        .select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("text"))
    )
