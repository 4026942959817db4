"""Registered queries read all of their input: tables made so that a cut would show."""

import datetime

from loomfield.plans import catalog


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_betweenness_of_all_returned_lines(spark, tmp_path):
    """The path 1 - 2 - 3 - 4, of lines of small quantities."""
    day = datetime.date(1995, 1, 1)
    lines = [(order, line, part, "R", 1.0 * part, day) for order, pair in enumerate([(1, 2), (2, 3), (3, 4)]) for line, part in enumerate(pair)]
    d = put(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_quantity double, l_shipdate date")
    found = dict(map(tuple, catalog.queries()["betweenness"](spark, d).collect()))
    assert {k: round(v, 6) for k, v in found.items()} == {1: 0.0, 2: 1.333333, 3: 1.333333, 4: 0.0}  # 2 pairs, both ways, over (n - 1)(n - 2) / 2


def test_paper_theme_similarity_of_whole_texts(spark, tmp_path):
    """Texts with one opening of 44 characters and other ends."""
    opening = "the same words open both texts of this pair "
    d = put(spark, tmp_path, "benchmark", [(1, opening + "aaaa"), (2, opening + "zzzz")], "item_id long, text string")
    found = [tuple(r) for r in catalog.queries()["paper_theme_similarity"](spark, d).collect()]
    assert found == [(1, round(0.6 * 9 / 11 + 0.4 * 44 / 48, 6))]
