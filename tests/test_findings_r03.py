"""What the findings of round 3 were about."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomfield.llm import chosen_path
from loomfield.operators import graph


def _bits(df) -> int:
    """Bits of the size in bytes that Spark guesses for df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length()


def _chain(spark, n):
    return spark.range(n).select((F.col("id") * 1237 % (n + 1)).alias("a"), ((F.col("id") + 1) * 1237 % (n + 1)).alias("b")).repartition(4)


def test_guessed_sizes_do_not_grow_with_rounds(spark, monkeypatch):
    """F1 to F3: every join multiplied the guesses of its sides, which checkpoints kept: 4134 bits after 4 rounds of components."""
    monkeypatch.setattr(chosen_path, "PARTITION_ROWS", 500)
    found, _ = chosen_path.components(_chain(spark, 2000))
    assert [(r.component, r["count"]) for r in found.groupBy("component").count().collect()] == [(0, 2001)]
    assert _bits(found) < 256
    links = _chain(spark, 40).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = graph.components(links)
    assert [(r.component, r["count"]) for r in found.groupBy("component").count().collect()] == [(0, 41)]
    assert _bits(found) < 256


def test_crowds_leave_the_trees_after_one_level(spark, monkeypatch):
    """The check's rows of op7 and pipeline: a group that a level does not part is not branched once more."""
    levels, real = [], chosen_path._branched
    monkeypatch.setattr(chosen_path, "_branched", lambda level: levels.append(level) or real(level))
    random = np.random.RandomState(3)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for k in range(600):
        words = list(base)
        words[random.randint(400)] = f"x{k}"
        texts.append((k, " ".join(words)))
    got = chosen_path.near_dup(spark.createDataFrame(texts, "doc_id long, text string"), words=2).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
    assert levels == [1]


def test_closeness_of_more_edges_than_other_searches_hold(spark, monkeypatch):
    """graphs of over MAX_LOCAL_EDGES edges were refused; components whose numbers interleave are searched by themselves."""
    monkeypatch.setattr(graph, "MAX_LOCAL_EDGES", 10)
    links = [(k, k + 2) for k in range(12)]  # two paths of seven nodes, even and odd
    got = {r.node: (r.reachable, r.closeness) for r in graph.closeness(spark.createDataFrame(links, "src long, dst long")).collect()}
    far = {k: sum(abs(k - m) // 2 for m in range(k % 2, 14, 2)) for k in range(14)}
    assert got == {k: (6, round(6 / far[k], 8)) for k in range(14)}
