"""What the last findings of round 3 were about: disk, and rows that grow with the square of a group."""

from __future__ import annotations

import numpy as np

from loomfield.llm import chosen_path
from loomfield.operators import pairs, text


def test_crowds_give_few_candidates_and_nodes_no_sketches(spark, monkeypatch):
    """The check of op7: all candidates of a crowd were joined with components, and trees moved a sketch with every row."""
    seen, columns, across, nodes_of = [], [], chosen_path.across_components, chosen_path.nodes_of

    def nodes(*given):
        found = nodes_of(*given)
        columns.extend([*found[0].columns, *found[1].columns])
        return found

    monkeypatch.setattr(chosen_path, "across_components", lambda pairs, known: seen.append(pairs.count()) or across(pairs, known))
    monkeypatch.setattr(chosen_path, "nodes_of", nodes)
    monkeypatch.setattr(chosen_path, "NODE", 16)
    random, texts = np.random.RandomState(3), []
    for k in range(200):
        words = [f"w{j}" for j in range(100)]
        for at in random.choice(100, random.randint(1, 6), replace=False):
            words[at] = f"x{k}_{at}"
        texts.append((k, " ".join(words)))
    got = chosen_path.near_dup(spark.createDataFrame(texts, "doc_id long, text string"), words=2).collect()
    assert {r.component_id for r in got} == {0}
    print("across", seen)
    assert set(columns) == {"path", "id", "n"}
    assert sum(seen) < 3_000


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_members_are_not_shuffled(spark):
    """pairs of a class with the members of another went through a shuffle, and grow with the square of the classes."""
    sets = {k: set(range(k % 5, k % 5 + 6)) for k in range(60)}
    rows = spark.createDataFrame([(k, t) for k, s in sets.items() for t in s], "k long, t int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = pairs.jaccard_pairs(rows, "k", "t", 0.3)
        got = {(r.a, r.b): (r.shared, r.jaccard) for r in found.collect()}
        plan = _plan(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shared = {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b}
    assert got == {k: (s, round(s / n, 8)) for k, (s, n) in shared.items() if s / n >= 0.3}
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_pairs_of_probes_and_documents_are_not_shuffled(spark, monkeypatch):
    """every pair of a probe and a document went through three shuffles."""
    monkeypatch.setattr(text, "PROBE_ROWS", 40, raising=False)
    random = np.random.RandomState(1)
    vectors = {k: {f"t{t}": float(random.randint(1, 9)) for t in random.choice(30, 8, replace=False)} for k in range(1, 60)}
    rows = spark.createDataFrame([(k, t, w) for k, v in vectors.items() for t, w in v.items()], "k long, token string, weight double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = text.cosine_to(rows, rows.filter("k % 5 = 0").withColumnRenamed("k", "probe"), "k")
        got = [((r.probe, r.k), r.cosine) for r in found.collect()]
        plan = _plan(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    norm = {k: sum(w * w for w in v.values()) ** 0.5 for k, v in vectors.items()}
    want = {(p, k): sum(w * v[t] for t, w in vectors[p].items() if t in v) / norm[p] / norm[k] for p in vectors if p % 5 == 0 for k, v in vectors.items() if vectors[p].keys() & v.keys()}
    assert len(got) == len(want) and all(abs(c - want[pair]) < 1e-5 for pair, c in got)
    assert "hashpartitioning(probe" not in plan and "SortMergeJoin" not in plan
