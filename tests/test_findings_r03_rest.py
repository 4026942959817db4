"""What the findings of round 3 that were left open were about."""

from __future__ import annotations

import numpy as np

from loomfield.llm import chosen_path
from loomfield.operators import pairs


def _components(keys, linked):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_classes_meet_pivots_like_them(spark, monkeypatch):
    """the smallest classes were the pivots, which most others don't resemble: all pairs of those were then compared."""
    compared, real = [], pairs._confirmed
    monkeypatch.setattr(pairs, "_confirmed", lambda found, *rest: compared.append(found.count()) or real(found, *rest))
    random = np.random.RandomState(5)
    sets = {k: set(random.choice(100, random.randint(36, 56), replace=False).tolist()) for k in range(300)}
    linked = [(a, b) for a in sets for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.3]
    rows = spark.createDataFrame([(k, t) for k, s in sets.items() for t in s], "k long, t int")
    got = {r.node: r.component for r in pairs.jaccard_components(rows, "k", "t", 0.3).collect()}
    ends = {k for pair in linked for k in pair}
    assert got == {k: c for k, c in _components(sets, linked).items() if k in ends}
    assert sum(compared) < 15_000


def test_candidates_inside_of_components_are_not_confirmed(spark, monkeypatch):
    """The check's rows of op7 and pipeline: a crowd's candidates across components were all confirmed, though the first of each joined them."""
    confirmed, real = [], chosen_path.confirm
    monkeypatch.setattr(chosen_path, "confirm", lambda found, *rest: confirmed.append(found.select("a", "b").distinct().count()) or real(found, *rest))
    monkeypatch.setattr(chosen_path, "NODE", 16)
    random = np.random.RandomState(3)
    texts, sets = [], {}
    for k in range(400):
        words = [f"w{j}" for j in range(100)]
        for at in random.choice(100, random.randint(1, 6), replace=False):
            words[at] = f"x{k}_{at}"
        texts.append((k, " ".join(words)))
        sets[k] = {*zip(words, words[1:])}
    linked = [(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in chosen_path.near_dup(spark.createDataFrame(texts, "doc_id long, text string"), words=2).collect()}
    assert got == _components(sets, linked)
    print("confirmed", confirmed, "linked", len(linked), "components", len(set(got.values())))
    assert sum(confirmed) < 4_000
