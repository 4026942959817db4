"""Hand-worked values of the formulas, and edge cases: empty input, ties, nulls, loops, isolated nodes."""

import pytest
from pyspark.sql import functions as F

from loomfield.operators import aggregates as A
from loomfield.operators import geo, graph, pairs, scoring, stats, text, windows
from loomfield.sources import payloads, sinks


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_growth(spark):
    years = [2020] * 10 + [2021] * 15 + [2023] * 5
    df = windows.yearly_growth(spark.createDataFrame([(y,) for y in years] + [(None,)], "year int"))
    assert rows(df, "year") == [(2020, 10, 0.0, 10), (2021, 15, 50.0, 25), (2022, 0, -100.0, 25), (2023, 5, 0.0, 30)]
    assert rows(windows.yearly_growth(spark.createDataFrame([], "year int"))) == []


def values(spark, xs, name="v"):
    return spark.createDataFrame([("k", x) for x in xs], f"grp string, {name} long")


def test_percentiles(spark):
    m = A.journal_metrics(values(spark, [1, 2, 3, 4]), ["grp"], "v").first()
    assert (m.p25, m.median, m.p75, m.p90) == (1.75, 2.5, 3.25, 3.7)


@pytest.mark.parametrize("xs, h", [([10, 8, 5, 4, 3], 4), ([0, 0], 0), ([100], 1), ([3, 3, 3, 3], 3), ([25, 8, 5, 3, 3], 3)])
def test_h_index(spark, xs, h):
    assert A.h_index(values(spark, xs), ["grp"], "v").first().h_index == h


@pytest.mark.parametrize("xs, standard, cumulative", [([5, 5, 5, 5], 0.0, 0.5), ([0, 0, 0, 10], 0.75, 0.875), ([7], 0.0, 0.5)])
def test_gini(spark, xs, standard, cumulative):
    assert A.gini(values(spark, xs), ["grp"], "v").first().gini == standard
    assert A.gini(values(spark, xs), ["grp"], "v", "cumulative").first().gini == cumulative


def test_top_share(spark):
    assert A.top_share(values(spark, range(1, 11)), ["grp"], "v").first().top_share == pytest.approx(10 / 55, abs=1e-6)


def test_rank_score(spark):
    assert spark.range(1).select(pairs.rank_score(F.lit(200), F.lit(5))).first()[0] == pytest.approx(1.5)


def test_zscore(spark):
    df = spark.createDataFrame([("m", i, 10.0 if i == 9 else 0.0) for i in range(10)], "k string, i int, v double")
    z = [r.z for r in windows.rolling_zscore(df, ["k"], ["i"], "v").orderBy("i").collect()]
    assert z == [0.0] * 9 + [3.0]


def test_ema(spark):
    df = spark.createDataFrame([("m", i, float(i + 1)) for i in range(3)], "k string, i int, v double")
    assert windows.ema(df, ["k"], ["i"], "v", span=3).first().ema == 2.25


def test_price_change(spark):
    df = spark.createDataFrame([(1, 1, 1, 100.0), (1, 2, 2, 80.0), (1, 3, 3, 80.0)], "item_id int, ts int, event_id int, price double")
    (r,) = windows.price_changes(df).collect()
    assert (r.delta, r.delta_percent, r.is_significant, r.direction) == (-20.0, -20.0, True, "down")


def test_burstiness(spark):
    df = spark.createDataFrame([(1, f"2024-01-01 0{h}:00:00", h) for h in range(4)], "u int, ts string, e int").withColumn("ts", F.to_timestamp("ts"))
    assert windows.interval_stats(df, "u", "ts", "e").first().burstiness == -1.0


def edges(spark, es):
    return spark.createDataFrame(es, "src string, dst string")


def test_pagerank_step(spark):
    found = {r.node: r["rank"] for r in graph.pagerank(edges(spark, [("a", "b"), ("b", "a"), ("a", "c")]), 1).collect()}
    assert found["a"] == pytest.approx(1 / 3, abs=1e-5)
    assert found["b"] == found["c"] == pytest.approx(0.191667, abs=1e-5)


def test_paths(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "a")])
    assert dict(rows(graph.betweenness(e)))["b"] == 2.0
    assert dict(rows(graph.betweenness(e, doubled=False)))["b"] == 1.0
    close = {r.node: r.closeness for r in graph.closeness(e, 5).collect()}
    assert close["b"] == 1 and close["a"] == pytest.approx(2 / 3, abs=1e-8)
    assert [r.node for r in graph.shortest_path(e, "a", "c").orderBy("step").collect()] == ["a", "b", "c"]
    assert rows(graph.shortest_path(edges(spark, [("a", "b"), ("c", "d")]), "a", "d")) == []


def test_modularity(spark):
    e = edges(spark, [("a", "b"), ("c", "d")])
    labels = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2)], "node string, label int")
    assert graph.modularity(e, labels).first()[0] == 0.5
    assert graph.modularity(e, labels, "ordered_pairs").first()[0] == 0.75


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    found = dict(rows(graph.components(spark.createDataFrame(chain, "src long, dst long"))))
    assert {found[i] for i in range(41)} == {0} and found[101] == 100
    assert rows(graph.components(spark.createDataFrame([], "src long, dst long"))) == []


def test_cascade(spark):
    t = spark.createDataFrame([(1, "root", None, 0), (1, "x", "root", 1), (1, "y", "root", 1), (1, "z", "x", 2)], "cascade_id int, node string, parent string, depth int")
    s = graph.cascade_stats(t).first()
    assert (s.structural_virality, s.viral_coefficient) == (1.0, 1.5)
    assert dict(rows(graph.downstream_reach(t, 2)))["root"] == 3


def test_powerlaw(spark):
    assert stats.powerlaw_alpha(values(spark, [1, 2, 4, 8]), ["grp"], "v", 1).first().alpha == pytest.approx(1.961797, abs=1e-6)
    h = stats.hill(values(spark, [2**i for i in range(9)]), ["grp"], "v").first()
    assert (h.k, h.hill) == (3, pytest.approx(0.721348, abs=1e-6))


def test_haversine_and_entropy(spark):
    km = spark.range(1).select(stats.haversine(F.lit(-6.2), F.lit(106.816), F.lit(-6.917), F.lit(107.617))).first()[0]
    assert km == pytest.approx(119.1038, abs=1e-3)
    df = spark.createDataFrame([("k", c) for c in "aabc"], "k string, c string")
    assert stats.entropy(df, ["k"], "c").first().entropy == 1.5


def test_dbscan(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.09), (3, 50.0, 50.0), (4, 0.0, 179.99), (5, 0.0, -179.99), (6, None, 0.0)], "id int, lat double, lng double")
    found = {r.id: (r.cluster, r.core) for r in geo.dbscan(p, "id").collect()}
    assert found == {1: (1, True), 2: (1, True), 3: (None, False), 4: (4, True), 5: (4, True), 6: (None, False)}


def test_similarity(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "id int, text string")
    p = text.shingles(spark.createDataFrame([(9, "a b c d e x")], "probe int, text string"), "probe", 5)
    r = text.probe_overlap(p, text.shingles(df, "id", 5), "id").first()
    assert (r.jaccard, r.overlap) == (pytest.approx(1 / 3, abs=1e-8), 0.5)
    a, b = (F.split(F.lit(x), " ") for x in ("a b c d e f", "a b c d e x"))
    assert spark.range(1).select(text.lcs_length(a, b)).first()[0] == 5


def test_ranges_and_sentiment(spark):
    assert spark.range(1).select(text.expand_ranges(F.lit("1, 2, 4-6, x"))).first()[0] == [1, 2, 4, 5, 6]
    r = text.sentiment(spark.createDataFrame([(1, "love this great bad"), (2, None)], "id int, text string")).orderBy("id").collect()
    assert (r[0].score, r[0].label, r[0].confidence) == (pytest.approx(1 / 3, abs=1e-6), "positive", 0.6)
    assert r[1].label == "neutral"


def test_tfidf(spark):
    df = spark.createDataFrame([(1, "graph spark"), (2, "graph join")], "id int, text string")
    w = text.tfidf(text.tokens(df, "id", least=4), "id")
    assert {r.token: r.idf for r in w.collect()}["graph"] == pytest.approx(0.594535, abs=1e-6)
    c = text.cosine_to(w, w.filter("id = 1").select(F.col("id").alias("probe"), "token", "weight"), "id").filter("id = 2").first()
    assert c.cosine == pytest.approx(0.261159, abs=1e-5)


def test_texts_to_numbers(spark):
    df = spark.createDataFrame([("Rp1.500.000", "Terjual 1,2rb"), ("Rp2.000 - Rp3.000", "3 jt"), ("", "none")], "p string, s string")
    assert rows(df.select(payloads.price_text(F.col("p")), payloads.sold_text(F.col("s")))) == [(1500000.0, 1200), (2000.0, 3000000), (0.0, 0)]
    more = spark.createDataFrame([("IDR 12.500,50 only", "10rb+ sold"), ("1.250", "2,5 juta"), ("999,9", "7.5k"), (None, None), ("Rp", "rb")], "p string, s string")
    assert rows(more.select(payloads.price_text(F.col("p")), payloads.sold_text(F.col("s")))) == [(12500.5, 10000), (1250.0, 2500000), (999.9, 7500), (0.0, 0), (0.0, 0)]
    assert int(spark.range(1).select(payloads.shortcode_id(F.lit("BA"))).first()[0]) == 64


def test_short_numbers_round_by_binary_value(spark):
    import random

    rng = random.Random(2)
    ns = [0.0, 999.0, 1050.0, 1150.0, 1250.0, 1350.0, 999_950.0, 1_250_000.0, 1_150_000.0, 2.5e9, 1.05e9] + [float(rng.randrange(10 ** rng.randint(3, 12))) for _ in range(2000)] + [50.0 * rng.randrange(20, 20_000) for _ in range(2000)]

    def shown(n):
        for scale, letter in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
            if n >= scale:
                return f"{n / scale:.1f}{letter}"
        return str(int(n))

    got = [r[0] for r in spark.createDataFrame([(k, n) for k, n in enumerate(ns)], "k int, n double").orderBy("k").select(payloads.short_number(F.col("n"))).collect()]
    assert got == [shown(n) for n in ns]


def test_closeness_and_betweenness_brute_force(spark):
    """A graph of two components against distances by Floyd and Warshall and all shortest paths."""
    import random

    rng = random.Random(3)
    pairs_ = {(a, b) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(22)) if a != b} | {(20, 21), (21, 22)}
    both = pairs_ | {(b, a) for a, b in pairs_}
    nodes = sorted({a for a, _ in both})
    far = {(a, b): 0 if a == b else 1 if (a, b) in both else 10**6 for a in nodes for b in nodes}
    for k in nodes:
        for a in nodes:
            for b in nodes:
                far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    count = {(a, a): 1 for a in nodes}
    for a, b in sorted(far, key=far.get):
        if 0 < far[a, b] < 10**6:
            count[a, b] = sum(count[a, x] for x in nodes if (x, b) in both and far[a, x] == far[a, b] - 1)
    e = spark.createDataFrame(sorted(pairs_), "src long, dst long")
    got = {r.node: (r.reachable, r.closeness) for r in graph.closeness(e).collect()}
    for a in nodes:
        d = [far[a, b] for b in nodes if b != a and far[a, b] < 10**6]
        assert got[a] == (len(d), round(len(d) / sum(d), 8))
    between = {r.node: r.betweenness for r in graph.betweenness(e).collect()}
    n = len(nodes)
    for x in nodes:
        want = sum(count[a, x] * count[x, b] / count[a, b] for a in nodes for b in nodes if len({a, b, x}) == 3 and far[a, b] < 10**6 and far[a, x] + far[x, b] == far[a, b])
        assert between[x] == pytest.approx(want * 2 / ((n - 1) * (n - 2)), abs=1e-7)


def test_bias_signals_keep_word_boundaries(spark):
    df = spark.createDataFrame([(1, "an unvalidated unadjusted instrument"), (2, "Blinded, ITT, adjusted and validated with CONSORT; n = 250"), (3, "pilot with n < 25 and masked, open-label")], "id int, text string")
    got = {r.id: r for r in text.risk_of_bias(df).collect()}
    assert (got[1].measurement, got[1].confounding) == ("high", "high")
    assert (got[2].blinding, got[2].attrition, got[2].reporting, got[2].measurement, got[2].confounding, got[2].sample_size, got[2].overall) == ("low", "low", "low", "low", "low", "low", "low")
    assert (got[3].sample_size, got[3].blinding) == ("high", "unclear")


def test_citation_intent_counts_matches(spark):
    """Hand-worked: contrast has 2 of 8 patterns with 2 and 1 matches (0.375), support 1 of 7 (0.142857); share of at least 1."""
    df = spark.createDataFrame([(1, "However, although it fails to scale, results confirm it"), (2, ""), (3, "zzz"), (4, " ".join(["however"] * 17)), (5, None)], "id int, text string")
    got = {r.id: (r.intent, r.confidence, r.tone) for r in text.intent(df).collect()}
    assert got == {1: ("contrast", 0.375, "negative"), 2: ("background", 0.0, "neutral"), 3: ("background", 0.3, "neutral"), 4: ("contrast", 1.0, "negative"), 5: ("background", 0.0, "neutral")}


def test_study_types_in_order(spark):
    df = spark.createDataFrame([(1, "a randomised trial and survey"), (2, "Systematic review of cohorts"), (3, "case series"), (4, "a narrative"), (5, "in vitro"), (6, "reviewed"), (7, "follow-up study")], "id int, text string")
    got = {r.id: r.t for r in df.select("id", text.study_type(F.col("text")).alias("t")).collect()}
    assert got == {1: "rct", 2: "meta_analysis", 3: "case_report", 4: "review", 5: "experimental", 6: "unknown", 7: "cohort"}


def test_funders_by_any_word(spark):
    from loomfield.operators import extract

    df = spark.createDataFrame([(1, "Thanks to the DFG and the Deutsche Forschungsgemeinschaft (award No. XY-77), and AFOSR."), (2, "none"), (3, None), (4, "The Army Research office, NSF-2024567")], "id int, text string")
    got = sorted(map(tuple, extract.funding(df, "id").collect()))
    assert got == [(1, "Air Force Office of Scientific Research (AFOSR)", "XY-77"), (1, "German Research Foundation (DFG)", "XY-77"), (4, "Army Research Office (ARO)", "NSF-2024567"), (4, "National Science Foundation (NSF)", "NSF-2024567")]


def test_ring_position(spark):
    h = spark.range(1).select(F.conv(F.substring(F.md5(F.lit("a")), 1, 8), 16, 10).cast("long")).first()[0]
    assert h == 214005177
    owners = pairs.ring_owner(spark.range(500).withColumnRenamed("id", "key"), "key", ["x", "y"]).groupBy("node").count().collect()
    assert sum(r["count"] for r in owners) == 500 and len(owners) == 2


def test_success_rate(spark):
    df = spark.createDataFrame([("k", True), ("k", True), ("k", False)], "k string, ok boolean")
    assert A.success_rate(df, ["k"], F.col("ok")).first().success_rate == pytest.approx(2 / 3, abs=1e-6)


def test_exports(spark, tmp_path):
    p = spark.createDataFrame([(k, ["A Smith", "X Y"], "Big <News>", 2020, "J", "1-9") for k in range(30)] + [(50, [], "", 0, "", "7")], "paper_id int, author_names array<string>, title string, year int, journal string, pages string")
    got = {r.paper_id: r for r in sinks.bibtex(p).collect()}
    assert [got[k].key for k in (0, 1, 26, 27, 28, 50)] == ["Smith2020big", "Smith2020biga", "Smith2020bigz", "Smith2020bigaa", "Smith2020bigab", "unknown0untitled"]
    assert got[0].entry == "@article{Smith2020big,\n  title = {Big <News>},\n  author = {A Smith and X Y},\n  year = {2020},\n  journal = {J},\n  pages = {1-9},\n}"
    assert got[50].entry == "@article{unknown0untitled,\n  title = {},\n  pages = {7},\n}"
    tags = {r.paper_id: r.entry for r in sinks.ris(p).collect()}
    assert tags[0] == "TY  - JOUR\nTI  - Big <News>\nAU  - A Smith\nAU  - X Y\nPY  - 2020\nJO  - J\nSP  - 1\nEP  - 9\nER  - " and tags[50] == "TY  - JOUR\nTI  - \nSP  - 7\nER  - "
    e = edges(spark, [("a&b", "c")])
    lines = sinks.graphml_lines(graph.nodes(e), e)
    sinks.write_lines(lines, str(tmp_path / "g"), *sinks.GRAPHML)
    whole = "\n".join(r.value for r in spark.read.text(str(tmp_path / "g")).collect())
    assert 'source="a&amp;b"' in whole and whole.count("<node") == 2
    nested = spark.createDataFrame([(1, (2.0, 3.0), ["x", "y"])], "id int, loc struct<lat:double,lng:double>, tags array<string>")
    assert rows(sinks.flatten(nested)) == [(1, 2.0, 3.0, "x; y")]
    sinks.write_csv(nested, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id", "loc_lat", "loc_lng", "tags"]


def test_federated_dedup(spark):
    df = spark.createDataFrame(
        [(1, "10.1/A", "T one", "", 5, "b"), (2, "10.1/a", "T one!", "text", 9, "c"), (3, "", "Other", "", 1, "a"), (4, None, "other.", "x", 2, "b")],
        "paper_id int, doi string, title string, abstract string, citation_count int, source_api string")
    found = {r.paper_id: (r.citation_count, r.abstract, r.n_sources) for r in pairs.federated_dedup(df, F.col("source_api")).collect()}
    assert found == {1: (9, "text", 2), 3: (2, "x", 2)}


def test_importance(spark):
    df = spark.createDataFrame([(float(i % 2), float(i), float(i % 2)) for i in range(200)], "x double, noise double, label double")
    got = dict(rows(scoring.permutation_importance(df, lambda d: d.withColumn("prediction", F.col("x")), ["x", "noise"], "label")))
    assert got["x"] > 0.2 and got["noise"] == 0


def test_signature(spark):
    import hashlib
    import hmac

    from loomfield.operators import extract

    got = spark.range(1).select(extract.signature(F.lit('{"k": 1}'), "s3cret", F.lit(17))).first()[0]
    assert got == hmac.new(b"s3cret", b'17.{"k": 1}', hashlib.sha256).hexdigest()
    assert extract.expanded_query("deep learning", {"deep": ["neural", "layered"]}, 1) == '("deep" OR "neural") AND "learning"'


def test_streams_agree_with_batch(spark, tmp_path):
    """A stream in several micro-batches gives what one batch does; a resumed sink writes nothing twice."""
    from loomfield.streaming import metrics as M

    rows = spark.createDataFrame([(f"m{i % 2}", i, float(i % 7)) for i in range(60)], "k string, i long, v double")
    for n in range(3):
        rows.filter(F.col("i").between(20 * n, 20 * n + 19)).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = M.run_to_memory(M.ema_stream(src, "k", "i", "v"), "ema_rows", str(tmp_path / "c1"))
    want = {}
    for k, i, v in rows.orderBy("i").collect():
        want[k] = v if k not in want else 2 / 11 * v + 9 / 11 * want[k]
    assert got.count() == 60
    assert {r.k: round(r.e, 9) for r in got.groupBy("k").agg(F.max_by("ema", "i").alias("e")).collect()} == {k: round(v, 9) for k, v in want.items()}
    seen = []
    for _ in range(2):
        M.filtered_sink(src, [F.col("v") > 3, F.col("i") < 50], lambda b, n: seen.extend(r.i for r in b.collect()), str(tmp_path / "c2")).awaitTermination()
    assert sorted(seen) == [i for i in range(50) if i % 7 > 3]


def test_alerts_and_limits(spark):
    from loomfield.streaming import metrics as M

    e = spark.createDataFrame([("a", float(t)) for t in (0, 100, 299, 301, 5000)], "k string, s double")
    assert sorted(r.s for r in M.alerts(e, "k", "s").collect()) == [0.0, 301.0, 5000.0]
    got = M.token_bucket(e, "k", "s", rate=0.001, capacity=2.0).orderBy("s").collect()
    assert [r.allowed for r in got] == [True, True, False, False, True]
    calls = spark.createDataFrame([("a", float(t), ok) for t, ok in ((0, False), (1, False), (2, True), (70, True), (71, False))], "k string, t double, ok boolean")
    assert [r.state for r in M.circuit_breaker(calls, "k", "t", "ok", failures=2).orderBy("t").collect()] == ["closed", "open", "open", "closed", "closed"]
