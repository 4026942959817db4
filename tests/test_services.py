"""Workflows, explanations, registers and exports on hand-worked cases."""

import time

import pytest
from pyspark.sql import functions as F

from loomfield.functions import lineage
from loomfield.operators import explain, graph, nested, registers, text, workflow
from loomfield.sources import payloads, sinks
from loomfield.sources.cursor import CursorSource


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_workflow_order_and_failures():
    seen = []

    def step(name, fails=False, wait=0.0):
        def run(given, needed):
            time.sleep(wait)
            seen.append(name)
            if fails:
                raise ValueError(f"{name} broke")
            return (given, sorted(needed))

        return run

    s = workflow.Step
    out = workflow.run_workflow([s("c", step("c"), ("a", "b")), s("a", step("a", wait=0.1)), s("b", step("b"))], 7)
    assert out.status == "completed" and out.results["c"] == (7, ["a", "b"]) and seen[-1] == "c"
    out = workflow.run_workflow([s("a", step("a", fails=True)), s("b", step("b"), ("a",)), s("c", step("c"), ("b",)), s("d", step("d"))], 0)
    assert out.status == "failed" and out.steps == {"a": "failed", "b": "cancelled", "c": "cancelled", "d": "completed"} and out.errors["a"] == "a broke"
    out = workflow.run_workflow([s("a", step("a", fails=True), (), 9.0, False), s("b", step("b"), ("a",))], 0)
    assert out.status == "completed" and out.results == {"b": (0, ["a"])} and out.steps["a"] == "failed"
    out = workflow.run_workflow([s("slow", step("slow", wait=1.0), (), 0.1), s("odd", step("odd"), ("nowhere",)), s("x", step("x"), ("y",)), s("y", step("y"), ("x",))], 0)
    assert out.steps == {"slow": "failed", "odd": "cancelled", "x": "cancelled", "y": "cancelled"} and "timeout" in out.errors["slow"]


def test_report_isolates_stages(spark):
    steps = [workflow.Step("one", lambda given, _: given.agg(F.count(F.lit(1)).alias("n"))), workflow.Step("two", lambda *_: 1 / 0, (), 9.0, False), workflow.Step("lazy", lambda given, _: given.select(F.raise_error(F.lit("late")).alias("x")))]
    got = workflow.report(spark, "p", steps, spark.range(3)).collect()
    assert [(r.stage, r.status, r.metric, r.value) for r in got[:2]] == [("one", "completed", "n", 3.0), ("two", "failed", "", None)]
    assert got[2].stage == "lazy" and got[2].status == "failed" and got[2].value is None


def test_batch_keeps_other_items(spark):
    def slow(x):
        if x == 2:
            time.sleep(1.5)
        if x == 3:
            raise ValueError("no")
        return x + 1

    got = {r.k: (r.result, r.error) for r in workflow.process_batch(spark.createDataFrame([(i, i) for i in range(5)], "k int, v int").coalesce(1), slow, "k", "v", 2, 0.4).collect()}
    assert got[0] == ("1", None) and got[4] == ("5", None) and got[3] == (None, "no") and got[2][0] is None and got[2][1]


def test_shapley_sums_to_the_score(spark):
    """By hand for x * y + z against means (1, 1, 0): the product's surplus is shared, z keeps its own."""
    df = spark.createDataFrame([(1, 3.0, 2.0, 5.0), (2, 1.0, 1.0, 0.0)], "k int, x double, y double, z double")
    back = spark.createDataFrame([(0.0, 1.0, -1.0), (2.0, 1.0, 1.0)], "x double, y double, z double")
    got = {(r.k, r.feature): (r.contribution, r.direction) for r in explain.shapley(df, "k", ["x", "y", "z"], lambda c: c["x"] * c["y"] + c["z"], back).collect()}
    assert got[1, "x"] == (3.0, "positive") and got[1, "y"] == (2.0, "positive") and got[1, "z"] == (5.0, "positive") and got[2, "x"] == (0.0, "neutral")
    plain = {(r.k, r.feature): (r.contribution, r.direction) for r in explain.shapley(df, "k", ["x", "z"], None).collect()}
    assert plain[1, "x"] == (3.0, "positive") and plain[2, "z"] == (0.0, "negative")


def test_counterfactual_takes_the_first_change(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 9.0), (3, 1.0, 100.0)], "k int, a double, b double")
    got = rows(explain.counterfactual(df, "k", ["a", "b"], {"a": (0, 4)}, lambda c: c["a"] + c["b"] > 13, True))
    assert got == [(2, "b", 9.0, 4.5), (3, "a", 1.0, 0.0)]


def test_isolation_forest_finds_far_rows(spark):
    import random

    rng = random.Random(5)
    data = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(600)] + [(1000 + i, 9.0 + i, -9.0) for i in range(6)] + [(2000, None, 0.0)]
    df = spark.createDataFrame(data, "k int, x double, y double").repartition(3)
    got = {r.k: r.anomaly for r in explain.isolation_forest(df, "k", ["x", "y"]).collect()}
    assert len(got) == 607 and min(got[1000 + i] for i in range(6)) > sorted(got[i] for i in range(600))[594]
    assert got == {r.k: r.anomaly for r in explain.isolation_forest(df.repartition(5), "k", ["x", "y"]).collect()}
    assert explain.isolation_forest(df.limit(0), "k", ["x", "y"]).count() == 0


def test_watch_list_and_cascading_removal(spark):
    log = spark.createDataFrame(
        [(1, 1, "add", "a"), (1, 2, "rename", "b"), (1, 3, "deactivate", None), (2, 4, "add", "x"), (2, 5, "remove", None), (2, 6, "activate", None), (3, 7, "rename", "ghost"), (4, 8, "add", "p"), (4, 9, "remove", None), (4, 10, "add", "q"), (5, 11, "add", "n"), (5, 12, "deactivate", None), (5, 13, "activate", None)],
        "item_id int, at int, action string, name string")
    assert rows(registers.watch_list(log).select("item_id", "name", "is_active")) == [(1, "b", False), (4, "q", True), (5, "n", True)]
    history = spark.createDataFrame([(1, 1, 5.0), (4, 8, 6.0), (4, 10, 7.0), (9, 1, 1.0)], "item_id int, at int, price double")
    assert rows(registers.kept_history(history, log)) == [(1, 1, 5.0), (4, 10, 7.0), (9, 1, 1.0)]


def test_payload_dialects(spark):
    graph_body = '{"paperId":"p","title":"T","year":null,"authors":[{"name":"A"},{"name":""}],"externalIds":{"DOI":"10.1/x"},"journal":null,"isOpenAccess":true}'
    r = payloads.graph_works(spark.createDataFrame([(graph_body,), ("broken",)], "body string")).collect()
    assert (r[0].paper_id, r[0].doi, r[0].year, r[0].author_names, r[0].journal, r[0].is_open_access) == ("p", "10.1/x", 0, ["A"], "", True)
    assert r[1].title in ("", "[Unknown]")
    body = '{"title":[],"author":[{"given":"A","family":"B"},{}],"DOI":"10.1/y","issued":{"date-parts":[[2019,1]]},"container-title":["J"],"abstract":"<p>x</p>","license":[]}'
    c = payloads.registry_works(spark.createDataFrame([(body,)], "body string")).first()
    assert (c.title, c.author_names, c.year, c.journal, c.abstract, c.url, c.is_open_access) == ("", ["A B"], 2019, "J", "x", "https://doi.org/10.1/y", False)
    contexts = '{"data":[{"citingPaper":{"paperId":"q","title":"Q"},"contexts":["one","two"],"intents":["Result","motivation","odd"],"isInfluential":true},{"citingPaper":{"paperId":"r","title":""}},{"citingPaper":{"paperId":"s","title":"S"}}]}'
    got = payloads.citation_contexts(spark.createDataFrame([(1, contexts)], "k int, body string"), "k").collect()
    assert sorted((x.citing_id, x.context or "", tuple(x.families), x.is_influential) for x in got) == [("q", "one", ("support", "background"), True), ("q", "two", ("support", "background"), True), ("s", "", (), False)]
    oa = payloads.oa_records(spark.createDataFrame([(1, '{"is_oa":true,"best_oa_location":{"url":"u"}}'), (2, "{}")], "k int, body string"), "k")
    assert rows(oa) == [(1, True, "closed", "u", "", "", ""), (2, False, "closed", "", "", "", "")]


def test_cascade_timing(spark):
    ev = [("a", f"2024-01-01 00:{m:02d}:00") for m in (0, 10)] + [("a", "2024-01-01 05:00:00"), ("a", "2024-01-01 05:30:00"), ("a", "2024-01-01 05:40:00"), ("b", "2024-01-01 00:00:00"), ("c", "2024-01-01 00:00:00"), ("c", "2024-01-01 00:00:00")]
    got = {r.cascade_id: r for r in graph.cascade_timing(spark.createDataFrame(ev, "cascade_id string, t string").withColumn("ts", F.col("t").cast("timestamp"))).collect()}
    assert (got["a"].n_events, got["a"].peak_hour, round(got["a"].speed, 4)) == (5, 5, round(5 / (17 / 3), 4)) and got["b"].speed == 0.0 and got["c"].speed == 2.0


def test_lifecycle_and_fusion(spark):
    m = spark.createDataFrame([(1, "x", k) for k in range(4)] + [(2, "x", k) for k in (0, 1, 9)] + [(3, "y", 5)], "snapshot int, community string, member int")
    assert rows(graph.community_lifecycle(m)) == [("x", 1, 2, 2, 3.5, False, 0.5), ("y", 3, 3, 1, 1.0, True, 0.0)]
    one = nested.early_fusion({"text": (F.array(F.lit(1.0)), F.lit(0.2))})
    r = spark.range(1).select(one.alias("f")).first().f
    assert r.consistency == 1.0 and r.insights == ["only text", "low confidence: text"]


def test_gap_rules(spark):
    p = spark.createDataFrame([(1, 2000, 90, ["old"]), (2, 2010, 80, ["shared"]), (3, 2024, 1, ["shared"])], "paper_id int, year int, citation_count int, keywords array<string>")
    c = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("b", 3)], "label string, paper_id int")
    assert rows(text.gap_report(p, c, 2022, 2023)) == [("no_follow_up", "1", "90"), ("publication_gap", "2001", "2009"), ("publication_gap", "2011", "2023"), ("small_cluster", "a", "1")]


def test_excel_falls_back_to_csv(spark, tmp_path):
    made = sinks.write_excel(spark.createDataFrame([(1, ["x", "y"])], "id int, tags array<string>"), str(tmp_path / "book.xlsx"))
    if made == "csv":
        assert spark.read.option("header", True).csv(str(tmp_path / "book.xlsx")).collect()[0].tags == "x; y"


def test_cursor_source_over_http(spark):
    """Pages of a real server, followed by their cursors."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlsplit

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlsplit(self.path).query)
            at = 0 if q["cursor"] == ["*"] else int(q["cursor"][0])
            body = json.dumps({"results": [{"q": q["query"][0], "n": at + k} for k in range(3)], "meta": {"next_cursor": str(at + 3) if at < 9 else None}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(CursorSource)
        df = spark.read.format("cursor").option("url", f"http://127.0.0.1:{server.server_port}/works").option("queries", '["a b", "c"]').load()
        got = sorted((r.query, json.loads(r.body)["n"]) for r in df.collect())
    finally:
        server.shutdown()
    assert got == [(q, n) for q in ("a b", "c") for n in range(12)]


def test_checkpoint_folder_is_shared(spark):
    class Far:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://far:7077"
            getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *_: None)}))

    with pytest.raises(ValueError):
        lineage.shared_folder(Far)


@pytest.mark.parametrize("stretch", [7, 60, 10**9])
def test_windows_across_stretches(spark, monkeypatch, stretch):
    """Rolling statistics are the same however series are cut; one key has nearly all rows, one has gaps, times repeat."""
    import random
    import statistics

    from loomfield.operators import windows

    monkeypatch.setattr(windows, "STRETCH_ROWS", stretch)
    rng = random.Random(8)
    data = [("hot", 1_700_000_000 + rng.randrange(4000), i, float(rng.randrange(50))) for i in range(300)] + [("rare", 1_700_000_000 + 900 * i, 1000 + i, float(i % 3)) for i in range(6)]
    df = spark.createDataFrame(data, "k string, s long, id long, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.z for r in windows.rolling_zscore(df, ["k"], ["ts", "id"], "v", 20, 5).collect()}
    stats = {r.id: (r.n, r.mean, r.low, r.high) for r in windows.time_window_stats(df, ["k"], "ts", "v", 300).collect()}
    assert len(got) == len(stats) == len(data)
    for key in ("hot", "rare"):
        series = sorted((s, i, v) for k, s, i, v in data if k == key)
        for at, (s, i, v) in enumerate(series):
            last = [x for _, _, x in series[max(0, at - 19) : at + 1]]
            dev = statistics.pstdev(last)
            assert got[i] == pytest.approx(round((v - statistics.fmean(last)) / dev, 4) if len(last) >= 5 and dev > 0 else 0.0, abs=1e-4)
            near = [x for t, _, x in series if s - 300 <= t <= s]
            assert stats[i] == (len(near), pytest.approx(statistics.fmean(near), abs=1e-7), min(near), max(near))


def test_dispatch_retries_with_one_name(spark):
    """Refused requests come again under the same name, and bodies are signed."""
    import hashlib
    import hmac
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    seen, lock = [], threading.Lock()

    class Hook(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            with lock:
                seen.append((body, self.headers["X-Delivery"], self.headers["X-Signature"]))
                n = sum(b == body for b, _, _ in seen)
            self.send_response(500 if body == b"never" or (body == b"late" and n < 2) else 204)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Hook)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        df = spark.createDataFrame([(1, "now"), (2, "late"), (3, "never")], "id int, body string")
        got = rows(sinks.dispatch(df, f"http://127.0.0.1:{server.server_port}/", "s", "id", "body"))
    finally:
        server.shutdown()
    assert got == [(1, True, 204, 1), (2, True, 204, 2), (3, False, 500, 3)]
    assert len({d for b, d, _ in seen if b == b"never"}) == 1 and len({d for _, d, _ in seen}) == 3
    assert all(s == hmac.new(b"s", b, hashlib.sha256).hexdigest() for b, _, s in seen)


def test_sanitized_payloads(spark):
    import json

    from loomfield.operators import checks

    body = {"ok": "x" * 10_001, "Auth": 1, "list": [{"my_token": 1, "v": [1]}] * 120, "deep": {"deep": {"deep": {"n": 1}}}}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "[1]"), (3, "no"), (4, None)], "id int, body string")
    got = {r.id: r.out for r in df.select("id", checks.sanitized(3)("body").alias("out")).collect()}
    out = json.loads(got[1])
    assert out["ok"] == "x" * 10_000 + "...[TRUNCATED]" and out["Auth"] == "[REDACTED]" and out["list"] == [{"my_token": "[REDACTED]", "v": [1]}] * 100
    assert out["deep"] == {"deep": {"deep": {"_truncated": True}}} and got[2] is got[3] is got[4] is None


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    """A second run with the same checkpoint hands over the new rows only, even if the first one was broken off in its sink."""
    from loomfield.streaming import metrics as M

    def put(n, values):
        spark.createDataFrame([(v,) for v in values], "v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    seen, broken = [], [True]

    def write(batch, n):
        got = sorted(r.v for r in batch.collect())
        if got and broken[0]:
            broken[0] = False
            raise RuntimeError("sink is down")
        seen.extend(got)

    def run():
        stream = spark.readStream.schema("v int").parquet(str(tmp_path / "in"))
        q = M.filtered_sink(stream, [F.col("v") > 2, F.col("v") % 2 == 1], write, str(tmp_path / "checkpoint"))
        q.awaitTermination()

    put(1, range(6))
    with pytest.raises(Exception, match="sink is down"):
        run()
    run()
    put(2, range(6, 10))
    run()
    run()
    assert sorted(seen) == [3, 5, 7, 9]


def test_profile_page_takes_the_first_way(spark):
    from loomfield.operators import extract

    user = '{"username":"u","edge_followed_by":{"count":5}}'
    pages = [
        (1, '<script>window._sharedData = {"entry_data":{"ProfilePage":[{"graphql":{"user":' + user + "}}]}};</script>"), (2, '<p>"user":{"username":"other","edge_followed_by":{"count":9}}</p>'), (3, "nothing"), (4, None),
        (5, "<script>window._sharedData = broken;</script>" + '"edge_follow":{"count":2},"edge_followed_by":{"count":8}'),
    ]
    df = spark.createDataFrame(pages, "id int, html string").select("id", extract.profile_page(F.col("html"), F.lit("u")).alias("x"))
    got = {r.id: r.x and (r.x.username, r.x.followers, r.x.following, r.x.source) for r in df.collect()}
    assert got == {1: ("u", 5, None, "shared"), 2: ("u", 9, None, "fields"), 3: None, 4: None, 5: ("u", 8, 2, "fields")}
