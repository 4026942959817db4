"""Findings of round 2: inputs on which queries differed from their SQL or did not finish."""

from pyspark.sql import functions as F

from loomfield.plans import catalog
from loomfield.sources import sinks


def against_sql(spark, name, folder, tables):
    """Rows of the query and of its SQL over the tables written to the folder, sorted."""
    import duckdb

    c = duckdb.connect()
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = catalog.queries()[name](spark, str(folder))
    found = c.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr), sorted(found.fetchall(), key=repr)


def test_bibtex_keys_of_large_groups(spark):
    n = 26 * 160 + 3
    papers = spark.range(n).select(F.col("id").alias("paper_id"), F.lit("Low").alias("title"), F.array(F.lit("A B")).alias("author_names"), F.lit(1995).alias("year"))
    keys = {r.paper_id: r.key for r in sinks.bibtex(papers).select("paper_id", "key").collect()}
    assert len(set(keys.values())) == n
    assert [keys[k] for k in (0, 1, 26, 27, 26 * 160 + 1)] == ["B1995low", "B1995lowa", "B1995lowz", "B1995lowaa", "B1995low" + chr(256) + "a"]


def lines(spark, pairs):
    """lineitem whose follow edges are the pairs."""
    rows = [(k, p, n) for k, pair in enumerate(pairs) for n, p in enumerate(pair)]
    return spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int").withColumns({"l_returnflag": F.lit("R"), "l_shipdate": F.lit("1995-01-01").cast("timestamp")})


def test_paths_beyond_the_searched_depth_have_no_length(spark, tmp_path):
    for length, expected in ((4, 4), (5, None), (6, None)):
        way = [1, *range(2, length + 1), 150]
        got, wanted = against_sql(spark, "shortest_path_length", tmp_path, {"lineitem": lines(spark, list(zip(way[:-1], way[1:])))})
        assert got == wanted == [(expected,)]


def events(spark, rows):
    """events of rows (user_id, event_type, hour, value)."""
    e = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "event_id long, user_id long, event_type string, h int, value double")
    return e.withColumn("ts", F.make_timestamp(F.lit(2020), F.lit(1), F.lit(1), "h", F.lit(0), F.lit(0))).drop("h")


def test_breaks_of_repeated_values(spark, tmp_path):
    values = [0.01] * 400 + [0.3 + 0.07 * k for k in range(300)] + [90.0] * 400
    got, wanted = against_sql(spark, "scaling_breaks", tmp_path, {"events": events(spark, [(0, "a", 0, v) for v in values])})
    assert [r[:3] for r in got] == [r[:3] for r in wanted] and got
    assert all(abs(x[3] - y[3]) < 2e-4 for x, y in zip(got, wanted))


def test_best_match_compares_classes(spark):
    from loomfield.operators import extract

    n = 20_000  # 4e8 pairs of rows, 4 of classes
    p = spark.range(2 * n).select(F.col("id").alias("k"), F.lit("x").alias("b"), F.when(F.col("id") % 4 < 2, "Old Iron bolt").otherwise("old  ring").alias("w"))
    got = extract.best_match(p.filter("k % 2 = 0"), p.filter("k % 2 = 1"), "b", "k", "w", 0.3)
    assert {tuple(r) for r in got.groupBy(F.col("k") % 4, "match", "score").count().collect()} == {(0, 1, 1.0, n // 2), (2, 3, 1.0, n // 2)}


def test_components_of_many_equal_sets(spark):
    from loomfield.operators import pairs

    n = 20_000  # equal sets of a third of all keys would make 7e7 pairs each
    sets = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (1, "x"), (1, "y"), (2, "c"), (2, "d"), (2, "e"), (2, "b")], "r long, t string")
    rows = spark.range(n).withColumn("r", F.col("id") % 3).join(sets, "r").select("id", "t").unionByName(spark.createDataFrame([(n + 1, "alone")], "id long, t string"))
    got = pairs.jaccard_components(rows, "id", "t", 0.4).groupBy((F.col("node") % 3).alias("r"), "component").count().collect()
    # {a b c} and {b c d e} share 2 of 5; a key linked with none has no row
    assert {tuple(r) for r in got} == {(0, 0, 6667), (2, 0, 6666), (1, 1, 6667)}


def test_theme_queries_with_copies(spark, tmp_path):
    rows = [(u, "ab"[h % 2], (h + u % 4) % 7, 1.0) for u in range(40) for h in range(3 + u % 5)]
    tables = {"events": events(spark, rows)}
    for name in ("theme_pairs", "theme_components"):
        got, wanted = against_sql(spark, name, tmp_path, tables)
        assert got == wanted and len(got) > 30


def test_clusters_of_many_points_at_one_place(spark):
    from loomfield.operators import geo

    n = 30_000  # three places, 1e8 pairs each
    p = spark.range(n).select("id", (F.col("id") % 3 * 0.05).cast("double").alias("lat"), F.when(F.col("id") % 3 == 2, 9.0).otherwise(0.0).alias("lng"))
    got = geo.dbscan(p, "id", 15, 3).groupBy((F.col("id") % 3).alias("r"), "cluster", "core").count().collect()
    assert {tuple(r) for r in got} == {(0, 0, True, n // 3), (1, 0, True, n // 3), (2, 2, True, n // 3)}


def test_near_pairs_with_copies(spark, tmp_path):
    keys = [k + 2001 * c for k in (1, 2, 3, 400) for c in range(0, 75, 25)]
    customer = spark.createDataFrame([(k, 0) for k in keys], "c_custkey long, c_nationkey int")
    for name in ("eps_join", "cluster_centroids"):
        got, wanted = against_sql(spark, name, tmp_path, {"customer": customer})
        assert got == wanted and got


def test_closeness_of_many_sources(spark):
    from loomfield.operators import graph

    n = 1500  # more sources than one search takes, in two components
    e = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")).unionByName(spark.createDataFrame([(n + 1, n + 2), (n + 2, n + 3)], "src long, dst long"))
    for depth, reach, far in ((None, n - 1, 2 * sum(range(1, n // 2)) + n // 2), (2, 4, 6)):
        got = {r.node: (r.reachable, r.closeness) for r in graph.closeness(e, depth).collect()}
        assert len(got) == n + 3 and {got[k] for k in range(n)} == {(reach, round(reach / far, 8))}
        assert got[n + 2] == (2, 1.0) and got[n + 1] == (2, round(2 / 3, 8))
    assert graph.closeness(e.limit(0)).count() == 0
