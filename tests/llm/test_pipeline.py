"""The corpus pipeline and the SQL of the training-data queries on small tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomfield.llm import common, queries

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def table(spark):
    text = " ".join(f"word{k}" for k in range(80))
    rows = [
        (1, text, "en", "a", 1), (2, text + " ", "en", "b", 1), (3, text.replace("word7 ", "other "), "en", "c", 1), (4, "### 123", "en", "a", 1), (5, None, None, None, None),
        (6, "mail bob.smith@mail1.example.com please, this is a clean letter", "en", "d", 1), (7, "eine saubere Nachricht mit einigen Wörtern", "de", "a", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    docs = table(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = sorted(r.doc_id for r in out.collect())
    assert kept == {"language_id": [1, 2, 3, 6, 7], "exact_dedup": [2, 3, 6, 7], "near_dedup": [2, 6, 7], "pii": [2, 6, 7], "packing": [2, 6, 7]}
    letter = docs.filter("doc_id = 6").first()
    assert "bob.smith" not in letter.text and letter.n_chars == len(letter.text)


def test_language_stage_rejects_unlearned(spark):
    """Scripts and languages that no label teaches, and letter junk, go; clean documents stay, held out or not."""
    import random

    rng = random.Random(4)
    words = {"en": "the house and river were quiet while people walked home through long green fields", "de": "das haus und der fluss waren still während leute durch lange grüne felder nach hause gingen"}
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(40)), lang) for i in range(160) for lang in [("en", "de")[i % 2]]]
    junk = ["Это письмо написано на русском языке", "这是一封用中文写的信内容相当长", "qxzjk vwbpq zzxkj qjxvk wpbzq jkqxz", "".join(rng.choice("BCDFGHJKLMNPQRSTVWXZbcdfghjklmnpqrstvwxz") for _ in range(300))]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows + [(1000 + k, t, None) for k, t in enumerate(junk)]], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()) == list(range(160))


@pytest.mark.parametrize("stage", ["exact_dedup", "near_dedup"])
def test_stages_drop_rows_not_ids(spark, stage):
    """One row of a null or repeated id is a copy; the others of that id stay."""
    text = " ".join(f"word{k}" for k in range(30))
    other = [f"{name} " + " ".join(f"{name}{k}" for k in range(30)) for name in ("left", "right", "third")]
    rows = [(1, text), (None, text), (None, other[0]), (None, None), (4, text), (4, other[1]), (5, other[2])]
    if stage == "near_dedup":
        rows += [(6, text + " new"), (6, "another " + other[0].replace("left", "also")), (7, other[2] + " new"), (7, other[2] + " newer")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)[stage](spark, docs, "").collect()]
    expected = [(1, text), (None, other[0]), (None, None), (4, other[1]), (5, other[2])]
    if stage == "near_dedup":  # which gives a null id no links
        expected += [(None, text), (6, "another " + other[0].replace("left", "also"))]
    assert sorted(left, key=repr) == sorted(expected, key=repr)


def test_rows_go_by_filter_and_shuffle(spark, monkeypatch):
    """With more dropped rows than may be broadcast, the same rows go; those that the filter clears are not shuffled."""
    docs = spark.createDataFrame([(None if i % 50 == 0 else i // 2, f"text {i % 700}", f"x{i}") for i in range(2000)], "doc_id long, text string, __maybe_dropped string")
    dropped = docs.filter("abs(hash(text)) % 5 = 0").select("doc_id", F.xxhash64("text").alias("raw"))
    few = {r["__maybe_dropped"] for r in common.without_rows(docs, dropped, "doc_id", "text").collect()}
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    many = common.without_rows(docs, dropped, "doc_id", "text")
    assert many.columns == docs.columns and sorted(r["__maybe_dropped"] for r in many.collect()) == sorted(few)
    assert 0 < len(few) < 2000
    assert common.without_rows(docs, dropped.limit(0), "doc_id", "text").count() == 2000


def test_stages_with_clashing_names(spark):
    clash = ["id", "path", "n", "key", "sketch", "sha", "h", "maybe", "kept", "raw", "shard", "score", "component", "row", "found", "pattern", "at", "__lang_pred", "lang_pred", "familiar", "__dropped_id", "__dropped_hash", "length", "bin_id"]
    docs = table(spark).withColumns({c: F.lit(f"x{c}") for c in clash})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == docs.columns
            assert all(r[c] == f"x{c}" for r in out.collect() for c in clash)
            docs = spark.createDataFrame(out.collect(), docs.schema)
    assert sorted({r.doc_id for r in out.collect()}) == [2, 6, 7]


def test_stages_on_nothing(spark):
    docs = table(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


@needs_tables
def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.select("doc_id").distinct().count() <= spark.read.parquet(f"{SF}/documents.parquet").count()


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    import duckdb

    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert rows
    sql = queries.oracle_sql().get(name)
    if sql is None:
        return
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(r[names.index(k)] for k in columns) for r in found.fetchall()), key=repr)


def test_split_of_large_texts(spark):
    docs = spark.createDataFrame([(1, "a " * 5000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.packing(spark, docs, "").agg(F.sum("piece_length")).first()[0] == 5000


@needs_tables
def test_run_brute_force(spark):
    """What each stage keeps of the real documents, against brute force on the stage's own input."""
    from test_operators import brute_exact, brute_near

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, SF).select("doc_id", "text").collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    rows = [(r.doc_id, r.text) for r in kept]
    alive = {i for i, _, _, stays, _ in brute_exact(rows) if stays}
    rows = [x for x in rows if x[0] in alive]
    components = brute_near(rows, 5, 80)
    alive = {i for i, (_, c) in components.items() if c == i}
    found = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in found.select("doc_id").distinct().collect()} == alive
    words = {i: len((t or "").split()) for i, t in rows}
    got = {r.doc_id: r.n for r in found.groupBy("doc_id").agg(F.sum("piece_length").alias("n")).collect()}
    assert sum(got.values()) == pytest.approx(sum(words[i] for i in alive), rel=0.02)  # surrogates may have more words
