"""The corpus pipeline: language ID, exact dedup, MinHash near-dedup, PII surrogates, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a driver may write it and hand what it reads again to
the next stage. All but the last return the columns of documents, so any run of stages can be left out or put elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.chosen_path import drop_near_copies
from loomfield.llm.exact_dedup import drop_repeats
from loomfield.llm.langid import accepted
from loomfield.llm.packing import pack
from loomfield.llm.pii import replace_pii
from loomfield.llm.queries import PII_KEY


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no learned language, go."""
    return accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without white space, the one with the most code points stays."""
    return drop_repeats(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity 0.8 on five-word shingles, the one with the smallest id stays."""
    return drop_near_copies(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by surrogates; n_chars follows the text."""
    out = replace_pii(docs, PII_KEY)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bins."""
    return pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("pii", pii), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
