"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Only in local mode (tests on one machine), where it may be unset, a temporary folder takes its place; on a cluster
    a folder of one machine would be lost with it, so an unset one is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return tempfile.mkdtemp(prefix="loomfield-checkpoint-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, cut from its lineage by reliable files in the shared folder, and from the size that Spark guesses for it.

    A checkpoint keeps the guess, and a join multiplies those of its sides: in a loop the number's digits grow several times
    a round, until it fills the driver's memory. After an explode the guess may be too low for a broadcast to fit. Without
    one, only sides that are hinted, or found small when they run, are broadcast.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))
    cut = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(cut.queryExecution().logical().rdd(), cut.schema(), False), spark)
