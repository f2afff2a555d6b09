"""Cutting a plan: a DataFrame computed once and kept in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, so that a lost executor loses none of it.

    The folder is the session's spark.checkpoint.dir. Only a local session without one gets a folder of its own.

    Spark's own checkpoint keeps the constraints of the plan that it cuts. Those of a loop's rounds grow with a power of their
    number, and the driver then plans for minutes, so the rows are taken as a table of which only the schema is known.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quire-checkpoint-")
        context.setCheckpointDir(folder)
    kept = df.checkpoint()
    return DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), spark)
