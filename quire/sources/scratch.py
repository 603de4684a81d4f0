"""Tables that are computed once and read again, in a folder that all machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a session in one process may do without that setting."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def once(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions, from a reliable checkpoint: computed once, whatever reads them and whichever executor is lost."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
