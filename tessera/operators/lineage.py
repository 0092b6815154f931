"""Cutting lineage in iterative plans."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the session names. Without one: a folder of this machine in local mode, else
    an error."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "tessera-checkpoints"))
    return df.checkpoint(eager=True)
