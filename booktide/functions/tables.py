"""Where a plan is cut, so that what is used many times is made once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def held(df: DataFrame) -> DataFrame:
    """df computed once and written to the checkpoint folder that all machines share; later steps read it. Only a local master gets a folder of our own."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        at = context.getConf().get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster checkpoints need a folder that all machines share")
        context.setCheckpointDir(at or "file:///tmp/checkpoints/booktide")
    return df.checkpoint()
