"""Results of a round kept for the next one, so that no round is computed twice."""

from __future__ import annotations

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder that spark.checkpoint.dir names; without one (tests), a cached table."""
    context = df.sparkSession.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if folder and not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return df.checkpoint() if folder or context._jsc.sc().getCheckpointDir().isDefined() else df.persist()
