"""Plans that are used several times."""

from __future__ import annotations

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df computed once in the session's checkpoint folder, where it has one; else df as it is."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() is not None else df
