"""Cutting a plan where what follows reads it more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: a checkpoint where the session names a folder for them, else kept by Spark and recomputable."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()
