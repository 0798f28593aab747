"""Scoring of pockets as they arrive. The reference data are batches; this is the same expressions on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.operators.clusters import scored, volume_band


def scored_stream(pockets: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Count, best and mean score of pockets (with ts) by event-time window and structure, late rows dropped."""
    good = scored(volume_band(pockets)).withWatermark("ts", watermark)
    return good.groupBy(F.window("ts", window), "structure_id").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.avg("score").alias("mean"))
