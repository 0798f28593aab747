"""Aggregation of pockets to clusters over frames, ranking and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.functions.scoring import crypticity, decimals, druggability, rank_key


def scored(pockets: DataFrame) -> DataFrame:
    """Adds score, the composite druggability, to pockets."""
    return pockets.withColumn("score", druggability()["composite"])


def cluster_stats(pockets: DataFrame, keys: Sequence[str], n_frames: Column | int) -> DataFrame:
    """Centroid, volumes, apo volume, persistence, frames and best score of each cluster; one partial aggregate."""
    n = F.lit(n_frames) if isinstance(n_frames, int) else n_frames
    stats = pockets.groupBy(*keys).agg(
        *(F.avg(c).alias(c) for c in ("cx", "cy", "cz")),
        decimals(F.avg("volume"), 1).alias("volume"),
        F.round(F.min("volume"), 1).alias("volume_min"),
        F.round(F.max("volume"), 1).alias("volume_max"),
        F.round(F.coalesce(F.max(F.when(F.col("frame_idx") == 0, F.col("volume"))), F.lit(0.0)), 1).alias("apo_volume"),
        F.max("score").alias("max_druggability"),
        F.array_sort(F.collect_set("frame_idx")).alias("appears_in_conformers"),
        F.count("*").alias("n_members"),
    )
    share = F.size("appears_in_conformers") / F.greatest(n, F.lit(1))
    return stats.withColumn("persistence", decimals(share, 3)).withColumn("cryptic", share < 0.9).withColumn("crypticity", crypticity())


def representative(pockets: DataFrame, centroids: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keys and druggability: the score of the member nearest to the centroid, the first in order on ties."""
    c = centroids.select(*keys, *(F.col(x).alias(f"_{x}") for x in ("cx", "cy", "cz")))
    d2 = sum(((F.col(x) - F.col(f"_{x}")) * (F.col(x) - F.col(f"_{x}")) for x in ("cy", "cz")), (F.col("cx") - F.col("_cx")) * (F.col("cx") - F.col("_cx")))
    near = pockets.join(c, list(keys)).withColumn("_d", F.round(d2, 9))
    return near.groupBy(*keys).agg(F.min_by("score", F.struct("_d", *order)).alias("druggability"))


def consensus_labels(members: DataFrame, keys: Sequence[str], frame: str, labels: str, share: float = 0.5) -> DataFrame:
    """Labels borne by at least share x distinct frames of members (members count, not frames), sorted as text."""
    frames = members.groupBy(*keys).agg(F.countDistinct(frame).alias("_n"))
    counts = members.select(*keys, F.explode(labels).alias("_label")).groupBy(*keys, "_label").agg(F.count("*").alias("_c"))
    kept = counts.join(frames, list(keys)).where(F.col("_c") >= share * F.col("_n"))
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list("_label")).alias("lining_residues"))


def aggregate(pockets: DataFrame, keys: Sequence[str], n_frames: Column | int, order: Sequence[str] = ("frame_idx", "source_ord", "pocket_idx")) -> DataFrame:
    """Clusters of labelled pockets: statistics, representative score and consensus labels."""
    known = pockets if "score" in pockets.columns else scored(pockets)
    stats = cluster_stats(known, keys, n_frames)
    out = stats.join(representative(known, stats, keys, order), list(keys))
    if "lining_residues" in pockets.columns:
        out = out.join(consensus_labels(known, keys, "frame_idx", "lining_residues"), list(keys), "left")
        out = out.withColumn("lining_residues", F.coalesce("lining_residues", F.array().cast("array<string>")))
    return out


def ranked(clusters: DataFrame, strategy: str = "crypticity", partition: Sequence[str] = ("structure_id",)) -> DataFrame:
    """Adds rank: by the strategy's key, then best druggability, then order of creation."""
    w = Window.partitionBy(*partition).orderBy(F.desc(rank_key(strategy)), F.desc("max_druggability"), F.asc("cluster_id"))
    return clusters.withColumn("rank", F.row_number().over(w))


def reported(clusters: DataFrame, min_druggability: float = 0.0, min_persistence: float = 0.0, min_crypticity: float = 0.0, top: int = 10, partition: Sequence[str] = ("structure_id",)) -> DataFrame:
    """Filters after ranking (the representative's druggability counts), then the first `top`; ranks are not renumbered."""
    kept = clusters.where((F.col("druggability") >= min_druggability) & (F.col("persistence") >= min_persistence) & (F.col("crypticity") >= min_crypticity))
    w = Window.partitionBy(*partition).orderBy("rank")
    return kept.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).drop("_n")


def volume_band(pockets: DataFrame, low: float = 80.0, high: float = 1500.0) -> DataFrame:
    return pockets.where(F.col("volume").between(low, high))


def fused(*sources: DataFrame) -> DataFrame:
    """Bag union of detectors in order, with source_ord."""
    out = None
    for k, s in enumerate(sources):
        s = s.withColumn("source_ord", F.lit(k))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out
