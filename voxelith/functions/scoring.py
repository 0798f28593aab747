"""Druggability, crypticity and rank keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decimals(c: Column, places: int) -> Column:
    """Rounded half up as a decimal: noise in the last bits does not move a tie."""
    return F.round(F.round(c, 9), places)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def druggability(volume="volume", enclosure="enclosure", hydrophobic="hydrophobic_fraction", aromatic="aromatic_count") -> Column:
    """Struct of four components and their composite, each rounded to 4 places; the composite is of unrounded parts."""
    v, e, h, a = (_col(c).cast("double") for c in (volume, enclosure, hydrophobic, aromatic))
    parts = {
        "volume_score": F.exp(-(v - 300) * (v - 300) / (2 * 200.0 * 200.0)),
        "enclosure_score": clip(e, 0.0, 1.0),
        "hydrophobic_score": h,
        "aromatic_score": F.least(a / 5, F.lit(1.0)),
    }
    weights = (0.35, 0.30, 0.25, 0.10)
    composite = sum((w * c for w, c in zip(weights[1:], list(parts.values())[1:], strict=True)), weights[0] * parts["volume_score"])
    return F.struct(*(decimals(c, 4).alias(k) for k, c in parts.items()), decimals(composite, 4).alias("composite"))


def crypticity(apo_volume="apo_volume", volume_max="volume_max", max_druggability="max_druggability") -> Column:
    """How far a site opens beyond its input volume, weighted by its best druggability; 0 where it has no volume."""
    apo, most, drug = _col(apo_volume), _col(volume_max), _col(max_druggability)
    return F.when(most <= 0, F.lit(0.0)).otherwise(decimals(clip((most - apo) / most, 0.0, 1.0) * drug, 4))


RANK_KEYS = {
    "persistence": lambda: F.col("persistence") * F.col("druggability"),
    "balanced": lambda: F.col("max_druggability") * (0.5 + 0.5 * F.col("persistence")),
    "druggability": lambda: F.col("max_druggability"),
    "crypticity": lambda: F.col("crypticity"),
}


def rank_key(strategy: str = "crypticity") -> Column:
    """The column that a ranking strategy sorts by, largest first."""
    if strategy not in RANK_KEYS:
        raise ValueError(f"unknown ranking strategy {strategy!r}; one of {sorted(RANK_KEYS)}")
    return RANK_KEYS[strategy]()
