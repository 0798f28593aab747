"""Evaluation predicates: set overlap, localisation and hit criteria, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADLINE_JACCARD, HEADLINE_DISTANCE, STRICT_DISTANCE, LEGACY_RECALL = 0.25, 4.0, 6.0, 0.30


def recall(found: Column, known: Column) -> Column:
    """Share of known in found (arrays); 0 where known is empty."""
    k = F.array_distinct(known)
    return F.when(F.size(k) > 0, F.size(F.array_intersect(found, k)) / F.size(k)).otherwise(F.lit(0.0))


def jaccard(found: Column, known: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    union = F.size(F.array_union(found, known))
    return F.when(union > 0, F.size(F.array_intersect(found, known)) / union).otherwise(F.lit(0.0))


def distance(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    """Euclidean distance; infinite where either point is missing."""
    d = F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by) + (az - bz) * (az - bz))
    return F.coalesce(d, F.lit(float("inf")))


def headline_hit(jac: Column, dist: Column) -> Column:
    return (jac >= HEADLINE_JACCARD) | (dist <= HEADLINE_DISTANCE)


def strict_hit(jac: Column, dist: Column) -> Column:
    return (jac >= HEADLINE_JACCARD) & (dist <= STRICT_DISTANCE)


def legacy_hit(rec: Column, dist: Column) -> Column:
    return (rec >= LEGACY_RECALL) | (dist <= HEADLINE_DISTANCE)


def overlap_hit(value: Column, threshold: float) -> Column:
    """Head-to-head criteria have no distance clause: Jaccard or recall alone."""
    return value >= threshold


def residue_numbers(labels: Column, signed: bool = False) -> Column:
    """Numbers of labels like ALA123:A, sorted and distinct. Digits alone by default; signed keeps a minus."""
    number = F.regexp_extract
    pattern = r"(-?\d+)[A-Za-z]?(?::|$)"
    if signed:
        each = F.transform(labels, lambda x: number(F.split(x, ":")[0], pattern, 1).try_cast("int"))
    else:
        each = F.transform(labels, lambda x: F.regexp_replace(F.split(x, ":")[0], r"[^0-9]", "").try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(each, lambda x: x.isNotNull())))


def residue_label(name: Column, number: Column, chain: Column) -> Column:
    """ALA123:A."""
    return F.concat(name, number.cast("string"), F.lit(":"), chain)
