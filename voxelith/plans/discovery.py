"""Whole analyses as logical plans: discovery of sites, docking preparation, evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.functions.metrics import distance, headline_hit, jaccard, legacy_hit, recall, residue_numbers, strict_hit
from voxelith.operators import clusters as C
from voxelith.operators.ensembles import assemble, fit_frames, generate, greedy_cluster
from voxelith.operators.evaluation import best_in_top, hit_curve
from voxelith.operators.grid import characterize, detect_pockets
from voxelith.sources.structures import is_solvent
from voxelith.staging import staged


@dataclass(frozen=True)
class Settings:
    """Options of a discovery run."""

    n_conformers: int = 20
    backend: str = "nma"
    detector: str = "alpha"  # alpha, proposals, fusion
    rank_by: str = "crypticity"
    spacing: float = 1.0
    min_volume: float = 80.0
    min_druggability: float = 0.0
    min_persistence: float = 0.0
    min_crypticity: float = 0.0
    top: int = 10
    eps: float = 5.0


def frames_of(atoms: DataFrame, settings: Settings, given: DataFrame | None = None) -> DataFrame:
    """Atoms of every frame with the residue columns that detection needs; frame 0 is the input.

    Frames made elsewhere (given: structure_id, frame_idx from 1, serial, x, y, z) take the place of generated ones;
    with position instead of serial (read_frames) they are fitted to the atoms first.
    """
    if given is None:
        frames = generate(atoms, settings.n_conformers, settings.backend)
    else:
        if "serial" not in given.columns:
            given = fit_frames(atoms, given)
        own = atoms.select("structure_id", F.lit(0).alias("frame_idx"), "serial", "x", "y", "z")
        frames = own.unionByName(given.where("frame_idx > 0").select(F.col("structure_id"), F.col("frame_idx").cast("int").alias("frame_idx"), "serial", "x", "y", "z"))
    about = atoms.select("structure_id", "serial", "res_idx", "res_label", "hydrophobic", "aromatic")
    return frames.join(about, ["structure_id", "serial"])


def detect(frames: DataFrame, settings: Settings, proposals: DataFrame | None = None) -> DataFrame:
    """Pockets of every frame by the chosen detector, with source and source_ord. Without proposals every mode is alpha."""
    if settings.detector not in ("alpha", "proposals", "fusion"):
        raise ValueError(f"unknown detector {settings.detector!r}")
    found = []
    if settings.detector != "proposals" or proposals is None:
        found.append(detect_pockets(frames, spacing=settings.spacing, min_volume=settings.min_volume).withColumn("source", F.lit("alpha")))
    if settings.detector != "alpha" and proposals is not None:
        found.append(characterize(frames, proposals, spacing=settings.spacing).withColumnRenamed("proposal", "pocket_idx").withColumn("source", F.lit("proposals")))
    return C.fused(*found)


def discover(atoms: DataFrame, settings: Settings = Settings(), proposals: DataFrame | None = None, frames: DataFrame | None = None, assembly: DataFrame | None = None) -> DataFrame:
    """Ranked, filtered clusters of pockets over an ensemble of each structure.

    frames: made elsewhere; settings.n_conformers is their number beside the
    input. assembly: operators (structure_id, op_id, r11..r33, tx, ty, tz) by
    which the structures are expanded first. Labelled pockets are written to the
    shared folder, as several aggregates read them.
    """
    if assembly is not None:
        atoms = assemble(atoms, assembly)
    pockets = detect(frames_of(atoms, settings, frames), settings, proposals)
    labelled = staged(greedy_cluster(C.scored(pockets), eps=settings.eps), "pockets")
    found = C.aggregate(labelled, ["structure_id", "cluster_id"], settings.n_conformers + 1)
    ranked = C.ranked(found, settings.rank_by)
    return C.reported(ranked, settings.min_druggability, settings.min_persistence, settings.min_crypticity, settings.top)


def dock_prep(pockets: DataFrame, structure_id: str | None = None, top: int = 5) -> DataFrame:
    """Report pockets (read_report) as clusters again, with every field that the report has; structure_id: by default the report's protein."""
    at = lambda k: F.col("centroid")[k]
    return pockets.where(F.col("pos") < top).select(
        (F.col("protein") if structure_id is None else F.lit(structure_id)).alias("structure_id"), "rank", *(at(k).alias(f"c{c}") for k, c in enumerate("xyz")), F.col("volume_A3").alias("volume"), F.col("volume_range_A3")[0].alias("volume_min"), F.col("volume_range_A3")[1].alias("volume_max"),
        F.col("apo_volume_A3").alias("apo_volume"), "druggability", "max_druggability", "persistence", "cryptic", "crypticity", "lining_residues", "appears_in_conformers",
    )


def evaluate(clusters: DataFrame, targets: DataFrame, top: int = 5, ks: Sequence[int] = (1, 3, 5, 10, 20)) -> DataFrame:
    """Per target (structure_id, known_residues, rx, ry, rz): best overlap and distance in the top, criteria, hit curve."""
    joined = clusters.join(targets, "structure_id")
    numbers = residue_numbers(F.col("lining_residues"))
    rows = joined.select("structure_id", "rank", jaccard(numbers, F.col("known_residues")).alias("jaccard"), recall(numbers, F.col("known_residues")).alias("recall"), distance(*(F.col(f"c{c}") for c in "xyz"), *(F.col(f"r{c}") for c in "xyz")).alias("distance"))
    hit = headline_hit(F.col("jaccard"), F.col("distance"))
    best = best_in_top(rows, ["structure_id"], "jaccard", top).withColumnsRenamed({"best": "jaccard", "best_rank": "jaccard_rank"})
    rec = best_in_top(rows, ["structure_id"], "recall", top).withColumnsRenamed({"best": "recall", "best_rank": "recall_rank"})
    near = rows.where(F.col("rank") <= top).groupBy("structure_id").agg(F.min("distance").alias("distance"))
    out = targets.select("structure_id").join(best, "structure_id", "left").join(rec, "structure_id", "left").join(near, "structure_id", "left").join(hit_curve(rows, ["structure_id"], hit, ks), "structure_id", "left")
    out = out.fillna({"jaccard": 0.0, "recall": 0.0}).withColumn("distance", F.coalesce("distance", F.lit(float("inf"))))
    return out.withColumns({"headline": headline_hit(F.col("jaccard"), F.col("distance")), "strict": strict_hit(F.col("jaccard"), F.col("distance")), "legacy": legacy_hit(F.col("recall"), F.col("distance"))})


def size_gate(atoms: DataFrame, low: int = 0, high: int = 600) -> DataFrame:
    """Atoms of the structures with low to high residues."""
    counts = atoms.groupBy("structure_id").agg(F.countDistinct("res_idx").alias("_n")).where(F.col("_n").between(low, high)).select("structure_id")
    return atoms.join(counts, "structure_id", "left_semi")


def known_site(hetero: DataFrame, protein: DataFrame, solvents: Column | None = None, radius: float = 4.5) -> DataFrame:
    """Residues of each structure within radius of its principal ligand: structure_id and known_residues.

    solvents: which hetero rows are none, by default those of is_solvent.
    """
    from voxelith.operators.evaluation import principal_group
    from voxelith.operators.spatial import range_join

    kept = hetero.where(~(is_solvent(F.col("res_name")) if solvents is None else solvents)).withColumn("ligand", F.concat_ws("/", "chain_id", "res_name", F.col("res_seq").cast("string")))
    main = principal_group(kept, ["structure_id"], "ligand", "pos")
    ligand = kept.join(main.select("structure_id", "ligand"), ["structure_id", "ligand"], "left_semi").select("structure_id", F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("z").alias("lz"))
    near = range_join(protein, ligand, radius, right_xyz=("lx", "ly", "lz"), on=["structure_id"], how="left_semi")
    return near.groupBy("structure_id").agg(F.array_sort(F.collect_set("res_seq")).alias("known_residues"))
