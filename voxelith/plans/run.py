"""Whole runs from files to files: assembly, discovery, every output, docking inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.operators.ensembles import assemble
from voxelith.plans.discovery import Settings, discover, dock_prep
from voxelith.sinks import files as K
from voxelith.sources import structures as R
from voxelith.sources.tables import read_report
from voxelith.staging import staged

OUTPUTS = ("pockets", "constraints", "boxes")


def assembled(spark: SparkSession, path: str, atoms: DataFrame) -> DataFrame:
    """The biological assemblies of structures by the operators that their files name; others stay as they are."""
    operators = (R.read_oper_list if path.lower().endswith((".cif", ".mmcif")) else R.read_biomt)(spark, path)
    return assemble(atoms, operators)


def _write(clusters: DataFrame, chains: DataFrame, path: str, kinds: Sequence[str]) -> None:
    unknown = set(kinds) - set(OUTPUTS)
    if unknown:
        raise ValueError(f"unknown outputs {sorted(unknown)}; any of {OUTPUTS}")
    if "pockets" in kinds:
        lines = K.pocket_pdb(clusters).groupBy("structure_id", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
        K.write_files(lines, f"{path}/pockets", ["structure_id", "rank"])
    if "constraints" in kinds:
        K.write_files(K.constraint_yaml(clusters, chains), f"{path}/constraints", ["structure_id", "rank"])
    if "boxes" in kinds:
        K.write_files(K.vina_box(clusters), f"{path}/boxes", ["structure_id", "rank"])


def analyze(spark: SparkSession, path: str, output: str, settings: Settings = Settings(), assembly: bool = False, emit: Sequence[str] = OUTPUTS, proposals: DataFrame | None = None, frames: DataFrame | None = None) -> DataFrame:
    """Discovery over all structures that the path or pattern names; its clusters, written under output.

    Output: reports (a JSON report for each structure, also for those without
    a site), and by emit pockets (pseudo-atoms), constraints (YAML) and boxes,
    a file a site in folders structure_id=/rank=. With assembly, structures are
    expanded first and written to assemblies.
    """
    atoms = R.read_structures(spark, path)
    if assembly:
        atoms = staged(assembled(spark, path, atoms), "assembled")
        K.write_text(K.structure_pdb(atoms), f"{output}/assemblies", ["serial"])
    found = staged(discover(atoms, settings, proposals, frames), "sites")
    K.write_files(K.all_reports(atoms.select("structure_id").distinct(), found, settings.n_conformers + 1, settings.rank_by), f"{output}/reports", ["structure_id"], "report")
    _write(found, R.sequences(atoms) if "constraints" in emit else None, output, emit)
    return found


def prepare_docking(spark: SparkSession, reports: str, structures: str, output: str, formats: Sequence[str] = OUTPUTS, top: int = 5) -> DataFrame:
    """Docking inputs of the first `top` sites of each report, under output as analyze writes them; the sites."""
    listed = read_report(spark, reports, top)
    sites = staged(dock_prep(listed, None, top), "sites")
    _write(sites, R.sequences(R.read_structures(spark, structures)) if "constraints" in formats else None, output, formats)
    return sites
