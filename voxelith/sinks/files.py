"""Reports, PDB, YAML, box and table outputs. Text is built as columns; a structure's file is one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRYPTIC_LIMIT = 0.3


def report_pocket() -> Column:
    """A cluster as it stands in reports: renamed and rounded."""
    r = F.round
    return F.struct(
        "rank", F.array(r("cx", 3), r("cy", 3), r("cz", 3)).alias("centroid"), r("volume", 1).alias("volume_A3"), F.array(r("volume_min", 1), r("volume_max", 1)).alias("volume_range_A3"),
        r("apo_volume", 1).alias("apo_volume_A3"), *(r(c, 3).alias(c) for c in ("druggability", "max_druggability", "persistence")), "cryptic", r("crypticity", 3).alias("crypticity"), "lining_residues", "appears_in_conformers",
    )


def reports(clusters: DataFrame, n_conformers: int, ranked_by: str) -> DataFrame:
    """structure_id and report (JSON) of ranked clusters."""
    out = clusters.groupBy("structure_id").agg(F.count("*").alias("n"), F.count_if(F.col("crypticity") >= CRYPTIC_LIMIT).alias("c"), F.array_sort(F.collect_list(report_pocket())).alias("pockets"))
    body = F.struct(F.col("structure_id").alias("protein"), F.lit(n_conformers).alias("n_conformers"), F.lit(ranked_by).alias("ranked_by"), F.col("n").alias("n_pockets_found"), F.col("c").alias("n_cryptic_pockets"), "pockets")
    return out.select("structure_id", F.to_json(body).alias("report"))


def all_reports(structures: DataFrame, clusters: DataFrame, n_conformers: int, ranked_by: str) -> DataFrame:
    """reports() of every structure, also of those without clusters."""
    none = F.to_json(F.struct(F.col("structure_id").alias("protein"), F.lit(n_conformers).alias("n_conformers"), F.lit(ranked_by).alias("ranked_by"), F.lit(0).alias("n_pockets_found"), F.lit(0).alias("n_cryptic_pockets"), F.array().cast("array<string>").alias("pockets")))
    return structures.join(reports(clusters, n_conformers, ranked_by), "structure_id", "left").select("structure_id", F.coalesce("report", none).alias("report"))


def sphere_radius(volume: Column) -> Column:
    return F.pow(3 * volume / (4 * 3.14159), F.lit(1 / 3))


def pocket_pdb(clusters: DataFrame) -> DataFrame:
    """structure_id, rank, line_no, line: seven pseudo-atoms a cluster, the centre and one radius along each axis."""
    r = sphere_radius(F.col("volume"))
    at = F.array(*(F.struct(F.lit(n).alias("n"), *((F.col(f"c{c}") + float(sign * (c == axis)) * r).alias(c) for c in "xyz")) for n, (axis, sign) in enumerate([("", 0), ("x", 1), ("x", -1), ("y", 1), ("y", -1), ("z", 1), ("z", -1)], 1)))
    rows = clusters.select("structure_id", "rank", "druggability", F.explode(at).alias("a"))
    line = F.format_string("HETATM%5d  %-3s POC P%4d    %8.3f%8.3f%8.3f  1.00%6.2f           C", (F.col("rank") - 1) * 7 + F.col("a.n"), F.when(F.col("a.n") == 1, "C").otherwise(F.concat(F.lit("C"), F.col("a.n").cast("string"))), F.col("rank"), F.col("a.x"), F.col("a.y"), F.col("a.z"), F.col("druggability"))
    return rows.select("structure_id", "rank", F.col("a.n").alias("line_no"), line.alias("line"))


def contacts(clusters: DataFrame) -> DataFrame:
    """structure_id, rank, chain, numbers: the lining residues by chain, sorted."""
    each = clusters.select("structure_id", "rank", F.explode("lining_residues").alias("l"))
    cut = each.select("structure_id", "rank", F.element_at(F.split("l", ":"), -1).alias("chain"), F.regexp_replace(F.split("l", ":")[0], r"[^0-9]", "").try_cast("int").alias("number")).where("number is not null")
    return cut.groupBy("structure_id", "rank", "chain").agg(F.array_sort(F.collect_set("number")).alias("numbers"))


def constraint_yaml(clusters: DataFrame, chains: DataFrame) -> DataFrame:
    """structure_id, rank, text: chains with sequences, a ligand to fill in, and the pocket's contacts by chain."""
    seq = chains.groupBy("structure_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chain_id", "sequence"))), lambda c: F.concat(F.lit("  - protein:\n      id: "), c["chain_id"], F.lit("\n      sequence: "), c["sequence"])), "\n").alias("seqs"))
    con = contacts(clusters).groupBy("structure_id", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chain", "numbers"))), lambda c: F.array_join(F.transform(c["numbers"], lambda n: F.concat(F.lit("        - ["), c["chain"], F.lit(", "), n.cast("string"), F.lit("]"))), "\n")), "\n").alias("con"))
    text = F.concat(F.lit("sequences:\n"), "seqs", F.lit("\n  - ligand:\n      id: LIG\n      smiles: SMILES_HERE\nconstraints:\n  - pocket:\n      binder: LIG\n      contacts:\n"), "con", F.lit("\n"))
    return con.join(seq, "structure_id").select("structure_id", "rank", text.alias("text"))


def structure_pdb(atoms: DataFrame) -> DataFrame:
    """structure_id, serial, line: fixed-width ATOM rows, with insertion codes where there are any; numbers begin again at 0 after 99999, as five columns hold no more."""
    name = F.when(F.length("name") < 4, F.concat(F.lit(" "), F.rpad("name", 3, " "))).otherwise(F.substring("name", 1, 4))
    icode = F.when(F.length(F.trim("icode")) == 1, F.col("icode")).otherwise(F.lit(" ")) if "icode" in atoms.columns else F.lit(" ")
    line = F.format_string("ATOM  %5d %s %3s %s%4d%s   %8.3f%8.3f%8.3f  1.00  0.00          %2s", F.pmod(F.col("serial") + 1, F.lit(100000)), name, "res_name", F.substring("chain_id", 1, 1), "res_seq", icode, F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double"), "element")
    return atoms.select("structure_id", "serial", line.alias("line"))


def vina_box(clusters: DataFrame, padding: float = 8.0) -> DataFrame:
    """structure_id, rank, text: docking box around each cluster."""
    size = 2 * (sphere_radius(F.col("volume")) + padding)
    text = F.format_string("center_x = %.3f\ncenter_y = %.3f\ncenter_z = %.3f\nsize_x = %.3f\nsize_y = %.3f\nsize_z = %.3f\nexhaustiveness = 8\nnum_modes = 9\n", "cx", "cy", "cz", size, size, size)
    return clusters.select("structure_id", "rank", text.alias("text"))


def console(clusters: DataFrame) -> DataFrame:
    """The table that a terminal shows."""
    whole = lambda c: F.bround(c, 0)  # noqa: E731  half to even
    volume = F.when(F.col("volume_max") - F.col("volume_min") > 50, F.format_string("%.0f -> %.0f", whole("apo_volume"), whole("volume_max"))).otherwise(F.format_string("%.0f", whole("volume")))
    more = F.size("lining_residues") - 5
    names = F.concat(F.array_join(F.slice("lining_residues", 1, 5), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(")"))).otherwise(F.lit("")))
    return clusters.select("rank", F.greatest("druggability", "max_druggability").alias("druggability"), "crypticity", F.format_string("%.0f%%", F.col("persistence") * 100).alias("persistence"), volume.alias("volume"), names.alias("residues"))


def results_json(rows: DataFrame, key: str) -> DataFrame:
    """The key and result: each row as a JSON object; null fields stay."""
    return rows.select(key, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("result"))


def write_results(rows: DataFrame, path: str) -> None:
    """Per-target rows as JSON lines, a file a partition; null fields stay."""
    rows.write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def not_done(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys the sink does not have yet."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def append_new(rows: DataFrame, path: str, keys: Sequence[str], fmt: str = "json") -> None:
    """Append the rows that are new to a sink of JSON lines, CSV or Parquet."""
    spark = rows.sparkSession
    try:
        done = spark.read.format(fmt).options(header="true").schema(rows.schema).load(path)
        rows = not_done(rows, done, keys)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.format(fmt).options(header="true").mode("append").save(path)


def write_text(rows: DataFrame, path: str, order: Sequence[str], line: str = "line") -> None:
    """Lines of each structure as text files in folders by structure, in order."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    rows.repartition(n, "structure_id").sortWithinPartitions("structure_id", *order).select("structure_id", F.col(line).alias("value")).write.partitionBy("structure_id").mode("overwrite").text(path)


def write_files(rows: DataFrame, path: str, keys: Sequence[str], text: str = "text") -> None:
    """A text of each row as a file in folders by its keys."""
    rows.select(*keys, F.col(text).alias("value")).write.partitionBy(*keys).mode("overwrite").text(path)
