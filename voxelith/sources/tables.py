"""Tables around structures: external proposals, reports, datasets, benchmark legs, features, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    """Ranked proposals of an external detector from padded CSV; rows that do not parse are skipped.

    Each file has its own header and, where a rank is missing, its own running
    count; structure_id is the file's name without its endings. A missing score
    or probability is 0. Files are read in blocks, and rows carry no more of
    their file than its header.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn")).alias("pos"), F.regexp_replace("value", r"\r$", "").alias("line")).where(F.trim("line") != "")
    cut = lambda c: F.transform(F.split(c, ","), lambda x: F.trim(x))
    heads = lines.groupBy("file").agg(F.min(F.struct("pos", "line")).alias("first")).select("file", F.col("first.pos").alias("top"), cut("first.line").alias("h"))
    named = lines.join(heads, "file").where("pos > top").select("file", "h", "pos", cut("line").alias("v"))
    get = lambda n: F.get("v", (F.array_position("h", n) - 1).cast("int"))
    number = lambda n: get(n).try_cast("double")
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(\.(pdb|cif))?(_predictions)?\.csv$", "")
    rows = named.select("file", name.alias("structure_id"), "pos", number("rank").cast("int").alias("_rank"), F.coalesce(number("score"), F.lit(0.0)).alias("score"), F.coalesce(number("probability"), F.lit(0.0)).alias("probability"), *(number(f"center_{c}").alias(f"p{c}") for c in "xyz"), F.filter(F.split(F.coalesce(get("residue_ids"), F.lit("")), r"\s+"), lambda x: x != "").alias("residue_ids"))
    good = rows.where("px is not null and py is not null and pz is not null")
    return good.withColumn("rank", F.coalesce("_rank", F.row_number().over(Window.partitionBy("file").orderBy("pos")))).drop("_rank", "pos", "file")


def proposals_of_frames(proposals: DataFrame, frame: Column | int | None = None) -> DataFrame:
    """Proposals as `characterize` and discover(proposals=) take them: structure_id, frame_idx, proposal, px, py, pz.

    frame: the frame of each row; by default the number after "_frame" in
    structure_id (which is then left off), else 0. proposal is the place of the
    row in its frame by rank, from 0.
    """
    found = F.regexp_extract("structure_id", r"_frame_?(\d+)$", 1)
    number = F.lit(frame) if isinstance(frame, int) else frame
    rows = proposals.select(
        (F.regexp_replace("structure_id", r"_frame_?\d+$", "") if frame is None else F.col("structure_id")).alias("structure_id"),
        (F.coalesce(found.try_cast("int"), F.lit(0)) if frame is None else number.cast("int")).alias("frame_idx"), "rank", "px", "py", "pz",
    )
    order = Window.partitionBy("structure_id", "frame_idx").orderBy("rank", "px", "py", "pz")
    return rows.select("structure_id", "frame_idx", (F.row_number().over(order) - 1).alias("proposal"), "px", "py", "pz")


def proposal_labels(proposals: DataFrame, residues: DataFrame | None = None) -> DataFrame:
    """Adds residues: A_10 as ALA10:A where a residue table (chain_id, res_seq, res_name, and structure_id if there are several) names it, else 10:A."""
    key = [c for c in ("structure_id", "rank") if c in proposals.columns]
    each = proposals.select(*key, F.posexplode("residue_ids").alias("pos", "rid")).select(*key, "pos", F.regexp_extract("rid", r"^([^_]*)_", 1).alias("chain_id"), F.regexp_extract("rid", r"_(-?\d+)", 1).try_cast("int").alias("res_seq"))
    plain = F.concat(F.col("res_seq").cast("string"), F.lit(":"), F.col("chain_id"))
    if residues is None:
        named = each.withColumn("label", plain)
    else:
        order = "res_idx" if "res_idx" in residues.columns else "res_name"
        place = [c for c in ("structure_id", "chain_id", "res_seq") if c in each.columns and c in residues.columns]
        last = residues.groupBy(*place).agg(F.max_by("res_name", order).alias("res_name"))
        named = each.join(last, place, "left").withColumn("label", F.concat(F.coalesce("res_name", F.lit("")), plain))
    lists = named.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda s: s["label"]).alias("residues"))
    return proposals.join(lists, key, "left")


def read_report(spark: SparkSession, path: str, top: int = 5) -> DataFrame:
    """The first `top` pockets of a report, in file order."""
    report = spark.read.json(path, multiLine=True)
    return report.select("protein", F.posexplode("pockets").alias("pos", "p")).where(F.col("pos") < top).select("protein", "pos", "p.*")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """id and one association a row, of a JSON map from ids to lists of associations."""
    schema = "map<string, array<struct<apo_chain: string, holo_pdb_id: string, holo_chain: string, is_main_holo_structure: boolean, pRMSD: double, apo_pocket_selection: array<string>>>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("id", "found"))
    return whole.select("id", F.explode("found").alias("a")).select("id", "a.*")


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """fold and id, of a JSON map from folds to ids."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("fold", "ids")).select("fold", F.explode("ids").alias("id"))


def read_legs(spark: SparkSession, path: str) -> DataFrame:
    """Detector legs from JSON lines; the last row of each id and tool wins, in order of file and line.

    Files are read in blocks by many tasks: a line's place is the start of its
    block and its turn in the task that reads the block.
    """
    schema = "id string, pdb string, chain string, n_known int, tool string, recall double, jaccard double, n_prop int, elapsed_s double"
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn"), F.from_json("value", schema).alias("r"))
    rows = lines.where("r.id is not null")
    return rows.groupBy("r.id", "r.tool").agg(F.max_by("r", F.struct("file", "block", "turn")).alias("r")).select("r.*")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature tables for re-ranking."""
    return spark.read.csv(path, header=True, inferSchema=True)


def _npy(content: bytes):
    """The array of one .npy file. Arrays of objects are pickles, which would run code, and are refused."""
    import io

    import numpy as np
    from numpy.lib import format as npy

    file = io.BytesIO(content)
    version = npy.read_magic(file)
    shape, fortran, dtype = {(1, 0): npy.read_array_header_1_0, (2, 0): npy.read_array_header_2_0}[version](file)
    if dtype.hasobject:
        raise ValueError("an array of objects")
    n = int(np.prod(shape, dtype=np.int64))
    raw = content[file.tell() :]
    if len(raw) < n * dtype.itemsize:
        raise ValueError(f"{len(raw)} bytes where {n * dtype.itemsize} belong")
    flat = np.frombuffer(raw, dtype, count=n)
    return flat.reshape(shape, order="F").ravel(order="C") if fortran else flat


def npy_values(files: DataFrame, kind: str = "long", rows: int = 1 << 16) -> DataFrame:
    """id, position (from 0, last axis fastest) and value of arrays in files of columns id and content (.npy bytes).

    kind: long (whole numbers and truth values), double or string (of fixed
    width). A file is a row, so that files are read by different tasks; values
    leave a task in batches. Arrays of objects, of another kind, cut short or
    of an unknown version raise an error that names the file; null contents
    give no row.
    """
    import pyarrow as pa

    fits = {"long": "iub", "double": "iubf", "string": "US"}[kind]
    arrow = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[kind]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                if not content.is_valid:
                    continue
                try:
                    flat = _npy(content.as_py())
                    if flat.dtype.kind not in fits:
                        raise ValueError(f"values of type {flat.dtype}")
                except (ValueError, KeyError) as e:
                    raise ValueError(f"{name.as_py()}: {e}") from None
                for at in range(0, len(flat), rows):
                    some = flat[at : at + rows]
                    if some.dtype.kind == "S":
                        values = pa.array([x.decode("latin-1") for x in some.tolist()], arrow)
                    elif kind == "string":
                        values = pa.array(some.tolist(), arrow)
                    else:
                        values = pa.array(some.astype("i8" if kind == "long" else "f8"))
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(some), pa.string()), pa.array(range(at, at + len(some)), pa.int64()), values], names=["id", "position", "value"])

    flat = files.select(F.col("id").cast("string").alias("id"), "content")
    return flat.mapInArrow(run, f"id string, position long, value {'bigint' if kind == 'long' else kind}")


def read_npy(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """npy_values of the .npy files that the path or pattern names; id is the file's name without its ending."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    name = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(.*)\.npy$", 1)
    return npy_values(files.select(name.alias("id"), "content"), kind)


def read_residue_labels(spark: SparkSession, path: str) -> DataFrame:
    """id, position and label (1 cryptic, 0 not, 2 excluded) of label arrays, one .npy file a structure, for by_position."""
    return as_labels(read_npy(spark, path))


def as_labels(values: DataFrame) -> DataFrame:
    return values.select("id", F.col("position").cast("int").alias("position"), F.col("value").cast("int").alias("label"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """id, pdb and chain of an .npy array of names like 1abcA, in order (position)."""
    names = read_npy(spark, path, "string")
    return names.select("position", F.substring("value", 1, 4).alias("pdb"), F.substring("value", 5, 100).alias("chain")).withColumn("id", F.concat("pdb", "chain"))


def labelled_site(residues: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Residues (key, res_idx, res_seq) beside labels by position: key, known_residues, n_residues, n_labels, n_matched, n_excluded.

    Labels beyond the residues and residues beyond the labels are left out.
    Every key that has labels is there, also where no residue is cryptic.
    """
    both = by_position(residues, labels, key)
    found = both.groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(F.col("label") == 1, F.col("res_seq")))).alias("known_residues"), F.count("*").alias("n_matched"), F.count_if(F.col("label") == 2).alias("n_excluded")
    )
    n_res = residues.groupBy(key).agg(F.count("*").alias("n_residues"))
    n_lab = labels.groupBy(key).agg(F.count("*").alias("n_labels"))
    out = n_lab.join(n_res, key, "left").join(found, key, "left").fillna(0, ["n_residues", "n_matched", "n_excluded"])
    none = F.array().cast(dict(found.dtypes)["known_residues"])
    return out.select(key, F.coalesce("known_residues", none).alias("known_residues"), "n_residues", "n_labels", "n_matched", "n_excluded")


def by_position(residues: DataFrame, labels: DataFrame, key: str = "id", order: str = "res_idx") -> DataFrame:
    """Residues beside labels by position; the shorter of the two bounds them."""
    w = Window.partitionBy(key).orderBy(order)
    return residues.withColumn("position", F.row_number().over(w) - 1).join(labels, [key, "position"])


def natural_order(names: DataFrame, column: str) -> DataFrame:
    """Adds number: the first whole number in a file name, so that pocket10 follows pocket9."""
    return names.withColumn("number", F.regexp_extract(column, r"(\d+)", 1).try_cast("int"))


def read_pocket_files(spark: SparkSession, path: str) -> DataFrame:
    """structure_id (file), number and residue numbers of pocket atom files."""
    from voxelith.sources.structures import raw_atoms

    return natural_order(raw_atoms(spark, path).groupBy("structure_id").agg(F.array_sort(F.collect_set("res_seq")).alias("res_seqs")), "structure_id")
