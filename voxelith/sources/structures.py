"""Structure files: PDB and mmCIF atoms, residues, chains, assembly operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Residue classes and the one-letter code.
HYDROPHOBIC = ("ALA", "VAL", "ILE", "LEU", "MET", "PHE", "TRP", "PRO", "TYR", "CYS")
AROMATIC = ("PHE", "TRP", "TYR", "HIS")
ONE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}

# Names of hetero groups that are solvents, buffers, ions or detergents, and no ligands.
SOLVENTS = (
    "ACE", "ACM", "ACT", "ACY", "BIS", "BNG", "BOG", "CA", "CD", "CIT", "CL", "CO", "CU", "DIO", "DMF", "DMS", "DOD", "EDO", "EGL", "FE", "FMT", "GOL", "H2P", "HEP", "HG", "HOH", "HPO", "IPA", "K",
    "MES", "MG", "MN", "NA", "NI", "P33", "P6G", "PE3", "PE4", "PE5", "PE6", "PE7", "PE8", "PEG", "PGO", "PO4", "SF4", "SO4", "SUL", "TAR", "TLA", "TRIS", "TRS", "WAT", "ZN",
)


def is_solvent(name: Column, extras: Sequence[str] = ()) -> Column:
    """Whether a hetero group's name is a solvent's, or one of the caller's extras."""
    return name.isin(*SOLVENTS, *extras)


def without_solvents(hetero: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """Hetero rows that are no solvents, nor, by structure_id and res_name, among a structure's own extras."""
    kept = hetero.where(~is_solvent(F.col("res_name")))
    return kept if extras is None else kept.join(extras.select("structure_id", "res_name").distinct(), ["structure_id", "res_name"], "left_anti")


def is_hydrophobic(name: Column) -> Column:
    return F.upper(name).isin(*HYDROPHOBIC)


def is_aromatic(name: Column) -> Column:
    return F.upper(name).isin(*AROMATIC)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """structure_id (file name without suffix), pos, line. A file is one row before the split: structures are small."""
    whole = spark.read.text(path, wholetext=True).withColumn("structure_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[A-Za-z]+$", 1))
    return whole.select("structure_id", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))


def _atom_columns(lines: DataFrame, *keep: str) -> DataFrame:
    cut = lambda a, b: F.trim(F.substring("line", a, b - a + 1))
    rows = lines.where(F.col("line").startswith("ATOM  ") | F.col("line").startswith("HETATM"))
    out = rows.select(
        *keep, "pos", cut(1, 6).alias("record"), cut(13, 16).alias("name"), F.substring("line", 17, 1).alias("alt"), cut(18, 20).alias("res_name"),
        cut(22, 22).alias("chain_id"), cut(23, 26).try_cast("int").alias("res_seq"), F.substring("line", 27, 1).alias("icode"),
        *(cut(a, a + 7).try_cast("float").alias(c) for c, a in (("x", 31), ("y", 39), ("z", 47))), cut(77, 78).alias("element"),
    )
    return out.where(F.col("res_seq").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())


def raw_atoms(spark: SparkSession, path: str) -> DataFrame:
    """ATOM and HETATM rows of all models by fixed columns; rows that do not parse are skipped."""
    return _atom_columns(_lines(spark, path), "structure_id")


def read_frames(spark: SparkSession, path: str, chain: str | None = None) -> DataFrame:
    """structure_id, frame_idx (from 1), position (from 0), x, y, z of frames that other tools wrote.

    A frame is a model of a file: files are split at the ends of their models,
    so that a long trajectory is read by many tasks. Files named like
    a_model_3.pdb are frames of structure a, in the order of their names, then
    of their models' numbers. Hetero rows are left out; of alternative places
    of an atom the first is taken; position is the atom's place in the frame.
    """
    models = spark.read.text(path, lineSep="ENDMDL").select(F.input_file_name().alias("file"), F.coalesce(F.regexp_extract("value", r"(?m)^MODEL\s+(\d+)", 1).try_cast("int"), F.lit(1)).alias("model"), "value")
    lines = models.select("file", "model", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    atoms = _atom_columns(lines, "file", "model").where("record = 'ATOM'")
    if chain is not None:
        atoms = atoms.where(F.col("chain_id") == chain)
    one = Window.partitionBy("file", "model", "chain_id", "res_seq", "icode", "name").orderBy("pos")
    atoms = atoms.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    order = Window.partitionBy("file", "model").orderBy("pos")
    placed = atoms.select("file", "model", (F.row_number().over(order) - 1).alias("position"), "x", "y", "z")
    stem = F.regexp_extract("file", r"([^/]+?)(_model_[^/]*)?\.[A-Za-z]+$", 1)
    nth = Window.partitionBy("structure_id").orderBy("file", "model")
    frames = placed.select("file", "model", stem.alias("structure_id")).distinct().withColumn("frame_idx", F.row_number().over(nth))
    return placed.join(frames, ["file", "model"]).select("structure_id", "frame_idx", "position", "x", "y", "z")


def read_pdb(spark: SparkSession, path: str, chain: str | None = None) -> DataFrame:
    """Atoms of the first model without hetero rows, with fresh serials and residue indexes from 0.

    Of alternative places of an atom the first is taken.
    """
    ends = _lines(spark, path).where(F.col("line").startswith("ENDMDL")).groupBy("structure_id").agg(F.min("pos").alias("_end"))
    atoms = raw_atoms(spark, path).where("record = 'ATOM'").join(ends, "structure_id", "left").where("_end is null or pos < _end").drop("_end", "record")
    return _numbered(atoms, chain)


def read_mmcif(spark: SparkSession, path: str, chain: str | None = None) -> DataFrame:
    """The same from mmCIF, by author chain, residue number and atom name."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[A-Za-z]+$", 1).alias("structure_id"), "value")

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for r in pdf.itertuples():
                rows = [(r.structure_id, k, *a) for k, a in enumerate(_cif_atoms(r.value))]
                yield pd.DataFrame(rows, columns=["structure_id", "pos", "name", "alt", "res_name", "chain_id", "res_seq", "icode", "x", "y", "z", "element"])

    schema = "structure_id string, pos int, name string, alt string, res_name string, chain_id string, res_seq int, icode string, x float, y float, z float, element string"
    return _numbered(files.mapInPandas(run, schema), chain)


def read_structures(spark: SparkSession, path: str, chain: str | None = None) -> DataFrame:
    """By suffix: .cif and .mmcif as mmCIF, others as PDB."""
    return (read_mmcif if path.lower().endswith((".cif", ".mmcif")) else read_pdb)(spark, path, chain)


def _numbered(atoms: DataFrame, chain: str | None) -> DataFrame:
    if chain is not None:
        atoms = atoms.where(F.col("chain_id") == chain)
    one = Window.partitionBy("structure_id", "chain_id", "res_seq", "icode", "name").orderBy("pos")
    atoms = atoms.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    w = Window.partitionBy("structure_id").orderBy("pos")
    new = (F.coalesce(F.lag(F.struct("chain_id", "res_seq", "icode", "res_name")).over(w) != F.struct("chain_id", "res_seq", "icode", "res_name"), F.lit(True))).cast("int")
    out = atoms.withColumn("serial", F.row_number().over(w) - 1).withColumn("_new", new).withColumn("res_idx", (F.sum("_new").over(w) - 1).cast("int"))
    label = F.concat("res_name", F.col("res_seq").cast("string"), F.lit(":"), "chain_id")
    return out.select("structure_id", "serial", "name", "res_name", "chain_id", "res_seq", "icode", "res_idx", label.alias("res_label"), "x", "y", "z", "element", is_hydrophobic(F.col("res_name")).alias("hydrophobic"), is_aromatic(F.col("res_name")).alias("aromatic"), (F.col("name") == "CA").alias("is_anchor"))


def residues(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("structure_id", "res_idx").agg(*(F.first(c).alias(c) for c in ("chain_id", "res_seq", "res_name", "res_label")))


#: Greatest distance of the bond between a residue's C and the next one's N.
PEPTIDE_BOND = 1.8


def fragments(atoms: DataFrame, bond: float = PEPTIDE_BOND) -> DataFrame:
    """structure_id, chain_id, fragment (from 0), n_residues, sequence: runs of residues that peptide bonds join.

    Gaps and islands: a residue goes on its predecessor's run if both have a
    one-letter code and the predecessor's C lies nearer than `bond` to its N;
    the running sum of breaks numbers the runs. Runs of one residue are no
    peptides and are left out; so are residues without a bond on either side.
    """
    codes = F.create_map(*(F.lit(x) for kv in ONE_LETTER.items() for x in kv))
    place = lambda n: F.first(F.when(F.col("name") == n, F.struct("x", "y", "z")), ignorenulls=True).alias(f"_{n}")
    one = atoms.groupBy("structure_id", "chain_id", "res_idx").agg(F.first("res_name").alias("res_name"), place("C"), place("N"))
    coded = one.withColumn("_code", F.try_element_at(codes, F.upper("res_name")))
    w = Window.partitionBy("structure_id", "chain_id").orderBy("res_idx")
    gap = F.sqrt(sum(((F.col(f"_N.{c}") - F.col(f"_before.{c}")).cast("double") * (F.col(f"_N.{c}") - F.col(f"_before.{c}")).cast("double") for c in "yz"), (F.col("_N.x") - F.col("_before.x")).cast("double") * (F.col("_N.x") - F.col("_before.x")).cast("double")))
    linked = coded.withColumns({"_before": F.lag("_C").over(w), "_coded": F.lag("_code").over(w).isNotNull() & F.col("_code").isNotNull()})
    breaks = linked.withColumn("_break", F.when(F.col("_coded") & F.coalesce(gap < bond, F.lit(False)), 0).otherwise(1))
    runs = breaks.withColumn("_run", F.sum("_break").over(w)).where(F.col("_code").isNotNull())
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("res_idx", "_code"))), lambda s: s["_code"]), "")
    long = runs.groupBy("structure_id", "chain_id", "_run").agg(F.count("*").alias("n_residues"), text.alias("sequence")).where("n_residues > 1")
    nth = Window.partitionBy("structure_id", "chain_id").orderBy("_run")
    return long.select("structure_id", "chain_id", (F.row_number().over(nth) - 1).alias("fragment"), "n_residues", "sequence")


def sequences(atoms: DataFrame, bond: float | None = PEPTIDE_BOND) -> DataFrame:
    """structure_id, chain_id, sequence: the fragments of each chain joined in order; chains without any are left out.

    Without a bond length the residues that have an alpha carbon and a
    one-letter code are joined whatever lies between them.
    """
    if bond is not None:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("fragment", "sequence"))), lambda s: s["sequence"])
        return fragments(atoms, bond).groupBy("structure_id", "chain_id").agg(F.array_join(parts, "").alias("sequence"))
    codes = F.create_map(*(F.lit(x) for kv in ONE_LETTER.items() for x in kv))
    named = atoms.where("is_anchor").withColumn("_c", F.try_element_at(codes, F.upper("res_name"))).where(F.col("_c").isNotNull())
    return named.groupBy("structure_id", "chain_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("res_idx", "_c"))), lambda s: s["_c"]), "").alias("sequence"))


def coords_array(atoms: DataFrame, keys=("structure_id",)) -> DataFrame:
    """Coordinates of each group as one array, in serial order."""
    return atoms.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("serial", "x", "y", "z"))), lambda s: F.array(s["x"], s["y"], s["z"])).alias("coords"))


def read_biomt(spark: SparkSession, path: str) -> DataFrame:
    """Assembly operators of REMARK 350 before the first atom; three rows make one, the last of a number wins."""
    lines = _lines(spark, path)
    first = lines.where(F.col("line").startswith("ATOM  ") | F.col("line").startswith("HETATM")).groupBy("structure_id").agg(F.min("pos").alias("_end"))
    rows = lines.where(F.col("line").rlike(r"^REMARK 350\s+BIOMT[123]")).join(first, "structure_id", "left").where("_end is null or pos < _end")
    p = F.split(F.trim(F.substring("line", 11, 90)), r"\s+")
    parsed = rows.select("structure_id", "pos", F.substring(p[0], 6, 1).cast("int").alias("row"), p[1].try_cast("int").alias("op_id"), *(p[k].try_cast("double").alias(f"v{k - 1}") for k in (2, 3, 4, 5))).where("op_id is not null and v4 is not null")
    last = parsed.groupBy("structure_id", "op_id", "row").agg(F.max_by(F.struct("v1", "v2", "v3", "v4"), "pos").alias("v"))
    wide = last.groupBy("structure_id", "op_id").agg(F.count("*").alias("_n"), *(F.max(F.when(F.col("row") == i, F.col(f"v.v{j}"))).alias(f"r{i}{j}" if j < 4 else f"t{'xyz'[i - 1]}") for i in (1, 2, 3) for j in (1, 2, 3, 4)))
    return wide.where("_n = 3").drop("_n")


def read_oper_list(spark: SparkSession, path: str) -> DataFrame:
    """Assembly operators of mmCIF files."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[A-Za-z]+$", 1).alias("structure_id"), "value")
    names = [f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)] + ["tx", "ty", "tz"]

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                for n, row in enumerate(cif_table(r.value, "_pdbx_struct_oper_list.")):
                    try:
                        rows.append((r.structure_id, int(row.get("id", n + 1)), *(float(row[f"matrix[{i}][{j}]"]) for i in (1, 2, 3) for j in (1, 2, 3)), *(float(row[f"vector[{i}]"]) for i in (1, 2, 3))))
                    except (KeyError, ValueError):
                        continue
            yield pd.DataFrame(rows, columns=["structure_id", "op_id", *names])

    return files.mapInPandas(run, "structure_id string, op_id int, " + ", ".join(f"{n} double" for n in names))


def cif_tokens(text: str) -> list[str]:
    """Tokens of a CIF text: quoted values, multi-line values between semicolons, comments dropped."""
    out, block = [], None
    for line in text.splitlines():
        if block is not None:
            if line.startswith(";"):
                out.append("\n".join(block))
                block = None
            else:
                block.append(line)
        elif line.startswith(";"):
            block = [line[1:]]
        elif "'" in line or '"' in line or "#" in line:
            out += _cif_line(line)
        else:
            out += line.split()
    return out


def _cif_line(line: str) -> list[str]:
    out, at = [], 0
    while at < len(line):
        c = line[at]
        if c.isspace():
            at += 1
        elif c == "#":
            break
        elif c in "'\"":
            end = at + 1
            while end < len(line) and not (line[end] == c and (end + 1 == len(line) or line[end + 1].isspace())):
                end += 1
            out.append(line[at + 1 : end])
            at = end + 1
        else:
            end = at
            while end < len(line) and not line[end].isspace():
                end += 1
            out.append(line[at:end])
            at = end
    return out


def cif_table(text: str, prefix: str) -> list[dict[str, str]]:
    """The rows of a category, written as a loop or as single items."""
    tokens, at, single = cif_tokens(text), 0, {}
    while at < len(tokens):
        if tokens[at] == "loop_":
            names, at = [], at + 1
            while at < len(tokens) and tokens[at].startswith("_"):
                names.append(tokens[at])
                at += 1
            start = at
            while at < len(tokens) and tokens[at] != "loop_" and not (tokens[at].startswith("_") and "." in tokens[at]) and not tokens[at].startswith("data_"):
                at += 1
            if names and names[0].startswith(prefix):
                keys, values = [n[len(prefix) :] for n in names], tokens[start:at]
                return [dict(zip(keys, values[k : k + len(keys)], strict=True)) for k in range(0, len(values) - len(keys) + 1, len(keys))]
        elif tokens[at].startswith(prefix) and at + 1 < len(tokens):
            single[tokens[at][len(prefix) :]] = tokens[at + 1]
            at += 2
        else:
            at += 1
    return [single] if single else []


def _cif_atoms(text: str):
    first = None
    for row in cif_table(text, "_atom_site."):
        model = row.get("pdbx_PDB_model_num", "1")
        first = model if first is None else first
        if model != first or row.get("group_PDB") != "ATOM":
            continue
        try:
            pick = lambda a, b: row.get(a) if row.get(a) not in (None, "?", ".") else row.get(b, "")  # noqa: E731, B023
            icode = row.get("pdbx_PDB_ins_code", "?")
            yield (
                pick("auth_atom_id", "label_atom_id"), row.get("label_alt_id", "."), pick("auth_comp_id", "label_comp_id"), pick("auth_asym_id", "label_asym_id"), int(pick("auth_seq_id", "label_seq_id")),
                " " if icode in "?." else icode, float(row["Cartn_x"]), float(row["Cartn_y"]), float(row["Cartn_z"]), row.get("type_symbol", ""),
            )
        except (KeyError, ValueError):
            continue
