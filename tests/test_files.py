"""Readers and writers on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from voxelith.plans.discovery import dock_prep
from voxelith.sinks import files as K
from voxelith.sources import structures as S
from voxelith.sources import tables as T


def atom(n, name, res, chain, seq, x, y, z, record="ATOM  ", icode=" ", alt=" "):
    shown = f" {name:<3s}" if len(name) < 4 else name
    return f"{record}{n:5d} {shown}{alt}{res:>3s} {chain}{seq:4d}{icode}   {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00           {name[0]}"


@pytest.fixture
def pdb(tmp_path):
    lines = ["REMARK 350   BIOMT1   1  1.000000  0.000000  0.000000        0.00000", "REMARK 350   BIOMT2   1  0.000000  1.000000  0.000000        0.00000", "REMARK 350   BIOMT3   1  0.000000  0.000000  1.000000        0.00000"]
    lines += ["REMARK 350   BIOMT1   2 -1.000000  0.000000  0.000000        5.00000", "REMARK 350   BIOMT2   2  0.000000 -1.000000  0.000000        0.00000", "REMARK 350   BIOMT3   2  0.000000  0.000000  1.000000        0.00000", "REMARK 350   BIOMT1   3  1.000000  0.000000  0.000000        0.00000"]
    lines += ["MODEL        1", atom(1, "N", "ALA", "A", -1, 0, 0, 0), atom(2, "CA", "ALA", "A", -1, 1, 0, 0, alt="A"), atom(3, "CA", "ALA", "A", -1, 9, 9, 9, alt="B"), atom(4, "CA", "TRP", "A", 60, 2, 0, 0), atom(5, "CA", "GLY", "A", 60, 3, 0, 0, icode="A"), atom(6, "CA", "HIS", "B", 5, 4, 0, 0)]
    lines += [atom(7, "O", "HOH", "A", 99, 5, 5, 5, record="HETATM"), "ATOM      8  CA  BAD A   x       1.0", "ENDMDL", "MODEL        2", atom(9, "CA", "ALA", "A", 7, 0, 0, 0), "ENDMDL"]
    path = tmp_path / "mini.pdb"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_read_pdb(spark, pdb):
    atoms = S.read_pdb(spark, pdb).orderBy("serial").collect()
    assert [(r.serial, r.res_idx, r.res_label) for r in atoms] == [(0, 0, "ALA-1:A"), (1, 0, "ALA-1:A"), (2, 1, "TRP60:A"), (3, 2, "GLY60:A"), (4, 3, "HIS5:B")]
    assert atoms[1].x == 1.0 and atoms[2].hydrophobic and atoms[2].aromatic and not atoms[4].hydrophobic and atoms[4].aromatic
    assert S.read_pdb(spark, pdb, chain="B").count() == 1
    assert {(r.chain_id, r.sequence) for r in S.sequences(S.read_pdb(spark, pdb), bond=None).collect()} == {("A", "AWG"), ("B", "H")}
    assert S.sequences(S.read_pdb(spark, pdb)).count() == 0  # no bonds
    assert S.coords_array(S.read_pdb(spark, pdb)).first().coords[4] == [4.0, 0.0, 0.0]
    assert S.raw_atoms(spark, pdb).count() == 8 and S.residues(S.read_pdb(spark, pdb)).count() == 4
    ops = {r.op_id: (r.r11, r.tx) for r in S.read_biomt(spark, pdb).collect()}
    assert ops == {1: (1.0, 0.0), 2: (-1.0, 5.0)}


def test_read_mmcif(spark, tmp_path):
    text = """data_x
_pdbx_struct_oper_list.id 1
_pdbx_struct_oper_list.matrix[1][1] 1.0
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.pdbx_PDB_model_num
ATOM 1 C CA ALA A 1 X 10 1.0 2.0 3.0 1
ATOM 2 O "O5'" ALA A 1 X 10 1.5 2.0 3.0 1
HETATM 3 O O HOH A . X 11 0 0 0 1
ATOM 4 C CA ALA A 1 X 10 9 9 9 2
#
"""
    path = tmp_path / "a.cif"
    path.write_text(text)
    atoms = S.read_structures(spark, str(path)).orderBy("serial").collect()
    assert [(r.name, r.chain_id, r.res_seq, r.x) for r in atoms] == [("CA", "X", 10, 1.0), ("O5'", "X", 10, 1.5)]
    assert S.read_oper_list(spark, str(path)).count() == 0  # an incomplete operator
    assert S.cif_tokens("a 'b c' # no\n;two\nlines\n;\n\"q\"") == ["a", "b c", "two\nlines", "q"]


def test_proposals(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("name ,rank , score, probability, center_x, center_y, center_z, residue_ids\npocket1 , 1 , 28.34 , .812, 11.20 , 5.88, 20.11, A_10 A_11 A_57\npocket2, 2, 9.11, .341, -3.40, 12.70, -1.05, A_30 A_-3\nbroken, x\n")
    found = T.read_proposals(spark, str(path)).orderBy("rank")
    assert [(r["rank"], r.score, r.px, r.residue_ids) for r in found.collect()] == [(1, 28.34, 11.2, ["A_10", "A_11", "A_57"]), (2, 9.11, -3.4, ["A_30", "A_-3"])]
    assert T.proposal_labels(found).orderBy("rank").first().residues == ["10:A", "11:A", "57:A"]
    names = spark.createDataFrame([("A", 10, "ALA")], "chain_id string, res_seq int, res_name string")
    assert T.proposal_labels(found, names).orderBy("rank").first().residues == ["ALA10:A", "11:A", "57:A"]


def ranked(spark):
    row = {"structure_id": "s", "rank": 1, "cx": 1.0, "cy": 2.0, "cz": 3.0, "volume": 300.0, "volume_min": 100.0, "volume_max": 400.0, "apo_volume": 0.0, "druggability": 0.61234, "max_druggability": 0.7, "persistence": 0.5, "cryptic": True, "crypticity": 0.4, "lining_residues": ["ALA12:A", "GLY3:A", "TRP7:B"], "appears_in_conformers": [1, 2]}
    return spark.createDataFrame([Row(**row), Row(**(row | {"rank": 2, "volume": 900.0, "crypticity": 0.1}))])


def test_reports(spark, tmp_path):
    text = K.reports(ranked(spark), 4, "crypticity").first().report
    report = json.loads(text)
    assert (report["n_conformers"], report["n_pockets_found"], report["n_cryptic_pockets"]) == (4, 2, 1)
    assert report["pockets"][0]["centroid"] == [1.0, 2.0, 3.0] and report["pockets"][0]["druggability"] == 0.612
    path = tmp_path / "r.json"
    path.write_text(text)
    back = dock_prep(T.read_report(spark, str(path), 1), "s").collect()
    assert len(back) == 1 and back[0].volume_max == 400.0 and back[0].crypticity == 0.4


def test_texts(spark):
    c = ranked(spark)
    lines = [r.line for r in K.pocket_pdb(c).orderBy("rank", "line_no").collect()]
    assert len(lines) == 14 and all(x.startswith("HETATM") for x in lines) and float(lines[1][30:38]) > 1.0
    boxes = [float(r.text.split("size_x = ")[1].split("\n")[0]) for r in K.vina_box(c).orderBy("rank").collect()]
    assert boxes[1] > boxes[0] > 16
    chains = spark.createDataFrame([("s", "A", "AG"), ("s", "B", "W")], "structure_id string, chain_id string, sequence string")
    text = K.constraint_yaml(c, chains).first().text
    assert "sequences:" in text and "constraints:" in text and "SMILES_HERE" in text and text.index("[A, 3]") < text.index("[A, 12]")
    shown = K.console(c).orderBy("rank").first()
    assert shown.volume == "0 -> 400" and shown.persistence == "50%" and shown.residues == "ALA12:A, GLY3:A, TRP7:B"


def test_structure_text_reads_back(spark, pdb, tmp_path):
    atoms = S.read_pdb(spark, pdb)
    K.write_text(K.structure_pdb(atoms), str(tmp_path / "out"), ["serial"])
    again = S.read_pdb(spark, str(tmp_path / "out" / "structure_id=mini"))
    assert [tuple(r) for r in again.orderBy("serial").select("name", "res_name", "res_seq", "x").collect()] == [tuple(r) for r in atoms.orderBy("serial").select("name", "res_name", "res_seq", "x").collect()]


def test_tables(spark, tmp_path):
    (tmp_path / "legs").mkdir()
    (tmp_path / "legs" / "a.jsonl").write_text('{"id": "1", "tool": "x", "jaccard": 0.1}\n{"id": "1", "tool": "x", "jaccard": 0.2}\nnot json\n')
    assert [r.jaccard for r in T.read_legs(spark, str(tmp_path / "legs")).collect()] == [0.2]
    (tmp_path / "d.json").write_text(json.dumps({"1abc": [{"apo_chain": "A", "pRMSD": 2.0, "is_main_holo_structure": False}, {"apo_chain": "B", "pRMSD": 1.0}]}))
    assert T.read_dataset(spark, str(tmp_path / "d.json")).count() == 2
    (tmp_path / "f.json").write_text(json.dumps({"test": ["1abc"], "train-0": ["2xyz", "3xyz"]}))
    assert T.read_folds(spark, str(tmp_path / "f.json")).where("fold = 'train-0'").count() == 2
    np.save(tmp_path / "p.npy", np.array([1, 0, 2]))
    labels = T.read_residue_labels(spark, str(tmp_path))
    res = spark.createDataFrame([("p", 5), ("p", 6)], "id string, res_idx int")
    assert [(r.res_idx, r.label) for r in T.by_position(res, labels).orderBy("res_idx").collect()] == [(5, 1), (6, 0)]
    names = spark.createDataFrame([("pocket10_atm",), ("pocket9_atm",)], "f string")
    assert [r.f for r in T.natural_order(names, "f").orderBy("number").collect()] == ["pocket9_atm", "pocket10_atm"]


def test_npy_files(spark, tmp_path):
    kinds = {"b": np.array([True, False]), "i1": np.array([[1, 2, 3], [4, 5, 6]], "i1"), "f": np.asfortranarray(np.arange(6).reshape(2, 3)), "u": np.array([7, 8], ">u2"), "none": np.zeros(0, int), "one": np.array(5)}
    for name, array in kinds.items():
        np.save(tmp_path / f"{name}.npy", array)
    rows = T.read_npy(spark, str(tmp_path)).collect()
    for name, array in kinds.items():
        assert [r.value for r in sorted(rows, key=lambda r: r.position) if r.id == name] == array.ravel().astype(int).tolist()
    with open(tmp_path / "two.npy", "wb") as f:
        np.lib.format.write_array(f, np.array([9, 9, 9]), version=(2, 0))
    assert T.read_npy(spark, str(tmp_path / "two.npy")).count() == 3
    np.save(tmp_path / "x.npy", np.array([0.5, -1.5], "f4"))
    assert [r.value for r in T.read_npy(spark, str(tmp_path / "x.npy"), "double").collect()] == [0.5, -1.5]
    np.save(tmp_path / "ids.npy", np.array(["1abcA", "2xyz", ""]))
    entries = T.read_entries(spark, str(tmp_path / "ids.npy")).orderBy("position").collect()
    assert [(r.pdb, r.chain, r.id) for r in entries] == [("1abc", "A", "1abcA"), ("2xyz", "", "2xyz"), ("", "", "")]
    (tmp_path / "bad").mkdir()
    np.save(tmp_path / "bad" / "objects.npy", np.array([{"a": 1}], object), allow_pickle=True)
    (tmp_path / "bad" / "short.npy").write_bytes((tmp_path / "i1.npy").read_bytes()[:-1])
    (tmp_path / "bad" / "text.npy").write_text("no array")
    for name, kind in (("objects", "long"), ("short", "long"), ("text", "long")):
        with pytest.raises(Exception, match=name):
            T.read_npy(spark, str(tmp_path / "bad" / f"{name}.npy"), kind).collect()
    with pytest.raises(Exception, match="x: values of type float32"):
        T.read_npy(spark, str(tmp_path / "x.npy")).collect()


def test_labels_by_position(spark, tmp_path):
    np.save(tmp_path / "p.npy", np.array([1, 0, 2, 1, 1]))  # longer than the residues
    np.save(tmp_path / "q.npy", np.array([1, 2], "u1"))  # shorter
    np.save(tmp_path / "r.npy", np.array([0, 0], float).astype("i8"))
    np.save(tmp_path / "s.npy", np.array([1]))  # no residues
    res = spark.createDataFrame([("p", k, 10 * k) for k in range(4)] + [("q", k, k) for k in range(5)] + [("r", 0, 3), ("t", 0, 1)], "id string, res_idx int, res_seq int")
    got = {r.id: tuple(r)[1:] for r in T.labelled_site(res, T.read_residue_labels(spark, str(tmp_path))).collect()}
    assert got == {"p": ([0, 30], 4, 5, 4, 1), "q": ([0], 5, 2, 2, 1), "r": ([], 1, 2, 1, 0), "s": ([], 0, 1, 0, 0)}


def residue(seq, name, x, chain="A", atoms=("N", "CA", "C")):
    return [(seq, name, a, x + 0.7 * k, chain) for k, a in enumerate(atoms)]


def test_peptide_gaps(spark, tmp_path):
    rows = [*residue(1, "ALA", 0.0), *residue(2, "GLY", 2.5), *residue(5, "SER", 5.0)]  # bonds of 1.1
    rows += [*residue(6, "TRP", 9.0), *residue(7, "HIS", 11.4)]  # after a gap
    rows += [*residue(8, "MSE", 13.8), *residue(9, "LYS", 16.2)]  # no code between: the last stands alone
    rows += [*residue(10, "ALA", 30.0, atoms=("N", "CA")), *residue(11, "ALA", 32.0)]  # no C
    rows += [*residue(1, "ALA", 0.0, "B"), *residue(2, "VAL", 3.2, "B")]  # exactly 1.8: no bond
    lines = [atom(n + 1, a, res, chain, seq, x, 0.0, 0.0) for n, (seq, res, a, x, chain) in enumerate(rows)]
    (tmp_path / "gap.pdb").write_text("\n".join(lines))
    atoms = S.read_pdb(spark, str(tmp_path / "gap.pdb"))
    got = [(r.chain_id, r.fragment, r.n_residues, r.sequence) for r in S.fragments(atoms).orderBy("chain_id", "fragment").collect()]
    assert got == [("A", 0, 3, "AGS"), ("A", 1, 2, "WH")]
    assert [(r.chain_id, r.sequence) for r in S.sequences(atoms).collect()] == [("A", "AGSWH")]
    assert {(r.chain_id, r.sequence) for r in S.sequences(atoms, bond=1.9).collect()} == {("A", "AGSWH"), ("B", "AV")}


def test_frames_from_files(spark, tmp_path):
    from voxelith.operators.ensembles import fit_frames

    model = lambda k, n: [f"MODEL     {k:4d}", *(atom(i + 1, "CA", "ALA", "A", i + 1, 10 * k + i, 0, 0) for i in range(n)), atom(99, "O", "HOH", "A", 90, 5, 5, 5, record="HETATM"), "ENDMDL"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "run.pdb").write_text("\n".join([*model(1, 3), *model(2, 2), *model(3, 5), "END", ""]))
    found = S.read_frames(spark, str(tmp_path / "t"))
    assert sorted((r.structure_id, r.frame_idx, r.position, r.x) for r in found.collect()) == [("run", k, i, 10.0 * k + i) for k, n in ((1, 3), (2, 2), (3, 5)) for i in range(n)]
    (tmp_path / "g").mkdir()
    for k in (0, 1, 10):
        (tmp_path / "g" / f"run_model_{k}.pdb").write_text("\n".join(atom(i + 1, "CA", "ALA", "A", i + 1, k, i, 0) for i in range(2)))
    files = S.read_frames(spark, str(tmp_path / "g"))
    assert sorted((r.structure_id, r.frame_idx, r.x) for r in files.where("position = 0").collect()) == [("run", 1, 0.0), ("run", 2, 1.0), ("run", 3, 10.0)]
    atoms = spark.createDataFrame([("run", s) for s in (7, 8, 9)], "structure_id string, serial int")
    fitted = {(r.frame_idx, r.serial): r.x for r in fit_frames(atoms, found).collect()}
    assert fitted == {(1, 7): 10, (1, 8): 11, (1, 9): 12, (2, 7): 20, (2, 8): 21, (2, 9): 0, (3, 7): 30, (3, 8): 31, (3, 9): 32}
    assert fit_frames(atoms, found.limit(0)).count() == 0


def test_proposal_files_of_frames(spark, tmp_path):
    head = "name, rank, score, probability, center_x, center_y, center_z, residue_ids\n"
    (tmp_path / "a_frame0.pdb_predictions.csv").write_text(head + "p, 2, 1, 1, 1.0, 2.0, 3.0, A_1\np, 1, 1, 1, 4.0, 5.0, 6.0, A_1\n")
    (tmp_path / "a_frame12_predictions.csv").write_text(head + "p, 1, 1, 1, 7.0, 8.0, 9.0, A_1\n")
    (tmp_path / "b.csv").write_text(head)
    got = T.proposals_of_frames(T.read_proposals(spark, str(tmp_path)))
    assert sorted(map(tuple, got.collect())) == [("a", 0, 0, 4.0, 5.0, 6.0), ("a", 0, 1, 1.0, 2.0, 3.0), ("a", 12, 0, 7.0, 8.0, 9.0)]


def box_pdb(path, operators=False):
    """A five-sided box of alpha carbons with a backbone at its start, and two operators."""
    at = [-4.0 + 2 * k for k in range(5)]
    spots = [(x, y, -4.0) for x in at for y in at] + [(x, y, z) for z in (-2.0, 0.0) for x in at for y in at if 4.0 in (abs(x), abs(y))]
    lines = [f"REMARK 350   BIOMT{i}   {n} {s if i == 1 else 0:9.6f} {s if i == 2 else 0:9.6f} {1 if i == 3 else 0:9.6f} {100 * (n - 1) if i == 1 else 0:14.5f}" for n, s in ((1, 1), (2, -1)) for i in (1, 2, 3)] if operators else []
    lines += [atom(k + 1, "CA", "ALA", "A", k + 1, *p) for k, p in enumerate(spots)]
    path.write_text("\n".join(lines) + "\n")


def test_whole_run(spark, tmp_path):
    import re

    from voxelith.plans.discovery import Settings
    from voxelith.plans.run import analyze, prepare_docking

    (tmp_path / "in").mkdir()
    box_pdb(tmp_path / "in" / "one.pdb", operators=True)
    box_pdb(tmp_path / "in" / "two.pdb")
    (tmp_path / "in" / "flat.pdb").write_text("\n".join(atom(k + 1, "CA", "ALA", "A", k + 1, 3.0 * k, 0, 0) for k in range(3)))
    source, out = str(tmp_path / "in" / "*.pdb"), tmp_path / "out"
    found = analyze(spark, source, str(out), Settings(n_conformers=3, min_volume=20.0, top=2), assembly=True)
    rows = found.collect()
    reports = {p.parent.name: json.loads(p.read_text()) for p in out.glob("reports/*/*.txt")}
    assert set(reports) == {f"structure_id={s}" for s in ("one", "two", "flat")} and all(r["n_conformers"] == 4 and r["ranked_by"] == "crypticity" for r in reports.values())
    assert all(len(r["pockets"]) <= 2 for r in reports.values())
    more = spark.createDataFrame([("one",), ("none",)], "structure_id string")
    empty = {r.structure_id: json.loads(r.report) for r in K.all_reports(more, found, 4, "crypticity").collect()}
    assert empty["none"]["pockets"] == [] and empty["none"]["n_pockets_found"] == 0 and empty["one"] == reports["structure_id=one"]
    assert sum(len(r["pockets"]) for r in reports.values()) == len(rows) > 0
    for kind, text in (("pockets", "HETATM"), ("boxes", "center_x")):
        files = list(out.glob(f"{kind}/*/*/*.txt"))
        assert len(files) == len(rows) and all(f.read_text().startswith(text) for f in files)
    chains = {p.parent.name: set(re.findall(r"^ATOM.{17}(.)", p.read_text(), re.M)) for p in out.glob("assemblies/*/*.txt")}
    assert chains["structure_id=one"] == {"A", "B"} and chains["structure_id=two"] == {"A"}
    docked = prepare_docking(spark, str(out / "reports" / "*" / "*.txt"), source, str(tmp_path / "dock"), ("boxes",), top=1).collect()
    assert len(docked) == sum(bool(r["pockets"]) for r in reports.values()) == len(list((tmp_path / "dock").glob("boxes/*/*/*.txt")))
    assert {(r.structure_id, r["rank"]) for r in docked} == {(r["protein"], r["pockets"][0]["rank"]) for r in reports.values() if r["pockets"]}
    with pytest.raises(ValueError):
        analyze(spark, source, str(tmp_path / "no"), Settings(n_conformers=0, rank_by="size"))
    with pytest.raises(ValueError):
        analyze(spark, source, str(tmp_path / "no"), Settings(n_conformers=0, backend="none"))


def test_results_keep_nulls(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("b", 2)], "id string, rank int")
    assert sorted(r.result for r in K.results_json(rows, "id").collect()) == ['{"id":"a","rank":null}', '{"id":"b","rank":2}']
    K.write_results(rows, str(tmp_path / "r"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r")).collect()) == ['{"id":"a","rank":null}', '{"id":"b","rank":2}']


def test_append_new(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    path = str(tmp_path / "sink")
    K.append_new(rows, path, ["id"])
    K.append_new(rows.union(spark.createDataFrame([("c", 3)], rows.schema)), path, ["id"])
    assert spark.read.schema(rows.schema).json(path).groupBy("id").agg(F.count("*").alias("n")).where("n = 1").count() == 3


def test_stream(spark, tmp_path):
    from voxelith.streaming.scoring import scored_stream

    rows = spark.sql("select 's' structure_id, timestamp'2024-01-01 00:00:10' ts, 300.0D volume, 0.5D enclosure, 0.5D hydrophobic_fraction, 2 aromatic_count union all select 's', timestamp'2024-01-01 00:20:00', 20.0D, 0.5D, 0.5D, 2")
    rows.write.parquet(str(tmp_path / "in"))
    q = scored_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("vx").start()
    q.processAllAvailable()
    q.stop()
    assert [r.n for r in spark.table("vx").collect()] == [1]
