"""One small test a finding of the third round."""

import os

import pytest
from pyspark.sql import functions as F

from voxelith import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _clusters(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    return {tuple(r) for r in li.groupBy("l_suppkey", (F.col("l_partkey") % 20).alias("c")).agg(F.count("*")).groupBy("l_suppkey").agg(F.count("*")).collect()}


@tables
def test_boxes_of_all_clusters(spark):
    assert {tuple(r) for r in Q.queries()["vina_box"](spark, SF).groupBy("structure_id").agg(F.count("*")).collect()} == _clusters(spark)


@tables
def test_console_of_all_clusters(spark):
    assert {tuple(r) for r in Q.queries()["console_table"](spark, SF).groupBy("structure_id").agg(F.count("*")).collect()} == _clusters(spark)


def test_fixed_width_keeps_large_keys(spark, tmp_path):
    spark.sql("select p_partkey, 3 p_size from values (0L), (99999L), (100000L), (250003L) t(p_partkey)").write.parquet(f"{tmp_path}/part.parquet")
    rows = Q.queries()["fixed_width_format"](spark, str(tmp_path)).orderBy("p_partkey").collect()
    assert [(r.p_partkey, r.line[6:11]) for r in rows] == [(0, "    0"), (99999, "    0"), (100000, "    1"), (250003, "50005")]


def _far_atoms(spark):
    from voxelith.sinks import files as K

    atoms = spark.sql("select 's' structure_id, id serial, 'CA' name, 'ALA' res_name, 'A' chain_id, cast(id % 90 as int) res_seq, id / 8 % 50 x, -1.5D y, 2.25D z, 'C' element from values (99997L), (99998L), (99999L), (123456L) t(id)")
    return "\n".join(r.line for r in K.structure_pdb(atoms).orderBy("serial").collect())


def test_frames_of_serials_beyond_five_digits(spark, tmp_path):
    from voxelith.sources import structures as R

    (tmp_path / "a.pdb").write_text("MODEL        1\n" + _far_atoms(spark) + "\nENDMDL\n")
    assert [(r.position, r.x) for r in R.read_frames(spark, str(tmp_path)).orderBy("position").collect()] == [(0, 49.625), (1, 49.75), (2, 49.875), (3, 32.0)]


def test_structures_of_serials_beyond_five_digits(spark, tmp_path):
    from voxelith.sources import structures as R

    (tmp_path / "a.pdb").write_text(_far_atoms(spark) + "\n")
    rows = R.read_structures(spark, str(tmp_path)).orderBy("serial").collect()
    assert [(r.serial, r.res_label, r.y) for r in rows] == [(0, "ALA7:A", -1.5), (1, "ALA8:A", -1.5), (2, "ALA9:A", -1.5), (3, "ALA66:A", -1.5)]


def test_coordinates_keep_the_sign_of_zero(spark, tmp_path):
    spark.sql("select 5L vec_id, array(-0.00005f, 0.00005f, -1f) embedding, 3 label").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in Q.queries()["coordinate_arrays"](spark, str(tmp_path)).collect()] == [(3, "-0.00/0.00/-40.00")]


def test_legs_of_one_file_are_read_in_blocks(spark, tmp_path):
    from voxelith.sources import tables as T

    text = [f'{{"id": "a{k % 5}", "tool": "t", "n_known": {k}}}' for k in range(400)]
    (tmp_path / "a.jsonl").write_text("\n".join(["not json", *text, ""]))
    (tmp_path / "b.jsonl").write_text('{"id": "a0", "tool": "t", "n_known": 7}\r\n')
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        legs = T.read_legs(spark, str(tmp_path))
        assert sorted((r.id, r.n_known) for r in legs.collect()) == [("a0", 7), ("a1", 396), ("a2", 397), ("a3", 398), ("a4", 399)]
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        assert "wholetext" not in legs._jdf.queryExecution().toString().lower()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@tables
def test_legs_are_written_as_several_files(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(Q, "written", lambda rows, *a, **k: kept.append(rows.count()) or made(rows, *a, **k))
    assert Q.queries()["read_legs"](spark, SF).count() > 0
    assert kept == [spark.read.parquet(f"{SF}/events.parquet").count() + 2]  # a row a line, not one row of all text


made = Q.written


def test_proposals_carry_only_their_header(spark, tmp_path):
    from voxelith.sources import tables as T

    for name, shift in (("a", 0), ("b", 1000)):
        rows = "\r\n".join(f" {k} , {k + shift}.5 ,1,2, A_{k}" for k in range(2000))
        (tmp_path / f"{name}.pdb_predictions.csv").write_text(f"\r\n{'name, ' * 0}score, center_x , center_y, center_z, residue_ids\r\n{rows}\r\nbroken, x\r\n")
    found = T.read_proposals(spark, str(tmp_path))
    assert "wholetext" not in found._jdf.queryExecution().toString().lower() and "Generate" not in found._jdf.queryExecution().toString()
    rows = found.orderBy("structure_id", "rank").collect()
    assert [(r.structure_id, r.rank, r.score, r.px, r.residue_ids) for r in rows] == [(n, k + 1, float(k), k + s + 0.5, [f"A_{k}"]) for n, s in (("a", 0), ("b", 1000)) for k in range(2000)]


def _network(n=70, cutoff=8.0):
    import numpy as np

    xyz = np.random.default_rng(4).normal(0, 5, (n, 3))
    d = xyz[None] - xyz[:, None]
    r2 = (d**2).sum(axis=2)
    i, j = np.nonzero((r2 > 0) & (r2 <= cutoff**2))
    return xyz, (n, i, j, d[i, j], 1 / r2[i, j], 5)


@pytest.mark.parametrize("way", ["factor", "filter"])
def test_contact_modes_by_each_way(monkeypatch, way):
    import numpy as np

    from voxelith.operators import kernels as K

    xyz, args = _network()
    values, vectors = K.elastic_modes(xyz, 5)
    monkeypatch.setattr(K, "DENSE", 10)
    if way == "filter":  # as for contacts that are few beside the points
        monkeypatch.setattr(K, "DENSE", -1)
        monkeypatch.setattr(K, "_lowest", None)
        monkeypatch.setattr(K, "MATRIX_SHARE", 0)
    got, found = K.contact_modes(*args)
    assert got == pytest.approx(values, rel=1e-6)
    assert np.abs(np.einsum("mpa,mpa->m", found, vectors)) == pytest.approx(np.ones(5), abs=1e-4)


def test_dense_contacts_need_no_filter(monkeypatch):
    from voxelith.operators import kernels as K

    monkeypatch.setattr(K, "contact_product", None)
    assert len(K.contact_modes(*_network()[1])[0]) == 5


def _peak(run):
    import tracemalloc

    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()


def test_modes_of_many_points_are_bounded_in_memory():
    import numpy as np

    from voxelith.operators import kernels as K

    xyz = np.random.default_rng(5).normal(0, 5, (1100, 3))
    (values, modes), peak = _peak(lambda: K.elastic_modes(xyz, 5))
    assert peak < 120  # MB; the matrix alone takes 87, its parts and copies took several times that
    flat = modes.reshape(len(values), -1)
    rest = K._product(1100, K._rows_of_points(xyz, 8.0, 1.0), flat.T) - flat.T * values
    assert np.abs(rest).max() < 1e-7 and np.abs(flat @ flat.T - np.eye(5)).max() < 1e-9


@tables
def test_mode_equations_solve_once(spark):
    found = Q.queries()["mode_equations"](spark, SF)
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan  # modes are written once and read by every step
    assert {(r.solves, r.unit) for r in found.collect()} == {(True, True)}


def test_frames_of_many_anchors_are_bounded_in_memory():
    import numpy as np

    from voxelith.operators import kernels as K

    xyz = np.random.default_rng(6).normal(0, 5, (4000, 3))
    moves = np.tile([1.0, -2.0, 0.5], (4000, 1))
    out, peak = _peak(lambda: K.propagate(xyz, xyz, moves))
    assert peak < 100 and np.abs(out - moves).max() < 1e-6


def test_modes_beyond_the_factor_need_memory_in_proportion(monkeypatch):
    import numpy as np
    import pandas as pd

    from voxelith.operators import ensembles as E
    from voxelith.operators import kernels as K

    xyz = np.random.default_rng(7).normal(0, 5, (1200, 3))
    springs = E._spring_rows(1200, pd.DataFrame({"i": [3, 9, 3], "j": [7, 8, 7], "gamma": [9.0, 0.5, 2.0]}))
    for gamma in (1.0, springs):
        values, modes = K.elastic_modes(xyz, 5, gamma=gamma if gamma == 1.0 else gamma(0, 1200))
        monkeypatch.setattr(K, "FACTORED", 10)
        monkeypatch.setattr(K, "_lowest", None)
        got, found = K.elastic_modes(xyz, 5, gamma=gamma)
        monkeypatch.undo()
        assert got == pytest.approx(values, rel=1e-9) and np.abs(found - modes).max() < 1e-7
    assert springs(0, 1200)[7, 3] == springs(0, 1200)[3, 7] == 2.0

    def peak(n):
        monkeypatch.setattr(K, "FACTORED", 10)
        return _peak(lambda: K.elastic_modes(np.random.default_rng(7).normal(0, 5, (n, 3)), 1))[1]

    small, large = peak(500), peak(2000)
    assert large < 4 * small + 10 and large < 60  # MB; the factor of 2000 points takes 72


@pytest.mark.parametrize("block", [7, 512])
def test_exact_line_dedup_links_all_similar_lines(spark, monkeypatch, block):
    """Against plain edit distance: words that all have one letter changed share no word, so no block."""
    import random

    from voxelith.llm import line_dedup as L

    monkeypatch.setattr(L, "BLOCK", block)
    rng = random.Random(8)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    lines = [" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(k % 12 + 1)) for k in range(24)] + ["ab", "abc", "\u00e9t\u00e9s \u4e2d", ""]
    lines += [" ".join(w[:3] + "z" + w[4:] for w in x.split(" ")) if len(x) > 5 else x + "d" for x in lines if x]
    want = list(range(len(lines)))
    for b, y in enumerate(lines):
        for a, x in enumerate(lines[:b]):
            if x and y and plain(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9):
                want = [want[a] if w == want[b] else w for w in want]
    gone = [int(bool(x) and want.index(want[k]) < k) for k, x in enumerate(lines)]
    assert sum(gone) >= 24
    frame = spark.createDataFrame([*enumerate(lines), (0, lines[0])], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_removed for r in L.digest(frame, exact=True).collect()}
    assert [got[k] for k in range(len(lines))] == gone
    assert sum(r.n_removed for r in L.digest(frame).collect()) < sum(gone)  # blocks alone leave links out


def test_line_blocks_travel_with_half_a_digest(spark):
    from collections import defaultdict

    from voxelith.llm import line_dedup as L
    from voxelith.llm.common import documents

    table = [(k, f"one two three four five six seven {'abc'[k % 3]} nine ten\nalone {k} here {k * k} now {k + 7}") for k in range(6)]
    found = L.lines(documents(spark.createDataFrame(table, "doc_id long, text string")).withColumn("th", F.xxhash64("text")), 0.8)
    met = L.shared_blocks(found)
    assert met.columns == ["h", "l1"]
    want = defaultdict(set)
    for r in found.collect():
        for h in r.blocks:
            want[h].add(r.l1)
    assert {tuple(r) for r in met.distinct().collect()} == {(h, x) for h, held in want.items() if len(held) > 1 for x in held}


def test_words_replaced_in_place_need_no_columns(monkeypatch):
    from voxelith.llm import line_dedup as L

    words = [f"word{k}" for k in range(40)]
    monkeypatch.setattr(L, "_word_bound", None)
    monkeypatch.setattr(L, "edit_within", None)
    assert L.similar(" ".join(words), " ".join(["other" if k % 8 == 3 else w for k, w in enumerate(words)]), 0.8)


def test_edit_distances_of_many_pairs_at_once():
    """Against one pair at a time: lengths over several words of 64 rows, edits on both sides of the limit, characters the other text lacks."""
    import random

    import numpy as np

    from voxelith.llm import line_dedup as L

    rng = random.Random(5)
    for length in (1, 9, 64, 65, 150, 400):
        a, b = [], []
        for _ in range(40):
            x = [rng.choice("abcd 中") for _ in range(rng.randint(max(1, length // 2), length))]
            y = list(x)
            for _ in range(rng.randint(0, max(1, len(x) // 3))):
                at = rng.randrange(len(y))
                y[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é", "xy"]) if len(y) > 2 else "q"
            a.append("".join(x))
            b.append("".join(y))
        limits = np.array([int(0.2 * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b)])
        use = [k for k in range(40) if abs(len(a[k]) - len(b[k])) <= limits[k]]
        a, b = [a[k] for k in use], [b[k] for k in use]
        assert L.edits_within(a, b, limits[use]).tolist() == [L.edit_within(x, y, int(k)) for x, y, k in zip(a, b, limits[use])]
        assert L.all_similar(a, b, 0.8).tolist() == [L.similar(x, y, 0.8) for x, y in zip(a, b)]


def test_lines_of_large_blocks_are_fetched_once(spark, monkeypatch):
    """The second pass, over parts of large blocks, takes the texts of the first."""
    from voxelith.llm import line_dedup as L

    calls, fetch = [], L._fetch
    monkeypatch.setattr(L, "UNIT", 4)
    monkeypatch.setattr(L, "_fetch", lambda names: calls.append(names) or fetch(names))
    words = [f"word{k}" for k in range(30)]
    table = [(k, " ".join(words[:k] + [f"v{k}"] + words[k + 1 :])) for k in range(30)]
    got = {r.doc_id: r.n_removed for r in L.digest(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == {k: int(k > 0) for k in range(30)} and len(calls) == 1


def test_components_write_one_table_a_round(spark, monkeypatch):
    import random

    from voxelith.llm import components as C

    written, staged = [], C.staged
    monkeypatch.setattr(C, "staged", lambda df, name: written.append(name) or staged(df, name))
    at = random.Random(2).sample(range(10_000), 400)
    edges = [*zip(at[:199], at[1:200]), *((at[200], x) for x in at[201:]), (at[0], at[1]), (at[5], at[5])]
    got = {r.v: r.label for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(at[:200]) for x in at[:200]} | {x: min(at[200:]) for x in at[200:]}
    assert len(written) <= 9  # three tables a round took 164
