"""Operators of the spatial engine on small cases with known answers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from voxelith.functions import metrics as M
from voxelith.functions import scoring
from voxelith.operators import clusters as C
from voxelith.operators import ensembles as E
from voxelith.operators import evaluation as V
from voxelith.operators import grid as G
from voxelith.operators import kernels as K
from voxelith.operators import spatial as S
from voxelith.plans import discovery as P


def pocket(frame, x=0.0, y=0.0, z=0.0, volume=200.0, structure="s", idx=0, **more):
    return Row(**({"structure_id": structure, "frame_idx": frame, "source_ord": 0, "pocket_idx": idx, "cx": x, "cy": y, "cz": z, "volume": volume, "enclosure": 0.5, "hydrophobic_fraction": 0.5, "aromatic_count": 2, "lining_residues": ["ALA1:A", "GLY2:A"]} | more))


def clustered(spark, rows, n_frames, strategy="crypticity"):
    labelled = E.greedy_cluster(C.scored(spark.createDataFrame(rows)))
    return {r.cluster_id: r for r in C.ranked(C.aggregate(labelled, ["structure_id", "cluster_id"], n_frames), strategy).collect()}


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scores(spark):
    composite = lambda v, e, h, a: value(spark, scoring.druggability(*(F.lit(x) for x in (v, e, h, a)))["composite"])
    assert composite(300.0, 0.9, 0.8, 5) > 0.7 and composite(20.0, 0.05, 0.0, 0) < 0.3
    crypt = lambda a, m, d: value(spark, scoring.crypticity(F.lit(a), F.lit(m), F.lit(d)))
    assert [crypt(0.0, 300.0, 0.8), crypt(300.0, 300.0, 0.9), crypt(150.0, 300.0, 0.6), crypt(0.0, 0.0, 0.5)] == [0.8, 0.0, 0.3, 0.0]
    with pytest.raises(ValueError):
        scoring.rank_key("size")


def test_clusters_over_frames(spark):
    one = clustered(spark, [pocket(0), pocket(1, 0.5, 0.5, 0.5)], 2)
    assert len(one) == 1 and one[0].persistence == 1.0 and one[0].appears_in_conformers == [0, 1]
    assert len(clustered(spark, [pocket(0), pocket(0, 50.0, 50.0, 50.0, idx=1)], 1)) == 2
    assert clustered(spark, [pocket(1), pocket(3)], 4)[0].persistence == 0.5
    assert clustered(spark, [pocket(k) for k in range(8)], 10)[0].cryptic and not clustered(spark, [pocket(k) for k in range(10)], 10)[0].cryptic
    assert clustered(spark, [pocket(2)], 4)[0].apo_volume == 0.0


def test_ranking_strategies(spark):
    rows = [pocket(k) for k in range(4)] + [pocket(k, x=40.0, idx=1) for k in (1, 2)]
    assert clustered(spark, rows, 4, "crypticity")[1].rank == 1
    assert clustered(spark, rows, 4, "balanced")[0].rank == 1
    assert {r.rank for r in clustered(spark, rows, 4, "persistence").values()} == {1, 2}


def test_consensus_counts_members_and_filters_keep_ranks(spark):
    rows = [pocket(0, lining_residues=["B2:A", "A1:A"]), pocket(1, lining_residues=["A1:A"]), pocket(2, lining_residues=["C3:A", "A1:A"])]
    assert clustered(spark, rows, 3)[0].lining_residues == ["A1:A"]
    table = spark.createDataFrame([Row(structure_id="s", rank=k, druggability=0.1 * k, persistence=1.0, crypticity=0.0) for k in range(1, 6)])
    assert [r["rank"] for r in C.reported(table, min_druggability=0.25, top=2).orderBy("rank").collect()] == [3, 4]


def test_greedy_depends_on_order_and_not_on_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [pocket(int(k % 5), *(float(x) for x in rng.uniform(0, 20, 3)), idx=int(k)) for k in range(60)]
    runs = [sorted((r.frame_idx, r.pocket_idx, r.cluster_id) for r in E.greedy_cluster(spark.createDataFrame(rows).repartition(n)).collect()) for n in (1, 8)]
    assert runs[0] == runs[1]


def test_metrics(spark):
    known = F.array(*map(F.lit, range(10, 20)))
    small, huge = F.array(*map(F.lit, range(10, 18))), F.array(*map(F.lit, [*range(10, 20), *range(100, 200)]))
    v = lambda c: value(spark, c)
    assert v(M.recall(huge, known)) > v(M.recall(small, known)) and v(M.jaccard(huge, known)) < v(M.jaccard(small, known))
    none = F.array().cast("array<int>")
    assert v(M.recall(small, none)) == 0 and v(M.jaccard(none, none)) == 0
    zero, missing = [F.lit(0.0)] * 3, [F.lit(None).cast("double")] * 3
    assert v(M.distance(*zero, F.lit(3.0), F.lit(4.0), F.lit(0.0))) == 5 and math.isinf(v(M.distance(*missing, *zero)))
    hits = [v(f(F.lit(j), F.lit(d))) for f, j, d in ((M.headline_hit, 0.0, 3.0), (M.strict_hit, 0.0, 3.0), (M.strict_hit, 0.3, 5.0), (M.headline_hit, 0.4, 99.0))]
    assert hits == [True, False, True, True]
    labels = F.array(F.lit("ALA12:A"), F.lit("GLY-3:B"), F.lit("X"))
    assert v(M.residue_numbers(labels)) == [3, 12] and v(M.residue_numbers(labels, signed=True)) == [-3, 12]


def test_range_join_is_exact(spark):
    rng = np.random.default_rng(1)
    a = [(k, *(float(x) for x in rng.uniform(-20, 20, 3))) for k in range(120)]
    left = spark.createDataFrame(a, "id int, x double, y double, z double")
    right = left.select(F.col("id").alias("id2"), *(F.col(c).alias(f"{c}2") for c in "xyz"))
    got = {(r.id, r.id2) for r in S.range_join(left, right, 6.0, right_xyz=("x2", "y2", "z2")).collect()}
    want = {(p[0], q[0]) for p, q in itertools.product(a, a) if math.dist(p[1:], q[1:]) <= 6.0}
    assert got == want
    semi = {r.id for r in S.range_join(left.where("id < 60"), left.where("id >= 60"), 6.0, how="left_semi").collect()}
    assert semi == {p for p, q in want if p < 60 <= q}


def test_components_match_flood_fill(spark):
    rng = np.random.default_rng(2)
    voxels = np.argwhere(rng.random((9, 9, 9)) < 0.3)
    got = K.label_voxels(voxels)
    seen, number = {}, 0
    have = {tuple(v) for v in voxels.tolist()}
    for v in map(tuple, voxels.tolist()):
        if v in seen:
            continue
        number += 1
        stack = [v]
        seen[v] = number
        while stack:
            x = stack.pop()
            for axis, by in itertools.product(range(3), (1, -1)):
                y = tuple(c + by * (n == axis) for n, c in enumerate(x))
                if y in have and y not in seen:
                    seen[y] = number
                    stack.append(y)
    assert got.tolist() == [seen[tuple(v)] for v in voxels.tolist()]
    assert len(K.label_voxels(np.zeros((0, 3), int))) == 0


def test_relational_grid_equals_kernel(spark):
    rng = np.random.default_rng(3)
    xyz = np.round(rng.uniform(0, 12, (40, 3)), 2)
    points = spark.createDataFrame([(0, *map(float, p)) for p in xyz], "frame_idx int, x double, y double, z double")
    grid = K.Grid(xyz, 1.0)
    ext = G.extents(points, ["frame_idx"])
    row = ext.first()
    assert (row.nx, row.ny, row.nz) == tuple(grid.shape)
    mask = G.protein_mask(G.voxelize(points, ext, ["frame_idx"]), ext, ["frame_idx"]).cache()
    assert {(r.i, r.j, r.k) for r in mask.collect()} == {tuple(v) for v in np.argwhere(grid.mask).tolist()}
    field = G.distance_field(mask, ext, ["frame_idx"]).cache()
    got = {(r.i, r.j, r.k): r.d2 for r in field.collect()}
    near = {tuple(v): int(grid.d2[tuple(v)]) for v in np.argwhere((grid.d2 > 0) & (grid.d2 <= 36)).tolist()}
    assert all(got[v] == d for v, d in near.items())
    brute = np.argwhere(grid.mask)
    v = next(iter(near))
    assert near[v] == ((brute - np.array(v)) ** 2).sum(axis=1).min()
    some = G.local_density(mask, spark.createDataFrame([(0, *next(iter(near)))], "frame_idx int, i int, j int, k int"), ["frame_idx"]).first()
    assert some.density == pytest.approx(grid.density[next(iter(near))])


def box_atoms(inner=6.0, step=1.5):
    """A five-sided box, open on top, of alpha carbons."""
    n = int(2 * inner / step) + 1
    at = [-inner + step * k for k in range(n)]
    pts = [(x, y, -inner) for x in at for y in at]
    for z in [-inner + step * k for k in range(1, int(inner / step) + 1)]:
        pts += [(x, y, z) for x in at for y in at if abs(x) == inner or abs(y) == inner]
    return [Row(structure_id="box", serial=k, x=float(x), y=float(y), z=float(z), res_idx=k, res_label=f"ALA{k + 1}:A", hydrophobic=True, aromatic=False, is_anchor=True) for k, (x, y, z) in enumerate(pts)]


def test_pocket_detection(spark):
    frames = spark.createDataFrame(box_atoms()).withColumn("frame_idx", F.lit(0))
    found = G.detect_pockets(frames, min_volume=80.0).collect()
    assert found and all(80 <= r.volume <= 1500 and 0 <= r.enclosure <= 1 and r.hydrophobic_fraction == 1.0 for r in found)
    assert all(r.volume >= 100 for r in G.detect_pockets(frames, min_volume=100.0).collect())
    moved = G.detect_pockets(frames.withColumns({"x": F.col("x") + 7, "z": F.col("z") - 3})).collect()
    assert sorted(r.volume for r in moved) == sorted(r.volume for r in found)
    centres = spark.createDataFrame([("box", 0, 1, found[0].cx, found[0].cy, found[0].cz), ("box", 0, 2, 1000.0, 1000.0, 1000.0)], "structure_id string, frame_idx int, proposal int, px double, py double, pz double")
    rows = G.characterize(frames, centres).collect()
    assert [r.proposal for r in rows] == [1] and math.dist((rows[0].cx, rows[0].cy, rows[0].cz), (found[0].cx, found[0].cy, found[0].cz)) <= 5


def test_ensembles(spark):
    atoms = spark.createDataFrame(box_atoms(4.0, 2.0))
    frames = E.generate(atoms, 3).collect()
    n = atoms.count()
    xyz = {f: np.array([(r.x, r.y, r.z) for r in sorted(frames, key=lambda r: r.serial) if r.frame_idx == f]) for f in range(4)}
    assert len(frames) == 4 * n
    rmsd = [np.sqrt(((xyz[f] - xyz[0]) ** 2).sum(axis=1).mean()) for f in (1, 2, 3)]
    assert rmsd[0] < rmsd[1] < rmsd[2] <= 2.5
    again = {(r.frame_idx, r.serial): (r.x, r.y, r.z) for r in E.generate(atoms.repartition(5), 3).collect()}
    assert all(again[r.frame_idx, r.serial] == (r.x, r.y, r.z) for r in frames)
    few = E.generate(atoms.where("serial < 4"), 2)  # too few anchors: random
    assert few.count() == 12
    assert E.noise_levels(3, [0.5, 1.0]) == [0.5, 1.0, 0.5] and E.noise_levels(2) == [0.3, 2.0]
    with pytest.raises(ValueError):
        E.generate(atoms, 1, "unheard of")


def test_modes_are_orthonormal_and_translation_free():
    rng = np.random.default_rng(4)
    xyz = rng.uniform(0, 12, (20, 3))
    values, modes = K.elastic_modes(xyz, 5, cutoff=20.0)
    flat = modes.reshape(len(modes), -1)
    assert np.allclose(flat @ flat.T, np.eye(len(flat)), atol=1e-8) and (values > 0).all()
    assert np.abs(modes.sum(axis=1)).max() < 1e-6
    same, _ = K.elastic_modes(xyz, 5, cutoff=20.0, gamma=np.ones((20, 20)))
    assert np.allclose(same, values)


def test_assembly(spark):
    atoms = spark.createDataFrame([("m", k, "A", k // 3, float(k), 1.0, 2.0) for k in range(5)], "structure_id string, serial int, chain_id string, res_idx int, x double, y double, z double")
    names = ["op_id", *(f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)), "tx", "ty", "tz"]
    ops = spark.createDataFrame([("m", 1, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), ("m", 2, -1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)], "structure_id string, " + ", ".join(f"{n} {'int' if n == 'op_id' else 'double'}" for n in names))
    out = E.assemble(atoms, ops).orderBy("serial").collect()
    assert [r.serial for r in out] == list(range(10)) and {r.chain_id for r in out} == {"A", "B"}
    assert [(r.x, r.y, r.z) for r in out[5:]] == [(-r.x, -r.y, r.z) for r in out[:5]]
    assert E.assemble(atoms, ops.where("op_id = 1")).count() == 5


def test_evaluation(spark):
    rows = spark.createDataFrame([("t", k, v) for k, v in ((1, 0.0), (2, 0.4), (3, 0.4), (4, 0.9))] + [("u", 1, 0.0)], "t string, rank int, v double")
    best = {r.t: (r.best, r.best_rank) for r in V.best_in_top(rows, ["t"], "v", 3).collect()}
    assert best == {"t": (0.4, 2), "u": (0.0, None)}
    curve = {r.t: (r.top1, r.top3, r.top5) for r in V.hit_curve(rows, ["t"], F.col("v") >= 0.25).collect()}
    assert curve == {"t": (False, True, True), "u": (False, False, False)}
    sample = spark.createDataFrame([(k < 7,) for k in range(10)], "hit boolean")
    ci = V.bootstrap(sample, "hit").first()
    assert ci["mean"] == 0.7 and ci.lo <= 0.7 <= ci.hi and ci.lo < ci.hi
    assert tuple(V.bootstrap(sample.limit(0), "hit").first())[1:] == (0.0, 0.0, 0.0)


def test_discover_end_to_end(spark):
    atoms = spark.createDataFrame(box_atoms(6.0, 1.5))
    found = P.discover(atoms, P.Settings(n_conformers=2, top=5)).orderBy("rank").collect()
    assert found and [r["rank"] for r in found] == sorted(r["rank"] for r in found) and len(found) <= 5
    assert all(0 <= r.persistence <= 1 for r in found)
    targets = spark.createDataFrame([("box", [1, 2, 3], 0.0, 0.0, 0.0)], "structure_id string, known_residues array<int>, rx double, ry double, rz double")
    out = P.evaluate(P.discover(atoms, P.Settings(n_conformers=2)), targets).first()
    assert out.headline in (True, False) and out.distance >= 0
    assert P.size_gate(atoms, 0, 10).count() == 0
    with pytest.raises(ValueError):
        P.detect(atoms, P.Settings(detector="other"))


def test_reranker(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), int(a + b > 1)) for a, b in rng.random((120, 2))]
    frame = spark.createDataFrame([(i, f"p{i % 30}", *r) for i, r in enumerate(rows)], "id int, protein string, a double, b double, label int")
    model = V.fit_reranker(frame, ["a", "b"], iterations=5, step=0.3)
    assert V.trees_grown(model) == 5
    assert model.transform(frame).where("prediction = label").count() > 100
    from pyspark.ml.functions import vector_to_array

    falls = {r.feature: r.fall for r in V.permutation_importance(model, frame.withColumn("c", F.lit(1.0)), ["a", "c"], F.col("label") == 1, vector_to_array("probability")[1], "id").collect()}
    assert falls["a"] > 0.05 and falls["c"] == 0


def test_reranker_stops_early(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rng = np.random.default_rng(6)
    rows = [(f"p{i % 40}", float(a), int(rng.random() < 0.5)) for i, a in enumerate(rng.random(200))]  # nothing to learn
    frame = spark.createDataFrame(rows, "protein string, a double, label int")
    model = V.fit_reranker(frame, ["a"], iterations=12, step=0.5, group="protein", held_out=4)
    assert 1 <= V.trees_grown(model) < 12
    model.write().overwrite().save(str(tmp_path / "m"))
    assert V.trees_grown(PipelineModel.load(str(tmp_path / "m"))) == V.trees_grown(model)


def test_auc_and_precision_against_loops(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(rng.integers(0, 40)), bool(rng.random() < 0.3)) for i in range(400)]
    frame = spark.createDataFrame(rows, "id int, s double, y boolean").repartition(5)
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert V.auc(frame, F.col("y"), "s").first().auc == pytest.approx(want, abs=1e-6)
    steps = [(sum(p >= t for p in pos) / (sum(p >= t for p in pos) + sum(n >= t for n in neg))) for t in pos]
    assert V.average_precision(frame, F.col("y"), "s").first().average_precision == pytest.approx(sum(steps) / len(pos), abs=1e-6)
    numbers = V.numbered_rows(frame, ["s", "id"], "k").collect()
    assert [(r.s, r.id) for r in sorted(numbers, key=lambda r: r.k)] == sorted((s, i) for i, s, _ in rows) and sorted(r.k for r in numbers) == list(range(400))


def test_poisson_bootstrap(spark):
    rng = np.random.default_rng(8)
    rows = [(f"t{i}", "g" if i % 3 else None, float(rng.normal(5, 2)), float(rng.normal(4, 2)) if i % 10 else None) for i in range(300)]
    frame = spark.createDataFrame(rows, "id string, g string, a double, b double").repartition(4)
    sums = V.bootstrap_sums(frame, "id", {"a": F.col("a"), "b": F.col("b")}, ["g"], 400)
    weights = frame.crossJoin(spark.range(1, 401).withColumnRenamed("id", "r")).where("b is not null").withColumn("w", V.resample_weight(F.col("id"), F.col("r")))
    slow = {(r.g, r.r): (r.n, r.a, r.b) for r in weights.groupBy("g", "r").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("a")).alias("a"), F.sum(F.col("w") * F.col("b")).alias("b")).collect()}
    fast = {(r.g, r.resample): (r.n, r.a, r.b) for r in sums.collect()}
    assert len(fast) == 2 * 401 and all(fast[k] == pytest.approx(slow[k]) for k in slow)
    drawn = np.array([fast["g", r][0] for r in range(1, 401)])
    n = fast["g", 0][0]
    assert abs(drawn.mean() / n - 1) < 0.02 and 0.6 < drawn.var() / n < 1.5  # Poisson: as much variance as mean
    ci = {r.g: r for r in V.bootstrap_interval(sums, (F.col("a") - F.col("b")) / F.col("n"), ["g"]).collect()}
    own = [a - b for _, g, a, b in rows if g == "g" and b is not None]
    assert ci["g"].value == pytest.approx(np.mean(own)) and ci["g"].n == len(own)
    assert ci["g"].hi - ci["g"].lo == pytest.approx(2 * 1.96 * np.std(own) / len(own) ** 0.5, rel=0.25)
    assert V.bootstrap_interval(V.bootstrap_sums(frame.limit(0), "id", {"a": F.col("a")}, ["g"], 50), F.col("a"), ["g"]).count() == 0


@pytest.mark.parametrize("case", ["near", "far", "ties", "one", "groups", "none"])
def test_nearest_against_all_pairs(spark, case):
    rng = np.random.default_rng(9)
    right = [(0, i, *map(float, rng.uniform(0, 30, 3))) for i in range(150)]
    left = [(0, i, *map(float, rng.uniform(-5, 35, 3))) for i in range(80)]
    if case == "far":  # outliers, and right in two distant lumps
        left += [(0, 900 + i, *map(float, rng.uniform(-1, 1, 3) * 10.0 ** (i % 7))) for i in range(40)]
        right += [(0, 900 + i, 5e5 + float(rng.uniform()), 5e5, 0.0) for i in range(40)]
    elif case == "ties":
        right = [(0, i, float(i % 4), float(i // 4 % 4), float(i // 16 % 2)) for i in range(96)]
        left = [(0, i, i % 4 + 0.5, float(i // 4), 0.5) for i in range(30)]
    elif case == "one":
        right = right[:1]
    elif case == "groups":
        left, right = ([(i % 5, *r[1:]) for i, r in enumerate(x)] for x in (left, right))
        right = [r for r in right if r[0] != 3]
    elif case == "none":
        right = []
    a = spark.createDataFrame([*left, (0, 999, None, 0.0, 0.0)], "g int, id int, x double, y double, z double")
    b = spark.createDataFrame([*right, (0, 998, None, 0.0, 0.0)], "g int, rank int, rx double, ry double, rz double")
    near = S.nearest(a, b, ["g", "id"], "rank", ["g"], right_xyz=("rx", "ry", "rz"))
    assert "NestedLoop" not in near._jdf.queryExecution().toString() and "Cartesian" not in near._jdf.queryExecution().toString()
    want = {}
    for g, i, *p in left:
        found = [(round(sum((u - v) ** 2 for u, v in zip(p, q, strict=True)), 9), r) for h, r, *q in right if h == g]
        if found:
            want[g, i] = min(found)
    got = {(r.g, r.id): (r.distance, r.nearest) for r in near.collect()}
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0] ** 0.5) for k in want)


def test_gaussian_cutoff_changes_nothing(spark):
    rng = np.random.default_rng(10)
    points = [(i, *map(float, rng.uniform(0, 300, 3))) for i in range(60)]
    anchors = [(*map(float, rng.uniform(0, 300, 3)), *map(float, rng.normal(0, 2, 3))) for _ in range(80)]
    got = {r.id: (r.dx, r.dy, r.dz) for r in S.gaussian_propagate(spark.createDataFrame(points, "id int, x double, y double, z double"), spark.createDataFrame(anchors, "ax double, ay double, az double, dx double, dy double, dz double"), ["id"]).collect()}
    for i, *p in points:
        w = [math.exp(-math.dist(p, q[:3]) ** 2 / 50) for q in anchors]
        want = [sum(a * q[3 + k] for a, q in zip(w, anchors, strict=True)) / (sum(w) + 1e-8) for k in range(3)]
        assert got[i] == pytest.approx(want, abs=1e-10)
    assert S.gaussian_cutoff(5.0, 1000, 2.0) < 60


def test_backends(spark):
    atoms = spark.createDataFrame([("m", k, float(k), 0.0, 0.0, k % 2 == 0) for k in range(4)], "structure_id string, serial int, x double, y double, z double, is_anchor boolean")

    def broken():
        raise ImportError("no such tool")

    E.register_backend("shift", lambda s, n, o: [s.xyz + o.get("by", 1.0) * (k + 1) for k in range(n)])
    E.register_backend("tool", lambda s, n, o: [], broken)
    try:
        assert E.resolve_backend("auto").name == "shift"  # the later one cannot be loaded
        got = {(r.frame_idx, r.serial): r.x for r in E.generate(atoms, 2, "auto", options={"by": 10.0}).collect()}
        assert got == {(f, s): s + 10.0 * f for f in range(3) for s in range(4)}
        with pytest.raises(ImportError):
            E.resolve_backend("tool")
        E.register_sql(spark, "frames_of")
        atoms.createOrReplaceTempView("some_atoms")
        rows = spark.sql("select * from frames_of(TABLE(some_atoms) PARTITION BY (structure_id), 1, 'shift')").collect()
        assert {(r.structure_id, r.frame_idx, r.serial): r.x for r in rows} == {("m", f, s): float(s + f) for f in range(2) for s in range(4)}
        E.register_backend("short", lambda s, n, o: [s.xyz[:-1]])
        with pytest.raises(Exception, match="short"):
            E.generate(atoms, 1, "short").collect()
    finally:
        for name in ("shift", "tool", "short"):
            E.forget_backend(name)
    assert E.resolve_backend("auto").name == "nma"
    with pytest.raises(ValueError):
        E.resolve_backend("shift")
    with pytest.raises(ValueError):
        E.register_backend("auto", lambda s, n, o: [])


def test_discover_with_frames_and_assembly(spark):
    box = spark.createDataFrame(box_atoms(6.0, 1.5))
    moved = E.generate(box, 2, "random").where("frame_idx > 0")
    order = {r.serial: i for i, r in enumerate(box.orderBy("serial").collect())}
    at = F.create_map(*(F.lit(v) for kv in order.items() for v in kv))
    files = moved.select("structure_id", "frame_idx", F.try_element_at(at, F.col("serial")).alias("position"), "x", "y", "z")
    one, two = (sorted(map(str, P.discover(box, P.Settings(n_conformers=2), frames=f).drop("lining_residues").collect())) for f in (moved, files))
    assert one and one == two
    names = [*(f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)), "tx", "ty", "tz"]
    op = spark.createDataFrame([(box.first().structure_id, 2, *(float(i == j) for i in range(3) for j in range(3)), 100.0, 0.0, 0.0)], "structure_id string, op_id int, " + ", ".join(f"{n} double" for n in names))
    alone, both = (P.discover(box.withColumn("chain_id", F.lit("A")), P.Settings(n_conformers=0, top=50), assembly=a).collect() for a in (None, op))
    assert alone and len(both) > len(alone)
    assert {x[-1] for r in both for x in r.lining_residues} == {"A", "B"} and {x[-1] for r in alone for x in r.lining_residues} == {"A"}


def test_file_proposals_in_every_detector_mode(spark, tmp_path):
    from voxelith.sources.tables import proposals_of_frames, read_proposals

    box = spark.createDataFrame(box_atoms())
    head = "name, rank, score, probability, center_x, center_y, center_z, residue_ids\n"
    (tmp_path / "box_frame0_predictions.csv").write_text(head + "p, 1, 9, 0.9, 0.0, 0.0, -2.0, A_1\np, 2, 1, 0.1, 500.0, 0.0, 0.0, A_1\n")
    (tmp_path / "box_frame1_predictions.csv").write_text(head + "p, 1, 9, 0.9, 0.0, 0.0, -2.5, A_1\n")
    proposals = proposals_of_frames(read_proposals(spark, str(tmp_path)))
    frames = P.frames_of(box, P.Settings(n_conformers=1, backend="random"))
    found = {m: P.detect(frames, P.Settings(detector=m), proposals).groupBy("source", "frame_idx").count().collect() for m in ("alpha", "proposals", "fusion")}
    counts = {m: {(r.source, r.frame_idx): r["count"] for r in rows} for m, rows in found.items()}
    assert counts["proposals"] == {("proposals", 0): 1, ("proposals", 1): 1}  # the place off the grid gives no row
    assert counts["fusion"] == counts["alpha"] | counts["proposals"] and ("alpha", 0) in counts["alpha"]
    ranked = P.discover(box, P.Settings(n_conformers=1, backend="random", detector="fusion"), proposals).collect()
    assert ranked and all(r.n_members >= 1 for r in ranked)


@pytest.mark.parametrize("shape", ["cloud", "chain", "apart"])
def test_contact_modes_equal_dense_ones(spark, shape):
    rng = np.random.default_rng(11)
    n = 90
    if shape == "cloud":
        xyz = rng.uniform(0, 14, (n, 3))
    elif shape == "chain":
        t = np.arange(n)
        xyz = np.column_stack([4 * np.cos(t * 1.7), 4 * np.sin(t * 1.7), 1.5 * t]) + rng.normal(0, 0.2, (n, 3))
    else:  # two bodies without a contact, and a point of its own
        xyz = np.concatenate([rng.uniform(0, 9, (45, 3)), rng.uniform(0, 9, (44, 3)) + 100, [[500.0, 0, 0]]])
    values, vectors = K.elastic_modes(xyz, 5)
    rows = [("a", 2 * i, *map(float, p), True) for i, p in enumerate(xyz)] + [("a", 1, 0.0, 0.0, 0.0, False), ("b", 0, 0.0, 0.0, 0.0, True)]
    atoms = spark.createDataFrame(rows, "structure_id string, serial int, x double, y double, z double, is_anchor boolean")
    got = E.contact_normal_modes(atoms, 5).orderBy("mode").collect()
    assert [r.structure_id for r in got] == ["a"] * len(values)
    assert [r.eigenvalue for r in got] == pytest.approx(values.tolist(), rel=1e-6)
    if shape == "cloud":
        for r, v in zip(got, vectors, strict=True):
            assert abs(float(np.dot(r.vector, v.ravel()))) > 0.9999


def test_components_over_blocks_equal_one_kernel(spark):
    rng = np.random.default_rng(12)
    rows = [(g, *map(int, v)) for g, share in ((0, 0.3), (1, 0.36), (2, 0.0)) for v in np.argwhere(rng.random((11, 10, 12)) < share)]
    rows += [(3, -i, 0, 5) for i in range(40)]  # one row over many blocks, negative places
    frame = spark.createDataFrame([*rows, rows[0]], "g int, i int, j int, k int")
    for block in (4, 32):
        got = G.components(frame, ["g"], block).collect()
        assert len(got) == len(rows)
        for g in (0, 1, 3):
            mine = sorted((r.i, r.j, r.k, r.component) for r in got if r.g == g)
            assert [m[3] for m in mine] == K.label_voxels(np.array([m[:3] for m in mine])).tolist()
    assert G.components(frame.limit(0), ["g"]).count() == 0
