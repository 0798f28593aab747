"""Tests of the findings of round 4."""

import os

import numpy as np
import pytest

from voxelith import queries as Q

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _cloud(n, seed=3):
    return np.round(np.random.default_rng(seed).normal(0, 5, (n, 3)), 2)


def _rows(name, xyz):
    return [(name, k, *map(float, p), True) for k, p in enumerate(xyz)]


ATOMS = "structure_id string, serial int, x double, y double, z double, is_anchor boolean"


def test_contacts_of_dense_structures_are_not_joined(spark, monkeypatch):
    from voxelith.operators import ensembles as E
    from voxelith.operators import kernels as K
    from voxelith.operators import spatial as S

    t = np.arange(150)
    chain = np.column_stack([4 * np.cos(t * 1.7), 4 * np.sin(t * 1.7), 1.5 * t])
    clouds = {"dense": _cloud(120), "few": _cloud(40) / 2, "chain": chain}
    monkeypatch.setattr(K, "DENSE", 100)  # for what is joined; tasks keep their own
    atoms = spark.createDataFrame([r for k, v in clouds.items() for r in _rows(k, v)], ATOMS)
    joined, join = [], S.range_join

    def watched(left, *args, **kwargs):
        joined.extend(r.structure_id for r in left.select("structure_id").distinct().collect())
        return join(left, *args, **kwargs)

    monkeypatch.setattr(S, "range_join", watched)
    found = E.contact_normal_modes(atoms, 3)
    assert sorted(joined) == ["chain", "few"]
    got = {(r.structure_id, r.mode): r for r in found.collect()}
    assert len(got) == 9
    monkeypatch.undo()
    for name, xyz in clouds.items():
        values, vectors = K.elastic_modes(xyz, 3)
        assert [got[name, k].eigenvalue for k in range(3)] == pytest.approx(values.tolist(), rel=1e-6)
        assert name == "chain" or all(abs(np.dot(got[name, k].vector, vectors[k].ravel())) > 0.999999 for k in range(3))  # a chain bends to any side alike


def test_modes_take_few_products(monkeypatch):
    from voxelith.operators import kernels as K

    xyz, columns, made = _cloud(1500), [], K._product_of_points

    def counted(*args):
        product, *rest = made(*args)

        def count(x, *kind):
            columns.append(x.shape[1])
            return product(x, *kind)

        return count, *rest

    monkeypatch.setattr(K, "_product_of_points", counted)
    monkeypatch.setattr(K, "FACTORED", 10)
    values, modes = K.elastic_modes(xyz, 5)
    assert sum(columns) < 250  # 394 for 2564 points before
    flat = modes.reshape(5, -1)
    rest = K._product(1500, K._rows_of_points(xyz, 8.0, 1.0), flat.T) - flat.T * values
    assert np.abs(rest).max() < 1e-7 and np.abs(flat @ flat.T - np.eye(5)).max() < 1e-9
    whole = np.linalg.eigvalsh(K._rows_of_points(xyz, 8.0, 1.0)(0, 1500, 1500))
    assert values == pytest.approx(K._picked(1500, whole[:26], np.zeros((4500, 26)) + 1.0, 5)[0], rel=1e-8)


@pytest.mark.parametrize("kind", [np.float64, np.float32])
def test_springs_at_the_limit_are_the_same_in_single_precision(kind):
    """Points at exactly the cutoff, at one place, and a hair apart; a far one; tiles that lie apart."""
    from voxelith.operators import kernels as K

    grid = np.stack(np.meshgrid(*[np.arange(0, 24, 4.0)] * 3), axis=-1).reshape(-1, 3) + 0.1
    xyz = np.concatenate([grid, grid[:20], grid[:20] + 1e-5, grid[:9] + 300.0, [[9e3, 0, 0]]])
    xyz = xyz[K._compact(xyz, K._TILE)]
    n, factors = len(xyz), np.random.default_rng(1).uniform(0.5, 2, (len(xyz),) * 2)
    x = np.random.default_rng(2).normal(0, 1, (3 * n, 4))
    for gamma in (1.0, factors + factors.T):
        product, own, _ = K._product_of_points(xyz, 8.0, gamma)
        rows = K._rows_of_points(xyz, 8.0, gamma)
        assert np.abs(product(x, kind) - K._product(n, rows, x)).max() < (1e-10 if kind is np.float64 else 2e-3)
        assert np.abs(own - np.stack([rows(0, n, n)[3 * k : 3 * k + 3, 3 * k : 3 * k + 3] for k in range(n)])).max() < 1e-10


def test_spring_forces_are_the_matrix_times_the_moves():
    from voxelith.operators import kernels as K

    xyz = np.concatenate([_cloud(300), _cloud(300)[:5]])
    moves = np.random.default_rng(2).normal(0, 1, (305, 4, 3))
    got = sum(K.spring_forces(xyz, moves, part, part_moves) for part, part_moves in ((xyz[:100], moves[:100]), (xyz[100:], moves[100:])))
    want = K._product(305, K._rows_of_points(xyz, 8.0, 1.0), moves.transpose(0, 2, 1).reshape(915, 4)).reshape(305, 3, 4).transpose(0, 2, 1)
    assert np.abs(got - want).max() < 1e-9


@tables
def test_mode_equations_give_no_row_a_pair(spark):
    found = Q.queries()["mode_equations"](spark, SF)
    assert "dist2" not in found._jdf.queryExecution().toString()
    assert {(r.solves, r.unit) for r in found.collect()} == {(True, True)}


@pytest.mark.parametrize("kind", ["nma", "random"])
def test_frames_share_their_weights(monkeypatch, kind):
    from voxelith.operators import ensembles as E
    from voxelith.operators import kernels as K

    calls, carried = [], K.propagate
    monkeypatch.setattr(K, "propagate", lambda *a: calls.append(1) or carried(*a))
    xyz = _cloud(60)
    s = E.Structure("a", xyz, np.arange(60) < 40)
    frames = (E._nma_frames if kind == "nma" else E._random_frames)(s, 3, {"seed": 2})
    assert len(calls) == 1
    anchors = xyz[:40]
    w = np.exp(-((xyz[:, None] - anchors[None]) ** 2).sum(axis=2) / 50)
    values, modes = K.elastic_modes(anchors, 10)
    for i, frame in enumerate(frames):
        if kind == "nma":
            move = np.tensordot(np.random.default_rng(2 + i).normal(0, 1 / np.sqrt(np.abs(values))), modes, axes=1)
            move *= (i + 1) / 3 * 2.0 / np.sqrt((move**2).sum(axis=1).mean())
        else:
            move = np.random.default_rng(2 + 1000 * (i + 1)).normal(0, E.noise_levels(3)[i], anchors.shape)
        assert np.abs(frame - xyz - w @ move / (w.sum(axis=1, keepdims=True) + 1e-8)).max() < 1e-9


def test_blocks_of_lines_are_listed_as_a_stream():
    """Groups over the ends of batches, repeated rows, empty batches."""
    import pyarrow as pa

    from voxelith.llm import line_dedup as L

    rows = sorted((k % 7, (k * 5) % 11 - 5) for k in range(200))
    want = {l1: sorted({h for x, h in rows if x == l1}) for l1 in range(7)}
    for size in (1, 3, 64, 1000):
        parts = [rows[k : k + size] for k in range(0, len(rows), size)] + [[]]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in p], pa.int64()) for c in (1, 0)], names=["h", "l1"]) for p in parts]
        got = [(a, b) for out in L._lists(iter(batches)) for a, b in zip(out.column("l1").to_pylist(), out.column("blocks").to_pylist(), strict=True)]
        assert got == sorted(want.items())
    assert list(L._lists(iter([]))) == []


def test_near_lines_of_units_look_at_smaller_blocks_only():
    """Against all pairs: a pair belongs to the smallest block that both lines have, and lists hold only the blocks below their unit's."""
    import pyarrow as pa

    from voxelith.llm import line_dedup as L

    rng = np.random.default_rng(4)
    lines = [(int(rng.integers(0, 4)), sorted({int(b) for b in rng.integers(-30, 30, 9)})) for _ in range(80)]
    rows = sorted((h, 0, 0, lid, lid, sim, 20, [b for b in blocks if b < h]) for lid, (sim, blocks) in enumerate(lines) for h in blocks)
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["h", "i", "j", "lid", "label", "sim", "size", "blocks"])
    for cut in (0, 100):  # a slice's lists do not start at the first value
        part = batch.slice(cut)
        got = {(rows[cut + k][0], rows[cut + k][3]) for k in L._with_near(part, L._starts(part), 0.8).tolist()}
        there = [(r[0], r[3]) for r in rows[cut:]]
        want = {x for x in there for y in there if x[0] == y[0] and x[1] != y[1] and min(set(lines[x[1]][1]) & set(lines[y[1]][1])) == x[0]}
        assert got == want
