"""Centroid clustering against a plain loop over all centroids and components."""

import hashlib
import math
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from voxelith.llm import centroid_clustering as C

SCHEMA = "vec_id long, embedding array<float>, cluster int, inertia string"


def brute(rows, k=16, rounds=3, dims=64, scale=64):
    kept = [
        (i, [max(-C.LIMIT, min(C.LIMIT, math.floor(scale * float(np.float32(x))))) for x in v])
        for i, v, *_ in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(float(np.float32(x))) for x in v)
    ]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    first = sorted(((sha(f"1:{i}"), v) for i, v in kept if i is not None))[:k]
    centroids = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for j, some in members.items():
            centroids[j] = [sum(col) // len(some) for col in zip(*some, strict=True)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    most = (1 << 63) - 1
    total = lambda j=None: min(most, sum(w for _, c, w in found if j in (None, c)))
    return sorted(((i, c, w, total(c), total(), sha(",".join(map(str, centroids[c])))) for i, c, w in found), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    out = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centres)], 5, "x") for i in range(150)]
    out += [(200 + i, [float(rng.choice((-1, 0, 1))) for _ in range(64)], 5, "x") for i in range(30)]  # ties
    out += [(300 + i, [0.5] * 64, 5, "x") for i in range(40)]  # one hot vector
    out += [(400, None, 1, "a"), (401, [], 1, "a"), (402, [1.0] * 63, 1, "a"), (403, [None] + [1.0] * 63, 1, "a"), (404, [math.nan] * 64, 1, "a"), (405, [math.inf] + [0.0] * 63, 1, "a")]
    return [*out, out[3], out[3], (None, out[4][1], 0, "n")]


def test_digest(spark, rows):
    got = C.digest(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("case", ["few", "huge", "none", "null ids"])
def test_digest_of_odd_tables(spark, rows, case):
    some = {"few": rows[:5], "huge": [(i, [(-1) ** i * 3e38 / (i + 1)] * 64, 0, "") for i in range(20)], "none": [], "null ids": [(None, [1.0] * 64, 0, "")]}[case]
    got = sorted(map(tuple, C.digest(spark.createDataFrame(some, SCHEMA)).collect()), key=str)
    assert got == ([(None, None, None, None, None, None)] if case == "null ids" else brute(some) if some else [])


def test_digest_like_its_sql(spark, rows, tmp_path):
    import duckdb

    vectors = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    vectors.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    assert sorted(map(tuple, C.digest(vectors).collect()), key=str) == sorted(con.execute(C.digest_sql()).fetchall(), key=str)


def test_partial_distances_find_the_nearest():
    rng = np.random.default_rng(2)
    for high in (2, 100, C.LIMIT):
        x, c = rng.integers(-high, high, (500, 64)), rng.integers(-high, high, (16, 64))
        far = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        who, distance = C.nearest(x, C.Centroids(c, rng.permutation(64)))
        assert (who == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
