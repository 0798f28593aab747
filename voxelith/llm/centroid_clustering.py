"""Centroid clustering of whole-number vectors by partial-distance search.

Lloyd's rounds: every vector goes to its nearest centroid, then each centroid
that has vectors becomes their mean, rounded down. A round reads the table
once; a task sums the components of its vectors by centroid before anything
moves, so that a shuffle and the driver see `k` rows of sums, whatever the
number of vectors.

Nearest centroids are found by partial distances. The dimensions are taken in
the order of their variance over all vectors, the highest first, FIRST at a
time. The centroid that is nearest in the first dimensions is measured in full;
any other one is given up as soon as its partial sum is strictly above the best
full distance, and finished over all dimensions else. Sums are whole numbers,
so what is given up could not have won, and ties go to the smaller number.

Components are scaled to floor(scale * x) and held to LIMIT either way, the
most with which every squared distance of 64 components fits a long.

Defined cases: vectors that are null, of another length, or hold a null or
non-finite component take no part and give no row; a null vec_id is kept, is
never a first centroid and comes out as null; repeated rows count each, and of
equal first-centroid hashes the smaller vector comes first; fewer vectors than
k give fewer centroids, and without any (null vec_ids only) clusters are null; a sum of distances beyond a long is held to its range;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

LIMIT, FIRST = 1 << 27, 8
_MOST = (1 << 63) - 1


@dataclass
class Centroids:
    """The centroids (k rows of whole numbers) and the dimensions in the order in which they are summed."""

    rows: np.ndarray
    order: np.ndarray


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims) & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def scaled(raw: pa.Array, dims: int, scale: int) -> np.ndarray:
    """The components of a batch as whole numbers, a row a vector."""
    flat = raw.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.clip(np.floor(flat * scale), -LIMIT, LIMIT).astype(np.int64)


def nearest(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest centroid and its squared distance, by partial-distance search."""
    order = centroids.order
    x, c = x[:, order], centroids.rows[:, order]
    n, d = x.shape
    steps = range(FIRST, d, FIRST)
    head = np.stack([((x[:, :FIRST] - row[:FIRST]) ** 2).sum(axis=1) for row in c], axis=1)
    winner = head.argmin(axis=1)
    best = head[np.arange(n), winner] + ((x[:, FIRST:] - c[winner][:, FIRST:]) ** 2).sum(axis=1)
    begun = winner.copy()
    for j in range(len(c)):
        alive = np.flatnonzero((begun != j) & (head[:, j] <= best))
        total = head[alive, j]
        for a in steps:
            if not len(alive):
                break
            total = total + ((x[alive, a : a + FIRST] - c[j, a : a + FIRST]) ** 2).sum(axis=1)
            going = total <= best[alive]
            alive, total = alive[going], total[going]
        better = (total < best[alive]) | (j < winner[alive])
        winner[alive[better]], best[alive[better]] = j, total[better]
    return winner, best


def _moments(kept: DataFrame, dims: int, scale: int) -> np.ndarray:
    """The variance of each component over all vectors; a row a task and component moves."""

    def run(batches):
        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            x = scaled(batch.column("embedding"), dims, scale).astype(np.float64)
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(s), pa.array(q)], names=["dim", "n", "s", "q"])

    sums = kept.select("embedding").mapInArrow(run, "dim int, n long, s double, q double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    out = np.zeros(dims)
    for r in sums:
        out[r.dim] = r.q / r.n - (r.s / r.n) ** 2
    return out


def _sums(kept: DataFrame, centroids: Centroids, dims: int, scale: int) -> list:
    """Count and component sums of each centroid's vectors: at most k rows, summed in tasks first."""
    sent = kept.sparkSession.sparkContext.broadcast(centroids)
    k = len(centroids.rows)

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = scaled(batch.column("embedding"), dims, scale)
            if len(x):
                who, _ = nearest(x, sent.value)
                count += np.bincount(who, minlength=k)
                np.add.at(total, who, x)
        some = np.flatnonzero(count)
        if len(some):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dims, pa.int32()), pa.array(total[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), lists], names=["cluster", "n", "total"])

    parts = kept.select("embedding").mapInArrow(run, "cluster int, n long, total array<long>")
    wide = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect()


def first_centroids(kept: DataFrame, k: int, seed: str, dims: int, scale: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of seed and vec_id, in that order."""
    whole = F.transform("embedding", lambda c: F.greatest(F.least(F.floor(c * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("long"))
    hashed = kept.where(F.col("vec_id").isNotNull()).select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), whole.alias("v"))
    rows = hashed.orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64).reshape(len(rows), dims)


def fit(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1:") -> Centroids:
    """The centroids after the given rounds."""
    kept = usable(vectors, dims)
    rows = first_centroids(kept, k, seed, dims, scale)
    centroids = Centroids(rows, np.argsort(-_moments(kept, dims, scale), kind="stable"))
    for _ in range(rounds if len(rows) else 0):
        rows = centroids.rows.copy()
        for r in _sums(kept, centroids, dims, scale):
            rows[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dims)]
        centroids = Centroids(rows, centroids.order)
    return centroids


def assign(vectors: DataFrame, centroids: Centroids, scale: int = 64) -> DataFrame:
    """vec_id, cluster and squared distance of every vector that takes part."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)
    dims = len(centroids.order)

    def run(batches):
        for batch in batches:
            x = scaled(batch.column("embedding"), dims, scale)
            if len(x) and len(sent.value.rows):
                who, distance = nearest(x, sent.value)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(who, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])
            elif len(x):  # only null vec_ids: no first centroid
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.int64())], names=["vec_id", "cluster", "distance"])

    return usable(vectors, dims).mapInArrow(run, "vec_id long, cluster int, distance long")


def digest(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector after the last round."""
    centroids = fit(vectors, k, rounds, dims, scale, seed)
    found = staged(assign(vectors, centroids, scale), "assigned")
    sums = {r.cluster: int(r.w) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("w")).collect() if r.w is not None}  # k rows at most
    shas = {i: hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for i, row in enumerate(centroids.rows.tolist())}
    inertia = min(sum(sums.values()), _MOST)
    clusters = vectors.sparkSession.createDataFrame([(i, min(w, _MOST), inertia, shas[i]) for i, w in sorted(sums.items())], "number int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters), F.col("cluster") == F.col("number"), "left").drop("number")


def digest_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1:") -> str:
    """DuckDB SQL for digest, a common table expression a round."""
    steps = [
        f"""e as (select row_number() over () r, vec_id, list_transform(embedding, lambda x: least(greatest(floor({scale} * x::double), -{LIMIT}), {LIMIT})::bigint) v from embeddings
    where embedding is not null and len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"x as (select r, unnest(range(1, {dims + 1})) d, unnest(v) a from e)",
        f"f as (select (row_number() over (order by sha256('{seed}' || vec_id), v))::int - 1 c, v from e where vec_id is not null qualify c < {k})",
        f"c0 as (select c, unnest(range(1, {dims + 1})) d, unnest(v) b from f)",
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} as (select r, c, sum((a - b) * (a - b))::bigint w from x join c{i} using (d) group by r, c)")
        steps.append(f"n{i} as (select r, c, w from d{i} qualify row_number() over (partition by r order by w, c) = 1)")
        if i < rounds:
            steps.append(f"s{i} as (select c, d, sum(a)::hugeint s, count(*)::hugeint n from n{i} join x using (r) group by c, d)")
            steps.append(f"c{i + 1} as (select c, d, case when n is null then b else ((s - ((s % n) + n) % n) // n)::bigint end b from c{i} left join s{i} using (c, d))")
    last = rounds
    return f"""with {", ".join(steps)},
  h as (select c, sha256(string_agg(b::varchar, ',' order by d)) z from c{last} group by c)
select vec_id, c::int as cluster, w as distance, (sum(w) over (partition by c))::bigint as cluster_inertia, (sum(w) over ())::bigint as inertia, z as centroid_sha256
from n{last} join e using (r) join h using (c)"""
