"""Exact top-k search by inner product: three-phase uniform threshold.

The dimensions are dealt into `nodes` blocks; a candidate's score is the sum of
its partial scores on them. Queries go in blocks of bounded size, which are
broadcast; candidates are never shuffled.

1. Each task lists, for every query and block of dimensions, the k candidates
   with the highest partial scores, and gathers the k highest whole scores
   among those listed. The k-th highest over all tasks is a safe cutoff: k
   candidates reach it.
2. The cutoffs are broadcast. A sum that reaches cutoff c has some part of at
   least c / nodes, so each task collects every candidate with such a part.
3. The whole scores of those collected are resolved exactly; those that reach
   the cutoff and are among their task's k best are ranked.

Ties go to the smaller vec_id. Components are scaled to whole numbers by
floor(scale * x), and scores are exact: in float64 where no sum can pass 2**53,
else in Python's integers, held to the range of a long.

Defined cases: vectors that are null, empty, or hold a null or non-finite
component take no part, nor do pairs of unequal length; rows with a null vec_id
take no part; of repeated rows with one vec_id each is a candidate, but never of a
query with that vec_id; a query without candidates gives no row; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

_LONG = (-(1 << 63), (1 << 63) - 1)
#: Queries a broadcast block: 4096 queries of 64 dimensions are 2 MB.
BLOCK_BYTES = 2 << 20


def _vectors(ids: pa.Array, raw: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: vec_ids and the matrix of scaled components (float64 whole numbers)."""
    lists = raw.cast(pa.list_(pa.float64()))
    offsets = lists.offsets.to_numpy()
    n = np.diff(offsets)
    flat = lists.values.to_numpy(zero_copy_only=False)
    who = ids.to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(n):
        rows = np.flatnonzero(n == d)
        out[int(d)] = (who[rows].astype(np.int64), flat[offsets[rows][:, None] + np.arange(d)])
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers as int64, or as clipped Python integers where they are too large."""
    most = max(float(np.abs(q).max(initial=0)), 1.0) * max(float(np.abs(x).max(initial=0)), 1.0) * max(q.shape[1], 1)
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(q) @ exact(x).T, *_LONG).astype(np.int64)


def _blocks(d: int, nodes: int) -> list[slice]:
    cuts = np.linspace(0, d, min(nodes, d) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _partial(q: np.ndarray, x: np.ndarray, nodes: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The partial scores on each block of dimensions, and the whole ones: their sum, so that each product is formed once."""
    parts = [_scores(q[:, dims], x[:, dims]) for dims in _blocks(q.shape[1], nodes)]
    if max(float(np.abs(p).max(initial=0)) for p in parts) * len(parts) < _LONG[1] // 2:
        return parts, reduce(np.add, parts)
    return parts, _scores(q, x)


def _batched(batches, rows: int = 4096):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield from _vectors(part.column("vec_id"), part.column("v")).items()


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, nodes: int = 4) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    base = usable.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"),
        is_query.alias("asks"),
    )
    candidates = base.drop("asks")
    asked = staged(base.where("asks").drop("asks"), "queries")
    parts = [_search(spark, block, candidates, k, nodes) for block in _query_blocks(asked)]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, parts, empty) if len(parts) != 1 else parts[0]


def _query_blocks(asked: DataFrame):
    """The queries in blocks of at most BLOCK_BYTES, one at a time on the driver."""
    held, size = [], 0
    for r in asked.select("vec_id", "v").toLocalIterator(prefetchPartitions=False):
        held.append((r.vec_id, r.v))
        size += 8 * len(r.v)
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _search(spark, block: list, candidates: DataFrame, k: int, nodes: int) -> DataFrame:
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # number in the block, vec_id, components
    for d in {len(v) for _, v in block}:
        at = [i for i, (_, v) in enumerate(block) if len(v) == d]
        by_length[d] = (np.array(at), np.array([block[i][0] for i in at], dtype=np.int64), np.array([block[i][1] for i in at], dtype=np.float64))
    sent = spark.sparkContext.broadcast(by_length)
    nq = len(block)

    def listed(batches):
        best = np.full((nq, 0), _LONG[0], dtype=np.int64)
        for d, (ids, x) in _batched(batches):
            if d not in sent.value:
                continue
            at, own, q = sent.value[d]
            parts, whole = _partial(q, x, nodes)
            whole[own[:, None] == ids[None, :]] = _LONG[0]
            picks = []
            for part in parts:
                part[own[:, None] == ids[None, :]] = _LONG[0] + 1
                n = min(k, part.shape[1])
                picks.append(np.argpartition(-part, n - 1, axis=1)[:, :n])
            chosen = np.sort(np.concatenate(picks, axis=1), axis=1)
            got = np.take_along_axis(whole, chosen, axis=1)
            got[:, 1:][chosen[:, 1:] == chosen[:, :-1]] = _LONG[0]  # listed by two blocks
            more = np.full((nq, got.shape[1]), _LONG[0], dtype=np.int64)
            more[at] = got
            best = np.sort(np.concatenate((best, more), axis=1), axis=1)[:, -k:]
        if best.shape[1]:
            rows, cols = np.nonzero(best > _LONG[0])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(best[rows, cols], pa.int64())], names=["q", "score"])

    heard = candidates.mapInArrow(listed, "q int, score long")
    nth = Window.partitionBy("q").orderBy(F.desc("score"))
    floors = heard.withColumn("n", F.row_number().over(nth)).where(F.col("n") == k).select("q", "score").collect()
    cut = np.full(nq, _LONG[0] + 1, dtype=np.int64)  # with fewer than k candidates, all are sufficient
    for r in floors:
        cut[r.q] = r.score
    cutoff = spark.sparkContext.broadcast(cut)

    def collected(batches):
        for d, (ids, x) in _batched(batches):
            if d not in sent.value:
                continue
            at, own, q = sent.value[d]
            least = cutoff.value[at]
            parts, whole = _partial(q, x, nodes)
            share = np.floor_divide(least, len(parts))[:, None]
            enough = reduce(np.logical_or, (part >= share for part in parts))
            enough &= own[:, None] != ids[None, :]
            rows, cols = np.nonzero(enough)
            if not len(rows):
                continue
            whole = whole[rows, cols]
            keep = whole >= least[rows]
            rows, cols, whole = rows[keep], cols[keep], whole[keep]
            order = np.lexsort((ids[cols], -whole, rows))
            rows, cols, whole = rows[order], cols[order], whole[order]
            first = np.searchsorted(rows, rows, side="left")
            keep = np.arange(len(rows)) - first < k
            rows, cols, whole = rows[keep], cols[keep], whole[keep]
            yield pa.RecordBatch.from_arrays([pa.array(own[rows], pa.int64()), pa.array(at[rows], pa.int32()), pa.array(ids[cols], pa.int64()), pa.array(whole, pa.int64())], names=["query_id", "q", "vec_id", "score"])

    found = candidates.mapInArrow(collected, "query_id long, q int, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """with e as (select row_number() over () r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) v from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  s as (select q.vec_id query_id, q.r qr, c.vec_id, list_dot_product(q.v, c.v)::bigint score from e q join e c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0),
  n as (select *, row_number() over (partition by qr order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from n where rank <= 10"""
