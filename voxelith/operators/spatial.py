"""Range joins by cells, nearest neighbours, weighting and rigid transforms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.staging import staged

XYZ = ("x", "y", "z")


def _cell(c: Column, width: float) -> Column:
    return F.floor(c / width).cast("long")


def _around(cells: Sequence[Column]) -> Column:
    """An array of the 27 cells around a cell."""
    steps = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    return F.flatten(F.transform(steps, lambda i: F.flatten(F.transform(steps, lambda j: F.transform(steps, lambda k: F.struct((cells[0] + i).alias("i"), (cells[1] + j).alias("j"), (cells[2] + k).alias("k")))))))


def range_join(left: DataFrame, right: DataFrame, radius: float, left_xyz: Sequence[str] = XYZ, right_xyz: Sequence[str] = XYZ, on: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Pairs within radius, with dist2. Cells of the radius's width make it an equi-join; only the right side is copied, 27 times.

    Columns of the two sides must differ but for `on` (equal keys, for instance the frame).
    """
    a = left.withColumns({f"_c{k}": _cell(F.col(c), radius) for k, c in enumerate(left_xyz)})
    b = right.withColumn("_near", F.explode(_around([_cell(F.col(c), radius) for c in right_xyz])))
    b = b.select("*", *(F.col(f"_near.{n}").alias(f"_c{k}") for k, n in enumerate("ijk"))).drop("_near")
    keys = [*on, "_c0", "_c1", "_c2"]
    if how == "left_semi":
        b = b.select(*keys, *(F.col(c).alias(f"_r{k}") for k, c in enumerate(right_xyz)))
        d2 = sum(((F.col(c) - F.col(f"_r{k}")) * (F.col(c) - F.col(f"_r{k}")) for k, c in list(enumerate(left_xyz))[1:]), (F.col(left_xyz[0]) - F.col("_r0")) * (F.col(left_xyz[0]) - F.col("_r0")))
        a = a.alias("a")
        cond = d2 <= radius * radius
        for k in keys:
            cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        return a.join(b.alias("b"), cond, "left_semi").drop("_c0", "_c1", "_c2")
    joined = a.join(b, keys)
    d2 = sum(((F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in list(zip(left_xyz, right_xyz, strict=True))[1:]), (F.col(left_xyz[0]) - F.col(right_xyz[0])) * (F.col(left_xyz[0]) - F.col(right_xyz[0])))
    return joined.withColumn("dist2", d2).where(F.col("dist2") <= radius * radius).drop("_c0", "_c1", "_c2")


def range_map(left: DataFrame, right: DataFrame, radius: float, f, schema: str, xyz: Sequence[str] = XYZ, on: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """f(rows, others) of each cell of range_join, as pandas: its left rows, and right's of it and the cells around, among which are all within radius.

    For sums over pairs that are too many for a row each.
    """
    keys = [*on, "_c0", "_c1", "_c2"]
    a = left.withColumns({f"_c{k}": _cell(F.col(c), radius) for k, c in enumerate(xyz)})
    b = right.select(*(F.col(c).alias(c) for c in right.columns)).withColumn("_near", F.explode(_around([_cell(F.col(c), radius) for c in xyz])))
    b = b.select("*", *(F.col(f"_near.{n}").alias(f"_c{k}") for k, n in enumerate("ijk"))).drop("_near")
    tasks = partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.repartition(tasks, *keys).groupBy(*keys).cogroup(b.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(f, schema)


def cell_pairs(points: DataFrame, radius: float, xyz: Sequence[str] = XYZ, on: Sequence[str] = ()) -> DataFrame:
    """For each value of `on`, n points and pairs: how many pairs of them range_join would compare, from counts of cells."""
    cells = points.groupBy(*on, *(_cell(F.col(c), radius).alias(f"_c{k}") for k, c in enumerate(xyz))).agg(F.count("*").alias("_n"))
    near = cells.select(*on, F.col("_n").alias("_m"), F.explode(_around([F.col(f"_c{k}") for k in range(3)])).alias("_near"))
    near = near.groupBy(*on, *(F.col(f"_near.{n}").alias(f"_c{k}") for k, n in enumerate("ijk"))).agg(F.sum("_m").alias("_m"))
    return cells.join(near, [*on, "_c0", "_c1", "_c2"]).groupBy(*on).agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_m")).alias("pairs"))


def _dist2(left_xyz: Sequence[str], right_xyz: Sequence[str]) -> Column:
    squares = [(F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(left_xyz, right_xyz, strict=True)]
    return sum(squares[1:], squares[0])


def nearest(left: DataFrame, right: DataFrame, left_id: Sequence[str], right_rank: str, on: Sequence[str] = (), left_xyz: Sequence[str] = XYZ, right_xyz: Sequence[str] = XYZ, width: float | None = None, rings: int = 3) -> DataFrame:
    """For each left row the nearest right row with equal `on` keys: distance and rank, the lowest rank on ties (to 9 places).

    Expanding rings of cells: a left row looks at the 27 cells around it; what
    it finds within a cell's width is proven nearest. The others look again in
    cells of twice the width, `rings` times. Those still left lie far from all
    of right, whatever the ring: they go down a tree of cells instead, from one
    cell to ever finer ones, and keep those that the farthest corner of another
    does not rule out. Neither way forms all pairs.

    width: of the first cells; by default the mean spacing of right. Left rows
    without a place, or without a right row of their keys, give no row; right
    rows without a place are passed over.
    """
    spark = left.sparkSession
    lx, rx = [f"_l{c}" for c in XYZ], [f"_r{c}" for c in XYZ]
    own = [f"_k{k}" for k in range(len(on))]
    keys = [*left_id]
    asks = left.select(*keys, *(F.col(c).alias(k) for c, k in zip(on, own, strict=True)), *(F.col(c).cast("double").alias(k) for c, k in zip(left_xyz, lx, strict=True))).dropna(subset=lx)
    asks = staged(asks.distinct(), "asking")
    there = right.select(*(F.col(c).alias(k) for c, k in zip(on, own, strict=True)), F.col(right_rank).alias("rank"), *(F.col(c).cast("double").alias(k) for c, k in zip(right_xyz, rx, strict=True))).dropna(subset=rx)
    there = staged(there, "known")
    box = there.agg(F.count("*").alias("n"), *(f(c).alias(f"{n}{c}") for c in rx for n, f in (("low", F.min), ("high", F.max)))).first()
    if not box.n:
        return spark.createDataFrame([], asks.select(*keys).schema).withColumns({"distance": F.lit(None).cast("double"), "nearest": F.lit(None).cast(dict(there.dtypes)["rank"])})
    extent = max(*(box[f"high{c}"] - box[f"low{c}"] for c in rx), 1e-6)
    radius = width or max(extent / box.n ** (1 / 3), 1e-6)
    best = F.min(F.struct(F.round(_dist2(lx, rx), 9).alias("d2"), F.col("rank"))).alias("best")
    done = None
    for _ in range(rings):
        cells = there.withColumn("_near", F.explode(_around([_cell(F.col(c), radius) for c in rx]))).select(*own, "rank", *rx, *(F.col(f"_near.{n}").alias(f"_c{k}") for k, n in enumerate("ijk")))
        looking = asks.withColumns({f"_c{k}": _cell(F.col(c), radius) for k, c in enumerate(lx)})
        proven = looking.join(cells, [*own, "_c0", "_c1", "_c2"]).groupBy(*keys).agg(best).where(F.col("best.d2") < radius * radius)
        proven = staged(proven, "proven")
        done = proven if done is None else done.unionByName(proven)
        asks = staged(asks.join(proven.select(*keys), keys, "left_anti"), "asking")
        if asks.isEmpty():
            break
        radius *= 2
    else:
        done = done.unionByName(_descend(asks, there, keys, own, lx, rx, box, extent, best))
    return done.select(*keys, F.sqrt("best.d2").alias("distance"), F.col("best.rank").alias("nearest"))


def _descend(asks: DataFrame, there: DataFrame, keys: list[str], own: list[str], lx: list[str], rx: list[str], box, extent: float, best: Column) -> DataFrame:
    """The nearest rows by a tree of cells: each level halves the cells of those that were kept."""
    levels = max(1, min(12, math.ceil(math.log(box.n / 4 + 1, 8)) + 1))

    def cells_of(level: int) -> list[Column]:
        size = extent / 2**level
        return [F.least(F.floor((F.col(c) - box[f"low{c}"]) / size), F.lit(2**level - 1)).cast("long") for c in rx]

    near2 = sum((F.pow(F.greatest(F.col(f"_a{c}") - F.col(p), F.col(p) - F.col(f"_b{c}"), F.lit(0.0)), F.lit(2.0)) for p, c in zip(lx, rx, strict=True)), F.lit(0.0))
    far2 = sum((F.pow(F.greatest(F.col(p) - F.col(f"_a{c}"), F.col(f"_b{c}") - F.col(p)), F.lit(2.0)) for p, c in zip(lx, rx, strict=True)), F.lit(0.0))
    kept, parent = asks.withColumns({f"_p{k}": F.lit(0).cast("long") for k in range(3)}), [f"_p{k}" for k in range(3)]
    for level in range(1, levels + 1):
        cell = [c.alias(f"_c{k}") for k, c in enumerate(cells_of(level))]
        boxes = there.groupBy(*own, *cell).agg(*(f(c).alias(f"{n}{c}") for c in rx for n, f in (("_a", F.min), ("_b", F.max))))
        boxes = boxes.withColumns({f"_p{k}": F.floor(F.col(f"_c{k}") / 2).cast("long") for k in range(3)})
        pairs = kept.join(boxes, [*own, *parent]).select(*keys, *own, *lx, "_c0", "_c1", "_c2", near2.alias("_near"), far2.alias("_far"))
        least = F.min("_far").over(Window.partitionBy(*keys))
        kept = pairs.withColumn("_least", least).where(F.col("_near") <= F.col("_least") * (1 + 1e-9) + 1e-9).select(*keys, *own, *lx, *(F.col(f"_c{k}").alias(f"_p{k}") for k in range(3)))
    leaves = there.withColumns({f"_p{k}": c for k, c in enumerate(cells_of(levels))})
    return kept.join(leaves, [*own, *parent]).groupBy(*keys).agg(best)


def gaussian_cutoff(sigma: float, n: int, largest: float, error: float = 1e-12) -> float:
    """The distance beyond which n anchors that move by `largest` at most change no displacement by more than error.

    A weighted mean is sums over 1e-8 plus the weights, so what is left out
    weighs n * exp(-r^2 / 2 sigma^2) * largest / 1e-8 at most.
    """
    return sigma * math.sqrt(2 * math.log(max(n * max(largest, 1.0) / (1e-8 * error), math.e)))


def gaussian_propagate(points: DataFrame, anchors: DataFrame, point_id: Sequence[str], sigma: float = 5.0, on: Sequence[str] = (), error: float = 1e-12) -> DataFrame:
    """Displacements of anchors (ax, ay, az, dx, dy, dz) carried to points (x, y, z) by Gaussian weights.

    Anchors weigh on the points of their group (`on`) within gaussian_cutoff,
    found by a range join, so that pairs are in proportion to neighbours;
    points without one there stay where they are, to within `error`. Groups
    without anchors give no row.
    """
    groups = anchors.groupBy(*on).agg(F.count("*").alias("n"), F.max(F.greatest(*(F.abs(f"d{c}") for c in XYZ))).alias("d"))
    most = groups.agg(F.max("n").alias("n"), F.max("d").alias("d")).first()
    kept = points.join(anchors.select(*on).distinct(), list(on), "left_semi") if on else (points if most.n else points.limit(0))
    radius = gaussian_cutoff(sigma, most.n or 1, most.d or 0.0, error)
    # only what the sums need is copied to the cells; the ids may be names of anchors' columns as well
    near = range_join(kept.select(*on, *point_id, *XYZ), anchors.select(*on, "ax", "ay", "az", *(f"d{c}" for c in XYZ)), radius, right_xyz=("ax", "ay", "az"), on=on)
    w = F.exp(-F.col("dist2") / (2 * sigma * sigma))
    sums = near.withColumn("_w", w).groupBy(*on, *point_id).agg(F.sum("_w").alias("_sw"), *(F.sum(F.col("_w") * F.col(f"d{c}")).alias(f"_s{c}") for c in XYZ))
    out = kept.select(*on, *point_id).distinct().join(sums, [*on, *point_id], "left")
    return out.select(*on, *point_id, *(F.coalesce(F.col(f"_s{c}") / (F.col("_sw") + 1e-8), F.lit(0.0)).alias(f"d{c}") for c in XYZ))


def identity_transform() -> Column:
    """Whether r11..r33, tx, ty, tz is the identity within tolerance."""
    close = None
    for i in (1, 2, 3):
        for j in (1, 2, 3):
            delta = float(i == j)
            c = F.abs(F.col(f"r{i}{j}") - delta) <= 1e-3 + 1e-5 * delta
            close = c if close is None else close & c
    for t in "xyz":
        close = close & (F.abs(F.col(f"t{t}")) <= 0.1)
    return close


def apply_transforms(points: DataFrame, transforms: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Each point under each transform (R x + t); transforms are few (a structure's operators) and joined by `on`."""
    joined = points.join(transforms, list(on)) if on else points.crossJoin(F.broadcast(transforms))
    moved = {c: sum((F.col(f"r{i}{j}") * F.col(d) for j, d in ((2, "y"), (3, "z"))), F.col(f"r{i}1") * F.col("x")) + F.col(f"t{c}") for i, c in enumerate(XYZ, 1)}
    keep = [c for c in joined.columns if c not in XYZ and c not in {f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)} | {"tx", "ty", "tz"}]
    return joined.select(*keep, *(v.alias(k) for k, v in moved.items()))


def remap_first(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left outer join to the first right row of each key; unmatched rows keep their own values."""
    first = right.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_v"))
    joined = left.join(first, list(keys), "left")
    return joined.select(*(c for c in left.columns if c not in values), *(F.coalesce(F.col(f"_v.{v}"), F.col(v)).alias(v) for v in values), F.col("_v").isNotNull().alias("matched"))


def resolve_last(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, fallback: Column) -> DataFrame:
    """Left outer join to the last right row of each key, or a fallback."""
    last = right.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("_v"))
    return left.join(last, list(keys), "left").withColumn(value, F.coalesce("_v", fallback)).drop("_v")


def known_centroid(atoms: DataFrame, known: DataFrame, keys: Sequence[str] = ("structure_id",), place: Sequence[str] = ("chain_id", "res_seq")) -> DataFrame:
    """Mean place of the alpha carbons of known residues, over all models that atoms holds: keys, cx, cy, cz, n_atoms."""
    at = [*keys, *place]
    found = atoms.where(F.col("name") == "CA").join(known.select(*at).distinct(), at, "left_semi")
    return found.groupBy(*keys).agg(*(F.avg(c).alias(f"c{c}") for c in "xyz"), F.count("*").alias("n_atoms"))
