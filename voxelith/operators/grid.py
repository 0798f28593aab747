"""Voxel grids as relations: extents, masks, distance fields, cavities, at one voxel a length unit.

At spacing 1 every grid distance is the root of a whole number, so stencils of
squared offsets replace distance transforms and nothing is compared in floats.
Stencils are constants of fixed size and become array literals; the same
relations work for any number of groups (structure, frame) at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.staging import staged

PADDING, MASK_RADIUS, FIELD_D2 = 5.0, 1.7, 59
ALPHA_LOW, ALPHA_HIGH, LINING, BALL = 1.6, 6.0, 5.0, 4


def stencil(reach: int, keep) -> list[tuple[int, int, int]]:
    """Offsets within reach on each axis that keep(i, j, k) admits."""
    return [o for o in product(range(-reach, reach + 1), repeat=3) if keep(*o)]


def mask_stencil(spacing: float = 1.0, radius: float = MASK_RADIUS) -> list[tuple[int, int, int]]:
    return stencil(int(radius / spacing), lambda i, j, k: (i * i + j * j + k * k) * spacing * spacing <= radius * radius)


def ball_stencil(radius: int = BALL) -> list[tuple[int, int, int]]:
    """Six-neighbour dilation repeated radius times."""
    return stencil(radius, lambda i, j, k: abs(i) + abs(j) + abs(k) <= radius)


def box_stencil(reach: int) -> list[tuple[int, int, int]]:
    return stencil(reach, lambda i, j, k: True)


def _spread(voxels: DataFrame, offsets: Sequence[tuple[int, int, int]], extra: Sequence[Column] = ()) -> DataFrame:
    """Each voxel at each offset: its columns with i, j, k moved, and d2 of the offset."""
    out = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip((*o, sum(x * x for x in o)), ("di", "dj", "dk", "d2"), strict=True))) for o in offsets))
    rest = [c for c in voxels.columns if c not in "ijk"]
    moved = voxels.withColumn("_o", F.explode(out))
    return moved.select(*rest, *((F.col(c) + F.col(f"_o.d{c}")).alias(c) for c in "ijk"), F.col("_o.d2").alias("d2"), *extra)


def extents(points: DataFrame, keys: Sequence[str], spacing: float = 1.0) -> DataFrame:
    """Lower corner and number of voxels on each axis for each group."""
    agg = points.groupBy(*keys).agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    agg = agg.withColumns({f"lo{c}": F.col(f"lo{c}") - PADDING for c in "xyz"})
    return agg.select(*keys, *(f"lo{c}" for c in "xyz"), *((F.ceil((F.col(f"hi{c}") + PADDING - F.col(f"lo{c}")) / spacing) + 1).cast("int").alias(f"n{c}") for c in "xyz"))


def voxelize(points: DataFrame, grid: DataFrame, keys: Sequence[str], spacing: float = 1.0) -> DataFrame:
    """Distinct voxels i, j, k of the points, rounded half to even and held inside the grid."""
    joined = points.join(grid, list(keys))
    at = [F.greatest(F.lit(0), F.least(F.col(f"n{c}") - 1, F.rint((F.col(c) - F.col(f"lo{c}")) / spacing).cast("int"))).alias(v) for c, v in zip("xyz", "ijk", strict=True)]
    return joined.select(*keys, *at).distinct()


def _inside(voxels: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = None
    for v, c in zip("ijk", "xyz", strict=True):
        one = (F.col(v) >= 0) & (F.col(v) < F.col(f"n{c}"))
        cond = one if cond is None else cond & one
    return voxels.join(grid.select(*keys, "nx", "ny", "nz"), list(keys)).where(cond).drop("nx", "ny", "nz")


def protein_mask(voxels: DataFrame, grid: DataFrame, keys: Sequence[str], spacing: float = 1.0) -> DataFrame:
    """Voxels within the mask radius of an occupied voxel."""
    return _inside(_spread(voxels, mask_stencil(spacing)).drop("d2").distinct(), grid, keys)


def distance_field(mask: DataFrame, grid: DataFrame, keys: Sequence[str], max_d2: int = FIELD_D2) -> DataFrame:
    """Squared distance to the mask, for voxels outside it up to max_d2: what the alpha test needs."""
    reach = int(max_d2**0.5)
    field = mask.select(*keys, "i", "j", "k").withColumn("d2", F.lit(0))
    for axis in "ijk":  # the nearest along one axis after another
        steps = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(s * s).alias("q")) for s in range(-reach, reach + 1)))
        moved = field.withColumn("_o", F.explode(steps)).withColumns({axis: F.col(axis) + F.col("_o.s"), "d2": F.col("d2") + F.col("_o.q")})
        field = moved.where(F.col("d2") <= max_d2).groupBy(*keys, "i", "j", "k").agg(F.min("d2").alias("d2"))
    return _inside(field.where("d2 > 0"), grid, keys)


def alpha_points(field: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Voxels whose distance is the largest of their 3x3x3 surroundings and between the alpha limits; plateaus all count."""
    low, high = ALPHA_LOW**2, ALPHA_HIGH**2
    best = _spread(field.withColumnRenamed("d2", "own"), box_stencil(1)).groupBy(*keys, "i", "j", "k").agg(F.max("own").alias("best"))
    candidate = field.where((F.col("d2") >= low) & (F.col("d2") <= high))
    return candidate.join(best.hint("merge"), [*keys, "i", "j", "k"]).where("d2 = best").drop("best")


def dilate(voxels: DataFrame, grid: DataFrame, keys: Sequence[str], radius: int = BALL) -> DataFrame:
    """Voxels within `radius` six-neighbour steps, inside the grid."""
    return _inside(_spread(voxels.select(*keys, "i", "j", "k"), ball_stencil(radius)).drop("d2").distinct(), grid, keys)


def local_density(mask: DataFrame, at: DataFrame, keys: Sequence[str], reach: int = 4) -> DataFrame:
    """Share of mask voxels in the box around each voxel of `at`."""
    counts = _spread(mask.select(*keys, "i", "j", "k"), box_stencil(reach)).groupBy(*keys, "i", "j", "k").agg(F.count("*").alias("_c"))
    joined = at.join(counts, [*keys, "i", "j", "k"], "left")
    return joined.select(*at.columns, (F.coalesce("_c", F.lit(0)) / float((2 * reach + 1) ** 3)).alias("density"))


def components(voxels: DataFrame, keys: Sequence[str], block: int = 32) -> DataFrame:
    """Adds component: six-connected parts of each group, numbered from 1 by their first voxel in (i, j, k).

    Two levels, so that a grid need not fit in one task: a kernel labels each
    block of block^3 voxels; voxels that meet over a block's face are joined to
    edges between labels; a union-find over the edges of a group, which grow
    with its faces alone, joins the labels.
    """
    import pandas as pd

    from voxelith.operators.kernels import joined_labels, label_voxels

    first = ("_fi", "_fj", "_fk")
    flat = voxels.select(*keys, "i", "j", "k").distinct()
    kinds = dict(flat.dtypes)
    own = [f"_b{c}" for c in "ijk"]
    blocks = flat.withColumns({f"_b{c}": F.floor(F.col(c) / block).cast("int") for c in "ijk"})

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j", "k"]).reset_index(drop=True)
        places = pdf[["i", "j", "k"]].to_numpy()
        number = label_voxels(places)
        at = pd.Series(range(len(pdf))).groupby(number).transform("min").to_numpy()  # each label's first voxel
        return pdf.assign(**{n: places[at, c] for c, n in enumerate(first)})

    schema = ", ".join(f"{c} {kinds[c]}" for c in flat.columns) + ", _bi int, _bj int, _bk int, " + ", ".join(f"{n} {kinds[c]}" for n, c in zip(first, "ijk", strict=True))
    local = staged(blocks.groupBy(*keys, *own).applyInPandas(label, schema), "blocks")
    edges = None
    for c in "ijk":
        low = local.where(F.pmod(F.col(c), F.lit(block)) == block - 1).select(*keys, *((F.col(x) + 1 if x == c else F.col(x)).alias(x) for x in "ijk"), *(F.col(n).alias(f"{n}1") for n in first))
        high = local.where(F.pmod(F.col(c), F.lit(block)) == 0).select(*keys, "i", "j", "k", *(F.col(n).alias(f"{n}2") for n in first))
        met = low.join(high, [*keys, "i", "j", "k"]).select(*keys, *(f"{n}{m}" for m in (1, 2) for n in first)).distinct()
        edges = met if edges is None else edges.unionByName(met)

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, roots = joined_labels(pdf[[f"{n}1" for n in first]].to_numpy(), pdf[[f"{n}2" for n in first]].to_numpy())
        out = pd.DataFrame(dict(zip((*first, "_ri", "_rj", "_rk"), [*nodes.T, *roots.T], strict=True)))
        for x in reversed(list(keys)):
            out.insert(0, x, pdf[x].iloc[0])
        return out

    roots = edges.groupBy(*keys).applyInPandas(union, ", ".join([*(f"{x} {kinds[x]}" for x in keys), *(f"{n} {kinds[c]}" for n, c in zip(first, "ijk", strict=True)), *(f"_r{c} {kinds[c]}" for c in "ijk")]))
    known = local.join(roots, [*keys, *first], "left")
    rooted = known.select(*keys, "i", "j", "k", *(F.coalesce(F.col(f"_r{c}"), F.col(n)).alias(f"_r{c}") for n, c in zip(first, "ijk", strict=True)))
    order = Window.partitionBy(*keys).orderBy("_ri", "_rj", "_rk")
    numbers = rooted.select(*keys, "_ri", "_rj", "_rk").distinct().withColumn("component", F.row_number().over(order))
    return rooted.join(numbers, [*keys, "_ri", "_rj", "_rk"]).select(*keys, "i", "j", "k", "component")


def cavities(parts: DataFrame, mask: DataFrame, keys: Sequence[str], spacing: float = 1.0) -> DataFrame:
    """Volume of each component without the mask."""
    free = parts.join(mask, [*keys, "i", "j", "k"], "left_anti")
    return free.groupBy(*keys, "component").agg((F.count("*") * spacing**3).alias("volume"))


POCKET = "cx double, cy double, cz double, volume double, enclosure double, hydrophobic_fraction double, aromatic_count int, lining_residues array<string>"


def detect_pockets(atoms: DataFrame, keys: Sequence[str] = ("structure_id", "frame_idx"), spacing: float = 1.0, min_volume: float = 80.0) -> DataFrame:
    """Pockets of each group of atoms (x, y, z, res_idx, res_label, hydrophobic, aromatic), one kernel call a group.

    A group is one frame of one structure, whose grid bounds the memory.
    """
    import pandas as pd

    from voxelith.operators.kernels import find_pockets

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = find_pockets(pdf, spacing, min_volume)
        out = pd.DataFrame(rows, columns=["pocket_idx", *(f.split()[0] for f in POCKET.split(", "))])
        for k in reversed(list(keys)):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return _kernel(atoms, keys).groupBy(*keys).applyInPandas(run, _schema(atoms, keys) + ", pocket_idx int, " + POCKET)


def characterize(atoms: DataFrame, centres: DataFrame, keys: Sequence[str] = ("structure_id", "frame_idx"), spacing: float = 1.0) -> DataFrame:
    """The pocket around each given centre (px, py, pz, proposal); no row where it lies off the grid or has no room."""
    import pandas as pd

    from voxelith.operators.kernels import characterize_at

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = characterize_at(left, right, spacing) if len(left) and len(right) else []
        out = pd.DataFrame(rows, columns=["proposal", *(f.split()[0] for f in POCKET.split(", "))])
        for k in reversed(list(keys)):
            out.insert(0, k, (left if len(left) else right)[k].iloc[0])
        return out

    right = centres.select(*keys, "proposal", "px", "py", "pz").groupBy(*keys)
    return _kernel(atoms, keys).groupBy(*keys).cogroup(right).applyInPandas(run, _schema(atoms, keys) + ", proposal int, " + POCKET)


def _kernel(atoms: DataFrame, keys: Sequence[str]) -> DataFrame:
    return atoms.select(*keys, "x", "y", "z", "res_idx", "res_label", "hydrophobic", "aromatic")


def _schema(atoms: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(atoms.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)
