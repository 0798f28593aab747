"""Ensembles: one structure's atoms to many frames, one kernel call a structure and block of frames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelith.operators.kernels import elastic_modes, nma_frames, random_frames
from voxelith.staging import staged

MIN_ANCHORS = 6


def noise_levels(n: int, levels: Sequence[float] | None = None) -> list[float]:
    """Given levels repeated to n, or 0.3 to 2.0 in equal steps."""
    return [float(levels[k % len(levels)]) for k in range(n)] if levels else np.linspace(0.3, 2.0, n).tolist()


@dataclass(frozen=True)
class Backend:
    """A maker of frames: make(structure, n, options) gives n arrays of places in the structure's atom order."""

    name: str
    make: Callable[[Structure, int, Mapping], Sequence[np.ndarray]]
    #: Raises ImportError, or gives False, where the backend cannot run.
    loads: Callable[[], object] = lambda: True


@dataclass
class Structure:
    """What a backend gets: the structure's id, its atoms' places and which of them are anchors."""

    structure_id: object
    xyz: np.ndarray
    is_anchor: np.ndarray
    springs: object = None


#: By name; `auto` takes the first that loads, those registered last before the built-in ones.
_BACKENDS: dict[str, Backend] = {}


def register_backend(name: str, make: Callable[[Structure, int, Mapping], Sequence[np.ndarray]], loads: Callable[[], object] = lambda: True) -> Backend:
    """Let `generate` and the SQL function make frames by a function of one's own; a name given again is replaced."""
    if name == "auto":
        raise ValueError("auto is not a backend's name")
    _BACKENDS.pop(name, None)
    _BACKENDS[name] = Backend(name, make, loads)
    return _BACKENDS[name]


def forget_backend(name: str) -> None:
    _BACKENDS.pop(name, None)


def _usable(backend: Backend) -> bool:
    try:
        return backend.loads() is not False
    except ImportError:
        return False


def resolve_backend(name: str = "auto", among: Mapping[str, Backend] | None = None) -> Backend:
    """The backend of that name, or for auto the first that loads: registered ones, the latest first, then nma and random."""
    known = _BACKENDS if among is None else among
    if name == "auto":
        own = [b for n, b in reversed(known.items()) if n not in ("nma", "random")]
        found = next((b for b in [*own, *(known[n] for n in ("nma", "random") if n in known)] if _usable(b)), None)
        if found is None:
            raise ImportError("no backend can be loaded")
        return found
    if name not in known:
        raise ValueError(f"unknown backend {name!r}; one of {sorted(known)}, or register it; frames of other tools can be read as a table")
    if not _usable(known[name]):
        raise ImportError(f"backend {name!r} cannot be loaded")
    return known[name]


def _random_frames(s: Structure, n: int, options: Mapping) -> list[np.ndarray]:
    seed = options.get("seed", 0)
    sigmas = noise_levels(n, options.get("levels"))
    return random_frames(s.xyz, s.xyz[s.is_anchor], sigmas, [seed + 1000 * (i + 1) for i in range(n)])


def _spring_rows(n: int, springs):
    """rows(a, b): the factors of anchors a to b with all anchors, 1 where none is given; of one given several times the last."""
    i, j, factor = (springs[c].to_numpy() for c in ("i", "j", "gamma"))
    i, j, factor = np.stack((i, j), axis=1).ravel(), np.stack((j, i), axis=1).ravel(), np.repeat(factor, 2)
    order = np.argsort(i, kind="stable")
    i, j, factor = i[order], j[order], factor[order]

    def rows(a: int, b: int) -> np.ndarray:
        out, at = np.ones((b - a, n)), slice(*np.searchsorted(i, (a, b)))
        out[i[at] - a, j[at]] = factor[at]
        return out

    return rows


def _nma_frames(s: Structure, n: int, options: Mapping) -> list[np.ndarray]:
    anchors = s.xyz[s.is_anchor]
    if len(anchors) < MIN_ANCHORS:
        return _random_frames(s, n, options)
    gamma = 1.0 if s.springs is None else _spring_rows(len(anchors), s.springs)
    values, modes = elastic_modes(anchors, options.get("n_modes", 10), gamma=gamma)
    return nma_frames(s.xyz, anchors, values, modes, n, options.get("max_rmsd", 2.0), options.get("seed", 0))


register_backend("random", _random_frames)
register_backend("nma", _nma_frames)


def _all_frames(made: Backend, s: Structure, n: int, options: Mapping, include_input: bool) -> list[tuple[int, np.ndarray]]:
    frames = [(0, s.xyz)] if include_input else []
    for i, places in enumerate(made.make(s, n, options) if n else []):
        places = np.asarray(places, dtype=np.float64)
        if places.shape != s.xyz.shape:
            raise ValueError(f"backend {made.name!r}: frame {i + 1} of {s.structure_id!r} has shape {places.shape}, not {s.xyz.shape}")
        frames.append((i + 1, places))
    return frames


def _spread(rows: DataFrame, key: str = "structure_id") -> DataFrame:
    """Rows by structure in a fixed number of partitions: structures are few bytes but long work, so small partitions must not be merged."""
    return rows.repartition(_partitions(rows), key)


def _apart(rows: DataFrame) -> DataFrame:
    """_spread by ranges: a few large structures each get a partition of their own, where hashes would put some together."""
    return rows.repartitionByRange(_partitions(rows), "structure_id")


def _partitions(rows: DataFrame) -> int:
    spark = rows.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def generate(atoms: DataFrame, n: int, backend: str = "nma", max_rmsd: float = 2.0, n_modes: int = 10, seed: int = 0, levels: Sequence[float] | None = None, include_input: bool = True, springs: DataFrame | None = None, options: Mapping | None = None) -> DataFrame:
    """structure_id, frame_idx, serial, x, y, z: frame 0 is the input, then n generated frames, in the input's atom order.

    atoms: structure_id, serial, x, y, z, is_anchor. backend: nma (elastic
    network; with fewer than six anchors random), random, one registered by
    register_backend, or auto. springs: optional structure_id, i, j, gamma
    factors between anchors. options: further values for the backend. Seeds are
    per frame, so frames do not depend on how many others are made or where.
    """
    made = resolve_backend(backend)
    given_options = {"max_rmsd": max_rmsd, "n_modes": n_modes, "seed": seed, "levels": levels} | dict(options or {})

    def run(key, pdf, given=None):
        import pandas as pd

        pdf = pdf.sort_values("serial", kind="stable")
        s = Structure(key[0], pdf[["x", "y", "z"]].to_numpy(dtype=np.float64), pdf["is_anchor"].to_numpy(dtype=bool), given)
        frames = _all_frames(made, s, n, given_options, include_input)
        parts = [pd.DataFrame({"structure_id": key[0], "frame_idx": k, "serial": pdf["serial"].to_numpy(), "x": f[:, 0], "y": f[:, 1], "z": f[:, 2]}) for k, f in frames]
        none = pd.DataFrame({c: [] for c in ("structure_id", "frame_idx", "serial", "x", "y", "z")})
        return (pd.concat(parts) if parts else none).astype({"x": "float32", "y": "float32", "z": "float32"})

    kinds = dict(atoms.dtypes)
    schema = f"structure_id {kinds['structure_id']}, frame_idx int, serial {kinds['serial']}, x float, y float, z float"
    flat = atoms.select("structure_id", "serial", "x", "y", "z", "is_anchor")

    def alone(key, pdf):
        return run(key, pdf)

    if springs is None:
        return _apart(flat).groupBy("structure_id").applyInPandas(alone, schema)

    def both(key, left, right):
        return run(key, left, right)

    return _spread(flat).groupBy("structure_id").cogroup(_spread(springs).groupBy("structure_id")).applyInPandas(both, schema)


def register_sql(spark: SparkSession, name: str = "make_frames") -> None:
    """A table function of SQL: name(TABLE(atoms) PARTITION BY (structure_id), n, backend), of the backends known now.

    Gives structure_id (as text), frame_idx, serial, x, y, z. Backends are
    resolved where it runs, so auto is what loads on the executors.
    """
    from pyspark.sql.functions import udtf

    known = dict(_BACKENDS)

    @udtf(returnType="structure_id string, frame_idx int, serial bigint, x float, y float, z float")
    class Frames:
        def __init__(self):
            self.rows, self.n, self.backend = [], 0, "auto"

        def eval(self, atom, n: int, backend: str):
            self.rows.append((atom["serial"], atom["x"], atom["y"], atom["z"], bool(atom["is_anchor"]), atom["structure_id"]))
            self.n, self.backend = n, backend

        def terminate(self):
            if not self.rows:
                return
            rows = sorted(self.rows, key=lambda r: r[0])
            s = Structure(rows[0][5], np.array([r[1:4] for r in rows], dtype=np.float64), np.array([r[4] for r in rows]))
            for k, places in _all_frames(resolve_backend(self.backend, known), s, self.n, {}, True):
                for r, (x, y, z) in zip(rows, places.tolist(), strict=True):
                    yield str(r[5]), k, r[0], x, y, z

    spark.udtf.register(name, Frames)


def fit_frames(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of other tools (structure_id, frame_idx, position, x, y, z) in the input's atoms: structure_id, frame_idx, serial, x, y, z.

    An ordered positional join: the atoms in order of serial take the places of
    a frame's atoms in order of position. Atoms that a frame has beyond the
    input's are cut off, and those that it lacks lie at the origin.
    """
    kinds = dict(atoms.dtypes)
    order = Window.partitionBy("structure_id").orderBy("serial")
    slots = atoms.select("structure_id", "serial", (F.row_number().over(order) - 1).cast("long").alias("position"))
    listed = frames.select("structure_id", F.col("frame_idx").cast("int").alias("frame_idx")).distinct()
    nth = Window.partitionBy("structure_id", "frame_idx").orderBy("position")
    placed = frames.select("structure_id", F.col("frame_idx").cast("int").alias("frame_idx"), "x", "y", "z", (F.row_number().over(nth) - 1).cast("long").alias("position"))
    full = slots.join(listed, "structure_id").join(placed, ["structure_id", "frame_idx", "position"], "left")
    return full.select("structure_id", "frame_idx", F.col("serial").cast(kinds["serial"]).alias("serial"), *(F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")).alias(c) for c in "xyz"))


def _with_anchors(atoms: DataFrame) -> DataFrame:
    """The anchors of structures that have enough of them for a network."""
    n = F.count("*").over(Window.partitionBy("structure_id"))
    return atoms.where("is_anchor").withColumn("_n", n).where(F.col("_n") >= MIN_ANCHORS).drop("_n")


def normal_modes(atoms: DataFrame, n_modes: int = 10, cutoff: float = 8.0) -> DataFrame:
    """structure_id, mode, eigenvalue and vector (3N numbers) of each structure's anchors; structures with fewer than six have none."""

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("serial", kind="stable")
        values, modes = elastic_modes(pdf[["x", "y", "z"]].to_numpy(dtype=np.float64), n_modes, cutoff)
        return pd.DataFrame({"structure_id": key[0], "mode": range(len(values)), "eigenvalue": values, "vector": [m.ravel().tolist() for m in modes]})

    kind = dict(atoms.dtypes)["structure_id"]
    return _apart(_with_anchors(atoms).select("structure_id", "serial", "x", "y", "z")).groupBy("structure_id").applyInPandas(run, f"structure_id {kind}, mode int, eigenvalue double, vector array<double>")


def contact_normal_modes(atoms: DataFrame, n_modes: int = 10, cutoff: float = 8.0) -> DataFrame:
    """normal_modes for structures whose dense matrix is too large: contacts by a range join, the lowest modes from them.

    A task holds one structure's anchors, contacts and the wanted vectors. Large structures most of whose anchors are near
    each other have about as many contacts as their matrix has numbers: theirs are made in the task, a tile of anchors
    by anchors at a time, and neither written nor held.
    """
    from voxelith.operators.kernels import contact_modes
    from voxelith.operators.spatial import range_join

    kind = dict(atoms.dtypes)["structure_id"]
    order = Window.partitionBy("structure_id").orderBy("serial")
    all_anchors = _with_anchors(atoms)
    crowded = staged(_crowded(all_anchors, cutoff), "crowded")
    dense = normal_modes(all_anchors.join(crowded, "structure_id", "left_semi"), n_modes, cutoff)
    anchors = all_anchors.join(crowded, "structure_id", "left_anti").select("structure_id", (F.row_number().over(order) - 1).alias("i"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    other = anchors.select("structure_id", F.col("i").alias("j"), *(F.col(c).alias(f"o{c}") for c in "xyz"))
    near = range_join(anchors, other, cutoff, right_xyz=("ox", "oy", "oz"), on=["structure_id"]).where("dist2 > 0")
    contacts = near.select("structure_id", "i", "j", *((F.col(f"o{c}") - F.col(c)).alias(f"d{c}") for c in "xyz"), (1 / F.col("dist2")).alias("factor"))

    def run(key, points, pairs):
        import pandas as pd

        pairs = pairs.sort_values(["i", "j"])
        values, modes = contact_modes(len(points), pairs["i"].to_numpy(), pairs["j"].to_numpy(), pairs[["dx", "dy", "dz"]].to_numpy(), pairs["factor"].to_numpy(), n_modes)
        return pd.DataFrame({"structure_id": key[0], "mode": range(len(values)), "eigenvalue": values, "vector": [m.ravel().tolist() for m in modes]})

    points = anchors.select(F.col("structure_id").alias("sid"), F.col("i").alias("place"))
    listed = _spread(points, "sid").groupBy("sid").cogroup(_spread(contacts).groupBy("structure_id")).applyInPandas(run, f"structure_id {kind}, mode int, eigenvalue double, vector array<double>")
    return listed.unionByName(dense)


def _crowded(anchors: DataFrame, cutoff: float) -> DataFrame:
    """structure_id of large structures whose contacts are no fewer than a share of their matrix, judged by how many anchors neighbouring cells hold."""
    from voxelith.operators.kernels import DENSE, MATRIX_SHARE
    from voxelith.operators.spatial import cell_pairs

    return cell_pairs(anchors, cutoff, on=["structure_id"]).where((F.col("n") > DENSE) & (9 * F.col("n") * F.col("n") <= MATRIX_SHARE // 3 * F.col("pairs"))).select("structure_id")


def greedy_cluster(pockets: DataFrame, keys: Sequence[str] = ("structure_id",), order: Sequence[str] = ("frame_idx", "source_ord", "pocket_idx"), eps: float = 5.0) -> DataFrame:
    """Adds cluster_id: pockets in order join the nearest running-mean centre within eps, else open a new cluster.

    The rule is sequential within a structure, whose pockets (a few a frame) one task holds.
    """
    from voxelith.operators.kernels import greedy_clusters

    def run(pdf):
        pdf = pdf.sort_values(list(order), kind="stable")
        return pdf.assign(cluster_id=greedy_clusters(pdf[["cx", "cy", "cz"]].to_numpy(dtype=np.float64), eps))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pockets.schema) + ", cluster_id int"
    return pockets.groupBy(*keys).applyInPandas(run, schema)


#: Letters for the chains of added copies.
_CHAINS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def assemble(atoms: DataFrame, transforms: DataFrame) -> DataFrame:
    """Biological assembly: the input chains, and a copy of each under every transform that is not the identity.

    Copies get unused letters in order of (operator, chain), then chain plus
    "+"; serial and residue indexes go on after the input's, and residue labels
    name the new chain. A structure without such transforms stays as it is.
    """
    from voxelith.operators.spatial import apply_transforms, identity_transform

    ops = transforms.where(~identity_transform())
    chains = atoms.groupBy("structure_id").agg(F.array_sort(F.collect_set("chain_id")).alias("_chains"), (F.max("serial") + 1).alias("_serials"), (F.max("res_idx") + 1).alias("_residues"))
    order = ops.groupBy("structure_id").agg(F.array_sort(F.collect_list("op_id")).alias("_ops"))
    free = F.array_except(F.array(*map(F.lit, _CHAINS)), F.col("_chains"))
    plan = chains.join(order, "structure_id").withColumn("_free", free)
    copies = apply_transforms(atoms, ops, ["structure_id"]).join(plan, "structure_id")
    nth = F.array_position("_ops", F.col("op_id")) - 1
    slot = (nth * F.size("_chains") + F.array_position("_chains", F.col("chain_id"))).cast("int")
    named = F.coalesce(F.try_element_at("_free", slot), F.concat("chain_id", F.lit("+")))
    kinds = dict(atoms.dtypes)
    moved = copies.withColumns({"_c": named, "_s": (F.col("serial") + F.col("_serials") * (nth + 1)), "_r": (F.col("res_idx") + F.col("_residues") * (nth + 1))})
    label = F.concat(F.substring_index("res_label", ":", 1), F.lit(":"), "_c") if "res_label" in atoms.columns else None
    moved = moved.select(*({"chain_id": F.col("_c"), "serial": F.col("_s"), "res_idx": F.col("_r"), "res_label": label}.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in atoms.columns))
    return atoms.unionByName(moved)
