"""Numpy kernels for steps that iterate: distance fields, components, greedy clusters, elastic networks."""

from __future__ import annotations

import numpy as np

PADDING, MASK_RADIUS, LINING, DENSITY_FULL, MAX_VOLUME = 5.0, 1.7, 5.0, 0.4, 1500.0
ALPHA_LOW, ALPHA_HIGH, BALL_RADIUS, DENSITY_REACH = 1.6, 6.0, 4.0, 4


def label_voxels(ijk: np.ndarray) -> np.ndarray:
    """Six-connected components of voxels, numbered from 1 in order of their first voxel in (i, j, k)."""
    n = len(ijk)
    if not n:
        return np.zeros(0, np.int32)
    lo = ijk.min(axis=0) - 1
    shape = ijk.max(axis=0) - lo + 2
    key = np.ravel_multi_index((ijk - lo).T, shape)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    a, b = [], []
    for step in (shape[1] * shape[2], shape[2], 1):
        at = np.searchsorted(sorted_key, sorted_key + step)
        ok = (at < n) & (sorted_key[np.minimum(at, n - 1)] == sorted_key + step)
        a.append(np.flatnonzero(ok))
        b.append(at[ok])
    same = np.flatnonzero(np.diff(sorted_key) == 0)  # repeated voxels
    a, b = np.concatenate([*a, same]), np.concatenate([*b, same + 1])
    root = np.arange(n)
    while True:  # smallest root over each edge, then jump
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    while not np.array_equal(root, root[root]):
        root = root[root]
    _, number = np.unique(root, return_inverse=True)
    out = np.empty(n, np.int32)
    out[order] = number + 1
    return out


def joined_labels(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels (rows of whole numbers) that edges join: all labels, and the smallest of each one's connected group."""
    nodes, at = np.unique(np.concatenate([one, two]), axis=0, return_inverse=True)
    at = at.ravel()
    a, b, root = at[: len(one)], at[len(one) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _shift(a: np.ndarray, axis: int, by: int, fill) -> np.ndarray:
    out = np.full_like(a, fill)
    src, dst = [slice(None)] * 3, [slice(None)] * 3
    if by >= 0:
        src[axis], dst[axis] = slice(0, a.shape[axis] - by), slice(by, None)
    else:
        src[axis], dst[axis] = slice(-by, None), slice(0, a.shape[axis] + by)
    out[tuple(dst)] = a[tuple(src)]
    return out


def truncated_d2(mask: np.ndarray, reach: int) -> np.ndarray:
    """Squared distance in voxels to the nearest True voxel where it is within reach on each axis; large elsewhere."""
    big = np.int32(1 << 20)
    d = np.where(mask, np.int32(0), big)
    for axis in range(3):
        best = d.copy()
        for by in range(1, reach + 1):
            if by >= mask.shape[axis]:
                break
            for sign in (by, -by):
                np.minimum(best, _shift(d, axis, sign, big) + np.int32(by * by), out=best)
        d = best
    return d


def box_mean(mask: np.ndarray, reach: int) -> np.ndarray:
    """Mean over the box of 2 * reach + 1 voxels a side, edges reflected."""
    a = mask.astype(np.float64)
    for axis in range(3):
        n = a.shape[axis]
        at = np.arange(-reach, n + reach) % (2 * n)
        at = np.where(at < n, at, 2 * n - 1 - at)
        s = np.cumsum(np.take(a, at, axis=axis), axis=axis)
        s = np.concatenate((np.zeros_like(np.take(s, [0], axis=axis)), s), axis=axis)
        w = 2 * reach + 1
        a = np.take(s, np.arange(w, n + w), axis=axis) - np.take(s, np.arange(n), axis=axis)
    return a / (2 * reach + 1) ** 3


class Grid:
    """One frame's voxels: lower corner, mask, truncated distance, density."""

    def __init__(self, xyz: np.ndarray, spacing: float):
        self.h, self.lo = spacing, xyz.min(axis=0) - PADDING
        self.shape = (np.ceil((xyz.max(axis=0) + PADDING - self.lo) / spacing) + 1).astype(int)
        at = np.clip(np.rint((xyz - self.lo) / spacing).astype(int), 0, self.shape - 1)
        occupied = np.zeros(self.shape, dtype=bool)
        occupied[tuple(at.T)] = True
        near = truncated_d2(occupied, int(MASK_RADIUS / spacing) + 1)
        self.mask = near * spacing * spacing <= MASK_RADIUS**2
        self.d2 = truncated_d2(self.mask, int(np.ceil((ALPHA_HIGH / spacing) + 2)))
        self.density = box_mean(self.mask, DENSITY_REACH)
        self.cells: dict[tuple[int, int, int], list[int]] = {}
        self.xyz = xyz
        for n, c in enumerate(map(tuple, np.floor(xyz / LINING).astype(int))):
            self.cells.setdefault(c, []).append(n)

    def atoms_near(self, points: np.ndarray) -> np.ndarray:
        """Atoms within the lining distance of any point."""
        found: list[np.ndarray] = []
        cell = np.floor(points / LINING).astype(int)
        for c in map(tuple, np.unique(cell, axis=0)):
            own = points[(cell == c).all(axis=1)]
            near = [n for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) for n in self.cells.get((c[0] + i, c[1] + j, c[2] + k), ())]
            if near:
                d2 = ((self.xyz[near][:, None, :] - own[None, :, :]) ** 2).sum(axis=2).min(axis=1)
                found.append(np.array(near)[d2 <= LINING**2])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, int)

    def describe(self, cavity: np.ndarray, whole: np.ndarray, residues) -> tuple:
        """centroid, volume, enclosure, hydrophobic share, aromatic count and lining labels of a cavity (n x 3 voxels)."""
        w = self.density[tuple(cavity.T)]
        centre = (cavity * w[:, None]).sum(axis=0) / w.sum() if w.sum() > 1e-6 else cavity.mean(axis=0)
        lining = residues(self.atoms_near(cavity * self.h + self.lo))
        enclosure = min(float(self.density[tuple(whole.T)].mean()) / DENSITY_FULL, 1.0)
        hydrophobic = sum(r[2] for r in lining) / max(len(lining), 1)
        x, y, z = (centre * self.h + self.lo).tolist()
        return (x, y, z, len(cavity) * self.h**3, enclosure, hydrophobic, int(sum(r[3] for r in lining)), [r[1] for r in lining])


def _residues(pdf):
    """Lining residues of atom numbers, in order of residue index: (index, label, hydrophobic, aromatic)."""
    index, label = pdf["res_idx"].to_numpy(), pdf["res_label"].tolist()
    hyd, aro = pdf["hydrophobic"].to_numpy(), pdf["aromatic"].to_numpy()

    def of(atoms: np.ndarray) -> list[tuple]:
        seen = {int(index[a]): (int(index[a]), label[a], bool(hyd[a]), bool(aro[a])) for a in atoms.tolist()}
        return [seen[k] for k in sorted(seen)]

    return of


def _ordered(pdf):
    """Atoms in one order, however they arrived."""
    return pdf.sort_values(["res_idx", "x", "y", "z"], kind="stable")


def find_pockets(pdf, spacing: float = 1.0, min_volume: float = 80.0) -> list[tuple]:
    """Pockets of one frame: alpha points, dilated, labelled, without the mask, in the volume band."""
    pdf = _ordered(pdf)
    xyz = pdf[["x", "y", "z"]].to_numpy(dtype=np.float64)
    if not len(xyz):
        return []
    grid = Grid(xyz, spacing)
    dist2, h2 = grid.d2, spacing * spacing
    top = dist2.copy()
    for axis in range(3):
        top = np.maximum(top, np.maximum(_shift(top, axis, 1, -1), _shift(top, axis, -1, -1)))
    alpha = (dist2 == top) & (dist2 * h2 >= ALPHA_LOW**2) & (dist2 * h2 <= ALPHA_HIGH**2)
    if not alpha.any():
        return []
    grown = alpha
    for _ in range(int(np.ceil(BALL_RADIUS / spacing))):
        grown = grown | np.logical_or.reduce([_shift(grown, axis, by, False) for axis in range(3) for by in (1, -1)])
    voxels = np.argwhere(grown)
    labels = label_voxels(voxels)
    order = np.argsort(labels, kind="stable")
    cuts = np.flatnonzero(np.diff(labels[order])) + 1
    residues, out = _residues(pdf), []
    for part in np.split(voxels[order], cuts):
        cavity = part[~grid.mask[tuple(part.T)]]
        if len(cavity) and min_volume <= len(cavity) * spacing**3 <= MAX_VOLUME:
            out.append((len(out), *grid.describe(cavity, part, residues)))
    return out


def characterize_at(pdf, centres, spacing: float = 1.0) -> list[tuple]:
    """The free voxels of the ball around each centre, described; none off the grid or without free voxels."""
    pdf = _ordered(pdf)
    grid, residues, out = Grid(pdf[["x", "y", "z"]].to_numpy(dtype=np.float64), spacing), _residues(pdf), []
    for r in centres.sort_values("proposal").itertuples():
        at = (np.array([r.px, r.py, r.pz]) - grid.lo) / spacing
        if (at < 0).any() or (at > grid.shape - 1).any():
            continue
        reach = int(np.ceil(BALL_RADIUS / spacing))
        low, high = np.maximum(np.floor(at).astype(int) - reach, 0), np.minimum(np.ceil(at).astype(int) + reach, grid.shape - 1)
        box = np.stack(np.meshgrid(*(np.arange(a, b + 1) for a, b in zip(low, high, strict=True)), indexing="ij"), axis=-1).reshape(-1, 3)
        whole = box[((box - at) ** 2).sum(axis=1) * spacing * spacing <= BALL_RADIUS**2]
        cavity = whole[~grid.mask[tuple(whole.T)]]
        if len(cavity):
            out.append((int(r.proposal), *grid.describe(cavity, whole, residues)))
    return out


def greedy_clusters(xyz: np.ndarray, eps: float) -> np.ndarray:
    """Assign points in order to the nearest running-mean centre within eps (the lowest number on ties), else to a new one."""
    centres, counts, out = np.zeros((len(xyz), 3)), np.zeros(len(xyz)), np.zeros(len(xyz), np.int32)
    used = 0
    for n, p in enumerate(xyz):
        d = np.sqrt(((centres[:used] - p) ** 2).sum(axis=1))
        k = int(d.argmin()) if used else -1
        if used == 0 or d[k] > eps:
            k, used = used, used + 1
        counts[k] += 1
        centres[k] += (p - centres[k]) / counts[k]
        out[n] = k
    return out


#: Up to so many points the matrix is taken apart whole; beyond, its lower half is factored in single precision.
DENSE = 1000
#: Up to so many points that factor is held, 130 MB; beyond, and where the network is dense, memory is in proportion to the points.
FACTORED = 2700
#: Numbers of the matrix for each contact, up to which a network counts as dense.
MATRIX_SHARE = 64
#: Points in a block of rows of the matrix, and on a side of a tile.
_ROWS, _TILE = 128, 96
#: Points with the weakest springs, whose part of the matrix is taken apart whole.
_WEAK = 400


def _springs(gamma):
    """of(a, b): the spring factors of points a to b with all points, or one number."""
    return gamma if callable(gamma) else lambda a, b: gamma if np.isscalar(gamma) else gamma[a:b]


def _rows_of_points(xyz: np.ndarray, cutoff: float, gamma):
    """rows(a, b, upto): the rows of points a to b of the elastic network's matrix, as far as point upto, made anew at each call."""
    factors = _springs(gamma)

    def rows(a: int, b: int, upto: int) -> np.ndarray:
        d = xyz[None, :, :] - xyz[a:b, None, :]
        r2 = (d**2).sum(axis=2)
        near = (r2 > 0) & (r2 <= cutoff**2)
        k = np.where(near, factors(a, b) / np.where(near, r2, 1.0), 0.0)
        own = np.einsum("pq,pqi,pqj->pij", k, d, d)
        out = np.empty((b - a, 3, upto, 3))
        for i in range(3):
            left = -k[:, :upto] * d[:, :upto, i]
            for j in range(3):
                np.multiply(left, d[:, :upto, j], out=out[:, i, :, j])
        inside = np.arange(a, min(b, upto))
        out[inside - a, :, inside] = own[: len(inside)]
        return out.reshape(3 * (b - a), 3 * upto)

    return rows


def _compact(xyz: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the points in which each run of `leaf` points lies close together: halves along the longest side, and again."""
    out, open_ = [], [np.arange(len(xyz))]
    while open_:
        at = open_.pop()
        if len(at) <= leaf:
            out.append(at)
            continue
        side = xyz[at, int(np.ptp(xyz[at], axis=0).argmax())]
        half = -(-len(at) // leaf) // 2 * leaf
        order = np.argsort(side, kind="stable")
        open_ += [at[order[half:]], at[order[:half]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _product_of_points(xyz: np.ndarray, cutoff: float, gamma):
    """product(x, kind) = Hx for the elastic network of the points, the points' own blocks of H, and a bound of its highest value.

    Springs are made anew at each product, a tile of points by points at a time, for both sides of the diagonal at once;
    tiles that lie apart have none. kind is the precision of the springs between points; which points have a spring,
    and the points' own blocks, are as in double precision whatever kind is.
    """
    n, factors, reach = len(xyz), _springs(gamma), cutoff**2
    axes = np.ascontiguousarray(xyz.T)
    bounds = [(a, min(a + _TILE, n)) for a in range(0, n, _TILE)]
    low, high = (np.stack([f(xyz[a:b], axis=0) for a, b in bounds]) for f in (np.min, np.max))

    def tiles(kind):
        """Where a tile of the upper half lies, the moves along each axis, and these by the springs."""
        for s, (a, b) in enumerate(bounds):
            apart = np.maximum(0, np.maximum(low[s:] - high[s], low[s] - high[s:]))
            given, middle = factors(a, b), (low[s] + high[s]) / 2
            single = (axes - middle[:, None]).astype(np.float32) if kind is np.float32 else None
            for t in (np.flatnonzero((apart**2).sum(axis=1) <= reach) + s).tolist():
                p, q = bounds[t]
                wide = kind is np.float64 or np.abs(np.stack((low[t], high[t], low[s], high[s])) - middle).max() > 8 * cutoff
                d = [x[None, p:q] - x[a:b, None] for x in (axes if wide else single)]
                r2 = d[0] * d[0]
                r2 += d[1] * d[1]
                r2 += d[2] * d[2]
                if wide:
                    near = r2 <= reach
                    if r2.min() == 0:
                        near &= r2 > 0
                        r2[r2 == 0] = 1
                else:
                    near, may = r2 <= np.float32(0.9999 * reach), r2 <= np.float32(1.0001 * reach)
                    close = r2.min() < 1e-6 * reach
                    if close or np.count_nonzero(near) < np.count_nonzero(may):  # too near to call
                        i, j = np.nonzero((near != may) | (r2 < 1e-6 * reach) if close else near != may)
                        exact = [x[p + j] - x[a + i] for x in axes]
                        exact2 = exact[0] * exact[0] + exact[1] * exact[1] + exact[2] * exact[2]
                        near[i, j] = (exact2 > 0) & (exact2 <= reach)
                        for x, y in zip((r2, *d), (np.where(near[i, j], exact2, 1), *exact), strict=True):
                            x[i, j] = y
                k = (given if np.isscalar(given) else given[:, p:q]) / r2
                k *= near
                yield s, t, d, [k * x for x in d]

    own = np.zeros((n, 3, 3))
    for s, t, d, along in tiles(np.float64):
        (a, b), (p, q) = bounds[s], bounds[t]
        for i in range(3):
            for j in range(i, 3):
                own[a:b, i, j] += np.einsum("pq,pq->p", along[i], d[j])
                if s < t:
                    own[p:q, i, j] += np.einsum("pq,pq->q", along[i], d[j])
    for i, j in ((1, 0), (2, 0), (2, 1)):
        own[:, i, j] = own[:, j, i]
    top = 2 * float(np.trace(own, axis1=1, axis2=2).max())

    def product(x: np.ndarray, kind=np.float64) -> np.ndarray:
        x = x.reshape(n, 3, -1)
        y = own @ x
        parts = [np.ascontiguousarray(x[a:b].transpose(1, 0, 2), dtype=kind).reshape(3 * (b - a), -1) for a, b in bounds]
        sums = [np.zeros(part.shape) for part in parts]
        held = np.empty(9 * _TILE * _TILE, kind)
        for s, t, d, along in tiles(kind):
            (a, b), (p, q) = bounds[s], bounds[t]
            w = held[: 9 * (b - a) * (q - p)].reshape(3, b - a, 3, q - p)
            for i in range(3):
                for j in range(i, 3):
                    np.multiply(along[i], d[j], out=w[i, :, j], casting="same_kind")
                    if i < j:
                        w[j, :, i] = w[i, :, j]
            w = w.reshape(3 * (b - a), 3 * (q - p))
            sums[s] += w @ parts[t]
            if s < t:
                sums[t] += w.T @ parts[s]
        for (a, b), z in zip(bounds, sums, strict=True):
            y[a:b] -= z.reshape(3, b - a, -1).transpose(1, 0, 2)
        return y.reshape(3 * n, -1)

    return product, own, top


def _rows_of_contacts(n: int, i: np.ndarray, j: np.ndarray, move: np.ndarray, factor: np.ndarray):
    """The same from contacts, both ways round."""
    order = np.argsort(i, kind="stable")
    i, j, move, factor = i[order], j[order], move[order], factor[order]

    def rows(a: int, b: int, upto: int) -> np.ndarray:
        at = slice(*np.searchsorted(i, (a, b)))
        p, q = i[at] - a, j[at]
        pair = factor[at, None, None] * move[at, :, None] * move[at, None, :]
        out = np.zeros((b - a, upto, 3, 3))
        kept = q < upto
        out[p[kept], q[kept]] = -pair[kept]
        for x in range(3):
            for y in range(3):
                own = np.bincount(p, weights=pair[:, x, y], minlength=b - a)
                inside = np.arange(a, min(b, upto))
                out[inside - a, inside, x, y] += own[: len(inside)]
        return np.ascontiguousarray(out.transpose(0, 2, 1, 3)).reshape(3 * (b - a), 3 * upto)

    return rows


def _product(n: int, rows, x: np.ndarray) -> np.ndarray:
    """The matrix times x, a block of rows at a time."""
    return np.concatenate([rows(a, min(a + _ROWS, n), n) @ x for a in range(0, n, _ROWS)])


def _solver(n: int, rows, shift: float):
    """x -> an x near to the solution of (H + shift) y = x: a Cholesky factor by blocks of rows in single precision, 18 n^2 bytes."""
    lower, inverse = [], []
    bounds = [(3 * a, 3 * min(a + _ROWS, n)) for a in range(0, n, _ROWS)]
    for a, b in bounds:
        row = rows(a // 3, b // 3, b // 3).astype(np.float32)
        row[np.arange(b - a), np.arange(a, b)] += np.float32(shift)
        for (p, q), own, inv in zip(bounds, lower, inverse, strict=False):
            row[:, p:q] -= row[:, :p] @ own.T
            row[:, p:q] = row[:, p:q] @ inv.T
        corner = np.linalg.cholesky((row[:, a:] - row[:, :a] @ row[:, :a].T).astype(np.float64))
        lower.append(row[:, :a].copy())
        inverse.append(np.linalg.inv(corner).astype(np.float32))

    def solve(x: np.ndarray) -> np.ndarray:
        y = (x / np.maximum(np.abs(x).max(axis=0), 1e-300)).astype(np.float32)
        for (a, b), own, inv in zip(bounds, lower, inverse, strict=True):
            y[a:b] = inv @ (y[a:b] - own @ y[:a])
        for (a, b), own, inv in zip(bounds[::-1], lower[::-1], inverse[::-1], strict=True):
            y[a:b] = inv.T @ y[a:b]
            y[:a] -= own.T @ y[a:b]
        return y.astype(np.float64)

    return solve


def _lowest(n: int, rows, top: float, n_modes: int, tolerance: float = 1e-11, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """The lowest 6 + 4 n_modes values and vectors of the matrix: whole for few points, else by Davidson's method.

    There the vectors are corrected by the factor in single precision, and
    residuals are of the matrix in double precision, until they are at most
    tolerance x top, a bound of the highest value.
    """
    wanted = min(6 + 4 * n_modes, 3 * n - 1)
    if n <= DENSE:
        values, vectors = np.linalg.eigh(rows(0, n, n))
        return values[:wanted], vectors[:, :wanted]
    shift = 1e-5 * top
    while True:
        try:
            solve = _solver(n, rows, shift)
            break
        except np.linalg.LinAlgError:
            shift *= 10
    width = wanted + max(8, wanted // 2)
    x = np.linalg.qr(np.random.default_rng(0).standard_normal((3 * n, width)))[0]
    for _ in range(8):
        x = np.linalg.qr(solve(x))[0]
    v, hv = x, _product(n, rows, x)
    for _ in range(rounds):
        values, turn = np.linalg.eigh((v.T @ hv + hv.T @ v) / 2)
        values, turn = values[:width], turn[:, :width]
        x, hx = v @ turn, hv @ turn
        rest = hx - x * values
        far = np.flatnonzero(np.abs(rest).max(axis=0)[:wanted] > tolerance * top)
        if not len(far):
            break
        if v.shape[1] > 5 * width:
            v, hv = x, hx
        more = solve(rest[:, far])
        for _ in range(2):
            more = np.linalg.qr(more - v @ (v.T @ more))[0]
        v, hv = np.concatenate((v, more), axis=1), np.concatenate((hv, _product(n, rows, more)), axis=1)
    return values[:wanted], x[:, :wanted]


def _needed(values: np.ndarray, off: np.ndarray, n_modes: int) -> int:
    """How many of the values, in rising order and each within `off` of a true one, _picked depends on: all, if it is not sure which it takes."""
    limit = 1e-3 * np.abs(values).max()
    keep = np.flatnonzero(values > limit)[:n_modes]
    unsure = np.abs(values - limit) <= off + 1e-3 * off[-1]
    return len(values) if len(keep) < n_modes or unsure.any() else int(keep[-1]) + 1


def _lowest_by_product(xyz: np.ndarray, cutoff: float, gamma, n_modes: int, tolerance: float = 1e-11, rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """_lowest from products alone, with memory in proportion to the points.

    Davidson's method. It begins with smooth fields, which are what springs resist least, and with the lowest vectors of the
    points with the weakest springs, and corrects by these points' part of the matrix, taken apart whole, and by the other
    points' own blocks. The values that _picked depends on are brought to the tolerance, the others to what shows that it does
    not depend on them. Products are in single precision until the vectors are near; then theirs are taken in double precision,
    as what is added from there on is small enough for single precision, and once more in the end, to be sure.
    """
    n = len(xyz)
    product, own, top = _product_of_points(xyz, cutoff, gamma)
    wanted = min(6 + 4 * n_modes, 3 * n - 1)
    width = min(wanted + 8, 3 * n)
    alone, turns = np.linalg.eigh(own)
    weak = np.sort(np.argsort(alone[:, 0], kind="stable")[:_WEAK])
    at = (3 * weak[:, None] + np.arange(3)).ravel()
    theirs, their_turns = np.linalg.eigh(_part_of_points(xyz, weak, own, cutoff, gamma))
    v = np.zeros((3 * n, min(width, len(at))))
    v[at] = their_turns[:, : v.shape[1]]
    fields, size, _ = np.linalg.svd(_smooth(xyz), full_matrices=False)
    v = _added(fields[:, size > 1e-8 * size[0]][:, : 3 * n - v.shape[1]], v)
    hv, exact, sure = product(v, np.float32), 0, False
    for _ in range(rounds):
        inner = v.T @ hv
        inner = (inner + inner.T) / 2
        if exact:  # of two vectors, the product that is exact
            inner[:exact] = hv[:, :exact].T @ v
            inner[:, :exact] = inner[:exact].T
        values, turn = np.linalg.eigh(inner)
        if v.shape[1] > 5 * width:
            values, turn = values[:width], turn[:, :width]
        v, hv = v @ turn, hv @ turn
        rest = hv[:, :wanted] - v[:, :wanted] * values[:wanted]
        size = np.abs(rest).max(axis=0)
        needed = _needed(values[:wanted], np.linalg.norm(rest, axis=0) + 1e-9 * top, n_modes)
        limit = np.full(len(size), 1e-6 * top)
        limit[:needed] = (tolerance if exact else 1e-7) * top
        far = np.flatnonzero(size > limit)
        if not len(far):
            if sure and needed <= exact:
                return values[:wanted], v[:, :wanted]
            sure, exact = exact > 0, needed
            hv[:, :exact] = product(v[:, :exact])
            continue
        sure = False
        least = max(1e-3 * abs(values[min(width, len(values)) - 1]), 1e-9 * top)

        def over(z, gap, least=least):
            return z / np.where(np.abs(gap) < least, np.where(gap < 0, -least, least), gap)

        left = rest[:, far]
        more = np.einsum("nij,njc->nic", turns, over(np.einsum("nij,nic->njc", turns, left.reshape(n, 3, -1)), alone[:, :, None] - values[far])).reshape(3 * n, -1)
        more[at] = their_turns @ over(their_turns.T @ left[at], theirs[:, None] - values[far])
        before = v.shape[1]
        v = _added(v, more)
        hv = np.concatenate((hv, product(v[:, before:], np.float32)), axis=1)
    raise ArithmeticError(f"modes of {n} points do not stand still after {rounds} rounds")


def _smooth(xyz: np.ndarray) -> np.ndarray:
    """Moves of all points that are polynomials of their places, of the second degree at most; shifts and turns of the whole are among them."""
    at = xyz - xyz.mean(axis=0)
    at = at / max(np.abs(at).max(), 1e-300)
    each = np.stack([np.ones(len(at)), *at.T, *(at[:, i] * at[:, j] for i in range(3) for j in range(i, 3))], axis=1)
    each = each / np.maximum(np.linalg.norm(each, axis=0), 1e-300)
    return np.einsum("nk,ij->nikj", each, np.eye(3)).reshape(3 * len(at), -1)


def _added(v: np.ndarray, more: np.ndarray) -> np.ndarray:
    """v and the part of more at right angles to it."""
    for _ in range(2):
        more = np.linalg.qr(more - v @ (v.T @ more))[0]
    return np.concatenate((v, more), axis=1)


def _part_of_points(xyz: np.ndarray, at: np.ndarray, own: np.ndarray, cutoff: float, gamma) -> np.ndarray:
    """The part of the elastic network's matrix that some points have, with their own blocks."""
    factors = _springs(gamma)
    d = xyz[at][None] - xyz[at][:, None]
    r2 = (d**2).sum(axis=2)
    near = (r2 > 0) & (r2 <= cutoff**2)
    given = factors(0, 0)
    k = np.where(near, (given if np.isscalar(given) else np.concatenate([factors(a, a + 1)[:, at] for a in at.tolist()])) / np.where(near, r2, 1.0), 0.0)
    h = -k[:, :, None, None] * d[:, :, :, None] * d[:, :, None, :]
    h[np.arange(len(at)), np.arange(len(at))] = own[at]
    return h.transpose(0, 2, 1, 3).reshape(3 * len(at), 3 * len(at))


def _picked(n: int, values: np.ndarray, vectors: np.ndarray, n_modes: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n_modes that are not zero, the component of largest size positive."""
    keep = np.flatnonzero(values > 1e-3 * np.abs(values).max())[:n_modes]
    if not len(keep):
        keep = np.sort(np.argsort(-np.abs(values))[:n_modes])
    picked = vectors[:, keep].T
    picked = picked * np.sign(picked[np.arange(len(keep)), np.abs(picked).argmax(axis=1)])[:, None]
    return values[keep], picked.reshape(len(keep), n, 3)


def elastic_modes(xyz: np.ndarray, n_modes: int = 10, cutoff: float = 8.0, gamma=1.0) -> tuple[np.ndarray, np.ndarray]:
    """Lowest non-zero modes of an anisotropic elastic network: eigenvalues, and vectors as (mode, point, axis).

    gamma may be a matrix of spring factors, or a function of a and b that gives
    its rows a to b. Signs are fixed: the component of largest size of each
    vector is positive.
    """
    n, top, contacts, factors = len(xyz), 0.0, 0, _springs(gamma)
    if DENSE < n <= FACTORED:  # twice the largest sum of springs at a point
        for a in range(0, n, _ROWS):
            r2 = ((xyz[None, :, :] - xyz[a : a + _ROWS, None, :]) ** 2).sum(axis=2)
            near = (r2 > 0) & (r2 <= cutoff**2)
            contacts += np.count_nonzero(near)
            top = max(top, 2 * float((near * factors(a, min(a + _ROWS, n))).sum(axis=1).max()))
    if n > FACTORED or n > DENSE and 9 * n * n <= MATRIX_SHARE * contacts:
        one = not callable(gamma) and np.isscalar(gamma)
        order = _compact(xyz, _TILE) if one else np.arange(n)  # factors of springs come in the order of the points
        values, vectors = _lowest_by_product(xyz[order], cutoff, gamma, n_modes)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        return _picked(n, values, vectors.reshape(n, 3, -1)[back].reshape(3 * n, -1), n_modes)
    return _picked(n, *_lowest(n, _rows_of_points(xyz, cutoff, gamma), top, n_modes), n_modes)


def spring_forces(xyz: np.ndarray, moves: np.ndarray, other: np.ndarray, other_moves: np.ndarray, cutoff: float = 8.0) -> np.ndarray:
    """What the springs between points and others do to the points when both are moved: moves, and the result, have an axis of points, one of modes, one of space."""
    out = np.zeros(moves.shape)
    for a in range(0, len(xyz), _ROWS):
        at = slice(a, a + _ROWS)
        for p in range(0, len(other), 4 * _ROWS):
            to = slice(p, p + 4 * _ROWS)
            d = [other[None, to, k] - xyz[at, k, None] for k in range(3)]
            r2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
            near = (r2 > 0) & (r2 <= cutoff**2)
            r2[r2 == 0] = 1
            k = near / r2
            for i in range(3):
                along = k * d[i]
                for j in range(i, 3):
                    w = along * d[j]
                    total = w.sum(axis=1)[:, None]
                    for x, y in {(i, j), (j, i)}:
                        out[at, :, x] += total * moves[at, :, y] - w @ other_moves[to, :, y]
    return out


def contact_product(n: int, i: np.ndarray, j: np.ndarray, move: np.ndarray, factor: np.ndarray):
    """x -> Hx for the elastic network of the contacts i, j (both ways round), laid out by neighbours: memory in proportion to contacts.

    move: from i to j. x has a row a point and axis, and any number of columns.
    """
    order = np.argsort(i, kind="stable")
    i, j, move, factor = i[order], j[order], move[order], factor[order]
    degree = np.bincount(i, minlength=n)
    first = np.cumsum(degree) - degree
    layers = []  # the k-th neighbour of every point that has one
    for k in range(int(degree.max(initial=0))):
        who = np.flatnonzero(degree > k)
        at = first[who] + k
        layers.append((who, j[at], move[at], factor[at]))

    def product(x: np.ndarray) -> np.ndarray:
        x = x.reshape(n, 3, -1)
        y = np.zeros_like(x)
        for who, other, d, w in layers:
            along = w[:, None] * np.einsum("pa,pab->pb", d, x[who] - x[other])
            y[who] += d[:, :, None] * along[:, None, :]
        return y.reshape(3 * n, -1)

    return product, 2 * float(np.bincount(i, weights=factor * (move**2).sum(axis=1), minlength=n).max(initial=0.0))


def contact_modes(n: int, i: np.ndarray, j: np.ndarray, move: np.ndarray, factor: np.ndarray, n_modes: int = 10, degree: int = 24, rounds: int = 300, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """elastic_modes for large structures: the lowest part of the spectrum by subspace iteration with a Chebyshev filter.

    Neither the matrix nor its whole spectrum is formed: products over contacts
    damp what lies above the wanted values, until these stand still. Where the
    contacts take about as much memory as the matrix (few points, or most of
    them near each other), it is taken apart as in elastic_modes.
    """
    if n <= DENSE or 9 * n * n <= MATRIX_SHARE * len(i):
        top = 2 * float(np.bincount(i, weights=factor * (move**2).sum(axis=1), minlength=n).max(initial=0.0))
        return _picked(n, *_lowest(n, _rows_of_contacts(n, i, j, move, factor), top, n_modes), n_modes)
    product, top = contact_product(n, i, j, move, factor)
    wanted = min(6 + 4 * n_modes, 3 * n - 1)
    width = min(wanted + max(8, wanted // 2), 3 * n)
    x, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((3 * n, width)))
    values = np.zeros(width)
    for _ in range(rounds):
        hx = product(x)
        values, turn = np.linalg.eigh(x.T @ hx)
        x, hx = x @ turn, hx @ turn
        if top == 0 or width == 3 * n or np.abs(hx - x * values)[:, :wanted].max() <= tolerance * top:
            break
        low = max(values[-1], 1e-6 * top)
        middle, half = (top + low) / 2, (top - low) / 2
        before, now = x, (hx - middle * x) / half
        for _ in range(degree - 1):
            before, now = now, 2 * (product(now) - middle * now) / half - before
            scale = np.abs(now).max()
            before, now = before / scale, now / scale
        x, _ = np.linalg.qr(now)
    return _picked(n, values[:wanted], x[:, :wanted], n_modes)


def propagate(points: np.ndarray, anchors: np.ndarray, moves: np.ndarray, sigma: float = 5.0, chunk: int = 2048) -> np.ndarray:
    """Moves of anchors carried to points by Gaussian weights, some points at a time: fewer where there are many anchors.

    moves may have three columns for each of several frames, which share the weights.
    """
    out = np.empty((len(points), moves.shape[1]))
    chunk = max(1, min(chunk, (1 << 18) // max(1, len(anchors))))
    middle = anchors.mean(axis=0)
    near, scale = np.ascontiguousarray((anchors - middle).T), 2 * sigma * sigma
    for a in range(0, len(points), chunk):
        at = points[a : a + chunk] - middle
        w = np.zeros((len(at), len(anchors)))
        for k in range(3):
            d = at[:, k, None] - near[k]
            d *= d
            w -= d
        w /= scale
        np.exp(w, out=w)
        out[a : a + chunk] = w @ moves / (w.sum(axis=1, keepdims=True) + 1e-8)
    return out


def nma_frames(points: np.ndarray, anchors: np.ndarray, values: np.ndarray, modes: np.ndarray, n: int, max_rmsd: float = 2.0, seed: int = 0) -> list[np.ndarray]:
    """n frames: random mode amplitudes, those of frame i scaled so that the anchors' RMSD is (i + 1) / n of max_rmsd."""
    moves = []
    for i in range(n):
        rng = np.random.default_rng(seed + i)
        c = rng.normal(0.0, 1.0 / np.sqrt(np.maximum(np.abs(values), 1e-12)))
        move = np.tensordot(c, modes, axes=1)
        rmsd = np.sqrt((move**2).sum(axis=1).mean())
        moves.append(move * ((i + 1) / n * max_rmsd / rmsd) if rmsd > 0 else move)
    if not n:
        return []
    carried = propagate(points, anchors, np.concatenate(moves, axis=1))
    return [points + carried[:, 3 * i : 3 * i + 3] for i in range(n)]


def random_frames(points: np.ndarray, anchors: np.ndarray, sigmas: list[float], seeds: list[int]) -> list[np.ndarray]:
    """Frames by anchor noise smoothed over the points, or by noise for each point where there are no anchors."""
    noise = [np.random.default_rng(seed).normal(0.0, sigma, (anchors if len(anchors) else points).shape) for sigma, seed in zip(sigmas, seeds, strict=True)]
    if not len(anchors) or not noise:
        return [points + x for x in noise]
    carried = propagate(points, anchors, np.concatenate(noise, axis=1))
    return [points + carried[:, 3 * i : 3 * i + 3] for i in range(len(noise))]
