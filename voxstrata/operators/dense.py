"""NumPy kernels on one dense volume, for fixpoints that rows can't express well.

Arrays are float32 or int32 of shape (depth, height, width).
"""

from __future__ import annotations

from math import isqrt

import numpy as np

from ..functions.weights import direction_alpha, directions, line_weights
from ..model import BACKGROUND, LOW, MASK, ResourceLimit


def _shifted(a: np.ndarray, dz: int, dy: int, dx: int, fill) -> np.ndarray:
    """b[p] = a[p + d], ``fill`` outside."""
    out = np.full_like(a, fill)
    src = tuple(slice(max(d, 0), n + min(d, 0)) for d, n in zip((dz, dy, dx), a.shape, strict=True))
    dst = tuple(slice(max(-d, 0), n + min(-d, 0)) for d, n in zip((dz, dy, dx), a.shape, strict=True))
    if all(s.start < s.stop for s in src):
        out[dst] = a[src]
    return out


def ball(a: np.ndarray, radius: int, dilate: bool) -> np.ndarray:
    if radius == 0:
        return a
    pick, worst = (np.maximum, -np.inf) if dilate else (np.minimum, np.inf)
    moves: dict[int, list[tuple[int, int]]] = {}
    for dz in range(-radius, radius + 1):
        for dy in range(-radius, radius + 1):
            if (left := radius * radius - dz * dz - dy * dy) >= 0:
                moves.setdefault(isqrt(left), []).append((dz, dy))
    out, run = None, a
    # runs along x grow by one voxel on both sides; each width is moved to where the ball has it
    for half in range(radius + 1):
        if half:
            run = pick(run, pick(_shifted(a, 0, 0, half, worst), _shifted(a, 0, 0, -half, worst)))
        for dz, dy in moves.get(half, ()):
            moved = _shifted(run, dz, dy, 0, worst)
            out = moved if out is None else pick(out, moved)
    return out


def closing(a: np.ndarray, radius: int) -> np.ndarray:
    return ball(ball(a, radius, True), radius, False)


def chunked(a: np.ndarray, radius: int, opening: bool) -> np.ndarray:
    for dilate in (not opening, opening):
        left = radius
        while left > 0:
            a = ball(a, min(left, 4), dilate)
            left -= 4
    return a


def components(foreground: np.ndarray, connectivity: int = 6, group: np.ndarray | None = None) -> np.ndarray:
    """For each foreground voxel the least linear index of its component, else -1."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    index = np.arange(foreground.size).reshape(foreground.shape)
    us, ws = [], []
    for dz in (-1, 0, 1):
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if 0 < abs(dz) + abs(dy) + abs(dx) <= most and (dz, dy, dx) < (0, 0, 0):
                    other = _shifted(index, dz, dy, dx, -1)
                    ok = foreground & (other >= 0) & _shifted(foreground, dz, dy, dx, False)
                    if group is not None:
                        ok &= _shifted(group, dz, dy, dx, -2) == group
                    us.append(index[ok])
                    ws.append(other[ok])
    u, w = np.concatenate(us), np.concatenate(ws)
    root = np.arange(foreground.size)
    while len(u):
        a, b = root[u], root[w]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        live = root[u] != root[w]
        u, w = u[live], w[live]
    return np.where(foreground, root.reshape(foreground.shape), -1)


def dense_labels(roots: np.ndarray, least_size: int) -> np.ndarray:
    """Ids from 0 in scan order of the first voxel."""
    values, inverse, count = np.unique(roots, return_inverse=True, return_counts=True)
    keep = (values >= 0) & (count >= least_size)
    ids = np.full(len(values), BACKGROUND, np.int32)
    ids[keep] = np.arange(keep.sum())
    return ids[inverse].reshape(roots.shape)


def reconstruct_minima(a: np.ndarray, h: float, check_interval: int) -> np.ndarray:
    """H-minima: MASK where flooding by h leaves less than 1e-5."""
    a = a.astype(np.float32)
    r = a + np.float32(h)
    for _ in range(a.size + 2 * check_interval):
        low = r
        for d in ((1, 0, 0), (0, 1, 0), (0, 0, 1)):
            low = np.minimum(low, np.minimum(_shifted(low, *d, np.inf), _shifted(low, *(-x for x in d), np.inf)))
        following = np.maximum(low, a)
        if np.array_equal(following, r):
            return np.where(r - a < np.float32(1e-5), np.float32(MASK), np.float32(0))
        r = following
    raise ResourceLimit("the reconstruction didn't settle")


#: The order in which a voxel looks for a labelled neighbour, and what labels have outside the volume.
NEIGHBOUR_ORDER = ((-1, 0, 0), (0, 0, -1), (0, -1, 0), (0, 0, 1), (0, 1, 0), (1, 0, 0))
OUTSIDE = -3


def _grow(labels: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Background voxels take the first labelled neighbour in a fixed order, all at once."""
    out = labels.copy()
    open_ = (labels < 0) & allowed
    for d in NEIGHBOUR_ORDER:
        near = _shifted(labels, *d, BACKGROUND)
        take = open_ & (near >= 0)
        out[take] = near[take]
        open_ &= ~take
    return out


def watershed(intensity: np.ndarray, seeds: np.ndarray, levels: int = 256) -> np.ndarray:
    """Flood from seeds (-1: none) level by level; after each level the labels are opened."""
    labels, levels_of = seeds.astype(np.int32), intensity.astype(np.float32)
    changed = True
    for level in range(1, levels + 1):
        top = np.float32(level) / np.float32(levels)
        allowed = levels_of <= top
        if not changed and not (allowed & (levels_of > np.float32(level - 1) / np.float32(levels))).any():
            continue
        start = labels
        while True:
            grown = _grow(labels, allowed)
            if np.array_equal(grown, labels):
                break
            labels = grown
        differs = np.zeros(labels.shape, bool)
        for d in NEIGHBOUR_ORDER:
            near = _shifted(labels, *d, OUTSIDE)
            differs |= (near != OUTSIDE) & (near != labels)
        labels = np.where((labels >= 0) & differs, BACKGROUND, labels)
        labels = _grow(labels, np.ones(labels.shape, bool))
        changed = not np.array_equal(labels, start)
    return labels


def sample(a: np.ndarray, px: np.ndarray, py: np.ndarray, pz: np.ndarray) -> np.ndarray:
    """Trilinear samples at coordinates that are clamped to the volume, in float32."""
    d, h, w = a.shape

    def part(p, n):
        p = np.clip(p, np.float32(0), np.float32(n - 1)).astype(np.float32)
        low = np.floor(p).astype(np.int64)
        return low, np.minimum(low + 1, n - 1), (p - low.astype(np.float32)).astype(np.float32)

    x0, x1, fx = part(px, w)
    y0, y1, fy = part(py, h)
    z0, z1, fz = part(pz, d)

    def line(z, y):
        low = a[z, y, x0]
        return low + (a[z, y, x1] - low) * fx

    def face(z):
        low = line(z, y0)
        return low + (line(z, y1) - low) * fy

    low = face(z0)
    return low + (face(z1) - low) * fz


def response(a: np.ndarray, radius: int, level: int, gaussian: bool, first: int, last: int, base: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Least directional mean and its alpha for planes first..last - 1 of a volume of ``depth`` planes.

    ``a`` holds the planes from ``base`` on that the rays reach.  Radii fall and
    directions keep their order; only a strictly smaller sum replaces.
    """
    a = a.astype(np.float32)
    vectors = directions(level)
    alphas = direction_alpha(vectors)
    zs, ys, xs = np.meshgrid(np.arange(first, last, dtype=np.float32), np.arange(a.shape[1], dtype=np.float32), np.arange(a.shape[2], dtype=np.float32), indexing="ij")
    least = np.full(zs.shape, np.finfo(np.float32).max, np.float32)
    alpha = np.zeros(zs.shape, np.float32)
    for r in range(radius, 0, -1):
        weights = np.array(line_weights(r, gaussian), np.float32)
        for (dx, dy, dz), bend in zip(vectors, alphas, strict=True):
            total = np.zeros(zs.shape, np.float32)
            for k, weight in zip(range(-r, r + 1), weights, strict=True):
                pz = np.clip(zs + dz * np.float32(k), 0, depth - 1) - np.float32(base)
                total += sample(a, xs + dx * np.float32(k), ys + dy * np.float32(k), pz) * weight
            less = least > total
            least[less] = total[less]
            alpha[less] = bend
    return least, alpha


def wall_thickness(mask: np.ndarray, start: int) -> int:
    """Twice the first radius whose opening leaves at most half of the mask."""
    top = max(mask.shape)
    total = np.abs(mask.astype(np.float64)).sum()
    for radius in range(min(max(start, 1), top), top + 1):
        if np.abs(chunked(mask, radius, True).astype(np.float64)).sum() <= total * 0.5:
            return radius * 2
    return top * 2


def label_boxes(labels: np.ndarray) -> list[tuple[slice, ...]]:
    """The bounding box of each label from 0 on."""
    n = int(labels.max(initial=-1)) + 1
    spots = np.nonzero(labels >= 0)
    which = labels[spots]
    ends = []
    for axis, at in enumerate(spots):
        lo, hi = np.full(n, labels.shape[axis]), np.full(n, -1)
        np.minimum.at(lo, which, at)
        np.maximum.at(hi, which, at)
        ends.append([slice(int(a), int(b) + 1) for a, b in zip(lo, hi, strict=True)])
    return list(zip(*ends, strict=True))


def staged_segmentation(masks, shape, *, closing_radius: int, more_than: int, invalid_area: float, outside: np.ndarray | None) -> tuple[np.ndarray, int, int]:
    """Labels, their number and the passes done over a sequence of masks (callables).

    Voxels of a pass's dark components get labels; on every pass but the last a
    component waits if too much of its closed shape is neither dark nor labelled.
    """
    labels, count, thickness = np.full(shape, BACKGROUND, np.int32), 0, 0
    for number, make in enumerate(masks):
        final = number == len(masks) - 1
        mask = closing(make().astype(np.float32), closing_radius)
        mask = np.where(labels >= 0, np.float32(0), mask)
        if outside is not None:
            mask = np.where(outside, np.float32(0), mask)
        thickness = wall_thickness(mask, thickness // 2)
        if outside is not None:
            mask = np.where(outside, np.float32(MASK), mask)
        dark = (mask <= np.float32(LOW)) & (labels < 0)
        candidates = dense_labels(components(dark), more_than + 1)
        boxes = label_boxes(candidates)
        waiting, before = False, labels.copy()
        for c in range(int(candidates.max(initial=-1)) + 1):
            # the component's box, around it what its dilation can reach, and what the erosion of that reads
            box = tuple(slice(max(0, s.start - 2 * (thickness // 2)), s.stop + 2 * (thickness // 2)) for s in boxes[c])
            own = candidates[box] == c
            if not final:
                closed = chunked(own.astype(np.float32), thickness // 2, False)
                if ((closed > 0) & (candidates[box] < 0) & (before[box] < 0)).sum() > np.float32(invalid_area) * np.float32(thickness):
                    waiting = True
                    continue
            labels[box][own] = count
            count += 1
        if not waiting:
            return labels, count, number + 1
    return labels, count, len(masks)
