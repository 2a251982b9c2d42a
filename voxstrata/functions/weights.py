"""Weights, directions and schedules: small tables that the driver makes."""

from __future__ import annotations

import math

import numpy as np

from ..model import InvalidArgument, ResourceLimit

MAX_PASSES = 100_000
WORK_LIMIT = 10_000_000_000_000
MEMORY_LIMIT = 16 * 1024**3

# The order of vertices and faces fixes the order of directions, which decides ties.
ICOSAHEDRON_VERTICES = (
    (0.000000, 0.000000, 1.000000),
    (0.723600, 0.525720, 0.447215),
    (-0.276385, 0.850640, 0.447215),
    (-0.894425, 0.000000, 0.447215),
    (-0.276385, -0.850640, 0.447215),
    (0.723600, -0.525720, 0.447215),
    (0.276385, 0.850640, -0.447215),
    (-0.723600, 0.525720, -0.447215),
    (-0.723600, -0.525720, -0.447215),
    (0.276385, -0.850640, -0.447215),
    (0.894425, 0.000000, -0.447215),
    (0.000000, 0.000000, -1.000000),
)
ICOSAHEDRON_FACES = (
    (0, 1, 2), (1, 0, 5), (0, 2, 3), (0, 3, 4), (0, 4, 5),
    (1, 5, 10), (2, 1, 6), (3, 2, 7), (4, 3, 8), (5, 4, 9),
    (1, 10, 6), (2, 6, 7), (3, 7, 8), (4, 8, 9), (5, 9, 10),
    (6, 10, 11), (7, 6, 11), (8, 7, 11), (9, 8, 11), (9, 10, 11),
)


def line_weights(radius: int, gaussian: bool) -> list[float]:
    """Weights of a line of 2r + 1 samples; the Gaussian has sigma 0.3 (r - 1) + 0.8."""
    if radius < 0:
        raise InvalidArgument("radius must not be negative")
    if not gaussian:
        return [float(np.float32(1 / (2 * radius + 1)))] * (2 * radius + 1)
    sigma = 0.3 * (radius - 1) + 0.8
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [float(np.float32(w / sum(raw))) for w in raw]


def box_weights(radius: int, gaussian: bool) -> list[float]:
    """One axis of the smoothing window; the Gaussian has sigma max(0.5, r / 2)."""
    sigma = max(0.5, radius / 2)
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) if gaussian else 1.0 for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def directions(level: int) -> np.ndarray:
    """float32 unit vectors of a subdivided icosahedron, one of each opposite pair, in order of making."""
    if not 1 <= level <= 5:
        raise InvalidArgument("direction level must be between 1 and 5")
    points = [np.array(p, np.float32) for p in ICOSAHEDRON_VERTICES]
    number = {p.tobytes(): i for i, p in enumerate(points)}
    edge_middle: dict[tuple[int, int], int] = {}

    def middle(a: int, b: int) -> int:
        pair = (min(a, b), max(a, b))
        if pair not in edge_middle:
            p = (points[a] + points[b]) * np.float32(0.5) + np.float32(0.0)
            if p.tobytes() not in number:
                number[p.tobytes()] = len(points)
                points.append(p)
            edge_middle[pair] = number[p.tobytes()]
        return edge_middle[pair]

    faces = list(ICOSAHEDRON_FACES)
    for _ in range(level):
        finer = []
        for a, b, c in faces:
            ab, bc, ac = middle(a, b), middle(b, c), middle(a, c)
            finer += [(a, ab, ac), (b, bc, ab), (c, ac, bc), (ac, ab, bc)]
        faces = finer
    kept, seen = [], set()
    for p in points:
        if (np.float32(0.0) - p).tobytes() not in seen:
            seen.add((p + np.float32(0.0)).tobytes())
            kept.append(p)
    out = np.stack(kept)
    return out / np.sqrt((out * out).sum(axis=1, dtype=np.float32))[:, None]


def direction_alpha(vectors: np.ndarray) -> np.ndarray:
    """How far a direction is from the XY plane, 0 to 1."""
    flat = np.clip(np.sqrt(vectors[:, 0] ** 2 + vectors[:, 1] ** 2), 0, 1)
    return np.abs(np.float32(2) * np.arccos(flat) / np.float32(np.pi)).astype(np.float32)


def _schedule(start: float, stop: float, step: float) -> list[float]:
    start, stop, step = (float(np.float32(x)) for x in (start, stop, step))
    sign = 1.0 if stop >= start else -1.0
    if not all(map(math.isfinite, (start, stop, step))) or step <= 0:
        raise InvalidArgument("a schedule needs finite ordered bounds and a positive step")
    out = [start]
    while sign * out[-1] < sign * stop:
        if len(out) >= MAX_PASSES:
            raise InvalidArgument("the schedule has too many passes")
        value = start + sign * step * len(out)
        out.append(float(np.float32(value)) if math.isfinite(value) and sign * value < sign * stop else stop)
    return out


def ascending_schedule(low: float, high: float, step: float) -> list[float]:
    if low > high:
        raise InvalidArgument("the bounds of a schedule must be ordered")
    return _schedule(low, high, step)


def descending_schedule(low: float, high: float, step: float) -> list[float]:
    if low > high:
        raise InvalidArgument("the bounds of a schedule must be ordered")
    return _schedule(high, low, step)


def estimate(width: int, height: int, depth: int, radius: int, level: int, schedule: list[float] | None = None) -> dict:
    """Work and memory of a directional operator; with a schedule, of a segmentation."""
    if min(width, height, depth) <= 0:
        raise InvalidArgument("extents must be positive")
    if not 1 <= radius <= 127 or not 1 <= level <= 5:
        raise InvalidArgument("radius must be 1 to 127 and level 1 to 5")
    count, samples, voxels = 5 * 4**level + 1, radius * (radius + 2), width * height * depth
    work, memory = voxels * count * samples, voxels * (16 if schedule is None else 48) + 12 * count
    if max(work, memory) >= 1 << 64:
        raise ResourceLimit("the work doesn't fit 64 bits")
    return {
        "voxels": voxels, "directions": count, "line_samples": samples, "work_items": work, "host_bytes": memory,
        "passes": 1 if schedule is None else len(schedule), "work_limit": WORK_LIMIT, "memory_limit": MEMORY_LIMIT, "within_limits": work <= WORK_LIMIT and memory <= MEMORY_LIMIT,
    }


def enforce(work: dict) -> None:
    if not work["within_limits"]:
        raise ResourceLimit(f"work {work['work_items']} of {work['work_limit']}, bytes {work['host_bytes']} of {work['memory_limit']}")


def lanczos_weight(distance: float, order: int) -> float:
    if abs(distance) >= order:
        return 0.0

    def sinc(t: float) -> float:
        return 1.0 if abs(t) < 1e-6 else math.sin(math.pi * t) / (math.pi * t)

    return sinc(distance) * sinc(distance / order)
