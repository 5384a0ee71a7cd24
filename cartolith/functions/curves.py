"""Affine maps, and points on bulges, arcs, circles, ellipses and splines."""

from __future__ import annotations

import math

import numpy as np

#: Segments of a full turn, and samples of a spline for each control point.
TURN, SAMPLES = 24, 6


def segments(sweep: float, turn: int = TURN) -> int:
    """Segments of an arc, in proportion to its share of a turn, one at least; halves round away from zero."""
    return max(1, math.floor(turn * min(1.0, abs(sweep) / math.tau) + 0.5))


def _around(center, radius: float, angles: np.ndarray) -> list[tuple[float, float]]:
    return list(zip((center[0] + radius * np.cos(angles)).tolist(), (center[1] + radius * np.sin(angles)).tolist()))


def bulge(p, q, value: float) -> list[tuple[float, float]]:
    """Points between two vertices whose joint arc's quarter angle has this tangent; both ends left out."""
    if value == 0 or not math.isfinite(value):
        return []
    lean = (1 / value - value) / 4
    center = ((p[0] + q[0]) / 2 - lean * (q[1] - p[1]), (p[1] + q[1]) / 2 + lean * (q[0] - p[0]))
    radius = math.sqrt((p[0] - center[0]) ** 2 + (p[1] - center[1]) ** 2)
    if radius == 0 or not math.isfinite(radius):
        return []
    sweep = 4 * math.atan(value)
    n = segments(sweep)
    return _around(center, radius, math.atan2(p[1] - center[1], p[0] - center[0]) + sweep * np.arange(1, n) / n)


def arc(center, radius: float, start: float, end: float) -> list[tuple[float, float]]:
    """Counter-clockwise from one angle to another, in degrees."""
    if not math.isfinite(radius) or radius <= 0 or not (math.isfinite(start) and math.isfinite(end)):
        return []
    sweep = math.radians(end - start)
    sweep += math.tau if sweep <= 0 else 0
    n = segments(sweep)
    return _around(center, radius, math.radians(start) + sweep * np.arange(n + 1) / n)


def circle(center, radius: float) -> list[tuple[float, float]]:
    if not math.isfinite(radius) or radius <= 0:
        return []
    ring = _around(center, radius, math.tau * np.arange(TURN) / TURN)
    return [*ring, ring[0]]


def ellipse(center, major, normal, ratio: float, start: float, end: float) -> list[tuple[float, float, float]]:
    """From one parameter to another, in the plane of the major axis and the normal."""
    major, normal = np.array(major, float), np.array(normal, float)
    length = math.sqrt(float(major @ major))
    if not math.isfinite(length) or length == 0 or not math.isfinite(ratio):
        return []
    up = normal / np.linalg.norm(normal) if normal.any() else np.array([0.0, 0.0, 1.0])
    minor = np.cross(up, major / length)
    if not minor.any():
        return []
    minor *= length * ratio / np.linalg.norm(minor)
    sweep = end - start + (math.tau if end <= start else 0)
    n = max(2, segments(sweep))
    t = start + sweep * np.arange(n + 1) / n
    points = np.array(center, float) + np.outer(np.cos(t), major) + np.outer(np.sin(t), minor)
    if abs(sweep - math.tau) < 1e-9:
        points[-1] = points[0]
    return [tuple(p) for p in points.tolist()]


def spline(degree: int, knots: list[float], control: list[tuple], weights: list[float]) -> list[tuple]:
    """Points of a rational B-spline; knots that don't fit give the control polygon."""
    n = len(control)
    if n < 2:
        return list(control)
    p = min(max(1, degree), n - 1)
    if len(knots) != n + p + 1 or not knots[p] < knots[n] or not all(map(math.isfinite, (knots[p], knots[n]))):
        return list(control)
    w = np.array([weights[k] if k < len(weights) and math.isfinite(weights[k]) and weights[k] > 0 else 1.0 for k in range(n)])
    points, u = np.column_stack([np.array(control, float) * w[:, None], w]), np.array(knots, float)
    out = []
    for at in np.linspace(u[p], u[n], SAMPLES * max(n, 2)):
        span = min(max(int(np.searchsorted(u, at, side="right")) - 1, p), n - 1)
        local = points[span - p : span + 1].copy()
        for level in range(1, p + 1):
            for j in range(p, level - 1, -1):
                low, high = u[span - p + j], u[span + 1 + j - level]
                share = 0.0 if high == low else (at - low) / (high - low)
                local[j] = (1 - share) * local[j - 1] + share * local[j]
        if abs(local[p, -1]) > 1e-12:
            out.append(tuple((local[p, :-1] / local[p, -1]).tolist()))
    return out or list(control)


def insertion(location, rotation: float, scale) -> np.ndarray:
    """Scale, then turn by degrees, then move; a scale of zero counts as one."""
    s = [v or 1.0 for v in scale]
    c, d = math.cos(math.radians(rotation)), math.sin(math.radians(rotation))
    return np.array([[c * s[0], -d * s[1], 0, location[0]], [d * s[0], c * s[1], 0, location[1]], [0, 0, s[2], location[2]], [0, 0, 0, 1.0]])


def object_axes(normal) -> np.ndarray:
    """From an object's own coordinates to the world's, by the arbitrary axis rule."""
    n = np.array(normal, float)
    out = np.eye(4)
    if not n.any() or (n[0] == 0 and n[1] == 0 and n[2] > 0):
        return out
    n /= np.linalg.norm(n)
    x = np.cross([0.0, 1.0, 0.0] if abs(n[0]) < 1 / 64 and abs(n[1]) < 1 / 64 else [0.0, 0.0, 1.0], n)
    x /= np.linalg.norm(x)
    out[:3, 0], out[:3, 1], out[:3, 2] = x, np.cross(n, x), n
    return out


def moved(points, matrix: np.ndarray) -> list[tuple[float, float, float]]:
    flat = np.array([(*p, 0.0)[:3] for p in points], float).reshape(-1, 3)
    return [tuple(p) for p in (flat @ matrix[:3, :3].T + matrix[:3, 3]).tolist()]
