"""WKB and EWKB: structural inspection, decoding, encoding and bounds.

A geometry is a ``Geometry``: kind, dimensions, optional srid, and content by kind. A point's content is its ordinates or
None if empty; a line string's or circular string's a list of ordinate tuples; a polygon's or triangle's a list of rings;
any other kind's a list of geometries.
"""

from __future__ import annotations

import math
import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from ..errors import EdgeError
from ..limits import Limits

#: Type codes of the simple feature standards; 13 and 14 are abstract and stand for nothing.
KINDS = {
    1: "point", 2: "linestring", 3: "polygon", 4: "multipoint", 5: "multilinestring", 6: "multipolygon", 7: "geometrycollection", 8: "circularstring",
    9: "compoundcurve", 10: "curvepolygon", 11: "multicurve", 12: "multisurface", 15: "polyhedralsurface", 16: "tin", 17: "triangle",
}
CODES = {kind: code for code, kind in KINDS.items()}
DIMENSIONS = ("xy", "xyz", "xym", "xyzm")
SIZES = {"xy": 2, "xyz": 3, "xym": 3, "xyzm": 4}
_LINES, _CURVES = {"linestring", "circularstring"}, {"linestring", "circularstring", "compoundcurve"}
#: What a collection may hold.
CHILDREN = {
    "multipoint": {"point"}, "multilinestring": {"linestring"}, "multipolygon": {"polygon"}, "geometrycollection": set(CODES), "compoundcurve": _LINES,
    "curvepolygon": _CURVES, "multicurve": _CURVES, "multisurface": {"polygon", "curvepolygon"}, "polyhedralsurface": {"polygon"}, "tin": {"triangle"},
}
#: Labels of footers and reports.
LABELS = {
    "point": "Point", "linestring": "LineString", "polygon": "Polygon", "multipoint": "MultiPoint", "multilinestring": "MultiLineString", "multipolygon": "MultiPolygon",
    "geometrycollection": "GeometryCollection", "circularstring": "CircularString", "compoundcurve": "CompoundCurve", "curvepolygon": "CurvePolygon", "multicurve": "MultiCurve",
    "multisurface": "MultiSurface", "polyhedralsurface": "PolyhedralSurface", "tin": "TIN", "triangle": "Triangle",
}
Z_FLAG, M_FLAG, SRID_FLAG = 0x80000000, 0x40000000, 0x20000000


class Geometry(NamedTuple):
    kind: str
    dims: str
    content: object
    srid: int | None = None


class Inspection(NamedTuple):
    kind: str
    dims: str
    srid: int | None
    coherent: bool  # all parts have the same dimensions
    contains_srid: bool
    components: int


def bad(message: str) -> EdgeError:
    return EdgeError("INVALID_GEOMETRY", message)


def label(kind: str, dims: str) -> str:
    return LABELS[kind] + {"xy": "", "xyz": " Z", "xym": " M", "xyzm": " ZM"}[dims]


def from_label(text: str) -> tuple[str, str]:
    name, _, suffix = text.partition(" ")
    found = {v.lower(): k for k, v in LABELS.items()}.get(name.lower())
    dims = {"": "xy", "Z": "xyz", "M": "xym", "ZM": "xyzm"}.get(suffix)
    if found is None or dims is None:
        raise EdgeError("CONTRACT", "unknown geometry type label")
    return found, dims


def split_code(code: int) -> tuple[str, str, bool]:
    """Kind, dimensions and presence of an SRID of a type word, ISO or extended."""
    z, m, srid, base = bool(code & Z_FLAG), bool(code & M_FLAG), bool(code & SRID_FLAG), code & 0x1FFFFFFF
    if base >= 1000:
        thousand, base = divmod(base, 1000)
        if z or m or srid or thousand > 3:
            raise bad("type word mixes notations")
        z, m = thousand in (1, 3), thousand in (2, 3)
    if base not in KINDS:
        raise bad("unknown type")
    return KINDS[base], DIMENSIONS[z + 2 * m], srid


class _Walk:
    """A bounds-checked cursor; what is announced must fit into what is left before anything is allocated."""

    def __init__(self, data: bytes, limits: Limits) -> None:
        if len(data) > limits.max_cell_bytes:
            raise bad("cell is too large")
        self.data, self.at, self.limits, self.components = data, 0, limits, 0
        self.order = "<"

    def take(self, size: int) -> int:
        at, self.at = self.at, self.at + size
        if self.at > len(self.data):
            raise bad("cell is cut short")
        return at

    def byte_order(self) -> None:
        order = self.data[self.take(1)]
        if order > 1:
            raise bad("unknown byte order")
        self.order = "<" if order else ">"

    def word(self) -> int:
        return struct.unpack_from(self.order + "I", self.data, self.take(4))[0]

    def count(self, least: int) -> int:
        n = self.word()
        if n * least > len(self.data) - self.at:
            raise bad("count does not fit into the cell")
        self.components += n
        if self.components > self.limits.components:
            raise EdgeError("LIMIT", "too many components", category="resource")
        return n

    def header(self) -> tuple[str, str, int | None, str]:
        self.byte_order()
        kind, dims, has = split_code(self.word())
        return kind, dims, (self.word() if has else None), self.order


def _visit(walk: _Walk, depth: int, build: bool, allowed: set[str] | None, seen: list):
    if depth > walk.limits.max_depth:
        raise bad("nested too deeply")
    kind, dims, srid, order = walk.header()
    if allowed is not None and kind not in allowed:
        raise bad("part of a type that does not belong there")
    seen.append((dims, srid))
    size = SIZES[dims]

    def run(n: int):
        at = walk.take(8 * size * n)
        if not build:
            return None
        flat = struct.unpack_from(f"{order}{size * n}d", walk.data, at)
        return [tuple(flat[k : k + size]) for k in range(0, size * n, size)]

    if kind == "point":
        walk.components += 1
        point = run(1)
        content = None if build and all(math.isnan(v) for v in point[0]) else point and point[0]
    elif kind in _LINES:
        content = run(walk.count(8 * size))
    elif kind in ("polygon", "triangle"):
        content = [run(walk.count(8 * size)) for _ in range(walk.count(4))]
    else:
        content = [_visit(walk, depth + 1, build, CHILDREN[kind], seen) for _ in range(walk.count(5))]
        walk.order = order
    return Geometry(kind, dims, content, srid) if build else (kind, dims, srid)


def inspect(data: bytes, limits: Limits = Limits()) -> Inspection:
    """Structure of a cell without building it."""
    walk, seen = _Walk(data, limits), []
    kind, dims, srid = _visit(walk, 1, False, None, seen)
    if walk.at != len(data):
        raise bad("bytes after the geometry")
    return Inspection(kind, dims, srid, len({d for d, _ in seen}) == 1, any(s is not None for _, s in seen), walk.components)


def decode(data: bytes, limits: Limits = Limits()) -> Geometry:
    walk = _Walk(data, limits)
    out = _visit(walk, 1, True, None, [])
    if walk.at != len(data):
        raise bad("bytes after the geometry")
    return out


def encode(g: Geometry, extended: bool = False) -> bytes:
    """Little-endian WKB; an SRID is only written in the extended form and refused in the plain one."""
    if g.srid is not None and not extended:
        raise bad("plain WKB has no place for an SRID")
    code, z, m = CODES[g.kind], "z" in g.dims, "m" in g.dims
    if extended:
        code |= Z_FLAG * z | M_FLAG * m | SRID_FLAG * (g.srid is not None)
    else:
        code += 1000 * z + 2000 * m
    out = [struct.pack("<BI", 1, code)] + ([struct.pack("<I", g.srid)] if g.srid is not None else [])
    size = SIZES[g.dims]

    def run(points) -> bytes:
        for p in points:
            if len(p) != size:
                raise bad("ordinates do not match the dimensions")
        return struct.pack(f"<{size * len(points)}d", *(v for p in points for v in p))

    if g.kind == "point":
        out.append(run([g.content if g.content is not None else (math.nan,) * size]))
    elif g.kind in _LINES:
        out += [struct.pack("<I", len(g.content)), run(g.content)]
    elif g.kind in ("polygon", "triangle"):
        out.append(struct.pack("<I", len(g.content)))
        out += [struct.pack("<I", len(ring)) + run(ring) for ring in g.content]
    else:
        out.append(struct.pack("<I", len(g.content)))
        for part in g.content:
            if part.kind not in CHILDREN[g.kind]:
                raise bad("part of a type that does not belong there")
            out.append(encode(part, extended))
    return b"".join(out)


def points(g: Geometry):
    """All ordinate tuples, in order."""
    if g.kind == "point":
        if g.content is not None:
            yield g.content
    elif g.kind in _LINES:
        yield from g.content
    elif g.kind in ("polygon", "triangle"):
        for ring in g.content:
            yield from ring
    else:
        for part in g.content:
            yield from points(part)


def is_empty(g: Geometry) -> bool:
    return next(points(g), None) is None


def bbox(data: bytes | None) -> tuple[float, float, float, float] | None:
    """Bounds in x and y, or None where none can be vouched for: malformed, empty, non-finite, curved or too deep."""
    if data is None:
        return None
    try:
        g = decode(data, Limits(max_depth=32))
    except (EdgeError, struct.error):
        return None
    if not _classic(g):
        return None
    xs, ys = [], []
    for p in points(g):
        if not (math.isfinite(p[0]) and math.isfinite(p[1])):
            return None
        xs.append(p[0])
        ys.append(p[1])
    return (min(xs), min(ys), max(xs), max(ys)) if xs else None


def _classic(g: Geometry) -> bool:
    return CODES[g.kind] <= 7 and (not isinstance(g.content, list) or not g.content or not isinstance(g.content[0], Geometry) or all(map(_classic, g.content)))


_POINT_HEAD = np.frombuffer(struct.pack("<BI", 1, 1), np.uint8)


def bbox_columns(cells: list[bytes | None]) -> tuple[list, list, list, list]:
    """Bounds of many cells; plain little-endian points, which have 21 bytes, are read together."""
    out: list[list] = [[None] * len(cells) for _ in range(4)]
    short = [k for k, c in enumerate(cells) if c is not None and len(c) == 21]
    done = set()
    if short:
        flat = np.frombuffer(b"".join([cells[k] for k in short]), np.uint8).reshape(-1, 21)
        xy = np.ascontiguousarray(flat[:, 5:]).view("<f8")
        good = (flat[:, :5] == _POINT_HEAD).all(axis=1) & np.isfinite(xy).all(axis=1)
        for k, ok, x, y in zip(short, good.tolist(), xy[:, 0].tolist(), xy[:, 1].tolist()):
            if ok:
                out[0][k] = out[2][k] = x
                out[1][k] = out[3][k] = y
                done.add(k)
    for k, cell in enumerate(cells):
        if k not in done and (box := bbox(cell)) is not None:
            for axis in range(4):
                out[axis][k] = box[axis]
    return tuple(out)


def point_cells(x: np.ndarray, y: np.ndarray) -> list[bytes]:
    """Plain little-endian points of many coordinates."""
    flat = np.empty((len(x), 21), np.uint8)
    flat[:, :5] = _POINT_HEAD
    flat[:, 5:] = np.ascontiguousarray(np.stack([x, y], axis=1).astype("<f8")).view(np.uint8).reshape(len(x), 16)
    raw = flat.tobytes()
    return [raw[k : k + 21] for k in range(0, len(raw), 21)]


def plain_points(cells: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
    """x and y of a column that holds nothing but plain little-endian points, else None."""
    if cells.null_count or not len(cells):
        return None
    cells = cells.cast(pa.binary())
    offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
    if (np.diff(offsets) != 21).any():
        return None
    raw = np.frombuffer(cells.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, 21)
    if (raw[:, :5] != [1, 1, 0, 0, 0]).any():
        return None
    xy = np.ascontiguousarray(raw[:, 5:]).view("<f8")
    return (xy[:, 0], xy[:, 1]) if np.isfinite(xy).all() else None
