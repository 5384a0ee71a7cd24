"""GeoJSON geometry objects: two or three ordinates, finite, uniform, nothing empty."""

from __future__ import annotations

import json
import math
import struct

from .wkb import Geometry, bad, is_empty

#: GeoJSON's names and how deeply each nests its positions.
TYPES = {"Point": ("point", 0), "LineString": ("linestring", 1), "Polygon": ("polygon", 2), "MultiPoint": ("multipoint", 1), "MultiLineString": ("multilinestring", 2), "MultiPolygon": ("multipolygon", 3)}
_PARTS = {"multipoint": "point", "multilinestring": "linestring", "multipolygon": "polygon"}
_NAMES = {kind: name for name, (kind, _) in TYPES.items()} | {"geometrycollection": "GeometryCollection"}


def _position(value) -> tuple:
    if not isinstance(value, list) or len(value) not in (2, 3) or not all(isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) for v in value):
        raise bad("a position has two or three finite numbers")
    return tuple(map(float, value))


def _nested(value, depth: int):
    if depth == 0:
        return _position(value)
    if not isinstance(value, list) or not value:
        raise bad("coordinates are empty or of the wrong form")
    return [_nested(v, depth - 1) for v in value]


def _sizes(content) -> set[int]:
    return {len(content)} if isinstance(content, tuple) else {n for c in content for n in _sizes(c)}


def parse(value: dict | None) -> Geometry | None:
    if value is None:
        return None
    if not isinstance(value, dict):
        raise bad("a geometry is an object")
    name = value.get("type")
    if name == "GeometryCollection":
        parts = value.get("geometries")
        if not isinstance(parts, list) or not parts:
            raise bad("an empty collection")
        parts = [parse(p) for p in parts]
        if None in parts or len({p.dims for p in parts}) > 1:
            raise bad("mixed dimensions")
        return Geometry("geometrycollection", parts[0].dims, parts)
    if name not in TYPES:
        raise bad("unknown type")
    kind, depth = TYPES[name]
    content = _nested(value.get("coordinates"), depth)
    sizes = _sizes(content)
    if len(sizes) > 1:
        raise bad("mixed dimensions")
    dims = "xy" if sizes == {2} else "xyz"
    if kind in _PARTS:
        content = [Geometry(_PARTS[kind], dims, c) for c in content]
    return Geometry(kind, dims, content)


def _no_twins(pairs):
    out = dict(pairs)
    if len(out) < len(pairs):
        raise bad("a key stands twice")
    return out


_POINT = struct.Struct("<BIdd")


def plain_point(value) -> bytes | None:
    """The cell of a point of two finite numbers, by a shorter way; None for all else."""
    if type(value) is dict and value.get("type") == "Point":
        c = value.get("coordinates")
        if type(c) is list and len(c) == 2 and type(c[0]) in (int, float) and type(c[1]) in (int, float) and c[0] - c[0] == 0 == c[1] - c[1]:
            return _POINT.pack(1, 1, *c)
    return None


def loads(text: str):
    """JSON in which no object has a key twice."""
    try:
        return json.loads(text, object_pairs_hook=_no_twins)
    except ValueError:
        raise bad("not JSON") from None


def _coordinates(g: Geometry):
    if g.kind in _PARTS:
        return [_coordinates(p) for p in g.content]
    listed = lambda c: list(c) if isinstance(c, tuple) else [listed(x) for x in c]
    return listed(g.content)


def to_object(g: Geometry) -> dict:
    if g.srid is not None or g.dims not in ("xy", "xyz"):
        raise bad("GeoJSON has no measures and no SRID")
    if g.kind not in _NAMES or is_empty(g) or (isinstance(g.content, list) and not all(g.content)):
        raise bad("GeoJSON can't hold this geometry")
    if g.kind == "geometrycollection":
        return {"type": "GeometryCollection", "geometries": [to_object(p) for p in g.content]}
    return {"type": _NAMES[g.kind], "coordinates": _coordinates(g)}


def dumps(g: Geometry) -> str:
    return json.dumps(to_object(g), allow_nan=False, separators=(",", ":"))
