"""KML: placemarks in document order, parsed by events and with a strict guard against hostile XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from xml.parsers import expat
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from ..contract import GeometryContract, Layer, geometry_field
from ..crs import CRS84, resolved
from ..errors import EdgeError
from ..functions import wkb, wkt
from ..functions.wkb import Geometry, bad
from .base import dicts, load, text_of, write_one

DEPTH = 256
_SINGLE = {"Point": "point", "LineString": "linestring", "LinearRing": "linestring", "Polygon": "polygon"}
_SHAPES, _REFUSED = {*_SINGLE, "MultiGeometry"}, {"Model", "Track", "MultiTrack"}


def guard(path: str) -> None:
    """No document type, no more than DEPTH levels, well formed."""
    parser, depth = expat.ParserCreate(), 0

    def start(*_):
        nonlocal depth
        depth += 1
        if depth > DEPTH:
            raise EdgeError("LIMIT", "XML is nested too deeply", category="resource", phase="open")

    def end(*_):
        nonlocal depth
        depth -= 1

    def doctype(*_):
        raise EdgeError("FORMAT", "a document type is not allowed", phase="open")

    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = start, end, doctype
    with open(path, "rb") as f:
        try:
            parser.ParseFile(f)
        except expat.ExpatError:
            raise EdgeError("FORMAT", "XML is not well formed", phase="open") from None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _child(node, name: str):
    return next((c for c in node if _local(c.tag) == name), None)


def _positions(node) -> list[tuple]:
    own = _child(node, "coordinates")
    text = (own.text or "") if own is not None else ""
    out = []
    for item in text.split():
        try:
            values = tuple(float(v) for v in item.split(","))
        except ValueError:
            raise bad("not a coordinate") from None
        if len(values) not in (2, 3) or any(v - v != 0 for v in values):
            raise bad("a position has two or three finite numbers")
        out.append(values)
    if len({len(p) for p in out}) > 1:
        raise bad("mixed dimensions")
    return out


def shape_of(node) -> Geometry:
    name = _local(node.tag)
    if name == "MultiGeometry":
        parts = [shape_of(c) for c in node if _local(c.tag) in _SHAPES]
        dims = {p.dims for p in parts if not wkb.is_empty(p)}
        if len(dims) > 1:
            raise bad("mixed dimensions")
        dims = next(iter(dims), "xy")
        parts = [p._replace(dims=dims) for p in parts]
        kinds = {p.kind for p in parts}
        kind = f"multi{kinds.pop()}" if len(kinds) == 1 and kinds <= {"point", "linestring", "polygon"} else "geometrycollection"
        return Geometry(kind, dims, parts)
    if name == "Polygon":
        rings = []
        for boundary in node:
            if _local(boundary.tag) in ("outerBoundaryIs", "innerBoundaryIs"):
                ring = _child(boundary, "LinearRing")
                if ring is None:
                    raise bad("a boundary without a ring")
                rings.insert(0, _positions(ring)) if _local(boundary.tag) == "outerBoundaryIs" else rings.append(_positions(ring))
        points = [p for r in rings for p in r]
        content = rings
    else:
        points = _positions(node)
        if name == "Point" and len(points) != 1:
            raise bad("a point has one position")
        content = points[0] if name == "Point" else points
    sizes = {len(p) for p in points}
    if len(sizes) > 1:
        raise bad("mixed dimensions")
    return Geometry(_SINGLE[name], "xyz" if sizes == {3} else "xy", content)


def placemarks(path: str):
    """(shape, name, description) of each placemark; what has been read is let go."""
    stack = []
    for event, node in ET.iterparse(path, events=("start", "end")):
        if event == "start":
            stack.append(node)
            continue
        stack.pop()
        if _local(node.tag) != "Placemark":
            continue
        if any(_local(c.tag) in _REFUSED for c in node):
            raise EdgeError("UNSUPPORTED", "models and tracks can't be read", category="capability")
        shapes = [c for c in node if _local(c.tag) in _SHAPES]
        if len(shapes) > 1:
            raise EdgeError("FORMAT", "a placemark has more than one geometry")
        text = lambda n: None if (c := _child(node, n)) is None else (c.text or "")  # noqa: B023, E731
        yield (shape_of(shapes[0]) if shapes else None), text("name"), text("description")
        node.clear()
        if stack:
            stack[-1].remove(node)


def describe(spark: SparkSession, path: str, options: dict) -> list[Layer]:
    guard(path)
    types, dims = set(), set()
    for shape, _, _ in placemarks(path):
        if shape is not None:
            types.add(shape.kind)
            dims.add(shape.dims)
    contract = GeometryContract("geometry", resolved(CRS84), True, "wkb", dims.pop() if len(dims) == 1 else "unknown", types=tuple(sorted(types)), declaration="exact" if types else "unresolved")
    return [Layer(0, "kml", StructType([geometry_field(contract), StructField("name", StringType()), StructField("description", StringType())]))]


def pieces(path: str, plan: dict, extra: dict) -> list:
    return [0]


def rows(path: str, plan: dict, extra: dict, piece):
    for n, (shape, name, description) in enumerate(placemarks(path)):
        yield None if shape is None else wkb.encode(shape), name, description, n


def read(spark: SparkSession, path: str, layer: Layer, options: dict, columns: list[str] | None = None, index: bool = False) -> DataFrame:
    return load(spark, "kml", path, layer, options, columns, index)


def _coordinates(points) -> str:
    return "<coordinates>" + " ".join(",".join(map(wkt.number, p)) for p in points) + "</coordinates>"


def element(g: Geometry) -> str:
    if g.dims not in ("xy", "xyz") or g.srid is not None or wkb.is_empty(g):
        raise bad("the format can't hold this geometry")
    if g.kind == "point":
        return f"<Point>{_coordinates([g.content])}</Point>"
    if g.kind == "linestring":
        return f"<LineString>{_coordinates(g.content)}</LineString>"
    if g.kind == "polygon":
        rings = [f"<LinearRing>{_coordinates(r)}</LinearRing>" for r in g.content]
        return "<Polygon><outerBoundaryIs>" + rings[0] + "</outerBoundaryIs>" + "".join(f"<innerBoundaryIs>{r}</innerBoundaryIs>" for r in rings[1:]) + "</Polygon>"
    if g.kind == "geometrycollection" and len({p.kind for p in g.content}) == 1 and g.content[0].kind in ("point", "linestring", "polygon"):
        raise bad("a collection of one kind would read back as another type")
    if g.kind not in ("multipoint", "multilinestring", "multipolygon", "geometrycollection"):
        raise bad("the format can't hold this geometry")
    return "<MultiGeometry>" + "".join(map(element, g.content)) + "</MultiGeometry>"


def write(spark: SparkSession, frames: list[tuple[Layer, DataFrame]], path: str, options: dict) -> dict:
    layer, df = frames[0]
    g, names = layer.geometry, [f.name for f in layer.attributes]

    def task(batches):
        n = 0
        with open(path, "w", encoding="utf-8") as f:
            f.write('<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>\n')
            for row in dicts(batches):
                own = "".join(f"<{c}>{escape(text_of(row[c]))}</{c}>" for c in ("name", "description") if c in names and row[c] is not None)
                other = "".join(f'<Data name="{escape(c, {chr(34): "&quot;"})}"><value>{escape(text_of(row[c]))}</value></Data>' for c in names if c not in ("name", "description") and row[c] is not None)
                shape = "" if row[g.name] is None else element(wkb.decode(row[g.name]))
                f.write(f"<Placemark>{own}{'<ExtendedData>' + other + '</ExtendedData>' if other else ''}{shape}</Placemark>\n")
                n += 1
            f.write("</Document></kml>\n")
        return {"rows": n}

    return write_one(df, task)
