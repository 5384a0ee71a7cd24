"""DXF drawings: entities become points, lines and areas, curves are sampled, and block references are exploded."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from ..contract import GeometryContract, Layer, geometry_field
from ..crs import Crs, from_definition, resolved
from ..errors import EdgeError
from ..functions import curves, wkb, wkt
from ..functions.wkb import Geometry, bad
from .base import dicts, load, text_of, write_one

DEPTH, ENTITIES = 16, 5_000_000


def pairs(path: str):
    """(group code, value) of a text drawing."""
    with open(path, encoding="utf-8", errors="replace") as f:
        while line := f.readline():
            value = f.readline()
            try:
                code = int(line)
            except ValueError:
                raise EdgeError("FORMAT", "a group code is not a number") from None
            yield code, value.rstrip("\r\n")


class Entity:
    """Group codes and values of an entity; ``inner`` are the vertices that follow it."""

    def __init__(self, kind: str) -> None:
        self.kind, self.groups, self.inner = kind, [], []

    def one(self, code: int, default=0.0, kind=float):
        found = next((v for c, v in self.groups if c == code), None)
        try:
            return default if found is None else kind(found)
        except ValueError:
            raise EdgeError("FORMAT", "a group's value is not a number") from None

    def all(self, code: int) -> list[float]:
        return [float(v) for c, v in self.groups if c == code]

    def point(self, code: int = 10) -> tuple[float, float, float]:
        return self.one(code), self.one(code + 10), self.one(code + 20)

    @property
    def layer(self) -> str:
        return self.one(8, "0", str)

    @property
    def normal(self) -> tuple[float, float, float]:
        return self.one(210), self.one(220), self.one(230, 1.0)


def drawing(path: str) -> tuple[list[Entity], dict[str, tuple[tuple, list[Entity]]], str | None]:
    """Entities, blocks (base point and entities) and the CRS text of the geodata object."""
    entities, blocks, crs = [], {}, []
    section, target, current, parent, block, expect = None, None, None, None, None, False
    for code, value in pairs(path):
        if code == 0:
            current = None
            if value == "SECTION":
                expect = True
            elif value == "ENDSEC":
                section, target, parent = None, None, None
            elif value == "EOF":
                break
            elif section == "BLOCKS" and value == "BLOCK":
                block = current = Entity("BLOCK")
                target = []
            elif section == "BLOCKS" and value == "ENDBLK":
                if block is not None:
                    blocks[block.one(2, "", str)] = (block.point(), target)
                block, target, parent = None, None, None
            elif value == "VERTEX" and parent is not None:
                current = Entity("VERTEX")
                parent.inner.append(current)
            elif value == "SEQEND":
                parent = None
            elif section == "OBJECTS":
                current = Entity(value) if value == "GEODATA" else None
                if current:
                    crs.append(current)
            elif section in ("ENTITIES", "BLOCKS") and target is not None:
                current = Entity(value)
                target.append(current)
                parent = current if value == "POLYLINE" else parent
        elif expect and code == 2:
            section, expect = value, False
            target = entities if value == "ENTITIES" else None
        elif current is not None:
            current.groups.append((code, value))
    text = "".join(v for c, v in crs[0].groups if c in (301, 303)) if crs else None
    return entities, blocks, text or None


def _line(points: list, closed: bool) -> Geometry | None:
    if closed and points and points[0] != points[-1]:
        points = [*points, points[0]]
    if len(points) < 2:
        return None
    return Geometry("polygon", "xyz", [points]) if closed and len(points) >= 4 else Geometry("linestring", "xyz", points)


def _run(vertices: list[tuple], bulges: list[float], closed: bool) -> list[tuple]:
    out = []
    for k, p in enumerate(vertices):
        out.append(p)
        follow = vertices[(k + 1) % len(vertices)] if closed or k + 1 < len(vertices) else None
        if follow is not None and bulges[k]:
            out += [(*q, p[2]) for q in curves.bulge(p, follow, bulges[k])]
    return out


def shape_of(e: Entity) -> tuple[Geometry | None, str | None]:
    """An entity's shape in the world's coordinates, and its text."""
    axes = curves.object_axes(e.normal)
    lift = lambda g: None if g is None else _mapped(g, axes)
    if e.kind == "POINT":
        return Geometry("point", "xyz", e.point()), None
    if e.kind in ("TEXT", "MTEXT"):
        text = "".join(v for c, v in e.groups if c in (3, 1))
        g = Geometry("point", "xyz", e.point())
        return (g if e.kind == "MTEXT" else lift(g)), text
    if e.kind == "LINE":
        return Geometry("linestring", "xyz", [e.point(), e.point(11)]), None
    if e.kind == "CIRCLE":
        x, y, z = e.point()
        ring = [(*p, z) for p in curves.circle((x, y), e.one(40))]
        return lift(Geometry("polygon", "xyz", [ring]) if ring else None), None
    if e.kind == "ARC":
        x, y, z = e.point()
        return lift(_line([(*p, z) for p in curves.arc((x, y), e.one(40), e.one(50), e.one(51))], False)), None
    if e.kind == "ELLIPSE":
        points = curves.ellipse(e.point(), e.point(11), e.normal, e.one(40, 1.0), e.one(41), e.one(42, 6.283185307179586))
        return _line(points, bool(points) and points[0] == points[-1]), None
    if e.kind == "SPLINE":
        control = list(zip(e.all(10), e.all(20), e.all(30)))
        return _line(curves.spline(e.one(71, 3, int), e.all(40), control, e.all(41)), bool(e.one(70, 0, int) & 1)), None
    if e.kind == "LWPOLYLINE":
        vertices, bulges, z = [], [], e.one(38)
        for code, value in e.groups:
            if code == 10:
                vertices.append([float(value), 0.0, z])
                bulges.append(0.0)
            elif code == 20 and vertices:
                vertices[-1][1] = float(value)
            elif code == 42 and vertices:
                bulges[-1] = float(value)
        closed = bool(e.one(70, 0, int) & 1)
        return lift(_line(_run([tuple(v) for v in vertices], bulges, closed), closed)), None
    if e.kind == "POLYLINE":
        flags = e.one(70, 0, int)
        if flags & 80:
            raise EdgeError("UNSUPPORTED", "meshes can't be read", category="capability")
        g = _line(_run([v.point() for v in e.inner], [v.one(42) for v in e.inner], bool(flags & 1)), bool(flags & 1))
        return (g if flags & 8 else lift(g)), None
    if e.kind == "SOLID":
        a, b, c, d = (e.point(k) for k in (10, 11, 12, 13))
        ring = [a, b, d, c] if d != c else [a, b, c]
        return lift(Geometry("polygon", "xyz", [[*ring, a]])), None
    raise EdgeError("UNSUPPORTED", "an entity can't be read", category="capability")


def _mapped(g: Geometry, matrix: np.ndarray) -> Geometry:
    if g.kind == "point":
        return g._replace(content=curves.moved([g.content], matrix)[0])
    if g.kind == "linestring":
        return g._replace(content=curves.moved(g.content, matrix))
    return g._replace(content=[curves.moved(r, matrix) for r in g.content])


def walk(entities: list[Entity], blocks: dict, matrix: np.ndarray = np.eye(4), layer: str | None = None, inside: tuple = ()):
    """(shape, layer, entity type, text) of all entities, references exploded; layer 0 of a block is its reference's."""
    for e in entities:
        own = layer if e.layer == "0" and layer is not None else e.layer
        if e.kind == "INSERT":
            name = e.one(2, "", str)
            if name in inside or len(inside) >= DEPTH:
                raise EdgeError("FORMAT", "block references form a circle or nest too deeply")
            if name not in blocks:
                raise EdgeError("FORMAT", "a block reference has no block")
            base, inner = blocks[name]
            here = curves.object_axes(e.normal) @ curves.insertion(e.point(), e.one(50), (e.one(41, 1.0), e.one(42, 1.0), e.one(43, 1.0)))
            back = np.eye(4)
            back[:3, 3] = -np.array(base)
            yield from walk(inner, blocks, matrix @ here @ back, own, (*inside, name))
        elif e.kind not in ("ATTRIB", "ATTDEF", "VIEWPORT"):
            shape, text = shape_of(e)
            if shape is not None:
                yield _mapped(shape, matrix), own, e.kind, text


def _items(path: str):
    entities, blocks, text = drawing(path)
    for n, item in enumerate(walk(entities, blocks)):
        if n >= ENTITIES:
            raise EdgeError("LIMIT", "too many entities", category="resource")
        yield item


def flat(g: Geometry) -> Geometry:
    cut = lambda c: c[:2] if isinstance(c, tuple) else [cut(x) for x in c]
    return Geometry(g.kind, "xy", cut(g.content))


def describe(spark: SparkSession, path: str, options: dict) -> list[Layer]:
    text = drawing(path)[2]
    crs = resolved(options["assume_crs"], text) if options.get("assume_crs") else from_definition(text) if text else Crs()
    if crs.resolution == "missing":
        raise EdgeError("CRS_REQUIRED", "there is no geodata; assume_crs must be given", category="contract", phase="open")
    types, high = set(), False
    for shape, *_ in _items(path):
        types.add(shape.kind)
        high = high or any(p[2] != 0 for p in wkb.points(shape))
    contract = GeometryContract("geometry", crs, True, "wkb", "xyz" if high else "xy", types=tuple(sorted(types)), declaration="exact" if types else "unresolved")
    return [Layer(0, "dxf", StructType([geometry_field(contract), *(StructField(n, StringType()) for n in ("layer", "dxf_type", "text"))]), {"high": high})]


def pieces(path: str, plan: dict, extra: dict) -> list:
    return [0]


def rows(path: str, plan: dict, extra: dict, piece):
    for n, (shape, layer, kind, text) in enumerate(_items(path)):
        yield wkb.encode(shape if extra["high"] else flat(shape)), layer, kind, text, n


def read(spark: SparkSession, path: str, layer: Layer, options: dict, columns: list[str] | None = None, index: bool = False) -> DataFrame:
    return load(spark, "dxf", path, layer, options, columns)


def entity_lines(g: Geometry, layer: str) -> list[tuple[int, str]]:
    """Group codes of the entities of one geometry; several parts become several entities."""
    n = wkt.number
    if g.kind in ("multipoint", "multilinestring", "multipolygon", "geometrycollection"):
        return [pair for part in g.content for pair in entity_lines(part, layer)]
    if "m" in g.dims or wkb.is_empty(g):
        raise bad("the format has no measures and nothing empty")
    if g.kind == "point":
        x, y, *z = g.content
        return [(0, "POINT"), (8, layer), (10, n(x)), (20, n(y)), (30, n(z[0] if z else 0.0))]
    if g.kind == "polygon":
        if len(g.content) > 1:
            raise bad("the format has no holes")
        points, closed = g.content[0][:-1], 1
    elif g.kind == "linestring":
        points, closed = g.content, 0
    else:
        raise bad("the format can't hold this geometry")
    if g.dims == "xy":
        return [(0, "LWPOLYLINE"), (8, layer), (90, str(len(points))), (70, str(closed)), *((c, n(v)) for p in points for c, v in ((10, p[0]), (20, p[1])))]
    vertices = [pair for p in points for pair in ((0, "VERTEX"), (8, layer), (10, n(p[0])), (20, n(p[1])), (30, n(p[2])), (70, "32"))]
    return [(0, "POLYLINE"), (8, layer), (66, "1"), (70, str(8 | closed)), *vertices, (0, "SEQEND")]


def write(spark: SparkSession, frames: list[tuple[Layer, DataFrame]], path: str, options: dict) -> dict:
    layer, df = frames[0]
    g = layer.geometry
    definition = g.crs.definition or f'LOCAL_CS["{g.crs.id}",AUTHORITY["{g.crs.id.partition(":")[0]}","{g.crs.id.partition(":")[2]}"]]'

    def task(batches):
        n = 0
        with open(path, "w", encoding="utf-8") as f:
            put = lambda items: f.write("".join(f"{c}\n{v}\n" for c, v in items))
            put([(0, "SECTION"), (2, "ENTITIES")])
            for row in dicts(batches):
                if row[g.name] is None:
                    raise EdgeError("DATA_MAPPING", "the format needs a geometry in each row", phase="write")
                name = row.get("layer")
                put(entity_lines(wkb.decode(row[g.name]), "0" if name is None else text_of(name)))
                n += 1
            put([(0, "ENDSEC"), (0, "SECTION"), (2, "OBJECTS"), (0, "GEODATA")])
            put([(301 if k + 255 >= len(definition) else 303, definition[k : k + 255]) for k in range(0, len(definition), 255)])
            put([(0, "ENDSEC"), (0, "EOF")])
        return {"rows": n}

    return write_one(df, task)
