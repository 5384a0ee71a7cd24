"""Shapefiles: .shp and .dbf in step, in ranges of records; written as one folder or as loose files."""

from __future__ import annotations

import math
import os
import re
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..contract import GeometryContract, Layer, geometry_field
from ..crs import Crs, resolved, root_epsg
from ..errors import EdgeError
from ..functions import wkb
from ..functions.wkb import Geometry, bad
from ..operators.infer import EXACT
from .base import dicts, load, text_of, write_one

#: Shape codes: base 1 point, 3 line, 5 polygon, 8 multipoint; 10 more with heights, 20 more with measures only.
_BASE = {1: "point", 3: "multilinestring", 5: "multipolygon", 8: "multipoint"}
_CODE = {"point": 1, "linestring": 3, "multilinestring": 3, "polygon": 5, "multipolygon": 5, "multipoint": 8}
NO_DATA, PIECE_ROWS = -1e38, 65_536
#: Ring faults.
UNCLOSED, DEGENERATE, ORPHAN, NO_OUTER = "shapefile.unclosed_ring", "shapefile.degenerate_ring", "shapefile.inner_before_outer", "shapefile.no_outer_ring"
WGS84_PRJ = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'


def base_path(path: str) -> str:
    """Path of the files without their suffix; a ``.shp.d`` folder holds ``data``."""
    return os.path.join(path, "data") if path.rstrip("/").lower().endswith(".shp.d") else path[:-4]


def _header(base: str) -> tuple[int, str | None, int]:
    """Shape code, kind and records."""
    with open(base + ".shp", "rb") as f:
        head = f.read(100)
    if len(head) < 100 or struct.unpack(">i", head[:4])[0] != 9994:
        raise EdgeError("FORMAT", "not a shapefile", phase="open")
    code = struct.unpack("<i", head[32:36])[0]
    return code, _BASE.get(code % 10), (os.path.getsize(base + ".shx") - 100) // 8


def dbf_fields(base: str) -> tuple[list[tuple[str, str, int, int]], int, int, int]:
    """(name, type, width, decimals) of each field, records, header size and record size."""
    with open(base + ".dbf", "rb") as f:
        head = f.read(32)
        n, header, record = struct.unpack("<IHH", head[4:12])
        rest = f.read(header - 32)
    fields = []
    for k in range(0, len(rest) - 31, 32):
        if rest[k] == 13:
            break
        name = rest[k : k + 11].split(b"\0")[0].decode("utf-8", "replace")
        fields.append((name, chr(rest[k + 11]), rest[k + 16], rest[k + 17]))
    if len({f[0].lower() for f in fields}) < len(fields):
        raise EdgeError("FORMAT", "two attributes have one name", phase="open")
    return fields, n, header, record


def _attribute(raw: bytes, kind: str, width: int, decimals: int):
    text = raw.decode("utf-8", "replace").strip(" \0")
    if kind in "NF":
        if not text or text.strip("*") == "":
            return None
        if kind == "N" and decimals == 0 and width >= 10 and re.fullmatch(r"[+-]?\d+", text):
            return int(text)
        value = float(text)
        return value if math.isfinite(value) else None
    if kind == "L":
        return {"t": True, "y": True, "f": False, "n": False}.get(text.lower())
    return text or None


def parse_shape(raw: bytes, dims: str) -> Geometry | None:
    """One record's content."""
    code = struct.unpack_from("<i", raw)[0]
    if code == 0:
        return None
    kind, has_z, has_m = _BASE.get(code % 10), 10 < code < 20, code > 10
    size = wkb.SIZES[dims]
    if kind == "point":
        values = struct.unpack_from(f"<{2 + has_z + (has_m and len(raw) >= 4 + 8 * (3 + has_z))}d", raw, 4)
        values = values[:2] + ((values[2],) if has_z else ()) + ((values[-1],) if "m" in dims else ())
        if len(values) != size:
            values = (*values, *(NO_DATA,) * (size - len(values)))[:size]
        return Geometry("point", dims, tuple(values))
    at = 36
    if kind == "multipoint":
        parts, n = None, struct.unpack_from("<i", raw, at)[0]
        at += 4
    else:
        k, n = struct.unpack_from("<2i", raw, at)
        parts = list(struct.unpack_from(f"<{k}i", raw, at + 8)) + [n]
        at += 8 + 4 * k
    columns = [np.frombuffer(raw, "<f8", 2 * n, at).reshape(-1, 2)]
    at += 16 * n
    if has_z:
        columns.append(np.frombuffer(raw, "<f8", n, at + 16)[:, None])
        at += 16 + 8 * n
    if "m" in dims:
        measures = np.frombuffer(raw, "<f8", n, at + 16) if len(raw) >= at + 16 + 8 * n else np.full(n, NO_DATA)
        columns.append(measures[:, None])
    points = [tuple(p) for p in np.concatenate(columns, axis=1).tolist()]
    if kind == "multipoint":
        return Geometry(kind, dims, [Geometry("point", dims, p) for p in points])
    rings = [points[a:b] for a, b in zip(parts, parts[1:])]
    if kind == "multilinestring":
        return Geometry(kind, dims, [Geometry("linestring", dims, r) for r in rings])
    areas = [ring_area(r) for r in rings]
    # Faults are told in this order, whichever ring has them; a ring closes by its x and y alone.
    if not rings:
        raise EdgeError("INVALID_GEOMETRY", NO_OUTER)
    if any(r[0][:2] != r[-1][:2] for r in rings):
        raise EdgeError("INVALID_GEOMETRY", UNCLOSED)
    if any(len(r) < 4 or area == 0 or not math.isfinite(area) for r, area in zip(rings, areas)):
        raise EdgeError("INVALID_GEOMETRY", DEGENERATE)
    if areas[0] > 0:
        raise EdgeError("INVALID_GEOMETRY", ORPHAN)
    polygons: list[list] = []
    for ring, area in zip(rings, areas):
        if area < 0:  # clockwise: an outer ring
            polygons.append([ring])
        else:
            polygons[-1].append(ring)
    return Geometry(kind, dims, [Geometry("polygon", dims, p) for p in polygons])


def ring_area(ring: list) -> float:
    """Twice the signed area; positive counter-clockwise."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))


def records(base: str, first: int, last: int):
    """(attribute bytes, shape bytes) of undeleted records from ``first`` to before ``last``."""
    fields, n, header, size = dbf_fields(base)
    with open(base + ".shp", "rb") as shp, open(base + ".shx", "rb") as shx, open(base + ".dbf", "rb") as dbf:
        shx.seek(100 + 8 * first)
        index = struct.unpack(f">{2 * (last - first)}i", shx.read(8 * (last - first)))
        dbf.seek(header + size * first)
        for k in range(last - first):
            row = dbf.read(size)
            if row[:1] == b"*":
                continue
            shp.seek(2 * index[2 * k] + 8)
            yield first + k, row, shp.read(2 * index[2 * k + 1])


def _dims(base: str, code: int, n: int) -> str:
    if code < 10:
        return "xy"
    if code > 20:
        return "xym"
    for _, _, raw in records(base, 0, n):  # measures count only if a record has one
        found = parse_shape(raw, "xyzm")
        if found is not None and any(p[3] > NO_DATA for p in wkb.points(found)):
            return "xyzm"
    return "xyz"


def _crs(base: str, options: dict) -> Crs:
    if os.path.exists(base + ".prj"):
        with open(base + ".prj", encoding="utf-8", errors="replace") as f:
            text = f.read().strip()
        if options.get("assume_crs"):
            return resolved(options["assume_crs"], text)
        code = root_epsg(text)
        if code is None and text.upper().startswith("GEOGCS") and re.search(r"WGS[_ ]?(19)?84", text.upper()):
            return resolved("EPSG:4326", text)
        return resolved(f"EPSG:{code}", text) if code else Crs("declared", None, text)
    if not options.get("assume_crs"):
        raise EdgeError("CRS_REQUIRED", "there is no .prj; assume_crs must be given", category="contract", phase="open")
    return resolved(options["assume_crs"])


def describe(spark: SparkSession, path: str, options: dict) -> list[Layer]:
    base = base_path(path)
    code, kind, n = _header(base)
    fields, rows_, *_ = dbf_fields(base)
    if rows_ != n:
        raise EdgeError("FORMAT", "shapes and attributes differ in number", phase="open")
    if kind is None and code != 0:
        raise EdgeError("UNSUPPORTED", "unknown shape type", category="capability", phase="open")
    types = {"multilinestring": ("multilinestring",), "multipolygon": ("multipolygon",)}.get(kind, (kind,) if kind else ())
    contract = GeometryContract("geometry", _crs(base, options), True, "wkb", _dims(base, code, n) if code else "unknown", types=types, declaration="exact" if types else "unresolved")
    columns, names = [], [f[0] for f in fields]
    for name, letter, width, decimals in fields:
        whole = letter == "N" and decimals == 0 and width >= 10
        columns.append(StructField(name, LongType() if whole else DoubleType() if letter in "NF" else BooleanType() if letter == "L" else StringType(), True))
    return [Layer(0, os.path.basename(base), StructType([geometry_field(contract), *columns]), {"dims": contract.dimensions, "fields": [list(f) for f in fields], "records": n, "rows": n, "names": names})]


def pieces(path: str, plan: dict, extra: dict) -> list:
    n = extra["records"]
    return [(k, min(k + PIECE_ROWS, n)) for k in range(0, n, PIECE_ROWS)] or [(0, 0)]


def rows(path: str, plan: dict, extra: dict, piece):
    wanted, dims = set(plan["wanted"]), "xy" if extra["dims"] == "unknown" else extra["dims"]
    for number, row, raw in records(base_path(path), *piece):
        at, out = 1, []
        for name, letter, width, decimals in extra["fields"]:
            value = _attribute(row[at : at + width], letter, width, decimals) if name in wanted else None
            out.append(float(value) if isinstance(value, int) and not isinstance(value, bool) and not (letter == "N" and decimals == 0 and width >= 10) else value)
            at += width
        shape = parse_shape(raw, dims) if plan["names"][0] in wanted else None
        yield (None if shape is None else wkb.encode(shape), *out, number)


def read(spark: SparkSession, path: str, layer: Layer, options: dict, columns: list[str] | None = None, index: bool = False) -> DataFrame:
    return load(spark, "shp", path, layer, options, columns)


def _field(name: str, kind: str) -> tuple[str, str, int, int]:
    if kind == "boolean":
        return name, "L", 1, 0
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return name, "N", 18, 0
    return (name, "N", 20, 8) if kind in ("float", "double") else (name, "C", 254, 0)


def _cell(value, field: tuple) -> bytes:
    _, letter, width, decimals = field
    if value is None:
        return b"?" if letter == "L" else b" " * width
    if letter == "L":
        return b"T" if value else b"F"
    if letter == "N":
        if isinstance(value, float) and not math.isfinite(value):
            raise EdgeError("DATA_MAPPING", "not a finite number", phase="write")
        if isinstance(value, int) and abs(value) > EXACT:
            raise EdgeError("DATA_MAPPING", "a whole number is beyond what the format keeps", phase="write")
        text = f"{value:.{decimals}f}" if decimals else str(value)
        if len(text) > width:
            raise EdgeError("DATA_MAPPING", "a number is too wide", phase="write")
        return text.rjust(width).encode()
    raw = text_of(value).encode()
    if len(raw) > width:
        raise EdgeError("DATA_MAPPING", "a text is too long", phase="write")
    return raw.ljust(width)


def _oriented(ring: list, outer: bool) -> list:
    if len(ring) < 4 or ring[0] != ring[-1] or ring_area(ring) == 0:
        raise bad("a ring is open or degenerate")
    return ring if (ring_area(ring) < 0) == outer else ring[::-1]


def build_shape(g: Geometry) -> tuple[int, bytes]:
    """Shape code and content of a geometry."""
    if wkb.is_empty(g) or any(not all(map(math.isfinite, p)) for p in wkb.points(g)):
        raise bad("empty or not finite")
    z, m = "z" in g.dims, "m" in g.dims
    code = _CODE[g.kind] + (10 if z else 20 if m else 0)
    if g.kind == "point":
        values = g.content if not z or m else (*g.content, NO_DATA)
        return code, struct.pack(f"<i{len(values)}d", code, *values)
    single = g.kind in ("linestring", "polygon")
    parts = [g] if single else g.content
    if _CODE[g.kind] == 8:
        runs = [[p.content for p in parts]]
    elif _CODE[g.kind] == 3:
        runs = [p.content for p in parts]
    else:
        runs = [_oriented(r, k == 0) for p in parts for k, r in enumerate(p.content)]
    points = np.array([p for r in runs for p in r], float)
    box = [*points[:, :2].min(axis=0), *points[:, :2].max(axis=0)]
    out = [struct.pack("<i4d", code, *box)]
    if _CODE[g.kind] == 8:
        out.append(struct.pack("<i", len(points)))
    else:
        starts = np.cumsum([0, *map(len, runs[:-1])])
        out.append(struct.pack(f"<2i{len(runs)}i", len(runs), len(points), *starts))
    out.append(points[:, :2].astype("<f8").tobytes())
    extra = ([points[:, 2]] if z else []) + ([points[:, -1]] if m else [np.full(len(points), NO_DATA)] if z else [])
    for column in extra:
        out += [struct.pack("<2d", column.min(), column.max()), column.astype("<f8").tobytes()]
    return code, b"".join(out)


def write(spark: SparkSession, frames: list[tuple[Layer, DataFrame]], path: str, options: dict) -> dict:
    """``path`` is a folder that gets data.shp, .shx, .dbf and .prj."""
    layer, df = frames[0]
    g, fields = layer.geometry, [_field(f.name, f.dataType.simpleString()) for f in layer.attributes]
    names = [f.name for f in layer.attributes]
    definition = g.crs.definition or (WGS84_PRJ if g.crs.id == "EPSG:4326" else None)
    if definition is None:
        raise EdgeError("CRS_UNRESOLVED", "the format keeps a definition, and there is none", category="capability", phase="plan")
    kinds = {_CODE[t] for t in g.types}
    dims = g.dimensions if g.dimensions != "unknown" else "xy"
    code = (kinds.pop() if len(kinds) == 1 else 1) + (10 if "z" in dims else 20 if "m" in dims else 0)

    def task(batches):
        os.makedirs(path, exist_ok=True)
        base, n, at = os.path.join(path, "data"), 0, 50
        box = [math.inf, math.inf, -math.inf, -math.inf]
        with open(base + ".shp", "wb") as shp, open(base + ".shx", "wb") as shx, open(base + ".dbf", "wb") as dbf:
            size = 1 + sum(f[2] for f in fields)
            for f in (shp, shx):
                f.write(b"\0" * 100)
            dbf.write(b"\0" * (33 + 32 * len(fields)))
            for row in dicts(batches):
                if row[g.name] is None:
                    raise EdgeError("DATA_MAPPING", "the format needs a geometry in each row", phase="write")
                shape = wkb.decode(row[g.name])
                own, raw = build_shape(shape)
                if own != code:
                    raise EdgeError("DATA_MAPPING", "shapefile.mixed_geometry_type", phase="write")
                for p in wkb.points(shape):
                    box = [min(box[0], p[0]), min(box[1], p[1]), max(box[2], p[0]), max(box[3], p[1])]
                n += 1
                shp.write(struct.pack(">2i", n, len(raw) // 2) + raw)
                shx.write(struct.pack(">2i", at, len(raw) // 2))
                at += 4 + len(raw) // 2
                dbf.write(b" " + b"".join(_cell(row[c], f) for c, f in zip(names, fields)))
            dbf.write(b"\x1a")
            box = box if n else [0.0] * 4
            for f, words in ((shp, at), (shx, 50 + 4 * n)):
                f.seek(0)
                f.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, code, *box, 0, 0, 0, 0))
            dbf.seek(0)
            dbf.write(struct.pack("<4BIHH20x", 3, 126, 1, 1, n, 33 + 32 * len(fields), size))
            for name, letter, width, decimals in fields:
                dbf.write(struct.pack("<11sc4xBB14x", name.encode(), letter.encode(), width, decimals))
            dbf.write(b"\r")
        with open(base + ".prj", "w", encoding="utf-8") as f:
            f.write(definition)
        return {"rows": n}

    return write_one(df, task)
