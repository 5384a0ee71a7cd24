"""GeoPackage through sqlite3: feature tables as layers, read in ranges of rowids, written in one transaction."""

from __future__ import annotations

import math
import sqlite3
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from ..contract import GeometryContract, Layer, geometry_field
from ..crs import Crs, resolved
from ..errors import EdgeError
from ..functions import wkb
from ..plans.loss import LossReport
from .base import dicts, load, write_one

#: Envelope bytes by the header's envelope code; application id and version of the standard.
ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
APPLICATION_ID, USER_VERSION = 0x47504B47, 10300
PIECE_ROWS, RESERVED = 262_144, {"rowid", "_rowid_", "oid"}
_KINDS = {"INTEGER": LongType(), "REAL": DoubleType(), "BLOB": BinaryType(), "TEXT": StringType()}


def strip_header(cell: bytes) -> bytes:
    """The WKB of a stored geometry."""
    if len(cell) < 8 or cell[:2] != b"GP":
        raise EdgeError("INVALID_GEOMETRY", "not a stored geometry")
    envelope = ENVELOPES.get(cell[3] >> 1 & 7)
    if envelope is None or len(cell) < 8 + envelope:
        raise EdgeError("INVALID_GEOMETRY", "unknown envelope")
    return cell[8 + envelope :]


def with_header(cell: bytes, srs_id: int) -> bytes:
    """A stored geometry without an envelope."""
    empty = wkb.is_empty(wkb.decode(cell))
    return b"GP\x00" + bytes([1 | (16 if empty else 0)]) + struct.pack("<i", srs_id) + cell


def _open(path: str) -> sqlite3.Connection:
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    db.text_factory = lambda b: b.decode("utf-8")
    return db


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _storage(declared: str) -> str:
    d = (declared or "").upper()
    if "INT" in d or d in ("BOOLEAN", "BOOL"):
        return "INTEGER"
    return "REAL" if "REAL" in d or "FLOA" in d or "DOUB" in d else "BLOB" if "BLOB" in d else "TEXT"


def _crs(db: sqlite3.Connection, srs_id: int) -> Crs:
    row = db.execute("SELECT organization, organization_coordsys_id, definition FROM gpkg_spatial_ref_sys WHERE srs_id = ?", (srs_id,)).fetchone()
    if row is None or row[0].upper() == "NONE":
        return Crs("declared", None, row[2] if row else None)
    return resolved(f"{row[0]}:{row[1]}", row[2] if row[2] and row[2] != "undefined" else None)


def describe(spark: SparkSession, path: str, options: dict) -> list[Layer]:
    layers = []
    with _open(path) as db:
        found = db.execute(
            "SELECT c.table_name, g.column_name, g.geometry_type_name, g.srs_id, g.z, g.m FROM gpkg_contents c "
            "JOIN gpkg_geometry_columns g ON c.table_name = g.table_name WHERE c.data_type = 'features' ORDER BY c.table_name"
        ).fetchall()
        for number, (name, column, kind, srs_id, z, m) in enumerate(found):
            fields, key = [], None
            for _, field, declared, _, _, pk in db.execute(f"PRAGMA table_info({_quoted(name)})"):
                if pk:
                    key = field
                elif field == column:
                    kinds = (kind.lower(),) if kind.lower() in wkb.CODES else ()
                    dims = "unknown" if 2 in (z, m) else wkb.DIMENSIONS[bool(z) + 2 * bool(m)]
                    fields.append(geometry_field(GeometryContract(field, _crs(db, srs_id), True, "wkb", dims, types=kinds, declaration="exact" if kinds else "unresolved")))
                else:
                    fields.append(StructField(field, _KINDS[_storage(declared)], True))
            if any(f.name.lower() in RESERVED for f in fields):
                raise EdgeError("UNSUPPORTED", "a column hides the row number", category="capability", phase="open")
            rtree = db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (f"rtree_{name}_{column}",)).fetchone()
            n = db.execute(f"SELECT count(*) FROM {_quoted(name)}").fetchone()[0]
            layers.append(Layer(number, name, StructType(fields), {"geometry": column, "key": key, "rows": n, "rtree": bool(rtree and db.execute("SELECT 1 FROM sqlite_master WHERE name = 'gpkg_extensions'").fetchone())}))
    return layers


def pieces(path: str, plan: dict, extra: dict) -> list:
    """Ranges of rowids, from the smallest on, below zero too."""
    with _open(path) as db:
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(plan['layer'])}").fetchone()
    if low is None:
        return [(0, -1)]
    return [(k, min(k + PIECE_ROWS - 1, high)) for k in range(low, high + 1, PIECE_ROWS)]


def coerce(value, kind: str) -> tuple[object, str | None]:
    """A stored value in its column's type, and the loss it meant, if any."""
    if value is None:
        return None, None
    if kind == "INTEGER":
        if isinstance(value, float):
            if not math.isfinite(value):
                return None, "non_finite_to_null"
            whole = max(-(1 << 63), min((1 << 63) - 1, int(value)))
            return whole, None if whole == value else "real_truncated_to_integer"
        return (value, None) if isinstance(value, int) else (None, "value_of_other_type_to_null")
    if kind == "REAL":
        if isinstance(value, int):
            return float(value), "integer_beyond_double" if abs(value) >= 1 << 53 else None
        if isinstance(value, float):
            return (value, None) if math.isfinite(value) else (None, "non_finite_to_null")
        return None, "value_of_other_type_to_null"
    if kind == "BLOB":
        return (value, None) if isinstance(value, bytes) else (str(value).encode(), "value_of_other_type_to_bytes")
    return (None, "bytes_to_null") if isinstance(value, bytes) else (value if isinstance(value, str) else str(value), None)


_CLASS_OF = {"bigint": "INTEGER", "double": "REAL", "binary": "BLOB", "string": "TEXT"}


def rows(path: str, plan: dict, extra: dict, piece):
    """Keyset pages of one range. A box prunes through a registered R-tree and may let more through than it holds."""
    wanted, names, table = set(plan["wanted"]), plan["names"][:-1], plan["layer"]
    with _open(path) as db:
        kinds = {f: _storage(d) for _, f, d, *_ in db.execute(f"PRAGMA table_info({_quoted(table)})")}
        columns = ", ".join(f"t.{_quoted(n)}" if n in wanted else "NULL" for n in names)
        box = [float(v) for v in str(plan.get("bbox") or "").split(",") if v]
        where, args = "", []
        if len(box) == 4 and extra.get("rtree") and all(map(math.isfinite, box)) and box[0] <= box[2] and box[1] <= box[3]:
            tree = _quoted(f"rtree_{table}_{extra['geometry']}")
            where = f" AND (t.{_quoted(extra['geometry'])} IS NULL OR t.rowid IN (SELECT id FROM {tree} WHERE minx <= ? AND maxx >= ? AND miny <= ? AND maxy >= ?) OR t.rowid NOT IN (SELECT id FROM {tree}))"
            args = [box[2], box[0], box[3], box[1]]
        at, last = piece
        while at <= last:
            page = db.execute(f"SELECT t.rowid, {columns} FROM {_quoted(table)} t WHERE t.rowid >= ? AND t.rowid <= ?{where} ORDER BY t.rowid LIMIT 8192", (at, last, *args)).fetchall()
            for rowid, *values in page:
                out = []
                for n, v in zip(names, values):
                    out.append((None if v is None else strip_header(v)) if n == extra["geometry"] else coerce(v, kinds[n])[0])
                yield (*out, None)
            if len(page) < 8192:
                return
            at = page[-1][0] + 1


def losses(path: str, layer: Layer) -> LossReport:
    """What reading the layer's attributes loses, by category and field."""
    report = LossReport()
    with _open(path) as db:
        for f in layer.attributes:
            kind = _CLASS_OF[f.dataType.simpleString()]
            for (value,) in db.execute(f"SELECT {_quoted(f.name)} FROM {_quoted(layer.name)}"):
                category = coerce(value, kind)[1]
                if category:
                    report.add(category, f.name)
    return report


def read(spark: SparkSession, path: str, layer: Layer, options: dict, columns: list[str] | None = None, index: bool = False) -> DataFrame:
    return load(spark, "gpkg", path, layer, options, columns)


def cell_in(value, kind: str):
    """A value as it is stored: whole numbers exactly, truth as 0 or 1."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float) and not math.isfinite(value):
        raise EdgeError("DATA_MAPPING", "not a finite number", phase="write")
    if kind.startswith("decimal"):
        value = int(value)
    if isinstance(value, int) and not -(1 << 63) <= value < 1 << 63:
        raise EdgeError("DATA_MAPPING", "a whole number does not fit", phase="write")
    return value


_TABLES = (
    "CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)",
    "CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change TEXT DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x REAL, min_y REAL, max_x REAL, max_y REAL, srs_id INTEGER)",
    "CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z INTEGER NOT NULL, m INTEGER NOT NULL, PRIMARY KEY (table_name, column_name))",
    "INSERT INTO gpkg_spatial_ref_sys VALUES ('Undefined Cartesian', -1, 'NONE', -1, 'undefined', NULL), ('Undefined geographic', 0, 'NONE', 0, 'undefined', NULL)",
)
_DECLARED = {"boolean": "BOOLEAN", "tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "float": "REAL", "double": "REAL", "binary": "BLOB", "string": "TEXT"}


def _create(db: sqlite3.Connection, layer: Layer) -> int:
    g = layer.geometry
    authority, _, code = g.crs.id.partition(":")
    srs_id = int(code)
    if not db.execute("SELECT 1 FROM gpkg_spatial_ref_sys WHERE srs_id = ?", (srs_id,)).fetchone():
        db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, NULL)", (g.crs.id, srs_id, authority, srs_id, g.crs.definition or "undefined"))
    kind = g.types[0].upper() if len(g.types) == 1 and g.declaration == "exact" else "GEOMETRY"
    columns = [f"{_quoted(f.name)} {kind if f.name == g.name else _DECLARED.get(f.dataType.simpleString(), 'INTEGER')}" for f in layer.schema.fields]
    key = "fid"
    while key in {f.name.lower() for f in layer.schema.fields}:
        key = "_" + key
    db.execute(f"CREATE TABLE {_quoted(layer.name)} ({_quoted(key)} INTEGER PRIMARY KEY AUTOINCREMENT, {', '.join(columns)})")
    z, m = (2, 2) if g.dimensions == "unknown" else (int("z" in g.dimensions), int("m" in g.dimensions))
    db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (layer.name, layer.name, srs_id))
    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, ?, ?, ?, ?)", (layer.name, g.name, kind, srs_id, z, m))
    return srs_id


def write(spark: SparkSession, frames: list[tuple[Layer, DataFrame]], path: str, options: dict) -> dict:
    """A task for each layer, one after the other, each in one transaction."""
    with sqlite3.connect(path) as db:
        db.execute(f"PRAGMA application_id = {APPLICATION_ID}")
        db.execute(f"PRAGMA user_version = {USER_VERSION}")
        for statement in _TABLES:
            db.execute(statement)
    total = 0
    for layer, df in frames:
        g, kinds = layer.geometry, {f.name: f.dataType.simpleString() for f in layer.schema.fields}

        def task(batches, layer=layer, g=g, kinds=kinds):
            with sqlite3.connect(path) as db:
                db.execute("BEGIN")
                db.execute("DELETE FROM gpkg_geometry_columns WHERE table_name = ?", (layer.name,))
                db.execute("DELETE FROM gpkg_contents WHERE table_name = ?", (layer.name,))
                db.execute(f"DROP TABLE IF EXISTS {_quoted(layer.name)}")  # of a task that was lost
                srs_id = _create(db, layer)
                names, n = list(kinds), 0
                insert = f"INSERT INTO {_quoted(layer.name)} ({', '.join(map(_quoted, names))}) VALUES ({', '.join('?' * len(names))})"

                def stored():
                    nonlocal n
                    for row in dicts(batches):
                        n += 1
                        yield [None if row[c] is None else with_header(row[c], srs_id) if c == g.name else cell_in(row[c], kinds[c]) for c in names]

                db.executemany(insert, stored())
                return {"rows": n}

        total += write_one(df, task)["rows"]
    return {"rows": total}
