"""Queries over the finer operators: drawings, coercions, faults, limits, diagnostics, plans; and their DuckDB texts."""

from __future__ import annotations

import math
import os
import sqlite3
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .contract import GeometryContract, with_geometry
from .crs import CRS84, resolved
from .dataset import ReadRequest, open_dataset
from .errors import EdgeError, exit_code
from .functions import curves
from .functions.udfs import wkb_bbox, wkb_inspect, wkb_to_ewkb, wkb_to_wkt, wkt_to_wkb
from .limits import Limits, next_batch_rows
from .operators.infer import CLASSES, lattice, value_class
from .operators.prune import parse_predicate
from .operators.validate import geometry_types
from .plans.catalog import format_of
from .plans.convert import convert, loss_frame, write_dataset
from .plans.loss import Fidelity, end_to_end
from .queries import _WKT, _WKT_SQUARE, EPSG, _broken, as_text, customers, points, squares, suppliers, table, work


def _pairs(*parts) -> str:
    """Group codes and values of a drawing, one to a line."""
    return "".join(f"{x}\n" for x in parts)


def _drawing(spark, text: str, blocks: str = ""):
    path = os.path.join(work(spark), "d.dxf")
    body = (_pairs(0, "SECTION", 2, "BLOCKS") + blocks + _pairs(0, "ENDSEC") if blocks else "") + _pairs(0, "SECTION", 2, "ENTITIES") + text + _pairs(0, "ENDSEC", 0, "EOF")
    with open(path, "w") as f:
        f.write(body)
    return open_dataset(spark, path, assume_crs="EPSG:4326").read()


def dxf_entities(spark, sf_dir):
    """A line for each nation, a circle for each region, and one each of arc, ellipse, spline and bulged polyline, by their bounds."""
    text = ""
    for r in table(spark, sf_dir, "nation").collect():
        text += _pairs(0, "LINE", 8, "a", 10, r.n_nationkey, 20, r.n_regionkey, 11, r.n_nationkey + 1, 21, r.n_regionkey + 2)
    for r in table(spark, sf_dir, "region").collect():
        text += _pairs(0, "CIRCLE", 8, "a", 10, r.r_regionkey, 20, 0, 40, r.r_regionkey + 1)
    text += _pairs(0, "ARC", 8, "a", 10, 0, 20, 0, 40, 2, 50, 0, 51, 90)
    text += _pairs(0, "ELLIPSE", 8, "a", 10, 0, 20, 0, 11, 3, 21, 0, 40, 0.5, 41, 0, 42, math.tau)
    text += _pairs(0, "SPLINE", 8, "a", 71, 1, 40, 0, 40, 0, 40, 1, 40, 1, 10, 0, 20, 0, 30, 0, 10, 5, 20, 1, 30, 0)
    text += _pairs(0, "LWPOLYLINE", 8, "a", 90, 2, 70, 0, 10, 0, 20, 0, 42, 1, 10, 2, 20, 0)
    df = _drawing(spark, text).select("dxf_type", wkb_bbox("geometry").alias("b"))
    side = lambda f, n: F.round(f(f"b.{n}"), 6) + 0.0
    return df.groupBy(F.col("dxf_type")).agg(F.count(F.lit(1)).alias("n"), side(F.min, "minx").alias("minx"), side(F.max, "maxx").alias("maxx"), side(F.min, "miny").alias("miny"), side(F.max, "maxy").alias("maxy"))


def dxf_insert(spark, sf_dir):
    """A block of one line, inserted for each nation at its place, turned by a right angle, twice as large; one block seen from below."""
    blocks = _pairs(0, "BLOCK", 2, "B", 10, 0, 20, 0, 0, "LINE", 8, 0, 10, 0, 20, 0, 11, 1, 21, 0, 0, "ENDBLK")
    text = ""
    for r in table(spark, sf_dir, "nation").collect():
        text += _pairs(0, "INSERT", 2, "B", 8, f"n{r.n_nationkey}", 10, r.n_nationkey, 20, r.n_regionkey, 41, 2, 42, 2, 50, 90)
    df = _drawing(spark, text, blocks).select(F.col("layer"), wkb_bbox("geometry").alias("b"))
    return df.select("layer", *((F.round(f"b.{n}", 6) + 0.0).alias(n) for n in ("minx", "miny", "maxx", "maxy")))


def tessellation(spark, sf_dir):
    """Points and ends of curves: whole circles, arcs over zero, half-circle bulges, straight and closed ones."""
    cases = {
        "circle": curves.circle((1.0, 2.0), 3.0), "no radius": curves.circle((0.0, 0.0), 0.0), "over zero": curves.arc((0.0, 0.0), 1.0, 350.0, 10.0), "full arc": curves.arc((0.0, 0.0), 1.0, 0.0, 0.0),
        "bulge": curves.bulge((0.0, 0.0), (2.0, 0.0), 1.0), "straight": curves.bulge((0.0, 0.0), (2.0, 0.0), 0.0), "ellipse": curves.ellipse((0.0, 0.0, 0.0), (2.0, 0.0, 0.0), (0.0, 0.0, 1.0), 0.5, 0.0, math.tau),
        "spline": curves.spline(1, [0.0, 0.0, 1.0, 1.0], [(0.0, 0.0, 0.0), (4.0, 2.0, 0.0)], [1.0, 1.0]),
    }
    rows = [(k, len(p), *((round(p[0][0], 6) + 0.0, round(p[-1][0], 6) + 0.0) if p else (None, None))) for k, p in cases.items()]
    return spark.createDataFrame(rows, "curve string, points int, first_x double, last_x double")


def object_coordinates(spark, sf_dir):
    """Object axes by the arbitrary axis rule, and a scaled, turned and moved point."""
    rows = [(f"axes {n}", *(round(float(v), 6) + 0.0 for v in (curves.object_axes(n)[:3, :3] @ np.array([1.0, 2.0, 3.0])))) for n in ((0, 0, 1), (0, 0, -1), (1, 0, 0), (0, 0, 0))]
    rows.append(("insertion", *(round(v, 6) + 0.0 for v in curves.moved([(1.0, 0.0)], curves.insertion((10.0, 20.0, 5.0), 90.0, (2.0, 0.0, 1.0)))[0])))
    return spark.createDataFrame(rows, "what string, x double, y double, z double")


def _supplier_package(spark, sf_dir) -> str:
    path = os.path.join(work(spark), "s.gpkg")
    write_dataset(spark, {"layer": suppliers(spark, sf_dir)}, path)
    return path


def gpkg_rtree(spark, sf_dir):
    """A box read through a registered R-tree that lacks every tenth row: rows that it does not know stay."""
    path = _supplier_package(spark, sf_dir)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL)")
        db.execute("INSERT INTO gpkg_extensions VALUES ('layer', 'geometry', 'gpkg_rtree_index', 'http://www.geopackage.org/spec120/#extension_rtree', 'write-only')")
        db.execute("CREATE VIRTUAL TABLE rtree_layer_geometry USING rtree(id, minx, maxx, miny, maxy)")
        db.execute("INSERT INTO rtree_layer_geometry SELECT rowid, id, id, nation, nation FROM layer WHERE id % 10 <> 0")
    return open_dataset(spark, path).read(ReadRequest(bbox=(5.0, 3.0, 60.0, 12.0))).select("id", "name")


def gpkg_coercions(spark, sf_dir):
    """What reading loses where a whole-number column holds other values: beyond 64 bits, fractions, infinities, text, bytes."""
    path = _supplier_package(spark, sf_dir)
    with sqlite3.connect(path) as db:
        for k, value in enumerate(("1e300", "nation + 0.25", "9e999", "'a word'", "x'00ff'", "nation * 1.0")):
            db.execute(f"UPDATE layer SET nation = {value} WHERE id % 7 = {k}")
    return loss_frame(spark, open_dataset(spark, path).losses())


def gpkg_coerced_values(spark, sf_dir):
    """The values that such a column gives: saturated, cut, null."""
    path = _supplier_package(spark, sf_dir)
    with sqlite3.connect(path) as db:
        for k, value in enumerate(("1e300", "nation + 0.25", "9e999", "'a word'", "-1e300")):
            db.execute(f"UPDATE layer SET nation = {value} WHERE id % 7 = {k}")
    return open_dataset(spark, path).read(ReadRequest(columns=("id", "nation"))).select("id", F.coalesce(F.col("nation").cast("string"), F.lit("null")).alias("nation"))


def shp_ring_faults(spark, sf_dir):
    """Why polygons are refused: faults are looked for in order, whichever ring has them; rings close by x and y alone."""
    outer, inner = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    cases = {
        "good": [outer, inner], "open": [outer[:-1]], "flat": [[(0, 0), (1, 1), (2, 2), (0, 0)]], "short": [[(0, 0), (1, 1), (0, 0)]], "hole first": [inner, outer],
        "hole only": [inner], "flat and open": [[(0, 0), (1, 1), (2, 2), (0, 0)], outer[:-1]], "none": [], "not a number": [[(0, 0), (math.nan, 1), (2, 2), (0, 0)]],
    }

    def shape(rings):
        flat = [float(v) for r in rings for p in r for v in p]
        starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
        return struct.pack(f"<i4d2i{len(rings)}i{len(flat)}d", 5, 0, 0, 4, 4, len(rings), len(flat) // 2, *starts, *flat)

    def judged(batches):
        from .sources.shapefile import parse_shape

        for batch in batches:
            said = []
            for raw in batch.column(1).to_pylist():
                try:
                    parse_shape(raw, "xy")
                    said.append("accepted")
                except EdgeError as error:
                    said.append(error.message)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], ["polygon", "verdict"])

    return spark.createDataFrame([(k, bytearray(shape(r))) for k, r in cases.items()], "polygon string, shape binary").mapInArrow(judged, "polygon string, verdict string")


def wkb_faults(spark, sf_dir):
    """Cells of parts, cut short, lengthened, of an unknown kind or order, by what structural inspection says of them."""
    k, g = F.col("p_partkey") % 6, F.col("geometry")
    tail = F.lit(bytearray(b"\x00")).cast("binary")
    code = F.lit(bytearray(struct.pack("<BI", 1, 99))).cast("binary")
    cell = F.when(k == 0, F.substring(g, 1, 30)).when(k == 1, F.concat(g, tail)).when(k == 2, code).when(k == 3, F.concat(F.lit(bytearray(b"\x07")).cast("binary"), g)).when(k == 4, F.lit(bytearray()).cast("binary")).otherwise(g)
    found = squares(table(spark, sf_dir, "part")).select(wkb_inspect(cell).alias("i"))
    return found.groupBy(F.col("i.valid").alias("valid"), F.col("i.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_SHAPES = (
    "POINT(1 2)", "POINT Z(1 2 3)", "POINT M(1 2 3)", "POINT ZM(1 2 3 4)", "LINESTRING(0 0,1.5 -2)", "LINESTRING Z(0 0 1,1 1 2)", "POLYGON((0 0,4 0,4 4,0 0),(1 1,2 1,2 2,1 1))", "MULTIPOINT((0 0),(1 1))",
    "MULTILINESTRING((0 0,1 1),(2 2,3 3))", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))", "GEOMETRYCOLLECTION(POINT(1 2),LINESTRING(0 0,1 1))",
)


def wkt_kinds(spark, sf_dir):
    """Every kind of shape, from text to bytes and back, with its structure."""
    df = spark.createDataFrame([(s,) for s in _SHAPES], "given string")
    cell = wkt_to_wkb("given")
    return df.select("given", wkb_to_wkt(cell).alias("back"), wkb_inspect(cell)["dims"].alias("dims"))


def ewkb_srid(spark, sf_dir):
    """Points with an SRID in their bytes, as inspection tells."""
    found = customers(spark, sf_dir).select(wkb_inspect(wkb_to_ewkb("geometry", F.lit(4326).cast("long"))).alias("i"))
    return found.groupBy(F.col("i.srid").alias("srid"), F.col("i.contains_srid").alias("contains_srid"), F.col("i.valid").alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def kml_polygons(spark, sf_dir):
    """Squares through KML, holes and all dimensions being other tests' matter."""
    own = squares(table(spark, sf_dir, "part").select("p_partkey", "p_size"), resolved(CRS84)).select("geometry", F.col("p_partkey").cast("string").alias("name"))
    own = with_geometry(own, GeometryContract("geometry", resolved(CRS84), dimensions="xy", types=("polygon",), declaration="exact"))
    path = os.path.join(work(spark), "p.kml")
    write_dataset(spark, {"p": own}, path)
    return as_text(open_dataset(spark, path, unlimited=True).read()).select("name", "geometry")


def geometry_types_found(spark, sf_dir):
    """Distinct kinds and dimensions of a column of several."""
    x = F.col("p_partkey")
    shape = F.when(x % 3 == 0, F.format_string("POINT(%d 0)", x)).when(x % 3 == 1, F.format_string("LINESTRING Z(0 0 1,%d 1 2)", x)).otherwise(F.format_string("MULTIPOINT((%d 1),(3 4))", x))
    return spark.createDataFrame(geometry_types(table(spark, sf_dir, "part").select(wkt_to_wkb(shape).alias("g")), "g"), "kind string, dims string")


def accepted_rows(spark, sf_dir):
    """Reads that stop once enough rows are there: whole batches, so more may be read than asked for."""
    path, rows = os.path.join(work(spark), "c.parquet"), []
    write_dataset(spark, {"c": customers(spark, sf_dir)}, path)
    data = open_dataset(spark, path)
    for limit in (None, 0, 1, 100, 1_000_000):
        found = data.read_summary(ReadRequest(limit=limit, batch_rows=64))
        rows.append((-1 if limit is None else limit, found["rows_read"], found["batches"], found["truncated"]))
    return spark.createDataFrame(rows, "asked long, rows_read long, batches long, truncated boolean")


def source_index(spark, sf_dir):
    """Rows' places in their files, formats that number them."""
    out = None
    for name, crs in (("s.geojson", resolved(CRS84)), ("s.arrow", EPSG), ("s.parquet", EPSG)):
        path = os.path.join(work(spark), name)
        write_dataset(spark, {"s": suppliers(spark, sf_dir, crs).coalesce(1).sortWithinPartitions("id")}, path)
        got = open_dataset(spark, path).read(ReadRequest(source_index=True)).select(F.lit(name).alias("file"), F.col("_source_row").alias("row"), "id")
        out = got if out is None else out.unionByName(got)
    return out


def diagnostic_keys(spark, sf_dir):
    """Examples that name rows by a key, shown or hidden, and the counts that they belong to."""
    from .operators.validate import diagnose

    rows, df = [], _broken(spark, sf_dir)
    for policy in ("emit", "redact"):
        found = diagnose(df, index="p_partkey", examples=4, key_field="p_partkey", key_policy=policy)
        rows += [(policy, e["row"], e["cause"], e["key"], found.total) for e in found.examples]
    return spark.createDataFrame(rows, "policy string, row long, cause string, key string, total long")


def refusals(spark, sf_dir):
    """What is refused, with the code and exit status of each."""
    folder, few = work(spark), suppliers(spark, sf_dir)
    write_dataset(spark, {"s": few}, f"{folder}/s.csv")
    for name in ("s.gpkg", "s.arrow", "s.parquet", "s.shp.d", "s.xlsx"):
        write_dataset(spark, {"s": few}, f"{folder}/{name}")
    write_dataset(spark, {"s": suppliers(spark, sf_dir, resolved(CRS84))}, f"{folder}/s.geojson")
    with open(f"{folder}/ragged.csv", "w") as f:
        f.write("a,geometry\n1,POINT(1 2)\n2\n")
    with open(f"{folder}/b.geojson", "w") as f:
        f.write('{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": null, "properties": {"a": 1, "a": 2}}]}')
    one, own = Limits(max_rows=1), {"wkt_column": "geometry"}
    cases = {
        "no geometry column named": lambda: open_dataset(spark, f"{folder}/s.csv"), "no crs": lambda: open_dataset(spark, f"{folder}/s.csv", **own), "no such column": lambda: open_dataset(spark, f"{folder}/s.csv", wkt_column="x", assume_crs="EPSG:4326"),
        "unknown format": lambda: open_dataset(spark, f"{folder}/s.tif"), "ragged rows": lambda: open_dataset(spark, f"{folder}/ragged.csv", **_WKT), "a key twice": lambda: open_dataset(spark, f"{folder}/b.geojson"),
        "target exists": lambda: write_dataset(spark, {"s": few}, f"{folder}/s.gpkg"), "wrong total": lambda: write_dataset(spark, {"s": few}, f"{folder}/t.gpkg", expected_rows={"s": 1}),
        "no such layer": lambda: open_dataset(spark, f"{folder}/s.gpkg").layer("x"), "unknown field": lambda: open_dataset(spark, f"{folder}/s.parquet").read(ReadRequest(columns=("x",))),
        "no projection": lambda: open_dataset(spark, f"{folder}/s.xlsx", **_WKT).read(ReadRequest(columns=("id",))), "two layers in one": lambda: convert(spark, f"{folder}/s.gpkg", f"{folder}/s.kml"),
        **{f"rows of {n}": (lambda n=n: open_dataset(spark, f"{folder}/{n}", one, **(_WKT if n == "s.csv" else {}))) for n in ("s.csv", "s.geojson", "s.gpkg", "s.arrow", "s.parquet", "s.shp.d")},
        "rows of s.xlsx": lambda: open_dataset(spark, f"{folder}/s.xlsx", one, **_WKT).read().count(),
    }
    rows = []
    for name, f in cases.items():
        try:
            f()
            rows.append((name, "accepted", 0))
        except EdgeError as error:
            rows.append((name, error.code, exit_code(error)))
        except Exception as error:  # noqa: BLE001  (raised within a task)
            rows.append((name, "LIMIT" if "LIMIT" in str(error) else type(error).__name__, 7))
    return spark.createDataFrame(rows, "attempt string, code string, status int")


def format_router(spark, sf_dir):
    rows = []
    for name in ("a.csv", "a.CSV", "a.json", "a.geojson", "a.parquet", "a.gpkg", "A/B.SHP.D", "a.shp", "a.kml", "a.xlsx", "a.dxf", "a.arrow", "a.gdb", "a.tif", "a"):
        try:
            rows.append((name, format_of(name).id))
        except EdgeError as error:
            rows.append((name, error.code))
    return spark.createDataFrame(rows, "path string, format string")


def infer_lattice(spark, sf_dir):
    """The type of every set of cell classes."""
    sets = [[c for k, c in enumerate(CLASSES) if n >> k & 1] for n in range(1 << len(CLASSES))]
    return spark.createDataFrame([(n, lattice(set(s))) for n, s in enumerate(sets)], "classes int, type string")


def infer_values(spark, sf_dir):
    """Classes of parsed values."""
    cases = [("null", None), ("true", True), ("one", 1), ("2^53", 1 << 53), ("2^53 + 1", (1 << 53) + 1), ("2^64", 1 << 64), ("half", 0.5), ("not a number", math.nan), ("word", "x"), ("list", [1])]
    return spark.createDataFrame([(n, value_class(v)) for n, v in cases], "value string, class string")


def predicate_hints(spark, sf_dir):
    rows = []
    for text in ("a >= 1", "b<2.5", "c == -3", "d = 1e3", "e > ", "f LIKE 1", "g >= x", "1 < 2 < 3", " h <= .5 "):
        found = parse_predicate(text)
        rows.append((text, found.field if found else None, found.op if found else None, float(found.value) if found else None))
    return spark.createDataFrame(rows, "hint string, field string, op string, value double")


def adaptive_batches(spark, sf_dir):
    """Rows of the next batch, from the bytes that the last one took."""
    cases = [(100, 1000, 10_000), (100, 100_000, 10_000), (100, 0, 10_000), (10, 10_000_000, 100), (65_536, 1, 1 << 30)]
    return spark.createDataFrame([(*c, next_batch_rows(*c)) for c in cases], "rows int, observed long, target long, next_rows int")


def fidelity_end_to_end(spark, sf_dir):
    levels = ("lossless", "conditional", "approximating")
    return spark.createDataFrame([(a, b, end_to_end(Fidelity(a), Fidelity(b)).level) for a in levels for b in levels], "source string, target string, level string")


def vertex_counts(spark, sf_dir):
    """Bytes of points written by arrays and by hand, which must be the same."""
    @arrow_udf("string")
    def text(cells: pa.Array) -> pa.Array:
        from .functions import wkb, wkt

        return pa.array([wkt.format(wkb.decode(c)) for c in cells.to_pylist()], pa.string())

    df = points(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")
    return df.where("o_orderkey % 50 = 0").select("o_orderkey", text("geometry").alias("wkt"))


def _values(names: str, rows: list[tuple]) -> str:
    word = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(word, r)) + ')' for r in rows)}) t({names})"


_BITS = {c: 1 << k for k, c in enumerate(CLASSES)}
_HAS = lambda c: f"(n & {_BITS[c]}) <> 0"

QUERIES = {f.__name__: f for f in (
    dxf_entities, dxf_insert, tessellation, object_coordinates, gpkg_rtree, gpkg_coercions, gpkg_coerced_values, shp_ring_faults, wkb_faults, wkt_kinds, ewkb_srid, kml_polygons, geometry_types_found, accepted_rows,
    source_index, diagnostic_keys, refusals, format_router, infer_lattice, infer_values, predicate_hints, adaptive_batches, fidelity_end_to_end, vertex_counts,
)}
ORACLE_SQL = {
    "dxf_entities": """
        SELECT 'LINE' AS dxf_type, count(*) AS n, CAST(min(n_nationkey) AS DOUBLE) AS minx, CAST(max(n_nationkey) + 1 AS DOUBLE) AS maxx, CAST(min(n_regionkey) AS DOUBLE) AS miny, CAST(max(n_regionkey) + 2 AS DOUBLE) AS maxy FROM nation
        UNION ALL SELECT 'CIRCLE', count(*), CAST(min(-1) AS DOUBLE), CAST(max(2 * r_regionkey + 1) AS DOUBLE), CAST(-max(r_regionkey + 1) AS DOUBLE), CAST(max(r_regionkey + 1) AS DOUBLE) FROM region
        UNION ALL VALUES ('ARC', 1, 0.0, 2.0, 0.0, 2.0), ('ELLIPSE', 1, -3.0, 3.0, -1.5, 1.5), ('SPLINE', 1, 0.0, 5.0, 0.0, 1.0), ('LWPOLYLINE', 1, 0.0, 2.0, -1.0, 0.0)""",
    "dxf_insert": "SELECT 'n' || n_nationkey AS layer, CAST(n_nationkey AS DOUBLE) AS minx, CAST(n_regionkey AS DOUBLE) AS miny, CAST(n_nationkey AS DOUBLE) AS maxx, CAST(n_regionkey + 2 AS DOUBLE) AS maxy FROM nation",
    "tessellation": "SELECT curve, CAST(points AS INTEGER) AS points, CAST(first_x AS DOUBLE) AS first_x, CAST(last_x AS DOUBLE) AS last_x FROM (" + _values("curve, points, first_x, last_x", [
        ("circle", 25, 4.0, 4.0), ("no radius", 0, None, None), ("over zero", 2, 0.984808, 0.984808), ("full arc", 25, 1.0, 1.0), ("bulge", 11, 0.034074, 1.965926), ("straight", 0, None, None), ("ellipse", 25, 2.0, 2.0), ("spline", 12, 0.0, 4.0)]) + ")",
    "object_coordinates": "SELECT what, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM (" + _values("what, x, y, z", [("axes (0, 0, 1)", 1, 2, 3), ("axes (0, 0, -1)", -1, 2, -3), ("axes (1, 0, 0)", 3, 1, 2), ("axes (0, 0, 0)", 1, 2, 3), ("insertion", 10, 22, 5)]) + ")",
    "gpkg_rtree": "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 10 = 0 OR (s_suppkey BETWEEN 5 AND 60 AND s_nationkey BETWEEN 3 AND 12)",
    "gpkg_coercions": """
        SELECT category, count(*) AS n FROM (SELECT CASE s_suppkey % 7 WHEN 0 THEN 'real_truncated_to_integer' WHEN 1 THEN 'real_truncated_to_integer' WHEN 2 THEN 'non_finite_to_null'
            WHEN 3 THEN 'value_of_other_type_to_null' WHEN 4 THEN 'value_of_other_type_to_null' END AS category FROM supplier) WHERE category IS NOT NULL GROUP BY category""",
    "gpkg_coerced_values": """
        SELECT s_suppkey AS id, CASE s_suppkey % 7 WHEN 0 THEN '9223372036854775807' WHEN 2 THEN 'null' WHEN 3 THEN 'null' WHEN 4 THEN '-9223372036854775808' ELSE CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier""",
    "shp_ring_faults": _values("polygon, verdict", [
        ("good", "accepted"), ("open", "shapefile.unclosed_ring"), ("flat", "shapefile.degenerate_ring"), ("short", "shapefile.degenerate_ring"), ("hole first", "shapefile.inner_before_outer"),
        ("hole only", "shapefile.inner_before_outer"), ("flat and open", "shapefile.unclosed_ring"), ("none", "shapefile.no_outer_ring"), ("not a number", "shapefile.degenerate_ring")]),
    "wkb_faults": "SELECT p_partkey % 6 = 5 AS valid, CASE WHEN p_partkey % 6 = 5 THEN 'polygon' END AS kind, count(*) AS n FROM part GROUP BY 1, 2",
    "wkt_kinds": _values("given, back, dims", [(s, s, {"Z(": "xyz", "M(": "xym", "ZM": "xyzm"}.get(s.partition(" ")[2][:2], "xy") if " " in s.partition("(")[0] else "xy") for s in _SHAPES]),
    "ewkb_srid": "SELECT CAST(4326 AS BIGINT) AS srid, true AS contains_srid, true AS valid, count(*) AS n FROM customer",
    "kml_polygons": f"SELECT CAST(p_partkey AS VARCHAR) AS name, {_WKT_SQUARE} AS geometry FROM part",
    "geometry_types_found": _values("kind, dims", [("linestring", "xyz"), ("multipoint", "xy"), ("point", "xy")]),
    "accepted_rows": """
        SELECT CAST(coalesce(asked, -1) AS BIGINT) AS asked, CASE WHEN asked = 0 THEN 0 WHEN asked IS NULL OR least(n, ceil(asked / 64) * 64) = n THEN n ELSE CAST(ceil(asked / 64) * 64 AS BIGINT) END AS rows_read,
            CASE WHEN asked = 0 THEN 0 WHEN asked IS NULL OR ceil(asked / 64) * 64 >= n THEN CAST(ceil(n / 64) AS BIGINT) ELSE CAST(ceil(asked / 64) AS BIGINT) END AS batches, coalesce(asked = 0 OR ceil(asked / 64) * 64 < n, false) AS truncated
        FROM (SELECT count(*) AS n FROM customer), (VALUES (NULL), (0), (1), (100), (1000000)) a(asked)""",
    "source_index": "SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY s_suppkey) - 1 AS BIGINT) AS row, s_suppkey AS id FROM supplier, (VALUES ('s.geojson'), ('s.arrow'), ('s.parquet')) f(file)",
    "diagnostic_keys": """
        WITH v AS (SELECT p_partkey AS row, CASE WHEN p_partkey % 11 = 0 THEN 'contract.nullability' WHEN p_partkey % 7 = 0 THEN 'conversion.invalid_geometry' WHEN p_partkey % 5 = 0 THEN 'contract.geometry_type' END AS cause FROM part),
        bad AS (SELECT * FROM v WHERE cause IS NOT NULL), few AS (SELECT * FROM bad ORDER BY row LIMIT 4)
        SELECT policy, row, cause, CASE WHEN policy = 'emit' THEN CAST(row AS VARCHAR) ELSE 'redacted' END AS key, (SELECT count(*) FROM bad) AS total FROM few, (VALUES ('emit'), ('redact')) p(policy)""",
    "refusals": "SELECT attempt, code, CAST(status AS INTEGER) AS status FROM (" + _values("attempt, code, status", [
        ("no geometry column named", "USAGE", 2), ("no crs", "CRS_REQUIRED", 5), ("no such column", "CONTRACT", 6), ("unknown format", "UNSUPPORTED", 4), ("ragged rows", "FORMAT", 1), ("a key twice", "INVALID_GEOMETRY", 1),
        ("target exists", "EXISTS", 3), ("wrong total", "CONTRACT", 6), ("no such layer", "CONTRACT", 6), ("unknown field", "CONTRACT", 6), ("no projection", "PROJECTION_UNSUPPORTED", 8), ("two layers in one", "REPROJECTION_REQUIRED", 1),
        *((f"rows of {n}", "LIMIT", 7) for n in ("s.csv", "s.geojson", "s.gpkg", "s.arrow", "s.parquet", "s.shp.d", "s.xlsx"))]) + ")",
    "format_router": _values("path, format", [
        ("a.csv", "csv"), ("a.CSV", "csv"), ("a.json", "geojson"), ("a.geojson", "geojson"), ("a.parquet", "geoparquet"), ("a.gpkg", "gpkg"), ("A/B.SHP.D", "shp"), ("a.shp", "shp"), ("a.kml", "kml"), ("a.xlsx", "xls"), ("a.dxf", "dxf"),
        ("a.arrow", "ipc"), ("a.gdb", "filegdb"), ("a.tif", "UNSUPPORTED"), ("a", "UNSUPPORTED")]),
    "infer_lattice": f"""
        SELECT CAST(n AS INTEGER) AS classes, CASE WHEN {_HAS('text')} OR (n & 30) = 0 THEN 'text' WHEN {_HAS('boolean')} THEN CASE WHEN (n & 14) = 0 THEN 'boolean' ELSE 'text' END
            WHEN {_HAS('number')} THEN CASE WHEN {_HAS('wide_integer')} THEN 'text' ELSE 'number' END ELSE 'integer' END AS type FROM range(64) r(n)""",
    "infer_values": _values("value, class", [("null", "null"), ("true", "boolean"), ("one", "integer"), ("2^53", "integer"), ("2^53 + 1", "wide_integer"), ("2^64", "text"), ("half", "number"), ("not a number", "text"), ("word", "text"), ("list", "text")]),
    "predicate_hints": "SELECT hint, field, op, CAST(value AS DOUBLE) AS value FROM (" + _values("hint, field, op, value", [
        ("a >= 1", "a", ">=", 1.0), ("b<2.5", "b", "<", 2.5), ("c == -3", "c", "==", -3.0), ("d = 1e3", "d", "=", 1000.0), ("e > ", None, None, None), ("f LIKE 1", None, None, None), ("g >= x", None, None, None), ("1 < 2 < 3", None, None, None), (" h <= .5 ", "h", "<=", 0.5)]) + ")",
    "adaptive_batches": "SELECT CAST(r AS INTEGER) AS rows, CAST(o AS BIGINT) AS observed, CAST(t AS BIGINT) AS target, CAST(CASE WHEN o = 0 THEN least(65536, r) ELSE greatest(1, least(65536, CAST(t AS HUGEINT) * r // o)) END AS INTEGER) AS next_rows FROM (VALUES (100, 1000, 10000), (100, 100000, 10000), (100, 0, 10000), (10, 10000000, 100), (65536, 1, 1073741824)) v(r, o, t)",
    "fidelity_end_to_end": "SELECT a.l AS source, b.l AS target, CASE WHEN a.k > b.k THEN a.l ELSE b.l END AS level FROM (VALUES ('lossless', 0), ('conditional', 1), ('approximating', 2)) a(l, k), (VALUES ('lossless', 0), ('conditional', 1), ('approximating', 2)) b(l, k)",
    "vertex_counts": "SELECT o_orderkey, 'POINT(' || o_orderkey || ' ' || o_custkey || ')' AS wkt FROM orders WHERE o_orderkey % 50 = 0",
}
