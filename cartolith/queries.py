"""The library's queries over the supplied tables and their DuckDB texts.

The tables hold no geometry, so both sides make it from numeric columns: a customer is a point at (c_custkey,
c_nationkey), a part the square of side 1 at (p_partkey, p_size). Files go to a new folder among the shared ones.
"""

from __future__ import annotations

import os
import sqlite3
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .contract import GeometryContract, with_geometry
from .crs import CRS84, resolved
from .dataset import ReadRequest, open_dataset
from .errors import EdgeError
from .functions import curves
from .functions.udfs import geojson_to_wkb, wkb_bbox, wkb_inspect, wkb_point, wkb_to_geojson, wkb_to_wkt, wkt_to_wkb
from .limits import initial_batch_rows
from .operators.infer import infer_types
from .operators.prune import project
from .operators.validate import first_examples, violations
from .plans.capabilities import validate_write
from .plans.catalog import FORMATS, catalog_frame
from .plans.convert import convert, layer_of, loss_frame, write_dataset

EPSG = resolved("EPSG:4326")


def work(spark: SparkSession) -> str:
    """A new folder for files, under the shared folder where that is a local path."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or ""
    if not shared.startswith(("file:///", "/")) and not spark.sparkContext.master.startswith("local"):
        raise EdgeError("USAGE", "files need a shared folder that executors see as a path", category="usage")
    base = shared.removeprefix("file://") if shared.startswith(("file:///", "/")) else tempfile.gettempdir()
    path = os.path.join(base, "cartolith-files", uuid.uuid4().hex)
    os.makedirs(path)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geometry_contract(crs=EPSG) -> GeometryContract:
    return GeometryContract("geometry", crs, dimensions="xy", types=("point",), declaration="exact")


def points(df: DataFrame, x: str, y: str, crs=EPSG) -> DataFrame:
    """``df`` with a first column of points."""
    own = df.select(wkb_point(F.col(x).cast("double"), F.col(y).cast("double")).alias("geometry"), "*")
    return with_geometry(own, geometry_contract(crs))


def squares(df: DataFrame, crs=EPSG) -> DataFrame:
    x, y = F.col("p_partkey"), F.col("p_size")
    ring = F.format_string("POLYGON((%d %d,%d %d,%d %d,%d %d,%d %d))", x, y, x, y + 1, x + 1, y + 1, x + 1, y, x, y)
    own = df.select(wkt_to_wkb(ring).alias("geometry"), "*")
    return with_geometry(own, GeometryContract("geometry", crs, dimensions="xy", types=("polygon",), declaration="exact"))


def customers(spark: SparkSession, sf_dir: str, crs=EPSG) -> DataFrame:
    return points(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", "c_acctbal"), "c_custkey", "c_nationkey", crs)


def suppliers(spark: SparkSession, sf_dir: str, crs=EPSG) -> DataFrame:
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("nation"), F.col("s_acctbal").alias("balance"))
    return points(own, "id", "nation", crs)


def written(spark: SparkSession, df: DataFrame, name: str, read_options: dict | None = None, request: ReadRequest = ReadRequest(), **options) -> DataFrame:
    """``df`` written to a file of this name and read back."""
    path = os.path.join(work(spark), name)
    write_dataset(spark, {"layer": df}, path, **options)
    return open_dataset(spark, path, unlimited=True, **(read_options or {})).read(request)


def as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("geometry", wkb_to_wkt("geometry"))


_XY = {"x_column": "x", "y_column": "y", "assume_crs": "EPSG:4326"}
_WKT = {"wkt_column": "geometry", "assume_crs": "EPSG:4326"}
_SUPPLIER = "SELECT 'POINT(' || s_suppkey || ' ' || s_nationkey || ')' AS geometry, s_suppkey AS id, s_name AS name, CAST(s_nationkey AS BIGINT) AS nation, s_acctbal AS balance FROM supplier"
_CUSTOMER = "SELECT 'POINT(' || c_custkey || ' ' || c_nationkey || ')' AS geometry, c_custkey, {nation} AS c_nationkey, c_name, c_acctbal FROM customer"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as CSV with coordinates, converted to GeoParquet with covering columns, pruned by a box, counted."""
    folder = work(spark)
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment").alias("segment"))
    write_dataset(spark, {"customers": points(own, "c_custkey", "c_nationkey")}, f"{folder}/c.csv", geometry_encoding="xy")
    convert(spark, f"{folder}/c.csv", f"{folder}/c.parquet", source_options=_XY)
    box = (10.0, 5.0, 1e6, 15.0)
    near = open_dataset(spark, f"{folder}/c.parquet").read(ReadRequest(bbox=box)).select("segment", wkb_bbox("geometry").alias("b"))
    inside = near.where((F.col("b.minx") >= box[0]) & F.col("b.miny").between(box[1], box[3]))
    return inside.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.max("b.maxx").alias("farthest"))


def wkb_point_encode(spark, sf_dir):
    return customers(spark, sf_dir).select("c_custkey", F.hex("geometry").alias("wkb"))


def wkb_inspect_types(spark, sf_dir):
    x = F.col("p_partkey")
    shape = (
        F.when(x % 4 == 0, F.format_string("POINT(%d 0)", x)).when(x % 4 == 1, F.format_string("LINESTRING(0 0,%d 1)", x))
        .when(x % 4 == 2, F.format_string("POLYGON((0 0,%d 0,%d 1,0 0))", x, x)).otherwise(F.format_string("MULTIPOINT Z(%d 1 2,3 4 5)", x))
    )
    found = table(spark, sf_dir, "part").select(wkb_inspect(wkt_to_wkb(shape)).alias("g"))
    return found.groupBy(F.col("g.kind").alias("kind"), F.col("g.dims").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.sum("g.components").alias("components"))


def wkb_bbox_polygon(spark, sf_dir):
    return squares(table(spark, sf_dir, "part")).select("p_partkey", wkb_bbox("geometry").alias("b")).select("p_partkey", "b.*")


def wkt_roundtrip(spark, sf_dir):
    return squares(table(spark, sf_dir, "part")).select("p_partkey", wkb_to_wkt(wkt_to_wkb(wkb_to_wkt("geometry"))).alias("wkt"))


def geojson_roundtrip(spark, sf_dir):
    return squares(table(spark, sf_dir, "part")).select("p_partkey", wkb_to_wkt(geojson_to_wkb(wkb_to_geojson("geometry"))).alias("wkt"))


def infer_types_csv(spark, sf_dir):
    path = os.path.join(work(spark), "orders")
    table(spark, sf_dir, "orders").withColumn("flag", F.col("o_orderkey") % 2 == 0).select([F.col(c).cast("string") for c in ("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate", "flag")]).write.csv(path, header=True)
    found = infer_types(spark.read.csv(path, header=True))
    return spark.createDataFrame(sorted(found.items()), "name string, type string")


def csv_roundtrip(spark, sf_dir):
    return as_text(written(spark, customers(spark, sf_dir), "c.csv", _WKT))


def csv_xy_scan(spark, sf_dir):
    return as_text(written(spark, customers(spark, sf_dir), "c.csv", _XY, geometry_encoding="xy"))


def geoparquet_roundtrip(spark, sf_dir):
    return as_text(written(spark, customers(spark, sf_dir), "c.parquet"))


def geoparquet_directory(spark, sf_dir):
    return as_text(written(spark, customers(spark, sf_dir).repartition(4, "c_custkey"), "c.parquet", layout="directory"))


def projection_exact(spark, sf_dir):
    return written(spark, customers(spark, sf_dir), "c.parquet", request=ReadRequest(columns=("c_acctbal", "c_custkey", "c_custkey")))


def projection_empty_count(spark, sf_dir):
    df = written(spark, customers(spark, sf_dir), "c.parquet", request=ReadRequest(columns=()))
    return spark.createDataFrame([(len(df.columns), df.count())], "columns int, n long")


def projection_by_id(spark, sf_dir):
    return project(table(spark, sf_dir, "nation"), [1, 0, 1])


def prune_numeric(spark, sf_dir):
    df = written(spark, customers(spark, sf_dir), "c.parquet", request=ReadRequest(predicate="c_custkey >= 100"))
    return df.where("c_custkey >= 100").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("total"))


def prune_bbox(spark, sf_dir):
    df = written(spark, customers(spark, sf_dir), "c.parquet", request=ReadRequest(bbox=(20.0, 3.0, 120.0, 9.0)))
    return df.select("c_custkey", wkb_bbox("geometry").alias("b")).where(F.col("b.minx").between(20, 120) & F.col("b.miny").between(3, 9)).select("c_custkey")


def opaque_predicate(spark, sf_dir):
    from .operators.prune import prune_numeric as prune

    return prune(table(spark, sf_dir, "lineitem"), "l_quantity >= 30.0").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def ipc_roundtrip(spark, sf_dir):
    return as_text(written(spark, suppliers(spark, sf_dir), "s.arrow"))


def gpkg_roundtrip(spark, sf_dir):
    return as_text(written(spark, suppliers(spark, sf_dir), "s.gpkg"))


def gpkg_multilayer(spark, sf_dir):
    path = os.path.join(work(spark), "m.gpkg")
    region = points(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name")), "key", "key")
    nation = points(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")), "key", "key")
    write_dataset(spark, {"nation": nation, "region": region}, path)
    opened = open_dataset(spark, path)
    parts = [opened.read(ReadRequest(x.name)).select(F.lit(x.name).alias("layer"), "key", "name", wkb_to_wkt("geometry").alias("geometry")) for x in opened.layers]
    return parts[0].unionByName(parts[1])


def geojson_roundtrip_file(spark, sf_dir):
    return as_text(written(spark, suppliers(spark, sf_dir, resolved(CRS84)), "s.geojson"))


def shp_roundtrip(spark, sf_dir):
    return as_text(written(spark, suppliers(spark, sf_dir), "s.shp.d"))


def shp_polygons(spark, sf_dir):
    parts = squares(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("geometry", F.col("p_partkey").alias("part"), F.col("p_size").alias("size"))
    parts = with_geometry(parts, GeometryContract("geometry", EPSG, dimensions="xy", types=("polygon",), declaration="exact"))
    return as_text(written(spark, parts, "p.shp.d"))


def kml_roundtrip(spark, sf_dir):
    own = suppliers(spark, sf_dir, resolved(CRS84)).select("geometry", "name", F.concat(F.lit("no. "), F.col("id").cast("string")).alias("description"))
    return as_text(written(spark, with_geometry(own, GeometryContract("geometry", resolved(CRS84), dimensions="xy", types=("point",), declaration="exact")), "s.kml"))


def xlsx_roundtrip(spark, sf_dir):
    return as_text(written(spark, suppliers(spark, sf_dir), "s.xlsx", _WKT))


def dxf_roundtrip(spark, sf_dir):
    own = suppliers(spark, sf_dir).select("geometry", F.col("name").alias("layer"))
    own = with_geometry(own, GeometryContract("geometry", EPSG, dimensions="xy", types=("point",), declaration="exact"))
    return as_text(written(spark, own, "s.dxf", {"assume_crs": "EPSG:4326"}))


def dxf_arc_points(spark, sf_dir):
    """Points of arcs, worked out by the tessellation batch by batch."""
    @arrow_udf("int")
    def n(sweep: pa.Array) -> pa.Array:
        return pa.array([len(curves.arc((0.0, 0.0), 1.0, 0.0, s)) for s in sweep.to_pylist()], pa.int32())

    return table(spark, sf_dir, "part").select("p_partkey", n(F.col("p_size").cast("double") * 7).alias("points"))


def _broken(spark, sf_dir):
    """Parts with every seventh cell cut short and every eleventh missing, under a contract that allows neither."""
    k = F.col("p_partkey")
    cell = F.when(k % 11 == 0, None).when(k % 7 == 0, F.substring("geometry", 1, 20)).when(k % 5 == 0, wkt_to_wkb(F.lit("POINT(1 2)"))).otherwise(F.col("geometry"))
    df = squares(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(cell.alias("geometry"), "p_partkey")
    return with_geometry(df, GeometryContract("geometry", EPSG, False, dimensions="xy", types=("polygon",), declaration="exact"))


def violations_by_cause(spark, sf_dir):
    return violations(_broken(spark, sf_dir), index="p_partkey").groupBy("cause").agg(F.count(F.lit(1)).alias("n"))


def diagnostic_examples(spark, sf_dir):
    return first_examples(violations(_broken(spark, sf_dir), index="p_partkey"), 3).select("cause", "row")


def batch_plan(spark, sf_dir):
    df = customers(spark, sf_dir)
    size = initial_batch_rows(df.schema, 65_536)
    n = df.count()
    return spark.createDataFrame([(size, n, -(-n // size))], "batch_rows int, n long, batches long")


def coercion_loss(spark, sf_dir):
    """A table whose whole-number column holds other values, with what reading it loses."""
    path = os.path.join(work(spark), "c.gpkg")
    own = points(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").cast("long").alias("value")), "key", "value")
    write_dataset(spark, {"layer": own}, path)
    with sqlite3.connect(path) as db:
        db.execute("UPDATE layer SET value = value + 0.5 WHERE key % 2 = 0")
    return loss_frame(spark, open_dataset(spark, path).losses())


def capability_matrix(spark, sf_dir):
    """Which formats accept suppliers, and why others refuse."""
    rows = []
    for name in sorted(FORMATS):
        for kind, df in (("points", suppliers(spark, sf_dir)), ("crs84", suppliers(spark, sf_dir, resolved(CRS84))), ("dates", suppliers(spark, sf_dir).withColumn("day", F.current_date()))):
            try:
                validate_write(FORMATS[name], [layer_of("layer", df)])
                rows.append((name, kind, "accepted"))
            except EdgeError as error:
                rows.append((name, kind, error.code))
    return spark.createDataFrame(rows, "format string, layer string, verdict string")


def catalog(spark, sf_dir):
    return catalog_frame(spark)


def convert_chain(spark, sf_dir):
    """CSV to GeoPackage to Arrow to GeoParquet, rows unchanged."""
    folder = work(spark)
    write_dataset(spark, {"s": suppliers(spark, sf_dir)}, f"{folder}/s.csv")
    convert(spark, f"{folder}/s.csv", f"{folder}/s.gpkg", source_options=_WKT)
    convert(spark, f"{folder}/s.gpkg", f"{folder}/s.arrow")
    convert(spark, f"{folder}/s.arrow", f"{folder}/s.parquet")
    return as_text(open_dataset(spark, f"{folder}/s.parquet").read())


_ARC = "CAST(greatest(1, floor(24 * (p_size * 7) / 360.0 + 0.5)) + 1 AS INTEGER)"
_WKT_SQUARE = "'POLYGON((' || p_partkey || ' ' || p_size || ',' || p_partkey || ' ' || (p_size + 1) || ',' || (p_partkey + 1) || ' ' || (p_size + 1) || ',' || (p_partkey + 1) || ' ' || p_size || ',' || p_partkey || ' ' || p_size || '))'"
_CAUSE = "CASE WHEN p_partkey % 11 = 0 THEN 'contract.nullability' WHEN p_partkey % 7 = 0 THEN 'conversion.invalid_geometry' WHEN p_partkey % 5 = 0 THEN 'contract.geometry_type' END"

QUERIES = {f.__name__: f for f in (
    flagship, wkb_point_encode, wkb_inspect_types, wkb_bbox_polygon, wkt_roundtrip, geojson_roundtrip, infer_types_csv, csv_roundtrip, csv_xy_scan, geoparquet_roundtrip,
    geoparquet_directory, projection_exact, projection_empty_count, projection_by_id, prune_numeric, prune_bbox, opaque_predicate, ipc_roundtrip, gpkg_roundtrip, gpkg_multilayer,
    geojson_roundtrip_file, shp_roundtrip, shp_polygons, kml_roundtrip, xlsx_roundtrip, dxf_roundtrip, dxf_arc_points, violations_by_cause, diagnostic_examples, batch_plan,
    coercion_loss, capability_matrix, catalog, convert_chain,
)}
ORACLE_SQL = {
    "flagship": "SELECT c_mktsegment AS segment, count(*) AS n, CAST(max(c_custkey) AS DOUBLE) AS farthest FROM customer WHERE c_custkey >= 10 AND c_custkey <= 1000000 AND c_nationkey BETWEEN 5 AND 15 GROUP BY 1",
    "wkb_point_encode": "SELECT c_custkey, hex(ST_AsWKB(('POINT(' || c_custkey || ' ' || c_nationkey || ')')::GEOMETRY)) AS wkb FROM customer",
    "wkb_inspect_types": "SELECT k.kind, k.dims, count(*) AS n, CAST(sum(k.c) AS BIGINT) AS components FROM part JOIN (VALUES (0, 'point', 'xy', 1), (1, 'linestring', 'xy', 2), (2, 'polygon', 'xy', 5), (3, 'multipoint', 'xyz', 4)) k(r, kind, dims, c) ON p_partkey % 4 = k.r GROUP BY 1, 2",
    "wkb_bbox_polygon": "SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS minx, CAST(p_size AS DOUBLE) AS miny, CAST(p_partkey + 1 AS DOUBLE) AS maxx, CAST(p_size + 1 AS DOUBLE) AS maxy FROM part",
    "wkt_roundtrip": f"SELECT p_partkey, {_WKT_SQUARE} AS wkt FROM part",
    "geojson_roundtrip": f"SELECT p_partkey, {_WKT_SQUARE} AS wkt FROM part",
    "infer_types_csv": """
        WITH c AS (SELECT 'o_orderkey' AS name, CAST(o_orderkey AS VARCHAR) AS v FROM orders UNION ALL SELECT 'o_totalprice', CAST(o_totalprice AS VARCHAR) FROM orders
            UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 'o_orderdate', CAST(o_orderdate AS VARCHAR) FROM orders UNION ALL SELECT 'flag', CAST(o_orderkey % 2 = 0 AS VARCHAR) FROM orders)
        SELECT name, CASE WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]+')) THEN 'integer' WHEN bool_and(regexp_full_match(v, '[+-]?[0-9.]+(e[+-]?[0-9]+)?')) THEN 'number'
            WHEN bool_and(v IN ('true', 'false')) THEN 'boolean' ELSE 'text' END AS type FROM c GROUP BY name""",
    "csv_roundtrip": _CUSTOMER.format(nation="CAST(c_nationkey AS BIGINT)"),
    "csv_xy_scan": _CUSTOMER.format(nation="CAST(c_nationkey AS BIGINT)"),
    "geoparquet_roundtrip": _CUSTOMER.format(nation="c_nationkey"),
    "geoparquet_directory": _CUSTOMER.format(nation="c_nationkey"),
    "projection_exact": "SELECT c_custkey, c_acctbal FROM customer",
    "projection_empty_count": "SELECT 0 AS columns, count(*) AS n FROM customer",
    "projection_by_id": "SELECT n_nationkey, n_name FROM nation",
    "prune_numeric": "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer WHERE c_custkey >= 100",
    "prune_bbox": "SELECT c_custkey FROM customer WHERE c_custkey BETWEEN 20 AND 120 AND c_nationkey BETWEEN 3 AND 9",
    "opaque_predicate": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity >= 30 GROUP BY 1",
    "ipc_roundtrip": _SUPPLIER, "gpkg_roundtrip": _SUPPLIER, "geojson_roundtrip_file": _SUPPLIER, "shp_roundtrip": _SUPPLIER, "xlsx_roundtrip": _SUPPLIER, "convert_chain": _SUPPLIER,
    "gpkg_multilayer": "SELECT 'region' AS layer, CAST(r_regionkey AS BIGINT) AS key, r_name AS name, 'POINT(' || r_regionkey || ' ' || r_regionkey || ')' AS geometry FROM region UNION ALL SELECT 'nation', n_nationkey, n_name, 'POINT(' || n_nationkey || ' ' || n_nationkey || ')' FROM nation",
    "shp_polygons": f"SELECT replace(replace({_WKT_SQUARE}, 'POLYGON(', 'MULTIPOLYGON(('), '))', ')))') AS geometry, p_partkey AS part, CAST(p_size AS BIGINT) AS size FROM part",
    "kml_roundtrip": "SELECT 'POINT(' || s_suppkey || ' ' || s_nationkey || ')' AS geometry, s_name AS name, 'no. ' || s_suppkey AS description FROM supplier",
    "dxf_roundtrip": "SELECT 'POINT(' || s_suppkey || ' ' || s_nationkey || ')' AS geometry, s_name AS layer, 'POINT' AS dxf_type, CAST(NULL AS VARCHAR) AS text FROM supplier",
    "dxf_arc_points": f"SELECT p_partkey, {_ARC} AS points FROM part",
    "violations_by_cause": f"SELECT {_CAUSE} AS cause, count(*) AS n FROM part WHERE {_CAUSE} IS NOT NULL GROUP BY 1",
    "diagnostic_examples": f"SELECT cause, p_partkey AS row FROM (SELECT p_partkey, {_CAUSE} AS cause, row_number() OVER (PARTITION BY {_CAUSE} ORDER BY p_partkey) AS k FROM part) WHERE cause IS NOT NULL AND k <= 3",
    "batch_plan": "SELECT CAST(65536 // (512 + 8 + 4 + 64 + 8) AS INTEGER) AS batch_rows, count(*) AS n, CAST(ceil(count(*) / (65536 // (512 + 8 + 4 + 64 + 8))) AS BIGINT) AS batches FROM customer",
    "capability_matrix": """
        SELECT f AS format, k AS layer, CASE WHEN f = 'filegdb' THEN 'UNSUPPORTED' WHEN k = 'points' AND f IN ('geojson', 'kml') THEN 'REPROJECTION_REQUIRED'
            WHEN k = 'crs84' AND f = 'gpkg' OR k = 'dates' AND f NOT IN ('dxf', 'geoparquet', 'ipc') THEN 'CONTRACT' ELSE 'accepted' END AS verdict
        FROM (VALUES ('csv'), ('dxf'), ('filegdb'), ('geojson'), ('geoparquet'), ('gpkg'), ('ipc'), ('kml'), ('shp'), ('xls')) a(f), (VALUES ('points'), ('crs84'), ('dates')) b(k)""",
    "catalog": """
        SELECT * FROM (VALUES
            ('csv', 'sequential', 'streaming', false, false, 'multiple', 'exact', 'none', 'none', 'none', 'conditional', true, NULL),
            ('dxf', 'sequential', 'buffered', false, false, 'single', 'none', 'none', 'none', 'embedded', 'approximating', true, NULL),
            ('filegdb', 'materializing', 'streaming', true, true, 'single', 'exact', 'none', 'none', 'embedded', 'conditional', false, 'gdal'),
            ('geojson', 'sequential', 'streaming', false, false, 'multiple', 'exact', 'none', 'none', 'fixed', 'lossless', true, NULL),
            ('geoparquet', 'columnar', 'streaming', false, false, 'multiple', 'exact', 'numeric_min_max', 'bbox_statistics', 'embedded', 'lossless', true, NULL),
            ('gpkg', 'sequential', 'streaming', true, false, 'multiple', 'exact', 'none', 'optional_rtree', 'embedded', 'conditional', true, NULL),
            ('ipc', 'sequential', 'streaming', false, false, 'multiple', 'exact', 'none', 'none', 'embedded_optional', 'lossless', true, NULL),
            ('kml', 'sequential', 'streaming', false, false, 'single', 'none', 'none', 'none', 'fixed', 'conditional', true, NULL),
            ('shp', 'sequential', 'streaming', false, true, 'multiple', 'exact', 'none', 'none', 'embedded', 'conditional', true, NULL),
            ('xls', 'sequential', 'buffered', false, false, 'single', 'none', 'none', 'none', 'none', 'conditional', true, NULL)
        ) t(id, read_mode, write_mode, multi_layer, multi_file, concurrency, projection, predicate_pruning, spatial_pruning, crs_handling, fidelity, available, required_feature)""",
    "coercion_loss": "SELECT 'real_truncated_to_integer' AS category, count(*) AS n FROM supplier WHERE s_suppkey % 2 = 0 HAVING count(*) > 0",
}

from . import kernel_queries  # noqa: E402  (they use what stands above)

QUERIES |= kernel_queries.QUERIES
ORACLE_SQL |= kernel_queries.ORACLE_SQL
