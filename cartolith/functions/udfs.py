"""Geometry functions for DataFrames and SQL: Arrow batches in, Arrow batches out.

Each takes null to null. ``register(spark)`` makes them SQL functions of the same names.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..errors import EdgeError
from . import geojson, wkb, wkt

INSPECTION = StructType([
    StructField("valid", BooleanType()), StructField("kind", StringType()), StructField("dims", StringType()), StructField("srid", LongType()), StructField("coherent", BooleanType()),
    StructField("contains_srid", BooleanType()), StructField("components", LongType()), StructField("cause", StringType()),
])
_INSPECTION = pa.struct([("valid", pa.bool_()), ("kind", pa.string()), ("dims", pa.string()), ("srid", pa.int64()), ("coherent", pa.bool_()), ("contains_srid", pa.bool_()), ("components", pa.int64()), ("cause", pa.string())])
BOX = StructType([StructField(n, DoubleType()) for n in ("minx", "miny", "maxx", "maxy")])


def inspect_row(cell: bytes | None) -> dict | None:
    if cell is None:
        return None
    try:
        found = wkb.inspect(cell)
    except EdgeError as error:
        return {"valid": False, "cause": error.message}
    return {"valid": True, **found._asdict()}


@arrow_udf(INSPECTION)
def wkb_inspect(cells: pa.Array) -> pa.Array:
    """Structure of each cell, or why it is not a geometry; plain points are all alike."""
    if wkb.plain_points(cells) is not None:
        return pa.array([inspect_row(cells[0].as_py())], _INSPECTION).take(pa.array(np.zeros(len(cells), np.int64)))
    return pa.array([inspect_row(c) for c in cells.to_pylist()], _INSPECTION)


@arrow_udf(BOX)
def wkb_bbox(cells: pa.Array) -> pa.Array:
    """Bounds; null fields where none can be vouched for."""
    return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in wkb.bbox_columns(cells.to_pylist())], ["minx", "miny", "maxx", "maxy"])


@arrow_udf(BinaryType())
def wkb_point(x: pa.Array, y: pa.Array) -> pa.Array:
    """Points; null if both ordinates are, an error if one is."""
    missing = np.asarray(x.is_null()) & np.asarray(y.is_null())
    if (np.asarray(x.is_null()) != np.asarray(y.is_null())).any():
        raise EdgeError("INVALID_GEOMETRY", "one ordinate of a point is missing")
    a, b = (np.asarray(v.cast(pa.float64()).fill_null(0.0)) for v in (x, y))
    if not (np.isfinite(a) & np.isfinite(b)).all():
        raise EdgeError("INVALID_GEOMETRY", "not a finite ordinate")
    return pa.array(wkb.point_cells(a, b), pa.binary(), mask=missing)


def _each(column: pa.Array, f, kind: pa.DataType) -> pa.Array:
    return pa.array([None if v is None else f(v) for v in column.to_pylist()], kind)


@arrow_udf(StringType())
def wkb_to_wkt(cells: pa.Array) -> pa.Array:
    plain = wkb.plain_points(cells)
    if plain is not None:
        return pa.array([f"POINT({wkt.number(x)} {wkt.number(y)})" for x, y in zip(*(c.tolist() for c in plain))], pa.string())
    return _each(cells, lambda c: wkt.format(wkb.decode(c)), pa.string())


@arrow_udf(BinaryType())
def wkt_to_wkb(texts: pa.Array) -> pa.Array:
    """Blank text is null."""
    return _each(texts, lambda t: wkb.encode(wkt.parse(t)) if t.strip() else None, pa.binary())


@arrow_udf(StringType())
def wkb_to_geojson(cells: pa.Array) -> pa.Array:
    plain = wkb.plain_points(cells)
    if plain is not None:
        return pa.array([f'{{"type":"Point","coordinates":[{x!r},{y!r}]}}' for x, y in zip(*(c.tolist() for c in plain))], pa.string())
    return _each(cells, lambda c: geojson.dumps(wkb.decode(c)), pa.string())


def geojson_cell(text: str) -> bytes | None:
    g = geojson.parse(geojson.loads(text))
    return None if g is None else wkb.encode(g)


@arrow_udf(BinaryType())
def geojson_to_wkb(texts: pa.Array) -> pa.Array:
    return _each(texts, geojson_cell, pa.binary())


@arrow_udf(BinaryType())
def wkb_to_ewkb(cells: pa.Array, srid: pa.Array) -> pa.Array:
    return pa.array([None if c is None else wkb.encode(wkb.decode(c)._replace(srid=s), extended=True) for c, s in zip(cells.to_pylist(), srid.to_pylist())], pa.binary())


@arrow_udf(BinaryType())
def gp_strip(cells: pa.Array) -> pa.Array:
    from ..sources.gpkg import strip_header

    return _each(cells, strip_header, pa.binary())


FUNCTIONS = {
    "wkb_inspect": wkb_inspect, "wkb_bbox": wkb_bbox, "wkb_point": wkb_point, "wkb_to_wkt": wkb_to_wkt, "wkt_to_wkb": wkt_to_wkb,
    "wkb_to_geojson": wkb_to_geojson, "geojson_to_wkb": geojson_to_wkb, "wkb_to_ewkb": wkb_to_ewkb, "gp_strip": gp_strip,
}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)


