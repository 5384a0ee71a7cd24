"""Structured Streaming over growing folders of CSV points and of newline-delimited GeoJSON features.

Streams need a schema up front, so the contract of a first batch, found as for a file, serves for all that follow;
a cell that doesn't fit its column then fails the query instead of being lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..contract import GeometryContract, with_geometry
from ..crs import CRS84, resolved
from ..functions.udfs import geojson_to_wkb, wkb_bbox
from ..operators.infer import typed
from ..sources.csv import geometry_expression


def strictly(cell, kind: str):
    """A typed cell, failing where it doesn't fit."""
    value = typed(cell, kind)
    return F.when(value.isNull() & (F.trim(cell) != ""), F.raise_error(F.lit("DATA_MAPPING: a value does not fit its column's type"))).otherwise(value)


def stream_csv(spark: SparkSession, folder: str, columns: dict[str, str], x_column: str, y_column: str, crs: str, **options) -> DataFrame:
    """Points from CSV files as they arrive. columns: attribute name to integer, number, boolean or text, in file order."""
    names = options.pop("file_columns", [*columns, x_column, y_column])
    raw = spark.readStream.schema(StructType([StructField(n, StringType()) for n in names])).csv(folder, header=True, mode="FAILFAST", enforceSchema=False, **options)
    df = raw.select(geometry_expression([x_column, y_column]).alias("geometry"), *(strictly(F.col(f"`{n}`"), k).alias(n) for n, k in columns.items()))
    return with_geometry(df, GeometryContract("geometry", resolved(crs), dimensions="xy", types=("point",), declaration="exact"))


def stream_features(spark: SparkSession, folder: str, properties: StructType) -> DataFrame:
    """Newline-delimited features as they arrive: geometry and the given properties."""
    lines = spark.readStream.text(folder).where(F.trim("value") != "")
    feature = F.from_json("value", StructType([StructField("properties", properties)]), {"mode": "FAILFAST"})
    df = lines.select(geojson_to_wkb(F.get_json_object("value", "$.geometry")).alias("geometry"), feature["properties"].alias("p")).select("geometry", "p.*")
    return with_geometry(df, GeometryContract("geometry", resolved(CRS84)))


def windowed_extent(df: DataFrame, time: str, width: str, late: str, geometry: str = "geometry") -> DataFrame:
    """Rows and extent in tumbling windows of event time; rows later than ``late`` are out."""
    boxed = df.withWatermark(time, late).withColumn("box", wkb_bbox(F.col(geometry)))
    return boxed.groupBy(F.window(time, width)).agg(
        F.count(F.lit(1)).alias("n"), F.min("box.minx").alias("minx"), F.min("box.miny").alias("miny"), F.max("box.maxx").alias("maxx"), F.max("box.maxy").alias("maxy")
    )
