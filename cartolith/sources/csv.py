"""CSV with a WKT column or x and y columns. Spark parses; types come from an aggregate over all rows."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..contract import GeometryContract, Layer, geometry_field, with_geometry
from ..crs import resolved
from ..errors import EdgeError
from ..functions import wkb, wkt
from ..functions.udfs import wkb_point, wkt_to_wkb
from ..operators.infer import NUMBER, TYPES, infer_types, typed
from ..operators.validate import geometry_types
from .base import text_column, write_text


def _raw(spark: SparkSession, path: str, options: dict, whole: bool = False) -> DataFrame:
    """Cells as text. Rows of the wrong width fail. Files are split unless ``multiline`` says that quotes hold line ends.

    whole: also cells that nobody asks for are parsed, so that every row's width is looked at.
    """
    multi = str(options.get("multiline", True)).lower() == "true"
    return spark.read.option("columnPruning", not whole).csv(path, header=True, inferSchema=False, mode="FAILFAST", enforceSchema=False, multiLine=multi, sep=(options.get("delimiter") or ",")[0], quote='"', escape='"', maxCharsPerColumn=-1, maxColumns=4096)


def _geometry_columns(options: dict, names: list[str]) -> list[str]:
    if options.get("wkt_column"):
        found = [options["wkt_column"]]
    elif options.get("x_column") and options.get("y_column"):
        found = [options["x_column"], options["y_column"]]
    elif options.get("tabular"):
        return []
    else:
        raise EdgeError("USAGE", "wkt_column, or x_column and y_column, must be given", category="usage", phase="open")
    if not set(found) <= set(names):
        raise EdgeError("CONTRACT", "a geometry column is not in the header", category="contract", phase="open")
    return found


def geometry_expression(columns: list[str]):
    cells = [F.col(f"`{c}`") for c in columns]
    if len(cells) == 1:
        return wkt_to_wkb(cells[0])
    numbers = [F.when(F.coalesce(F.trim(c) == "", F.lit(True)), None).when(F.trim(c).rlike(NUMBER), F.trim(c).try_cast("double")).otherwise(F.raise_error(F.lit("INVALID_GEOMETRY: an ordinate is not a number"))) for c in cells]
    return wkb_point(*numbers)


def quoted(spark: SparkSession, path: str) -> bool:
    """Whether the file has a quotation mark, and so perhaps cells with line ends; looked for in parallel."""
    return not spark.read.text(path).where(F.col("value").contains('"')).limit(1).isEmpty()


def describe(spark: SparkSession, path: str, options: dict) -> list[Layer]:
    if "multiline" not in options:  # what is found is kept for the reads to come
        options["multiline"] = quoted(spark, path)
    raw = _raw(spark, path, options, whole=True)
    if len(set(raw.columns)) < len(raw.columns):
        raise EdgeError("FORMAT", "the header names a column twice", phase="open")
    taken = _geometry_columns(options, raw.columns)
    if taken and not options.get("assume_crs"):
        raise EdgeError("CRS_REQUIRED", "the format carries no CRS; assume_crs must be given", category="contract", phase="open")
    attributes = [c for c in raw.columns if c not in taken]
    most = options.get("max_rows")
    kinds, n = infer_types(raw, attributes, count=True)
    if most is not None and n > most:
        raise EdgeError("LIMIT", "too many rows", category="resource", phase="open")
    fields = [StructField(c, TYPES[kinds[c]], True) for c in attributes]
    if taken:
        types, dims = (("point",), {"xy"}) if len(taken) == 2 else _types(raw, taken)
        contract = GeometryContract("geometry", resolved(options["assume_crs"]), True, "wkb", dims.pop() if len(dims) == 1 else "unknown", types=types, declaration="exact" if types else "unresolved")
        fields.insert(0, geometry_field(contract))
    return [Layer(0, "csv", StructType(fields), {"geometry": taken, "kinds": kinds})]


def _types(raw: DataFrame, taken: list[str]):
    found = geometry_types(raw.select(geometry_expression(taken).alias("g")), "g")
    return tuple(sorted({k for k, _ in found})), {d for _, d in found}


def read(spark: SparkSession, path: str, layer: Layer, options: dict, columns: list[str] | None = None, index: bool = False) -> DataFrame:
    kinds, out = layer.extra["kinds"], []
    for f in layer.schema.fields:
        if columns is None or f.name in columns:
            out.append(typed(F.col(f"`{f.name}`"), kinds[f.name]).alias(f.name) if f.name in kinds else geometry_expression(layer.extra["geometry"]).alias(f.name))
    df = _raw(spark, path, options).select(*out)
    g = layer.geometry
    return with_geometry(df, g) if g and g.name in df.columns else df


def write(spark: SparkSession, frames: list[tuple[Layer, DataFrame]], path: str, options: dict) -> dict:
    layer, df = frames[0]
    g, names = layer.geometry, [f.name for f in layer.attributes]
    as_xy, sep = options.get("geometry_encoding") == "xy", (options.get("delimiter") or ",")[0]

    def shapes(cells: pa.Array) -> list[list[str]]:
        plain = wkb.plain_points(cells)
        if plain is not None:
            x, y = ([wkt.number(v) for v in c.tolist()] for c in plain)
            return [x, y] if as_xy else [[f"POINT({a} {b})" for a, b in zip(x, y)]]
        decoded = [None if c is None else wkb.decode(c) for c in cells.to_pylist()]
        if not as_xy:
            return [["" if g is None else wkt.format(g) for g in decoded]]
        if any(g is not None and (g.kind != "point" or g.dims != "xy" or g.content is None) for g in decoded):
            raise EdgeError("DATA_MAPPING", "only points of two ordinates have x and y", phase="write")
        return [["" if g is None else wkt.number(g.content[k]) for g in decoded] for k in (0, 1)]

    def texts(batch: pa.RecordBatch) -> str:
        columns = [text_column(batch.column(batch.schema.get_field_index(n))) for n in names]
        columns += shapes(batch.column(batch.schema.get_field_index(g.name))) if g else []
        out = io.StringIO()
        csv.writer(out, delimiter=sep, lineterminator="\n").writerows(zip(*columns))
        return out.getvalue()

    head = io.StringIO()
    csv.writer(head, delimiter=sep, lineterminator="\n").writerow(names + ([] if not g else ["x", "y"] if as_xy else ["geometry"]))
    return write_text(df, path, texts, head.getvalue())
