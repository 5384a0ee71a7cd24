"""GeoParquet: Spark's own Parquet scan with a geometry contract from the footer, and covering columns for pruning."""

from __future__ import annotations

import json
import os
from dataclasses import replace

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from ..contract import GeometryContract, Layer, geometry_field, geometry_of, with_geometry
from ..crs import CRS84, Crs, from_definition, resolved
from ..errors import EdgeError
from ..functions import wkb
from ..functions.udfs import wkb_bbox
from ..operators.prune import COVERING
from .base import write_one

ROW_GROUP, CODECS = 65_536, {"snappy", "zstd", "gzip", "brotli", "lz4", "none"}


def first_file(path: str) -> str:
    if not os.path.isdir(path):
        return path
    found = sorted(os.path.join(d, f) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet") and not f.startswith(("_", ".")))
    if not found:
        raise EdgeError("FORMAT", "there is no Parquet file", phase="open")
    return found[0]


def _crs(column: dict) -> Crs:
    value = column.get("crs")
    if value is None:
        return resolved(CRS84)
    own = value.get("id") if isinstance(value, dict) else None
    if isinstance(own, dict) and own.get("authority") and own.get("code") is not None:
        definition = json.dumps(value, sort_keys=True) if set(value) - {"id"} else None
        return resolved(f"{own['authority']}:{own['code']}", definition)
    return from_definition(json.dumps(value, sort_keys=True))


def _contract(geo: dict, name: str, nullable: bool) -> GeometryContract:
    column = geo.get("columns", {}).get(name, {})
    found = [wkb.from_label(t) for t in column.get("geometry_types", [])]
    types, dims = tuple(sorted({k for k, _ in found})), {d for _, d in found}
    return GeometryContract(name, _crs(column), nullable, "wkb", dims.pop() if len(dims) == 1 else "unknown", types=types, declaration="exact" if types else "unresolved")


def describe(spark: SparkSession, path: str, options: dict) -> list[Layer]:
    """Only footers are read; the number of rows is theirs too."""
    schema = spark.read.parquet(path).schema
    raw = (pq.read_metadata(first_file(path)).metadata or {}).get(b"geo")
    geo = json.loads(raw) if raw else {}
    fields = [f for f in schema.fields if f.name not in COVERING]
    names = [f.name for f in fields if isinstance(f.dataType, BinaryType)]
    name = geo.get("primary_column") or next((n for n in ("geometry", "geom", "wkb") if n in names), None)
    if name not in names:
        raise EdgeError("CONTRACT", "there is no geometry column", category="contract", phase="open")
    stamped = geometry_of(StructType([f for f in fields if f.name == name]))
    contract = _contract(geo, name, True)
    if stamped and not raw:
        contract = stamped
    if options.get("assume_crs") and contract.crs.resolution != "resolved":
        contract = replace(contract, crs=resolved(options["assume_crs"]))
    return [Layer(0, "geoparquet", StructType([geometry_field(contract) if f.name == name else f for f in fields]), {"covering": set(COVERING) <= set(schema.names), "rows": spark.read.parquet(path).count()})]


def read(spark: SparkSession, path: str, layer: Layer, options: dict, columns: list[str] | None = None, index: bool = False) -> DataFrame:
    """Catalyst prunes columns and pushes filters; covering columns come along only for pruning by box."""
    df = spark.read.parquet(path)
    keep = [f.name for f in layer.schema.fields if columns is None or f.name in columns]
    covering = list(COVERING) if options.get("with_covering") and layer.extra.get("covering") else []
    if index:
        df = df.select("*", F.col("_metadata.row_index").alias("_source_row"))
        keep.append("_source_row")
    df = df.select(*(F.col(f"`{c}`") for c in (*keep, *covering)))
    g = layer.geometry
    return with_geometry(df, g) if g and g.name in df.columns else df


def with_covering(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the four covering columns of its geometry."""
    box = wkb_bbox(F.col(f"`{name}`"))
    boxed = df.withColumn("__box", box)
    return boxed.select(*(F.col(f"`{c}`") for c in df.columns), *(F.col(f"__box.{p}").alias(c) for p, c in zip(("minx", "miny", "maxx", "maxy"), COVERING)))


def footer(contract: GeometryContract, labels: list[str]) -> dict:
    column = {"encoding": "WKB", "geometry_types": sorted(labels), "covering": {"bbox": {k: [c] for k, c in zip(("xmin", "ymin", "xmax", "ymax"), COVERING)}}}
    if contract.crs.id and contract.crs.id != CRS84:
        authority, _, code = contract.crs.id.partition(":")
        column["crs"] = {"id": {"authority": authority, "code": int(code) if code.isdigit() else code}}
    return {"version": "1.0.0", "primary_column": contract.name, "columns": {contract.name: column}}


def write(spark: SparkSession, frames: list[tuple[Layer, DataFrame]], path: str, options: dict) -> dict:
    """One file, or with ``layout=directory`` a file for each partition, written side by side."""
    layer, df = frames[0]
    contract, codec = layer.geometry, options.get("compression", "snappy")
    codec = codec if codec in CODECS else "snappy"
    covered = with_covering(df, contract.name)
    directory = options.get("layout") == "directory"

    def save(batches, target: str) -> dict:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, n, seen = to_arrow_schema(covered_schema), 0, set()
        with pq.ParquetWriter(target, schema, compression=codec) as out:
            held, rows = [], 0
            for batch in batches:
                table = pa.Table.from_batches([batch]).cast(schema)
                for cell in set(batch.column(batch.schema.get_field_index(contract.name)).to_pylist()):
                    if cell is not None:
                        found = wkb.inspect(cell)
                        seen.add(wkb.label(found.kind, found.dims))
                held.append(table)
                rows += len(table)
                n += len(table)
                while rows >= ROW_GROUP:
                    whole = pa.concat_tables(held)
                    out.write_table(whole.slice(0, ROW_GROUP), row_group_size=ROW_GROUP)
                    held, rows = [whole.slice(ROW_GROUP)], rows - ROW_GROUP
            if rows:
                out.write_table(pa.concat_tables(held), row_group_size=ROW_GROUP)
            out.add_key_value_metadata({"geo": json.dumps(footer(contract, list(seen)))})
        return {"rows": n, "types": sorted(seen)}

    covered_schema = covered.schema
    if not directory:
        return write_one(covered, lambda batches: save(batches, path))
    os.makedirs(path)

    def task(batches):
        from pyspark import TaskContext

        at = TaskContext.get()
        name = f".part-{at.partitionId():05d}-{at.taskAttemptId()}.parquet"
        report = save(batches, os.path.join(path, name))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(report | {"file": name})])], ["report"])

    reports = [json.loads(r.report) for r in covered.mapInArrow(task, "report string").collect()]  # a row for each partition
    for k, report in enumerate(reports):  # only files of the attempts that count get a name
        os.rename(os.path.join(path, report["file"]), os.path.join(path, f"part-{k:05d}.parquet"))
    for name in os.listdir(path):
        if name.startswith(".part-"):
            os.unlink(os.path.join(path, name))
    return {"rows": sum(r["rows"] for r in reports)}
