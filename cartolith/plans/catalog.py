"""What each format can do, and which format a path belongs to."""

from __future__ import annotations

import importlib
import json
import os
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from ..errors import EdgeError
from ..functions.wkb import CODES

SCALARS = ("boolean", "signed_integer", "unsigned_integer", "floating", "utf8", "binary", "temporal", "decimal")
EVERYTHING = (*SCALARS, "nested", "other")
CLASSIC = tuple(k for k, code in CODES.items() if code <= 7)
ALL_DIMS = ("xy", "xyz", "xym", "xyzm", "unknown")


@dataclass(frozen=True)
class Writes:
    types: tuple[str, ...] = SCALARS
    coercion: str = "reject"  # reject, explicit_text or loss_reported
    attributes: str = "all"  # all or loss_reported
    encodings: tuple[str, ...] = ("wkb",)
    dimensions: tuple[str, ...] = ALL_DIMS
    semantics: tuple[str, ...] = ("geometry",)
    geometry_types: tuple[str, ...] = CLASSIC
    mixed_types: bool = True
    crs: str = "embedded"  # embedded, embedded_optional, none, or the id that is fixed
    crs_id: str = "absent"  # preserved, derived or absent; so the next two
    srid: str = "absent"
    crs_definition: str = "absent"
    multi_layer: bool = False
    name_bytes: int | None = None
    name_ascii: bool = False
    name_case_sensitive: bool = True
    reserved: tuple[str, ...] = ()


@dataclass(frozen=True)
class Descriptor:
    id: str
    extensions: tuple[str, ...]
    read_mode: str = "sequential"
    write_mode: str = "streaming"
    multi_layer: bool = False
    multi_file: bool = False
    concurrency: str = "multiple"
    projection: str = "exact"
    predicate_pruning: str = "none"
    spatial_pruning: str = "none"
    crs_handling: str = "embedded"
    fidelity: str = "conditional"
    source_index: bool = False  # rows can be told by their place in the source
    available: bool = True
    required_feature: str | None = None
    writes: Writes = Writes()


_XYZ = ("xy", "xyz", "unknown")
_SHAPES = ("point", "multipoint", "linestring", "multilinestring", "polygon", "multipolygon")
FORMATS = {d.id: d for d in [
    Descriptor("csv", ("csv",), crs_handling="none", source_index=True, writes=Writes(coercion="explicit_text", crs="none")),
    Descriptor("dxf", ("dxf",), write_mode="buffered", concurrency="single", projection="none", fidelity="approximating", writes=Writes(coercion="loss_reported", attributes="loss_reported", dimensions=_XYZ, crs_id="derived", crs_definition="preserved")),
    Descriptor(
        "filegdb", ("gdb",), read_mode="materializing", multi_layer=True, multi_file=True, concurrency="single", available=False, required_feature="gdal",
        writes=Writes(types=("signed_integer", "floating", "utf8"), dimensions=ALL_DIMS[:4], geometry_types=("point", "multipoint", "multilinestring", "multipolygon"), mixed_types=False, crs_id="derived", crs_definition="derived", multi_layer=True),
    ),
    Descriptor("geojson", ("geojson", "json"), crs_handling="fixed", fidelity="lossless", source_index=True, writes=Writes(dimensions=_XYZ, crs="OGC:CRS84", crs_id="derived")),
    Descriptor("geoparquet", ("parquet",), read_mode="columnar", predicate_pruning="numeric_min_max", spatial_pruning="bbox_statistics", fidelity="lossless", source_index=True, writes=Writes(types=EVERYTHING, crs_id="preserved")),
    Descriptor("gpkg", ("gpkg",), multi_layer=True, spatial_pruning="optional_rtree", writes=Writes(types=("boolean", "signed_integer", "unsigned_integer", "floating", "utf8", "binary"), crs_id="preserved", srid="derived", crs_definition="derived", multi_layer=True, mixed_types=False, name_case_sensitive=False)),
    Descriptor("ipc", ("arrow",), crs_handling="embedded_optional", fidelity="lossless", source_index=True, writes=Writes(types=EVERYTHING, encodings=("wkb", "ewkb"), semantics=("geometry", "geography"), geometry_types=tuple(CODES), crs="embedded_optional", crs_id="preserved", srid="preserved", crs_definition="preserved")),
    Descriptor("kml", ("kml",), concurrency="single", projection="none", crs_handling="fixed", source_index=True, writes=Writes(dimensions=_XYZ, crs="OGC:CRS84", crs_id="derived")),
    Descriptor("shp", ("shp", "shp.d"), multi_file=True, writes=Writes(coercion="explicit_text", geometry_types=_SHAPES, mixed_types=False, crs_id="derived", crs_definition="preserved", name_bytes=10, name_ascii=True, name_case_sensitive=False)),
    Descriptor("xls", ("xlsx",), write_mode="buffered", concurrency="single", projection="none", crs_handling="none", source_index=True, writes=Writes(coercion="explicit_text", crs="none")),
]}
#: Modules that read and write each format.
MODULES = {"csv": "csv", "dxf": "dxf", "geojson": "geojson", "geoparquet": "geoparquet", "gpkg": "gpkg", "ipc": "ipc", "kml": "kml", "shp": "shapefile", "xls": "xlsx"}


def format_of(path: str) -> Descriptor:
    """The format of a path by its extension alone; content is never sniffed."""
    name = os.path.basename(path.rstrip("/")).lower()
    for d in FORMATS.values():
        if any(name.endswith("." + e) for e in d.extensions):
            return d
    raise EdgeError("UNSUPPORTED", "no format has this extension", category="capability", phase="open")


def driver(descriptor: Descriptor):
    """The module of an available format."""
    if not descriptor.available:
        raise EdgeError("UNSUPPORTED", f"format {descriptor.id} needs {descriptor.required_feature}, which is missing", category="capability", phase="open")
    return importlib.import_module(f"cartolith.sources.{MODULES[descriptor.id]}")


def catalog() -> list[dict]:
    """All descriptors, by id; the same bytes each time."""
    return [asdict(FORMATS[k]) for k in sorted(FORMATS)]


def catalog_json() -> str:
    return json.dumps({"schema": "catalog-v1", "formats": catalog()}, sort_keys=True)


def catalog_frame(spark: SparkSession) -> DataFrame:
    rows = [(d["id"], d["read_mode"], d["write_mode"], d["multi_layer"], d["multi_file"], d["concurrency"], d["projection"], d["predicate_pruning"], d["spatial_pruning"], d["crs_handling"], d["fidelity"], d["available"], d["required_feature"]) for d in catalog()]
    return spark.createDataFrame(rows, "id string, read_mode string, write_mode string, multi_layer boolean, multi_file boolean, concurrency string, projection string, predicate_pruning string, spatial_pruning string, crs_handling string, fidelity string, available boolean, required_feature string")
