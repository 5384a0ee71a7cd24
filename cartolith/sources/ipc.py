"""Arrow IPC files: batches pass through, a partition for each; any contract can be kept."""

from __future__ import annotations

import itertools
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from ..contract import GEOMETRY, VERSION, VERSION_KEY, GeometryContract, Layer, geometry_field
from ..crs import MISSING, resolved
from ..errors import EdgeError
from .base import load, write_one

_EXTENSION, _EXTENSION_DATA = b"ARROW:extension:name", b"ARROW:extension:metadata"


def _contract(f: pa.Field) -> GeometryContract | None:
    meta = f.metadata or {}
    if GEOMETRY.encode() in meta:
        if meta.get(VERSION_KEY.encode(), VERSION.encode()) != VERSION.encode():
            raise EdgeError("CONTRACT", "unknown contract version", category="contract", phase="open")
        return GeometryContract.from_dict(json.loads(meta[GEOMETRY.encode()]))
    if meta.get(_EXTENSION) == b"geoarrow.wkb":
        own = json.loads(meta.get(_EXTENSION_DATA) or b"{}")
        crs = meta.get(b"crs", b"").decode() or own.get("crs")
        return GeometryContract(f.name, resolved(crs) if isinstance(crs, str) and ":" in crs else MISSING)
    return None


def describe(spark: SparkSession, path: str, options: dict) -> list[Layer]:
    with pa.memory_map(path) as source:
        reader = pa.ipc.open_file(source)
        schema, n = reader.schema, sum(reader.get_batch(k).num_rows for k in range(reader.num_record_batches))
    shapes = {f.name: c for f in schema if (c := _contract(f))}
    if len(shapes) > 1:
        raise EdgeError("CONTRACT", "more than one geometry column", category="contract", phase="open")
    plain = from_arrow_schema(pa.schema([pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type, f.nullable) for f in schema]))
    fields = []
    for f in plain.fields:
        if f.name in shapes:
            if not isinstance(f.dataType, BinaryType):
                raise EdgeError("CONTRACT", "a geometry column is binary", category="contract", phase="open")
            f = geometry_field(shapes[f.name])
        fields.append(f)
    return [Layer(0, "ipc", StructType([StructField(f.name, f.dataType, f.nullable, f.metadata) for f in fields]), {"rows": n})]


def pieces(path: str, plan: dict, extra: dict) -> list:
    """Batches, each with the number of rows before it."""
    with pa.memory_map(path) as source:
        reader = pa.ipc.open_file(source)
        sizes = [reader.get_batch(k).num_rows for k in range(reader.num_record_batches)]
    return [[k, n] for k, n in enumerate([0, *itertools.accumulate(sizes)][: len(sizes)])] or [[-1, 0]]


def rows(path: str, plan: dict, extra: dict, piece: list[int]):
    piece, first = piece
    with pa.memory_map(path) as source:
        reader = pa.ipc.open_file(source)
        if piece < 0:
            return
        batch, wanted = reader.get_batch(piece), set(plan["wanted"])
        columns = [batch.column(k).to_pylist() if n in wanted else [None] * batch.num_rows for k, n in enumerate(batch.schema.names)]
        yield from zip(*columns, range(first, first + batch.num_rows))


def read(spark: SparkSession, path: str, layer: Layer, options: dict, columns: list[str] | None = None, index: bool = False) -> DataFrame:
    return load(spark, "ipc", path, layer, options, columns, index)


def write(spark: SparkSession, frames: list[tuple[Layer, DataFrame]], path: str, options: dict) -> dict:
    layer, df = frames[0]
    g = layer.geometry
    schema = []
    for f in to_arrow_schema(layer.schema):
        if g and f.name == g.name:
            meta = {k: str(v) for k, v in g.metadata().items()} | {_EXTENSION.decode(): "geoarrow.wkb"} | ({"crs": g.crs.id} if g.crs.id else {})
            f = f.with_metadata(meta)
        schema.append(f)
    schema = pa.schema(schema)

    def task(batches):
        n = 0
        with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, schema) as out:
            for batch in batches:
                out.write_table(pa.Table.from_batches([batch]).cast(schema))
                n += batch.num_rows
        return {"rows": n}

    return write_one(df, task)
