"""The Spark data source that all row-oriented formats share, and single-file sinks."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..contract import Layer, with_geometry
from ..errors import EdgeError, guarded_rows
from ..limits import BATCH_BYTES, Limits, initial_batch_rows, next_batch_rows

INDEX = "_source_row"


class Piece(InputPartition):
    """A part of a file that is read on its own."""

    def __init__(self, value) -> None:
        super().__init__(value)


class EdgeSource(DataSource):
    """``spark.read.format("cartolith")`` with options format, path, layer, columns and those of the format."""

    @classmethod
    def name(cls) -> str:
        return "cartolith"

    def reader(self, schema: StructType) -> EdgeReader:
        return EdgeReader(schema, dict(self.options))


class EdgeReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options = schema, options

    def _module(self):
        from ..plans.catalog import FORMATS, driver

        return driver(FORMATS[self.options["format"]])

    def partitions(self) -> list[Piece]:
        return [Piece(p) for p in self._module().pieces(self.options["path"], json.loads(self.options["plan"]), json.loads(self.options["extra"]))]

    def read(self, partition: Piece):
        yield from guarded_rows("read", self._batches(partition.value))

    def _batches(self, piece):
        """Batches sized by bytes: the first by estimate, the next by what the one before took."""
        from pyspark.sql.pandas.types import to_arrow_schema

        plan, kind = json.loads(self.options["plan"]), to_arrow_schema(self.schema)
        names, places = plan["names"], None
        size = initial_batch_rows(self.schema)
        rows: list[tuple] = []
        seen = 0
        for row in self._module().rows(self.options["path"], plan, json.loads(self.options["extra"]), piece):
            if places is None:
                places = [names.index(f.name) for f in self.schema.fields]
            seen += 1
            if seen > plan.get("max_rows", Limits().max_rows):
                raise EdgeError("LIMIT", "too many rows", category="resource")
            rows.append(row)
            if len(rows) >= size:
                batch = _batch(rows, places, kind)
                size = next_batch_rows(len(rows), batch.nbytes, BATCH_BYTES)
                yield batch
                rows = []
        if rows:
            yield _batch(rows, places, kind)


def _batch(rows: list[tuple], places: list[int], kind: pa.Schema) -> pa.RecordBatch:
    if not places:
        return pa.RecordBatch.from_struct_array(pa.array([{}] * len(rows), pa.struct([])))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in zip(places, kind)], schema=kind)


def load(spark: SparkSession, fmt: str, path: str, layer: Layer, options: dict, columns: list[str] | None = None, index: bool = False) -> DataFrame:
    """A layer as a DataFrame; columns not asked for are never converted."""
    from pyspark.sql.types import LongType, StructField

    spark.dataSource.register(EdgeSource)
    fields = [f for f in layer.schema.fields if columns is None or f.name in columns]
    own = StructType([StructField(f.name, f.dataType, True) for f in fields] + ([StructField(INDEX, LongType())] if index else []))
    if not own.fields:
        return load(spark, fmt, path, layer, options, [layer.schema.fields[0].name]).select()
    names = [f.name for f in layer.schema.fields] + [INDEX]
    plan = {"names": names, "wanted": [f.name for f in fields], "layer": layer.name, **{k: v for k, v in options.items() if isinstance(v, (str, int, float, bool, list))}}
    df = spark.read.format("cartolith").schema(own).option("format", fmt).option("path", path).option("plan", json.dumps(plan)).option("extra", json.dumps(layer.extra)).load()
    return with_geometry(df, layer.geometry) if layer.geometry and any(f.name == layer.geometry.name for f in fields) else df


def in_order(df: DataFrame) -> DataFrame:
    """``df`` in one partition with its rows in order; what comes before still runs in parallel."""
    at = "__place"
    return df.withColumn(at, F.monotonically_increasing_id()).repartition(1).sortWithinPartitions(at).drop(at)


def write_one(df: DataFrame, write) -> dict:
    """Run ``write(batches) -> dict`` over all rows in one task, in order; what it returns comes back.

    The formats that need it are single files; a lost executor only means that the task writes its file again.
    """
    def task(batches):
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(write(batches))])], ["report"])

    return json.loads(in_order(df).mapInArrow(task, "report string").first().report)


def write_text(df: DataFrame, path: str, texts, head: str = "", between: str = "", tail: str = "") -> dict:
    """Write a text file whose rows are put into words in parallel, by ``texts(batch) -> str``, and joined in order by one task."""

    def worded(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([texts(batch).encode()], pa.binary())], ["n", "body"])

    def task(batches):
        n = 0
        with open(path, "wb") as f:
            f.write(head.encode())
            for batch in batches:
                for rows, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                    f.write((between.encode() if n else b"") + body.as_py())
                    n += rows
            f.write(tail.encode())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return {"rows": in_order(df.mapInArrow(worded, "n long, body binary")).mapInArrow(task, "n long").first().n}


def text_column(column: pa.Array) -> list[str]:
    """A column's values as the text formats write them, null as nothing."""
    kind = column.type
    if pa.types.is_string(kind):
        return column.fill_null("").to_pylist()
    if pa.types.is_integer(kind):
        return column.cast(pa.string()).fill_null("").to_pylist()
    return ["" if v is None else text_of(v) for v in column.to_pylist()]


def dicts(batches):
    for batch in batches:
        yield from batch.to_pylist()


def text_of(value) -> str:
    """A value as the text formats write it."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if value - value != 0:
            raise EdgeError("DATA_MAPPING", "not a finite number", phase="write")
        return repr(value)
    if isinstance(value, (int, str)):
        return str(value)
    raise EdgeError("DATA_MAPPING", "the format has no text for this type", phase="write")
