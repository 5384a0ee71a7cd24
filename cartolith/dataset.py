"""Opening, reading and inspecting datasets."""

from __future__ import annotations

import threading
from contextlib import nullcontext
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .contract import Layer
from .errors import EdgeError, guarded
from .limits import BATCH_BYTES, BATCH_ROWS, Budget, Cancellation, Limits, initial_batch_rows, next_batch_rows
from .operators import prune
from .operators.validate import EXAMPLES, Diagnostics, diagnose
from .plans.catalog import Descriptor, driver, format_of
from .plans.loss import LossReport, fidelity
from .plans.publish import preflight


@dataclass(frozen=True)
class ReadRequest:
    """What to read: columns by name or id, hints that may skip rows that can't match, and how far to go."""

    layer: int | str = 0
    columns: tuple | None = None
    mode: str = "required"
    predicate: str | prune.NumericHint | None = None
    bbox: tuple[float, float, float, float] | None = None
    source_index: bool = False
    limit: int | None = None
    batch_bytes: int = BATCH_BYTES
    batch_rows: int = BATCH_ROWS


@dataclass
class Dataset:
    """An opened dataset: its format, its layers' contracts, and no rows."""

    spark: SparkSession
    path: str
    descriptor: Descriptor
    layers: list[Layer]
    options: dict
    limits: Limits
    gate: threading.Lock = field(default_factory=threading.Lock)
    cancellation: Cancellation = field(default_factory=Cancellation)
    budget: Budget | None = None

    def layer(self, key: int | str = 0) -> Layer:
        for x in self.layers:
            if key in (x.id, x.name):
                return x
        raise EdgeError("CONTRACT", "there is no such layer", category="contract", phase="open")

    def read(self, request: ReadRequest = ReadRequest()) -> DataFrame:
        """A lazy DataFrame of one layer; formats without exact projection read all columns."""
        self.cancellation.check()
        layer = self.layer(request.layer)
        exact = self.descriptor.projection == "exact"
        names = None
        if request.columns is not None:
            if not exact and request.mode == "required":
                raise EdgeError("PROJECTION_UNSUPPORTED", "the format reads all columns", category="capability")
            known = [f.name for f in layer.schema.fields]
            picked = [known[c] if isinstance(c, int) and 0 <= c < len(known) else c for c in request.columns]
            if request.mode == "required" and not set(picked) <= set(known):
                raise EdgeError("CONTRACT", "there is no such field", category="contract")
            names = [n for n in known if n in picked] if exact else None
        options, hint = dict(self.options), request.predicate
        needed = names
        if self.descriptor.id == "geoparquet":
            hint = prune.parse_predicate(hint) if isinstance(hint, str) else hint
            if request.bbox is not None:
                options["with_covering"] = True
            if names is not None and (hint is not None or request.bbox is not None):  # hints look at columns not asked for
                needed = [f.name for f in layer.schema.fields if f.name in names or (hint and f.name == hint.field) or (request.bbox and layer.geometry and f.name == layer.geometry.name)]
        if self.descriptor.id == "gpkg" and request.bbox is not None:
            options["bbox"] = ",".join(map(repr, request.bbox))
        index = request.source_index and self.descriptor.source_index and hint is None and request.bbox is None
        df = driver(self.descriptor).read(self.spark, self.path, layer, options, needed, index)
        if self.descriptor.id == "geoparquet":
            df = prune.prune_bbox(prune.prune_numeric(df, hint), request.bbox)
            keep = [f.name for f in layer.schema.fields if names is None or f.name in names] + (["_source_row"] if index else [])
            df = df.select(*(df[f"`{c}`"] for c in keep))
        return df

    def open_reader(self, request: ReadRequest = ReadRequest()):
        """Arrow record batches of a layer, one reader at a time where the format allows one only.

        A partition's batches come to the driver one partition at a time, and are sliced anew to the size asked for: the
        first by estimate, each next one by the bytes of the one before. The token is looked at before each batch, the
        budget's memory is leased for the batch that is out, and a request's limit ends the read after a whole batch.
        """
        if self.descriptor.concurrency == "single" and not self.gate.acquire(blocking=False):
            raise EdgeError("READER_BUSY", "another reader is open", category="conflict", retry="later")

        def batches():
            token = self.cancellation.child(self.budget.duration_s if self.budget else None)
            seen = 0
            try:
                with self.budget.lease("concurrency") if self.budget else nullcontext():
                    df = self.read(request)
                    size = initial_batch_rows(df.schema, request.batch_bytes, request.batch_rows)
                    for batch in resliced(arrow_batches(df), size, request):
                        token.check()
                        with self.budget.lease("memory_bytes", batch.nbytes) if self.budget else nullcontext():
                            yield batch
                        seen += batch.num_rows
                        if request.limit is not None and seen >= request.limit:
                            return
            finally:
                if self.descriptor.concurrency == "single":
                    self.gate.release()

        return batches()

    def read_summary(self, request: ReadRequest = ReadRequest()) -> dict:
        size = initial_batch_rows(self.layer(request.layer).schema, request.batch_bytes, request.batch_rows)
        return prune.read_summary(self.read(request), size, request.limit)

    def diagnose(self, key: int | str = 0, examples: int = EXAMPLES, key_field: str | None = None, key_policy: str | None = None) -> Diagnostics | None:
        """What rows violate the layer's contract, from a scan of all; examples may name rows by a field's value."""
        layer = self.layer(key)
        df = self.read(ReadRequest(layer.id, source_index=True))
        return diagnose(df, layer.schema, "_source_row" if "_source_row" in df.columns else None, examples=examples, key_field=key_field, key_policy=key_policy)

    def losses(self) -> LossReport:
        module, report = driver(self.descriptor), LossReport()
        for layer in self.layers:
            if hasattr(module, "losses"):
                report = report.merge(module.losses(self.path, layer))
        return report

    def inspect(self) -> dict:
        return {
            "schema": "inspect-v1", "format": self.descriptor.id, "fidelity": fidelity(self.descriptor.fidelity, LossReport()).to_dict(),
            "layers": [x.to_dict() for x in self.layers],
        }

    def layers_summary(self) -> dict:
        return {"schema": "layers-v1", "layers": [{"id": x.id, "name": x.name, "crs": x.geometry.crs.id if x.geometry else None, "field_count": len(x.schema.fields)} for x in self.layers]}


def arrow_batches(df: DataFrame):
    """The record batches of a DataFrame, in order; the driver holds one partition's at a time."""

    def packed(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])

    if not df.columns:
        n = df.count()
        yield pa.RecordBatch.from_struct_array(pa.array([{}] * n, pa.struct([])))
        return
    for row in df.mapInArrow(packed, "batch binary").toLocalIterator():
        yield from pa.ipc.open_stream(row.batch)


def resliced(batches, size: int, request: ReadRequest):
    """Batches of ``size`` rows at first, and then of what the bytes of the one before make of it; the last may be smaller."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= size:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            first, rest = whole.slice(0, size), whole.slice(size)
            held = [rest] if rest.num_rows else []
            size = next_batch_rows(first.num_rows, first.nbytes, request.batch_bytes, request.batch_rows)
            yield first
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def open_dataset(spark: SparkSession, path: str, limits: Limits = Limits(), cancellation: Cancellation | None = None, budget: Budget | None = None, **options) -> Dataset:
    """Open a dataset by its extension: size and links are checked, then header, schema and CRS are read.

    A cancelled token stops opening, reading and converting; a budget bounds what readers hold, how many are open and for
    how long, and columns.
    """
    cancellation = cancellation or Cancellation()
    cancellation.check()
    descriptor = format_of(path)
    module = driver(descriptor)
    preflight(path, limits.max_input_bytes if not options.pop("unlimited", False) else None)
    options.setdefault("max_rows", limits.max_rows)
    layers = guarded("open", module.describe, spark, path, options)
    if any(x.extra.get("rows", 0) > limits.max_rows for x in layers):
        raise EdgeError("LIMIT", "too many rows", category="resource", phase="open")
    if any(len(x.schema.fields) > limits.max_columns for x in layers):
        raise EdgeError("LIMIT", "too many columns", category="resource", phase="open")
    if budget:
        for x in layers:
            budget.lease("columns", len(x.schema.fields)).commit()
    cancellation.check()
    return Dataset(spark, path, descriptor, layers, options, limits, cancellation=cancellation, budget=budget)
