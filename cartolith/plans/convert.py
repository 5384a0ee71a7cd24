"""Writing and converting whole datasets: checked, validated, staged, and published all or nothing."""

from __future__ import annotations

import os
from contextlib import ExitStack
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..contract import Layer, geometry_field, geometry_of, with_geometry
from ..dataset import Dataset, ReadRequest, open_dataset
from ..errors import EdgeError
from ..limits import Cancellation, Limits
from ..operators.validate import diagnose, geometry_types
from .capabilities import planned_loss, validate_write
from .catalog import driver, format_of
from .loss import LossReport, end_to_end, fidelity
from .publish import Stage, publish_set


def declare_types(df: DataFrame) -> DataFrame:
    """``df`` with its geometry contract's types and dimensions found out from all rows."""
    contract = geometry_of(df.schema)
    found = geometry_types(df, contract.name)
    dims = {d for _, d in found}
    types = tuple(sorted({k for k, _ in found}))
    return with_geometry(df, replace(contract, types=types, declaration="exact" if types else "unresolved", dimensions=dims.pop() if len(dims) == 1 else "unknown"))


def layer_of(name: str, df: DataFrame, number: int = 0) -> Layer:
    g = geometry_of(df.schema)
    return Layer(number, name, StructType([geometry_field(g) if g and f.name == g.name else f for f in df.schema.fields]))


def write_dataset(spark: SparkSession, layers: dict[str, DataFrame], path: str, validate: bool = True, limits: Limits = Limits(), expected_rows: dict[str, int] | None = None, cancellation: Cancellation | None = None, **options) -> dict:
    """Write layers (DataFrames whose geometry carries its contract) to a new dataset.

    Nothing is visible at ``path`` until all is written. With ``validate`` a scan looks for rows that violate the
    contract first, and the write is refused with their diagnostics. ``expected_rows`` must match what was written, and
    more rows than the limit are not published. A cancelled token ends the write between its steps.
    """
    token = cancellation or Cancellation()
    token.check()
    descriptor = format_of(path)
    plan = [layer_of(name, df, k) for k, (name, df) in enumerate(layers.items())]
    validate_write(descriptor, plan, limits.max_columns)
    frames = list(zip(plan, layers.values()))
    if validate:
        for layer, df in frames:
            found = diagnose(df, layer.schema, direction="write")
            if found:
                raise EdgeError("CONTRACT", "rows violate the contract", category="contract", phase="write", diagnostics=found)
    loose = descriptor.id == "shp" and not path.rstrip("/").lower().endswith(".shp.d")
    with ExitStack() as stack:
        stage = stack.enter_context(Stage(path, limits.max_output_bytes))
        token.check()
        report = driver(descriptor).write(spark, frames, stage.path, options)
        token.check()
        if report["rows"] > limits.max_rows:
            raise EdgeError("LIMIT", "too many rows", category="resource", phase="write")
        if expected_rows is not None and sum(expected_rows.values()) != report["rows"]:
            raise EdgeError("CONTRACT", "the declared total does not match the rows written", category="contract", phase="publish")
        if loose:
            base, parts = path[:-4], []
            for suffix in (".dbf", ".shx", ".prj", ".shp"):
                part = stack.enter_context(Stage(base + suffix if suffix != ".shp" else path, limits.max_output_bytes))
                os.rename(os.path.join(stage.path, "data" + suffix), part.path)
                parts.append(part)
            published = publish_set(parts)
        else:
            published = stage.publish()
    losses = planned_loss(descriptor, plan)
    return {"rows": report["rows"], **published, "fidelity": fidelity(descriptor.fidelity, losses).to_dict(), "losses": losses.to_dict()}


def convert(spark: SparkSession, source: str, target: str, layer: int | str | None = None, validate: bool = True, source_options: dict | None = None, limits: Limits = Limits(), cancellation: Cancellation | None = None, **options) -> dict:
    """Transcode a dataset, all layers or one; nothing is published unless every row of every layer passes.

    Types that the source leaves open are found out from its rows, so that the target's checks can judge them.
    """
    dataset: Dataset = open_dataset(spark, source, limits, cancellation, **(source_options or {}))
    chosen = dataset.layers if layer is None else [dataset.layer(layer)]
    if len(chosen) > 1 and not format_of(target).writes.multi_layer:
        raise EdgeError("UNSUPPORTED", "SINGLE_LAYER_SINK: the target holds one layer", category="capability", phase="plan")
    frames: dict[str, DataFrame] = {}
    for x in chosen:
        df = dataset.read(ReadRequest(x.id))
        if x.geometry and x.geometry.declaration == "unresolved":
            df = declare_types(df)
        frames[x.name] = df
    written = write_dataset(spark, frames, target, validate, limits, cancellation=cancellation, **options)
    seen = dataset.losses()
    read_side = fidelity(dataset.descriptor.fidelity, seen)
    write_losses = LossReport(dict(written["losses"]["counts"]), [(e["category"], e["field"]) for e in written["losses"]["examples"]])
    write_side = fidelity(format_of(target).fidelity, write_losses)
    return {
        "schema": "convert-v1", "rows": written["rows"], "bytes": written["bytes"], "outcome": written["outcome"],
        "fidelity": {"read": read_side.to_dict(), "write": write_side.to_dict(), "end_to_end": end_to_end(read_side, write_side).to_dict()},
        "losses": seen.merge(write_losses).to_dict(),
    }


def with_crs(df: DataFrame, crs) -> DataFrame:
    """``df`` whose geometry is declared to be in ``crs``; a declaration, not a reprojection."""
    return with_geometry(df, replace(geometry_of(df.schema), crs=crs))


def loss_frame(spark: SparkSession, report: LossReport) -> DataFrame:
    rows = sorted(report.counts.items())
    return spark.createDataFrame(rows, "category string, n long") if rows else spark.range(0).select(F.lit("").alias("category"), F.col("id").alias("n"))
