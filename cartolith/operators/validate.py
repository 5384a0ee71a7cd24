"""Row-level validation against a contract, as a DataFrame of violations, and bounded diagnostics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..contract import GEOMETRY, geometry_of
from ..errors import EdgeError
from ..functions.udfs import wkb_inspect

EXAMPLES = 64
NULLABILITY, INVALID, DIMENSIONS, ENCODING, KIND = "contract.nullability", "conversion.invalid_geometry", "contract.coordinate_dimensions", "contract.geometry_encoding", "contract.geometry_type"


def violation(schema: StructType, actual: StructType | None = None) -> Column:
    """The first cause for which a row violates the contract of ``schema``, or null."""
    contract, tests = geometry_of(schema), []
    for f in schema.fields:
        if not f.nullable and GEOMETRY not in (f.metadata or {}):
            tests.append((F.col(f"`{f.name}`").isNull(), NULLABILITY))
    if contract:
        g = F.col(f"`{contract.name}`")
        found = wkb_inspect(g)
        if not contract.nullable:
            tests.append((g.isNull(), NULLABILITY))
        tests.append((found["valid"] == False, INVALID))  # noqa: E712
        tests.append((found["coherent"] == False, DIMENSIONS))  # noqa: E712
        if contract.dimensions != "unknown":
            tests.append((found["dims"] != contract.dimensions, DIMENSIONS))
        if contract.encoding == "wkb":
            tests.append((found["contains_srid"], ENCODING))
        elif contract.srid is not None:
            tests.append((F.coalesce(found["srid"] != contract.srid, F.lit(False)), ENCODING))
        if contract.declaration == "exact":
            tests.append((~found["kind"].isin(*contract.types), KIND))
    cause = F.lit(None).cast("string")
    for test, name in reversed(tests):
        cause = F.when(F.coalesce(test, F.lit(False)), name).otherwise(cause)
    return cause


@dataclass(frozen=True)
class Diagnostics:
    """Counts by cause that add up to the total, and examples by zero-based source row, EXAMPLES at most.

    scan: complete, partial (it stopped early) or unknown (rows can't be told apart, so there are no examples).
    """

    direction: str
    scan: str
    total: int
    counts: dict[str, int]
    examples: list[dict] = field(default_factory=list)
    not_attempted: int | None = None

    def validate(self) -> Diagnostics:
        if sum(self.counts.values()) != self.total or len(self.examples) > EXAMPLES or any(n <= 0 for n in self.counts.values()):
            raise EdgeError("CONTRACT", "diagnostics don't add up", category="contract")
        if self.scan == "unknown" and self.examples or self.direction == "write" and self.scan == "complete" and self.total:
            raise EdgeError("CONTRACT", "diagnostics claim more than was seen", category="contract")
        rows = [e["row"] for e in self.examples]
        if rows != sorted(rows) or any(e["cause"] not in self.counts for e in self.examples):
            raise EdgeError("CONTRACT", "examples don't match the counts", category="contract")
        return self

    def to_dict(self) -> dict:
        return {"schema": "diagnostics-v1", "direction": self.direction, "scan": self.scan, "observed_total": self.total, "counts": self.counts, "examples": self.examples, "not_attempted": self.not_attempted}


def violations(df: DataFrame, schema: StructType | None = None, index: str | None = None) -> DataFrame:
    """(row, cause) of every row that violates the contract; row is null unless ``index`` names the source row."""
    cause = violation(schema or df.schema)
    row = F.col(index).cast("long") if index else F.lit(None).cast("long")
    return df.select(row.alias("row"), cause.alias("cause")).where("cause is not null")


def diagnose(
    df: DataFrame, schema: StructType | None = None, index: str | None = None, direction: str = "read", examples: int = EXAMPLES, key_field: str | None = None, key_policy: str | None = None
) -> Diagnostics | None:
    """Diagnostics of a whole scan, or None if all rows pass. Counts meet as partial sums; examples are a top-k.

    examples: how many, 1 to EXAMPLES. key_field names a column whose value tells a row to its owner, and key_policy
    whether examples show it (emit) or only that it is there (redact); one without the other is an error.
    """
    if not 1 <= examples <= EXAMPLES or (key_field is None) != (key_policy is None) or key_policy not in (None, "emit", "redact"):
        raise EdgeError("USAGE", "examples are 1 to 64, and key_field and key_policy go together", category="usage")
    if key_field is not None and key_field not in df.columns:
        raise EdgeError("CONTRACT", "there is no such field", category="contract")
    key = F.lit(None).cast("string") if key_field is None else F.col(f"`{key_field}`").cast("string")
    cause, row = violation(schema or df.schema), F.col(index).cast("long") if index else F.lit(None).cast("long")
    found = df.select(row.alias("row"), cause.alias("cause"), key.alias("key")).where("cause is not null")
    counts = {r.cause: r.n for r in found.groupBy("cause").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    shown = lambda r: {"row": r.row, "cause": r.cause} | ({} if key_field is None else {"key": r.key if key_policy == "emit" else "redacted"})
    listed = [shown(r) for r in found.orderBy("row", "cause").limit(examples).collect()] if index else []
    scan = "partial" if direction == "write" else "complete" if index else "unknown"
    return Diagnostics(direction, scan, sum(counts.values()), dict(sorted(counts.items())), listed).validate()


def first_examples(found: DataFrame, n: int = EXAMPLES) -> DataFrame:
    """Of (row, cause) the first ``n`` rows of each cause; each partition keeps its own first ones before they meet."""
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("row"))
    some = found.withColumn("part", F.spark_partition_id()).withColumn("nth", nth("part", "cause")).where(F.col("nth") <= n).drop("part")
    return some.withColumn("nth", nth("cause")).where(F.col("nth") <= n)


def geometry_types(df: DataFrame, column: str) -> list[tuple[str, str]]:
    """Distinct kinds and dimensions in a whole column."""
    found = df.select(wkb_inspect(F.col(f"`{column}`")).alias("g")).where("g.valid").groupBy("g.kind", "g.dims").agg(F.sum("g.components").alias("n"))
    return sorted((r.kind, r.dims) for r in found.collect())
