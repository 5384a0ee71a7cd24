"""Projection and pruning: hints that let a scan skip what can't match, and never drop what could."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..contract import geometry_of
from ..errors import EdgeError

#: The covering columns of a geometry column, hidden from readers.
COVERING = ("_bbox_minx", "_bbox_miny", "_bbox_maxx", "_bbox_maxy")
_OPERATORS = (">=", "<=", "==", ">", "<", "=")
_WHOLE, _REAL = {"byte", "short", "integer", "long"}, {"float", "double"}


def project(df: DataFrame, wanted: list[str | int] | None, mode: str = "required", supported: bool = True) -> DataFrame:
    """Columns by name or field id, once each, in the schema's order; none at all keeps the rows.

    required: an unknown column, or a format that can't project exactly, is an error; best_effort ignores both.
    """
    if wanted is None:
        return df
    if not supported:
        if mode == "required":
            raise EdgeError("PROJECTION_UNSUPPORTED", "the format reads all columns", category="capability")
        return df
    names = set()
    for w in wanted:
        name = df.columns[w] if isinstance(w, int) and 0 <= w < len(df.columns) else w
        if name in df.columns:
            names.add(name)
        elif mode == "required":
            raise EdgeError("CONTRACT", "there is no such field", category="contract")
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c in names))


@dataclass(frozen=True)
class NumericHint:
    field: str
    op: str
    value: int | float

    def column(self, schema: StructType) -> Column | None:
        """The predicate, or None where the hint can't be used: unknown field, or a whole number against reals or so."""
        found = [f for f in schema.fields if f.name == self.field]
        if len(found) != 1 or self.op not in _OPERATORS or self.value != self.value:
            return None
        kinds = _WHOLE if isinstance(self.value, int) else _REAL
        if found[0].dataType.typeName() not in kinds:
            return None
        c, v = F.col(f"`{self.field}`"), F.lit(self.value)
        return {">=": c >= v, "<=": c <= v, ">": c > v, "<": c < v, "=": c == v, "==": c == v}[self.op]


def parse_predicate(text: str) -> NumericHint | None:
    """``column OP literal``; whatever doesn't read like that is no hint."""
    for op in _OPERATORS:
        left, found, right = text.partition(op)
        if not found:
            continue
        name, literal = left.strip(), right.strip()
        if not name or not re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", literal):
            return None
        return NumericHint(name, op, int(literal) if re.fullmatch(r"[-+]?\d+", literal) else float(literal))
    return None


def prune_numeric(df: DataFrame, hint: NumericHint | str | None) -> DataFrame:
    """Rows that may match a hint; Spark pushes it to row groups' statistics. Rows it can't judge stay, nulls don't match."""
    hint = parse_predicate(hint) if isinstance(hint, str) else hint
    predicate = None if hint is None else hint.column(df.schema)
    return df if predicate is None else df.where(predicate)


def prune_bbox(df: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    """Rows whose covering meets a box, edges included; a geometry of unknown extent always stays.

    Needs the covering columns; without them, or with a box that isn't finite and in order, all rows stay.
    """
    if box is None or not set(COVERING) <= set(df.columns) or any(v - v != 0 for v in box) or box[0] > box[2] or box[1] > box[3]:
        return df
    meets = (F.col(COVERING[0]) <= box[2]) & (F.col(COVERING[2]) >= box[0]) & (F.col(COVERING[1]) <= box[3]) & (F.col(COVERING[3]) >= box[1])
    contract = geometry_of(df.schema)
    unknown = F.col(COVERING[0]).isNull()
    if contract:
        unknown &= F.col(f"`{contract.name}`").isNotNull()
    return df.where(meets | unknown)


def read_summary(df: DataFrame, batch_rows: int, limit: int | None = None) -> dict:
    """Rows and batches read until ``limit`` rows are there: whole batches, so more may be read than asked for."""
    if limit == 0:
        return {"rows_read": 0, "batches": 0, "truncated": True}
    most = None if limit is None else -(-limit // batch_rows) * batch_rows
    n = df.count() if most is None else df.limit(most + 1).count()
    if most is not None and n > most:
        return {"rows_read": most, "batches": most // batch_rows, "truncated": True}
    return {"rows_read": n, "batches": -(-n // batch_rows), "truncated": False}
