"""Type inference of untyped cells: classes per cell, folded to a type per column in one aggregate, never from a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType

from ..errors import EdgeError

#: Whole numbers beyond this can't be told apart as doubles.
EXACT = 1 << 53
INTEGER, NUMBER = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
CLASSES = ("null", "integer", "wide_integer", "number", "boolean", "text")
TYPES: dict[str, DataType] = {"integer": LongType(), "number": DoubleType(), "boolean": BooleanType(), "text": StringType()}


def classify(cell: Column, names=lambda name: name) -> Column:
    """The class of a text cell: null (blank), integer, wide_integer (beyond 2^53), number, boolean or text.

    Whole numbers that don't fit 64 bits stay text rather than lose digits; so do NaN and infinities, and decimals that
    overflow a double. ``names`` gives what stands for a class in the result, its name if not told otherwise.
    """
    t = F.trim(cell)
    whole, long = t.rlike(INTEGER), t.try_cast("bigint")
    return (
        F.when(F.coalesce(t == "", F.lit(True)), names("null"))
        .when(whole & long.isNull(), names("text"))
        .when(whole & ((long > EXACT) | (long < -EXACT)), names("wide_integer"))
        .when(whole, names("integer"))
        .when(t.rlike(NUMBER) & (F.abs(t.try_cast("double")) < float("inf")), names("number"))
        .when(F.lower(t).isin("true", "false"), names("boolean"))
        .otherwise(names("text"))
    )


def lattice(seen: set[str]) -> str:
    """The type of a column in which these classes were seen, in any order."""
    seen = seen - {"null"}
    if not seen or "text" in seen:
        return "text"
    if seen <= {"integer", "wide_integer"}:
        return "integer"
    if seen == {"boolean"}:
        return "boolean"
    if "boolean" in seen or {"number", "wide_integer"} <= seen:
        return "text"
    return "number"


#: What the classes count as in a column's set of them, so that sets meet as whole numbers.
_BITS = {c: 1 << k for k, c in enumerate(CLASSES)}


def infer_types(df: DataFrame, columns: list[str] | None = None, kinds=classify, count: bool = False):
    """Inferred types of text columns; one job whatever their number, with a partial aggregate in every task.

    With ``count`` also how many rows there are.
    """
    columns = df.columns if columns is None else columns
    if not columns and not count:
        return {}
    bits = lambda c: F.bit_or(kinds(F.col(f"`{c}`"), _BITS.__getitem__))
    row = df.agg(F.count(F.lit(1)), *(bits(c).alias(f"c{k}") for k, c in enumerate(columns))).first()
    found = {c: lattice({name for name, bit in _BITS.items() if (row[k + 1] or 0) & bit}) for k, c in enumerate(columns)}
    return (found, row[0]) if count else found


def typed(cell: Column, kind: str) -> Column:
    """A cell in its column's type: blank is null in every type, text keeps its outer blanks."""
    t = F.trim(cell)
    value = {"integer": t.try_cast("bigint"), "number": t.try_cast("double"), "boolean": F.lower(t) == "true", "text": cell}[kind]
    return F.when(F.coalesce(t == "", F.lit(True)), None).otherwise(value)


def value_class(value) -> str:
    """The class of a parsed value, as of JSON or a sheet."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "text" if not -(1 << 63) <= value < 1 << 63 else "wide_integer" if abs(value) > EXACT else "integer"
    return "number" if isinstance(value, float) and value - value == 0 else "text"


def value_as(value, kind: str, text):
    """A parsed value in its column's type. ``text`` writes a value that goes into a text column."""
    if value is None:
        return None
    if kind == "text":
        return value if isinstance(value, str) else text(value)
    if kind == "number" and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if kind == "integer" and isinstance(value, int) and not isinstance(value, bool) or kind == "boolean" and isinstance(value, bool):
        return value
    raise EdgeError("DATA_MAPPING", "a value does not fit its column's type")
