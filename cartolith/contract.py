"""Layer contracts: schema, geometry and CRS, carried as field metadata.

Any expression drops a field's metadata, so a geometry column is always put in place by :func:`with_geometry`.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from .crs import MISSING, Crs
from .errors import EdgeError
from .functions.wkb import CODES

GEOMETRY, VERSION_KEY, VERSION = "carto.geometry", "carto.contract.version", "1"
DIMENSIONS = ("xy", "xyz", "xym", "xyzm", "unknown")


@dataclass(frozen=True)
class GeometryContract:
    """declaration: exact (types are all there are), mixed (they may be more) or unresolved (none are known)."""

    name: str = "geometry"
    crs: Crs = MISSING
    nullable: bool = True
    encoding: str = "wkb"
    dimensions: str = "unknown"
    semantics: str = "geometry"
    srid: int | None = None
    precision: str = "float64"
    types: tuple[str, ...] = ()
    declaration: str = "unresolved"
    native: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        if self.encoding not in ("wkb", "ewkb") or self.dimensions not in DIMENSIONS or self.semantics not in ("geometry", "geography"):
            raise EdgeError("CONTRACT", "unknown encoding, dimensions or semantics", category="contract")
        if self.precision not in ("float64", "float32", "native") or self.declaration not in ("exact", "mixed", "unresolved"):
            raise EdgeError("CONTRACT", "unknown precision or declaration", category="contract")
        if any(t not in CODES for t in self.types) or list(self.types) != sorted(set(self.types)):
            raise EdgeError("CONTRACT", "geometry types must be known, distinct and in order", category="contract")
        if (self.declaration == "exact") != bool(self.types) and self.declaration != "mixed":
            raise EdgeError("CONTRACT", "an exact declaration lists types, an unresolved one lists none", category="contract")

    def to_dict(self) -> dict:
        out = {k: getattr(self, k) for k in ("name", "nullable", "encoding", "dimensions", "semantics", "srid", "precision", "declaration", "native")}
        return out | {"types": list(self.types), "crs": self.crs.to_dict()}

    @staticmethod
    def from_dict(value: dict) -> GeometryContract:
        crs = value.get("crs") or {}
        own = {k: value[k] for k in ("name", "nullable", "encoding", "dimensions", "semantics", "srid", "precision", "declaration", "native") if k in value}
        return GeometryContract(**own, types=tuple(value.get("types", ())), crs=Crs(crs.get("resolution", "missing"), crs.get("id"), crs.get("definition")))

    def metadata(self) -> dict:
        return {GEOMETRY: json.dumps(self.to_dict(), sort_keys=True), VERSION_KEY: VERSION}


def geometry_of(schema: StructType) -> GeometryContract | None:
    """The contract of a schema's geometry field; there is one at most. Plain binary fields are bytes."""
    found = [f for f in schema.fields if GEOMETRY in (f.metadata or {})]
    if len(found) > 1:
        raise EdgeError("CONTRACT", "more than one geometry column", category="contract")
    if not found:
        return None
    f = found[0]
    if f.metadata.get(VERSION_KEY, VERSION) != VERSION:
        raise EdgeError("CONTRACT", "unknown contract version", category="contract")
    if not isinstance(f.dataType, BinaryType):
        raise EdgeError("CONTRACT", "a geometry column is binary", category="contract")
    return replace(GeometryContract.from_dict(json.loads(f.metadata[GEOMETRY])), name=f.name)


def geometry_field(contract: GeometryContract) -> StructField:
    return StructField(contract.name, BinaryType(), contract.nullable, contract.metadata())


def with_geometry(df: DataFrame, contract: GeometryContract) -> DataFrame:
    """``df`` with the contract on its column of that name; order and values stay."""
    from pyspark.sql import functions as F

    return df.select(*(F.col(f"`{c}`").alias(c, metadata=contract.metadata()) if c == contract.name else F.col(f"`{c}`") for c in df.columns))


@dataclass(frozen=True)
class Layer:
    """A unit of exchange: id, name, schema with the geometry contract in its field, and what the format knows besides."""

    id: int
    name: str
    schema: StructType
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def geometry(self) -> GeometryContract | None:
        return geometry_of(self.schema)

    @property
    def attributes(self) -> list[StructField]:
        return [f for f in self.schema.fields if GEOMETRY not in (f.metadata or {})]

    def to_dict(self) -> dict:
        g = self.geometry
        fields = [{"id": k, "name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for k, f in enumerate(self.schema.fields)]
        return {"id": self.id, "name": self.name, "fields": fields, "geometry": g.to_dict() if g else None}
