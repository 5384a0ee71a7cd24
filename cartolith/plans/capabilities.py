"""Whether a format can hold a set of layers, found out before anything is written; and what it will lose."""

from __future__ import annotations

from pyspark.sql.types import DataType

from ..contract import Layer
from ..crs import root_epsg
from ..errors import EdgeError
from .catalog import Descriptor
from .loss import LossReport

_CLASSES = {
    "boolean": "boolean", "byte": "signed_integer", "short": "signed_integer", "integer": "signed_integer", "long": "signed_integer", "float": "floating", "double": "floating", "string": "utf8",
    "binary": "binary", "date": "temporal", "timestamp": "temporal", "timestamp_ntz": "temporal", "time": "temporal", "array": "nested", "struct": "nested", "map": "nested",
}


def type_class(kind: DataType, metadata: dict | None = None) -> str:
    """The class of a Spark type; unsigned integers are known by their field's metadata."""
    if metadata and metadata.get("carto.unsigned"):
        return "unsigned_integer"
    name = kind.typeName()
    return "decimal" if name.startswith("decimal") else "temporal" if name.startswith(("interval", "time")) else _CLASSES.get(name, "other")


def _refuse(reason: str, message: str, code: str = "CONTRACT"):
    raise EdgeError(code, f"{reason}: {message}", category="capability", phase="plan")


#: Classes whose cells the text formats can write; other scalars would only fail at the first row, so they are refused.
WRITABLE = {"boolean", "signed_integer", "unsigned_integer", "floating", "utf8"}
_TEXT_FORMATS = {"csv", "geojson", "kml", "xls", "shp", "dxf"}


def validate_write(descriptor: Descriptor, layers: list[Layer], max_columns: int = 4096) -> None:
    """Guards in order; the first that fails decides."""
    w = descriptor.writes
    if not descriptor.available:
        _refuse("unavailable", f"format {descriptor.id} needs {descriptor.required_feature}", "UNSUPPORTED")
    if not layers:
        _refuse("empty_plan", "there is no layer")
    if len(layers) > 1 and not w.multi_layer:
        _refuse("single_layer_sink", "the format holds one layer", "UNSUPPORTED")
    if len({x.name for x in layers}) < len(layers) or not all(x.name for x in layers):
        _refuse("layer_names", "layer names must be there and differ")
    for layer in layers:
        if len(layer.schema.fields) > max_columns:
            _refuse("max_columns", "too many columns", "LIMIT")
        _field_names(descriptor, layer)
        for f in layer.attributes:
            kind = type_class(f.dataType, f.metadata)
            writable = kind in w.types and (descriptor.id not in _TEXT_FORMATS or kind in WRITABLE)
            if not writable and w.attributes != "loss_reported":
                _refuse("type_class", f"the format can't hold {kind}")
        _geometry(descriptor, layer)


def _field_names(descriptor: Descriptor, layer: Layer) -> None:
    w, names = descriptor.writes, [f.name for f in layer.attributes]
    for name in names:
        if not name or (w.name_bytes and len(name.encode()) > w.name_bytes):
            _refuse("field_name_length", "a field's name is empty or too long")
        if w.name_ascii and not name.isascii():
            _refuse("field_name_ascii", "a field's name is not ASCII")
        if name.lower() in w.reserved:
            _refuse("field_name_reserved", "a field's name is reserved")
    if len({n if w.name_case_sensitive else n.lower() for n in names}) < len(names):
        _refuse("field_name_collision", "fields' names collide")


def _geometry(descriptor: Descriptor, layer: Layer) -> None:
    w, g = descriptor.writes, layer.geometry
    if g is None:
        if descriptor.id not in ("ipc", "csv", "xls"):
            _refuse("geometry_missing", "the format needs a geometry")
        return
    if g.encoding not in w.encodings:
        _refuse("geometry_encoding", "the format can't hold this encoding")
    if g.dimensions not in w.dimensions:
        _refuse("geometry_dimensions", "the format can't hold these dimensions")
    if g.semantics not in w.semantics:
        _refuse("spatial_semantics", "the format can't hold geography")
    if len(g.types) > 1 and not w.mixed_types:
        _refuse("mixed_types", "the format holds one geometry type")
    if g.declaration == "unresolved" and len(w.geometry_types) < 15:
        _refuse("types_undeclared", "the geometry types must be declared")
    if not set(g.types) <= set(w.geometry_types):
        _refuse("geometry_type", "the format can't hold a geometry type")
    crs = g.crs
    if w.crs == "embedded" and crs.resolution != "resolved":
        _refuse("crs", "the format needs a resolved CRS", "CRS_UNRESOLVED" if crs.resolution == "declared" else "CRS_REQUIRED")
    if w.crs not in ("embedded", "embedded_optional", "none") and crs.id != w.crs:
        _refuse("reprojection_required", f"the format is fixed to {w.crs} and nothing is reprojected", "REPROJECTION_REQUIRED")
    if descriptor.id == "gpkg" and crs.epsg is None and not (crs.id or "").partition(":")[2].isdigit():
        _refuse("crs", "the format needs an authority and a whole number")
    present = {"crs_id": crs.epsg, "srid": g.srid, "crs_definition": root_epsg(crs.definition) if crs.definition else None}
    codes = {v for v in present.values() if v}
    if len(codes) > 1 and any(getattr(w, k) != "preserved" for k, v in present.items() if v):
        _refuse("crs_incoherent", "the CRS's representations disagree and not all would be kept")


def planned_loss(descriptor: Descriptor, layers: list[Layer]) -> LossReport:
    """What writing will lose, known from the contracts alone."""
    report = LossReport()
    for layer in layers:
        g = layer.geometry
        if g:
            have = {"crs_id": g.crs.id, "srid": g.srid, "crs_definition": g.crs.definition}
            for name, value in have.items():
                state = getattr(descriptor.writes, name)
                if value is not None and state != "preserved":
                    report.add(f"{name}_not_preserved_{state}", layer.name)
        for f in layer.attributes:
            kind = type_class(f.dataType, f.metadata)
            if descriptor.id == "kml" and kind != "utf8" or descriptor.id == "gpkg" and f.dataType.typeName() not in ("long", "double", "string", "binary"):
                report.add("attribute_type_coercion", f.name)
            if descriptor.id == "dxf" and f.name != "layer":
                report.add("attribute_dropped", f.name)
            if descriptor.id == "kml" and f.name not in ("name", "description"):
                report.add("attribute_not_read_back", f.name)
            if descriptor.id == "shp" and f.dataType.typeName() == "long":
                report.add("integer_through_double", f.name)
    return report
