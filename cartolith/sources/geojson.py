"""GeoJSON feature collections, feature by feature; keys that stand twice are errors, wanted or not."""

from __future__ import annotations

import io
import itertools
import json
import math
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from ..contract import GeometryContract, Layer, geometry_field
from ..crs import CRS84, resolved
from ..errors import EdgeError
from ..functions import geojson, wkb
from ..operators.infer import TYPES, lattice, value_as, value_class
from .base import load, write_text

_DECODER = json.JSONDecoder(object_pairs_hook=geojson._no_twins, parse_constant=lambda _: (_ for _ in ()).throw(EdgeError("FORMAT", "not JSON")))


#: Letters read at once, and the most that one value may take; bytes of a piece of a file with a feature on each line, and
#: of what stands before its first feature and after its last.
CHUNK, MOST, PIECE_BYTES, EDGE_BYTES = 4 << 20, 64 << 20, 4 << 20, 1 << 16


class _Text:
    """A file's text, of which only the part that is being parsed is held."""

    def __init__(self, read) -> None:
        self.read, self.text, self.at, self.ended = read, "", 0, False

    def more(self) -> bool:
        if self.ended:
            return False
        got = self.read(CHUNK)
        if len(self.text) - self.at > MOST:
            raise EdgeError("LIMIT", "a value is too large", category="resource")
        self.text, self.at, self.ended = self.text[self.at :] + got, 0, not got
        return bool(got)

    def peek(self) -> str:
        """The next letter that is not blank, or nothing at the end."""
        while True:
            while self.at < len(self.text):
                if self.text[self.at] not in " \t\r\n":
                    return self.text[self.at]
                self.at += 1
            if not self.more():
                return ""

    def expect(self, marks: str) -> None:
        if self.peek() not in marks or not self.peek():
            raise EdgeError("FORMAT", "not JSON")
        self.at += 1

    def follow(self, end: str) -> None:
        """Go past a comma that something follows, or stay before the end."""
        if self.peek() == ",":
            self.at += 1
            if self.peek() != end:
                return
        elif self.peek() == end:
            return
        raise EdgeError("FORMAT", "not JSON")

    def value(self):
        self.peek()
        while True:
            try:
                found, end = _DECODER.raw_decode(self.text, self.at)
                if end < len(self.text) or not self.more():  # a number might go on
                    self.at = end
                    return found
            except ValueError:
                if not self.more():
                    raise EdgeError("FORMAT", "not JSON") from None


def parsed(read):
    """The features of a text, parsed one at a time."""
    text, seen = _Text(read), set()
    text.expect("{")
    while text.peek() and text.peek() != "}":
        key = text.value()
        if key in seen:
            raise EdgeError("FORMAT", "a key stands twice")
        seen.add(key)
        text.expect(":")
        if key != "features":
            found = text.value()
            if key == "type" and found != "FeatureCollection":
                raise EdgeError("FORMAT", "not a feature collection")
        else:
            text.expect("[")
            while text.peek() != "]":
                yield _feature(text.value())
                text.follow("]")
            text.at += 1
        text.follow("}")
    text.expect("}")
    if not {"type", "features"} <= seen:
        raise EdgeError("FORMAT", "not a feature collection")


def _feature(value) -> dict:
    if not isinstance(value, dict) or value.get("type") != "Feature":
        raise EdgeError("FORMAT", "not a feature")
    return value


def line_span(path: str) -> tuple[int, int] | None:
    """The bytes of a file in which each line is a feature, or None where the file does not look like that.

    What stands before and after must make an empty feature collection. Whether the lines are features, only reading
    them tells.
    """
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(EDGE_BYTES)
        f.seek(max(0, size - EDGE_BYTES))
        tail = f.read()
    found = re.match(rb'\s*\{[^\[{]*"features"\s*:\s*\[[ \t\r]*\n', head)
    last = [m for m in re.finditer(rb"\n[ \t]*(?=\][^\]]*$)", tail)]
    if not found or not last:
        return None
    first, end = found.end(), max(0, size - EDGE_BYTES) + last[-1].start() + 1
    if end <= first:
        return None
    try:
        around = io.StringIO((head[:first] + tail[last[-1].start() :]).decode())
        return (first, end) if list(parsed(around.read)) == [] else None
    except (EdgeError, UnicodeDecodeError):
        return None


def line_pieces(span: tuple[int, int]) -> list[list[int]]:
    first, end = span
    n = max(1, -(-(end - first) // PIECE_BYTES))
    edges = [first + (end - first) * k // n for k in range(n + 1)]
    return [[a, b, end] for a, b in zip(edges, edges[1:])]


def lines(path: str, first: int, last: int, end: int, start: int):
    """Features on the lines that begin in a range of bytes; each line but the last of all ends with a comma."""
    with open(path, "rb") as f:
        if first > start:  # the line that goes over the edge belongs to the range before
            f.seek(first - 1)
            f.readline()
        at = f.tell() if first > start else f.seek(first)
        while at < last:
            line = f.readline()
            at += len(line)
            line = line.strip()
            comma = line.endswith(b",")
            if comma != (at < end):
                raise EdgeError("FORMAT", "not JSON")
            try:
                yield _feature(_DECODER.decode((line[:-1] if comma else line).decode()))
            except ValueError:
                raise EdgeError("FORMAT", "not JSON") from None


def features(path: str, piece=None, start: int = 0):
    """The features of a file, or of a piece of one whose lines are features."""
    if piece:
        yield from lines(path, *piece, start)
    else:
        with open(path, encoding="utf-8") as f:
            yield from parsed(f.read)


def _properties(feature: dict) -> dict:
    found = feature.get("properties")
    if found is not None and not isinstance(found, dict):
        raise EdgeError("FORMAT", "properties are an object or null")
    return found or {}


def survey(found) -> dict:
    """Of features how many there are, the classes of their properties, and the types of their geometries."""
    seen: dict[str, set] = {}
    types, n = set(), 0
    for feature in found:
        n += 1
        for key, v in _properties(feature).items():
            seen.setdefault(key, set()).add(value_class(v))
        own = feature.get("geometry")
        if geojson.plain_point(own):
            types.add(("point", "xy"))
            continue
        shape = geojson.parse(own)
        if shape is not None:
            types.add((shape.kind, shape.dims))
    return {"n": n, "seen": {k: sorted(v) for k, v in seen.items()}, "types": sorted(types)}


def _surveyed(spark: SparkSession, path: str, parts: list[list[int]], start: int) -> list[dict] | None:
    """Surveys of a file's pieces, in parallel; None if a line turns out to be no feature."""

    def task(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                try:
                    found = json.dumps(survey(features(path, parts[k], start)))
                except EdgeError as error:
                    if error.code != "FORMAT":
                        raise
                    found = None
                yield pa.RecordBatch.from_arrays([pa.array([found], pa.string())], ["found"])

    got = [r.found for r in spark.range(0, len(parts), 1, len(parts)).mapInArrow(task, "found string").collect()]
    return None if None in got else [json.loads(x) for x in got]


def describe(spark: SparkSession, path: str, options: dict) -> list[Layer]:
    span, extra, found = line_span(path), {}, None
    if span and span[1] - span[0] > PIECE_BYTES:
        parts = line_pieces(span)
        found = _surveyed(spark, path, parts, span[0])
        extra = {"pieces": parts, "counts": [x["n"] for x in found]} if found else {}
    found = found or [survey(features(path))]
    n, most = sum(x["n"] for x in found), options.get("max_rows")
    if most is not None and n > most:
        raise EdgeError("LIMIT", "too many rows", category="resource", phase="open")
    seen: dict[str, set] = {}
    for x in found:
        for key, classes in x["seen"].items():
            seen.setdefault(key, set()).update(classes)
    pairs = {tuple(t) for x in found for t in x["types"]}
    types, dims = {t for t, _ in pairs}, {d for _, d in pairs}
    kinds = {k: lattice(v) for k, v in sorted(seen.items())}
    name = "geometry" if "geometry" not in kinds else "_geometry"
    contract = GeometryContract(name, resolved(CRS84), True, "wkb", dims.pop() if len(dims) == 1 else "unknown", types=tuple(sorted(types)), declaration="exact" if types else "unresolved")
    return [Layer(0, "geojson", StructType([geometry_field(contract), *(StructField(k, TYPES[v], True) for k, v in kinds.items())]), {"kinds": kinds, **extra})]


def pieces(path: str, plan: dict, extra: dict) -> list:
    """(piece, number of features before it), or one piece for a file that must be read in a row."""
    if "pieces" not in extra:
        return [[None, 0, 0]]
    before = [0, *itertools.accumulate(extra["counts"])]
    return [[p, n, extra["pieces"][0][0]] for p, n in zip(extra["pieces"], before)]


def rows(path: str, plan: dict, extra: dict, piece):
    kinds, wanted = extra["kinds"], set(plan["wanted"])
    name, keys = plan["names"][0], [k for k in plan["names"][1:-1]]
    part, before, start = piece
    text = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    for n, feature in enumerate(features(path, part, start), before):
        found, own = feature.get("geometry"), _properties(feature)
        cell = geojson.plain_point(found)
        if cell is None and (shape := geojson.parse(found)) is not None:
            cell = wkb.encode(shape)
        values = [value_as(own.get(k), kinds[k], text) if k in wanted else None for k in keys]
        yield (cell if name in wanted else None, *values, n)


def read(spark: SparkSession, path: str, layer: Layer, options: dict, columns: list[str] | None = None, index: bool = False) -> DataFrame:
    return load(spark, "geojson", path, layer, options, columns, index)


def write(spark: SparkSession, frames: list[tuple[Layer, DataFrame]], path: str, options: dict) -> dict:
    layer, df = frames[0]
    g, names = layer.geometry, [f.name for f in layer.attributes]

    def member(v):
        if isinstance(v, float) and not math.isfinite(v):
            raise EdgeError("DATA_MAPPING", "not a finite number", phase="write")
        if v is not None and not isinstance(v, (bool, int, float, str)):
            raise EdgeError("DATA_MAPPING", "the format has no value for this type", phase="write")
        return v

    def members(column: pa.Array) -> list:
        values = column.to_pylist()
        return values if pa.types.is_string(column.type) or pa.types.is_integer(column.type) or pa.types.is_boolean(column.type) else [member(v) for v in values]

    def shapes(cells: pa.Array) -> list[str]:
        plain = wkb.plain_points(cells)
        if plain is not None:
            return [f'{{"type":"Point","coordinates":[{x!r},{y!r}]}}' for x, y in zip(*(c.tolist() for c in plain))]
        return ["null" if c is None else geojson.dumps(wkb.decode(c)) for c in cells.to_pylist()]

    def texts(batch: pa.RecordBatch) -> str:
        columns = [members(batch.column(batch.schema.get_field_index(n))) for n in names]
        encode = json.JSONEncoder(ensure_ascii=False, allow_nan=False, separators=(",", ":")).encode
        own = [encode(dict(zip(names, row))) for row in zip(*columns)] if names else ["{}"] * batch.num_rows
        cells = shapes(batch.column(batch.schema.get_field_index(g.name)))
        return ",".join([f'\n{{"type":"Feature","geometry":{shape},"properties":{row}}}' for shape, row in zip(cells, own)])

    return write_text(df, path, texts, '{"type":"FeatureCollection","features":[', ",", "\n]}\n")
