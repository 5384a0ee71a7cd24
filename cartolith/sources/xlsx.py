"""XLSX sheets with a WKT column or x and y columns, from the zip archive's XML by events."""

from __future__ import annotations

import datetime
import re
import xml.etree.ElementTree as ET
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from ..contract import GeometryContract, Layer, geometry_field
from ..crs import resolved
from ..errors import EdgeError
from ..functions import wkb, wkt
from ..operators.infer import TYPES, lattice, value_as, value_class
from .base import dicts, load, text_of, write_one
from .csv import _geometry_columns

EXPANSION, EPOCH = 1000, datetime.datetime(1899, 12, 30)
#: Number formats that mean a date or time.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _archive(path: str) -> zipfile.ZipFile:
    try:
        book = zipfile.ZipFile(path)
    except zipfile.BadZipFile:
        raise EdgeError("FORMAT", "not an archive", phase="open") from None
    for item in book.infolist():
        if item.file_size > EXPANSION * max(1, item.compress_size):
            raise EdgeError("LIMIT", "the archive expands too much", category="resource", phase="open")
    return book


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as f:
        return [_text(n) for _, n in ET.iterparse(f) if _local(n.tag) == "si"]


def _dates(book: zipfile.ZipFile) -> list[bool]:
    """Which cell styles show a date."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(n.get("numFmtId")) for n in root.iter() if _local(n.tag) == "numFmt" and re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", n.get("formatCode", "")).lower())}
    styles = next((n for n in root.iter() if _local(n.tag) == "cellXfs"), [])
    return [int(x.get("numFmtId", 0)) in DATE_FORMATS | own for x in styles]


def _sheet_file(book: zipfile.ZipFile, sheet: str | None) -> str:
    root = ET.fromstring(book.read("xl/workbook.xml"))
    sheets = [n for n in root.iter() if _local(n.tag) == "sheet"]
    found = next((s for s in sheets if sheet is None or s.get("name") == sheet), None)
    if found is None:
        raise EdgeError("CONTRACT", "there is no such sheet", category="contract", phase="open")
    target = next(v for k, v in found.attrib.items() if _local(k) == "id")
    links = ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    return "xl/" + next(n.get("Target") for n in links if n.get("Id") == target).removeprefix("/xl/")


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _value(cell, shared: list[str], dates: list[bool]):
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _text(cell)
    raw = next((c.text for c in cell if _local(c.tag) == "v"), None)
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind in ("str", "d"):
        return raw
    if kind == "b":
        return raw == "1"
    number = float(raw)
    style = int(cell.get("s", -1))
    if 0 <= style < len(dates) and dates[style]:
        return (EPOCH + datetime.timedelta(days=number)).isoformat()
    return int(number) if number == int(number) and abs(number) <= 1 << 53 else number


def sheet_rows(path: str, sheet: str | None = None):
    """(row number, cells by column) of the used rows; rows between that hold nothing come as empty ones."""
    with _archive(path) as book:
        shared, dates = _shared(book), _dates(book)
        with book.open(_sheet_file(book, sheet)) as f:
            last = None
            for _, node in ET.iterparse(f):
                if _local(node.tag) != "row":
                    continue
                number = int(node.get("r", (last or 0) + 1))
                cells = {(_column(c.get("r")) if c.get("r") else k): _value(c, shared, dates) for k, c in enumerate(node)}
                node.clear()
                if last is None and not any(v is not None for v in cells.values()):
                    continue
                for gap in range((last or number - 1) + 1, number):
                    yield gap, {}
                last = number
                yield number, cells


def _number(value):
    if value is None or isinstance(value, str) and not value.strip():
        return None
    try:
        out = float(value)
    except (TypeError, ValueError):
        raise EdgeError("INVALID_GEOMETRY", "an ordinate is not a number") from None
    if out - out != 0:
        raise EdgeError("INVALID_GEOMETRY", "not a finite ordinate")
    return out


def _shape(values: list):
    if len(values) == 1:
        return wkt.parse(values[0]) if isinstance(values[0], str) and values[0].strip() else None
    x, y = map(_number, values)
    if (x is None) != (y is None):
        raise EdgeError("INVALID_GEOMETRY", "one ordinate of a point is missing")
    return None if x is None else wkb.Geometry("point", "xy", (x, y))


def _header(cells: dict) -> dict[str, int]:
    names = {str(v): k for k, v in sorted(cells.items()) if v is not None}
    if len(names) < sum(v is not None for v in cells.values()):
        raise EdgeError("FORMAT", "the header names a column twice", phase="open")
    return names


def describe(spark: SparkSession, path: str, options: dict) -> list[Layer]:
    found = sheet_rows(path, options.get("sheet"))
    names = _header(next(found, (0, {}))[1])
    taken = _geometry_columns(options, list(names))
    if taken and not options.get("assume_crs"):
        raise EdgeError("CRS_REQUIRED", "the format carries no CRS; assume_crs must be given", category="contract", phase="open")
    seen: dict[str, set] = {n: set() for n in names if n not in taken}
    types, dims = set(), set()
    for _, cells in found:
        for n in seen:
            seen[n].add(value_class(cells.get(names[n])))
        shape = _shape([cells.get(names[c]) for c in taken]) if taken else None
        if shape is not None:
            types.add(shape.kind)
            dims.add(shape.dims)
    kinds = {n: lattice(s) for n, s in seen.items()}
    fields = [StructField(n, TYPES[k], True) for n, k in kinds.items()]
    if taken:
        contract = GeometryContract("geometry", resolved(options["assume_crs"]), True, "wkb", dims.pop() if len(dims) == 1 else "unknown", types=tuple(sorted(types)), declaration="exact" if types else "unresolved")
        fields.insert(0, geometry_field(contract))
    return [Layer(0, options.get("sheet") or "sheet", StructType(fields), {"kinds": kinds, "geometry": taken, "places": names, "sheet": options.get("sheet")})]


def pieces(path: str, plan: dict, extra: dict) -> list:
    return [0]


def rows(path: str, plan: dict, extra: dict, piece):
    found, places, wanted = sheet_rows(path, extra["sheet"]), extra["places"], set(plan["wanted"])
    next(found, None)
    for n, (_, cells) in enumerate(found):
        own = [value_as(cells.get(places[c]), k, text_of) if c in wanted else None for c, k in extra["kinds"].items()]
        if extra["geometry"]:
            shape = _shape([cells.get(places[c]) for c in extra["geometry"]])
            own.insert(0, None if shape is None else wkb.encode(shape))
        yield (*own, n)


def read(spark: SparkSession, path: str, layer: Layer, options: dict, columns: list[str] | None = None, index: bool = False) -> DataFrame:
    return load(spark, "xls", path, layer, options, columns, index)


_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="sheet" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{text_of(float(value)).removesuffix('.0')}</v></c>"
    if not isinstance(value, str):
        raise EdgeError("DATA_MAPPING", "the format has no cell for this type", phase="write")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def write(spark: SparkSession, frames: list[tuple[Layer, DataFrame]], path: str, options: dict) -> dict:
    layer, df = frames[0]
    g, names, as_xy = layer.geometry, [f.name for f in layer.attributes], options.get("geometry_encoding") == "xy"

    def shape(cell) -> list:
        if g is None:
            return []
        found = None if cell is None else wkb.decode(cell)
        if not as_xy:
            return [None if found is None else wkt.format(found)]
        if found is not None and (found.kind != "point" or found.dims != "xy" or found.content is None):
            raise EdgeError("DATA_MAPPING", "only points of two ordinates have x and y", phase="write")
        return [None, None] if found is None else list(found.content)

    def task(batches):
        n = 0
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
            for name, text in _PARTS.items():
                book.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
            with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
                put = lambda cells: f.write(("<row>" + "".join(map(_cell, cells)) + "</row>").encode())
                f.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                put(names + ([] if g is None else ["x", "y"] if as_xy else ["geometry"]))
                for row in dicts(batches):
                    put([row[c] for c in names] + shape(row[g.name] if g else None))
                    n += 1
                f.write(b"</sheetData></worksheet>")
        return {"rows": n}

    return write_one(df, task)
