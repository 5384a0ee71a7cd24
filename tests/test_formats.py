"""Sources and sinks through files: round trips, refusals, publication, diagnostics, command line and streams."""

from __future__ import annotations

import json
import os
import sqlite3
import zipfile
from dataclasses import replace

import pytest

from cartolith import cli
from cartolith.contract import GeometryContract, geometry_of, with_geometry
from cartolith.crs import CRS84, resolved
from cartolith.dataset import ReadRequest, open_dataset
from cartolith.errors import EdgeError, guarded
from cartolith.functions import wkb, wkt
from cartolith.limits import Budget, Cancellation, Limits
from cartolith.operators.validate import Diagnostics, diagnose
from cartolith.plans.capabilities import validate_write
from cartolith.plans.catalog import FORMATS, catalog, catalog_json, format_of
from cartolith.plans.convert import convert, layer_of, write_dataset
from cartolith.plans.loss import Fidelity, LossReport, end_to_end
from cartolith.plans.publish import Stage, preflight
from cartolith.sources import geojson as geojson_source

OPTIONS = {"csv": {"wkt_column": "geometry", "assume_crs": "EPSG:4326"}, "xlsx": {"wkt_column": "geometry", "assume_crs": "EPSG:4326"}, "dxf": {"assume_crs": "EPSG:4326"}}


def frame(spark, shapes, crs="EPSG:4326", schema="id long, name string", rows=None, **contract):
    cells = [None if s is None else wkb.encode(wkt.parse(s)) for s in shapes]
    found = [wkb.inspect(c) for c in cells if c is not None]
    types, dims = tuple(sorted({f.kind for f in found})), {f.dims for f in found}
    rows = rows or [(k, f"n{k}") for k in range(len(cells))]
    df = spark.createDataFrame([(c, *r) for c, r in zip(cells, rows)], "geometry binary, " + schema).coalesce(1)
    own = {"dimensions": dims.pop() if len(dims) == 1 else "unknown", "types": types, "declaration": "exact"} | contract
    return with_geometry(df, GeometryContract("geometry", resolved(crs), **own))


def back(spark, path, extension):
    df = open_dataset(spark, path, **OPTIONS.get(extension, {})).read()
    return [(None if r.geometry is None else wkt.format(wkb.decode(bytes(r.geometry))), *r[1:]) for r in df.collect()]


@pytest.mark.parametrize("extension", ["csv", "geojson", "parquet", "gpkg", "arrow", "xlsx", "kml", "dxf", "shp", "shp.d"])
@pytest.mark.parametrize("shapes", [["POINT(1 2)", "POINT(-3.5 4.25)"], ["LINESTRING Z(0 0 1,1 1 2)"], ["POLYGON((0 0,0 1,1 1,1 0,0 0))"]])
def test_round_trip(spark, tmp_path, extension, shapes):
    crs = CRS84 if extension in ("geojson", "kml") else "EPSG:4326"
    path = str(tmp_path / f"d.{extension}")
    if extension in ("kml", "dxf"):
        df = frame(spark, shapes, crs, "name string, description string" if extension == "kml" else "layer string", [("a", "b")] * len(shapes) if extension == "kml" else [("a",)] * len(shapes))
    else:
        df = frame(spark, shapes, crs)
    report = write_dataset(spark, {"d": df}, path)
    assert report["rows"] == len(shapes) and report["outcome"] == "published"
    got = back(spark, path, extension)
    expected = [s.replace("LINESTRING Z(0 0 1,1 1 2)", "MULTILINESTRING Z((0 0 1,1 1 2))").replace("POLYGON((0 0,0 1,1 1,1 0,0 0))", "MULTIPOLYGON(((0 0,0 1,1 1,1 0,0 0)))") for s in shapes] if extension.startswith("shp") else shapes
    assert [g[0] for g in got] == expected
    if extension not in ("kml", "dxf"):
        assert [g[1:] for g in got] == [(k, f"n{k}") for k in range(len(shapes))]
    with pytest.raises(EdgeError) as again:
        write_dataset(spark, {"d": df}, path)
    assert again.value.code == "EXISTS"
    assert sorted(os.listdir(tmp_path)) == sorted(["d.shp", "d.shx", "d.dbf", "d.prj"] if extension == "shp" else [f"d.{extension}"])


def test_csv_refusals(spark, tmp_path):
    def opened(text, **options):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.csv"
        path.write_text(text)
        return open_dataset(spark, str(path), **options)

    xy = {"x_column": "lon", "y_column": "lat", "assume_crs": "EPSG:4326"}
    found = opened("nome,lon,lat,pop\nA,12.5,45.9,100\nB,9.1,45.4,200\n", **xy)
    assert [f.name for f in found.layers[0].schema.fields] == ["geometry", "nome", "pop"] and found.read().select("pop").collect()[1].pop == 200
    assert opened("identifier,lon,lat\n18446744073709551615,1,2\n", **xy).read().first().identifier == "18446744073709551615"
    for text, options, code in (("a,lon,lat\n1,2,3\n", {}, "USAGE"), ("a,lon,lat\n1,2,3\n", {"x_column": "lon", "y_column": "lat"}, "CRS_REQUIRED"), ("a,b\n1,2\n", xy, "CONTRACT")):
        with pytest.raises(EdgeError) as error:
            opened(text, **options)
        assert error.value.code == code
    for text in ("a,lon,lat\n1,x,3\n", "a,lon,lat\n1,,3\n"):
        with pytest.raises(Exception, match="INVALID_GEOMETRY"):
            opened(text, **xy).read().collect()
    with pytest.raises(EdgeError) as error:
        opened("a,lon,lat\n1,2,3\n1,2\n", **xy).read().collect()
    assert error.value.code == "FORMAT"


def test_only_errors_of_the_data_are_typed(spark):
    def failing(kind):
        def rows(batches):
            raise kind

        return lambda: spark.range(1).mapInArrow(rows, "id long").collect()

    with pytest.raises(EdgeError) as error:
        guarded("open", failing(EdgeError("LIMIT", "too many rows")))
    assert error.value.code == "LIMIT"
    for f in (failing(MemoryError()), failing(ValueError("bad luck"))):
        with pytest.raises(Exception, match="MemoryError|bad luck") as error:
            guarded("open", f)
        assert not isinstance(error.value, EdgeError)
    for own in (PermissionError(13, "no"), MemoryError()):
        with pytest.raises(type(own)):
            guarded("open", lambda: (_ for _ in ()).throw(own))  # noqa: B023
    with pytest.raises(EdgeError) as error:
        guarded("open", lambda: int("x"))
    assert error.value.code == "FORMAT"


def test_geojson_refusals(spark, tmp_path):
    def opened(text):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.geojson"
        path.write_text(text)
        return open_dataset(spark, str(path))

    one = '{"type":"FeatureCollection","features":[%s]}'
    mixed = opened(one % '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"a":1,"b":"x"}},{"type":"Feature","geometry":null,"properties":{"a":2}},{"type":"Feature","geometry":null,"properties":null},{"type":"Feature","geometry":null,"properties":{"b":[1],"c":3}}')
    assert mixed.layers[0].extra["kinds"] == {"a": "integer", "b": "text", "c": "integer"}
    assert [tuple(r)[1:] for r in mixed.read().collect()] == [(1, "x", None), (2, None, None), (None, None, None), (None, "[1]", 3)]
    assert mixed.read(ReadRequest(columns=("c", "a"))).columns == ["a", "c"]
    for text in (one % '{"type":"Feature","geometry":null,"properties":{"a":1,"a":2}}', one % '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2,3,4]},"properties":{}}', '{"type":"FeatureCollection"}', one % "{}", "[]"):
        with pytest.raises(EdgeError):
            opened(text)


def test_geopackage_layers_and_pruning(spark, tmp_path):
    path = str(tmp_path / "m.gpkg")
    a, b = frame(spark, ["POINT(1 2)"]), frame(spark, ["POINT(3 4)", "POINT(100 100)"])
    write_dataset(spark, {"b": b, "a": a}, path)
    found = open_dataset(spark, path)
    assert [x.name for x in found.layers] == ["a", "b"] and found.layers[0].geometry.crs.id == "EPSG:4326" and found.layers[1].geometry.types == ("point",)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_extensions (x)")
        db.execute("CREATE VIRTUAL TABLE rtree_b_geometry USING rtree(id, minx, maxx, miny, maxy)")
        db.execute("INSERT INTO rtree_b_geometry VALUES (1, 3, 3, 4, 4), (2, 100, 100, 100, 100)")
        db.execute("INSERT INTO b VALUES (-5, ?, 9, 'below')", (db.execute("SELECT geometry FROM b LIMIT 1").fetchone()[0],))
    found = open_dataset(spark, path)
    assert found.read(ReadRequest("b")).count() == 3  # rows below rowid 1 too
    assert {r.id for r in found.read(ReadRequest("b", bbox=(0, 0, 10, 10))).collect()} == {0, 9}
    with pytest.raises(EdgeError) as refused:
        convert(spark, path, str(tmp_path / "x.arrow"))
    assert refused.value.code == "UNSUPPORTED" and not os.path.exists(tmp_path / "x.arrow")


def test_geoparquet_prunes_and_never_under_returns(spark, tmp_path):
    shapes = [f"POINT({k} {k % 7})" for k in range(400)] + ["CIRCULARSTRING(0 0,1 1,2 0)", None]
    df = frame(spark, shapes, types=("circularstring", "point"))
    from cartolith.sources import geoparquet

    folder = str(tmp_path / "p.parquet")
    geoparquet.write(spark, [(layer_of("p", df), df)], folder, {})
    data = open_dataset(spark, folder)
    kept = data.read(ReadRequest(bbox=(10, 0, 20, 6)))
    assert {r.id for r in kept.collect()} == {*range(10, 21), 400}  # the curve's extent is unknown; a null shape has none
    assert data.read(ReadRequest(predicate="id >= 395")).count() == 7
    plan = data.read(ReadRequest(columns=("id",), predicate="id >= 395"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "name" not in plan.split("ReadSchema")[1][:60]
    assert data.read(ReadRequest(source_index=True)).where("_source_row = 7").first().id == 7


def test_foreign_errors_are_typed(spark, tmp_path):
    for name in ("a.arrow", "b.xlsx", "c.gpkg", "d.parquet", "e.shp"):
        (tmp_path / name).write_bytes(b"junk" * 50)
        with pytest.raises(EdgeError) as error:
            open_dataset(spark, str(tmp_path / name), assume_crs="EPSG:4326", wkt_column="g")
        assert "junk" not in str(error.value)


def test_kml_guard(spark, tmp_path):
    for name, text in (("a", '<!DOCTYPE x><kml/>'), ("b", "<kml>" + "<a>" * 300 + "</a>" * 300 + "</kml>"), ("c", "<kml>")):
        path = tmp_path / f"{name}.kml"
        path.write_text(text)
        with pytest.raises(EdgeError):
            open_dataset(spark, str(path))
    path = tmp_path / "d.kml"
    path.write_text('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><Placemark><name>x</name><MultiGeometry><Point><coordinates>1,2</coordinates></Point><Point><coordinates>3,4</coordinates></Point></MultiGeometry></Placemark></Folder></Document></kml>')
    assert back(spark, str(path), "kml") == [("MULTIPOINT((1 2),(3 4))", "x", None)]
    with pytest.raises(EdgeError) as whole:
        open_dataset(spark, str(path)).read(ReadRequest(columns=("name",)))
    assert whole.value.code == "PROJECTION_UNSUPPORTED"


def test_sheet_gaps_and_dates(spark, tmp_path):
    path = str(tmp_path / "s.xlsx")
    from cartolith.sources.xlsx import _PARTS

    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>x</t></is></c><c r="B1" t="inlineStr"><is><t>y</t></is></c><c r="C1" t="inlineStr"><is><t>v</t></is></c></row><row r="2"><c r="A2"><v>1</v></c><c r="B2"><v>2</v></c><c r="C2"><v>7</v></c></row><row r="4"><c r="A4"><v>3</v></c><c r="B4"><v>4</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as book:
        for name, text in _PARTS.items():
            book.writestr(name, text)
        book.writestr("xl/worksheets/sheet1.xml", sheet)
    found = open_dataset(spark, path, x_column="x", y_column="y", assume_crs="EPSG:4326")
    assert [(r.geometry is None, r.v) for r in found.read().collect()] == [(False, 7), (True, None), (False, None)]


def test_dxf_blocks(spark, tmp_path):
    path = tmp_path / "b.dxf"
    pairs = "0 SECTION 2 BLOCKS 0 BLOCK 2 BOX 10 0 20 0 0 LINE 8 0 10 0 20 0 11 1 21 0 0 ENDBLK 0 ENDSEC 0 SECTION 2 ENTITIES 0 INSERT 2 BOX 8 MYLAYER 10 10 20 5 0 ENDSEC 0 EOF"
    path.write_text("\n".join(pairs.split(" ")) + "\n")
    assert back(spark, str(path), "dxf") == [("LINESTRING(10 5,11 5)", "MYLAYER", "LINE", None)]
    path.write_text("\n".join(pairs.replace("0 LINE 8 0 10 0 20 0 11 1 21 0", "0 INSERT 2 BOX").split(" ")) + "\n")
    with pytest.raises(EdgeError):
        open_dataset(spark, str(path), assume_crs="EPSG:4326")


def test_shapefile_rings_and_names(spark, tmp_path):
    from cartolith.sources.shapefile import parse_shape
    import struct

    def polygon(ring):
        flat = [v for p in ring for v in p]
        return struct.pack(f"<i4d2ii{len(flat)}d", 5, 0, 0, 1, 1, 1, len(ring), 0, *flat)

    for ring, cause in (([(0, 0), (0, 1), (1, 1)], "unclosed"), ([(0, 0), (1, 1), (0, 0)], "degenerate"), ([(0, 0), (1, 0), (1, 1), (0, 0)], "inner_before_outer")):
        with pytest.raises(EdgeError, match=cause):
            parse_shape(polygon(ring), "xy")
    with pytest.raises(EdgeError, match="field_name_length"):
        write_dataset(spark, {"d": frame(spark, ["POINT(1 2)"], schema="n_nationkey long, b string")}, str(tmp_path / "d.shp"))
    with pytest.raises(Exception, match="beyond"):
        write_dataset(spark, {"d": frame(spark, ["POINT(1 2)"], rows=[(1 << 60, "x")])}, str(tmp_path / "d.shp"))
    assert os.listdir(tmp_path) == []


def test_capability_verdicts(spark):
    points, dated = frame(spark, ["POINT(1 2)"]), frame(spark, ["POINT(1 2)"]).selectExpr("geometry", "current_date() as day")
    dated = with_geometry(dated, geometry_of(points.schema))
    verdicts = {}
    for name, descriptor in FORMATS.items():
        for label, df in (("points", points), ("dated", dated), ("open", with_geometry(points, GeometryContract("geometry", resolved("EPSG:4326"))))):
            try:
                validate_write(descriptor, [layer_of("x", df)])
                verdicts[name, label] = "ok"
            except EdgeError as error:
                verdicts[name, label] = error.code
    assert verdicts["filegdb", "points"] == "UNSUPPORTED" and verdicts["geojson", "points"] == verdicts["kml", "points"] == "REPROJECTION_REQUIRED"
    assert all(verdicts[f, "points"] == "ok" for f in ("csv", "dxf", "geoparquet", "gpkg", "ipc", "shp", "xls"))
    assert {f for f in FORMATS if verdicts[f, "dated"] == "ok"} == {"dxf", "geoparquet", "ipc"} and verdicts["ipc", "open"] == "ok" and verdicts["geoparquet", "open"] == "CONTRACT"
    for crs, fmt, code in (("OGC:CRS84", "gpkg", "CONTRACT"),):
        with pytest.raises(EdgeError) as error:
            validate_write(FORMATS[fmt], [layer_of("x", frame(spark, ["POINT(1 2)"], crs))])
        assert error.value.code == code
    with pytest.raises(EdgeError, match="crs_incoherent"):
        own = replace(geometry_of(points.schema), srid=3857)
        validate_write(FORMATS["gpkg"], [layer_of("x", with_geometry(points, own))])


def test_catalog_is_stable():
    assert catalog_json() == catalog_json() and [d["id"] for d in catalog()] == sorted(FORMATS)
    assert format_of("A/B.SHP.D").id == "shp" and format_of("x.json").id == "geojson"
    for name in ("x.xls", "x", "x.tif"):
        with pytest.raises(EdgeError) as error:
            format_of(name)
        assert error.value.code == "UNSUPPORTED"


def test_validation_stops_publication(spark, tmp_path):
    df = frame(spark, ["POINT(1 2)", "POINT(3 4)", None])
    bad = with_geometry(df, replace(geometry_of(df.schema), nullable=False))
    with pytest.raises(EdgeError) as error:
        write_dataset(spark, {"d": bad}, str(tmp_path / "d.parquet"))
    assert error.value.diagnostics.counts == {"contract.nullability": 1} and error.value.diagnostics.scan == "partial"
    with pytest.raises(EdgeError):
        write_dataset(spark, {"d": df}, str(tmp_path / "d.parquet"), expected_rows={"d": 2})
    assert os.listdir(tmp_path) == []
    broken = spark.createDataFrame([(k, b"junk" if k % 3 == 0 else wkb.encode(wkt.parse("POINT(1 2)"))) for k in range(300)], "k long, geometry binary")
    found = diagnose(with_geometry(broken, GeometryContract("geometry")), index="k")
    assert found.counts == {"conversion.invalid_geometry": 100} and [e["row"] for e in found.examples] == list(range(0, 192, 3)) and found.scan == "complete"
    told = diagnose(with_geometry(broken, GeometryContract("geometry")), index="k", examples=2, key_field="k", key_policy="emit")
    assert told.examples == [{"row": 0, "cause": "conversion.invalid_geometry", "key": "0"}, {"row": 3, "cause": "conversion.invalid_geometry", "key": "3"}]
    for options in ({"examples": 65}, {"key_field": "k"}, {"key_field": "k", "key_policy": "guess"}):
        with pytest.raises(EdgeError):
            diagnose(with_geometry(broken, GeometryContract("geometry")), **options)
    with pytest.raises(EdgeError):
        Diagnostics("read", "unknown", 1, {"x": 1}, [{"row": 1, "cause": "x"}]).validate()


def test_publication(tmp_path):
    target = tmp_path / "t"
    with Stage(str(target)) as stage:
        open(stage.path, "w").write("x")
    assert not target.exists() and list(tmp_path.iterdir()) == []
    with Stage(str(target)) as stage:
        open(stage.path, "w").write("x")
        target.write_text("other")
        with pytest.raises(EdgeError):
            stage.publish()
    assert target.read_text() == "other" and len(list(tmp_path.iterdir())) == 1
    os.symlink(target, tmp_path / "link")
    for path, limit in ((tmp_path / "link", None), (tmp_path, None), (target, 2), (tmp_path / "none", None)):
        with pytest.raises(EdgeError):
            preflight(str(path), limit)


def test_loss_reports():
    a, b = LossReport(), LossReport()
    a.add("x", "f", 2)
    b.add("x", "g")
    both = a.merge(b)
    assert both.counts == {"x": 3} and both.examples == [("x", "f"), ("x", "g")]
    assert end_to_end(Fidelity("lossless"), Fidelity("approximating", ("x",)), Fidelity("conditional", ("x", "y"))) == Fidelity("approximating", ("x", "y"))


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "c.csv"
    path.write_text("id,x,y\n1,2,3\n2,4,5\n")
    options = ["--option", "x_column=x", "--option", "y_column=y", "--option", "assume_crs=EPSG:4326"]
    assert cli.run(["catalog"])["schema"] == "catalog-v1"
    assert cli.run(["layers", str(path), *options], spark)["layers"] == [{"id": 0, "name": "csv", "crs": "EPSG:4326", "field_count": 2}]
    assert cli.run(["inspect", str(path), *options], spark)["layers"][0]["geometry"]["types"] == ["point"]
    assert cli.run(["read", str(path), *options, "--limit", "1"], spark)["rows_read"] == 2
    report = cli.run(["convert", str(path), str(tmp_path / "c.gpkg"), *options], spark)
    assert report["schema"] == "convert-v1" and report["rows"] == 2 and report["fidelity"]["end_to_end"]["level"] in ("conditional", "approximating")
    assert cli.main(["inspect", str(tmp_path / "none.gdb")]) == 4 and json.loads(capsys.readouterr().err)["error"]["code"] == "UNSUPPORTED"


def test_single_reader(spark, tmp_path):
    write_dataset(spark, {"d": frame(spark, ["POINT(1 2)"], CRS84, "name string", [("a",)])}, str(tmp_path / "d.kml"))
    data = open_dataset(spark, str(tmp_path / "d.kml"))
    first = data.open_reader()
    with pytest.raises(EdgeError) as busy:
        data.open_reader()
    assert busy.value.code == "READER_BUSY" and sum(map(len, first)) == 1
    assert sum(b.num_rows for b in data.open_reader()) == 1


def test_stream_of_points(spark, tmp_path):
    from cartolith.streaming.files import stream_csv, stream_features, windowed_extent
    from pyspark.sql.types import LongType, StructField, StructType

    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.csv").write_text("id,x,y\n1,2,3\n2,4,5\n")
    df = stream_csv(spark, str(tmp_path / "in"), {"id": "integer"}, "x", "y", "EPSG:4326")
    query = df.writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.id for r in spark.table("arrived").collect()) == [1, 2] and geometry_of(df.schema).types == ("point",)
    os.makedirs(tmp_path / "nd")
    (tmp_path / "nd" / "a.json").write_text('{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"t":5}}\n')
    features = stream_features(spark, str(tmp_path / "nd"), StructType([StructField("t", LongType())]))
    timed = windowed_extent(features.selectExpr("geometry", "timestamp_seconds(t) as at"), "at", "1 minute", "1 minute")
    query = timed.writeStream.format("memory").outputMode("complete").queryName("extents").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.n, r.minx, r.maxy) for r in spark.table("extents").collect()] == [(1, 1.0, 2.0)]


def _collection(n, between=",\n", tail="\n]}\n", head='{"type":"FeatureCollection","features":[\n'):
    one = lambda k: json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [k, -k]} if k % 5 else None, "properties": {"id": k, "name": "}],{" * (k % 3) + "é"}}, ensure_ascii=False)
    return head + between.join(one(k) for k in range(n)) + tail


@pytest.mark.parametrize("text", [_collection(400), _collection(400, between=", "), _collection(400, tail='\n], "crs": null}'), _collection(400, head='{"features": [\n', tail='\n],\n"type": "FeatureCollection"}'), _collection(400, between=",\n\n")])
def test_geojson_in_pieces(spark, tmp_path, monkeypatch, text):
    """A feature on each line is read in pieces; other files in a row; rows and their numbers are the same."""
    monkeypatch.setattr(geojson_source, "PIECE_BYTES", 3000)
    monkeypatch.setattr(geojson_source, "CHUNK", 700)
    path = tmp_path / "p.geojson"
    path.write_text(text, encoding="utf-8")
    data = open_dataset(spark, str(path))
    assert ("pieces" in data.layers[0].extra) == (",\n{" in text and "\n\n{" not in text)
    got = data.read(ReadRequest(source_index=True)).collect()
    assert sorted((r._source_row, r.id, r.name.count("}"), r.geometry is None) for r in got) == [(k, k, k % 3, k % 5 == 0) for k in range(400)]
    assert list(geojson_source.features(str(path)))[399]["properties"]["id"] == 399


def test_geojson_faults_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(geojson_source, "PIECE_BYTES", 2000)
    good = _collection(100).split("\n")
    for k, line in ((50, good[50][:-1]), (50, good[50][:-3] + ","), (50, "{},"), (100, good[100] + ",")):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.geojson"
        path.write_text("\n".join([*good[:k], line, *good[k + 1 :]]), encoding="utf-8")
        with pytest.raises(EdgeError) as error:
            open_dataset(spark, str(path))
        assert error.value.code == "FORMAT"


def test_row_limits_bind(spark, tmp_path):
    df = frame(spark, ["POINT(1 2)"] * 5)
    path = str(tmp_path / "l.csv")
    write_dataset(spark, {"l": df}, path)
    for limit, fits in ((4, False), (5, True)):
        try:
            assert open_dataset(spark, path, Limits(max_rows=limit), **OPTIONS["csv"]).read().count() == 5 and fits
        except EdgeError as error:
            assert error.code == "LIMIT" and not fits


def test_text_sinks_keep_rows_in_order(spark, tmp_path):
    df = frame(spark, [f"POINT({k} {-k}.5)" for k in range(60)]).repartition(5)
    df = with_geometry(df, geometry_of(frame(spark, ["POINT(1 2)"]).schema))
    order = [wkt.format(wkb.decode(bytes(r.geometry))) for r in df.collect()]
    path = str(tmp_path / "o.csv")
    write_dataset(spark, {"o": df}, path)
    with open(path) as f:
        assert [line.rstrip("\n").rsplit(",", 1)[-1].strip('"') for line in f][1:] == order


def test_readers_slice_batches_and_heed_tokens(spark, tmp_path):
    df = frame(spark, [f"POINT({k} 1)" for k in range(100)])
    path = str(tmp_path / "r.csv")
    write_dataset(spark, {"r": df}, path)
    data = open_dataset(spark, path, **OPTIONS["csv"])
    sizes = [b.num_rows for b in data.open_reader(ReadRequest(batch_rows=30))]
    assert sum(sizes) == 100 and max(sizes) == 30 and all(n == 30 for n in sizes[:-1])
    assert sum(b.num_rows for b in data.open_reader(ReadRequest(batch_rows=30, limit=31))) == 60
    assert sum(b.num_rows for b in data.open_reader(ReadRequest(columns=()))) == 100
    token = Cancellation()
    reader = open_dataset(spark, path, cancellation=token.child(), **OPTIONS["csv"]).open_reader(ReadRequest(batch_rows=30))
    next(reader)
    token.cancel()
    with pytest.raises(EdgeError) as error:
        next(reader)
    assert error.value.code == "CANCELLED"
    for f in (lambda: open_dataset(spark, path, cancellation=token, **OPTIONS["csv"]), lambda: convert(spark, path, str(tmp_path / "r.gpkg"), source_options=OPTIONS["csv"], cancellation=token), lambda: write_dataset(spark, {"r": df}, str(tmp_path / "s.csv"), cancellation=token)):
        with pytest.raises(EdgeError) as error:
            f()
        assert error.value.code == "CANCELLED"
    assert sorted(os.listdir(tmp_path)) == ["r.csv"]


def test_budgets_bind(spark, tmp_path):
    path = str(tmp_path / "b.csv")
    write_dataset(spark, {"b": frame(spark, ["POINT(1 1)"] * 20)}, path)
    for budget in (Budget(columns=1), Budget(memory_bytes=10), Budget(concurrency=0), Budget(duration_s=0.0)):
        with pytest.raises(EdgeError) as error:
            list(open_dataset(spark, path, budget=budget, **OPTIONS["csv"]).open_reader())
        assert error.value.code in ("LIMIT", "CANCELLED")
    budget = Budget()
    assert sum(b.num_rows for b in open_dataset(spark, path, budget=budget, **OPTIONS["csv"]).open_reader()) == 20
    assert budget.used["memory_bytes"] == budget.used["concurrency"] == 0
    with pytest.raises(EdgeError) as error:
        write_dataset(spark, {"b": frame(spark, ["POINT(1 1)"] * 20)}, str(tmp_path / "c.csv"), limits=Limits(max_rows=19))
    assert error.value.code == "LIMIT" and sorted(os.listdir(tmp_path)) == ["b.csv"]
