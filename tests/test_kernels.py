"""Geometry kernels, CRS, contracts, inference and limits, without files."""

from __future__ import annotations

import math
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartolith import crs
from cartolith.contract import GeometryContract, geometry_of, with_geometry
from cartolith.errors import EdgeError, exit_code
from cartolith.functions import curves, geojson, wkb, wkt
from cartolith.functions.wkb import Geometry
from cartolith.limits import Budget, Cancellation, Limits, initial_batch_rows, next_batch_rows
from cartolith.operators.infer import infer_types, lattice, typed, value_as, value_class
from cartolith.operators.prune import NumericHint, parse_predicate, project, prune_bbox, prune_numeric, read_summary

WKT = [
    "POINT(1 2)", "POINT Z(1 2 3)", "POINT M(1 2 3)", "POINT ZM(1 2 3 4)", "POINT EMPTY", "LINESTRING(0 0,1 1)", "POLYGON((0 0,1 0,1 1,0 0),(0.1 0.1,0.2 0.1,0.2 0.2,0.1 0.1))", "MULTIPOINT((1 2),(3 4))",
    "MULTILINESTRING((0 0,1 1),(2 2,3 3))", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)))", "GEOMETRYCOLLECTION(POINT(1 2),LINESTRING(0 0,1 1))", "CIRCULARSTRING(0 0,1 1,2 0)", "COMPOUNDCURVE((0 0,1 1),CIRCULARSTRING(1 1,2 2,3 1))",
    "CURVEPOLYGON(CIRCULARSTRING(0 0,1 1,2 0,1 -1,0 0))", "MULTICURVE((0 0,1 1))", "MULTISURFACE(((0 0,1 0,1 1,0 0)))", "POLYHEDRALSURFACE Z(((0 0 0,1 0 0,1 1 0,0 0 0)))", "TIN(((0 0,1 0,1 1,0 0)))", "TRIANGLE((0 0,1 0,1 1,0 0))", "GEOMETRYCOLLECTION EMPTY",
]


@pytest.mark.parametrize("text", WKT)
def test_text_and_binary_round_trip(text):
    g = wkt.parse(text)
    assert wkt.format(g) == text
    for extended in (False, True):
        cell = wkb.encode(g, extended)
        assert wkb.decode(cell) == g
        found = wkb.inspect(cell)
        assert (found.kind, found.dims, found.srid, found.coherent) == (g.kind, g.dims, None, True)
        for cut in range(len(cell)):
            with pytest.raises(EdgeError):
                wkb.inspect(cell[:cut])
        with pytest.raises(EdgeError):
            wkb.inspect(cell + b"\0")


def test_binary_variants():
    big = struct.pack(">BIdd", 0, 1, 1.0, 2.0)
    assert wkb.decode(big).content == (1.0, 2.0)
    srid = wkb.encode(Geometry("point", "xyz", (1.0, 2.0, 3.0), 4326), extended=True)
    assert wkb.inspect(srid).srid == 4326 and wkb.inspect(srid).contains_srid
    with pytest.raises(EdgeError):
        wkb.encode(Geometry("point", "xy", (1.0, 2.0), 4326))
    with pytest.raises(EdgeError):
        wkb.inspect(struct.pack("<BII", 1, 2, 1 << 31))  # a count that can't fit
    with pytest.raises(EdgeError):
        wkb.inspect(struct.pack("<BI", 1, 13))
    deep = wkb.encode(Geometry("point", "xy", (1.0, 2.0)))
    for _ in range(70):
        deep = struct.pack("<BII", 1, 7, 1) + deep
    with pytest.raises(EdgeError):
        wkb.inspect(deep)
    wrong = struct.pack("<BII", 1, 4, 1) + wkb.encode(wkt.parse("LINESTRING(0 0,1 1)"))
    with pytest.raises(EdgeError):
        wkb.inspect(wrong)
    many = wkb.encode(wkt.parse("LINESTRING(0 0,1 1,2 2)"))
    with pytest.raises(EdgeError) as limit:
        wkb.inspect(many, Limits(max_components=2))
    assert limit.value.code == "LIMIT"


@given(st.lists(st.tuples(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6)), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_bounds_never_fall_short(points):
    cell = wkb.encode(Geometry("linestring", "xy", points))
    a, b, c, d = wkb.bbox(cell)
    assert all(a <= x <= c and b <= y <= d for x, y in points)
    assert wkt.parse(wkt.format(wkb.decode(cell))).content == points
    shape = Geometry("multipoint", "xy", [Geometry("point", "xy", p) for p in points])
    assert geojson.parse(geojson.loads(geojson.dumps(shape))) == shape


def test_bounds_are_unknown_where_they_must_be():
    cells = [None, b"", wkb.encode(wkt.parse("POINT EMPTY")), wkb.encode(wkt.parse("CIRCULARSTRING(0 0,1 1,2 0)")), wkb.encode(Geometry("point", "xy", (math.inf, 1.0))), wkb.encode(wkt.parse("POINT(1 2)")), struct.pack(">BIdd", 0, 1, 3.0, 4.0)]
    assert list(zip(*wkb.bbox_columns(cells))) == [(None,) * 4] * 5 + [(1.0, 2.0, 1.0, 2.0), (3.0, 4.0, 3.0, 4.0)]


@pytest.mark.parametrize("text", ["POINT(1)", "POINT(1 2 3 4 5)", "POINT(1 nan)", "LINESTRING(0 0,1 1 1)", "POINT(1 2) x", "CIRCLE(1 2)", "POINT(1 2", "MULTIPOINT(LINESTRING(0 0,1 1))", "POINT Z(1 2)", ""])
def test_bad_text(text):
    with pytest.raises(EdgeError):
        wkt.parse(text)


@pytest.mark.parametrize("text", ['{"type":"Point","coordinates":[1,2,3,4]}', '{"type":"Point","coordinates":[]}', '{"type":"Point","coordinates":[1,null]}', '{"type":"Blob"}', '{"type":"LineString","coordinates":[[1,2],[1,2,3]]}', '{"type":"Point","type":"Point","coordinates":[1,2]}', "{"])
def test_bad_geojson(text):
    with pytest.raises(EdgeError):
        geojson.parse(geojson.loads(text))


def test_labels():
    for kind in wkb.CODES:
        for dims in wkb.DIMENSIONS:
            assert wkb.from_label(wkb.label(kind, dims)) == (kind, dims)


def test_crs():
    projected = 'PROJCS["x",GEOGCS["WGS 84",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","32632"]]'
    assert crs.root_epsg(projected) == 32632 and crs.from_definition(projected).id == "EPSG:32632"
    assert crs.root_epsg('PROJCS["x",GEOGCS["WGS 84",AUTHORITY["EPSG","4326"]]]') is None
    assert crs.root_epsg('{"type":"ProjectedCRS","base_crs":{"id":{"authority":"EPSG","code":4326}},"id":{"authority":"EPSG","code":3857}}') == 3857
    assert crs.resolved("ogc:crs84").axis_order == "lon_lat" and crs.resolved("EPSG:4326").axis_order == "lat_lon"
    assert crs.from_definition("LOCAL_CS[]").resolution == "declared" and crs.MISSING.id is None


def test_contract_rules():
    with pytest.raises(EdgeError):
        GeometryContract(types=("polygon", "point"), declaration="exact")
    with pytest.raises(EdgeError):
        GeometryContract(types=(), declaration="exact")
    with pytest.raises(EdgeError):
        GeometryContract(types=("point",), declaration="unresolved")


def test_contract_survives_parquet(spark, tmp_path):
    own = GeometryContract("g", crs.resolved("EPSG:3857"), False, dimensions="xyz", types=("point",), declaration="exact")
    df = with_geometry(spark.createDataFrame([(b"x", 1)], "g binary, n int"), own)
    df.write.parquet(str(tmp_path / "p"))
    assert geometry_of(spark.read.parquet(str(tmp_path / "p")).schema) == own
    assert geometry_of(df.selectExpr("concat(g, g) as g").schema) is None


def test_inference(spark):
    rows = [("1", "1", "true", "1.5", "x", " ", "9007199254740993", "18446744073709551615", "1", "NaN"), ("-2", "2.5e3", "FALSE", "9007199254740993", "2", None, "3", "1", "true", "1")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string, h string, i string, j string")
    assert infer_types(df) == {"a": "integer", "b": "number", "c": "boolean", "d": "text", "e": "text", "f": "text", "g": "integer", "h": "text", "i": "text", "j": "text"}
    got = df.select(typed(df.a, "integer").alias("a"), typed(df.b, "number").alias("b"), typed(df.c, "boolean").alias("c"), typed(df.f, "text").alias("f"), typed(df.e, "text").alias("e")).collect()
    assert [tuple(r) for r in got] == [(1, 1.0, True, None, "x"), (-2, 2500.0, False, None, "2")]


def test_lattice_does_not_depend_on_order():
    rnd = random.Random(1)
    for _ in range(100):
        seen = {rnd.choice(["null", "integer", "wide_integer", "number", "boolean", "text"]) for _ in range(rnd.randint(0, 4))}
        assert lattice(seen) == lattice(set(reversed(sorted(seen))))
    assert [value_class(v) for v in (None, True, 1, 1 << 60, 1 << 70, 1.5, math.nan, "x", [1])] == ["null", "boolean", "integer", "wide_integer", "text", "number", "text", "text", "text"]
    assert value_as(3, "number", str) == 3.0 and value_as([1], "text", str) == "[1]"
    with pytest.raises(EdgeError):
        value_as(1.5, "integer", str)


def test_batches(spark):
    schema = with_geometry(spark.createDataFrame([], "g binary, a long, b string"), GeometryContract("g")).schema
    assert initial_batch_rows(schema, 584 * 10) == 10 and initial_batch_rows(schema, 1) == 1
    assert next_batch_rows(100, 1000, 5000) == 500 and next_batch_rows(100, 10**9, 10) == 1
    df = spark.range(25)
    assert read_summary(df, 10, 11) == {"rows_read": 20, "batches": 2, "truncated": True}
    assert read_summary(df, 10, 0)["rows_read"] == 0 and read_summary(df, 10)["batches"] == 3


def test_budget_and_cancellation():
    budget = Budget(concurrency=1)
    with budget.lease("concurrency"):
        with pytest.raises(EdgeError):
            budget.lease("concurrency")
    budget.lease("concurrency").commit()
    with pytest.raises(EdgeError) as limit:
        budget.lease("concurrency")
    assert exit_code(limit.value) == 7
    root = Cancellation()
    child = root.child(seconds=60)
    child.check()
    root.cancel()
    with pytest.raises(EdgeError) as ended:
        child.check()
    assert exit_code(ended.value) == 130


def test_hints(spark):
    df = spark.createDataFrame([(k, float(k), str(k)) for k in range(10)], "a long, b double, c string")
    assert parse_predicate("a >= 3") == NumericHint("a", ">=", 3) and parse_predicate("b<2.5") == NumericHint("b", "<", 2.5) and parse_predicate("a like 3") is None and parse_predicate("a = x") is None
    assert prune_numeric(df, "a >= 7").count() == 3 and prune_numeric(df, "a >= 7.5").count() == 10 and prune_numeric(df, "c >= 7").count() == 10 and prune_numeric(df, "z > 1").count() == 10
    assert prune_bbox(df, (0, 0, 1, 1)).count() == 10
    assert project(df, ["c", 0, "c"]).columns == ["a", "c"] and project(df, []).count() == 10
    with pytest.raises(EdgeError):
        project(df, ["zz"])
    assert project(df, ["zz"], "best_effort").columns == []


def test_curves():
    half = curves.bulge((0.0, 0.0), (2.0, 0.0), 1.0)
    assert len(half) == 11 and all(math.isclose((x - 1) ** 2 + y * y, 1) for x, y in half) and all(y < 0 for _, y in half)
    assert len(curves.arc((0, 0), 1, 0, 90)) == 7 and curves.arc((0, 0), 0, 0, 90) == [] and len(curves.circle((0, 0), 2)) == 25
    ring = curves.ellipse((0, 0, 0), (2, 0, 0), (0, 0, 1), 0.5, 0, math.tau)
    assert ring[0] == ring[-1] and len(ring) == 25
    line = curves.spline(3, [0, 0, 0, 0, 1, 1, 1, 1], [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0)], [])
    assert len(line) == 24 and line[0] == (0, 0, 0) and line[-1] == (3, 3, 0) and all(math.isclose(x, y) for x, y, _ in line)
    assert curves.spline(3, [0, 1], [(0, 0, 0), (1, 1, 0)], []) == [(0, 0, 0), (1, 1, 0)]
    assert curves.moved([(1, 0, 0)], curves.insertion((10, 5, 0), 90, (2, 0, 1)))[0] == pytest.approx((10, 7, 0))
    assert curves.moved([(1, 0, 0)], curves.object_axes((0, 0, -1)))[0] == pytest.approx((-1, 0, 0))
