"""Readers of several files, each by its own form."""

import pytest

from pedon.operators import geometry
from pedon.sources import readers


def test_each_report_has_its_own_delimiter_and_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Amostra;P;K\nT1;1,5;0,2\n;;\nT2;<0,4;ND\n", "utf-8")
    (tmp_path / "b.csv").write_text('Amostra,K,Ca\nT3,"0,3",2\n', "utf-8")
    (tmp_path / "c.csv").write_text("Amostra;P;K\nT4;9;8\n", "utf-8")
    (tmp_path / "empty.csv").write_text("", "utf-8")
    rows = readers.lab_csv(spark, str(tmp_path), file_col="file")
    got = {r["Amostra"]: (r["P"], r["K"], r["Ca"], r["file"].rsplit("/", 1)[1]) for r in rows.collect()}
    assert got == {"T1": ("1,5", "0,2", None, "a.csv"), "T2": ("<0,4", "ND", None, "a.csv"), "T3": (None, "0,3", "2", "b.csv"), "T4": ("9", "8", None, "c.csv")}
    assert [r["Amostra"] for r in readers.lab_csv(spark, str(tmp_path), "t-3").collect()] == ["T3"]
    assert readers.lab_csv(spark, str(tmp_path / "b.csv")).columns == ["Amostra", "K", "Ca"]


def test_reports_without_rows_are_errors(spark, tmp_path):
    for name, text in (("empty", ""), ("head", "a;b\n"), ("blank", "a;b\n;\n ;\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.csv").write_text(text, "utf-8")
        with pytest.raises(ValueError):
            readers.lab_csv(spark, str(tmp_path / name))


def test_sheets_and_points_of_two_forms(spark, tmp_path):
    (tmp_path / "a.csv").write_text("nome;Lon;Lat\nx;-47,5;-21,1\n", "utf-8")
    (tmp_path / "b.csv").write_text("nome,Lon,Lat\ny,-48.5,-22.1\nz,,\n", "utf-8")
    assert {(r.x, r.y, r.props["nome"]) for r in readers.points_csv(spark, str(tmp_path)).collect()} == {(-47.5, -21.1, "x"), (-48.5, -22.1, "y")}
    assert {r["nome"] for r in readers.sheet_csv(spark, str(tmp_path)).collect()} == {"x", "y", "z"}


def test_rings_of_two_files_stay_apart(spark, tmp_path):
    square = '{"type": "Polygon", "coordinates": [[[%d,0],[%d,0],[%d,1],[%d,1],[%d,0]]]}'
    for name, x in (("a", 0), ("b", 10)):
        (tmp_path / f"{name}.geojson").write_text(square % (x, x + 1, x + 1, x, x), "utf-8")
        (tmp_path / f"{name}.kml").write_text(f"<kml><Polygon><outerBoundaryIs><LinearRing><coordinates>{x},0 {x + 1},0 {x + 1},1 {x},0</coordinates></LinearRing></outerBoundaryIs></Polygon></kml>", "utf-8")
    for read, pattern in ((readers.geojson_rings, "*.geojson"), (readers.kml_rings, "*.kml")):
        rings = read(spark, str(tmp_path / pattern))
        assert rings.select("geom_id").distinct().count() == 2
        assert all(abs(r[-1]) <= 1 for r in geometry.ring_areas(rings).select("area").collect())


KML = """<?xml version="1.0"?><kml:kml xmlns:kml="http://www.opengis.net/kml/2.2" xmlns:gx="g">
<Document xmlns="http://www.opengis.net/kml/2.2"><name>all</name>
<Placemark id="p1"><name> A &amp; B </name><ExtendedData><Data name="code"><displayName>c</displayName><value>7</value></Data><Data name="P"><value>1,5</value></Data><Data name="none"/>
<SchemaData schemaUrl="#s"><SimpleData name="depth"> 0-20 </SimpleData><SimpleData name="P">2,5</SimpleData></SchemaData></ExtendedData><Point><coordinates>
 -47.5,-21.25,0 1,1 </coordinates></Point></Placemark>
<kml:Placemark><kml:Point gx:mode="x"><kml:coordinates>10,20</kml:coordinates></kml:Point></kml:Placemark>
<Placemark><name>line</name><LineString><coordinates>1,2 3,4</coordinates></LineString></Placemark>
<Placemark><name>twice</name><MultiGeometry><Point><coordinates>1,2</coordinates></Point><Point><coordinates>3,4</coordinates></Point></MultiGeometry></Placemark>
<Placemark><name>nothing</name><Point><coordinates> </coordinates></Point></Placemark>
</Document></kml:kml>"""


def test_kml_points(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML, "utf-8")
    (tmp_path / "b.kml").write_text("<kml></kml>", "utf-8")
    got = {(r.x, r.y): r.props for r in readers.kml_points(spark, str(tmp_path)).collect()}
    assert got == {(-47.5, -21.25): {"name": "A & B", "code": "c", "P": "2,5", "none": "", "depth": "0-20"}, (10.0, 20.0): {"name": ""}, (3.0, 4.0): {"name": "twice"}}
