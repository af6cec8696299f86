"""Contour files read by the data source: kinds of files, namespaces, comments, bad files, filters that reach the parser."""

import io
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from rainfold.sources import contour_files, readers


def mark(name, line="1,2 3,4", more=""):
    return f"<k:Placemark><k:name>{name}</k:name>{more}<k:LineString><k:coordinates>{line}</k:coordinates></k:LineString></k:Placemark>"


def document(*marks):
    return f'<?xml version="1.0"?><k:kml xmlns:k="urn:any"><k:Document><k:name>9 is no contour</k:name><k:Folder>{"".join(marks)}</k:Folder></k:Document></k:kml>'


def parsed(text, **options):
    return list(contour_files.contours_of(io.BytesIO(text.encode()), "it", **options))


def test_what_is_a_contour():
    own = '<k:ExtendedData><k:Data name="Fid"><k:value>7</k:value></k:Data><k:SimpleData name="ID">x</k:SimpleData></k:ExtendedData>'
    nested = "<k:Placemark><k:name>5</k:name><k:MultiGeometry><k:LineString><k:coordinates>8,9</k:coordinates></k:LineString></k:MultiGeometry></k:Placemark>"
    got = parsed(document(mark("270 m"), f"<!-- {mark(1)} -->", mark("<![CDATA[ -2.5<3 ]]>", more=own), mark("hill"), mark("4", "a,b 1"), nested, "<k:Placemark/>", mark("277", " 5,6,7 bad ")))
    assert got == [(0, 0, 270.0, "1,2 3,4"), (1, 7, -2.5, "1,2 3,4"), (4, 4, 5.0, "8,9"), (6, 6, 277.0, " 5,6,7 bad ")]
    assert [r[0] for r in parsed(document(*map(mark, range(6))), passes=[GreaterThan(("elevation",), 1.0), LessThanOrEqual(("elevation",), 4.0)])] == [2, 3, 4]
    assert parsed(document(mark(1)), passes=[EqualTo(("elevation",), 3.0)]) == []  # a file with contours, though none passes


@pytest.mark.parametrize("text", ["", "  ", "<kml>", "<kml/>", document(), document(mark("hill")), document(mark("4", ""))])
def test_files_without_contours(text):
    with pytest.raises(ValueError):
        parsed(text)
    assert parsed(text, strict=False) == []


def test_a_torn_file_gives_what_came_before():
    torn = document(mark(1), mark(2))[:-60]
    assert len(parsed(torn, strict=False)) == 1
    with pytest.raises(ValueError, match="well-formed"):
        parsed(torn)


def archive(path, **entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in entries.items():
            z.writestr(name.replace("_", "."), text)


def test_folders_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(contour_files, "PART_FILES", 2)
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.kml").write_text(document(mark(1), mark(2)))
    (tmp_path / "deep" / "b.KML").write_text(document(mark(3)))
    (tmp_path / "_SUCCESS").write_text("")
    archive(tmp_path / "c.kmz", x_kml=document(mark(4)), doc_kml=document(mark(5)), y_txt="no")
    archive(tmp_path / "d.kmz", x_kml=document(mark(6)), y_kml=document(mark(7)))
    got = contour_files.read(spark, str(tmp_path))
    assert got.columns == ["path", "entry", "idx", "contour_id", "elevation", "coordinates"]
    found = [(r["path"][-5:], r["entry"], r["elevation"]) for r in got.orderBy("elevation").collect()]
    assert found == [("a.kml", None, 1.0), ("a.kml", None, 2.0), ("b.KML", None, 3.0), ("c.kmz", "doc.kml", 5.0), ("d.kmz", "x.kml", 6.0)]
    parts = contour_files.ContourReader({"path": str(tmp_path)}).partitions()
    assert [[p[-5:] for p in part.paths] for part in parts] == [["a.kml", "c.kmz"], ["d.kmz", "b.KML"]]
    assert contour_files.read(spark, f"file://{tmp_path}/d.kmz").count() == 1
    assert [tuple(p) for p in contour_files.read(spark, f"file:{tmp_path}/a.kml").first()["coordinates"]] == [(1.0, 2.0), (3.0, 4.0)]

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = contour_files.read(spark, str(tmp_path)).where((F.col("elevation") > 2) & (F.col("elevation") <= 5) & (F.col("idx") < 9))
        assert {r["elevation"] for r in pushed.collect()} == {3.0, 5.0}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")

    (tmp_path / "empty").mkdir()
    assert contour_files.read(spark, str(tmp_path / "empty")).count() == 0
    (tmp_path / "e.kmz").write_bytes(b"no zip")
    with pytest.raises(PySparkException, match="no KMZ archive"):
        contour_files.read(spark, str(tmp_path)).count()
    archive(tmp_path / "e.kmz", y_txt="no")
    with pytest.raises(PySparkException, match="no KML document"):
        contour_files.read(spark, str(tmp_path)).count()
    assert contour_files.read(spark, str(tmp_path), "permissive").count() == 5
    (tmp_path / "f.txt").write_text("")
    with pytest.raises(PySparkException, match="unknown kind of file"):
        contour_files.read(spark, str(tmp_path), "permissive").count()
    with pytest.raises(PySparkException, match="is not there"):
        contour_files.read(spark, str(tmp_path / "nowhere")).count()


def test_written_files_are_read_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, document(mark(1)), False), (2, document(mark(2), mark(3)), True)], "name bigint, xml string, packed boolean")
    for _ in range(2):
        contour_files.write(rows, str(tmp_path / "out"))
    assert sorted((r["path"][-5:], r["elevation"]) for r in contour_files.read(spark, str(tmp_path / "out")).collect()) == [("1.kml", 1.0), ("2.kmz", 2.0), ("2.kmz", 3.0)]


def test_documents_are_not_written_by_batches_of_rows(spark, tmp_path, monkeypatch):
    """An Arrow batch held a partition's documents at once."""
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda *_: pytest.fail("batches of documents"))
    rows = spark.createDataFrame([(k, document(mark(k), mark(k + 0.5)), k % 2 == 1) for k in range(5)], "name long, xml string, packed boolean")
    contour_files.write(rows, str(tmp_path / "out"))
    got = contour_files.read(spark, str(tmp_path / "out")).select("elevation", "entry").collect()
    assert sorted(map(tuple, got)) == [(k + h, "doc.kml" if k % 2 else None) for k in range(5) for h in (0.0, 0.5)]


def test_placemarks_are_parsed_once(spark):
    """An XPath for each part parsed the text again; texts are still those that XPath's text() gives."""
    inner = '<x:Placemark a:b="1"><x:name><!-- 9 --> 27<![CDATA[0]]></x:name><x:ExtendedData><x:Data name="Other"><x:value>4</x:value></x:Data><x:Data name="FID"><x:value> 12 </x:value></x:Data></x:ExtendedData>'
    inner += "<x:MultiGeometry><x:LineString><x:coordinates>8,9</x:coordinates></x:LineString></x:MultiGeometry><x:LineString><x:coordinates>1,2 &#51;,4</x:coordinates></x:LineString></x:Placemark>"
    made = readers.contours(spark.createDataFrame([("d", f"<kml>{inner}{mark('hill')}{mark(-5)}</kml>")], "doc string, xml string"))
    assert "xpath" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
    got = [(r["doc"], r["idx"], r["contour_id"], r["elevation"], [tuple(p) for p in r["coordinates"]]) for r in made.collect()]
    assert got == [("d", 0, 12, 27.0, [(1.0, 2.0), (3.0, 4.0)]), ("d", 2, 2, -5.0, [(1.0, 2.0), (3.0, 4.0)])]
