"""Readers of contours, maps, rain and land as DataFrames, of contour files see `contour_files`; writers for rasters and responses."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainfold.functions import parsing

#: Names of an id in a placemark's extended data, compared in small letters (fixed values of the files).
ID_NAMES = ["id", "contour_id", "fid"]


def placemarks(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """documents + (idx, mark): one row a placemark, numbered from 0 in document order, skipped ones counted too."""
    mark = r"(?s)<(?:[A-Za-z0-9_]+:)?Placemark[\s>].*?</(?:[A-Za-z0-9_]+:)?Placemark>"
    plain = F.regexp_replace(F.col(xml), r"\s+xmlns(:[A-Za-z0-9_]+)?=(\"[^\"]*\"|'[^']*')", "")
    bare = F.regexp_replace(plain, r"<(/?)[A-Za-z0-9_]+:", "<$1")
    rest = [c for c in documents.columns if c != xml]
    return documents.select(*rest, F.posexplode(F.regexp_extract_all(bare, F.lit(mark), F.lit(0))).alias("idx", "mark"))


def _texts(mark: str) -> tuple[str | None, str | None, list[str | None], list[str]]:
    """Of a placemark in one pass: the first texts of its name and of its line's coordinates (its own line's before nested ones'), names and values of extended data."""
    above: list[str] = []
    name, own, nested, names, values = [], [], [], [], []

    def start(tag: str, attributes: dict[str, str]) -> None:
        above.append(tag.rsplit(":", 1)[-1])
        if above[-1] in ("SimpleData", "Data") and "name" in attributes:
            names.append(attributes["name"])

    def text(found: str) -> None:
        if above[-1] == "coordinates" and above[-2:-1] == ["LineString"]:
            (own if above[:-2] == ["Placemark"] else nested).append(found)
        elif above == ["Placemark", "name"]:
            name.append(found)
        elif above[-1] == "SimpleData" or above[-2:] == ["Data", "value"]:
            values.append(found)

    parser = expat.ParserCreate()
    parser.buffer_text, parser.buffer_size = True, max(1, min(len(mark.encode()), 1 << 20))
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda _: above.pop(), text
    parser.CommentHandler = parser.ProcessingInstructionHandler = lambda *_: None  # these part texts
    parser.StartCdataSectionHandler = parser.EndCdataSectionHandler = lambda: None
    parser.Parse(mark, True)
    return next(iter(name), None), next(iter(own or nested), None), names, values


def contours(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """documents' other columns + (idx, contour_id, elevation, coordinates) of the placemarks that are contours.

    A contour has a name that starts with a number and a LineString with a coordinate; others are left out. Each placemark is parsed once.
    """
    marks = placemarks(documents, xml)
    kept = {c: k for c, k in marks.dtypes if c != "mark"}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_texts(m) for m in b.column("mark").to_pylist()]
            columns = {c: b.column(c) for c in kept}
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
            made = {c: pa.array([g[i] for g in got], k) for i, (c, k) in enumerate(zip(("name__", "line__", "names__", "values__"), kinds))}
            yield pa.RecordBatch.from_pydict(columns | made)

    kinds = ", ".join(f"`{c}` {k}" for c, k in kept.items())
    texts = marks.mapInArrow(parse, f"{kinds}, name__ string, line__ string, names__ array<string>, values__ array<string>")
    names = F.transform("names__", F.lower)
    own = F.get(F.filter(F.zip_with(names, F.col("values__"), lambda n, v: F.when(n.isin(ID_NAMES), F.trim(v).try_cast("bigint"))), lambda v: v.isNotNull()), F.lit(0))
    made = texts.withColumns({"elevation": parsing.elevation_of(F.col("name__")), "coordinates": parsing.coordinates_of(F.col("line__")), "contour_id": F.coalesce(own, F.col("idx").cast("bigint"))})
    return made.where(F.col("elevation").isNotNull() & (F.size("coordinates") > 0)).drop("name__", "line__", "names__", "values__")


def kml_text(contour_rows: DataFrame, by: str) -> DataFrame:
    """(by, xml): contours (contour_id, elevation, coordinates) written as one KML document for each value of `by`."""
    pairs = F.array_join(F.transform("coordinates", lambda p: F.concat_ws(",", p["lon"].cast("string"), p["lat"].cast("string"), F.lit("0"))), " ")
    mark = F.concat(F.lit("<Placemark><name>"), F.col("elevation").cast("string"), F.lit(' m</name><ExtendedData><Data name="ID"><value>'), F.col("contour_id").cast("string"), F.lit("</value></Data></ExtendedData><LineString><coordinates>"), pairs, F.lit("</coordinates></LineString></Placemark>"))
    whole = contour_rows.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("contour_id", mark.alias("m")))), lambda x: x["m"]), "").alias("body"))
    return whole.select(by, F.concat(F.lit('<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), "body", F.lit("</Document></kml>")).alias("xml"))


def rain_of_json(rows: DataFrame, column: str = "value") -> DataFrame:
    """rows' other columns + (day, rain_mm) of JSON texts that map YYYYMMDD to millimetres; values that are no number are null."""
    rest = [c for c in rows.columns if c != column]
    found = rows.select(*rest, F.explode(F.from_json(column, "map<string,string>")).alias("k", "v"))
    return found.select(*rest, F.to_date("k", "yyyyMMdd").alias("day"), F.col("v").try_cast("double").alias("rain_mm"))


def read_rain(spark: SparkSession, path: str) -> DataFrame:
    return rain_of_json(spark.read.text(path, wholetext=True))


def land_of_geojson(rows: DataFrame, column: str = "geojson") -> DataFrame:
    """rows' other columns + (rings ARRAY<ARRAY<STRUCT<x, y>>>): a Polygon, or a Feature that holds one; null otherwise."""
    shape = "struct<type:string,coordinates:array<array<array<double>>>>"
    parsed = F.from_json(column, f"struct<type:string,coordinates:array<array<array<double>>>,geometry:{shape}>")
    polygon = F.when(F.col("g.type") == "Feature", F.when(F.col("g.geometry.type") == "Polygon", F.col("g.geometry.coordinates"))).when(F.col("g.type") == "Polygon", F.col("g.coordinates"))
    rings = F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    rest = [c for c in rows.columns if c != column]
    return rows.withColumn("g", parsed).select(*rest, rings.alias("rings"))


def geojson_of(points: Column) -> Column:
    """A GeoJSON polygon text of a ring."""
    pairs = F.transform(points, lambda p: F.array(p["x"], p["y"]))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(pairs).alias("coordinates")))


def osm_objects(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Nodes, ways or relations of map XML files, by Spark's XML source with a fixed schema."""
    tags = "tag array<struct<_k:string,_v:string>>"
    schema = {
        "node": f"_id bigint, _lon double, _lat double, {tags}",
        "way": f"_id bigint, nd array<struct<_ref:bigint>>, {tags}",
        "relation": f"_id bigint, member array<struct<_type:string,_ref:bigint,_role:string>>, {tags}",
    }[kind]
    rows = spark.read.format("xml").option("rowTag", kind).schema(schema).load(path)
    named = F.map_from_entries(F.coalesce(F.col("tag"), F.array().cast("array<struct<_k:string,_v:string>>"))).alias("tags")
    if kind == "node":
        return rows.select(F.col("_id").alias("node_id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), named)
    if kind == "way":
        return rows.select(F.col("_id").alias("way_id"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), named)
    return rows.select(F.col("_id").alias("relation_id"), F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"))).alias("members"), named)


def elements_of_json(rows: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(ways, relations) of JSON texts whose `elements` carry their geometry, as `surfaces.water_features` takes them.

    A way or member without geometry, or with a point that lacks a coordinate, counts as missing. Texts with a `remark` are
    incomplete answers and raise an error, as do those without elements.
    """
    point = "array<struct<lat:double,lon:double>>"
    member = f"struct<type:string,ref:bigint,role:string,geometry:{point}>"
    parsed = F.from_json(column, f"struct<remark:string,elements:array<struct<type:string,id:bigint,tags:map<string,string>,geometry:{point},members:array<{member}>>>>")
    whole = rows.select(parsed.alias("j")).select(F.when(F.col("j.remark").isNotNull() | F.col("j.elements").isNull(), F.raise_error(F.lit("the map data is incomplete")).cast("array<string>")).alias("bad"), F.col("j.elements").alias("elements"))
    each = whole.where(F.col("bad").isNull()).select(F.explode("elements").alias("e"))

    def lacks(line: Column) -> Column:
        return F.coalesce((F.size(line) < 1) | F.exists(line, lambda p: p["lon"].isNull() | p["lat"].isNull()), F.lit(True))

    def placed(line: Column) -> Column:
        return F.transform(line, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))

    tags = F.coalesce(F.col("e.tags"), F.create_map().cast("map<string,string>")).alias("tags")
    ways = each.where("e.type = 'way'").select(F.col("e.id").alias("way_id"), tags, placed(F.col("e.geometry")).alias("geometry"), lacks(F.col("e.geometry")).cast("int").alias("missing"))
    of_ways = F.filter(F.coalesce("e.members", F.array().cast(f"array<{member}>")), lambda m: m["type"] == "way")
    made = F.transform(of_ways, lambda m: F.struct(m["role"].alias("role"), placed(m["geometry"]).alias("geometry")))
    relations = each.where("e.type = 'relation'").select(F.col("e.id").alias("relation_id"), tags, made.alias("members"), F.size(F.filter(of_ways, lambda m: lacks(m["geometry"]))).alias("missing"))
    return ways, relations


def write_raster(cells: DataFrame, path: str) -> None:
    """A raster in Parquet, partitioned by survey, so that a survey is read alone."""
    cells.write.mode("overwrite").partitionBy("survey").parquet(path)


def raster_key(*parts: str) -> str:
    """A name for a stored raster: a digest of its adapter, source and grid."""
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


def read_raster(spark: SparkSession, path: str, need_finite: bool = False, shape: tuple[int, int] | None = None) -> DataFrame:
    """A raster written before; with need_finite a missing height raises an error, with a shape a survey of other numbers of rows and columns."""
    cells = spark.read.parquet(path)
    if need_finite:
        bad = F.col("z").isNull() | F.isnan("z")
        cells = cells.withColumn("z", F.when(bad, F.raise_error(F.lit("a cell of the raster has no height")).cast("double")).otherwise(F.col("z")))
    if shape is not None:
        sizes = cells.groupBy(F.col("survey").alias("of__")).agg(((F.max("row") == shape[0] - 1) & (F.max("col") == shape[1] - 1) & (F.min("row") == 0) & (F.min("col") == 0) & (F.count(F.lit(1)) == shape[0] * shape[1])).alias("fits__"))
        checked = sizes.withColumn("of__", F.when(F.col("fits__"), F.col("of__")).otherwise(F.raise_error(F.lit("a survey of the raster has another shape")).cast(sizes.schema["of__"].dataType)))
        cells = cells.join(checked.drop("fits__"), F.col("survey").eqNullSafe(F.col("of__"))).drop("of__")
    return cells


def mosaic(tiles: DataFrame) -> DataFrame:
    """One height for each cell of overlapping tiles (survey, row, col, tile_order, z): of the valid ones the last tile's."""
    return tiles.groupBy("survey", "row", "col").agg(F.max_by("z", F.when(F.col("z").isNotNull() & ~F.isnan("z"), F.col("tile_order"))).alias("z"))


def write_response(df: DataFrame, path: str, hidden: tuple[str, ...] = ("row", "col")) -> None:
    """Rows as JSON lines without the grid positions."""
    df.drop(*hidden).write.mode("overwrite").json(path)
