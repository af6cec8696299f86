"""Contour files as a Spark data source: KML files and KMZ archives, read by a pull parser, small ones together in a partition.

`spark.read.format("contours").load(folder)` after `register(spark)`. Comments and CDATA are what XML says they are, namespaces do not
matter, and a file's elements are dropped once read, so a task holds one placemark and not the file. Comparisons of `elevation` with
numbers are pushed to the parser where the session has spark.sql.python.filterPushdown.enabled.

Folders and files are found by pyarrow's file systems, so a path may be local or a URI that these know.
"""

from __future__ import annotations

import operator
import os
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import IO

from pyarrow import ArrowInvalid, fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from rainfold.functions import parsing
from rainfold.sources.readers import ID_NAMES

SCHEMA = "path string, entry string, idx int, contour_id bigint, elevation double, line string"

COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}

FIRST_NUMBER = re.compile(r"[+-]?[0-9]+(?:[.][0-9]+)?")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def _kind(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower() if "." in os.path.basename(path) else ""


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _number(text: str | None) -> float | None:
    found = FIRST_NUMBER.match((text or "").strip())
    return float(found[0]) if found else None


def _whole(text: str | None) -> int | None:
    try:
        return int(text or "")
    except ValueError:
        return None


def _named(element: ET.Element, name: str) -> Iterator[ET.Element]:
    return (e for e in element.iter() if _local(e.tag) == name)


def _own_id(mark: ET.Element) -> int | None:
    """The first whole number among extended data with an id's name, SimpleData before Data."""
    values = [(e.get("name", ""), e.text) for e in _named(mark, "SimpleData")]
    values += [(e.get("name", ""), v.text) for e in _named(mark, "Data") for v in e if _local(v.tag) == "value"]
    numbers = (_whole(text) for name, text in values if name.lower() in ID_NAMES)
    return next((n for n in numbers if n is not None), None)


def _line(mark: ET.Element) -> str | None:
    """The coordinates of a placemark's own line, or else of the first one within it; null without a pair of numbers."""
    lines = sorted(_named(mark, "LineString"), key=lambda e: not any(e is child for child in mark))
    text = next((c.text for c in lines[0] if _local(c.tag) == "coordinates"), None) if lines else None
    for token in (text or "").split():
        try:
            _ = [float(number) for number in token.split(",")[:2]]
        except ValueError:
            continue
        if "," in token:
            return text
    return None


def contours_of(stream: IO[bytes], name: str, passes: Iterable[Filter] = (), strict: bool = True) -> Iterator[tuple]:
    """(idx, contour_id, elevation, line) of a document's placemarks that are contours, in its order; skipped placemarks are counted.

    With `strict` a document that is empty, no XML, or without a contour raises a ValueError; otherwise what came before the error counts.
    """
    tests = [(COMPARED[type(f)], f.value) for f in passes]
    above: list[ET.Element] = []
    idx, found = 0, 0
    try:
        for event, element in ET.iterparse(stream, ("start", "end")):
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if _local(element.tag) != "Placemark":
                if above and not any(_local(a.tag) == "Placemark" for a in above):
                    above[-1].remove(element)  # what lies outside placemarks is of no use
                continue
            elevation = _number(next((c.text for c in element if _local(c.tag) == "name"), None))
            line = _line(element) if elevation is not None else None
            if line is not None:
                found += 1
                if all(test(elevation, value) for test, value in tests):
                    own = _own_id(element)
                    yield idx, idx if own is None else own, elevation, line
            idx += 1
            if above:
                above[-1].remove(element)
    except ET.ParseError as bad:
        if strict:
            raise ValueError(f"{name} is no well-formed KML: {bad}") from bad
        return
    if strict and not found:
        raise ValueError(f"{name} holds no contour among its {idx} placemarks")


def documents(path: str, strict: bool = True) -> Iterator[tuple[str | None, IO[bytes]]]:
    """(entry, stream) of a file's document: the file itself, or of an archive doc.kml, or else its first .kml entry."""
    system, at = located(path)
    with system.open_input_file(at) as file:
        if _kind(path) == "kml":
            yield None, file
            return
        try:
            box = zipfile.ZipFile(file)
        except (zipfile.BadZipFile, ArrowInvalid) as bad:  # a file too short to hold an end record fails as a bad position
            if strict:
                raise ValueError(f"{path} is no KMZ archive") from bad
            return
        with box:
            entries = [n for n in box.namelist() if _kind(n) == "kml"]
            first = sorted(entries, key=lambda n: n.lower() != "doc.kml")[:1]
            if strict and not first:
                raise ValueError(f"{path} holds no KML document")
            for entry in first:
                with box.open(entry) as stream:
                    yield entry, stream


#: Files of one partition are no more, and begin within so many bytes of its first one.
PART_FILES, PART_BYTES = 256, 32 << 20


@dataclass
class ContourFiles(InputPartition):
    paths: list[str]


class ContourReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options.get("path") or ""
        self.strict = options.get("mode", "strict") != "permissive"
        self.passes: list[Filter] = []

    def partitions(self) -> list[InputPartition]:
        """Groups of files; names that begin with a dot or underscore are left out, other kinds of files raise an error."""
        system, at = located(self.root)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"{self.root} is not there")
        scheme = self.root.split("://")[0] + "://" if "://" in self.root else ""
        host = self.root[len(scheme) :].split(at)[0] if scheme else ""
        infos = [info] if info.is_file else [i for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.is_file]
        shown = sorted((i for i in infos if not i.base_name.startswith((".", "_"))), key=lambda i: i.path)
        strange = [i.path for i in shown if _kind(i.path) not in ("kml", "kmz")]
        if strange:
            raise ValueError(f"unknown kind of file: {strange[0]}")
        parts: list[list[str]] = []
        held = 0
        for one in shown:
            if not parts or len(parts[-1]) == PART_FILES or held >= PART_BYTES:
                parts.append([])
                held = 0
            parts[-1].append(f"{scheme}{host}{one.path}")
            held += one.size or 0
        return [ContourFiles(p) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths if isinstance(partition, ContourFiles) else []:  # an empty folder is read as one partition that is none
            for entry, stream in documents(path, self.strict):
                for row in contours_of(stream, path, self.passes, self.strict):
                    yield path, entry, *row


class PushingReader(ContourReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            if type(one) in COMPARED and one.attribute == ("elevation",):
                self.passes.append(one)
            else:
                yield one


class ContourSource(DataSource):
    """Options: path; mode `strict` (a bad file raises an error) or `permissive` (it gives the contours that can be read); pushdown."""

    @classmethod
    def name(cls) -> str:
        return "contours"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        made = PushingReader if self.options.get("pushdown", "false") == "true" else ContourReader
        return made(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContourSource)


def read(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """(path, entry, idx, contour_id, elevation, coordinates) of all .kml and .kmz files under a path."""
    register(spark)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    rows = spark.read.format("contours").option("mode", mode).option("pushdown", push).load(path)
    return rows.withColumn("coordinates", parsing.coordinates_of(F.col("line"))).where(F.size("coordinates") > 0).drop("line")


def write(rows: DataFrame, folder: str, name: str = "name", text: str = "xml", packed: str = "packed") -> None:
    """Each row's text as folder/name.kml, or packed in name.kmz; a task that runs again writes the same files.

    Rows come to Python in batches of some megabytes, as Arrow's batches, so many rows each, would hold a partition's documents at once.
    """

    def files(documents: Iterator[Row]) -> None:
        system, at = located(folder)
        system.create_dir(at, recursive=True)
        for n, body, box in documents:
            with system.open_output_stream(f"{at}/{n}.{'kmz' if box else 'kml'}") as out:
                if box:
                    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                        archive.writestr("doc.kml", body)
                else:
                    out.write(body.encode())

    rows.select(F.col(name).cast("string"), text, packed).foreachPartition(files)
