"""Readers of network packages: ZIP archives of text tables.

An archive is not splittable, so the unit of parallelism is the package file: `path` may be a list or a glob over
thousands of packages. Spark fetches the bytes (any file system it knows) and one task per file reads the asked
member in file order into (path, line_no, head, cells) rows; a row carries the header of its own file, so packages
may differ in their columns. All that follows is columnar, and every window and join is keyed by `path`, so
packages never mix. `path` is in the result when a list or glob was asked for, or with keep_path=True.

Members whose columns are known are read once. Extra attributes and traffic results have columns of any name:
without `attributes` a first pass reads the header lines.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple, TextIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.functions.text import eng_notation, line_operator, line_route
from odweave.operators import network

Paths = str | Sequence[str]
Row = tuple[int, list[str], list[str]]
Parser = Callable[[TextIO], Iterator[Row]]
Report = Callable[[str], None]

ROWS = "path string, line_no long, head array<string>, cells array<string>"
ROWS_A_BATCH = 50_000
#: The base network's headers that the tables name otherwise, and the columns of vehicles.
RENAMED = {"x-coord": "x", "y-coord": "y", "from": "inode", "to": "jnode", "typ": "type", "lan": "lanes"}
VEHICLE_COLUMNS = "id description mode fleet_size seated_capacity total_capacity cost_time_coeff cost_distance_coeff energy_time_coeff energy_distance_coeff auto_equivalent".split()
QUOTED = re.compile(r"'([^']*)'|(\S+)")


class CsvOptions(NamedTuple):
    """How a CSV member is written."""

    sep: str = ","
    quote: str = '"'
    encoding: str = "utf-8"
    skip_rows: int = 0
    comment: str | None = None
    na_values: tuple[str, ...] = ()


# --- lines of a member, in file order ---------------------------------------------------------------------------


def _csv_rows(options: CsvOptions, header_only: bool = False) -> Parser:
    """Trimmed cells below a header line of trimmed names."""

    def parse(lines: TextIO) -> Iterator[Row]:
        rest = itertools.islice(lines, options.skip_rows, None)
        if options.comment:
            rest = (x.split(options.comment, 1)[0] for x in rest)
        reader = csv.reader(rest, delimiter=options.sep, quotechar=options.quote, skipinitialspace=True)
        head: list[str] = []
        for cells in reader:
            cells = [x.strip() for x in cells]
            if not any(cells):
                continue
            if not head:
                head = cells
                if header_only:
                    yield 1, head, []
                    return
            else:
                yield options.skip_rows + reader.line_num, head, [None if x in options.na_values else x for x in cells]

    return parse


def _section_rows(section: str, quoted: bool = False) -> Parser:
    """Rows between a 't <section>' line and the next 't' line; the first comment line there is the header."""

    def parse(lines: TextIO) -> Iterator[Row]:
        inside, head = False, None
        for i, raw in enumerate(lines, 1):
            line = raw.strip()
            if line.startswith("t "):
                inside = line.split()[1:2] == [section]
            elif not inside or not line:
                continue
            elif line == "c" or line.startswith(("c ", "c\t")):
                head = head or [RENAMED.get(x, x) for x in line.lower().split()]
            elif head is None:
                raise ValueError(f"section {section} has no header line")
            else:
                yield i, head, [(a or b).strip() for a, b in QUOTED.findall(line)] if quoted else line.split()

    return parse


def _transit_rows(lines: TextIO) -> Iterator[Row]:
    """Rows of transit lines (head: 'a', its id) and of their stops (head: 's', the id of the line they follow)."""
    current = None
    for i, raw in enumerate(lines, 1):
        line = raw.strip()
        if not line or line.startswith(("c", "t", "path")):
            continue
        if line.startswith("a"):
            cells = line.replace("'", " ").split()
            current = cells[1]
            yield i, ["a", current], cells
        else:
            yield i, ["s", current], line.split()


def member_rows(spark: SparkSession, path: Paths, member: str, parse: Parser, *, encoding: str = "utf-8", required: bool = True) -> DataFrame:
    """(path, line_no, head, cells) of one member of each package."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.list_(pa.string())
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    if member not in archive.namelist():
                        if required:
                            raise FileNotFoundError(f"{name} has no member {member}")
                        continue
                    with archive.open(member) as raw:
                        rows = parse(io.TextIOWrapper(raw, encoding, newline=""))
                        while some := list(itertools.islice(rows, ROWS_A_BATCH)):
                            no, head, cells = zip(*some, strict=True)
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(no, pa.int64()), pa.array(head, texts), pa.array(cells, texts)], names=["path", "line_no", "head", "cells"])

    files = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path))
    return files.select("path", "content").mapInArrow(decode, ROWS)


def _cell(name: str) -> Column:
    """The cell below a header name; null where the row's file lacks the column."""
    return F.get("cells", F.array_position("head", name).cast("int") - 1)


def _at(i: int | Column) -> Column:
    return F.get("cells", F.lit(i) if isinstance(i, int) else i)


def _names(spark: SparkSession, path: Paths, member: str, options: CsvOptions) -> list[str]:
    """Column names of all packages, in the order of the first that has each; as many rows as there are layouts."""
    heads = member_rows(spark, path, member, _csv_rows(options, True), encoding=options.encoding)
    found = heads.groupBy("head").agg(F.min("path").alias("p")).orderBy("p").collect()
    return list(dict.fromkeys(n for r in found for n in r["head"]))


def _keys(path: Paths, keep_path: bool | None) -> list[str]:
    many = not isinstance(path, str) or any(c in path for c in "*?[{")
    return ["path"] if (many if keep_path is None else keep_path) else []


# --- tables -----------------------------------------------------------------------------------------------------


def modification_counts(spark: SparkSession, path: Paths) -> DataFrame:
    """(path, modifications): link records of type m in each package."""
    rows = member_rows(spark, path, "base.211", _section_rows("links"))
    return rows.groupBy("path").agg(F.count_if(_at(0) == "m").alias("modifications"))


def base_network(spark: SparkSession, path: Paths, *, keep_path: bool | None = None, report: Report | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of `base.211`; link records of type m (modifications) are left out.

    `report` is given a message about those left out, which takes a pass over the packages.
    """
    keys = _keys(path, keep_path)
    if report and (n := modification_counts(spark, path).agg(F.sum("modifications")).first()[0]):
        report(f"{n} modification records of links left out")
    number = lambda c: _cell(c).cast("double").alias(c)
    whole = lambda c, kind: _cell(c).cast(kind).alias(c)
    nodes = member_rows(spark, path, "base.211", _section_rows("nodes"))
    nodes = nodes.select(*keys, whole("node", "long"), *[number(c) for c in ("x", "y", "data1", "data2", "data3")], _cell("label").alias("label"), (_at(0) == "a*").alias("is_centroid"))
    links = member_rows(spark, path, "base.211", _section_rows("links")).where(_at(0) != "m")
    links = links.select(
        *keys, whole("inode", "long"), whole("jnode", "long"), eng_notation(_cell("length")).alias("length"), _cell("modes").alias("modes"),
        *[whole(c, "int") for c in ("type", "lanes", "vdf")], *[eng_notation(_cell(c)).alias(c) for c in ("data1", "data2", "data3")],
    )
    return nodes, links


def attribute_list(spark: SparkSession, path: Paths, *, keep_path: bool | None = None, **options: object) -> DataFrame:
    """The extra attributes that `exatts.241` declares; options: see CsvOptions."""
    how = CsvOptions(**{"quote": "'", **options})
    names = _names(spark, path, "exatts.241", how)
    rows = member_rows(spark, path, "exatts.241", _csv_rows(how), encoding=how.encoding)
    return rows.select(*_keys(path, keep_path), *[_cell(n).alias(n) for n in names])


def _attributes(spark: SparkSession, path: Paths, kind: str, index: dict[str, str], attributes: str | Sequence[str] | None, keep_path: bool | None, options: dict) -> DataFrame:
    member, how = f"exatt_{kind}.241", CsvOptions(**{"quote": "'", **options})
    if attributes is None:
        wanted = [n for n in _names(spark, path, member, how) if n not in index]
    else:
        wanted = [attributes] if isinstance(attributes, str) else list(attributes)
        wanted = [a if a.startswith("@") or a in index else f"@{a}" for a in wanted]
    rows = member_rows(spark, path, member, _csv_rows(how), encoding=how.encoding)
    value = lambda c: _cell(c).try_cast("double") if c.startswith("@") else _cell(c)
    return rows.select(*_keys(path, keep_path), *[_cell(k).cast(t).alias(k) for k, t in index.items()], *[value(c).alias(c) for c in wanted])


def node_attributes(spark: SparkSession, path: Paths, attributes: str | Sequence[str] | None = None, *, keep_path: bool | None = None, **options: object) -> DataFrame:
    """(inode, attributes); '@' is put before a name that lacks it; options: see CsvOptions."""
    return _attributes(spark, path, "nodes", {"inode": "long"}, attributes, keep_path, options)


def link_attributes(spark: SparkSession, path: Paths, attributes: str | Sequence[str] | None = None, *, keep_path: bool | None = None, **options: object) -> DataFrame:
    return _attributes(spark, path, "links", {"inode": "long", "jnode": "long"}, attributes, keep_path, options)


def line_attributes(spark: SparkSession, path: Paths, attributes: str | Sequence[str] | None = None, *, keep_path: bool | None = None, **options: object) -> DataFrame:
    return _attributes(spark, path, "transit_lines", {"line": "string"}, attributes, keep_path, options)


def traffic_results(spark: SparkSession, path: Paths, *, keep_path: bool | None = None) -> DataFrame:
    """(inode, jnode, every result column as double)."""
    names = [n for n in _names(spark, path, "link_results.csv", CsvOptions()) if n not in ("i", "j")]
    rows = member_rows(spark, path, "link_results.csv", _csv_rows(CsvOptions()))
    return rows.select(*_keys(path, keep_path), _cell("i").cast("long").alias("inode"), _cell("j").cast("long").alias("jnode"), *[_cell(n).try_cast("double").alias(n) for n in names])


def traffic_results_at_countpost(spark: SparkSession, path: Paths, attribute: str, *, keep_path: bool | None = None) -> DataFrame:
    keys = _keys(path, keep_path)
    posts = link_attributes(spark, path, attribute, keep_path=True)
    return network.at_countposts(traffic_results(spark, path, keep_path=True), posts, attribute, by=("path",)).drop(*{"path"} - set(keys))


def transit_network(spark: SparkSession, path: Paths, *, parse_line_id: bool = False, keep_path: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, segments) of `transit.221`.

    A line starting with 'a' heads a transit line, others are its stops in file order; comments, 't' and
    'path' lines are skipped. The last stop of a line has no attributes and leaves the segments after giving
    its node to the stop before.
    """
    keys, n = _keys(path, keep_path), F.size("cells")
    rows = member_rows(spark, path, "transit.221", _transit_rows)
    heads = rows.where(F.get("head", F.lit(0)) == "a")
    lines = heads.select(
        *keys, _at(1).alias("line"), F.array_join(F.slice("cells", 7, F.greatest(n - 9, F.lit(0))), " ").alias("description"), _at(2).alias("mode"), _at(3).cast("int").alias("veh"),
        _at(4).cast("double").alias("headway"), _at(5).cast("double").alias("speed"), *[_at(n - 3 + i).cast("double").alias(f"data{i + 1}") for i in range(3)],
    )
    if parse_line_id:
        rest = [c for c in lines.columns if c not in (*keys, "line")]
        lines = lines.select(*keys, "line", line_operator(F.col("line")).alias("operator"), line_route(F.col("line")).alias("route"), *rest)
    stops = rows.where(F.get("head", F.lit(0)) == "s").select("path", "line_no", F.get("head", F.lit(1)).alias("line"), "cells", _at(0).cast("long").alias("inode"))
    segments = network.sequence_segments(stops, by=("path",)).where(n >= 6)
    value = lambda i, name: F.replace(_at(i), F.lit(f"{name}="), F.lit(""))
    return lines, segments.select(
        *keys, "line", "inode", "jnode", "seg_seq", "loop", value(1, "dwt").alias("dwt"), value(2, "ttf").cast("short").alias("ttf"), *[value(2 + i, f"us{i}").cast("double").alias(f"us{i}") for i in (1, 2, 3)]
    )


def _segment_csv(spark: SparkSession, path: Paths) -> DataFrame:
    kinds = {"line": "string", "i": "long", "j": "long", "loop": "int", "transit_boardings": "double", "transit_volume": "double"}
    rows = member_rows(spark, path, "segment_results.csv", _csv_rows(CsvOptions()))
    return rows.select("path", *[_cell(c).cast(k).alias(c) for c, k in kinds.items()])


def transit_segment_results(spark: SparkSession, path: Paths, *, keep_path: bool | None = None, report: Report | None = None) -> DataFrame:
    """Boardings, alightings and volume by segment; `report` is told how many segments have no result (a pass more)."""
    segments, results = transit_network(spark, path, keep_path=True)[1], _segment_csv(spark, path)
    if report and (n := network.missing_results(segments, results, by=("path",))):
        report(f"{n} segments without results are set to 0")
    return network.segment_results(segments, results, by=("path",)).drop(*{"path"} - set(_keys(path, keep_path)))


def transit_result_summary(spark: SparkSession, path: Paths, *, parse_line_id: bool = False, aggregate: bool = False, keep_path: bool | None = None) -> DataFrame:
    return network.result_summary(_segment_csv(spark, path), parse_line_id=parse_line_id, aggregate=aggregate, by=tuple(_keys(path, keep_path)))


def transit_station_results(spark: SparkSession, path: Paths, nodes: Sequence[int], *, keep_path: bool | None = None) -> DataFrame:
    """on and off at station nodes, by node; the file must have one value column beside i and j."""
    keys = _keys(path, keep_path)
    value = [n for n in _names(spark, path, "aux_transit_results.csv", CsvOptions()) if n not in ("i", "j")]
    rows = member_rows(spark, path, "aux_transit_results.csv", _csv_rows(CsvOptions()))
    flows = rows.select(*keys, _cell("i").cast("long").alias("i"), _cell("j").cast("long").alias("j"), *[_cell(n).try_cast("double").alias(n) for n in value])
    return network.station_results(flows, nodes, by=tuple(keys))


def transit_vehicles(spark: SparkSession, path: Paths, *, keep_path: bool | None = None) -> DataFrame:
    rows = member_rows(spark, path, "vehicles.202", _section_rows("vehicles", quoted=True))
    kinds = {"id": "int", "description": "string", "mode": "string", "fleet_size": "int"}
    return rows.select(*_keys(path, keep_path), *[_cell(n).cast(kinds.get(n, "double")).alias("veh_id" if n == "id" else n) for n in VEHICLE_COLUMNS])
