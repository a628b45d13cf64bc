"""Binary matrix files: mdf, emx and row-numbered Fortran records.

Reading is a Python data source ("odmatrix") whose partitions are ranges of matrix rows addressed by byte
offset, so a large matrix is read by many tasks and none holds more than its rows. Writing streams the ordered
rows to one file, a row at a time; the matrix is made once and kept in the shared folder for its passes. Paths must be on a file system that driver and executors mount alike.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from odweave.operators.zones import densify, zone_list, zone_ordinals
from odweave.session import written

MAGIC, VERSION = 0xC4D4F1B2, 1
#: Cell types of mdf files by their number.
MDF_TYPES = {1: "<f4", 2: "<f8", 3: "<i4", 4: "<u4"}
ROWS_A_PARTITION = 256


class Layout(NamedTuple):
    dtype: str
    rows: int
    cols: int
    offset: int
    stride: int
    row_labels: list[int]
    col_labels: list[int]
    vector: bool = False


def _mdf_header(path: str) -> Layout:
    with open(path, "rb") as f:
        head = f.read(16)
        if len(head) < 16:
            raise OSError(f"{path}: not an mdf file")
        magic, version, kind, ndim = struct.unpack("<4I", head)
        if magic != MAGIC or version != VERSION or kind not in MDF_TYPES or ndim not in (1, 2):
            raise OSError(f"{path}: bad mdf header {magic:#x}, {version}, {kind}, {ndim}")
        shape = struct.unpack(f"<{ndim}I", f.read(4 * ndim))
        labels = [np.frombuffer(f.read(4 * n), "<i4").tolist() for n in shape]
        width, at = np.dtype(MDF_TYPES[kind]).itemsize, f.tell()
    if ndim == 1:
        return Layout(MDF_TYPES[kind], shape[0], 1, at, width, labels[0], [0], True)
    return Layout(MDF_TYPES[kind], shape[0], shape[1], at, width * shape[1], *labels)


def _labels(zones: str | None, n: int) -> list[int]:
    """zones: a count, which truncates, or comma-separated labels, which truncate and name."""
    if not zones:
        return list(range(n))
    out = [int(x) for x in zones.split(",")] if "," in zones else list(range(int(zones)))
    if len(out) > n:
        raise ValueError(f"{len(out)} zones for a matrix of {n}")
    return out


def _layout(path: str, kind: str, zones: str | None, n_columns: int | None) -> Layout:
    if kind == "mdf":
        return _mdf_header(path)
    words = os.path.getsize(path) // 4
    if kind == "emx":
        n = round(words**0.5)
        if n * n != words:
            raise ValueError(f"{path}: {words} cells are no square")
        lab = _labels(zones, n)
        return Layout("<f4", len(lab), len(lab), 0, 4 * n, lab, lab)
    if kind == "fortran":
        n = n_columns or round(((1 + 4 * words) ** 0.5 - 1) / 2)
        if words % (n + 1) or (not n_columns and words != n * (n + 1)):
            raise ValueError(f"{path}: {words} words do not form records of {n} cells")
        rows = words // (n + 1)
        lab = _labels(zones, n)
        return Layout("<f4", rows if n_columns else len(lab), len(lab), 4, 4 * (n + 1), list(range(rows)) if n_columns else lab, lab)
    raise ValueError(f"unknown kind {kind!r}")


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class OdMatrixSource(DataSource):
    """Options: path, kind (mdf, emx, fortran), zones, n_columns, drop_null, check_rows."""

    @classmethod
    def name(cls) -> str:
        return "odmatrix"

    def schema(self) -> str:
        if self.options.get("kind", "mdf") == "mdf" and _mdf_header(self.options["path"]).vector:
            return "o int, value double"
        return "o int, d int, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = options
        n = options.get("n_columns") or options.get("N_COLUMNS")
        self.kind, self.path, self.n_columns = options.get("kind", "mdf"), options["path"], int(n) if n else None
        self.layout = _layout(self.path, self.kind, options.get("zones"), self.n_columns)

    def partitions(self) -> list[_Range]:
        n = self.layout.rows
        return [_Range(i, min(n, i + ROWS_A_PARTITION)) for i in range(0, n, ROWS_A_PARTITION)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        lay, drop = self.layout, self.o.get("drop_null", "true").lower() == "true"
        cell = np.dtype(lay.dtype)
        with open(self.path, "rb") as f:
            for i in range(part.start, part.stop):
                f.seek(lay.offset + i * lay.stride - (4 if self.kind == "fortran" else 0))
                label = lay.row_labels[i]
                if self.kind == "fortran":
                    stored = struct.unpack("<i", f.read(4))[0] - 1
                    if self.n_columns:
                        label = stored
                        if not 0 <= stored:
                            raise ValueError(f"{self.path}: row number {stored + 1}")
                        if "," in (self.o.get("zones") or ""):
                            if stored >= len(lay.col_labels):
                                continue
                            label = lay.col_labels[stored]
                    elif self.o.get("check_rows", "false").lower() == "true" and stored != i:
                        raise ValueError(f"{self.path}: record {i} has row number {stored + 1}")
                row = np.frombuffer(f.read(cell.itemsize * lay.cols), cell).astype(float)
                for d, v in zip(lay.col_labels, row.tolist(), strict=True):
                    if v == v or not drop:
                        value = v if v == v else None
                        yield (label, value) if lay.vector else (label, d, value)


def _read(spark: SparkSession, path: str, kind: str, **options: object) -> DataFrame:
    spark.dataSource.register(OdMatrixSource)
    reader = spark.read.format("odmatrix").option("path", path).option("kind", kind)
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, ",".join(map(str, v)) + ("," if len(v) == 1 else "") if isinstance(v, (list, tuple)) else str(v))
    return reader.load()


def read_mdf(spark: SparkSession, path: str, *, drop_null: bool = True) -> DataFrame:
    """Tall (o, d, value), or (o, value) for a vector."""
    return _read(spark, path, "mdf", drop_null=drop_null)


def peek_mdf(spark: SparkSession, path: str) -> DataFrame:
    """(dim, position, zone) from the header alone; no cell is read."""
    lay = _mdf_header(path)
    dims = [lay.row_labels] if lay.vector else [lay.row_labels, lay.col_labels]
    return spark.createDataFrame([(i, j, z) for i, labels in enumerate(dims) for j, z in enumerate(labels)], "dim int, position int, zone int")


def read_emx(spark: SparkSession, path: str, *, zones: int | Sequence[int] | None = None, drop_null: bool = True) -> DataFrame:
    return _read(spark, path, "emx", zones=zones, drop_null=drop_null)


def read_fortran_square(spark: SparkSession, path: str, *, zones: int | Sequence[int] | None = None, check_rows: bool = False, drop_null: bool = True) -> DataFrame:
    return _read(spark, path, "fortran", zones=zones, check_rows=check_rows, drop_null=drop_null)


def read_fortran_rectangle(spark: SparkSession, path: str, n_columns: int, *, zones: int | Sequence[int] | None = None, reindex_rows: bool = False, fill_value: float | None = None, drop_null: bool = True) -> DataFrame:
    """Row labels come from the stored row numbers less 1; `reindex_rows` adds missing rows with fill_value."""
    df = _read(spark, path, "fortran", zones=zones, n_columns=n_columns, drop_null=drop_null)
    if not reindex_rows:
        return df
    labels = _labels(",".join(map(str, zones)) if isinstance(zones, (list, tuple)) else (str(zones) if zones else None), n_columns)
    frame = spark.createDataFrame([(z,) for z in labels], "zone int")
    return densify(df, frame, frame, fill=fill_value)


def _ordered_rows(matrix: DataFrame, zones: DataFrame, n_cols: int, value: str) -> Iterator[tuple[int, bytes]]:
    """(row ordinal, float32 cells) in row order, streamed to the driver a row at a time."""
    o, d = (zones.select(F.col("zone").alias(c), F.col("ordinal").alias(f"__{c}")) for c in "od")
    cells = matrix.select("o", "d", F.coalesce(F.col(value).cast("float"), F.lit(0.0).cast("float")).alias("v")).join(o, "o").join(d, "d").where(F.col("__d") < n_cols)
    rows = cells.groupBy("__o").agg(F.collect_list(F.struct("__d", "v")).alias("cells")).orderBy("__o")
    for r in rows.toLocalIterator():
        out = np.zeros(n_cols, "<f4")
        for j, v in r["cells"]:
            out[j] = v
        yield r["__o"], out.tobytes()


def _all_rows(rows: Iterator[tuple[int, bytes]], n: int, n_cols: int) -> Iterator[tuple[int, bytes]]:
    empty, at = np.zeros(n_cols, "<f4").tobytes(), 0
    for i, data in rows:
        for j in range(at, min(i, n)):
            yield j, empty
        if i < n:
            yield i, data
        at = i + 1
    for j in range(at, n):
        yield j, empty


def _once(matrix: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """The matrix and its zones' ordinals, both written."""
    matrix = written(matrix.select("o", "d", value))
    return matrix, written(zone_ordinals(zone_list(matrix)))


def to_mdf(matrix: DataFrame, path: str, *, value: str = "value") -> None:
    """Float32 mdf over the union of both label sets; missing cells are 0."""
    matrix, zones = _once(matrix, value)
    labels = [r["zone"] for r in zones.orderBy("ordinal").collect()]
    n = len(labels)
    with open(path, "wb") as f:
        f.write(struct.pack("<6I", MAGIC, VERSION, 1, 2, n, n))
        f.write(np.array(labels + labels, "<i4").tobytes())
        for _, data in _all_rows(_ordered_rows(matrix, zones, n, value), n, n):
            f.write(data)


def to_emx(matrix: DataFrame, path: str, n_zones: int, *, value: str = "value") -> None:
    """Headerless float32 n x n, padded with 0 or truncated."""
    matrix, zones = _once(matrix, value)
    with open(path, "wb") as f:
        for _, data in _all_rows(_ordered_rows(matrix, zones, n_zones, value), n_zones, n_zones):
            f.write(data)


def to_fortran(matrix: DataFrame, path: str, *, n_columns: int | None = None, min_index: int = 1, force_square: bool = True, value: str = "value") -> None:
    """Records of an int32 row number, counted from min_index, and float32 cells, padded to n_columns."""
    if force_square:
        matrix, zones = _once(matrix, value)
        n_rows = zones.count()
        width, source = n_rows, _ordered_rows(matrix, zones, max(n_columns or 0, n_rows), value)
    else:
        matrix = written(matrix.select("o", "d", value))
        rows = zone_ordinals(matrix.select(F.col("o").alias("zone")))
        cols = zone_ordinals(matrix.select(F.col("d").alias("zone")))
        n_rows, width = rows.count(), cols.count()
        moved = matrix.join(rows.select(F.col("zone").alias("o"), F.col("ordinal").alias("__ro")), "o").join(cols.select(F.col("zone").alias("d"), F.col("ordinal").alias("__co")), "d").select(F.col("__ro").alias("o"), F.col("__co").alias("d"), value)
        both = matrix.sparkSession.range(max(n_rows, width)).select(F.col("id").cast("int").alias("zone"), F.col("id").cast("int").alias("ordinal"))
        source = _ordered_rows(moved, both, max(n_columns or 0, width), value)
    n_cols = max(n_columns or 0, width)
    with open(path, "wb") as f:
        for i, data in _all_rows(source, n_rows, n_cols):
            f.write(struct.pack("<i", min_index + i) + data)
