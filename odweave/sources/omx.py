"""OMX (HDF5) matrices; needs the optional package openmatrix."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.operators.zones import zone_list, zone_ordinals

ROWS_A_BLOCK = 256


def _need() -> Any:
    """The package, looked for where it is used, as a worker may have it later than this module."""
    try:
        import openmatrix
    except ImportError as absent:
        raise NotImplementedError("reading and writing OMX needs the package openmatrix") from absent
    return openmatrix


def _natural(name: str) -> list:
    import re

    return [int(x) if x.isdigit() else x for x in re.split("([0-9]+)", name)]


def read_omx(spark: SparkSession, path: str, *, tables: Sequence[str] | None = None, mapping: str | None = None) -> DataFrame:
    """Long (matrix, o, d, value), one task per block of rows of a matrix; names in natural order."""
    with _need().open_file(path, "r") as f:
        names = sorted(tables or f.list_matrices(), key=_natural)
        shape = tuple(int(x) for x in f.shape())
        if shape[0] != shape[1]:
            raise ValueError(f"{path}: not square: {shape}")
        labels = [int(x) for x in f.map_entries(mapping)] if mapping else list(range(shape[0]))
    blocks = spark.createDataFrame([(n, i) for n in names for i in range(0, shape[0], ROWS_A_BLOCK)], "matrix string, start int")

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        with _need().open_file(path, "r") as f:
            for batch in batches:
                for name, start in batch.itertuples(index=False):
                    block = np.asarray(f[name][start : start + ROWS_A_BLOCK], float)
                    o = np.repeat(np.array(labels[start : start + len(block)]), block.shape[1])
                    yield pd.DataFrame({"matrix": name, "o": o, "d": np.tile(labels, len(block)), "value": block.ravel()})

    return blocks.repartition(max(1, blocks.count())).mapInPandas(read, "matrix string, o long, d long, value double")


def check_collection(tables: Mapping[str, DataFrame]) -> list:
    """All matrices square over the same labels, no cell twice; the labels in order."""
    if not tables:
        raise ValueError("no matrix")
    common: list | None = None
    for name, m in tables.items():
        if m.groupBy("o", "d").count().where("count > 1").limit(1).count():
            raise ValueError(f"{name}: a cell occurs twice")
        labels = [r["zone"] for r in zone_list(m).orderBy("zone").collect()]
        if common is not None and labels != common:
            raise ValueError(f"{name}: labels differ from those before")
        common = labels
    return common or []


def to_omx(path: str, tables: Mapping[str, DataFrame], *, title: str = "", descriptions: Mapping[str, str] | None = None, attrs: Mapping[str, Mapping[str, Any]] | None = None, mapping_name: str = "zone_numbers", value: str = "value") -> None:
    """Square matrices over common labels plus the label mapping; rows are streamed in order."""
    omx = _need()
    labels = check_collection(tables)
    n = len(labels)
    with omx.open_file(path, "w", title=title) as f:
        f.create_mapping(mapping_name, labels)
        for name, m in tables.items():
            zones = zone_ordinals(zone_list(m))
            o, d = (zones.select(F.col("zone").alias(c), F.col("ordinal").alias(f"__{c}")) for c in "od")
            array = f.create_matrix(name, shape=(n, n), atom=None, title=(descriptions or {}).get(name, ""), attrs=(attrs or {}).get(name), obj=np.zeros((n, n)))
            for r in m.join(o, "o").join(d, "d").groupBy("__o").agg(F.collect_list(F.struct("__d", value)).alias("cells")).orderBy("__o").toLocalIterator():
                row = np.zeros(n)
                for j, v in r["cells"]:
                    row[j] = v or 0
                array[r["__o"], :] = row
