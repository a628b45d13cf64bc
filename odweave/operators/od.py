"""Aggregation, disaggregation, splitting and reshaping of tall (o, d, value) matrices."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odweave.operators.zones import assert_known, densify

Agg = str | Callable[[Column], Column]


def _agg(how: Agg, column: str) -> Column:
    return how(F.col(column)) if callable(how) else getattr(F, how)(F.col(column))


def aggregate_matrix(matrix: DataFrame, *, groups: DataFrame | None = None, row_groups: DataFrame | None = None, col_groups: DataFrame | None = None, aggfunc: Agg = "sum", wide: bool = False, check: bool = False, ordered: bool = False, origin: str = "o", dest: str = "d", value: str = "value") -> DataFrame:
    """Aggregates cells to groups given as (zone, group) tables.

    Rows whose zone has no group or a null group drop out. `wide=True` applies `aggfunc` in two passes, rows
    first, which differs from one pass for mean, median, std, count and the like. `aggfunc` is the name of a
    pyspark aggregate or a function from Column to Column. `ordered` sorts the result by its groups.
    """
    row_groups = groups if row_groups is None else row_groups
    col_groups = groups if col_groups is None else col_groups
    if row_groups is None or col_groups is None:
        raise ValueError("groups, or both of row_groups and col_groups, are needed")
    if check:
        assert_known(matrix, origin, row_groups)
        assert_known(matrix, dest, col_groups)
    rows = row_groups.where("group is not null").select(F.col("zone").alias(origin), F.col("group").alias("row_group"))
    cols = col_groups.where("group is not null").select(F.col("zone").alias(dest), F.col("group").alias("col_group"))
    if not wide:
        out = matrix.join(rows, origin).join(cols, dest).groupBy("row_group", "col_group").agg(_agg(aggfunc, value).alias(value))
        return out.orderBy("row_group", "col_group") if ordered else out
    first = matrix.join(rows, origin).groupBy("row_group", dest).agg(_agg(aggfunc, value).alias(value))
    out = first.join(cols, dest).groupBy("row_group", "col_group").agg(_agg(aggfunc, value).alias(value))
    return out.orderBy("row_group", "col_group") if ordered else out


def map_to_matrix(pairs: DataFrame, zones: DataFrame, *, fill: float = 0, grouper: Agg = "sum", out: DataFrame | None = None, operand: str = "+", check: bool = True, origin: str = "o", dest: str = "d", value: str = "value") -> DataFrame:
    """Groups (o, d) pairs and scatters them into a full square; with `out`, combines cell by cell."""
    if check:
        assert_known(pairs, origin, zones)
        assert_known(pairs, dest, zones)
    square = densify(pairs.groupBy(origin, dest).agg(_agg(grouper, value).alias(value)), zones, origin=origin, dest=dest, value=value, fill=fill)
    if out is None:
        return square
    if operand not in ("+", "-", "*", "/"):
        raise ValueError(f"operand {operand!r} is not one of + - * /")
    left = F.coalesce(F.col("__out"), F.lit(fill))
    joined = square.join(out.select(origin, dest, F.col(value).alias("__out")), [origin, dest], "full")
    right = F.coalesce(F.col(value), F.lit(fill))
    result = {"+": left + right, "-": left - right, "*": left * right, "/": F.try_divide(left, right)}[operand]
    return joined.select(origin, dest, result.alias(value))


def indexers_for_map_matrix(labels: DataFrame, zones: DataFrame, *, column: str, check: bool = True) -> DataFrame:
    """Position of each label in the ordered superset `zones` (zone, ordinal)."""
    if check:
        assert_known(labels, column, zones)
    return labels.join(zones.select(F.col("zone").alias(column), "ordinal"), column, "left")


def normalise_proportions(correspondence: DataFrame) -> DataFrame:
    """(new, old, prop) with prop divided by its parent's sum; a zero parent gives null."""
    return correspondence.withColumn("prop", F.try_divide(F.col("prop"), F.sum("prop").over(Window.partitionBy("old"))))


def disaggregate_matrix(matrix: DataFrame, *, correspondence: DataFrame | None = None, rows: DataFrame | None = None, cols: DataFrame | None = None, normalise: bool = True, check: bool = True, origin: str = "o", dest: str = "d", value: str = "value") -> DataFrame:
    """Expands zones by (new, old, prop) tables, on both axes or on each its own.

    Parents that the tables name but the matrix lacks raise; parents that the tables lack drop out with
    their cells, so totals are kept only if every parent is mapped.
    """
    rows = correspondence if rows is None else rows
    cols = correspondence if cols is None else cols
    if rows is None or cols is None:
        raise ValueError("correspondence, or both of rows and cols, are needed")
    if check:
        assert_known(rows, "old", matrix.select(F.col(origin).alias("zone")).distinct())
        assert_known(cols, "old", matrix.select(F.col(dest).alias("zone")).distinct())
    if normalise:
        rows, cols = normalise_proportions(rows), normalise_proportions(cols)
    r = rows.select(F.col("old").alias(origin), F.col("new").alias("__o"), F.col("prop").alias("__po"))
    c = cols.select(F.col("old").alias(dest), F.col("new").alias("__d"), F.col("prop").alias("__pd"))
    return matrix.join(r, origin).join(c, dest).select(F.col("__o").alias(origin), F.col("__d").alias(dest), (F.col(value) * F.col("__po") * F.col("__pd")).alias(value))


def split_zone(matrix: DataFrame, old_zone: object, new_zones: Sequence[object], proportions: Sequence[float], *, ordered: bool = False, origin: str = "o", dest: str = "d", value: str = "value") -> DataFrame:
    """Replaces one zone by several; row, column and the intrazonal cell are prorated. The result is double.

    `ordered` sorts it by zones.
    """
    if len(new_zones) != len(proportions):
        raise ValueError("new_zones and proportions differ in length")
    if abs(sum(proportions) - 1) > 1e-8 + 1e-5:
        raise ValueError("proportions must sum to 1")
    parts = F.array(*[F.struct(F.lit(z).alias("zone"), F.lit(float(p)).alias("p")) for z, p in zip(new_zones, proportions, strict=True)])

    def expand(df: DataFrame, axis: str) -> DataFrame:
        alone = F.array(F.struct(F.col(axis).cast(df.schema[axis].dataType).alias("zone"), F.lit(1.0).alias("p")))
        out = df.withColumn("__s", F.explode(F.when(F.col(axis) == F.lit(old_zone), parts).otherwise(alone)))
        return out.withColumn(axis, F.col("__s.zone")).withColumn(value, F.col(value) * F.col("__s.p")).drop("__s")

    out = expand(expand(matrix.withColumn(value, F.col(value).cast("double")), origin), dest)
    return out.orderBy(origin, dest) if ordered else out


def stack(wide: DataFrame, *, origin: str = "o", dest: str = "d", value: str = "value", columns: Sequence[str] | None = None, drop_null: bool = False) -> DataFrame:
    """Wide to tall; nulls stay unless `drop_null`."""
    columns = [c for c in wide.columns if c != origin] if columns is None else list(columns)
    tall = wide.unpivot([origin], columns, dest, value)
    return tall.where(F.col(value).isNotNull()) if drop_null else tall


def unstack(matrix: DataFrame, columns: Sequence[object], *, origin: str = "o", dest: str = "d", value: str = "value") -> DataFrame:
    """Tall to wide with known column labels, which spares the job that would look for them."""
    return matrix.groupBy(origin).pivot(dest, list(columns)).agg(F.first(value))


def sum_frames(frames: Sequence[DataFrame], keys: Sequence[str], *, fill: float = 0) -> DataFrame:
    """Cellwise sum over frames whose rows and columns are unioned; a missing frame adds `fill`."""
    values = sorted({c for f in frames for c in f.columns} - set(keys))
    parts = [f.select(*keys, *[F.col(c) if c in f.columns else F.lit(None).cast("double").alias(c) for c in values]) for f in frames]
    total = reduce(lambda a, b: a.unionByName(b), parts)
    n = len(frames)
    if fill == 0:
        return total.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.sum(F.lit(0))).alias(c) for c in values])
    return total.groupBy(*keys).agg(*[(F.coalesce(F.sum(c), F.lit(0)) + (F.lit(n) - F.count(c)) * F.lit(fill)).alias(c) for c in values])


def totals(matrix: DataFrame, axis: str, *, value: str = "value") -> DataFrame:
    """Row totals for axis 'o', column totals for axis 'd', as (zone, total)."""
    return matrix.groupBy(F.col(axis).alias("zone")).agg(F.sum(value).alias("total"))
