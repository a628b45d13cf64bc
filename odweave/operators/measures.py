"""Distances, trip-length distributions and the numbers behind the standard plots."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mean radius of the earth in kilometres.
EARTH_RADIUS = 6371.0


def distance(x0: Column, y0: Column, x1: Column, y1: Column, method: str = "EUCLIDEAN", *, coord_unit: float = 1.0, earth_radius_factor: float = 1.0, pi: float = math.pi) -> Column:
    """EUCLIDEAN, MANHATTAN or HAVERSINE (x longitude, y latitude in degrees), times coord_unit."""
    method = method.upper()
    dx, dy = x1 - x0, y1 - y0
    if method == "EUCLIDEAN":
        return F.sqrt(dx * dx + dy * dy) * F.lit(coord_unit)
    if method == "MANHATTAN":
        return (F.abs(dx) + F.abs(dy)) * F.lit(coord_unit)
    if method == "HAVERSINE":
        rad = F.lit(pi / 180.0)
        sy, sx = F.sin(dy * rad / F.lit(2.0)), F.sin(dx * rad / F.lit(2.0))
        a = sy * sy + F.cos(y0 * rad) * F.cos(y1 * rad) * sx * sx
        return F.lit(EARTH_RADIUS * earth_radius_factor * 2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)) * F.lit(coord_unit)
    raise NotImplementedError(method)


def distance_matrix(zones: DataFrame, others: DataFrame | None = None, *, method: str = "EUCLIDEAN", **kwargs: float) -> DataFrame:
    """All pairs of (zone, x, y) points, tall; the product is the result's own size."""
    a = zones.select(F.col("zone").alias("o"), F.col("x").cast("double").alias("x0"), F.col("y").cast("double").alias("y0"))
    b = (zones if others is None else others).select(F.col("zone").alias("d"), F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"))
    return a.crossJoin(b).select("o", "d", distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), method, **kwargs).alias("value"))


def distance_array(df: DataFrame, x0: str, y0: str, x1: str, y1: str, *, method: str = "EUCLIDEAN", name: str = "distance", **kwargs: float) -> DataFrame:
    """Row-wise distance; runs on streams too."""
    return df.withColumn(name, distance(*(F.col(c).cast("double") for c in (x0, y0, x1, y1)), method, **kwargs))


def tlfd(df: DataFrame, value: str = "value", *, bin_start: float = 0, bin_end: float = 200, bin_step: float = 2, weights: str | None = None, intrazonal: Column | None = None, include_top: bool = False, top_exclusive: bool = False, label_type: str | None = None) -> DataFrame:
    """Trip-length distribution: (position, bin_type, bin_from, bin_to, label, value), empty bins included.

    `label_type` gives one kind of label instead: MULTI (position, from, to, value, as text), or (position, label, value) with
    TOP or BOTTOM, the bin's upper or lower edge, or TEXT, both.

    Bins are [a, b), the last one [a, b]. With `intrazonal`, those rows leave the bins and form a first row
    whatever their length; `include_top` adds a last row with all values >= bin_end (> with top_exclusive).
    """
    n_bins = max(1, math.ceil((bin_end + bin_step - bin_start) / bin_step) - 1)
    edges = [bin_start + i * bin_step for i in range(n_bins + 1)]
    v = F.col(value)
    iz = F.coalesce(intrazonal, F.lit(False)) if intrazonal is not None else F.lit(False)
    w = F.col(weights) if weights else F.lit(1)
    inside = (v >= F.lit(edges[0])) & (v <= F.lit(edges[-1]))
    at = F.when(inside, F.least(F.floor((v - F.lit(bin_start)) / F.lit(bin_step)).cast("int"), F.lit(n_bins - 1)))
    over = (v > F.lit(bin_end)) if top_exclusive else (v >= F.lit(bin_end))
    rows = df.select(F.when(iz, F.lit(-1)).otherwise(at).alias("position"), w.alias("__w"), (over & ~iz).alias("__top"))
    spots = F.array_compact(F.array(F.col("position"), *([F.when(F.col("__top"), F.lit(n_bins))] if include_top else [])))
    hist = rows.select(F.explode(spots).alias("position"), "__w").groupBy("position").agg(F.sum("__w").alias("__v"))
    fmt = lambda e: str(int(e)) if float(e).is_integer() else str(float(e))
    labels = [(i, "bin", float(a), float(b), f"{fmt(a)} to {fmt(b)}") for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    if intrazonal is not None:
        labels.insert(0, (-1, "intrazonal", None, float(edges[0]), f"intrazonal to {fmt(edges[0])}"))
    if include_top:
        labels.append((n_bins, "top", float(edges[-1]), None, f"{fmt(edges[-1])} to inf"))
    bins = df.sparkSession.createDataFrame(labels, "position int, bin_type string, bin_from double, bin_to double, label string")
    out = bins.join(hist, "position", "left").select("position", "bin_type", "bin_from", "bin_to", "label", F.coalesce(F.col("__v"), F.lit(0)).alias("value"))
    if label_type is None:
        return out
    low, high = (F.split("label", " to ")[i] for i in (0, 1))
    kinds = {"MULTI": [low.alias("from"), high.alias("to")], "TOP": [high.alias("label")], "BOTTOM": [low.alias("label")], "TEXT": [F.col("label")]}
    if label_type.upper() not in kinds:
        raise NotImplementedError(label_type)
    return out.select("position", *kinds[label_type.upper()], "value")


def convergence_errors(targets: DataFrame, results: DataFrame, keep: Callable[[Column], Column], *, key: str = "zone", adjust_target: bool = True, percentage: bool = True) -> DataFrame:
    """Errors by column and zone: targets are scaled to the model's sum, errors are relative if asked."""
    names = [c for c in targets.columns if c != key]
    if sorted(names) != sorted(c for c in results.columns if c != key):
        raise ValueError("targets and results have different columns")
    both = targets.unpivot([key], names, "column", "target").join(results.unpivot([key], names, "column", "model"), [key, "column"]).where(keep(F.col("target")))
    w = Window.partitionBy("column")
    total = F.sum("target").over(w)
    factor = F.when(total > 0, F.try_divide(F.sum("model").over(w), total)).otherwise(F.lit(1.0)) if adjust_target else F.lit(1.0)
    scaled = both.withColumn("target", F.col("target") * factor)
    err = F.col("model") - F.col("target")
    return scaled.select(key, "column", "model", "target", (F.try_divide(err, F.col("target")) if percentage else err).alias("error"))


def convergence_summary(errors: DataFrame) -> DataFrame:
    """Box-plot numbers by column: sums, number of zones and quartiles of the error."""
    q = F.percentile("error", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return errors.groupBy("column").agg(F.sum("model").alias("model_sum"), F.sum("target").alias("target_sum"), F.count("*").alias("zones"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"))


def _band(c: Column, small: float, large: float) -> Column:
    return F.when(c >= large, "dodgerblue").when(c >= small, "skyblue").when(c <= -large, "tomato").when(c <= -small, "lightsalmon").otherwise("grey")


def location_summary(model: DataFrame, target: DataFrame, names: DataFrame) -> DataFrame:
    """Model against target by ensemble (id, name): scaled target, differences, colours and short labels."""
    m = names.join(model.select("id", F.col("value").alias("model")), "id", "left").join(target.select("id", F.col("value").alias("target")), "id", "left").na.fill(0, ["model", "target"])
    sums = m.agg(F.sum("model").alias("sm"), F.sum("target").alias("st"))
    n = F.count("*").over(Window.partitionBy())
    at = F.row_number().over(Window.orderBy("id"))
    scaled = m.crossJoin(F.broadcast(sums)).withColumn("target", F.col("target") * F.try_divide(F.col("sm"), F.col("st"))).drop("sm", "st")
    diff = scaled.withColumn("diff", F.col("model") - F.col("target")).withColumn("perc_diff", F.try_divide(F.col("diff"), F.col("target")))
    return diff.select("id", "name", F.when(at == n, 99).otherwise(at).alias("short_label"), "model", "target", "diff", "perc_diff", _band(F.col("diff"), 2000, 5000).alias("diff_colour"), _band(F.coalesce(F.col("perc_diff"), F.lit(0.0)), 0.10, 0.25).alias("perc_colour"))


def trumpet_points(counts: DataFrame, model: DataFrame, *, key: str = "id", categories: list[str] | None = None) -> DataFrame:
    """(key, count, model, error, perc_error [, categories]) for count locations."""
    joined = counts.join(model, key, "left")
    err = F.col("model") - F.col("count")
    return joined.select(key, *(categories or []), "count", "model", err.alias("error"), F.try_divide(err, F.col("count")).alias("perc_error"))


def trumpet_curve(counts: DataFrame) -> DataFrame:
    """The highway-agency error curve at x = 1, 11, ... below 1.05 times the largest count."""
    top = counts.agg(F.max("count").alias("top"))
    xs = top.select(F.explode(F.expr("sequence(0L, cast(greatest(ceil((top * 1.05 - 1) / 10) - 1, 0) as bigint))")).alias("i")).select((F.col("i") * 10 + 1).cast("double").alias("x"))
    y = (F.lit(-13.7722) + F.lit(555.1382) * F.pow("x", F.lit(-0.26025))) / 100.0
    return xs.select("x", y.alias("upper"), (-y).alias("lower"))
