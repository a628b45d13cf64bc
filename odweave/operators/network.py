"""Derivations on transit and road networks: segments, results, stations, countposts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odweave.functions.text import line_operator, line_route


def sequence_segments(stops: DataFrame, *, line: str = "line", node: str = "inode", order: str = "line_no", by: Sequence[str] = ()) -> DataFrame:
    """Adds jnode (next node of the line, 0 at its end), seg_seq (1-based) and loop (nth repeat of the pair).

    `by` names columns, such as the package, within which line ids are unique; likewise below.
    """
    along = Window.partitionBy(*by, line).orderBy(order)
    out = stops.withColumns({"jnode": F.coalesce(F.lead(node).over(along), F.lit(0).cast(stops.schema[node].dataType)), "seg_seq": F.row_number().over(along)})
    return out.withColumn("loop", F.row_number().over(Window.partitionBy(*by, line, node, "jnode").orderBy("seg_seq")))


def _keyed(results: DataFrame, by: Sequence[str], *values: Column) -> DataFrame:
    return results.select(*by, "line", F.col("i").alias("inode"), F.col("j").alias("jnode"), "loop", *values)


def segment_results(segments: DataFrame, results: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Boardings, alightings and volume by segment; segments without a result get 0.

    results: line, i, j, loop, transit_boardings, transit_volume. alightings = previous volume + boardings - volume.
    """
    r = _keyed(results, by, F.bround("transit_boardings", 3).alias("boardings"), F.bround("transit_volume", 3).alias("volume"))
    joined = segments.join(r, [*by, "line", "inode", "jnode", "loop"], "left").na.fill(0, ["boardings", "volume"])
    previous = F.coalesce(F.lag("volume").over(Window.partitionBy(*by, "line").orderBy("seg_seq")), F.lit(0))
    alightings = F.bround(previous + F.col("boardings") - F.col("volume"), 3).alias("alightings")
    return joined.withColumn("alightings", alightings).select(*by, "line", "inode", "jnode", "seg_seq", "loop", "boardings", "alightings", "volume")


def missing_results(segments: DataFrame, results: DataFrame, *, by: Sequence[str] = ()) -> int:
    """How many segments have no result."""
    return segments.join(_keyed(results, by), [*by, "line", "inode", "jnode", "loop"], "left_anti").count()


def station_results(flows: DataFrame, nodes: Sequence[int] | DataFrame, *, value: str | None = None, by: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """on (sum by j) and off (sum by i) at station nodes, rounded to 3; stations without flow have null.

    With `by`, each of its values has all stations (the result's own size). `ordered` sorts by station.
    """
    if value is None:
        rest = [c for c in flows.columns if c not in ("i", "j", *by)]
        if len(rest) != 1:
            raise ValueError(f"exactly one value column is needed, found {rest}")
        value = rest[0]
    stations = nodes if isinstance(nodes, DataFrame) else flows.sparkSession.createDataFrame([(int(n),) for n in sorted(nodes)], "stn_node long")
    if by:
        stations = flows.select(*by).distinct().crossJoin(stations)
    keys = [*by, "stn_node"]
    side = lambda c, name: flows.groupBy(*by, F.col(c).alias("stn_node")).agg(F.bround(F.sum(value), 3).alias(name))
    out = stations.join(side("j", "on"), keys, "left").join(side("i", "off"), keys, "left")
    return out.orderBy(*keys) if ordered else out


def at_countposts(results: DataFrame, links: DataFrame, attribute: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Link results whose countpost attribute is above 0; '@' is put before the name if it lacks one."""
    name = attribute if attribute.startswith("@") else f"@{attribute}"
    posts = links.where(F.col(f"`{name}`").cast("double") > 0).select(*by, "inode", "jnode")
    return results.join(posts, [*by, "inode", "jnode"], "left_semi")


def result_summary(results: DataFrame, *, parse_line_id: bool = False, aggregate: bool = False, by: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """Boardings and volume: by (operator, route) if parsed, by line if asked, else one row per segment.

    `ordered` sorts a parsed summary by operator and route number.
    """
    sums = lambda *keys: results.groupBy(*by, *keys).agg(F.sum("transit_boardings").alias("boardings"), F.sum("transit_volume").alias("total_volume"))
    if parse_line_id:
        out = sums(line_operator(F.col("line")).alias("operator"), line_route(F.col("line")).alias("route"))
        return order_routes(out, *by, "operator") if ordered else out
    if aggregate:
        return sums("line")
    return results.select(*by, "line", F.col("transit_boardings").alias("boardings"), F.col("transit_volume").alias("total_volume"))


def order_routes(summary: DataFrame, *before: str) -> DataFrame:
    """Sorted by the columns `before` and then by route, padded with zeros to the longest one.

    The window has one partition of one row a route.
    """
    longest = F.max(F.length("route")).over(Window.partitionBy())
    padded = F.concat(F.repeat(F.lit("0"), longest - F.length("route")), F.col("route"))
    return summary.withColumn("__key", padded).orderBy(*before, "__key").drop("__key")
