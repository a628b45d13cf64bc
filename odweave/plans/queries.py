"""The registered queries: each applies one operator to the shared tables, whole."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.functions import text
from odweave.operators import balance, intermediates, measures, network, od, zones
from odweave.plans import file_queries
from odweave.session import mounted_dir, table, written


def _qty() -> F.Column:
    return F.sum("l_quantity").cast("bigint")


def nation_flows(s: SparkSession, d: str) -> DataFrame:
    """(o, d, value): quantity from customer nation to supplier nation.

    Orders get their nation before they meet lineitem, whose rows so move once less.
    """
    li = table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    cust = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("o"))
    supp = table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("d"))
    return li.join(supp, "l_suppkey").join(orders.join(cust, "c_custkey"), "l_orderkey").groupBy("o", "d").agg(_qty().alias("value"))


def flows_once(s: SparkSession, d: str) -> DataFrame:
    """nation_flows, a row a pair of nations, written for queries that use it more than once."""
    return written(nation_flows(s, d))


def regions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select(F.col("n_nationkey").alias("zone"), F.col("n_regionkey").alias("group"))


def nations(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select(F.col("n_nationkey").alias("zone"))


def legs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """pk: customer nation x brand; kq: brand x supplier nation; cost and a second measure n."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    brands = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("k"))
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    cust = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("p"))
    supp = table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("q"))
    measured = [_qty().cast("double").alias("cost"), F.count("*").alias("n")]
    pk = li.drop("l_suppkey").join(brands, "l_partkey").join(orders, "l_orderkey").join(cust, "c_custkey").groupBy("p", "k").agg(*measured)
    kq = li.drop("l_orderkey").join(brands, "l_partkey").join(supp, "l_suppkey").groupBy("k", "q").agg(*measured)
    return pk, kq


def points(s: SparkSession, d: str) -> DataFrame:
    """A plane and a sphere position for each nation, from its key."""
    k = F.col("n_nationkey")
    return table(s, d, "nation").select(k.alias("zone"), ((k * 37) % 101).cast("double").alias("x"), ((k * 53) % 89).cast("double").alias("y"))


def correspondence(s: SparkSession, d: str) -> DataFrame:
    """(new, old, prop): suppliers within nations, by quantity."""
    li = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("new")).agg(F.sum("l_quantity").alias("prop"))
    return li.join(table(s, d, "supplier").select(F.col("s_suppkey").alias("new"), F.col("s_nationkey").alias("old")), "new").select("new", "old", "prop")


def best(s: SparkSession, d: str, **kw: object) -> DataFrame:
    pk, kq = legs(s, d)
    extra = {k: v(s, d) if callable(v) else v for k, v in kw.items()}
    out = intermediates.best_intermediates(pk, kq, n=3, include_unavailable=False, check=False, **extra)
    return out.select("p", "q", "k", "cost", "n", "rank")


def _mask(s: SparkSession, d: str) -> DataFrame:
    pk, kq = legs(s, d)
    return pk.select("p").distinct().where("p % 2 = 0").crossJoin(kq.select("q").distinct().where("q % 3 = 0"))


def _pair_cost(s: SparkSession, d: str) -> DataFrame:
    pk, kq = legs(s, d)
    return pk.select("p", "k").join(kq.select("k", "q"), "k").select("p", "k", "q", ((F.col("p") * 7 + F.col("q") * 11) % 13 * F.length("k")).cast("double").alias("add_cost"))


def best_intermediate_unavailable(s: SparkSession, d: str) -> DataFrame:
    pk, kq = legs(s, d)
    pk = pk.withColumn("cost", F.when(F.col("p") % 5 == 0, F.lit(float("-inf"))).otherwise(F.col("cost")))
    out = intermediates.best_intermediates(pk, kq, null_index="none", check=False)
    return out.select("p", "q", "k", "available", F.when(F.col("available"), F.col("cost")).alias("cost"), "n")


def best_intermediate_subset(s: SparkSession, d: str) -> DataFrame:
    pk, kq = legs(s, d)
    sub = pk.select("p", "k", F.col("n").cast("double").alias("subset_cost"))
    out = intermediates.best_subset_intermediates(sub, pk, kq, n_subset=5, n_final=2, maximize_subset=False, include_unavailable=False, check=False)
    return out.select("p", "q", "k", "cost", "n", "rank")


def od_aggregate_regions(s: SparkSession, d: str) -> DataFrame:
    return od.aggregate_matrix(nation_flows(s, d), groups=regions(s, d))


def od_aggregate_wide_mean(s: SparkSession, d: str) -> DataFrame:
    return od.aggregate_matrix(nation_flows(s, d), groups=regions(s, d), aggfunc="avg", wide=True).withColumn("value", F.round("value", 4))


def od_aggregate_wide_median(s: SparkSession, d: str) -> DataFrame:
    return od.aggregate_matrix(nation_flows(s, d), groups=regions(s, d), aggfunc=F.median, wide=True).withColumn("value", F.round("value", 4))


def od_aggregate_max(s: SparkSession, d: str) -> DataFrame:
    return od.aggregate_matrix(nation_flows(s, d), groups=regions(s, d), aggfunc="max")


def zones_and_regions(s: SparkSession, d: str) -> DataFrame:
    """Nations, and regions as zones from 100 on, which no flow between nations touches."""
    return nations(s, d).union(table(s, d, "region").select((F.col("r_regionkey") + 100).alias("zone")))


def od_map_to_square(s: SparkSession, d: str) -> DataFrame:
    return od.map_to_matrix(nation_flows(s, d), zones_and_regions(s, d), check=False)


def od_map_into_existing(s: SparkSession, d: str) -> DataFrame:
    """Twice the flows between nations, in a matrix with regions too, less the flows themselves."""
    flows = flows_once(s, d)
    base = flows.select("o", "d", (F.col("value") * 2).alias("value"))
    return od.map_to_matrix(flows, zones_and_regions(s, d), out=base, operand="-", check=False).withColumn("value", F.col("value").cast("bigint"))


def od_coerce_square(s: SparkSession, d: str) -> DataFrame:
    """Flows from nations to regions, as one square."""
    to = regions(s, d).select(F.col("zone").alias("d"), (F.col("group") + 100).alias("region"))
    oblong = flows_once(s, d).join(to, "d").groupBy("o", F.col("region").alias("d")).agg(F.sum("value").alias("value"))
    return zones.coerce_square(oblong).withColumn("value", F.col("value").cast("double"))


def expand_array(s: SparkSession, d: str) -> DataFrame:
    return zones.expand(nation_flows(s, d), 2, (25, 25)).withColumns({"o": F.col("o").cast("int"), "d": F.col("d").cast("int")})


def od_stack(s: SparkSession, d: str) -> DataFrame:
    wide = od.unstack(nation_flows(s, d), range(25))
    return od.stack(wide).withColumn("d", F.col("d").cast("int"))


def od_unstack(s: SparkSession, d: str) -> DataFrame:
    wide = od.unstack(nation_flows(s, d), range(25))
    return wide.select("o", *[F.col(f"`{i}`").alias(f"d{i}") for i in range(25)])


def od_totals(s: SparkSession, d: str) -> DataFrame:
    flows = flows_once(s, d)
    side = lambda a: od.totals(flows, a).withColumn("axis", F.lit(a))
    return side("o").unionByName(side("d"))


def disaggregate_nations(s: SparkSession, d: str) -> DataFrame:
    flows = od.aggregate_matrix(nation_flows(s, d), row_groups=regions(s, d), col_groups=nations(s, d).withColumn("group", F.col("zone")), aggfunc="sum").select(F.col("row_group").alias("o"), F.col("col_group").alias("d"), "value")
    by_region = regions(s, d).select(F.col("zone").alias("new"), F.col("group").alias("old"), (F.col("zone") + 1).cast("double").alias("prop"))
    return od.disaggregate_matrix(flows, rows=by_region, cols=correspondence(s, d), check=False).withColumn("value", F.round("value", 4))


def split_zone(s: SparkSession, d: str) -> DataFrame:
    return od.split_zone(nation_flows(s, d), 3, [100, 101, 102], [0.5, 0.25, 0.25]).withColumn("value", F.round("value", 4))


def balance_rows_1d(s: SparkSession, d: str) -> DataFrame:
    flows = flows_once(s, d)
    goal = od.totals(flows, "o").withColumn("total", F.col("total") * 2 + F.col("zone"))
    return balance.balance_1d(flows, goal, "o").withColumn("value", F.round("value", 4))


def balance_cols_1d(s: SparkSession, d: str) -> DataFrame:
    flows = flows_once(s, d)
    goal = od.totals(flows, "d").withColumn("total", F.col("total") * 3 + F.col("zone"))
    return balance.balance_1d(flows, goal, "d").withColumn("value", F.round("value", 4))


def balance_2d_k_iters(s: SparkSession, d: str) -> DataFrame:
    """Three passes of proportional fitting, a fixed number, for the comparison with SQL."""
    import warnings

    flows = written(od.map_to_matrix(nation_flows(s, d), nations(s, d), check=False))
    rows = od.totals(flows, "o").withColumn("total", (F.col("total") + 100 * F.col("zone")).cast("double"))
    cols = od.totals(flows, "d").withColumn("total", (F.col("total") + 100 * (24 - F.col("zone"))).cast("double"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        out = balance.balance_2d(flows, rows, cols, totals_to_use="average", max_iterations=3, rel_error=0.0)
    return out.matrix.withColumn("value", F.round("value", 3))


def balance_2d_converged(s: SparkSession, d: str) -> DataFrame:
    """Row sums after convergence, to whole units; they meet the totals."""
    flows = flows_once(s, d)
    rows = od.totals(flows, "o").withColumn("total", (F.col("total") * 2).cast("double"))
    cols = od.totals(flows, "d").withColumn("total", (F.col("total") * 2).cast("double"))
    out = balance.balance_2d(flows, rows, cols, rel_error=1e-7)
    return od.totals(out.matrix, "o").select("zone", F.round("total").cast("bigint").alias("total"))


def bucket_round_prices(s: SparkSession, d: str) -> DataFrame:
    ev = table(s, d, "events").select("user_id", "ts", F.round("value", 6).alias("value")).where("value is not null")
    return balance.bucket_round(ev, block="user_id", order=("ts",)).select("user_id", "ts", "value")


def bucket_round_hundreds(s: SparkSession, d: str) -> DataFrame:
    return balance.bucket_round(flows_once(s, d).withColumn("value", F.col("value").cast("double")), decimals=-2).select("o", "d", "value")


def _trips(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_quantity", F.col("l_extendedprice").cast("decimal(18,2)").alias("w"), (F.col("l_partkey") % 10 == 0).alias("iz"))


def _tlfd(s: SparkSession, d: str, **kw: object) -> DataFrame:
    out = measures.tlfd(_trips(s, d), "l_quantity", bin_start=0, bin_end=40, bin_step=4, **kw)
    kind = "decimal(38,2)" if "weights" in kw else "bigint"
    return out.select("position", "bin_type", "label", F.col("value").cast(kind).cast("double" if "weights" in kw else "bigint").alias("value"))


def tlfd_intrazonal(s: SparkSession, d: str) -> DataFrame:
    return _tlfd(s, d, intrazonal=F.col("iz"), include_top=True)


def _distance(s: SparkSession, d: str, method: str) -> DataFrame:
    return measures.distance_matrix(points(s, d), method=method).withColumn("value", F.round("value", 5))


def distance_rows(s: SparkSession, d: str) -> DataFrame:
    pts = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 97).alias("x0"), (F.col("o_orderkey") % 89).alias("y0"), (F.col("o_custkey") % 97).alias("x1"), (F.col("o_custkey") % 89).alias("y1"))
    return measures.distance_array(pts, "x0", "y0", "x1", "y1").select("o_orderkey", F.round("distance", 5).alias("distance"))


def lookup_reindex(s: SparkSession, d: str) -> DataFrame:
    cust = table(s, d, "customer").select("c_custkey", "c_nationkey")
    names = table(s, d, "nation").where("n_regionkey <> 1").select("n_nationkey", "n_name")
    return zones.reindex_lookup(cust, names, {"c_nationkey": "n_nationkey"}, "n_name")


def lookup_fill(s: SparkSession, d: str) -> DataFrame:
    cust = table(s, d, "customer").select("c_custkey", "c_nationkey")
    names = table(s, d, "nation").where("n_regionkey <> 1").select("n_nationkey", "n_name")
    return zones.reindex_lookup(cust, names, {"c_nationkey": "n_nationkey"}, "n_name", fill="elsewhere")


def zone_indexers(s: SparkSession, d: str) -> DataFrame:
    return od.indexers_for_map_matrix(flows_once(s, d).select("o").distinct(), zones.zone_ordinals(nations(s, d).where("zone >= 0")), column="o").select("o", "ordinal")


def sum_frames(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"), F.max("s_suppkey").alias("customers"))
    return od.sum_frames([a, b], ["k"]).select("k", F.col("customers").cast("bigint").alias("customers"), F.col("suppliers").cast("bigint").alias("suppliers"))


def natural_sort_rank(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    brands = table(s, d, "part").select("p_brand").distinct()
    return brands.select("p_brand", F.row_number().over(Window.orderBy(zones.natural_key("p_brand"))).alias("position"))


def category_codes(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "orders").select(F.col("o_orderpriority").alias("c"))
    b = table(s, d, "customer").select(F.col("c_mktsegment").alias("c"))
    return zones.category_codes([a, b], "c")[0]


def category_difference(s: SparkSession, d: str) -> DataFrame:
    """Brands that no line item of the greatest quantity has."""
    parts = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    li = table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    most = li.agg(F.max("l_quantity").alias("l_quantity"))
    return zones.category_difference(parts, parts.join(li.join(F.broadcast(most), "l_quantity"), "p_partkey"), "brand")


def align_categories(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("c"))
    b = table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("c"))
    coded = zones.align_categories([a, b])
    return reduce(lambda x, y: x.unionByName(y), [f.groupBy("c", "c_code").count() for f in coded])


def _line_ids(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(F.concat(F.element_at(F.array(F.lit("T"), F.lit("GT"), F.lit("B2"), F.lit("Y")), (k % 4 + 1).cast("int")), F.when(k % 7 == 0, F.lit("")).otherwise(F.lpad(k.cast("string"), 8, "0")), F.lit("a")).alias("line"))


def line_id_parse(s: SparkSession, d: str) -> DataFrame:
    return _line_ids(s, d).select("line", text.line_operator(F.col("line")).alias("operator"), text.line_route(F.col("line")).alias("route"))


def eng_notation(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.concat((k % 50).cast("string"), F.element_at(F.array(*map(F.lit, ["k", "m", "M", "."])), (k % 4 + 1).cast("int")), (k % 9).cast("string"))
    return table(s, d, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", "raw", F.round(text.eng_notation(F.col("raw")), 6).alias("amount"))


def _stops(s: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("click", "view", "purchase", "login", "signup", "logout", "search")])
    return table(s, d, "events").select(F.col("user_id").alias("line"), F.col("ts").alias("line_no"), F.coalesce(F.array_position(kinds, F.col("event_type")), F.lit(0)).cast("bigint").alias("inode"), F.coalesce(F.round("value", 0), F.lit(0)).cast("bigint").alias("v"))


def segment_next_node(s: SparkSession, d: str) -> DataFrame:
    return network.sequence_segments(_stops(s, d)).select("line", "line_no", "inode", "jnode", "seg_seq", "loop")


def segment_alightings(s: SparkSession, d: str) -> DataFrame:
    seg = network.sequence_segments(_stops(s, d))
    results = seg.where("jnode > 0").select("line", F.col("inode").alias("i"), F.col("jnode").alias("j"), "loop", F.col("v").cast("double").alias("transit_boardings"), (F.col("v") * 2).cast("double").alias("transit_volume"))
    return network.segment_results(seg.drop("line_no", "v"), results).select("line", "inode", "jnode", "seg_seq", "loop", "boardings", "alightings", "volume")


def result_summary(s: SparkSession, d: str) -> DataFrame:
    r = _line_ids(s, d).select("line", F.length("line").cast("double").alias("transit_boardings"), F.lit(2.0).alias("transit_volume"))
    return network.result_summary(r, parse_line_id=True)


def station_on_off(s: SparkSession, d: str) -> DataFrame:
    flows = flows_once(s, d).select(F.col("o").alias("i"), F.col("d").alias("j"), F.col("value").cast("double").alias("v"))
    return network.station_results(flows, [2, 5, 7, 11, 40])


def semi_join_countpost(s: SparkSession, d: str) -> DataFrame:
    flows = flows_once(s, d).select(F.col("o").alias("inode"), F.col("d").alias("jnode"), "value")
    links = flows.select("inode", "jnode", ((F.col("inode") * 5 + F.col("jnode")) % 4 - 1).alias("@post"))
    return network.at_countposts(flows, links, "post")


def _model_target(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    flows = flows_once(s, d)
    return od.totals(flows, "o"), od.totals(flows, "d")


def relative_error_summary(s: SparkSession, d: str) -> DataFrame:
    m, t = _model_target(s, d)
    names = table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    out = measures.location_summary(m.select(F.col("zone").alias("id"), F.col("total").alias("value")), t.select(F.col("zone").alias("id"), F.col("total").alias("value")), names)
    return out.select("id", "name", F.col("short_label").cast("int").alias("short_label"), F.col("model").cast("bigint").alias("model"), F.round("target", 4).alias("target"), F.round("diff", 4).alias("diff"), F.round("perc_diff", 5).alias("perc_diff"), "diff_colour", "perc_colour")


def convergence_errors(s: SparkSession, d: str) -> DataFrame:
    m, t = _model_target(s, d)
    targets = t.select("zone", F.col("total").cast("double").alias("jobs"))
    results = m.select("zone", F.col("total").cast("double").alias("jobs"))
    out = measures.convergence_errors(targets, results, lambda c: c > 1000)
    return out.select("zone", F.col("column").alias("col"), F.round("target", 4).alias("target"), F.round("error", 5).alias("error"))


def convergence_summary(s: SparkSession, d: str) -> DataFrame:
    m, t = _model_target(s, d)
    targets = t.select("zone", F.col("total").cast("double").alias("jobs"))
    results = m.select("zone", F.col("total").cast("double").alias("jobs"))
    out = measures.convergence_summary(measures.convergence_errors(targets, results, lambda c: c > 1000, percentage=False, adjust_target=False))
    return out.select(F.col("column").alias("col"), *[F.round(c, 4).alias(c) for c in ("model_sum", "target_sum")], "zones", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")])


def trumpet_categories(s: SparkSession, d: str) -> DataFrame:
    """Points that carry their region's name as category."""
    m, t = _model_target(s, d)
    names = table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("r_regionkey")).join(table(s, d, "region").select("r_regionkey", "r_name"), "r_regionkey")
    counts = t.select(F.col("zone").alias("id"), F.col("total").alias("count")).join(names.drop("r_regionkey"), "id")
    out = measures.trumpet_points(counts, m.select(F.col("zone").alias("id"), F.col("total").alias("model")), categories=["r_name"])
    return out.select("id", "r_name", F.col("count").alias("cnt"), "model", "error", F.round("perc_error", 5).alias("perc_error"))


def trumpet_points(s: SparkSession, d: str) -> DataFrame:
    m, t = _model_target(s, d)
    out = measures.trumpet_points(t.select(F.col("zone").alias("id"), F.col("total").alias("count")), m.select(F.col("zone").alias("id"), F.col("total").alias("model")))
    return out.select("id", F.col("count").alias("cnt"), "model", "error", F.round("perc_error", 5).alias("perc_error"))


def trumpet_curve(s: SparkSession, d: str) -> DataFrame:
    counts = table(s, d, "customer").groupBy("c_nationkey").count()
    return measures.trumpet_curve(counts).select("x", F.round("upper", 6).alias("upper"), F.round("lower", 6).alias("lower"))


def matrix_file_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Writes the flows as mdf and reads them back; one row a format with cells and sum."""
    import os

    from odweave.sources import matrix_files as m

    flows, base = flows_once(s, d), mounted_dir(s)
    m.to_mdf(flows, os.path.join(base, "a.mdf"))
    m.to_emx(flows, os.path.join(base, "a.emx"), 25)
    m.to_fortran(flows, os.path.join(base, "a.bin"))
    parts = [("mdf", m.read_mdf(s, os.path.join(base, "a.mdf"))), ("emx", m.read_emx(s, os.path.join(base, "a.emx"))), ("fortran", m.read_fortran_square(s, os.path.join(base, "a.bin")))]
    return reduce(lambda a, b: a.union(b), [df.where("value <> 0").agg(F.lit(n).alias("kind"), F.count("*").alias("cells"), F.sum("value").cast("bigint").alias("total")) for n, df in parts])


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        best_intermediate_unavailable, best_intermediate_subset, od_aggregate_regions, od_aggregate_wide_mean, od_aggregate_wide_median, od_aggregate_max, od_map_to_square, od_map_into_existing, od_coerce_square, expand_array, od_stack, od_unstack,
        od_totals, disaggregate_nations, split_zone, balance_rows_1d, balance_cols_1d, balance_2d_k_iters, balance_2d_converged, bucket_round_prices, bucket_round_hundreds, tlfd_intrazonal, distance_rows, lookup_reindex, lookup_fill, zone_indexers,
        sum_frames, natural_sort_rank, category_codes, category_difference, align_categories, line_id_parse, eng_notation, segment_next_node, segment_alightings, result_summary, station_on_off, semi_join_countpost, relative_error_summary, convergence_errors, convergence_summary, trumpet_categories, trumpet_points, trumpet_curve, matrix_file_round_trip,
    ]
    out = {f.__name__: f for f in own}
    out |= {
        "best_intermediate": best,
        "best_intermediate_minimize": lambda s, d: best(s, d, maximize=False),
        "best_intermediate_masked": lambda s, d: best(s, d, mask=_mask),
        "best_intermediate_with_pair_cost": lambda s, d: best(s, d, add_cost=_pair_cost),
        "tlfd_quantity": _tlfd,
        "tlfd_weighted": lambda s, d: _tlfd(s, d, weights="w"),
        "tlfd_multi_labels": lambda s, d: measures.tlfd(_trips(s, d), "l_quantity", bin_start=0, bin_end=40, bin_step=4, label_type="MULTI").withColumn("value", F.col("value").cast("bigint")),
        "tlfd_top": lambda s, d: _tlfd(s, d, include_top=True),
        "distance_euclid": lambda s, d: _distance(s, d, "EUCLIDEAN"),
        "distance_manhattan": lambda s, d: _distance(s, d, "MANHATTAN"),
        "distance_haversine": lambda s, d: _distance(s, d, "HAVERSINE"),
    }
    return out | file_queries.QUERIES
