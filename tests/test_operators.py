"""Goldens, invariants and edge cases of the matrix operators; Qnn names the quirk that a test settles."""

import math
import random
import warnings

import pytest
from pyspark.sql import functions as F

from odweave.functions import text
from odweave.operators import balance, intermediates, measures, network, od, zones

INF = float("inf")
ZONES = [10, 11, 12, 20, 21, 22, 30, 31, 32]


def tall(spark, rows, o, d, kind="int"):
    return spark.createDataFrame([(a, b, v) for a, row in zip(o, rows, strict=True) for b, v in zip(d, row, strict=True)], f"o int, d {'string' if isinstance(d[0], str) else 'int'}, value {kind}")


def cells(df):
    return {(r[0], r[1]): r[2] for r in df.collect()}


def test_aggregate_square_and_rectangular(spark):
    square = [[4, 9, 1, 1, 9, 0, 4, 4, 9], [10, 0, 0, 10, 2, 8, 0, 10, 9], [8, 9, 9, 6, 7, 7, 4, 1, 8], [9, 8, 1, 10, 6, 7, 2, 1, 2], [3, 3, 10, 5, 3, 9, 7, 9, 4], [1, 5, 1, 1, 7, 4, 2, 9, 0], [4, 3, 4, 1, 5, 9, 3, 7, 5], [2, 3, 7, 2, 2, 10, 2, 3, 5], [5, 10, 4, 9, 1, 5, 4, 4, 7]]
    groups = spark.createDataFrame([(z, z // 10) for z in ZONES], "zone int, group int")
    out = cells(od.aggregate_matrix(tall(spark, square, ZONES, ZONES), groups=groups, check=True))
    assert [[out[i, j] for j in (1, 2, 3)] for i in (1, 2, 3)] == [[50, 50, 49], [41, 52, 36], [42, 44, 40]]
    rect = [[1, 3, 2, 9], [5, 0, 4, 7], [10, 5, 4, 0], [6, 1, 8, 9], [10, 5, 0, 3], [4, 8, 8, 6], [1, 0, 4, 1], [2, 3, 4, 6], [3, 0, 0, 7]]
    names = ["A1", "A2", "B1", "B2"]
    letters = spark.createDataFrame([(n, n[0]) for n in names], "zone string, group string")
    out = cells(od.aggregate_matrix(tall(spark, rect, ZONES, names), row_groups=groups, col_groups=letters))
    assert [[out[i, j] for j in "AB"] for i in (1, 2, 3)] == [[24, 26], [34, 34], [9, 22]]


def test_wide_and_tall_differ_for_counts(spark):
    """Q18: the wide form aggregates twice."""
    m = tall(spark, [[1, 2], [3, 4]], [1, 2], [1, 2])
    g = spark.createDataFrame([(1, 9), (2, 9)], "zone int, group int")
    assert cells(od.aggregate_matrix(m, groups=g, aggfunc="count"))[9, 9] == 4
    assert cells(od.aggregate_matrix(m, groups=g, aggfunc="count", wide=True))[9, 9] == 2


def test_disaggregate_golden_and_missing_parent(spark):
    m = spark.createDataFrame([(a, b, v) for a, row in zip("ABC", [[10, 30, 20], [20, 10, 10], [30, 20, 20]], strict=True) for b, v in zip("ABC", row, strict=True)], "o string, d string, value int")
    corr = spark.createDataFrame([("A1", "A", 0.25), ("A2", "A", 0.75), ("B1", "B", 0.55), ("B2", "B", 0.45), ("C1", "C", 0.62), ("C2", "C", 0.38)], "new string, old string, prop double")
    out = cells(od.disaggregate_matrix(m, correspondence=corr))
    assert out["A1", "A1"] == pytest.approx(0.625) and out["C1", "A2"] == pytest.approx(13.95) and out["B2", "C1"] == pytest.approx(2.79)
    assert sum(out.values()) == pytest.approx(170)
    with pytest.raises(KeyError):  # Q16
        od.disaggregate_matrix(m, correspondence=corr.union(spark.createDataFrame([("Z1", "Z", 1.0)], corr.schema)))


def test_split_zone(spark):
    out = cells(od.split_zone(tall(spark, [[8, 4], [2, 6]], [1, 2], [1, 2]), 1, [11, 12], [0.25, 0.75]))
    assert out[11, 11] == 0.5 and out[11, 12] == 1.5 and out[12, 12] == 4.5 and out[2, 12] == 1.5 and out[2, 2] == 6
    with pytest.raises(ValueError):
        od.split_zone(tall(spark, [[1]], [1], [1]), 1, [2], [0.5])


def test_stack_unstack_sum_frames(spark):
    m = tall(spark, [[1, None], [3, 4]], [1, 2], [1, 2])
    back = od.stack(od.unstack(m, [1, 2])).withColumn("d", F.col("d").cast("int"))
    assert cells(back) == cells(m)
    a, b = spark.createDataFrame([(1, 2.0)], "k int, x double"), spark.createDataFrame([(1, 3.0), (2, 5.0)], "k int, y double")
    assert sorted(map(tuple, od.sum_frames([a, b], ["k"]).collect())) == [(1, 2.0, 3.0), (2, 0.0, 5.0)]
    assert sorted(map(tuple, od.sum_frames([a, b], ["k"], fill=1).collect())) == [(1, 3.0, 4.0), (2, 2.0, 6.0)]  # Q40


def test_balancing(spark):
    rnd = random.Random(3)
    m = tall(spark, [[rnd.random() * 1000 for _ in range(5)] for _ in range(5)], range(5), range(5), "double")
    rows = [sum(v for (o, _), v in cells(m).items() if o == z) for z in range(5)]
    cols = [sum(v for (_, d), v in cells(m).items() if d == z) for z in range(5)]
    vec = lambda x: spark.createDataFrame(list(enumerate(map(float, x))), "zone int, total double")
    out = cells(balance.balance_1d(m, vec(rows[::-1]), "o"))
    assert all(sum(out[o, d] for d in range(5)) == pytest.approx(rows[4 - o]) for o in range(5))
    a, b = rows[2:] + rows[:2], cols[2:] + cols[:2]
    res = balance.balance_2d(m, vec(a), vec(b), rel_error=1e-6)
    got = cells(res.matrix)
    assert res.error <= 1e-6 and all(sum(got[o, d] for d in range(5)) == pytest.approx(a[o], rel=1e-4) for o in range(5))
    same = balance.balance_2d(m, vec(rows), vec(cols))
    assert same.iterations <= 1  # Q12: balanced already
    with pytest.raises(ValueError):
        balance.balance_2d(m, vec(rows), vec([2 * c for c in cols]))
    for use, goal in (("rows", sum(rows)), ("columns", 2 * sum(cols)), ("average", (sum(rows) + 2 * sum(cols)) / 2)):
        res = balance.balance_2d(m, vec(a), vec([2 * x for x in b]), totals_to_use=use, rel_error=1e-6)
        assert sum(cells(res.matrix).values()) == pytest.approx(goal, rel=1e-4)
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        assert balance.balance_2d(m, vec(a), vec(b), max_iterations=1, rel_error=0).iterations == 1  # Q11
    assert any(issubclass(w.category, RuntimeWarning) for w in told)


@pytest.mark.parametrize("decimals", [-2, 0, 1, 3])
def test_bucket_rounding(spark, decimals):
    rnd = random.Random(decimals)
    m = tall(spark, [[round(rnd.random() * 1000, 6) for _ in range(6)] for _ in range(6)], range(6), range(6), "double")
    out = balance.bucket_round(m, decimals=decimals)
    assert dict(out.dtypes)["value"] == ("int" if decimals <= 0 else "double")  # Q14
    a, b, unit = cells(m), cells(out.select("o", "d", "value")), 10.0**-decimals
    assert abs(sum(a.values()) - sum(b.values())) <= unit / 2 + 1e-6
    assert all(abs(a[k] - b[k]) <= unit + 1e-6 for k in a)


@pytest.mark.parametrize("decimals", [-2, 0, 5])
def test_bucket_rounding_of_a_million_cells(spark, decimals):
    """Running sums of the rounded cells stay within half a unit of the exact ones, over all blocks."""
    import numpy as np
    import pandas as pd

    exact = np.random.default_rng(3).uniform(0, 1000, (1000, 1000)).round(6)
    o, d = np.divmod(np.arange(1_000_000), 1000)
    m = spark.createDataFrame(pd.DataFrame({"o": o, "d": d, "value": exact.ravel()}))
    out = balance.bucket_round(m, decimals=decimals).select("o", "d", "value").toPandas().sort_values(["o", "d"])["value"].to_numpy(float)
    micro = lambda x: np.rint(x * 1e6).astype(np.int64)  # noqa: E731  sums in whole millionths, as floats would round
    unit = 10 ** (6 - decimals)
    assert len(out) == 1_000_000 and 2 * np.abs(np.cumsum(micro(out)) - np.cumsum(micro(exact.ravel()))).max() <= unit
    assert np.abs(micro(out) - micro(exact.ravel())).max() <= unit


def test_balancing_of_a_larger_matrix(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    m, rows = rng.uniform(0, 1000, (60, 60)), rng.uniform(0, 1000, 60)
    cols = np.roll(rows, 2)
    vec = lambda x: spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "zone int, total double")
    res = balance.balance_2d(tall(spark, m.tolist(), range(60), range(60), "double"), vec(rows), vec(cols), rel_error=1e-6)
    got = np.zeros((60, 60))
    for (a, b), v in cells(res.matrix).items():
        got[a, b] = v
    assert np.allclose(got.sum(1), rows, rtol=1e-4, atol=0.01) and np.allclose(got.sum(0), cols, rtol=1e-4, atol=0.01) and res.error <= 1e-6


def test_balancing_makes_its_inputs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(df):
        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(count, df.schema)

    m = tall(spark, [[1.0, None, 5.0], [2.0, 7.0, 1.0]], [1, 2], [1, 2, 3], "double")
    rows, cols = spark.createDataFrame([(1, 8.0), (2, 8.0)], "zone int, total double"), spark.createDataFrame([(1, 4.0), (2, 6.0), (3, 6.0)], "zone int, total double")
    with pytest.warns(RuntimeWarning):
        got = cells(balance.balance_2d(counted(m), counted(rows), counted(cols), max_iterations=1, rel_error=0).matrix)
    assert len(got) == 6 and got[1, 2] is None and got[2, 2] == pytest.approx(6, rel=1e-3)
    assert seen.value == 6 + 2 + 3


def test_label_types(spark):
    df = spark.createDataFrame([(0.0,), (1.5,), (9.0,)], "value double")
    kind = lambda t: [tuple(r)[1:-1] for r in measures.tlfd(df, bin_end=4, bin_step=2, include_top=True, label_type=t).orderBy("position").collect()]
    assert kind("text") == [("0 to 2",), ("2 to 4",), ("4 to inf",)] and kind("TOP") == [("2",), ("4",), ("inf",)]
    assert kind("BOTTOM") == [("0",), ("2",), ("4",)] and kind("MULTI") == [("0", "2"), ("2", "4"), ("4", "inf")]
    with pytest.raises(NotImplementedError):
        measures.tlfd(df, label_type="x")


# The matrices, costs and expected results here and in the goldens of aggregation and disaggregation above
# are those that results must equal.
def legs(spark):
    util = [-0.1569, -0.4972, -0.4174, -0.1145, -0.1197, -0.0175, -0.3938, -0.9686]
    back = [-0.739, -INF, -INF, -0.3384, -0.9853, -0.1971, -INF, -0.896]
    dist = [5.093, 1.8829, 3.1976, 0.7403, 4.6856, 7.8176, 3.2228, 5.2814]
    ks = [100, 101, 102, 103]
    pk = spark.createDataFrame([(p, k, util[i], i, i) for i, (p, k) in enumerate((p, k) for p in (1, 2) for k in ks)], "p int, k int, util double, col1 int, col2 int")
    kq = spark.createDataFrame([(k, q, back[i], i, i) for i, (k, q) in enumerate((k, q) for k in ks for q in (1, 2))], "k int, q int, util double, col1 int, col3 int")
    sub = spark.createDataFrame([(p, k, dist[i]) for i, (p, k) in enumerate((p, k) for p in (1, 2) for k in ks)], "p int, k int, subset_cost double")
    return pk, kq, sub


def rows_of(df):
    return [(r["p"], r["q"], r["k"], r["available"], round(r["util"], 4), r["col1"], r["col2"], r["col3"]) for r in df.orderBy("p", "q", "rank").collect()]


def test_best_intermediates_goldens(spark):
    pk, kq, sub = legs(spark)
    assert rows_of(intermediates.best_intermediates(pk, kq, "util")) == [(1, 1, 100, True, -0.8959, 0, 0, 0), (1, 2, 102, True, -0.6145, 7, 2, 5), (2, 1, 100, True, -0.8587, 4, 4, 0), (2, 2, 101, True, -0.3559, 8, 5, 3)]
    out = intermediates.best_subset_intermediates(sub, pk, kq, "util", n_subset=2, maximize_subset=False)
    assert rows_of(out) == [(1, 1, 100, True, -0.8959, 0, 0, 0), (1, 2, 101, True, -0.8356, 4, 1, 3), (2, 1, 100, True, -0.8587, 4, 4, 0), (2, 2, 102, True, -0.5909, 11, 6, 5)]


def test_best_intermediates_edges(spark):
    pk = spark.createDataFrame([(1, 7, 1.0), (1, 8, 1.0), (2, 7, float("nan")), (2, 8, -INF)], "p int, k int, cost double")
    kq = spark.createDataFrame([(7, 5, 2.0), (8, 5, 2.0)], "k int, q int, cost double")
    out = {r["p"]: r for r in intermediates.best_intermediates(pk, kq, null_index=-1).collect()}
    assert out[1]["k"] == 8  # Q3: ties go to the larger label
    assert (out[2]["k"], out[2]["available"], out[2]["cost"]) == (-1, False, -INF)  # Q4, Q5
    low = intermediates.best_intermediates(pk.where("p = 1"), kq, maximize=False).first()
    assert low["cost"] == 3.0  # Q1: the cost keeps its sign
    add = spark.createDataFrame([(1, 8, 5, 10.0)], "p int, k int, q int, add_cost double")
    assert intermediates.best_intermediates(pk.where("p = 1"), kq, maximize=False, add_cost=add).first()["k"] == 7  # Q2
    with pytest.raises(ValueError):
        intermediates.best_intermediates(pk, kq.where("k = 7"))  # Q9
    with pytest.raises(ValueError):
        intermediates.best_subset_intermediates(pk.withColumnRenamed("cost", "subset_cost"), pk, kq, n_subset=1, n_final=2)


def test_tlfd_edges(spark):
    v = spark.createDataFrame([(0.0,), (1.9,), (2.0,), (6.0,), (7.0,), (-1.0,)], "value double")
    out = {r["position"]: (r["label"], r["value"]) for r in measures.tlfd(v, bin_end=6, bin_step=2, include_top=True).collect()}
    assert out == {0: ("0 to 2", 2), 1: ("2 to 4", 1), 2: ("4 to 6", 1), 3: ("6 to inf", 2)}  # Q19: 6 is in both
    out = {r["position"]: r["value"] for r in measures.tlfd(v, bin_end=6, bin_step=2, include_top=True, top_exclusive=True, intrazonal=F.col("value") < 0).collect()}
    assert out == {-1: 1, 0: 2, 1: 1, 2: 1, 3: 1}  # Q21
    assert measures.tlfd(v, bin_end=5, bin_step=2).count() == 3  # Q20: the last edge overshoots


def test_distances(spark):
    z = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0)], "zone int, x double, y double")
    assert cells(measures.distance_matrix(z, method="haversine"))[1, 2] == pytest.approx(111.19492664, abs=1e-6)
    assert cells(measures.distance_matrix(z, coord_unit=3.0))[1, 2] == 3.0
    with pytest.raises(NotImplementedError):
        measures.distance_matrix(z, method="other")


def test_zone_helpers(spark):
    names = spark.createDataFrame([(x,) for x in ("a10", "a2", "a1b", "A3", "")], "n string")
    assert [r[0] for r in zones.sort_nicely(names, "n").collect()] == ["", "A3", "a1b", "a2", "a10"]
    assert zones.is_identifier("abc") and not zones.is_identifier("for") and not zones.is_identifier("1a")
    m = spark.createDataFrame([(1, 2, 5.0)], "o int, d int, value double")
    assert cells(zones.coerce_square(m)) == {(1, 1): 0, (1, 2): 5, (2, 1): 0, (2, 2): 0}
    with pytest.raises(ValueError):
        zones.reindex_lookup(m, spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), {"o": "k"}, "v")


def test_text_functions(spark):
    df = spark.createDataFrame([("1k5",), ("12m",), ("-1k5",), ("1.5k",), ("7",), ("x",)], "s string")
    assert [r[0] for r in df.select(text.eng_notation(F.col("s"))).collect()] == [1500.0, 0.012, -1500.0, 1500.0, 7.0, None]  # Q33
    ids = spark.createDataFrame([("T501a",), ("GT12b",), ("B0007x",), ("YRa",)], "s string")
    assert [tuple(r) for r in ids.select(text.line_operator(F.col("s")), text.line_route(F.col("s"))).collect()] == [("T", "501"), ("GT", "12"), ("B", "7"), ("YR", "")]


def test_station_results_need_one_value(spark):
    with pytest.raises(ValueError):
        network.station_results(spark.createDataFrame([(1, 2, 3.0, 4.0)], "i int, j int, a double, b double"), [1])  # Q36


def test_streams_are_refused_or_run(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, 5.0, 2.5)], "o int, d int, value double, x double").write.parquet(src)
    stream = spark.readStream.schema("o int, d int, value double, x double").parquet(src)
    with pytest.raises(ValueError):
        balance.bucket_round(stream)
    from odweave.streaming.online import stream_histogram

    q = stream_histogram(stream, "x", bin_start=0, bin_end=4, bin_step=1).writeStream.outputMode("complete").format("memory").queryName("hist").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("hist").collect()] == [(2, 1)]
    assert math.isfinite(1.0)


def test_ordered_results(spark):
    from odweave.operators import network, od

    m = spark.createDataFrame([(o, d, 1.0) for o in (3, 1, 2) for d in (2, 3, 1)], "o long, d long, value double").repartition(3)
    split = [(r["o"], r["d"]) for r in od.split_zone(m, 2, [5, 4], [0.5, 0.5], ordered=True).collect()]
    assert split == sorted(split) and len(split) == 16
    groups = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c")], "zone long, group string")
    for wide in (False, True):
        got = [(r["row_group"], r["col_group"]) for r in od.aggregate_matrix(m, groups=groups, wide=wide, ordered=True).collect()]
        assert got == sorted(got) and len(got) == 9
    r = spark.createDataFrame([(x, 1.0, 1.0) for x in ("T100a", "T9a", "T010a", "TXa", "B2" + "1" * 40 + "a", "B3a")], "line string, transit_boardings double, transit_volume double")
    assert [x["route"] for x in network.result_summary(r, parse_line_id=True, ordered=True).collect()] == ["3", "2" + "1" * 40, "9", "10", "100", ""]
    flows = spark.createDataFrame([(1, 2, 3.0)], "i long, j long, v double")
    assert [x["stn_node"] for x in network.station_results(flows, [9, 2, 5], ordered=True).collect()] == [2, 5, 9]


def test_names_of_any_script(spark):
    from odweave.functions.text import identifier
    from odweave.operators import zones
    from pyspark.sql import functions as F

    names = ["abc", "1a", "for", "été", "名前", "a b", "_x9", "", "a-b", "ä́2"]
    got = {r["n"]: r["ok"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", identifier(F.col("n")).alias("ok")).collect()}
    assert got == {n: zones.is_identifier(n) for n in names}
