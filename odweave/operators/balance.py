"""One- and two-dimensional matrix balancing."""

from __future__ import annotations

import warnings
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odweave.session import reject_streaming, written

#: Added to a sum before it divides, so that a zero sum gives a finite factor.
EPS = 1.0e-7


def balance_1d(matrix: DataFrame, totals: DataFrame, axis: str = "o", *, value: str = "value") -> DataFrame:
    """Scales rows (axis 'o') or columns (axis 'd') to (zone, total); zones without a total become 0."""
    sums = matrix.groupBy(axis).agg(F.sum(value).alias("__sum"))
    factors = sums.join(totals.select(F.col("zone").alias(axis), F.col("total").alias("__total")), axis, "left").select(axis, F.coalesce(F.nanvl(F.col("__total").cast("double") / (F.col("__sum") + F.lit(EPS)), F.lit(0.0)), F.lit(0.0)).alias("__f"))
    return matrix.join(factors, axis).select("o", "d", (F.col(value) * F.col("__f")).alias(value))


class Balanced(NamedTuple):
    matrix: DataFrame
    error: float
    iterations: int


def balance_2d(matrix: DataFrame, row_totals: DataFrame, col_totals: DataFrame, *, totals_to_use: str = "raise", max_iterations: int = 1000, rel_error: float = 1e-4, value: str = "value") -> Balanced:
    """Iterative proportional fitting, row then column, over scaling vectors.

    The matrix stays unchanged; it and the totals are made once and kept in the shared folder. Only two vectors of zone
    length move, as tables: a pass is two joins and aggregations, each written there, and one number comes back, the
    error. `totals_to_use` says how unequal totals are reconciled: raise, rows, columns or average. At most
    `max_iterations` passes are made; without convergence a RuntimeWarning is given. An input that is balanced already
    comes back unchanged.
    """
    reject_streaming(matrix, "balance_2d")
    if totals_to_use not in ("raise", "rows", "columns", "average"):
        raise ValueError(totals_to_use)
    goal = lambda df: df.select("zone", F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("goal"))
    a, b = written(goal(row_totals)), written(goal(col_totals))
    sa, sb = (df.agg(F.coalesce(F.sum("goal"), F.lit(0.0))).first()[0] for df in (a, b))
    if abs(sa - sb) > 1e-8 + 1e-5 * abs(sb):
        if totals_to_use == "raise":
            raise ValueError(f"row totals ({sa}) and column totals ({sb}) differ")
        both = {"rows": sa, "columns": sb, "average": (sa + sb) / 2}[totals_to_use]
        a, b = a.withColumn("goal", F.col("goal") * F.lit(both / sa)), b.withColumn("goal", F.col("goal") * F.lit(both / sb))
    matrix = written(matrix.select("o", "d", F.col(value).cast("double").alias(value)))
    cells = matrix.select("o", "d", F.col(value).alias("m")).where("m is not null and not isnan(m)")
    for axis, totals in (("o", a), ("d", b)):
        if cells.select(F.col(axis).alias("zone")).distinct().join(totals, "zone", "left_anti").limit(1).count():
            raise KeyError("a zone of the matrix has no total")

    def met(x: DataFrame, across: str, to: str, own: DataFrame) -> DataFrame:
        """own (zone, goal, x) with the sum of cells times the other axis's x; zones without cells have 0."""
        sums = cells.join(x.select(F.col("zone").alias(across), F.col("x").alias("other")), across).groupBy(F.col(to).alias("zone")).agg(F.sum(F.col("m") * F.col("other")).alias("sum"))
        return own.select("zone", "goal", "x").join(sums, "zone", "left").select("zone", "goal", "x", F.coalesce("sum", F.lit(0.0)).alias("sum"))

    def moved(state: DataFrame) -> DataFrame:
        """The vector scaled so that its zones meet their goals."""
        return state.withColumn("x", F.col("x") * (F.col("goal") / (F.col("x") * F.col("sum") + F.lit(EPS))))

    def total_error(rows: DataFrame, cols: DataFrame) -> float:
        return rows.union(cols).agg(F.coalesce(F.sum(F.abs(F.col("goal") - F.col("x") * F.col("sum"))), F.lit(0.0))).first()[0]

    r, c = a.withColumn("x", F.lit(1.0)), b.withColumn("x", F.lit(1.0))
    r, c = written(met(c, "d", "o", r)), written(met(r, "o", "d", c))
    initial, err, i = total_error(r, c), 1.0, 0
    if initial <= 1e-12 * (sa + sb):  # only rounding is left
        return Balanced(matrix, 0.0, 0)
    while err > rel_error:
        if i >= max_iterations:
            warnings.warn(f"no convergence after {i} iterations: relative error {err:g}", RuntimeWarning, stacklevel=2)
            break
        r = moved(r)
        c = moved(written(met(r, "o", "d", c)))
        r = written(met(c, "d", "o", r))
        err, i = total_error(r, c) / initial, i + 1
    out = matrix.withColumnRenamed(value, "__m")
    for axis, x in (("o", r), ("d", c)):
        out = out.join(x.select(F.col("zone").alias(axis), F.col("x").alias(f"__{axis}")), axis)
    return Balanced(out.select("o", "d", (F.col("__m") * F.col("__o") * F.col("__d")).alias(value)), err if i else 1.0, i)


def bucket_round(df: DataFrame, *, decimals: int = 0, block: str = "o", order: tuple[str, ...] = ("d",), value: str = "value", scale: int = 9, ranges: int = 64) -> DataFrame:
    """Rounds a sequence so that running totals stay within half a unit of the exact ones.

    The sequence runs by `block`, then by `order`. Running sums are exact decimals: a window inside each block plus
    what lies before the block. That prefix is found in two levels, so that no task sees all blocks: blocks are dealt
    to `ranges` ranges by approximate quantiles, a window in each range adds up its blocks, and only the ranges' own
    totals, `ranges` rows at most, are added up in one task. decimals <= 0 gives int.
    """
    reject_streaming(df, "bucket_round")
    kind = f"decimal(38,{scale})"
    zero = F.lit(0).cast(kind)
    exact = df.withColumn("__x", F.col(value).cast(kind))
    within = Window.partitionBy(block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = _prefixes(exact.groupBy(block).agg(F.coalesce(F.sum("__x").cast(kind), zero).alias("__t")), block, kind, ranges)
    summed = exact.withColumn("__w", F.sum(F.coalesce(F.col("__x"), zero)).over(within).cast(kind)).join(starts, F.col(block).eqNullSafe(F.col("__block"))).drop("__block")
    upto = (F.col("__s") + F.col("__w")).cast(kind)
    rounded = F.bround(upto, decimals) - F.bround((upto - F.coalesce(F.col("__x"), zero)).cast(kind), decimals)
    return summed.withColumn(value, rounded.cast("int") if decimals <= 0 else rounded.cast("double")).drop("__x", "__w", "__s")


def _prefixes(totals: DataFrame, block: str, kind: str, ranges: int) -> DataFrame:
    """(__block, __s): the sum of __t over all blocks before each, nulls first."""
    before = lambda w: F.coalesce(F.sum("__t").over(w.rowsBetween(Window.unboundedPreceding, -1)).cast(kind), F.lit(0).cast(kind))
    # written with their range's number, which so stays the same in both uses
    dealt = written(totals.repartitionByRange(ranges, block).select(F.col(block).alias("__block"), "__t", F.spark_partition_id().alias("__p")))
    by_range = dealt.groupBy("__p").agg(F.sum("__t").cast(kind).alias("__t")).select("__p", before(Window.orderBy("__p")).alias("__r"))
    inside = dealt.select("__block", "__p", before(Window.partitionBy("__p").orderBy("__block")).alias("__i"))
    return inside.join(by_range, "__p").select("__block", (F.col("__r") + F.col("__i")).cast(kind).alias("__s"))
