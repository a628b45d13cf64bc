"""Best transfer zones k for each pair (p, q) of a two-leg trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odweave.operators.zones import assert_unique
from odweave.session import reject_streaming

INF = float("inf")


def _usable(cost: Column, worst: float) -> Column:
    return cost.isNotNull() & ~F.isnan(cost) & (cost != F.lit(worst))


def _validate(pk: DataFrame, kq: DataFrame, check: bool) -> None:
    reject_streaming(pk, "best_intermediates")
    reject_streaming(kq, "best_intermediates")
    if check:
        assert_unique(pk, "p", "k")
        assert_unique(kq, "k", "q")
        a, b = pk.select("k").distinct(), kq.select("k").distinct()
        if a.join(b, "k", "left_anti").limit(1).count() or b.join(a, "k", "left_anti").limit(1).count():
            raise ValueError("the two legs have different intermediate zones")


def _combine(pk: DataFrame, kq: DataFrame, cost_col: str, mask: DataFrame | None, add_cost: DataFrame | None, maximize: bool, other_columns: bool, extra: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """All usable (p, k, q) with their cost. Masked pairs never fan out: the mask meets pk before kq does."""
    worst = -INF if maximize else INF
    both = (set(pk.columns) | set(kq.columns)) - {"p", "k", "q", cost_col, *extra}
    names = sorted(both) if other_columns else []
    a = pk.where(_usable(F.col(cost_col).cast("double"), worst)).select("p", "k", F.col(cost_col).alias("__a"), *[F.col(c) for c in extra], *[F.col(c).alias(f"__a_{c}") for c in names if c in pk.columns])
    b = kq.where(_usable(F.col(cost_col).cast("double"), worst)).select("k", "q", F.col(cost_col).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in names if c in kq.columns])
    if mask is None:
        paths = a.join(b, "k")
    else:
        paths = a.join(mask.select("p", "q").distinct(), "p").join(b, ["k", "q"])
    cost = F.col("__a") + F.col("__b")
    if add_cost is not None:
        paths = paths.join(add_cost.select("p", "k", "q", F.col("add_cost").alias("__add")), ["p", "k", "q"], "left")
        cost = cost + F.coalesce(F.col("__add"), F.lit(0))
    carried = []
    for c in names:
        parts = [F.col(f"__{leg}_{c}") for leg, t in (("a", pk), ("b", kq)) if c in t.columns]
        carried.append((parts[0] + parts[1] if len(parts) == 2 else parts[0]).alias(c))
    out = paths.select("p", "q", "k", cost.alias(cost_col), *extra, *carried)
    return out.where(_usable(F.col(cost_col).cast("double"), worst)), names


def _finish(ranked: DataFrame, pk: DataFrame, kq: DataFrame, mask: DataFrame | None, n: int, cost_col: str, names: list[str], maximize: bool, include_unavailable: bool, null_index: object, intermediate_name: str, availability_name: str) -> DataFrame:
    if not include_unavailable:
        return ranked.select("p", "q", "rank", F.col("k").alias(intermediate_name), F.lit(True).alias(availability_name), cost_col, *names)
    pairs = mask.select("p", "q").distinct() if mask is not None else pk.select("p").distinct().crossJoin(kq.select("q").distinct())
    slots = pairs.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(n))))
    out = slots.join(ranked, ["p", "q", "rank"], "left")
    missing = F.lit(-INF if maximize else INF)
    return out.select("p", "q", "rank", F.coalesce(F.col("k"), F.lit(null_index).cast(pk.schema["k"].dataType)).alias(intermediate_name), F.col("k").isNotNull().alias(availability_name), F.coalesce(F.col(cost_col), missing).alias(cost_col), *names)


def best_intermediates(pk: DataFrame, kq: DataFrame, cost_col: str = "cost", *, n: int = 1, add_cost: DataFrame | None = None, mask: DataFrame | None = None, maximize: bool = True, null_index: object = 0, other_columns: bool = True, include_unavailable: bool = True, intermediate_name: str = "k", availability_name: str = "available", check: bool = True) -> DataFrame:
    """The n best k per (p, q) by pk + kq (+ add_cost on p, k, q), rank 1 the best.

    Infinite (-inf when maximising, +inf when minimising), NaN and null costs are unavailable. Ties go to the
    larger k label. Columns of one leg are carried, columns of both are summed, and unavailable slots have null
    there. `mask` (p, q) restricts the pairs. The returned cost keeps its sign when minimising.
    """
    _validate(pk, kq, check)
    n = max(1, n)
    paths, names = _combine(pk, kq, cost_col, mask, add_cost, maximize, other_columns)
    by = F.col(cost_col).desc() if maximize else F.col(cost_col).asc()
    ranked = paths.withColumn("rank", F.row_number().over(Window.partitionBy("p", "q").orderBy(by, F.col("k").desc()))).where(F.col("rank") <= n)
    return _finish(ranked, pk, kq, mask, n, cost_col, names, maximize, include_unavailable, null_index, intermediate_name, availability_name)


def best_subset_intermediates(pk_subset: DataFrame, pk: DataFrame, kq: DataFrame, cost_col: str = "cost", *, n_subset: int = 1, n_final: int = 1, add_cost: DataFrame | None = None, mask: DataFrame | None = None, maximize_subset: bool = True, maximize_final: bool = True, null_index: object = 0, other_columns: bool = True, include_unavailable: bool = True, intermediate_name: str = "k", availability_name: str = "available", check: bool = True) -> DataFrame:
    """Two stages: the n_subset best k by (p, k, subset_cost) alone, then the n_final best of those by full cost.

    A subset cost counts only if positive when minimising, or negative when maximising; kq must be available.
    Final ties go to the better subset rank.
    """
    if n_subset < n_final:
        raise ValueError("n_subset must not be less than n_final")
    _validate(pk, kq, check)
    worst = -INF if maximize_final else INF
    sub = pk_subset.select("p", "k", F.col("subset_cost").alias("__sub")).where((F.col("__sub") < 0 if maximize_subset else F.col("__sub") > 0) & ~F.isnan(F.col("__sub").cast("double")))
    legs = kq.where(_usable(F.col(cost_col).cast("double"), worst)).select("k", "q")
    eligible = sub.join(legs, "k") if mask is None else sub.join(mask.select("p", "q").distinct(), "p").join(legs, ["k", "q"])
    order = F.col("__sub").desc() if maximize_subset else F.col("__sub").asc()
    chosen = eligible.withColumn("__rank", F.row_number().over(Window.partitionBy("p", "q").orderBy(order, F.col("k").desc()))).where(F.col("__rank") <= n_subset).select("p", "k", "q", "__rank")
    paths, names = _combine(pk, kq, cost_col, mask, add_cost, maximize_final, other_columns)
    by = F.col(cost_col).desc() if maximize_final else F.col(cost_col).asc()
    ranked = paths.join(chosen, ["p", "k", "q"]).withColumn("rank", F.row_number().over(Window.partitionBy("p", "q").orderBy(by, F.col("__rank").asc()))).where(F.col("rank") <= n_final).drop("__rank")
    return _finish(ranked, pk, kq, mask, n_final, cost_col, names, maximize_final, include_unavailable, null_index, intermediate_name, availability_name)
