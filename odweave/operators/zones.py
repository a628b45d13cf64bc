"""Zone dictionaries, label checks, densification and natural ordering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zone_list(matrix: DataFrame, origin: str = "o", dest: str = "d") -> DataFrame:
    """Union of the origin and destination labels, one row per zone."""
    return matrix.select(F.col(origin).alias("zone")).union(matrix.select(F.col(dest).alias("zone"))).distinct().where("zone is not null")


def zone_ordinals(zones: DataFrame, zone: str = "zone") -> DataFrame:
    """Adds the 0-based position of each zone in label order.

    The window has one partition, but it holds only the zone dictionary, never cells.
    """
    return zones.select(F.col(zone).alias("zone")).distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("zone")) - 1)


def assert_known(df: DataFrame, column: str, zones: DataFrame, zone: str = "zone") -> None:
    """Raises when a label of `column` has no zone (an anti join that must come out empty)."""
    stray = df.select(F.col(column).alias("zone")).join(zones.select(F.col(zone).alias("zone")), "zone", "left_anti").where("zone is not null").limit(5).collect()
    if stray:
        raise KeyError(f"{column}: labels without a zone: {[r[0] for r in stray]}")


def assert_unique(df: DataFrame, *keys: str) -> None:
    if twice := df.groupBy(*keys).count().where("count > 1").limit(1).collect():
        raise ValueError(f"keys {keys} are not unique: {twice[0].asDict()}")


def densify(matrix: DataFrame, rows: DataFrame, cols: DataFrame | None = None, *, origin: str = "o", dest: str = "d", value: str = "value", fill: float | None = 0) -> DataFrame:
    """One row for each (row zone, column zone); missing or null cells get `fill`.

    The product of the two zone lists is the result's own size.
    """
    cols = rows if cols is None else cols
    grid = rows.select(F.col("zone").alias(origin)).crossJoin(cols.select(F.col("zone").alias(dest)))
    cell = F.col(value) if fill is None else F.coalesce(F.col(value), F.lit(fill).cast(matrix.schema[value].dataType))
    return grid.join(matrix.select(origin, dest, value), [origin, dest], "left").select(origin, dest, cell.alias(value))


def expand(matrix: DataFrame, n: int, shape: tuple[int, int], *, axis: int | None = None, origin: str = "o", dest: str = "d", value: str = "value") -> DataFrame:
    """Zero-pads a positional matrix (labels 0..) by n along one axis or both."""
    if n < 0:
        raise ValueError("n must not be negative")
    spark = matrix.sparkSession
    sizes = [shape[i] + (n if axis in (None, i) else 0) for i in (0, 1)]
    rows, cols = (spark.range(s).select(F.col("id").alias("zone")) for s in sizes)
    return densify(matrix.withColumns({origin: F.col(origin).cast("long"), dest: F.col(dest).cast("long")}), rows, cols, origin=origin, dest=dest, value=value)


def coerce_square(matrix: DataFrame, *, origin: str = "o", dest: str = "d", value: str = "value") -> DataFrame:
    """Square float32 form over the union of both label sets, missing cells 0."""
    return densify(matrix, zone_list(matrix, origin, dest), origin=origin, dest=dest, value=value).withColumn(value, F.col(value).cast("float"))


def natural_key(column: Column | str) -> Column:
    """Sort key under which 'x2' comes before 'x10': alternating text and number chunks."""
    c = F.col(column) if isinstance(column, str) else column
    texts = F.split(c, "[0-9]+")
    numbers = F.transform(F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("decimal(38,0)"))
    return F.arrays_zip(texts.alias("t"), numbers.alias("n"))


def sort_nicely(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(natural_key(column), column)


def reindex_lookup(target: DataFrame, source: DataFrame, on: dict[str, str], value: str, *, fill: object = None, check: bool = True) -> DataFrame:
    """Looks up `source.value` for each target row; `on` maps target columns to source keys."""
    if check:
        assert_unique(source, *on.values())
    keyed = source.select(*[F.col(s).alias(f"__{s}") for s in on.values()], F.col(value).alias("__value"))
    found = target.join(keyed, reduce(lambda a, b: a & b, [target[t] == F.col(f"__{s}") for t, s in on.items()]), "left")
    out = F.col("__value") if fill is None else F.coalesce(F.col("__value"), F.lit(fill))
    return found.select(*target.columns, out.alias(value))


def category_codes(frames: list[DataFrame], column: str) -> tuple[DataFrame, list[DataFrame]]:
    """One shared, label-sorted dictionary (category, code) and the frames with a `<column>_code`."""
    union = reduce(lambda a, b: a.union(b), [f.select(F.col(column).alias("category")) for f in frames]).distinct().where("category is not null")
    codes = union.withColumn("code", F.row_number().over(Window.orderBy("category")) - 1)
    return codes, [f.join(codes.withColumnsRenamed({"category": column, "code": f"{column}_code"}), column, "left") for f in frames]


def category_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Categories of a's column that b's lacks."""
    return a.select(column).where(F.col(column).isNotNull()).distinct().join(b.select(column), column, "left_anti")


def align_categories(items: list[DataFrame]) -> list[DataFrame]:
    """Adds, for every string column of frames of equal kind, codes over the categories of all."""
    names = {c for f in items for c, kind in f.dtypes if kind == "string"}
    for name in sorted(names):
        having = [i for i, f in enumerate(items) if name in f.columns]
        _, coded = category_codes([items[i] for i in having], name)
        for i, f in zip(having, coded, strict=True):
            items = [*items[:i], f, *items[i + 1 :]]
    return items


def is_identifier(name: str) -> bool:
    """Valid as a Python name and no keyword."""
    import keyword

    return isinstance(name, str) and name.isidentifier() and not keyword.iskeyword(name)
