"""Mixing sources to target weights.

Sizes are added up by source (partial sums before the shuffle). Weights are shared by water-filling under caps,
in closed form over the table of sources; each document is then taken floor(rate) times, and once more if a
uniform number from the hash of its id and the seed lies below the rate's fraction. That needs no order and no
state, so reruns and retried tasks agree.

Each source has its own seed, of SEEDS candidates: the words that every candidate would take are added up in one
aggregation, and the one nearest the target is used, the first if several
are. So also a source of few documents, or one with a document that holds a large part of its words, comes as near
its target as one of the candidates does.

Contract: a null source is one source, sorted last; null texts have size 0; a source of size 0 has rate 0.
Repeated rows draw alike. The result has the input's columns plus size, source_size, target, rate, seed and copies; columns
of the input with these names are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odweave.llm.common import materialize, unwrapped, wrapped

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Bits of the hash that make the uniform number, and candidate seeds a source.
BITS, SEEDS = 52, 64


def uniform(id: Column, salt: str, seed: Column) -> Column:
    """A number in [0, 1) from two stretches of the id's hash: first + seed * second, of BITS bits each."""
    digest = F.md5(F.concat(F.coalesce(id.cast("string"), F.lit("null")), F.lit(f":{salt}")).cast("binary"))
    first, second = (F.conv(F.substring(digest, 1 + i * BITS // 4, BITS // 4), 16, 10).cast("long") for i in (0, 1))
    return F.pmod(first + seed.cast("long") * second, F.lit(2**BITS)).cast("double") / F.lit(float(2**BITS))


def best_seeds(counted: DataFrame, targets: DataFrame, *, salt: str) -> DataFrame:
    """targets (source, source_size, target) with rate and the seed that comes nearest, over (id, of, size)."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = counted.join(targets.withColumn("rate", rate), F.col("of").eqNullSafe(F.col("source"))).withColumn("part", F.col("rate") - F.floor("rate"))
    more = [F.sum(F.when(uniform(F.col("id"), salt, F.lit(k)) < F.col("part"), F.col("size")).otherwise(F.lit(0))) for k in range(SEEDS)]
    summed = joined.groupBy("source", "source_size", "target", "rate").agg(F.array(*more).alias("more"))
    missed = F.transform("more", lambda x: F.abs((F.col("source_size") * F.floor("rate") + x).cast("double") - F.col("target")))
    return summed.select("source", "source_size", "target", "rate", (F.array_position(missed, F.array_min(missed)) - 1).cast("int").alias("seed"))


def source_targets(sizes: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): `share` of all sizes by weight, none above `cap` times its size.

    With sources in order of cap / weight, the level is the first that no later source's cap is below; the
    windows have one partition, of as many rows as there are sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    below = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    level = s.withColumn("level", (total - below) / rest)
    found = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "level"))).over(Window.partitionBy())
    return level.withColumn("found", found["level"]).select("source", "source_size", F.least("cap", F.coalesce(F.col("found") * F.col("w"), F.col("cap"))).alias("target"))


def mix_sources(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", salt: str = "mix", **shares: object) -> DataFrame:
    kept = docs.drop(*{"size", "source_size", "target", "rate", "seed", "copies"} - {id, text, source})
    sized = wrapped(kept, id=F.col(id), of=F.col(source), size=word_count(F.col(text)))
    counted = materialize(sized.select("id", "of", "size"))
    by_source = counted.groupBy(F.col("of").alias("source")).agg(F.sum("size").alias("source_size"))
    # tables of one row a source are written, so that their size is known: a small one is sent to the documents, else
    # a hot source is split
    targets = materialize(source_targets(by_source, **shares))
    seeds = materialize(best_seeds(counted, targets, salt=salt))
    joined = sized.join(seeds, F.col("of").eqNullSafe(F.col("source")))
    made = ("size", "source_size", "target", "rate", "seed", "copies")
    once_more = (uniform(F.col("id"), salt, F.col("seed")) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", F.floor("rate") + once_more).select("row", *made).select(*unwrapped(kept), *made)


def emit_copies(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixed.where("copies > 0")
    rows = wrapped(taken, copy=F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
 CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), 'null') || ':mix'), 1, 13) AS BIGINT) AS h, CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), 'null') || ':mix'), 14, 13) AS BIGINT) AS g FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, ([5.0, 2.0, 1.0])[(ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, CAST(source_size AS DOUBLE) * 2.0 AS cap FROM s),
l AS (SELECT *, cap / w AS ratio, (CAST(SUM(source_size) OVER () AS DOUBLE) * 1.5 - COALESCE(SUM(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / SUM(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, LEAST(cap, COALESCE((SELECT MIN(level) FROM l x WHERE x.level <= x.ratio AND x.ratio = (SELECT MIN(ratio) FROM l y WHERE y.level <= y.ratio)) * w, cap)) AS target FROM l),
r AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
c AS (SELECT r.source, target, k, SUM(size * (floor(rate) + CASE WHEN CAST((h + k * g) % {2**BITS} AS DOUBLE) / {2**BITS}.0 < rate - floor(rate) THEN 1 ELSE 0 END)) AS taken
 FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source CROSS JOIN range({SEEDS}) t(k) GROUP BY r.source, target, k),
b AS (SELECT source, k FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY source ORDER BY abs(CAST(taken AS DOUBLE) - target), k) = 1)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN CAST((h + k * g) % {2**BITS} AS DOUBLE) / {2**BITS}.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
