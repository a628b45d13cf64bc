"""Line deduplication against levelled sorted runs of line hashes; DataFrame operations only.

A run is a table of (h1, h2, owner), bucketed and sorted by the hashes, of the keys that were new in one batch
or, after compaction, in several. Runs never share a key. A batch meets every run in a merge anti-join in which
only the batch moves; what remains becomes a run of level 0, and `fan_in` runs of a level are merged into one of
the next, so a history of n batches has about log(n) runs to read.

Contract: a line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased. A key of at least
`min_chars` code points keeps its lines only in the first document that holds it, batches being in the order of
ids and the least id winning in a batch. A null id counts as the largest. Null and empty texts are one empty
line. Repeated rows (same id and text) are treated alike; rows of one id with different texts are one document.
Further columns pass through, but for those that the result names itself; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.llm.common import materialize, unwrapped, wrapped
from odweave.session import remove, shared_dir

BLANKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = 2**63 - 1


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The runs of one history of batches: bucketed tables whose files are in the shared folder."""

    def __init__(self, spark: SparkSession, *, buckets: int | None = None, fan_in: int = 3):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in reversed(self.levels) for t in level]

    def _write(self, df: DataFrame) -> str:
        name, by = f"{self.name}_{len(self.paths)}", ("h1", "h2")
        self.paths[name] = shared_dir(self.spark)
        df.repartition(self.buckets, *by).write.bucketBy(self.buckets, *by).sortBy(*by).option("path", self.paths[name]).saveAsTable(name)
        return name

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.paths[name])

    def add(self, keys: DataFrame) -> DataFrame:
        """Takes a batch's (h1, h2, doc, last): the least and largest id by key. Returns the keys that drop lines.

        The result has owner: null if an older batch holds the key (all its lines go), else the least id.
        """
        fresh = keys
        for run in self.runs():
            fresh = fresh.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        table = self._write(fresh.select("h1", "h2", F.col("doc").alias("owner")))
        self.levels[0].append(table)
        return keys.join(self.spark.table(table), ["h1", "h2"], "left").where("owner is null or last > owner").select("h1", "h2", "owner")

    def compact(self) -> None:
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= self.fan_in:
                merged = self._write(reduce(lambda a, b: a.unionByName(b), [self.spark.table(t) for t in self.levels[i]]))
                for t in self.levels[i]:
                    self._forget(t)
                self.levels[i] = []
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(merged)

    def drop(self) -> None:
        for name in self.paths:
            self._forget(name)
        self.levels = [[]]


def dedup_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", min_chars: int = 10, batches: int = 4, fan_in: int = 3) -> DataFrame:
    """All columns of docs plus kept_text, n_lines and n_dropped."""
    spark = docs.sparkSession
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    doc, version = F.coalesce(F.col(id).cast("long"), F.lit(LAST)), F.xxhash64(text)
    cuts = [i / batches for i in range(1, batches)]
    bounds = sorted({int(x) for x in docs.agg(F.percentile_approx(doc, cuts, 1000).alias("b")).first()["b"] or []}) if cuts else []
    batch = reduce(lambda a, b: a + b, [(doc > F.lit(x)).cast("int") for x in bounds], F.lit(0))
    split = docs.select(doc.alias("doc"), version.alias("version"), batch.alias("batch"), F.posexplode(_lines(F.col(text))).alias("pos", "line"))
    keyed = split.select("doc", "version", "batch", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    base = shared_dir(spark)
    keyed.select("doc", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "batch").write.partitionBy("batch").parquet(f"{base}/lines")
    lines = spark.read.schema("doc long, version long, pos int, h1 long, h2 long, batch int").parquet(f"{base}/lines")
    runs = LineRuns(spark, fan_in=fan_in)
    try:
        for i in range(len(bounds) + 1):
            own = lines.where(F.col("batch") == i)
            drops = runs.add(own.groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.max("doc").alias("last")))
            drops = materialize(drops)  # a plain table to join with, so that a line of very many documents can be split
            dropped = own.join(drops, ["h1", "h2"]).where("owner is null or doc > owner")
            dropped.select("doc", "version", "pos").write.mode("append").parquet(f"{base}/gone")
            runs.compact()
    finally:
        runs.drop()
    gone = spark.read.schema("doc long, version long, pos int").parquet(f"{base}/gone")
    gone = gone.groupBy(F.col("doc").alias("__doc"), F.col("version").alias("__version")).agg(F.sort_array(F.collect_set("pos")).alias("__gone"))
    body = F.col("row").getField(text)
    joined = wrapped(docs, doc=doc, version=version).join(gone, (F.col("doc") == F.col("__doc")) & (F.col("version") == F.col("__version")), "left")
    # the array of lines is bound once; array_except keeps the order and takes linear time
    places = lambda a: F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("__gone"))
    rebuilt = F.transform(F.array(_lines(body)), lambda a: F.concat_ws("\n", F.transform(places(a), lambda i: F.get(a, i))))[0]
    whole = F.coalesce(body, F.lit(""))
    n = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    out = joined.select(
        "row", F.when(F.col("__gone").isNull(), whole).otherwise(rebuilt).alias("kept_text"),
        n.cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return out.select(*unwrapped(docs), "kept_text", "n_lines", "n_dropped")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (SELECT doc_id, UNNEST(string_split(COALESCE(text, ''), chr(10))) AS line, generate_subscripts(string_split(COALESCE(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, MIN(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING MIN(doc_id) < MAX(doc_id)),
m AS (SELECT k.doc_id, pos, line, owner IS NOT NULL AND k.doc_id <> owner AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, COUNT(*) AS n_lines, CAST(SUM(CAST(gone AS BIGINT)) AS BIGINT) AS n_dropped, sha256(COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
