"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.

Contract: ids may be null or repeated; rows are never united by their id. A null text is empty from the second stage
on. Documents without words link with nothing, so each stays until the mix, which takes any number of words of them.
Columns beyond those of documents don't pass. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.llm.common import materialize
from odweave.llm.jaccard_join import jaccard_components
from odweave.llm.line_dedup import dedup_lines
from odweave.llm.mixing import emit_copies, mix_sources
from odweave.llm.packing import default_tokenizer, pack_documents
from odweave.llm.quality import classify
from odweave.session import scratch, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Repeated rows stay repeated."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return classify(docs, labels, columns=COLUMNS).where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one has; a text may become empty."""
    out = dedup_lines(docs.select(*COLUMNS))
    n_chars = F.length("kept_text").cast("long").alias("n_chars")
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that of the least id (null last), then of the least text hash.

    Rows are told apart by a number of their own, written with them so that each read sees the same one.
    """
    rows = materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")))
    linked = jaccard_components(rows, id="__row").select(F.col("doc_id").alias("__row"), "component_id")
    named = rows.select("__row", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("h"), "__row").alias("place"))
    kept = linked.join(named, "__row").groupBy("component_id").agg(F.min("place")["__row"].alias("__row"))
    return rows.join(kept.select("__row"), "__row", "left_semi").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return emit_copies(mix_sources(docs.select(*COLUMNS)), COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, with its sequence and place there."""
    return pack_documents(docs, default_tokenizer())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: A trained classifier, set joins and a tokenizer are beyond SQL: tests/llm holds run()'s rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = shared_dir(spark)
        with scratch(spark):  # a stage's own tables go once its result is written
            docs = materialize(stage(spark, docs, sf_dir), path)
    return docs
