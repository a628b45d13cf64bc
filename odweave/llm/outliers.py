"""Quality rules: fixed limits, then robust multivariate outliers by language and source.

Each document becomes a vector of transformed statistics. For each (language, source), each language and all documents
the minimum covariance determinant estimate of location and scatter is sought: the CORE share of the group's documents
whose (regularised) covariance has the least determinant.

1. Starts come from a sample of each group, the SAMPLE rows of least hash: STARTS random small subsets are
   concentrated twice, the best of them until they settle, and the best two of these go on.
2. Both are concentrated over all documents of the group: distances under the present estimate, the CORE nearest
   documents, their mean and covariance, again, until no determinant falls by more than TOLERANCE. A step is two
   aggregations over the table of statistics, partial before the shuffle, so a source with a third of all documents
   costs its task a few numbers. The one of lesser determinant is the group's estimate.
3. Groups of any size are shrunk alike: a group of n documents counts n / (n + PRIOR), the estimate of its language
   (itself shrunk to that of all documents) the rest.

A document is rejected when its squared Mahalanobis distance passes a far chi-square quantile. Many statistics are
constant in clean text, so a scatter's eigenvalues, in units of FLOOR, are raised to 1 where they are less; determinants
are those of scatters so raised.

Contract: null texts have no words (and fail the base rule); null language or source is a group of its own.
Repeated rows count as rows. Extra columns don't pass. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odweave.llm.common import SEPARATOR, U64, Hasher, inside, materialize, mix, sequences, steps, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW, MIN_WORDS, MAX_REPEAT = 5, 10, 20
#: Documents that a group's language counts for beside its own.
PRIOR = 60
#: Share of a group that the estimate is made from, and what its covariance is multiplied by to be that of a normal
#: sample: CORE / P(chi-square with 9 degrees < the CORE quantile of chi-square with 7).
CORE, CONSISTENT = 0.5, 1.694
#: Rows of a group that starts are drawn from, starts, and steps over all documents at most.
SAMPLE, STARTS, MAX_STEPS = 400, 40, 30
#: Fall of a log-determinant below which a group has settled.
TOLERANCE = 0.01
#: Squared distance beyond which a document is an outlier: the 0.9999 quantile of chi-square with 7 degrees.
CUTOFF = 29.88
#: Least standard deviation of each statistic: many are constant in clean text. A rate is at most asinh(10) / 10 = 0.2998
#: (at half the words or lines 0.2312), so floors of rates are low enough for each to pass CUTOFF by itself.
FLOOR = np.array([0.9, 0.25, 0.03, 0.0415, 0.052, 0.045, 0.045])
NAMES = ["x_length", "x_word", "x_symbols", "x_lines", "x_repeats", "x_upper", "x_marks"]
_HASHER = Hasher(31)
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long, n_lines long"


def _by_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts by document, over whole texts."""
    n = len(offsets) - 1
    zero = np.zeros(n, np.int64)
    if not len(data):
        return dict(n_words=zero, word_chars=zero, n_symbols=zero, n_dup_lines=zero, n_repeat_words=zero, n_upper=zero, n_marks=zero, n_lines=zero + 1)
    starts, ends, first = words(data, offsets)
    sep = SEPARATOR[data]
    out = {"n_words": np.diff(first), "word_chars": _by_doc(~sep & ((data & 0xC0) != 0x80), offsets), "n_symbols": _by_doc(SYMBOLS[data], offsets)}
    out["n_upper"] = _by_doc((data >= 0x41) & (data <= 0x5A), offsets)
    out["n_marks"] = _by_doc((data < 0x80) & ~sep & ~(((data >= 0x30) & (data <= 0x39)) | ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)), offsets)
    prefix = _HASHER.prefix(data)
    # lines: between newlines and ends of documents
    newline = np.flatnonzero(data == 0x0A)
    stops = np.concatenate((newline, offsets[1:]))
    begin = np.sort(np.concatenate((newline + 1, offsets[:-1])))
    stop = np.sort(stops)
    doc = np.searchsorted(offsets, begin, "right") - 1
    # an empty document shares its start with the next one; the order by start and stop pairs them still
    out["n_lines"] = _by_doc(data == 0x0A, offsets) + 1
    worded = np.concatenate(([0], np.cumsum(~sep)))
    some = worded[stop] > worded[begin]
    h = _HASHER.spans(prefix, begin[some], stop[some])
    key = mix(h + doc[some].astype(U64) * U64(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    lines = np.bincount(doc[some], minlength=n)
    out["n_dup_lines"] = lines - np.bincount(doc[some][at], minlength=n)
    # words in windows that occur twice in their document
    h = _HASHER.spans(prefix, starts, ends)
    win, ok = sequences(h, WINDOW), inside(first, WINDOW, len(h))
    word_doc = np.repeat(np.arange(n), np.diff(first))
    at = np.flatnonzero(ok)
    key = mix(win[at] + word_doc[at].astype(U64) * U64(0xD1342543DE82EF95))
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(h) + 1, np.int64)
    found = at[order[twice]]
    np.add.at(edge, found, 1)
    np.add.at(edge, found + WINDOW, -1)
    out["n_repeat_words"] = np.diff(np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))[first]) if len(h) else zero
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = [x.split()[0] for x in STATS.split(", ")][3:]
    for batch in batches:
        parts = [text_statistics(data, offsets) for _, data, offsets in steps(batch["text"])]
        cols = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64)) for c in order]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], batch["source"], *cols], names=["doc_id", "lang", "source", *order])


def vectors(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistics: logarithms of sizes, and rates on a scale that spreads small ones."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rate = lambda c, per: F.asinh(F.col(c) / per * F.lit(10.0)) / F.lit(10.0)
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    made = [F.log1p("n_words"), F.log(chars / n), rate("n_symbols", n), rate("n_dup_lines", F.col("n_lines")), rate("n_repeat_words", n), rate("n_upper", chars), rate("n_marks", chars)]
    return stats.withColumns(dict(zip(NAMES, made, strict=True)))


def _moments() -> list[Column]:
    p = len(NAMES)
    return [F.count("*").cast("double").alias("m"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(NAMES)], *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]]


def regular(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance of a core as scatter of the whole, and its log-determinant, in units of FLOOR.

    In these units the scatter's eigenvalues are raised to 1, so it has a spread in every direction and a core that
    is narrower than the floors everywhere has the least determinant there is.
    """
    value, axes = np.linalg.eigh(CONSISTENT * cov / np.outer(FLOOR, FLOOR))
    value = np.maximum(value, 1.0)
    return (axes * value) @ axes.T * np.outer(FLOOR, FLOOR), float(np.log(value).sum())


def concentrate(x: np.ndarray, mean: np.ndarray, scatter: np.ndarray, core: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One step: (mean, covariance, log-determinant) of the core nearest to the estimate."""
    gap = x - mean
    d2 = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(scatter), gap)
    h = max(1, int(np.ceil(core * len(x))))
    near = x[np.argsort(d2, kind="stable")[:h]]
    cov = np.cov(near.T, bias=True) if h > 1 else np.zeros((x.shape[1],) * 2)
    return near.mean(0), cov, regular(cov)[1]


def best_starts(x: np.ndarray, *, core: float = CORE, starts: int = STARTS, keep: int = 2, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """The `keep` estimates (mean, covariance) of least determinant that concentration reaches within x."""
    rng, p = np.random.default_rng(seed), x.shape[1]
    middle, found = np.median(x, 0), []
    for k in range(starts):
        # the first start is the middle under the floors alone, the others are small subsets
        own = x[rng.choice(len(x), min(len(x), p + 1), replace=False)]
        mean, cov = (middle, np.zeros((p, p))) if k == 0 else (own.mean(0), np.cov(own.T, bias=True) if len(own) > 1 else np.zeros((p, p)))
        for _ in range(2):
            mean, cov, det = concentrate(x, mean, regular(cov)[0], core)
        found.append((det, k, mean, cov))
    settled = []
    for det, k, mean, cov in sorted(found, key=lambda f: f[:2])[: max(5, keep)]:
        for _ in range(100):
            mean, cov, now = concentrate(x, mean, regular(cov)[0], core)
            if now >= det - 1e-9:
                break
            det = now
        settled.append((det, k, mean, cov))
    return [(mean, cov) for _, _, mean, cov in sorted(settled, key=lambda f: f[:2])[:keep]]


ESTIMATE = "grp string, start int, mean array<double>, cov array<double>, precision array<double>, logdet double"


def _row(grp: str, start: int, mean: np.ndarray, cov: np.ndarray) -> tuple:
    scatter, logdet = regular(cov)
    return grp, start, mean.tolist(), cov.ravel().tolist(), np.linalg.inv(scatter).ravel().tolist(), logdet


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ESTIMATE.split(", ")])


def _first_estimates(core: float, starts: int):  # noqa: ANN202
    def first(frame: pd.DataFrame) -> pd.DataFrame:
        grp = frame["grp"].iloc[0]
        x = frame.sort_values(["__order", *NAMES])[NAMES].to_numpy()
        return _frame([_row(grp, k, mean, cov) for k, (mean, cov) in enumerate(best_starts(x, core=core, starts=starts))])

    return first


def _estimates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Estimates from moments."""
    p = len(NAMES)
    for f in frames:
        rows = []
        for r in f.to_dict("records"):
            mean = np.array([r[f"s{i}"] for i in range(p)]) / r["m"]
            cov = np.zeros((p, p))
            for i in range(p):
                for j in range(i, p):
                    cov[i, j] = cov[j, i] = r[f"s{i}_{j}"] / r["m"] - mean[i] * mean[j]
            rows.append(_row(r["grp"], r["start"], mean, cov))
        yield _frame(rows)


def _shrink(prior: float):  # noqa: ANN202
    """(lang, source) with the mean and precision of its estimate shrunk to its language's and that to all documents'."""

    def shrink(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(NAMES)
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                mean, cov = np.array(r["mean_all"]), np.array(r["cov_all"])
                for level, n in (("lang", r["in_lang"]), ("pair", r["n"])):
                    w = n / (n + prior)
                    mean = w * np.array(r[f"mean_{level}"]) + (1 - w) * mean
                    cov = w * np.array(r[f"cov_{level}"]) + (1 - w) * cov
                rows.append((r["grp"], mean.tolist(), np.linalg.inv(regular(cov.reshape(p, p))[0]).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["grp", "mean", "precision"])

    return shrink


def _distance() -> Column:
    """Squared Mahalanobis distance as one expression over columns."""
    p = len(NAMES)
    d = [F.col(c) - F.col("mean")[i] for i, c in enumerate(NAMES)]
    total = None
    for i in range(p):
        for j in range(i, p):
            t = d[i] * d[j] * F.col("precision")[i * p + j] * F.lit(1.0 if i == j else 2.0)
            total = t if total is None else total + t
    return total


def _steps(data: DataFrame, estimate: DataFrame, core: float, max_steps: int) -> DataFrame:
    """Concentrates estimates over all of data (grp, statistics); both are written tables."""
    for _ in range(max_steps):
        # tables of one row a group and start are written, so that their size is known and a hot group can be split otherwise
        near = data.join(estimate.select("grp", "start", "mean", "precision"), "grp").withColumn("d2", _distance()).drop("mean", "precision")
        limit = materialize(near.groupBy("grp", "start").agg(F.percentile_approx("d2", core, 10_000).alias("limit")))
        moments = near.join(limit, ["grp", "start"]).where("d2 <= limit").groupBy("grp", "start").agg(*_moments())
        now = materialize(moments.mapInPandas(_estimates, ESTIMATE))
        fell = now.join(estimate.select("grp", "start", F.col("logdet").alias("before")), ["grp", "start"]).agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
        # of a step that gains nothing the earlier estimate stays: limits are approximate quantiles
        better = now.join(estimate.select("grp", "start", *[F.col(c).alias(f"b_{c}") for c in ("mean", "cov", "precision", "logdet")]), ["grp", "start"])
        kept = [F.when(F.col("logdet") <= F.col("b_logdet"), F.col(c)).otherwise(F.col(f"b_{c}")).alias(c) for c in ("mean", "cov", "precision", "logdet")]
        estimate = materialize(better.select("grp", "start", *kept))
        if fell is None or fell <= TOLERANCE:
            break
    return estimate


def group_names() -> tuple[Column, Column, Column]:
    """Keys of a row's pair of language and source, of its language, and of all rows."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    return F.concat(F.lit("p"), named("lang"), F.lit("\x01"), named("source")), F.concat(F.lit("l"), named("lang")), F.lit("")


def group_estimates(vectors_: DataFrame, *, core: float = CORE, sample: int = SAMPLE, starts: int = STARTS, max_steps: int = MAX_STEPS) -> DataFrame:
    """The estimate (grp, mean, cov, logdet) of least determinant of each pair, each language and all rows."""
    data = materialize(vectors_.select(F.explode(F.array(*group_names())).alias("grp"), *NAMES))
    order = F.xxhash64(*NAMES)
    drawn = data.withColumn("__order", order).withColumn("__n", F.row_number().over(Window.partitionBy("grp").orderBy("__order", *NAMES))).where(F.col("__n") <= sample)
    first = materialize(drawn.drop("__n").groupBy("grp").applyInPandas(_first_estimates(core, starts), ESTIMATE))
    settled = _steps(data, first, core, max_steps)
    return settled.groupBy("grp").agg(F.min_by(F.struct("mean", "cov", "logdet"), F.struct("logdet", "start")).alias("e")).select("grp", "e.*")


def outlier_distances(vectors_: DataFrame, *, prior: float = PRIOR, **how: float) -> DataFrame:
    """Adds grp and d2 to vectors with lang and source."""
    pair, lang, every = group_names()
    estimates = materialize(group_estimates(vectors_, **how))
    counts = vectors_.groupBy(pair.alias("grp"), lang.alias("in")).agg(F.count("*").alias("n"))
    counts = counts.join(counts.groupBy("in").agg(F.sum("n").alias("in_lang")), "in")
    level = lambda key, name: estimates.select(F.col("grp").alias(key), F.col("mean").alias(f"mean_{name}"), F.col("cov").alias(f"cov_{name}"))
    known = counts.join(level("grp", "pair"), "grp").join(level("in", "lang"), "in").withColumn("all", every).join(level("all", "all"), "all").drop("in", "all")
    shrunk = materialize(known.mapInPandas(_shrink(prior), "grp string, mean array<double>, precision array<double>"))
    return vectors_.withColumn("grp", pair).join(shrunk, "grp").withColumn("d2", _distance()).drop("mean", "precision")


def quality_rules(docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    fed = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    stats = materialize(fed.mapInArrow(_measure, STATS))
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT) * F.col("n_words"))
    base = vectors(stats).withColumn("base_failed", failed)
    # the estimate covers all documents; the limits decide on their own
    return outlier_distances(base).withColumn("kept", ~F.col("base_failed") & (F.col("d2") <= cutoff))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 3).alias("distance2"))
