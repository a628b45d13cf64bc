"""Quality classifier: supervised subword embeddings.

Features are hashed words, hashed character 3- and 4-grams of each word with its boundaries, over UTF-8 bytes, and
hashed word bigrams in buckets of their own; the bigram of a word that follows itself has one bucket, whichever word.
A document is the mean of its features' vectors, a bigram counting PAIR times; a softmax over two classes stands on
top. Training is stochastic gradient descent in numpy (one document a step, per-row adaptive rates) on a bounded sample
of labelled documents: `max_train` of them, least hash of the id first. Features are counted on the executors from whole
texts; the driver gets counts only, and each document has at most 2 * BUCKETS of them. As the mean is linear, a
trained model folds into one number a bucket, which is all that scoring needs.

FOLDS models are trained, each without its fold of the sample, and averaged. The logits of the documents that each
left out place the bias: the limit THRESHOLD is put where rejecting label 0 and keeping label 1 (which counts KEEP
times as much) go best together.

Contract: null texts are empty; a text without words scores the bias alone. Without labels of both classes every
score is the share of label 1 (0.5 without any). Rows are scored one by one, so repeated rows score alike. The columns
asked for pass, but for `score` and `predicted`, which the result names itself. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.llm.common import SEPARATOR, U64, Hasher, crc_of_id, inside, sequences, steps, words

BITS = 17
BUCKETS = 1 << BITS
#: The bucket of a word that follows itself, the first of the bigrams'.
REPEAT = BUCKETS
PAIR, DIM, FOLDS, KEEP = 6, 8, 3, 20
MAX_TRAIN = 2500
THRESHOLD = 0.3
_HASHER = Hasher(11)


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place in the text, bucket) of each word, bigram of words, 3-gram and 4-gram."""
    n = len(data)
    starts, ends, first = words(data, offsets)
    out = []
    if len(starts):
        h = _HASHER.spans(_HASHER.prefix(data), starts, ends)
        out.append((starts, (h >> U64(64 - BITS)).astype(np.int32)))
        pair = np.where(h[1:] == h[:-1], 0, (sequences(h, 2) >> U64(64 - BITS)).astype(np.int32))
        ok = inside(first, 2, len(h))
        out.append((starts[1:][ok], (pair[ok] + REPEAT).astype(np.int32)))
    sep = SEPARATOR[data]
    x = np.where(sep, np.uint8(32), data).astype(np.uint32)
    stop = np.zeros(n + 4, bool)  # the first byte of the next document
    stop[offsets[1:]] = True
    for size, factor in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
        m = n - size + 1
        if m <= 0:
            continue
        gram, ok = x[:m].copy(), np.ones(m, bool)
        for j in range(1, size):
            gram |= x[j : j + m] << np.uint32(8 * j)
            ok &= ~stop[j : j + m]
            if j < size - 1:
                ok &= ~sep[j : j + m]
        gram *= np.uint32(factor)
        gram ^= gram >> np.uint32(15)
        gram *= np.uint32(0x2C1B3C6D)
        at = np.flatnonzero(ok)
        out.append((at, (gram[at] >> np.uint32(32 - BITS)).astype(np.int32)))
    return out


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, buckets, counts) of each document."""
    for batch in batches:
        ids, buckets, counts = [], [], []
        for _, data, offsets in steps(batch["text"]):
            place, bucket = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (zip(*features(data, offsets), strict=True) if len(data) else ((), ())))
            doc = np.searchsorted(offsets, place, "right") - 1
            key, number = np.unique(doc * (2 * BUCKETS) + bucket, return_counts=True)
            edges = np.searchsorted(key, np.arange(len(offsets)) * (2 * BUCKETS))
            for i in range(len(offsets) - 1):
                buckets.append((key[edges[i] : edges[i + 1]] % (2 * BUCKETS)).astype(np.int32))
                counts.append(number[edges[i] : edges[i + 1]].astype(np.int32))
        del ids
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(buckets, kind), pa.array(counts, kind)], names=["doc_id", "label", "buckets", "counts"])


Example = tuple[int, np.ndarray, np.ndarray]  # label, buckets, weights that sum to 1


def examples(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> list[Example]:
    """From (label, buckets, counts)."""
    out = []
    for y, at, n in rows:
        w = np.where(at >= REPEAT, PAIR, 1) * n
        out.append((y, at, (w / max(1, w.sum())).astype(np.float32)))
    return out


def descend(rows: list[Example], *, epochs: int = 5, rate: float = 0.15, seed: int = 5) -> tuple[np.ndarray, float]:
    """(score by bucket, bias) of one model."""
    ones = sum(y for y, _, _ in rows)
    # a rare class weighs more, by the root of its rarity
    balance = ((len(rows) / (2 * max(1, len(rows) - ones))) ** 0.5, (len(rows) / (2 * max(1, ones))) ** 0.5)
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((2 * BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    grown = np.full(2 * BUCKETS, 1e-8, np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    out[1] = rng.random(DIM) - 0.5
    out[0] = -out[1]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(rows)):
            y, at, weight = rows[i]
            if not len(at):
                continue
            h = weight @ vectors[at]
            z = out @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= balance[y]
            back = p @ out
            out -= step * np.outer(p, h)
            bias -= step * 0.1 * p
            grown[at] += weight * weight * float(back @ back)
            vectors[at] -= (step * weight / np.sqrt(grown[at]))[:, None] * back[None, :]
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def best_limit(logits: np.ndarray, labels: np.ndarray) -> float:
    """Where rejected of label 0 + KEEP * kept of label 1, as shares, is greatest: the middle of the widest such gap."""
    order = np.argsort(logits, kind="stable")
    z, y = logits[order], labels[order]
    below0 = np.concatenate(([0], np.cumsum(y == 0))) / max(1, (y == 0).sum())
    below1 = np.concatenate(([0], np.cumsum(y == 1))) / max(1, (y == 1).sum())
    gain = below0 - KEEP * below1
    edges = np.concatenate(([z[0] - 1], z, [z[-1] + 1]))
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    i = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[i] + edges[i + 1]) / 2)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], *, folds: int = FOLDS, **how: float) -> tuple[np.ndarray, float]:
    """(score by bucket, bias) from (label, buckets, counts) rows."""
    ones = sum(y for y, _, _ in rows)
    if not rows or ones in (0, len(rows)):
        share = 0.5 if not rows else min(0.99, max(0.01, ones / len(rows)))
        return np.zeros(2 * BUCKETS, np.float32), float(np.log(share / (1 - share)))
    known = examples(rows)
    total, bias, left_out = np.zeros(2 * BUCKETS, np.float32), 0.0, np.zeros(len(known))
    for k in range(folds):
        table, b = descend([e for i, e in enumerate(known) if i % folds != k], **how)
        for i in range(k, len(known), folds):
            left_out[i] = table[known[i][1]] @ known[i][2] + b
        total += table / folds
        bias += b / folds
    limit = best_limit(left_out, np.array([y for y, _, _ in rows]))
    return total, bias + float(np.log(THRESHOLD / (1 - THRESHOLD))) - limit


def scorer(table: np.ndarray, bias: float, with_text: bool = False):  # noqa: ANN201
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = [np.empty(0)]
            for _, data, offsets in steps(batch["text"]):
                total, number = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
                for place, bucket in features(data, offsets) if len(data) else ():
                    edges = np.searchsorted(place, offsets)
                    sums = np.concatenate(([0.0], np.cumsum(table[bucket], dtype=np.float64)))
                    weight = PAIR if len(bucket) and bucket[0] >= REPEAT else 1
                    total += np.diff(sums[edges]) * weight
                    number += np.diff(edges) * weight
                logits.append(total / np.maximum(number, 1) + bias)
            p = 1 / (1 + np.exp(-np.concatenate(logits)))
            keep = [c for c in batch.schema.names if c != "text" or with_text]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(np.round(p, 6))], names=[*keep, "score"])

    return score


def fit(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """Trains on at most max_train rows of labels whose id is not in the held-out fifth."""
    chosen = labels.where((crc_of_id(id) % 5 != 0) & F.col(label).isNotNull()).select(F.col(id).alias("doc_id"), F.col(label).cast("int").alias("label")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")  # max_train rows of two numbers
    rows = texts.select("doc_id", "label", "text").mapInArrow(counted, "doc_id long, label int, buckets array<int>, counts array<int>").toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    y, b, c = rows["label"].to_numpy(), rows["buckets"].combine_chunks(), rows["counts"].combine_chunks()
    bo, bv, cv = b.offsets.to_numpy(), b.values.to_numpy(), c.values.to_numpy()
    return train([(int(y[i]), bv[bo[i] : bo[i + 1]], cv[bo[i] : bo[i + 1]]) for i in order])


def classify(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, columns: tuple[str, ...] | None = None, **kw: object) -> DataFrame:
    """The given columns (the id alone by default; the text may be among them) plus score and predicted."""
    table, bias = fit(docs, labels, id=id, text=text, **kw)
    kept = [id] if columns is None else [c for c in columns if c not in ("score", "predicted")]
    others = [c for c in kept if c != text]
    fed = docs.select(*[F.col(f"`{c}`").alias(f"__{c}") for c in others], F.col(text).alias("text"))
    schema = ", ".join(f"`__{c}` {docs.schema[c].dataType.simpleString()}" for c in others) + (", text string" if text in kept else "") + ", score double"
    out = fed.mapInArrow(scorer(table, bias, text in kept), schema)
    return out.select(*[F.col("text" if c == text else f"`__{c}`").alias(c) for c in kept], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return classify(docs, labels).select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", "predicted")
