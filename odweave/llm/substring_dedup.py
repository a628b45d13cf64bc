"""Substring deduplication by difference-cover anchors.

Words are hashed in windows of ANCHOR words at the places of a document that a difference cover modulo PERIOD
names. For any two places i, j some shift below PERIOD takes both into the cover, so two equal runs of
PERIOD + ANCHOR - 1 words, wherever they stand, share an anchor. Anchors that two documents hold mark candidates;
a candidate is then extended to the whole window, by comparing a hash of all its words.

Each step is an exchange between groups of documents and buckets (see common): anchors out, repeated ones back;
distinct candidate windows out, each with the least id that the group has for it, back which of them a smaller id
elsewhere holds. A group's other documents with such a window then know by their own ids.

Contract: null texts have no words. A null id counts as the largest. Rows of one id are one document for the
order; repeated rows don't remove each other. Extra columns don't pass; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.llm.common import PAYLOAD_DDL, U64, Hasher, bucket_bits, exchange, group_count, grouped, inside, look_up, payloads, received, send_keys, sequences, steps, tally, total_bytes, words

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
_HASHER, _SECOND = Hasher(41), Hasher(43)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
LAST = 2**63 - 1
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A group's documents by id, the ids (a null one as LAST), and their place among distinct ids."""
    ids = table["doc_id"].combine_chunks()
    order = np.argsort(ids.fill_null(LAST).to_numpy(zero_copy_only=False), kind="stable")
    table = table.take(pa.array(order))
    sorted_ids = table["doc_id"].combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)
    place = np.cumsum(np.concatenate(([0], sorted_ids[1:] != sorted_ids[:-1]))) if len(order) else order
    return table, sorted_ids, place


def _anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word places, hashes) of the cover's anchors in documents that have a whole window."""
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(h)) - np.repeat(first[:-1], count)
    seq = sequences(h, ANCHOR)
    ok = inside(first, ANCHOR, len(h)) & _IN_COVER[within[: len(seq)] % PERIOD] & (count[doc[: len(seq)]] >= WINDOW)
    at = np.flatnonzero(ok)
    return at, seq[at]


def _send_anchors(bits: int):  # noqa: ANN202
    def send(table: pa.Table) -> pa.Table:
        table, _, place = in_order(table)
        found = []
        for i, data, offsets in steps(table["text"]):
            starts, ends, first = words(data, offsets)
            if len(starts) < WINDOW:
                continue
            at, a = _anchors(_HASHER.spans(_HASHER.prefix(data), starts, ends), first)
            doc = place[i + np.searchsorted(first, at, "right") - 1]
            order = np.lexsort((doc, a))
            a, doc = a[order], doc[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
            found.append(a[new])
        once, more, counts = tally(np.concatenate(found)) if found else (np.empty(0, U64),) * 2 + (np.empty(0, np.int64),)
        return send_keys(table["g"][0].as_py(), once, more, counts, bits)

    return send


class Candidates:
    """A group's candidate windows, the same in each pass: distinct, sorted, with the first document of each."""

    def __init__(self, table: pa.Table, answers: pa.Table, bits: int):
        self.table, self.ids, self.place = in_order(table)
        keys, counts = received(answers, bits)
        self.parts, hs, ss, docs = [], [], [], []
        for i, data, offsets in steps(self.table["text"]):
            starts, ends, first = words(data, offsets)
            win = np.empty(0, np.int64)
            if len(starts) >= WINDOW and len(keys):
                h = _HASHER.spans(_HASHER.prefix(data), starts, ends)
                at, a = _anchors(h, first)
                hot = at[look_up(a, keys, counts, bits) > 1]
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, np.maximum(hot - PERIOD + 1, 0), 1)
                np.add.at(edge, hot + 1, -1)
                m = len(h) - WINDOW + 1
                win = np.flatnonzero((np.cumsum(edge)[:m] > 0) & inside(first, WINDOW, len(h)))
                if len(win):
                    second = _SECOND.spans(_SECOND.prefix(data), starts, ends)
                    hs.append(sequences(h, WINDOW, 9)[win])
                    ss.append((sequences(second, WINDOW, 10)[win] >> U64(32)).astype(np.uint32))
                    docs.append(self.place[i + np.searchsorted(first, win, "right") - 1])
            self.parts.append((i, data, offsets, starts, ends, first, win))
        h, s, doc = (np.concatenate(x) if x else np.empty(0, k) for x, k in ((hs, U64), (ss, np.uint32), (docs, np.int64)))
        order = np.lexsort((doc, s, h))
        h, s, doc = h[order], s[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        self.h, self.s = h[new], s[new]
        least = np.empty(int(self.place[-1]) + 1 if len(self.place) else 0, np.int64)
        least[self.place] = self.ids
        self.least = least[doc[new]]  # the least id that has each window here
        run = np.cumsum(new) - 1
        self.run = np.empty(len(h), np.int64)
        self.run[order] = run
        self.later = np.empty(len(h), bool)
        self.later[order] = doc > doc[np.flatnonzero(new)][run]


def _send_windows(bits: int):  # noqa: ANN202
    def send(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return payloads([])
        c = Candidates(table, answers, bits)
        edges = np.append(np.searchsorted(c.h, np.arange(1 << bits, dtype=U64) << U64(64 - bits)), len(c.h))
        g = key[0].as_py()
        return payloads([(b, g, c.h[x:y].tobytes() + c.least[x:y].tobytes() + c.s[x:y].tobytes()) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x])

    return send


def _earlier(table: pa.Table) -> pa.Table:
    """A bucket's answer to each group: a bit for each of its windows, set if another group has it in a smaller id."""
    raw = table["payload"].to_pylist()
    n = [len(p) // 20 for p in raw]
    part = lambda kind, at: np.concatenate([np.frombuffer(p, kind, k, at * k) for p, k in zip(raw, n, strict=True)])
    h, least, s = part(U64, 0), part(np.int64, 8), part(np.uint32, 16)
    order = np.lexsort((least, s, h))
    hs, ss = h[order], s[order]
    new = np.concatenate(([True], (hs[1:] != hs[:-1]) | (ss[1:] != ss[:-1])))
    smallest = np.empty(len(h), np.int64)
    smallest[order] = least[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    before = smallest < least
    at, b, rows = 0, table["bucket"][0].as_py(), []
    for g, k in zip(table["g"].to_pylist(), n, strict=True):
        if before[at : at + k].any():
            rows.append((b, g, np.packbits(before[at : at + k]).tobytes()))
        at += k
    return payloads(rows)


def kept_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words one after the other, each followed by a space."""
    if not len(starts):
        return np.empty(0, np.uint8)
    size = ends - starts + 1
    stop = np.cumsum(size)
    source = np.repeat(starts - (stop - size), size) + np.arange(stop[-1])
    out = data[np.minimum(source, len(data) - 1)]
    out[stop - 1] = 0x20
    return out


def _remove(bits: int):  # noqa: ANN202
    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        second = np.array(answers["bucket"].to_pylist(), np.int64) >= (1 << bits)
        c = Candidates(table, answers.filter(pa.array(~second)), bits)
        earlier = np.zeros(len(c.h), bool)
        edges = np.append(np.searchsorted(c.h, np.arange(1 << bits, dtype=U64) << U64(64 - bits)), len(c.h))
        back = answers.filter(pa.array(second))
        for b, p in zip(back["bucket"].to_pylist(), back["payload"].to_pylist(), strict=True):
            x, y = edges[b - (1 << bits)], edges[b - (1 << bits) + 1]
            earlier[x:y] = np.unpackbits(np.frombuffer(p, np.uint8), count=y - x).astype(bool)
        gone = earlier[c.run] | c.later
        at, n_words, n_removed, shas = 0, [], [], []
        for _, data, _, starts, ends, first, win in c.parts:
            own = win[gone[at : at + len(win)]]
            at += len(win)
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, own, 1)
            np.add.at(edge, own + WINDOW, -1)
            drop = np.cumsum(edge[:-1]) > 0
            keep = np.flatnonzero(~drop)
            text = kept_bytes(data, starts[keep], ends[keep]).tobytes()
            sizes = np.concatenate(([0], np.cumsum(ends[keep] - starts[keep] + 1)))
            cut = sizes[np.searchsorted(keep, first)]
            removed = np.concatenate(([0], np.cumsum(drop)))[first]
            n_words.append(np.diff(first))
            n_removed.append(np.diff(removed))
            shas += [hashlib.sha256(text[x : max(x, y - 1)]).hexdigest() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return pa.table({"doc_id": c.table["doc_id"], "n_words": np.concatenate(n_words), "n_removed": np.concatenate(n_removed), "kept_sha256": pa.array(shas, pa.string())})

    return remove


def dedup_substrings(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    n = group_count(total_bytes(docs, text))
    bits = bucket_bits(n)
    base = grouped(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")), n)
    first = exchange(base.groupBy("g").applyInArrow(_send_anchors(bits), PAYLOAD_DDL))
    windows = base.groupBy("g").cogroup(first.groupBy("g")).applyInArrow(_send_windows(bits), PAYLOAD_DDL)
    second = windows.groupBy("bucket").applyInArrow(_earlier, PAYLOAD_DDL).withColumn("bucket", F.col("bucket") + F.lit(1 << bits))
    return base.groupBy("g").cogroup(first.unionByName(second).groupBy("g")).applyInArrow(_remove(bits), OUT)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
