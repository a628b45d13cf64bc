"""What the text operators share: words and hashes in numpy, and exchange of hashes between groups of documents.

Groups. An operator that compares documents deals them to groups by the hash of id and text; a group is a bounded
number of bytes. Each group sends what it has, deduplicated, to buckets by hash value (a payload of packed
integers for each bucket); a bucket, also bounded, answers each group with what it found. Text crosses the
network once and a hash costs its own bytes, not those of a row. A value that a third of all documents hold
reaches its bucket once a group, not once a document.

There are about half as many buckets as groups, so the number of payloads is half the square of that of groups; a
group's bytes therefore grow with the root of the input's (see group_count), and a payload holds many hashes:

    input    groups      bytes each   hashes in a payload (of words)
    30 GB    4800        6 MiB        250
    1 TB     28,000      35 MiB       350
    100 TB   1,500,000   64 MiB       11 (payloads are then about half overhead, and no worse beyond)
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.session import shared_dir

U64 = np.uint64
#: Bytes that separate words: space and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes of text that one numpy step works on, unless a single document is longer.
STEP_BYTES = 1 << 19
#: Bytes of text in a group of documents: the least, the most, and the input up to which groups are the least.
GROUP_BYTES, MOST_GROUP_BYTES, SMALL_INPUT = 6 << 20, 64 << 20, 30e9


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes to the shared folder and reads back: cuts lineage, survives lost executors."""
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wrapped(docs: DataFrame, **own: Column) -> DataFrame:
    """All columns of docs in one, `row`, beside an operator's own, which no column of docs can then clash with."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in own.items()])


def unwrapped(docs: DataFrame) -> list[Column]:
    """The columns of docs, out of what wrapped() made."""
    return [F.col("row").getField(c).alias(c) for c in docs.columns]


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0)


def group_count(n_bytes: int, group_bytes: int | None = None) -> int:
    """Groups of group_bytes each; by default of GROUP_BYTES, times the root of the input's size beyond SMALL_INPUT."""
    grown = min(MOST_GROUP_BYTES, GROUP_BYTES * max(1.0, n_bytes / SMALL_INPUT) ** 0.5)
    return max(8, math.ceil(n_bytes / (group_bytes or grown)))


def bucket_bits(n_groups: int) -> int:
    return max(3, math.ceil(math.log2(n_groups)) - 1)


def grouped(docs: DataFrame, n_groups: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(g, doc_id, text) with g by the hash of id and text, as an id may be that of many rows; null texts are empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(group_of(F.col(id), F.xxhash64(whole), n_groups).alias("g"), F.col(id).alias("doc_id"), whole.alias("text"))


def group_of(id: Column, text_hash: Column, n_groups: int) -> Column:
    return F.pmod(F.xxhash64(id, text_hash), F.lit(n_groups)).cast("int")


# --- numbers from bytes ---------------------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer over 64 bits (in place)."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


class Hasher:
    """Hashes of substrings of a byte array: a polynomial over the integers modulo 2**64 from prefix sums.

    Each byte stands for a random odd-free 64-bit value; different seeds give independent hashes.
    """

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**64, 256, dtype=U64)
        self.base = int(rng.integers(2**62, 2**63)) * 2 + 1
        self.base &= 2**64 - 1
        self.inverse = pow(self.base, -1, 2**64)
        self.seed = seed
        self.up = self.down = np.ones(1, U64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            grow = lambda b: np.cumprod(np.concatenate(([U64(1)], np.full(n - 1, b, U64))), dtype=U64)
            up, down = grow(self.base), grow(self.inverse)
            if n <= 4 * STEP_BYTES:  # those of a very long document aren't kept
                self.up, self.down = up, down
            return up, down
        return self.up, self.down

    def prefix(self, data: np.ndarray) -> np.ndarray:
        up, _ = self.powers(len(data) + 1)
        out = np.empty(len(data) + 1, U64)
        out[0] = 0
        np.cumsum(self.table[data] * up[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = self.powers(len(prefix))
        h = (prefix[ends] - prefix[starts]) * down[starts]
        h += (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15)
        return mix(h)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the words of concatenated texts; document i has words first[i] to first[i + 1]."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    sep = SEPARATOR[data]
    before = np.empty(n + 1, bool)
    before[0], before[1:] = True, sep
    before[offsets] = True
    starts = np.flatnonzero(~sep & before[:n])
    after = np.empty(n + 1, bool)
    after[n], after[:n] = True, sep
    after[offsets] = True
    ends = np.flatnonzero(~sep & after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sequences(h: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Hash of each n successive hashes; len(h) - n + 1 of them (across documents too: mask those)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    factors = np.random.default_rng(seed).integers(2**62, 2**63, n, dtype=U64) * U64(2) + U64(1)
    out = h[:m] * factors[0]
    for j in range(1, n):
        out += h[j : j + m] * factors[j]
        out ^= out >> U64(29)
        out *= U64(0xBF58476D1CE4E5B9)
    return mix(out)


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the n-word windows lie within one document."""
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    ok = np.ones(m, bool)
    # a window that starts less than n words before its document's end reaches into the next
    for j in range(1, n):
        at = first[1:] - j
        ok[at[(at >= 0) & (at < m)]] = False
    return ok


def steps(texts: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in pieces of about STEP_BYTES: (index of the first text, bytes, offsets). Null texts are empty."""
    chunks = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
    at = 0
    for chunk in chunks:
        if not len(chunk):
            continue
        chunk = chunk.cast(pa.large_binary()) if chunk.type != pa.large_binary() else chunk
        if chunk.null_count:
            chunk = chunk.fill_null(b"")
        _, off, body = chunk.buffers()
        offsets = np.frombuffer(off, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
        i = 0
        while i < len(chunk):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP_BYTES, "right")) - 1)
            j = min(j, len(chunk))
            yield at + i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
        at += len(chunk)


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of `total` places lie in [start, start + length) for some start."""
    upto = np.cumsum(np.bincount(starts, minlength=total)[:total])
    upto[length:] -= upto[:-length].copy() if total > length else 0
    return upto > 0


# --- exchange -------------------------------------------------------------------------------------------------

PAYLOAD = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("payload", pa.binary())])
PAYLOAD_DDL = "bucket int, g int, payload binary"


def payloads(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    b, g, p = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(b, pa.int32()), pa.array(g, pa.int32()), pa.array(p, pa.binary())], schema=PAYLOAD)


def deal(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted hashes: where each bucket (their leading bits) begins, and the 32 bits that follow as keys."""
    edges = np.searchsorted(hashes, np.arange(1 << bits, dtype=U64) << U64(64 - bits))
    return np.append(edges, len(hashes)), (hashes >> U64(32 - bits)).astype(np.uint32)


def send_keys(g: int, once: np.ndarray, more: np.ndarray, counts: np.ndarray, bits: int) -> pa.Table:
    """A group's distinct hashes: those it holds once, and those it holds more often with how often."""
    e1, k1 = deal(once, bits)
    e2, k2 = deal(more, bits)
    rows = []
    for b in range(1 << bits):
        x, y, c = k1[e1[b] : e1[b + 1]], k2[e2[b] : e2[b + 1]], counts[e2[b] : e2[b + 1]].astype(np.uint32)
        if len(x) or len(y):
            rows.append((b, g, len(x).to_bytes(4, "little") + x.tobytes() + y.tobytes() + c.tobytes()))
    return payloads(rows)


def tally(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes that occur once, those that occur more often, their counts), sorted."""
    u, n = np.unique(hashes, return_counts=True)
    return u[n == 1], u[n > 1], n[n > 1]


def repeated_keys(table: pa.Table) -> pa.Table:
    """A bucket's answer to each group: its keys that occur twice or more in all, with their counts.

    Keys are 32 bits behind the bucket's own; a chance match only lets a candidate through that a later
    comparison of whole values removes.
    """
    got = [(g, np.frombuffer(p, np.uint32)) for g, p in zip(table["g"].to_pylist(), table["payload"].to_pylist(), strict=True)]
    keys, ones = [], []
    for _, p in got:
        n = int(p[0])
        m = (len(p) - 1 - n) // 2
        keys.append(p[1 : 1 + n + m])
        ones.append(np.concatenate((np.ones(n, np.uint32), p[1 + n + m :])))
    every, weight = np.concatenate(keys), np.concatenate(ones)
    order = np.argsort(every, kind="stable")
    sorted_keys = every[order]
    new = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    total = np.add.reduceat(weight[order].astype(np.int64), new)
    hot, number = sorted_keys[new][total > 1], total[total > 1].astype(np.uint32)
    rows, bucket = [], table["bucket"][0].as_py()
    for (g, _), k in zip(got, keys, strict=True):
        at = np.searchsorted(hot, k)
        at[at == len(hot)] = 0
        mine = (hot[at] == k) if len(hot) else np.zeros(len(k), bool)
        if mine.any():
            rows.append((bucket, g, k[mine].tobytes() + number[at[mine]].tobytes()))
    return payloads(rows)


def received(table: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted bucket-and-key prefixes, their counts) from a group's answers."""
    keys, counts = [np.empty(0, U64)], [np.empty(0, np.uint32)]
    for b, p in zip(table["bucket"].to_pylist(), table["payload"].to_pylist(), strict=True):
        a = np.frombuffer(p, np.uint32)
        keys.append(a[: len(a) // 2].astype(U64) | (U64(b) << U64(32)))
        counts.append(a[len(a) // 2 :])
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    return k[order], c[order]


def look_up(hashes: np.ndarray, keys: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """How often each hash occurs in all groups (1 if its answer doesn't name it)."""
    if not len(keys):
        return np.ones(len(hashes), np.int64)
    h = hashes >> U64(32 - bits)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return np.where(keys[at] == h, counts[at], 1).astype(np.int64)


def exchange(sent: DataFrame) -> DataFrame:
    return sent.groupBy("bucket").applyInArrow(repeated_keys, PAYLOAD_DDL)


def sha256(data: bytes) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()


def crc_of_id(column: str = "doc_id") -> object:
    return F.crc32(F.col(column).cast("string"))
