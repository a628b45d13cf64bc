"""Best-fit packing of token sequences by exact-complement hashing.

Documents are tokenized once; only the lengths of their pieces go on. How pieces combine depends on nothing but
how many there are of each length, so the plan is made from a table of at most `capacity` counts, whatever the
size of the corpus: open sequences take a single piece, a pair or a triple whose lengths sum to the gap exactly,
as many at once as the counts allow, and else the longest piece that fits. The plan is a list of (length, first
rank, number of pieces, first sequence, offset) rows; a piece finds its row by its length and its rank among
pieces of that length. Ranks come from counts of (length, salt), so no length, however common, meets in one task.

Contract: a null text is empty and gives the end token alone. Repeated rows are pieces like others. Only
documents longer than `capacity` are cut. Extra columns don't pass. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odweave.llm.common import materialize

CAPACITY = 4096
END = 1
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
#: Words kept encoded at a time.
CACHE_WORDS = 600_000
#: Pieces of one length that one task ranks.
SALT_ROWS = 50_000


class WordEncoder:
    """Encodes by words between white space, each distinct word once, where the tokenizer's rules allow it.

    The tokenizer normalises, splits with one expression whose matches never hold white space, and encodes every
    match by itself. So ids of a text are those of its words one after the other. That is used for texts of
    characters below U+0250, less those that the two expression engines see differently and less texts that
    may hold a special token; any other text goes to the tokenizer whole. A comma or full stop that ends a word
    is a match of its own unless another mark stands before it, so it is set apart first: fewer distinct words.
    """

    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
    WHOLE = re.compile("[ɐ-\U0010ffff\x1c-\x1f\x85\xa0\xb2\xb3\xb9\xbc-\xbeİ]|<\\|")

    MARKS = re.compile(r"(?:[^\w\s]|_)[.,](?=[ \n])")

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        """Encodes new words in one call; each match of the split ends with the one token that ends a word."""
        for k in range(0, len(new), 2000):
            part = new[k : k + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            matches = np.cumsum([len(self.SPLIT.findall(w)) for w in part])
            if len(last) != matches[-1]:  # some word is split in another way: each by itself, as the tokenizer does it
                for w in part:
                    self.cache[w] = self.whole(w)
                continue
            at = np.concatenate(([0], last))[np.concatenate(([0], matches))] * 4
            raw = ids.tobytes()
            for i, w in enumerate(part):
                self.cache[w] = raw[at[i] : at[i + 1]]

    def split(self, text: str) -> list[str] | None:
        if self.WHOLE.search(text):
            return None
        low = text.lower()
        if not self.MARKS.search(low):
            low = low.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n").replace(",\n", " ,\n")
        return low.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if len(self.cache) > CACHE_WORDS:  # the older half has the more frequent words
            for w in list(itertools.islice(reversed(self.cache), CACHE_WORDS // 2)):
                del self.cache[w]
        found = [self.split(t) for t in texts]
        new: set[str] = set()
        for f in found:
            if f:
                new.update(set(f).difference(self.cache))
        if new:
            self.learn(sorted(new))
        get = self.cache.__getitem__
        return [self.whole(t) if f is None else b"".join(map(get, f)) for t, f in zip(texts, found, strict=True)]


def _encoder(path: str, cache: dict[str, WordEncoder] = {}) -> WordEncoder:  # noqa: B006  one a worker
    if path not in cache:
        cache[path] = WordEncoder(path)
    return cache[path]


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def cutter(path: str, capacity: int, end: int):  # noqa: ANN201
    tail = end.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            rows: list[tuple[Any, int, int, int, int]] = []
            for some in slices(batch):
                for id, ids in zip(some["doc_id"].to_pylist(), encoder.encode([t or "" for t in some["text"].to_pylist()]), strict=True):
                    ids += tail
                    for k in range(0, len(ids), 4 * capacity):
                        part = ids[k : k + 4 * capacity]
                        rows.append((id, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


class Complements:
    """Counts by length and what of them fills a gap exactly.

    Lengths that are left are kept as the bits of one integer, and mirrored in another: shifted against each
    other by the gap, their common bits are the pairs that sum to it.
    """

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(np.int64).tolist()
        self.top = len(self.n) - 1
        self.left = sum(1 << i for i, x in enumerate(self.n) if x and i)
        self.mirror = sum(1 << (self.top - i) for i, x in enumerate(self.n) if x and i)

    def take(self, length: int, k: int) -> None:
        self.n[length] -= k
        if not self.n[length] and self.left >> length & 1:
            self.left ^= 1 << length
            self.mirror ^= 1 << (self.top - length)

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.n[gap] else None

    def pair(self, gap: int, above: int = 1) -> tuple[int, ...] | None:
        """The most uneven pair of lengths, each at least `above`, that sums to gap."""
        both = (self.left & (self.mirror >> (self.top - gap))) >> above << above if gap >= 2 * above else 0
        while both:
            low = (both & -both).bit_length() - 1
            if 2 * low > gap:
                return None
            if 2 * low < gap or self.n[low] > 1:
                return (gap - low, low)
            both &= both - 1
        return None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """A pair and a smallest part of at most a third of the gap."""
        bits = self.left & ((1 << (gap // 3 + 1)) - 1)
        while bits:
            a = (bits & -bits).bit_length() - 1
            bits &= bits - 1
            found = self.pair(gap - a, a)
            if found and found.count(a) < self.n[a]:
                return (*found, a)
        return None

    def best_fit(self, gap: int) -> int:
        return (self.left & ((1 << (gap + 1)) - 1)).bit_length() - 1


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences of them) for counts[length] pieces, longest first."""
    c, out = Complements(np.concatenate((counts, np.zeros(capacity + 2 - len(counts), np.int64)))), []
    if c.n[capacity]:
        out.append(((capacity,), c.n[capacity]))
        c.take(capacity, c.n[capacity])
    for length in range(capacity - 1, 0, -1):
        while c.n[length]:
            # as many as can be the longest of a sequence each: where two fit, more than that would be wasted
            m = -(-c.n[length] // (capacity // length))
            open_ = [((length,), m)]
            c.take(length, m)
            while open_:
                lengths, m = open_.pop()
                gap = capacity - sum(lengths)
                more = (c.single(gap) or c.pair(gap) or c.triple(gap)) if gap else None
                exact = more is not None
                if gap and not more and (fit := c.best_fit(gap)) > 0:
                    more = (fit,)
                if not more:
                    out.append((lengths, m))
                    continue
                uses = {x: more.count(x) for x in more}
                t = min(m, *(c.n[x] // k for x, k in uses.items()))
                for x, k in uses.items():
                    c.take(x, t * k)
                if t < m:
                    open_.append((lengths, m - t))
                (out if exact else open_).append((lengths + more, t))
    return out


def plan_rows(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, offset), by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, m in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), m, sequence, offset))
            used[x] = used.get(x, 0) + m
            offset += x
        sequence += m
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def placer(rows: np.ndarray):  # noqa: ANN201
    keys = rows[:, 0] << 44 | rows[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy().astype(np.int64), batch["rank"].to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])], names=[*names, "sequence_id", "offset"])

    return place


def pack_pieces(pieces: DataFrame, *, capacity: int = CAPACITY, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Adds sequence_id and offset to (doc_id, piece, start, length, ids_crc32)."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # capacity rows at most
        counts[length] = n
    rows = plan_rows(plan(counts, capacity))
    # a length is dealt to as many salts as its count asks for, by a table of `capacity` numbers in the plan
    salts = F.element_at(F.array(*[F.lit(max(1, -(-int(n) // salt_rows))) for n in counts]), F.col("length") + 1)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts).cast("int"))
    by_salt = salted.groupBy("length", "salt").count()
    before = by_salt.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("rank", rank.cast("long")).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(placer(rows), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    pieces = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cutter(tokenizer, capacity, end), PIECES)
    return pack_pieces(materialize(pieces), capacity=capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, default_tokenizer()).withColumn("length", F.col("length").cast("long"))
