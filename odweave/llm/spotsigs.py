"""Document fingerprints by spot signatures.

A signature is a common word (an antecedent) with the chain of content words that follow it. The set of a text's
signatures, as sorted 32-bit hashes in hexadecimal, is its fingerprint; likeness is the Jaccard coefficient of
two sets. Texts without a common word use every word as an antecedent, and texts without words their runs of other
marks as words, so only a blank text has an empty fingerprint; two empty ones are alike (1.0), an empty and another are
not (0.0).

`near_duplicates` joins documents whose fingerprints have a likeness of 0.8 or more. No text is shuffled for it:

1. One pass gives each document's set size and set hash; documents of one hash are a class. Each task adds a sketch of
   how often signatures occur, 2**SKETCH_BITS counters, which added up put all signatures in one order, rarest first.
2. Two sets at the threshold share a signature that is among the first |x| - ceil(t |x|) + 1 of the larger and the
   first |x| - ceil(2 t / (1 + t) |x|) + 1 of the smaller in that order (any order would do; this one keeps common
   signatures out). A pass gives these with their class and length partition. Sets of partitions two or more apart can't
   be alike, so a signature's list is cut by them: a set is in that of its own partition and, as the smaller one of a
   pair, in the next. Lists with one least class and partition are a block, and each class goes once to each of its blocks.
3. Each class has a bitmap, for every place whether an odd number of its signatures falls there. Bits that differ are at
   most the signatures that do, so a class whose bitmap differs too much from those of all others in a block leaves it
   before any set is sent.
4. In a block, sets of partitions two or more apart never meet, nor those that hang together already, and within
   reach a comparison ends once the bound on what may still be common is too low.

`fingerprint_in_order` lets each document meet the next one: text is shuffled once, compressed, into ranges of ids that
a task reads in order, whatever their size. Each document's component travels in the same shuffle.

Contract: null texts are empty. Documents follow each other in descending id, null ids last, repeated ids by descending
hash of the text; the first follows the last. In the join a blank text links with nothing, and a null id counts as
largest; rows of one id are told apart; a repeated row is repeated in the result. Extra columns don't pass. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.llm.common import LOWER, SEPARATOR, U64, Hasher, group_count, materialize, mix, steps, total_bytes
from odweave.llm.graphs import connected_components
from odweave.llm.jaccard_join import BLOCK, BOTTOM, EDGE, LAST, TOP, Union, _link_block, link_large_blocks, ranked, set_hashes

#: Common words of English, French, German and Spanish.
COMMON = """a an and are as at be been but by for from had has have he her his if in into is it its not of on or she so that the their them then there they this to was we were which who will with you
au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas pour qu que qui sa se ses son sont sur un une vous
aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind über um und von vor war wie wir zu zum zur
al como con cuando de del desde el ella en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por que se si sin sobre su sus también un una y ya"""
CHAIN, DISTANCE = 2, 1
#: Counters of the sketch of signatures, and ranges of ids at most.
SKETCH_BITS, MAX_RANGES = 16, 20_000
#: Bits of a filter that spares most sets the way to the join by which they are chosen.
FILTER_BITS = 23
#: Bits of a set's bitmap: the least power of two that is its size or more, between these.
LEAST_BITS, MOST_BITS = 64, 1 << 13
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_HASHER = Hasher(23)


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _HASHER.spans(_HASHER.prefix(LOWER[data]), starts, ends)


def _common() -> np.ndarray:
    out = []
    for w in sorted(set(COMMON.split())):
        b = np.frombuffer(w.encode(), np.uint8)
        out.append(_hash_words(b, np.array([0]), np.array([len(b)]))[0])
    return np.sort(np.array(out, U64))


_COMMON = _common()


def signatures(texts: list[bytes], *, chain: int = CHAIN, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct (text index << 32 | signature), edges) of some texts."""
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    owner, sig = spots(np.frombuffer(b"".join(texts), np.uint8), offsets, chain, distance)
    key = np.unique(owner.astype(U64) << U64(32) | sig >> U64(32))
    return key, np.searchsorted(key, np.arange(len(texts) + 1, dtype=U64) << U64(32))


def signature_sets(texts: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct 32-bit signatures) of each text."""
    for i, data, offsets in steps(texts):
        owner, sig = spots(data, offsets)
        key = np.unique(owner.astype(U64) << U64(32) | sig >> U64(32))
        edges = np.searchsorted(key, np.arange(len(offsets), dtype=U64) << U64(32))
        for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            yield i + k, key[a:b] & U64(0xFFFFFFFF)


def _runs(gap: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs between gaps; none crosses a text's end."""
    edge = np.empty(len(gap) + 1, bool)
    edge[0], edge[1:] = True, gap
    edge[offsets] = True
    starts = np.flatnonzero(~gap & edge[:-1])
    edge[-1], edge[:-1] = True, gap
    edge[offsets] = True
    return starts, np.flatnonzero(~gap & edge[1:]) + 1


def spots(data: np.ndarray, offsets: np.ndarray, chain: int = CHAIN, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 64-bit signature) of every antecedent with its chain."""
    n_texts = len(offsets) - 1
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, U64)
    starts, ends = _runs(NOT_WORD[data], offsets)
    doc = np.searchsorted(offsets, starts, "right") - 1
    wordless = np.bincount(doc, minlength=n_texts) == 0
    if wordless.any():
        starts, ends = _runs(np.where(np.repeat(wordless, np.diff(offsets)), SEPARATOR[data], NOT_WORD[data]), offsets)
        doc = np.searchsorted(offsets, starts, "right") - 1
    h = _hash_words(data, starts, ends)
    at = np.searchsorted(_COMMON, h)
    at[at == len(_COMMON)] = 0
    common = _COMMON[at] == h
    content = np.flatnonzero(~common)
    chains = np.zeros(len(content), U64)
    ok = np.ones(len(content), bool)
    reach = (chain - 1) * distance
    for j in range(chain):
        k = np.minimum(np.arange(len(content)) + j * distance, max(len(content) - 1, 0))
        chains = mix(chains * U64(0x9E3779B97F4A7C15) + h[content[k]]) if len(content) else chains
    last = np.arange(len(content)) + reach
    ok = (last < len(content)) & (doc[content[np.minimum(last, max(len(content) - 1, 0))]] == doc[content]) if len(content) else ok
    spots = np.flatnonzero(common)
    follow = np.searchsorted(content, spots)
    valid = follow < len(content)
    spots, follow = spots[valid], follow[valid]
    valid = ok[follow] & (doc[content[follow]] == doc[spots])
    spots, follow = spots[valid], follow[valid]
    sig = mix(h[spots] + chains[follow] * U64(0xD1342543DE82EF95))
    owner = doc[spots]
    # texts without a signature: each word with its successor
    bare = np.ones(n_texts, bool)
    bare[owner] = False
    lone = np.flatnonzero(bare[doc])
    if len(lone):
        after = np.minimum(lone + 1, len(h) - 1)
        same = (doc[after] == doc[lone]) & (after > lone)
        pair = mix(h[lone] * U64(3) + np.where(same, h[after], U64(0)))
        single = np.bincount(doc[lone], minlength=n_texts)[doc[lone]] == 1
        use = same | single
        sig, owner = np.concatenate((sig, pair[use])), np.concatenate((owner, doc[lone][use]))
    return owner, sig


def fingerprint(part: np.ndarray) -> str:
    return (part & U64(0xFFFFFFFF)).astype(">u4").tobytes().hex()


def common_count(a: np.ndarray, b: np.ndarray, need: float = 0) -> int:
    """How many elements two sorted distinct arrays share; -1 as soon as what remains can't give `need`."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    common = 0
    for k in range(0, len(small), 1024):
        if common + len(small) - k < need:
            return -1
        part = small[k : k + 1024]
        at = np.searchsorted(large, part)
        at[at == len(large)] = 0
        common += int((large[at] == part).sum()) if len(large) else 0
    return common if common >= need else -1


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted distinct arrays; -1 as soon as sizes or what remains rule `least` out."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return -1.0
    common = common_count(a, b, least / (1 + least) * (len(a) + len(b)) - 1e-9)
    return common / (len(a) + len(b) - common) if common >= 0 else -1.0


def length_partition(n: int, threshold: float, edges: list[int] | None = None) -> int:
    """Sets of partitions two or more apart can't reach the threshold."""
    if edges is None:
        edges = length_edges(threshold)
    return bisect_left(edges, n)


def length_edges(threshold: float, longest: int = 1 << 40) -> list[int]:
    edges = [0, 1]
    while edges[-1] < longest:
        edges.append(max(edges[-1] + 1, int(edges[-1] / threshold)))
    return edges


# --- the join ---------------------------------------------------------------------------------------------------


def link_by_length(labels: list[int], sizes: list[int], blobs: list[bytes], probes: int = 0) -> list[tuple[int, int]]:
    """Pairs of labels to unite, as jaccard_join.link_sets gives them, over partitions by length.

    Each set looks up its rarest signatures in an index of those of the others, and is compared with the sets found
    that lie in its own or a neighbouring partition and don't hang together with it yet.
    """
    paths, n_ranks = ranked(blobs)
    n, size = len(labels), np.array(sizes, np.int64)
    union, first = Union(n), {}
    for i, x in enumerate(labels):
        union.join(i, first.setdefault(x, i))
    root = np.array([union.find(i) for i in range(n)], np.int64)
    edges = length_edges(TOP / BOTTOM, int(size.max(initial=1)))
    part = np.array([length_partition(x, TOP / BOTTOM, edges) for x in sizes], np.int64)
    heads = []
    for x, p in zip(sizes, paths, strict=True):
        room = x - -(-TOP * x // BOTTOM) + 1 - (x - len(p))
        heads.append(p[len(p) - room :] if room > 0 else p[:0])
    token = np.concatenate(heads) if heads else np.empty(0, np.int32)
    owner = np.repeat(np.arange(n), [len(h) for h in heads])
    owner = owner[np.argsort(token, kind="stable")]
    at = np.concatenate(([0], np.cumsum(np.bincount(token, minlength=n_ranks)))).tolist()
    met, found = np.zeros(n, bool), []
    may = np.arange(n) >= probes
    for i in range(probes or n):
        for t in heads[i].tolist():
            met[owner[at[t] : at[t + 1]]] = True
        near = np.flatnonzero(met & may & (np.abs(part - part[i]) <= 1) & (root != root[i]))
        met[:] = False
        while len(near):
            y = int(near[0])
            need = -(-TOP * (sizes[i] + sizes[y]) // (TOP + BOTTOM))  # common / (size + other - common) >= TOP / BOTTOM
            near = near[1:]
            if common_count(paths[i], paths[y], need) >= 0:
                found.append((labels[i], labels[y]))
                root[root == root[y]] = root[i]
                near = near[root[near] != root[i]]
    return found


def _link(labels: list[int], sizes: list[int], blobs: list[bytes], probes: int = 0) -> list[tuple[int, int]]:
    return link_by_length(labels, sizes, [np.frombuffer(b, "<u4").astype(U64).tobytes() for b in blobs], probes)


def bitmap(s: np.ndarray) -> bytes:
    """For each place, whether an odd number of signatures falls there."""
    places = min(MOST_BITS, max(LEAST_BITS, 1 << (len(s) - 1).bit_length())) if len(s) else LEAST_BITS
    odd = np.bincount((s & U64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def fold(bits: int, length: int, to: int) -> int:
    """A bitmap of `length` places as one of `to`; both are powers of two."""
    while length > to:
        length //= 2
        bits = (bits >> length) ^ (bits & (1 << length) - 1)
    return bits


def may_link(sizes: list[int], bitmaps: list[bytes]) -> list[bool]:
    """Which sets may reach the threshold with another one, as far as sizes and bitmaps tell."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    bits = [int.from_bytes(b, "little") for b in bitmaps]
    may = [False] * len(sizes)
    for k, x in enumerate(order):
        n, length = sizes[x], len(bitmaps[x]) * 8
        for y in order[k + 1 :]:
            both = n + sizes[y]
            need = -(-TOP * both // (TOP + BOTTOM))
            if need > n:
                break
            if not (may[x] and may[y]) and (bits[x] ^ fold(bits[y], len(bitmaps[y]) * 8, length)).bit_count() <= both - 2 * need:
                may[x] = may[y] = True
    return may


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of blocks, those that may link with another one of their block, without size and bitmap."""
    held: pa.Table | None = None

    def chosen(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        block, sizes, bitmaps = rows["block"].to_numpy(), rows["size"].to_pylist(), rows["bits"].to_pylist()
        edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        keep: list[bool] = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            keep += may_link(sizes[a:b], bitmaps[a:b])
        yield from rows.filter(pa.array(keep, pa.bool_())).drop_columns(["size", "bits"]).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held else pa.Table.from_batches([batch])
        block = held["block"].to_numpy()
        if len(whole := np.flatnonzero(block != block[-1])):  # the last block may go on
            yield from chosen(held.slice(0, int(whole[-1]) + 1))
            held = held.slice(int(whole[-1]) + 1)
    if held:
        yield from chosen(held)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, n, s1, bits) of each document, and one row with the task's sketch."""
    counts = np.zeros(1 << SKETCH_BITS, U64)
    names = ["doc_id", "h", "n", "s1", "bits", "sketch"]
    for batch in batches:
        n, s1, bits = [], [], []
        for _, s in signature_sets(batch["text"]):
            n.append(len(s))
            s1.append(set_hashes(s)[0])
            bits.append(bitmap(s))
            np.add.at(counts, (s >> U64(32 - SKETCH_BITS)).astype(np.int64), U64(1))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(len(n), pa.binary())], names=names)
    one = [pa.nulls(1, pa.int64())] * 4
    yield pa.RecordBatch.from_arrays([*one, pa.nulls(1, pa.binary()), pa.array([_pack(counts)], pa.binary())], names=names)


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def _add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SKETCH_BITS, U64)
    for batch in batches:
        for one in batch["sketch"].to_pylist():
            total += np.frombuffer(zlib.decompress(one), U64)
    yield pa.RecordBatch.from_arrays([pa.array([_pack(total)], pa.binary())], names=["sketch"])


def _rarest(counts: np.ndarray):  # noqa: ANN202
    edges = length_edges(TOP / BOTTOM)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(label, token, part, head): of each set the first ones, of which a partner shares one, and its length
        partition; head is 1 for those of which a partner that isn't smaller shares one."""
        for batch in batches:
            labels, tokens, parts, heads = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.empty(0, np.int8)]
            for _, s in signature_sets(batch["text"]):
                if len(s):
                    room = len(s) - -(-TOP * len(s) // BOTTOM) + 1
                    first = s[np.lexsort((s, counts[(s >> U64(32 - SKETCH_BITS)).astype(np.int64)]))[:room]]
                    labels.append(np.full(room, set_hashes(s)[0], np.int64))
                    tokens.append(first.astype(np.uint32).view(np.int32))
                    parts.append(np.full(room, length_partition(len(s), TOP / BOTTOM, edges), np.int32))
                    heads.append((np.arange(room) <= len(s) - -(-2 * TOP * len(s) // (TOP + BOTTOM))).astype(np.int8))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (labels, tokens, parts, heads)], names=["label", "token", "part", "head"])

    return rarest


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the bits at the places `f`, or those of the rows' own bits, together."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        if "f" in batch.schema.names:
            bits[batch["f"].to_numpy()] = True
        else:
            for one in batch["bits"].to_pylist():
                bits |= np.unpackbits(np.frombuffer(zlib.decompress(one), np.uint8)).astype(bool)
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["bits"])


def _marked(df: DataFrame) -> np.ndarray:
    """A filter of the documents (doc_id, h) of df: FILTER_BITS bits, one of which each sets."""
    one = df.select(_place()).mapInArrow(_marks, "bits binary").repartition(1).mapInArrow(_marks, "bits binary").first()
    return np.frombuffer(zlib.decompress(one[0]), np.uint8) if one else np.zeros(1 << FILTER_BITS >> 3, np.uint8)


def _place() -> Column:
    return F.pmod(F.xxhash64("doc_id", "h"), F.lit(1 << FILTER_BITS)).cast("int").alias("f")


def _sets(marks: np.ndarray):  # noqa: ANN202
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of the documents that the filter lets through."""
        bits = np.unpackbits(marks).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch["f"].to_numpy()]))
            found = [(set_hashes(s)[0], len(s), s.astype("<u4").tobytes()) for _, s in signature_sets(batch["text"])]
            label, size, blob = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], pa.array(label, pa.int64()), pa.array(size, pa.int64()), pa.array(blob, pa.binary())], names=["doc_id", "h", "label", "size", "blob"])

    return sets


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc_id, h, text): a null id as the largest number, a null text empty; h tells texts of one id apart."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(id).cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(whole).alias("h"), whole.alias("text"))


def described_components(docs: DataFrame, *, id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """A written table (doc_id, h, n, component) for every row; doc_id and component may be LAST, for null."""
    keyed = _keyed(docs, id, text)
    all_ = materialize(keyed.mapInArrow(_describe, "doc_id long, h long, n long, s1 long, bits binary, sketch binary"))
    described = all_.where("sketch is null")
    rows = described.drop("sketch", "bits")
    sketches = all_.where("sketch is not null").select("sketch").mapInArrow(_add_sketches, "sketch binary")
    sketch = sketches.repartition(1).mapInArrow(_add_sketches, "sketch binary").first()  # one row of bounded size
    counts = np.frombuffer(zlib.decompress(sketch[0]), U64) if sketch else np.zeros(1 << SKETCH_BITS, U64)
    classes = materialize(described.where("n > 0").groupBy("s1").agg(F.min(F.struct("doc_id", "h", F.col("n").alias("size"), "bits")).alias("first")).select("s1", "first.*"))
    posted = keyed.select("text").mapInArrow(_rarest(counts), "label long, token int, part int, head tinyint")
    several = posted.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.max("head").alias("head")).where("least < most and head = 1").select("token")
    # the lists of each token are cut by length: a set is in the list of its own partition and, as a guest, of the next,
    # where it is smaller than all others
    own, guest = F.struct("part", F.lit(1).alias("own"), "head"), F.struct((F.col("part") + 1).alias("part"), F.lit(0).alias("own"), "head")
    shared = posted.join(several, "token").select("label", "token", F.explode(F.when(F.col("head") == 1, F.array(own, guest)).otherwise(F.array(own))).alias("at"))
    cut = materialize(shared.select("label", "token", "at.*").distinct())
    least = cut.groupBy("token", "part").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.max("own").alias("own"), F.max("head").alias("head")).where("least < most and own = 1 and head = 1")
    lists = cut.join(least.select("token", "part", "least"), ["token", "part"])
    named = lists.select("label", F.xxhash64("least", "part").alias("block")).distinct()
    counted = named.groupBy("block").agg(F.count("*").alias("n"))
    # a class's set comes from its first document; tables that meet the sets are written, so that their size is known
    dealt = materialize(named.join(counted, "block").join(classes.withColumnRenamed("s1", "label"), "label").select("label", "block", "n", "doc_id", "h", "size", "bits"))
    small = dealt.where(F.col("n") <= block).repartition("block").sortWithinPartitions("block")
    few = small.mapInArrow(_promising, "label long, block long, n long, doc_id long, h long")
    dealt = materialize(few.unionByName(dealt.where(F.col("n") > block).drop("size", "bits")))
    sets = keyed.withColumn("f", _place()).mapInArrow(_sets(_marked(dealt)), "doc_id long, h long, label long, size long, blob binary")
    placed = sets.join(dealt, ["label", "doc_id", "h"]).select("block", "n", "label", "size", "blob")
    links = placed.where(F.col("n") <= block).groupBy("block").applyInArrow(_link_block(_link), EDGE)
    if dealt.where(F.col("n") > block).limit(1).count():
        links = links.union(link_large_blocks(materialize(placed.where(F.col("n") > block)), block, _link))
    roots = connected_components(links).select(F.col("id").alias("s1"), "root")
    known = classes.join(roots, "s1").select("s1", "root", "doc_id")
    heads = known.join(known.groupBy("root").agg(F.min("doc_id").alias("component")), "root").select("s1", "component")
    named = materialize(classes.join(heads, "s1", "left").select("s1", F.coalesce("component", "doc_id").alias("component")))
    return materialize(rows.join(named, "s1", "left").select("doc_id", "h", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component")))


def _real(c: str) -> Column:
    return F.when(F.col(c) != LAST, F.col(c)).alias(c)


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_signatures, component_id) for every row: the least id reachable by links, its own included."""
    out = described_components(docs, id=id, text=text, block=block)
    return out.select(_real("doc_id"), F.col("n").alias("n_signatures"), _real("component").alias("component_id"))


# --- the documents in their order -----------------------------------------------------------------------------

#: Sort keys: range, whether the row only ends its range, descending id and text hash, and what the row is (0: a
#: document's component, 1: its text).
DEALT = "b int, extra boolean, i long, h long, kind int, z binary, n long, component long"


class Ranges:
    """Ranges of (id, text hash), descending, null ids last.

    Cuts are quantiles of ids. A quantile that several cuts agree on is an id of many rows: these are cut at equal
    steps of the hash.
    """

    def __init__(self, cuts: list[int]):
        self.cuts = np.array(sorted(cuts), np.int64)

    def of(self, i: np.ndarray, h: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.cuts, i, "left"), np.searchsorted(self.cuts, i, "right")
        share = (h.astype(np.float64) + 2.0**63) / 2.0**64
        within = np.minimum((share * (hi - lo + 1)).astype(np.int64), hi - lo)
        return (len(self.cuts) - (lo + within)).astype(np.int32)


def _order_id(ids: pa.Array) -> np.ndarray:
    """Ids as the order sees them: LAST, which stands for null, is the least."""
    i = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(i == LAST, -(2**63), i)


def _dealt(cols: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in DEALT.split(", ")])


def _deal_texts(ranges: Ranges, heads: dict[tuple[int, int], int]):  # noqa: ANN202
    """Each text, compressed, in its range; the first of a range also in the range before, to end it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(1)
        for batch in batches:
            i, h = _order_id(batch["doc_id"]), batch["h"].to_numpy()
            b = ranges.of(i, h).tolist()
            i, h = i.tolist(), h.tolist()
            z = [squeeze.compress(t.encode()) for t in batch["text"].to_pylist()]
            extra = [False] * len(b)
            for k in range(len(i)):
                if (target := heads.get((i[k], h[k]))) is not None:
                    for col, x in ((b, target), (extra, True), (i, i[k]), (h, h[k]), (z, z[k])):
                        col.append(x)
            yield _dealt([b, extra, i, h, [1] * len(b), z, [None] * len(b), [None] * len(b)])

    return deal


def _deal_components(ranges: Ranges):  # noqa: ANN202
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, m = _order_id(batch["doc_id"]), batch.num_rows
            yield _dealt([ranges.of(i, batch["h"].to_numpy()), [False] * m, i, batch["h"], [0] * m, [None] * m, batch["n"], batch["component"]])

    return deal


def _real_ids(ids: list[int], null: int) -> pa.Array:
    return pa.array([None if x == null else x for x in ids], pa.int64())


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of DEALT in order: each document with the next one, an extra row ending a range."""
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    held: list[tuple[int, bool, int, str, int, int]] = []  # range, extra, id, text, signatures, component

    def work(rows: list[tuple[int, bool, int, str, int, int]]) -> pa.RecordBatch:
        edited = []
        for r, after in zip(rows, rows[1:], strict=False):
            half = len(r[3]) // 2
            edited.append((r[3][: len(r[3]) - half] + after[3][:half]).encode())
        keys, edge = signatures([r[3].encode() for r in rows] + edited)
        part, m = [keys[edge[i] : edge[i + 1]] & U64(0xFFFFFFFF) for i in range(len(edge) - 1)], len(rows)
        use = [i for i in range(m - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        cols = [
            _real_ids([rows[i][2] for i in use], -(2**63)), pa.array([len(rows[i][3]) for i in use], pa.int64()), pa.array([hashlib.sha256(edited[i]).hexdigest() for i in use], pa.string()),
            pa.array([fingerprint(part[i]) for i in use], pa.string()), pa.array([fingerprint(part[m + i]) for i in use], pa.string()),
            pa.array([jaccard(part[i], part[m + i]) for i in use], pa.float64()), pa.array([jaccard(part[i], part[i + 1]) for i in use], pa.float64()),
            pa.array([rows[i][4] for i in use], pa.int64()), _real_ids([rows[i][5] for i in use], LAST),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in OUT.split(", ")])

    size, info = 0, (0, LAST)
    for batch in batches:
        for b, extra, i, kind, z, n, component in zip(*[batch[c].to_pylist() for c in ("b", "extra", "i", "kind", "z", "n", "component")], strict=True):
            if kind == 0:
                info = (n, component)
                continue
            held.append((b, extra, i, open_.decompress(z).decode(), *info))
            size += len(held[-1][3])
            if size > 400_000 and len(held) > 1:
                yield work(held)
                held, size = held[-1:], len(held[-1][3])
    if len(held) > 1:
        yield work(held)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long, component_id long"


def fingerprint_in_order(docs: DataFrame, *, id: str = "doc_id", text: str = "text", block: int = BLOCK, max_ranges: int = MAX_RANGES) -> DataFrame:
    """Each document's fingerprint, that of its edited text, its likeness to that and to the next document, and the
    component of near duplicates that it belongs to.

    Ids are cut into ranges by quantiles, about one a group of bytes and at most `max_ranges`, as a range is read in
    order and never held; their cuts and first documents (`max_ranges` numbers each) go with the tasks. What follows
    the last document of a range is the first of the next one, which is sent to both.
    """
    spark = docs.sparkSession
    known = described_components(docs, id=id, text=text, block=block)
    n = min(group_count(total_bytes(docs, text), 8 << 20), max_ranges)
    place = F.when(F.col("doc_id") == LAST, F.lit(-(2**63))).otherwise(F.col("doc_id"))
    cuts = known.agg(F.percentile_approx(place, [i / n for i in range(1, n)], 4 * max_ranges).alias("c")).first()["c"]
    if not cuts:
        return spark.createDataFrame([], OUT)
    ranges = Ranges([int(c) for c in cuts])
    infos = known.mapInArrow(_deal_components(ranges), DEALT)
    firsts = {r["b"]: (r["m"]["i"], r["m"]["h"]) for r in infos.groupBy("b").agg(F.max(F.struct("i", "h")).alias("m")).collect()}  # a row a range
    present = sorted(firsts)
    heads = {firsts[b]: present[k - 1] for k, b in enumerate(present)}  # the first of all ends the last range
    texts = _keyed(docs, id, text).mapInArrow(_deal_texts(ranges, heads), DEALT)
    dealt = texts.unionByName(infos.distinct()).repartition(len(present) + 1, "b").sortWithinPartitions("b", "extra", F.col("i").desc(), F.col("h").desc(), "kind")
    return dealt.drop("h").mapInArrow(_compare, OUT)


def op2_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fingerprint_in_order(docs)
