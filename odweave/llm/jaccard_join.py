"""Exact Jaccard join of word n-gram sets with a prefix tree.

1. Documents with equal sets are one class (a hash of the set, an aggregation); only classes go on.
2. Classes learn how many of them hold each of their shingles (exchange, see common). With shingles in the order
   of that number, rarest first, two sets at the threshold share one among the first |x| - ceil(t |x|) + 1 of
   each. A set whose first ones are all its own has no partner; that leaves copies and near copies.
3. The classes that hold such a shingle among their first ones are its posting list. A block is all lists with one
   least class, found by a partial aggregation; each class goes, once, to the blocks of its first shingles, but for
   blocks that lie within another. Any two sets at the threshold so meet in a block, and nothing is closed transitively before it is verified: text made of
   shared passages gives many small blocks, not one that chains them all.
4. In a block, sets go into a prefix tree in one order, commonest shingle first, so that like sets share long
   paths. A set walks down the tree once, carrying the overlap of the path, and leaves a subtree when the
   overlap that remains possible is too small for any size below, or when all below is already linked to it.
5. Blocks of more than BLOCK classes are cut into chunks. Chunks are joined by themselves, then one class for
   each component of each chunk among themselves, which unites what hangs together in bulk; the classes
   outside the block's largest component are then joined with every chunk. So a group of copies with a third
   of all documents is not in one task, and no link between components is missed.
6. Components are those of the verified links.

Contract: A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+`; fewer than n words are one shingle, none (or null
text) give an empty set, which links with nothing. Rows of one id count as linked. A null id counts as largest.
Extra columns don't pass; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.llm.common import LOWER, PAYLOAD_DDL, U64, Hasher, bucket_bits, exchange, group_count, group_of, grouped, look_up, materialize, mix, payloads, received, send_keys, sequences, steps, tally, total_bytes, words
from odweave.llm.graphs import connected_components

N = 5
#: The threshold as a fraction: 80 / 100.
TOP, BOTTOM = 4, 5
BLOCK = 1000
LAST = 2**63 - 1
_HASHER = Hasher(61)
#: (index, sorted distinct 64-bit hashes) of each text of a column
Sets = Callable[[pa.ChunkedArray | pa.Array], Iterator[tuple[int, np.ndarray]]]
#: pairs of labels to unite, of (labels, sizes, blobs, probes); see link_sets
Link = Callable[..., list[tuple[int, int]]]


def shingle_sets(texts: pa.ChunkedArray | pa.Array, n: int = N) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of each text."""
    for i, data, offsets in steps(texts):
        low = LOWER[data]
        starts, ends, first = words(low, offsets)
        h = _HASHER.spans(_HASHER.prefix(low), starts, ends) if len(starts) else np.empty(0, U64)
        seq = sequences(h, n)
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if b - a >= n:
                yield i + k, np.unique(seq[a : b - n + 1])
            elif b > a:
                yield i + k, sequences(h[a:b], b - a, 100 + b - a)
            else:
                yield i + k, np.empty(0, U64)


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    a = int(mix(s * U64(0x9E3779B97F4A7C15) + U64(1)).sum(dtype=U64))
    b = int(mix((s ^ U64(0x5851F42D4C957F2D)) * U64(0xD1342543DE82EF95)).sum(dtype=U64)) + len(s)
    return (a & (2**64 - 1)) - 2**63, (b & (2**64 - 1)) - 2**63


def _describe(sets: Sets):  # noqa: ANN202
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), *set_hashes(s)) for _, s in sets(batch["text"])]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], *[pa.array(list(c), pa.int64()) for c in cols]], names=["doc_id", "h", "n_shingles", "s1", "s2"])

    return describe


class Members:
    """Of a group's texts, those that stand for a class: (class id, set)."""

    def __init__(self, table: pa.Table, answers: pa.Table, sets: Sets):
        bucket = np.array(answers["bucket"].to_pylist(), np.int64)
        named = answers.filter(pa.array(bucket < 0))["payload"].to_pylist()
        wanted = {(int.from_bytes(p[:8], "little", signed=True), int.from_bytes(p[8:16], "little", signed=True)) for p in named}
        self.answers = answers.filter(pa.array(bucket >= 0))
        ids, seen = table["doc_id"].to_pylist(), set()
        self.sets: list[tuple[int, np.ndarray]] = []
        for i, s in sets(table["text"]):
            key = (ids[i], set_hashes(s)[0])
            if len(s) and key in wanted and key not in seen:
                seen.add(key)
                self.sets.append((ids[i], s))


def _send_shingles(bits: int, sets: Sets):  # noqa: ANN202
    def send(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        m = Members(table, answers, sets)
        if not m.sets:
            return payloads([])
        return send_keys(key[0].as_py(), *tally(np.concatenate([s for _, s in m.sets])), bits)

    return send


CANDIDATE = "label long, size long, blob binary, head array<bigint>"


def _candidates(bits: int, sets: Sets):  # noqa: ANN202
    """(class, size, shingles that others hold, the rarest of these that a partner must share one of)."""

    def candidates(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        m = Members(table, answers, sets)
        keys, counts = received(m.answers, bits)
        labels, sizes, blobs, heads = [], [], [], []
        for cid, s in m.sets:
            df = look_up(s, keys, counts, bits)
            shared = df > 1
            prefix = len(s) - -(-TOP * len(s) // BOTTOM) + 1
            room = prefix - int((~shared).sum())
            if room > 0:
                t, n = s[shared], df[shared]
                labels.append(cid)
                sizes.append(len(s))
                blobs.append(t.tobytes())
                heads.append(t[np.lexsort((t, n))[:room]].view(np.int64))
        return pa.table({"label": pa.array(labels, pa.int64()), "size": pa.array(sizes, pa.int64()), "blob": pa.array(blobs, pa.binary()), "head": pa.array(heads, pa.list_(pa.int64()))})

    return candidates


# --- the prefix tree ------------------------------------------------------------------------------------------


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        root = x
        while self.up[root] != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


class Node:
    __slots__ = ("edge", "next", "ends", "least", "most", "longest", "one")

    def __init__(self, edge: np.ndarray, size: int, length: int, one: int):
        self.edge, self.next, self.ends = edge, {}, []
        self.least = self.most = size
        self.longest = length
        self.one = one  # a member, if all below are of one component; -1 if they may not be


class PrefixTree:
    """Sets as paths of ascending ranks; `size` is a set's full size, its path only what others may share."""

    def __init__(self, union: Union, n_ranks: int):
        self.root = Node(np.empty(0, np.int32), 1 << 60, 0, -1)
        self.root.most = 0
        self.union, self.flags = union, np.zeros(n_ranks + 1, bool)

    def add(self, x: int, path: np.ndarray, size: int) -> None:
        node, at = self.root, 0
        first = node.least > node.most
        self._note(node, x, size, len(path), first)
        while at < len(path):
            child = node.next.get(int(path[at]))
            if child is None:
                child = Node(path[at:], size, len(path), x)
                node.next[int(path[at])] = child
                child.ends.append((x, size))
                return
            m = min(len(child.edge), len(path) - at)
            differ = np.flatnonzero(child.edge[:m] != path[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.edge):
                upper = Node(child.edge[:same], child.least, child.longest, child.one)
                upper.most = child.most
                child.edge = child.edge[same:]
                upper.next[int(child.edge[0])] = child
                node.next[int(path[at])] = upper
                child = upper
            self._note(child, x, size, len(path), False)
            node, at = child, at + same
        node.ends.append((x, size))

    def _note(self, node: Node, x: int, size: int, length: int, first: bool) -> None:
        node.least, node.most, node.longest = min(node.least, size), max(node.most, size), max(node.longest, length)
        if first:
            node.one = x
        elif node.one >= 0 and self.union.find(node.one) != self.union.find(x):
            node.one = -1

    def link(self, x: int, path: np.ndarray, size: int) -> Iterator[int]:
        """Joins x with every set that reaches the threshold, unless they hang together already."""
        find, flags = self.union.find, self.flags
        flags[path] = True
        own = find(x)
        stack = [(c, 0, 0) for c in self.root.next.values()] + [(self.root, -1, 0)] * bool(self.root.ends)
        while stack:
            node, overlap, depth = stack.pop()
            if node.one >= 0 and find(node.one) == own:
                continue
            if BOTTOM * node.most < TOP * size or TOP * node.least > BOTTOM * size:
                continue
            if overlap < 0:
                continue  # an empty path shares nothing
            overlap += int(np.count_nonzero(flags[node.edge]))
            depth += len(node.edge)
            rest = min(len(path) - int(np.searchsorted(path, node.edge[-1], "right")), node.longest - depth)
            # overlap / (size + other - overlap) >= TOP / BOTTOM
            if (TOP + BOTTOM) * (overlap + rest) < TOP * (size + node.least):
                continue
            for y, other in node.ends:
                if find(y) != own and (TOP + BOTTOM) * overlap >= TOP * (size + other):
                    self.union.join(x, y)
                    own = find(x)
                    yield y
            if node.one < 0 and not node.ends:
                ones = {find(c.one) if c.one >= 0 else -1 for c in node.next.values()}
                if len(ones) == 1 and -1 not in ones:
                    node.one = next(iter(node.next.values())).one
            stack += [(c, overlap, depth) for c in node.next.values()]
        flags[path] = False


def ranked(blobs: list[bytes]) -> tuple[list[np.ndarray], int]:
    """Each set as ascending ranks, commonest shingle first; those of one set alone are left out."""
    sets = [np.frombuffer(b, U64) for b in blobs]
    every = np.concatenate(sets) if sets else np.empty(0, U64)
    token, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
    order = np.lexsort((token, -count))
    order = order[count[order] > 1]
    rank = np.full(len(token), -1, np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    r, at, out = rank[inverse], 0, []
    for s in sets:
        own = r[at : at + len(s)]
        out.append(np.sort(own[own >= 0]))
        at += len(s)
    return out, len(order)


def link_sets(labels: list[int], sizes: list[int], blobs: list[bytes], probes: int = 0) -> list[tuple[int, int]]:
    """Pairs of labels to unite. Sets with one label hang together. The first `probes` sets meet the rest only
    (and not each other), if that number isn't 0."""
    paths, n_ranks = ranked(blobs)
    n = len(labels)
    union = Union(n)
    first: dict[int, int] = {}
    for i, x in enumerate(labels):
        union.join(i, first.setdefault(x, i))
    tree, found = PrefixTree(union, n_ranks), []
    by_size = lambda r: sorted(r, key=lambda i: (sizes[i], i))
    if probes:
        for i in by_size(range(probes, n)):
            tree.add(i, paths[i], sizes[i])
        for i in by_size(range(probes)):
            found += [(labels[i], labels[y]) for y in tree.link(i, paths[i], sizes[i])]
        return found
    for i in by_size(range(n)):
        found += [(labels[i], labels[y]) for y in tree.link(i, paths[i], sizes[i])]
        tree.add(i, paths[i], sizes[i])
    return found


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _link_block(link: Link):  # noqa: ANN202
    def within(table: pa.Table) -> pa.Table:
        return _pairs(link(table["label"].to_pylist(), table["size"].to_pylist(), table["blob"].to_pylist()))

    return within


def _link_across(link: Link):  # noqa: ANN202
    def across(table: pa.Table) -> pa.Table:
        table = table.sort_by([("probe", "descending")])
        n = sum(table["probe"].to_pylist())
        if n in (0, table.num_rows):
            return _pairs([])
        return _pairs(link(table["label"].to_pylist(), table["size"].to_pylist(), table["blob"].to_pylist(), n))

    return across


EDGE = "a long, b long"


def without_nested(dealt: DataFrame) -> DataFrame:
    """(label, block, n): blocks of two and more, but for those whose members all are in the first block of the class
    that names them, which then links them. dealt: (label, block), a written table; a block is named by its least label."""
    counted = dealt.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
    first = dealt.groupBy(F.col("label").alias("block")).agg(F.min("block").alias("outer")).where("outer < block")
    inside = dealt.join(first, "block").join(dealt.select("label", F.col("block").alias("outer")), ["label", "outer"], "left_semi")
    nested = inside.groupBy("block").agg(F.count("*").alias("n"))
    return dealt.join(materialize(counted.join(nested, ["block", "n"], "left_anti")), "block")


def _relabel(sets: DataFrame, links: DataFrame) -> DataFrame:
    roots = connected_components(links).withColumnRenamed("id", "label")
    return sets.join(roots, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")


def link_large_blocks(sets: DataFrame, block: int = BLOCK, link: Link = link_sets) -> DataFrame:
    """Links (a, b) in blocks of more than `block` sets; sets: (block, n, label, size, blob), a label once a block."""
    chunked = sets.withColumn("chunk", F.expr(f"pmod(xxhash64(label), cast(ceil(n / {block}) as int))").cast("int"))
    within = materialize(chunked.groupBy("block", "chunk").applyInArrow(_link_block(link), EDGE))
    one = materialize(_relabel(chunked.withColumn("cid", F.col("label")), within))
    # one set for each component of each chunk; those of a block are again dealt to tasks of bounded size
    heads = one.join(one.groupBy("block", "chunk", "label").agg(F.min("cid").alias("cid")), ["block", "chunk", "label", "cid"], "left_semi")
    counted = heads.join(heads.groupBy("block").agg(F.count("*").alias("m")), "block")
    dealt = counted.withColumn("part", F.expr(f"pmod(xxhash64(cid, 3), cast(ceil(m / {block}) as int))").cast("int"))
    among = materialize(dealt.groupBy("block", "part").applyInArrow(_link_block(link), EDGE))
    two = materialize(_relabel(one, among))
    by_label = two.groupBy("block", "label").count()
    largest = by_label.groupBy("block").agg(F.max_by("label", F.struct("count", "label")).alias("bulk"))
    marked = two.join(largest, "block").withColumn("outside", F.col("label") != F.col("bulk"))
    others = marked.where("outside").groupBy("block").agg(F.count("*").alias("q"))
    sized = marked.join(others, "block").withColumns({"chunks": F.expr(f"cast(ceil(n / {block}) as int)"), "slices": F.expr(f"cast(ceil(q / {block}) as int)")})
    members = sized.withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)"))).withColumn("probe", F.lit(0))
    probes = sized.where("outside").withColumn("slice", F.expr("pmod(xxhash64(cid, 5), slices)").cast("int")).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).withColumn("probe", F.lit(1))
    cols = ["block", "chunk", "slice", "probe", "label", "size", "blob"]
    across = members.select(*cols).unionByName(probes.select(*cols)).groupBy("block", "chunk", "slice").applyInArrow(_link_across(link), EDGE)
    return within.union(among).union(materialize(across))


def jaccard_components(docs: DataFrame, *, id: str = "doc_id", text: str = "text", n: int = N, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    return set_components(docs, partial(shingle_sets, n=n), link_sets, id=id, text=text, block=block)


def set_components(docs: DataFrame, sets: Sets, link: Link, *, id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The same for any sets of hashes, with any way to link those of a block."""
    groups = group_count(total_bytes(docs, text))
    bits = bucket_bits(groups)
    whole = F.coalesce(F.col(text), F.lit(""))
    known = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(whole).alias("h"), whole.alias("text"))
    rows = materialize(known.mapInArrow(_describe(sets), "doc_id long, h long, n_shingles long, s1 long, s2 long"))
    # a plain table to join with, so that a class of very many documents can be split
    classes = materialize(rows.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "h")).alias("first")).select("s1", "s2", F.col("first.doc_id").alias("cid"), "first.h"))
    base = grouped(known, groups)
    packed = F.concat(*[_little(c) for c in ("cid", "s1")])
    named = classes.select(F.lit(-1).alias("bucket"), group_of(F.col("cid"), F.col("h"), groups).alias("g"), packed.alias("payload"))
    answers = exchange(base.groupBy("g").cogroup(named.groupBy("g")).applyInArrow(_send_shingles(bits, sets), PAYLOAD_DDL))
    found = materialize(base.groupBy("g").cogroup(named.unionByName(answers).groupBy("g")).applyInArrow(_candidates(bits, sets), CANDIDATE))
    posted = found.select("label", F.explode("head").alias("token"))
    least = posted.groupBy("token").agg(F.min("label").alias("block"), F.count("*").alias("k")).where("k > 1").drop("k")
    # written, so that what meets each other next is of known size and a block of very many classes can be split
    dealt = materialize(without_nested(materialize(posted.join(least, "token").select("label", "block").distinct())))
    placed = found.drop("head").join(dealt, "label").select("block", "n", "label", "size", "blob")
    links = placed.where(F.col("n") <= block).groupBy("block").applyInArrow(_link_block(link), EDGE)
    if dealt.where(F.col("n") > block).limit(1).count():
        links = links.union(link_large_blocks(materialize(placed.where(F.col("n") > block)), block, link))
    # rows of one id are one document, whatever their sets
    same = rows.drop("h").where("n_shingles > 0").join(classes.drop("h"), ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("cid").alias("b"))
    twice = rows.where("n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    extra = same.join(twice.withColumnRenamed("doc_id", "a"), "a", "left_semi").where("a <> b")
    roots = connected_components(links.union(extra)).select(F.col("id").alias("cid"), "root")
    out = rows.drop("h").join(classes.drop("h"), ["s1", "s2"], "left").join(roots, "cid", "left")
    real = lambda c: F.when(c != LAST, c)
    return out.select(real(F.col("doc_id")).alias("doc_id"), "n_shingles", real(F.when(F.col("n_shingles") > 0, F.coalesce("root", "cid", "doc_id")).otherwise(F.col("doc_id"))).alias("component_id"))


def _little(c: str) -> F.Column:
    """A long as eight bytes, least first."""
    return F.concat(*[F.unhex(F.substring(F.lpad(F.hex(F.col(c)), 16, "0"), 15 - 2 * i, 2)) for i in range(8)])


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
