"""Suffix arrays by linear grouping, and exact deduplication of long byte strings with them.

`suffix_array` sorts the suffixes of a sequence of integers. Suffixes start in groups by first symbol. Groups are
taken in descending order; each member points to the nearest earlier suffix of a smaller group, and suffixes
pointed to are split off their groups, the more often pointed to the higher. In the end a group holds the
suffixes with the same longest Lyndon prefix, and one ascending sweep emits the order inside every group along
the same pointers. Nothing is renamed or sorted recursively.

Deduplication removes every byte that a string of `min_len` bytes covers which also starts elsewhere. A corpus has
no one suffix array, so the strings that could be equal are brought together first:

1. Each string of min_len bytes has an anchor, the least hash among its substrings of ANCHOR bytes (the leftmost if
   tied), and a core: the bytes common to all strings whose anchor lies as far from their start, by classes
   of distance. Equal strings have equal cores. Groups of documents send the hashes of their cores; buckets answer
   which occur twice (see common).
2. For each core that does, a group sends a segment: the 128-bit hash of the core and the few bytes on either side
   that its strings reach. Equal segments of a group are one. A bucket sorts the segments of each core by what
   follows the core, by one suffix array over all of them: strings that reach as far right with the same bytes are
   then neighbours, and of those the ones with the same bytes on the left are equal.
   A core that occurs more than HOT times, such as one at the edge of a passage that very many documents share, is
   no bucket's work: of its strings each group sends distinct 96-bit hashes, which are dealt by their own value.
3. Groups get back a bit for each string start and cut their documents.

Contract: texts are UTF-8 bytes, null texts empty. Strings never cross documents. Repeated rows are documents.
Documents shorter than min_len keep all bytes. Extra columns don't pass; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.llm.common import PAYLOAD_DDL, U64, Hasher, bucket_bits, covered, exchange, group_count, grouped, look_up, mix, payloads, received, send_keys, steps, tally, total_bytes

MIN_LEN, ANCHOR = 200, 100
PLACE_BITS = 24
#: Distances in a class; the string starts of a segment fit a 64-bit mask.
WIDTH = 34
#: Symbols that one suffix array is built over at most, unless one core has more.
BATCH_SYMBOLS = 30_000
#: Occurrences of a core beyond which its strings are dealt one by one.
HOT = 50_000
_HASHER, _SECOND = Hasher(53), Hasher(59)
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of text in lexicographic order, a proper prefix first."""
    n = len(text)
    if n < 2:
        return list(range(n))
    # an end symbol below all others, at place n
    order = sorted(range(n), key=text.__getitem__)
    sa = [n, *order]
    where, group, size = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    size[0], start, last = 1, 0, None
    for i in range(1, n + 1):
        s = sa[i]
        where[s] = i
        if text[s] != last:
            start, last = i, text[s]
        group[s] = start
        size[start] += 1
    prev = [-2] * (n + 1)  # -1: no earlier suffix is smaller
    i = n
    while i >= 0:
        g = group[sa[i]]
        members = sa[g : i + 1]
        i = g - 1
        if len(members) == 1:
            j = members[0] - 1
            while j >= 0 and group[j] > g:
                j = prev[j]
            prev[members[0]] = j
            if j >= 0:
                h = group[j]
                if size[h] > 1:
                    size[h] -= 1
                    end = h + size[h]
                    at, other = where[j], sa[end]
                    sa[end], sa[at], where[j], where[other] = j, other, end, at
                    group[j] = end
                    size[end] = 1
            continue
        pointed: dict[int, int] = {}
        for s in members:
            chain, j = [s], s - 1
            while True:
                while j >= 0 and group[j] > g:
                    j = prev[j]
                if j < 0 or group[j] < g:
                    break
                if prev[j] != -2:  # a member whose pointer is known
                    j = prev[j]
                    break
                chain.append(j)
                j -= 1
            for x in chain:
                if prev[x] == -2:
                    prev[x] = j
                    if j >= 0:
                        pointed[j] = pointed.get(j, 0) + 1
        by_times: dict[int, dict[int, list[int]]] = {}
        for p, times in pointed.items():
            by_times.setdefault(times, {}).setdefault(group[p], []).append(p)
        for times in sorted(by_times, reverse=True):
            # groups as they are now: an earlier round may have shortened them, never moved their start
            for h, out in by_times[times].items():
                if len(out) == size[h]:
                    continue
                end = h + size[h]
                for p in out:
                    end -= 1
                    at, other = where[p], sa[end]
                    sa[end], sa[at], where[p], where[other] = p, other, end, at
                for p in out:
                    group[p] = end
                size[h] -= len(out)
                size[end] = len(out)
    free = list(range(n + 1))  # the next free place of each group, by its start
    placed = [False] * (n + 1)
    out = [0] * (n + 1)
    out[0], placed[n] = n, True
    for k in range(n + 1):
        s = out[k] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = prev[s]
    return out[1:]


# --- strings, anchors, cores ----------------------------------------------------------------------------------


def classes(min_len: int, anchor: int) -> list[tuple[int, int]]:
    """Ranges of at most WIDTH distances from a string's start to its anchor."""
    far = min_len - anchor
    n = -(-(far + 1) // WIDTH)
    cuts = [round(i * (far + 1) / n) for i in range(n + 1)]
    return [(x, y - 1) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def pieces(data: np.ndarray, offsets: np.ndarray, min_len: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(anchor place, class, first start, last start, core hash) of runs of strings; none crosses a document."""
    n, none = len(data), np.empty(0, np.int64)
    if n < min_len:
        return none, none, none, none, np.empty(0, U64)
    prefix = _HASHER.prefix(data)
    at = np.arange(n - anchor + 1)
    key = _HASHER.spans(prefix, at, at + anchor)
    mask = U64((1 << PLACE_BITS) - 1)
    key = (key & ~mask) | at.astype(U64)
    span, width = min_len - anchor + 1, 1
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    place = (key & mask).astype(np.int64)  # of the anchor of the string that starts here
    start = np.arange(len(place))
    doc_end = np.repeat(offsets[1:], np.diff(offsets))[: len(place)]
    ok = start + min_len <= doc_end
    bounds = classes(min_len, anchor)
    kind = np.digitize(place - start, [b[0] for b in bounds[1:]])
    label = place * len(bounds) + kind
    start, label = start[ok], label[ok]
    if not len(start):
        return none, none, none, none, np.empty(0, U64)
    new = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (start[1:] != start[:-1] + 1))))
    lo, hi = start[new], start[np.append(new[1:], len(start)) - 1]
    place, kind = label[new] // len(bounds), label[new] % len(bounds)
    near, far = np.array([b[0] for b in bounds])[kind], np.array([b[1] for b in bounds])[kind]
    core = mix(_HASHER.spans(prefix, place - near, place - far + min_len) + kind.astype(U64))
    return place, kind, lo, hi, core


def split_steps(texts: pa.ChunkedArray, min_len: int):  # noqa: ANN201
    """steps(), with documents beyond the anchors' place bits cut into overlapping parts; each string lies whole in exactly one."""
    limit = 1 << (PLACE_BITS - 1)
    for i, data, offsets in steps(texts):
        if len(data) <= limit:
            yield i, data, offsets, 0
        else:
            for k in range(0, max(1, len(data) - min_len + 1), limit - min_len + 1):
                part = data[k : k + limit]
                yield i, part, np.array([0, len(part)]), k


def _in_order(table: pa.Table) -> pa.Table:
    """A group's documents in an order that depends on them alone."""
    return table.append_column("__h", pa.array([hashlib.md5(t.encode()).digest() for t in table["text"].to_pylist()], pa.binary())).sort_by([("doc_id", "ascending"), ("__h", "ascending")])


def _send_cores(bits: int, min_len: int, anchor: int):  # noqa: ANN202
    def send(table: pa.Table) -> pa.Table:
        found = [pieces(data, offsets, min_len, anchor)[4] for _, data, offsets, _ in split_steps(table["text"], min_len)]
        once, more, counts = tally(np.concatenate(found))
        return send_keys(table["g"][0].as_py(), once, more, counts, bits)

    return send


class Segments:
    """A group's distinct segments of repeated cores, the same in each pass.

    A segment is a record: two core hashes, the numbers of bytes on the left and right, the class, the left bytes
    from the core outward, the right bytes.
    """

    def __init__(self, table: pa.Table, answers: pa.Table, bits: int, min_len: int, anchor: int, most: int):
        self.table = _in_order(table)
        keys, counts = received(answers, bits)
        bounds = classes(min_len, anchor)
        near, far = np.array([b[0] for b in bounds]), np.array([b[1] for b in bounds])
        self.width = int((far - near).max())
        self.places: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        singles: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # strings of hot cores
        records: dict[bytes, int] = {}
        times: list[int] = []
        for i, data, offsets, base in split_steps(self.table["text"], min_len):
            place, kind, lo, hi, core = pieces(data, offsets, min_len, anchor)
            times_ = look_up(core, keys, counts, bits) if len(keys) and len(core) else np.ones(len(core), np.int64)
            if (very := np.flatnonzero(times_ > most)).size:
                size = hi[very] - lo[very] + 1
                at = np.repeat(lo[very] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                second = _SECOND.spans(_SECOND.prefix(data), at, at + min_len) >> U64(32)
                singles.append((i, at + base, _HASHER.spans(_HASHER.prefix(data), at, at + min_len), second.astype(np.uint32)))
            hot = np.flatnonzero((times_ > 1) & (times_ <= most))
            if not len(hot):
                continue
            place, kind, lo, hi, core = place[hot], kind[hot], lo[hot], hi[hot], core[hot]
            start, end = place - near[kind], place - far[kind] + min_len
            second = mix(_SECOND.spans(_SECOND.prefix(data), start, end) + kind.astype(U64))
            raw, index = data.tobytes(), np.empty(len(hot), np.int64)
            heads = np.empty((len(hot), 19), np.uint8)
            heads[:, :8], heads[:, 8:16] = core.view(np.uint8).reshape(-1, 8), second.view(np.uint8).reshape(-1, 8)
            heads[:, 16], heads[:, 17], heads[:, 18] = start - lo, hi + min_len - end, kind
            head = heads.tobytes()
            for k, (x, s, e, y) in enumerate(zip(lo.tolist(), start.tolist(), end.tolist(), (hi + min_len).tolist(), strict=True)):
                rec = head[19 * k : 19 * k + 19] + raw[x:s][::-1] + raw[e:y]
                number = records.setdefault(rec, len(times))
                if number == len(times):
                    times.append(1)
                else:
                    times[number] += 1
                index[k] = number
            self.places.append((i, base, lo, hi, start, index))
        self.records, self.times = list(records), times
        first = np.array([int.from_bytes(r[:8], "little") for r in self.records], U64)
        self.order = np.argsort(first, kind="stable")
        edges = np.arange(1 << bits, dtype=U64) << U64(64 - bits)
        self.edges = np.append(np.searchsorted(first[self.order], edges), len(first))
        # strings of hot cores: (text, start, number of its hash) and distinct hashes with how often they are here
        h, s = (np.concatenate([x[k] for x in singles]) if singles else np.empty(0, t) for k, t in ((2, U64), (3, np.uint32)))
        by = np.lexsort((s, h))
        new = np.concatenate(([True], (h[by][1:] != h[by][:-1]) | (s[by][1:] != s[by][:-1]))) if len(h) else np.empty(0, bool)
        number = np.empty(len(h), np.int64)
        number[by] = np.cumsum(new) - 1
        cuts = np.cumsum([0] + [len(x[1]) for x in singles])
        self.singles = [(x[0], x[1], number[a:b]) for x, a, b in zip(singles, cuts[:-1], cuts[1:], strict=True)]
        self.h, self.s, self.held = h[by][new], s[by][new], np.bincount(number) if len(number) else number
        self.h_edges = np.append(np.searchsorted(self.h, edges), len(self.h))


def _send_segments(bits: int, min_len: int, anchor: int, most: int):  # noqa: ANN202
    def send(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return payloads([])
        import zstandard

        squeeze = zstandard.ZstdCompressor(1)
        s = Segments(table, answers, bits, min_len, anchor, most)
        g, rows = key[0].as_py(), []
        for b in range(1 << bits):
            own = s.order[s.edges[b] : s.edges[b + 1]].tolist()
            if own:
                # heads and bytes apart, as they compress unlike
                head = b"".join(s.records[i][:19] + bytes((s.times[i] > 1,)) for i in own)
                rows.append((b, g, len(own).to_bytes(4, "little") + squeeze.compress(head + b"".join(s.records[i][19:] for i in own))))
            x, y = s.h_edges[b], s.h_edges[b + 1]
            if y > x:
                rows.append((b + (1 << bits), g, s.h[x:y].tobytes() + s.s[x:y].tobytes() + (s.held[x:y] > 1).astype(np.uint8).tobytes()))
        return payloads(rows)

    return send


def _right_order(core: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of segments by core and then right bytes: a suffix array over all segments of each batch.

    A segment's symbols are its core, blocks of seven bytes with the number of bytes in the block (so that a
    shorter one comes first), and a separator. The suffixes at the cores give the order.
    """
    n = len(core)
    out, at = [], 0
    blocks = -(-size // 7)
    upto = np.cumsum(blocks + 2)
    padded = np.zeros((n, -(-max(1, right.shape[1]) // 7) * 7), U64)
    padded[:, : right.shape[1]] = right
    cube = padded.reshape(n, -1, 7)
    value = np.zeros(cube.shape[:2], U64)
    for j in range(7):
        value = value << U64(8) | cube[:, :, j]
    held = np.clip(size[:, None] - 7 * np.arange(cube.shape[1])[None, :], 0, 7)
    value = value << U64(4) | held.astype(U64)
    while at < n:
        stop = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH_SYMBOLS, "right"))
        stop = max(stop, at + 1)
        while stop < n and core[stop] == core[stop - 1]:  # a core stays whole
            stop += 1
        m = stop - at
        if m == 1:
            out.append(np.array([at]))
        else:
            used = np.arange(cube.shape[1])[None, :] < blocks[at:stop, None]
            _, rank = np.unique(value[at:stop][used], return_inverse=True)
            base = int(core[stop - 1]) - int(core[at]) + 2
            symbols = np.zeros((m, cube.shape[1] + 2), np.int64)
            symbols[:, 0] = core[at:stop] - core[at] + 1
            symbols[:, 1:-1][used] = rank + base
            keep = np.ones(symbols.shape, bool)
            keep[:, 1:-1] = used
            text = symbols[keep]
            starts = np.concatenate(([0], np.cumsum(keep.sum(1))[:-1]))
            owner = np.full(len(text), -1)
            owner[starts] = np.arange(m)
            sa = owner[np.array(suffix_array(text.tolist()))]
            out.append(sa[sa >= 0] + at)
        at = stop
    return np.concatenate(out) if out else np.empty(0, np.int64)


def equal_strings(core: np.ndarray, reach: np.ndarray, lefts: np.ndarray, left: np.ndarray, rights: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For segments sorted by core, a mask of the lefts t whose string occurs in another segment too.

    The string that starts t bytes left of the core takes reach - t bytes to its right. In the order by right
    bytes, segments that share that many are neighbours; among those the left bytes decide.
    """
    order = _right_order(core, rights, right)
    k, r, size, span, l_bytes, l_size = core[order], rights[order], right[order], reach[order], lefts[order], left[order]
    m, width = len(order), rights.shape[1]
    shared = np.full(m, -1)
    differ = (r[1:] != r[:-1]) | (np.arange(width)[None, :] >= np.minimum(size[1:], size[:-1])[:, None])
    common = np.where(differ.any(1), differ.argmax(1), width) if width else np.zeros(m - 1, np.int64)
    shared[1:] = np.where(k[1:] == k[:-1], common, -1)
    mask, h = np.zeros(len(core), U64), np.zeros(m, U64)
    for t in range(lefts.shape[1] + 1):
        if t:
            h = mix(h * U64(0x9E3779B97F4A7C15) + l_bytes[:, t - 1].astype(U64) + U64(1))
        for total in np.unique(span).tolist():
            want = total - t
            use = np.flatnonzero((span == total) & (l_size >= t) & (size >= want)) if want >= 0 else []
            if not len(use):
                continue
            key = mix(h[use] + np.cumsum(shared < want)[use].astype(U64) * U64(0xD1342543DE82EF95))
            by = np.argsort(key)
            same = key[by][1:] == key[by][:-1]
            hit = np.zeros(len(use), bool)
            hit[by[1:][same]] = True
            hit[by[:-1][same]] = True
            mask[order[use[hit]]] |= U64(1) << U64(t)
    return mask


def equal_singles(table: pa.Table) -> pa.Table:
    """A bucket's answer on strings of hot cores: a bit for each of a group's, set if it occurs twice or more in all."""
    raw = table["payload"].to_pylist()
    n = [len(p) // 13 for p in raw]
    part = lambda kind, at: np.concatenate([np.frombuffer(p, kind, k, at * k) for p, k in zip(raw, n, strict=True)])
    h, s, more = part(U64, 0), part(np.uint32, 8), part(np.uint8, 12)
    by = np.lexsort((s, h))
    same = (h[by][1:] == h[by][:-1]) & (s[by][1:] == s[by][:-1])
    twice = more > 0
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    ends = np.cumsum([0, *n])
    return payloads([(b, g, np.packbits(twice[x:y]).tobytes()) for b, g, x, y in zip(table["bucket"].to_pylist(), table["g"].to_pylist(), ends[:-1], ends[1:], strict=True)])


def _find_equal(bits: int, min_len: int, anchor: int):  # noqa: ANN202
    """A bucket's answer: for each segment of a group the mask of its repeated strings."""
    reach_of = np.array([b[1] - b[0] for b in classes(min_len, anchor)])

    def find(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() >= 1 << bits:
            return equal_singles(table)
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        heads, tails = [], []
        for p in table["payload"].to_pylist():
            n = int.from_bytes(p[:4], "little")
            raw = open_.decompress(p[4:])
            heads.append(np.frombuffer(raw, np.uint8, 20 * n).reshape(n, 20))
            tails.append(np.frombuffer(raw, np.uint8, offset=20 * n))
        head, tail = np.concatenate(heads), np.concatenate(tails + [np.zeros(1, np.uint8)])
        cores = head[:, :16].copy().view(U64)
        by_core = np.lexsort((cores[:, 1], cores[:, 0]))
        c = cores[by_core]
        core = np.cumsum(np.concatenate(([0], (c[1:] != c[:-1]).any(1))))
        mask = np.where(head[by_core, 19] > 0, ~U64(0), U64(0))
        many = np.flatnonzero(np.bincount(core)[core] > 1)  # a core with one segment has nothing to compare
        if len(many):
            at = by_core[many]
            left, right = head[at, 16].astype(np.int64), head[at, 17].astype(np.int64)
            sizes = head[:, 16].astype(np.int64) + head[:, 17]
            begin = (np.cumsum(sizes) - sizes)[at]

            def block(start: np.ndarray, size: np.ndarray) -> np.ndarray:
                grid = np.arange(int(size.max()))[None, :]
                return np.where(grid < size[:, None], tail[np.minimum(start[:, None] + grid, len(tail) - 1)], 0).astype(np.uint8)

            mask[many] |= equal_strings(np.unique(core[many], return_inverse=True)[1], reach_of[head[at, 18]], block(begin, left), left, block(begin + left, right), right)
        back = np.empty(len(head), U64)
        back[by_core] = mask
        rows, at, b = [], 0, table["bucket"][0].as_py()
        for g, own in zip(table["g"].to_pylist(), heads, strict=True):
            rows.append((b, g, back[at : at + len(own)].tobytes()))
            at += len(own)
        return payloads(rows)

    return find


def _cut(bits: int, min_len: int, anchor: int, most: int):  # noqa: ANN202
    def cut(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        second = np.array(answers["bucket"].to_pylist(), np.int64) >= (1 << bits)
        s = Segments(table, answers.filter(pa.array(~second)), bits, min_len, anchor, most)
        mask = np.zeros(len(s.records), U64)
        back, twice = answers.filter(pa.array(second)), np.zeros(len(s.h), bool)
        for b, p in zip(back["bucket"].to_pylist(), back["payload"].to_pylist(), strict=True):
            b -= 1 << bits
            if b >= 1 << bits:
                x, y = s.h_edges[b - (1 << bits)], s.h_edges[b - (1 << bits) + 1]
                twice[x:y] = np.unpackbits(np.frombuffer(p, np.uint8), count=y - x).astype(bool)
            else:
                mask[s.order[s.edges[b] : s.edges[b + 1]]] = np.frombuffer(p, U64)
        starts: dict[int, list[np.ndarray]] = {}
        for i, at, number in s.singles:
            starts.setdefault(i, []).append(at[twice[number]])
        for i, base, lo, hi, core, index in s.places:
            m = mask[index]
            for t in range(s.width + 1):
                at = core - t
                hit = (m >> U64(t) & U64(1) > 0) & (at >= lo) & (at <= hi)
                starts.setdefault(i, []).append(at[hit] + base)
        n_bytes, n_removed, n_spans, shas = [], [], [], []
        for i, data, offsets in steps(s.table["text"]):
            gone = covered(np.concatenate(starts[i]), min_len, len(data)) if i in starts else np.zeros(len(data), bool)
            before = np.zeros(len(data), bool)
            before[1:] = gone[:-1]
            before[offsets[:-1][offsets[:-1] < len(data)]] = False
            by_doc = lambda x, o=offsets: np.diff(np.concatenate(([0], np.cumsum(x)))[o])
            n_bytes.append(np.diff(offsets))
            n_removed.append(by_doc(gone))
            n_spans.append(by_doc(gone & ~before))
            kept = data[~gone].tobytes()
            ends = np.concatenate(([0], np.cumsum(n_bytes[-1] - n_removed[-1]))).tolist()
            shas += [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"doc_id": s.table["doc_id"], "n_bytes": np.concatenate(n_bytes), "n_removed": np.concatenate(n_removed), "n_spans": np.concatenate(n_spans), "kept_sha256": pa.array(shas, pa.string())})

    return cut


def dedup_strings(docs: DataFrame, *, id: str = "doc_id", text: str = "text", min_len: int = MIN_LEN, anchor: int | None = None, hot: int = HOT) -> DataFrame:
    """One row a document; see the module. `hot`: occurrences of a core beyond which its strings are dealt one by one."""
    anchor = anchor or min_len // 2
    n = group_count(total_bytes(docs, text))
    bits = bucket_bits(n)
    base = grouped(docs, n, id, text)
    first = exchange(base.groupBy("g").applyInArrow(_send_cores(bits, min_len, anchor), PAYLOAD_DDL))
    segments = base.groupBy("g").cogroup(first.groupBy("g")).applyInArrow(_send_segments(bits, min_len, anchor, hot), PAYLOAD_DDL)
    second = segments.groupBy("bucket").applyInArrow(_find_equal(bits, min_len, anchor), PAYLOAD_DDL).withColumn("bucket", F.col("bucket") + F.lit(1 << bits))
    return base.groupBy("g").cogroup(first.unionByName(second).groupBy("g")).applyInArrow(_cut(bits, min_len, anchor, hot), OUT)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_strings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
