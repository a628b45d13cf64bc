"""Secret scans: fixed patterns, and a linear-chain conditional random field on top.

Tokens are tagged B, I or O, and a text's chain is all of its tokens: each of them may be tagged, wherever it stands.
Emissions are hashed features: the token's shape, length, character mix and affixes, its neighbours' words and file
features (how frequent triggers are, whether the text has base spans). A trigger is a word that holds a digit, one of at
least LONG characters, one that changes from small to capital letters, or one of the names that secrets go by.

Weights come from gradient ascent on the conditional likelihood (forward-backward in numpy) over a bounded sample:
stretches around triggers of at most `max_docs` documents, least hash of the id first, and at most `max_chains` of them,
`per_doc` a document (those with spans first), cut at every `max_tokens` tokens, and `max_plain` stretches of any tokens,
two a document; they are labelled by the base patterns; a second copy of those with spans has its neighbours hidden, so
that shape has to do. To these come `made_up` secrets of well-known formats, and harmless look-alikes, set between the
sample's own words. Only this fit is bounded.

Decoding is Viterbi over the whole chain. A token whose best run of B and I, by an upper bound on what such a run can
gain over O, still loses is O on the best path; what lies between such tokens is decoded by itself, with the same
result (see `hopeful`).

Contract: null texts are empty; positions are code points, ends exclusive. Base spans always stay; a model span
that overlaps a base span is left out. Rows are scanned one by one, so repeated rows agree. Extra columns don't pass. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.llm.common import sha256

#: The base patterns, in the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run of 32 or more, as leftmost runs of any length then filtered
KINDS = {"assign": 0, "access": 1, "hex": 2, "crf": 3}
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
HEX_ALPHABET = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))

FEATURES = 1 << 15
LONG, AROUND = 24, 40
MAX_DOCS, MAX_CHAINS, PER_DOC, MAX_TOKENS = 3000, 1500, 20, 400
#: Stretches of any tokens in the fit, and the tokens of each.
MAX_PLAIN, PLAIN_TOKENS = 2000, 40
TOKEN = re.compile(r"[\w+/\-]+(?:\.[\w+/\-]+)*(?:={1,2}(?!\w))?|[^\w\s+/\-]")
#: Names that secrets go by, apart from the base patterns'.
NAMES = ("passw", "passphrase", "passcode", "pwd", "secret", "token", "credential", "bearer", "private key", "api key", "access key")
NAMED = re.compile("|".join(NAMES))
SPACE = re.compile(r"\s")
TRIGGER = re.compile(rf"[0-9]\S*|[a-z][A-Z]\S*|(?<!\S)\S{{{LONG},}}")

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns; cheap containment tests come first."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS) or not low.isascii() and ASSIGN.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if b"\x01" * 32 in text.encode("latin-1", "replace").translate(HEX_ALPHABET):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS[s[2]]))


class Chain(NamedTuple):
    starts: list[int]
    ends: list[int]
    words: list[str]


def triggers(text: str) -> list[tuple[int, int]]:
    spots = [m.span() for m in TRIGGER.finditer(text)]
    low = text.lower()
    # the lower-cased text may be longer by some letters; then names are sought in ASCII alone
    low = low if len(low) == len(text) else text.translate(SMALL)
    if any(k in low for k in NAMES):
        spots = sorted(spots + [m.span() for m in NAMED.finditer(low)])
    return spots


def share_of(n_triggers: int, text: str) -> float:
    return n_triggers * 200 / (len(text) + 200)


def whole(text: str) -> Chain:
    """All tokens of a text."""
    found = list(TOKEN.finditer(text))
    return Chain([m.start() for m in found], [m.end() for m in found], [m[0] for m in found])


def chains(text: str) -> tuple[list[Chain], float]:
    """Stretches of tokens around triggers, from which the fit draws, and how frequent these are (a file feature)."""
    spots = triggers(text)
    stretches: list[list[int]] = []
    for a, b in spots:
        while a and not text[a - 1].isspace():
            a -= 1
        a, b = max(0, a - AROUND), min(len(text), b + AROUND)
        while a and not text[a].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = max(b, stretches[-1][1])
        else:
            stretches.append([a, b])
    out = []
    for a, b in stretches:
        if found := list(TOKEN.finditer(text, a, b)):
            out.append(Chain([m.start() for m in found], [m.end() for m in found], [m[0] for m in found]))
    return out, share_of(len(spots), text)


CLASS = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}})
RUN = re.compile(r"(.)\1+", re.DOTALL)


def shape(word: str) -> str:
    """Character classes with runs collapsed: 'ab12-C' is 'a0-A'."""
    return RUN.sub(r"\1", word.translate(CLASS))


def number(feature: str) -> int:
    return zlib.crc32(feature.encode()) % FEATURES


def own_features(w: str) -> list[int]:
    """Features of a token alone."""
    n, classes = len(w), w.translate(CLASS)
    runs = RUN.sub(r"\1", classes)
    digits, upper, lower, changes = classes.count("0"), classes.count("A"), classes.count("a"), len(runs) - 1
    size = min(n // 4, 12)
    parts = [
        "bias", f"s={runs}", f"l={size}", f"m={size}:{digits * 4 // n}:{upper * 4 // n}:{changes * 6 // n}", f"d={len(set(w)) * 4 // n}:{size}", f"k={digits > 0}:{upper > 0}:{lower > 0}:{size}",
        f"h={not w.strip('0123456789abcdefABCDEF')}:{min(n // 8, 5)}:{digits > 0}", f"p={w[:4]}", f"e={w[-4:]}", f"t={digits + upper + lower == n}:{size}:{min(changes, 6)}",
    ]
    if n < 20:
        parts.append(f"w={w.lower()}")
    return [number(x) for x in parts]


NEAR = (-4, -3, -2, -1, 1, 2)


def near_feature(d: int, w: str) -> int:
    return number(f"{d}={w.lower() if len(w) < 20 else '#long'}")


LEVELS = 6


def level_of(share: float) -> int:
    return min(int(share * 5), LEVELS - 1)


def is_some(w: str) -> bool:
    return len(w) >= LONG or any("0" <= c <= "9" for c in w)


def file_features(w: str, share: float, has_base: bool) -> list[int]:
    return _file_numbers(is_some(w), level_of(share), has_base)


def _file_numbers(some: bool, level: int, has_base: bool) -> list[int]:
    return [number(f"f={level}:{some}"), number(f"b={has_base}:{some}")]


def emissions(chain: Chain, share: float, has_base: bool, hide: bool = False) -> list[np.ndarray]:
    """Feature numbers of each token; with `hide`, without its neighbours'."""
    words, out = chain.words, []
    for i, w in enumerate(words):
        near = [] if hide else [near_feature(d, words[i + d]) for d in NEAR if 0 <= i + d < len(words)]
        out.append(np.array(own_features(w) + file_features(w, share, has_base) + near))
    return out


class Model(NamedTuple):
    weights: np.ndarray  # FEATURES x 3 for O, B, I
    moves: np.ndarray  # 3 x 3
    first: np.ndarray  # 3


FORBID = -1e4


def _scores(model: Model, feats: list[np.ndarray]) -> np.ndarray:
    return np.array([model.weights[f].sum(0) for f in feats])


Vector = tuple[float, float, float]


def viterbi(model: Model, e: Sequence[Vector], after_o: bool = False, before_o: bool = False) -> list[int]:
    """The best tags for the scores of O, B, I at each token, of a whole chain or between tokens that are O."""
    (oo, ob, _), (bo, bb, bi), (io, ib, ii) = model.moves.tolist()
    o, b, i = (f + x for f, x in zip((model.moves[0] if after_o else model.first).tolist(), e[0], strict=True))
    back: list[tuple[int, int, int]] = []
    for eo, eb, ei in e[1:]:
        to_o, to_b = (o + oo, b + bo, i + io), (o + ob, b + bb, i + ib)
        from_o, from_b = to_o.index(max(to_o)), to_b.index(max(to_b))
        from_i = 1 if b + bi >= i + ii else 2  # I follows B or I only
        back.append((from_o, from_b, from_i))
        o, b, i = to_o[from_o] + eo, to_b[from_b] + eb, (b + bi if from_i == 1 else i + ii) + ei
    if before_o:
        o, b, i = o + oo, b + bo, i + io
    tags = [max(range(3), key=(o, b, i).__getitem__)]
    for step in reversed(back):
        tags.append(step[tags[-1]])
    return tags[::-1]


class Numbers(dict):
    """A row for each word, from 1 on; `new` are the words whose rows are still to be filled."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, w: str) -> int:
        self.new.append(w)
        self[w] = row = len(self) + 1
        return row


class Emitter:
    """Scores of texts' tokens. Words met before keep theirs in tables, a row a word; row 0 is no word.

    A line holds the rows of several texts, PAD zeros before each and after the last: no neighbour is in another text.
    """

    WORDS, STEP, PAD = 300_000, 1 << 17, max(-min(NEAR), max(NEAR))

    def __init__(self, model: Model):
        self.model = model
        numbers = [_file_numbers(some, level, has) for level in range(LEVELS) for has in (False, True) for some in (False, True)]
        self.file = np.array([model.weights[x].sum(0) for x in numbers])
        self.starts = [zlib.crc32(f"{d}=".encode()) for d in NEAR]
        m = model.moves - model.moves[0, 0]
        self.to_b, self.to_i = max(*m[:, 1], model.first[1] - model.first[0]), max(m[1, 2], m[2, 2])
        self.leave = max(m[1, 0], m[2, 0], 0.0)
        self.forget()

    def forget(self) -> None:
        self.rows = Numbers()
        self.own, self.near, self.some = np.zeros((1024, 3), np.float32), np.zeros((len(NEAR), 1024, 3), np.float32), np.zeros(1024, np.int8)

    def _learn(self) -> None:
        """Fills the rows of new words."""
        new, self.rows.new = self.rows.new, []
        first, weights = len(self.rows) - len(new) + 1, self.model.weights
        if (more := first + len(new) - len(self.own)) > 0:
            more = max(more, len(self.own))
            self.own, self.some = np.pad(self.own, ((0, more), (0, 0))), np.pad(self.some, (0, more))
            self.near = np.pad(self.near, ((0, 0), (0, more), (0, 0)))
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            at = slice(first + k, first + k + len(part))
            feats = [own_features(w) for w in part]
            edges = np.cumsum([0, *map(len, feats[:-1])])
            self.own[at] = np.add.reduceat(weights[[x for f in feats for x in f]], edges)
            self.some[at] = [is_some(w) for w in part]
            names = [(w.lower() if len(w) < 20 else "#long").encode() for w in part]
            for j, crc in enumerate(self.starts):
                self.near[j, at] = weights[[zlib.crc32(x, crc) % FEATURES for x in names]]

    def line(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """The texts' rows in a line, and where each text begins."""
        if len(self.rows) > self.WORDS:
            self.forget()
        pad, parts, at = np.zeros(self.PAD, np.int32), [], []
        n = 0
        for text in texts:
            n += self.PAD
            parts.append(pad)
            at.append(n)
            a = 0
            while a < len(text):  # tokens end at spaces, so a long text is cut there
                gap = SPACE.search(text, a + (1 << 20))
                b = gap.start() if gap else len(text)
                parts.append(np.fromiter(map(self.rows.__getitem__, TOKEN.findall(text, a, b)), np.int32))
                n, a = n + len(parts[-1]), b
        self._learn()
        return np.concatenate([*parts, pad]), at

    def emit(self, line: np.ndarray, kind: np.ndarray | int, a: int, b: int) -> np.ndarray:
        """Scores of O, B and I at the places a to b of a line; `kind` says which file features they have."""
        rows = line[a:b]
        e = self.own[rows] + self.file[kind + self.some[rows]]
        for near, d in zip(self.near, NEAR, strict=True):
            e += near[line[a + d : b + d]]
        return e

    def hopeful(self, line: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """(start, end) of the stretches of a line outside of which every token is O on the best path.

        A run of B and I on the best path gains at least nothing over O. What it gains is at most the sum of its
        tokens' gains, each with the best move to its tag, and the best move out of it. So a token is O if that sum is
        below 0 for every run that holds it: the greatest cumulative sum from it on less the least one before it.
        """
        gain = np.empty(len(line))
        for a in range(self.PAD, len(line) - self.PAD, self.STEP):
            b = min(a + self.STEP, len(line) - self.PAD)
            e = self.emit(line, kinds[a:b], a, b)
            gain[a:b] = np.maximum(e[:, 1] + self.to_b, e[:, 2] + self.to_i) - e[:, 0]
        gain[line == 0] = -100.0
        upto = np.concatenate(([0.0], np.cumsum(gain)))
        best = np.maximum.accumulate(upto[:0:-1])[::-1] - np.minimum.accumulate(upto[:-1])
        hot = np.concatenate(([False], (best + self.leave > -1e-2) & (line > 0), [False]))
        return np.flatnonzero(hot[1:] != hot[:-1]).reshape(-1, 2)

    def kind(self, share: float, has_base: bool) -> int:
        return (level_of(share) * 2 + has_base) * 2

    def scores(self, chain: Chain, share: float, has_base: bool) -> np.ndarray:
        pad = np.zeros(self.PAD, np.int32)
        line = np.concatenate((pad, np.array([self.rows[w] for w in chain.words], np.int32), pad))
        self._learn()
        return self.emit(line, self.kind(share, has_base), self.PAD, len(line) - self.PAD)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(x, axis)


def blank_model() -> Model:
    moves, first = np.zeros((3, 3)), np.zeros(3)
    moves[0, 2] = first[2] = FORBID  # I follows B or I only
    return Model(np.zeros((FEATURES, 3)), moves, first)


def train(examples: list[tuple[list[np.ndarray], list[int]]], *, epochs: int = 6, rate: float = 0.2, decay: float = 1e-4, seed: int = 3) -> Model:
    """Stochastic gradient ascent on the chains' conditional log-likelihood."""
    model = blank_model()
    if not any(any(t) for _, t in examples):
        weights = model.weights.copy()
        weights[number("bias"), 0] = 5.0  # nothing to learn from: all is outside
        return model._replace(weights=weights)
    rng = np.random.default_rng(seed)
    allowed = model.moves > FORBID / 2
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(len(examples)):
            feats, tags = examples[i]
            e, n = _scores(model, feats), len(feats)
            a, b = np.empty((n, 3)), np.zeros((n, 3))
            a[0] = model.first + e[0]
            for t in range(1, n):
                a[t] = _lse(a[t - 1][:, None] + model.moves, 0) + e[t]
            for t in range(n - 2, -1, -1):
                b[t] = _lse(model.moves + (e[t + 1] + b[t + 1])[None, :], 1)
            z = _lse(a[-1], 0)
            g = -np.exp(a + b - z)
            g[np.arange(n), tags] += 1
            for t in np.flatnonzero(np.abs(g).max(1) > 1e-4):  # a token that is certain teaches nothing
                f = feats[t]
                model.weights[f] += step * (g[t] - decay * model.weights[f])
            if n > 1:
                q = np.exp(a[:-1, :, None] + model.moves + (e[1:] + b[1:])[:, None, :] - z)
                total = q.sum(0)
                np.subtract.at(total, (tags[:-1], tags[1:]), 1)
                model.moves[allowed] -= step * 0.1 * total[allowed]
    return model


def _label(chain: Chain, spans: list[Span]) -> list[int]:
    """Tags of the tokens that lie in a span; of an assignment that is what stands behind its sign."""
    tags, inside_ = [], False
    for k, (a, b) in enumerate(zip(chain.starts, chain.ends, strict=True)):
        hit = any(s <= a and b <= e and (kind != "assign" or a >= e - _value_length(chain, s, e)) for s, e, kind in spans)
        tags.append((2 if inside_ else 1) if hit else 0)
        inside_ = hit
    return tags


def _value_length(chain: Chain, start: int, end: int) -> int:
    """Code points of a span from the first token behind its ':' or '='."""
    sign = next((b for a, b, w in zip(chain.starts, chain.ends, chain.words, strict=True) if start <= a and w in (":", "=")), start)
    first = next((a for a, w in zip(chain.starts, chain.words, strict=True) if a >= sign and w not in ("'", '"')), start)
    return end - first


def _plain(text: str, spans: list[Span], id: int) -> Iterator[tuple[list[str], list[int]]]:
    """Twice PLAIN_TOKENS tokens of a text with their tags: from a place that its id decides, and around its longest
    word of letters, as secrets may look like such words."""
    chain = whole(text)
    words, tags = chain.words, _label(chain, spans)
    longest = max(range(len(words)), key=lambda i: words[i].isalpha() and len(words[i]), default=0)
    for k in (zlib.crc32(str(id).encode()), longest - PLAIN_TOKENS // 2):
        k = max(0, k) % max(1, len(words) - PLAIN_TOKENS + 1)
        yield words[k : k + PLAIN_TOKENS], tags[k : k + PLAIN_TOKENS]


def _sampler(per_doc: int, max_tokens: int):  # noqa: ANN202
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches as text with tags: (doc_id, words, tags, share, base, plain)."""
        for batch in batches:
            rows = []
            for id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                spans = base_spans(text or "")
                found, share = chains(text or "")
                tagged = [(c.words[k : k + max_tokens], t[k : k + max_tokens]) for c in found for t in [_label(c, spans)] for k in range(0, len(t), max_tokens)]
                tagged.sort(key=lambda x: -any(x[1]))
                tagged = [(*x, False) for x in tagged[:per_doc]] + [(*x, True) for x in _plain(text or "", spans, id)]
                rows += [(id, "\x00".join(w), bytes(t), share, bool(spans), plain) for w, t, plain in tagged if w]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.float64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "words", "tags", "share", "base", "plain"])

    return sampled


LOW, UP, DIGITS, HEXES = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def made_up(rng: np.random.Generator, words: list[str], n: int) -> list[tuple[str, list[Span]]]:
    """Sentences of the sample's words with a secret of a well-known format, or with something that looks like one."""
    pick = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    some = lambda *x: x[int(rng.integers(0, len(x)))]
    word = lambda: words[int(rng.integers(0, len(words)))]
    many = LOW + UP + DIGITS
    keys = [
        lambda: "AKIA" + pick(UP + DIGITS, 16), lambda: pick(many + "+/", 40), lambda: pick(many, int(rng.integers(20, 60))), lambda: pick(HEXES, int(rng.choice([32, 40, 64]))),
        lambda: some("ghp_", "tok_", "pat-", "key-") + pick(many, int(rng.integers(20, 40))), lambda: some("sk_live_", "rk_test_", "pk_") + pick(many, int(rng.integers(16, 32))),
        lambda: ".".join(("ey" + pick(many, int(rng.integers(15, 40))), "ey" + pick(many, int(rng.integers(20, 80))), pick(many + "_-", int(rng.integers(20, 50))))),
        lambda: pick(many + "+/", int(rng.integers(22, 64))) + some("=", "=="), lambda: "-".join(pick(DIGITS + LOW, int(rng.integers(8, 16))) for _ in range(3)),
        lambda: "-".join(pick(UP, k) for k in [int(rng.integers(4, 6))] * int(rng.integers(3, 6))), lambda: pick(UP, int(rng.integers(16, 24))),
    ]
    passwords = [
        lambda: pick(LOW, int(rng.integers(4, 10))) + pick(DIGITS, int(rng.integers(1, 5))) + pick(LOW, int(rng.integers(0, 5))), lambda: pick(LOW, int(rng.integers(8, 28))), lambda: pick(UP, int(rng.integers(8, 20))),
        lambda: pick(many, int(rng.integers(7, 16))), lambda: pick(LOW, 5) + some("!", "#", "&", "$") + pick(DIGITS, 2), lambda: word() + "-" + word() + "-" + word(), lambda: pick(DIGITS, int(rng.integers(4, 9))),
    ]
    harmless = [
        *[lambda: pick(DIGITS, int(rng.integers(1, 8)))] * 4, lambda: pick(DIGITS, int(rng.integers(6, 13))), lambda: f"{pick(DIGITS, 4)}-{pick(DIGITS, 2)}-{pick(DIGITS, 2)}", lambda: f"+{pick(DIGITS, 2)} ({pick(DIGITS, 3)}) {pick(DIGITS, 3)}-{pick(DIGITS, 4)}",
        lambda: f"{word()}.{pick(DIGITS, 2)}@{word()}.example.com", lambda: f"https://{word()}.example.org/{word()}/{pick(DIGITS, 3)}", lambda: f"{pick(DIGITS, 1)}.{pick(DIGITS, 1)}.{pick(DIGITS, 2)}", lambda: pick(DIGITS, 3) + some("km", "kg", "px", "th"),
        lambda: "".join(word() for _ in range(4)), lambda: word().capitalize() + word().capitalize(), lambda: f"{pick(DIGITS, 3)}.{pick(DIGITS, 3)}.{pick(DIGITS, 1)}.{pick(DIGITS, 2)}", lambda: word() + pick(DIGITS, 1), lambda: pick(UP, 3) + "-" + pick(DIGITS, 4),
    ]
    about = ["password", "passwd", "pwd", "passphrase", "passcode", "secret", "token", "api key", "access key", "credential", "login password", "private key", "bearer token"]
    told = [" is ", ": ", " = ", " was set to ", "=", ' is "', " '", " ", " changed to ", " -> "]
    out = []
    for _ in range(n):
        before, after = " ".join(word() for _ in range(int(rng.integers(0, 7)))), " ".join(word() for _ in range(int(rng.integers(0, 7))))
        kind, close = rng.random(), some("", "", ".", ",", '"')
        if kind < 0.3:
            secret, lead = some(*keys)(), some("", "", some(*about) + some(*told), "key ", "= ", ": ")
        elif kind < 0.55:
            secret, lead = some(*passwords)(), some(*about) + some(*told[:7], *told[8:])
        elif kind < 0.85:
            secret, lead, close = "", some("", "", "number ", "call ", "on ", "in ", "had ") + some(*harmless)(), some("", ".", ",")
        else:
            secret, lead, close = "", some("the ", "a ", "") + some(*about) + " " + some("is required", "must be changed", "of " + word(), "was lost", word(), "and " + word()), some("", ".")
        text = f"{before} {lead}" if before else lead
        start = len(text)
        out.append((f"{text}{secret}{close} {after}", [(start, start + len(secret), "crf")] if secret else []))
    return out


def fit(docs: DataFrame, *, id: str = "doc_id", text: str = "text", max_docs: int = MAX_DOCS, max_chains: int = MAX_CHAINS, per_doc: int = PER_DOC, max_tokens: int = MAX_TOKENS, max_plain: int = MAX_PLAIN, made: int = 2000, seed: int = 17) -> Model:
    chosen = docs.select(F.col(id).alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")  # max_docs ids
    rows = texts.mapInArrow(_sampler(per_doc, max_tokens), "doc_id long, words string, tags binary, share double, base boolean, plain boolean")
    hit = F.instr(F.hex("tags"), "01") > 0
    order = [F.xxhash64("doc_id", "words"), "words"]
    chosen_rows = rows.where("not plain").orderBy(hit.desc(), *order).limit(max_chains).collect() + rows.where("plain").orderBy(*order).limit(max_plain).collect()
    examples, common = [], ["the", "a", "of"]
    for r in chosen_rows:
        words = r["words"].split("\x00")
        common += [w for w in words if w.isalpha()][:5]
        for hide in (False, True)[: 1 + any(r["tags"])]:
            examples.append((emissions(Chain([], [], words), r["share"], r["base"], hide), list(r["tags"])))
    rng = np.random.default_rng(seed)
    for sentence, spans in made_up(rng, common, made):
        if (chain := whole(sentence)).words:
            # how frequent triggers are says nothing in a single sentence
            examples.append((emissions(chain, float(rng.random() * 0.6), False, bool(rng.random() < 0.15)), _label(chain, spans)))
    return train(examples)


def spans_of(texts: list[str], bases: list[list[Span]], emitter: Emitter) -> list[list[Span]]:
    """The model's spans in each text, out of the best path through all of its tokens."""
    line, at = emitter.line(texts)
    ends = [*[a - emitter.PAD for a in at[1:]], len(line) - emitter.PAD]
    kind = [emitter.kind(share_of(len(triggers(text)), text), bool(base)) for text, base in zip(texts, bases, strict=True)]
    kinds = np.repeat(np.array([0, *kind], np.int16), np.diff([0, *at, len(line)]))
    runs: dict[int, list[tuple[int, int]]] = {}  # first and last token of each span of a text
    for a, b in emitter.hopeful(line, kinds).tolist():
        k = bisect_right(at, a) - 1
        tags = viterbi(emitter.model, emitter.emit(line, kind[k], a, b).tolist(), a > at[k], b < ends[k])
        start = None
        for i, t in enumerate([*tags, 0], a - at[k]):
            if start is not None and t != 2:
                runs.setdefault(k, []).append((start, i - 1))
                start = None
            if t == 1:
                start = i
    out: list[list[Span]] = [[] for _ in texts]
    for k, found in runs.items():
        wanted = {i for run in found for i in run}
        places = {i: m.span() for i, m in enumerate(TOKEN.finditer(texts[k])) if i in wanted}
        for i, j in found:
            a, b = places[i][0], places[j][1]
            if not any(a < e and s < b for s, e, _ in bases[k]):
                out[k].append((a, b, "crf"))
    return out


def model_spans(text: str, base: list[Span], emitter: Emitter) -> list[Span]:
    return spans_of([text], [base], emitter)[0]


def portions(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(start, end) of successive texts of about `most` characters in all."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS[s[2]])))


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"


def scanner(model: Model):  # noqa: ANN201
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitter = Emitter(model)
        for batch in batches:
            rows, ids, texts = [], batch["doc_id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()]
            for a, b in portions(texts):
                bases = [base_spans(t) for t in texts[a:b]]
                for id, base, more in zip(ids[a:b], bases, spans_of(texts[a:b], bases, emitter), strict=True):
                    n = [sum(k == kind for _, _, k in base) for kind in ("assign", "access", "hex")]
                    rows.append((id, *n, sha256(join_spans(base).encode()), join_spans(base + more), len(more)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return scan


def find_secrets(docs: DataFrame, *, id: str = "doc_id", text: str = "text", model: Model | None = None, **kw: int) -> DataFrame:
    model = model or fit(docs, id=id, text=text, **kw)
    packed = model._replace(weights=model.weights.astype(np.float32))
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scanner(packed), OUT)


def redact(text: str, spans: str, mark: str = "[secret]") -> str:
    """The text with each span replaced; overlapping spans count as one."""
    out, at = [], 0
    for _, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)), key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_secrets(docs)
