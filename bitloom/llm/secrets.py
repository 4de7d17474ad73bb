"""Secret scans: fixed patterns, and a character convolutional network over further candidates.

Base findings are exact pattern matches and always stay. Candidates are all runs of token
characters no shorter than the least value that a base pattern counts, of any classes; of a
run that base findings touch, all parts outside them.

The network (numpy) reads each candidate whole, and WIDTH characters on both sides: one-hot
character classes, one rectified convolution of SPAN characters, maximum and mean over the
candidate, maximum over either context, the length, one hidden layer and a logistic output.

Fit. All characters of all texts, and all base findings with their contexts, are counted as
runs of GRAM characters by class (exact integers, at most 18 ** GRAM cells, whatever the
corpus). The network learns from what is drawn from these counts: positives are base findings
and keys of the rules of KEYS, negatives other candidates of drawn text, half of them from those with
digits or signs, and names, numbers, paths and identifiers by the rules of PLAIN from its words;
keys and names are set in places of its candidates. Then the network scores every candidate
(negative; a finding that no base pattern knows is one of many) and every base finding of the
corpus, and drawn examples that it has not learned from. Counts of all these logits, each sort
weighing the same, give the temperature and the threshold: the largest one that keeps RECALL of
the positives. The model holds the recall, the precision and the share of all corpus candidates
above the threshold.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bitloom.llm.common import tune

#: Base patterns, in the order that breaks ties; the number is the least length of the group that counts.
KINDS = {
    "assign": (re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
#: As hex without its short runs, which match nothing else.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Every third character of a run of long hex; what a lower-case text with an assign finding holds.
_THIRD_HEX, _ASSIGNED = re.compile(r"[0-9a-f]{8}"), ("passw", "secret", "token", "api")
LEAST = min(least for _, _, least in KINDS.values())

#: Examples drawn by rule of either sort, characters of context on each side.
DRAWN, WIDTH = 2_000, 12
FILTERS, HIDDEN, SPAN, RECALL, CLASSES = 8, 16, 5, 0.95, 16
#: Characters of a counted run, and of drawn text; logits are counted in bins of 1 / FINE up to FAR.
GRAM, DRAWN_CHARS, FINE, FAR = SPAN, 120_000, 64, 64
#: Characters of texts that are scored at a time (a longer text is scored alone).
SCORED = 1 << 16


def _class_table() -> np.ndarray:
    t = np.full(256, 15, np.int64)  # all other characters
    t[0] = 0  # outside the text
    for k, chars in enumerate(("ae", "bcdf", "iou", "ghjklmnpqrstvwxyz", "ABCDEF", "IOU", "GHJKLMNPQRSTVWXYZ", "0123456789", " \t\r\n", "=:", "\"'`", "/", "+-_", ".,;@"), 1):
        for c in chars:
            t[ord(c)] = k
    return t


_TABLE = _class_table()
_TOKEN = np.zeros(256, bool)
_TOKEN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
#: Between two texts, and before the first and after the last.
_GAP = "\0" * (WIDTH + SPAN)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base findings, in order; code points, end exclusive."""
    found = []
    low = text.lower()
    for k, (pattern, group, least) in enumerate(KINDS.values()):
        # Texts without any finding of the kind are told by cheaper tests.
        if not (any(x in low for x in _ASSIGNED) if k == 0 else k == 1 or _THIRD_HEX.search(text[::3])):
            continue
        for m in (_LONG_HEX if k == 2 else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end()))
    found.sort()
    return found


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate([[0], flag.view(np.int8), [0]]).astype(np.int8))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


class Texts:
    """Some texts in one array of characters, with their base findings and further candidates."""

    def __init__(self, texts: list[str], scan: bool = True):
        self.texts = texts
        self.begin = np.cumsum([len(_GAP), *(len(t) + len(_GAP) for t in texts)])[: len(texts)]
        raw = np.frombuffer((_GAP + "".join(t + _GAP for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.chars = np.minimum(raw, 255).astype(np.uint8)
        self.base = [base_spans(t) if scan else [] for t in texts]

    def candidates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of the further candidates, in order; places in the array of characters."""
        inside = _TOKEN[self.chars]
        start, end = _runs(inside)
        short = end - start < LEAST
        edge = np.zeros(len(inside) + 1, np.int8)
        edge[start[short]] = 1
        edge[end[short]] -= 1
        inside &= np.cumsum(edge[:-1], dtype=np.int8) == 0
        for at, base in zip(self.begin.tolist(), self.base):
            for a, _, b in base:
                inside[at + a : at + b] = False
        start, end = _runs(inside)
        return np.searchsorted(self.begin, start, "right") - 1, start, end

    def odd(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether candidates hold digits or signs."""
        n = np.concatenate([[0], np.cumsum(~_LETTER[self.chars])])
        return n[end] > n[start]

    def base_values(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of the values of the base findings, as candidates(); they may overlap."""
        found = [(d, KINDS["assign"][0].match(self.texts[d], a).start(2) if k == 0 else a, b) for d, base in enumerate(self.base) for a, k, b in base]
        doc, start, end = np.array(found, np.int64).reshape(-1, 3).T
        return doc, start + self.begin[doc], end + self.begin[doc]

    @staticmethod
    def slices(texts: list[str]) -> Iterator[tuple[int, "Texts"]]:
        """(index of the first, texts) of about SCORED characters each."""
        i = 0
        while i < len(texts):
            j, n = i + 1, len(texts[i])
            while j < len(texts) and n + len(texts[j]) <= SCORED:
                n, j = n + len(texts[j]), j + 1
            yield i, Texts(texts[i:j])
            i = j


@dataclass
class SecretModel:
    w: np.ndarray = field(default_factory=lambda: np.zeros((FILTERS, SPAN, CLASSES)))
    b: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS))
    u: np.ndarray = field(default_factory=lambda: np.zeros((4 * FILTERS + 1, HIDDEN)))
    a: np.ndarray = field(default_factory=lambda: np.zeros(HIDDEN))
    v: np.ndarray = field(default_factory=lambda: np.zeros(HIDDEN))
    c: float = -10.0
    temperature: float = 1.0
    threshold: float = 1.0
    recall: float | None = None
    precision: float | None = None
    marked: float | None = None  # share of sampled corpus candidates above the threshold

    def convolved(self, classes: np.ndarray) -> np.ndarray:
        """(positions, filters) of the rectified convolution, by tables of two and of three characters."""
        tap = [self.w[:, i, :].T.astype(np.float32) for i in range(SPAN)]
        two = (tap[0][:, None] + tap[1][None]).reshape(-1, FILTERS) + self.b.astype(np.float32)
        three = (tap[2][:, None, None] + tap[3][None, :, None] + tap[4][None, None]).reshape(-1, FILTERS)
        k = classes.astype(np.int32)
        n = len(k) - SPAN + 1
        pair = k[:-1] * CLASSES + k[1:]
        z = np.take(two, pair[:n], 0)
        z += np.take(three, pair[2 : n + 2] * CLASSES + k[4 : n + 4], 0)
        return np.maximum(z, 0, out=z)

    def pooled(self, z: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Features of candidates (start, end) from the convolution; candidates are in order and don't overlap."""
        cut = np.stack([start - SPAN // 2, end - SPAN // 2], 1).reshape(-1)
        top, total = np.maximum.reduceat(z, cut)[::2], np.add.reduceat(z, cut)[::2]
        near, size = z, 1
        while size < WIDTH - SPAN + 1:
            near, size = np.maximum(near[:-size], near[size:]), 2 * size
        n = (end - start)[:, None]
        return np.concatenate([top, total / n, near[start - WIDTH], near[end], np.log(n) / 4], 1)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.u + self.a, 0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (self.hidden(x) @ self.v + self.c) / self.temperature

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))

    def features(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """(which, features) of candidates in order; a part of the array at a time, so that memory is bounded but for a longer candidate."""
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + SCORED, "right")))
            low = start[i] - WIDTH
            z = self.convolved(_TABLE[chars[low : end[j - 1] + WIDTH + SPAN]])
            yield slice(i, j), self.pooled(z, start[i:j] - low, end[i:j] - low)
            i = j

    def score(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Probability of each candidate."""
        out = np.empty(len(start))
        for at, x in self.features(chars, start, end):
            out[at] = self.probability(x)
        return out

    def train(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 14, rate: float = 0.01) -> None:
        """Adam on the log loss; the seed fixes the result. Examples are candidates in order in one array."""
        rng = np.random.default_rng(seed)
        p = {"w": rng.normal(0, 0.3, self.w.shape), "b": np.zeros(FILTERS), "u": rng.normal(0, 0.2, self.u.shape), "a": np.zeros(HIDDEN), "v": rng.normal(0, 0.3, HIDDEN), "c": np.zeros(1)}
        m, s, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        classes = _TABLE[chars]
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), 64):
                pick = np.sort(order[at : at + 64])
                # Each example on its own: left context, candidate, right context.
                low, high = start[pick] - WIDTH, end[pick] + WIDTH
                size = high - low
                place = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                k = classes[place]
                a = np.cumsum(size) - size + WIDTH
                b = a + (end - start)[pick]
                self.w, self.b, self.u, self.a, self.v, self.c = p["w"], p["b"], p["u"], p["a"], p["v"], float(p["c"][0])
                n = len(k) - SPAN + 1
                z = np.maximum(sum(self.w[:, i, :].T[k[i : i + n]] for i in range(SPAN)) + self.b, 0)
                z = np.concatenate([z, np.zeros((SPAN, FILTERS))])
                x = self.pooled(z, a, b)
                h = np.maximum(x @ self.u + self.a, 0)
                d = (1 / (1 + np.exp(-np.clip(h @ self.v + self.c, -30, 30))) - y[pick]) / len(pick)
                dh = d[:, None] * self.v * (h > 0)
                dx = dh @ self.u.T
                dz = np.zeros_like(z)
                f = np.arange(FILTERS)
                lo, n_own = a - SPAN // 2, b - a
                row, begin = np.repeat(np.arange(len(pick)), n_own), np.cumsum(n_own) - n_own
                own = np.arange(len(row)) + (lo - begin)[row]
                dz[own] += (dx[:, FILTERS : 2 * FILTERS] / n_own[:, None])[row]
                dz[np.minimum.reduceat(np.where(z[own] == x[row, :FILTERS], own[:, None], len(z)), begin), f] += dx[:, :FILTERS]
                for q, g in ((a - WIDTH, 2), (b, 3)):
                    np.add.at(dz, (q[:, None] + z[q[:, None] + np.arange(WIDTH - SPAN + 1)].argmax(1), f[None]), dx[:, g * FILTERS : (g + 1) * FILTERS])
                dz *= z > 0
                dw = np.zeros_like(p["w"])
                for j in range(SPAN):
                    hot = np.zeros((n, CLASSES))
                    hot[np.arange(n), k[j : j + n]] = 1
                    dw[:, j, :] = dz[:n].T @ hot
                g = {"w": dw + 1e-4 * p["w"], "b": dz.sum(0), "u": x.T @ dh + 1e-4 * p["u"], "a": dh.sum(0), "v": h.T @ d + 1e-4 * p["v"], "c": np.array([d.sum()])}
                t += 1
                for q in p:
                    m[q] = 0.9 * m[q] + 0.1 * g[q]
                    s[q] = 0.999 * s[q] + 0.001 * g[q] ** 2
                    p[q] = p[q] - rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(s[q] / (1 - 0.999**t)) + 1e-8)
        self.w, self.b, self.u, self.a, self.v, self.c = p["w"], p["b"], p["u"], p["a"], p["v"], float(p["c"][0])


_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _drawn(rng: np.random.Generator, chars: str, low: int, high: int) -> str:
    return "".join(rng.choice(list(chars), int(rng.integers(low, high + 1))))


#: Keys, by rule: what the network is to find beside the base patterns.
KEYS: list[Callable] = [
    lambda r: _drawn(r, _UPPER + _LOWER + _DIGIT, 18, 48),
    lambda r: _drawn(r, _UPPER + _LOWER + _DIGIT + "+/", 24, 64) + "=" * int(r.integers(0, 3)),
    lambda r: _drawn(r, _LOWER, 2, 5) + str(r.choice(["_", "-"])) + _drawn(r, _UPPER + _LOWER + _DIGIT, 16, 40),
    lambda r: _drawn(r, _UPPER + _DIGIT, 18, 40),
    lambda r: _drawn(r, _LOWER + _DIGIT, 20, 40),
    lambda r: _drawn(r, "ABCDEF" + _DIGIT, 24, 64),
    lambda r: _drawn(r, _LOWER, 2, 4) + "-" + _drawn(r, _DIGIT, 8, 12) + "-" + _drawn(r, _UPPER + _LOWER + _DIGIT, 16, 32),
    lambda r: "-".join(_drawn(r, _UPPER + _DIGIT, 5, 5) for _ in range(5)),
]
#: What is no key, by rule, from words of drawn text.
PLAIN: list[Callable] = [
    lambda r, w: "-".join(_drawn(r, "abcdef" + _DIGIT, n, n) for n in (8, 4, 4, 4, 12)),
    lambda r, w: "".join(x.capitalize() for x in r.choice(w, int(r.integers(2, 6)))),
    lambda r, w: str(r.choice(["_", "-"])).join(r.choice(w, int(r.integers(2, 6)))),
    lambda r, w: "_".join(r.choice(w, int(r.integers(2, 5)))).upper(),
    lambda r, w: "/".join(r.choice(w, int(r.integers(2, 7)))) + str(r.choice(["", _drawn(r, _DIGIT, 1, 4)])),
    lambda r, w: _drawn(r, _DIGIT, 6, 20),
    lambda r, w: f"{r.integers(1950, 2050)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}" + str(r.choice(["", f"T{r.integers(0, 24):02d}"])),
    lambda r, w: str(r.choice(w)) + _drawn(r, _DIGIT, 1, 6),
    lambda r, w: str(r.choice(list("=-_+/"))) * int(r.integers(6, 60)),
    lambda r, w: "".join(x.capitalize() for x in r.choice(w, 2)) + _drawn(r, _DIGIT, 1, 4) + str(r.choice(w)),
    lambda r, w: "+" + _drawn(r, _DIGIT, 1, 3) + "-" + _drawn(r, _DIGIT, 3, 3) + "-" + _drawn(r, _DIGIT, 4, 8),
]


#: Sorts of examples: other candidates of letters alone, those with digits or signs, base findings; drawn ones that are no keys, and keys.
LETTERS, ODD, BASE, NO_KEY, KEY = range(5)


class Examples:
    """Some (before, value, after) as candidates in one array of characters."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        part = Texts(["".join(r) for r in rows], scan=False)
        self.chars = part.chars
        self.start = part.begin + np.array([len(r[0]) for r in rows], np.int64)
        self.end = self.start + np.array([len(r[1]) for r in rows], np.int64)


#: Letters of counted runs: the classes, ":" apart since it ends a candidate, and a mark around the value of a base finding.
_COLON, _MARK, _LETTERS = CLASSES, CLASSES + 1, CLASSES + 2
_ALPHABET = _TABLE.copy()
_ALPHABET[ord(":")] = _COLON
_CHARS = ["\0", *([chr(c) for c in range(1, 255) if _ALPHABET[c] == k and (k < 15 or c > 191)] for k in range(1, CLASSES)), ":", "\1"]


def _grams(letters: np.ndarray) -> np.ndarray:
    """Codes of all runs of GRAM letters."""
    n = len(letters) - GRAM + 1
    code = np.zeros(n, np.int64)
    for i in range(GRAM):
        code = code * _LETTERS + letters[i : i + n]
    return code


class Chain:
    """Text drawn letter by letter from counted runs (sorted codes, counts)."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes, self.ends = array("q", codes.tobytes()), array("q", np.concatenate([[0], np.cumsum(counts)]).tobytes())

    def draw(self, rng: np.random.Generator, size: int) -> str:
        """About size characters; the chain begins and ends between two texts. None if nothing was counted."""
        rest, top, out, at = 0, _LETTERS ** (GRAM - 1), [], 0
        u = rng.random((2, 1024)).tolist()
        while len(self.codes) and (len(out) < size or rest):
            if at == 1024:
                u, at = rng.random((2, 1024)).tolist(), 0
            i, j = bisect_left(self.codes, rest * _LETTERS), bisect_left(self.codes, (rest + 1) * _LETTERS)
            low = self.ends[i]
            letter = self.codes[bisect_right(self.ends, low + int(u[0][at] * (self.ends[j] - low)), i, j + 1) - 1] % _LETTERS
            out.append(_CHARS[letter][int(u[1][at] * len(_CHARS[letter]))])
            rest = (rest * _LETTERS + letter) % top
            at += 1
        return "".join(out)


def drawn(text: Chain, odd: Chain, base: Chain, seed: int) -> list[tuple[int, Examples]]:
    """(sort, examples) from the chains and the rules, at most DRAWN of each sort."""
    rng = np.random.default_rng(seed)
    part = Texts([text.draw(rng, DRAWN_CHARS)])
    t, (_, start, end) = part.texts[0], part.candidates()
    places = [(t[max(0, a - WIDTH) : a], t[a:b], t[b : b + WIDTH]) for a, b in zip((start - part.begin[0]).tolist(), (end - part.begin[0]).tolist())]
    if not places:
        return []
    words = np.array(sorted({w.lower() for _, v, _ in places for w in re.findall("[A-Za-z]{3,12}", v)}) or ["text"])
    put = lambda value: (lambda place: (place[0], value, place[2]))(places[int(rng.integers(len(places)))])
    whole = lambda chain: [tuple(x) for r in chain.draw(rng, DRAWN * 100).split("\0") if len(x := r.split("\1")) == 3 and x[1]][:DRAWN]
    rows = {
        LETTERS: [p for p in places if p[1].isalpha()][:DRAWN], ODD: whole(odd), BASE: whole(base),
        NO_KEY: [put(PLAIN[i % len(PLAIN)](rng, words)) for i in range(DRAWN)], KEY: [put(KEYS[i % len(KEYS)](rng)) for i in range(DRAWN)],
    }
    return [(sort, Examples(r)) for sort, r in rows.items() if r]


def _framed(letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Codes of the runs in values (start, end) between two marks and their contexts, each on its own."""
    n = end - start
    size = n + 2 * WIDTH + 2 + GRAM - 1
    row = np.repeat(np.arange(len(n)), size)
    k = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    after = WIDTH + 1 + n[row]  # place of the second mark
    out = letters[start[row] - WIDTH + k - (k > WIDTH) - (k > after)]
    out[(k == WIDTH) | (k == after)] = _MARK
    out[k > after + WIDTH] = 0
    return _grams(np.concatenate([np.zeros(GRAM - 1, out.dtype), out]))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, codes, counts) of the runs of whole texts (0), of candidates with digits or signs (1) and of base findings (2)."""
    total, found, held = np.zeros((3, _LETTERS**GRAM), np.int64), [[], [], []], 0
    for batch in batches:
        for _, part in Texts.slices([t or "" for t in batch.column(0).to_pylist()]):
            letters = _ALPHABET[part.chars]
            _, start, end = part.candidates()
            odd = part.odd(start, end)
            _, first, last = part.base_values()
            for k, code in enumerate((_grams(letters), _framed(letters, start[odd], end[odd]), _framed(letters, first, last))):
                found[k].append(code[code > 0])  # runs between texts say nothing
                held += len(code)
            if held > 1 << 20:
                _add(total, found)
                held = 0
    _add(total, found)
    for k, counts in enumerate(total):
        yield k, (at := np.flatnonzero(counts)), counts[at]


def _add(total: np.ndarray, found: list[list[np.ndarray]]) -> None:
    for k, codes in enumerate(found):
        if codes:
            total[k] += np.bincount(np.concatenate(codes), minlength=total.shape[1])
            codes.clear()


def _logit_counts(hidden: Iterator[tuple[int, np.ndarray]]) -> np.ndarray:
    """(sort, bin of the logit): examples."""
    bins = 2 * FAR * FINE
    out = np.zeros((5, bins), np.int64)
    for sort, z in hidden:
        out[sort] += np.bincount(np.clip(np.floor(z * FINE) + FAR * FINE, 0, bins - 1).astype(np.int64), minlength=bins)
    return out


def _logits(parts: list[tuple[int, Examples]], model: SecretModel) -> Iterator[tuple[int, np.ndarray]]:
    for sort, e in parts:
        for _, x in model.features(e.chars, e.start, e.end):
            yield sort, model.logit(x)


def _corpus_logits(batches: Iterator[pa.RecordBatch], model: SecretModel) -> Iterator[tuple[int, np.ndarray]]:
    """(sort, logits) of all base findings and other candidates of whole texts, some at a time."""
    for batch in batches:
        for _, part in Texts.slices([t or "" for t in batch.column(0).to_pylist()]):
            _, start, end = part.candidates()
            odd = part.odd(start, end)
            for at, x in model.features(part.chars, start, end):
                z = model.logit(x)
                yield LETTERS, z[~odd[at]]
                yield ODD, z[odd[at]]
            doc, start, end = part.base_values()
            at = part.begin[doc]
            rows = [(t[max(0, a - WIDTH) : a], t[a:b], t[b : b + WIDTH]) for t, a, b in zip((part.texts[d] for d in doc), (start - at).tolist(), (end - at).tolist())]
            if rows:
                yield from _logits([(BASE, Examples(rows))], model)


def fit_secrets(docs: DataFrame, seed: int = 3) -> SecretModel:
    """Fit and calibrate on all rows of docs(text), in two passes. Without base findings or without other candidates nothing is added to the base spans."""
    sc = tune(docs.sparkSession).sparkContext
    texts = docs.select("text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for which, code, n in _gram_counts(batches):
            yield pa.record_batch({"which": pa.array(np.full(len(code), which), pa.int64()), "code": pa.array(code, pa.int64()), "n": pa.array(n, pa.int64())})

    # At most three times 18 ** GRAM rows.
    runs = texts.mapInArrow(grams, "which long, code long, n long").groupBy("which", "code").agg(F.sum("n").alias("n")).toArrow()
    which, code, n = (runs[c].to_numpy() for c in runs.column_names)
    chains = []
    for k in range(3):
        of, count = code[which == k], n[which == k]
        order = np.argsort(of)
        chains.append(Chain(of[order], count[order]))
    # A value of a base finding stands between two marks.
    if n[(which == 2) & (code % _LETTERS == _MARK)].sum() < 16 or not (learned := drawn(*chains, seed)):
        return SecretModel()
    model = SecretModel()
    size = np.cumsum([0, *(len(e.chars) for _, e in learned)])
    start, end = (np.concatenate([getattr(e, side) + at for (_, e), at in zip(learned, size)]) for side in ("start", "end"))
    model.train(np.concatenate([e.chars for _, e in learned]), start, end, np.concatenate([np.full(len(e.start), float(sort in (BASE, KEY))) for sort, e in learned]), seed)
    held = sc.broadcast(model)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = _logit_counts(_corpus_logits(batches, held.value)).reshape(-1)
        at = np.flatnonzero(flat)
        yield pa.record_batch({"at": pa.array(at, pa.int64()), "n": pa.array(flat[at], pa.int64())})

    found = texts.mapInArrow(logits, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    # Of the drawn ones only those by rule: the corpus has all of the others.
    counts = _logit_counts(_logits([(s, e) for s, e in drawn(*chains, seed + 1) if s in (NO_KEY, KEY)], model))
    counts.reshape(-1)[found["at"].to_numpy()] += found["n"].to_numpy()
    return calibrated(model, counts) if counts[[LETTERS, ODD]].sum() >= 8 else SecretModel()


def calibrated(model: SecretModel, counts: np.ndarray) -> SecretModel:
    """The model with temperature and threshold from the counts of all logits, by sort and bin."""
    edge = np.arange(counts.shape[1]) / FINE - FAR
    z = edge + 0.5 / FINE
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    positive = np.isin(np.arange(5), (BASE, KEY))
    plus, minus = share[positive].mean(0), share[~positive].sum(0)
    grid = np.geomspace(0.1, 10, 41)
    t = float(min(grid, key=lambda t: float(plus @ np.logaddexp(0, -z / t) * 2 + minus @ np.logaddexp(0, z / t))))
    kept = plus[::-1].cumsum()[::-1]  # share of the positives in this bin and above
    at = int(np.flatnonzero(kept >= RECALL)[-1])
    above, other = counts[:, at:].sum(1), [LETTERS, ODD]
    out = replace(model, temperature=t, threshold=float(1 / (1 + np.exp(-np.clip(edge[at] / t, -30, 30)))))
    out.recall, out.precision, out.marked = float(kept[at]), float(above[positive].sum() / above.sum()), float(above[other].sum() / counts[other].sum())
    return out


def find_all(texts: list[str | None], model: SecretModel | None) -> Iterator[list[tuple[int, str, int]]]:
    """(start, kind, end) of all findings of each text, by start and then kind."""
    names = list(KINDS)
    rank = {k: i for i, k in enumerate([*names, "network"])}
    for _, part in Texts.slices([t or "" for t in texts]):
        out = [[(a, names[k], b) for a, k, b in base] for base in part.base]
        if model is not None and model.threshold < 1:
            doc, start, end = part.candidates()
            for i in np.flatnonzero(model.score(part.chars, start, end) >= model.threshold):
                at = int(part.begin[doc[i]])
                out[doc[i]].append((int(start[i]) - at, "network", int(end[i]) - at))
        for found in out:
            yield sorted(found, key=lambda s: (s[0], rank[s[1]]))


def find(text: str | None, model: SecretModel | None) -> list[tuple[int, str, int]]:
    """find_all of one text."""
    return next(find_all([text], model))


def scan_secrets(docs: DataFrame, model: SecretModel) -> DataFrame:
    """(doc_id, findings) for each row of docs(doc_id, text, ...): findings is an array of (kind, start, end).

    Offsets are code points, end exclusive, ordered by start and then kind. A null text is
    an empty one. Repeated rows repeat their findings, a null doc_id stays null.
    """
    held = tune(docs.sparkSession).sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b} for a, k, b in found] for found in find_all(batch.column(1).to_pylist(), held.value)]
            yield pa.record_batch({"doc_id": batch.column(0).cast(pa.int64()), "findings": pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))})

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, findings array<struct<kind:string,start:long,end:long>>")


def redact_secrets(docs: DataFrame, model: SecretModel) -> DataFrame:
    """docs with every finding in text replaced by <kind>, all rows and columns kept; n_chars, if there, is counted anew.

    Findings that overlap are one replacement each for what the one before left. A null text
    stays null, an empty one empty; an empty table gives none.
    """
    held = tune(docs.sparkSession).sparkContext.broadcast(model)
    at, schema = docs.columns.index("text"), docs.schema

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            column = batch.column(at).to_pylist()
            for text, found in zip(column, find_all(column, held.value)):
                done, parts = 0, []
                for a, k, b in found:
                    if b > done:
                        parts += [text[done:a] if a > done else "", f"<{k}>" if a >= done else ""]
                        done = b
                texts.append("".join(parts) + text[done:] if parts else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(redact, schema)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
