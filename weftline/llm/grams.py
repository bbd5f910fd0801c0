"""Hashed character n-grams over whole batches of text, and a sparse linear model on them.

All texts of a batch become one vector of code points; n-gram indices, table
look-ups and sums over lines are array operations, so no Python code runs per
character or per word.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass, field

import numpy as np

_BREAK, _GAP, _DIGIT = 10, 32, 48
_FOLD: dict[bool, np.ndarray] = {}


def _fold_table(keep_marks: bool) -> np.ndarray:
    """Code point -> lower-case letter, digit class (48), line feed (10), blank (32) or, with ``keep_marks``, the mark itself (private code points too)."""
    if keep_marks not in _FOLD:
        t = np.full(0x110000, _GAP, dtype=np.uint32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
            elif ch.isdigit():
                t[c] = _DIGIT
            elif keep_marks and c > 32 and unicodedata.category(ch)[0] in "PS":
                t[c] = c
        if keep_marks:
            t[0xE000:0xF900] = np.arange(0xE000, 0xF900)  # private use: marks that callers add
        t[_BREAK] = _BREAK
        _FOLD[keep_marks] = t
    return _FOLD[keep_marks]


@dataclass
class Lines:
    """Lines of a list of texts as one vector of folded code points; every line ends with a line feed."""

    chars: np.ndarray  #: folded, runs of blanks collapsed
    starts: np.ndarray  #: index in ``chars`` of the first character of each line
    letters: np.ndarray  #: letters of each line
    text_of: np.ndarray  #: index of the text that a line is from
    number: np.ndarray  #: number of the line within its text, from 0


def fold(texts: list[str], keep_marks: bool = False, split: bool = True) -> Lines:
    """Folded lines of ``texts``; with ``split=False`` a text is one line and its line feeds are blanks."""
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1  # of the feed after each text
    f = _fold_table(keep_marks)[raw]
    if not split:
        inner = f == _BREAK
        inner[ends] = False
        f[inner] = _GAP
    gap = f == _GAP
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    feeds = np.flatnonzero(f == _BREAK)
    letter = (f > 64) & ((f < 91) | (f > 96)) if not keep_marks else _is_letter()[raw]
    count = np.concatenate(([0], np.cumsum(letter)))
    first = np.concatenate(([0], feeds[:-1] + 1))
    at = np.cumsum(keep) - 1  # index in chars of a kept character
    chars = f[keep]
    text_of = np.searchsorted(ends, feeds, side="left")
    lead = np.concatenate(([0], np.cumsum(np.bincount(text_of, minlength=len(texts)))))[:-1]
    starts = np.concatenate(([0], at[feeds[:-1]] + 1))
    return Lines(chars, starts, count[feeds] - count[first], text_of, np.arange(len(feeds)) - lead[text_of])


_LETTER: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTER:
        t = np.zeros(0x110000, dtype=bool)
        t[:] = [chr(c).isalpha() for c in range(sys.maxunicode + 1)]
        _LETTER.append(t)
    return _LETTER[0]


def indices(chars: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each character; 0 if it would cross the end of a line."""
    h = np.full(len(chars), 2166136261 + 97 * n, dtype=np.uint32)
    crosses = np.zeros(len(chars), dtype=bool)
    for k in range(n):
        c = chars[k:]
        m = len(c)
        h[:m] = (h[:m] ^ c) * np.uint32(0x9E3779B1)
        h[:m] ^= h[:m] >> np.uint32(15)
        crosses[:m] |= c == _BREAK
        crosses[m:] = True
    out = (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)
    out = np.maximum(out, 1)
    out[crosses] = 0
    return out


def line_sums(lines: Lines, table: np.ndarray, orders: tuple[int, ...], bits: int, step: int = 1 << 18) -> np.ndarray:
    """Sum over each line of the table rows of its n-grams (row 0 must be zero)."""
    out = np.zeros((len(lines.starts), table.shape[1]), dtype=np.float32)
    bounds = np.append(lines.starts, len(lines.chars))
    a = 0
    while a < len(lines.starts):  # whole lines, about ``step`` characters at a time
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + step, side="right")) - 1)
        chars = lines.chars[bounds[a] : bounds[b]]
        rel = bounds[a:b] - bounds[a]
        for n in orders:
            out[a:b] += np.add.reduceat(table[indices(chars, n, bits)], rel, axis=0)
        a = b
    return out


@dataclass
class LinearModel:
    """Multinomial logistic regression on TF-IDF n-grams, softened by a temperature."""

    labels: list[str]
    orders: tuple[int, ...]
    bits: int
    table: np.ndarray  #: buckets x (classes + 1): idf-weighted weights, and the squared idf
    bias: np.ndarray
    temperature: float = 1.0
    report: dict = field(default_factory=dict)

    def scores(self, lines: Lines) -> np.ndarray:
        """Class scores of each line, divided by the temperature."""
        s = line_sums(lines, self.table, self.orders, self.bits)
        norm = np.sqrt(np.maximum(s[:, -1:], 1e-6))
        return (s[:, :-1] / norm + self.bias) / self.temperature


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    texts: list[str],
    target: np.ndarray,
    labels: list[str],
    orders: tuple[int, ...] = (1, 3),
    bits: int = 16,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 1e-3,
    l2: float = 1e-3,
    epochs: int = 2,
    batch: int = 32,
    keep_marks: bool = False,
    clean: float = 0.0,
    seed: int = 7,
) -> LinearModel:
    """Follow-the-regularised-leader with an elastic net; a tenth of the rows sets the temperature.

    With ``clean`` > 0 the model is fitted twice; rows whose own label gets
    less than that probability in the first fit are left out of the second
    (wrong labels).  Each text is one row; its line feeds count as blanks.
    """
    k, d = len(labels), 1 << bits
    lines = fold(texts, keep_marks, split=False)
    bounds = np.append(lines.starts, len(lines.chars))
    grams = [indices(lines.chars, n, bits).astype(np.int32) for n in orders]
    df = np.zeros(d, dtype=np.int64)
    for s in range(0, len(texts), 1000):  # rows that hold an n-gram, a slice of rows at a time
        lo, hi = bounds[s], bounds[min(s + 1000, len(texts))]
        own = np.repeat(np.arange(len(bounds[s : s + 1001]) - 1), np.diff(bounds[s : s + 1001])).astype(np.int64) * d
        df += np.bincount(np.unique(np.concatenate([own + g[lo:hi] for g in grams])) % d, minlength=d)
    df[0] = 0
    idf = np.where(df > 0, np.log((1 + len(texts)) / (1 + df)) + 1, 0).astype(np.float32)
    norm = np.sqrt(np.maximum(sum(np.add.reduceat(idf[g] ** 2, bounds[:-1]) for g in grams), 1e-6))
    rng = np.random.default_rng(seed)
    perm = rng.permutation(len(texts))
    held, rest = perm[: len(perm) // 10], perm[len(perm) // 10 :]
    ok = np.ones(len(texts), dtype=bool)
    w = bias = None
    for attempt in range(2 if clean else 1):
        z, nn, w = np.zeros((d, k)), np.zeros((d, k)), np.zeros((d, k))
        zb, nb, bias = np.zeros(k), np.zeros(k), np.zeros(k)
        for _ in range(epochs):
            todo = rng.permutation(rest[ok[rest]])
            for s in range(0, len(todo), batch):
                r = todo[s : s + batch]
                size = bounds[r + 1] - bounds[r]
                at = np.repeat(bounds[r] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                own = np.tile(np.repeat(np.arange(len(r)), size), len(orders))
                ii = np.concatenate([g[at] for g in grams])
                v = idf[ii] / norm[r][own]
                u, inv = np.unique(ii, return_inverse=True)
                wu = w[u]
                logits = np.stack([np.bincount(own, weights=v * wu[inv, c], minlength=len(r)) for c in range(k)], axis=1) + bias
                g = softmax(logits)
                g[np.arange(len(r)), target[r]] -= 1
                gu = np.stack([np.bincount(inv, weights=v * g[own, c], minlength=len(u)) for c in range(k)], axis=1)
                for grad, zz, n2, cur, put in ((gu, z[u], nn[u], wu, True), (g.sum(axis=0), zb, nb, bias, False)):
                    sigma = (np.sqrt(n2 + grad**2) - np.sqrt(n2)) / alpha
                    zz = zz + grad - sigma * cur
                    n2 = n2 + grad**2
                    new = np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n2)) / alpha + l2))
                    if put:
                        z[u], nn[u], w[u] = zz, n2, new
                    else:
                        zb, nb, bias = zz, n2, new
        table = np.concatenate([w * idf[:, None], (idf**2)[:, None]], axis=1).astype(np.float32)
        table[0] = 0
        model = LinearModel(labels, orders, bits, table, bias.astype(np.float32))
        if clean and attempt == 0:
            p = softmax(model.scores(lines))
            ok = p[np.arange(len(texts)), target] >= clean
    h = held[ok[held]]
    s = model.scores(lines)[h]
    if len(h):
        y = target[h]

        def loss(t: float) -> float:
            return float(-np.log(np.maximum(softmax(s / t)[np.arange(len(h)), y], 1e-12)).mean())

        model.temperature = min((0.05 * 1.15**i for i in range(45)), key=loss)
        model.report = {"rows": int(ok.sum()), "left_out": int((~ok).sum()), "held_out": len(h), "accuracy": float((s.argmax(axis=1) == y).mean()), "zero_share": float((w == 0).mean())}
    return model
