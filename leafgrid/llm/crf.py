"""A linear-chain conditional random field over the words of texts, in numpy.

A word's potentials are sums of weights of hashed features: the word itself, its prefixes and suffixes, its
character n-grams.  Transitions between neighbouring words are learned with them.  ``marginals`` runs
forward-backward exactly, many words at once: the chain is cut into rows, the rows' transfer matrices are
multiplied up, and every row then starts from what stands before and after it.
"""

from __future__ import annotations

import re
import sys
from itertools import repeat

import numpy as np

SLOTS = 1 << 18
WIDTH = 32
# fractions, circled and Roman figures count as word characters, but are no letters
_FIGURES = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
LETTERS = re.compile(rf"[^\W\d_]{{1,{WIDTH}}}")
#: Takes ten times as long; for texts with such figures only.
STRICT = re.compile(rf"[^\W\d_{_FIGURES}]{{1,{WIDTH}}}")
KEPT = 200_000
ROW = 128
CHUNK_WORDS = 100_000


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters; longer ones than WIDTH are several words, so that every letter counts."""
    text = (text or "").lower()
    found = LETTERS.findall(text)
    return found if all(map(str.isalpha, found)) else STRICT.findall(text)


def places_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of every word of ``words_of`` in the text, in code points."""
    low = text.lower()
    letters = LETTERS if all(map(str.isalpha, LETTERS.findall(low))) else STRICT
    found = [m.span() for m in letters.finditer(low)]
    if len(low) == len(text):
        return found
    # lower case may take more letters than the text has
    of = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
    return [(int(of[a]), int(of[b - 1]) + 1) for a, b in found]


def _hash(x):
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def features(words: list[str], grams=(2, 3), prefixes=(1, 2, 3, 4, 5, 6), suffixes=(1, 2, 3, 4)):
    """(row, slot) of every feature of every word.  ``words_of`` gives no word of more than WIDTH letters, so n-grams are those of all its letters."""
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    width = min(WIDTH, max(map(len, words)))
    size = np.fromiter(map(len, words), np.int64, n)
    code = np.array(words, f"U{width}").view(np.uint32).reshape(n, width).astype(np.uint64)
    back = np.array([w[-4:][::-1] for w in words], "U4").view(np.uint32).reshape(n, 4).astype(np.uint64)
    rows, slots, at = [], [], np.arange(n)
    base = np.uint64(0x100000001B3)

    def add(kind, keep, value):
        rows.append(at[keep])
        slots.append((_hash(_hash(value[keep] * np.uint64(64) + np.uint64(kind))) >> np.uint64(64 - 18)).astype(np.int64))

    def running(codes, lengths, first_kind, wanted):
        h = np.full(n, 7, np.uint64)
        for k in range(codes.shape[1]):
            h = h * base + codes[:, k]
            if k + 1 in wanted:
                add(first_kind + k + 1, lengths >= k + 1, h)
        return h

    whole = running(code, size, 0, prefixes)
    running(back, size, 20, suffixes)
    ends = np.fromiter((hash_text(w[width:]) for w in words), np.uint64, n) if size.max() > width else np.zeros(n, np.uint64)
    add(40, size > 0, whole * base + ends + size.astype(np.uint64))
    for g in grams:
        for k in range(width - g + 1):
            h = np.full(n, 11, np.uint64)
            for j in range(g):
                h = h * base + code[:, k + j]
            add(40 + g, size >= k + g, h)
    return np.concatenate(rows), np.concatenate(slots)


def hash_text(s: str) -> int:
    h = 0
    for b in s.encode("utf-8", "surrogatepass"):
        h = (h * 0x100000001B3 + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def _passes(log_p, start, trans, first):
    """Normalised forward and backward messages, and the potentials they were made of."""
    n, k = log_p.shape
    rows = -(-n // ROW)
    p = np.ones((rows * ROW, k))
    p[:n] = np.exp(log_p - log_p.max(1, keepdims=True))
    new = np.zeros(rows * ROW, bool)
    new[:n] = start
    new[n:] = True
    p, new = p.reshape(rows, ROW, k), new.reshape(rows, ROW)
    a, s = np.exp(trans), np.exp(first)
    # the product of each row's matrices
    m = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
    for t in range(ROW):
        step = m @ a
        at = new[:, t]
        if at.any():
            step[at] = m[at].sum(2, keepdims=True) * s
        m = step * p[:, t, None, :]
        m /= m.sum((1, 2), keepdims=True)
    before, after = np.empty((rows, k)), np.empty((rows, k))
    v = np.full(k, 1.0 / k)
    for r in range(rows):
        before[r] = v
        v = v @ m[r]
        v = v / v.sum()
    v = np.ones(k)
    for r in range(rows - 1, -1, -1):
        after[r] = v
        v = m[r] @ v
        v = v / v.sum()
    alpha, beta = np.empty((rows, ROW, k)), np.empty((rows, ROW, k))
    v = before
    for t in range(ROW):
        v = np.where(new[:, t, None], s, v @ a) * p[:, t]
        v = v / v.sum(1, keepdims=True)
        alpha[:, t] = v
    v = after
    for t in range(ROW - 1, -1, -1):
        beta[:, t] = v
        w = p[:, t] * v
        v = np.where(new[:, t, None], (w @ s)[:, None], w @ a.T)
        v = v / v.sum(1, keepdims=True)
    flat = (rows * ROW, k)
    return alpha.reshape(flat)[:n], beta.reshape(flat)[:n], p.reshape(flat)[:n]


def marginals(log_p, start, trans, first):
    """Probability of each label at each word; ``start`` marks the first word of each text."""
    if not len(log_p):
        return log_p
    alpha, beta, _ = _passes(log_p, start, trans, first)
    g = alpha * beta
    return g / g.sum(1, keepdims=True)


def fit(texts: list[list[str]], labels: list[list[int]], k: int, turns: int = 60, rate: float = 0.15, decay: float = 1e-6):
    """Weights by gradient ascent on the likelihood of the labelled sequences (Adam)."""
    flat = [w for t in texts for w in t]
    weight, trans, first = np.zeros((SLOTS, k)), np.zeros((k, k)), np.zeros(k)
    if not flat:
        return {"weight": weight.astype(np.float32), "trans": trans, "first": first}
    index = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    word = np.fromiter((index[w] for w in flat), np.int64, len(flat))
    gold = np.concatenate([np.asarray(x, np.int64) for x in labels])
    start = np.zeros(len(flat), bool)
    start[np.cumsum([0, *[len(t) for t in texts if t]])[:-1]] = True
    row, slot = features(list(index))
    used, slot = np.unique(slot, return_inverse=True)
    n, u = len(flat), len(index)
    hot = np.eye(k)[gold]
    pair = np.flatnonzero(~start)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[pair - 1], gold[pair]), 1)
    x = [np.zeros((len(used), k)), trans, first]
    m, v = [np.zeros_like(z) for z in x], [np.zeros_like(z) for z in x]
    by = np.argsort(row, kind="stable")
    row, slot = row[by], slot[by]
    head = np.searchsorted(row, np.arange(u))
    for turn in range(1, turns + 1):
        e = np.add.reduceat(x[0][slot], head, axis=0)
        alpha, beta, p = _passes(e[word], start, x[1], x[2])
        g = alpha * beta
        g /= g.sum(1, keepdims=True)
        q = p * beta
        z = np.einsum("ni,ij,nj->n", alpha[pair - 1], np.exp(x[1]), q[pair])
        both = np.exp(x[1]) * ((alpha[pair - 1] / z[:, None]).T @ q[pair])
        off = np.stack([np.bincount(word, (hot - g)[:, j], u) for j in range(k)], 1)
        up = np.stack([np.bincount(slot, off[row, j], len(used)) for j in range(k)], 1)
        grads = [up / n - decay * x[0], (seen - both) / n - decay * x[1], (hot - g)[start].sum(0) / n - decay * x[2]]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.99 * v[i] + 0.01 * d * d
            x[i] = x[i] + rate * (m[i] / (1 - 0.9**turn)) / (np.sqrt(v[i] / (1 - 0.99**turn)) + 1e-8)
    weight[used] = x[0]
    return {"weight": weight.astype(np.float32), "trans": x[1], "first": x[2]}


class Tagger:
    """Marginals for many texts; potentials of known words are kept, up to KEPT words."""

    def __init__(self, model):
        self.model, self.known = model, {}
        self.table = np.zeros((0, model["weight"].shape[1]), np.float32)

    def _rows(self, words):
        found = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = list(dict.fromkeys(words[i] for i in np.flatnonzero(found < 0).tolist()))
        if not new:
            return found
        if len(self.known) + len(new) > KEPT:
            self.known, self.table = {}, self.table[:0]
            new = list(dict.fromkeys(words))
        parts = [self.table]
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            row, slot = features(some)
            w = self.model["weight"]
            parts.append(np.stack([np.bincount(row, w[slot, j], len(some)) for j in range(w.shape[1])], 1).astype(np.float32))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.table = np.concatenate(parts)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def tag(self, texts: list[list[str]]) -> list[np.ndarray]:
        """One array (words, labels) per text."""
        size = [len(t) for t in texts]
        flat = [w for t in texts for w in t]
        if not flat:
            return [np.zeros((0, self.table.shape[1])) for _ in texts]
        ends = np.cumsum(size)
        start = np.zeros(len(flat), bool)
        start[(ends - size)[np.array(size) > 0]] = True
        g = marginals(self.table_of(flat), start, self.model["trans"], self.model["first"])
        return np.split(g, ends[:-1])

    def table_of(self, flat):
        rows = self._rows(flat)
        return self.table[rows].astype(np.float64)


def chunks(texts):
    """Groups of (position, words) with about CHUNK_WORDS words, to bound the work space."""
    group, total = [], 0
    for i, text in enumerate(texts):
        words = words_of(text)
        group.append((i, words))
        total += len(words)
        if total >= CHUNK_WORDS:
            yield group
            group, total = [], 0
    if group:
        yield group
