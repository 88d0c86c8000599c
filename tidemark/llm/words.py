"""Vectorised words, word hashes and shingles over Arrow text batches.

Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR, the
class ``[^\\x20\\x09-\\x0D]+``; UTF-8 continuation bytes never fall into it, so
working on bytes gives the same words as working on characters.
Hashes are 64-bit polynomials over random byte weights, finished by a mixing
bijection; equal words hash equally wherever they stand. Hashes only find what
may be equal: whatever decides a result compares the words themselves, or their
BLAKE2b names of 128 bits where the words are in another partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _weights(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


WEIGHT = _weights(7)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE, GRAM = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inverse)):
                    x = np.full(n + (n >> 2), b, U)
                    x[0] = 1
                    setattr(self, name, np.cumprod(x))
        return self.up[:n], self.down[:n]


_BYTES, _GRAMS = Powers(BASE), Powers(GRAM)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset :]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(col: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) in pieces of about ``most`` bytes, whole texts each."""
    data, off = buffers(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word and the index of each text's first word, n + 1 long."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    edge = off[(off > 0) & (off < n)]
    before[edge], after[edge - 1] = False, False
    start = np.flatnonzero(word & ~before)
    return start, np.flatnonzero(word & ~after) + 1, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _BYTES.get(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(WEIGHT[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes, also of those across texts."""
    if len(h) < n:
        return np.zeros(0, U)
    up, down = _GRAMS.get(len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(h) - n + 1])


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, a word of each number): equal numbers within the chunk mean equal bytes.

    Hashes only propose what may be equal; every word is compared with the one
    that speaks for its hash, and hashes that stand for several words are told
    apart by their bytes.
    """
    _, rep, ids = np.unique(h, return_index=True, return_inverse=True)
    if not len(h):
        return ids, rep
    lead, length = rep[ids], end - start
    first = np.concatenate([[0], np.cumsum(length)])
    own = np.arange(first[-1]) + np.repeat(start - first[:-1], length)
    other = np.minimum(own + np.repeat(start[lead] - start, length), len(data) - 1)
    wrong = (length != length[lead]) | np.logical_or.reduceat(data[own] != data[other], first[:-1])
    if wrong.any():
        raw, known = data.tobytes(), {}
        for i in np.flatnonzero(np.isin(ids, ids[wrong])).tolist():
            ids[i] = known.setdefault(raw[start[i] : end[i]], (len(rep) + len(known), i))[0]
        rep = np.concatenate([rep, [i for _, i in known.values()]])
    return ids, rep


def names(data: np.ndarray, start: np.ndarray, end: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """(numbers, 2) uint64: BLAKE2b names of 128 bits of the chunk's different words, the same in every chunk."""
    raw = data.tobytes()
    b = [hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(start[rep].tolist(), end[rep].tolist(), strict=True)]
    return np.frombuffer(b"".join(b), U).reshape(len(rep), 2)


class Shingles(NamedTuple):
    """Distinct shingles of texts, by text and hash; ``at`` is the first word, ``ids`` and ``rep`` as of ``word_ids``."""

    el: np.ndarray
    off: np.ndarray
    at: np.ndarray
    size: np.ndarray
    ids: np.ndarray
    rep: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def same(self, i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
        """Whether shingles i and j are the same words."""
        out = self.size[i] == self.size[j]
        for k in range(n):
            has = self.size[i] > k
            x, y = np.where(has, self.at[i] + k, 0), np.where(has & out, self.at[j] + k, 0)
            out &= ~has | (self.ids[x] == self.ids[y])
        return out

    def numbers(self, n: int) -> np.ndarray:
        """A number for each shingle, equal within the chunk if and only if the words are."""
        order = np.argsort(self.el, kind="stable")
        el = self.el[order]
        alike = np.flatnonzero(el[1:] == el[:-1])
        if self.same(order[alike], order[alike + 1], n).all():
            new = np.ones(len(el), np.int64)
            new[alike + 1] = 0
            out = np.empty(len(el), np.int64)
            out[order] = np.cumsum(new)
            return out
        # one hash stands for several shingles: number the words themselves
        rows = np.stack([np.where(self.size > k, self.ids[np.where(self.size > k, self.at + k, 0)], -1) for k in range(n)], axis=1)
        return np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1).astype(np.int64)

    def digests(self, data: np.ndarray, n: int) -> list[bytes | None]:
        """A BLAKE2b digest of each text's set of shingles by the names of their words; None for empty sets."""
        if not len(self.el):
            return [None] * (len(self.off) - 1)
        name = names(data, self.start, self.end, self.rep)
        rows = np.zeros((len(self.el), 2 * n + 1), U)
        rows[:, 0] = self.size
        for k in range(n):
            has = self.size > k
            rows[has, 2 * k + 1 : 2 * k + 3] = name[self.ids[self.at[has] + k]]
        doc = np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))
        same = (self.el[1:] == self.el[:-1]) & (doc[1:] == doc[:-1])
        if same.any():
            # shingles of one hash stand in the order of their words' names
            rows = rows[np.lexsort((*rows.T, self.el, doc))]
        return [
            hashlib.blake2b(rows[i:j].tobytes(), digest_size=16).digest() if j > i else None
            for i, j in zip(self.off[:-1].tolist(), self.off[1:].tolist(), strict=True)
        ]


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> Shingles:
    """The distinct n-word shingles of each text, told apart by their words.

    A text of fewer than n words, but one at least, has its whole sequence as
    its one shingle. Different shingles of one hash are separate entries with
    equal hashes.
    """
    start, end, first = spans(data, off)
    h, counts = word_hashes(data, start, end), np.diff(first)
    ids, rep = word_ids(data, start, end, h)
    grams = gram_hashes(h, n)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(np.arange(len(grams)) + n <= first[1:][doc[: len(grams)]])
    el, owner, size = grams[at], doc[at], np.full(len(at), n)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.zeros(len(short), U)
        with np.errstate(over="ignore"):
            for i in range(n - 1):
                has = counts[short] > i
                whole[has] = whole[has] * U(GRAM) + h[first[short[has]] + i] + U(1)
        el, owner = np.concatenate([el, mix(whole + counts[short].astype(U))]), np.concatenate([owner, short])
        at, size = np.concatenate([at, first[short]]), np.concatenate([size, counts[short]])
    order = np.lexsort((el, owner))
    el, owner, at, size = el[order], owner[order], at[order], size[order]
    made = Shingles(el, off, at, size, ids, rep, start, end)
    new = np.ones(len(el), bool)
    alike = np.flatnonzero((el[1:] == el[:-1]) & (owner[1:] == owner[:-1]))
    if made.same(alike, alike + 1, n).all():
        new[alike + 1] = False
    else:
        number = made.numbers(n)
        order = np.lexsort((number, el, owner))
        el, owner, at, size, number = el[order], owner[order], at[order], size[order], number[order]
        new[1:] = (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])
    return Shingles(el[new], np.searchsorted(owner[new], np.arange(len(counts) + 1)), at[new], size[new], ids, rep, start, end)
