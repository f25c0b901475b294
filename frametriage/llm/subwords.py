"""Linear scores of texts from hashed words and character n-grams.

A text's features are its words and the character n-grams of each word between marks. Every score that is linear in
them is a sum over words, so a word's sums are computed once and remembered; a text costs a look-up for each word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np

from .common import LONG_WORD, MEMO_BYTES

BITS = 17
SHORTEST, LONGEST = 2, 5
GRID = 2.0**24
#: Bytes of words whose n-grams are held at the same time.
BLOCK = 1 << 16
#: Odd multipliers of 64 bits.
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all words and their n-grams, and the number of each one's word, block by block.

    N-grams are hashed together: each longer one from the shorter one at the same place, by multiply and add modulo 2^64.
    A block has those that begin in so many bytes, in the middle of a word too, so a word of any length takes no more memory.
    """
    marked = [f"<{w}>".encode() for w in words]
    ends = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))
    data = np.frombuffer(b"".join(marked), np.uint8)
    hashes, rows = [np.fromiter(map(zlib.crc32, marked), np.uint64, len(marked))], [np.arange(len(words))]
    for start in range(0, len(data), BLOCK):
        h = part = data[start : start + BLOCK + LONGEST - 1].astype(np.uint64)
        n = min(BLOCK, len(part))
        first, last = np.searchsorted(ends, [start, start + n - 1], side="right")
        own = ends[first : last + 1] - start
        sizes = np.diff(np.minimum(own, n), prepend=0)
        word, end = np.repeat(np.arange(first, last + 1), sizes), np.repeat(own, sizes)
        at = np.arange(n)
        for size in range(2, LONGEST + 1):
            h = h[:-1] * FACTOR + part[size - 1 :]
            if size >= SHORTEST:
                k = min(n, len(h))
                whole = at[:k] + size <= end[:k]
                hashes.append(h[:k][whole] * FACTOR + np.uint64(size))
                rows.append(word[:k][whole])
        yield (np.concatenate(hashes) * MIX >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows)
        hashes, rows = [], []


#: Begins what stands for a word n-gram of which only the pattern counts: a word, and the same one that far behind it.
PATTERN = "\x01"
BACK = [f"{PATTERN}{k}" for k in range(64)]


def words_of(text: str, patterns: bool = False) -> list[str]:
    """The words; with patterns, for each that stood before also how far back, in powers of two."""
    words = text.split()
    if patterns:
        last: dict[str, int] = {}
        found = []
        for i, w in enumerate(words):
            if w in last:
                found.append(BACK[(i - last[w]).bit_length()])
            last[w] = i
        words += found
    return words


def document(text: str, patterns: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares of the text's features."""
    counts = Counter(words_of(text, patterns))
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    often, n = np.fromiter(counts.values(), np.float64, len(counts)), np.zeros(1 << BITS)
    for ids, rows in grams(list(counts)):
        n += np.bincount(ids, weights=often[rows], minlength=1 << BITS)
    ids = np.flatnonzero(n)
    return ids, (n[ids] / n.sum()).astype(np.float32)


class WordSums:
    """Sums of the rows of a table (bucket by score) over a text's features, and the number of features."""

    def __init__(self, table: np.ndarray, memo: int = MEMO_BYTES):
        #: Multiples of a power of 2, so that sums are exact and do not depend on what is remembered.
        self.table = np.round(table.astype(np.float64) * GRID) / GRID
        width = table.shape[1] + 1
        self.most = max(memo // (200 + 8 * width), 1024)
        self.rows = np.zeros((self.most, width))
        self.known: dict[str, int] = {}

    def words(self, words: list[str]) -> np.ndarray:
        """A row of sums for each word."""
        out = np.zeros((self.rows.shape[1], len(words)))
        for ids, rows in grams(words):
            for own, c in zip(out, [*self.table[ids].T, None], strict=True):
                own += np.bincount(rows, weights=c, minlength=len(words))
        return out.T

    def text(self, text: str, patterns: bool = False) -> np.ndarray:
        """Of the features' scores their mean, last their number."""
        words = words_of(text, patterns)
        total = np.zeros(self.rows.shape[1])
        at = list(map(self.known.get, words))
        if None in at:
            fresh = Counter(w for k, w in zip(at, words, strict=True) if k is None)
            counts, new = np.fromiter(fresh.values(), np.float64, len(fresh)), list(fresh)
            at = [k for k in at if k is not None]
            total += self.rows[at].sum(axis=0) if at else 0
            for k in range(0, len(new), self.most):
                sums = self.words(new[k : k + self.most])
                total += counts[k : k + self.most] @ sums
                self.remember(new[k : k + self.most], sums)
        else:
            total += self.rows[at].sum(axis=0) if at else 0
        total[:-1] /= max(total[-1], 1)
        return total

    def remember(self, words: list[str], sums: np.ndarray) -> None:
        """When there is no more room, all that is known goes first."""
        kept = [i for i, w in enumerate(words) if len(w) < LONG_WORD]
        if len(self.known) + len(kept) > self.most:
            self.known.clear()
        n = len(self.known)
        self.rows[n : n + len(kept)] = sums[kept]
        self.known.update((words[i], n + k) for k, i in enumerate(kept))
