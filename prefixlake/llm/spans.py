"""Words of many texts at once as numpy arrays, inside Spark tasks.

A slice of texts becomes one array of code points with one separator after each text. Words are runs of code points of a
class; a 64-bit polynomial hash of every word comes from prefix sums, so no Python loop runs over words.
"""

from functools import lru_cache

import numpy as np
import pyarrow.compute as pc

#: Code points in a slice; a longer text is a slice of its own.
SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def slices(batches, column="text", limit=SLICE):
    """(rows, their texts) with at most `limit` code points each, or one row; null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) + 1)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            part = batch.slice(start, end - start)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            start = end


class Texts:
    """`text`: all texts, joined; `cps`: its code points; text i is at starts[i]:ends[i]; `gaps`: the separators."""

    def __init__(self, texts: list[str]):
        self.text = "\n".join(texts) + "\n"
        self.cps = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.gaps = np.cumsum(lengths + 1) - 1
        self.starts = self.gaps - lengths
        self.ends = self.gaps

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs where `inside` holds; no run crosses a separator."""
        inside = inside.copy()
        inside[self.gaps] = False
        step = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def owner(self, starts: np.ndarray) -> np.ndarray:
        """Index of the text that each position lies in."""
        return np.searchsorted(self.gaps, starts, "right")

    def bounds(self, starts: np.ndarray) -> np.ndarray:
        """Text i has the spans bounds[i]:bounds[i + 1] of the sorted `starts`."""
        return np.concatenate(([0], np.searchsorted(starts, self.gaps)))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    both = []
    for x in (_BASE, inverse):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p))
    return both[0], both[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE + 2, n) if n <= SLICE + 2 else 1 << (n - 1).bit_length()
    return _powers(size)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the code points of each span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(cps) + 1)
    x = (cps.astype(np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    x *= up[: len(cps)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x)))
    return mixed((sums[ends] - sums[starts]) * down[starts])


@lru_cache(1)
def _plain_words() -> tuple[np.ndarray, np.ndarray]:
    word = np.ones(0x110000, bool)
    word[:0x80] = False
    lower = np.arange(0x110000, dtype=np.uint32)
    for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
        word[a:b] = True
    lower[0x41:0x5B] += 32
    return word, lower


def plain_words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of `t`: runs of ASCII letters (in lower case) and digits and all beyond ASCII."""
    word, lower = _plain_words()
    starts, ends = t.runs(word[t.cps])
    return starts, ends, span_hashes(lower[t.cps], starts, ends)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` words in a row; window i starts at word i."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _BASE + hashes[k : k + n]
    return mixed(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0] + 1, ... for lengths[0], then the same for the next, and so on."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
