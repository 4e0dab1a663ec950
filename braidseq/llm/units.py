"""Words of texts as 64-bit hashes, in numpy, for a whole batch of texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE, _WORD_BASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.ones(1, U)


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection."""
    with np.errstate(over="ignore"):
        h = h + U(0x9E3779B97F4A7C15)
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def powers(n: int) -> np.ndarray:
    """_BASE ** 0..n-1 modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([[U(1)], np.multiply.accumulate(np.full(2 * n, _BASE, U))])
    return _POWERS[:n]


class Words:
    """The words of a batch of texts: hash, first byte and end byte of each; words first[i]:first[i+1] are text i's.

    data holds the texts one after the other, a newline after each; base[i] is where text i begins in it.
    """

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        a = np.frombuffer(self.data, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.base = np.concatenate([[0], np.cumsum(lengths)])
        space = _SPACE[a]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(a) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        n = self.end - self.start
        self.first = np.searchsorted(self.start, self.base)
        if not len(n):
            self.hash = np.empty(0, U)
            return
        at = np.flatnonzero(~space)
        within = np.arange(len(at)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        with np.errstate(over="ignore"):
            value = (a[at].astype(U) + U(1)) * powers(int(n.max()))[within]
            self.hash = mix(np.add.reduceat(value, np.concatenate([[0], np.cumsum(n)[:-1]])))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values (of any documents; the caller leaves out those that cross a border)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for i in range(1, k):
            out = out * _WORD_BASE + hashes[i : i + n]
    return mix(out)


def whole(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole sequence, of any length."""
    with np.errstate(over="ignore"):
        return mix(np.array([np.add.reduce(hashes[::-1] * powers(len(hashes))) + U(len(hashes))], U))[0]


def batches(texts, size: int = 1_000_000):
    """Runs of indices of texts of about so many characters each."""
    run, total = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        total += len(t) if t else 0
        if total >= size:
            yield run
            run, total = [], 0
    if run:
        yield run
