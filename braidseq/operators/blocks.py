"""Likelihoods and expected counts of sequences of symbols read in blocks, for models of few states and symbols.

What a model makes of a block of symbols is one small matrix, and a pass over the data needs few kinds of them. So a sequence is coded once as numbers of
blocks; a pass moves from block to block, sums for each kind what came before and after it, and counts within the kinds only.
"""

from __future__ import annotations

from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..plans.models import Model
from .hmm import unpacked

#: Kinds of blocks at most, symbols of a block, states of a model.
KINDS, LONGEST, STATES = 2048, 6, 4


def size(symbols: int) -> int:
    """Symbols of a block, one more kind of symbol being the missing one; 0 where blocks don't pay."""
    return max((k for k in range(2, LONGEST + 1) if (symbols + 1) ** k <= KINDS), default=0)


def fits(models: list[Model]) -> bool:
    """Models of one alphabet, one transition class and few states that all speak, without history."""
    return all(m.b is not None and not m.order and len(m.a) == 1 and m.n <= STATES and not m.silent.any() and m.symbols == models[0].symbols for m in models) and size(models[0].symbols) > 0


def codes(obs: np.ndarray, lengths: np.ndarray, symbols: int) -> np.ndarray:
    """(block, sequence): 0 past the end; then blocks that others follow; then last blocks by length."""
    base, k, o = symbols + 1, size(symbols), obs.astype(int)
    inside = np.arange(obs.shape[1]) < lengths[:, None]
    if ((o < 0) | (o > symbols))[inside].any():
        raise ValueError("a symbol is out of range")
    steps = -(-obs.shape[1] // k)
    o = np.pad(np.where(inside, o, 0), ((0, 0), (0, steps * k - obs.shape[1]))).reshape(len(o), steps, k)
    number = np.zeros((len(o), steps), int)
    for i in range(k):
        number = number * base + o[:, :, i]
    left = lengths[:, None] - np.arange(steps) * k
    short = np.clip(left, 0, k)
    number //= base ** (k - short)  # of a short block its own symbols only
    first = 1 + base**k + np.concatenate([[0, 0], np.cumsum(base ** np.arange(1, k))])
    return np.where(left > k, 1 + number, np.where(left > 0, first[short] + number, 0)).T.astype(np.uint16)


def coded(blocks: DataFrame, symbols: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Packed sequences (see hmm.packed) with codes in place of obs."""

    def run(frames):
        for x in unpacked(frames):
            got = {"ids": x["ids"], "codes": codes(x["obs"], x["lengths"], symbols), **{c: x[c] for c in ("lengths", "weight", *more)}}
            yield pd.DataFrame({c: [np.ascontiguousarray(v).tobytes()] for c, v in got.items()})

    return blocks.mapInPandas(run, ", ".join(f"{c} binary" for c in ("ids", "codes", "lengths", "weight", *more)))


class Kinds:
    """A model's matrices by kind of block, each of any scale, with its logarithm; and sums over the sequences that were added."""

    def __init__(self, m: Model):
        self.m, self.n, self.base, self.size = m, m.n, m.symbols + 1, size(m.symbols)
        self.start = m.a[0][0] if m.from_first else m.pi
        self.says = np.concatenate([m.b, np.ones((m.n, 1))], axis=1).T  # by symbol, a missing one last
        single = self.says[:, :, None] * np.eye(m.n)
        x, log = self._scaled(single)
        self.read, logs = [None, x], [None, log]
        for k in range(2, self.size + 1):
            x, log = self._scaled(((self.read[-1] @ m.a[0])[:, None] @ single[None]).reshape(-1, m.n, m.n))
            self.read.append(x)
            logs.append(log + np.repeat(logs[-1], self.base))
        on, log = self._scaled(self.read[-1] @ m.a[0])
        table = np.concatenate([np.eye(m.n)[None], on, *self.read[1:]])
        self.table, self.log = np.ascontiguousarray(table.transpose(1, 2, 0)), np.concatenate([[0.0], log + logs[-1], *logs[1:]])
        self.ways: list = []
        self._empty()

    def _empty(self) -> None:
        self.sums = np.zeros((self.n, self.n, len(self.log)))
        self.pi, self.logp = np.zeros(self.n), np.zeros(2)

    def fresh(self) -> Kinds:
        """The same matrices with sums of its own."""
        out = copy(self)
        out._empty()
        return out

    @staticmethod
    def _scaled(x):
        top = x.max(axis=(1, 2))
        safe = np.where(top > 0, top, 1)
        return x / safe[:, None, None], np.log(safe)

    def _forward(self, c, lengths):
        """Scores before each block, their sums after it, first sequence that has it, log-likelihoods (nan: impossible)."""
        n, blocks = self.n, -(-lengths // self.size)
        now = np.repeat(self.start[:, None].astype(float), c.shape[1], axis=1)
        logp, seen = np.zeros(c.shape[1]), []
        with np.errstate(divide="ignore"):
            for s in range(len(c)):
                lo = int(np.searchsorted(blocks, s, "right"))  # they come in order of length
                if lo == c.shape[1]:
                    break
                kind, p = c[s, lo:], now[:, lo:]
                x = np.stack([sum(p[i] * self.table[i, j].take(kind) for i in range(n)) for j in range(n)])
                total = x.sum(axis=0)
                logp[lo:] += np.log(total) + self.log.take(kind)
                total = np.where(total > 0, total, 1)
                seen.append((lo, kind, p.copy(), total))
                np.divide(x, total, out=p)
        return seen, np.where(np.isfinite(logp), logp, np.nan)

    def loglik(self, c: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self._forward(c, lengths)[1]

    def add(self, c: np.ndarray, lengths: np.ndarray, weight: np.ndarray) -> None:
        seen, logp = self._forward(c, lengths)
        some = lengths > 0
        ok = ~np.isnan(logp) & some
        self.logp += [np.where(ok, logp * weight, 0).sum(), (weight * (~ok & some)).sum()]
        w = np.where(ok, weight, 0.0)
        after = np.ones((self.n, c.shape[1]))
        for lo, kind, p, total in reversed(seen):
            right = after[:, lo:] / total
            left = p * w[lo:]
            for i in range(self.n):
                for j in range(self.n):
                    self.sums[i, j] += np.bincount(kind, left[i] * right[j], len(self.log))
            after[:, lo:] = np.stack([sum(self.table[i, j].take(kind) * right[j] for j in range(self.n)) for i in range(self.n)])
        self.pi += (self.start[:, None] * after * w).sum(axis=1)

    def _places(self) -> list:
        """For each length of a block, last and other: the place in the table, and for its symbols from the last on: the symbol by kind, what is read up to it, what follows a move from it (None: no move), what follows it."""
        if not self.ways:
            at, one = 1, np.eye(self.n)[:, :, None]
            for length, followed in [(self.size, True), *((k, False) for k in range(1, self.size + 1))]:
                number, places, after = np.arange(self.base**length), [], one if followed else None
                rest = self.m.a[0][:, :, None] if followed else one
                for k in range(length, 0, -1):
                    symbol = number // self.base ** (length - k) % self.base
                    read = np.ascontiguousarray(self.read[k][number // self.base ** (length - k)].transpose(1, 2, 0))
                    places.append((symbol, read, after, rest))
                    after = self.says[symbol].T[:, None] * rest
                    top = after.max(axis=(0, 1))
                    after = after / np.where(top > 0, top, 1)
                    rest = np.einsum("pq,qjw->pjw", self.m.a[0], after)
                self.ways.append((slice(at, at + len(number)), places))
                at += len(number)
        return self.ways

    def counts(self) -> dict[str, np.ndarray]:
        """Expected counts of all that was added, as training.counted gives them."""
        a, says = np.zeros((self.n, self.n)), np.zeros((self.base, self.n))
        for on, places in self._places():
            x = self.sums[:, :, on]
            if not x.any():
                continue
            held = (x * self.table[:, :, on]).sum(axis=(0, 1))
            for symbol, read, after, rest in places:
                before = np.einsum("ipw,ijw->pjw", read, x)
                if after is not None:
                    move = self.m.a[0][:, :, None] * np.einsum("pjw,qjw->pqw", before, np.broadcast_to(after, x.shape))
                    a += move @ self._share(held, move.sum(axis=(0, 1)))
                in_state = (before * rest).sum(axis=1)
                in_state = in_state * self._share(held, in_state.sum(axis=0))
                for s in range(self.n):
                    says[:, s] += np.bincount(symbol, in_state[s], self.base)
        return {"logp": self.logp, "pi": self.pi, "a": a[None], "b": says[:-1].T.copy()}

    @staticmethod
    def _share(held, total):
        return np.divide(held, total, out=np.zeros_like(held), where=total > 0)
