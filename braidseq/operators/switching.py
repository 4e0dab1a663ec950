"""Switching models: the class of a move follows from the path that leads to its source.

A path counts its visits to some of the states (in a profile the match and delete states); class_of(counts, t) names the class
of the moves out of a state whose best path has counted so many, towards symbol t. Silent states are entered within
a step, in topological order, so a path may pass several of them between two symbols, before the first and after the last.
Each state keeps the best path that leads to it and that path's count. Sequences of like length go together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..plans.models import Model
from .hmm import emissions, padded


def in_classes(models: list[Model]) -> Model:
    """One switching model whose classes are the transitions of models that agree in all else."""
    first = models[0]
    if any(len(m.a) != 1 or m.n != first.n or not np.array_equal(m.b, first.b) or not np.array_equal(m.pi, first.pi) for m in models):
        raise ValueError("models that differ in more than their transitions")
    return replace(first, a=np.concatenate([m.a for m in models]))


def of_class(m: Model, k: int) -> Model:
    """The plain model with the transitions of one class."""
    return replace(m, a=m.a[k : k + 1])


def _silent_order(m: Model) -> list[int]:
    """Silent states in topological order of the moves of all classes; a cycle of silent states is an error."""
    left, out = [int(s) for s in np.flatnonzero(m.silent)], []
    while left:
        free = [s for s in left if not any((m.a[:, p, s] > 0).any() for p in left)]
        if not free:
            raise ValueError("silent states in a cycle")
        out += free
        left = [s for s in left if s not in free]
    return out


def best_paths(m: Model, b: np.ndarray, lengths: np.ndarray, counted: np.ndarray, class_of: Callable):
    """Paths with their silent states (None: impossible), log-likelihoods and counts. The lowest source wins ties, the lowest last state too."""
    n, steps, _ = b.shape
    order, every = _silent_order(m), np.arange(m.n)
    speaks = ~m.silent
    with np.errstate(divide="ignore"):
        la, start, lb = np.log(m.a), np.log(m.pi), np.log(b)
    back = np.full((steps + 1, n, m.n), -1, np.int32)
    score, count = np.full((n, m.n), -np.inf), np.zeros((n, m.n), np.int64)
    final, total = np.full((n, m.n), -np.inf), np.zeros((n, m.n), np.int64)

    def entered(s, level, score, count, t, begin):
        """Silent state s within a step: from the beginning if that is open, else from any state of the step."""
        ways = score + la[np.broadcast_to(class_of(count, t), count.shape), every, s]
        come = ways.argmax(axis=1)
        value, seen = ways[np.arange(n), come], count[np.arange(n), come]
        if begin:
            first = start[s] >= value
            value, come, seen = np.where(first, start[s], value), np.where(first, -1, come), np.where(first, 0, seen)
        score[:, s], count[:, s], back[level, :, s] = value, seen + counted[s], come

    for s in order:
        entered(s, 0, score, count, 0, True)
    for t in range(steps):
        ways = score[:, :, None] + la[np.broadcast_to(class_of(count, t), count.shape), every]
        come = ways.argmax(axis=1)
        value = np.take_along_axis(ways, come[:, None], 1)[:, 0]
        seen = np.take_along_axis(count, come, 1)
        if t == 0:
            first = start >= value
            value, come, seen = np.where(first, start, value), np.where(first, -1, come), np.where(first, 0, seen)
        score, count = np.where(speaks, value + lb[:, t], -np.inf), seen + counted
        back[t + 1] = come
        for s in order:
            entered(s, t + 1, score, count, t + 1, False)
        last = (lengths == t + 1)[:, None]
        final, total = np.where(last, score, final), np.where(last, count, total)
    paths, logp, counts = [], np.where(lengths > 0, final.max(axis=1), 0.0), []
    for i in range(n):
        s, level = int(final[i].argmax()), int(lengths[i])
        if not level or not np.isfinite(final[i, s]):
            paths.append([] if not level else None)
            counts.append(0)
            continue
        counts.append(int(total[i, s]))
        path = []
        while s >= 0:
            path.append(s)
            before = int(back[level, i, s])
            level -= int(speaks[s])
            s = before
        paths.append(path[::-1])
    return paths, np.where(np.isfinite(logp), logp, np.nan), np.array(counts, np.int64)


def decode(seqs: DataFrame, m: Model, counted: list[bool], class_of: Callable) -> DataFrame:
    """seq_id, path (silent states in it), logp, count of the best path of each sequence; null where there is none. Empty sequences have an empty path."""
    marks = np.array(counted, np.int64)
    if m.b is None or m.order or len(marks) != m.n:
        raise ValueError("a discrete model without history, and a mark for each state")

    def run(frames):
        for frame in frames:
            for rows, obs, n in padded(frame, max(1 << 18, 1 << 21) // (m.n * m.n)):
                paths, logp, counts = best_paths(m, emissions(m, obs), n, marks, class_of)
                yield pd.DataFrame({"seq_id": frame["seq_id"].to_numpy()[rows], "path": paths, "logp": logp, "count": counts})

    return seqs.select("seq_id", "obs").mapInPandas(run, "seq_id long, path array<int>, logp double, count long")
