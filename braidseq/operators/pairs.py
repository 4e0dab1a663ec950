"""Pair models: two sequences read together, with transition classes, in linear space.

A state takes dx symbols of x and dy of y (not none of both) and emits by the last of each. The transitions out of a state may come in classes; which
one holds is asked of a function of the state and of the cell that is reached. Cells of one antidiagonal depend only on
earlier ones, so they are reckoned together, those of many pairs at once, and no more antidiagonals are kept than a step is long.

A pair whose table would be larger than `most` cells is divided: the sweep carries along where each path first reached the middle
antidiagonal, so at its end the cell where the best path crosses is known, and two smaller segments take the pair's place. Segments
are rows of their own, dealt to all tasks again in every round, until all are small enough to be traced back. Scores are whole
numbers, so a divided pair has the path of an undivided one, the lowest state winning ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .antidiagonals import Beside, batches, sweep, traced
from .state import settle

NEG, BITS = -(1 << 61), 30
#: Cells of a segment that is traced back at once.
MOST = 1 << 20


class Cell(NamedTuple):
    """Cells that are reached, as arrays: places of the last symbols read (-1: none yet), these symbols, and the values of the tracks there (nan: none)."""

    u: np.ndarray
    v: np.ndarray
    x: np.ndarray
    y: np.ndarray
    x_track: np.ndarray
    y_track: np.ndarray


@dataclass(frozen=True)
class PairModel:
    """start (n), a (classes, n, n), steps (dx, dy of each state), b: for each state its emissions by symbol of x and of y (one row or column where it takes none).

    class_of(state, cell) gives the class of the moves out of a state that reach the cells.
    """

    start: np.ndarray
    a: np.ndarray
    steps: tuple
    b: tuple
    class_of: Callable | None = None

    @classmethod
    def of(cls, start, a, steps, b, class_of=None) -> PairModel:
        a = np.array(a, float)
        a = a[None] if a.ndim == 2 else a
        if any(dx + dy < 1 or min(dx, dy) < 0 for dx, dy in steps):
            raise ValueError("every state takes a symbol at least")
        if len(a) > 1 and class_of is None:
            raise ValueError("several classes need class_of")
        return cls(np.array(start, float), a, tuple(map(tuple, steps)), tuple(np.atleast_2d(np.array(t, float)) for t in b), class_of)

    @property
    def n(self) -> int:
        return len(self.steps)


def _whole(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        x = np.log(p)
    return np.where(np.isfinite(x), np.rint(np.where(np.isfinite(x), x, 0) * 2.0**BITS), NEG).astype(np.int64)


class _Tables:
    """The model's logarithms and the symbols of many segments, which go side by side."""

    def __init__(self, m: PairModel, segments: list[dict]):
        self.m, self.la, self.ls, self.lb = m, _whole(m.a), _whole(m.start), [_whole(t) for t in m.b]
        x, y = ([np.asarray(r[k], np.int64) for r in segments] for k in ("x", "y"))
        self.beside = b = Beside(np.array([len(z) for z in x], np.int64), np.array([len(z) for z in y], np.int64), max(dx for dx, _ in m.steps))
        self.x0, self.y0 = (np.array([r[k] for r in segments], np.int64) for k in ("x0", "y0"))
        # What stands before a segment, for cells that have read nothing of it.
        self.xs = b.along_x([np.concatenate([[r["x_before"]], z]) for r, z in zip(segments, x)], -1)
        self.ys = np.concatenate([np.concatenate([[r["y_before"]], z]) for r, z in zip(segments, y)])
        self.tx = b.along_x([self._track(r["x_track"], len(z)) for r, z in zip(segments, x)], np.nan)
        self.ty = np.concatenate([self._track(r["y_track"], len(z)) for r, z in zip(segments, y)])

    @staticmethod
    def _track(t, size):
        return np.full(size + 1, np.nan) if t is None or not len(t) else np.asarray(t, float)

    def classes(self, rows: np.ndarray, pair: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        """For each state: class of the moves out of it into the cells."""
        at = self.beside.y_base[pair] + v
        cell = Cell(u + self.x0[pair] - 1, v + self.y0[pair] - 1, self.xs[rows], self.ys[at], self.tx[rows], self.ty[at])
        return [np.broadcast_to(self.m.class_of(r, cell), u.shape) for r in range(self.m.n)]

    def said(self, s: int, rows: np.ndarray, pair: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        (dx, dy), t = self.m.steps[s], self.lb[s]
        if not dy:
            return t[:, 0][self.xs[rows]]
        y = self.ys[self.beside.y_base[pair] + v]
        return t[self.xs[rows], y] if dx else t[0][y]

    def sweep(self, begin: list[int], keep: bool):
        kinds = None if self.m.class_of is None else self.classes
        return sweep(self.beside, self.m.steps, self.ls, self.la, self.said, kinds, NEG, np.array(begin, np.int64), keep)


def _ends(final: np.ndarray, wanted: list[int]) -> np.ndarray:
    """The wanted states, or else the best, the lowest of equals; -1 where they can't be reached."""
    wanted = np.array(wanted, np.int64)
    s = np.where(wanted >= 0, wanted, final.argmax(axis=1))
    return np.where(final[np.arange(len(s)), s] > NEG // 2, s, -1)


_SEGMENT = "seq_id long, x0 int, y0 int, x_before int, y_before int, begin int, finish int, x array<int>, y array<int>, x_track array<double>, y_track array<double>"
_COLUMNS = [c.split()[0] for c in _SEGMENT.split(", ")]


def _together(m: PairModel, frame: pd.DataFrame) -> Iterator[list[dict]]:
    """The rows of a frame as segments, as many as go together."""
    sizes = (frame["x"].map(len).to_numpy(np.int64) + 1) * (frame["y"].map(len).to_numpy(np.int64) + 1) * m.n
    for some in batches(sizes):
        yield frame.iloc[some].to_dict("records")


def _divided(m: PairModel, segments: list[dict]) -> list[dict]:
    """Two segments for each; one that can't be aligned gets the last state -2."""
    t = _Tables(m, segments)
    final, cross = t.sweep([r["begin"] for r in segments], False)
    out = []
    for i, (r, s) in enumerate(zip(segments, _ends(final, [r["finish"] for r in segments]).tolist())):
        if s < 0:
            out.append({**r, "x": [], "y": [], "x_track": None, "y_track": None, "finish": -2})
            continue
        code, ny = int(cross[i, s]), len(r["y"])
        u, v, k = code // m.n // (ny + 1), code // m.n % (ny + 1), code % m.n
        track = lambda name, lo, hi: None if r[name] is None else list(r[name][lo:hi])  # noqa: B023, E731
        head = {**r, "x": r["x"][:u], "y": r["y"][:v], "finish": k, "x_track": track("x_track", 0, u + 1), "y_track": track("y_track", 0, v + 1)}
        x_before, y_before = (int(r[c][at - 1]) if at else r[f"{c}_before"] for c, at in (("x", u), ("y", v)))
        tail = {**r, "x": r["x"][u:], "y": r["y"][v:], "x0": r["x0"] + u, "y0": r["y0"] + v, "begin": k, "finish": s, "x_before": x_before, "y_before": y_before, "x_track": track("x_track", u, None), "y_track": track("y_track", v, None)}
        out += [head, tail]
    return out


def _traced(m: PairModel, segments: list[dict]) -> list[tuple]:
    """(path, logp) of each; none where it can't be aligned."""
    t = _Tables(m, segments)
    final, back = t.sweep([r["begin"] for r in segments], True)
    empty = t.beside.nx + t.beside.ny == 0
    s = np.where(empty, -1, _ends(final, [r["finish"] for r in segments]))
    logp = final[np.arange(len(s)), s] / 2.0**BITS
    paths = traced(t.beside, m.steps, back, s)
    return [((None, None) if r["finish"] == -2 else ([], 0.0)) if e else (p, z) if k >= 0 else (None, None) for r, e, k, p, z in zip(segments, empty, s, paths, logp.tolist())]


def align(pairs: DataFrame, m: PairModel, most: int = MOST) -> DataFrame:
    """seq_id, path, logp of the best alignment of x and y (arrays of ints) of each row; null for pairs that the model can't give.

    Optional columns x_track and y_track (a number for each symbol) are for class_of. seq_ids differ.
    """
    reach = max(dx + dy for dx, dy in m.steps)
    most = max(most, (8 * reach) ** 2)  # smaller segments need not have a middle
    track = lambda c: F.concat(F.array(F.lit(float("nan"))), F.col(c)).cast("array<double>") if c in pairs.columns else F.lit(None).cast("array<double>")
    none = F.lit(-1)
    rows = pairs.select(F.col("seq_id").cast("long").alias("seq_id"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), none.alias("x_before"), none.alias("y_before"), none.alias("begin"), none.alias("finish"), F.col("x").cast("array<int>").alias("x"), F.col("y").cast("array<int>").alias("y"), track("x_track").alias("x_track"), track("y_track").alias("y_track"))
    n, done = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), None
    large = (F.size("x").cast("long") + 1) * (F.size("y").cast("long") + 1) > most

    def split(frames):
        for frame in frames:
            for some in _together(m, frame):
                yield pd.DataFrame(_divided(m, some), columns=_COLUMNS)

    while True:
        rows = settle(rows.repartition(n, "seq_id", "x0", "y0"))
        small = rows.where(~large)
        done = small if done is None else done.unionByName(small)
        rows = rows.where(large)
        if not rows.take(1):
            break
        rows = rows.mapInPandas(split, _SEGMENT)

    def trace(frames):
        for frame in frames:
            for some in _together(m, frame):
                out = [(r["seq_id"], r["x0"] + r["y0"], *found) for r, found in zip(some, _traced(m, some))]
                yield pd.DataFrame(out, columns=["seq_id", "place", "path", "logp"])

    found = done.mapInPandas(trace, "seq_id long, place long, path array<int>, logp double")
    item = F.struct("place", "path", "logp")
    whole = found.groupBy("seq_id").agg(F.array_sort(F.collect_list(item)).alias("parts"), F.bool_and(F.col("path").isNotNull()).alias("fine"))
    path = F.flatten(F.transform("parts", lambda p: p["path"]))
    return whole.select("seq_id", F.when(F.col("fine"), path).alias("path"), F.when(F.col("fine"), F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["logp"])).alias("logp"))


def path_logp(pairs: DataFrame, m: PairModel) -> DataFrame:
    """seq_id, logp of a given path of each row; null if the model can't go it or it does not read both sequences to their ends."""
    def some(rows):
        """Log-likelihoods of rows with paths that read both sequences to their ends, and at least a symbol."""
        track = lambda r, c: None if c not in r or r[c] is None else [np.nan, *r[c]]
        t = _Tables(m, [{**dict.fromkeys(("x0", "y0"), 0), **dict.fromkeys(("x_before", "y_before"), -1), "x": r["x"], "y": r["y"], "x_track": track(r, "x_track"), "y_track": track(r, "y_track")} for r in rows])
        size = np.array([len(r["path"]) for r in rows])
        path, head, pair = np.concatenate([np.asarray(r["path"], int) for r in rows]), np.cumsum(size) - size, np.repeat(np.arange(len(rows)), size)
        before = np.concatenate([[0], path[:-1]])
        u, v = (z - (z[head] - step[path[head]])[pair] for step in steps for z in (np.cumsum(step[path]),))
        at = t.beside.base[pair] + u
        kinds = 0 if m.class_of is None else np.stack(t.classes(at, pair, u, v))[before, np.arange(len(path))]
        terms = t.la[kinds, before, path]
        terms[head] = t.ls[path[head]]
        said = np.zeros(len(path), np.int64)
        for s in np.unique(path):
            here = path == s
            said[here] = t.said(s, at[here], pair[here], u[here], v[here])
        fine = np.minimum.reduceat(np.minimum(terms, said), head) > NEG // 2
        return np.where(fine, np.add.reduceat(terms + said, head) / 2.0**BITS, np.nan), fine

    steps = [np.array([s[k] for s in m.steps], np.int64) for k in (0, 1)]

    def logps(rows):
        out, whole = [None] * len(rows), []
        for i, r in enumerate(rows):
            if r["path"] is None:
                continue
            if not len(r["path"]):
                out[i] = 0.0 if not len(r["x"]) and not len(r["y"]) else None
            elif tuple(int(step[np.asarray(r["path"], int)].sum()) for step in steps) == (len(r["x"]), len(r["y"])):
                whole.append(i)
        sizes = np.array([len(rows[i]["path"]) + len(rows[i]["x"]) + len(rows[i]["y"]) for i in whole], np.int64)
        for at in batches(sizes):
            for k, z, fine in zip(at, *some([rows[whole[k]] for k in at])):
                out[whole[k]] = float(z) if fine else None
        return out

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"seq_id": frame["seq_id"], "logp": logps(frame.to_dict("records"))})

    keep = [c for c in ("seq_id", "x", "y", "x_track", "y_track", "path") if c in pairs.columns]
    return pairs.select(*keep).mapInPandas(run, "seq_id long, logp double")
