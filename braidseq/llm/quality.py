"""Quality by a factorisation machine over hashed words, structure statistics and the text's own metadata (its lengths).

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is made in linear time as half of
(sum v_i x_i)^2 - sum (v_i x_i)^2 over the factors. Words hash to 2**15 features, weighted log(1 + tf) and scaled to
unit length; the statistics are standardised on the sample.

Fits on at most `per_class` labelled rows of each class (a bounded sample) on the driver, never on the held-out fold;
the score is then corrected to the classes' true shares. Nulls and empty texts have all statistics at zero and a score
like any other. Repeated rows score alike. Very long texts are taken whole. If a class has no example, every score is
the other class's. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import Lookup, held_out, sample

WORDS, RANK = 1 << 15, 8
_SYMBOLS = np.frombuffer(b"#&%$*|<>{}[]=\\^~_@", np.uint8)
STATS = ("log_bytes", "log_words", "word_bytes", "distinct", "repeated", "commonest", "symbols", "digits", "stops", "capitals", "others", "lines", "line_copies", "symbol_words")


def _bucket(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) & (WORDS - 1)


def statistics(text: str, words: list[str], ids: np.ndarray, counts: np.ndarray) -> list[float]:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n, m = max(len(raw), 1), max(len(words), 1)
    hist = np.bincount(raw, minlength=256)
    lines = text.split("\n")
    return [
        np.log1p(len(raw)), np.log1p(len(words)), len(raw) / m, len(ids) / m, sum(map(eq, words, words[1:])) / m, (int(counts.max()) if len(counts) else 0) / m,
        hist[_SYMBOLS].sum() / n, hist[48:58].sum() / n, hist[[44, 46, 33, 63, 58, 59]].sum() / n, hist[65:91].sum() / n, hist[128:].sum() / n,
        len(lines) / m, 1 - len(set(lines)) / len(lines), sum(1 for w in words if not w[-1].isalnum()) / m,
    ]


def features(text: str | None, lookup: Lookup) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word features, their weights, and the raw statistics."""
    words = (text or "").split()
    ids, counts = np.unique(np.fromiter(map(lookup.__getitem__, words), np.int64, len(words)), return_counts=True)
    w = np.log1p(counts)
    return ids, w / max(float(np.sqrt((w * w).sum())), 1e-12), statistics(text or "", words, ids, counts)


class Machine:
    """Parameters: linear weights, factors and bias; mean and deviation of the statistics."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.w = np.zeros(WORDS + len(STATS))
        self.v = rng.normal(0, 0.05, (WORDS + len(STATS), RANK))
        self.b, self.shift = 0.0, 0.0
        self.mean, self.dev = np.zeros(len(STATS)), np.ones(len(STATS))

    def inputs(self, ids, weights, stats):
        z = np.clip((np.asarray(stats) - self.mean) / self.dev, -4, 4) * 0.5
        return np.concatenate([ids, WORDS + np.arange(len(STATS))]), np.concatenate([weights, z])

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        s = vx.sum(axis=0)
        return float(self.b + self.w[at] @ x + 0.5 * ((s * s).sum() - (vx * vx).sum()))

    def fit(self, rows: list, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.03, decay: float = 1e-4):
        """Adaptive gradient steps on the logistic loss."""
        stats = np.array([r[2] for r in rows])
        self.mean, self.dev = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        data = [self.inputs(*r) for r in rows]
        rng = np.random.default_rng(5)
        gw, gv, gb = np.full(len(self.w), 1e-3), np.full(self.v.shape, 1e-3), 1e-3
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(data)), max(1, len(data) // batch)):
                at = np.concatenate([data[i][0] for i in part])
                x = np.concatenate([data[i][1] for i in part])
                sizes = np.array([len(data[i][0]) for i in part])
                begin = np.cumsum(sizes) - sizes
                vx = self.v[at] * x[:, None]
                s = np.add.reduceat(vx, begin)
                margin = self.b + np.add.reduceat(self.w[at] * x, begin) + 0.5 * ((s * s) - np.add.reduceat(vx * vx, begin)).sum(axis=1)
                g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[part]) / len(part)
                each = np.repeat(g, sizes) * x
                dv = each[:, None] * (np.repeat(s, sizes, axis=0) - vx)
                uniq, inv = np.unique(at, return_inverse=True)
                sw = np.bincount(inv, weights=each) + decay * self.w[uniq]
                sv = np.stack([np.bincount(inv, weights=dv[:, k]) for k in range(RANK)], 1) + decay * self.v[uniq]
                gw[uniq] += sw * sw
                gv[uniq] += sv * sv
                gb += float(g.sum()) ** 2
                self.w[uniq] -= rate * sw / np.sqrt(gw[uniq])
                self.v[uniq] -= rate * sv / np.sqrt(gv[uniq])
                self.b -= rate * float(g.sum()) / gb**0.5
        return self


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> Machine:
    chosen, counts = sample(docs, labels, "quality", per_class)

    def run(frames):
        lookup = Lookup(_bucket)
        for frame in frames:
            got = [features(t, lookup) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["y"], "ids": [g[0] for g in got], "w": [g[1] for g in got], "s": [g[2] for g in got]})

    # At most 2 * per_class rows of at most WORDS features.
    rows = sorted(chosen.mapInPandas(run, "doc_id long, y int, ids array<long>, w array<double>, s array<double>").toLocalIterator(), key=lambda r: r["doc_id"])
    y = np.array([float(r["y"]) for r in rows])
    machine = Machine()
    if len(counts) < 2:
        machine.w[:], machine.v[:] = 0, 0
        machine.b = 10.0 if 1 in counts else -10.0
        return machine
    machine.fit([(np.array(r["ids"], np.int64), np.array(r["w"]), r["s"]) for r in rows], y)
    machine.shift = float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return machine


def classified(docs: DataFrame, labels: DataFrame, per_class: int = 3000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))  # of fixed size

    def run(frames):
        machine, lookup = shared.value, Lookup(_bucket)
        for frame in frames:
            margin = np.array([machine.margin(*machine.inputs(*features(t, lookup))) for t in frame["text"]])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": 1 / (1 + np.exp(-np.clip(margin + machine.shift, -30, 30)))}).astype({"doc_id": "Int64"})

    d = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, score double")
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
