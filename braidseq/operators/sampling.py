"""Sequences drawn from a model: each has a generator of its own, seeded by its id, so reruns and partitionings agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.models import Model
from .hmm import classes, emissions, forward, loglik, padded


def draw(m: Model, length: int, rng: np.random.Generator, begun: tuple[list, int] | None = None) -> tuple[list, list[int]]:
    """Observations and states; a state without a way out ends the sequence. begun: observations to go on from, and the state that gave the last."""
    obs, path = (list(begun[0]), [None] * (len(begun[0]) - 1) + [begun[1]]) if begun else ([], [])
    s, t = begun[1] if begun else 0 if m.from_first else int(rng.choice(m.n, p=m.pi)), len(obs)
    moved = not (begun or m.from_first)
    while t < length:
        if not moved:
            row = m.a[classes(m, t), s]
            if row.sum() <= 0:
                break
            s = int(rng.choice(m.n, p=row / row.sum()))
        moved = False
        if m.silent[s]:
            continue
        if m.b is not None:
            row = 0
            for o in obs[max(0, t - m.order) : t]:
                row = row * m.symbols + o
            p = m.b[s].reshape(-1, m.symbols)[row]
            obs.append(int(rng.choice(m.symbols, p=p / p.sum())))
        else:
            k = int(rng.choice(m.c.shape[1], p=m.c[s]))
            x = rng.normal(m.mu[s, k], m.var[s, k] ** 0.5)
            while m.cut is not None and x < m.cut:
                x = rng.normal(m.mu[s, k], m.var[s, k] ** 0.5)
            obs.append(float(x))
        path.append(s)
        t += 1
    return obs, path


def generate(ids: DataFrame, m: Model, length: int = 100_000, seed: int = 1) -> DataFrame:
    """seq_id, obs, states for each seq_id of ids; a column `len` gives each its own length."""

    def run(frames):
        for frame in frames:
            sizes = frame["len"] if "len" in frame else [length] * len(frame)
            got = [draw(m, int(n), np.random.default_rng([seed, int(i)])) for i, n in zip(frame["seq_id"], sizes)]
            yield pd.DataFrame({"seq_id": frame["seq_id"], "obs": [g[0] for g in got], "states": [g[1] for g in got]})

    return ids.mapInPandas(run, f"seq_id long, obs array<{'int' if m.b is not None else 'double'}>, states array<int>")


def _last_states(m: Model, obs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(sequences, states): distribution of the state of the last symbol; nan where the sequence is impossible."""
    alpha, _, logp = forward(m, emissions(m, obs), lengths)
    p = alpha[np.arange(len(obs)), np.maximum(lengths - 1, 0)] * ~m.silent
    total = p.sum(axis=1, keepdims=True)
    return np.where(np.isnan(logp)[:, None] | (total <= 0), np.nan, np.divide(p, total, out=np.zeros_like(p), where=total > 0))


def extended(seqs: DataFrame, m: Model, length: int = 100_000, seed: int = 1) -> DataFrame:
    """seq_id, obs, states: each sequence drawn on to `length` symbols (a column `len` gives each its own) from the state distribution at its end.

    states are null before the given last symbol. A sequence that is as long already stays; an empty one is drawn from its beginning; an impossible one gives null.
    """
    def run(frames):
        for frame in frames:
            sizes = frame["len"].to_numpy() if "len" in frame else np.full(len(frame), length)
            for rows, obs, n in padded(frame):
                last, out = _last_states(m, obs, n), []
                for i, r in enumerate(rows):
                    own = [] if not n[i] else list(frame["obs"].iloc[r])
                    rng = np.random.default_rng([seed, int(frame["seq_id"].iloc[r])])
                    if not n[i]:
                        out.append(draw(m, int(sizes[r]), rng))
                    elif np.isnan(last[i, 0]):
                        out.append((None, None))
                    else:
                        out.append(draw(m, int(sizes[r]), rng, (own, int(rng.choice(m.n, p=last[i])))))
                yield pd.DataFrame({"seq_id": frame["seq_id"].to_numpy()[rows], "obs": [g[0] for g in out], "states": [g[1] for g in out]})

    keep = ["seq_id", "obs", *(["len"] if "len" in seqs.columns else [])]
    return seqs.select(*keep).mapInPandas(run, f"seq_id long, obs array<{'int' if m.b is not None else 'double'}>, states array<int>")


def next_symbols(seqs: DataFrame, m: Model) -> DataFrame:
    """seq_id, symbol, p: distribution of the symbol after each sequence, given that one follows; none for impossible or empty sequences, or after a last state that ends."""
    if m.b is None or m.order or len(m.a) > 1:
        raise ValueError("a discrete model of one class without history")
    m = m.without_silent() if m.silent.any() else m

    def run(frames):
        for frame in frames:
            for rows, obs, n in padded(frame):
                p = _last_states(m, obs, n) @ m.a[0] @ m.b
                total = p.sum(axis=1)
                good = np.flatnonzero((n > 0) & (total > 0))
                ids = frame["seq_id"].to_numpy()[rows][good]
                yield pd.DataFrame({"seq_id": np.repeat(ids, m.symbols), "symbol": np.tile(np.arange(m.symbols), len(good)), "p": (p[good] / total[good, None]).ravel()})

    return seqs.select("seq_id", "obs").mapInPandas(run, "seq_id long, symbol int, p double")


def words(spark: SparkSession, length: int, symbols: int) -> DataFrame:
    """All symbols ** length words in order: seq_id, obs."""
    digits = [(F.floor(F.col("id") / symbols ** (length - 1 - i)) % symbols).cast("int") for i in range(length)]
    return spark.range(symbols**length).select(F.col("id").alias("seq_id"), F.array(*digits).alias("obs"))


def probability_distance(spark: SparkSession, a: Model, b: Model, sequences: int = 100, length: int = 200, symmetric: bool = False, seed: int = 1) -> float:
    """Mean of (log P under a - log P under b) per symbol of sequences drawn from a."""
    drawn = generate(spark.range(sequences).withColumnRenamed("id", "seq_id"), a, length, seed).withColumn("weight", F.lit(1.0))
    both = loglik(drawn, a).withColumnRenamed("logp", "la").join(loglik(drawn, b), "seq_id").join(drawn.select("seq_id", F.size("obs").alias("t")), "seq_id")
    d = both.agg(F.sum(F.col("la") - F.col("logp")) / F.sum("t")).first()[0]
    return (d + probability_distance(spark, b, a, sequences, length, False, seed)) / 2 if symmetric else d
