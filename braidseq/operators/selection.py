"""How many models a set of sequences needs: mixtures of every size, repeated from different starts, trained at once.

A pass reads the sequences once for all mixtures that still move: it scores them under every model, shares each sequence out among
the models of its mixture, and sums expected counts by (mixture, model). A repeat trains on its own part of the
sequences, drawn by a hash of the sequence and the repeat, and is judged on the rest. What comes to the driver is as large as the models.

A sequence that no model of a mixture can give counts as PENALTY in likelihoods and nothing in counts. Empty sequences count nothing.
"""

from __future__ import annotations

from dataclasses import replace
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.models import PENALTY, Model
from .hmm import emissions, forward, padded
from .training import GAIN, STEPS, counted, maximized


def starts(start: Model, sizes: list[int], repeats: int, level: float = 0.3, seed: int = 0) -> dict[tuple[int, int], list[Model]]:
    """Mixtures by (number of models, repeat): noisy copies of one model, of equal priors."""
    out = {}
    for k in sizes:
        for r in range(repeats):
            out[k, r] = [replace(_shaken(start, level, 1 + seed + 1009 * (repeats * k + r) + i), prior=1.0 / k) for i in range(k)]
    return out


def _shaken(m: Model, level: float, seed: int) -> Model:
    if m.b is not None:
        return m.with_noise(level, seed)
    rng = np.random.default_rng(seed)
    return replace(m, mu=m.mu + level * np.sqrt(m.var) * rng.standard_normal(m.mu.shape))


def trains(share: float):
    """Whether a sequence is in the training part of a repeat, as a column of seq_id and repeat."""
    return lambda seq_id, repeat: F.pmod(F.xxhash64(seq_id, F.lit(int(repeat))), F.lit(1 << 20)) < int(share * (1 << 20))


def shared_out(logp: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of log-likelihoods (sequences, models): log-likelihood under the mixture (nan: impossible) and each model's share."""
    with np.errstate(divide="ignore"):
        joint = np.where(np.isnan(logp), -np.inf, logp) + np.log(prior)
    top = joint.max(axis=1)
    fine = np.isfinite(top)
    share = np.where(fine[:, None], np.exp(joint - np.where(fine, top, 0)[:, None]), 0.0)
    total = share.sum(axis=1)
    return np.where(fine, top + np.log(np.where(fine, total, 1)), np.nan), np.divide(share, total[:, None], out=np.zeros_like(share), where=fine[:, None])


def one_pass(seqs: DataFrame, mixtures: dict[tuple[int, int], list[Model]], share: float, counts: bool = True):
    """{mixture: (log-likelihood and weight of the training part, those of the rest, counts and weight of each model)}."""
    repeats = sorted({r for _, r in mixtures})
    inside = trains(share)
    weight = F.col("weight") if "weight" in seqs.columns else F.lit(1.0)
    rows = seqs.where(F.size("obs") > 0).select("seq_id", weight.alias("weight"), "obs", F.array(*[inside(F.col("seq_id"), r) for r in repeats]).alias("parts"))

    def run(frames):
        total: dict = {}

        def put(key, value):
            total[key] = total.get(key, 0) + value

        for frame in frames:
            parts, w = np.stack(frame["parts"].to_numpy()) if len(frame) else np.zeros((0, len(repeats)), bool), frame["weight"].to_numpy(float)
            for at, obs, n in padded(frame, 1 << 19):
                for (k, r), models in mixtures.items():
                    train = parts[at, repeats.index(r)]
                    logp, part = shared_out(np.stack([forward(m, emissions(m, obs), n)[2] for m in models], axis=1), np.array([m.prior for m in models]))
                    value = np.where(np.isnan(logp), PENALTY, logp) * w[at]
                    put((k, r, -1, "sums"), np.array([value[train].sum(), w[at][train].sum(), value[~train].sum(), w[at][~train].sum()]))
                    for i, m in enumerate(models if counts else []):
                        own = np.flatnonzero(train & (part[:, i] > 0))
                        if len(own):
                            put((k, r, i, "weight"), np.array([(part[own, i] * w[at][own]).sum()]))
                            for name, v in counted(m, obs[own], n[own], part[own, i] * w[at][own]).items():
                                if name != "logp":
                                    put((k, r, i, name), v)
        if total:
            yield pd.concat([pd.DataFrame({"k": k, "r": r, "model": i, "name": name, "place": np.arange(v.size), "value": v.ravel()}) for (k, r, i, name), v in total.items()])

    got = rows.mapInPandas(run, "k int, r int, model int, name string, place int, value double").groupBy("k", "r", "model", "name", "place").agg(F.sum("value").alias("value"))
    out = {key: (np.zeros(4), [{"weight": np.zeros(1), **_zeros(m)} for m in models]) for key, models in mixtures.items()}
    for x in got.collect():
        sums, models = out[x["k"], x["r"]]
        (sums if x["model"] < 0 else models[x["model"]][x["name"]]).flat[x["place"]] = x["value"]
    return out


def _zeros(m: Model) -> dict[str, np.ndarray]:
    shapes = {"pi": m.pi.shape, "a": m.a.shape} | ({"b": m.b.shape} if m.b is not None else {k: m.c.shape for k in ("c", "x", "xx")})
    return {k: np.zeros(s) for k, s in shapes.items()}


def select(seqs: DataFrame, mixtures: dict[tuple[int, int], list[Model]], share: float = 0.7, steps: int = STEPS, gain: float = GAIN):
    """Mixtures after training, and a row (dict) for each: k, repeat, steps, train and test log-likelihood and weight, free parameters, bic (lower is better).

    A mixture leaves the passes when a step gains at most `gain` of its log-likelihood, or after `steps`.
    """
    seqs = seqs.persist()
    try:
        now, moving, last, took = dict(mixtures), set(mixtures), {}, dict.fromkeys(mixtures, 0)
        for _ in range(steps):
            if not moving:
                break
            for key, (sums, counts) in one_pass(seqs, {k: now[k] for k in sorted(moving)}, share).items():
                if key in last and sums[0] - last[key] <= gain * abs(sums[0]):
                    moving.discard(key)
                    continue
                last[key] = sums[0]
                took[key] += 1
                every = sum(c["weight"][0] for c in counts)
                now[key] = [replace(maximized(m, c), prior=float(c["weight"][0] / every)) if every > 0 and c["weight"][0] > 0 else replace(m, prior=0.0 if every > 0 else m.prior) for m, c in zip(now[key], counts)]
        rows = []
        for (k, r), (sums, _) in sorted(one_pass(seqs, now, share, counts=False).items()):
            free = sum(m.free_parameters() for m in now[k, r]) + k - 1
            rows.append({"k": k, "repeat": r, "steps": took[k, r], "train": float(sums[0]), "n_train": float(sums[1]), "test": float(sums[2]), "n_test": float(sums[3]), "free": free, "bic": float(-2 * sums[0] + free * log(max(sums[1], 1.0)))})
        return now, rows
    finally:
        seqs.unpersist()
