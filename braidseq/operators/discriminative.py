"""Training of several models together so that each sequence is told from those of the other classes.

The objective is the sum over sequences of sigmoid(alpha x), x = log(prior p of the own model) - log(sum of prior p over the other models).
One pass over the sequences scores all models, weighs each sequence by the slope of its sigmoid, and sums every model's
expected counts apart for its own sequences and for those of the others, which count by their share among the models
that are not the sequence's own. What comes to the driver is as large as the models.

Labels number the models (a sequence of another label, or none, is left out). A sequence that neither its own nor any other model can give
counts nothing. Models without silent states; zeros stay zero, fixed states keep their emissions.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.models import Model
from .hmm import emissions, forward, packed, padded, unpacked
from .training import counted, posteriors, summed

#: Share of the new parameters in a closed step, shrink of its factor, first gradient rate for each symbol.
MIX, SHRINK, RATE = 0.14, 0.99, 0.3


def margins(logp: np.ndarray, prior: np.ndarray, label: np.ndarray, alpha: float = 1.0):
    """Of log-likelihoods (sequences, models): margin x, sigmoid, slope, and each model's share among the others (own: 0)."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        joint = np.where(np.isnan(logp), -np.inf, logp) + np.log(prior)
        own = joint[np.arange(len(label)), label]
        rest = joint.copy()
        rest[np.arange(len(label)), label] = -np.inf
        top = rest.max(axis=1)
        share = np.where(np.isfinite(top)[:, None], np.exp(rest - np.where(np.isfinite(top), top, 0)[:, None]), 0.0)
        total = share.sum(axis=1)
        x = own - np.where(total > 0, top + np.log(np.where(total > 0, total, 1)), -np.inf)
        share = np.divide(share, total[:, None], out=np.zeros_like(share), where=total[:, None] > 0)
        s = np.where(np.isnan(x), 0.0, 1 / (1 + np.exp(-alpha * x)))
    slope = np.where(np.isfinite(x), alpha * s * (1 - s), 0.0)
    return x, s, slope, share


def _scores(models: list[Model], obs, n) -> np.ndarray:
    return np.stack([forward(m, emissions(m, obs), n)[2] for m in models], axis=1)


def margin_table(seqs: DataFrame, models: list[Model], alpha: float = 1.0) -> DataFrame:
    """seq_id, label, margin, performance, slope, best (the model of highest likelihood, priors aside, the lowest of equals) of every labelled sequence."""
    prior = np.array([m.prior for m in models])

    def run(frames):
        for frame in frames:
            for rows, obs, n in padded(frame):
                label = frame["label"].to_numpy(int)[rows]
                logp = _scores(models, obs, n)
                x, s, slope, _ = margins(logp, prior, label, alpha)
                yield pd.DataFrame({"seq_id": frame["seq_id"].to_numpy()[rows], "label": label, "margin": x, "performance": s, "slope": slope, "best": np.where(np.isnan(logp), -np.inf, logp).argmax(axis=1)})

    return _labelled(seqs, models).mapInPandas(run, "seq_id long, label int, margin double, performance double, slope double, best int")


def errors(seqs: DataFrame, models: list[Model]) -> DataFrame:
    """label, n, false_negatives (its sequences that another model likes best), false_positives (others' that its model does)."""
    d = margin_table(seqs, models).select(F.explode(F.array(F.struct(F.col("label"), F.lit(1).alias("n"), (F.col("best") != F.col("label")).cast("int").alias("fn"), F.lit(0).alias("fp")), F.struct(F.col("best").alias("label"), F.lit(0).alias("n"), F.lit(0).alias("fn"), (F.col("best") != F.col("label")).cast("int").alias("fp")))).alias("x")).select("x.*")
    return d.groupBy("label").agg(F.sum("n").alias("n"), F.sum("fn").alias("false_negatives"), F.sum("fp").alias("false_positives"))


def _labelled(seqs: DataFrame, models: list[Model]) -> DataFrame:
    weight = [F.col("weight")] if "weight" in seqs.columns else [F.lit(1.0).alias("weight")]
    return seqs.where(F.col("label").between(0, len(models) - 1)).select("seq_id", "label", *weight, "obs")


def coupled(seqs: DataFrame, models: list[Model], alpha: float = 1.0) -> tuple[float, float, list[dict[str, dict[str, np.ndarray]]]]:
    """Objective, symbols, and for each model the counts `own` and `rest`: both weighed by slopes. One pass."""
    return _coupled(packed(_labelled(seqs, models), ("label",)), models, alpha)


def _coupled(blocks: DataFrame, models: list[Model], alpha: float):
    prior = np.array([m.prior for m in models])

    def run(frames):
        total: dict = {}

        def put(key, value):
            total[key] = total.get(key, 0) + value

        for batch in unpacked(frames):
            obs, n, label, weight = (batch[k] for k in ("obs", "lengths", "label", "weight"))
            found = [posteriors(m, obs, n) for m in models]
            _, s, slope, share = margins(np.stack([f[-1] for f in found], axis=1), prior, label, alpha)
            put((-1, "all", "objective"), np.array([(weight * s).sum(), n.sum()]))
            for k, m in enumerate(models):
                for kind, some, w in (("own", label == k, slope * weight), ("rest", label != k, slope * weight * share[:, k])):
                    at = np.flatnonzero(some & (w > 0))
                    if len(at):
                        put((k, kind, "weight"), np.array([w[at].sum()]))
                        for name, value in counted(m, obs[at], n[at], w[at], found=tuple(f[at] for f in found[k])).items():
                            if name != "logp":
                                put((k, kind, name), value)
        if total:
            yield pd.concat([pd.DataFrame({"model": k, "kind": kind, "name": name, "place": np.arange(v.size), "value": v.ravel()}) for (k, kind, name), v in total.items()])

    rows = blocks.mapInPandas(run, "model int, kind string, name string, place int, value double")
    empty = lambda m: {"pi": np.zeros_like(m.pi), "a": np.zeros_like(m.a), "b": np.zeros_like(m.b), "weight": np.zeros(1)}
    counts, objective = [{"own": empty(m), "rest": empty(m)} for m in models], np.zeros(2)
    for (k, kind, name, place), value in summed(rows, "model", "kind", "name", "place").items():
        (objective if k < 0 else counts[k][kind][name]).flat[place] = value
    return float(objective[0]), float(objective[1]), counts


def slopes(m: Model, counts: dict[str, dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Derivatives of the objective by the model's parameters, each taken as free; 0 where a parameter is 0."""
    out = {}
    for name in ("pi", "a", "b"):
        old, d = getattr(m, name), counts["own"][name] - counts["rest"][name]
        out[name] = np.divide(d, old, out=np.zeros_like(old), where=old > 0)
    return out


def _distribution(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Rows of new made distributions over the places where old is not 0: lifted by 1.1 of what is below 0, then divided by the sum."""
    on = old > 0
    least = np.where(on, new, np.inf).min(axis=-1, keepdims=True)
    new = np.where(on, new - np.where(least < 0, 1.1 * least, 0), 0)
    total = new.sum(axis=-1, keepdims=True)
    return np.where(total > 0, np.divide(new, total, out=np.zeros_like(new), where=total > 0), old)


def _blocks(m: Model, name: str, x: np.ndarray) -> np.ndarray:
    return x.reshape(m.n, -1, m.symbols) if name == "b" else x


def by_gradient(m: Model, counts, rate: float) -> Model:
    g = slopes(m, counts)
    new = {k: _distribution(_blocks(m, k, getattr(m, k)), _blocks(m, k, getattr(m, k) + rate * g[k])).reshape(g[k].shape) for k in g}
    return _kept(m, new)


def step_factor(m: Model, counts) -> float:
    """The largest share, at most 1, of the others' counts that leaves every numerator above 0; a little less than that."""
    own, rest = counts["own"]["weight"][0], counts["rest"]["weight"][0]
    factor = own / rest if rest > 0 and own < rest else 1.0
    fixed = np.array(m.fixed or [False] * m.n, bool)
    for name in ("pi", "a", "b"):
        a, b = counts["own"][name], counts["rest"][name]
        use = (a < factor * b) & (getattr(m, name) > 0)
        if name == "b":
            use &= ~fixed[:, None]
        if use.any():
            factor = min(factor, float((a[use] / b[use]).min()))
    return SHRINK * factor


def by_closed_form(m: Model, counts, mix: float = MIX) -> Model:
    factor, new = step_factor(m, counts), {}
    for name in ("pi", "a", "b"):
        old, x = _blocks(m, name, getattr(m, name)), _blocks(m, name, np.maximum(counts["own"][name] - factor * counts["rest"][name], 0))
        total = x.sum(axis=-1, keepdims=True)
        best = np.where(total > 0, np.divide(x, total, out=np.zeros_like(x), where=total > 0), old)
        new[name] = ((1 - mix) * old + mix * best).reshape(getattr(m, name).shape)
    return _kept(m, new)


def _kept(m: Model, new: dict[str, np.ndarray]) -> Model:
    fixed = np.array(m.fixed or [False] * m.n, bool)
    return replace(m, pi=m.pi if m.from_first else new["pi"], a=new["a"], b=np.where(fixed[:, None] | m.silent[:, None], m.b, new["b"]))


def train(seqs: DataFrame, models: list[Model], form: str = "gradient", steps: int = 50, alpha: float = 1.0, gain: float = 1e-6, halvings: int = 12) -> tuple[list[Model], list[float]]:
    """Models after at most `steps` accepted steps of all classes at once, and the objective before and after each; it never falls.

    A step that would lower the objective is halved (the gradient's rate, or the share of the closed form's new parameters) up to `halvings`
    times; training ends when none helps or a step gains less than `gain` of the objective. While it goes on priors are the
    classes' shares of the weights; the models come back with their own.
    """
    if form not in ("gradient", "closed"):
        raise ValueError("form is gradient or closed")
    if len(models) < 2 or any(m.b is None or m.silent.any() for m in models):
        raise ValueError("two discrete models without silent states at least")
    seqs = _labelled(seqs, models).persist()
    blocks = packed(seqs, ("label",))
    try:
        share = {r["label"]: r["w"] for r in seqs.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
        every = sum(share.values())
        now = [replace(m, prior=share.get(k, 0.0) / every if every else m.prior) for k, m in enumerate(models)]
        best, symbols, counts = _coupled(blocks, now, alpha)
        seen, size = [best], RATE / max(symbols, 1.0) if form == "gradient" else MIX
        for _ in range(steps):
            for _ in range(halvings):
                tried = [by_gradient(m, c, size) if form == "gradient" else by_closed_form(m, c, size) for m, c in zip(now, counts)]
                value, _, new = _coupled(blocks, tried, alpha)
                if value > best:
                    break
                size /= 2
            else:
                break
            small = value - best <= gain * abs(best)
            now, best, counts = tried, value, new
            seen.append(best)
            size = min(size * 1.5, 1.0 if form == "closed" else np.inf)
            if small:
                break
        return [replace(m, prior=old.prior) for m, old in zip(now, models)], seen
    finally:
        seqs.unpersist()
        blocks.unpersist()
