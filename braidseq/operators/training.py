"""Training: executors make expected counts, Spark sums them by parameter, the driver sets the parameters anew.

What comes to the driver is as large as the model, whatever the data. A step reads the sequences once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.models import LEAST_VARIANCE, PENALTY, Model
from . import blocks as by_blocks
from .hmm import backward, classes, emissions, forward, packed, padded, scores, unpacked

#: Most steps, and the relative gain in log-likelihood at which training ends.
STEPS, GAIN = 500, 1e-4


def posteriors(m: Model, obs, n, allowed=None) -> tuple:
    """Emissions, alphas, scales, betas, state probabilities and log-likelihoods of a batch; what is past a sequence's end is 0."""
    b = emissions(m, obs)
    alpha, scale, logp = forward(m, b, n, allowed)
    beta = backward(m, b, n, scale, allowed)
    gamma = alpha * beta
    total = gamma.sum(axis=2, keepdims=True)
    gamma = np.divide(gamma, total, out=np.zeros_like(gamma), where=(total > 0) & (np.arange(obs.shape[1])[None, :, None] < n[:, None, None]))
    return b if allowed is None else b * allowed, alpha, scale, beta, gamma, logp


def counted(m: Model, obs, n, weight, allowed=None, found: tuple | None = None) -> dict[str, np.ndarray]:
    """Expected counts of a batch. Impossible sequences count in `lost` only. found: its posteriors, if they are known."""
    be, alpha, scale, beta, gamma, logp = posteriors(m, obs, n, allowed) if found is None else found
    ok = ~np.isnan(logp) & (n > 0)
    w = np.where(ok, weight, 0.0)
    gamma = gamma * w[:, None, None]
    out = {"logp": np.array([np.where(ok, logp * weight, 0).sum(), (weight * (~ok & (n > 0))).sum()]), "pi": gamma[:, 0].sum(axis=0), "a": np.zeros_like(m.a)}
    steps = obs.shape[1]
    if steps > 1:
        # beta is 0 past a sequence's end, so its moves there are none.
        right = be[:, 1:] * beta[:, 1:] / np.where(scale[:, 1:] > 0, scale[:, 1:], 1)[..., None]
        left, kinds = alpha[:, :-1] * w[:, None, None], np.array([classes(m, t) for t in range(1, steps)])
        for k in np.unique(kinds):
            on = slice(None) if (kinds == k).all() else kinds == k
            out["a"][k] += m.a[k] * (left[:, on].reshape(-1, m.n).T @ right[:, on].reshape(-1, m.n))
    if m.b is not None:
        size, o = m.symbols, obs.astype(int)
        row, row_t = np.zeros(o.shape, int), np.zeros(len(o), int)
        for t in range(steps) if m.order else ():
            row_t = (row_t * size) % size ** (m.order + 1) + np.minimum(o[:, t], size - 1)
            row[:, t] = row_t
        row = row if m.order else np.minimum(o, size - 1)
        use = (o < size) & (np.arange(steps) >= m.order)
        out["b"] = np.stack([np.bincount(row[use], gamma[..., s][use], m.b.shape[1]) for s in range(m.n)])
        return out
    x = obs[..., None, None]
    part = m.c * np.exp(-((x - m.mu) ** 2) / (2 * m.var)) / np.sqrt(m.var)
    if m.cut is not None:
        from .truncated import above

        part = part / above(m.cut, m.mu, m.var)
    s = part.sum(axis=-1, keepdims=True)
    part = np.divide(part, s, out=np.zeros_like(part), where=s > 0) * gamma[..., None]
    out |= {"c": part.sum(axis=(0, 1)), "x": (part * x).sum(axis=(0, 1)), "xx": (part * x * x).sum(axis=(0, 1))}
    return out


def expected(seqs: DataFrame, m: Model, labelled: bool = False) -> dict[str, np.ndarray]:
    """Counts over all sequences: (name, place, value) rows, summed in Spark."""

    def run(frames):
        total: dict = {}
        for frame in frames:
            weight = frame["weight"].to_numpy() if "weight" in frame else np.ones(len(frame))
            for rows, obs, n in padded(frame, 1 << 19):
                allowed = None
                if labelled:
                    want = np.full(obs.shape, -1)
                    for i, x in enumerate(frame["state_labels"].iloc[rows]):
                        want[i, : n[i]] = x
                    allowed = want[..., None] == np.array(m.labels)
                for name, value in counted(m, obs, n, weight[rows], allowed).items():
                    total[name] = total.get(name, 0) + value
        if not total:
            return
        names = [k for k, v in total.items() for _ in range(v.size)]
        yield pd.DataFrame({"name": names, "place": [i for v in total.values() for i in range(v.size)], "value": np.concatenate([v.ravel() for v in total.values()])})

    keep = [c for c in ("seq_id", "weight", "obs", *(["state_labels"] if labelled else [])) if c in seqs.columns]
    rows = seqs.select(*keep).mapInPandas(run, "name string, place int, value double").groupBy("name", "place").agg(F.sum("value").alias("value")).collect()
    shapes = {"logp": (2,), "pi": m.pi.shape, "a": m.a.shape, "b": m.b.shape if m.b is not None else (), **({k: m.c.shape for k in ("c", "x", "xx")} if m.b is None else {})}
    out = {k: np.zeros(s) for k, s in shapes.items() if s}
    for r in rows:
        out[r["name"]].flat[r["place"]] = r["value"]
    return out


def _share(x: np.ndarray, old: np.ndarray) -> np.ndarray:
    s = x.sum(axis=-1, keepdims=True)
    return np.where(s > 0, np.divide(x, s, out=np.zeros_like(x), where=s > 0), old)


def maximized(m: Model, e: dict[str, np.ndarray]) -> Model:
    """The model of highest likelihood for the counts; fixed states keep their emissions, tied ones share theirs."""
    pi, a = (m.pi if m.from_first else _share(e["pi"], m.pi)), _share(e["a"], m.a)
    fixed = np.array(m.fixed or [False] * m.n, bool)
    if m.b is not None:
        counts = e["b"].copy()
        for group in {t for t in m.tied if t is not None}:
            at = [i for i, t in enumerate(m.tied) if t == group]
            counts[at] = counts[at].sum(axis=0)
        blocks = (m.n, -1, m.symbols)
        b = _share(counts.reshape(blocks), m.b.reshape(blocks)).reshape(m.b.shape)
        return replace(m, pi=pi, a=a, b=np.where(fixed[:, None], m.b, b))
    some = e["c"] > 1e-12
    c = _share(e["c"], m.c)
    mu = np.where(some, e["x"] / np.where(some, e["c"], 1), m.mu)
    var = np.where(some, np.maximum(e["xx"] / np.where(some, e["c"], 1) - mu**2, LEAST_VARIANCE), m.var)
    if m.cut is not None:
        from .truncated import fitted

        share = np.where(some, e["c"], 1)
        cut_mu, cut_var = fitted(e["x"] / share, e["xx"] / share, m.cut, LEAST_VARIANCE)
        mu, var = np.where(some, cut_mu, m.mu), np.where(some, cut_var, m.var)
    keep = fixed[:, None]
    return replace(m, pi=pi, a=a, c=np.where(keep, m.c, c), mu=np.where(keep, m.mu, mu), var=np.where(keep, m.var, var))


def baum_welch(seqs: DataFrame, m: Model, steps: int = STEPS, gain: float = GAIN, labelled: bool = False, watch: Callable | None = None) -> tuple[Model, float]:
    """Model and log-likelihood (impossible sequences cost PENALTY times their weight) after at most `steps` steps."""
    m = m.without_silent() if m.silent.any() else m
    seqs = seqs.persist()
    last = -np.inf
    try:
        for _ in range(steps):
            e = expected(seqs, m, labelled)
            now = e["logp"][0] + PENALTY * e["logp"][1]
            if watch:
                watch(now)
            if now - last <= gain * abs(now) and np.isfinite(last):
                break
            last, m = now, maximized(m, e)
        else:
            # Out of steps: the likelihood of the model that goes back, not of the one before it.
            e = expected(seqs, m, labelled)
            now = e["logp"][0] + PENALTY * e["logp"][1]
        return m, now
    finally:
        seqs.unpersist()


def trained_apart(seqs: DataFrame, models: list[Model], steps: int = STEPS, gain: float = GAIN) -> list[Model]:
    """Each model trained on the sequences of its own number (column model_id), all in one pass a step; each stops as baum_welch does.

    A model without sequences stays. Its last step's gain decides when a model leaves; then only its sequences' counts are left out.
    """
    models = [m.without_silent() if m.silent.any() else m for m in models]
    blocks = _prepared(seqs, models, ("model_id",))
    try:
        return _trained(blocks, models, steps, gain, {})
    finally:
        blocks.unpersist()


def _prepared(seqs: DataFrame, models: list[Model], more: tuple[str, ...] = ()) -> DataFrame:
    """Packed sequences, as codes of blocks of symbols where the models allow it: a pass then moves by blocks and costs a fraction."""
    blocks = packed(seqs, more)
    if not by_blocks.fits(models):
        return blocks
    out = by_blocks.coded(blocks, models[0].symbols, more).persist()
    out.count()
    blocks.unpersist()
    return out


def summed(rows: DataFrame, *keys: str) -> dict[tuple, float]:
    """Sums of value by keys. Each task has summed its own, so it sends as many rows as the models have parameters, without a shuffle."""
    out: dict = {}
    for r in rows.collect():
        key = tuple(r[k] for k in keys)
        out[key] = out.get(key, 0.0) + r["value"]
    return out


def _trained(blocks: DataFrame, models: list[Model], steps: int, gain: float, moved: dict[int, int]) -> list[Model]:
    """trained_apart over packed sequences. moved: sequences that count for another model than their own number."""
    models, last, moving = list(models), dict.fromkeys(range(len(models)), -np.inf), set(range(len(models)))
    for _ in range(steps):
        on = {k: models[k] for k in moving}

        def run(frames, on=on):
            total, kinds = {}, {}
            for x in unpacked(frames):
                of = x["model_id"].copy()
                for seq, k in moved.items():
                    of[x["ids"] == seq] = k
                for k, m in on.items():
                    own = np.flatnonzero(of == k)
                    if not len(own):
                        continue
                    if "codes" in x:
                        kinds[k] = kinds.get(k) or by_blocks.Kinds(m)
                        kinds[k].add(x["codes"][:, own], x["lengths"][own], x["weight"][own])
                        continue
                    for name, value in counted(m, x["obs"][own], x["lengths"][own], x["weight"][own]).items():
                        total[k, name] = total.get((k, name), 0) + value
            total |= {(k, name): value for k, sums in kinds.items() for name, value in sums.counts().items()}
            if total:
                yield pd.concat([pd.DataFrame({"model": k, "name": name, "place": np.arange(v.size), "value": v.ravel()}) for (k, name), v in total.items()])

        got: dict = {}
        rows = blocks.mapInPandas(run, "model int, name string, place int, value double")
        for (k, name, place), value in summed(rows, "model", "name", "place").items():
            got.setdefault(k, {}).setdefault(name, {})[place] = value
        for k in sorted(moving):
            if k not in got:
                moving.discard(k)
                continue
            m = models[k]
            shapes = {"logp": (2,), "pi": m.pi.shape, "a": m.a.shape} | ({"b": m.b.shape} if m.b is not None else {x: m.c.shape for x in ("c", "x", "xx")})
            e = {name: np.zeros(shape) for name, shape in shapes.items()}
            for name, values in got[k].items():
                e[name].flat[list(values)] = list(values.values())
            now = e["logp"][0] + PENALTY * e["logp"][1]
            if np.isfinite(last[k]) and now - last[k] <= gain * abs(now):
                moving.discard(k)
                continue
            last[k], models[k] = now, maximized(m, e)
        if not moving:
            break
    return models


def random_starts(seqs: DataFrame, m: Model, k: int, steps: int = 5, seed: int = 0) -> list[Model]:
    """k models for clustering: sequences are dealt to them by a hash of seq_id, and copies of m, each a little different, are trained on their shares."""
    part = F.pmod(F.xxhash64("seq_id", F.lit(seed)), F.lit(k)).cast("int")
    noisy = [m.with_noise(0.1, 1 + seed + i) if m.b is not None else replace(m, mu=m.mu + 0.1 * (i - k // 2) * np.sqrt(m.var)) for i in range(k)]
    return trained_apart(seqs.withColumn("model_id", part), noisy, steps)


def _reseeded(seqs: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """labels, where each of the k clusters has a member if there are so many sequences (see _moved)."""
    moved = _moved(seqs, labels, {r["model_id"]: r["n"] for r in labels.where("model_id is not null").groupBy("model_id").agg(F.count("*").alias("n")).collect()}, k)
    if not moved:
        return labels
    to = F.create_map(*[F.lit(x) for pair in moved.items() for x in pair])
    return labels.withColumn("model_id", F.coalesce(F.element_at(to, F.col("seq_id")), F.col("model_id")))


def _moved(seqs: DataFrame, labels: DataFrame, sizes: dict[int, int], k: int) -> dict[int, int]:
    """Sequences that go to empty clusters: an empty one gets the sequence that fits worst for its length, from a cluster that has others."""
    empty = [i for i in range(k) if not sizes.get(i)]
    if not empty:
        return {}
    fit = F.col("logp") / F.greatest(F.size("obs"), F.lit(1))
    worst = labels.where("model_id is not null").join(seqs.select("seq_id", "obs"), "seq_id").select("seq_id", "model_id", fit.alias("fit")).orderBy("fit", "seq_id").limit(2 * k)
    moved, sizes = {}, dict(sizes)
    for r in worst.collect():  # at most two for each cluster
        if len(moved) == len(empty):
            break
        if sizes[r["model_id"]] > 1:
            sizes[r["model_id"]] -= 1
            moved[r["seq_id"]] = empty[len(moved)]
    return moved


def viterbi_train(seqs: DataFrame, m: Model, steps: int = 50, pseudo: float = 0.0) -> Model:
    """Parameters from the counts of the best paths, until they no longer change."""
    from .hmm import decode

    seqs = seqs.persist()
    try:
        for _ in range(steps):
            d = decode(seqs, m).join(seqs, "seq_id").where("path is not null")
            pair = d.select("obs", "path")
            move = F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] as s, path[i] as t))")
            moves = pair.where("size(path) > 1").select(F.explode(move).alias("x"))
            a = np.full(m.a.shape, pseudo)
            for r in moves.groupBy("x.s", "x.t").count().collect():
                a[0, r["s"], r["t"]] += r["count"]
            b = np.full(m.b.shape, pseudo)
            for r in pair.select(F.explode(F.arrays_zip("path", "obs")).alias("x")).groupBy("x.path", "x.obs").count().collect():
                b[r["path"], int(r["obs"])] += r["count"]
            new = replace(m, a=_share(np.where(m.a > 0, a, 0), m.a), b=_share(np.where(m.b > 0, b, 0), m.b))
            if np.allclose(new.a, m.a) and np.allclose(new.b, m.b):
                return new
            m = new
        return m
    finally:
        seqs.unpersist()


def gradient(seqs: DataFrame, m: Model, steps: int = 20, rate: float = 0.1) -> tuple[Model, float]:
    """Raises the log-likelihood of the labels given the symbols, by batch steps along the difference of expected counts.

    The rate grows by 1.07 after a gain and shrinks by 0.85 after a loss, which is taken back.
    """
    seqs = seqs.persist()

    def both(m):
        with_labels, free = expected(seqs, m, True), expected(seqs, m)
        return with_labels["logp"][0] - free["logp"][0], with_labels, free

    try:
        best, up, down = both(m)
        for _ in range(steps):
            def moved(old, key, shape=None):
                x = old.reshape(shape) if shape else old
                g = (up[key] - down[key]).reshape(x.shape)
                y = np.where(x > 0, x * np.exp(np.clip(rate * g / max(np.abs(g).max(), 1e-12), -5, 5)), 0)
                return _share(y, x).reshape(old.shape)

            new = replace(m, a=moved(m.a, "a"), b=moved(m.b, "b", (m.n, -1, m.symbols)), pi=moved(m.pi, "pi"))
            value, u, d = both(new)
            if value > best:
                m, best, up, down, rate = new, value, u, d, rate * 1.07
            else:
                rate *= 0.85
        return m, float(best)
    finally:
        seqs.unpersist()


def cluster(seqs: DataFrame, models: list[Model], rounds: int | None = None, steps: int = 20, reseed: bool = False) -> tuple[list[Model], DataFrame]:
    """k models: each sequence to its best model, each model trained on its own, until no label changes.

    Rounds train by `steps` steps until no label changes, then by STEPS until none does again. A model without members
    keeps its parameters, or with reseed gets the sequence that fits worst elsewhere. Returns the models and (seq_id, model_id, logp), the labels that these models give.

    A pass over the sequences is a step of training, tells what labels the models would give now, and counts by these too. So a round whose
    training ends at once, as most do near the end, is one pass.
    """
    from .hmm import classify

    seqs = seqs.persist()
    blocks = _prepared(seqs, models)
    speaking = lambda some: [m.without_silent() if m.silent.any() else m for m in some]
    named, moved, turn = None, {}, 0
    try:
        while rounds is None or turn < rounds:
            if not turn:
                look = _looked(blocks, models, None, {})
            elif not look["other"]:
                if steps >= STEPS:
                    break
                steps = STEPS
            turn += 1
            named = models
            moved = _moved(seqs, classify(seqs, dict(enumerate(models))), look["sizes"], len(models)) if reseed else {}
            models = speaking(models)
            counts = _looked(blocks, models, named, moved)["old"] if moved else look["new"]
            last, moving = dict.fromkeys(range(len(models)), -np.inf), set(range(len(models)))
            models, fresh = list(models), False
            for step in range(steps):
                if step:
                    look = _looked(blocks, models, named, moved)
                    counts, fresh = look["old"], True
                for k in sorted(moving):
                    if k not in counts:
                        moving.discard(k)
                        continue
                    e = counts[k]
                    now = e["logp"][0] + PENALTY * e["logp"][1]
                    if np.isfinite(last[k]) and now - last[k] <= GAIN * abs(now):
                        moving.discard(k)
                        continue
                    last[k], models[k], fresh = now, maximized(models[k], e), False
                if not moving:
                    break
            # What the last pass told of labels holds, unless a step was made since.
            if not fresh and turn != rounds:
                look = _looked(blocks, models, named, moved)
    finally:
        blocks.unpersist()
    return models, classify(seqs, dict(enumerate(models)))


def _looked(blocks: DataFrame, now: list[Model], named: list[Model] | None, moved: dict[int, int]) -> dict:
    """One pass. old, new: counts for each model of its sequences by the labels of the models `named` (and moved) and by those of `now`, where it has any.

    sizes: sequences by new label; other: those whose label was another (moved ones by their own). Without `named` there are no old labels.
    """

    def labels_of(some, x, kinds):
        """Number of each sequence's best model (the lowest of equals), -1 for none."""
        if "codes" in x:
            logp = np.stack([k.loglik(x["codes"], x["lengths"]) for k in kinds], axis=1)
        else:
            logp = np.stack([forward(m, emissions(m, x["obs"]), x["lengths"])[2] for m in some], axis=1)
        joint = np.where(np.isnan(logp), -np.inf, logp) + np.log([m.prior for m in some])
        return np.where(np.isfinite(joint.max(axis=1)), joint.argmax(axis=1), -1)

    counting = [m.without_silent() if m.silent.any() else m for m in now]
    by_codes = "codes" in blocks.columns

    def run(frames):
        kinds, before = ([by_blocks.Kinds(m) for m in some or ()] if by_codes else None for some in (now, named))
        total, sums = {}, {}
        sizes, other = np.zeros(len(now)), 0
        for x in unpacked(frames):
            new = labels_of(now, x, kinds)
            old = np.full(len(new), -1) if named is None else labels_of(named, x, before)
            other += int((new != old).sum())
            sizes += np.bincount(new[new >= 0], minlength=len(now))
            for seq, k in moved.items():
                old[x["ids"] == seq] = k
            for k, m in enumerate(counting):
                for part, own in (("stay", (old == k) & (new == k)), ("left", (old == k) & (new != k)), ("came", (old != k) & (new == k))):
                    own = np.flatnonzero(own)
                    if not len(own):
                        continue
                    if by_codes:
                        sums[part, k] = sums.get((part, k)) or kinds[k].fresh()
                        sums[part, k].add(x["codes"][:, own], x["lengths"][own], x["weight"][own])
                        continue
                    for name, value in counted(m, x["obs"][own], x["lengths"][own], x["weight"][own]).items():
                        total[part, k, name] = total.get((part, k, name), 0) + value
        total |= {(*key, name): value for key, s in sums.items() for name, value in s.counts().items()}
        total |= {("", -1, "sizes"): sizes, ("", -1, "other"): np.array([float(other)])}
        yield pd.concat([pd.DataFrame({"part": part, "model": k, "name": name, "place": np.arange(v.size), "value": v.ravel()}) for (part, k, name), v in total.items()])

    got: dict = {}
    for (part, k, name, place), value in summed(blocks.mapInPandas(run, "part string, model int, name string, place int, value double"), "part", "model", "name", "place").items():
        got.setdefault((part, k), {}).setdefault(name, {})[place] = value
    whole = got.pop(("", -1), {"sizes": {}, "other": {}})
    out: dict = {"old": {}, "new": {}, "sizes": {k: int(n) for k, n in whole["sizes"].items()}, "other": int(whole["other"].get(0, 0))}
    for label, parts in (("old", ("stay", "left")), ("new", ("stay", "came"))):
        for k, m in enumerate(counting):
            if any((part, k) in got for part in parts):
                shapes = {"logp": (2,), "pi": m.pi.shape, "a": m.a.shape} | ({"b": m.b.shape} if m.b is not None else {x: m.c.shape for x in ("c", "x", "xx")})
                e = {name: np.zeros(shape) for name, shape in shapes.items()}
                for part in parts:
                    for name, values in got.get((part, k), {}).items():
                        e[name].flat[list(values)] += list(values.values())
                out[label][k] = e
    return out


def mixture(seqs: DataFrame, models: list[Model], rounds: int = STEPS, gain: float = GAIN, steps: int = 10) -> tuple[list[Model], float]:
    """EM over a mixture of models: soft weights of each sequence, then each model trained by them. Priors are kept in the models.

    Ends at a relative gain of `gain` or after `rounds`; the log-likelihood is that of the models returned.
    """
    seqs, last = seqs.persist(), -np.inf
    for turn in range(rounds + 1):
        joint = scores(seqs, dict(enumerate(models))).na.drop(subset=["logp"])
        priors = F.create_map(*[F.lit(x) for k, m in enumerate(models) for x in (k, float(np.log(max(m.prior, 1e-300))))])
        joint = joint.withColumn("j", F.col("logp") + F.element_at(priors, F.col("model_id")))
        wide = joint.groupBy("seq_id").agg(F.map_from_entries(F.collect_list(F.struct("model_id", "j"))).alias("js"))
        top = F.array_max(F.map_values("js"))
        wide = wide.withColumn("all", top + F.log(F.aggregate(F.map_values("js"), F.lit(0.0), lambda s, x: s + F.exp(x - top)))).persist()
        now = wide.agg(F.sum("all")).first()[0] or 0.0
        if turn == rounds or (np.isfinite(last) and now - last <= gain * abs(now)):
            wide.unpersist()
            break
        last = now
        soft = [seqs.drop("weight").join(wide.select("seq_id", F.coalesce(F.exp(F.element_at("js", F.lit(k)) - F.col("all")), F.lit(0.0)).alias("weight")), "seq_id") for k in range(len(models))]
        n = max(wide.count(), 1)
        share = [s.agg(F.sum("weight")).first()[0] / n for s in soft]
        models = [replace(baum_welch(s, m, steps)[0], prior=p) for s, m, p in zip(soft, models, share)]
        wide.unpersist()
    return models, now
