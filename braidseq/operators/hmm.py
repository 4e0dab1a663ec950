"""Likelihood, decoding and posteriors of sequence tables under a model.

Sequences are rows, so all of this is narrow: no shuffle, the model travels with the task. Within a batch sequences
of like length advance together, so a step is one matrix product for all of them. Small models without silent
states also have a form that stays in the JVM (`forward_fold`).
"""

from __future__ import annotations

from math import log, nan, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.models import Model
from . import antidiagonals
from .state import settle

#: Emissions of pair alignments that a task remembers.
KNOWN = 1 << 20


def emissions(m: Model, obs: np.ndarray) -> np.ndarray:
    """b (batch, time, states) of padded observations; symbol m.symbols is a missing one."""
    if m.b is None:
        x = obs[..., None, None]
        d = m.c * np.exp(-((x - m.mu) ** 2) / (2 * m.var)) / np.sqrt(2 * pi * m.var)
        if m.cut is not None:
            from ..functions.numeric import erfc

            tail = np.vectorize(lambda mu, v: 0.5 * erfc((m.cut - mu) / (2 * v) ** 0.5))(m.mu, m.var)
            d = np.where(x < m.cut, 0, d / tail)
        return d.sum(axis=-1)
    base = np.where(m.silent[:, None], 1.0, m.b)
    if not m.order:
        return np.concatenate([base, np.ones((m.n, 1))], axis=1)[:, obs.astype(int)].transpose(1, 2, 0)
    # Before `order` symbols have been seen the rows of all histories that end in what was seen are averaged.
    size, out = m.symbols, np.empty((*obs.shape, m.n))
    row = np.zeros(len(obs), int)
    for t in range(obs.shape[1]):
        o = obs[:, t].astype(int)
        row = (row * size) % size ** (m.order + 1) + np.minimum(o, size - 1)
        seen = min(t, m.order)
        table = base.reshape(m.n, size ** (m.order - seen), -1).mean(axis=1)
        out[:, t] = np.where((o < size)[:, None], table[:, row % table.shape[1]].T, 1.0)
    return out


def padded(frame: pd.DataFrame, size: int = 1 << 21):
    """(rows, observations, lengths) in order of length, cells bounded."""
    lengths = frame["obs"].map(lambda x: 0 if x is None else len(x)).to_numpy()
    order, at = np.argsort(lengths, kind="stable"), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * lengths[order[end]] <= size:
            end += 1
        rows = order[at:end]
        obs = np.zeros((len(rows), max(int(lengths[rows].max()), 1)))
        for i, r in enumerate(rows):
            if lengths[r]:
                obs[i, : lengths[r]] = frame["obs"].iloc[r]
        yield rows, obs, lengths[rows]
        at = end


#: Symbols of a task's share where passes over the sequences are many: of small tables, of large ones.
SHARE = (1 << 16, 1 << 19)


def packed(seqs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """seqs for many passes: rows (ids, obs, lengths, weight, more; binary) of padded batches, in as many partitions as their symbols need.

    more: columns of whole numbers, -1 for null. Sequences without symbols stay; read with unpacked.
    """
    weight = [F.col("weight").cast("double").alias("weight")] if "weight" in seqs.columns else [F.lit(1.0).alias("weight")]
    d = seqs.select(F.col("seq_id").cast("long").alias("seq_id") if "seq_id" in seqs.columns else F.lit(0).cast("long").alias("seq_id"), "obs", *weight, *[F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long")).alias(c) for c in more]).persist()
    total = d.agg(F.sum(F.greatest(F.size("obs"), F.lit(1)).cast("long"))).first()[0] or 0
    tasks = max(1, min(-(-total // SHARE[0]), max(seqs.sparkSession.sparkContext.defaultParallelism, -(-total // SHARE[1]))))

    def run(frames):
        for frame in frames:
            for rows, obs, n in padded(frame, 1 << 19):
                own = frame.iloc[rows]
                columns = {"ids": own["seq_id"].to_numpy(np.int64), "obs": obs, "lengths": n.astype(np.int64), "weight": own["weight"].to_numpy(float), **{c: own[c].to_numpy(np.int64) for c in more}}
                yield pd.DataFrame({k: [np.ascontiguousarray(v).tobytes()] for k, v in columns.items()})

    out = settle(d.repartition(tasks).mapInPandas(run, ", ".join(f"{c} binary" for c in ("ids", "obs", "lengths", "weight", *more)))).persist()
    d.unpersist()
    return out


def unpacked(frames):
    """Batches of packed sequences: dicts of arrays, with obs or the codes of blocks.coded."""
    for frame in frames:
        for r in frame.to_dict("records"):
            out = {k: np.frombuffer(v, float if k in ("obs", "weight") else np.uint16 if k == "codes" else np.int64) for k, v in r.items()}
            if "codes" in out:
                out["codes"] = out["codes"].reshape(-1, len(out["ids"]))
            else:
                out["obs"] = out["obs"].reshape(len(out["ids"]), -1)
            yield out


def classes(m: Model, t: int) -> int:
    """Transition class of step t: classes take turns unless the model names its own rule."""
    rule = m.extra.get("class_of")
    return rule(t) if rule else t % len(m.a)


def forward(m: Model, b: np.ndarray, lengths: np.ndarray, allowed: np.ndarray | None = None):
    """Scaled alphas (batch, time, states), scales (batch, time), log-likelihood (nan: impossible; 0 for empty ones)."""
    n, steps, _ = b.shape
    if not m.silent.any():
        return _forward_speaking(m, b if allowed is None else b * allowed, lengths)
    silent = m.silent_order()
    alpha, scale = np.zeros((n, steps, m.n)), np.ones((n, steps))
    b = b if allowed is None else b * allowed
    speaks = ~m.silent

    def settle(x, k):
        for s in silent:
            x[:, s] = (x * np.where(np.arange(m.n) == s, 0, 1)) @ m.a[k][:, s] + entry[:, s]
        return x

    for t in range(steps):
        k = classes(m, t)
        if t == 0:
            entry = np.tile(m.a[k][0] if m.from_first else m.pi, (n, 1)).astype(float)
            # Mass that starts in silent states runs on before the first symbol.
            for s in silent:
                entry = entry + entry[:, [s]] * m.a[k][s] * np.where(np.arange(m.n) == s, 0, 1)
            x = entry * b[:, 0] * speaks
            entry = np.zeros_like(entry)
        else:
            x = (alpha[:, t - 1] @ m.a[k]) * b[:, t] * speaks
        x = settle(x, k)
        total = x[:, speaks].sum(axis=1)
        live = (t < lengths) & (total > 0)
        scale[:, t] = np.where(live, total, np.where(t < lengths, 0, 1))
        alpha[:, t] = np.where(live[:, None], x / np.where(total > 0, total, 1)[:, None], 0)
    with np.errstate(divide="ignore"):
        logp = np.log(scale).sum(axis=1)
    return alpha, scale, np.where(np.isfinite(logp), logp, np.nan)


def _forward_speaking(m: Model, b: np.ndarray, lengths: np.ndarray):
    """forward without silent states: fewer operations a step."""
    n, steps, _ = b.shape
    alpha, scale = np.zeros((steps, n, m.n)), np.ones((steps, n))
    for t in range(steps):
        k = classes(m, t)
        x = ((m.a[k][0] if m.from_first else m.pi) if t == 0 else alpha[t - 1] @ m.a[k]) * b[:, t]
        total = x.sum(axis=1)
        on = t < lengths
        live = on & (total > 0)
        if live.all():
            scale[t] = total
            np.divide(x, total[:, None], out=alpha[t])
        else:
            scale[t] = np.where(live, total, np.where(on, 0, 1))
            np.divide(x, total[:, None], out=alpha[t], where=live[:, None])
    with np.errstate(divide="ignore"):
        logp = np.log(scale.T).sum(axis=1)
    return alpha.transpose(1, 0, 2), scale.T, np.where(np.isfinite(logp), logp, np.nan)


def backward(m: Model, b: np.ndarray, lengths: np.ndarray, scale: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """Betas scaled as the alphas; models with silent states are taken without them."""
    n, steps, _ = b.shape
    b = b if allowed is None else b * allowed
    beta = np.zeros((n, steps, m.n))
    for t in range(steps - 1, -1, -1):
        last = (t == lengths - 1)[:, None]
        if t == steps - 1:
            beta[:, t] = np.where(last, 1.0, 0.0)
            continue
        s = np.where(scale[:, t + 1] > 0, scale[:, t + 1], 1)[:, None]
        beta[:, t] = np.where(last, 1.0, ((b[:, t + 1] * beta[:, t + 1]) @ m.a[classes(m, t + 1)].T) / s)
    return beta


def viterbi(m: Model, b: np.ndarray, lengths: np.ndarray):
    """Best paths (lists of emitting states) and their log-likelihoods. The first maximum wins, the lowest final state too."""
    if m.silent.any():
        m = m.without_silent()
    n, steps, _ = b.shape
    with np.errstate(divide="ignore"):
        a, start, lb = np.log(m.a), np.log(m.a[0][0] if m.from_first else m.pi), np.log(b)
    back = np.zeros((n, steps, m.n), np.int32)
    delta, best = start + lb[:, 0], np.full((n, m.n), -np.inf)
    for t in range(steps):
        if t:
            ways = delta[:, :, None] + a[classes(m, t)][None]
            back[:, t] = ways.argmax(axis=1)
            delta = ways.max(axis=1) + lb[:, t]
        best = np.where((lengths - 1 == t)[:, None], delta, best)
    paths, logp = [], best.max(axis=1)
    for i in range(n):
        if not lengths[i]:
            paths.append([])
            continue
        if not np.isfinite(logp[i]):
            paths.append(None)
            continue
        s, path = int(best[i].argmax()), []
        for t in range(lengths[i] - 1, -1, -1):
            path.append(s)
            s = int(back[i, t, s])
        paths.append(path[::-1])
    return paths, np.where(lengths == 0, 0.0, np.where(np.isfinite(logp), logp, np.nan))


def _mapped(seqs: DataFrame, schema: str, work) -> DataFrame:
    """work(rows, obs, lengths) gives a frame's columns for those rows."""

    def run(frames):
        for frame in frames:
            for rows, obs, lengths in padded(frame):
                yield pd.DataFrame({"seq_id": frame["seq_id"].to_numpy()[rows], **work(frame.iloc[rows], obs, lengths)})

    keep = [c for c in ("seq_id", "weight", "label", "obs", "state_labels") if c in seqs.columns]
    return seqs.select(*keep).mapInPandas(run, schema)


def loglik(seqs: DataFrame, m: Model) -> DataFrame:
    """seq_id, logp; null for an impossible sequence, 0 for an empty one."""
    return _mapped(seqs, "seq_id long, logp double", lambda f, obs, n: {"logp": forward(m, emissions(m, obs), n)[2]})


def backward_loglik(seqs: DataFrame, m: Model) -> DataFrame:
    """seq_id, logp from the backward variables."""
    m = m.without_silent() if m.silent.any() else m

    def work(f, obs, n):
        b = emissions(m, obs)
        scale = forward(m, b, n)[1]
        beta = backward(m, b, n, scale)
        start = m.a[0][0] if m.from_first else m.pi
        with np.errstate(divide="ignore"):
            logp = np.log((start * b[:, 0] * beta[:, 0]).sum(axis=1)) + np.log(scale[:, 1:]).sum(axis=1)
        return {"logp": np.where(n == 0, 0.0, np.where(np.isfinite(logp), logp, np.nan))}

    return _mapped(seqs, "seq_id long, logp double", work)


def label_loglik(seqs: DataFrame, m: Model) -> DataFrame:
    """seq_id, logp of symbols and state labels together."""
    if m.silent.any():
        raise ValueError("labelled models have no silent states")

    def work(f, obs, n):
        want = np.full(obs.shape, -1)
        for i, x in enumerate(f["state_labels"]):
            want[i, : n[i]] = x
        return {"logp": forward(m, emissions(m, obs), n, want[..., None] == np.array(m.labels))[2]}

    return _mapped(seqs, "seq_id long, logp double", work)


def decode(seqs: DataFrame, m: Model) -> DataFrame:
    """seq_id, path, logp of the most probable path; null path and logp if there is none."""
    m = m.without_silent() if m.silent.any() else m

    def work(f, obs, n):
        paths, logp = viterbi(m, emissions(m, obs), n)
        return {"path": paths, "logp": logp}

    return _mapped(seqs, "seq_id long, path array<int>, logp double", work)


def posterior(seqs: DataFrame, m: Model) -> DataFrame:
    """seq_id, pos, state, p: probabilities of the states at each place. Impossible sequences give no rows."""
    m = m.without_silent() if m.silent.any() else m

    def run(frames):
        for frame in frames:
            for rows, obs, n in padded(frame, 1 << 18):
                b = emissions(m, obs)
                alpha, scale, logp = forward(m, b, n)
                gamma = alpha * backward(m, b, n, scale)
                i, t = np.nonzero((np.arange(obs.shape[1])[None] < n[:, None]) & ~np.isnan(logp)[:, None])
                g = gamma[i, t] / gamma[i, t].sum(axis=1, keepdims=True)
                ids = frame["seq_id"].to_numpy()[rows][i]
                yield pd.DataFrame({"seq_id": np.repeat(ids, m.n), "pos": np.repeat(t, m.n), "state": np.tile(np.arange(m.n), len(t)), "p": g.ravel()})

    return seqs.select("seq_id", "obs").mapInPandas(run, "seq_id long, pos int, state int, p double")


def forward_fold(seqs: DataFrame, m: Model) -> DataFrame:
    """loglik as a fold in the JVM, for at most 8 states, no silent ones, no history and one class; expressions grow with states squared."""
    if m.n > 8 or m.silent.any() or m.order or len(m.a) > 1 or m.b is None:
        raise ValueError("use loglik for this model")
    rows = F.array(*[F.array(*[F.lit(float(p)) for p in [*m.b[:, s], *[]]]) for s in range(m.symbols)])
    start = F.struct(*[F.lit(float(p)).alias(f"p{i}") for i, p in enumerate(m.a[0][0] if m.from_first else m.pi)], F.lit(0.0).alias("l"), F.lit(False).alias("on"))

    def step(acc, o):
        e = F.get(rows, o)
        # From the second symbol on the state moves before it speaks.
        into = [F.when(acc["on"], sum((acc[f"p{i}"] * float(m.a[0, i, j]) for i in range(m.n)), F.lit(0.0))).otherwise(acc[f"p{j}"]) for j in range(m.n)]
        x = F.array(*[into[j] * F.get(e, F.lit(j)) for j in range(m.n)])
        return F.struct(*[F.get(x, F.lit(i)).alias(f"p{i}") for i in range(m.n)], acc["l"].alias("l"), F.lit(True).alias("on"))

    def scaled(acc, o):
        s = step(acc, o)
        total = sum((s[f"p{i}"] for i in range(m.n)), F.lit(0.0))
        return F.struct(*[F.when(total > 0, s[f"p{i}"] / total).otherwise(0.0).alias(f"p{i}") for i in range(m.n)], (acc["l"] + F.when(total > 0, F.log(total))).alias("l"), F.lit(True).alias("on"))

    return seqs.select("seq_id", F.aggregate("obs", start, scaled, lambda acc: acc["l"]).alias("logp"))


def scores(seqs: DataFrame, models: dict[int, Model]) -> DataFrame:
    """seq_id, model_id, logp of every sequence under every model, in one pass over the sequences."""

    def run(frames):
        for frame in frames:
            for rows, obs, n in padded(frame):
                for k, m in models.items():
                    yield pd.DataFrame({"seq_id": frame["seq_id"].to_numpy()[rows], "model_id": k, "logp": forward(m, emissions(m, obs), n)[2]})

    return seqs.select("seq_id", "obs").mapInPandas(run, "seq_id long, model_id int, logp double")


def classify(seqs: DataFrame, models: dict[int, Model]) -> DataFrame:
    """seq_id, model_id of the highest log P + log prior (ties: the lowest), its logp and posterior. One row per sequence leaves the task."""

    def work(f, obs, n):
        logp = np.stack([forward(m, emissions(m, obs), n)[2] for m in models.values()], axis=1)
        joint = np.where(np.isnan(logp), -np.inf, logp) + np.log([m.prior for m in models.values()])
        best = joint.argmax(axis=1)
        top = joint.max(axis=1)
        with np.errstate(invalid="ignore"):
            share = 1 / np.exp(joint - top[:, None]).sum(axis=1)
        none = ~np.isfinite(top)
        pick = np.array(list(models))[best]
        return {"model_id": pd.array(np.where(none, 0, pick), "Int32") if not none.any() else pd.Series(pick).astype("Int32").mask(none), "logp": logp[np.arange(len(n)), best], "posterior": np.where(none, np.nan, share)}

    return _mapped(seqs, "seq_id long, model_id int, logp double, posterior double", work)


def kbest(seqs: DataFrame, m: Model, k: int = 3, threshold: float = log(0.03)) -> DataFrame:
    """seq_id, labels, logp: the most probable labelling found with k hypotheses per state, each the sum over its paths.

    A hypothesis goes on if in some state it is among the k best and not below `threshold` (a logarithm) of that state's best. The hypotheses
    of all sequences of a batch go on together; each knows its parent, so they share their beginnings. Equal ones go in order of their labels.
    """
    labels = np.array(m.labels)
    names = np.unique(labels)
    share = np.exp(threshold)

    def batch(obs, n):
        b, count = emissions(m, obs), len(obs)
        start = m.a[0][0] if m.from_first else m.pi
        own, g, steps = np.arange(count)[n > 0], None, []
        shift, found = np.zeros(count), [([], 0.0) if not n[i] else (None, None) for i in range(count)]
        for t in range(obs.shape[1]):
            x = np.tile(start, (len(own), 1)) * b[own, t] if t == 0 else (g @ m.a[classes(m, t)]) * b[own, t]
            # Every hypothesis is followed by each label, in order of the labels.
            parent, label = np.repeat(np.arange(len(x)), len(names)), np.tile(names, len(x))
            x = np.where(labels[None] == label[:, None], x[parent], 0.0)
            live = x.max(axis=1) > 0
            parent, label, x = parent[live], label[live], x[live]
            seq = own[parent]
            if len(x):
                begin = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
                group = np.cumsum(np.concatenate([[False], seq[1:] != seq[:-1]]))
                keep = np.zeros(len(x), bool)
                for s in range(m.n):
                    order = np.lexsort((np.arange(len(x)), -x[:, s], seq))
                    best = x[order[begin], s]
                    rank = np.arange(len(x)) - begin[group]
                    keep[order] |= (rank < k) & (x[order, s] > 0) & (x[order, s] >= share * best[group])
                top = np.maximum.reduceat(x.max(axis=1), begin)
                x = x / top[group][:, None]
                shift[seq[begin]] += np.log(top)
                parent, label, x, seq = parent[keep], label[keep], x[keep], seq[keep]
            steps.append((parent, label))
            for i in np.unique(seq[n[seq] == t + 1]).tolist():
                at = np.flatnonzero(seq == i)
                total = x[at].sum(axis=1)
                h, path = int(at[total.argmax()]), []
                for up, names_of in reversed(steps):
                    path.append(int(names_of[h]))
                    h = int(up[h])
                found[i] = (path[::-1], float(shift[i] + np.log(total.max())))
            on = n[seq] > t + 1
            # Hypotheses of sequences that have ended go; the places of the others in this step are kept for their children.
            steps[-1] = (parent[on], label[on])
            own, g = seq[on], x[on]
            if not len(own):
                break
        return found

    def run(frames):
        for frame in frames:
            for rows, obs, n in padded(frame, 1 << 18):
                got = batch(obs, n)
                yield pd.DataFrame({"seq_id": frame["seq_id"].to_numpy()[rows], "labels": [x[0] for x in got], "logp": [x[1] for x in got]})

    return seqs.select("seq_id", "obs").mapInPandas(run, "seq_id long, labels array<int>, logp double")


def align(pairs: DataFrame, a: np.ndarray, start: np.ndarray, steps: list[tuple[int, int]], emit) -> DataFrame:
    """seq_id, path, logp of the best pair alignment of x and y (arrays of ints).

    steps: what of x and y each state takes; emit(state, xs, ys): its emission probability for those symbols.
    """
    with np.errstate(divide="ignore"):
        la, ls = np.log(a), np.log(start)

    most_x = max(i for i, _ in steps)
    known = {}

    def coded(values, first, size):
        """For each place the number of the run of `size` symbols that ends there (-1: none), and the runs; first: of each row's sequence, the place before its symbols."""
        at = np.arange(len(values)) - first
        ends = np.flatnonzero(at >= size)
        runs, codes = np.unique(values[ends[:, None] + np.arange(1 - size, 1)], axis=0, return_inverse=True) if size else (np.zeros((1, 0)), np.zeros(len(ends), int))
        out = np.full(len(values), -1)
        out[ends] = codes.reshape(-1)
        return out, [tuple(int(z) if z == z else nan for z in run) for run in runs.tolist()]

    def emitted(s, kinds, codes, owners, n):
        """Log emissions of a state by numbers of runs; each pair of runs that meet in one alignment is asked for once in a task."""
        seen = [np.zeros((n, len(k) + 1), np.float32) for k in kinds]
        for z, c, of in zip(seen, codes, owners):
            z[of, c] = 1
        e = np.zeros((len(kinds[0]) + 1, len(kinds[1]) + 1))
        for p, q in np.argwhere((seen[0].T @ seen[1])[:-1, :-1] > 0).tolist():
            key = (s, kinds[0][p], kinds[1][q])
            if key not in known:
                if len(known) > KNOWN:
                    known.clear()
                known[key] = emit(s, list(key[1]), list(key[2]))
            e[p, q] = known[key]
        return np.log(np.maximum(e, 0))

    def aligned(xs, ys):
        b = antidiagonals.Beside([len(x) for x in xs], [len(y) for y in ys], most_x)
        flat = [np.concatenate([np.asarray(part, float) for z in zs for part in (np.zeros(gap), z)]) for zs, gap in ((xs, most_x + 1), (ys, 1))]
        owners = [b.of, np.repeat(np.arange(len(ys)), b.ny + 1)]
        first = [b.base[b.of], b.y_base[owners[1]]]
        codes, runs = {}, {}
        for side in (0, 1):
            for size in {step[side] for step in steps}:
                codes[side, size], runs[side, size] = coded(flat[side], first[side], size)
        if len(xs) > 1 and any(len(runs[0, i]) * len(runs[1, j]) > b.cells for i, j in steps):
            # Runs that differ from pair to pair: a table of all would outgrow the pairs' own.
            half = len(xs) // 2
            return aligned(xs[:half], ys[:half]) + aligned(xs[half:], ys[half:])
        with np.errstate(divide="ignore"):
            e = [emitted(s, (runs[0, i], runs[1, j]), (codes[0, i], codes[1, j]), owners, len(xs)) for s, (i, j) in enumerate(steps)]

        def said(s, rows, pair, u, v):
            i, j = steps[s]
            return e[s][codes[0, i][rows], codes[1, j][b.y_base[pair] + v]]

        final, back = antidiagonals.sweep(b, steps, ls, la[None], said, None, -np.inf, np.full(len(xs), -1), True)
        end = final.argmax(axis=1)
        logp = final[np.arange(len(end)), end]
        end = np.where(np.isfinite(logp), end, -1)
        return [(p, z) if s >= 0 else (None, None) for p, z, s in zip(antidiagonals.traced(b, steps, back, end), logp.tolist(), end)]

    def run(frames):
        for frame in frames:
            sizes = (frame["x"].map(len).to_numpy(np.int64) + 1) * (frame["y"].map(len).to_numpy(np.int64) + 1) * len(steps)
            for some in antidiagonals.batches(sizes):
                d = frame.iloc[some]
                got = aligned(list(d["x"]), list(d["y"]))
                yield pd.DataFrame({"seq_id": d["seq_id"].to_numpy(), "path": [g[0] for g in got], "logp": [g[1] for g in got]})

    return pairs.select("seq_id", "x", "y").mapInPandas(run, "seq_id long, path array<int>, logp double")
