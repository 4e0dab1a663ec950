"""Training against the other classes: numeric slopes, an objective that never falls, and better separation."""

from dataclasses import replace

import numpy as np
import pytest

from braidseq.operators import discriminative as disc
from braidseq.operators import hmm
from braidseq.plans.models import Model

RNG = np.random.default_rng(8)
MODELS = [
    Model.of([0.6, 0.4], [[0.7, 0.3], [0.4, 0.6]], [[0.5, 0.3, 0.2], [0.2, 0.3, 0.5]], prior=0.5),
    Model.of([0.5, 0.5], [[0.6, 0.4], [0.5, 0.5]], [[0.3, 0.4, 0.3], [0.4, 0.2, 0.4]], prior=0.3),
    Model.of([1.0, 0.0], [[0.5, 0.5], [0.0, 1.0]], [[0.2, 0.5, 0.3], [0.5, 0.0, 0.5]], prior=0.2),
]


@pytest.fixture(scope="module")
def seqs(spark):
    rows = []
    for i in range(60):
        k = i % 3
        rows.append((i, k, [1.0, 0.5, 2.0][i % 3], RNG.choice(3, 3 + i % 12, p=[[0.6, 0.3, 0.1], [0.2, 0.5, 0.3], [0.3, 0.2, 0.5]][k]).tolist()))
    rows += [(100, 7, 1.0, [0, 1]), (101, None, 1.0, [0])]  # labels of no model
    return spark.createDataFrame(rows, "seq_id long, label int, weight double, obs array<int>")


def objective(models, rows, alpha=1.0):
    total = 0.0
    for r in rows:
        if r["label"] is None or r["label"] >= len(models):
            continue
        p = [m.prior * float(brute(m, r["obs"])) for m in models]
        rest = sum(p) - p[r["label"]]
        x = p[r["label"]] / rest
        total += r["weight"] * (x**alpha / (1 + x**alpha))
    return total


def brute(m, obs):
    f = m.pi * m.b[:, obs[0]]
    for o in obs[1:]:
        f = (f @ m.a[0]) * m.b[:, o]
    return f.sum()


def test_coupled_pass(seqs):
    rows = seqs.collect()
    for alpha in (1.0, 0.3):
        value, symbols, counts = disc.coupled(seqs, MODELS, alpha)
        assert value == pytest.approx(objective(MODELS, rows, alpha))
        assert symbols == sum(len(r["obs"]) for r in rows if r["seq_id"] < 100)
        for k, m in enumerate(MODELS):
            slopes = disc.slopes(m, counts[k])
            for name in ("pi", "a", "b"):
                old = getattr(m, name)
                for at in np.ndindex(old.shape):
                    if old[at] == 0:
                        assert slopes[name][at] == 0
                        continue
                    h, side = 1e-6, []
                    for d in (h, -h):
                        x = old.copy()
                        x[at] += d
                        side.append(objective([replace(q, **{name: x}) if j == k else q for j, q in enumerate(MODELS)], rows, alpha))
                    assert slopes[name][at] == pytest.approx((side[0] - side[1]) / (2 * h), rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("form", ["gradient", "closed"])
def test_training(seqs, form):
    fitted, seen = disc.train(seqs, MODELS, form, steps=8)
    assert len(seen) > 2 and all(b > a for a, b in zip(seen, seen[1:]))
    rows, share = seqs.collect(), [20.0 / 70, 10.0 / 70, 40.0 / 70]
    assert seen[-1] == pytest.approx(objective([replace(m, prior=p) for m, p in zip(fitted, share)], rows))
    assert [m.prior for m in fitted] == [m.prior for m in MODELS] and not any(m.problems() for m in fitted)
    assert fitted[2].a[0, 1, 0] == 0 and fitted[2].b[1, 1] == 0
    wrong = lambda models: sum(r["false_negatives"] for r in disc.errors(seqs, models).collect())
    assert wrong(fitted) <= wrong(MODELS)


def test_step_factor_keeps_numerators_above_zero(seqs):
    _, _, counts = disc.coupled(seqs, MODELS)
    for m, c in zip(MODELS, counts):
        f = disc.step_factor(m, c)
        assert 0 < f < 1
        for name in ("pi", "a", "b"):
            assert (c["own"][name] - f * c["rest"][name] >= -1e-12).all()


def test_fixed_states_and_errors(seqs):
    models = [replace(m, fixed=(True, False)) for m in MODELS]
    fitted, _ = disc.train(seqs, models, "closed", steps=1)
    assert all((f.b[0] == m.b[0]).all() for f, m in zip(fitted, models)) and any((f.b[1] != m.b[1]).any() for f, m in zip(fitted, models))
    rows = [r for r in seqs.collect() if r["seq_id"] < 100]
    best = {r["seq_id"]: int(np.argmax([brute(m, r["obs"]) for m in MODELS])) for r in rows}
    got = {r["label"]: (r["n"], r["false_negatives"], r["false_positives"]) for r in disc.errors(seqs, MODELS).collect()}
    for k in range(3):
        assert got[k] == (20, sum(r["label"] == k and best[r["seq_id"]] != k for r in rows), sum(r["label"] != k and best[r["seq_id"]] == k for r in rows))
    with pytest.raises(ValueError):
        disc.train(seqs, MODELS[:1])
    with pytest.raises(ValueError):
        disc.train(seqs, MODELS, "other")


def test_impossible_sequences(spark):
    certain = Model.of([1.0], [[1.0]], [[1.0, 0.0]], prior=0.5)
    other = Model.of([1.0], [[1.0]], [[0.0, 1.0]], prior=0.5)
    d = spark.createDataFrame([(1, 0, [0, 0]), (2, 0, [1, 1]), (3, 0, [0, 1]), (4, 1, [1])], "seq_id long, label int, obs array<int>")
    got = {r["seq_id"]: (r["performance"], r["slope"]) for r in disc.margin_table(d, [certain, other]).collect()}
    assert got == {1: (1.0, 0.0), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (1.0, 0.0)}
    assert hmm.loglik(d, certain).where("seq_id = 2").first()["logp"] is None
