"""Mixtures of several sizes trained at once, against each trained alone by plain loops."""

from dataclasses import replace

import numpy as np
import pytest

from braidseq.operators import selection
from braidseq.operators.training import counted, maximized
from braidseq.plans.models import Model

RNG = np.random.default_rng(31)
START = Model.of([0.5, 0.5], [[0.6, 0.4], [0.4, 0.6]], [[0.5, 0.3, 0.2], [0.2, 0.3, 0.5]])


@pytest.fixture(scope="module")
def seqs(spark):
    kinds = [[0.8, 0.1, 0.1], [0.1, 0.1, 0.8]]
    rows = [(i, [1.0, 2.0][i % 2], RNG.choice(3, 4 + i % 9, p=kinds[i % 2]).tolist()) for i in range(60)] + [(99, 1.0, [])]
    return spark.createDataFrame(rows, "seq_id long, weight double, obs array<int>")


def alone(rows, models, steps):
    """Plain EM over a mixture, sequence by sequence."""
    for _ in range(steps):
        total = [None] * len(models)
        logs = [[like(m, o) for m in models] for _, o in rows]
        for (w, o), ps in zip(rows, logs):
            joint = np.array([m.prior * p for m, p in zip(models, ps)])
            part = joint / joint.sum()
            for i, m in enumerate(models):
                c = counted(m, np.array([o], float), np.array([len(o)]), np.array([w * part[i]]))
                c["weight"] = np.array([w * part[i]])
                total[i] = c if total[i] is None else {k: total[i][k] + c[k] for k in c}
        every = sum(t["weight"][0] for t in total)
        models = [replace(maximized(m, t), prior=t["weight"][0] / every) for m, t in zip(models, total)]
    return models


def like(m, obs):
    f = m.pi * m.b[:, obs[0]]
    for o in obs[1:]:
        f = (f @ m.a[0]) * m.b[:, o]
    return f.sum()


def test_all_at_once_equals_each_alone(spark, seqs):
    mixtures = selection.starts(START, [1, 2, 3], 2)
    assert sorted(mixtures) == [(k, r) for k in (1, 2, 3) for r in (0, 1)] and all(len(v) == k for (k, _), v in mixtures.items())
    fitted, rows = selection.select(seqs, mixtures, share=0.6, steps=3, gain=-1.0)
    inside = selection.trains(0.6)
    for (k, r), models in mixtures.items():
        some = [(x["weight"], x["obs"]) for x in seqs.where(inside(seqs["seq_id"], r)).collect() if x["obs"]]
        rest = [(x["weight"], x["obs"]) for x in seqs.where(~inside(seqs["seq_id"], r)).collect() if x["obs"]]
        want, got = alone(some, models, 3), fitted[k, r]
        for a, b in zip(want, got):
            assert np.allclose(a.a, b.a) and np.allclose(a.b, b.b) and np.allclose(a.pi, b.pi) and a.prior == pytest.approx(b.prior)
        row = next(x for x in rows if (x["k"], x["repeat"]) == (k, r))
        total = lambda part: sum(w * np.log(sum(m.prior * like(m, o) for m in want)) for w, o in part)
        assert row["train"] == pytest.approx(total(some)) and row["test"] == pytest.approx(total(rest)) and row["steps"] == 3
        assert row["n_train"] + row["n_test"] == pytest.approx(90.0)
        free = sum(m.free_parameters() for m in got) + k - 1
        assert row["bic"] == pytest.approx(-2 * row["train"] + free * np.log(row["n_train"]))


def test_likelihood_rises_and_two_kinds_want_two_models(seqs):
    mixtures = selection.starts(Model.of([1.0], [[1.0]], [[0.4, 0.3, 0.3]]), [1, 2], 2)
    before = selection.select(seqs, mixtures, steps=0)[1]
    _, after = selection.select(seqs, mixtures, steps=60)
    for b, a in zip(before, after):
        assert a["train"] > b["train"] and a["steps"] > 0
    best = {k: min(x["bic"] for x in after if x["k"] == k) for k in (1, 2)}
    assert best[2] < best[1]


def test_values_and_impossible(spark):
    m = Model.of([0.5, 0.5], [[0.8, 0.2], [0.3, 0.7]], c=[[1.0], [1.0]], mu=[[0.0], [4.0]], var=[[1.0], [1.0]])
    d = spark.createDataFrame([(i, RNG.normal([0, 4][i % 2], 1, 6).tolist()) for i in range(20)], "seq_id long, obs array<double>")
    _, rows = selection.select(d, selection.starts(m, [1, 2], 1), steps=5)
    assert all(np.isfinite(r["train"]) and np.isfinite(r["bic"]) for r in rows)
    only = Model.of([1.0], [[1.0]], [[1.0, 0.0]])
    d = spark.createDataFrame([(1, [0, 0]), (2, [0, 1])], "seq_id long, obs array<int>")
    _, rows = selection.select(d, {(1, 0): [only]}, share=1.0, steps=1)
    assert rows[0]["train"] == -500.0 and rows[0]["n_train"] == 2
