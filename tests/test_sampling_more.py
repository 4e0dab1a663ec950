"""Extensions, next symbols, k best labellings and cut normals."""

from dataclasses import replace
from itertools import product

import numpy as np
import pytest

from braidseq.operators import hmm, sampling, training, truncated
from braidseq.plans.models import Model

RNG = np.random.default_rng(12)
M = Model.of([0.6, 0.4, 0.0], [[0.7, 0.2, 0.1], [0.1, 0.6, 0.3], [0.3, 0.0, 0.7]], [[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.1, 0.2, 0.7]], labels=(0, 1, 1))


def test_extensions(spark):
    rows = [(i, [0, 0, 1][: 1 + i % 3]) for i in range(400)] + [(1000, []), (1001, [0] * 9)]
    d = spark.createDataFrame(rows, "seq_id long, obs array<int>")
    got = {r["seq_id"]: r for r in sampling.extended(d, M, 5).collect()}
    for i, o in rows[:400]:
        assert len(got[i]["obs"]) == 5 and got[i]["obs"][: len(o)] == o and got[i]["states"][len(o) - 1] is not None and got[i]["states"][: len(o) - 1] == [None] * (len(o) - 1)
    assert len(got[1000]["obs"]) == 5 and None not in got[1000]["states"] and got[1001]["obs"] == [0] * 9
    again = {r["seq_id"]: r["obs"] for r in sampling.extended(d.repartition(5), M, 5).collect()}
    assert again == {k: r["obs"] for k, r in got.items()}
    # The state at the end of [0, 0, 1] is drawn as the model has it.
    f = M.pi * M.b[:, 0]
    for o in (0, 1):
        f = (f @ M.a[0]) * M.b[:, o]
    share = np.bincount([got[i]["states"][2] for i in range(400) if i % 3 == 2], minlength=3) / sum(i % 3 == 2 for i in range(400))
    assert np.abs(share - f / f.sum()).max() < 0.12
    certain = Model.of([1.0], [[1.0]], [[1.0, 0.0]])
    assert sampling.extended(spark.createDataFrame([(1, [1])], "seq_id long, obs array<int>"), certain, 3).first()["obs"] is None


def test_next_symbols(spark):
    rows = [(1, [0]), (2, [0, 2, 1]), (3, [])]
    got = {(r["seq_id"], r["symbol"]): r["p"] for r in sampling.next_symbols(spark.createDataFrame(rows, "seq_id long, obs array<int>"), M).collect()}
    assert len(got) == 6
    for i, obs in rows[:2]:
        like = lambda o: sum(M.pi[p[0]] * np.prod([M.a[0, x, y] for x, y in zip(p, p[1:])]) * np.prod([M.b[s, q] for s, q in zip(p, o)]) for p in product(range(3), repeat=len(o)))
        for x in range(3):
            assert got[i, x] == pytest.approx(like([*obs, x]) / like(obs))


def one_by_one(m, obs, k, share):
    """The same search for one sequence, with plain dictionaries."""
    g = {(lab,): np.where(np.array(m.labels) == lab, m.pi * m.b[:, obs[0]], 0) for lab in sorted(set(m.labels))}

    def pruned(g):
        g = {h: v for h, v in g.items() if v.max() > 0}
        keep = set()
        for s in range(m.n):
            ranked = sorted((h for h in g if g[h][s] > 0), key=lambda h: (-g[h][s], h))
            keep |= {h for h in ranked[:k] if g[h][s] >= share * g[ranked[0]][s]}
        return {h: g[h] for h in sorted(keep)}

    g = pruned(g)
    for o in obs[1:]:
        g = pruned({(*h, lab): np.where(np.array(m.labels) == lab, (v @ m.a[0]) * m.b[:, o], 0) for h, v in g.items() for lab in sorted(set(m.labels))})
    if not g:
        return None, None
    h = min(g, key=lambda x: (-g[x].sum(), x))
    return list(h), float(np.log(g[h].sum()))


def test_kbest(spark):
    rows = [(i, RNG.integers(0, 3, n).tolist()) for i, n in enumerate([1, 2, 9, 9, 30, 0, 30])]
    d = spark.createDataFrame(rows, "seq_id long, obs array<int>")
    for k, share in ((1, 0.03), (3, 0.03), (2, 0.5), (60, 1e-300)):
        got = {r["seq_id"]: r for r in hmm.kbest(d, M, k, np.log(share)).collect()}
        for i, o in rows[: 6 if k < 60 else 4]:
            labels, logp = one_by_one(M, o, k, share) if o else ([], 0.0)
            assert got[i]["labels"] == labels and got[i]["logp"] == pytest.approx(logp)
    certain = replace(M, b=np.array([[1.0, 0, 0]] * 3))
    assert hmm.kbest(spark.createDataFrame([(1, [0, 1])], "seq_id long, obs array<int>"), certain).first()["labels"] is None


def test_roots():
    c = np.array([2.0, 3.0, 0.5, -1.0])
    x = truncated.roots(lambda v: v**3 - c, np.full(4, -5.0), np.full(4, 5.0))
    assert np.allclose(x, np.cbrt(c), atol=1e-10)
    assert np.isnan(truncated.roots(lambda v: v * v + 1, np.zeros(1) - 1, np.ones(1)))[0]


def test_cut_normals_are_found_again():
    cut = -0.1
    z = np.linspace(-3, 40, 50)
    assert np.allclose(truncated.hazard(z[z < 5]), np.exp(-z[z < 5] ** 2 / 2) / np.sqrt(2 * np.pi) / (0.5 * truncated._erfc(z[z < 5] / np.sqrt(2))))
    assert abs(truncated.hazard(25.0001) - truncated.hazard(24.9999)) < 1e-3
    mu, var = np.array([2.0, 0.0, -1.0, 5.0]), np.array([1.0, 4.0, 2.0, 0.01])
    s = np.sqrt(var)
    alpha = (cut - mu) / s
    h = truncated.hazard(alpha)
    mean = mu + s * h
    square = mu**2 + var + s * h * (mu + cut)
    got = truncated.fitted(mean, square, cut, 1e-4)
    assert np.allclose(got[0], mu, atol=1e-6) and np.allclose(got[1], var, atol=1e-6)
    wide = truncated.fitted(np.array([0.9]), np.array([0.81 + 1.1]), cut, 1e-4)  # as wide as an exponential density, or wider
    assert np.isfinite(wide).all()
    assert truncated.fitted(np.array([3.0]), np.array([9.0]), cut, 1e-4) == (3.0, 1e-4)


def test_training_with_a_cut_never_loses(spark):
    m = Model.of([0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]], c=[[1.0], [1.0]], mu=[[0.3], [4.0]], var=[[1.0], [1.0]], cut=-0.1)
    d = sampling.generate(spark.range(40).withColumnRenamed("id", "seq_id"), m, 40)
    seen = []
    start = replace(m, mu=np.array([[1.0], [3.0]]), var=np.array([[2.0], [2.0]]))
    fit, _ = training.baum_welch(d, start, steps=25, gain=0.0, watch=seen.append)
    assert all(b >= a - 1e-7 * abs(a) for a, b in zip(seen, seen[1:])) and len(seen) > 5
    assert abs(fit.mu[0, 0] - 0.3) < 0.35 and abs(fit.var[0, 0] - 1.0) < 0.4 and abs(fit.mu[1, 0] - 4.0) < 0.2
