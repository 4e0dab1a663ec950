"""Switching models with silent states against a plain recursion, and against the plain decoder."""

import numpy as np
import pytest

from braidseq.operators import hmm, switching
from braidseq.plans.models import Model

RNG = np.random.default_rng(17)


def profile(n, classes=2):
    """States that speak and silent ones; silent moves only forward."""
    silent = RNG.random(n) < 0.4
    silent[0] = False
    a = RNG.random((classes, n, n)) * (RNG.random((classes, n, n)) > 0.2) + 0.01
    for i in np.flatnonzero(silent):
        a[:, i, np.flatnonzero(silent & (np.arange(n) <= i))] = 0
    a /= a.sum(axis=2, keepdims=True)
    b = RNG.dirichlet(np.ones(3), n) * ~silent[:, None]
    return Model.of(RNG.dirichlet(np.ones(n)), a, b)


def plain(m, obs, counted, class_of):
    """Best path to each state, step by step, as a dictionary of (score, path, count)."""
    log = lambda p: np.log(p) if p > 0 else -np.inf
    order = switching._silent_order(m)

    def best(ways):
        return max(ways, key=lambda w: w[0]) if ways else (-np.inf, None, 0)  # the first of equals

    def silent(at, t, begin):
        for s in order:
            ways = [(log(m.pi[s]), [s], counted[s])] if begin else []
            ways += [(at[r][0] + log(m.a[class_of(at[r][2], t), r, s]), at[r][1] + [s], at[r][2] + counted[s]) for r in range(m.n) if r in at and at[r][0] > -np.inf]
            at[s] = best([w for w in ways if w[0] > -np.inf])
        return at

    at = silent({}, 0, True)
    for t, o in enumerate(obs):
        new = {}
        for s in np.flatnonzero(~m.silent).tolist():
            ways = [(log(m.pi[s]), [s], counted[s])] if t == 0 else []
            ways += [(at[r][0] + log(m.a[class_of(at[r][2], t), r, s]), at[r][1] + [s], at[r][2] + counted[s]) for r in range(m.n) if r in at and at[r][0] > -np.inf]
            w = best(ways)
            new[s] = (w[0] + log(m.b[s, o]), w[1], w[2])
        at = silent(new, t + 1, False)
    return max((at[s] for s in range(m.n)), key=lambda w: w[0])


def _rule(count, t):
    return ((count + t) // 2) % 2


@pytest.mark.parametrize("n", [3, 5, 8])
def test_against_a_plain_recursion(spark, n):
    m, counted = profile(n), [int(x) for x in RNG.random(n) < 0.5]
    rows = [(k, RNG.integers(0, 3, x).tolist()) for k, x in enumerate([1, 2, 7, 7, 20, 0])]
    d = spark.createDataFrame(rows, "seq_id long, obs array<int>")
    got = {r["seq_id"]: r for r in switching.decode(d, m, counted, _rule).collect()}
    for k, obs in rows:
        if not obs:
            assert got[k]["path"] == [] and got[k]["logp"] == 0 and got[k]["count"] == 0
            continue
        logp, path, count = plain(m, obs, counted, _rule)
        assert got[k]["logp"] == pytest.approx(logp) and got[k]["path"] == path and got[k]["count"] == count


def test_one_class_is_the_plain_decoder(spark):
    m = Model.of([0.6, 0.4], [[0.7, 0.3], [0.2, 0.8]], RNG.dirichlet(np.ones(3), 2))
    d = spark.createDataFrame([(k, RNG.integers(0, 3, 15).tolist()) for k in range(5)], "seq_id long, obs array<int>")
    a = {r["seq_id"]: (r["path"], r["logp"]) for r in hmm.decode(d, m).collect()}
    b = {r["seq_id"]: (r["path"], r["logp"]) for r in switching.decode(d, m, [0, 1], lambda c, t: np.zeros_like(c)).collect()}
    assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()} and all(a[k][1] == pytest.approx(b[k][1]) for k in a)


def test_classes_and_errors(spark):
    parts = [Model.of([1, 0], [[p, 1 - p], [0.5, 0.5]], np.eye(2)) for p in (0.1, 0.9)]
    m = switching.in_classes(parts)
    assert m.a.shape == (2, 2, 2) and np.array_equal(switching.of_class(m, 1).a, parts[1].a)
    d = spark.createDataFrame([(1, [0, 0, 1]), (2, [1])], "seq_id long, obs array<int>")
    got = {r["seq_id"]: r for r in switching.decode(d, m, [1, 0], lambda c, t: (c > 1).astype(int)).collect()}
    assert got[1]["path"] == [0, 0, 1] and got[1]["logp"] == pytest.approx(np.log(0.1 * 0.1)) and got[1]["count"] == 2
    assert got[2]["path"] is None and got[2]["logp"] is None
    with pytest.raises(ValueError):
        switching.in_classes([parts[0], Model.of([0, 1], [[1, 0], [0, 1]], np.eye(2))])
    with pytest.raises(ValueError):
        switching._silent_order(Model.of([1, 0], [[0, 1], [1, 0]], [[0.0], [0.0]]))
