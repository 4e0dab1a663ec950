"""Pair models against plain tables, divided and undivided."""

import math

import numpy as np
import pytest

from braidseq.operators import hmm, pairs

RNG = np.random.default_rng(21)
STEPS = [(1, 1), (1, 0), (0, 1)]
A = [[0.8, 0.1, 0.1], [0.7, 0.3, 0.0], [0.7, 0.0, 0.3]]


def log(p):
    """In whole numbers, so that paths of equal probability are equal here too."""
    return round(math.log(p) * 2**30)


def match(m, p):
    return np.where(np.eye(m) > 0, p / m, (1 - p) / (m * (m - 1)))


PLAIN = pairs.PairModel.of([0.8, 0.1, 0.1], A, STEPS, [match(4, 0.8), np.full((4, 1), 0.25), np.full((1, 4), 0.25)])
WIDE = pairs.PairModel.of([0.5, 0.2, 0.2, 0.1], RNG.dirichlet(np.ones(4), (2, 4)), [(1, 1), (2, 0), (0, 1), (3, 2)], [match(4, 0.7), RNG.dirichlet(np.ones(4))[:, None], RNG.dirichlet(np.ones(4))[None], RNG.dirichlet(np.ones(16)).reshape(4, 4)], class_of=lambda s, c: ((c.u + 2 * c.v + s) % 3 == 0).astype(int))
TRACKED = pairs.PairModel.of([0.8, 0.1, 0.1], [A, [[0.2, 0.4, 0.4], [0.2, 0.6, 0.2], [0.2, 0.2, 0.6]]], STEPS, PLAIN.b, class_of=lambda s, c: ((c.x_track > 0.5) | (c.y_track > 0.8) | (c.x == 2)).astype(int))


def brute(m, x, y, tx=None, ty=None):
    """Path and log-likelihood by the plain recurrence, cell by cell."""
    best = {}
    for u in range(len(x) + 1):
        for v in range(len(y) + 1):
            for s, (dx, dy) in enumerate(m.steps):
                if u < dx or v < dy:
                    continue
                e = m.b[s][x[u - 1] if dx else 0, y[v - 1] if dy else 0]
                if e <= 0:
                    continue
                if (u, v) == (dx, dy):
                    ways = [(log(m.start[s]), -1)] if m.start[s] > 0 else []
                else:
                    at = lambda z, i: np.array([z[i - 1] if z is not None and i else np.nan])
                    cell = pairs.Cell(np.array([u - 1]), np.array([v - 1]), np.array([x[u - 1] if u else -1]), np.array([y[v - 1] if v else -1]), at(tx, u), at(ty, v))
                    ways = []
                    for r in range(m.n):
                        p = m.a[int(m.class_of(r, cell)[0]) if m.class_of else 0, r, s]
                        if (u - dx, v - dy, r) in best and p > 0:
                            ways.append((best[u - dx, v - dy, r][0] + log(p), r))
                if ways:
                    w = max(ways, key=lambda z: (z[0], -z[1]))
                    best[u, v, s] = (w[0] + log(e), w[1])
    ends = [(best[len(x), len(y), s][0], -s) for s in range(m.n) if (len(x), len(y), s) in best]
    if not ends:
        return None, None
    logp, s = max(ends)
    s, u, v, path = -s, len(x), len(y), []
    while u or v:
        path.append(s)
        r = best[u, v, s][1]
        u, v, s = u - m.steps[s][0], v - m.steps[s][1], r
    return path[::-1], logp / 2**30


def drawn(n):
    x = RNG.integers(0, 4, n)
    y = [int(c) if RNG.random() < 0.85 else int(RNG.integers(0, 4)) for c in x if RNG.random() < 0.9]
    return x.tolist(), y


@pytest.mark.parametrize("m", [PLAIN, WIDE, TRACKED], ids=["plain", "wide", "tracked"])
def test_against_the_plain_recurrence(spark, m):
    rows = [(k, *drawn(n)) for k, n in enumerate([1, 2, 5, 9, 30, 60])] + [(50, [], [1, 2]), (51, [1], []), (52, [0, 1, 2, 3] * 9, [3])]
    rows = [(k, x, y, RNG.random(len(x)).tolist(), RNG.random(len(y)).tolist()) for k, x, y in rows]
    d = spark.createDataFrame(rows, "seq_id long, x array<int>, y array<int>, x_track array<double>, y_track array<double>")
    want = {r[0]: brute(m, *r[1:]) for r in rows}
    for most in (1 << 20, 1):  # undivided, and divided as far as it goes
        got = pairs.align(d, m, most)
        for r in got.collect():
            path, logp = want[r["seq_id"]]
            assert r["path"] == path and (logp is None or r["logp"] == pytest.approx(logp, abs=1e-6))
        assert got.count() == len(rows)
    both = d.join(got.select("seq_id", "path"), "seq_id")
    for r in pairs.path_logp(both, m).collect():
        logp = want[r["seq_id"]][1]
        assert (r["logp"] is None) == (logp is None) and (logp is None or r["logp"] == pytest.approx(logp, abs=1e-6))


def test_a_long_pair_is_divided_into_many_rows(spark):
    x, y = drawn(1500)
    d = spark.createDataFrame([(1, x, y)], "seq_id long, x array<int>, y array<int>")
    one, many = pairs.align(d, PLAIN, 1 << 24).first(), pairs.align(d, PLAIN, 1 << 12).first()
    assert one["path"] == many["path"] and one["logp"] == pytest.approx(many["logp"], abs=1e-6)
    same = hmm.align(d, np.array(A), np.array([0.8, 0.1, 0.1]), STEPS, lambda s, p, q: PLAIN.b[0][p[0], q[0]] if s == 0 else 0.25).first()
    assert same["logp"] == pytest.approx(one["logp"], abs=1e-5)


def test_paths_that_do_not_fit(spark):
    d = spark.createDataFrame([(1, [0, 1], [0, 1], [0, 0]), (2, [0, 1], [0, 1], [0]), (3, [0], [0], [1, 2]), (4, [], [], []), (5, [0], [0], None)], "seq_id long, x array<int>, y array<int>, path array<int>")
    got = {r["seq_id"]: r["logp"] for r in pairs.path_logp(d, PLAIN).collect()}
    assert got[1] is not None and got[2] is None and got[3] is None and got[4] == 0.0 and got[5] is None
    assert pairs.align(d.limit(0), PLAIN).count() == 0
    with pytest.raises(ValueError):
        pairs.PairModel.of([1.0], [[1.0]], [(0, 0)], [[1.0]])


@pytest.mark.parametrize("most", [1 << 20, 200])
def test_short_pairs_go_side_by_side(spark, most):
    """Steps are as many as the longest pair has antidiagonals, not as all pairs have together."""
    calls = spark.sparkContext.accumulator(0)

    def class_of(state, cell):
        calls.add(1)
        return (cell.x == 1).astype(int)

    m = pairs.PairModel.of(TRACKED.start, TRACKED.a, STEPS, TRACKED.b, class_of=class_of)
    rows = [(k, *drawn(20)) for k in range(300)]
    d = spark.createDataFrame(rows, "seq_id long, x array<int>, y array<int>")
    got = {r["seq_id"]: (r["path"], r["logp"]) for r in pairs.align(d, m, most).collect()}
    asked, cells = calls.value, sum(len(x) + len(y) for _, x, y in rows)
    assert 0 < asked < cells
    for k, x, y in rows[::60]:
        path, logp = brute(m, x, y)
        assert got[k][0] == path and got[k][1] == pytest.approx(logp, abs=1e-6)
    calls.value = 0
    both = spark.createDataFrame([(*r, got[r[0]][0]) for r in rows], "seq_id long, x array<int>, y array<int>, path array<int>")
    assert {r["seq_id"]: r["logp"] for r in pairs.path_logp(both, m).collect()} == pytest.approx({k: z for k, (_, z) in got.items()}, abs=1e-6)
    assert 0 < calls.value < len(rows)


def test_pairs_of_a_path_are_built_once(spark):
    """pair_path_logp aligns and rescores the same settled pairs; the events are not read again for the second (F9)."""
    from braidseq.plans import catalogue

    d = catalogue.pair_path_logp(spark, "/root/testdata/sf0.001")
    assert "parquet" not in d._jdf.queryExecution().optimizedPlan().toString().lower()
    assert d.where("logp is null").count() == 0
