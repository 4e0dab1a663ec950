"""Queries and operators on whole sequences, against plain loops."""

import os
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from braidseq.operators import hmm
from braidseq.plans import catalogue

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def users():
    """Per user the symbols and the values in order."""
    rows = sorted(pq.read_table(f"{SF}/events.parquet", columns=["user_id", "ts", "event_id", "event_type", "value"]).to_pylist(), key=lambda r: (r["ts"], r["event_id"]))
    out = defaultdict(lambda: ([], []))
    for r in rows:
        out[r["user_id"]][0].append(catalogue.TYPES.index(r["event_type"]))
        out[r["user_id"]][1].append(r["value"])
    return out


@given
def test_posteriors_of_whole_sequences(spark, users):
    got = {(r["seq_id"], r["pos"], r["state"]): r["p"] for r in catalogue.QUERIES["posterior_states_whole"](spark, SF).collect()}
    m = catalogue.CALM
    for user, (obs, _) in users.items():
        up, down = [m.pi * m.b[:, obs[0]]], [np.ones(2)]
        for o in obs[1:]:
            up.append(up[-1] @ m.a[0] * m.b[:, o])
        for o in obs[:0:-1]:
            down.append(m.a[0] @ (m.b[:, o] * down[-1]))
        p = np.array(up) * np.array(down[::-1])
        p /= p.sum(axis=1, keepdims=True)
        assert np.allclose([[got.pop((user, t, s)) for s in range(2)] for t in range(len(obs))], p, atol=1e-6)
    assert not got


@given
def test_means_and_scatter_of_all_positions(spark, users):
    values = [v for _, v in users.values()]
    longest = max(map(len, values))
    at = [[v[t] for v in values if len(v) > t] for t in range(longest)]
    got = {r["pos"]: r for r in catalogue.QUERIES["mean_sequence_whole"](spark, SF).collect()}
    assert sorted(got) == list(range(longest))
    assert all(got[t]["n"] == len(x) and got[t]["mean"] == pytest.approx(sum(x) / len(values), abs=2e-6) for t, x in enumerate(at))
    got = {(r["i"], r["j"]): r for r in catalogue.QUERIES["scatter_matrix_whole"](spark, SF).collect()}
    assert len(got) == longest**2
    mean = [sum(x) / len(x) for x in at]
    for (i, j), r in got.items():
        both = [(v[i] - mean[i]) * (v[j] - mean[j]) for v in values if len(v) > max(i, j)]
        assert r["n"] == len(both) and r["s"] == pytest.approx(sum(both), abs=2e-4)


def test_scatter_over_tiles_and_nulls(spark):
    from braidseq.operators import sequences

    rng = np.random.default_rng(0)
    x = [list(map(float, rng.random(n))) for n in (600, 300, 300, 1)]
    x[1][5] = None
    d = sequences.scatter(spark.createDataFrame([(i, 1.0, v) for i, v in enumerate(x)], "seq_id long, weight double, obs array<double>"))
    got = {(r["i"], r["j"]): (r["s"], r["n"]) for r in d.collect()}
    assert len(got) == 600**2 and got[5, 290][1] == 3
    mean = [np.mean([v[t] for v in x if len(v) > t and v[t] is not None]) for t in range(600)]
    for i, j in ((5, 5), (5, 290), (290, 5), (255, 256), (599, 0), (0, 0)):
        want = sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in x if len(v) > max(i, j) and v[i] is not None and v[j] is not None)
        assert got[i, j][0] == pytest.approx(want, abs=1e-9)


def brute(x, y, a, start, steps, emit):
    """Best log-likelihood by the plain recursion."""
    d = np.full((len(x) + 1, len(y) + 1, len(steps)), -np.inf)
    with np.errstate(divide="ignore"):
        for u in range(len(x) + 1):
            for v in range(len(y) + 1):
                for s, (i, j) in enumerate(steps):
                    if u >= i and v >= j and (u, v) != (0, 0):
                        before = np.log(start[s]) if (u, v) == (i, j) else (d[u - i, v - j] + np.log(a[:, s])).max()
                        d[u, v, s] = before + np.log(emit(s, x[u - i : u], y[v - j : v]))
    return d[-1, -1].max()


def test_alignments_by_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.integers(0, 3, n).tolist(), rng.integers(0, 3, m).tolist()) for k, (n, m) in enumerate([(30, 25), (1, 7), (0, 3), (5, 0), (0, 0), (12, 12)])]
    a, start = np.array([[0.8, 0.1, 0.1], [0.7, 0.3, 0.0], [0.7, 0.0, 0.3]]), np.array([0.8, 0.1, 0.1])
    for steps in ([(1, 1), (1, 0), (0, 1)], [(2, 1), (1, 0), (0, 1)]):
        got = hmm.align(spark.createDataFrame(rows, "seq_id long, x array<int>, y array<int>"), a, start, steps, lambda s, x, y: (0.16 if x[0] == y[0] else 0.01) if s == 0 else 0.2)
        for r in got.collect():
            _, x, y = rows[r["seq_id"]]
            want = brute(x, y, a, start, steps, lambda s, x, y: (0.16 if x[0] == y[0] else 0.01) if s == 0 else 0.2)
            if not np.isfinite(want):
                assert r["path"] is None
                continue
            assert r["logp"] == pytest.approx(want)
            assert [sum(steps[s][k] for s in r["path"]) for k in (0, 1)] == [len(x), len(y)]


def test_short_alignments_go_side_by_side(spark):
    """Emissions are asked for once in a task, not once for each alignment; the results are those of the plain recurrence."""
    rng = np.random.default_rng(5)
    asked = spark.sparkContext.accumulator(0)

    def emit(s, x, y):
        asked.add(1)
        return (0.16 if x[0] == y[0] else 0.01) if s == 0 else 0.2

    rows = [(k, rng.integers(0, 3, n).tolist(), rng.integers(0, 3, m).tolist()) for k, (n, m) in enumerate(rng.integers(0, 12, (400, 2)).tolist())]
    a, start = np.array([[0.8, 0.1, 0.1], [0.7, 0.3, 0.0], [0.7, 0.0, 0.3]]), np.array([0.8, 0.1, 0.1])
    for steps in ([(1, 1), (1, 0), (0, 1)], [(2, 1), (1, 0), (0, 1)], [(3, 3), (2, 0), (0, 2)]):
        asked.value = 0
        got = hmm.align(spark.createDataFrame(rows, "seq_id long, x array<int>, y array<int>"), a, start, steps, emit).collect()
        assert len(got) == len(rows) and 0 < asked.value < 4 * (27 * 27 + 9 + 9) and (steps[0] != (1, 1) or asked.value < 4 * 16)
        for r in got[::10]:
            _, x, y = rows[r["seq_id"]]
            want = brute(x, y, a, start, steps, lambda s, x, y: (0.16 if x[0] == y[0] else 0.01) if s == 0 else 0.2)
            assert (r["logp"] is None) == (not np.isfinite(want)) and (r["logp"] is None or r["logp"] == pytest.approx(want))
            if r["path"] is not None:
                assert [sum(steps[s][k] for s in r["path"]) for k in (0, 1)] == [len(x), len(y)]


@given
def test_alignments_of_whole_sequences(spark, users):
    got = {r["seq_id"]: r["len"] for r in catalogue.QUERIES["pair_alignments"](spark, SF).collect()}
    assert set(got) == {u for u in users if u + 1 in users}
    assert all(n >= max(len(users[u][0]), len(users[u + 1][0])) for u, n in got.items())


def by_hand(stays):
    """(pairs with scores, each other's best) among the intervals of one contig."""
    pairs = {(f, g): (min(b, d) - max(a, c) + 1) / (max(b, d) - min(a, c) + 1) for f, a, b in stays for g, c, d in stays if f != g and a <= d and c <= b}
    best = {f: min((-s, h) for (g, h), s in pairs.items() if g == f)[1] for f, _ in pairs}
    return {k: s for k, s in pairs.items() if k[0] < k[1]}, {(f, g) for f, g in best.items() if f < g and best[g] == f}


@given
def test_overlaps_of_all_orders(spark):
    contigs = defaultdict(list)
    for r in catalogue._one_set(spark, SF).collect():
        contigs[r["contig_id"]].append((r["feature_id"], r["lo"], r["hi"]))
    pairs, best, alone = {}, set(), {}
    for c, x in contigs.items():
        own, match = by_hand(x)
        pairs |= {(c, *k): s for k, s in own.items()}
        best |= {(c, *k) for k in match}
        alone[c] = len(x) - 2 * len(match)
    got = {(r["contig_id"], r["feature_id"], r["r_feature_id"]): r["score"] for r in catalogue.QUERIES["overlap_pairs_whole"](spark, SF).collect()}
    assert got.keys() == pairs.keys() and all(s == pytest.approx(pairs[k], abs=1e-8) for k, s in got.items())
    assert any((f - g) % 2 == 0 for _, f, g in got)
    assert {tuple(r)[:3] for r in catalogue.QUERIES["overlap_match_whole"](spark, SF).collect()} == best
    assert {r["contig_id"]: r["n"] for r in catalogue.QUERIES["unmatched_whole"](spark, SF).collect()} == {c: n for c, n in alone.items() if n}
