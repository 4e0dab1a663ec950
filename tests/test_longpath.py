"""Decoding by a scan over parts against the plain one."""

import numpy as np
import pytest

from braidseq.operators import genefinder, hmm, longpath
from braidseq.plans import catalogue
from braidseq.plans.models import Model

RNG = np.random.default_rng(5)


def random_model(n, m, sparse=0.4, gauss=False):
    a = RNG.random((n, n)) * (RNG.random((n, n)) > sparse) + np.eye(n, k=1) * 0.5 + np.eye(n) * 0.05
    a /= a.sum(axis=1, keepdims=True)
    pi = RNG.dirichlet(np.ones(n))
    if gauss:
        return Model.of(pi, a, c=np.ones((n, 1)), mu=RNG.normal(0, 3, (n, 1)), var=RNG.random((n, 1)) * 4 + 1)
    b = RNG.random((n, m)) * (RNG.random((n, m)) > 0.2) + 1e-3
    return Model.of(pi, a, b / b.sum(axis=1, keepdims=True))


@pytest.mark.parametrize("n,size,gauss", [(2, 7, False), (5, 16, False), (9, 3, False), (3, 5, True)])
def test_equals_the_plain_path(spark, n, size, gauss):
    m = random_model(n, 4, gauss=gauss)
    lengths = [1, size - 1, size, size + 1, 40 * size + 2, 0, 9 * size * 4]
    seqs = [(k, (RNG.normal(0, 3, x) if gauss else RNG.integers(0, 5, x)).astype(float).tolist()) for k, x in enumerate(lengths)]  # 4 is a missing symbol
    d = spark.createDataFrame(seqs, "seq_id long, obs array<double>")
    if not gauss:
        d = d.selectExpr("seq_id", "transform(obs, x -> int(x)) as obs")
    want = {r["seq_id"]: (r["path"], r["logp"]) for r in hmm.decode(d, m).collect()}
    got = {}
    for r in sorted(longpath.decode_parts(longpath.cut(d, size), m, fan=3).collect(), key=lambda r: (r["seq_id"], r["part"])):
        path, logp = got.get(r["seq_id"], ([], 0.0))
        got[r["seq_id"]] = (path + r["path"], logp + r["logp"])
    assert set(got) == {k for k, x in enumerate(lengths) if x}
    for k in got:
        assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-6)


def test_impossible_and_empty(spark):
    m = Model.of([1, 0], [[0, 1], [1, 0]], [[1, 0], [0, 1]])
    d = spark.createDataFrame([(1, [0, 1] * 20), (2, [0, 1] * 9 + [1] + [0, 1] * 9), (3, [])], "seq_id long, obs array<int>")
    got = longpath.decode_parts(longpath.cut(d, 4), m, fan=2).collect()
    assert sorted({r["seq_id"] for r in got}) == [1, 2]
    assert all(r["path"] == [0, 1, 0, 1] for r in got if r["seq_id"] == 1) and all(r["path"] is None and r["logp"] is None for r in got if r["seq_id"] == 2)
    assert longpath.decode_parts(longpath.cut(d.limit(0)), m).count() == 0
    with pytest.raises(ValueError):
        longpath.Steps(Model.of([1.0], [[[1.0]], [[1.0]]], [[1.0]]))


def test_silent_states_with_several_ways_are_taken_out(spark):
    """A hub is kept only where it is the one way between two states."""
    a = [[0.0, 0.5, 0.5, 0.0], [0.2, 0.2, 0.0, 0.6], [0.0, 0.0, 0.3, 0.7], [0.5, 0.3, 0.2, 0.0]]
    b = [[0.7, 0.3], [0.2, 0.8], [0.5, 0.5], [0.0, 0.0]]
    twice = Model.of([1, 0, 0, 0], a, b)
    once = Model.of([1, 0, 0, 0], [[0.0, 0.5, 0.5, 0.0], [0.0, 0.4, 0.0, 0.6], [0.0, 0.0, 0.3, 0.7], [1.0, 0.0, 0.0, 0.0]], b)
    assert not longpath.Steps(twice).hubs and len(longpath.Steps(once).hubs) == 1
    obs = RNG.integers(0, 2, 61).tolist()
    d = spark.createDataFrame([(1, obs)], "seq_id long, obs array<int>")
    for m in (once, twice):
        got = sorted(longpath.decode_parts(longpath.cut(d, 5), m, fan=2).collect(), key=lambda r: r["part"])
        # Rounds of the same moves in another order are as likely, so the paths' own likelihoods are held against each other.
        path, plain = [s for r in got for s in r["path"]], m.without_silent()
        own = np.log(plain.pi[path[0]]) + sum(np.log(plain.a[0, x, y]) for x, y in zip(path, path[1:])) + sum(np.log(plain.b[s, o]) for s, o in zip(path, obs))
        assert own == pytest.approx(hmm.decode(d, m).first()["logp"], abs=1e-9) and sum(r["logp"] for r in got) == pytest.approx(own, abs=1e-6)


def test_ties_go_to_the_lowest_state(spark):
    m = Model.of([0.5, 0.5], [[0.5, 0.5], [0.5, 0.5]], [[0.5, 0.5], [0.5, 0.5]])
    d = spark.createDataFrame([(1, [0, 1] * 30)], "seq_id long, obs array<int>")
    assert {s for r in longpath.decode_parts(longpath.cut(d, 8), m, fan=2).collect() for s in r["path"]} == {0}


def test_one_contig(spark):
    rows = [(i, [i] * (i % 5)) for i in range(50)]
    d = spark.createDataFrame(rows, "k long, obs array<int>").repartition(7)
    for back in (False, True):
        want = [x for _, o in sorted(rows, reverse=back) for x in o]
        got = sorted(longpath.one_contig(d, ["k"], size=3, backwards=back).collect(), key=lambda r: r["part"])
        assert [r["part"] for r in got] == list(range(len(got))) and max(len(r["obs"]) for r in got) == 3
        flat = [x for r in got for x in r["obs"]]
        assert flat == want and all(r["offset"] == sum(len(q["obs"]) for q in got[: r["part"]]) for r in got)
        again = sorted(longpath.gathered(longpath.one_contig(d, ["k"], size=3, backwards=back), 8).collect(), key=lambda r: r["part"])
        assert [x for r in again for x in r["obs"]] == want and {len(r["obs"]) for r in again[:-1]} == {8}


def test_genes_of_a_contig_in_parts(spark):
    """Both strands of contigs cut into short parts, against plain decoding and plain runs."""
    m = catalogue.gene_model({"AAA": 500, "CCG": 300, "GAT": 200, "ATG": 50, "TAA": 50}, gap=40.0)
    plain = m.without_silent()
    assert len(longpath.Steps(m).hubs) == 3 and not longpath.Steps(plain).hubs and len(longpath.Steps(m).src) < 0.2 * len(longpath.Steps(plain).src)
    bases = "".join(RNG.choice(list("ACGTN"), 3000, p=[0.3, 0.2, 0.2, 0.29, 0.01]))
    gene = "ATG" + "AAACCGGAT" * 25 + "TAA"
    rc = gene[::-1].translate(str.maketrans("ACGT", "TGCA"))
    contigs = [("x", bases[:700] + gene + bases[700:1500] + rc + bases[1500:]), ("y", gene), ("z", "")]
    want = set()
    for name, seq in contigs:
        for reverse in (False, True):
            s = seq[::-1].translate(str.maketrans("ACGT", "TGCA")) if reverse else seq
            if not s:
                continue
            obs = np.array([["ACGT".find(c) if c in "ACGT" else 4 for c in s]], float)
            (path,), _ = hmm.viterbi(plain, hmm.emissions(plain, obs), np.array([len(s)]))
            kind = [plain.names[k].startswith("intergenic") for k in path] + [True]
            at = None
            for i, gap in enumerate(kind):
                if not gap and at is None:
                    at = i
                if gap and at is not None:
                    want.add((name, len(s) - at, len(s) - i + 1) if reverse else (name, at + 1, i))
                    at = None
    d = spark.createDataFrame(contigs, "contig_id string, seq string")
    got = {tuple(r) for r in genefinder.find(d, m, size=97).collect()}
    assert got == want and len(got) >= 3


def test_memory_of_many_short_parts(spark):
    """Batches of parts are bounded by the scores that they move, and a first part moves one row of scores (F1, F2)."""
    m = catalogue.gene_model({"AAA": 500, "CCG": 300})
    steps = longpath.Steps(m)
    obs = [list(RNG.integers(0, 4, 60)) for _ in range(200)]
    assert max(len(rows) for rows, _, _ in longpath._batches(obs, longpath.CELLS, steps.n + 8, 30)) == 30
    seen, moved = [], longpath.Steps.moved
    steps.moved = lambda x: seen.append(len(x)) or moved(steps, x)
    got = longpath._transfers(steps, np.array(obs[:20], float), np.full(20, 60), np.ones(20, bool))
    assert max(seen) == 20 and all(len(t.kinds) == 1 for t in got)


def test_tails_are_packed_and_ends_stay_silent(spark):
    m = genefinder.genic({"AAA": 5, "CCG": 3, "GAT": 1}, {"ATG": 1}, {"TAA": 1})
    steps = longpath.Steps(m)
    assert len(steps.hubs) == 1 and len(steps.src) < m.n
    obs = np.array([["ACGT".index(c) for c in "ATG" + "AAACCGGATAAA" * 3 + "TAA"]], float)
    plain = m.without_silent()
    (want,), logp = hmm.viterbi(plain, hmm.emissions(plain, obs), np.array([obs.shape[1]]))
    d = spark.createDataFrame([(1, obs[0].astype(int).tolist())], "seq_id long, obs array<int>")
    for size in (5, 1000):
        got = sorted(longpath.decode_parts(longpath.cut(d, size), m, fan=2).collect(), key=lambda r: r["part"])
        assert [s for r in got for s in r["path"]] == want and abs(sum(r["logp"] for r in got) - logp[0]) < 1e-9


def test_runs_over_many_parts(spark):
    """Only runs at the ends of parts meet; one may span several parts."""
    kinds = RNG.integers(0, 2, 300)
    kinds[50:90] = 1
    rows = [(0, p, p * 7, kinds[p * 7 : p * 7 + 7].tolist()) for p in range(43)]
    d = spark.createDataFrame(rows, "seq_id long, part long, offset long, path array<int>")
    at = np.concatenate([[0], np.flatnonzero(np.diff(kinds)) + 1, [300]])
    want = {(0, int(kinds[a]), int(a), int(b) - 1) for a, b in zip(at, at[1:])}
    assert {(r["seq_id"], r["kind"], r["first"], r["last"]) for r in longpath.runs(d, [0, 1]).collect()} == want
