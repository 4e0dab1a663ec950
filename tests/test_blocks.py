"""Passes over blocks of symbols, and clustering of one pass a step (F2, F4)."""

import numpy as np
import pytest

from braidseq.operators import blocks, hmm, training
from braidseq.plans.models import Model

RNG = np.random.default_rng(9)


def model(n, symbols, **kw):
    return Model.of(RNG.dirichlet(np.ones(n)), RNG.dirichlet(np.ones(n), n), RNG.dirichlet(np.ones(symbols), n), **kw)


@pytest.mark.parametrize("n,symbols", [(2, 5), (3, 3), (1, 2), (4, 4)])
def test_counts_equal_those_of_single_symbols(n, symbols):
    m, w = model(n, symbols), RNG.random(200)
    lengths, obs = np.sort(RNG.integers(0, 30, 200)), RNG.integers(0, symbols + 1, (200, 30)).astype(float)
    kinds, codes = blocks.Kinds(m), blocks.codes(obs, lengths, symbols)
    kinds.add(codes[:, :90], lengths[:90], w[:90])
    kinds.add(codes[:, 90:], lengths[90:], w[90:])
    want, got = training.counted(m, obs, lengths, w), kinds.counts()
    assert want.keys() == got.keys() and all(np.allclose(want[k], got[k], rtol=1e-11, atol=1e-12) for k in want)
    assert np.allclose(kinds.loglik(codes, lengths), hmm.forward(m, hmm.emissions(m, obs), lengths)[2], rtol=1e-12)
    assert not kinds.fresh().sums.any()


def test_impossible_and_hardly_possible_sequences():
    m = Model.of([1.0, 0.0], [[0.0, 1.0], [0.0, 0.0]], [[1.0, 0.0, 0.0], [0.0, 1e-200, 1.0]])  # the second state has no way on
    hard = Model.of([1.0], [[1.0]], [[1e-200, 1e-190, 1.0]])
    obs, lengths = np.array([[0.0] * 9, [0, 2] + [0] * 7, [0, 1] + [0] * 7, [0, 2, 2] + [0] * 6, [0, 1, 0, 1, 1, 0, 1, 0, 0]]), np.array([1, 2, 2, 3, 9])
    for some in (m, hard):
        kinds, codes = blocks.Kinds(some), blocks.codes(obs, lengths, 3)
        kinds.add(codes, lengths, np.ones(5))
        want, got = training.counted(some, obs, lengths, np.ones(5)), kinds.counts()
        assert all(np.allclose(want[k], got[k]) for k in want) and got["logp"][1] == (2 if some is m else 0)
    with pytest.raises(ValueError):
        blocks.codes(np.array([[4.0]]), np.array([1]), 3)


def test_models_that_blocks_do_not_fit():
    m = model(2, 3)
    assert blocks.fits([m, model(4, 3)]) and not blocks.fits([m, model(2, 4)]) and not blocks.fits([model(5, 3)]) and not blocks.fits([model(2, 60)])
    assert not blocks.fits([Model.of([1.0, 0.0], [[0.5, 0.5], [1.0, 0.0]], [[0.5, 0.5], [0.0, 0.0]])])
    assert not blocks.fits([Model.of([1.0], [[1.0]], c=[[1.0]], mu=[[0.0]], var=[[1.0]])])


@pytest.fixture(scope="module")
def seqs(spark):
    rows = [(i, RNG.choice(4, RNG.integers(0, 25), p=RNG.dirichlet(np.ones(4) * 3)).tolist()) for i in range(150)]
    return spark.createDataFrame(rows, "seq_id long, obs array<int>").persist()


STARTS = [model(2, 4, prior=0.4), model(2, 4, prior=0.4), model(2, 4, prior=0.2)]


def test_clusters_by_blocks_equal_those_by_symbols(seqs, monkeypatch):
    """And those of rounds that label, train and test one after the other."""
    one, labels = training.cluster(seqs, STARTS)
    got = {r["seq_id"]: r["model_id"] for r in labels.collect()}
    monkeypatch.setattr(blocks, "fits", lambda models: False)
    two, others = training.cluster(seqs, STARTS)
    assert got == {r["seq_id"]: r["model_id"] for r in others.collect()}
    plain, steps, before = STARTS, 20, None
    while True:
        label = {r["seq_id"]: r["model_id"] for r in hmm.classify(seqs, dict(enumerate(plain))).collect()}
        if label == before:
            if steps == training.STEPS:
                break
            steps = training.STEPS
        before = label
        own = seqs.sparkSession.createDataFrame(list(label.items()), "seq_id long, model_id int")
        plain = training.trained_apart(seqs.join(own, "seq_id"), plain, steps)
    assert got == label and all(np.allclose(x.a, z.a) and np.allclose(x.b, z.b) and np.allclose(x.pi, z.pi) and np.allclose(y.b, z.b) for x, y, z in zip(one, two, plain))


def test_a_round_is_a_pass_and_rounds_are_not_limited(spark, seqs, monkeypatch):
    """A round was a pass for its labels and two of training at least, and after STEPS rounds an error came in place of the labels."""
    passes, looked = [], training._looked
    monkeypatch.setattr(training, "_looked", lambda *a: passes.append(looked(*a)) or passes[-1])
    monkeypatch.setattr(training, "STEPS", 2)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("clusters", "clusters")
    try:
        models, labels = training.cluster(seqs, STARTS)
        jobs = len(tracker.getJobIdsForGroup("clusters"))
    finally:
        spark.sparkContext.setJobGroup("", "")
    changed = sum(1 for p in passes[1:] if p["other"])
    # A dozen at most to pack the sequences.
    assert changed > 2 and jobs <= len(passes) + 12
    again = training._looked(hmm.packed(seqs), models, models, {})
    assert again["other"] == 0 and sum(again["sizes"].values()) == labels.where("model_id is not null").count() == 150
