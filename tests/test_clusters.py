"""Clusters trained in one pass, random starts, and empty clusters that are seeded again."""

import numpy as np
import pytest

from braidseq.operators import training
from braidseq.plans.models import Model

RNG = np.random.default_rng(4)
A = Model.of([0.5, 0.5], [[0.6, 0.4], [0.4, 0.6]], [[0.6, 0.2, 0.2], [0.2, 0.6, 0.2]])
B = Model.of([0.5, 0.5], [[0.5, 0.5], [0.3, 0.7]], [[0.2, 0.2, 0.6], [0.3, 0.3, 0.4]])


@pytest.fixture(scope="module")
def seqs(spark):
    kinds = [[0.7, 0.2, 0.1], [0.1, 0.2, 0.7]]
    rows = [(i, [1.0, 2.0][i % 2], RNG.choice(3, 5 + i % 7, p=kinds[i % 2]).tolist()) for i in range(40)]
    return spark.createDataFrame(rows, "seq_id long, weight double, obs array<int>")


def test_apart_equals_each_alone(seqs):
    d = seqs.selectExpr("*", "cast(seq_id % 2 as int) as model_id")
    got = training.trained_apart(d, [A, B, A], steps=15)
    for k, m in enumerate((A, B)):
        want, _ = training.baum_welch(d.where(f"model_id = {k}"), m, steps=15)
        assert np.allclose(got[k].a, want.a) and np.allclose(got[k].b, want.b) and np.allclose(got[k].pi, want.pi)
    assert got[2] is A


def test_random_starts_differ_and_agree_with_themselves(seqs):
    one, two = training.random_starts(seqs, A, 3), training.random_starts(seqs.repartition(5), A, 3)
    assert len(one) == 3 and not np.allclose(one[0].b, one[1].b)
    for x, y in zip(one, two):
        assert np.allclose(x.a, y.a) and np.allclose(x.b, y.b)


def test_an_empty_cluster_gets_the_worst_sequence(seqs):
    hopeless = Model.of([1.0, 0.0], [[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0, 0.0], [1.0, 0.0, 0.0]], prior=1e-9)
    labels = training.cluster(seqs, [A, hopeless], rounds=0)[1]
    assert {r["model_id"] for r in labels.collect()} == {0}
    again = {r["seq_id"]: r["model_id"] for r in training._reseeded(seqs, labels, 2).collect()}
    fits = {r["seq_id"]: (r["logp"] / len(r["obs"]), r["seq_id"]) for r in labels.join(seqs, "seq_id").collect()}
    assert [k for k, v in again.items() if v == 1] == [min(fits, key=fits.get)]
    # A cluster of one does not lose it.
    few = labels.where("seq_id < 1")
    assert {r["model_id"] for r in training._reseeded(seqs, few, 2).collect()} == {0}


def test_clusters_from_random_starts(seqs):
    models, labels = training.cluster(seqs, training.random_starts(seqs, A, 2, seed=1), reseed=True)
    got = {r["seq_id"]: r["model_id"] for r in labels.collect()}
    assert len(models) == 2 and set(got.values()) == {0, 1}
    same = sum(got[i] == got[0] for i in range(0, 40, 2)) + sum(got[i] != got[0] for i in range(1, 40, 2))
    assert same >= 32
