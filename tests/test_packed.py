"""Sequences packed once for many passes (F3, F4, F5)."""

import numpy as np

from braidseq.operators import discriminative, hmm, training
from braidseq.plans.models import Model

RNG = np.random.default_rng(8)
M = Model.of([0.3, 0.7], [[0.6, 0.4], [0.4, 0.6]], [[0.6, 0.2, 0.2], [0.1, 0.5, 0.4]])
N = Model.of([0.5, 0.5], [[0.5, 0.5], [0.3, 0.7]], [[0.2, 0.2, 0.6], [0.3, 0.3, 0.4]])


def rows():
    return [(i, 1.0 + i % 3, i % 2 if i % 5 else None, RNG.integers(0, 3, i % 9).tolist()) for i in range(60)]


def test_packed_keeps_every_sequence_in_few_partitions(spark):
    want = rows()
    blocks = hmm.packed(spark.createDataFrame(want, "seq_id long, weight double, label int, obs array<int>").repartition(20), ("label",))
    got = {}
    for x in hmm.unpacked([blocks.toPandas()]):
        for i, s in enumerate(x["ids"].tolist()):
            got[s] = (s, float(x["weight"][i]), int(x["label"][i]), x["obs"][i, : x["lengths"][i]].astype(int).tolist())
    assert sorted(got.values()) == [(s, w, -1 if k is None else k, o) for s, w, k, o in want] and blocks.rdd.getNumPartitions() == 1


def test_counts_of_a_batch_equal_sums_over_paths(spark):
    obs, n = RNG.integers(0, 3, (6, 5)).astype(float), np.array([5, 3, 1, 5, 2, 4])
    obs[0, 2] = 3  # a missing symbol
    w = RNG.random(6)
    got = training.counted(M, obs, n, w)
    a, b = np.zeros((2, 2)), np.zeros((2, 3))
    for i, size in enumerate(n):
        paths = np.array(np.meshgrid(*[[0, 1]] * size, indexing="ij")).reshape(size, -1).T
        o = obs[i, :size].astype(int)
        say = np.concatenate([M.b, np.ones((2, 1))], axis=1)
        p = np.array([M.pi[q[0]] * np.prod([M.a[0][x, y] for x, y in zip(q, q[1:])]) * np.prod(say[q, o]) for q in paths])
        for q, share in zip(paths, p / p.sum() * w[i]):
            np.add.at(a, (q[:-1], q[1:]), share)
            np.add.at(b, (q[o < 3], o[o < 3]), share)
    assert np.allclose(got["a"][0], a) and np.allclose(got["b"], b)


def test_a_step_has_no_shuffle(spark):
    """A pass is one stage of as many tasks as the symbols need; it was two stages of shuffle.partitions tasks and more."""
    d = spark.createDataFrame([(s, w, k or 0, [*o, 1]) for s, w, k, o in rows()], "seq_id long, weight double, label int, obs array<int>").repartition(20)
    blocks = hmm.packed(d, ("label",))
    tracker, group = spark.sparkContext.statusTracker(), "one pass"
    spark.sparkContext.setJobGroup(group, group)
    try:
        discriminative._coupled(blocks, [M, N], 1.0)
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert len(jobs) == 1 and len(jobs[0].stageIds) == 1
