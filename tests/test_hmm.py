"""Folds against enumeration of all paths, and invariants of training."""

from dataclasses import replace
from itertools import product

import numpy as np
import pytest

from braidseq.operators import genefinder, hmm, sampling, training
from braidseq.plans import models
from braidseq.plans.models import Model

LOADED = Model.of([1, 0], [[0.95, 0.05], [0.10, 0.90]], [[1 / 6] * 6, [0.1] * 5 + [0.5]], names=("fair", "loaded"), labels=(0, 1))
SMALL = Model.of([0.6, 0.3, 0.1], [[0.5, 0.3, 0.2], [0.1, 0.8, 0.1], [0.3, 0.3, 0.4]], [[0.7, 0.3], [0.2, 0.8], [0.5, 0.5]], labels=(0, 1, 1))
SILENT = Model.of([0.5, 0.5, 0, 0], [[0.2, 0, 0.5, 0.3], [0.3, 0.4, 0.3, 0], [0, 0.6, 0, 0.4], [0.7, 0.3, 0, 0]], [[0.7, 0.3], [0.2, 0.8], [0, 0], [0, 0]])


def paths(m, obs):
    out = {}
    for p in product(range(m.n), repeat=len(obs)):
        w = m.pi[p[0]] * m.b[p[0], obs[0]]
        for t in range(1, len(obs)):
            w *= m.a[0, p[t - 1], p[t]] * m.b[p[t], obs[t]]
        out[p] = w
    return out


def seqs(spark, rows, **more):
    return spark.createDataFrame([(i, 1.0, list(r), *[v[i] for v in more.values()]) for i, r in enumerate(rows)], "seq_id long, weight double, obs array<int>" + "".join(f", {k} array<int>" for k in more))


OBS = [[0, 1, 1, 0], [1], [0, 0, 0], []]


def test_forward_backward_viterbi_posterior(spark):
    d = seqs(spark, OBS)
    up, down = ({r["seq_id"]: r["logp"] for r in f(d, SMALL).collect()} for f in (hmm.loglik, hmm.backward_loglik))
    fold = {r["seq_id"]: r["logp"] for r in hmm.forward_fold(d, SMALL).collect()}
    best = {r["seq_id"]: r for r in hmm.decode(d, SMALL).collect()}
    post = {(r["seq_id"], r["pos"], r["state"]): r["p"] for r in hmm.posterior(d, SMALL).collect()}
    for i, o in enumerate(OBS):
        if not o:
            assert up[i] == 0 and fold[i] == 0 and list(best[i]["path"]) == []
            continue
        every = paths(SMALL, o)
        total = sum(every.values())
        assert up[i] == pytest.approx(np.log(total)) and down[i] == pytest.approx(up[i]) and fold[i] == pytest.approx(up[i])
        top = max(every.values())
        assert tuple(best[i]["path"]) in [p for p, w in every.items() if w == pytest.approx(top)] and best[i]["logp"] == pytest.approx(np.log(top))
        for t in range(len(o)):
            for s in range(3):
                assert post[i, t, s] == pytest.approx(sum(w for p, w in every.items() if p[t] == s) / total)


def test_impossible_and_missing(spark):
    m = Model.of([1.0, 0.0], [[0.0, 1.0], [0.0, 1.0]], [[1.0, 0.0], [0.0, 1.0]])
    got = {r["seq_id"]: r["logp"] for r in hmm.loglik(seqs(spark, [[0, 1, 1], [1, 0], [2, 1], [0, 2]]), m).collect()}
    assert got[0] == 0 and got[2] == pytest.approx(0) and got[3] == pytest.approx(0) and (got[1] is None or np.isnan(got[1]))
    assert hmm.decode(seqs(spark, [[1, 0]]), m).first()["path"] is None


def test_all_words_sum_to_one(spark):
    for m in (SMALL, SILENT, replace(SMALL, b=np.random.default_rng(0).dirichlet([1, 1], (3, 2)).reshape(3, 4), order=1)):
        total = sum(np.exp(r["logp"]) for r in hmm.loglik(sampling.words(spark, 4, 2), m).collect())
        assert total == pytest.approx(1.0)


def test_silent_states_can_be_removed(spark):
    d = seqs(spark, OBS)
    a, b = ({r["seq_id"]: r["logp"] for r in hmm.loglik(d, m).collect()} for m in (SILENT, SILENT.without_silent()))
    assert all(a[i] == pytest.approx(b[i]) for i in range(4)) and SILENT.without_silent().problems() == []


def test_labels(spark):
    d = seqs(spark, OBS[:3], state_labels=[[0, 1, 1, 0], [1], [0, 0, 1]])
    got = {r["seq_id"]: r["logp"] for r in hmm.label_loglik(d, SMALL).collect()}
    lab = [[0, 1, 1, 0], [1], [0, 0, 1]]
    for i, o in enumerate(OBS[:3]):
        want = sum(w for p, w in paths(SMALL, o).items() if [SMALL.labels[s] for s in p] == lab[i])
        assert got[i] == pytest.approx(np.log(want))
    best = {r["seq_id"]: r for r in hmm.kbest(d, SMALL, k=50).collect()}
    for i, o in enumerate(OBS[:3]):
        sums = {}
        for p, w in paths(SMALL, o).items():
            k = tuple(SMALL.labels[s] for s in p)
            sums[k] = sums.get(k, 0) + w
        assert best[i]["logp"] == pytest.approx(np.log(max(sums.values())))


def test_training_never_loses(spark):
    d = sampling.generate(spark.range(30).withColumnRenamed("id", "seq_id"), LOADED, 60)
    seen = []
    m, _ = training.baum_welch(d, LOADED.with_noise(0.4, 1), steps=8, watch=seen.append)
    assert all(b >= a - 1e-8 for a, b in zip(seen, seen[1:])) and len(seen) > 3 and m.problems() == []
    fixed, _ = training.baum_welch(d, replace(LOADED, fixed=(True, False), tied=()), steps=2)
    assert np.allclose(fixed.b[0], LOADED.b[0]) and not np.allclose(fixed.b[1], LOADED.b[1])
    tied, _ = training.baum_welch(d, replace(LOADED, tied=(0, 0)), steps=2)
    assert np.allclose(tied.b[0], tied.b[1])
    again = sampling.generate(spark.range(30).withColumnRenamed("id", "seq_id").repartition(3), LOADED, 60)
    assert {tuple(r["obs"]) for r in again.collect()} == {tuple(r["obs"]) for r in d.collect()}


def test_one_step_against_enumeration(spark):
    e = training.expected(seqs(spark, OBS), SMALL)
    a, b = np.zeros((3, 3)), np.zeros((3, 2))
    for o in OBS[:3]:
        every = paths(SMALL, o)
        total = sum(every.values())
        for p, w in every.items():
            for t, s in enumerate(p):
                b[s, o[t]] += w / total
                if t:
                    a[p[t - 1], s] += w / total
    assert np.allclose(e["a"][0], a) and np.allclose(e["b"], b)


def test_gauss_training(spark):
    true = Model.of([0.5, 0.5], [[0.9, 0.1], [0.1, 0.9]], c=[[1.0], [1.0]], mu=[[0.0], [10.0]], var=[[1.0], [4.0]])
    d = sampling.generate(spark.range(20).withColumnRenamed("id", "seq_id"), true, 80)
    m, _ = training.baum_welch(d, replace(true, mu=np.array([[2.0], [7.0]])), steps=15)
    assert np.allclose(m.mu.ravel(), [0, 10], atol=0.5)


def test_viterbi_and_gradient_training(spark):
    d = sampling.generate(spark.range(20).withColumnRenamed("id", "seq_id"), LOADED, 50)
    m = training.viterbi_train(d, LOADED.with_noise(0.2, 2), steps=4, pseudo=1.0)
    assert m.problems() == []
    labelled = d.withColumnRenamed("states", "state_labels")
    start = LOADED.with_noise(0.5, 3)
    before = training.gradient(labelled, start, steps=0)[1]
    assert training.gradient(labelled, start, steps=6)[1] >= before


def test_clusters_and_mixture(spark):
    a = Model.of([1.0], [[1.0]], [[0.9, 0.1]], prior=0.5)
    b = Model.of([1.0], [[1.0]], [[0.1, 0.9]], prior=0.5)
    d = seqs(spark, [[0] * 9 + [1]] * 6 + [[1] * 9 + [0]] * 4)
    _, labels = training.cluster(d, [a, b], rounds=3, steps=3)
    assert [r["count"] for r in labels.groupBy("model_id").count().orderBy("model_id").collect()] == [6, 4]
    fitted, _ = training.mixture(d, [a, b], rounds=4)
    assert fitted[0].prior == pytest.approx(0.6, abs=0.01)


def test_distance_and_classification(spark):
    other = replace(LOADED, b=LOADED.b[::-1].copy())
    assert LOADED.distance(LOADED) == 0 and LOADED.distance(other) > 0
    assert sampling.probability_distance(spark, LOADED, other, 10, 50) > 0
    d = seqs(spark, [[5] * 20, [0, 1, 2, 3, 4] * 4])
    got = {r["seq_id"]: r for r in hmm.classify(d, {3: LOADED, 7: Model.of([1.0], [[1.0]], [[1 / 6] * 6])}).collect()}
    assert got[0]["model_id"] == 3 and got[1]["model_id"] == 7 and 0.5 < got[0]["posterior"] <= 1


def test_pair_alignment(spark):
    d = spark.createDataFrame([(1, [0, 1, 2], [0, 2])], "seq_id long, x array<int>, y array<int>")
    a = np.array([[0.8, 0.1, 0.1], [0.8, 0.2, 0], [0.8, 0, 0.2]])
    emit = lambda s, x, y: (0.3 if x == y else 0.001) if s == 0 else 0.25
    r = hmm.align(d, a, np.array([0.8, 0.1, 0.1]), [(1, 1), (1, 0), (0, 1)], emit).first()
    assert list(r["path"]) == [0, 1, 0] and r["logp"] == pytest.approx(np.log(0.8 * 0.3 * 0.1 * 0.25 * 0.8 * 0.3))


def test_model_edits(spark):
    m = SMALL.edited(edges={(0, 2): 0.0}).normalized()
    assert m.a[0, 0, 2] == 0 and m.problems() == []
    long = LOADED.with_duration(1, 3)
    assert long.n == 4 and long.problems() == []
    x = Model.of([1.0, 0], [[0.5, 0.5], [1, 0]], [[1, 0], [0, 1.0]], names=("A", "B"))
    y = Model.of([1.0, 0], [[0.1, 0.9], [1, 0]], [[0.5, 0.5], [0, 1.0]], names=("b", "C"))
    z = x.merged(y)
    assert z.names == ("A", "B", "C") and np.allclose(z.b[1], [0, 1]) and z.problems() == []
    t = models.tables(spark, {4: SMALL})
    back = models.from_tables(t["states"], t["transitions"], t["emissions"], 4)
    assert np.allclose(back.a, SMALL.a) and np.allclose(back.b, SMALL.b) and np.allclose(back.pi, SMALL.pi)
    assert np.allclose(models.left_right([0, 2, 1], 3).b.argmax(axis=1), [0, 2, 1])


def test_gene_finder(spark):
    gene = "ATG" + "GCC" * 12 + "TAA"
    contig = "T" * 60 + gene + "T" * 70
    genes = spark.createDataFrame([(gene,)], "seq string")
    inner, starts, stops = genefinder.statistics(genes)
    assert inner == {"GCC": 12} and starts == {"ATG": 1} and stops == {"TAA": 1}
    m = genefinder.joined(genefinder.genic(inner, starts, stops), genefinder.dumb_intergenic(60, (0.05, 0.05, 0.05, 0.85)), 0.02)
    found = genefinder.find(spark.createDataFrame([("c", contig)], "contig_id string, seq string"), m)
    truth = spark.createDataFrame([("c", 61, 60 + len(gene))], "contig_id string, idx1 long, idx2 long")
    forward = [(r["idx1"], r["idx2"]) for r in found.where("idx1 < idx2").collect()]
    assert (61, 60 + len(gene)) in forward
    score = {r["reverse"]: r for r in genefinder.evaluate(truth, found).collect()}
    assert score[False]["matched"] == 1 and score[False]["exact"] == 1
