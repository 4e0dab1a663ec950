"""Training goes on until it converges, and what it returns belongs together."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidseq.operators import hmm, sampling, training
from braidseq.plans import catalogue
from braidseq.plans.models import Model

SF = "/root/testdata/sf0.001"
A = Model.of([0.5, 0.5], [[0.6, 0.4], [0.3, 0.7]], [[0.5, 0.3, 0.2], [0.2, 0.3, 0.5]], prior=0.5)
B = Model.of([0.5, 0.5], [[0.5, 0.5], [0.5, 0.5]], [[0.2, 0.5, 0.3], [0.4, 0.2, 0.4]], prior=0.5)


@pytest.fixture(scope="module")
def drawn(spark):
    ids = spark.range(24).withColumnRenamed("id", "seq_id")
    return sampling.generate(ids.where("seq_id < 12"), A, 30).unionByName(sampling.generate(ids.where("seq_id >= 12"), B, 30)).select("seq_id", F.lit(1.0).alias("weight"), "obs").persist()


def total(d, m):
    return hmm.loglik(d, m).agg(F.sum("logp")).first()[0]


def test_out_of_steps(drawn):
    m, logp = training.baum_welch(drawn, A, steps=2, gain=0.0)
    assert logp == pytest.approx(total(drawn, m), abs=1e-9)


def test_labels_are_those_of_the_models_returned(drawn):
    for rounds, steps in ((1, 5), (None, 2)):
        fitted, labels = training.cluster(drawn, [A, B], rounds=rounds, steps=steps)
        got, want = ({r["seq_id"]: (r["model_id"], r["logp"]) for r in d.collect()} for d in (labels, hmm.classify(drawn, dict(enumerate(fitted)))))
        assert got == want


def test_mixture_likelihood_is_that_of_the_models_returned(drawn):
    fitted, logp = training.mixture(drawn, [A, B], rounds=1, steps=1)
    each = np.array([[r["logp"] + np.log(m.prior) for r in hmm.loglik(drawn, m).orderBy("seq_id").collect()] for m in fitted])
    assert logp == pytest.approx(np.logaddexp(each[0], each[1]).sum(), abs=1e-8)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_queries_train_until_the_gain_is_small(spark):
    for seqs, start, query in ((catalogue.event_seqs, catalogue.CALM, "em_trained"), (catalogue.value_seqs, catalogue.GAUSS, "gauss_trained")):
        d, seen = seqs(spark, SF), []
        m, logp = training.baum_welch(d, start, watch=seen.append)
        assert seen[-1] - seen[-2] <= training.GAIN * abs(seen[-1]) and all(b - a > training.GAIN * abs(b) for a, b in zip(seen[:-2], seen[1:-1]))
        rows = catalogue.QUERIES[query](spark, SF).collect()
        if query == "em_trained":
            assert rows[0]["logp"] == pytest.approx(logp, abs=1e-6) and np.allclose([r["p"] for r in rows], m.a[0].ravel())
        else:
            assert np.allclose([r["mue"] for r in rows], m.mu.ravel())
