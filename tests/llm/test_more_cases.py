"""The machine's pair sum, and every pipeline stage on no rows and on rows with nulls and shared ids."""

import os

import corpus_pipeline
import numpy as np
import pytest

from braidseq.llm import quality
from braidseq.llm.common import numbered

SF = "/root/testdata/sf0.001"


def test_the_pair_sum_in_linear_time():
    m, rng = quality.Machine(), np.random.default_rng(2)
    m.w = rng.normal(size=m.w.shape)
    m.v = rng.normal(size=m.v.shape)
    m.b = 0.7
    for n in (0, 1, 2, 30):
        at, x = rng.choice(len(m.w), n, replace=False), rng.normal(size=n)
        pairs = sum(float(m.v[at[i]] @ m.v[at[j]]) * x[i] * x[j] for i in range(n) for j in range(i))
        assert m.margin(at, x) == pytest.approx(m.b + float(m.w[at] @ x) + pairs)


def test_a_training_step_lowers_the_loss():
    rng = np.random.default_rng(6)
    rows = [(rng.choice(50, 8, replace=False), np.full(8, 0.3), rng.normal(size=len(quality.STATS)).tolist()) for _ in range(120)]
    y = np.array([float(5 in r[0] or r[2][0] > 0.5) for r in rows])
    loss = lambda m: np.mean([np.log1p(np.exp(-(2 * t - 1) * m.margin(*m.inputs(*r)))) for r, t in zip(rows, y)])
    assert loss(quality.Machine().fit(rows, y, epochs=150)) < 0.8 * loss(quality.Machine().fit(rows, y, epochs=0))


def test_numbered_sorts_nulls_where_asked(spark):
    d = spark.createDataFrame([(None, "a"), (3, "b"), (3, "c"), (None, "z"), (3, "b")], "doc_id long, text string")
    for last in (False, True):
        rows, names = numbered(d, last)
        order = [r["doc_id"] for r in names.orderBy("d").collect()]
        assert order == ([3, 3, None, None] if last else [None, None, 3, 3])
        assert rows.count() == 5 and rows.select("d").distinct().count() == 4


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_no_rows_and_odd_rows(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert stage(spark, docs.limit(0), SF).count() == 0
    some = docs.orderBy("doc_id").limit(40)
    odd = some.selectExpr(*[f"cast(null as {t}) as {c}" if c == "doc_id" else c for c, t in docs.dtypes]).limit(3)
    nulls = some.limit(2).selectExpr(*[f"cast(null as {t}) as {c}" for c, t in docs.dtypes])
    shared = some.selectExpr(*["cast(7 as long) as doc_id" if c == "doc_id" else c for c in docs.columns]).limit(4)
    every = some.unionByName(odd).unionByName(nulls).unionByName(shared)
    out = stage(spark, every, SF)
    if name != "sentencepiece":
        assert out.columns == docs.columns
    n = out.count()
    if name == "minhash":
        texts = [r["text"] for r in out.select("text").collect()]
        assert len([t for t in texts if t]) == len({t for t in texts if t})  # exact copies are gone, whatever their ids
    else:
        assert n >= 40
