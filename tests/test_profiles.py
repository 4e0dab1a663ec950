"""Chains of positions against plain counts."""

from collections import defaultdict

import numpy as np
import pytest

from braidseq.operators import hmm, profiles


def test_chains(spark):
    rows = [("a", 1.0, [0, 1, 2]), ("a", 2.0, [0, 0]), ("a", 1.0, [1, None, 2]), ("b", 1.0, [2]), ("c", 1.0, []), (None, 0.5, [1, 1])]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq_id long, kind string, weight double, obs array<int>")
    count, reach, more = defaultdict(float), defaultdict(float), defaultdict(float)
    for k, w, o in rows:
        for t, x in enumerate(o):
            reach[k, t] += w
            more[k, t] += w * (t + 1 < len(o))
            if x is not None:
                count[k, t, x] += w
    got = profiles.positions(d, "kind").collect()
    assert len(got) == len(count)
    for r in got:
        k, t = r["key"], r["pos"]
        assert r["n"] == count[k, t, r["symbol"]] and r["reached"] == reach[k, t] and r["go_on"] == pytest.approx(more[k, t] / reach[k, t])
        assert r["p"] == pytest.approx(r["n"] / sum(v for (q, s, _), v in count.items() if (q, s) == (k, t)))
    models = profiles.chains(d, "kind", 3)
    assert set(models) == {"a", "b", None}
    m = models["a"]
    assert m.n == 4 and m.a[0, 1, 2] == pytest.approx(0.5) and m.a[0, 1, 3] == pytest.approx(0.5) and m.problems() == []
    d = spark.createDataFrame([(1, [0, 1, 2]), (2, [2])], "seq_id long, obs array<int>")
    logp = {r["seq_id"]: r["logp"] for r in hmm.loglik(d, m).collect()}
    assert logp[1] == pytest.approx(np.log(0.75 * (1 / 3) * 0.5)) and logp[2] is None
    assert profiles.chains(d.limit(0).selectExpr("seq_id", "seq_id as kind", "obs"), "kind", 3) == {}
