"""Counts that are made in tasks, without a row for each codon or gap (F11, F12)."""

from collections import Counter

import numpy as np

from braidseq.operators import codons, gapmodels, intervals
from braidseq.plans import catalogue

RNG = np.random.default_rng(3)


def test_six_frames_of_odd_strings(spark):
    """Short, empty and null strings, other letters, and letters of several bytes; no row is made for a codon."""
    strings = ["", None, "a", "ac", "acgtn", "ACGTACGTTT", "aé漢acg", *["".join(RNG.choice(list("acgt"), k)) for k in range(3, 40)]]
    d = codons.six_frames(spark.createDataFrame([(s,) for s in strings], "seq string").repartition(3))
    want = Counter()
    for s in (s.upper() for s in strings if s):
        back = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        for f in range(3):
            want.update((f + 1, s[i : i + 3]) for i in range(f, len(s) - 2, 3))
            want.update((f + 4, back[i : i + 3]) for i in range(f, len(back) - 2, 3))
    assert {(r["frame"], r["codon"]): r["n"] for r in d.collect()} == dict(want)
    assert "Generate" not in d._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[-1]


def test_the_loop_sees_a_row_for_each_gap_length(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(gapmodels, "best_value", lambda held, build, **_: seen.append(held) or (0.5, 1.0))
    catalogue.gap_loop(spark, "/root/testdata/sf0.001")
    g = intervals.gaps(catalogue.stays(spark, "/root/testdata/sf0.001"), ["contig_id"]).selectExpr("gap_end - gap_start + 1 as len")
    assert {len(r["obs"]) - 1: r["weight"] for r in seen[0].collect()} == {r["len"]: r["count"] for r in g.groupBy("len").count().collect()}
    assert seen[0].count() < g.count()
