"""Gap counts, ladders and the search for a loop against plain reckoning."""

from collections import Counter

import numpy as np
import pytest

from braidseq.operators import gapmodels, genefinder, hmm
from braidseq.plans import catalogue
from braidseq.plans.models import Model

RNG = np.random.default_rng(3)


def test_count_gaps(spark):
    genes = [("a", 3, 9), ("a", 20, 12), ("a", 25, 40), ("b", 5, 1), ("b", 10, 20), ("c", 1, 30)]
    contigs = [("a", 41), ("b", 20), ("c", 30), ("d", 5), ("e", 1)]
    got = {r["contig_id"]: (r["direct"], r["reverse"]) for r in gapmodels.count_gaps(spark.createDataFrame(genes, "contig_id string, idx1 int, idx2 int"), spark.createDataFrame(contigs, "contig_id string, len int")).collect()}
    want = {}
    for name, size in contigs:
        own = sorted((g for g in genes if g[0] == name), key=lambda g: min(g[1:]))
        direct, reverse, after, before = 0, 0, 1, size
        for _, i, j in own:
            if i < j:
                direct, after = direct + 1, j + 1
        for _, i, j in reversed(own):
            if i > j:
                reverse, before = reverse + 1, j - 1
        want[name] = (direct + (after < size), reverse + (before > 1))
    assert got == want


def test_ladder_has_the_counted_lengths(spark):
    sizes = RNG.geometric(0.2, 400).tolist() + [3] * 50 + [0]
    gaps = spark.createDataFrame([(x,) for x in sizes], "len int")
    rows = [r.asDict() for r in gapmodels.hazards(gaps, 8).collect()]
    counts = Counter(min(x, 8) for x in sizes if x)
    for r in rows:
        reached = sum(v for k, v in counts.items() if k >= r["rung"])
        assert (r["n"], r["reached"], r["hazard"]) == (counts[r["rung"]], reached, pytest.approx(counts[r["rung"]] / reached))
    m = gapmodels.ladder(rows)
    total = sum(counts.values())
    # Probability of a gap of length k: reach its rung, then leave.
    reach = 1.0
    for k in range(1, 8):
        h = m.a[0, k, m.n - 1]
        assert reach * h == pytest.approx(counts[k] / total)
        reach *= 1 - h
    tail = [x for x in sizes if x >= 8]
    assert 8 + m.a[0, 8, 8] / (1 - m.a[0, 8, 8]) == pytest.approx(np.mean(tail))
    with pytest.raises(ValueError):
        gapmodels.ladder([])


def test_lanes(spark):
    m = gapmodels.lanes(4)
    rows = m.a[0].sum(axis=1)
    assert np.allclose(rows[:-1], 1) and rows[-1] == 0 and int(m.silent.sum()) == 4 + 2
    assert m.a[0, m.names.index("intergenic_loop_4"), m.n - 1] == 0.5 and m.a[0, m.names.index("intergenic_step_4"), m.n - 1] == pytest.approx(2 / 3)
    assert m.a[0, m.names.index("intergenic_skip_4"), m.n - 1] == 1 and m.a[0, m.names.index("intergenic_loop_2"), m.names.index("intergenic_loop_2")] == 0.25
    inner = {a + b + c: 1 for a in "ACGT" for b in "ACGT" for c in "ACGT" if a + b + c not in ("TAA", "TAG", "TGA")}
    whole = gapmodels.ring(genefinder.genic(inner, {"ATG": 1}, {"TAA": 1}), m)
    assert not whole.silent.any() and whole.problems() == []
    d = spark.createDataFrame([("x", "CCGTC" + "ATG" + "AAA" * 30 + "TAA" + "GGCCG")], "contig_id string, seq string")
    got = genefinder.find(d, whole).where("idx1 < idx2").collect()
    assert [(r["idx1"], r["idx2"]) for r in got] == [(6, 101)]


def test_best_value(spark):
    sizes = RNG.geometric(0.1234, 300)
    held = spark.createDataFrame([(i, [0] * int(x) + [1]) for i, x in enumerate(sizes)], "seq_id long, obs array<int>")
    build = lambda p: Model.of([1, 0], [[p, 1 - p], [0, 1]], np.eye(2))
    value, score = gapmodels.best_value(held, build)
    best = 1 - 1 / sizes.mean()
    assert value == pytest.approx(best, abs=1.1e-5)
    assert score == pytest.approx(sum((x - 1) * np.log(value) + np.log(1 - value) for x in sizes))
    value, _ = gapmodels.best_value(held, build, score=lambda models: {i: -abs(m.a[0, 0, 0] - 0.98765) for i, m in models.items()})
    assert value == pytest.approx(0.98765)


def test_genic_check(spark):
    inner = {"AAA": 5, "CCG": 3, "GAT": 2}
    m = genefinder.genic(inner, {"ATG": 1, "GTG": 1}, {"TAA": 1})
    genes = ["ATGAAACCGTAA", "atggattaa", "GTGAAATAA", "ATGAATAA", "ATGAAANNNTAA", "CCGAAATAA", "ATGTTTTAA", "ATGAAATGA", "ATGTAA", "TAA", ""]
    d = spark.createDataFrame(list(enumerate(genes)), "seq_id long, seq string")
    r = gapmodels.genic_check(d, m).first().asDict()
    plain = m.without_silent()
    good = [g.upper() for g in genes if g.upper()[:3] in ("ATG", "GTG", "TTG") and g.upper()[-3:] in ("TAA", "TAG", "TGA") and set(g.upper()) <= set("ACGT") and len(g) > 5]
    found = []
    for g in good:
        (path,), _ = hmm.viterbi(plain, hmm.emissions(plain, np.array([["ACGT".index(c) for c in g]], float)), np.array([len(g)]))
        names = [plain.names[s] for s in path] if path is not None else []
        found.append(len(names) > 5 and all(x.startswith("start") for x in names[:3]) and all(x.startswith("stop") for x in names[-3:]))
    thirds = [len(g) % 3 == 0 for g in good]
    want = {"good": len(good), "len3": sum(thirds), "not_len3": len(good) - sum(thirds), "found": sum(found), "found_len3": sum(f and t for f, t in zip(found, thirds)), "found_not_len3": sum(f and not t for f, t in zip(found, thirds))}
    assert r == want and r["found"] >= 3 and r["not_len3"] == 1
    assert gapmodels.genic_check(d.limit(0), m).first()["good"] == 0
