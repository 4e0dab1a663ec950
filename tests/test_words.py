"""Decoding by words against decoding state by state (F1, F3)."""

import numpy as np
import pytest

from braidseq.operators import gapmodels, genefinder, hmm, longpath, words
from braidseq.plans import catalogue
from braidseq.plans.models import Model

RNG = np.random.default_rng(6)
FEW = {"AAA": 500, "CCG": 300, "GAT": 200, "ATG": 50, "TAA": 50}
#: A loop of two words beside one that waits, with states that are reached from several places.
LOOPS = Model.of(
    [0.5, 0, 0, 0.5, 0, 0], [[0, 1, 0, 0, 0, 0], [0.5, 0, 0.25, 0.25, 0, 0], [0.3, 0, 0.7, 0, 0, 0], [0, 0, 0, 0, 1, 0], [0, 0, 0, 0, 0, 1], [0.5, 0, 0, 0.5, 0, 0]],
    [[0.7, 0.1, 0.1, 0.1], [0.1, 0.4, 0.4, 0.1], [0.25] * 4, [0, 0.5, 0.5, 0], [0.5, 0, 0, 0.5], [0.25] * 4], names=("intergenic_a", "b", "c", "d", "e", "f"),
)
MODELS = {
    "gaps and genes": catalogue.gene_model(FEW, gap=40.0),
    "one gene": genefinder.genic({k: n for k, n in FEW.items() if k != "TAA"}, {"ATG": 1}, {"TAA": 1}),
    "every codon alike": catalogue.gene_model({}, gap=3.0),
    "loops": LOOPS,
}


def strings():
    gene = "ATG" + "AAACCGGAT" * 5 + "TAA"
    out = ["", "A", "AT", "ATG", "CATGTAA", gene, gene * 3, "acgt" * 30, "ATGAAATAA" * 12]
    for n in (5, 50, 333):
        s = "".join(RNG.choice(list("ACGTN"), n, p=[0.3, 0.2, 0.2, 0.28, 0.02]))
        out += [s, s + gene + s, "ATG" + s.replace("N", "A") + "TAA"]
    return out


@pytest.mark.parametrize("name", MODELS)
@pytest.mark.parametrize("size", [2, 7, 4096])
def test_equals_state_by_state(spark, name, size):
    m, seqs = MODELS[name], strings()
    numbers = [[{"A": 0, "C": 1, "G": 2, "T": 3}.get(c, 4) for c in s.upper()] for s in seqs]
    d = spark.createDataFrame(list(enumerate(numbers)), "seq_id long, obs array<int>")
    want = {r["seq_id"]: r for r in longpath.decode_parts(longpath.cut(d), m).collect()}
    plain = {r["seq_id"]: r for r in hmm.decode(d, m).collect()}
    got = {}
    for r in sorted(words.paths(words.cut(spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string"), m, size), m, fan=3).collect(), key=lambda r: (r["seq_id"], r["part"])):
        path, logp = got.get(r["seq_id"], ([], 0.0))
        if r["path"] is None:
            got[r["seq_id"]] = (None, None)
            continue
        assert r["offset"] == len(path)
        got[r["seq_id"]] = (path + r["path"], logp + r["logp"])
    assert set(got) == set(want) == {i for i, s in enumerate(seqs) if s}
    for i in got:
        assert got[i][0] == want[i]["path"]
        assert got[i][1] == (None if want[i]["logp"] is None else pytest.approx(want[i]["logp"], abs=1e-8)) == (None if plain[i]["logp"] is None else pytest.approx(plain[i]["logp"], abs=1e-6))
    tips = {r["seq_id"]: r for r in words.tips(words.cut(spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string"), m, size), m, 3).collect()}
    assert all((tips[i]["head"], tips[i]["tail"]) == (None if p is None else p[:3], None if p is None else p[-3:]) for i, (p, _) in got.items())


def test_genes_of_a_contig_of_pieces(spark):
    """Pieces of any length, in parts that begin within them and within words."""
    m = MODELS["gaps and genes"]
    pieces = [s.replace("N", "") for s in strings()]
    obs = [["ACGT".index(c) for c in "".join(pieces).upper()]]
    want = {tuple(r) for r in genefinder.genes_of(longpath.decode_parts(longpath.cut(spark.createDataFrame([(0, *obs)], "seq_id long, obs array<int>")), m).selectExpr("*", "0L as offset"), m).collect()}
    d = longpath.one_contig(spark.createDataFrame(list(enumerate(pieces)), "doc_id long, obs string").repartition(5), ["doc_id"], size=11)
    for size in (10, 64):
        parts = words.contig(d, m, size)
        assert {r["obs"].decode() for r in parts.where("part = 3").collect()} == {"".join(pieces)[3 * size - 2 : 4 * size]}
        assert {tuple(r) for r in genefinder.genes_in(parts, m).collect()} == want and len(want) >= 5


def test_a_gene_model_moves_few_scores():
    """Each symbol moved over 200 states and some hundred edges; words leave six edges and eight scores, whatever the codons."""
    for counts in (FEW, {}):
        m = words.Words(catalogue.gene_model(counts))
        assert len(m.u) == 6 and len(m.slot) == 8 and m.lead == 2


def test_models_without_words(spark):
    a = RNG.random((40, 40))
    b = RNG.random((40, 4))
    dense = Model.of(np.full(40, 1 / 40), a / a.sum(axis=1, keepdims=True), b / b.sum(axis=1, keepdims=True), names=tuple(f"{'start' if i < 20 else 'stop'}_{i}" for i in range(40)))
    with pytest.raises(words.NoWords):
        words.Words(dense)
    d = spark.createDataFrame([(1, "ATGCCCTAA"), (2, "ATGTAACTAA")], "seq_id long, seq string")
    assert gapmodels.genic_check(d, dense).first()["good"] == 2
