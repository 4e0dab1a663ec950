"""Scalars, intervals, codons, readers and writers on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidseq.functions import dna, numeric
from braidseq.operators import codons, genefinder, intervals, sequences
from braidseq.plans.models import Model
from braidseq.sources import text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_dna(spark):
    s = F.lit("acgtuN")
    assert one(spark, dna.ints(s)) == [0, 1, 2, 3, 3, None]
    assert one(spark, dna.reverse_complement(F.lit("ACGTTa"))) == "tAACGT"
    assert one(spark, dna.codons(F.lit("ACGTACG"), 1)) == ["CGT", "ACG"] and one(spark, dna.codons(F.lit("AC"))) == []
    assert one(spark, dna.codon_id(F.lit("GTA"))) == 2 + 12 + 0 and one(spark, dna.is_start(F.lit("gtg"))) and one(spark, dna.is_stop(F.lit("TGA")))
    assert one(spark, dna.one_hot(F.lit("G"))) == [0, 0, 1, 0] and one(spark, dna.int2nt(F.lit(2))) == "g"
    fixed = one(spark, dna.resolve_ambiguous(F.lit("acRYn")))
    assert fixed[:2] == "AC" and fixed[2] in "AG" and fixed[3] in "CT" and fixed[4] in "ACGT"
    with pytest.raises(Exception, match="gap"):
        one(spark, dna.resolve_ambiguous(F.lit("a-c")))
    assert one(spark, dna.region(F.lit("AACCGGTT"), F.lit(4), F.lit(2))) == "GGT" and one(spark, dna.region(F.lit("AACC"), F.lit(2), F.lit(2))) == "A"


def test_numeric(spark):
    v = F.array(*map(F.lit, [1.0, 3.0]))
    assert one(spark, numeric.normalize(v)) == [0.25, 0.75] and one(spark, numeric.normalize(F.array(F.lit(0.0)))) is None
    m = F.array(v, F.array(F.lit(0.0), F.lit(2.0)))
    assert one(spark, numeric.times(m, v)) == [10.0, 6.0] and one(spark, numeric.transpose(m)) == [[1.0, 0.0], [3.0, 2.0]]
    assert one(spark, numeric.log_sum(F.array(F.lit(0.0), F.lit(None).cast("double"), F.lit(0.0)))) == pytest.approx(np.log(2))
    assert one(spark, numeric.normal_density(F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(0.3989422804)
    assert one(spark, numeric.normal_cdf(F.lit(1.96), F.lit(0.0), F.lit(1.0))) == pytest.approx(0.975, abs=1e-4)
    assert one(spark, numeric.truncated_density(F.lit(-1.0), F.lit(0.0), F.lit(1.0))) == 0
    assert one(spark, numeric.emission_row(F.lit(1), F.lit(2), 4, F.lit(1))) == 6


def features(spark, rows):
    return spark.createDataFrame([("c", i, *r) for i, r in enumerate(rows)], "contig_id string, feature_id long, idx1 long, idx2 long")


def test_intervals(spark):
    f = features(spark, [(1, 10), (30, 12), (15, 20), (31, 31), (50, 60)])
    gaps = sorted((r["gap_start"], r["gap_end"]) for r in intervals.gaps(f, ["contig_id"]).collect())
    assert gaps == [(11, 11), (32, 49)]
    assert intervals.within(f, 10, 31).count() == 3 and intervals.of_length(f, 1, 10).count() == 3
    d = intervals.spans(f).select("contig_id", "feature_id", "lo", "hi")
    for width in (1, 7, 1000):
        got = {(r["feature_id"], r["r_feature_id"]) for r in intervals.overlaps(d, d, ["contig_id"], width).collect()}
        assert got == {(i, i) for i in range(5)} | {(1, 2), (2, 1)}
    points = spark.createDataFrame([("c", p) for p in (1, 11, 31, 40)], "contig_id string, at long")
    assert sorted(r["at"] for r in intervals.uncovered(points, d, ["contig_id"], 8).collect()) == [11, 40]
    cut = genefinder.best_cut(f, 0.5).first()
    assert cut["at"] in (11, 32)
    rows = spark.createDataFrame([("k", i, s) for i, s in enumerate("aabba")], "k string, pos int, s string")
    runs = sorted((r["first"], r["last"], r["s"]) for r in intervals.islands(rows, ["k"], ["pos"], "s").collect())
    assert runs == [(0, 1, "a"), (2, 3, "b"), (4, 4, "a")]


def test_codons(spark):
    d = spark.createDataFrame([("ATGGCCTAA",), ("ATGGCCTA",), ("CCC",), ("",)], "seq string")
    assert codons.valid_genes(d).count() == 1
    assert {r["base"]: r["n"] for r in codons.base_counts(d).collect()} == {"a": 5, "c": 7, "g": 4, "t": 4}
    assert {(r["frame"], r["codon"]): r["n"] for r in codons.six_frames(d).collect()}[4, "TTA"] == 1


def test_sequences(spark):
    d = spark.createDataFrame([(1, 1.0, [0.5, -0.5, 2.4]), (2, 1.0, [1.0])], "seq_id long, weight double, obs array<double>")
    assert [r["obs"] for r in sequences.rounded(d).orderBy("seq_id").collect()] == [[1, -1, 2], [1]]
    assert [len(r["obs"]) for r in sequences.truncated(d, -1).collect()] == [0, 0]
    assert [(r["mean"], r["n"]) for r in sequences.mean_sequence(d).orderBy("pos").collect()] == [(0.75, 2), (-0.25, 1), (1.2, 1)]
    with pytest.raises(Exception, match="out of range"):
        sequences.check(spark.createDataFrame([(1, [0, 7])], "seq_id long, obs array<int>"), 3).collect()


def test_sequence_files(spark, tmp_path):
    (tmp_path / "a.sqd").write_text("# note\nSEQD = {\n O = {\n (0) <3> |2.0| 5.62, -0.73;\n 1.0;\n };\n};\nSEQ = { L = { seq_len = 2; symb = 2; }; };\n")
    rows = text.read_sequences(spark, str(tmp_path / "a.sqd")).collect()
    assert [list(r["obs"]) for r in rows] == [[5.62, -0.73], [1.0], [0, 0], [0, 1], [1, 0], [1, 1]]
    assert rows[0]["label"] == 3 and rows[0]["weight"] == 2 and rows[1]["label"] is None and rows[2]["block"] == 1
    d = spark.createDataFrame([(i, i, 1.5, [1.25 * i, 1000000.5]) for i in range(6)], "seq_id long, label long, weight double, obs array<double>").repartition(3)
    text.write_sequences(d, str(tmp_path / "out"), "SEQD")
    back = {r["seq_id"]: (r["label"], r["weight"], list(r["obs"])) for r in text.read_sequences(spark, str(tmp_path / "out")).collect()}
    assert back == {i: (i, 1.5, [1.25 * i, 1000000.5]) for i in range(6)}
    with pytest.raises(ValueError):
        text.parse_sequences("SEQ = { Z = { 1; }; };")


def test_model_files(tmp_path):
    m = Model.of([0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]], [[0.5, 0.5], [0.1, 0.9]], names=("x", "y"))
    back = text.parse_models(text.text_of_model(m) * 2)
    assert len(back) == 2 and np.allclose(back[1].a, m.a) and np.allclose(back[1].b, m.b)
    g = Model.of([1.0, 0], np.ones((2, 2, 2)) / 2, c=[[1.0], [1.0]], mu=[[0.0], [5.0]], var=[[1.0], [2.0]])
    back = text.parse_models(text.text_of_model(g))[0]
    assert back.a.shape == (2, 2, 2) and np.allclose(back.mu, g.mu)
    (tmp_path / "part.cfg").write_text('inner={ 1 -2.5 "q\\"" }')
    tree = text.parse_config('a=1, b="two" @include "part.cfg" list={ { x=1 } { x=2 } }', tmp_path)
    assert tree == {"a": 1.0, "b": "two", "inner": [1.0, -2.5, 'q"'], "list": [{"x": 1.0}, {"x": 2.0}]}
    m4 = Model.of([1.0, 0], [[0.25, 0.75], [1, 0]], [[0.1, 0.2, 0.3, 0.4], [0, 0, 0, 1.0]], names=("s", "t"))
    same = text.model_of_config(text.parse_config(text.config_of_model(m4)))
    assert np.allclose(same.a, m4.a) and np.allclose(same.b, m4.b) and same.names == ("s", "t")


def test_genbank(spark, tmp_path):
    (tmp_path / "x.gbk").write_text("LOCUS       X\nACCESSION   AB1\nFEATURES             Location/Qualifiers\n     gene            3..8\n     gene            complement(10..14)\nORIGIN\n        1 acgtacgtac gtac\n//\n")
    contigs, found = text.read_genbank(spark, str(tmp_path))
    assert contigs.first()["seq"] == "acgtacgtacgtac"
    assert sorted((r["type"], r["idx1"], r["idx2"]) for r in found.collect()) == [("gene", 3, 8), ("gene", 14, 10)]
