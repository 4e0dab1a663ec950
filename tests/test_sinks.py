"""Writers for other programs, printed models, and annotated records."""

import xml.etree.ElementTree as tree

from braidseq.plans.models import Model
from braidseq.sources import text


def joined(path):
    return [p.read_text() for p in sorted(path.glob("part-*")) if p.stat().st_size]


def test_sequence_writers(spark, tmp_path):
    d = spark.createDataFrame([(1, 2, 1.0, [0, 3]), (2, None, 4.0, [5])], "seq_id long, label long, weight double, obs array<int>").coalesce(1)
    text.write_mathematica(d, str(tmp_path / "m"), "Runs")
    assert joined(tmp_path / "m") == ["Runs = {\n{0, 3},\n{5}\n};\n"]
    text.write_xml(d, str(tmp_path / "x"), "%d")
    root = tree.fromstring(joined(tmp_path / "x")[0])
    assert [(s.get("id"), [x.text for x in s.findall("Label")]) for s in root.iter("Sequence")] == [("seq1", ["2"]), ("seq2", [])]
    text.write_gnu(d.selectExpr("seq_id", "cast(obs as array<double>) as obs"), str(tmp_path / "g"), 2)
    assert joined(tmp_path / "g") == ["0.00\n3.00\n\n\n5.00\n\n\n"]
    text.write_xml(d.limit(0), str(tmp_path / "none"))
    assert joined(tmp_path / "none") == []


def test_printed_models():
    m = Model.of([1, 0], [[0.25, 0.75], [0, 1]], [[0.5, 0.5], [0.1, 0.9]])
    assert text.grid_lines(m.a[0], "\t") == ["\t0.25, 0.75;", "\t0.00, 1.00;"]
    assert text.grid_lines(m.a[0], transposed=True) == ["0.25, 0.00;", "0.75, 1.00;"]
    assert text.grid_lines(m.pi) == ["1.00, 0.00;"] and text.grid_lines([3, 4], pattern="%d", transposed=True) == ["3;", "4;"]
    lines = text.state_lines(m)
    assert lines[0].endswith("M = 2 \t N = 2") and lines[8] == "  Out states (Id, a):\t(0, 0.250) \t(1, 0.750) \t" and lines[-1] == "  In states (Id, a):\t(0, 0.750) \t(1, 1.000) \t"


def test_joined_places_and_qualifiers(spark, tmp_path):
    record = '''LOCUS       X
ACCESSION   AB1
FEATURES             Location/Qualifiers
     source          1..40
     gene            complement(join(3..8,
                     12..20))
                     /gene="abc"
                     /note="two lines / with a
                     slash and ""quotes"""
     CDS             join(<1..4,9..>12)
                     /codon_start=2
                     /product="thing"
                     /translation="MKV
                     LLA"
     variation       7
ORIGIN
        1 acgtacgtac gtac
//
'''
    (tmp_path / "x.gbk").write_text(record)
    contigs, found = text.read_genbank(spark, str(tmp_path))
    assert contigs.first()["seq"] == "acgtacgtacgtac"
    rows = [r for r in found.orderBy("feature_id").collect() if r["type"] != "source"]
    assert [(r["type"], r["idx1"], r["idx2"], [tuple(p) for p in r["parts"]]) for r in rows] == [("gene", 20, 3, [(3, 8), (12, 20)]), ("CDS", 1, 12, [(1, 4), (9, 12)])]
    assert rows[0]["gene"] == "abc" and rows[0]["note"] == 'two lines / with a slash and "quotes"' and rows[0]["product"] is None
    assert (rows[1]["codon_start"], rows[1]["product"], rows[1]["translation"]) == ("2", "thing", "MKVLLA")
