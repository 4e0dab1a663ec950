"""Nothing ends silently on a fixed number of rounds."""

import pytest

from braidseq.llm.common import components


def test_components_say_when_they_are_not_done(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r["component"] for r in components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(chain, rounds=1)


def test_giant_documents_are_cut_between_units(docs_of):
    """Parts of a giant document, encoded on their own, give the ids of the whole."""
    import pytest

    from braidseq.llm import sentencepiece_scan

    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_scan.MODEL)
    texts = ["short one", " ".join(f"Wörter {i} und 漢字  more" for i in range(300)), "x" * 900, None, "", " lead and trail  " * 40, "same text here " * 60, "same text here " * 60]
    rows = sentencepiece_scan.encode(docs_of(texts, ids=[1, 2, 3, 4, 5, 6, 7, 7]), chunk=25).collect()
    want = dict(zip([1, 2, 3, 4, 5, 6, 7], texts))
    assert len(rows) == 8
    for r in rows:
        assert list(r["ids"]) == sp.encode(want[r["doc_id"]] or "") and r["round_trip"] and r["n_tokens"] == len(r["ids"])


def test_vectors_of_many_lengths(spark):
    """Every length has its own plan; pairs of each are found."""
    from braidseq.llm import embeddings

    rows = [(2 * n + k, [1.0 + 0.001 * k] * (n - 1) + [2.0]) for n in range(2, 40) for k in range(2)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.where("n_links = 1").count() == len(rows)
