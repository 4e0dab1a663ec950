"""Bootstrapped contexts: patterns that seeds induce find other identifiers, which induce patterns in turn."""

import os

import pytest

from braidseq.llm import pii

SF = "/root/testdata/sf0.01"


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def found(spark, texts):
    return {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("context")] for r in pii.report(table(spark, texts)).collect()}


def test_patterns_chain_over_rounds(spark):
    texts = [f"host id is 10.0.0.{k} here" for k in range(3)]  # seeds induce "id is"
    texts += [f"host id is ab{k}cd7 here" for k in range(4)]  # found in the first round
    texts += [f"badge: ab{k}cd7 shown" for k in range(4)]  # these induce "badge :"
    texts += ["badge: zz99yy1 shown", "release zz77 of 2024a1b here", "the model is ab12xy9", "Version 4.0", None, ""]
    got = found(spark, texts)
    for k in range(4):
        a = texts[3 + k].index(f"ab{k}cd7")
        assert got[3 + k] == [(a, a + 6)]
        a = texts[7 + k].index(f"ab{k}cd7")
        assert got[7 + k] == [(a, a + 6)]
    assert got[11] == [(7, 14)]  # only the second round's pattern leads there
    assert all(not got[i] for i in (0, 1, 2, 12, 13, 14, 15, 16))


def test_common_contexts_are_not_confident(spark):
    texts = [f"go to 10.1.1.{k} now" for k in range(5)] + [f"go to town now go to bed now" for k in range(20)] + ["go to abc1234 now"]
    assert not any(found(spark, texts).values())


def test_machine_made_strings_need_a_pattern(spark):
    secret = ["b7db7aa4a5fcc78305", "7602ad27cf5550de1c", "531ccd051a92ebcb68"]
    texts = [f"word password={s} more" for s in secret] + ["some password=hunter22 more", "lone 24be64439e3e49cf46b2d7c90f3602a3d0b907ff stands"]
    got = found(spark, texts)
    assert all(len(got[i]) == 1 for i in range(4)) and not got[4]
    keys = [f"near words AKIA{s} of" for s in ("MD62HKU6VBLCCCCE", "W4UCRDTZDYKZN4BD", "CXBNCR5D3J4ABGLK")]
    assert all(len(x) == 1 for x in found(spark, keys).values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_tokens_of_the_given_documents(spark):
    """Every quoted token of the given table is found, and nothing else."""
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = {(d, m.start(1), m.end(1)) for d, t in texts.items() for p in (r'token = "([0-9a-f]{40})"', r"password=([0-9a-f]{18})", r"\b(AKIA[A-Z0-9]{16})\b") for m in re.finditer(p, t)}
    got = {(r["doc_id"], *map(int, x.split(":")[1:])) for r in pii.report(docs).collect() for x in r["spans"].split(",") if x.startswith("context")}
    assert len(want) > 10
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)
