"""The corpus pipeline: stages that each work on all the documents that their predecessor kept.

Toxic documents go; of each group of near-duplicates one document stays; personal data is replaced by its kind;
sources are mixed to their target weights (a document comes once for each pass that takes words of it); the mix is
encoded to SentencePiece ids, decoded again and compared.
"""

from __future__ import annotations

from braidseq.llm import minhash, mixing, pii, sentencepiece_scan, toxicity
from braidseq.llm.common import table, written


def detoxify(spark, docs, sf_dir):
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark, docs, sf_dir):
    return minhash.deduplicated(docs, words=5, percent=80)


def redact(spark, docs, sf_dir):
    return pii.redacted(docs)


def mix(spark, docs, sf_dir):
    return mixing.mixed_documents(docs)


def tokenize(spark, docs, sf_dir):
    return sentencepiece_scan.encode(docs)


STAGES = [("toxicity", detoxify), ("minhash", deduplicate), ("pii", redact), ("mixing", mix), ("sentencepiece", tokenize)]

#: Models, sketches and tokens are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
