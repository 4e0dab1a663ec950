"""Substring dedup by seed and extend, over words.

Documents meet on winnowed anchors (see `seeds`). Around an anchor the match with an earlier occurrence is extended
both ways: if the whole context agrees, all of the anchor's windows repeat; else each of its windows is held against
the first occurrence of the same words. Consecutive repeated windows are a maximal repeat; its words are removed,
in all documents but where they stand first (smaller doc_id, then earlier start).

Nulls: a null text has no words; a null doc_id counts as the smallest. Empty and short texts lose nothing. Rows of
one doc_id (or none) with different texts are documents of their own, in the order of the texts' hashes; rows that agree in
doc_id and text are one document given twice and get the same result. Very long texts go through in overlapping parts. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seeds
from .common import BROADCAST_ROWS, named, numbered, only, settle
from .units import Words, batches


def _encoded(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _units(texts):
    w = Words(_encoded(texts))
    return w.hash, w.first


def repeats(docs: DataFrame, length: int = 20, k: int = 6, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Of docs (d, text): d, codes (whole runs of windows that also start earlier), windows (single ones), where there are any."""
    marks = settle(seeds.packed(seeds.seeds(docs, _units, length, k, unique=False)))
    opened = marks.where(F.exists("codes", lambda c: c % 2 == 1))

    def windows(frames):
        for frame in frames:
            for at in batches(frame["text"]):
                part = frame.iloc[at]
                w = Words(_encoded(part["text"]))
                hashes = seeds.Ranges(w.hash)
                d, p, h = [], [], []
                for i, (doc, codes) in enumerate(zip(part["d"], part["codes"])):
                    lo, m = seeds.unpacked(codes, 1)
                    starts = np.repeat(lo - np.cumsum(m) + m, m) + np.arange(m.sum())
                    at_word = starts + w.first[i]
                    d.append(np.full(len(starts), doc))
                    p.append(starts)
                    h.append(hashes.of(at_word, at_word + length).view(np.int64))
                yield pd.DataFrame({"w": np.concatenate(h), "d": np.concatenate(d), "p": np.concatenate(p)})

    texts = only(docs, opened, "d", limit).dropDuplicates(["d"]).join(opened, "d")
    single = settle(texts.mapInPandas(windows, "w long, d long, p long"))
    first = single.groupBy("w").agg(F.min(F.struct("d", "p")).alias("first"), F.count("*").alias("n")).where("n > 1").select("w", "first")
    later = single.join(first, "w").where(F.struct("d", "p") > F.col("first")).groupBy("d").agg(F.collect_list("p").alias("windows"))
    return settle(marks.where(F.exists("codes", lambda c: F.floor(c / 2) % 2 == 1)).join(later, "d", "full"))


CUT = "d long, n_words long, n_removed long, kept_sha256 string, kept string"


def cut(docs: DataFrame, length: int = 20, k: int = 6, texts: bool = True, limit: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if texts, kept: the words that stay, joined by one space."""
    docs, names = numbered(docs)
    marks = repeats(docs, length, k, limit)

    def run(frames):
        for frame in frames:
            out = []
            for d, text, codes, windows in zip(frame["d"], frame["text"], frame["codes"], frame["windows"]):
                words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() cuts at ASCII white space
                n = len(words)
                if codes is not None or windows is not None:
                    gone = seeds.covered(n, length, codes, windows)
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(words)
                out.append((d, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if texts else None))
            yield pd.DataFrame(out, columns=["d", "n_words", "n_removed", "kept_sha256", "kept"])

    parts = [p.mapInPandas(run, CUT) for p in seeds.with_marks(docs, marks, limit)]
    out = named(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), names)
    return out if texts else out.drop("kept")
