"""Benchmark decontamination: windows of terms of the test items, looked for in every document.

The items' windows go to every task as a hash table (an item of fewer terms than a window has is one window). A task
hashes all windows of its documents, looks them up, compares the hits term by term and marks the terms that any
occurrence covers. Then spans or whole documents are removed. One narrow pass, no shuffle. The items' texts are summed
before they are broadcast; where they exceed `most` bytes they go in parts, a pass for each, and a document's marks are
put together in a shuffle of marks.

Nulls: a null text has no terms, in documents and items; an item without an item_id counts under the empty name. Items of
one item_id are one item. Rows with a null or shared doc_id are looked at one by one. Rows given twice give two rows. Very long texts are hashed in
pieces but matched whole. Extra columns are kept by `decontaminated` and ignored by `report`. Empty tables give an empty result and no marks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, settle, sha256
from .terms import PART_BYTES, Tokens, folded, item_parts
from .units import U, batches, grams

_BITS = 22


class Windows:
    """Windows of items by hash: arrays sorted by hash, for each number of terms that a window has."""

    def __init__(self, items: list[tuple], length: int):
        self.names = ["" if i is None else str(i) for i, _ in items]
        t = Tokens([data for _, data in items])
        sizes = np.diff(t.first)
        self.tokens, self.by = t, {}
        for k in sorted(set(np.minimum(sizes[sizes > 0], length).tolist())):
            own = np.flatnonzero(sizes >= length) if k == length else np.flatnonzero(sizes == k)
            n = sizes[own] - k + 1
            at = np.repeat(t.first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            h, item = grams(t.hash, k)[at], np.repeat(own, n)
            order = np.argsort(h, kind="stable")
            maybe = np.zeros(1 << _BITS, bool)
            maybe[h >> U(64 - _BITS)] = True
            self.by[k] = (h[order], at[order], item[order], maybe)

    def marks(self, t: Tokens) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Whether each term is in an occurrence, and the (text, item) pairs of all occurrences."""
        edge, found, known = np.zeros(len(t.hash) + 1, np.int64), set(), {}
        for k, (hashes, places, item, maybe) in self.by.items():
            g = grams(t.hash, k)
            at = np.flatnonzero(maybe[g >> U(64 - _BITS)])
            lo, hi = np.searchsorted(hashes, g[at]), np.searchsorted(hashes, g[at], "right")
            text = np.searchsorted(t.first, at, "right") - 1
            real = (hi > lo) & (at + k <= t.first[text + 1])
            for p, d, a, b in zip(at[real].tolist(), text[real].tolist(), lo[real].tolist(), hi[real].tolist()):
                words = t.words(p, p + k)
                if known.get((d, a)) != words:  # a window that comes again in a text adds no items
                    same = [int(item[i]) for i in range(a, b) if self.tokens.words(places[i], places[i] + k) == words]
                    if not same:
                        continue
                    known[d, a] = words
                    found.update((d, i) for i in same)
                edge[p] += 1
                edge[p + k] -= 1
        return np.cumsum(edge[:-1]) > 0, sorted(found)


FOUND = "doc_id long, text_hash long, n_words long, hit array<int>, items array<string>"


def _scan(docs: DataFrame, items: list[tuple], length: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Windows(items, length))  # bounded by item_parts

    def run(frames):
        windows = shared.value
        for frame in frames:
            for at in batches(frame["text"]):
                part = frame.iloc[at]
                t = Tokens([folded(x) for x in part["text"]])
                inside, found = windows.marks(t)
                items_of: list[list[str]] = [[] for _ in at]
                for d, i in found:
                    items_of[d].append(windows.names[i])
                hit = [np.flatnonzero(inside[a:b]).astype(np.int32) if items_of[i] else [] for i, (a, b) in enumerate(zip(t.first[:-1], t.first[1:]))]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(object), "text_hash": part["text_hash"].to_numpy(), "n_words": np.diff(t.first), "hit": hit, "items": items_of}).astype({"doc_id": "Int64"})

    return docs.mapInPandas(run, FOUND)


def found(docs: DataFrame, items: DataFrame, length: int = 10, most: int = PART_BYTES) -> DataFrame:
    """doc_id, text_hash, n_words, hit (places of covered terms), items (names of items with occurrences) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    passes = [_scan(rows, part, length) for part in item_parts(items, most)]
    if len(passes) == 1:
        return passes[0].withColumn("items", F.array_distinct("items"))
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    both = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)  # noqa: E731  a list for each pass and repeated row
    one = every.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.first("n_words").alias("n_words"), both("hit"), both("items"))
    copies = F.explode(F.array_repeat(F.lit(0), (F.col("n") / len(passes)).cast("int")))
    return one.select("doc_id", "text_hash", "n_words", "hit", "items", copies.alias("_copy")).drop("_copy")


def report(docs: DataFrame, items: DataFrame, length: int = 10, most: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    d = found(docs, items, length, most)
    return d.select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha256(F.concat_ws(",", F.sort_array("items"))).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))


def _cut(texts: pd.Series, hits: pd.Series) -> pd.Series:
    out = []
    for text, hit in zip(texts, hits):
        if not len(hit):
            out.append(text)
            continue
        raw = text.encode("utf-8", "surrogatepass")
        t = Tokens([folded(text)])
        hit = np.sort(np.asarray(hit, np.int64))
        new = np.concatenate([[True], np.diff(hit) > 1])
        begin, end, at, kept = t.start[hit[new]], t.end[hit[np.concatenate([new[1:], [True]])]], 0, []
        for a, b in zip(begin.tolist(), end.tolist()):
            kept.append(raw[at:a])
            at = b
        out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass"))
    return pd.Series(out)


def decontaminated(docs: DataFrame, items: DataFrame, length: int = 10, spans: bool = True, most: int = PART_BYTES) -> DataFrame:
    """docs, all columns, with covered spans (from a run's first term to its last) cut from the texts, or without the documents that have any."""
    d = found(docs, items, length, most).where(F.size("hit") > 0)
    d = settle(d.select(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash"), F.col("hit").alias("_hit")).dropDuplicates(["_hit_id", "_hit_hash"]))
    few = d.count() <= BROADCAST_ROWS and (d.agg(F.sum(F.size("_hit"))).first()[0] or 0) <= 16 * BROADCAST_ROWS
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_hit_id")) & (F.xxhash64("text") == F.col("_hit_hash"))
    if not spans:
        return docs.join(F.broadcast(d) if few else d, same, "left_anti")
    both = docs.join(F.broadcast(d) if few else d, same, "left")
    text = F.when(F.col("_hit").isNotNull(), F.pandas_udf(_cut, "string")("text", F.coalesce("_hit", F.array().cast("array<int>")))).otherwise(F.col("text"))
    return both.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
