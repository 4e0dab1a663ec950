"""Ranked lexical search over bit-sliced Bloom signatures, exact.

The index has a Bloom signature for each document, of its terms and of how often they occur: a term is entered once for each
of the frequencies 1, 2, 3, 5, 9, 17, ... that it reaches. Documents of about as many entries form a block, whose signatures
are stored by bit: slice b is a bitmap over the block's documents. And-ing the slices of a term's bits gives the
documents that may hold it, and at which frequency at most; never too few. As the length of each document is kept, the
sum over a query's terms of weight times the most that such a frequency can score bounds the document's score from above.

A search reads the index twice. First the documents of the highest bounds are scored exactly, from their texts; the last
of the best k is a floor for the k-th score. Then every document whose bound reaches the floor is scored exactly; all others are
proven to be out. Weights use exact document frequencies, counted over all documents for the terms of the items.

Nulls: a document or item without terms is not ranked. Rows of one doc_id (or none) with different texts are documents of their own; rows that
agree in both are one document. Different texts of one item_id are ranked as items of their own, under that item_id. Equal scores go by doc_id. Very long texts are taken
whole. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, named, numbered, settle
from .terms import PART_BYTES, Tokens, folded, item_parts, pieces
from .units import U, batches, mix

#: Least bits of a signature for each entry, bits that an entry sets, documents of a block, bits of a block while it is made, bits of a signature (powers of two).
PER_ENTRY, PROBES, BLOCK, CELLS, MOST_BITS = 16, 10, 1024, 1 << 25, 1 << 24
#: Frequencies that are entered: 1, 2, 3, 5, 9, ...; those of one step count as its greatest, the last step has no greatest.
STEPS = (1, *(2**i + 1 for i in range(16)))
INDEX = "docs array<long>, sizes array<long>, bits int, slices binary"


def entries(hashes: np.ndarray, step: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(hashes + U(step) * U(0xD1342543DE82EF95))


def probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places of the bits of each key: (keys, PROBES). The step is odd and bits a power of two, so a key's places differ."""
    low, step = keys & U(0xFFFFFFFF), (keys >> U(32)) | U(1)
    return ((low[:, None] + step[:, None] * np.arange(PROBES, dtype=U)) & U(bits - 1)).astype(np.int64)


def _blocks(docs: list[int], sizes: list[int], keys: list[np.ndarray]):
    """Index rows; documents whose numbers of entries share a power of two go together."""
    kind = np.array([max(len(k) - 1, 7).bit_length() for k in keys])
    for c in np.unique(kind).tolist():
        own = np.flatnonzero(kind == c)
        bits = min(PER_ENTRY << c, MOST_BITS)
        room = max(8, min(BLOCK, CELLS // bits) // 8 * 8)
        for at in range(0, len(own), room):
            some = own[at : at + room]
            grid = np.zeros((-(-len(some) // 8) * 8, bits), bool)
            for i, j in enumerate(some):
                for a in range(0, len(keys[j]), 1 << 16):
                    grid[i, probes(keys[j][a : a + (1 << 16)], bits).ravel()] = True
            slices = np.ascontiguousarray(np.packbits(grid, axis=0, bitorder="little").T)
            yield [docs[j] for j in some], [sizes[j] for j in some], bits, slices.tobytes()


def index(docs: DataFrame) -> DataFrame:
    """Of docs (d, text): blocks of signatures. It does not depend on the queries."""

    def run(frames):
        for frame in frames:
            ids, sizes, keys = [], [], []
            for at in batches(frame["text"]):
                t = Tokens([folded(x) for x in frame["text"].iloc[at]])
                for d, a, b in zip(frame["d"].iloc[at], t.first[:-1].tolist(), t.first[1:].tolist()):
                    if b > a:
                        h, n = np.unique(t.hash[a:b], return_counts=True)
                        ids.append(d)
                        sizes.append(b - a)
                        keys.append(np.concatenate([entries(h[n >= least] if least > 1 else h, s) for s, least in enumerate(STEPS) if least <= n.max()]))
            if ids:
                yield pd.DataFrame(list(_blocks(ids, sizes, keys)), columns=["docs", "sizes", "bits", "slices"])

    return docs.select("d", "text").mapInPandas(run, INDEX)


class Queries:
    """Items as weights of numbered terms, and what scores need of the corpus."""

    def __init__(self, items: list[tuple], n_docs: int, n_terms: int, df: dict[bytes, int]):
        self.n_docs, self.n_terms = n_docs, n_terms
        weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for w, n in df.items()}
        self.terms = sorted(w for w, x in weight.items() if x > 0)
        number = {w: i for i, w in enumerate(self.terms)}
        # What no document holds, or what weighs nothing, adds nothing to any score.
        self.own = [np.array(sorted(number[w] for w in set(data.split()) if w in number), np.int64) for _, data in items]
        self.weight = np.array([weight[w] for w in self.terms], np.float64)
        t = Tokens(self.terms)
        self.hash = t.hash

    def length_part(self, size: int) -> int:
        return 50 + 50 * size * self.n_docs // self.n_terms

    def score(self, q: int, counts: Counter, m: int) -> int:
        total = 0
        for i in self.own[q].tolist():
            tf = counts.get(self.terms[i], 0)
            if tf:
                total += int(self.weight[i]) * (1_000_000_000 * tf // (1000 * tf + 20 * m))
        return total

    def bounds(self, sizes: np.ndarray, bits: int, slices: bytes) -> np.ndarray:
        """(queries, documents of the block): no score is above these. All values are whole numbers below 2**53."""
        n = len(sizes)
        grid = np.frombuffer(slices, np.uint8).reshape(bits, -1)
        m = np.array([self.length_part(int(s)) for s in sizes], np.int64)
        out, before = np.zeros((len(self.own), n)), np.zeros(n)
        alive = np.arange(len(self.terms))
        held = np.full((len(alive), grid.shape[1]), 255, np.uint8)
        for step in range(len(STEPS)):
            at = probes(entries(self.hash[alive], step), bits)
            for i in range(PROBES):
                held &= grid[at[:, i]]
            some = held.any(axis=1)
            alive, held = alive[some], held[some]
            if not len(alive):
                break
            most = STEPS[step + 1] - 1 if step + 1 < len(STEPS) else None
            now = (1_000_000_000 * most // (1000 * most + 20 * m)).astype(np.float64) if most else np.full(n, 1e6)
            row = np.full(len(self.terms), -1)
            row[alive] = np.arange(len(alive))
            for q, own in enumerate(self.own):
                r = row[own]
                use = r >= 0
                if use.any():
                    present = np.unpackbits(held[r[use]], axis=1, bitorder="little", count=n)
                    out[q] += (now - before) * (self.weight[own[use]] @ present)
            before = now
        return out


def frequencies(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """How many documents hold each of the words."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # bounded by item_parts

    def run(frames):
        wanted, seen = shared.value, Counter()
        for frame in frames:
            for text in frame["text"]:
                data = folded(text)
                seen.update(set().union(*(wanted.intersection(data[a:b].split()) for a, b in pieces(data))))
        yield pd.DataFrame({"w": list(seen), "n": list(seen.values())})

    rows = docs.select("text").mapInPandas(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {bytes(r["w"]): r["n"] for r in rows.toLocalIterator()}


def _leading(blocks: DataFrame, shared, k: int) -> DataFrame:
    """q, d of the k documents of the highest bounds of each query."""

    def run(frames):
        queries = shared.value
        ids, best = np.zeros((len(queries.own), 0), np.int64), np.zeros((len(queries.own), 0))
        for frame in frames:
            for docs, sizes, bits, slices in zip(frame["docs"], frame["sizes"], frame["bits"], frame["slices"]):
                best = np.concatenate([best, queries.bounds(sizes, bits, slices)], axis=1)
                ids = np.concatenate([ids, np.tile(np.asarray(docs), (len(ids), 1))], axis=1)
                if best.shape[1] > k:
                    top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                    best, ids = np.take_along_axis(best, top, 1), np.take_along_axis(ids, top, 1)
        q, i = np.nonzero(best > 0)
        yield pd.DataFrame({"q": q, "d": ids[q, i], "bound": best[q, i]})

    return _first(blocks.mapInPandas(run, "q int, d long, bound double"), "bound", k).select("q", "d")


def _reaching(blocks: DataFrame, shared, floors: np.ndarray) -> DataFrame:
    """q, d of all documents whose bound reaches the query's floor."""

    def run(frames):
        queries = shared.value
        for frame in frames:
            for docs, sizes, bits, slices in zip(frame["docs"], frame["sizes"], frame["bits"], frame["slices"]):
                bound = queries.bounds(sizes, bits, slices)
                q, i = np.nonzero((bound >= floors[:, None]) & (bound > 0))
                yield pd.DataFrame({"q": q, "d": np.asarray(docs)[i]})

    return blocks.mapInPandas(run, "q int, d long")


def _first(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The k rows of each q that are highest by a column, then lowest by d; first within shares of the rows, so no task has all of a q."""
    for keys in (["q", F.pmod(F.xxhash64("d"), F.lit(64))], ["q"]):
        w = Window.partitionBy(*keys).orderBy(F.col(by).desc(), "d")
        rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return rows


def _scored(docs: DataFrame, pairs: DataFrame, shared, limit: int) -> DataFrame:
    """q, d, score above 0 of pairs (q, d), from the documents' texts. The pairs are broadcast only after a count."""
    wide = settle(pairs.groupBy("d").agg(F.collect_list("q").alias("qs")))  # at most all queries of a part
    few = (wide.agg(F.sum(F.size("qs"))).first()[0] or 0) <= limit

    def run(frames):
        queries = shared.value
        for frame in frames:
            out = []
            for d, text, qs in zip(frame["d"], frame["text"], frame["qs"]):
                data, counts = folded(text), Counter()
                for a, b in pieces(data):
                    counts.update(data[a:b].split())
                m = queries.length_part(counts.total())
                out += [(q, d, s) for q in qs if (s := queries.score(q, counts, m)) > 0]
            yield pd.DataFrame(out, columns=["q", "d", "score"])

    return docs.join(F.broadcast(wide) if few else wide, "d").mapInPandas(run, "q int, d long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, limit: int = BROADCAST_ROWS, most: int = PART_BYTES, blocks: DataFrame | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents of those that score above 0. blocks: an index of docs that was kept (where doc_ids are unique)."""
    docs, names = numbered(docs)
    if names is not None:
        docs = docs.dropDuplicates(["d"])
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    blocks = settle(index(docs)) if blocks is None else blocks
    sums = blocks.agg(F.sum(F.size("docs")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)).alias("l")).first()
    result = None
    for part in item_parts(items, most):
        df = frequencies(docs, {w for _, data in part for w in data.split()}) if sums["n"] else {}
        queries = Queries(part, sums["n"] or 0, sums["l"] or 0, df)
        shared = spark.sparkContext.broadcast(queries)
        lead = settle(_scored(docs, _leading(blocks, shared, k), shared, limit))
        last = lead.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        floors = np.zeros(len(part))
        for r in last.collect():  # a row for each item of the part
            floors[r["q"]] = r["least"]
        best = _first(settle(_scored(docs, _reaching(blocks, shared, floors), shared, limit)), "score", k)
        ids = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(part)], f"q int, item_id {kind}")
        best = best.join(F.broadcast(ids), "q").select("item_id", "rank", "d", "score")
        result = best if result is None else result.unionByName(settle(best))
    return named(result, names).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
