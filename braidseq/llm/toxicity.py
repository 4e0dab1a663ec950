"""Toxicity by the nearest labelled examples, exact by TF-IDF cosine over a block-max inverted index.

Terms are lower-case words without outer punctuation and their first 4, 5 and 6 characters. The vocabulary is chosen
on the labelled sample: terms whose documents differ between the classes by a chi-square test (all terms, where no term passes it). Their document
frequencies are counted over all documents. Examples are vectors of log(1 + tf) * idf of unit length, sorted so that
like ones share a block; the index keeps postings per block and term and each block's greatest weights. A document's
blocks are visited in order of their bounds until none can enter its nearest k. Neighbours vote by the square of their
cosine; the vote is calibrated by a logistic fit to the examples' own leave-one-out votes, weighted to the classes'
true shares. A document without any term of the vocabulary scores as the least vote does.

Learns from at most `per_class` labelled rows of each class (a bounded sample), never from the held-out fold.
Nulls and empty texts have no terms and score low. Repeated rows score alike. Very long texts are taken whole. If a
class has no example, every score is 0. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, settle
from .labelled import Lookup, held_out, sample

_OUTER = ".,;:!?\"'()[]{}*#&%$|-_…«»„“”"
NEIGHBOURS, BLOCK, GROUP = 15, 64, 8


def terms_of(word: str) -> tuple[str, ...]:
    w = word.strip(_OUTER)
    return (w, *(f"{w[:n]}*" for n in (4, 5, 6) if len(w) > n)) if w else ()


def _terms(text: str | None, lookup) -> Counter:
    """Term numbers and how often."""
    out = Counter()
    for got, n in Counter(filter(None, map(lookup.__getitem__, (text or "").lower().split()))).items():
        for t in got:
            out[t] += n
    return out


def finder(vocabulary: dict[str, int]):
    """What gives the numbers, in order, of a word's terms that are in the vocabulary."""
    words = {t: i for t, i in vocabulary.items() if not t.endswith("*") or len(t) not in (5, 6, 7)}
    heads = [(n, {t[:-1]: i for t, i in vocabulary.items() if t.endswith("*") and len(t) == n + 1}) for n in (4, 5, 6)]

    def known(word: str) -> tuple[int, ...]:
        w = word.strip(_OUTER)
        size = len(w)
        found = [words[w]] if w in words else []
        for n, head in heads:
            if size <= n:
                break
            if (start := w[:n]) in head:
                found.append(head[start])
        return tuple(sorted(found))

    return known


class Index:
    """The examples by block and term. Arrays only, so it goes to executors as it is."""

    def __init__(self, vectors: list[dict[int, float]], y: np.ndarray, ids: np.ndarray, n_terms: int):
        # Like examples side by side: by class, then by their heaviest terms.
        lead = [tuple(t for t, _ in sorted(v.items(), key=lambda x: (-x[1], x[0]))[:3]) for v in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (y[i], lead[i], ids[i]))
        self.y, self.ids = y[order].astype(np.float64), ids[order]
        self.n, self.blocks, self.n_terms = len(order), -(-len(order) // BLOCK), n_terms
        rows = [(i // BLOCK, t, i, w) for i, v in enumerate(vectors[j] for j in order) for t, w in v.items()]
        rows.sort()
        key = np.array([b * n_terms + t for b, t, _, _ in rows], np.int64)
        self.doc, self.weight = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows])
        self.begin = np.searchsorted(key, np.arange(self.blocks * n_terms + 1))
        self.most = np.zeros((n_terms, self.blocks))
        np.maximum.at(self.most, (key % n_terms, key // n_terms), self.weight)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples (numbers) and cosines of the k nearest with a cosine above 0; equal ones in order. but: an example left out."""
        bound = weights @ self.most[terms]
        by = np.argsort(-bound, kind="stable")
        near, score = np.empty(0, np.int64), np.empty(0)
        for g in range(0, len(by), GROUP):
            blocks = by[g : g + GROUP]
            if bound[blocks[0]] <= 0 or (len(near) >= k and bound[blocks[0]] < score[-1] - 1e-12):
                break
            cell = blocks[:, None] * self.n_terms + terms[None, :]
            lo, size = self.begin[cell].ravel(), (self.begin[cell + 1] - self.begin[cell]).ravel()
            at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
            # Scores of the visited blocks alone, one block after the other.
            base = np.repeat(np.arange(len(blocks)) - blocks, len(terms)) * BLOCK
            here = np.bincount(self.doc[at] + np.repeat(base, size), np.repeat(np.tile(weights, len(blocks)), size) * self.weight[at], len(blocks) * BLOCK)
            if but >= 0:
                here[(blocks[np.arange(len(here)) // BLOCK] * BLOCK + np.arange(len(here)) % BLOCK) == but] = 0
            good = np.flatnonzero(here > 0 if len(near) < k else here >= score[-1])
            near, score = np.concatenate([near, blocks[good // BLOCK] * BLOCK + good % BLOCK]), np.concatenate([score, here[good]])
            order = np.lexsort((near, -score))[:k]
            near, score = near[order], score[order]
        return near, score

    def vote(self, at: np.ndarray, cosines: np.ndarray) -> float:
        w = cosines**2 * np.where(self.y[at] == 1, self.weigh[1], self.weigh[0])
        return float((w * self.y[at]).sum() / w.sum()) if len(at) else 0.0


def _vector(counts: Counter, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms = np.fromiter(counts, np.int64, len(counts))
    w = np.log1p(np.fromiter(counts.values(), np.float64, len(counts))) * idf[terms]
    return terms, w / max(float(np.sqrt((w * w).sum())), 1e-12)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept, by Newton steps with a slight ridge."""
    a = np.stack([x, np.ones_like(x)], 1)
    c = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([0.5, 1e-3]), a.T @ (weight * (y - p)) - np.array([0.5, 1e-3]) * c)
        c = c + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(c[0]), float(c[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, least: int = 3, chi2: float = 10.83):
    """(vocabulary, idf, index) or None if a class has no example."""
    chosen, counts = sample(docs, labels, "toxic", per_class)

    def bags(frames):
        for frame in frames:
            lookup = Lookup(terms_of)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["y"], "terms": [list(_terms(t, lookup)) for t in frame["text"]]})

    bag = chosen.mapInPandas(bags, "doc_id long, y int, terms array<string>").select("y", F.explode("terms").alias("term"))
    n = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    a, b = F.col("a"), F.col("b")
    seen = bag.groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    total = n[0] + n[1]
    num = F.pow(a * (n[0] - b) - b * (n[1] - a), F.lit(2.0)) * total
    test = num / (F.lit(float(n[0] * n[1])) * (a + b) * (F.lit(float(total)) - a - b + 1e-9))
    # As many terms at most as the bounded sample has.
    telling = (a + b >= least) & (test >= chi2)
    terms = seen.where(telling).select("term").orderBy("term").collect()
    # From so few examples that no term can pass the test, all of the sample's terms are taken.
    terms = terms or seen.select("term").orderBy("term").collect()
    if not terms:
        return None
    vocabulary = {r["term"]: i for i, r in enumerate(terms)}
    known = finder(vocabulary)

    def frequencies(frames):
        lookup, df, docs_seen = Lookup(known), np.zeros(len(vocabulary) + 1, np.int64), 0
        for frame in frames:
            for text in frame["text"]:
                got = set().union(*set(map(lookup.__getitem__, (text or "").lower().split())))
                df[list(got)] += 1
                docs_seen += 1
        df[-1] = docs_seen
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": at, "df": df[at]})

    df = np.zeros(len(vocabulary) + 1)
    for r in docs.select("text").mapInPandas(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[r["term"]] = r["df"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def vectors(frames):
        lookup = Lookup(known)
        for frame in frames:
            bags = [_terms(t, lookup) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["y"], "t": [list(x) for x in bags], "n": [list(x.values()) for x in bags]})

    rows = sorted((r for r in chosen.mapInPandas(vectors, "doc_id long, y int, t array<long>, n array<long>").toLocalIterator() if r["t"]), key=lambda r: r["doc_id"])
    made = [dict(zip(*map(np.ndarray.tolist, _vector(Counter(dict(zip(r["t"], r["n"]))), idf)))) for r in rows]
    y = np.array([r["y"] for r in rows])
    index = Index(made, y, np.array([r["doc_id"] for r in rows]), len(vocabulary))
    # The sample has as many of each class as it can; a vote weighs them as all labelled rows have them.
    index.weigh = (counts[0] / n[0] / (counts[0] / n[0] + counts[1] / n[1]), counts[1] / n[1] / (counts[0] / n[0] + counts[1] / n[1]))
    votes = {}
    for v, i in zip(made, (r["doc_id"] for r in rows)):
        own = int(np.flatnonzero(index.ids == i)[0])
        at, cosines = index.nearest(np.array(list(v), np.int64), np.array(list(v.values())), but=own)
        votes[own] = index.vote(at, cosines)
    x = np.array([votes[i] for i in range(index.n)] + [0.0] * (n[0] + n[1] - index.n))
    # Examples without terms vote 0.
    blank = np.array([1.0] * (n[1] - int(index.y.sum())) + [0.0] * (n[0] - int((1 - index.y).sum())))
    truth = np.concatenate([index.y, blank])
    index.scale = _logistic(x * 6 - 3, truth, np.where(truth == 1, index.weigh[1], index.weigh[0]) * 2)
    return vocabulary, idf, index


SCORED = "doc_id long, score double, neighbours array<struct<doc_id:long,cosine:double,toxic:int>>"


def scored(docs: DataFrame, labels: DataFrame, per_class: int = 2000, evidence: int = 3, hashed: bool = False) -> DataFrame:
    """docs' doc_id, score and the nearest examples that speak for it; hashed: text_hash, which tells rows of one doc_id apart."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", *([F.xxhash64("text").alias("text_hash")] if hashed else []))
    model = fit(docs, labels, per_class)
    if model is None:
        return rows.select(*rows.drop("text").columns, F.lit(0.0).alias("score"), F.array().cast("array<struct<doc_id:long,cosine:double,toxic:int>>").alias("neighbours"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(frames):
        vocabulary, idf, index = shared.value
        lookup = Lookup(finder(vocabulary))
        slope, shift = index.scale
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                counts = _terms(text, lookup)
                at, cosines = index.nearest(*_vector(counts, idf)) if counts else (np.empty(0, np.int64), np.empty(0))
                score = 1 / (1 + np.exp(-(slope * (index.vote(at, cosines) * 6 - 3) + shift)))
                near = [(int(index.ids[i]), float(c), int(index.y[i])) for i, c in zip(at[:evidence], cosines)]
                out.append((doc_id, float(score), near))
            got = pd.DataFrame(out, columns=["doc_id", "score", "neighbours"]).astype({"doc_id": "Int64"})
            yield got.assign(text_hash=frame["text_hash"].to_numpy()) if hashed else got

    return rows.mapInPandas(run, SCORED + (", text_hash long" if hashed else ""))


def classified(docs: DataFrame, labels: DataFrame, per_class: int = 2000, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours of every document."""
    d = scored(docs, labels, per_class)
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "neighbours")


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = 2000, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold; all columns. Each row by its own text, whatever its doc_id, null ones too."""
    bad = scored(docs, labels, per_class, hashed=True).where(F.col("score") >= threshold)
    bad = settle(bad.select(F.col("doc_id").alias("_tox_id"), F.col("text_hash").alias("_tox_hash")).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_tox_id")) & (F.xxhash64("text") == F.col("_tox_hash"))
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, same, "left_anti")
