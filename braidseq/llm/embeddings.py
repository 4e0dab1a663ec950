"""Embedding near-dedup by spherical-cap filters.

A filter is a direction of a structured random product code: after a random rotation a vector falls into blocks, each
block has its own random unit codewords, and one codeword per block together are a direction. A vector passes all
filters whose inner product with it exceeds a threshold; they are found by list decoding, block by block, leaving
partial sums that the other blocks' best codewords cannot lift over it. Threshold and codewords follow the number of
vectors, so that a filter is passed by about `occupancy` of unrelated vectors and a vector passes about `passes`,
at any size; one that passes fewer takes the nearest beyond. Vectors meet in filters and are verified there by their exact cosine in double precision. Equal vectors
are one class and meet others once. A pair counts in the first filter that both pass, so links are counted once.
A filter that many vectors pass is split into blocks, and every two blocks meet in a task of their own.

Two independent codes leave pairs at 0.95 with no common filter at well under one in 10,000 (measured in tests).

Vectors that are null, zero, or hold nulls or components that are not finite link with nothing. Vectors of different
lengths do not link. A null vec_id keeps its row and links with nothing. Repeated rows count as vectors of their own.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain
from math import erfc, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, components, settle, shuffle_parts

#: Rows of one filter that meet in one task; more are split into blocks of about so many.
SPLIT = 1500


@lru_cache(8)
def code(dim: int, blocks: int, words: int, number: int):
    """Rotation and codewords (blocks, each words x its width) of a code, from its numbers alone."""
    rng = np.random.default_rng([dim, blocks, words, number])
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    edges = np.linspace(0, dim, blocks + 1).astype(int)
    parts = []
    for a, b in zip(edges[:-1], edges[1:]):
        c = rng.normal(size=(words, b - a))
        parts.append((a, b, c / np.linalg.norm(c, axis=1, keepdims=True) / sqrt(blocks)))
    return rotation, parts


@lru_cache(1000)
def plan(n: int, dim: int, passes: int, occupancy: int) -> tuple[float, int, int]:
    """Threshold, blocks and codewords per block for n vectors."""
    share = min(0.25, occupancy / max(n, 1))
    lo, hi = 0.0, 38.0
    for _ in range(80):
        t = (lo + hi) / 2
        lo, hi = (t, hi) if 0.5 * erfc(t / sqrt(2)) > share else (lo, t)
    filters = passes / share
    blocks = 2 if dim >= 2 else 1
    while filters ** (1 / blocks) > 1024 and blocks < dim // 4:
        blocks += 1
    return min(t / sqrt(dim), 0.9), blocks, max(2, int(np.ceil(filters ** (1 / blocks))))


def decoded(v: np.ndarray, dim: int, threshold: float, blocks: int, words: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and filter of all inner products of unit vectors v that reach the threshold."""
    rotation, parts = code(dim, blocks, words, number)
    r = v @ rotation
    sums = [r[:, a:b] @ c.T for a, b, c in parts]
    best = np.cumsum([s.max(axis=1) for s in sums[::-1]], axis=0)[::-1]
    row, path, total = np.arange(len(v)), np.zeros(len(v), np.int64), np.zeros(len(v))
    for i, s in enumerate(sums):
        rest = best[i + 1][row] if i + 1 < blocks else 0.0
        at, word = np.nonzero(total[:, None] + s[row] >= (threshold - rest - 1e-12)[:, None] if i + 1 < blocks else total[:, None] + s[row] >= threshold)
        total = total[at] + s[row[at], word]
        row, path = row[at], path[at] * words + word
    return row, path


def passing(v: np.ndarray, dim: int, threshold: float, blocks: int, words: int, number: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """decoded, with the threshold lowered for vectors that lie far from all directions until they pass `least` filters."""
    row, path = decoded(v, dim, threshold, blocks, words, number)
    few = np.flatnonzero(np.bincount(row, minlength=len(v)) < least)
    rows, paths = [row], [path]
    for _ in range(40):
        if not len(few) or words**blocks < least:
            break
        threshold -= 0.04
        row, path = decoded(v[few], dim, threshold, blocks, words, number)
        n = np.bincount(row, minlength=len(few))
        done = (n >= least)[row]
        rows.append(few[row[done]])
        paths.append(path[done])
        few = few[n < least]
    row, path = np.concatenate(rows), np.concatenate(paths)
    both = np.unique(np.stack([row, path]), axis=1)
    return both[0], both[1]


def _matrix(blobs, dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), dtype).reshape(len(blobs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each one's component, by repeated minima."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(vectors: DataFrame, cosine: float = 0.95, codes: int = 2, passes: int = 10, occupancy: int = 96) -> DataFrame:
    """vec_id, n_links (other vectors at the cosine or more), component_id (smallest vec_id reachable), kept (vec_id is that)."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding" if kind == "float" else F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("fit", F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull())
    classes = rows.where("fit").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = settle(classes)
    # How many vectors of its length there are goes with each vector, so that there may be any number of lengths.
    lengths = classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("peers"))
    counted = classes.withColumn("dim", F.size("embedding")).join(lengths, "dim").drop("dim")

    def decode(frames):
        for frame in frames:
            blobs = [np.asarray(e, dtype).tobytes() for e in frame["embedding"]]
            size = np.array([len(b) // np.dtype(dtype).itemsize for b in blobs])
            out = [[] for _ in blobs]
            for dim in np.unique(size).tolist():
                which = np.flatnonzero(size == dim)
                peers = int(frame["peers"].iloc[which[0]])
                if peers < 2:
                    continue
                threshold, blocks, words = plan(peers, dim, passes, occupancy)
                for at in np.array_split(which, max(1, len(which) // 256)) if len(which) else []:
                    v = _matrix([blobs[i] for i in at], dtype)
                    for number in range(codes):
                        row, path = passing(v, dim, threshold, blocks, words, number, passes)
                        names = (path * codes + number) % (2**31 - 1)
                        for i, f in zip(row, names):
                            out[at[i]].append(f)
            names = [np.unique(np.array(f, np.int32)) for f in out]
            yield pd.DataFrame({"rep": frame["rep"], "copies": frame["copies"], "dim": size, "vector": blobs, "filters": names})

    passed = settle(counted.mapInPandas(decode, "rep long, copies long, dim int, vector binary, filters array<int>"))
    cells = passed.withColumn("filter", F.explode("filters"))
    wide = settle(cells.groupBy("dim", "filter").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT))
    cells = cells.join(F.broadcast(wide) if wide.count() <= BROADCAST_ROWS else wide, ["dim", "filter"], "left")
    parts = F.coalesce(F.ceil(F.col("n") / SPLIT), F.lit(1)).cast("int")
    cells = cells.withColumn("own", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = cells.select("dim", "filter", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "own", "rep", "copies", "vector", "filters")
    cells = cells.repartition(shuffle_parts(vectors), "dim", "filter", "i", "j").sortWithinPartitions("dim", "filter", "i", "j")

    def group(g: pd.DataFrame):
        v, own = _matrix(list(g["vector"]), dtype), g["own"].to_numpy()
        one, i, j = int(g["filter"].iloc[0]), g["i"].iloc[0], g["j"].iloc[0]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = np.nonzero(v[left] @ v[right].T >= cosine)
        a, b = left[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        if not len(a):
            return None
        root = _roots(len(g), a, b)
        # The pair counts here if no earlier filter holds both.
        filters = list(g["filters"])
        before = [f[f < one] for f in filters]
        if any(map(len, before)):
            used = np.unique(np.concatenate([a, b]))
            names, place = np.unique(np.concatenate([before[k] for k in used]), return_inverse=True)
            member = np.zeros((len(g), len(names)), np.float32)
            member[np.repeat(used, [len(before[k]) for k in used]), place] = 1
            first = np.concatenate([(member[a[k : k + 4096]] * member[b[k : k + 4096]]).sum(axis=1) == 0 for k in range(0, len(a), 4096)])
        else:
            first = np.ones(len(a), bool)
        copies = g["copies"].to_numpy()
        links = np.bincount(a[first], weights=copies[b[first]], minlength=len(g)) + np.bincount(b[first], weights=copies[a[first]], minlength=len(g))
        at = np.unique(np.concatenate([a, b]))
        rep = g["rep"].to_numpy()
        return pd.DataFrame({"rep": rep[at], "root": rep[root[at]], "links": links[at].astype(np.int64)})

    def verify(frames):
        held = None
        for frame in chain(frames, [None]):
            if frame is not None:
                held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if held is None or not len(held):
                continue
            key = held[["dim", "filter", "i", "j"]].to_numpy()
            edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            edge = np.concatenate([[0], edge, [len(held)] if frame is None else []]).astype(int)
            got = [x for x in (group(held.iloc[s:e]) for s, e in zip(edge[:-1], edge[1:]) if e - s > 1) if x is not None]
            if got:
                yield pd.concat(got)
            held = held.iloc[edge[-1] :].reset_index(drop=True)

    met = settle(cells.mapInPandas(verify, "rep long, root long, links long"))
    degree = met.groupBy("rep").agg(F.sum("links").alias("links"))
    label = components(met, "rep", "root").withColumnRenamed("node", "rep")
    classes = classes.join(degree, "rep", "left").join(label, "rep", "left")
    classes = classes.select(F.col("embedding").alias("_e"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.where("fit").join(classes, F.col("embedding") == F.col("_e")).select("vec_id", "n_links", "component_id")
    none = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

