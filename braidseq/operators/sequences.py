"""Sequence tables: seq_id, weight, label, obs (array of symbols or values in order)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build(rows: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """One row per key: seq_id, weight 1, obs in the given order. Nulls of value are kept in their places."""
    item = F.struct(*order, value.alias("_v"))
    got = rows.groupBy(F.col(key).alias("seq_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return got.select("seq_id", F.lit(1.0).alias("weight"), F.transform("items", lambda x: x["_v"]).alias("obs"))


def check(seqs: DataFrame, symbols: int) -> DataFrame:
    """seqs; a symbol outside 0..symbols-1 is an error."""
    bad = F.exists("obs", lambda x: x.isNull() | (x < 0) | (x >= symbols))
    return seqs.withColumn("obs", F.when(bad, F.raise_error(F.lit("a symbol is out of range"))).otherwise(F.col("obs")))


def profile(seqs: DataFrame) -> DataFrame:
    """n, longest and largest symbol of a set."""
    return seqs.agg(F.count("*").alias("n"), F.max(F.size("obs")).alias("max_len"), F.max(F.array_max("obs")).alias("max_symbol"))


def rounded(seqs: DataFrame) -> DataFrame:
    """Values to the nearest whole number, halves away from zero."""
    return seqs.withColumn("obs", F.transform("obs", lambda x: (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("int")))


def truncated(seqs: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """Each sequence cut to ceil(L (1 - ratio U)) with U from a hash of seq_id; ratio -1 empties."""
    u = F.pmod(F.xxhash64(F.lit(seed), "seq_id"), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(0) if ratio == -1 else F.ceil(F.size("obs") * (1 - ratio * u)).cast("int")
    return seqs.withColumn("obs", F.slice("obs", F.lit(1), keep))


def split(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """rows with part, train or test, by a hash of the key: the same at every run and partitioning."""
    u = F.pmod(F.col(key) % 1000 * (2654435761 % 1000) + seed % 1000, F.lit(1000))  # 2654435761 * key + seed, within a long for any key
    return rows.withColumn("part", F.when(u < share * 1000, "train").otherwise("test"))


def by_position(seqs: DataFrame, most: int | None = None) -> DataFrame:
    obs = F.slice("obs", F.lit(1), F.lit(most)) if most else F.col("obs")
    return seqs.select("seq_id", "weight", F.posexplode(obs).alias("pos", "x"))


def mean_sequence(seqs: DataFrame, most: int | None = None) -> DataFrame:
    """pos, mean over all sequences of the set (those too short count as 0), and n that reach the position."""
    n = seqs.agg(F.count("*").alias("all"))
    sums = by_position(seqs, most).groupBy("pos").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return sums.crossJoin(F.broadcast(n)).select("pos", (F.col("s") / F.col("all")).alias("mean"), "n")


def scatter(seqs: DataFrame, most: int | None = None) -> DataFrame:
    """i, j, s, n: sums of products of deviations from the positions' own means, over sequences that reach both.

    Nulls (and NaN) count in n only. A task sums its sequences' products in tiles of positions, of which it holds a bounded number.
    """
    means = by_position(seqs, most).groupBy("pos").agg(F.avg("x").alias("m"))
    m = F.broadcast(means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("means")))
    obs = F.slice("obs", 1, most) if most else F.col("obs")
    dev = seqs.crossJoin(m).select(F.transform(obs, lambda x, i: x - F.get("means", i)).alias("obs"))
    parts = dev.mapInPandas(_products, "i int, j int, s double, known long, n long")
    return parts.groupBy("i", "j").agg(F.when(F.sum("known") > 0, F.sum("s")).alias("s"), F.sum("n").alias("n"))


def _products(frames, tile: int = 256, held: int = 64):
    """Sums of products, products without nulls and sequences, of each two positions."""
    from .hmm import padded

    sums: dict = {}

    def out():
        for (a, b), (s, known, n) in sums.items():
            i, j = np.nonzero(n)
            yield pd.DataFrame({"i": a + i, "j": b + j, "s": s[i, j], "known": known[i, j].astype(int), "n": n[i, j].astype(int)})
        sums.clear()

    for frame in frames:
        for _, x, lengths in padded(frame):
            reach = (np.arange(x.shape[1])[None] < lengths[:, None]).astype(float)
            known = np.where(np.isnan(x), 0, reach)
            x = np.where(known > 0, x, 0)
            for a in range(0, x.shape[1], tile):
                for b in range(0, x.shape[1], tile):
                    long = slice(int(np.searchsorted(lengths, max(a, b), "right")), None)  # they come in order of length
                    part = np.stack([z[long, a : a + tile].T @ z[long, b : b + tile] for z in (x, known, reach)])
                    if (a, b) not in sums:
                        if len(sums) >= held:
                            yield from out()
                        sums[a, b] = np.zeros((3, tile, tile))
                    sums[a, b][:, : part.shape[1], : part.shape[2]] += part
    yield from out()


def grams(seqs: DataFrame, k: int) -> DataFrame:
    """Runs of k consecutive symbols and how often."""
    n = F.size("obs") - k + 1
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.slice("obs", i, F.lit(k)))
    return seqs.where(n > 0).select(F.explode(runs).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
