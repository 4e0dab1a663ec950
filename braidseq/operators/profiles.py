"""Left-right models from many sequences: a chain of positions for each key, counted in one grouped aggregation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.models import Model


def positions(seqs: DataFrame, key: str) -> DataFrame:
    """key, pos, symbol, n, p, reached, go_on: how often each symbol stands at each position, its share there, how many sequences reach it, and the share of these that go on.

    Weights count where there are any. Null symbols (missing ones) count for reaching only.
    """
    weight = F.col("weight") if "weight" in seqs.columns else F.lit(1.0)
    rows = seqs.select(F.col(key).alias("key"), weight.alias("w"), F.size("obs").alias("size"), F.posexplode("obs").alias("pos", "symbol"))
    # Partial sums by (key, pos, symbol) come before any window, which then holds a row for each symbol.
    n = rows.groupBy("key", "pos", "symbol").agg(F.sum("w").alias("n"), F.sum(F.when(F.col("size") > F.col("pos") + 1, F.col("w")).otherwise(0.0)).alias("more"))
    here = Window.partitionBy("key", "pos")
    d = n.withColumn("reached", F.sum("n").over(here)).withColumn("go_on", F.sum("more").over(here) / F.sum("n").over(here))
    d = d.where("symbol is not null").withColumn("p", F.col("n") / F.sum("n").over(here))
    return d.select("key", "pos", "symbol", "n", "p", "reached", "go_on")


def chain(rows: list[dict], symbols: int, prefix: str = "") -> Model:
    """The model of one key's rows: a state for each position, left for the next or, with what does not go on, for a silent end.

    A position at which only missing symbols stand emits evenly.
    """
    n = 1 + max(r["pos"] for r in rows)
    a, b = np.zeros((n + 1, n + 1)), np.zeros((n + 1, symbols))
    for r in rows:
        b[r["pos"], r["symbol"]] = r["p"]
        a[r["pos"], r["pos"] + 1], a[r["pos"], n] = r["go_on"], 1 - r["go_on"]
    b[:n][b[:n].sum(axis=1) == 0] = 1 / symbols
    a[n - 1] = np.eye(n + 1)[n]
    return Model.of(np.eye(n + 1)[0], a, b, names=(*[f"{prefix}{i}" for i in range(n)], f"{prefix}end"))


def chains(seqs: DataFrame, key: str, symbols: int) -> dict:
    """A chain for each key. The rows come key by key; what is held is one key's chain more than the result."""
    out, own, at = {}, [], None
    for r in positions(seqs, key).orderBy("key", "pos", "symbol").toLocalIterator():
        if own and r["key"] != at:
            out[at] = chain(own, symbols)
            own = []
        at = r["key"]
        own.append(r.asDict())
    if own:
        out[at] = chain(own, symbols)
    return out
