"""Seeds of repeats: winnowed anchors of texts, and what their groups already decide.

A window is `length` consecutive units of a document (words or bytes). Its anchor is the k-gram of least hash in it,
the leftmost of equals, so equal windows have equal anchors at equal places. Anchors are far fewer than windows; the
windows of one occurrence of an anchor are consecutive and span its context. Occurrences of one anchor whose whole
contexts agree are a class: all their windows repeat. Only where an anchor has occurrences of several classes can
windows repeat that the classes do not show; those occurrences are open, and are settled window by window.

Batches of texts fold their own copies first: a class sends one row per batch, and an anchor that already has several
classes in a batch sends its open rows elsewhere and one witness, so no anchor, however common, gathers more rows in
one task than twice the number of batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts
from .units import U, batches, grams, mix

BITS = 22
_STEP = U(0xD1342543DE82EF95)
_UNSTEP = U(pow(0xD1342543DE82EF95, -1, 2**64))
_TABLES: dict = {}
SEED = "h long, c long, d long, p int, m int, whole boolean, open boolean, witness boolean"


def _powers(n: int, base: np.uint64) -> np.ndarray:
    if len(_TABLES.get(base, ())) < n:
        with np.errstate(over="ignore"):
            _TABLES[base] = np.concatenate([[U(1)], np.multiply.accumulate(np.full(2 * n, base, U))])
    return _TABLES[base][:n]


class Ranges:
    """Hashes of any ranges of a sequence of units."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[U(0)], np.add.accumulate(units * _powers(n, _STEP))])
            self.back = _powers(n + 1, _UNSTEP)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(U))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    have, m = 1, x
    while 2 * have <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (w - have)], m[w - have :]) if have < w else m


def anchors(units: np.ndarray, first: np.ndarray, length: int, k: int, gram_hashes=grams):
    """Of texts i with units first[i]:first[i+1]: text, gram hash, context hash, first window (place in the text), number of windows of each anchor occurrence."""
    n = len(units) - length + 1
    sizes = np.maximum(np.diff(first) - length + 1, 0)
    if n <= 0 or not sizes.any():
        return [np.empty(0, t) for t in (np.int64, U, U, np.int64, np.int64)]
    assert len(units) < 1 << BITS
    g = gram_hashes(units, k)
    low = U((1 << BITS) - 1)
    at = (sliding_min((g & ~low) | np.arange(len(g), dtype=U), length - k + 1) & low).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    window = np.arange(len(text)) - np.repeat(starts, sizes) + np.repeat(first[:-1], sizes)
    at = at[window]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    i = np.flatnonzero(new)
    count = np.diff(np.concatenate([i, [len(text)]]))
    lo, a, text = window[i], at[i], text[i]
    with np.errstate(over="ignore"):
        c = mix(Ranges(units).of(lo, lo + count - 1 + length) + (a - lo).astype(U) * _STEP)
    return text, g[a], c, lo - first[:-1][text], count


def folded(d, h, c, p, m, unique: bool) -> pd.DataFrame:
    """The rows that a batch sends on. unique: only windows that occur nowhere else stay; else the first of each does."""
    o = np.lexsort((p, d, c, h))
    d, h, c, p, m = d[o], h[o], c[o], p[o], m[o]
    new_h = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.empty(0, bool)
    new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]]) if len(h) else new_h
    class_of = np.cumsum(new_c) - 1
    again = np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1])]) if len(h) else new_h
    several = np.bincount(class_of, weights=again | new_c)[class_of] > 1 if len(h) else new_h
    group = np.cumsum(new_h) - 1
    many = np.bincount(group, weights=new_c)[group] > 1 if len(h) else new_h
    lead = np.flatnonzero(new_c)[class_of] if len(h) else class_of
    whole = several if unique else (d != d[lead]) | (p != p[lead])
    # Rows after a class's first are settled; the first stands for all in the anchor's group.
    part = pd.DataFrame({"h": h, "c": c, "d": d, "p": p, "m": m, "whole": whole, "open": many & new_c, "witness": False})
    own = mix(d.view(U) * _STEP + p.astype(U) if len(d) else np.empty(0, U))
    part["h"] = np.where(new_c & ~many, h, own)
    keep = new_c | whole
    seen = part[new_h & many].assign(h=h[new_h & many], witness=True, whole=False, open=False)
    out = pd.concat([part[keep], seen])
    return out.assign(h=out["h"].to_numpy(U).view(np.int64), c=out["c"].to_numpy(U).view(np.int64), p=out["p"].astype(np.int32), m=out["m"].astype(np.int32))


def seeds(docs: DataFrame, units_of, length: int, k: int, unique: bool, gram_hashes=grams, batch: int = 1_000_000) -> DataFrame:
    """Of docs (d, text): anchor occurrences that matter: d, p (first window), m (windows), whole (they all repeat), open (they may).

    units_of(texts) gives the units of a list of texts and where each text's begin. A text of more units than a batch
    holds goes through in overlapping parts, so that every window is in one of them.
    """
    room = (1 << BITS) - 1
    if length - k + 1 >= 1024:
        raise ValueError("an anchor may have at most 1023 windows: length - k must be less than 1023")

    def run(frames):
        for frame in frames:
            for at in batches(frame["text"], batch):
                part = frame.iloc[at]
                units, first = units_of(list(part["text"]))
                ids = part["d"].to_numpy(np.int64)
                cuts = [0]
                while cuts[-1] < len(ids):  # as many whole texts as there is room for, one at least
                    cuts.append(max(cuts[-1] + 1, int(np.searchsorted(first, first[cuts[-1]] + room, "right")) - 1))
                for x, y in zip(cuts[:-1], cuts[1:]):
                    lo, hi = first[x], first[y]
                    got = []
                    for s in range(lo, max(hi, lo + 1), room - length):
                        e = min(hi, s + room - 1)
                        local = np.clip(first[x : y + 1], s, e) - s
                        t, h, c, p, m = anchors(units[s:e], local, length, k, gram_hashes)
                        got.append((ids[x + t], h, c, p + np.maximum(s - first[x + t], 0), m))
                        if e == hi:
                            break
                    yield folded(*[np.concatenate(z) for z in zip(*got)], unique)

    rows = docs.mapInPandas(run, SEED).repartition(shuffle_parts(docs), "h")
    same = Window.partitionBy("h", "c").orderBy("witness", "d", "p")
    group = Window.partitionBy("h")
    rows = rows.withColumn("nth", F.row_number().over(same))
    if unique:
        both = Window.partitionBy("h", "c")
        rows = rows.withColumn("several", F.max("whole").over(both) | (F.min(F.struct("d", "p")).over(both) != F.max(F.struct("d", "p")).over(both)))
    rows = rows.withColumn("many", (F.min("c").over(group) != F.max("c").over(group)) | F.max("witness").over(group)).where("not witness")
    if unique:
        rows = rows.withColumn("whole", F.col("whole") | F.col("several")).withColumn("open", F.col("open") | (F.col("many") & (F.col("nth") == 1)))
    else:
        first = F.min(F.struct("d", "p")).over(Window.partitionBy("h", "c"))
        rows = rows.withColumn("whole", F.col("whole") | (F.struct("d", "p") != first)).withColumn("open", ~F.col("whole") & (F.col("open") | F.col("many")))
    return rows.where("whole or open").select("d", "p", "m", "whole", "open")


def packed(rows: DataFrame) -> DataFrame:
    """d and codes, a long for each of its rows: place, windows, and whether all repeat or may."""
    code = F.col("p").cast("long") * 4096 + F.col("m") * 4 + F.col("whole").cast("int") * 2 + F.col("open").cast("int")
    return rows.groupBy("d").agg(F.collect_list(code).alias("codes"))


def unpacked(codes, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of windows of the codes that have the bit (2: whole, 1: open)."""
    c = np.asarray(codes if codes is not None else [], np.int64)
    c = c[(c & bit) > 0]
    return c >> 12, (c >> 2) & 1023


def covered(n: int, length: int, codes, windows) -> np.ndarray:
    """Which of n units are in a repeated window: those of whole codes, and windows that begin at the given places."""
    edge = np.zeros(n + 1, np.int64)
    p, m = unpacked(codes, 2)
    w = np.asarray(windows if windows is not None else [], np.int64)
    lo, hi = np.concatenate([p, w]), np.concatenate([p + m - 1 + length, w + length])
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge[:-1]) > 0


def with_marks(docs: DataFrame, marks: DataFrame, limit: int) -> list[DataFrame]:
    """docs (d, text) with the columns codes and windows of marks, null where it has none.

    If the marked ids are few enough to broadcast (they are counted), only marked texts are shuffled.
    """
    if marks.count() > limit:
        return [docs.join(marks, "d", "left")]
    ids = F.broadcast(marks.select("d"))
    none = [F.lit(None).cast("array<long>").alias("codes"), F.lit(None).cast("array<long>").alias("windows")]
    return [docs.join(ids, "d", "left_semi").join(marks, "d"), docs.join(ids, "d", "left_anti").select("*", *none)]
