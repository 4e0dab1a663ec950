"""Interval tables: contig_id, feature_id, idx1, idx2 (from 1, both ends in; idx1 > idx2 is the reverse strand)."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import settle

#: Lengths of short and of long gaps.
SHORT, LONG = (1, 14), (10, None)
#: Intervals of a key, both sides together, that are matched in one task beside other keys.
CROWD = 1000
#: Intervals of a side in a tile of a crowded key; a key of at most a tile is matched in a task.
EDGE = 1 << 14
#: Pairs of a crowded key that are held at a time.
HELD = 1 << 20


def spans(features: DataFrame) -> DataFrame:
    return features.withColumns({"lo": F.least("idx1", "idx2"), "hi": F.greatest("idx1", "idx2"), "reverse": F.col("idx1") > F.col("idx2")})


def length() -> Column:
    return F.abs(F.col("idx1") - F.col("idx2")) + 1


def of_length(features: DataFrame, least: int, most: int | None = None) -> DataFrame:
    return features.where((length() >= least) & ((length() <= most) if most is not None else F.lit(True)))


def within(features: DataFrame, start: int, end: int) -> DataFrame:
    """Features wholly inside start..end."""
    return features.where((F.least("idx1", "idx2") >= start) & (F.greatest("idx1", "idx2") <= end))


def shift(features: DataFrame, delta: int) -> DataFrame:
    return features.withColumns({"idx1": F.col("idx1") - delta, "idx2": F.col("idx2") - delta})


def mirror(features: DataFrame, contig_length: Column) -> DataFrame:
    """Coordinates on the reverse complement of a contig."""
    return features.withColumns({"idx1": contig_length - F.col("idx1") + 1, "idx2": contig_length - F.col("idx2") + 1})


def gaps(features: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gap_start, gap_end between each feature and the furthest end before it; touching and overlapping ones leave none."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    d = spans(features).withColumn("gap_start", before + 1).withColumn("gap_end", F.col("lo") - 1)
    return d.where(F.col("gap_start") <= F.col("gap_end")).select(*keys, "gap_start", "gap_end")


def binned(features: DataFrame, width: int, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """A row for each bin of `width` that an interval touches, so that overlap is an equality of bins."""
    return features.withColumn("bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of intervals (lo, hi) of two tables that share a place, each once: an equi-join on keys and bins, no nested loop.

    All columns; those of the right table are prefixed by r_.
    """
    r = binned(right, width).select(*[F.col(c).alias(f"r_{c}") for c in (*right.columns, "bin")])
    on = [F.col(k) == F.col(f"r_{k}") for k in (*keys, "bin")]
    first = F.greatest(F.floor(F.col("lo") / width), F.floor(F.col("r_lo") / width)) == F.col("bin")
    meet = (F.col("lo") <= F.col("r_hi")) & (F.col("r_lo") <= F.col("hi"))
    return binned(left, width).join(r, on).where(first & meet).drop("bin", "r_bin")


def score() -> Column:
    """Shared length over joint length of a pair."""
    shared = F.least("hi", "r_hi") - F.greatest("lo", "r_lo") + 1
    return shared / (F.greatest("hi", "r_hi") - F.least("lo", "r_lo") + 1)


def _mutual(pairs: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """The pairs that are each other's best by score, ties to the smaller identifiers."""
    mine = Window.partitionBy(*keys, ident).orderBy(F.desc("score"), f"r_{ident}")
    yours = Window.partitionBy(*keys, f"r_{ident}").orderBy(F.desc("score"), ident)
    return pairs.withColumn("a", F.row_number().over(mine)).withColumn("b", F.row_number().over(yours)).where("a = 1 and b = 1").drop("a", "b")


def matched(left: DataFrame, right: DataFrame | None, keys: list[str], ident: str, width: int) -> DataFrame:
    """One to one: pairs that are each other's best by score, ties to the smaller identifiers.

    Without a right table the pairs are of the left one with itself, each once, the smaller identifier on the left.
    """
    pairs = overlaps(left, left if right is None else right, keys, width).withColumn("score", score())
    if right is None:
        pairs = pairs.where(F.col(ident) != F.col(f"r_{ident}"))
    best = _mutual(pairs, keys, ident)
    return best.where(F.col(ident) < F.col(f"r_{ident}")) if right is None else best


def assigned(left: DataFrame, right: DataFrame, keys: list[str], ident: str, width: int) -> DataFrame:
    """One to one: pairs by falling score, ties to the smaller identifiers, each passed over if either side is taken.

    Keys of at most CROWD intervals are matched whole, many in a task (see _matched_here). Larger keys go band by band (see
    _matched_by_bands): only intervals and the pairs of a band are ever held or shuffled. Null keys and identifiers match nothing. `width` is not used.
    """
    both = [d.where(F.col(ident).isNotNull()).dropna(subset=keys) for d in (left, right)]
    crowded = both[0].select(*keys).unionByName(both[1].select(*keys)).groupBy(*keys).count().where(F.col("count") > CROWD).select(*keys)
    crowded = settle(crowded)
    if not crowded.take(1):
        return _matched_here(*both, keys, ident)
    few, many = ([d.join(crowded, keys, how) for d in both] for how in ("left_anti", "left_semi"))
    here = _matched_here(*few, keys, ident)
    return here.unionByName(_matched_by_bands(*many, keys, ident))


def _sides(left: DataFrame, right: DataFrame, keys: list[str], ident: str) -> tuple[DataFrame, str]:
    """The intervals of both tables with their side (0 or 1), and the schema of pairs: keys, ident, lo, hi, r_ident, r_lo, r_hi, score."""
    side = lambda d, k: d.select(*keys, ident, "lo", "hi", F.lit(k).alias("side"))
    rows = side(left, 0).unionByName(side(right, 1))
    kind = dict(rows.dtypes)
    return rows, ", ".join([*(f"`{k}` {kind[k]}" for k in keys), *(f"`{p}{c}` {kind[c]}" for p in ("", "r_") for c in (ident, "lo", "hi")), "score double"])


def _matched_here(left: DataFrame, right: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """assigned for keys of few intervals."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, schema = _sides(left, right, keys, ident)
    rows = rows.repartition(n, *keys).sortWithinPartitions(*keys)

    def match(d):
        d["g"] = d.groupby(keys, sort=False).ngroup()
        a, b = (d[d["side"] == k].drop(columns="side") for k in (0, 1))
        # Rows of the right side are those of the left one's key, in places first to last.
        b = b.sort_values("g", kind="stable")
        of, lo, hi = (b[c].to_numpy() for c in ("g", "lo", "hi"))
        first, last = np.searchsorted(of, a["g"].to_numpy(), "left"), np.searchsorted(of, a["g"].to_numpy(), "right")
        for some in _slices(last - first):
            n = (last - first)[some]
            i = np.repeat(np.arange(some.start, some.stop), n)
            j = np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            meet = (a["lo"].to_numpy()[i] <= hi[j]) & (lo[j] <= a["hi"].to_numpy()[i])
            yield i[meet], j[meet]

    def run(frames):
        held = None
        for frame in chain(frames, [None]):
            rows = held if frame is None else frame if held is None else pd.concat([held, frame], ignore_index=True)
            if rows is None or not len(rows):
                continue
            # The last key may go on in the next batch.
            end = len(rows) if frame is None else int((rows[keys] != rows[keys].iloc[-1]).any(axis=1).to_numpy()[::-1].argmax())
            end = end if frame is None else len(rows) - end if (rows[keys] != rows[keys].iloc[-1]).any(axis=None) else 0
            part, held = rows.iloc[:end].reset_index(drop=True), rows.iloc[end:].reset_index(drop=True)
            if not len(part):
                continue
            found = [np.concatenate(x) if x else np.zeros(0, int) for x in zip(*match(part))] or [np.zeros(0, int)] * 2
            a, b = part[part["side"] == 0], part[part["side"] == 1].sort_values("g", kind="stable")
            yield _best_first(a.iloc[found[0]].reset_index(drop=True), b.iloc[found[1]].reset_index(drop=True), keys, ident)

    return rows.mapInPandas(run, schema)


def _slices(n: np.ndarray, most: int = 1 << 20):
    """Runs of rows whose counts n are `most` in all, or one row."""
    total, at = np.cumsum(n), 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield slice(at, end)
        at = end


def _best_first(a: pd.DataFrame, b: pd.DataFrame, keys: list[str], ident: str) -> pd.DataFrame:
    """Of pairs of overlapping intervals, row by row, those that are taken by falling score; all keys go on together."""
    lo, hi = np.maximum(a["lo"], b["lo"]), np.minimum(a["hi"], b["hi"])
    score = ((hi - lo + 1) / (np.maximum(a["hi"], b["hi"]) - np.minimum(a["lo"], b["lo"]) + 1)).to_numpy(float)
    x, y = (pd.DataFrame({"g": a["g"], "i": d[ident]}).groupby(["g", "i"]).ngroup().to_numpy() for d in (a, b))  # in order of identifiers
    best = np.lexsort((y, x, -score))
    best = best[_taken(x[best], y[best])]
    return _pairs(a.iloc[best], b.iloc[best], score[best], keys, ident)


def _taken(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the pairs (x, y), in their order, of which no side is in a pair taken before."""
    out, xs, ys = [], bytearray(int(x.max(initial=0)) + 1), bytearray(int(y.max(initial=0)) + 1)
    for k, (p, q) in enumerate(zip(x.tolist(), y.tolist())):
        if not xs[p] and not ys[q]:
            xs[p] = ys[q] = 1
            out.append(k)
    return np.array(out, int)


def _pairs(a: pd.DataFrame, b: pd.DataFrame, score: np.ndarray, keys: list[str], ident: str) -> pd.DataFrame:
    """Rows of pairs from the intervals on both sides."""
    a, b = a.reset_index(drop=True), b.reset_index(drop=True)
    return pd.DataFrame({**{k: a[k] for k in keys}, **{c: a[c] for c in (ident, "lo", "hi")}, **{f"r_{c}": b[c] for c in (ident, "lo", "hi")}, "score": score})


def _first_pairs(a: pd.DataFrame, b: pd.DataFrame, ident: str, most: int, cells: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Places in a and in b, and scores, of the first `most` overlapping pairs by falling score and identifiers, in this order; whether there are more.

    Pairs are looked through `cells` at a time, and twice `most` are kept at the most besides.
    """
    lo, hi, r_lo, r_hi = (d[c].to_numpy() for d in (a, b) for c in ("lo", "hi"))
    x, y = (pd.factorize(d[ident], sort=True)[0] for d in (a, b))
    held, size, least, more = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))], 0, -np.inf, False
    step = max(1, cells // max(1, len(b)))
    for at in range(0, len(a), step):
        u, v = lo[at : at + step, None], hi[at : at + step, None]
        meet = (u <= r_hi) & (r_lo <= v)
        score = (np.minimum(v, r_hi) - np.maximum(u, r_lo) + 1) / (np.maximum(v, r_hi) - np.minimum(u, r_lo) + 1)
        p, q = np.nonzero(meet & (score >= least))
        more = more or len(p) < np.count_nonzero(meet)
        held.append((p + at, q, score[p, q]))
        size += len(p)
        if size > 2 * most:
            i, j, s = map(np.concatenate, zip(*held))
            least, more = np.partition(s, size - most)[size - most], True
            kept = np.flatnonzero(s >= least)
            if len(kept) > 3 * most // 2:  # many of one score
                kept = kept[np.lexsort((y[j[kept]], x[i[kept]], -s[kept]))[:most]]
            held, size = [(i[kept], j[kept], s[kept])], len(kept)
    i, j, s = map(np.concatenate, zip(*held))
    order = np.lexsort((y[j], x[i], -s))
    more, order = more or len(order) > most, order[:most]
    return i[order], j[order], s[order], more


def _whole_key(rows: pd.DataFrame, keys: list[str], ident: str, most: int) -> pd.DataFrame:
    """assigned for one key, band by band: when the first pairs of the order are settled, what is left has none of them."""
    a, b = (rows[rows["side"] == k] for k in (0, 1))
    out, more = [], True
    while more:
        i, j, s, more = _first_pairs(a, b, ident, most)
        x, y = a[ident].to_numpy()[i], b[ident].to_numpy()[j]
        now = _taken(pd.factorize(x)[0], pd.factorize(y)[0])
        out.append(_pairs(a.iloc[i[now]], b.iloc[j[now]], s[now], keys, ident))
        a, b = a[~a[ident].isin(x[now])], b[~b[ident].isin(y[now])]
    return pd.concat(out, ignore_index=True)


def _matched_by_bands(left: DataFrame, right: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """assigned for crowded keys; no list of all their pairs is made.

    A key of at most EDGE by EDGE pairs is matched in a task. A larger one is dealt to tiles of about EDGE by EDGE. Each gives its first
    pairs; down to where the first of the tiles breaks off all pairs are known, so these are matched, and their intervals leave. So it
    goes on until the key is small. A task holds a tile's intervals and HELD pairs (1,024 of each tile, where the tiles are very many).
    """
    rows, schema = _sides(left, right, keys, ident)
    edge, held, r = EDGE, HELD, f"r_{ident}"
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest, out = settle(rows), None

    def whole(d):
        return _whole_key(d, keys, ident, held)

    def first(d):
        a, b = (d[d["side"] == k] for k in (0, 1))
        i, j, s, more = _first_pairs(a, b, ident, max(1024, held // int(d["tiles"].iloc[0])))
        # The pair at which the tile breaks off is marked.
        return _pairs(a.iloc[i], b.iloc[j], s, keys, ident).assign(ends=more & (np.arange(len(s)) == len(s) - 1))

    def merge(d):
        x, y = (pd.factorize(d[c], sort=True)[0] for c in (ident, r))
        order = np.lexsort((y, x, -d["score"].to_numpy()))
        ends = np.flatnonzero(d["ends"].to_numpy()[order])
        order = order[: ends[0] + 1] if len(ends) else order
        return d.iloc[order[_taken(x[order], y[order])]].drop(columns="ends")

    while True:
        count = lambda k: F.count_if(F.col("side") == k)
        sizes = settle(rest.groupBy(*keys).agg(count(0).alias("n"), count(1).alias("m")).where("n > 0 and m > 0"))
        large = F.col("n") * F.col("m") > edge * edge
        here = rest.join(sizes.where(~large), keys).select(*rest.columns).repartition(tasks, *keys).groupBy(*keys).applyInPandas(whole, schema)
        out = here if out is None else out.unionByName(here)
        if not sizes.where(large).take(1):
            return out
        rest = rest.join(sizes.where(large), keys).withColumns({"n": F.ceil(F.col("n") / edge), "m": F.ceil(F.col("m") / edge)})
        mine, others = (F.when(F.col("side") == 0, c).otherwise(d) for c, d in ((F.col("n"), F.col("m")), (F.col("m"), F.col("n"))))
        dealt = rest.withColumn("own", F.pmod(F.xxhash64(ident), mine)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
        tile = [F.when(F.col("side") == 0, F.col(c)).otherwise(F.col(d)).alias(e) for c, d, e in (("own", "other", "across"), ("other", "own", "down"))]
        dealt = dealt.select(*keys, ident, "lo", "hi", "side", (F.col("n") * F.col("m")).alias("tiles"), *tile)
        firsts = dealt.repartition(tasks, *keys, "across", "down").groupBy(*keys, "across", "down").applyInPandas(first, f"{schema}, ends boolean")
        best = settle(firsts.repartition(tasks, *keys).groupBy(*keys).applyInPandas(merge, schema))
        gone = best.select(*keys, ident, F.lit(0).alias("side")).unionByName(best.select(*keys, F.col(r).alias(ident), F.lit(1).alias("side")))
        rest = settle(rest.select(*rows.columns).join(gone, [*keys, ident, "side"], "left_anti").select(*rows.columns))
        out = out.unionByName(best)


def agreement(left: DataFrame, right: DataFrame, pairs: DataFrame, keys: list[str], ident: str, by: list[str]) -> DataFrame:
    """by, counts of pairs of score 1, from 0.8, from 0.5 and below, of left and right intervals without a partner, and the score.

    The score is the sum of the pairs' scores less one for each interval without a partner. by: some of the keys, or none.
    """
    r = pairs.select(*keys, F.col(f"r_{ident}").alias(ident))
    rows = pairs.select(*by, F.lit("pair").alias("kind"), "score")
    for kind, every, used in (("left", left, pairs.select(*keys, ident)), ("right", right, r)):
        rows = rows.unionByName(every.join(used, [*keys, ident], "left_anti").select(*by, F.lit(kind).alias("kind"), F.lit(-1.0).alias("score")))
    s, pair = F.col("score"), F.col("kind") == "pair"
    parts = {"perfect": pair & (s == 1), "partial80": pair & (s >= 0.8) & (s < 1), "partial50": pair & (s >= 0.5) & (s < 0.8), "partial0": pair & (s < 0.5)}
    parts |= {"false_negatives": F.col("kind") == "left", "false_positives": F.col("kind") == "right"}
    return rows.groupBy(*by).agg(*[F.count_if(c).alias(k) for k, c in parts.items()], F.coalesce(F.sum("score"), F.lit(0.0)).alias("score"))


def uncovered(points: DataFrame, features: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Points (keys, at) that no interval (lo, hi) covers."""
    f = binned(features, width).select(*[F.col(k).alias(f"f_{k}") for k in (*keys, "bin", "lo", "hi")])
    p = points.withColumn("bin", F.floor(F.col("at") / width))
    on = [F.col(k) == F.col(f"f_{k}") for k in (*keys, "bin")]
    return p.join(f, [*on, F.col("at") >= F.col("f_lo"), F.col("at") <= F.col("f_hi")], "left_anti").drop("bin")


def islands(rows: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Maximal runs of one state: keys, state, run, first and last of order[0], length. A run that is open at the end counts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((~F.lag(state).over(w).eqNullSafe(F.col(state))).cast("int"), F.lit(1))
    runs = rows.withColumn("new", F.when(F.row_number().over(w) == 1, 1).otherwise(new)).withColumn("run", F.sum("new").over(w))
    return runs.groupBy(*keys, "run", state).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length"))
