"""Most probable paths of sequences that are too long for one task: a max-plus scan over parts.

A sequence comes as rows (seq_id, part, obs), its parts numbered from 0. Each part gives its transfer: for every state before
its first symbol, the best scores of all states at its last one. Rows of this matrix that differ by a constant are kept
once; after a few hundred symbols there are hardly more than a few, so a transfer costs about as much as a plain pass. Transfers
are combined in groups of `fan` parts, groups of groups and so on, and the scores at the start of every part follow
on the way back down. From them each part finds its back pointers by itself and traces back from all its last states at
once; these paths meet soon, so what goes on is one common path and a short tail for each last state, packed. Which one is the true
last state follows from a second scan, from the end, over the maps from last to first states.

Scores are whole numbers (logarithms times a power of two), so sums do not depend on how they are grouped and the path is the
plain one, the lowest state winning ties. Models have one transition class and no history; paths are of the states that speak.
"""

from __future__ import annotations

import zlib
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.models import Model
from .hmm import emissions
from .state import settle

#: Score of what is impossible; possible scores stay above half of it.
NEG = -(1 << 61)
#: Symbols of a part at most, parts of a group, steps between looks for equal rows, cells of back pointers in a task.
SIZE, FAN, LOOK, CELLS = 1 << 14, 32, 32, 1 << 25
#: Symbols of a part where many are decoded: short enough for a task to advance dozens of parts together.
PART = 1 << 12
#: Scores that a task moves at once, of all states before and edges of its parts; emission scores that it looks up ahead.
MOVED, AHEAD = 1 << 22, 1 << 19


class Steps:
    """A model's moves as whole numbers: edges in order of target and source."""

    def __init__(self, m: Model):
        if len(m.a) > 1 or m.order:
            raise ValueError("models of one transition class without history only")
        plain = m.without_silent() if m.silent.any() else m
        self.m, self.n = plain, plain.n
        # Ways through silent states stay two moves, which are far fewer than the moves they stand for, where no two states are joined by several ways.
        m = m.normalized() if m.silent.any() else m  # as taking silent states out does
        self.hubs = self._hubs(m) if m.silent.any() else []
        a = plain.a[0]
        if self.hubs:
            speaks = np.flatnonzero(~m.silent)
            a = m.a[0][np.ix_(speaks, speaks)]
        m = plain
        with np.errstate(divide="ignore"):
            la, start = np.log(a), np.log(m.a[0][0] if m.from_first else m.pi)
            lb = np.log(m.b) if m.b is not None else np.array([-750.0])
            self.hubs = [(i, np.log(x), j, np.log(y)) for i, x, j, y in self.hubs]
        finite = [x[np.isfinite(x)] for x in (np.concatenate([la.ravel(), *[np.add.outer(x, y).ravel() for _, x, _, y in self.hubs]]), start, lb)]
        worst = 1 + sum(np.abs(x).max(initial=0.0) for x in (np.concatenate(finite[:2]), finite[2]))
        self.bits = 58 - ceil(log2(SIZE * worst))
        self.dst, self.src = np.nonzero(np.isfinite(la.T))
        self.w, self.start = self.whole(la[self.src, self.dst]), self.whole(start)
        # States that one edge leads to need no choice.
        alone = np.bincount(self.dst, minlength=self.n)[self.dst] == 1
        self.only = [z[alone] for z in (self.src, self.dst, self.w)]
        self.many = [z[~alone] for z in (self.src, self.dst, self.w)]
        self.reached = np.unique(self.many[1])
        self.seg = np.searchsorted(self.many[1], self.reached)
        self.hubs = [(i, self.whole(x), j, self.whole(y)) for i, x, j, y in self.hubs]
        # Emission scores by symbol, a missing one last.
        self.table = np.concatenate([self.whole(lb).T, np.zeros((1, self.n), np.int64)]) if plain.b is not None else None

    @staticmethod
    def _hubs(m: Model) -> list[tuple]:
        """For each silent state: the states that speak before it and after it, with their shares; [] where two states are joined by several ways, silent states follow each other or lose mass."""
        silent, speaks = np.flatnonzero(m.silent), np.flatnonzero(~m.silent)
        a, number = m.a[0], np.cumsum(~m.silent) - 1
        if (a[np.ix_(silent, silent)] > 0).any() or m.from_first or np.abs(a[speaks].sum(axis=1) - 1).max(initial=0) > 1e-9:
            return []
        ways, hubs = (a[np.ix_(speaks, speaks)] > 0).astype(int), []
        for s in silent:
            i, j = speaks[a[speaks, s] > 0], speaks[a[s, speaks] > 0]
            if not len(j) and (a[i, s] == a[i].sum(axis=1)).all():
                continue  # an end, which no state goes on from
            if len(i) and abs(a[s].sum() - 1) > 1e-9:
                return []
            if len(i):
                ways[np.ix_(number[i], number[j])] += 1
                hubs.append((number[i], a[i, s], number[j], a[s, j]))
        return hubs if (ways <= 1).all() else []

    def whole(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(x), np.rint(np.where(np.isfinite(x), x, 0) * 2.0**self.bits), NEG).astype(np.int64)

    def said(self, obs: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[obs.astype(int)]
        with np.errstate(divide="ignore"):
            return self.whole(np.log(emissions(self.m, obs)))

    def moved(self, x: np.ndarray) -> np.ndarray:
        """Best scores after a move, of rows of scores."""
        out = np.full(x.shape, NEG, np.int64)
        # Of many rows, edges from states that none of them can be in are left out.
        live = (x > NEG // 2).any(axis=0) if len(x) > 4 else np.ones(self.n, bool)
        src, dst, w = (z[live[self.only[0]]] for z in self.only)
        out[:, dst] = x[:, src] + w
        src, dst, w = (z[live[self.many[0]]] for z in self.many)
        if len(src):
            seg = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
            out[:, dst[seg]] = np.maximum.reduceat(x[:, src] + w, seg, axis=1)
        for i, into, j, on in self.hubs:
            out[:, j] = np.maximum(out[:, j], (x[:, i] + into).max(axis=1)[:, None] + on)
        return out

    def moved_from(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best scores after a move and the lowest state that each comes from."""
        out, back = np.full(x.shape, NEG, np.int64), np.zeros(x.shape, np.int32)
        src, dst, w = self.only
        out[:, dst], back[:, dst] = x[:, src] + w, src
        if len(self.seg):
            src, dst, w = self.many
            ways = x[:, src] + w
            out[:, self.reached] = np.maximum.reduceat(ways, self.seg, axis=1)
            edge = np.where(ways == out[:, dst], np.arange(len(src)), len(src) - 1)
            back[:, self.reached] = src[np.minimum.reduceat(edge, self.seg, axis=1)]
        for i, into, j, on in self.hubs:
            ways = x[:, i] + into
            best = ways.argmax(axis=1)
            value, come = ways[np.arange(len(x)), best][:, None] + on, i[best][:, None]
            better = (value > out[:, j]) | ((value == out[:, j]) & (come < back[:, j]))
            out[:, j], back[:, j] = np.where(better, value, out[:, j]), np.where(better, come, back[:, j])
        return out, back


def _level(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with their maximum taken off (what is impossible stays so), and the maxima."""
    top = x.max(axis=1)
    return np.where(x > NEG // 2, x - top[:, None], NEG), np.where(top > NEG // 2, top, NEG)


class Transfer:
    """From each state before to all states after: kinds[of[i]] + add[i]."""

    def __init__(self, of: np.ndarray, add: np.ndarray, kinds: np.ndarray):
        self.of, self.add, self.kinds = of, add, kinds

    def packed(self) -> bytes:
        n = len(self.of)
        return np.concatenate([[n], self.of, self.add, self.kinds.ravel()]).astype(np.int64).tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Transfer:
        x = np.frombuffer(data, np.int64)
        n = int(x[0])
        return cls(x[1 : n + 1], x[n + 1 : 2 * n + 1], x[2 * n + 1 :].reshape(-1, n))

    def after(self, rows: np.ndarray) -> np.ndarray:
        """Rows of scores carried through."""
        best = np.full((len(rows), len(self.kinds)), NEG, np.int64)
        np.maximum.at(best.T, self.of, (rows + self.add).T)
        best = np.maximum(best, NEG)
        return np.maximum((best[:, :, None] + self.kinds[None]).max(axis=1), NEG)

    def then(self, other: Transfer) -> Transfer:
        kinds, top = _level(other.after(self.kinds))
        add = np.maximum(self.add + top[self.of], NEG)
        return Transfer(self.of, _level(add[None])[0][0], kinds)


def _batches(obs: list, cells: int, width: int, most: int):
    """Numbers of parts, at most `most`, in order of length, that go together; padded observations; lengths."""
    lengths = np.array([len(o) for o in obs])
    order, at = np.argsort(lengths, kind="stable"), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < most and (end + 1 - at) * max(int(lengths[order[end]]), 1) * width <= cells:
            end += 1
        rows = order[at:end]
        x = np.zeros((len(rows), max(int(lengths[rows].max()), 1)))
        for i, r in enumerate(rows):
            x[i, : lengths[r]] = obs[r]
        yield rows, x, lengths[rows]
        at = end


def _said(steps: Steps, x: np.ndarray):
    """Emission scores of all parts, step by step."""
    block = max(1, AHEAD // (len(x) * steps.n))
    for at in range(0, x.shape[1], block):
        e = steps.said(x[:, at : at + block])
        for t in range(e.shape[1]):
            yield at + t, e[:, t]


def _transfers(steps: Steps, x: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> list[Transfer]:
    b, n = len(x), steps.n
    # Row of each part and state before. The first part of a sequence has a start instead of a state before; state 0 stands for it, so it has one row.
    own = np.where(first, 1, n)
    of = np.minimum(np.arange(n), own[:, None] - 1) + (np.cumsum(own) - own)[:, None]
    add = np.where(first[:, None] & (np.arange(n) > 0), NEG, 0).astype(np.int64)
    part = np.repeat(np.arange(b), own)
    rows = np.where(np.arange(n) == (np.arange(len(part)) - (np.cumsum(own) - own)[part])[:, None], 0, NEG).astype(np.int64)
    ended: list = [None] * b

    def squeezed():
        nonlocal of, add, rows, part
        level, top = _level(rows)
        keyed = np.concatenate([part[:, None], level], axis=1)
        kinds, where = np.unique(keyed, axis=0, return_inverse=True)
        where = where.ravel()
        live = of >= 0
        add = np.where(live, np.maximum(add + top[of], NEG), add)
        of, rows, part = np.where(live, where[of], -1), kinds[:, 1:], kinds[:, 0]

    def close(done):
        """Take the rows of the parts out."""
        nonlocal of, rows, part
        for i in done:
            own = part == i
            number = np.cumsum(own) - 1
            ended[i] = Transfer(number[of[i]], add[i], rows[own])
        keep = ~np.isin(part, done)
        number = np.cumsum(keep) - 1
        of = np.where((of >= 0) & keep[of], number[of], -1)
        rows, part = rows[keep], part[keep]

    empty = np.flatnonzero(lengths == 0)
    if len(empty):
        close(empty)
    for t, e in _said(steps, x):
        if not len(rows):
            break
        now = steps.moved(rows)
        if t == 0:
            now[first[part]] = steps.start
        rows = np.maximum(np.maximum(now, NEG) + e[part], NEG)
        if (t % LOOK == LOOK - 1 or t in (0, 1, 3, 7, 15)) and len(rows) > len(np.unique(part)):
            squeezed()
        done = np.flatnonzero(lengths == t + 1)
        if len(done):
            squeezed()
            close(done)
    return ended


def _traced(steps: Steps, x: np.ndarray, lengths: np.ndarray, first: np.ndarray, before: np.ndarray):
    """For each part: state before for each last state, common path, tails (packed, see _unpacked), gains, best last state (-1: none)."""
    b, n = len(x), steps.n
    back = np.zeros((x.shape[1], b, n), np.uint8 if n <= 256 else np.uint16 if n <= 1 << 16 else np.int32)
    score = before.copy()
    for t, e in _said(steps, x):
        on = slice(int(np.searchsorted(lengths, t, "right")), None)  # parts come in order of length
        now, come = steps.moved_from(score[on])
        if t == 0:
            now, come = np.where(first[on, None], steps.start, now), np.where(first[on, None], 0, come)
        score[on] = np.maximum(np.maximum(now, NEG) + e[on], NEG)
        back[t, on] = come
    last = score
    ok = last > NEG // 2
    best = np.where(ok.any(axis=1), last.argmax(axis=1), -1)
    state = np.where(ok, np.arange(n), best[:, None])
    origin = state.copy()
    for t in range(x.shape[1] - 1, -1, -1):
        on = np.arange(int(np.searchsorted(lengths, t, "right")), b)
        here = origin[on].copy()
        origin[on] = back[t, on[:, None], here]
        back[t, on] = here
    for i in range(b):
        size = int(lengths[i])
        if best[i] < 0:
            yield np.zeros(n, int), np.zeros(0, np.int32), b"", np.zeros(n, int), -1
            continue
        paths = back[:size, i]
        common = int((paths == paths[:, :1]).all(axis=1).sum())  # paths that meet, going back, stay together
        from_score = np.where(first[i], 0, before[i][origin[i]])
        yield origin[i], paths[:common, 0].astype(np.int32), zlib.compress(paths[common:].T.tobytes(), 1), np.where(ok[i], last[i] - from_score, 0), int(best[i])


def _unpacked(steps: Steps, tails: bytes, state: int) -> np.ndarray:
    """The tail of one last state; those of the last states differ little, so together they pack into little more than one."""
    kind = np.uint8 if steps.n <= 256 else np.uint16 if steps.n <= 1 << 16 else np.int32
    return np.frombuffer(zlib.decompress(tails), kind).reshape(steps.n, -1)[state].astype(np.int32)


def _grouped(rows: DataFrame, fan: int) -> DataFrame:
    return rows.withColumn("up", F.floor(F.col("part") / fan).cast("long"))


def _levels(rows: DataFrame, merge, fan: int) -> list[DataFrame]:
    """rows (seq_id, part, data), those merged by groups, and so on to one row a sequence."""
    out = [rows]
    most = rows.agg(F.max("part").alias("p")).first()["p"] or 0
    while most > 0:
        def run(frame):
            frame = frame.sort_values("part")
            return pd.DataFrame({"seq_id": frame["seq_id"].iloc[:1], "part": frame["up"].iloc[:1], "data": [merge(list(frame["data"]))]})

        out.append(settle(_grouped(out[-1], fan).groupBy("seq_id", "up").applyInPandas(run, "seq_id long, part long, data binary")))
        most //= fan
    return out


def _down(levels: list[DataFrame], given: DataFrame, walk, fan: int) -> DataFrame:
    """given (seq_id, part, value) for the top level, carried to the bottom. walk(datas, value) gives a value for each member."""
    for rows in reversed(levels[:-1]):
        both = _grouped(rows, fan).join(given.select("seq_id", F.col("part").alias("up"), "value"), ["seq_id", "up"])

        def run(frame):
            frame = frame.sort_values("part")
            return pd.DataFrame({"seq_id": frame["seq_id"], "part": frame["part"], "value": walk(list(frame["data"]), frame["value"].iloc[0])})

        given = settle(both.groupBy("seq_id", "up").applyInPandas(run, "seq_id long, part long, value binary"))
    return given


def decode_parts(parts: DataFrame, m: Model, fan: int = FAN) -> DataFrame:
    """seq_id, part, path, logp (of the part; their sum is the sequence's) of every part; null where the sequence is impossible.

    States are numbered as without the silent ones.

    Parts have 1 to SIZE symbols. logp is right to about 1e-9.
    """
    steps = Steps(m)
    n = steps.n
    most = max(1, MOVED // (n * (n + len(steps.src))))

    def transfers(frames):
        for frame in frames:
            obs, first = list(frame["obs"]), frame["part"].to_numpy() == 0
            if any(len(o) > SIZE for o in obs):
                raise ValueError(f"a part has more than {SIZE} symbols")
            # First parts have a row where others have one for each state, so more of them go together.
            for some, size in ((np.flatnonzero(first), most * n), (np.flatnonzero(~first), most)):
                yield from moved(frame.iloc[some], [obs[i] for i in some], first[some], size)

    def moved(frame, obs, first, size):
        for rows, x, lengths in _batches(obs, CELLS, n + 8, size):
            got = _transfers(steps, x, lengths, first[rows])
            yield pd.DataFrame({"seq_id": frame["seq_id"].to_numpy()[rows], "part": frame["part"].to_numpy()[rows], "data": [g.packed() for g in got]})

    def chained(datas):
        whole = Transfer.unpacked(datas[0])
        for d in datas[1:]:
            whole = whole.then(Transfer.unpacked(d))
        return whole.packed()

    def starts(datas, value):
        x, out = np.frombuffer(value, np.int64)[None], []
        for d in datas:
            out.append(x[0].tobytes())
            x = _level(Transfer.unpacked(d).after(x))[0]
        return out

    # Few bytes but long work: the parts go to all tasks.
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = settle(parts.select(F.col("seq_id").cast("long").alias("seq_id"), F.col("part").cast("long").alias("part"), "obs").repartition(tasks, "seq_id", "part"))
    bottom = settle(parts.mapInPandas(transfers, "seq_id long, part long, data binary"))
    levels = _levels(bottom, chained, fan)
    zero = np.where(np.arange(n) == 0, 0, NEG).astype(np.int64).tobytes()
    before = _down(levels, levels[-1].select("seq_id", "part", F.lit(bytearray(zero)).alias("value")), starts, fan)

    def traces(frames):
        for frame in frames:
            obs, first = list(frame["obs"]), frame["part"].to_numpy() == 0
            begin = np.stack([np.frombuffer(v, np.int64) for v in frame["value"]]) if len(frame) else np.zeros((0, n), np.int64)
            for rows, x, lengths in _batches(obs, CELLS, n + 8, most * n):
                got = list(_traced(steps, x, lengths, first[rows], begin[rows]))
                origin, common, tails, gain, best = map(list, zip(*got))
                yield pd.DataFrame({
                    "seq_id": frame["seq_id"].to_numpy()[rows], "part": frame["part"].to_numpy()[rows], "data": [np.asarray(o, np.int64).tobytes() for o in origin],
                    "common": common, "tails": tails, "gains": [g / 2.0**steps.bits for g in gain], "best": best,
                })

    schema = "seq_id long, part long, data binary, common array<int>, tails binary, gains array<double>, best int"
    traced = settle(parts.join(before, ["seq_id", "part"]).repartition(tasks, "seq_id", "part").mapInPandas(traces, schema))

    def composed(datas):
        whole = np.frombuffer(datas[-1], np.int64)
        for d in reversed(datas[:-1]):
            whole = np.frombuffer(d, np.int64)[whole]
        return whole.tobytes()

    def ends(datas, value):
        state, out = int(np.frombuffer(value, np.int64)[0]), []
        for d in reversed(datas):
            out.append(np.int64(state).tobytes())
            state = int(np.frombuffer(d, np.int64)[state]) if state >= 0 else -1
        return out[::-1]

    maps = _levels(traced.select("seq_id", "part", "data"), composed, fan)
    final = traced.groupBy("seq_id").agg(F.max_by("best", "part").alias("best"))
    # 8 bytes in the machine's order, as numpy reads them.
    known = final.select("seq_id", F.lit(0).cast("long").alias("part"), F.col("best").cast("long").alias("best"))
    known = known.mapInPandas(lambda frames: (f.assign(value=[np.int64(v).tobytes() for v in f["best"]])[["seq_id", "part", "value"]] for f in frames), "seq_id long, part long, value binary")
    last = _down(maps, known, ends, fan)
    last = last.mapInPandas(lambda frames: (f.assign(state=[int(np.frombuffer(v, np.int64)[0]) for v in f["value"]])[["seq_id", "part", "state"]] for f in frames), "seq_id long, part long, state int")

    def chosen(frames):
        for frame in frames:
            out = []
            for s, p, common, tails, gains, state in zip(*(frame[c] for c in ("seq_id", "part", "common", "tails", "gains", "state"))):
                out.append((s, p, np.concatenate([common, _unpacked(steps, tails, state)]) if state >= 0 else None, gains[state] if state >= 0 else None))
            yield pd.DataFrame(out, columns=["seq_id", "part", "path", "logp"])

    return traced.drop("data", "best").join(last, ["seq_id", "part"]).mapInPandas(chosen, "seq_id long, part long, path array<int>, logp double")


def cut(seqs: DataFrame, size: int = SIZE) -> DataFrame:
    """seq_id, part, obs: whole sequences (seq_id, obs) cut into parts; empty ones have none."""
    d = seqs.where(F.size("obs") > 0).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.size("obs") - 1) / size).cast("int"))))
    return d.select("seq_id", F.col("part").cast("long").alias("part"), F.slice("obs", F.col("part") * size + 1, F.lit(size)).alias("obs"))


def one_contig(rows: DataFrame, order: list[str], size: int = SIZE, backwards: bool = False) -> DataFrame:
    """seq_id 0, part, offset, obs: the strings of symbols (order columns, obs: arrays or text) of all rows, one after the other, in parts.

    Rows are sorted over ranges and numbered by the ranges' counts, so no task sees them all. Rows may have any length; parts end
    where rows end. offset counts the symbols before a part.
    """
    keys = [F.col(c).desc() if backwards else F.col(c) for c in order]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cut_rows(rows, order, size, backwards).repartitionByRange(n, *keys, "nth").sortWithinPartitions(*keys, "nth")
    d = settle(d.withColumn("range", F.spark_partition_id()))
    counts = d.groupBy("range").agg(F.count("*").alias("n"), F.sum(_length(d)).alias("s"))  # a row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"))
    own = Window.partitionBy("range").orderBy(*keys, "nth")
    before_it = F.coalesce(F.sum(_length(d)).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.select("range", "obs", (F.row_number().over(own) - 1).alias("place"), before_it.alias("passed")).join(F.broadcast(counts), "range")
    return d.select(F.lit(0).cast("long").alias("seq_id"), (F.col("place") + F.col("n0")).alias("part"), (F.col("passed") + F.col("s0")).alias("offset"), "obs")


def gathered(parts: DataFrame, size: int) -> DataFrame:
    """seq_id, part, obs: parts (with offset) put together anew into parts of `size` symbols. Slices of the parts are shuffled, not symbols."""
    chunk = F.explode(F.sequence(F.floor(F.col("offset") / size).cast("long"), F.floor((F.col("offset") + F.size("obs") - 1) / size).cast("long")))
    d = parts.where(F.size("obs") > 0).select("seq_id", "offset", "obs", chunk.alias("chunk"))
    begin = F.greatest(F.col("chunk") * size - F.col("offset"), F.lit(0))
    own = F.slice("obs", (begin + 1).cast("int"), ((F.col("chunk") + 1) * size - F.col("offset") - begin).cast("int"))
    d = d.select("seq_id", F.col("chunk").alias("part"), F.struct((F.col("offset") + begin).alias("at"), own.alias("x")).alias("x"))
    return d.groupBy("seq_id", "part").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("seq_id", "part", F.flatten(F.transform("xs", lambda x: x["x"])).alias("obs"))


def cut_rows(rows: DataFrame, order: list[str], size: int, backwards: bool = False) -> DataFrame:
    """order columns, nth, obs: rows cut into parts in order."""
    n = _length(rows)
    d = rows.where(n > 0).select(*order, "obs", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("nth"))
    part = F.substring if dict(rows.dtypes)["obs"] == "string" else F.slice
    return d.select(*order, "nth", part("obs", F.col("nth") * size + 1, F.lit(size)).alias("obs"))


def _length(rows: DataFrame):
    return F.char_length("obs") if dict(rows.dtypes)["obs"] == "string" else F.size("obs")


def runs(paths: DataFrame, kind: list[int]) -> DataFrame:
    """seq_id, kind, first, last (places from 0) of the maximal runs of states of one kind, of paths (seq_id, part, offset, path).

    Parts find their own runs; only those at the ends of parts are put together along the sequence.
    """
    table = np.array(kind)

    def own(frames):
        for frame in frames:
            yield own_runs(table, frame["seq_id"], frame["offset"], frame["path"])

    return joined_runs(settle(paths.select("seq_id", "part", "offset", "path").mapInPandas(own, "seq_id long, kind int, first long, last long, open boolean")))


def own_runs(table: np.ndarray, ids, offsets, paths) -> pd.DataFrame:
    """seq_id, kind, first, last, open (it may go on) of the runs of each path by itself."""
    out = []
    for s, o, path in zip(ids, offsets, paths):
        if path is None or not len(path):
            continue
        k = table[np.asarray(path)]
        at = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
        end = np.concatenate([at[1:], [len(k)]]) - 1
        out += [(s, int(k[i]), int(o + i), int(o + j), bool(i == 0 or j == len(k) - 1)) for i, j in zip(at, end)]
    return pd.DataFrame(out, columns=["seq_id", "kind", "first", "last", "open"])


def joined_runs(every: DataFrame) -> DataFrame:
    """Runs of own_runs; open ones that go on are put together."""
    d = every.where("open").drop("open")
    w = Window.partitionBy("seq_id").orderBy("first")
    # Runs that go on stand next to each other; closed ones stand between others.
    on = (F.lag("kind").over(w) == F.col("kind")) & (F.lag("last").over(w) + 1 == F.col("first"))
    d = d.withColumn("new", F.when(on, 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    d = d.groupBy("seq_id", "g", "kind").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("g")
    return d.unionByName(every.where("not open").drop("open"))
