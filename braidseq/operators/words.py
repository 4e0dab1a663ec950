"""Most probable paths of strings under models whose states stand in words: longpath's scan, moved on by words.

States that can only be run through one after the other are a word, and words that lead from one place to another (a silent state, a
state with its own ways on, the beginning) are one edge: a table of the best of them by the symbols that they read. A gene model of
hundreds of states so has a few edges between a few places, and a part of a string moves the places' last scores (slots) only. Scores are the
whole numbers of longpath.Steps, so paths are the plain ones, the lowest state winning ties.

Words may lie across the ends of parts: a part knows the symbols before it (lead), and its path goes from the beginning of its
first word that ends in it to the end of its last one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.models import Model
from .longpath import FAN, NEG, SIZE, Steps, Transfer, _down, _level, _levels, joined_runs, own_runs
from .state import settle

#: Rows of a table at most, slots at most, symbols that a task decodes at once, scores that it looks up ahead.
CODES, SLOTS, CELLS, AHEAD = 4096, 24, 1 << 22, 1 << 20
#: Letters of the symbols 0, 1 and so on, in either case; others are missing.
LETTERS = ("a", "c", "g", "tu")


class NoWords(ValueError):
    """The model's states don't stand in few words."""


class Words:
    """A model as edges between places: u, v, symbols and the best word by code (the last symbols, the latest one the lowest digit)."""

    def __init__(self, m: Model):
        steps = Steps(m)
        if steps.table is None:
            raise NoWords("values have no codes")
        self.n, self.bits, self.base = steps.n, steps.bits, len(steps.table)
        direct, hubs = list(zip(steps.src.tolist(), steps.dst.tolist(), steps.w.tolist())), []
        for i, into, j, on in steps.hubs:
            if len(i) == 1:
                direct += [(int(i[0]), t, int(into[0]) + w) for t, w in zip(j.tolist(), on.tolist())]
            else:
                hubs.append((dict(zip(i.tolist(), into.tolist())), dict(zip(j.tolist(), on.tolist()))))
        begins = {s: w for s, w in enumerate(steps.start.tolist()) if w > NEG // 2}
        outs, ins = [[] for _ in range(self.n)], [[] for _ in range(self.n)]
        for s, t, w in direct:
            outs[s].append((t, w))
            ins[t].append((s, w))
        ways_in = [len(ins[s]) + (s in begins) + sum(s in on for _, on in hubs) for s in range(self.n)]
        ways_out = [len(outs[s]) + sum(s in into for into, _ in hubs) for s in range(self.n)]
        follows = {s: outs[s][0] for s in range(self.n) if ways_out[s] == 1 and outs[s] and ways_in[outs[s][0][0]] == 1 and outs[s][0][0] != s}
        most = max(k for k in range(1, 64) if k == 1 or self.base**k <= CODES)
        heads, chains = [s for s in range(self.n) if s not in {t for t, _ in follows.values()}], []
        while heads:
            chain, inner = [heads.pop()], []
            while chain[-1] in follows:
                t, w = follows[chain[-1]]
                if len(chain) == most:
                    heads.append(t)
                    break
                chain.append(t)
                inner.append(w)
            chains.append((chain, inner))
        chains.sort()
        # Places: the beginning, hubs, and ends of chains that states are reached from.
        ends = [c[-1] for c, _ in chains]
        head = {c[0]: number for number, (c, _) in enumerate(chains)}
        left = [s for s in ends if any(t in head for t, _ in outs[s])]
        place = {s: 1 + len(hubs) + i for i, s in enumerate(left)}
        from_states = [[-1], *[sorted(into) for into, _ in hubs], *[[s] for s in left]]
        rank = [x[0] + 1 for x in from_states]
        self.most = max((len(c) for c, _ in chains), default=1)
        size = self.base**self.most
        digits = np.arange(size)[:, None] // self.base ** np.arange(self.most) % self.base  # the latest symbol first
        edges, last = {}, {}

        def better(tables, key, value, state):
            at = tables.setdefault(key, (np.full(size, NEG, np.int64), np.full(size, self.n, np.int64)))
            take = (value > at[0]) | ((value == at[0]) & (state < at[1]))
            at[0][take], at[1][take] = value[take], state

        self.earlier = np.full((self.n, self.most), -1)
        for chain, inner in chains:
            into = [(0, begins[chain[0]])] if chain[0] in begins else []
            into += [(1 + h, on[chain[0]]) for h, (_, on) in enumerate(hubs) if chain[0] in on] + [(place[s], w) for s, w in ins[chain[0]] if s in place]
            spans = sorted((from_states[u][0], from_states[u][-1]) for u, _ in into)
            if any(a[1] >= b[0] for a, b in zip(spans, spans[1:])):
                raise NoWords("ties between places are not settled by their order")
            out = [(1 + h, w[chain[-1]]) for h, (w, _) in enumerate(hubs) if chain[-1] in w] + ([(place[chain[-1]], 0)] if chain[-1] in place else [])
            for k in range(1, len(chain) + 1):
                said = np.zeros(size, np.int64)
                for i in range(k):
                    said = np.maximum(said + steps.table[digits[:, k - 1 - i], chain[i]] + (inner[i - 1] if i else 0), NEG)
                self.earlier[chain[k - 1], :k] = chain[k - 1 :: -1] if k > 1 else chain[:1]
                for u, w in into:
                    value = np.maximum(said + w, NEG)
                    better(last, (u, k), value, chain[k - 1])
                    for v, x in out if k == len(chain) else ():
                        better(edges, (v, u, k), np.maximum(value + x, NEG), chain[-1])
        kept = sorted(edges)
        self.u, self.v, self.k = (np.array([e[i] for e in kept], int) for i in (1, 0, 2))
        self.value = np.stack([edges[e][0] for e in kept]) if kept else np.zeros((0, size), np.int64)
        self.state = np.stack([edges[e][1] for e in kept]) if kept else np.zeros((0, size), np.int64)
        self.key = self.state * (self.n + 1) + np.array([rank[u] for u in self.u], int)[:, None] if kept else self.state
        self.last = [(u, k, value, state * (self.n + 1) + rank[u]) for (u, k), (value, state) in sorted(last.items())]
        # How many of its last scores a place has to remember.
        self.held = [max([k for u, k, _, _ in self.last if u == p], default=0) for p in range(len(from_states))]
        self.into = [(v, np.flatnonzero(self.v == v).tolist()) for v in range(1, len(from_states)) if self.held[v] and (self.v == v).any()]
        self.slot = [(u, a) for u, h in enumerate(self.held) for a in range(h)]
        self.at = {x: i for i, x in enumerate(self.slot)}
        if len(self.slot) > SLOTS:
            raise NoWords("too many places")

    @property
    def lead(self) -> int:
        return self.most - 1

    def begin(self) -> np.ndarray:
        """Scores of the slots before the first symbol."""
        return np.array([0 if x == (0, 0) else NEG for x in self.slot], np.int64)


def _number(letters) -> np.ndarray:
    out = np.full(256, len(letters), np.uint8)
    for i, some in enumerate(letters):
        for c in some:
            out[ord(c.lower())] = out[ord(c.upper())] = i
    return out


def _batches(m: Words, obs: list, leads: np.ndarray, number: np.ndarray):
    """Numbers of parts in order of length, the codes (time, part) of their own symbols, their lengths."""
    lengths = np.array([len(o) for o in obs], np.int64) - leads
    order, at = np.argsort(lengths, kind="stable"), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * int(lengths[order[end]]) <= CELLS:
            end += 1
        rows = order[at:end]
        x = np.zeros((len(rows), m.lead + int(lengths[rows[-1]])), np.uint8)
        for i, r in enumerate(rows):
            x[i, m.lead - leads[r] : m.lead + lengths[r]] = number[np.frombuffer(obs[r], np.uint8)]
        x, steps = np.ascontiguousarray(x.T), int(lengths[rows[-1]])
        codes = np.zeros((steps, len(rows)), np.uint16)
        for i in range(m.most):
            codes += x[m.lead - i : m.lead - i + steps] * np.uint16(m.base**i)
        yield rows, codes, lengths[rows]
        at = end


def _said(m: Words, codes: np.ndarray, lengths: np.ndarray):
    """Place in time, first part that is as long, scores of the edges."""
    block = max(1, AHEAD // max(1, codes.shape[1] * len(m.u)))
    for at in range(0, len(codes), block):
        e = m.value[:, codes[at : at + block]]
        for t in range(e.shape[1]):
            yield at + t, int(np.searchsorted(lengths, at + t, "right")), e[:, t]


def _rings(m: Words, before: np.ndarray) -> list[list[np.ndarray]]:
    """For each place its scores at the last times, at their time modulo their number. before: scores of the slots in the last axis."""
    return [[np.array(before[..., m.at[u, (-1 - i) % h]], order="C") for i in range(h)] for u, h in enumerate(m.held)]


def transfers(m: Words, codes: np.ndarray, lengths: np.ndarray) -> list[Transfer]:
    """From each slot before a part to all slots after it."""
    b, s = codes.shape[1], len(m.slot)
    v = _rings(m, np.broadcast_to(np.where(np.eye(s, dtype=bool), 0, NEG)[:, None], (s, b, s)))
    out = np.empty((b, s, s), np.int64)
    for t, lo, e in _said(m, codes, lengths):
        new = []
        for _, some in m.into:
            best = None
            for i in some:
                u = m.u[i]
                way = v[u][(t - m.k[i]) % m.held[u]][:, lo:] + e[i, lo:]
                best = way if best is None else np.maximum(best, way, out=best)
            new.append(np.maximum(best, NEG, out=best))
        if m.held[0]:
            v[0][t % m.held[0]][:, lo:] = NEG
        for (p, _), x in zip(m.into, new):
            v[p][t % m.held[p]][:, lo:] = x
        hi = int(np.searchsorted(lengths, t + 1, "right"))
        if hi > lo:
            for i, (p, a) in enumerate(m.slot):
                out[lo:hi, :, i] = v[p][(t - a) % m.held[p]][:, lo:hi].T
    got = []
    for x in out:
        kinds, top = _level(x)
        got.append(Transfer(np.arange(s), top, kinds))
    return got


class Walk:
    """Parts moved on from known scores: scores and origins (slots before) of the slots after, the best last state, and the ways back."""

    def __init__(self, m: Words, codes: np.ndarray, lengths: np.ndarray, before: np.ndarray, ways: bool):
        b, self.m, self.codes, self.lengths, self.before = codes.shape[1], m, codes, lengths, before
        v = _rings(m, before)
        o = _rings(m, np.broadcast_to(np.arange(len(m.slot), dtype=np.int8), before.shape))
        self.score, self.origin = np.full((b, len(m.slot) + 1), NEG, np.int64), np.full((b, len(m.slot) + 1), -1)
        self.end = np.full((b, 3), -1)  # last state, its word's place and how many symbols of it were read
        self.back = np.zeros((len(m.held), *codes.shape), np.uint8) if ways else None
        for t, lo, e in _said(m, codes, lengths):
            hi = int(np.searchsorted(lengths, t + 1, "right"))
            if hi > lo:
                self._ended(t, lo, hi, v, o)
            new = []
            for p, some in m.into:
                at = [(t - m.k[i]) % m.held[m.u[i]] for i in some]
                best, edge, come = v[m.u[some[0]]][at[0]][lo:] + e[some[0], lo:], None, o[m.u[some[0]]][at[0]][lo:]
                for i, place in zip(some[1:], at[1:]):
                    way = v[m.u[i]][place][lo:] + e[i, lo:]
                    better, same = way > best, way == best
                    if same.any():
                        here = np.flatnonzero(same)
                        code, now = codes[t, lo + here], some[0] if edge is None else edge[here]
                        better[here] = m.key[i, code] < m.key[now, code]
                    edge = np.where(better, np.uint8(i), np.uint8(some[0]) if edge is None else edge)
                    best, come = np.where(better, way, best), np.where(better, o[m.u[i]][place][lo:], come)
                if ways:
                    self.back[p, t, lo:] = some[0] if edge is None else edge
                # Copies: the places that they are read from are written over below.
                new.append((np.maximum(best, NEG, out=best), come.copy()))
            if m.held[0]:
                v[0][t % m.held[0]][lo:] = NEG
            for (p, _), (x, come) in zip(m.into, new):
                v[p][t % m.held[p]][lo:], o[p][t % m.held[p]][lo:] = x, come
            if hi > lo:
                for i, (p, a) in enumerate(m.slot):
                    self.score[lo:hi, i], self.origin[lo:hi, i] = v[p][(t - a) % m.held[p]][lo:hi], o[p][(t - a) % m.held[p]][lo:hi]

    def _ended(self, t, lo, hi, v, o):
        """The best last states, where t is the last time: words may end before they are read to their end."""
        m, on = self.m, slice(lo, hi)
        best, key, found = np.full(hi - lo, NEG // 2), np.zeros(hi - lo, np.int64), np.full((hi - lo, 3), -1)
        come = np.full(hi - lo, -1)
        for u, k, value, keys in m.last:
            code, place = self.codes[t, on], (t - k) % m.held[u]
            way, order = v[u][place][on] + value[code], keys[code]
            take = (way > best) | ((way == best) & (found[:, 0] >= 0) & (order < key))
            best, key, come = np.where(take, way, best), np.where(take, order, key), np.where(take, o[u][place][on], come)
            found[take] = np.stack([order // (m.n + 1), np.full(hi - lo, u), np.full(hi - lo, k)], axis=1)[take]
        self.end[on], self.score[on, -1], self.origin[on, -1] = found, best, come

    def paths(self, slot: np.ndarray):
        """For each part its place of the path's first state (from its own first symbol), the path and its gain; slot: the slot after it, one more for its best last state, -1 for no path."""
        m, b, k0 = self.m, len(self.lengths), self.m.most
        path = np.full((b, k0 + len(self.codes)), -1, np.int16 if m.n < 1 << 15 else np.int32)
        whole = slot == len(m.slot)
        known = np.array([*m.slot, (0, 0)])
        node, time = known[slot, 0], self.lengths - 1 - known[slot, 1]
        for i in np.flatnonzero(whole):
            s, u, k = self.end[i]
            if s >= 0:
                path[i, k0 + time[i] - np.arange(k)] = m.earlier[s, :k]
                node[i], time[i] = u, time[i] - k
        stop = np.where(whole, self.lengths, self.lengths - known[slot, 1])
        bad = (slot < 0) | (whole & (self.end[:, 0] < 0))
        on = np.flatnonzero((time >= 0) & ~bad)
        while len(on):
            t = time[on]
            edge = self.back[node[on], t, on]
            state, k = m.state[edge, self.codes[t, on]], m.k[edge]
            for i in range(k0):
                long = slice(None) if (k > i).all() else k > i
                path[on[long], k0 + t[long] - i] = m.earlier[state[long], i]
            node[on], time[on] = m.u[edge], t - k
            on = on[time[on] >= 0]
        for i in range(b):
            if bad[i]:
                yield 0, None, None
                continue
            gain = self.score[i, slot[i]] - self.before[i, m.at[int(node[i]), int(-1 - time[i])]]
            yield int(time[i]) + 1, path[i, k0 + time[i] + 1 : k0 + stop[i]], float(gain) / 2.0**m.bits


def decode(parts: DataFrame, m: Model, emit: Callable, schema: str, fan: int = FAN, letters=LETTERS) -> DataFrame:
    """emit(seq_ids, parts, offsets, paths, logps) of every task's parts: offsets are the places of the paths' first states, paths (of the states that speak) None where a sequence is impossible.

    parts: those of cut or of contig, for this model's lead. The paths of a sequence's parts follow each other without gap; one may be empty. NoWords: see longpath.decode_parts.
    """
    words, number = Words(m), _number(letters)
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Few bytes but long work: the parts go to all tasks.
    parts = settle(parts.select(*[F.col(c).cast("long").alias(c) for c in ("seq_id", "part", "parts", "offset", "lead")], "obs").repartition(tasks, "seq_id", "part"))
    size = len(words.slot)

    def batches(frame):
        obs, leads = list(frame["obs"]), frame["lead"].to_numpy()
        if any(len(o) > SIZE + words.lead for o in obs):
            raise ValueError(f"a part has more than {SIZE} symbols")
        return _batches(words, obs, leads, number)

    def emitted(frame, rows, walk, slot):
        place, path, logp = map(list, zip(*walk.paths(slot)))
        ids, part, offset = (frame[c].to_numpy()[rows] for c in ("seq_id", "part", "offset"))
        return emit(ids, part, offset + np.array(place), path, logp)

    def alone(frames):
        for frame in frames:
            for rows, codes, lengths in batches(frame):
                walk = Walk(words, codes, lengths, np.tile(words.begin(), (len(rows), 1)), True)
                yield emitted(frame, rows, walk, np.full(len(rows), size))

    one = parts.where("parts = 1").mapInPandas(alone, schema)
    several = parts.where("parts > 1")
    if several.isEmpty():
        return one

    def moved(frames):
        for frame in frames:
            for rows, codes, lengths in batches(frame):
                yield pd.DataFrame({"seq_id": frame["seq_id"].to_numpy()[rows], "part": frame["part"].to_numpy()[rows], "data": [x.packed() for x in transfers(words, codes, lengths)]})

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

    levels = _levels(settle(several.mapInPandas(moved, "seq_id long, part long, data binary")), chained, fan)
    before = _down(levels, levels[-1].select("seq_id", "part", F.lit(bytearray(words.begin().tobytes())).alias("value")), starts, fan)
    several = settle(several.join(before, ["seq_id", "part"]).repartition(tasks, "seq_id", "part"))

    def walked(frame, rows, codes, lengths, ways):
        begin = np.stack([np.frombuffer(x, np.int64) for x in frame["value"].iloc[rows]])
        return Walk(words, codes, lengths, begin, ways)

    def origins(frames):
        for frame in frames:
            for rows, codes, lengths in batches(frame):
                walk = walked(frame, rows, codes, lengths, False)
                yield pd.DataFrame({"seq_id": frame["seq_id"].to_numpy()[rows], "part": frame["part"].to_numpy()[rows], "data": [x.astype(np.int64).tobytes() for x in walk.origin]})

    def after(data, slots):
        """Slots before a part of slots after it, one more for its best last state, -1 for none."""
        return np.where(slots < 0, -1, np.frombuffer(data, np.int64)[slots])

    def composed(datas):
        slots = np.frombuffer(datas[-1], np.int64)
        for d in reversed(datas[:-1]):
            slots = after(d, slots)
        return slots.tobytes()

    def ends(datas, value):
        slots, out = np.frombuffer(value, np.int64), []
        for d in reversed(datas):
            out.append(slots.tobytes())
            slots = after(d, slots)
        return out[::-1]

    maps = _levels(settle(several.mapInPandas(origins, "seq_id long, part long, data binary")), composed, fan)
    known = maps[-1].select("seq_id", "part", F.lit(bytearray(np.array([size], np.int64).tobytes())).alias("value"))
    last = _down(maps, known, ends, fan).withColumnRenamed("value", "slot")

    def traced(frames):
        for frame in frames:
            for rows, codes, lengths in batches(frame):
                slot = np.array([np.frombuffer(x, np.int64)[0] for x in frame["slot"].iloc[rows]])
                yield emitted(frame, rows, walked(frame, rows, codes, lengths, True), slot)

    return one.unionByName(several.join(last, ["seq_id", "part"]).repartition(tasks, "part", "seq_id").mapInPandas(traced, schema))


def paths(parts: DataFrame, m: Model, **kw) -> DataFrame:
    """seq_id, part, offset, path, logp (of the path's words; their sum is the sequence's)."""

    def emit(ids, part, offset, path, logp):
        return pd.DataFrame({"seq_id": ids, "part": part, "offset": offset, "path": path, "logp": logp})

    return decode(parts, m, emit, "seq_id long, part long, offset long, path array<int>, logp double", **kw)


def tips(parts: DataFrame, m: Model, size: int, **kw) -> DataFrame:
    """seq_id, head, tail: the first and the last `size` states of the sequences' paths; null where there is none."""

    def emit(ids, part, offset, path, logp):
        return pd.DataFrame({"seq_id": ids, "part": part, "head": [None if p is None else p[:size] for p in path], "tail": [None if p is None else p[-size:] for p in path]})

    d = decode(parts, m, emit, "seq_id long, part long, head array<int>, tail array<int>", **kw)
    d = d.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("part", "head", "tail"))).alias("x"))
    head, tail = (F.flatten(F.col(f"x.{c}")) for c in ("head", "tail"))
    return d.select("seq_id", F.slice(head, 1, size).alias("head"), F.slice(tail, F.greatest(F.size(tail) - size + 1, F.lit(1)), F.lit(size)).alias("tail"))


def runs(parts: DataFrame, m: Model, kind: list[int], **kw) -> DataFrame:
    """longpath.runs of the best paths; tasks send their runs, not their paths."""
    table = np.array(kind)

    def emit(ids, part, offset, path, logp):
        return own_runs(table, ids, offset, path)

    return joined_runs(settle(decode(parts, m, emit, "seq_id long, kind int, first long, last long, open boolean", **kw)))


def cut(seqs: DataFrame, m: Model, size: int = SIZE) -> DataFrame:
    """Parts of strings (seq_id, seq); empty ones have none. Letters are counted as bytes, so strings hold plain ones only."""
    lead, n = Words(m).lead, F.length("b")
    d = seqs.select("seq_id", F.col("seq").cast("binary").alias("b")).where(n > 0).withColumn("parts", F.floor((n - 1) / size) + 1)
    d = d.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    offset, own = F.col("part") * size, F.least(F.col("part") * size, F.lit(lead))
    return d.select("seq_id", "part", "parts", offset.alias("offset"), own.alias("lead"), F.substring("b", (offset - own + 1).cast("int"), (own + size).cast("int")).alias("obs"))


def contig(pieces: DataFrame, m: Model, size: int) -> DataFrame:
    """Parts of `size` symbols of the pieces (seq_id, offset, obs: plain letters) of longpath.one_contig. Slices of the pieces are shuffled."""
    lead = Words(m).lead
    n = F.length("obs")
    d = pieces.where(n > 0).select("seq_id", "offset", "obs")
    total = d.groupBy("seq_id").agg(F.max(F.col("offset") + n).alias("total"))
    d = d.join(F.broadcast(total), "seq_id")
    end = F.least(F.col("offset") + n - 1 + lead, F.col("total") - 1)
    d = d.withColumn("part", F.explode(F.sequence(F.floor(F.col("offset") / size).cast("long"), F.floor(end / size).cast("long"))))
    begin = F.greatest(F.col("part") * size - lead - F.col("offset"), F.lit(0))
    own = F.substring("obs", (begin + 1).cast("int"), ((F.col("part") + 1) * size - F.col("offset") - begin).cast("int"))
    d = d.select("seq_id", "part", "total", F.struct((F.col("offset") + begin).alias("at"), own.alias("x")).alias("x"))
    d = d.groupBy("seq_id", "part", "total").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    text = F.array_join(F.transform("xs", lambda x: x["x"]), "").cast("binary")
    return d.select("seq_id", "part", (F.floor((F.col("total") - 1) / size) + 1).alias("parts"), (F.col("part") * size).alias("offset"), F.least(F.col("part") * size, F.lit(lead)).alias("lead"), text.alias("obs"))
