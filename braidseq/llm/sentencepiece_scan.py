"""SentencePiece encoding and decoding by a max-plus parallel scan.

A segmentation's score is the sum of its pieces' scores; the best one is a path of greatest weight, so the step over a
stretch of text is a matrix over the max-plus semiring. Giant documents are split into chunks of a fixed length. A
boundary's state is how far past it the first cut lies; a chunk's transfer matrix holds the best score from each state
at its left boundary to each at its right. Matrices are combined associatively (prefixes by doubling), which gives the
states of the best path at all boundaries, and each chunk is then backtraced on its own between its two states.
No piece continues from another character into the space mark, so each stretch from space marks to space marks (a
unit) is a step of its own; within a chunk whole units come from a cache and only the two cut ones need all states.

The scan serves files of the unigram type, whose encoder seeks the best-scoring path. A file of the BPE type defines its
ids by merges in order of rank, which no sum of scores expresses: on the public BPE file the best-scoring path gave none
of 100 documents the ids of the file's own encoder. For such files a unit is encoded by its merges (exactly as the
library does); no merge crosses a unit's border, so giant documents are cut there, their parts encoded on their own and put
together in order. The README says so. Equal scores of the scan: the longest last piece
wins; at a boundary, the nearest cut.

Nulls are empty texts and have no ids. Repeated rows give one row each. A text that itself holds the space mark is
decoded with spaces, and its round_trip is false. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts
from .labelled import Lookup
from .units import batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
NONE = -np.inf


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[i]
        i, x, shift = i + 1, x | (c & 127) << shift, shift + 7
        if c < 128:
            return x, i


def _fields(b: bytes):
    """(number, value) of a protocol buffer message: ints, or bytes."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


@dataclass
class Pieces:
    """Of a model file: normal pieces with ids and scores, ids of the byte pieces, bytes of every id."""

    ids: dict
    scores: dict
    byte_ids: list
    raw: list
    longest: int
    unknown: float
    bpe: bool

    @classmethod
    def read(cls, data: bytes) -> Pieces:
        ids, scores, byte_ids, raw, bpe = {}, {}, [0] * 256, [], False
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                text, kind = f[1].decode(), f.get(3, 1)
                if kind == 1:
                    ids[text], scores[text] = len(raw), float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0])
                    raw.append(text.replace(MARK, " ").encode())
                elif kind == 6:
                    byte_ids[int(text[3:-1], 16)] = len(raw)
                    raw.append(bytes([int(text[3:-1], 16)]))
                else:
                    raw.append(b"")
            elif number == 2:
                bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2, b"") or f.get(4, 1):
                    raise ValueError("only models that keep the text as it is are supported")
        if any(MARK in t.lstrip(MARK) for t in ids):
            raise ValueError("a piece continues into the space mark")
        return cls(ids, scores, byte_ids, raw, max(map(len, ids)), min(scores.values()) - 10, bpe)

    def ending(self, text: str, e: int, least: int = 0):
        """(start, score) of the pieces of text that end at e, longest first; a character that is no piece is one of its own."""
        found = False
        for s in range(max(least, e - self.longest), e):
            w = self.scores.get(text[s:e])
            if w is not None:
                found = s == e - 1
                yield s, w
        if not found:
            yield e - 1, self.unknown

    def best(self, text: str) -> tuple[tuple, float]:
        """Ids and score of the best segmentation."""
        n = len(text)
        score, back = [0.0] + [NONE] * n, [0] * (n + 1)
        for e in range(1, n + 1):
            for s, w in self.ending(text, e):
                if score[s] + w > score[e]:
                    score[e], back[e] = score[s] + w, s
        cuts, e = [n], n
        while e:
            e = back[e]
            cuts.append(e)
        cuts.reverse()
        return self._numbers(text[a:b] for a, b in zip(cuts[:-1], cuts[1:])), score[n]

    def _numbers(self, parts) -> tuple:
        """Ids of pieces; a character that is none gives the ids of its bytes."""
        out = []
        for piece in parts:
            got = self.ids.get(piece)
            out += [got] if got is not None else [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        return tuple(out)

    def merged(self, unit: str) -> tuple:
        """Ids of a unit by merges: the neighbours whose union is the piece of highest score, the leftmost of equals, until there are none."""
        n = len(unit)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live, heap = [True] * n, []

        def offer(a: int, b: int):
            w = self.scores.get(unit[a : end[b]])
            if w is not None:
                heappush(heap, (-w, a, b, end[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, e = heappop(heap)
            if not (live[a] and live[b] and end[a] == b and end[b] == e):
                continue
            live[b] = False
            end[a] = e
            if e < n:
                before[e] = a
                offer(a, e)
            if before[a] >= 0:
                offer(before[a], a)
        return self._numbers(unit[i : end[i]] for i in range(n) if live[i])

    def bytes_of(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.bytes_of(ids).decode("utf-8", "surrogatepass")[1:]

    def transfer(self, text: str, size: int, last: bool, unit: Lookup) -> np.ndarray:
        """Matrix (states before, states after) of a chunk of `size` characters; text goes on past it by a piece's length less 1."""
        L = self.longest
        ends = size if last else min(len(text), size + L - 1)
        cuts = [m.end() for m in UNIT.finditer(text)][:-1]
        first = next((c for c in cuts if c >= L - 1), None)
        after = [c for c in cuts if c <= size]
        out = np.full((L, L), NONE)
        if first is not None and after and after[-1] >= first:
            left = self._from_all(text, 0, first, first)[:, first]
            middle = sum(unit[m.group()][1] for m in UNIT.finditer(text, first, after[-1]))
            # The last unit, cut by the boundary: from its begin alone.
            right = self._reach(text, after[-1], size, ends)
            return left[:, None] + middle + right[None, :]
        rows = self._from_all(text, 0, size, ends)
        out[:, : ends - size + 1] = rows[:, size : ends + 1]
        return out

    def _from_all(self, text: str, begin: int, size: int, ends: int) -> np.ndarray:
        """Best score from each of the first states to each place; places past size are reached by pieces that begin before it."""
        L = self.longest
        rows = np.full((L, ends + 1), NONE)
        for i in range(min(L, ends + 1)):
            rows[i, i] = 0.0
        for e in range(begin + 1, ends + 1):
            got = rows[:, e].copy()
            for s, w in self.ending(text, e, begin):
                if s < size:
                    np.maximum(got, rows[:, s] + w, out=got)
            # A path that begins at a later place than e has not begun.
            rows[:, e] = np.where(np.arange(L) < e, got, rows[:, e])
        return rows

    def _reach(self, text: str, begin: int, size: int, ends: int) -> np.ndarray:
        score = {begin: 0.0}
        for e in range(begin + 1, ends + 1):
            score[e] = max((score[s] + w for s, w in self.ending(text, e, begin) if s < size), default=NONE)
        out = np.full(self.longest, NONE)
        for e in range(size, ends + 1):
            out[e - size] = score.get(e, NONE)
        return out


class Merger:
    """Merges of many units at once. Symbols are the ids of the pieces, then characters that only occur within pieces; others are below 0."""

    def __init__(self, p: Pieces):
        symbols = dict(p.ids)
        for c in sorted(set().union(*p.ids) - symbols.keys()):
            symbols[c] = len(p.raw) + len(symbols) - len(p.ids)
        self.symbols, self.pieces, self.byte_ids = len(p.raw) + len(symbols) - len(p.ids), len(p.raw), p.byte_ids
        self.within = {s: c for c, s in symbols.items() if s >= len(p.raw)}
        self.chars = np.array(sorted(map(ord, (c for c in symbols if len(c) == 1))), np.int64)
        self.of_char = np.array([symbols[chr(c)] for c in self.chars], np.int64)
        pairs = {}
        for text, number in p.ids.items():
            for cut in range(1, len(text)):
                left, right = symbols.get(text[:cut]), symbols.get(text[cut:])
                if left is not None and right is not None:
                    pairs[left * self.symbols + right] = number
        self.keys = np.array(sorted(pairs), np.int64)
        self.union = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        score = np.zeros(len(p.raw))
        for text, number in p.ids.items():
            score[number] = p.scores[text]
        self.score = score[self.union]

    def _places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of neighbours, their place in the table of pairs, or -1."""
        key = np.where((left >= 0) & (right >= 0), left * self.symbols + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def all(self, units: list[str], one) -> dict[str, bytes]:
        """Ids, as bytes, of distinct units that are not empty. one gives the ids of a single long unit."""
        out, by = {}, {}
        for u in units:
            by.setdefault(next((n for n in WIDTHS if len(u) <= n), 0), []).append(u)
        for u in by.pop(0, []):
            out[u] = np.array(one(u), "<i4").tobytes()
        for group in by.values():
            self._side_by_side(group, out)
        return out

    def _side_by_side(self, group: list[str], out: dict):
        """Units of like lengths as rows of one matrix, padded. Each step merges one pair of every unit that has one left, so all that go on lose a column."""
        length = np.fromiter(map(len, group), np.int64, len(group))
        code = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
        row = np.full((len(group), int(length.max())), PAD)
        row[np.arange(row.shape[1]) < length[:, None]] = np.where(self.chars[at] == code, self.of_char[at], -1 - code)
        number, place = np.arange(len(group)), self._places(row[:, :-1], row[:, 1:])
        # The last score is that of no pair.
        score = np.append(self.score, NONE)[np.pad(place, ((0, 0), (0, 1)), constant_values=-1)]
        merged = 0
        while len(row):
            here, best = np.arange(len(row)), score.argmax(1)
            on = score[here, best] > NONE
            if not on.all():
                self._put(row[~on], number[~on], length[number[~on]] - merged, group, out)
                row, place, score, best, number = row[on], place[on], score[on], best[on], number[on]
                here = np.arange(len(row))
            if not len(row):
                break
            merged += 1
            width = row.shape[1] - 1
            row[here, best] = self.union[place[here, best]]
            stay = np.ones(row.shape, bool)
            stay[here, best + 1] = False
            row = row[stay].reshape(len(row), width)
            stay[here, best + 1], stay[here, best] = True, False
            place, score = place[stay[:, :-1]].reshape(len(row), width - 1), score[stay].reshape(len(row), width)
            for some, i in ((best > 0, best - 1), (best < width - 1, best)):
                some = np.flatnonzero(some)
                i = i[some]
                place[some, i] = p = self._places(row[some, i], row[some, i + 1])
                score[some, i] = np.where(p >= 0, self.score[p], NONE)

    def _put(self, rows: np.ndarray, number: np.ndarray, sizes: np.ndarray, group: list[str], out: dict):
        """Ids of finished rows; a character that is no piece gives the ids of its bytes."""
        plain = ((rows < self.pieces) & ((rows >= 0) | (rows == PAD))).all(1).tolist()
        data, step = rows.astype("<i4").tobytes(), 4 * rows.shape[1]
        for i, (k, size) in enumerate(zip(number.tolist(), sizes.tolist())):
            if plain[i]:
                out[group[k]] = data[i * step : i * step + 4 * size]
            else:
                ids = []
                for s in rows[i, :size].tolist():
                    ids += [s] if 0 <= s < self.pieces else self.bytes_of_char(chr(-1 - s) if s < 0 else self.within[s])
                out[group[k]] = np.array(ids, "<i4").tobytes()

    def bytes_of_char(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]


#: Units are merged side by side with others of like length; longer ones one by one, with a heap.
WIDTHS = (6, 9, 12, 18, 48)
#: What stands in a row after a unit's end: below any character.
PAD = -(1 << 30)


def units_of(marked: str) -> list[str]:
    """Units of a text that begins with the mark."""
    return UNIT.findall(marked) if MARK * 2 in marked else [MARK + w for w in marked[1:].split(MARK)]


class Coder:
    """Ids of lists of texts. Units are met again and again, so their ids are kept; as it is broadcast, a worker keeps them from task to task."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.merger = pieces, Merger(pieces) if pieces.bpe else None
        self.unit = Lookup(self.one, 600_000)

    def one(self, unit: str) -> bytes:
        return np.array(self.pieces.merged(unit) if self.merger else self.pieces.best(unit)[0], "<i4").tobytes()

    def ids(self, marked: list[str]) -> list[np.ndarray]:
        parts = [units_of(t) if t else [] for t in marked]
        if self.merger:
            new = [u for u in set().union(*parts) if not self.unit.holds(u)]
            self.unit.keep(self.merger.all(new, self.pieces.merged))
        return [np.frombuffer(b"".join(map(self.unit.__getitem__, units)), "<i4") for units in parts]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of (stacks of) matrices."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def boundary_states(matrices: np.ndarray) -> list[int]:
    """State of the best path at each chunk's right boundary, from the chunks' matrices, by doubling."""
    prefix, step = matrices.copy(), 1
    while step < len(prefix):
        prefix[step:] = times(prefix[:-step], prefix[step:])
        step *= 2
    states = [0]  # the end of the text is a cut
    for k in range(len(matrices) - 1, 0, -1):
        states.append(int(np.argmax(prefix[k - 1][0] + matrices[k][:, states[-1]])))
    return states[::-1]


ENCODED = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"


def encode(docs: DataFrame, model: bytes | None = None, chunk: int = 16_384) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (decoding the ids gives the text back) of every document."""
    if model is None:
        with open(MODEL, "rb") as f:
            model = f.read()
    pieces = Pieces.read(model)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # the model's fixed size
    L = pieces.longest
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.char_length("text")

    def ids_of(text, unit):
        return list(chain.from_iterable(map(unit.__getitem__, UNIT.findall(text))))

    coder = docs.sparkSession.sparkContext.broadcast(Coder(pieces))

    def short(frames):
        c = coder.value
        for frame in frames:
            # Ids leave the worker in small parts.
            for at in batches(frame["text"], 2_000_000):
                texts = frame["text"].iloc[at].tolist()
                ids = c.ids([MARK + t.replace(" ", MARK) if t else "" for t in texts])
                same = [c.pieces.decode(i.tolist()) == t for i, t in zip(ids, texts)]
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[at].to_numpy(), "n_tokens": list(map(len, ids)), "ids": ids, "round_trip": same}).astype({"doc_id": "Int64"})

    # Units are short steps, so parts between units can be longer than the chunks whose matrices are scanned.
    chunk = 4 * chunk if pieces.bpe else chunk
    long = docs.where(size > chunk).withColumn("key", F.xxhash64("doc_id", "text"))
    rows = long.groupBy("key").agg(F.count("*").alias("rows"))
    if pieces.bpe:
        return docs.where(size <= chunk).mapInPandas(short, ENCODED).unionByName(_by_units(long, rows, chunk, coder))
    # Giant documents: one row per chunk, with what follows it as far as a piece can reach. A rest shorter than a piece joins the chunk before it.
    n = F.greatest(F.lit(1), F.floor((size + 1 - L) / chunk) + F.when((size + 1 - L) % chunk > 0, 1).otherwise(0)).cast("int")
    chunks = long.dropDuplicates(["key"]).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    whole = F.concat(F.lit(MARK), F.replace("text", F.lit(" "), F.lit(MARK)))
    last = F.col("k") == F.col("n") - 1
    span = F.when(last, size + 1 - F.col("k") * chunk).otherwise(F.lit(chunk))
    chunks = chunks.select("doc_id", "key", "k", last.alias("last"), span.cast("int").alias("size"), F.substring(whole, F.col("k") * chunk + 1, F.when(last, span).otherwise(F.lit(chunk + L - 1)).cast("int")).alias("part"))
    chunks = chunks.repartition(shuffle_parts(docs), "key", "k")

    def transfers(frames):
        p = shared.value
        unit = Lookup(p.best)
        for frame in frames:
            made = [p.transfer(t, int(s), bool(e), unit).ravel() for t, s, e in zip(frame["part"], frame["size"], frame["last"])]
            yield pd.DataFrame({"key": frame["key"], "k": frame["k"], "matrix": made})

    def scan(frames):
        for frame in frames:
            out = []
            for key, parts in zip(frame["key"], frame["parts"]):
                parts = sorted(parts, key=lambda x: x["k"])
                after = boundary_states(np.array([x["matrix"] for x in parts], np.float64).reshape(len(parts), L, L))
                out += [(key, k, enter, leave) for k, (enter, leave) in enumerate(zip([0, *after], after))]
            yield pd.DataFrame(out, columns=["key", "k", "enter", "leave"])

    matrices = chunks.mapInPandas(transfers, "key long, k int, matrix array<double>").groupBy("key").agg(F.collect_list(F.struct("k", "matrix")).alias("parts"))
    states = matrices.mapInPandas(scan, "key long, k int, enter int, leave int")

    def backtrace(frames):
        p = shared.value
        unit = Lookup(lambda u: p.best(u)[0])
        for frame in frames:
            ids = [np.array(ids_of(t[a : s + b], unit), np.int32) for t, s, a, b in zip(frame["part"], frame["size"], frame["enter"], frame["leave"])]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "key": frame["key"], "k": frame["k"], "ids": ids}).astype({"doc_id": "Int64"})

    traced = chunks.join(states, ["key", "k"]).select("doc_id", "key", "k", "size", "part", "enter", "leave").mapInPandas(backtrace, "doc_id long, key long, k int, ids array<int>")
    whole_ids = traced.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))

    def check(frames):
        p = shared.value
        for frame in frames:
            same = [p.decode(i) == t for i, t in zip(frame["ids"], frame["text"])]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_tokens": frame["ids"].map(len), "ids": frame["ids"], "round_trip": same}).astype({"doc_id": "Int64"})

    texts = long.select("key", "text").dropDuplicates(["key"])
    full = whole_ids.join(texts, "key").join(rows, "key").withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    giant = full.select("doc_id", "ids", "text").mapInPandas(check, ENCODED)
    return docs.where(size <= chunk).mapInPandas(short, ENCODED).unionByName(giant)


def _by_units(long: DataFrame, rows: DataFrame, chunk: int, coder) -> DataFrame:
    """Giant documents for files of the BPE type: no merge crosses from one unit into the next, so they are cut between units and the parts encoded on their own."""

    def cut(frames):
        for frame in frames:
            for doc_id, key, text in zip(frame["doc_id"], frame["key"], frame["text"]):
                text = MARK + text.replace(" ", MARK)
                ends = [m.end() for m in UNIT.finditer(text)]
                begin, parts = 0, []
                for e in ends:
                    if e - begin >= chunk or e == len(text):
                        parts.append((doc_id, key, len(parts), text[begin:e]))
                        begin = e
                yield pd.DataFrame(parts, columns=["doc_id", "key", "k", "part"]).astype({"doc_id": "Int64"})

    def encoded(frames):
        c = coder.value
        for frame in frames:
            ids = c.ids(frame["part"].tolist())
            same = [c.pieces.bytes_of(i.tolist()) == t.replace(MARK, " ").encode() for i, t in zip(ids, frame["part"])]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "key": frame["key"], "k": frame["k"], "ids": ids, "same": same}).astype({"doc_id": "Int64"})

    parts = long.dropDuplicates(["key"]).select("doc_id", "key", "text").mapInPandas(cut, "doc_id long, key long, k int, part string")
    parts = parts.repartition(shuffle_parts(long), "key", "k").mapInPandas(encoded, "doc_id long, key long, k int, ids array<int>, same boolean")
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids")
    whole = parts.groupBy("key").agg(F.first("doc_id").alias("doc_id"), ids, F.min("same").alias("same"))
    marks = long.groupBy("key").agg(F.max(F.col("text").contains(MARK)).alias("marked"))
    full = whole.join(rows, "key").join(marks, "key").withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return full.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("same") & ~F.col("marked")).alias("round_trip"))


def decode(encoded: DataFrame, model: bytes | None = None) -> DataFrame:
    """encoded (doc_id, ids) with its texts; null ids are empty texts."""
    if model is None:
        with open(MODEL, "rb") as f:
            model = f.read()
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.read(model))

    def run(frames):
        for frame in frames:
            texts = [shared.value.decode(i) if i is not None else "" for i in frame["ids"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": texts}).astype({"doc_id": "Int64"})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
