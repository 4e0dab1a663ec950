"""Suffix-array dedup over bytes.

Anchors (see `seeds`) route the places where long strings may repeat: an anchor's occurrences of equal whole contexts
are settled there, the open ones go on as snippets of bytes. Snippets of one anchor go to one shard; an anchor with
more of them than a shard should hold is split over several. What of a snippet shares no stretch around its anchor with
another one can't repeat and is left out (see `aligned`). A shard's suffix array is made by Larsson-Sadakane
refinement in numpy (groups of equal rank are sorted by the rank a doubled distance on, single ones are left alone),
and its common prefixes by Kasai's algorithm, run in many lanes at once. Windows that share their whole length with a
neighbour in the array repeat. Shards of a split anchor also give the first of each of their distinct windows in runs sorted by
hash; binary search in the merged runs tells which of them other shards have too.

Nulls: a null text is empty; a null doc_id counts as the smallest. Empty and short texts lose nothing. Rows of one
doc_id (or none) with different texts are documents of their own; rows that agree in doc_id and text are one document given
twice and get the same result. Very long texts go through in
overlapping parts. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seeds
from .common import BROADCAST_ROWS, named, numbered, only, settle, shuffle_parts, written
from .units import U, batches, mix

_BYTE = mix(np.arange(256, dtype=U))
#: Bytes of snippets in a shard, and snippets that one anchor may put into one.
SHARD, SPLIT = 1_000_000, 1500
#: Stretches around an anchor that are compared before a shard's suffix array is made.
LEVELS = 8


def byte_grams(units: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k units, k a power of two, by doubling."""
    h, have, base = units, 1, U(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while have < k:
            h = h[:-have] * base + h[have:] if len(h) > have else h[:0]
            have, base = 2 * have, base * base
    return mix(h)


def _bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])


def _units(texts):
    a, first = _bytes(texts)
    return _BYTE[a], first


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a text of symbols 0..256; its end comes before all symbols."""
    n = len(symbols)
    key = np.zeros(n, U)
    padded = np.concatenate([symbols + 1, np.zeros(7, symbols.dtype)]).astype(U)
    for i in range(7):
        key = (key << U(9)) | padded[i : i + n]
    order = np.argsort(key)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    # The rank of a group is the place of its first member, so it stays when others are refined.
    head = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    have = 7
    heads = new
    while True:
        sizes = np.diff(np.append(head, n))
        tied = np.repeat(sizes > 1, sizes)
        at = np.flatnonzero(tied)
        if not len(at):
            break
        suffix = order[at]
        ahead = suffix + have
        then = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[suffix]
        pair = group.astype(U) * U(n + 1) + then.astype(U)
        o = np.argsort(pair)
        suffix, pair = suffix[o], pair[o]
        order[at] = suffix
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        begins = at[fresh]
        rank[suffix] = np.repeat(begins, np.diff(np.append(np.flatnonzero(fresh), len(at))))
        heads[begins] = True
        head = np.flatnonzero(heads)
        have *= 2
    return order


def kasai(symbols: np.ndarray, order: np.ndarray, left: np.ndarray, depth: int, lanes: int = 4096) -> np.ndarray:
    """Common prefix of each suffix in order with the one before it, at most depth and what is `left` of either before its end.

    Kasai's loop over text positions (the prefix of the next position is at least this one's less 1), run from many
    positions side by side; prefixes grow by eight bytes at a time.
    """
    n = len(symbols)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    data = np.concatenate([(symbols - 1).clip(0).astype(np.uint8), np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(data, (n + 1, 8), (1, 1))
    words = np.ascontiguousarray(eight).view("<u8").ravel()
    lcp = np.zeros(n, np.int64)
    step = -(-n // lanes)
    at = np.arange(0, n, step)
    h = np.zeros(len(at), np.int64)
    for _ in range(step):
        ok = at < n
        at, h = at[ok], h[ok]
        if not len(at):
            break
        where = place[at]
        prior = order[np.maximum(where - 1, 0)]
        most = np.where(where > 0, np.minimum(np.minimum(left[at], left[prior]), depth), 0)
        h = np.minimum(h, most)
        grow = np.flatnonzero(h < most)
        while len(grow):
            x = words[at[grow] + h[grow]] ^ words[prior[grow] + h[grow]]
            low = x & (~x + U(1))
            more = np.where(x == 0, 8, np.log2(np.maximum(low, U(1)).astype(np.float64)).astype(np.int64) // 8)
            h[grow] += more
            grow = grow[(more == 8) & (h[grow] < most[grow])]
        h = np.minimum(h, most)
        lcp[where] = h
        h = np.maximum(h - 1, 0)
        at = at + 1
    return lcp


def shard_repeats(snippets: list[bytes], m: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows that begin at the first m places of each snippet: snippet, place, and a class number, the same for equal windows."""
    sizes = np.fromiter(map(len, snippets), np.int64, len(snippets)) + 1
    base = np.cumsum(sizes) - sizes
    symbols = np.zeros(int(sizes.sum()), np.int16)
    raw = np.frombuffer(b"\0".join(snippets) + b"\0", np.uint8)
    symbols[:] = raw.astype(np.int16) + 1
    symbols[base + sizes - 1] = 0
    left = np.repeat(base + sizes - 1, sizes) - np.arange(len(symbols))
    order = suffix_array(symbols)
    lcp = kasai(symbols, order, left, length)
    snippet = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(symbols)) - np.repeat(base, sizes)
    classes = np.cumsum(lcp < length)
    keep = place[order] < m[snippet[order]]
    return snippet[order][keep], place[order][keep], classes[keep]


def aligned(pieces: list[bytes], group: np.ndarray, at: np.ndarray, m: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window (last < first: none) of each snippet that may equal one of another snippet of its group.

    at: where the anchor of k bytes begins in a snippet. A window holds the anchor, l bytes before it and r after, l + r the
    rest of its length; with s an eighth of that, it holds s * t bytes before and s * (7 - t) after, where t is l div s (7 at
    most). So equal windows agree in that stretch, and windows whose stretch no other snippet shares are left out.
    """
    rest = length - k
    levels = max(1, min(LEVELS, rest))
    s = max(1, rest // levels)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    base = np.cumsum(sizes) - sizes
    hashes = seeds.Ranges(_BYTE[np.frombuffer(b"".join(pieces), np.uint8)])
    t = np.arange(levels)
    lo, hi = at[:, None] - s * t, at[:, None] + k + s * (levels - 1 - t)
    ok = (lo >= 0) & (hi <= sizes[:, None])
    who, level = np.nonzero(ok)
    h = hashes.of(base[who] + lo[ok], base[who] + hi[ok])
    h = mix(h ^ mix(group.astype(U))[who]) + level.astype(U)
    _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
    shared = n[inverse] > 1
    least, most = np.full(len(pieces), levels), np.full(len(pieces), -1)
    np.minimum.at(least, who[shared], level[shared])
    np.maximum.at(most, who[shared], level[shared])
    first = np.where(most == levels - 1, 0, at - s * (most + 1) + 1).clip(0)
    last = np.minimum(at - s * least, m - 1)
    return first, np.where(most < 0, first - 1, last)


SHARDED = "d long, p long, w long, local boolean"


def repeats(docs: DataFrame, length: int = 400, k: int = 32, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Of docs (d, text): d, codes (whole runs of windows that occur elsewhere), windows (single ones), where there are any."""
    marks = settle(seeds.packed(seeds.seeds(docs, _units, length, k, True, byte_grams)))
    opened = marks.where(F.exists("codes", lambda c: c % 2 == 1))
    low = U((1 << seeds.BITS) - 1)

    def snippets(frames):
        for frame in frames:
            out = []
            for d, text, codes in zip(frame["d"], frame["text"], frame["codes"]):
                raw = text.encode("utf-8", "surrogatepass")
                for p, m in zip(*map(np.ndarray.tolist, seeds.unpacked(codes, 1))):
                    piece = raw[p : p + m - 1 + length]
                    g = byte_grams(_BYTE[np.frombuffer(piece[:length], np.uint8)], k) & ~low  # the anchor is the least of these
                    at = int(g.argmin())
                    out.append((int(g[at].view(np.int64)), d, p, m, at, piece))
            yield pd.DataFrame(out, columns=["a", "d", "p", "m", "at", "piece"])

    pieces = only(docs, opened, "d", limit).dropDuplicates(["d"]).join(opened, "d").mapInPandas(snippets, "a long, d long, p long, m int, at int, piece binary")
    pieces = written(pieces)
    # Anchors of very many snippets, few by their nature; they meet the snippets before any shuffle.
    wide = settle(pieces.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT))
    salt = F.coalesce(F.pmod(F.xxhash64("d", "p"), F.ceil(F.col("n") / SPLIT)), F.lit(-1)).alias("salt")
    dealt = pieces.join(F.broadcast(wide) if wide.count() <= limit else wide, "a", "left").select("a", salt, "d", "p", "m", "at", "piece")
    dealt = dealt.repartition(shuffle_parts(docs), "a", "salt").sortWithinPartitions("a", "salt")

    def sharded(frames):
        """Snippets in order of their anchors, in shards of about SHARD bytes; one anchor's stay together."""

        def shard(rows):
            split = rows["salt"].to_numpy() >= 0
            m, pieces = rows["m"].to_numpy(np.int64), list(rows["piece"])
            # All of a split anchor's windows go on to be merged.
            first, last = aligned(pieces, rows["a"].to_numpy(), rows["at"].to_numpy(np.int64), m, length, k)
            first, last = np.where(split, 0, first), np.where(split, m - 1, last)
            kept = np.flatnonzero(last >= first)
            if not len(kept):
                return None
            first, last, split = first[kept], last[kept], split[kept]
            pieces = [pieces[i][f : e + length] for i, f, e in zip(kept, first, last)]
            s, at, c = shard_repeats(pieces, last - first + 1, length)
            d, p = rows["d"].to_numpy(np.int64)[kept][s], (rows["p"].to_numpy(np.int64)[kept] + first)[s] + at
            new = np.concatenate([[True], c[1:] != c[:-1]])
            group = np.cumsum(new) - 1
            local = np.bincount(group)[group] > 1
            # A window that repeats here is settled; of a split anchor one of each kind goes on to be merged.
            on = np.flatnonzero(split[s] & new)
            w = np.zeros(len(d), np.int64)
            if len(on):
                sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
                begin = (np.cumsum(sizes) - sizes)[s[on]] + at[on]
                w[on] = seeds.Ranges(_BYTE[np.frombuffer(b"".join(pieces), np.uint8)]).of(begin, begin + length).view(np.int64)
            keep = local.copy()
            keep[on] = True
            return pd.DataFrame({"d": d, "p": p, "w": w, "local": local})[keep]

        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            while True:
                size = np.cumsum(held["piece"].map(len).to_numpy())
                edge = np.flatnonzero((held["a"].to_numpy()[1:] != held["a"].to_numpy()[:-1]) | (held["salt"].to_numpy()[1:] != held["salt"].to_numpy()[:-1])) + 1
                edge = edge[size[edge - 1] >= SHARD]
                if not len(edge):
                    break
                if (out := shard(held.iloc[: edge[0]])) is not None:
                    yield out
                held = held.iloc[edge[0] :].reset_index(drop=True)
        if held is not None and len(held) and (out := shard(held)) is not None:
            yield out

    found = settle(dealt.mapInPandas(sharded, SHARDED))

    def merged(frames):
        """Sorted runs of (w, d, p): a window repeats if binary search finds its hash more than once. What repeats in its shard is known."""
        held = None
        for frame in chain(frames, [None]):
            rows = held if frame is None else frame if held is None else pd.concat([held, frame], ignore_index=True)
            if rows is None or not len(rows):
                continue
            w = rows["w"].to_numpy()
            cut = len(w) if frame is None else np.searchsorted(w, w[-1], "left")
            part, held = rows.iloc[:cut], rows.iloc[cut:].reset_index(drop=True)
            w = part["w"].to_numpy()
            n = np.searchsorted(w, w, "right") - np.searchsorted(w, w, "left")
            yield part.loc[(n > 1) & ~part["local"].to_numpy(), ["d", "p"]]

    # A shard sends each of its windows once, so a hash comes as often as its anchor has shards.
    runs = found.where("w <> 0").repartition(shuffle_parts(docs), "w").sortWithinPartitions("w")
    across = runs.select("d", "p", "w", "local").mapInPandas(merged, "d long, p long")
    windows = found.where("local").select("d", "p").union(across).groupBy("d").agg(F.collect_list("p").alias("windows"))
    return settle(marks.where(F.exists("codes", lambda c: F.floor(c / 2) % 2 == 1)).join(windows, "d", "full"))


CUT = "d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cut(docs: DataFrame, length: int = 400, k: int = 32, texts: bool = True, limit: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if texts, kept: the bytes that stay."""
    docs, names = numbered(docs)
    marks = repeats(docs, length, k, limit)

    def run(frames):
        for frame in frames:
            out = []
            for d, text, codes, windows in zip(frame["d"], frame["text"], frame["codes"], frame["windows"]):
                raw = kept = text.encode("utf-8", "surrogatepass")
                spans = 0
                if codes is not None or windows is not None:
                    gone = seeds.covered(len(raw), length, codes, windows)
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
                out.append((d, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            yield pd.DataFrame(out, columns=["d", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    parts = [p.mapInPandas(run, CUT) for p in seeds.with_marks(docs, marks, limit)]
    out = named(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), names)
    return out if texts else out.drop("kept")
