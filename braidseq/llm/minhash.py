"""MinHash near-duplicates of documents, candidates verified by odd sketches and then on whole shingle sets.

A document's set is its distinct 4-word shingles (five words and 0.8 are the general defaults; the query sets four).
256 minima per set make 25 bands of 5, and fold into a 512-bit odd sketch: each minimum flips one bit, so the
bits in which two sketches differ estimate the similarity, precisely where it is high. Documents of equal sets are
one class, whose smallest doc_id stands for it. In each band bucket the members are paired with the bucket's first,
not with one another; a pair goes on if its sizes and sketches allow the threshold, and becomes a link if the whole
sets confirm it. Buckets whose members are then in one component are done. In the others, members of different
components are held against each other, but only those whose shingles that any other such member shares are enough
for the threshold (in a family of copies with many edits each, that leaves few). So no link between different
components that share a bucket is left out. Two sets at 0.8 share a bucket with probability 1 - (1 - 0.8**5)**25,
above 0.9999; the sketches are let off by 0.11, about four deviations of their
estimate, in the second step and 0.2 in the first.

Nulls, empty texts and texts without words have the empty set and link with nothing. Rows of one doc_id (or none) with
different texts are documents of their own, those without a doc_id after all others; a component without any doc_id has none. With fewer words
than a shingle has, the whole sequence is one shingle. Repeated rows (one doc_id, one text) are one document and give one row each. Very long texts are taken whole. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, components, named, numbered, only, settle, without
from .units import U, Words, batches, grams, mix, whole

SAMPLES, BANDS, ROWS, BITS = 256, 25, 5, 512
#: Members of a crowded bucket that meet those of another block in one key, about.
BLOCK = 1024
SKETCH = tuple(f"s{i}" for i in range(BITS // 64))
_RNG = np.random.Generator(np.random.PCG64(20240501))
_A = (_RNG.integers(0, 2**31, SAMPLES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)
FEATURES = f"doc_id long, n_shingles long, k0 long, k1 long, {', '.join(f'{s} long' for s in SKETCH)}, bands array<long>"


def lower_ascii(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower() changes A-Z only


def shingle_sets(texts: list[bytes], words: int):
    """For each text its distinct shingles, sorted, as 64-bit hashes."""
    w = Words(texts)
    g = grams(w.hash, words)
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= words:
            s = np.sort(g[a : b - words + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            yield np.array([whole(w.hash[a:b])], U) if b > a else np.empty(0, U)


def minima(s: np.ndarray) -> np.ndarray:
    low = (s >> U(32)).astype(np.uint32)
    best = np.full(SAMPLES, 2**32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(low), 4096):
            best = np.minimum(best, (_A[:, None] * low[None, i : i + 4096] + _B[:, None]).min(axis=1))
    return best


def odd_sketch(m: np.ndarray) -> np.ndarray:
    at = mix(m.astype(U) + (np.arange(SAMPLES, dtype=U) << U(32))) & U(BITS - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m[: BANDS * ROWS].reshape(BANDS, ROWS).astype(U)
    key = np.arange(BANDS, dtype=U)
    for r in range(ROWS):
        key = mix(key ^ rows[:, r])
    return key.view(np.int64)


def features(docs: DataFrame, words: int) -> DataFrame:
    def run(frames):
        for frame in frames:
            for at in batches(frame["text"]):
                part = frame.iloc[at]
                out = []
                for doc_id, s in zip(part["doc_id"], shingle_sets(lower_ascii(part["text"]), words)):
                    m = minima(s)
                    with np.errstate(over="ignore"):
                        key = np.array([np.add.reduce(mix(s)), np.bitwise_xor.reduce(mix(s ^ U(0xABCD)))], U).view(np.int64)
                    out.append((doc_id, len(s), *key.tolist(), *odd_sketch(m).tolist(), band_keys(m) if len(s) else []))
                yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "k0", "k1", *SKETCH, "bands"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, FEATURES)


def likeness(a: str, b: str) -> Column:
    """Estimated similarity of two sketches."""
    apart = sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(len(SKETCH))), F.lit(0))
    return 1 + F.lit(BITS / (4 * SAMPLES)) * F.log(F.greatest(1 - 2 * apart / F.lit(BITS), F.lit(1e-9)))


def shingled(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc_id and set (sorted hashes of all its shingles) of the documents in ids."""

    def run(frames):
        for frame in frames:
            for at in batches(frame["text"]):
                part = frame.iloc[at]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "set": [s.view(np.int64) for s in shingle_sets(lower_ascii(part["text"]), words)]})

    return settle(only(docs.select("doc_id", "text"), ids, "doc_id").dropDuplicates(["doc_id"]).mapInPandas(run, "doc_id long, set array<long>"))


def verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose whole sets reach the threshold. Sets are made again, only for documents in pairs."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))

    sets = shingled(docs, ids, words)

    def count(frames):
        for frame in frames:
            keep = []
            for x, y in zip(frame["set_a"], frame["set_b"]):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield frame.loc[keep, ["a", "b"]]

    with_a = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")
    return with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b").mapInPandas(count, "a long, b long")


def _hopeful(pairs: DataFrame, reps: DataFrame, percent: int, slack: float) -> DataFrame:
    """Pairs (a, b) that their sizes and sketches allow. slack: how far an estimate may be off, about five of its deviations."""
    side = lambda x: reps.select(F.col("rep").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", *SKETCH)])
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent
    return p.where(sized & (likeness("a_s", "b_s") >= percent / 100 - slack)).select("a", "b")


def links(docs: DataFrame, feats: DataFrame, words: int, percent: int, slack: float = 0.2, close: float = 0.11) -> DataFrame:
    """Verified links (u, v) between class representatives, enough to connect all that the bands bring together."""
    reps = feats.where("n_shingles > 0")
    member = F.struct("doc_id", F.col("n_shingles").alias("n"), *SKETCH, "bands")
    reps = settle(reps.groupBy("n_shingles", "k0", "k1").agg(F.min(member).alias("m")).select(F.col("m.doc_id").alias("rep"), "m.n", *[f"m.{s}" for s in SKETCH], "m.bands"))
    slots = reps.select(F.posexplode("bands").alias("band", "bucket"), "rep")
    shared = slots.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("first")).where("size > 1")
    slots = settle(slots.join(shared, "bucket"))
    sketches = reps.drop("bands")
    pairs = slots.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    tried = settle(_hopeful(pairs, sketches, percent, slack))
    found = settle(verified(docs, tried, words, percent))
    joined = components(found, "a", "b")
    here = slots.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("band", "bucket", "rep", F.coalesce("component", "rep").alias("c"))
    still = here.groupBy("bucket").agg((F.min("c") != F.max("c")).alias("open")).where("open").select("bucket")
    here = settle(here.join(still, "bucket"))
    # What of a set stands in no other open set bounds every overlap that it can have.
    sets = shingled(docs, here.select(F.col("rep").alias("doc_id")), words)
    alone = sets.select("doc_id", F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")).where("n = 1").groupBy("rep").agg(F.count("*").alias("alone"))
    bound = reps.join(alone, "rep", "left").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    here = settle(here.join(bound, "rep").where(F.col("shared") * 100 >= F.col("n") * percent))
    # A crowded bucket is dealt into blocks, and each two blocks (or one and itself) meet under a key of their own.
    blocks = here.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    here = here.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = {"a": ("block", "other"), "b": ("other", "block")}
    side = lambda x: here.where("block <= other" if x == "a" else "other <= block").select("bucket", *[F.col(k).alias(to) for k, to in zip(place[x], ("lo", "hi"))], *[F.col(k).alias(f"{x}_{k}") for k in ("rep", "c", "n", "shared", "band", "bands", *SKETCH)])
    most = F.least("a_shared", "b_shared")
    once = (F.col("lo") < F.col("hi")) | (F.col("a_rep") < F.col("b_rep"))
    can = once & (F.col("a_c") != F.col("b_c")) & (most * 100 >= (F.col("a_n") + F.col("b_n") - most) * percent)
    more = side("a").join(side("b"), ["bucket", "lo", "hi"]).where(can & (likeness("a_s", "b_s") >= percent / 100 - close))
    # A pair of several common buckets counts in the first of them.
    more = more.where(~F.arrays_overlap(F.slice("a_bands", F.lit(1), F.col("a_band")), F.slice("b_bands", F.lit(1), F.col("b_band"))))
    more = settle(more.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    found = found.union(verified(docs, more, words, percent))
    return found.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _labelled(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id of documents whose ids differ."""
    feats = settle(features(docs, words))
    label = components(links(docs, feats, words, percent))
    base = feats.drop("bands", *SKETCH)
    classes = base.where("n_shingles > 0").groupBy("n_shingles", "k0", "k1").agg(F.min("doc_id").alias("rep"))
    classes = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("n_shingles", "k0", "k1", F.coalesce("component", "rep").alias("c"))
    return base.join(classes, ["n_shingles", "k0", "k1"], "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (it is the component's first document) of every document."""
    rows, names = numbered(docs, nulls_last=True)
    out = _labelled(rows.withColumnRenamed("d", "doc_id"), words, percent).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    if names is None:
        return out
    first = names.select(F.col("d").alias("component_id"), F.col("doc_id").alias("component"))
    out = named(out.join(first, "component_id").drop("component_id").withColumnRenamed("doc_id", "d"), names)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The first document of each component; all columns. Each row goes by its own doc_id and text."""
    rows, names = numbered(docs, nulls_last=True)
    gone = _labelled(rows.withColumnRenamed("d", "doc_id"), words, percent).where("doc_id <> component_id")
    if names is None:
        return without(docs, gone, "doc_id")
    gone = settle(names.join(gone.select(F.col("doc_id").alias("d")).distinct(), "d").select(F.col("doc_id").alias("_dup_id"), "_text_hash"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_dup_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_text_hash"))
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, same, "left_anti")
