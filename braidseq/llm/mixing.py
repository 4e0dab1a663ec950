"""Mixing sources to target weights, with DataFrame functions only.

Every source's words, laid end to end in a fixed order of documents, are packed into blocks of a fixed length, which is
less for sources of few words.
Sources share the output by weight, no more than `most` times their own size (water filling). A source's target
is a number of blocks, by the words that they hold on average. The output is shards of a fixed number of slots; how many slots of each
shard a source draws is a multinomial draw, conditioned on the totals of the corpus, which are met exactly. A source's slots,
shard by shard, take its indices 0, 1, 2, ...; a pseudorandom permutation over the source's blocks maps index r to a block
of pass r div N, never a block twice in one pass. Slots and documents meet by (source, block).

Nulls: a null text has no words; null sources are one source, the last. Documents without words take nothing.
Repeated rows are packed one after the other, each as a document of its own. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settle, shuffle_parts

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
BLOCK = 32
ROUNDS = 2
#: Slots in an output shard.
PER_SHARD = 65_536
#: White space after a word, taken whole.
SPACE = r"[\x20\x09-\x0D]*+"


def permuted(x: Column, n: Column, salt: Column, inverse: bool = False, rounds: int = ROUNDS) -> Column:
    """Pseudorandom permutation of 0..n-1.

    A round turns the places by a hashed distance, then takes those of the largest rectangle a * b within n, a about the root of n,
    as (row, column) and moves rows by a hash of the column and columns by a hash of the row, twice each. Every step can be undone.
    """
    n = n.cast("long")
    a = F.greatest(F.lit(1), F.floor(F.sqrt(n.cast("double")))).cast("long")
    b = F.floor(n / a).cast("long")

    def moved(i):
        """One of a pair moves by a hash of the other, and they change sides."""

        def step(p, k):
            if inverse:
                by = F.xxhash64(i, k, salt, p["l"]) % p["w"]
                return F.struct(F.pmod(p["r"] - by, p["w"]).alias("l"), p["l"].alias("r"), p["w"].alias("m"), p["m"].alias("w"))
            by = F.xxhash64(i, k, salt, p["r"]) % p["m"]
            return F.struct(p["r"].alias("l"), F.pmod(p["l"] + by, p["m"]).alias("r"), p["w"].alias("m"), p["m"].alias("w"))

        return step

    def turned(x, i):
        turn = F.xxhash64(i, F.lit("turn"), salt) % n
        return F.pmod(x - turn if inverse else x + turn, n)

    def dealt(y, i):
        pair = F.struct(F.floor(y / b).cast("long").alias("l"), (y % b).alias("r"), a.alias("m"), b.alias("w"))
        halves = F.array(*[F.lit(k) for k in ((4, 3, 2, 1) if inverse else (1, 2, 3, 4))])
        return F.when(y < a * b, F.aggregate(halves, pair, moved(i), lambda p: p["l"] * b + p["r"])).otherwise(y)

    order = F.array(*[F.lit(i) for i in (range(rounds, 0, -1) if inverse else range(1, rounds + 1))])
    if inverse:
        return F.aggregate(order, x.cast("long"), lambda y, i: turned(dealt(y, i), i))
    return F.aggregate(order, x.cast("long"), lambda y, i: F.element_at(F.transform(F.array(turned(y, i)), lambda z: dealt(z, i)), 1))


def sized(docs: DataFrame) -> DataFrame:
    """docs with size, the number of words."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """From (source, size): source, sid, source_size, target. One row per source, so the windows are over sources only."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("sid", F.row_number().over(order).cast("long"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # Those whose cap is least for their weight fill first.
    before = Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    # All that are not full share one level: that of the first of them, which is the highest.
    shared = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return s.select("source", "sid", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * shared).alias("target"))


def length(block: int) -> Column:
    """Words in a block of a source: fewer where a source has so few that whole blocks could not meet its target."""
    return F.greatest(F.lit(1), F.least(F.lit(block), F.ceil(F.col("source_size") / block))).cast("long")


def packed(docs: DataFrame, weights=WEIGHTS, block: int = BLOCK, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Documents with their places, and sources with their numbers of blocks and draws.

    Places: doc_id, size, source_size, target, sid, start (words before it in its source). Prefix sums go over
    hashed buckets of each source first, so no window holds more than about the square root of all documents.
    """
    base = settle(sized(docs).select("doc_id", "source", "size", F.xxhash64("text").alias("text_hash")))
    sources = settle(targets(base, weights, most))
    buckets = max(1, int(base.count() ** 0.5))
    base = base.join(F.broadcast(sources) if sources.count() <= 100_000 else sources, base["source"].eqNullSafe(sources["source"])).drop("source")
    base = base.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "sid"), F.lit(buckets)))
    sums = base.groupBy("sid", "bucket").agg(F.sum("size").alias("s"))
    sums = sums.select("sid", "bucket", (F.sum("s").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("s")).alias("offset"))
    run = Window.partitionBy("sid", "bucket").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    places = base.withColumn("run", F.sum("size").over(run)).join(sums, ["sid", "bucket"])
    places = places.select("doc_id", "text_hash", "size", "source_size", "target", "sid", (F.col("offset") + F.col("run") - F.col("size")).alias("start"))
    first = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("n_blocks", F.ceil(F.col("source_size") / length(block)).cast("long"))
    # By true words: the last block is not full, so blocks hold source_size / n_blocks words on average.
    draws = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.select("sid", "n_blocks", draws.alias("draws"))
    return places, sources.withColumn("first", F.coalesce(F.sum("draws").over(first), F.lit(0)))


def shard_counts(sources: DataFrame, per_shard: int = PER_SHARD, chunk: int = 8192) -> DataFrame:
    """How many slots of each output shard every source draws: sid, n_blocks, shard, count, before (draws of the source in earlier shards).

    A source's draws are places `first`.. of one line of all draws; a permutation deals the line to the slots, `per_shard`
    of which are a shard. The counts of a shard are thus a multinomial draw of sources, conditioned on the corpus totals.
    The line is cut into chunks, counted where they are made; what is left is a row for each source and shard.
    """
    total = sources.agg(F.coalesce(F.sum("draws"), F.lit(0))).first()[0]
    spread = sources.where("draws > 0").withColumn("c", F.explode(F.sequence(F.lit(0), ((F.col("draws") - 1) / chunk).cast("long"))))
    spread = spread.repartition(shuffle_parts(sources), "sid", "c")
    line = spread.withColumn("r", F.explode(F.sequence(F.col("c") * chunk, F.least((F.col("c") + 1) * chunk, F.col("draws")) - 1)))
    slot = permuted(F.col("first") + F.col("r"), F.lit(int(total)), F.lit(-1))
    counts = line.groupBy("sid", "n_blocks", F.floor(slot / per_shard).alias("shard")).agg(F.count("*").alias("count"))
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))


def slots(counts: DataFrame) -> DataFrame:
    """The mix: one row per output slot, with shard, place (in its shard: a permuted number), sid, block (index in the source) and pass.

    The slots that a source drew in a shard take its next indices, one after the other; the permutation of the source's
    blocks maps an index to a block, each once in a pass.
    """
    each = counts.repartition(shuffle_parts(counts), "sid", "shard")
    each = each.withColumn("r", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("count") - 1)))
    block = permuted(F.col("r") % F.col("n_blocks"), F.col("n_blocks"), F.col("sid"))
    return each.select("sid", "shard", F.xxhash64("shard", "sid", "r").alias("place"), block.alias("block"), F.floor(F.col("r") / F.col("n_blocks")).alias("pass"))


def pieces(places: DataFrame, block: int = BLOCK) -> DataFrame:
    """Which words of a document are in which block: places' columns, block, lo, hi (words of the document, hi exclusive)."""
    block = length(block)
    start, end = F.col("start"), F.col("start") + F.col("size")
    parts = places.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(start / block), F.floor((end - 1) / block))))
    return parts.withColumn("lo", F.greatest(F.lit(0), F.col("block") * block - start)).withColumn("hi", F.least(F.col("size"), (F.col("block") + 1) * block - start))


def taken(docs: DataFrame, weights=WEIGHTS, block: int = BLOCK, most: int = 3, per_shard: int = PER_SHARD) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes, repeats counted), first_shard, last_shard of every document.

    first_shard and last_shard are the output shards that hold the first and the last of its words, null if none are taken.
    """
    places, sources = packed(docs, weights, block, most)
    places, sources = settle(places), settle(sources)
    # Joins by index of the block; a source's slots are as many rows as its blocks, so neither side is ever broadcast.
    drawn = slots(shard_counts(sources, per_shard)).groupBy("sid", "block").agg(F.count("*").alias("times"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    got = pieces(places.select("sid", "start", "size", "source_size"), block).hint("merge").join(drawn, ["sid", "block"])
    # A place is its source's and start: no two documents that have words share one.
    got = got.groupBy("sid", "start").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"), F.min("first_shard").alias("first_shard"), F.max("last_shard").alias("last_shard"))
    full = places.where("size > 0").hint("merge").join(got, ["sid", "start"], "left")
    none = places.where("size = 0").select("*", F.lit(0).cast("long").alias("taken"), *[F.lit(None).cast("long").alias(c) for c in ("first_shard", "last_shard")])
    taken = F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    return full.unionByName(none).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken, "first_shard", "last_shard")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, block: int = BLOCK, most: int = 3, per_shard: int = PER_SHARD, placed: bool = False) -> DataFrame:
    """The mix as documents: for each pass over a source, the words it takes of a document, with the white space between them.

    Columns of docs; doc_id repeats up to `most` times. placed: also mix_shard and mix_place, the shard and the place in it of
    the row's first slot, so that ordering by both gives the mix. Documents of which nothing is taken are absent.
    Rows that agree in doc_id and text get the same words. Document boundaries hold: a row has words of one document.
    """
    places, sources = packed(docs, weights, block, most)
    places, sources = settle(places), settle(sources)
    drawn = slots(shard_counts(sources, per_shard))
    got = pieces(places, block).hint("merge").join(drawn, ["sid", "block"])
    part = F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("parts")
    got = got.groupBy("doc_id", "text_hash", "sid", "start", "pass").agg(part, F.min(F.struct("shard", "place")).alias("at"))
    # Rows of one doc_id and text are one here: the first of them by its place.
    got = got.groupBy("doc_id", "text_hash", "pass").agg(F.min(F.struct("start", "parts", "at")).alias("x"))
    got = settle(got.select(F.col("doc_id").alias("_mix_id"), F.col("text_hash").alias("_mix_hash"), F.struct("x.parts", "x.at").alias("_mix")))
    rows = docs.hint("merge").join(got, F.col("doc_id").eqNullSafe(F.col("_mix_id")) & (F.xxhash64("text") == F.col("_mix_hash")))
    # Every word with the white space after it, the last one too; found once for a text and bound by the outer function.
    words = F.regexp_extract_all(F.concat("text", F.lit(" ")), F.lit(WORD + SPACE), F.lit(0))
    taken = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("_mix.parts", lambda p: F.slice(w, (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))), ""))
    rows = rows.withColumn("text", F.rtrim(F.element_at(taken, 1), F.lit(" \t\n\x0b\f\r")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    return rows.select(*docs.columns, *([F.col("_mix.at.shard").alias("mix_shard"), F.col("_mix.at.place").alias("mix_place")] if placed else []))
