"""Canonical exact fingerprints of documents, with DataFrame functions only.

A text's canonical form is NFKC, case folded, NFKC again, and every run of white space one space. Its fingerprint is
a 128-bit xxhash (two 64-bit hashes of different seeds, in hex). Documents meet by that hash; in each bucket the
least and the greatest canonical bytes are compared, and where they differ (a collision) the fingerprints of that
bucket are continued by a SHA-256, so unequal canonical texts never share one.

Nulls: a null text is the empty text; a null doc_id sorts below all others. Repeated rows are each a document; rows
of one doc_id stand in the order of their hashes. The only document of a table is its own next. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, settle, sha256


def _nfkc(c: Column) -> Column:
    # ICU comes with Spark; of its entry points this one takes and gives strings, as SQL's reflect() needs.
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))


def canonical(text: Column) -> Column:
    """NFKC, case and white space folding. ASCII texts, which NFKC leaves alone, take the short way."""
    text = F.coalesce(text, F.lit(""))
    fold = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _nfkc(text), F.lit(True))
    folded = F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(_nfkc(fold))
    return F.trim(F.regexp_replace(folded, r"[\x09-\x0D\x20\x85\x{1680}\x{2028}\x{2029}]+", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits in hex."""
    return F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(canon), F.xxhash64(F.lit("wide"), canon))]))


def collisions(digests: DataFrame) -> DataFrame:
    """Buckets (h) whose members' canonical bytes differ. digests: h, canon. Copies fold within each task before the shuffle."""
    several = digests.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    several = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    return digests.join(several, "h", "left_semi").groupBy("h").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b").select("h")


def _placed(docs: DataFrame, per_range: int) -> DataFrame:
    """docs with rng, the range of ids that holds a document: ranges are of one width, so their order is that of the ids."""
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if low is None:
        return docs.withColumn("rng", F.lit(-1).cast("long"))
    width = max(1.0, (high - low + 1) / max(1, n // per_range))
    return docs.withColumn("rng", F.coalesce(F.floor((F.col("doc_id").cast("double") - F.lit(float(low))) / F.lit(width)), F.lit(-1)))


def with_next(docs: DataFrame, what: list[str], tie: str, per_range: int = 500) -> DataFrame:
    """docs with next_<c> for c in what: the values of the document that follows in descending doc_id, after the last those of the first.

    Ranges of ids are windows of their own; each also gets a copy of the first document of the following range.
    """
    docs = _placed(docs, per_range)
    top = docs.groupBy("rng").agg(F.max(F.struct("doc_id", tie)).alias("top"))
    order = Window.orderBy(F.col("rng").desc())
    first = F.first("top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ghosts = top.select("rng", F.coalesce(F.lead("top").over(order), first).alias("top"))
    ghosts = ghosts.select(F.col("rng").alias("_rng"), F.col("top.doc_id").alias("_id"), F.col(f"top.{tie}").alias("_tie"))
    ghosts = F.broadcast(ghosts) if ghosts.count() <= BROADCAST_ROWS else ghosts
    copies = docs.join(ghosts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(tie) == F.col("_tie"))).withColumn("rng", F.col("_rng"))
    every = docs.withColumn("ghost", F.lit(0)).unionByName(copies.select(*docs.columns, F.lit(1).alias("ghost")))
    row = Window.partitionBy("rng").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col(tie).desc())
    return every.select("*", *[F.lead(c).over(row).alias(f"next_{c}") for c in what]).where("ghost = 0").drop("ghost", "rng")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fingerprint, h and canon_sha of every document."""
    d = docs.select("doc_id", canonical(F.col("text")).alias("canon"))
    d = d.select("doc_id", "canon", wide_hash(F.col("canon")).alias("h"))
    bad = collisions(d.select("h", "canon")).withColumn("bad", F.lit(True))
    return d.join(bad, "h", "left").select("doc_id", F.when(F.col("bad"), F.concat_ws("-", "h", sha256(F.col("canon")))).otherwise(F.col("h")).alias("fingerprint"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """The fingerprint of each document against those of its edited text and of the next document: 1 where they are equal, else 0."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), canonical(F.col("text")).alias("canon"))
    d = d.select("doc_id", "text", wide_hash(F.col("canon")).alias("h"), sha256(F.col("canon")).alias("sha"), F.xxhash64("text").alias("tie"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    d = with_next(d, ["text", "h", "sha"], "tie")
    d = d.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    d = d.withColumn("edited_canon", canonical(F.col("edited")))
    d = settle(
        d.select(
            "doc_id", "n_chars", sha256(F.col("edited")).alias("edited_sha256"), "h", "sha", wide_hash(F.col("edited_canon")).alias("edited_h"), sha256(F.col("edited_canon")).alias("edited_sha"),
            (F.col("h") == F.col("next_h")).cast("int").alias("same_h"), (F.col("sha") == F.col("next_sha")).cast("int").alias("same_sha"),
        )
    )
    # Byte comparison: the texts again, but only of documents whose hash others share.
    bad = settle(collisions(docs.select(canonical(F.col("text")).alias("canon")).select("canon", wide_hash(F.col("canon")).alias("h"))))
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    for name in ("", "edited_"):
        d = d.join(bad.select(F.col("h").alias(f"{name}bad")), F.col(f"{name}h") == F.col(f"{name}bad"), "left")
        whole = F.concat_ws("-", f"{name}h", f"{name}sha")
        d = d.withColumn(f"{name}fingerprint", F.when(F.col(f"{name}bad").isNotNull(), whole).otherwise(F.col(f"{name}h")))
    return d.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        ((F.col("h") == F.col("edited_h")) & (F.col("sha") == F.col("edited_sha"))).cast("double").alias("near_edited"),
        (F.col("same_h") * F.col("same_sha")).cast("double").alias("near_next"),
    )
