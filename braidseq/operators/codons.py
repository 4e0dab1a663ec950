"""Codon and base statistics of sequence tables."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna


def base_counts(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """base, n over all sequences. Counted in each string first, so only four rows per task are shuffled."""
    parts = [F.sum((F.char_length(seq) - F.char_length(F.regexp_replace(F.lower(seq), b, ""))).cast("long")).alias(b) for b in "acgt"]
    wide = seqs.agg(*parts)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.coalesce(b, F.lit(0)).alias("n")) for b in "acgt"])).alias("x")).select("x.*")


def codon_counts(seqs: DataFrame, frame: int = 0, seq: str = "seq", by: list[str] | None = None) -> DataFrame:
    """Codons (upper case, letters A, C, G, T only) of one frame and how often. Without keys each task counts its own, so no row is made for a codon."""
    plain = F.col("codon").rlike("^[ACGT]{3}$")
    if not by:
        each = seqs.select(F.col(seq).alias("seq")).mapInPandas(_placed, "rest int, place int, codon string, n long")
        return each.where((F.col("place") == frame) & plain).groupBy("codon").agg(F.sum("n").alias("n"))
    words = seqs.select(*by, F.explode(dna.codons(F.upper(seq), frame)).alias("codon"))
    return words.where(plain).groupBy(*by, "codon").agg(F.count("*").alias("n"))


def six_frames(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """frame (1..3 direct, 4..6 reverse complement), codon, n, share of the frame.

    Codons are counted on the direct strand only. Read backwards, a string of n letters has from offset f the codons that begin
    at the places of n - f modulo 3, complemented; so the counts by place and n modulo 3 give the other three frames too.
    """
    each = seqs.select(F.col(seq).alias("seq")).mapInPandas(_placed, "rest int, place int, codon string, n long")
    each = each.groupBy("rest", "place", "codon").agg(F.sum("n").alias("n"))
    both = F.array(
        F.struct((F.col("place") + 1).alias("frame"), F.col("codon").alias("codon")),
        F.struct((F.pmod(F.col("rest") - F.col("place"), F.lit(3)) + 4).alias("frame"), F.upper(dna.reverse_complement(F.col("codon"))).alias("codon")),
    )
    counts = each.select(F.explode(both).alias("x"), "n").groupBy("x.frame", "x.codon").agg(F.sum("n").alias("n"))
    every = counts.groupBy("frame").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(every), "frame").select("frame", "codon", "n", (F.col("n") / F.col("total")).alias("share"))


def _placed(frames):
    """Codons by the length and by the place they begin at, both modulo 3; each task counts its own, so no row is made for a codon.

    Strings of plain letters are joined and counted as numbers, others one by one.
    """
    total, others = np.zeros(9 * 64, np.int64), Counter()
    for frame in frames:
        raws = [x.upper() for x in frame["seq"] if x]
        plain = [r for r in raws if r.isascii()]
        for r in (r for r in raws if not r.isascii()):
            others.update((len(r) % 3, at % 3, r[at : at + 3]) for at in range(len(r) - 2))
        sizes = np.array([len(r) for r in plain], np.int64)
        letters = np.frombuffer("".join(plain).encode(), np.uint8)
        if len(letters) < 3:
            continue
        begin = np.cumsum(sizes) - sizes
        number = _BASE[letters]
        key = (number[:-2].astype(np.int16) * 4 + number[1:-1]) * 4 + number[2:]
        place = ((np.arange(len(letters)) % 3).astype(np.int16) - np.repeat((begin % 3).astype(np.int16), sizes)) % 3
        rest = np.repeat((sizes % 3).astype(np.int16), sizes)
        whole = np.arange(len(letters) - 2) + 3 <= np.repeat(begin + sizes, sizes)[:-2]
        known = np.maximum(np.maximum(number[:-2], number[1:-1]), number[2:]) < 4
        use = np.flatnonzero(whole & known)
        total += np.bincount((rest[use].astype(np.int64) * 3 + place[use]) * 64 + key[use], minlength=9 * 64)
        for at in np.flatnonzero(whole & ~known).tolist():
            others[int(rest[at]), int(place[at]), letters[at : at + 3].tobytes().decode()] += 1
    out = [(k // 192, k // 64 % 3, "".join("ACGT"[k % 64 // d % 4] for d in (16, 4, 1)), int(total[k])) for k in np.flatnonzero(total).tolist()]
    yield pd.DataFrame([*out, *((*k, n) for k, n in others.items())], columns=["rest", "place", "codon", "n"])


#: Number of a base's letter, 4 for others.
_BASE = np.full(256, 4, np.uint8)
_BASE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def valid_genes(seqs: DataFrame, seq: str = "seq", codons: bool = True, letters: bool = True, thirds: bool = True) -> DataFrame:
    """Regions of whole codons that begin with a start and end with a stop, of plain letters."""
    s = F.col(seq)
    out = seqs.where(F.char_length(s) % 3 == 0) if thirds else seqs
    out = out.where(dna.is_start(F.substring(s, 1, 3)) & dna.is_stop(F.substring(s, -3, 3))) if codons else out
    return out.where(F.upper(s).rlike("^[ACGT]*$")) if letters else out


def interior(seq: str = "seq"):
    """A gene without its start and its stop; '' if there is nothing between."""
    return F.substring(F.col(seq), F.lit(4), F.greatest(F.char_length(seq) - 6, F.lit(0)))
