"""Nucleotide strings as Column expressions. Bases are numbered a, c, g, t = 0..3, in either case; u counts as t."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start and stop codons, and the members of the ambiguity letters.
STARTS = ("ATG", "GTG", "TTG")
STOPS = ("TAA", "TGA", "TAG")
AMBIGUOUS = {"R": "AG", "Y": "CT", "K": "GT", "M": "AC", "S": "CG", "W": "AT", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def nt2int(c: Column) -> Column:
    """Number of a base, null for any other letter."""
    at = F.instr(F.lit("acgt"), F.translate(F.lower(c), "u", "t"))
    return F.when((F.char_length(c) == 1) & (at > 0), at - 1)


def int2nt(c: Column) -> Column:
    return F.when(c.between(0, 3), F.substring(F.lit("acgt"), c + 1, F.lit(1)))


def ints(seq: Column) -> Column:
    """Array of the numbers of a string's bases; other letters give null."""
    return F.transform(F.regexp_extract_all(seq, F.lit("(?s)."), F.lit(0)), nt2int)


def complement(seq: Column) -> Column:
    return F.translate(seq, "acgtuACGTU", "tgcaaTGCAA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def is_start(codon: Column) -> Column:
    return F.upper(codon).isin(*STARTS)


def is_stop(codon: Column) -> Column:
    return F.upper(codon).isin(*STOPS)


def codon_type(codon: Column) -> Column:
    return F.when(is_start(codon), "start").when(is_stop(codon), "stop").otherwise("genic")


def codon_id(codon: Column) -> Column:
    """n0 + 4 n1 + 16 n2 of a codon's bases."""
    n = [nt2int(F.substring(codon, i, 1)) for i in (1, 2, 3)]
    return n[0] + 4 * n[1] + 16 * n[2]


def codons(seq: Column, frame: int = 0) -> Column:
    """The whole codons of a string from an offset of 0, 1 or 2; fewer than three letters give an empty array. One pass over the string."""
    rest = F.substring(seq, frame + 1, 2**31 - 1) if frame else seq
    return F.coalesce(F.regexp_extract_all(rest, F.lit("(?s)..."), F.lit(0)), F.array().cast("array<string>"))


def only_bases(seq: Column) -> Column:
    """The letters a, c, g, t of any text, in lower case."""
    return F.regexp_replace(F.lower(seq), "[^acgt]++", "")


def resolve_ambiguous(seq: Column, seed: int = 0) -> Column:
    """Upper case, every ambiguity letter a member of its set, chosen by a hash of the place and the string; a gap is an error."""
    letters = F.regexp_extract_all(F.upper(seq), F.lit("(?s)."), F.lit(0))
    sets = F.create_map(*[F.lit(x) for kv in AMBIGUOUS.items() for x in kv])

    def one(c, i):
        members = F.element_at(sets, c)
        pick = F.pmod(F.xxhash64(F.lit(seed), seq, i), F.char_length(members)).cast("int") + 1
        gap = F.raise_error(F.lit("a sequence holds a gap"))
        return F.when(c == "-", gap).when(members.isNotNull(), F.substring(members, pick, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(letters, one), "")


def one_hot(base: Column) -> Column:
    n = nt2int(base)
    return F.array(*[(n == i).cast("double") for i in range(4)])


def region(seq: Column, idx1: Column, idx2: Column) -> Column:
    """Letters min..max of a string (from 1, both ends in), reverse complement where idx1 > idx2."""
    lo = F.least(idx1, idx2)
    part = F.substring(seq, lo.cast("int"), (F.abs(idx1 - idx2) + 1).cast("int"))
    return F.when(idx1 > idx2, reverse_complement(part)).otherwise(part)
