"""Interaction of filters: what each removes in every order, and its Shapley share, exactly.

A document's failures are a bit mask. Per part the documents are counted by mask, and from these counts the removals
of every coalition of filters: the documents that fail one of them at least. A step's counts are differences of two
coalitions. The Shapley values are the least squares fit of an additive game to the coalition removals under the Shapley kernel
and the constraint that all filters together account for all removals. Its normal equations are solved once in
rationals, for a unit removal of each coalition; as the solution is linear in the removals, Spark applies it to every part.

One filter may be "identical to a smaller doc_id's text": texts are grouped by SHA-256 and hot groups are summed where
they are read. Only digests, ids, parts and masks are shuffled, never texts.

Nulls: a null text is empty; a null part is the empty string; a row without a doc_id is nobody's smaller copy, is no copy
itself and has no labels. Rows given twice count twice and are no copies of each other. Several labels of a document count if one of them is 1; labels
of absent documents count for nothing. Very long texts are taken whole. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, settle

#: Failure conditions by letter, of a text and its words.
CHECKS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
    "C": lambda text, words: 100 * (F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))) > 5 * F.char_length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
COPIES = "E"
_SALT = 1024


def shapley_rows(n: int) -> list[list[int]]:
    """For each of n filters, what a unit of removals of each of the 2**n coalitions adds to n! times its Shapley value.

    Minimises the kernel-weighted squares of v(S) - v(empty) - the sum of x over S, where x sums to v(all) - v(empty).
    """
    every = (1 << n) - 1
    kernel = lambda s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count()))
    inner = range(1, every)
    rows = []
    for i in range(n):
        left = [sum((kernel(s) for s in inner if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)]
        right = [kernel(s) if s not in (0, every) and s >> i & 1 else Fraction(0) for s in range(every + 1)]
        right[0] -= sum(right)
        rows.append([*left, Fraction(1), *right])
    rows.append([*[Fraction(1)] * n, Fraction(0), *[Fraction((s == every) - (s == 0)) for s in range(every + 1)]])
    for c in range(n + 1):
        p = next(r for r in range(c, n + 1) if rows[r][c])
        rows[c], rows[p] = rows[p], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n + 1):
            if r != c and rows[r][c]:
                f = rows[r][c]
                rows[r] = [x - f * y for x, y in zip(rows[r], rows[c])]
    scaled = [[x * factorial(n) for x in row[n + 1 :]] for row in rows[:n]]
    assert all(x.denominator == 1 for row in scaled for x in row)
    return [[int(x) for x in row] for row in scaled]


def masked(docs: DataFrame, labels: DataFrame, checks=None, copies: str | None = COPIES, part: str = "source") -> DataFrame:
    """part, mask (bit i: fails the i-th filter, copies last), n, good, toxic: documents, and those labelled quality 1 and toxic 1."""
    checks = CHECKS if checks is None else checks
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    bits = [F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0) for i, fails in enumerate(checks.values())]
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)) if copies else F.lit(None).cast("binary")
    rows = rows.select("doc_id", "part", sum(bits, F.lit(0)).alias("mask"), digest.alias("digest"))
    rows = settle(rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")))
    if copies:
        first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
        again = F.col("first").isNull() & F.col("doc_id").isNotNull()
        rows = rows.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(again, 1 << len(checks)).otherwise(0))
    # Rows without a doc_id meet no label; the salt deals them out.
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(_SALT))).otherwise(F.lit(0).cast("long")))
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic")).withColumn("salt", F.lit(0).cast("long"))
    rows = rows.join(marks, ["doc_id", "salt"], "left")
    of = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("quality").alias("good"), of("toxic").alias("toxic"))


def removals(counts: DataFrame, n: int) -> DataFrame:
    """part, total, and arrays over all coalitions: all, good and toxic documents that each removes."""
    def of(c):
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(c)).otherwise(F.lit(0).cast("long"))) for s in range(1 << n)])

    return counts.groupBy("part").agg(F.sum("n").alias("total"), of("n").alias("gone"), of("good").alias("good"), of("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, checks=None, copies: str | None = COPIES, part: str = "source") -> DataFrame:
    """part, filter_order, step and the counts of that step, for every part, order and step."""
    letters = [*(CHECKS if checks is None else checks), *([copies] if copies else [])]
    n, every = len(letters), (1 << len(letters)) - 1
    table = removals(masked(docs, labels, checks, copies, part), n)
    plan = [
        {"filter_order": "".join(letters[i] for i in order), "step": k + 1, "at": order[k], "before": sum(1 << i for i in order[:k])}
        for order in permutations(range(n))
        for k in range(n)
    ]
    shares = [sum((F.get("gone", F.lit(s)) * w for s, w in enumerate(row) if w), F.lit(0).cast("long")) for row in shapley_rows(n)]
    rows = table.withColumn("shares", F.array(*shares))
    rows = rows.select("*", F.inline(F.from_json(F.lit(json.dumps(plan)), "array<struct<filter_order:string,step:int,at:int,before:int>>")))
    own = F.expr("shiftleft(1, at)")
    after = F.col("before").bitwiseOR(own)
    gained = lambda c: F.get(c, after) - F.get(c, F.col("before"))
    return rows.select(
        "part", "filter_order", "step",
        (F.col("total") - F.get("gone", after)).alias("kept"),
        gained("gone").alias("removed"),
        (F.get("gone", own) - gained("gone")).alias("redundant"),
        (F.get("gone", F.lit(every)) - F.get("gone", F.lit(every).bitwiseXOR(own))).alias("unique_fails"),
        gained("good").alias("good_lost"),
        gained("toxic").alias("toxic_lost"),
        F.get("shares", F.col("at")).alias("shapley"),
    )
