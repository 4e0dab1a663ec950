"""Labelled rows for the two classifiers: the fold that is held out, and bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, y and text of at most per_class labelled rows of each class that are not held out, those of least hash; and the classes' full counts.

    Labels that are null or of documents that are absent count for nothing; of several labels of a document the greatest holds.
    """
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    y = y.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    y = settle(y.join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi"))
    counts = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [y.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = settle(parts[0].union(parts[1]))
    # per_class bounds the ids, so they are always small enough to broadcast.
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), counts


class Lookup(dict):
    """A bounded cache of what a function gives for a word, in two generations: when one is full, the words not asked for since the last time go."""

    def __init__(self, of, most: int = 300_000):
        super().__init__()
        self.of, self.most, self.before = of, most // 2, {}

    def __missing__(self, word):
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        value = self.before.get(word, self)
        if value is self:
            value = self.of(word)
        self[word] = value
        return value

    def holds(self, word) -> bool:
        return word in self or word in self.before

    def keep(self, values: dict):
        """Take in values that were found together."""
        if len(self) + len(values) > self.most:
            self.before = dict(self)
            self.clear()
        self.update(values)
