"""The gene finder: models from codon statistics, decoding of contigs, and the score of what was found."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from ..plans.models import Model
from . import codons, intervals, longpath, words
from .state import settle

BASES = "ACGT"


def dumb_intergenic(gap_length: float, bases=(0.25,) * 4) -> Model:
    """One state whose loop gives the gaps' mean length."""
    return Model.of([1.0], [[1 - 1 / (gap_length + 1)]], [list(bases)], names=("intergenic",))


def genic(counts: dict[str, int], starts: dict[str, int], stops: dict[str, int]) -> Model:
    """A chain of three states per start, codon and stop, weighted by their counts, around silent centres."""
    names, rows = ["begin", "center", "end"], [np.zeros(4)] * 3
    edges = {}

    def chain(kind, source, target, table):
        total = sum(table.values())
        for word, n in sorted(table.items()):
            first = len(names)
            for i, c in enumerate(word):
                names.append(f"{kind}_{word}{i}")
                rows.append(np.eye(4)[BASES.index(c)])
            edges[source, first] = n / total
            edges[first, first + 1] = edges[first + 1, first + 2] = 1.0
            edges[first + 2, target] = 1.0

    chain("start", 0, 1, starts)
    codon_total, genes = sum(counts.values()), max(sum(starts.values()), 1)
    chain("codon", 1, 1, counts)
    leave = genes / (codon_total + genes)
    for k in [k for k in edges if k[0] == 1]:
        edges[k] *= 1 - leave
    first_stop = len(names)
    chain("stop", 1, 2, stops)
    for (s, t), p in list(edges.items()):
        if s == 1 and t >= first_stop:
            edges[s, t] = p * leave
    a = np.zeros((len(names), len(names)))
    for (s, t), p in edges.items():
        a[s, t] = p
    return Model.of(np.eye(len(names))[0], a, np.array(rows), names=tuple(names))


def joined(gene: Model, gap: Model, leave_gap: float, silent: bool = False) -> Model:
    """Gaps and genes in turn; starts in the gap. silent: with the gene's silent centres, which make long decoding faster."""
    n, g = gene.n, gap.n
    a = np.zeros((n + g, n + g))
    a[:g, :g] = gap.a[0] * (1 - leave_gap)
    a[:g, g] = leave_gap
    a[g:, g:] = gene.a[0]
    a[g + 2, 0] = 1.0
    m = Model.of(np.eye(n + g)[0], a, np.concatenate([gap.b, gene.b]), names=(*gap.names, *gene.names))
    return m if silent else m.without_silent()


def statistics(genes: DataFrame, seq: str = "seq") -> tuple[dict, dict, dict]:
    """Codons inside valid genes, starts and stops with their counts (64 rows at most each)."""
    good = codons.valid_genes(genes, seq)
    inner = codons.codon_counts(good.select(codons.interior(seq).alias("seq")))
    head = good.groupBy(F.upper(F.substring(seq, 1, 3)).alias("codon")).agg(F.count("*").alias("n"))
    tail = good.groupBy(F.upper(F.substring(seq, -3, 3)).alias("codon")).agg(F.count("*").alias("n"))
    return tuple({r["codon"]: r["n"] for r in d.collect()} for d in (inner, head, tail))


def find(contigs: DataFrame, m: Model, size: int = longpath.SIZE) -> DataFrame:
    """contig_id, idx1, idx2 of the genes on both strands; reverse ones in forward coordinates with idx1 > idx2.

    Contigs (contig_id, seq) may be of any length: strands are cut into parts of `size` bases and decoded by a scan over parts.
    """
    strands = contigs.select("contig_id", F.char_length("seq").alias("len"), F.explode(F.array(F.struct(F.lit(False).alias("reverse"), F.col("seq").alias("s")), F.struct(F.lit(True).alias("reverse"), dna.reverse_complement(F.col("seq")).alias("s")))).alias("x"))
    strands = strands.select("contig_id", "len", "x.reverse", "x.s").withColumn("seq_id", F.xxhash64("contig_id", "reverse"))
    parts = strands.where("len > 0").select("seq_id", "s", F.explode(F.sequence(F.lit(0), F.floor((F.col("len") - 1) / size).cast("int"))).alias("part"))
    bases = dna.ints(F.substring(F.col("s"), F.col("part") * size + 1, F.lit(size)))
    # A letter that is no base is a missing symbol.
    parts = settle(parts.select("seq_id", F.col("part").cast("long").alias("part"), F.transform(bases, lambda x: F.coalesce(x, F.lit(m.symbols))).alias("obs")))
    runs = genes_of(longpath.decode_parts(parts, m).withColumn("offset", F.col("part") * size), m).join(strands.drop("s"), "seq_id")
    first, last = F.col("first") + 1, F.col("last") + 1
    return runs.select("contig_id", F.when(F.col("reverse"), F.col("len") - first + 1).otherwise(first).alias("idx1"), F.when(F.col("reverse"), F.col("len") - last + 1).otherwise(last).alias("idx2"))


def genes_of(paths: DataFrame, m: Model) -> DataFrame:
    """seq_id, first, last (places from 0) of the runs of states that are not of a gap, of paths in parts."""
    return longpath.runs(paths, _genic(m)).where("kind = 1").drop("kind")


def genes_in(parts: DataFrame, m: Model) -> DataFrame:
    """genes_of the best paths of strings in parts (see words)."""
    return words.runs(parts, m, _genic(m)).where("kind = 1").drop("kind")


def _genic(m: Model) -> list[int]:
    return [int(not n.startswith("intergenic")) for n, s in zip(m.names, m.silent) if not s]


def evaluate(truth: DataFrame, found: DataFrame, width: int = 10_000) -> DataFrame:
    """By strand: genes in truth and found, matched one to one by falling score, and how well they agree (see intervals.agreement)."""
    keys = ["contig_id", "reverse"]
    t, f = (intervals.spans(d).withColumn("id", F.row_number().over(Window.partitionBy(*keys).orderBy("lo", "hi"))).select(*keys, "id", "lo", "hi") for d in (truth, found))
    t, f = settle(t), settle(f)
    pairs = intervals.assigned(t, f, keys, "id", width)
    m = pairs.groupBy("reverse").agg(F.count("*").alias("matched"), F.count_if(F.col("score") == 1).alias("exact"), F.sum("score").alias("score"))
    counts = t.groupBy("reverse").agg(F.count("*").alias("annotated")).join(f.groupBy("reverse").agg(F.count("*").alias("predicted")), "reverse", "full")
    agree = intervals.agreement(t, f, pairs, keys, "id", ["reverse"]).drop("perfect").withColumnRenamed("score", "net_score")
    return counts.join(m, "reverse", "left").join(agree, "reverse", "left").na.fill(0)


def best_cut(features: DataFrame, wanted: float) -> DataFrame:
    """contig_id, at: the place between features whose share of the features before it is nearest to `wanted`, ties to the first.

    A running maximum of ends finds the places that nothing covers.
    """
    order = Window.partitionBy("contig_id").orderBy("lo", "hi")
    d = intervals.spans(features).withColumn("before", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("k", F.row_number().over(order) - 1)
    d = d.withColumn("n", F.count("*").over(Window.partitionBy("contig_id"))).where(F.col("before") + 1 < F.col("lo"))
    near = F.struct(F.abs(F.col("k") / F.col("n") - wanted).alias("d"), "k", (F.col("before") + 1).alias("at"), (F.col("k") / F.col("n")).alias("share"))
    return d.groupBy("contig_id").agg(F.min(near).alias("x")).select("contig_id", "x.at", "x.share")
