"""Gaps between genes: how many and how long, models whose states are a ladder of their lengths, and the search for a loop.

Lengths are counted in Spark, those of `rungs` and more together, so what comes to the driver is as long as the ladder. Candidate
models of a search are all scored in one pass over the held-out sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..plans.models import PENALTY, Model
from . import hmm, intervals, longpath, words
from .state import settle

UNIFORM = (0.25,) * 4


def count_gaps(features: DataFrame, contigs: DataFrame) -> DataFrame:
    """contig_id, direct, reverse: a gap for each gene of the strand, and one more where room is left after the strand's last.

    features: contig_id, idx1, idx2. contigs: contig_id, len. Overlaps of genes are not looked at. A contig without genes of a strand has one gap if it has
    two places at least.
    """
    d = intervals.spans(features)
    ends = d.groupBy("contig_id").agg(
        F.count_if(~F.col("reverse")).alias("n_direct"), F.count_if("reverse").alias("n_reverse"),
        F.max_by(F.when(~F.col("reverse"), F.col("hi")), F.when(~F.col("reverse"), F.struct("lo", "hi"))).alias("last"),
        F.min_by(F.when(F.col("reverse"), F.col("lo")), F.when(F.col("reverse"), F.struct("lo", "hi"))).alias("first"),
    )
    both = contigs.select("contig_id", "len").join(ends, "contig_id", "left")
    room = F.when(F.coalesce(F.col("last") + 1, F.lit(1)) < F.col("len"), 1).otherwise(0)
    back = F.when(F.coalesce(F.col("first") - 1, F.col("len")) > 1, 1).otherwise(0)
    return both.select("contig_id", (F.coalesce("n_direct", F.lit(0)) + room).alias("direct"), (F.coalesce("n_reverse", F.lit(0)) + back).alias("reverse"))


def hazards(gaps: DataFrame, rungs: int, size: str = "len") -> DataFrame:
    """rung (1..rungs), n, reached, hazard, mean: gaps that end at a length (the last rung: of it and more), those as long at least, their share, and the mean length of those that end."""
    rung = F.least(F.col(size), F.lit(rungs)).cast("int")
    n = gaps.where(F.col(size) > 0).groupBy(rung.alias("rung")).agg(F.count("*").alias("n"), F.avg(size).alias("mean"))
    # At most `rungs` rows, each set against the longer ones.
    longer = n.select(F.col("rung").alias("other"), F.col("n").alias("m"))
    every = n.join(F.broadcast(longer), F.col("other") >= F.col("rung")).groupBy("rung", "n", "mean").agg(F.sum("m").alias("reached"))
    return every.select("rung", "n", "reached", (F.col("n") / F.col("reached")).alias("hazard"), "mean")


def ladder(rows: list[dict], bases=UNIFORM, prefix: str = "intergenic_") -> Model:
    """A state for each length: rung i is left for the silent end with its hazard, else for rung i + 1; the last rung loops to give its mean length.

    rows: those of hazards. The gaps' lengths have the counted distribution, and a geometric one from the last rung on.
    """
    found = {r["rung"]: r for r in rows}
    if not found:
        raise ValueError("no gap")
    n = max(found)
    a = np.zeros((n + 2, n + 2))
    a[0, 1] = a[n + 1, n + 1] = 1.0
    for i in range(1, n):
        h = found[i]["hazard"] if i in found else 0.0
        a[i, n + 1], a[i, i + 1] = h, 1 - h
    leave = 1 / (1 + max(found[n]["mean"] - n, 0.0))
    a[n, n], a[n, n + 1] = 1 - leave, leave
    a[n + 1] = 0
    b = np.array([np.zeros(4), *[np.array(bases, float)] * n, np.zeros(4)])
    return Model.of(np.eye(n + 2)[0], a, b, names=(f"{prefix}begin", *[f"{prefix}{i}" for i in range(1, n + 1)], f"{prefix}end"))


def lanes(rungs: int, bases=UNIFORM, prefix: str = "intergenic_") -> Model:
    """Three lanes of `rungs`: states that emit once, states that loop, and silent ones that skip. Each state shares its mass evenly among its ways on.

    A way to the next rung leads to the end from the last one, so lengths from 1 up are possible and those near `rungs` likely.
    """
    names = [f"{prefix}begin", f"{prefix}wait", *[f"{prefix}{lane}_{i}" for i in range(1, rungs + 1) for lane in ("skip", "loop", "step")], f"{prefix}end"]
    at, a = {n: i for i, n in enumerate(names)}, np.zeros((len(names), len(names)))

    def ways(source, *targets):
        for t in targets:
            a[at[f"{prefix}{source}"], at[f"{prefix}{t}"]] += 1 / len(targets)

    ways("begin", "wait", "step_1", "skip_1")
    ways("wait", "wait", "step_1")
    for i in range(1, rungs + 1):
        on = [f"skip_{i + 1}", f"step_{i + 1}"] if i < rungs else ["end", "end"]
        ways(f"step_{i}", f"loop_{i}", *on)
        ways(f"loop_{i}", f"loop_{i}", f"skip_{i}", *on)
        ways(f"skip_{i}", *on)
    speaks = [("loop" in n or "step" in n or n.endswith("wait")) for n in names]
    return Model.of(np.eye(len(names))[0], a, np.outer(speaks, bases), names=tuple(names))


def ring(gene: Model, gap: Model) -> Model:
    """Gap and gene in turn: from the gap's silent end to the gene's beginning and from the gene's end (its third state) to the gap's. Begins in the gap."""
    g, n = gap.n, gap.n + gene.n
    a = np.zeros((n, n))
    a[:g, :g], a[g:, g:] = gap.a[0], gene.a[0]
    a[g - 1, :] = 0
    a[g - 1, g] = 1.0
    a[g + 2, 0] = 1.0
    return Model.of(np.eye(n)[0], a, np.concatenate([gap.b, gene.b]), names=(*gap.names, *gene.names)).without_silent()


def best_value(held: DataFrame, build: Callable[[float], Model], step: float = 0.01, least: float = 1e-5, score: Callable | None = None) -> tuple[float, float]:
    """The value between 0 and 1 whose model scores best on held-out sequences, and that score; the smallest of equals.

    Equal sequences are scored once and weighed. First all multiples of `step`, then ten times finer around the best, down to `least`. All models of a round are scored in one pass: by the
    sum of log-likelihoods (impossible sequences cost PENALTY), or by score(models), which gives a number for each.
    """
    weight = F.col("weight") if "weight" in held.columns else F.lit(1.0)
    # Few rows but long work: the kinds go to all tasks.
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = settle(held.groupBy("obs").agg(F.sum(weight).alias("weight"), F.min("seq_id").alias("seq_id")).repartition(tasks, "seq_id")) if score is None else None

    def likelihood(models):
        d = hmm.scores(kinds, models).join(kinds.select("seq_id", "weight"), "seq_id").groupBy("model_id").agg(F.sum(F.col("weight") * F.coalesce("logp", F.lit(PENALTY))).alias("s"))
        return {r["model_id"]: r["s"] for r in d.collect()}

    values, best = [round(step * i, 9) for i in range(1, round(1 / step))], None
    while True:
        got = (score or likelihood)({i: build(v) for i, v in enumerate(values)})
        best = max((got[i], -v) for i, v in enumerate(values) if i in got)
        step /= 10
        if step < least * 0.999:
            return -best[1], best[0]
        values = [v for v in (round(-best[1] + step * i, 9) for i in range(-10, 11)) if 0 < v < 1]


def genic_check(genes: DataFrame, m: Model, seq: str = "seq") -> DataFrame:
    """One row: genes that begin with a start, end with a stop and have plain letters only; of these those of whole codons and others; and how many of each the model reads as one gene: its path begins in a start and ends in a stop.

    m: a model of one gene whose states are named by start_ and stop_ (see genefinder.genic).
    """
    s = F.upper(F.col(seq))
    good = genes.where(dna.is_start(F.substring(s, 1, 3)) & dna.is_stop(F.substring(s, -3, 3)) & s.rlike("^[ACGT]+$") & (F.char_length(s) > 5))
    good = good.select("seq_id", (F.char_length(s) % 3 == 0).alias("thirds"), s.alias("seq"))
    kinds = np.array([1 if n.startswith("start") else 2 if n.startswith("stop") else 0 for n, silent in zip(m.names, m.silent) if not silent])
    kind = F.array(*[F.lit(int(k)) for k in kinds])
    d = good.select("seq_id", "thirds").join(_tips(good, m), "seq_id")
    ends = lambda x, k: F.forall(x, lambda i: F.get(kind, i) == k)
    found = F.coalesce(ends("head", 1) & ends("tail", 2), F.lit(False))
    d = d.select("thirds", found.alias("found"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return d.agg(F.count("*").alias("good"), n(F.col("thirds")).alias("len3"), n(~F.col("thirds")).alias("not_len3"), n(F.col("found")).alias("found"), n(F.col("found") & F.col("thirds")).alias("found_len3"), n(F.col("found") & ~F.col("thirds")).alias("found_not_len3"))


def _tips(genes: DataFrame, m: Model) -> DataFrame:
    """seq_id, head, tail: the first and the last three states of the genes' best paths; null where there is none."""
    try:
        return words.tips(words.cut(genes, m), m, 3)
    except words.NoWords:
        paths = longpath.decode_parts(longpath.cut(genes.select("seq_id", dna.ints(F.col("seq")).alias("obs"))), m).groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("part", "path"))).alias("parts"))
        paths = paths.select("seq_id", F.flatten(F.transform("parts", lambda p: p["path"])).alias("path"))
        return paths.select("seq_id", F.slice("path", 1, 3).alias("head"), F.slice("path", -3, 3).alias("tail"))
