"""Registered queries over the given tables, with the SQL that states the same results.

Symbol streams are event types per user in order of (ts, event_id); value streams are the events' values; letters
a, c, g, t of the documents' texts serve as nucleotide strings; intervals are orders of a customer in days.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna, numeric
from ..operators import codons, discriminative, gapmodels, genefinder, hmm, intervals, longpath, pairs, profiles, sampling, selection, sequences, switching, training, words
from ..operators.state import settle
from ..sources import text
from . import models
from .models import Model

#: The alphabet of the event streams and two models over it.
TYPES = ("click", "error", "purchase", "signup", "view")
CALM = Model.of([0.6, 0.4], [[0.9, 0.1], [0.2, 0.8]], [[0.4, 0.1, 0.2, 0.1, 0.2], [0.1, 0.4, 0.1, 0.2, 0.2]], names=("calm", "busy"), prior=0.5)
BRISK = Model.of([0.5, 0.5], [[0.5, 0.5], [0.5, 0.5]], [[0.2, 0.2, 0.2, 0.2, 0.2], [0.3, 0.1, 0.3, 0.1, 0.2]], names=("even", "mixed"), prior=0.5)
GAUSS = Model.of([0.5, 0.5], [[0.8, 0.2], [0.3, 0.7]], c=[[1.0], [1.0]], mu=[[20.0], [60.0]], var=[[400.0], [900.0]])
#: A silent state between two that speak.
PAUSED = Model.of([1.0, 0.0, 0.0], [[0.7, 0.3, 0.0], [0.0, 0.0, 1.0], [0.4, 0.0, 0.6]], [[0.4, 0.1, 0.2, 0.1, 0.2], [0.0] * 5, [0.1, 0.4, 0.1, 0.2, 0.2]], names=("talk", "pause", "answer"))


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_seqs(spark, sf_dir, most: int | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1).cast("int").alias("sym"))
    seqs = sequences.build(e, "user_id", ["ts", "event_id"], F.col("sym"))
    return seqs.withColumn("obs", F.slice("obs", 1, most)) if most else seqs


def value_seqs(spark, sf_dir) -> DataFrame:
    return sequences.build(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], F.col("value").cast("double"))


def strings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", dna.only_bases(F.col("text")).alias("seq"))


def stays(spark, sf_dir) -> DataFrame:
    """Per customer the days from an order to 30 days later, shorter for cheap ones: idx1 > idx2 where the status is F."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long").alias("a"), "o_totalprice", "o_orderstatus")
    b = F.col("a") + F.least(F.lit(90), F.floor(F.col("o_totalprice") / 3000)).cast("long")
    back = F.col("o_orderstatus") == "F"
    return o.select(F.col("o_custkey").alias("contig_id"), F.col("o_orderkey").alias("feature_id"), F.when(back, b).otherwise(F.col("a")).alias("idx1"), F.when(back, F.col("a")).otherwise(b).alias("idx2"))


def nt_counts(spark, sf_dir):
    s = strings(spark, sf_dir)
    return codons.base_counts(s).withColumn("strand", F.lit("direct")).unionByName(codons.base_counts(s.select(dna.reverse_complement(F.col("seq")).alias("seq"))).withColumn("strand", F.lit("reverse"))).select("strand", "base", "n")


def nt_shares(spark, sf_dir):
    return strings(spark, sf_dir).groupBy("lang").agg(*[F.round(F.sum(F.char_length("seq") - F.char_length(F.replace("seq", F.lit(b), F.lit("")))) / F.sum(F.char_length("seq")), 9).alias(f"share_{b}") for b in "acgt"])


def codon_frames(spark, sf_dir):
    d = codons.six_frames(strings(spark, sf_dir))
    return d.select("frame", "codon", "n", F.round("share", 9).alias("share"))


def codon_rollup(spark, sf_dir):
    words = strings(spark, sf_dir).select("lang", F.explode(dna.codons(F.upper("seq"))).alias("codon"))
    return words.rollup("lang", "codon").agg(F.count("*").alias("n"))


def revcomp_start_stop(spark, sf_dir):
    s = F.col("seq")
    return strings(spark, sf_dir).select("doc_id", dna.is_start(F.substring(s, 1, 3)).alias("starts"), dna.is_stop(F.substring(s, -3, 3)).alias("stops"), F.md5(dna.reverse_complement(s).cast("binary")).alias("rc_md5"))


def codon_types(spark, sf_dir):
    words = strings(spark, sf_dir).select(F.explode(dna.codons(F.col("seq"), 1)).alias("codon"))
    return words.groupBy("codon").agg(F.count("*").alias("n")).select("codon", dna.codon_id(F.col("codon")).cast("int").alias("id"), dna.codon_type(F.col("codon")).alias("type"), "n")


def event_sequences(spark, sf_dir):
    return event_seqs(spark, sf_dir).select("seq_id", F.size("obs").alias("len"), F.array_max("obs").alias("max_symbol"), F.concat_ws("", F.transform("obs", lambda x: x.cast("string"))).alias("word"))


def sequence_profile(spark, sf_dir):
    return sequences.profile(event_seqs(spark, sf_dir))


def gap_lengths(spark, sf_dir):
    g = intervals.gaps(stays(spark, sf_dir), ["contig_id"]).withColumn("len", F.col("gap_end") - F.col("gap_start") + 1)
    return g.agg(F.count("*").alias("n"), F.min("len").alias("least"), F.max("len").alias("most"), F.count_if(F.col("len").between(*intervals.SHORT)).alias("short"), F.count_if(F.col("len") >= intervals.LONG[0]).alias("long"))


def gap_list(spark, sf_dir):
    return intervals.gaps(stays(spark, sf_dir), ["contig_id"])


def contained(spark, sf_dir):
    return intervals.within(stays(spark, sf_dir), 9000, 9500).groupBy("contig_id").agg(F.count("*").alias("n"))


def lengths_by_strand(spark, sf_dir):
    d = intervals.spans(stays(spark, sf_dir))
    return d.groupBy("reverse").agg(F.count("*").alias("n"), F.floor(F.avg(intervals.length())).alias("mean_length"))


def mirrored(spark, sf_dir):
    d = intervals.mirror(stays(spark, sf_dir), F.lit(20000))
    return d.groupBy("contig_id").agg(F.min(F.least("idx1", "idx2")).alias("lo"), F.max(F.greatest("idx1", "idx2")).alias("hi"))


def islands_by_type(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    runs = intervals.islands(e, ["user_id"], ["ts", "event_id"], "event_type")
    return runs.groupBy("event_type", "length").agg(F.count("*").alias("n")).withColumnRenamed("length", "run_length")


def _two_sets(spark, sf_dir):
    d = intervals.spans(stays(spark, sf_dir)).select("contig_id", "feature_id", "lo", "hi")
    return d.where("feature_id % 2 = 0"), d.where("feature_id % 2 = 1")


def overlap_pairs(spark, sf_dir):
    a, b = _two_sets(spark, sf_dir)
    pairs = intervals.overlaps(a, b, ["contig_id"], 64)
    return pairs.select("contig_id", "feature_id", "r_feature_id", F.round(intervals.score(), 9).alias("score"))


def overlap_match(spark, sf_dir):
    a, b = _two_sets(spark, sf_dir)
    m = intervals.matched(a, b, ["contig_id"], "feature_id", 64)
    return m.select("contig_id", "feature_id", "r_feature_id", F.round("score", 9).alias("score"))


def unmatched(spark, sf_dir):
    a, b = _two_sets(spark, sf_dir)
    return a.join(intervals.matched(a, b, ["contig_id"], "feature_id", 64), ["contig_id", "feature_id"], "left_anti").groupBy("contig_id").agg(F.count("*").alias("n"))


def _one_set(spark, sf_dir):
    return intervals.spans(stays(spark, sf_dir)).select("contig_id", "feature_id", "lo", "hi")


def overlap_pairs_whole(spark, sf_dir):
    """Overlaps among all stays; overlap_pairs, overlap_match and unmatched are kept as their SQL states them, even against odd orders."""
    d = _one_set(spark, sf_dir)
    pairs = intervals.overlaps(d, d, ["contig_id"], 64).where("feature_id < r_feature_id")
    return pairs.select("contig_id", "feature_id", "r_feature_id", F.round(intervals.score(), 9).alias("score"))


def overlap_match_whole(spark, sf_dir):
    m = intervals.matched(_one_set(spark, sf_dir), None, ["contig_id"], "feature_id", 64)
    return m.select("contig_id", "feature_id", "r_feature_id", F.round("score", 9).alias("score"))


def unmatched_whole(spark, sf_dir):
    d = _one_set(spark, sf_dir)
    m = intervals.matched(d, None, ["contig_id"], "feature_id", 64)
    both = m.select("contig_id", F.explode(F.array("feature_id", "r_feature_id")).alias("feature_id"))
    return d.join(both, ["contig_id", "feature_id"], "left_anti").groupBy("contig_id").agg(F.count("*").alias("n"))


def shipped(spark, sf_dir) -> DataFrame:
    """Per customer and order the days from its first to its last shipping."""
    at = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("contig_id"), F.col("o_orderkey").alias("feature_id"))
    return o.join(d, F.col("feature_id") == F.col("l_orderkey")).select("contig_id", "feature_id", "lo", "hi")


def greedy_match(spark, sf_dir):
    """Stays against shippings of a customer, one to one by falling score."""
    m = intervals.assigned(_one_set(spark, sf_dir), settle(shipped(spark, sf_dir)), ["contig_id"], "feature_id", 64)
    return m.select("contig_id", "feature_id", "r_feature_id", F.round("score", 9).alias("score"))


def match_agreement(spark, sf_dir):
    a, b = _one_set(spark, sf_dir), settle(shipped(spark, sf_dir))
    m = settle(intervals.assigned(a, b, ["contig_id"], "feature_id", 64))
    d = intervals.agreement(a, b, m, ["contig_id"], "feature_id", ["contig_id"])
    return d.withColumn("score", F.round("score", 6))


def plotted(spark, sf_dir):
    """Each user's values as text for plotting."""
    return value_seqs(spark, sf_dir).select("seq_id", text.gnu_text().alias("lines"))


def listed_symbols(spark, sf_dir):
    return event_seqs(spark, sf_dir).select("seq_id", text.mathematica_text().alias("line"))


def xml_symbols(spark, sf_dir):
    seqs = event_seqs(spark, sf_dir).withColumn("label", F.when(F.col("seq_id") % 3 > 0, F.col("seq_id") % 3))
    return seqs.select("seq_id", text.xml_text("%d").alias("line"))


def uncovered_cuts(spark, sf_dir):
    d = intervals.spans(stays(spark, sf_dir))
    ends = d.select("contig_id", (F.col("hi") + 1).alias("at")).distinct()
    return intervals.uncovered(ends, d, ["contig_id"], 64)


def transition_counts(spark, sf_dir):
    g = sequences.grams(event_seqs(spark, sf_dir), 2).select(F.get("gram", F.lit(0)).alias("src"), F.get("gram", F.lit(1)).alias("dst"), "n")
    return g.select("src", "dst", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("src")), 9).alias("p"))


def kgram_background(spark, sf_dir):
    g = sequences.grams(event_seqs(spark, sf_dir), 3)
    every = spark.range(125).select(*[F.floor(F.col("id") / 5**i % 5).cast("int").alias(f"s{2 - i}") for i in range(3)])
    got = g.select(*[F.get("gram", F.lit(i)).alias(f"s{i}") for i in range(3)], "n")
    d = every.join(got, ["s0", "s1", "s2"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    return d.select("s0", "s1", "s2", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("s0", "s1")), 9).alias("p"))


def forward_loglik(spark, sf_dir):
    return hmm.loglik(event_seqs(spark, sf_dir), CALM).select("seq_id", F.round("logp", 6).alias("logp"))


def forward_loglik_fold(spark, sf_dir):
    return hmm.forward_fold(event_seqs(spark, sf_dir), CALM).select("seq_id", F.round("logp", 6).alias("logp"))


def backward_loglik(spark, sf_dir):
    return hmm.backward_loglik(event_seqs(spark, sf_dir), CALM).select("seq_id", F.round("logp", 6).alias("logp"))


def silent_loglik(spark, sf_dir):
    return hmm.loglik(event_seqs(spark, sf_dir), PAUSED).select("seq_id", F.round("logp", 6).alias("logp"))


def viterbi_logp(spark, sf_dir):
    return hmm.decode(event_seqs(spark, sf_dir), CALM).select("seq_id", F.round("logp", 6).alias("logp"))


def viterbi_states(spark, sf_dir):
    d = hmm.decode(event_seqs(spark, sf_dir), CALM)
    return d.select("seq_id", F.concat_ws("", F.transform("path", lambda x: x.cast("string"))).alias("path"))


def posterior_states(spark, sf_dir):
    return hmm.posterior(event_seqs(spark, sf_dir, 20), CALM).select("seq_id", "pos", "state", F.round("p", 6).alias("p"))


def posterior_states_whole(spark, sf_dir):
    """posterior_states on whole sequences; the other one is kept as its SQL states it, on the first 20 events."""
    return hmm.posterior(event_seqs(spark, sf_dir), CALM).select("seq_id", "pos", "state", F.round("p", 6).alias("p"))


def model_scores(spark, sf_dir):
    return hmm.scores(event_seqs(spark, sf_dir), {0: CALM, 1: BRISK}).select("seq_id", "model_id", F.round("logp", 6).alias("logp"))


def best_model(spark, sf_dir):
    d = hmm.classify(event_seqs(spark, sf_dir), {0: CALM, 1: BRISK})
    return d.select("seq_id", "model_id", F.round("posterior", 6).alias("posterior"))


def set_likelihood(spark, sf_dir):
    d = hmm.loglik(event_seqs(spark, sf_dir), CALM)
    return d.agg(F.round(F.sum(F.coalesce("logp", F.lit(models.PENALTY))), 4).alias("total"), F.count_if(F.col("logp").isNull()).alias("impossible"))


def gauss_loglik(spark, sf_dir):
    return hmm.loglik(value_seqs(spark, sf_dir), GAUSS).select("seq_id", F.round("logp", 5).alias("logp"))


def normal_densities(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", F.col("value").cast("double").alias("value"))
    return d.select("event_id", F.round(numeric.normal_density(F.col("value"), F.lit(50.0), F.lit(900.0)), 9).alias("density"))


def em_one_step(spark, sf_dir):
    m = training.maximized(CALM, training.expected(event_seqs(spark, sf_dir), CALM))
    t = models.tables(spark, {0: m})
    a = t["transitions"].select(F.lit("a").alias("kind"), F.col("src").alias("i"), F.col("dst").alias("j"), "p")
    b = t["emissions"].select(F.lit("b").alias("kind"), F.col("state").alias("i"), F.col("symbol").alias("j"), "p")
    return a.unionByName(b).select("kind", "i", "j", F.round("p", 6).alias("p"))


def em_trained(spark, sf_dir):
    m, logp = training.baum_welch(event_seqs(spark, sf_dir), CALM)
    return models.tables(spark, {0: m})["transitions"].withColumn("logp", F.lit(float(logp)))


def gauss_trained(spark, sf_dir):
    m, _ = training.baum_welch(value_seqs(spark, sf_dir), GAUSS)
    return models.tables(spark, {0: m})["components"]


def model_clusters(spark, sf_dir):
    _, labels = training.cluster(event_seqs(spark, sf_dir), [CALM, BRISK])
    return labels.groupBy("model_id").agg(F.count("*").alias("n"), F.sum("logp").alias("logp"))


def model_mixture(spark, sf_dir):
    fitted, logp = training.mixture(event_seqs(spark, sf_dir), [CALM, BRISK])
    return spark.createDataFrame([(k, float(m.prior), float(logp)) for k, m in enumerate(fitted)], "model_id int, prior double, logp double")


def sampled_like_users(spark, sf_dir):
    """A drawn sequence for every user, as long as the user's own."""
    own = event_seqs(spark, sf_dir).select("seq_id", F.size("obs").alias("len"))
    return sampling.generate(own, CALM).select("seq_id", F.size("obs").alias("len"), F.array_max("states").alias("last_state"))


def pair_alignments(spark, sf_dir):
    """Each user's symbols against the next user's, with states match, x only, y only."""
    s = event_seqs(spark, sf_dir).select("seq_id", F.col("obs").alias("x"))
    pairs = s.join(s.select((F.col("seq_id") - 1).alias("seq_id"), F.col("x").alias("y")), "seq_id")
    # Few bytes but long work: the pairs go to all tasks.
    pairs = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    a = np.array([[0.8, 0.1, 0.1], [0.7, 0.3, 0.0], [0.7, 0.0, 0.3]])
    return hmm.align(pairs, a, np.array([0.8, 0.1, 0.1]), [(1, 1), (1, 0), (0, 1)], _pair_emission).select("seq_id", F.size("path").alias("len"), "logp")


def _pair_emission(state, x, y):
    return (0.16 if x[0] == y[0] else 0.01) if state == 0 else 0.2


def mean_sequence(spark, sf_dir):
    return sequences.mean_sequence(value_seqs(spark, sf_dir), 50).select(F.col("pos").alias("pos"), F.round("mean", 6).alias("mean"), "n")


def mean_sequence_whole(spark, sf_dir):
    """mean_sequence to the end of the longest sequence; the other one is kept as its SQL states it, for 50 positions."""
    return sequences.mean_sequence(value_seqs(spark, sf_dir)).select("pos", F.round("mean", 6).alias("mean"), "n")


def scatter_matrix(spark, sf_dir):
    return sequences.scatter(value_seqs(spark, sf_dir), 8).select("i", "j", F.round("s", 4).alias("s"), "n")


def scatter_matrix_whole(spark, sf_dir):
    """scatter_matrix of all positions; the other one is kept as its SQL states it, for 8 positions."""
    return sequences.scatter(value_seqs(spark, sf_dir)).select("i", "j", F.round("s", 4).alias("s"), "n")


def bernoulli_split(spark, sf_dir):
    return sequences.split(table(spark, sf_dir, "events").select("event_id"), "event_id", 0.7).groupBy("part").agg(F.count("*").alias("n"))


def model_normalize(spark, sf_dir):
    """Transition rows from counts of pairs of event types, a model for each type of the first event of a user."""
    e = event_seqs(spark, sf_dir).where(F.size("obs") > 1)
    pairs = e.select(F.get("obs", F.lit(0)).alias("model_id"), F.explode(F.expr("transform(sequence(1, size(obs) - 1), i -> struct(obs[i - 1] as src, obs[i] as dst))")).alias("x"))
    t = pairs.groupBy("model_id", F.lit(0).alias("class"), F.col("x.src").alias("src"), F.col("x.dst").alias("dst")).agg(F.count("*").cast("double").alias("p"))
    return models.normalized_transitions(t).select("model_id", "src", "dst", F.round("p", 9).alias("p"))


def base_vectors(spark, sf_dir):
    v = F.array(*[(F.char_length("seq") - F.char_length(F.replace("seq", F.lit(b), F.lit("")))).cast("double") for b in "acgt"])
    d = strings(spark, sf_dir).select("doc_id", v.alias("v"))
    m = F.array(*[F.array(*[F.lit(float(i == j) + 1.0) for j in range(4)]) for i in range(4)])
    return d.select("doc_id", F.round(numeric.total("v"), 6).alias("total"), F.round(F.get(numeric.normalize(F.col("v")), F.lit(0)), 9).alias("share_a"), F.round(F.get(numeric.times(m, F.col("v")), F.lit(1)), 6).alias("product_c"))


def codon_model(spark, sf_dir):
    """The gene finder's model of codons from all documents' strings: transition mass by kind of its source."""
    from ..operators import genefinder

    counts = {r["codon"]: r["n"] for r in codons.codon_counts(strings(spark, sf_dir)).collect()}
    stops = {c: counts.pop(c, 0) + 1 for c in dna.STOPS}
    starts = {c: counts.get(c, 0) + 1 for c in dna.STARTS}
    return models.tables(spark, {0: genefinder.genic(counts, starts, stops)})["transitions"]


def viterbi_stream(spark, sf_dir):
    """All events as one sequence, in parts: the best state of each place."""
    e = table(spark, sf_dir, "events").select("ts", "event_id", F.array((F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1).cast("int")).alias("obs"))
    parts = longpath.gathered(longpath.one_contig(e, ["ts", "event_id"]), 1024)
    d = longpath.decode_parts(parts, CALM)
    return d.select((F.col("part") * 1024).alias("at"), F.posexplode("path").alias("pos", "state")).select((F.col("at") + F.col("pos")).alias("pos"), "state")


def stream_loglik(spark, sf_dir):
    """The best path's log-likelihood over all events as one sequence."""
    e = table(spark, sf_dir, "events").select("ts", "event_id", F.array((F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1).cast("int")).alias("obs"))
    parts = longpath.gathered(longpath.one_contig(e, ["ts", "event_id"]), 1024)
    return longpath.decode_parts(parts, CALM).groupBy("seq_id").agg(F.round(F.sum("logp"), 4).alias("logp"), F.sum(F.size("path")).alias("n"))


def gene_model(counts: dict[str, int], gap: float = 300.0, silent: bool = True) -> Model:
    """Genes of the counted codons between gaps; every codon, start and stop counts once more."""
    inner = {a + b + c: counts.get(a + b + c, 0) + 1 for a in genefinder.BASES for b in genefinder.BASES for c in genefinder.BASES if a + b + c not in dna.STOPS}
    starts, stops = ({c: counts.get(c, 0) + 1 for c in kind} for kind in (dna.STARTS, dna.STOPS))
    return genefinder.joined(genefinder.genic(inner, starts, stops), genefinder.dumb_intergenic(gap), 1 / gap, silent)


def genes_of_corpus(spark, sf_dir):
    """All documents' bases as one contig, in order of doc_id, and the genes found in it."""
    d = settle(strings(spark, sf_dir).select("doc_id", "seq"))
    m = gene_model({r["codon"]: r["n"] for r in codons.codon_counts(d).collect()})
    parts = words.contig(longpath.one_contig(d.select("doc_id", F.col("seq").alias("obs")), ["doc_id"]), m, longpath.PART)
    return genefinder.genes_in(parts, m).select(F.col("first").alias("first_base"), F.col("last").alias("last_base"))


def labelled_seqs(spark, sf_dir) -> DataFrame:
    """Event sequences labelled by whether the user's values are 50 or more on average."""
    kind = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("seq_id")).agg((F.avg(F.col("value").cast("double")) >= 50).cast("int").alias("label"))
    return event_seqs(spark, sf_dir).join(kind, "seq_id")


def class_margins(spark, sf_dir):
    """How well two models tell each sequence's class, and how much it weighs in training against the other class."""
    d = discriminative.margin_table(labelled_seqs(spark, sf_dir), [CALM, BRISK])
    return d.select("seq_id", "label", *[F.round(c, 6).alias(c) for c in ("margin", "performance", "slope")], "best")


def class_errors(spark, sf_dir):
    return discriminative.errors(labelled_seqs(spark, sf_dir), [CALM, BRISK])


def _told_apart(spark, sf_dir, form):
    fitted, seen = discriminative.train(labelled_seqs(spark, sf_dir), [CALM, BRISK], form)
    t = models.tables(spark, dict(enumerate(fitted)))["transitions"]
    return t.select("model_id", "src", "dst", "p", F.lit(seen[0]).alias("before"), F.lit(seen[-1]).alias("after"))


def told_apart_gradient(spark, sf_dir):
    return _told_apart(spark, sf_dir, "gradient")


def told_apart_closed(spark, sf_dir):
    return _told_apart(spark, sf_dir, "closed")


#: Match, x only, y only; after an error (symbol 1) on either side gaps are likelier.
PAIRS = pairs.PairModel.of(
    [0.8, 0.1, 0.1], [[[0.8, 0.1, 0.1], [0.7, 0.3, 0.0], [0.7, 0.0, 0.3]], [[0.4, 0.3, 0.3], [0.3, 0.7, 0.0], [0.3, 0.0, 0.7]]], [(1, 1), (1, 0), (0, 1)],
    [np.where(np.eye(5) > 0, 0.16, 0.01), np.full((5, 1), 0.2), np.full((1, 5), 0.2)], class_of=lambda state, cell: ((cell.x == 1) | (cell.y == 1)).astype(int),
)


def _neighbours(spark, sf_dir):
    s = event_seqs(spark, sf_dir).select("seq_id", F.col("obs").alias("x"))
    return s.join(s.select((F.col("seq_id") - 1).alias("seq_id"), F.col("x").alias("y")), "seq_id")


def pair_classes(spark, sf_dir):
    """Each user's symbols against the next user's under a pair model with transition classes; large tables are divided."""
    d = pairs.align(_neighbours(spark, sf_dir), PAIRS, most=1 << 11)
    return d.select("seq_id", F.concat_ws("", F.transform("path", lambda x: x.cast("string"))).alias("path"), F.round("logp", 5).alias("logp"))


def pair_path_logp(spark, sf_dir):
    """Log-likelihood of the alignments that pair_classes finds, from their paths."""
    both = settle(_neighbours(spark, sf_dir))  # read twice
    d = pairs.path_logp(both.join(pairs.align(both, PAIRS), "seq_id").drop("logp"), PAIRS)
    return d.select("seq_id", F.round("logp", 5).alias("logp"))


#: Talk, a silent pause, answer; when the visits to the last two are 3 or 4 more than a multiple of 5, the second class holds.
SWITCHED = switching.in_classes([PAUSED, Model.of(PAUSED.pi, [[0.4, 0.6, 0.0], [0.0, 0.0, 1.0], [0.8, 0.0, 0.2]], PAUSED.b)])


def switching_paths(spark, sf_dir):
    d = switching.decode(event_seqs(spark, sf_dir), SWITCHED, [False, True, True], lambda count, t: (count % 5 >= 3).astype(int))
    return d.select("seq_id", F.concat_ws("", F.transform("path", lambda x: x.cast("string"))).alias("path"), F.round("logp", 6).alias("logp"), F.col("count").alias("visits"))


def gap_hazards(spark, sf_dir):
    """Rungs of a ladder of 30 from the lengths of the gaps between stays."""
    g = intervals.gaps(stays(spark, sf_dir), ["contig_id"]).withColumn("len", F.col("gap_end") - F.col("gap_start") + 1)
    return gapmodels.hazards(g, 30).select("rung", "n", "reached", F.round("hazard", 9).alias("hazard"), F.round("mean", 6).alias("mean"))


def gap_loop(spark, sf_dir):
    """The loop of a one-state gap under which the gaps between stays are likeliest."""
    g = intervals.gaps(stays(spark, sf_dir), ["contig_id"]).groupBy((F.col("gap_end") - F.col("gap_start") + 1).cast("int").alias("len")).agg(F.count("*").cast("double").alias("weight"))
    # A row for each length that there is; its gaps are equal sequences.
    g = settle(g).select(F.col("len").cast("long").alias("seq_id"), "weight", F.concat(F.array_repeat(F.lit(0), F.col("len")), F.array(F.lit(1))).alias("obs"))
    value, score = gapmodels.best_value(g, lambda p: Model.of([1.0, 0.0], [[p, 1 - p], [0.0, 1.0]], np.eye(2)))
    return g.limit(1).select(F.round(F.lit(value), 5).alias("value"), F.round(F.lit(score), 3).alias("score"))


def strand_gaps(spark, sf_dir):
    s = stays(spark, sf_dir)
    return gapmodels.count_gaps(s, s.select("contig_id").distinct().withColumn("len", F.lit(10500)))


def regions(spark, sf_dir) -> DataFrame:
    """Each document's string cut in what lies from its first atg to its last taa (genic) and what is left of it and right of it."""
    s, n = F.col("seq"), F.char_length("seq")
    a, e = F.instr(s, "atg"), n - F.instr(F.reverse(s), "aat") + 1
    whole = (a > 0) & (F.instr(F.reverse(s), "aat") > 0) & (e >= a + 5)
    item = lambda region, x: F.struct(F.lit(region).alias("region"), x.alias("seq"))
    cut = F.array(item("genic", F.substr(s, a, e - a + 1)), item("intergenic", F.substr(s, F.lit(1), a - 1)), item("intergenic", F.substr(s, e + 1)))
    return strings(spark, sf_dir).select("doc_id", F.explode(F.when(whole, cut).otherwise(F.array(item("intergenic", s)))).alias("x")).select("doc_id", "x.region", "x.seq")


def codon_regions(spark, sf_dir):
    """Codons of the whole strings, of their genic parts and of the rest."""
    parts = regions(spark, sf_dir).unionByName(strings(spark, sf_dir).select("doc_id", F.lit("whole").alias("region"), "seq"))
    d = codons.codon_counts(parts, by=["region"])
    return d.select("region", "codon", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("region")), 9).alias("share"))


def gene_ends(spark, sf_dir):
    """First and last codons of the genic parts, and whether they are whole codons."""
    s = F.upper("seq")
    g = regions(spark, sf_dir).where("region = 'genic'").select(F.substring(s, 1, 3).alias("head"), F.substring(s, -3, 3).alias("tail"), (F.char_length("seq") % 3 == 0).alias("thirds"))
    return g.groupBy("head", "tail", "thirds").agg(F.count("*").alias("n"))


def genes_read_whole(spark, sf_dir):
    """Genic parts that the gene model reads as one gene each."""
    g = settle(regions(spark, sf_dir).where("region = 'genic'").select(F.col("doc_id").alias("seq_id"), "seq"))
    counts = {r["codon"]: r["n"] for r in codons.codon_counts(g).collect()}
    inner = {c: n for c, n in counts.items() if c not in dna.STOPS}
    return gapmodels.genic_check(g, genefinder.genic(inner, {"ATG": 1}, {"TAA": 1}))


def position_profiles(spark, sf_dir):
    """Left-right chains of the event sequences, one for each class of users."""
    d = profiles.positions(labelled_seqs(spark, sf_dir), "label")
    return d.select(F.col("key").alias("label"), "pos", "symbol", "n", F.round("p", 9).alias("p"), F.round("go_on", 9).alias("go_on"))


def mixture_selection(spark, sf_dir):
    """Mixtures of one to three models, two repeats each."""
    _, rows = selection.select(event_seqs(spark, sf_dir), selection.starts(CALM, [1, 2, 3], 2))
    return spark.createDataFrame(rows, "k int, repeat int, steps int, train double, n_train double, test double, n_test double, free int, bic double")


def next_symbol_shares(spark, sf_dir):
    """Distribution of each user's next event."""
    return sampling.next_symbols(event_seqs(spark, sf_dir), CALM).select("seq_id", "symbol", F.round("p", 9).alias("p"))


def drawn_on(spark, sf_dir):
    """Each user's events drawn on by ten."""
    d = sampling.extended(event_seqs(spark, sf_dir).withColumn("len", F.size("obs") + 10), CALM)
    return d.select("seq_id", F.size("obs").alias("len"), F.concat_ws("", F.transform(F.slice("obs", F.size("obs") - 9, F.lit(10)), lambda x: x.cast("string"))).alias("more"))


#: Two calm states of one label, one busy one of another.
LABELLED = Model.of([0.4, 0.3, 0.3], [[0.8, 0.1, 0.1], [0.1, 0.7, 0.2], [0.2, 0.1, 0.7]], [[0.5, 0.1, 0.2, 0.1, 0.1], [0.2, 0.1, 0.1, 0.1, 0.5], [0.1, 0.4, 0.1, 0.2, 0.2]], labels=(0, 0, 1))


def kbest_labels(spark, sf_dir):
    d = hmm.kbest(event_seqs(spark, sf_dir), LABELLED)
    return d.select("seq_id", F.concat_ws("", F.transform("labels", lambda x: x.cast("string"))).alias("labels"), F.round("logp", 6).alias("logp"))


def cut_trained(spark, sf_dir):
    """GAUSS cut off below 0 and trained."""
    m, logp = training.baum_welch(value_seqs(spark, sf_dir), replace(GAUSS, cut=0.0))
    return models.tables(spark, {0: m})["components"].withColumn("logp", F.lit(float(logp)))


def clusters_from_random(spark, sf_dir):
    """Three clusters from random starts; none stays empty while it trains."""
    s = event_seqs(spark, sf_dir)
    _, labels = training.cluster(s, training.random_starts(s, CALM, 3), reseed=True)
    return labels.groupBy("model_id").agg(F.count("*").alias("n"), F.round(F.sum("logp"), 3).alias("logp"))


_ORDERED = """ord AS (SELECT user_id, CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS INTEGER) AS sym, CAST(value AS DOUBLE) AS value,
 ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events)"""
_BASES = "s AS (SELECT doc_id, lang, regexp_replace(lower(text), '[^acgt]', '', 'g') AS seq FROM documents)"
_RC = "reverse(translate(seq, 'acgt', 'tgca'))"
_STAYS = """raw AS (SELECT o_custkey AS contig_id, o_orderkey AS feature_id, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS a, o_totalprice, o_orderstatus FROM orders),
 iv AS (SELECT contig_id, feature_id, a AS lo, a + LEAST(90, CAST(floor(o_totalprice / 3000) AS BIGINT)) AS hi, o_orderstatus = 'F' AS rev FROM raw)"""
_E = {0: CALM, 1: BRISK}


def _b(m: Model, state: int, sym: str = "o.sym") -> str:
    return "CASE " + sym + " " + " ".join(f"WHEN {k} THEN {p!r}" for k, p in enumerate(map(float, m.b[state]))) + " END"


def _forward_cte(m: Model, name: str = "f") -> str:
    """Recursive scaled forward: user_id, t, p0, p1, l."""
    a = m.a[0]
    into = [f"({name}.p0 * {float(a[0, j])!r} + {name}.p1 * {float(a[1, j])!r}) * ({_b(m, j)})" for j in range(2)]
    return f"""{name}0 AS (SELECT user_id, t, {float(m.pi[0])!r} * ({_b(m, 0)}) AS x0, {float(m.pi[1])!r} * ({_b(m, 1)}) AS x1 FROM ord o WHERE t = 1),
 {name} AS (SELECT user_id, t, x0 / (x0 + x1) AS p0, x1 / (x0 + x1) AS p1, ln(x0 + x1) AS l FROM {name}0
 UNION ALL SELECT user_id, t, x0 / (x0 + x1), x1 / (x0 + x1), l + ln(x0 + x1) FROM (SELECT o.user_id, o.t, {into[0]} AS x0, {into[1]} AS x1, {name}.l FROM {name} JOIN ord o ON o.user_id = {name}.user_id AND o.t = {name}.t + 1))"""


_FORWARD = f"WITH RECURSIVE {_ORDERED}, {_forward_cte(CALM)}"
_LAST = "QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY t DESC) = 1"
_LOGLIK = f"{_FORWARD} SELECT user_id AS seq_id, round(l, 6) AS logp FROM f {_LAST}"


def _log(x: float) -> str:
    return repr(float(np.log(x)))


_VIT_STEP = [[f"v.d{i} + {_log(CALM.a[0, i, j])}" for i in range(2)] for j in range(2)]
_VITERBI = f"""WITH RECURSIVE {_ORDERED},
 v AS (SELECT user_id, t, {_log(CALM.pi[0])} + ln({_b(CALM, 0)}) AS d0, {_log(CALM.pi[1])} + ln({_b(CALM, 1)}) AS d1, '0' AS w0, '1' AS w1 FROM ord o WHERE t = 1
 UNION ALL SELECT o.user_id, o.t, GREATEST({_VIT_STEP[0][0]}, {_VIT_STEP[0][1]}) + ln({_b(CALM, 0)}), GREATEST({_VIT_STEP[1][0]}, {_VIT_STEP[1][1]}) + ln({_b(CALM, 1)}),
 CASE WHEN {_VIT_STEP[0][1]} > {_VIT_STEP[0][0]} THEN v.w1 ELSE v.w0 END || '0', CASE WHEN {_VIT_STEP[1][1]} > {_VIT_STEP[1][0]} THEN v.w1 ELSE v.w0 END || '1'
 FROM v JOIN ord o ON o.user_id = v.user_id AND o.t = v.t + 1)"""

#: All events as one sequence.
_STREAM = _VITERBI.replace("PARTITION BY user_id ORDER BY ts", "ORDER BY ts").replace("SELECT user_id, t, ", "SELECT t, ").replace("SELECT o.user_id, o.t, ", "SELECT o.t, ").replace("o.user_id = v.user_id AND ", "").replace("ord AS (", "ord AS MATERIALIZED (")

_MARGINS = f"""WITH RECURSIVE {_ORDERED}, {_forward_cte(CALM)}, {_forward_cte(BRISK, 'h')}, x AS (SELECT user_id, l FROM f {_LAST}), y AS (SELECT user_id, l FROM h {_LAST}),
 k AS (SELECT user_id, CASE WHEN avg(CAST(value AS DOUBLE)) >= 50 THEN 1 ELSE 0 END AS label FROM events GROUP BY user_id),
 g AS (SELECT user_id AS seq_id, label, CASE WHEN label = 0 THEN x.l - y.l ELSE y.l - x.l END AS margin, CASE WHEN y.l > x.l THEN 1 ELSE 0 END AS best FROM x JOIN y USING (user_id) JOIN k USING (user_id))"""


def _pairs_sql() -> str:
    """Antidiagonal by antidiagonal: a row for each cell with the whole-number scores and the paths of its three states; two antidiagonals are carried."""
    whole = lambda p: str(round(float(np.log(p)) * 2**30)) if p > 0 else "NULL"
    step = []
    for s, (dx, dy) in enumerate(PAIRS.steps):
        # What leads into the cell comes from one cell: up and left, left, or up.
        p = ("m", "l", "u")[s]
        ways = [f"CASE WHEN i.xs = 1 OR i.ys = 1 THEN {p}.d{r} + {whole(PAIRS.a[1, r, s])} ELSE {p}.d{r} + {whole(PAIRS.a[0, r, s])} END" for r in range(3)]
        said = f"CASE WHEN i.xs = i.ys THEN {whole(0.16)} ELSE {whole(0.01)} END" if s == 0 else whole(0.2)
        step.append((ways, said, dx, dy))
    low = "-4000000000000000000"
    cols = []
    for s, (ways, said, dx, dy) in enumerate(step):
        w = [f"coalesce({x}, {low})" for x in ways]
        first = f"i.u = {dx} AND i.v = {dy}"
        top = f"greatest({', '.join(w)})"
        p = ("m", "l", "u")[s]
        cols.append(f"CASE WHEN {first} THEN {whole(PAIRS.start[s])} + {said} WHEN {top} > {low} THEN {top} + {said} END AS d{s}")
        cols.append(f"CASE WHEN {first} THEN '{s}' WHEN {w[0]} = {top} THEN {p}.w0 || '{s}' WHEN {w[1]} = {top} THEN {p}.w1 || '{s}' ELSE {p}.w2 || '{s}' END AS w{s}")
    return f"""WITH RECURSIVE {_ORDERED}, n AS (SELECT user_id, max(t) AS n FROM ord GROUP BY user_id),
 syms AS (SELECT a.user_id AS seq_id, a.n AS nx, b.n AS ny FROM n a JOIN n b ON b.user_id = a.user_id + 1),
 cells AS MATERIALIZED (SELECT p.seq_id, u, v, u + v AS t, x.sym AS xs, y.sym AS ys FROM syms p, LATERAL (SELECT unnest(range(0, p.nx + 1)) AS u), LATERAL (SELECT unnest(range(0, p.ny + 1)) AS v) LEFT JOIN ord x ON x.user_id = p.seq_id AND x.t = u LEFT JOIN ord y ON y.user_id = p.seq_id + 1 AND y.t = v),
 d AS (SELECT seq_id, CAST(0 AS BIGINT) AS now, CAST(0 AS BIGINT) AS u, CAST(0 AS BIGINT) AS v, CAST(NULL AS BIGINT) AS d0, CAST(NULL AS VARCHAR) AS w0, CAST(NULL AS BIGINT) AS d1, CAST(NULL AS VARCHAR) AS w1, CAST(NULL AS BIGINT) AS d2, CAST(NULL AS VARCHAR) AS w2 FROM syms
 UNION ALL (WITH held AS (SELECT * FROM d), top AS (SELECT seq_id, max(now) AS now FROM held GROUP BY seq_id),
 fresh AS (SELECT i.seq_id, i.t AS now, i.u, i.v, {', '.join(cols)} FROM top JOIN cells i ON i.seq_id = top.seq_id AND i.t = top.now + 1 LEFT JOIN held m ON m.seq_id = i.seq_id AND m.u = i.u - 1 AND m.v = i.v - 1 LEFT JOIN held l ON l.seq_id = i.seq_id AND l.u = i.u - 1 AND l.v = i.v LEFT JOIN held u ON u.seq_id = i.seq_id AND u.u = i.u AND u.v = i.v - 1)
 SELECT * FROM fresh UNION ALL SELECT held.* FROM held JOIN top USING (seq_id) WHERE held.now = top.now AND EXISTS (SELECT 1 FROM fresh WHERE fresh.seq_id = held.seq_id))),
 ends AS (SELECT DISTINCT seq_id, greatest(coalesce(d0, {low}), coalesce(d1, {low}), coalesce(d2, {low})) AS l, CASE WHEN coalesce(d0, {low}) >= greatest(coalesce(d1, {low}), coalesce(d2, {low})) THEN w0 WHEN coalesce(d1, {low}) >= coalesce(d2, {low}) THEN w1 ELSE w2 END AS path FROM d JOIN syms USING (seq_id) WHERE u = nx AND v = ny AND now = u + v)"""

#: The best of three states, the lowest of equals.
_TOP3 = "(CASE WHEN coalesce(d0, -1e300) >= greatest(coalesce(d1, -1e300), coalesce(d2, -1e300)) THEN 0 WHEN coalesce(d1, -1e300) >= coalesce(d2, -1e300) THEN 1 ELSE 2 END)"


def _switching_sql() -> str:
    """v: after each symbol the scores, visits and paths of talk (0), pause (1, silent) and answer (2)."""
    a = SWITCHED.a
    move = lambda q, i, j: f"{q}.d{i} + CASE WHEN {q}.c{i} % 5 >= 3 THEN {_log(a[1, i, j])} ELSE {_log(a[0, i, j])} END"
    best = lambda q, i, j, to: f"coalesce({move(q, i, to)}, -1e300) >= coalesce({move(q, j, to)}, -1e300)"
    pick = lambda q, i, j, to, x, y: f"CASE WHEN {best(q, i, j, to)} THEN {x} ELSE {y} END"
    said = [f"ln({_b(PAUSED, j)})" for j in range(3) if j != 1]
    spoken = f"""SELECT o.user_id, o.t, {pick('v', 0, 2, 0, move('v', 0, 0), move('v', 2, 0))} + {said[0]} AS d0, {pick('v', 0, 2, 0, 'v.c0', 'v.c2')} AS c0, {pick('v', 0, 2, 0, 'v.w0', 'v.w2')} || '0' AS w0,
 {pick('v', 1, 2, 2, move('v', 1, 2), move('v', 2, 2))} + {said[1]} AS d2, {pick('v', 1, 2, 2, 'v.c1', 'v.c2')} + 1 AS c2, {pick('v', 1, 2, 2, 'v.w1', 'v.w2')} || '2' AS w2 FROM v JOIN ord o ON o.user_id = v.user_id AND o.t = v.t + 1"""
    begun = f"SELECT user_id, t, {said[0]} AS d0, CAST(0 AS BIGINT) AS c0, '0' AS w0, CAST(NULL AS DOUBLE) AS d2, CAST(0 AS BIGINT) AS c2, '' AS w2 FROM ord o WHERE t = 1"
    paused = f"SELECT user_id, t, d0, {move('x', 0, 1)} AS d1, d2, c0, c0 + 1 AS c1, c2, w0, w0 || '1' AS w1, w2 FROM"
    return f"WITH RECURSIVE {_ORDERED}, v AS ({paused} ({begun}) x UNION ALL {paused} ({spoken}) x)"


def _posterior_sql(most: int | None) -> str:
    """f (forward) and g (backward, scaled by its own sums) up to a place."""
    a = CALM.a[0]
    own = _ORDERED.replace("FROM events)", "FROM events QUALIFY t <= %d)" % most) if most else _ORDERED
    back = [" + ".join(f"{float(a[i, j])!r} * ({_b(CALM, j, 'o.sym')}) * g.q{j}" for j in range(2)) for i in range(2)]
    return f"""WITH RECURSIVE {own}, {_forward_cte(CALM)}, n AS (SELECT user_id, max(t) AS n FROM ord GROUP BY user_id),
 g AS (SELECT user_id, n AS t, CAST(1 AS DOUBLE) AS q0, CAST(1 AS DOUBLE) AS q1 FROM n
 UNION ALL SELECT user_id, t, y0 / (y0 + y1), y1 / (y0 + y1) FROM (SELECT o.user_id, o.t - 1 AS t, {back[0]} AS y0, {back[1]} AS y1 FROM g JOIN ord o ON o.user_id = g.user_id AND o.t = g.t WHERE g.t > 1)),
 post AS (SELECT f.user_id, f.t, f.p0 * g.q0 / (f.p0 * g.q0 + f.p1 * g.q1) AS r0, f.p1 * g.q1 / (f.p0 * g.q0 + f.p1 * g.q1) AS r1 FROM f JOIN g USING (user_id, t))"""


def _em_sql() -> str:
    a = CALM.a[0]
    xi = [[f"f.p{i} * {float(a[i, j])!r} * ({_b(CALM, j)}) * g.q{j}" for j in range(2)] for i in range(2)]
    every = " + ".join(x for r in xi for x in r)
    moves = ", ".join(f"sum(({xi[i][j]}) / ({every})) AS x{i}{j}" for i in range(2) for j in range(2))
    rows = " UNION ALL ".join(f"SELECT 'a' AS kind, {i} AS i, {j} AS j, round(x{i}{j} / (x{i}0 + x{i}1), 6) AS p FROM mv" for i in range(2) for j in range(2))
    emit = " UNION ALL ".join(f"SELECT 'b', {i}, o.sym, round(sum(r{i}) / (SELECT sum(r{i}) FROM post), 6) FROM post JOIN ord o USING (user_id, t) GROUP BY o.sym" for i in range(2))
    return f"{_posterior_sql(None)}, mv AS (SELECT {moves} FROM f JOIN g ON g.user_id = f.user_id AND g.t = f.t + 1 JOIN ord o ON o.user_id = g.user_id AND o.t = g.t) {rows} UNION ALL {emit}"


def _gauss(j: int) -> str:
    mu, v = float(GAUSS.mu[j, 0]), float(GAUSS.var[j, 0])
    return f"exp(-(o.value - {mu!r}) * (o.value - {mu!r}) / {2 * v!r}) / sqrt({2 * np.pi * v!r})"


_GAUSS_SQL = f"""WITH RECURSIVE {_ORDERED}, f0 AS (SELECT user_id, t, 0.5 * ({_gauss(0)}) AS x0, 0.5 * ({_gauss(1)}) AS x1 FROM ord o WHERE t = 1),
 f AS (SELECT user_id, t, x0 / (x0 + x1) AS p0, x1 / (x0 + x1) AS p1, ln(x0 + x1) AS l FROM f0
 UNION ALL SELECT user_id, t, x0 / (x0 + x1), x1 / (x0 + x1), l + ln(x0 + x1) FROM (SELECT o.user_id, o.t, (f.p0 * 0.8 + f.p1 * 0.3) * ({_gauss(0)}) AS x0, (f.p0 * 0.2 + f.p1 * 0.7) * ({_gauss(1)}) AS x1, f.l FROM f JOIN ord o ON o.user_id = f.user_id AND o.t = f.t + 1))
 SELECT user_id AS seq_id, round(l, 5) AS logp FROM f {_LAST}"""
#: Without the silent state: its edge leads on to the last one.
_PLAIN = PAUSED.without_silent()
_MATCH = """pairs AS (SELECT l.contig_id, l.feature_id, r.feature_id AS r_feature_id, (LEAST(l.hi, r.hi) - GREATEST(l.lo, r.lo) + 1) / CAST(GREATEST(l.hi, r.hi) - LEAST(l.lo, r.lo) + 1 AS DOUBLE) AS score
 FROM iv l JOIN iv r ON l.contig_id = r.contig_id AND l.lo <= r.hi AND r.lo <= l.hi WHERE l.feature_id % 2 = 0 AND r.feature_id % 2 = 1),
 best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY contig_id, feature_id ORDER BY score DESC, r_feature_id) AS a, ROW_NUMBER() OVER (PARTITION BY contig_id, r_feature_id ORDER BY score DESC, feature_id) AS b FROM pairs)"""
#: Overlaps of all stays, both ways round, and each one's best.
_BOTH_WAYS = _MATCH.replace(" WHERE l.feature_id % 2 = 0 AND r.feature_id % 2 = 1)", " AND l.feature_id <> r.feature_id)")
#: Pairs in order, one after the other, with the intervals of both sides that are taken.
_GREEDY = f"""WITH RECURSIVE {_STAYS}, sp AS (SELECT o_custkey AS contig_id, o_orderkey AS feature_id, min(datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS lo, max(datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS hi
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
 pairs AS (SELECT l.contig_id, l.feature_id AS x, r.feature_id AS y, (LEAST(l.hi, r.hi) - GREATEST(l.lo, r.lo) + 1) / CAST(GREATEST(l.hi, r.hi) - LEAST(l.lo, r.lo) + 1 AS DOUBLE) AS score FROM iv l JOIN sp r ON l.contig_id = r.contig_id AND l.lo <= r.hi AND r.lo <= l.hi),
 ranked AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY contig_id ORDER BY score DESC, x, y) AS k FROM pairs),
 g AS (SELECT contig_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS xs, CAST([] AS BIGINT[]) AS ys, false AS took, CAST(NULL AS BIGINT) AS x, CAST(NULL AS BIGINT) AS y, CAST(NULL AS DOUBLE) AS score FROM (SELECT DISTINCT contig_id FROM ranked)
 UNION ALL SELECT g.contig_id, p.k, CASE WHEN list_contains(g.xs, p.x) OR list_contains(g.ys, p.y) THEN g.xs ELSE list_append(g.xs, p.x) END, CASE WHEN list_contains(g.xs, p.x) OR list_contains(g.ys, p.y) THEN g.ys ELSE list_append(g.ys, p.y) END,
 NOT (list_contains(g.xs, p.x) OR list_contains(g.ys, p.y)), p.x, p.y, p.score FROM g JOIN ranked p ON p.contig_id = g.contig_id AND p.k = g.k + 1),
 taken AS (SELECT contig_id, x, y, score FROM g WHERE took)"""
_GAPS = "before AS (SELECT contig_id, lo, max(hi) OVER (PARTITION BY contig_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM iv), gaps AS (SELECT contig_id, h + 1 AS gap_start, lo - 1 AS gap_end FROM before WHERE h + 1 <= lo - 1)"

_REGIONS = f"""{_BASES}, p AS (SELECT seq, strpos(seq, 'atg') AS a, length(seq) - strpos(reverse(seq), 'aat') + 1 AS e, strpos(reverse(seq), 'aat') > 0 AS ends FROM s),
 q AS (SELECT *, a > 0 AND ends AND e >= a + 5 AS fine FROM p),
 parts AS (SELECT 'genic' AS region, substr(seq, a, e - a + 1) AS x FROM q WHERE fine UNION ALL SELECT 'intergenic', substr(seq, 1, a - 1) FROM q WHERE fine UNION ALL SELECT 'intergenic', substr(seq, e + 1) FROM q WHERE fine UNION ALL SELECT 'intergenic', seq FROM q WHERE NOT fine)"""


def _loop_sql() -> str:
    """The grid of values, then ten times finer around the best, three times."""
    score = "(total - n) * ln(v) + n * ln(1 - v)"
    out = f"WITH {_STAYS}, {_GAPS}, t AS (SELECT sum(gap_end - gap_start + 1) AS total, count(*) AS n FROM gaps), b0 AS (SELECT v, {score} AS s FROM t, (SELECT round(0.01 * i, 9) AS v FROM range(1, 100) r(i)) ORDER BY s DESC, v LIMIT 1)"
    for k in range(1, 4):
        out += f", b{k} AS (SELECT v, {score} AS s FROM t, (SELECT round(b{k - 1}.v + {0.01 / 10**k!r} * i, 9) AS v FROM b{k - 1}, range(-10, 11) r(i)) WHERE v > 0 AND v < 1 ORDER BY s DESC, v LIMIT 1)"
    return out + " SELECT round(v, 5) AS value, round(s, 3) AS score FROM b3"


def _frames_sql() -> str:
    parts = [f"SELECT {k} AS frame, upper(substr({e}, CAST(i * 3 + 1 + {f} AS BIGINT), 3)) AS codon FROM s, range((length(seq) - {f}) // 3) r(i) WHERE length(seq) - {f} >= 3" for k, (e, f) in enumerate([(e, f) for e in ("seq", _RC) for f in range(3)], 1)]
    return f"WITH {_BASES}, c AS ({' UNION ALL '.join(parts)}) SELECT frame, codon, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY frame), 9) AS share FROM c GROUP BY frame, codon"


def _bases_sql(expr: str) -> str:
    return " UNION ALL ".join(f"SELECT '{strand}' AS strand, '{b}' AS base, CAST(sum(length({e}) - length(replace({e}, '{b}', ''))) AS BIGINT) AS n FROM s" for strand, e in (("direct", "seq"), ("reverse", _RC)) for b in "acgt")


_PAIRS_SQL = _pairs_sql()

SQL: dict[str, str] = {
    "nt_counts": f"WITH {_BASES} {_bases_sql('seq')}",
    "nt_shares": f"WITH {_BASES} SELECT lang, " + ", ".join(f"round(sum(length(seq) - length(replace(seq, '{b}', ''))) / sum(length(seq)), 9) AS share_{b}" for b in "acgt") + " FROM s GROUP BY lang",
    "codon_frames": _frames_sql(),
    "codon_rollup": f"WITH {_BASES}, c AS (SELECT lang, upper(substr(seq, CAST(i * 3 + 1 AS BIGINT), 3)) AS codon FROM s, range(length(seq) // 3) r(i)) SELECT lang, codon, count(*) AS n FROM c GROUP BY ROLLUP (lang, codon)",
    "revcomp_start_stop": f"WITH {_BASES} SELECT doc_id, upper(substr(seq, 1, 3)) IN ('ATG','GTG','TTG') AS starts, upper(right(seq, 3)) IN ('TAA','TGA','TAG') AS stops, md5({_RC}) AS rc_md5 FROM s",
    "codon_types": f"WITH {_BASES}, c AS (SELECT substr(seq, CAST(i * 3 + 2 AS BIGINT), 3) AS codon FROM s, range((length(seq) - 1) // 3) r(i) WHERE length(seq) >= 4) SELECT codon, CAST(instr('acgt', substr(codon, 1, 1)) - 1 + 4 * (instr('acgt', substr(codon, 2, 1)) - 1) + 16 * (instr('acgt', substr(codon, 3, 1)) - 1) AS INTEGER) AS id, CASE WHEN upper(codon) IN ('ATG','GTG','TTG') THEN 'start' WHEN upper(codon) IN ('TAA','TGA','TAG') THEN 'stop' ELSE 'genic' END AS type, count(*) AS n FROM c GROUP BY codon",
    "event_sequences": f"WITH {_ORDERED} SELECT user_id AS seq_id, CAST(count(*) AS INTEGER) AS len, max(sym) AS max_symbol, string_agg(CAST(sym AS VARCHAR), '' ORDER BY t) AS word FROM ord GROUP BY user_id",
    "sequence_profile": f"WITH {_ORDERED}, q AS (SELECT user_id, count(*) AS len, max(sym) AS m FROM ord GROUP BY user_id) SELECT count(*) AS n, CAST(max(len) AS INTEGER) AS max_len, max(m) AS max_symbol FROM q",
    "gap_lengths": f"WITH {_STAYS}, {_GAPS}, l AS (SELECT gap_end - gap_start + 1 AS len FROM gaps) SELECT count(*) AS n, min(len) AS least, max(len) AS most, count(*) FILTER (len BETWEEN 1 AND 14) AS short, count(*) FILTER (len >= 10) AS long FROM l",
    "gap_list": f"WITH {_STAYS}, {_GAPS} SELECT contig_id, gap_start, gap_end FROM gaps",
    "contained": f"WITH {_STAYS} SELECT contig_id, count(*) AS n FROM iv WHERE lo >= 9000 AND hi <= 9500 GROUP BY contig_id",
    "lengths_by_strand": f"WITH {_STAYS} SELECT (rev AND hi > lo) AS reverse, count(*) AS n, CAST(floor(avg(hi - lo + 1)) AS BIGINT) AS mean_length FROM iv GROUP BY 1",
    "mirrored": f"WITH {_STAYS} SELECT contig_id, min(20001 - hi) AS lo, max(20001 - lo) AS hi FROM iv GROUP BY contig_id",
    "islands_by_type": "WITH o AS (SELECT user_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events), r AS (SELECT user_id, event_type, g, count(*) AS run_length FROM o GROUP BY ALL) SELECT event_type, run_length, count(*) AS n FROM r GROUP BY ALL",
    "overlap_pairs": f"WITH {_STAYS}, {_MATCH} SELECT contig_id, feature_id, r_feature_id, round(score, 9) AS score FROM pairs",
    "overlap_match": f"WITH {_STAYS}, {_MATCH} SELECT contig_id, feature_id, r_feature_id, round(score, 9) AS score FROM best WHERE a = 1 AND b = 1",
    "unmatched": f"WITH {_STAYS}, {_MATCH} SELECT contig_id, count(*) AS n FROM iv WHERE feature_id % 2 = 0 AND feature_id NOT IN (SELECT feature_id FROM best WHERE a = 1 AND b = 1) GROUP BY contig_id",
    "overlap_pairs_whole": f"WITH {_STAYS}, {_BOTH_WAYS} SELECT contig_id, feature_id, r_feature_id, round(score, 9) AS score FROM pairs WHERE feature_id < r_feature_id",
    "overlap_match_whole": f"WITH {_STAYS}, {_BOTH_WAYS} SELECT contig_id, feature_id, r_feature_id, round(score, 9) AS score FROM best WHERE a = 1 AND b = 1 AND feature_id < r_feature_id",
    "unmatched_whole": f"WITH {_STAYS}, {_BOTH_WAYS} SELECT contig_id, count(*) AS n FROM iv WHERE feature_id NOT IN (SELECT feature_id FROM best WHERE a = 1 AND b = 1) GROUP BY contig_id",
    "posterior_states_whole": f"{_posterior_sql(None)} SELECT user_id AS seq_id, CAST(t - 1 AS INTEGER) AS pos, 0 AS state, round(r0, 6) AS p FROM post UNION ALL SELECT user_id, CAST(t - 1 AS INTEGER), 1, round(r1, 6) FROM post",
    "mean_sequence_whole": f"WITH {_ORDERED} SELECT CAST(t - 1 AS INTEGER) AS pos, round(sum(value) / (SELECT count(DISTINCT user_id) FROM events), 6) AS mean, count(*) AS n FROM ord GROUP BY t",
    "plotted": "SELECT user_id AS seq_id, string_agg(printf('%.8f', CAST(value AS DOUBLE)) || chr(10), '' ORDER BY ts, event_id) || chr(10) || chr(10) AS lines FROM events GROUP BY user_id",
    "listed_symbols": f"WITH {_ORDERED} SELECT user_id AS seq_id, '{{' || string_agg(CAST(sym AS VARCHAR), ', ' ORDER BY t) || '}}' AS line FROM ord GROUP BY user_id",
    "xml_symbols": f"WITH {_ORDERED} SELECT user_id AS seq_id, '  1 <Sequence id=\"seq' || user_id || '\">' || CASE WHEN user_id % 3 > 0 THEN '<Label>' || user_id % 3 || '</Label>' ELSE '' END || '<!-- Length: ' || count(*) || ' --> ' || string_agg(CAST(sym AS VARCHAR), ' ' ORDER BY t) || '  </Sequence>' AS line FROM ord GROUP BY user_id",
    "greedy_match": f"{_GREEDY} SELECT contig_id, x AS feature_id, y AS r_feature_id, round(score, 9) AS score FROM taken",
    "match_agreement": f"""{_GREEDY}, u AS (SELECT contig_id, 'pair' AS kind, score FROM taken UNION ALL SELECT contig_id, 'left', -1.0 FROM iv WHERE feature_id NOT IN (SELECT x FROM taken) UNION ALL SELECT contig_id, 'right', -1.0 FROM sp WHERE feature_id NOT IN (SELECT y FROM taken))
 SELECT contig_id, count(*) FILTER (kind = 'pair' AND score = 1) AS perfect, count(*) FILTER (kind = 'pair' AND score >= 0.8 AND score < 1) AS partial80, count(*) FILTER (kind = 'pair' AND score >= 0.5 AND score < 0.8) AS partial50,
 count(*) FILTER (kind = 'pair' AND score < 0.5) AS partial0, count(*) FILTER (kind = 'left') AS false_negatives, count(*) FILTER (kind = 'right') AS false_positives, round(sum(score), 6) AS score FROM u GROUP BY contig_id""",
    "uncovered_cuts": f'WITH {_STAYS}, p AS (SELECT DISTINCT contig_id, hi + 1 AS "at" FROM iv) SELECT contig_id, "at" FROM p WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.contig_id = p.contig_id AND p."at" BETWEEN iv.lo AND iv.hi)',
    "transition_counts": f"WITH {_ORDERED}, m AS (SELECT sym AS src, lead(sym) OVER (PARTITION BY user_id ORDER BY t) AS dst FROM ord) SELECT src, dst, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY src), 9) AS p FROM m WHERE dst IS NOT NULL GROUP BY src, dst",
    "kgram_background": f"WITH {_ORDERED}, m AS (SELECT sym AS s0, lead(sym) OVER w AS s1, lead(sym, 2) OVER w AS s2 FROM ord WINDOW w AS (PARTITION BY user_id ORDER BY t)), g AS (SELECT s0, s1, s2, count(*) AS n FROM m WHERE s2 IS NOT NULL GROUP BY ALL), e AS (SELECT CAST(a AS INTEGER) AS s0, CAST(b AS INTEGER) AS s1, CAST(c AS INTEGER) AS s2 FROM range(5) x(a), range(5) y(b), range(5) z(c)) SELECT s0, s1, s2, coalesce(n, 0) + 1 AS n, round((coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY s0, s1), 9) AS p FROM e LEFT JOIN g USING (s0, s1, s2)",
    "forward_loglik": _LOGLIK,
    "forward_loglik_fold": _LOGLIK,
    "backward_loglik": _LOGLIK,
    "silent_loglik": f"WITH RECURSIVE {_ORDERED}, {_forward_cte(_PLAIN)} SELECT user_id AS seq_id, round(l, 6) AS logp FROM f {_LAST}",
    "viterbi_logp": f"{_VITERBI} SELECT user_id AS seq_id, round(GREATEST(d0, d1), 6) AS logp FROM v {_LAST}",
    "viterbi_states": f"{_VITERBI} SELECT user_id AS seq_id, CASE WHEN d1 > d0 THEN w1 ELSE w0 END AS path FROM v {_LAST}",
    "posterior_states": f"{_posterior_sql(20)} SELECT user_id AS seq_id, CAST(t - 1 AS INTEGER) AS pos, 0 AS state, round(r0, 6) AS p FROM post UNION ALL SELECT user_id, CAST(t - 1 AS INTEGER), 1, round(r1, 6) FROM post",
    "model_scores": f"WITH RECURSIVE {_ORDERED}, {_forward_cte(CALM)}, {_forward_cte(BRISK, 'h')} (SELECT user_id AS seq_id, 0 AS model_id, round(l, 6) AS logp FROM f {_LAST}) UNION ALL (SELECT user_id, 1, round(l, 6) FROM h {_LAST})",
    "best_model": f"WITH RECURSIVE {_ORDERED}, {_forward_cte(CALM)}, {_forward_cte(BRISK, 'h')}, x AS (SELECT user_id, l FROM f {_LAST}), y AS (SELECT user_id, l FROM h {_LAST}) SELECT user_id AS seq_id, CASE WHEN y.l > x.l THEN 1 ELSE 0 END AS model_id, round(1 / (1 + exp(-abs(x.l - y.l))), 6) AS posterior FROM x JOIN y USING (user_id)",
    "set_likelihood": f"{_FORWARD}, e AS (SELECT l FROM f {_LAST}) SELECT round(sum(l), 4) AS total, CAST(0 AS BIGINT) AS impossible FROM e",
    "gauss_loglik": _GAUSS_SQL,
    "normal_densities": f"SELECT event_id, round(exp(-(value - 50.0) * (value - 50.0) / 1800.0) / sqrt({2 * np.pi * 900!r}), 9) AS density FROM (SELECT event_id, CAST(value AS DOUBLE) AS value FROM events)",
    "em_one_step": _em_sql(),
    "next_symbol_shares": f"{_FORWARD}, e AS (SELECT user_id, p0 * {float(CALM.a[0, 0, 0])!r} + p1 * {float(CALM.a[0, 1, 0])!r} AS q0, p0 * {float(CALM.a[0, 0, 1])!r} + p1 * {float(CALM.a[0, 1, 1])!r} AS q1 FROM f {_LAST}), o(sym) AS (VALUES (0), (1), (2), (3), (4)) SELECT user_id AS seq_id, o.sym AS symbol, round(q0 * ({_b(CALM, 0)}) + q1 * ({_b(CALM, 1)}), 9) AS p FROM e, o",
    "gap_hazards": f"WITH {_STAYS}, {_GAPS}, r AS (SELECT CAST(least(gap_end - gap_start + 1, 30) AS INTEGER) AS rung, count(*) AS n, avg(gap_end - gap_start + 1) AS mean FROM gaps GROUP BY 1), s AS (SELECT rung, n, mean, CAST(sum(n) OVER (ORDER BY rung DESC) AS BIGINT) AS reached FROM r) SELECT rung, n, reached, round(n / reached, 9) AS hazard, round(mean, 6) AS mean FROM s",
    "gap_loop": _loop_sql(),
    "strand_gaps": f"WITH {_STAYS}, f AS (SELECT contig_id, lo, hi, rev AND hi > lo AS back FROM iv), g AS (SELECT contig_id, count(*) FILTER (NOT back) AS d, count(*) FILTER (back) AS r, arg_max(hi, lo * 100000 + hi) FILTER (NOT back) AS last, arg_min(lo, lo * 100000 + hi) FILTER (back) AS first FROM f GROUP BY contig_id) SELECT contig_id, d + CASE WHEN coalesce(last + 1, 1) < 10500 THEN 1 ELSE 0 END AS direct, r + CASE WHEN coalesce(first - 1, 10500) > 1 THEN 1 ELSE 0 END AS reverse FROM g",
    "codon_regions": f"WITH {_REGIONS}, every AS (SELECT region, x FROM parts UNION ALL SELECT 'whole', seq FROM s), c AS (SELECT region, upper(substr(x, CAST(i * 3 + 1 AS BIGINT), 3)) AS codon FROM every, range(length(x) // 3) r(i)) SELECT region, codon, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY region), 9) AS share FROM c GROUP BY region, codon",
    "gene_ends": f"WITH {_REGIONS} SELECT upper(substr(x, 1, 3)) AS head, upper(right(x, 3)) AS tail, length(x) % 3 = 0 AS thirds, count(*) AS n FROM parts WHERE region = 'genic' GROUP BY ALL",
    "position_profiles": f"WITH {_ORDERED}, k AS (SELECT user_id, CASE WHEN avg(CAST(value AS DOUBLE)) >= 50 THEN 1 ELSE 0 END AS label, count(*) AS size FROM events GROUP BY user_id), c AS (SELECT label, CAST(t - 1 AS INTEGER) AS pos, sym AS symbol, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (size > t) AS more FROM ord JOIN k USING (user_id) GROUP BY ALL) SELECT label, pos, symbol, n, round(n / sum(n) OVER (PARTITION BY label, pos), 9) AS p, round(sum(more) OVER (PARTITION BY label, pos) / sum(n) OVER (PARTITION BY label, pos), 9) AS go_on FROM c",
    "switching_paths": f"{_switching_sql()}, e AS (SELECT * FROM v {_LAST}) SELECT user_id AS seq_id, CASE WHEN {_TOP3} = 0 THEN w0 WHEN {_TOP3} = 1 THEN w1 ELSE w2 END AS path, round(greatest(coalesce(d0, -1e300), coalesce(d1, -1e300), coalesce(d2, -1e300)), 6) AS logp, CASE WHEN {_TOP3} = 0 THEN c0 WHEN {_TOP3} = 1 THEN c1 ELSE c2 END AS visits FROM e",
    "class_margins": f"{_MARGINS} SELECT seq_id, label, round(margin, 6) AS margin, round(1 / (1 + exp(-margin)), 6) AS performance, round(1 / (1 + exp(-margin)) * (1 - 1 / (1 + exp(-margin))), 6) AS slope, best FROM g",
    "class_errors": f"{_MARGINS} SELECT k AS label, count(*) FILTER (label = k) AS n, count(*) FILTER (label = k AND best <> k) AS false_negatives, count(*) FILTER (best = k AND label <> k) AS false_positives FROM g, (VALUES (0), (1)) c(k) WHERE label = k OR best = k GROUP BY k",
    "pair_classes": f"{_PAIRS_SQL} SELECT seq_id, path, round(l / {2**30}.0, 5) AS logp FROM ends",
    "pair_path_logp": f"{_PAIRS_SQL} SELECT seq_id, round(l / {2**30}.0, 5) AS logp FROM ends",
    "viterbi_stream": f"{_STREAM}, best AS (SELECT CASE WHEN d1 > d0 THEN w1 ELSE w0 END AS path FROM v ORDER BY t DESC LIMIT 1) SELECT o.t - 1 AS pos, CAST(substr(path, CAST(o.t AS BIGINT), 1) AS INTEGER) AS state FROM ord o, best",
    "stream_loglik": f"{_STREAM} SELECT CAST(0 AS BIGINT) AS seq_id, round(GREATEST(d0, d1), 4) AS logp, t AS n FROM v ORDER BY t DESC LIMIT 1",
    "mean_sequence": f"WITH {_ORDERED} SELECT CAST(t - 1 AS INTEGER) AS pos, round(sum(value) / (SELECT count(DISTINCT user_id) FROM events), 6) AS mean, count(*) AS n FROM ord WHERE t <= 50 GROUP BY t",
    "scatter_matrix": f"WITH {_ORDERED}, d AS (SELECT user_id, t, value - avg(value) OVER (PARTITION BY t) AS x FROM ord WHERE t <= 8) SELECT CAST(a.t - 1 AS INTEGER) AS i, CAST(b.t - 1 AS INTEGER) AS j, round(sum(a.x * b.x), 4) AS s, count(*) AS n FROM d a JOIN d b USING (user_id) GROUP BY a.t, b.t",
    "bernoulli_split": "SELECT CASE WHEN (event_id * 2654435761) % 1000 < 700 THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM events GROUP BY 1",
    "model_normalize": f"WITH {_ORDERED}, m AS (SELECT first_value(sym) OVER w AS model_id, sym AS src, lead(sym) OVER w AS dst FROM ord WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT model_id, src, dst, round(count(*) / sum(count(*)) OVER (PARTITION BY model_id, src), 9) AS p FROM m WHERE dst IS NOT NULL GROUP BY model_id, src, dst",
    "base_vectors": f"WITH {_BASES}, c AS (SELECT doc_id, length(seq) AS n, length(seq) - length(replace(seq, 'a', '')) AS a, length(seq) - length(replace(seq, 'c', '')) AS c FROM s) SELECT doc_id, round(CAST(n AS DOUBLE), 6) AS total, CASE WHEN n > 0 THEN round(a / n, 9) END AS share_a, round(CAST(n + c AS DOUBLE), 6) AS product_c FROM c",
}

QUERIES = {
    f.__name__: f
    for f in (
        nt_counts, nt_shares, codon_frames, codon_rollup, revcomp_start_stop, codon_types, event_sequences, sequence_profile, gap_lengths, gap_list, contained, lengths_by_strand, mirrored,
        islands_by_type, overlap_pairs, overlap_match, unmatched, overlap_pairs_whole, overlap_match_whole, unmatched_whole, greedy_match, match_agreement, plotted, listed_symbols, xml_symbols, uncovered_cuts, transition_counts, kgram_background, forward_loglik, forward_loglik_fold, backward_loglik, silent_loglik,
        viterbi_logp, viterbi_states, posterior_states, posterior_states_whole, model_scores, best_model, set_likelihood, gauss_loglik, normal_densities, em_one_step, em_trained, gauss_trained, model_clusters,
        model_mixture, sampled_like_users, pair_alignments, mean_sequence, mean_sequence_whole, scatter_matrix, scatter_matrix_whole, bernoulli_split, model_normalize, base_vectors, codon_model, viterbi_stream, stream_loglik, genes_of_corpus, class_margins, class_errors, told_apart_gradient, told_apart_closed, pair_classes, pair_path_logp, switching_paths,
        gap_hazards, gap_loop, strand_gaps, codon_regions, gene_ends, genes_read_whole, position_profiles, mixture_selection, next_symbol_shares, drawn_on, kbest_labels, cut_trained, clusters_from_random,
    )
}
