"""Personal data by fixed patterns and bootstrapped contexts, with DataFrame functions only.

Base spans are matches of four patterns that pass a check (parts of an address, Luhn, digits). They are the sure seeds of
the bootstrapping, with score 1. Candidates are runs of letters, digits and _+/- of six or more that hold a digit and meet no base
span; those that look machine-made (16 or more hex digits, or capitals and digits) are weak seeds, with a prior of 0.8.

Every item (base span or candidate) has lexical patterns, made of lexemes (words or single punctuation marks): the two and the
three lexemes before it, the lexemes on both sides of it, and, where it begins with four letters, these with its length.
In rounds, items with a score of 0.5 or more induce the patterns that lead to at least three of them; a pattern's occurrences are
counted over the whole corpus; its confidence is the sum of the scores of the items that it leads to, over its occurrences. A
candidate's score is 1 - prod(1 - confidence) over its confident patterns. What rises induces patterns in the next round; rounds
end when no pattern is new and no score rises. Candidates that confident patterns lead to are spans of kind `context`; weak
seeds that none leads to are not. Patterns of common words are ruled out by the documents that may hold identifiers, before any
count over the whole corpus.

Nulls: a null text is empty; a null doc_id keeps its row. Empty texts have no spans. Repeated rows get the same spans. Extra
columns are ignored. Very long texts and runs of digits are matched without backtracking. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, settle, sha256

KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<s:int,e:int>>"

#: Runs are taken whole (++), which changes no match, and begin where a run begins or the last match ended.
_RUN = "(?:(?<!{0})|\\G){0}++"
PATTERNS = {
    "email": _RUN.format("[A-Za-z0-9._%+-]") + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _RUN.format("[0-9]") + r"\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"(?:[0-9][\x20-]?){15}[0-9]", "phone": r"\+[0-9][\x20().0-9-]"}
CANDIDATE = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{6,}+"
#: Weak seeds.
MACHINE_MADE = r"^(?:(?=.*[a-f].*[a-f])(?=.*[0-9].*[0-9])[0-9a-f]{16,}|(?=(?:.*[A-Z]){4})(?=.*[0-9])[A-Z0-9]{16,})$"
PRIOR = 0.8
LEXEME = r"[\p{L}\p{N}_]++|[^\p{L}\p{N}_\s]"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        # Without leading zeros a part is at most 255 by length, then by digits.
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def found(text: Column, pattern: str, valid, hint: str) -> Column:
    """Spans (s, e in code points, e exclusive) of the matches that are valid, leftmost and not overlapping."""
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(gaps, matches, lambda g, m: F.struct(F.char_length(g).alias("g"), m.alias("m")))
    none = F.array().cast(SPAN)

    def step(acc, x):
        s = acc["p"] + x["g"]
        e = s + F.coalesce(F.char_length(x["m"]), F.lit(0))
        one = F.array(F.struct(s.alias("s"), e.alias("e")))
        return F.struct(e.alias("p"), F.when(x["m"].isNotNull() & valid(x["m"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(both, F.struct(F.lit(0).alias("p"), none.alias("out")), step, lambda acc: acc["out"])
    held = text.contains(hint) if len(hint) == 1 else text.rlike(hint)
    return F.when(held, spans).otherwise(none)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with a column of spans for each kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({k: found(text, PATTERNS[k], lambda m, k=k: _valid(k, m), HINTS[k]) for k in KINDS})


def _named(kind: str, *lexemes: Column) -> Column:
    """A pattern's name; null if it lacks a lexeme."""
    return F.concat(F.lit(kind), *[F.concat(F.lit(" "), x) for x in lexemes])


def _patterns(text: Column, s: Column, e: Column, value: Column) -> Column:
    """The patterns of an item at s..e. Lexemes are sought within 64 characters before it and 40 after."""
    lexemes = lambda c: F.regexp_extract_all(F.lower(c), F.lit(LEXEME), F.lit(0))
    near = lexemes(F.substring(text, F.greatest(s - 64, F.lit(0)) + 1, F.least(s, F.lit(64))))
    near = F.when(s > 64, F.slice(near, F.lit(2), F.greatest(F.size(near) - 1, F.lit(0)))).otherwise(near)  # the first may be cut
    near = F.slice(F.concat(F.array_repeat(F.lit(None).cast("string"), 3), near), -3, 3)
    after = F.get(lexemes(F.substring(text, e + 1, F.lit(40))), F.lit(0))
    one, two, three = (F.element_at(near, -i) for i in (1, 2, 3))
    inner = F.when(value.rlike("^[A-Za-z]{4}"), F.concat(F.lit("inner "), F.substring(value, 1, 4), F.lit(" "), F.char_length(value)))
    return F.array_compact(F.array(_named("two", two, one), _named("three", three, two, one), _named("around", one, after), inner))


def _occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often each of the patterns of lexemes stands at a word, over all words of docs."""
    held = F.broadcast(patterns) if patterns.count() <= BROADCAST_ROWS else patterns
    words = docs.select(F.regexp_extract_all(F.lower("text"), F.lit(LEXEME), F.lit(0)).alias("w")).where(F.size("w") > 1)
    at = lambda i: F.get("w", i)
    every = F.transform(
        F.sequence(F.lit(1), F.size("w") - 1),
        lambda i: F.when(at(i).rlike(r"^[\p{L}\p{N}_]"), F.array(_named("two", F.when(i > 1, at(i - 2)), at(i - 1)), _named("three", F.when(i > 2, at(i - 3)), F.when(i > 1, at(i - 2)), at(i - 1)), _named("around", at(i - 1), at(i + 1)))),
    )
    rows = words.select(F.explode(every).alias("p")).select(F.explode("p").alias("pattern"))
    return rows.join(held, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("n"))


def _anew(counts: DataFrame) -> DataFrame:
    """pattern and n as new columns: a union of checkpoints can't carry over what Spark has noted of theirs."""
    return counts.select(F.concat("pattern", F.lit("")).alias("pattern"), (F.col("n").cast("double") + 0.0).alias("n"))


def _counted(docs: DataFrame, fresh: DataFrame, confident: float, few) -> DataFrame:
    """pattern, n (its occurrences in the corpus) of the patterns of fresh (pattern, times, kind) that may be confident.

    Those of the items themselves (kind inner) occur as often as their items. Most of the others are common words and
    fail already on the documents that may hold identifiers, and of these already on an eighth: a count only grows with what is read, so a pattern
    that fails on part of the documents fails on all, and need not be counted further. Only the rest are counted over all, and
    only in documents that hold one of the lexemes before their places, if those are few.
    """
    lexical = few(fresh.where("kind <> 'inner'").select("pattern", "times", F.lit(0).cast("long").alias("seen")))
    some = docs.where(F.col("text").rlike("[0-9]"))
    early = F.pmod(F.xxhash64("text"), F.lit(8)) == 0
    for part in (early, ~early):
        n = _occurrences(some.where(part), lexical.select("pattern"))
        lexical = few(lexical.join(n, "pattern", "left").select("pattern", "times", (F.col("seen") + F.coalesce("n", F.lit(0))).alias("seen")).where(F.col("times") >= confident * F.col("seen")))
    lexical = lexical.select("pattern")
    before = F.when(F.col("pattern").startswith("around "), 2).otherwise(-1)  # "around x y", "two x y", "three x y z"
    lead = [r[0] for r in lexical.select(F.element_at(F.split("pattern", " "), before).alias("x")).distinct().limit(33).collect()]
    if len(lead) <= 32:
        docs = docs.where(F.exists(F.array(*[F.lit(x) for x in lead]), lambda x: F.contains(F.lower("text"), x)) if lead else F.lit(False))
    return few(fresh.where("kind = 'inner'").select("pattern", F.col("times").alias("n")).unionByName(_occurrences(docs, lexical)))


#: Rows of the graph for each partition of the tables that the rounds make of it.
GRAPH_ROWS = 50_000


def contextual(docs: DataFrame, spanned: DataFrame, least_seeds: int = 3, confident: float = 0.5, accepted: float = 0.5, rounds: int = 100) -> DataFrame:
    """Accepted candidates: doc_id, text_hash, s, e. spanned: doc_id, text_hash, items (kind, s, e, value, patterns)."""
    items = spanned.select("doc_id", "text_hash", F.explode("items").alias("x")).select("doc_id", "text_hash", "x.*")
    prior = F.when(F.col("kind") != "context", 1.0).when(F.col("value").rlike(MACHINE_MADE), PRIOR).otherwise(0.0)
    graph = items.select(prior.alias("prior"), "value", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("prior").alias("prior"), F.count("*").alias("times"))
    # A pattern that leads to few values can't be induced.
    graph = settle(graph)
    parts = 1 + graph.count() // GRAPH_ROWS
    few = lambda df: settle(df.coalesce(parts))  # noqa: E731  no table of a round has more rows than the graph
    often = graph.groupBy("pattern").agg(F.count("*").alias("values"), F.sum("times").alias("all")).where(F.col("values") >= least_seeds)
    often = few(often.select("pattern", "all"))
    graph = few(graph.join(F.broadcast(often) if often.count() <= BROADCAST_ROWS else often, "pattern"))
    scores = few(graph.groupBy("value").agg(F.max("prior").alias("score")).withColumn("raised", F.lit(0.0)))
    known, judged = None, None
    for _ in range(rounds):
        linked = graph.join(scores, "value")
        led = linked.groupBy("pattern", "all").agg(F.count_if(F.col("score") >= accepted).alias("seeds"), F.sum(F.col("times") * F.col("score")).alias("sure"))
        led = few(led)
        fresh = led.where(F.col("seeds") >= least_seeds).select("pattern", F.col("all").alias("times"), F.split("pattern", " ")[0].alias("kind"))
        fresh = few(fresh if judged is None else fresh.join(judged, "pattern", "left_anti"))
        new = fresh.count()
        if new:
            more = _counted(docs, fresh, confident, few)
            known = more if known is None else few(_anew(known).unionByName(_anew(more)))
            names = fresh.select("pattern", F.lit(0).alias("n"))
            judged = names if judged is None else few(_anew(judged).unionByName(_anew(names)))
        if known is None:
            return items.limit(0).select("doc_id", "text_hash", "s", "e")
        weight = led.join(known, "pattern").select("pattern", F.least(F.lit(1.0), F.col("sure") / F.col("n")).alias("confidence")).where(F.col("confidence") >= confident)
        weight = few(weight)
        weight = F.broadcast(weight) if weight.count() <= BROADCAST_ROWS else weight
        raised = graph.join(weight, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(1.000001 - F.col("confidence"))))).alias("now"))
        after = few(scores.join(raised, "value", "left").select("value", F.greatest("score", F.coalesce("now", F.lit(0.0))).alias("score"), F.greatest("raised", F.coalesce("now", F.lit(0.0))).alias("raised"), (F.coalesce("now", F.lit(0.0)) > F.col("score") + 0.01).alias("rose")))
        rising = bool(after.where("rose").take(1))
        scores = after.drop("rose")
        if not new and not rising:
            break
    else:
        raise RuntimeError(f"scores still rise after {rounds} rounds")
    good = scores.where(F.col("raised") >= accepted).select("value")
    here = items.where("kind = 'context'").select("doc_id", "text_hash", "s", "e", "value", F.explode("patterns").alias("pattern"))
    return here.join(weight.select("pattern"), "pattern", "left_semi").join(good, "value", "left_semi").select("doc_id", "text_hash", "s", "e")


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, the four kinds' spans, and context, the spans that the bootstrapping adds. One row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = base_spans(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash")))
    d = d.withColumn("context", found(F.col("text"), CANDIDATE, lambda m: F.lit(True), r"[0-9]"))
    base = F.concat(*[F.col(k) for k in KINDS])
    clear = lambda c: ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
    d = d.withColumn("context", F.filter("context", clear))

    def item(k):
        def one(x):
            value = F.substring("text", x["s"] + 1, x["e"] - x["s"])
            return F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), value.alias("value"), _patterns(F.col("text"), x["s"], x["e"], value).alias("patterns"))

        return F.transform(k, one)

    d = d.withColumn("items", F.concat(*[item(k) for k in (*KINDS, "context")]))
    spanned = settle(d.select("doc_id", "text_hash", *KINDS, "items"))
    added = contextual(docs, spanned).distinct().groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("context"))
    added = added.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash")
    out = spanned.drop("items").join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select("doc_id", "text_hash", *KINDS, F.coalesce("context", F.array().cast(SPAN)).alias("context"))


def _joined(kinds) -> Column:
    def part(k):
        return F.transform(k, lambda x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string")))

    return F.concat_ws(",", F.concat(*[part(k) for k in kinds]))


def report(docs: DataFrame) -> DataFrame:
    """Counts of the spans by kind and of all, the base spans' digest, and all spans as text."""
    d = extract(docs)
    counts = {k: F.size(k).cast("long") for k in (*KINDS, "context")}
    base = [counts[k].alias(f"n_{k}") for k in KINDS]
    return d.select("doc_id", *base, sha256(_joined(KINDS)).alias("base_sha256"), _joined((*KINDS, "context")).alias("spans"), counts["context"].alias("n_context"), sum(counts.values(), F.lit(0)).cast("long").alias("n_spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans are one, named after the first. Columns of docs."""
    spans = extract(docs).dropDuplicates(["doc_id", "text_hash"])

    def names(k):
        return F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k")))

    named = F.concat(*[names(k) for k in (*KINDS, "context")])
    spans = spans.select(F.col("doc_id").alias("_pii_id"), F.col("text_hash").alias("_pii_hash"), F.array_sort(named).alias("_pii_spans")).where(F.size("_pii_spans") > 0)
    same = F.col("doc_id").eqNullSafe(F.col("_pii_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_pii_hash"))
    d = docs.join(spans, same, "left")

    def step(acc, x):
        new = F.concat(acc["out"], F.substring("text", acc["p"] + 1, x["s"] - acc["p"]), F.lit("["), F.upper(x["k"]), F.lit("]"))
        return F.struct(F.greatest(acc["p"], x["e"]).alias("p"), F.when(x["s"] >= acc["p"], new).otherwise(acc["out"]).alias("out"))

    text = F.aggregate("_pii_spans", F.struct(F.lit(0).alias("p"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring("text", acc["p"] + 1, F.char_length("text"))))
    none = F.col("_pii_spans").isNull()
    d = d.withColumn("text", F.when(none, F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(none, F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return d.select(*docs.columns)
