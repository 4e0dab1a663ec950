"""Ranked search, filter audit and decontamination against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import pytest

from braidseq.llm import decontaminate, filter_audit, ranked
from braidseq.llm.terms import Tokens, folded

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_R = random.Random(11)
_VOCAB = ["the", "of", "and", "Éa", "漢字", "x9"] + [f"t{i}" for i in range(120)]


def lowered(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def terms(s):
    return [lowered(t) for t in TERM.findall(s or "")]


def prose(n):
    return "".join(_R.choice(_VOCAB) + _R.choice([" ", ", ", ".\n", "_", " - "]) for _ in range(n))


ITEMS = [(1, "The of AND t3 t4 t5"), (2, prose(25)), (3, None), (4, ""), (5, "nowhere_else words-here"), (6, "t7"), (7, "... !!"), (None, "t8 T9 t8"), (2, "t1 t2 t3"), (10, prose(12)), (2, "t1 t2 t3")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def corpus():
    passage = ITEMS[1][1]
    texts = [None, "", " .,;", "the", "The THE the", "t7 " * 40, passage, prose(30) + passage + prose(5), passage.upper(), "é" * 10, prose(4000)]
    texts += [prose(_R.randrange(3, 60)) for _ in range(150)] + [prose(20) + passage[:80] for _ in range(6)] + ["t1, t2: T3", "x" + passage, ITEMS[9][1] + ITEMS[1][1], "t7 t8 t9 t8 t9 t8"]
    return texts + [texts[20]] * 5


CORPUS = corpus()


def test_tokens_in_pieces():
    texts = [folded(t) for t in CORPUS]
    for size in (1 << 22, 50, 1):
        t = Tokens(texts, size)
        for i in range(len(texts)):
            assert t.words(t.first[i], t.first[i + 1]).decode() == " ".join(terms(CORPUS[i]))
        assert (t.hash == Tokens(texts).hash).all()


def brute_search(docs, items, k):
    bags = {d: Counter(terms(t)) for d, t in docs}
    sizes = {d: b.total() for d, b in bags.items() if b}
    n, total = len(sizes), sum(sizes.values())
    df = Counter(w for b in bags.values() for w in b)
    out = set()
    for item_id, text in set(items):
        scores = []
        for d in sizes:
            m = 100 - 50 + (50 * sizes[d] * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * bags[d][w]) // (1000 * bags[d][w] + 20 * m)) for w in set(terms(text)) if bags[d][w])
            if s > 0:
                scores.append((-s, d))
        out |= {(item_id, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])}
    return out


def test_search(spark, docs_of, items):
    texts = CORPUS
    docs, want = docs_of(texts), brute_search([(i + 1, t) for i, t in enumerate(texts)], ITEMS, 7)
    as_set = lambda df: {tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()}
    got = ranked.search(docs, items, k=7)
    assert as_set(got) == want and got.count() == len(want)
    assert as_set(ranked.search(docs, items, k=7, limit=0)) == want  # pairs shuffled
    assert as_set(ranked.search(docs, items, k=7, most=60)) == want  # items in parts
    assert as_set(ranked.search(docs, items, k=500)) == brute_search([(i + 1, t) for i, t in enumerate(texts)], ITEMS, 500)
    for d, i in ((docs_of([]), items), (docs, items.limit(0)), (docs_of([None, ""]), items)):
        assert ranked.search(d, i, k=7).count() == 0


def test_search_proves_documents_out(docs_of, items):
    """The bounds exclude most documents, and never one of the best."""
    import numpy as np

    docs = docs_of(CORPUS).selectExpr("doc_id as d", "text")
    words = {w for _, t in ITEMS for w in folded(t).split()}
    sizes = {i + 1: len(terms(t)) for i, t in enumerate(CORPUS)}
    queries = ranked.Queries([(i, folded(t)) for i, t in ITEMS], sum(n > 0 for n in sizes.values()), sum(sizes.values()), ranked.frequencies(docs, words))
    bags, seen = {i + 1: Counter(folded(t).split()) for i, t in enumerate(CORPUS)}, set()
    loose = 0
    for r in ranked.index(docs).collect():
        assert [sizes[d] for d in r["docs"]] == list(r["sizes"])
        bound = queries.bounds(np.array(r["sizes"]), r["bits"], r["slices"])
        for i, d in enumerate(r["docs"]):
            seen.add(d)
            for q in range(len(ITEMS)):
                s = queries.score(q, bags[d], queries.length_part(sizes[d]))
                assert s <= bound[q, i] <= 3 * s + 1e7
    assert seen == {d for d, n in sizes.items() if n}


def test_search_nulls_and_shared_ids(spark, docs_of, items):
    docs = docs_of(["t7 a", "t7 b b", "t7 a", "t7", "t7 t8"], [None, None, 5, 5, 5])
    got = ranked.search(docs.unionByName(docs), items.where("item_id = 6"), k=3).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3]
    assert {r["doc_id"] for r in ranked.search(docs, items.where("item_id = 6"), k=9).collect()} == {None, 5}


def windows_of(ws, n):
    return [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]


def brute_marks(docs, items, n):
    wins = {}
    for item_id, text in items:
        ws = terms(text)
        for w in windows_of(ws, min(n, len(ws))) if ws else []:
            wins.setdefault(w, set()).add("" if item_id is None else str(item_id))
    out = []
    for d, t in docs:
        ws, hit, names = terms(t), set(), set()
        for k in {len(w) for w in wins}:
            for i, w in enumerate(windows_of(ws, k)):
                if w in wins:
                    hit |= set(range(i, i + k))
                    names |= wins[w]
        out.append((d, len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontamination(docs_of, items):
    texts = CORPUS
    docs, want = docs_of(texts), brute_marks([(i + 1, t) for i, t in enumerate(texts)], ITEMS, 10)
    assert any(r[2] for r in want) and not all(r[2] for r in want)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(decontaminate.report(docs, items)) == want
    assert key(decontaminate.report(docs, items, most=40)) == want  # items in parts, a pass for each
    twice = docs_of(["t7 a", "t7 a", "b", None], [None, None, 3, 3])
    for most in (1 << 20, 40):
        got = decontaminate.report(twice, items, most=most).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in got) == [("3", 0, 0), ("3", 1, 0), ("None", 2, 1), ("None", 2, 1)]
    assert decontaminate.report(docs_of([]), items).count() == 0
    assert {r["contaminated"] for r in decontaminate.report(docs, items.limit(0)).collect()} == {False}


def test_decontaminated_texts(docs_of, items):
    texts = ["Start - t7! end", None, "", "clean", "T8 t9_T8 tail", "a t7 t7 b t7"]
    docs = docs_of(texts)
    cut = decontaminate.decontaminated(docs, items)
    assert cut.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "Start - ! end", 2: None, 3: "", 4: "clean", 5: " tail", 6: "a  b "}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(docs, items, spans=False).collect()) == [2, 3, 4]


def brute_audit(docs, labels):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in (0, 1))
    fails = []
    for d, t, source in docs:
        t = t or ""
        ws = WORD.findall(t)
        f = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d}
        fails.append((source or "", {k for k, v in f.items() if v}, d in good, d in toxic))
    out = []
    for part in {p for p, *_ in fails}:
        own, shares, rows = [x for x in fails if x[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shares[f] += len(gone)
                rows.append((part, "".join(order), step, len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)))
        out += [(*r, shares[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_audit(spark):
    base = ["", None, "word " * 60, "AB cd " * 40, "a # b", " ".join(f"w{i}" for i in range(70)), " ".join(f"w{i}" for i in range(70)) + " $", "Tab\tline\x0bfeed " + " ".join(f"é{i}" for i in range(60)), "X" * 50]
    docs, labels = [], []
    for i in range(120):
        docs.append((None if i % 17 == 16 else i, _R.choice(base), _R.choice([None, "", "p", "q"])))
        labels.append((None if i % 13 == 0 else i, i % 3 % 2, int(i % 5 == 0)))
    docs += [docs[3], docs[3], docs[10]]
    labels += [(3, 1, None), (999, 1, 1), (4, None, None)]
    d = spark.createDataFrame([(*x, "n", "m") for x in docs], "doc_id long, text string, source string, mask string, words string")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(d, y)
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(docs, labels)
    assert filter_audit.audit(d.limit(0), y).count() == 0
    fewer = filter_audit.audit(d, y, {k: filter_audit.CHECKS[k] for k in "DA"}, None)
    assert {r["filter_order"] for r in fewer.collect()} == {"DA", "AD"}


def test_shapley_rows_are_the_permutation_average():
    for n in (2, 3, 5):
        rows = filter_audit.shapley_rows(n)
        v = [_R.randrange(1000) for _ in range(1 << n)]
        want = [0] * n
        for order in permutations(range(n)):
            s = 0
            for i in order:
                want[i] += v[s | 1 << i] - v[s]
                s |= 1 << i
        assert [sum(a * b for a, b in zip(row, v)) for row in rows] == want
