"""The operators that run numpy in tasks, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from braidseq.llm import embeddings, minhash, quality, sentencepiece_scan, substring, suffixes, toxicity
from braidseq.llm.common import components

W = re.compile(r"[^\x20\x09-\x0D]+")
_R = random.Random(3)
_VOCAB = [f"w{i}" for i in range(300)]


def prose(n):
    return " ".join(_R.choice(_VOCAB) for _ in range(n))


def edited(t, n):
    w = t.split(" ")
    for _ in range(n):
        w[_R.randrange(len(w))] = f"x{_R.randrange(10**6)}"
    return " ".join(w)


def corpus():
    passage, line, base = prose(60), prose(25), prose(150)
    texts = [None, "", " \t\n", "one", "One", "a b c", "A B C", "same same same same same same " * 20, prose(30) + "\x85" + prose(5)]
    texts += [prose(40) + " " + passage + " " + prose(20) for _ in range(8)] + [passage] * 3
    texts += [prose(10) + "\n" + line + "\n" + prose(30) for _ in range(12)]
    texts += [edited(base, k % 9) for k in range(40)] + [base.upper(), base]
    texts += ["é漢😀 " * 150, prose(5) + "é漢😀 " * 150, prose(3000), "x" * 900, "x" * 450, "\0" * 500 + "end"]
    return texts


def test_substring(docs_of):
    docs = docs_of(corpus())
    seen, want = set(), {}
    for d, t in sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()):
        w = W.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    for limit in (10**6, 0):  # marked documents by broadcast, and by shuffles on both sides
        got = {r["doc_id"]: tuple(r)[1:] for r in substring.cut(docs, limit=limit).collect()}
        assert got == want
    assert substring.cut(docs_of([])).count() == 0


def test_substring_long_text_in_parts(docs_of, monkeypatch):
    from braidseq.llm import seeds

    monkeypatch.setattr(seeds, "BITS", 8)
    words = [f"u{i}" for i in range(700)]
    texts = [" ".join(words), " ".join(words[100:400]), prose(90)]
    units, first = substring._units(texts)
    rows = []
    for s in range(0, 700, 255 - 20):
        e = min(700, s + 254)
        t, h, c, p, m = seeds.anchors(units[s:e], np.array([0, e - s]), 20, 6)
        rows += [q + s + i for q, n in zip(p, m) for i in range(n)]
    assert sorted(set(rows)) == list(range(681))


def test_suffixes(docs_of, monkeypatch):
    docs = docs_of(corpus())
    count = Counter()
    raw = {r["doc_id"]: (r["text"] or "").encode() for r in docs.select("doc_id", "text").collect()}
    for b in raw.values():
        count.update(b[p : p + 400] for p in range(len(b) - 399))
    want = {}
    for d, b in raw.items():
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                gone[p] += 1
                gone[p + 400] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want[d] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept)
    got = {r["doc_id"]: (*tuple(r)[1:-1], bytes(r["kept"])) for r in suffixes.cut(docs).collect()}
    assert got == want
    monkeypatch.setattr(suffixes, "SPLIT", 2)  # anchors of a few snippets are split over shards and merged
    got = {r["doc_id"]: (*tuple(r)[1:-1], bytes(r["kept"])) for r in suffixes.cut(docs, limit=0).collect()}
    assert got == want
    assert suffixes.cut(docs_of([])).count() == 0


def test_suffix_array_and_kasai():
    for text in (b"banana" * 30, bytes(200), b"mississippi", bytes(_R.randrange(3) for _ in range(500))):
        s = np.frombuffer(text, np.uint8).astype(np.int16) + 1
        order = suffixes.suffix_array(s)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        lcp = suffixes.kasai(s, order, len(text) - np.arange(len(text)), 50, lanes=7)
        for k in range(1, len(text)):
            a, b = text[order[k - 1] :], text[order[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(n, 50)


@pytest.mark.parametrize("words", [4, 5])
def test_minhash(docs_of, words):
    docs = docs_of(corpus())
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    group = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, words).collect()}
    assert got == {d: (len(s), group[d], group[d] == d) for d, s in sets.items()}
    left = {r["doc_id"] for r in minhash.deduplicated(docs, words).select("doc_id").collect()}
    assert left == {d for d in sets if group[d] == d}
    assert minhash.near_duplicates(docs_of([])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "extra") for i, v in rows], "vec_id long, embedding array<float>, label int, rep string")


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 64))
    rows = [(i + 1, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, (base[i] + 0.2 * rng.normal(size=64)).tolist()) for i in range(200)] + [(2000 + i, (base[0] + 0.15 * rng.normal(size=64)).tolist()) for i in range(60)]
    rows += [(3000 + i, base[5].tolist()) for i in range(30)] + [(3100, (base[5] * 1e3).tolist()), (3200, None), (3201, [0.0] * 64), (3202, [None] * 64), (3203, [float("nan")] + [1.0] * 63), (3204, [float("inf")] * 64), (3205, []), (3206, [1.0, 2.0]), (3207, [2.0, 4.0])]
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i <= 3100]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= 0.95
    ids = np.array([i for i, _ in good])
    label = ids.copy()
    while True:
        new = np.array([label[m].min() for m in near])
        if (new == label).all():
            break
        label = new
    want = {int(i): (int(m.sum()) - 1, int(c), bool(i == c)) for i, m, c in zip(ids, near, label)}
    want |= {i: (0, i, True) for i in range(3200, 3206)} | {3206: (1, 3206, True), 3207: (1, 3206, False)}
    df = vectors(spark, rows)
    assert {r["vec_id"]: tuple(r)[1:] for r in embeddings.near_vectors(df).collect()} == want
    monkeypatch.setattr(embeddings, "SPLIT", 20)  # crowded filters in blocks
    assert {r["vec_id"]: tuple(r)[1:] for r in embeddings.near_vectors(df).collect()} == want
    assert embeddings.near_vectors(vectors(spark, [])).count() == 0


def test_filters_recall():
    """Of pairs at exactly 0.95, at most one in 1000 has no common filter, at two sizes of the corpus."""
    rng = np.random.default_rng(4)
    for n in (10_000, 1_000_000):
        threshold, blocks, words = embeddings.plan(n, 64, 10, 96)
        x = rng.normal(size=(3000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.normal(size=(3000, 64))
        y -= (y * x).sum(axis=1, keepdims=True) * x
        y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        met = np.zeros(3000, bool)
        for number in (0, 1):
            a, b = ({*zip(*map(np.ndarray.tolist, embeddings.passing(v, 64, threshold, blocks, words, number, 10)))} for v in (x, y))
            met[[i for i, _ in a & b]] = True
        assert met.mean() >= 0.999, (n, met.mean())


def brute_best(p, text):
    best = {0: (0.0, ())}
    for e in range(1, len(text) + 1):
        best[e] = max(((best[s][0] + w, (*best[s][1], s)) for s, w in p.ending(text, e)), key=lambda x: x[0])
    return best[len(text)][0]


def test_sentencepiece(docs_of):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_scan.MODEL)
    texts = [*corpus(), "  two  spaces ", "tab\tnew\nline", "ﬁ　１", "▁mark", "x" * 3000]
    got = {r["doc_id"]: r for r in sentencepiece_scan.encode(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        assert list(got[i + 1]["ids"]) == sp.encode(t or "") and got[i + 1]["n_tokens"] == len(sp.encode(t or "")), t
        assert got[i + 1]["round_trip"] == ("▁" not in (t or ""))
    back = sentencepiece_scan.decode(sentencepiece_scan.encode(docs_of(texts)))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i + 1: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    assert sentencepiece_scan.encode(docs_of([])).count() == 0


def test_sentencepiece_scan(docs_of):
    """As a unigram model: chunked by the max-plus scan, scores equal to the best path over the whole text."""
    with open(sentencepiece_scan.MODEL, "rb") as f:
        raw = f.read()
    at = raw.index(b"\x18\x02\x20\x80\xfa\x01")  # the field that holds the type
    raw = raw[: at + 1] + b"\x01" + raw[at + 2 :]
    p = sentencepiece_scan.Pieces.read(raw)
    assert not p.bpe
    texts = ["the cat and the hat " * 20, "a" * 333, "漢字 and\nlines " * 12, "short", "", None, "x " + " " * 120 + "y", "the cat and the hat " * 20]
    got = {r["doc_id"]: r for r in sentencepiece_scan.encode(docs_of(texts), raw, chunk=40).collect()}
    score = {i: s for t, s in p.scores.items() for i in [p.ids[t]]}
    for i, t in enumerate(texts):
        ids = list(got[i + 1]["ids"])
        assert p.decode(ids) == (t or "") and got[i + 1]["round_trip"]
        if t:
            best = brute_best(p, "▁" + t.replace(" ", "▁"))
            mine = sum(score.get(x, 0) for x in ids) + p.unknown * sum(1 for c in t if c not in p.scores and c != " ")
            assert abs(best - mine) <= 1e-6 * abs(best) + 1e-3, t


def labelled(spark, docs_of):
    good = [prose(80) for _ in range(120)]
    toxic = [edited(prose(80), 1) + " " + _R.choice(["vile", "nasty", "awful"]) + "ness scum " + prose(5) for _ in range(60)]
    junk = [" ".join([w] * 10 for w in []) + " ".join(_R.choice(_VOCAB) + "###" for _ in range(60)) for _ in range(60)]
    texts = [*good, *toxic, *junk, None, ""]
    labels = [(i + 1, int(not 180 <= i < 240), int(120 <= i < 180), "x") for i in range(240)]
    return docs_of(texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score string")


@pytest.mark.parametrize("module, bad", [(toxicity, range(121, 181)), (quality, range(181, 241))])
def test_classifiers(spark, docs_of, module, bad):
    from zlib import crc32

    docs, labels = labelled(spark, docs_of)
    rows = {r["doc_id"]: r for r in module.classified(docs, labels).collect()}
    assert len(rows) == 242
    for d, r in rows.items():
        assert 0 <= r["score"] <= 1 and r["held_out"] == (crc32(str(d).encode()) % 5 == 0)
    held = [r for d, r in rows.items() if r["held_out"] and d <= 240]
    right = sum((r["predicted"] == 1) == ((r["doc_id"] in bad) == (module is toxicity)) for r in held)
    assert right >= 0.95 * len(held)
    again = {r["doc_id"]: r["score"] for r in module.classified(docs.repartition(3), labels).collect()}
    assert all(abs(again[d] - r["score"]) < 1e-9 for d, r in rows.items())
    assert module.classified(docs_of([]), labels).count() == 0
    assert module.classified(docs, labels.limit(0)).count() == 242


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    made = []
    for _ in range(500):
        t = rng.choice(80, 6, replace=False)
        w = rng.random(6)
        made.append(dict(zip(t.tolist(), (w / np.linalg.norm(w)).tolist())))
    index = toxicity.Index(made, rng.integers(0, 2, 500), np.arange(500), 80)
    dense = np.zeros((500, 80))
    for i, v in enumerate(made):
        dense[i, list(v)] = list(v.values())
    for q in made[:50]:
        at, cosines = index.nearest(np.array(list(q)), np.array(list(q.values())))
        assert np.allclose(np.sort(dense @ dense[made.index(q)])[::-1][: len(at)], cosines)
