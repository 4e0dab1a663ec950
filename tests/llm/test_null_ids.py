"""A toxic row goes and a clean row stays by its own text, whatever its doc_id."""

from braidseq.llm import toxicity

from .test_arrow import labelled


def test_toxic_rows_by_their_own_text(spark, docs_of):
    docs, labels = labelled(spark, docs_of)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    bad, good = texts[150], texts[20]
    more = spark.createDataFrame([(None, bad), (None, good), (9001, bad + " x"), (9001, good + " x")], "doc_id long, text string")
    got = toxicity.accepted(docs.select("doc_id", "text").unionByName(more), labels)
    rest = sorted(((r["doc_id"], r["text"]) for r in got.collect() if r["doc_id"] in (None, 9001)), key=str)
    assert sorted([(None, good), (9001, good + " x")], key=str) == rest


def several(spark):
    """Rows without a doc_id and rows of one doc_id, with different texts; some given twice."""
    import random

    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    a, b, c = prose(120), prose(120), prose(120)
    rows = [(None, a + " " + prose(30)), (None, prose(40) + " " + b), (None, prose(50)), (7, prose(20) + " " + a), (7, b + " " + prose(10)), (7, prose(60)), (-(2**63), c), (3, prose(10) + " " + c), (2**62 + 1, prose(70)), (9, None), (9, "")]
    return rows + rows[1:2] + rows[4:5]


def test_suffixes_with_null_and_shared_ids(spark):
    from collections import Counter

    from braidseq.llm import suffixes

    rows = several(spark)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixes.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    one = [(i, (t or "").encode()) for i, t in dict.fromkeys((i, t or "") for i, t in rows)]
    seen = Counter(t[p : p + 400] for _, t in one for p in range(len(t) - 399))
    want = {}
    for i, t in one:
        gone = [False] * len(t)
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                gone[p : p + 400] = [True] * 400
        want[i, t] = sum(gone)
    assert sum(want.values()) > 2000
    assert got == Counter((i, len((t or "").encode()), want[i, (t or "").encode()]) for i, t in rows)


def test_substring_with_null_and_shared_ids(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    from braidseq.llm import substring

    rows = several(spark)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.cut(d).collect())
    order = d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).distinct().orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()
    seen, want = set(), {}
    for i, t in order:
        w = t.split()
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(k)
        want[i, t] = sum(gone)
    assert sum(want.values()) > 200
    assert got == Counter((i, len((t or "").split()), want[i, t or ""]) for i, t in rows)


def test_minhash_with_null_and_shared_ids(spark):
    from braidseq.llm import minhash

    rows = several(spark)
    long = " ".join(f"v{i}" for i in range(100))
    rows += [(None, long), (None, long + " x"), (12, long), (12, "other words than these " * 9), (11, long + " y"), (None, "alone in the world " * 5), (None, rows[2][1]), (30, None), (None, "")]
    d = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, rep string")
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := (t or "").split()) else set() for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] == rows[j][0] and (rows[i][1] or "") == (rows[j][1] or "")
            if same or (sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = []
    for i, (doc_id, text) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        want.append((doc_id, len(sets[i]), min(ids, default=None)))
    got = minhash.near_duplicates(d, 5).collect()
    assert sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(str, want))
    left = minhash.deduplicated(d, 5)
    assert left.columns == d.columns
    texts = [(r["doc_id"], r["text"]) for r in left.collect()]
    kept = {group[rows.index(x)] for x in texts}
    assert kept == set(group)  # something of each group stays, and one document only
    assert len({(group[rows.index(x)], x[0], x[1] or "") for x in texts}) == len(kept)
    assert (12, "other words than these " * 9) in texts and (11, long + " y") in texts and (12, long) not in texts and (None, long) not in texts


def test_minhash_crowded_buckets_in_blocks(docs_of, monkeypatch):
    from braidseq.llm import minhash

    from .test_arrow import corpus

    texts = corpus()
    want = {tuple(r) for r in minhash.near_duplicates(docs_of(texts), 4).collect()}
    monkeypatch.setattr(minhash, "BLOCK", 2)
    assert {tuple(r) for r in minhash.near_duplicates(docs_of(texts), 4).collect()} == want
