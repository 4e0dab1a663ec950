"""One-to-one matching by falling score."""

from braidseq.operators import intervals


def table(spark, rows):
    return spark.createDataFrame(rows, "contig_id long, feature_id long, lo long, hi long")


def by_hand(a, b):
    pairs = [(-(min(h, k) - max(g, j) + 1) / (max(h, k) - min(g, j) + 1), x, y) for c, x, g, h in a for d, y, j, k in b if c == d and g <= k and j <= h]
    out, xs, ys = [], set(), set()
    for s, x, y in sorted(pairs):
        if x not in xs and y not in ys:
            out.append((x, y, -s))
            xs.add(x), ys.add(y)
    return sorted(out)


def test_second_choice_is_taken(spark):
    """2 prefers 11, which 1 has; so 2 goes with 12, though neither is the other's best at first."""
    a, b = [(1, 1, 1, 100), (1, 2, 20, 120)], [(1, 11, 1, 101), (1, 12, 90, 200)]
    got = intervals.assigned(table(spark, a), table(spark, b), ["contig_id"], "feature_id", 64)
    assert sorted((r["feature_id"], r["r_feature_id"]) for r in got.collect()) == [(1, 11), (2, 12)]
    assert intervals.matched(table(spark, a), table(spark, b), ["contig_id"], "feature_id", 64).count() == 1


def test_chains_and_ties(spark):
    """A chain in which each waits for the one before it, and intervals that are all alike."""
    a = [(1, i, 100 * i, 100 * i + 90 - i) for i in range(8)] + [(2, 20 + i, 5, 9) for i in range(4)]
    b = [(1, i, 100 * i + 40, 100 * i + 130 - i) for i in range(8)] + [(2, 20 + i, 5, 9) for i in range(3)]
    got = intervals.assigned(table(spark, a), table(spark, b), ["contig_id"], "feature_id", 16).collect()
    assert sorted((r["feature_id"], r["r_feature_id"], r["score"]) for r in got) == by_hand(a, b)


def test_agreement_counts(spark):
    a, b = table(spark, [(1, 1, 1, 10), (1, 2, 21, 30), (1, 3, 50, 60)]), table(spark, [(1, 1, 1, 10), (1, 2, 21, 29), (1, 3, 70, 80), (2, 4, 1, 2)])
    pairs = intervals.assigned(a, b, ["contig_id"], "feature_id", 64)
    r = intervals.agreement(a, b, pairs, ["contig_id"], "feature_id", []).first()
    assert (r["perfect"], r["partial80"], r["partial50"], r["partial0"], r["false_negatives"], r["false_positives"]) == (1, 1, 0, 0, 1, 2)
    assert abs(r["score"] - (1 + 0.9 - 3)) < 1e-9


def test_empty_and_nulls(spark):
    none = table(spark, [])
    some = table(spark, [(None, 1, 1, 5), (1, None, 1, 5), (1, 2, 1, 5)])
    assert intervals.assigned(none, some, ["contig_id"], "feature_id", 64).count() == 0
    assert [(r["feature_id"], r["r_feature_id"]) for r in intervals.assigned(some, some, ["contig_id"], "feature_id", 64).collect()] == [(2, 2)]
    r = intervals.agreement(none, none, intervals.assigned(none, none, ["contig_id"], "feature_id", 64), ["contig_id"], "feature_id", []).first()
    assert r["perfect"] == 0 and r["score"] == 0


def test_small_keys_in_tasks_and_crowded_ones_in_rounds(spark, monkeypatch):
    """Keys matched whole, in rounds and mixed give the same pairs; small ones shuffle intervals, not pairs (F7, F8)."""
    import random

    rng = random.Random(5)
    a, b = ([(c, 100 * c + i, lo := rng.randint(1, 60), lo + rng.randint(0, 30)) for c in range(30) for i in range(1 + c % 7 + 20 * (c == 3))] for _ in range(2))
    got = {}
    for crowd in (1000, 20, 0):
        monkeypatch.setattr(intervals, "CROWD", crowd)
        d = intervals.assigned(table(spark, a).repartition(3), table(spark, b), ["contig_id"], "feature_id", 16)
        got[crowd] = sorted((r["feature_id"], r["r_feature_id"], r["score"]) for r in d.collect())
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert ("MapInPandas" in plan) and (crowd < 1000 or "Join" not in plan)
    assert got[1000] == got[20] == got[0] == by_hand(a, b)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        monkeypatch.setattr(intervals, "CROWD", 1000)
        assert sorted((r["feature_id"], r["r_feature_id"], r["score"]) for r in intervals.assigned(table(spark, a), table(spark, b), ["contig_id"], "feature_id", 16).collect()) == got[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_crowded_keys_go_band_by_band(spark, monkeypatch):
    """Intervals that all want the same partners, and ones that are all alike: few steps, no list of all pairs (F7)."""
    import random

    rng = random.Random(7)
    a = [(1, i, lo := rng.randint(1, 40), lo + 40 + rng.randint(0, 9)) for i in range(150)] + [(2, 200 + i, 5, 9) for i in range(60)] + [(3, 300, 1, 2)]
    b = [(1, i, lo := rng.randint(1, 9), lo + 80 + rng.randint(0, 99)) for i in range(150)] + [(2, 200 + i, 5, 9) for i in range(50)] + [(4, 400, 1, 2)]
    count, settle = [], intervals.settle
    monkeypatch.setattr(intervals, "settle", lambda d: count.append(0) or settle(d))
    monkeypatch.setattr(intervals, "CROWD", 10)
    # Keys whole in a task, held whole and in bands; then the larger one in tiles that break off.
    for edge, held, most in ((1000, 1 << 20, 3), (1000, 50, 3), (70, 1, 40)):
        monkeypatch.setattr(intervals, "EDGE", edge, raising=False)
        monkeypatch.setattr(intervals, "HELD", held, raising=False)
        count.clear()
        got = intervals.assigned(table(spark, a), table(spark, b), ["contig_id"], "feature_id", 16)
        assert sorted((r["feature_id"], r["r_feature_id"], r["score"]) for r in got.collect()) == by_hand(a, b)
        assert len(count) <= most, (edge, held, len(count))
        assert edge > 70 or len(count) > 6  # more than one round of tiles
