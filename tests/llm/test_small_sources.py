"""Sources of few words meet their targets too."""

from collections import Counter

from braidseq.llm import mixing


def docs(spark, sizes):
    rows = [(i + 1, " ".join(f"{s}{k}" for k in range(n)), s) for i, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_capped_sources_take_all_words_three_times(spark):
    d = docs(spark, [("a", 5), ("b", 33), ("c", 40), ("d", 20), ("d", 13), ("z", 4000)])
    took, target, size = Counter(), {}, {}
    source = {r["doc_id"]: r["source"] for r in d.collect()}
    for r in mixing.taken(d).collect():
        s = source[r["doc_id"]]
        took[s] += r["taken"]
        target[s], size[s] = r["target"], r["source_size"]
    assert [target[s] for s in "abcd"] == [15, 99, 120, 99]
    assert [took[s] for s in "abcd"] == [15, 99, 120, 99] and abs(took["z"] - target["z"]) <= 32
    got = Counter()
    for r in mixing.mixed_documents(d).collect():
        got[r["source"]] += len(r["text"].split(" "))
    assert got == took


def test_small_sources_below_the_cap_come_near(spark):
    d = docs(spark, [("a", 40), ("b", 45), ("c", 300)])
    source = {r["doc_id"]: r["source"] for r in d.collect()}
    for weights in ((5, 2, 1), (1, 1, 9), (3, 4, 20)):
        for r in mixing.taken(d, weights).collect():
            assert abs(r["taken"] - r["target"]) <= (2 if source[r["doc_id"]] != "c" else 10) + 1


def test_shards_are_drawn_by_weight_and_slots_decide_them(spark):
    d = docs(spark, [("a", 9000), ("b", 7000), ("c", 8000)])
    places, sources = mixing.packed(d, (5, 2, 1), 4)
    counts = mixing.shard_counts(sources, 500).collect()
    total = Counter()
    for r in counts:
        total[r["sid"]] += r["count"]
    draws = {r["sid"]: r["draws"] for r in sources.collect()}
    assert total == draws  # the corpus totals hold exactly
    whole = sum(draws.values())
    spread = 0
    for shard in range(whole // 500):
        here = {r["sid"]: r["count"] for r in counts if r["shard"] == shard}
        assert sum(here.values()) == 500
        for sid, n in here.items():
            p = draws[sid] / whole
            assert abs(n - 500 * p) <= 5 * (500 * p * (1 - p)) ** 0.5
            spread += n != round(500 * p)
    assert spread > whole // 500  # drawn, not rounded
    # The draws of a source take each block once in a pass.
    mix = mixing.slots(mixing.shard_counts(sources, 500)).collect()
    assert len({(r["sid"], r["block"], r["pass"]) for r in mix}) == len(mix) == whole
    assert len({(r["shard"], r["place"]) for r in mix}) == whole


def test_shards_depend_on_the_permutation_of_slots(spark, monkeypatch):
    d = docs(spark, [("a", 900), ("b", 700), ("c", 800)] + [("c", 50)] * 20)
    one = {r["doc_id"]: (r["first_shard"], r["last_shard"]) for r in mixing.taken(d, block=4, per_shard=50).collect()}
    rows = mixing.mixed_documents(d, block=4, per_shard=50, placed=True).collect()
    assert all(one[r["doc_id"]][0] <= r["mix_shard"] <= one[r["doc_id"]][1] for r in rows)
    true = mixing.permuted
    monkeypatch.setattr(mixing, "permuted", lambda x, n, salt, *a, **k: true(x, n, salt, *a, **k) if not isinstance(salt, type(mixing.F.lit(1))) or "-1" not in str(salt) else x)
    assert {r["doc_id"]: (r["first_shard"], r["last_shard"]) for r in mixing.taken(d, block=4, per_shard=50).collect()} != one


def test_white_space_between_words_is_kept(spark):
    text = "one two\n\nthree\tfour  five\nsix"
    d = spark.createDataFrame([(1, text, "a"), (2, "x " * 300, "b")], "doc_id long, text string, source string")
    got = {r["text"] for r in mixing.mixed_documents(d).where("doc_id = 1").collect()}
    assert got == {text}
