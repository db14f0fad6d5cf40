import heapq
import random

from ripplegraph.llm import mixing
from ripplegraph.llm.mixing import default_total, mix, sainte_lague, shares


def slow(weights, seats, caps):
    held = [0] * len(weights)
    for _ in range(seats):
        best = [(-w / (2 * h + 1), i) for i, (w, h, c) in enumerate(zip(weights, held, caps, strict=True)) if w > 0 and h < c]
        if not best:
            break
        held[heapq.nsmallest(1, best)[0][1]] += 1
    return held


def test_apportionment_is_by_highest_quotients():
    r = random.Random(1)
    for _ in range(400):
        n = r.randrange(1, 8)
        w = [r.choice([0, 1, 1, 2, r.random() * 9]) for _ in range(n)]
        caps, seats = [r.choice([0, 3, 10, 1000]) for _ in range(n)], r.randrange(200)
        assert sainte_lague(w, seats, caps) == slow(w, seats, caps), (w, seats, caps)


DOCS = "doc_id long, source string, n_tokens int, copies string, shard string"
TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, sizes, seed=1):
    r = random.Random(seed)
    data, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            k += 1
            data.append((k, s, r.randrange(20, 90), "clash", "clash"))
    return spark.createDataFrame(data + [(0, None, 5, "", ""), (-1, "a", 0, "", ""), (-2, "a", None, "", "")], DOCS).repartition(4)


def test_shares_repeats_and_left_out_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 3000)
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 4), ("c", 0.1, 3), ("gone", 0.1, 9)], TARGETS)
    m = mix(docs(spark, {"a": 900, "b": 100, "c": 500, "none": 50}), t, block_tokens=64).cache()
    got = {r.source: r for r in shares(m, t).collect()}
    assert got["gone"].actual_share == 0 and got["b"].most_copies == 4 and set(got) == {"a", "b", "c", "gone"}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(got[s].actual_share - share / 0.9) < 0.01
    assert {r.source for r in m.collect()} == {"a", "b", "c"} and m.groupBy("doc_id").count().where("count > 1").isEmpty()
    again = mix(docs(spark, {"a": 900, "b": 100, "c": 500, "none": 50}).repartition(9), t, block_tokens=64)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, m.collect()))


def test_a_total_beyond_the_caps_uses_all(spark):
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], TARGETS)
    got = {r.source: (r.n_docs, r.most_copies) for r in shares(mix(docs(spark, {"a": 30, "b": 10}), t, total_tokens=10**7, block_tokens=64), t).collect()}
    assert got == {"a": (30, 1), "b": (10, 3)}


def test_a_scarce_source_does_not_empty_the_mixture(spark):
    t = spark.createDataFrame([("rich", 0.9, 1), ("scarce", 0.1, 2)], TARGETS)
    d = spark.createDataFrame([(k, "rich", 50, "", "") for k in range(2000)] + [(-5, "scarce", 20, "", "")], DOCS)
    got = {r.source: r for r in shares(mix(d, t), t).collect()}
    assert got["scarce"].n_tokens == 40 and got["scarce"].missing_tokens > 9000 and got["rich"].n_tokens > 90_000 and got["rich"].missing_tokens == 0


def test_default_total():
    assert default_total({"a": 900, "b": 300}, {"a": 0.5, "b": 0.5}, 1000, 0.05) == 600
    assert default_total({"a": 900, "b": 1}, {"a": 0.5, "b": 0.5}, 1000, 0.05) == 1800 and default_total({}, {}, 0, 0.05) == 0


def test_empty(spark):
    t = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mix(docs(spark, {}), t).collect() == [] and [r.actual_share for r in shares(mix(docs(spark, {}), t), t).collect()] == [0.0]
    assert mix(docs(spark, {"a": 9}), t.limit(0)).collect() == []
