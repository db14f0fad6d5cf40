import math
import random
from itertools import combinations

import pytest

from ripplegraph.llm import pairs
from ripplegraph.llm.pairs import pair_counts

SCHEMA = "scope string, basket string, item string, n long, id string"


def brute(data, min_pair, min_lift):
    baskets = {}
    for s, b, i, *_ in data:
        if b is not None and i is not None:
            baskets.setdefault((s, b), set()).add(i)
    out = []
    for scope in {s for s, _ in baskets}:
        own = [v for (s, _), v in baskets.items() if s == scope]
        one, two = {}, {}
        for v in own:
            for i in v:
                one[i] = one.get(i, 0) + 1
            for p in combinations(sorted(v), 2):
                two[p] = two.get(p, 0) + 1
        for (a, b), k in two.items():
            if k >= min_pair and k * len(own) >= min_lift * one[a] * one[b]:
                lift = k * len(own) / (one[a] * one[b])
                out.append((scope, a, b, k, one[a], one[b], len(own), round(lift, 9), round(math.log2(lift), 9)))
    return sorted(out, key=repr)


def check(spark, data, min_pair=1, min_lift=0.0):
    df = spark.createDataFrame([(*x, 1, "clash") for x in data], SCHEMA).repartition(3)
    got = [tuple(r[:7]) + (round(r.lift, 9), round(r.pmi, 9)) for r in pair_counts(df, min_pair, min_lift).collect()]
    assert sorted(got, key=repr) == brute(data, min_pair, min_lift)


@pytest.mark.parametrize(("min_pair", "min_lift"), [(1, 0.0), (2, 1.0), (3, 1.5)])
def test_random_baskets_with_a_hot_item(spark, min_pair, min_lift):
    r = random.Random(1)
    data = [(r.choice("RQ"), f"b{r.randrange(40)}", f"i{r.randrange(15)}") for _ in range(300)] + [("R", f"b{k}", "hot") for k in range(40)]
    check(spark, data, min_pair, min_lift)


def test_wide_baskets_in_blocks_and_many_salts(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 7)
    monkeypatch.setattr(pairs, "SALT_ROWS", 20)
    r = random.Random(4)
    data = [("R", f"w{k}", f"i{i}") for k in range(4) for i in range(50) if r.random() < 0.8] + [("R", f"b{r.randrange(30)}", f"i{r.randrange(50)}") for _ in range(120)]
    check(spark, data, 2, 1.0)


def test_nulls_repeats_single_items_and_odd_names(spark):
    check(spark, [("R", "b", "x"), ("R", "b", "x"), ("R", "b", "y"), ("R", None, "x"), ("R", "b", None), ("R", "c", "x"), (None, "b", "x"), (None, "b", ""), ("Q", "b", "x"), ("R", "d", "z" * 5000), ("R", "d", "é")])


def test_code_unit_order(spark):
    df = spark.createDataFrame([("R", "b", "￮", 1, ""), ("R", "b", "\U0001f600", 1, "")], SCHEMA)
    assert [(r.item_a, r.item_b) for r in pair_counts(df).collect()] == [("\U0001f600", "￮")]


def test_empty(spark):
    assert pair_counts(spark.createDataFrame([], SCHEMA)).collect() == []
