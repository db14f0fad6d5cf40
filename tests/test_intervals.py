import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripplegraph.operators import intervals
from ripplegraph.operators.intervals import IntervalMap, merge_intervals

SCHEMA = "a string, b string, start long, end long"


def brute(spans):
    covered = sorted({x for s, e in spans for x in range(s, e + 1)})
    periods = []
    for x in covered:
        if periods and periods[-1][1] == x - 1:
            periods[-1][1] = x
        else:
            periods.append([x, x])
    periods = [tuple(p) for p in periods]
    return periods, [(p[1] + 1, q[0] - 1) for p, q in zip(periods, periods[1:], strict=False)]


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12)), max_size=40))
@settings(max_examples=200, deadline=None)
def test_map_in_any_order(spans):
    m, n = IntervalMap(), 0
    for s, w in spans:
        n += m.insert(s, s + w)
    periods, gaps = brute([(s, s + w) for s, w in spans])
    assert (m.periods(), m.gaps(), n) == (periods, gaps, len(periods))


def expected(data):
    out = []
    for key in {(a, b) for a, b, *_ in data}:
        periods, gaps = brute([(s, e) for a, b, s, e in data if (a, b) == key and s is not None and e is not None and e >= s])
        out += [(*key, "period", *p) for p in periods] + [(*key, "gap", *g) for g in gaps]
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 7])
def test_nulls_repeats_reversed_and_null_keys(spark, rows, partitions):
    data = [("f", "x", 1, 5), ("f", "x", 6, 7), ("f", "x", 1, 5), ("f", "x", 10, 12), ("f", "x", 11, 11), ("f", "y", None, 3), ("f", "y", 3, None), ("f", "y", 9, 2), (None, "x", 4, 4), ("f", None, 4, 4), ("", "", 2**31, 2**31 + 5)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("kind", F.lit("clash")).withColumn("k", F.lit(1)).repartition(partitions)
    assert rows(merge_intervals(df, ["a", "b"])) == expected(data)


def test_empty(spark, rows):
    df = merge_intervals(spark.createDataFrame([], SCHEMA), ["a", "b"])
    assert df.columns == ["a", "b", "kind", "start", "end"] and rows(df) == []


def test_hot_key_over_many_partitions(spark, rows, monkeypatch):
    """One key holds most rows and long ranges reach over several partitions; parts are handed on early."""
    monkeypatch.setattr(intervals, "COMBINER_INTERVALS", 3)
    r = random.Random(5)
    data = [("hot", "", s, s + r.choice([0, 1, 2, 3, 400])) for s in (r.randrange(0, 20_000) for _ in range(900))]
    data += [(f"k{r.randrange(5)}", "", s, s + r.randrange(9)) for s in (r.randrange(0, 300) for _ in range(200))] + [("hot", "", 5, 3000)]
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert rows(merge_intervals(df, ["a", "b"])) == expected(data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
