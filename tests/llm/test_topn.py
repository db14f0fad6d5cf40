import random
from datetime import datetime

from pyspark.sql import functions as F

from ripplegraph.llm.topn import co_change_top, top_n

SCHEMA = "g string, score long, item string, pos string"


def test_against_sorting_with_ties_and_nulls(spark, rows):
    r = random.Random(3)
    data = [(r.choice(["a", "b", None]), r.choice([1, 2, 3, None]), f"i{i:03}", "clash") for i in range(200)] + [("hot", 5, f"h{i:04}", "x") for i in range(2000)] + [("a", 9, None, "x")]
    got = top_n(spark.createDataFrame(data, SCHEMA).repartition(5), ["g"], "score", "item", 4)
    want = []
    for g in {x[0] for x in data}:
        best = sorted((x for x in data if x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[2] is None, x[2] or ""))[:4]
        want += [(g, x[1], x[2], k + 1) for k, x in enumerate(best)]
    assert rows(got, "g", "score", "item", "pos") == sorted(want, key=repr)


def test_plan_prunes_before_and_after_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1, "x", "")], SCHEMA)
    plan = top_n(df, ["g"], "score", "item", 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_limit_by_group_repeats_and_empty(spark, rows):
    df = spark.createDataFrame([("a", 2, "x", ""), ("a", 2, "x", ""), ("a", 1, "y", ""), ("b", 1, "z", "")], SCHEMA)
    assert rows(top_n(df, ["g"], "score", "item", 5, F.when(F.col("g") == "a", 2).otherwise(0)), "g", "item", "pos") == [("a", "x", 1), ("a", "x", 2)]
    assert top_n(df.limit(0), ["g"], "score", "item", 5).collect() == [] and top_n(df, ["g"], "score", "item", 0).collect() == []


def test_co_changes(spark, rows):
    t = lambda d: datetime(2024, 1, d)
    data = [
        ("R", "o", "f", "b", 3, t(1), 7), ("R", "o", "./f", "a", 3, t(1), 7), ("R", "o", "f", "b", 3, t(1), 7), ("R", "o", "f", "c", 9, t(1), 7), ("R", "o", "f", ".\\c", 1, t(2), 7), ("R", "o", "f", "f", 9, t(1), 7),
        ("R", "o", "f", "d", 5, t(1), 7), ("R", "o", "f", "d", None, t(3), 7), ("R", "o", "f", None, 5, t(1), 7), ("R", "?", "f", "z", 50, t(1), 7),
    ]
    df = spark.createDataFrame(data, "repository_identity string, option_set string, file string, co_file string, commits long, mined_at timestamp_ntz, pos int")
    options = spark.createDataFrame([("o", 2, 2), ("p", 1, 9)], "option_set string, min_support int, max_per_file int")
    assert rows(co_change_top(df, options)) == [("R", "f", 1, "d"), ("R", "f", 2, "a")]
    assert rows(co_change_top(df.limit(0), options)) == [] and rows(co_change_top(df, options.limit(0))) == []
