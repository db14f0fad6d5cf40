import importlib.util
import re

import __spark_entry__


def test_queries_and_sql_match_by_name():
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q) and all(f.__doc__ for f in q.values())
    for n in (1, 2, 4, 6):
        assert f"p{n}_found" in q
    if importlib.util.find_spec("ripplegraph.llm"):
        assert {"p3_found", "p5_found", "p7_ids", "p9_found"} <= set(q) and any(re.match("p8_", k) for k in q)


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns and df.count() >= 0
