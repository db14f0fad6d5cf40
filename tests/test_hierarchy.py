import random

from ripplegraph.operators.hierarchy import descendants, resolve_hierarchy

SCHEMA = "scope string, child string, parent string, depth int, ids string"


def brute(links):
    up = {}
    for s, c, p, *_ in links:
        if c is not None and p is not None:
            up[(s, c)] = min(p, up.get((s, c), p))
    out = []
    for s, n in {(s, x) for s, c, p, *_ in links if c is not None and p is not None for x in (c, p)}:
        path, seen = [n], {n}
        while (s, path[-1]) in up and up[(s, path[-1])] not in seen:
            path.append(up[(s, path[-1])])
            seen.add(path[-1])
        if (s, path[-1]) not in up:
            out.append((s, n, path[-1], len(path) - 1, " > ".join(reversed(path))))
        else:
            out.append((s, n, "", -1 if up[(s, path[-1])] == n else -2, ""))
    return sorted(out, key=repr)


def check(spark, rows, links):
    got = resolve_hierarchy(spark.createDataFrame([(*x, 1, "clash") for x in links], SCHEMA))
    assert rows(got, "scope", "node_id", "root_id", "depth", "path") == brute(links)
    return got


def test_trees_cycles_and_tails(spark, rows):
    links = [("r", "b", "a"), ("r", "c", "b"), ("r", "c", "b"), ("r", "x", "y"), ("r", "y", "x"), ("r", "t", "x"), ("r", "t2", "t"), ("r", "self", "self"), ("r", "s2", "self"), ("q", "a", "b"), (None, "b", "a"), ("r", None, "a"), ("r", "a", None), ("r", "two", "b"), ("r", "two", "a")]
    got = check(spark, rows, links)
    assert rows(descendants(got).where("scope = 'r'"), "ancestor_id", "node_id", "distance") == [("a", "b", 1), ("a", "c", 2), ("a", "two", 1), ("b", "c", 1)]


def test_deep_chain_and_long_tail_on_a_cycle(spark, rows):
    chain = [("r", f"n{i + 1:03}", f"n{i:03}") for i in range(70)]
    tail = [("r", f"t{i + 1:02}", f"t{i:02}") for i in range(37)] + [("r", "t00", "k0"), ("r", "k0", "k1"), ("r", "k1", "k2"), ("r", "k2", "k0")]
    check(spark, rows, chain + tail)


def test_random_forest(spark, rows):
    r = random.Random(2)
    check(spark, rows, [("r", f"{i}", f"{r.randrange(120)}") for i in range(120) if r.random() < 0.9])


def test_hub_and_empty(spark, rows):
    check(spark, rows, [("r", f"c{i}", "hub") for i in range(300)])
    assert rows(resolve_hierarchy(spark.createDataFrame([], SCHEMA))) == []
    assert rows(resolve_hierarchy(spark.createDataFrame([("r", "a", None, 1, "")], SCHEMA))) == []
