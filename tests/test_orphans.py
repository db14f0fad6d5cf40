import random
from datetime import datetime, timedelta

from ripplegraph.operators import orphans
from ripplegraph.operators.graph_orphans import graph_orphans
from ripplegraph.operators.orphans import PARENT_ARRIVES, PARENT_LEAVES, REFERENCE_CLOSES, REFERENCE_OPENS, PendingOrphans, orphan_spans

EV = "array<struct<file_path string, start_line int, end_line int, source_kind string, excerpt string>>"
SCHEMAS = {
    "snapshots": "snapshot_id string, repository_identity string, commit_id string, captured_at timestamp_ntz",
    "nodes": f"snapshot_id string, id string, file_path string, evidence {EV}, delivered_at timestamp_ntz, repo string, seq int",
    "edges": "snapshot_id string, id string, from_id string, to_id string, delivered_at timestamp_ntz, repo string, seq int",
    "evidence": "id string, recorded_at timestamp_ntz",
    "sem_links": "snapshot_id string, owner_id string, kind string, ref string",
}


def at(h):
    return datetime(2024, 1, 1) + timedelta(hours=h)


def run(spark, **tables):
    return graph_orphans(*(spark.createDataFrame(tables.get(t, []), s) for t, s in SCHEMAS.items()))


def test_state_waits_resolves_and_reopens():
    s = PendingOrphans()
    assert s.apply(1, REFERENCE_OPENS, "r") == [] and s.apply(5, PARENT_ARRIVES, None) == [("r", 1, 5)]
    assert s.apply(6, REFERENCE_OPENS, "q") == [] and s.apply(8, PARENT_LEAVES, None) == []
    assert s.apply(9, REFERENCE_CLOSES, "q") == [("q", 8, 9)] and s.rest() == [("r", 8, None)]


def test_late_and_deleted_parents(spark, rows):
    snaps = [(f"s{i}", "R", f"c{i}", at(i)) for i in (1, 2, 3, 4)] + [("x", "R", "cx", at(2.5))]
    keep = [(f"s{i}", "keep", None, None, at(i), "z", 1) for i in (1, 2, 3, 4)]
    nodes = [*keep, ("s2", "p", None, None, at(2), "z", 1), ("s4", "p", None, None, at(4), "z", 1)]
    edges = [(f"s{i}", "e", "p", "keep", at(i), "z", 1) for i in (1, 2, 3, 4)] + [("s3", "e", "p", "keep", at(9), "z", 1), ("s1", "f", None, None, at(1), "z", 1), ("x", "e", "p", "q", at(1), "z", 1)]
    assert rows(run(spark, snapshots=snaps, nodes=nodes, edges=edges)) == [("edges", "s1", "e", "from_id", "p"), ("edges", "s3", "e", "from_id", "p")]


def test_evidence_and_links(spark, rows):
    snaps = [("s1", "R", "c1", at(1)), ("s2", "R", "c2", at(2)), ("s2", "R", "c2", at(2))]
    e1 = [("./a\\b.ts", 3, None, "code", "x"), ("./a\\b.ts", 3, None, "code", "y"), (None, None, None, None, None)]
    nodes = [("s1", "n", "a/b.ts", e1, at(1), "z", 1), ("s2", "n", ".\\a\\b.ts", e1, at(2), "z", 1)]
    evidence = [("ev:code:a/b.ts:3:0", at(2)), ("ev:code:a/b.ts:3:0", at(5)), (None, at(1)), ("e", None)]
    links = [("s1", "o", "file", "./a/b.ts"), ("s1", "o", "file", "gone.ts"), ("s1", "o", "symbol", "gone.ts"), ("s1", "o", "file", "gone.ts"), ("s2", "o", "evidence", "ev:code:a/b.ts:3:0"), ("s1", "o", "evidence", "ev:code:a/b.ts:3:0"), ("s1", None, None, "n"), ("s1", None, None, "m"), ("s1", "o", "file", None)]
    got = rows(run(spark, snapshots=snaps, nodes=nodes, evidence=evidence, sem_links=links))
    assert got == sorted([
        ("nodes", "s1", "n", "evidence", "ev:code:a/b.ts:3:0"), ("nodes", "s1", "n", "evidence", "ev:::0:0"), ("nodes", "s2", "n", "evidence", "ev:::0:0"), ("sem_links", "s1", "o", "ref", "gone.ts"),
        ("sem_links", "s1", "o", "ref", "ev:code:a/b.ts:3:0"), ("sem_links", "s1", None, "ref", "m"),
    ], key=repr)


def test_many_snapshots_of_one_moment(spark, rows):
    names = [f"s{i:04}" for i in range(1200)]
    snaps = [(s, "R", s, at(1)) for s in names] + [("z", "R", "cz", at(1) + timedelta(microseconds=1)), ("n", None, "cn", at(1))]
    nodes = [(s, "keep", None, None, at(1), "z", 1) for s in [*names, "z", "n"]] + [(s, "late", None, None, at(1), "z", 1) for s in [*names[1100:], "z"]] + [("z", "gone", None, None, at(1), "z", 1)]
    edges = [(s, "f", "late", "keep", at(1), "z", 1) for s in [*names, "z"]] + [(s, "e", "gone", "keep", at(1), "z", 1) for s in (names[500], "z")] + [("n", "e", "gone", "keep", at(1), "z", 1)]
    links = [("s1150", "o\0p", "evidence", "ev"), ("s1150", "o\0p", "file", "ev\1"), ("s1150", "o\0p", "test", "ev\1")]
    got = rows(run(spark, snapshots=snaps, nodes=nodes, edges=edges, sem_links=links, evidence=[("ev", at(1))]))
    want = [("edges", s, "f", "from_id", "late") for s in names[:1100]] + [("edges", "s0500", "e", "from_id", "gone"), ("edges", "n", "e", "from_id", "gone"), ("sem_links", "s1150", "o\0p", "ref", "ev\1")]
    assert got == sorted(want, key=repr)


def test_a_key_of_a_small_share_is_split_too(spark, monkeypatch):
    """However small a key's share of all references, no task follows many more of them than the limit."""
    monkeypatch.setattr(orphans, "HOT_ROWS", 10)
    events = [("warm", 1, REFERENCE_OPENS, f"w{i}") for i in range(50)] + [(f"k{i}", 1, REFERENCE_OPENS, f"r{i}") for i in range(9950)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen = orphan_spans(spark.createDataFrame(events, "key string, seq long, op int, ident string")).where("ident like 'w%'")
    parts = [len([r for r in p if r]) for p in seen.select("ident").rdd.glom().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(parts) == 50 and max(parts) < 50


def test_empty(spark, rows):
    assert rows(run(spark)) == []


def test_hot_key_is_salted(spark, rows, monkeypatch):
    monkeypatch.setattr(orphans, "HOT_ROWS", 20)
    r = random.Random(3)
    events, want = [], []
    for key, n in (("hot", 300), ("cold", 5)):
        events += [(key, 50, PARENT_ARRIVES, None), (key, 70, PARENT_LEAVES, None)]
        for i in range(n):
            opens = r.randrange(0, 60)
            ident = f"{key}{i}"
            events += [(key, opens, REFERENCE_OPENS, ident), (key, opens, REFERENCE_OPENS, ident)]
            want += ([(ident, opens, 50)] if opens < 50 else []) + [(ident, 70, None)]
    df = spark.createDataFrame(events + [(None, 1, 3, "x"), ("hot", None, 3, "x")], "key string, seq long, op int, ident string").repartition(5)
    assert rows(orphan_spans(df)) == sorted(want, key=repr)
