import pytest

from ripplegraph.operators.claims import build_claims
from ripplegraph.operators.context import RACE_UNKNOWN, Task, context_pack, context_packs, hypotheses, validate_candidates
from ripplegraph.operators.graph import merge_edges, merge_nodes
from ripplegraph.operators.typescript import index_repository, with_edge_ids
from ripplegraph.runtime import stored

FILES = [
    ("src/seat.ts", "/** @capability reserve\n * @invariant capacity: never more than seats\n */\nexport function reserve(n) { return check(n); }\nexport function check(n) { return audit(n); }\nfunction audit(n) { return n; }\n"),
    ("src/other.ts", "export function other() { return 1; }\n"),
    ("test/seat.test.ts", 'import { reserve } from "../src/seat";\nreserve(1);\n'),
    ("db/1.sql", "create table seats (n int);\n-- @constraint capacity: n <= 9\n"),
    ("docs/old.md", "---\nstatus: deprecated\ncontradicts: docs/new.md\ncapabilities: [reserve]\n---\n# Old\n"),
]


@pytest.fixture(scope="module")
def graph(spark):
    n, e = index_repository(spark.createDataFrame(FILES, "rel_path string, content string"), "app")
    return stored(merge_nodes(n)), stored(with_edge_ids(merge_edges(e)))


def pack(spark, graph, task):
    n, e = graph
    ev = spark.createDataFrame([("ev:code:src/seat.ts:4:4",), ("ev:code:nothing:1:1",)], "id string")
    return context_pack(task, n, e, build_claims(n, e), ev)


def test_pack_by_marker(spark, graph, rows):
    p = pack(spark, graph, Task("oversold seats", "business_rule", "bugfix", ["reserve", "fly"], ["capacity"], risks=["race on seats"]))
    assert rows(p["entrypoints"]) == [("sym:function:src/seat.ts:reserve:4",)]
    assert rows(p["paths"], "n") == [(3,)] and rows(p["tests"]) == [("test:test/seat.test.ts",)]
    assert {"inv:capacity", "mig:db/1.sql", "sym:function:src/seat.ts:audit:6"} <= {r.id for r in p["primary"].collect()}
    assert [(r.file_path, r.priority) for r in p["reads"].orderBy("file_path").collect()] == [("db/1.sql", "high"), ("src/seat.ts", "critical"), ("test/seat.test.ts", "high")]
    assert "doc:docs/old.md" not in {r.id for r in p["secondary"].collect()}
    assert rows(p["unknowns"]) == sorted([
        ('Capability "fly" referenced by the task was not found in the graph.',), ('Hypothesis not yet verified: Risk surface: race on seats.',), (RACE_UNKNOWN,),
        ('Hypothesis not yet verified: The "reserve" path can violate invariant "capacity" under the reported conditions.',),
    ], key=repr)
    assert {r.kind for r in p["plan"].collect()} == {"run_test", "static_check", "reproduce"}
    assert rows(p["evidence"]) == [("ev:code:src/seat.ts:4:4",)] and all("deprec" not in r.kind for r in p["claims"].collect())


def test_pack_by_words(spark, graph):
    p = pack(spark, graph, Task("make check of seats faster"))
    assert {r.id.split(":")[3] for r in p["entrypoints"].collect()} == {"check"}


def test_seals(spark):
    df = spark.createDataFrame([(1, "a.ts", 0.5, "s", None), (2, "a.ts", 0.5, "s", ("src", "q", "wrong"))], "i int, file_path string, score double, snippet string, seal struct<source_hash:string,query_hash:string,result_hash:string>")
    assert [r.reason for r in validate_candidates(df, "src", "query").orderBy("i").collect()] == ["PROVIDER_SEAL_MISSING", "PROVIDER_SEAL_INVALID"]


def test_many_tasks_have_their_own_packs(spark, graph, rows):
    n, e = graph
    tasks = spark.createDataFrame([("a", "oversold", ["reserve"], None), ("b", "nothing to see", None, ["other behaviour of it"]), ("c", "zzz", None, None)], "task_id string, text string, capabilities array<string>, expected array<string>")
    p = context_packs(tasks, n, e, build_claims(n, e))
    assert rows(p["entrypoints"]) == [("a", "sym:function:src/seat.ts:reserve:4"), ("b", "sym:function:src/other.ts:other:1")]
    assert {r.task_id for r in p["reads"].collect()} == {"a", "b", "c"}  # c reaches nothing, so every invariant counts
    assert [(r.task_id, r.statement) for r in p["hypotheses"].collect()] == [("a", 'The change primarily affects the "reserve" capability.')]


def test_hypotheses_in_order(spark, rows):
    t = spark.createDataFrame([("a", "bugfix", ["c"], ["i"], ["r"]), ("b", "feature", ["c"], ["i"], []), ("d", "feature", [], [], [])], "task_id string, mode string, capabilities array<string>, invariants array<string>, risks array<string>")
    assert rows(hypotheses(t), "task_id", "pos", "confidence") == [("a", 0, 0.5), ("a", 1, 0.4), ("b", 0, 0.5)]


def test_entry_points_are_searched_once_for_all_tasks(spark, rows, monkeypatch):
    from ripplegraph.operators import context

    seeds, bfs = [], context.bfs
    monkeypatch.setattr(context, "bfs", lambda nodes, edges, s, depth: seeds.append(s) or bfs(nodes, edges, s, depth))
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    e = spark.createDataFrame([("calls", "a", "b"), ("imports", "b", "c")], "kind string, from_id string, to_id string")
    entry = spark.createDataFrame([(f"t{k}", i) for k in range(9) for i in "ab"], "task_id string, id string")
    assert rows(context.hops_by_start(entry, n, e)) == [("a", "a", 0), ("a", "b", 1), ("b", "a", 1), ("b", "b", 0)]
    assert seeds[0].count() == 2


def test_hops_of_a_task_without_pairs_of_ids_and_entry_points(spark, rows):
    from ripplegraph.operators import context

    entry = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "b")], "task_id string, id string")
    hops = spark.createDataFrame([("a", "a", 0), ("a", "x", 1), ("b", "b", 0), ("b", "x", 3), ("b", "y", 2)], "start string, id string, hop int")
    ids = spark.createDataFrame([("t", "a"), ("t", "x"), ("u", "x"), ("u", "y"), ("u", "a"), ("v", "x")], "task_id string, id string")
    got = context.least_hops(ids, entry, hops)
    assert rows(got, "task_id", "id", "hop") == sorted([("t", "a", 0), ("t", "x", 1), ("u", "x", 3), ("u", "y", 2), ("u", "a", None), ("v", "x", None)], key=repr)


def test_a_task_goes_no_further_than_its_nearest_need(spark, rows):
    from ripplegraph.operators import context

    entry = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "b")], "task_id string, id string")
    near = [("a", "a", 0), ("a", "p", 1), ("a", "q", 1), ("a", "r", 2), ("b", "b", 0), ("b", "q", 2), ("b", "r", 1), ("b", "s", 4)]
    near = spark.createDataFrame(near, "start string, id string, hop int")
    shown = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "p"), ("u", "b")], "task_id string, id string")
    got = context.nearest_others(entry, near, shown, 2)
    assert rows(got, "task_id", "id", "hop") == [("t", "q", 1), ("t", "r", 1), ("u", "q", 2), ("u", "r", 1)]  # none goes on to s
    assert rows(context.nearest_others(entry, near, shown, 3), "task_id", "id", "hop") == [("t", "q", 1), ("t", "r", 1), ("t", "s", 4), ("u", "q", 2), ("u", "r", 1), ("u", "s", 4)]


def test_unknowns_rest_on_no_paths(spark, graph, rows, monkeypatch):
    from ripplegraph.operators import context

    monkeypatch.setattr(context, "simple_paths", lambda *_: pytest.fail("unknowns need no paths"))
    n, e = graph
    tasks = spark.createDataFrame([("a", "oversold", ["fly"])], "task_id string, text string, capabilities array<string>")
    p = context_packs(tasks, n, e, build_claims(n, e), only={"unknowns"})
    assert set(p) == {"unknowns"} and 'Capability "fly" referenced by the task was not found in the graph.' in {r.unknown for r in p["unknowns"].collect()}
