import pytest

from ripplegraph.schema import TABLES
from ripplegraph.sources.files import count_typescript, detect_mode, discover_files, parse_candidates, parse_tasks
from ripplegraph.sources.store import Store, StoreError, invalid_rows


def test_versions_are_whole_and_last_row_wins(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert not s.is_indexed() and not (tmp_path / "store").exists()
    with pytest.raises(StoreError, match="nothing has been indexed"):
        s.load("nodes")
    n = spark.createDataFrame([("a", "module", "old", 1), ("a", "module", "new", 2), ("b", "test", "t", 1)], "id string, kind string, name string, seq int")
    n = n.selectExpr("id", "kind", "name", "null as file_path", "null as bounded_context", "true as exported", "array('x') as tags", f"cast(null as {TABLES['nodes'].split('evidence ')[1].split(', metadata')[0]}) as evidence", "map('k', 'v') as metadata", "seq")
    first = s.replace(nodes=n)
    assert {r.id: r.name for r in s.load("nodes").collect()} == {"a": "new", "b": "t"} and s.is_indexed()
    assert [r.name for r in s.get("nodes", "b").collect()] == ["t"]
    second = s.replace(meta=spark.createDataFrame([("k", "v")], "key string, value string"))
    assert second != first and s.load("nodes").count() == 2 and [r.value for r in s.get("meta", "k").collect()] == ["v"]
    (tmp_path / "store" / second / "MANIFEST").unlink()
    with pytest.raises(StoreError, match="not whole"):
        s.load("nodes")


def test_vocabularies(spark, rows):
    n = spark.createDataFrame([("a", "module"), (None, "module"), ("b", "planet")], "id string, kind string")
    assert rows(invalid_rows(nodes=n)) == [("nodes", "id", None), ("nodes", "kind", "b")]


def test_discovery(spark, rows, tmp_path):
    for p, t in {"src/a.ts": "export const a = 1;", "src/a.test.ts": "//", "docs/x.md": "# X", "node_modules/p/i.ts": "x", "out/b.ts": "x", "src/u.ts": 'import x from "vitest"'}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    f = discover_files(spark, str(tmp_path), ["out/*"])
    assert rows(discover_files(spark, str(tmp_path), ["out/*"], ignored=["node_modules", "docs"]), "rel_path")[0] == ("src/a.test.ts",)
    assert rows(f, "rel_path", "role") == [("docs/x.md", "document"), ("src/a.test.ts", "test"), ("src/a.ts", "source"), ("src/u.ts", "test")]
    assert rows(count_typescript(discover_files(spark, str(tmp_path), content=False))) == [(4,)]


def test_candidates_in_three_forms(spark, rows):
    t = [
        (1, '[{"path": "./a.ts", "score": 0.9}, {"nope": 1}, {"path": "src/b.ts", "file": "src/a.ts", "relevance": 0.8}]'), (2, '{"results": [{"filePath": "b.ts", "text": "s", "content": "c", "symbol": "f", "start": 3, "end_line": 9}]}'),
        (3, '{"file": "c.ts"}\n\n{"path": "d\\\\e.ts", "similarity": 0.1}\nbroken'), (4, ""), (5, None),
    ]
    assert rows(parse_candidates(spark.createDataFrame(t, "query_id int, text string"))) == [
        (1, "a.ts", 0.9, None, None, None, None), (1, "src/a.ts", 0.8, None, None, None, None), (2, "b.ts", 0.5, "f", "c", 3, 9), (3, "c.ts", 0.5, None, None, None, None), (3, "d/e.ts", 0.1, None, None, None, None),
    ]


def test_tasks(spark, rows):
    t = spark.createDataFrame([(1, "Fix the slow path\n- Mode: bugfix\n> Capability: a, b ,\nExpected: one, two\nOther: x")], "task_id int, text string")
    assert rows(parse_tasks(t), "field", "value") == [("capabilities", "a"), ("capabilities", "b"), ("expected_behavior", "one, two"), ("mode", "bugfix")]
    assert [r[0] for r in t.select(detect_mode(t.text)).collect()] == ["performance"]
