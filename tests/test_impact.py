import json
import math
import random

from ripplegraph.operators import impact
from ripplegraph.operators.cochange import co_changes, parse_name_status
from ripplegraph.operators.extract import parse_diffs
from ripplegraph.operators.graph import bfs, oriented, pagerank, simple_paths
from ripplegraph.operators.report import verify_reports
from ripplegraph.operators.retrieval import bm25

EV = "array<struct<file_path:string,start_line:int,end_line:int,source_kind:string>>"
NODE = f"id string, kind string, name string, file_path string, exported boolean, tags array<string>, evidence {EV}, metadata map<string,string>"
EDGE = "kind string, from_id string, to_id string"


def node(i, kind="function", at=(1, 10), exported=False, tags=(), path="a.ts", metadata=None):
    return (i, kind, i, path, exported, list(tags), [(path, at[0], at[1], "code")] if at else [], metadata or {})


def verdict(spark, nodes, edges, hunks):
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    h = spark.createDataFrame([("d", "a.ts", k, *x) for k, x in enumerate(hunks)], "diff_id string, file_path string, hunk_no int, old_start int, old_lines int, new_start int, new_lines int")
    x = impact.analyze(n, e, h)
    return x["verdicts"].first().verdict, sorted(r.condition for r in x["findings"].collect())


def test_golden_verdicts(spark):
    bound = [("constrained_by", "f", "i")]
    assert verdict(spark, [node("f")], bound, [(6, 1, 6, 1)]) == ("BLOCK", ["invariant_touched_without_test"])
    assert verdict(spark, [node("f")], [*bound, ("tested_by", "f", "t")], [(6, 1, 6, 1)]) == ("PASS", [])
    assert verdict(spark, [node("f")], bound, [(11, 1, 30, 2)]) == ("PASS", [])
    assert verdict(spark, [node("f")], bound, [(50, 2, 10, 0)]) == ("BLOCK", ["invariant_touched_without_test"])
    assert verdict(spark, [node("f", tags=["security"])], [], [(1, 0, 1, 5)]) == ("BLOCK", ["security_surface_without_verification"])
    assert verdict(spark, [node("f", "interface", exported=True)], [], [(1, 1, 1, 1)]) == ("WARN", ["contract_changed_without_test"])
    assert verdict(spark, [node("m", "module", at=None, tags=["security"])], [], [(90, 1, 90, 1)])[0] == "BLOCK"
    assert verdict(spark, [node("c", "capability", tags=["security"])], [], [(1, 1, 1, 1)]) == ("PASS", [])


def test_contradictions_warn(spark):
    """Deprecated and contradicting documents are the fifth condition; it fires on claims, with or without a document touched."""
    old, new = node("old", "document", metadata={"deprecated": "true"}), node("new", "document", at=(200, 210))
    assert verdict(spark, [old], [], [(1, 1, 1, 1)]) == ("WARN", ["contradiction_unresolved"])
    assert verdict(spark, [old], [], [(50, 1, 50, 1)]) == ("PASS", [])
    against = [("contradicts", "new", "f")]
    assert verdict(spark, [node("f"), new], against, [(1, 1, 1, 1)]) == ("WARN", ["contradiction_unresolved"])
    assert verdict(spark, [node("f"), node("g")], [("contradicts", "g", "f")], [(1, 1, 1, 1)]) == ("PASS", [])
    n, e = spark.createDataFrame([node("f"), new, old], NODE), spark.createDataFrame([*against, ("contradicts", "old", "f")], EDGE)
    h = spark.createDataFrame([("d", "a.ts", 1, 1, 1, 1, 1)], "diff_id string, file_path string, hunk_no int, old_start int, old_lines int, new_start int, new_lines int")
    found = impact.analyze(n, e, h)["findings"].collect()
    assert [(r.severity, r.n_nodes, r.message) for r in found] == [("warn", 1, "change touches 3 unresolved contradiction(s)")]


def test_hunks_without_starts_count_by_file(spark, rows):
    n = spark.createDataFrame([node("near"), node("far", at=(900, 950)), node("long", at=(1, 100_000)), node("module", "module", at=None), node("other", path="b.ts")], NODE)
    hunks = "diff_id string, file_path string, hunk_no int, old_start int, old_lines int, new_start int, new_lines int"
    mixed = spark.createDataFrame([("d", "a.ts", 1, None, 1, None, 1), ("d", "a.ts", 2, 5, 0, None, 1), ("e", "a.ts", 1, None, 1, None, 1), ("f", "a.ts", 1, 90_000, 1, 920, 60_000), ("g", "b.ts", 1, None, 1, 1, 1)], hunks)
    got = rows(impact.impacted_nodes(n, mixed), "diff_id", "id")
    assert got == sorted([("d", "near"), ("d", "long"), ("d", "module"), *(("e", i) for i in ("near", "far", "long", "module")), ("f", "far"), ("f", "long"), ("f", "module"), ("g", "other")])


def test_a_file_of_many_hunks_against_brute_force(spark, rows):
    r = random.Random(8)
    nodes = [node(f"n{k}", at=(a, a + r.choice([0, 3, 300, 20_000]))) for k in range(60) for a in [r.randrange(1, 9000)]]
    hunks = [("d%d" % (k % 3), "a.ts", k, r.choice([None, r.randrange(1, 30_000)]), r.choice([0, 1, 40, 9_000]), r.choice([None, r.randrange(1, 30_000)]), r.choice([0, 2, 700])) for k in range(120)]
    want = set()
    for d, _, _, a, m, b, k in hunks:
        for n in nodes:
            lo, hi = n[6][0][1], n[6][0][2]
            if any(s is not None and s <= hi and s + max(w, 1) - 1 >= lo for s, w in ((a, m), (b, k))):
                want.add((d, n[0]))
    h = spark.createDataFrame(hunks, "diff_id string, file_path string, hunk_no int, old_start int, old_lines int, new_start int, new_lines int")
    assert rows(impact.impacted_nodes(spark.createDataFrame(nodes, NODE), h), "diff_id", "id") == sorted(want)


def test_rules_of_a_configuration(spark, rows):
    r = impact.rules(spark, [("a", "x", "warn", None), ("b", "x", "block", None), ("c", "y", "block", "advisory"), ("d", "z", "block", None)])
    assert rows(r, "rule", "tier") == [("a", "advisory"), ("b", "advisory"), ("c", "advisory"), ("d", "strict")]


def test_unknowns(spark, rows):
    n = spark.createDataFrame([node("f"), node("g"), node("t", "test"), node("i", "invariant", metadata={"statement": "never negative"}), node("j", "invariant")], NODE)
    e = spark.createDataFrame([("e1", "constrained_by", "f", "i"), ("e2", "constrained_by", "f", "j"), ("e3", "constrained_by", "g", "j"), ("e4", "tested_by", "g", "t"), ("e0", "constrained_by", "f", "gone")], "id string, " + EDGE)
    h = spark.createDataFrame([("d", "a.ts", 1, 1, 1, 1, 1)], "diff_id string, file_path string, hunk_no int, old_start int, old_lines int, new_start int, new_lines int")
    diffs = spark.createDataFrame([("d",), ("empty",)], "diff_id string")
    assert rows(impact.unknowns(n, e, h, impact.impacted_nodes(n, h), diffs)) == [
        ("d", '"f" is constrained by [i, j] but has no test — behaviour under change is unverified.'), ("d", "Impacted invariant is not test-backed: never negative"), ("empty", "No changes detected in the diff."),
    ]


def test_exit_codes(spark, rows):
    v = spark.createDataFrame([(x,) for x in ("PASS", "WARN", "BLOCK", "STALE", "PARTIAL", "VERIFIED")], "verdict string")
    failing = lambda how: {r.verdict for r in impact.exit_codes(v, how).collect() if r.exit_code == 3}
    assert failing("none") == set() and failing("block") == {"BLOCK", "STALE"} and failing("warn") == {"BLOCK", "STALE", "WARN"} and failing("partial") == {"BLOCK", "STALE", "PARTIAL"}


def test_report_leaves_out_empty_parts(spark):
    n = spark.createDataFrame([node("F", exported=True, tags=["security"]), node("G", path="b.ts"), node("t", "test", path=None)], NODE)
    e = spark.createDataFrame([("1", "calls", "G", "F"), ("2", "tested_by", "G", "t")], "id string, " + EDGE)
    h = spark.createDataFrame([(d, p, 1, 1, 1, 1, 1) for d, p in (("d", "a.ts"), ("e", "b.ts"))], "diff_id string, file_path string, hunk_no int, old_start int, old_lines int, new_start int, new_lines int")
    git = spark.createDataFrame([("d", "main", "x", None, None)], "diff_id string, base string, head string, merge_base string, range string")
    got = {r.diff_id: json.loads(r.report) for r in verify_reports(n, e, h, git=git).collect()}
    d, e = got["d"], got["e"]
    assert list(d)[:6] == ["schemaVersion", "verdict", "base", "head", "mergeBase", "range"] and (d["base"], d["mergeBase"]) == ("main", None)
    assert d["findings"] == [{"rule": "security_surface_without_verification", "tier": "strict", "severity": "block", "message": "security surface changed without verification: F", "nodeIds": ["F"], "locations": [{"file": "a.ts", "line": 1}]}]
    assert d["impactedConsumers"] == [{"symbol": {"id": "F", "name": "F", "kind": "function", "file": "a.ts"}, "consumers": [{"id": "G", "name": "G", "kind": "function", "file": "b.ts"}]}]
    assert "impactedConsumers" not in e and "coChangedFiles" not in e and e["verdict"] == "PASS" and e["recommendedTests"] == [{"name": "t"}] and e["summary"] == {"blockCount": 0, "warnCount": 0}


def test_consumers(spark, rows):
    n = spark.createDataFrame([node("F", exported=True), node("C", "interface", exported=True), node("G"), node("modA", "module"), node("modB", "module")], NODE)
    e = spark.createDataFrame([("calls", "G", "F"), ("declares", "modA", "F"), ("declares", "modA", "C"), ("imports", "modB", "modA"), ("calls", "F", "F"), ("calls", "gone", "F")], EDGE)
    hit = spark.createDataFrame([("d", "F"), ("d", "C"), ("d", "G")], "diff_id string, id string")
    assert rows(impact.impacted_consumers(n, e, hit), "symbol_id", "consumer_id") == [("C", "modB"), ("F", "G"), ("F", "modB")]


def test_diffs(spark, rows):
    text = "diff --git\n--- a/x.ts\n+++ b/./x.ts\n@@ -10,2 +10,3 @@ f\n+++ b/fake.ts\n@@ -1 +2,0 @@\n--- a/gone.ts\n+++ /dev/null\n@@ -1 +1 @@\n--- /dev/null\n+++ b/new.ts\r\n"
    got = parse_diffs(spark.createDataFrame([("d", text), ("e", ""), ("n", None)], "diff_id string, text string"))
    assert rows(got, "diff_id", "file_path", "old_start", "old_lines", "new_start", "new_lines") == [("d", "new.ts", None, None, None, None), ("d", "x.ts", 1, 1, 2, 0), ("d", "x.ts", 10, 2, 10, 3)]


def test_name_status_and_co_change(spark, rows):
    log = "\x1eM\ta\nA\tb\nM\ta\n\x1eR100\ta\tc\n\x1e\n\x1eM\tx\nM\ty"
    got = parse_name_status(spark.createDataFrame([("l", log)], "log_id string, text string"))
    assert rows(got, "commit_no", "file") == [(1, "a"), (1, "b"), (2, "a"), (2, "c"), (4, "x"), (4, "y")]
    c = spark.createDataFrame([("r", k, f) for k, fs in enumerate((["a", "b"], ["a", "b"], ["a", "c"], ["x", "y"], ["a", "c"])) for f in fs], "repo string, commit_id int, file string")
    ch = spark.createDataFrame([("a",)], "file string")
    assert rows(co_changes(c, ch, 2, 1), "co_file", "commits") == [("b", 2)] and rows(co_changes(c, ch, 2), "co_file") == [("b",), ("c",)]


def test_search_paths_and_rank(spark, rows):
    e = spark.createDataFrame([("calls", a, b) for a, b in ("ab", "bc", "ca", "cd", "xa")], EDGE)
    n = spark.createDataFrame([(x,) for x in "abcdx"], "id string")
    seeds = spark.createDataFrame([("s", "a"), ("s", "nowhere")], "seed_set string, id string")
    assert rows(bfs(n, oriented(e, ["calls"]), seeds, 2), "id", "hop") == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(simple_paths(oriented(e, ["calls"]), n.where("id = 'x'")), "path") == [(["x", "a", "b", "c", "d"],)]
    adj = oriented(e, ["calls"], "both")
    rank = {r.node: r.rank for r in pagerank(adj, 30).collect()}
    want = dict.fromkeys("abcdx", 0.2)
    near = {k: [b for a, b in ((r.src, r.dst) for r in adj.collect()) if a == k] for k in want}
    for _ in range(30):
        want = {k: 0.03 + 0.85 * sum(want[m] / len(near[m]) for m in near[k]) for k in want}
    assert all(abs(rank[k] - want[k]) < 1e-12 for k in want)


def test_bm25_against_scoring_all(spark, monkeypatch):
    from ripplegraph.operators import retrieval

    monkeypatch.setattr(retrieval, "FIRST_POSTINGS", 30)
    r = random.Random(6)
    words = [f"w{'abcdefghij'[k % 10]}{k}" for k in range(60)]
    texts = [" ".join(r.choices(words, [1 / (k + 1) for k in range(60)], k=r.randrange(0, 40))) for _ in range(150)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    queries = docs.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    bags = [(t or "").split() for t in texts]
    size = sum(map(len, bags)) / len(bags)
    df = {w: sum(w in b for b in bags) for w in words}
    want = {}
    for q in range(0, 152, 10):
        score = {}
        for d, b in enumerate(bags):
            s = sum(math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b.count(w) * 2.5 / (b.count(w) + 1.5 * (0.25 + 0.75 * len(b) / size)) for w in set(bags[q]) & set(b))
            if s > 0 and d != q:
                score[d] = s
        want |= {(q, k + 1): (d, round(score[d], 9)) for k, d in enumerate(sorted(score, key=lambda d: (-round(score[d], 9), d))[:5])}
    got = {(x.query_id, x.pos): (x.doc_id, round(x.score, 9)) for x in bm25(docs, queries, 5, skip_self=True).collect()}
    assert got == want


def test_wide_commits_in_blocks(spark, rows, monkeypatch):
    from ripplegraph.operators import cochange

    r = random.Random(2)
    sets = [[f"f{k}" for k in range(60) if r.random() < 0.7] for _ in range(4)] + [["f1", "f2"], ["f1", "f3"], ["f1", "f1"]]
    c = spark.createDataFrame([("r", k, f) for k, fs in enumerate(sets) for f in set(fs)], "repo string, commit_id int, file string")
    ch = spark.createDataFrame([(f"f{k}",) for k in range(5)], "file string")
    whole = rows(cochange.co_change_counts(c, ch, 2), "file", "co_file", "commits")
    monkeypatch.setattr(cochange, "BLOCK", 7)
    assert whole and rows(cochange.co_change_counts(c, ch, 2), "file", "co_file", "commits") == whole
