import hashlib

import pytest

from ripplegraph.operators import authored
from ripplegraph.operators.control import bounds, certifying, explain_why, graph_fingerprint, impact_paths, refinement_steps, traverse_levels
from ripplegraph.operators.refinement import format_relation, parse_relation, parse_relations, verified_digests

D1, D2 = "sha256:" + "1" * 64, "sha256:" + "2" * 64
GOOD = f"""relation r.1 realizes source semantic code.a
target semantic "cap one"
epistemicStatus human_declared
provenance author
evidenceRef commit git:abc {D1}
evidenceRef document_span docs/a.md {D2}
end"""


def codes(text):
    return [c for _, _, c in parse_relation(text.split("\n"))[1]]


def test_canonical_text_round_trips():
    r, problems = parse_relation(GOOD.split("\n"))
    assert not problems and format_relation(r) == GOOD and r["target"] == ("semantic", "cap one")


@pytest.mark.parametrize(("change", "code"), [
    (("realizes", "admires"), "RELATION_UNKNOWN_KIND"), (("source semantic", "origin semantic"), "RELATION_MALFORMED_HEADER"), (("semantic code.a", "planet code.a"), "RELATION_INVALID_ENDPOINT"), (("human_declared", "felt"), "RELATION_UNKNOWN_EPISTEMIC_STATUS"),
    (("provenance author", "provenance ghost"), "RELATION_UNKNOWN_PROVENANCE"), (("provenance author\n", ""), "RELATION_MISSING_FIELD"), (("\nend", ""), "RELATION_MISSING_END"), (("document_span", "rumour"), "RELATION_UNKNOWN_EVIDENCE_KIND"),
    ((D2, "sha256:22"), "RELATION_MALFORMED_DIGEST"), ((f"evidenceRef document_span docs/a.md {D2}", f"evidenceRef commit git:abc {D1}"), "RELATION_DUPLICATE_EVIDENCE"), (("commit git:abc", "test_result z"), "RELATION_EVIDENCE_OUT_OF_ORDER"),
    (("semantic code.a", "semantic  code.a"), "RELATION_NON_CANONICAL_ENCODING"), (("code.a", "côde"), "RELATION_NON_ASCII"), (('"cap one"', '"cap one'), "RELATION_MALFORMED_TOKEN"), (("provenance author", "colour red"), "RELATION_UNKNOWN_FIELD"),
    (("semantic code.a", "observed_hunk sha256:1"), "RELATION_MALFORMED_DIGEST"), ((f" git:abc {D1}", ""), "RELATION_MALFORMED_EVIDENCE"), (("epistemicStatus human_declared\nprovenance author", "provenance author\nepistemicStatus human_declared"), "RELATION_FIELD_OUT_OF_ORDER"),
])
def test_each_fault_has_its_code(change, code):
    assert code in codes(GOOD.replace(*change))


def test_files(spark, rows):
    text = f"goal goal.a\n  statement: s\n{GOOD}\n{GOOD.replace('r.1', 'r.2')}\n{GOOD}\nrelation broken\ngoal goal.b\n  statement: t\n"
    files = spark.createDataFrame([("f", text), ("g", None)], "file string, text string")
    r, d = parse_relations(files)
    assert [x.id for x in r.collect()] == ["r.2"] and rows(d, "code") == [("RELATION_DUPLICATE_ID",), ("RELATION_MALFORMED_HEADER",)]
    m = authored.model(authored.parse_blocks(files))
    assert rows(m["nodes"], "id") == [("goal.a",), ("goal.b",)] and rows(m["diagnostics"]) == []


def test_only_true_evidence_is_verified(spark, rows):
    sha = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()
    ev = [("commit", "git:c1", sha("c1")), ("commit", "c1", sha("c2")), ("document_span", "a.md", sha("text")), ("semantic_node", "n", D1), ("observed_diff_hunk", "x", D2), ("observed_diff_hunk", "x", D1)]
    rel = spark.createDataFrame([("r", ev)], "id string, evidence array<struct<kind:string,locator:string,digest:string>>")
    got = verified_digests(rel, spark.createDataFrame([(D2,)], "identity string"), spark.createDataFrame([("n", D1), ("m", D2)], "id string, digest string"), spark.createDataFrame([("c1",)], "commit_id string"), spark.createDataFrame([("a.md", "text")], "rel_path string, content string"))
    assert {r[0] for r in rows(got)} == {sha("c1"), sha("text"), D1, D2}


def test_lift_needs_every_certified_step(spark, rows):
    coords = spark.createDataFrame([("c", 1), ("b", 2), ("k", 3), ("x", 3)], "id string, level int")
    rel = spark.createDataFrame([("1", "realizes", "c", "b", "human_declared"), ("2", "decomposes_to", "k", "b", "human_declared"), ("3", "implements", "b", "k", "human_declared"), ("4", "implements", "b", "x", "llm_inferred")], "id string, kind string, source string, target string, epistemic_status string")
    ev = spark.createDataFrame([(i, f"d{i}") for i in "1234"], "relation_id string, digest string")
    src = spark.createDataFrame([("c",), ("nowhere",)], "id string")

    def lift(known):
        cert = certifying(rel, ev, spark.createDataFrame([(k,) for k in known], "digest string"))
        return rows(traverse_levels(coords, refinement_steps(cert, coords, "lift"), src, 3, "lift"))

    assert lift(["d1", "d2", "d3", "d4"]) == [("c", ["c", "b", "k"], ["1", "2"]), ("c", ["c", "b", "k"], ["1", "3"])]
    assert lift(["d1", "d2"]) == [("c", ["c", "b", "k"], ["1", "2"])] and lift(["d1", "d4"]) == [] and lift(["d3"]) == []


def test_rationale_impact_and_bounds(spark, rows):
    coords = spark.createDataFrame([("a", "B", None), ("g", "B", "goal"), ("h", "B", "goal"), ("r", "A", "goal")], "id string, plane string, category string")
    edges = spark.createDataFrame([("a", "b", "serves"), ("b", "g", "justifies"), ("g", "h", "serves"), ("a", "r", "serves"), ("a", "h", "calls")], "from_id string, to_id string, relation string")
    assert rows(explain_why(coords, edges, spark.createDataFrame([("a",), ("g",)], "id string"))) == [("a", "g", ["a", "b", "g"]), ("g", "g", ["g"])]
    e = spark.createDataFrame([(a, b, "calls") for a, b in ("sa", "sb", "sc", "at", "bt", "ct", "tu", "us")], "from_id string, to_id string, relation string")
    got = rows(impact_paths(e, spark.createDataFrame([("q", "s")], "source_set string, id string"), 3), "id", "path")
    assert [p for i, p in got if i == "t"] == [["s", "a", "t"], ["s", "b", "t"]] and {i for i, _ in got} == {"a", "b", "c", "t", "u"}
    assert bounds(max_depth=1000, max_results=0) == {"max_depth": 100, "max_results": 1, "max_expansions": 10_000, "max_queue": 1_000}
    assert rows(graph_fingerprint(coords, edges)) == rows(graph_fingerprint(coords.orderBy("id").repartition(3), edges.orderBy("to_id")))


def test_patches_and_wiring(spark, rows):
    c = spark.createDataFrame([("c", ["a", "b"]), ("d", None)], "id string, serves array<string>")
    p = spark.createDataFrame([("c", ["b", "x"], ["a"])], "id string, add_serves array<string>, remove_serves array<string>")
    assert rows(authored.apply_patches(c, p, ("serves",))) == [("c", ["b", "x"]), ("d", [])]
    e = spark.createDataFrame([("implements_capability", "f", "cap"), ("implements_capability", "g", "cap"), ("constrained_by", "f", "i")], "kind string, from_id string, to_id string")
    assert rows(authored.capability_wiring(e, spark.createDataFrame([("f", "bc1"), ("g", None)], "id string, bounded_context string"))) == [("cap", ["i"], ["bc1"])]


def test_digests_are_not_broadcast(spark, rows):
    e = spark.createDataFrame([("commit", "git:c", "sha256:" + hashlib.sha256(b"c").hexdigest()), ("semantic_node", "n", "x"), ("test_result", "f", "y"), ("observed_diff_hunk", "", "h")], "kind string, locator string, digest string")
    one = lambda *v, of: spark.createDataFrame([v], of)
    got = verified_digests(e.selectExpr("array(struct(kind, locator, digest)) as evidence"), one("h", of="identity string"), one("n", "x", of="id string, digest string"), one("c", of="commit_id string"), one("f", "t", of="rel_path string, content string"))
    assert rows(got) == sorted([("h",), ("x",), ("sha256:" + hashlib.sha256(b"c").hexdigest(),)], key=repr)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
