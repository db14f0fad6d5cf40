from ripplegraph.operators import authored
from ripplegraph.operators.authored import model, parse_blocks, parse_text

TEXT = """# Truth of the shop. Comments start with a hash.

goal goal.checkout.safe
  statement: A payment is applied at most once.
  status: declared
  tag: shop

invariant invariant.payment.once
  rule: [retry, twice] equals once
  status: declared
  link: inv:seats
  link: sym:function:src/a.ts:go:12
  serves: goal.checkout.safe
  tag: critical

unknown unknown.race
  statement: A race may free a seat twice.

evidence proof.test.webhook
  statement: The test holds.
  link: test:test/a.test.ts

change change.webhook
  statement: Make it safe.
  status: active
  serves: [goal.checkout.safe]
  preserves:
    - invariant.payment.once
    -
  requires: proof.test.webhook
  unknown: unknown.race
  file: src/a.ts
"""


def test_sample(spark, rows):
    m = model(parse_blocks(spark.createDataFrame([("a.sem", TEXT), ("none", None)], "file string, text string")))
    assert rows(m["nodes"], "id", "kind", "status", "statement") == [
        ("goal.checkout.safe", "goal", "declared", "A payment is applied at most once."), ("invariant.payment.once", "invariant", "declared", "[retry, twice] equals once"),
        ("proof.test.webhook", "evidence", "declared", "The test holds."), ("unknown.race", "unknown", "declared", "A race may free a seat twice."),
    ]
    assert rows(m["change_refs"]) == [("change.webhook", "preserves", "invariant.payment.once"), ("change.webhook", "requires_evidence", "proof.test.webhook"), ("change.webhook", "serves", "goal.checkout.safe"), ("change.webhook", "unknown", "unknown.race")]
    assert rows(m["links"].where("owner_id = 'change.webhook'")) == [("change.webhook", "file", "src/a.ts")]
    assert rows(m["diagnostics"]) == [] and rows(authored.check_model(m)) == []
    again = model(parse_blocks(authored.format_blocks(m).withColumnRenamed("id", "file")))
    for k in ("relations", "change_refs", "links"):
        assert rows(again[k]) == rows(m[k])


def test_everything_odd_is_a_diagnostic():
    bad = "widget x\n  a: b\ngoal\n\ngoal goal.a\n\tstatement: t\n  - item\n  nonsense\n  status:\n  serves: [ , goal.b ,]\n"
    got = [(r[1], r[2], r[3]) for r in parse_text("f", bad)]
    assert got == [("error", 1, 1), ("error", 2, 3), ("error", 3, 6), ("block", 5, 1), ("warning", 6, 1), ("field", 6, 2), ("error", 7, 3), ("error", 8, 3), ("error", 9, 3), ("field", 10, 3)]


def verdict(spark, extra="", touched=(), under="PASS"):
    m = model(parse_blocks(spark.createDataFrame([("a.sem", TEXT.replace("  statement: The test holds.", "  statement: The test holds.\n" + extra))], "file string, text string")))
    n = spark.createDataFrame([("inv:seats", None), ("sym:function:src/a.ts:go:12", "src/a.ts"), ("test:test/a.test.ts", None)], "id string, file_path string")
    e = spark.createDataFrame([("constrained_by", "sym:function:src/a.ts:go:12", "inv:seats")], "kind string, from_id string, to_id string")
    none = spark.createDataFrame([], "id string")
    t = spark.createDataFrame([("change.webhook", i, s) for i, s in touched], "change_id string, id string, severity string")
    f = authored.change_findings(m, t, authored.footprints(m["links"], n, e), authored.resolve_links(m["links"], n, none, none), spark.createDataFrame([("change.webhook", under)], "change_id string, verdict string"))
    return authored.change_verdicts(m["changes"], f).first().verdict, sorted(r.kind for r in f.collect())


def test_composed_verdicts(spark):
    assert verdict(spark) == ("PARTIAL", ["open_unknown", "required_evidence_pending"])
    assert verdict(spark, "  status: tested") == ("PARTIAL", ["open_unknown"])
    assert verdict(spark, "  status: tested", [("sym:function:src/a.ts:go:12", "warn")]) == ("BLOCKED", ["critical_invariant_unproven", "open_unknown"])
    assert verdict(spark, "  status: tested", [("sym:function:src/a.ts:go:12", "none")], "WARN") == ("PARTIAL", ["open_unknown", "underlying_warn"])
    assert verdict(spark, "  status: tested\n  link: sym:gone") == ("STALE", ["open_unknown", "stale_link"])


def test_slice_is_capped_in_order(spark, rows):
    text = "goal goal.a\n  statement: s\n  serves: [goal.b, goal.c, goal.d, goal.missing]\n\n" + "\n".join(f"goal goal.{x}\n  statement: s\n" for x in "bcd")
    m = model(parse_blocks(spark.createDataFrame([("f", text)], "file string, text string")))
    seeds = spark.createDataFrame([("s", "goal.a")], "seed_set string, id string")
    assert rows(authored.slice_model(m, seeds, 3)) == [("s", "goal.a", 0, True), ("s", "goal.b", 1, True), ("s", "goal.c", 1, True)]
    assert rows(authored.slice_model(m, seeds, 9), "id", "truncated") == [(f"goal.{x}", False) for x in "abcd"]


def test_unknowns_need_proof(spark, rows):
    text = "unknown unknown.a\n  statement: s\n  proved_by: proof.x\n\nunknown unknown.b\n  statement: s\n  proved_by: proof.y\n\nevidence proof.x\n  statement: s\n  status: tested\n\nevidence proof.y\n  statement: s\n"
    m = model(parse_blocks(spark.createDataFrame([("f", text)], "file string, text string")))
    assert rows(authored.resolvable_unknowns(m)) == [("unknown.a", 1, True), ("unknown.b", 0, False)]


def test_the_worst_of_several_diffs_counts(spark, rows):
    v = spark.createDataFrame([("a", "PASS"), ("a", "WARN"), ("b", "WARN"), ("b", "BLOCK"), ("b", "PASS"), ("c", "PASS")], "file string, verdict string")
    assert rows(v.groupBy("file").agg(authored.worst_verdict().alias("w"))) == [("a", "WARN"), ("b", "BLOCK"), ("c", "PASS")]


def test_policies_and_the_order_of_findings(spark, rows):
    p = authored.Policy.of({"openUnknownSeverity": "block", "criticalInvariantTags": ["core"], "requireProofForActiveChange": False, "enabled": True})
    assert p == authored.Policy(("core",), "block", "warn", False) and authored.Policy.of(None) == authored.Policy()
    f = spark.createDataFrame([("c", "stale_link", "stale", "x"), ("c", "open_unknown", "warn", "u"), ("c", "underlying_block", "block", ""), ("c", "dangling_reference", "stale", "y"), ("d", "open_unknown", "warn", "u")], "change_id string, kind string, severity string, ref string")
    assert rows(authored.in_order(f), "change_id", "pos", "kind") == [("c", 1, "underlying_block"), ("c", 2, "dangling_reference"), ("c", 3, "stale_link"), ("c", 4, "open_unknown"), ("d", 1, "open_unknown")]


def test_pointers_to_active_changes(spark, rows):
    c = spark.createDataFrame([("r", "change.a", "active", "x"), ("r", "change.b", "draft", "x"), ("q", "change.c", "verified", "x"), ("p", "change.d", "stale", "x"), ("p", "change.e", "partial", "x"), ("o", "change.f", "draft", "x")], "repo string, id string, status string, content string")
    at = spark.createDataFrame([("q", "valid", "change.c", "x"), ("p", "valid", "change.d", "other"), ("o", "invalid", None, None), ("n", "valid", "change.z", "x")], "repo string, state string, change_id string, content string")
    base = spark.createDataFrame([("r", "stale"), ("q", "invalid"), ("p", "valid"), ("o", "missing")], "repo string, baseline string")
    assert rows(authored.lifecycle_findings(c, at, base)) == sorted([
        ("r", "ACTIVE_CHANGE_POINTER_MISSING", "change.a"), ("q", "ACTIVE_CHANGE_OBSOLETE", "change.c"), ("p", "ACTIVE_CHANGE_POINTER_MISMATCH", "change.d"), ("p", "ACTIVE_CHANGE_OBSOLETE", "change.e"),
        ("o", "ACTIVE_CHANGE_POINTER_INVALID", None), ("n", "ACTIVE_CHANGE_POINTER_INVALID", "change.z"), ("r", "EVIDENCE_BASELINE_STALE", None), ("q", "EVIDENCE_BASELINE_INVALID", None),
    ], key=repr)
