"""What a diff touches, and what follows: impacted nodes, claims, tests, consumers, findings, verdict. Every operator takes
many diffs at once, keyed by diff_id."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions.paths import normalize_path
from ripplegraph.operators.graph import is_deprecated, statement_of, with_lines
from ripplegraph.runtime import checkpointed

#: Kinds of node a diff can touch, and kinds that are symbols.
TOUCHABLE = ("function", "class", "interface", "type", "enum", "module", "test", "document", "migration")
SYMBOLS = TOUCHABLE[:5]
#: Fixed values: (order, rule, condition, severity, tier) of the default rules.
RULES = (
    (0, "invariant-needs-test", "invariant_touched_without_test", "block", "strict"),
    (1, "critical-contract-needs-test", "critical_contract_changed_without_test", "block", "strict"),
    (2, "security-needs-verification", "security_surface_without_verification", "block", "strict"),
    (3, "contract-needs-test", "contract_changed_without_test", "warn", "advisory"),
    (4, "contradiction-unresolved", "contradiction_unresolved", "warn", "advisory"),
)
#: How a finding of each condition begins.
MESSAGES = {
    "invariant_touched_without_test": "invariant-constrained code changed without a covering test: ",
    "critical_contract_changed_without_test": "critical exported contract changed without a covering test: ",
    "contract_changed_without_test": "exported contract changed without a covering test: ",
    "security_surface_without_verification": "security surface changed without verification: ",
}


def current_hunks(hunks: DataFrame) -> DataFrame:
    """One row per (diff_id, file_path, hunk_no), the latest received; an omitted count is 1."""
    h = hunks.select("diff_id", normalize_path("file_path").alias("file_path"), "hunk_no", "received_at", "old_start", "old_lines", "new_start", "new_lines")
    h = h.groupBy("diff_id", "file_path", "hunk_no").agg(F.max(F.struct("received_at", "old_start", "old_lines", "new_start", "new_lines")).alias("h"))
    one = lambda c: F.coalesce(F.col(f"h.{c}"), F.lit(1)).alias(c)
    return h.select("diff_id", "file_path", "hunk_no", "h.old_start", one("old_lines"), "h.new_start", one("new_lines"))


def candidates(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """(diff_id, id, kind): nodes in files that a diff changes."""
    files = hunks.select("diff_id", "file_path").distinct()
    n = nodes.where(F.col("kind").isin(*TOUCHABLE) & F.col("file_path").isNotNull()).select("id", "kind", "file_path")
    return n.join(files, "file_path").select("diff_id", "id", "kind")


#: Lines to a bucket, by which lines of hunks and nodes of one file meet; the buckets a range may lie in to be met so.
BUCKET_LINES, MOST_BUCKETS = 256, 32


def impacted_nodes(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """(diff_id, id): nodes in a changed file whose line range meets the old or the new window of a hunk.

    A window of no lines counts as one line; a node without lines is touched by any change of its file; a hunk without a
    start has no window, and a file of a diff none of whose hunks has one touches all its nodes.

    Scale: windows and nodes of a file meet by blocks of lines, so a file of very many hunks or nodes is many keys and no
    pair is made only to be dropped, but at the rims of a block. Ranges too long for that are few and meet by file.
    """
    n = with_lines(nodes.where(F.col("kind").isin(*TOUCHABLE) & F.col("file_path").isNotNull())).select("id", "file_path", F.col("start_line").cast("long").alias("a"), F.col("end_line").cast("long").alias("z"))
    files = hunks.groupBy("diff_id", "file_path").agg(F.bool_or(F.col("old_start").isNotNull() | F.col("new_start").isNotNull()).alias("placed"))
    window = lambda p: F.when(F.col(f"{p}_start").isNotNull(), F.struct(F.col(f"{p}_start").cast("long").alias("lo"), (F.col(f"{p}_start").cast("long") + F.greatest(F.col(f"{p}_lines"), F.lit(1)) - 1).alias("hi")))
    w = hunks.select("diff_id", "file_path", F.explode(F.array_distinct(F.array_compact(F.array(window("old"), window("new"))))).alias("w")).select("diff_id", "file_path", "w.lo", "w.hi")
    lined = n.where("a is not null")
    short = lambda lo, hi: (F.col(hi) >= F.col(lo)) & (F.col(hi) - F.col(lo) < BUCKET_LINES * (MOST_BUCKETS - 1))
    blocks = lambda df, lo, hi: df.where(short(lo, hi)).withColumn("block", F.explode(F.sequence(F.floor(F.col(lo) / BUCKET_LINES), F.floor(F.col(hi) / BUCKET_LINES))))
    meets = (F.col("lo") <= F.col("z")) & (F.col("hi") >= F.col("a"))
    hits = [
        n.where("a is null").join(files, "file_path"), lined.join(files.where("not placed"), "file_path"), blocks(lined, "a", "z").join(blocks(w, "lo", "hi"), ["file_path", "block"]).where(meets),
        lined.where(~short("a", "z")).join(w, "file_path").where(meets), lined.where(short("a", "z")).join(w.where(~short("lo", "hi")), "file_path").where(meets),
    ]
    return reduce(DataFrame.unionByName, (x.select("diff_id", "id") for x in hits)).distinct()


def with_neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with what conditions ask: tested, constrained, beside_security. What edges say is joined to the nodes once."""
    secure = nodes.where(F.array_contains("tags", "security")).select(F.col("id").alias("to_id"))
    beside = edges.where("kind = 'related_to'").join(secure, "to_id", "left_semi").select(F.col("from_id").alias("id"), F.lit("beside_security").alias("is"))
    own = edges.where("kind in ('tested_by', 'constrained_by')").select(F.col("from_id").alias("id"), F.when(F.col("kind") == "tested_by", "tested").otherwise("constrained").alias("is"))
    names = ("tested", "constrained", "beside_security")
    said = own.unionByName(beside).groupBy("id").agg(*(F.bool_or(F.col("is") == c).alias(c) for c in names))
    return nodes.join(said, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in names})


def non_normative_subjects(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(claim, id): the subjects of the claims that are not normative, one claim a deprecated document and one a document and
    what it contradicts, as ``build_claims`` makes them; without building the others."""
    docs = nodes.where("kind = 'document'")
    old = docs.where(is_deprecated(nodes)).select(F.struct("id", F.lit(None).cast("string").alias("target")).alias("claim"), "id")
    pair = edges.where("kind = 'contradicts'").select(F.col("from_id").alias("id"), F.col("to_id").alias("target")).join(docs.select("id"), "id", "left_semi")
    against = pair.select(F.struct("id", "target").alias("claim"), F.explode(F.array_distinct(F.array("id", "target"))).alias("id"))
    return old.unionByName(against).distinct()


def contradictions_touched(impacted: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(diff_id, n): how many claims that are deprecated or contradicted a diff touches; diffs that touch none are left out."""
    hit = impacted.join(non_normative_subjects(nodes, edges), "id").select("diff_id", "claim").distinct()
    return hit.groupBy("diff_id").agg(F.count("*").alias("n"))


def conditions(impacted: DataFrame, nodes: DataFrame, edges: DataFrame, contradictions: DataFrame | None = None) -> DataFrame:
    """(diff_id, condition, id, name): impacted nodes that meet a condition.

    ``contradictions`` has (diff_id, n) of the diffs whose impacted claims are deprecated or contradicted; there it is the
    impacted documents that count.
    """
    n = with_neighbours(nodes, edges)
    contract = F.col("kind").isin("interface", "type") & F.coalesce("exported", F.lit(False))
    critical = F.array_contains("tags", "critical") | F.array_contains("tags", "security")
    bare = ~F.col("tested")
    when = {
        "invariant_touched_without_test": F.col("constrained") & bare,
        "critical_contract_changed_without_test": contract & critical & bare,
        "security_surface_without_verification": (F.array_contains("tags", "security") | F.col("beside_security")) & bare,
        "contract_changed_without_test": contract & ~critical & bare,
    }
    met = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in when.items())))
    n = n.select("id", "name", "kind", met.alias("met"))
    x = impacted.join(n, "id")
    found = x.select("diff_id", F.explode("met").alias("condition"), "id", "name")
    if contradictions is not None:
        doc = x.where("kind = 'document'").join(contradictions.select("diff_id"), "diff_id", "left_semi")
        found = found.unionByName(doc.select("diff_id", F.lit("contradiction_unresolved").alias("condition"), "id", "name"))
    return found


def findings(met: DataFrame, rules: DataFrame, contradictions: DataFrame | None = None) -> DataFrame:
    """(diff_id, ord, rule, condition, severity, tier, n_nodes, message): at most one finding per diff and rule.

    A rule fires when its condition has a node; that on contradictions fires on their count alone.
    """
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]), ", ")
    g = met.groupBy("diff_id", "condition").agg(F.count("*").alias("n_nodes"), names.alias("names"))
    if contradictions is not None:
        c = contradictions.select("diff_id", F.lit("contradiction_unresolved").alias("condition"), F.col("n").alias("n_contra"))
        g = g.join(c, ["diff_id", "condition"], "full")
    else:
        g = g.withColumn("n_contra", F.lit(None).cast("long"))
    text = F.coalesce(*(F.when(F.col("condition") == k, F.concat(F.lit(v), F.col("names"))) for k, v in MESSAGES.items()), F.concat(F.lit("change touches "), F.coalesce("n_contra", F.lit(0)).cast("string"), F.lit(" unresolved contradiction(s)")))
    return g.join(F.broadcast(rules), "condition").select(  # a handful of configured rules
        "diff_id", "ord", "rule", "condition", "severity", "tier", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), text.alias("message"))


def rules(spark: SparkSession, configured: Sequence[tuple[str, str, str, str | None]] | None = None) -> DataFrame:
    """(ord, rule, condition, severity, tier) of configured rules (rule, condition, severity, tier), by default the five.

    A rule without a tier is strict if it blocks, else advisory. Of several rules on one condition each fires with its own
    severity, but the first one's tier counts for all.
    """
    given = configured if configured is not None else [r[1:] for r in RULES]
    first: dict[str, str] = {}
    for _, condition, severity, tier in given:
        first.setdefault(condition, tier or ("strict" if severity == "block" else "advisory"))
    rows = [(k, rule, condition, severity, first[condition]) for k, (rule, condition, severity, _) in enumerate(given)]
    return spark.createDataFrame(rows, "ord int, rule string, condition string, severity string, tier string")


def default_rules(like: DataFrame) -> DataFrame:
    return rules(like.sparkSession)


def analyze(nodes: DataFrame, edges: DataFrame, hunks: DataFrame, by: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a diff touches and what follows, for all diffs of ``hunks``: ``impacted``, ``contradictions``, ``met`` (nodes that
    meet a condition), ``findings`` under the rules ``by``, and ``verdicts``."""
    impacted = checkpointed(impacted_nodes(nodes, hunks))
    against = checkpointed(contradictions_touched(impacted, nodes, edges))
    met = checkpointed(conditions(impacted, nodes, edges, against))
    found = findings(met, default_rules(hunks) if by is None else by, against)
    return {"impacted": impacted, "contradictions": against, "met": met, "findings": found, "verdicts": verdicts(hunks, found)}


def unknowns(nodes: DataFrame, edges: DataFrame, hunks: DataFrame, impacted: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
    """(diff_id, unknown): what a diff leaves open, in one line each: that it changes nothing, invariants it touches that no
    test backs, and constrained nodes without a test. ``diffs`` (diff_id) names diffs that may have no hunk."""
    n = with_neighbours(nodes, edges)
    bound = edges.where("kind = 'constrained_by'").select("id", "from_id", F.col("to_id").alias("inv"))
    name = nodes.select(F.col("id").alias("inv"), F.col("kind").alias("inv_kind"), F.col("name").alias("inv_name"), F.coalesce(statement_of(nodes), F.concat(F.lit("Invariant: "), "name")).alias("said"))
    bound = bound.join(name, "inv").join(n.select(F.col("id").alias("from_id"), "tested"), "from_id", "left")
    backed = bound.groupBy("inv").agg(F.coalesce(F.bool_or("tested"), F.lit(False)).alias("backed"))
    open_ = bound.where("inv_kind = 'invariant'").join(backed.where("not backed"), "inv", "left_semi").select(F.col("from_id").alias("id"), "said").distinct()
    unbacked = impacted.join(open_, "id").select("diff_id", F.concat(F.lit("Impacted invariant is not test-backed: "), "said").alias("unknown"))
    named = bound.where("inv_name <> ''").groupBy(F.col("from_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "inv_name"))), lambda x: x["inv_name"]), ", ").alias("invs"))
    bare = impacted.join(n.where("constrained and not tested").select("id", "name"), "id").join(named, "id", "left")
    text = F.concat(F.lit('"'), "name", F.lit('" is constrained by ['), F.coalesce("invs", F.lit("")), F.lit("] but has no test — behaviour under change is unverified."))
    found = unbacked.unionByName(bare.select("diff_id", text.alias("unknown")))
    if diffs is not None:
        none = diffs.select("diff_id").distinct().join(hunks.select("diff_id"), "diff_id", "left_anti")
        found = found.unionByName(none.select("diff_id", F.lit("No changes detected in the diff.").alias("unknown")))
    return found.distinct()


def exit_codes(verdicts: DataFrame, fail_on: str = "block") -> DataFrame:
    """``verdicts`` with exit_code: 3 where the policy says that a diff's verdict, or a change's, fails; else 0.

    ``fail_on``: ``none``; ``block`` (BLOCK, BLOCKED and STALE); ``warn`` also WARN; ``partial`` also PARTIAL.
    """
    failing = {"none": (), "block": ("BLOCK", "BLOCKED", "STALE"), "warn": ("BLOCK", "BLOCKED", "STALE", "WARN"), "partial": ("BLOCK", "BLOCKED", "STALE", "PARTIAL")}
    if fail_on not in failing:
        raise ValueError(f"fail_on must be one of {', '.join(failing)}")
    return verdicts.withColumn("exit_code", F.when(F.col("verdict").isin(*failing[fail_on] or ("",)), 3).otherwise(0))


def verdicts(hunks: DataFrame, found: DataFrame) -> DataFrame:
    """(diff_id, verdict, n_block, n_warn) of every diff: BLOCK over WARN over PASS."""
    g = found.groupBy("diff_id").agg(F.count_if(F.col("severity") == "block").alias("b"), F.count_if(F.col("severity") == "warn").alias("w"))
    d = hunks.select("diff_id").distinct().join(g, "diff_id", "left")
    b, w = F.coalesce("b", F.lit(0)), F.coalesce("w", F.lit(0))
    return d.select("diff_id", F.when(b > 0, "BLOCK").when(w > 0, "WARN").otherwise("PASS").alias("verdict"), b.alias("n_block"), w.alias("n_warn"))


def recommended_tests(nodes: DataFrame, edges: DataFrame, hunks: DataFrame) -> DataFrame:
    """(diff_id, test_id): tests of any touchable node in a changed file."""
    t = edges.where("kind = 'tested_by'").select(F.col("from_id").alias("id"), F.col("to_id").alias("test_id"))
    tests = nodes.where("kind = 'test'").select(F.col("id").alias("test_id"))
    return candidates(nodes, hunks).join(t, "id").join(tests, "test_id", "left_semi").select("diff_id", "test_id").distinct()


def impacted_consumers(nodes: DataFrame, edges: DataFrame, impacted: DataFrame) -> DataFrame:
    """(diff_id, symbol_id, consumer_id): callers of an impacted exported node, and importers of what declares it."""
    s = impacted.join(nodes.where("exported").select("id"), "id", "left_semi")
    e = lambda kind, a, b: edges.where(F.col("kind") == kind).select(F.col("from_id").alias(a), F.col("to_id").alias(b))
    callers = e("calls", "consumer_id", "id")
    importers = e("declares", "module", "id").join(e("imports", "consumer_id", "module"), "module").select("consumer_id", "id")
    uses = callers.unionByName(importers).where("consumer_id <> id").distinct().join(nodes.select(F.col("id").alias("consumer_id")), "consumer_id", "left_semi")
    return s.join(uses, "id").select("diff_id", F.col("id").alias("symbol_id"), "consumer_id")


def impacted_claims(claims: DataFrame, impacted: DataFrame) -> DataFrame:
    """(diff_id, claim_id): claims with an impacted subject."""
    subjects = claims.select(F.col("id").alias("claim_id"), F.explode("subject_node_ids").alias("id"))
    return impacted.join(subjects, "id").select("diff_id", "claim_id").distinct()
