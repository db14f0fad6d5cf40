"""The diff-analysis surface over the current graph: what changed, what it touches, what follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators import impact
from ripplegraph.operators.claims import claim_rows
from ripplegraph.operators.cochange import co_changes_per_diff, commit_sets
from ripplegraph.operators.graph import current_graph, node_ranges
from ripplegraph.operators.report import verify_reports
from ripplegraph.plans.graph_sql import CLAIM_ID, DIFF_CO_CHANGE, FINDINGS, GRAPH, HUNKS, IMPACT, NINE_CLAIMS, RANGES, SEEDED_GRAPH, SEEDED_HUNKS, UNKNOWNS
from ripplegraph.runtime import checkpointed, read, stored


def graph(spark: SparkSession, d: str, proofs: bool = False, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """The current graph; with ``keep`` written once, for queries that read it several times."""
    n, e = current_graph(read(spark, d, "snapshots"), read(spark, d, "nodes"), read(spark, d, "edges"), proofs)
    return (stored(n), stored(e)) if keep else (n, e)


def _hunks(spark: SparkSession, d: str) -> DataFrame:
    return impact.current_hunks(read(spark, d, "hunks"))


def _analyzed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, DataFrame]]:
    (n, e), h = graph(spark, d, keep=True), checkpointed(_hunks(spark, d))
    return n, e, h, impact.analyze(n, e, h)


def seeded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph and hunks with what the tables lack: deprecated and contradicting documents, decisions, risks, declared contracts,
    tests that cover, and hunks without any start."""
    n, e = graph(spark, d)
    has = lambda t: F.array_contains("tags", t)
    kind = F.when((F.col("kind") == "enum") & has("generated"), "decision").when((F.col("kind") == "enum") & has("legacy"), "risk").when((F.col("kind") == "class") & has("generated"), "contract").otherwise(F.col("kind"))
    old = (F.col("kind") == "document") & has("legacy")
    first = n.where("kind = 'invariant'").groupBy("repo").agg(F.min("id").alias("to_id"))
    docs = n.where((F.col("kind") == "document") & has("generated")).join(first, "repo")
    risks = n.where((F.col("kind") == "enum") & has("legacy") & ~has("generated")).select(F.col("id").alias("to_id"))
    edge = lambda df, prefix, kind, a, b: df.select("repo", F.concat(F.lit(prefix), "id").alias("id"), F.lit(kind).alias("kind"), F.col(a).alias("from_id"), F.col(b).alias("to_id"))
    e = e.select("repo", "id", "kind", "from_id", "to_id")
    e = e.unionByName(edge(docs, "x:", "contradicts", "id", "to_id")).unionByName(edge(e.where("kind = 'tested_by'"), "c:", "covers", "to_id", "from_id"))
    e = e.unionByName(edge(e.where("kind = 'declares'").join(risks, "to_id", "left_semi"), "r:", "related_to", "from_id", "to_id"))
    h = _hunks(spark, d)
    bare = F.col("hunk_no") % 4 == 0
    h = h.withColumns({c: F.when(~bare, F.col(c)) for c in ("old_start", "new_start")})
    return stored(n.withColumns({"deprecated": F.col("deprecated") | old, "kind": kind})), stored(e), checkpointed(h)


def diff_hunks(spark: SparkSession, d: str) -> DataFrame:
    """The hunks that count, omitted counts filled in."""
    return _hunks(spark, d)


def node_line_range(spark: SparkSession, d: str) -> DataFrame:
    """First and last evidence line of every node."""
    return node_ranges(graph(spark, d)[0])


def impact_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Nodes in files that a diff changes."""
    return impact.candidates(graph(spark, d)[0], _hunks(spark, d))


def impacted_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose lines a diff touches."""
    return impact.impacted_nodes(stored(graph(spark, d)[0]), checkpointed(_hunks(spark, d)))


def impacted_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims with an impacted subject."""
    n, e = graph(spark, d, keep=True)
    claims = claim_rows(n, e).withColumnRenamed("subjects", "subject_node_ids")
    return impact.impacted_claims(claims, impact.impacted_nodes(n, checkpointed(_hunks(spark, d))))


def impacted_claim_keys(spark: SparkSession, d: str) -> DataFrame:
    """Invariants and exported contracts impacted per diff, by their first subject."""
    n, e = graph(spark, d, keep=True)
    claims = claim_rows(n, e).withColumnRenamed("subjects", "subject_node_ids")
    claims = checkpointed(claims.where("kind = 'invariant' or (kind = 'contract' and array_contains(tags, 'exported'))"))
    hit = impact.impacted_claims(claims, impact.impacted_nodes(n, checkpointed(_hunks(spark, d))))
    return hit.join(claims.select(F.col("id").alias("claim_id"), "kind", F.col("subject_node_ids")[0].alias("subject")), "claim_id").select("diff_id", "kind", "subject").distinct()


def recommended_tests(spark: SparkSession, d: str) -> DataFrame:
    """Tests of nodes in changed files."""
    n, e = graph(spark, d)
    return impact.recommended_tests(n, e, _hunks(spark, d))


def untested_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Constrained nodes without a test."""
    n, e = graph(spark, d)
    by = lambda kind: e.where(F.col("kind") == kind).select(F.col("from_id").alias("id"))
    return n.join(by("constrained_by"), "id", "left_semi").join(by("tested_by"), "id", "left_anti").select("id", "kind", "name")


def contract_surface(spark: SparkSession, d: str) -> DataFrame:
    """Exported interfaces and types, and whether they are critical."""
    n, _ = graph(spark, d)
    critical = F.arrays_overlap("tags", F.array(F.lit("critical"), F.lit("security")))
    return n.where("kind in ('interface', 'type') and exported").select("id", critical.alias("critical"))


def security_surface(spark: SparkSession, d: str) -> DataFrame:
    """Nodes tagged security or related to one, and whether they are tested."""
    n = impact.with_neighbours(*graph(spark, d))
    return n.where(F.array_contains("tags", "security") | F.col("beside_security")).select("id", "tested")


def impacted_consumers(spark: SparkSession, d: str) -> DataFrame:
    """Callers and importers of impacted exported symbols."""
    n, e = graph(spark, d, keep=True)
    return impact.impacted_consumers(n, e, impact.impacted_nodes(n, checkpointed(_hunks(spark, d))))


def verify_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of every diff under the default rules."""
    return _analyzed(spark, d)[3]["findings"]


def verify_seeded(spark: SparkSession, d: str) -> DataFrame:
    """The same over a graph with deprecated and contradicting documents, and hunks without a start."""
    return impact.analyze(*seeded(spark, d))["findings"]


def finding_summary(spark: SparkSession, d: str) -> DataFrame:
    """Findings counted by rule, severity and tier."""
    return verify_findings(spark, d).groupBy("rule", "severity", "tier").agg(F.count("*").alias("n_findings"), F.sum("n_nodes").alias("n_nodes"))


def verify_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The verdict of every diff."""
    return _analyzed(spark, d)[3]["verdicts"]


def verify_exit_codes(spark: SparkSession, d: str) -> DataFrame:
    """How each diff would end a run that fails on warnings too."""
    return impact.exit_codes(_analyzed(spark, d)[3]["verdicts"], "warn").select("diff_id", "verdict", "exit_code")


def _locations(n: DataFrame, met: DataFrame) -> DataFrame:
    at = n.select("id", "file_path", "start_line")
    return met.join(at, "id").select("diff_id", "condition", "id", "file_path", "start_line")


def finding_locations(spark: SparkSession, d: str) -> DataFrame:
    """File and first line of every node that a finding names."""
    n, _, _, x = _analyzed(spark, d)
    return _locations(n, x["met"])


def verify_unknowns(spark: SparkSession, d: str) -> DataFrame:
    """What a diff leaves open: nothing changed, invariants no test backs, constrained nodes without a test."""
    (n, e), h = graph(spark, d, keep=True), checkpointed(_hunks(spark, d))
    diffs = read(spark, d, "hunks").select("diff_id").union(read(spark, d, "snapshots").select(F.concat(F.lit("none:"), "snapshot_id")))
    return impact.unknowns(n, e, h, checkpointed(impact.impacted_nodes(n, h)), diffs)


def verify_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of every diff as JSON, with what history says of its files."""
    (n, e), h = graph(spark, d, keep=True), checkpointed(_hunks(spark, d))
    co = co_changes_per_diff(commit_sets(read(spark, d, "commit_files")), h.select("diff_id", F.col("file_path").alias("file")))
    return verify_reports(n, e, h, co_changes=co)


_REPORT = """verdict string, changedFiles array<string>, changedSymbols array<struct<id: string>>, impactedContracts array<struct<statement: string>>, impactedInvariants array<struct<statement: string>>,
 recommendedTests array<struct<name: string>>, contradictions array<struct<statement: string>>, unknowns array<string>, findings array<struct<rule: string, nodeIds: array<string>, locations: array<struct<file: string, line: int>>>>,
 impactedConsumers array<struct<consumers: array<struct<id: string>>>>, coChangedFiles array<struct<file: string, coChanged: array<struct<file: string, commits: long>>>>, summary struct<blockCount: long, warnCount: long>"""


def report_sections(spark: SparkSession, d: str) -> DataFrame:
    """What the reports hold, read back from their JSON: entries by part, and the sums within parts."""
    x = verify_report(spark, d).select("diff_id", "verdict", F.from_json("report", _REPORT).alias("r"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    total = lambda c, f: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda t, v: t + f(v)), F.lit(0)).cast("long")
    return x.where("verdict = r.verdict").select(
        "diff_id", "verdict", n("r.changedFiles").alias("n_files"), F.element_at("r.changedFiles", 1).alias("first_file"), n("r.changedSymbols").alias("n_symbols"), n("r.impactedContracts").alias("n_contracts"), n("r.impactedInvariants").alias("n_invariants"),
        n("r.recommendedTests").alias("n_tests"), n("r.contradictions").alias("n_contradictions"), n("r.unknowns").alias("n_unknowns"), n("r.findings").alias("n_findings"), total("r.findings", lambda v: F.size(v["nodeIds"])).alias("n_named"),
        total("r.findings", lambda v: F.size(v["locations"])).alias("n_located"), total("r.impactedConsumers", lambda v: F.size(v["consumers"])).alias("n_consumers"),
        total("r.coChangedFiles", lambda v: F.aggregate(v["coChanged"], F.lit(0).cast("long"), lambda t, c: t + c["commits"])).alias("co_commits"), F.col("r.summary.blockCount").alias("n_block"), F.col("r.summary.warnCount").alias("n_warn"),
    )


def claims_seeded(spark: SparkSession, d: str) -> DataFrame:
    """Claims by all nine rules over the graph with what the tables lack."""
    n, e, _ = seeded(spark, d)
    return claim_rows(n, e).select("id", "kind", "statement", F.array_join(F.array_sort(F.array_distinct("subjects")), ",").alias("subjects"), "verification_status", F.array_join("tags", ",").alias("tags"))


def verify_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Findings as one-line annotations, their properties and texts escaped."""
    n, _, _, a = _analyzed(spark, d)
    x = _locations(n, a["met"]).groupBy("diff_id", "condition").agg(F.min(F.struct("id", "file_path", "start_line")).alias("at"))
    f = a["findings"].join(x, ["diff_id", "condition"])
    text = F.replace(F.replace(F.replace("message", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    prop = lambda c: F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))
    level = F.when(F.col("severity") == "block", "error").otherwise("warning")
    line = F.coalesce(F.concat(F.lit(",line="), F.col("at.start_line").cast("string")), F.lit(""))
    return f.select("diff_id", F.concat(F.lit("::"), level, F.lit(" file="), F.coalesce(prop(F.col("at.file_path")), F.lit("")), line, F.lit("::"), text).alias("annotation"))


_ALL = f"WITH {GRAPH},{HUNKS},{RANGES},{IMPACT},{FINDINGS}"
_IMP = f"WITH {GRAPH},{HUNKS},{RANGES},{IMPACT}"
_G = f"WITH {GRAPH}"
_LOC = "loc AS (SELECT diff_id, condition, met.id, n.file_path, nr.start_line FROM met JOIN n ON n.id = met.id JOIN nr ON nr.id = met.id)"
_ESC = "replace(replace(replace({0}, '%', '%25'), ':', '%3A'), ',', '%2C')"

SQL = {
    "diff_hunks": f"WITH {HUNKS} SELECT diff_id, file_path, hunk_no, old_start, old_lines, new_start, new_lines FROM h",
    "node_line_range": f"WITH {GRAPH},{RANGES} SELECT id, start_line, CASE WHEN start_line IS NOT NULL THEN coalesce(end_line, start_line) END AS end_line FROM nr",
    "impact_candidates": f"{_IMP} SELECT diff_id, id, kind FROM cand",
    "impacted_nodes": f"{_IMP} SELECT diff_id, id FROM imp",
    "impacted_claims": f"{_IMP}, {NINE_CLAIMS} SELECT DISTINCT diff_id, {CLAIM_ID} AS claim_id FROM imp JOIN (SELECT *, unnest(subj) id FROM c) USING (id)",
    "impacted_claim_keys": f"{_IMP} SELECT DISTINCT diff_id, 'contract' AS kind, id AS subject FROM imp JOIN n USING (id) WHERE kind IN ('interface', 'type') AND exported "
    "UNION SELECT diff_id, 'invariant', e.to_id FROM imp JOIN e ON e.from_id = imp.id AND e.kind = 'constrained_by' JOIN n i ON i.id = e.to_id AND i.kind = 'invariant'",
    "recommended_tests": f"{_IMP} SELECT DISTINCT diff_id, t.id AS test_id FROM cand JOIN e ON e.from_id = cand.id AND e.kind = 'tested_by' JOIN n t ON t.id = e.to_id AND t.kind = 'test'",
    "untested_invariants": f"{_G} SELECT id, kind, name FROM n WHERE id IN (SELECT from_id FROM e WHERE kind = 'constrained_by') AND id NOT IN (SELECT from_id FROM e WHERE kind = 'tested_by')",
    "contract_surface": f"{_G} SELECT id, list_has_any(tags, ['critical', 'security']) AS critical FROM n WHERE kind IN ('interface', 'type') AND exported",
    "security_surface": f"{_ALL} SELECT id, tested FROM nb WHERE sec OR beside",
    "impacted_consumers": f"""{_IMP}, u AS (SELECT from_id c, to_id s FROM e WHERE kind = 'calls' UNION SELECT i.from_id, d.to_id FROM e d JOIN e i ON i.to_id = d.from_id AND i.kind = 'imports' WHERE d.kind = 'declares')
SELECT diff_id, s AS symbol_id, c AS consumer_id FROM imp JOIN n ON n.id = imp.id AND n.exported JOIN u ON u.s = imp.id JOIN n k ON k.id = u.c WHERE s <> c""",
    "verify_findings": f"{_ALL} SELECT * FROM f",
    "finding_summary": f"{_ALL} SELECT rule, severity, tier, count(*) AS n_findings, CAST(sum(n_nodes) AS BIGINT) AS n_nodes FROM f GROUP BY ALL",
    "verify_verdict": f"""{_ALL} SELECT diff_id, CASE WHEN count(*) FILTER (severity = 'block') > 0 THEN 'BLOCK' WHEN count(*) FILTER (severity = 'warn') > 0 THEN 'WARN' ELSE 'PASS' END AS verdict,
  count(*) FILTER (severity = 'block') AS n_block, count(*) FILTER (severity = 'warn') AS n_warn FROM (SELECT DISTINCT diff_id FROM h) LEFT JOIN f USING (diff_id) GROUP BY 1""",
    "finding_locations": f"{_ALL}, {_LOC} SELECT * FROM loc",
    "verify_seeded": f"WITH {SEEDED_GRAPH},{SEEDED_HUNKS},{RANGES},{IMPACT},{FINDINGS} SELECT * FROM f",
    "verify_exit_codes": f"""{_ALL} SELECT diff_id, CASE WHEN bool_or(severity = 'block') THEN 'BLOCK' WHEN bool_or(severity = 'warn') THEN 'WARN' ELSE 'PASS' END AS verdict, CASE WHEN count(severity) > 0 THEN 3 ELSE 0 END AS exit_code
 FROM (SELECT DISTINCT diff_id FROM h) LEFT JOIN f USING (diff_id) GROUP BY 1""",
    "verify_unknowns": f"{_ALL}, {UNKNOWNS} SELECT * FROM unk UNION ALL SELECT DISTINCT 'none:' || snapshot_id, 'No changes detected in the diff.' FROM snapshots",
    "claims_seeded": f"WITH {SEEDED_GRAPH}, {NINE_CLAIMS} SELECT {CLAIM_ID} AS id, kind, statement, array_to_string(list_sort(list_distinct(subj)), ',') AS subjects, st AS verification_status, array_to_string(tags, ',') AS tags FROM c",
    "report_sections": f"""{_ALL}, {UNKNOWNS}, {NINE_CLAIMS}, cl AS (SELECT DISTINCT diff_id, kind, statement, subj, st FROM imp JOIN (SELECT *, unnest(subj) id FROM c) USING (id)), {_LOC}, {DIFF_CO_CHANGE},
 us AS (SELECT from_id c, to_id s FROM e WHERE kind = 'calls' UNION SELECT i.from_id, d.to_id FROM e d JOIN e i ON i.to_id = d.from_id AND i.kind = 'imports' WHERE d.kind = 'declares'),
 p AS (SELECT diff_id, 'n_files' k, count(DISTINCT file_path) v FROM h GROUP BY 1 UNION ALL SELECT diff_id, 'n_symbols', count(*) FROM imp JOIN n USING (id) WHERE kind IN ('function', 'class', 'interface', 'type', 'enum') GROUP BY 1
  UNION ALL SELECT diff_id, 'n_contracts', count(*) FROM cl WHERE kind = 'contract' GROUP BY 1 UNION ALL SELECT diff_id, 'n_invariants', count(*) FROM cl WHERE kind = 'invariant' GROUP BY 1 UNION ALL SELECT diff_id, 'n_contradictions', count(*) FROM cl WHERE st IN ('deprecated', 'contradicted') GROUP BY 1
  UNION ALL SELECT diff_id, 'n_tests', count(DISTINCT t.id) FROM cand JOIN e ON e.from_id = cand.id AND e.kind = 'tested_by' JOIN n t ON t.id = e.to_id AND t.kind = 'test' GROUP BY 1 UNION ALL SELECT diff_id, 'n_unknowns', count(*) FROM unk GROUP BY 1
  UNION ALL SELECT diff_id, 'n_findings', count(*) FROM f GROUP BY 1 UNION ALL SELECT diff_id, 'n_named', count(*) FROM met GROUP BY 1 UNION ALL SELECT diff_id, 'n_located', count(*) FROM loc WHERE file_path IS NOT NULL GROUP BY 1
  UNION ALL SELECT diff_id, 'n_consumers', count(DISTINCT (s, c)) FROM imp JOIN n ON n.id = imp.id AND n.exported JOIN us ON us.s = imp.id JOIN n k ON k.id = us.c WHERE s <> c GROUP BY 1
  UNION ALL SELECT diff_id, 'co_commits', sum(commits) FROM dco GROUP BY 1 UNION ALL SELECT diff_id, 'n_block', count(*) FROM f WHERE severity = 'block' GROUP BY 1 UNION ALL SELECT diff_id, 'n_warn', count(*) FROM f WHERE severity = 'warn' GROUP BY 1)
SELECT diff_id, CASE WHEN max(v) FILTER (k = 'n_block') > 0 THEN 'BLOCK' WHEN max(v) FILTER (k = 'n_warn') > 0 THEN 'WARN' ELSE 'PASS' END AS verdict, (SELECT min(file_path) FROM h WHERE h.diff_id = p.diff_id) AS first_file, """
 + ", ".join(f"CAST(coalesce(max(v) FILTER (k = '{k}'), 0) AS BIGINT) AS {k}" for k in ("n_files", "n_symbols", "n_contracts", "n_invariants", "n_contradictions", "n_tests", "n_unknowns", "n_findings", "n_named", "n_located", "n_consumers", "co_commits", "n_block", "n_warn")) + " FROM p GROUP BY diff_id",
    "verify_annotations": f"""{_ALL}, {_LOC}, a AS (SELECT diff_id, condition, min(struct_pack(i := id, f := file_path, l := start_line)) p FROM loc GROUP BY 1, 2)
SELECT diff_id, concat('::', CASE WHEN severity = 'block' THEN 'error' ELSE 'warning' END, ' file=', coalesce({_ESC.format('p.f')}, ''), CASE WHEN p.l IS NULL THEN '' ELSE concat(',line=', p.l) END, '::', replace(message, '%', '%25')) AS annotation FROM f JOIN a USING (diff_id, condition)""",
}
QUERIES = {q.__name__: q for q in (
    verify_verdict, diff_hunks, node_line_range, impact_candidates, impacted_nodes, impacted_claims, impacted_claim_keys, recommended_tests, untested_invariants, contract_surface, security_surface,
    impacted_consumers, verify_findings, verify_seeded, finding_summary, finding_locations, verify_exit_codes, verify_unknowns, verify_annotations, verify_report, report_sections, claims_seeded,
)}
