"""Authored intent over texts written from the links table: parse, resolve, check, slice, verify."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions.ids import LINK_KINDS, SEMANTIC_KINDS
from ripplegraph.operators import authored, impact
from ripplegraph.operators.claims import claim_rows
from ripplegraph.operators.control import verification_baseline
from ripplegraph.plans.graph_sql import CLAIM_ID, FINDINGS, GRAPH, HUNKS, IMPACT, NINE_CLAIMS, PATH, RANGES
from ripplegraph.plans.impact_queries import graph
from ripplegraph.runtime import checkpointed, read

#: One block per authored owner of a repository, in SQL that both engines read alike.
OWNERS = """
SELECT *, CASE WHEN kind = 'change' THEN 'active' WHEN length(id) % 4 = 0 THEN 'tested' WHEN length(id) % 4 = 1 THEN 'declared' WHEN length(id) % 4 = 2 THEN 'contradicted' ELSE 'bogus' END AS status,
  max(CASE WHEN kind = 'change' THEN nxt END) OVER (PARTITION BY repo) AS kept FROM (SELECT *, lead(id) OVER (PARTITION BY repo ORDER BY id) AS nxt FROM (SELECT DISTINCT split_part(owner_id, '.', 1) AS repo, split_part(owner_id, '.', 2) AS kind, concat(split_part(owner_id, '.', 2), '.', split_part(owner_id, '.', 3)) AS id FROM sem_links WHERE owner_id IS NOT NULL) i) o
"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    links = read(spark, d, "sem_links")
    o = spark.sql(OWNERS.replace("FROM sem_links", "FROM {links}"), links=links)
    line = lambda k, v: F.concat(F.lit(f"\n  {k}: "), v)
    own = links.where("owner_id is not null and ref is not null").select(F.substring_index("owner_id", ".", 1).alias("repo"), F.regexp_replace("owner_id", r"^[^.]*\.", "").alias("id"), F.when(F.col("kind") == "file", line("file", F.col("ref"))).otherwise(line("link", F.col("ref"))).alias("l"))
    own = own.groupBy("repo", "id").agg(F.array_join(F.sort_array(F.collect_set("l")), "").alias("links"))
    x = o.join(own, ["repo", "id"], "left")
    relation = F.when(F.col("kind") == "change", F.concat(F.lit("\n  preserves:\n    - "), "nxt", F.lit("\n  requires: [proof.missing, "), "nxt", F.lit("]\n  unknown: unknown.open"))).when(F.col("kind") == "decision", F.concat(line("justifies", F.col("nxt")), F.coalesce(line("justifies", F.col("kept")), F.lit("")))).otherwise(line("serves", F.col("nxt")))
    tag = F.when(F.length("id") % 5 == 0, "\n  tag: critical").otherwise("")
    block = F.concat("kind", F.lit(" "), "id", F.lit("\n  # note"), line("statement", F.concat(F.lit("Says [a, b] of "), "id")), line("status", F.col("status")), tag, F.coalesce(relation, F.lit("")), F.coalesce("links", F.lit("")), F.lit("\n  colour: red\n"))
    return x.groupBy(F.col("repo").alias("file")).agg(F.array_join(F.sort_array(F.collect_list(block)), "\n").alias("text"))


def _model(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return authored.model(checkpointed(authored.parse_blocks(_texts(spark, d))))


def sem_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Blocks read back from text, defaults where a status is unknown."""
    m = _model(spark, d)
    return m["nodes"].unionByName(m["changes"]).select("file", "id", "kind", "statement", "status", "provenance", F.array_join("tags", ",").alias("tags"))


def sem_references(spark: SparkSession, d: str) -> DataFrame:
    """Relations of nodes and references of changes read back from text."""
    m = _model(spark, d)
    r = m["relations"].select(F.col("from_id").alias("id"), F.col("kind").alias("field"), F.col("to_id").alias("ref"))
    return r.unionByName(m["change_refs"].select(F.col("change_id").alias("id"), "field", "ref")).distinct()


def sem_repository_links(spark: SparkSession, d: str) -> DataFrame:
    """Links read back from text."""
    return _model(spark, d)["links"]


def sem_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the texts, by level and message."""
    return _model(spark, d)["diagnostics"].groupBy("file", "level", "message").agg(F.count("*").alias("n"))


def sem_document_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Rows parsed from the authored blocks among the documents, whatever their language."""
    docs = read(spark, d, "documents").where(F.lower(F.trim("source")) == "sem_block")
    rows = authored.parse_blocks(docs.select(F.col("doc_id").alias("file"), "text"))
    return rows.groupBy("file", "row").agg(F.count("*").alias("n"))


def sem_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose canonical text is the same after it is read and written again."""
    m = _model(spark, d)
    first = authored.format_blocks(m)
    whole = checkpointed(first.withColumn("file", F.col("id")))
    again = authored.format_blocks(authored.model(checkpointed(authored.parse_blocks(whole.select("file", "text").distinct()))))
    return first.distinct().join(again.distinct().toDF("id", "again"), "id").select("id", (F.col("text") == F.col("again")).alias("same")).distinct()


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids declared in several files: every second text is given twice, under another name."""
    t = _texts(spark, d)
    again = t.where(F.length("file") % 2 == 0).withColumn("file", F.concat(F.lit("copy of "), "file"))
    return authored.duplicate_ids(authored.model(checkpointed(authored.parse_blocks(t.unionByName(again)))))


def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    """References to ids that no text declares."""
    return authored.dangling_references(_model(spark, d))


def _resolved(spark: SparkSession, d: str, links: DataFrame) -> DataFrame:
    n, e = graph(spark, d, keep=True)
    return authored.resolve_links(links, n, claim_rows(n, e), read(spark, d, "evidence"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "sem_links").where("ref is not null and owner_id is not null")
    return x.select("owner_id", "kind", F.when(F.col("kind") == "file", authored.link_of(F.regexp_replace(F.replace("ref", F.lit("\\"), F.lit("/")), r"^\./", ""))[1]).otherwise(F.col("ref")).alias("ref")).distinct()


def link_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Authored links resolved against the current graph, with reasons where they fail."""
    x = _resolved(spark, d, _links(spark, d))
    return x.select("owner_id", "kind", "ref", "resolved", "n_targets", F.coalesce("reason", F.lit("")).alias("reason"))


def stale_links(spark: SparkSession, d: str) -> DataFrame:
    """Owners with links that no longer resolve."""
    return _resolved(spark, d, _links(spark, d)).where("not resolved").groupBy("owner_id").agg(F.count("*").alias("n_stale"))


def incoming_references(spark: SparkSession, d: str) -> DataFrame:
    """How many references name each authored id, by field."""
    return sem_references(spark, d).groupBy("ref", "field").agg(F.count("*").alias("n"))


def invariant_footprint(spark: SparkSession, d: str) -> DataFrame:
    """Graph nodes each authored owner stands on, directly or through what they constrain."""
    return authored.footprints(_links(spark, d), *graph(spark, d))


def superseded_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Contradicted or stale decisions that justify what a change preserves."""
    m = _model(spark, d)
    return authored.superseded_decisions(m, m["change_refs"].where("field = 'preserves'").select("change_id", "ref"))


def check_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Everything a check of the texts finds, in order of precedence."""
    m = _model(spark, d)
    return authored.check_model(m, _resolved(spark, d, m["links"]))


def model_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two sources of links merged by owner, the later source winning."""
    x = _links(spark, d).groupBy("owner_id").agg(F.min("ref").alias("lo"), F.max("ref").alias("hi"))
    a = x.select(F.col("owner_id").alias("id"), F.lit(0).alias("ord"), F.col("lo").alias("ref"))
    b = x.where(F.length("owner_id") % 2 == 0).select(F.col("owner_id").alias("id"), F.lit(1).alias("ord"), F.col("hi").alias("ref"))
    return authored.merge_models(a.unionByName(b))


def semantic_slice(spark: SparkSession, d: str) -> DataFrame:
    """What each change reaches over relations, at most 60 ids."""
    m = _model(spark, d)
    s = m["changes"].select(F.col("id").alias("seed_set"), "id").distinct()
    return authored.slice_model(m, s)


def slice_parts(spark: SparkSession, d: str) -> DataFrame:
    """What the slices hold, by part, with their links and the proofs still needed."""
    m = _model(spark, d)
    s = checkpointed(authored.slice_model(m, m["changes"].select(F.col("id").alias("seed_set"), "id").distinct()))
    return authored.slice_parts(m, s)


def lifecycle_findings(spark: SparkSession, d: str) -> DataFrame:
    """Pointers to active changes and baselines made up for each repository, checked against its changes."""
    c = _model(spark, d)["changes"].select(F.col("file").alias("repo"), "id", F.when(F.length("id") % 6 == 0, "verified").otherwise(F.col("status")).alias("status"), F.col("statement").alias("content"))
    first = c.groupBy("repo").agg(F.min("id").alias("change_id"), F.min_by("content", "id").alias("content"))
    k = F.length("repo") % 5
    pointers = first.where(k != 4).select("repo", F.when(k == 3, "invalid").otherwise("valid").alias("state"), F.when(k == 2, "change.gone").otherwise(F.col("change_id")).alias("change_id"), F.when(k == 1, "other").otherwise(F.col("content")).alias("content"))
    head, state = F.repeat(F.lit("a"), F.lit(40)), F.concat(F.lit("sha256:"), F.repeat(F.lit("b"), F.lit(64)))
    text = F.to_json(F.struct(F.lit(2).alias("version"), head.alias("headCommit"), F.when(k == 1, "broken").otherwise(state).alias("workingStateHash"), F.lit("PASS").alias("verdict"), F.lit("2024-01-01T00:00:00Z").alias("recordedAt")))
    now = first.select("repo", F.when(k != 0, text).alias("recorded"), head.alias("head"), F.when(k == 2, "sha256:moved").otherwise(state).alias("state_hash"))
    return authored.lifecycle_findings(c, pointers, verification_baseline(now)).select("repo", "reason", F.coalesce("subject", F.lit("")).alias("subject"))


def _change_findings(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    m = _model(spark, d)
    (n, e), h = graph(spark, d, keep=True), checkpointed(impact.current_hunks(read(spark, d, "hunks")))
    x = impact.analyze(n, e, h)
    rank = F.when(F.col("severity") == "block", 2).otherwise(1)
    worst = x["met"].join(x["findings"].select("diff_id", "condition", rank.alias("rank")), ["diff_id", "condition"]).groupBy("id").agg(F.max("rank").alias("rank"))
    touched = x["impacted"].select("id").distinct().join(worst, "id", "left").withColumn("severity", F.when(F.col("rank") == 2, "block").when(F.col("rank") == 1, "warn").otherwise("none"))
    at = n.select("id", F.substring_index("repo", ":", -1).alias("file"))
    own = m["changes"].select(F.col("id").alias("change_id"), "file").distinct()
    touched = touched.join(at, "id").join(own, "file").select("change_id", "id", "severity").distinct()
    files = h.select("diff_id", F.substring_index("file_path", "/", 1).alias("file")).distinct()
    per = files.join(x["verdicts"], "diff_id").groupBy("file").agg(authored.worst_verdict().alias("verdict"))
    under = own.join(per, "file").groupBy("change_id").agg(authored.worst_verdict().alias("verdict"))
    resolved = authored.resolve_links(m["links"], n, claim_rows(n, e), read(spark, d, "evidence"))
    return m, authored.change_findings(m, touched, authored.footprints(m["links"], n, e), resolved, under)


def change_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The composed verdict of every change, each with the diffs of its repository as underlying."""
    m, found = _change_findings(spark, d)
    return authored.change_verdicts(m["changes"], found)


def change_findings(spark: SparkSession, d: str) -> DataFrame:
    """What stands between each change and a verified verdict, in order, and how the run would end."""
    found = authored.in_order(_change_findings(spark, d)[1])
    return found.select("change_id", "pos", "kind", "severity", "ref")


_O = f"WITH o AS ({OWNERS})"
REFS = """r AS (SELECT id, CASE kind WHEN 'decision' THEN 'justifies' ELSE 'serves' END AS field, nxt AS ref FROM o WHERE kind <> 'change' AND nxt IS NOT NULL UNION SELECT id, 'justifies', kept FROM o WHERE kind = 'decision' AND nxt IS NOT NULL AND kept IS NOT NULL
 UNION SELECT id, 'preserves', nxt FROM o WHERE kind = 'change' AND nxt IS NOT NULL UNION SELECT id, 'requires_evidence', unnest(['proof.missing', nxt]) FROM o WHERE kind = 'change' AND nxt IS NOT NULL
 UNION SELECT id, 'unknown', 'unknown.open' FROM o WHERE kind = 'change' AND nxt IS NOT NULL)"""
_SL = f"sl AS (SELECT DISTINCT owner_id, kind, CASE WHEN kind = 'file' THEN {PATH.format('ref')} ELSE ref END AS ref FROM sem_links WHERE ref IS NOT NULL AND owner_id IS NOT NULL)"
_RES = f"""{_SL}, x AS (SELECT *, CASE kind WHEN 'file' THEN (SELECT count(*) FROM n WHERE file_path = sl.ref) WHEN 'evidence' THEN (SELECT count(DISTINCT id) FROM evidence WHERE id = sl.ref) ELSE (SELECT count(*) FROM n WHERE id = sl.ref) END AS n_targets FROM sl)"""
_LINK = "CASE " + " ".join(f"WHEN starts_with(ref, '{p}') THEN '{k}'" for p, k in LINK_KINDS.items()) + " ELSE 'file' END"
LINKS = f"SELECT DISTINCT regexp_replace(owner_id, '^[^.]*\\.', '') AS owner_id, CASE WHEN kind = 'file' THEN 'file' ELSE {_LINK} END AS kind, trim(ref) AS ref FROM sem_links WHERE owner_id IS NOT NULL AND ref IS NOT NULL"
_CHANGE = f"""WITH {GRAPH},{HUNKS},{RANGES},{IMPACT},{FINDINGS}, {NINE_CLAIMS}, o AS ({OWNERS}), {REFS},
lks AS ({LINKS}),
ch AS (SELECT id, repo FROM o WHERE kind = 'change'), fi AS (SELECT met.id, min(severity) s FROM met JOIN f USING (diff_id, condition) GROUP BY 1),
tc AS (SELECT DISTINCT ch.id change_id, imp.id, fi.s FROM imp JOIN n USING (id) JOIN ch ON ch.repo = regexp_replace(n.repo, '^.*:', '') JOIN fi ON fi.id = imp.id),
vd AS (SELECT split_part(h.file_path, '/', 1) repo, max(CASE severity WHEN 'block' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) w FROM h LEFT JOIN f USING (diff_id) GROUP BY 1),
fp AS (SELECT owner_id, ref id FROM lks WHERE ref IN (SELECT id FROM n) UNION SELECT owner_id, e.from_id FROM lks JOIN e ON e.to_id = lks.ref AND e.kind = 'constrained_by' WHERE ref IN (SELECT id FROM n)),
hit AS (SELECT DISTINCT change_id, owner_id ref FROM tc JOIN fp ON fp.id = tc.id), oi AS (SELECT id ref, kind rk, CASE WHEN status = 'bogus' THEN 'declared' ELSE status END rs, length(id) % 5 = 0 crit FROM o WHERE kind <> 'change'),
rf AS (SELECT r.id change_id, r.field, r.ref, rk, rs, coalesce(crit, false) crit FROM r JOIN ch USING (id) LEFT JOIN oi ON oi.ref = r.ref),
gone AS (SELECT owner_id, ref FROM lks WHERE CASE kind WHEN 'file' THEN ref NOT IN (SELECT file_path FROM n WHERE file_path IS NOT NULL) WHEN 'claim' THEN ref NOT IN (SELECT {CLAIM_ID} FROM c) WHEN 'evidence' THEN ref NOT IN (SELECT id FROM evidence WHERE id IS NOT NULL) ELSE ref NOT IN (SELECT id FROM n) END),
cf AS (SELECT ch.id change_id, CASE w WHEN 2 THEN 'underlying_block' ELSE 'underlying_warn' END kind, CASE w WHEN 2 THEN 'block' ELSE 'warn' END severity, '' ref FROM ch JOIN vd USING (repo) WHERE w > 0
 UNION ALL SELECT change_id, 'dangling_reference', 'stale', ref FROM rf WHERE field = 'preserves' AND rk IS DISTINCT FROM 'invariant' UNION ALL SELECT change_id, 'invariant_contradicted', 'block', ref FROM rf WHERE field = 'preserves' AND rk = 'invariant' AND rs = 'contradicted'
 UNION ALL SELECT change_id, CASE WHEN crit THEN 'critical_invariant_unproven' ELSE 'invariant_unproven' END, CASE WHEN crit THEN 'block' ELSE 'warn' END, ref FROM rf JOIN hit USING (change_id, ref) WHERE field = 'preserves' AND rk = 'invariant' AND rs <> 'contradicted'
 UNION ALL (SELECT DISTINCT k.change_id, 'superseded_decision', 'warn', j.id FROM rf k JOIN r j ON j.field = 'justifies' AND j.ref = k.ref JOIN oi ON oi.ref = j.id AND oi.rk = 'decision' AND oi.rs IN ('contradicted', 'stale') WHERE k.field = 'preserves')
 UNION ALL SELECT change_id, CASE WHEN rk IS NULL THEN 'dangling_reference' ELSE 'required_evidence_pending' END, CASE WHEN rk IS NULL THEN 'stale' ELSE 'warn' END, ref FROM rf WHERE field = 'requires_evidence' AND (rk IS NULL OR rs NOT IN ('tested', 'statically_verified', 'runtime_verified'))
 UNION ALL SELECT change_id, CASE WHEN crit THEN 'critical_open_unknown' ELSE 'open_unknown' END, CASE WHEN crit THEN 'block' ELSE 'warn' END, ref FROM rf WHERE field = 'unknown'
 UNION ALL (SELECT DISTINCT change_id, 'stale_link', 'stale', gone.ref FROM (SELECT change_id, ref owner_id FROM rf UNION SELECT id, id FROM ch) JOIN gone USING (owner_id)))"""
SQL = {
    "change_verdict": f"""{_CHANGE} SELECT ch.id AS change_id, CASE WHEN bool_or(severity = 'block') THEN 'BLOCKED' WHEN bool_or(severity = 'stale') THEN 'STALE' WHEN bool_or(severity = 'warn') THEN 'PARTIAL' ELSE 'VERIFIED' END AS verdict, lower(verdict) AS lifecycle, count(severity) AS n_findings
 FROM (SELECT DISTINCT id FROM ch) ch LEFT JOIN cf ON cf.change_id = ch.id GROUP BY 1""",
    "change_findings": f"{_CHANGE} SELECT change_id, CAST(row_number() OVER (PARTITION BY change_id ORDER BY CASE severity WHEN 'block' THEN 0 WHEN 'stale' THEN 1 ELSE 2 END, kind, ref) AS INTEGER) AS pos, kind, severity, ref FROM cf",
    "slice_parts": f"""WITH RECURSIVE o AS ({OWNERS}), {REFS}, lks AS ({LINKS}), w AS (SELECT id AS seed_set, id, 0 hop FROM o WHERE kind = 'change' UNION SELECT seed_set, r.ref, hop + 1 FROM w JOIN r ON r.id = w.id WHERE hop < 400),
h AS (SELECT seed_set, id, min(hop) hop FROM w WHERE id IN (SELECT id FROM o) GROUP BY 1, 2), k AS (SELECT seed_set, o.* FROM h JOIN o USING (id) QUALIFY row_number() OVER (PARTITION BY seed_set ORDER BY hop, h.id) <= 60)
SELECT seed_set, CASE kind WHEN 'goal' THEN 'intentions' WHEN 'invariant' THEN 'invariants' WHEN 'decision' THEN 'decisions' WHEN 'assumption' THEN 'assumptions' WHEN 'change' THEN 'changes' WHEN 'evidence' THEN 'evidence' ELSE 'open_unknowns' END AS part, id AS ref FROM k
UNION SELECT seed_set, 'safety', id FROM k WHERE kind = 'invariant' AND length(id) % 5 = 0 UNION SELECT seed_set, 'links', lks.kind || ':' || lks.ref FROM k JOIN lks ON lks.owner_id = k.id
UNION SELECT seed_set, 'next_proofs', r.ref FROM k JOIN r ON r.id = k.id AND r.field = 'requires_evidence' WHERE k.kind = 'change' AND r.ref NOT IN (SELECT id FROM o WHERE kind <> 'change' AND status IN ('tested', 'statically_verified', 'runtime_verified'))""",
    "lifecycle_findings": f"""{_O}, c AS (SELECT repo, id, CASE WHEN length(id) % 6 = 0 THEN 'verified' ELSE 'active' END status FROM o WHERE kind = 'change'), f AS (SELECT repo, min(id) id, length(repo) % 5 k FROM c GROUP BY 1),
v AS (SELECT f.repo, k, CASE k WHEN 2 THEN 'change.gone' ELSE f.id END picked, c.status FROM f LEFT JOIN c ON c.repo = f.repo AND c.id = CASE k WHEN 2 THEN 'change.gone' ELSE f.id END WHERE k < 3)
SELECT repo, 'ACTIVE_CHANGE_POINTER_INVALID' AS reason, '' AS subject FROM f WHERE k = 3 UNION SELECT repo, 'ACTIVE_CHANGE_POINTER_INVALID', picked FROM v WHERE status IS NULL UNION SELECT c.repo, 'ACTIVE_CHANGE_POINTER_MISSING', c.id FROM c JOIN f USING (repo) WHERE k = 4 AND status = 'active'
UNION SELECT repo, 'ACTIVE_CHANGE_OBSOLETE', picked FROM v WHERE status = 'verified' UNION SELECT repo, 'ACTIVE_CHANGE_POINTER_MISMATCH', picked FROM v WHERE status = 'active' AND k = 1 UNION SELECT c.repo, 'ACTIVE_CHANGE_OBSOLETE', c.id FROM c JOIN v USING (repo) WHERE c.status = 'active' AND c.id <> picked
UNION SELECT repo, 'EVIDENCE_BASELINE_INVALID', '' FROM f WHERE k = 1 UNION SELECT repo, 'EVIDENCE_BASELINE_STALE', '' FROM f WHERE k = 2""",
    "sem_round_trip": f"{_O} SELECT DISTINCT id, true AS same FROM o",
    "check_reasons": f"""{_CHANGE}, x AS (SELECT 0 AS rank, 'SEMANTIC_DSL_INVALID' AS reason, count(*) AS n FROM o WHERE status = 'bogus' UNION ALL SELECT 1, 'DUPLICATE_SEMANTIC_ID', count(*) FROM (SELECT id FROM o GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT 2, 'INVALID_SEMANTIC_ID', count(DISTINCT (id, kind)) FROM o WHERE NOT regexp_full_match(regexp_replace(id, '^[a-z]+\\.', ''), '[a-z0-9]([a-z0-9.-]*[a-z0-9])?') OR kind NOT IN {SEMANTIC_KINDS}
 UNION ALL SELECT 3, 'DANGLING_SEMANTIC_REFERENCE', count(DISTINCT (id, field, ref)) FROM r WHERE ref NOT IN (SELECT id FROM o) UNION ALL SELECT 4, 'STALE_REPOSITORY_LINK', count(*) FROM gone) SELECT * FROM x WHERE n > 0""",
    "semantic_slice": f"""WITH RECURSIVE o AS ({OWNERS}), {REFS}, w AS (SELECT id AS seed_set, id, 0 hop FROM o WHERE kind = 'change' UNION SELECT seed_set, r.ref, hop + 1 FROM w JOIN r ON r.id = w.id WHERE hop < 400),
h AS (SELECT seed_set, id, min(hop) hop, id IN (SELECT id FROM o) known FROM w GROUP BY 1, 2), k AS (SELECT *, CASE WHEN known THEN row_number() OVER (PARTITION BY seed_set, known ORDER BY hop, id) END pos FROM h),
l AS (SELECT seed_set, hop, id FROM k WHERE pos = 60), t AS (SELECT DISTINCT k.seed_set FROM k JOIN l ON l.seed_set = k.seed_set AND (k.hop = l.hop AND k.id > l.id OR k.hop = l.hop + 1))
SELECT seed_set, id, CAST(hop AS INTEGER) AS hop, seed_set IN (FROM t) AS truncated FROM k WHERE pos <= 60""",
    "sem_nodes": f"{_O} SELECT repo AS file, id, kind, 'Says [a, b] of ' || id AS statement, CASE WHEN status = 'bogus' THEN 'declared' ELSE status END AS status, 'author' AS provenance, CASE WHEN length(id) % 5 = 0 THEN 'critical' ELSE '' END AS tags FROM o",
    "sem_references": f"{_O}, {REFS} SELECT * FROM r",
    "sem_repository_links": LINKS,
    "sem_diagnostics": f"""{_O} SELECT repo AS file, 'warning' AS level, 'unknown field "colour" (ignored)' AS message, count(*) AS n FROM o GROUP BY 1 UNION ALL SELECT repo, 'error', 'unknown status "bogus"', count(*) FROM o WHERE status = 'bogus' GROUP BY 1""",
    "duplicate_ids": f"{_O} SELECT id, sum(CASE WHEN length(repo) % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS n FROM o GROUP BY 1 HAVING n > 1",
    "dangling_refs": f"{_O}, {REFS} SELECT DISTINCT id AS owner_id, field, ref FROM r WHERE ref NOT IN (SELECT id FROM o)",
    "incoming_references": f"{_O}, {REFS} SELECT ref, field, count(*) AS n FROM r GROUP BY 1, 2",
    "link_resolution": f"""WITH {GRAPH}, {_RES} SELECT owner_id, kind, ref, n_targets > 0 AS resolved, n_targets, CASE WHEN n_targets > 0 THEN '' WHEN kind = 'file' THEN 'no indexed file matches this path' WHEN kind = 'evidence' THEN 'evidence id not found in the graph' ELSE kind || ' node id not found in the graph' END AS reason FROM x""",
    "stale_links": f"WITH {GRAPH}, {_RES} SELECT owner_id, count(*) AS n_stale FROM x WHERE n_targets = 0 GROUP BY 1",
    "invariant_footprint": f"WITH {GRAPH}, {_SL}, f AS (SELECT DISTINCT owner_id, ref AS id FROM sl WHERE ref IN (SELECT id FROM n)) SELECT owner_id, id FROM f UNION SELECT owner_id, e.from_id FROM f JOIN e ON e.to_id = f.id AND e.kind = 'constrained_by'",
    "superseded_decisions": f"{_O}, {REFS} SELECT DISTINCT c.id AS change_id, j.id AS decision_id FROM r c JOIN r j ON j.field = 'justifies' AND j.ref = c.ref JOIN o ON o.id = j.id AND o.kind = 'decision' AND o.status = 'contradicted' WHERE c.field = 'preserves'",
    "model_merge": f"WITH {_SL} SELECT owner_id AS id, CASE WHEN length(owner_id) % 2 = 0 THEN max(ref) ELSE min(ref) END AS ref FROM sl GROUP BY owner_id",
}
QUERIES = {q.__name__: q for q in (
    sem_nodes, sem_references, sem_repository_links, sem_diagnostics, sem_document_blocks, sem_round_trip, duplicate_ids, dangling_refs, incoming_references, link_resolution, stale_links, invariant_footprint,
    superseded_decisions, check_reasons, model_merge, semantic_slice, slice_parts, lifecycle_findings, change_verdict, change_findings,
)}
