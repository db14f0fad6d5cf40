"""Indexing, byte-exact hunks, context packs and input parsers over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators import context, impact, observed
from ripplegraph.operators.claims import claims_by_status
from ripplegraph.operators.graph import evidence_records, merge_edges, merge_nodes
from ripplegraph.operators.typescript import extract_files, index_repository
from ripplegraph.plans.graph_queries import CLAIMS, STATUS, STOP, oriented_sql
from ripplegraph.plans.graph_sql import CLAIM_ID, GRAPH, HUNKS, PATH
from ripplegraph.plans.impact_queries import graph
from ripplegraph.runtime import checkpoint_dir, read
from ripplegraph.sources.files import MODE_WORDS, detect_mode, parse_candidates, parse_tasks
from ripplegraph.sources.store import Store


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of one repository: doc comments as sources, records and runbooks as documents."""
    x = read(spark, d, "documents").where("text is not null").withColumn("s", F.lower(F.trim("source")))
    ext = F.when(F.col("s") == "docstring", ".ts").when(F.col("s").isin("adr", "runbook", "changelog"), ".md").otherwise(".txt")
    return x.select(F.concat(F.lit("src/"), F.coalesce("s", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), ext).alias("rel_path"), F.col("text").alias("content"))


def ts_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols declared in doc comment texts."""
    x = extract_files(_files(spark, d).where("rel_path like '%.ts'"))
    return x.select("rel_path", F.explode("symbols").alias("s")).select("rel_path", "s.name", "s.kind", "s.start_line", "s.end_line", "s.exported")


def repository_index(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges by kind of the graph indexed from all documents."""
    n, e = index_repository(_files(spark, d), "documents")
    of = lambda df, what: df.groupBy(F.lit(what).alias("what"), "kind").agg(F.count("*").alias("n"))
    return of(merge_nodes(n), "node").unionByName(of(merge_edges(e), "edge"))


def patches(spark: SparkSession, d: str) -> DataFrame:
    """Patches written from the hunk table, one a file of a diff; some with a line of no hunk."""
    h = impact.current_hunks(read(spark, d, "hunks")).where("old_start is not null and new_start is not null")
    num = lambda c: F.col(c).cast("string")
    body = F.concat(F.when(F.col("hunk_no") == 7, "?bad\n").otherwise(""), F.repeat(F.lit("-old\n"), F.col("old_lines")), F.repeat(F.lit("+new\n"), F.col("new_lines")))
    h = h.withColumn("t", F.concat(F.lit("@@ -"), num("old_start"), F.lit(","), num("old_lines"), F.lit(" +"), num("new_start"), F.lit(","), num("new_lines"), F.lit(" @@\n"), body))
    f = h.groupBy("diff_id", "file_path").agg(F.array_join(F.sort_array(F.collect_list("t")), "").alias("t"))
    f = f.withColumn("t", F.concat(F.lit("diff --git a/x b/x\nindex 00000..abc\n--- a/"), "file_path", F.lit("\n+++ b/"), "file_path", F.lit("\n"), "t"))
    return f.groupBy(F.concat_ws("|", "diff_id", "file_path").alias("patch_id")).agg(F.max("t").cast("binary").alias("data"))


def observed_hunks(spark: SparkSession, d: str) -> DataFrame:
    """Byte-exact hunks of patches built from the hunk table, per patch; those with a line of no hunk are refused whole."""
    h = observed.observed_hunks(patches(spark, d))
    g = h.groupBy("patch_id").agg(F.count("path").alias("n_hunks"), F.coalesce(F.sum(F.length("raw")), F.lit(0)).alias("n_bytes"), F.max(F.col("error").isNotNull()).alias("refused"))
    return g


def _packs(spark: SparkSession, d: str, part: str) -> DataFrame:
    """One part of the packs of the tasks that every twentieth document makes, some of which name a capability that is there and one that is not."""
    n, e = graph(spark, d, keep=True)
    docs = read(spark, d, "documents").where("doc_id % 20 = 0 and text is not null")
    cap = e.where("kind = 'implements_capability'").agg(F.regexp_replace(F.min("to_id"), "^cap:", "").alias("c")).scalar()
    named = F.when(F.col("doc_id") % 40 == 0, F.array(cap, F.lit("no such thing"))).otherwise(F.array().cast("array<string>"))
    tasks = docs.select(F.col("doc_id").cast("string").alias("task_id"), "text", F.lit("business_rule").alias("question"), F.lit("bugfix").alias("mode"), named.alias("capabilities"))
    return context.context_packs(tasks, n, e, claims_by_status(n, e), only={part})[part]


def context_reads(spark: SparkSession, d: str) -> DataFrame:
    """What to read for each task."""
    return _packs(spark, d, "reads").select("task_id", "file_path", "priority", "id")


def context_primary(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that each task is about, and how far from its entry points."""
    return _packs(spark, d, "primary").select("task_id", "id", "hop")


def context_secondary(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of what else each task reaches."""
    return _packs(spark, d, "secondary").select("task_id", "id", "hop")


def context_unknowns(spark: SparkSession, d: str) -> DataFrame:
    """What each pack leaves open."""
    return _packs(spark, d, "unknowns")


def candidate_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Search results in three JSON forms, and the nodes of the files they name."""
    n, _ = graph(spark, d)
    p = read(spark, d, "hunks").select("file_path").where("file_path is not null").distinct()
    k = F.pmod(F.length("file_path"), F.lit(3))
    one = lambda **fields: F.to_json(F.struct(*(v.alias(c) for c, v in fields.items())))
    path, other = F.col("file_path"), F.lit("elsewhere.ts")
    text = F.when(k == 0, F.concat(F.lit("["), one(path=other, filePath=path, score=F.lit(0.9)), F.lit("]"))).when(k == 1, F.concat(F.lit('{"results": ['), one(file=path, path=other), F.lit("]}")))
    text = text.otherwise(F.concat(F.lit("searching...\n"), one(path=path, relevance=F.lit(0.25), startLine=F.lit(7))))
    c = parse_candidates(p.select(F.col("file_path").alias("query_id"), text.alias("text")))
    return c.join(n.select("file_path", F.col("id").alias("node_id")), "file_path").groupBy("file_path", "score").agg(F.count_distinct("node_id").alias("n_nodes"))


def _store(spark: SparkSession, d: str) -> Store:
    """A store of all deliveries of nodes, edges and evidence, written in two versions, the second keeping what it is not given."""
    store = Store(spark, f"{checkpoint_dir(spark)}/stores/{uuid.uuid4().hex}")
    when = lambda *cs: F.struct("delivered_at", *cs)
    n, e = read(spark, d, "nodes").where("id is not null"), read(spark, d, "edges").where("id is not null")
    ev = read(spark, d, "evidence").where("id is not null").withColumn("seq", F.struct("recorded_at", "file_path", "start_line", "end_line", "excerpt"))
    frames = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("payload"), F.col("written_at").cast("string").alias("created_at"))
    store.replace(nodes=n.withColumn("seq", when("snapshot_id", "name", "kind", "file_path")), evidence=ev, task_frames=frames)
    store.replace(edges=e.withColumn("seq", when("snapshot_id", "kind", "from_id", "to_id")))
    return store


def store_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a store's tables by kind, as read back; of several rows of an id the last counts."""
    s = _store(spark, d)
    of = lambda t, kind: s.load(t).groupBy(F.lit(t).alias("tbl"), kind.alias("kind")).agg(F.count("*").alias("n"))
    kind = F.coalesce("kind", F.lit(""))
    return of("nodes", kind).unionByName(of("edges", kind)).unionByName(of("evidence", F.coalesce("source_kind", F.lit("")))).unionByName(of("task_frames", F.lit("")))


def store_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The newest task frames of a store, and one row looked up by its key."""
    s = _store(spark, d)
    newest = s.task_frames().limit(10).select(F.lit("newest").alias("what"), "id")
    return newest.unionByName(s.get("task_frames", "20").select(F.lit("asked").alias("what"), "id"))


def evidence_first(spark: SparkSession, d: str) -> DataFrame:
    """All evidence that nodes give, one row an id, the excerpt of the first."""
    n = read(spark, d, "nodes").where("evidence is not null")
    x = evidence_records(n.select("evidence", F.struct("delivered_at", "snapshot_id", "id", "name").alias("seq")))
    return x.select("id", F.coalesce("excerpt", F.lit("-")).alias("excerpt"))


def task_parse(spark: SparkSession, d: str) -> DataFrame:
    """Labelled lines of task texts built from customers."""
    t = read(spark, d, "customer").select(F.col("c_custkey").alias("task_id"), F.concat(F.lit("Work\n - Mode: bugfix\n> Capabilities: seg-"), "c_mktsegment", F.lit(", "), "c_name", F.lit("\nNon-Goal: x\nExpected: all, of it\nnothing here")).alias("text"))
    return parse_tasks(t).select("task_id", "field", "pos", "value")


def task_modes(spark: SparkSession, d: str) -> DataFrame:
    """The mode that each document's words would give a task."""
    return read(spark, d, "documents").where("text is not null").select("doc_id", detect_mode(F.col("text")).alias("mode"))


_CODE = "('module', 'function', 'class', 'interface', 'type', 'enum')"
_PACK = f"""{CLAIMS.replace('WITH', 'WITH RECURSIVE', 1)}, {oriented_sql(tuple(context.REACHING))}, cap AS (SELECT min(to_id) c FROM e WHERE kind = 'implements_capability'),
tk AS (SELECT CAST(doc_id AS VARCHAR) task_id, text, doc_id % 40 = 0 named FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL),
mk AS (SELECT DISTINCT task_id, e.from_id id FROM tk JOIN e ON e.kind = 'implements_capability' AND e.to_id = (SELECT c FROM cap) JOIN n ON n.id = e.from_id WHERE named),
wd AS (SELECT DISTINCT task_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) w FROM tk WHERE task_id NOT IN (SELECT task_id FROM mk)), wk AS (SELECT * FROM wd WHERE length(w) >= 4 AND w NOT IN {STOP}),
hit AS (SELECT w, id FROM (SELECT DISTINCT w FROM wk) JOIN n ON contains(lower(concat_ws(' ', name, coalesce(file_path, ''))), w) WHERE kind IN ('function', 'class', 'interface', 'type', 'enum')),
lx AS (SELECT task_id, id FROM (SELECT DISTINCT task_id, id FROM wk JOIN hit USING (w)) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY id) <= 25), en AS (SELECT * FROM mk UNION SELECT * FROM lx),
w AS (SELECT task_id, id, 0 hop FROM en UNION SELECT task_id, u.dst, hop + 1 FROM w JOIN u ON u.src = w.id JOIN n ON n.id = u.dst WHERE hop < {context.MAX_HOPS}), h AS (SELECT task_id, id, min(hop) hop FROM w GROUP BY 1, 2),
cs AS (SELECT rn, unnest(ds) s FROM q), cd AS (SELECT rn, bool_or(n.kind IN {_CODE}) code FROM cs JOIN n ON n.id = s GROUP BY 1), rh AS (SELECT task_id, rn, min(hop) hop FROM h JOIN cs ON cs.s = h.id GROUP BY 1, 2),
z AS (SELECT tk.task_id, q.rn, kind, st, statement, coalesce(code, false) OR hop IS NOT NULL OR tk.task_id NOT IN (SELECT task_id FROM en) own, {CLAIM_ID} id, 0.25 * CASE kind WHEN 'invariant' THEN 1.0 WHEN 'capability' THEN 0.925 ELSE 0.3 END + 0.25 * {STATUS.format(0.95, 0.85, 0.6, 0.4)} + 0.15 * CASE WHEN hop IS NOT NULL THEN 1.0 / (1 + hop) WHEN code THEN 0 ELSE 0.3 END + 0.2 * {STATUS.format(1.0, 0.85, 0.5, 0.3)} + 0.15 * {STATUS.format(0.9, 0.85, 0.7, 0.6)} score
  FROM tk CROSS JOIN q LEFT JOIN cd ON cd.rn = q.rn LEFT JOIN rh ON rh.task_id = tk.task_id AND rh.rn = q.rn WHERE NOT coalesce(code, false) OR hop IS NOT NULL OR tk.task_id NOT IN (SELECT task_id FROM en)),
chosen AS (SELECT * FROM z WHERE kind = 'invariant' UNION ALL SELECT * FROM (SELECT * FROM z WHERE kind <> 'invariant' QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY round(score, 9) DESC, id) <= 10)),
cl AS (SELECT DISTINCT from_id src, to_id dst FROM e WHERE kind = 'calls'), wp AS (SELECT DISTINCT id AS start, [id] p FROM en UNION ALL SELECT wp.start, list_append(wp.p, cl.dst) FROM wp JOIN cl ON cl.src = wp.p[-1] WHERE len(wp.p) < 6 AND NOT list_contains(wp.p, cl.dst)),
pp AS (SELECT * FROM wp WHERE len(p) > 1 AND (len(p) = 6 OR NOT EXISTS (SELECT 1 FROM cl WHERE cl.src = wp.p[-1] AND NOT list_contains(wp.p, cl.dst)))),
tp AS (SELECT * FROM (SELECT DISTINCT task_id, array_to_string(p, ',') path, p FROM en JOIN pp ON pp.start = en.id) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY len(p) DESC, path) <= 6),
sb AS (SELECT DISTINCT task_id, kind, s id FROM chosen JOIN cs USING (rn) WHERE s IN (SELECT id FROM n WHERE kind IN {_CODE})),
pr AS (SELECT task_id, id FROM en UNION SELECT task_id, id FROM (SELECT task_id, unnest(p) id FROM tp) WHERE id IN (SELECT id FROM n WHERE kind IN {_CODE}) UNION SELECT task_id, id FROM sb),
te AS (SELECT DISTINCT task_id, t.id FROM pr JOIN e ON e.kind = 'tested_by' AND e.from_id = pr.id JOIN n t ON t.id = e.to_id AND t.kind = 'test')"""
_MODES = " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {w!r})' for w in words)} THEN '{m}'" for m, words in MODE_WORDS)
SQL = {
    "context_reads": f"""{_PACK}, wa AS (SELECT task_id, id, 3 r, 0 s FROM en UNION ALL SELECT task_id, id, 3, 1 FROM sb WHERE kind = 'invariant' UNION ALL SELECT task_id, id, 2, 3 FROM te)
SELECT task_id, file_path, CASE r WHEN 3 THEN 'critical' ELSE 'high' END AS priority, id FROM wa JOIN n USING (id) WHERE file_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task_id, file_path ORDER BY r DESC, s, id) = 1""",
    "context_primary": f"{_PACK} SELECT task_id, id, CAST(coalesce(hop, 99) AS INTEGER) AS hop FROM pr JOIN n USING (id) LEFT JOIN h USING (task_id, id)",
    "context_secondary": f"""{_PACK} SELECT task_id, id, CAST(hop AS INTEGER) AS hop FROM h JOIN n USING (id) WHERE (task_id, id) NOT IN (SELECT (task_id, id) FROM pr) AND (task_id, id) NOT IN (SELECT (task_id, id) FROM te)
 AND NOT (kind = 'document' AND (list_contains(tags, 'deprecated') OR coalesce(metadata['deprecated'] = 'true', false))) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY hop, id) <= 15""",
    "context_unknowns": f"""{_PACK} SELECT DISTINCT task_id, concat('Invariant "', statement, '" is only inferred (no test proves it).') AS unknown FROM chosen WHERE kind = 'invariant' AND st = 'inferred' AND own
 UNION ALL SELECT task_id, 'Capability "no such thing" referenced by the task was not found in the graph.' FROM tk WHERE named
 UNION ALL SELECT task_id, concat('Hypothesis not yet verified: The change primarily affects the "', regexp_replace(c, '^cap:', ''), '" capability.') FROM tk, cap WHERE named""",
    "observed_hunks": rf"""WITH {HUNKS}, g AS (SELECT concat_ws('|', diff_id, file_path) AS patch_id, bool_or(hunk_no = 7 AND old_lines + new_lines > 0) bad, count(*) k, sum(length(concat('@@ -', old_start, ',', old_lines, ' +', new_start, ',', new_lines, ' @@')) + 1 + 5 * (old_lines + new_lines)) b FROM h WHERE old_start IS NOT NULL AND new_start IS NOT NULL GROUP BY 1)
SELECT patch_id, CASE WHEN bad THEN 0 ELSE k END AS n_hunks, CAST(CASE WHEN bad THEN 0 ELSE b END AS BIGINT) AS n_bytes, bad AS refused FROM g""",
    "candidate_nodes": rf"""WITH {GRAPH}, p AS (SELECT DISTINCT file_path f FROM hunks WHERE file_path IS NOT NULL), c AS (SELECT {PATH.format('f')} file_path, CASE length(f) % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 ELSE 0.25 END score FROM p)
SELECT c.file_path AS file_path, CAST(score AS DOUBLE) AS score, count(DISTINCT n.id) AS n_nodes FROM c JOIN n ON n.file_path = c.file_path GROUP BY 1, 2""",
    "store_tables": """SELECT 'nodes' AS tbl, coalesce(k, '') AS kind, count(*) AS n FROM (SELECT arg_max(nodes, struct_pack(a := delivered_at, b := snapshot_id, c := name, d := kind, e := file_path)).kind k FROM nodes WHERE id IS NOT NULL GROUP BY id) GROUP BY 2
 UNION ALL SELECT 'edges', coalesce(k, ''), count(*) FROM (SELECT arg_max(edges, struct_pack(a := delivered_at, b := snapshot_id, c := kind, d := from_id, e := to_id)).kind k FROM edges WHERE id IS NOT NULL GROUP BY id) GROUP BY 2
 UNION ALL SELECT 'evidence', coalesce(k, ''), count(*) FROM (SELECT arg_max(evidence, struct_pack(a := recorded_at, b := file_path, c := start_line, d := end_line, e := excerpt)).source_kind k FROM evidence WHERE id IS NOT NULL GROUP BY id) GROUP BY 2 UNION ALL SELECT 'task_frames', '', count(*) FROM documents""",
    "store_lookup": "SELECT 'newest' AS what, id FROM (SELECT CAST(doc_id AS VARCHAR) id, written_at FROM documents ORDER BY written_at DESC NULLS LAST, 1 LIMIT 10) UNION ALL SELECT 'asked', '20' FROM documents WHERE doc_id = 20",
    "evidence_first": f"""SELECT concat('ev:', coalesce(r.source_kind, ''), ':', coalesce({PATH.format('r.file_path')}, ''), ':', coalesce(r.start_line, 0), ':', coalesce(r.end_line, 0)) AS id, coalesce(arg_min_null(r.excerpt, struct_pack(a := delivered_at, b := snapshot_id, c := nid, d := name, e := p)), '-') AS excerpt
 FROM (SELECT delivered_at, snapshot_id, id nid, name, unnest(evidence) r, generate_subscripts(evidence, 1) p FROM nodes WHERE evidence IS NOT NULL) GROUP BY 1""",
    "task_parse": """SELECT c_custkey AS task_id, 'mode' AS field, 0 AS pos, 'bugfix' AS value FROM customer UNION ALL SELECT c_custkey, 'capabilities', 0, 'seg-' || c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'capabilities', 1, c_name FROM customer
 UNION ALL SELECT c_custkey, 'non_goals', 0, 'x' FROM customer UNION ALL SELECT c_custkey, 'expected_behavior', 0, 'all, of it' FROM customer""",
    "task_modes": f"SELECT doc_id, CASE {_MODES} ELSE 'feature' END AS mode FROM documents WHERE text IS NOT NULL",
}
QUERIES = {q.__name__: q for q in (ts_symbols, repository_index, observed_hunks, context_reads, context_primary, context_secondary, context_unknowns, store_tables, store_lookup, evidence_first, candidate_nodes, task_parse, task_modes)}
