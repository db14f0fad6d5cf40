"""Graph kernels, claims, co-change and retrieval over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions.scoring import POLICIES, by_status
from ripplegraph.operators import claims as cl
from ripplegraph.operators import cochange, retrieval
from ripplegraph.operators import graph as g
from ripplegraph.operators.context import MAX_HOPS
from ripplegraph.operators.context import REACHING as _REACHABILITY
from ripplegraph.plans.graph_sql import CLAIM_ID, DIFF_CO_CHANGE, GRAPH, NINE_CLAIMS, PATH, SEEDED_GRAPH
from ripplegraph.plans.impact_queries import graph, seeded
from ripplegraph.runtime import checkpointed, read

_G = f"WITH {GRAPH}"
_STRUCTURE = ["calls", "imports", "declares", "constrained_by"]
_KINDS = "('calls', 'imports', 'declares', 'constrained_by')"


def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of the current graph by kind."""
    n, e = graph(spark, d)
    of = lambda df, what: df.groupBy(F.lit(what).alias("what"), "kind").agg(F.count("*").alias("n"))
    return of(n, "node").unionByName(of(e, "edge"))


def neighbors(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes each node is joined to by calls, outwards, inwards and either way."""
    _, e = graph(spark, d)
    parts = [g.oriented(e, ["calls"], way).groupBy("src").agg(F.count("*").alias(way)) for way in ("out", "in", "both")]
    x = parts[0].join(parts[1], "src", "full").join(parts[2], "src", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return x.select(F.col("src").alias("id"), zero("out").alias("n_out"), zero("in").alias("n_in"), zero("both").alias("n_both"))


def _seeds(n: DataFrame) -> DataFrame:
    return n.where("kind = 'module'").groupBy(F.col("repo").alias("seed_set")).agg(F.min("id").alias("id"))


def bfs_distances(spark: SparkSession, d: str) -> DataFrame:
    """Hops from each repository's first module over structural edges, either way, at most 4."""
    n, e = graph(spark, d)
    return g.bfs(n, g.oriented(e, _STRUCTURE, "both"), _seeds(n), 4)


def reachable_out(spark: SparkSession, d: str) -> DataFrame:
    """What each repository's first module reaches over imports and calls, at most 8 hops."""
    n, e = graph(spark, d)
    return g.bfs(n, g.oriented(e, ["imports", "calls", "declares"], "out"), _seeds(n), 8)


def call_paths(spark: SparkSession, d: str) -> DataFrame:
    """Maximal simple call paths of up to 6 nodes from critical functions."""
    n, e = graph(spark, d)
    starts = n.where(F.array_contains("tags", "critical") & (F.col("kind") == "function"))
    p = g.simple_paths(g.oriented(e, ["calls"]), starts)
    return p.select("start", F.array_join("path", " -> ").alias("path"), F.size("path").alias("n_nodes"))


def impact_path_top(spark: SparkSession, d: str) -> DataFrame:
    """The 6 longest call paths of each repository, ties by their joined ids."""
    n, e = graph(spark, d)
    starts = n.where(F.array_contains("tags", "critical") & (F.col("kind") == "function"))
    p = g.simple_paths(g.oriented(e, ["calls"]), starts).join(n.select(F.col("id").alias("start"), "repo"), "start")
    p = p.select("repo", F.array_join("path", ",").alias("path"), F.size("path").alias("n_nodes"))
    return g.top_by(p, ["repo"], [F.desc("n_nodes"), F.col("path")], 6)


def file_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Files joined by an edge between their nodes."""
    return g.file_adjacency(*graph(spark, d))


def pagerank_files(spark: SparkSession, d: str) -> DataFrame:
    """Centrality of files over their adjacency, 30 rounds."""
    r = g.pagerank(g.file_adjacency(*graph(spark, d)))
    return r.select(F.col("node").alias("file_path"), F.round("rank", 9).alias("rank"))


def _pagerank_sql(rounds: int = 30) -> str:
    ctes = [f"{_G}, f AS (SELECT id, file_path FROM n WHERE file_path IS NOT NULL)",
            "a0 AS (SELECT DISTINCT x.file_path src, y.file_path dst FROM e JOIN f x ON x.id = e.from_id JOIN f y ON y.id = e.to_id WHERE x.file_path <> y.file_path)",
            "a AS MATERIALIZED (SELECT src, dst FROM a0 UNION SELECT dst, src FROM a0)", "g AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) deg FROM a)",
            "c AS MATERIALIZED (SELECT count(DISTINCT src) k FROM a)", "r0 AS MATERIALIZED (SELECT DISTINCT src node, 1.0::DOUBLE / k rank FROM a, c)"]
    ctes += [f"r{i + 1} AS MATERIALIZED (SELECT dst node, any_value(0.15::DOUBLE / k) + 0.85::DOUBLE * sum(rank / deg) rank FROM g JOIN r{i} ON node = src, c GROUP BY dst)" for i in range(rounds)]
    return ", ".join(ctes) + f" SELECT node AS file_path, round(rank, 9) AS rank FROM r{rounds}"


def node_merge(spark: SparkSession, d: str) -> DataFrame:
    """All deliveries of every node merged: how much evidence, which tags, what context."""
    n = read(spark, d, "nodes").where("id is not null")
    order = F.xxhash64("snapshot_id", "delivered_at", "name", "kind")
    rows = n.select("id", "kind", "name", "file_path", "bounded_context", "exported", "evidence", "tags", "metadata", F.struct("delivered_at", "snapshot_id", order.alias("o")).alias("seq"))
    m = g.merge_nodes(rows)
    return m.select("id", F.size("evidence").cast("long").alias("n_evidence"), F.array_join(F.array_sort("tags"), ",").alias("tags"), F.coalesce("exported", F.lit(False)).alias("exported"))


def edge_merge(spark: SparkSession, d: str) -> DataFrame:
    """All deliveries of every edge merged by (kind, from, to): how much evidence."""
    e = read(spark, d, "edges").where("from_id is not null and to_id is not null")
    rows = e.select("kind", "from_id", "to_id", "evidence", "metadata", F.struct("delivered_at", "snapshot_id", "id").alias("seq"))
    return g.merge_edges(rows).select("kind", "from_id", "to_id", F.size("evidence").cast("long").alias("n_evidence"))


def claims_build(spark: SparkSession, d: str) -> DataFrame:
    """Claims derived from the graph, with status and confidence."""
    c = cl.build_claims(*graph(spark, d, proofs=True, keep=True))
    return c.select("kind", "statement", F.array_join(F.array_sort("subject_node_ids"), ",").alias("subjects"), "verification_status", F.round("confidence", 6).alias("confidence"), F.size("evidence_ids").cast("long").alias("n_evidence"))


_LIST = "coalesce(list_transform(evidence, lambda r: struct_pack(i := concat('ev:', r.source_kind, ':', " + PATH.format("r.file_path") + ", ':', coalesce(r.start_line, 0), ':', coalesce(r.end_line, 0)), k := r.source_kind)), [])"
CLAIMS = f"""{_G}, p AS (SELECT id s, {_LIST} p FROM n), t AS (SELECT DISTINCT from_id s FROM e WHERE kind = 'tested_by'),
l AS (SELECT i.id, i.kind, e.from_id o, e.id eid FROM n i JOIN e ON e.to_id = i.id AND e.kind = CASE i.kind WHEN 'invariant' THEN 'constrained_by' ELSE 'implements_capability' END WHERE i.kind IN ('invariant', 'capability')),
g AS (SELECT id, count(*) k, bool_or(o IN (FROM t)) tested, list(o ORDER BY eid) o FROM l GROUP BY 1),
c AS (SELECT 'invariant' kind, coalesce(metadata['statement'], 'Invariant: ' || name) statement, list_concat([id], coalesce(o, [])) subj, CASE WHEN tested THEN 'tested' WHEN list_contains(tags, 'from-doc') THEN 'documented' ELSE 'inferred' END st FROM n LEFT JOIN g USING (id) WHERE kind = 'invariant'
  UNION ALL SELECT 'capability', concat('Capability "', name, '" is implemented by ', coalesce(k, 0), ' symbol(s).'), list_concat([id], coalesce(o, [])), CASE WHEN tested THEN 'tested' WHEN list_contains(tags, 'from-code') THEN 'documented' ELSE 'inferred' END FROM n LEFT JOIN g USING (id) WHERE kind = 'capability' AND (k > 0 OR list_contains(tags, 'from-doc'))
  UNION ALL SELECT 'contract', concat('Exported ', kind, ' "', name, '" is a public, compiler-enforced contract.'), [id], 'statically_verified' FROM n WHERE kind IN ('interface', 'type') AND exported),
q AS (SELECT c.*, list_sort(list_distinct(subj)) ds, row_number() OVER () rn FROM c),
v AS (SELECT rn, list_distinct(flatten(list(p.p))) ev FROM (SELECT rn, unnest(ds) s FROM q) u JOIN p USING (s) GROUP BY 1)
"""
STATUS = "CASE st WHEN 'statically_verified' THEN {} WHEN 'tested' THEN {} WHEN 'documented' THEN {} ELSE {} END"
_CONFIDENCE = f"0.5 * {STATUS.format(0.95, 0.85, 0.6, 0.4)} + 0.3 * {STATUS.format(0.9, 0.85, 0.7, 0.6)} + 0.2 * least(1.0, coalesce(len(list_distinct(list_transform(ev, lambda x: x.k))), 0) / 3)"
CLAIMS_SQL = f"""{CLAIMS} SELECT kind, statement, array_to_string(ds, ',') AS subjects, st AS verification_status, round(CAST({_CONFIDENCE} AS DOUBLE), 6) AS confidence, CAST(coalesce(len(list_distinct(list_transform(ev, lambda x: x.i))), 0) AS BIGINT) AS n_evidence FROM q LEFT JOIN v USING (rn)"""


_HIT = "m AS (SELECT id FROM n WHERE contains(lower(name), 'ledger') OR contains(lower(id), 'ledger'))"
_SEEDS = "sd AS (SELECT repo seed_set, min(id) id FROM n WHERE kind = 'module' GROUP BY 1)"
def oriented_sql(kinds: str) -> str:
    return f"u AS (SELECT from_id src, to_id dst FROM e WHERE kind IN {kinds} UNION SELECT to_id, from_id FROM e WHERE kind IN {kinds})"


def _scores_sql(preferred: list[str], required: list[str] | None, disallowed: list[str], seeds: str, hops: int) -> str:
    """Gates and scores of the claims q, with hops over the reference's edges from the nodes that ``seeds`` selects."""
    n = len(preferred)
    fit = " ".join(f"WHEN '{k}' THEN {1 - i / n * 0.3}" for i, k in enumerate(preferred))
    strength = STATUS.format(1.0, 0.85, 0.5, 0.3)
    within = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
    return f"""{CLAIMS.replace('WITH', 'WITH RECURSIVE', 1)}, {oriented_sql(tuple(_REACHABILITY))}, sd AS ({seeds}), w AS (SELECT id, 0 hop FROM sd UNION SELECT u.dst, hop + 1 FROM w JOIN u ON u.src = w.id JOIN n ON n.id = u.dst WHERE hop < {hops}),
h AS (SELECT id, min(hop) hop FROM w GROUP BY 1), f AS (SELECT rn, bool_or(n.kind IN ('module', 'function', 'class', 'interface', 'type', 'enum')) code, min(hop) hop FROM (SELECT rn, unnest(ds) s FROM q) u JOIN n ON n.id = u.s LEFT JOIN h ON h.id = u.s GROUP BY 1),
z AS (SELECT {CLAIM_ID} AS id, kind, CAST(hop AS INTEGER) AS hop, st NOT IN {within(disallowed)} AS status_allowed, {'true' if required is None else f'st IN {within(required)}'} AS sufficient, NOT coalesce(code, false) OR NOT EXISTS (FROM sd) OR hop IS NOT NULL AS reachable,
 0.25 * CASE kind {fit} ELSE 0.3 END + 0.25 * {STATUS.format(0.95, 0.85, 0.6, 0.4)} + 0.15 * CASE WHEN hop IS NOT NULL THEN 1.0 / (1 + hop) WHEN code THEN 0 ELSE 0.3 END + 0.2 * {strength} + 0.15 * {STATUS.format(0.9, 0.85, 0.7, 0.6)} AS raw FROM q LEFT JOIN f USING (rn)),
y AS (SELECT *, status_allowed AND sufficient AND reachable AS eligible, CASE WHEN status_allowed AND sufficient AND reachable THEN CAST(raw AS DOUBLE) ELSE 0.0 END AS score FROM z)"""


def claim_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of all claims."""
    return cl.claim_rows(*graph(spark, d, keep=True)).select("id", "kind", "statement")


def claim_scores(spark: SparkSession, d: str) -> DataFrame:
    """Gates and scores of all claims for a security question from the tagged entry points."""
    n, e = graph(spark, d, proofs=True, keep=True)
    seeds = n.where(F.array_contains("tags", "security") & (F.col("kind") == "function")).select(F.lit("all").alias("seed_set"), "id")
    hops = g.bfs(n, g.oriented(e, _REACHABILITY, "both"), seeds, MAX_HOPS).select("id", "hop")
    x = cl.evaluate_claims(checkpointed(cl.build_claims(n, e)), n, hops, "security")
    return x.select("id", "kind", "eligible", F.round("score", 6).alias("score"), "hop", "status_allowed", "sufficient", "reachable")


def contradiction_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Claims that are not normative, the surest first, over the graph with what the tables lack."""
    n, e, _ = seeded(spark, d)
    st = F.col("verification_status")
    c = cl.claim_rows(n, e).select("id", "kind", "statement", st, by_status(st, 0).alias("confidence"))
    return cl.ranked_contradictions(c).select("pos", "id", "verification_status")


def authoritative_claims(spark: SparkSession, d: str) -> DataFrame:
    """The 10 best claims for a question about business rules."""
    n, e = graph(spark, d, proofs=True, keep=True)
    x = cl.evaluate_claims(checkpointed(cl.build_claims(n, e)), n, spark.createDataFrame([], "id string, hop int"), "business_rule")
    return x.where("eligible").orderBy(F.desc(F.round("score", 9)), "id").limit(10).select("id", "kind", F.round("score", 6).alias("score"))


def _commits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    changed = read(spark, d, "hunks").select(g.normalize_path("file_path").alias("file")).distinct()
    return cochange.commit_sets(read(spark, d, "commit_files")), changed


def co_change_pairs_raw(spark: SparkSession, d: str) -> DataFrame:
    """Commits that each changed file shares with files beyond the change."""
    return cochange.co_change_counts(*_commits(spark, d), 1)


def co_change(spark: SparkSession, d: str) -> DataFrame:
    """The 8 files that changed most often with each changed file, twice at least."""
    return cochange.co_changes(*_commits(spark, d))


_CO = f"""WITH c AS (SELECT DISTINCT repository_identity repo, commit_id, {PATH.format('file')} f FROM commit_files WHERE commit_id IS NOT NULL AND file IS NOT NULL), ch AS (SELECT DISTINCT {PATH.format('file_path')} f FROM hunks),
p AS (SELECT a.repo, a.f AS file, b.f AS co_file, count(*) AS commits FROM c a JOIN c b ON a.repo = b.repo AND a.commit_id = b.commit_id WHERE a.f IN (FROM ch) AND b.f NOT IN (FROM ch) GROUP BY 1, 2, 3)"""


def diff_co_change(spark: SparkSession, d: str) -> DataFrame:
    """For each file of each diff, the 8 files beyond the diff that changed with it most often."""
    commits, _ = _commits(spark, d)
    files = read(spark, d, "hunks").select("diff_id", g.normalize_path("file_path").alias("file")).distinct()
    return cochange.co_changes_per_diff(commits, files)


def name_status_parse(spark: SparkSession, d: str) -> DataFrame:
    """Commits read back from logs written in name-status form, each repository's history in many logs."""
    c = cochange.commit_sets(read(spark, d, "commit_files"))
    renamed = F.concat(F.lit("R100\told/"), "file", F.lit("\t"), "file")
    line = F.when(F.pmod(F.length("file"), F.lit(5)) == 0, renamed).otherwise(F.concat(F.lit("M\t"), "file"))
    rec = c.groupBy("repo", "commit_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("r"))
    part = F.concat("repo", F.lit("#"), F.left(F.sha2("commit_id", 256), F.lit(3)))
    logs = rec.groupBy(part.alias("log_id")).agg(F.array_join(F.sort_array(F.collect_list("r")), "\x1e").alias("text"))
    return cochange.parse_name_status(logs).groupBy(F.regexp_replace("log_id", "#[0-9a-f]{3}$", "").alias("log_id"), "file").agg(F.count("*").alias("commits"))


def _queries(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id % 20 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), "text")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 10 best documents for every query text by BM25."""
    docs = read(spark, d, "documents")
    return retrieval.bm25(docs, _queries(docs)).select("query_id", "doc_id", "pos", F.round("score", 6).alias("score"))


_TOK = r"list_filter(regexp_split_to_array(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^A-Za-z0-9]+'), lambda t: length(t) >= 3)"
_BM25 = f"""WITH d AS (SELECT doc_id, coalesce({_TOK.format('text')}, []) w FROM documents), st AS (SELECT count(*) n, avg(len(w)) al FROM d),
tf AS (SELECT doc_id, len, word, count(*) tf FROM (SELECT doc_id, len(w) len, unnest(w) word FROM d) GROUP BY ALL), df AS (SELECT word, count(*) df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT doc_id query_id, unnest({_TOK.format('text')}) word FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL),
s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))) score FROM q JOIN tf USING (word) JOIN df USING (word), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) pos FROM s WHERE score > 0 {{skip}})"""


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, d, "documents")
    ranks = retrieval.bm25(docs, _queries(docs), 20, skip_self=True)
    place = docs.select("doc_id", F.col("repository_identity").alias("r"), F.col("source").alias("s"))
    own = docs.where("doc_id % 20 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), F.col("repository_identity").alias("q_r"), F.col("source").alias("q_s"))
    met = ranks.join(own, "query_id").join(place, "doc_id")
    met = met.select("query_id", "doc_id", "pos", ((F.col("q_r") == F.col("r")) & (F.col("q_s") == F.col("s"))).alias("hit"), (F.col("q_r") == F.col("r")).alias("close"))
    sizes = place.groupBy(F.col("r").alias("q_r"), F.col("s").alias("q_s")).agg((F.count("*") - 1).alias("n_truth"))
    return met, own.join(sizes, ["q_r", "q_s"]).select("query_id", "n_truth")


def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Recall, reciprocal rank and false neighbours of every query: truth is text of its repository and source."""
    x = retrieval.ranking_scores(*_ranked(spark, d))
    return x.select("query_id", *(F.round(c, 6).alias(c) for c in x.columns if c != "query_id"))


def retrieval_means(spark: SparkSession, d: str) -> DataFrame:
    """The same scores, averaged over queries."""
    x = retrieval.mean_scores(retrieval.ranking_scores(*_ranked(spark, d)))
    return x.select(*(F.round(c, 6).alias(c) for c in x.columns if c != "n_queries"), "n_queries")


_SCORES = f"""{_BM25.format(skip='AND query_id <> doc_id')}, k AS (SELECT * FROM r WHERE pos <= 20), o AS (SELECT doc_id query_id, repository_identity r, source s FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL),
tr AS (SELECT o.query_id, x.doc_id FROM o JOIN documents x ON x.repository_identity = o.r AND x.source = o.s WHERE o.query_id <> x.doc_id), nt AS (SELECT query_id, count(*) m FROM tr GROUP BY 1),
j AS (SELECT k.*, (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM tr) hit, coalesce(o.r = x.repository_identity, false) near FROM k JOIN o USING (query_id) JOIN documents x USING (doc_id)),
z AS (SELECT query_id, m, count(*) FILTER (hit AND pos <= 5) / m AS recall_5, count(*) FILTER (hit AND pos <= 10) / m AS recall_10, count(*) FILTER (hit AND pos <= 20) / m AS recall_20,
  CASE WHEN m IS NOT NULL THEN coalesce(1 / min(pos) FILTER (hit), 0) END AS reciprocal_rank, count(*) FILTER (pos <= 10 AND NOT hit AND NOT near) / count(*) FILTER (pos <= 10) AS false_10 FROM j LEFT JOIN nt USING (query_id) GROUP BY 1, 2)"""


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return _queries(read(spark, d, "documents")).withColumnRenamed("query_id", "task_id")


def lexical_entrypoints(spark: SparkSession, d: str) -> DataFrame:
    """Symbols named by a task's words, the first 25 of each task."""
    return retrieval.lexical_entrypoints(graph(spark, d)[0], _tasks(spark, d))


def lexical_name_rank(spark: SparkSession, d: str) -> DataFrame:
    """Files ranked by how often a task's words name them."""
    return retrieval.lexical_name_rank(graph(spark, d)[0], _tasks(spark, d))


def known_slug_match(spark: SparkSession, d: str) -> DataFrame:
    """Capabilities whose words begin words of a task."""
    caps = graph(spark, d)[0].where("kind = 'capability'").select(F.regexp_replace("id", "^cap:", "").alias("slug")).distinct()
    return retrieval.known_slugs(_tasks(spark, d), caps)


_WORDS = "SELECT DISTINCT doc_id task_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) w FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL"
STOP = "(" + ", ".join(f"'{w}'" for w in retrieval.STOPWORDS) + ")"


def task_caps(spark: SparkSession, d: str) -> DataFrame:
    """16 orders chosen with caps by priority, filled up in order of key."""
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("item"))
    return retrieval.capped_selection(o, {"1-URGENT": 6, "2-HIGH": 6, "3-MEDIUM": 3, "5-LOW": 3}, 16)


def inspect_match(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose name or id holds a term."""
    return retrieval.inspect(*graph(spark, d), "ledger")[0].select("id", "kind", "name")


def inspect_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations that touch such nodes, with names."""
    return retrieval.inspect(*graph(spark, d), "ledger")[1]


_PATHS = f"""WITH RECURSIVE {GRAPH}, c AS (SELECT DISTINCT from_id src, to_id dst FROM e WHERE kind = 'calls'),
w AS (SELECT id AS start, [id] p FROM n WHERE kind = 'function' AND list_contains(tags, 'critical') UNION ALL SELECT w.start, list_append(w.p, c.dst) FROM w JOIN c ON c.src = w.p[-1] WHERE len(w.p) < 6 AND NOT list_contains(w.p, c.dst)),
pp AS (SELECT * FROM w WHERE len(p) > 1 AND (len(p) = 6 OR NOT EXISTS (SELECT 1 FROM c WHERE c.src = w.p[-1] AND NOT list_contains(w.p, c.dst))))"""

SQL = {
    "kind_counts": f"{_G} SELECT 'node' AS what, kind, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'edge', kind, count(*) FROM e GROUP BY ALL",
    "neighbors": f"""{_G}, o AS (SELECT DISTINCT from_id a, to_id b FROM e WHERE kind = 'calls'), u AS (SELECT a, b FROM o UNION SELECT b, a FROM o)
SELECT a AS id, (SELECT count(*) FROM o WHERE o.a = u.a) AS n_out, (SELECT count(*) FROM o WHERE o.b = u.a) AS n_in, count(*) AS n_both FROM u GROUP BY u.a""",
    "bfs_distances": f"WITH RECURSIVE {GRAPH}, {oriented_sql(_KINDS)}, {_SEEDS}, w AS (SELECT seed_set, id, 0 hop FROM sd UNION SELECT seed_set, u.dst, hop + 1 FROM w JOIN u ON u.src = w.id JOIN n ON n.id = u.dst WHERE hop < 4) SELECT seed_set, id, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY 1, 2",
    "reachable_out": f"WITH RECURSIVE {GRAPH}, u AS (SELECT DISTINCT from_id src, to_id dst FROM e WHERE kind IN ('imports', 'calls', 'declares')), {_SEEDS}, w AS (SELECT seed_set, id, 0 hop FROM sd UNION SELECT seed_set, u.dst, hop + 1 FROM w JOIN u ON u.src = w.id JOIN n ON n.id = u.dst WHERE hop < 8) SELECT seed_set, id, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY 1, 2",
    "call_paths": f"{_PATHS} SELECT start, array_to_string(p, ' -> ') AS path, CAST(len(p) AS INTEGER) AS n_nodes FROM pp",
    "impact_path_top": f"{_PATHS}, k AS (SELECT repo, array_to_string(p, ',') path, CAST(len(p) AS INTEGER) n_nodes FROM pp JOIN n ON n.id = pp.start) SELECT repo, path, n_nodes, CAST(row_number() OVER (PARTITION BY repo ORDER BY n_nodes DESC, path) AS INTEGER) AS pos FROM k QUALIFY pos <= 6",
    "file_adjacency": f"{_G}, f AS (SELECT id, file_path FROM n WHERE file_path IS NOT NULL), a AS (SELECT x.file_path src, y.file_path dst FROM e JOIN f x ON x.id = e.from_id JOIN f y ON y.id = e.to_id WHERE x.file_path <> y.file_path) SELECT src, dst FROM a UNION SELECT dst, src FROM a",
    "pagerank_files": _pagerank_sql(),
    "node_merge": "SELECT id, CAST(sum(coalesce(len(evidence), 0)) AS BIGINT) AS n_evidence, coalesce(array_to_string(list_sort(list_distinct(flatten(list(coalesce(tags, []))))), ','), '') AS tags, coalesce(bool_or(exported), false) AS exported FROM nodes WHERE id IS NOT NULL GROUP BY id",
    "edge_merge": "SELECT kind, from_id, to_id, CAST(sum(coalesce(len(evidence), 0)) AS BIGINT) AS n_evidence FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL GROUP BY 1, 2, 3",
    "claims_build": CLAIMS_SQL,
    "claim_ids": f"{CLAIMS} SELECT {CLAIM_ID} AS id, kind, statement FROM q",
    "claim_scores": _scores_sql(*POLICIES["security"], "SELECT id FROM n WHERE kind = 'function' AND list_contains(tags, 'security')", MAX_HOPS) + " SELECT id, kind, eligible, round(score, 6) AS score, hop, status_allowed, sufficient, reachable FROM y",
    "contradiction_ranks": f"WITH {SEEDED_GRAPH}, {NINE_CLAIMS}, k AS (SELECT {CLAIM_ID} AS id, st FROM c WHERE st IN ('deprecated', 'contradicted')) SELECT row_number() OVER (ORDER BY st, id) AS pos, id, st AS verification_status FROM k",
    "authoritative_claims": _scores_sql(*POLICIES["business_rule"], "SELECT id FROM n WHERE false", 1) + " SELECT id, kind, round(score, 6) AS score FROM y WHERE eligible ORDER BY round(y.score, 9) DESC, id LIMIT 10",
    "lexical_name_rank": f"""{_G}, q AS (SELECT DISTINCT doc_id task_id, unnest({_TOK.format('text')}) w FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL), k AS (SELECT * FROM q WHERE length(w) >= 4 AND w NOT IN {STOP}),
p AS (SELECT DISTINCT file_path, id, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^A-Za-z0-9]+'), lambda t: t <> '')) part FROM n WHERE file_path IS NOT NULL),
a AS (SELECT DISTINCT task_id, file_path, w, id FROM k JOIN p ON starts_with(part, w)), b AS (SELECT task_id, file_path, w FROM k JOIN (SELECT DISTINCT file_path, lower(string_split(file_path, '/')[-1]) base FROM n WHERE file_path IS NOT NULL) ON contains(base, w))
SELECT task_id, file_path, count(*) AS hits FROM (SELECT task_id, file_path FROM a UNION ALL SELECT task_id, file_path FROM b) GROUP BY 1, 2""",
    "co_change_pairs_raw": f"{_CO} SELECT * FROM p",
    "co_change": f"{_CO} SELECT *, CAST(row_number() OVER (PARTITION BY repo, file ORDER BY commits DESC, co_file) AS INTEGER) AS pos FROM p WHERE commits >= 2 QUALIFY pos <= 8",
    "diff_co_change": f"WITH {DIFF_CO_CHANGE} SELECT * FROM dco",
    "name_status_parse": f"""WITH c AS (SELECT DISTINCT repository_identity log_id, commit_id, {PATH.format('file')} f FROM commit_files WHERE commit_id IS NOT NULL AND file IS NOT NULL),
x AS (SELECT log_id, commit_id, f FROM c UNION SELECT log_id, commit_id, 'old/' || f FROM c WHERE length(f) % 5 = 0) SELECT log_id, f AS file, count(*) AS commits FROM x GROUP BY 1, 2""",
    "bm25_topk": f"{_BM25.format(skip='')} SELECT query_id, doc_id, CAST(pos AS INTEGER) AS pos, round(score, 6) AS score FROM r WHERE pos <= 10",
    "recall_mrr": f"{_SCORES} SELECT query_id, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10, round(recall_20, 6) AS recall_20, round(reciprocal_rank, 6) AS reciprocal_rank, round(false_10, 6) AS false_10 FROM z",
    "retrieval_means": f"{_SCORES} SELECT round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(recall_20), 6) AS recall_20, round(avg(reciprocal_rank), 6) AS reciprocal_rank, round(avg(false_10), 6) AS false_10, count(*) AS n_queries FROM z",
    "lexical_entrypoints": f"""{_G}, q AS (SELECT * FROM ({_WORDS}) WHERE length(w) >= 4 AND w NOT IN {STOP}), y AS (SELECT DISTINCT w FROM q), hit AS (SELECT w, id FROM y JOIN n ON contains(lower(concat_ws(' ', name, coalesce(file_path, ''))), w) WHERE kind IN ('function', 'class', 'interface', 'type', 'enum')),
x AS (SELECT DISTINCT task_id, id FROM q JOIN hit USING (w)) SELECT task_id, id FROM x QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY id) <= 25""",
    "known_slug_match": f"""{_G}, q AS ({_WORDS}), s AS (SELECT DISTINCT regexp_replace(id, '^cap:', '') slug FROM n WHERE kind = 'capability'), p AS (SELECT slug, unnest(string_split(slug, '-')) p FROM s)
SELECT DISTINCT task_id, slug FROM q JOIN p ON starts_with(q.w, p.p) WHERE length(p.p) >= 4""",
    "task_caps": """WITH r AS (SELECT o_orderpriority AS type, o_orderkey AS seq, o_custkey AS item, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= CASE o_orderpriority WHEN '1-URGENT' THEN 6 WHEN '2-HIGH' THEN 6 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 3 ELSE 0 END w FROM orders)
SELECT type, seq, item FROM r ORDER BY w DESC, seq LIMIT 16""",
    "inspect_match": f"{_G}, {_HIT} SELECT id, kind, name FROM n WHERE id IN (FROM m)",
    "inspect_relations": f"{_G}, {_HIT} SELECT e.kind AS kind, from_id, to_id, coalesce(a.name, from_id) AS from_name, coalesce(b.name, to_id) AS to_name FROM e LEFT JOIN n a ON a.id = from_id LEFT JOIN n b ON b.id = to_id WHERE from_id IN (FROM m) OR to_id IN (FROM m)",
}
QUERIES = {q.__name__: q for q in (
    kind_counts, neighbors, bfs_distances, reachable_out, call_paths, impact_path_top, file_adjacency, pagerank_files, node_merge, edge_merge, claims_build, claim_ids, claim_scores, contradiction_ranks, authoritative_claims,
    co_change_pairs_raw, co_change, diff_co_change, name_status_parse, bm25_topk, recall_mrr, retrieval_means, lexical_entrypoints, lexical_name_rank, known_slug_match, task_caps, inspect_match, inspect_relations,
)}
