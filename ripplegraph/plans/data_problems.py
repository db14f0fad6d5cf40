"""The general data problems: intervals, snapshot changes, hierarchies, orphan references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions.paths import normalize_path
from ripplegraph.operators.containment import containment_links
from ripplegraph.operators.graph_orphans import graph_orphans
from ripplegraph.operators.hierarchy import descendants, resolve_hierarchy
from ripplegraph.operators.intervals import merge_intervals
from ripplegraph.operators.snapshots import snapshot_changes
from ripplegraph.runtime import read

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Covered line ranges of each file, and the gaps between them."""
    ev = read(spark, d, "evidence").select(
        F.lit("evidence").alias("src"), F.lit("").alias("diff_id"), normalize_path("file_path").alias("file_path"),
        F.col("start_line").cast("long").alias("start"), F.coalesce("end_line", "start_line").cast("long").alias("end"),
    )
    start = F.col("new_start").cast("long")
    hk = read(spark, d, "hunks").select(
        F.lit("hunks").alias("src"), "diff_id", normalize_path("file_path").alias("file_path"),
        start.alias("start"), (start + F.coalesce("new_lines", F.lit(1)) - 1).alias("end"),
    )
    found = merge_intervals(ev.unionByName(hk), ["src", "diff_id", "file_path"])
    return found.select("src", "diff_id", "file_path", "kind", F.col("start").cast("int").alias("start_line"), F.col("end").cast("int").alias("end_line"))


_PATH = r"regexp_replace(replace({0}, '\', '/'), '^\./', '')"

P1_SQL = rf"""
WITH r AS (
  SELECT 'evidence' src, '' diff_id, {_PATH.format('file_path')} file_path, CAST(start_line AS BIGINT) s, CAST(coalesce(end_line, start_line) AS BIGINT) e FROM evidence
  UNION ALL
  SELECT 'hunks', diff_id, {_PATH.format('file_path')}, CAST(new_start AS BIGINT), CAST(new_start AS BIGINT) + coalesce(new_lines, 1) - 1 FROM hunks),
m AS (SELECT *, max(e) OVER (PARTITION BY src, diff_id, file_path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) b FROM r WHERE s IS NOT NULL AND e >= s),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY src, diff_id, file_path ORDER BY s, e ROWS UNBOUNDED PRECEDING) n FROM m),
p AS (SELECT src, diff_id, file_path, n, min(s) s, max(e) e FROM g GROUP BY ALL),
l AS (SELECT *, lag(e) OVER (PARTITION BY src, diff_id, file_path ORDER BY s) b FROM p)
SELECT src, diff_id, file_path, 'period' AS kind, CAST(s AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line FROM p
UNION ALL SELECT src, diff_id, file_path, 'gap', CAST(b + 1 AS INTEGER), CAST(s - 1 AS INTEGER) FROM l WHERE b IS NOT NULL
"""


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Node and edge ids added, removed or changed between consecutive snapshots."""
    nodes = read(spark, d, "nodes")
    return snapshot_changes(read(spark, d, "snapshots"), {"nodes": nodes, "edges": read(spark, d, "edges")}, nodes)


_DELIVERED = """
s0 AS (SELECT snapshot_id, max(captured_at) captured_at, max(repository_identity) repo, max(commit_id) commit_id FROM snapshots
  WHERE snapshot_id IN (SELECT snapshot_id FROM nodes) GROUP BY 1)"""
_EV = rf"list_sort(list_distinct(list_transform(coalesce(evidence, []), lambda e: concat_ws(chr(1), {_PATH.format('e.file_path')}, coalesce(CAST(e.start_line AS VARCHAR), '~'), coalesce(CAST(e.end_line AS VARCHAR), '~'), coalesce(e.source_kind, '~'), coalesce(e.excerpt, '~')))))"
_META = "list_sort(list_transform(map_entries(coalesce(metadata, MAP {})), lambda e: concat(e.key, chr(1), coalesce(e.value, '~'))))"

P2_SQL = rf"""
WITH {_DELIVERED},
s1 AS (SELECT *, row_number() OVER (PARTITION BY repo, commit_id ORDER BY captured_at DESC, snapshot_id DESC) rn FROM s0),
s AS (SELECT snapshot_id, repo, row_number() OVER (PARTITION BY repo ORDER BY captured_at, snapshot_id) idx, lead(snapshot_id) OVER (PARTITION BY repo ORDER BY captured_at, snapshot_id) nxt FROM s1 WHERE rn = 1),
n AS (SELECT 'nodes' tbl, snapshot_id, id, delivered_at, concat_ws(chr(2), kind, name, coalesce({_PATH.format('file_path')}, '~'), coalesce(bounded_context, '~'), coalesce(CAST(exported AS VARCHAR), '~'),
  CAST(list_sort(list_distinct(coalesce(tags, []))) AS VARCHAR), CAST({_EV} AS VARCHAR), CAST({_META} AS VARCHAR)) c FROM nodes),
e AS (SELECT 'edges' tbl, snapshot_id, id, delivered_at, concat_ws(chr(2), kind, coalesce(from_id, '~'), coalesce(to_id, '~'), CAST({_EV} AS VARCHAR), CAST({_META} AS VARCHAR)) c FROM edges),
v AS (SELECT tbl, snapshot_id, id, max(struct_pack(d := delivered_at, c := c)).c c FROM (FROM n UNION ALL FROM e) GROUP BY 1, 2, 3),
w AS (SELECT tbl, id, c, s.*, lag(idx) OVER k was, lag(c) OVER k wc, lead(idx) OVER k will FROM v JOIN s USING (snapshot_id) WINDOW k AS (PARTITION BY repo, tbl, id ORDER BY idx))
SELECT snapshot_id, tbl, id, 'added' AS change FROM w WHERE idx > 1 AND (was IS NULL OR was < idx - 1)
UNION ALL SELECT snapshot_id, tbl, id, 'changed' FROM w WHERE was = idx - 1 AND c <> wc
UNION ALL SELECT nxt, tbl, id, 'removed' FROM w WHERE nxt IS NOT NULL AND (will IS NULL OR will > idx + 1)
"""


def _hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return resolve_hierarchy(containment_links(read(spark, d, "snapshots"), read(spark, d, "nodes"), read(spark, d, "edges")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth and path of every node of the containment trees; nodes on and below cycles named."""
    return _hierarchy(spark, d).select("node_id", "root_id", "depth", "path")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All nodes beneath each node."""
    return descendants(_hierarchy(spark, d)).select("ancestor_id", "node_id", "distance")


_FOREST = f"""
WITH RECURSIVE {_DELIVERED},
s AS (SELECT repo, max(struct_pack(c := captured_at, i := snapshot_id)).i snapshot_id FROM s0 GROUP BY 1),
e AS (SELECT snapshot_id, id, max(struct_pack(d := delivered_at, k := kind, f := from_id, t := to_id)) x FROM edges WHERE snapshot_id IN (SELECT snapshot_id FROM s) GROUP BY 1, 2),
l AS (SELECT repo, CASE WHEN x.k = 'declares' THEN x.t ELSE x.f END child, min(CASE WHEN x.k = 'declares' THEN x.f ELSE x.t END) parent FROM e JOIN s USING (snapshot_id)
  WHERE x.k IN ('belongs_to', 'declares') AND x.f IS NOT NULL AND x.t IS NOT NULL GROUP BY 1, 2),
ends AS (SELECT repo, child node FROM l UNION SELECT repo, parent FROM l),
tree AS (SELECT repo, node, node root, 0 depth, node path, [node] ids FROM ends WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.repo = ends.repo AND l.child = ends.node)
  UNION ALL SELECT t.repo, l.child, t.root, t.depth + 1, t.path || ' > ' || l.child, list_append(t.ids, l.child) FROM tree t JOIN l ON l.repo = t.repo AND l.parent = t.node)"""

P4_SQL = f"""{_FOREST},
rest AS (SELECT repo, node FROM ends WHERE (repo, node) NOT IN (SELECT (repo, node) FROM tree)),
walk AS (SELECT repo, node, node AS pos, 0 AS n FROM rest UNION ALL
  SELECT w.repo, w.node, l.parent, w.n + 1 FROM walk w JOIN l ON l.repo = w.repo AND l.child = w.pos WHERE w.n = 0 OR (w.pos <> w.node AND w.n <= (SELECT count(*) FROM rest))),
cyc AS (SELECT DISTINCT repo, node FROM walk WHERE n > 0 AND pos = node)
SELECT node AS node_id, root AS root_id, CAST(depth AS INTEGER) AS depth, path FROM tree
UNION ALL SELECT node, '', CASE WHEN (repo, node) IN (SELECT (repo, node) FROM cyc) THEN -1 ELSE -2 END, '' FROM rest
"""

P4_DESCENDANTS_SQL = f"""{_FOREST}
SELECT ids[i] AS ancestor_id, node AS node_id, CAST(depth + 1 - i AS INTEGER) AS distance FROM (SELECT *, unnest(range(1, depth + 1)) i FROM tree)
"""


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every orphan reference of every delivered snapshot."""
    return graph_orphans(*(read(spark, d, t) for t in ("snapshots", "nodes", "edges", "evidence", "sem_links")))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references counted per table, field and snapshot."""
    return p6_found(spark, d).groupBy("tbl", "field", "snapshot_id").agg(F.count("*").alias("orphans"))


_P6 = rf"""
WITH {_DELIVERED},
n AS (SELECT snapshot_id, id, max(struct_pack(d := delivered_at, f := {_PATH.format('file_path')}, e := evidence)) x FROM nodes JOIN s0 USING (snapshot_id) GROUP BY 1, 2),
e AS (SELECT snapshot_id, id, max(struct_pack(d := delivered_at, f := from_id, t := to_id)) x FROM edges JOIN s0 USING (snapshot_id) GROUP BY 1, 2),
ev AS (SELECT id, min(recorded_at) first_at FROM evidence GROUP BY 1),
r AS (SELECT 'edges' tbl, snapshot_id, id rec_id, 'from_id' field, x.f AS ref, 'node' k, x.f AS target FROM e UNION ALL SELECT 'edges', snapshot_id, id, 'to_id', x.t, 'node', x.t FROM e
  UNION ALL SELECT 'nodes', snapshot_id, id, 'evidence', ref, 'evidence', ref FROM (SELECT snapshot_id, id, unnest(list_transform(x.e, lambda v: concat('ev:', v.source_kind, ':', {_PATH.format('v.file_path')}, ':', coalesce(v.start_line, 0), ':', coalesce(v.end_line, 0)))) AS ref FROM n)
  UNION ALL SELECT 'sem_links', snapshot_id, owner_id, 'ref', ref, CASE WHEN kind IN ('file', 'evidence') THEN kind ELSE 'node' END, CASE WHEN kind = 'file' THEN {_PATH.format('ref')} ELSE ref END FROM sem_links JOIN s0 USING (snapshot_id)),
o AS (SELECT DISTINCT r.tbl, r.snapshot_id, r.rec_id, r.field, r.ref FROM r JOIN s0 USING (snapshot_id)
  LEFT JOIN (SELECT DISTINCT snapshot_id, 'node' k, id target FROM n UNION SELECT snapshot_id, 'file', x.f FROM n) p ON p.snapshot_id = r.snapshot_id AND p.k = r.k AND p.target = r.target
  LEFT JOIN ev ON r.k = 'evidence' AND ev.id = r.target AND ev.first_at <= s0.captured_at
  WHERE r.ref IS NOT NULL AND p.target IS NULL AND ev.id IS NULL)
"""
P6_SQL = _P6 + "SELECT tbl, snapshot_id, rec_id, field, ref FROM o"
P6_REPORT_SQL = _P6 + "SELECT tbl, field, snapshot_id, count(*) AS orphans FROM o GROUP BY ALL"

QUERIES: dict[str, Query] = {q.__name__: q for q in (p1_found, p2_found, p4_found, p4_descendants, p6_found, p6_report)}
SQL = {"p1_found": P1_SQL, "p2_found": P2_SQL, "p4_found": P4_SQL, "p4_descendants": P4_DESCENDANTS_SQL, "p6_found": P6_SQL, "p6_report": P6_REPORT_SQL}
