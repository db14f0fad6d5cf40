"""Property-graph kernels: the current graph, merges, neighbours, bounded search, paths, centrality."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.functions.paths import normalize_path
from ripplegraph.operators.versions import delivered_snapshots, evidence_id
from ripplegraph.runtime import broadcast_if_small, checkpointed


def current_graph(snapshots: DataFrame, nodes: DataFrame, edges: DataFrame, proofs: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each repository's latest delivered snapshot, one row per id, the latest delivered.

    Nodes get normalised paths, sets instead of nulls, and ``repo``. Rows are combined by id before the shuffle. Without
    ``proofs`` there is neither evidence nor metadata, and nodes have start_line, end_line, statement and deprecated instead:
    of evidence only line numbers are then read from the files.
    """
    last = delivered_snapshots(snapshots, nodes).groupBy("repository_identity").agg(F.max(F.struct("captured_at", "snapshot_id")).alias("s"))
    last = broadcast_if_small(checkpointed(last.select(F.col("repository_identity").alias("repo"), "s.snapshot_id")))

    def newest(rows: DataFrame, payload: list[str], order: list[str]) -> DataFrame:
        live = rows.where("id is not null").join(last, "snapshot_id")
        best = live.groupBy("repo", "id").agg(F.max_by(F.struct(*payload), F.struct("delivered_at", *order)).alias("x"))
        return best.select("repo", "id", "x.*")

    if not proofs:
        start, end = _lines(F.col("evidence.start_line"), F.col("evidence.end_line"))
        nodes = nodes.withColumns({"start_line": start, "end_line": end, "statement": F.col("metadata")["statement"], "deprecated": is_deprecated(nodes)})
    facts = ["evidence", "metadata"] if proofs else ["start_line", "end_line", "statement", "deprecated"]
    n = newest(nodes, ["kind", "name", "file_path", "bounded_context", "exported", "tags", *facts], ["kind", "name", "file_path"])
    n = n.withColumns({"file_path": normalize_path("file_path"), "tags": F.coalesce("tags", F.array().cast("array<string>"))})
    e = newest(edges, ["kind", "from_id", "to_id", *facts[:1]] if proofs else ["kind", "from_id", "to_id"], ["kind", "from_id", "to_id"])
    return n, e.where("from_id is not null and to_id is not null")


def merge_nodes(rows: DataFrame) -> DataFrame:
    """Nodes given more than once under one id, merged: evidence appended in order of seq, tags united, metadata and
    context of the first row that has them, exported if any row says so."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    ordered = F.sort_array(F.collect_list(F.struct("seq", "evidence", "tags")))
    m = rows.groupBy("id").agg(
        F.min_by("kind", "seq").alias("kind"), F.min_by("name", "seq").alias("name"), first("file_path").alias("file_path"),
        first("bounded_context").alias("bounded_context"), F.bool_or("exported").alias("exported"), ordered.alias("o"), first("metadata").alias("metadata"),
    )
    drop = lambda a: F.flatten(F.filter(a, lambda x: x.isNotNull()))
    return m.withColumns({"evidence": drop(F.col("o.evidence")), "tags": F.array_distinct(drop(F.col("o.tags")))}).drop("o")


def merge_edges(rows: DataFrame) -> DataFrame:
    """Edges by (kind, from_id, to_id), never by their 32-bit id: evidence appended in order, the first metadata kept."""
    ordered = F.sort_array(F.collect_list(F.struct("seq", "evidence")))
    m = rows.groupBy("kind", "from_id", "to_id").agg(ordered.alias("o"), F.min_by("metadata", F.when(F.col("metadata").isNotNull(), F.col("seq"))).alias("metadata"))
    return m.withColumn("evidence", F.flatten(F.filter(F.col("o.evidence"), lambda x: x.isNotNull()))).drop("o")


def _lines(starts: Column, ends: Column) -> tuple[Column, Column]:
    """Least start, and greatest end where an entry without end ends where it starts; nulls without any start."""
    both = F.zip_with(starts, ends, lambda s, e: F.coalesce(e, s))
    start = F.array_min(starts)
    return start, F.when(start.isNotNull(), F.coalesce(F.array_max(both), start))


def evidence_records(rows: DataFrame) -> DataFrame:
    """(id, file_path, start_line, end_line, source_kind, excerpt) of all evidence of ``rows`` (evidence, seq), one a id, the
    first by seq and place in its list."""
    e = rows.select("seq", F.posexplode("evidence").alias("pos", "e")).withColumn("id", evidence_id(F.col("e")))
    return e.groupBy("id").agg(F.min_by("e", F.struct("seq", "pos")).alias("e")).select("id", normalize_path("e.file_path").alias("file_path"), "e.start_line", "e.end_line", "e.source_kind", "e.excerpt")


def with_lines(nodes: DataFrame) -> DataFrame:
    """``nodes`` with start_line and end_line, the first and last line over their evidence."""
    if "start_line" in nodes.columns:
        return nodes
    start, end = _lines(F.col("evidence.start_line"), F.col("evidence.end_line"))
    return nodes.withColumns({"start_line": start, "end_line": end})


def node_ranges(nodes: DataFrame) -> DataFrame:
    return with_lines(nodes).select("id", "start_line", "end_line")


def is_deprecated(nodes: DataFrame) -> Column:
    """Whether a node says of itself that it is deprecated, by tag or metadata."""
    if "deprecated" in nodes.columns:
        return F.col("deprecated")
    return F.coalesce(F.array_contains("tags", "deprecated"), F.lit(False)) | F.coalesce(F.col("metadata")["deprecated"] == "true", F.lit(False))


def statement_of(nodes: DataFrame) -> Column:
    return F.col("statement") if "statement" in nodes.columns else F.col("metadata")["statement"]


def oriented(edges: DataFrame, kinds: list[str] | None = None, direction: str = "out") -> DataFrame:
    """(src, dst) along ``kinds``: outwards, inwards, or both ways."""
    e = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    out = e.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    back = e.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def bfs(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 8) -> DataFrame:
    """(seed_set, id, hop): least hops from any seed of each set, at most ``max_depth``; ``edges`` has src and dst.

    ``seeds`` has seed_set and id; seeds that are no node are ignored. Many sets run in one search. Each level joins the
    frontier to the edges, drops what was reached before, and is cut by a reliable checkpoint; the loop ends with the first
    empty frontier. The edges are checkpointed once and so read, not derived, at each level.
    """
    e = checkpointed(edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
    frontier = checkpointed(seeds.select("seed_set", "id").distinct().join(nodes.select("id"), "id", "left_semi").withColumn("hop", F.lit(0)))
    seen = frontier
    for depth in range(1, max_depth + 1):
        step = frontier.join(e, frontier["id"] == e["src"]).select("seed_set", F.col("dst").alias("id")).distinct()
        frontier = checkpointed(step.join(seen.select("seed_set", "id"), ["seed_set", "id"], "left_anti").withColumn("hop", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.select("seed_set", "id", "hop")


def simple_paths(edges: DataFrame, starts: DataFrame, max_nodes: int = 6) -> DataFrame:
    """(start, path array): maximal simple paths of 2 to ``max_nodes`` nodes along ``edges`` (src, dst).

    Depth is bounded, so the paths are a fixed number of joins; a path ends where no unvisited successor is left.
    """
    e = edges.select("src", "dst").distinct()
    nexts = e.groupBy("src").agg(F.collect_set("dst").alias("nexts"))
    at = starts.select(F.col("id").alias("start"), F.array("id").alias("path"))
    done = None
    for length in range(1, max_nodes + 1):
        at = at.join(nexts, F.element_at("path", -1) == nexts["src"], "left").drop("src")
        ahead = F.array_except(F.coalesce("nexts", F.array().cast("array<string>")), "path")
        at = at.withColumn("ahead", ahead if length < max_nodes else F.array().cast("array<string>")).drop("nexts")
        ended = at.where((F.size("ahead") == 0) & (F.size("path") > 1)).select("start", "path")
        done = ended if done is None else done.unionByName(ended)
        at = at.select("start", "path", F.explode("ahead").alias("n")).select("start", F.concat("path", F.array("n")).alias("path"))
    return done


def file_adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) files joined by an edge between their nodes, both ways, without loops."""
    f = nodes.where("file_path is not null").select("id", "file_path")
    a = edges.join(f.toDF("from_id", "src"), "from_id").join(f.toDF("to_id", "dst"), "to_id").where("src <> dst").select("src", "dst").distinct()
    return a.unionByName(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def pagerank(adjacency: DataFrame, iterations: int = 30, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """(node, rank) after a fixed number of rounds over (src, dst); every node of the graph has a neighbour.

    Edges carry their source's degree and are hashed by source once; they stay so, in memory and on disk, and a round
    moves ranks and sums but no edges. Lineage of the ranks is cut by a checkpoint every few rounds.
    """
    adjacency = checkpointed(adjacency)
    degree = adjacency.groupBy("src").agg(F.count("*").alias("degree"))
    e = adjacency.join(degree, "src")
    spread = int(adjacency.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = e.repartition(spread, "src").persist(StorageLevel.MEMORY_AND_DISK)
    rank = checkpointed(e.select(F.col("src").alias("node")).distinct())
    count = rank.count()
    rank = rank.withColumn("rank", F.lit(1.0 / max(count, 1)))
    for i in range(iterations):
        flow = e.join(rank, e["src"] == rank["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("in"))
        rank = flow.select(F.col("dst").alias("node"), ((1 - damping) / count + damping * F.col("in")).alias("rank"))
        if (i + 1) % cut_every == 0 or i + 1 == iterations:
            rank = checkpointed(rank)
    e.unpersist()
    return rank


def top_by(rows: DataFrame, by: list[str], order: list[Column], most: int, name: str = "pos") -> DataFrame:
    """The first ``most`` rows of each group in a total order, numbered from 1."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= most)
