"""Coordinates and levels, refinement, architecture deltas, freshness, proof obligations, integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.functions.hashing import canonical_json, canonical_map, fingerprint, json_text
from ripplegraph.operators.hierarchy import resolve_hierarchy
from ripplegraph.runtime import checkpointed

#: Relations that carry impact, relations that refine, relations that carry a rationale.
IMPACT_RELATIONS = ("imports", "depends_on", "calls", "references", "extends", "implements", "tested_by", "covers", "verifies")
REFINING = ("decomposes_to", "realizes", "implements")
RATIONALE = ("serves", "justifies", "preserves")
#: Bounds of traversals by default, and the most that may be asked for.
DEFAULT_BOUNDS = {"max_depth": 8, "max_results": 100, "max_expansions": 10_000, "max_queue": 1_000}
HARD_BOUNDS = {"max_depth": 100, "max_results": 10_000, "max_expansions": 100_000, "max_queue": 10_000}


def bounds(**asked: int) -> dict[str, int]:
    """The bounds asked for, at least 1 and at most the hard limit, defaults elsewhere."""
    return {k: max(1, min(HARD_BOUNDS[k], asked.get(k, v))) for k, v in DEFAULT_BOUNDS.items()}


def semantic_category(kind: Column, level: Column) -> Column:
    """The category of an authored node: by kind first, else by level."""
    by_level = F.when(level == 5, "goal").when(level == 4, "policy").when(level == 3, "capability").when(level == 2, "bounded_context").when(level == 1, "code_entity").when(level == 0, "syntax").otherwise("strategy")
    return F.when((kind == "goal") & (level == 6), "strategy").when(kind.isin("goal", "invariant", "decision"), kind).otherwise(by_level)


def epistemic_status(status: Column, provenance: Column) -> Column:
    """How an authored statement is known."""
    seen = F.when(status == "tested", "test_observed").when(status == "statically_verified", "statically_observed").when(status == "runtime_verified", "dynamically_observed")
    return F.coalesce(seen, F.when(provenance == "author", "human_declared").when(provenance == "derived", "statically_observed").otherwise("llm_inferred"))


def coordinates(nodes: DataFrame, authored: DataFrame) -> DataFrame:
    """(id, plane, source_id, source_kind, level, category, label, epistemic_status) of graph nodes and authored nodes."""
    none = lambda t: F.lit(None).cast(t)
    a = nodes.select(F.concat(F.lit("repo:"), "id").alias("id"), F.lit("A").alias("plane"), F.col("id").alias("source_id"), F.col("kind").alias("source_kind"), none("int").alias("level"), none("string").alias("category"), F.col("name").alias("label"), F.lit("statically_observed").alias("epistemic_status"))
    category = F.when(F.col("level").isNotNull(), semantic_category(F.col("kind"), F.col("level")))
    b = authored.select(F.concat(F.lit("semantic:"), "id").alias("id"), F.lit("B").alias("plane"), F.col("id").alias("source_id"), F.col("kind").alias("source_kind"), "level", category.alias("category"), F.col("statement").alias("label"), epistemic_status(F.col("status"), F.col("provenance")).alias("epistemic_status"))
    return a.unionByName(b).dropDuplicates(["id"])


def structural_edges(coords: DataFrame, edges: DataFrame, relations: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_id, to_id, relation): edges of the graph, authored relations, and resolved links from what they name to their
    owner; both ends must be coordinates."""
    r = lambda c: F.concat(F.lit("repo:"), c)
    s = lambda c: F.concat(F.lit("semantic:"), c)
    file_targets = links.where("kind = 'file'").join(nodes.select(F.col("file_path").alias("ref"), "id"), "ref").select("owner_id", "kind", "id")
    targets = file_targets.unionByName(links.where("kind not in ('file', 'claim', 'evidence')").select("owner_id", "kind", F.col("ref").alias("id")))
    x = reduce(DataFrame.unionByName, (
        edges.select(r("from_id").alias("from_id"), r("to_id").alias("to_id"), F.col("kind").alias("relation")),
        relations.select(s("from_id").alias("from_id"), s("to_id").alias("to_id"), F.col("kind").alias("relation")),
        targets.select(r("id").alias("from_id"), s("owner_id").alias("to_id"), F.concat(F.lit("repository_link:"), "kind").alias("relation")),
    )).distinct()
    ids = coords.select("id")
    return x.join(ids.toDF("from_id"), "from_id", "left_semi").join(ids.toDF("to_id"), "to_id", "left_semi").select("from_id", "to_id", "relation")


def level_coverage(coords: DataFrame) -> DataFrame:
    """(level, categories, n_coordinates) of all levels 0 to 6, empty ones included."""
    g = coords.where("level is not null").groupBy("level").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.count("*").alias("n"))
    levels = coords.sparkSession.range(7).select(F.col("id").cast("int").alias("level"))
    return levels.join(F.broadcast(g), "level", "left").select("level", F.coalesce("categories", F.lit("")).alias("categories"), F.coalesce("n", F.lit(0)).alias("n_coordinates"))


def certifying(relations: DataFrame, evidence: DataFrame, verified: DataFrame) -> DataFrame:
    """Relations that certify: not inferred or hypothetical, with evidence, every digest of which is verified.

    ``evidence`` has (relation_id, digest), ``verified`` digest.
    """
    bad = evidence.join(verified.select("digest").distinct(), "digest", "left_anti").select(F.col("relation_id").alias("id")).distinct()
    has = evidence.select(F.col("relation_id").alias("id")).distinct()
    r = relations.where(~F.col("epistemic_status").isin("llm_inferred", "hypothetical"))
    return r.join(has, "id", "left_semi").join(bad, "id", "left_anti")


def refinement_steps(relations: DataFrame, coords: DataFrame, direction: str) -> DataFrame:
    """(relation_id, src, dst): refining relations turned so that each step lifts, or lowers, by exactly one level.

    ``decomposes_to`` is written downwards, the others upwards.
    """
    r = relations.where(F.col("kind").isin(*REFINING))
    along = (F.col("kind") == "decomposes_to") if direction == "lower" else (F.col("kind") != "decomposes_to")
    s = r.select(F.col("id").alias("relation_id"), F.when(along, F.col("source")).otherwise(F.col("target")).alias("src"), F.when(along, F.col("target")).otherwise(F.col("source")).alias("dst"))
    lv = lambda c: coords.select(F.col("id").alias(c), F.col("level").alias(f"{c}_level"))
    s = s.join(lv("src"), "src").join(lv("dst"), "dst")
    return s.where(F.col("dst_level") - F.col("src_level") == (1 if direction == "lift" else -1)).select("relation_id", "src", "dst")


def traverse_levels(coords: DataFrame, steps: DataFrame, sources: DataFrame, target_level: int, direction: str) -> DataFrame:
    """(source, path array, relations array) of all refinement paths from sources to a level.

    Each step moves one level and there are seven, so the traversal is at most six joins and can meet no cycle.
    """
    sign = 1 if direction == "lift" else -1
    at = sources.select(F.col("id").alias("source")).join(coords.select(F.col("id").alias("source"), "level"), "source").where(F.col("level").isNotNull() & ((F.lit(target_level) - F.col("level")) * sign >= 0))
    at = at.select("source", "level", F.array("source").alias("path"), F.array().cast("array<string>").alias("relations"))
    done = at.where(F.col("level") == target_level)
    for _ in range(6):
        at = at.where(F.col("level") != target_level).join(steps, F.element_at("path", -1) == steps["src"])
        at = at.select("source", (F.col("level") + sign).alias("level"), F.concat("path", F.array("dst")).alias("path"), F.concat("relations", F.array("relation_id")).alias("relations"))
        done = done.unionByName(at.where(F.col("level") == target_level))
    return done.select("source", "path", "relations")


def refinement_gaps(coords: DataFrame, reached: DataFrame, lo: int, hi: int) -> DataFrame:
    """(source, level): levels between lo and hi that the first path from each source does not cover."""
    first = reached.groupBy("source").agg(F.min(F.struct(F.array_join("relations", ",").alias("o"), "path")).alias("p"))
    have = first.select("source", F.explode("p.path").alias("id")).join(coords.select("id", "level"), "id").select("source", "level")
    want = first.select("source", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("level"))
    return want.join(have, ["source", "level"], "left_anti")


def impact_paths(edges: DataFrame, sources: DataFrame, max_depth: int = 8, per_destination: int = 2, max_results: int | None = None) -> DataFrame:
    """(source_set, id, path array): what sources reach over impact relations, at most two paths each, shortest first.

    Level by level with the paths carried along; paths are simple, and ties follow the ids on the path. A deeper path counts
    where a destination holds fewer than ``per_destination``; only paths of a node's least depth go on, and of these no more
    than later levels can tell apart. ``sources`` has source_set and id. ``max_results`` keeps the first destinations in
    order of least depth and id.
    """
    e = checkpointed(edges.where(F.col("relation").isin(*IMPACT_RELATIONS)).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct())
    src = checkpointed(sources.select("source_set", "id").distinct())
    at = src.select("source_set", F.col("id").alias("tail"), F.array("id").alias("path"))
    held = src.select("source_set", F.col("id").alias("tail"), F.lit(per_destination).cast("long").alias("held"))
    found = None
    for depth in range(1, max_depth + 1):
        nxt = at.join(e, at["tail"] == e["src"]).where(~F.array_contains("path", F.col("dst"))).select("source_set", F.col("dst").alias("tail"), F.concat("path", F.array("dst")).alias("path"))
        nxt = checkpointed(nxt.join(held, ["source_set", "tail"], "left").where(F.coalesce("held", F.lit(0)) < per_destination))
        w = W.partitionBy("source_set", "tail").orderBy(F.array_join("path", "\0"))
        hit = nxt.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_destination)
        hit = checkpointed(hit.where(F.col("rn") + F.coalesce("held", F.lit(0)) <= per_destination).select("source_set", F.col("tail").alias("id"), "path", F.lit(depth).alias("depth")))
        if hit.isEmpty():
            break
        found = hit if found is None else found.unionByName(hit)
        now = hit.groupBy("source_set", F.col("id").alias("tail")).agg(F.count("*").alias("held"))
        held = checkpointed(held.unionByName(now).groupBy("source_set", "tail").agg(F.sum("held").alias("held")))
        at = checkpointed(_telling_paths(nxt.where("held is null"), per_destination))
    if found is None:
        return src.limit(0).select("source_set", "id", F.array("id").alias("path"))
    if max_results is not None:
        found = found.withColumn("first", F.min("depth").over(W.partitionBy("source_set", "id")))
        found = found.withColumn("rk", F.dense_rank().over(W.partitionBy("source_set").orderBy("first", "id"))).where(F.col("rk") <= max_results)
    return found.select("source_set", "id", "path")


def _telling_paths(paths: DataFrame, k: int) -> DataFrame:
    """Paths (source_set, tail, path) without those that no continuation needs.

    A path goes on to x only if it avoids x, so what counts are the first ``k`` paths that avoid x, for every x. In order, a
    path is kept if it avoids a node that fewer than ``k`` kept ones avoid; such a node is on one of the first ``k``. Salted
    first, as what is kept of parts holds all that is kept of the whole.
    """
    few = lambda kept, x: F.size(F.filter(kept, lambda q: ~F.array_contains(q, x))) < k
    needed = lambda kept, p: F.exists(F.array_except(F.flatten(F.slice(kept, 1, k)), p), lambda x: few(kept, x))
    keep = F.aggregate(F.array_sort(F.collect_list("path")), F.array().cast("array<array<string>>"), lambda kept, p: F.when((F.size(kept) < k) | needed(kept, p), F.concat(kept, F.array(p))).otherwise(kept))
    x = paths.groupBy("source_set", "tail", F.pmod(F.xxhash64("path"), F.lit(64)).alias("salt")).agg(keep.alias("p"))
    x = x.select("source_set", "tail", F.explode("p").alias("path")).groupBy("source_set", "tail").agg(keep.alias("p"))
    return x.select("source_set", "tail", F.explode("p").alias("path"))


def explain_why(coords: DataFrame, edges: DataFrame, sources: DataFrame, max_depth: int = 8) -> DataFrame:
    """(source, rationale, path array): authored goals, invariants, decisions, policies and strategies that a coordinate
    serves, justifies or preserves, directly or through others. A path ends at the first of them."""
    why = coords.where((F.col("plane") == "B") & F.col("category").isin("goal", "invariant", "decision", "policy", "strategy")).select(F.col("id").alias("tail"), F.lit(True).alias("why"))
    e = checkpointed(edges.where(F.col("relation").isin(*RATIONALE)).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct())
    at = checkpointed(sources.select(F.col("id").alias("source"), F.col("id").alias("tail"), F.array("id").alias("path")).join(why, "tail", "left"))
    found, seen = at.where("why"), at.select("source", "tail")
    for _ in range(max_depth):
        at = at.where("why is null").join(e, F.col("tail") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        at = at.select("source", F.col("dst").alias("tail"), F.concat("path", F.array("dst")).alias("path")).join(seen, ["source", "tail"], "left_anti")
        at = checkpointed(at.join(why, "tail", "left"))
        if at.isEmpty():
            break
        found = found.unionByName(at.where("why"))
        seen = checkpointed(seen.unionByName(at.where("why is null").select("source", "tail").distinct()))
    return found.select("source", F.col("tail").alias("rationale"), "path")


def decorations(relations: DataFrame, visited: DataFrame, kind: str) -> DataFrame:
    """Certifying relations of a kind that start at a visited coordinate."""
    return relations.where(F.col("kind") == kind).join(visited.select(F.col("id").alias("source")), "source", "left_semi")


def graph_fingerprint(coords: DataFrame, edges: DataFrame, domain: str = "coordinates:v1") -> DataFrame:
    """One fingerprint of all coordinates and edges, whatever order they come in."""
    c = coords.select(F.col("id").alias("k"), F.to_json(F.struct(*sorted(coords.columns))).alias("p"))
    e = edges.select(F.concat_ws("\0", "from_id", "to_id", "relation").alias("k"), F.lit("edge").alias("p"))
    return fingerprint(c.unionByName(e), [], F.col("k"), F.col("p"), domain)


def architecture(coords: DataFrame, edges: DataFrame, metadata: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Elements (id, level, category, fingerprint) with a level, and relations (from_id, to_id, relation, fingerprint) between them."""
    c = coords if metadata is None else coords.join(metadata, "id", "left")
    meta = F.lit("{}") if metadata is None else canonical_map(F.col("metadata"))
    print_ = canonical_json(category=json_text(F.col("category")), epistemicStatus=json_text(F.col("epistemic_status")), label=json_text(F.col("label")), level=F.col("level").cast("string"), metadata=meta, sourceKind=json_text(F.col("source_kind")))
    elements = c.where("level is not null and category is not null").select("id", "level", "category", print_.alias("fingerprint"))
    ids = elements.select("id")
    r = edges.join(ids.toDF("from_id"), "from_id", "left_semi").join(ids.toDF("to_id"), "to_id", "left_semi")
    return elements, r.select("from_id", "to_id", "relation", F.sha2("relation", 256).alias("fingerprint"))


def compare_elements(current: DataFrame, target: DataFrame) -> DataFrame:
    """(id, change, invariant): elements added, removed or changed; invariant if either side is a policy, an invariant or at level 4."""
    side = lambda df, p: df.select("id", *(F.col(c).alias(f"{p}_{c}") for c in ("level", "category", "fingerprint")))
    x = side(current, "a").join(side(target, "b"), "id", "full")
    change = F.when(F.col("a_fingerprint").isNull(), "added").when(F.col("b_fingerprint").isNull(), "removed").when(F.col("a_fingerprint") != F.col("b_fingerprint"), "changed")
    inv = lambda p: F.coalesce((F.col(f"{p}_level") == 4) | F.col(f"{p}_category").isin("invariant", "policy"), F.lit(False))
    return x.select("id", change.alias("change"), (inv("a") | inv("b")).alias("invariant")).where("change is not null")


def compare_relations(current: DataFrame, target: DataFrame) -> DataFrame:
    """(from_id, to_id, relation, change) by the key of all three."""
    key = ["from_id", "to_id", "relation"]
    x = current.withColumnRenamed("fingerprint", "a").join(target.withColumnRenamed("fingerprint", "b"), key, "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return x.select(*key, change.alias("change")).where("change is not null")


#: Fixed values: (reason, current field, indexed field) in order of precedence.
MISMATCHES = (
    ("REPOSITORY_ROOT_MISMATCH", "root", "indexed_root"), ("HEAD_MISMATCH", "head", "indexed_head"), ("REPOSITORY_GRAPH_MISMATCH", "graph_hash", "indexed_graph_hash"),
    ("SEMANTIC_MODEL_MISMATCH", "model_hash", "indexed_model_hash"), ("ANALYSIS_INPUT_MISMATCH", "input_hash", "indexed_input_hash"), ("WORKING_DIFF_MISMATCH", "diff_hash", "indexed_diff_hash"),
    ("STORE_SCHEMA_MISMATCH", "store_version", "indexed_store_version"), ("TOOL_VERSION_MISMATCH", "tool_version", "indexed_tool_version"),
)


def classify_freshness(seals: DataFrame, clean_diff: str) -> DataFrame:
    """(seal_id, verdict, reasons): UNSEALED without an index or a known state, else STALE with every mismatch in order,
    else FRESH if the working diff is the clean one, else DIRTY_KNOWN."""
    null = lambda *cs: reduce(Column.__or__, (F.col(c).isNull() for c in cs))
    missing = null("indexed_root", "indexed_graph_hash", "indexed_model_hash", "indexed_input_hash", "indexed_at", "indexed_tool_version")
    unknown = F.array_compact(F.array(F.when(null("head", "indexed_head", "diff_hash", "indexed_diff_hash"), F.lit("GIT_STATE_UNAVAILABLE")), F.when(null("store_version", "indexed_store_version"), F.lit("STORE_SCHEMA_UNAVAILABLE"))))
    differ = F.array_compact(F.array(*(F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(r)) for r, a, b in MISMATCHES)))
    clean = F.col("diff_hash") == clean_diff
    verdict = F.when(missing | (F.size(unknown) > 0), "UNSEALED").when(F.size(differ) > 0, "STALE").when(clean, "FRESH").otherwise("DIRTY_KNOWN")
    reasons = F.when(missing, F.array(F.lit("INDEX_SNAPSHOT_MISSING"))).when(F.size(unknown) > 0, unknown).when(F.size(differ) > 0, differ).when(clean, F.array().cast("array<string>")).otherwise(F.array(F.lit("WORKING_TREE_DIRTY")))
    return seals.select("seal_id", verdict.alias("verdict"), F.array_join(reasons, ",").alias("reasons"))


def attestations_in_force(attestations: DataFrame) -> DataFrame:
    """Attestations with their freshness: observed not after, and expiring not before, the time of evaluation; texts that
    are no timestamps make them stale."""
    t = lambda c: F.try_to_timestamp(F.col(c).cast("string"))
    ok = (t("observed_at") <= t("evaluated_at")) & (t("evaluated_at") <= t("expires_at"))
    return attestations.withColumn("fresh", F.coalesce(ok, F.lit(False)))


#: What can be asked to be proved.
OBLIGATIONS = (
    "baseline_captured", "behavior_characterized", "target_reviewed", "replacement_present", "shadow_equivalent", "cutover_approved", "observation_window_passed", "static_dependencies_zero", "runtime_dependencies_zero",
    "invariants_preserved", "data_migration_complete", "rollback_ready", "deletion_approved",
)
#: What has to be proved before a deletion may be approved.
BEFORE_DELETION = (
    "replacement_present", "shadow_equivalent", "cutover_approved", "observation_window_passed", "static_dependencies_zero", "runtime_dependencies_zero", "invariants_preserved", "data_migration_complete", "rollback_ready",
)
#: Fixed values: (obligation, clause, status, kind of reference): an obligation holds if each clause is met by one of its
#: statuses, with such a reference where one is named.
MATRIX = (
    ("baseline_captured", 0, "statically_observed", ""), ("baseline_captured", 0, "dynamically_observed", ""), ("behavior_characterized", 0, "test_observed", ""), ("behavior_characterized", 0, "dynamically_observed", ""),
    ("target_reviewed", 0, "human_declared", "architecture"), ("replacement_present", 0, "statically_observed", ""), ("shadow_equivalent", 0, "test_observed", ""), ("shadow_equivalent", 1, "dynamically_observed", ""),
    ("cutover_approved", 0, "human_declared", ""), ("cutover_approved", 1, "test_observed", ""), ("cutover_approved", 1, "dynamically_observed", ""), ("observation_window_passed", 0, "dynamically_observed", ""),
    ("static_dependencies_zero", 0, "statically_observed", ""), ("runtime_dependencies_zero", 0, "dynamically_observed", ""), ("invariants_preserved", 0, "test_observed", ""),
    ("data_migration_complete", 0, "dynamically_observed", ""), ("data_migration_complete", 0, "test_observed", ""), ("rollback_ready", 0, "test_observed", ""), ("deletion_approved", 0, "human_declared", ""),
)


def sufficiency(spark: SparkSession) -> DataFrame:
    """The matrix as (obligation, clause, status, kinds)."""
    return spark.createDataFrame(MATRIX, "obligation string, clause int, status string, kinds string")


def with_prerequisites(asked: DataFrame, needs: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``asked`` (subject, obligation) with all that its obligations need first, directly or through others."""
    needs = {"deletion_approved": BEFORE_DELETION} if needs is None else needs
    whole: dict[str, set[str]] = {}
    for o in needs:  # a small configured table
        seen, todo = {o}, [o]
        while todo:
            todo += [x for x in needs.get(todo.pop(), ()) if x not in seen and not seen.add(x)]
        whole[o] = seen
    more = F.coalesce(*(F.when(F.col("obligation") == o, F.array(*(F.lit(x) for x in sorted(xs)))) for o, xs in whole.items()), F.array("obligation")) if whole else F.array("obligation")
    return asked.select("subject", F.explode(more).alias("obligation")).distinct()


def evaluate_obligations(asked: DataFrame, clauses: DataFrame, attestations: DataFrame) -> DataFrame:
    """(subject, obligation, satisfied, reasons): an obligation holds if each of its clauses is met by a usable attestation.

    ``asked`` has subject, obligation and commit_id; ``clauses`` (obligation, clause, status, kinds); ``attestations`` (subject,
    obligation, commit_id, epistemic_status, reference_kind, non_llm, fresh), a row a reference. Usable are attestations of
    the subject and commit, fresh, neither inferred nor supposed, with a reference that no model wrote. Reasons: none at all,
    of another subject or commit, all stale, or of too little weight. An obligation without clauses is never satisfied.
    """
    a = attestations.withColumn("sure", ~F.col("epistemic_status").isin("llm_inferred", "hypothetical"))
    any_ = a.groupBy("obligation").agg(F.lit(True).alias("known"))
    q = asked.select("subject", "obligation", "commit_id").distinct()
    own = q.join(a.withColumnRenamed("commit_id", "of"), ["subject", "obligation"], "left")
    here = F.coalesce(F.col("of") == F.col("commit_id"), F.lit(False))
    usable = here & F.col("sure") & F.col("fresh") & F.col("non_llm")
    some = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    g = own.groupBy("subject", "obligation", "commit_id").agg(
        some(F.col("of").isNotNull()).alias("own"), some(here).alias("here"), some(here & F.col("sure")).alias("sure"), some(here & F.col("sure") & F.col("fresh")).alias("live")
    )
    c = F.broadcast(clauses)  # a configured table of a few rows an obligation
    met = own.where(usable).join(c, "obligation").where((F.col("epistemic_status") == F.col("status")) & ((F.col("kinds") == "") | (F.col("kinds") == F.col("reference_kind")))).select("subject", "obligation", "commit_id", "clause").distinct()
    met = met.groupBy("subject", "obligation", "commit_id").agg(F.count("*").alias("met"))
    want = clauses.groupBy("obligation").agg(F.count_distinct("clause").alias("want"))
    x = g.join(met, ["subject", "obligation", "commit_id"], "left").join(F.broadcast(want), "obligation", "left").join(F.broadcast(any_), "obligation", "left")
    ok = F.coalesce(F.col("met") == F.col("want"), F.lit(False))
    known = F.coalesce("known", F.lit(False))
    why = F.array_compact(F.array(
        F.when(~known, "proof_missing"), F.when(known & ~F.col("own"), "proof_subject_mismatch"), F.when(known & ~F.col("here"), "proof_commit_mismatch"), F.when(F.col("sure") & ~F.col("live"), "proof_stale"),
    ))
    reasons = F.when(ok, F.array().cast("array<string>")).when(F.size(why) > 0, F.array_sort(why)).otherwise(F.array(F.lit("proof_epistemically_insufficient")))
    return x.select("subject", "obligation", "commit_id", ok.alias("satisfied"), reasons.alias("reasons"))


#: Fixed values: (profile, kind, from, to, risk, least obligations) of the steps of a plan, in order.
PROFILES = (
    ("capture_baseline", "capture", "OBSERVED", "MODELED", "R0", ("baseline_captured",)), ("characterize_behavior", "characterize", "MODELED", "TARGET_PROPOSED", "R0", ("behavior_characterized",)),
    ("define_target_proofs", "introduce", "TARGET_PROPOSED", "PROOFS_DEFINED", "R1", ("target_reviewed",)), ("introduce_parallel", "introduce", "PROOFS_DEFINED", "PARALLEL_IMPLEMENTATION", "R1", ("replacement_present",)),
    ("shadow_validate", "shadow_compare", "PARALLEL_IMPLEMENTATION", "SHADOW_VALIDATED", "R2", ("shadow_equivalent", "invariants_preserved", "rollback_ready")),
    ("cutover_replacement", "cutover", "SHADOW_VALIDATED", "CUTOVER", "R3", ("cutover_approved", "invariants_preserved", "rollback_ready")),
    ("observe_cutover", "observe", "CUTOVER", "LEGACY_REMOVABLE", "R2", ("observation_window_passed", "rollback_ready")), ("authorize_deletion", "deletion_check", "LEGACY_REMOVABLE", "DELETED", "R3", (*BEFORE_DELETION, "deletion_approved")),
)
#: Reasons that a traversal may end with, by its status.
TERMINAL_REASONS = {"success": (), "budget_exhausted": ("BUDGET_EXHAUSTED",), "refused": ("INDEX_STALE",), "empty": ("COORDINATE_UNKNOWN", "MAPPING_MISSING", "REFINEMENT_DISCONNECTED")}
#: Reasons of a freshness status in canonical order.
UNSEALED_REASONS = ("REPOSITORY_NOT_INITIALIZED", "REPOSITORY_NOT_INDEXED", "INDEX_SNAPSHOT_MISSING", "INDEX_SNAPSHOT_INVALID", "GIT_STATE_UNAVAILABLE", "STORE_SCHEMA_UNAVAILABLE")
STALE_REASONS = tuple(m[0] for m in MISMATCHES)
REASON_ORDER = (*UNSEALED_REASONS, *STALE_REASONS, "WORKING_TREE_DIRTY")


def profiles(spark: SparkSession) -> DataFrame:
    """The steps of a plan as (ord, profile, kind, from_state, to_state, risk, obligations)."""
    return spark.createDataFrame([(k, *p[:5], list(p[5])) for k, p in enumerate(PROFILES)], "ord int, profile string, kind string, from_state string, to_state string, risk string, obligations array<string>")


def _listed(values: tuple[str, ...]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def verification_baseline(recorded: DataFrame) -> DataFrame:
    """(repo, baseline) of (repo, recorded JSON text, head, state_hash as they are now): missing, invalid, stale or valid."""
    r = F.from_json("recorded", "version int, headCommit string, workingStateHash string, verdict string, recordedAt string")
    whole = (r["version"] == 2) & r["headCommit"].rlike("^[0-9a-f]{40,64}$") & r["workingStateHash"].rlike("^sha256:[0-9a-f]{64}$") & r["verdict"].isin("PASS", "WARN", "BLOCK") & F.try_to_timestamp(r["recordedAt"]).isNotNull()
    known = F.coalesce(whole, F.lit(False)) & F.col("head").isNotNull() & F.col("state_hash").isNotNull()
    same = (r["headCommit"] == F.col("head")) & (r["workingStateHash"] == F.col("state_hash"))
    return recorded.select("repo", F.when(F.col("recorded").isNull(), "missing").when(~known, "invalid").when(same, "valid").otherwise("stale").alias("baseline"))


def violations(**tables: DataFrame) -> DataFrame:
    """(rule, subject) of broken constraints among the tables given; none where all holds.

    ``elements`` and ``relations``: ends exist, category and level both or neither. ``coordinates`` (id, plane): the id is its
    plane's. ``attestations``: expiry not before observation. ``steps`` (plan, ord, id, depends_on): each depends on the one
    before, the first on none, and none on itself through others. ``plan_steps`` (id, profile, kind, from_state, to_state, risk,
    rollback, obligations): as its profile says, with a way back where the risk asks for one. ``plans`` (id, status, reason,
    n_details, has_target, change_id, context_id, commit_id, current_commit, n_steps): what its status asks for. ``paths``
    (path_id, nodes, edges): one edge fewer than nodes. ``budgets`` (id, most, consumed, remaining): consumed and remaining are
    all. ``lists`` (list_id, items): unique and in order. ``changes`` (change_id, before_id, after_id): one id on both sides.
    ``statuses`` (id, verdict, reasons, allowed, sealed): reasons unique, in order and the verdict's, and, where ``seals``
    (id, verdict, reasons) are given, those of the seal. ``coverages`` (id, covered, missing): disjoint. ``terminals`` (id,
    status, reason): the reason is the status's. ``envelopes`` (id, verdict, status, reasons, has_payload): refused where
    stale. ``digests`` (id, stored, computed): equal. A link of ``steps`` with null ends is no dependency.
    """
    out = []
    add = lambda rule, df, c: out.append(df.select(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("subject")))
    if "elements" in tables and "relations" in tables:
        for end in ("from_id", "to_id"):
            add(f"relation_{end}_is_element", tables["relations"].join(tables["elements"].select(F.col("id").alias(end)), end, "left_anti"), end)
        add("level_and_category_go_together", tables["elements"].where(F.col("level").isNull() != F.col("category").isNull()), "id")
    if (t := tables.get("coordinates")) is not None:
        prefix = F.when(F.col("plane") == "observed", "sha256:").otherwise(F.concat("plane", F.lit(":")))
        add("id_is_of_its_plane", t.where(~F.startswith("id", prefix)), "id")
    if (t := tables.get("attestations")) is not None:
        add("expiry_not_before_observation", t.where("expires_at < observed_at"), "id")
    if (t := tables.get("steps")) is not None:
        before = F.lag("id").over(W.partitionBy("plan").orderBy("ord"))
        add("step_depends_on_the_one_before", t.withColumn("_b", before).where(~F.col("_b").eqNullSafe(F.col("depends_on"))), "id")
        loops = resolve_hierarchy(t.select("plan", F.col("id").alias("child"), F.col("depends_on").alias("parent")), "plan")
        add("steps_are_no_cycle", loops.where("depth = -1"), "node_id")
    if (t := tables.get("plan_steps")) is not None:
        p = F.broadcast(profiles(t.sparkSession).select("profile", *(F.col(c).alias(f"_{c}") for c in ("kind", "from_state", "to_state", "risk", "obligations"))))  # eight rows
        x = t.join(p, "profile", "left")
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("kind", "from_state", "to_state", "risk")))
        add("step_is_as_its_profile", x.where(F.col("_kind").isNull() | ~same), "id")
        add("profile_obligations_are_there", x.where(same & (F.size(F.array_except("_obligations", "obligations")) > 0)), "id")
        risky = F.col("risk").isin("R2", "R3")
        add("risk_has_a_rollback", t.where(risky & F.col("rollback").isNull()), "id")
        add("risk_has_rollback_ready", t.where(risky & ~F.array_contains("obligations", "rollback_ready")), "id")
    if (t := tables.get("plans")) is not None:
        ready, blocked = F.col("status") == "READY", F.col("status") == "BLOCKED"
        add("blocked_plan_says_why", t.where(blocked & (F.col("reason").isNull() | (F.col("n_details") == 0))), "id")
        add("ready_plan_is_not_blocked", t.where(ready & (F.col("reason").isNotNull() | (F.col("n_details") > 0))), "id")
        add("ready_plan_is_whole", t.where(ready & (~F.col("has_target") | (F.col("n_steps") != len(PROFILES)))), "id")
        add("plan_is_of_its_change", t.where(F.col("change_id") != F.col("context_id")), "id")
        add("plan_is_of_its_commit", t.where(F.col("commit_id") != F.col("current_commit")), "id")
    if (t := tables.get("paths")) is not None:
        add("path_has_one_edge_fewer_than_nodes", t.where("size(edges) <> size(nodes) - 1"), "path_id")
    if (t := tables.get("budgets")) is not None:
        add("budget_adds_up", t.where("consumed + remaining <> most"), "id")
    if (t := tables.get("lists")) is not None:
        add("list_is_unique_and_in_order", t.where(F.col("items") != F.array_sort(F.array_distinct("items"))), "list_id")
    if (t := tables.get("changes")) is not None:
        add("change_keeps_its_id", t.where("before_id <> after_id"), "change_id")
    if (t := tables.get("statuses")) is not None:
        order = F.transform("reasons", lambda r: F.array_position(_listed(REASON_ORDER), r))
        add("reasons_are_unique_and_in_order", t.where(order != F.array_sort(F.array_distinct(order))), "id")
        of = F.when(F.col("verdict") == "FRESH", _listed(())).when(F.col("verdict") == "DIRTY_KNOWN", _listed(("WORKING_TREE_DIRTY",))).when(F.col("verdict") == "STALE", _listed(STALE_REASONS)).otherwise(_listed(UNSEALED_REASONS))
        lacking = (F.col("verdict") != "FRESH") & (F.size("reasons") == 0)
        add("reasons_are_the_verdicts", t.where(lacking | (F.size(F.array_except("reasons", of)) > 0)), "id")
        add("only_fresh_or_known_is_allowed", t.where(F.col("allowed") != F.col("verdict").isin("FRESH", "DIRTY_KNOWN")), "id")
        add("only_unsealed_has_no_seal", t.where(~F.col("sealed") & (F.col("verdict") != "UNSEALED")), "id")
        if "seals" in tables:
            s = tables["seals"].select("id", F.col("verdict").alias("_v"), F.col("reasons").alias("_r"))
            add("status_is_that_of_the_seal", t.where("sealed").join(s, "id").where((F.col("verdict") != F.col("_v")) | (F.array_join("reasons", ",") != F.col("_r"))), "id")
    if (t := tables.get("coverages")) is not None:
        add("covered_and_missing_are_disjoint", t.where(F.arrays_overlap("covered", "missing")), "id")
    if (t := tables.get("terminals")) is not None:
        fits = reduce(Column.__or__, ((F.col("status") == s) & (F.col("reason").isNull() if not rs else F.col("reason").isNotNull() & F.col("reason").isin(*rs)) for s, rs in TERMINAL_REASONS.items()))
        add("reason_is_the_statuss", t.where(~F.coalesce(fits, F.lit(False))), "id")
    if (t := tables.get("envelopes")) is not None:
        add("stale_queries_refuse", t.where(F.col("verdict").isin("STALE", "UNSEALED") & ((F.col("status") != "refused") | ~F.array_contains("reasons", "INDEX_STALE"))), "id")
        add("success_has_a_payload", t.where((F.col("status") == "success") & ~F.col("has_payload")), "id")
    if (t := tables.get("digests")) is not None:
        add("digest_is_recomputable", t.where(~F.col("stored").eqNullSafe(F.col("computed"))), "id")
    return reduce(DataFrame.unionByName, out)


def evidence_set_digest(rows: DataFrame, by: str) -> DataFrame:
    """(by, digest) of each group's references (kind, locator, digest): the hash of their canonical JSON, each once and in order."""
    one = F.concat(F.lit('{"digest":'), json_text(F.col("digest")), F.lit(',"kind":'), json_text(F.col("kind")), F.lit(',"locator":'), json_text(F.col("locator")), F.lit("}"))
    x = rows.select(by, "kind", "locator", "digest", one.alias("j")).distinct()
    g = x.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "locator", "digest", "j"))), lambda r: r["j"]), ",").alias("j"))
    return g.select(by, F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("["), "j", F.lit("]")), 256)).alias("digest"))
