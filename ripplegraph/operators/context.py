"""Context packs: what to read, prove and run for one task, with reasons. Every part is a frame, evidence joined last."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.functions.ids import slugify
from ripplegraph.functions.paths import normalize_path
from ripplegraph.functions.scoring import POLICIES, by_status, clamp01, classify_question, reachability, role_match, weighted
from ripplegraph.operators import claims as cl
from ripplegraph.operators.graph import bfs, is_deprecated, oriented, simple_paths, top_by
from ripplegraph.operators.retrieval import lexical_entrypoints
from ripplegraph.operators.versions import evidence_id
from ripplegraph.runtime import BROADCAST_ROWS, broadcast_if_small, checkpointed, stored
from ripplegraph.sources.files import detect_mode

#: Edges that reach, hops that count, and the limits of a pack.
REACHING = ["calls", "implements_capability", "constrained_by", "tested_by", "covers", "declares", "related_to", "documents", "decides", "references"]
MAX_HOPS, MOST_CLAIMS, MOST_SECONDARY, MOST_PATHS, FAR = 4, 10, 15, 6, 99
PRIORITY = {"critical": 3, "high": 2, "medium": 1}
CONCURRENCY = "(?i)concurr|race|lock|atomic"


TASKS = "task_id string, text string, question string, mode string, capabilities array<string>, invariants array<string>, contexts array<string>, expected array<string>, observed array<string>, risks array<string>"
RACE_UNKNOWN = "Static analysis cannot prove a concurrency race; confirm the behaviour by running or reading the affected path under concurrent execution."


@dataclass
class Task:
    text: str
    question: str = "business_rule"
    mode: str = "feature"
    capabilities: list[str] = field(default_factory=list)
    invariants: list[str] = field(default_factory=list)
    contexts: list[str] = field(default_factory=list)
    risks: list[str] = field(default_factory=list)
    expected: list[str] = field(default_factory=list)
    observed: list[str] = field(default_factory=list)


def complete(tasks: DataFrame) -> DataFrame:
    """``tasks`` with all columns of TASKS: lists that are missing or null are empty, the question follows from mode and text."""
    none = F.array().cast("array<string>")
    lists = ("capabilities", "invariants", "contexts", "expected", "observed", "risks")
    has = lambda c: F.col(c) if c in tasks.columns else F.lit(None).cast("string")
    mode = F.coalesce(has("mode"), detect_mode(F.col("text")))
    return tasks.select(
        F.col("task_id").cast("string").alias("task_id"), "text", F.coalesce(has("question"), classify_question(mode, F.col("text"))).alias("question"), mode.alias("mode"),
        *(F.coalesce(F.col(c), none).alias(c) if c in tasks.columns else none.alias(c) for c in lists),
    )


def hypotheses(tasks: DataFrame) -> DataFrame:
    """(task_id, pos, statement, confidence): what a task supposes, unverified: that its first capability breaks its first
    invariant (a bugfix), its first risk, else that its first capability is what the change is about."""
    cap, inv, risk = (F.get(c, 0) for c in ("capabilities", "invariants", "risks"))
    breaks = F.when((F.col("mode") == "bugfix") & cap.isNotNull() & inv.isNotNull(), F.concat(F.lit('The "'), cap, F.lit('" path can violate invariant "'), inv, F.lit('" under the reported conditions.')))
    risky = F.concat(F.lit("Risk surface: "), risk, F.lit("."))
    about = F.when(breaks.isNull() & risky.isNull(), F.concat(F.lit('The change primarily affects the "'), cap, F.lit('" capability.')))
    some = F.array_compact(F.array(*(F.when(t.isNotNull(), F.struct(t.alias("statement"), F.lit(c).alias("confidence"))) for t, c in ((breaks, 0.5), (risky, 0.4), (about, 0.5)))))
    return tasks.select("task_id", F.posexplode(some).alias("pos", "h")).select("task_id", "pos", "h.statement", "h.confidence")


def _named(tasks: DataFrame, column: str, prefix: str) -> DataFrame:
    """(task_id, name, id): what a task names, and the node id that makes."""
    x = tasks.select("task_id", F.explode(F.array_distinct(column)).alias("name"))
    return x.select("task_id", "name", F.concat(F.lit(prefix), slugify("name")).alias("id"))


def entrypoints(tasks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(task_id, id): nodes that implement a task's capabilities or are bound by its invariants; of tasks without any, those
    that the words of its text, behaviours and capabilities name."""
    ids = nodes.select("id")
    at = lambda df, kind: df.select("task_id", F.col("id").alias("to_id")).join(edges.where(F.col("kind") == kind).select("to_id", F.col("from_id").alias("id")), "to_id").select("task_id", "id")
    marked = at(_named(tasks, "capabilities", "cap:"), "implements_capability").unionByName(at(_named(tasks, "invariants", "inv:"), "constrained_by"))
    marked = checkpointed(marked.join(ids, "id", "left_semi").distinct())
    words = F.concat_ws(" ", "text", "expected", "observed", "capabilities")
    rest = tasks.join(marked.select("task_id"), "task_id", "left_anti").select("task_id", words.alias("text"))
    return checkpointed(marked.select("task_id", "id").unionByName(lexical_entrypoints(nodes, rest)))


def hops_by_start(entry: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, id, hop): least hops from each entry point, searched once however many tasks have it. A task's hops are the
    least of its entry points'."""
    hops = bfs(nodes, oriented(edges, REACHING, "both"), entry.select(F.col("id").alias("seed_set"), "id").distinct(), MAX_HOPS)
    return stored(hops.select(F.col("seed_set").alias("start"), "id", "hop"))


def least_hops(ids: DataFrame, entry: DataFrame, hops: DataFrame) -> DataFrame:
    """``ids`` (task_id, id and more) with ``hop``, the least from an entry point of the task; null where none reaches the node.

    A task's ids times its entry points are far more rows than either, so they are never paired: a node comes with the numbers
    and hops of all starts that reach it, a task with the numbers of its own.
    """
    number = checkpointed(entry.select(F.col("id").alias("start")).distinct().withColumn("no", F.monotonically_increasing_id()))
    own = entry.select("task_id", F.col("id").alias("start")).join(broadcast_if_small(number), "start").groupBy("task_id").agg(F.collect_set("no").alias("starts"))
    own = F.broadcast(own) if entry.limit(5 * BROADCAST_ROWS + 1).count() <= 5 * BROADCAST_ROWS else own  # 8 bytes an entry point
    reaching = hops.join(broadcast_if_small(number), "start").groupBy("id").agg(F.collect_list(F.struct("no", "hop")).alias("reaching"))
    least = F.array_min(F.transform(F.filter("reaching", lambda x: F.array_contains("starts", x["no"])), lambda x: x["hop"]))
    return ids.join(reaching, "id", "left").join(own, "task_id", "left").withColumn("hop", least).drop("reaching", "starts")


def nearest_others(entry: DataFrame, near: DataFrame, shown: DataFrame, most: int = MOST_SECONDARY) -> DataFrame:
    """(task_id, id, hop): nodes in reach of a task that it does not show elsewhere, at least its ``most`` nearest, but none
    further away than those need: a task goes on to the next hop only while it has fewer.

    ``near`` has (start, id, hop), ``shown`` (task_id, id), the entry points among them.
    """
    left, found = entry.select("task_id", F.col("id").alias("start")), None
    for depth in range(1, MAX_HOPS + 1):
        step = left.join(near.where(F.col("hop") == depth).select("start", "id"), "start").select("task_id", "id").distinct()
        step = step.join(shown, ["task_id", "id"], "left_anti").withColumn("hop", F.lit(depth))
        step = checkpointed(step if found is None else step.join(found.select("task_id", "id"), ["task_id", "id"], "left_anti"))
        found = step if found is None else found.unionByName(step)
        enough = found.groupBy("task_id").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("task_id")
        left = checkpointed(left.join(enough, "task_id", "left_anti"))
        if depth == MAX_HOPS or left.isEmpty():
            break
    return found


def reasons(wanted: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``wanted`` (id, kind, on_path and more) with the reason for each node in one line."""
    name = nodes.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"))
    linked = edges.where("kind in ('implements_capability', 'constrained_by', 'tested_by')").join(wanted.select(F.col("id").alias("from_id")).distinct(), "from_id", "left_semi").join(name, "to_id", "left")
    names = lambda kind: F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("kind") == kind) & (F.col("to_name") != ""), F.struct("id", "to_name")))), lambda x: x["to_name"]), ", ")
    g = linked.groupBy(F.col("from_id").alias("id")).agg(names("implements_capability").alias("caps"), names("constrained_by").alias("invs"), F.count_if(F.col("kind") == "tested_by").alias("tests"))
    parts = F.array_compact(F.array(
        F.when(F.col("caps") != "", F.concat(F.lit('implements capability "'), "caps", F.lit('"'))), F.when(F.col("invs") != "", F.concat(F.lit('constrained by invariant "'), "invs", F.lit('"'))),
        F.when(F.col("tests") > 0, F.concat(F.lit("covered by "), F.col("tests").cast("string"), F.lit(" test(s)"))), F.when(F.col("on_path"), F.lit("on the task's primary call path")),
        F.when(F.col("kind") == "migration", F.lit("defines the persistence schema for the invariant")), F.when(F.col("kind") == "invariant", F.lit("is a hard, non-negotiable domain invariant")),
    ))
    reason = F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(F.concat("kind", F.lit(" relevant to the task")))
    return wanted.join(g, "id", "left").withColumn("reason", reason).drop("caps", "invs", "tests")


def _judged(x: DataFrame) -> DataFrame:
    """Eligible rows of (question, with_entry, code, hop, claim columns), with their score."""
    policy = lambda i: F.create_map(*(y for q, p in POLICIES.items() for y in (F.lit(q), F.array(*(F.lit(v) for v in p[i] or ())).cast("array<string>"))))[F.col("question")]
    st, required = F.col("verification_status"), policy(1)
    ok = ~F.array_contains(policy(2), st) & ~st.isin("deprecated", "contradicted") & ((F.size(required) == 0) | F.array_contains(required, st))
    reach = F.when(F.col("hop").isNotNull(), reachability(F.col("hop"))).when(F.col("code"), 0.0).otherwise(0.3)
    raw = weighted(role_match(F.col("kind"), policy(0)), F.col("authority"), reach, by_status(st, 1), F.col("freshness"), F.lit(False))
    return x.where(ok & (~F.col("code") | ~F.col("with_entry") | F.col("hop").isNotNull())).withColumn("score", clamp01(raw))


def chosen_claims(tasks: DataFrame, entry: DataFrame, hops: DataFrame, claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """(task_id, claim_id, kind, score): of each task all invariants its gates let through, and the best of the other claims.

    A task meets the claims it reaches by their subjects. What no task has to reach (claims without code, and all claims where
    a task has no entry point) has one score a question, so those are ranked once a question and context, and a task looks
    only at as many of the first as it may need. Invariants without code are let through for every task alike; they are
    listed once a question by ``common_invariants``, not again for every task.
    """
    t = tasks.join(entry.select("task_id").distinct().withColumn("with_entry", F.lit(True)), "task_id", "left").select("task_id", "question", "contexts", F.coalesce("with_entry", F.lit(False)).alias("with_entry"))
    c = _with_subjects(claims, nodes)
    subject = claims.select(F.col("id").alias("claim_id"), F.explode("subject_node_ids").alias("id")).distinct()
    reached = hops.join(subject, "id").groupBy("start", "claim_id").agg(F.min("hop").alias("hop"))
    reached = entry.select("task_id", F.col("id").alias("start")).distinct().join(reached, "start").groupBy("task_id", "claim_id").agg(F.min("hop").alias("hop"))
    reached = checkpointed(reached)
    inside = (F.size("contexts") == 0) | (F.size("places") == 0) | F.arrays_overlap("contexts", "places")
    met = checkpointed(_judged(reached.join(t, "task_id").join(c, "claim_id").where(inside)).select("task_id", "claim_id", "kind", "score"))
    seen = reached.groupBy("task_id").agg(F.count("*").alias("n_seen"))
    t = t.join(seen, "task_id", "left").withColumn("depth", F.lit(MOST_CLAIMS) + F.coalesce("n_seen", F.lit(0)))
    deepest = t.agg(F.max("depth")).first()[0] or MOST_CLAIMS
    ranked = _common(c).where("kind <> 'invariant'")
    w = W.partitionBy("question", "with_entry", "place").orderBy(F.desc(F.round("score", 9)), "claim_id")
    ranked = ranked.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= int(deepest))
    open_ = checkpointed(t.select("task_id", "question", "with_entry", "depth", F.explode(_places("contexts")).alias("place")))
    extra = open_.join(ranked, ["question", "with_entry", "place"]).where("pos <= depth").select("task_id", "claim_id", "kind", "score").distinct().join(reached, ["task_id", "claim_id"], "left_anti")
    best = top_by(met.where("kind <> 'invariant'").unionByName(extra), ["task_id"], [F.desc(F.round("score", 9)), F.col("claim_id")], MOST_CLAIMS).drop("pos")
    bare = open_.where("not with_entry").join(_common(c).where("kind = 'invariant'"), ["question", "with_entry", "place"]).select("task_id", "claim_id", "kind", "score").distinct()
    return checkpointed(met.where("kind = 'invariant'").unionByName(best).unionByName(bare))


def common_invariants(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """(question, place, claim_id, score): invariants without code, which bind every task of a question that has entry points:
    place ``*`` for tasks without contexts, else an empty place and the task's own contexts."""
    c = _common(_with_subjects(claims, nodes)).where("kind = 'invariant' and with_entry")
    return c.select("question", "place", "claim_id", "score")


def _with_subjects(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """Claims with whether a subject is code, and the contexts of their subjects."""
    facts = nodes.select("id", F.col("kind").isin(*cl.CODE).alias("code"), "bounded_context")
    g = claims.select(F.col("id").alias("claim_id"), F.explode("subject_node_ids").alias("id")).join(facts, "id").groupBy("claim_id").agg(F.bool_or("code").alias("code"), F.collect_set("bounded_context").alias("places"))
    c = claims.select(F.col("id").alias("claim_id"), "kind", "authority", "freshness", "verification_status", "statement").join(g, "claim_id", "left")
    return checkpointed(c.withColumns({"code": F.coalesce("code", F.lit(False)), "places": F.coalesce("places", F.array().cast("array<string>"))}))


def _places(contexts: str) -> Column:
    return F.when(F.size(contexts) == 0, F.array(F.lit("*"))).otherwise(F.array_union(F.array(F.lit("")), contexts))


def _common(c: DataFrame) -> DataFrame:
    """Claims that need no path from a task, scored for each question: a fixed number of rows a claim and context."""
    x = c.withColumn("question", F.explode(F.array(*(F.lit(q) for q in POLICIES)))).withColumn("hop", F.lit(None).cast("int"))
    x = x.withColumn("with_entry", F.explode(F.when(F.col("code"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    own = F.when(F.size("places") == 0, F.array(F.lit(""))).otherwise(F.col("places"))
    return _judged(x.withColumn("place", F.explode(F.array_union(F.array(F.lit("*")), own))))


def context_packs(tasks: DataFrame, nodes: DataFrame, edges: DataFrame, claims: DataFrame, evidence: DataFrame | None = None, candidates: DataFrame | None = None, only: set[str] | None = None) -> dict[str, DataFrame]:
    """The parts of the packs of many tasks, each keyed by task_id: entrypoints, claims, primary, secondary, tests, paths, reads,
    unknowns, hypotheses, plan and evidence; and ``common``, the invariants that bind all tasks of a question.

    ``tasks`` has task_id and text, and may have the other columns of TASKS. ``candidates`` has task_id and file_path of sealed
    search results; they move nodes to the front of the secondary ones only. Tasks without a name in the graph are sought by
    their words; a task that reaches nothing still gets the best claims of its question. ``only`` names the parts that are
    wanted, if not all: what none of them rests on is left out.
    """
    t = checkpointed(complete(tasks))
    nodes, edges, claims = stored(nodes), stored(edges), stored(claims)  # read many times below
    entry = entrypoints(t, nodes, edges)
    hops = hops_by_start(entry, nodes, edges)
    started = entry.select("task_id", F.col("id").alias("start"))
    chosen = chosen_claims(t, entry, hops, claims, nodes)
    about = claims.select(F.col("id").alias("claim_id"), "statement", "subject_node_ids", "evidence_ids", "verification_status")
    good = checkpointed(chosen.join(about, "claim_id"))
    hard = good.where("kind = 'invariant'")
    guessed = hypotheses(t)
    racy = t.where(F.exists("risks", lambda r: r.rlike(CONCURRENCY))).select("task_id")
    missing = lambda column, prefix, what: _named(t, column, prefix).join(nodes.select("id"), "id", "left_anti").select("task_id", F.concat(F.lit(f'{what} "'), "name", F.lit('" referenced by the task was not found in the graph.')).alias("unknown"))
    unknowns = reduce(DataFrame.unionByName, (
        missing("capabilities", "cap:", "Capability"), missing("invariants", "inv:", "Invariant"),
        hard.where("verification_status = 'inferred'").select("task_id", F.concat(F.lit('Invariant "'), "statement", F.lit('" is only inferred (no test proves it).')).alias("unknown")),
        guessed.select("task_id", F.concat(F.lit("Hypothesis not yet verified: "), "statement").alias("unknown")), racy.select("task_id", F.lit(RACE_UNKNOWN).alias("unknown")),
    )).distinct()
    if only == {"unknowns"}:
        return {"unknowns": unknowns}
    code = nodes.where(F.col("kind").isin(*cl.CODE)).select("id")
    walks = simple_paths(oriented(edges, ["calls"]), entry.select("id").distinct())
    walks = walks.select("start", F.array_join("path", ",").alias("path"), F.size("path").alias("n"), F.col("path").alias("ids")).distinct()
    walks = checkpointed(top_by(walks, ["start"], [F.desc("n"), F.col("path")], MOST_PATHS).drop("pos"))  # a task's best are among those of its starts
    walks = entry.withColumnRenamed("id", "start").join(walks, "start").select("task_id", "path", "n", "ids").distinct()
    paths = checkpointed(top_by(walks, ["task_id"], [F.desc("n"), F.col("path")], MOST_PATHS))
    on_path = checkpointed(paths.select("task_id", F.explode("ids").alias("id")).distinct())
    own = _named(t, "invariants", "inv:").join(nodes.select("id"), "id", "left_semi").select("task_id", "id")
    moves = edges.where("kind = 'related_to'").select(F.col("to_id").alias("id"), "from_id").join(nodes.where("kind = 'migration'").select(F.col("id").alias("from_id")), "from_id", "left_semi")
    migrations = checkpointed(own.join(moves, "id").select("task_id", F.col("from_id").alias("id")).distinct())
    subjects = good.select("task_id", F.explode("subject_node_ids").alias("id")).distinct().join(code, "id", "left_semi").select("task_id", "id")
    ids = reduce(DataFrame.unionByName, (entry, on_path.join(code, "id", "left_semi").select("task_id", "id"), subjects, own, migrations)).distinct()
    at = nodes.select("id", "kind", "name", "file_path", is_deprecated(nodes).alias("deprecated"))
    primary = checkpointed(least_hops(ids, entry, hops).join(at, "id").withColumn("hop", F.coalesce("hop", F.lit(FAR))))
    if only == {"primary"}:
        return {"primary": primary.select("task_id", "id", "kind", "hop")}
    covering = primary.select("task_id", F.col("id").alias("from_id")).join(edges.where("kind = 'tested_by'").select("from_id", F.col("to_id").alias("id")), "from_id").select("task_id", "id").distinct()
    tests = checkpointed(covering.join(at.where("kind = 'test'"), "id"))
    live = at.where("not (kind = 'document' and deprecated)")
    # What is among the nearest of a task is among those of the entry point it is nearest to, but for what the task shows elsewhere.
    shown = checkpointed(primary.select("task_id", "id").unionByName(tests.select("task_id", "id")).distinct())
    hidden = shown.groupBy("task_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    near = top_by(hops.join(live.select("id"), "id", "left_semi").select("start", "id", "hop"), ["start"], [F.col("hop"), F.col("id")], MOST_SECONDARY + hidden).drop("pos")
    near = nearest_others(entry, checkpointed(near), shown)
    if candidates is not None:
        sought = candidates.select(F.col("task_id").cast("string").alias("task_id"), normalize_path("file_path").alias("file_path")).distinct()
        near = near.unionByName(sought.join(at.where("not deprecated"), "file_path").select("task_id", "id", F.lit(-1).alias("hop")))
    near = near.groupBy("task_id", "id").agg(F.min("hop").alias("hop")).join(shown, ["task_id", "id"], "left_anti")
    near = near.join(live, "id")
    secondary = top_by(near, ["task_id"], [F.col("hop"), F.col("id")], MOST_SECONDARY)
    if only == {"secondary"}:
        return {"secondary": secondary.select("task_id", "id", "kind", "hop")}
    if only is None or only & {"secondary", "evidence"}:
        secondary = checkpointed(secondary)

    read = lambda df, priority, seq: df.select("task_id", "id", F.lit(PRIORITY[priority]).alias("rank"), F.lit(priority).alias("priority"), F.lit(seq).alias("seq"))
    bound = hard.select("task_id", F.explode("subject_node_ids").alias("id")).distinct().join(code, "id", "left_semi")
    decided = primary.where("kind = 'decision'").select("task_id", "id").unionByName(started.join(hops.join(at.where("kind = 'decision'").select("id"), "id", "left_semi"), "start").select("task_id", "id")).distinct()
    wanted = reduce(DataFrame.unionByName, (read(entry, "critical", 0), read(bound, "critical", 1), read(migrations, "high", 2), read(tests, "high", 3), read(decided, "medium", 4)))
    reads = checkpointed(top_by(wanted.join(at.where("file_path is not null").select("id", "kind", "file_path"), "id"), ["task_id", "file_path"], [F.desc("rank"), F.col("seq"), F.col("id")], 1))
    reads = reasons(reads.join(on_path.withColumn("on_path", F.lit(True)), ["task_id", "id"], "left"), edges, nodes).select("task_id", "file_path", "priority", "reason", "id")

    step = lambda df, kind, what, target: df.select("task_id", F.lit(kind).alias("kind"), what.alias("description"), target.alias("target"))
    fixes = entry.join(t.where("mode = 'bugfix'").select("task_id"), "task_id", "left_semi")
    plan = reduce(DataFrame.unionByName, (
        step(tests, "run_test", F.lit("Run the tests that cover the touched code paths; they must stay green."), F.col("id")),
        step(hard, "static_check", F.concat(F.lit("Statically re-check the invariant: "), "statement"), F.array_join("subject_node_ids", ",")),
        step(fixes, "reproduce", F.lit("Reproduce the observed behaviour, and prove the expected one after the fix."), F.col("id")),
        step(entry.join(racy, "task_id", "left_semi"), "reproduce", F.lit("Run the entry points concurrently, and prove the expected behaviour after the fix."), F.col("id")),
    ))
    parts = {
        "entrypoints": entry, "claims": chosen.withColumnRenamed("claim_id", "id"), "common": common_invariants(claims, nodes), "primary": primary.select("task_id", "id", "kind", "hop"), "secondary": secondary.select("task_id", "id", "kind", "hop"),
        "tests": tests.select("task_id", "id"), "paths": paths.select("task_id", "path", "n"), "reads": reads, "unknowns": unknowns, "hypotheses": guessed, "plan": plan,
    }
    if evidence is not None and "evidence" in nodes.columns:
        listed = reduce(DataFrame.unionByName, (x.select("task_id", "id") for x in (primary, secondary, tests))).join(nodes.select("id", F.transform("evidence", evidence_id).alias("e")), "id")
        used = listed.select("task_id", F.explode("e").alias("id")).unionByName(good.select("task_id", F.explode("evidence_ids").alias("id"))).distinct()
        parts["evidence"] = used.join(evidence, "id")
    return parts


def context_pack(task: Task, nodes: DataFrame, edges: DataFrame, claims: DataFrame, evidence: DataFrame, candidates: DataFrame | None = None) -> dict[str, DataFrame]:
    """The parts of one task's pack, as ``context_packs`` gives them for many. ``candidates`` has file_path."""
    row = [("task", task.text, task.question, task.mode, task.capabilities, task.invariants, task.contexts, task.expected, task.observed, task.risks)]
    one = candidates.withColumn("task_id", F.lit("task")) if candidates is not None else None
    parts = context_packs(nodes.sparkSession.createDataFrame(row, TASKS), nodes, edges, claims, evidence, one)
    return {k: p.drop("task_id") for k, p in parts.items()}


def validate_candidates(candidates: DataFrame, expected_source: str, expected_query: str) -> DataFrame:
    """(candidate..., reason): the first thing wrong with a search result's seal, null if it may be used.

    In order: no seal, a seal of other content than the result's, of another state of the repository, of another query.
    ``seal`` is a struct of source_hash, query_hash and result_hash; the result's hash is taken over path, score and snippet.
    """
    own = F.sha2(F.concat_ws("\0", "file_path", F.col("score").cast("string"), F.coalesce("snippet", F.lit(""))), 256)
    why = (
        F.when(F.col("seal").isNull(), "PROVIDER_SEAL_MISSING").when(~F.col("seal.result_hash").eqNullSafe(own), "PROVIDER_SEAL_INVALID")
        .when(~F.col("seal.source_hash").eqNullSafe(F.lit(expected_source)), "PROVIDER_SOURCE_STALE").when(~F.col("seal.query_hash").eqNullSafe(F.sha2(F.lit(expected_query).cast("binary"), 256)), "PROVIDER_QUERY_MISMATCH")
    )
    return candidates.withColumn("reason", why)
