"""Architecture deltas, levels, refinement, freshness, obligations and integrity over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators import control as c
from ripplegraph.operators.authored import capability_wiring as capability_wiring_of
from ripplegraph.operators.refinement import parse_relations
from ripplegraph.operators.retrieval import suite_scores as suite_scores_of
from ripplegraph.plans.authored_queries import LINKS, OWNERS, REFS, _model
from ripplegraph.plans.graph_sql import GRAPH
from ripplegraph.plans.impact_queries import graph
from ripplegraph.runtime import read

#: Parts as architecture elements, the target dropping, changing and adding some; SQL both engines read alike.
_CURRENT = "SELECT concat('p', p_partkey) AS id, p_size % 7 AS level, CASE WHEN p_size % 7 = 4 THEN 'policy' ELSE p_brand END AS category, concat(p_name, p_type) AS fingerprint FROM part"
_TARGET = """SELECT concat('p', p_partkey) AS id, p_size % 7 AS level, CASE WHEN p_size % 7 = 4 THEN 'policy' ELSE p_brand END AS category, concat(p_name, p_type, CASE WHEN p_partkey % 13 = 0 THEN '!' ELSE '' END) AS fingerprint FROM part WHERE p_partkey % 17 <> 0
UNION ALL SELECT concat('new', p_partkey), p_size % 7, p_brand, p_name FROM part WHERE p_partkey % 19 = 0"""


def _sql(spark: SparkSession, d: str, text: str, table: str) -> DataFrame:
    return spark.sql(text.replace(f"FROM {table}", "FROM {t}"), t=read(spark, d, table))


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Elements added, removed or changed between two architectures, and whether an invariant is concerned."""
    return c.compare_elements(_sql(spark, d, _CURRENT, "part"), _sql(spark, d, _TARGET, "part"))


def relation_diff(spark: SparkSession, d: str) -> DataFrame:
    """Relations added, removed or changed between the graphs of two halves of the nations."""
    li = read(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("from_id"), F.concat(F.lit("p"), "l_partkey").alias("to_id"), F.col("l_returnflag").alias("relation"), (F.col("l_linenumber") % 2).alias("half"), "l_linestatus")
    side = lambda h: li.where(F.col("half") == h).groupBy("from_id", "to_id", "relation").agg(F.max("l_linestatus").alias("fingerprint"))
    return c.compare_relations(side(0), side(1))


def level_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Categories and elements of every level."""
    x = _sql(spark, d, _TARGET, "part")
    return c.level_coverage(x.where("level <> 2"))


_RELATIONS = """SELECT concat('r', l_orderkey, '-', l_linenumber) AS id, CASE l_linenumber % 3 WHEN 0 THEN 'decomposes_to' WHEN 1 THEN 'realizes' ELSE 'implements' END AS kind, concat('p', l_partkey) AS a, concat('p', (l_orderkey * 7 + l_linenumber) % 997) AS b,
 CASE WHEN l_orderkey % 23 = 0 THEN 'llm_inferred' ELSE 'human_declared' END AS epistemic_status FROM lineitem"""


def _refinement(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = _sql(spark, d, _RELATIONS, "lineitem").withColumnRenamed("a", "source").withColumnRenamed("b", "target")
    ev = r.select(F.col("id").alias("relation_id"), F.explode(F.array("source", "target")).alias("digest"))
    ok = ev.where("digest not like '%7'").select("digest")
    return _sql(spark, d, _CURRENT, "part"), c.certifying(r, ev, ok)


def certifying_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations all of whose evidence is verified."""
    return _refinement(spark, d)[1].select("id", "kind")


def _traverse(spark: SparkSession, d: str, lo: int, hi: int, way: str) -> DataFrame:
    coords, rel = _refinement(spark, d)
    return c.traverse_levels(coords, c.refinement_steps(rel, coords, way), coords.where(F.col("level") == lo), hi, way)


def refinement_lift(spark: SparkSession, d: str) -> DataFrame:
    """Certified paths that lift elements from level 1 to level 3."""
    return _traverse(spark, d, 1, 3, "lift").select("source", F.array_join("path", ">").alias("path"))


def refinement_lower(spark: SparkSession, d: str) -> DataFrame:
    """Certified paths that lower elements from level 3 to level 2."""
    return _traverse(spark, d, 3, 2, "lower").select("source", F.array_join("path", ">").alias("path"))


def refinement_missing(spark: SparkSession, d: str) -> DataFrame:
    """Levels from 0 to 4 that the first such path of each element leaves out."""
    coords, _ = _refinement(spark, d)
    return c.refinement_gaps(coords, _traverse(spark, d, 1, 3, "lift"), 0, 4)


def impact_paths(spark: SparkSession, d: str) -> DataFrame:
    """What each repository's invariant-bound functions reach over impact relations, two shortest paths each."""
    n, e = graph(spark, d)
    src = n.where("kind = 'function' and array_contains(tags, 'critical')").select(F.col("repo").alias("source_set"), "id")
    return c.impact_paths(e.withColumnRenamed("kind", "relation"), src).select("source_set", "id", F.array_join("path", ">").alias("path"))


def impact_reach(spark: SparkSession, d: str) -> DataFrame:
    """The least depth of what they reach."""
    n, e = graph(spark, d)
    src = n.where("kind = 'function' and array_contains(tags, 'critical')").select(F.col("repo").alias("source_set"), "id")
    return c.impact_paths(e.withColumnRenamed("kind", "relation"), src).groupBy("source_set", "id").agg(F.min(F.size("path") - 1).alias("depth"))


def coordinate_graph(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates of both planes by source kind, and the structural edges between them by relation."""
    (n, e), m = graph(spark, d), _model(spark, d)
    x = c.coordinates(n, m["nodes"])
    s = c.structural_edges(x, e, m["relations"], m["links"], n)
    return x.groupBy(F.lit("coordinate").alias("what"), F.col("source_kind").alias("name")).agg(F.count("*").alias("n")).unionByName(s.groupBy(F.lit("edge").alias("what"), F.col("relation").alias("name")).agg(F.count("*").alias("n")))


_SEALS = """SELECT c_custkey AS seal_id, 'r' AS root, CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE 'r' END AS indexed_root, CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE 'h1' END AS head, CASE WHEN c_custkey % 5 = 0 THEN 'h2' ELSE 'h1' END AS indexed_head, 'g' AS graph_hash, CASE WHEN c_custkey % 7 = 0 THEN 'g2' ELSE 'g' END AS indexed_graph_hash,
 'm' AS model_hash, 'm' AS indexed_model_hash, 'i' AS input_hash, 'i' AS indexed_input_hash, CASE WHEN c_custkey % 2 = 0 THEN 'clean' ELSE 'dirty' END AS diff_hash, CASE WHEN c_custkey % 2 = 0 THEN 'clean' ELSE 'dirty' END AS indexed_diff_hash, CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE '1' END AS store_version, '1' AS indexed_store_version,
 't' AS tool_version, CASE WHEN c_custkey % 11 = 0 THEN 'u' ELSE 't' END AS indexed_tool_version, 'now' AS indexed_at FROM customer"""


def freshness_class(spark: SparkSession, d: str) -> DataFrame:
    """Freshness of seals built from customers."""
    return c.classify_freshness(_sql(spark, d, _SEALS, "customer"), "clean")


_STATUSES = "['test_observed', 'human_declared', 'llm_inferred', 'statically_observed', 'dynamically_observed']"
_ATTESTED = f"""SELECT concat('a', event_id) AS id, concat('u', user_id % 200) AS subject, {list(c.OBLIGATIONS)}[CAST(event_id % {len(c.OBLIGATIONS)} + 1 AS INT)] AS obligation, {_STATUSES}[CAST(user_id * 7 % 5 + 1 AS INT)] AS epistemic_status, CASE WHEN event_id % 7 = 0 THEN 'old' ELSE 'head' END AS commit_id,
 CASE WHEN event_id % 11 = 0 THEN 'test' ELSE 'architecture' END AS reference_kind, event_id % 13 <> 0 AS non_llm, ts AS observed_at, CASE WHEN event_id % 3 = 0 THEN '2024-01-02 00:00:00' ELSE '2025-01-20 12:00:00' END AS expires_at,
 CASE WHEN event_id % 50 = 0 THEN 'never' ELSE '2024-06-15 00:00:00' END AS evaluated_at FROM events"""


def _attested(spark: SparkSession, d: str) -> DataFrame:
    text = _ATTESTED
    for listed in (str(list(c.OBLIGATIONS)), _STATUSES):  # lists are indexed from 1 in both engines, but spelled differently
        text = text.replace(f"{listed}[", f"element_at(array({listed[1:-1]}), ", 1)
    return spark.sql(text.replace(" AS INT)]", " AS INT))").replace("FROM events", "FROM {t}"), t=read(spark, d, "events"))


def obligation_eval(spark: SparkSession, d: str) -> DataFrame:
    """Obligations of subjects by the published matrix, against attestations built from events: whether they hold, and why not."""
    a = c.attestations_in_force(_attested(spark, d))
    asked = a.select("subject", "obligation", F.lit("head").alias("commit_id"))
    return c.evaluate_obligations(asked, c.sufficiency(spark), a).select("subject", "obligation", "satisfied", F.array_join("reasons", ",").alias("reasons"))


def prerequisites(spark: SparkSession, d: str) -> DataFrame:
    """Everything that the obligations of each subject ask for, directly or through others."""
    a = _attested(spark, d)
    return c.with_prerequisites(a.where("non_llm").select("subject", "obligation"))


def integrity_violations(spark: SparkSession, d: str) -> DataFrame:
    """Broken constraints among elements, relations, steps, paths and lists with faults put in."""
    part, orders = read(spark, d, "part"), read(spark, d, "orders")
    key = F.col("p_partkey")
    elements = part.select(F.concat(F.lit("p"), key).alias("id"), (key % 7).alias("level"), F.when(key % 41 != 0, F.col("p_brand")).alias("category")).where("id not like '%99'")
    relations = part.select(F.concat(F.lit("p"), key).alias("from_id"), F.concat(F.lit("p"), key + 1).alias("to_id"))
    steps = orders.select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).alias("depends_on"))
    seq = lambda n: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: i.cast("string"))
    paths = part.select(key.alias("path_id"), seq(F.col("p_size") % 4 + 2).alias("nodes"), seq(F.when(key % 37 == 0, F.lit(1)).otherwise(F.col("p_size") % 4 + 1)).alias("edges"))
    lists = part.select(key.alias("list_id"), F.array("p_brand", "p_type").alias("items"))
    changes = part.select(key.alias("change_id"), key.alias("before_id"), F.when(key % 53 == 0, key + 1).otherwise(key).alias("after_id"))
    return c.violations(elements=elements, relations=relations, steps=steps, paths=paths, lists=lists, changes=changes)


_FAULTS = f"""SELECT c_custkey AS k, CASE WHEN c_custkey % 17 = 0 THEN 'FRESH' WHEN c_custkey % 3 = 0 THEN 'STALE' WHEN c_custkey % 3 = 1 THEN 'UNSEALED' ELSE 'DIRTY_KNOWN' END AS verdict, c_custkey % 8 AS p FROM customer"""


def report_violations(spark: SparkSession, d: str) -> DataFrame:
    """Broken constraints among coordinates, plans and their steps, attestations, budgets, statuses, coverages, queries and
    digests made of customers, with faults of every kind put in."""
    t = _sql(spark, d, _FAULTS, "customer")
    k, s = F.col("k"), F.col("k").cast("string")
    on = lambda n, yes, no: F.when(k % n == 0, yes).otherwise(no)
    lit, arr = F.lit, lambda *xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    coordinates = t.select(F.concat(on(19, lit("repo:"), lit("semantic:")), s).alias("id"), on(23, lit("repo"), lit("semantic")).alias("plane"))
    attestations = t.select(s.alias("id"), lit("2024-02-01").alias("observed_at"), on(29, lit("2024-01-31"), lit("2024-03-01")).alias("expires_at"))
    steps = t.select((k - k % 4).alias("plan"), k.alias("ord"), s.alias("id"), F.when(k % 4 > 0, (k - 1).cast("string")).otherwise(on(5, (k + 3).cast("string"), lit(None))).alias("depends_on")).where(F.col("plan") > 0)
    pr = c.profiles(spark).withColumnRenamed("ord", "p")
    plan_steps = t.join(F.broadcast(pr), "p").select(
        s.alias("id"), on(31, lit("unheard_of"), F.col("profile")).alias("profile"), "kind", "from_state", "to_state", on(7, lit("R3"), F.col("risk")).alias("risk"), on(11, lit(None), lit("back")).alias("rollback"),
        on(13, F.array_except("obligations", arr("rollback_ready")), F.col("obligations")).alias("obligations"),
    )
    plans = t.select(
        s.alias("id"), on(2, lit("READY"), lit("BLOCKED")).alias("status"), F.when(k % 2 == 1, on(15, lit(None), lit("open_unknowns"))).otherwise(on(14, lit("open_unknowns"), lit(None))).alias("reason"), (k % 2).alias("n_details"), (k % 22 != 0).alias("has_target"),
        s.alias("change_id"), on(37, lit("other"), s).alias("context_id"), lit("c").alias("commit_id"), on(41, lit("d"), lit("c")).alias("current_commit"), lit(8).alias("n_steps"),
    )
    budgets = t.select(s.alias("id"), lit(10).alias("most"), (k % 10).alias("consumed"), (10 - k % 10 + on(43, lit(1), lit(0))).alias("remaining"))
    reasons = F.when(F.col("verdict") == "FRESH", on(34, arr("HEAD_MISMATCH"), arr())).when(F.col("verdict") == "STALE", on(6, arr("HEAD_MISMATCH", "REPOSITORY_ROOT_MISMATCH"), arr("HEAD_MISMATCH"))).when(F.col("verdict") == "UNSEALED", on(5, arr("HEAD_MISMATCH"), arr("GIT_STATE_UNAVAILABLE"))).otherwise(on(10, arr(), arr("WORKING_TREE_DIRTY")))
    statuses = t.select(s.alias("id"), "verdict", reasons.alias("reasons"), (F.col("verdict").isin("FRESH", "DIRTY_KNOWN") != (k % 47 == 0)).alias("allowed"), ((F.col("verdict") != "UNSEALED") & (k % 49 != 0)).alias("sealed"))
    seals = t.select(s.alias("id"), on(51, lit("FRESH"), F.col("verdict")).alias("verdict"), F.array_join(reasons, ",").alias("reasons"))
    coverages = t.select(s.alias("id"), F.array(k % 7).alias("covered"), F.array(k % 6).alias("missing"))
    terminals = t.select(s.alias("id"), F.when(k % 4 == 0, "success").when(k % 4 == 1, "empty").when(k % 4 == 2, "refused").otherwise("budget_exhausted").alias("status"), F.when(k % 4 == 0, on(12, lit("INDEX_STALE"), lit(None))).when(k % 4 == 1, on(9, lit(None), lit("MAPPING_MISSING"))).when(k % 4 == 2, "INDEX_STALE").otherwise(on(15, lit("INDEX_STALE"), lit("BUDGET_EXHAUSTED"))).alias("reason"))
    envelopes = t.select(s.alias("id"), "verdict", on(2, lit("refused"), lit("success")).alias("status"), on(4, arr("INDEX_STALE"), arr()).alias("reasons"), (k % 5 != 0).alias("has_payload"))
    refs = t.select("k", F.explode(F.array(s, (k + 1).cast("string"), s)).alias("locator")).select("k", lit("commit").alias("kind"), "locator", F.concat(lit("sha256:"), "locator").alias("digest"))
    one = lambda v: F.concat(lit('{"digest":"sha256:'), v, lit('","kind":"commit","locator":"'), v, lit('"}'))
    lo, hi = F.least(s, (k + 1).cast("string")), F.greatest(s, (k + 1).cast("string"))
    stored_ = F.concat(lit("sha256:"), F.sha2(F.concat(lit("["), one(lo), on(53, lit(""), F.concat(lit(","), one(hi))), lit("]")), 256))
    digests = t.select("k", stored_.alias("stored")).join(c.evidence_set_digest(refs, "k").withColumnRenamed("digest", "computed"), "k").withColumnRenamed("k", "id")
    return c.violations(
        coordinates=coordinates, attestations=attestations, steps=steps, plan_steps=plan_steps, plans=plans, budgets=budgets, statuses=statuses, seals=seals, coverages=coverages, terminals=terminals, envelopes=envelopes, digests=digests
    )


def explain_why(spark: SparkSession, d: str) -> DataFrame:
    """What each authored coordinate rests on, and the path there."""
    (n, e), m = graph(spark, d), _model(spark, d)
    x = c.coordinates(n, m["nodes"].withColumn("level", F.when(F.col("kind") != "decision", 5)))
    s = c.structural_edges(x, e, m["relations"], m["links"], n)
    return c.explain_why(x, s, x.where("plane = 'B'")).select("source", "rationale", F.array_join("path", ">").alias("path"))


def capability_wiring(spark: SparkSession, d: str) -> DataFrame:
    """Invariants and contexts of each capability through what implements it."""
    n, e = graph(spark, d)
    return capability_wiring_of(e, n).select("capability", F.array_join("invariants", ",").alias("invariants"), F.array_join("contexts", ",").alias("contexts"))


def relation_parse(spark: SparkSession, d: str) -> DataFrame:
    """Refinement relations read back from texts built from parts, a tenth of them faulty."""
    key = F.col("p_partkey").cast("string")
    kind = F.when(F.col("p_partkey") % 10 == 3, "admires").when(F.col("p_partkey") % 2 == 0, "realizes").otherwise("decomposes_to")
    digest = F.concat(F.lit("sha256:"), F.sha2(key, 256))
    block = F.concat(F.lit("relation r."), key, F.lit(" "), kind, F.lit(" source semantic p."), key, F.lit("\ntarget semantic \"size "), F.col("p_size").cast("string"), F.lit("\"\nepistemicStatus human_declared\nprovenance author\nevidenceRef commit git:"), key, F.lit(" "), digest, F.lit("\nend"))
    texts = read(spark, d, "part").select("p_brand", block.alias("t")).groupBy(F.col("p_brand").alias("file")).agg(F.array_join(F.sort_array(F.collect_list("t")), "\n").alias("text"))
    good, bad = parse_relations(texts)
    out = good.select("file", "id", "kind", "target", F.col("evidence")[0]["digest"].alias("digest"))
    return out.unionByName(bad.groupBy("file", F.col("code").alias("kind")).agg(F.count("*").alias("n")).select("file", F.lit("").alias("id"), "kind", F.col("n").cast("string").alias("target"), F.lit("").alias("digest")))


def suite_scores(spark: SparkSession, d: str) -> DataFrame:
    """Means of metrics of suites built from order lines, and which suites pass."""
    x = read(spark, d, "lineitem").select(F.concat("l_returnflag", F.lit("-"), F.col("l_linenumber").cast("string")).alias("suite"), F.col("l_orderkey").alias("task_id"), F.lit("m").alias("metric"), F.when(F.col("l_returnflag") == "R", F.lit(1.0)).when(F.col("l_tax") > 0.01, F.col("l_discount")).alias("score"))
    return suite_scores_of(x, 0.5).select("suite", F.round("mean_score", 6).alias("mean_score"), "n_tasks", "passed")


PLANE = f"""WITH RECURSIVE {GRAPH}, o AS ({OWNERS}), {REFS}, lks AS ({LINKS}), am AS (SELECT id, kind FROM o WHERE kind <> 'change'),
co AS (SELECT 'repo:' || id id, kind k FROM n UNION SELECT 'semantic:' || id, kind FROM am),
lt AS (SELECT owner_id, lks.kind, n.id FROM lks JOIN n ON n.file_path = lks.ref WHERE lks.kind = 'file' UNION ALL SELECT owner_id, kind, ref FROM lks WHERE kind NOT IN ('file', 'claim', 'evidence')),
se AS (SELECT f, t, relation FROM (SELECT 'repo:' || from_id f, 'repo:' || to_id t, kind relation FROM e UNION SELECT 'semantic:' || id, 'semantic:' || ref, field FROM r WHERE id IN (SELECT id FROM am) UNION SELECT 'repo:' || id, 'semantic:' || owner_id, 'repository_link:' || kind FROM lt)
  WHERE f IN (SELECT id FROM co) AND t IN (SELECT id FROM co))"""
_R = f"r0 AS ({_RELATIONS}), t AS ({_CURRENT}), r AS (SELECT * FROM r0 WHERE epistemic_status <> 'llm_inferred' AND id NOT IN (SELECT id FROM r0 WHERE a LIKE '%7' OR b LIKE '%7'))"
_STEP = "{0} AS (SELECT r.id rid, CASE WHEN {1} THEN a ELSE b END src, CASE WHEN {1} THEN b ELSE a END dst FROM r), {0}1 AS (SELECT {0}.* FROM {0} JOIN t x ON x.id = src JOIN t y ON y.id = dst WHERE y.level - x.level = {2})"
_LIFT = f"{_R}, {_STEP.format('u', 'kind <> ' + repr('decomposes_to'), 1)}, p AS (SELECT t.id AS source, t.id || '>' || a.dst || '>' || b.dst AS path, [t.id, a.dst, b.dst] ids, a.rid || ',' || b.rid o FROM t JOIN u1 a ON a.src = t.id JOIN u1 b ON b.src = a.dst WHERE t.level = 1)"
SQL = {
    "snapshot_diff": f"""WITH a AS ({_CURRENT}), b AS ({_TARGET}) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change,
 coalesce(a.level = 4 OR a.category IN ('invariant', 'policy'), false) OR coalesce(b.level = 4 OR b.category IN ('invariant', 'policy'), false) AS invariant FROM a FULL JOIN b ON a.id = b.id WHERE a.fingerprint IS DISTINCT FROM b.fingerprint""",
    "relation_diff": """WITH g AS (SELECT concat('s', l_suppkey) f, concat('p', l_partkey) t, l_returnflag r, l_linenumber % 2 h, max(l_linestatus) x FROM lineitem GROUP BY ALL), a AS (SELECT * FROM g WHERE h = 0), b AS (SELECT * FROM g WHERE h = 1)
SELECT coalesce(a.f, b.f) AS from_id, coalesce(a.t, b.t) AS to_id, coalesce(a.r, b.r) AS relation, CASE WHEN a.x IS NULL THEN 'added' WHEN b.x IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.f = b.f AND a.t = b.t AND a.r = b.r WHERE a.x IS DISTINCT FROM b.x""",
    "level_coverage": f"""WITH b AS ({_TARGET}), g AS (SELECT level, array_to_string(list_sort(list(DISTINCT category)), ',') cs, count(*) k FROM b WHERE level <> 2 GROUP BY 1) SELECT CAST(l AS INTEGER) AS level, coalesce(cs, '') AS categories, coalesce(k, 0) AS n_coordinates FROM range(7) x(l) LEFT JOIN g ON g.level = l""",
    "certifying_relations": f"WITH {_R} SELECT id, kind FROM r",
    "refinement_lift": f"WITH {_LIFT} SELECT source, path FROM p",
    "refinement_lower": f"WITH {_R}, {_STEP.format('v', 'kind = ' + repr('decomposes_to'), -1)} SELECT t.id AS source, t.id || '>' || dst AS path FROM t JOIN v1 ON src = t.id WHERE t.level = 3",
    "refinement_missing": f"WITH {_LIFT}, f AS (SELECT source, arg_min(ids, o) ids FROM p GROUP BY 1), h AS (SELECT source, level FROM (SELECT source, unnest(ids) id FROM f) JOIN t USING (id)) SELECT source, CAST(l AS INTEGER) AS level FROM f, range(5) x(l) WHERE (source, l) NOT IN (SELECT (source, CAST(level AS BIGINT)) FROM h)",
    "impact_reach": f"""WITH RECURSIVE {GRAPH}, u AS (SELECT DISTINCT from_id src, to_id dst FROM e WHERE kind IN {c.IMPACT_RELATIONS}), s AS (SELECT repo source_set, id FROM n WHERE kind = 'function' AND list_contains(tags, 'critical')),
w AS (SELECT source_set, id, 0 depth FROM s UNION SELECT source_set, u.dst, depth + 1 FROM w JOIN u ON u.src = w.id WHERE depth < 8) SELECT source_set, id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2 HAVING min(depth) > 0""",
    "impact_paths": f"""WITH RECURSIVE {GRAPH}, u AS (SELECT DISTINCT from_id src, to_id dst FROM e WHERE kind IN {c.IMPACT_RELATIONS}), s AS (SELECT repo source_set, id FROM n WHERE kind = 'function' AND list_contains(tags, 'critical')),
w AS (SELECT source_set, id, 0 depth FROM s UNION SELECT source_set, u.dst, depth + 1 FROM w JOIN u ON u.src = w.id WHERE depth < 8), b AS (SELECT source_set, id, min(depth) depth FROM w GROUP BY 1, 2),
p AS (SELECT source_set, id tail, [id] p FROM s UNION ALL SELECT p.source_set, u.dst, list_append(p.p, u.dst) FROM p JOIN b ON b.source_set = p.source_set AND b.id = p.tail AND b.depth = len(p.p) - 1 JOIN u ON u.src = p.tail WHERE len(p.p) <= 8 AND NOT list_contains(p.p, u.dst))
SELECT source_set, tail AS id, array_to_string(p, '>') AS path FROM p WHERE (source_set, tail) NOT IN (SELECT (source_set, id) FROM s) QUALIFY row_number() OVER (PARTITION BY source_set, tail ORDER BY len(p), array_to_string(p, chr(0))) <= 2""",
    "coordinate_graph": f"{PLANE} SELECT 'coordinate' AS what, k AS name, count(*) AS n FROM co GROUP BY 2 UNION ALL SELECT 'edge', relation, count(*) FROM se GROUP BY 2",
    "explain_why": f"""{PLANE}, y AS (SELECT 'semantic:' || id id FROM am WHERE kind <> 'decision'), x AS (SELECT DISTINCT f, t FROM se WHERE relation IN {c.RATIONALE}),
p AS (SELECT 'semantic:' || id AS source, 'semantic:' || id AS tail, ['semantic:' || id] p FROM am UNION ALL SELECT source, x.t, list_append(p.p, x.t) FROM p JOIN x ON x.f = p.tail WHERE p.tail NOT IN (FROM y) AND len(p.p) <= 8 AND NOT list_contains(p.p, x.t))
SELECT source, tail AS rationale, array_to_string(p, '>') AS path FROM p WHERE tail IN (FROM y) AND len(p) = (SELECT min(len(q.p)) FROM p q WHERE q.source = p.source AND q.tail = p.tail)""",
    "freshness_class": f"""WITH s AS ({_SEALS}), x AS (SELECT *, indexed_root IS NULL OR indexed_graph_hash IS NULL miss, list_filter([CASE WHEN head IS NULL OR indexed_head IS NULL OR diff_hash IS NULL THEN 'GIT_STATE_UNAVAILABLE' END, CASE WHEN store_version IS NULL THEN 'STORE_SCHEMA_UNAVAILABLE' END], lambda v: v IS NOT NULL) un,
 list_filter([{', '.join(f"CASE WHEN {a} IS DISTINCT FROM {b} THEN '{r}' END" for r, a, b in c.MISMATCHES)}], lambda v: v IS NOT NULL) mm FROM s)
SELECT seal_id, CASE WHEN miss OR len(un) > 0 THEN 'UNSEALED' WHEN len(mm) > 0 THEN 'STALE' WHEN diff_hash = 'clean' THEN 'FRESH' ELSE 'DIRTY_KNOWN' END AS verdict,
 CASE WHEN miss THEN 'INDEX_SNAPSHOT_MISSING' WHEN len(un) > 0 THEN array_to_string(un, ',') WHEN len(mm) > 0 THEN array_to_string(mm, ',') WHEN diff_hash = 'clean' THEN '' ELSE 'WORKING_TREE_DIRTY' END AS reasons FROM x""",
    "obligation_eval": f"""WITH a AS ({_ATTESTED}), m AS (SELECT * FROM (VALUES {', '.join(str(r) for r in c.MATRIX)}) t(obligation, clause, status, kinds)),
q AS (SELECT DISTINCT subject, obligation FROM a), v AS (SELECT *, coalesce(observed_at <= try_cast(evaluated_at AS TIMESTAMP) AND try_cast(evaluated_at AS TIMESTAMP) <= CAST(expires_at AS TIMESTAMP), false) fresh, epistemic_status <> 'llm_inferred' sure FROM a),
k AS (SELECT subject, obligation, bool_or(commit_id = 'head') at_head, bool_or(commit_id = 'head' AND sure) sure_head, bool_or(commit_id = 'head' AND sure AND fresh) fresh_head, bool_or(commit_id = 'head' AND sure AND fresh AND non_llm) usable FROM v GROUP BY 1, 2),
s AS (SELECT subject, obligation, bool_and(met) ok FROM (SELECT q.subject, q.obligation, clause, bool_or(coalesce(v.commit_id = 'head' AND fresh AND sure AND non_llm AND v.epistemic_status = m.status AND (m.kinds = '' OR m.kinds = v.reference_kind), false)) met
  FROM q JOIN m USING (obligation) LEFT JOIN v ON v.subject = q.subject AND v.obligation = q.obligation GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT subject, obligation, ok AS satisfied, CASE WHEN ok THEN '' WHEN NOT at_head THEN 'proof_commit_mismatch' WHEN sure_head AND NOT fresh_head THEN 'proof_stale' ELSE 'proof_epistemically_insufficient' END AS reasons FROM k JOIN s USING (subject, obligation)""",
    "prerequisites": f"""WITH a AS ({_ATTESTED}) SELECT DISTINCT subject, obligation FROM a WHERE non_llm UNION SELECT subject, unnest({list(c.BEFORE_DELETION)}) FROM a WHERE non_llm AND obligation = 'deletion_approved'""",
    "capability_wiring": f"""WITH {GRAPH} SELECT i.to_id AS capability, coalesce(array_to_string(list_sort(list(DISTINCT b.to_id) FILTER (b.to_id IS NOT NULL)), ','), '') AS invariants, coalesce(array_to_string(list_sort(list(DISTINCT n.bounded_context) FILTER (n.bounded_context IS NOT NULL)), ','), '') AS contexts
FROM e i LEFT JOIN e b ON b.kind = 'constrained_by' AND b.from_id = i.from_id LEFT JOIN n ON n.id = i.from_id WHERE i.kind = 'implements_capability' GROUP BY 1""",
    "relation_parse": """SELECT p_brand AS file, concat('r.', p_partkey) AS id, CASE WHEN p_partkey % 2 = 0 THEN 'realizes' ELSE 'decomposes_to' END AS kind, concat('size ', p_size) AS target, 'sha256:' || sha256(CAST(p_partkey AS VARCHAR)) AS digest FROM part WHERE p_partkey % 10 <> 3
UNION ALL SELECT p_brand, '', 'RELATION_UNKNOWN_KIND', CAST(count(*) AS VARCHAR), '' FROM part WHERE p_partkey % 10 = 3 GROUP BY 1""",
    "suite_scores": """WITH x AS (SELECT concat(l_returnflag, '-', l_linenumber) suite, l_orderkey t, CASE WHEN l_returnflag = 'R' THEN 1.0 WHEN l_tax > 0.01 THEN l_discount END s FROM lineitem)
SELECT suite, round(avg(s), 6) AS mean_score, count(DISTINCT t) AS n_tasks, coalesce(bool_and(s >= 1), false) AND avg(s) >= 0.5 AS passed FROM x GROUP BY 1""",
    "report_violations": f"""WITH t AS (SELECT *, CAST(k AS VARCHAR) id FROM ({_FAULTS})), pr AS (SELECT * FROM (VALUES {', '.join(str((i, r[0], r[4], list(r[5]))) for i, r in enumerate(c.PROFILES))}) x(p, profile, risk, obl)),
ps AS (SELECT k, id, profile, pr.risk own, CASE WHEN k % 7 = 0 THEN 'R3' ELSE pr.risk END risk, CASE WHEN k % 13 = 0 THEN list_filter(obl, lambda x: x <> 'rollback_ready') ELSE obl END ob, obl FROM t JOIN pr USING (p)),
st AS (SELECT *, CASE verdict WHEN 'FRESH' THEN CASE WHEN k % 34 = 0 THEN 'bad' ELSE 'ok' END WHEN 'STALE' THEN CASE WHEN k % 6 = 0 THEN 'order' ELSE 'ok' END WHEN 'UNSEALED' THEN CASE WHEN k % 5 = 0 THEN 'bad' ELSE 'ok' END ELSE CASE WHEN k % 10 = 0 THEN 'bad' ELSE 'ok' END END rs FROM t)
SELECT 'id_is_of_its_plane' AS rule, concat(CASE WHEN k % 19 = 0 THEN 'repo:' ELSE 'semantic:' END, k) AS subject FROM t WHERE (k % 19 = 0) <> (k % 23 = 0) UNION ALL SELECT 'expiry_not_before_observation', id FROM t WHERE k % 29 = 0
UNION ALL SELECT 'step_depends_on_the_one_before', id FROM t WHERE k >= 4 AND k % 20 = 0 UNION ALL SELECT 'steps_are_no_cycle', id FROM t WHERE k >= 4 AND (k - k % 4) % 20 = 0 AND k - k % 4 + 3 <= (SELECT max(k) FROM t)
UNION ALL SELECT 'step_is_as_its_profile', id FROM ps WHERE k % 31 = 0 OR risk <> own UNION ALL SELECT 'profile_obligations_are_there', id FROM ps WHERE k % 31 <> 0 AND risk = own AND len(ob) < len(obl)
UNION ALL SELECT 'risk_has_a_rollback', id FROM ps WHERE risk IN ('R2', 'R3') AND k % 11 = 0 UNION ALL SELECT 'risk_has_rollback_ready', id FROM ps WHERE risk IN ('R2', 'R3') AND NOT list_contains(ob, 'rollback_ready')
UNION ALL SELECT 'blocked_plan_says_why', id FROM t WHERE k % 2 = 1 AND k % 15 = 0 UNION ALL SELECT 'ready_plan_is_not_blocked', id FROM t WHERE k % 14 = 0 UNION ALL SELECT 'ready_plan_is_whole', id FROM t WHERE k % 22 = 0
UNION ALL SELECT 'plan_is_of_its_change', id FROM t WHERE k % 37 = 0 UNION ALL SELECT 'plan_is_of_its_commit', id FROM t WHERE k % 41 = 0 UNION ALL SELECT 'budget_adds_up', id FROM t WHERE k % 43 = 0
UNION ALL SELECT 'reasons_are_unique_and_in_order', id FROM st WHERE rs = 'order' UNION ALL SELECT 'reasons_are_the_verdicts', id FROM st WHERE rs = 'bad' UNION ALL SELECT 'only_fresh_or_known_is_allowed', id FROM t WHERE k % 47 = 0
UNION ALL SELECT 'only_unsealed_has_no_seal', id FROM t WHERE verdict <> 'UNSEALED' AND k % 49 = 0 UNION ALL SELECT 'status_is_that_of_the_seal', id FROM t WHERE verdict NOT IN ('UNSEALED', 'FRESH') AND k % 49 <> 0 AND k % 51 = 0
UNION ALL SELECT 'covered_and_missing_are_disjoint', id FROM t WHERE k % 7 = k % 6 UNION ALL SELECT 'reason_is_the_statuss', id FROM t WHERE k % 4 = 0 AND k % 12 = 0 OR k % 4 = 1 AND k % 9 = 0 OR k % 4 = 3 AND k % 15 = 0
UNION ALL SELECT 'stale_queries_refuse', id FROM t WHERE verdict IN ('STALE', 'UNSEALED') AND k % 4 <> 0 UNION ALL SELECT 'success_has_a_payload', id FROM t WHERE k % 2 = 1 AND k % 5 = 0 UNION ALL SELECT 'digest_is_recomputable', id FROM t WHERE k % 53 = 0""",
    "integrity_violations": """WITH el AS (SELECT concat('p', p_partkey) id, p_partkey % 41 = 0 nocat FROM part WHERE concat('p', p_partkey) NOT LIKE '%99'), re AS (SELECT concat('p', p_partkey) f, concat('p', p_partkey + 1) t FROM part)
SELECT 'relation_from_id_is_element' AS rule, f AS subject FROM re WHERE f NOT IN (SELECT id FROM el) UNION ALL SELECT 'relation_to_id_is_element', t FROM re WHERE t NOT IN (SELECT id FROM el) UNION ALL SELECT 'level_and_category_go_together', id FROM el WHERE nocat
UNION ALL SELECT 'step_depends_on_the_one_before', CAST(o_orderkey AS VARCHAR) FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) b FROM orders) WHERE b IS DISTINCT FROM CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END UNION ALL SELECT 'steps_are_no_cycle', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT 'path_has_one_edge_fewer_than_nodes', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 37 = 0 AND p_size % 4 + 1 <> 1 UNION ALL SELECT 'list_is_unique_and_in_order', CAST(p_partkey AS VARCHAR) FROM part WHERE p_brand >= p_type UNION ALL SELECT 'change_keeps_its_id', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 53 = 0""",
}
QUERIES = {q.__name__: q for q in (
    snapshot_diff, relation_diff, level_coverage, certifying_relations, refinement_lift, refinement_lower, refinement_missing, impact_paths, impact_reach, coordinate_graph, freshness_class, obligation_eval, prerequisites, integrity_violations, report_violations, explain_why,
    capability_wiring, relation_parse, suite_scores,
)}
