"""Single operators over the driver's tables that no larger query shows by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators import authored, context, control, observed, refinement
from ripplegraph.operators.authored import PROVEN
from ripplegraph.plans.authored_queries import _model
from ripplegraph.plans.control_queries import PLANE
from ripplegraph.plans.graph_sql import HUNKS
from ripplegraph.plans.impact_queries import graph
from ripplegraph.plans.index_queries import patches
from ripplegraph.runtime import read


def change_patches(spark: SparkSession, d: str) -> DataFrame:
    """Lists of changes made of customers after their patches: added to, taken from, or as they were."""
    t = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))
    key = F.col("k")
    none = F.lit(None).cast("array<string>")
    changes = t.select(F.col("k").alias("id"), F.array(F.lit("a"), F.col("s"), (key % 3).cast("string")).alias("serves"), F.when(key % 5 > 0, F.array(F.lit("p"))).alias("preserves"), none.alias("requires_evidence"), F.array(F.lit("u")).alias("unknowns"))
    lists = {"serves": (F.array(F.lit("n"), F.lit("a")), F.array(F.lit("a"), F.lit("0"))), "preserves": (F.array(F.lit("q")), none), "requires_evidence": (F.when(key % 4 == 0, F.array(F.lit("e"))), none), "unknowns": (none, F.array(F.lit("u")))}
    p = t.where(key % 2 == 0).select(F.col("k").alias("id"), *(x.alias(f"{how}_{c}") for c, pair in lists.items() for how, x in zip(("add", "remove"), pair, strict=True)))
    x = authored.apply_patches(changes, p)
    return x.select("id", *(F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",").alias(c) for c in lists))


def unknown_proofs(spark: SparkSession, d: str) -> DataFrame:
    """Which unknowns made of parts may be closed: those proved by evidence that is itself proven."""
    t = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    key = F.col("k").cast("string")
    status = F.when(F.col("z") % 3 == 0, "tested").when(F.col("z") % 3 == 1, "declared").otherwise("runtime_verified")
    nodes = t.select(F.concat(F.lit("unknown."), key).alias("id"), F.lit("unknown").alias("kind"), F.lit("declared").alias("status")).unionByName(t.select(F.concat(F.lit("evidence."), key).alias("id"), F.lit("evidence").alias("kind"), status.alias("status")))
    rel = t.select(F.concat(F.lit("unknown."), key).alias("from_id"), F.when(F.col("k") % 7 == 0, "serves").otherwise("proved_by").alias("kind"), F.explode(F.array(F.concat(F.lit("evidence."), key), F.concat(F.lit("evidence."), (F.col("k") + 1).cast("string")))).alias("to_id"))
    return authored.resolvable_unknowns({"nodes": nodes, "relations": rel})


def candidate_seals(spark: SparkSession, d: str) -> DataFrame:
    """The first thing wrong with the seals of search results made of customers, a fault of every kind among them."""
    t = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("file_path"), F.lit(0.5).alias("score"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("snippet"))
    own = F.sha2(F.concat_ws("\0", "file_path", F.lit("0.5"), F.coalesce("snippet", F.lit(""))), 256)
    k = F.col("k")
    seal = F.when(k % 11 > 0, F.struct(F.when(k % 5 == 0, "old").otherwise("now").alias("source_hash"), F.sha2(F.when(k % 3 == 0, "other").otherwise("asked").cast("binary"), 256).alias("query_hash"), F.when(k % 7 == 0, F.lit(None)).otherwise(own).alias("result_hash")))
    return context.validate_candidates(t.withColumn("seal", seal), "now", "asked").select("k", F.coalesce("reason", F.lit("")).alias("reason"))


def coordinate_categories(spark: SparkSession, d: str) -> DataFrame:
    """Category and kind of knowledge of authored nodes made of parts, over all kinds, levels, statuses and provenances."""
    at = lambda names, i: F.element_at(F.array(*(F.lit(n) for n in names)), (i % len(names) + 1).cast("int"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("k"))
    kind, level = at(("goal", "invariant", "decision", "assumption"), F.col("k")), (F.col("k") / 4).cast("int") % 7
    status, by = at(("tested", "statically_verified", "runtime_verified", "declared"), (F.col("k") / 28).cast("int")), at(("author", "derived", "agent"), (F.col("k") / 112).cast("int"))
    return p.select("k", control.semantic_category(kind, level).alias("category"), control.epistemic_status(status, by).alias("known"))


def proof_decorations(spark: SparkSession, d: str) -> DataFrame:
    """Relations of a kind that start at what was visited."""
    li = read(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "proves").otherwise("governs").alias("kind"), F.col("l_partkey").alias("source"))
    visited = read(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("id"))
    return control.decorations(li, visited, "proves").groupBy("source").agg(F.count("*").alias("n"))


def patch_structure(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of each file's hunks, without their bytes."""
    x = observed.structural(observed.observed_hunks(patches(spark, d)))
    return x.select("patch_id", F.size("hunks").cast("long").alias("n_hunks"), F.col("hunks")[0]["old_start"].alias("first"), F.col("hunks")[0]["new_start"].alias("first_new"))


def missing_hunks(spark: SparkSession, d: str) -> DataFrame:
    """Hunks that customers refer to and orders do not hold."""
    wanted = read(spark, d, "customer").select(F.concat(F.lit("h"), (F.col("c_custkey") * 3).cast("string")).alias("identity"))
    return observed.missing_hunks(wanted, read(spark, d, "orders").select(F.concat(F.lit("h"), "o_custkey").alias("identity")))


def evidence_verified(spark: SparkSession, d: str) -> DataFrame:
    """Digests of evidence that are as stated, of each kind that evidence may have."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    key = F.col("k").cast("string")
    sha = lambda c: F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))
    kind = F.element_at(F.array(*(F.lit(x) for x in ("observed_diff_hunk", "semantic_node", "commit", "document_span", "test_result"))), (F.col("k") % 5 + 1).cast("int"))
    stated = F.when(F.col("k") % 3 == 0, sha(F.lit("wrong"))).when(F.col("k") % 5 > 2, sha(F.col("name"))).otherwise(sha(key))
    locator = F.when(F.col("k") % 5 == 2, F.concat(F.when(F.col("k") % 2 == 0, "git:").otherwise(""), key)).otherwise(key)
    rel = p.select(F.array(F.struct(kind.alias("kind"), locator.alias("locator"), stated.alias("digest"))).alias("evidence"))
    got = refinement.verified_digests(rel, p.select(sha(key).alias("identity")), p.select(key.alias("id"), sha(key).alias("digest")), p.select(key.alias("commit_id")), p.select(key.alias("rel_path"), F.col("name").alias("content")))
    return got.groupBy(F.left("digest", F.lit(8)).alias("head")).agg(F.count("*").alias("n"))


def architecture_elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements of an architecture made of parts with their fingerprints, and relations between them."""
    p = read(spark, d, "part")
    coords = p.select(F.concat(F.lit("semantic:"), "p_partkey").alias("id"), F.when(F.col("p_size") % 5 > 0, F.col("p_size") % 7).alias("level"), F.when(F.col("p_partkey") % 6 > 0, F.col("p_brand")).alias("category"), F.col("p_name").alias("label"), F.lit("human_declared").alias("epistemic_status"), F.lit("goal").alias("source_kind"))
    meta = p.select(F.concat(F.lit("semantic:"), "p_partkey").alias("id"), F.create_map(F.lit("type"), F.col("p_type"), F.lit("a"), F.lit("b")).alias("metadata"))
    edges = p.select(F.concat(F.lit("semantic:"), "p_partkey").alias("from_id"), F.concat(F.lit("semantic:"), F.col("p_partkey") + 1).alias("to_id"), F.lit("serves").alias("relation"))
    e, r = control.architecture(coords, edges, meta)
    return e.select("id", F.sha2("fingerprint", 256).alias("what")).unionByName(r.select(F.concat_ws(">", "from_id", "to_id").alias("id"), F.col("fingerprint").alias("what")))


def coordinate_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """One fingerprint of the whole coordinate graph."""
    (n, e), m = graph(spark, d, keep=True), _model(spark, d)
    x = control.coordinates(n, m["nodes"])
    s = control.structural_edges(x, e, m["relations"], m["links"], n)
    return control.graph_fingerprint(x.select("id", "plane", "source_kind"), s)


_SHA = "'sha256:' || sha256({})"
SQL = {
    "change_patches": """WITH t AS (SELECT c_custkey k, list_distinct(['a', c_mktsegment, CAST(c_custkey % 3 AS VARCHAR)]) s FROM customer)
SELECT k AS id, array_to_string(CASE WHEN k % 2 = 0 THEN list_filter(['a', (SELECT c_mktsegment FROM customer WHERE c_custkey = k), CAST(k % 3 AS VARCHAR), 'n'], lambda x: x NOT IN ('a', '0')) ELSE ['a', (SELECT c_mktsegment FROM customer WHERE c_custkey = k), CAST(k % 3 AS VARCHAR)] END, ',') AS serves,
 concat_ws(',', CASE WHEN k % 5 > 0 THEN 'p' END, CASE WHEN k % 2 = 0 THEN 'q' END) AS preserves, CASE WHEN k % 4 = 0 THEN 'e' ELSE '' END AS requires_evidence, CASE WHEN k % 2 = 0 THEN '' ELSE 'u' END AS unknowns FROM t""",
    "unknown_proofs": f"""WITH t AS (SELECT p_partkey k, p_size % 3 <> 1 ok FROM part), n AS (SELECT a.k, count(*) n FROM t a JOIN t b ON b.k IN (a.k, a.k + 1) AND b.ok WHERE a.k % 7 <> 0 GROUP BY 1)
SELECT concat('unknown.', t.k) AS id, coalesce(n, 0) AS n_proofs, n IS NOT NULL AS resolvable FROM t LEFT JOIN n USING (k) WHERE {len(PROVEN)} = 3""",
    "candidate_seals": "SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN 'PROVIDER_SEAL_MISSING' WHEN c_custkey % 7 = 0 THEN 'PROVIDER_SEAL_INVALID' WHEN c_custkey % 5 = 0 THEN 'PROVIDER_SOURCE_STALE' WHEN c_custkey % 3 = 0 THEN 'PROVIDER_QUERY_MISMATCH' ELSE '' END AS reason FROM customer",
    "coordinate_categories": """WITH t AS (SELECT p_partkey k, ['goal', 'invariant', 'decision', 'assumption'][p_partkey % 4 + 1] kind, p_partkey // 4 % 7 l, p_partkey // 28 % 4 s, p_partkey // 112 % 3 b FROM part)
SELECT k, CASE WHEN kind = 'goal' AND l = 6 THEN 'strategy' WHEN kind <> 'assumption' THEN kind ELSE ['syntax', 'code_entity', 'bounded_context', 'capability', 'policy', 'goal', 'strategy'][l + 1] END AS category,
 CASE s WHEN 0 THEN 'test_observed' WHEN 1 THEN 'statically_observed' WHEN 2 THEN 'dynamically_observed' ELSE CASE b WHEN 0 THEN 'human_declared' WHEN 1 THEN 'statically_observed' ELSE 'llm_inferred' END END AS known FROM t""",
    "proof_decorations": "SELECT l_partkey AS source, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 0 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY 1",
    "patch_structure": f"""WITH {HUNKS} SELECT concat_ws('|', diff_id, file_path) AS patch_id, count(*) AS n_hunks, CAST(min(old_start) AS BIGINT) AS first, CAST(arg_min(new_start, struct_pack(a := old_start, b := old_lines, c := new_start)) AS BIGINT) AS first_new
 FROM h WHERE old_start IS NOT NULL AND new_start IS NOT NULL GROUP BY 1 HAVING NOT bool_or(hunk_no = 7 AND old_lines + new_lines > 0)""",
    "missing_hunks": "SELECT DISTINCT concat('h', c_custkey * 3) AS identity FROM customer WHERE c_custkey * 3 NOT IN (SELECT o_custkey FROM orders)",
    "evidence_verified": f"SELECT left(g, 8) AS head, count(*) AS n FROM (SELECT DISTINCT CASE WHEN p_partkey % 5 > 2 THEN {_SHA.format('p_name')} ELSE {_SHA.format('CAST(p_partkey AS VARCHAR)')} END g FROM part WHERE p_partkey % 3 <> 0) GROUP BY 1",
    "architecture_elements": """WITH c AS (SELECT p_partkey k, 'semantic:' || p_partkey id, concat('{"category":"', p_brand, '","epistemicStatus":"human_declared","label":"', p_name, '","level":', p_size % 7, ',"metadata":{"a":"b","type":"', p_type, '"},"sourceKind":"goal"}') f FROM part WHERE p_size % 5 > 0 AND p_partkey % 6 > 0)
SELECT id, sha256(f) AS what FROM c UNION ALL SELECT concat('semantic:', k, '>semantic:', k + 1), sha256('serves') FROM c WHERE k + 1 IN (SELECT k FROM c)""",
    "coordinate_fingerprint": f"""{PLANE}, x AS (SELECT k, sha256(p) h, sha256(k) g FROM (SELECT id k, concat('{{"id":', to_json(id), ',"plane":"', CASE WHEN starts_with(id, 'repo:') THEN 'A' ELSE 'B' END, '","source_kind":', to_json(k), '}}') p FROM co UNION ALL SELECT concat_ws(chr(0), f, t, relation), 'edge' FROM se)),
a AS (SELECT left(g, 6) g, sha256(string_agg(h, chr(10) ORDER BY k)) h FROM x GROUP BY 1), b AS (SELECT left(g, 3) g, sha256(string_agg(h, chr(10) ORDER BY g)) h FROM a GROUP BY left(g, 3))
SELECT 'sha256:' || sha256(concat('coordinates:v1', chr(0), string_agg(h, chr(10) ORDER BY g))) AS fingerprint FROM b""",
}
QUERIES = {q.__name__: q for q in (
    change_patches, unknown_proofs, candidate_seals, coordinate_categories, proof_decorations, patch_structure, missing_hunks, evidence_verified, architecture_elements, coordinate_fingerprint,
)}
