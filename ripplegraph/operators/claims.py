"""Claims derived from the graph, their gates and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.functions.ids import claim_id
from ripplegraph.functions.scoring import POLICIES, by_status, clamp01, confidence, reachability, role_match, weighted
from ripplegraph.operators.graph import is_deprecated, statement_of
from ripplegraph.operators.versions import evidence_id
from ripplegraph.runtime import checkpointed

#: Kinds that are code, the module included.
CODE = ("module", "function", "class", "interface", "type", "enum")


def _linked(n: DataFrame, edges: DataFrame, kind: str, inwards: bool) -> DataFrame:
    """(id, others): what is at the other end of a node's edges of a kind, in order of edge id."""
    own, other = ("to_id", "from_id") if inwards else ("from_id", "to_id")
    g = edges.where(F.col("kind") == kind).groupBy(F.col(own).alias("id")).agg(F.sort_array(F.collect_list(F.struct("id", other))).alias("o"))
    return n.join(g.select("id", F.col(f"o.{other}").alias("others")), "id", "left").withColumn("others", F.coalesce("others", F.array().cast("array<string>")))


def claim_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, statement, subjects, verification_status, tags, extra) of all claims, without their evidence.

    Nine rules, each a frame of (kind, statement, subjects, status, tags): invariants, capabilities, declared contracts,
    exported interfaces and types, behaviours, decisions, risks, deprecations and contradictions. Status comes from
    evidence: an invariant is tested if a node it constrains is. Subjects keep their order, and repeats in it count for the
    id. ``extra`` is evidence of an edge, where edges carry any.
    """
    tested = edges.where("kind = 'tested_by'").select(F.col("from_id").alias("s"), F.lit(True).alias("t")).distinct()
    of = lambda kind: nodes.where(F.col("kind") == kind)
    said = lambda default: F.coalesce(statement_of(nodes), default)
    one = lambda *tags: F.array(*(F.lit(t) for t in tags))

    def claim(df: DataFrame, kind: str, statement: Column, subjects: Column, status: Column, tags: Column, extra: Column | None = None) -> DataFrame:
        extra = F.array().cast("array<string>") if extra is None else extra
        return df.select(F.lit(kind).alias("kind"), statement.alias("statement"), subjects.alias("subjects"), status.alias("verification_status"), tags.alias("tags"), extra.alias("extra"))

    def with_tested(df: DataFrame) -> DataFrame:
        hit = df.select("id", F.explode("others").alias("s")).join(tested, "s").groupBy("id").agg(F.lit(True).alias("any_tested"))
        return df.join(hit, "id", "left")

    name = F.col("name")
    subjects = F.concat(F.array("id"), F.col("others"))
    status = lambda tag, then: F.when(F.coalesce("any_tested", F.lit(False)), "tested").when(F.array_contains("tags", tag), then).otherwise("inferred")
    inv = with_tested(_linked(of("invariant"), edges, "constrained_by", True))
    cap = with_tested(_linked(of("capability"), edges, "implements_capability", True)).where((F.size("others") > 0) | F.array_contains("tags", "from-doc"))
    con, beh, risk = _linked(of("contract"), edges, "declares", True), _linked(of("test"), edges, "covers", False).where("size(others) > 0"), _linked(of("risk"), edges, "related_to", True)
    api = nodes.where("kind in ('interface', 'type') and exported")
    docs = of("document")
    old = docs.where(is_deprecated(nodes))
    proof = F.transform("evidence", evidence_id) if "evidence" in edges.columns else F.array().cast("array<string>")
    against = edges.where("kind = 'contradicts'").select(F.col("from_id").alias("id"), F.col("to_id").alias("target"), proof.alias("extra"))
    against = docs.join(against, "id").join(nodes.select(F.col("id").alias("target"), F.col("name").alias("target_name")), "target", "left")
    lit = F.lit
    claims = reduce(DataFrame.unionByName, (
        claim(inv, "invariant", said(F.concat(lit("Invariant: "), name)), subjects, status("from-doc", "documented"), F.concat(one("invariant"), F.col("tags"))),
        claim(cap, "capability", F.concat(lit('Capability "'), name, lit('" is implemented by '), F.size("others").cast("string"), lit(" symbol(s).")), subjects, status("from-code", "documented"), one("capability")),
        claim(con, "contract", said(F.concat(lit("Contract: "), name)), subjects, lit("statically_verified"), one("contract")),
        claim(api, "contract", F.concat(lit("Exported "), F.col("kind"), lit(' "'), name, lit('" is a public, compiler-enforced contract.')), F.array("id"), lit("statically_verified"), one("contract", "exported")),
        claim(beh, "behavior", F.concat(lit("Behaviour covered by test "), name, lit(".")), subjects, lit("tested"), one("behavior")),
        claim(of("decision"), "decision", said(name), F.array("id"), lit("documented"), one("decision")),
        claim(risk, "risk", said(F.concat(lit("Risk: "), name)), subjects, lit("inferred"), one("risk")),
        claim(old, "deprecation", F.concat(lit('Deprecated documentation "'), name, lit('" — its assertions are no longer authoritative.')), F.array("id"), lit("deprecated"), one("deprecation", "documentation")),
        claim(against, "assumption", F.concat(lit('Documentation "'), name, lit('" contradicts "'), F.coalesce("target_name", "target"), lit('".')), F.array("id", "target"), lit("contradicted"), one("contradiction", "documentation"), F.col("extra")),
    ))
    return claims.withColumn("id", claim_id(F.col("kind"), F.col("statement"), F.col("subjects")))


def claims_by_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The claims of ``build_claims`` where nobody asks for evidence or confidence: what their status alone gives."""
    st = F.col("verification_status")
    return claim_rows(nodes, edges).select(
        "id", "kind", "statement", F.array_distinct("subjects").alias("subject_node_ids"), F.array().cast("array<string>").alias("evidence_ids"), by_status(st, 0).alias("authority"), by_status(st, 2).alias("freshness"), st, "tags"
    )


def build_claims(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, statement, subject_node_ids, evidence_ids, authority, freshness, confidence, verification_status, tags):
    ``claim_rows`` with the evidence of all subjects, joined at the end, and the scores it gives."""
    claims = claim_rows(nodes, edges)
    proof = nodes.select(F.col("id").alias("s"), F.transform("evidence", lambda r: F.struct(evidence_id(r).alias("i"), r["source_kind"].alias("k"))).alias("p"))
    # The evidence of a contradicting edge is that edge's alone; the documents' target lends none.
    lend = F.when(F.col("kind") == "assumption", F.slice("subjects", 1, 1)).otherwise(F.col("subjects"))
    got = claims.select("id", F.explode(F.array_distinct(lend)).alias("s")).join(proof, "s").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("p"))).alias("p"))
    claims = claims.join(got, "id", "left")
    ids = F.array_sort(F.array_union(F.coalesce(F.col("p.i"), F.array().cast("array<string>")), F.coalesce("extra", F.array().cast("array<string>"))))
    extra_kinds = F.transform(F.coalesce("extra", F.array().cast("array<string>")), lambda i: F.split(i, ":")[1])
    kinds = F.size(F.array_union(F.coalesce(F.col("p.k"), F.array().cast("array<string>")), extra_kinds))
    st = F.col("verification_status")
    return claims.select(
        "id", "kind", "statement", F.array_distinct("subjects").alias("subject_node_ids"), ids.alias("evidence_ids"), by_status(st, 0).alias("authority"),
        by_status(st, 2).alias("freshness"), confidence(st, kinds).alias("confidence"), st, "tags",
    )


def contradictions(claims: DataFrame) -> DataFrame:
    """Claims that are not normative: deprecated or contradicted."""
    return claims.where("verification_status in ('deprecated', 'contradicted')")


def ranked_contradictions(claims: DataFrame) -> DataFrame:
    """(pos, id, ...) of the claims that are not normative, the surest first, ties by id. Positions are given by ranges of the
    order, so no task numbers all of them."""
    x = checkpointed(contradictions(claims).withColumn("_o", F.struct((-F.col("confidence")).alias("c"), F.col("id").alias("i"))).repartitionByRange("_o").sortWithinPartitions("_o").withColumn("_p", F.spark_partition_id()))
    before = x.groupBy("_p").agg(F.count("*").alias("k")).withColumn("skip", F.coalesce(F.sum("k").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.join(F.broadcast(before.select("_p", "skip")), "_p")  # a row a partition
    within = F.row_number().over(W.partitionBy("_p").orderBy("_o"))
    return x.select((F.col("skip") + within).alias("pos"), *claims.columns)


def evaluate_claims(claims: DataFrame, nodes: DataFrame, hops: DataFrame, question: str, contexts: list[str] | None = None, open_contradictions: DataFrame | None = None) -> DataFrame:
    """(id, kind, eligible, score, hop, the five gates, the components) of every claim for one question.

    ``hops`` has (id, hop) from the task's entry points, and may be empty: then nothing has to be reachable. A claim that
    fails a gate is ineligible and scores 0.
    """
    preferred, required, disallowed = POLICIES[question]
    st = F.col("verification_status")
    facts = nodes.select(F.col("id").alias("s"), F.col("kind").isin(*CODE).alias("code"), "bounded_context").join(hops.select(F.col("id").alias("s"), "hop"), "s", "left")
    g = claims.select("id", F.explode("subject_node_ids").alias("s")).join(facts, "s").groupBy("id").agg(
        F.bool_or("code").alias("code"), F.min("hop").alias("hop"), F.count("bounded_context").alias("n_context"),
        F.bool_or(F.col("bounded_context").isin(*(contexts or [""]))).alias("in_context"),
    )
    x = claims.join(g, "id", "left")
    any_entry = F.lit(not hops.isEmpty())
    contradicted = st == "contradicted"
    if open_contradictions is not None:
        x = x.join(open_contradictions.select("id", F.lit(True).alias("open")), "id", "left")
        contradicted = contradicted | F.coalesce("open", F.lit(False))
    code = F.coalesce("code", F.lit(False))
    gates = {
        "status_allowed": ~st.isin(*disallowed),
        "contradiction_resolved": ~contradicted,
        "within_context": F.lit(True) if not contexts else (F.coalesce("n_context", F.lit(0)) == 0) | F.coalesce("in_context", F.lit(False)),
        "sufficient": F.lit(True) if required is None else st.isin(*required),
        "reachable": ~code | ~any_entry | F.col("hop").isNotNull(),
    }
    x = x.withColumns(gates)
    eligible = reduce(Column.__and__, (F.col(g) for g in gates))
    reach = F.when(F.col("hop").isNotNull(), reachability(F.col("hop"))).when(code, 0.0).otherwise(0.3)
    fit = role_match(F.col("kind"), F.array(*(F.lit(p) for p in preferred)))
    raw = weighted(fit, F.col("authority"), reach, by_status(st, 1), F.col("freshness"), contradicted)
    return x.select("id", "kind", eligible.alias("eligible"), F.when(eligible, clamp01(raw)).otherwise(0.0).alias("score"), "hop", *gates, fit.alias("role_match"), reach.alias("graph_reachability"))
