"""The versioned report of a verified diff: one JSON object a diff, with optional parts left out where they are empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.hashing import json_text
from ripplegraph.operators import impact
from ripplegraph.operators.claims import claim_rows
from ripplegraph.operators.graph import with_lines
from ripplegraph.runtime import checkpointed

#: Fixed value: the version that readers of the report know.
SCHEMA_VERSION = 1


def verify_reports(nodes: DataFrame, edges: DataFrame, hunks: DataFrame, by: DataFrame | None = None, co_changes: DataFrame | None = None, git: DataFrame | None = None) -> DataFrame:
    """(diff_id, verdict, report) of every diff.

    ``by`` are the rules, ``co_changes`` (diff_id, file, co_file, commits, pos) what history adds, ``git`` (diff_id, base, head,
    merge_base, range) the revisions. Lists are in order of ids; files and texts in order of themselves.

    Every part of a report is a row (diff_id, part, order, JSON); one shuffle by diff brings the parts together.
    """
    x = impact.analyze(nodes, edges, hunks, by)
    named = with_lines(nodes).select("id", "name", "kind", "file_path", "exported", "start_line")
    hit = checkpointed(x["impacted"].join(named, "id"))
    symbol = lambda p="": F.to_json(F.struct(F.col(f"{p}id").alias("id"), F.col(f"{p}name").alias("name"), F.col(f"{p}kind").alias("kind"), F.col(f"{p}file_path").alias("file")))
    part = lambda df, name, order, json: df.select("diff_id", F.lit(name).alias("part"), order.alias("o"), json.alias("j"))
    key = lambda *cs: F.array(*(c.cast("string") for c in cs))

    files = hunks.select("diff_id", "file_path").distinct()
    claims = claim_rows(nodes, edges).select(F.col("id").alias("claim_id"), "statement", F.col("kind").alias("claim_kind"), "verification_status", F.explode(F.array_distinct("subjects")).alias("id"))
    claims = checkpointed(x["impacted"].join(claims, "id").drop("id").distinct())
    said = F.to_json(F.struct("statement", F.col("claim_kind").alias("kind"), F.col("verification_status").alias("verificationStatus")))
    tests = impact.recommended_tests(nodes, edges, hunks).join(named.select(F.col("id").alias("test_id"), "name", "file_path"), "test_id")
    uses = impact.impacted_consumers(nodes, edges, x["impacted"])
    who = named.select(*(F.col(c).alias(f"c_{c}") for c in ("id", "name", "kind", "file_path")))
    uses = uses.join(who, uses["consumer_id"] == who["c_id"]).groupBy("diff_id", F.col("symbol_id").alias("id")).agg(_joined(F.col("consumer_id"), symbol("c_")).alias("consumers"))
    uses = uses.join(named, "id")
    places = x["met"].select("diff_id", "condition", "id").join(named.select("id", "file_path", "start_line"), "id")
    place = F.when(F.col("file_path").isNotNull(), F.to_json(F.struct(F.col("file_path").alias("file"), F.col("start_line").alias("line"))))
    places = places.groupBy("diff_id", "condition").agg(_joined(F.col("id"), json_text(F.col("id"))).alias("ids"), _joined(F.col("id"), place).alias("places"))
    found = x["findings"].join(places, ["diff_id", "condition"], "left")
    quoted = lambda c: json_text(F.col(c))
    finding = F.concat(
        F.lit('{"rule":'), quoted("condition"), F.lit(',"tier":'), quoted("tier"), F.lit(',"severity":'), quoted("severity"), F.lit(',"message":'), quoted("message"),
        F.lit(',"nodeIds":['), F.coalesce("ids", F.lit("")), F.lit('],"locations":['), F.coalesce("places", F.lit("")), F.lit("]}"),
    )
    parts = [
        part(files, "changedFiles", key(F.col("file_path")), quoted("file_path")), part(hit.where(F.col("kind").isin(*impact.SYMBOLS)), "changedSymbols", key(F.col("id")), symbol()),
        part(claims.where("claim_kind = 'contract'"), "impactedContracts", key(F.col("claim_id")), said), part(claims.where("claim_kind = 'invariant'"), "impactedInvariants", key(F.col("claim_id")), said),
        part(claims.where("verification_status in ('deprecated', 'contradicted')"), "contradictions", key(F.col("claim_id")), said),
        part(tests, "recommendedTests", key(F.col("test_id")), F.to_json(F.struct("name", F.col("file_path").alias("file")))),
        part(impact.unknowns(nodes, edges, hunks, x["impacted"]), "unknowns", key(F.col("unknown")), quoted("unknown")), part(found, "findings", key(F.lpad(F.col("ord").cast("string"), 10, "0")), finding),
        part(uses, "impactedConsumers", key(F.col("id")), F.concat(F.lit('{"symbol":'), symbol(), F.lit(',"consumers":['), "consumers", F.lit("]}"))),
    ]
    if co_changes is not None:
        c = co_changes.groupBy("diff_id", "file").agg(_joined(F.col("pos"), F.to_json(F.struct(F.col("co_file").alias("file"), "commits"))).alias("co"))
        parts.append(part(c, "coChangedFiles", key(F.col("file")), F.concat(F.lit('{"file":'), quoted("file"), F.lit(',"coChanged":['), "co", F.lit("]}"))))
    g = reduce(DataFrame.unionByName, parts).groupBy("diff_id").agg(F.sort_array(F.collect_list(F.struct("part", "o", "j"))).alias("parts"))
    d = x["verdicts"].join(g, "diff_id")
    revisions = ("base", "head", "merge_base", "range")
    d = d.join(git.select("diff_id", *revisions), "diff_id", "left") if git is not None else d.withColumns({c: F.lit(None).cast("string") for c in revisions})
    of = lambda name: F.transform(F.filter("parts", lambda p: p["part"] == name), lambda p: p["j"])
    listed = lambda name: F.concat(F.lit(f',"{name}":['), F.array_join(of(name), ","), F.lit("]"))
    some = lambda name: F.when(F.size(of(name)) > 0, listed(name)).otherwise("")
    revision = lambda name, c: F.concat(F.lit(f',"{name}":'), F.coalesce(json_text(F.col(c)), F.lit("null")))
    report = F.concat(
        F.lit(f'{{"schemaVersion":{SCHEMA_VERSION},"verdict":'), json_text(F.col("verdict")), revision("base", "base"), revision("head", "head"), revision("mergeBase", "merge_base"), revision("range", "range"),
        *(listed(n) for n in ("changedFiles", "changedSymbols", "impactedContracts", "impactedInvariants", "recommendedTests", "contradictions", "unknowns", "findings")), some("impactedConsumers"), some("coChangedFiles"),
        F.lit(',"summary":{"blockCount":'), F.col("n_block").cast("string"), F.lit(',"warnCount":'), F.col("n_warn").cast("string"), F.lit("}}"),
    )
    return d.select("diff_id", "verdict", report.alias("report"))


def _joined(order: Column, json: Column) -> Column:
    """JSON texts of a group in order, parted by commas; nulls left out."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(json.isNotNull(), F.struct(order.alias("o"), json.alias("j"))))), lambda x: x["j"]), ",")
