"""Authored intent: the block language, links, footprints, slices, checks and composed change verdicts.

Text is parsed a file at a time into rows (blocks, fields, diagnostics); everything after that is relational.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.functions.ids import SEMANTIC_KINDS, is_semantic_id, link_of, semantic_kind
from ripplegraph.operators.refinement import relation_spans
from ripplegraph.runtime import broadcast_if_small, checkpointed

#: Vocabularies of the block language.
STATUSES = ("declared", "proposed", "assumed", "tested", "statically_verified", "runtime_verified", "contradicted", "stale")
LIFECYCLES = ("draft", "active", "verified", "partial", "blocked", "stale", "superseded")
PROVENANCES = ("author", "agent", "derived")
RELATIONS = ("implements", "preserves", "serves", "justifies", "depends_on", "requires_evidence", "proved_by", "risks", "contradicts", "supersedes")
SCALARS = ("statement", "rule", "status", "provenance", "appliesAtLevel")
OTHER_FIELDS = ("link", "file", "tag", "meta", "unknown", "requires")
PROVEN = ("tested", "statically_verified", "runtime_verified")
CHANGE_RELATIONS = ("serves", "preserves", "requires_evidence")

_ROWS = pa.schema([
    ("file", pa.string()), ("row", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("block", pa.int32()), ("kind", pa.string()), ("id", pa.string()), ("key", pa.string()), ("value", pa.string()),
])
ROWS_DDL = "file string, row string, line int, col int, block int, kind string, id string, key string, value string"


def parse_text(file: str, text: str) -> Iterator[tuple]:
    """Rows of one text: ``block`` for each header, ``field`` for each value of a block, ``error`` and ``warning``.

    A header begins in the first column, fields are indented. ``key:`` alone opens a list of ``- item`` lines; ``[a, b]``
    gives several values, but never for a scalar. Nothing raises: what cannot be read becomes a diagnostic.
    """
    block, kind, name, list_key = -1, None, None, None

    def say(level: str, line: int, col: int, message: str) -> tuple:
        return (file, level, line, col, block if name else None, kind, name, None, message)

    lines = text.replace("\r\n", "\n").split("\n")
    taken = {k for a, b in relation_spans(lines) for k in range(a, b)}  # relations are another parser's
    for line, raw in enumerate(lines, 1):
        body = raw.strip()
        if line - 1 in taken:
            continue
        if not body or body[0] == "#":
            list_key = None
            continue
        if "\t" in raw:
            yield say("warning", line, 1, "tabs are not recommended for indentation; use spaces")
        content = raw.lstrip(" \t")
        col = len(raw) - len(content) + 1
        if col == 1:
            list_key = None
            kind, _, rest = content.replace("\t", " ").partition(" ")
            name = rest.strip()
            if kind not in SEMANTIC_KINDS:
                problem = say("error", line, 1, f'unknown block kind "{kind}"')
                kind = name = None
                yield problem
            elif not name:
                problem = say("error", line, len(kind) + 2, f"{kind} block is missing an id")
                kind = name = None
                yield problem
            else:
                block += 1
                yield (file, "block", line, 1, block, kind, name, None, None)
        elif name is None:
            yield say("error", line, col, "field outside of any block")
        elif content.startswith("-"):
            item = content[1:].strip()
            if list_key is None:
                yield say("error", line, col, "list item has no preceding key")
            elif item:
                yield (file, "field", line, col, block, kind, name, list_key, item)
        else:
            key, colon, value = (x.strip() for x in content.partition(":"))
            list_key = None
            if not colon:
                yield say("error", line, col, f'expected "key: value", got "{content}"')
            elif not value and key in SCALARS:
                yield say("error", line, col, f'"{key}" needs a value')
            elif not value:
                list_key = key
            elif value[0] == "[" and value[-1] == "]" and key not in SCALARS:
                for item in filter(None, map(str.strip, value[1:-1].split(","))):
                    yield (file, "field", line, col, block, kind, name, key, item)
            else:
                yield (file, "field", line, col, block, kind, name, key, value)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [r for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t is not None for r in parse_text(f, t)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _ROWS, strict=True)], schema=_ROWS)


def parse_blocks(files: DataFrame) -> DataFrame:
    """The rows of ``parse_text`` for (file, text) of many files; null texts give none."""
    return files.select(F.col("file").cast("string"), "text").mapInArrow(_parse, ROWS_DDL)


def relation_kind(key: Column) -> Column:
    return F.when(key == "requires", "requires_evidence").when(key.isin(*RELATIONS), key)


def model(rows: DataFrame) -> dict[str, DataFrame]:
    """The model of parsed rows: ``nodes``, ``relations``, ``links``, ``changes``, ``change_refs`` and ``diagnostics``.

    Nodes and changes come one per block, with the last statement, status and provenance given, and defaults; ids may
    repeat. Values that the vocabularies do not know become diagnostics and are not taken.
    """
    f = rows.where("row = 'field'")
    at = ["file", "block"]
    last = lambda cond: F.max_by("value", F.when(cond, F.col("line")))
    is_change = F.col("kind") == "change"
    known_status = F.when(is_change, F.col("value").isin(*LIFECYCLES)).otherwise(F.col("value").isin(*STATUSES))
    key = F.col("key")
    g = f.groupBy(*at).agg(
        last(key.isin("statement", "rule")).alias("statement"), last((key == "status") & known_status).alias("status"), last((key == "provenance") & F.col("value").isin(*PROVENANCES)).alias("provenance"),
        last((key == "appliesAtLevel") & F.col("value").rlike("^[1-6]$")).alias("level"), F.array_sort(F.collect_set(F.when(key == "tag", F.col("value")))).alias("tags"),
    )
    b = rows.where("row = 'block'").select(*at, "line", "kind", "id").join(g, at, "left")
    default = F.when(is_change, "draft").otherwise("declared")
    b = b.select(*at, "line", "kind", "id", F.coalesce("statement", F.lit("")).alias("statement"), F.coalesce("status", default).alias("status"), F.coalesce("provenance", F.lit("author")).alias("provenance"), F.col("level").cast("int").alias("level"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    rel = f.withColumn("relation", relation_kind(key))
    link_kind, link_ref = link_of(F.when(key == "file", F.concat(F.lit("file:"), F.col("value"))).otherwise(F.col("value")))
    field = F.when(F.col("key") == "unknown", "unknown").otherwise(F.col("relation"))
    tracked = F.col("relation").isin(*CHANGE_RELATIONS) | (F.col("key") == "unknown")
    bad = lambda cond, level, text: f.where(cond).select("file", "line", "col", F.lit(level).alias("level"), text.alias("message"))
    quoted = lambda before, c, after="": F.concat(F.lit(before + ' "'), c, F.lit('"' + after))
    prefix = semantic_kind(F.col("id"))
    diagnostics = reduce(DataFrame.unionByName, (
        rows.where("row in ('error', 'warning')").select("file", "line", "col", F.col("row").alias("level"), F.col("value").alias("message")),
        rows.where("row = 'block'").where(prefix.isNotNull() & (prefix != F.col("kind"))).select("file", "line", (F.length("kind") + 2).alias("col"), F.lit("warning").alias("level"), F.concat(F.lit('id "'), "id", F.lit('" has a "'), prefix, F.lit('" prefix but the block is "'), "kind", F.lit('"')).alias("message")),
        bad((key == "status") & ~known_status, "error", quoted("unknown status", F.col("value"))),
        bad((key == "provenance") & ~F.col("value").isin(*PROVENANCES), "warning", quoted("unknown provenance", F.col("value"))),
        bad((key == "appliesAtLevel") & ~F.col("value").rlike("^[1-6]$"), "error", quoted("invalid appliesAtLevel", F.col("value"))),
        bad((key == "meta") & ~F.contains("value", F.lit("=")), "warning", quoted("meta expects key=value, got", F.col("value"))),
        bad(~key.isin(*SCALARS, *OTHER_FIELDS, *RELATIONS), "warning", quoted("unknown field", key, " (ignored)")),
        b.where("statement = ''").select("file", "line", F.lit(1).alias("col"), F.lit("warning").alias("level"), F.concat("kind", F.lit(' "'), "id", F.lit('" has no statement')).alias("message")),
    ))
    return {
        "nodes": b.where(~is_change),
        "changes": b.where(is_change),
        "relations": rel.where(~is_change & F.col("relation").isNotNull()).select(F.col("id").alias("from_id"), F.col("relation").alias("kind"), F.col("value").alias("to_id")).distinct(),
        "change_refs": rel.where(is_change & tracked).select(F.col("id").alias("change_id"), field.alias("field"), F.col("value").alias("ref")).distinct(),
        "links": f.where("key in ('link', 'file')").select(F.col("id").alias("owner_id"), link_kind.alias("kind"), link_ref.alias("ref")).distinct(),
        "diagnostics": diagnostics,
    }


def format_blocks(m: dict[str, DataFrame]) -> DataFrame:
    """(id, text): each block in canonical form: fixed order of fields, values sorted, one per line."""
    line = lambda k, v: F.concat(F.lit("  "), k, F.lit(": "), v)
    head = m["nodes"].unionByName(m["changes"]).select(
        "id", F.array_compact(F.array(F.concat("kind", F.lit(" "), "id"), line(F.lit("statement"), F.col("statement")), line(F.lit("status"), F.col("status")), line(F.lit("provenance"), F.col("provenance")), line(F.lit("appliesAtLevel"), F.col("level").cast("string")))).alias("head"),
        F.transform("tags", lambda t: line(F.lit("tag"), t)).alias("tags"),
    )
    order = lambda c, names: F.array_position(F.array(*(F.lit(n) for n in names)), c)
    rel = m["relations"].select(F.col("from_id").alias("id"), order(F.col("kind"), RELATIONS).alias("o"), F.col("to_id").alias("v"), line(F.col("kind"), F.col("to_id")).alias("t"))
    ref = m["change_refs"].select(F.col("change_id").alias("id"), order(F.col("field"), (*CHANGE_RELATIONS, "unknown")).alias("o"), F.col("ref").alias("v"), line(F.col("field"), F.col("ref")).alias("t"))
    lnk = m["links"].select(F.col("owner_id").alias("id"), F.lit(99).cast("long").alias("o"), F.col("ref").alias("v"), line(F.lit("link"), F.when(F.col("kind") == "file", F.concat(F.lit("file:"), "ref")).otherwise(F.col("ref"))).alias("t"))
    body = rel.unionByName(ref).unionByName(lnk).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "v", "t"))), lambda x: x["t"]).alias("body"))
    x = head.join(body, "id", "left")
    return x.select("id", F.array_join(F.concat("head", F.coalesce("body", F.array().cast("array<string>")), "tags"), "\n").alias("text"))


def merge_models(rows: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Union with last wins: of the rows of one id the one of the greatest source ordinal."""
    other = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*other), order).alias("x")).select(key, "x.*")


def duplicate_ids(m: dict[str, DataFrame]) -> DataFrame:
    return m["nodes"].select("id").unionAll(m["changes"].select("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def resolve_links(links: DataFrame, nodes: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(owner_id, kind, ref, resolved, n_targets, reason): files by path, claims and evidence by id, all else as a node id.

    The four kinds of target are one table keyed by kind, so links are joined once.
    """
    t = lambda kind, df, c: df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("ref")).agg(F.count("*").alias("n_targets")).select(F.lit(kind).alias("k"), "ref", "n_targets")
    targets = reduce(DataFrame.unionByName, (t("file", nodes.select("id", "file_path").distinct(), "file_path"), t("node", nodes.select("id").distinct(), "id"), t("claim", claims.select("id").distinct(), "id"), t("evidence", evidence.select("id").distinct(), "id")))
    x = links.withColumn("k", F.when(F.col("kind").isin("file", "claim", "evidence"), F.col("kind")).otherwise("node")).join(targets, ["k", "ref"], "left")
    why = F.when(F.col("k") == "file", "no indexed file matches this path").when(F.col("k") == "node", F.concat("kind", F.lit(" node id not found in the graph"))).otherwise(F.concat("k", F.lit(" id not found in the graph")))
    found = F.col("n_targets").isNotNull()
    return x.select("owner_id", "kind", "ref", found.alias("resolved"), F.coalesce("n_targets", F.lit(0)).alias("n_targets"), F.when(~found, why).alias("reason"))


def dangling_references(m: dict[str, DataFrame]) -> DataFrame:
    """(owner_id, field, ref) of references to ids that the model does not declare."""
    ids = m["nodes"].select("id").unionAll(m["changes"].select("id")).distinct().select(F.col("id").alias("ref"))
    refs = m["relations"].select(F.col("from_id").alias("owner_id"), F.col("kind").alias("field"), F.col("to_id").alias("ref"))
    refs = refs.unionByName(m["change_refs"].select(F.col("change_id").alias("owner_id"), "field", "ref"))
    return refs.join(ids, "ref", "left_anti").select("owner_id", "field", "ref").distinct()


def footprints(links: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(owner_id, id): graph nodes an authored node stands on: what it links, and what those constrain."""
    direct = links.select("owner_id", F.col("ref").alias("id")).join(nodes.select("id"), "id", "left_semi").select("owner_id", "id")
    bound = edges.where("kind = 'constrained_by'").select(F.col("to_id").alias("id"), F.col("from_id").alias("s"))
    return direct.unionByName(direct.join(bound, "id").select("owner_id", F.col("s").alias("id"))).distinct()


def invalid_ids(m: dict[str, DataFrame]) -> DataFrame:
    """(id, kind) of declared ids whose prefix or body is not that of their kind."""
    x = m["nodes"].select("id", "kind").unionByName(m["changes"].select("id", "kind"))
    return x.where(~is_semantic_id(F.col("id"), F.col("kind"))).distinct()


#: Reasons of a check in order of precedence.
CHECK_ORDER = (
    "SEMANTIC_DSL_INVALID", "DUPLICATE_SEMANTIC_ID", "INVALID_SEMANTIC_ID", "DANGLING_SEMANTIC_REFERENCE", "STALE_REPOSITORY_LINK", "ACTIVE_CHANGE_POINTER_INVALID", "ACTIVE_CHANGE_POINTER_MISSING",
    "ACTIVE_CHANGE_POINTER_MISMATCH", "ACTIVE_CHANGE_OBSOLETE", "EVIDENCE_BASELINE_INVALID", "EVIDENCE_BASELINE_STALE",
)
#: Lifecycles of changes under way, and of closed ones.
ACTIVE, TERMINAL = ("active", "partial", "blocked", "stale"), ("verified", "superseded")


def lifecycle_findings(changes: DataFrame, pointers: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """(repo, reason, subject): what is wrong with the pointers to active changes, and with recorded baselines.

    ``changes`` has repo, id, status and content; ``pointers`` (repo, state, change_id, content), state being ``valid`` or
    ``invalid``, and no row where there is none; ``baselines`` (repo, baseline) as ``verification_baseline`` gives them.
    """
    none = F.lit(None).cast("string")
    row = lambda df, reason, subject=none: df.select("repo", F.lit(reason).alias("reason"), subject.alias("subject"))
    active = changes.where(F.col("status").isin(*ACTIVE))
    good = pointers.where("state = 'valid'").select("repo", F.col("change_id").alias("picked"), F.col("content").alias("seen"))
    x = good.join(changes.select("repo", F.col("id").alias("picked"), "status", "content"), ["repo", "picked"], "left").withColumn("over", F.col("status").isin(*TERMINAL))
    others = active.join(good, "repo").where(F.col("id") != F.col("picked"))
    found = [
        row(pointers.where("state = 'invalid'"), "ACTIVE_CHANGE_POINTER_INVALID"), row(x.where("status is null"), "ACTIVE_CHANGE_POINTER_INVALID", F.col("picked")),
        row(active.join(pointers.select("repo"), "repo", "left_anti"), "ACTIVE_CHANGE_POINTER_MISSING", F.col("id")), row(x.where("over"), "ACTIVE_CHANGE_OBSOLETE", F.col("picked")),
        row(x.where(~F.col("over") & ~F.col("content").eqNullSafe(F.col("seen"))), "ACTIVE_CHANGE_POINTER_MISMATCH", F.col("picked")), row(others, "ACTIVE_CHANGE_OBSOLETE", F.col("id")),
    ]
    if baselines is not None:
        found += [row(baselines.where(F.col("baseline") == b), f"EVIDENCE_BASELINE_{b.upper()}") for b in ("invalid", "stale")]
    return reduce(DataFrame.unionByName, found).distinct()


def check_model(m: dict[str, DataFrame], resolved: DataFrame | None = None, lifecycle: DataFrame | None = None) -> DataFrame:
    """(rank, reason, n) of everything wrong with a model, in order of precedence; no rows if nothing is. ``lifecycle`` are
    ``lifecycle_findings``; a repository counts once a reason."""
    found = {
        "SEMANTIC_DSL_INVALID": m["diagnostics"].where("level = 'error'"), "DUPLICATE_SEMANTIC_ID": duplicate_ids(m), "INVALID_SEMANTIC_ID": invalid_ids(m), "DANGLING_SEMANTIC_REFERENCE": dangling_references(m),
    }
    if resolved is not None:
        found["STALE_REPOSITORY_LINK"] = resolved.where("not resolved")
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(CHECK_ORDER.index(k)).alias("rank"), F.lit(k).alias("reason"), "n") for k, df in found.items()]
    if lifecycle is not None:
        order = F.array(*(F.lit(k) for k in CHECK_ORDER))
        parts.append(lifecycle.groupBy("reason").agg(F.count_distinct("repo").alias("n")).select((F.array_position(order, F.col("reason")) - 1).cast("int").alias("rank"), "reason", "n"))
    return reduce(DataFrame.unionByName, parts).where("n > 0")


#: Levels of a slice that run before its lineage is cut.
LEVELS_PER_JOB = 6


def slice_model(m: dict[str, DataFrame], seeds: DataFrame, max_nodes: int = 60) -> DataFrame:
    """(seed_set, id, hop, truncated): what each set of seeds reaches over relations, at most ``max_nodes`` ids.

    Level by level; within a level ids are taken in order, as the cap depends on it, and ids that the model does not
    declare are skipped but, once the cap is reached, still mark the slice as cut. A set is one row of what it has picked
    and what comes next, so that several levels run in one job.
    """
    ids = m["nodes"].select("id").unionAll(m["changes"].select("id")).distinct()
    out = m["relations"].select(F.col("from_id").alias("id"), F.col("to_id").alias("b")).unionByName(m["change_refs"].select(F.col("change_id").alias("id"), F.col("ref").alias("b")))
    known = ids.join(out.groupBy("id").agg(F.collect_set("b").alias("nexts")), "id", "left").withColumn("nexts", F.coalesce("nexts", F.array().cast("array<string>")))
    known = broadcast_if_small(checkpointed(known))
    at = seeds.groupBy("seed_set").agg(F.collect_set("id").alias("front"))
    at = at.select("seed_set", F.array().cast("array<struct<id: string, hop: int>>").alias("picked"), "front", F.lit(False).alias("cut"))
    hop = 0
    while True:
        for _ in range(LEVELS_PER_JOB):
            x = at.select("seed_set", "picked", "cut", F.explode_outer("front").alias("id")).join(known, "id", "left")
            x = x.groupBy("seed_set").agg(F.first("picked").alias("picked"), F.first("cut").alias("cut"), F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", "nexts")))).alias("f"))
            x = x.withColumn("room", max_nodes - F.size("picked")).withColumn("k", F.filter("f", lambda v: v["nexts"].isNotNull()))
            past = F.get("f", F.size("f") - 1)["id"] > F.get("k", F.col("room") - 1)["id"]
            x = x.withColumn("cut", F.col("cut") | F.coalesce(F.when(F.col("room") == 0, F.size("f") > 0).otherwise(past), F.lit(False))).withColumn("k", F.slice("k", 1, F.col("room")))
            x = x.withColumn("picked", F.concat("picked", F.transform("k", lambda v: F.struct(v["id"].alias("id"), F.lit(hop).alias("hop")))))  # noqa: B023
            at = x.select("seed_set", "picked", F.array_except(F.flatten("k.nexts"), F.col("picked.id")).alias("front"), "cut")
            hop += 1
        at = checkpointed(at)
        if at.where("size(front) > 0").isEmpty():
            break
    return at.select("seed_set", F.explode("picked").alias("p"), "cut").select("seed_set", "p.id", "p.hop", F.col("cut").alias("truncated"))


def slice_parts(m: dict[str, DataFrame], sliced: DataFrame, critical: tuple[str, ...] = ("critical", "security")) -> DataFrame:
    """(seed_set, part, ref): what the ids of a slice are (goals, invariants, decisions, assumptions, changes, evidence, unknowns;
    safety for critical invariants), the repository links of all of them, and the proofs its changes still need."""
    names = {"goal": "intentions", "invariant": "invariants", "decision": "decisions", "assumption": "assumptions", "change": "changes", "evidence": "evidence", "unknown": "open_unknowns"}
    part = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in names.items()))
    what = m["nodes"].select("id", "kind", "status", "tags").unionByName(m["changes"].select("id", "kind", "status", "tags"))
    x = checkpointed(sliced.select("seed_set", "id").join(what, "id"))
    safe = x.where((F.col("kind") == "invariant") & F.arrays_overlap("tags", F.array(*(F.lit(t) for t in critical))))
    links = sliced.select("seed_set", F.col("id").alias("owner_id")).join(m["links"], "owner_id").select("seed_set", F.lit("links").alias("part"), F.concat_ws(":", "kind", "ref").alias("ref"))
    proven = m["nodes"].where(F.col("status").isin(*PROVEN)).select(F.col("id").alias("ref"))
    need = x.where("kind = 'change'").select("seed_set", F.col("id").alias("change_id")).join(m["change_refs"].where("field = 'requires_evidence'"), "change_id").join(proven, "ref", "left_anti")
    return reduce(DataFrame.unionByName, (
        x.select("seed_set", part.alias("part"), F.col("id").alias("ref")), safe.select("seed_set", F.lit("safety").alias("part"), F.col("id").alias("ref")), links, need.select("seed_set", F.lit("next_proofs").alias("part"), "ref"),
    )).distinct()


def superseded_decisions(m: dict[str, DataFrame], preserved: DataFrame) -> DataFrame:
    """(change_id, decision_id): decisions that justify what a change preserves but are superseded, contradicted or stale."""
    r = m["relations"]
    over = r.where("kind = 'supersedes'").select(F.col("to_id").alias("id")).unionByName(m["nodes"].where("kind = 'decision' and status in ('contradicted', 'stale')").select("id")).distinct()
    j = r.where("kind = 'justifies'").select(F.col("from_id").alias("id"), F.col("to_id").alias("ref"))
    d = m["nodes"].where("kind = 'decision'").select("id").join(over, "id", "left_semi").join(j, "id")
    return preserved.join(d, "ref").select("change_id", F.col("id").alias("decision_id")).distinct()


@dataclass(frozen=True)
class Policy:
    """What a repository may set of how its changes are judged; what it leaves out has these values."""

    critical_tags: tuple[str, ...] = ("critical", "security")
    open_unknown: str = "warn"
    superseded_decision: str = "warn"
    proof_for_active: bool = True

    @classmethod
    def of(cls, given: dict | None) -> Policy:
        """From the names of a configuration block; null means the defaults."""
        names = {"criticalInvariantTags": "critical_tags", "openUnknownSeverity": "open_unknown", "supersededDecisionSeverity": "superseded_decision", "requireProofForActiveChange": "proof_for_active"}
        known = {names[k]: tuple(v) if isinstance(v, list) else v for k, v in (given or {}).items() if k in names}
        return cls(**known)


def change_findings(m: dict[str, DataFrame], touched: DataFrame, prints: DataFrame, resolved: DataFrame, verdicts: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(change_id, kind, severity, ref): what stands between each change and a verified verdict.

    ``touched`` has (change_id, id, severity): graph nodes that the change's diff touches, with the worst finding on each
    (block, warn or none). ``prints`` are footprints, ``verdicts`` (change_id, verdict) of the underlying diffs. An
    invariant that is touched under a finding is unproven, whatever the finding's severity.
    """
    critical = F.arrays_overlap("tags", F.array(*(F.lit(c) for c in policy.critical_tags or ("\0",))))
    n = m["nodes"].select("id", "kind", "status", critical.alias("critical"))
    ref = m["change_refs"].join(n.select(F.col("id").alias("ref"), F.col("kind").alias("ref_kind"), F.col("status").alias("ref_status"), "critical"), "ref", "left")
    row = lambda df, kind, severity: df.select("change_id", F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), "ref")
    level = lambda s: "block" if s == "block" else "warn"
    keep = ref.where("field = 'preserves'")
    inv = keep.where("ref_kind = 'invariant'")
    hit = touched.where("severity in ('block', 'warn')").join(prints, "id").select("change_id", F.col("owner_id").alias("ref")).distinct()
    unproven = inv.where("ref_status <> 'contradicted'").join(hit, ["change_id", "ref"], "left_semi")
    active = m["changes"].where("status = 'active'").select(F.col("id").alias("change_id"))
    weak = unproven.where("not critical").join(active, "change_id", "left_semi")
    need, unk = ref.where("field = 'requires_evidence'"), ref.where("field = 'unknown'")
    scope = m["change_refs"].select("change_id", F.col("ref").alias("owner_id")).unionByName(m["changes"].select(F.col("id").alias("change_id"), F.col("id").alias("owner_id"))).distinct()
    stale = scope.join(resolved.where("not resolved"), "owner_id").select("change_id", "ref").distinct()
    old = superseded_decisions(m, keep.select("change_id", "ref")).withColumnRenamed("decision_id", "ref")
    under = verdicts.select("change_id", "verdict", F.lit("").alias("ref"))
    return reduce(DataFrame.unionByName, (
        row(under.where("verdict = 'BLOCK'"), "underlying_block", "block"), row(under.where("verdict = 'WARN'"), "underlying_warn", "warn"),
        row(keep.where("ref_kind is null or ref_kind <> 'invariant'"), "dangling_reference", "stale"), row(inv.where("ref_status = 'contradicted'"), "invariant_contradicted", "block"),
        row(unproven.where("critical"), "critical_invariant_unproven", "block"), row(weak if policy.proof_for_active else weak.limit(0), "invariant_unproven", "warn"),
        row(old, "superseded_decision", level(policy.superseded_decision)), row(need.where("ref_kind is null"), "dangling_reference", "stale"),
        row(need.where(F.col("ref_kind").isNotNull() & ~F.col("ref_status").isin(*PROVEN)), "required_evidence_pending", "warn"),
        row(unk.where("coalesce(critical, false)"), "critical_open_unknown", "block"), row(unk.where("not coalesce(critical, false)"), "open_unknown", level(policy.open_unknown)), row(stale, "stale_link", "stale"),
    ))


def in_order(findings: DataFrame) -> DataFrame:
    """``findings`` with pos, numbering those of a change: blocking, stale, then warning ones, ties by kind and reference."""
    rank = F.when(F.col("severity") == "block", 0).when(F.col("severity") == "stale", 1).otherwise(2)
    return findings.withColumn("pos", F.row_number().over(W.partitionBy("change_id").orderBy(rank, "kind", "ref")))


#: Verdicts of diffs, the better before the worse.
DIFF_VERDICTS = ("PASS", "WARN", "BLOCK")


def worst_verdict(verdict: str = "verdict") -> Column:
    """Of a group's verdicts of diffs the worst."""
    ranked = F.array(*(F.lit(v) for v in DIFF_VERDICTS))
    return F.get(ranked, F.max(F.array_position(ranked, F.col(verdict)).cast("int") - 1))


def change_verdicts(changes: DataFrame, findings: DataFrame) -> DataFrame:
    """(change_id, verdict, lifecycle, n_findings): BLOCKED over STALE over PARTIAL over VERIFIED."""
    any_of = lambda s: F.coalesce(F.bool_or(F.col("severity") == s), F.lit(False))
    g = changes.select(F.col("id").alias("change_id")).distinct().join(findings, "change_id", "left").groupBy("change_id").agg(
        F.when(any_of("block"), "BLOCKED").when(any_of("stale"), "STALE").when(any_of("warn"), "PARTIAL").otherwise("VERIFIED").alias("verdict"), F.count("severity").alias("n_findings")
    )
    return g.select("change_id", "verdict", F.lower("verdict").alias("lifecycle"), "n_findings")


def apply_patches(changes: DataFrame, patches: DataFrame, fields: tuple[str, ...] = ("serves", "preserves", "requires_evidence", "unknowns")) -> DataFrame:
    """Changes with lists united with what their patch adds, less what it removes; a change without a patch stays as it is.

    ``patches`` has id and, for each field, add_{field} and remove_{field} arrays, null meaning nothing.
    """
    x = changes.join(patches, "id", "left")
    none = F.array().cast("array<string>")
    some = lambda c: F.coalesce(F.col(c), none)
    return x.select(*(F.array_except(F.array_union(some(c), some(f"add_{c}")), some(f"remove_{c}")).alias(c) if c in fields else F.col(c) for c in changes.columns))


def capability_wiring(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(capability, invariants, contexts): what binds, and where live, the nodes that implement a capability."""
    i = edges.where("kind = 'implements_capability'").select(F.col("to_id").alias("capability"), F.col("from_id").alias("id"))
    bound = edges.where("kind = 'constrained_by'").select(F.col("from_id").alias("id"), F.col("to_id").alias("inv"))
    x = i.join(bound, "id", "left").join(nodes.select("id", "bounded_context"), "id", "left")
    return x.groupBy("capability").agg(F.array_sort(F.collect_set("inv")).alias("invariants"), F.array_sort(F.collect_set("bounded_context")).alias("contexts"))


def resolvable_unknowns(m: dict[str, DataFrame]) -> DataFrame:
    """(id, n_proofs, resolvable): unknowns with how much proven evidence they are proved by; without any, none may be closed."""
    proven = m["nodes"].where((F.col("kind") == "evidence") & F.col("status").isin(*PROVEN)).select(F.col("id").alias("to_id")).distinct()
    r = m["relations"].where("kind = 'proved_by'").join(proven, "to_id", "left_semi").groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n"))
    u = m["nodes"].where("kind = 'unknown'").select("id").distinct().join(r, "id", "left")
    return u.select("id", F.coalesce("n", F.lit(0)).alias("n_proofs"), F.col("n").isNotNull().alias("resolvable"))
