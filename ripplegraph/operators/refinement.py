"""Authored refinement relations: strict text to rows, and back."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabularies of relations.
KINDS = ("decomposes_to", "realizes", "implements", "constrained_by", "proved_by")
EPISTEMIC = ("human_declared", "statically_observed", "dynamically_observed", "test_observed", "historically_observed", "llm_inferred", "hypothetical")
PROVENANCES = ("author", "agent", "derived")
EVIDENCE_KINDS = ("semantic_node", "observed_diff_hunk", "document_span", "test_result", "commit")
#: Fields in their only order.
ORDER = ("target", "epistemicStatus", "provenance", "evidenceRef")

_DIGEST = re.compile(r"sha256:[0-9a-f]{64}")
_BARE = re.compile(r"[A-Za-z0-9._:/@+-]+")
_PART = re.compile(r' *(?:("(?:[^"\\]|\\.)*")(?= |$)|([^ "\\]+)(?= |$))')
_NEXT_BLOCK = re.compile(r"(?:relation|goal|invariant|decision|assumption|unknown|change|evidence)\s")


class _Bad(Exception):
    def __init__(self, code: str, column: int = 1) -> None:
        self.code, self.column = code, column


def _parts(line: str) -> list[tuple[str, int]]:
    """The tokens of a line and their columns: bare words, or JSON strings of printable ASCII."""
    out, at = [], 0
    while line[at:].strip(" "):
        m = _PART.match(line, at)
        column = at + len(line[at:]) - len(line[at:].lstrip(" ")) + 1
        if not m:
            raise _Bad("RELATION_MALFORMED_TOKEN", column)
        value = m[2]
        if m[1]:
            try:
                value = json.loads(m[1])
            except ValueError:
                raise _Bad("RELATION_MALFORMED_TOKEN", column) from None
            if not all(" " <= c <= "~" for c in value):
                raise _Bad("RELATION_MALFORMED_TOKEN", column)
        out.append((value, column))
        at = m.end()
    return out


def _token(value: str) -> str:
    return value if _BARE.fullmatch(value) else json.dumps(value)


def _endpoint(parts: list[tuple[str, int]]) -> tuple[str, str]:
    if len(parts) != 2 or parts[0][0] not in ("semantic", "observed_hunk") or not parts[1][0]:
        raise _Bad("RELATION_INVALID_ENDPOINT", parts[0][1] if parts else 1)
    if parts[0][0] == "observed_hunk" and not _DIGEST.fullmatch(parts[1][0]):
        raise _Bad("RELATION_MALFORMED_DIGEST", parts[1][1])
    return parts[0][0], parts[1][0]


def _one_of(parts: list[tuple[str, int]], allowed: tuple[str, ...], code: str) -> str:
    if len(parts) != 1 or parts[0][0] not in allowed:
        raise _Bad(code, parts[0][1] if parts else 1)
    return parts[0][0]


def _evidence(parts: list[tuple[str, int]]) -> tuple[str, str, str]:
    if len(parts) != 3:
        raise _Bad("RELATION_MALFORMED_EVIDENCE")
    (kind, at), (locator, _), (digest, there) = parts
    if kind not in EVIDENCE_KINDS:
        raise _Bad("RELATION_UNKNOWN_EVIDENCE_KIND", at)
    if not _DIGEST.fullmatch(digest):
        raise _Bad("RELATION_MALFORMED_DIGEST", there)
    return kind, locator, digest


_READ = {
    "target": _endpoint,
    "epistemicStatus": lambda p: _one_of(p, EPISTEMIC, "RELATION_UNKNOWN_EPISTEMIC_STATUS"),
    "provenance": lambda p: _one_of(p, PROVENANCES, "RELATION_UNKNOWN_PROVENANCE"),
    "evidenceRef": _evidence,
}


def format_relation(r: dict) -> str:
    """The one spelling of a relation."""
    ends = {k: f"{r[k][0]} {_token(r[k][1])}" for k in ("source", "target")}
    proofs = [f"evidenceRef {k} {_token(where)} {d}" for k, where, d in sorted(r["evidence"])]
    return "\n".join([f"relation {_token(r['id'])} {r['kind']} source {ends['source']}", f"target {ends['target']}", f"epistemicStatus {r['epistemicStatus']}", f"provenance {r['provenance']}", *proofs, "end"])


def relation_spans(lines: list[str]) -> list[tuple[int, int]]:
    """[first, behind) lines of each relation block: up to ``end``, or to where another block begins."""
    out, k = [], 0
    while k < len(lines):
        if not lines[k].startswith("relation "):
            k += 1
            continue
        stop = k + 1
        while stop < len(lines) and lines[stop - 1] != "end" and not _NEXT_BLOCK.match(lines[stop]):
            stop += 1
        out.append((k, stop))
        k = stop
    return out


def parse_relation(lines: list[str]) -> tuple[dict | None, list[tuple[int, int, str]]]:
    """(relation, problems) of one block; problems are (line from 0, column, code), and a relation comes only without any."""
    for n, line in enumerate(lines):
        if not line.isascii():
            return None, [(n, next(i for i, c in enumerate(line) if not c.isascii()) + 1, "RELATION_NON_ASCII")]
    r: dict = {"evidence": []}
    problems: list[tuple[int, int, str]] = []
    try:
        head = _parts(lines[0])
        if len(head) < 4 or head[0][0] != "relation" or head[3][0] != "source":
            raise _Bad("RELATION_MALFORMED_HEADER")
    except _Bad as e:
        return None, [(0, e.column, e.code)]
    r["id"], r["kind"] = head[1][0], head[2][0]
    if r["kind"] not in KINDS:
        problems.append((0, head[2][1], "RELATION_UNKNOWN_KIND"))
    try:
        r["source"] = _endpoint(head[4:])
    except _Bad as e:
        problems.append((0, e.column, e.code))
    stage, ended, tried = 0, False, set()
    for n, line in enumerate(lines[1:], 1):
        try:
            parts = _parts(line)
            if not parts:
                continue
            (name, column), rest = parts[0], parts[1:]
            if name == "end":
                ended = True
                if rest or n != len(lines) - 1:
                    raise _Bad("RELATION_UNKNOWN_FIELD", column)
                continue
            if name not in _READ:
                raise _Bad("RELATION_UNKNOWN_FIELD", column)
            rank = ORDER.index(name)
            if rank != stage:
                problems.append((n, column, "RELATION_FIELD_OUT_OF_ORDER"))
            if name == "target" and name in r:
                problems.append((n, column, "RELATION_DUPLICATE_FIELD"))
            stage = max(stage, min(rank + 1, 3))
            tried.add(name)
            value = _READ[name](rest)
            if name != "evidenceRef":
                r[name] = value
                continue
            if value in r["evidence"]:
                problems.append((n, column, "RELATION_DUPLICATE_EVIDENCE"))
            elif r["evidence"] and r["evidence"][-1] > value:
                problems.append((n, column, "RELATION_EVIDENCE_OUT_OF_ORDER"))
            r["evidence"].append(value)
        except _Bad as e:
            problems.append((n, e.column, e.code))
    if not ended:
        problems.append((len(lines) - 1, 1, "RELATION_MISSING_END"))
    if not r["evidence"]:
        problems.append((0, 1, "RELATION_MISSING_EVIDENCE"))
    problems += [(0, 1, "RELATION_MISSING_FIELD") for name in ORDER[:3] if name not in r and name not in tried]
    if not problems and format_relation(r) != "\n".join(lines):
        problems.append((0, 1, "RELATION_NON_CANONICAL_ENCODING"))
    return (None if problems else r), problems


_SCHEMA = pa.schema([
    ("file", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("code", pa.string()), ("id", pa.string()), ("kind", pa.string()), ("source_plane", pa.string()), ("source", pa.string()), ("target_plane", pa.string()), ("target", pa.string()),
    ("epistemic_status", pa.string()), ("provenance", pa.string()), ("evidence", pa.list_(pa.struct([("kind", pa.string()), ("locator", pa.string()), ("digest", pa.string())]))), ("text", pa.string()),
])
_DDL = (
    "file string, line int, col int, code string, id string, kind string, source_plane string, source string, target_plane string, target string, epistemic_status string, provenance string, "
    "evidence array<struct<kind:string,locator:string,digest:string>>, text string"
)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            lines = (text or "").replace("\r\n", "\n").split("\n")
            for first, stop in relation_spans(lines):
                r, problems = parse_relation(lines[first:stop])
                out += [(file, first + n + 1, col, code, *[None] * 10) for n, col, code in problems]
                if r:
                    proofs = [dict(zip(("kind", "locator", "digest"), e, strict=True)) for e in r["evidence"]]
                    out.append((file, first + 1, 1, None, r["id"], r["kind"], *r["source"], *r["target"], r["epistemicStatus"], r["provenance"], proofs, format_relation(r)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def parse_relations(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations, diagnostics) of texts (file, text). An id given twice in a file gives no relation and a diagnostic."""
    rows = files.select(F.col("file").cast("string"), "text").mapInArrow(_run, _DDL)
    good = rows.where("code is null")
    twice = good.groupBy("file", "id").agg(F.count("*").alias("n"), F.max("line").alias("line")).where("n > 1")
    relations = good.join(twice.select("file", "id"), ["file", "id"], "left_anti").drop("code", "line", "col")
    problems = rows.where("code is not null").select("file", "line", "col", "code")
    return relations, problems.unionByName(twice.select("file", "line", F.lit(10).alias("col"), F.lit("RELATION_DUPLICATE_ID").alias("code")))


def verified_digests(relations: DataFrame, hunks: DataFrame, nodes: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """digest of all evidence that is as stated: a known hunk, a node whose fingerprint it is, the head commit, or a file's bytes.

    ``hunks`` has identity; ``nodes`` (id, digest); ``commits`` commit_id, the heads; ``files`` (rel_path, content).

    Scale: digests are worked out, so the planner takes them for far smaller than they are and would broadcast them all; the
    joins are merged.
    """
    held = lambda df: df.hint("merge")
    e = relations.select(F.explode("evidence").alias("e")).select("e.kind", "e.locator", "e.digest").distinct()
    h = e.where("kind = 'observed_diff_hunk'").join(held(hunks.select(F.col("identity").alias("digest"))), "digest", "left_semi")
    n = e.where("kind = 'semantic_node'").join(held(nodes.select(F.col("id").alias("locator"), "digest")), ["locator", "digest"], "left_semi")
    c = commits.select(F.explode(F.array("commit_id", F.concat(F.lit("git:"), "commit_id"))).alias("locator"), F.concat(F.lit("sha256:"), F.sha2(F.col("commit_id").cast("binary"), 256)).alias("digest"))
    c = e.where("kind = 'commit'").join(held(c), ["locator", "digest"], "left_semi")
    f = files.select(F.col("rel_path").alias("locator"), F.concat(F.lit("sha256:"), F.sha2(F.col("content").cast("binary"), 256)).alias("digest"))
    f = e.where("kind in ('document_span', 'test_result')").join(held(f), ["locator", "digest"], "left_semi")
    return h.select("digest").unionByName(n.select("digest")).unionByName(c.select("digest")).unionByName(f.select("digest")).distinct()
