"""Scores of claims: bounded blends of authority, freshness, corroboration, reach and fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values by verification status: (authority, strength, freshness).
BY_STATUS = {
    "statically_verified": (0.95, 1.0, 0.9),
    "runtime_verified": (0.9, 0.95, 0.9),
    "tested": (0.85, 0.85, 0.85),
    "documented": (0.6, 0.5, 0.7),
    "inferred": (0.4, 0.3, 0.6),
    "unverified": (0.25, 0.15, 0.5),
    "contradicted": (0.15, 0.1, 0.1),
    "deprecated": (0.1, 0.05, 0.05),
}
#: Fixed values by question: claim kinds preferred in order, statuses required (none: any), statuses disallowed.
POLICIES = {
    "public_api": (["contract", "capability", "behavior"], ["statically_verified", "tested", "runtime_verified"], ["deprecated", "contradicted"]),
    "persistence": (["invariant", "contract", "decision"], None, ["deprecated", "contradicted"]),
    "business_rule": (["invariant", "capability", "behavior", "decision"], None, ["deprecated", "contradicted"]),
    "runtime_behavior": (["behavior", "invariant", "capability"], ["tested", "runtime_verified", "statically_verified"], ["deprecated", "contradicted"]),
    "historical_reason": (["decision", "capability"], None, ["contradicted"]),
    "style": (["capability", "behavior", "contract"], None, ["deprecated", "contradicted"]),
    "security": (["invariant", "contract", "behavior", "risk"], ["statically_verified", "tested", "runtime_verified"], ["deprecated", "contradicted", "unverified", "inferred"]),
}
#: Weights of fit, authority, reach, strength and freshness; what an open contradiction costs.
WEIGHTS, PENALTY = (0.25, 0.25, 0.15, 0.2, 0.15), 0.5


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def by_status(status: Column, which: int) -> Column:
    """Authority (0), strength (1) or freshness (2) of a status."""
    return F.coalesce(*(F.when(status == k, F.lit(v[which])) for k, v in BY_STATUS.items()))


def confidence(status: Column, source_kinds: Column) -> Column:
    """Blend of authority, freshness and the distinct kinds of source, of which three corroborate fully."""
    return clamp01(0.5 * by_status(status, 0) + 0.3 * by_status(status, 2) + 0.2 * clamp01(source_kinds / 3))


def role_match(kind: Column, preferred: Column) -> Column:
    """1 for the first preferred kind, falling gently; 0.3 for a kind that is not preferred."""
    at, n = F.array_position(preferred, kind), F.size(preferred)
    return F.when(at == 0, F.lit(0.3)).when(n <= 1, F.lit(1.0)).otherwise(clamp01(1 - (at - 1) / n * 0.3))


def reachability(hop: Column) -> Column:
    return F.when(hop.isNull(), F.lit(0.0)).when(hop <= 0, F.lit(1.0)).otherwise(clamp01(1 / (1 + hop)))


def weighted(fit: Column, authority: Column, reach: Column, strength: Column, freshness: Column, contradicted: Column) -> Column:
    parts = sum(w * c for w, c in zip(WEIGHTS, (fit, authority, reach, strength, freshness), strict=True))
    return parts - F.when(contradicted, PENALTY).otherwise(0.0)


#: Words that decide a question once the mode has not, in order of precedence.
QUESTION_WORDS = (
    ("persistence", ["persist", "database", "migration", "schema", "sql", "table", "storage", "column"]),
    ("public_api", ["public api", "exported", "interface", "signature", "endpoint", "contract"]),
    ("historical_reason", ["why", "history", "historical", "decision", "rationale", "reason", "adr"]),
    ("style", ["style", "convention", "formatting", "naming", "lint"]),
)
#: Questions that a mode settles.
QUESTION_OF_MODE = {"security": "security", "performance": "runtime_behavior", "migration": "persistence"}


def mentions(text: Column, words: list[str]) -> Column:
    return F.coalesce(*(F.when(F.contains(text, F.lit(w)), True) for w in words), F.lit(False))


def classify_question(mode: Column, text: Column) -> Column:
    """The kind of question a task asks: by its mode, else by the first words it mentions, else about the business."""
    t = F.lower(text)
    settled = (F.when(mode == m, q) for m, q in QUESTION_OF_MODE.items())
    worded = (F.when(mentions(t, w), q) for q, w in QUESTION_WORDS)
    return F.coalesce(*settled, *worded, F.lit("business_rule"))
