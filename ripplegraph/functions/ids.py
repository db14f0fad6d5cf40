"""Deterministic ids as Column expressions: pure functions of their inputs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplegraph.functions.paths import normalize_path

_FNV_START, _FNV_PRIME, _MASK = 2166136261, 16777619, 0xFFFFFFFF


@F.pandas_udf(T.StringType())
def _ascii_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKD", x.lower()).encode("ascii", "ignore").decode())


def slugify(text: str | Column, most: int = 60, ascii_only: bool = False) -> Column:
    """Lower case, accents folded, runs of other characters to ``-``, trimmed, then cut to ``most`` characters; ``empty`` if none is left.

    Accents need Python, which sees only the texts that are not ASCII; ``ascii_only`` says that there are none.
    """
    c = F.col(text) if isinstance(text, str) else text
    folded = F.lower(c) if ascii_only else F.coalesce(_ascii_fold(F.when(F.octet_length(c) > F.length(c), c)), F.lower(c))
    s = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(c.isNull(), None).when(s == "", "empty").otherwise(F.substring(s, 1, most))


def fnv1a(text: str | Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, 8 hex digits, within the JVM: a character beyond the basic plane is two units."""
    c = F.col(text) if isinstance(text, str) else text
    num = lambda n: F.lit(n).cast("long")
    step = lambda h, unit: (h.bitwiseXOR(unit) * num(_FNV_PRIME)).bitwiseAND(num(_MASK))

    def add(h: Column, char: Column) -> Column:
        o = F.ascii(char).cast("long")
        high = num(0xD800) + F.shiftright(o - 0x10000, 10)
        low = num(0xDC00) + (o - 0x10000).bitwiseAND(num(0x3FF))
        return F.when(char == "", h).when(o < 0x10000, step(h, o)).otherwise(step(step(h, high), low))

    return F.lower(F.lpad(F.hex(F.aggregate(F.split(c, ""), num(_FNV_START), add)), 8, "0"))


def symbol_id(kind: Column, path: Column, name: Column, start: Column) -> Column:
    return F.concat_ws(":", F.lit("sym"), kind, normalize_path(path), name, start.cast("string"))


def edge_id(kind: Column, from_id: Column, to_id: Column) -> Column:
    """``edge:{kind}:{fnv1a(from->to)}``: 32 bits, so for output only; group and join by (kind, from, to)."""
    return F.concat_ws(":", F.lit("edge"), kind, fnv1a(F.concat(from_id, F.lit("->"), to_id)))


def claim_id(kind: Column, statement: Column, subjects: Column) -> Column:
    """``claim:{kind}:{slug of the statement}-{fnv1a(subjects joined by | :: statement)}``."""
    whole = F.concat(F.array_join(subjects, "|"), F.lit("::"), statement)
    return F.concat(F.lit("claim:"), kind, F.lit(":"), F.substring(slugify(statement), 1, 40), F.lit("-"), fnv1a(whole))


#: Kinds of authored ids, each the prefix of its ids; ``proof.`` also stands for evidence.
SEMANTIC_KINDS = ("goal", "invariant", "decision", "assumption", "unknown", "change", "evidence")
#: Prefixes of derived ids, and the kind of link each makes; any other reference is a file.
LINK_KINDS = {"sym:": "symbol", "inv:": "invariant", "contract:": "contract", "cap:": "capability", "test:": "test", "mig:": "migration", "claim:": "claim", "ev:": "evidence"}


def semantic_kind(ref: Column) -> Column:
    """The kind named by an authored id's prefix; null if it names none."""
    kind = F.substring_index(ref, ".", 1)
    known = F.when(kind == "proof", "evidence").when(kind.isin(*SEMANTIC_KINDS), kind)
    return F.when(F.contains(ref, F.lit(".")), known)


def is_semantic_id(ref: Column, kind: Column) -> Column:
    """Whether ``ref`` has the prefix of ``kind`` and a body of lower-case letters, digits, dots and dashes that ends in neither."""
    body = F.regexp_replace(ref, r"^[a-z]+\.", "")
    return F.coalesce((semantic_kind(ref) == kind) & body.rlike(r"^[a-z0-9]([a-z0-9.-]*[a-z0-9])?$"), F.lit(False))


def semantic_id(kind: Column, label: Column) -> Column:
    """``{kind}.{slugged dotted segments}``; a label that is such an id stays itself."""
    prefix = F.concat(kind, F.lit("."))
    body = F.when(F.startswith(label, prefix), F.substr(label, F.length(prefix) + 1)).otherwise(label)
    parts = F.filter(F.transform(F.split(body, r"\."), lambda p: slugify(p, ascii_only=True)), lambda p: p != "empty")
    return F.concat(prefix, F.when(F.size(parts) > 0, F.array_join(parts, ".")).otherwise("unnamed"))


def link_of(ref: Column) -> tuple[Column, Column]:
    """(kind, ref) of an authored link; ``file:`` is stripped, and whatever has no known prefix is a path."""
    t = F.trim(ref)
    kind = F.coalesce(*(F.when(F.startswith(t, F.lit(p)), k) for p, k in LINK_KINDS.items()), F.lit("file"))
    return kind, F.regexp_replace(t, "^file:", "")


def py_slug(text: str, most: int = 60) -> str:
    """slugify() for the driver's and the parsers' own use."""
    s = unicodedata.normalize("NFKD", text.lower()).encode("ascii", "ignore").decode()
    return re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9]+", "-", s))[:most] or "empty"
