"""Content identities: canonical JSON, domain-separated hashes, framed hunk identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_map(m: Column) -> Column:
    """A map as JSON text with its keys in order; null is an empty object."""
    entry = lambda e: F.concat(json_text(e["key"]), F.lit(":"), F.coalesce(json_text(e["value"]), F.lit("null")))
    body = F.array_join(F.transform(F.array_sort(F.map_entries(m)), entry), ",")
    return F.concat(F.lit("{"), F.coalesce(body, F.lit("")), F.lit("}"))


def json_text(s: Column) -> Column:
    """A string as a JSON literal; null stays null."""
    return F.when(s.isNotNull(), F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", ""))


def canonical_json(**fields: Column) -> Column:
    """A JSON object of the given parts (each JSON text), keys in order; null parts are left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def domain_sha256(domain: str, payload: Column) -> Column:
    """sha256 of ``domain``, a zero byte and the payload, as ``sha256:{hex}``."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(domain.encode() + b"\0"), payload.cast("binary")), 256))


#: Digits of the key's hash that make the groups of each level of a fingerprint: 16 million groups, then 4096, then one.
FINGERPRINT_LEVELS = (6, 3)


def fingerprint(rows: DataFrame, by: list[str], key: Column, payload: Column, domain: str) -> DataFrame:
    """(by..., fingerprint) of a set of rows, whatever order they come in; the key tells rows apart and sets their order.

    A tree of hashes: rows are hashed where they are, then in groups by their key's hash, then groups of groups, so that
    no task ever holds a set, however large.
    """
    x = rows.select(*by, key.cast("string").alias("k"), F.sha2(payload.cast("binary"), 256).alias("h")).withColumn("g", F.sha2("k", 256))
    all_of = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "h"))), lambda r: r["h"]), "\n")
    for digits in FINGERPRINT_LEVELS:
        x = x.groupBy(*by, F.substring("g", 1, digits).alias("g")).agg(F.sha2(all_of, 256).alias("h")).withColumn("k", F.col("g"))
    return x.groupBy(*by).agg(domain_sha256(domain, all_of).alias("fingerprint"))


def _u32(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def _prefixed(b: Column) -> Column:
    return F.concat(_u32(F.octet_length(b)), b)


def hunk_identity(repository: Column, path: Column, old_start: Column, old_lines: Column, new_start: Column, new_lines: Column, old_blob: Column, new_blob: Column, raw: Column, magic: bytes) -> Column:
    """sha256 identity of a byte-exact hunk: an 8-byte magic, version 1, length-prefixed repository and path, four
    big-endian numbers, two tagged nullable blob ids and the length-prefixed bytes.

    The magic names the format whose identities are wanted and is the caller's to give.
    """
    text = lambda c: _prefixed(c.cast("binary"))
    blob = lambda c: F.when(c.isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), text(c)))
    frame = F.concat(F.lit(magic), _u32(F.lit(1)), text(repository), text(path), *(_u32(c) for c in (old_start, old_lines, new_start, new_lines)), blob(old_blob), blob(new_blob), _prefixed(raw))
    return F.concat(F.lit("sha256:"), F.sha2(frame, 256))


def is_safe_path(path: Column) -> Column:
    """Whether a path is relative and normal: not empty, no drive, no empty, ``.`` or ``..`` part."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return ~((p == "") | p.rlike("^[A-Za-z]:") | p.rlike(r"(^|/)(\.{0,2})(/|$)"))
