"""Path and code-unit helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_path(path: str | Column) -> Column:
    """Forward slashes, then one leading ``./`` dropped; null stays null."""
    return F.regexp_replace(F.replace(_c(path), F.lit("\\"), F.lit("/")), r"^\./", "")


def code_unit_key(text: str | Column) -> Column:
    """A binary sort key whose byte order is the UTF-16 code-unit order of ``text``.

    Spark compares strings by UTF-8 bytes, which differs only where supplementary characters meet U+E000 to U+FFFF.
    """
    return F.encode(_c(text), "UTF-16BE")


def code_unit_less(a: str | Column, b: str | Column) -> Column:
    return code_unit_key(a) < code_unit_key(b)
