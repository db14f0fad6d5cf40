"""Text to rows: diffs, markers, front matter, documents, migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.functions.paths import normalize_path

#: Folders that are never walked (a tool's own folder is the caller's to add), and names that make a file a test.
IGNORED_FOLDERS = ["node_modules", ".git", "dist", "build", "coverage", ".turbo", ".next"]
TEST_FOLDERS = ["test", "tests", "__tests__"]
#: Patterns of names and imports that tell a file's role.
CODE_NAME, TEST_NAME, DOCUMENT_NAME, SQL_NAME = r"\.(ts|tsx|mts|cts)$", r"\.(test|spec)\.(ts|tsx|mts|cts)$", r"\.mdx?$", r"\.sql$"
TEST_IMPORT = "from\\s+[\"'](vitest|bun:test|node:test)[\"']"
#: Patterns of a unified diff.
OLD_FILE, NEW_FILE = r"^--- (?:a/(.+)|/dev/null)\s*$", r"^\+\+\+ (?:b/(.+)|/dev/null)\s*$"
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
#: Patterns of markers, constraints and tables.
MARKER = r"(?i)@(capability|invariant|contract|risk|boundedcontext|tag)[ \t]+([A-Za-z0-9][A-Za-z0-9_-]*)[ \t]*(?::[ \t]*([^\r\n*][^\r\n]*))?"
CONSTRAINT = r"(?i)--\s*@constraint[ \t]+([A-Za-z0-9][A-Za-z0-9_-]*)[ \t]*(?::[ \t]*([^\r\n]*))?"
FRONT_MATTER = r"\A---[^\S\n]*\n((?s:.*?\n)??)---[^\S\n]*(?:\n|\z)"
CREATE_TABLE = r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"'`]?([A-Za-z0-9_]+)[\"'`]?"


def is_excluded(path: Column, excludes: list[str], ignored: list[str] = IGNORED_FOLDERS) -> Column:
    """Whether a folder of the path is ignored, or the path holds an exclude pattern with its stars taken out."""
    hit = F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(x) for x in ignored)))
    for e in excludes:
        hit = hit | F.contains(path, F.lit(e.replace("*", "")))
    return hit


def classify_path(path: Column, content: Column | None = None, migrations: tuple[str, ...] = ("migrations",)) -> Column:
    """migration, document, test, source or other, by name first; a test import in the content also makes a test."""
    parts = F.split(path, "/")
    any_of = lambda names: F.arrays_overlap(parts, F.array(*(F.lit(n) for n in names)))
    code = path.rlike(CODE_NAME)
    under = any_of(["migrations", "migration"])
    for m in migrations:
        under = under | F.startswith(path, F.lit(m))
    test = path.rlike(TEST_NAME) | any_of(TEST_FOLDERS)
    if content is not None:
        test = test | F.coalesce(content.rlike(TEST_IMPORT), F.lit(False))
    return F.when(path.rlike(SQL_NAME) | (under & code), "migration").when(path.rlike(DOCUMENT_NAME), "document").when(code & test, "test").when(code, "source").otherwise("other")


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """(diff_id, file_no, file_path, hunk_no, old_start, old_lines, new_start, new_lines) from (diff_id, text).

    A new-file header counts only right behind an old-file header; a deleted file vanishes with its hunks; a file without
    hunks has one row with null numbers; an omitted count is 1. Only headers and hunk lines reach the window, which carries
    the current file along; content lines stay in the scan.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split("text", "\r?\n")).alias("no", "line"))
    lines = lines.where(F.col("line").rlike(OLD_FILE) | F.col("line").rlike(NEW_FILE) | F.col("line").rlike(HUNK))
    w = W.partitionBy("diff_id").orderBy("no")
    paired = F.col("line").rlike(NEW_FILE) & (F.lag("no").over(w) == F.col("no") - 1) & F.lag("line").over(w).rlike(OLD_FILE)
    x = lines.withColumn("head", F.coalesce(paired, F.lit(False)))
    file = F.when(F.col("head"), F.struct(F.col("no").alias("file_no"), F.regexp_extract("line", NEW_FILE, 1).alias("path")))
    x = x.withColumn("file", F.last(file, ignorenulls=True).over(w)).where("file is not null and file.path <> ''")
    hunk = x.where(~F.col("head") & F.col("line").rlike(HUNK))
    part = lambda i: F.regexp_extract("line", HUNK, i)
    number = lambda i: F.when(part(i) == "", 1).otherwise(part(i).cast("int"))
    hunk = hunk.select("diff_id", "file.file_no", F.col("no").alias("hunk_no"), number(1).alias("old_start"), number(2).alias("old_lines"), number(3).alias("new_start"), number(4).alias("new_lines"))
    files = x.where("head").select("diff_id", "file.file_no", normalize_path(F.col("file.path")).alias("file_path"))
    return files.join(hunk, ["diff_id", "file_no"], "left").select("diff_id", "file_no", "file_path", "hunk_no", "old_start", "old_lines", "new_start", "new_lines")


def strip_doc_comment(comment: Column) -> Column:
    """The text of a ``/** */`` comment without its frame and leading stars."""
    body = F.regexp_replace(F.regexp_replace(comment, r"^\s*/\*\*?", ""), r"\*/\s*$", "")
    line = lambda s: F.regexp_replace(F.regexp_replace(s, r"^\s*\*[ \t]?", ""), r"\s+$", "")
    return F.array_join(F.transform(F.split(body, "\r?\n"), line), "\n")


def parse_markers(comments: DataFrame, key: str) -> DataFrame:
    """(key, no, tag, slug, statement) of the ``@tag slug: statement`` lines of each comment, in order."""
    found = lambda i: F.regexp_extract_all("t", F.lit(MARKER), F.lit(i))
    x = comments.select(key, strip_doc_comment(F.col("comment")).alias("t"))
    x = x.select(key, F.posexplode(F.arrays_zip(found(1).alias("tag"), found(2).alias("slug"), found(3).alias("statement"))).alias("no", "m"))
    tag, said = F.lower("m.tag"), F.trim("m.statement")
    return x.select(key, "no", F.when(tag == "boundedcontext", "boundedContext").otherwise(tag).alias("tag"), "m.slug", F.when(said != "", said).alias("statement"))


def _scalar(raw: Column) -> Column:
    return F.regexp_replace(F.trim(raw), "^[\"']|[\"']$", "")


def parse_front_matter(documents: DataFrame, key: str) -> DataFrame:
    """(key, data map<string, array<string>>, body, body_start_line): the lines between two ``---`` as keys and values.

    Without a closing line there is no data and the body is the whole text. An inline list has several values, anything
    else one; quotes around values are dropped; of a repeated key the last counts.
    """
    x = documents.select(key, "text", F.col("text").rlike(FRONT_MATTER).alias("has"), F.regexp_extract("text", FRONT_MATTER, 1).alias("head"))

    def values(s: Column) -> Column:
        v = F.trim(F.regexp_replace(s, "^[^:]*:", ""))
        body = F.trim(F.regexp_replace(v, r"^\[|\]$", ""))
        listed = v.rlike(r"^\[.*\]$")
        return F.when(listed & (body == ""), F.array().cast("array<string>")).when(listed, F.transform(F.split(body, ","), _scalar)).otherwise(F.array(_scalar(v)))

    said = F.filter(F.split("head", "\r?\n"), lambda s: F.trim(F.substring_index(s, ":", 1)) != "")
    said = F.filter(said, lambda s: F.contains(s, F.lit(":")))
    pairs = F.transform(said, lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("key"), values(s).alias("value")))
    none = F.array().cast("array<struct<key:string,value:array<string>>>")
    last = F.aggregate(pairs, none, lambda done, p: F.concat(F.filter(done, lambda q: q["key"] != p["key"]), F.array(p)))
    body = F.when(F.col("has"), F.replace(F.regexp_replace("text", FRONT_MATTER, ""), F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))
    start = F.when(F.col("has"), F.size(F.split("head", "\n")) + 2).otherwise(1)
    return x.select(key, F.map_from_entries(last).alias("data"), body.alias("body"), start.alias("body_start_line"))


def extract_documents(documents: DataFrame, key: str) -> DataFrame:
    """(key, title, type, status, bounded_context, decision, deprecated, capabilities, invariants, contradicts)."""
    f = parse_front_matter(documents, key)
    one = lambda k: F.element_at(F.element_at("data", k), 1)
    many = lambda k: F.coalesce(F.element_at("data", k), F.array().cast("array<string>"))
    heading = F.trim(F.regexp_extract("body", r"(?m)^#\s+(.+)$", 1))
    return f.select(
        key, F.when(heading != "", heading).otherwise(F.col(key).cast("string")).alias("title"), F.coalesce(one("type"), F.lit("doc")).alias("type"), one("status").alias("status"),
        one("boundedContext").alias("bounded_context"), one("decision").alias("decision"), (F.coalesce(one("status") == "deprecated", F.lit(False)) | F.coalesce(one("deprecated") == "true", F.lit(False))).alias("deprecated"),
        many("capabilities").alias("capabilities"), many("invariants").alias("invariants"), F.transform(many("contradicts"), normalize_path).alias("contradicts"),
    )


def extract_migrations(files: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Tables (key, no, table_name) that SQL creates, and constraints (key, line, slug, statement) its comments name, the
    first of each line."""
    tables = files.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(CREATE_TABLE), F.lit(1))).alias("no", "table_name"))
    lines = files.select(key, F.posexplode(F.split("text", "\r?\n")).alias("no", "l")).where(F.col("l").rlike(CONSTRAINT))
    said = F.trim(F.regexp_extract("l", CONSTRAINT, 2))
    return tables, lines.select(key, (F.col("no") + 1).alias("line"), F.regexp_extract("l", CONSTRAINT, 1).alias("slug"), F.when(said != "", said).alias("statement"))
