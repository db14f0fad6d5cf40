"""Repository files, candidate lists and task texts as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions.paths import normalize_path
from ripplegraph.operators.extract import IGNORED_FOLDERS, classify_path, is_excluded


def discover_files(spark: SparkSession, root: str, excludes: list[str] | None = None, content: bool = True, ignored: list[str] = IGNORED_FOLDERS) -> DataFrame:
    """(rel_path, role, content) of the files under ``root`` that are not excluded, in order of path when written.

    Folders named in ``ignored`` are not looked into; a tool that keeps its own folder in a repository adds its name. Without
    ``content`` the texts are not read; roles then come from names alone. Files that are no UTF-8 are read with replacement
    characters; files without a byte hold nothing to analyse and are left out, as Spark skips them.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    f = raw.withColumn("rel_path", normalize_path(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{_quoted(base)}/", "")))
    f = f.where(~is_excluded(F.col("rel_path"), excludes or [], ignored))
    if not content:
        return f.select("rel_path", classify_path(F.col("rel_path")).alias("role"))
    text = F.decode("content", "UTF-8")
    return f.select("rel_path", classify_path(F.col("rel_path"), text).alias("role"), text.alias("content"))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "/" else "\\" + c for c in text)


def count_typescript(files: DataFrame) -> DataFrame:
    return files.where("role in ('source', 'test')").agg(F.count("*").alias("n"))


#: Names of a search result's fields, the first that is there counting.
CANDIDATE_FIELDS = {
    "file_path": ("string", ["filePath", "file", "path"]), "score": ("double", ["score", "similarity", "relevance"]), "symbol": ("string", ["symbolName", "symbol", "name"]), "snippet": ("string", ["snippet", "content", "text"]),
    "start_line": ("int", ["startLine", "start_line", "start"]), "end_line": ("int", ["endLine", "end_line", "end"]),
}


def parse_candidates(outputs: DataFrame) -> DataFrame:
    """(query_id, file_path, score, symbol, snippet, start_line, end_line) from (query_id, text): a JSON array, an object with
    ``results``, or a JSON object a line among which other lines are noise. The score is 0.5 if there is none; a result without
    a path is dropped."""
    item = ", ".join(f"{name}: {kind}" for kind, names in CANDIDATE_FIELDS.values() for name in names)
    item = f"struct<{item}>"
    t = F.trim("text")
    listed = F.startswith(t, F.lit("["))
    whole = F.from_json(t, f"struct<results: array<{item}>>")
    many = F.when(listed, F.from_json(t, f"array<{item}>")).otherwise(whole["results"])
    lines = F.transform(F.filter(F.split(t, "\r?\n"), lambda s: F.trim(s) != ""), lambda s: F.from_json(s, item))
    x = outputs.select("query_id", F.explode(F.when(listed | F.get_json_object(t, "$.results").isNotNull(), many).otherwise(lines)).alias("i"))
    got = {c: F.coalesce(*(F.col(f"i.{n}") for n in names)) for c, (_, names) in CANDIDATE_FIELDS.items()}
    x = x.select("query_id", *(v.alias(c) for c, v in got.items())).where("file_path is not null")
    return x.withColumns({"file_path": normalize_path("file_path"), "score": F.coalesce("score", F.lit(0.5))})


#: Labels of task texts and the field each gives.
TASK_LABELS = {
    "mode": "mode", "capability": "capabilities", "capabilities": "capabilities", "invariant": "hard_invariants", "invariants": "hard_invariants", "hard invariant": "hard_invariants", "observed": "observed_behavior",
    "observed behavior": "observed_behavior", "expected": "expected_behavior", "expected behavior": "expected_behavior", "bounded context": "bounded_contexts", "boundedcontext": "bounded_contexts", "context": "bounded_contexts",
    "non-goal": "non_goals", "non goal": "non_goals", "nongoal": "non_goals", "risk": "risk_surfaces", "risks": "risk_surfaces", "soft constraint": "soft_constraints", "acceptance": "acceptance_evidence",
}
#: Words that tell a task's mode, in order of precedence.
MODE_WORDS = (
    ("security", ["security", "vulnerab", "auth", "exploit", "injection", "xss", "csrf"]), ("performance", ["performance", "slow", "latency", "throughput", "optimize", "optimise"]),
    ("migration", ["migrate", "migration", "upgrade", "port to", "move to"]), ("refactor", ["refactor", "clean up", "restructure", "rename", "extract"]), ("audit", ["audit", "review", "assess", "inventory"]),
    ("bugfix", ["fix", "bug", "incorrect", "wrong", "broken", "regression", "race"]), ("feature", ["add", "implement", "support", "introduce", "new feature", "enable"]),
)


#: Fixed value: the pattern of a labelled line.
LABELLED = r"^[\s>*-]*([A-Za-z][A-Za-z -]*?)\s*:\s*(.+)$"


def parse_tasks(tasks: DataFrame) -> DataFrame:
    """(task_id, field, value) of the labelled lines of task texts; behaviours stay whole, other values part at commas."""
    line = tasks.select("task_id", F.posexplode(F.split("text", "\r?\n")).alias("no", "line")).where(F.col("line").rlike(LABELLED))
    label = F.lower(F.regexp_extract("line", LABELLED, 1))
    field = F.element_at(F.create_map(*(F.lit(x) for kv in TASK_LABELS.items() for x in kv)), label)
    x = line.select("task_id", "no", field.alias("field"), F.trim(F.regexp_extract("line", LABELLED, 2)).alias("v")).where("field is not null")
    whole = F.col("field").isin("observed_behavior", "expected_behavior")
    values = F.when(whole, F.array("v")).otherwise(F.filter(F.transform(F.split("v", ","), lambda s: F.trim(s)), lambda s: s != ""))
    return x.select("task_id", "field", F.posexplode(values).alias("pos", "value"), "no").select("task_id", "field", "no", "pos", "value")


def detect_mode(text):  # noqa: ANN001, ANN201
    """The mode a task's words tell: the first of seven groups, else feature."""
    from ripplegraph.functions.scoring import mentions

    t = F.lower(text)
    return F.coalesce(*(F.when(mentions(t, w), m) for m, w in MODE_WORDS), F.lit("feature"))
