"""Extraction and identity operators over texts built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions import hashing, ids, scoring
from ripplegraph.functions.paths import normalize_path
from ripplegraph.operators import extract, impact
from ripplegraph.plans.graph_sql import HUNKS, PATH
from ripplegraph.runtime import read


def diff_parse(spark: SparkSession, d: str) -> DataFrame:
    """Hunks read back from unified diffs written from the hunk table: counts of 1 omitted, misleading lines put in."""
    h = impact.current_hunks(read(spark, d, "hunks")).where("old_start is not null and new_start is not null")
    count = lambda c: F.when(F.col(c) == 1, "").otherwise(F.concat(F.lit(","), F.col(c).cast("string")))
    head = F.concat(F.lit("@@ -"), F.col("old_start").cast("string"), count("old_lines"), F.lit(" +"), F.col("new_start").cast("string"), count("new_lines"), F.lit(" @@ part\n+++ b/not-a-file.ts\n-x"))
    f = h.groupBy("diff_id", "file_path").agg(F.array_join(F.sort_array(F.collect_list(head)), "\n").alias("body"))
    gone = F.pmod(F.length("file_path"), F.lit(7)) == 0
    to = F.when(gone, "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/"), "file_path"))
    f = f.withColumn("body", F.concat(F.lit("--- a/"), "file_path", F.lit("\n"), to, F.lit("\n"), "body"))
    diffs = f.groupBy("diff_id").agg(F.array_join(F.sort_array(F.collect_list("body")), "\n").alias("text"))
    return extract.parse_diffs(diffs).groupBy("diff_id", "file_path", "old_start", "old_lines", "new_start", "new_lines").agg(F.count("*").alias("n"))


def path_classify(spark: SparkSession, d: str) -> DataFrame:
    """Every file of the history by role, and whether it is excluded."""
    f = read(spark, d, "commit_files").where("file is not null").select(normalize_path("file").alias("path")).distinct()
    return f.select("path", extract.classify_path(F.col("path")).alias("role"), extract.is_excluded(F.col("path"), ["**/core/*", "shared"]).alias("excluded"))


def markers_parse(spark: SparkSession, d: str) -> DataFrame:
    """Markers in doc comments built from parts."""
    p = read(spark, d, "part").select("p_partkey", F.concat(F.lit("/**\n * Part.\n * @Capability cap-"), F.col("p_size").cast("string"), F.lit(": "), "p_name", F.lit("  \n * @invariant size_"), F.col("p_size").cast("string"), F.lit("\n * @tag critical\n * @unknown x: y\n */")).alias("comment"))
    return extract.parse_markers(p, "p_partkey").select("p_partkey", "no", "tag", "slug", F.coalesce("statement", F.lit("-")).alias("statement"))


def front_matter_parse(spark: SparkSession, d: str) -> DataFrame:
    """Document facts from front matter built from orders."""
    o = read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "deprecated").otherwise("active")
    key = F.col("o_orderkey").cast("string")
    close = F.when(F.pmod(F.col("o_orderkey"), F.lit(10)) == 9, "\n").otherwise("\n---\n")
    text = F.concat(F.lit("---\ntype: adr\nstatus: '"), status, F.lit("'\ncapabilities: [cap-"), key, F.lit(", \"x\"]\ncontradicts: [./docs\\"), key, F.lit(".md]"), close, F.lit("intro\n# Order "), key, F.lit("\nbody"))
    x = extract.extract_documents(o.select("o_orderkey", text.alias("text")), "o_orderkey")
    return x.select("o_orderkey", "title", "type", "deprecated", F.array_join("capabilities", ",").alias("capabilities"), F.array_join("contradicts", ",").alias("contradicts"))


def _migrations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("CREATE TABLE IF NOT EXISTS \"t_"), key, F.lit("\" (x int);\r\n-- @constraint size-"), F.col("p_size").cast("string"), F.lit(": at most "), F.col("p_size").cast("string"), F.lit("\r\ncreate table b_"), key, F.lit("(y int); -- @constraint bare"))
    return extract.extract_migrations(read(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey")


def migration_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables created by migrations built from parts."""
    return _migrations(spark, d)[0]


def migration_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Constraints named in migrations built from parts."""
    return _migrations(spark, d)[1].select("p_partkey", "line", "slug", F.coalesce("statement", F.lit("-")).alias("statement"))


def doc_comment_text(spark: SparkSession, d: str) -> DataFrame:
    """All doc comments of all documents, their frames stripped, by place and hash."""
    x = read(spark, d, "documents").where(F.contains("text", F.lit("/**")))
    x = x.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)/\*\*.*?\*/"), F.lit(0))).alias("no", "comment"))
    return x.select("doc_id", "no", F.sha2(extract.strip_doc_comment(F.col("comment")), 256).alias("text_hash"))


def slug_ids(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of part names, and the ids built of them."""
    p = read(spark, d, "part")
    s = ids.slugify(F.concat("p_name", F.lit(" — "), "p_type"))
    return p.select("p_partkey", s.alias("slug"), F.concat(F.lit("cap:"), s).alias("cap_id"))


def edge_ids(spark: SparkSession, d: str) -> DataFrame:
    """32-bit ids of edges, and how many edges of a kind they would merge."""
    e = read(spark, d, "edges").where("from_id is not null and to_id is not null").select("kind", "from_id", "to_id").distinct()
    e = e.withColumn("edge_id", ids.edge_id(F.col("kind"), F.col("from_id"), F.col("to_id")))
    return e.groupBy("kind", "edge_id").agg(F.count("*").alias("n_merged"))


def fnv_units(spark: SparkSession, d: str) -> DataFrame:
    """The same hash over UTF-16 units for texts of any script."""
    return read(spark, d, "documents").where("text is not null").select("doc_id", ids.fnv1a("text").alias("fnv"))


def evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    """Evidence rows whose id is not the one their columns give."""
    from ripplegraph.operators.versions import evidence_id

    ev = read(spark, d, "evidence")
    whole = evidence_id(F.struct("file_path", "start_line", "end_line", "source_kind"))
    return ev.select("id", whole.alias("computed")).distinct().withColumn("same", F.col("id") == F.col("computed"))


def sha_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A fingerprint of each brand's parts, whatever order they come in."""
    return hashing.fingerprint(read(spark, d, "part"), ["p_brand"], F.col("p_partkey"), F.col("p_name"), "parts:v1")


def canonical_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of edges as canonical JSON, hashed with its domain."""
    e = read(spark, d, "edges").where("id is not null")
    j = hashing.canonical_json(kind=hashing.json_text(F.col("kind")), metadata=hashing.canonical_map(F.col("metadata")), to=hashing.json_text(F.col("to_id")))
    return e.select("snapshot_id", "id", hashing.domain_sha256("edge:v1", j).alias("digest")).distinct()


def hunk_identities(spark: SparkSession, d: str) -> DataFrame:
    """Identities of all hunks that have all their numbers."""
    h = impact.current_hunks(read(spark, d, "hunks")).where("old_start is not null and new_start is not null")
    raw = F.concat(F.lit("@@ -"), F.col("old_start").cast("string")).cast("binary")
    i = hashing.hunk_identity(F.substring_index("file_path", "/", 1), F.col("file_path"), F.col("old_start"), F.col("old_lines"), F.col("new_start"), F.col("new_lines"), F.lit(None).cast("string"), F.substring_index("diff_id", ":", -1), raw, b"HUNKFRM0")
    return h.select("diff_id", "file_path", "hunk_no", i.alias("identity"))


def question_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What kind of question each document would ask as a task."""
    x = read(spark, d, "documents").where("text is not null")
    mode = F.when(F.col("doc_id") % 50 == 1, "security").when(F.col("doc_id") % 50 == 2, "migration").otherwise("feature")
    return x.select("doc_id", scoring.classify_question(mode, F.col("text")).alias("question"))


def semantic_ids(spark: SparkSession, d: str) -> DataFrame:
    """Kinds and canonical forms of authored ids built from the owners of links."""
    o = read(spark, d, "sem_links").select(F.regexp_replace("owner_id", r"^[^.]*\.", "").alias("ref")).where("ref is not null").distinct()
    kind = ids.semantic_kind(F.col("ref"))
    return o.select("ref", F.coalesce(kind, F.lit("-")).alias("kind"), ids.is_semantic_id(F.col("ref"), F.coalesce(kind, F.lit(""))).alias("valid"), ids.semantic_id(F.lit("goal"), F.upper("ref")).alias("as_goal"))


def link_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The kind that each authored reference's prefix makes it."""
    x = read(spark, d, "sem_links").where("ref is not null").select("ref").distinct()
    kind, ref = ids.link_of(F.col("ref"))
    return x.select("ref", kind.alias("kind"), ref.alias("target"))


def safe_paths(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of paths in the history, and whether each is safe as it stands."""
    f = read(spark, d, "commit_files").where("file is not null").select("file").distinct()
    return f.select("file", hashing.is_safe_path(F.col("file")).alias("safe"))


_CH = f"""WITH {HUNKS}, g AS (SELECT *, length(file_path) % 7 = 0 gone FROM h WHERE old_start IS NOT NULL AND new_start IS NOT NULL)"""
_U = "from_hex(printf('%08x', CAST({0} AS BIGINT)))"
_KEY = "CAST(o_orderkey AS VARCHAR)"
SQL = {
    "diff_parse": f"{_CH} SELECT diff_id, file_path, old_start, old_lines, new_start, new_lines, count(*) AS n FROM g WHERE NOT gone GROUP BY ALL",
    "path_classify": rf"""SELECT path, CASE WHEN regexp_matches(path, '\.sql$') OR (list_has_any(string_split(path, '/'), ['migrations', 'migration']) OR starts_with(path, 'migrations')) AND regexp_matches(path, '\.(ts|tsx|mts|cts)$') THEN 'migration'
 WHEN regexp_matches(path, '\.mdx?$') THEN 'document' WHEN regexp_matches(path, '\.(ts|tsx|mts|cts)$') THEN CASE WHEN regexp_matches(path, '\.(test|spec)\.(ts|tsx|mts|cts)$') OR list_has_any(string_split(path, '/'), ['test', 'tests', '__tests__']) THEN 'test' ELSE 'source' END ELSE 'other' END AS role,
 list_has_any(string_split(path, '/'), ['node_modules', '.git', 'dist', 'build', 'coverage', '.turbo', '.next']) OR contains(path, '/core/') OR contains(path, 'shared') AS excluded FROM (SELECT DISTINCT {PATH.format('file')} path FROM commit_files WHERE file IS NOT NULL)""",
    "markers_parse": """SELECT p_partkey, 0 AS no, 'capability' AS tag, concat('cap-', p_size) AS slug, trim(p_name) AS statement FROM part UNION ALL SELECT p_partkey, 1, 'invariant', concat('size_', p_size), '-' FROM part UNION ALL SELECT p_partkey, 2, 'tag', 'critical', '-' FROM part""",
    "front_matter_parse": f"""SELECT o_orderkey, 'Order ' || {_KEY} AS title, CASE WHEN o_orderkey % 10 = 9 THEN 'doc' ELSE 'adr' END AS type, o_orderkey % 10 <> 9 AND o_orderstatus = 'F' AS deprecated,
 CASE WHEN o_orderkey % 10 = 9 THEN '' ELSE concat('cap-', o_orderkey, ',x') END AS capabilities, CASE WHEN o_orderkey % 10 = 9 THEN '' ELSE concat('docs/', o_orderkey, '.md') END AS contradicts FROM orders""",
    "migration_tables": "SELECT p_partkey, 0 AS no, concat('t_', p_partkey) AS table_name FROM part UNION ALL SELECT p_partkey, 1, concat('b_', p_partkey) FROM part",
    "migration_constraints": "SELECT p_partkey, 2 AS line, concat('size-', p_size) AS slug, concat('at most ', p_size) AS statement FROM part UNION ALL SELECT p_partkey, 3, 'bare', '-' FROM part",
    "doc_comment_text": r"""SELECT doc_id, CAST(no - 1 AS INTEGER) AS no, sha256(array_to_string(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(c, '^\s*/\*\*?', ''), '\*/\s*$', ''), '\r?\n'), lambda s: regexp_replace(regexp_replace(s, '^\s*\*[ \t]?', ''), '\s+$', '')), chr(10))) AS text_hash
 FROM (SELECT doc_id, unnest(l) c, generate_subscripts(l, 1) no FROM (SELECT doc_id, regexp_extract_all(text, '(?s)/\*\*.*?\*/') l FROM documents))""",
    "fnv_units": """SELECT doc_id, printf('%08x', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), flatten(list_transform(regexp_extract_all(text, '(?s).'), lambda c: CASE WHEN unicode(c) < 65536 THEN [CAST(unicode(c) AS BIGINT)] ELSE [55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)] END))),
 lambda h, c: (xor(h, c) * 16777619) & 4294967295)) AS fnv FROM documents WHERE text IS NOT NULL""",
    "semantic_ids": r"""SELECT ref, coalesce(kind, '-') AS kind, coalesce(kind IS NOT NULL AND regexp_full_match(regexp_replace(ref, '^[a-z]+\.', ''), '[a-z0-9]([a-z0-9.-]*[a-z0-9])?'), false) AS valid,
 'goal.' || coalesce(nullif(array_to_string(list_filter(list_transform(string_split(CASE WHEN starts_with(upper(ref), 'goal.') THEN upper(ref)[6:] ELSE upper(ref) END, '.'), lambda p: left(regexp_replace(regexp_replace(lower(p), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60)), lambda p: p <> '' AND p <> 'empty'), '.'), ''), 'unnamed') AS as_goal
 FROM (SELECT ref, CASE WHEN contains(ref, '.') THEN CASE WHEN split_part(ref, '.', 1) = 'proof' THEN 'evidence' WHEN split_part(ref, '.', 1) IN ('goal', 'invariant', 'decision', 'assumption', 'unknown', 'change', 'evidence') THEN split_part(ref, '.', 1) END END kind
 FROM (SELECT DISTINCT regexp_replace(owner_id, '^[^.]*\.', '') ref FROM sem_links WHERE owner_id IS NOT NULL))""",
    "slug_ids": """SELECT p_partkey, slug, 'cap:' || slug AS cap_id FROM (SELECT p_partkey, left(regexp_replace(regexp_replace(lower(concat(p_name, ' ', p_type)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) slug FROM part)""",
    "evidence_ids": f"SELECT *, id = computed AS same FROM (SELECT DISTINCT id, concat('ev:', source_kind, ':', {PATH.format('file_path')}, ':', coalesce(start_line, 0), ':', coalesce(end_line, 0)) AS computed FROM evidence)",
    "edge_ids": "SELECT kind, concat('edge:', kind, ':', printf('%08x', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(from_id || '->' || to_id, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295))) AS edge_id, count(*) AS n_merged FROM (SELECT DISTINCT kind, from_id, to_id FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL) GROUP BY ALL",
    "hunk_identities": f"""WITH {HUNKS}, x AS (SELECT *, encode(string_split(file_path, '/')[1]) r, encode(file_path) p, encode(string_split(diff_id, ':')[-1]) b, encode(concat('@@ -', old_start)) raw FROM h WHERE old_start IS NOT NULL AND new_start IS NOT NULL)
SELECT diff_id, file_path, hunk_no, 'sha256:' || sha256(encode('HUNKFRM0') || {_U.format('1')} || {_U.format('octet_length(r)')} || r || {_U.format('octet_length(p)')} || p || {' || '.join(_U.format(c) for c in ('old_start', 'old_lines', 'new_start', 'new_lines'))} || from_hex('00') || from_hex('01') || {_U.format('octet_length(b)')} || b || {_U.format('octet_length(raw)')} || raw) AS identity FROM x""",
    "sha_fingerprint": """WITH x AS (SELECT p_brand, CAST(p_partkey AS VARCHAR) k, sha256(p_name) h, sha256(CAST(p_partkey AS VARCHAR)) g FROM part), a AS (SELECT p_brand, left(g, 6) g, sha256(string_agg(h, chr(10) ORDER BY k)) h FROM x GROUP BY 1, 2),
b AS (SELECT p_brand, left(g, 3) g, sha256(string_agg(h, chr(10) ORDER BY g)) h FROM a GROUP BY p_brand, left(g, 3)) SELECT p_brand, 'sha256:' || sha256(concat('parts:v1', chr(0), string_agg(h, chr(10) ORDER BY g))) AS fingerprint FROM b GROUP BY 1""",
    "canonical_metadata": """SELECT DISTINCT snapshot_id, id, 'sha256:' || sha256(concat('edge:v1', chr(0), '{', array_to_string(list_filter(['"kind":"' || kind || '"', '"metadata":{' || coalesce(array_to_string(list_transform(list_sort(map_entries(metadata)), lambda e: concat('"', e.key, '":', coalesce('"' || e.value || '"', 'null'))), ','), '') || '}', '"to":"' || to_id || '"'], lambda x: x IS NOT NULL), ','), '}')) AS digest FROM edges WHERE id IS NOT NULL""",
    "question_kinds": "SELECT doc_id, CASE WHEN doc_id % 50 = 1 THEN 'security' WHEN doc_id % 50 = 2 THEN 'persistence' " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {w!r})' for w in words)} THEN '{q}'" for q, words in scoring.QUESTION_WORDS) + " ELSE 'business_rule' END AS question FROM documents WHERE text IS NOT NULL",
    "link_kinds": "SELECT ref, CASE WHEN starts_with(trim(ref), 'file:') THEN 'file' " + " ".join(f"WHEN starts_with(trim(ref), '{p}') THEN '{k}'" for p, k in ids.LINK_KINDS.items()) + " ELSE 'file' END AS kind, regexp_replace(trim(ref), '^file:', '') AS target FROM (SELECT DISTINCT ref FROM sem_links WHERE ref IS NOT NULL)",
    "safe_paths": r"""SELECT file, NOT (p = '' OR regexp_matches(p, '^[A-Za-z]:') OR list_has_any(string_split(p, '/'), ['', '.', '..'])) AS safe FROM (SELECT DISTINCT file, replace(file, '\', '/') p FROM commit_files WHERE file IS NOT NULL)""",
}
QUERIES = {q.__name__: q for q in (
    diff_parse, path_classify, markers_parse, front_matter_parse, migration_tables, migration_constraints, doc_comment_text, slug_ids, edge_ids, fnv_units, evidence_ids, sha_fingerprint, canonical_metadata,
    hunk_identities, question_kinds, semantic_ids, link_kinds, safe_paths,
)}
