"""Common table expressions that the queries' SQL starts from."""

PATH = r"regexp_replace(replace({0}, '\', '/'), '^\./', '')"

GRAPH = f"""
s0 AS (SELECT snapshot_id, max(captured_at) captured_at, max(repository_identity) repo FROM snapshots WHERE snapshot_id IN (SELECT snapshot_id FROM nodes) GROUP BY 1),
last AS (SELECT repo, max(struct_pack(c := captured_at, i := snapshot_id)).i snapshot_id FROM s0 GROUP BY 1),
n AS (SELECT repo, id, x.kind AS kind, x.name AS name, {PATH.format('x.file_path')} AS file_path, x.bounded_context AS bounded_context, x.exported AS exported, coalesce(x.tags, []) AS tags, x.evidence AS evidence, x.metadata AS metadata
  FROM (SELECT repo, id, arg_max(nodes, struct_pack(d := delivered_at, k := kind, n := name, f := file_path)) x FROM nodes JOIN last USING (snapshot_id) GROUP BY 1, 2)),
e AS (SELECT repo, id, x.kind AS kind, x.from_id AS from_id, x.to_id AS to_id, x.evidence AS evidence
  FROM (SELECT repo, id, arg_max(edges, struct_pack(d := delivered_at, k := kind, f := from_id, t := to_id)) x FROM edges JOIN last USING (snapshot_id) GROUP BY 1, 2) WHERE x.from_id IS NOT NULL AND x.to_id IS NOT NULL)"""

HUNKS = f"""
h AS (SELECT diff_id, file_path, hunk_no, x.old_start AS old_start, coalesce(x.old_lines, 1) AS old_lines, x.new_start AS new_start, coalesce(x.new_lines, 1) AS new_lines
  FROM (SELECT diff_id, {PATH.format('file_path')} AS file_path, hunk_no, max(struct_pack(r := received_at, old_start := old_start, old_lines := old_lines, new_start := new_start, new_lines := new_lines)) x FROM hunks GROUP BY 1, 2, 3))"""

RANGES = """
nr AS (SELECT id, list_min(list_transform(evidence, lambda r: r.start_line)) AS start_line, list_max(list_transform(evidence, lambda r: coalesce(r.end_line, r.start_line))) AS end_line FROM n)"""

_TOUCHABLE = "('function', 'class', 'interface', 'type', 'enum', 'module', 'test', 'document', 'migration')"

IMPACT = f"""
cand AS (SELECT DISTINCT diff_id, id, kind FROM n JOIN (SELECT DISTINCT diff_id, file_path FROM h) USING (file_path) WHERE kind IN {_TOUCHABLE}),
fl AS (SELECT diff_id, file_path, bool_or(old_start IS NOT NULL OR new_start IS NOT NULL) placed FROM h GROUP BY 1, 2),
imp AS (SELECT DISTINCT h.diff_id, n.id FROM n JOIN nr ON nr.id = n.id JOIN h ON h.file_path = n.file_path JOIN fl ON fl.diff_id = h.diff_id AND fl.file_path = h.file_path WHERE kind IN {_TOUCHABLE}
  AND (start_line IS NULL OR NOT placed OR (old_start <= coalesce(end_line, start_line) AND old_start + greatest(old_lines, 1) - 1 >= start_line)
    OR (new_start <= coalesce(end_line, start_line) AND new_start + greatest(new_lines, 1) - 1 >= start_line)))"""

FINDINGS = """
nb AS (SELECT n.*, id IN (SELECT from_id FROM e WHERE kind = 'tested_by') tested, id IN (SELECT from_id FROM e WHERE kind = 'constrained_by') constrained,
  id IN (SELECT from_id FROM e JOIN n t ON t.id = e.to_id WHERE e.kind = 'related_to' AND list_contains(t.tags, 'security')) beside, list_contains(tags, 'security') sec, list_contains(tags, 'critical') crit FROM n),
c0 AS (SELECT id, name, unnest(list_filter([CASE WHEN constrained THEN 'invariant_touched_without_test' END,
  CASE WHEN kind IN ('interface', 'type') AND exported AND (sec OR crit) THEN 'critical_contract_changed_without_test' END,
  CASE WHEN sec OR beside THEN 'security_surface_without_verification' END,
  CASE WHEN kind IN ('interface', 'type') AND exported AND NOT (sec OR crit) THEN 'contract_changed_without_test' END], lambda x: x IS NOT NULL)) AS condition FROM nb WHERE NOT tested),
nn AS (SELECT 'deprecated ' || id claim, id FROM n WHERE kind = 'document' AND (list_contains(tags, 'deprecated') OR metadata['deprecated'] = 'true')
  UNION SELECT 'contradicts ' || from_id || ' ' || to_id, unnest([from_id, to_id]) FROM e WHERE kind = 'contradicts' AND from_id IN (SELECT id FROM n WHERE kind = 'document')),
ct AS (SELECT diff_id, count(DISTINCT claim) k FROM imp JOIN nn USING (id) GROUP BY 1),
met AS (SELECT diff_id, condition, id, name FROM imp JOIN c0 USING (id) UNION ALL SELECT diff_id, 'contradiction_unresolved', id, name FROM imp JOIN n USING (id) WHERE kind = 'document' AND diff_id IN (SELECT diff_id FROM ct)),
rules AS (SELECT * FROM (VALUES (0, 'invariant-needs-test', 'invariant_touched_without_test', 'block', 'strict', 'invariant-constrained code changed without a covering test: '),
  (1, 'critical-contract-needs-test', 'critical_contract_changed_without_test', 'block', 'strict', 'critical exported contract changed without a covering test: '),
  (2, 'security-needs-verification', 'security_surface_without_verification', 'block', 'strict', 'security surface changed without verification: '),
  (3, 'contract-needs-test', 'contract_changed_without_test', 'warn', 'advisory', 'exported contract changed without a covering test: '),
  (4, 'contradiction-unresolved', 'contradiction_unresolved', 'warn', 'advisory', '')) t(ord, rule, condition, severity, tier, msg)),
f0 AS (SELECT diff_id, condition, count(*) n_nodes, string_agg(name, ', ' ORDER BY id) names FROM met GROUP BY 1, 2
  UNION ALL SELECT diff_id, 'contradiction_unresolved', 0, '' FROM ct WHERE diff_id NOT IN (SELECT diff_id FROM met WHERE condition = 'contradiction_unresolved')),
f AS (SELECT diff_id, ord, rule, condition, severity, tier, n_nodes, CASE WHEN ord = 4 THEN concat('change touches ', k, ' unresolved contradiction(s)') ELSE msg || names END AS message FROM f0 JOIN rules USING (condition) LEFT JOIN ct USING (diff_id))"""

UNKNOWNS = """
ui AS (SELECT i.id inv, coalesce(i.metadata['statement'], 'Invariant: ' || i.name) said FROM n i WHERE i.kind = 'invariant' AND NOT EXISTS (SELECT 1 FROM e b JOIN e t ON t.from_id = b.from_id AND t.kind = 'tested_by' WHERE b.kind = 'constrained_by' AND b.to_id = i.id)),
un AS (SELECT e.from_id id, string_agg(n.name, ', ' ORDER BY e.id, n.name) inv FROM e JOIN n ON n.id = e.to_id WHERE e.kind = 'constrained_by' AND n.name <> '' GROUP BY 1),
unk AS (SELECT diff_id, 'Impacted invariant is not test-backed: ' || said AS unknown FROM imp JOIN e ON e.from_id = imp.id AND e.kind = 'constrained_by' JOIN ui ON ui.inv = e.to_id
  UNION SELECT diff_id, concat('"', name, '" is constrained by [', coalesce(inv, ''), '] but has no test — behaviour under change is unverified.') FROM imp JOIN nb USING (id) LEFT JOIN un USING (id) WHERE constrained AND NOT tested)"""

#: The graph and hunks with what the tables lack, as the query's ``seeded``.
SEEDED_GRAPH = GRAPH.replace("\nn AS (", "\nn0 AS (").replace("\ne AS (", "\ne0 AS (") + """,
n AS (SELECT * REPLACE (CASE WHEN kind = 'document' AND list_contains(tags, 'legacy') THEN MAP {'deprecated': 'true'} ELSE metadata END AS metadata,
  CASE WHEN kind = 'enum' AND list_contains(tags, 'generated') THEN 'decision' WHEN kind = 'enum' AND list_contains(tags, 'legacy') THEN 'risk' WHEN kind = 'class' AND list_contains(tags, 'generated') THEN 'contract' ELSE kind END AS kind) FROM n0),
e AS (SELECT repo, id, kind, from_id, to_id FROM e0 UNION ALL SELECT repo, 'x:' || id, 'contradicts', id, t FROM n0 JOIN (SELECT repo, min(id) t FROM n0 WHERE kind = 'invariant' GROUP BY 1) USING (repo) WHERE kind = 'document' AND list_contains(tags, 'generated')
  UNION ALL SELECT repo, 'c:' || id, 'covers', to_id, from_id FROM e0 WHERE kind = 'tested_by' UNION ALL SELECT repo, 'r:' || id, 'related_to', from_id, to_id FROM e0 WHERE kind = 'declares' AND to_id IN (SELECT id FROM n WHERE kind = 'risk'))"""
SEEDED_HUNKS = HUNKS.replace("\nh AS (", "\nh0 AS (") + """,
h AS (SELECT * REPLACE (CASE WHEN hunk_no % 4 <> 0 THEN old_start END AS old_start, CASE WHEN hunk_no % 4 <> 0 THEN new_start END AS new_start) FROM h0)"""

#: Claims c (kind, statement, subj, st, tags) by all nine rules.
NINE_CLAIMS = """
ts AS (SELECT DISTINCT from_id s FROM e WHERE kind = 'tested_by'),
lk AS (SELECT i.id, e.from_id o, e.id eid FROM n i JOIN e ON e.to_id = i.id AND e.kind = CASE i.kind WHEN 'invariant' THEN 'constrained_by' WHEN 'capability' THEN 'implements_capability' WHEN 'contract' THEN 'declares' WHEN 'risk' THEN 'related_to' END
  UNION ALL SELECT i.id, e.to_id, e.id FROM n i JOIN e ON e.from_id = i.id AND e.kind = 'covers' WHERE i.kind = 'test'),
lg AS (SELECT id, count(*) k, bool_or(o IN (FROM ts)) tested, list(o ORDER BY eid, o) o FROM lk GROUP BY 1),
ln AS (SELECT n.*, coalesce(k, 0) k, coalesce(tested, false) tested, list_concat([id], coalesce(o, [])) subj, metadata['statement'] said FROM n LEFT JOIN lg USING (id)),
c AS (SELECT 'invariant' kind, coalesce(said, 'Invariant: ' || name) statement, subj, CASE WHEN tested THEN 'tested' WHEN list_contains(tags, 'from-doc') THEN 'documented' ELSE 'inferred' END st, list_concat(['invariant'], tags) tags FROM ln WHERE kind = 'invariant'
  UNION ALL SELECT 'capability', concat('Capability "', name, '" is implemented by ', k, ' symbol(s).'), subj, CASE WHEN tested THEN 'tested' WHEN list_contains(tags, 'from-code') THEN 'documented' ELSE 'inferred' END, ['capability'] FROM ln WHERE kind = 'capability' AND (k > 0 OR list_contains(tags, 'from-doc'))
  UNION ALL SELECT 'contract', coalesce(said, 'Contract: ' || name), subj, 'statically_verified', ['contract'] FROM ln WHERE kind = 'contract'
  UNION ALL SELECT 'contract', concat('Exported ', kind, ' "', name, '" is a public, compiler-enforced contract.'), [id], 'statically_verified', ['contract', 'exported'] FROM ln WHERE kind IN ('interface', 'type') AND exported
  UNION ALL SELECT 'behavior', concat('Behaviour covered by test ', name, '.'), subj, 'tested', ['behavior'] FROM ln WHERE kind = 'test' AND k > 0
  UNION ALL SELECT 'decision', coalesce(said, name), [id], 'documented', ['decision'] FROM ln WHERE kind = 'decision'
  UNION ALL SELECT 'risk', coalesce(said, 'Risk: ' || name), subj, 'inferred', ['risk'] FROM ln WHERE kind = 'risk'
  UNION ALL SELECT 'deprecation', concat('Deprecated documentation "', name, '" — its assertions are no longer authoritative.'), [id], 'deprecated', ['deprecation', 'documentation'] FROM ln WHERE kind = 'document' AND (list_contains(tags, 'deprecated') OR metadata['deprecated'] = 'true')
  UNION ALL SELECT 'assumption', concat('Documentation "', ln.name, '" contradicts "', coalesce(t.name, e.to_id), '".'), [ln.id, e.to_id], 'contradicted', ['contradiction', 'documentation'] FROM ln JOIN e ON e.from_id = ln.id AND e.kind = 'contradicts' LEFT JOIN n t ON t.id = e.to_id WHERE ln.kind = 'document')"""

FNV = "printf('%08x', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({0}, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295))"
#: As the slug of text that folds to ASCII by dropping what is not: the statements' dashes and names.
SLUG = "left(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40)"
CLAIM_ID = f"concat('claim:', kind, ':', {SLUG.format('statement')}, '-', {FNV.format("array_to_string(subj, '|') || '::' || statement")})"

DIFF_CO_CHANGE = f"""
dc AS (SELECT DISTINCT repository_identity repo, commit_id, {PATH.format('file')} f FROM commit_files WHERE commit_id IS NOT NULL AND file IS NOT NULL), dd AS (SELECT DISTINCT diff_id, {PATH.format('file_path')} f FROM hunks),
dp AS (SELECT a.repo, a.f AS file, b.f AS co_file, count(*) AS commits FROM dc a JOIN dc b ON a.repo = b.repo AND a.commit_id = b.commit_id AND a.f <> b.f WHERE a.f IN (SELECT f FROM dd) GROUP BY 1, 2, 3),
dco AS (SELECT diff_id, repo, file, co_file, commits, CAST(row_number() OVER (PARTITION BY diff_id, repo, file ORDER BY commits DESC, co_file) AS INTEGER) AS pos FROM dd JOIN dp ON dp.file = dd.f WHERE commits >= 2 AND (diff_id, co_file) NOT IN (SELECT (diff_id, f) FROM dd) QUALIFY pos <= 8)"""
