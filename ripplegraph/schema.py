"""Schemas of the engine's tables."""

EVIDENCE = "array<struct<file_path: string, start_line: int, end_line: int, source_kind: string, excerpt: string>>"
TABLES = {
    "meta": "key string, value string",
    "nodes": f"id string, kind string, name string, file_path string, bounded_context string, exported boolean, tags array<string>, evidence {EVIDENCE}, metadata map<string, string>",
    "edges": f"id string, kind string, from_id string, to_id string, evidence {EVIDENCE}, metadata map<string, string>",
    "evidence": "id string, file_path string, start_line int, end_line int, source_kind string, excerpt string",
    "claims": "id string, kind string, statement string, subject_node_ids array<string>, evidence_ids array<string>, authority double, freshness double, confidence double, verification_status string, tags array<string>",
    "task_frames": "id string, payload string, created_at string",
    "context_packs": "id string, payload string, generated_at string",
}
#: Closed vocabularies, checked at the boundary.
VOCABULARIES = {
    ("nodes", "kind"): [
        "repository", "package", "module", "symbol", "function", "class", "interface", "type", "enum", "test", "document", "migration", "capability", "invariant", "contract", "decision", "risk", "bounded_context",
        "external_integration",
    ],
    ("edges", "kind"): [
        "imports", "exports", "calls", "references", "extends", "implements", "depends_on", "tested_by", "covers", "verifies", "declares", "documents", "decides", "contradicts", "belongs_to", "constrained_by",
        "implements_capability", "related_to", "changes",
    ],
}
