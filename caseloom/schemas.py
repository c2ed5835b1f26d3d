"""Input and state table schemas."""

from __future__ import annotations

NORMALIZED_DOCUMENT = (
    "project_id string, source_id string, sync_id string, batch_id string, position bigint, "
    "external_id string, path string, source_type string, content string, content_hash string, "
    "metadata map<string,string>, size_bytes bigint, modified_at timestamp"
)
EVAL_CASE = (
    "id string, question string, query_class string, expected_documents array<string>, "
    "expected_terms array<string>, forbidden_terms array<string>, "
    "expected_source_types array<string>, forbidden_source_types array<string>, "
    "expected_root_cause string, must_not_claim array<string>"
)
DOCUMENTS = (
    "project_id string, source_id string, external_id string, document_id string, title string, "
    "path string, doc_type string, source_type string, content_hash string, checksum string, "
    "modified_at timestamp, size_bytes bigint"
)
CHUNKS = (
    "project_id string, source_id string, external_id string, document_id string, chunk_id string, "
    "path string, failure_code string, chunk_type string, doc_type string, service_name string, "
    "endpoint string, deploy_hash string, timestamp_start timestamp, timestamp_end timestamp, "
    "section_title string, start_line int, end_line int, text string, token_count int, "
    "metadata map<string,string>, metadata_lists map<string,array<string>>"
)
RELATIONS = (
    "project_id string, evidence_chunk_id string, chunk_type string, document_path string, source_type string, "
    "relation_type string, from_key string, to_key string"
)
QUARANTINE = "project_id string, source_id string, external_id string, batch_id string, path string, failure_code string"
#: A line of input that is no document of the declared schema, kept as text beside what could be read of it.
MALFORMED = "malformed"
