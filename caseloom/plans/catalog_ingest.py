"""Queries for sources, validation, chunking and state tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import vocab
from caseloom.defaults import DEFAULTS
from caseloom.functions import paths, text as tx
from caseloom.operators import chunkers, embedding, jobs, reports, store, validate, vector
from caseloom.operators.matching import dense_sequence, spread
from caseloom.plans import ingest, state
from caseloom.plans import sqlexpr as sx
from caseloom.plans.catalog_text import facts_sql
from caseloom.plans.registry import Load, big, flag, joined, query, stamp, text
from caseloom.session import checkpoint_root, cut_lineage
from caseloom.sources import documents, files

# --- sources ----------------------------------------------------------------


@query(
    "file_glob_selection",
    r"""SELECT path FROM v_docs WHERE regexp_matches(path, '(?s)^(?:services/.*|docs/.*\.md|.*/logs/.*)\z')
      AND NOT regexp_matches(path, '(?s)^(?:.*handler_1.*|docs/runbook-[02].*)\z')""",
)
def file_glob_selection(t: Load) -> DataFrame:
    return files.select_paths(
        t("v_docs").select("path"), include=["services/*", "docs/*.md", "*/logs/*"],
        exclude=["*handler_1*", "docs/runbook-[02]*"],
    )


@query(
    "file_glob_first_files",
    r"SELECT path FROM v_docs WHERE regexp_matches(path, '(?s)^.*\.(?:py|go)\z') ORDER BY path LIMIT 25",
)
def file_glob_first_files(t: Load) -> DataFrame:
    return files.select_paths(t("v_docs").select("path"), include=["*.py", "*.go"], max_files=25)


_TRIAGE = f"""SELECT doc_id, path, source_id, CASE
      WHEN list_has_any(string_split(path, '/'), [{sx.quoted(vocab.GENERATED_DIRS)}]) THEN 'generated_file'
      WHEN list_has_any(string_split(path, '/'), [{sx.quoted(vocab.VENDOR_DIRS)}]) THEN 'vendor_file'
      WHEN ({sx.suffix('path')}) IN ({sx.quoted(vocab.DENIED_SUFFIXES)}) OR starts_with(regexp_extract(path, '[^/]*$'), '.env') THEN 'unsupported_extension'
      WHEN size_bytes = 0 THEN 'empty' WHEN size_bytes > 2000000 THEN 'oversized'
      WHEN ({sx.suffix('path')}) <> '' AND ({sx.suffix('path')}) NOT IN ({sx.quoted(DEFAULTS.supported_extensions)}) THEN 'unsupported_extension'
      ELSE NULL END AS skip_reason FROM v_inbox"""


@query("file_triage", f"SELECT doc_id, coalesce(skip_reason, '') AS skip_reason FROM ({_TRIAGE})")
def file_triage(t: Load) -> DataFrame:
    tagged = files.triage(t("v_inbox"), F.substring("content", 1, 4096))
    return tagged.select("doc_id", text("skip_reason").alias("skip_reason"))


@query(
    "collector_dry_run_summary",
    f"""SELECT kind, key, count(*) AS n FROM (SELECT 'skip_reason' AS kind, skip_reason AS key FROM ({_TRIAGE})
      UNION ALL SELECT 'source_type', CASE WHEN skip_reason IS NULL THEN CASE WHEN {sx.any_of('lower(path)', vocab.DEPLOY_PATH_TOKENS)} THEN 'deploy'
        WHEN ({sx.source_type('path')}) = 'unknown' THEN 'unknown_text' ELSE ({sx.source_type('path')}) END END FROM ({_TRIAGE})
      UNION ALL SELECT 'language', CASE WHEN skip_reason IS NULL THEN {sx.mapped(sx.suffix('path'), vocab.LANGUAGE_BY_SUFFIX)} END FROM ({_TRIAGE}))
    WHERE key IS NOT NULL GROUP BY ALL""",
)
def collector_dry_run_summary(t: Load) -> DataFrame:
    tagged = files.triage(t("v_inbox"), F.substring("content", 1, 4096)).withColumns(
        {"source_type": paths.collected_source_type("path"), "language": paths.language("path")}
    )
    return reports.collector_summary(tagged)


def _coverage_warnings(**have: str) -> str:
    cells = [f"CASE WHEN NOT {have[c]} THEN '{w}' END" for c, w in reports.COVERAGE_WARNINGS]
    return f"list_filter([{', '.join(cells)}], lambda w: w IS NOT NULL)"


@query(
    "folder_inspection",
    f"""SELECT source_id, total, usable, unsupported, oversized, CASE WHEN usable = 0 THEN 'none' WHEN NOT l AND NOT d AND NOT c THEN 'low'
        WHEN unsupported > usable OR oversized > 0 THEN 'medium' ELSE 'high' END AS grade,
      array_to_string(list_concat({_coverage_warnings(has_logs='l', has_code='c', has_deploys='d', has_incidents='i', has_runbooks='r')}, list_filter([
        CASE WHEN unsupported > 0 THEN unsupported || ' unsupported files will be skipped.' END,
        CASE WHEN oversized > 0 THEN oversized || ' oversized files exceed the ingest limit.' END,
        CASE WHEN usable = 0 THEN 'No supported ingestable files found.' END], lambda w: w IS NOT NULL)), '|') AS warnings
    FROM (SELECT source_id, count(*) AS total, count(*) FILTER (u) AS usable, count(*) FILTER (NOT s) AS unsupported, count(*) FILTER (s AND size_bytes > 2000000) AS oversized,
        coalesce(bool_or(u AND k = 'logs'), false) AS l, coalesce(bool_or(u AND k = 'code'), false) AS c, coalesce(bool_or(u AND k = 'deploy'), false) AS d,
        coalesce(bool_or(u AND k = 'incident'), false) AS i, coalesce(bool_or(u AND k IN ('runbook', 'api_doc')), false) AS r
      FROM (SELECT *, s AND size_bytes <= 2000000 AS u FROM (SELECT source_id, size_bytes, ({sx.suffix('path')}) IN ({sx.quoted(DEFAULTS.supported_extensions)}) AS s,
        {sx.source_type('path')} AS k FROM v_inbox)) GROUP BY source_id)""",
)
def folder_inspection(t: Load) -> DataFrame:
    listed = t("v_inbox").select(
        "source_id", "size_bytes", paths.suffix("path").alias("suffix"), paths.source_type("path").alias("source_type")
    )
    r = reports.inspection(listed, ["source_id"])
    return r.select(
        "source_id", big("total_files_seen").alias("total"), big("ingestable_files").alias("usable"),
        big("unsupported_files").alias("unsupported"), big("oversized_files").alias("oversized"), "grade",
        joined("warnings", "|").alias("warnings"),
    )


_DIGEST = "sha256(path || '|' || CAST(modified_at AS STRING))"


@query(
    "directory_fingerprint",
    f"""SELECT project_id, n AS files, substr(sha256(concat_ws('|', x0, x1, x2, x3, n)), 1, 16) AS version_hash FROM (
      SELECT project_id, count(*) AS n, {', '.join(f"bit_xor(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT)) AS x{i}" for i in range(4))}
      FROM (SELECT project_id, {_DIGEST} AS h FROM (SELECT project_id, 'deploys/' || deploy_id AS path, deployed_at AS modified_at FROM v_deploys)) GROUP BY project_id)""",
)
def directory_fingerprint(t: Load) -> DataFrame:
    listed = t("v_deploys").select(
        "project_id", F.concat(F.lit("deploys/"), "deploy_id").alias("path"), F.col("deployed_at").alias("modified_at")
    )
    return files.fingerprint(listed, ["project_id"])


@query(
    "structured_file_status",
    """SELECT 'p' || deploy_id AS id, CASE deploy_id % 5 WHEN 0 THEN 'array' WHEN 4 THEN 'invalid' ELSE 'object' END AS status FROM v_deploy_docs
    UNION ALL SELECT 'c' || doc_id, CASE WHEN kind IN (5, 6) THEN 'object' ELSE 'other_format' END FROM v_code_docs""",
)
def structured_file_status(t: Load) -> DataFrame:
    of = lambda v, prefix, key: t(v).select(
        F.concat(F.lit(prefix), key).alias("id"), documents.structured_status().alias("status")
    )
    return of("v_deploy_docs", "p", "deploy_id").unionByName(of("v_code_docs", "c", "doc_id"))


# --- validation -------------------------------------------------------------

_SAFE = lambda x: f"NOT (starts_with({x}, '/') OR list_contains(string_split({x}, '/'), '..'))"
_CTRL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
ERROR_SQL = f"""CASE WHEN trim(external_id) = '' THEN 'invalid_external_id' WHEN length(trim(external_id)) > 1024 THEN 'external_id_too_long'
  WHEN NOT ({_SAFE('trim(external_id)')}) THEN 'unsafe_external_id' WHEN trim(path) = '' THEN 'invalid_path' WHEN length(path) > 2048 THEN 'path_too_long'
  WHEN NOT ({_SAFE('path')}) THEN 'unsafe_path' WHEN trim(content) = '' THEN 'empty_content' WHEN size_bytes < 0 THEN 'invalid_size'
  WHEN strlen(content) > 2000000 OR size_bytes > 2000000 THEN 'document_too_large'
  WHEN NOT regexp_matches(trim(content_hash), '^(?i:sha256:)?[a-fA-F0-9]{{64}}$') OR starts_with(content_hash, 'SHA') THEN 'invalid_content_hash'
  WHEN strlen(branch) > 8192 THEN 'metadata_too_large'
  WHEN len(regexp_extract_all(substr(content, 1, 4096), '{_CTRL}')) / greatest(length(substr(content, 1, 4096)), 1) > 0.05 THEN 'binary_content' END"""


def inbox(t: Load) -> DataFrame:
    return t("v_inbox").withColumns(
        {
            "metadata": F.create_map(F.lit("branch"), F.col("branch")),
            "modified_at": F.lit(None).cast("timestamp"), "sync_id": F.lit("s1"),
        }
    )


@query(
    "document_validation",
    f"""SELECT doc_id, coalesce(error, '') AS error, CASE WHEN error IS NULL THEN '' ELSE {sx.failure_code('error')} END AS failure_code,
      {sx.canonical('source_type', 'trim(path)')} AS source_type, regexp_replace(lower(trim(content_hash)), '^sha256:', '') AS content_hash
    FROM (SELECT *, {ERROR_SQL} AS error FROM v_inbox)""",
)
def document_validation(t: Load) -> DataFrame:
    tagged = validate.validate_documents(inbox(t))
    return tagged.select(
        "doc_id", text("error").alias("error"), text("failure_code").alias("failure_code"), "source_type", "content_hash"
    )


@query(
    "batch_duplicates",
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY batch_id, external_id ORDER BY position) > 1 AS BIGINT) AS is_duplicate FROM v_inbox",
)
def batch_duplicates(t: Load) -> DataFrame:
    marked = validate.mark_duplicates(t("v_inbox"), ["batch_id", "external_id"], "position")
    return marked.select("doc_id", flag("is_duplicate").alias("is_duplicate"))


@query(
    "question_admission",
    """SELECT question_id, CASE WHEN length(repeat(question, 1 + conv_id % 90)) > 4096 THEN 'query_too_long'
      WHEN conv_id % 30 > 20 THEN 'top_k_too_large' ELSE '' END AS reject_reason FROM v_questions""",
)
def question_admission(t: Load) -> DataFrame:
    from caseloom.functions.questions import admit

    asked = t("v_questions").withColumns(
        {"question": F.expr("repeat(question, cast(1 + conv_id % 90 as int))"), "top_k": F.col("conv_id") % 30}
    )
    return admit(asked).select("question_id", text("reject_reason").alias("reject_reason"))


@query(
    "sync_reference_checks",
    """SELECT r.request_id, CASE WHEN s.sync_id IS NULL OR s.source_id <> r.source_id THEN 'sync_not_found_for_source'
        WHEN r.collector_id IS NOT NULL AND (c.project_id IS NULL OR c.project_id <> r.project_id) THEN 'collector_not_found_for_project'
        WHEN r.collector_id IS NOT NULL AND s.collector_id IS NOT NULL AND r.collector_id <> s.collector_id THEN 'collector_does_not_match_sync' ELSE '' END AS error
    FROM (SELECT sync_id AS request_id, sync_id + sync_id % 2 AS sync_id, CASE WHEN sync_id % 3 = 0 THEN 's0' ELSE source_id END AS source_id,
        CASE WHEN sync_id % 7 = 0 THEN NULL ELSE collector_id + sync_id % 4 END AS collector_id, 'p' || (collector_id % 5) AS project_id FROM v_syncs) r
    LEFT JOIN v_syncs s ON s.sync_id = r.sync_id
    LEFT JOIN (SELECT s_suppkey AS collector_id, 'p' || (s_suppkey % 5) AS project_id FROM supplier) c ON c.collector_id = r.collector_id""",
)
def sync_reference_checks(t: Load) -> DataFrame:
    syncs = t("v_syncs")
    requests = syncs.select(
        F.col("sync_id").alias("request_id"), (F.col("sync_id") + F.col("sync_id") % 2).alias("sync_id"),
        F.when(F.col("sync_id") % 3 == 0, "s0").otherwise(F.col("source_id")).alias("source_id"),
        F.when(F.col("sync_id") % 7 != 0, F.col("collector_id") + F.col("sync_id") % 4).alias("collector_id"),
        F.concat(F.lit("p"), F.col("collector_id") % 5).alias("project_id"),
    )
    collectors = t("supplier").select(
        F.col("s_suppkey").alias("collector_id"), F.concat(F.lit("p"), F.col("s_suppkey") % 5).alias("project_id")
    )
    return validate.check_sync_references(requests, syncs, collectors).select(
        "request_id", text("reference_error").alias("error")
    )


@query(
    "payload_size_guard",
    """SELECT doc_id, CAST(strlen('{"branch":"' || branch || '","path":"' || path || '"}') > 8000 AS BIGINT) AS too_large FROM v_inbox""",
)
def payload_size_guard(t: Load) -> DataFrame:
    return t("v_inbox").select(
        "doc_id", flag(validate.payload_too_large(F.struct("branch", "path"), 8000)).alias("too_large")
    )


# --- chunkers ---------------------------------------------------------------


@query(
    "token_windows",
    f"""SELECT doc_id, i - 1 AS part, {sx.word_count('ws[i]')} AS words, md5(ws[i]) AS digest
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, {sx.windows('content')} AS ws FROM v_docs))""",
)
def token_windows(t: Load) -> DataFrame:
    pieces = t("v_docs").select("doc_id", F.posexplode(chunkers.window_texts("content")).alias("part", "piece"))
    return pieces.select("doc_id", big("part").alias("part"), big(tx.word_count("piece")).alias("words"), F.md5("piece").alias("digest"))


def _docs(frame: DataFrame, key: str = "doc_id") -> DataFrame:
    """The chunker input columns, with the key as document id."""
    with_service = frame if "service_name" in frame.columns else frame.withColumn("service_name", F.lit(None).cast("string"))
    return with_service.withColumn("document_id", F.col(key))


def _section_rows(view: str, heading: str) -> str:
    """Sections of every document, as lines grouped by a running heading count."""
    return rf"""SELECT *, {sx.strip("raw")} AS text, CASE WHEN regexp_matches(first, '{heading}') THEN {sx.strip(f"regexp_extract(first, '{heading}', 1)")} END AS title
      FROM (SELECT doc_id, min(i) AS a, max(i) AS b, arg_min(line, i) AS first, string_agg(line, chr(10) ORDER BY i) AS raw
        FROM (SELECT doc_id, i, line, sum(CASE WHEN regexp_matches(line, '{heading}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec
          FROM (SELECT doc_id, ls[i] AS line, i FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(content, chr(10)) AS ls FROM {view}))))
        GROUP BY doc_id, sec) WHERE {sx.strip("raw")} <> ''"""


_TITLE = "lower(coalesce(title, ''))"


@query(
    "markdown_sections",
    rf"""SELECT doc_id, a AS start_line, b AS end_line, coalesce(title, '') AS title, md5(text) AS digest,
      CASE WHEN regexp_matches(text, '(?m)^\s*\|.+\|\s*$\n^\s*\|\s*:?-{{3,}}') THEN 'markdown_table'
        WHEN {sx.any_of(_TITLE, ('procedure', 'runbook', 'how to', 'steps', 'playbook'))} OR regexp_matches(text, '(?m)^\s*\d+[.)]\s+') THEN 'markdown_procedure'
        WHEN {sx.any_of(_TITLE, ('faq', 'questions', 'q&a'))} THEN 'markdown_faq' ELSE 'markdown_heading_section' END AS chunk_type
    FROM ({_section_rows('v_md_docs', r'^#{1,6}\s+(.+)$')})""",
)
def markdown_sections(t: Load) -> DataFrame:
    c = chunkers.emit(_docs(t("v_md_docs")), chunkers.markdown())
    return c.select(
        F.col("document_id").alias("doc_id"), big("start_line").alias("start_line"), big("end_line").alias("end_line"),
        text("section_title").alias("title"), F.md5("text").alias("digest"), "chunk_type",
    )


@query(
    "incident_sections",
    rf"""SELECT r.doc_id, a AS start_line, b AS end_line, coalesce(title, 'Preamble') AS title, md5(text) AS digest,
      CASE WHEN contains({_TITLE}, 'cause') THEN 'incident_root_cause' WHEN contains({_TITLE}, 'timeline') THEN 'incident_timeline'
        WHEN {sx.any_of(_TITLE, ('fix', 'mitigation', 'action', 'lessons'))} THEN 'incident_action'
        WHEN {sx.any_of(_TITLE, ('summary', 'symptom', 'impact', 'severity', 'overview'))} THEN 'incident_symptom' ELSE 'incident_section' END AS chunk_type,
      coalesce(CASE WHEN h NOT IN ('incident', 'postmortem') THEN h END, s, CASE WHEN p NOT IN ('incident', 'postmortem') THEN p END, '') AS service
    FROM ({_section_rows('v_incident_docs', r'^#{1,3}\s+(.+)$')}) r JOIN (SELECT doc_id,
      lower(nullif(regexp_extract(content, '(?m)^#\s+([A-Za-z][A-Za-z0-9_-]{{2,40}})', 1), '')) AS h,
      lower(nullif(regexp_extract(content, '(?i)\bservice[:\s-]+([a-z][a-z0-9_-]{{2,40}})\b', 1), '')) AS s, {sx.service('path')} AS p FROM v_incident_docs) o ON o.doc_id = r.doc_id""",
)
def incident_sections(t: Load) -> DataFrame:
    c = chunkers.emit(_docs(t("v_incident_docs")), chunkers.incident())
    return c.select(
        F.col("document_id").alias("doc_id"), big("start_line").alias("start_line"), big("end_line").alias("end_line"),
        text("section_title").alias("title"), F.md5("text").alias("digest"), "chunk_type", text("service_name").alias("service"),
    )


_LOG_LINES = r"""SELECT part AS doc_id, project_id, service, line, deploy_hash, ln, n, CAST(substr(line, 1, 19) AS TIMESTAMP) AS tm, event_type, event_id,
      regexp_matches(line, '^\S+\s+(ERROR|FATAL|CRITICAL)\s') OR regexp_matches(line, '(?i)\b(error|fatal|exception|panic|stack trace)\b') AS bad
    FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY event_id) AS ln, count(*) OVER (PARTITION BY part) AS n FROM v_log_lines)"""
_LOG_GROUP = """min(ln) AS start_line, max(ln) AS end_line, strftime(min(tm), '%Y-%m-%d %H:%M:%S') AS ts_start, strftime(max(tm), '%Y-%m-%d %H:%M:%S') AS ts_end,
      CASE WHEN count(DISTINCT event_type) = 1 THEN '/v1/' || min(event_type) ELSE '' END AS endpoint, min(deploy_hash) AS deploy_hash,
      string_agg(DISTINCT CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END, ',' ORDER BY CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END) AS levels,
      count(DISTINCT event_id) AS traces, md5(string_agg(line, chr(10) ORDER BY ln)) AS digest"""
LOG_CHUNKS_SQL = f"""
    SELECT doc_id, 'log_time_window' AS chunk_type, min(service) AS service, {_LOG_GROUP}, 0 AS error_lines, 0 AS close_line,
      {sx.tokens("string_agg(line, chr(10) ORDER BY ln)")} AS tokens FROM ({_LOG_LINES}) GROUP BY doc_id, (ln - 1) // 30
    UNION ALL
    SELECT doc_id, 'log_error_burst', min(service), {_LOG_GROUP}, min(errors), min(close_line), {sx.tokens("string_agg(line, chr(10) ORDER BY ln)")}
    FROM (SELECT l.*, b.s, b.errors, b.close_line FROM ({_LOG_LINES}) l JOIN (
        SELECT doc_id, min(ln) AS s, count(*) AS errors, least(max(ln) + 1, min(n)) AS close_line FROM (
          SELECT *, ln - row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS island FROM ({_LOG_LINES}) WHERE bad)
        GROUP BY doc_id, island HAVING count(*) >= 2) b
      ON b.doc_id = l.doc_id AND l.ln BETWEEN b.s AND least(b.close_line, b.s + 23)) GROUP BY doc_id, s"""


@query("log_windows_and_bursts", f"SELECT * EXCLUDE (tokens, service) FROM ({LOG_CHUNKS_SQL})")
def log_windows_and_bursts(t: Load) -> DataFrame:
    c = chunkers.emit(_docs(t("v_log_docs")), chunkers.logs())
    number = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)).cast("bigint"), F.lit(0).cast("bigint"))
    listed = lambda k: F.try_element_at("metadata_lists", F.lit(k))
    return c.select(
        F.col("document_id").alias("doc_id"), "chunk_type", big("start_line").alias("start_line"), big("end_line").alias("end_line"),
        stamp("timestamp_start").alias("ts_start"), stamp("timestamp_end").alias("ts_end"), text("endpoint").alias("endpoint"),
        text("deploy_hash").alias("deploy_hash"), joined(listed("levels")).alias("levels"),
        big(F.coalesce(F.size(listed("trace_ids")), F.lit(0))).alias("traces"), F.md5("text").alias("digest"),
        number("error_line_count").alias("error_lines"), number("cluster_end_line").alias("close_line"),
    )


@query(
    "deploy_history_entries",
    """SELECT deploy_id, CASE WHEN deploy_id % 5 = 2 THEN commit_sha ELSE deploy_hash END AS deploy_hash, service,
      strftime(deployed_at, '%Y-%m-%d %H:%M:%S') AS deployed_at,
      'Deploy: ' || CASE WHEN deploy_id % 5 = 2 THEN commit_sha ELSE deploy_hash END || chr(10) || 'Service: ' || service || chr(10) || 'Author: ' || author || chr(10)
        || 'Deployed at: ' || deployed_text || chr(10) || 'Commit: ' || CASE WHEN deploy_id % 5 = 2 THEN 'unknown' ELSE commit_sha END || chr(10)
        || 'Summary: ' || summary || chr(10) || 'Changed files: ' || file_a || ', ' || file_b AS text
    FROM v_deploys WHERE deploy_id % 5 IN (0, 1, 2)""",
)
def deploy_history_entries(t: Load) -> DataFrame:
    c = chunkers.emit(_docs(t("v_deploy_docs"), "deploy_id"), chunkers.deploy_history())
    return c.select(
        F.col("document_id").alias("deploy_id"), "deploy_hash", F.col("service_name").alias("service"),
        stamp("timestamp_start").alias("deployed_at"), "text",
    )


@query(
    "patch_sections",
    """SELECT doc_id, part, 'diff: ' || f AS title, deploy_hash, service, lines AS end_line, is_new FROM (
      SELECT doc_id, 0 AS part, 'services/svc' || (doc_id % 13) || '/h.py' AS f, deploy_hash, 'svc' || (doc_id % 13) AS service, 4 AS lines, 'false' AS is_new FROM v_patch_docs
      UNION ALL SELECT doc_id, 1, 'docs/b' || doc_id || '.md', deploy_hash, coalesce(CASE WHEN length('b' || doc_id) >= 3 THEN 'b' || doc_id END, ''), 4, 'true' FROM v_patch_docs)""",
)
def patch_sections(t: Load) -> DataFrame:
    c = chunkers.emit(_docs(t("v_patch_docs")), chunkers.patch())
    return c.select(
        F.col("document_id").alias("doc_id"), big("ordinal").alias("part"), F.col("section_title").alias("title"), "deploy_hash",
        text("service_name").alias("service"), big("end_line").alias("end_line"),
        F.try_element_at("metadata", F.lit("is_new_file")).alias("is_new"),
    )


_CODE_SQL = """
  SELECT doc_id, t.* FROM v_code_docs, (SELECT unnest(CASE kind
    WHEN 0 THEN [{{'a': 1, 'b': 4, 't': 'go_module', 's': 'module preamble'}}, {{'a': 5, 'b': 8, 't': 'go_struct', 's': 'struct E' || doc_id}},
      {{'a': 9, 'b': 11, 't': 'go_method', 's': 'method M' || doc_id}}, {{'a': 12, 'b': 12, 't': 'go_function', 's': 'function New_' || symbol}}]
    WHEN 1 THEN [{{'a': 1, 'b': 2, 't': 'proto_preamble', 's': 'module preamble'}}, {{'a': 3, 'b': 3, 't': 'proto_service', 's': 'service S' || doc_id}},
      {{'a': 4, 'b': 5, 't': 'proto_rpc', 's': 'rpc Get' || doc_id}}, {{'a': 6, 'b': 6, 't': 'proto_message', 's': 'message A' || doc_id}}, {{'a': 7, 'b': 8, 't': 'proto_enum', 's': 'enum K'}}]
    WHEN 2 THEN [{{'a': 1, 'b': 1, 't': 'ts_module', 's': 'module preamble'}}, {{'a': 2, 'b': 4, 't': 'ts_interface', 's': 'interface P' || doc_id}},
      {{'a': 5, 'b': 6, 't': 'ts_function', 's': 'function load_' || symbol}}, {{'a': 7, 'b': 7, 't': 'ts_function', 's': 'function go' || doc_id}}]
    WHEN 3 THEN [{{'a': 1, 'b': 1, 't': 'java_package', 's': 'module preamble'}}, {{'a': 2, 'b': 2, 't': 'java_class', 's': 'class Part' || doc_id}},
      {{'a': 3, 'b': 5, 't': 'java_method', 's': 'function run' || doc_id}}]
    WHEN 4 THEN [{{'a': 1, 'b': 2, 't': 'python_module', 's': 'module preamble'}}, {{'a': 3, 'b': 4, 't': 'python_function', 's': 'def handle_' || symbol || '_' || doc_id}},
      {{'a': 7, 'b': 9, 't': 'python_class', 's': 'class Entity' || doc_id}}] ELSE [] END) AS c) t"""


_CONFIG_TYPES = ("openapi_endpoint", "openapi_schema", "config_service_block", "env_var_block", "config_section")


@query(
    "code_declarations",
    "SELECT doc_id, c.a AS start_line, c.b AS end_line, c.t AS chunk_type, c.s AS title, array_to_string(list_slice(string_split(content, chr(10)), c.a, c.b), chr(10)) AS raw FROM ("
    + _CODE_SQL.format().replace("SELECT doc_id, t.*", "SELECT doc_id, content, t.*").replace("{{", "{").replace("}}", "}") + ")",
)
def code_declarations(t: Load) -> DataFrame:
    docs = _docs(t("v_code_docs")).withColumn("parser", chunkers.parser_name("path", "source_type"))
    c = chunkers.emit(spread(docs), chunkers.dispatched()).where(~F.col("chunk_type").isin(*_CONFIG_TYPES))
    lines = docs.select("document_id", F.split("content", "\n").alias("ls"))
    return c.join(lines, "document_id").select(
        F.col("document_id").alias("doc_id"), big("start_line").alias("start_line"), big("end_line").alias("end_line"), "chunk_type",
        F.col("section_title").alias("title"),
        F.array_join(F.slice("ls", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("raw"),
    )


@query(
    "code_declarations_quoted",
    "SELECT doc_id, CASE WHEN c.a = 1 THEN 1 ELSE c.a + shift END AS start_line, c.b + shift AS end_line, c.t AS chunk_type, c.s AS title FROM ("
    + _CODE_SQL.format().replace("SELECT doc_id, t.*", "SELECT doc_id, length(content) - length(replace(content, chr(10), '')) + 2 AS shift, t.*").replace("{{", "{").replace("}}", "}") + ")",
)
def code_declarations_quoted(t: Load) -> DataFrame:
    """Files that first hold their own text as a comment or string: nothing in it is declared."""
    opened = F.when(F.col("kind") == 4, 'DOC = """\n').otherwise("/*\n")
    closed = F.when(F.col("kind") == 4, '"""\n').otherwise("*/\n")
    files = t("v_code_docs").where("kind < 5").withColumn("content", F.concat(opened, "content", closed, "content"))
    docs = spread(_docs(files)).withColumn("parser", chunkers.parser_name("path", "source_type"))
    c = chunkers.emit(docs, chunkers.dispatched())
    return c.select(
        F.col("document_id").alias("doc_id"), big("start_line").alias("start_line"), big("end_line").alias("end_line"), "chunk_type",
        F.col("section_title").alias("title"),
    )


@query(
    "structured_config_blocks",
    """SELECT doc_id, c.t AS chunk_type, c.s AS title, c.e AS endpoint FROM (SELECT doc_id, unnest(CASE kind
      WHEN 5 THEN [{'t': 'openapi_endpoint', 's': 'GET, POST /v1/parts/' || doc_id, 'e': 'GET, POST /v1/parts/' || doc_id}, {'t': 'openapi_endpoint', 's': '/v1/health', 'e': '/v1/health'},
        {'t': 'openapi_schema', 's': 'schema Part' || doc_id, 'e': ''}]
      WHEN 6 THEN [{'t': 'config_service_block', 's': 'config service', 'e': ''}, {'t': 'env_var_block', 's': 'config env', 'e': ''},
        {'t': 'config_section', 's': 'config password_file', 'e': ''}, {'t': 'config_section', 's': 'config zone', 'e': ''}] ELSE [] END) AS c FROM v_code_docs)""",
)
def structured_config_blocks(t: Load) -> DataFrame:
    c = chunkers.emit(spread(_docs(t("v_code_docs"))), chunkers.structured()).where(F.col("chunk_type").isin(*_CONFIG_TYPES))
    return c.select(
        F.col("document_id").alias("doc_id"), "chunk_type", F.col("section_title").alias("title"), text("endpoint").alias("endpoint")
    )


@query(
    "generic_code_files",
    r"""SELECT doc_id, 'code_file' AS chunk_type, regexp_extract(path, '[^/]*$') AS title,
      len(regexp_split_to_array(regexp_replace(content, '\n\z', ''), '\n')) AS end_line, strlen(content) AS bytes FROM v_code_docs""",
)
def generic_code_files(t: Load) -> DataFrame:
    c = chunkers.emit(spread(_docs(t("v_code_docs"))), chunkers.generic_code())
    return c.select(
        F.col("document_id").alias("doc_id"), "chunk_type", F.col("section_title").alias("title"), big("end_line").alias("end_line"),
        big(F.octet_length("text")).alias("bytes"),
    )


@query("bounded_fallback_chunks")
def bounded_fallback_chunks(t: Load) -> DataFrame:
    """Greedy packing is sequential; checked against a plain loop in the tests."""
    from dataclasses import replace

    tight = replace(DEFAULTS, max_chunk_tokens=120, max_chunks_per_document=20)
    docs = _docs(t("v_docs").withColumn("source_type", paths.canonical_source_type("declared_type", "path")))
    c = chunkers.emit(docs, chunkers.bounded_fallback(tight))
    return c.select(F.col("document_id").alias("doc_id"), "chunk_type", "start_line", "end_line", F.md5("text").alias("digest"))


@query(
    "chunking_hints",
    r"""SELECT doc_id, kind, a AS start_line, CASE WHEN kind = 'document' THEN n ELSE greatest(coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a) - 1, n), a) END AS end_line FROM (
      SELECT doc_id, hint AS kind, n, i AS a FROM (SELECT doc_id, hint, pattern, len(ls) AS n, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
        SELECT doc_id, regexp_split_to_array(regexp_replace(content, '\n\z', ''), '\n') AS ls,
          CASE kind WHEN 0 THEN 'go_symbol' WHEN 1 THEN 'proto_symbol' END AS hint,
          CASE kind WHEN 0 THEN '^\s*(?:func\s+(?:\([^)]*\)\s*)?[\p{L}\p{N}_]+\s*\(|type\s+[\p{L}\p{N}_]+\s+(?:struct|interface))'
            WHEN 1 THEN '^\s*(?:service|rpc|message|enum)\s+([A-Za-z_][\p{L}\p{N}_]*)' END AS pattern FROM v_code_docs WHERE kind < 2)) WHERE regexp_matches(ls[i], pattern)
      UNION ALL SELECT doc_id, 'document', len(regexp_split_to_array(regexp_replace(content, '\n\z', ''), '\n')), 1 FROM v_code_docs WHERE kind >= 2)""",
)
def chunking_hints(t: Load) -> DataFrame:
    h = chunkers.chunking_hints(spread(_docs(t("v_code_docs"))))
    return h.select(
        F.col("document_id").alias("doc_id"), F.col("type").alias("kind"), big("start_line").alias("start_line"), big("end_line").alias("end_line")
    )


_S, _K = f"({sx.suffix('path')})", "k"


@query(
    "parser_dispatch",
    f"""SELECT doc_id, coalesce(CASE WHEN k = 'logs' OR {_S} = '.log' THEN 'logs' WHEN {_S} IN ('.patch', '.diff') THEN 'patch'
      WHEN {_S} = '.json' AND (k = 'deploy' OR {sx.any_of('lower(path)', vocab.DEPLOY_TOKENS)}) THEN 'deploy_history'
      WHEN k = 'incident' OR {sx.any_of('lower(path)', ('incident', 'postmortem'))} THEN 'incident' WHEN {_S} = '.py' THEN 'python' WHEN {_S} = '.go' THEN 'go'
      WHEN {_S} IN ('.js', '.ts', '.jsx', '.tsx') THEN 'script' WHEN {_S} = '.java' THEN 'java' WHEN {_S} = '.proto' THEN 'proto' WHEN k = 'code' THEN 'generic_code'
      WHEN {_S} IN ('.yaml', '.yml', '.toml', '.ini') THEN 'structured' WHEN {_S} = '.json' AND k IN ('config', 'api_doc') THEN 'structured'
      WHEN {_S} IN ('.md', '.txt', '.json') THEN 'markdown' WHEN k IN ('config', 'unknown_text', 'runbook', 'api_doc') THEN 'markdown' END, '') AS parser
    FROM (SELECT *, {sx.canonical('declared_type', 'path')} AS k FROM v_docs)""",
)
def parser_dispatch(t: Load) -> DataFrame:
    docs = t("v_docs").withColumn("k", paths.canonical_source_type("declared_type", "path"))
    return docs.select("doc_id", text(chunkers.parser_name("path", "k")).alias("parser"))


def _log_corpus(t: Load) -> DataFrame:
    return t("v_log_docs").select(
        "doc_id", "project_id", F.lit("logs").alias("source_id"), F.col("path").alias("external_id"), "path",
        F.lit("logs").alias("source_type"), "content", tx.content_hash("content").alias("content_hash"),
        F.create_map(F.lit("branch"), F.lit("main"), F.lit("title"), F.lit("")).alias("metadata"),
    )


@query(
    "final_chunk_rows",
    f"SELECT 'services/' || service || '/logs/app-' || doc_id || '.log' AS path, chunk_type, service, start_line, deploy_hash, endpoint, tokens, digest, 'main' AS branch FROM ({LOG_CHUNKS_SQL})",
)
def final_chunk_rows(t: Load) -> DataFrame:
    rows = store.final_chunks(_log_corpus(t))
    return rows.select(
        "path", "chunk_type", F.col("service_name").alias("service"), big("start_line").alias("start_line"), text("deploy_hash").alias("deploy_hash"),
        text("endpoint").alias("endpoint"), big("token_count").alias("tokens"), F.md5("text").alias("digest"),
        F.try_element_at("metadata", F.lit("branch")).alias("branch"),
    )


@query("corpus_ingest")
def corpus_ingest(t: Load) -> DataFrame:
    """The whole ingest of a mixed, partly broken inbox, as status counts per parser outcome."""
    current = t("v_docs").select(
        "project_id", "source_id", F.col("path").alias("external_id"),
        F.when(F.col("doc_id") % 3 == 0, F.col("content_hash")).otherwise("old").alias("content_hash"),
    ).where("content_hash <> 'old'")
    result = ingest.ingest_documents(inbox(t), current)
    return result.statuses.groupBy("project_id", "status", "source_type").agg(
        F.count("*").alias("documents"), F.sum("chunks").alias("chunks")
    )


@query(
    "collected_facts_in_chunks",
    f"SELECT id, symbols, python_functions AS functions FROM ({facts_sql('v_code_docs', 'c')})",
)
def collected_facts_in_chunks(t: Load) -> DataFrame:
    """Files collected, ingested and chunked: what every chunk of a file carries of its facts."""
    listed_files = t("v_code_docs").select(
        F.concat(F.lit("c"), "doc_id").alias("source_id"), "project_id", F.lit("s1").alias("sync_id"), F.lit("b1").alias("batch_id"),
        F.col("doc_id").alias("position"), "path", "content", F.lit(None).cast("string").alias("skip_reason"), F.lit(None).cast("timestamp").alias("modified_at"),
    )
    none = t("v_docs").select("project_id", "source_id", F.col("path").alias("external_id"), "content_hash").limit(0)
    # Written, since what selects files by their text would else be worked out before they are spread.
    chunks = ingest.ingest_documents(files.collected_documents(cut_lineage(spread(listed_files))), none).chunks
    listed = lambda k: joined(F.try_element_at("metadata_lists", F.lit(k)))
    functions = F.when(F.try_element_at("metadata", F.lit("language")) == "python", listed("function_names")).otherwise("")
    return chunks.select(
        F.col("source_id").alias("id"), listed("symbol_names").alias("symbols"), functions.alias("functions")
    ).distinct()


@query(
    "ingest_quarantine",
    f"""SELECT failure_code, count(*) AS n FROM (
      SELECT {sx.failure_code('error')} AS failure_code FROM (SELECT {ERROR_SQL} AS error FROM v_inbox) WHERE error IS NOT NULL
      UNION ALL SELECT 'metadata_invalid' FROM (SELECT row_number() OVER (PARTITION BY project_id, source_id, batch_id, trim(external_id) ORDER BY position) AS rn
        FROM (SELECT *, {ERROR_SQL} AS error FROM v_inbox) WHERE error IS NULL) WHERE rn > 1) GROUP BY failure_code""",
)
def ingest_quarantine(t: Load) -> DataFrame:
    tagged = validate.validate_documents(inbox(t))
    accepted, rejected = validate.split_valid(tagged)
    marked = validate.mark_duplicates(accepted, ["project_id", "source_id", "batch_id", "external_id"], "position")
    copies = marked.where("is_duplicate").select(tx.failure_code(F.lit("duplicate_external_id")).alias("failure_code"))
    return rejected.select("failure_code").unionByName(copies).groupBy("failure_code").agg(F.count("*").alias("n"))


# --- state tables -----------------------------------------------------------

_KEYED = ("project_id", "source_id", "path", "content_hash")


def _keyed(frame: DataFrame) -> DataFrame:
    return frame.select("doc_id", "project_id", "source_id", F.col("path").alias("external_id"), "content_hash")


# Several documents may share a README path, so the state keeps one per path.
_LATEST = "(SELECT project_id, source_id, path, max(content_hash) AS content_hash FROM v_docs GROUP BY ALL)"
_LATEST_NEXT = "(SELECT project_id, source_id, path, max(content_hash) AS content_hash FROM v_docs_next GROUP BY ALL)"


def _one_per_path(frame: DataFrame) -> DataFrame:
    return frame.groupBy("project_id", "source_id", F.col("path").alias("external_id")).agg(F.max("content_hash").alias("content_hash"))


@query(
    "document_change_status",
    f"""SELECT n.project_id, n.source_id, n.path AS external_id, CASE WHEN c.content_hash IS NULL THEN 'created' WHEN c.content_hash = n.content_hash THEN 'unchanged' ELSE 'updated' END AS status
    FROM {_LATEST_NEXT} n LEFT JOIN {_LATEST} c USING (project_id, source_id, path)""",
)
def document_change_status(t: Load) -> DataFrame:
    return store.change_status(_one_per_path(t("v_docs_next")), _one_per_path(t("v_docs"))).drop("content_hash")


@query(
    "document_state_upsert",
    f"""SELECT project_id, source_id, path AS external_id, content_hash FROM {_LATEST_NEXT}
    UNION ALL SELECT project_id, source_id, path, content_hash FROM {_LATEST} c WHERE NOT EXISTS (SELECT 1 FROM {_LATEST_NEXT} n WHERE n.project_id = c.project_id AND n.source_id = c.source_id AND n.path = c.path)""",
)
def document_state_upsert(t: Load) -> DataFrame:
    current, incoming = _one_per_path(t("v_docs")), _one_per_path(t("v_docs_next"))
    changed = store.change_status(incoming, current).where(F.col("status") != "unchanged").drop("status")
    return store.replace_rows(current, changed, changed, store.KEY)


@query(
    "versioned_document_state",
    f"""SELECT project_id, source_id, external_id, content_hash FROM (SELECT project_id, source_id, path AS external_id, content_hash FROM {_LATEST_NEXT}
    UNION ALL SELECT project_id, source_id, path, content_hash FROM {_LATEST} c WHERE NOT EXISTS (SELECT 1 FROM {_LATEST_NEXT} n WHERE n.project_id = c.project_id AND n.source_id = c.source_id AND n.path = c.path))
    WHERE NOT (project_id = 'p0' AND source_id = (SELECT min(source_id) FROM v_docs))""",
)
def versioned_document_state(t: Load) -> DataFrame:
    """Two batches ingested, one of them twice, a source purged and all batches compacted: the documents that are left with their chunks."""
    spark = t("v_docs").sparkSession
    root = f"{checkpoint_root(spark)}/state-{uuid.uuid4().hex}"

    def batch(frame: DataFrame, name: str) -> DataFrame:
        none = F.lit(None).cast("string")
        return _one_per_path(frame).select(
            "project_id", "source_id", none.alias("sync_id"), F.lit(name).alias("batch_id"), F.lit(1).cast("bigint").alias("position"), "external_id",
            F.concat("external_id", F.lit(".md")).alias("path"), F.lit("").alias("source_type"), F.concat(F.lit("# Notes\n\nbody "), "content_hash").alias("content"), "content_hash",
            F.expr("cast(map() as map<string, string>)").alias("metadata"), F.lit(None).cast("bigint").alias("size_bytes"), F.lit(None).cast("timestamp").alias("modified_at"),
        )

    for frame, name in (("v_docs", "first"), ("v_docs_next", "second"), ("v_docs", "first")):
        state.apply_batch(batch(t(frame), name), root, name)
    doomed = t("v_docs").agg(F.min("source_id")).first()[0]
    state.purge_source(spark, root, "p0", doomed)
    state.compact(spark, root)
    now = state.snapshot(spark, root)
    chunked = state.current_chunks(spark, now).select(*store.KEY).distinct()
    return state.current_documents(spark, now).join(chunked, store.KEY, "left_semi").select("project_id", "source_id", "external_id", "content_hash")


@query(
    "batch_ingest_counters",
    f"""SELECT project_id, count(*) AS received, count(*) FILTER (status = 'created') AS created, count(*) FILTER (status = 'updated') AS updated,
      count(*) FILTER (status = 'unchanged') AS skipped_unchanged, CAST(sum(chunks) AS BIGINT) AS chunks_created FROM (
      SELECT n.project_id, CASE WHEN c.content_hash IS NULL THEN 'created' WHEN c.content_hash = n.content_hash THEN 'unchanged' ELSE 'updated' END AS status,
        CASE WHEN c.content_hash = n.content_hash THEN 0 ELSE length(n.path) % 5 END AS chunks
      FROM {_LATEST_NEXT} n LEFT JOIN {_LATEST} c USING (project_id, source_id, path)) GROUP BY project_id""",
)
def batch_ingest_counters(t: Load) -> DataFrame:
    tagged = store.change_status(_one_per_path(t("v_docs_next")), _one_per_path(t("v_docs"))).withColumn(
        "chunks", F.when(F.col("status") == "unchanged", 0).otherwise(F.length("external_id") % 5)
    )
    return store.batch_counters(tagged, ["project_id"]).drop("skipped_invalid")


@query(
    "counter_map_merge",
    """SELECT project_id, name, CAST(sum(n) AS BIGINT) AS n FROM (SELECT project_id, 'created' AS name, files_seen AS n FROM v_syncs
      UNION ALL SELECT project_id, 'errors', parser_errors FROM v_syncs UNION ALL SELECT project_id, status, 1 FROM v_syncs) GROUP BY ALL""",
)
def counter_map_merge(t: Load) -> DataFrame:
    cell = lambda name, n: F.struct(name.alias("name"), n.cast("bigint").alias("n"))
    long = t("v_syncs").select(
        "project_id",
        F.inline(
            F.array(
                cell(F.lit("created"), F.col("files_seen")), cell(F.lit("errors"), F.col("parser_errors")), cell(F.col("status"), F.lit(1))
            )
        ),
    )
    return store.merge_counters(long, ["project_id"])


@query(
    "source_purge_counts",
    """SELECT source_id, tab AS "table", n FROM (SELECT source_id, 'documents' AS tab, count(*) AS n FROM v_docs GROUP BY source_id
      UNION ALL SELECT source_id, 'chunks', CAST(sum(1 + n_chars // 2000) AS BIGINT) FROM v_docs GROUP BY source_id
      UNION ALL SELECT source_id, 'syncs', count(*) FROM v_syncs GROUP BY source_id) WHERE regexp_matches(source_id, '[37]$')""",
)
def source_purge_counts(t: Load) -> DataFrame:
    counts, _ = store.purge(_purge_tables(t), _doomed(t), "source_id")
    return counts


def _purge_tables(t: Load) -> dict[str, DataFrame]:
    docs = t("v_docs").select("source_id", "doc_id", "n_chars")
    chunks = docs.select("source_id", F.explode(F.expr("sequence(0L, n_chars div 2000)")).alias("i"))
    return {"documents": docs.select("source_id"), "chunks": chunks.select("source_id"), "syncs": t("v_syncs").select("source_id")}


def _doomed(t: Load) -> DataFrame:
    both = t("v_docs").select("source_id").unionByName(t("v_syncs").select("source_id"))
    return both.where(F.col("source_id").rlike("[37]$"))


@query(
    "source_purge_remaining",
    """SELECT tab AS "table", count(*) AS n FROM (SELECT 'documents' AS tab, source_id FROM v_docs UNION ALL SELECT 'syncs', source_id FROM v_syncs)
    WHERE NOT regexp_matches(source_id, '[37]$') GROUP BY tab""",
)
def source_purge_remaining(t: Load) -> DataFrame:
    _, rest = store.purge(_purge_tables(t), _doomed(t), "source_id")
    named = lambda n: rest[n].agg(F.count("*").alias("n")).withColumn("table", F.lit(n))
    return named("documents").unionByName(named("syncs"))


@query(
    "project_purge_counts",
    """SELECT project_id, tab AS "table", n FROM (SELECT project_id, 'syncs' AS tab, count(*) AS n FROM v_syncs GROUP BY ALL
      UNION ALL SELECT project_id, 'memberships', count(*) FROM v_members GROUP BY ALL
      UNION ALL SELECT project_id, 'index_jobs', count(DISTINCT job_id) FROM v_deliveries GROUP BY ALL
      UNION ALL SELECT project_id, 'operational_events', count(*) FROM v_deliveries GROUP BY ALL) WHERE regexp_matches(project_id, '^p1')""",
)
def project_purge_counts(t: Load) -> DataFrame:
    deliveries = t("v_deliveries")
    tables = {
        "syncs": t("v_syncs").select("project_id"), "memberships": t("v_members").select("project_id"),
        "index_jobs": deliveries.select("project_id", "job_id").distinct(), "operational_events": deliveries.select("project_id"),
    }
    known = [tables[n].select("project_id") for n in ("syncs", "memberships", "operational_events")]
    doomed = known[0].unionByName(known[1]).unionByName(known[2]).where(F.col("project_id").startswith("p1"))
    return store.purge(tables, doomed, "project_id")[0]


@query(
    "vector_delete_by_filter",
    "SELECT vec_id FROM embeddings WHERE NOT (label % 3 = 1 AND label = 4)",
)
def vector_delete_by_filter(t: Load) -> DataFrame:
    points = t("embeddings").select(
        "vec_id", F.concat(F.lit("p"), F.col("label") % 3).alias("project_id"), F.concat(F.lit("src"), "label").alias("source_id")
    )
    return vector.delete_points(points, project_id="p1", source_id="src4").select("vec_id")


@query(
    "vector_keyword_filter",
    "SELECT vec_id FROM embeddings WHERE label % 3 = 1 AND vec_id % 2 = 0 AND label = 4",
)
def vector_keyword_filter(t: Load) -> DataFrame:
    points = t("embeddings").select(
        "vec_id", F.concat(F.lit("p"), F.col("label") % 3).alias("project_id"), F.concat(F.lit("src"), "label").alias("source_id"),
        F.when(F.col("vec_id") % 2 == 0, "current").otherwise("old").alias("index_version"),
    )
    return vector.filter_points(points, "p1", source_id="src4", service_name=None).select("vec_id")


@query(
    "vector_dimension_guard",
    "SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN 'embedding_failed' ELSE '' END AS failure_code FROM embeddings",
)
def vector_dimension_guard(t: Load) -> DataFrame:
    cut = t("embeddings").withColumn(
        "vector", F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    )
    return embedding.dimension_guard(cut, 64).select("vec_id", text("failure_code").alias("failure_code"))


@query(
    "vector_point_payloads",
    """SELECT chunk_id AS id, project_id, source_type, chunk_type, path, language, symbol AS symbol_name, coalesce(service, '') AS service_name,
      coalesce(endpoint, '') AS endpoint, coalesce(deploy_hash, '') AS deploy_hash, 'current' AS index_version FROM v_facts""",
)
def vector_point_payloads(t: Load) -> DataFrame:
    from caseloom.plans.corpus import with_maps

    chunks = with_maps(t("v_facts")).withColumnRenamed("service", "service_name").withColumn("vector", F.array(F.lit(0.0)))
    points = vector.vector_points(chunks)
    return points.select(
        "id", "project_id", "source_type", "chunk_type", "path", "language", "symbol_name", "service_name", "endpoint", "deploy_hash", "index_version"
    )


@query(
    "collector_registration",
    """SELECT project_id, name, environment, arg_max(version, (ts, id)) AS version, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen_at
    FROM (SELECT 'p' || (o_custkey % 40) AS project_id, 'c' || (o_custkey % 7) AS name, o_orderpriority AS environment, 'v' || o_orderkey AS version, o_orderdate AS ts, o_orderkey AS id FROM orders) GROUP BY ALL""",
)
def collector_registration(t: Load) -> DataFrame:
    requests = t("orders").select(
        F.concat(F.lit("p"), F.col("o_custkey") % 40).alias("project_id"), F.concat(F.lit("c"), F.col("o_custkey") % 7).alias("name"),
        F.col("o_orderpriority").alias("environment"), F.concat(F.lit("v"), "o_orderkey").alias("version"), F.col("o_orderdate").alias("last_seen_at"),
        F.col("o_orderkey").alias("request_id"),
    )
    latest = store.latest_by(requests, ["project_id", "name", "environment"], "last_seen_at", "request_id")
    return latest.select("project_id", "name", "environment", "version", stamp("last_seen_at").alias("last_seen_at"))


@query(
    "source_reindex_counts",
    f"""SELECT source_id, chunk_type, count(*) AS chunks, count(DISTINCT doc_id) AS documents, CAST(sum(len(list_filter({sx.stems('ws[i]')}, lambda t: t <> ''))) AS BIGINT) AS positions FROM (
      SELECT source_id, chunk_type, doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT *, {sx.windows('content')} AS ws FROM v_prose)) GROUP BY ALL""",
)
def source_reindex_counts(t: Load) -> DataFrame:
    from caseloom.operators.lexical import positions

    pieces = t("v_prose").select("source_id", "chunk_type", "doc_id", F.explode(chunkers.window_texts("content")).alias("piece"))
    counted = pieces.withColumn("n", F.size(F.array_remove(positions("piece"), "")))
    return counted.groupBy("source_id", "chunk_type").agg(
        F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.sum("n").alias("positions")
    )


@query(
    "chunk_integrity",
    f"""SELECT source_id, CAST(sum(n) AS BIGINT) AS chunk_count, count(*) FILTER (n > 1) AS duplicate_groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows FROM (
      SELECT source_id, chunk_type, md5(ws[i]) AS d, count(*) AS n FROM (SELECT source_id, chunk_type, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT *, {sx.windows('content')} AS ws FROM v_prose)) GROUP BY ALL) GROUP BY source_id""",
)
def chunk_integrity(t: Load) -> DataFrame:
    pieces = t("v_prose").select(
        "source_id", "chunk_type", F.lit("d").alias("document_id"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
        F.explode(chunkers.window_texts("content")).alias("text"),
    )
    return store.integrity(pieces, ["source_id"])


@query(
    "resync_regression_report",
    f"""SELECT sync, status, count(*) AS n FROM (SELECT 'first' AS sync, 'created' AS status FROM {_LATEST} UNION ALL SELECT 'repeat', 'unchanged' FROM {_LATEST}
      UNION ALL SELECT 'changed', CASE WHEN c.content_hash IS NULL THEN 'created' WHEN c.content_hash = n.content_hash THEN 'unchanged' ELSE 'updated' END
        FROM {_LATEST_NEXT} n LEFT JOIN {_LATEST} c USING (project_id, source_id, path)) GROUP BY ALL""",
)
def resync_regression_report(t: Load) -> DataFrame:
    from caseloom.operators.evaluation import resync_report

    first, changed = _one_per_path(t("v_docs")), _one_per_path(t("v_docs_next"))
    nothing = first.where(F.lit(False))
    return resync_report(
        store.change_status(first, nothing), store.change_status(first, first), store.change_status(changed, first)
    )


@query(
    "run_event_sequences",
    "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sequence_no FROM conversations",
)
def run_event_sequences(t: Load) -> DataFrame:
    numbered = dense_sequence(t("conversations"), ["conv_id"], ["turn"], F.floor(F.col("turn") / 2))
    return numbered.select("conv_id", "turn", "sequence_no")


@query(
    "index_job_states",
    """WITH RECURSIVE d AS (SELECT job_id, outcome, code, current_version, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS k FROM v_deliveries),
    s AS (SELECT job_id, CAST(0 AS BIGINT) AS k, 'pending' AS status, 0 AS attempts, CAST(NULL AS VARCHAR) AS error FROM d WHERE k = 1
      UNION ALL SELECT s.job_id, s.k + 1,
        CASE WHEN s.status IN ('completed', 'stale', 'running') THEN s.status WHEN s.attempts >= 3 THEN 'failed' WHEN NOT d.current_version THEN 'stale'
          WHEN d.outcome = 'completed' THEN 'completed' WHEN d.outcome = 'failed' THEN 'failed' WHEN s.attempts + 1 < 3 THEN 'pending' ELSE 'failed' END,
        CASE WHEN s.status IN ('completed', 'stale', 'running') OR s.attempts >= 3 OR NOT d.current_version THEN s.attempts ELSE s.attempts + 1 END,
        CASE WHEN s.status IN ('completed', 'stale', 'running') THEN s.error WHEN s.attempts >= 3 THEN coalesce(s.error, 'retry_limit_exceeded')
          WHEN NOT d.current_version THEN 'index_version_changed' WHEN d.outcome = 'completed' THEN NULL ELSE d.code END
      FROM s JOIN d ON d.job_id = s.job_id AND d.k = s.k + 1)
    SELECT job_id, arg_max(status, k) AS status, CAST(arg_max(attempts, k) AS BIGINT) AS attempts, coalesce(max(error) FILTER (k = mk), '') AS error_code
    FROM (SELECT *, max(k) OVER (PARTITION BY job_id) AS mk FROM s) GROUP BY job_id""",
)
def index_job_states(t: Load) -> DataFrame:
    folded = jobs.fold_jobs(t("v_deliveries"))
    return folded.select("job_id", "status", big("attempts").alias("attempts"), text("error_code").alias("error_code"))


@query(
    "recoverable_index_jobs",
    """SELECT sync_id FROM (SELECT sync_id, started_at, parser_errors % 4 AS attempts, CASE status WHEN 'success' THEN 'pending' WHEN 'failed' THEN 'queued' ELSE 'completed' END AS st FROM v_syncs)
    WHERE attempts < 3 AND (st = 'pending' OR (st = 'queued' AND started_at < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 60 SECOND)) ORDER BY started_at, sync_id LIMIT 50""",
)
def recoverable_index_jobs(t: Load) -> DataFrame:
    queue = t("v_syncs").select(
        F.col("sync_id").alias("job_id"), F.col("started_at").alias("created_at"), F.col("started_at").alias("queued_at"),
        (F.col("parser_errors") % 4).alias("attempts"),
        F.expr("CASE status WHEN 'success' THEN 'pending' WHEN 'failed' THEN 'queued' ELSE 'completed' END").alias("status"),
    )
    return jobs.recoverable_jobs(queue, F.to_timestamp(F.lit("1998-06-01 00:00:00"))).select(F.col("job_id").alias("sync_id"))


@query(
    "sync_ledger_fold",
    """SELECT b.sync_id, received, errors, CASE WHEN f.status IS NULL THEN 'running' WHEN f.status = 'success' AND errors > 0 THEN 'partial_success' ELSE f.status END AS status FROM (
      SELECT l_orderkey AS sync_id, CAST(sum(l_quantity) AS BIGINT) AS received, CAST(sum(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM lineitem GROUP BY 1) b
    LEFT JOIN (SELECT sync_id, status FROM v_syncs) f ON f.sync_id = b.sync_id""",
)
def sync_ledger_fold(t: Load) -> DataFrame:
    batches = t("lineitem").select(
        F.col("l_orderkey").alias("sync_id"), F.col("l_shipdate").alias("ts"), F.col("l_linenumber").alias("batch_no"),
        F.col("l_quantity").cast("bigint").alias("received"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)).cast("bigint").alias("errors"),
    )
    finishes = t("v_syncs").select("sync_id", F.col("started_at").alias("ts"), "status")
    folded = jobs.fold_syncs(batches, finishes)
    return folded.select("sync_id", F.col("documents_received").alias("received"), F.col("parser_errors").alias("errors"), "status")


@query(
    "sync_close_out",
    """SELECT sync_id, e AS effective_errors, s AS effective_status, CASE WHEN s IN ('success', 'partial_success') AND pending > 0 THEN 'indexing'
      WHEN s IN ('success', 'partial_success') THEN 'ready' ELSE 'error' END AS source_status, CASE WHEN s IN ('failed', 'cancelled') THEN s ELSE '' END AS error_message FROM (
      SELECT sync_id, greatest(parser_errors, files_seen % 3, 0) AS e, sync_id % 4 AS pending,
        CASE WHEN status = 'success' AND (greatest(parser_errors, files_seen % 3, 0) > 0 OR sync_id % 11 = 0) THEN 'partial_success' ELSE status END AS s FROM v_syncs)""",
)
def sync_close_out(t: Load) -> DataFrame:
    open_syncs = t("v_syncs").select(
        "sync_id", F.col("status").alias("requested_status"), "parser_errors", (F.col("files_seen") % 3).alias("reported_parser_errors"),
        F.lit(0).cast("bigint").alias("parser_error_count"), (F.col("sync_id") % 11 == 0).cast("int").alias("error_count"),
        F.lit(None).cast("string").alias("reported_message"), (F.col("sync_id") % 4).alias("pending_jobs"),
    )
    closed = reports.close_syncs(open_syncs)
    return closed.select(
        "sync_id", big("effective_errors").alias("effective_errors"), "effective_status", "source_status", text("error_message").alias("error_message")
    )
