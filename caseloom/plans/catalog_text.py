"""Queries for the scalar functions: paths, texts, facts, questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import vocab
from caseloom.functions import facts, paths, questions, text as tx
from caseloom.operators import chunkers, fusion, investigation, store
from caseloom.plans import sqlexpr as sx

from caseloom.plans.registry import Load, big, flag, joined, query, text


@query(
    "path_classification",
    f"""SELECT doc_id, {sx.source_type('path')} AS source_type, {sx.doc_type('path')} AS doc_type,
      {sx.canonical('declared_type', 'path')} AS canonical_type,
      CASE WHEN {sx.any_of("lower(path)", vocab.DEPLOY_PATH_TOKENS)} THEN 'deploy'
        WHEN ({sx.source_type('path')}) = 'unknown' THEN 'unknown_text' ELSE ({sx.source_type('path')}) END AS collected_type,
      coalesce({sx.mapped(sx.suffix('path'), vocab.LANGUAGE_BY_SUFFIX)}, '') AS language
    FROM v_docs""",
)
def path_classification(t: Load) -> DataFrame:
    return t("v_docs").select(
        "doc_id", paths.source_type("path").alias("source_type"), paths.doc_type("path").alias("doc_type"),
        paths.canonical_source_type("declared_type", "path").alias("canonical_type"),
        paths.collected_source_type("path").alias("collected_type"), text(paths.language("path")).alias("language"),
    )


@query(
    "path_service_names",
    rf"""SELECT doc_id, coalesce({sx.service('path')}, '') AS service,
      regexp_extract(path, '(?i)(?:^|/)(?:services?|cmd)/([A-Za-z0-9_-]+)(?:/|$)', 1) AS owner
    FROM v_docs""",
)
def path_service_names(t: Load) -> DataFrame:
    return t("v_docs").select(
        "doc_id", text(paths.service_from_path("path")).alias("service"),
        text(paths.owner_from_path("path")).alias("owner"),
    )


@query(
    "path_safety",
    """SELECT doc_id, CAST(NOT (starts_with(external_id, '/') OR list_contains(string_split(external_id, '/'), '..')) AS BIGINT) AS id_safe,
      CAST(NOT (starts_with(path, '/') OR list_contains(string_split(path, '/'), '..')) AS BIGINT) AS path_safe
    FROM v_inbox""",
)
def path_safety(t: Load) -> DataFrame:
    return t("v_inbox").select(
        "doc_id", flag(paths.is_safe("external_id")).alias("id_safe"), flag(paths.is_safe("path")).alias("path_safe")
    )


@query(
    "text_deploy_hashes",
    f"""SELECT 'd' || doc_id AS id, coalesce({sx.deploy_hash('content')}, '') AS deploy_hash FROM v_docs
    UNION ALL SELECT 'l' || event_id, coalesce({sx.deploy_hash('line')}, '') FROM v_log_lines""",
)
def text_deploy_hashes(t: Load) -> DataFrame:
    of = lambda view, prefix, key, col: t(view).select(
        F.concat(F.lit(prefix), F.col(key)).alias("id"), text(tx.deploy_hash(col)).alias("deploy_hash")
    )
    return of("v_docs", "d", "doc_id", "content").unionByName(of("v_log_lines", "l", "event_id", "line"))


@query(
    "text_http_endpoints",
    r"""SELECT doc_id, len(e) AS n, array_to_string(list_sort(list_distinct(e)), ',') AS endpoints
    FROM (SELECT doc_id, regexp_extract_all(content, '(?:GET|POST|PUT|DELETE|PATCH)\s+(/\S+)', 1) AS e FROM v_log_docs)""",
)
def text_http_endpoints(t: Load) -> DataFrame:
    found = t("v_log_docs").select("doc_id", tx.http_endpoints("content").alias("e"))
    return found.select(
        "doc_id", big(F.size("e")).alias("n"), joined(F.array_sort(F.array_distinct("e"))).alias("endpoints")
    )


@query("text_token_counts", f"SELECT doc_id, {sx.word_count('content')} AS words, {sx.tokens('content')} AS tokens FROM v_docs")
def text_token_counts(t: Load) -> DataFrame:
    return t("v_docs").select(
        "doc_id", big(tx.word_count("content")).alias("words"), big(tx.token_count("content")).alias("tokens")
    )


@query(
    "failure_reason_histogram",
    f"""SELECT project_id, failure_code, count(*) AS n FROM (SELECT project_id, {sx.failure_code(
        "CASE seq % 6 WHEN 0 THEN ' Embedding_Error' WHEN 1 THEN 'unsafe_path' WHEN 2 THEN code WHEN 3 THEN 'index_error' "
        "WHEN 4 THEN 'Binary' ELSE 'something else' END")} AS failure_code FROM v_deliveries) GROUP BY ALL""",
)
def failure_reason_histogram(t: Load) -> DataFrame:
    from caseloom.operators.reports import failure_histogram

    raw = F.expr(
        "CASE seq % 6 WHEN 0 THEN ' Embedding_Error' WHEN 1 THEN 'unsafe_path' WHEN 2 THEN code "
        "WHEN 3 THEN 'index_error' WHEN 4 THEN 'Binary' ELSE 'something else' END"
    )
    return failure_histogram(t("v_deliveries").withColumn("error", raw), ["project_id"])


@query(
    "canonical_json_keys",
    f"""SELECT doc_id, strlen(j) AS bytes, substr(sha256('{{"request": {{"branch": "' || branch || '", "source": "' || source_id
        || '"}}, "run_type": "observer"}}'), 1, 48) AS idempotency_key
    FROM (SELECT doc_id, branch, source_id, '{{"a":"' || project_id || '","branch":"' || branch || '","source":"' || source_id || '"}}' AS j FROM v_inbox)""",
)
def canonical_json_keys(t: Load) -> DataFrame:
    docs = t("v_inbox")
    meta = F.create_map(
        F.lit("source"), F.col("source_id"), F.lit("a"), F.col("project_id"), F.lit("branch"), F.col("branch")
    )
    request = F.create_map(F.lit("source"), F.col("source_id"), F.lit("branch"), F.col("branch"))
    return docs.select(
        "doc_id", big(tx.json_bytes(meta)).alias("bytes"),
        tx.idempotency_key(F.lit("observer"), request).alias("idempotency_key"),
    )


@query(
    "binary_content_check",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(substr(content, 1, 4096), '[\x00-\x08\x0b\x0c\x0e-\x1f]'))
        / greatest(length(substr(content, 1, 4096)), 1) > 0.05 AS BIGINT) AS is_binary FROM v_inbox""",
)
def binary_content_check(t: Load) -> DataFrame:
    return t("v_inbox").select("doc_id", flag(tx.looks_binary("content")).alias("is_binary"))


@query(
    "content_hashes",
    """SELECT doc_id, CAST(regexp_matches(trim(content_hash), '^(?:sha256:)?[a-fA-F0-9]{64}$') AS BIGINT) AS valid,
      regexp_replace(lower(trim(content_hash)), '^sha256:', '') AS cleaned, sha256(content) AS computed FROM v_inbox""",
)
def content_hashes(t: Load) -> DataFrame:
    return t("v_inbox").select(
        "doc_id", flag(tx.valid_content_hash("content_hash")).alias("valid"),
        tx.clean_content_hash("content_hash").alias("cleaned"), tx.content_hash("content").alias("computed"),
    )


def facts_sql(view: str, prefix: str) -> str:
    s = lambda p, n=None, g=1: (
        f"array_to_string(list_sort(list_distinct(regexp_extract_all(content, '{p}', {g})))" + (f"[1:{n}]" if n else "") + ", ',')"
    )
    name = r"[A-Za-z_][\p{L}\p{N}_]*"
    sym = {
        "go": [rf"(?m)^\s*type\s+({name})\s+(?:struct|interface)", rf"(?m)^\s*func\s+(?:\([^)]*\)\s*)?({name})\s*\("],
        "proto": [rf"(?m)^\s*(?:service|rpc|message|enum)\s+({name})"],
        "python": [rf"(?m)^\s*(?:async\s+def|def|class)\s+({name})"],
        "typescript": [rf"(?m)^\s*(?:export\s+)?(?:async\s+)?(?:function|class|interface|type)\s+({name})"],
        "java": [
            rf"(?m)^\s*(?:(?:public|private|protected|abstract|final|static)\s+)*(?:class|interface|enum|record)\s+({name})",
            rf"(?m)^\s*(?:(?:public|private|protected|static|final|synchronized|abstract|native)\s+)+[A-Za-z_][\p{{L}}\p{{N}}_<>\[\], ?]*\s+({name})\s*\(",
        ],
    }
    symbols = "CASE language " + " ".join(
        f"WHEN '{k}' THEN array_to_string(list_sort(list_distinct("
        + ("list_concat(" if len(v) > 1 else "") + ", ".join(f"regexp_extract_all(content, '{p}', 1)" for p in v)
        + (")" if len(v) > 1 else "") + "))[1:100], ',')"
        for k, v in sym.items()
    ) + " ELSE '' END"
    package = (
        r"CASE language WHEN 'go' THEN regexp_extract(content, '(?m)^\s*package\s+([\p{L}\p{N}_]+)', 1) "
        r"WHEN 'java' THEN regexp_extract(content, '(?m)^\s*package\s+([A-Za-z_][\p{L}\p{N}_.]*)\s*;', 1) ELSE '' END"
    )
    ts = r"\b(\d{4}-\d{2}-\d{2}[T ][0-2]\d:[0-5]\d:[0-5]\d(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\b"
    http = r"\b(?:GET|POST|PUT|PATCH|DELETE)\s+(/[^\s]+)"
    api = r"(?m)^\s{0,4}(/[^\s:]+):\s*(?:#.*)?$"
    name_only = "lower(regexp_extract(path, '[^/]*$'))"
    marker = r"(?i)\b((?:release|version|changelog)\b[^\n]{0,120})"
    return f"""SELECT '{prefix}' || doc_id AS id, language, {symbols} AS symbols, {package} AS package,
      lower(regexp_extract(content, '(?i)(?:^|{sx.NOT_WORD})([0-9a-f]{{7,40}})(?:$|{sx.NOT_WORD})', 1)) AS commit_sha,
      regexp_replace(path, '([^/])\\.[^/.]+$', '\\1') AS module_path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS package_path,
      array_to_string(regexp_extract_all(content, '(?m)^#{{1,6}}\\s+(.+)$', 1)[1:50], '|') AS headings,
      array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(content, '{http}', 1), regexp_extract_all(content, '{api}', 1))))[1:50], ',') AS endpoints,
      {s(r'\b(DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL)\b')} AS log_levels,
      CASE WHEN language = 'python' THEN {s(rf'(?m)^\s*(?:async\s+def|def)\s+({name})')} ELSE '' END AS python_functions,
      CASE WHEN language = 'python' THEN {s(rf'(?m)^\s*class\s+({name})')} ELSE '' END AS python_classes,
      {s(r'(?i)\b(?:trace(?:_id)?|trace-id)[=:]([A-Za-z0-9._-]+)', 100)} AS trace_ids,
      coalesce(regexp_extract_all(content, '{ts}', 1)[1], '') AS ts_first, coalesce(regexp_extract_all(content, '{ts}', 1)[-1], '') AS ts_last,
      {s(r'(?m)^\s*([A-Za-z_][A-Za-z0-9_.-]*)\s*(?::|=)', 100)} AS config_keys,
      array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(content, '{marker}', 1),
        CASE WHEN {sx.any_of(name_only, ('changelog', 'release', 'version'))} THEN ['release_file:' || {name_only}] ELSE [] END),
        lambda m: {sx.strip('m')}), lambda m: m <> '')))[1:25], '|') AS release_markers
    FROM (SELECT *, coalesce({sx.mapped(sx.suffix('path'), vocab.LANGUAGE_BY_SUFFIX)}, '') AS language FROM {view})"""


@query(
    "document_facts",
    facts_sql("v_code_docs", "c") + " UNION ALL " + facts_sql("v_md_docs", "m") + " UNION ALL " + facts_sql("v_log_docs", "l"),
)
def document_facts(t: Load) -> DataFrame:
    def of(view: str, prefix: str) -> DataFrame:
        d = facts.document_facts(t(view))
        return d.select(
            F.concat(F.lit(prefix), "doc_id").alias("id"), text("file_language").alias("language"),
            joined("symbol_names").alias("symbols"), text("package_name").alias("package"), text("commit_sha").alias("commit_sha"),
            "module_path", text("package_path").alias("package_path"), joined("headings", "|").alias("headings"),
            joined("endpoint_candidates").alias("endpoints"), joined("log_levels").alias("log_levels"),
            F.when(F.col("file_language") == "python", joined("function_names")).otherwise("").alias("python_functions"),
            F.when(F.col("file_language") == "python", joined("class_names")).otherwise("").alias("python_classes"),
            joined("trace_ids").alias("trace_ids"), text("timestamp_first").alias("ts_first"), text("timestamp_last").alias("ts_last"),
            joined("config_keys_summary").alias("config_keys"), joined("release_markers", "|").alias("release_markers"),
        )

    return of("v_code_docs", "c").unionByName(of("v_md_docs", "m")).unionByName(of("v_log_docs", "l"))


_COLLECTED = "content"
_COUNT = "0"
for _label, _pattern in vocab.COLLECTOR_SECRETS:
    _COUNT += f" + len(regexp_extract_all({_COLLECTED}, '{_pattern}'))"
    _COLLECTED = f"regexp_replace({_COLLECTED}, '{_pattern}', '[REDACTED:{_label}]', 'g')"


@query("collector_redaction", f"SELECT doc_id, {_COLLECTED} AS redacted, {_COUNT} AS redactions FROM v_md_docs")
def collector_redaction(t: Load) -> DataFrame:
    return t("v_md_docs").withColumn("r", tx.redact_collected("content")).select(
        "doc_id", F.col("r.text").alias("redacted"), big("r.redactions").alias("redactions")
    )


@query(
    "secret_redaction",
    f"SELECT 'm' || doc_id AS id, {sx.redact('content')} AS redacted FROM v_md_docs UNION ALL SELECT 'd' || doc_id, md5({sx.redact('content')}) FROM v_docs",
)
def secret_redaction(t: Load) -> DataFrame:
    guides = t("v_md_docs").select(F.concat(F.lit("m"), "doc_id").alias("id"), tx.redact_secrets("content").alias("redacted"))
    docs = t("v_docs").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.md5(tx.redact_secrets("content")).alias("redacted"))
    return guides.unionByName(docs)


@query(
    "prompt_injection_flags",
    "SELECT doc_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(content, '(?i){p}') THEN '{p}' END" for p in vocab.INJECTION_PATTERNS)
    + "], lambda x: x IS NOT NULL), ',') AS matches FROM v_md_docs",
)
def prompt_injection_flags(t: Load) -> DataFrame:
    return t("v_md_docs").select("doc_id", joined(tx.injection_matches("content")).alias("matches"))


@query(
    "output_sanitizing",
    "SELECT page_id, md5(s) AS digest, len(regexp_extract_all(s, 'REMOVED_SCRIPT')) AS scripts FROM (SELECT page_id, "
    + sx.redact(r"regexp_replace(html, '(?i)<script[\s\S]*?</script>', '[REMOVED_SCRIPT]', 'g')") + " AS s FROM pages)",
)
def output_sanitizing(t: Load) -> DataFrame:
    clean = t("pages").select("page_id", tx.sanitize_output("html").alias("s"))
    return clean.select("page_id", F.md5("s").alias("digest"), big(F.regexp_count("s", F.lit("REMOVED_SCRIPT"))).alias("scripts"))


@query(
    "config_secret_scan",
    """SELECT config_id, violation FROM (SELECT config_id, unnest(['nested.client_secret contains a credential-like key',
      'header contains secret-like value', 'list.1 contains secret-like value']) AS violation FROM v_configs)""",
)
def config_secret_scan(t: Load) -> DataFrame:
    from caseloom.sources.documents import config_violations

    return config_violations(t("v_configs"), "config_id", "config")


@query(
    "chunk_metadata_merge",
    """SELECT doc_id, 'branch=' || branch || ';content_hash=' || content_hash || ';language=go;source_type=' ||
      CASE WHEN doc_id % 2 = 0 THEN 'code' ELSE 'logs' END AS merged FROM v_inbox""",
)
def chunk_metadata_merge(t: Load) -> DataFrame:
    docs = t("v_inbox")
    base = F.create_map(F.lit("source_type"), F.lit("code"), F.lit("content_hash"), F.col("content_hash"))
    doc = F.create_map(F.lit("branch"), F.col("branch"), F.lit("language"), F.lit("python"), F.lit("title"), F.lit(""))
    chunk = F.create_map(
        F.lit("language"), F.lit("go"), F.lit("source_type"), F.when(F.col("doc_id") % 2 == 1, "logs").otherwise("")
    )
    merged = F.array_sort(F.map_entries(store.merge_metadata(base, doc, chunk)))
    return docs.select(
        "doc_id", joined(F.transform(merged, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("merged")
    )


@query(
    "operational_event_append",
    r"""SELECT event_id, regexp_replace('App/' || event_type, '[^A-Za-z]', '', 'g') AS x,
      lower('app' || event_type) AS category, 'http.' || event_type || '_done' AS event_type,
      CASE event_type WHEN 'error' THEN 'high' ELSE 'info' END AS severity,
      'line=' || """
    + sx.redact("substr(replace(line, chr(10), ' '), 1, 256)")
    + """ || ';note=[REDACTED];user=' || user_id AS payload FROM
      (SELECT event_id, event_type, user_id, line FROM v_log_lines)""",
)
def operational_event_append(t: Load) -> DataFrame:
    lines = t("v_log_lines")
    events = lines.select(
        "event_id", F.regexp_replace(F.concat(F.lit("App/"), "event_type"), "[^A-Za-z]", "").alias("x"),
        F.concat(F.lit("App/ "), "event_type").alias("category"),
        F.concat(F.lit("HTTP."), "event_type", F.lit("_Done!")).alias("event_type"),
        F.when(F.col("event_type") == "error", "high").otherwise("loud").alias("severity"),
        F.create_map(
            F.lit("line"), F.col("line"), F.lit("user"), F.col("user_id").cast("string"), F.lit("note"), F.lit("n")
        ).alias("payload"),
    )
    events = events.withColumn(
        "payload", F.transform_keys("payload", lambda k, v: F.when(k == "note", "Raw-Content").otherwise(k))
    )
    stored = store.operational_events(events)
    shown = F.array_sort(F.map_entries(stored["payload"]))
    renamed = F.transform(
        shown, lambda e: F.concat_ws("=", F.when(e["key"] == "Raw-Content", "note").otherwise(e["key"]), e["value"])
    )
    return stored.select("event_id", "x", "category", "event_type", "severity", joined(F.array_sort(renamed), ";").alias("payload"))


@query(
    "audit_event_append",
    "SELECT doc_id, 'actor=user;client-secret=[REDACTED];note=' || " + sx.redact("content") + " AS metadata FROM v_md_docs",
)
def audit_event_append(t: Load) -> DataFrame:
    rows = t("v_md_docs").select(
        "doc_id",
        F.create_map(
            F.lit("actor"), F.lit("user"), F.lit("client-secret"), F.col("service"), F.lit("note"), F.col("content")
        ).alias("metadata"),
    )
    return store.audit_events(rows).select(
        "doc_id", joined(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("metadata")
    )


@query(
    "text_compaction",
    f"SELECT 'd' || doc_id AS id, length({sx.compact('content', 1600)}) AS n, md5({sx.compact('content', 1600)}) AS digest FROM v_docs "
    f"UNION ALL SELECT 'm' || doc_id, length({sx.compact('content', 90)}), md5({sx.compact('content', 90)}) FROM v_md_docs",
)
def text_compaction(t: Load) -> DataFrame:
    def of(view: str, prefix: str, limit: int) -> DataFrame:
        c = t(view).select(F.concat(F.lit(prefix), "doc_id").alias("id"), tx.compact("content", limit).alias("c"))
        return c.select("id", big(F.length("c")).alias("n"), F.md5("c").alias("digest"))

    return of("v_docs", "d", 1600).unionByName(of("v_md_docs", "m", 90))


_LOW = "lower(coalesce(path, ''))"


@query(
    "chunk_evidence_types",
    f"""SELECT chunk_id, CASE WHEN raw IS NOT NULL THEN coalesce({sx.mapped('raw', vocab.RETRIEVAL_SOURCE_ALIASES)}, raw)
        {sx.chunk_source('chunk_type')}
        WHEN chunk_type IN ({sx.quoted(vocab.MARKDOWN_CHUNKS)}) THEN CASE WHEN contains({_LOW}, 'api') OR contains({_LOW}, 'swagger') THEN 'api_doc' ELSE 'runbook' END
        ELSE 'unknown_text' END AS fusion_type,
      CASE WHEN raw IN ('deploy', 'logs', 'code', 'incident', 'runbook', 'api_doc', 'config') THEN raw
        {sx.chunk_source('chunk_type')}
        WHEN chunk_type IN ({sx.quoted(vocab.MARKDOWN_CHUNKS)}) THEN CASE WHEN contains({_LOW}, 'runbook') THEN 'runbook'
          WHEN contains({_LOW}, 'api') OR contains({_LOW}, 'swagger') THEN 'api_doc'
          WHEN regexp_matches({_LOW}, '\\.(yaml|yml|json|toml|ini)$') THEN 'config' ELSE 'runbook' END
        ELSE 'runbook' END AS packed_type
    FROM (SELECT chunk_id, path, chunk_type, CASE WHEN start_line = 1 AND source_type <> 'logs' THEN NULL ELSE source_type END AS raw FROM v_facts)""",
)
def chunk_evidence_types(t: Load) -> DataFrame:
    c = t("v_facts").withColumn(
        "metadata",
        F.map_filter(
            F.create_map(F.lit("source_type"), F.when(~((F.col("start_line") == 1) & (F.col("source_type") != "logs")), F.col("source_type"))),
            lambda k, v: v.isNotNull(),
        ),
    )
    return c.select("chunk_id", fusion.chunk_source_type().alias("fusion_type"), fusion.packed_source_type().alias("packed_type"))


@query(
    "chunk_metadata_terms",
    """SELECT chunk_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', nullif(language, ''),
      nullif(symbol, ''), nullif(symbol, ''), nullif(kind, ''), replace(levels, ',', ' '))), '[^a-z0-9_./-]+'), lambda x: length(x) >= 3))), ',') AS terms
    FROM v_facts""",
)
def chunk_metadata_terms(t: Load) -> DataFrame:
    from caseloom.plans.corpus import with_maps

    return with_maps(t("v_facts")).select("chunk_id", joined(F.array_sort(fusion.metadata_term_set())).alias("terms"))


@query(
    "question_entities",
    f"""SELECT question_id, array_to_string({sx.endpoints('question')}, ',') AS endpoints, array_to_string({sx.hashes('question')}, ',') AS hashes,
      array_to_string({sx.services('question')}, ',') AS services FROM v_questions""",
)
def question_entities(t: Load) -> DataFrame:
    return t("v_questions").select(
        "question_id", joined(questions.endpoints("question")).alias("endpoints"),
        joined(questions.deploy_hashes("question")).alias("hashes"), joined(questions.services("question")).alias("services"),
    )


_LQ = "lower(trim(question))"


@query(
    "question_intents",
    f"""SELECT question_id, r AS route, {sx.preference('r', 'intent')} AS intent, array_to_string({sx.query_terms('question')}, ',') AS terms,
      array_to_string({sx.preference('r', 'sources')}, ',') AS sources, array_to_string({sx.preference('r', 'chunks')}, ',') AS chunks,
      CASE WHEN r = 'root_cause' THEN array_to_string(list_filter([CASE WHEN {sx.term(_LQ, vocab.RUNTIME_TERMS)} THEN 'runtime_incident' END,
          CASE WHEN {sx.term(_LQ, vocab.DEPLOY_TERMS)} THEN 'deploy_regression' END, CASE WHEN {sx.term(_LQ, vocab.HISTORY_TERMS)} THEN 'previous_incident' END],
          lambda x: x IS NOT NULL), ',')
        WHEN r IN ('api', 'config') AND contains({_LQ}, 'implemented') THEN 'code_location' ELSE '' END AS secondary
    FROM (SELECT *, {sx.route('question')} AS r FROM v_questions)""",
)
def question_intents(t: Load) -> DataFrame:
    q = questions.with_intent(t("v_questions"))
    return q.select(
        "question_id", "route", "intent", joined("query_terms").alias("terms"), joined("preferred_sources").alias("sources"),
        joined("preferred_chunks").alias("chunks"), joined("secondary_intents").alias("secondary"),
    )


@query(
    "investigation_support",
    f"""SELECT question_id, kind, CASE WHEN i IN ({sx.quoted(vocab.LOOKUP_INTENTS)}) THEN 'query intent is repo lookup rather than runtime incident investigation'
        WHEN i = 'runtime_incident' AND kind <> 'logs' THEN 'runtime investigation requires logs'
        WHEN i = 'deploy_regression' AND kind <> 'deploy' THEN 'deploy analysis requires deploy history or diffs'
        WHEN i = 'previous_incident' AND kind <> 'incident' THEN 'incident history lookup requires incident reports or postmortems' ELSE '' END AS reason
    FROM (SELECT question_id, {sx.preference(sx.route('question'), 'intent')} AS i, unnest(['logs', 'deploy', 'incident', 'code']) AS kind FROM v_questions)""",
)
def investigation_support(t: Load) -> DataFrame:
    q = questions.with_intent(t("v_questions")).withColumn(
        "kind", F.explode(F.array(*[F.lit(k) for k in ("logs", "deploy", "incident", "code")]))
    )
    verdict = questions.investigation_support("intent", F.array("kind"))
    return q.select("question_id", "kind", text(F.get(verdict["reasons"], F.lit(0))).alias("reason"))


_ENTITY = f"""SELECT question_id, {sx.rules('lower(question)', vocab.TASK_RULES, "'generic_incident_question'")} AS task_type,
      {sx.rules('lower(question)', vocab.SYMPTOM_RULES, "NULL")} AS symptom, {sx.services('question')}[1] AS service,
      {sx.endpoints('question')}[1] AS endpoint, {sx.hashes('question')}[1] AS hash,
      nullif(regexp_extract(question, '(?i)\\b(last\\s+\\d+\\s+(?:m|minutes|h|hours|d|days)|between\\s+.+?)\\b', 1), '') AS win FROM v_questions"""


@query(
    "question_investigation_scope",
    f"""SELECT question_id, task_type, coalesce(symptom, '') AS symptom, coalesce(service, '') AS service, coalesce(endpoint, '') AS endpoint,
      coalesce(hash, '') AS deploy_hash, concat_ws('|', service, endpoint, 'deploy ' || hash, replace(symptom, '_', ' ')) AS variants,
      coalesce(win, hash || ' -15/+120 min', '') AS scope_window FROM ({_ENTITY})""",
)
def question_investigation_scope(t: Load) -> DataFrame:
    q = questions.with_scope(questions.with_entities(questions.with_intent(t("v_questions"))))
    return q.select(
        "question_id", "task_type", text("symptom").alias("symptom"), text("service").alias("service"), text("endpoint").alias("endpoint"),
        text("deploy_hash").alias("deploy_hash"), joined("query_variants", "|").alias("variants"), text("scope_window").alias("scope_window"),
    )


@query(
    "section_chunk_types",
    f"""SELECT doc_id, CASE WHEN ({sx.suffix('path')}) = '.go' THEN 'go_fallback' WHEN ({sx.suffix('path')}) = '.proto' THEN 'proto_fallback'
        WHEN k = 'config' THEN 'config_fallback' WHEN k = 'api_doc' THEN 'api_fallback' WHEN k = 'code' THEN 'code_fallback' ELSE 'text_fallback' END AS fallback_type,
      CASE WHEN regexp_matches(lower(split_part(content, ' ', 1)), 'cause') THEN 'incident_root_cause' WHEN contains(lower(split_part(content, ' ', 1)), 'timeline') THEN 'incident_timeline'
        WHEN regexp_matches(lower(split_part(content, ' ', 1)), 'fix|mitigation|action|lessons') THEN 'incident_action'
        WHEN regexp_matches(lower(split_part(content, ' ', 1)), 'summary|symptom|impact|severity|overview') THEN 'incident_symptom' ELSE 'incident_section' END AS incident_type,
      CASE WHEN regexp_matches(content, '(?m)^\\s*\\d+[.)]\\s+') THEN 'markdown_procedure' ELSE 'markdown_heading_section' END AS markdown_type,
      CASE WHEN k = 'api_doc' THEN 'openapi_schema' ELSE CASE doc_id % 4 WHEN 0 THEN 'config_service_block' WHEN 1 THEN 'env_var_block' WHEN 2 THEN 'dependency_block' ELSE 'config_section' END END AS config_type
    FROM (SELECT *, {sx.canonical('declared_type', 'path')} AS k FROM v_docs)""",
)
def section_chunk_types(t: Load) -> DataFrame:
    docs = t("v_docs").withColumn("k", paths.canonical_source_type("declared_type", "path"))
    key = F.expr("CASE doc_id % 4 WHEN 0 THEN 'Services' WHEN 1 THEN 'ENV' WHEN 2 THEN 'requires' ELSE 'misc' END")
    return docs.select(
        "doc_id", paths.fallback_chunk_type("path", "k").alias("fallback_type"),
        chunkers.incident_type(F.split_part("content", F.lit(" "), F.lit(1))).alias("incident_type"),
        chunkers.markdown_type(F.lit(None).cast("string"), F.col("content")).alias("markdown_type"),
        chunkers.config_block_type(key, F.col("k")).alias("config_type"),
    )


@query(
    "report_drafts",
    """SELECT deploy_id, 'Incident Report: ' || service AS report_title, '# Incident Report' || chr(10) || chr(10) || '## Summary' || chr(10) || summary
      || chr(10) || chr(10) || '## Suggested Fix' || chr(10) || 'revert ' || deploy_hash AS report, 'Investigate remediation: ' || substr(summary, 1, 80) AS issue_title,
      '## Context' || chr(10) || summary || chr(10) || chr(10) || '## Suggested Fix' || chr(10) || 'revert ' || deploy_hash AS issue FROM v_deploys""",
)
def report_drafts(t: Load) -> DataFrame:
    d = t("v_deploys").withColumn("fix", F.concat(F.lit("revert "), "deploy_hash"))
    r = d.withColumns({"r": investigation.draft_report("service", "summary", "fix"), "i": investigation.draft_issue("summary", "fix")})
    return r.select(
        "deploy_id", F.col("r.title").alias("report_title"), F.col("r.markdown").alias("report"),
        F.col("i.title").alias("issue_title"), F.col("i.body").alias("issue"),
    )


def _snippet_sql(x: str, limit: int) -> str:
    body, cut = sx.strip(x), sx.rstrip(f"substr(b, 1, {limit - 3})")
    return f"list_transform([{body}], lambda b: CASE WHEN length(b) <= {limit} THEN b ELSE {cut} || '...' END)[1]"


@query(
    "citations_and_snippets",
    f"""SELECT chunk_id, '[' || start_line || '] ' || path || ':' || l AS citation, l AS lines,
      path || ':' || l || chr(10) || {_snippet_sql('text', 200)} AS snippet FROM (SELECT *, {sx.span('start_line', 'end_line')} AS l FROM v_facts)""",
)
def citations_and_snippets(t: Load) -> DataFrame:
    c = t("v_facts").withColumn("lines", tx.line_span("start_line", "end_line"))
    return c.select(
        "chunk_id", tx.citation_text(F.format_string("[%d]", "start_line"), "path", "lines").alias("citation"), "lines",
        tx.direct_snippet("path", "lines", "text", 200).alias("snippet"),
    )


