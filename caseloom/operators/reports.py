"""Coverage, readiness, observer and rollup reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import vocab
from caseloom.defaults import DEFAULTS, Defaults
from caseloom.functions.patterns import first_of, flagged, lookup, strings
from caseloom.functions.text import failure_code
from caseloom.operators.matching import top_per
from caseloom.operators.store import latest_by

# Coverage and readiness texts.
COVERAGE_WARNINGS = (
    ("has_logs", "No logs found. Runtime symptom analysis may be weak."),
    ("has_code", "No code found. Code-path and diff reasoning will be limited."),
    ("has_deploys", "No deploy history found. Deploy-regression investigations may be weak."),
    ("has_incidents", "No previous incidents found. Similar-incident lookup unavailable."),
    (
        "has_runbooks",
        "No runbooks or API docs found. Ownership and remediation guidance may be weak.",
    ),
)
MISSING_EVIDENCE = (
    ("has_logs", "Timestamped application logs are missing."),
    ("has_deploys", "Deploy history or code diffs are missing."),
    ("has_runbooks", "Runbooks or remediation docs are missing."),
    ("has_incidents", "Previous incident reports or postmortems are missing."),
    (
        "has_api_docs",
        "API/OpenAPI docs are missing; endpoint investigation may rely on code only.",
    ),
    ("has_code", "Source code evidence is missing."),
)
READINESS_WEIGHTS = {
    "has_code": 15, "has_docs": 10, "has_configs": 10, "has_logs": 20, "has_deploys": 15,
    "has_runbooks": 15, "has_incidents": 10, "has_api_docs": 5,
}
SUMMARY_LABELS = (
    ("code", "has_code"), ("docs", "has_docs"), ("configs", "has_configs"), ("logs", "has_logs"),
    ("deploy history", "has_deploys"), ("runbooks", "has_runbooks"),
    ("incidents", "has_incidents"), ("API docs", "has_api_docs"),
)
SUCCESS_STATUSES = ("success", "partial_success")
FAILED_STATUSES = ("failed", "cancelled")


def source_coverage(documents: DataFrame, keys: list[str], source_type: str = "source_type") -> DataFrame:
    """Which evidence classes exist per key, with warnings in a fixed order."""
    any_of = lambda *kinds: F.bool_or(F.col(source_type).isin(*kinds))
    flags = documents.groupBy(*keys).agg(
        any_of("logs").alias("has_logs"), any_of("code").alias("has_code"),
        any_of("deploy").alias("has_deploys"), any_of("incident").alias("has_incidents"),
        any_of("runbook", "api_doc").alias("has_runbooks"), any_of("api_doc").alias("has_api_docs"),
    )
    return flags.withColumn(
        "warnings", flagged([(~F.col(c), text) for c, text in COVERAGE_WARNINGS])
    )


def inspection(files: DataFrame, keys: list[str], defaults: Defaults = DEFAULTS) -> DataFrame:
    """Ingestability of scanned folders from ``suffix, size_bytes, source_type``."""
    supported = F.col("suffix").isin(*defaults.supported_extensions)
    oversized = supported & (F.col("size_bytes") > defaults.max_document_bytes)
    usable = supported & ~oversized
    any_of = lambda *kinds: F.coalesce(
        F.bool_or(usable & F.col("source_type").isin(*kinds)), F.lit(False)
    )
    counted = files.groupBy(*keys).agg(
        F.count("*").alias("total_files_seen"),
        F.count_if(usable).alias("ingestable_files"),
        F.count_if(~supported).alias("unsupported_files"),
        F.count_if(oversized).alias("oversized_files"),
        any_of("logs").alias("has_logs"), any_of("code").alias("has_code"),
        any_of("deploy").alias("has_deploys"), any_of("incident").alias("has_incidents"),
        any_of("runbook", "api_doc").alias("has_runbooks"),
    )
    grade = first_of(
        [
            (F.col("ingestable_files") == 0, "none"),
            (~F.col("has_logs") & ~F.col("has_deploys") & ~F.col("has_code"), "low"),
            (
                (F.col("unsupported_files") > F.col("ingestable_files")) | (F.col("oversized_files") > 0),
                "medium",
            ),
        ],
        "high",
    )
    warnings = flagged(
        [
            *[(~F.col(c), text) for c, text in COVERAGE_WARNINGS],
            (
                F.col("unsupported_files") > 0,
                F.format_string("%d unsupported files will be skipped.", "unsupported_files"),
            ),
            (
                F.col("oversized_files") > 0,
                F.format_string("%d oversized files exceed the ingest limit.", "oversized_files"),
            ),
            (F.col("ingestable_files") == 0, "No supported ingestable files found."),
        ]
    )
    return counted.withColumns({"grade": grade, "warnings": warnings})


def failure_histogram(errors: DataFrame, keys: list[str], code: str = "error") -> DataFrame:
    return errors.groupBy(*keys, failure_code(code).alias("failure_code")).agg(F.count("*").alias("n"))


def readiness_source_type(value: Column | str) -> Column:
    lower = F.lower(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("unknown_text")))
    return F.coalesce(lookup(lower, vocab.READINESS_SOURCE_ALIASES), lower)


def readiness_snapshot(projects: DataFrame, sources: DataFrame, documents: DataFrame,
                       chunks: DataFrame, syncs: DataFrame) -> DataFrame:
    """Counts, type flags and the latest sync of every project.

    Each input is reduced to one row per project before the joins.
    """
    kind = readiness_source_type(F.coalesce("source_type", "doc_type"))
    docs = documents.groupBy("project_id").agg(
        F.count("*").alias("document_count"),
        *[
            F.coalesce(F.bool_or(kind == k), F.lit(False)).alias(f"t_{k}")
            for k in vocab.SOURCE_TYPES
        ],
    )
    pieces = chunks.groupBy("project_id").agg(
        F.count("*").alias("chunk_count"),
        F.bool_or(F.contains(F.lower("chunk_type"), F.lit("markdown"))).alias("has_markdown"),
    )
    runs = syncs.groupBy("project_id").agg(
        F.count_if(F.col("status").isin(*SUCCESS_STATUSES)).alias("successful_syncs"),
        F.count_if(F.col("status").isin(*FAILED_STATUSES)).alias("failed_syncs"),
    )
    latest = latest_by(syncs, ["project_id"], "started_at", "sync_id").select(
        "project_id", F.col("status").alias("latest_status"),
        F.col("parser_errors").alias("latest_parser_errors"),
    )
    owned = sources.groupBy("project_id").agg(F.count("*").alias("source_count"))
    joined = projects.select("project_id")
    for part in (owned, docs, pieces, runs, latest):
        joined = joined.join(part, "project_id", "left")
    numbers = (
        "source_count", "document_count", "chunk_count", "successful_syncs", "failed_syncs",
        "latest_parser_errors",
    )
    joined = joined.fillna(0, list(numbers)).fillna(
        False, [f"t_{k}" for k in vocab.SOURCE_TYPES] + ["has_markdown"]
    )
    t = lambda k: F.col(f"t_{k}")
    return joined.withColumns(
        {
            "has_code": t("code"), "has_docs": F.col("has_markdown") | t("unknown_text") | t("runbook"),
            "has_logs": t("logs"), "has_deploys": t("deploy"), "has_runbooks": t("runbook"),
            "has_incidents": t("incident"), "has_api_docs": t("api_doc"), "has_configs": t("config"),
        }
    ).drop(*[f"t_{k}" for k in vocab.SOURCE_TYPES])


def _score() -> tuple[Column, Column]:
    col = F.col
    points = sum((F.when(col(c), w).otherwise(0) for c, w in READINESS_WEIGHTS.items()), F.lit(0))
    errors = F.coalesce("latest_parser_errors", F.lit(0))
    failed = F.coalesce(col("latest_status").isin(*FAILED_STATUSES), F.lit(False))
    no_sync, no_chunks = col("successful_syncs") == 0, col("chunk_count") == 0
    docs_only = (
        col("has_code") & col("has_docs")
        & ~(col("has_logs") | col("has_deploys") | col("has_runbooks") | col("has_incidents"))
    )
    total = (
        points
        - F.when(no_sync, 30).otherwise(0)
        - F.when(failed, 20).otherwise(0)
        - F.when(errors > 0, F.least(F.lit(15), F.greatest(F.lit(3), errors * 2))).otherwise(0)
    )
    total = F.when(no_chunks, F.least(total, F.lit(20))).otherwise(total)
    total = F.when(docs_only, F.least(total, F.lit(55))).otherwise(total)
    score = F.when(col("document_count") == 0, 0).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(100), total))
    )
    notes = F.when(
        col("document_count") == 0, strings(("No documents have been indexed.",))
    ).otherwise(
        flagged(
            [
                (no_sync, "No successful sync has completed."),
                (failed, "Latest sync failed."),
                (errors > 0, F.format_string("Latest sync reported %d parser error(s).", errors)),
                (no_chunks, "No chunks are available for retrieval."),
                (
                    docs_only,
                    "Only code/docs evidence is present; runtime incident investigation will be weak.",
                ),
            ]
        )
    )
    return score.cast("int"), notes


def readiness_report(snapshot: DataFrame) -> DataFrame:
    """Score, grade and advice per project, as projections over the snapshot."""
    score, notes = _score()
    scored = snapshot.withColumns({"score": score, "score_notes": notes})
    c, lack = F.col, lambda name: ~F.col(name)
    grade = first_of(
        [
            (c("score") >= 85, "excellent"), (c("score") >= 70, "good"),
            (c("score") >= 50, "partial"), (c("score") >= 25, "weak"),
        ],
        "empty",
    )
    repo = c("has_code") | c("has_docs") | c("has_configs")
    answerable = flagged(
        [
            (repo, "Where is a feature, endpoint, or behavior implemented?"),
            (repo, "Which files define API, configuration, or service behavior?"),
            (repo, "Where are service or module boundaries visible in the repo?"),
            (c("has_logs"), "What errors, timeouts, or latency symptoms appear in the logs?"),
            (c("has_deploys"), "What deploys, releases, or diffs are available around a change?"),
            (c("has_runbooks"), "What remediation or rollback steps are already documented?"),
            (c("has_incidents"), "Have similar incidents or postmortems been indexed?"),
            (c("has_api_docs"), "Which endpoints are documented?"),
        ]
    )
    weak = flagged(
        [
            (lack("has_logs"), "Why did latency spike at runtime?"),
            (lack("has_logs"), "What errors happened during the outage?"),
            (lack("has_deploys"), "Was this caused by the last deploy?"),
            (lack("has_deploys"), "What changed immediately before the incident?"),
            (lack("has_incidents"), "Has this happened before?"),
            (lack("has_runbooks"), "What rollback or fix does the team already recommend?"),
        ]
    )
    gaps = flagged(
        [
            (lack("has_logs"), "No timestamped logs found; runtime symptoms cannot be grounded."),
            (lack("has_deploys"), "No deploy history found; deploy-regression analysis will be weak."),
            (c("has_logs") & lack("has_deploys"), "Logs exist but deploy context is missing."),
            (
                lack("has_incidents"),
                "No previous incident reports found; similarity lookup is unavailable.",
            ),
        ]
    )
    actions = flagged(
        [
            (c("source_count") == 0, "Register a source and run Collector sync."),
            (
                lack("has_logs"),
                "Add timestamped application logs with service names, request IDs, and error levels.",
            ),
            (lack("has_deploys"), "Add deploy history, release notes, or patch/diff exports."),
            (
                lack("has_runbooks"),
                "Add runbooks for critical services and common rollback procedures.",
            ),
            (lack("has_incidents"), "Add previous incident reports or postmortems."),
            (lack("has_api_docs"), "Add OpenAPI/API docs if endpoint-level investigation matters."),
            (lack("has_code"), "Add backend source code or service ownership docs."),
        ]
    )
    suggested = flagged(
        [
            (c("has_code"), "Where is the application configured?"),
            (c("has_code"), "Which files define database configuration?"),
            (c("has_code"), "Which modules or services appear most important?"),
            (
                c("has_configs"),
                "Which configuration files mention deployment, Docker, or database settings?",
            ),
            (c("has_logs"), "What timeout, error, or latency symptoms appear in the logs?"),
            (c("has_deploys"), "What changed in the latest deploy history or diff?"),
            (c("has_runbooks"), "Which runbooks mention rollback or restart steps?"),
            (
                lack("has_logs") | lack("has_deploys"),
                "What evidence is missing for deploy-regression or latency investigation?",
            ),
        ]
    )
    latest = F.coalesce("latest_status", F.lit(""))
    extra = flagged(
        [
            (
                latest == "partial_success",
                "Latest sync completed with partial success; inspect parser errors and skipped documents.",
            ),
            (latest.isin(*FAILED_STATUSES), "Latest sync failed; readiness may be stale."),
            (lack("has_logs"), "Latency and outage investigations will be weak without logs."),
            (
                lack("has_deploys"),
                "Deploy-regression investigations will be weak without deploy history.",
            ),
            (
                lack("has_incidents"),
                "Previous-incident lookup is unavailable without incident reports.",
            ),
        ]
    )
    missing = flagged([(lack(f), text) for f, text in MISSING_EVIDENCE])
    advised = scored.withColumns(
        {
            "grade": grade, "answerable_questions": answerable, "weak_questions": weak,
            "observability_gaps": gaps, "suggested_actions": actions,
            "suggested_questions": suggested, "missing_evidence": missing,
            "warnings": F.array_distinct(F.concat("score_notes", extra)),
        }
    )
    found = F.array_join(flagged([(F.col(f), label) for label, f in SUMMARY_LABELS]), ", ")
    found_or = F.coalesce(F.nullif(found, F.lit("")), F.lit("limited evidence"))
    summary = first_of(
        [
            (
                c("document_count") == 0,
                "No indexed evidence is available yet. Run Collector sync before asking incident questions.",
            ),
            (c("score") >= 70, F.concat(F.lit("Evidence coverage is strong across "), found, F.lit("."))),
            (
                F.size("missing_evidence") > 0,
                F.concat(
                    F.lit("Found "), found_or, F.lit(", but "), F.get("missing_evidence", F.lit(0))
                ),
            ),
        ],
        F.concat(F.lit("Found "), found_or, F.lit(".")),
    )
    return advised.withColumn("summary", summary)


# --- observer ---------------------------------------------------------------


def fingerprint(finding_type: Column, threshold: str) -> Column:
    """Hash of the finding type and its threshold, for matching repeats."""
    body = F.concat(
        F.lit('{"finding_type": "'), finding_type, F.lit('", "threshold": '), F.lit(threshold), F.lit("}")
    )
    return F.sha2(body, 256)


def observer_findings(syncs: DataFrame, jobs: DataFrame, evals: DataFrame,
                      defaults: Defaults = DEFAULTS) -> DataFrame:
    """Threshold findings per project from recent syncs, jobs and the last evaluation."""
    recent = top_per(
        syncs, ["project_id"], [F.desc("started_at"), F.desc("sync_id")], defaults.observer_sync_window
    )
    loss = recent.groupBy("project_id").agg(
        F.count("*").alias("syncs_checked"), F.sum("files_seen").alias("files_seen"),
        F.sum("parser_errors").alias("parser_errors"),
    ).withColumn("rate", F.col("parser_errors") / F.greatest("files_seen", F.lit(1)))
    states = jobs.groupBy("project_id").agg(
        F.count_if(F.col("status") == "failed").alias("failed_jobs"),
        F.count_if(F.col("status") == "stale").alias("stale_jobs"),
    )
    last_eval = latest_by(evals, ["project_id"], "created_at", "eval_run_id")
    limit = defaults.observer_parser_error_rate

    def rows(frame: DataFrame, rules: list[tuple[str, Column, Column | str, Column, str]]) -> DataFrame:
        """Rules are (type, holds, severity, observed value, threshold as JSON)."""
        cells = [
            (
                holds,
                F.struct(
                    F.lit(kind).alias("finding_type"),
                    (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
                    F.round(observed.cast("double"), 4).alias("observed"),
                    F.lit(threshold).alias("threshold"),
                    fingerprint(F.lit(kind), threshold).alias("fingerprint"),
                ),
            )
            for kind, holds, severity, observed, threshold in rules
        ]
        return frame.select("project_id", F.inline(flagged(cells)))

    c = F.col
    parser = rows(
        loss,
        [
            (
                "parser_loss_spike", (c("parser_errors") > 0) & (c("rate") >= limit),
                F.when(c("rate") >= limit * 2, "high").otherwise("medium"), c("rate"),
                f'{{"max_rate": {limit}}}',
            )
        ],
    )
    job = rows(
        states,
        [
            ("index_job_failures", c("failed_jobs") > 0, "high", c("failed_jobs"), '{"allowed": 0}'),
            ("stale_index_version", c("stale_jobs") > 0, "medium", c("stale_jobs"), '{"allowed": 0}'),
        ],
    )
    quality = rows(
        last_eval,
        [
            (
                "retrieval_recall_regression", c("avg_evidence_recall") < defaults.observer_min_recall,
                "high", c("avg_evidence_recall"), f'{{"min_recall": {defaults.observer_min_recall}}}',
            ),
            (
                "wrong_source_type_rate", c("wrong_source_type_rate") > defaults.observer_max_wrong_rate,
                "medium", c("wrong_source_type_rate"), f'{{"max_rate": {defaults.observer_max_wrong_rate}}}',
            ),
            (
                "eval_latency_regression", c("latency_p95_ms") > defaults.observer_p95_ms, "medium",
                c("latency_p95_ms"), f'{{"max_latency_p95_ms": {defaults.observer_p95_ms}}}',
            ),
        ],
    )
    return parser.unionByName(job).unionByName(quality)


def event_rollup(events: DataFrame, defaults: Defaults = DEFAULTS) -> DataFrame:
    """Counts over the latest events of each project by category, severity and type.

    The first twenty event types in alphabetical order are reported.
    """
    recent = top_per(
        events, ["project_id"], [F.desc("created_at"), F.desc("event_id")], defaults.logging_event_limit
    )
    long = recent.select(
        "project_id",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias("kind"), F.col(k).alias("key"))
                    for k in ("category", "severity", "event_type")
                ]
            )
        ),
    )
    counts = long.groupBy("project_id", "kind", "key").agg(F.count("*").alias("n"))
    ranked = top_per(counts, ["project_id", "kind"], [F.asc("key")], 2**31 - 1)
    return ranked.where((F.col("kind") != "event_type") | (F.col("rank") <= 20)).drop("rank")


def latency_summary(events: DataFrame, name: str, value: str) -> DataFrame:
    return events.groupBy(name).agg(
        F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"), F.round(F.avg(value), 2).alias("mean")
    )


def collector_summary(files: DataFrame) -> DataFrame:
    """Collected files by skip reason, source type and language, in long form."""
    kept = F.col("skip_reason").isNull()
    kinds = F.array_compact(
        F.array(
            F.when(~kept, F.struct(F.lit("skip_reason").alias("kind"), F.col("skip_reason").alias("key"))),
            F.when(kept, F.struct(F.lit("source_type").alias("kind"), F.col("source_type").alias("key"))),
            F.when(
                kept & F.col("language").isNotNull(),
                F.struct(F.lit("language").alias("kind"), F.col("language").alias("key")),
            ),
        )
    )
    return files.select(F.inline(kinds)).groupBy("kind", "key").agg(F.count("*").alias("n"))


def close_syncs(syncs: DataFrame) -> DataFrame:
    """Effective status of finished syncs and the status of their sources.

    ``syncs`` carries the requested status, the errors counted while ingesting
    and those reported at the end, and the index jobs that are still open.
    """
    errors = F.greatest("parser_errors", "reported_parser_errors", "parser_error_count")
    status = F.when(
        (F.col("requested_status") == "success") & ((errors > 0) | (F.col("error_count") > 0)),
        "partial_success",
    ).otherwise(F.col("requested_status"))
    ended = syncs.withColumns({"effective_errors": errors, "effective_status": status})
    good = F.col("effective_status").isin(*SUCCESS_STATUSES)
    return ended.withColumns(
        {
            "error_message": F.coalesce(
                "reported_message", F.when(F.col("effective_status").isin(*FAILED_STATUSES), F.col("effective_status"))
            ),
            "source_status": F.when(good & (F.col("pending_jobs") > 0), "indexing")
            .when(good, "ready")
            .otherwise("error"),
        }
    )
