"""Queries for joins, reports, observers, investigation, evaluation and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import vocab
from caseloom.functions.questions import with_entities, with_intent
from caseloom.operators import evaluation, investigation as inv, jobs, reports
from caseloom.operators.matching import nearest_rank, sliding_count, top_per
from caseloom.plans import investigation as plan, retrieval_sql as rs, sqlexpr as sx
from caseloom.plans.catalog_retrieval import index_tables, packed
from caseloom.plans.registry import Load, big, flag, joined, query, stamp, text
from caseloom.streaming import jobs as streams

# --- joins and access -------------------------------------------------------


@query("chunk_document_join", "SELECT f.chunk_id, d.service, f.chunk_type FROM v_facts f JOIN v_log_docs d ON f.document_id = 'log' || d.doc_id")
def chunk_document_join(t: Load) -> DataFrame:
    docs = t("v_log_docs").select(F.concat(F.lit("log"), "doc_id").alias("document_id"), "service")
    return t("v_facts").drop("service").join(docs, "document_id").select("chunk_id", "service", "chunk_type")


@query(
    "visible_projects",
    """SELECT user_id, project_id, role, rank FROM (SELECT m.*, row_number() OVER (PARTITION BY user_id ORDER BY n_regionkey DESC, project_id) AS rank
    FROM v_members m JOIN (SELECT 'p' || n_nationkey AS project_id, n_regionkey FROM nation) n USING (project_id)) WHERE rank <= 100""",
)
def visible_projects(t: Load) -> DataFrame:
    projects = t("nation").select(F.concat(F.lit("p"), "n_nationkey").alias("project_id"), F.col("n_regionkey").alias("created_at"))
    seen = jobs.visible_projects(projects, t("v_members"))
    return seen.select("user_id", "project_id", "role", big("rank").alias("rank"))


@query(
    "role_gate",
    """SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM v_members m WHERE m.user_id = o_custkey AND m.project_id = 'p' || (o_orderkey % 25) AND m.role IN ('approver', 'admin'))""",
)
def role_gate(t: Load) -> DataFrame:
    asked = t("orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.concat(F.lit("p"), F.col("o_orderkey") % 25).alias("project_id"))
    return jobs.permitted(asked, t("v_members"), "approver").select("o_orderkey")


@query(
    "logs_near_deploys",
    r"""SELECT d.project_id, d.service, d.deploy_id, count(*) AS log_lines, CAST(sum(len(regexp_extract_all(l.line, '(?i)\b(?:ERROR|CRITICAL|EXCEPTION|5\d\d)\b'))) AS BIGINT) AS errors,
      strftime(min(l.ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(l.ts), '%Y-%m-%d %H:%M:%S') AS last_ts
    FROM v_log_lines l JOIN (SELECT deploy_id, project_id, service, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(deploy_id * 37 % 43200 AS BIGINT)) AS deployed_at FROM v_deploys) d
    ON d.project_id = l.project_id AND d.service = l.service AND l.ts BETWEEN d.deployed_at - INTERVAL 15 MINUTE AND d.deployed_at + INTERVAL 120 MINUTE GROUP BY ALL""",
)
def logs_near_deploys(t: Load) -> DataFrame:
    moved = t("v_deploys").select(
        "deploy_id", "project_id", "service",
        F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(deploy_id * 37 % 43200 as int), 0)").alias("deployed_at"),
    )
    near = inv.logs_near_deploys(t("v_log_lines"), moved)
    return near.select(
        "project_id", "service", "deploy_id", "log_lines", big("errors").alias("errors"), stamp("first_ts").alias("first_ts"), stamp("last_ts").alias("last_ts")
    )


# --- aggregations -----------------------------------------------------------


@query(
    "grouped_counts",
    f"""SELECT project_id, coalesce(nullif(k, 'unknown_text'), dt) AS kind, count(*) AS n FROM (SELECT project_id, {sx.canonical('declared_type', 'path')} AS k, {sx.doc_type('path')} AS dt FROM v_docs) GROUP BY ALL""",
)
def grouped_counts(t: Load) -> DataFrame:
    from caseloom.functions import paths

    kind = F.coalesce(F.nullif(paths.canonical_source_type("declared_type", "path"), F.lit("unknown_text")), paths.doc_type("path"))
    return t("v_docs").groupBy("project_id", kind.alias("kind")).agg(F.count("*").alias("n"))


@query(
    "sync_status_counts",
    """SELECT project_id, count(*) FILTER (status IN ('success', 'partial_success')) AS successful, count(*) FILTER (status IN ('failed', 'cancelled')) AS failed FROM v_syncs GROUP BY project_id""",
)
def sync_status_counts(t: Load) -> DataFrame:
    s = F.col("status")
    return t("v_syncs").groupBy("project_id").agg(
        F.count_if(s.isin(*reports.SUCCESS_STATUSES)).alias("successful"), F.count_if(s.isin(*reports.FAILED_STATUSES)).alias("failed")
    )


@query(
    "source_coverage",
    f"""SELECT source_id, CAST(l AS BIGINT) AS has_logs, CAST(c AS BIGINT) AS has_code, CAST(r AS BIGINT) AS has_runbooks, array_to_string(list_filter([
      {', '.join(f"CASE WHEN NOT {v} THEN '{w}' END" for v, (_, w) in zip(('l', 'c', 'd', 'i', 'r'), reports.COVERAGE_WARNINGS))}], lambda w: w IS NOT NULL), '|') AS warnings
    FROM (SELECT source_id, bool_or(k = 'logs') AS l, bool_or(k = 'code') AS c, bool_or(k = 'deploy') AS d, bool_or(k = 'incident') AS i, bool_or(k IN ('runbook', 'api_doc')) AS r
      FROM (SELECT source_id, {sx.source_type('path')} AS k FROM v_docs) GROUP BY source_id)""",
)
def source_coverage(t: Load) -> DataFrame:
    from caseloom.functions import paths

    c = reports.source_coverage(t("v_docs").withColumn("source_type", paths.source_type("path")), ["source_id"])
    return c.select("source_id", flag("has_logs").alias("has_logs"), flag("has_code").alias("has_code"), flag("has_runbooks").alias("has_runbooks"), joined("warnings", "|").alias("warnings"))


def _readiness(t: Load) -> DataFrame:
    kinds = F.expr("CASE doc_id % 9 WHEN 0 THEN 'code' WHEN 1 THEN 'patch' WHEN 2 THEN 'log' WHEN 3 THEN 'incidents' WHEN 4 THEN 'config' WHEN 5 THEN 'api_doc' WHEN 6 THEN 'runbooks' ELSE 'code' END")
    # Project 7 has no documents and project 9 documents without chunks: theirs belong to the next project.
    owner = "CASE doc_id % 40 WHEN 7 THEN 8 ELSE doc_id % 40 END"
    docs = t("v_docs").select(F.concat(F.lit("p"), F.expr(owner)).alias("project_id"), kinds.alias("source_type"), F.lit("markdown").alias("doc_type"), "doc_id")
    holder = F.expr("CASE doc_id % 40 WHEN 7 THEN 8 WHEN 9 THEN 10 ELSE doc_id % 40 END")
    chunks = docs.select(F.concat(F.lit("p"), holder).alias("project_id"), F.when(F.col("doc_id") % 5 == 0, "markdown_faq").otherwise("go_function").alias("chunk_type"))
    projects = t("v_syncs").select("project_id").distinct()
    sources = t("v_syncs").select("project_id", "source_id").distinct()
    return reports.readiness_report(reports.readiness_snapshot(projects, sources, docs, chunks, t("v_syncs")))


_READY = """WITH d AS (SELECT 'p' || (CASE doc_id % 40 WHEN 7 THEN 8 ELSE doc_id % 40 END) AS project_id, 'p' || (CASE doc_id % 40 WHEN 7 THEN 8 WHEN 9 THEN 10 ELSE doc_id % 40 END) AS holder, doc_id, doc_id % 9 AS m FROM v_docs),
  c AS (SELECT holder AS project_id, count(*) AS chunks, bool_or(doc_id % 5 = 0) AS md FROM d GROUP BY holder),
  s AS (SELECT project_id, count(*) FILTER (status IN ('success', 'partial_success')) AS good, arg_max(status, (started_at, sync_id)) AS latest, arg_max(parser_errors, (started_at, sync_id)) AS errs,
    count(DISTINCT source_id) AS sources FROM v_syncs GROUP BY project_id),
  f AS (SELECT s.*, coalesce(docs, 0) AS docs, coalesce(chunks, 0) AS chunks, coalesce(md, false) OR coalesce(rb, false) AS docs_, coalesce(code, false) AS code, coalesce(dep, false) AS dep, coalesce(logs, false) AS logs,
      coalesce(inc, false) AS inc, coalesce(cfg, false) AS cfg, coalesce(api, false) AS api, coalesce(rb, false) AS rb FROM s LEFT JOIN (
    SELECT project_id, count(*) AS docs, bool_or(m IN (0, 7, 8)) AS code, bool_or(m = 1) AS dep, bool_or(m = 2) AS logs,
      bool_or(m = 3) AS inc, bool_or(m = 4) AS cfg, bool_or(m = 5) AS api, bool_or(m = 6) AS rb FROM d GROUP BY project_id) USING (project_id) LEFT JOIN c USING (project_id)),
  g AS (SELECT *, CASE WHEN code THEN 15 ELSE 0 END + CASE WHEN docs_ THEN 10 ELSE 0 END + CASE WHEN cfg THEN 10 ELSE 0 END + CASE WHEN logs THEN 20 ELSE 0 END + CASE WHEN dep THEN 15 ELSE 0 END + CASE WHEN rb THEN 15 ELSE 0 END
      + CASE WHEN inc THEN 10 ELSE 0 END + CASE WHEN api THEN 5 ELSE 0 END - CASE WHEN good = 0 THEN 30 ELSE 0 END - CASE WHEN latest IN ('failed', 'cancelled') THEN 20 ELSE 0 END
      - CASE WHEN errs > 0 THEN least(15, greatest(3, errs * 2)) ELSE 0 END AS raw FROM f),
  h AS (SELECT *, CASE WHEN docs = 0 THEN 0 ELSE greatest(0, least(100, CASE WHEN code AND docs_ AND NOT (logs OR dep OR rb OR inc) THEN least(55, x) ELSE x END)) END AS score FROM (SELECT *, CASE WHEN chunks = 0 THEN least(raw, 20) ELSE raw END AS x FROM g))
  """
_MISSING = "list_filter([" + ", ".join(
    f"CASE WHEN NOT {c} THEN '{m}' END" for c, (_, m) in zip(("logs", "dep", "rb", "inc", "api", "code"), reports.MISSING_EVIDENCE)
) + "], lambda w: w IS NOT NULL)"


@query(
    "readiness_scores",
    _READY + "SELECT project_id, CAST(score AS BIGINT) AS score, CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'partial' WHEN score >= 25 THEN 'weak' ELSE 'empty' END AS grade, sources, docs, chunks FROM h",
)
def readiness_scores(t: Load) -> DataFrame:
    return _readiness(t).select(
        "project_id", big("score").alias("score"), "grade", F.col("source_count").alias("sources"), F.col("document_count").alias("docs"), F.col("chunk_count").alias("chunks")
    )


@query(
    "readiness_advice",
    _READY + f"""SELECT project_id, array_to_string({_MISSING}, '|') AS missing,
      CASE WHEN docs = 0 THEN 'No indexed evidence is available yet. Run Collector sync before asking incident questions.'
        WHEN score >= 70 THEN 'Evidence coverage is strong across ' || found || '.' WHEN len({_MISSING}) > 0 THEN 'Found ' || coalesce(nullif(found, ''), 'limited evidence') || ', but ' || {_MISSING}[1]
        ELSE 'Found ' || coalesce(nullif(found, ''), 'limited evidence') || '.' END AS summary,
      array_to_string(list_distinct(list_concat(notes, list_filter([CASE WHEN latest = 'partial_success' THEN 'Latest sync completed with partial success; inspect parser errors and skipped documents.' END,
        CASE WHEN latest IN ('failed', 'cancelled') THEN 'Latest sync failed; readiness may be stale.' END, CASE WHEN NOT logs THEN 'Latency and outage investigations will be weak without logs.' END,
        CASE WHEN NOT dep THEN 'Deploy-regression investigations will be weak without deploy history.' END, CASE WHEN NOT inc THEN 'Previous-incident lookup is unavailable without incident reports.' END], lambda w: w IS NOT NULL))).list_sort(), '|') AS warnings
    FROM (SELECT *, array_to_string(list_filter([CASE WHEN code THEN 'code' END, CASE WHEN docs_ THEN 'docs' END, CASE WHEN cfg THEN 'configs' END, CASE WHEN logs THEN 'logs' END, CASE WHEN dep THEN 'deploy history' END,
        CASE WHEN rb THEN 'runbooks' END, CASE WHEN inc THEN 'incidents' END, CASE WHEN api THEN 'API docs' END], lambda w: w IS NOT NULL), ', ') AS found,
      CASE WHEN docs = 0 THEN ['No documents have been indexed.'] ELSE list_filter([CASE WHEN good = 0 THEN 'No successful sync has completed.' END, CASE WHEN latest IN ('failed', 'cancelled') THEN 'Latest sync failed.' END,
        CASE WHEN errs > 0 THEN 'Latest sync reported ' || errs || ' parser error(s).' END, CASE WHEN chunks = 0 THEN 'No chunks are available for retrieval.' END,
        CASE WHEN code AND docs_ AND NOT (logs OR dep OR rb OR inc) THEN 'Only code/docs evidence is present; runtime incident investigation will be weak.' END], lambda w: w IS NOT NULL) END AS notes FROM h)""",
)
def readiness_advice(t: Load) -> DataFrame:
    return _readiness(t).select(
        "project_id", joined("missing_evidence", "|").alias("missing"), "summary", joined(F.array_sort("warnings"), "|").alias("warnings")
    )


@query("latency_percentiles", """SELECT l_suppkey, v[CAST(floor(0.5 * (n - 1)) AS BIGINT) + 1] AS p50, v[CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1] AS p95 FROM (
    SELECT l_suppkey, list_sort(list(CAST(l_extendedprice AS BIGINT) // 100)) AS v, count(*) AS n FROM (SELECT l_suppkey, floor(l_extendedprice) AS l_extendedprice FROM lineitem) GROUP BY l_suppkey)""")
def latency_percentiles(t: Load) -> DataFrame:
    rows = t("lineitem").select("l_suppkey", F.expr("cast(floor(l_extendedprice) as bigint) div 100").alias("ms"))
    return nearest_rank(rows, ["l_suppkey"], "ms", {"p50": 50, "p95": 95})


@query(
    "observer_findings",
    """WITH recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, sync_id DESC) AS rn FROM v_syncs) WHERE rn <= 20),
    p AS (SELECT project_id, sum(parser_errors) AS e, sum(parser_errors) / greatest(sum(files_seen), 1) AS rate FROM recent GROUP BY project_id),
    j AS (SELECT project_id, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (NOT current_version) AS stale FROM v_deliveries GROUP BY project_id),
    v AS (SELECT project_id, arg_max(n, (started_at, sync_id)) AS n FROM (SELECT *, files_seen AS n FROM v_syncs) GROUP BY project_id)
    SELECT project_id, 'parser_loss_spike' AS finding_type, CASE WHEN rate >= 0.2 THEN 'high' ELSE 'medium' END AS severity, round(CAST(rate AS DOUBLE), 4) AS observed FROM p WHERE e > 0 AND rate >= 0.1
    UNION ALL SELECT project_id, 'index_job_failures', 'high', CAST(failed AS DOUBLE) FROM j WHERE failed > 0
    UNION ALL SELECT project_id, 'stale_index_version', 'medium', CAST(stale AS DOUBLE) FROM j WHERE stale > 0
    UNION ALL SELECT project_id, 'retrieval_recall_regression', 'high', round(n / 100.0, 4) FROM v WHERE n / 100.0 < 0.6
    UNION ALL SELECT project_id, 'wrong_source_type_rate', 'medium', round(n / 200.0, 4) FROM v WHERE n / 200.0 > 0.25
    UNION ALL SELECT project_id, 'eval_latency_regression', 'medium', CAST(n * 30 AS DOUBLE) FROM v WHERE n * 30 > 1500""",
)
def observer_findings(t: Load) -> DataFrame:
    syncs = t("v_syncs")
    states = t("v_deliveries").select("project_id", F.when(F.col("outcome") == "failed", "failed").otherwise("done").alias("status")).unionByName(
        t("v_deliveries").where(~F.col("current_version")).select("project_id", F.lit("stale").alias("status"))
    )
    evals = syncs.select(
        "project_id", F.col("sync_id").alias("eval_run_id"), F.col("started_at").alias("created_at"), (F.col("files_seen") / 100.0).alias("avg_evidence_recall"),
        (F.col("files_seen") / 200.0).alias("wrong_source_type_rate"), (F.col("files_seen") * 30).alias("latency_p95_ms"),
    )
    return reports.observer_findings(syncs, states, evals).select("project_id", "finding_type", "severity", "observed")


@query(
    "event_rollup",
    """WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, seq DESC) AS rn FROM v_deliveries) WHERE rn <= 500)
    SELECT project_id, kind, key, n FROM (SELECT *, row_number() OVER (PARTITION BY project_id, kind ORDER BY key) AS k FROM (
      SELECT project_id, 'category' AS kind, outcome AS key, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT project_id, 'severity', CASE WHEN current_version THEN 'info' ELSE 'high' END, count(*) FROM r GROUP BY ALL
      UNION ALL SELECT project_id, 'event_type', 'e' || (seq % 37), count(*) FROM r GROUP BY ALL)) WHERE kind <> 'event_type' OR k <= 20""",
)
def event_rollup(t: Load) -> DataFrame:
    events = t("v_deliveries").select(
        "project_id", F.col("ts").alias("created_at"), F.col("seq").alias("event_id"), F.col("outcome").alias("category"),
        F.when(F.col("current_version"), "info").otherwise("high").alias("severity"), F.concat(F.lit("e"), F.col("seq") % 37).alias("event_type"),
    )
    return reports.event_rollup(events)


@query("latency_means", "SELECT event_type, count(*) AS n, round(sum(CAST(floor(value * 20) AS DOUBLE)), 2) AS total, round(avg(CAST(floor(value * 20) AS BIGINT)), 2) AS mean FROM events GROUP BY event_type")
def latency_means(t: Load) -> DataFrame:
    ms = t("events").withColumn("ms", F.floor(F.col("value") * 20).cast("double"))
    return reports.latency_summary(ms, "event_type", "ms")


@query(
    "latest_sync_per_source",
    "SELECT source_id, arg_max(sync_id, (started_at, sync_id)) AS sync_id, arg_max(status, (started_at, sync_id)) AS status FROM v_syncs GROUP BY source_id",
)
def latest_sync_per_source(t: Load) -> DataFrame:
    from caseloom.operators.store import latest_by

    return latest_by(t("v_syncs"), ["source_id"], "started_at", "sync_id").select("source_id", "sync_id", "status")


@query(
    "sliding_request_limits",
    """SELECT a.event_id, count(*) AS in_window FROM events a JOIN events b ON a.event_type = b.event_type AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 3600 SECOND GROUP BY a.event_id HAVING count(*) > 3""",
)
def sliding_request_limits(t: Load) -> DataFrame:
    counted = sliding_count(t("events"), ["event_type"], "ts", 3600)
    return counted.where("in_window > 3").select("event_id", "in_window")


_BAD = "(event_type = 'error' OR event_id % 41 = 0)"


@query(
    "stream_error_rates",
    f"""SELECT service, strftime(w, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS lines, count(*) FILTER ({_BAD}) AS error_lines, round(count(*) FILTER ({_BAD}) / count(*), 6) AS error_rate
    FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01 00:00:00') AS w FROM v_log_lines) GROUP BY service, w""",
)
def stream_error_rates(t: Load) -> DataFrame:
    """The streaming operator over stored lines."""
    r = streams.error_rates(t("v_log_lines"), width="6 hours")
    return r.select("service", stamp("start").alias("start"), "lines", "error_lines", F.round("error_rate", 6).alias("error_rate"))


@query(
    "stream_error_bursts",
    f"""SELECT service, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS error_lines FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY service ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
        SELECT service, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY service ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM v_log_lines WHERE {_BAD}))
    GROUP BY service, session HAVING count(*) >= 2""",
)
def stream_error_bursts(t: Load) -> DataFrame:
    """The streaming operator over stored lines."""
    b = streams.error_bursts(t("v_log_lines"), gap="2 hours")
    return b.select("service", stamp("start").alias("start"), stamp("end").alias("end"), "error_lines")


@query(
    "stream_request_limits",
    """SELECT event_type, strftime(w, '%Y-%m-%d %H:%M:%S') AS start, strftime(w + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS requests FROM (
      SELECT event_type, unnest([h, h - INTERVAL 1 HOUR]) AS w FROM (SELECT event_type, date_trunc('hour', ts) AS h FROM events)) GROUP BY event_type, w HAVING count(*) > 3""",
)
def stream_request_limits(t: Load) -> DataFrame:
    """The streaming operator over stored events."""
    over = streams.request_limits(t("events"), "event_type", "ts", 7200, 3, slide=3600)
    return over.select("event_type", stamp("start").alias("start"), stamp("end").alias("end"), "requests")


@query(
    "latest_runs_per_project",
    "SELECT project_id, sync_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, sync_id DESC) AS rank FROM v_syncs) WHERE rank <= 100",
)
def latest_runs_per_project(t: Load) -> DataFrame:
    newest = top_per(t("v_syncs"), ["project_id"], [F.desc("started_at"), F.desc("sync_id")], 100)
    return newest.select("project_id", "sync_id", big("rank").alias("rank"))


# --- investigation ----------------------------------------------------------

_LOG_COUNTS = r"""len(list_filter(regexp_extract_all(text, '(\d{2,6})ms', 1), lambda x: CAST(x AS BIGINT) >= 500)) AS slow,
  coalesce(list_max(list_transform(regexp_extract_all(text, '(\d{2,6})ms', 1), lambda x: CAST(x AS BIGINT))), 0) AS top,
  len(regexp_extract_all(text, '(?i)\b(?:ERROR|CRITICAL|EXCEPTION|5\d\d)\b')) AS err, len(regexp_extract_all(text, '(?i)\bTIMEOUT|timed out\b')) AS tmo"""


@query(
    "corpus_log_findings",
    f"""SELECT service, CAST(sum(slow) AS BIGINT) AS slow_requests, CAST(max(top) AS BIGINT) AS max_latency_ms, CAST(sum(err) AS BIGINT) AS errors, CAST(sum(tmo) AS BIGINT) AS timeouts, count(ts_start) AS timestamped_logs
    FROM (SELECT service, ts_start, {_LOG_COUNTS} FROM v_log_windows) GROUP BY service""",
)
def corpus_log_findings(t: Load) -> DataFrame:
    logs = t("v_log_windows").select(F.col("service").alias("owner"), F.col("service").alias("service_name"), "text", F.col("ts_start").alias("timestamp_start"))
    found = inv.log_findings(logs, ["owner"])
    return found.select(
        F.col("owner").alias("service"), big("slow_requests").alias("slow_requests"), big("max_latency_ms").alias("max_latency_ms"), big("errors").alias("errors"),
        big("timeouts").alias("timeouts"), "timestamped_logs",
    )


@query(
    "corpus_deploy_findings",
    r"""SELECT service, count(*) AS diff_count, count(DISTINCT 'deploy ' || deploy_hash) AS changed, count(*) FILTER (regexp_matches(text, '(?i)\b(?:sync|blocking|sleep|requests\.|httpx\.|urllib)\b')) AS blocking_hints
    FROM (SELECT *, deploy_hash || ' ' || summary AS text, CASE WHEN deploy_id % 3 = 0 THEN 'a' END AS wanted FROM v_deploys) WHERE wanted IS NULL OR contains(lower(text), wanted) GROUP BY service""",
)
def corpus_deploy_findings(t: Load) -> DataFrame:
    items = t("v_deploys").select(
        "service", F.lit("deploy").alias("source_type"), F.concat_ws(" ", "deploy_hash", "summary").alias("text"), F.lit("d").alias("path"),
        F.concat(F.lit("deploy "), "deploy_hash").alias("section_title"), F.when(F.col("deploy_id") % 3 == 0, "a").alias("wanted"),
    )
    return inv.deploy_findings(items, ["service"], "wanted").select(
        "service", "diff_count", F.col("changed_count").alias("changed"), "blocking_hints"
    )


_FIND = f"""WITH RECURSIVE {rs.EVIDENCE}, ent AS (SELECT question_id, question, services[1] AS service, eps[1] AS endpoint_, hashes[1] AS hash, {sx.rules('lower(question)', vocab.SYMPTOM_RULES, 'NULL')} AS symptom FROM q),
  ev AS (SELECT e.question_id, e.n, e.chunk_id, e.path, e.source_type, e.txt AS text, e.service_name, e.timestamp_start, e.section_title, ent.service, ent.hash, ent.symptom FROM evid e JOIN ent USING (question_id))"""


def _found(t: Load) -> tuple[DataFrame, DataFrame]:
    asked = with_entities(with_intent(t("v_questions")))
    return asked, packed(t)


@query(
    "question_findings",
    _FIND + f""" SELECT question_id, count(*) AS evidence_count, CAST(coalesce(sum(slow) FILTER (source_type = 'logs'), 0) AS BIGINT) AS slow_requests, CAST(coalesce(sum(err) FILTER (source_type = 'logs'), 0) AS BIGINT) AS errors,
      CAST(coalesce(sum(tmo) FILTER (source_type = 'logs'), 0) AS BIGINT) AS timeouts, count(*) FILTER (source_type = 'logs' AND timestamp_start IS NOT NULL) AS timestamped_logs,
      count(*) FILTER (source_type = 'deploy' AND (hash IS NULL OR contains(lower(text), hash) OR contains(lower(path), hash))) AS diff_count, count(*) FILTER (source_type = 'incident') AS incident_count,
      string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS source_types FROM (SELECT *, {_LOG_COUNTS} FROM ev) GROUP BY question_id""",
)
def question_findings(t: Load) -> DataFrame:
    f = inv.findings(*_found(t)).where("evidence_count > 0")
    names = ("evidence_count", "slow_requests", "errors", "timeouts", "timestamped_logs", "diff_count", "incident_count")
    return f.select("question_id", *[big(n).alias(n) for n in names], joined("source_types").alias("source_types"))


@query(
    "incident_matches",
    _FIND + """ SELECT question_id, chunk_id, similarity, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, n) AS incident_rank FROM (SELECT question_id, chunk_id, n,
      least(round(0.35 + CASE WHEN contains(lower(text), service) THEN 0.25 ELSE 0 END + CASE WHEN contains(lower(text), symptom) THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(lower(text), 'root cause|timeline') THEN 0.1 ELSE 0 END, 6), 1.0)::DOUBLE AS similarity FROM ev WHERE source_type = 'incident')""",
)
def incident_matches(t: Load) -> DataFrame:
    asked, found = _found(t)
    joined_ = found.join(asked.select("question_id", "service", "symptom"), "question_id")
    return inv.incident_matches(joined_).select("question_id", "chunk_id", "similarity", big("incident_rank").alias("incident_rank"))


_SIMILAR = """(SELECT question_id, chunk_id, path, row_number() OVER (PARTITION BY question_id ORDER BY least(round(0.35 + CASE WHEN contains(lower(text), service) THEN 0.25 ELSE 0 END
      + CASE WHEN contains(lower(text), symptom) THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(lower(text), 'root cause|timeline') THEN 0.1 ELSE 0 END, 6), 1.0) DESC, n) AS k FROM ev WHERE source_type = 'incident')"""


@query(
    "investigation_timelines",
    _FIND + f""" SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY ts NULLS LAST, pos) AS seq, event_type, summary, coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S'), '') AS ts, chunk_id FROM (
      SELECT question_id, 'deploy' AS event_type, coalesce('deploy evidence found for ' || deploy_hash, 'deploy evidence found') AS summary, timestamp_start AS ts, chunk_id, n AS pos FROM evid WHERE source_type = 'deploy'
      UNION ALL SELECT question_id, 'log_signal', CASE WHEN contains(lower(txt), 'timeout') THEN 'timeout evidence appears in logs' WHEN contains(lower(txt), 'error') THEN 'error evidence appears in logs'
        WHEN contains(lower(txt), 'ms') THEN 'latency evidence appears in logs' ELSE 'log evidence found' END, timestamp_start, chunk_id, n FROM evid WHERE source_type = 'logs' AND timestamp_start IS NOT NULL
      UNION ALL SELECT question_id, 'similar_incident', 'similar previous incident found: ' || path, NULL, chunk_id, 2147483647 FROM {_SIMILAR} WHERE k = 1)""",
)
def investigation_timelines(t: Load) -> DataFrame:
    """Deploys, log signals and the best similar incident in time order."""
    asked, found = _found(t)
    matches = inv.incident_matches(found.join(asked.select("question_id", "service", "symptom"), "question_id"))
    line = inv.timeline(found, matches)
    return line.select("question_id", big("seq").alias("seq"), "event_type", "summary", stamp("ts").alias("ts"), "chunk_id")


@query("investigations")
def investigations(t: Load) -> DataFrame:
    """Full investigation per question."""
    stored, tables = index_tables(t)
    r = plan.investigate(t("v_questions"), stored, rs.TOP_K, **tables)
    return r.select(
        "question_id", "task_type", "intent", F.col("support.supported").cast("int").alias("supported"), F.col("root.hypothesis_id").alias("hypothesis"),
        F.col("root.summary").alias("summary"), F.col("level.confidence").alias("confidence"), joined("level.reasons", "|").alias("reasons"),
        joined("missing_data", "|").alias("missing_data"), joined("affected_services").alias("affected_services"), text("suggested_fix").alias("suggested_fix"), "answer",
        F.size("hypotheses").alias("hypotheses"),
    )


_WORKED = f"""SELECT question_id, coalesce(sum(slow) FILTER (source_type = 'logs'), 0) > 0 AND count(*) FILTER (source_type = 'deploy' AND (hash IS NULL OR contains(lower(text), hash) OR contains(lower(path), hash))) > 0 AS deployed,
      count(*) FILTER (source_type = 'incident') AS incidents FROM (SELECT *, {_LOG_COUNTS} FROM ev) GROUP BY question_id"""


@query(
    "workflow_answers",
    _FIND + f""" SELECT q.question_id, {sx.rules('lower(q.question)', vocab.TASK_RULES, "'generic_incident_question'")} AS task_type,
      CASE WHEN deployed THEN '{inv.HYPOTHESES[0][2]}' ELSE '{inv.NO_ROOT_CAUSE}' END AS summary,
      CASE WHEN deployed THEN 'Validate the leading hypothesis against deploy history, logs, and ownership documentation before taking action.' ELSE '' END AS suggested_fix,
      CASE WHEN incidents > 0 THEN '' ELSE 'No prior incident match reached confidence threshold.' END AS unknowns
    FROM v_questions q LEFT JOIN ({_WORKED}) f ON f.question_id = q.question_id""",
)
def workflow_answers(t: Load) -> DataFrame:
    """Final workflow record per question."""
    w = inv.workflow_answer(inv.findings(*_found(t)))
    return w.select("question_id", "task_type", F.col("root.summary").alias("summary"), text("suggested_fix").alias("suggested_fix"), joined("unknowns", "|").alias("unknowns"))


# --- evaluation -------------------------------------------------------------


def _cases(t: Load) -> tuple[DataFrame, DataFrame]:
    c = t("v_cases").select(
        "case_id", "project_id", "question", F.lit(None).cast("string").alias("query_class"), F.array("expected_a", "expected_b").alias("expected_documents"),
        F.array("term_a", "term_b").alias("expected_terms"), F.array("forbidden").alias("forbidden_terms"), F.array("wanted_type").alias("expected_source_types"),
        F.array("banned_type").alias("forbidden_source_types"),
    )
    # Ten documents at most share a case id, since document ids are unique.
    docs = t("v_prose").select(F.expr("doc_id div 10").alias("case_id"), "path", "source_type", "doc_id")
    o = docs.groupBy("case_id").agg(
        F.array_sort(F.collect_list("path")).alias("evidence_paths"), F.collect_set("source_type").alias("observed_types"),
        F.concat_ws(" ", F.lit("Database outage"), F.when(F.min("doc_id") % 20 == 0, "TIMEOUT")).alias("answer_payload"),
    )
    return c, o


_SCORED = f"""SELECT c.case_id, {sx.preference(sx.route('c.question'), 'intent')} AS query_class,
      (CAST(coalesce(len(list_filter(o.p, lambda x: contains(x, c.expected_a))), 0) > 0 AS INTEGER) + CAST(coalesce(len(list_filter(o.p, lambda x: contains(x, c.expected_b))), 0) > 0 AS INTEGER)) / 2.0 AS evidence_recall,
      CASE WHEN contains(coalesce(o.a, ''), 'timeout') THEN 0.5 ELSE 0.0 END AS term_coverage, CAST(contains(coalesce(o.a, ''), 'database outage') AS BIGINT) AS forbidden_hits,
      CASE WHEN list_contains(o.t, c.wanted_type) THEN 1.0 ELSE 0.0 END AS source_type_hit_rate, CAST(coalesce(list_contains(o.t, c.banned_type), false) AS BIGINT) AS wrong_types, coalesce(len(o.p), 0) AS retrieved, c.case_id % 7 * 100 + 40 AS latency_ms
    FROM v_cases c LEFT JOIN (SELECT doc_id // 10 AS case_id, list(path) AS p, list(DISTINCT source_type) AS t, lower('Database outage' || CASE WHEN min(doc_id) % 20 = 0 THEN ' TIMEOUT' ELSE '' END) AS a FROM v_prose GROUP BY 1) o ON o.case_id = c.case_id"""


@query("eval_case_scores", f"SELECT case_id, query_class, CAST(evidence_recall AS DOUBLE) AS evidence_recall, CAST(term_coverage AS DOUBLE) AS term_coverage, forbidden_hits, CAST(source_type_hit_rate AS DOUBLE) AS source_type_hit_rate, wrong_types, retrieved FROM ({_SCORED})")
def eval_case_scores(t: Load) -> DataFrame:
    s = evaluation.score_cases(*_cases(t))
    return s.select(
        "case_id", "query_class", "evidence_recall", "term_coverage", big(F.size("forbidden_hits")).alias("forbidden_hits"), "source_type_hit_rate",
        big(F.size("wrong_types")).alias("wrong_types"), big("retrieved").alias("retrieved"),
    )


@query(
    "eval_run_summary",
    f"""SELECT run, count(*) AS total_cases, round(avg(evidence_recall), 6) AS avg_recall, round(avg(term_coverage), 6) AS avg_terms, count(*) FILTER (forbidden_hits > 0) AS forbidden, round(avg(latency_ms), 6) AS avg_latency_ms,
      round(avg(CAST(wrong_types > 0 AS INTEGER)), 6) AS wrong_rate, count(*) FILTER (retrieved = 0) AS zero_results, CAST(sum(retrieved) AS BIGINT) AS citations,
      list_sort(list(latency_ms))[CAST(floor(0.5 * (count(*) - 1)) AS BIGINT) + 1] AS p50, list_sort(list(latency_ms))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS p95 FROM (SELECT *, 'r' || (case_id % 3) AS run FROM ({_SCORED})) GROUP BY run""",
)
def eval_run_summary(t: Load) -> DataFrame:
    s = evaluation.score_cases(*_cases(t)).withColumns(
        {"run": F.concat(F.lit("r"), F.col("case_id") % 3), "latency_ms": F.col("case_id") % 7 * 100 + 40, "error": F.lit(None).cast("string")}
    )
    r = evaluation.run_summary(s, ["run"])
    return r.select(
        "run", "total_cases", F.round("avg_evidence_recall", 6).alias("avg_recall"), F.round("avg_term_coverage", 6).alias("avg_terms"), F.col("forbidden_hit_count").alias("forbidden"),
        F.round("avg_latency_ms", 6).alias("avg_latency_ms"), F.round("wrong_source_type_rate", 6).alias("wrong_rate"), F.col("zero_result_count").alias("zero_results"),
        big("citation_count").alias("citations"), F.col("latency_p50_ms").alias("p50"), F.col("latency_p95_ms").alias("p95"),
    )


@query("evaluation_run")
def evaluation_run(t: Load) -> DataFrame:
    """Every case investigated and scored end to end."""
    stored, tables = index_tables(t)
    cases = _cases(t)[0]
    s = plan.evaluate(cases.withColumn("case_id", F.col("case_id").cast("string")), stored, rs.TOP_K, **tables)
    return s.select("case_id", "query_class", "evidence_recall", "term_coverage", "source_type_hit_rate", "retrieved")
