"""What a question asks for: entities, intent, task, symptom and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import vocab
from caseloom.defaults import DEFAULTS, Defaults
from caseloom.functions.patterns import (
    WORD, as_col, contains_any, find_all, first_match, first_of, flagged, has_term, let,
    lookup, strings,
)
from caseloom.functions.text import deploy_hash

_HEX = r"(?i)\b([a-f0-9]{6,40})\b"


def query_terms(question: Column | str) -> Column:
    tokens = find_all(F.lower(F.trim(as_col(question))), r"([a-z0-9_./-]+)")
    kept = F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(*vocab.QUERY_STOPWORDS))
    return F.slice(kept, 1, 30)


def endpoints(question: Column | str) -> Column:
    return find_all(question, rf"(/{WORD}[\p{{L}}\p{{N}}_/-]*)")


def deploy_hashes(question: Column | str) -> Column:
    bare = F.transform(find_all(question, _HEX), F.lower)
    return F.array_distinct(F.array_compact(F.concat(F.array(deploy_hash(question)), bare)))


def services(question: Column | str) -> Column:
    """Up to five names that are neither stop words, endpoints nor hashes."""
    names = find_all(
        F.lower(as_col(question)), r"\b([a-z][a-z0-9_-]{2,40})(?:\s+service)?\b"
    )
    taken = F.concat(endpoints(question), deploy_hashes(question))
    kept = let(
        taken,
        lambda seen: F.filter(
            names,
            lambda n: ~n.isin(*vocab.SERVICE_STOPWORDS)
            & ~n.startswith("http")
            & ~F.array_contains(seen, n),
        ),
    )
    return F.slice(F.array_distinct(kept), 1, 5)


def route(question: Column | str) -> Column:
    """Key of the preference row a question is routed to; first rule wins."""
    q = F.lower(F.trim(as_col(question)))
    located = has_term(q, vocab.CODE_TERMS) | contains_any(q, vocab.LOCATION_PHRASES)
    return first_of(
        [
            (has_term(q, vocab.HISTORY_TERMS), "history"),
            (has_term(q, vocab.RUNBOOK_TERMS), "runbook"),
            (located & ~has_term(q, vocab.API_TERMS + vocab.CONFIG_TERMS), "code"),
            (has_term(q, vocab.ROOT_CAUSE_TERMS), "root_cause"),
            (
                has_term(q, vocab.DEPLOY_TERMS) & ~has_term(q, ("where is", "where are")),
                "deploy",
            ),
            (has_term(q, vocab.RUNTIME_TERMS), "runtime"),
            (has_term(q, vocab.API_TERMS), "api"),
            (has_term(q, vocab.CONFIG_TERMS), "config"),
            (has_term(q, vocab.ARCHITECTURE_TERMS), "architecture"),
        ],
        "generic",
    )


def secondary_intents(question: Column | str, routed: Column | str) -> Column:
    q, routed = F.lower(F.trim(as_col(question))), as_col(routed)
    causes = flagged(
        [
            (has_term(q, vocab.RUNTIME_TERMS), "runtime_incident"),
            (has_term(q, vocab.DEPLOY_TERMS), "deploy_regression"),
            (has_term(q, vocab.HISTORY_TERMS), "previous_incident"),
        ]
    )
    return (
        F.when(routed == "root_cause", causes)
        .when(
            routed.isin("api", "config") & q.contains("implemented"), strings(("code_location",))
        )
        .otherwise(strings(()))
    )


def _preference(routed: Column, field: str) -> Column:
    return lookup(routed, {k: v[field] for k, v in vocab.INTENT_PREFERENCES.items()})


def with_intent(questions: DataFrame, text: str = "question") -> DataFrame:
    """Add intent, preferences and entities to every question in one projection."""
    routed = questions.withColumn("route", route(text))
    return routed.withColumns(
        {
            "intent": _preference(F.col("route"), "intent"),
            "secondary_intents": secondary_intents(text, "route"),
            "preferred_sources": _preference(F.col("route"), "sources"),
            "preferred_chunks": _preference(F.col("route"), "chunks"),
            "explanation": _preference(F.col("route"), "explanation"),
            "query_terms": query_terms(text),
            "services": services(text),
            "deploy_hashes": deploy_hashes(text),
            "endpoints": endpoints(text),
        }
    )


def investigation_support(intent: Column | str, available: Column | str) -> Column:
    """Struct of the verdict and its reasons for an intent and the types at hand."""
    intent, available = as_col(intent), as_col(available)
    lacking = lambda kind: ~F.array_contains(available, F.lit(kind))
    reason = first_of(
        [
            (
                intent.isin(*vocab.LOOKUP_INTENTS),
                "query intent is repo lookup rather than runtime incident investigation",
            ),
            (
                (intent == "runtime_incident") & lacking("logs"),
                "runtime investigation requires logs",
            ),
            (
                (intent == "deploy_regression") & lacking("deploy"),
                "deploy analysis requires deploy history or diffs",
            ),
            (
                (intent == "previous_incident") & lacking("incident"),
                "incident history lookup requires incident reports or postmortems",
            ),
        ]
    )
    return F.struct(reason.isNull().alias("supported"), F.array_compact(F.array(reason)).alias("reasons"))


def task_type(question: Column | str) -> Column:
    q = F.lower(as_col(question))
    return first_of(
        [(contains_any(q, tokens), label) for label, tokens in vocab.TASK_RULES],
        "generic_incident_question",
    )


def symptom(question: Column | str) -> Column:
    q = F.lower(as_col(question))
    return first_of([(contains_any(q, tokens), label) for label, tokens in vocab.SYMPTOM_RULES])


def time_window(question: Column | str) -> Column:
    return first_match(
        question, r"(?i)\b(last\s+\d+\s+(?:m|minutes|h|hours|d|days)|between\s+.+?)\b"
    )


def with_entities(questions: DataFrame, text: str = "question") -> DataFrame:
    """Investigation entities: first service, endpoint and hash, symptom, window."""
    return questions.withColumns(
        {
            "task_type": task_type(text),
            "service": F.get("services", F.lit(0)),
            "endpoint": F.get("endpoints", F.lit(0)),
            "deploy_hash": F.get("deploy_hashes", F.lit(0)),
            "symptom": symptom(text),
            "time_window": time_window(text),
        }
    )


def with_scope(questions: DataFrame, defaults: Defaults = DEFAULTS) -> DataFrame:
    """Filters, query variants and the deploy window that follow from the entities."""
    named = F.col("deploy_hash").isNotNull()
    default_window = F.when(
        named,
        F.format_string(
            "%s -%d/+%d min",
            F.col("deploy_hash"),
            F.lit(defaults.deploy_before_minutes),
            F.lit(defaults.deploy_after_minutes),
        ),
    )
    return questions.withColumns(
        {
            "filter_endpoint": F.col("endpoint"),
            "filter_deploy_hash": F.col("deploy_hash"),
            "query_variants": F.array_compact(
                F.array(
                    F.col("service"),
                    F.col("endpoint"),
                    F.concat(F.lit("deploy "), F.col("deploy_hash")),
                    F.replace("symptom", F.lit("_"), F.lit(" ")),
                )
            ),
            "scope_window": F.coalesce(F.col("time_window"), default_window),
        }
    )


def fetch_budget(intent: Column | str, top_k: int, defaults: Defaults = DEFAULTS) -> Column:
    """Candidates fetched per branch."""
    base = max(1, defaults.candidate_multiplier)
    factor = (
        F.when(as_col(intent).isin(*vocab.EXACT_INTENTS), 3)
        .when(
            as_col(intent).isin("runtime_incident", "deploy_regression"),
            max(base, defaults.incident_multiplier),
        )
        .otherwise(base)
    )
    return F.greatest(factor * top_k, F.lit(defaults.min_fetch))


def fetch_ceiling(top_k: int, defaults: Defaults = DEFAULTS) -> int:
    """The largest budget that ``fetch_budget`` gives any intent."""
    factor = max(3, 1, defaults.candidate_multiplier, defaults.incident_multiplier)
    return max(factor * top_k, defaults.min_fetch)


def admit(questions: DataFrame, text: str = "question", top_k: str = "top_k",
          defaults: Defaults = DEFAULTS) -> DataFrame:
    """Tag questions beyond the length or result limits with a reject reason."""
    return questions.withColumn(
        "reject_reason",
        first_of(
            [
                (F.length(text) > defaults.max_query_length, "query_too_long"),
                (F.col(top_k) > defaults.max_top_k, "top_k_too_large"),
            ]
        ),
    )
