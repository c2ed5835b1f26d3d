"""Rank fusion, metadata boosts and retrieval diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom import vocab
from caseloom.defaults import DEFAULTS, Defaults
from caseloom.functions.patterns import contains_any, first_of, lookup
from caseloom.functions.text import metadata_tokens
from caseloom.operators.matching import top_per

BRANCHES = ("vector", "lexical", "metadata", "graph")


def chunk_source_type(metadata: Column | str = "metadata", chunk_type: Column | str = "chunk_type",
                      path: Column | str = "path") -> Column:
    """Evidence type used in fusion; unknown chunks stay unknown."""
    raw = F.try_element_at(metadata, F.lit("source_type"))
    kind = F.lower(F.coalesce(F.col(chunk_type) if isinstance(chunk_type, str) else chunk_type, F.lit("")))
    lower = F.lower(F.coalesce(F.col(path) if isinstance(path, str) else path, F.lit("")))
    rules = [
        (raw.isNotNull(), F.coalesce(lookup(raw, vocab.RETRIEVAL_SOURCE_ALIASES), raw)),
        *[(kind.isin(*kinds), name) for name, kinds in vocab.CHUNK_SOURCE.items()],
        (
            kind.isin(*vocab.MARKDOWN_CHUNKS),
            F.when(lower.contains("api") | lower.contains("swagger"), "api_doc").otherwise("runbook"),
        ),
    ]
    return first_of(rules, "unknown_text")


def packed_source_type(metadata: Column | str = "metadata", chunk_type: Column | str = "chunk_type",
                       path: Column | str = "path") -> Column:
    """Evidence type used when packing; unknown chunks count as runbooks."""
    raw = F.try_element_at(metadata, F.lit("source_type"))
    kind = F.coalesce(F.col(chunk_type) if isinstance(chunk_type, str) else chunk_type, F.lit(""))
    lower = F.lower(F.coalesce(F.col(path) if isinstance(path, str) else path, F.lit("")))
    known = [t for t in vocab.SOURCE_TYPES if t != "unknown_text"]
    rules = [
        (raw.isin(*known), raw),
        (raw == "incident_report", "incident"),
        (raw == "deploy_history", "deploy"),
        *[(kind.isin(*kinds), name) for name, kinds in vocab.CHUNK_SOURCE.items()],
        (
            kind.isin(*vocab.MARKDOWN_CHUNKS),
            first_of(
                [
                    (lower.contains("runbook"), "runbook"),
                    (contains_any(lower, ("api", "swagger")), "api_doc"),
                    (lower.rlike(r"\.(?:yaml|yml|json|toml|ini)$"), "config"),
                ],
                "runbook",
            ),
        ),
    ]
    return first_of(rules, "runbook")


def metadata_term_set() -> Column:
    """Distinct tokens of the descriptive metadata of a chunk."""
    scalars = [F.try_element_at("metadata", F.lit(k)) for k in vocab.METADATA_SCALAR_TERMS]
    lists = [
        F.array_join(F.try_element_at("metadata_lists", F.lit(k)), " ")
        for k in vocab.METADATA_LIST_TERMS
    ]
    return F.array_distinct(metadata_tokens(F.concat_ws(" ", *scalars, *lists)))


def union_branches(**branches: DataFrame) -> DataFrame:
    """Branch candidates as one table ``question_id, chunk_id, branch, score, rank``."""
    parts = [
        frame.select(
            "question_id", "project_id", "chunk_id", F.lit(name).alias("branch"),
            F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"),
        )
        for name, frame in branches.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def rank_branches(candidates: DataFrame) -> DataFrame:
    """One-based rank of each candidate in its branch."""
    return top_per(
        candidates, ["question_id", "branch"], [F.desc("score"), F.asc("chunk_id")], 2**31 - 1
    )


def drop_redundant_vectors(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """Vector candidates of exact lookups count only where no other branch has any.

    One window per question decides; the fusion that follows groups inside the
    same partitions, so this costs no shuffle of its own.
    """
    exact = questions.select("question_id", F.col("intent").isin(*vocab.EXACT_INTENTS).alias("_exact"))
    is_vector = F.col("branch") == "vector"
    others = F.max((~is_vector).cast("int")).over(Window.partitionBy("question_id"))
    return (
        candidates.join(exact, "question_id")
        .withColumn("_others", others)
        .where(~(is_vector & F.col("_exact") & (F.col("_others") == 1)))
        .drop("_exact", "_others")
    )


def weighted_rrf(candidates: DataFrame, defaults: Defaults = DEFAULTS) -> DataFrame:
    """Weighted reciprocal-rank fusion: one shuffle on question and chunk.

    Each branch's part is taken out by itself and the parts are added in a
    fixed order, so that a score does not depend on the order of the rows.
    """
    weights = {
        "vector": defaults.vector_weight, "lexical": defaults.lexical_weight,
        "metadata": defaults.metadata_weight, "graph": defaults.graph_weight,
    }
    of = lambda branch, value: F.max(F.when(F.col("branch") == branch, F.col(value)))
    fused = candidates.groupBy("question_id", "project_id", "chunk_id").agg(
        *[of(b, "score").alias(f"{b}_score") for b in BRANCHES],
        *[of(b, "rank").alias(f"{b}_rank") for b in BRANCHES],
    )
    part = lambda b: F.coalesce(
        F.lit(max(weights[b], 0.0)) / (max(defaults.rrf_k, 1) + F.col(f"{b}_rank")) * 100, F.lit(0.0)
    )
    total = reduce(lambda a, b: a + b, [part(b) for b in BRANCHES])
    return fused.withColumns(
        {
            **{f"{b}_score": F.coalesce(f"{b}_score", F.lit(0.0)) for b in BRANCHES},
            "rrf_score": total,
        }
    )


def boost_facts() -> dict[str, Column]:
    """What the rules test of a chunk. It does not depend on the question, so it is worked out once per chunk."""
    kind, path = F.lower(F.coalesce("chunk_type", F.lit(""))), F.lower(F.coalesce("path", F.lit("")))
    listed = lambda k: F.coalesce(F.size(F.try_element_at("metadata_lists", F.lit(k))), F.lit(0)) > 0
    meta = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit("")) != ""
    return {
        "chunk_kind": kind,
        "kind_boost": F.coalesce(lookup(kind, vocab.CHUNK_BOOSTS), F.lit(vocab.DEFAULT_CHUNK_BOOST)),
        "lower_hash": F.lower("deploy_hash"),
        "lower_service": F.lower("service_name"),
        "config_path": contains_any(path, vocab.CONFIG_PATH_CUES),
        "api_path": contains_any(path, vocab.API_PATH_CUES),
        "doc_path": contains_any(path, vocab.DOC_PATH_CUES),
        "code_path": contains_any(path, vocab.CODE_PATH_CUES),
        "readme_path": path.contains("readme.md"),
        "log_marks": meta("timestamp_start") | listed("log_levels") | listed("trace_ids"),
        "incident_marks": meta("incident_date") | meta("has_root_cause"),
    }


def boost_rules() -> list[tuple[Column, Column, Column]]:
    """(condition, delta, reason) rules over a candidate, with the facts of its chunk, next to its question."""
    intent, source, kind = F.col("intent"), F.col("evidence_type"), F.col("chunk_kind")
    has = lambda names, value: F.coalesce(F.array_contains(F.col(names), F.col(value)), F.lit(False))
    endpoint = F.col("chunk_endpoint")
    touching = F.coalesce(
        F.exists("endpoints", lambda e: F.contains(endpoint, e) | F.contains(e, endpoint)),
        F.lit(False),
    ) & (F.coalesce(endpoint, F.lit("")) != "")
    matched = F.col("matched")
    on = lambda name: intent == name
    text = F.lit
    return [
        (has("deploy_hashes", "lower_hash"), F.lit(0.18), text("deploy_hash_match")),
        (has("services", "lower_service"), F.lit(0.12), text("service_name_match")),
        (touching, F.lit(0.12), text("endpoint_match")),
        (
            F.array_contains("preferred_sources", source), F.lit(0.16),
            F.concat(F.lit("intent_source:"), source),
        ),
        (
            F.array_contains("preferred_chunks", kind), F.col("kind_boost"),
            F.concat(F.lit("intent_chunk:"), kind),
        ),
        (
            F.size(matched) > 0, F.least(F.size(matched), F.lit(3)) * 0.05,
            F.concat(F.lit("metadata_terms:"), F.array_join(matched, ",")),
        ),
        (
            on("config_lookup") & F.col("config_path"), F.lit(0.12),
            text("config_path_match"),
        ),
        (
            on("api_contract") & F.col("api_path"), F.lit(0.12),
            text("api_contract_path_match"),
        ),
        (
            on("architecture") & F.col("doc_path"), F.lit(0.10),
            text("architecture_doc_match"),
        ),
        (
            on("code_location") & F.col("code_path"), F.lit(0.06),
            text("code_path_match"),
        ),
        (
            on("runtime_incident") & (source == "logs") & F.col("log_marks"), F.lit(0.08), text("runtime_log_metadata"),
        ),
        (
            on("deploy_regression") & (source == "deploy"), F.lit(0.08),
            text("deploy_regression_source"),
        ),
        (
            on("previous_incident") & (source == "incident") & F.col("incident_marks"), F.lit(0.08), text("incident_metadata"),
        ),
        (on("runbook_lookup") & (source == "runbook"), F.lit(0.08), text("runbook_source")),
        (
            ~intent.isin("architecture", "generic") & F.col("readme_path"), F.lit(-0.10),
            text("readme_penalty"),
        ),
        (
            intent.isin("code_location", "api_contract") & (source == "runbook"), F.lit(-0.24),
            text("wrong_intent_runbook_penalty"),
        ),
        (on("config_lookup") & (source == "runbook"), F.lit(-0.12), text("generic_runbook_penalty")),
    ]


CHUNK_COLUMNS = (
    "path", "chunk_type", "service_name", "deploy_hash", "endpoint", "section_title", "start_line",
    "end_line", "timestamp_start", "timestamp_end", "text", "metadata", "metadata_lists",
)
QUESTION_COLUMNS = (
    "question", "intent", "preferred_sources", "preferred_chunks", "query_terms", "services",
    "deploy_hashes", "endpoints",
)


def boost(fused: DataFrame, questions: DataFrame, chunks: DataFrame,
          defaults: Defaults = DEFAULTS) -> DataFrame:
    """Add the capped metadata boost, its reasons and the fused score."""
    held = boost_facts()
    facts = chunks.withColumns({"evidence_type": chunk_source_type(), "terms": metadata_term_set(), **held}).select(
        "project_id", "chunk_id", "evidence_type", "terms", *held,
        *[F.col(c) for c in CHUNK_COLUMNS if c not in ("service_name", "deploy_hash", "endpoint", "text")],
        F.col("service_name").alias("chunk_service"),
        F.col("deploy_hash").alias("chunk_hash"),
        F.col("endpoint").alias("chunk_endpoint"),
    )
    joined = (
        fused.join(facts, ["project_id", "chunk_id"])
        .join(questions.select("question_id", *QUESTION_COLUMNS), "question_id")
    )
    rules = boost_rules()
    fires = [f"_fires{k}" for k in range(len(rules))]
    total = reduce(lambda a, b: a + b, [F.when(F.col(f), delta.cast("double")).otherwise(0.0) for f, (_, delta, _) in zip(fires, rules, strict=True)])
    boosted = (
        joined.withColumn("matched", F.slice(
            F.array_sort(F.array_intersect(F.array_distinct("query_terms"), "terms")), 1, 4
        ))
        .withColumns({f: holds for f, (holds, _, _) in zip(fires, rules, strict=True)})
        .withColumns(
            {
                "metadata_boost": F.least(total, F.lit(defaults.boost_cap)),
                "reasons": F.array_compact(F.array(*[F.when(F.col(f), reason) for f, (_, _, reason) in zip(fires, rules, strict=True)])),
            }
        )
    )
    return boosted.withColumn("fused_score", F.col("rrf_score") + F.col("metadata_boost")).drop(
        "terms", "matched", *held, *fires, "preferred_sources", "preferred_chunks", "query_terms",
        "services", "deploy_hashes", "endpoints", "metadata_lists",
    )


def rank_fused(boosted: DataFrame, limit: int) -> DataFrame:
    """Best candidates per question by fused score, ties by chunk id."""
    return top_per(
        boosted.withColumn("_order", F.round("fused_score", 6)),
        ["question_id"], [F.desc("_order"), F.asc("chunk_id")], limit,
    ).drop("_order")


def evidence_mix(ranked: DataFrame, column: str) -> DataFrame:
    """Counts of one type column per question."""
    return ranked.groupBy("question_id", F.coalesce(column, F.lit("unknown")).alias("type")).agg(
        F.count("*").alias("n")
    )


def reason_counts(ranked: DataFrame) -> DataFrame:
    """How often each boost and penalty was applied, per question."""
    return (
        ranked.select("question_id", F.explode("reasons").alias("reason"))
        .groupBy("question_id", "reason")
        .agg(F.count("*").alias("n"))
        .withColumn(
            "direction", F.when(F.contains("reason", F.lit("penalty")), "penalty").otherwise("boost")
        )
    )


def top_rejected(ranked: DataFrame, top_k: int) -> DataFrame:
    """The five candidates after the cut, with the reason they missed it."""
    return ranked.where(F.col("rank").between(top_k + 1, top_k + 5)).select(
        "question_id", "rank", "chunk_id", "path", "evidence_type",
        F.round("fused_score", 4).alias("score"),
        F.when(F.col("fused_score") < 0.15, "low_fused_score")
        .otherwise("below_top_k_after_score_merge")
        .alias("reason"),
    )


def branch_counts(candidates: DataFrame) -> DataFrame:
    """Candidates per branch and distinct candidates per question."""
    per_chunk = candidates.groupBy("question_id", "chunk_id").agg(
        *[F.max((F.col("branch") == b).cast("int")).alias(b) for b in BRANCHES]
    )
    return per_chunk.groupBy("question_id").agg(
        *[F.sum(b).alias(f"{b}_candidates") for b in BRANCHES], F.count("*").alias("merged")
    )


