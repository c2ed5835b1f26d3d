"""Evidence relations: deterministic edges between paths, symbols and owners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import vocab
from caseloom.operators.matching import contains_join, top_per
from caseloom.session import cut_lineage


def derive_relations(chunks: DataFrame) -> DataFrame:
    """Up to six edges per chunk; keys are cut at 512 characters.

    Needs ``project_id, chunk_id, path, chunk_type, service_name, endpoint,
    deploy_hash, metadata``. Edges carry their chunk id and the six forms
    differ, so none can repeat and no de-duplication shuffle is needed.
    """
    path_key = F.concat(F.lit("path:"), F.coalesce("path", F.lit("")))
    meta = lambda k: F.nullif(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    symbol = F.coalesce(meta("symbol_name"), meta("symbol"))
    named = lambda kind, value: F.concat(F.lit(f"{kind}:"), F.nullif(value, F.lit("")))

    def edge(relation: str, source, target):
        return F.when(
            source.isNotNull() & target.isNotNull(),
            F.struct(
                F.lit(relation).alias("relation_type"),
                F.substring(source, 1, 512).alias("from_key"),
                F.substring(target, 1, 512).alias("to_key"),
            ),
        )

    edges = F.array_compact(
        F.array(
            edge("contains", path_key, F.concat(F.lit("chunk:"), F.col("chunk_id"))),
            edge("contains", named("service", F.col("service_name")), path_key),
            edge("contains", named("package", meta("package_name")), path_key),
            edge("defines", path_key, F.concat(F.lit("symbol:"), symbol)),
            edge("implements", path_key, named("endpoint", F.col("endpoint"))),
            edge("changed_by", path_key, named("deploy", F.col("deploy_hash"))),
        )
    )
    return chunks.select(
        "project_id",
        F.col("chunk_id").alias("evidence_chunk_id"),
        "chunk_type",
        F.col("path").alias("document_path"),
        F.coalesce(F.try_element_at("metadata", F.lit("source_type")), F.lit("unknown_text")).alias(
            "source_type"
        ),
        F.inline(edges),
    )


def graph_terms(questions: DataFrame) -> DataFrame:
    """Up to eight lower-cased terms per question, services allowed to be shorter."""
    services = F.transform("services", F.lower)
    values = F.transform(F.concat("services", "endpoints", "query_terms"), F.lower)
    kept = F.filter(
        values,
        lambda v: (F.length(v) >= F.when(F.array_contains(services, v), 3).otherwise(4))
        & ~v.isin(*vocab.GRAPH_IGNORED_TERMS),
    )
    return questions.withColumn("graph_terms", F.slice(F.array_sort(F.array_distinct(kept)), 1, 8))


def graph_search(questions: DataFrame, relations: DataFrame, most: int | None = None) -> DataFrame:
    """Chunks on edges whose keys mention a term of an architecture question.

    Terms are matched against the distinct keys first, and edges are sorted by
    the asked terms that their keys mention. Edges of a project that mention the
    same terms score alike for every question, so of each such class only the
    first ``most`` chunks can be among any results. Questions with the same
    terms are one search, which scores classes. Work grows with the edges and
    the answers, not with their product.
    """
    asked = graph_terms(questions.where(F.col("intent") == "architecture")).select(
        "question_id", "project_id", "fetch_k", "graph_terms"
    )
    # Numbers of searches are fixed by writing them.
    searches = cut_lineage(
        asked.groupBy("project_id", "graph_terms").agg(F.max("fetch_k").alias("fetch_k")).withColumn("search", F.monotonically_increasing_id())
    )
    terms = searches.select("search", "project_id", "fetch_k", F.explode("graph_terms").alias("term"))
    edges = relations.select(
        "project_id", F.col("evidence_chunk_id").alias("chunk_id"), "relation_type",
        F.lower("from_key").alias("from_key"), F.lower("to_key").alias("to_key"),
    )
    keys = (
        edges.select("project_id", F.explode(F.array("from_key", "to_key")).alias("key")).distinct()
    )
    hits = contains_join(keys, "key", terms.select("project_id", "term").distinct(), "term", ["project_id"], 3)
    # Joined to both sides of an edge; the keys are searched once.
    held = cut_lineage(hits.groupBy("project_id", "key").agg(F.collect_set("term").alias("held")))
    of = lambda side: held.select("project_id", F.col("key").alias(f"{side}_key"), F.col("held").alias(f"{side}_held"))
    none = F.expr("cast(array() as array<string>)")
    both = F.array_sort(F.array_union(F.coalesce("from_held", none), F.coalesce("to_held", none)))
    mentioned = (
        edges.join(of("from"), ["project_id", "from_key"], "left").join(of("to"), ["project_id", "to_key"], "left")
        .select("project_id", both.alias("held"), "relation_type", "chunk_id").where(F.size("held") > 0).distinct()
    )
    classes = ["project_id", "held", "relation_type"]
    first = mentioned if most is None else top_per(mentioned, classes, [F.asc("chunk_id")], most).drop("rank")
    first = cut_lineage(first)
    scored = (
        first.select(*classes).distinct().withColumn("term", F.explode("held")).join(terms, ["project_id", "term"])
        .groupBy("search", "fetch_k", *classes).agg(F.count("*").alias("n"))
    )
    score = F.col("n").cast("double") + F.when(F.col("relation_type").isin("defines", "implements"), 1.0).otherwise(0.0)
    best = (
        scored.join(first, classes).groupBy("search", "fetch_k", "chunk_id")
        .agg(F.max(F.struct(score.alias("score"), "relation_type")).alias("best"))
        .select("search", "chunk_id", "fetch_k", "best.*")
    )
    order = [F.desc("score"), F.asc("chunk_id")]
    top = top_per(best, ["search"], order, F.col("fetch_k"), most=most).drop("fetch_k", "rank")
    owners = asked.distinct().join(searches.drop("fetch_k"), ["project_id", "graph_terms"])
    found = owners.select("search", "question_id", "project_id", "fetch_k").join(top, "search")
    return top_per(
        found.select("question_id", "project_id", "chunk_id", "fetch_k", "score", "relation_type"),
        ["question_id"], order, F.col("fetch_k"), most=most,
    )
