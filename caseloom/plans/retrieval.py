"""Retrieval plans over a table of questions and a table of chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.defaults import DEFAULTS, Defaults
from caseloom.functions.questions import fetch_budget, fetch_ceiling, investigation_support, with_intent
from caseloom.operators import answers, fusion, lexical, metadata_search, relations, vector
from caseloom.operators.embedding import embed_column
from caseloom.operators.evidence import pack_evidence
from caseloom.operators.filters import PAYLOAD, active_filters
from caseloom.operators.rerank import rerank
from caseloom.session import cut_lineage


@dataclass(frozen=True)
class Retrieval:
    """Questions with their intent, branch candidates, the chunks these name, and ranked results.

    Chunks are looked up when they are first asked for, so that who reads
    candidates alone does not wait for them.
    """

    questions: DataFrame
    candidates: DataFrame
    corpus: DataFrame
    keep: int
    defaults: Defaults = DEFAULTS

    @cached_property
    def chunks(self) -> DataFrame:
        return named_chunks(self.candidates, self.corpus)

    @cached_property
    def ranked(self) -> DataFrame:
        fused = fusion.weighted_rrf(self.candidates, self.defaults)
        return fusion.rank_fused(fusion.boost(fused, self.questions, self.chunks, self.defaults), self.keep)


def prepare(questions: DataFrame, top_k: int, defaults: Defaults = DEFAULTS) -> DataFrame:
    """Intent, entities and fetch budget of every question."""
    typed = questions if "intent" in questions.columns else with_intent(questions)
    return typed.withColumn("fetch_k", fetch_budget("intent", top_k, defaults).cast("int"))


def embed_chunks(chunks: DataFrame) -> DataFrame:
    """Points for chunks where no table of points exists yet."""
    return chunks.select("project_id", "chunk_id", *PAYLOAD, embed_column("text").alias("vector"))


def hybrid_search(questions: DataFrame, chunks: DataFrame, top_k: int, *,
                  vectors: DataFrame | None = None, edges: DataFrame | None = None,
                  index: DataFrame | None = None, keep: int | None = None,
                  defaults: Defaults = DEFAULTS) -> Retrieval:
    """Vector, lexical, metadata and graph candidates, fused and boosted.

    All questions are answered in one plan. Vector hits of exact-lookup
    questions count only where the other branches found nothing. Vectors,
    edges and the lexical index are tables in a maintained corpus and derived
    here otherwise. A question's filters hold in the vector, lexical and
    metadata branches, before any of them is cut to its budget.
    """
    # Every branch reads the questions; their intent is worked out once.
    asked = cut_lineage(prepare(questions, top_k, defaults))
    vectors = embed_chunks(chunks) if vectors is None else vectors
    edges = relations.derive_relations(chunks) if edges is None else edges
    embedded = asked.select(
        "question_id", "project_id", "fetch_k", *active_filters(asked), embed_column("question").alias("vector")
    )
    most = fetch_ceiling(top_k, defaults)
    lexical_hits = lexical.best(lexical.lexical_search(asked, chunks, index, most), most)
    metadata_hits = metadata_search.metadata_search(asked, chunks, most)
    graph_hits = relations.graph_search(asked, edges, most)
    near = vector.vector_search(embedded, vectors, defaults.embedding_dim, most=most, version=defaults.index_version)
    every = fusion.union_branches(
        vector=near, lexical=lexical_hits, metadata=metadata_hits, graph=graph_hits
    )
    # Bounded by the fetch budgets; written once, since fusion and reports read it.
    candidates = cut_lineage(fusion.drop_redundant_vectors(every, asked))
    return Retrieval(asked, candidates, chunks, keep or top_k, defaults)


#: Ids of at most so many candidates are sent to the chunk table's scan.
SENT_IDS = 500_000


def named_chunks(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """All columns of the chunks that candidates name, looked up once.

    The ids go to the scan of the chunk table while they are few, so that no
    text is shuffled; beyond that both sides are. Boosts, filters and texts of
    results then read these rows instead of the corpus.
    """
    ids = cut_lineage(candidates.select("project_id", "chunk_id").distinct())
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    return cut_lineage(chunks.join(F.broadcast(ids) if few else ids, ["project_id", "chunk_id"], "left_semi"))


def with_text(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Bring text and filter columns back to the few candidates that are kept."""
    return ranked.join(
        chunks.select("project_id", "chunk_id", "text", "service_name", "deploy_hash", "endpoint"),
        ["project_id", "chunk_id"],
    )


def search(questions: DataFrame, chunks: DataFrame, top_k: int = DEFAULTS.top_k, *,
           scorer: Callable | None = None, defaults: Defaults = DEFAULTS, **tables: DataFrame) -> DataFrame:
    """Cited evidence for every question."""
    wide = max(top_k * 3, 30)
    found = hybrid_search(questions, chunks, wide, defaults=defaults, **tables)
    ranked = with_text(found.ranked, found.chunks)
    return pack_evidence(rerank(ranked, top_k, scorer, defaults), top_k)


def support_by_question(asked: DataFrame, ranked: DataFrame) -> DataFrame:
    """Questions with the declared types of their results and the support verdict."""
    types = answers.raw_source_types(ranked)
    empty: Column = F.expr("cast(array() as array<string>)")
    return asked.join(types, "question_id", "left").withColumn(
        "raw_types", F.coalesce("raw_types", empty)
    ).withColumn("raw_support", investigation_support("intent", "raw_types"))


def answer(questions: DataFrame, chunks: DataFrame, top_k: int = DEFAULTS.top_k, *,
           scorer: Callable | None = None, defaults: Defaults = DEFAULTS, **tables: DataFrame) -> DataFrame:
    """One answer per question; no model is called."""
    wide = max(top_k * 3, 30)
    found = hybrid_search(questions, chunks, wide, defaults=defaults, **tables)
    # A few dozen rows per question, read again by reranking and packing.
    ranked = cut_lineage(with_text(found.ranked, found.chunks))
    judged = support_by_question(found.questions, ranked)
    flags = judged.select(
        "question_id", answers.skips_rerank(F.col("intent"), F.col("raw_support.supported")).alias("skip")
    )
    limit = max(top_k * 3, defaults.answer_max_chunks * 2)
    ordered = rerank(ranked.join(flags, "question_id"), limit, scorer, defaults, ~F.col("skip"))
    return answers.assemble_answers(judged, cut_lineage(ordered.drop("skip")), top_k, defaults)
