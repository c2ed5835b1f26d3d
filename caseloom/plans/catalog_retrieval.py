"""Queries for embeddings, the retrieval branches, fusion, evidence and answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.questions import fetch_ceiling, with_entities, with_intent, with_scope
from caseloom.operators import cells, embedding, evidence, fusion, lexical, metadata_search, relations, rerank, vector
from caseloom.plans import retrieval, retrieval_sql as rs
from caseloom.plans.corpus import chunk_table as corpus, index_tables
from caseloom.plans.registry import Load, big, flag, joined, query, text
from caseloom.session import checkpoint_root, cut_lineage


def asked(t: Load) -> DataFrame:
    return cut_lineage(retrieval.prepare(t("v_questions"), rs.WIDE))


MOST = fetch_ceiling(rs.WIDE)


def hybrid(t: Load, keep: int = rs.WIDE, questions: DataFrame | None = None) -> retrieval.Retrieval:
    stored, tables = index_tables(t)
    return retrieval.hybrid_search(t("v_questions") if questions is None else questions, stored, rs.WIDE, keep=keep, **tables)


def scoped(t: Load) -> DataFrame:
    """Questions with the filters that follow from what they name, as investigations ask them."""
    return with_scope(with_entities(with_intent(t("v_questions"))))


def packed(t: Load) -> DataFrame:
    stored, tables = index_tables(t)
    return retrieval.search(t("v_questions"), stored, rs.TOP_K, **tables)


# --- embeddings -------------------------------------------------------------


@query(
    "hash_embedding_cells",
    f"SELECT doc_id, idx, round(v, 6) AS value FROM ({rs.hashed('documents', 'doc_id', 'text')})",
)
def hash_embedding_cells(t: Load) -> DataFrame:
    cells = embedding.hashed_terms(t("documents"), "doc_id", "text")
    return cells.select("doc_id", F.col("index").alias("idx"), F.round("value", 6).alias("value"))


@query(
    "batch_embedding_model",
    f"SELECT doc_id, idx, round(v, 6) AS value FROM ({rs.hashed('v_md_docs', 'doc_id', 'content')})",
)
def batch_embedding_model(t: Load) -> DataFrame:
    vectors = t("v_md_docs").select("doc_id", embedding.embed_column("content").alias("v"))
    cells = vectors.select("doc_id", F.posexplode("v").alias("idx", "x")).where("x <> 0")
    return cells.select("doc_id", "idx", F.round("x", 6).alias("value"))


@query(
    "embedding_reuse",
    """SELECT sha256('current:hash:' || sha256(content)) AS embedding_key, count(*) AS rows_served, 384 AS width FROM v_docs
    WHERE content NOT IN (SELECT content FROM v_docs WHERE doc_id % 3 = 0) GROUP BY content""",
)
def embedding_reuse(t: Load) -> DataFrame:
    docs = t("v_docs").select("doc_id", F.col("content").alias("text"))
    _, seen = embedding.embed_with_reuse(docs.where("doc_id % 3 = 0"), docs.select(F.lit("").alias("embedding_key")))
    fresh, keyed = embedding.embed_with_reuse(docs, seen.select("embedding_key").distinct())
    return fresh.join(keyed, "embedding_key").groupBy("embedding_key").agg(F.count("*").alias("rows_served"), F.max(F.size("vector")).alias("width"))


@query(
    "token_vector_mean_pooling",
    """SELECT label, i - 1 AS pos, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL""",
)
def token_vector_mean_pooling(t: Load) -> DataFrame:
    pooled = embedding.mean_pool(t("embeddings").withColumn("vector", F.col("embedding").cast("array<double>")), "label")
    return pooled.select("label", F.posexplode("vector").alias("pos", "m")).select(
        "label", big("pos").alias("pos"), F.round("m", 6).alias("mean")
    )


@query(
    "vector_top_k",
    """SELECT question_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT 'v' || a.vec_id AS question_id, 'v' || b.vec_id AS chunk_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
      FROM embeddings a JOIN embeddings b ON a.label = b.label)) WHERE rank <= 5""",
)
def vector_top_k(t: Load) -> DataFrame:
    points = t("embeddings").select(
        F.concat(F.lit("p"), "label").alias("project_id"), F.concat(F.lit("v"), "vec_id").alias("chunk_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    wanted = points.withColumnRenamed("chunk_id", "question_id").withColumn("fetch_k", F.lit(5))
    hits = vector.vector_search(wanted, points, 64)
    return hits.select("question_id", "chunk_id", "score", big("rank").alias("rank"))


@query(
    "vector_hit_reconciliation",
    """SELECT chunk_id, path, rank FROM (SELECT 'o' || o_orderkey AS chunk_id, project_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders JOIN (SELECT deploy_id AS o_orderkey, project_id FROM v_deploys) USING (o_orderkey)) h
    JOIN (SELECT chunk_id, path, project_id FROM v_facts) f USING (chunk_id, project_id)""",
)
def vector_hit_reconciliation(t: Load) -> DataFrame:
    from caseloom.operators.matching import top_per

    owners = t("v_deploys").select(F.col("deploy_id").alias("o_orderkey"), "project_id")
    hits = t("orders").join(owners, "o_orderkey").select(
        "project_id", F.concat(F.lit("o"), "o_orderkey").alias("chunk_id"), "o_custkey", "o_totalprice", "o_orderkey"
    )
    ranked = top_per(hits, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2**31 - 1)
    return vector.reconcile(ranked, t("v_facts")).select("chunk_id", "path", big("rank").alias("rank"))


# --- branches ---------------------------------------------------------------

_TOP = "SELECT question_id, chunk_id, round(score, 6) AS score, rk AS rank FROM "


def _branch(hits: DataFrame) -> DataFrame:
    return hits.select("question_id", "chunk_id", F.round("score", 6).alias("score"), big("rank").alias("rank"))


@query("lexical_search", f"WITH {rs.BASE}, {rs.LEX_CTES} {_TOP} lex")
def lexical_search(t: Load) -> DataFrame:
    q, (c, tables) = asked(t), index_tables(t, "index")
    return _branch(lexical.best(lexical.lexical_search(q, c, tables["index"], MOST), MOST))


@query(
    "lexical_search_filtered",
    f"""WITH {rs.BASE}, {rs.LEX_CTES.replace(f"lex AS (SELECT * FROM ({rs.LEX}) WHERE rk <= fetch_k)", f"raw AS ({rs.LEX})")}
    SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank
    FROM raw JOIN ch USING (chunk_id) JOIN q USING (question_id) WHERE (q.hashes[1] IS NULL OR deploy_hash = q.hashes[1]) AND (q.eps[1] IS NULL OR endpoint = q.eps[1]) QUALIFY rank <= min(q.fetch_k) OVER (PARTITION BY question_id)""",
)
def lexical_search_filtered(t: Load) -> DataFrame:
    q = asked(t).withColumns(
        {"filter_deploy_hash": F.get("deploy_hashes", F.lit(0)), "filter_endpoint": F.get("endpoints", F.lit(0))}
    )
    c, tables = index_tables(t, "index")
    return _branch(lexical.best(lexical.lexical_search(q, c, tables["index"], MOST), MOST))


@query(
    "lexical_source_reindex",
    f"""SELECT source_id, count(*) AS chunks, CAST(sum(len(s)) AS BIGINT) AS places, CAST(sum(len(list_distinct(s))) AS BIGINT) AS stems
    FROM (SELECT source_id, {rs.sx.stems('text')} AS s FROM ({rs.CH})) GROUP BY source_id""",
)
def lexical_source_reindex(t: Load) -> DataFrame:
    """A stored index with one stale source, after that source was written anew in place."""
    stored, tables = index_tables(t, "index")
    spark, path = stored.sparkSession, f"{checkpoint_root(stored.sparkSession)}/reindex-{uuid.uuid4().hex}"
    stale = tables["index"].where((F.col("source_id") != "deploys") | (F.element_at("places", 1) == 1))
    lexical.write_index(stale, path)
    lexical.replace_source(path, "deploys", stored.where("source_id = 'deploys'"))
    by_chunk = lexical.read_index(spark, path).groupBy("source_id", "project_id", "chunk_id").agg(
        F.sum(F.size("places")).alias("places"), F.count("*").alias("stems")
    )
    return by_chunk.groupBy("source_id").agg(F.count("*").alias("chunks"), big(F.sum("places")).alias("places"), big(F.sum("stems")).alias("stems"))


@query("metadata_search", f"WITH {rs.BASE}, {rs.META_CTES} {_TOP} meta")
def metadata_branch(t: Load) -> DataFrame:
    return _branch(metadata_search.metadata_search(asked(t), corpus(t), MOST))


@query(
    "evidence_relations",
    f"WITH ch AS ({rs.CH}) SELECT project_id, chunk_id, relation_type, from_key, to_key FROM ({rs.EDGES})",
)
def evidence_relations(t: Load) -> DataFrame:
    edges = relations.derive_relations(corpus(t))
    return edges.select("project_id", F.col("evidence_chunk_id").alias("chunk_id"), "relation_type", "from_key", "to_key")


@query(
    "relation_evidence_join",
    f"""WITH ch AS ({rs.CH}) SELECT relation_type, c.chunk_type, count(*) AS n FROM ({rs.EDGES}) e JOIN ch c USING (project_id, chunk_id) GROUP BY ALL""",
)
def relation_evidence_join(t: Load) -> DataFrame:
    c = corpus(t)
    edges = relations.derive_relations(c).select("project_id", F.col("evidence_chunk_id").alias("chunk_id"), "relation_type")
    return edges.join(c.select("project_id", "chunk_id", "chunk_type"), ["project_id", "chunk_id"]).groupBy("relation_type", "chunk_type").agg(
        F.count("*").alias("n")
    )


@query("graph_search", f"WITH {rs.BASE}, {rs.GRAPH_CTES} {_TOP} graph")
def graph_branch(t: Load) -> DataFrame:
    return _branch(relations.graph_search(asked(t), index_tables(t, "edges")[1]["edges"], MOST))


@query("vector_search_text", f"WITH {rs.BASE}, {rs.VEC_CTES.split('vec AS')[0].rstrip().rstrip(',')} {_TOP} near")
def vector_search_text(t: Load) -> DataFrame:
    q = asked(t).select("question_id", "project_id", "fetch_k", embedding.embed_column("question").alias("vector"))
    return _branch(vector.vector_search(q, index_tables(t, "vectors")[1]["vectors"], most=MOST))


@query("vector_cell_search")
def vector_cell_search(t: Load) -> DataFrame:
    """What probing cells finds of the exact result at rank 30, and which share of the points it reads, per question."""
    points = index_tables(t, "vectors")[1]["vectors"]
    trained = cells.train(points)
    path = f"{checkpoint_root(points.sparkSession)}/cells-{uuid.uuid4().hex}"
    cells.write_cells(points.withColumnRenamed("chunk_id", "id"), trained, path)
    stored = cells.read_cells(points.sparkSession, path)
    q = cut_lineage(t("v_questions").select("question_id", "project_id", F.lit(30).alias("fetch_k"), embedding.embed_column("question").alias("vector")))
    near = cells.cell_search(q, stored, trained)
    exact = vector.vector_search(q, points)
    counted = cells.recall(near, exact)
    return counted.select("question_id", "wanted", "found", F.round(F.col("found") / F.col("wanted"), 6).alias("recall"))


# --- fusion -----------------------------------------------------------------


@query("branch_candidates", f"WITH {rs.HYBRID} SELECT question_id, chunk_id, branch, round(score, 6) AS score, rk AS rank FROM cand")
def branch_candidates(t: Load) -> DataFrame:
    return hybrid(t).candidates.select("question_id", "chunk_id", "branch", F.round("score", 6).alias("score"), big("rank").alias("rank"))


@query(
    "reciprocal_rank_fusion",
    """SELECT question_id, chunk_id, round(coalesce(0.4 / (60 + max(rk) FILTER (branch = 'vector')) * 100, 0.0) + coalesce(0.3 / (60 + max(rk) FILTER (branch = 'lexical')) * 100, 0.0)
      + coalesce(0.2 / (60 + max(rk) FILTER (branch = 'metadata')) * 100, 0.0) + coalesce(0.1 / (60 + max(rk) FILTER (branch = 'graph')) * 100, 0.0), 6) AS rrf FROM (
      SELECT question_id, chunk_id, branch, row_number() OVER (PARTITION BY question_id, branch ORDER BY score DESC, chunk_id) AS rk FROM (
        SELECT 'q' || l_suppkey AS question_id, 'c' || l_partkey AS chunk_id, CASE l_linenumber % 4 WHEN 0 THEN 'vector' WHEN 1 THEN 'lexical' WHEN 2 THEN 'metadata' ELSE 'graph' END AS branch,
          max(l_extendedprice) AS score FROM lineitem GROUP BY ALL)) GROUP BY ALL""",
)
def reciprocal_rank_fusion(t: Load) -> DataFrame:
    raw = t("lineitem").select(
        F.concat(F.lit("q"), "l_suppkey").alias("question_id"), F.lit("p").alias("project_id"), F.concat(F.lit("c"), "l_partkey").alias("chunk_id"),
        F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'vector' WHEN 1 THEN 'lexical' WHEN 2 THEN 'metadata' ELSE 'graph' END").alias("branch"),
        F.col("l_extendedprice").alias("score"),
    ).groupBy("question_id", "project_id", "chunk_id", "branch").agg(F.max("score").alias("score"))
    fused = fusion.weighted_rrf(fusion.rank_branches(raw))
    return fused.select("question_id", "chunk_id", F.round("rrf_score", 6).alias("rrf"))


_RANKED = f"""SELECT question_id, chunk_id, rank, round(rrf, 6) AS rrf, round(boost, 6) AS boost, round(fs, 6) AS fused, array_to_string(reasons, '|') AS reasons,
  round(vs, 6) AS vector_score, round(ls, 6) AS lexical_score, round(ms, 6) AS metadata_score, round(gs, 6) AS graph_score FROM ranked WHERE rank <= {rs.WIDE}"""


def _ranked(r: DataFrame) -> DataFrame:
    return r.select(
        "question_id", "chunk_id", big("rank").alias("rank"), F.round("rrf_score", 6).alias("rrf"), F.round("metadata_boost", 6).alias("boost"),
        F.round("fused_score", 6).alias("fused"), joined("reasons", "|").alias("reasons"),
        *[F.round(f"{b}_score", 6).alias(f"{b}_score") for b in fusion.BRANCHES],
    )


@query("hybrid_search", f"WITH {rs.HYBRID} {_RANKED}")
def hybrid_search(t: Load) -> DataFrame:
    return _ranked(hybrid(t).ranked)


@query("hybrid_search_filtered", f"WITH {rs.HYBRID_FILTERED} {_RANKED}")
def hybrid_search_filtered(t: Load) -> DataFrame:
    """Questions that filter by endpoint or deploy hash among questions that do not."""
    return _ranked(hybrid(t, questions=scoped(t)).ranked)


@query(
    "branch_candidates_filtered",
    f"WITH {rs.HYBRID_FILTERED} SELECT question_id, chunk_id, branch, round(score, 6) AS score, rk AS rank FROM cand",
)
def branch_candidates_filtered(t: Load) -> DataFrame:
    return hybrid(t, questions=scoped(t)).candidates.select("question_id", "chunk_id", "branch", F.round("score", 6).alias("score"), big("rank").alias("rank"))


@query(
    "vector_search_filtered",
    """SELECT question_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT 'v' || a.vec_id AS question_id, 'v' || b.vec_id AS chunk_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
      FROM embeddings a JOIN embeddings b ON a.vec_id % 3 = 0 OR (b.label = a.label AND (a.vec_id % 3 = 1 OR b.vec_id % 5 = a.vec_id % 5)))) WHERE rank <= 7""",
)
def vector_search_filtered(t: Load) -> DataFrame:
    """Free questions, questions with one filter and with two, in one scan of all vectors."""
    points = t("embeddings").select(
        F.lit("p").alias("project_id"), F.concat(F.lit("v"), "vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"),
        F.concat(F.lit("s"), "label").alias("service_name"), F.concat(F.lit("d"), F.col("vec_id") % 5).alias("deploy_hash"), "vec_id",
    )
    wanted = points.select(
        "project_id", F.col("chunk_id").alias("question_id"), "vector", F.lit(7).alias("fetch_k"),
        F.when(F.col("vec_id") % 3 != 0, F.col("service_name")).alias("filter_service_name"),
        F.when(F.col("vec_id") % 3 == 2, F.col("deploy_hash")).alias("filter_deploy_hash"),
    )
    hits = vector.vector_search(wanted, points, 64)
    return hits.select("question_id", "chunk_id", "score", big("rank").alias("rank"))


@query(
    "retrieval_evidence_mix",
    f"""WITH {rs.HYBRID} SELECT question_id, 'source' AS kind, source_type AS type, count(*) AS n FROM ranked WHERE rank <= {rs.WIDE} GROUP BY ALL
    UNION ALL SELECT question_id, 'chunk', chunk_type, count(*) FROM ranked WHERE rank <= {rs.WIDE} GROUP BY ALL""",
)
def retrieval_evidence_mix(t: Load) -> DataFrame:
    r = hybrid(t).ranked
    both = r.select(
        "question_id",
        F.inline(
            F.array(
                F.struct(F.lit("source").alias("kind"), F.col("evidence_type").alias("type")),
                F.struct(F.lit("chunk").alias("kind"), F.col("chunk_type").alias("type")),
            )
        ),
    )
    return both.groupBy("question_id", "kind", "type").agg(F.count("*").alias("n"))


@query(
    "retrieval_reason_counts",
    f"""WITH {rs.HYBRID} SELECT question_id, reason, CASE WHEN contains(reason, 'penalty') THEN 'penalty' ELSE 'boost' END AS direction, count(*) AS n
    FROM (SELECT question_id, unnest(reasons) AS reason FROM ranked WHERE rank <= {rs.WIDE}) GROUP BY ALL""",
)
def retrieval_reason_counts(t: Load) -> DataFrame:
    return fusion.reason_counts(hybrid(t).ranked).select("question_id", "reason", "direction", "n")


@query(
    "retrieval_top_rejected",
    f"""WITH {rs.HYBRID} SELECT question_id, rank, chunk_id, round(fs, 4) AS score, CASE WHEN fs < 0.15 THEN 'low_fused_score' ELSE 'below_top_k_after_score_merge' END AS reason
    FROM ranked WHERE rank BETWEEN {rs.WIDE + 1} AND {rs.WIDE + 5}""",
)
def retrieval_top_rejected(t: Load) -> DataFrame:
    r = fusion.top_rejected(hybrid(t, rs.WIDE + 5).ranked, rs.WIDE)
    return r.select("question_id", big("rank").alias("rank"), "chunk_id", "score", "reason")


@query(
    "retrieval_candidate_counts",
    f"""WITH {rs.HYBRID} SELECT question_id, count(*) FILTER (branch = 'vector') AS vector_candidates, count(*) FILTER (branch = 'lexical') AS lexical_candidates,
      count(*) FILTER (branch = 'metadata') AS metadata_candidates, count(*) FILTER (branch = 'graph') AS graph_candidates, count(DISTINCT chunk_id) AS merged FROM cand GROUP BY question_id""",
)
def retrieval_candidate_counts(t: Load) -> DataFrame:
    return fusion.branch_counts(hybrid(t).candidates)


@query(
    "retrieval_budgets",
    f"SELECT question_id, CASE WHEN intent IN ('runtime_incident', 'deploy_regression') THEN 120 ELSE 90 END AS fetch_k FROM ({rs.Q})",
)
def retrieval_budgets(t: Load) -> DataFrame:
    return asked(t).select("question_id", "fetch_k")


# --- reranking and evidence -------------------------------------------------


@query(
    "rerank_decisions",
    f"WITH {rs.HYBRID}, {rs.RERANK_CTES} SELECT question_id, gap, CAST(decisive AS BIGINT) AS decisive FROM decided",
)
def rerank_decisions(t: Load) -> DataFrame:
    d = rerank.with_decision(hybrid(t).ranked).where("rank = 1")
    return d.select("question_id", F.col("score_gap").alias("gap"), flag("decisive").alias("decisive"))


def length_scorer():
    """A stand-in for a relevance model: shorter texts score higher."""
    return lambda questions, texts: [1000.0 / (1 + len(x)) for x in texts]


@query(
    "rerank_with_model",
    f"""WITH {rs.HYBRID}, {rs.RERANK_CTES}, placed AS (SELECT question_id, chunk_id, CASE WHEN decisive THEN 'heuristic' ELSE 'cross_encoder' END AS mode,
        CASE WHEN NOT decisive AND rank <= 20 THEN 0 ELSE 1 END AS part, round(CASE WHEN NOT decisive AND rank <= 20 THEN 1000.0 / (1 + length(substr(text, 1, 1600))) ELSE fs END, 6) AS s
      FROM top JOIN decided USING (question_id))
    SELECT question_id, chunk_id, final_rank, mode FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY part, s DESC, chunk_id) AS final_rank FROM placed) WHERE final_rank <= {rs.TOP_K}""",
)
def rerank_with_model(t: Load) -> DataFrame:
    found = hybrid(t)
    ranked = retrieval.with_text(found.ranked, found.chunks)
    r = rerank.rerank(ranked, rs.TOP_K, length_scorer)
    return r.select("question_id", "chunk_id", big("final_rank").alias("final_rank"), F.col("rerank_mode").alias("mode"))


_EVIDENCE_SQL = rs.EVIDENCE


@query(
    "search_results",
    f"""WITH RECURSIVE {_EVIDENCE_SQL} SELECT question_id, n AS rank, chunk_id, source_type, path, coalesce(service_name, '') AS service, coalesce(endpoint, '') AS endpoint,
      round(fs, 4) AS score, substr(txt, 1, 300) AS text_preview, label, lines FROM evid""",
)
def search_results(t: Load) -> DataFrame:
    hits = evidence.search_hits(packed(t))
    return hits.select(
        "question_id", big("rank").alias("rank"), "chunk_id", "source_type", "path", text("service_name").alias("service"), text("endpoint").alias("endpoint"),
        "score", "text_preview", "label", "lines",
    )


@query(
    "packed_evidence",
    f"""WITH RECURSIVE {_EVIDENCE_SQL} SELECT question_id, n, chunk_id, md5(txt) AS digest, length(txt) AS chars, label || ' ' || path || CASE WHEN lines = '' THEN '' ELSE ':' || lines END AS citation,
      CASE WHEN regexp_matches(txt, '(?i)ignore previous instructions') THEN 1 ELSE 0 END AS flagged FROM evid""",
)
def packed_evidence(t: Load) -> DataFrame:
    e = packed(t)
    return e.select(
        "question_id", big("n").alias("n"), "chunk_id", F.md5("text").alias("digest"), big(F.length("text")).alias("chars"), "citation",
        flag(F.array_contains("injection_flags", F.lit("ignore previous instructions"))).alias("flagged"),
    )


@query(
    "citation_blocks",
    f"""WITH RECURSIVE {_EVIDENCE_SQL} SELECT question_id, string_agg(label || ' ' || path || ':' || lines, chr(10) ORDER BY n) AS block FROM evid GROUP BY question_id""",
)
def citation_blocks(t: Load) -> DataFrame:
    return evidence.citations_block(packed(t))


@query(
    "evidence_class_filters",
    f"""WITH RECURSIVE {_EVIDENCE_SQL} SELECT question_id, chunk_id, CASE source_type WHEN 'logs' THEN 'logs' WHEN 'incident' THEN 'incidents' ELSE 'deploys' END AS class FROM evid JOIN q USING (question_id)
    WHERE source_type IN ('logs', 'incident') OR (source_type = 'deploy' AND (q.hashes[1] IS NULL OR contains(path, q.hashes[1]) OR contains(txt, q.hashes[1])))""",
)
def evidence_class_filters(t: Load) -> DataFrame:
    q = with_intent(t("v_questions")).select("question_id", F.get("deploy_hashes", F.lit(0)).alias("wanted"))
    e = packed(t).join(q, "question_id")
    of = lambda frame, name: frame.select("question_id", "chunk_id", F.lit(name).alias("class"))
    return (
        of(evidence.log_evidence(e), "logs")
        .unionByName(of(evidence.incident_evidence(e), "incidents"))
        .unionByName(of(evidence.deploy_evidence(e, "wanted"), "deploys"))
    )


@query(
    "retrieval_run_log",
    f"""WITH {rs.HYBRID} SELECT 'run-' || question_id AS retrieval_run_id, chunk_id, round(vs, 6) AS vector_score, round(ls, 6) AS lexical_score, round(fs, 6) AS fused_score, rank FROM ranked WHERE rank <= {rs.TOP_K}""",
)
def retrieval_run_log(t: Load) -> DataFrame:
    from caseloom.operators.store import log_retrieval

    ranked = rerank.rerank(hybrid(t).ranked, rs.TOP_K)
    logged = log_retrieval(ranked, F.concat(F.lit("run-"), "question_id"))
    return logged.select(
        "retrieval_run_id", "chunk_id", *[F.round(c, 6).alias(c) for c in ("vector_score", "lexical_score", "fused_score")], big("rank").alias("rank")
    )


@query(
    "direct_lookup_candidates",
    f"""WITH {rs.HYBRID} SELECT question_id, chunk_id, CAST(CASE intent WHEN 'code_location' THEN source_type IN ('code', 'api_doc') OR regexp_matches(lower(path), '\\.(py|go|ts|tsx|js|jsx|java|proto)$')
        WHEN 'config_lookup' THEN source_type IN ('config', 'deploy', 'runbook', 'code') OR regexp_matches(lower(path), '\\.(yaml|yml|json|toml|ini|env)$')
        WHEN 'api_contract' THEN source_type IN ('api_doc', 'code') OR chunk_type IN ('proto_service') ELSE false END AS BIGINT) AS direct FROM ranked WHERE rank <= {rs.WIDE}""",
)
def direct_lookup_candidates(t: Load) -> DataFrame:
    from caseloom.operators.answers import is_direct

    r = hybrid(t).ranked.withColumn("raw_source_type", F.try_element_at("metadata", F.lit("source_type")))
    return r.select("question_id", "chunk_id", flag(is_direct()).alias("direct"))


@query("answers")
def answers(t: Load) -> DataFrame:
    """Answer mode and text per question."""
    stored, tables = index_tables(t)
    a = retrieval.answer(t("v_questions"), stored, rs.TOP_K, **tables)
    return a.select(
        "question_id", "intent", "synthesis_mode", text("summary").alias("summary"), text("confidence").alias("confidence"), text("answer_text").alias("answer_text"),
        joined("affected_services").alias("affected_services"), text("citations").alias("citations"), joined("warnings", "|").alias("warnings"), joined("unknowns", "|").alias("unknowns"),
    )


@query("answer_prompts")
def answer_prompts(t: Load) -> DataFrame:
    """Prompt text per question, with every source wrapped as untrusted."""
    from caseloom.operators.answers import answer_prompts as build

    q = with_intent(t("v_questions")).withColumn("warnings", F.array(F.lit("runtime logs are missing from the retrieved evidence")))
    return build(q, packed(t))


