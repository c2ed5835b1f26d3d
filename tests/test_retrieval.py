from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import cells, embedding, fusion, lexical, matching, metadata_search, vector


def test_contains_join_equals_brute_force(spark):
    hay = [f"services/svc{i}/handler_{i % 7}.py" for i in range(60)]
    needles = ["svc1", "handler_3", "vices", "nothing", ".py"]
    left = spark.createDataFrame([("p", h) for h in hay], "project_id string, text string")
    right = spark.createDataFrame([("p", n) for n in needles], "project_id string, needle string")
    got = {(r.text, r.needle) for r in matching.contains_join(left, "text", right, "needle", ["project_id"], 3).collect()}
    assert got == {(h, n) for h in hay for n in needles if n in h}


def test_vector_search_in_blocks_equals_numpy(spark):
    rng = np.random.default_rng(7)
    vectors, asked = rng.normal(size=(80, 8)), rng.normal(size=(9, 8))
    frame = spark.createDataFrame([("p", f"c{i:02d}", v.tolist()) for i, v in enumerate(vectors)], "project_id string, chunk_id string, vector array<double>")
    q = spark.createDataFrame([("p", f"q{i}", v.tolist(), 4) for i, v in enumerate(asked)], "project_id string, question_id string, vector array<double>, fetch_k int")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(asked) @ unit(vectors).T, 6)
    want = {(f"q{i}", f"c{j:02d}") for i in range(9) for j in np.lexsort((np.arange(80), -scores[i]))[:4]}
    hits = vector.vector_search(q, frame, 8, block_bytes=3 * 8 * 8)
    assert {(r.question_id, r.chunk_id) for r in hits.collect()} == want


def test_hash_embedding_forms_agree(spark):
    texts = spark.createDataFrame([(1, "error timeout error"), (2, "deploy abc")], "id int, text string")
    cells = {(r["id"], r["index"]): r["value"] for r in embedding.hashed_terms(texts, "id", "text").collect()}
    rows = texts.select("id", embedding.embed_column("text").alias("v")).collect()
    dense = {(r.id, i): x for r in rows for i, x in enumerate(r.v) if x}
    assert cells.keys() == dense.keys() and all(abs(cells[k] - dense[k]) < 1e-12 for k in cells)


def test_cover_density_prefers_close_terms(spark):
    frame = spark.createDataFrame([(["deploy", "x", "timeout"],), (["deploy", "x", "x", "x", "timeout"],)], "s array<string>")
    scores = [r.v for r in frame.select(lexical.cover_density("s", F.array(F.lit("timeout"), F.lit("deploy"))).alias("v")).collect()]
    assert scores == [1 / 3, 1 / 5]


def test_agreement_between_branches_wins(spark):
    rows = [("q", "p", "a", "vector", 0.9, 1), ("q", "p", "b", "vector", 0.8, 2), ("q", "p", "b", "lexical", 1.0, 1)]
    frame = spark.createDataFrame(rows, "question_id string, project_id string, chunk_id string, branch string, score double, rank int")
    best = fusion.weighted_rrf(frame).orderBy(F.desc("rrf_score")).first()
    assert best.chunk_id == "b"


def test_small_rows_are_spread_over_tasks(spark, sf_dir, monkeypatch):
    from caseloom.operators import chunkers
    from caseloom.plans.catalog import QUERIES

    monkeypatch.setattr(matching, "TASK_ROWS", 50)
    frame = spark.range(0, 420, 1, 1)
    sizes = matching.spread(frame).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 9 and max(r["count"] for r in sizes) <= 60 and sum(r["count"] for r in sizes) == 420
    assert matching.spread(frame.limit(50)).rdd.getNumPartitions() == 1
    tasks = []
    monkeypatch.setattr(chunkers, "emit", lambda docs, chunks, f=chunkers.emit: tasks.append(docs.rdd.getNumPartitions()) or f(docs, chunks))
    QUERIES["code_declarations"](spark, sf_dir)
    QUERIES["code_declarations_quoted"](spark, sf_dir)
    assert min(tasks) > 1


def test_dense_sequence_handles_one_hot_key(spark):
    frame = spark.range(1000).select(F.lit("hot").alias("k"), "id")
    rows = matching.dense_sequence(frame, ["k"], ["id"], F.floor(F.col("id") / 100)).collect()
    assert all(r.sequence_no == r.id + 1 for r in rows)


def test_large_budgets_are_kept_and_checked(spark):
    frame = spark.range(1000).select(F.lit("q").alias("k"), "id", F.lit(500).alias("fetch_k"))
    assert matching.top_per(frame, ["k"], [F.asc("id")], F.col("fetch_k")).count() == 500
    assert matching.top_per(frame, ["k"], [F.asc("id")], F.col("fetch_k"), most=600).count() == 500
    with pytest.raises(Exception, match="a budget exceeds 400"):
        matching.top_per(frame, ["k"], [F.asc("id")], F.col("fetch_k"), most=400).collect()


def _metadata_brute(questions, chunks):
    """Every pair, scored and cut, in plain Python."""
    out = set()
    for q, services, hashes, endpoints, terms, k in questions:
        terms = sorted({t.lower() for t in terms if len(t) >= 4})[:8]
        scored = []
        for c, service, deploy, endpoint, path, symbol in chunks:
            s, h = service is not None and service.lower() in services, deploy in hashes
            e = endpoint is not None and any(x in endpoint.lower() for x in endpoints)
            y, p = bool(symbol) and symbol.lower() in terms, sum(t in path.lower() for t in terms)
            if s or h or e or y or p:
                scored.append((-(4.0 * s + 4.0 * h + 5.0 * e + 3.0 * y + min(2, p)), c))
        out |= {(q, c, -x) for x, c in sorted(scored)[:k]}
    return out


def test_metadata_kinds_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "svc1"]
    chunks = [
        (f"c{i:03d}", rng.choice(["Svc1", "svc2", None]), rng.choice(["abc1234", None, None, None]), rng.choice(["/v1/alpha", None, None]),
         "/".join(rng.sample(words, rng.randrange(4))), rng.choice(["", "", "Gamma"]))
        for i in range(300)
    ]
    questions = [
        (f"q{i}", rng.sample(["svc1", "svc2"], rng.randrange(3)), rng.sample(["abc1234"], rng.randrange(2)), rng.sample(["/v1"], rng.randrange(2)),
         rng.sample(words, rng.randrange(5)), rng.choice([3, 10, 40]))
        for i in range(40)
    ]
    frame = spark.createDataFrame([("p", *c) for c in chunks], "project_id string, chunk_id string, service_name string, deploy_hash string, endpoint string, path string, symbol string")
    frame = frame.withColumns({
        "chunk_type": F.lit("x"), "metadata": F.create_map(F.lit("symbol"), F.col("symbol")),
        "metadata_lists": F.expr("cast(map() as map<string, array<string>>)"),
    })
    asked = spark.createDataFrame(
        [("p", *q) for q in questions],
        "project_id string, question_id string, services array<string>, deploy_hashes array<string>, endpoints array<string>, query_terms array<string>, fetch_k int",
    )
    hits = metadata_search.metadata_search(asked, frame, 40).collect()
    assert {(r.question_id, r.chunk_id, r.score) for r in hits} == _metadata_brute(questions, chunks)
    # A filter that all chunks pass changes nothing.
    filtered = asked.withColumn("filter_chunk_type", F.when(F.col("question_id") != "q3", "x"))
    again = metadata_search.metadata_search(filtered, frame, 40).collect()
    assert {(r.question_id, r.chunk_id, r.score) for r in again} == {(r.question_id, r.chunk_id, r.score) for r in hits}
    # Filters by service, hash or both hold before the cut, whichever questions ask for them.
    filtered = asked.withColumns({
        "filter_service_name": F.when(F.crc32("question_id") % 3 == 0, "svc2").otherwise(F.lit("")),
        "filter_deploy_hash": F.when(F.crc32("question_id") % 4 == 0, "abc1234"),
    })
    rows = {r.question_id: (r.filter_service_name, r.filter_deploy_hash) for r in filtered.collect()}
    want = set()
    for q in questions:
        service, deploy = rows[q[0]]
        own = [c for c in chunks if (not service or c[1] == service) and (deploy is None or c[2] == deploy)]
        want |= _metadata_brute([q], own)
    again = metadata_search.metadata_search(filtered, frame, 40).collect()
    assert {(r.question_id, r.chunk_id, r.score) for r in again} == want and len(want) > 100


def test_filters_hold_before_the_vector_cut(spark):
    """One vector in a hundred passes the filter, and stands last without it."""
    rows = [("p", f"c{k:03d}", [1.0, k / 100], None if k else "/v1/rare") for k in range(100)]
    points = spark.createDataFrame(rows, "project_id string, chunk_id string, vector array<double>, endpoint string")
    asked = spark.createDataFrame(
        [("p", "q1", [0.0, 1.0], 30, "/v1/rare"), ("p", "q2", [0.0, 1.0], 30, None), ("p", "q3", [0.0, 1.0], 30, "/none")],
        "project_id string, question_id string, vector array<double>, fetch_k int, filter_endpoint string",
    )
    found = vector.vector_search(asked, points, 2).collect()
    assert [r.chunk_id for r in found if r.question_id == "q1"] == ["c000"]
    assert {r.chunk_id for r in found if r.question_id == "q2"} == {f"c{k:03d}" for k in range(70, 100)}
    assert not [r for r in found if r.question_id == "q3"]
    with pytest.raises(ValueError, match="payload"):
        vector.vector_search(asked.withColumnRenamed("filter_endpoint", "filter_chunk_type"), points, 2)


def test_filtered_vector_search_equals_numpy(spark):
    """Ties, several projects, filters alone and together, in one block and in many."""
    rng = np.random.default_rng(11)
    vectors = np.round(rng.normal(size=(400, 4)), 0)
    rows = [(f"p{k % 3}", f"c{k:03d}", v.tolist(), f"s{k % 5}", f"t{k % 2}") for k, v in enumerate(vectors)]
    points = spark.createDataFrame(rows, "project_id string, chunk_id string, vector array<double>, service_name string, chunk_type string").repartition(5)
    asked = [
        (f"p{k % 4}", f"q{k:02d}", np.round(rng.normal(size=4), 1).tolist(), int(rng.integers(1, 60)), None if k % 2 else f"s{k % 6}", None if k % 3 else f"t{k % 2}")
        for k in range(40)
    ]
    frame = spark.createDataFrame(asked, "project_id string, question_id string, vector array<double>, fetch_k int, filter_service_name string, filter_chunk_type string")
    want = set()
    for project, question, v, k, service, kind in asked:
        own = [(c, x) for p, c, x, s, t in rows if p == project and service in (None, s) and kind in (None, t)]
        length = lambda x: np.linalg.norm(x) or 1.0
        scored = sorted((-round(float(np.dot(np.array(x) / length(x), np.array(v) / length(v))), 6), c) for c, x in own)
        want |= {(question, c, -x) for x, c in scored[:k]}
    for size in (vector.BLOCK_BYTES, 7 * 4 * 8):
        found = vector.vector_search(frame, points, 4, block_bytes=size).collect()
        assert {(r.question_id, r.chunk_id) for r in found} == {w[:2] for w in want}
        assert np.allclose(sorted(r.score for r in found), sorted(w[2] for w in want), atol=2e-6)


def test_stored_points_are_read_by_partition(spark, tmp_path):
    chunks = spark.createDataFrame([(f"p{k % 4}", f"c{k}", [1.0, float(k)]) for k in range(20)], "project_id string, chunk_id string, vector array<double>")
    none = {c: F.lit(None).cast("string") for c in ("source_id", "document_id", "chunk_type", "path", "service_name", "endpoint", "deploy_hash")}
    chunks = chunks.withColumns({**none, "metadata": F.expr("cast(map() as map<string, string>)")})
    path = str(tmp_path / "points")
    vector.write_points(vector.vector_points(chunks), path)
    vector.write_points(vector.vector_points(chunks, "old"), path)
    points = vector.read_points(spark, path)
    assert points.count() == 40
    asked = spark.createDataFrame([("p1", "q", [0.0, 1.0], 3)], "project_id string, question_id string, vector array<double>, fetch_k int")
    kept = vector.asked_partitions(points, asked, "current")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(index_version" in plan and "PushedFilters: []" in plan
    assert len(kept.inputFiles()) > 0 and {r.chunk_id for r in kept.collect()} == {"c1", "c5", "c9", "c13", "c17"}
    assert {r.chunk_id for r in vector.vector_search(asked, points, 2).collect()} == {"c17", "c13", "c9"}


def _lexical_chunks(spark, n=60):
    rng = random.Random(3)
    words = ["deploy", "timeout", "latency", "the", "queue", "a", "checkout", "errors"]
    rows = [(f"p{k % 2}", f"s{k % 3}", f"c{k:02d}", " ".join(rng.choices(words, k=rng.randrange(0, 30))), f"v{k % 4}") for k in range(n)]
    return spark.createDataFrame(rows, "project_id string, source_id string, chunk_id string, text string, service_name string")


def test_postings_hold_every_place(spark):
    chunks = _lexical_chunks(spark)
    stems = {r.chunk_id: r.s for r in chunks.select("chunk_id", lexical.positions("text").alias("s")).collect()}
    held = {c: [None] * len(s) for c, s in stems.items()}
    for r in lexical.lexical_index(chunks).collect():
        for at in r.places:
            assert held[r.chunk_id][at - 1] is None
            held[r.chunk_id][at - 1] = r.term
    assert held == stems


def test_stored_index_gives_the_same_hits_and_reads_asked_buckets(spark, tmp_path):
    chunks, path = _lexical_chunks(spark), str(tmp_path / "index")
    lexical.write_index(lexical.lexical_index(chunks), path)
    index = lexical.read_index(spark, path)
    asked = spark.createDataFrame(
        [("q1", "p0", "deploy timeout", 5, None), ("q2", "p1", "checkout latency errors", 50, "v1"), ("q3", "p0", "the a", 5, None), ("q4", "p1", "unknown", 5, None)],
        "question_id string, project_id string, question string, fetch_k int, filter_service_name string",
    )
    hits = {tuple(r) for r in lexical.lexical_search(asked, chunks).collect()}
    assert hits and hits == {tuple(r) for r in lexical.lexical_search(asked, chunks, index).collect()}
    stems = chunks.select("project_id", "chunk_id", "service_name", lexical.positions("text").alias("s")).collect()
    want = {
        (q.question_id, c.chunk_id)
        for q in asked.withColumn("w", lexical.terms("question")).collect() for c in stems
        if q.w and q.project_id == c.project_id and set(q.w) <= set(c.s) and q.filter_service_name in (None, c.service_name)
    }
    assert {(h[0], h[2]) for h in hits} == want
    one = lexical.lexical_search(asked.limit(1), chunks, index)
    plan = one._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"ReadSchema: struct<[^>]*places", plan)


def test_replacing_a_source_leaves_other_files(spark, tmp_path):
    chunks, path = _lexical_chunks(spark), str(tmp_path / "index")
    lexical.write_index(lexical.lexical_index(chunks), path)
    files = {f.relative_to(tmp_path): f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    changed = chunks.where("source_id = 's1' and chunk_id > 'c20'").withColumn("text", F.lit("brand new words"))
    lexical.replace_source(path, "s1", changed)
    now = {f.relative_to(tmp_path): f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    kept = {f: t for f, t in files.items() if "source_id=s1" not in str(f)}
    assert kept and all(now.get(f) == t for f, t in kept.items())
    assert not {f for f in files if "source_id=s1" in str(f)} & now.keys()
    want = lexical.lexical_index(chunks.where("source_id <> 's1'").unionByName(changed))
    rows = lambda frame: {(r.source_id, r.chunk_id, r.term, tuple(r.places)) for r in frame.collect()}
    assert rows(lexical.read_index(spark, path)) == rows(want)


def test_cell_search_finds_what_the_exact_search_does(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(24, 16))
    vectors = centres[rng.integers(0, 24, 3000)] + 0.35 * rng.normal(size=(3000, 16))
    rows = [("p" if k % 4 else "r", f"c{k:04d}", v.tolist(), f"s{k % 3}") for k, v in enumerate(vectors)]
    none = {c: F.lit(None).cast("string") for c in ("source_id", "document_id", "chunk_type", "path", "endpoint", "deploy_hash")}
    chunks = spark.createDataFrame(rows, "project_id string, chunk_id string, vector array<double>, service_name string")
    points = vector.vector_points(chunks.withColumns({**none, "metadata": F.expr("cast(map() as map<string, string>)")}))
    trained = cells.train(points.withColumnRenamed("id", "chunk_id"), 30)
    cells.write_cells(points, trained, str(tmp_path / "cells"))
    stored = cells.read_cells(spark, str(tmp_path / "cells"))
    assert stored.count() == 3000
    asked = [("p", f"q{k}", (centres[k % 24] + 0.35 * rng.normal(size=16)).tolist(), 30, None if k % 2 else f"s{k % 3}") for k in range(40)]
    frame = spark.createDataFrame(asked, "project_id string, question_id string, vector array<double>, fetch_k int, filter_service_name string")
    exact = vector.vector_search(frame, points.withColumnRenamed("id", "chunk_id"), 16)
    hits = lambda f: {(r.question_id, r.chunk_id, r["rank"]) for r in f.collect()}
    assert hits(cells.cell_search(frame, stored, trained, probes=30)) == hits(exact)
    near = cells.cell_search(frame, stored, trained, probes=6)
    share = cells.recall(near, exact).agg(F.sum("found") / F.sum("wanted")).first()[0]
    assert 0.9 <= share <= 1.0


def test_cells_of_few_or_no_points(spark):
    schema = "project_id string, chunk_id string, vector array<double>"
    empty = spark.createDataFrame([], schema)
    assert cells.train(empty).centres.shape == (1, 1)
    flat = spark.createDataFrame([("p", f"c{k}", [0.0, 0.0]) for k in range(3)] + [("p", "d", [1.0, 0.0])], schema)
    assert cells.train(flat).centres.shape[1] == 2 and cells.with_cell(flat, cells.train(flat)).count() == 4


def test_best_hits_equal_numpy_over_many_cuts(monkeypatch):
    monkeypatch.setattr(vector, "GATHERED", 40)
    rng = np.random.default_rng(3)
    # Few distinct scores, so that names decide, and names in no order of rows.
    scores = np.round(rng.normal(size=(11, 600)), 1)
    names = np.array([f"c{i}" for i in rng.permutation(600)], dtype=object)
    budgets = np.array([3, 7] * 5 + [4])
    best = vector.Best(budgets)
    for at in range(0, 600, 50):
        rows = best.rows(names[at : at + 50])
        for own in (np.arange(6), np.arange(6, 11)):
            best.add(own, scores[own, at : at + 50] + rng.normal(scale=1e-8, size=(len(own), 50)), rows, 7)
    q, score, name = best.cut()
    for k in range(11):
        order = np.lexsort((names.astype(str), -scores[k]))[: budgets[k]]
        assert list(zip(score[q == k], name[q == k], strict=True)) == list(zip(scores[k][order], names[order], strict=True))
    # Names of rows without hits are dropped.
    assert len(best.names) <= 200


def test_ties_are_held_only_where_their_names_come_first():
    best = vector.Best(np.array([3, 2]))
    for at in range(0, 5000, 500):
        rows = best.rows(np.array([f"c{i:04d}" for i in range(at, at + 500)], dtype=object))
        best.add(np.arange(2), np.full((2, 500), 0.5), rows, 3)
        if at:
            # Nothing after the first rows can be among the best, though all tie.
            assert best.held == 0
        best.cut()
    assert best.cut()[2].tolist() == ["c0000", "c0001", "c0002", "c0000", "c0001"]


def test_questions_of_a_product_share_their_coordinates():
    rng = np.random.default_rng(4)
    matrix = np.zeros((300, 400))
    for k in range(300):
        matrix[k, [k % 5, 10 + k % 5, 20 + k % 5 * 60 + int(rng.integers(0, 60))]] = 1.0
    group = vector.Group((), np.arange(300), matrix.copy(), 3)
    assert max(map(len, group.places)) < 150
    dense = rng.normal(size=(50, 400))
    found = np.zeros((300, 50))
    for numbers, scores in group.tiles(dense):
        found[numbers] = scores
    assert np.allclose(found, matrix @ dense.T)


def test_questions_with_the_same_vector_are_one_search(spark, monkeypatch):
    points = spark.createDataFrame([("p", f"c{k}", [float(k), 1.0], f"s{k % 2}") for k in range(20)], "project_id string, chunk_id string, vector array<double>, service_name string")
    asked = [("p", f"q{k}", [1.0, float(k % 2)], 3 + k % 2, [None, "s0"][k % 4 // 2]) for k in range(40)]
    frame = spark.createDataFrame(asked, "project_id string, question_id string, vector array<double>, fetch_k int, filter_service_name string")
    sizes = []
    monkeypatch.setattr(vector, "_block_of", lambda rows, names, f=vector._block_of: sizes.append(rows.num_rows) or f(rows, names))
    hits = vector.vector_search(frame, points, 2).collect()
    assert sizes == [4]
    alone = [r for q in asked[:4] for r in vector.vector_search(spark.createDataFrame([q], frame.schema), points, 2).collect()]
    want = {(int(r.question_id[1:]) % 4, r.chunk_id, r.score, r["rank"]) for r in alone}
    assert {(r.question_id, r.chunk_id, r.score, r["rank"]) for r in hits} == {(f"q{k}", *w[1:]) for k in range(40) for w in want if w[0] == k % 4}


def test_places_of_a_batch_of_stems_equal_a_plain_loop():
    import pyarrow as pa

    lines = [["x"], ["b", "a", "", "b"], None, [], ["a"] * 3, ["c", "\u00e9", "c", "b"]]
    batch = pa.array(lines, pa.list_(pa.string()))
    for part, own in ((batch, lines), (batch.slice(1, 4), lines[1:5]), (batch.slice(2, 2), lines[2:4]), (batch.slice(0, 0), [])):
        found = lexical.term_places.func(part).to_pylist()
        want = [{t: [k + 1 for k, x in enumerate(line or []) if x == t] for t in line or []} for line in own]
        assert [{f["term"]: f["places"] for f in row} for row in found] == want
        assert [len(row) for row in found] == [len(w) for w in want]


def test_graph_search_pairs_edges_with_searches_not_questions(spark, monkeypatch):
    from caseloom.operators import relations

    rows = [(f"q{i}", "p", "architecture", 2 + i % 2, ["svc1"], [], []) for i in range(40)]
    asked = spark.createDataFrame(rows, "question_id string, project_id string, intent string, fetch_k int, services array<string>, endpoints array<string>, query_terms array<string>")
    edges = spark.createDataFrame(
        [("p", f"c{i:02d}", "defines" if i % 10 == 3 else "contains", "service:svc1", f"path:{i}") for i in range(30)],
        "project_id string, evidence_chunk_id string, relation_type string, from_key string, to_key string",
    )
    joined = []
    monkeypatch.setattr(relations, "top_per", lambda frame, *a, f=relations.top_per, **k: joined.append(frame.count()) or f(frame, *a, **k))
    hits = relations.graph_search(asked, edges, 3)
    first = ["c03", "c13", "c23"]
    assert {(r.question_id, r.chunk_id, r["rank"]) for r in hits.collect()} == {(f"q{i}", first[k], k + 1) for i in range(40) for k in range(2 + i % 2)}
    # Edges are cut by what they mention, searches by their chunks; only the last cut is by question.
    assert joined == [30, 6, 120]


def test_a_query_builds_only_the_tables_it_reads(spark, sf_dir, monkeypatch):
    from caseloom.plans import corpus
    from caseloom.plans.catalog import QUERIES

    monkeypatch.setattr(corpus, "_BUILT", {})
    QUERIES["evidence_relations"](spark, sf_dir)
    assert {key[-1] for key in corpus._BUILT} == {"chunks"}
    QUERIES["graph_search"](spark, sf_dir)
    assert {key[-1] for key in corpus._BUILT} == {"chunks", "edges"}


def test_tokens_of_a_batch_are_stemmed_as_the_text_is(spark):
    lines = ["Classes, classes and THE \u00e9t\u00e9s; bus busses", "the of", "", None, "Deployed deploys-deploy: x9ing ab\u0661ed"]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "id int, text string")
    rows = frame.select("id", lexical.token_places(lexical.tokens("text")).alias("found"), lexical.positions("text").alias("stems")).collect()
    for r in rows:
        stems = r.stems or []
        assert {t.term: t.places for t in r.found or []} == {s: [k + 1 for k, x in enumerate(stems) if x == s] for s in stems}


def test_what_was_cut_is_known_to_be_small(spark):
    from caseloom.session import cut_lineage

    small = cut_lineage(spark.range(5).withColumn("name", F.concat(F.lit("n"), "id")))
    assert sorted(r.name for r in small.collect()) == [f"n{k}" for k in range(5)]
    plan = spark.range(10_000_000).join(small, "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_an_endpoint_of_many_chunks_is_not_paired_with_every_question(spark):
    from caseloom import vocab
    from caseloom.operators import metadata_search as ms

    kinds = "question_id string, project_id string, fetch_k int, services array<string>, deploy_hashes array<string>, endpoints array<string>, query_terms array<string>"
    asked = spark.createDataFrame(
        [(f"q{k}", "p", 3 + k % 2, ["svc1"] if k % 3 else [], ["abcdef12"] if k == 5 else [], ["/v1/error", "/v1/e"][: 1 + k % 2], ["timeout", "handler"][: k % 3]) for k in range(30)], kinds)
    rows = [(f"c{k:03}", "p", f"svc{k % 3}", "abcdef12" if k % 40 == 7 else None, [None, "/v1/error", "GET /v1/error", "/v1/e"][k % 4],
             ["a/handler.py", "b/timeout/handler.py", "c"][k % 3 if k % 5 else 2], {"symbol": "Timeout" if k == 33 else "x"}, {}) for k in range(160)]
    chunks = spark.createDataFrame(rows, "chunk_id string, project_id string, service_name string, deploy_hash string, endpoint string, path string, metadata map<string,string>, "
                                   "metadata_lists map<string,array<string>>").withColumn("chunk_type", F.lit("x"))
    found = {(r.question_id, r.chunk_id, r.score, r["rank"]) for r in ms.metadata_search(asked, chunks, 4).collect()}
    want = set()
    for q in asked.collect():
        scored, terms = [], [t for t in q.query_terms if t not in vocab.METADATA_IGNORED_TERMS]
        for chunk, _, service, deploy, endpoint, path, meta, _ in rows:
            symbols = sum(meta["symbol"].lower() == t for t in terms)
            paths = sum(t in path for t in terms)
            score = 4.0 * (service in q.services) + 4.0 * (deploy in q.deploy_hashes) + 5.0 * any(e in (endpoint or "") for e in q.endpoints) + 3.0 * symbols + min(2.0, paths)
            if score:
                scored.append((-score, chunk))
        want |= {(q.question_id, chunk, -score, k + 1) for k, (score, chunk) in enumerate(sorted(scored)[: q.fetch_k])}
    assert found == want
    ready, facts = ms.metadata_terms(asked), ms._facts(chunks)
    assert ms._selective(ready, facts, []).count() < 30
    # A kind that scores more fills each budget of 4, so no question takes more than a few kinds.
    assert ms._leading(ready, facts, 4, []).groupBy("question_id").count().agg(F.max("count")).first()[0] <= 12


def test_hashed_terms_deal_texts_out_by_key(spark, monkeypatch):
    monkeypatch.setattr(embedding, "TASK_KEYS", 10)
    texts = spark.range(95).select("id", F.concat_ws(" ", F.lit("alpha"), F.concat(F.lit("w"), "id"), F.lit("beta alpha")).alias("text")).coalesce(1)
    cells = embedding.hashed_terms(texts.union(texts.where("id = 3")), "id", "text")
    # The cells of a key are counted where its text is: by ten tasks, and with no shuffle of cells.
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    dense = {i: embedding.hash_embedder()([f"alpha w{i} beta alpha"])[0] for i in range(95)}
    got = {(r["id"], r["index"]): r["value"] for r in cells.collect()}
    assert got == pytest.approx({(i, k): x for i, v in dense.items() for k, x in enumerate(v) if x})


def test_embedder_begins_its_codes_anew_and_stays_the_same(monkeypatch):
    texts = [f"a{i} b{i % 5} a{i} C" for i in range(900)]
    want = embedding.hash_embedder()(texts)
    monkeypatch.setattr(embedding, "MOST_CODES", 10)
    assert (embedding.hash_embedder()(texts) == want).all()


def test_contains_join_finds_every_needle_and_joins_only_such_pieces(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abäß€😀/-.") for _ in range(n))
    hay = [None, "", "ab", *(word(rng.randrange(90)) for _ in range(400))]
    needles = {h[at : at + n] for h in hay[3:90] for at in (0, 3, 11) for n in (2, 3, 5, 31, 32, 33, 50)} | {"zzz", "a"}
    left = spark.createDataFrame([(f"p{k % 2}", h) for k, h in enumerate(hay)], "project_id string, text string").repartition(3)
    right = spark.createDataFrame([(p, n) for n in needles for p in ("p0", "p1")], "project_id string, needle string")
    got = [tuple(r) for r in matching.contains_join(left, "text", right, "needle", ["project_id"], 2).select("project_id", "text", "needle").collect()]
    want = [(f"p{k % 2}", h, n) for k, h in enumerate(hay) if h for n in needles if len(n) >= 2 and n in h]
    assert sorted(got) == sorted(want)
    exploded = []
    monkeypatch.setattr(matching.F, "explode", lambda c, explode=F.explode: exploded.append(c) or explode(c))
    matching.contains_join(left, "text", right.where("needle = 'zzz'"), "needle", ["project_id"], 2)
    assert left.select(F.sum(F.size(exploded[0]))).first()[0] == 0


def test_graph_search_searches_keys_once(spark, monkeypatch):
    edges = spark.createDataFrame(
        [("p", f"c{i}", "contains", f"service:svc{i % 3}", f"path:svc{i % 5}/a{i}") for i in range(40)],
        "project_id string, evidence_chunk_id string, relation_type string, from_key string, to_key string")
    asked = spark.createDataFrame([("q", "p", 5, "architecture", ["svc1"], [], [])],
        "question_id string, project_id string, fetch_k int, intent string, services array<string>, endpoints array<string>, query_terms array<string>")
    from caseloom.operators import relations

    held = []
    monkeypatch.setattr(relations, "cut_lineage", lambda f, cut=relations.cut_lineage: held.append(f.columns) or cut(f))
    got = [r.chunk_id for r in relations.graph_search(asked, edges, 5).orderBy("rank").collect()]
    assert got == sorted(f"c{i}" for i in range(40) if i % 3 == 1 or i % 5 == 1)[:5]
    assert ["project_id", "key", "held"] in held


def test_density_of_a_batch_equals_the_fold(spark):
    rng, rows = random.Random(11), []
    for k in range(300):
        line = [rng.choice("abcdxyz") for _ in range(rng.randrange(1, 40))]
        wanted = sorted(set(rng.choices("abcd", k=rng.randrange(1, 5))))
        held = [(n, [i + 1 for i, s in enumerate(line) if s == w]) for n, w in enumerate(wanted)]
        rows.append((line, wanted, [h for h in held if h[1]] if k % 3 else held[::-1]))
    frame = spark.createDataFrame(rows, "line array<string>, wanted array<string>, held array<struct<term: int, places: array<int>>>").repartition(3)
    got = frame.select(lexical.place_density("held", F.size("wanted")).alias("a"), lexical.cover_density("line", "wanted").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and any(r.a > 1 for r in got) and any(r.a == 0 for r in got)


def test_lexical_search_looks_up_only_terms_that_are_not_at_hand(spark, monkeypatch):
    chunks = spark.createDataFrame(
        [("p", f"c{i}", "alpha beta " * (1 + i % 3) + ("gamma " if i % 2 else "") + "alpha") for i in range(20)], "project_id string, chunk_id string, text string")
    index = lexical.lexical_index(chunks)
    asked = spark.createDataFrame([("q1", "p", 50, "alpha"), ("q2", "p", 50, "gamma beta"), ("q3", "p", 50, "alpha missing")],
        "question_id string, project_id string, fetch_k int, question string")
    written = []
    monkeypatch.setattr(lexical, "cut_lineage", lambda f, cut=lexical.cut_lineage: written.append(cut(f)) or written[-1])
    found = lexical.lexical_search(asked, chunks, index)
    pairs = [w for w in written if {"search", "chunk_id", "term"} <= set(w.columns) and "wanted" not in w.columns]
    assert [p.select("term").distinct().collect()[0].term for p in pairs] == ["beta"] and pairs[0].count() == 10
    got = {(r.question_id, r.chunk_id): r.score for r in found.collect()}
    assert got == {**{("q1", f"c{i}"): 2.0 + i % 3 for i in range(20)},
                   **{("q2", f"c{i}"): got[("q2", f"c{i}")] for i in range(20) if i % 2}}
    fold = chunks.select("chunk_id", F.round(lexical.cover_density(lexical.positions("text"), F.array(F.lit("beta"), F.lit("gamma"))), 6).alias("s")).collect()
    assert {r.chunk_id: r.s for r in fold if r.s} == {c: s for (q, c), s in got.items() if q == "q2"}


def test_searches_meet_questions_after_their_cut(spark):
    chunks = spark.createDataFrame([("p", f"c{i:02d}", "alpha " * (1 + i % 4)) for i in range(30)], "project_id string, chunk_id string, text string")
    asked = spark.createDataFrame([(f"q{k}", "p", 3, "alpha") for k in range(5)], "question_id string, project_id string, fetch_k int, question string")
    whole, few = lexical.lexical_search(asked, chunks), lexical.lexical_search(asked, chunks, None, 4)
    assert whole.count() == 150 and few.count() == 20
    rows = lambda f: sorted((r.question_id, r.chunk_id, r.score, r["rank"]) for r in lexical.best(f, 4).collect())
    assert rows(whole) == rows(few) and len(rows(few)) == 15


def test_boosts_test_a_chunk_once_whatever_questions_name_it(spark):
    """Rules read columns of the chunk that are worked out before it meets any question."""
    rules = str([[str(c) for c in rule] for rule in fusion.boost_rules()])
    assert "metadata_lists" not in rules and "CASE WHEN contains(path" not in rules and "lower(" not in rules
    chunks = spark.createDataFrame(
        [("p", "a", "config/App.yaml", "Config_Service_Block", "SVC1", "AB12", None, None, 1, 2, None, None, "t", {"source_type": "config", "has_root_cause": "y"}, {"log_levels": ["E"]}),
         ("p", "b", None, None, None, None, "/v1/x", None, 1, 2, None, None, "t", {}, {})],
        "project_id string, chunk_id string, path string, chunk_type string, service_name string, deploy_hash string, endpoint string, section_title string,"
        "start_line int, end_line int, timestamp_start timestamp, timestamp_end timestamp, text string, metadata map<string,string>, metadata_lists map<string,array<string>>")
    asked = spark.createDataFrame(
        [("q", "which config", "config_lookup", ["config"], ["config_service_block"], ["config"], ["svc1"], ["ab12"], ["/v1/x/y"])],
        "question_id string, question string, intent string, preferred_sources array<string>, preferred_chunks array<string>, query_terms array<string>,"
        "services array<string>, deploy_hashes array<string>, endpoints array<string>")
    fused = spark.createDataFrame([("q", "p", "a", 1.0), ("q", "p", "b", 1.0)], "question_id string, project_id string, chunk_id string, rrf_score double")
    got = {r.chunk_id: r for r in fusion.boost(fused, asked, chunks).collect()}
    names = [r.split(":")[0] for r in got["a"].reasons]
    assert names[:4] == ["deploy_hash_match", "service_name_match", "intent_source", "intent_chunk"] and "config_path_match" in names
    assert got["b"].reasons == ["endpoint_match"] and got["b"].fused_score == 1.12
    assert not {"chunk_kind", "kind_boost", "config_path", "_fires0"} & set(got["a"].asDict())


def test_kinds_are_listed_for_the_first_chunks_of_those_alike(spark, monkeypatch):
    schema = ("project_id string, chunk_id string, service_name string, deploy_hash string, endpoint string, chunk_type string, path string,"
              "metadata map<string,string>, metadata_lists map<string,array<string>>")
    chunks = spark.createDataFrame([("p", f"c{i:03d}", "svc1", None, None, "t", f"logs/app-{i}.log", {}, {}) for i in range(200)], schema)
    asked = spark.createDataFrame([("q", "p", 4, ["svc1"], [], [], ["logs"])],
        "question_id string, project_id string, fetch_k int, services array<string>, deploy_hashes array<string>, endpoints array<string>, query_terms array<string>")
    places = []
    monkeypatch.setattr(metadata_search, "top_per", lambda f, keys, *a, top_per=metadata_search.top_per, **k: places.append((keys, top_per(f, keys, *a, **k))) or places[-1][1])
    got = [(r.chunk_id, r.score) for r in metadata_search.metadata_search(asked, chunks, 4).orderBy("rank").collect()]
    assert got == [(f"c{i:03d}", 5.0) for i in range(4)]
    assert [f.count() for keys, f in places if "terms" in keys] == [4]


def test_files_of_the_chunk_table_hold_few_rows(spark, sf_dir, monkeypatch):
    from caseloom.plans import corpus, views

    monkeypatch.setattr(corpus, "FILE_ROWS", 100)
    monkeypatch.setattr(corpus, "_BUILT", {})
    table = corpus.chunk_table(lambda name: views.load(spark, sf_dir, name))
    per_file = table.groupBy(F.input_file_name()).count().agg(F.max("count"), F.sum("count")).first()
    assert per_file[0] == 100 and per_file[1] == table.count() > 1000


def test_hits_sent_do_not_grow_with_the_tasks_of_the_points(spark):
    points = spark.range(600).selectExpr("'p' AS project_id", "concat('c', id) AS chunk_id", "array(1.0D, id / 600.0D) AS vector").repartition(50)
    asked = spark.createDataFrame([("q", "p", [1.0, 0.5], 5)], "question_id string, project_id string, vector array<double>, fetch_k int")
    hits, _ = vector._search_block(asked, points, {})
    most = 5 * vector.CORE_TASKS * spark.sparkContext.defaultParallelism
    assert 5 <= hits.count() <= most < 50 * 5
    assert [r.chunk_id for r in vector.vector_search(asked, points, 2).orderBy("rank").collect()] == ["c300", "c299", "c301", "c298", "c302"]


def test_scores_are_exact_though_pairs_are_found_in_single_precision(spark):
    rng = np.random.default_rng(9)
    # Scores that differ by less than single precision tells, and by more than is rounded away.
    base = rng.normal(size=64)
    near = [(base + 3e-5 * rng.normal(size=64)).tolist() for _ in range(400)]
    points = spark.createDataFrame([("p", f"c{k:03d}", v) for k, v in enumerate(near)], "project_id string, chunk_id string, vector array<double>")
    asked = np.vstack([base + 0.3 * rng.normal(size=64), np.eye(64)[:3]])
    frame = spark.createDataFrame([(f"q{k}", "p", v.tolist(), 7) for k, v in enumerate(asked)], "question_id string, project_id string, vector array<double>, fetch_k int")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(asked) @ unit(np.array(near)).T, 6)
    want = {(f"q{k}", f"c{c:03d}", s[c]) for k, s in enumerate(scores) for c in np.lexsort((np.arange(400), -s))[:7]}
    assert {(r.question_id, r.chunk_id, r.score) for r in vector.vector_search(frame, points, 64).collect()} == want


def test_questions_of_few_coordinates_are_multiplied_over_few():
    rng = np.random.default_rng(5)
    matrix = np.zeros((500, 384))
    for k in range(500):
        matrix[k, rng.choice(384, 1 + k % 6, replace=False)] = 1.0
    sparse = vector.Group((), np.arange(500), matrix, 3)
    assert max(map(len, sparse.places)) <= vector.TILE_PLACES and sorted(sparse.numbers) == list(range(500))
    # Full vectors share all coordinates and stay many to a product.
    assert len(vector.Group((), np.arange(500), rng.normal(size=(500, 8)), 3).places) == -(-500 // vector.TILE_QUESTIONS)


def test_hits_too_many_for_one_number_are_sorted_all_the_same():
    best = vector.Best(np.full(1 << 20, 2))
    for at in range(0, 6, 2):
        rows = best.rows(np.array([f"c{9 - at}", f"c{8 - at}"], dtype=object))
        best.add(np.array([0, (1 << 20) - 1]), np.array([[-2000.0 + at, 2000.0], [0.1, 0.1]]), rows, 2)
    q, score, name = best.cut()
    assert list(zip(q.tolist(), score.tolist(), name)) == [(0, 2000.0, "c4"), (0, 2000.0, "c6"), ((1 << 20) - 1, 0.1, "c4"), ((1 << 20) - 1, 0.1, "c5")]


def test_candidates_are_read_without_looking_chunks_up(spark, sf_dir, monkeypatch):
    from caseloom.plans import catalog_retrieval, retrieval, views

    monkeypatch.setattr(retrieval, "named_chunks", lambda *a: pytest.fail("chunks were looked up"))
    found = catalog_retrieval.hybrid(lambda name: views.load(spark, sf_dir, name))
    assert found.candidates.count() > 0


def test_the_one_nearest_cell_is_found_without_sorting_all(monkeypatch):
    rng = np.random.default_rng(6)
    # Few distinct scores, so that numbers decide.
    held, vectors = cells.Cells(np.round(rng.normal(size=(40, 3)))), np.round(rng.normal(size=(200, 3)))
    want = held.nearest(vectors, 2)[:, :1]
    monkeypatch.setattr(np, "argsort", lambda *a, **k: pytest.fail("all cells were sorted"))
    assert np.array_equal(held.nearest(vectors, 1), want)
