"""Versioned state, malformed input, and exact answers where one key has all rows."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caseloom.operators import investigation, matching
from caseloom.plans import ingest, state
from caseloom.sources import documents
from tests.test_streaming import document, run


def read(spark, folder, *lines):
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(lines))
    return documents.read_batches(spark, str(folder))


def texts(spark, root):
    now = state.snapshot(spark, root)
    docs = {(r.external_id, r.content_hash) for r in state.current_documents(spark, now).collect()}
    chunks = {(r.external_id, r.text) for r in state.current_chunks(spark, now).collect()}
    assert {e for e, _ in docs} == {e for e, _ in chunks}
    return {e: t for e, t in chunks}


@pytest.fixture()
def batches(spark, tmp_path):
    lines = lambda *rows: [json.dumps(document(*r)) for r in rows]
    first = read(spark, tmp_path / "a", *lines(("a.md", "# A\n\none", 1), ("b.md", "# B\n\none", 2)))
    second = read(spark, tmp_path / "b", *lines(("b.md", "# B\n\ntwo", 1), ("c.md", "# C\n\ntwo", 2)))
    return first, second


def test_a_version_holds_all_tables_or_none(spark, batches, tmp_path, monkeypatch):
    root = str(tmp_path / "state")
    state.apply_batch(batches[0], root, "1")
    before = texts(spark, root)
    # The job fails after two of the tables of the second batch are written.
    monkeypatch.setattr(state, "derive_relations", lambda chunks: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        state.apply_batch(batches[1], root, "2")
    assert texts(spark, root) == before and state.snapshot(spark, root).version == 1
    monkeypatch.undo()
    for _ in range(2):  # a batch that is delivered again changes nothing
        state.apply_batch(batches[1], root, "2")
        now = state.snapshot(spark, root)
        assert now.version == 2 and {e: t[-3:] for e, t in texts(spark, root).items()} == {"a.md": "one", "b.md": "two", "c.md": "two"}
    assert now.read(spark, "relations").count() > 0


def test_purge_and_compaction_switch_all_tables(spark, batches, tmp_path):
    root = str(tmp_path / "state")
    state.apply_batch(batches[0], root, "1")
    other = batches[1].withColumn("source_id", F.lit("t"))
    state.apply_batch(other, root, "2")
    files = lambda: {str(f) for f in (tmp_path / "state").rglob("part-*.parquet") if "v2-batch" in str(f)}
    kept = files()
    counts = state.purge_source(spark, root, "p", "s")
    assert counts["documents"] == 2 and counts["chunks"] == 2 and counts["relations"] > 0
    now = state.snapshot(spark, root)
    # Folders without the source are the same files as before.
    assert [f for f, _ in now.folders["documents"]] == ["v3-purge-0", "v2-batch"] and files() == kept
    rows = texts(spark, root)
    state.compact(spark, root)
    now = state.snapshot(spark, root)
    assert texts(spark, root) == rows and all(len(f) == 1 for f in now.folders.values()) and now.batches == {"1", "2"}
    assert state.purge_source(spark, root, "p", "t")["documents"] == 2 and texts(spark, root) == {}


def test_a_second_writer_changes_nothing(spark, batches, tmp_path):
    root = str(tmp_path / "state")
    old = state.snapshot(spark, root)
    assert old.version == 0 and texts(spark, root) == {}
    state.apply_batch(batches[0], root, "1")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        state._commit(spark, old, {}, "x")
    assert state.snapshot(spark, root).batches == {"1"}


BROKEN = ['{"project_id": "p", "external_id": ', "[1, 2", json.dumps({**document("d.md", "# D\n\nx", 3), "position": "third"})]


def test_malformed_lines_are_quarantined(spark, tmp_path):
    good = [json.dumps(document("a.md", "# A\n\none", 1)), json.dumps(document("b.md", "# B\n\none", 2))]
    rows = read(spark, tmp_path / "in", good[0], *BROKEN, good[1])
    result = ingest.ingest_documents(rows, rows.select("project_id", "source_id", "external_id", "content_hash").limit(0))
    assert {r.external_id for r in result.documents.collect()} == {"a.md", "b.md"}
    turned = result.quarantine.collect()
    assert [r.failure_code for r in turned] == ["malformed_content"] * 3 and "malformed" not in result.quarantine.columns
    assert {r.external_id for r in turned} == {None, "d.md"}


def test_malformed_lines_of_a_stream_are_quarantined(spark, tmp_path):
    inbox, root = tmp_path / "inbox", str(tmp_path / "state")
    inbox.mkdir()
    (inbox / "1.json").write_text("\n".join([json.dumps(document("a.md", "# A\n\none", 1)), *BROKEN]))
    run(spark, str(inbox), root)
    assert {r.path for r in ingest.current_chunks(spark, root).collect()} == {"a.md"}
    assert spark.read.parquet(f"{root}/quarantine").where("failure_code = 'malformed_content'").count() == 3


def test_percentiles_of_a_key_with_all_rows(spark):
    rng = random.Random(8)
    rows = [("hot", rng.choice([rng.randrange(10**9), rng.randrange(50), 7])) for _ in range(8000)] + [(None, k % 3) for k in range(10)] + [("one", 5), ("one", None)]
    frame = spark.createDataFrame(rows, "k string, v bigint").repartition(6)
    wanted = {"p0": 0, "p1": 1, "p50": 50, "p95": 95, "p100": 100}
    got = {r.k: tuple(r)[1:] for r in matching.nearest_rank(frame, ["k"], "v", wanted).collect()}
    for key in ("hot", None, "one"):
        own = sorted(v for k, v in rows if k == key and v is not None)
        assert got[key] == tuple(own[int(p / 100 * (len(own) - 1))] for p in wanted.values())


def test_logs_near_deploys_equal_brute_force(spark):
    rng, base = random.Random(6), datetime(2024, 1, 1)
    times = [base + timedelta(seconds=rng.randrange(0, 40_000), microseconds=rng.choice([0, 5])) for _ in range(400)]
    logs = [("p", rng.choice(["a", "b", None]), t, rng.choice(["ERROR 500", "fine", "error"])) for t in times]
    deploys = [("p", rng.choice(["a", "b"]), f"d{k}", rng.choice(times) + timedelta(minutes=rng.choice([15, -120, 0, 7]))) for k in range(60)]
    got = investigation.logs_near_deploys(
        spark.createDataFrame(logs, "project_id string, service string, ts timestamp, line string"),
        spark.createDataFrame(deploys, "project_id string, service string, deploy_id string, deployed_at timestamp"),
    ).collect()
    want = set()
    for _, service, name, at in deploys:
        own = [(t, line) for _, s, t, line in logs if s == service and at - timedelta(minutes=15) <= t <= at + timedelta(minutes=120)]
        if own:
            errors = {"ERROR 500": 2, "error": 1, "fine": 0}
            want.add((service, name, len(own), sum(errors[x] for _, x in own), min(own)[0], max(own)[0]))
    assert want and {tuple(r)[1:] for r in got} == want
