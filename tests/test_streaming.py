from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from caseloom.operators import jobs
from caseloom.plans import ingest
from caseloom.plans.views import load
from caseloom.streaming import jobs as streams


def document(name, content, position):
    return {
        "project_id": "p", "source_id": "s", "batch_id": "b", "position": position, "external_id": name, "path": name,
        "source_type": "", "content": content, "content_hash": hashlib.sha256(content.encode()).hexdigest(), "metadata": {},
    }


def run(spark, inbox, root):
    query = streams.ingest_stream(streams.document_stream(spark, inbox), root, f"{root}/ckpt").trigger(availableNow=True).start()
    query.awaitTermination()


def test_stream_ingest_replays_and_isolates_errors(spark, tmp_path):
    inbox, root = tmp_path / "inbox", str(tmp_path / "state")
    inbox.mkdir()
    first = [document("docs/a.md", "# A\nrunbook text", 1), document("../bad.md", "x", 2), document("b.py", "def f():\n    return 1\n", 3)]
    (inbox / "1.json").write_text("\n".join(map(json.dumps, first)))
    run(spark, str(inbox), root)
    second = [document("docs/a.md", "# A\nrunbook text", 1), document("b.py", "def g():\n    return 2\n", 2)]
    (inbox / "2.json").write_text("\n".join(map(json.dumps, second)))
    run(spark, str(inbox), root)
    chunks = ingest.current_chunks(spark, root).select("path", "section_title").collect()
    assert sorted((c.path, c.section_title) for c in chunks) == [("b.py", "def g"), ("docs/a.md", "A")]
    bad = spark.read.parquet(f"{root}/quarantine").select("failure_code").collect()
    assert [b.failure_code for b in bad] == ["metadata_invalid"]
    assert "content" not in spark.read.parquet(f"{root}/quarantine").columns


def test_streaming_job_states_equal_the_batch_fold(spark, sf_dir, tmp_path):
    deliveries = load(spark, sf_dir, "v_deliveries").select("job_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "outcome", "code", "current_version")
    source = str(tmp_path / "in")
    deliveries.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(deliveries.schema).parquet(source)
    query = streams.job_states(stream).writeStream.outputMode("update").format("memory").queryName("job_states").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.job_id, r.status, r.attempts, r.error_code) for r in spark.table("job_states").collect()}
    want = {(r.job_id, r.status, r.attempts, r.error_code) for r in jobs.fold_jobs(deliveries).collect()}
    assert got == want


def test_streaming_bursts_and_limits(spark, sf_dir, tmp_path):
    lines = load(spark, sf_dir, "v_log_lines").select(F.col("ts").cast("timestamp").alias("ts"), "service", "line")
    source = str(tmp_path / "lines")
    lines.coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(lines.schema).parquet(source)
    for name, build in {
        "bursts": lambda rows: streams.error_bursts(rows, gap="2 hours"),
        "limits": lambda rows: streams.request_limits(rows, "service", "ts", 7200, 3, slide=3600),
        "rates": lambda rows: streams.error_rates(rows, width="6 hours"),
    }.items():
        build(stream()).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        # Windows that the watermark has closed are out, and each is what the stored lines give.
        got, want = set(map(tuple, spark.table(name).collect())), set(map(tuple, build(lines).collect()))
        assert got and got <= want and len(got) > len(want) / 2
    assert spark.table("bursts").where("error_lines < 2").count() == 0


def test_a_folder_is_ingested(spark, tmp_path):
    from caseloom.plans.ingest import ingest_folder, read_state
    from caseloom import schemas

    (tmp_path / "services" / "api").mkdir(parents=True)
    (tmp_path / "services" / "api" / "service.py").write_text("def handle(x):\n    return 1\n")
    (tmp_path / "runbook.md").write_text("# Runbook\n\nRestart it.\n")
    (tmp_path / "tool.bin").write_bytes(b"\x00\x01" * 10)
    (tmp_path / "large.log").write_text("x" * 2_000_001)
    (tmp_path / ".hidden.md").write_text("# no\n")
    current = read_state(spark, str(tmp_path / "nowhere"), schemas.DOCUMENTS)
    assert current.collect() == []
    result, ledger = ingest_folder(spark, str(tmp_path), "p", "s", current)
    assert {r.path for r in result.documents.collect()} == {"services/api/service.py", "runbook.md"}
    assert {r.chunk_type for r in result.chunks.collect()} == {"python_function", "markdown_procedure"}
    row = ledger.first()
    assert (row.files_seen, row.files_skipped, row.parser_errors) == (4, 2, 0)
