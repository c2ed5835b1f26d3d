from __future__ import annotations

import math
from dataclasses import replace

from caseloom.defaults import DEFAULTS
from caseloom.operators import chunkers, store

SCHEMA = "document_id string, path string, content string, source_type string, service_name string"


def cut(spark, path, content, kind="code", build=None):
    docs = spark.createDataFrame([(path, path, content, kind, None)], SCHEMA)
    frame = chunkers.emit(docs, build()) if build else chunkers.chunk_documents(docs)
    return frame.orderBy("ordinal").collect()


def test_fixture_corpus_types(spark):
    service = "import time\n\n\ndef handle_orders(request):\n    time.sleep(1)\n    return 1\n"
    rows = cut(spark, "services/api/service.py", service)
    assert [(r.chunk_type, r.start_line, r.end_line) for r in rows] == [("python_module", 1, 3), ("python_function", 4, 6)]
    rows = cut(spark, "docs/runbook.md", "# Orders runbook\n\nRestart the service.\n", "runbook")
    assert [r.chunk_type for r in rows] == ["markdown_procedure"]
    rows = cut(spark, "incidents/previous.md", "# Incident\n\n## Summary\nslow\n## Root Cause\npool\n", "incident")
    assert [r.chunk_type for r in rows] == ["incident_section", "incident_symptom", "incident_root_cause"]
    log = "2026-01-01T00:00:00Z INFO api [deploy=abc1234] GET /v1/orders ok\n2026-01-01T00:00:05Z ERROR api slow 900ms\nlast\n"
    rows = cut(spark, "logs/api.log", log, "logs")
    assert [(r.chunk_type, r.start_line, r.end_line) for r in rows] == [("log_time_window", 1, 3)]
    assert rows[0].deploy_hash == "abc1234" and rows[0].endpoint == "/v1/orders"
    rows = cut(spark, "deploys/deploy-history.json", '[{"deploy_hash":"abc1234","service_name":"orders-api"}]', "deploy")
    assert [(r.chunk_type, r.deploy_hash, r.service_name) for r in rows] == [("deploy_commit", "abc1234", "orders-api")]
    patch = "diff --git a/services/api/service.py b/services/api/service.py\n-x\n+time.sleep(1)\n"
    rows = cut(spark, "deploys/diff-abc1234.patch", patch, "deploy")
    assert rows[0].deploy_hash == "abc1234" and rows[0].metadata["changed_file"] == "services/api/service.py"


def test_malformed_deploy_json_gives_no_chunks(spark):
    assert cut(spark, "deploys/deploy-x.json", "not json", "deploy") == []


def test_windows_overlap_and_keep_the_tail(spark):
    words = [f"w{i}" for i in range(711)]
    frame = spark.createDataFrame([(" ".join(words),)], "t string")
    pieces = frame.select(chunkers.window_texts("t").alias("p")).first()["p"]
    assert [p.split()[0] for p in pieces] == ["w0", "w355", "w710"]


def loop_pack(lines, limit, cap):
    count = lambda ls: int(len(" ".join(ls).split()) * 1.3)
    total = max(1, count(lines))
    goal = max(limit, math.ceil(total / min(cap, max(1, math.ceil(total / limit)))))
    out, i = [], 0
    while i < len(lines):
        j, held = i, []
        while j < len(lines):
            if held and count(held + [lines[j]]) > goal:
                break
            held.append(lines[j])
            j += 1
            if count(held) >= goal:
                break
        out.append((i + 1, j))
        i = j
    return out


def test_bounded_fallback_equals_a_plain_loop(spark):
    lines = [" ".join(["x"] * (1 + (i * 7) % 23)) for i in range(200)]
    tight = replace(DEFAULTS, max_chunk_tokens=40, max_chunks_per_document=500)
    rows = cut(spark, "notes/a.txt", "\n".join(lines), "runbook", lambda: chunkers.bounded_fallback(tight))
    assert [(r.start_line, r.end_line) for r in rows] == loop_pack(lines, 40, 500)
    few = replace(DEFAULTS, max_chunk_tokens=40, max_chunks_per_document=5)
    rows = cut(spark, "notes/a.txt", "\n".join(lines), "runbook", lambda: chunkers.bounded_fallback(few))
    assert len(rows) <= 5 and rows[-1].end_line == 200


def test_chunk_limit_is_a_typed_failure(spark):
    content = "\n".join(f"# h{i}\nbody {i}" for i in range(30))
    docs = spark.createDataFrame(
        [("p", "s", "a.md", "a.md", "runbook", content, "h", {})],
        "project_id string, source_id string, external_id string, path string, source_type string, content string, "
        "content_hash string, metadata map<string,string>",
    )
    rows = store.final_chunks(docs, replace(DEFAULTS, max_chunks_per_document=10)).collect()
    assert len(rows) <= 10 and all(r.failure_code is None for r in rows)


def test_config_keys_beyond_the_limit_share_a_last_chunk(spark):
    content = "{" + ",".join(f'"k{i:02d}":{i}' for i in range(60)) + "}"
    rows = cut(spark, "config/a.json", content, "config")
    assert len(rows) == 51 and rows[-1].metadata["rest_entries"] == "10"
    text = "\n".join(r.text for r in rows)
    assert all(f"k{i:02d}\n{i}" in text for i in range(60))
    api = '{"openapi":"3","paths":{' + ",".join(f'"/p{i:03d}":{{"get":{{}}}}' for i in range(103)) + "}}"
    rows = cut(spark, "api/openapi.json", api, "api_doc")
    assert len(rows) == 101 and "/p102" in rows[-1].text and rows[-1].metadata["rest_entries"] == "3"


def test_document_lists_reach_the_chunks(spark):
    docs = spark.createDataFrame(
        [("p", "s", "a.md", "a.md", "runbook", "# one\nbody", "h", {}, {"symbol_names": ["f", "g"], "unknown": ["x"], "headings": []})],
        "project_id string, source_id string, external_id string, path string, source_type string, content string, "
        "content_hash string, metadata map<string,string>, metadata_lists map<string,array<string>>",
    )
    row = store.final_chunks(docs).first()
    assert row.metadata_lists["symbol_names"] == ["f", "g"] and "unknown" not in row.metadata_lists


def test_nothing_is_declared_inside_strings_and_comments(spark):
    def titles(path, content):
        return [(r.section_title, r.start_line, r.end_line) for r in cut(spark, path, content, "api_doc" if path.endswith("proto") else "code") if r.section_title]

    text = 'def f():\n    """Use:\ndef g():\n    pass\n\'\'\' "\n    """\n    return 1\n\nX = \'\'\'\nclass A:\n\'\'\'\ny = \'"""\'\ndef h():\n    return 2\n'
    assert titles("a/f.py", text) == [("def f", 1, 7), ("def h", 13, 14)]
    assert titles("a/f.py", 'x = 1\x0c\n"""\ndef no():\n"""\rdef f():\n    pass\ndef g():\n    pass\n')[-1] == ("def g", 6, 7)
    # Nothing closes the string, so the line after it is code.
    assert titles("a/f.py", 'x = """\ndef f():\n    pass\n')[-1] == ("def f", 2, 3)
    text = "/*\nfunc A() {}\n*/\nfunc B() {\n  s := `\nfunc C() {}\n`\n}\n// it's `\nfunc D() {}\n// `\n"
    assert titles("a/f.go", text)[1:] == [("function B", 4, 9), ("function D", 10, 11)]
    text = "const r = /[`/]'/\nconst s = `a\nfunction no() {}\n\\`\nclass No {}\n`\nfunction yes() {}\nconst u = 'http://x' // `\nclass Yes {}\n/** class X\nclass Z {}\n*/\n"
    assert titles("a/f.ts", text)[1:] == [("function yes", 7, 8), ("class Yes", 9, 12)]
    text = 'class A {\n  String s = """\n  void no() {\n  """;\n  /* void\n  void no2() {\n  */ void yes() {\n  }\n  void last() {\n  }\n}\n'
    assert titles("a/A.java", text) == [("class A", 1, 8), ("function last", 9, 11)]
    assert titles("a/a.proto", "/*\nmessage No {}\n*/\nmessage Yes {}\n")[1:] == [("message Yes", 4, 4)]


def test_long_strings_and_comments_need_no_stack(spark):
    for build, path, opened, closed, tail in (
        (chunkers.python, "a/f.py", '"""', '"""', "def f():\n    pass\n"), (chunkers.go, "a/f.go", "/*", "*/", "func f() {}\n"),
        (chunkers.script, "a/f.js", "`", "`", "function f() {}\n"), (chunkers.java, "a/F.java", '"', '"', "class f {}\n"),
    ):
        body = "x \\\\ * \\n" * 60_000 if path != "a/f.py" else "x \\n \" '\n" * 60_000
        rows = cut(spark, path, f"x = {opened}{body}{closed}\n{tail}", build=build)
        assert rows[-1].section_title.endswith(" f"), path
