"""Facts a collector states about a document: symbols, headings, ids, markers.

Only what the text shows is extracted. Lists are sorted, distinct and bounded;
headings keep their order in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import paths
from caseloom.functions.patterns import (
    WORD, contains_any, find_all, first_match, first_of, sorted_set, strings, strip,
)

NAME = rf"[A-Za-z_]{WORD}*"

# Extraction patterns.
GO_PACKAGE = rf"(?m)^\s*package\s+({WORD}+)"
GO_FUNCTION = rf"(?m)^\s*func\s+(?:\([^)]*\)\s*)?({NAME})\s*\("
GO_TYPE = rf"(?m)^\s*type\s+({NAME})\s+(?:struct|interface)"
PROTO_SYMBOL = rf"(?m)^\s*(?:service|rpc|message|enum)\s+({NAME})"
PROTO_RPC = rf"(?m)^\s*rpc\s+({NAME})"
PY_SYMBOL = rf"(?m)^\s*(?:async\s+def|def|class)\s+({NAME})"
PY_FUNCTION = rf"(?m)^\s*(?:async\s+def|def)\s+({NAME})"
PY_CLASS = rf"(?m)^\s*class\s+({NAME})"
TS_SYMBOL = rf"(?m)^\s*(?:export\s+)?(?:async\s+)?(?:function|class|interface|type)\s+({NAME})"
TS_CLASS = rf"(?m)^\s*(?:export\s+)?(?:class|interface|type)\s+({NAME})"
JAVA_PACKAGE = r"(?m)^\s*package\s+([A-Za-z_][\p{L}\p{N}_.]*)\s*;"
JAVA_TYPE = (
    r"(?m)^\s*(?:(?:public|private|protected|abstract|final|static)\s+)*"
    rf"(?:class|interface|enum|record)\s+({NAME})"
)
JAVA_METHOD = (
    r"(?m)^\s*(?:(?:public|private|protected|static|final|synchronized|abstract|native)\s+)+"
    rf"[A-Za-z_][\p{{L}}\p{{N}}_<>\[\], ?]*\s+({NAME})\s*\("
)
HEADING = r"(?dm)^#{1,6}\s+(.+)$"
HTTP_ENDPOINT = r"\b(?:GET|POST|PUT|PATCH|DELETE)\s+(/[^\s]+)"
OPENAPI_PATH = r"(?dm)^\s{0,4}(/[^\s:]+):\s*(?:#.*)?$"
LOG_LEVEL = r"\b(DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL)\b"
ERROR_CODE = r"\b(ERR_[A-Z0-9_]+|E\d{3,5})\b"
COMMIT = r"(?i)\b([0-9a-f]{7,40})\b"
TIMESTAMP = (
    r"\b(\d{4}-\d{2}-\d{2}[T ][0-2]\d:[0-5]\d:[0-5]\d(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\b"
)
TRACE_ID = r"(?i)\b(?:trace(?:_id)?|trace-id)[=:]([A-Za-z0-9._-]+)"
REQUEST_ID = r"(?i)\b(?:request(?:_id)?|request-id)[=:]([A-Za-z0-9._-]+)"
CONFIG_KEY = r"(?m)^\s*([A-Za-z_][A-Za-z0-9_.-]*)\s*(?::|=)"
RELEASE_MARKER = r"(?i)\b((?:release|version|changelog)\b[^\n]{0,120})"


def _by_language(language: Column, table: dict[str, Column]) -> Column:
    return F.coalesce(first_of([(language == k, v) for k, v in table.items()]), strings(()))


def symbols(content: str, language: Column) -> dict[str, Column]:
    """Function, class and symbol names by the rules of the file's language."""
    found = lambda p: find_all(content, p)
    script_classes, script_all = found(TS_CLASS), found(TS_SYMBOL)
    script_functions = F.array_except(script_all, script_classes)
    functions = _by_language(
        language,
        {
            "go": found(GO_FUNCTION), "proto": found(PROTO_RPC), "python": found(PY_FUNCTION),
            "typescript": script_functions, "javascript": script_functions,
            "java": found(JAVA_METHOD),
        },
    )
    classes = _by_language(
        language,
        {
            "go": found(GO_TYPE), "typescript": script_classes, "javascript": script_classes,
            "java": found(JAVA_TYPE), "python": found(PY_CLASS),
        },
    )
    every = _by_language(
        language,
        {
            "go": F.concat(found(GO_TYPE), found(GO_FUNCTION)), "proto": found(PROTO_SYMBOL),
            "python": found(PY_SYMBOL), "typescript": script_all, "javascript": script_all,
            "java": F.concat(found(JAVA_TYPE), found(JAVA_METHOD)),
        },
    )
    package = first_of(
        [
            (language == "go", first_match(content, GO_PACKAGE)),
            (language == "java", first_match(content, JAVA_PACKAGE)),
        ]
    )
    return {
        "symbol_names": sorted_set(every, 100), "function_names": sorted_set(functions, 100),
        "class_names": sorted_set(classes, 100), "package_name": package,
    }


def release_markers(path: str, content: str) -> Column:
    name = F.lower(paths.file_name(path))
    by_name = F.when(
        contains_any(name, ("changelog", "release", "version")),
        F.array(F.concat(F.lit("release_file:"), name)),
    ).otherwise(strings(()))
    marks = F.transform(F.concat(find_all(content, RELEASE_MARKER), by_name), strip)
    return sorted_set(F.array_remove(marks, ""), 25)


def document_facts(docs: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Add the fact columns; absent facts are NULL or empty lists."""
    language = paths.language(path)
    endpoints = sorted_set(
        F.concat(find_all(content, HTTP_ENDPOINT), find_all(content, OPENAPI_PATH)), 50
    )
    times = find_all(content, TIMESTAMP)
    folder = F.nullif(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit(""))
    staged = docs.withColumns({"file_language": language, "_times": times})
    return staged.withColumns(
        {
            **symbols(content, F.col("file_language")),
            "commit_sha": F.lower(first_match(content, COMMIT)),
            "module_path": F.regexp_replace(path, r"([^/])\.[^/.]+$", "$1"),
            "package_path": folder,
            "headings": F.slice(find_all(content, HEADING), 1, 50),
            "endpoint_candidates": endpoints,
            "api_paths": endpoints,
            "owner": paths.owner_from_path(path),
            "log_levels": sorted_set(find_all(content, LOG_LEVEL)),
            "error_codes": sorted_set(find_all(content, ERROR_CODE), 50),
            "trace_ids": sorted_set(find_all(content, TRACE_ID), 100),
            "request_ids": sorted_set(find_all(content, REQUEST_ID), 100),
            "timestamp_first": F.get("_times", F.lit(0)),
            "timestamp_last": F.get("_times", F.size("_times") - 1),
            "config_keys_summary": sorted_set(find_all(content, CONFIG_KEY), 100),
            "release_markers": release_markers(path, content),
        }
    ).drop("_times")
