"""What a path says about a document: its type, language, owner and safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom import vocab
from caseloom.functions.patterns import (
    alternation, as_col, contains_any, first_match, first_of, let, lookup, strings,
)

_CODE = rf"(?:{alternation(vocab.CODE_SUFFIXES)})$"


def slashed(path: Column | str) -> Column:
    return F.replace(as_col(path), F.lit("\\"), F.lit("/"))


def suffix(path: Column | str) -> Column:
    """Lower-cased file suffix with its dot; empty for dot-files and bare names."""
    return F.regexp_extract(F.lower(as_col(path)), r"[^/](\.[^/.]+)$", 1)


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(as_col(path), "/"), -1)


def _deploy_json(lower: Column) -> Column:
    return lower.endswith(".json") & contains_any(lower, vocab.DEPLOY_TOKENS)


def source_type(path: Column | str) -> Column:
    lower = F.lower(as_col(path))
    return first_of(
        [
            (lower.rlike(_CODE), "code"),
            (lower.endswith(".proto"), "api_doc"),
            (lower.endswith(".log") | lower.contains("/logs/"), "logs"),
            (lower.rlike(r"\.(?:patch|diff)$") | _deploy_json(lower), "deploy"),
            (contains_any(lower, ("incident", "postmortem")), "incident"),
            (contains_any(lower, ("openapi", "swagger")), "api_doc"),
            (lower.rlike(r"\.(?:yaml|yml|toml|ini)$"), "config"),
            (lower.rlike(r"\.(?:md|txt)$"), "runbook"),
            (lower.endswith(".json"), "config"),
        ],
        "unknown",
    )


def doc_type(path: Column | str) -> Column:
    lower = F.lower(as_col(path))
    return first_of(
        [
            (lower.rlike(_CODE), "code"),
            (lower.endswith(".proto"), "api_doc"),
            (lower.endswith(".log") | lower.contains("/logs/"), "log"),
            (lower.rlike(r"\.(?:patch|diff)$") | _deploy_json(lower), "deploy"),
            (contains_any(lower, ("incident", "postmortem")), "incident"),
            (
                lower.rlike(r"\.(?:yaml|yml|toml|ini|json)$"),
                F.when(contains_any(lower, ("openapi", "swagger")), "api_doc").otherwise("config"),
            ),
        ],
        "markdown",
    )


def canonical_source_type(declared: Column | str, path: Column | str) -> Column:
    """Declared type through the alias table, else what the path shows."""
    raw = F.lower(F.trim(F.coalesce(as_col(declared), F.lit(""))))
    named = F.coalesce(lookup(raw, vocab.SOURCE_TYPE_ALIASES), raw)
    inferred = source_type(path)
    return first_of(
        [
            (named.isin(*vocab.SOURCE_TYPES), named),
            (inferred.isin("logs", "code", "deploy", "incident", "api_doc", "runbook"), inferred),
            (suffix(path).isin(".json", ".yaml", ".yml"), "config"),
        ],
        "unknown_text",
    )


def collected_source_type(path: Column | str) -> Column:
    """Classification at collection time: deploy and release folders win."""
    clean = slashed(path)
    inferred = source_type(clean)
    return first_of(
        [
            (contains_any(F.lower(clean), vocab.DEPLOY_PATH_TOKENS), "deploy"),
            (inferred == "unknown", "unknown_text"),
        ],
        inferred,
    )


def language(path: Column | str) -> Column:
    return lookup(suffix(path), vocab.LANGUAGE_BY_SUFFIX)


def extension(path: Column | str) -> Column:
    """Text after the last dot, ``text`` for a path without one."""
    lower = F.lower(as_col(path))
    return F.when(lower.contains("."), F.element_at(F.split(lower, r"\."), -1)).otherwise("text")


def _service_like(token: Column) -> Column:
    return token.rlike(vocab.SERVICE_TOKEN) & ~token.isin(*vocab.PATH_STOPWORDS)


def service_from_path(path: Column | str) -> Column:
    """First path part that reads like a service name.

    A folder word such as ``services`` defers to the part after it, and a file
    name contributes the tokens of its stem.
    """
    split = F.filter(F.split(F.lower(slashed(path)), "/"), lambda p: ~p.isin("", ".", ".."))

    def candidates(parts: Column, part: Column, i: Column) -> Column:
        follower = F.get(parts, i + 1)
        stem = F.regexp_replace(part, r"\.[^.]*$", "")
        return (
            F.when(
                part.isin(*vocab.PATH_STOPWORDS),
                F.when(_service_like(follower), F.array(follower)),
            )
            .when(part.rlike(vocab.SERVICE_TOKEN), F.array(part))
            .when(
                (stem != "") & (stem != part),
                F.filter(F.split(stem, r"[-_.]"), _service_like),
            )
        )

    def first(parts: Column) -> Column:
        nested = F.transform(
            parts, lambda p, i: F.coalesce(candidates(parts, p, i), strings(()))
        )
        return F.get(F.flatten(nested), F.lit(0))

    return let(split, first)


def owner_from_path(path: Column | str) -> Column:
    """Name of the folder under ``service(s)/`` or ``cmd/``."""
    return first_match(
        slashed(path), r"(?i)(?:^|/)(?:services?|cmd)/([A-Za-z0-9_-]+)(?:/|$)"
    )


def is_safe(path: Column | str) -> Column:
    """Relative, without parent steps or NUL."""
    p = as_col(path)
    return ~(
        p.contains("\x00") | p.startswith("/") | F.array_contains(F.split(p, "/"), F.lit(".."))
    )


def fallback_chunk_type(path: Column | str, kind: Column | str) -> Column:
    ext, kind = suffix(path), as_col(kind)
    return first_of(
        [
            (ext == ".go", "go_fallback"),
            (ext == ".proto", "proto_fallback"),
            (kind == "config", "config_fallback"),
            (kind == "api_doc", "api_fallback"),
            (kind == "code", "code_fallback"),
        ],
        "text_fallback",
    )


def glob_to_regex(pattern: str) -> str:
    """Anchored regex for a shell glob whose ``*`` also crosses slashes."""
    import fnmatch

    body = fnmatch.translate(pattern)
    # Python renders the anchors as \Z; Java and RE2 write the same point \z.
    return "^" + body.replace(r"\Z", r"\z")


def matches_globs(path: Column | str, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | as_col(path).rlike(glob_to_regex(pattern))
    return hit


def skip_reason(path: Column | str, size: Column | str, head: Column | str, limit: int,
                extensions: tuple[str, ...]) -> Column:
    """Why a collected file is left out; NULL where it is kept. First rule wins."""
    parts = F.split(as_col(path), "/")
    ext, size = suffix(path), as_col(size)
    return first_of(
        [
            (F.arrays_overlap(parts, strings(vocab.GENERATED_DIRS)), "generated_file"),
            (F.arrays_overlap(parts, strings(vocab.VENDOR_DIRS)), "vendor_file"),
            (
                ext.isin(*vocab.DENIED_SUFFIXES) | file_name(path).startswith(".env"),
                "unsupported_extension",
            ),
            (size == 0, "empty"),
            (size > limit, "oversized"),
            ((ext != "") & ~ext.isin(*extensions), "unsupported_extension"),
            (as_col(head).contains("\x00"), "binary"),
        ]
    )
