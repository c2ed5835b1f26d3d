"""Text scalars: token counts, hashes, redaction, sanitising and compaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom import vocab
from caseloom.functions.patterns import (
    alternation, as_col, find_all, first_match, flagged, let, lookup, rstrip, split_lines, strip,
    words,
)

# Redaction patterns of the query side, applied in order.
SECRET_RULES = (
    (
        r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z]+ )?PRIVATE KEY-----",
        "[REDACTED_PRIVATE_KEY]",
    ),
    (
        r"\b(?:sk-[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}"
        r"|AKIA[0-9A-Z]{16})",
        "[REDACTED_API_KEY]",
    ),
    (
        r"(?i)\b(api[_-]?key|access[_-]?key|secret|token)(\s*[:=]\s*[\"']?)[A-Za-z0-9_./+-]{16,}",
        "$1$2[REDACTED_API_KEY]",
    ),
    (r"(?i)\bbearer\s+[A-Za-z0-9_.-]{20,}", "Bearer [REDACTED_TOKEN]"),
    (
        r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
        "[REDACTED_TOKEN]",
    ),
    (r"(?i)\b(password|passwd|pwd)(\s*[:=]\s*)\S+", "$1$2[REDACTED_PASSWORD]"),
)
SCRIPT = r"(?i)<script[\s\S]*?</script>"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def token_count(text: Column | str) -> Column:
    """Estimated tokens: 1.3 per word, rounded down."""
    return F.floor(word_count(text) * F.lit(1.3)).cast("int")


def deploy_hash(text: Column | str) -> Column:
    """A hash named by a deploy word wins over any bare hex token."""
    named = first_match(
        text, r"(?i)(?:deploy|release|commit|sha|revision)[_\s:=#-]+([a-f0-9]{6,40})"
    )
    return F.lower(F.coalesce(named, first_match(text, r"(?i)\b([a-f0-9]{6,40})\b")))


def http_endpoints(text: Column | str) -> Column:
    return find_all(text, r"(?:GET|POST|PUT|DELETE|PATCH)\s+(/\S+)")


def failure_code(code: Column | str) -> Column:
    """Public failure code for any internal one."""
    raw = F.lower(F.trim(F.coalesce(as_col(code), F.lit(""))))
    return F.when(raw.isin(*vocab.FAILURE_CODES), raw).otherwise(
        F.coalesce(lookup(raw, vocab.FAILURE_ALIASES), F.lit("unknown"))
    )


def looks_binary(content: Column | str) -> Column:
    head = F.substring(as_col(content), 1, 4096)
    share = F.regexp_count(head, F.lit(CONTROL)) / F.greatest(F.length(head), F.lit(1))
    return as_col(content).contains("\x00") | (share > 0.05)


def valid_content_hash(value: Column | str) -> Column:
    return F.trim(F.coalesce(as_col(value), F.lit(""))).rlike(r"^(?:sha256:)?[a-fA-F0-9]{64}$")


def clean_content_hash(value: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(as_col(value))), "^sha256:", "")


def content_hash(content: Column | str) -> Column:
    return F.sha2(as_col(content), 256)


def redact_collected(text: Column | str) -> Column:
    """Struct of the redacted text and the number of replacements."""
    out, count = as_col(text), F.lit(0)
    for label, pattern in vocab.COLLECTOR_SECRETS:
        count = count + F.regexp_count(out, F.lit(pattern))
        out = F.regexp_replace(out, pattern, f"[REDACTED:{label}]")
    return F.struct(out.alias("text"), count.alias("redactions"))


def redact_secrets(text: Column | str) -> Column:
    out = as_col(text)
    for pattern, replacement in SECRET_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def injection_matches(text: Column | str) -> Column:
    return flagged(
        [(as_col(text).rlike(f"(?i){p}"), p) for p in vocab.INJECTION_PATTERNS]
    )


def sanitize_output(text: Column | str) -> Column:
    return redact_secrets(F.regexp_replace(as_col(text), SCRIPT, "[REMOVED_SCRIPT]"))


def clean_label(value: Column | str, limit: int) -> Column:
    kept = F.regexp_replace(F.lower(as_col(value)), r"[^\p{L}\p{N}_.-]", "")
    return F.coalesce(F.nullif(F.substring(kept, 1, limit), F.lit("")), F.lit("unknown"))


def clamp_severity(value: Column | str) -> Column:
    return F.when(as_col(value).isin(*vocab.SEVERITIES), as_col(value)).otherwise("info")


def _key_form(key: Column) -> Column:
    return F.replace(F.lower(key), F.lit("-"), F.lit("_"))


def sanitize_audit(metadata: Column | str) -> Column:
    """Map of strings with credential-like keys masked and values redacted."""
    secret = alternation(vocab.CREDENTIAL_TOKENS)
    return F.transform_values(
        as_col(metadata),
        lambda k, v: F.when(_key_form(k).rlike(secret), F.lit("[REDACTED]")).otherwise(
            redact_secrets(v)
        ),
    )


def sanitize_payload(payload: Column | str) -> Column:
    """Flat event payload: at most 40 keys, short values, sensitive ones masked."""
    tokens = alternation(vocab.PAYLOAD_DROP_TOKENS)

    def entry(e: Column) -> Column:
        form = _key_form(e["key"])
        hidden = form.isin(*vocab.PAYLOAD_DROP_KEYS) | form.rlike(tokens)
        value = F.substring(F.replace(e["value"], F.lit("\n"), F.lit(" ")), 1, 256)
        return F.struct(
            F.when(hidden, e["key"]).otherwise(F.substring(e["key"], 1, 96)).alias("key"),
            F.when(hidden, F.lit("[REDACTED]")).otherwise(redact_secrets(value)).alias("value"),
        )

    kept = F.slice(F.map_entries(as_col(payload)), 1, 40)
    return sanitize_audit(F.map_from_entries(F.transform(kept, entry)))


def canonical_json(mapping: Column | str) -> Column:
    """Compact JSON of a string map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(as_col(mapping)))))


def json_bytes(mapping: Column | str) -> Column:
    return F.octet_length(canonical_json(mapping))


def idempotency_key(run_type: Column | str, request: Column | str) -> Column:
    """First 48 hex digits of the hash of the run type and its ordered request."""
    quoted = lambda c: F.concat(
        F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"')
    )
    body = F.array_join(
        F.transform(
            F.array_sort(F.map_entries(as_col(request))),
            lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"])),
        ),
        ", ",
    )
    text = F.concat(
        F.lit('{"request": {'), body, F.lit('}, "run_type": '), quoted(as_col(run_type)), F.lit("}")
    )
    return F.substring(F.sha2(text, 256), 1, 48)


def compact(text: Column | str, limit: Column | int) -> Column:
    """Trimmed text without trailing blanks; cut to the limit with an ellipsis."""
    limit = F.lit(limit) if isinstance(limit, int) else limit

    def cut(clean: Column) -> Column:
        head = rstrip(F.substring(clean, F.lit(1), F.greatest(limit - 1, F.lit(0))))
        return F.when(F.length(clean) <= limit, clean).otherwise(
            F.when(head == "", "").otherwise(F.concat(head, F.lit("...")))
        )

    return let(F.array_join(F.transform(split_lines(strip(text)), rstrip), "\n"), cut)


def line_span(start: Column | str, end: Column | str) -> Column:
    """``7``, ``7-12`` or an empty string."""
    start, end = as_col(start), as_col(end)
    return (
        F.when(start.isNull(), "")
        .when(end.isNull() | (start == end), start.cast("string"))
        .otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))
    )


def citation_text(label: Column | str, path: Column | str, lines: Column | str) -> Column:
    """``[n] path:lines`` or ``[n] path`` where no lines are known."""
    place = F.when(as_col(lines) == "", as_col(path)).otherwise(
        F.concat(as_col(path), F.lit(":"), as_col(lines))
    )
    return F.concat(as_col(label), F.lit(" "), place)


def direct_snippet(path: Column | str, lines: Column | str, text: Column | str,
                   limit: int) -> Column:
    """Cited location over its text, cut to the limit."""
    head = F.when(as_col(lines) == "", as_col(path)).otherwise(
        F.concat(as_col(path), F.lit(":"), as_col(lines))
    )
    body = strip(text)
    cut = rstrip(F.substring(body, 1, max(limit - 3, 0)))
    short = F.when(F.length(body) <= limit, body).otherwise(
        F.when(cut == "", "").otherwise(F.concat(cut, F.lit("...")))
    )
    return F.when(short == "", "").otherwise(F.concat(head, F.lit("\n"), short))


def metadata_tokens(text: Column | str) -> Column:
    return F.filter(
        F.split(F.lower(as_col(text)), r"[^a-z0-9_./-]+"), lambda t: F.length(t) >= 3
    )


