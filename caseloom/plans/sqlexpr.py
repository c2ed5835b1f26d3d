"""SQL expressions the checks are written with."""

from __future__ import annotations

from collections.abc import Iterable

from caseloom import vocab

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def quoted(values: Iterable[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def any_of(x: str, tokens: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in tokens) + ")"


def term(x: str, terms: Iterable[str]) -> str:
    body = "|".join(t.replace(".", r"\.") for t in terms)
    return f"regexp_matches({x}, '(^|[^a-z0-9_])({body})($|[^a-z0-9_])')"


def mapped(x: str, table: dict, default: str = "NULL") -> str:
    cells = " ".join(
        f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in table.items()
    )
    return f"CASE {x} {cells} ELSE {default} END"


def suffix(p: str) -> str:
    return rf"regexp_extract(lower({p}), '[^/](\.[^/.]+)$', 1)"


def source_type(p: str) -> str:
    low = f"lower({p})"
    return rf"""CASE
      WHEN regexp_matches({low}, '\.(py|js|ts|jsx|tsx|go|java|rb)$') THEN 'code'
      WHEN {low} LIKE '%.proto' THEN 'api_doc'
      WHEN {low} LIKE '%.log' OR contains({low}, '/logs/') THEN 'logs'
      WHEN regexp_matches({low}, '\.(patch|diff)$') THEN 'deploy'
      WHEN {low} LIKE '%.json' AND {any_of(low, vocab.DEPLOY_TOKENS)} THEN 'deploy'
      WHEN {any_of(low, ('incident', 'postmortem'))} THEN 'incident'
      WHEN {any_of(low, ('openapi', 'swagger'))} THEN 'api_doc'
      WHEN regexp_matches({low}, '\.(yaml|yml|toml|ini)$') THEN 'config'
      WHEN regexp_matches({low}, '\.(md|txt)$') THEN 'runbook'
      WHEN {low} LIKE '%.json' THEN 'config' ELSE 'unknown' END"""


def doc_type(p: str) -> str:
    low = f"lower({p})"
    return rf"""CASE
      WHEN regexp_matches({low}, '\.(py|js|ts|jsx|tsx|go|java|rb)$') THEN 'code'
      WHEN {low} LIKE '%.proto' THEN 'api_doc'
      WHEN {low} LIKE '%.log' OR contains({low}, '/logs/') THEN 'log'
      WHEN regexp_matches({low}, '\.(patch|diff)$') OR ({low} LIKE '%.json' AND {any_of(low, vocab.DEPLOY_TOKENS)}) THEN 'deploy'
      WHEN {any_of(low, ('incident', 'postmortem'))} THEN 'incident'
      WHEN regexp_matches({low}, '\.(yaml|yml|toml|ini|json)$') AND {any_of(low, ('openapi', 'swagger'))} THEN 'api_doc'
      WHEN regexp_matches({low}, '\.(yaml|yml|toml|ini|json)$') THEN 'config'
      ELSE 'markdown' END"""


def canonical(declared: str, p: str) -> str:
    raw = f"lower(trim({declared}))"
    named = f"coalesce({mapped(raw, vocab.SOURCE_TYPE_ALIASES)}, {raw})"
    return f"""CASE WHEN {named} IN ({quoted(vocab.SOURCE_TYPES)}) THEN {named}
      WHEN ({source_type(p)}) IN ('logs', 'code', 'deploy', 'incident', 'api_doc', 'runbook') THEN ({source_type(p)})
      WHEN {suffix(p)} IN ('.json', '.yaml', '.yml') THEN 'config' ELSE 'unknown_text' END"""


def service(p: str) -> str:
    """First service-like path part, as nested list functions."""
    stop = quoted(vocab.PATH_STOPWORDS)
    ok = lambda t: f"(regexp_matches({t}, '{vocab.SERVICE_TOKEN}') AND {t} NOT IN ({stop}))"
    parts = f"list_filter(string_split(lower(replace({p}, '\\', '/')), '/'), lambda x: x NOT IN ('', '.', '..'))"
    stem = r"regexp_replace(x, '\.[^.]*$', '')"
    body = f"""list_transform(ps, lambda x, i: CASE
        WHEN x IN ({stop}) THEN CASE WHEN i < len(ps) AND {ok('ps[i + 1]')} THEN [ps[i + 1]] ELSE [] END
        WHEN regexp_matches(x, '{vocab.SERVICE_TOKEN}') THEN [x]
        WHEN {stem} <> '' AND {stem} <> x THEN list_filter(regexp_split_to_array({stem}, '[-_.]'), lambda t: {ok('t')})
        ELSE [] END)"""
    return f"list_transform([{parts}], lambda ps: flatten({body})[1])[1]"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def word_count(x: str) -> str:
    return f"len({words(x)})"


def tokens(x: str) -> str:
    return f"CAST(floor({word_count(x)} * 1.3) AS BIGINT)"


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\A{WS}+', ''), '{WS}+\z', '')"


def rstrip(x: str) -> str:
    return rf"regexp_replace({x}, '{WS}+\z', '')"


def compact(x: str, limit: int) -> str:
    clean = f"array_to_string(list_transform(string_split({strip(x)}, chr(10)), lambda z: {rstrip('z')}), chr(10))"
    cut = rstrip(f"substr(c, 1, {limit - 1})")
    return (
        f"list_transform([{clean}], lambda c: CASE WHEN length(c) <= {limit} THEN c "
        f"WHEN {cut} = '' THEN '' ELSE {cut} || '...' END)[1]"
    )


def deploy_hash(x: str) -> str:
    named = rf"nullif(regexp_extract({x}, '(?i)(?:deploy|release|commit|sha|revision)[_\s:=#-]+([a-f0-9]{{6,40}})', 1), '')"
    bare = rf"nullif(regexp_extract({x}, '(?i)(?:^|{NOT_WORD})([a-f0-9]{{6,40}})(?:$|{NOT_WORD})', 1), '')"
    return f"lower(coalesce({named}, {bare}))"


SECRETS = (
    (
        r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z]+ )?PRIVATE KEY-----",
        "[REDACTED_PRIVATE_KEY]",
    ),
    (
        r"\b(?:sk-[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}|AKIA[0-9A-Z]{16})",
        "[REDACTED_API_KEY]",
    ),
    (
        r"""(?i)\b(api[_-]?key|access[_-]?key|secret|token)(\s*[:=]\s*["'']?)[A-Za-z0-9_./+-]{16,}""",
        r"\1\2[REDACTED_API_KEY]",
    ),
    (r"(?i)\bbearer\s+[A-Za-z0-9_.-]{20,}", "Bearer [REDACTED_TOKEN]"),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "[REDACTED_TOKEN]"),
    (r"(?i)\b(password|passwd|pwd)(\s*[:=]\s*)\S+", r"\1\2[REDACTED_PASSWORD]"),
)


def redact(x: str) -> str:
    for pattern, replacement in SECRETS:
        x = f"regexp_replace({x}, '{pattern}', '{replacement}', 'g')"
    return x


def failure_code(x: str) -> str:
    raw = f"lower(trim(coalesce({x}, '')))"
    return (
        f"CASE WHEN {raw} IN ({quoted(vocab.FAILURE_CODES)}) THEN {raw} "
        f"ELSE coalesce({mapped(raw, vocab.FAILURE_ALIASES)}, 'unknown') END"
    )


def route(q: str) -> str:
    x = f"lower(trim({q}))"
    code = f"({term(x, vocab.CODE_TERMS)} OR {any_of(x, vocab.LOCATION_PHRASES)})"
    return f"""CASE
      WHEN {term(x, vocab.HISTORY_TERMS)} THEN 'history'
      WHEN {term(x, vocab.RUNBOOK_TERMS)} THEN 'runbook'
      WHEN {code} AND NOT {term(x, vocab.API_TERMS + vocab.CONFIG_TERMS)} THEN 'code'
      WHEN {term(x, vocab.ROOT_CAUSE_TERMS)} THEN 'root_cause'
      WHEN {term(x, vocab.DEPLOY_TERMS)} AND NOT {term(x, ('where is', 'where are'))} THEN 'deploy'
      WHEN {term(x, vocab.RUNTIME_TERMS)} THEN 'runtime'
      WHEN {term(x, vocab.API_TERMS)} THEN 'api'
      WHEN {term(x, vocab.CONFIG_TERMS)} THEN 'config'
      WHEN {term(x, vocab.ARCHITECTURE_TERMS)} THEN 'architecture'
      ELSE 'generic' END"""


def preference(r: str, field: str) -> str:
    if field == "intent":
        return mapped(r, {k: v["intent"] for k, v in vocab.INTENT_PREFERENCES.items()})
    cells = " ".join(f"WHEN '{k}' THEN [{quoted(v[field])}]" for k, v in vocab.INTENT_PREFERENCES.items())
    return f"CASE {r} {cells} END"


def query_terms(q: str) -> str:
    return (
        f"list_slice(list_filter(regexp_extract_all(lower(trim({q})), '[a-z0-9_./-]+'), "
        f"lambda t: length(t) >= 3 AND t NOT IN ({quoted(vocab.QUERY_STOPWORDS)})), 1, 30)"
    )


def endpoints(q: str) -> str:
    return rf"regexp_extract_all({q}, '/[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_/-]*')"


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def hashes(q: str) -> str:
    bare = rf"list_transform(regexp_extract_all({q}, '(?i)\b([a-f0-9]{{6,40}})\b', 1), lambda h: lower(h))"
    every = f"list_filter(list_concat([{deploy_hash(q)}], {bare}), lambda h: h IS NOT NULL)"
    return f"list_transform([{every}], lambda hs: {ordered_distinct('hs')})[1]"


def services(q: str) -> str:
    names = rf"regexp_extract_all(lower({q}), '\b([a-z][a-z0-9_-]{{2,40}})(?:\s+service)?\b', 1)"
    kept = (
        f"list_filter({names}, lambda n: n NOT IN ({quoted(vocab.SERVICE_STOPWORDS)}) AND NOT starts_with(n, 'http') "
        f"AND NOT list_contains({endpoints(q)}, n) AND NOT list_contains({hashes(q)}, n))"
    )
    return f"list_transform([{kept}], lambda ns: list_slice({ordered_distinct('ns')}, 1, 5))[1]"


def rules(x: str, table: Iterable[tuple[str, Iterable[str]]], default: str) -> str:
    cells = " ".join(f"WHEN {any_of(x, tokens)} THEN '{label}'" for label, tokens in table)
    return f"CASE {cells} ELSE {default} END"


def chunk_source(kind: str) -> str:
    return " ".join(
        f"WHEN {kind} IN ({quoted(kinds)}) THEN '{name}'" for name, kinds in vocab.CHUNK_SOURCE.items()
    )


def span(start: str, end: str) -> str:
    return (
        f"CASE WHEN {start} IS NULL THEN '' WHEN {end} IS NULL OR {start} = {end} THEN CAST({start} AS STRING) "
        f"ELSE {start} || '-' || {end} END"
    )


STOP_TERMS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "did", "do", "does", "for", "from", "had",
    "has", "have", "how", "in", "is", "it", "its", "of", "on", "or", "that", "the", "their",
    "this", "to", "was", "were", "what", "when", "where", "which", "who", "why", "will", "with",
)


def stem(t: str) -> str:
    return rf"regexp_replace({t}, '^([\p{{L}}\p{{N}}]{{3,}}?)(?:ing|edly|ed|ies|es|s|ly)$', '\1')"


def stems(x: str) -> str:
    """Stems in text order with empty places for stop words."""
    stops = ", ".join(stem(f"'{w}'") for w in STOP_TERMS)
    return (
        rf"list_transform(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'), "
        f"lambda t: CASE WHEN {stem('t')} IN ({stops}) THEN '' ELSE {stem('t')} END)"
    )


def windows(content: str, size: int = 393, stride: int = 355) -> str:
    """List of word windows of a text."""
    w = words(content)
    return (
        f"list_transform([{w}], lambda ws: CASE WHEN len(ws) <= {size} THEN [{content}] ELSE "
        f"list_transform(range(0, len(ws), {stride}), lambda s: array_to_string(list_slice(ws, s + 1, s + {size}), ' ')) END)[1]"
    )
