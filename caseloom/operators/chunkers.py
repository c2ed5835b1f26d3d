"""Source-aware chunkers.

Every chunker is a column: an array of chunk structs computed from ``path``,
``content``, ``source_type`` and ``service_name`` of the row at hand. A mixed
corpus is therefore chunked in one scan (``chunk_documents``), where a CASE
picks the chunker of each document, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.defaults import DEFAULTS, Defaults
from caseloom.functions import paths
from caseloom.functions.patterns import (
    LINE_BREAK, WORD, contains_any, first_match, first_of, let, newline_lines, sorted_set,
    split_lines, strings, strip, words,
)
from caseloom.operators.sections import (
    chunk, line_numbers, list_map, ranges, span, text_map, with_leading,
)

NAME = rf"[A-Za-z_]{WORD}*"

# Line formats and declaration patterns.
LOG_LINE = (
    r"^(\d{4}-\d{2}-\d{2}T[\d:.]+Z?)\s+"
    rf"({WORD}+)\s+"
    r"([\p{L}\p{N}_.]+)\s+"
    rf"(?:\[trace_id=({WORD}+)\]\s*)?"
    rf"(?:\[deploy=({WORD}+)\]\s*)?"
    r"(?:(GET|POST|PUT|DELETE|PATCH)\s+(/\S+)\s*)?"
    r"(.*)"
)
ERROR_WORD = r"(?i)\b(?:error|fatal|exception|panic|stack trace)\b"
HEADING = r"(?d)^#{1,6}\s+(.+)$"
INCIDENT_HEADING = r"(?d)^#{1,3}\s+(.+)$"
GO_PACKAGE = rf"(?m)^\s*package\s+({NAME})\b"
GO_FUNC = rf"^\s*func\s+(\([^)]*\)\s*)?({NAME})\s*\("
GO_TYPE = rf"^\s*type\s+({NAME})\s+(struct|interface|func|{WORD}+)\b"
PROTO_DECL = rf"^\s*(service|message|enum)\s+({NAME})\s*\{{?"
PROTO_RPC = rf"^\s*rpc\s+({NAME})\s*\("
PROTO_PACKAGE = r"(?m)^\s*package\s+([A-Za-z_][\p{L}\p{N}_.]*)\s*;"
JS_KIND = rf"^\s*(?:export\s+)?(class|interface|type|enum)\s+({NAME})"
JS_FUNC = (
    rf"^\s*(?:export\s+)?(?:(?:async\s+)?function\s+({NAME})"
    rf"|(?:const|let|var)\s+({NAME})\s*=\s*(?:async\s*)?\()"
)
JAVA_DECL = (
    r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*"
    r"(class|interface|enum|record|void|[A-Za-z_][\p{L}\p{N}_<>\[\]]+)\s+"
    rf"({NAME})\s*(?:\(|\{{)"
)
PY_TOP = rf"^(async\s+def|def|class)\s+({NAME})"
PY_ANY = r"^\s*(?:async\s+def|def|class)\s"

#: Put before lines that begin inside a string or comment; no declaration begins with it.
INSIDE = "\u0001"
# Strings and comments, longest form first. Repetitions are possessive, so that long tokens need no stack.
PLAIN_STRINGS = r'''"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+\''''
BLOCK_COMMENT = r"/\*(?:[^*]|\*(?!/))*+\*/|//[^\n]*+"
TRIPLE_STRING = r'''"""(?:[^"\\]|\\.|"(?!""))*+"""'''
PY_TOKENS = TRIPLE_STRING + "|" + TRIPLE_STRING.replace('"', "'") + "|" + PLAIN_STRINGS + r"|#[^\n]*+"
GO_TOKENS = f"{BLOCK_COMMENT}|{PLAIN_STRINGS}|`[^`]*+`"
JAVA_TOKENS = f"{BLOCK_COMMENT}|{TRIPLE_STRING}|{PLAIN_STRINGS}"
PROTO_TOKENS = f"{BLOCK_COMMENT}|{PLAIN_STRINGS}"
JS_REGEX = r"(?<=[=(,:;!&|?{}\[\n]\s{0,4})/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/"
JS_TOKENS = BLOCK_COMMENT + "|" + JS_REGEX + "|" + PLAIN_STRINGS + r"|`(?:[^`\\]|\\.)*+`"


def emit(docs: DataFrame, chunks: Column) -> DataFrame:
    """One row per chunk, next to the keys of its document."""
    packed = docs.select("document_id", "path", chunks.alias("chunks"))
    exploded = packed.select("document_id", "path", explode_once("chunks", "ordinal", "c"))
    return exploded.where(F.col("ordinal").isNotNull()).select("document_id", "path", "ordinal", "c.*")


def explode_once(array: Column | str, position: str, name: str) -> Column:
    """Outer explode, for arrays that are costly to compute.

    For a plain explode the optimizer infers a filter on the size of the array
    and pushes it below the projection, which would compute the array twice
    more. Callers drop the rows without a position.
    """
    return F.posexplode_outer(array).alias(position, name)


# --- text splitting ---------------------------------------------------------


def window_texts(text: Column | str, defaults: Defaults = DEFAULTS) -> Column:
    """Overlapping word windows; a text that fits is left as it is."""
    size, stride = defaults.window_words, defaults.stride_words

    def cut(ws: Column) -> Column:
        n = F.size(ws)
        return F.when(n <= size, F.array(text if isinstance(text, Column) else F.col(text))).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)),
                lambda s: F.array_join(F.slice(ws, s + 1, size), " "),
            )
        )

    return let(words(text), cut)


# --- markdown and incidents -------------------------------------------------


def markdown_type(title: Column, text: Column) -> Column:
    name = F.lower(F.coalesce(title, F.lit("")))
    return first_of(
        [
            (text.rlike(r"(?dm)^\s*\|.+\|\s*$\n^\s*\|\s*:?-{3,}"), "markdown_table"),
            (
                contains_any(name, ("procedure", "runbook", "how to", "steps", "playbook"))
                | text.rlike(r"(?m)^\s*\d+[.)]\s+"),
                "markdown_procedure",
            ),
            (contains_any(name, ("faq", "questions", "q&a")), "markdown_faq"),
        ],
        "markdown_heading_section",
    )


def incident_type(title: Column) -> Column:
    name = F.lower(title)
    return first_of(
        [
            (name.contains("cause"), "incident_root_cause"),
            (name.contains("timeline"), "incident_timeline"),
            (contains_any(name, ("fix", "mitigation", "action", "lessons")), "incident_action"),
            (
                contains_any(name, ("summary", "symptom", "impact", "severity", "overview")),
                "incident_symptom",
            ),
        ],
        "incident_section",
    )


def config_block_type(key: Column, source_type: Column) -> Column:
    name = F.lower(key)
    return first_of(
        [
            (source_type == "api_doc", "openapi_schema"),
            (name.isin("service", "services", "application", "server"), "config_service_block"),
            (
                name.isin("env", "environment", "environmentvariables", "environment_variables"),
                "env_var_block",
            ),
            (name.isin("dependency", "dependencies", "require", "requires"), "dependency_block"),
        ],
        "config_section",
    )


def _headed(content: Column, heading: str, build: Callable[[Column, Column, Column], Column]) -> Column:
    """Sections that start at heading lines; blank ones are dropped."""

    def cut(lines: Column) -> Column:
        starts = with_leading(line_numbers(lines, lambda line: line.rlike(heading)))

        def section(r: Column) -> Column:
            first = F.get(lines, r["start"] - 1)
            title = F.when(first.rlike(heading), strip(F.regexp_extract(first, heading, 1)))
            return build(title, strip(span(lines, r["start"], r["end"])), r)

        return F.filter(
            F.transform(ranges(starts, F.size(lines)), section), lambda c: c["text"] != ""
        )

    return let(newline_lines(content), cut)


def markdown() -> Column:
    def build(title: Column, text: Column, r: Column) -> Column:
        return let(
            text,
            lambda t: chunk(
                text=t, chunk_type=markdown_type(title, t), source_type=F.col("source_type"),
                doc_type=F.lit("markdown"), service_name=F.col("service_name"),
                section_title=title, start_line=r["start"], end_line=r["end"],
            ),
        )

    return _headed(F.col("content"), HEADING, build)


def incident_service(content: Column, path: Column) -> Column:
    headed = F.lower(first_match(content, r"(?m)^#\s+([A-Za-z][A-Za-z0-9_-]{2,40})"))
    named = F.lower(first_match(content, r"(?i)\bservice[:\s-]+([a-z][a-z0-9_-]{2,40})\b"))
    by_path = paths.service_from_path(path)
    generic = ("incident", "postmortem")
    return F.coalesce(
        F.when(~headed.isin(*generic), headed), named, F.when(~by_path.isin(*generic), by_path)
    )


def incident() -> Column:
    def sections(owner: Column) -> Column:
        def build(title: Column, text: Column, r: Column) -> Column:
            title = F.coalesce(title, F.lit("Preamble"))
            return chunk(
                text=text, chunk_type=incident_type(title), source_type=F.lit("incident"),
                doc_type=F.lit("incident"), service_name=owner, section_title=title,
                start_line=r["start"], end_line=r["end"],
            )

        return _headed(F.col("content"), INCIDENT_HEADING, build)

    return let(incident_service(F.col("content"), F.col("path")), sections)


# --- logs -------------------------------------------------------------------


def _log_field(line: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(line, LOG_LINE, group), F.lit(""))


def log_timestamp(line: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(_log_field(line, 1), "Z+$", ""))


def is_error_line(line: Column) -> Column:
    level = F.upper(F.coalesce(_log_field(line, 2), F.lit("")))
    return level.isin("ERROR", "FATAL", "CRITICAL") | line.rlike(ERROR_WORD)


def log_chunk(lines: Column, start: Column, kind: str, owner: Column, **extra: Column) -> Column:
    """One log chunk over some lines, with what its lines carry."""
    field = lambda g: F.array_compact(F.transform(lines, lambda x: _log_field(x, g)))
    facts = F.struct(
        F.array_compact(F.transform(lines, log_timestamp)).alias("times"),
        sorted_set(F.transform(field(2), F.upper)).alias("levels"),
        sorted_set(field(4)).alias("traces"),
        sorted_set(field(5)).alias("hashes"),
        sorted_set(field(7)).alias("endpoints"),
    )
    return let(
        facts,
        lambda f: chunk(
            text=F.array_join(lines, "\n"), chunk_type=F.lit(kind), source_type=F.lit("logs"),
            doc_type=F.lit("log"), service_name=owner,
            endpoint=F.when(F.size(f["endpoints"]) == 1, F.get(f["endpoints"], F.lit(0))),
            deploy_hash=F.get(f["hashes"], F.lit(0)),
            timestamp_start=F.array_min(f["times"]), timestamp_end=F.array_max(f["times"]),
            start_line=start, end_line=start + F.size(lines) - 1,
            metadata=text_map(**extra),
            metadata_lists=list_map(
                trace_ids=f["traces"], levels=f["levels"], log_levels=f["levels"],
                endpoints=f["endpoints"],
            ),
        ),
    )


def log_windows(lines: Column, owner: Column, defaults: Defaults = DEFAULTS) -> Column:
    size = defaults.log_window_lines
    windows = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1)), F.lit(size)),
        lambda s: let(F.slice(lines, s, size), lambda w: log_chunk(w, s, "log_time_window", owner)),
    )
    return F.filter(windows, lambda c: strip(c["text"]) != "")


def log_bursts(lines: Column, owner: Column, defaults: Defaults = DEFAULTS) -> Column:
    """Maximal runs of error lines, each with the line after it."""

    def runs(flags: Column) -> Column:
        last = F.size(flags)
        edge = lambda step: F.array_compact(
            F.transform(
                flags,
                lambda bad, i: F.when(
                    bad & ~F.coalesce(F.get(flags, i + step), F.lit(False)), i + 1
                ),
            )
        )
        pairs = F.zip_with(
            edge(-1), edge(1), lambda a, b: F.struct(a.alias("start"), b.alias("end"))
        )
        long = F.filter(
            pairs, lambda r: r["end"] - r["start"] + 1 >= defaults.burst_min_errors
        )
        return F.transform(
            long,
            lambda r: F.struct(
                r["start"].alias("start"),
                F.least(r["end"] + 1, last).alias("close"),
                (r["end"] - r["start"] + 1).alias("errors"),
            ),
        )

    def build(r: Column) -> Column:
        kept = F.slice(
            lines, r["start"], F.least(r["close"] - r["start"] + 1, F.lit(defaults.burst_max_lines))
        )
        return let(
            kept,
            lambda w: log_chunk(
                w, r["start"], "log_error_burst", owner,
                error_line_count=r["errors"], cluster_end_line=r["close"],
            ),
        )

    return F.transform(let(F.transform(lines, is_error_line), runs), build)


def logs(defaults: Defaults = DEFAULTS) -> Column:
    def cut(doc: Column) -> Column:
        lines, owner = doc["lines"], doc["owner"]
        return F.concat(log_windows(lines, owner, defaults), log_bursts(lines, owner, defaults))

    return let(
        F.struct(
            newline_lines(strip("content")).alias("lines"),
            F.coalesce("service_name", paths.service_from_path("path")).alias("owner"),
        ),
        cut,
    )


# --- deploys ----------------------------------------------------------------


def deploy_entries(content: Column) -> Column:
    """Entries of a deploy history: the elements of an array, or the object itself."""
    parsed = F.try_parse_json(content)
    return F.coalesce(F.try_variant_get(parsed, "$", "array<variant>"), F.array(parsed))


def _entry(v: Column, key: str) -> Column:
    return F.nullif(F.try_variant_get(v, f"$.{key}", "string"), F.lit(""))


def deploy_history() -> Column:
    def build(v: Column) -> Column:
        sha = _entry(v, "commit_sha")
        known = F.coalesce(_entry(v, "deploy_hash"), sha, _entry(v, "commit"), _entry(v, "sha"))
        hash_ = F.coalesce(known, F.lit("unknown"))
        service = F.coalesce(_entry(v, "service_name"), _entry(v, "service"))
        at = F.coalesce(F.try_variant_get(v, "$.deployed_at", "string"), F.lit(""))
        files = F.coalesce(
            F.try_variant_get(v, "$.changed_files", "array<string>"),
            F.array(F.try_variant_get(v, "$.changed_files", "string")),
        )
        text = F.concat_ws(
            "\n",
            F.concat(F.lit("Deploy: "), hash_),
            F.concat(F.lit("Service: "), F.coalesce(service, F.lit("None"))),
            F.concat(F.lit("Author: "), F.coalesce(F.try_variant_get(v, "$.author", "string"), F.lit("unknown"))),
            F.concat(F.lit("Deployed at: "), at),
            F.concat(F.lit("Commit: "), F.coalesce(F.try_variant_get(v, "$.commit_sha", "string"), F.lit("unknown"))),
            F.concat(F.lit("Summary: "), F.coalesce(F.try_variant_get(v, "$.summary", "string"), F.lit(""))),
            F.concat(F.lit("Changed files: "), F.array_join(F.array_compact(files), ", ")),
        )
        relevant = F.schema_of_variant(v).startswith("OBJECT") & (
            known.isNotNull() | _entry(v, "deployed_at").isNotNull()
        )
        return F.when(
            relevant,
            chunk(
                text=text, chunk_type=F.lit("deploy_commit"), source_type=F.lit("deploy"),
                doc_type=F.lit("deploy"), service_name=service, deploy_hash=hash_,
                timestamp_start=F.try_to_timestamp(at),
                section_title=F.concat(F.lit("deploy "), hash_),
                start_line=F.lit(1), end_line=F.lit(1),
                metadata=text_map(
                    kind="deploy_commit", author=_entry(v, "author"), summary=_entry(v, "summary"),
                    commit_sha=sha, deployed_at=at,
                ),
                metadata_lists=list_map(changed_files=F.array_compact(files)),
            ),
        )

    return F.array_compact(F.transform(deploy_entries(F.col("content")), build))


def patch() -> Column:
    file_hash = first_match("path", r"(?i)(?:diff|deploy)[_-]([a-f0-9]{6,})")

    def build(raw: Column, i: Column) -> Column:
        def section(text: Column) -> Column:
            changed = F.coalesce(
                first_match(text, r"(?dm)^diff --git a/(.+?) b/(.+?)$", 2),
                F.concat(F.lit("section_"), i.cast("string")),
            )
            return chunk(
                text=text, chunk_type=F.lit("deploy_diff"), source_type=F.lit("deploy"),
                doc_type=F.lit("deploy"), service_name=paths.service_from_path(changed),
                deploy_hash=file_hash,
                section_title=F.concat(F.lit("diff: "), changed), start_line=F.lit(1),
                end_line=F.size(newline_lines(text)),
                metadata=text_map(
                    changed_file=changed,
                    is_new_file=F.when(
                        ~text.contains("+++ /dev/null") & text.contains("new file mode"), "true"
                    ).otherwise("false"),
                ),
            )

        return let(strip(raw), section)

    parts = F.split(F.col("content"), r"(?m)(?=^diff --git )")
    return F.filter(F.transform(parts, build), lambda c: c["text"] != "")


# --- code -------------------------------------------------------------------


def code_lines(content: Column | str, tokens: str, split: Callable[[Column], Column] = split_lines) -> Column:
    """Lines of a source text, those marked that begin inside a string or comment.

    The text is read from left to right as tokens and what lies between them.
    An opening that nothing closes is code like any other, so a stray quote
    hides no declaration. A string inside a template string's braces ends it.
    """
    content = F.col(content) if isinstance(content, str) else content
    pieces = F.regexp_extract_all(content, F.lit(rf"(?s){tokens}|[^\"'`/#]++|."), F.lit(0))
    hidden = F.transform(
        pieces,
        lambda piece: F.when(
            piece.rlike(r"^[\"'`/]"), F.regexp_replace(piece, rf"({LINE_BREAK})", f"$1{INSIDE}")
        ).otherwise(piece),
    )
    several = content.rlike(r"/\*|`|\"\"\"|'''|\\\n")
    return split(F.when(several, F.array_join(hidden, "")).otherwise(content))


def _declared(
    declaration: Callable[[Column], Column],
    types: dict[str, str],
    *,
    language: Column | str,
    preamble: Column | str,
    fallback: Column | str,
    source_type: str = "code",
    tokens: str,
    package: Column | None = None,
    prefix: Column | None = None,
) -> Column:
    """Preamble, one chunk per declaration up to the next, or the whole file.

    ``declaration`` gives a (kind, symbol) struct for a line, NULL for others;
    ``tokens`` are the language's strings and comments, inside which nothing is
    declared; ``prefix`` is put before the chunk types, for languages that share
    a grammar.
    """
    as_lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    fallback, preamble, language = as_lit(fallback), as_lit(preamble), as_lit(language)
    package = F.lit(None).cast("string") if package is None else package

    def kind_type(kind: Column) -> Column:
        named = first_of([(kind == k, v) for k, v in types.items()])
        return F.coalesce(named if prefix is None else F.concat(prefix, named), fallback)

    def common(**fields: Column) -> Column:
        return chunk(
            source_type=F.lit(source_type), doc_type=F.lit(source_type),
            service_name=F.col("service_name"), **fields,
        )

    def cut(lines: Column) -> Column:
        found = F.array_compact(
            F.transform(
                code_lines("content", tokens),
                lambda line, i: let(
                    declaration(line),
                    lambda d: F.when(
                        d.isNotNull(),
                        F.struct(
                            (i + 1).alias("line"), d["kind"].alias("kind"),
                            d["symbol"].alias("symbol"),
                        ),
                    ),
                ),
            )
        )

        def assemble(decls: Column) -> Column:
            last = F.size(lines)
            lead_end = F.get(decls, F.lit(0))["line"] - 1
            lead = common(
                text=strip(span(lines, F.lit(1), lead_end)), chunk_type=preamble,
                section_title=F.lit("module preamble"), start_line=F.lit(1), end_line=lead_end,
                metadata=text_map(language=language, kind="preamble", package_name=package),
            )

            def section(d: Column, i: Column) -> Column:
                end = F.coalesce(F.get(decls, i + 1)["line"] - 1, last)
                return common(
                    text=strip(span(lines, d["line"], end)), chunk_type=kind_type(d["kind"]),
                    section_title=F.concat_ws(" ", d["kind"], d["symbol"]),
                    start_line=d["line"], end_line=end,
                    metadata=text_map(
                        language=language, symbol=d["symbol"], symbol_name=d["symbol"],
                        kind=d["kind"], package_name=package,
                    ),
                )

            whole = common(
                text=F.col("content"), chunk_type=fallback,
                section_title=paths.file_name("path"), start_line=F.lit(1), end_line=last,
                metadata=text_map(language=language, kind="file", package_name=package),
            )
            parts = F.filter(
                F.concat(
                    F.filter(F.array(lead), lambda c: lead_end >= 1),
                    F.transform(decls, section),
                ),
                lambda c: c["text"] != "",
            )
            return F.when(F.size(decls) > 0, parts).otherwise(F.array(whole))

        return F.filter(let(found, assemble), lambda c: F.size(lines) > 0)

    return let(split_lines("content"), cut)


def _decl(kind: Column | str, symbol: Column) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.struct(kind.alias("kind"), symbol.alias("symbol"))


def go() -> Column:
    def declaration(raw: Column) -> Column:
        line = strip(raw)
        receiver = F.regexp_extract(line, GO_FUNC, 1) != ""
        return F.when(
            line.rlike(GO_FUNC),
            _decl(
                F.when(receiver, "method").otherwise("function"), F.regexp_extract(line, GO_FUNC, 2)
            ),
        ).when(
            line.rlike(GO_TYPE),
            _decl(F.regexp_extract(line, GO_TYPE, 2), F.regexp_extract(line, GO_TYPE, 1)),
        )

    types = {
        "function": "go_function", "method": "go_method", "struct": "go_struct",
        "interface": "go_interface", "func": "go_type",
    }
    return _declared(
        declaration, types, language="go", preamble="go_module", fallback="go_fallback",
        tokens=GO_TOKENS,
        package=first_match("content", GO_PACKAGE),
    )


def proto() -> Column:
    def declaration(line: Column) -> Column:
        return F.when(
            line.rlike(PROTO_DECL),
            _decl(F.regexp_extract(line, PROTO_DECL, 1), F.regexp_extract(line, PROTO_DECL, 2)),
        ).when(line.rlike(PROTO_RPC), _decl("rpc", F.regexp_extract(line, PROTO_RPC, 1)))

    types = {
        "service": "proto_service", "rpc": "proto_rpc", "message": "proto_message",
        "enum": "proto_enum",
    }
    return _declared(
        declaration, types, language="proto", preamble="proto_preamble",
        fallback="proto_fallback", source_type="api_doc", tokens=PROTO_TOKENS,
        package=first_match("content", PROTO_PACKAGE),
    )


def script() -> Column:
    """JavaScript and TypeScript; .jsx counts as js, .tsx as ts."""
    language = F.when(paths.suffix("path").isin(".ts", ".tsx"), "ts").otherwise("js")

    def declaration(line: Column) -> Column:
        name = F.coalesce(
            first_match(line, JS_FUNC, 1), first_match(line, JS_FUNC, 2)
        )
        return F.when(
            line.rlike(JS_KIND),
            _decl(F.regexp_extract(line, JS_KIND, 1), F.regexp_extract(line, JS_KIND, 2)),
        ).when(name.isNotNull(), _decl("function", name))

    types = {
        "class": "_class", "interface": "_interface", "type": "_interface", "enum": "_class",
        "function": "_function",
    }
    return let(
        language,
        lambda lang: _declared(
            declaration, types, language=lang, preamble=F.concat(lang, F.lit("_module")),
            fallback=F.concat(lang, F.lit("_fallback")), prefix=lang, tokens=JS_TOKENS,
        ),
    )


def java() -> Column:
    def declaration(line: Column) -> Column:
        kind = F.lower(F.regexp_extract(line, JAVA_DECL, 1))
        return F.when(
            line.rlike(JAVA_DECL),
            _decl(
                F.when(kind.isin("class", "interface", "enum", "record"), kind).otherwise("function"),
                F.regexp_extract(line, JAVA_DECL, 2),
            ),
        )

    types = {
        "class": "java_class", "interface": "java_interface", "enum": "java_class",
        "record": "java_class", "function": "java_method",
    }
    return _declared(
        declaration, types, language="java", preamble="java_package",
        fallback="java_fallback", tokens=JAVA_TOKENS,
    )


def python() -> Column:
    """Top-level functions and classes, found by their place in the margin.

    A block runs from its ``def`` or ``class`` line to the line before the next
    statement in the margin, without trailing blanks and comments. Lines that
    begin inside a string are no statements.
    """

    def common(**fields: Column) -> Column:
        return chunk(
            source_type=F.lit("code"), doc_type=F.lit("code"),
            service_name=F.col("service_name"), **fields,
        )

    def cut(lines: Column, marked: Column) -> Column:
        statements = line_numbers(marked, lambda line: line.rlike(rf"^[^\s#)\]}}{INSIDE}]"))
        first_def = F.array_min(line_numbers(marked, lambda line: line.rlike(PY_ANY)))

        def block(r: Column) -> Column:
            head = F.get(lines, r["start"] - 1)
            is_class = F.regexp_extract(head, PY_TOP, 1) == "class"
            symbol = F.regexp_extract(head, PY_TOP, 2)
            body = F.regexp_replace(span(lines, r["start"], r["end"]), r"(?:\s*\n\s*#[^\n]*|\s)+\z", "")
            kind = F.when(is_class, "class").otherwise("function")
            return let(
                body,
                lambda text: common(
                    text=text,
                    chunk_type=F.concat(F.lit("python_"), kind),
                    section_title=F.concat(
                        F.when(is_class, "class ").otherwise("def "), symbol
                    ),
                    start_line=r["start"],
                    end_line=r["start"] + F.size(newline_lines(text)) - 1,
                    metadata=text_map(
                        language="python", symbol=symbol, symbol_name=symbol, kind=kind
                    ),
                ),
            )

        blocks = F.transform(
            F.filter(
                ranges(statements, F.size(lines)),
                lambda r: F.get(lines, r["start"] - 1).rlike(PY_TOP),
            ),
            block,
        )
        lead_end = first_def - 1
        lead = common(
            text=strip(span(lines, F.lit(1), lead_end)), chunk_type=F.lit("python_module"),
            section_title=F.lit("module preamble"), start_line=F.lit(1), end_line=lead_end,
            metadata=text_map(language="python", kind="preamble"),
        )
        whole = common(
            text=F.col("content"), chunk_type=F.lit("python_fallback"), start_line=F.lit(1),
            end_line=F.size(lines),
            metadata=text_map(language="python", kind="file", fallback_reason="no_declarations"),
        )
        parts = F.filter(
            F.concat(F.filter(F.array(lead), lambda c: lead_end >= 1), blocks),
            lambda c: c["text"] != "",
        )
        return let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(whole)))

    marked = code_lines("content", PY_TOKENS, newline_lines)
    return let(newline_lines("content"), lambda lines: let(marked, lambda m: cut(lines, m)))


def generic_code() -> Column:
    lines = F.size(split_lines("content"))
    whole = chunk(
        text=F.col("content"), chunk_type=F.lit("code_file"), source_type=F.lit("code"),
        doc_type=F.lit("code"), service_name=F.col("service_name"),
        section_title=paths.file_name("path"), start_line=F.lit(1), end_line=lines,
        metadata=text_map(parser="generic_code"),
    )
    return F.filter(F.array(whole), lambda c: c["text"] != "")


# --- structured documents ---------------------------------------------------


def json_object(content: Column | str) -> Column:
    """Top-level members of a JSON object in file order; NULL for anything else."""
    content = content if isinstance(content, Column) else F.col(content)
    members = F.from_json(content, "map<string,variant>")
    is_object = F.schema_of_variant(F.try_parse_json(content)).startswith("OBJECT")
    return F.when(is_object, members)


def render_section(key: Column, value: Column) -> Column:
    """The key over its value as JSON with ordered keys."""
    return strip(F.concat(key, F.lit("\n"), F.to_json(value)))


def _doc_kind(source_type: Column) -> Column:
    return F.when(source_type == "api_doc", "api_doc").otherwise("config")


def rest_text(entries: Column, limit: int) -> Column:
    """The rendered entries after the limit as one text, empty if there are none."""
    rest = F.slice(entries, limit + 1, F.greatest(F.size(entries) - limit, F.lit(0)))
    return F.array_join(F.transform(rest, lambda e: render_section(e["key"], e["value"])), "\n")


def rest_count(entries: Column, limit: int) -> Column:
    return F.greatest(F.size(entries) - limit, F.lit(0)).cast("string")


def openapi_chunks(limit: int = DEFAULTS.openapi_entries) -> Column:
    """Chunks for the paths and the schemas of an OpenAPI document.

    Each kind has a chunk of its own up to the limit; all later entries share
    one last chunk that tells how many they are.
    """
    content, last = F.col("content"), F.greatest(F.size(split_lines("content")), F.lit(1))
    root = F.try_parse_json(content)
    section = lambda where: F.coalesce(
        F.try_variant_get(root, where, "map<string,variant>"),
        F.expr("cast(map() as map<string,variant>)"),
    )
    common = dict(
        source_type=F.lit("api_doc"), doc_type=F.lit("api_doc"),
        service_name=F.col("service_name"), start_line=F.lit(1), end_line=last,
    )

    def endpoint(e: Column) -> Column:
        keys = F.coalesce(
            F.map_keys(F.try_variant_get(e["value"], "$", "map<string,variant>")), strings(())
        )
        verbs = F.transform(
            F.filter(keys, lambda k: F.lower(k).isin("get", "post", "put", "patch", "delete")),
            F.upper,
        )
        label = F.when(
            F.size(verbs) > 0, F.concat(F.array_join(verbs, ", "), F.lit(" "), e["key"])
        ).otherwise(e["key"])
        return chunk(
            text=render_section(e["key"], e["value"]), chunk_type=F.lit("openapi_endpoint"),
            section_title=label, endpoint=label,
            metadata=text_map(
                language=paths.extension("path"), endpoint=e["key"], kind="openapi_path"
            ),
            metadata_lists=list_map(methods=verbs), **common,
        )

    def schema(e: Column) -> Column:
        return chunk(
            text=render_section(e["key"], e["value"]), chunk_type=F.lit("openapi_schema"),
            section_title=F.concat(F.lit("schema "), e["key"]),
            metadata=text_map(
                language=paths.extension("path"), symbol_name=e["key"], kind="openapi_schema"
            ),
            **common,
        )

    def rest(where: str, chunk_type: str, title: str) -> Column:
        entries = F.map_entries(section(where))
        late = chunk(
            text=rest_text(entries, limit), chunk_type=F.lit(chunk_type), section_title=F.lit(title),
            metadata=text_map(language=paths.extension("path"), kind="openapi_rest", rest_entries=rest_count(entries, limit)), **common,
        )
        return F.filter(F.array(late), lambda c: c["text"] != "")

    take = lambda where: F.slice(F.map_entries(section(where)), 1, limit)
    return F.concat(
        F.transform(take("$.paths"), endpoint), rest("$.paths", "openapi_endpoint", "further paths"),
        F.transform(take("$.components.schemas"), schema), rest("$.components.schemas", "openapi_schema", "further schemas"),
    )


def structured(limit: int = DEFAULTS.config_keys) -> Column:
    """Config files by top-level key, OpenAPI files by path and schema.

    JSON is parsed; other formats and unusable JSON become one whole-file chunk.
    Keys after the limit share one last chunk that tells how many they are.
    """
    content, kind = F.col("content"), F.col("source_type")
    last = F.greatest(F.size(split_lines("content")), F.lit(1))
    is_json = F.lower("path").endswith(".json")

    def block(e: Column) -> Column:
        return chunk(
            text=render_section(e["key"], e["value"]),
            chunk_type=config_block_type(e["key"], kind), source_type=kind,
            doc_type=_doc_kind(kind), service_name=F.col("service_name"),
            section_title=F.concat(F.lit("config "), e["key"]), start_line=F.lit(1), end_line=last,
            metadata=text_map(
                language=paths.extension("path"), config_key=e["key"], kind="config"
            ),
        )

    whole = F.array(
        chunk(
            text=content, chunk_type=F.lit("config_fallback"), source_type=kind,
            doc_type=_doc_kind(kind), service_name=F.col("service_name"),
            section_title=paths.file_name("path"), start_line=F.lit(1), end_line=last,
            metadata=text_map(language=paths.extension("path"), kind="config_file"),
        )
    )
    entries = F.map_entries(json_object(content))
    late = chunk(
        text=rest_text(entries, limit), chunk_type=F.lit("config_section"), source_type=kind, doc_type=_doc_kind(kind),
        service_name=F.col("service_name"), section_title=F.lit("further config keys"), start_line=F.lit(1), end_line=last,
        metadata=text_map(language=paths.extension("path"), kind="config_rest", rest_entries=rest_count(entries, limit)),
    )
    blocks = F.concat(F.transform(F.slice(entries, 1, limit), block), F.filter(F.array(late), lambda c: c["text"] != ""))
    api = F.when(is_json & (kind == "api_doc"), openapi_chunks())
    config = F.when(is_json, blocks)
    nonempty = lambda c: let(c, lambda x: F.when(F.size(x) > 0, x))
    return F.coalesce(nonempty(api), nonempty(config), whole)


# --- bounded fallback -------------------------------------------------------


def estimated_segments(text: Column | str, defaults: Defaults = DEFAULTS) -> Column:
    """Token windows a raw chunk is expected to need."""
    tokens = F.greatest(F.floor(F.size(words(text)) * 1.3), F.lit(1))
    return F.ceil(tokens / defaults.max_chunk_tokens).cast("int")


def bounded_fallback(defaults: Defaults = DEFAULTS) -> Column:
    """Repack a document by lines so that its chunk count stays within the limit.

    Lines are packed greedily to a token target; the fold carries the words of
    the open chunk and the line it started at, and yields the closed ranges. A
    tail beyond the limit joins the last chunk, so that no text is lost.
    """
    limit, cap = defaults.max_chunk_tokens, defaults.max_chunks_per_document
    tokens = lambda n: F.floor(n * 1.3).cast("int")

    def cut(lines: Column) -> Column:
        counts = F.transform(lines, lambda x: F.size(words(x)))
        total = F.greatest(tokens(F.size(words("content"))), F.lit(1))
        pieces = F.least(F.lit(cap), F.greatest(F.lit(1), F.ceil(total / limit)))
        target = F.greatest(F.lit(limit), F.ceil(total / pieces)).cast("int")

        def pack(shape: Column) -> Column:
            goal = shape["goal"]
            seed = F.struct(
                F.lit(1).alias("start"), F.lit(0).alias("words"), F.lit(0).alias("at"),
                F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("closed"),
            )
            one = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))

            def step(acc: Column, n: Column) -> Column:
                here, grown = acc["at"] + 1, acc["words"] + n
                full = (acc["start"] < here) & (tokens(grown) > goal)
                held = F.when(full, F.concat(acc["closed"], one(acc["start"], acc["at"]))).otherwise(
                    acc["closed"]
                )
                start = F.when(full, here).otherwise(acc["start"])
                load = F.when(full, n).otherwise(grown)
                done = tokens(load) >= goal
                return F.struct(
                    F.when(done, here + 1).otherwise(start).alias("start"),
                    F.when(done, 0).otherwise(load).alias("words"),
                    here.alias("at"),
                    F.when(done, F.concat(held, one(start, here))).otherwise(held).alias("closed"),
                )

            def finish(acc: Column) -> Column:
                return F.when(
                    acc["start"] <= acc["at"],
                    F.concat(acc["closed"], one(acc["start"], acc["at"])),
                ).otherwise(acc["closed"])

            return F.aggregate(shape["counts"], seed, step, finish)

        packed = let(
            let(F.struct(counts.alias("counts"), target.alias("goal")), pack),
            lambda p: F.when(F.size(p) <= cap, p).otherwise(
                F.concat(
                    F.slice(p, 1, cap - 1),
                    F.array(
                        F.struct(
                            F.get(p, F.lit(cap - 1))["start"].alias("start"),
                            F.get(p, F.size(p) - 1)["end"].alias("end"),
                        )
                    ),
                )
            ),
        )
        return F.transform(
            packed,
            lambda r: chunk(
                text=strip(span(lines, r["start"], r["end"])),
                chunk_type=paths.fallback_chunk_type("path", "source_type"),
                source_type=F.col("source_type"), doc_type=paths.doc_type("path"),
                service_name=F.col("service_name"), section_title=paths.file_name("path"),
                start_line=r["start"], end_line=r["end"],
                metadata=text_map(fallback_reason="chunk_limit_guard"),
            ),
        )

    return F.filter(let(split_lines("content"), cut), lambda c: c["text"] != "")


# --- dispatch ---------------------------------------------------------------

PARSERS: dict[str, Callable[[], Column]] = {
    "logs": logs,
    "patch": patch,
    "deploy_history": deploy_history,
    "incident": incident,
    "python": python,
    "go": go,
    "script": script,
    "java": java,
    "proto": proto,
    "generic_code": generic_code,
    "structured": structured,
    "markdown": markdown,
}


def parser_name(path: Column | str, source_type: Column | str) -> Column:
    """Parser for a document; first rule wins, NULL where none is configured."""
    path = F.col(path) if isinstance(path, str) else path
    kind = F.col(source_type) if isinstance(source_type, str) else source_type
    lower, ext = F.lower(path), paths.suffix(path)
    return first_of(
        [
            ((kind == "logs") | (ext == ".log"), "logs"),
            (ext.isin(".patch", ".diff"), "patch"),
            (
                (ext == ".json")
                & ((kind == "deploy") | contains_any(lower, ("deploy", "release", "commit"))),
                "deploy_history",
            ),
            ((kind == "incident") | contains_any(lower, ("incident", "postmortem")), "incident"),
            (ext == ".py", "python"),
            (ext == ".go", "go"),
            (ext.isin(".js", ".ts", ".jsx", ".tsx"), "script"),
            (ext == ".java", "java"),
            (ext == ".proto", "proto"),
            (kind == "code", "generic_code"),
            (ext.isin(".yaml", ".yml", ".toml", ".ini"), "structured"),
            ((ext == ".json") & kind.isin("config", "api_doc"), "structured"),
            (ext.isin(".md", ".txt", ".json"), "markdown"),
            (kind.isin("config", "unknown_text", "runbook", "api_doc"), "markdown"),
        ]
    )


def dispatched(parser: Column | str = "parser") -> Column:
    """Chunks of whichever parser the row names, in one projection."""
    parser = F.col(parser) if isinstance(parser, str) else parser
    return first_of([(parser == name, build()) for name, build in PARSERS.items()])


def chunk_documents(docs: DataFrame) -> DataFrame:
    """Raw chunks of a mixed corpus, in one scan and without a shuffle."""
    routed = docs.withColumn("parser", parser_name("path", "source_type"))
    return emit(routed, dispatched())


def chunking_hints(docs: DataFrame, limit: int = 500) -> DataFrame:
    """Advisory boundaries: symbols of Go and proto files, markdown headings."""
    path, kind = F.col("path"), F.col("source_type")
    go_line = rf"^\s*(?:func\s+(?:\([^)]*\)\s*)?{WORD}+\s*\(|type\s+{WORD}+\s+(?:struct|interface))"
    proto_line = rf"^\s*(?:service|rpc|message|enum)\s+({NAME})"

    def boundaries(lines: Column, pattern: str, hint: str) -> Column:
        return F.transform(
            ranges(line_numbers(lines, lambda x: x.rlike(pattern)), F.size(lines)),
            lambda r: F.struct(
                F.lit(hint).alias("type"), r["start"].alias("start_line"),
                F.greatest(r["end"], r["start"]).alias("end_line"), F.lit("high").alias("priority"),
            ),
        )

    def cut(lines: Column) -> Column:
        whole = F.array(
            F.struct(
                F.lit("document").alias("type"), F.lit(1).alias("start_line"),
                F.greatest(F.size(lines), F.lit(1)).alias("end_line"), F.lit("low").alias("priority"),
            )
        )
        found = (
            F.when((kind == "code") & path.endswith(".go"), boundaries(lines, go_line, "go_symbol"))
            .when(
                (kind == "api_doc") & path.endswith(".proto"),
                boundaries(lines, proto_line, "proto_symbol"),
            )
            .when(path.endswith(".md"), boundaries(lines, HEADING, "markdown_section"))
        )
        return F.slice(
            let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(whole)), 1, limit
        )

    packed = docs.select("document_id", "path", let(split_lines("content"), cut).alias("hints"))
    exploded = packed.select("document_id", "path", explode_once("hints", "ordinal", "h"))
    return exploded.where(F.col("ordinal").isNotNull()).select("document_id", "path", "h.*")


__all__ = [
    "PARSERS", "bounded_fallback", "chunk_documents", "chunking_hints", "config_block_type", "deploy_history",
    "dispatched", "emit", "estimated_segments", "explode_once", "generic_code", "go", "incident", "incident_type", "is_error_line",
    "java", "logs", "markdown", "markdown_type", "parser_name", "patch", "proto", "python",
    "script", "structured", "window_texts",
]
