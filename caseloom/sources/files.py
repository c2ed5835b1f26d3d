"""File scans: recursive reads, globs, triage, inspection and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.defaults import DEFAULTS, Defaults
from caseloom.functions import paths, text
from caseloom.functions.patterns import first_of, strip


def scan_files(spark: SparkSession, root: str, max_bytes: int | None = None, extensions: tuple[str, ...] = ()) -> DataFrame:
    """All regular files under a folder, with relative path, size and bytes.

    With a size or extensions given, only the bytes of files that fit are read;
    the others are listed with NULL. Both tests reach the scan, so a file too
    large for one row does not fail it. Cache folders and dot-files are left
    out. The order of a scan carries no meaning; whatever needs path order sorts
    on ``path``.
    """
    reader = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if max_bytes is None and not extensions:
        raw = reader().load(root)
    else:
        fitting = reader()
        if extensions:
            fitting = fitting.option("pathGlobFilter", "*{" + ",".join(extensions) + "}")
        bodies = fitting.load(root)
        if max_bytes is not None:
            bodies = bodies.where(F.col("length") <= max_bytes)
        raw = reader().load(root).drop("content").join(bodies.select("path", "content"), "path", "left")
    base = root.rstrip("/").removeprefix("file:")
    clean = F.regexp_replace("path", r"^file:/*", "/")
    relative = F.regexp_replace(clean, "^" + _quoted(base) + "/", "")
    files = raw.select(
        relative.alias("path"), F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"), "content",
    )
    return files.where(
        ~F.contains("path", F.lit("__pycache__")) & ~paths.file_name("path").startswith(".")
    )


def _quoted(literal: str) -> str:
    return r"\Q" + literal + r"\E"


def select_paths(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None,
                 max_files: int | None = None) -> DataFrame:
    """Files that match the globs; a limit counts them in path order."""
    kept = files
    if include:
        kept = kept.where(paths.matches_globs("path", include))
    if exclude:
        kept = kept.where(~paths.matches_globs("path", exclude))
    return kept if max_files is None else kept.orderBy("path").limit(max_files)


def triage(files: DataFrame, head: Column | str = "head", defaults: Defaults = DEFAULTS) -> DataFrame:
    """Tag files with the reason they are skipped; NULL for the others."""
    return files.withColumn(
        "skip_reason",
        paths.skip_reason("path", "size_bytes", head, defaults.max_document_bytes, defaults.supported_extensions),
    )


def local_skip_reason(content: Column | str = "text", defaults: Defaults = DEFAULTS) -> Column:
    """Shorter triage of a local ingest run."""
    return first_of(
        [
            (~paths.suffix("path").isin(*defaults.supported_extensions), "unsupported_extension"),
            (F.col("size_bytes") > defaults.max_document_bytes, "file_too_large"),
            (strip(content) == "", "empty_file"),
        ]
    )


def read_documents(spark: SparkSession, root: str, defaults: Defaults = DEFAULTS) -> DataFrame:
    """Files of a folder as documents, with a skip reason for those left out.

    The bytes of oversized and unsupported files are not read.
    """
    files = scan_files(spark, root, defaults.max_document_bytes, defaults.supported_extensions)
    wanted = paths.suffix("path").isin(*defaults.supported_extensions) & (
        F.col("size_bytes") <= defaults.max_document_bytes
    )
    decoded = files.withColumn(
        "text", F.when(wanted, F.try_validate_utf8(F.col("content").cast("string")))
    ).withColumn(
        "text", F.coalesce("text", F.when(wanted, F.make_valid_utf8(F.col("content").cast("string"))), F.lit(""))
    )
    return decoded.select(
        F.col("path").alias("external_id"), "path", paths.source_type("path").alias("source_type"),
        F.col("text").alias("content"), text.content_hash("text").alias("content_hash"),
        "size_bytes", "modified_at",
        F.create_map(F.lit("service_name"), F.coalesce(paths.service_from_path("path"), F.lit(""))).alias("metadata"),
        local_skip_reason("text", defaults).alias("skip_reason"),
    )


def fingerprint(files: DataFrame, keys: list[str]) -> DataFrame:
    """Version hash of a set of files from their paths and times, 16 hex digits.

    Each file is digested by itself and the digests are combined with XOR, so
    the result does not depend on order and no task sees the whole listing.
    """
    digest = F.sha2(F.concat_ws("|", "path", F.col("modified_at").cast("string")), 256)
    piece = lambda i: F.bit_xor(
        F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("bigint")
    )
    combined = files.groupBy(*keys).agg(
        *[piece(i).alias(f"_x{i}") for i in range(4)], F.count("*").alias("files")
    )
    body = F.concat_ws("|", *[F.col(f"_x{i}").cast("string") for i in range(4)], F.col("files").cast("string"))
    return combined.select(*keys, "files", F.substring(F.sha2(body, 256), 1, 16).alias("version_hash"))


def collect(files: DataFrame, defaults: Defaults = DEFAULTS, **repository: str) -> DataFrame:
    """Normalised documents from triaged files: redacted, classified, described."""
    from caseloom.functions.facts import document_facts

    kept = files.where(F.col("skip_reason").isNull())
    redacted = kept.withColumn("_r", text.redact_collected("content")).withColumns(
        {"content": F.col("_r.text"), "redaction_count": F.col("_r.redactions")}
    ).drop("_r")
    typed = redacted.withColumns(
        {
            "source_type": paths.collected_source_type("path"),
            "language": paths.language("path"),
            "content_hash": text.content_hash("content"),
            "size_bytes": F.octet_length("content"),
        }
    )
    described = document_facts(typed)
    for name, value in repository.items():
        described = described.withColumn(name, F.lit(value))
    return described


# Names that chunk metadata knows, and the fact columns they come from.
COLLECTED_TEXT = {
    "language": "language", "file_language": "file_language", "repo_name": "repo_name", "branch": "branch", "commit_sha": "commit_sha",
    "module_path": "module_path", "package_path": "package_path", "package_name": "package_name", "service_name": "owner",
    "timestamp_start": "timestamp_first", "timestamp_end": "timestamp_last",
}
COLLECTED_LISTS = (
    "symbol_names", "function_names", "class_names", "headings", "endpoint_candidates", "api_paths", "log_levels", "error_codes",
    "trace_ids", "request_ids", "config_keys_summary", "release_markers",
)


def collected_documents(files: DataFrame, defaults: Defaults = DEFAULTS, **repository: str) -> DataFrame:
    """Collected files in the schema that ingest reads, facts as document metadata.

    ``files`` carries ``path, content, skip_reason`` and what identifies the
    source. Single facts go to ``metadata``, lists to ``metadata_lists``; both
    reach every chunk of the document.
    """
    from caseloom.operators.sections import list_map, text_map

    described = collect(files, defaults, **repository)
    have = set(described.columns)
    single = {name: F.col(column).cast("string") for name, column in COLLECTED_TEXT.items() if column in have}
    return described.select(
        *(F.col(c) for c in files.columns if c not in ("content", "skip_reason", "path", *COLLECTED_TEXT, *COLLECTED_LISTS)),
        F.col("path").alias("external_id"), "path", "source_type", "content", "content_hash", F.col("size_bytes").cast("bigint").alias("size_bytes"),
        text_map(**single).alias("metadata"), list_map(**{n: F.col(n) for n in COLLECTED_LISTS}).alias("metadata_lists"),
    )
