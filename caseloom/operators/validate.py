"""Admission of documents, batches, syncs and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.defaults import DEFAULTS, Defaults
from caseloom.functions import paths, text
from caseloom.functions.patterns import first_of, strip


def document_error(defaults: Defaults = DEFAULTS) -> Column:
    """First failed check of a normalized document; NULL where it is valid."""
    external = F.trim(F.coalesce("external_id", F.lit("")))
    path = paths.slashed(F.trim(F.coalesce("path", F.lit(""))))
    content = F.coalesce("content", F.lit(""))
    size = F.octet_length(content)
    declared = F.coalesce(F.col("size_bytes"), size)
    meta = F.coalesce("metadata", F.expr("cast(map() as map<string,string>)"))
    long_entry = F.exists(
        F.map_entries(meta),
        lambda e: (F.length(e["key"]) > 256) | (F.octet_length(e["value"]) > 8192),
    )
    return first_of(
        [
            (external == "", "invalid_external_id"),
            (F.length(external) > defaults.max_external_id_length, "external_id_too_long"),
            (~paths.is_safe(paths.slashed(external)), "unsafe_external_id"),
            (path == "", "invalid_path"),
            (F.length(path) > defaults.max_path_length, "path_too_long"),
            (~paths.is_safe(path), "unsafe_path"),
            (strip(content) == "", "empty_content"),
            (declared < 0, "invalid_size"),
            (
                (size > defaults.max_document_bytes) | (declared > defaults.max_document_bytes),
                "document_too_large",
            ),
            (~text.valid_content_hash("content_hash"), "invalid_content_hash"),
            (
                (text.json_bytes(meta) > defaults.max_metadata_bytes) | long_entry,
                "metadata_too_large",
            ),
            (text.looks_binary(content), "binary_content"),
        ]
    )


def validate_documents(docs: DataFrame, defaults: Defaults = DEFAULTS) -> DataFrame:
    """Cleaned documents with an error and its public code; nothing is dropped."""
    tagged = docs.withColumn("error", document_error(defaults))
    path = paths.slashed(F.trim("path"))
    return tagged.withColumns(
        {
            "failure_code": F.when(F.col("error").isNotNull(), text.failure_code("error")),
            "external_id": F.trim("external_id"),
            "path": path,
            "source_type": paths.canonical_source_type("source_type", path),
            "content_hash": text.clean_content_hash("content_hash"),
        }
    )


def split_valid(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted documents and the quarantine, which never carries content."""
    accepted = tagged.where(F.col("error").isNull()).drop("error", "failure_code")
    rejected = tagged.where(F.col("error").isNotNull()).drop("content")
    return accepted, rejected


def mark_duplicates(docs: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Tag every row of a key but the first as a duplicate.

    The first position of each key is an aggregate that combines before the
    shuffle, so a key with very many copies is not gathered anywhere.
    """
    first = docs.groupBy(*keys).agg(F.min(position).alias("_first"))
    return (
        docs.join(first, keys)
        .withColumn("is_duplicate", F.col(position) > F.col("_first"))
        .drop("_first")
    )


def check_sync_references(requests: DataFrame, syncs: DataFrame, collectors: DataFrame) -> DataFrame:
    """Tag ingest requests whose sync or collector does not fit.

    ``requests`` carries ``project_id, source_id, sync_id, collector_id``.
    """
    known = syncs.select(
        "sync_id", F.col("source_id").alias("_s_source"), F.col("collector_id").alias("_s_collector")
    )
    owned = collectors.select("collector_id", F.col("project_id").alias("_c_project"))
    joined = requests.join(known, "sync_id", "left").join(owned, "collector_id", "left")
    given, bound = F.col("collector_id"), F.col("_s_collector")
    return joined.withColumn(
        "reference_error",
        first_of(
            [
                (~F.coalesce(F.col("_s_source") == F.col("source_id"), F.lit(False)), "sync_not_found_for_source"),
                (
                    given.isNotNull()
                    & ~F.coalesce(F.col("_c_project") == F.col("project_id"), F.lit(False)),
                    "collector_not_found_for_project",
                ),
                (given.isNotNull() & bound.isNotNull() & (given != bound), "collector_does_not_match_sync"),
            ]
        ),
    ).drop("_s_source", "_s_collector", "_c_project")


def payload_too_large(payload: Column | str, limit: int) -> Column:
    payload = F.col(payload) if isinstance(payload, str) else payload
    return F.octet_length(F.to_json(payload)) > limit
