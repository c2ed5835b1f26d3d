"""State tables: change detection, replacement, purge, reindex, registration.

Plain Parquet has no row-level writes, so an operator returns the next state
of a table; ``publish`` writes it as a new version beside the old one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.defaults import DEFAULTS, Defaults
from caseloom.functions import paths, text
from caseloom.functions.patterns import first_of
from caseloom.operators import chunkers
from caseloom.operators.sections import LIST_MAP, STRING_MAP

KEY = ["project_id", "source_id", "external_id"]


def document_id() -> Column:
    """Stable id of a document: hash of its natural key."""
    return F.sha2(F.concat_ws("\x1f", *KEY), 256)


def change_status(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """Tag incoming documents as created, updated or unchanged."""
    known = current.select(*KEY, F.col("content_hash").alias("_known"))
    return (
        incoming.join(known, KEY, "left")
        .withColumn(
            "status",
            first_of(
                [
                    (F.col("_known").isNull(), "created"),
                    (F.col("_known") == F.col("content_hash"), "unchanged"),
                ],
                "updated",
            ),
        )
        .drop("_known")
    )


def document_rows(changed: DataFrame) -> DataFrame:
    """Document table rows for created and updated documents."""
    return changed.select(
        *KEY, document_id().alias("document_id"), paths.file_name("path").alias("title"), "path",
        paths.doc_type("path").alias("doc_type"), "source_type", "content_hash",
        F.col("content_hash").alias("checksum"), "modified_at", "size_bytes",
    )


def merge_metadata(base: Column, document: Column, chunk: Column) -> Column:
    """Later maps win; empty values never replace anything."""
    keep = lambda m: F.map_filter(m, lambda k, v: F.coalesce(v, F.lit("")) != "")
    return F.map_concat(base, keep(document), keep(chunk))


def merge_lists(document: Column, chunk: Column) -> Column:
    """List facts of the document that chunks may carry, and the chunk's own, which win."""
    empty = F.expr(f"cast(map() as {LIST_MAP})")
    allowed = F.map_filter(F.coalesce(document, empty), lambda k, v: k.isin(*_WHITELIST) & (F.size(v) > 0))
    return F.map_concat(allowed, F.map_filter(F.coalesce(chunk, empty), lambda k, v: F.coalesce(F.size(v), F.lit(0)) > 0))


def final_chunks(docs: DataFrame, defaults: Defaults = DEFAULTS) -> DataFrame:
    """Chunk rows of changed documents, split, completed and guarded.

    Everything happens in the row of the document: dispatch to its chunker,
    the guard on very many segments, token splitting and the chunk limit. A
    document over the limit yields one row with ``failure_code`` and no text.
    """
    meta = lambda k: F.nullif(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    prepared = docs.withColumns(
        {
            "document_id": document_id(),
            "service_name": F.coalesce(meta("service_name"), paths.service_from_path("path")),
            "parser": chunkers.parser_name("path", "source_type"),
        }
    ).withColumn("raw", chunkers.dispatched())
    segments = F.aggregate(
        F.transform("raw", lambda c: chunkers.estimated_segments(c["text"], defaults)),
        F.lit(0), lambda a, n: a + n,
    )
    guarded = prepared.withColumn(
        "raw",
        F.when(segments > defaults.max_chunks_per_document, chunkers.bounded_fallback(defaults)).otherwise(
            F.col("raw")
        ),
    )
    pieces = F.flatten(
        F.transform(
            "raw",
            lambda c, i: F.transform(
                chunkers.window_texts(c["text"], defaults),
                lambda t, j: F.struct(c.dropFields("text").alias("c"), t.alias("text")),
            ),
        )
    )
    cut = guarded.withColumn("pieces", pieces)
    failure = first_of(
        [
            ((F.col("parser") == "deploy_history") & (F.size("raw") == 0), "parser_exception"),
            (F.coalesce(F.size("raw"), F.lit(0)) <= 0, "empty"),
            (F.size("pieces") > defaults.max_chunks_per_document, "chunk_limit_exceeded"),
        ]
    )
    marked = cut.withColumn("failure_code", failure)
    one = F.when(F.col("failure_code").isNull(), F.col("pieces"))
    listed = F.col("metadata_lists") if "metadata_lists" in docs.columns else F.lit(None).cast(LIST_MAP)
    # A piece carries what its chunk says; the document's text stays behind.
    rows = marked.select(
        *KEY, "document_id", "path", "content_hash", "metadata", listed.alias("document_lists"), "failure_code", "service_name",
        F.posexplode_outer(one).alias("chunk_no", "piece"),
    ).withColumn("c", F.col("piece.c"))
    base = F.create_map(
        F.lit("source_type"), F.coalesce("c.source_type", F.lit("unknown_text")),
        F.lit("document_path"), F.col("path"), F.lit("content_hash"), F.col("content_hash"),
    )
    whitelisted = F.map_filter(
        "metadata", lambda k, v: k.isin(*_WHITELIST)
    )
    empty = F.expr(f"cast(map() as {STRING_MAP})")
    return rows.select(
        *KEY, "document_id",
        F.when(
            F.col("piece").isNotNull(),
            F.concat_ws("-", F.substring("document_id", 1, 24), F.col("chunk_no").cast("string")),
        ).alias("chunk_id"),
        "path", "failure_code",
        F.col("c.chunk_type").alias("chunk_type"), F.col("c.doc_type").alias("doc_type"),
        F.coalesce("c.service_name", "service_name").alias("service_name"),
        F.coalesce("c.endpoint", meta("endpoint")).alias("endpoint"),
        F.coalesce("c.deploy_hash", meta("deploy_hash"), meta("commit_sha")).alias("deploy_hash"),
        *[F.col(f"c.{n}").alias(n) for n in (
            "timestamp_start", "timestamp_end", "section_title", "start_line", "end_line",
        )],
        F.col("piece.text").alias("text"),
        text.token_count("piece.text").alias("token_count"),
        merge_metadata(base, F.coalesce(whitelisted, empty), F.coalesce("c.metadata", empty)).alias("metadata"),
        merge_lists(F.col("document_lists"), F.col("c.metadata_lists")).alias("metadata_lists"),
    )


def _whitelist() -> tuple[str, ...]:
    from caseloom import vocab

    return vocab.CHUNK_METADATA_KEYS


_WHITELIST = _whitelist()


def replace_rows(current: DataFrame, touched: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Next state of a table: rows of touched keys give way to the fresh ones.

    Only the touched keys move; where they are few, Spark broadcasts them and
    the current table is not shuffled at all.
    """
    kept = current.join(touched.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def batch_counters(statuses: DataFrame, keys: list[str]) -> DataFrame:
    """Batch result counters from status-tagged documents with chunk counts."""
    n = lambda s: F.count_if(F.col("status") == s)
    return statuses.groupBy(*keys).agg(
        F.count("*").alias("received"), n("created").alias("created"), n("updated").alias("updated"),
        n("unchanged").alias("skipped_unchanged"), n("invalid").alias("skipped_invalid"),
        F.sum("chunks").alias("chunks_created"),
    )


def merge_counters(batches: DataFrame, keys: list[str], counter: str = "name", value: str = "n") -> DataFrame:
    """Counters of many batches added up per key, in long form."""
    return batches.groupBy(*keys, counter).agg(F.sum(value).alias(value))


def purge(tables: dict[str, DataFrame], doomed: DataFrame, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Counts that go and tables that stay when the doomed keys are deleted."""
    ids = doomed.select(key).distinct()
    counts = [
        table.join(ids, key, "left_semi")
        .groupBy(key)
        .agg(F.count("*").alias("n"))
        .withColumn("table", F.lit(name))
        for name, table in tables.items()
    ]
    remaining = {n: t.join(ids, key, "left_anti") for n, t in tables.items()}
    return reduce(DataFrame.unionByName, counts), remaining


def latest_by(rows: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Latest row per key, as an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_row")
    )
    return picked.select(*keys, "_row.*")


def register_collectors(current: DataFrame, requests: DataFrame) -> DataFrame:
    """Upsert collectors by project, name and environment: the latest request wins."""
    both = current.withColumn("_new", F.lit(0)).unionByName(requests.withColumn("_new", F.lit(1)))
    latest = latest_by(both, ["project_id", "name", "environment"], "last_seen_at", "_new")
    return latest.drop("_new")


def integrity(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Groups and rows of repeated chunks per key, without their text."""
    groups = chunks.groupBy(
        *keys, "document_id", "chunk_type", "start_line", "end_line", F.md5("text").alias("digest")
    ).agg(F.count("*").alias("n"))
    repeated = F.col("n") > 1
    return groups.groupBy(*keys).agg(
        F.sum("n").alias("chunk_count"),
        F.count_if(repeated).alias("duplicate_groups"),
        F.sum(F.when(repeated, F.col("n")).otherwise(0)).alias("duplicate_rows"),
    )


def publish(table: DataFrame, root: str, version: int, partition_by: list[str] | None = None) -> str:
    """Write a state version and return its path; readers move to it afterwards."""
    target = f"{root.rstrip('/')}/version={version}"
    writer = table.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    return target


def merge_into(spark: SparkSession, target: str, updates: DataFrame, keys: list[str]) -> None:
    """Upsert through a catalog table whose format has row-level operations."""
    t, u = F.col, lambda c: F.col(f"updates.{c}")
    condition = reduce(lambda a, b: a & b, [t(f"{target}.{k}") == u(k) for k in keys])
    updates.alias("updates").mergeInto(target, condition).whenMatched().updateAll().whenNotMatched().insertAll().merge()


def log_retrieval(ranked: DataFrame, run_id: Column) -> DataFrame:
    """Ranked result rows of retrieval runs with all their scores."""
    return ranked.select(
        run_id.alias("retrieval_run_id"), "chunk_id", "vector_score", "lexical_score", "fused_score",
        "rerank_score", F.col("final_rank").alias("rank"),
    )


def operational_events(events: DataFrame) -> DataFrame:
    """Events as stored: clean labels, clamped severity, sanitised payload."""
    return events.withColumns(
        {
            "category": text.clean_label("category", 64),
            "event_type": text.clean_label("event_type", 96),
            "severity": text.clamp_severity("severity"),
            "payload": text.sanitize_payload("payload"),
        }
    )


def audit_events(events: DataFrame) -> DataFrame:
    return events.withColumn("metadata", text.sanitize_audit("metadata"))
