"""Ingest plans: one batch, one micro-batch, one folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.defaults import DEFAULTS, Defaults
from caseloom.functions.text import failure_code
from caseloom.operators import store, validate
from caseloom.operators.matching import spread
from caseloom.operators.relations import derive_relations
from caseloom.session import cut_lineage


@dataclass(frozen=True)
class IngestResult:
    """Tables a batch adds to, and the rows it turned away."""

    documents: DataFrame
    chunks: DataFrame
    relations: DataFrame
    statuses: DataFrame
    quarantine: DataFrame


def split_malformed(incoming: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows that could be read, and quarantine rows for lines that could not.

    Of such a line the quarantine gets what was readable of its key, and the
    public code, never the line itself.
    """
    if schemas.MALFORMED not in incoming.columns:
        return incoming, None
    broken = F.col(schemas.MALFORMED).isNotNull()
    rows = incoming.where(broken).select(*store.KEY, "batch_id", "path", F.lit("malformed_content").alias("failure_code"))
    return incoming.where(~broken).drop(schemas.MALFORMED), rows


def ingest_documents(incoming: DataFrame, current: DataFrame, defaults: Defaults = DEFAULTS) -> IngestResult:
    """Validate, de-duplicate, compare and chunk one batch of documents.

    ``incoming`` follows the normalised document schema; ``current`` is the
    document table. One document's failure never touches another: it ends up
    in the quarantine with its public code.
    """
    incoming, broken = split_malformed(incoming)
    tagged = validate.validate_documents(incoming, defaults)
    valid = tagged.where(F.col("error").isNull())
    marked = validate.mark_duplicates(
        valid, ["project_id", "source_id", "batch_id", "external_id"], "position"
    )
    unique = marked.where(~F.col("is_duplicate")).drop("is_duplicate")
    compared = store.change_status(unique, current)
    changed = spread(compared.where(F.col("status") != "unchanged"), incoming.count())
    # Four tables read the chunker's rows; they are made once and kept.
    rows = cut_lineage(store.final_chunks(changed, defaults))
    chunks = rows.where(F.col("failure_code").isNull())
    per_document = rows.groupBy(*store.KEY).agg(
        F.max("failure_code").alias("chunk_failure"),
        F.count("chunk_id").alias("chunks"),
    )
    statuses = (
        compared.select(*store.KEY, "batch_id", "path", "source_type", "status")
        .join(per_document, store.KEY, "left")
        .withColumn("status", F.when(F.col("chunk_failure").isNotNull(), "invalid").otherwise(F.col("status")))
        .withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    )
    rejected = (
        tagged.where(F.col("error").isNotNull())
        .select(*store.KEY, "batch_id", "path", F.col("failure_code"))
        .unionByName(
            marked.where("is_duplicate").select(
                *store.KEY, "batch_id", "path",
                failure_code(F.lit("duplicate_external_id")).alias("failure_code"),
            )
        )
        .unionByName(
            statuses.where("status = 'invalid'").select(
                *store.KEY, "batch_id", "path", F.col("chunk_failure").alias("failure_code")
            )
        )
    )
    if broken is not None:
        rejected = rejected.unionByName(broken)
    good = statuses.where(F.col("status").isin("created", "updated")).select(*store.KEY)
    documents = store.document_rows(changed.join(good, store.KEY, "left_semi"))
    return IngestResult(documents, chunks, derive_relations(chunks), statuses, rejected)


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state folder, or an empty table where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ingest_batch(batch: DataFrame, root: str, batch_id: int, defaults: Defaults = DEFAULTS) -> None:
    """Apply one micro-batch to the tables under ``root``.

    Every batch writes its own folders; the newest row of a document wins when
    the tables are read back (``current_documents``). The chunk table is
    written first and read from disk afterwards, so the chunkers run once.
    """
    spark = batch.sparkSession
    current = current_documents(spark, root, before=batch_id)
    result = ingest_documents(batch, current, defaults)
    folder = lambda name: f"{root.rstrip('/')}/{name}/batch={batch_id}"
    result.chunks.write.mode("overwrite").parquet(folder("chunks"))
    result.documents.write.mode("overwrite").parquet(folder("documents"))
    result.quarantine.write.mode("overwrite").parquet(folder("quarantine"))
    written = spark.read.schema(schemas.CHUNKS).parquet(folder("chunks"))
    derive_relations(written).write.mode("overwrite").parquet(folder("relations"))


def current_documents(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Newest row of every document over the batches written so far."""
    rows = read_state(spark, f"{root.rstrip('/')}/documents", schemas.DOCUMENTS + ", batch int")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return store.latest_by(rows, store.KEY, "batch", "content_hash")


def current_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of the newest batch of every document."""
    documents = current_documents(spark, root).select(*store.KEY, "batch")
    rows = read_state(spark, f"{root.rstrip('/')}/chunks", schemas.CHUNKS + ", batch int")
    return rows.join(documents, [*store.KEY, "batch"], "left_semi").drop("batch")


def ingest_folder(spark: SparkSession, root: str, project_id: str, source_id: str, current: DataFrame,
                  defaults: Defaults = DEFAULTS) -> tuple[IngestResult, DataFrame]:
    """Ingest the files of a folder and give one ledger row for the run."""
    from caseloom.sources.files import read_documents

    read = read_documents(spark, root, defaults).withColumns(
        {
            "project_id": F.lit(project_id), "source_id": F.lit(source_id),
            "sync_id": F.lit(None).cast("string"), "batch_id": F.lit("folder"),
            "position": F.xxhash64("path"),
        }
    )
    result = ingest_documents(read.where(F.col("skip_reason").isNull()).drop("skip_reason"), current, defaults)
    counted = store.batch_counters(result.statuses, ["project_id", "source_id"])
    skipped = read.groupBy("project_id", "source_id").agg(
        F.count("*").alias("files_seen"), F.count("skip_reason").alias("files_skipped")
    )
    errors = result.quarantine.groupBy("project_id", "source_id").agg(F.count("*").alias("parser_errors"))
    ledger = (
        skipped.join(counted, ["project_id", "source_id"], "left")
        .join(errors, ["project_id", "source_id"], "left")
        .fillna(0)
        .withColumn("status", F.lit("success"))
    )
    return result, ledger
