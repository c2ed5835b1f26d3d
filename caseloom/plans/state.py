"""Versioned state: a manifest names the folders that are live, for all tables at once.

Batches, purges and compactions write folders of their own, which nobody reads
yet. One small manifest, written last, then names for every table the folders
that are live from now on: the state moves from one version to the next for all
tables together, or not at all. A job that fails half way leaves folders that no
manifest names; its repetition writes them again. One writer at a time is
assumed; a second one fails on the manifest it finds and changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.defaults import DEFAULTS, Defaults
from caseloom.operators import store
from caseloom.operators.relations import derive_relations
from caseloom.plans.ingest import ingest_documents, read_state

TABLES = {"documents": schemas.DOCUMENTS, "chunks": schemas.CHUNKS, "relations": schemas.RELATIONS, "quarantine": schemas.QUARANTINE}
MANIFEST = "version bigint, batch string, name string, folder string, written bigint"


@dataclass(frozen=True)
class Snapshot:
    """One version of the state: the live folders of each table, oldest first, with the version that wrote each."""

    root: str
    version: int
    batches: frozenset[str]
    folders: dict[str, list[tuple[str, int]]]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """All rows of a table's live folders, with ``version`` of the folder they stand in."""
        parts = [
            spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/{folder}").withColumn("version", F.lit(written).cast("bigint"))
            for folder, written in self.folders.get(name, [])
        ]
        out = spark.createDataFrame([], TABLES[name] + ", version bigint")
        for part in parts:
            out = out.unionByName(part)
        return out


def snapshot(spark: SparkSession, root: str) -> Snapshot:
    """The newest version. A manifest has a row per live folder; compaction keeps these few."""
    root = root.rstrip("/")
    rows = read_state(spark, f"{root}/manifest", MANIFEST)
    newest = rows.agg(F.max("version")).first()[0]
    live = rows.where(F.col("version") == newest).orderBy("written", "folder").collect() if newest is not None else []
    folders: dict[str, list[tuple[str, int]]] = {}
    for r in live:
        if r.name is not None:
            folders.setdefault(r.name, []).append((r.folder, r.written))
    # Every manifest names the batch it came from, if any.
    batches = frozenset(r.batch for r in rows.where("batch is not null").select("batch").distinct().collect())
    return Snapshot(root, newest or 0, batches, folders)


def _commit(spark: SparkSession, old: Snapshot, folders: dict[str, list[tuple[str, int]]], batch: str | None) -> None:
    version = old.version + 1
    rows = [(version, batch, name, folder, written) for name, own in folders.items() for folder, written in own]
    rows = rows or [(version, batch, None, None, None)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{old.root}/manifest/commit={version}")


def current_documents(spark: SparkSession, state: Snapshot) -> DataFrame:
    """Newest row of every document of one version, with the version that wrote it."""
    return store.latest_by(state.read(spark, "documents"), store.KEY, "version", "content_hash")


def current_chunks(spark: SparkSession, state: Snapshot) -> DataFrame:
    """Chunks of the newest row of every document of the same version."""
    documents = current_documents(spark, state).select(*store.KEY, "version")
    return state.read(spark, "chunks").join(documents, [*store.KEY, "version"], "left_semi")


def apply_batch(batch: DataFrame, root: str, batch_id: str, defaults: Defaults = DEFAULTS) -> None:
    """Add one batch to all tables in one step. A batch that some version holds already is not applied again."""
    spark = batch.sparkSession
    old = snapshot(spark, root)
    if batch_id in old.batches:
        return
    result = ingest_documents(batch, current_documents(spark, old), defaults)
    version, folder = old.version + 1, f"v{old.version + 1}-batch"
    path = lambda name: f"{old.root}/{name}/{folder}"
    result.chunks.write.mode("overwrite").parquet(path("chunks"))
    result.documents.write.mode("overwrite").parquet(path("documents"))
    result.quarantine.write.mode("overwrite").parquet(path("quarantine"))
    derive_relations(spark.read.schema(schemas.CHUNKS).parquet(path("chunks"))).write.mode("overwrite").parquet(path("relations"))
    _commit(spark, old, {n: [*old.folders.get(n, []), (folder, version)] for n in TABLES}, batch_id)


def purge_source(spark: SparkSession, root: str, project_id: str, source_id: str) -> dict[str, int]:
    """Delete a source from all tables in one step; what went, by table.

    Only folders that hold rows of the source are written anew; others stay as
    they are. Relations belong to the chunks they were found in.
    """
    old = snapshot(spark, root)
    gone = (F.col("project_id") == project_id) & (F.col("source_id") == source_id)
    folders: dict[str, list[tuple[str, int]]] = {}
    counts = dict.fromkeys(TABLES, 0)
    doomed = old.read(spark, "chunks").where(gone).select("project_id", F.col("chunk_id").alias("evidence_chunk_id")).distinct()
    for name in TABLES:
        folders[name] = []
        for k, (folder, written) in enumerate(old.folders.get(name, [])):
            rows = spark.read.schema(TABLES[name]).parquet(f"{old.root}/{name}/{folder}")
            if name == "relations":
                kept = rows.join(doomed, ["project_id", "evidence_chunk_id"], "left_anti")
                lost = rows.join(doomed, ["project_id", "evidence_chunk_id"], "left_semi").count()
            else:
                kept = rows.where(~F.coalesce(gone, F.lit(False)))
                lost = rows.where(gone).count()
            counts[name] += lost
            if lost:
                target = f"v{old.version + 1}-purge-{k}"
                kept.write.mode("overwrite").parquet(f"{old.root}/{name}/{target}")
                folder = target
            folders[name].append((folder, written))
    _commit(spark, old, folders, None)
    return counts


def compact(spark: SparkSession, root: str) -> None:
    """One folder per table with the current rows only, in place of all batches before."""
    old = snapshot(spark, root)
    version, folder = old.version + 1, f"v{old.version + 1}-compact"
    path = lambda name: f"{old.root}/{name}/{folder}"
    current_documents(spark, old).drop("version").write.mode("overwrite").parquet(path("documents"))
    current_chunks(spark, old).drop("version").write.mode("overwrite").parquet(path("chunks"))
    derive_relations(spark.read.schema(schemas.CHUNKS).parquet(path("chunks"))).write.mode("overwrite").parquet(path("relations"))
    old.read(spark, "quarantine").drop("version").write.mode("overwrite").parquet(path("quarantine"))
    _commit(spark, old, {n: [(folder, version)] for n in TABLES}, None)
