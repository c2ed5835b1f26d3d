"""The retrieval corpus over the given tables, as a chunk table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators.chunkers import window_texts
from caseloom.operators.embedding import embed_column
from caseloom.operators.lexical import lexical_index, read_index, write_index
from caseloom.operators.relations import derive_relations
from caseloom.operators.sections import list_map, text_map
from caseloom.operators.vector import read_points, vector_points, write_points
from caseloom.session import checkpoint_root

COLUMNS = (
    "chunk_id", "document_id", "project_id", "source_id", "path", "chunk_type", "service_name",
    "endpoint", "deploy_hash", "timestamp_start", "timestamp_end", "section_title", "start_line",
    "end_line", "text", "metadata", "metadata_lists",
)

# The same rows as SQL, for the checks: the short chunks and the prose windows.
CHUNKS_SQL = """
SELECT chunk_id, document_id, project_id, source_id, path, chunk_type, source_type, service AS service_name, endpoint, deploy_hash,
  ts_start AS timestamp_start, ts_end AS timestamp_end, section_title, start_line, end_line, text, symbol, language, kind, levels FROM v_facts
UNION ALL
SELECT 'd' || doc_id || '-' || (i - 1), 'doc' || doc_id, project_id, source_id, path, chunk_type, source_type, service, NULL, NULL,
  NULL, NULL, NULL, CAST(i AS INTEGER), CAST(i AS INTEGER), ws[i], '', language, '', ''
FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT *, {windows} AS ws FROM v_prose))
"""


def with_maps(facts: DataFrame) -> DataFrame:
    """Typed metadata maps from the scalar columns of the view."""
    return facts.withColumns(
        {
            "metadata": text_map(
                source_type=F.col("source_type"), document_path=F.col("path"), language=F.col("language"),
                symbol=F.col("symbol"), symbol_name=F.col("symbol"), kind=F.col("kind"),
            ),
            "metadata_lists": list_map(log_levels=F.array_remove(F.split("levels", ","), "")),
        }
    )


#: The given tables that the views under the corpus read.
SOURCES = ("documents", "events", "orders", "customer", "supplier", "part", "conversations")
#: Tables that are built on the chunks.
PARTS = ("vectors", "edges", "index")
#: Rows of a file of the chunk table. Short texts compress so well that few large files would leave few tasks with most rows.
FILE_ROWS = 50_000
_BUILT: dict[tuple, str] = {}


def state_of(load) -> tuple:
    """A number per source table that changes with any of its files.

    Names, sizes and change times are combined in Spark; no listing reaches the
    driver, and no data is read.
    """
    file = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    return tuple(
        load(name).select(file.alias("file")).distinct().agg(F.bit_xor("file")).first()[0] for name in SOURCES
    )


def index_tables(load, *parts: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The chunk table, and those of its vectors, edges and lexical index that ``parts`` names; all without any.

    A maintained corpus has these as tables that ingest writes. Here they are
    derived from the given tables and written once per application and state of
    these tables to the checkpoint folder, each when a query first asks for it.
    """
    parts = parts or PARTS
    spark = load("documents").sparkSession
    key = (spark.sparkContext.applicationId, *state_of(load))

    def stored(name: str, write: Callable[[str], None]) -> str:
        if (*key, name) not in _BUILT:
            path = f"{checkpoint_root(spark)}/corpus-{uuid.uuid4().hex}/{name}"
            write(path)
            _BUILT[*key, name] = path
        return _BUILT[*key, name]

    corpus = spark.read.parquet(stored("chunks", chunks(load).write.option("maxRecordsPerFile", FILE_ROWS).parquet))
    tables = {}
    if "vectors" in parts:
        points = vector_points(corpus.withColumn("vector", embed_column("text")))
        tables["vectors"] = read_points(spark, stored("vectors", lambda path: write_points(points, path)))
    if "edges" in parts:
        tables["edges"] = spark.read.parquet(stored("edges", derive_relations(corpus).write.parquet))
    if "index" in parts:
        tables["index"] = read_index(spark, stored("index", lambda path: write_index(lexical_index(corpus), path)))
    return corpus, tables


def chunk_table(load) -> DataFrame:
    """The chunk table alone."""
    return index_tables(load, "chunks")[0]


def chunks(load) -> DataFrame:
    """All chunks: prose cut into word windows, and the short fact chunks."""
    short = load("v_facts").withColumnsRenamed(
        {"service": "service_name", "ts_start": "timestamp_start", "ts_end": "timestamp_end"}
    )
    prose = load("v_prose").select(
        "*", F.posexplode(window_texts("content")).alias("i", "text")
    )
    none = lambda kind: F.lit(None).cast(kind)
    prose = prose.select(
        F.concat(F.lit("d"), "doc_id", F.lit("-"), "i").alias("chunk_id"),
        F.concat(F.lit("doc"), "doc_id").alias("document_id"), "project_id", "source_id", "path",
        "chunk_type", "source_type", F.col("service").alias("service_name"),
        none("string").alias("endpoint"), none("string").alias("deploy_hash"),
        none("timestamp").alias("timestamp_start"), none("timestamp").alias("timestamp_end"),
        none("string").alias("section_title"), (F.col("i") + 1).alias("start_line"),
        (F.col("i") + 1).alias("end_line"), "text", F.lit("").alias("symbol"), "language",
        F.lit("").alias("kind"), F.lit("").alias("levels"),
    )
    return with_maps(short.unionByName(prose)).select(*COLUMNS)
