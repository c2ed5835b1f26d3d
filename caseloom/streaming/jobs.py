"""Streams: document ingest with a quarantine, job states, limits, log errors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from caseloom.defaults import DEFAULTS, Defaults
from caseloom.sources.documents import parsed_lines


def document_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Documents as files arrive; lines that cannot be parsed come as ``malformed``."""
    return parsed_lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def ingest_stream(docs: DataFrame, root: str, checkpoint: str, defaults: Defaults = DEFAULTS) -> DataStreamWriter:
    """Ingest every micro-batch into versioned tables under ``root``.

    Each batch writes folders that carry its batch id in overwrite mode, so a
    batch that is replayed after a failure writes the same rows once. Invalid
    documents go to the quarantine with a public code and without content.
    """
    from caseloom.plans.ingest import ingest_batch

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, root, batch_id, defaults)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def job_states(deliveries: DataFrame, defaults: Defaults = DEFAULTS) -> DataFrame:
    """State of every job after each micro-batch of its deliveries.

    The state is a status, an attempt count and an error code. Deliveries of
    one batch are applied in time order.
    """
    limit = defaults.index_max_retries

    def update(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, attempts, error = state.get if state.exists else ("pending", 0, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        for outcome, code, current in zip(rows["outcome"], rows["code"], rows["current_version"]):
            if status in ("completed", "stale", "running"):
                continue
            if attempts >= limit:
                status, error = "failed", error or "retry_limit_exceeded"
            elif not current:
                status, error = "stale", "index_version_changed"
            else:
                attempts += 1
                if outcome == "completed":
                    status, error = "completed", None
                elif outcome == "failed":
                    status, error = "failed", code
                else:
                    status, error = ("pending" if attempts < limit else "failed"), code
        state.update((status, attempts, error))
        yield pd.DataFrame(
            {"job_id": [key[0]], "status": [status], "attempts": [attempts], "error_code": [error]}
        )

    return deliveries.groupBy("job_id").applyInPandasWithState(
        update, "job_id string, status string, attempts int, error_code string",
        "status string, attempts int, error_code string", "update", "NoTimeout",
    )


def request_limits(events: DataFrame, key: str, ts: str, seconds: int, limit: int,
                   slide: int = 1, late: str = "1 minute") -> DataFrame:
    """Sliding windows in which a key exceeds its request limit."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, f"{seconds} seconds", f"{slide} seconds"), key)
        .agg(F.count("*").alias("requests"))
        .where(F.col("requests") > limit)
        .select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "requests")
    )


def error_bursts(lines: DataFrame, gap: str = "1 minute", late: str = "10 minutes",
                 defaults: Defaults = DEFAULTS) -> DataFrame:
    """Error sessions per service on live log lines; late lines are dropped.

    ``lines`` carries ``ts, service, line``.
    """
    from caseloom.operators.chunkers import is_error_line

    return (
        lines.where(is_error_line(F.col("line")))
        .withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "service")
        .agg(F.count("*").alias("error_lines"))
        .where(F.col("error_lines") >= defaults.burst_min_errors)
        .select(
            "service", F.col("session_window.start").alias("start"),
            F.col("session_window.end").alias("end"), "error_lines",
        )
    )


def error_rates(lines: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Share of error lines per service and tumbling window."""
    from caseloom.operators.chunkers import is_error_line

    return (
        lines.withColumn("bad", is_error_line(F.col("line")))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width), "service")
        .agg(F.count("*").alias("lines"), F.count_if("bad").alias("error_lines"))
        .select(
            "service", F.col("window.start").alias("start"), "lines", "error_lines",
            (F.col("error_lines") / F.col("lines")).alias("error_rate"),
        )
    )
