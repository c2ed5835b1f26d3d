"""The queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseloom.llm import (
    compression_quality, fill_middle, lanczos_whitening, line_blocks, poisson_mixing, simhash_tiles, suffix_dedup, surrogates, toxicity,
    training_suffixes, transport_stream, url_reputation, vertical_join,
)
from caseloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Callable], Callable]:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_host_reputation", url_reputation.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_reputation.judge(pages, url_reputation.page_outcomes(pages, table(spark, sf_dir, "labels")))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_transport_stream")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.media_features(table(spark, sf_dir, "documents"))


@query("op5_compression_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_poisson_mixing", poisson_mixing.ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mixing.mix(table(spark, sf_dir, "documents"))


@query("op7_line_blocks")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.main_text(table(spark, sf_dir, "pages"))


@query("op9_surrogates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.report(table(spark, sf_dir, "documents"))


@query("op10_training_suffixes")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_suffixes.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_vertical_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertical_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


@query("op11_lanczos_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanczos_whitening.whitened(table(spark, sf_dir, "embeddings"))


@query("op12_fill_middle", fill_middle.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


@query("op13_simhash_tiles")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_tiles.near_duplicates(table(spark, sf_dir, "documents"))
