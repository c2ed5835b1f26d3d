"""Equality filters that questions set, and what they test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filter column of a question, and the column of a chunk that it must equal.
FILTERS = {
    "filter_service_name": "service_name",
    "filter_deploy_hash": "deploy_hash",
    "filter_chunk_type": "chunk_type",
    "filter_endpoint": "endpoint",
}
#: What stored points and postings carry, so that a filter needs no join with chunks.
PAYLOAD = tuple(FILTERS.values())


def active_filters(questions: DataFrame) -> list[str]:
    return [q for q in FILTERS if q in questions.columns]


def set_filter(name: str) -> Column:
    """The value of a filter; null where it is not set. An empty value sets none."""
    return F.nullif(F.col(name), F.lit(""))


def passes(active: list[str]) -> Column:
    """Whether a row of question and chunk columns meets every filter that the question sets."""
    tests = [set_filter(q).isNull() | F.coalesce(F.col(FILTERS[q]) == F.col(q), F.lit(False)) for q in active]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def sent(frame: DataFrame, most: int) -> DataFrame:
    """A table of ids, broadcast while it has at most ``most`` rows. It is read twice, so it should be stored."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame
