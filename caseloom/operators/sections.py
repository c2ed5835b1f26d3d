"""Cutting one document into sections without leaving its row.

Documents are bounded at two megabytes by validation, so boundaries are found
and sections assembled with array functions inside the row that holds the
text. Nothing is shuffled: chunking scales with the number of scan tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions.patterns import let

STRING_MAP = "map<string,string>"
LIST_MAP = "map<string,array<string>>"

CHUNK_FIELDS = {
    "chunk_type": "string",
    "source_type": "string",
    "doc_type": "string",
    "service_name": "string",
    "endpoint": "string",
    "deploy_hash": "string",
    "timestamp_start": "timestamp",
    "timestamp_end": "timestamp",
    "section_title": "string",
    "start_line": "int",
    "end_line": "int",
    "text": "string",
    "metadata": STRING_MAP,
    "metadata_lists": LIST_MAP,
}


def chunk(**fields: Column) -> Column:
    """A chunk struct; fields left out are NULL, maps left out are empty."""
    cells = []
    for name, kind in CHUNK_FIELDS.items():
        value = fields.get(name)
        if value is None:
            value = F.expr("map()") if kind.startswith("map") else F.lit(None)
        cells.append(value.cast(kind).alias(name))
    return F.struct(*cells)


def text_map(**entries: Column | str | None) -> Column:
    """String map of the entries that are present and not empty."""
    if not entries:
        return F.expr("cast(map() as map<string,string>)")
    pairs = []
    for key, value in entries.items():
        cell = value if isinstance(value, Column) else F.lit(value)
        pairs.append(F.struct(F.lit(key).alias("key"), cell.cast("string").alias("value")))
    kept = F.filter(F.array(*pairs), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.map_from_entries(kept)


def list_map(**entries: Column) -> Column:
    """Map of the non-empty string lists."""
    if not entries:
        return F.expr("cast(map() as map<string,array<string>>)")
    pairs = [
        F.struct(F.lit(k).alias("key"), v.cast("array<string>").alias("value"))
        for k, v in entries.items()
    ]
    return F.map_from_entries(
        F.filter(F.array(*pairs), lambda e: F.coalesce(F.size(e["value"]), F.lit(0)) > 0)
    )


def span(lines: Column, start: Column, end: Column) -> Column:
    """Text of the lines ``start``..``end``, counted from one."""
    return F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n")


def line_numbers(lines: Column, is_start: Callable[[Column], Column]) -> Column:
    """Numbers, from one, of the lines that satisfy a test."""
    return F.array_compact(F.transform(lines, lambda line, i: F.when(is_start(line), i + 1)))


def ranges(starts: Column, last: Column) -> Column:
    """Ranges from each start to the line before the next one."""
    return let(
        starts,
        lambda at: F.transform(
            at,
            lambda s, i: F.struct(
                s.alias("start"), F.coalesce(F.get(at, i + 1) - 1, last).alias("end")
            ),
        ),
    )


def with_leading(starts: Column) -> Column:
    """Add line one so that text before the first boundary is kept."""
    return F.array_distinct(F.concat(F.array(F.lit(1)), starts))
