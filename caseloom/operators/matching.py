"""Substring joins and skew-safe numbering shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.filters import sent
from caseloom.session import cut_lineage


#: Rows that one task takes of work that costs much for each row.
TASK_ROWS = 5_000


def spread(frame: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows dealt out evenly for work that costs much for each row.

    Scans and shuffles cut their tasks by bytes, so that small rows, of which a
    few MB hold very many, would all be worked on by one task.
    """
    tasks = -(-(frame.count() if rows is None else rows) // TASK_ROWS)
    return frame.repartition(tasks) if tasks > 1 else frame


#: Characters of a needle that it is looked up by, and how many numbers these and their first bytes are turned into.
KEY_CHARS = 32
CODES = 1 << 22
STARTS = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    up, down = (np.full(n, x, np.uint64) for x in (int(_ODD), pow(int(_ODD), -1, 1 << 64)))
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


class _Bytes:
    """The bytes of a batch of texts, where each text ends, and numbers of the pieces of them."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pa.array(texts.fill_null(""), pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        self.data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None else np.zeros(0, np.uint8)
        self.first, self.ends = (ends - ends[0])[:-1], (ends - ends[0])[1:]
        up, self.down = _powers(len(self.data) + 1)
        # The sum of a piece is a difference of two of these, so a piece of any length costs the same.
        self.sums = np.r_[np.uint64(0), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1])]

    def starts(self, width: int) -> np.ndarray:
        """A number for the first ``width`` bytes from each byte on."""
        code = np.zeros(max(len(self.data) - width + 1, 0), np.int64)
        for k in range(width):
            code = code * 331 + self.data[k : k + len(code)]
        return code % STARTS

    def codes(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """A number for the ``size`` bytes from ``at`` on."""
        mixed = (self.sums[at + size] - self.sums[at]) * self.down[at] + np.asarray(size, np.uint64)
        return ((mixed * _ODD) >> np.uint64(42)).astype(np.int64)


def _numbers(width: int) -> Callable[..., Column]:
    """(code, start, size) of each needle."""

    @F.arrow_udf("struct<code: int, start: int, size: int>")
    def run(needles: pa.Array) -> pa.Array:
        held = _Bytes(needles)
        size = held.ends - held.first
        starts = np.r_[held.starts(width), np.zeros(width, np.int64)][held.first]
        columns = (held.codes(held.first, size), starts, size)
        return pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns], ["code", "start", "size"])

    return run


def _pieces(codes: list[int], starts: list[int], sizes: list[int], width: int) -> Callable[..., Column]:
    """The pieces of each text whose numbers are those of some needle: all that equal one, and hardly any other."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        is_code, is_start = np.zeros(CODES, bool), np.zeros(STARTS, bool)
        is_code[codes], is_start[starts] = True, True
        held = _Bytes(texts)
        at = np.flatnonzero(is_start[held.starts(width)])
        row = np.searchsorted(held.ends, at, side="right")
        found_at, found_size, found_row = [], [], []
        for size in sizes:
            near = np.flatnonzero(at + size <= held.ends[row])
            near = near[is_code[held.codes(at[near], size)]]
            found_at.append(at[near])
            found_size.append(np.full(len(near), size))
            found_row.append(row[near])
        at, size, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_at, found_size, found_row))
        order = np.argsort(row, kind="stable")
        data = held.data.tobytes()
        # A piece that begins or ends inside a character is none of the needles; what is left of it is still a piece of the text.
        cut = [data[a : a + n].decode("utf-8", "ignore") for a, n in zip(at[order].tolist(), size[order].tolist(), strict=True)]
        upto = np.searchsorted(row[order], np.arange(len(texts) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(upto), pa.array(cut, pa.string()))

    return run


def contains_join(hay: DataFrame, text: str, needles: DataFrame, needle: str, on: list[str],
                  size: int) -> DataFrame:
    """Pairs where the needle occurs in the text, as an equi-join.

    A text that contains a needle contains the first ``KEY_CHARS`` characters of
    it. So each text is searched for pieces that look like these of some needle,
    many texts at a time, and only such pieces are joined with the needles by
    equality; the test that follows matters for longer needles. What the search
    holds of the needles is bounded: it tells pieces by ``CODES`` numbers, and
    pieces that share one with a needle by chance find no partner in the join.
    Needles must be at least ``size`` long; shorter ones find nothing. Unlike a
    ``LIKE`` join this never plans as a nested loop.
    """
    keyed = cut_lineage(needles.where(F.length(needle) >= size).withColumn("_piece", F.substring(needle, 1, KEY_CHARS)))
    of = keyed.select(_numbers(size)("_piece").alias("n"))
    codes, starts, sizes = of.agg(*[F.collect_set(f"n.{c}") for c in ("code", "start", "size")]).first()
    probed = hay.withColumn("_piece", F.explode(F.array_distinct(_pieces(codes, starts, sorted(sizes), size)(text))))
    return probed.join(keyed, [*on, "_piece"]).where(F.contains(F.col(text), F.col(needle))).drop("_piece")


def top_per(frame: DataFrame, keys: list[str], order: list[Column], limit: Column | int,
            rank: str = "rank", most: int | None = None) -> DataFrame:
    """First rows per key.

    A literal bound lets Spark cut every key inside the map tasks, before the
    shuffle. A bound that varies by row may come with ``most``, the largest
    that the plan can hold, known when the plan is built. A row that asks for
    more fails the job; nothing is cut in silence.
    """
    ranked = frame.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if isinstance(limit, Column):
        if most is None:
            return ranked.where(F.col(rank) <= limit)
        kept = ranked.where(F.col(rank) <= most)
        over = F.raise_error(F.concat(F.lit(f"a budget exceeds {most}: "), limit.cast("string"))).cast("boolean")
        return kept.where(F.when(limit > most, over).otherwise(F.col(rank) <= limit))
    return ranked.where(F.col(rank) <= limit)


def dense_sequence(events: DataFrame, keys: list[str], order: list[str], bucket: Column,
                   name: str = "sequence_no") -> DataFrame:
    """Number the rows of each key in order, also where one key holds most rows.

    Rows are numbered inside (key, bucket) groups, where buckets follow the
    order, and each group starts at the row count of the buckets before it.
    The offsets come from one small aggregate, so no task sees a whole key.
    """
    bucketed = events.withColumn("_bucket", bucket)
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        bucketed.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_bucket", "_local", "_offset")
    )


def sliding_count(events: DataFrame, keys: list[str], ts: str, seconds: int,
                  name: str = "in_window") -> DataFrame:
    """Events of the same key in the window that ends at each event.

    Each row also visits the next time bucket as look-back only, so that a
    window never spans more than one bucket and a busy key is spread over time.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    width = seconds * 1_000_000
    home = F.floor(at / width)
    spread = events.withColumn("_at", at).withColumn(
        "_visit",
        F.explode(
            F.array(
                F.struct(home.alias("bucket"), F.lit(True).alias("own")),
                F.struct((home + 1).alias("bucket"), F.lit(False).alias("own")),
            )
        ),
    )
    window = (
        Window.partitionBy(*keys, "_visit.bucket").orderBy("_at").rangeBetween(-(width - 1), 0)
    )
    return (
        spread.withColumn(name, F.count("*").over(window))
        .where("_visit.own")
        .drop("_visit", "_at")
    )


#: Ranges that the values of a key are cut into, and keys whose spans are sent to all tasks at most.
RANGES = 4096
SENT_KEYS = 100_000


def nearest_rank(frame: DataFrame, keys: list[str], value: str,
                 percentiles: dict[str, int]) -> DataFrame:
    """Floor nearest-rank percentiles per key, exact also where one key has all rows.

    The value at index ``floor(p/100 * (n-1))`` of the sorted values; nulls do
    not count. The span of a key's values is cut into equal ranges. Counts per
    range tell which range holds an index and how many rows stand before it;
    then only the values of that range are counted one by one. All counts
    combine before the shuffle, and no task sorts more than the distinct values
    of one range.
    """
    key = F.struct(*keys).alias("_key")
    rows = frame.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"))
    cuts = rows.groupBy("_key").agg(F.count("*").alias("_total"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    cuts = cut_lineage(cuts)
    spans = sent(cuts.select("_key", "_least", "_most"), SENT_KEYS)
    low, high = F.col("_least").cast("double"), F.col("_most").cast("double")
    # Grows with the value, which is all that exactness needs.
    place = F.floor((F.col("_v").cast("double") - low) / (high - low) * RANGES).cast("int")
    placed = rows.join(spans, "_key").select("_key", "_v", F.when(high > low, place).otherwise(0).alias("_range"))
    upto = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = placed.groupBy("_key", "_range").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(upto))
    asked = F.array(*(
        F.struct(F.lit(name).alias("name"), F.floor(F.lit(p / 100) * (F.col("_total") - 1)).alias("index")) for name, p in percentiles.items()
    ))
    wanted = cuts.select("_key", F.explode(asked).alias("_p"))
    held = ranges.join(wanted, "_key").where((F.col("_p.index") < F.col("_upto")) & (F.col("_p.index") >= F.col("_upto") - F.col("_n")))
    held = held.select("_key", "_range", "_p.name", (F.col("_p.index") - F.col("_upto") + F.col("_n")).alias("_at"))
    near = placed.join(held.select("_key", "_range").distinct(), ["_key", "_range"], "left_semi")
    inside = Window.partitionBy("_key", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    counted = near.groupBy("_key", "_range", "_v").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(inside))
    found = counted.join(held, ["_key", "_range"]).where(F.col("_upto") > F.col("_at"))
    picks = [F.min(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in percentiles]
    return found.groupBy("_key").agg(*picks).select("_key.*", *percentiles)
