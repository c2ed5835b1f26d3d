"""Operator 13, near-duplicates by SimHash with tiled exact comparison.

A document's fingerprint has a bit for each of the 64 bits that more than half of
its three-word shingles' hashes have. Equal fingerprints are one node from the
start, so copies are never compared. Distinct fingerprints are dealt out to tiles
by the population counts of their parts of 16 bits. Two fingerprints that differ
in at most ``RADIUS`` bits have counts that differ by no more, summed over the
parts; so a tile is compared only with tiles that near, and all other pairs of
tiles are skipped. Comparison is exact: every pair of two such tiles goes through
exclusive-or and a count of bits.

A tile with many fingerprints is cut into chunks by their hash, and pairs of
chunks are the units of work, each of bounded size: at most some thousand
fingerprints on either side, compared a block of rows at a time. A pair of chunks
gives its links, or, where there are more links than fingerprints, one edge from
each fingerprint to the smallest one that it reaches there; components stay the
same and nobody lists all pairs of a large group.

The work grows with the square of the distinct fingerprints, as all exact
comparison does; the counts leave about 4 % of the pairs of unrelated ones.

Defined results: null, empty and blank texts have the fingerprint zero and link as
any other. Fewer than three words are one shingle. A null doc_id is ignored by the
minimum; a component of null ids only has a null id. Repeated rows are copies.
Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from caseloom.llm.common import LOWER, encode, mapped, pick, sized_slices, stored, word_spans
from caseloom.llm.graph import components

SIZE = 3
SEED = 42
RADIUS = 3
PARTS = 4
PART_BITS = 64 // PARTS
#: Population counts that a part can have.
COUNTS = PART_BITS + 1
#: Fingerprints of one chunk on average, rows of a chunk compared at once, and hashes whose bits are counted at once.
CHUNK = 2048
ROWS = 256
HASHES = 1 << 14

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def fingerprint(text: str | None, size: int = SIZE) -> int:
    """The SimHash of one text: bits that more than half of its shingles' hashes have."""
    data = LOWER[np.frombuffer(encode(text or ""), np.uint8)]
    starts, ends = word_spans(data, IS_WORD)
    if not len(starts):
        return 0
    # The words one after another with one space between, and where each begins and ends there.
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    keep = np.repeat(starts - first, lengths + 1) + np.arange(first[-1] + lengths[-1] + 1)
    gaps = first[1:] - 1
    joined = np.take(data, keep[:-1], mode="clip")
    joined[gaps] = 0x20
    run = min(size, len(starts))
    begin, stop = first[: len(first) - run + 1].tolist(), (first + lengths)[run - 1 :].tolist()
    view, ones = joined.tobytes(), np.zeros(64, np.int64)
    for at in range(0, len(begin), HASHES):
        hashes = np.array([xxh64_intdigest(view[a:b], SEED) for a, b in zip(begin[at : at + HASHES], stop[at : at + HASHES], strict=True)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(begin), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in sized_slices(whole)):
        found = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, fp) for each row; ``fp`` holds the 64 bits as a long."""
    rows = pick(docs, doc_id="doc_id", text="text")
    return mapped(rows, partial(_fingerprints, size=size), rows.select("doc_id").schema.add("fp", "long"))


def offsets(radius: int = RADIUS) -> list[int]:
    """Differences of tile numbers at which counts differ by at most ``radius`` in sum, one of each pair of opposite ones.

    Tile numbers are the counts of the parts as digits in base ``2 * COUNTS``, so
    that no sum of a number and a difference means two pairs of tiles.
    """
    near = [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius and d >= (0,) * PARTS]
    return [sum(x * (2 * COUNTS) ** k for k, x in enumerate(reversed(d))) for d in near]


def tile_of(fp: Column) -> Column:
    digit = [F.bit_count(F.shiftrightunsigned(fp, PART_BITS * k).bitwiseAND(F.lit((1 << PART_BITS) - 1).cast("long"))) for k in range(PARTS)]
    return reduce(lambda number, d: number * F.lit(2 * COUNTS) + d, digit[::-1]).cast("int")


def chunks(nodes: DataFrame, size: int = CHUNK) -> DataFrame:
    """(tile, chunk, fps): distinct fingerprints by tile, large tiles in several chunks."""
    tiled = nodes.select("fp", tile_of(F.col("fp")).alias("tile"))
    # One row per tile there is, at most COUNTS ** PARTS = 83,521 of some bytes.
    counts = tiled.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("parts"))
    dealt = tiled.join(F.broadcast(counts), "tile").select("tile", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("chunk"), "fp")
    return dealt.groupBy("tile", "chunk").agg(F.collect_list("fp").alias("fps"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node of the given links to the smallest node that it reaches by them."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    least = np.arange(len(nodes))
    while True:
        new = least.copy()
        near = np.minimum(least[left], least[right])
        np.minimum.at(new, left, near)
        np.minimum.at(new, right, near)
        # Also the roots move, so that distances halve.
        np.minimum.at(new, least[left], near)
        np.minimum.at(new, least[right], near)
        new = new[new]
        if (new == least).all():
            break
        least = new
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[moved], nodes[least[moved]]


def compared(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between two chunks (or within one), or edges with the same components if there are more than fingerprints."""
    none = np.zeros(0, np.int64)
    a, b = none, none
    most = len(left) + len(right)
    for at in range(0, len(left), ROWS):
        rows = left[at : at + ROWS]
        others = right[at + 1 :] if same else right
        near = np.bitwise_count((rows[:, None] ^ others[None, :]).view(np.uint64)) <= radius
        i, j = np.nonzero(near)
        if same:
            below = j + 1 > i
            i, j = i[below], j[below]
        if not len(i):
            continue
        a, b = np.concatenate([a, rows[i]]), np.concatenate([b, others[j]])
        if len(a) > most:
            a, b = forest(a, b)
    return a, b


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = []
        for name in ("fps", "others"):
            column = batch.column(name)
            sides.append((column.offsets.to_numpy(), column.values.to_numpy()))
        (left_at, left), (right_at, right) = sides
        own = batch.column("own").to_pylist()
        found = [
            compared(left[left_at[k] : left_at[k + 1]], right[right_at[k] : right_at[k + 1]], radius, own[k]) for k in range(batch.num_rows)
        ]
        for a, b in (f for f in found if len(f[0])):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(nodes: DataFrame, radius: int = RADIUS, size: int = CHUNK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links."""
    cut = stored(chunks(nodes, size))
    sent = cut.withColumn("near", F.explode(F.array(*(F.lit(d) for d in offsets(radius))))).select(
        (F.col("tile") + F.col("near")).alias("tile"), F.col("chunk").alias("from_chunk"), "fps", (F.col("near") == 0).alias("home")
    )
    # Tiles that are not there get nothing: their numbers are few and known.
    there = cut.select("tile").distinct()
    sent = sent.join(F.broadcast(there), "tile", "left_semi")
    met = sent.join(cut.select("tile", "chunk", F.col("fps").alias("others")), "tile")
    met = met.where(~F.col("home") | (F.col("from_chunk") <= F.col("chunk")))
    met = met.select("fps", "others", (F.col("home") & (F.col("from_chunk") == F.col("chunk"))).alias("own"))
    return mapped(met, partial(_compare, radius=radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SIZE, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row."""
    known = stored(fingerprints(docs, size))
    nodes = stored(known.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    roots = components(links(nodes, radius, chunk)).withColumnRenamed("node", "fp")
    # A fingerprint of one row without links is its own component and need not be looked up.
    grouped = nodes.join(roots, "fp", "left").where("rows > 1 or root is not null").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    grouped = stored(grouped)
    least = grouped.groupBy("root").agg(F.min("first").alias("component"))
    named = grouped.join(least, "root").select("fp", "component")
    return known.join(named, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component", "doc_id").alias("component_id")
    )
