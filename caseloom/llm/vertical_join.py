"""Operator 4, n-gram Jaccard join by vertical partitioning.

A document is its set of distinct five-word shingles. Equal sets are one class
from the start, so copies are never paired. The rest is done on classes:

1. Sets are cut into fragments by ranges of the shingle hash, and each fragment
   is dealt out on its own. It holds all occurrences of its shingles, so their
   document counts are known there. Shingles of one class only are counted and
   dropped; they cannot overlap with anything. (What is sent of a 64-bit hash is
   its fragment and 48 bits; two documents' own shingles agree by chance with a
   probability of some 1e-10.)
2. The fragments give the global order: rarest shingle first, then by hash. Two
   linked sets share a shingle among the rarest quarter of either (the prefix),
   and where it stands bounds what they can still share. Most sets have only
   shingles of their own in the prefix and have no candidates at all.
3. Candidates of one shingle are first compared with one leader, the class that
   has the least of its own. Classes that remain outside the leader's component
   are then compared with all others of the shingle that the bound lets pass.
   What is already connected is not compared again; no link between different
   components is lost.
4. A pair is verified by fragments: overlaps are counted separately in each and
   summed per pair.

Links make components; a document's class id is the smallest doc_id there.

Defined results: null, empty and blank texts have no shingles, link with nothing
and are their own component. A null doc_id is ignored by the minimum, and a
component of null ids only has a null id. Repeated rows are copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import LOWER, encode, mapped, pick, run_hashes, slices, span_hashes, stored, word_spans
from caseloom.llm.graph import components

SIZE = 5
#: Shingles that one fragment holds at most on average; the number of fragments follows the input.
FRAGMENT_SHINGLES = 4_000_000
LEAST_FRAGMENTS = 32
#: Bytes of a shingle hash that are sent; the fragment tells its upper bits.
SENT = 6
#: Fragments in which a pair's overlap is counted.
PARTS = 8
BATCH_BYTES = 1 << 19

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def shingle_sets(texts: list[str], size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``size`` are one shingle."""
    data = [encode(t) for t in texts]
    bounds = np.cumsum([len(d) + 1 for d in data])
    joined = LOWER[np.frombuffer(b"\n".join(data) + b"\n", np.uint8)]
    starts, ends = word_spans(joined, IS_WORD)
    words = span_hashes(joined, starts, ends)
    stops = np.searchsorted(starts, bounds)
    runs = run_hashes(words, size) if len(words) >= size else np.zeros(0, np.uint64)
    out, at = [], 0
    for stop in stops:
        n = stop - at
        if n >= size:
            own = runs[at : stop - size + 1]
        elif n:
            own = run_hashes(words[at:stop], int(n))
        else:
            own = runs[:0]
        out.append(np.unique(own))
        at = stop
    return out


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[np.ndarray], pa.DataType]]:
    """Ids and sets of a few documents at a time."""
    for batch in batches:
        kind = batch.schema.field(0).type
        ids, texts, held = [], [], 0
        for part in slices(batch):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text or "")
                held += len(texts[-1])
                if held >= BATCH_BYTES:
                    yield ids, shingle_sets(texts, size), kind
                    ids, texts, held = [], [], 0
        if ids:
            yield ids, shingle_sets(texts, size), kind


def class_key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def members(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, sig, n, key): hash of the text, number of shingles and the class of equal sets (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets, kind in _sets(batches, size):
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, kind), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) for s in sets], pa.binary())],
                ["row", "n", "key"],
            )

    rows = pick(docs, doc_id="doc_id", text="text").select(F.struct("doc_id", F.xxhash64("text").alias("sig")).alias("row"), "text")
    found = mapped(rows, run, rows.select("row").schema.add("n", "long").add("key", "binary"))
    return found.select("row.doc_id", "row.sig", "n", "key")


def _binary(values: np.ndarray, bounds: np.ndarray, sent: int | None = None) -> pa.Array:
    """Slices of an array, from each bound to the next, as a binary column; of each value only the ``sent`` lower bytes."""
    if sent is not None:
        values = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize)[:, :sent])
    offsets = (bounds * (sent or values.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def segments(docs: DataFrame, bits: int, size: int = SIZE) -> DataFrame:
    """(fragment, key, n, shingles): the sets cut by the top bits of the hash.

    Copies that one task meets together are sent once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, _ in _sets(batches, size):
            own = {class_key(s): s for s in sets if len(s)}
            if not own:
                continue
            lengths = np.array([len(s) for s in own.values()])
            shingles = np.concatenate(list(own.values()))
            doc = np.repeat(np.arange(len(own)), lengths)
            fragment = (shingles >> np.uint64(64 - bits)).astype(np.int32)
            new = np.flatnonzero(np.concatenate([[True], (fragment[1:] != fragment[:-1]) | (doc[1:] != doc[:-1])]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(fragment[new]), pa.array(list(own), pa.binary()).take(pa.array(doc[new])), pa.array(lengths[doc[new]].astype(np.int64)),
                 _binary(shingles, np.append(new, len(shingles)), SENT)],
                ["fragment", "key", "n", "shingles"],
            )

    return mapped(pick(docs, doc_id="doc_id", text="text"), run, "fragment int, key binary, n long, shingles binary")


def _sent(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a column as they were sent, and how many each row has."""
    rows = column.to_pylist()
    data = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, SENT)
    values = np.zeros((len(data), 8), np.uint8)
    values[:, :SENT] = data
    return values.view(np.uint64).ravel(), np.array([len(r) for r in rows], np.int64) // SENT


def _shared(group: pa.Table) -> pa.Table:
    """Of one fragment, the shingles that more than one class has, with the number of classes."""
    group = group.take(pa.array(_first_of(group.column("key").to_pylist())))
    shingles, lengths = _sent(group.column("shingles"))
    row = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    runs = np.diff(np.append(start, len(ordered)))
    count = np.empty(len(shingles), np.uint32)
    count[order] = np.repeat(runs, runs)
    many = count > 1
    upper = np.uint64(group.column("fragment")[0].as_py()) << np.uint64(8 * SENT)
    shingles, count, row = shingles[many] | upper, count[many], row[many]
    new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    bounds = np.append(new, len(row))
    head = group.select(["key", "n"]).take(pa.array(row[new]))
    return pa.table({
        "key": head.column("key").cast(pa.binary()), "n": head.column("n"), "shingles": _binary(shingles, bounds), "counts": _binary(count, bounds),
    })


def _first_of(keys: list[bytes]) -> np.ndarray:
    """Where each distinct key stands first: a copy met by another task counts once."""
    seen: dict[bytes, int] = {}
    for k, key in enumerate(keys):
        seen.setdefault(key, k)
    return np.fromiter(seen.values(), np.int64, len(seen))


def prefix_length(n: int) -> int:
    """How many of the rarest shingles two linked sets must meet in: n - ceil(3n/4) + 1."""
    return n - -(-3 * n // 4) + 1


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes that may have links: shared shingles in global order, and where the prefix ends."""
    for batch in (part for whole in batches for part in slices(whole)):
        out = []
        for row in batch.to_pylist():
            shingles = np.concatenate([np.frombuffer(p["shingles"], np.int64) for p in row["parts"]])
            counts = np.concatenate([np.frombuffer(p["counts"], np.uint32) for p in row["parts"]])
            own = row["n"] - len(shingles)
            take = prefix_length(row["n"]) - own
            if take > 0:
                order = np.lexsort((shingles, counts))
                out.append((row["key"], row["n"], own, shingles[order], take))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()),
             pa.array([r[3] for r in out], pa.list_(pa.int64())), pa.array([r[4] for r in out], pa.int32())],
            ["key", "n", "own", "shingles", "take"],
        )


def candidates(docs: DataFrame, total: int, size: int = SIZE) -> DataFrame:
    """(key, n, own, shingles, take) of the classes that may have links."""
    bits = (max(LEAST_FRAGMENTS, -(-total // FRAGMENT_SHINGLES)) - 1).bit_length()
    found = segments(docs, bits, size).groupBy("fragment").applyInArrow(_shared, "key binary, n long, shingles binary, counts binary")
    parts = found.groupBy("key").agg(F.first("n").alias("n"), F.collect_list(F.struct("shingles", "counts")).alias("parts"))
    return mapped(parts, _ordered, "key binary, n long, own long, shingles array<long>, take int")


def may_link(n: Column, place: Column, other_n: Column, other_place: Column) -> Column:
    """Whether two sets can reach the threshold if this is the first shingle they share."""
    left = F.least(n - place, other_n - other_place)
    return 7 * left >= 3 * (n + other_n)


def verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The linked among pairs (a, b): overlaps by fragment, summed per pair."""
    part = F.pmod(F.shiftright("shingle", 45), F.lit(PARTS)).cast("int")
    named = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    exploded = found.join(named.withColumnRenamed("a", "key"), "key", "left_semi").select("key", "n", F.explode("shingles").alias("shingle"))
    cut = stored(exploded.groupBy("key", "n", part.alias("part")).agg(F.collect_list("shingle").alias("own")))
    left = cut.select(F.col("key").alias("a"), F.col("n").alias("na"), "part", F.col("own").alias("left"))
    right = cut.select(F.col("key").alias("b"), F.col("n").alias("nb"), "part", F.col("own").alias("right"))
    overlap = F.size(F.array_intersect("left", "right"))
    counted = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", "na", "nb", overlap.alias("overlap"))
    summed = counted.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    return summed.where(7 * F.col("overlap") >= 3 * (F.col("na") + F.col("nb"))).select("a", "b")


def links(docs: DataFrame, known: DataFrame, size: int = SIZE) -> DataFrame:
    """Edges (a, b) between classes whose components are those of all links."""
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    found = stored(candidates(docs, total, size))
    places = found.select("key", "n", "own", F.posexplode(F.slice("shingles", 1, F.col("take"))).alias("k", "shingle"))
    places = stored(places.select("shingle", "key", "n", (F.col("own") + F.col("k")).alias("place")))
    leader = F.min(F.struct("place", "n", "key")).alias("lead")
    shared = places.groupBy("shingle").agg(leader, F.count("*").alias("classes")).where("classes > 1").select("shingle", "lead")
    shared = stored(shared)

    def pair(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    met = places.join(shared, "shingle").where(F.col("key") != F.col("lead.key"))
    met = met.where(may_link(F.col("n"), F.col("place"), F.col("lead.n"), F.col("lead.place")))
    first = stored(met.select(*pair("key", "lead.key")).distinct())
    edges = stored(verified(first, found))
    roots = components(edges).withColumnRenamed("node", "key")
    rooted = places.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    lead_root = shared.select("shingle", F.col("lead.key").alias("key")).join(roots, "key", "left")
    lead_root = lead_root.select("shingle", F.coalesce("root", "key").alias("lead_root"))
    rooted = stored(rooted.join(lead_root, "shingle"))
    outside = rooted.where("root <> lead_root").select(
        "shingle", F.col("key").alias("x"), F.col("n").alias("xn"), F.col("place").alias("xp"), F.col("root").alias("xr")
    )
    rest = outside.join(rooted, "shingle").where(
        (F.col("root") != F.col("xr")) & may_link(F.col("xn"), F.col("xp"), F.col("n"), F.col("place"))
    )
    second = stored(rest.select(*pair("x", "key")).distinct().join(first, ["a", "b"], "left_anti"))
    return edges.unionByName(verified(second, found))


def rooted_classes(docs: DataFrame, known: DataFrame, size: int = SIZE) -> DataFrame:
    """(key, first, root): each class of equal sets, its smallest doc_id, and its component."""
    roots = components(links(docs, known, size)).withColumnRenamed("node", "key")
    classes = known.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"))
    return stored(classes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))


def near_duplicates(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row."""
    known = stored(members(docs, size))
    joined = rooted_classes(docs, known, size)
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    named = joined.join(least, "root").select("key", "component")
    return known.join(named, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def representatives(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows, all columns, of one document of each component: the one with the smallest doc_id.

    Documents without shingles all stay. Rows that repeat id and text are one
    document, of which one row stays; a null id comes after all others.
    """
    known = stored(members(docs, size))
    joined = rooted_classes(docs, known, size)
    named = known.join(joined.select("key", "root"), "key")
    chosen = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")).alias("own"))
    kept = chosen.select("own.doc_id", "own.sig").unionByName(known.where("key is null").select("doc_id", "sig").distinct())
    kept = kept.toDF("kept_id", "kept_sig")
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names)
    own_id, own_sig = F.col(names[docs.columns.index("doc_id")]), F.xxhash64(names[docs.columns.index("text")])
    rows = rows.withColumn("row_sig", own_sig)
    same = own_id.eqNullSafe(F.col("kept_id")) & (F.col("row_sig") == F.col("kept_sig"))
    once = rows.join(kept, same, "left_semi").dropDuplicates([names[docs.columns.index("doc_id")], "row_sig"])
    return once.select(*names).toDF(*docs.columns)
