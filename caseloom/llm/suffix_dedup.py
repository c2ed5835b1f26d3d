"""Operator 8, suffix-array dedup: remove bytes of 100-byte strings that stand earlier too.

Every 100-byte window holds a minimizer: the 32 bytes with the smallest hash, the
leftmost if several. Equal windows have equal minimizers, so they meet wherever
rows are dealt out by it. Consecutive windows with the minimizer at the same
place make one run of at most 168 bytes.

1. Runs are dealt out by a hash of the minimizer, as records of hashes and
   places; text does not move. Runs equal as a whole are one class. Its earliest
   occurrence is the origin; all windows of the others are repeats.
2. Only where one minimizer has several classes must their insides be compared.
   The bytes of these classes' origins are fetched and dealt out into shards by
   minimizer. Each shard's suffix array is made by induced sorting, and the
   permuted common prefixes tell which suffixes agree in 100 bytes. Of equal
   windows all but the earliest are repeats.
   A minimizer with more classes than one suffix array should hold is not
   compared as a whole: its windows are dealt out once more, each by a hash of
   its own 100 bytes, as runs of one window. Equal windows meet as in step 1.
3. Repeats are united by document to maximal runs of removed bytes.

Of runs that one batch of texts holds several times only the earliest is dealt
out by minimizer; the others are repeats already and go by document. One task
holds the records, not the bytes, of all distinct contexts of some minimizers.

Defined results: null and empty texts have no bytes and keep none removed.
Documents are ordered by doc_id, a null before all others. Rows that repeat both
id and text are one document, and each gets its result; rows that repeat an id
with another text are documents ordered by a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import BASE, BYTE_VALUES, INVERSE, encode, mapped, mixed, pick, powers, slices, stored
from caseloom.llm.induced_sort import common_prefixes, suffix_array

LENGTH = 100
GRAM = 32
#: Bytes of text whose runs one fragment holds on average, and bytes of runs in one suffix array.
FRAGMENT_BYTES = 6 << 20
SHARD_BYTES = 1 << 20
#: Classes of one minimizer that one suffix array compares at most; a class has up to 168 bytes.
MOST_CLASSES = SHARD_BYTES // (2 * LENGTH - GRAM)
#: Windows of such minimizers that a task holds before it sends them on.
WINDOWS_HELD = 1 << 19
LEAST_PARTS = 48
PIECE = 1 << 22
BATCH_BYTES = 1 << 20

#: A run: hashes of minimizer and bytes, document (id and hash of text), first byte and number of windows.
RUN = np.dtype([("gram", "<u8"), ("bytes", "<u8"), ("doc", "<i8"), ("sig", "<u4"), ("start", "<u4"), ("windows", "<u2")])
#: Bytes of a document.
SPAN = np.dtype([("doc", "<i8"), ("sig", "<u4"), ("start", "<u4"), ("stop", "<u4")])
#: A span to fetch, with its minimizer, and whether that has too many classes for one array.
WANT = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("sig", "<u4"), ("start", "<u4"), ("stop", "<u4"), ("many", "u1")])


def pack(records: np.ndarray) -> bytes:
    """Records compressed column by column, and in a column byte by byte: upper bytes of ids and places hardly differ."""
    columns = (np.ascontiguousarray(records[name]).view(np.uint8).reshape(len(records), records.dtype[name].itemsize) for name in records.dtype.names)
    return zstd.ZstdCompressor(level=1).compress(b"".join(c.T.tobytes() for c in columns))


def unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    data = zstd.ZstdDecompressor().decompress(data)
    n = len(data) // kind.itemsize
    out, at = np.empty(n, kind), 0
    for name in kind.names:
        width = kind[name].itemsize
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out[name] = np.ascontiguousarray(planes.T).view(kind[name]).ravel()
        at += n * width
    return out


def unpack_all(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    parts = [unpack(x, kind) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - span : width - span + n])


def runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash of minimizer, hash of bytes, first byte, windows) of each run of a text.

    Long texts are read in pieces that overlap by one window less one byte.
    """
    parts = []
    for base in range(0, max(1, len(data) - length + 1), PIECE):
        piece = data[base : base + PIECE + length - 1]
        n = len(piece)
        if n < length:
            break
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE_VALUES[piece] * powers(BASE, n), out=total[1:])
            inverse = powers(INVERSE, n)
            grams = mixed((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
            # Smallest of the hash's upper 40 bits, then leftmost: the place is in the lower bits.
            keyed = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
            place = (sliding_min(keyed, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            end = np.append(first[1:], len(place))
            own = mixed((total[end + length - 1] - total[first]) * inverse[first] + (end - first).astype(np.uint64))
        parts.append((grams[place[first]], own, first + base, end - first))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, sig, text): a number for the id, and 32 bits of the text's hash."""
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), (F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))).alias("sig"), "text"
    )


def _ranges(values: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges of 64-bit hashes each value is in."""
    return ((values >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _of_doc(doc: np.ndarray, parts: int) -> np.ndarray:
    return _ranges(mixed(doc.astype(np.int64).view(np.uint64)), parts)


def _dealt(records: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, list[bytes], list[int]]:
    """Records grouped by number: the numbers, the packed records of each, and how many they are."""
    if not len(to):
        return to, [], []
    order = np.argsort(to, kind="stable")
    records, to = records[order], to[order]
    new = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    parts = np.split(records, new[1:])
    return to[new], [pack(part) for part in parts], [len(part) for part in parts]


def fragments(rows: DataFrame, parts: int) -> DataFrame:
    """(fragment, runs, spans): the runs of all texts, packed by task and hash of the minimizer; repeats in a batch as spans by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found, spans = earliest(np.concatenate(held))
            # Minimizers are smallest hashes, which crowd at the low end; scrambled once more they spread evenly.
            to, blobs, _ = _dealt(found, _ranges(mixed(found["gram"]), parts))
            by_doc, repeated, _ = _dealt(spans, _of_doc(spans["doc"], parts))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([to, by_doc]), pa.int32()), pa.array([*blobs, *[None] * len(repeated)], pa.binary()),
                 pa.array([*[None] * len(blobs), *repeated], pa.binary())],
                ["fragment", "runs", "spans"],
            )

        for part in (p for batch in batches for p in slices(batch)):
            for doc, sig, text in zip(*(part.column(c).to_pylist() for c in ("doc", "sig", "text")), strict=True):
                data = np.frombuffer(encode(text), np.uint8)
                size += len(data)
                gram, own, start, windows = runs(data)
                if len(gram):
                    records = np.empty(len(gram), RUN)
                    records["gram"], records["bytes"], records["doc"], records["sig"] = gram, own, doc, sig
                    records["start"], records["windows"] = start, windows
                    held.append(records)
                if size >= BATCH_BYTES and held:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return mapped(rows, run, "fragment int, runs binary, spans binary")


OUT = "bucket int, kind int, n long, records binary"


def _spread(spans: np.ndarray, kind: int, buckets: int) -> dict[str, list]:
    to, blobs, counts = _dealt(spans, _of_doc(spans["doc"], buckets))
    return {"bucket": to.tolist(), "kind": [kind] * len(blobs), "n": counts, "records": blobs}


def _table(*parts: dict[str, list]) -> pa.Table:
    columns = {name: [x for p in parts for x in p[name]] for name in ("bucket", "kind", "n", "records")}
    return pa.table({
        "bucket": pa.array(columns["bucket"], pa.int32()), "kind": pa.array(columns["kind"], pa.int32()), "n": pa.array(columns["n"], pa.int64()),
        "records": pa.array(columns["records"], pa.binary()),
    })


def _later(records: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Of records in order, whether each stands after the first of its group (which may be repeated rows)."""
    first = np.flatnonzero(same == 0) if len(same) else np.zeros(0, np.int64)
    lead = records[np.repeat(first, np.diff(np.append(first, len(records))))]
    return (records["doc"] != lead["doc"]) | (records["sig"] != lead["sig"]) | (records["start"] != lead["start"])


def in_classes(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs in order of minimizer, bytes and place, and whether each is the first of its class."""
    found = runs[np.lexsort((runs["start"], runs["sig"], runs["doc"], runs["bytes"], runs["gram"]))]
    new = np.ones(len(found), bool)
    new[1:] = (found["gram"][1:] != found["gram"][:-1]) | (found["bytes"][1:] != found["bytes"][:-1])
    return found, new


def spans_of(runs: np.ndarray) -> np.ndarray:
    spans = np.empty(len(runs), SPAN)
    for name in ("doc", "sig", "start"):
        spans[name] = runs[name]
    spans["stop"] = runs["start"] + runs["windows"] + LENGTH - 1
    return spans


def earliest(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest run of each class, and the others as spans."""
    _, inverse, counts = np.unique(runs["bytes"], return_inverse=True, return_counts=True)
    several = counts[inverse] > 1
    if not several.any():
        return runs, np.empty(0, SPAN)
    found, new = in_classes(runs[several])
    spans = spans_of(found[_later(found, (~new).astype(np.int8))])
    return np.concatenate([runs[~several], found[new]]), joined_spans(spans[np.lexsort((spans["start"], spans["sig"], spans["doc"]))])


def classes(group: pa.Table, buckets: int, most: int = MOST_CLASSES) -> pa.Table:
    """Of one fragment: spans of later occurrences (kind 0) and origins to compare (kind 1)."""
    known = unpack_all(group.column("spans").drop_null(), SPAN)
    found = unpack_all(group.column("runs").drop_null(), RUN)
    _, inverse, counts = np.unique(found["gram"], return_inverse=True, return_counts=True)
    found, new_class = in_classes(found[counts[inverse] > 1])
    if not len(found):
        return _table(_spread(known, 0, buckets))
    new_gram = np.concatenate([[True], found["gram"][1:] != found["gram"][:-1]])
    spans = spans_of(found[_later(found, (~new_class).astype(np.int8))])
    gram_number = np.cumsum(new_gram) - 1
    count = np.bincount(gram_number[new_class])[gram_number]
    chosen = new_class & (count > 1)
    origins = spans_of(found[chosen])
    wanted = np.empty(len(origins), WANT)
    wanted["gram"], wanted["many"] = found["gram"][chosen], count[chosen] > most
    for name in ("doc", "sig", "start", "stop"):
        wanted[name] = origins[name]
    return _table(_spread(np.concatenate([known, spans]), 0, buckets), _spread(wanted, 1, buckets))


def by_document(records: pa.ChunkedArray, kind: np.dtype) -> tuple[np.ndarray, list[np.ndarray]]:
    """(doc, sig) of each document in a bucket, and its records in order of their start."""
    found = unpack_all(records, kind)
    found = found[np.lexsort((found["start"], found["sig"], found["doc"]))]
    if not len(found):
        return found, []
    new = np.flatnonzero(np.concatenate([[True], (found["doc"][1:] != found["doc"][:-1]) | (found["sig"][1:] != found["sig"][:-1])]))
    return found[new], np.split(found, new[1:])


def united(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans in order of their start; touching ones join."""
    reach = np.maximum.accumulate(stop)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def _wanted_rows(group: pa.Table) -> pa.Table:
    heads, parts = by_document(group.column("records"), WANT)
    return pa.table({
        "doc": pa.array(heads["doc"], pa.int64()), "sig": pa.array(heads["sig"].astype(np.int64)), "wanted": pa.array([pack(p) for p in parts], pa.binary()),
    })


def _span_rows(group: pa.Table) -> pa.Table:
    heads, parts = by_document(group.column("records"), SPAN)
    removed, count, spans = [], [], []
    for part in parts:
        start, stop = united(part["start"], part["stop"])
        removed.append(int((stop.astype(np.int64) - start).sum()))
        count.append(len(start))
        spans.append(np.stack([start, stop]).astype("<u4").tobytes())
    return pa.table({
        "doc": pa.array(heads["doc"], pa.int64()), "sig": pa.array(heads["sig"].astype(np.int64)), "n_removed": pa.array(removed, pa.int64()),
        "n_spans": pa.array(count, pa.int64()), "spans": pa.array(spans, pa.binary()),
    })


def packed_texts(rows: DataFrame) -> DataFrame:
    """(doc, sig, packed): texts compressed, so that a shuffle moves less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstd.ZstdCompressor(level=1)
        for part in (p for batch in batches for p in slices(batch, 1024)):
            packed = pa.array([press.compress(encode(t)) for t in part.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("sig"), packed], ["doc", "sig", "packed"])

    return mapped(rows, run, "doc long, sig long, packed binary")


def single_windows(wanted: np.void, content: bytes) -> np.ndarray:
    """Each window of a span as a run of its own."""
    data = np.frombuffer(content, np.uint8)
    n = len(data) - LENGTH + 1
    out = np.empty(n, RUN)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=total[1:])
        out["bytes"] = mixed((total[LENGTH:] - total[:-LENGTH]) * powers(INVERSE, n) + np.uint64(1))
    for name in ("gram", "doc", "sig"):
        out[name] = wanted[name]
    out["start"], out["windows"] = wanted["start"] + np.arange(n), 1
    return out


def _fetch(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """(shard, wanted, contents): the bytes of wanted spans, by shard of the minimizer.

    Windows of minimizers with too many classes go without bytes to shards of
    their own, behind the others, by the hash of the window.
    """
    unpress = zstd.ZstdDecompressor()
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        found, spans = earliest(np.concatenate(held))
        to, blobs, _ = _dealt(found, shards + _ranges(mixed(found["gram"] ^ mixed(found["bytes"])), shards))
        # Repeats of a batch need no other and go to any shard.
        by_doc, repeated, _ = _dealt(spans, shards + _of_doc(spans["doc"], shards))
        n = len(blobs) + len(repeated)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([to, by_doc]), pa.int32()), pa.array([*blobs, *repeated], pa.binary()),
             pa.array([None] * n, pa.binary()), pa.array([False] * len(blobs) + [True] * len(repeated))],
            ["shard", "wanted", "contents", "known"],
        )

    for part in (p for batch in batches for p in slices(batch, 2048)):
        wanted, contents = [], []
        for packed, blob in zip(part.column("packed").to_pylist(), part.column("wanted").to_pylist(), strict=True):
            data, own = unpress.decompress(packed), unpack(blob, WANT)
            for record in own[own["many"] == 1]:
                held.append(single_windows(record, data[record["start"] : record["stop"]]))
                size += len(held[-1])
                if size >= WINDOWS_HELD:
                    yield flush()
                    held, size = [], 0
            own = own[own["many"] == 0]
            wanted.append(own)
            contents += [data[a:b] for a, b in zip(own["start"].tolist(), own["stop"].tolist(), strict=True)]
        records = np.concatenate(wanted) if wanted else np.empty(0, WANT)
        if not len(records):
            continue
        to = _ranges(mixed(records["gram"]), shards)
        order = np.argsort(to, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], to[order][1:] != to[order][:-1]]))
        groups = np.split(order, new[1:])
        press = zstd.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(to[order][new], pa.int32()), pa.array([pack(records[g]) for g in groups], pa.binary()),
             pa.array([press.compress(b"".join(contents[k] for k in g)) for g in groups], pa.binary()), pa.array([False] * len(groups))],
            ["shard", "wanted", "contents", "known"],
        )
    if held:
        yield flush()


def repeats(records: np.ndarray, contents: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Spans of repeated windows among origins with these bytes, found in one suffix array.

    The shard's text is the contents one after another, a stop behind each; a
    last letter smaller than all others ends it.
    """
    sizes = np.array([len(c) for c in contents])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.ones(begin[-1] + 1, np.int64)
    text[-1] = 0
    joined = np.frombuffer(b"".join(contents), np.uint8)
    at = np.arange(len(joined)) + np.repeat(np.arange(len(sizes)), sizes)
    text[at] = joined.astype(np.int64) + 2
    order = suffix_array(text)
    common = common_prefixes(text, order)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    owner = np.append(owner, len(sizes))
    left = np.append(begin[1:], begin[-1] + 1)[owner] - 1 - np.arange(len(text))
    # A window is a suffix with enough bytes before its stop. Equal windows are neighbours in order.
    windows = order[left[order] >= length]
    joins = np.zeros(len(order), bool)
    joins[1:] = np.minimum(common[order[1:]], np.minimum(left[order[1:]], left[order[:-1]])) >= length
    joins = joins[left[order] >= length]
    if not len(windows):
        return np.empty(0, SPAN)
    group = np.cumsum(~joins) - 1
    who = owner[windows]
    start = records["start"][who] + (windows - begin[who])
    # Order of windows by document and place.
    by = np.lexsort((start, records["sig"][who], records["doc"][who]))
    rank = np.empty(len(by), np.int64)
    different = np.concatenate([[True], np.zeros(len(by) - 1, bool)])
    for values in (records["doc"][who][by], records["sig"][who][by], start[by]):
        different[1:] |= values[1:] != values[:-1]
    rank[by] = np.cumsum(different)
    first = np.minimum.reduceat(rank, np.flatnonzero(~joins))
    again = rank > first[group]
    out = np.empty(int(again.sum()), SPAN)
    out["doc"], out["sig"] = records["doc"][who[again]], records["sig"][who[again]]
    out["start"], out["stop"] = start[again], start[again] + length
    out = out[np.lexsort((out["start"], out["sig"], out["doc"]))]
    return joined_spans(out)


def joined_spans(spans: np.ndarray) -> np.ndarray:
    """Overlapping spans of one document as one; spans come in order."""
    if not len(spans):
        return spans
    new = np.concatenate([
        [True], (spans["doc"][1:] != spans["doc"][:-1]) | (spans["sig"][1:] != spans["sig"][:-1]) | (spans["start"][1:] > spans["stop"][:-1])
    ])
    first = np.flatnonzero(new)
    out = spans[first].copy()
    out["stop"] = spans["stop"][np.append(first[1:], len(spans)) - 1]
    return out


def _sorted_shard(group: pa.Table, buckets: int) -> pa.Table:
    if group.column("contents").null_count:
        known = group.column("known")
        _, spans = earliest(unpack_all(group.filter(pc.invert(known)).column("wanted"), RUN))
        return _table(_spread(np.concatenate([spans, unpack_all(group.filter(known).column("wanted"), SPAN)]), 0, buckets))
    unpress = zstd.ZstdDecompressor()
    records, contents = [], []
    for blob, pressed in zip(group.column("wanted").to_pylist(), group.column("contents").to_pylist(), strict=True):
        own, data = unpack(blob, WANT), unpress.decompress(pressed)
        stops = np.cumsum(own["stop"].astype(np.int64) - own["start"])
        contents += [data[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
        records.append(own)
    found = np.concatenate(records)
    # Minimizers stay together; a shard of several arrays keeps each one small.
    order = np.argsort(found["gram"], kind="stable")
    sizes = np.cumsum([len(contents[k]) for k in order])
    new_gram = np.concatenate([[True], found["gram"][order][1:] != found["gram"][order][:-1]])
    number = np.maximum.accumulate(np.where(new_gram, sizes // SHARD_BYTES, 0))
    cuts = np.flatnonzero(np.diff(number)) + 1
    spans = [repeats(found[own], [contents[k] for k in own]) for own in np.split(order, cuts)]
    return _table(_spread(np.concatenate(spans), 0, buckets))


def repeated_spans(docs: DataFrame, most: int = MOST_CLASSES) -> DataFrame:
    """(doc, sig, n_removed, n_spans, spans): bytes to remove of each document that has any."""
    rows = keyed(docs)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    parts = max(LEAST_PARTS, total // FRAGMENT_BYTES)
    found = stored(fragments(rows, parts).groupBy("fragment").applyInArrow(lambda group: classes(group, parts, most), OUT))
    wanted = found.where("kind = 1")
    many = wanted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    shards = max(LEAST_PARTS, many * 140 // SHARD_BYTES)
    asked = wanted.groupBy("bucket").applyInArrow(_wanted_rows, "doc long, sig long, wanted binary")
    once = packed_texts(rows).join(asked, ["doc", "sig"]).select("packed", "wanted")
    contents = mapped(once, lambda batches: _fetch(batches, shards), "shard int, wanted binary, contents binary, known boolean")
    compared = contents.groupBy("shard").applyInArrow(lambda group: _sorted_shard(group, parts), OUT)
    spans = found.where("kind = 0").unionByName(compared)
    return spans.groupBy("bucket").applyInArrow(_span_rows, "doc long, sig long, n_removed long, n_spans long, spans binary")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpress = zstd.ZstdDecompressor()
    for batch in batches:
        out = []
        for packed, blob in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = unpress.decompress(packed)
            start, stop = np.frombuffer(blob, "<u4").reshape(2, -1).tolist()
            out.append(hashlib.sha256(b"".join(data[a:b] for a, b in zip([0, *stop], [*start, len(data)], strict=True))).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("sig"), pa.array(out, pa.string())], ["doc", "sig", "kept"])


def deduplicated(docs: DataFrame, most: int = MOST_CLASSES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row.

    Texts move once more for documents of which a part is removed; what stays
    whole or goes whole is known without them.
    """
    spans = stored(repeated_spans(docs, most))
    ids = pick(docs, doc_id="doc_id", text="text").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc")
    )
    ids = ids.select(
        "doc_id", "doc", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("sig"), F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("whole"),
    )
    counted = ids.join(spans.select("doc", "sig", "n_removed", "n_spans"), ["doc", "sig"], "left")
    partly = counted.where("n_removed < n_bytes").select("doc", "sig").distinct().join(spans.select("doc", "sig", "spans"), ["doc", "sig"])
    kept = mapped(packed_texts(keyed(docs)).join(partly, ["doc", "sig"]), _kept, "doc long, sig long, kept string")
    kept = kept.groupBy("doc", "sig").agg(F.first("kept").alias("kept"))
    nothing = hashlib.sha256(b"").hexdigest()
    return counted.join(kept, ["doc", "sig"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.when(F.coalesce("n_removed", F.lit(0)) == 0, F.col("whole")).when(F.col("n_removed") == F.col("n_bytes"), nothing).otherwise(F.col("kept")).alias("kept_sha256"),
    )
