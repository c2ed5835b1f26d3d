"""Operator 10, benchmark decontamination by suffix arrays over the training words.

Documents are cut into shards, consecutive rows of a task up to some megabytes.
In each shard the suffixes of the word sequence are sorted; every suffix of
every benchmark item is then looked up by binary search. Places where at least a
whole window of the item follows are verbatim matches; neighbouring places on
one diagonal join to the longest match. Words inside any match are hit, and
documents with too large a share of hit words are contaminated.

Suffixes are ordered by 16-bit codes of their first 16 words, which is enough to
find windows of up to 16 words; each place found is then compared word by word
by 64-bit hashes. Documents never move: shards are searched where rows are read.

Equal windows of the benchmark are looked up once and carry the set of items that
hold them, so a place is met at most once per window length, however often words
repeat. For places so met the longest match is searched in a suffix array of the
benchmark; a match inside a longer one is left out. The benchmark is sent in
blocks of bounded size, one pass each, and a block's results are stored before
the next is made.

Defined results: null and empty texts have no words and are clean. An item
without words matches nothing; a null item id is skipped. Rows that repeat an
item id are occurrences of one item. Rows that repeat a document repeat results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import BASE, INVERSE, LOWER, encode, mapped, mixed, pick, powers, sized_slices, span_hashes, stored, with_rows, word_spans

WINDOW = 13
#: A document is contaminated when SHARE * hit words >= words.
SHARE = 20
SHARD_BYTES = 1 << 20
#: Words of the benchmark that one pass sends to the executors (some 30 bytes each).
BLOCK_WORDS = 4_000_000
#: Windows that are looked up in a shard at once.
QUERIES = 1 << 16

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word of lower-cased bytes."""
    starts, ends = word_spans(data, IS_WORD)
    return starts, span_hashes(data, starts, ends)


def prefix_sums(words: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any run of words follows."""
    out = np.zeros(len(words) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mixed(words) * powers(BASE, len(words)), out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the runs of ``size`` words from ``start``, equal for equal runs of any sequence."""
    with np.errstate(over="ignore"):
        return (sums[start + size] - sums[start]) * powers(INVERSE, len(sums))[start]


@dataclass
class Windows:
    """The distinct windows of one length, and the sets of items that hold them."""

    #: First word of each distinct window, and the number of its set of items.
    firsts: np.ndarray
    group: np.ndarray
    #: Set k is ``members[bounds[k] : bounds[k + 1]]``. Windows of a passage that items share have one set.
    bounds: np.ndarray
    members: np.ndarray


def windows_of(hashes: np.ndarray, starts: np.ndarray, owners: np.ndarray) -> Windows:
    order = np.lexsort((owners, hashes))
    hashes, starts, owners = hashes[order], starts[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    once = new.copy()
    once[1:] |= owners[1:] != owners[:-1]
    starts, owners, new = starts[once], owners[once], new[once]
    first = np.flatnonzero(new)
    with np.errstate(over="ignore"):
        sets = np.add.reduceat(mixed(owners.astype(np.uint64) + np.uint64(1)), first)
    _, example, group = np.unique(sets, return_index=True, return_inverse=True)
    size = np.diff(np.append(first, len(owners)))[example]
    members = owners[spread(first[example], size)]
    return Windows(starts[first].astype(np.int32), group.astype(np.int32), np.concatenate([[0], np.cumsum(size)]), members.astype(np.int32))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each start and size, one after another."""
    before = np.concatenate([[0], np.cumsum(size)[:-1]])
    return np.repeat(start - before, size) + np.arange(size.sum())


@dataclass
class Block:
    """Some items: their words, each item followed by a stop of value 0, and the windows to find, by length."""

    words: np.ndarray
    #: All suffixes of the words in order, as far as items reach.
    order: np.ndarray
    windows: dict[int, Windows]
    #: The item of each stretch of words between stops.
    owners: np.ndarray
    ids: list[str]

    @cached_property
    def stops(self) -> np.ndarray:
        return np.flatnonzero(self.words == 0)

    @cached_property
    def sums(self) -> np.ndarray:
        return prefix_sums(self.words)

    def longest(self, words: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words from each place ``at`` (of texts that end at ``ends``) some item holds, and that item."""
        sums = prefix_sums(words)

        def common(place: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
            low, high = np.zeros(len(place), np.int64), np.minimum(end - place, self.stops[np.searchsorted(self.stops, other)] - other)
            while (low < high).any():
                middle = (low + high + 1) // 2
                same = run_hash(sums, place, middle) == run_hash(self.sums, other, middle)
                low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
            return low

        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.order), np.int64)
        while (active := np.flatnonzero(lo < hi)).size:
            middle = (lo[active] + hi[active]) // 2
            other = self.order[middle].astype(np.int64)
            size = common(at[active], ends[active], other)
            after = words[at[active] + size] > self.words[other + size]
            lo[active[after]] = middle[after] + 1
            hi[active[~after]] = middle[~after]
        # The longest common beginning is with one of the two neighbours in the order.
        near = [self.order[np.clip(lo - k, 0, len(self.order) - 1)].astype(np.int64) for k in (1, 0)]
        sizes = [common(at, ends, other) for other in near]
        place = np.where(sizes[0] >= sizes[1], near[0], near[1])
        return np.maximum(*sizes), self.owners[np.searchsorted(self.stops, place)]


def suffix_order(words: np.ndarray, reach: int) -> np.ndarray:
    """Suffixes by their first ``reach`` words at least, by doubling."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    order, done = np.argsort(rank, kind="stable"), 1
    while done < reach and len(words) and rank.max() < len(words) - 1:
        later = np.concatenate([rank[done:], np.full(min(done, len(rank)), -1, np.int64)])
        order = np.lexsort((later, rank))
        new = np.ones(len(order), bool)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (later[order][1:] != later[order][:-1])
        rank[order] = np.cumsum(new) - 1
        done *= 2
    return order


def block_of(items: list[tuple[str, np.ndarray]]) -> Block:
    ids = sorted({i for i, _ in items})
    number = {i: k for k, i in enumerate(ids)}
    firsts: dict[int, list[np.ndarray]] = {}
    owners: dict[int, list[np.ndarray]] = {}
    at = 0
    for name, words in items:
        size = min(WINDOW, len(words))
        starts = np.arange(at, at + len(words) - size + 1)
        firsts.setdefault(size, []).append(starts)
        owners.setdefault(size, []).append(np.full(len(starts), number[name]))
        at += len(words) + 1
    words = np.zeros(at, np.uint64)
    for start, (_, own) in zip(np.cumsum([0] + [len(w) + 1 for _, w in items]), items):
        words[start : start + len(own)] = own
    sums = prefix_sums(words)
    windows = {}
    for size in firsts:
        starts = np.concatenate(firsts[size])
        windows[size] = windows_of(run_hash(sums, starts, np.int64(size)), starts, np.concatenate(owners[size]))
    reach = max((len(w) for _, w in items), default=0) + 1
    return Block(words, suffix_order(words, reach).astype(np.int32), windows, np.array([number[i] for i, _ in items], np.int64), ids)


def packed(words: np.ndarray) -> np.ndarray:
    """For each place, the codes of its four words in one number; none after the end."""
    code = np.concatenate([words >> np.uint64(48), np.zeros(3, np.uint64)])
    n = len(words)
    return code[:n] << np.uint64(48) | code[1 : n + 1] << np.uint64(32) | code[2 : n + 2] << np.uint64(16) | code[3 : n + 3]


class SuffixArray:
    """Suffixes of a word sequence in the order of the codes of their first 16 words."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.keys = np.concatenate([packed(words), np.zeros(16, np.uint64)])
        n = len(words)
        order = np.argsort(self.keys[:n], kind="stable")
        group = self._groups(self.keys[order], np.zeros(n, np.int64), np.arange(n))
        for depth in (4, 8, 12):
            tied = np.zeros(n, bool)
            same = group[1:] == group[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            at = np.flatnonzero(tied)
            if not len(at):
                break
            key = self.keys[order[at] + depth]
            inner = np.lexsort((key, group[at]))
            order[at] = order[at][inner]
            group[at] = self._groups(key[inner], group[at], at)
        self.order = order

    @staticmethod
    def _groups(key: np.ndarray, above: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each run of equal keys within one group above, the place of its first member."""
        if not len(key):
            return np.zeros(0, np.int64)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (above[1:] != above[:-1])])
        return at[new][np.cumsum(new) - 1]

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, key: np.ndarray, right: bool) -> np.ndarray:
        """Binary search of each key in its own range of the array."""
        lo, hi = lo.copy(), hi.copy()
        while (active := np.flatnonzero(lo < hi)).size:
            mid = (lo[active] + hi[active]) // 2
            there = self.keys[self.order[mid] + depth]
            below = there <= key[active] if right else there < key[active]
            lo[active[below]] = mid[below] + 1
            hi[active[~below]] = mid[~below]
        return lo

    def ranges(self, query: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the suffixes stand that begin with each row of ``query`` (size words)."""
        lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(self.order), np.int64)
        for depth in range(0, size, 4):
            own = min(4, size - depth)
            key = np.zeros(len(query), np.uint64)
            for k in range(own):
                key |= (query[:, depth + k] >> np.uint64(48)) << np.uint64(48 - 16 * k)
            top = key | np.uint64((1 << (64 - 16 * own)) - 1)
            lo, hi = self._bound(lo, hi, depth, key, False), self._bound(lo, hi, depth, top, True)
        return lo, hi

    def places(self, query: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of query, place) of every verbatim occurrence."""
        lo, hi = self.ranges(query, size)
        found = hi - lo
        rows = np.repeat(np.arange(len(query)), found)
        at = self.order[np.repeat(lo - np.concatenate([[0], np.cumsum(found)[:-1]]), found) + np.arange(found.sum())]
        same = at + size <= len(self.words)
        rows, at = rows[same], at[same]
        for k in range(size):
            same = self.words[at + k] == query[rows, k]
            rows, at = rows[same], at[same]
        return rows, at


def shard_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and where each text begins.

    A stop of value 0 follows each text, which no item holds, so that no match
    runs from one text into the next.
    """
    data = [encode(t) for t in texts]
    bounds = np.cumsum([len(d) + 1 for d in data])
    joined = LOWER[np.frombuffer(b"\n".join(data) + b"\n", np.uint8)]
    starts, hashes = words_of(joined)
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, bounds)]))
    begin = np.concatenate([[0], np.cumsum(counts + 1)])
    words = np.zeros(begin[-1], np.uint64)
    words[np.arange(len(hashes)) + np.repeat(np.arange(len(texts)), counts)] = np.maximum(hashes, np.uint64(1))
    return words, begin


def search(words: np.ndarray, begin: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches as rows (text, first word in text, words, item), the items of each text as rows (text, item), and its word count."""
    array = SuffixArray(words)
    matches, items = [np.zeros((0, 4), np.int64)], [np.zeros((0, 2), np.int64)]
    for size, own in block.windows.items():
        parts = []
        for low in range(0, len(own.firsts), QUERIES):
            query = block.words[own.firsts[low : low + QUERIES, None] + np.arange(size)]
            rows, at = array.places(query, size)
            parts.append((rows + low, at))
        which, at = (np.concatenate(p) for p in zip(*parts))
        if not len(at):
            continue
        # Windows are distinct, so each place stands here once.
        order = np.argsort(at)
        which, at = which[order], at[order]
        text = np.searchsorted(begin, at, "right") - 1
        held = np.unique(np.stack([text, own.group[which]], 1), axis=0)
        count = (own.bounds[1:] - own.bounds[:-1])[held[:, 1]]
        items.append(np.stack([np.repeat(held[:, 0], count), own.members[spread(own.bounds[held[:, 1]], count)]], 1))
        if size == WINDOW:
            length, item = block.longest(words, begin[text + 1] - 1, at)
        else:
            length, item = np.full(len(at), size), own.members[own.bounds[own.group[which]]]
        stop = at + length
        kept = np.ones(len(at), bool)
        kept[1:] = stop[1:] > np.maximum.accumulate(stop)[:-1]
        matches.append(np.stack([text, at - begin[text], length, item], 1)[kept])
    found = np.concatenate(matches)
    return found[np.lexsort(found.T[::-1])], np.unique(np.concatenate(items), axis=0), np.diff(begin) - 1


MATCH = pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("n_words", pa.int64())])


def _searched(shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block: Block = shared.value

    names = np.array(block.ids, object)

    def flush(ids: list, texts: list[str], kind: pa.DataType) -> pa.RecordBatch:
        matches, items, n_words = search(*shard_words(texts), block)

        def lists(rows: np.ndarray, values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[:, 0], np.arange(len(texts) + 1)), pa.int32()), values)

        named = pa.StructArray.from_arrays([pa.array(names[matches[:, 3]], pa.string()), pa.array(matches[:, 1]), pa.array(matches[:, 2])], fields=list(MATCH))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), pa.array(n_words, pa.int64()), lists(matches, named), lists(items, pa.array(names[items[:, 1]], pa.string()))],
            ["doc_id", "n_words", "matches", "items"],
        )

    ids: list = []
    texts: list[str] = []
    size, kind = 0, pa.int64()
    for batch in (part for whole in batches for part in sized_slices(whole)):
        kind = batch.schema.field("doc_id").type
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= SHARD_BYTES:
                yield flush(ids, texts, kind)
                ids, texts, size = [], [], 0
    if ids:
        yield flush(ids, texts, kind)


def blocks(items: DataFrame, most: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of at most ``most`` words (a longer item is a block alone)."""
    own: list[tuple[str, np.ndarray]] = []
    size = 0
    for row in pick(items, item_id="item_id", text="text").where("item_id is not null and text is not null").toLocalIterator():
        words = np.maximum(words_of(LOWER[np.frombuffer(encode(row.text), np.uint8)])[1], np.uint64(1))
        if not len(words):
            continue
        if own and size + len(words) > most:
            yield block_of(own)
            own, size = [], 0
        own.append((str(row.item_id), words))
        size += len(words)
    yield block_of(own)


def matches(docs: DataFrame, items: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, matches, items) per row.

    ``matches`` holds the longest verbatim match of every place that a window
    meets, with one item that holds it; matches inside a longer one are left
    out. ``items`` holds all items with a window in the text.

    With one block, the usual case, rows are not shuffled. Of further blocks the
    executors hold one at a time and the driver two: a block's results are
    stored, by the number of the row, before the next one is sent. Later passes store only rows with matches.
    """
    rows = pick(docs, doc_id="doc_id", text="text")
    context = docs.sparkSession.sparkContext
    source = blocks(items, most)
    block, following = next(source), next(source, None)
    if following is None:
        return searched(rows, context.broadcast(block))
    keyed = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    texts = keyed.select(F.col("row").alias("doc_id"), "text")
    passes: list[DataFrame] = []
    while block is not None:
        sent = context.broadcast(block)
        found = searched(texts, sent)
        passes.append(stored(found.where(F.size("items") > 0) if passes else found))
        sent.destroy()
        block, following = following, next(source, None)
    united = reduce(DataFrame.unionByName, passes).groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    return keyed.select("doc_id", "row").join(united.withColumnRenamed("doc_id", "row"), "row").drop("row")


def searched(rows: DataFrame, block: Broadcast) -> DataFrame:
    match = T.StructType().add("item_id", "string").add("start", "long").add("n_words", "long")
    schema = rows.select("doc_id").schema.add("n_words", "long").add("matches", T.ArrayType(match)).add("items", T.ArrayType(T.StringType()))
    return mapped(rows, lambda batches: _searched(block, batches), schema)


def hit_words(spans: Column) -> Column:
    """How many words lie in at least one of the matches, by one fold over their sorted spans."""
    ordered = F.array_sort(F.transform(spans, lambda m: F.struct(m.start.alias("start"), (m.start + m.n_words).alias("stop"))))
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("reached"))

    def step(acc: Column, span: Column) -> Column:
        more = F.greatest(span.stop - F.greatest(span.start, acc.reached), F.lit(0).cast("long"))
        return F.struct((acc.total + more).alias("total"), F.greatest(acc.reached, span.stop).alias("reached"))

    return F.aggregate(ordered, zero, step, lambda acc: acc.total)


def judged(found: DataFrame, share: int = SHARE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated, longest) from matches."""
    rows = found.select("doc_id", "n_words", "matches", "items", hit_words(F.col("matches")).alias("n_hit"))
    items = F.array_sort("items")
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m.n_words)), F.lit(0))
    bad = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), items.alias("items"), bad.alias("contaminated"), longest.alias("longest")
    )


def contamination(docs: DataFrame, items: DataFrame, share: int = SHARE) -> DataFrame:
    """The query's rows: digests of what each document shares with the benchmark."""
    return judged(matches(docs, items), share).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "longest"
    )


def clean_rows(docs: DataFrame, items: DataFrame, share: int = SHARE) -> DataFrame:
    """The rows, all columns, of documents that are not contaminated."""
    found = judged(matches(with_rows(docs), items), share)
    return found.where(~F.col("contaminated")).select("doc_id.*")
