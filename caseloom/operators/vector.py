"""Vector points and exact cosine search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom import vocab
from caseloom.defaults import DEFAULTS
from caseloom.operators.filters import FILTERS, active_filters, set_filter
from caseloom.operators.matching import top_per
from caseloom.session import cut_lineage

#: Bytes of question vectors that one scan takes, and of the products that one step of a task holds.
BLOCK_BYTES = 64 << 20
TILE_BYTES = 32 << 20
#: Questions of one product at most, and coordinates where any of them may have a value, if none has more by itself.
#: Few that look alike have values at few coordinates, and only these are multiplied.
TILE_QUESTIONS = 64
TILE_PLACES = 16
#: Tasks of a scan for each core. Each sends the best hits of every question, so their number must not grow with the points.
CORE_TASKS = 2
#: Hits that a task gathers before it cuts them, and projects that are named to the scan at most.
GATHERED = 500_000
#: Of so many pairs one that is near its bound makes it cheaper to work all out in full.
MANY = 64
#: Hits of one batch that a task sends.
SENT_HITS = 100_000
#: Unrounded scores this far below a bound can still round up to it.
SLACK = 1e-6
SENT_PROJECTS = 1_000


def vector_points(chunks: DataFrame, version: str = DEFAULTS.index_version) -> DataFrame:
    """Points with the bounded keyword payload and never the text."""
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    text = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    payload = {
        "project_id": F.col("project_id"),
        "source_id": text(F.col("source_id")),
        "document_id": F.col("document_id"),
        "source_type": F.coalesce(meta("source_type"), F.lit("unknown_text")),
        "chunk_type": F.coalesce("chunk_type", F.lit("unknown")),
        "path": text(F.col("path"), meta("document_path")),
        "language": text(meta("language")),
        "symbol_name": text(meta("symbol_name"), meta("function_name")),
        "package_name": text(meta("package_name"), meta("module_path")),
        "service_name": text(F.col("service_name")),
        "endpoint": text(F.col("endpoint")),
        "commit_sha": text(meta("commit_sha")),
        "deploy_hash": text(F.col("deploy_hash")),
        "content_hash": text(meta("content_hash")),
        "index_version": F.lit(version),
    }
    return chunks.select(
        F.col("chunk_id").alias("id"), "vector", *[c.alias(n) for n, c in payload.items()]
    )


#: Columns of stored points; the last two are their partitions.
POINTS = "id string, vector array<double>, " + ", ".join(
    f"{c} string" for c in (*(f for f in vocab.VECTOR_FILTER_FIELDS if f not in ("project_id", "index_version")), "project_id", "index_version")
)


def write_points(points: DataFrame, path: str) -> None:
    """Publish points; searches of one project and version read one folder."""
    points.write.mode("append").partitionBy("project_id", "index_version").parquet(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Published points, under the name that hits carry their id in."""
    return spark.read.schema(POINTS).parquet(path).withColumnRenamed("id", "chunk_id")


def delete_points(points: DataFrame, **filters: str) -> DataFrame:
    """Points that remain after deleting those equal to every filter."""
    unknown = sorted(set(filters) - set(vocab.VECTOR_FILTER_FIELDS))
    if unknown:
        raise ValueError(f"unsupported filter field: {', '.join(unknown)}")
    hit = F.lit(True)
    for field, value in filters.items():
        hit = hit & F.col(field).eqNullSafe(F.lit(value))
    return points.where(~hit)


def filter_points(points: DataFrame, project_id: str, version: str = DEFAULTS.index_version,
                  **filters: str) -> DataFrame:
    """Keyword pre-filter of a search: project and version always, others if set."""
    kept = points.where((F.col("project_id") == project_id) & (F.col("index_version") == version))
    for field, value in filters.items():
        if field in vocab.VECTOR_FILTER_FIELDS and value is not None:
            kept = kept.where(F.col(field) == value)
    return kept


_HITS = "question_id string, project_id string, chunk_id string, score double, fetch_k int"


@dataclass
class Group:
    """Questions of a block that ask the same rows: those of a project that equal all of some values."""

    wanted: tuple[tuple[int, str], ...]  # (place of the tested column, value)
    numbers: np.ndarray
    matrix: np.ndarray
    most: int

    def __post_init__(self) -> None:
        """Order the questions by where their values are not zero, the most common places first, and cut them where they cease to share places."""
        held = self.matrix != 0
        marks = np.packbits(held[:, np.argsort(-held.sum(axis=0), kind="stable")], axis=1)
        order = np.lexsort(marks.T[::-1])
        self.numbers, self.matrix, held = self.numbers[order], self.matrix[order], held[order]
        widest = np.maximum(held.sum(axis=1), TILE_PLACES)
        self.cuts, union, most = [0], held[:1].any(axis=0), 0
        for at in range(len(order)):
            both, most = union | held[at], max(most, widest[at])
            if at - self.cuts[-1] >= TILE_QUESTIONS or both.sum() > most:
                self.cuts.append(at)
                both, most = held[at], widest[at]
            union = both
        self.cuts.append(len(order))
        self.places = [np.flatnonzero(held[at:to].any(axis=0)) for at, to in zip(self.cuts, self.cuts[1:])]

    def tiles(self, dense: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers, scores) of a few questions at a time with all rows. Coordinates where these questions are zero add nothing."""
        for own, places, scores in self.products(np.ascontiguousarray(dense.T)):
            yield self.numbers[own], scores

    def products(self, part: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(questions, their coordinates, scores) of a few questions at a time with all columns of ``part``, as exact as its numbers."""
        matrix = self.matrix.astype(part.dtype, copy=False)
        step = max(1, TILE_BYTES // (part.itemsize * max(part.shape[1], 1)))
        for places, first, end in zip(self.places, self.cuts, self.cuts[1:]):
            held = part[places]
            for at in range(first, end, step):
                own = slice(at, min(at + step, end))
                yield own, places, matrix[own, places] @ held


@dataclass
class Block:
    questions: list[str]
    budgets: np.ndarray
    groups: dict[str, list[Group]]  # by project


def _block_of(rows: pa.Table, columns: list[str]) -> Block:
    """Group the rows (question_id, project_id, vector, fetch_k, one column per test) of one block.

    A question may stand in several rows, as with cells to probe; it has one
    number and one list of best hits.
    """
    projects, questions, budgets = (rows.column(c).to_pylist() for c in ("project_id", "question_id", "fetch_k"))
    number = {q: k for k, q in enumerate(dict.fromkeys(questions))}
    tests = [rows.column(c).to_pylist() for c in columns]
    members: dict[tuple, list[int]] = {}
    for r, project in enumerate(projects):
        wanted = tuple((k, values[r]) for k, values in enumerate(tests) if values[r] is not None)
        members.setdefault((project, wanted), []).append(r)
    vectors = rows.column("vector").combine_chunks()
    matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(projects), -1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = matrix / np.where(norms == 0, 1.0, norms)
    groups: dict[str, list[Group]] = {}
    for (project, wanted), own in members.items():
        groups.setdefault(project, []).append(
            Group(wanted, np.array([number[questions[r]] for r in own]), matrix[own], max(budgets[r] for r in own))
        )
    held = np.zeros(len(number), np.int64)
    for q, k in zip(questions, budgets, strict=True):
        held[number[q]] = k
    return Block(list(number), held, groups)


class Best:
    """The best hits of each question so far. Hits are gathered and sorted many at a time.

    Hits hold the number of a row and their score in millionths, and names are
    compared by their place in order, so that a sort is one of whole numbers and
    no text is copied for every hit. The bound of a question is the score and
    the name of its last hit: a row with that score is taken only if its name
    comes first, since whole tables can tie.
    """

    def __init__(self, budgets: np.ndarray) -> None:
        self.budgets, self.bound, self.parts, self.held = budgets, np.full(len(budgets), -np.inf), [], 0
        self.names, self.used, self.last = np.zeros(0, object), 0, np.full(len(budgets), "", object)

    def rows(self, names: np.ndarray) -> np.ndarray:
        """Numbers for the rows of a batch, valid until the next. Names that no hit holds go when there are many."""
        if len(self.names) > max(GATHERED, 2 * self.used):
            self.cut()
            used = np.unique(np.concatenate([row for _, _, row in self.parts])) if self.parts else np.zeros(0, np.int32)
            self.parts = [(q, mark, np.searchsorted(used, row).astype(np.int32)) for q, mark, row in self.parts]
            self.names, self.used = self.names[used], len(used)
        self.first = len(self.names)
        self.names = np.concatenate([self.names, names])
        self.ordered = None
        return np.arange(self.first, len(self.names))

    def _sort_names(self) -> None:
        """Places of the names of this batch in their order, worked out when first needed."""
        if self.ordered is None:
            names = self.names[self.first :]
            order = np.argsort(names, kind="stable")
            self.ordered, self.place = names[order], np.empty(len(names), np.int32)
            self.place[order] = np.arange(len(names), dtype=np.int32)

    def _preceding(self, numbers: np.ndarray) -> np.ndarray:
        """How many names of this batch come before those of the last hits."""
        self._sort_names()
        return np.where(np.isneginf(self.bound[numbers]), len(self.ordered), np.searchsorted(self.ordered, self.last[numbers])).astype(np.int32)

    def add(self, numbers: np.ndarray, scores: np.ndarray, rows: np.ndarray, most: int,
            exact: Callable[[np.ndarray | None, np.ndarray | None], np.ndarray] | None = None, slack: float = SLACK) -> None:
        """A tile of scores (questions x rows), of which what can still be among the best is kept.

        Scores come unrounded; only those that may reach the bound are rounded.
        Where they are off by up to ``slack``, ``exact`` gives those of single pairs,
        or of all where many are near the bound. Of these, which may all tie with it,
        only rows whose names come first are looked at.
        """
        least = self.bound[numbers]
        fresh = np.isneginf(least)
        if scores.shape[1] > most and fresh.any():
            least[fresh] = np.partition(scores[fresh], -most, axis=1)[:, -most] - slack
        near = scores >= (least - slack).astype(scores.dtype)[:, None]
        count = np.count_nonzero(near)
        if not count:
            return
        if count * MANY > scores.size and not fresh.all():
            if exact is not None:
                return self.add(numbers, exact(None, None), rows, most)
            before = self._preceding(numbers)
            near &= (self.place[rows - self.first] < before[:, None]) | (scores >= np.where(fresh, -np.inf, least + 0.4e-6)[:, None])
        q, row = np.divmod(np.flatnonzero(near), scores.shape[1])
        mark = np.rint((scores[q, row] if exact is None else exact(q, row)) * 1e6)
        score, bound = mark / 1e6, least[q]
        kept = score > bound
        tied = np.flatnonzero(score == bound)
        if len(tied):
            kept[tied] = self._preceding(numbers)[q[tied]] > self.place[rows[row[tied]] - self.first]
        self.parts.append((numbers[q[kept]].astype(np.int32), mark[kept].astype(np.int32), rows[row[kept]].astype(np.int32)))
        self.held += int(kept.sum())
        # What is kept anyway must not lead to a sort for every tile.
        if self.held > max(GATHERED, int(self.budgets.sum()) // 2):
            self.cut()

    def _sorted(self, q: np.ndarray, mark: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hits by question, best first, ties by name. One number holds all three where they fit."""
        by_name = pc.array_sort_indices(pa.array(self.names, pa.large_string())).to_numpy().astype(np.int64)
        rank = np.empty(len(by_name), np.int64)
        rank[by_name] = np.arange(len(by_name))
        high = int(mark.max())
        span, width = (high - int(mark.min())).bit_length(), len(by_name).bit_length()
        if len(self.budgets).bit_length() + span + width > 63:
            order = np.lexsort((rank[row], -mark, q))
            return q[order], mark[order], row[order]
        key = np.sort(((q.astype(np.int64) << span | high - mark.astype(np.int64)) << width) | rank[row])
        upper = key >> width
        return upper >> span, high - (upper & (1 << span) - 1), by_name[key & (1 << width) - 1]

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, score, name) of the best hits, ties by name; what is left is the bound for more."""
        q, mark, row = (np.concatenate([p[k] for p in self.parts]) if self.parts else np.zeros(0, np.int32) for k in range(3))
        if not len(q):
            return np.zeros(0, np.int64), np.zeros(0), self.names[:0]
        q, mark, row = self._sorted(q, mark, row)
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        kept = place < self.budgets[q]
        full = place == self.budgets[q] - 1
        self.bound[q[full]], self.last[q[full]] = mark[full] / 1e6, self.names[row[full]]
        q, mark, row = q[kept], mark[kept], row[kept]
        self.parts, self.held = [(q.astype(np.int32), mark.astype(np.int32), row.astype(np.int32))], 0
        return q, mark / 1e6, self.names[row]


def _tiles(batch: pa.RecordBatch, block: Block, tests: int, best: Best) -> None:
    names = np.asarray(batch.column(1).to_pylist(), dtype=object)
    numbers = best.rows(names)
    column = batch.column(2)
    dense = column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False).reshape(len(names), -1)
    norms = np.sqrt(np.einsum("ij,ij->i", dense, dense))
    norms[norms == 0] = 1.0
    # Rows by value of the project and each tested column. A group takes the rows of its rarest value and tests the others on these.
    values_of, rows_of = [], []
    for k in (0, *range(3, 3 + tests)):
        held = batch.column(k).dictionary_encode()
        code = held.indices.fill_null(-1).to_numpy()
        order = np.argsort(code, kind="stable")
        values = [*held.dictionary.to_pylist(), None]
        ends = np.searchsorted(code[order], np.arange(-1, len(values)))
        rows = {value: order[ends[v + 1] : ends[v + 2]] for v, value in enumerate(values[:-1])}
        values_of.append((code, {value: v for v, value in enumerate(values[:-1])}))
        rows_of.append(rows)
    for project in rows_of[0].keys() & block.groups.keys():
        for group in block.groups[project]:
            wanted = [(0, project), *((k + 1, value) for k, value in group.wanted)]
            if not all(value in rows_of[k] for k, value in wanted):
                continue
            rows = min((rows_of[k][value] for k, value in wanted), key=len)
            if len(wanted) > 1:
                for k, value in wanted:
                    code, code_of = values_of[k]
                    rows = rows[code[rows] == code_of[value]]
            if not len(rows):
                continue
            # Single precision tells which pairs may be hits, and only the scores of these are worked out in full.
            full = np.ascontiguousarray((dense[rows] / norms[rows, None]).T)
            for own, places, scores in group.products(full.astype("float32")):
                def exact(q: np.ndarray | None, row: np.ndarray | None, own: slice = own, places: np.ndarray = places) -> np.ndarray:
                    asked, held = group.matrix[own, places], full[places]  # noqa: B023
                    return asked @ held if q is None else np.einsum("ij,ji->i", asked[q], held[:, row])

                # Rounding of both factors and of each step of the sum, twice over.
                best.add(group.numbers[own], scores, numbers[rows], group.most, exact, SLACK + (len(places) + 8) * 2.0**-23)


def _search_block(questions: DataFrame, points: DataFrame, tests: dict[str, str]) -> tuple[DataFrame, Broadcast]:
    """Score one block of questions against the points of their projects that pass their tests."""
    spark = points.sparkSession
    names = list(tests)
    columns = [F.nullif(F.col(q).cast("string"), F.lit("")).alias(q) for q in names]
    block = _block_of(questions.select("project_id", "question_id", "vector", "fetch_k", *columns).toArrow(), names)
    shared = spark.sparkContext.broadcast(block)
    tested = [F.col(c).cast("string").alias(f"_t{k}") for k, c in enumerate(tests.values())]

    many = len(tested)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = Best(block.budgets)
        for batch in batches:
            if batch.num_rows:
                _tiles(batch, block, many, best)
        project_of = np.full(len(block.questions), None, object)
        for project, groups in block.groups.items():
            for group in groups:
                project_of[group.numbers] = project
        hits = best.cut()
        for at in range(0, len(hits[0]), SENT_HITS):
            q, score, name = (x[at : at + SENT_HITS] for x in hits)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.questions, pa.string()).take(pa.array(q)), pa.array(project_of, pa.string()).take(pa.array(q)),
                    pa.array(name, pa.string()), pa.array(score), pa.array(block.budgets[q].astype(np.int32)),
                ],
                names=["question_id", "project_id", "chunk_id", "score", "fetch_k"],
            )

    few = points.select("project_id", "chunk_id", "vector", *tested).coalesce(CORE_TASKS * spark.sparkContext.defaultParallelism)
    return few.mapInArrow(score, _HITS), shared


def asked_partitions(points: DataFrame, questions: DataFrame, version: str) -> DataFrame:
    """Only the points of the version and, while they are few enough to be named, of the projects that are asked.

    Both are partitions of stored points, so nothing else is read.
    """
    if "index_version" in points.columns:
        points = points.where(F.col("index_version") == version)
    asked = [r.project_id for r in questions.select("project_id").distinct().limit(SENT_PROJECTS + 1).collect()]
    return points.where(F.col("project_id").isin(asked)) if len(asked) <= SENT_PROJECTS else points


def vector_search(questions: DataFrame, vectors: DataFrame, dim: int = DEFAULTS.embedding_dim,
                  block_bytes: int = BLOCK_BYTES, most: int | None = None, version: str = DEFAULTS.index_version,
                  tests: dict[str, str] | None = None) -> DataFrame:
    """Exact cosine top-k per question among the points of its project that pass its filters.

    A question's filter is tested inside the scan, before anything is cut, on
    the payload that points carry; ``tests`` names further pairs of a question's
    and a point's column that must be equal. The vectors stay where they are:
    each task multiplies its Arrow batches with a block of questions and keeps
    the best per question, so a task sends at most ``fetch_k`` rows per question
    to the final cut. Questions with the same vector, project, filters and
    budget are one search. Searches beyond one block of a bounded size are run
    block after block: each is a scan, its hits are written, and neither driver
    nor executors hold two blocks. No pair is written out; a project with most
    of the vectors is just more scan tasks.
    """
    # What further pairs test may differ between the rows of one question, which then stay together.
    own = bool(tests)
    same = F.col("question_id") if own else F.sha2(
        F.to_json(F.struct("project_id", "fetch_k", "vector", *(set_filter(q).alias(q) for q in active_filters(questions)))), 256)
    tests = {**{q: FILTERS[q] for q in active_filters(questions)}, **(tests or {})}
    lacking = sorted(set(tests.values()) - set(vectors.columns))
    if lacking:
        raise ValueError(f"points without the payload that filters test: {', '.join(lacking)}")
    asked = cut_lineage(questions.select("question_id", "project_id", "vector", "fetch_k", *tests, same.alias("same")))
    searches = asked if own else asked.drop("question_id").dropDuplicates(["same"]).withColumn("question_id", F.monotonically_increasing_id().cast("string"))
    # Numbers of searches, which every hit carries, are fixed by writing them.
    searches = cut_lineage(searches)
    owners = asked.select("same", "question_id").distinct().join(searches.select("same", F.col("question_id").alias("search")), "same").drop("same")
    points = asked_partitions(vectors, searches, version)
    blocks = max(1, math.ceil(searches.count() * dim * 8 / block_bytes))
    if blocks == 1:
        hits = _search_block(searches, points, tests)[0]
    else:
        parts = []
        for b in range(blocks):
            found, shared = _search_block(searches.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b), points, tests)
            parts.append(cut_lineage(found))
            shared.destroy()
        hits = reduce(DataFrame.unionByName, parts)
    order = [F.desc("score"), F.asc("chunk_id")]
    best = top_per(hits, ["question_id"], order, F.col("fetch_k"), most=most)
    if own:
        return best
    found = owners.join(best.drop("rank").withColumnRenamed("question_id", "search"), "search").drop("search")
    return top_per(found, ["question_id"], order, F.col("fetch_k"), most=most)


def reconcile(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits whose chunk exists in their project, in hit order."""
    return hits.join(
        chunks.select("project_id", "chunk_id", "path", "chunk_type"), ["project_id", "chunk_id"]
    )
