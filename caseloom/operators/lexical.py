"""Lexical retrieval: stemmed AND queries ranked by cover density.

The ranking follows Clarke, Cormack and Tudhope's cover density: the shorter
the spans of a text that hold every query term, the higher the score. The
tokenizer, stop list and suffix stemmer below are this library's own; only the
order of the results matters to what follows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.patterns import as_col, let
from caseloom.operators.filters import FILTERS, PAYLOAD, active_filters, passes, sent
from caseloom.operators.matching import top_per
from caseloom.session import cut_lineage

STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "did", "do", "does", "for", "from", "had",
    "has", "have", "how", "in", "is", "it", "its", "of", "on", "or", "that", "the", "their",
    "this", "to", "was", "were", "what", "when", "where", "which", "who", "why", "will", "with",
)
SUFFIXES = "ing|edly|ed|ies|es|s|ly"
TOKEN = r"[\p{L}\p{N}]"


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits in text order."""
    return F.regexp_extract_all(F.lower(as_col(text)), F.lit(rf"({TOKEN}+)"), F.lit(1))


def positions(text: Column | str) -> Column:
    """Stems in text order; stop words leave an empty place."""
    stemmed = F.regexp_replace(
        F.lower(as_col(text)),
        rf"(?<!{TOKEN})({TOKEN}{{3,}}?)(?:{SUFFIXES})(?!{TOKEN})",
        "$1",
    )
    tokens = F.regexp_extract_all(stemmed, F.lit(rf"({TOKEN}+)"), F.lit(1))
    return F.transform(tokens, lambda t: F.when(t.isin(*_STOP_STEMS), "").otherwise(t))


_ENDING = re.compile(rf"^(.{{3,}}?)(?:{SUFFIXES})$")


@lru_cache(maxsize=1 << 18)
def _stem(word: str) -> str:
    return _ENDING.sub(r"\1", word)


_STOP_STEMS = tuple(dict.fromkeys(_stem(w) for w in STOPWORDS))
_STOPS = frozenset(_STOP_STEMS)


def terms(text: Column | str) -> Column:
    return F.array_remove(F.array_distinct(positions(text)), "")


#: Rows of terms and of candidates that are sent to the scan of the index at most.
SENT_TERMS = 100_000
SENT_CANDIDATES = 500_000
#: Parts of a source's postings by term. A search reads those of its terms.
BUCKETS = 16

INDEX_COLUMNS = ("source_id", "bucket", "project_id", "term", "chunk_id", "places", *PAYLOAD)
INDEX_SCHEMA = (
    "project_id string, term string, chunk_id string, places array<int>, "
    + ", ".join(f"{c} string" for c in PAYLOAD) + ", source_id string, bucket int"
)


def bucket_of(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(as_col(term)), F.lit(BUCKETS)).cast("int")


_TERM_PLACES = T.ArrayType(T.StructType().add("term", "string").add("places", T.ArrayType(T.IntegerType())))


def _grouped(line: pa.ListArray, words: pa.Array, word: np.ndarray) -> pa.Array:
    """Array of (term, places) per row of ``line``, whose items are ``word``, numbers in ``words``. A whole batch is sorted at once."""
    rows = pc.list_parent_indices(line).to_numpy()
    first = np.searchsorted(rows, np.arange(len(line) + 1))
    at = (np.arange(len(rows)) - first[rows] + 1).astype(np.int32)
    key = rows * max(len(words), 1) + word
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    places = pa.ListArray.from_arrays(pa.array(np.r_[start, len(key)].astype(np.int32)), pa.array(at[order]))
    found = pa.StructArray.from_arrays([words.take(pa.array(word[order[start]])), places], ["term", "places"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[order[start]], np.arange(len(line) + 1)).astype(np.int32)), found)


@F.arrow_udf(_TERM_PLACES)
def term_places(stems: pa.Array) -> pa.Array:
    """Array of (term, places): the places of each distinct stem."""
    line = stems.flatten().dictionary_encode()
    return _grouped(stems, line.dictionary, line.indices.to_numpy())


@F.arrow_udf(_TERM_PLACES)
def token_places(tokens: pa.Array) -> pa.Array:
    """The same from the tokens of a text; each distinct token of a batch is stemmed once."""
    line = tokens.flatten().dictionary_encode()
    stems = [_stem(w) for w in line.dictionary.to_pylist()]
    number = {s: k for k, s in enumerate(dict.fromkeys("" if s in _STOPS else s for s in stems))}
    of_token = np.array([number["" if s in _STOPS else s] for s in stems], np.int64)
    return _grouped(tokens, pa.array(list(number), pa.string()), of_token[line.indices.to_numpy()])


def lexical_index(chunks: DataFrame) -> DataFrame:
    """Postings: a row for each stem of each chunk, with its places and what filters test.

    Places of stop words stand under the empty term, which no search asks for,
    so that the index still tells the length of a text. A chunk without source
    belongs to the source of the empty name.
    """
    have = {"source_id": F.coalesce(F.col("source_id"), F.lit(""))} if "source_id" in chunks.columns else {"source_id": F.lit("")}
    payload = [(F.col(c) if c in chunks.columns else F.lit(None).cast("string")).alias(c) for c in PAYLOAD]
    rows = chunks.select(have["source_id"].alias("source_id"), "project_id", "chunk_id", *payload, F.explode(token_places(tokens("text"))).alias("t"))
    rows = rows.select("source_id", "project_id", "chunk_id", *PAYLOAD, F.col("t.term").alias("term"), F.col("t.places").alias("places"))
    return rows.withColumn("bucket", bucket_of("term")).select(*INDEX_COLUMNS)


def _written(index: DataFrame, path: str, mode: str) -> None:
    """Partitions of source and bucket. A bucket of hot terms is split over tasks, and so over files, by its size."""
    spread = index.hint("rebalance", "source_id", "bucket").sortWithinPartitions("source_id", "bucket")
    spread.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("source_id", "bucket").parquet(path)


def write_index(index: DataFrame, path: str) -> None:
    """Write a whole index to a new folder."""
    _written(index, path, "errorifexists")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The postings of a stored index. Rows that only mark a partition as written are left out."""
    return spark.read.schema(INDEX_SCHEMA).parquet(path).where("chunk_id is not null").select(*INDEX_COLUMNS)


def replace_source(path: str, source_id: str, chunks: DataFrame) -> None:
    """Write one source of a stored index anew from its chunks as they are now.

    Only the partitions of that source are replaced; no other file is read or
    written. Every bucket gets a row without chunk, so that buckets whose terms
    are all gone are replaced as well.
    """
    spark = chunks.sparkSession
    own = lexical_index(chunks.withColumn("source_id", F.lit(source_id)))
    none = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in INDEX_COLUMNS[2:]]
    marks = spark.range(BUCKETS).select(F.lit(source_id).alias("source_id"), F.col("id").cast("int").alias("bucket"), *none)
    _written(own.unionByName(marks), path, "overwrite")


def density(hits: Column, terms: Column) -> Column:
    """Sum of one over the length of every minimal span that holds all of ``terms`` terms.

    ``hits`` are places (at, term from 1) in text order. The last place of every
    term is carried, and a span is minimal where its start moves forward.
    """
    seed = F.struct(
        F.lit(0).alias("start"), F.lit(0.0).alias("score"),
        F.transform(F.sequence(F.lit(1), terms), lambda t: F.lit(0)).alias("last"),
    )

    def step(acc: Column, hit: Column) -> Column:
        last = F.transform(acc["last"], lambda p, i: F.when(i + 1 == hit["term"], hit["at"]).otherwise(p))
        start = F.array_min(last)
        new = start > acc["start"]
        return F.struct(
            F.when(new, start).otherwise(acc["start"]).alias("start"),
            F.when(new, acc["score"] + F.lit(1.0) / (hit["at"] - start + 1)).otherwise(acc["score"]).alias("score"),
            last.alias("last"),
        )

    return F.aggregate(hits, seed, step, lambda acc: acc["score"])


@F.arrow_udf(T.DoubleType())
def place_density(held: pa.Array, terms: pa.Array) -> pa.Array:
    """The same for a batch of arrays of (term from 0, its places), in which no place stands twice.

    The last place of a term is a running maximum over the batch, where every row
    begins above all places of the rows before it.
    """
    items = held.flatten()
    places = items.field("places")
    item = pc.list_parent_indices(places).to_numpy()
    row = pc.list_parent_indices(held).to_numpy()[item]
    at, term = places.flatten().to_numpy().astype(np.int64), items.field("term").to_numpy()[item]
    size = terms.to_numpy()
    width = int(at.max(initial=0)) + 1
    order = np.argsort(row * width + at, kind="stable")
    row, term = row[order], term[order]
    base = row * width
    end = base + at[order]
    start = np.full(len(end), np.iinfo(np.int64).max)
    for t in range(int(size.max(initial=0))):
        last = np.maximum.accumulate(np.where(term == t, end, -1))
        np.minimum(start, last, out=start, where=t < size[row])
    # Places count from 1, so that nothing of a row stands at its base: a term that is still to come.
    start = np.maximum(start, base)
    new = start > np.r_[base[:1], np.where(row[1:] == row[:-1], start[:-1], base[1:])]
    return pa.array(np.bincount(row[new], 1.0 / (end[new] - start[new] + 1), len(held)))


def cover_density(stems: Column | str, query: Column | str) -> Column:
    """Cover density of query terms in the stems of a text."""

    def score(wanted: Column) -> Column:
        places = F.filter(
            F.transform(
                as_col(stems), lambda s, i: F.struct((i + 1).alias("at"), F.array_position(wanted, s).cast("int").alias("term"))
            ),
            lambda hit: hit["term"] > 0,
        )
        return density(places, F.size(wanted))

    return let(as_col(query), score)


def lexical_search(questions: DataFrame, chunks: DataFrame, index: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Chunks that hold every term of a question and pass its filters, with their cover density.

    Questions with the same terms in the same project are one search. Only the
    buckets of asked terms are read, and of these only the asked terms. The
    rarest term of a search gives its candidates; the places of its other terms
    are then read for these only, and a search of one term needs no others. A
    frequent term therefore never drives a join unless a search has nothing
    rarer. Postings are made of the chunks where no stored index is given. With
    ``most``, the largest budget of any question, a search without filters is cut
    to it before its hits meet the questions.
    """
    index = lexical_index(chunks) if index is None else index
    active = active_filters(questions)
    asked = questions.select("question_id", "project_id", "fetch_k", F.array_sort(terms("question")).alias("wanted"), *active)
    asked = asked.where(F.size("wanted") > 0)
    # Numbers of searches are fixed by writing them.
    searches = cut_lineage(asked.select("project_id", "wanted").distinct().withColumn("search", F.monotonically_increasing_id()))
    long = searches.select("search", "project_id", "wanted", F.explode("wanted").alias("term"))
    needed = cut_lineage(long.select("project_id", "term", bucket_of("term").alias("bucket")).distinct())
    buckets = [r.bucket for r in needed.select("bucket").distinct().collect()]  # BUCKETS numbers at most
    tested = [FILTERS[q] for q in active]
    posted = index.where(F.col("bucket").isin(buckets))
    frequency = posted.join(sent(needed, SENT_TERMS), ["project_id", "term", "bucket"], "left_semi")
    frequency = frequency.groupBy("project_id", "term").agg(F.count("*").alias("df"))
    driver = (
        long.join(frequency, ["project_id", "term"])
        .groupBy("search", "project_id", "wanted")
        .agg(F.min(F.struct("df", "term")).alias("rarest"), F.count("*").alias("known"))
        .where(F.col("known") == F.size("wanted"))
        .select("search", "project_id", "wanted", F.col("rarest.term").alias("term"))
    )
    driver = cut_lineage(driver)
    one = F.size("wanted") == 1
    led = posted.join(sent(driver, SENT_TERMS), ["project_id", "term"]).select("search", "project_id", "chunk_id", "wanted", "term", "places", *tested)
    led = cut_lineage(led)
    # Every place of a single term is a span of its own.
    alone = led.where(one).select("search", "chunk_id", *tested, F.size("places").cast("double").alias("score"))
    # The places of the rarest term are at hand; those of the others are looked up.
    rest = F.explode(F.array_remove("wanted", F.col("term"))).alias("term")
    hits = led.where(~one)
    wanted = cut_lineage(hits.select("search", "project_id", "chunk_id", rest))
    others = cut_lineage(driver.where(~one).select("project_id", rest).distinct())
    looked = posted.join(sent(others, SENT_TERMS), ["project_id", "term"], "left_semi").select("project_id", "chunk_id", "term", "places", *tested)
    columns = ["search", "chunk_id", "term", "places", *tested]
    placed = looked.join(sent(wanted, SENT_CANDIDATES), ["project_id", "chunk_id", "term"]).select(*columns).unionByName(hits.select(*columns))
    whole = placed.groupBy("search", "chunk_id").agg(F.collect_list(F.struct("term", "places")).alias("held"), *[F.max(c).alias(c) for c in tested])
    several = whole.join(searches.select("search", "wanted"), "search").where(F.size("held") == F.size("wanted"))
    numbered = F.transform("held", lambda t: F.struct((F.array_position("wanted", t["term"]) - 1).cast("int").alias("term"), t["places"].alias("places")))
    several = several.select("search", "chunk_id", *tested, F.round(place_density(numbered, F.size("wanted")), 6).alias("score"))
    found = alone.unionByName(several)
    if most is not None and not active:
        found = top_per(found, ["search"], [F.desc("score"), F.asc("chunk_id")], most).drop("rank")
    owners = asked.join(searches, ["project_id", "wanted"]).select("search", "question_id", "project_id", "fetch_k", *active)
    return owners.join(found, "search").where(passes(active)).select("question_id", "project_id", "chunk_id", "fetch_k", "score")


def best(hits: DataFrame, most: int | None = None) -> DataFrame:
    """The hits of each question cut to its budget."""
    return top_per(hits, ["question_id"], [F.desc("score"), F.asc("chunk_id")], F.col("fetch_k"), most=most)
