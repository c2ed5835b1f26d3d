"""Exact metadata retrieval: owner, deploy, endpoint, symbol and path matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom import vocab
from caseloom.operators.filters import FILTERS, active_filters, passes, set_filter
from caseloom.operators.matching import contains_join, top_per
from caseloom.session import cut_lineage


def metadata_terms(questions: DataFrame) -> DataFrame:
    """The entities of each question in the form they are matched in."""
    lowered = lambda c: F.array_sort(F.array_distinct(F.transform(c, F.lower)))
    path_terms = F.filter(
        F.transform("query_terms", F.lower),
        lambda t: (F.length(t) >= 4) & ~t.isin(*vocab.METADATA_IGNORED_TERMS),
    )
    return questions.withColumns(
        {
            "m_services": lowered("services"),
            "m_hashes": lowered("deploy_hashes"),
            "m_endpoints": lowered("endpoints"),
            "m_terms": F.slice(F.array_sort(F.array_distinct(path_terms)), 1, 8),
        }
    )


def _symbols() -> Column:
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    listed = F.coalesce(
        F.try_element_at("metadata_lists", F.lit("symbol_names")),
        F.expr("cast(array() as array<string>)"),
    )
    single = F.array_compact(F.array(meta("symbol_name"), meta("symbol")))
    return F.array_distinct(F.transform(F.concat(single, listed), F.lower))


def _facts(chunks: DataFrame) -> DataFrame:
    meta = lambda k: F.lower(F.try_element_at("metadata", F.lit(k)))
    return chunks.select(
        "project_id", "chunk_id", "service_name", "deploy_hash", "endpoint", "chunk_type",
        F.lower("service_name").alias("c_service"),
        F.lower("deploy_hash").alias("c_hash"),
        F.lower("endpoint").alias("c_endpoint"),
        F.lower(F.coalesce("path", F.lit(""))).alias("c_path"),
        F.array_distinct(
            F.array_compact(F.array(meta("symbol_name"), meta("symbol")))
        ).alias("c_symbol"),
        _symbols().alias("c_symbols"),
    )


def _path_hits(asked: DataFrame, facts: DataFrame, names: str, value: str, size: int) -> DataFrame:
    """(project_id, value, _n): which wanted strings each distinct value contains."""
    wanted = asked.select("project_id", F.explode(names).alias("_n")).distinct()
    values = facts.select("project_id", value).where(F.col(value).isNotNull()).distinct()
    return contains_join(values, value, wanted, "_n", ["project_id"], size)


def in_list(names: str, value: str) -> Column:
    return F.coalesce(F.array_contains(F.col(names), F.col(value)), F.lit(False))


def _endpoint() -> Column:
    return F.coalesce(F.exists("m_endpoints", lambda n: F.contains(F.col("c_endpoint"), n)), F.lit(False))


def _matches() -> Column:
    """Whether any arm finds the pair. Listed symbols add to a score but find nothing."""
    path = F.exists("m_terms", lambda t: F.contains(F.col("c_path"), t))
    symbol = F.arrays_overlap("m_terms", "c_symbol")
    return in_list("m_services", "c_service") | in_list("m_hashes", "c_hash") | _endpoint() | F.coalesce(symbol, F.lit(False)) | path


def _score() -> Column:
    one = lambda cond, points: F.when(cond, points).otherwise(0.0)
    return (
        one(in_list("m_services", "c_service"), 4.0)
        + one(in_list("m_hashes", "c_hash"), 4.0)
        + one(_endpoint(), 5.0)
        + 3.0 * F.size(F.array_intersect("c_symbols", "m_terms"))
        + F.least(
            F.lit(2.0),
            F.size(F.filter("m_terms", lambda t: F.contains(F.col("c_path"), t))).cast("double"),
        )
    )


def _selective(asked: DataFrame, facts: DataFrame, active: list[str]) -> DataFrame:
    """Pairs that share a deploy hash or a symbol and pass the filters, each once, fully scored."""
    tested = [FILTERS[q] for q in active]
    ids = ["question_id", "project_id", "chunk_id"]

    def by_value(names: str, value: Column) -> DataFrame:
        left = asked.select("question_id", "project_id", *active, F.explode(names).alias("_v"))
        right = facts.select("project_id", "chunk_id", *tested, value.alias("_v"))
        return left.join(right, ["project_id", "_v"]).where(passes(active)).select(*ids)

    pairs = by_value("m_hashes", F.col("c_hash")).unionByName(by_value("m_terms", F.explode("c_symbols"))).distinct()
    found = pairs.join(asked.drop(*active), ["question_id", "project_id"]).join(facts, ["project_id", "chunk_id"])
    return found.where(_matches()).select(*ids, _score().alias("score"))


def _fitted(asked: DataFrame, facts: DataFrame, active: list[str]) -> tuple[DataFrame, DataFrame]:
    """Questions and chunks with ``fit``: the filters that are set, with their values, as one text.

    A chunk stands there once for every set of filters that some question of
    its project asks and the chunk passes, and once without any. Which filters
    are ever set together is a list of a few, so chunks meet asked values by
    equality alone.
    """
    if not active:
        return asked.withColumn("fit", F.lit("")), facts.withColumn("fit", F.lit(""))
    marks = [set_filter(q).isNotNull() for q in active]
    combos = sorted(tuple(r) for r in asked.select(*marks).distinct().collect())  # 2 ** len(active) rows at most

    def fit(columns: list[str], combo: tuple[bool, ...]) -> Column:
        # Values are quoted by their lengths, so that no two lists of values look alike.
        own = [F.concat(F.lit(f"{k}:"), F.length(c).cast("string"), F.lit(":"), F.col(c)) for k, (c, on) in enumerate(zip(columns, combo, strict=True)) if on]
        return F.concat(*own) if own else F.lit("")

    named = F.lit(None).cast("string")
    for combo in combos:
        same = reduce(lambda a, b: a & b, [mark if on else ~mark for mark, on in zip(marks, combo, strict=True)])
        named = F.when(same, fit(active, combo)).otherwise(named)
    asked = asked.withColumn("fit", named)
    options = F.array_compact(F.array(*(fit([FILTERS[q] for q in active], combo) for combo in combos)))
    offered = facts.withColumn("fit", F.explode(options))
    wanted = asked.select("project_id", "fit").distinct()
    return asked, offered.join(wanted, ["project_id", "fit"], "left_semi")


def _kinds(endpoints: Column, services: Column, terms: Column) -> Column:
    """Array of (endpoint, service, first, second): what a pair can match by, with empty names for what it does not."""
    blank = F.lit("")
    at = lambda k: F.get(terms, k)
    n = F.size(terms)
    two = F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(
        F.sequence(F.lit(0), i - 1), lambda j: F.struct(at(j).alias("first"), at(i).alias("second"))))))
    one = F.transform(terms, lambda t: F.struct(t.alias("first"), blank.alias("second")))
    paths = F.concat(F.array(F.struct(blank.alias("first"), blank.alias("second"))), one, F.coalesce(two, F.slice(one, 1, 0)))
    return F.flatten(F.transform(F.concat(F.array(blank), endpoints), lambda e: F.flatten(F.transform(
        F.concat(F.array(blank), services), lambda s: F.transform(paths, lambda t: F.struct(
            e.alias("endpoint"), s.alias("service"), t["first"].alias("first"), t["second"].alias("second")))))))


def _leading(asked: DataFrame, facts: DataFrame, most: int, active: list[str]) -> DataFrame:
    """Pairs that match by endpoint, service and path only, as far as a budget can reach.

    A kind holds the filters of a question as well, so its first ids are the
    first that pass them.

    Such chunks score by whether an endpoint fits, whether the service fits and
    whether none, one or several path terms do, and tie at chunk id. A kind of
    match is an endpoint, a service, a term or two, or some of these, and all
    chunks of a kind score at least as much. So no chunk after the first
    ``most`` ids of a kind can be among the results through it. These first ids
    are found once per kind, whichever questions ask for it. A kind is left out
    where one that scores more fills the budget of the question. Work grows
    with the chunks and the answers, not their product.
    """
    asked, facts = _fitted(asked, facts, active)
    keyed = ["project_id", "fit", "endpoint", "service", "first", "second"]
    kinds = F.explode(_kinds(F.col("m_endpoints"), F.col("m_services"), F.col("m_terms")))
    named = F.concat("endpoint", "service", "first") != ""
    wanted = cut_lineage(asked.select("question_id", "project_id", "fit", "fetch_k", kinds.alias("t")).select(
        "question_id", "fetch_k", "project_id", "fit", "t.*").where(named))

    def held(names: str, value: str, size: int) -> DataFrame:
        hits = _path_hits(asked, facts, names, value, size)
        return hits.groupBy("project_id", value).agg(F.sort_array(F.collect_set("_n")).alias(f"held_{value}"))

    # Most chunks have no endpoint; a key of their own keeps them from meeting in one task.
    lone = F.concat(F.lit("\0"), "chunk_id")
    placed = facts.select("project_id", "fit", "chunk_id", "c_path", "c_service", F.coalesce("c_endpoint", lone).alias("c_endpoint"))
    placed = placed.join(held("m_terms", "c_path", 4), ["project_id", "c_path"], "left").join(held("m_endpoints", "c_endpoint", 2), ["project_id", "c_endpoint"], "left")
    empty = F.expr("cast(array() as array<string>)")
    service = F.when(F.coalesce("c_service", F.lit("")) != "", F.array("c_service")).otherwise(empty)
    alike = {"endpoints": F.coalesce("held_c_endpoint", empty), "services": service, "terms": F.coalesce("held_c_path", empty)}
    placed = placed.select("project_id", "fit", "chunk_id", *[c.alias(n) for n, c in alike.items()])
    # Chunks that can match by the same things have the same kinds, so that their first ids are enough here too.
    placed = top_per(placed, ["project_id", "fit", *alike], [F.asc("chunk_id")], most, "place")
    own = F.explode(_kinds(*[F.col(n) for n in alike]))
    matched = placed.select("project_id", "fit", "chunk_id", own.alias("t")).select("project_id", "fit", "chunk_id", "t.*").where(named)
    of_kinds = matched.join(wanted.select(*keyed).distinct(), keyed, "left_semi")
    first = cut_lineage(top_per(of_kinds, keyed, [F.asc("chunk_id")], most, "place").drop("place"))
    score = (
        F.when(F.col("endpoint") != "", 5.0).otherwise(0.0) + F.when(F.col("service") != "", 4.0).otherwise(0.0)
        + F.when(F.col("second") != "", 2.0).when(F.col("first") != "", 1.0).otherwise(0.0)
    )
    offered = wanted.join(first.groupBy(*keyed).agg(F.count("*").alias("held")), keyed).withColumn("score", score)
    filled = F.max(F.when(F.col("held") >= F.col("fetch_k"), F.col("score"))).over(Window.partitionBy("question_id"))
    reached = offered.withColumn("filled", filled).where(F.col("filled").isNull() | (F.col("score") >= F.col("filled")))
    return reached.join(first, keyed).select("question_id", "project_id", "chunk_id", "score")


def metadata_search(questions: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """Best exact matches per question; ``most`` is the largest budget of any.

    Hash and symbol matches are joined in full. Endpoint, service and path
    matches, which may hold much of a corpus, are taken as far as the largest
    budget can reach. Filters hold in both, before anything is cut. A pair's
    score is the largest found for it.
    """
    active = active_filters(questions)
    asked = cut_lineage(metadata_terms(questions).select(
        "question_id", "project_id", "fetch_k", "m_services", "m_hashes", "m_endpoints", "m_terms", *active
    ))
    # Read by every kind of match, and much narrower than the chunks.
    facts = cut_lineage(_facts(chunks))
    pairs = _selective(asked, facts, active).unionByName(_leading(asked, facts, most, active))
    best = pairs.groupBy("question_id", "project_id", "chunk_id").agg(F.max("score").alias("score"))
    scored = best.join(asked.select("question_id", "fetch_k"), "question_id").select(
        "question_id", "project_id", "chunk_id", "fetch_k", "score"
    )
    return top_per(
        scored, ["question_id"], [F.desc("score"), F.asc("chunk_id")], F.col("fetch_k"), most=most
    )
