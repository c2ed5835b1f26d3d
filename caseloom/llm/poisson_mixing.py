"""Operator 6, mixing sources to target weights by Poisson replication.

Each source has a target weight; its mean repetition rate is the weight times
the size of the mixture over the source's own size. Each document's count is
the inverse of the Poisson distribution with that mean at a number in [0, 1)
made from a hash of seed, document id and text, so a rerun, another cluster or
a lost executor give the same counts. Documents are repeated by their count and
shuffled globally by another hash.

A mean beyond some hundreds is not summed from 0: its distribution is taken in a
window of twelve deviations around the mean, below which lies nothing that a
number of 52 bits could tell from 0. Where a document has many copies, they are
dealt out in blocks before they are made, so that no task makes them all.

Defined results: a null source is a source of its own; null ids and texts hash
as a word of their own. Rows that repeat an id and a text share one number and
so one count. A source without a given weight has weight 0 and is left out by
choice of the weights. An empty table gives an empty mixture. Input columns named
``copy`` or ``place`` come back as ``input_copy`` and ``input_place``; all others
keep their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import stored

SEED = "mix-1"
#: The largest mean that is summed from 0, copies of a document that one task makes, and terms that a distribution needs on either side.
SMALL_MEAN = 200.0
BLOCK = 1_000
DEVIATIONS = 12
#: Distribution tables of at most so many sources are sent to all executors.
BROADCAST_SOURCES = 10_000


def unit(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from an md5 over the parts."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def distribution(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... far into the tail, as an array.

    Terms are taken through logarithms, so a mean of thousands does not underflow.
    """
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.lit(0.0).alias("log_factorial"), F.lit(0.0).alias("total"), F.expr("cast(array() as array<double>)").alias("out"))

    def step(acc: Column, k: Column) -> Column:
        log_factorial = acc.log_factorial + F.when(k > 0, F.log(F.greatest(k, F.lit(1)).cast("double"))).otherwise(0.0)
        total = acc.total + F.exp(k * F.log(mean) - mean - log_factorial)
        return F.struct(log_factorial.alias("log_factorial"), total.alias("total"), F.concat(acc.out, F.array(total)).alias("out"))

    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(0), last), start, step, lambda acc: acc.out)).otherwise(F.array(F.lit(2.0)))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, size: int | None = None, source: str = "source") -> DataFrame:
    """(source, n, rate) for each source. Without weights, all sources weigh the same.

    ``size`` is the expected number of rows of the mixture, by default the
    number of rows there are.
    """
    counts = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight: Column = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source") == name, float(value)).otherwise(weight)
    counts = stored(counts.withColumn("weight", weight))
    total = counts.agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).first()
    rows = size if size is not None else total.n or 0
    share = F.col("weight") / F.lit(float(total.weight or 1.0))
    return counts.select("source", "n", (share * F.lit(float(rows)) / F.col("n")).alias("rate"))


def log_factorial(k: Column) -> Column:
    """Stirling's series, to double precision from some tens on."""
    return k * F.log(k) - k + 0.5 * F.log(2 * F.pi() * k) + 1 / (12 * k) - 1 / (360 * k * k * k)


def distributions(table: DataFrame) -> DataFrame:
    """(mix_source, mix_low, mix_steps): P(X <= k) for k = mix_low, mix_low + 1, ... as an array.

    Small means are summed inside their row. Of a large one the terms of the
    window are rows, summed in order by a window of the source: some 24 times
    the root of the mean, whatever the number of documents.
    """
    rate = F.col("rate")
    small = table.where(rate <= SMALL_MEAN).select(F.col("source").alias("mix_source"), F.lit(0).cast("long").alias("mix_low"), distribution(rate).alias("mix_steps"))
    spread = DEVIATIONS * F.sqrt(rate) + 30
    low = F.greatest(F.floor(rate - spread), F.lit(1)).cast("long")
    terms = table.where(rate > SMALL_MEAN).select("source", "rate", low.alias("low"), F.explode(F.sequence(low, F.ceil(rate + spread).cast("long"))).alias("k"))
    k = F.col("k").cast("double")
    term = F.exp(k * F.log(rate) - rate - log_factorial(k))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    summed = terms.withColumn("total", F.sum(term).over(upto))
    # Sums grow with k, so their order is that of k.
    large = summed.groupBy(F.col("source").alias("mix_source")).agg(F.min("low").alias("mix_low"), F.sort_array(F.collect_list("total")).alias("mix_steps"))
    return small.unionByName(large)


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, size: int | None = None, seed: str = SEED,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK,
) -> DataFrame:
    """The rows of the mixture, shuffled globally: all columns, ``copy`` (from 1) and ``place``.

    ``place`` is a random number in [0, 1) of each copy. Rows are dealt out by
    its hash and sorted by it within partitions, so every copy may stand next to
    any other. One number per row decides its count; the table of distributions
    has one row per source and is broadcast up to a stated number of sources,
    beyond it joined by shuffle. The rows cross the network once, and documents
    of sources that may have more than ``block`` copies once for every block.
    """
    known = rates(docs, weights, size, source)
    table = stored(distributions(known))
    few = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    most = known.agg(F.max("rate")).first()[0] or 0.0
    named, wanted = [], {"copy", "place"}
    for column in docs.columns:
        name = f"input_{column}" if column in ("copy", "place") else column
        while name in wanted:
            name = f"input_{name}"
        wanted.add(name)
        named.append(name)
    inner = [f"c{k}" for k in range(len(docs.columns))]
    own = dict(zip(docs.columns, inner, strict=True))
    rows = docs.toDF(*inner)
    base = rows.withColumn("mix_digest", F.md5(F.coalesce(F.col(own[text]), F.lit("\\N"))))
    # The number is made below the join, once per row, and only compared above it.
    base = base.withColumn("mix_number", unit(F.lit(seed), F.col(own[doc_id]), F.col("mix_digest")))
    joined = base.join(F.broadcast(table) if few else table, F.col(own[source]).eqNullSafe(F.col("mix_source")))
    # As many steps of the distribution lie at or below the number as the document has copies.
    if most <= SMALL_MEAN:
        passed = F.filter("mix_steps", lambda step: step <= F.col("mix_number"))
        repeated = joined.select(*inner, "mix_digest", F.posexplode(passed).alias("mix_place", "mix_step"))
        repeated = repeated.withColumn("mix_copy", F.col("mix_place") + 1)
    else:
        many = F.col("mix_low") + F.size(F.filter("mix_steps", lambda step: step <= F.col("mix_number")))
        counted = joined.select(*inner, "mix_digest", many.alias("mix_count")).where("mix_count > 0")
        blocks = counted.withColumn("mix_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("mix_count") - 1) / block).cast("int"))))
        dealt = blocks.repartition(F.xxhash64(own[doc_id], "mix_digest", "mix_block"))
        first = F.col("mix_block").cast("long") * block
        made = F.sequence(first + 1, F.least(first + block, F.col("mix_count")))
        repeated = dealt.select(*inner, "mix_digest", F.explode(made).alias("mix_copy")).withColumn("mix_copy", F.col("mix_copy").cast("int"))
    placed = repeated.withColumn("mix_at", unit(F.lit(seed + "/place"), F.col(own[doc_id]), F.col("mix_digest"), F.col("mix_copy")))
    placed = placed.select(*inner, F.col("mix_copy").alias("copy"), F.col("mix_at").alias("place"))
    return placed.repartition("place").sortWithinPartitions("place", own[doc_id], "copy").toDF(*named, "copy", "place")


ORACLE = """
with recursive counts as (select source, count(*) as n from documents group by source),
rates as (
  select source, (1.0 / (select count(*) from counts)) * (select sum(n) from counts)::double / n as rate from counts),
steps(source, rate, k, log_factorial, total) as (
  select source, rate, 0, 0.0::double, exp(-rate) from rates
  union all
  select source, rate, k + 1, log_factorial + ln((k + 1)::double),
    total + exp((k + 1) * ln(rate) - rate - (log_factorial + ln((k + 1)::double)))
  from steps where k < ceil(rate + 12 * sqrt(rate) + 30)),
tables as (select source, list(total order by k) as totals from steps group by source),
numbered as (
  select d.*, md5(coalesce(text, '\\N')) as digest,
    ('0x' || substr(md5('mix-1|' || coalesce(doc_id::varchar, '\\N') || '|' || md5(coalesce(text, '\\N'))), 1, 13))::bigint::double / 4503599627370496.0 as u
  from documents d),
counted as (
  select n.*, len(list_filter(t.totals, lambda x: x <= n.u)) as times
  from numbered n join tables t on t.source is not distinct from n.source),
repeated as (select *, unnest(range(1, times + 1))::int as copy from counted where times > 0)
select doc_id, text, lang, source, n_chars, copy,
  ('0x' || substr(md5('mix-1/place|' || coalesce(doc_id::varchar, '\\N') || '|' || digest || '|' || copy), 1, 13))::bigint::double / 4503599627370496.0 as place
from repeated
"""
