"""Operator 1, URL filter: empirical-Bayes host reputation, DataFrame functions only.

Labelled page outcomes are counted per host. Each host's share of good pages is
shrunk towards its registered domain, the domain towards its suffix, the suffix
towards the whole corpus. How strongly is read from the data: at each level the
excess of the counts' variance over the binomial one gives the beta-binomial
correlation, and so the prior's weight. A host passes if the lower bound of its
posterior reaches a threshold. Written rules come first.

Defined results: a null url or one without ``://`` has empty host and path, fits
no rule and is judged by the corpus prior; without any outcome that prior is
uniform. Repeated pages repeat their row. Outcomes with a null label or url
teach nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import pick, stored

#: (rule, verdict): host and path prefix; a host stands for its subdomains too.
RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
    ("com/fr/", "allow"), ("com/de/", "block"),
)
#: Suffixes of two labels under which names are registered. Fixed values; a parameter.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "gov.uk", "org.uk")
LEVELS = ("suffix", "domain", "host")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty if there is none."""
    raw = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]], value: int) -> Column:
    """The longest fitting rule (value 0) or its verdict (value 1), else null."""
    out = F.lit(None).cast("string")
    for entry in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = entry[0].partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, entry[value]).otherwise(out)
    return out


def with_levels(frame: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """Adds ``suffix`` and ``domain`` of ``host``; an address or a bare name is its own domain."""
    bare = F.regexp_replace("host", r"^.*@|:\d*$", "")
    parts = F.split(bare, r"\.")
    two = F.array_join(F.slice(parts, -2, 2), ".")
    depth = F.when(two.isin(*suffixes), 2).otherwise(1)
    numeric = bare.rlike(r"^[0-9.]+$") | ~bare.contains(".") | (F.size(parts) <= depth)
    frame = frame.withColumns({
        "suffix": F.when(numeric, "").when(depth == 2, two).otherwise(F.element_at(parts, -1)),
    })
    own = F.array_join(F.slice(parts, -(depth + 1), depth + 1), ".")
    return frame.withColumn("domain", F.when(numeric, bare).otherwise(own))


def outcomes_by_host(outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(suffix, domain, host, n, y) from outcomes (url, good): pages seen, good pages."""
    rows = pick(outcomes, url="url", good="good").where("url is not null and good is not null")
    rows = rows.select(host_of(F.col("url")).alias("host"), F.col("good").cast("int").alias("good")).where("host <> ''")
    counts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum((F.col("good") > 0).cast("long")).alias("y"))
    return with_levels(counts, suffixes)


def correlation(groups: DataFrame, least: float, most: float) -> float:
    """Beta-binomial correlation of groups (n, y) about their prior means (mu), one number."""
    n, y, mu = F.col("n").cast("double"), F.col("y").cast("double"), F.col("mu")
    excess = F.sum((y - n * mu) * (y - n * mu) - n * mu * (1 - mu))
    room = F.sum(n * (n - 1) * mu * (1 - mu))
    row = groups.agg(excess.alias("excess"), room.alias("room")).first()
    if not row.room:
        return most
    return min(most, max(least, row.excess / row.room))


def reputation(counts: DataFrame, z: float = 1.645, least: float = 0.001, most: float = 0.5) -> tuple[DataFrame, dict]:
    """(host, domain, suffix, n, y, mean, bound) for each counted host, and the fitted priors.

    One small aggregate per level reaches the driver: two sums. The tables of
    domains and suffixes that carry the prior means stay in Spark.
    """
    counts = stored(counts)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
    priors = {"root": (total.y + 1) / (total.n + 2)}
    above, key = None, None
    frames = {}
    for level in LEVELS:
        keys = list(LEVELS[: LEVELS.index(level) + 1])
        groups = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
        if above is None:
            groups = groups.withColumn("mu", F.lit(priors["root"]))
        else:
            groups = groups.join(above.select(*key, F.col("mean").alias("mu")), key)
        rho = correlation(groups, least, most)
        weight = 1 / rho - 1
        priors[level] = weight
        total_weight = F.col("n") + F.lit(weight)
        mean = (F.col("y") + F.lit(weight) * F.col("mu")) / total_weight
        groups = groups.withColumn("mean", mean)
        bound = F.col("mean") - F.lit(z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total_weight + 1))
        groups = groups.withColumn("bound", bound)
        above, key = groups, keys
        frames[level] = groups
    return frames, priors


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES,
    suffixes: Sequence[str] = SUFFIXES, z: float = 1.645, threshold: float = 0.5,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) for each page row.

    A host without outcomes takes the prior of its domain, else of its suffix,
    else of the corpus, with that prior's own bound. Only ids, hosts and paths
    are joined with the host table, which Spark broadcasts by its measured size
    only; else it splits the rows of a busy host.
    """
    frames, priors = reputation(outcomes_by_host(outcomes, suffixes), z)

    def prior_bound(mean: Column, level: str) -> Column:
        return mean - F.lit(z) * F.sqrt(mean * (1 - mean) / F.lit(priors[level] + 1))

    rows = pick(pages, page_id="page_id", url="url")
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = with_levels(rows, suffixes)
    # One lookup per distinct host, then one join of the pages with it.
    hosts = rows.select(*LEVELS).distinct()
    by_host = frames["host"].select("host", F.col("bound").alias("host_bound"))
    by_domain = frames["domain"].select("suffix", "domain", F.col("mean").alias("domain_mean"))
    by_suffix = frames["suffix"].select("suffix", F.col("mean").alias("suffix_mean"))
    known = (
        hosts.join(by_host, "host", "left").join(by_domain, ["suffix", "domain"], "left").join(by_suffix, "suffix", "left")
        .select(
            "host",
            F.coalesce(
                "host_bound", prior_bound(F.col("domain_mean"), "host"), prior_bound(F.col("suffix_mean"), "domain"),
                prior_bound(F.lit(priors["root"]), "suffix"),
            ).alias("bound"),
        )
    )
    host, path = F.col("host"), F.col("path")
    by_rule = rule_for(host, path, rules, 1)
    by_method = F.when(F.col("bound") >= threshold, "allow").otherwise("block")
    return rows.join(known, "host").select(
        "page_id", "host", "path", rule_for(host, path, rules, 0).alias("rule"),
        F.coalesce(by_rule, by_method).alias("verdict"), F.round("bound", 6).alias("bound"),
    )


def page_outcomes(pages: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """(url, good) from the labels of the documents that pages were made of.

    The last number in the url's path is the document's id. A document labelled
    more than once counts by its smallest label; held-out folds play no part
    here, as a verdict is about hosts.
    """
    known = (
        pick(labels, doc_id="doc_id", good=target).where("doc_id is not null and good is not null")
        .groupBy("doc_id").agg(F.min("good").alias("good"))
    )
    url = F.col("url")
    number = F.regexp_extract(path_of(url), r"^.*?([0-9]{1,18})[^0-9]*$", 1)
    rows = pick(pages, url="url").where("url is not null")
    rows = rows.select("url", F.when(number != "", number).cast("long").alias("doc_id")).where("doc_id is not null")
    return rows.join(known, "doc_id").select("url", "good")


ORACLE = r"""
with p as (
  select page_id, url,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*(/[^?#]*)', 1), '') as path
  from pages),
parts as (select *, string_split(host, '.') as l from p),
named as (
  select page_id, url, host, path,
    case when regexp_full_match(host, '[0-9.]+') or len(l) < 2 then '' else l[-1] end as suffix,
    case when regexp_full_match(host, '[0-9.]+') or len(l) < 2 then host else l[-2] || '.' || l[-1] end as domain
  from parts),
lab as (select doc_id, min(quality) as good from labels where doc_id is not null and quality is not null group by doc_id),
counts as (
  select suffix, domain, host, count(*) as n, sum(case when good > 0 then 1 else 0 end)::bigint as y
  from named join lab on lab.doc_id = try_cast(regexp_extract(path, '^.*?([0-9]{1,18})[^0-9]*$', 1) as bigint)
  where host <> '' group by 1, 2, 3),
root as (select (coalesce(sum(y), 0) + 1) / (coalesce(sum(n), 0) + 2)::double as mean from counts),
g1 as (select suffix, sum(n)::double as n, sum(y)::double as y, (select mean from root) as mu from counts group by 1),
r1 as (select 1 / greatest(0.001, least(0.5, sum((y - n*mu)*(y - n*mu) - n*mu*(1-mu)) / sum(n*(n-1)*mu*(1-mu)))) - 1 as m from g1),
s1 as (select suffix, (y + m*mu) / (n + m) as mean from g1, r1),
g2 as (select suffix, domain, c.n, c.y, s1.mean as mu from (select suffix, domain, sum(n)::double as n, sum(y)::double as y from counts group by 1, 2) c join s1 using (suffix)),
r2 as (select 1 / greatest(0.001, least(0.5, sum((y - n*mu)*(y - n*mu) - n*mu*(1-mu)) / sum(n*(n-1)*mu*(1-mu)))) - 1 as m from g2),
s2 as (select suffix, domain, (y + m*mu) / (n + m) as mean from g2, r2),
g3 as (select c.suffix, c.domain, c.host, c.n::double as n, c.y::double as y, s2.mean as mu from counts c join s2 using (suffix, domain)),
r3 as (select 1 / greatest(0.001, least(0.5, sum((y - n*mu)*(y - n*mu) - n*mu*(1-mu)) / sum(n*(n-1)*mu*(1-mu)))) - 1 as m from g3),
s3 as (select host, (y + m*mu) / (n + m) as mean, n + m as w from g3, r3),
known as (
  select distinct named.host, coalesce(
    s3.mean - 1.645 * sqrt(s3.mean * (1 - s3.mean) / (s3.w + 1)),
    s2.mean - 1.645 * sqrt(s2.mean * (1 - s2.mean) / (r3.m + 1)),
    s1.mean - 1.645 * sqrt(s1.mean * (1 - s1.mean) / (r2.m + 1)),
    root.mean - 1.645 * sqrt(root.mean * (1 - root.mean) / (r1.m + 1))) as bound
  from named, root, r1, r2, r3
  left join s3 on s3.host = named.host
  left join s2 on s2.suffix = named.suffix and s2.domain = named.domain
  left join s1 on s1.suffix = named.suffix),
ruled as (
  select page_id, host, path, bound, case
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule
  from named join known using (host))
select page_id, host, path, rule,
  case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
       when bound >= 0.5 then 'allow' else 'block' end as verdict,
  round(bound, 6) as bound
from ruled
"""
