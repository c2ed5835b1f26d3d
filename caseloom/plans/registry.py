"""Registration of the named queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.plans.views import Dialect, expand, load
from caseloom.session import configure

Load = Callable[[str], DataFrame]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Load], DataFrame]], Callable]:
    """Register a query over the given tables and the views on them."""

    def register(fn: Callable[[Load], DataFrame]) -> Callable[[Load], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(lambda table: load(spark, sf_dir, table))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = expand(oracle, Dialect(False))
        return fn

    return register


def joined(array: Column | str, sep: str = ",") -> Column:
    """An array as one string, in its own order."""
    return F.coalesce(F.array_join(array, sep), F.lit(""))


def big(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("bigint")


def flag(value: Column | str) -> Column:
    """A boolean as 0 or 1."""
    return F.coalesce((F.col(value) if isinstance(value, str) else value).cast("bigint"), F.lit(0).cast("bigint"))


def text(value: Column | str) -> Column:
    """A nullable value as a string, empty where absent."""
    return F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit(""))


def stamp(ts: Column | str) -> Column:
    """A timestamp as text, to the second."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
