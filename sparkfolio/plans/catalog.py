"""Every query by name: a callable over (spark, folder) and its SQL, or None where SQL cannot express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


#: Tables whose rows are long and cost work of their own.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; one of texts that comes in fewer splits than the session has cores is dealt out to all."""
    rows, cores = spark.read.parquet(f"{folder}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in TEXTS and rows.rdd.getNumPartitions() < cores else rows


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        CATALOG[name] = (f, sql)
        return f

    return put


def load() -> dict[str, tuple[Query, str | None]]:
    from . import contracts, corpus, pages, results, scores, service, states  # noqa: F401  each registers its queries

    return CATALOG
