"""Registry of runnable queries and, where SQL can say the same thing, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Tables whose rows carry whole texts: row work on them is CPU-heavy.
TEXT_TABLES = {"documents", "pages", "conversations"}


def spread(df: DataFrame) -> DataFrame:
    """Split a table that arrives in fewer scan tasks than there are cores (few large row groups).

    A table with enough files is left alone, so at scale this adds no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_ONCE: dict[tuple, object] = {}


def forget() -> None:
    """Drop remembered intermediates, so that the next query pays for all of its work."""
    _ONCE.clear()


class Tables:
    """Lazy access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def once(self, name: str, build: Callable):
        """Intermediates several queries share are written once per session (to the checkpoint folder)."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _ONCE:
            _ONCE[key] = build()
        return _ONCE[key]

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if name in TEXT_TABLES else df


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with an optional DuckDB text."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
