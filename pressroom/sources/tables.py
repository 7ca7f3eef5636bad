"""Driver parquet tables (``<sf_dir>/<name>.parquet``).

Reads are lazy: Catalyst prunes columns and pushes filters into the parquet scan, so callers
select only what they use and never pre-materialise a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Attribute access to the driver tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark = spark
        self._dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self._spark, self._dir, name)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal CPU-heavy row-local work (regex over long texts) evenly: rows are hash-partitioned by
    ``key``, at every size, so a retry deals them the same way and no plan depends on how the
    table happens to be split into files."""
    return df.repartition(key)
