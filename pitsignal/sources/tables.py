"""Readers for the benchmark tables the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitsignal.session import ensure_settings

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(name)
    return ensure_settings(spark).read.parquet(f"{sf_dir}/{name}.parquet")
