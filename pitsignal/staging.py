"""Materialising an intermediate table that several branches of a plan read."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def staging_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session, whose tasks run in the driver's process, may leave it unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a columnar table and return a scan of it.

    Lineage ends here: a lost executor re-reads the table instead of recomputing the
    branch, and every consumer reads only its own columns.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
