"""Session construction and the few session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Only the defaults that the plans in this package assume.  A cluster submits its
# own sizes; ``get_session`` never overrides a value that is already set.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot never compiles a method of more than 8000 bytes of bytecode.  A fused stage
    # above that size runs interpreted; below this limit Spark uses split projections.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Aggregates and sorts hold a shuffled partition many times its compressed size.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # Compressed files are several times as large once read; a join must not be planned by the file's size.
    "spark.sql.sources.fileCompressionFactor": "10.0",
}


def get_session(app_name: str = "pitsignal", master: str | None = None, **conf: str) -> SparkSession:
    """Return the active session, or build one with the library's defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_settings(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on (UTC clocks) and the compilation limit; sizes only where the cluster names none."""
    for key in ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit"):
        if spark.conf.get(key) != _DEFAULTS[key]:
            spark.conf.set(key, _DEFAULTS[key])
    for key in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.sources.fileCompressionFactor"):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, _DEFAULTS[key])
    return spark
