"""(entity, cutoff) grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def periodic_grid(entities: DataFrame, bounds: DataFrame, *, step_days: int) -> DataFrame:
    """Every entity at every ``step_days`` from ``first`` to ``last`` (one row of dates).

    The cutoffs are one array in a scalar subquery; each entity row expands to it, so
    the grid is built without a join and without a shuffle.
    """
    cutoffs = bounds.select(F.sequence(
        F.col("first").cast("timestamp_ntz"), F.col("last").cast("timestamp_ntz"),
        F.make_dt_interval(days=F.lit(step_days)))).scalar()
    return entities.select("entity_key", F.explode(cutoffs).alias("forecast_cutoff"))


def period_grid(entities: DataFrame, periods: DataFrame) -> DataFrame:
    """Every entity at every distinct ``period_start`` of ``periods``.

    The distinct periods of a demand history are a calendar: their number is the
    number of weeks, whatever the number of entities.
    """
    cutoffs = periods.agg(F.array_sort(F.collect_set(F.col("period_start").cast("timestamp")))).scalar()
    return entities.select("entity_key", F.explode(cutoffs).alias("forecast_cutoff"))


def weekly_cutoffs(spark, start: str, n_weeks: int) -> DataFrame:
    """``n_weeks`` cutoffs seven days apart, beginning at ``start``."""
    week = F.make_dt_interval(days=(F.col("id") * 7).cast("int"))
    return spark.range(n_weeks).select((F.lit(start).cast("timestamp") + week).alias("forecast_cutoff"))
