"""Registered queries over the event ledger: point-in-time features and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitsignal.operators.features import build_features, contributing_signals
from pitsignal.sources.derived import event_days, signals_from_events
from pitsignal.sources.tables import table

CLOCK = "2024-02-01 00:00:00"

FEATURE_COLUMNS = (
    "entity_key", "cast(forecast_cutoff as timestamp_ntz) as forecast_cutoff",
    "has_active_signal_30d", "signal_count_30d", "net_demand_direction_30d",
    "round(expected_qty_delta_next_horizon, 4) as expected_qty_delta_next_horizon",
    "round(committed_qty, 4) as committed_qty", "round(cancelled_qty_30d, 4) as cancelled_qty_30d",
    "delay_count_90d", "nearest_effective_start_days", "days_since_latest_signal",
    "independent_source_count_30d", "active_conflict_count", "staleness_status",
)


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_features(
        signals_from_events(spark, sf_dir), event_days(spark, sf_dir), generated_at=CLOCK)


def pit_features_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of every user at every day, lineage counted."""
    return event_features(spark, sf_dir).selectExpr(*FEATURE_COLUMNS, "contributing_signal_count")


def pit_features_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with each cutoff seeing supersession as known then, and lineage arrays."""
    return build_features(
        signals_from_events(spark, sf_dir), event_days(spark, sf_dir),
        generated_at=CLOCK, supersession="as_of", lineage="array",
    ).selectExpr(*FEATURE_COLUMNS, "array_join(contributing_signal_ids, ',') as contributing_signal_ids")


def pit_features_own_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every user at the instant of each of the user's own events."""
    pairs = table(spark, sf_dir, "events").selectExpr("concat('USER-', cast(user_id as string)) as entity_key", "ts as forecast_cutoff")
    return build_features(signals_from_events(spark, sf_dir), pairs, generated_at=CLOCK).selectExpr(*FEATURE_COLUMNS, "contributing_signal_count")


def contributing_signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat lineage: every eligible signal of every pair."""
    return contributing_signals(
        signals_from_events(spark, sf_dir), event_days(spark, sf_dir)
    ).selectExpr("entity_key", "cast(forecast_cutoff as timestamp_ntz) as forecast_cutoff", "signal_id", "source_id")


QUERIES = {
    "pit_features_events": pit_features_events,
    "pit_features_as_of": pit_features_as_of,
    "pit_features_own_cutoffs": pit_features_own_cutoffs,
    "contributing_signals": contributing_signal_rows,
}
