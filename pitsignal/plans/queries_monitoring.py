"""Registered queries for monitoring: lineage, drift, alerts, comparisons of arms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.operators import comparison, monitor
from pitsignal.plans.queries_extraction import CLOCK, conversation_cues, order_signals
from pitsignal.plans.queries_forecast import _simple_arms
from pitsignal.plans.queries_features import event_features
from pitsignal.operators.extract import extract_signals
from pitsignal.operators.forecast import tabular_features
from pitsignal.sources.derived import (
    customer_master, event_days, notes_from_orders, signals_from_events, weekly_demand,
)
from pitsignal.sources.tables import table
from pitsignal.staging import stage


def _event_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = signals_from_events(spark, sf_dir).selectExpr(
        "*", "'r1' as source_revision", "named_struct('source_id', source_id, 'char_start', 0L, 'char_end', 1L) as evidence_ref",
        "'run-1' as extraction_run_id")
    sources = signals.select("source_id", "source_revision", "available_at").distinct()
    return monitor.lineage_trace(signals, sources, event_days(spark, sf_dir))


def pit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.point_in_time_violations(_event_trace(spark, sf_dir))


def feature_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.freshness(event_features(spark, sf_dir), _event_trace(spark, sf_dir)).selectExpr(
        "entity_key", "cast(forecast_cutoff as timestamp_ntz) as forecast_cutoff", "freshness_seconds")


def _event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values by type; the first ten days are the reference, then five-day windows."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_type", "value", "datediff(cast(ts as date), date '2024-01-01') as day").selectExpr(
        "event_type", "value", "if(day < 10, null, cast(day div 5 as bigint)) as part")


def value_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.ks_distance(_event_values(spark, sf_dir).withColumnRenamed("event_type", "feature")).selectExpr(
        "feature", "part", "n_ref", "n_mon", "round(distance, 6) as distance", "round(critical, 6) as critical")


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.category_shift(_event_values(spark, sf_dir).selectExpr(
        "'event_type' as feature", "part", "event_type as category"))


def mix_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).selectExpr(
        "feature", "part", "n_ref", "n_mon", "degrees", "round(chi_square, 6) as chi_square", "round(effect, 6) as effect")


def drift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _mix(spark, sf_dir).selectExpr("feature", "part", "z > 1.645 as significant", "effect").union(
        monitor.ks_distance(_event_values(spark, sf_dir).withColumnRenamed("event_type", "feature")).selectExpr(
            "feature", "part", "distance > critical", "distance"))
    return monitor.alerts(checks, min_effect=0.01)


def _daily_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values by type; the first ten days are the reference, then every day is a window."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_type as feature", "value", "cast(datediff(cast(ts as date), date '2024-01-01') as bigint) as day").selectExpr(
        "feature", "value", "if(day < 10, null, day) as part")


def alert_lead_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from the first lasting alert on an event type's values to the degradation of its forecast.

    The forecast is the mean of the reference; a day's loss is its mean squared error over that of the reference, less 1.
    """
    values = stage(_daily_values(spark, sf_dir))
    level = values.where("part is null").groupBy("feature").agg(
        F.avg("value").alias("mean"), F.var_pop("value").alias("spread"))
    losses = values.where("part is not null").join(level, "feature").groupBy("feature", "part").agg(
        F.expr("avg((value - mean) * (value - mean)) / nullif(any_value(spread), 0) - 1 as loss"))
    checks = monitor.ks_distance(values).selectExpr("feature", "part", "distance > critical as significant", "distance as effect")
    return monitor.lead_time(
        monitor.alerts(checks, min_effect=0.01), monitor.degradation(losses, slack=0.0, threshold=0.1))


def _text_shift(texts: DataFrame) -> DataFrame:
    profiles = stage(monitor.text_profile(texts))
    return monitor.profile_shift(profiles, monitor.merged(profiles)).selectExpr(
        "feature", "part", "n_mon", "n_ref", "round(steps, 6) as steps", "round(variation, 6) as variation")


def text_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and vocabulary of each source's documents against those of all documents."""
    return _text_shift(table(spark, sf_dir, "documents").selectExpr("coalesce(source, '') as part", "text"))


def turn_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and vocabulary of each role's turns against those of all turns."""
    return _text_shift(table(spark, sf_dir, "conversations").selectExpr("coalesce(role, '') as part", "text"))


def extraction_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cues of each later turn say, against the first two turns of all conversations."""
    cues = conversation_cues(spark, sf_dir).selectExpr(
        "if(turn < 2, null, cast(turn as bigint)) as part", "stack(3, 'signal_type', signal_type, 'direction', direction, "
        "'business_certainty', business_certainty) as (feature, category)")
    return monitor.category_shift(cues).selectExpr(
        "feature", "part", "n_ref", "n_mon", "degrees", "round(chi_square, 6) as chi_square", "round(effect, 6) as effect")


def signal_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of last week's demand with this week's, over the last twelve weeks."""
    rows = tabular_features(weekly_demand(spark, sf_dir)).selectExpr("cast(t as bigint) as period", "lag_1", "demand")
    return monitor.rolling_correlation(rows, "lag_1", "demand").selectExpr(
        "period", "n", "round(correlation, 6) as correlation")


def reprocessing_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run over corrected notes changes."""
    notes = notes_from_orders(spark, sf_dir)
    corrected = notes.selectExpr(
        "* except (raw_text)", "replace(replace(raw_text, 'might', 'will'), 'purchase volume', 'inventory') as raw_text")
    again = extract_signals(
        corrected, customer_master(spark, sf_dir), extraction_run_id="run-2", extracted_at=CLOCK)
    return monitor.reprocessing_diff(order_signals(spark, sf_dir, keep=()), again)


def horizon_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.breakdown(_simple_arms(spark, sf_dir), ("horizon",)).selectExpr(
        "arm", "cast(horizon as bigint) as horizon", "round(mae, 6) as mae", "round(bias, 6) as bias", "n_origins",
        "round(lift, 6) as lift")


def breakdown_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by horizon, by the region of the nation, by both and overall."""
    regions = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("n_name as entity_key", "r_name as segment")
    results = _simple_arms(spark, sf_dir).join(regions, "entity_key").withColumn("horizon", F.col("horizon").cast("bigint"))
    return comparison.breakdown_cube(results, ("horizon", "segment")).selectExpr(
        "arm", "horizon", "segment", "cast(level as bigint) as level", "round(mae, 6) as mae", "round(bias, 6) as bias", "n_origins",
        "round(lift, 6) as lift")


def paired_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.paired_losses(_simple_arms(spark, sf_dir)).groupBy("arm").agg({"gain": "avg", "*": "count"}).selectExpr(
        "arm", "round(`avg(gain)`, 6) as mean_gain", "`count(1)` as pairs")


def bootstrap_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = comparison.bootstrap_lift(comparison.paired_losses(_simple_arms(spark, sf_dir)))
    return band.selectExpr("arm", *(f"round({c}, 6) as {c}" for c in ("lift_low", "lift_mid", "lift_high")), "replicates")


def ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of every ablation of the extracted features."""
    from pitsignal.operators.access import FeatureStore
    from pitsignal.operators.grid import period_grid
    from pitsignal.plans.queries_ledger import nation_signals, nations

    demand = stage(weekly_demand(spark, sf_dir))
    features = stage(FeatureStore(nation_signals(spark, sf_dir)).get_historical_features(
        period_grid(nations(spark, sf_dir), demand), generated_at=CLOCK, lineage="none", unique=True))
    return comparison.breakdown(comparison.with_exposure(
        comparison.run_ablations(demand, features), demand, features), ("exposed",), baseline="none")


QUERIES = {
    "pit_violations": pit_violations,
    "feature_freshness": feature_freshness,
    "value_drift": value_drift,
    "mix_drift": mix_drift,
    "drift_alerts": drift_alerts,
    "alert_lead_time": alert_lead_time,
    "text_drift": text_drift,
    "turn_drift": turn_drift,
    "extraction_mix": extraction_mix,
    "rolling_correlation": signal_correlation,
    "reprocessing_diff": reprocessing_diff,
    "horizon_breakdown": horizon_breakdown,
    "breakdown_cube": breakdown_cube,
    "paired_losses": paired_losses,
    "bootstrap_lift": bootstrap_lift,
    "ablations": ablations,
}
