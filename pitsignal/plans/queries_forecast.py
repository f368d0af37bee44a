"""Registered queries over weekly demand: series features, arms, metrics, decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from pitsignal.operators.access import FeatureStore
from pitsignal.operators.forecast import (
    ForecastConfig, arm_metrics, decision, merge_signals, origin_schedule, run_arms, simple_forecast, tabular_features,
)
from pitsignal.operators.grid import period_grid
from pitsignal.operators.quality import demand_sanity, series_quality
from pitsignal.plans.experiment import run_experiment
from pitsignal.plans.queries_extraction import CLOCK
from pitsignal.plans.queries_ledger import nation_signals, nations
from pitsignal.sources.derived import truth_by_nation, weekly_demand
from pitsignal.staging import stage


def demand_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_demand(spark, sf_dir).selectExpr(
        "entity_key", "period_start", "cast(week_index as bigint) as week_index", "demand")


def demand_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_quality(weekly_demand(spark, sf_dir)).selectExpr(
        "entity_key", "weeks", "missing_weeks", "negative_weeks", "not_finite_weeks",
        "round(spread, 6) as spread", "round(yearly_correlation, 6) as yearly_correlation")


def demand_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand_sanity(weekly_demand(spark, sf_dir))


def tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = ForecastConfig()
    return tabular_features(weekly_demand(spark, sf_dir), config).selectExpr(
        "entity_key", "cast(t as bigint) as t", "demand", *(f"round({c}, 6) as {c}" for c in config.tabular_columns))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tabular rows with the extracted signal features of the same entity and week."""
    demand = weekly_demand(spark, sf_dir)
    features = FeatureStore(nation_signals(spark, sf_dir)).get_historical_features(
        period_grid(nations(spark, sf_dir), demand), generated_at=CLOCK, lineage="none", unique=True)
    return merge_signals(tabular_features(demand), features).selectExpr(
        "entity_key", "cast(t as bigint) as t", "round(lag_1, 6) as lag_1", "signal_count_30d", "has_active_signal_30d",
        "expected_qty_delta_next_horizon", "nearest_effective_start_days", "days_since_latest_signal",
        "independent_source_count_30d", "active_conflict_count", "dir_increase", "dir_decrease", "dir_mixed")


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin_schedule(tabular_features(weekly_demand(spark, sf_dir))).selectExpr(
        "entity_key", "cast(origin as bigint) as origin", "cast(n_train as bigint) as n_train")


def ridge_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling ridge with a single column, where it has a closed form."""
    return run_arms(weekly_demand(spark, sf_dir), {"A": None}, columns={"A": ["lag_1"]}).selectExpr(
        "entity_key", "cast(origin_week_index as bigint) as origin", "cast(horizon as bigint) as horizon", "actual",
        "round(predicted, 4) as predicted")


# Single-feature predictors standing in for the arms, so that metrics have a check in SQL.
_PREDICTORS = {"A": "seasonal_lag", "B": "rolling_mean_4", "C": "(rolling_mean_4 + seasonal_lag) / 2", "D": "lag_1"}


def _simple_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    demand = weekly_demand(spark, sf_dir)
    # All arms read the history; it is derived once.
    demand = stage(demand)
    return reduce(DataFrame.unionByName, (simple_forecast(demand, arm, p) for arm, p in _PREDICTORS.items()))


def simple_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arm_metrics(_simple_arms(spark, sf_dir)).selectExpr(
        "arm", "round(mase, 6) as mase", "round(mae, 6) as mae", "round(bias, 6) as bias", "n_origins",
        "round(incremental_lift_vs_a, 6) as incremental_lift_vs_a")


def ridge_two_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling ridge with two columns, solved by Cramer's rule in its check."""
    return run_arms(weekly_demand(spark, sf_dir), {"A": None}, columns={"A": ["lag_1", "rolling_mean_4"]}).selectExpr(
        "entity_key", "cast(origin_week_index as bigint) as origin", "cast(horizon as bigint) as horizon", "actual",
        "round(predicted, 4) as predicted")


def simple_metrics_pooled_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arm_metrics(_simple_arms(spark, sf_dir), seasonal_period=4).selectExpr(
        "arm", "round(mase, 6) as mase", "n_origins")


def simple_metrics_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arm_metrics(_simple_arms(spark, sf_dir), scale="per_entity", seasonal_period=4).selectExpr(
        "arm", "round(mase, 6) as mase", "n_origins")


def simple_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision(arm_metrics(_simple_arms(spark, sf_dir))).selectExpr(
        *(f"round({a}_lift, 6) as {a}_lift" for a in ("b", "c", "d")), "branch", "round(retained, 6) as retained")


def _experiment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    demand = stage(weekly_demand(spark, sf_dir))
    entities = nations(spark, sf_dir)
    store = FeatureStore(nation_signals(spark, sf_dir, linked=True), supersession="as_of")
    features = stage(store.get_historical_features(
        period_grid(entities, demand), generated_at=CLOCK, lineage="none", unique=True))
    return run_experiment(
        demand, truth_by_nation(spark, sf_dir), None, store, entities, generated_at=CLOCK, extracted=features)


def forecast_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four arms end to end: every origin and horizon of every nation."""
    return _experiment(spark, sf_dir)[0]


def experiment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _experiment(spark, sf_dir)[1]


def experiment_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision(experiment_metrics(spark, sf_dir))


QUERIES = {
    "weekly_demand": demand_rows,
    "demand_quality": demand_quality,
    "demand_sanity": demand_summary,
    "tabular_features": tabular,
    "merged_features": merged,
    "origin_schedule": schedule,
    "ridge_one_feature": ridge_one_feature,
    "ridge_two_features": ridge_two_features,
    "arm_metrics": simple_metrics,
    "arm_metrics_pooled_4": simple_metrics_pooled_4,
    "arm_metrics_per_entity": simple_metrics_per_entity,
    "decision_branch": simple_decision,
    "forecast_arms": forecast_arms,
    "experiment_metrics": experiment_metrics,
    "experiment_decision": experiment_decision,
}
