"""The four-arm experiment: history, oracle signals, extracted signals, shuffled control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.operators.access import FeatureStore
from pitsignal.operators.forecast import ForecastConfig, arm_metrics, run_arms
from pitsignal.operators.grid import period_grid
from pitsignal.operators.oracle import build_oracle_features
from pitsignal.operators.shuffle import shuffle_features
from pitsignal.staging import stage


def run_experiment(
    demand: DataFrame, truth: DataFrame, notes: DataFrame | None, store: FeatureStore, entities: DataFrame,
    config: ForecastConfig = ForecastConfig(), *, generated_at: str | None = None, shuffle_seed: int = 99,
    extracted: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Results of all arms and their metrics.

    Without ``notes`` the truth rows carry the availability and the entity of their note.
    Arms C and D read the extracted features from a table: the one passed as
    ``extracted``, or one written here.
    """
    grid = period_grid(entities, demand)
    periods = demand.select(F.col("period_start").cast("timestamp").alias("forecast_cutoff")).distinct()
    oracle = build_oracle_features(truth, notes, grid, generated_at=generated_at, cutoffs=periods)
    if extracted is None:
        extracted = stage(store.get_historical_features(
            grid, lineage="none", generated_at=generated_at, cutoffs=periods, unique=True))
    arms = {"A": None, "B": oracle, "C": extracted, "D": shuffle_features(extracted, seed=shuffle_seed)}
    results = stage(run_arms(demand, arms, config))
    return results, arm_metrics(results)
