"""Reading the arms of an experiment: breakdowns, paired losses, ablations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.operators.forecast import DIRECTION_FLAGS, SIGNAL_COLUMNS, ForecastConfig, incremental_lift, run_arms

# Signal columns each ablation keeps; the history columns are always kept.
ABLATIONS: dict[str, tuple[str, ...]] = {
    "presence_only": ("has_active_signal_30d",),
    "count_only": ("signal_count_30d",),
    "direction_only": ("has_active_signal_30d", *DIRECTION_FLAGS),
    "with_magnitude": ("has_active_signal_30d", *DIRECTION_FLAGS, "expected_qty_delta_next_horizon"),
    "with_time": ("has_active_signal_30d", *DIRECTION_FLAGS, "expected_qty_delta_next_horizon",
                  "nearest_effective_start_days", "days_since_latest_signal", "delay_count_90d"),
    "with_certainty": ("has_active_signal_30d", *DIRECTION_FLAGS, "expected_qty_delta_next_horizon",
                       "nearest_effective_start_days", "days_since_latest_signal", "delay_count_90d",
                       "committed_qty", "cancelled_qty_30d"),
    "all": (*SIGNAL_COLUMNS, *DIRECTION_FLAGS),
}


def run_ablations(demand: DataFrame, features: DataFrame, config: ForecastConfig = ForecastConfig()) -> DataFrame:
    """Results of one arm per ablation, all in one job, with history only as arm ``none``."""
    arms: dict = {"none": None} | dict.fromkeys(ABLATIONS, features)
    columns = {name: (*config.tabular_columns, *kept) for name, kept in ABLATIONS.items()}
    return run_arms(demand, arms, config, columns=columns)


def breakdown(results: DataFrame, keys: tuple[str, ...], *, baseline: str = "A") -> DataFrame:
    """MAE, bias and lift over the baseline per arm and group (horizon, segment, exposure)."""
    errors = results.groupBy("arm", *keys).agg(
        F.expr("avg(abs(actual - predicted)) as mae"), F.expr("avg(predicted - actual) as bias"),
        F.count(F.lit(1)).alias("n_origins"))
    base = f"max(if(arm = '{baseline}', mae, null)) over (partition by {', '.join(keys)})"
    return errors.selectExpr("*", f"{base} as base_mae").selectExpr(
        "arm", *keys, "mae", "bias", "n_origins", f"{incremental_lift('base_mae', 'mae')} as lift")


def breakdown_cube(results: DataFrame, keys: tuple[str, ...], *, baseline: str = "A") -> DataFrame:
    """:func:`breakdown` for every subset of ``keys`` in one pass over the results.

    ``level`` has a bit for each key that a row sums over, the first key's bit the highest; such
    a key is null.
    """
    errors = results.sparkSession.sql(
        f"select arm, {', '.join(keys)}, grouping_id() as level, avg(abs(actual - predicted)) as mae, "
        f"avg(predicted - actual) as bias, count(*) as n_origins from {{results}} group by arm, cube({', '.join(keys)})", results=results)
    base = f"max(if(arm = '{baseline}', mae, null)) over (partition by level, {', '.join(keys)})"
    return errors.selectExpr("*", f"{base} as base_mae").selectExpr(
        "arm", *keys, "level", "mae", "bias", "n_origins", f"{incremental_lift('base_mae', 'mae')} as lift")


def with_exposure(results: DataFrame, demand: DataFrame, features: DataFrame) -> DataFrame:
    """Add ``exposed``: a signal was active for the entity at the origin's cutoff."""
    cutoffs = demand.selectExpr(
        "entity_key", "week_index as origin_week_index", "cast(period_start as timestamp) as forecast_cutoff")
    active = features.selectExpr(
        "entity_key", "cast(forecast_cutoff as timestamp) as forecast_cutoff", "has_active_signal_30d as exposed")
    at = cutoffs.join(active, ["entity_key", "forecast_cutoff"], "left").drop("forecast_cutoff")
    return results.join(at, ["entity_key", "origin_week_index"], "left").withColumn(
        "exposed", F.coalesce("exposed", F.lit(False)))


def paired_losses(results: DataFrame, *, baseline: str = "A") -> DataFrame:
    """Per entity, origin and horizon: baseline loss minus the arm's loss (positive is better)."""
    place = ["entity_key", "origin_week_index", "horizon_week_index"]
    loss = results.selectExpr("arm", *place, "abs(actual - predicted) as loss")
    base = loss.where(F.col("arm") == baseline).select(*place, F.col("loss").alias("base_loss"))
    return loss.where(F.col("arm") != baseline).join(base, place).withColumn("gain", F.expr("base_loss - loss"))


def bootstrap_lift(paired: DataFrame, *, replicates: int = 500, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Bootstrap interval of each arm's lift, resampling entities.

    Each entity enters a replicate with a Poisson(1) weight read from a hash, so the
    replicates need no shuffle of their own: losses are summed per entity, and entity
    sums fold into ``replicates`` rows per arm map-side.
    """
    per_entity = paired.groupBy("arm", "entity_key").agg(F.sum("base_loss").alias("base"), F.sum("loss").alias("loss"))
    uniform = f"cast(conv(left(md5(concat_ws('|', '{seed}', b, entity_key)), 8), 16, 10) as double) / 4294967296D"
    # Cumulative Poisson(1) probabilities.
    weight = ("case when u < 0.36787944D then 0 when u < 0.73575888D then 1 when u < 0.91969860D then 2 "
              "when u < 0.98101184D then 3 when u < 0.99634015D then 4 when u < 0.99940582D then 5 else 6 end")
    weighted = per_entity.selectExpr("*", f"explode(sequence(1, {replicates})) as b").selectExpr(
        "arm", "b", "base", "loss", f"{uniform} as u").selectExpr("arm", "b", "base", "loss", f"{weight} as w")
    lifts = weighted.groupBy("arm", "b").agg(
        F.expr("sum(w * base) as base"), F.expr("sum(w * loss) as loss")).where("base > 0").selectExpr(
        "arm", "(base - loss) / base as lift")
    low, high = (1 - level) / 2, (1 + level) / 2
    return lifts.groupBy("arm").agg(
        F.expr(f"percentile(lift, {low}) as lift_low"), F.expr("percentile(lift, 0.5) as lift_mid"),
        F.expr(f"percentile(lift, {high}) as lift_high"), F.count(F.lit(1)).alias("replicates"))
