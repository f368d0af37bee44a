"""Rolling-origin forecast experiment over weekly demand.

Features are window expressions over each entity's series.  Only the least-squares solve
leaves Spark SQL: one grouped call per (feature table, entity, block of weeks), for all arms
that read the table.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.operators.scan import lag_in_order
from pitsignal.shipping import ship_by_value
from pitsignal.staging import stage

ship_by_value(__name__)

# Numeric signal columns of a feature row that enter the model, and its direction flags.
SIGNAL_COLUMNS = (
    "has_active_signal_30d", "signal_count_30d", "expected_qty_delta_next_horizon", "committed_qty",
    "cancelled_qty_30d", "delay_count_90d", "nearest_effective_start_days", "days_since_latest_signal",
    "independent_source_count_30d", "active_conflict_count",
)
DIRECTION_FLAGS = {"dir_increase": "INCREASE", "dir_decrease": "DECREASE", "dir_mixed": "MIXED"}


@dataclass(frozen=True)
class ForecastConfig:
    """Model settings, the same for every arm."""

    train_weeks: int = 52
    horizon_weeks: int = 4
    min_origins: int = 10
    ridge_alpha: float = 1.0
    lag_weeks: tuple[int, ...] = (1, 2, 4, 8, 13, 26)
    seasonal_period: int = 52
    random_state: int = 42

    @property
    def tabular_columns(self) -> tuple[str, ...]:
        return (*(f"lag_{k}" for k in self.lag_weeks), "seasonal_lag", "rolling_mean_4", "rolling_std_4")

    @property
    def first_training_week(self) -> int:
        return self.lag_weeks[-1] + 4


_SERIES = "(partition by entity_key order by week_index"


def tabular_features(demand: DataFrame, config: ForecastConfig = ForecastConfig(), *, complete_only: bool = True) -> DataFrame:
    """Lag, seasonal and rolling features of each week, from earlier weeks only.

    ``t`` is the position in the entity's series and ``n`` its length.  Weeks without
    all lags are dropped unless ``complete_only`` is false.
    """
    lags = [f"lag(demand, {k}) over {_SERIES}) as lag_{k}" for k in config.lag_weeks]
    earlier = f"over {_SERIES} rows between unbounded preceding and 1 preceding)"
    last4 = f"over {_SERIES} rows between 4 preceding and 1 preceding)"
    features = demand.selectExpr(
        "entity_key", "period_start", "week_index", "demand",
        f"cast(row_number() over {_SERIES}) - 1 as int) as t",
        "cast(count(*) over (partition by entity_key) as int) as n",
        *lags,
        f"coalesce(lag(demand, {config.seasonal_period}) over {_SERIES}), avg(demand) {earlier}, 0.0D) as seasonal_lag",
        f"avg(demand) {last4} as rolling_mean_4", f"stddev_pop(demand) {last4} as rolling_std_4",
    )
    if not complete_only:
        return features
    return features.where(f"t >= {max(4, *config.lag_weeks)}")


def merge_signals(tabular: DataFrame, features: DataFrame | None) -> DataFrame:
    """Attach signal features by (entity, period); a week without a row gets zeros."""
    if features is None:
        zero = [f"0.0D as {c}" for c in (*SIGNAL_COLUMNS, *DIRECTION_FLAGS)]
        return tabular.selectExpr("*", *zero)
    rows = features.selectExpr(
        "entity_key", "cast(forecast_cutoff as timestamp) as _cutoff",
        *(f"cast({c} as double) as {c}" for c in SIGNAL_COLUMNS), "net_demand_direction_30d as _direction")
    weeks = tabular.withColumn("_cutoff", F.col("period_start").cast("timestamp"))
    return weeks.join(rows, ["entity_key", "_cutoff"], "left").selectExpr(
        *tabular.columns,
        *(f"coalesce({c}, 0.0D) as {c}" for c in SIGNAL_COLUMNS),
        *(f"if(_direction <=> '{v}', 1.0D, 0.0D) as {k}" for k, v in DIRECTION_FLAGS.items()))


def origin_schedule(tabular: DataFrame, config: ForecastConfig = ForecastConfig()) -> DataFrame:
    """``(entity_key, origin, origin_week_index, n_train)`` of every fit that takes place."""
    first, enough = config.first_training_week, config.train_weeks + config.min_origins
    usable = f"t >= {first}"
    counted = tabular.selectExpr(
        "entity_key", "t", "n", "week_index",
        f"count_if({usable}) over (partition by entity_key order by t "
        "rows between unbounded preceding and 1 preceding) as n_train")
    return counted.where(
        f"n - {config.horizon_weeks} >= {enough} and n_train >= 10 "
        f"and t between {config.train_weeks} and n - {config.horizon_weeks}"
    ).selectExpr("entity_key", "t as origin", "week_index as origin_week_index", "n_train")


_RESULT = (
    "arm string, entity_key string, origin_week_index int, horizon_week_index int, horizon int, "
    "actual double, predicted double"
)


BLOCK = 512  # weeks of a series that one task fits


def _moments(rows: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """Count, means and centred products of a block's training rows (the target last)."""
    z = rows[[*columns, "demand"]].to_numpy(float)
    centred = z - z.mean(axis=0)
    return pd.DataFrame({"source": rows["source"][:1], "entity_key": rows["entity_key"][:1], "block": rows["block"][:1],
                         "count": float(len(z)), "mean": [z.mean(axis=0)], "spread": [(centred.T @ centred).ravel()]})


def _prefixes(blocks: pd.DataFrame) -> pd.DataFrame:
    """The merged moments of all earlier blocks, for each block of a series but the first."""
    blocks = blocks.sort_values("block", ignore_index=True)
    count, mean, spread, out = 0.0, 0.0, 0.0, []
    for block, n, m, s in zip(blocks["block"], blocks["count"], blocks["mean"], blocks["spread"]):
        apart = np.asarray(m) - mean
        total = count + n
        spread = spread + np.asarray(s) + np.outer(apart, apart).ravel() * (count * n / total)
        mean, count = mean + apart * (n / total), total
        out.append((block + 1, count, mean, spread))
    return pd.DataFrame({"source": blocks["source"], "entity_key": blocks["entity_key"]}).join(
        pd.DataFrame(out, columns=["block", "count", "mean", "spread"]))


def _fit_block(rows: pd.DataFrame, before: pd.DataFrame, config: ForecastConfig, columns: list[str], arms: dict[str, list[str]]) -> pd.DataFrame:
    """All origins of one block and all arms that read its columns: expanding-window ridge.

    The normal equations of an origin are the moments of the earlier blocks and prefix sums
    inside this one.  Products are taken about the mean of the earlier rows, so the sums stay
    small against the values and lose no precision to cancellation.
    """
    rows = rows.sort_values("t", ignore_index=True)
    t, z = rows["t"].to_numpy(), rows[[*columns, "demand"]].to_numpy(float)
    used = (t >= config.first_training_week).astype(float)
    if len(before):
        known, centre = float(before["count"].iloc[0]), np.asarray(before["mean"].iloc[0])
        spread = np.asarray(before["spread"].iloc[0]).reshape(len(centre), -1)
    else:
        known, spread = 0.0, 0.0
        centre = z[used > 0].mean(axis=0) if used.any() else z.mean(axis=0)
    seen = (z != 0).any(axis=0)[:-1] | (np.zeros(len(columns), bool) if not len(before) else (centre[:-1] != 0) | (np.diag(spread)[:-1] > 0))
    zc = z - centre
    prefix = lambda a: np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])[:-1]
    count, sums = known + prefix(used), prefix(zc * used[:, None])
    n = rows["n"].to_numpy()
    at = np.flatnonzero((t >= config.train_weeks) & (t <= n - config.horizon_weeks) & (count >= 10)
                        & (n - config.horizon_weeks - config.train_weeks >= config.min_origins))
    products = spread + prefix(np.einsum("ti,tj->tij", zc * used[:, None], zc))[at]
    m = count[at][:, None]
    moments = products - np.einsum("ti,tj->tij", sums[at], sums[at]) / m[:, :, None]
    level, away = centre[-1] + sums[at][:, -1] / m[:, 0], zc[at] - sums[at] / m
    parts = []
    for arm, names in arms.items():
        # Columns that are zero throughout have no part in the equations.
        k = np.array([i for i, c in enumerate(columns) if c in names and seen[i]], int)
        gram = moments[:, k][:, :, k] + config.ridge_alpha * np.eye(len(k))
        beta = np.linalg.solve(gram, moments[:, k, -1][:, :, None])[:, :, 0]
        predicted = np.maximum(0.0, level + (away[:, k] * beta).sum(axis=1))
        for h in range(1, config.horizon_weeks + 1):
            parts.append(pd.DataFrame({
                "arm": arm, "entity_key": rows["entity_key"].iloc[at], "origin_week_index": rows["week_index"].iloc[at],
                "horizon_week_index": rows[f"week_{h}"].iloc[at], "horizon": h, "actual": rows[f"actual_{h}"].iloc[at],
                "predicted": predicted}))
    return pd.concat(parts, ignore_index=True).dropna(subset=["actual"]).astype({"horizon_week_index": "int32"})


def run_arms(
    demand: DataFrame, arms: dict[str, DataFrame | None], config: ForecastConfig = ForecastConfig(), *,
    columns: dict[str, Iterable[str]] | None = None,
) -> DataFrame:
    """Rolling-origin results of several arms in one job.

    ``arms`` maps a label to its feature table (None: history only).  ``columns`` may
    restrict the model columns of an arm.  The history is windowed once, each feature table is
    joined once, and all arms that read it are solved on the same moments.  A series is cut
    into blocks of ``BLOCK`` weeks that are fitted apart: an associative scan over the blocks'
    moments gives each the sums of the weeks before it.
    """
    series = stage(tabular_features(demand, config).selectExpr(
        "*", f"cast(t div {BLOCK} as int) as block",
        *(f"lead(demand, {h}) over {_SERIES}) as actual_{h}" for h in range(1, config.horizon_weeks + 1)),
        *(f"lead(week_index, {h}) over {_SERIES}) as week_{h}" for h in range(1, config.horizon_weeks + 1))))
    every = [*config.tabular_columns, *SIGNAL_COLUMNS, *DIRECTION_FLAGS]
    tables: list[tuple[DataFrame | None, dict[str, list[str]]]] = []
    for arm, features in arms.items():
        own = next((held for table, held in tables if table is features), None)
        if own is None:
            own = {}
            tables.append((features, own))
        own[arm] = list((columns or {}).get(arm, every))
    stacked = stage(reduce(DataFrame.unionByName, (
        merge_signals(series, features).withColumn("source", F.lit(k)) for k, (features, _) in enumerate(tables))))
    group = ["source", "entity_key", "block"]
    earlier = stacked.where(f"t >= {config.first_training_week} and block < (n - 1) div {BLOCK}").select(*group, *every, "demand")
    state = "source int, entity_key string, block int, count double, mean array<double>, spread array<double>"
    prefixes = earlier.groupBy(*group).applyInPandas(lambda pdf: _moments(pdf, every), state).groupBy(*group[:2]).applyInPandas(_prefixes, state)
    by_source = [held for _, held in tables]
    fit = lambda key, rows, before: _fit_block(rows, before, config, every, by_source[key[0]])
    return stacked.groupBy(*group).cogroup(prefixes.groupBy(*group)).applyInPandas(fit, _RESULT)


def run_arm(demand: DataFrame, arm: str, features: DataFrame | None = None, config: ForecastConfig = ForecastConfig()) -> DataFrame:
    return run_arms(demand, {arm: features}, config)


def simple_forecast(demand: DataFrame, arm: str, predictor: str, config: ForecastConfig = ForecastConfig()) -> DataFrame:
    """The same origins and horizons with one tabular feature as the prediction.

    ``predictor`` is an expression over the tabular columns, such as ``seasonal_lag`` or
    ``lag_1``: the reference points a fitted arm has to beat.
    """
    tabular = tabular_features(demand, config)
    fits = origin_schedule(tabular, config).selectExpr("entity_key", "origin as t", "origin_week_index")
    ahead = ", ".join(
        f"named_struct('horizon', {h}, 'horizon_week_index', lead(week_index, {h}) over {_SERIES}), "
        f"'actual', lead(demand, {h}) over {_SERIES}))" for h in range(1, config.horizon_weeks + 1))
    weeks = tabular.selectExpr("entity_key", "t", f"{predictor} as value", f"array({ahead}) as ahead")
    return fits.join(weeks, ["entity_key", "t"]).selectExpr(
        "entity_key", "origin_week_index", "value", "inline(ahead)",
    ).where("actual is not null").selectExpr(
        f"'{arm}' as arm", "entity_key", "origin_week_index", "horizon_week_index", "horizon", "actual",
        "greatest(0.0D, value) as predicted")


def incremental_lift(baseline: str, enhanced: str) -> str:
    return f"if({baseline} = 0, 0.0D, ({baseline} - {enhanced}) / {baseline})"


def _naive_scale_pooled(results: DataFrame, by: str, period: int) -> DataFrame:
    """Mean absolute ``period``-step difference over the pooled order (entity, origin, horizon), across entities."""
    place = ("entity_key", "origin_week_index", "horizon_week_index")
    lagged = lag_in_order(results.select(by, *place, "actual"), (by,), place, "actual", period)
    return lagged.groupBy(by).agg(F.expr("avg(abs(actual - before)) as scale"))


def _naive_scale_per_entity(results: DataFrame, by: str, period: int) -> DataFrame:
    """Mean absolute ``period``-step difference inside each entity's own results."""
    order = "order by origin_week_index, horizon_week_index"
    return results.selectExpr(
        by, f"abs(actual - lag(actual, {period}) over (partition by {by}, entity_key {order})) as step",
    ).groupBy(by).agg(F.avg("step").alias("scale"))


def arm_metrics(
    results: DataFrame, *, baseline: str | None = "A", scale: str = "pooled", seasonal_period: int = 1, by: str = "arm",
) -> DataFrame:
    """Per arm: MASE, MAE, signed bias, number of results, lift over the baseline arm.

    ``scale="pooled"`` differences all actuals of an arm in (entity, origin, horizon)
    order, ``seasonal_period`` places apart; ``"per_entity"`` does not cross entities.  MASE is null where undefined, and
    the lift is null without a baseline or with a perfect one.
    """
    errors = results.groupBy(by).agg(
        F.expr("avg(abs(actual - predicted)) as mae"), F.expr("avg(predicted - actual) as bias"),
        F.count(F.lit(1)).alias("n_origins"))
    if scale == "per_entity":
        scales = _naive_scale_per_entity(results, by, seasonal_period)
    elif scale == "pooled":
        scales = _naive_scale_pooled(results, by, seasonal_period)
    else:
        raise ValueError("scale must be 'pooled' or 'per_entity'")
    joined = errors.join(scales, by)
    base = f"max(if({by} = '{baseline}', mae, null)) over ()" if baseline else "cast(null as double)"
    return joined.selectExpr("*", f"{base} as base_mae").selectExpr(
        by, "mae / nullif(scale, 0) as mase", "mae", "bias", "n_origins",
        f"if(base_mae = 0, null, {incremental_lift('base_mae', 'mae')}) as incremental_lift_vs_a")


def decision(metrics: DataFrame) -> DataFrame:
    """One row: lifts of the arms and what they say about signal and extraction."""
    one = metrics.groupBy().agg(*(
        F.expr(f"max(if(arm = '{a}', mae, null)) as {a.lower()}_mae") for a in ("A", "B", "C", "D")))
    lift = lambda m: f"if(a_mae > 0, (a_mae - {m}) / a_mae, 0.0D)"
    return one.selectExpr(
        *(f"{lift(f'{a}_mae')} as {a}_lift" for a in ("b", "c", "d")),
    ).selectExpr(
        "*",
        "case when d_lift > 0.02 then 'investigate_leakage' when b_lift < 0.01 then 'no_forecastable_signal' "
        "when c_lift < 0.005 then 'extraction_is_bottleneck' else 'extraction_retains_lift' end as branch",
        "case when d_lift > 0.02 or b_lift < 0.01 or c_lift < 0.005 then null else c_lift / b_lift end as retained",
    )
