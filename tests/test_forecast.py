import numpy as np
import pandas as pd
import pytest

from pitsignal.operators import forecast
from pitsignal.operators.comparison import bootstrap_lift, breakdown, breakdown_cube, paired_losses
from pitsignal.operators.forecast import (
    SIGNAL_COLUMNS, ForecastConfig, arm_metrics, decision, merge_signals, run_arms, tabular_features,
)
from pitsignal.operators.scan import lag_in_order

CONFIG = ForecastConfig(train_weeks=40, horizon_weeks=2, min_origins=5)


def demand_pandas(entities=3, weeks=80, level=100.0, seed=1):
    rng = np.random.default_rng(seed)
    return pd.concat([pd.DataFrame({
        "entity_key": f"E{e}", "week_index": np.arange(weeks, dtype="int32"),
        "period_start": pd.date_range("2024-01-01", periods=weeks, freq="7D").date,
        "demand": level + 20 * np.sin(2 * np.pi * np.arange(weeks) / 52) + rng.normal(0, 5, weeks),
    }) for e in range(entities)])


def demand_frame(spark, pdf):
    return spark.createDataFrame(pdf, "entity_key string, week_index int, period_start date, demand double")


def feature_frame(spark, pdf, seed=3):
    rng = np.random.default_rng(seed)
    rows = pdf[["entity_key", "period_start"]].copy()
    rows["forecast_cutoff"] = pd.to_datetime(rows.pop("period_start"))
    for c in SIGNAL_COLUMNS:
        rows[c] = rng.integers(0, 4, len(rows)).astype(float)
    rows["has_active_signal_30d"] = rows["signal_count_30d"] > 0
    rows["net_demand_direction_30d"] = rng.choice(["INCREASE", "DECREASE", "MIXED", "STABLE"], len(rows))
    return rows, spark.createDataFrame(rows)


def features_at(series, t, config):
    """Tabular features of week ``t`` written out directly."""
    row = {f"lag_{k}": series[t - k] for k in config.lag_weeks}
    row["seasonal_lag"] = series[t - 52] if t >= 52 else series[:t].mean()
    row["rolling_mean_4"], row["rolling_std_4"] = series[t - 4:t].mean(), series[t - 4:t].std()
    return row


def direct_ridge(pdf, config, signals=None):
    """Refit at every origin from scratch with the normal equations."""
    out = {}
    for entity, g in pdf.groupby("entity_key"):
        y = g["demand"].to_numpy()
        extra = None if signals is None else signals[signals.entity_key == entity].reset_index(drop=True)

        def row(t):
            r = features_at(y, t, config)
            if extra is not None:
                s = extra.iloc[t]
                r |= {c: float(s[c]) for c in SIGNAL_COLUMNS}
                for name, value in (("dir_increase", "INCREASE"), ("dir_decrease", "DECREASE"), ("dir_mixed", "MIXED")):
                    r[name] = float(s["net_demand_direction_30d"] == value)
            return list(r.values())

        n = len(y)
        for origin in range(config.train_weeks, n - config.horizon_weeks + 1):
            weeks = range(config.lag_weeks[-1] + 4, origin)
            if len(weeks) < 10:
                continue
            x, target = np.array([row(t) for t in weeks]), y[list(weeks)]
            xc, yc = x - x.mean(0), target - target.mean()
            beta = np.linalg.solve(xc.T @ xc + config.ridge_alpha * np.eye(x.shape[1]), xc.T @ yc)
            p = max(0.0, target.mean() + (np.array(row(origin)) - x.mean(0)) @ beta)
            for h in range(1, config.horizon_weeks + 1):
                if origin + h < n:
                    out[entity, origin, origin + h] = (y[origin + h], p)
    return out


@pytest.mark.parametrize("level", [100.0, 1e6])
def test_rolling_ridge_equals_refitting_at_every_origin(spark, level):
    pdf = demand_pandas(level=level)
    signals, frame = feature_frame(spark, pdf)
    got = run_arms(demand_frame(spark, pdf), {"A": None, "B": frame}, CONFIG).toPandas()
    for arm, extra in (("A", None), ("B", signals)):
        want = direct_ridge(pdf, CONFIG, extra)
        mine = {(r.entity_key, r.origin_week_index, r.horizon_week_index): (r.actual, r.predicted)
                for r in got[got.arm == arm].itertuples()}
        assert mine.keys() == want.keys()
        for k in want:
            assert mine[k] == pytest.approx(want[k], rel=1e-6)


def test_short_series_and_few_training_rows_are_skipped(spark):
    pdf = pd.concat([demand_pandas(1, 80), demand_pandas(1, 46).assign(entity_key="short")])
    results = run_arms(demand_frame(spark, pdf), {"A": None}, CONFIG)
    assert {r[0] for r in results.select("entity_key").distinct().collect()} == {"E0"}
    assert results.where("horizon_week_index <= origin_week_index or predicted < 0").count() == 0


def test_history_never_looks_ahead(spark):
    pdf = demand_pandas(1)
    changed = pdf.copy()
    changed.loc[changed.week_index >= 60, "demand"] += 1000
    frames = [tabular_features(demand_frame(spark, p)).where("t <= 60").drop("demand", "n").orderBy("t").toPandas()
              for p in (pdf, changed)]
    pd.testing.assert_frame_equal(*frames)


def test_missing_signal_rows_and_nulls_become_zero(spark):
    pdf = demand_pandas(1)
    signals, _ = feature_frame(spark, pdf)
    signals = signals[signals.index % 2 == 0].assign(committed_qty=np.nan)
    merged = merge_signals(tabular_features(demand_frame(spark, pdf)), spark.createDataFrame(signals)).toPandas()
    assert len(merged) == 80 - 26 and not merged.isna().any().any() and (merged["committed_qty"] == 0).all()


def results_frame(spark, rows):
    return spark.createDataFrame(
        [(a, e, o, o + h, h, float(y), float(p)) for a, e, o, h, y, p in rows],
        "arm string, entity_key string, origin_week_index int, horizon_week_index int, horizon int, actual double, predicted double")


def test_metrics_by_hand(spark):
    rows = [("A", "x", i, 1, y, y - 1) for i, y in enumerate([1, 2, 3, 4, 5])]
    rows += [("B", "x", i, 1, y, y) for i, y in enumerate([1, 2, 3, 4, 5])]
    rows += [("C", "x", i, 1, 7, 8) for i in range(3)]  # flat: no scale
    got = {r["arm"]: r for r in arm_metrics(results_frame(spark, rows)).collect()}
    assert (got["A"]["mase"], got["A"]["mae"], got["A"]["bias"], got["A"]["incremental_lift_vs_a"]) == (1.0, 1.0, -1.0, 0.0)
    assert (got["B"]["mase"], got["B"]["incremental_lift_vs_a"]) == (0.0, 1.0)
    assert got["C"]["mase"] is None and got["C"]["bias"] == 1.0
    none = {r["arm"]: r for r in arm_metrics(results_frame(spark, rows), baseline=None).collect()}
    assert none["B"]["incremental_lift_vs_a"] is None
    perfect = {r["arm"]: r for r in arm_metrics(results_frame(spark, rows), baseline="B").collect()}
    assert perfect["A"]["incremental_lift_vs_a"] is None


def test_pooled_scale_crosses_entities_and_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [(a, f"e{e:02d}", o, h, rng.integers(1, 100), rng.integers(1, 100))
            for a in "AB" for e in range(15) for o in range(6) for h in (1, 2)]
    got = {r["arm"]: r["mase"] for r in arm_metrics(results_frame(spark, rows).repartition(6)).collect()}
    for arm in "AB":
        mine = sorted(r for r in rows if r[0] == arm)
        y, p = np.array([r[4] for r in mine], float), np.array([r[5] for r in mine], float)
        assert got[arm] == pytest.approx(np.abs(y - p).mean() / np.abs(np.diff(y)).mean())


@pytest.mark.parametrize("mae,branch", [
    ((10, 9, 9.2, 9.7), "investigate_leakage"), ((10, 9.95, 9, 10), "no_forecastable_signal"),
    ((10, 9, 9.97, 10), "extraction_is_bottleneck"), ((10, 9, 9.5, 10), "extraction_retains_lift")])
def test_decision_branches(spark, mae, branch):
    row = decision(spark.createDataFrame([(a, float(m)) for a, m in zip("ABCD", mae)], "arm string, mae double")).first()
    assert row["branch"] == branch
    assert (row["retained"] is not None) == (branch == "extraction_retains_lift")


def test_comparisons(spark):
    rows = [(a, f"e{e}", o, h, 10, 10 + miss) for e in range(8) for o in range(5) for h in (1, 2)
            for a, miss in (("A", 2), ("B", 1))]
    frame = results_frame(spark, rows)
    assert {(r["arm"], r["horizon"], r["lift"]) for r in breakdown(frame, ("horizon",)).collect()} == {
        ("A", 1, 0.0), ("A", 2, 0.0), ("B", 1, 0.5), ("B", 2, 0.5)}
    paired = paired_losses(frame)
    assert paired.count() == 80 and {r[0] for r in paired.select("gain").collect()} == {1.0}
    band = bootstrap_lift(paired, replicates=50).first()
    assert (band["lift_low"], band["lift_mid"], band["lift_high"]) == (0.5, 0.5, 0.5)


@pytest.mark.parametrize("block", [7, 16, 30])
def test_blocks_of_a_series_equal_refitting(spark, monkeypatch, block):
    monkeypatch.setattr(forecast, "BLOCK", block)
    pdf = demand_pandas(entities=2, level=1e5, seed=5)
    signals, frame = feature_frame(spark, pdf)
    columns = {"B": ("lag_1", "rolling_mean_4", "signal_count_30d")}
    got = run_arms(demand_frame(spark, pdf), {"A": None, "B": frame, "C": frame}, CONFIG, columns=columns).toPandas()
    for arm, extra in (("A", None), ("C", signals)):
        want = direct_ridge(pdf, CONFIG, extra)
        mine = {(r.entity_key, r.origin_week_index, r.horizon_week_index): (r.actual, r.predicted) for r in got[got.arm == arm].itertuples()}
        assert mine.keys() == want.keys()
        assert all(mine[k] == pytest.approx(want[k], rel=1e-6) for k in want)
    alone = run_arms(demand_frame(spark, pdf), {"B": frame}, CONFIG, columns=columns).toPandas()
    key = ["entity_key", "origin_week_index", "horizon"]
    b = got[got.arm == "B"].sort_values(key)["predicted"].to_numpy()
    assert len(b) and b == pytest.approx(alone.sort_values(key)["predicted"].to_numpy(), rel=1e-9)


@pytest.mark.parametrize("steps", [1, 3, 40])
def test_pooled_lag_over_ranges(spark, steps):
    rng = np.random.default_rng(steps)
    pdf = pd.DataFrame({"arm": rng.choice(["A", "B"], 300, p=[0.9, 0.1]), "place": rng.permutation(300), "v": rng.normal(size=300)})
    got = lag_in_order(spark.createDataFrame(pdf).repartition(4), ("arm",), ("place",), "v", steps).toPandas()
    want = pdf.sort_values("place").assign(before=lambda d: d.groupby("arm")["v"].shift(steps))
    a, b = (d.sort_values("place")[["place", "v", "before"]].to_numpy() for d in (got, want))
    assert np.array_equal(a, b, equal_nan=True)


def test_breakdown_cube_holds_every_breakdown(spark):
    rows = [(a, h, s, float(i % 7), float(i % 5)) for i, (a, h, s) in enumerate((a, h, s) for a in "AB" for h in (1, 2) for s in "xyx" for _ in range(3))]
    results = spark.createDataFrame(rows, "arm string, horizon int, segment string, actual double, predicted double")
    cube = breakdown_cube(results, ("horizon", "segment"))
    for level, keys in ((0, ("horizon", "segment")), (1, ("horizon",)), (2, ("segment",))):
        one = breakdown(results, keys)
        assert cube.where(f"level = {level}").select(one.columns).exceptAll(one).count() == 0
        assert cube.where(f"level = {level}").count() == one.count()
    assert cube.where("level = 3").count() == 2
