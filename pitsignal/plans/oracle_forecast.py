"""Check statements for the forecast queries."""

from __future__ import annotations

from pitsignal.plans.oracle_extraction import SIGNAL_CTE
from pitsignal.plans.oracle_features import feature_sql
from pitsignal.plans.oracle_ledger import _GRID, _NATION_SIGNALS, NATIONS, WEEKS

_DEMAND = f"""
week AS ({WEEKS}),
total AS (SELECT n_name AS entity_key, date_trunc('week', l_shipdate) AS w, sum(l_quantity) AS q
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
demand AS (SELECT e.entity_key, CAST(week.forecast_cutoff AS DATE) AS period_start,
  CAST(row_number() OVER (PARTITION BY e.entity_key ORDER BY week.forecast_cutoff) - 1 AS BIGINT) AS week_index,
  coalesce(t.q, 0) AS demand
  FROM ({NATIONS}) e CROSS JOIN week LEFT JOIN total t ON t.entity_key = e.entity_key AND t.w = week.forecast_cutoff)"""

_W = "OVER (PARTITION BY entity_key ORDER BY week_index"
_TABULAR = f"""{_DEMAND},
raw AS (SELECT *, week_index AS t, count(*) OVER (PARTITION BY entity_key) AS n,
  {', '.join(f'lag(demand, {k}) {_W}) AS lag_{k}' for k in (1, 2, 4, 8, 13, 26))},
  coalesce(lag(demand, 52) {_W}), avg(demand) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seasonal_lag,
  avg(demand) {_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rolling_mean_4,
  stddev_pop(demand) {_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rolling_std_4 FROM demand),
tab AS (SELECT * FROM raw WHERE t >= 26),
fit AS (SELECT a.entity_key, a.t AS origin, count(b.t) AS n_train FROM tab a
  LEFT JOIN tab b ON b.entity_key = a.entity_key AND b.t >= 30 AND b.t < a.t
  WHERE a.n - 4 - 52 >= 10 AND a.t BETWEEN 52 AND a.n - 4 GROUP BY ALL HAVING count(b.t) >= 10)"""

_COLS = ("lag_1", "lag_2", "lag_4", "lag_8", "lag_13", "lag_26", "seasonal_lag", "rolling_mean_4", "rolling_std_4")

_ARMS = f"""{_TABULAR},
res AS (SELECT p.arm, f.entity_key, f.origin, h.h, d.demand AS actual, greatest(0, CASE p.arm WHEN 'A' THEN t.seasonal_lag
    WHEN 'B' THEN t.rolling_mean_4 WHEN 'C' THEN (t.rolling_mean_4 + t.seasonal_lag) / 2 ELSE t.lag_1 END) AS predicted
  FROM fit f JOIN tab t ON t.entity_key = f.entity_key AND t.t = f.origin
  CROSS JOIN (VALUES (1), (2), (3), (4)) h(h) CROSS JOIN (VALUES ('A'), ('B'), ('C'), ('D')) p(arm)
  JOIN demand d ON d.entity_key = f.entity_key AND d.week_index = f.origin + h.h),
err AS (SELECT arm, avg(abs(actual - predicted)) AS mae, avg(predicted - actual) AS bias, count(*) AS n_origins FROM res GROUP BY arm),
sc AS (SELECT arm, avg(step) AS scale FROM (SELECT arm, abs(actual - lag(actual) OVER (PARTITION BY arm ORDER BY entity_key, origin, h)) AS step
  FROM res) GROUP BY arm),
met AS (SELECT e.*, mae / nullif(scale, 0) AS mase, (SELECT mae FROM err WHERE arm = 'A') AS base FROM err e JOIN sc USING (arm))"""

ORACLE = {
    "weekly_demand": f"WITH {_DEMAND} SELECT * FROM demand",
    "demand_quality": f"""WITH {_DEMAND}, l AS (SELECT *, lag(demand, 52) {_W}) AS ago FROM demand)
SELECT entity_key, CAST(count(*) AS BIGINT) AS weeks, CAST(max(week_index) + 1 - count(DISTINCT week_index) AS BIGINT) AS missing_weeks,
  CAST(count(*) FILTER (demand < 0) AS BIGINT) AS negative_weeks, CAST(count(*) FILTER (NOT isfinite(demand)) AS BIGINT) AS not_finite_weeks,
  round(stddev_samp(demand), 6) AS spread, round(corr(demand, ago) FILTER (ago IS NOT NULL), 6) AS yearly_correlation FROM l GROUP BY entity_key""",
    "demand_sanity": f"""WITH {_DEMAND}, l AS (SELECT *, lag(demand, 52) {_W}) AS ago FROM demand),
e AS (SELECT entity_key, count(*) AS weeks, max(week_index) AS top, min(demand) AS low, stddev_samp(demand) AS spread,
  corr(demand, ago) FILTER (ago IS NOT NULL) AS r FROM l GROUP BY entity_key)
SELECT CAST(count(*) AS BIGINT) AS entities, min(weeks) = max(weeks) AND max(top) = min(weeks) - 1 AS dense, min(low) >= 0 AS non_negative,
  true AS finite, min(spread) > 0 AS varies, avg(r) > 0 AS seasonal FROM e""",
    "tabular_features": f"WITH {_TABULAR} SELECT entity_key, t, demand, {', '.join(f'round({c}, 6) AS {c}' for c in _COLS)} FROM tab",
    "merged_features": f"""WITH RECURSIVE {SIGNAL_CTE}, {_TABULAR}, ft AS ({feature_sql(_NATION_SIGNALS, _GRID, 'NULL AS x')})
SELECT tab.entity_key, tab.t, round(lag_1, 6) AS lag_1, CAST(signal_count_30d AS DOUBLE) AS signal_count_30d,
  CAST(has_active_signal_30d AS DOUBLE) AS has_active_signal_30d,
  coalesce(expected_qty_delta_next_horizon, 0) AS expected_qty_delta_next_horizon,
  CAST(coalesce(nearest_effective_start_days, 0) AS DOUBLE) AS nearest_effective_start_days,
  CAST(coalesce(days_since_latest_signal, 0) AS DOUBLE) AS days_since_latest_signal,
  CAST(independent_source_count_30d AS DOUBLE) AS independent_source_count_30d,
  CAST(active_conflict_count AS DOUBLE) AS active_conflict_count,
  CASE WHEN net_demand_direction_30d = 'INCREASE' THEN 1.0::DOUBLE ELSE 0 END AS dir_increase,
  CASE WHEN net_demand_direction_30d = 'DECREASE' THEN 1.0::DOUBLE ELSE 0 END AS dir_decrease,
  CASE WHEN net_demand_direction_30d = 'MIXED' THEN 1.0::DOUBLE ELSE 0 END AS dir_mixed
FROM tab LEFT JOIN ft ON ft.entity_key = tab.entity_key AND ft.forecast_cutoff = tab.period_start""",
    "origin_schedule": f"WITH {_TABULAR} SELECT entity_key, origin, CAST(n_train AS BIGINT) AS n_train FROM fit",
    "ridge_one_feature": f"""WITH {_TABULAR},
m AS (SELECT f.entity_key, f.origin, avg(b.lag_1) AS mx, avg(b.demand) AS my,
    covar_pop(b.demand, b.lag_1) * count(*) AS sxy, var_pop(b.lag_1) * count(*) AS sxx
  FROM fit f JOIN tab b ON b.entity_key = f.entity_key AND b.t >= 30 AND b.t < f.origin GROUP BY ALL)
SELECT m.entity_key, m.origin, CAST(h.h AS BIGINT) AS horizon, d.demand AS actual,
  round(greatest(0, my + sxy / (sxx + 1) * (x.lag_1 - mx)), 4) AS predicted
FROM m JOIN tab x ON x.entity_key = m.entity_key AND x.t = m.origin CROSS JOIN (VALUES (1), (2), (3), (4)) h(h)
JOIN demand d ON d.entity_key = m.entity_key AND d.week_index = m.origin + h.h""",
    "ridge_two_features": f"""WITH {_TABULAR},
mo AS (SELECT f.entity_key, f.origin, avg(b.lag_1) AS mx, avg(b.rolling_mean_4) AS mz, avg(b.demand) AS my, count(*) AS m,
    var_pop(b.lag_1) AS xx, var_pop(b.rolling_mean_4) AS zz, covar_pop(b.lag_1, b.rolling_mean_4) AS xz,
    covar_pop(b.demand, b.lag_1) AS xy, covar_pop(b.demand, b.rolling_mean_4) AS zy
  FROM fit f JOIN tab b ON b.entity_key = f.entity_key AND b.t >= 30 AND b.t < f.origin GROUP BY ALL),
s AS (SELECT *, (m * xx + 1) * (m * zz + 1) - m * xz * m * xz AS det FROM mo)
SELECT s.entity_key, s.origin, CAST(h.h AS BIGINT) AS horizon, d.demand AS actual, round(greatest(0, my
    + (s.m * xy * (s.m * zz + 1) - s.m * zy * s.m * xz) / det * (x.lag_1 - mx)
    + ((s.m * xx + 1) * s.m * zy - s.m * xz * s.m * xy) / det * (x.rolling_mean_4 - mz)), 4) AS predicted
FROM s JOIN tab x ON x.entity_key = s.entity_key AND x.t = s.origin CROSS JOIN (VALUES (1), (2), (3), (4)) h(h)
JOIN demand d ON d.entity_key = s.entity_key AND d.week_index = s.origin + h.h""",
    "arm_metrics_pooled_4": f"""WITH {_ARMS}, s4 AS (SELECT arm, avg(step) AS scale FROM (
  SELECT arm, abs(actual - lag(actual, 4) OVER (PARTITION BY arm ORDER BY entity_key, origin, h)) AS step FROM res) GROUP BY arm)
SELECT arm, round(mae / scale, 6) AS mase, CAST(n_origins AS BIGINT) AS n_origins FROM err JOIN s4 USING (arm)""",
    "arm_metrics": f"""WITH {_ARMS} SELECT arm, round(mase, 6) AS mase, round(mae, 6) AS mae, round(bias, 6) AS bias,
  CAST(n_origins AS BIGINT) AS n_origins, round((base - mae) / base, 6) AS incremental_lift_vs_a FROM met""",
    "arm_metrics_per_entity": f"""WITH {_ARMS}, s4 AS (SELECT arm, avg(step) AS scale FROM (
  SELECT arm, abs(actual - lag(actual, 4) OVER (PARTITION BY arm, entity_key ORDER BY origin, h)) AS step FROM res) GROUP BY arm)
SELECT arm, round(mae / scale, 6) AS mase, CAST(n_origins AS BIGINT) AS n_origins FROM err JOIN s4 USING (arm)""",
    "decision_branch": f"""WITH {_ARMS}, l AS (SELECT max((base - mae) / base) FILTER (arm = 'B') AS b, max((base - mae) / base) FILTER (arm = 'C') AS c,
  max((base - mae) / base) FILTER (arm = 'D') AS d FROM met)
SELECT round(b, 6) AS b_lift, round(c, 6) AS c_lift, round(d, 6) AS d_lift, CASE WHEN d > 0.02 THEN 'investigate_leakage'
  WHEN b < 0.01 THEN 'no_forecastable_signal' WHEN c < 0.005 THEN 'extraction_is_bottleneck' ELSE 'extraction_retains_lift' END AS branch,
  CASE WHEN d > 0.02 OR b < 0.01 OR c < 0.005 THEN NULL ELSE round(c / b, 6) END AS retained FROM l""",
}
