"""Check statements for the feature queries, written independently of the Spark plans:
claims are paired with cutoffs directly and aggregated."""

from __future__ import annotations

from pitsignal.sources.derived import EVENT_SIGNALS_SQL

SIGNALS = EVENT_SIGNALS_SQL.replace("@ts", "TIMESTAMP").format(events="events")

PAIRS = """
  SELECT u.entity_key, c.forecast_cutoff
  FROM (SELECT DISTINCT 'USER-' || CAST(user_id AS VARCHAR) AS entity_key FROM events) u,
       (SELECT unnest(generate_series(
          (SELECT CAST(min(CAST(ts AS DATE)) AS TIMESTAMP) + INTERVAL 1 DAY FROM events),
          (SELECT CAST(max(CAST(ts AS DATE)) AS TIMESTAMP) + INTERVAL 1 DAY FROM events),
          INTERVAL 1 DAY)) AS forecast_cutoff) c
"""

VOTE = """CASE s.direction WHEN 'INCREASE' THEN CASE WHEN s.negated THEN -1 ELSE 1 END
         WHEN 'DECREASE' THEN CASE WHEN s.negated THEN 1 ELSE -1 END ELSE 0 END"""

ELIGIBLE = """s.available_at <= p.forecast_cutoff
    AND (s.effective_start IS NULL OR s.effective_start < p.forecast_cutoff + INTERVAL 28 DAY)
    AND (s.effective_end IS NULL OR s.effective_end > p.forecast_cutoff)"""


def feature_sql(signals: str, pairs: str, extra: str, superseded: str = "") -> str:
    """Direct formulation: pairs LEFT JOIN eligible signals, then GROUP BY."""
    gate = "AND (x.superseded_at IS NULL OR x.superseded_at > p.forecast_cutoff)" if superseded else ""
    join_x = "LEFT JOIN x ON x.target = s.signal_id" if superseded else ""
    cte_x = f", x AS ({superseded})" if superseded else ""
    return f"""
WITH sig AS ({signals}), pairs AS ({pairs}){cte_x},
act AS (SELECT s.*{', x.superseded_at' if superseded else ''} FROM sig s {join_x}
  WHERE record_status = 'ACTIVE' AND validation_status IN ('PASS', 'REVIEW') AND signal_type <> 'NO_SIGNAL'),
e AS (SELECT p.entity_key, p.forecast_cutoff, s.*, {VOTE} AS vote,
    s.available_at > p.forecast_cutoff - INTERVAL 30 DAY AS in30,
    s.available_at > p.forecast_cutoff - INTERVAL 90 DAY AS in90
  FROM pairs p LEFT JOIN act s ON s.forecast_key = p.entity_key AND {ELIGIBLE}
    {gate.replace('x.superseded_at', 's.superseded_at')}),
conf AS (SELECT entity_key, forecast_cutoff, count(*) AS active_conflict_count FROM (
    SELECT entity_key, forecast_cutoff, signal_type FROM e WHERE in30
    GROUP BY ALL HAVING max(vote) = 1 AND min(vote) = -1) GROUP BY ALL),
agg AS (SELECT entity_key, forecast_cutoff,
  CAST(count(*) FILTER (in30) AS BIGINT) AS n30,
  count(*) FILTER (in30 AND vote > 0) AS up, count(*) FILTER (in30 AND vote < 0) AS down,
  sum(magnitude_value * vote) FILTER (in30 AND magnitude_basis IS DISTINCT FROM 'PERCENT') AS qty,
  sum(abs(magnitude_value)) FILTER (in30 AND magnitude_basis IS DISTINCT FROM 'PERCENT'
    AND signal_type = 'ORDER_LIFECYCLE' AND direction = 'DECREASE') AS cancelled,
  sum(abs(magnitude_value)) FILTER (in30 AND magnitude_basis IS DISTINCT FROM 'PERCENT'
    AND NOT (signal_type = 'ORDER_LIFECYCLE' AND direction = 'DECREASE')
    AND business_certainty IN ('ASSERTED', 'EXPECTED')) AS committed,
  count(*) FILTER (in90 AND signal_type = 'TIMING_REVISION' AND direction = 'DECREASE') AS delays,
  CAST(floor(min(epoch(effective_start) - epoch(forecast_cutoff))
    FILTER (effective_start >= forecast_cutoff) / 86400) AS BIGINT) AS nearest,
  CAST(floor((epoch(forecast_cutoff) - max(epoch(available_at))) / 86400) AS BIGINT) AS since,
  count(DISTINCT source_id) FILTER (in30) AS sources,
  count(signal_id) AS n_all,
  string_agg(signal_id, ',' ORDER BY available_at, source_id, signal_id) AS ids
  FROM e GROUP BY entity_key, forecast_cutoff)
SELECT a.entity_key, a.forecast_cutoff, n30 > 0 AS has_active_signal_30d, n30 AS signal_count_30d,
  CASE WHEN n30 = 0 THEN 'UNKNOWN' WHEN up > 0 AND down > 0 THEN 'MIXED' WHEN up > down THEN 'INCREASE'
       WHEN up < down THEN 'DECREASE' ELSE 'STABLE' END AS net_demand_direction_30d,
  round(qty, 4) AS expected_qty_delta_next_horizon, round(committed, 4) AS committed_qty,
  round(cancelled, 4) AS cancelled_qty_30d, CAST(delays AS BIGINT) AS delay_count_90d,
  nearest AS nearest_effective_start_days, since AS days_since_latest_signal,
  CAST(sources AS BIGINT) AS independent_source_count_30d,
  CAST(coalesce(c.active_conflict_count, 0) AS BIGINT) AS active_conflict_count,
  CASE WHEN since IS NULL THEN 'UNKNOWN' WHEN since <= 14 THEN 'FRESH' ELSE 'STALE' END AS staleness_status,
  {extra}
FROM agg a LEFT JOIN conf c USING (entity_key, forecast_cutoff)
"""


SUPERSEDED = """SELECT supersedes_signal_id AS target, min(available_at) AS superseded_at
  FROM sig WHERE validation_status = 'PASS' AND supersedes_signal_id IS NOT NULL GROUP BY ALL"""

ORACLE = {
    "pit_features_events": feature_sql(SIGNALS, PAIRS, "CAST(n_all AS BIGINT) AS contributing_signal_count"),
    "pit_features_own_cutoffs": feature_sql(
        SIGNALS, "SELECT DISTINCT 'USER-' || CAST(user_id AS VARCHAR) AS entity_key, ts AS forecast_cutoff FROM events",
        "CAST(n_all AS BIGINT) AS contributing_signal_count"),
    "pit_features_as_of": feature_sql(SIGNALS, PAIRS, "coalesce(ids, '') AS contributing_signal_ids", SUPERSEDED),
    "contributing_signals": f"""
WITH s AS (SELECT * FROM ({SIGNALS}) WHERE record_status = 'ACTIVE'
    AND validation_status IN ('PASS', 'REVIEW') AND signal_type <> 'NO_SIGNAL'),
p AS ({PAIRS})
SELECT p.entity_key, p.forecast_cutoff, s.signal_id, s.source_id
FROM p JOIN s ON s.forecast_key = p.entity_key AND {ELIGIBLE}""",
}
