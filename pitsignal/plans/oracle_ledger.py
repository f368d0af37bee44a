"""Check statements for the ledger queries."""

from __future__ import annotations

from pitsignal.plans.oracle_extraction import NOTES, SIGNAL_CTE, TRUTH
from pitsignal.plans.oracle_features import PAIRS, SIGNALS, feature_sql

_GATE = """is_reversal AND forecast_key IS NOT NULL AND abstention_reason IN (
  'reversal requires an unambiguous prior signal',
  'direction detected but signal type/subject unclear; reversal requires an unambiguous prior signal')"""

# Reversals, and the claims open to each (pairs).
_CANDIDATES = f"""
rev AS (SELECT *, row_number() OVER (PARTITION BY forecast_key ORDER BY available_at, source_id) AS i
  FROM signal WHERE {_GATE}),
pair AS (SELECT r.signal_id AS rid, p.signal_id AS pid, p.signal_type AS ptype
  FROM rev r JOIN signal p ON p.forecast_key = r.forecast_key AND p.validation_status = 'PASS' AND NOT p.negated
    AND p.signal_type <> 'NO_SIGNAL' AND p.available_at <= r.authored_at
    AND (r.signal_type = 'OTHER_RELEVANT' OR p.signal_type = r.signal_type)
    AND (p.effective_end IS NULL OR p.effective_end > r.authored_at))"""

# Walk each entity's reversals in order, carrying the links made so far.
LINKS_CTE = f"""{SIGNAL_CTE}, {_CANDIDATES},
revs AS (SELECT r.forecast_key, r.i, r.signal_id, r.signal_type, r.authored_at, r.available_at, r.negated, r.effective_end,
    coalesce(c.base, []) AS base
  FROM rev r LEFT JOIN (SELECT rid, list({{'id': pid, 'kind': ptype}}) AS base FROM pair GROUP BY rid) c ON c.rid = r.signal_id),
fold AS (
  SELECT DISTINCT forecast_key, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(id VARCHAR, target VARCHAR, kind VARCHAR,
    seen TIMESTAMP, negated BOOLEAN, ends TIMESTAMP)[]) AS links FROM rev
  UNION ALL
  SELECT forecast_key, i, CASE WHEN len(open) = 1 THEN list_append(links, {{'id': rid, 'target': open[1].id,
    'kind': open[1].kind, 'seen': available_at, 'negated': negated, 'ends': effective_end}}) ELSE links END
  FROM (SELECT f.forecast_key, r.i, f.links, r.signal_id AS rid, r.available_at, r.negated, r.effective_end,
      list_concat(
        list_filter(r.base, lambda b: NOT list_contains(
          list_transform(list_filter(f.links, lambda l: l.seen <= r.authored_at), lambda l: l.target), b.id)),
        list_transform(list_filter(f.links, lambda l: NOT l.negated AND l.seen <= r.authored_at
            AND (r.signal_type = 'OTHER_RELEVANT' OR l.kind = r.signal_type)
            AND (l.ends IS NULL OR l.ends > r.authored_at)
            AND NOT list_contains(list_transform(list_filter(f.links, lambda m: m.seen <= r.authored_at),
              lambda m: m.target), l.id)),
          lambda l: {{'id': l.id, 'kind': l.kind}})) AS open
    FROM fold f JOIN revs r ON r.forecast_key = f.forecast_key AND r.i = f.i + 1)),
link AS (SELECT l.id AS signal_id, l.target AS target_signal_id, l.kind AS target_type FROM (
  SELECT unnest(links) AS l FROM (SELECT forecast_key, arg_max(links, i) AS links FROM fold GROUP BY forecast_key)))"""

_NATION_SIGNALS = """SELECT s.* REPLACE (n.n_name AS forecast_key), 'ACTIVE' AS record_status
  FROM signal s JOIN customer c ON s.forecast_key = 'CUST-' || CAST(c.c_custkey AS VARCHAR)
  JOIN nation n ON n.n_nationkey = c.c_nationkey"""

WEEKS = """SELECT CAST(unnest(generate_series(
    date_trunc('week', CAST((SELECT min(l_shipdate) FROM lineitem) AS DATE) + INTERVAL 6 DAY),
    date_trunc('week', (SELECT max(l_shipdate) FROM lineitem)) - INTERVAL 7 DAY, INTERVAL 7 DAY)) AS TIMESTAMP) AS forecast_cutoff"""
NATIONS = "SELECT DISTINCT n_name AS entity_key FROM customer JOIN nation ON n_nationkey = c_nationkey"
_GRID = f"SELECT e.entity_key, w.forecast_cutoff FROM ({NATIONS}) e, ({WEEKS}) w"
_CUSTOMERS = "SELECT 'CUST-' || CAST(c_custkey AS VARCHAR) AS entity_key FROM customer"


ORACLE = {
    "reversal_candidates": f"""WITH {SIGNAL_CTE}, {_CANDIDATES}
SELECT r.source_id, r.forecast_key, CAST(count(p.pid) AS BIGINT) AS candidates
FROM rev r LEFT JOIN pair p ON p.rid = r.signal_id GROUP BY ALL""",
    "reversal_links": f"WITH RECURSIVE {LINKS_CTE} SELECT * FROM link",
    "ledger_as_of": f"""WITH sig AS ({SIGNALS}),
v AS (SELECT * FROM sig WHERE available_at <= TIMESTAMP '2024-01-16')
SELECT signal_id, source_id, CASE WHEN signal_id IN (SELECT supersedes_signal_id FROM v
    WHERE validation_status = 'PASS' AND supersedes_signal_id IS NOT NULL) THEN 'SUPERSEDED' ELSE record_status END AS record_status,
  supersedes_signal_id FROM v""",
    "ledger_append": f"""SELECT signal_id, CASE
    WHEN available_at > TIMESTAMP '2024-01-24' THEN 'conflict'
    WHEN available_at > TIMESTAMP '2024-01-16' THEN 'write'
    WHEN signal_type = 'TIMING_REVISION' THEN 'conflict' ELSE 'skip' END AS action FROM ({SIGNALS})""",
    "feature_grid": _GRID,
    "historical_features": f"""WITH RECURSIVE {SIGNAL_CTE}, result AS ({feature_sql(_NATION_SIGNALS, _GRID, 'NULL AS x')})
SELECT r.* EXCLUDE (x) FROM result r, (VALUES (1), (2)) twice(z)""",
    "latest_features": f"""WITH RECURSIVE {SIGNAL_CTE}, result AS ({feature_sql(
        "SELECT *, 'ACTIVE' AS record_status FROM signal",
        f"SELECT entity_key, TIMESTAMP '2001-07-02' AS forecast_cutoff FROM ({_CUSTOMERS})",
        "'fdv-test' AS feature_definition_version, coalesce(ids, '') AS contributing_signal_ids")}) SELECT * FROM result""",
    "oracle_features": f"""WITH t AS ({TRUTH}), notes AS ({NOTES}),
p AS (SELECT e.entity_key, m.forecast_cutoff FROM ({_CUSTOMERS}) e, (SELECT unnest(generate_series(
    (SELECT date_trunc('month', min(o_orderdate)) FROM orders), (SELECT date_trunc('month', max(o_orderdate)) FROM orders),
    INTERVAL 1 MONTH)) AS forecast_cutoff) m),
e AS (SELECT p.entity_key, CAST(p.forecast_cutoff AS TIMESTAMP) AS forecast_cutoff, t.*, n.available_at,
    n.available_at > p.forecast_cutoff - INTERVAL 30 DAY AS in30,
    CASE WHEN direction NOT IN ('INCREASE', 'DECREASE') THEN 0 WHEN (direction = 'INCREASE') = negated THEN -1 ELSE 1 END AS vote
  FROM p LEFT JOIN (t JOIN (SELECT source_id, available_at, mention_1 FROM notes) n USING (source_id))
    ON NOT is_irrelevant AND mention_1 = p.entity_key AND n.available_at <= p.forecast_cutoff
    AND (effective_start IS NULL OR effective_end IS NULL
      OR (effective_start < p.forecast_cutoff + INTERVAL 28 DAY AND effective_end > p.forecast_cutoff))),
a AS (SELECT entity_key, forecast_cutoff, count(*) FILTER (in30) AS n30, count(*) FILTER (in30 AND vote > 0) AS up,
    count(*) FILTER (in30 AND vote < 0) AS down,
    sum(stated_magnitude_value * vote) FILTER (in30 AND stated_magnitude_unit IS DISTINCT FROM '%' AND stated_magnitude_value IS NOT NULL) AS qty,
    max(available_at) AS latest, count(DISTINCT source_id) FILTER (in30) AS sources, count(source_id) AS n_all
  FROM e GROUP BY entity_key, forecast_cutoff)
SELECT entity_key, forecast_cutoff, n30 > 0 AS has_active_signal_30d, CAST(n30 AS BIGINT) AS signal_count_30d,
  CASE WHEN n30 = 0 THEN 'UNKNOWN' WHEN up > 0 AND down > 0 THEN 'MIXED' WHEN up > down THEN 'INCREASE'
       WHEN up < down THEN 'DECREASE' ELSE 'STABLE' END AS net_demand_direction_30d,
  qty AS expected_qty_delta_next_horizon,
  CAST(floor((epoch(forecast_cutoff) - epoch(latest)) / 86400) AS BIGINT) AS days_since_latest_signal,
  CAST(sources AS BIGINT) AS independent_source_count_30d,
  CAST(CASE WHEN up > 0 AND down > 0 THEN 1 ELSE 0 END AS BIGINT) AS active_conflict_count,
  CASE WHEN latest IS NULL THEN 'UNKNOWN' WHEN epoch(forecast_cutoff) - epoch(latest) < 15 * 86400 THEN 'FRESH' ELSE 'STALE' END AS staleness_status,
  CAST(n_all AS BIGINT) AS contributing_signal_count FROM a""",
    "shuffled_features": f"""WITH f AS ({feature_sql(SIGNALS, PAIRS, 'NULL AS x')}),
r AS (SELECT * EXCLUDE (x), row_number() OVER (PARTITION BY forecast_cutoff ORDER BY
    md5('99|row|' || CAST(epoch_us(forecast_cutoff) AS VARCHAR) || '|' || entity_key), entity_key) AS place FROM f),
k AS (SELECT forecast_cutoff, entity_key AS new_entity, row_number() OVER (PARTITION BY forecast_cutoff ORDER BY
    md5('99|key|' || CAST(epoch_us(forecast_cutoff) AS VARCHAR) || '|' || entity_key), entity_key) AS place FROM f)
SELECT r.* EXCLUDE (place) REPLACE (k.new_entity AS entity_key) FROM r JOIN k ON k.forecast_cutoff = r.forecast_cutoff AND k.place = r.place""",
    "shuffle_invariants": f"""WITH f AS ({feature_sql(SIGNALS, PAIRS, 'NULL AS x')})
SELECT forecast_cutoff AS cutoff, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT entity_key) AS BIGINT) AS n_entities,
  CAST(sum(signal_count_30d) AS BIGINT) AS signals, CAST(sum(delay_count_90d) AS BIGINT) AS delays, CAST(0 AS BIGINT) AS lineage
FROM f GROUP BY forecast_cutoff""",
}
