"""Check statements for the monitoring queries."""

from __future__ import annotations

from pitsignal.plans.oracle_extraction import NOTES, ORACLE as _EXTRACTION, SIGNAL_CTE
from pitsignal.plans.oracle_features import ELIGIBLE, PAIRS, SIGNALS
from pitsignal.plans.oracle_forecast import _ARMS, _TABULAR

_LINKS = f"""s AS (SELECT * FROM ({SIGNALS}) WHERE record_status = 'ACTIVE' AND validation_status IN ('PASS', 'REVIEW')
  AND signal_type <> 'NO_SIGNAL'), p AS ({PAIRS}),
l AS (SELECT p.entity_key, p.forecast_cutoff, s.available_at FROM p JOIN s ON s.forecast_key = p.entity_key AND {ELIGIBLE})"""

_VALUES = """v AS (SELECT event_type, value, CASE WHEN d >= 10 THEN CAST(d // 5 AS BIGINT) END AS part
  FROM (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d FROM events))"""

_KS = f"""{_VALUES}, w AS (SELECT DISTINCT event_type, part FROM v WHERE part IS NOT NULL),
pts AS (SELECT w.event_type, w.part, v.value, v.part IS NULL AS ref FROM w JOIN v ON v.event_type = w.event_type AND (v.part IS NULL OR v.part = w.part)),
c AS (SELECT event_type, part, count(*) FILTER (ref) OVER o AS cr, count(*) FILTER (NOT ref) OVER o AS cm,
    count(*) FILTER (ref) OVER (PARTITION BY event_type, part) AS n_ref, count(*) FILTER (NOT ref) OVER (PARTITION BY event_type, part) AS n_mon
  FROM pts WINDOW o AS (PARTITION BY event_type, part ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ks AS (SELECT event_type AS feature, part, n_ref, n_mon, max(abs(cr / n_ref - cm / n_mon)) AS distance,
  1.3581015 * sqrt((n_ref + n_mon) / (n_ref * n_mon)) AS critical FROM c GROUP BY event_type, part, n_ref, n_mon)"""

_CHI = f"""{_VALUES}, w2 AS (SELECT DISTINCT part FROM v WHERE part IS NOT NULL),
k AS (SELECT w2.part, event_type, count(*) FILTER (v.part IS NULL) AS r, count(*) FILTER (v.part IS NOT NULL) AS m
  FROM w2 JOIN v ON v.part IS NULL OR v.part = w2.part GROUP BY ALL),
t AS (SELECT part, sum(r) AS nr, sum(m) AS nm, count(*) AS k FROM k GROUP BY part),
chi AS (SELECT part, nr, nm, t.k AS k, sum(pow(r - (r + m) * nr / (nr + nm), 2) / ((r + m) * nr / (nr + nm))
    + pow(m - (r + m) * nm / (nr + nm), 2) / ((r + m) * nm / (nr + nm))) AS x2 FROM k JOIN t USING (part) GROUP BY part, nr, nm, t.k)"""

_DAILY = _KS.replace("CASE WHEN d >= 10 THEN CAST(d // 5 AS BIGINT) END", "CASE WHEN d >= 10 THEN CAST(d AS BIGINT) END")
_LEAD = f"""WITH RECURSIVE {_DAILY},
f AS (SELECT feature, part, distance > critical AND distance >= 0.01 AS fired FROM ks),
al AS (SELECT feature, min(part) AS first_alert FROM (SELECT *, lag(fired) OVER p AS before, lag(part) OVER p AS last FROM f
  WINDOW p AS (PARTITION BY feature ORDER BY part)) WHERE fired AND before AND last = part - 1 GROUP BY feature),
lv AS (SELECT event_type, avg(value) AS mean, var_pop(value) AS spread FROM v WHERE part IS NULL GROUP BY event_type),
lo AS (SELECT event_type AS feature, part, avg((value - mean) * (value - mean)) / any_value(spread) - 1 AS loss,
  row_number() OVER (PARTITION BY event_type ORDER BY part) AS k FROM v JOIN lv USING (event_type) WHERE part IS NOT NULL GROUP BY event_type, part),
cu AS (SELECT feature, part, k, greatest(0, loss) AS s FROM lo WHERE k = 1
  UNION ALL SELECT lo.feature, lo.part, lo.k, greatest(0, cu.s + lo.loss) FROM cu JOIN lo ON lo.feature = cu.feature AND lo.k = cu.k + 1),
co AS (SELECT a.feature, min(a.part) AS confirmed FROM cu a JOIN cu b ON b.feature = a.feature AND b.part = a.part - 1 WHERE a.s > 0.1 AND b.s > 0.1 GROUP BY a.feature)
SELECT feature, first_alert, confirmed, confirmed - first_alert AS lead FROM al FULL JOIN co USING (feature)"""


def _shift(source: str) -> str:
    """Profiles straight from the texts: shares of every cell in each window and overall."""
    return f"""WITH d AS (SELECT {source}), n AS (SELECT part, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM d),
w AS (SELECT part, unnest(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+')) AS word FROM d),
c AS (SELECT 'length' AS feature, part, CASE WHEN n < 64 THEN n ELSE n - n % CAST(pow(2, length(bin(n)) - 6) AS BIGINT) END AS cell FROM n
  UNION ALL SELECT 'vocabulary', part, CAST('0x' || substr(md5(word), 1, 3) AS BIGINT) FROM w WHERE word <> ''),
g AS (SELECT feature, part, cell, count(*) AS m FROM c GROUP BY ALL), r AS (SELECT feature, cell, sum(m) AS r FROM g GROUP BY ALL),
p AS (SELECT DISTINCT feature, part FROM g),
j AS (SELECT p.feature, p.part, r.cell, coalesce(g.m, 0) AS m, r.r AS r FROM p JOIN r ON r.feature = p.feature
  LEFT JOIN g ON g.feature = p.feature AND g.part = p.part AND g.cell = r.cell),
s AS (SELECT *, sum(m) OVER o AS cm, sum(r) OVER o AS cr, sum(m) OVER a AS nm, sum(r) OVER a AS nr FROM j
  WINDOW o AS (PARTITION BY feature, part ORDER BY cell), a AS (PARTITION BY feature, part))
SELECT feature, part, CAST(nm AS BIGINT) AS n_mon, CAST(nr AS BIGINT) AS n_ref, round(max(abs(cm / nm - cr / nr)), 6) AS steps,
  round(sum(abs(m / nm - r / nr)) / 2, 6) AS variation FROM s GROUP BY feature, part, nm, nr"""


_FIELDS = ("signal_type", "direction", "business_certainty", "conditionality", "condition_text", "negated", "magnitude_value",
           "magnitude_unit", "effective_start", "effective_end", "forecast_key", "validation_status")
_CHANNEL = """CASE WHEN {p}.signal_type = 'SUPPLY_FULFILLMENT' THEN 'FULFILLMENT'
  WHEN {p}.signal_type IN ('OTHER_RELEVANT', 'NO_SIGNAL') THEN 'UNKNOWN' ELSE 'DEMAND' END"""
_CORRECTED = SIGNAL_CTE.replace(NOTES, f"""SELECT * REPLACE (
  replace(replace(raw_text, 'might', 'will'), 'purchase volume', 'inventory') AS raw_text) FROM ({NOTES})""")

ORACLE = {
    "pit_violations": f"WITH {_LINKS} SELECT CAST(count(*) AS BIGINT) AS links, CAST(0 AS BIGINT) AS untraced, "
                      "CAST(count(*) FILTER (available_at > forecast_cutoff) AS BIGINT) AS violations FROM l",
    "feature_freshness": f"""WITH {_LINKS} SELECT entity_key, forecast_cutoff,
  CAST(epoch(TIMESTAMP '2024-02-01') - epoch(max(available_at)) AS BIGINT) AS freshness_seconds FROM l GROUP BY entity_key, forecast_cutoff""",
    "value_drift": f"""WITH {_KS} SELECT feature, part, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_mon AS BIGINT) AS n_mon,
  round(distance, 6) AS distance, round(critical, 6) AS critical FROM ks""",
    "mix_drift": f"""WITH {_CHI} SELECT 'event_type' AS feature, part, CAST(nr AS BIGINT) AS n_ref, CAST(nm AS BIGINT) AS n_mon,
  CAST(k - 1 AS BIGINT) AS degrees, round(x2, 6) AS chi_square, round(sqrt(x2 / (nr + nm)), 6) AS effect FROM chi""",
    "drift_alerts": f"""WITH {_KS}, {_CHI.replace(_VALUES + ', ', '')},
f AS (SELECT feature, part, distance > critical AND distance >= 0.01 AS fired FROM ks UNION ALL
  SELECT 'event_type', part, (cbrt(x2 / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))) > 1.645 AND sqrt(x2 / (nr + nm)) >= 0.01 FROM chi)
SELECT feature, part, fired, fired AND coalesce(lag(fired) OVER (PARTITION BY feature ORDER BY part), false) AS alert, false AS critical FROM f""",
    "alert_lead_time": _LEAD,
    "text_drift": _shift("coalesce(source, '') AS part, text FROM documents"),
    "turn_drift": _shift("coalesce(role, '') AS part, text FROM conversations"),
    "extraction_mix": f"""WITH q AS ({_EXTRACTION['conversation_cues']}),
v AS (SELECT CASE WHEN turn >= 2 THEN CAST(turn AS BIGINT) END AS part, feature, category FROM (
  SELECT turn, 'signal_type' AS feature, signal_type AS category FROM q UNION ALL SELECT turn, 'direction', direction FROM q
  UNION ALL SELECT turn, 'business_certainty', business_certainty FROM q)),
w AS (SELECT DISTINCT feature, part FROM v WHERE part IS NOT NULL),
k AS (SELECT w.feature, w.part, category, count(*) FILTER (v.part IS NULL) AS r, count(*) FILTER (v.part IS NOT NULL) AS m
  FROM w JOIN v ON v.feature = w.feature AND (v.part IS NULL OR v.part = w.part) GROUP BY ALL),
t AS (SELECT *, sum(r) OVER p AS nr, sum(m) OVER p AS nm, count(*) OVER p AS k FROM k WINDOW p AS (PARTITION BY feature, part))
SELECT feature, part, CAST(nr AS BIGINT) AS n_ref, CAST(nm AS BIGINT) AS n_mon, CAST(k - 1 AS BIGINT) AS degrees,
  round(sum(pow(r - (r + m) * nr / (nr + nm), 2) / ((r + m) * nr / (nr + nm)) + pow(m - (r + m) * nm / (nr + nm), 2) / ((r + m) * nm / (nr + nm))), 6) AS chi_square,
  round(sqrt(sum(pow(r - (r + m) * nr / (nr + nm), 2) / ((r + m) * nr / (nr + nm)) + pow(m - (r + m) * nm / (nr + nm), 2) / ((r + m) * nm / (nr + nm))) / (nr + nm)), 6) AS effect
FROM t GROUP BY feature, part, nr, nm, k""",
    "rolling_correlation": f"""WITH {_TABULAR}, p AS (SELECT DISTINCT t AS period FROM tab)
SELECT p.period, CAST(count(*) AS BIGINT) AS n, round(corr(tab.lag_1, tab.demand), 6) AS correlation
FROM p JOIN tab ON tab.t BETWEEN p.period - 11 AND p.period GROUP BY p.period""",
    "reprocessing_diff": f"""WITH a AS (WITH {SIGNAL_CTE} SELECT * FROM signal), b AS (WITH {_CORRECTED} SELECT * FROM signal),
d AS (SELECT unnest([{', '.join(f"CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN '{c}' END" for c in _FIELDS)},
  CASE WHEN {_CHANNEL.format(p='a')} <> {_CHANNEL.format(p='b')} THEN 'impact_channel' END]) AS change FROM a JOIN b USING (logical_signal_id))
SELECT change, CAST(count(*) AS BIGINT) AS signals FROM d WHERE change IS NOT NULL GROUP BY change""",
    "horizon_breakdown": f"""WITH {_ARMS}, g AS (SELECT arm, h, avg(abs(actual - predicted)) AS mae, avg(predicted - actual) AS bias, count(*) AS n FROM res GROUP BY ALL)
SELECT g.arm, CAST(g.h AS BIGINT) AS horizon, round(g.mae, 6) AS mae, round(g.bias, 6) AS bias, CAST(g.n AS BIGINT) AS n_origins,
  round((b.mae - g.mae) / b.mae, 6) AS lift FROM g JOIN g b ON b.arm = 'A' AND b.h = g.h""",
    "breakdown_cube": f"""WITH {_ARMS}, r AS (SELECT arm, CAST(h AS BIGINT) AS horizon, r_name AS segment, actual, predicted
  FROM res JOIN nation ON n_name = res.entity_key JOIN region ON r_regionkey = n_regionkey),
g AS (SELECT arm, horizon, segment, 0 AS level, * EXCLUDE (arm, horizon, segment) FROM r
  UNION ALL SELECT arm, horizon, NULL, 1, actual, predicted FROM r UNION ALL SELECT arm, NULL, segment, 2, actual, predicted FROM r
  UNION ALL SELECT arm, NULL, NULL, 3, actual, predicted FROM r),
e AS (SELECT arm, horizon, segment, level, avg(abs(actual - predicted)) AS mae, avg(predicted - actual) AS bias, count(*) AS n FROM g GROUP BY ALL)
SELECT e.arm, e.horizon, e.segment, CAST(e.level AS BIGINT) AS level, round(e.mae, 6) AS mae, round(e.bias, 6) AS bias,
  CAST(e.n AS BIGINT) AS n_origins, round((b.mae - e.mae) / b.mae, 6) AS lift
FROM e JOIN e b ON b.arm = 'A' AND b.level = e.level AND b.horizon IS NOT DISTINCT FROM e.horizon AND b.segment IS NOT DISTINCT FROM e.segment""",
    "bootstrap_lift": f"""WITH {_ARMS}, pair AS (SELECT x.arm, x.entity_key, sum(abs(b.actual - b.predicted)) AS base, sum(abs(x.actual - x.predicted)) AS loss
  FROM res x JOIN res b ON b.arm = 'A' AND b.entity_key = x.entity_key AND b.origin = x.origin AND b.h = x.h WHERE x.arm <> 'A' GROUP BY ALL),
drawn AS (SELECT arm, b, base, loss, CAST('0x' || substr(md5('7|' || CAST(b AS VARCHAR) || '|' || entity_key), 1, 8) AS BIGINT) / 4294967296 AS u
  FROM pair, (SELECT unnest(range(1, 501)) AS b)),
weighted AS (SELECT arm, b, base, loss, CASE WHEN u < 0.36787944 THEN 0 WHEN u < 0.73575888 THEN 1 WHEN u < 0.91969860 THEN 2
  WHEN u < 0.98101184 THEN 3 WHEN u < 0.99634015 THEN 4 WHEN u < 0.99940582 THEN 5 ELSE 6 END AS w FROM drawn),
lift AS (SELECT arm, b, (sum(w * base) - sum(w * loss)) / sum(w * base) AS lift FROM weighted GROUP BY ALL HAVING sum(w * base) > 0)
SELECT arm, round(quantile_cont(lift, 0.025), 6) AS lift_low, round(quantile_cont(lift, 0.5), 6) AS lift_mid,
  round(quantile_cont(lift, 0.975), 6) AS lift_high, CAST(count(*) AS BIGINT) AS replicates FROM lift GROUP BY arm""",
    "paired_losses": f"""WITH {_ARMS} SELECT x.arm, round(avg(abs(b.actual - b.predicted) - abs(x.actual - x.predicted)), 6) AS mean_gain, CAST(count(*) AS BIGINT) AS pairs
FROM res x JOIN res b ON b.arm = 'A' AND b.entity_key = x.entity_key AND b.origin = x.origin AND b.h = x.h WHERE x.arm <> 'A' GROUP BY x.arm""",
}
