"""Check statements for the scoring and integrity queries."""

from __future__ import annotations

from pitsignal.plans.oracle_extraction import SIGNAL_CTE, TRUTH

_CHANNEL = """CASE WHEN {t} = 'SUPPLY_FULFILLMENT' THEN 'FULFILLMENT' WHEN {t} IN ({none}) THEN 'UNKNOWN' ELSE 'DEMAND' END"""

# One row per note: label (g_*), prediction (p_*), and what happened to the output.
_BASE = f"""{SIGNAL_CTE}, truth AS ({TRUTH}),
base AS (SELECT s.k, s.source_id, o.o_custkey AS c,
  CASE WHEN o_custkey % 3 = 0 THEN 'natural_prevalence' ELSE 'challenge' END AS sample,
  CASE WHEN o_custkey % 4 = 0 THEN 'provisional' WHEN o_custkey % 4 = 2 THEN 'human_single' ELSE 'human_adjudicated' END AS label_status,
  t.signal_type AS g_signal_type, t.direction AS g_direction,
  {_CHANNEL.format(t='t.signal_type', none="'NO_SIGNAL'")} AS g_impact_channel,
  t.business_certainty AS g_business_certainty, t.conditionality AS g_conditionality, t.condition_text AS g_condition_text,
  t.negated AS g_negated, t.stated_magnitude_value AS g_magnitude_value, t.stated_magnitude_unit AS g_magnitude_unit,
  t.effective_start AS g_effective_start, t.effective_end AS g_effective_end,
  CASE WHEN s.k % 23 <> 0 AND s.k % 29 <> 0 THEN 'CUST-' || CAST(o_custkey AS VARCHAR) END AS g_forecast_key,
  CASE WHEN t.is_reversal AND s.k % 4 = 3 THEN 'ORD-' || CAST(s.k - 10 AS VARCHAR) END AS g_supersedes_source_id,
  CASE WHEN t.is_irrelevant THEN 'NO_SIGNAL' WHEN t.is_reversal OR s.k % 23 = 0 THEN 'REVIEW' ELSE 'PASS' END AS decision,
  CASE WHEN t.is_irrelevant THEN 'no_signal' WHEN t.is_reversal THEN 'reversal' WHEN s.k % 23 = 0 THEN 'entity' END AS abstention_reason,
  s.signal_type AS p_signal_type, s.direction AS p_direction,
  {_CHANNEL.format(t='s.signal_type', none="'NO_SIGNAL', 'OTHER_RELEVANT'")} AS p_impact_channel,
  s.business_certainty AS p_business_certainty, s.conditionality AS p_conditionality, s.condition_text AS p_condition_text,
  s.negated AS p_negated, s.magnitude_value AS p_magnitude_value, s.magnitude_unit AS p_magnitude_unit,
  s.effective_start AS p_effective_start, s.effective_end AS p_effective_end, s.forecast_key AS p_forecast_key,
  CAST(NULL AS VARCHAR) AS p_supersedes_source_id, s.validation_status, s.char_end AS len,
  CASE WHEN s.k % 43 = 0 THEN 0 WHEN s.k % 41 = 0 THEN 2 ELSE 1 END AS n_outputs,
  CASE WHEN s.k % 47 = 0 THEN 'contract' WHEN s.k % 59 = 0 AND s.magnitude_value IS NOT NULL THEN 'construct'
       WHEN s.k % 53 = 0 THEN 'lineage' END AS failure
  FROM signal s JOIN truth t USING (source_id) JOIN orders o ON o.o_orderkey = s.k),
note AS (SELECT *, n_outputs = 1 AND failure IS NULL AS usable,
  CASE WHEN validation_status = 'REVIEW' THEN 'REVIEW' WHEN p_signal_type = 'NO_SIGNAL' THEN 'NO_SIGNAL' ELSE 'PASS' END AS d FROM base),
n2 AS (SELECT * EXCLUDE (d), CASE WHEN usable THEN d ELSE '__MISSING__' END AS predicted,
  CASE WHEN decision = 'PASS' THEN g_signal_type ELSE '__MISSING__' END AS gold_event,
  CASE WHEN usable AND d = 'PASS' THEN p_signal_type ELSE '__MISSING__' END AS pred_event,
  failure IS NULL AND d = 'PASS' AS output_passes, k % 6 <> 0 AS full_scope FROM note)"""

_TEXT = ("signal_type", "direction", "impact_channel", "business_certainty", "conditionality", "condition_text",
         "magnitude_unit", "forecast_key", "supersedes_source_id")


def _field(name: str) -> str:
    g, p = f"g_{name}", f"p_{name}"
    if name in _TEXT:
        yes = lambda c: f"coalesce({c} NOT IN ('UNKNOWN', 'NA', 'NONE', 'NO_SIGNAL'), false)"
        same = f"{g} IS NOT DISTINCT FROM {p}"
    elif name == "negated":
        yes, same = (lambda c: c), f"{g} = {p}"
    elif name == "magnitude_value":
        yes, same = (lambda c: f"{c} IS NOT NULL"), f"({g} IS NULL AND {p} IS NULL) OR coalesce(abs({g} - {p}) <= 1e-6, false)"
    else:
        yes, same = (lambda c: f"{c} IS NOT NULL"), f"{g} IS NOT DISTINCT FROM {p}"
    grounds = name != "supersedes_source_id"
    spans = grounds and name != "effective_end"
    reach = "CASE WHEN k % 13 = 0 THEN len + 1 ELSE 8 END" if name in ("direction", "magnitude_value") else "len"
    where = "true" if name in ("forecast_key", "direction") else "full_scope"
    return f"""SELECT source_id, sample, label_status, '{name}' AS field, usable AND ({same}) AS correct, {yes(g)} AS gold,
      usable AND {yes(p)} AS asserts, {str(grounds).lower()} AS grounds, {str(spans).lower()} AS spans,
      {str(spans).lower()} AND usable AND k % 7 <> 0 AND len >= {reach} AS covered FROM n2 WHERE {where}"""


_FIELDS = ("signal_type", "direction", "impact_channel", "business_certainty", "conditionality", "condition_text", "negated",
           "magnitude_value", "magnitude_unit", "effective_start", "effective_end", "forecast_key", "supersedes_source_id")
_FIELD_CTE = f"{_BASE}, fld AS ({' UNION ALL '.join(_field(f) for f in _FIELDS)})"

_ERROR = """CASE field WHEN 'signal_type' THEN 'wrong_type' WHEN 'forecast_key' THEN 'wrong_entity' WHEN 'direction' THEN 'wrong_direction'
  WHEN 'magnitude_value' THEN 'wrong_magnitude' WHEN 'magnitude_unit' THEN 'wrong_magnitude' WHEN 'effective_start' THEN 'wrong_timing'
  WHEN 'effective_end' THEN 'wrong_timing' WHEN 'negated' THEN 'negation_error' WHEN 'conditionality' THEN 'conditionality_error'
  WHEN 'condition_text' THEN 'conditionality_error' WHEN 'supersedes_source_id' THEN 'missed_supersession_stale_signal' END"""
_ERROR_CTE = f"""{_FIELD_CTE},
bad AS (SELECT source_id, {_ERROR} AS error FROM fld WHERE NOT correct
  UNION SELECT source_id, 'unsupported_inference' FROM fld WHERE grounds AND asserts AND NOT (correct AND covered)
  UNION SELECT source_id, 'duplicate' FROM n2 WHERE n_outputs > 1
  UNION SELECT source_id, 'false_event' FROM n2 WHERE full_scope AND gold_event = '__MISSING__' AND pred_event <> '__MISSING__'
  UNION SELECT source_id, 'missed_event' FROM n2 WHERE full_scope AND gold_event <> '__MISSING__' AND pred_event = '__MISSING__'),
err AS (SELECT DISTINCT source_id, error FROM bad WHERE error IS NOT NULL)"""

_PAIRS_CTE = f"""{_BASE},
q AS (SELECT sample, label_status, 'actionable_event_detection' AS metric, gold_event AS g, pred_event AS p FROM n2 WHERE full_scope
  UNION ALL SELECT sample, label_status, 'actionable_event_detection', '__MISSING__', p_signal_type FROM n2, (VALUES (1), (2)) x(x)
    WHERE full_scope AND n_outputs > 1 AND output_passes
  UNION ALL SELECT sample, label_status, 'signal_type', g_signal_type, CASE WHEN usable THEN p_signal_type ELSE '__MISSING__' END FROM n2 WHERE full_scope
  UNION ALL SELECT sample, label_status, 'direction', g_direction, CASE WHEN usable THEN p_direction ELSE '__MISSING__' END FROM n2
  UNION ALL SELECT sample, label_status, 'negation_subset', 'True', CASE WHEN NOT usable THEN '__MISSING__' WHEN p_negated THEN 'True' ELSE 'False' END
    FROM n2 WHERE g_negated AND full_scope
  UNION ALL SELECT sample, label_status, 'conditional_subset', 'CONDITIONAL', CASE WHEN usable THEN p_conditionality ELSE '__MISSING__' END
    FROM n2 WHERE g_conditionality = 'CONDITIONAL' AND full_scope
  UNION ALL SELECT sample, label_status, 'abstention_decision', decision, predicted FROM n2
  UNION ALL SELECT sample, label_status, 'abstention', CASE WHEN decision = 'PASS' THEN 'PASS' ELSE 'ABSTAIN' END,
    CASE WHEN predicted IN ('NO_SIGNAL', 'REVIEW') THEN 'ABSTAIN' ELSE predicted END FROM n2),
lab AS (SELECT 'actionable_event_detection' AS metric, unnest(['DEMAND_EXPECTATION', 'PURCHASE_INTENT', 'ORDER_LIFECYCLE', 'QUANTITY_REVISION',
    'TIMING_REVISION', 'INVENTORY_POSITION', 'COMMERCIAL_EVENT', 'SUPPLY_FULFILLMENT', 'MARKET_CONTEXT', 'OTHER_RELEVANT']) AS label
  UNION ALL SELECT 'negation_subset', unnest(['True', 'False'])
  UNION ALL SELECT 'conditional_subset', unnest(['NONE', 'CONDITIONAL', 'UNKNOWN'])
  UNION ALL SELECT 'abstention', 'ABSTAIN'
  UNION ALL SELECT 'abstention_decision', unnest(['PASS', 'NO_SIGNAL', 'REVIEW']))"""


def _classes(keys: str) -> str:
    return f"""{_PAIRS_CTE},
l AS (SELECT DISTINCT {keys} q.metric, lab.label FROM q JOIN lab USING (metric)
  UNION SELECT {keys} metric, g FROM q WHERE metric IN ('signal_type', 'direction')
  UNION SELECT {keys} metric, p FROM q WHERE metric IN ('signal_type', 'direction') AND p <> '__MISSING__'),
pc AS (SELECT {', '.join('l.' + k for k in keys.replace(',', '').split())}{',' if keys else ''} l.metric, l.label,
  CAST(count(*) FILTER (q.g = label AND q.p = label) AS BIGINT) AS tp, CAST(count(*) FILTER (q.g <> label AND q.p = label) AS BIGINT) AS fp,
  CAST(count(*) FILTER (q.g = label AND q.p <> label) AS BIGINT) AS fn
  FROM l JOIN q ON q.metric = l.metric {' '.join(f'AND q.{k} = l.{k}' for k in keys.replace(',', '').split())} GROUP BY ALL)"""


_IOU = """CASE WHEN NOT usable OR p_effective_start IS NULL OR p_effective_end IS NULL THEN 0.0
  ELSE greatest(0, epoch(least(g_effective_end, p_effective_end)) - epoch(greatest(g_effective_start, p_effective_start)))
    / (epoch(greatest(g_effective_end, p_effective_end)) - epoch(least(g_effective_start, p_effective_start))) END"""

_RATES = f"""WITH {_FIELD_CTE},
a AS (SELECT sample, label_status, count(*) AS n, count(*) FILTER (n_outputs = 0) AS missing, count(*) FILTER (n_outputs = 2) AS dup,
    count(*) FILTER (has AND usable AND g_effective_start IS NOT DISTINCT FROM p_effective_start
      AND g_effective_end IS NOT DISTINCT FROM p_effective_end) AS exact,
    count(*) FILTER (has) AS iv, coalesce(sum(iou) FILTER (has), 0) AS iou,
    count(*) FILTER (g_forecast_key IS NOT NULL AND usable AND g_forecast_key IS NOT DISTINCT FROM p_forecast_key) AS res,
    count(g_forecast_key) AS resd, count(*) FILTER (g_forecast_key IS NULL AND usable AND p_forecast_key IS NULL) AS un,
    count(*) FILTER (g_forecast_key IS NULL) AS und
  FROM (SELECT *, full_scope AND g_effective_start IS NOT NULL AND g_effective_end IS NOT NULL AS has, {_IOU} AS iou FROM n2) GROUP BY ALL),
b AS (SELECT sample, label_status, count(*) FILTER (spans) AS sp, count(*) FILTER (covered) AS cov, count(*) FILTER (grounds AND asserts) AS ga,
    count(*) FILTER (grounds AND asserts AND NOT (correct AND covered)) AS uns FROM fld GROUP BY ALL),
r AS (SELECT * FROM a JOIN b USING (sample, label_status))
SELECT sample, label_status, metric, round(CASE WHEN counted THEN num ELSE num / nullif(den, 0) END, 6) AS value, round(num, 4) AS numerator,
  CASE WHEN NOT counted THEN CAST(den AS BIGINT) END AS denominator FROM (
  SELECT sample, label_status, 'n_notes' AS metric, CAST(n AS DOUBLE) AS num, 1 AS den, true AS counted FROM r
  UNION ALL SELECT sample, label_status, 'missing_output_count', missing, 1, true FROM r
  UNION ALL SELECT sample, label_status, 'duplicate_output_count', dup, 1, true FROM r
  UNION ALL SELECT sample, label_status, 'temporal_exact_match', exact, iv, false FROM r
  UNION ALL SELECT sample, label_status, 'temporal_mean_interval_iou', iou, iv, false FROM r
  UNION ALL SELECT sample, label_status, 'entity_resolvable_accuracy', res, resd, false FROM r
  UNION ALL SELECT sample, label_status, 'entity_correct_unresolved_rate', un, und, false FROM r
  UNION ALL SELECT sample, label_status, 'evidence_span_coverage', cov, sp, false FROM r
  UNION ALL SELECT sample, label_status, 'unsupported_inference_rate', uns, ga, false FROM r)"""

_CASE_RULES = (
    ("repeated: annotator_ids", "k % 17 = 0"),
    ("draft of a machine marked as reviewed", "c % 4 = 0 AND k % 19 = 0"),
    ("reviewed twice by fewer than two people",
     "k % 17 <> 0 AND k % 5 = 0 AND (c % 4 = 1 OR c % 4 = 3 OR (c % 4 = 0 AND k % 19 = 0))"),
    ("resolved by nobody", "c % 4 = 3 AND k % 3 = 0"),
    ("decision and type disagree on whether there is a signal", "(decision = 'NO_SIGNAL') <> (g_signal_type = 'NO_SIGNAL')"),
    ("empty interval: effective_start, effective_end", "g_effective_end <= g_effective_start"),
    ("asserted without a span: effective_end", "full_scope AND g_effective_end IS NOT NULL"),
    ("span outside its own text", "k % 13 = 0"),
)

# The one letter of the tables that folds otherwise than it lower-cases.
_FOLD = "replace(lower(text), 'ß', 'ss')"


_LANES = ", ".join(f"CAST(CAST('0x' || substr(d{i // 4}, {16 * (i % 4) + 1}, 16) AS UBIGINT) AS HUGEINT) AS l{i}" for i in range(8))
_LANE_SUMS = " || ':' || ".join(f"CAST(sum(l{i}) % 18446744073709551616 AS VARCHAR)" for i in range(8))

ORACLE = {
    "dataset_fingerprint": f"""WITH r AS (SELECT coalesce(lang, '') AS lang,
  concat_ws('|', CAST(doc_id AS VARCHAR), coalesce(lang, ''), source, CAST(n_chars AS VARCHAR), text) AS row FROM documents),
d AS (SELECT lang, sha256(row) AS d0, sha256('+' || row) AS d1 FROM r), l AS (SELECT lang, {_LANES} FROM d)
SELECT lang, CAST(count(*) AS BIGINT) AS n, sha256(CAST(count(*) AS VARCHAR) || ':' || {_LANE_SUMS}) AS fingerprint FROM l GROUP BY lang""",
    "classification_report": f"""WITH {_classes('sample, label_status,')}
SELECT sample, label_status, metric, label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM pc""",
    "classification_summary": f"""WITH {_classes('')},
m AS (SELECT metric, avg(2 * tp / nullif(2 * tp + fp + fn, 0)) AS macro_f1, count(*) FILTER (2 * tp + fp + fn > 0) AS n_classes FROM pc GROUP BY metric)
SELECT metric, round(avg(CASE WHEN g = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy, CAST(count(*) FILTER (g = p) AS BIGINT) AS n_correct,
  CAST(count(*) AS BIGINT) AS n_pairs, round(any_value(macro_f1), 6) AS macro_f1, CAST(any_value(n_classes) AS BIGINT) AS n_classes
FROM q JOIN m USING (metric) GROUP BY metric""",
    "field_metrics": f"""WITH {_FIELD_CTE},
fm AS (SELECT sample, label_status, field, count(*) AS n, count(*) FILTER (correct) AS correct, count(*) FILTER (gold AND asserts AND correct) AS tp,
  count(*) FILTER (asserts AND NOT (gold AND correct)) AS fp, count(*) FILTER (gold AND NOT (asserts AND correct)) AS fn FROM fld GROUP BY ALL)
SELECT sample, label_status, field, CAST(n AS BIGINT) AS n, CAST(correct AS BIGINT) AS correct, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
  CAST(fn AS BIGINT) AS fn, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM fm""",
    "error_taxonomy": f"""WITH {_ERROR_CTE},
e AS (SELECT unnest(['false_event', 'missed_event', 'wrong_type', 'wrong_entity', 'wrong_direction', 'wrong_magnitude', 'wrong_timing',
  'negation_error', 'conditionality_error', 'duplicate', 'missed_supersession_stale_signal', 'unsupported_inference']) AS error_type)
SELECT c.sample, c.label_status, e.error_type, CAST(coalesce(x.n, 0) AS BIGINT) AS notes
FROM (SELECT DISTINCT sample, label_status FROM n2) c CROSS JOIN e LEFT JOIN (
  SELECT sample, label_status, error, count(*) AS n FROM err JOIN n2 USING (source_id) GROUP BY ALL) x
  ON x.sample = c.sample AND x.label_status = c.label_status AND x.error = e.error_type""",
    "diagnostics": f"""WITH {_ERROR_CTE},
e AS (SELECT source_id, string_agg(error, ',' ORDER BY error) AS error_types FROM err GROUP BY source_id),
w AS (SELECT source_id, string_agg(field, ',' ORDER BY field) AS field_errors FROM fld WHERE NOT correct GROUP BY source_id),
u AS (SELECT source_id, string_agg(field, ',' ORDER BY field) AS unsupported_fields FROM fld
  WHERE grounds AND asserts AND NOT (correct AND covered) GROUP BY source_id)
SELECT source_id, decision AS expected_decision, predicted AS predicted_decision, coalesce(error_types, '') AS error_types,
  coalesce(field_errors, '') AS field_errors, coalesce(unsupported_fields, '') AS unsupported_fields
FROM n2 LEFT JOIN e USING (source_id) LEFT JOIN w USING (source_id) LEFT JOIN u USING (source_id)
WHERE error_types IS NOT NULL OR field_errors IS NOT NULL OR predicted <> decision""",
    "note_rates": _RATES,
    "output_rates": f"""WITH {_BASE},
o AS (SELECT n2.* FROM n2 JOIN (VALUES (1), (2)) x(x) ON x <= n_outputs),
r AS (SELECT sample, label_status, count(*) AS att, count(*) FILTER (failure IS DISTINCT FROM 'contract') AS ok,
  count(*) FILTER (failure = 'construct') AS con, count(*) FILTER (failure = 'contract') AS ctr, count(*) FILTER (failure = 'lineage') AS lin
  FROM o GROUP BY ALL)
SELECT sample, label_status, metric, round(CASE WHEN den IS NULL THEN num ELSE num / den END, 6) AS value, num AS numerator, CAST(den AS BIGINT) AS denominator FROM (
  SELECT sample, label_status, 'schema_valid_record_rate' AS metric, CAST(ok AS DOUBLE) AS num, att AS den FROM r
  UNION ALL SELECT sample, label_status, 'model_validation_failure_rate', con, att FROM r
  UNION ALL SELECT sample, label_status, 'semantic_cross_field_failure_rate', con, ok FROM r
  UNION ALL SELECT sample, label_status, 'schema_failure_rate', ctr, att FROM r
  UNION ALL SELECT sample, label_status, 'lineage_failure_rate', lin, att FROM r
  UNION ALL SELECT sample, label_status, 'unclassified_construction_failure_count', 0, NULL FROM r)""",
    "abstention_reasons": f"""WITH {_BASE}
SELECT sample, label_status, abstention_reason, CAST(count(*) FILTER (predicted = decision) AS BIGINT) AS numerator, CAST(count(*) AS BIGINT) AS denominator,
  round(avg(CASE WHEN predicted = decision THEN 1.0 ELSE 0.0 END), 6) AS value FROM n2 WHERE abstention_reason IS NOT NULL GROUP BY ALL""",
    "case_errors": f"""WITH {_BASE} SELECT error, CAST(count(*) AS BIGINT) AS n FROM (
  {' UNION ALL '.join(f"SELECT '{m}' AS error FROM n2 WHERE {c}" for m, c in _CASE_RULES)}) GROUP BY error""",
    "split_leakage": """WITH g AS (SELECT CASE WHEN o_orderkey % 101 = 0 THEN 'T-' || CAST(o_orderkey % 7 AS VARCHAR) ELSE 'T-' || CAST(o_custkey AS VARCHAR) END AS grp,
  CAST(o_custkey % 2 AS VARCHAR) || CAST(o_custkey % 3 = 0 AS VARCHAR) AS part FROM orders)
SELECT 'template' AS kind, grp AS "group" FROM g GROUP BY grp HAVING count(DISTINCT part) > 1""",
    "supersession_integrity": f"""WITH {_BASE}, l AS (SELECT n2.*, s.authored_at FROM n2 JOIN signal s USING (source_id) WHERE g_supersedes_source_id IS NOT NULL)
SELECT l.source_id, g_supersedes_source_id AS target_id, CASE WHEN t.source_id IS NULL OR t.c <> l.c
    THEN 'supersedes nothing in its scenario'
    ELSE 'supersedes what was not yet known' END AS error
FROM l LEFT JOIN (SELECT n2.source_id, n2.c, s.available_at FROM n2 JOIN signal s USING (source_id)) t ON t.source_id = g_supersedes_source_id
WHERE t.source_id IS NULL OR t.c <> l.c OR t.available_at > l.authored_at""",
    "label_scoring": """WITH r AS (SELECT text, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM documents JOIN labels USING (doc_id)),
p AS (SELECT 'quality' AS metric, quality AS gold, CASE WHEN length(text) < 40 OR contains(text, '!!') OR contains(text, ' | ')
    OR contains(text, '$$$') OR contains(text, '%%%') THEN '0' ELSE '1' END AS pred FROM r
  UNION ALL SELECT 'toxic', toxic, CASE WHEN contains(text, 'http') THEN '1' ELSE '0' END FROM r),
l AS (SELECT DISTINCT metric, unnest([gold, pred]) AS label FROM p),
c AS (SELECT l.metric, label, CAST(count(*) FILTER (gold = label AND pred = label) AS BIGINT) AS tp,
  CAST(count(*) FILTER (gold <> label AND pred = label) AS BIGINT) AS fp,
  CAST(count(*) FILTER (gold = label AND pred <> label) AS BIGINT) AS fn FROM l JOIN p USING (metric) GROUP BY ALL)
SELECT metric, label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""",
    "unknown_keys": """SELECT DISTINCT source_id, entity_key FROM (
  SELECT 'ORD-' || CAST(o_orderkey AS VARCHAR) AS source_id, unnest([
    CASE WHEN o_orderkey % 23 = 0 THEN 'Acme Holding' ELSE 'CUST-' || CAST(o_custkey AS VARCHAR) END,
    CASE WHEN o_orderkey % 29 = 0 THEN 'CUST-' || CAST(o_custkey + 1 AS VARCHAR) END]) AS entity_key FROM orders)
WHERE entity_key IS NOT NULL AND entity_key NOT IN (SELECT 'CUST-' || CAST(c_custkey AS VARCHAR) FROM customer)""",
    "duplicate_text_leakage": rf"""WITH t AS (SELECT text, source AS split FROM documents UNION ALL SELECT text, 'benchmark' FROM benchmark),
d AS (SELECT sha256(trim(regexp_replace({_FOLD}, '[\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))) AS text_digest, split FROM t)
SELECT text_digest, min(split) AS first_split, max(split) AS last_split, CAST(count(*) AS BIGINT) AS copies FROM d GROUP BY text_digest HAVING min(split) <> max(split)""",
    "duplicate_sources": """SELECT 'ORD-' || CAST(o_orderkey AS VARCHAR) AS source_id, CAST(2 AS BIGINT) AS n FROM orders WHERE o_custkey % 3 = 0""",
}
