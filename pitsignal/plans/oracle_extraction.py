"""Check statements for the note queries, phrased for an engine with RE2 patterns."""

from __future__ import annotations

from pitsignal.sources.derived import EVENT_SIGNALS_SQL, ORDER_NOTES_SQL, ORDER_TRUTH_SQL, RAW_NOTES_SQL

NOTES = ORDER_NOTES_SQL.replace("@ts", "TIMESTAMP").format(orders="orders")
TRUTH = ORDER_TRUTH_SQL.replace("@ts", "TIMESTAMP").format(orders="orders")
EVENTS = EVENT_SIGNALS_SQL.replace("@ts", "TIMESTAMP").format(events="events")

_EDGE = r"[^\p{L}\p{N}_]"


def word(pattern: str) -> str:
    return rf"regexp_matches(low, '(?:^|{_EDGE})(?:{pattern})(?:$|{_EDGE})')"


def cues_cte(source: str) -> str:
    """CTEs ``f`` (flags) and ``cue`` over ``source(raw_text, authored_at, ...)``."""
    return rf"""
f AS (SELECT *, lower(raw_text) AS low FROM {source}),
g AS (SELECT *,
  {word('is not increasing|no increase planned|will not be going up|reversed their previous decision|cancelled|no longer happening')} AS negated,
  ({word('increase')} AND NOT contains(low, 'no increase')) OR {word(r'needs?\s+(?:additional|more)')} AS up,
  {word('decrease')} AS dn,
  regexp_matches(low, '(?:^|{_EDGE})keep{_EDGE}(?:[^\n]*{_EDGE})?steady(?:$|{_EDGE})') AS st,
  {word('cancelled|canceled|no longer happening|reversed their previous decision')} AS is_reversal,
  nullif(trim(regexp_extract(raw_text, '(?i)(?:^|{_EDGE})(if [^.]+|pending [^.]+|unless [^.]+)', 1)), '') AS condition_text,
  TRY_CAST(nullif(regexp_extract(low, 'roughly\s+(\d+(?:\.\d+)?)\s*%', 1), '') AS DOUBLE) AS magnitude_value
  FROM f),
cue AS (SELECT * EXCLUDE (up, dn, st),
  CASE WHEN negated THEN 'STABLE' WHEN up AND dn THEN 'MIXED' WHEN st THEN 'STABLE' WHEN up THEN 'INCREASE'
       WHEN dn THEN 'DECREASE' END AS direction,
  NOT negated AND up AND dn AS conflict,
  CASE WHEN contains(low, 'confirmed they will') THEN 'ASSERTED'
       WHEN contains(low, 'mentioned they may possibly') THEN 'UNKNOWN'
       WHEN contains(low, 'indicated they might') THEN 'POSSIBLE'
       WHEN contains(low, 'will likely') THEN 'LIKELY'
       WHEN contains(low, 'expects to') OR contains(low, 'expected to') THEN 'EXPECTED'
       WHEN {word('might')} THEN 'POSSIBLE' WHEN {word('may')} THEN 'POSSIBLE'
       WHEN {word('confirmed')} THEN 'ASSERTED' WHEN {word('expect')} THEN 'EXPECTED'
       WHEN {word('will')} THEN 'LIKELY' ELSE 'UNKNOWN' END AS business_certainty,
  CASE WHEN condition_text IS NULL THEN 'NONE' ELSE 'CONDITIONAL' END AS conditionality,
  CASE WHEN magnitude_value IS NOT NULL THEN '%' END AS magnitude_unit,
  CASE WHEN magnitude_value IS NOT NULL THEN 'PERCENT' END AS magnitude_basis,
  CASE WHEN contains(low, 'volume tied to the upcoming promotion') THEN 'COMMERCIAL_EVENT'
       WHEN contains(low, 'our ability to fulfill on time') THEN 'SUPPLY_FULFILLMENT'
       WHEN contains(low, 'the delivery schedule') THEN 'TIMING_REVISION'
       WHEN contains(low, 'the order quantity') THEN 'QUANTITY_REVISION'
       WHEN contains(low, 'purchase volume') THEN 'PURCHASE_INTENT'
       WHEN contains(low, 'market demand') THEN 'MARKET_CONTEXT'
       WHEN contains(low, 'inventory') THEN 'INVENTORY_POSITION'
       WHEN contains(low, 'the order') THEN 'ORDER_LIFECYCLE'
       WHEN contains(low, 'orders') OR contains(low, 'volume') OR contains(low, 'demand')
       THEN 'DEMAND_EXPECTATION' END AS signal_type,
  CASE WHEN contains(low, 'next month') THEN 'next month' WHEN contains(low, 'next quarter') THEN 'next quarter'
       WHEN contains(low, 'next year') THEN 'next year' WHEN contains(low, 'later this year') THEN 'later this year'
       WHEN contains(low, 'in the next couple of weeks') THEN 'in the next couple of weeks' END AS time_expression_raw
  FROM g),
cued AS (SELECT *,
  CASE time_expression_raw WHEN 'next month' THEN 'month' WHEN 'next quarter' THEN 'quarter' WHEN 'next year' THEN 'year'
       WHEN 'later this year' THEN 'unknown' WHEN 'in the next couple of weeks' THEN 'week' END AS time_granularity,
  CASE time_expression_raw
       WHEN 'next month' THEN date_trunc('month', authored_at) + INTERVAL 1 MONTH
       WHEN 'next quarter' THEN date_trunc('quarter', authored_at) + INTERVAL 3 MONTH
       WHEN 'next year' THEN date_trunc('year', authored_at) + INTERVAL 1 YEAR
       WHEN 'later this year' THEN authored_at WHEN 'in the next couple of weeks' THEN authored_at
  END AS effective_start,
  CASE time_expression_raw
       WHEN 'next month' THEN date_trunc('month', authored_at) + INTERVAL 2 MONTH
       WHEN 'next quarter' THEN date_trunc('quarter', authored_at) + INTERVAL 6 MONTH
       WHEN 'next year' THEN date_trunc('year', authored_at) + INTERVAL 2 YEAR
       WHEN 'later this year' THEN date_trunc('year', authored_at) + INTERVAL 1 YEAR
       WHEN 'in the next couple of weeks' THEN authored_at + INTERVAL 14 DAY END AS effective_end
  FROM cue)"""


RESOLVED_CTE = f"""
notes AS ({NOTES}),
mention AS (SELECT DISTINCT source_id, m FROM (
    SELECT source_id, 1 AS pos, mention_1 AS m FROM notes UNION ALL SELECT source_id, 2, mention_2 FROM notes)
  WHERE m IN (SELECT 'CUST-' || CAST(c_custkey AS VARCHAR) FROM customer)),
resolved AS (SELECT n.source_id,
  string_agg(d.m, ',' ORDER BY CASE WHEN d.m = n.mention_1 THEN 1 ELSE 2 END) AS resolved_entities,
  CASE WHEN count(*) = 1 THEN min(d.m) END AS forecast_key
  FROM mention d JOIN notes n USING (source_id) GROUP BY n.source_id)"""


def _uuid(name: str) -> str:
    h = f"sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    variant = f"substr('89ab', CAST(('0x' || substr({h}, 17, 1)) AS INTEGER) % 4 + 1, 1)"
    return f"'sig-' || substr({h}, 1, 12) || '5' || substr({h}, 14, 3) || {variant} || substr({h}, 18, 15)"


SIGNAL_ID = _uuid("""'["' || source_id || '", "' || source_revision || '", "rules-v0.2.0", "cfg-v0.2.0", "run-1"]'""")
LOGICAL_ID = _uuid("""'["' || source_type || '", "' || source_record_id || '"]'""")

# Signals extracted from order notes: CTE ``signal`` with one row per note.
SIGNAL_CTE = f"""{RESOLVED_CTE}, {cues_cte('notes')},
joined AS (SELECT c.*, r.resolved_entities, r.forecast_key, c.direction IS NULL AND c.signal_type IS NULL AS no_cues
  FROM cued c LEFT JOIN resolved r USING (source_id)),
signal AS (SELECT {SIGNAL_ID} AS signal_id, {LOGICAL_ID} AS logical_signal_id, k, source_id, authored_at, available_at, is_reversal,
  CASE WHEN no_cues THEN 'NO_SIGNAL' ELSE coalesce(signal_type, 'OTHER_RELEVANT') END AS signal_type,
  CASE WHEN no_cues THEN 'NA' ELSE coalesce(direction, 'UNKNOWN') END AS direction,
  CASE WHEN no_cues THEN 'UNKNOWN' ELSE business_certainty END AS business_certainty,
  CASE WHEN no_cues THEN 'NONE' ELSE conditionality END AS conditionality,
  CASE WHEN NOT no_cues THEN condition_text END AS condition_text, negated,
  CASE WHEN NOT no_cues THEN magnitude_value END AS magnitude_value,
  CASE WHEN NOT no_cues THEN magnitude_unit END AS magnitude_unit,
  CASE WHEN NOT no_cues THEN magnitude_basis END AS magnitude_basis,
  effective_start, effective_end, forecast_key, CAST(length(raw_text) AS BIGINT) AS char_end,
  CASE WHEN conflict OR is_reversal
         OR (NOT no_cues AND (direction IS NULL OR signal_type IS NULL OR forecast_key IS NULL)) THEN 'REVIEW' ELSE 'PASS' END
    AS validation_status,
  nullif(concat_ws('; ',
    CASE WHEN conflict THEN 'conflicting direction cues detected in the same note' END,
    CASE WHEN no_cues THEN 'no direction or subject-matter cues found in text' END,
    CASE WHEN direction IS NULL AND NOT no_cues THEN 'subject matter detected but no clear direction cue' END,
    CASE WHEN signal_type IS NULL AND NOT no_cues THEN 'direction detected but signal type/subject unclear' END,
    CASE WHEN forecast_key IS NULL AND NOT no_cues THEN 'entity is ambiguous or unresolved' END,
    CASE WHEN is_reversal THEN 'reversal requires an unambiguous prior signal' END), '') AS abstention_reason
  FROM joined)"""

_LOOSE = f"""
s AS (SELECT *, CAST(substr(signal_id, 5) AS BIGINT) AS k FROM ({EVENTS})),
loose AS (SELECT * EXCLUDE (supersedes_signal_id, effective_start, effective_end, direction),
  CASE WHEN k % 97 = 0 THEN 'SIDEWAYS' WHEN k % 46 = 0 THEN 'STABLE' ELSE direction END AS direction,
  CASE WHEN k % 31 <> 0 THEN 'r1' END AS source_revision,
  CASE WHEN k % 41 = 0 THEN '0.2.0' ELSE '0.1.0' END AS schema_version,
  CASE WHEN k % 53 = 0 THEN 'MAYBE' ELSE 'NONE' END AS conditionality,
  CASE WHEN k % 3 <> 0 THEN 'units' END AS magnitude_unit,
  CASE WHEN k % 11 = 0 THEN magnitude_value + 1 END AS magnitude_low,
  CASE WHEN k % 22 = 0 THEN magnitude_value END AS magnitude_high,
  CASE WHEN k % 59 = 0 THEN effective_end ELSE effective_start END AS effective_start,
  CASE WHEN k % 59 = 0 THEN effective_start ELSE effective_end END AS effective_end,
  CASE WHEN k % 29 = 0 THEN 'elsewhere' ELSE source_id END AS ref_source,
  k % 7 - 1 AS char_start, k % 5 AS char_end,
  CASE WHEN k % 61 = 0 THEN 1.5 END AS extraction_confidence,
  CASE WHEN k % 67 = 0 THEN signal_id END AS supersedes_signal_id FROM s)"""

_CHECKS = (
    ("construct", "direction given without a signal", "signal_type = 'NO_SIGNAL' AND direction <> 'NA'"),
    ("construct", "magnitude without unit",
     "magnitude_unit IS NULL AND (magnitude_value IS NOT NULL OR magnitude_low IS NOT NULL OR magnitude_high IS NOT NULL)"),
    ("construct", "range reversed: magnitude_low, magnitude_high", "magnitude_low > magnitude_high"),
    ("construct", "range reversed: effective_start, effective_end", "effective_end < effective_start"),
    ("construct", "cites another source", "ref_source <> source_id"),
    ("construct", "range reversed: char_start, char_end", "char_end < char_start"),
    ("construct", "supersedes itself", "supersedes_signal_id = signal_id"),
    ("contract", "missing: source_revision", "source_revision IS NULL"),
    ("contract", "not in its value list: direction", "direction = 'SIDEWAYS'"),
    ("contract", "not in its value list: conditionality", "conditionality = 'MAYBE'"),
    ("contract", "other version: schema_version", "schema_version <> '0.1.0'"),
    ("contract", "below 0: evidence_ref.char_start", "char_start < 0"),
    ("contract", "out of range: extraction_confidence", "extraction_confidence > 1"),
    ("contract", "direction given without a signal", "signal_type = 'NO_SIGNAL' AND direction <> 'NA'"),
)
_VIOLATIONS = " UNION ALL ".join(
    f"SELECT signal_id, '{stage}' AS stage, '{message}' AS error, {i} AS place FROM loose WHERE {condition}"
    for i, (stage, message, condition) in enumerate(_CHECKS))

RAW_LINES = RAW_NOTES_SQL.replace("{orders}", "orders").replace("SELECT CASE", "SELECT o_orderkey AS k, CASE", 1).replace("AS STRING", "AS VARCHAR")

ORACLE = {
    "extract_cues": f"""WITH notes AS ({NOTES}), {cues_cte('notes')}
SELECT source_id, direction, negated, conflict, business_certainty, conditionality, condition_text, magnitude_value,
  magnitude_unit, magnitude_basis, signal_type, is_reversal, time_expression_raw, time_granularity,
  effective_start, effective_end FROM cued""",
    "document_cues": f"""WITH docs AS (SELECT doc_id, text AS raw_text, TIMESTAMP '2024-01-01' AS authored_at FROM documents),
{cues_cte('docs')}
SELECT doc_id, direction, negated, conflict, business_certainty, conditionality, signal_type, is_reversal,
  time_granularity, CAST(length(raw_text) AS BIGINT) AS text_length FROM cued""",
    "entity_resolution": f"WITH {RESOLVED_CTE} SELECT * FROM resolved",
    "extract_signals": f"""WITH {SIGNAL_CTE}
SELECT signal_id, logical_signal_id, source_id, signal_type, lower(direction) AS signal_subtype, direction,
  CASE WHEN signal_type = 'SUPPLY_FULFILLMENT' THEN 'FULFILLMENT'
       WHEN signal_type IN ('OTHER_RELEVANT', 'NO_SIGNAL') THEN 'UNKNOWN' ELSE 'DEMAND' END AS impact_channel,
  business_certainty, conditionality, condition_text, negated, magnitude_value, magnitude_unit, magnitude_basis,
  effective_start, effective_end, forecast_key, char_end, validation_status, abstention_reason FROM signal""",
    "signal_ids": f"WITH notes AS ({NOTES}) SELECT source_id, {SIGNAL_ID} AS signal_id, {LOGICAL_ID} AS logical_signal_id FROM notes",
    "content_hash": "SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents",
    "contract_errors": f"WITH {_LOOSE} SELECT signal_id, stage, error FROM ({_VIOLATIONS})",
    "quarantine_counts": f"""WITH {_LOOSE}, v AS ({_VIOLATIONS}),
first AS (SELECT signal_id, arg_min(stage, place) AS stage, arg_min(error, place) AS error FROM v GROUP BY signal_id)
SELECT coalesce(f.stage, 'accepted') AS stage, coalesce(f.error, '') AS error, CAST(count(*) AS BIGINT) AS n
FROM loose l LEFT JOIN first f USING (signal_id) GROUP BY ALL""",
    "conformance_rate": f"""WITH {_LOOSE}, v AS (SELECT DISTINCT signal_id FROM ({_VIOLATIONS}))
SELECT CAST(count(*) FILTER (v.signal_id IS NULL) AS BIGINT) AS accepted, CAST(count(v.signal_id) AS BIGINT) AS quarantined,
  round(avg(CASE WHEN v.signal_id IS NULL THEN 1.0 ELSE 0.0 END), 6) AS schema_conformance_rate
FROM loose l LEFT JOIN v USING (signal_id)""",
    "feature_contract": """SELECT CAST(count(DISTINCT user_id) * (SELECT count(*) FROM (
    SELECT unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM events), (SELECT max(CAST(ts AS DATE)) FROM events), INTERVAL 1 DAY))))
  AS BIGINT) AS feature_rows, CAST(0 AS BIGINT) AS schema_failures FROM events""",
    "corpus_summary": f"""WITH week AS (SELECT date_trunc('week', CAST(min(l_shipdate) AS DATE) + INTERVAL 6 DAY) AS first,
    date_trunc('week', max(l_shipdate)) - INTERVAL 7 DAY AS last FROM lineitem),
size AS (SELECT count(DISTINCT n_name) AS n_entities FROM customer JOIN nation ON n_nationkey = c_nationkey),
span AS (SELECT CAST(date_diff('day', first, last) / 7 + 1 AS BIGINT) AS n_weeks FROM week)
SELECT n_entities, n_weeks, CAST(n_entities * n_weeks AS BIGINT) AS n_demand_rows, t.* FROM size, span, (
  SELECT CAST(count(*) AS BIGINT) AS n_notes, CAST(count(*) FILTER (NOT is_irrelevant) AS BIGINT) AS n_signal_notes,
  CAST(count(*) FILTER (is_irrelevant) AS BIGINT) AS n_irrelevant_notes, CAST(count(*) FILTER (is_reversal) AS BIGINT) AS n_reversal_notes,
  round(coalesce(avg(CASE WHEN is_irrelevant THEN 1.0 ELSE 0.0 END), 0), 6) AS irrelevant_fraction FROM ({TRUTH})) t""",
    "conversation_cues": f"""WITH turns AS (SELECT conv_id, turn, role, text AS raw_text, TIMESTAMP '2024-01-01' AS authored_at FROM conversations),
{cues_cte('turns')}
SELECT conv_id, turn, role, direction, negated, conflict, business_certainty, conditionality, signal_type, is_reversal,
  time_granularity, CAST(length(raw_text) AS BIGINT) AS text_length FROM cued""",
    "raw_note_errors": f"""WITH line AS ({RAW_LINES}),
found AS (SELECT value AS raw_record, CASE WHEN k % 19 = 0 THEN ['not a JSON record'] ELSE list_filter([
    CASE WHEN k % 17 = 0 THEN 'unknown field mood' END, CASE WHEN k % 13 = 0 THEN 'missing: content_hash' END,
    CASE WHEN k % 11 = 0 THEN 'not in its value list: source_type' END,
    CASE WHEN k % 23 = 0 THEN 'range reversed: authored_at, available_at' END], lambda x: x IS NOT NULL) END AS errors FROM line)
SELECT raw_record, array_to_string(errors, '; ') AS errors FROM found WHERE len(errors) > 0""",
}
