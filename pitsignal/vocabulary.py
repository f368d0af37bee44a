"""Fixed values of the data model: versions, enumerations and defaults.

These strings are part of the wire contract and must not change.
"""

SCHEMA_VERSION = "0.1.0"

SOURCE_TYPES = ("account_note", "service_note", "supplier_commentary", "sales_commentary", "other")
SIGNAL_TYPES = (
    "DEMAND_EXPECTATION", "PURCHASE_INTENT", "ORDER_LIFECYCLE", "QUANTITY_REVISION",
    "TIMING_REVISION", "INVENTORY_POSITION", "COMMERCIAL_EVENT", "SUPPLY_FULFILLMENT",
    "MARKET_CONTEXT", "OTHER_RELEVANT", "NO_SIGNAL",
)
DIRECTIONS = ("INCREASE", "DECREASE", "STABLE", "MIXED", "UNKNOWN", "NA")
IMPACT_CHANNELS = ("DEMAND", "FULFILLMENT", "MIX_ALLOCATION", "UNKNOWN")
CERTAINTIES = ("ASSERTED", "EXPECTED", "LIKELY", "POSSIBLE", "UNKNOWN")
CONDITIONALITIES = ("NONE", "CONDITIONAL", "UNKNOWN")
MAGNITUDE_BASES = ("ABSOLUTE", "DELTA", "PERCENT", "RANGE")
TIME_GRANULARITIES = ("day", "week", "month", "quarter", "year", "interval", "unknown")
VALIDATION_STATUSES = ("PASS", "REVIEW", "FAIL")
RECORD_STATUSES = ("ACTIVE", "SUPERSEDED", "RETRACTED")
NET_DIRECTIONS = ("INCREASE", "DECREASE", "STABLE", "MIXED", "UNKNOWN")
STALENESS = ("FRESH", "STALE", "UNKNOWN")

EXTRACTOR_VERSION = "rules-v0.2.0"
EXTRACTION_CONFIG_VERSION = "cfg-v0.2.0"
FEATURE_DEFINITION_VERSION = "fdv-0.1.0"
ORACLE_FEATURE_VERSION = "oracle-v0.1.0"
EVALUATOR_VERSION = "extraction-eval-0.1.0"
ANNOTATION_SCHEMA_VERSION = "d2-0.1.0"

LOOKBACK_DAYS = 30
LONG_LOOKBACK_DAYS = 90
HORIZON_DAYS = 28
STALENESS_THRESHOLD_DAYS = 14

# Review reasons attached by the extractor, in the order they are joined.
REASON_CONFLICT = "conflicting direction cues detected in the same note"
REASON_NO_CUES = "no direction or subject-matter cues found in text"
REASON_NO_DIRECTION = "subject matter detected but no clear direction cue"
REASON_NO_SUBJECT = "direction detected but signal type/subject unclear"
REASON_ENTITY = "entity is ambiguous or unresolved"
REASON_REVERSAL = "reversal requires an unambiguous prior signal"
REASON_SEPARATOR = "; "

# Annotation scoring.
SCORED_FIELDS = (
    "signal_type", "direction", "impact_channel", "business_certainty", "conditionality",
    "condition_text", "negated", "magnitude_value", "magnitude_unit",
    "effective_start", "effective_end", "forecast_key", "supersedes_source_id",
)
NOT_ASSERTED = ("UNKNOWN", "NA", "NONE", "NO_SIGNAL")
MISSING = "__MISSING__"
ERROR_TYPES = (
    "false_event", "missed_event", "wrong_type", "wrong_entity", "wrong_direction",
    "wrong_magnitude", "wrong_timing", "negation_error", "conditionality_error",
    "duplicate", "missed_supersession_stale_signal", "unsupported_inference",
)

# The error type that a wrong value of a field counts as.
ERROR_OF_FIELD = {
    "signal_type": "wrong_type", "forecast_key": "wrong_entity", "direction": "wrong_direction",
    "magnitude_value": "wrong_magnitude", "magnitude_unit": "wrong_magnitude",
    "effective_start": "wrong_timing", "effective_end": "wrong_timing", "negated": "negation_error",
    "conditionality": "conditionality_error", "condition_text": "conditionality_error",
    "supersedes_source_id": "missed_supersession_stale_signal",
}
