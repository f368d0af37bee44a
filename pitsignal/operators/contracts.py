"""Data contracts as rule columns: every violated rule of a row yields a message.

A rule is ``(message, condition)``; the condition is true for a violation.  *Schema*
rules mirror the wire contract (required fields, enumerations, ranges); *model* rules
are the cross-field business rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pitsignal import vocabulary as V

Rule = tuple[str, str]


def _required(fields) -> list[Rule]:
    return [(f"missing: {f}", f"{f} is null") for f in fields]


def _one_of(field: str, values) -> Rule:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"not in its value list: {field}", f"{field} not in ({listed})"


def _at_least_zero(field: str) -> Rule:
    return f"below 0: {field}", f"{field} < 0"


def _finite(field: str) -> Rule:
    return f"not finite: {field}", f"isnan({field}) or abs({field}) = double('Infinity')"


_VERSION: Rule = ("other version: schema_version", f"schema_version <> '{V.SCHEMA_VERSION}'")

EVIDENCE_SCHEMA_RULES: list[Rule] = [
    *_required(("source_id", "source_type", "source_record_id", "source_revision", "authored_at",
                "available_at", "content_hash", "schema_version")),
    _one_of("source_type", V.SOURCE_TYPES), _VERSION,
]
EVIDENCE_MODEL_RULES: list[Rule] = [
    ("range reversed: authored_at, available_at", "available_at < authored_at"),
]

SIGNAL_SCHEMA_RULES: list[Rule] = [
    *_required(("signal_id", "logical_signal_id", "schema_version", "source_id", "source_revision", "signal_type",
                "direction", "impact_channel", "business_certainty", "conditionality", "negated",
                "entity_mentions", "evidence_ref", "extractor_version", "extraction_config_version",
                "extraction_run_id", "extracted_at", "validation_status", "record_status")),
    *_required(("evidence_ref.source_id", "evidence_ref.char_start", "evidence_ref.char_end")),
    _one_of("signal_type", V.SIGNAL_TYPES), _one_of("direction", V.DIRECTIONS),
    _one_of("impact_channel", V.IMPACT_CHANNELS), _one_of("business_certainty", V.CERTAINTIES),
    _one_of("conditionality", V.CONDITIONALITIES), _one_of("validation_status", V.VALIDATION_STATUSES),
    _one_of("record_status", V.RECORD_STATUSES), _one_of("magnitude_basis", V.MAGNITUDE_BASES),
    _one_of("time_granularity", V.TIME_GRANULARITIES), _VERSION,
    _at_least_zero("evidence_ref.char_start"), _at_least_zero("evidence_ref.char_end"),
    ("out of range: extraction_confidence", "extraction_confidence < 0 or extraction_confidence > 1"),
    ("direction given without a signal", "signal_type = 'NO_SIGNAL' and direction <> 'NA'"),
]
SIGNAL_MODEL_RULES: list[Rule] = [
    ("direction given without a signal", "signal_type = 'NO_SIGNAL' and direction <> 'NA'"),
    ("magnitude without unit",
     "coalesce(magnitude_value, magnitude_low, magnitude_high) is not null and coalesce(magnitude_unit, '') = ''"),
    ("range reversed: magnitude_low, magnitude_high", "magnitude_low > magnitude_high"),
    ("range reversed: effective_start, effective_end", "effective_end < effective_start"),
    ("cites another source", "evidence_ref.source_id <> source_id"),
    ("range reversed: char_start, char_end", "evidence_ref.char_end < evidence_ref.char_start"),
    ("supersedes itself", "supersedes_signal_id = signal_id"),
    *(_finite(f) for f in ("magnitude_value", "magnitude_low", "magnitude_high", "extraction_confidence")),
]

_COUNTS = ("signal_count_30d", "delay_count_90d", "days_since_latest_signal",
           "independent_source_count_30d", "active_conflict_count")
FEATURE_SCHEMA_RULES: list[Rule] = [
    *_required(("entity_key", "forecast_cutoff", "feature_definition_version", "generated_at",
                "contributing_signal_ids", "schema_version")),
    *(_at_least_zero(f) for f in _COUNTS),
    _one_of("net_demand_direction_30d", V.NET_DIRECTIONS), _one_of("staleness_status", V.STALENESS), _VERSION,
]

CONTRACTS: dict[str, list[Rule]] = {
    "source_evidence": EVIDENCE_SCHEMA_RULES,
    "signal_record": SIGNAL_SCHEMA_RULES,
    "forecast_feature": FEATURE_SCHEMA_RULES,
}
MODELS: dict[str, list[Rule]] = {
    "source_evidence": EVIDENCE_MODEL_RULES,
    "signal_record": SIGNAL_MODEL_RULES,
    "forecast_feature": [],
}


def errors_of(rules: list[Rule]) -> str:
    """Array of the messages of all violated rules, in rule order."""
    quoted = lambda m: m.replace("'", "\\'")
    checks = ", ".join(f"if({cond}, '{quoted(msg)}', null)" for msg, cond in rules)
    return f"array_distinct(array_compact(array({checks})))" if rules else "cast(array() as array<string>)"


def with_errors(df: DataFrame, contract: str) -> DataFrame:
    """Add ``contract_errors`` and ``model_errors``."""
    if contract not in CONTRACTS:
        raise KeyError(f"unknown contract {contract!r}; known: {sorted(CONTRACTS)}")
    return df.selectExpr(
        "*", f"{errors_of(CONTRACTS[contract])} as contract_errors", f"{errors_of(MODELS[contract])} as model_errors")


def violations(df: DataFrame, contract: str, key: str) -> DataFrame:
    """Every violation of the wire contract and the model: ``(key, stage, error)``."""
    tagged = (
        "concat(transform(model_errors, e -> named_struct('stage', 'construct', 'error', e)), "
        "transform(contract_errors, e -> named_struct('stage', 'contract', 'error', e)))")
    return with_errors(df, contract).selectExpr(key, f"inline({tagged})")


def classify(df: DataFrame, contract: str) -> DataFrame:
    """Add ``stage`` (null when valid) and ``error`` (the first violation).

    Model rules are checked before the wire contract, as a record is built before it is
    serialised.
    """
    return with_errors(df, contract).selectExpr(
        "* except (contract_errors, model_errors)",
        "case when size(model_errors) > 0 then 'construct' when size(contract_errors) > 0 then 'contract' end as stage",
        "try_element_at(concat(model_errors, contract_errors), 1) as error",
    )


def is_valid(contract: str) -> str:
    """Boolean SQL expression: the row satisfies the wire contract."""
    return f"size({errors_of(CONTRACTS[contract])}) = 0"


def conformance(classified: DataFrame) -> DataFrame:
    """One row: accepted, quarantined and their rate (1.0 for an empty input)."""
    return classified.sparkSession.sql(
        "select count_if(stage is null) as accepted, count_if(stage is not null) as quarantined, "
        "coalesce(avg(if(stage is null, 1.0D, 0.0D)), 1.0D) as schema_conformance_rate from {df}", df=classified)


def unknown_fields(df: DataFrame, allowed: list[str]) -> list[str]:
    """Columns of ``df`` that the contract does not know."""
    return [c for c in df.columns if c not in allowed]


def unknown_json_fields(json: str, allowed: list[str]) -> str:
    """Fields of a raw JSON record that the contract does not know (array expression)."""
    listed = ", ".join(f"'{a}'" for a in allowed)
    return f"array_except(coalesce(json_object_keys({json}), cast(array() as array<string>)), array({listed}))"
