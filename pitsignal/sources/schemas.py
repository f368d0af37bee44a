"""Spark schemas of the data model's tables."""

from __future__ import annotations

from pyspark.sql import types as T

EVIDENCE_REF = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("char_start", T.LongType()),
    T.StructField("char_end", T.LongType()),
])

EVIDENCE = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("source_record_id", T.StringType()),
    T.StructField("source_revision", T.StringType()),
    T.StructField("authored_at", T.TimestampType()),
    T.StructField("available_at", T.TimestampType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("entity_mentions_raw", T.ArrayType(T.StringType())),
    T.StructField("schema_version", T.StringType()),
])

SIGNAL = T.StructType([
    T.StructField("signal_id", T.StringType()),
    T.StructField("logical_signal_id", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("source_revision", T.StringType()),
    T.StructField("signal_type", T.StringType()),
    T.StructField("signal_subtype", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("impact_channel", T.StringType()),
    T.StructField("business_certainty", T.StringType()),
    T.StructField("conditionality", T.StringType()),
    T.StructField("condition_text", T.StringType()),
    T.StructField("negated", T.BooleanType()),
    T.StructField("magnitude_value", T.DoubleType()),
    T.StructField("magnitude_low", T.DoubleType()),
    T.StructField("magnitude_high", T.DoubleType()),
    T.StructField("magnitude_unit", T.StringType()),
    T.StructField("magnitude_basis", T.StringType()),
    T.StructField("time_expression_raw", T.StringType()),
    T.StructField("effective_start", T.TimestampType()),
    T.StructField("effective_end", T.TimestampType()),
    T.StructField("time_granularity", T.StringType()),
    T.StructField("entity_mentions", T.ArrayType(T.StringType())),
    T.StructField("resolved_entities", T.ArrayType(T.StringType())),
    T.StructField("forecast_key", T.StringType()),
    T.StructField("evidence_ref", EVIDENCE_REF),
    T.StructField("extractor_version", T.StringType()),
    T.StructField("extraction_config_version", T.StringType()),
    T.StructField("extraction_run_id", T.StringType()),
    T.StructField("extracted_at", T.TimestampType()),
    T.StructField("extraction_confidence", T.DoubleType()),
    T.StructField("validation_status", T.StringType()),
    T.StructField("abstention_reason", T.StringType()),
    T.StructField("record_status", T.StringType()),
    T.StructField("supersedes_signal_id", T.StringType()),
    T.StructField("related_signal_ids", T.ArrayType(T.StringType())),
])

FEATURE = T.StructType([
    T.StructField("entity_key", T.StringType()),
    T.StructField("forecast_cutoff", T.TimestampType()),
    T.StructField("feature_definition_version", T.StringType()),
    T.StructField("generated_at", T.TimestampType()),
    T.StructField("contributing_signal_ids", T.ArrayType(T.StringType())),
    T.StructField("schema_version", T.StringType()),
    T.StructField("has_active_signal_30d", T.BooleanType()),
    T.StructField("signal_count_30d", T.LongType()),
    T.StructField("net_demand_direction_30d", T.StringType()),
    T.StructField("expected_qty_delta_next_horizon", T.DoubleType()),
    T.StructField("committed_qty", T.DoubleType()),
    T.StructField("cancelled_qty_30d", T.DoubleType()),
    T.StructField("delay_count_90d", T.LongType()),
    T.StructField("nearest_effective_start_days", T.LongType()),
    T.StructField("days_since_latest_signal", T.LongType()),
    T.StructField("independent_source_count_30d", T.LongType()),
    T.StructField("active_conflict_count", T.LongType()),
    T.StructField("feature_available_at", T.TimestampType()),
    T.StructField("staleness_status", T.StringType()),
])

DEMAND = T.StructType([
    T.StructField("entity_key", T.StringType()),
    T.StructField("period_start", T.DateType()),
    T.StructField("week_index", T.IntegerType()),
    T.StructField("demand", T.DoubleType()),
])

GROUND_TRUTH = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("signal_type", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("business_certainty", T.StringType()),
    T.StructField("conditionality", T.StringType()),
    T.StructField("condition_text", T.StringType()),
    T.StructField("stated_magnitude_value", T.DoubleType()),
    T.StructField("stated_magnitude_unit", T.StringType()),
    T.StructField("effective_start", T.TimestampType()),
    T.StructField("effective_end", T.TimestampType()),
    T.StructField("negated", T.BooleanType()),
    T.StructField("is_irrelevant", T.BooleanType()),
    T.StructField("is_reversal", T.BooleanType()),
    T.StructField("supersedes_event_id", T.StringType()),
    T.StructField("template_id", T.StringType()),
])

EXPECTED = T.StructType([
    T.StructField("signal_type", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("impact_channel", T.StringType()),
    T.StructField("business_certainty", T.StringType()),
    T.StructField("conditionality", T.StringType()),
    T.StructField("condition_text", T.StringType()),
    T.StructField("negated", T.BooleanType()),
    T.StructField("magnitude_value", T.DoubleType()),
    T.StructField("magnitude_unit", T.StringType()),
    T.StructField("effective_start", T.TimestampType()),
    T.StructField("effective_end", T.TimestampType()),
    T.StructField("forecast_key", T.StringType()),
    T.StructField("supersedes_source_id", T.StringType()),
    T.StructField("decision", T.StringType()),
    T.StructField("abstention_reason", T.StringType()),
])

CASE = T.StructType([
    T.StructField("evidence", EVIDENCE),
    T.StructField("scenario_id", T.StringType()),
    T.StructField("template_group", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("sample", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("label_origin", T.StringType()),
    T.StructField("annotator_ids", T.ArrayType(T.StringType())),
    T.StructField("adjudication_state", T.StringType()),
    T.StructField("adjudicator_id", T.StringType()),
    T.StructField("ambiguity_flag", T.BooleanType()),
    T.StructField("expected", EXPECTED),
    T.StructField("scored_fields", T.ArrayType(T.StringType())),
    T.StructField("field_evidence", T.MapType(T.StringType(), T.ArrayType(EVIDENCE_REF))),
])

ANNOTATIONS = T.StructType([
    T.StructField("schema_version", T.StringType()),
    T.StructField("dataset_id", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("known_entities", T.ArrayType(T.StringType())),
    T.StructField("cases", T.ArrayType(CASE)),
])
