"""Registered queries over notes: cues, signals, identifiers, contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitsignal.functions import ids
from pitsignal.operators import quality
from pitsignal.operators.contracts import classify, conformance, violations
from pitsignal.operators.extract import detect_cues, extract_signals, resolve_entities
from pitsignal.sources.derived import (
    RAW_NOTES_SQL, customer_master, notes_from_orders, resolved_notes_from_orders, signals_from_events, truth_from_orders, weekly_demand,
)
from pitsignal.sources.readers import check_raw_notes
from pitsignal.sources.tables import table

RUN = "run-1"
CLOCK = "2002-01-01 00:00:00"


def order_signals(
    spark: SparkSession, sf_dir: str, keep=("authored_at", "available_at"), *, master: DataFrame | None = None, carry=(),
) -> DataFrame:
    """Signals of the order notes; ``carry`` names columns of ``master`` that come along with the forecast key."""
    notes = resolved_notes_from_orders(
        spark, sf_dir, customer_master(spark, sf_dir) if master is None else master, tuple(carry))
    return extract_signals(notes, None, extraction_run_id=RUN, extracted_at=CLOCK, keep=(*keep, *carry))


def _ntz(*cols: str) -> list[str]:
    return [f"cast({c} as timestamp_ntz) as {c}" for c in cols]


def extract_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_cues(notes_from_orders(spark, sf_dir), ["source_id"]).selectExpr(
        "source_id", "direction", "negated", "conflict", "business_certainty", "conditionality", "condition_text",
        "magnitude_value", "magnitude_unit", "magnitude_basis", "signal_type", "is_reversal",
        "time_expression_raw", "time_granularity", *_ntz("effective_start", "effective_end"))


def document_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues over whole real-length texts in several languages."""
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text as raw_text", "timestamp '2024-01-01 00:00:00' as authored_at")
    return detect_cues(docs, ["doc_id"]).selectExpr(
        "doc_id", "direction", "negated", "conflict", "business_certainty", "conditionality",
        "signal_type", "is_reversal", "time_granularity", "cast(text_length as bigint) as text_length")


def conversation_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues and reversals in the turns of conversations."""
    turns = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "role", "text as raw_text", "timestamp '2024-01-01 00:00:00' as authored_at")
    return detect_cues(turns, ["conv_id", "turn", "role"]).selectExpr(
        "conv_id", "turn", "role", "direction", "negated", "conflict", "business_certainty", "conditionality",
        "signal_type", "is_reversal", "time_granularity", "cast(text_length as bigint) as text_length")


def raw_note_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw note lines with what the reader finds wrong with them."""
    lines = spark.sql(RAW_NOTES_SQL, orders=table(spark, sf_dir, "orders"))
    return check_raw_notes(lines).where("size(errors) > 0").selectExpr("raw_record", "array_join(errors, '; ') as errors")


def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_entities(notes_from_orders(spark, sf_dir), customer_master(spark, sf_dir)).selectExpr(
        "source_id", "array_join(resolved_entities, ',') as resolved_entities", "forecast_key")


def extracted_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_signals(spark, sf_dir).selectExpr(
        "signal_id", "logical_signal_id", "source_id", "signal_type", "signal_subtype", "direction", "impact_channel",
        "business_certainty", "conditionality", "condition_text", "negated", "magnitude_value", "magnitude_unit",
        "magnitude_basis", *_ntz("effective_start", "effective_end"), "forecast_key", "evidence_ref.char_end as char_end",
        "validation_status", "abstention_reason")


def signal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = notes_from_orders(spark, sf_dir)
    physical = ["source_id", "source_revision", "'rules-v0.2.0'", "'cfg-v0.2.0'", f"'{RUN}'"]
    return notes.selectExpr(
        "source_id", f"{ids.signal_id(physical)} as signal_id",
        f"{ids.signal_id(['source_type', 'source_record_id'])} as logical_signal_id")


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{ids.content_hash('text')} as content_hash")


def contract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations in a ledger assembled from events, which break several rules."""
    return violations(_loose_signals(spark, sf_dir), "signal_record", "signal_id")


def _loose_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event signals as a feed might deliver them: units, spans and versions not always right."""
    return signals_from_events(spark, sf_dir).selectExpr(
        "*", "cast(substr(signal_id, 5) as bigint) as k").selectExpr(
        "* except (supersedes_signal_id, effective_start, effective_end, direction)",
        "if(k % 97 = 0, 'SIDEWAYS', if(k % 46 = 0, 'STABLE', direction)) as direction",
        "if(k % 31 = 0, null, 'r1') as source_revision",
        "signal_id as logical_signal_id", "if(k % 41 = 0, '0.2.0', '0.1.0') as schema_version",
        "'DEMAND' as impact_channel", "if(k % 53 = 0, 'MAYBE', 'NONE') as conditionality",
        "if(k % 3 = 0, null, 'units') as magnitude_unit",
        "if(k % 11 = 0, magnitude_value + 1, null) as magnitude_low",
        "if(k % 22 = 0, magnitude_value, null) as magnitude_high",
        "if(k % 59 = 0, effective_end, effective_start) as effective_start",
        "if(k % 59 = 0, effective_start, effective_end) as effective_end",
        "cast(null as string) as time_granularity", "array(forecast_key) as entity_mentions",
        "named_struct('source_id', if(k % 29 = 0, 'elsewhere', source_id), 'char_start', k % 7 - 1, "
        "'char_end', k % 5) as evidence_ref",
        "'x' as extractor_version", "'x' as extraction_config_version", "'run' as extraction_run_id",
        "timestamp '2024-02-01 00:00:00' as extracted_at",
        "if(k % 61 = 0, 1.5D, null) as extraction_confidence",
        "if(k % 67 = 0, signal_id, null) as supersedes_signal_id")


def quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accept/quarantine split of the same ledger, per stage and first error."""
    return classify(_loose_signals(spark, sf_dir), "signal_record").selectExpr(
        "coalesce(stage, 'accepted') as stage", "coalesce(error, '') as error",
    ).groupBy("stage", "error").count().withColumnRenamed("count", "n")


def conformance_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformance(classify(_loose_signals(spark, sf_dir), "signal_record")).selectExpr(
        "accepted", "quarantined", "round(schema_conformance_rate, 6) as schema_conformance_rate")


def feature_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract failures of the feature rows of every user and day."""
    from pitsignal.operators.access import contract_failures
    from pitsignal.plans.queries_features import event_features

    return contract_failures(event_features(spark, sf_dir))


def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the notes, their truth and the demand history."""
    found = quality.corpus_summary(
        truth_from_orders(spark, sf_dir), notes_from_orders(spark, sf_dir), weekly_demand(spark, sf_dir))
    return found.selectExpr("* except (irrelevant_fraction)", "round(irrelevant_fraction, 6) as irrelevant_fraction")


QUERIES = {
    "extract_cues": extract_cues,
    "document_cues": document_cues,
    "conversation_cues": conversation_cues,
    "raw_note_errors": raw_note_errors,
    "entity_resolution": entity_resolution,
    "extract_signals": extracted_signals,
    "signal_ids": signal_ids,
    "content_hash": content_hash,
    "contract_errors": contract_errors,
    "quarantine_counts": quarantine_counts,
    "conformance_rate": conformance_rate,
    "feature_contract": feature_contract,
    "corpus_summary": corpus_summary,
}
