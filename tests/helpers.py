"""Small row builders shared by the tests."""

from datetime import datetime, timezone

from pitsignal.sources.schemas import EVIDENCE, SIGNAL
from pyspark.sql import types as T


def utc(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def note_rows(spark, notes):
    """Evidence rows from ``(source_id, text, authored_at, available_at, mentions)``."""
    rows = [(sid, "account_note", sid, "r1", utc(a), utc(v), text, "sha256:x", list(m), "0.1.0")
            for sid, text, a, v, m in notes]
    return spark.createDataFrame(rows, EVIDENCE)


def note(sid, text, authored="2026-01-05T09:00:00", available=None, mentions=("CUST-0001",)):
    return (sid, text, authored, available or authored.replace("T09:00", "T09:10"), mentions)


def signal(signal_id, source_id, available_at="2026-02-01T00:00:00", **over):
    row = dict(
        signal_id=signal_id, logical_signal_id="l-" + signal_id, schema_version="0.1.0", source_id=source_id,
        source_revision="r1", signal_type="DEMAND_EXPECTATION", signal_subtype="increase", direction="INCREASE",
        impact_channel="DEMAND", business_certainty="LIKELY", conditionality="NONE", negated=False,
        entity_mentions=["CUST-0001"], resolved_entities=["CUST-0001"], forecast_key="CUST-0001",
        evidence_ref=(source_id, 0, 10), extractor_version="t", extraction_config_version="t",
        extraction_run_id="run-1", extracted_at=utc("2026-02-02T00:00:00"), validation_status="PASS",
        record_status="ACTIVE", related_signal_ids=[])
    row.update(over)
    for c in ("effective_start", "effective_end"):
        if isinstance(row.get(c), str):
            row[c] = utc(row[c])
    if row.get("magnitude_value") is not None:
        row.setdefault("magnitude_unit", "units")
    row["available_at"] = utc(available_at) if available_at else None
    return row


LEDGER = T.StructType([*SIGNAL.fields, T.StructField("available_at", T.TimestampType())])


def ledger_frame(spark, rows, schema=LEDGER):
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def pair_frame(spark, pairs):
    return spark.createDataFrame(
        [(e, utc(c)) for e, c in pairs], "entity_key string, forecast_cutoff timestamp")
