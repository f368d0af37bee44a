"""Incremental extraction: note lines that arrive as files, through the gate into the ledger.

A micro-batch goes the way of a batch run: lines that are no sound evidence and signals that
break the contract are quarantined, the rest is appended, each with one commit that carries
the batch's key.  A batch that is replayed after a crash finds its keys committed and writes
nothing twice.  Linking reversals needs the claims of other batches and remains a batch job
over the ledger.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pitsignal.operators.contracts import classify
from pitsignal.operators.extract import extract_signals
from pitsignal.sources.readers import check_raw_notes, sound_notes
from pitsignal.sources.schemas import SIGNAL
from pitsignal.sources.sinks import append_quarantine, append_to_ledger
from pitsignal.staging import stage


def stream_notes(spark: SparkSession, path: str) -> DataFrame:
    """The lines of note files as they arrive."""
    return spark.readStream.text(path)


def ingest(
    lines: DataFrame, known_entities: DataFrame | Iterable[str], ledger_path: str, quarantine_path: str, *,
    extraction_run_id: str, key: str, **versions,
) -> int:
    """Extract one batch of JSON lines; returns the number of ledger rows written."""
    checked = stage(check_raw_notes(lines))
    signals = stage(classify(extract_signals(
        sound_notes(checked), known_entities, extraction_run_id=extraction_run_id, **versions), "signal_record"))
    written = append_to_ledger(signals.where("stage is null"), ledger_path, key)
    run = f"'{extraction_run_id}' as extraction_run_id"
    record = SIGNAL.simpleString()
    rejected = signals.where("stage is not null").selectExpr(
        "source_id", "error", "stage", run, f"struct({', '.join(SIGNAL.names)}) as rejected_record", "cast(null as string) as raw_record")
    unsound = checked.where("size(errors) > 0").selectExpr(
        "source_id", "errors[0] as error", "'construct' as stage", run, f"cast(null as {record}) as rejected_record", "raw_record")
    append_quarantine(rejected.unionByName(unsound), quarantine_path, key)
    return written


def start_extraction(
    lines: DataFrame, known_entities: DataFrame | Iterable[str], ledger_path: str, quarantine_path: str, checkpoint: str, *,
    extraction_run_id: str, **versions,
) -> StreamingQuery:
    """Ingest all lines available now; a restart goes on after the last batch that was finished."""
    def write(batch: DataFrame, number: int) -> None:
        ingest(batch, known_entities, ledger_path, quarantine_path, extraction_run_id=extraction_run_id,
               key=f"{extraction_run_id}/{number}", **versions)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
