"""Notes to ledger: extract, reconcile, validate, split, persist."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.operators.contracts import (
    EVIDENCE_MODEL_RULES, EVIDENCE_SCHEMA_RULES, classify, conformance, errors_of,
)
from pitsignal.operators.extract import extract_signals
from pitsignal.operators.reconcile import not_reversals, relinked_reversals
from pitsignal.sources.schemas import EVIDENCE, SIGNAL
from pitsignal.sources.sinks import append_quarantine, append_to_ledger
from pitsignal.staging import stage


@dataclass(frozen=True)
class ExtractionRun:
    extraction_run_id: str
    classified: DataFrame
    notes: DataFrame

    @property
    def accepted(self) -> DataFrame:
        return self.classified.where("stage is null").select(*SIGNAL.names)

    @property
    def quarantined(self) -> DataFrame:
        """Rejected notes with the error, its stage, the evidence and the rejected record."""
        evidence = self.notes.selectExpr("source_id", f"struct({', '.join(EVIDENCE.names)}) as source_evidence")
        rejected = self.classified.where("stage is not null").selectExpr(
            "source_id", "error", "stage", "extraction_run_id", f"struct({', '.join(SIGNAL.names)}) as rejected_record")
        unreadable = self._invalid_evidence().selectExpr(
            "source_id", "errors[0] as error", "'construct' as stage", f"'{self.extraction_run_id}' as extraction_run_id",
            f"cast(null as {SIGNAL.simpleString()}) as rejected_record")
        return rejected.unionByName(unreadable).join(evidence, "source_id", "left")

    def _invalid_evidence(self) -> DataFrame:
        return with_evidence_errors(self.notes).where("size(errors) > 0")

    def conformance(self) -> DataFrame:
        """Accepted, quarantined, rate."""
        stages = self.classified.select("stage").unionByName(self._invalid_evidence().selectExpr("'construct' as stage"))
        return conformance(stages)


def with_evidence_errors(notes: DataFrame) -> DataFrame:
    return notes.selectExpr("*", f"{errors_of([*EVIDENCE_SCHEMA_RULES, *EVIDENCE_MODEL_RULES])} as errors")


def require_unique_sources(notes: DataFrame) -> None:
    duplicate = notes.where("source_id is not null").groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1)
    if duplicate:
        raise ValueError(f"the snapshot repeats source_id {duplicate[0]['source_id']}")


def run_extraction(
    notes: DataFrame, known_entities, *, extraction_run_id: str, scope: tuple[str, ...] = (),
    check_unique: bool = True, **versions,
) -> ExtractionRun:
    """Extract and reconcile a snapshot of notes.

    ``scope`` names note columns (such as a scenario id) that reversals must not cross.
    """
    if check_unique:
        require_unique_sources(notes)
    valid = with_evidence_errors(notes).where("size(errors) = 0").drop("errors")
    # Linking reads the signals several times; the texts are interpreted and checked once.
    checked = stage(classify(extract_signals(
        valid, known_entities, extraction_run_id=extraction_run_id,
        keep=("authored_at", "available_at", *scope), **versions), "signal_record"))
    # Only records that pass the contracts are linked, so no link names a quarantined one.
    sound = checked.where("stage is null").drop("stage", "error")
    linked = relinked_reversals(sound, ("extraction_run_id", *scope))
    columns = [*SIGNAL.names, "stage", "error"]
    # A link changes reversals only; what was checked before stands for the others.
    settled = checked.where("stage is not null").union(not_reversals(checked.where("stage is null")))
    classified = classify(linked, "signal_record").select(*columns).unionByName(settled.select(*columns))
    return ExtractionRun(extraction_run_id, classified, notes)


def run_and_persist(notes: DataFrame, known_entities, ledger_path: str, quarantine_path: str, **kwargs) -> tuple[ExtractionRun, int]:
    """Append accepted rows to the ledger and rejected ones beside it.

    The validated rows feed both sinks, so they are kept while the sinks run; lost
    partitions are recomputed from the notes.
    """
    run = run_extraction(notes, known_entities, **kwargs)
    run.classified.persist()
    try:
        written = append_to_ledger(run.accepted, ledger_path)
        append_quarantine(run.quarantined, quarantine_path)
    finally:
        run.classified.unpersist()
    return run, written
