"""The signal ledger as it stood at a cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.functions.clock import to_us


PASSING_SUPERSESSION = "validation_status = 'PASS' and supersedes_signal_id is not null"


def supersession_times(signals: DataFrame) -> DataFrame:
    """``(signal_id, superseded_us)``: when each superseded signal stopped counting.

    One pre-aggregated pass serves any number of cutoffs: a signal is superseded at
    ``t`` exactly when its earliest passing superseder was available by ``t``.
    ``signals`` carries ``available_at``.
    """
    return (
        signals.where(PASSING_SUPERSESSION)
        .groupBy(F.col("supersedes_signal_id").alias("signal_id"))
        .agg(F.expr(f"min({to_us('available_at')}) as superseded_us"))
    )


def ledger_as_of(ledger: DataFrame, sources: DataFrame, cutoff: str, *, extraction_run_id: str) -> DataFrame:
    """Rows of one run whose source was known at ``cutoff``, with derived status.

    Fails when a row's source is missing or its revision differs: lineage is never
    guessed.  Stored rows are not changed.
    """
    run = ledger.where(F.col("extraction_run_id") == extraction_run_id)
    known = sources.selectExpr("source_id", "source_revision as _revision", "available_at as _available_at")
    checked = (
        "case when _revision is null then "
        "raise_error(concat('ledger row without source evidence: ', source_id)) "
        "when _revision <> source_revision then "
        "raise_error(concat('source revision does not match ledger lineage: ', source_id)) "
        "else _available_at end")
    visible = (
        run.join(known, "source_id", "left")
        .where(f"cast({checked} as timestamp) <= timestamp '{cutoff}'")
        .select(*ledger.columns)
    )
    targets = visible.where(PASSING_SUPERSESSION).selectExpr(
        "supersedes_signal_id as signal_id", "true as _superseded").distinct()
    status = F.expr("if(_superseded, 'SUPERSEDED', record_status)")
    return visible.join(targets, "signal_id", "left").withColumn("record_status", status).select(*ledger.columns)
