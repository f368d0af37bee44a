"""Sources: notes, ground truth, demand, ledger, annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.operators.contracts import EVIDENCE_MODEL_RULES, EVIDENCE_SCHEMA_RULES, errors_of, unknown_json_fields
from pitsignal.sources import schemas as S
from pitsignal.sources.commits import CommitLog


def read_notes(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Sound evidence rows.  Time stamps without a zone mean UTC; blank lines are skipped.

    JSON lines that are not sound are left to :func:`rejected_notes`, never turned into
    rows of nulls.
    """
    if fmt == "json":
        return sound_notes(check_raw_notes(spark.read.text(path)))
    return _filled(spark.read.schema(S.EVIDENCE).format(fmt).load(path))


def sound_notes(checked: DataFrame) -> DataFrame:
    """The evidence of checked lines that have no errors."""
    return _filled(checked.where("size(errors) = 0").select(*S.EVIDENCE.names))


def _filled(notes: DataFrame) -> DataFrame:
    return notes.withColumns({
        "raw_text": F.coalesce("raw_text", F.lit("")),
        "entity_mentions_raw": F.coalesce("entity_mentions_raw", F.array().cast("array<string>")),
    })


def rejected_notes(spark: SparkSession, path: str) -> DataFrame:
    """The JSON lines that :func:`read_notes` leaves out: text, source id where readable, messages."""
    return check_raw_notes(spark.read.text(path)).where("size(errors) > 0").select("source_id", "raw_record", "errors")


def check_raw_notes(lines: DataFrame, value: str = "value") -> DataFrame:
    """Parse JSON lines against the evidence contract without losing any.

    Adds ``raw_record`` and ``errors`` to the evidence columns; a line that is not JSON,
    misses fields, has unknown fields or breaks a rule keeps its text and its messages.
    """
    ddl = S.EVIDENCE.simpleString()
    parsed = lines.where(f"trim({value}) <> ''").selectExpr(
        f"{value} as raw_record", f"from_json({value}, '{ddl}') as note",
        f"transform({unknown_json_fields(value, S.EVIDENCE.names)}, k -> concat('unknown field ', k)) as unknown",
        f"json_object_keys({value}) is null as unreadable",
    ).selectExpr("note.*", "raw_record", "unknown", "unreadable")
    rules = errors_of([*EVIDENCE_SCHEMA_RULES, *EVIDENCE_MODEL_RULES])
    return parsed.selectExpr(
        *S.EVIDENCE.names, "raw_record",
        f"if(unreadable, array('not a JSON record'), concat(unknown, {rules})) as errors")


def read_ground_truth(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(S.GROUND_TRUTH).format(fmt).load(path)


def read_demand(spark: SparkSession, path: str) -> DataFrame:
    """Demand history; a missing path is an error."""
    return spark.read.parquet(path).select(
        "entity_key", F.col("period_start").cast("date").alias("period_start"),
        F.col("week_index").cast("int").alias("week_index"), F.col("demand").cast("double").alias("demand"))


def committed_ledger(log: CommitLog, entries: list[dict]) -> DataFrame:
    """The rows of some commits of a ledger."""
    folders = [log.full(e["folder"]) for e in entries if e["rows"]]
    if not folders:
        return log.spark.createDataFrame([], S.SIGNAL)
    return log.reader().schema(S.SIGNAL).parquet(*folders).select(*S.SIGNAL.names)


def read_ledger(spark: SparkSession, path: str, extraction_run_id: str | None = None) -> DataFrame:
    """Committed ledger rows, empty when nothing was written yet.  One run reads one partition.

    A folder of Parquet files without a commit log is read as it is.
    """
    log = CommitLog(spark, path)
    if log.is_plain():
        ledger = spark.read.schema(S.SIGNAL).parquet(path).select(*S.SIGNAL.names)
    else:
        ledger = committed_ledger(log, log.entries())
    if extraction_run_id is None:
        return ledger
    return ledger.where(F.col("extraction_run_id") == extraction_run_id)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame | None:
    """Committed rejected rows; None when there are none."""
    log = CommitLog(spark, path)
    folders = [log.full(e["folder"]) for e in log.entries()]
    return log.reader().option("mergeSchema", True).parquet(*folders).drop("commit") if folders else None


def dataset_path(spark: SparkSession, directory: str, table: str) -> str:
    """Where a table (demand, notes, ground_truth) of the corpus committed last lies."""
    log = CommitLog(spark, directory)
    return f"{log.full(log.entries()[-1]['folder'])}/{table}"


def read_bundle(spark: SparkSession, directory: str, run_id: str, name: str) -> DataFrame:
    """An artefact of a saved evaluation run; a run that was never committed is an error."""
    log = CommitLog(spark, f"{directory}/{run_id}")
    entries = log.entries()
    if not entries:
        raise FileNotFoundError(f"no saved run: {log.path}")
    return spark.read.json(f"{log.full(entries[0]['folder'])}/{name}")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row per annotated case, with the dataset's id and master entities alongside."""
    dataset = spark.read.schema(S.ANNOTATIONS).option("multiLine", True).json(path)
    return dataset.selectExpr("dataset_id", "known_entities", "explode(cases) as case").selectExpr(
        "dataset_id", "known_entities", "case.*")
