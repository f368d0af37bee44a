"""Registered queries over annotated notes: scoring reports and dataset integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.operators import integrity, scoring
from pitsignal.plans.evaluation import COHORT, run_evaluation
from pitsignal.plans.queries_extraction import order_signals
from pitsignal.sources.derived import cases_from_orders, customer_master
from pitsignal.sources.sinks import multiset_fingerprint
from pitsignal.sources.tables import table
from pitsignal.staging import stage


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases_from_orders(spark, sf_dir).withColumn("label_status", F.expr(scoring.label_status()))


def noisy_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractor output as a flaky run might leave it: lost, repeated, malformed and stale rows."""
    signals = order_signals(spark, sf_dir, keep=()).drop("is_reversal").selectExpr(
        "*", "cast(substr(source_id, 5) as bigint) as k")
    kept = signals.where("k % 43 <> 0").selectExpr(
        "* except (schema_version, source_revision, magnitude_unit, evidence_ref)",
        "if(k % 47 = 0, '9', schema_version) as schema_version",
        "if(k % 53 = 0, 'r2', source_revision) as source_revision",
        "if(k % 59 = 0, null, magnitude_unit) as magnitude_unit",
        "if(k % 7 = 0, named_struct('source_id', source_id, 'char_start', 9L, 'char_end', evidence_ref.char_end), "
        "evidence_ref) as evidence_ref")
    # The repeated rows leave with the row itself, so that no note is read twice.
    ids = "explode(if(k % 41 = 0, array(signal_id, concat(signal_id, '-again')), array(signal_id))) as signal_id"
    return kept.selectExpr(*(ids if c == "signal_id" else c for c in kept.columns if c != "k"))


def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content of the documents of each language, whatever the order and the files of their rows."""
    rows = table(spark, sf_dir, "documents").withColumn("lang", F.coalesce("lang", F.lit("")))
    row = "concat_ws('|', cast(doc_id as string), lang, source, cast(n_chars as string), text)"
    return multiset_fingerprint(rows, row, ("lang",))


def scored_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(scoring.score_cases(
        labelled(spark, sf_dir), stage(noisy_predictions(spark, sf_dir)), cohort=COHORT))


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.per_class(stage(scoring.confusion(scored_notes(spark, sf_dir), COHORT)), COHORT).selectExpr(
        *COHORT, "metric", "label", "tp", "fp", "fn", "round(precision, 6) as precision", "round(recall, 6) as recall",
        "round(f1, 6) as f1")


def classification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and macro-F1 over all notes together."""
    return scoring.classification_summary(stage(scoring.confusion(scored_notes(spark, sf_dir), ())), ()).selectExpr(
        "metric", "round(accuracy, 6) as accuracy", "n_correct", "n_pairs", "round(macro_f1, 6) as macro_f1", "n_classes")


def field_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.field_metrics(scored_notes(spark, sf_dir), COHORT).selectExpr(
        *COHORT, "field", "n", "correct", "tp", "fp", "fn", "round(f1, 6) as f1")


def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.error_taxonomy(scored_notes(spark, sf_dir), COHORT)


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.diagnostics(scored_notes(spark, sf_dir), COHORT).selectExpr(
        "source_id", "expected_decision", "predicted_decision", "array_join(error_types, ',') as error_types",
        "array_join(array_sort(field_errors), ',') as field_errors",
        "array_join(array_sort(unsupported_fields), ',') as unsupported_fields")


def note_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal, entity, grounding and output-count rates per cohort."""
    return scoring.note_rates(scored_notes(spark, sf_dir), COHORT).selectExpr(
        *COHORT, "metric", "round(value, 6) as value", "round(numerator, 4) as numerator", "denominator")


def output_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, predictions = labelled(spark, sf_dir), stage(noisy_predictions(spark, sf_dir))
    none = spark.createDataFrame([], "source_id string, stage string, extraction_run_id string")
    return scoring.output_rates(cases, predictions, none, COHORT).selectExpr(
        *COHORT, "metric", "round(value, 6) as value", "numerator", "denominator")


def abstention_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.abstention_reasons(scored_notes(spark, sf_dir), COHORT).selectExpr(
        *COHORT, "abstention_reason", "numerator", "denominator", "round(value, 6) as value")


def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation: extraction per scenario, linking, scoring, cohort summary."""
    result = run_evaluation(cases_from_orders(spark, sf_dir), customer_master(spark, sf_dir), split="test", validate=False)
    return result.classification()


def case_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.case_errors(cases_from_orders(spark, sf_dir)).groupBy("error").count().withColumnRenamed("count", "n")


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.group_leakage(cases_from_orders(spark, sf_dir))


def supersession_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.supersession_errors(cases_from_orders(spark, sf_dir))


def unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of labels and mentions that no customer has."""
    return integrity.unknown_keys(cases_from_orders(spark, sf_dir), customer_master(spark, sf_dir), mentions=True)


def duplicate_text_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents and benchmark passages that occur in more than one source."""
    documents = table(spark, sf_dir, "documents").selectExpr("text as raw_text", "source as split")
    benchmark = table(spark, sf_dir, "benchmark").selectExpr("text as raw_text", "'benchmark' as split")
    return integrity.duplicate_text_leakage(documents.union(benchmark))


def label_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two plain text rules scored per class against the quality and toxicity labels of documents."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    marks = " or ".join(f"contains(text, '{m}')" for m in ("!!", " | ", "$$$", "%%%"))
    pairs = rows.selectExpr(
        f"inline(array(named_struct('metric', 'quality', 'gold', cast(quality as string), 'pred', if(length(text) < 40 or {marks}, '0', '1')), "
        "named_struct('metric', 'toxic', 'gold', cast(toxic as string), 'pred', if(contains(text, 'http'), '1', '0'))))")
    confusion = pairs.groupBy("metric", "gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    return scoring.per_class(confusion).selectExpr(
        "metric", "label", "tp", "fp", "fn", "round(precision, 6) as precision", "round(recall, 6) as recall", "round(f1, 6) as f1")


def duplicate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes labelled more than once when two annotation batches are combined."""
    cases = cases_from_orders(spark, sf_dir)
    return integrity.duplicate_sources(cases.union(cases.where("sample = 'natural_prevalence'"))).select("source_id", "n")


QUERIES = {
    "dataset_fingerprint": dataset_fingerprint,
    "classification_report": classification_report,
    "classification_summary": classification_summary,
    "field_metrics": field_metrics,
    "error_taxonomy": error_taxonomy,
    "diagnostics": diagnostics,
    "note_rates": note_rates,
    "output_rates": output_rates,
    "abstention_reasons": abstention_reasons,
    "evaluation_run": evaluation_run,
    "case_errors": case_errors,
    "split_leakage": split_leakage,
    "supersession_integrity": supersession_integrity,
    "unknown_keys": unknown_keys,
    "duplicate_text_leakage": duplicate_text_leakage,
    "duplicate_sources": duplicate_sources,
    "label_scoring": label_scoring,
}
