"""Registered queries over the note ledger: reversals, time travel, access, controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.operators.access import FeatureStore
from pitsignal.operators.grid import period_grid
from pitsignal.operators.ledger import ledger_as_of
from pitsignal.operators.oracle import build_oracle_features
from pitsignal.operators.reconcile import LINK_COLUMNS, not_reversals, relinked_reversals, reversal_links, reversal_states
from pitsignal.operators.shuffle import shuffle_features
from pitsignal.plans.queries_extraction import CLOCK, order_signals
from pitsignal.plans.queries_features import FEATURE_COLUMNS, event_features
from pitsignal.sources.derived import (
    customer_master, customer_nations, nation_signals_key, notes_from_orders, signals_from_events, truth_from_orders, weekly_demand,
)
from pitsignal.sources.sinks import append_actions
from pitsignal.staging import stage
from pitsignal.sources.tables import table

# Instants inside the range of the tables at which point-in-time views are taken.
LEDGER_CUTOFF = "2024-01-16 00:00:00"
LATEST_CUTOFF = "2001-07-02 00:00:00"


def stored_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-note signals as a ledger at rest: extracted once, then scanned by column."""
    return stage(order_signals(spark, sf_dir))


def linkable_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the columns that linking reads; the others are not extracted."""
    return stage(order_signals(spark, sf_dir).select("extraction_run_id", *LINK_COLUMNS))


def reversal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open claims each reversal could mean when it was written, before any link."""
    return reversal_states(linkable_signals(spark, sf_dir)).selectExpr("source_id", "forecast_key", "n as candidates")


def reversal_link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversal_links(linkable_signals(spark, sf_dir))


def _event_ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    signals = signals_from_events(spark, sf_dir).selectExpr(
        "*", "'r1' as source_revision", "'run-1' as extraction_run_id")
    sources = signals.select("source_id", "source_revision", "available_at").distinct()
    return signals.drop("available_at"), sources


def ledger_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, sources = _event_ledger(spark, sf_dir)
    return ledger_as_of(ledger, sources, LEDGER_CUTOFF, extraction_run_id="run-1").select(
        "signal_id", "source_id", "record_status", "supersedes_signal_id")


def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What appending all event signals does to a ledger that holds the first half month.

    The stored copies of error events were revised since, so they conflict; the signals
    of the last week were already stored by another run.
    """
    batch = signals_from_events(spark, sf_dir).selectExpr("*", "'run-1' as extraction_run_id")
    revised = "if(signal_type = 'TIMING_REVISION', 'LIKELY', business_certainty)"
    first = batch.where("available_at <= timestamp_ntz '2024-01-16 00:00:00'").withColumn(
        "business_certainty", F.expr(revised))
    other = batch.where("available_at > timestamp_ntz '2024-01-24 00:00:00'").withColumn(
        "extraction_run_id", F.lit("run-0"))
    twice = batch.union(batch.where("signal_type = 'ORDER_LIFECYCLE'"))
    return append_actions(twice, first.union(other))


# What features are made of; an experiment reads nothing else of a signal.
CLAIM_COLUMNS = (
    "signal_id", "source_id", "forecast_key", "available_at", "signal_type", "direction", "negated", "business_certainty",
    "magnitude_basis", "magnitude_value", "effective_start", "effective_end", "record_status", "validation_status")


def nation_signals(spark: SparkSession, sf_dir: str, *, linked: bool = False) -> DataFrame:
    """Order-note signals keyed by the customer's nation, with availability.

    The nations come along with the customer that a note resolves to, so signals are not shuffled to meet them.
    Linking reads the signals several times: what it and the features read is stored before it, for signals of
    a customer that say something, and the reversals once more after it.
    """
    carry = ("nation_keys",)
    signals = order_signals(spark, sf_dir, master=customer_nations(spark, sf_dir), carry=carry).where(
        "forecast_key is not null and size(nation_keys) > 0")
    if not linked:
        return stage(_by_nation(signals.select(*CLAIM_COLUMNS, *carry)))
    columns = dict.fromkeys(("extraction_run_id", *LINK_COLUMNS, *CLAIM_COLUMNS, "supersedes_signal_id", *carry))
    stored = stage(signals.where("signal_type <> 'NO_SIGNAL'").select(*columns))
    reversals = stage(relinked_reversals(stored).select(*CLAIM_COLUMNS, "supersedes_signal_id", *carry))
    return _by_nation(reversals.union(not_reversals(stored).select(*reversals.columns)))


def _by_nation(signals: DataFrame) -> DataFrame:
    kept = [c for c in signals.columns if c not in ("forecast_key", "nation_keys")]
    return signals.selectExpr(*kept, "explode(nation_keys) as forecast_key")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_signals_key(spark, sf_dir).selectExpr("nation_key as entity_key").distinct()


def feature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_grid(nations(spark, sf_dir), weekly_demand(spark, sf_dir)).selectExpr(
        "entity_key", "cast(forecast_cutoff as timestamp_ntz) as forecast_cutoff")


def historical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every nation at every demand week; each pair is requested twice."""
    store = FeatureStore(nation_signals(spark, sf_dir))
    grid = period_grid(nations(spark, sf_dir), weekly_demand(spark, sf_dir))
    return store.get_historical_features(grid.union(grid), generated_at=CLOCK, lineage="none").selectExpr(*FEATURE_COLUMNS)


def latest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every customer at one cutoff, with lineage."""
    store = FeatureStore(stored_signals(spark, sf_dir))
    return store.get_features(
        customer_master(spark, sf_dir), LATEST_CUTOFF, "fdv-test", generated_at=CLOCK, lineage="array",
    ).selectExpr(
        *FEATURE_COLUMNS, "feature_definition_version", "array_join(contributing_signal_ids, ',') as contributing_signal_ids")


def month_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer at every month start, a calendar with uneven steps."""
    months = table(spark, sf_dir, "orders").selectExpr(
        "sequence(cast(date_trunc('month', min(o_orderdate)) as timestamp), "
        "cast(date_trunc('month', max(o_orderdate)) as timestamp), interval 1 month)").scalar()
    return customer_master(spark, sf_dir).select("entity_key", F.explode(months).alias("forecast_cutoff"))


def oracle_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_oracle_features(
        truth_from_orders(spark, sf_dir), notes_from_orders(spark, sf_dir), month_pairs(spark, sf_dir), generated_at=CLOCK,
    ).selectExpr(
        "entity_key", "cast(forecast_cutoff as timestamp_ntz) as forecast_cutoff", "has_active_signal_30d",
        "signal_count_30d", "net_demand_direction_30d", "expected_qty_delta_next_horizon", "days_since_latest_signal",
        "independent_source_count_30d", "active_conflict_count", "staleness_status", "contributing_signal_count")


def shuffled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_features(stage(event_features(spark, sf_dir))).selectExpr(*FEATURE_COLUMNS)


def shuffle_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cutoff, what a permutation of entities must preserve."""
    shuffled = shuffle_features(stage(event_features(spark, sf_dir)))
    return shuffled.selectExpr("*", "cast(forecast_cutoff as timestamp_ntz) as cutoff").groupBy("cutoff").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity_key").alias("n_entities"),
        F.sum("signal_count_30d").alias("signals"), F.sum("delay_count_90d").alias("delays"),
        F.sum(F.size("contributing_signal_ids")).alias("lineage"))


QUERIES = {
    "reversal_candidates": reversal_candidates,
    "reversal_links": reversal_link_rows,
    "ledger_as_of": ledger_view,
    "ledger_append": ledger_append,
    "feature_grid": feature_grid,
    "historical_features": historical_features,
    "latest_features": latest_features,
    "oracle_features": oracle_features,
    "shuffled_features": shuffled_features,
    "shuffle_invariants": shuffle_invariants,
}
