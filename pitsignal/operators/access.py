"""Feature access: the interface consumers call.  Raw note text never leaves it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.operators.contracts import FEATURE_SCHEMA_RULES, errors_of
from pitsignal.operators.features import build_features, contributing_signals, with_availability
from pitsignal.operators.grid import period_grid
from pitsignal.sources.readers import read_ledger, read_notes
from pitsignal.sources.sinks import write_features
from pitsignal.vocabulary import (
    FEATURE_DEFINITION_VERSION, HORIZON_DAYS, LOOKBACK_DAYS, STALENESS_THRESHOLD_DAYS,
)


@dataclass(frozen=True)
class FeatureStore:
    """Signals of one extraction run with their availability, and the feature settings."""

    signals: DataFrame
    feature_definition_version: str = FEATURE_DEFINITION_VERSION
    horizon_days: int = HORIZON_DAYS
    lookback_days: int = LOOKBACK_DAYS
    staleness_threshold_days: int = STALENESS_THRESHOLD_DAYS
    supersession: str = "raw"

    @classmethod
    def of(cls, signals: DataFrame, sources: DataFrame, **settings) -> FeatureStore:
        return cls(with_availability(signals, sources), **settings)

    def _build(self, signals: DataFrame, pairs: DataFrame, version: str | None, **options) -> DataFrame:
        return build_features(
            signals, pairs,
            feature_definition_version=version or self.feature_definition_version,
            horizon_days=self.horizon_days, lookback_days=self.lookback_days,
            staleness_threshold_days=self.staleness_threshold_days, supersession=self.supersession, **options)

    def get_features(
        self, entity_keys: Iterable[str] | DataFrame, forecast_cutoff: str, feature_set_version: str | None = None,
        *, lineage: str = "none", generated_at: str | None = None,
    ) -> DataFrame:
        """Features of each requested entity at one cutoff; unknown entities get zero rows.

        A list of keys is pushed into the ledger scan.  Supersession by signals of other
        entities does not occur, so the filter is safe in both modes.
        """
        at = F.lit(forecast_cutoff).cast("timestamp").alias("forecast_cutoff")
        if isinstance(entity_keys, DataFrame):
            signals = self.signals
            pairs = entity_keys.select("entity_key", at)
        else:
            keys = list(dict.fromkeys(entity_keys))
            signals = self.signals.where(F.col("forecast_key").isin(keys))
            spark = self.signals.sparkSession
            pairs = spark.createDataFrame([(k,) for k in keys], "entity_key string").select("entity_key", at)
        cutoff = self.signals.sparkSession.range(1).select(at)
        return self._build(signals, pairs, feature_set_version, lineage=lineage, generated_at=generated_at, cutoffs=cutoff)

    def get_historical_features(
        self, pairs: DataFrame, feature_set_version: str | None = None, *, lineage: str = "none",
        generated_at: str | None = None, cutoffs: DataFrame | None = None, unique: bool = False,
    ) -> DataFrame:
        """The features as they stood at each (entity_key, forecast_cutoff) of ``pairs``.

        Repeated pairs return repeated rows; ``unique=True`` states that there are none
        and saves the join back.
        """
        built = self._build(
            self.signals, pairs, feature_set_version, lineage=lineage, generated_at=generated_at, cutoffs=cutoffs)
        if unique:
            return built
        request = pairs.select("entity_key", F.col("forecast_cutoff").cast("timestamp").alias("forecast_cutoff"))
        return request.join(built, ["entity_key", "forecast_cutoff"])

    def lineage(self, pairs: DataFrame) -> DataFrame:
        return contributing_signals(
            self.signals, pairs, horizon_days=self.horizon_days, supersession=self.supersession)


def load_feature_store(
    spark: SparkSession, ledger_path: str, notes_path: str, *, extraction_run_id: str, notes_format: str = "json", **settings,
) -> FeatureStore:
    """Store over one run: its ledger partition and the availability of its notes."""
    ledger = read_ledger(spark, ledger_path, extraction_run_id)
    notes = read_notes(spark, notes_path, notes_format).select("source_id", "available_at")
    return FeatureStore.of(ledger, notes, **settings)


def contract_failures(features: DataFrame) -> DataFrame:
    """One row: feature rows and how many break the wire contract."""
    return features.selectExpr(f"size({errors_of(FEATURE_SCHEMA_RULES)}) > 0 as bad").selectExpr(
        "count(*) as feature_rows", "count_if(bad) as schema_failures")


def lineage_path(path: str) -> str:
    """Where the lineage of the feature table at ``path`` is stored."""
    return f"{path.rstrip('/')}-lineage"


def build_feature_table(
    store: FeatureStore, demand: DataFrame, entities: DataFrame, path: str, *,
    feature_set_version: str | None = None, generated_at: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Features of every entity at every demand period, written as a table.

    Returns the stored table and its contract metrics, taken from the stored rows.  The
    contributing signals are a flat table beside it (:func:`lineage_path`).
    """
    grid = period_grid(entities, demand)
    periods = demand.select(F.col("period_start").cast("timestamp").alias("forecast_cutoff")).distinct()
    features = store.get_historical_features(
        grid, feature_set_version, lineage="none", generated_at=generated_at, cutoffs=periods, unique=True)
    write_features(features, path)
    write_features(store.lineage(grid), lineage_path(path))
    stored = features.sparkSession.read.parquet(path)
    return stored, contract_failures(stored)
