"""Upper-bound features from ground truth instead of extracted signals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pitsignal.functions.clock import from_us, to_us
from pitsignal.functions.votes import days_since, direction_vote, net_direction, staleness
from pitsignal.operators.features import request_pairs
from pitsignal.operators.sweep import sweep
from pitsignal.staging import stage
from pitsignal.vocabulary import (
    HORIZON_DAYS, LONG_LOOKBACK_DAYS, LOOKBACK_DAYS, ORACLE_FEATURE_VERSION, SCHEMA_VERSION,
)


def claims_from_truth(truth: DataFrame, notes: DataFrame | None) -> DataFrame:
    """Relevant truth rows as claims, available when their note was.

    The entity is the note's first mention; the period restricts a row only when both
    ends are stated.  Without ``notes`` the truth rows carry ``available_at`` and ``entity_key``.
    """
    relevant = truth.where("not coalesce(is_irrelevant, false)")
    if notes is None:
        return _claims(relevant.where("available_at is not null and entity_key is not null"))
    known = notes.selectExpr(
        "source_id", "available_at", "try_element_at(entity_mentions_raw, 1) as entity_key",
    ).where("available_at is not null and entity_key is not null")
    # Both sides are as long as the notes, however small their files are: no broadcast.
    return _claims(relevant.join(known.hint("merge"), "source_id"))


def _claims(rows: DataFrame) -> DataFrame:
    both = "effective_start is not null and effective_end is not null"
    return rows.selectExpr(
        "entity_key", "source_id", "source_id as signal_id",
        f"{to_us('available_at')} as available_us",
        f"if({both}, {to_us('effective_start')}, null) as window_start_us",
        f"if({both}, {to_us('effective_end')}, null) as window_end_us",
        "cast(null as bigint) as closed_us", "cast(null as bigint) as near_us",
        f"{direction_vote()} as vote",
        # Conflicts are judged over all types together.
        "1L as type_bit",
        "if(stated_magnitude_unit <=> '%', null, stated_magnitude_value) as qty",
        "false as is_cancelled", "false as is_committed", "false as is_delay",
    )


def build_oracle_features(
    truth: DataFrame, notes: DataFrame | None, pairs: DataFrame, *, generated_at: str | None = None,
    horizon_days: int = HORIZON_DAYS, lookback_days: int = LOOKBACK_DAYS, cutoffs: DataFrame | None = None,
) -> DataFrame:
    """Feature-shaped rows per distinct (entity_key, forecast_cutoff).

    The claims are stored for the sweep, which reads them several times.
    """
    known = None if cutoffs is None else cutoffs.selectExpr(f"{to_us('forecast_cutoff')} as cutoff_us")
    raw = sweep(
        stage(claims_from_truth(truth, notes).drop("signal_id")), request_pairs(pairs), horizon_days=horizon_days,
        lookback_days=lookback_days, long_lookback_days=LONG_LOOKBACK_DAYS, cutoffs=known)
    clock = f"timestamp '{generated_at}'" if generated_at else "current_timestamp()"
    since = days_since("cutoff_us", "latest_us")
    return raw.selectExpr(
        "entity_key", f"{from_us('cutoff_us')} as forecast_cutoff",
        f"'{ORACLE_FEATURE_VERSION}' as feature_definition_version", f"{clock} as generated_at",
        "cast(array() as array<string>) as contributing_signal_ids", f"'{SCHEMA_VERSION}' as schema_version",
        "n_30 > 0 as has_active_signal_30d", "n_30 as signal_count_30d",
        f"{net_direction('n_30', 'up', 'down')} as net_demand_direction_30d",
        "qty as expected_qty_delta_next_horizon",
        "cast(null as double) as committed_qty", "cast(null as double) as cancelled_qty_30d",
        "0L as delay_count_90d", "cast(null as bigint) as nearest_effective_start_days",
        f"{since} as days_since_latest_signal", "n_sources as independent_source_count_30d",
        "n_conflicts as active_conflict_count", f"{clock} as feature_available_at",
        f"{staleness(since)} as staleness_status", "n_eligible as contributing_signal_count",
    )
