"""Point-in-time features per (entity, cutoff) from a signal ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.functions.clock import floor_days, from_us, to_us
from pitsignal.functions.votes import days_since, direction_vote, net_direction, staleness, type_bit
from pitsignal.operators.ledger import supersession_times
from pitsignal.operators.possible import with_possible
from pitsignal.operators.sweep import memberships, sweep
from pitsignal.staging import stage
from pitsignal.vocabulary import (
    FEATURE_DEFINITION_VERSION, HORIZON_DAYS, LONG_LOOKBACK_DAYS, LOOKBACK_DAYS, SCHEMA_VERSION,
    STALENESS_THRESHOLD_DAYS,
)

# Active rows that passed or await review and carry a signal.
ACTIONABLE = "record_status = 'ACTIVE' and validation_status in ('PASS', 'REVIEW') and signal_type <> 'NO_SIGNAL'"

LINKS_PER_TASK = 500_000  # links that one task makes, or gathers into arrays


def with_availability(signals: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach ``available_at`` by source; signals without a source drop out.

    Repeated rows of a source count once; two different availabilities of one source fail.
    """
    clash = "raise_error(concat('two availabilities for source ', source_id))"
    known = sources.where("source_id is not null").groupBy("source_id").agg(
        F.min("available_at").alias("low"), F.max("available_at").alias("high"))
    return signals.join(known, "source_id").selectExpr(
        *signals.columns, f"if(low <=> high, low, cast({clash} as timestamp)) as available_at")


def claims_from_signals(signals: DataFrame, *, supersession: str = "raw") -> DataFrame:
    """Actionable signals in the claim layout of :func:`pitsignal.operators.sweep.sweep`.

    ``signals`` carries ``available_at``.  ``supersession="raw"`` trusts the stored
    status; ``"as_of"`` closes a signal once a passing row that supersedes it is
    available, so each cutoff sees the ledger as it stood then.
    """
    if supersession not in ("raw", "as_of"):
        raise ValueError("supersession must be 'raw' or 'as_of'")
    rows = signals.where(f"{ACTIONABLE} and forecast_key is not null and available_at is not null")
    closed = "cast(null as bigint)"
    if supersession == "as_of":
        rows, closed = _with_supersession(rows, supersession_times(signals)), "superseded_us"
    cancelled = "signal_type = 'ORDER_LIFECYCLE' and direction = 'DECREASE'"
    return rows.selectExpr(
        "forecast_key as entity_key", "source_id", "signal_id",
        f"{to_us('available_at')} as available_us",
        f"{to_us('effective_start')} as window_start_us",
        f"{to_us('effective_end')} as window_end_us",
        f"{closed} as closed_us",
        f"{to_us('effective_start')} as near_us",
        f"{direction_vote()} as vote",
        f"{type_bit()} as type_bit",
        "if(magnitude_basis <=> 'PERCENT', null, magnitude_value) as qty",
        f"{cancelled} as is_cancelled",
        f"not ({cancelled}) and business_certainty in ('ASSERTED', 'EXPECTED') as is_committed",
        "signal_type = 'TIMING_REVISION' and direction = 'DECREASE' as is_delay",
    )


def _with_supersession(rows: DataFrame, times: DataFrame) -> DataFrame:
    """Attach ``superseded_us``; rows that a bit set of the superseded rules out are not shuffled for it."""
    flagged = with_possible(rows, times.select(F.xxhash64("signal_id").alias("h")), key="h", hashed="xxhash64(signal_id)")
    met = flagged.where("possible").join(times, "signal_id", "left").select(*rows.columns, "superseded_us")
    return met.union(flagged.where("not possible").selectExpr(*rows.columns, "cast(null as bigint) as superseded_us"))


def request_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.selectExpr("entity_key", f"{to_us('forecast_cutoff')} as cutoff_us")


def build_features(
    signals: DataFrame,
    pairs: DataFrame,
    *,
    generated_at: str | None = None,
    feature_definition_version: str = FEATURE_DEFINITION_VERSION,
    horizon_days: int = HORIZON_DAYS,
    lookback_days: int = LOOKBACK_DAYS,
    staleness_threshold_days: int = STALENESS_THRESHOLD_DAYS,
    supersession: str = "raw",
    lineage: str = "none",
    cutoffs: DataFrame | None = None,
) -> DataFrame:
    """One feature row per distinct (entity_key, forecast_cutoff) of ``pairs``.

    ``generated_at`` is a timestamp literal; without it the query's own start time is
    used.  ``lineage="array"`` adds ``contributing_signal_ids`` in (availability,
    source, signal) order; ``"none"`` leaves the array empty and lineage is read from
    :func:`contributing_signals`.  ``contributing_signal_count`` is always present.
    ``cutoffs`` lists the request's distinct ``forecast_cutoff`` where already known.
    """
    claims = claims_from_signals(signals, supersession=supersession)
    if lineage != "array":
        claims = claims.drop("signal_id")
    if supersession == "as_of":
        # The sweep reads claims several times; signals meet their superseders once.
        claims = stage(claims)
    days = dict(horizon_days=horizon_days, lookback_days=lookback_days, long_lookback_days=LONG_LOOKBACK_DAYS)
    request = request_pairs(pairs)
    known = None if cutoffs is None else cutoffs.selectExpr(
        f"{to_us('forecast_cutoff')} as cutoff_us")
    raw = sweep(claims, request, cutoffs=known, **days)
    if lineage == "array":
        raw = _attach_lineage(raw, claims, request, known, days)
    elif lineage == "none":
        raw = raw.selectExpr("*", "cast(array() as array<string>) as contributing_signal_ids")
    else:
        raise ValueError("lineage must be 'none' or 'array'")
    clock = f"timestamp '{generated_at}'" if generated_at else "current_timestamp()"
    since = days_since("cutoff_us", "latest_us")
    return raw.selectExpr(
        "entity_key",
        f"{from_us('cutoff_us')} as forecast_cutoff",
        f"'{feature_definition_version}' as feature_definition_version",
        f"{clock} as generated_at",
        "contributing_signal_ids",
        f"'{SCHEMA_VERSION}' as schema_version",
        "n_30 > 0 as has_active_signal_30d",
        "n_30 as signal_count_30d",
        f"{net_direction('n_30', 'up', 'down')} as net_demand_direction_30d",
        "qty as expected_qty_delta_next_horizon",
        "committed as committed_qty",
        "cancelled as cancelled_qty_30d",
        "n_delay as delay_count_90d",
        f"{floor_days('(nearest_us - cutoff_us)')} as nearest_effective_start_days",
        f"{since} as days_since_latest_signal",
        "n_sources as independent_source_count_30d",
        "n_conflicts as active_conflict_count",
        f"{clock} as feature_available_at",
        f"{staleness(since, staleness_threshold_days)} as staleness_status",
        "n_eligible as contributing_signal_count",
    )


def _attach_lineage(
    raw: DataFrame, claims: DataFrame, request: DataFrame, cutoffs: DataFrame | None, days: dict,
) -> DataFrame:
    """Collect the ids of each pair; a request that wants whole arrays in rows gets them at any size.

    The swept rows hold the number of links of each pair, so the tasks that make and gather them are as many
    as the links ask for: a fixed number of partitions would hold ever more of them.
    """
    key = ["entity_key", "cutoff_us"]
    raw = stage(raw)
    rest = [c for c in raw.columns if c not in key]
    tasks = raw.selectExpr(f"cast(coalesce(sum(1 + n_eligible), 0) div {LINKS_PER_TASK} + 1 as int) as n").first()["n"]
    packed = raw.selectExpr(*key, f"struct({', '.join(rest)}) as row")
    links = memberships(
        claims, request.distinct(), cutoffs=cutoffs, keep=("available_us", "source_id", "signal_id"), tasks=tasks, **days)
    joined = packed.repartition(tasks, *key).join(links.repartition(tasks, *key), key, "left")
    ordered = F.expr("transform(array_sort(links), x -> x.signal_id) as contributing_signal_ids")
    return joined.groupBy(*key).agg(
        F.first("row").alias("row"),
        F.expr("collect_list(if(signal_id is null, null, struct(available_us, source_id, signal_id))) as links"),
    ).select(*key, "row.*", ordered)


def contributing_signals(
    signals: DataFrame, pairs: DataFrame, *, horizon_days: int = HORIZON_DAYS, supersession: str = "raw",
) -> DataFrame:
    """Lineage as a flat table: every eligible signal of every requested pair."""
    links = memberships(
        claims_from_signals(signals, supersession=supersession), request_pairs(pairs).distinct(),
        horizon_days=horizon_days, lookback_days=LOOKBACK_DAYS, long_lookback_days=LONG_LOOKBACK_DAYS,
        keep=("signal_id", "source_id", "available_us"))
    return links.selectExpr(
        "entity_key", f"{from_us('cutoff_us')} as forecast_cutoff", "signal_id", "source_id",
        f"{from_us('available_us')} as available_at")


def eligible_signals(
    signals: DataFrame, entity_key: str, cutoff: str, *, horizon_days: int = HORIZON_DAYS,
) -> DataFrame:
    """The ledger rows eligible for one entity at one cutoff (a plain pushed-down filter)."""
    at = f"timestamp '{cutoff}'"
    return signals.where(F.col("forecast_key") == entity_key).where(
        f"{ACTIONABLE} and available_at <= {at} "
        f"and coalesce(effective_start < {at} + interval {horizon_days} days, true) "
        f"and coalesce(effective_end > {at}, true)")
