"""Scalar expressions shared by the extracted and the oracle feature builders."""

from __future__ import annotations

from pitsignal.functions.clock import floor_days
from pitsignal.vocabulary import SIGNAL_TYPES, STALENESS_THRESHOLD_DAYS


def direction_vote(direction: str = "direction", negated: str = "negated") -> str:
    """+1 for an increase, -1 for a decrease, flipped when negated, otherwise 0."""
    sign = f"if(coalesce({negated}, false), -1, 1)"
    return f"case {direction} when 'INCREASE' then {sign} when 'DECREASE' then -{sign} else 0 end"


def net_direction(n: str, up: str, down: str) -> str:
    return (
        f"case when {n} = 0 then 'UNKNOWN' when {up} > 0 and {down} > 0 then 'MIXED' "
        f"when {up} > {down} then 'INCREASE' when {up} < {down} then 'DECREASE' else 'STABLE' end")


def days_since(cutoff_us: str, latest_us: str) -> str:
    return floor_days(f"({cutoff_us} - {latest_us})")


def staleness(days: str, threshold_days: int = STALENESS_THRESHOLD_DAYS) -> str:
    return f"case when {days} is null then 'UNKNOWN' when {days} <= {threshold_days} then 'FRESH' else 'STALE' end"


def type_bit(signal_type: str = "signal_type") -> str:
    """One bit per signal type, so that a set of types is a bitwise-or."""
    bits = " ".join(f"when '{t}' then {1 << i}L" for i, t in enumerate(SIGNAL_TYPES))
    return f"case {signal_type} {bits} end"
