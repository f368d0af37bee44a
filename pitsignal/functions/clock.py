"""Time arithmetic as SQL expressions, and the cutoff calendar.

Inside the aggregation plans time is a ``bigint`` of microseconds since the epoch
(UTC).  Both Spark timestamp types convert to it, so a ledger stored with zoned
timestamps and a table with plain ones can meet in one plan.

A *calendar* places instants on an integer axis from the first to the last cutoff of a
request, in steps of the request's spacing where that is regular and in microseconds
otherwise.  An eligibility interval in time thereby becomes an integer interval
``[lo, hi)``, by arithmetic alone: no list of cutoffs is collected or shipped.

Functions in this package return SQL expression text for ``selectExpr``/``expr``: they
compose as strings and reach the JVM once, as one parsed expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

DAY_US = 86_400_000_000


def to_us(ts: str) -> str:
    """Microseconds since the epoch of a timestamp, timestamp_ntz or date expression."""
    return f"unix_micros(cast({ts} as timestamp))"


def from_us(us: str) -> str:
    return f"timestamp_micros({us})"


def floor_div(x: str, unit: int) -> str:
    return f"(({x}) - pmod({x}, {unit}L)) div {unit}L"


def floor_days(us: str) -> str:
    """Whole days in a span of microseconds."""
    return floor_div(us, DAY_US)


@dataclass(frozen=True)
class Calendar:
    """The axis of a request: first cutoff, step (both in microseconds) and number of positions."""

    first: int
    step: int
    size: int

    def at_or_after(self, us: str) -> str:
        """Position of the first step ``>= us``; ``size`` when there is none, null for null."""
        last = self.first + (self.size - 1) * self.step
        if not self.size:
            return f"if({us} is null, null, 0L)"
        return (f"case when {us} <= {self.first}L then 0L when {us} > {last}L then {self.size}L "
                f"when {us} is not null then ({us} - {self.first}L + {self.step - 1}L) div {self.step}L end")

    def after(self, us: str) -> str:
        """Position of the first step ``> us``."""
        return self.at_or_after(f"({us} + 1)")


def calendar_of(cutoffs: DataFrame) -> Calendar:
    """The calendar of the ``cutoff_us`` of a request, from its ends, their number and one check of the spacing."""
    known = cutoffs.where("cutoff_us is not null")
    ends = known.selectExpr("min(cutoff_us) as first", "max(cutoff_us) as last", "count(distinct cutoff_us) as n").first()
    if not ends["n"]:
        return Calendar(0, 1, 0)
    first, length, gaps = ends["first"], ends["last"] - ends["first"], ends["n"] - 1
    if gaps and length % gaps == 0 and not known.where(f"(cutoff_us - {first}L) % {length // gaps}L <> 0").take(1):
        return Calendar(first, length // gaps, ends["n"])
    return Calendar(first, 1, length + 1)
