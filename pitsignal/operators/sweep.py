"""Aggregation of claims over (entity, cutoff) pairs without pairing them up.

A claim is eligible at a cutoff when it is already available, still open and its
period meets the horizon.  All of these are lower or upper bounds on the cutoff, so
a claim is eligible on one integer interval ``[lo, hi)`` of the cutoff calendar, and
each feature window (30 days, 90 days, nearest start) is a prefix of that interval.

The plan keeps the shuffles to narrow, pre-aggregated rows:

1. claims -> *cells* ``(entity, lo, end, ...)``; equal cells are summed map-side, so a
   hot entity leaves each map task with at most one row per cell, not per claim;
2. a cell of an entity with many claims or cutoffs is repeated per *block* of calendar
   positions, at most about ``BLOCKS`` times, and meets the cutoffs its own entity asked for
   in that block, where cells are summed again; cutoffs of other entities make no rows, a hot
   entity is spread by block, and the cells of a small one go out once;
3. cells still open at the end of the calendar are not expanded to it: they enter once
   and are carried forward by a running window over the entity's cutoffs.

Requested pairs stay in step 2 without any cell, so entities without any claim come out as
zero rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.functions.clock import DAY_US, Calendar, calendar_of
from pitsignal.staging import stage

BLOCKS = 64
WHOLE = 4096  # an entity of so many claims and cutoffs together is one block

_KEY = ("entity_key", "lo", "end", "is_open", "end_30", "end_90", "end_near")

# Cell measures: type and how equal cells combine.
_MEASURES = {
    "n": ("bigint", "sum"),
    "up": ("bigint", "sum"),
    "down": ("bigint", "sum"),
    "up_types": ("bigint", "bit_or"),
    "down_types": ("bigint", "bit_or"),
    "qty": ("double", "sum"),
    "n_qty": ("bigint", "sum"),
    "cancelled": ("double", "sum"),
    "n_cancelled": ("bigint", "sum"),
    "committed": ("double", "sum"),
    "n_committed": ("bigint", "sum"),
    "n_delay": ("bigint", "sum"),
    "latest_us": ("bigint", "max"),
    "nearest_us": ("bigint", "min"),
    "n_sources": ("bigint", "sum"),
}


def _aggregate(df: DataFrame, keys: tuple[str, ...], aggregates: list[str]) -> DataFrame:
    """``GROUP BY keys`` with SQL aggregate text."""
    return df.sparkSession.sql(
        f"select {', '.join((*keys, *aggregates))} from {{df}} group by {', '.join(keys)}", df=df)


def eligibility_intervals(
    claims: DataFrame, calendar: Calendar, *, horizon_days: int, lookback_days: int, long_lookback_days: int,
) -> DataFrame:
    """Attach the calendar interval of each claim and drop claims that are never eligible."""
    at = calendar.at_or_after
    bounded = lambda until: f"greatest(lo, least(hi, coalesce({until}, lo)))"
    spans = claims.selectExpr(
        *claims.columns,
        f"greatest({at('available_us')}, {at(f'(window_start_us - {horizon_days * DAY_US}L + 1)')}) as lo",
        f"least({calendar.size}, {at('window_end_us')}, {at('closed_us')}) as hi",
        f"{at(f'(available_us + {lookback_days * DAY_US}L)')} as until_30",
        f"if(is_delay, {at(f'(available_us + {long_lookback_days * DAY_US}L)')}, null) as until_90",
        f"{calendar.after('near_us')} as until_near",
    ).where("lo < hi")
    return spans.selectExpr(
        *claims.columns, "lo", "hi", f"hi = {calendar.size} as is_open",
        f"{bounded('until_30')} as end_30",
        f"{bounded('until_90')} as end_90",
        f"{bounded('until_near')} as end_near",
    )


def _as_cells(rows: DataFrame, key: dict[str, str], **measures: str) -> DataFrame:
    """Project to the common cell layout; measures not given stay null."""
    return rows.selectExpr(
        *(f"{key.get(k, k)} as {k}" for k in _KEY),
        *(f"cast({measures.get(m, 'null')} as {dtype}) as {m}" for m, (dtype, _) in _MEASURES.items()))


def _claim_cells(spans: DataFrame) -> DataFrame:
    cancelled, committed = "is_cancelled and qty is not null", "is_committed and qty is not null"
    return _as_cells(
        spans,
        # An open cell is expanded only as far as its windows reach.
        {"end": "if(is_open, greatest(lo + 1, end_30, end_90, end_near), hi)"},
        n="1",
        up="if(vote > 0, 1, 0)", down="if(vote < 0, 1, 0)",
        up_types="if(vote > 0, type_bit, null)", down_types="if(vote < 0, type_bit, null)",
        qty="qty * vote", n_qty="if(qty is null, 0, 1)",
        cancelled=f"if({cancelled}, abs(qty), null)", n_cancelled=f"if({cancelled}, 1, 0)",
        committed=f"if({committed}, abs(qty), null)", n_committed=f"if({committed}, 1, 0)",
        n_delay="if(is_delay, 1, 0)",
        latest_us="available_us", nearest_us="near_us",
    )


def _source_cells(spans: DataFrame) -> DataFrame:
    """Cells that count each source once per cutoff: the overlapping spans of a source are merged.

    Equal spans are folded map-side; the rest stream in order through a window, so a source
    of any size is sorted but never gathered.
    """
    spans = _aggregate(spans.where("end_30 > lo"), ("entity_key", "source_id", "lo"), ["max(end_30) as `end`"])
    by = "partition by entity_key, source_id order by lo"
    runs = spans.selectExpr(
        "*", f"max(`end`) over ({by} rows between unbounded preceding and 1 preceding) as reach",
    ).selectExpr("*", f"sum(if(reach >= lo, 0, 1)) over ({by}) as run")
    rows = _aggregate(runs, ("entity_key", "source_id", "run"), ["min(lo) as lo", "max(`end`) as `end`"])
    return _as_cells(
        rows, {"is_open": "false", "end_30": "end", "end_90": "lo", "end_near": "lo"}, n_sources="1")


def _reads(pairs: DataFrame, calendar: Calendar) -> DataFrame:
    """The requested pairs as calendar positions."""
    return pairs.selectExpr("entity_key", "cutoff_us", f"{calendar.at_or_after('cutoff_us')} as idx").distinct()


def _block(calendar: Calendar) -> int:
    """Calendar positions per block: an interval spans at most some ``BLOCKS`` of them."""
    return max(16, -(-calendar.size // BLOCKS))


def _spread(claims: DataFrame, reads: DataFrame, calendar: Calendar) -> DataFrame:
    """``(entity_key, size)``: calendar positions per block of the entities that are cut into blocks.

    An entity of up to ``WHOLE`` claims and cutoffs is met whole, as one block.  The table is at most one
    ``WHOLE``-th of these, and stored: Spark knows its size then, and claims are read for it once.
    """
    sizes = claims.selectExpr("entity_key", "1L as n").union(reads.selectExpr("entity_key", "1L as n"))
    return stage(_aggregate(sizes, ("entity_key",), ["sum(n) as n"]).where(f"n > {WHOLE}").selectExpr(
        "entity_key", f"{_block(calendar)}L as size"))


def _meet(
    rows: DataFrame, reads: DataFrame, large: DataFrame, calendar: Calendar, end: str, how: str = "inner",
    tasks: int | None = None,
) -> DataFrame:
    """The entity's own cutoffs with the rows whose ``[lo, end)`` they lie in; "left" keeps the others.

    A row of a large entity is repeated per block of its interval, not per cutoff of the
    calendar, and meets the requested cutoffs of its entity in that block, so such an entity
    is spread over its blocks; a row of a small one goes out once.  The cutoffs come out of an
    array, which Spark's size estimate does not see, so the join with them may not be planned as a
    broadcast.  ``tasks`` deals the join out over so many tasks; without it Spark's settings do.
    """
    whole = f"coalesce(size, {max(1, calendar.size)}L)"
    cut = not large.isEmpty()
    sized = lambda df: df.join(large, "entity_key", "left") if cut else df.selectExpr("*", "cast(null as bigint) as size")
    dealt = sized(rows).selectExpr(*rows.columns, f"explode(sequence(lo div {whole}, ({end} - 1) div {whole})) as block")
    placed = sized(reads).selectExpr(*reads.columns, f"idx div {whole} as block")
    if tasks is not None:
        dealt, placed = (side.repartition(tasks, "entity_key", "block") for side in (dealt, placed))
    same = f"r.entity_key = c.entity_key and r.block = c.block and r.idx >= c.lo and r.idx < c.{end}"
    return placed.alias("r").join(dealt.alias("c").hint("merge"), F.expr(same), how).selectExpr(
        *(f"r.{c}" for c in reads.columns), *(f"c.`{c}`" for c in rows.columns if c not in reads.columns))


def sweep(
    claims: DataFrame,
    pairs: DataFrame,
    *,
    horizon_days: int,
    lookback_days: int,
    long_lookback_days: int,
    cutoffs: DataFrame | None = None,
) -> DataFrame:
    """One row of raw aggregates per distinct ``(entity_key, cutoff_us)`` of ``pairs``.

    ``claims`` columns: entity_key, source_id, available_us, window_start_us,
    window_end_us (null side = unbounded), closed_us (instant from which the claim no
    longer counts, or null), near_us, vote, type_bit, qty (null = not counted),
    is_cancelled, is_committed, is_delay.

    ``cutoffs`` names the cutoffs of ``pairs`` where the caller knows them (a grid), which
    saves reading ``pairs`` for the calendar.
    """
    days = dict(horizon_days=horizon_days, lookback_days=lookback_days, long_lookback_days=long_lookback_days)
    calendar = calendar_of(pairs if cutoffs is None else cutoffs)
    spans = eligibility_intervals(claims, calendar, **days)
    rows = _claim_cells(spans).union(_source_cells(spans))
    cells = _aggregate(rows, _KEY, [f"{how}({m}) as {m}" for m, (_, how) in _MEASURES.items()])
    reads = _reads(pairs, calendar)
    # Cells that are open at the end of the calendar also enter once, where they begin.
    begun = cells.where("is_open").selectExpr("entity_key", "lo as idx", "cast(null as bigint) as cutoff_us", "n as n_begun", "latest_us as latest_begun")
    at = _meet(cells, reads, _spread(claims, reads, calendar), calendar, "`end`", "left").unionByName(begun, allowMissingColumns=True)
    in_30 = lambda m, how="sum": f"{how}(if(idx < end_30, {m}, null)) as {m}"
    counted = ("up", "down", "qty", "n_qty", "cancelled", "n_cancelled", "committed", "n_committed", "n_sources")
    per_cutoff = _aggregate(at, ("entity_key", "idx"), [
        "max(cutoff_us) as cutoff_us",
        "coalesce(sum(if(idx < end_30, n, null)), 0) as n_30",
        *(in_30(m) for m in counted), in_30("up_types", "bit_or"), in_30("down_types", "bit_or"),
        "coalesce(sum(if(idx < end_90, n_delay, null)), 0) as n_delay",
        "min(if(idx < end_near, nearest_us, null)) as nearest_us",
        "coalesce(sum(if(is_open, null, n)), 0) as n_closed",
        "coalesce(sum(n_begun), 0) as n_opened",
        "max(if(is_open, null, latest_us)) as latest_closed",
        "max(latest_begun) as latest_opened",
    ])
    so_far = "(partition by entity_key order by idx rows between unbounded preceding and current row)"
    return per_cutoff.selectExpr(
        "*", f"sum(n_opened) over {so_far} as n_open_now", f"max(latest_opened) over {so_far} as latest_open_now",
    ).where("cutoff_us is not null").selectExpr(
        "entity_key", "cutoff_us", "n_30",
        "n_closed + n_open_now as n_eligible",
        "coalesce(up, 0) as up", "coalesce(down, 0) as down",
        "cast(bit_count(coalesce(up_types & down_types, 0L)) as bigint) as n_conflicts",
        "if(n_qty > 0, qty, null) as qty",
        "if(n_cancelled > 0, cancelled, null) as cancelled",
        "if(n_committed > 0, committed, null) as committed",
        "n_delay", "nearest_us",
        "greatest(latest_closed, latest_open_now) as latest_us",
        "coalesce(n_sources, 0) as n_sources",
    )


def memberships(
    claims: DataFrame, pairs: DataFrame, *,
    horizon_days: int, lookback_days: int, long_lookback_days: int, keep: tuple[str, ...],
    cutoffs: DataFrame | None = None, tasks: int | None = None,
) -> DataFrame:
    """Long lineage ``(entity_key, cutoff_us, *keep)``: one row per eligible claim and pair, made by ``tasks`` tasks.

    The output is as large as the answer itself.  It is never grouped here: an entity
    with many claims spreads over its cutoffs, and rows stay flat.
    """
    days = dict(horizon_days=horizon_days, lookback_days=lookback_days, long_lookback_days=long_lookback_days)
    calendar = calendar_of(pairs if cutoffs is None else cutoffs)
    claim_rows = eligibility_intervals(claims, calendar, **days).selectExpr("entity_key", "lo", "hi", *keep)
    reads = _reads(pairs, calendar)
    dealt = {} if tasks is None else {"tasks": tasks}
    return _meet(claim_rows, reads, _spread(claims, reads, calendar), calendar, "hi", **dealt).select(
        "entity_key", "cutoff_us", *keep)
