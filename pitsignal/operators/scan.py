"""Running state over time for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.staging import stage

HOUR_US = 3_600_000_000


def running_before(
    points: DataFrame, keys: tuple[str, ...], us: str, *, sums: tuple[str, ...] = (), xors: tuple[str, ...] = (),
    block: str | None = None,
) -> DataFrame:
    """Add ``before_<c>``: the sum (or xor) of ``c`` over all earlier points of the group.

    ``points`` has one row per (keys, us); ``block`` names a column that rises with ``us``
    and cuts it into pieces (hours, when ``us`` is a time).  The scan has two levels so that a group with
    most of the data is not one sorted partition: running values inside time blocks of
    the group, plus the running total of the blocks before (one row per block).
    """
    spark, by = points.sparkSession, ", ".join(keys)
    measures = [(c, "sum") for c in sums] + [(c, "bit_xor") for c in xors]
    columns = [c for c in points.columns if c != block]
    blocked = points.selectExpr(*columns, f"{block or f'{us} div {HOUR_US}L'} as block")
    earlier = f"(partition by {by}, block order by {us} rows between unbounded preceding and 1 preceding)"
    inside = blocked.selectExpr("*", *(f"{how}({c}) over {earlier} as in_{c}" for c, how in measures))
    totals = spark.sql(
        f"select {by}, block, {', '.join(f'{how}({c}) as {c}' for c, how in measures)} "
        f"from {{df}} group by {by}, block", df=blocked)
    blocks_before = f"(partition by {by} order by block rows between unbounded preceding and 1 preceding)"
    offsets = totals.selectExpr(*keys, "block", *(f"{how}({c}) over {blocks_before} as off_{c}" for c, how in measures))
    combine = lambda c, how: (
        f"coalesce(in_{c}, 0L) {'+' if how == 'sum' else '^'} coalesce(off_{c}, 0L) as before_{c}")
    return inside.join(offsets, [*keys, "block"]).selectExpr(
        *columns, *(combine(c, how) for c, how in measures))


def lag_in_order(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: str, steps: int) -> DataFrame:
    """Add ``before``: the ``value`` of the row ``steps`` places earlier in the group's order; null where there is none.

    The rows are cut into ranges of the order.  Places run through all ranges of a group, and a
    range gets, besides its own rows, copies of the rows ``steps`` places before them that lie in
    other ranges: at most ``steps`` a range, so a group of any size is looked up range by range.
    Names that begin with an underscore are used on the way.
    """
    by, along = ", ".join(keys), ", ".join(order)
    ranged = stage(rows.repartitionByRange(*keys, *order).selectExpr("*", "spark_partition_id() as _part"))
    counts = ranged.groupBy(*keys, "_part").count().selectExpr(
        *keys, "_part", f"sum(count) over (partition by {by} order by _part) as _stop", "count")
    starts = counts.selectExpr(*keys, "_part", "_stop - count as _offset", "_stop")
    placed = ranged.selectExpr("*", f"row_number() over (partition by {by}, _part order by {along}) as _inside").join(
        starts, [*keys, "_part"]).selectExpr(*keys, "_part", *(c for c in rows.columns if c not in keys), "_offset + _inside as _place", "_stop")
    # A copy goes to the last range that starts before the place it is looked up from.
    looked_up = placed.where(f"_place + {steps} > _stop").selectExpr(*keys, f"_place + {steps} as _at", "cast(null as int) as _part", "_place", value)
    borders = starts.selectExpr(*keys, "_offset + 1 as _at", "_part", "cast(null as bigint) as _place", f"cast(null as {dict(rows.dtypes)[value]}) as {value}")
    copies = borders.unionByName(looked_up).selectExpr(
        *keys, "_place", value, f"max(_part) over (partition by {by} order by _at range between unbounded preceding and current row) as _part",
    ).where("_place is not null")
    own = placed.drop("_stop").withColumn("_own", F.lit(True))
    every = own.unionByName(copies.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    found = every.selectExpr(
        *rows.columns, "_own", f"max({value}) over (partition by {by}, _part order by _place range between {steps} preceding and {steps} preceding) as before")
    return found.where("_own").drop("_own")
