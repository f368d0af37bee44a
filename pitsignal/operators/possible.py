"""Keeping rows that have no partner out of a join's shuffle.

The keys of the smaller side set bits by their hash.  A row whose bit is not set has no partner;
one whose bit is set may have one, and goes on to the join, which decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24  # sent to every task as at most BITS / 64 rows of two numbers, however many keys there are


def with_possible(rows: DataFrame, keys: DataFrame, *, key: str, hashed: str) -> DataFrame:
    """Add ``possible``: false where the hash ``hashed`` of a row is none of the hashes ``key`` of ``keys``."""
    place = lambda h: f"pmod({h}, {BITS}L)"
    words = keys.where(f"{key} is not null").selectExpr(f"{place(key)} as _bit").groupBy(
        F.expr("_bit div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_bit % 64 as int)))").alias("_bits"))
    placed = rows.selectExpr("*", f"{place(hashed)} as _bit").selectExpr("*", "_bit div 64 as _word")
    return placed.join(F.broadcast(words), "_word", "left").selectExpr(
        *rows.columns, "coalesce(getbit(_bits, cast(_bit % 64 as int)) = 1, false) as possible")
