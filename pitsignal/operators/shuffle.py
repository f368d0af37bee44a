"""Shuffled control: features handed to the wrong entity of the same cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pitsignal.functions.clock import to_us

# Entities of one cutoff are ranked by a digest, bucket by bucket, so that no task sorts
# all entities of a cutoff: 16**4 buckets of equal expected size.
_BUCKET_DIGITS = 4


def _ranked(rows: DataFrame, seed: int, salt: str) -> DataFrame:
    """Add ``rank``: the position of the row in a seeded random order of its cutoff."""
    hashed = rows.selectExpr("*", f"md5(concat_ws('|', '{seed}', '{salt}', {to_us('forecast_cutoff')}, entity_key)) as h").selectExpr(
        "*", f"left(h, {_BUCKET_DIGITS}) as bucket")
    inside = hashed.selectExpr(
        "*", "row_number() over (partition by forecast_cutoff, bucket order by h, entity_key) as place")
    sizes = hashed.groupBy("forecast_cutoff", "bucket").count()
    offsets = sizes.selectExpr(
        "forecast_cutoff", "bucket", "coalesce(sum(count) over (partition by forecast_cutoff order by bucket "
        "rows between unbounded preceding and 1 preceding), 0) as offset")
    return inside.join(offsets, ["forecast_cutoff", "bucket"]).selectExpr(
        *rows.columns, "offset + place as rank")


def shuffle_features(features: DataFrame, *, seed: int = 99) -> DataFrame:
    """Permute entity keys inside each cutoff; values stay, lineage is emptied.

    The permutation is a function of ``seed`` and the keys only.  ``features`` is read
    twice (all columns, and its two key columns): pass a stored table.
    """
    rows = _ranked(features, seed, "row")
    keys = _ranked(features.select("forecast_cutoff", "entity_key"), seed, "key").withColumnRenamed(
        "entity_key", "new_entity")
    changed = {"entity_key": "new_entity", "contributing_signal_ids": "cast(array() as array<string>)"}
    return rows.join(keys, ["forecast_cutoff", "rank"]).selectExpr(
        *(f"{changed[c]} as {c}" if c in changed else c for c in features.columns))
