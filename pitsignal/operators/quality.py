"""Sanity of a demand history and summary of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def series_quality(demand: DataFrame, season: int = 52) -> DataFrame:
    """Per entity: gaps, impossible values, spread, and correlation with one season before."""
    lagged = demand.selectExpr(
        "entity_key", "week_index", "demand",
        f"lag(demand, {season}) over (partition by entity_key order by week_index) as season_ago",
        "isnan(demand) or abs(demand) = double('Infinity') as not_finite")
    return lagged.groupBy("entity_key").agg(
        F.expr("count(*) as weeks"),
        # A dense series of distinct weeks 0..max has no missing week.
        F.expr("cast(max(week_index) + 1 - count(distinct week_index) as bigint) as missing_weeks"),
        F.expr("count_if(demand < 0) as negative_weeks"), F.expr("count_if(not_finite) as not_finite_weeks"),
        F.expr("stddev_samp(demand) as spread"),
        F.expr("if(stddev_pop(if(season_ago is null, null, demand)) > 0 and stddev_pop(season_ago) > 0, "
               "corr(if(season_ago is null, null, demand), season_ago), null) as yearly_correlation"))


def demand_sanity(demand: DataFrame, season: int = 52) -> DataFrame:
    """One row of checks over all entities; every flag must be true for a usable history."""
    per_entity = series_quality(demand, season)
    return per_entity.selectExpr(
        "count(*) as entities", "min(weeks) = max(weeks) and sum(missing_weeks) = 0 as dense",
        "sum(negative_weeks) = 0 as non_negative", "sum(not_finite_weeks) = 0 as finite",
        "min(spread) > 0 as varies", "coalesce(avg(yearly_correlation) > 0, false) as seasonal")


def corpus_summary(truth: DataFrame, notes: DataFrame, demand: DataFrame) -> DataFrame:
    """One row: sizes of the corpus and the share of irrelevant notes."""
    counts = truth.selectExpr(
        "count_if(not is_irrelevant) as n_signal_notes", "count_if(is_irrelevant) as n_irrelevant_notes",
        "count_if(is_reversal) as n_reversal_notes")
    n_notes = notes.selectExpr("count(*)").scalar()
    sizes = demand.selectExpr("struct(count(distinct entity_key), count(distinct week_index), count(*))").scalar()
    return counts.select("*", n_notes.alias("n_notes"), sizes.alias("sizes")).selectExpr(
        "sizes.col1 as n_entities", "sizes.col2 as n_weeks", "sizes.col3 as n_demand_rows",
        "n_notes", "n_signal_notes", "n_irrelevant_notes", "n_reversal_notes",
        "if(n_notes = 0, 0.0D, n_irrelevant_notes / n_notes) as irrelevant_fraction")
