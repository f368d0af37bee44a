"""Checks around a running feature pipeline: lineage, freshness, drift, alerts, reprocessing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.functions.clock import to_us
from pitsignal.operators.features import contributing_signals
from pitsignal.operators.scan import running_before
from pitsignal.staging import stage


def lineage_trace(signals: DataFrame, sources: DataFrame, pairs: DataFrame, **options) -> DataFrame:
    """Feature row -> signal -> source revision and cited span, one row per link."""
    links = contributing_signals(signals, pairs, **options).select("entity_key", "forecast_cutoff", "signal_id")
    details = signals.selectExpr("signal_id", "source_id", "source_revision", "evidence_ref", "extraction_run_id")
    known = sources.selectExpr("source_id", "source_revision as known_revision", "available_at")
    return links.join(details, "signal_id").join(known, "source_id", "left")


def point_in_time_violations(trace: DataFrame) -> DataFrame:
    """One row: links, and how many use evidence from after their cutoff (must be 0)."""
    return trace.selectExpr(
        "count(*) as links", "count_if(available_at is null) as untraced",
        "count_if(available_at > forecast_cutoff) as violations")


def freshness(features: DataFrame, trace: DataFrame) -> DataFrame:
    """Seconds from the newest evidence of each feature row to the row's availability."""
    newest = trace.groupBy("entity_key", "forecast_cutoff").agg(F.max("available_at").alias("newest_at"))
    return features.join(newest, ["entity_key", "forecast_cutoff"]).selectExpr(
        "entity_key", "forecast_cutoff",
        f"({to_us('feature_available_at')} - {to_us('newest_at')}) div 1000000L as freshness_seconds")


def ks_distance(values: DataFrame, *, blocks: int = 1000) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of each monitored window from the reference.

    ``values``: feature, part (null for the reference, else the monitored window), value.
    Equal values are counted map-side; the distribution functions are running counts over
    the distinct values, scanned in value blocks rather than in one sorted partition.
    """
    counts = stage(values.where("value is not null and not isnan(value)").groupBy("feature", "part", "value").count())
    windows = counts.where("part is not null").select("feature", "part").distinct()
    reference = counts.where("part is null").drop("part").join(windows, "feature")
    sides = reference.selectExpr("feature", "part", "value", "count as ref", "0L as mon").union(
        counts.where("part is not null").selectExpr("feature", "part", "value", "0L", "count"))
    points = sides.groupBy("feature", "part", "value").agg(F.sum("ref").alias("ref"), F.sum("mon").alias("mon"))
    extent = counts.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    placed = points.join(extent, "feature").selectExpr(
        "feature", "part", "value", "ref", "mon",
        f"cast(floor((value - low) / greatest(high - low, 1e-300D) * {blocks}) as bigint) as block")
    running = running_before(placed, ("feature", "part"), "value", sums=("ref", "mon"), block="block")
    sized = running.selectExpr(
        "feature", "part", "before_ref + ref as c_ref", "before_mon + mon as c_mon")
    totals = sized.groupBy("feature", "part").agg(F.max("c_ref").alias("n_ref"), F.max("c_mon").alias("n_mon"))
    return sized.join(totals, ["feature", "part"]).groupBy("feature", "part", "n_ref", "n_mon").agg(
        F.expr("max(abs(c_ref / n_ref - c_mon / n_mon)) as distance")).selectExpr(
        "feature", "part", "n_ref", "n_mon", "distance",
        # Critical distance at the 5% level.
        "1.3581015D * sqrt((n_ref + n_mon) / (n_ref * n_mon)) as critical")


def category_shift(values: DataFrame) -> DataFrame:
    """Chi-square test of homogeneity of each monitored window against the reference.

    ``values``: feature, part (null for the reference), category.  ``z`` is the
    Wilson-Hilferty normal score of the statistic and ``effect`` is Cramer's V.
    """
    counts = stage(values.groupBy("feature", "part", "category").count())
    windows = counts.where("part is not null").select("feature", "part").distinct()
    reference = counts.where("part is null").drop("part").join(windows, "feature")
    sides = reference.selectExpr("feature", "part", "category", "count as ref", "0L as mon").union(
        counts.where("part is not null").selectExpr("feature", "part", "category", "0L", "count"))
    cells = sides.groupBy("feature", "part", "category").agg(F.sum("ref").alias("ref"), F.sum("mon").alias("mon"))
    totals = cells.groupBy("feature", "part").agg(
        F.sum("ref").alias("n_ref"), F.sum("mon").alias("n_mon"), F.count(F.lit(1)).alias("k"))
    expected = lambda n: f"(ref + mon) * {n} / (n_ref + n_mon)"
    term = lambda c, n: f"pow({c} - {expected(n)}, 2) / ({expected(n)})"
    stat = cells.join(totals, ["feature", "part"]).groupBy("feature", "part", "n_ref", "n_mon", "k").agg(
        F.expr(f"sum({term('ref', 'n_ref')} + {term('mon', 'n_mon')}) as chi_square"))
    df = "greatest(k - 1, 1)"
    return stat.selectExpr(
        "feature", "part", "n_ref", "n_mon", "k - 1 as degrees", "chi_square",
        f"(cbrt(chi_square / {df}) - (1 - 2 / (9 * {df}))) / sqrt(2 / (9 * {df})) as z",
        "sqrt(chi_square / (n_ref + n_mon)) as effect")


def alerts(checks: DataFrame, *, min_effect: float) -> DataFrame:
    """Persistent alerts over monitored windows.

    ``checks``: feature, part, significant, effect, and optionally immediate.  A window
    alerts when test and effect size agree in it and in the window before; an immediate
    finding (a schema or point-in-time violation) alerts at once.
    """
    immediate = "immediate" if "immediate" in checks.columns else "false"
    fired = checks.selectExpr(
        "feature", "part", f"significant and effect >= {min_effect}D as fired", f"coalesce({immediate}, false) as immediate")
    return fired.selectExpr(
        "feature", "part", "fired", "lag(fired) over (partition by feature order by part) as before",
        "lag(part) over (partition by feature order by part) as part_before", "immediate",
    ).selectExpr(
        "feature", "part", "fired",
        "immediate or fired and coalesce(before and part - part_before = 1, false) as alert", "immediate as critical")


def degradation(losses: DataFrame, *, slack: float, threshold: float, persist: int = 2) -> DataFrame:
    """feature, part: the window in which a lasting rise of the loss is confirmed; no row without one.

    ``losses``: feature, part, loss, where 0 is the reference level.  The statistic is the
    cumulative sum of (loss - slack) that starts again from 0 whenever it would fall below:
    the running sum less its own running minimum, so a window expression instead of a loop.
    Confirmed is the ``persist``-th consecutive window (of consecutive parts) above ``threshold``.
    """
    so_far = "over (partition by feature order by part rows unbounded preceding)"
    sums = losses.where("loss is not null and not isnan(loss)").selectExpr(
        "feature", "part", f"sum(loss - {slack}D) {so_far} as running")
    above = sums.selectExpr("feature", "part", f"running - least(0D, min(running) {so_far}) as statistic").where(
        f"statistic > {threshold}D")
    islands = above.selectExpr("feature", "part", "part - row_number() over (partition by feature order by part) as island")
    runs = islands.selectExpr("feature", "part", "row_number() over (partition by feature, island order by part) as run")
    return runs.where(f"run = {persist}").groupBy("feature").agg(F.min("part").alias("part"))


def lead_time(alert_rows: DataFrame, degraded: DataFrame) -> DataFrame:
    """Windows between the first alert of each feature and its confirmed degradation.

    ``degraded``: feature, part.  A feature with only one of the two has no lead; a negative
    lead is an alert that came after the degradation.
    """
    first = alert_rows.where("alert").groupBy("feature").agg(F.min("part").alias("first_alert"))
    return first.join(degraded.withColumnRenamed("part", "confirmed"), "feature", "full_outer").selectExpr(
        "feature", "first_alert", "confirmed", "confirmed - first_alert as lead")


def length_cell(n: str) -> str:
    """The smallest length of the cell of ``n``: exact below 64, cells of at most 1/32 of their value above."""
    step = f"shiftleft(1L, greatest(length(bin({n})) - 6, 0))"
    return f"{n} - {n} % {step}"


def text_profile(texts: DataFrame) -> DataFrame:
    """Mergeable profile of the texts of each window: feature, part, cell, count.

    ``texts``: part, text.  ``length`` counts texts by the cell of their length in code points
    (relative error 1/32 at most); ``vocabulary`` counts words between blanks by a slot
    of 4,096, the first three digits of their MD5, so a distance of slots never exceeds that of the words.
    A profile has a bounded number of rows; profiles add up, so stored windows are never read again.
    A null text counts as empty.
    """
    size = "char_length(coalesce(text, ''))"
    lengths = texts.selectExpr("part", f"cast({size} as bigint) as n").selectExpr(
        "'length' as feature", "part", f"{length_cell('n')} as cell")
    words = texts.selectExpr("part", "explode(split(text, '[\\\\x20\\\\x09-\\\\x0D]+')) as word").where("word <> ''").groupBy("part", "word").count()
    slots = words.selectExpr(
        "'vocabulary' as feature", "part", "cast(conv(substr(md5(cast(word as binary)), 1, 3), 16, 10) as bigint) as cell", "count")
    return lengths.groupBy("feature", "part", "cell").count().union(
        slots.groupBy("feature", "part", "cell").agg(F.sum("count").alias("count")))


def merged(profiles: DataFrame) -> DataFrame:
    """The profile of all windows together: feature, cell, count."""
    return profiles.groupBy("feature", "cell").agg(F.sum("count").alias("count"))


def profile_shift(profiles: DataFrame, reference: DataFrame) -> DataFrame:
    """Distances of each window's profile from a reference profile.

    ``steps`` is the largest gap of the running shares in the order of cells (Kolmogorov-Smirnov
    on cells), ``variation`` half the summed gaps of the shares (total variation).
    """
    parts = profiles.select("feature", "part").distinct()
    sides = profiles.selectExpr("feature", "part", "cell", "count as mon", "0L as ref").union(
        reference.join(parts, "feature").selectExpr("feature", "part", "cell", "0L", "count"))
    cells = sides.groupBy("feature", "part", "cell").agg(F.sum("mon").alias("mon"), F.sum("ref").alias("ref"))
    whole = "over (partition by feature, part)"
    so_far = "over (partition by feature, part order by cell rows unbounded preceding)"
    shares = cells.selectExpr(
        "feature", "part", f"sum(mon) {whole} as n_mon", f"sum(ref) {whole} as n_ref", "mon", "ref",
        f"sum(mon) {so_far} as c_mon", f"sum(ref) {so_far} as c_ref")
    return shares.groupBy("feature", "part", "n_mon", "n_ref").agg(
        F.expr("max(abs(c_mon / n_mon - c_ref / n_ref)) as steps"),
        F.expr("sum(abs(mon / n_mon - ref / n_ref)) / 2 as variation"))


def rolling_correlation(rows: DataFrame, feature: str, target: str, *, periods: int = 12) -> DataFrame:
    """Correlation of a feature with a target over the last ``periods`` periods, all entities pooled.

    The moments are summed per period first; the window runs over periods only.
    """
    x, y = f"cast({feature} as double)", f"cast({target} as double)"
    moments = rows.where(f"{feature} is not null and {target} is not null").groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"sum({x}) as sx"), F.expr(f"sum({y}) as sy"),
        F.expr(f"sum({x} * {x}) as sxx"), F.expr(f"sum({y} * {y}) as syy"), F.expr(f"sum({x} * {y}) as sxy"))
    last = f"over (order by period rows between {periods - 1} preceding and current row)"
    sums = moments.selectExpr("period", *(f"sum({c}) {last} as {c}" for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    spread = "sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))"
    return sums.selectExpr("period", "n", f"(n * sxy - sx * sy) / nullif({spread}, 0) as correlation")


_COMPARED = ("signal_type", "direction", "impact_channel", "business_certainty", "conditionality", "condition_text",
             "negated", "magnitude_value", "magnitude_unit", "effective_start", "effective_end", "forecast_key",
             "validation_status", "supersedes_signal_id")


def reprocessing_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per field: signals whose value changed between two extraction runs, and one-sided signals."""
    side = lambda df, p: df.selectExpr("logical_signal_id", f"struct({', '.join(_COMPARED)}) as {p}")
    joined = side(before, "a").join(side(after, "b"), "logical_signal_id", "full_outer")
    changed = ", ".join(f"if(a is not null and b is not null and not (a.{c} <=> b.{c}), '{c}', null)" for c in _COMPARED)
    return joined.selectExpr(
        f"explode(array_compact(array({changed}, if(a is null, 'added', null), if(b is null, 'removed', null)))) as change",
    ).groupBy("change").count().withColumnRenamed("count", "signals")
