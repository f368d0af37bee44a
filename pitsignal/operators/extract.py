"""Notes to signals: one projection per note, plus entity resolution against a master."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal import vocabulary as V
from pitsignal.functions import cues, ids
from pitsignal.sources.schemas import SIGNAL


def detect_cues(notes: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """All text cues of each note, next to the columns named in ``keep``.

    ``direction`` and ``signal_type`` are null where the text has no cue.
    """
    keep = list(keep)
    flags = notes.selectExpr(
        "* except (raw_text)", "coalesce(raw_text, '') as raw_text", "lower(coalesce(raw_text, '')) as low",
    ).selectExpr(
        "*", f"{cues.negated()} as negated", f"{cues.rising()} as rising", f"{cues.falling()} as falling",
        f"{cues.steady()} as steady", f"{cues.time_expression()} as time_expression_raw",
        f"{cues.condition_text()} as condition_text", f"{cues.magnitude_value()} as magnitude_value")
    return flags.selectExpr(
        *keep,
        f"{cues.direction()} as direction",
        "negated",
        "not negated and rising and falling as conflict",
        f"{cues.certainty()} as business_certainty",
        "if(condition_text is null, 'NONE', 'CONDITIONAL') as conditionality",
        "condition_text",
        "magnitude_value",
        "if(magnitude_value is null, null, '%') as magnitude_unit",
        "if(magnitude_value is null, null, 'PERCENT') as magnitude_basis",
        f"{cues.subject()} as signal_type",
        f"{cues.is_reversal()} as is_reversal",
        "time_expression_raw",
        f"{cues.by_time_expression(1)} as time_granularity",
        f"{cues.by_time_expression(2)} as effective_start",
        f"{cues.by_time_expression(3)} as effective_end",
        "length(raw_text) as text_length",
    )


def _forecast_key(resolved: str) -> str:
    """Only an unambiguous resolution names a forecast entity."""
    return f"if(size({resolved}) = 1, {resolved}[0], null)"


def resolve_entities(notes: DataFrame, master: DataFrame, key: str = "source_id", carry: Iterable[str] = ()) -> DataFrame:
    """``(key, resolved_entities, forecast_key, *carry)`` against a master table of any size.

    Only keys and mentions are shuffled, never the text: once to meet the master on the
    mention, once back to the note.  ``carry`` names columns of the master that come along
    with the forecast key; the master has one row per entity then.
    """
    carry = list(carry)
    mentions = notes.selectExpr(key, "posexplode(array_distinct(entity_mentions_raw)) as (pos, entity_key)")
    known = mentions.join(master.select("entity_key", *carry).distinct(), "entity_key")
    hit = ", ".join(("pos", "entity_key", *carry))
    return known.groupBy(key).agg(F.expr(f"array_sort(collect_list(struct({hit}))) as hits")).selectExpr(
        key, "hits", "transform(hits, x -> x.entity_key) as resolved_entities",
    ).selectExpr(
        key, "resolved_entities", f"{_forecast_key('resolved_entities')} as forecast_key",
        *(f"if(size(hits) = 1, hits[0].{c}, null) as {c}" for c in carry))


def _with_resolution(rows: DataFrame, notes: DataFrame, known_entities) -> DataFrame:
    if known_entities is None:
        return rows.withColumn(
            "resolved_entities", F.expr("coalesce(resolved_entities, cast(array() as array<string>))"))
    if isinstance(known_entities, DataFrame):
        resolved = resolve_entities(notes, known_entities)
        return rows.join(resolved, "source_id", "left").withColumn(
            "resolved_entities", F.expr("coalesce(resolved_entities, cast(array() as array<string>))"))
    known = F.from_json(F.lit(json.dumps(sorted(set(known_entities)))), "array<string>")
    rows = rows.withColumn("resolved_entities", F.array_intersect(F.array_distinct("entity_mentions_raw"), known))
    return rows.withColumn("forecast_key", F.expr(_forecast_key("resolved_entities")))


def extract_signals(
    notes: DataFrame,
    known_entities: DataFrame | Iterable[str] | None,
    *,
    extraction_run_id: str,
    extracted_at: str | None = None,
    extractor_version: str = V.EXTRACTOR_VERSION,
    extraction_config_version: str = V.EXTRACTION_CONFIG_VERSION,
    keep: Iterable[str] = (),
) -> DataFrame:
    """One signal row per note in the ledger layout, abstaining where evidence is missing.

    With a Python collection of entities this is a single projection (it also runs on a
    stream); with a master table it adds the join of :func:`resolve_entities`, which shuffles
    the signals to their entities.  With None the notes carry the columns of that function, and
    nothing is shuffled.  ``keep`` carries further note columns along.
    """
    keep = [c for c in dict.fromkeys(keep) if c not in SIGNAL.names]
    resolved = ["resolved_entities", "forecast_key"] if known_entities is None else []
    evidence = list(dict.fromkeys([
        "source_id", "source_revision", "source_type", "source_record_id", "entity_mentions_raw", *keep]))
    found = _with_resolution(detect_cues(notes, [*evidence, *resolved]), notes, known_entities)
    reasons = ", ".join(f"if({when}, '{text}', null)" for when, text in (
        ("conflict", V.REASON_CONFLICT),
        ("no_cues", V.REASON_NO_CUES),
        ("direction is null and not no_cues", V.REASON_NO_DIRECTION),
        ("signal_type is null and not no_cues", V.REASON_NO_SUBJECT),
        ("forecast_key is null and not no_cues", V.REASON_ENTITY),
        ("is_reversal", V.REASON_REVERSAL),
    ))
    kind = "case when no_cues then 'NO_SIGNAL' when signal_type is null then 'OTHER_RELEVANT' else signal_type end"
    heading = "case when no_cues then 'NA' when direction is null then 'UNKNOWN' else direction end"
    unless_empty = lambda c: f"if(no_cues, null, {c})"
    review = ("conflict or is_reversal or not no_cues "
              "and (direction is null or signal_type is null or forecast_key is null)")
    clock = f"timestamp '{extracted_at}'" if extracted_at else "current_timestamp()"
    text = lambda value: "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    physical = ["source_id", "source_revision", text(extractor_version), text(extraction_config_version),
                text(extraction_run_id)]
    channel = ("case when signal_type = 'SUPPLY_FULFILLMENT' then 'FULFILLMENT' "
               "when signal_type in ('OTHER_RELEVANT', 'NO_SIGNAL') then 'UNKNOWN' else 'DEMAND' end")
    rows = found.selectExpr("*", "direction is null and signal_type is null as no_cues").selectExpr(
        *evidence, *(c for c in ("negated", "is_reversal", "time_expression_raw", "effective_start", "effective_end",
                                 "time_granularity", "resolved_entities", "forecast_key", "text_length")),
        f"{kind} as signal_type", f"{heading} as direction",
        "if(no_cues, 'UNKNOWN', business_certainty) as business_certainty",
        "if(no_cues, 'NONE', conditionality) as conditionality",
        *(f"{unless_empty(c)} as {c}" for c in (
            "condition_text", "magnitude_value", "magnitude_unit", "magnitude_basis")),
        f"if({review}, 'REVIEW', 'PASS') as validation_status",
        f"nullif(concat_ws('{V.REASON_SEPARATOR}', {reasons}), '') as abstention_reason",
    )
    computed = {
        "signal_id": ids.signal_id(physical),
        "logical_signal_id": ids.signal_id(["source_type", "source_record_id"]),
        "schema_version": text(V.SCHEMA_VERSION),
        "signal_subtype": "lower(direction)",
        "impact_channel": channel,
        "magnitude_low": "cast(null as double)", "magnitude_high": "cast(null as double)",
        "entity_mentions": "entity_mentions_raw",
        "evidence_ref": "named_struct('source_id', source_id, 'char_start', 0L, 'char_end', cast(text_length as bigint))",
        "extractor_version": text(extractor_version),
        "extraction_config_version": text(extraction_config_version),
        "extraction_run_id": text(extraction_run_id),
        "extracted_at": clock,
        "extraction_confidence": "cast(null as double)",
        "record_status": "'ACTIVE'",
        "supersedes_signal_id": "cast(null as string)",
        "related_signal_ids": "cast(array() as array<string>)",
    }
    return rows.selectExpr(
        *(f"{computed[n]} as {n}" if n in computed else n for n in SIGNAL.names), "is_reversal", *keep)
