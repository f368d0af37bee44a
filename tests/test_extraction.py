import json
import uuid

import pytest

from helpers import note, note_rows, utc
from pitsignal.functions import ids
from pitsignal.operators.extract import detect_cues, extract_signals, resolve_entities
from pitsignal.plans.extraction_run import run_extraction
from pitsignal.sources.schemas import EVIDENCE, SIGNAL

KNOWN = ["CUST-0001", "CUST-0002"]

# text -> expected cues
CUES = [
    ("Customer is not increasing the order.", dict(direction="STABLE", negated=True, signal_type="ORDER_LIFECYCLE")),
    ("Customer may increase volume if the promotion is approved.", dict(
        direction="INCREASE", negated=False, business_certainty="POSSIBLE", conditionality="CONDITIONAL",
        condition_text="if the promotion is approved", signal_type="DEMAND_EXPECTATION")),
    ("Previous expansion plan has been cancelled.", dict(direction="STABLE", negated=True, is_reversal=True, signal_type=None)),
    ("The order has been Canceled.", dict(direction=None, negated=False, is_reversal=True)),
    ("Customer indicated they might need additional inventory.", dict(
        direction="INCREASE", business_certainty="POSSIBLE", signal_type="INVENTORY_POSITION")),
    ("Customer will increase volume but decrease headcount.", dict(direction="MIXED", conflict=True)),
    ("Updated contact email on file.", dict(direction=None, negated=False, conflict=False, signal_type=None)),
    ("Customer confirmed they will increase orders by roughly 15%.", dict(
        magnitude_value=15.0, magnitude_unit="%", magnitude_basis="PERCENT", business_certainty="ASSERTED")),
    ("Roughly  7.25 % more", dict(magnitude_value=7.25)),
    ("Customer confirmed they will increase orders.", dict(magnitude_value=None, conditionality="NONE", condition_text=None)),
    ("Customer expects to decrease orders.", dict(business_certainty="EXPECTED", direction="DECREASE")),
    ("Customer will likely increase orders.", dict(business_certainty="LIKELY")),
    ("Customer mentioned they may possibly increase orders.", dict(business_certainty="UNKNOWN")),
    ("William discussed orders.", dict(business_certainty="UNKNOWN", signal_type="DEMAND_EXPECTATION")),
    ("Keep the order quantity steady", dict(direction="STABLE", negated=False, signal_type="QUANTITY_REVISION")),
    ("Keep it\nsteady", dict(direction=None)),
    ("no increase expected", dict(direction=None)),
    ("Unless prices rise.", dict(condition_text="Unless prices rise")),
    ("cafémay grow", dict(business_certainty="UNKNOWN")),
]
CALENDAR = [
    ("2024-01-31T23:00:00", "next month", "2024-02-01", "2024-03-01", "month"),
    ("2024-12-31T00:00:00", "next month", "2025-01-01", "2025-02-01", "month"),
    ("2024-12-31T00:00:00", "next quarter", "2025-01-01", "2025-04-01", "quarter"),
    ("2024-03-01T00:00:00", "next quarter", "2024-04-01", "2024-07-01", "quarter"),
    ("2024-02-29T00:00:00", "next year", "2025-01-01", "2026-01-01", "year"),
    ("2024-02-29T05:00:00", "later this year", "2024-02-29T05:00:00", "2025-01-01", "unknown"),
    ("2024-02-29T05:00:00", "in the next couple of weeks", "2024-02-29T05:00:00", "2024-03-14T05:00:00", "week"),
]


def test_cues_of_literal_sentences(spark):
    notes = note_rows(spark, [note(str(i), text) for i, (text, _) in enumerate(CUES)])
    got = {int(r["source_id"]): r for r in detect_cues(notes, ["source_id"]).collect()}
    for i, (text, want) in enumerate(CUES):
        assert {k: got[i][k] for k in want} == want, text


def test_calendar_windows(spark):
    notes = note_rows(spark, [note(str(i), p, a, a) for i, (a, p, *_) in enumerate(CALENDAR)])
    got = {int(r["source_id"]): r for r in detect_cues(notes, ["source_id"]).selectExpr(
        "source_id", "time_granularity", "date_format(effective_start, \"yyyy-MM-dd'T'HH:mm:ss\") as s",
        "date_format(effective_end, \"yyyy-MM-dd'T'HH:mm:ss\") as e").collect()}
    for i, (_, phrase, start, end, grain) in enumerate(CALENDAR):
        pad = lambda d: d if "T" in d else d + "T00:00:00"
        assert (got[i]["s"], got[i]["e"], got[i]["time_granularity"]) == (pad(start), pad(end), grain), phrase


def test_signals_and_abstention(spark):
    notes = note_rows(spark, [
        note("neg", "Customer is not increasing the order."),
        note("none", "Updated contact email on file next month."),
        note("nodir", "Talked about inventory."),
        note("nosub", "They will increase it."),
        note("who", "Customer expects to increase orders.", mentions=("missing",)),
        note("two", "Customer expects to increase orders.", mentions=("CUST-0001", "CUST-0002", "CUST-0001")),
        note("rev", "Previous expansion plan has been cancelled."),
    ])
    rows = {r["source_id"]: r for r in extract_signals(notes, KNOWN, extraction_run_id="r").collect()}
    status = {k: (r["signal_type"], r["direction"], r["validation_status"], r["abstention_reason"]) for k, r in rows.items()}
    assert status["neg"] == ("ORDER_LIFECYCLE", "STABLE", "PASS", None)
    assert status["none"] == ("NO_SIGNAL", "NA", "PASS", "no direction or subject-matter cues found in text")
    assert rows["none"]["time_expression_raw"] == "next month"  # kept although the note abstains
    assert status["nodir"][1:] == ("UNKNOWN", "REVIEW", "subject matter detected but no clear direction cue")
    assert status["nosub"] == ("OTHER_RELEVANT", "INCREASE", "REVIEW", "direction detected but signal type/subject unclear")
    assert rows["who"]["forecast_key"] is None and rows["who"]["validation_status"] == "REVIEW"
    assert rows["two"]["resolved_entities"] == KNOWN and rows["two"]["forecast_key"] is None
    assert status["rev"][3] == ("direction detected but signal type/subject unclear; "
                                "reversal requires an unambiguous prior signal")
    want = uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(["neg", "r1", "rules-v0.2.0", "cfg-v0.2.0", "r"])).hex
    assert rows["neg"]["signal_id"] == "sig-" + want
    assert rows["neg"]["evidence_ref"] == ("neg", 0, 37)
    assert rows["neg"]["signal_subtype"] == "stable"


def test_entity_resolution_against_a_master_table(spark):
    notes = note_rows(spark, [
        note("a", "x", mentions=("CUST-0002", "CUST-0001", "CUST-0002")), note("b", "x", mentions=("CUST-0001", "nobody")),
        note("c", "x", mentions=("nobody",)), note("d", "x", mentions=())])
    master = spark.createDataFrame([(k,) for k in KNOWN], "entity_key string")
    got = {r[0]: (r[1], r[2]) for r in resolve_entities(notes, master).collect()}
    assert got == {"a": (["CUST-0002", "CUST-0001"], None), "b": (["CUST-0001"], "CUST-0001")}
    inline = extract_signals(notes, KNOWN, extraction_run_id="r").select("source_id", "resolved_entities", "forecast_key")
    joined = extract_signals(notes, master, extraction_run_id="r").select("source_id", "resolved_entities", "forecast_key")
    assert sorted(inline.collect()) == sorted(joined.collect())


def test_identifiers_equal_python_uuid5(spark):
    names = ["plain", 'qu"ote', "back\\slash", "é", "😀x", "tab\t\n\x01", "", "\x7f", "a/b"]
    rows = spark.createDataFrame([(n, "b") for n in names], "a string, b string").selectExpr(
        "a", f"{ids.json_list(['a', 'b'])} as j", f"{ids.signal_id(['a', 'b'])} as u").collect()
    for r in rows:
        text = json.dumps([r["a"], "b"])
        assert r["j"] == text
        assert r["u"] == "sig-" + uuid.uuid5(uuid.NAMESPACE_URL, text).hex


def test_run_links_only_known_claims_and_is_repeatable(spark):
    first = note("original", "Customer expects to increase orders next month.")
    cancel = note("cancel", "Previous expansion plan has been cancelled.", "2026-01-07T09:00:00", "2026-01-07T10:00:00")
    late = note("original", first[1], available="2026-01-07T09:30:00")
    other = note("other", "Customer expects to increase purchase volume next month.")

    def links(*notes):
        run = run_extraction(note_rows(spark, notes), KNOWN, extraction_run_id="r", extracted_at="2026-02-01 00:00:00")
        rows = {r["source_id"]: r for r in run.accepted.collect()}
        return rows, rows["cancel"]

    rows, linked = links(cancel, first)
    assert linked["supersedes_signal_id"] == rows["original"]["signal_id"]
    assert linked["validation_status"] == "PASS" and linked["abstention_reason"] is None
    assert linked["signal_type"] == "DEMAND_EXPECTATION" and linked["signal_subtype"] == "cancelled"
    assert links(first, cancel)[0] == rows
    assert links(late, cancel)[1]["supersedes_signal_id"] is None
    assert links(first, other, cancel)[1]["validation_status"] == "REVIEW"
    with pytest.raises(ValueError, match="repeats source_id"):
        run_extraction(note_rows(spark, [first, first]), KNOWN, extraction_run_id="r")
