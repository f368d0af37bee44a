"""Cases that once gave wrong answers."""

import json
import sys

import pytest

from helpers import note, note_rows, signal, utc
from pitsignal.operators import integrity, monitor
from pitsignal.operators.forecast import ForecastConfig, run_arms
from pitsignal.plans.extraction_run import run_extraction
from pitsignal.sources.readers import read_notes, rejected_notes
from pitsignal.sources.schemas import EVIDENCE, SIGNAL
from pitsignal.sources.sinks import JSON_TIMES, append_actions, content_fingerprint


def records(spark, *rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in SIGNAL) for r in rows], SIGNAL)


def test_content_that_differs_by_microseconds_is_a_conflict(spark):
    one = signal("a", "n1")
    later = one | {"extracted_at": utc("2026-02-02T00:00:00.000543")}
    stored, batch = records(spark, one), records(spark, later)
    assert [r["action"] for r in append_actions(batch, stored).collect()] == ["conflict"]
    assert [r["action"] for r in append_actions(stored, stored).collect()] == ["skip"]
    assert content_fingerprint(stored) != content_fingerprint(batch)


def test_json_keeps_microseconds(spark, tmp_path):
    notes = note_rows(spark, [note("n1", "text", "2026-01-05T09:00:00.123456", "2026-01-05T10:00:00.654321")])
    notes.write.options(**JSON_TIMES).json(str(tmp_path / "notes"))
    back = spark.read.schema(EVIDENCE).json(str(tmp_path / "notes"))
    assert back.exceptAll(notes).count() == 0


def test_no_reversal_is_linked_to_a_quarantined_claim(spark):
    notes = note_rows(spark, [
        note("plan", "Customer expects to increase orders by roughly " + "9" * 400 + "% next month.", "2026-01-05T09:00:00"),
        note("undo", "Previous expansion plan has been cancelled.", "2026-01-07T09:00:00")])
    run = run_extraction(notes, ["CUST-0001"], extraction_run_id="r", extracted_at="2026-02-01 00:00:00")
    assert {r["source_id"] for r in run.quarantined.collect()} == {"plan"}
    assert [(r["source_id"], r["supersedes_signal_id"]) for r in run.accepted.collect()] == [("undo", None)]


def test_contracts_are_checked_once_per_record_not_once_per_reader(spark):
    notes = note_rows(spark, [
        note("plan", "Customer expects to increase orders by roughly 9% next month.", "2026-01-05T09:00:00"),
        note("undo", "Previous expansion plan has been cancelled.", "2026-01-07T09:00:00")])
    run = run_extraction(notes, ["CUST-0001"], extraction_run_id="r", extracted_at="2026-02-01 00:00:00")
    plan = run.classified._jdf.queryExecution().optimizedPlan().toString()
    # Two mentions per check (stage and error) of the linked reversals; all else was checked when it was written.
    assert plan.count("missing: logical_signal_id") <= 2
    assert {r["source_id"]: bool(r["supersedes_signal_id"]) for r in run.accepted.collect()} == {"plan": False, "undo": True}


def test_broken_note_lines_are_rejected_with_their_text(spark, tmp_path):
    good = dict(source_id="n1", source_type="account_note", source_record_id="n1", source_revision="r1", authored_at="2026-01-05T09:00:00",
                available_at="2026-01-05T09:10:00", raw_text="x", content_hash="sha256:x", entity_mentions_raw=[], schema_version="0.1.0")
    lines = [json.dumps(good), "{broken", "", json.dumps(good | {"source_id": None})]
    (tmp_path / "notes.json").write_text("\n".join(lines))
    assert [r["source_id"] for r in read_notes(spark, str(tmp_path)).collect()] == ["n1"]
    assert {r["raw_record"][:7] for r in rejected_notes(spark, str(tmp_path)).collect()} == {"{broken", '{"sourc'}


def test_a_ridge_without_penalty_uses_the_columns_of_its_arm(spark):
    config = ForecastConfig(train_weeks=40, horizon_weeks=2, min_origins=5, ridge_alpha=0.0)
    demand = spark.range(80).selectExpr(
        "'E' as entity_key", "date_add(date'2024-01-01', cast(7 * id as int)) as period_start", "cast(id as int) as week_index",
        "100 + 10 * sin(id * 0.7) + pmod(hash(id), 17) as demand")
    got = run_arms(demand, {"A": None}, config, columns={"A": config.tabular_columns}).toPandas()
    assert len(got) and got["predicted"].notna().all()


def test_alerts_need_neighbouring_windows(spark):
    checks = spark.createDataFrame([("f", p, True, 1.0) for p in (1, 2, 4)], "feature string, part int, significant boolean, effect double")
    assert {r["part"]: r["alert"] for r in monitor.alerts(checks, min_effect=0.5).collect()} == {1: False, 2: True, 4: False}


@pytest.mark.parametrize("text", ["Straße ẞ", "ﬁn ﬄ", "ΟΔΟΣ", "ſo µ", "a  B\tc"])
def test_texts_are_case_folded(spark, text):
    got = spark.createDataFrame([(text,)], "t string").selectExpr(f"{integrity.normalized_text('t')} as n").first()["n"]
    assert got == " ".join(text.casefold().split())


def test_case_folding_of_every_code_point(spark):
    letters = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(letters[at:at + 1000]) for at in range(0, len(letters), 1000)] + [c for c in letters if len(c.casefold()) > 1] + ["ΑΣ ΟΔΟΣ"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", f"{integrity.case_folded('t')} as f").collect()
    assert all(r["f"] == r["t"].casefold() for r in got) and len(got) == len(texts)


def test_linking_stages_only_the_columns_it_reads(spark, monkeypatch):
    from pitsignal.operators.reconcile import LINK_COLUMNS
    from pitsignal.plans import queries_ledger

    staged, stage = [], queries_ledger.stage
    monkeypatch.setattr(queries_ledger, "stage", lambda df: staged.append(df.columns) or stage(df))
    sf = "/root/testdata/sf0.001"
    got = sorted(queries_ledger.reversal_candidates(spark, sf).collect())
    assert staged == [["extraction_run_id", *LINK_COLUMNS]]
    whole = queries_ledger.reversal_states(queries_ledger.stored_signals(spark, sf))
    assert got and got == sorted(whole.selectExpr("source_id", "forecast_key", "n as candidates").collect())
