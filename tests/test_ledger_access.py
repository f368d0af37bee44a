import pytest

from helpers import LEDGER, ledger_frame, note, note_rows, pair_frame, signal, utc
from pitsignal.operators.access import FeatureStore, build_feature_table, contract_failures, load_feature_store
from pitsignal.operators.contracts import classify, conformance, violations
from pitsignal.operators.features import build_features
from pitsignal.operators.ledger import ledger_as_of
from pitsignal.operators.oracle import build_oracle_features
from pitsignal.operators.shuffle import shuffle_features
from pitsignal.plans.extraction_run import run_and_persist, run_extraction
from pitsignal.sources.readers import check_raw_notes, read_ledger
from pitsignal.sources.schemas import GROUND_TRUTH, SIGNAL
from pitsignal.sources.sinks import ConflictingContent, append_to_ledger, write_dataset

CUTOFF = "2026-02-03 00:00:00"


def ledger(spark, *rows):
    return ledger_frame(spark, rows).select(*SIGNAL.names)


def test_append_is_idempotent_and_refuses_conflicts(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert read_ledger(spark, path).count() == 0
    one, two = signal("a", "n1"), signal("b", "n2")
    assert append_to_ledger(ledger(spark, one, two, one), path) == 2
    assert append_to_ledger(ledger(spark, two, one), path) == 0
    assert append_to_ledger(ledger(spark, two, signal("c", "n3")), path) == 1
    stored = sorted(read_ledger(spark, path).collect())
    changed = signal("a", "n1", extractor_version="changed")
    for bad in ([changed], [signal("d", "n4"), signal("d", "n4", direction="DECREASE")],
                [signal("a", "n1", extraction_run_id="run-2")]):
        with pytest.raises(ConflictingContent):
            append_to_ledger(ledger(spark, *bad), path)
    with pytest.raises(ValueError, match="without a signal"):
        append_to_ledger(ledger(spark, signal("e", "n5"), signal("f", "n6", signal_type="NO_SIGNAL")), path)
    assert sorted(read_ledger(spark, path).collect()) == stored
    assert append_to_ledger(ledger(spark, signal("a2", "n1", extraction_run_id="run-2")), path) == 1
    assert read_ledger(spark, path, "run-2").count() == 1 and read_ledger(spark, path).count() == 4


def test_splitting_a_batch_gives_the_same_ledger(spark, tmp_path):
    rows = [signal(f"s{i}", f"n{i}") for i in range(6)]
    append_to_ledger(ledger(spark, *rows), str(tmp_path / "one"))
    append_to_ledger(ledger(spark, *rows[:4]), str(tmp_path / "two"))
    append_to_ledger(ledger(spark, *rows[3:]), str(tmp_path / "two"))
    assert sorted(read_ledger(spark, str(tmp_path / "one")).collect()) == sorted(
        read_ledger(spark, str(tmp_path / "two")).collect())


def test_ledger_as_of_needs_lineage_and_selects_one_run(spark):
    sources = note_rows(spark, [note("n1", "x", "2026-01-01T09:00:00"), note("n2", "x", "2026-01-07T09:00:00")])
    rows = ledger(spark, signal("a", "n1"), signal("b", "n2", supersedes_signal_id="a"),
                  signal("z", "n1", extraction_run_id="run-2"))
    view = lambda at: {r["signal_id"]: r["record_status"] for r in ledger_as_of(
        rows, sources, at, extraction_run_id="run-1").collect()}
    assert view("2026-01-07 09:09:59") == {"a": "ACTIVE"}
    assert view("2026-01-07 09:10:00") == {"a": "SUPERSEDED", "b": "ACTIVE"}
    with pytest.raises(Exception, match="without source evidence"):
        ledger_as_of(ledger(spark, signal("a", "gone")), sources, CUTOFF, extraction_run_id="run-1").collect()
    with pytest.raises(Exception, match="revision does not match"):
        ledger_as_of(ledger(spark, signal("a", "n1", source_revision="r9")), sources, CUTOFF, extraction_run_id="run-1").collect()


def test_contract_violations(spark):
    bad = {
        "unit": dict(magnitude_value=5.0, magnitude_unit=None), "nan": dict(magnitude_value=float("nan")),
        "inf": dict(magnitude_low=float("-inf"), magnitude_unit="u"), "enum": dict(direction="SIDEWAYS"),
        "span": dict(evidence_ref=("span", 10, 2)), "ref": dict(evidence_ref=("other", 0, 1)),
        "period": dict(effective_start="2026-03-01T00:00:00", effective_end="2026-02-01T00:00:00"),
        "self": dict(supersedes_signal_id="self"), "none": dict(source_revision=None), "conf": dict(extraction_confidence=1.5),
        "range": dict(magnitude_low=3.0, magnitude_high=1.0, magnitude_unit="u"),
    }
    rows = [signal(k, k, **v) for k, v in bad.items()] + [signal("good", "good")]
    frame = ledger(spark, *rows)
    found = {r["signal_id"]: (r["stage"], r["error"]) for r in violations(frame, "signal_record", "signal_id").collect()}
    assert set(found) == set(bad)
    assert found["unit"] == ("construct", "magnitude without unit")
    assert found["enum"] == ("contract", "not in its value list: direction")
    assert found["none"] == ("contract", "missing: source_revision")
    rate = conformance(classify(frame, "signal_record")).first()
    assert (rate["accepted"], rate["quarantined"]) == (1, len(bad))
    assert conformance(classify(frame.limit(0), "signal_record")).first()["schema_conformance_rate"] == 1.0
    with pytest.raises(KeyError):
        classify(frame, "unknown")


def test_raw_notes_keep_every_line_with_its_errors(spark):
    ok = ('{"source_id":"a","source_type":"account_note","source_record_id":"a","source_revision":"r1",'
          '"authored_at":"2026-01-05T09:00:00","available_at":"2026-01-05T10:00:00Z","raw_text":"x",'
          '"content_hash":"h","entity_mentions_raw":["E"],"schema_version":"0.1.0"}')
    lines = [ok, "", ok.replace('"content_hash":"h",', ""), ok.replace('"raw_text"', '"not_a_field":1,"raw_text"'),
             ok.replace("2026-01-05T09:00:00", "not-a-time"), ok.replace("T09:00:00", "T23:00:00"), "not json",
             ok.replace("account_note", "memo")]
    got = [r["errors"] for r in check_raw_notes(spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1)).collect()]
    assert got == [[], ["missing: content_hash"], ["unknown field not_a_field"],
                   ["missing: authored_at"], ["range reversed: authored_at, available_at"],
                   ["not a JSON record"], ["not in its value list: source_type"]]


def test_run_and_persist_quarantines_invalid_evidence(spark, tmp_path):
    notes = note_rows(spark, [note("ok", "Customer expects to increase orders."),
                              note("bad", "Customer expects to increase orders.", "2026-01-05T09:00:00", "2026-01-04T09:00:00")])
    run, written = run_and_persist(
        notes, ["CUST-0001"], str(tmp_path / "ledger"), str(tmp_path / "rejected"), extraction_run_id="r",
        extracted_at="2026-02-01 00:00:00")
    assert written == 1
    row = spark.read.parquet(str(tmp_path / "rejected")).first()
    assert (row["source_id"], row["stage"], row["extraction_run_id"]) == ("bad", "construct", "r")
    assert row["source_evidence"]["raw_text"].startswith("Customer") and "available_at" in row["error"]
    rate = run.conformance().first()
    assert (rate["accepted"], rate["quarantined"], rate["schema_conformance_rate"]) == (1, 1, 0.5)


def test_dataset_sink_writes_nothing_when_a_note_is_invalid(spark, tmp_path):
    notes = note_rows(spark, [note("bad", "x", "2026-01-05T09:00:00", "2026-01-04T09:00:00")])
    empty = spark.createDataFrame([], GROUND_TRUTH)
    with pytest.raises(ValueError, match="available_at"):
        write_dataset(spark.range(1), notes, empty, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_feature_access(spark):
    sources = note_rows(spark, [note("n1", "secret text", "2026-02-01T09:00:00"), note("n2", "x", "2026-02-05T09:00:00")])
    store = FeatureStore.of(ledger(
        spark, signal("a", "n1"), signal("late", "n2"), signal("b", "n1", forecast_key="CUST-0002"),
        signal("lost", "nowhere")), sources, feature_definition_version="fdv-x")
    got = {r["entity_key"]: r for r in store.get_features(["CUST-0001", "CUST-0002", "CUST-9"], CUTOFF, lineage="array").collect()}
    assert got["CUST-0001"]["contributing_signal_ids"] == ["a"]
    assert got["CUST-9"]["has_active_signal_30d"] is False and got["CUST-9"]["contributing_signal_ids"] == []
    assert got["CUST-9"]["feature_definition_version"] == "fdv-x" and got["CUST-9"]["feature_available_at"] is not None
    assert "raw_text" not in got["CUST-9"].asDict()
    pairs = pair_frame(spark, [("CUST-0001", "2026-02-03T00:00:00")] * 2 + [("CUST-0002", "2026-01-03T00:00:00")])
    history = store.get_historical_features(pairs, "fdv-test")
    assert [r["signal_count_30d"] for r in history.orderBy("entity_key").collect()] == [1, 1, 0]
    assert {r[0] for r in history.select("feature_definition_version").collect()} == {"fdv-test"}
    assert store.get_historical_features(pairs.limit(0)).count() == 0
    assert contract_failures(history).first()["schema_failures"] == 0


def test_store_loads_one_run_and_builds_the_table(spark, tmp_path):
    note_rows(spark, [note("n1", "x", "2026-02-01T09:00:00")]).write.json(str(tmp_path / "notes"))
    append_to_ledger(ledger(spark, signal("a", "n1"), signal("z", "n1", extraction_run_id="run-2")), str(tmp_path / "ledger"))
    store = load_feature_store(spark, str(tmp_path / "ledger"), str(tmp_path / "notes"), extraction_run_id="run-1")
    demand = spark.sql("select 'CUST-0001' as entity_key, date '2026-01-26' + interval 7 day * id as period_start, "
                       "cast(id as int) as week_index, 1.0D as demand from range(4)")
    entities = spark.createDataFrame([("CUST-0001",), ("CUST-0002",)], "entity_key string")
    table, metrics = build_feature_table(store, demand, entities, str(tmp_path / "features"))
    assert table.count() == 8 and metrics.first().asDict() == {"feature_rows": 8, "schema_failures": 0}
    assert table.where("signal_count_30d = 1").count() == 3


def test_oracle_features_use_first_mention_and_stated_periods(spark):
    notes = note_rows(spark, [note("n1", "x", "2026-02-01T09:00:00", mentions=("CUST-0001", "CUST-0002")),
                              note("n2", "x", "2026-02-01T09:00:00"), note("n3", "x", "2026-02-01T09:00:00")])
    row = lambda sid, **o: tuple({**dict(
        source_id=sid, signal_type="DEMAND_EXPECTATION", direction="INCREASE", negated=False, is_irrelevant=False,
        is_reversal=False), **o}.get(f.name) for f in GROUND_TRUTH)
    truth = spark.createDataFrame([
        row("n1", stated_magnitude_value=10.0, stated_magnitude_unit=None),
        row("n2", direction="DECREASE", stated_magnitude_value=5.0, stated_magnitude_unit="%",
            effective_end=utc("2020-01-01T00:00:00")),  # one end only: not restricted
        row("n3", is_irrelevant=True)], GROUND_TRUTH)
    got = {r["entity_key"]: r for r in build_oracle_features(truth, notes, pair_frame(
        spark, [("CUST-0001", "2026-02-03T00:00:00"), ("CUST-0002", "2026-02-03T00:00:00")])).collect()}
    one = got["CUST-0001"]
    assert (one["signal_count_30d"], one["expected_qty_delta_next_horizon"], one["net_demand_direction_30d"],
            one["active_conflict_count"], one["delay_count_90d"]) == (2, 10.0, "MIXED", 1, 0)
    assert got["CUST-0002"]["signal_count_30d"] == 0


def test_shuffle_permutes_entities_within_each_cutoff(spark):
    rows = [signal(f"s{i}", f"n{i}", "2026-02-01T00:00:00", forecast_key=f"E{i % 12}") for i in range(60)]
    pairs = pair_frame(spark, [(f"E{e}", f"2026-02-0{d}T00:00:00") for e in range(12) for d in (2, 3, 4)])
    features = build_features(ledger_frame(spark, rows, LEDGER), pairs, generated_at="2027-01-01 00:00:00", lineage="array")
    features = features.withColumnRenamed("contributing_signal_count", "tag").withColumn("tag", features.entity_key)
    shuffle = lambda seed: sorted(tuple(r) for r in shuffle_features(features, seed=seed).select(
        "forecast_cutoff", "entity_key", "tag", "contributing_signal_ids").collect())
    one = shuffle(42)
    assert one == shuffle(42) and one != shuffle(99)
    assert len(one) == 36 and all(ids == [] for *_, ids in one)
    for cutoff in {r[0] for r in one}:
        mine = [r for r in one if r[0] == cutoff]
        assert {r[1] for r in mine} == {r[2] for r in mine} == {f"E{e}" for e in range(12)}
    assert any(r[1] != r[2] for r in one)
    assert shuffle_features(features.limit(0)).count() == 0


def test_every_note_is_accepted_or_quarantined(spark):
    texts = ["Customer expects to increase orders.", "hello", "The order has been cancelled."]
    notes = note_rows(spark, [note(f"n{i}", texts[i % 3]) for i in range(9)])
    run = run_extraction(notes, ["CUST-0001"], extraction_run_id="r")
    assert run.accepted.count() + run.quarantined.count() == 9


def test_experiments_store_only_what_features_read_of_a_signal(spark):
    from pitsignal.plans.queries_ledger import CLAIM_COLUMNS, nation_signals

    assert set(nation_signals(spark, "/root/testdata/sf0.001").columns) == set(CLAIM_COLUMNS)
