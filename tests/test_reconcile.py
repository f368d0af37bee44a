"""Reversal linking against a direct, quadratic reading of the rule."""

import random
from datetime import datetime, timedelta

import pytest

from pitsignal.operators.reconcile import reconcile
from pitsignal.sources.schemas import SIGNAL
from pyspark.sql import types as T

BASE = datetime(2026, 1, 1)
ROW = T.StructType([
    *(SIGNAL[n] for n in (
        "signal_id", "source_id", "signal_type", "signal_subtype", "impact_channel", "negated", "effective_end",
        "forecast_key", "extraction_run_id", "validation_status", "abstention_reason", "record_status",
        "supersedes_signal_id", "related_signal_ids")),
    T.StructField("is_reversal", T.BooleanType()),
    T.StructField("authored_at", T.TimestampType()),
    T.StructField("available_at", T.TimestampType()),
])
REVERSAL = "reversal requires an unambiguous prior signal"
SUBJECT = "direction detected but signal type/subject unclear"
TYPES = ["ORDER_LIFECYCLE", "DEMAND_EXPECTATION", "SUPPLY_FULFILLMENT"]


def expected_links(rows):
    """Walk the notes in knowledge order and look at every earlier note."""
    by_order = sorted((dict(r) for r in rows), key=lambda r: (r["available_at"], r["source_id"]))
    done, links = [], {}
    for r in by_order:
        reasons = set((r["abstention_reason"] or "").split("; "))
        if r["is_reversal"] and r["forecast_key"] and not reasons - {REVERSAL, SUBJECT}:
            known = [p for p in done if p["available_at"] <= r["authored_at"]]
            gone = {p["supersedes_signal_id"] for p in known if p["validation_status"] == "PASS"}
            found = [p for p in known if p["signal_id"] not in gone and p["validation_status"] == "PASS"
                     and not p["negated"] and p["signal_type"] != "NO_SIGNAL"
                     and p["forecast_key"] == r["forecast_key"]
                     and r["signal_type"] in ("OTHER_RELEVANT", p["signal_type"])
                     and (p["effective_end"] is None or p["effective_end"] > r["authored_at"])]
            if len(found) == 1:
                r.update(signal_type=found[0]["signal_type"], supersedes_signal_id=found[0]["signal_id"],
                         validation_status="PASS")
                links[r["signal_id"]] = (found[0]["signal_id"], found[0]["signal_type"])
        done.append(r)
    return links


def make_rows(seed, n, entities, reversal_share):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        authored = BASE + timedelta(hours=rng.randrange(40 + n))
        reversal = rng.random() < reversal_share
        unclear = reversal and rng.random() < 0.5
        rows.append(dict(
            signal_id=f"s{i}", source_id=f"n{rng.randrange(10**6):06d}-{i}",
            signal_type="OTHER_RELEVANT" if unclear else rng.choice([*TYPES, "NO_SIGNAL"] if not reversal else TYPES),
            signal_subtype="x", impact_channel="DEMAND", negated=rng.random() < (0.5 if reversal else 0.1),
            effective_end=None if rng.random() < 0.3 else authored + timedelta(hours=rng.randrange(-2, 30)),
            forecast_key=f"e{rng.randrange(entities)}" if rng.random() < 0.95 else None, extraction_run_id="r",
            validation_status="REVIEW" if reversal or rng.random() < 0.1 else "PASS",
            abstention_reason=("; ".join([SUBJECT] * unclear + [REVERSAL]) if rng.random() < 0.9 else
                               "entity is ambiguous or unresolved; " + REVERSAL) if reversal else None,
            record_status="ACTIVE", supersedes_signal_id=None, related_signal_ids=[],
            is_reversal=reversal, authored_at=authored,
            available_at=authored + timedelta(hours=rng.choice([0, 0, 1, 3, 9]))))
    return rows


@pytest.mark.parametrize("seed,n,entities,share", [
    (1, 300, 40, 0.5), (2, 300, 12, 0.3), (3, 120, 60, 0.6), (4, 400, 1, 0.5), (5, 60, 3, 0.9)])
def test_links_equal_the_direct_reading(spark, seed, n, entities, share):
    rows = make_rows(seed, n, entities, share)
    df = spark.createDataFrame([tuple(r[f.name] for f in ROW) for r in rows], ROW)
    got = {r.signal_id: (r.supersedes_signal_id, r.signal_type) for r in
           reconcile(df).where("supersedes_signal_id is not null").collect()}
    assert got == expected_links(rows)
    assert got  # the fixture reaches the linking branch


def test_input_order_does_not_matter_and_linked_rows_pass(spark):
    rows = make_rows(7, 200, 20, 0.5)
    frame = lambda rs: spark.createDataFrame([tuple(r[f.name] for f in ROW) for r in rs], ROW)
    one = sorted(map(tuple, reconcile(frame(rows)).collect()), key=lambda r: r[0])
    two = sorted(map(tuple, reconcile(frame(rows[::-1]).repartition(7)).collect()), key=lambda r: r[0])
    assert one == two
    linked = reconcile(frame(rows)).where("supersedes_signal_id is not null")
    assert linked.where("validation_status <> 'PASS' or abstention_reason is not null "
                        "or signal_subtype <> 'cancelled' or related_signal_ids[0] <> supersedes_signal_id").count() == 0


def test_scenarios_are_isolated(spark):
    rows = make_rows(8, 150, 10, 0.5)
    schema = T.StructType([*ROW.fields, T.StructField("scenario_id", T.StringType())])
    data = [tuple(r[f.name] for f in ROW) + (f"sc{i % 3}",) for i, r in enumerate(rows)]
    got = {r.signal_id: r.supersedes_signal_id for r in
           reconcile(spark.createDataFrame(data, schema), scope=("extraction_run_id", "scenario_id"))
           .where("supersedes_signal_id is not null").collect()}
    want = {}
    for k in range(3):
        want |= {s: t for s, (t, _) in expected_links([r for i, r in enumerate(rows) if i % 3 == k]).items()}
    assert got == want


@pytest.mark.parametrize("seed,n,entities,share", [(1, 300, 40, 0.5), (4, 400, 1, 0.5)])
def test_links_do_not_depend_on_blocks_of_time(spark, monkeypatch, seed, n, entities, share):
    """every time line was cut into hours and shuffled once for each level of the scan."""
    from pitsignal.operators import reconcile as module
    from test_scale import plan_of

    rows = make_rows(seed, n, entities, share)
    df = spark.createDataFrame([tuple(r[f.name] for f in ROW) for r in rows], ROW)
    states = module.reversal_states(df)
    assert plan_of(states).count("Exchange") == 1
    whole = sorted(map(tuple, states.collect()))
    monkeypatch.setattr(module, "WHOLE", 0)
    assert sorted(map(tuple, module.reversal_states(df).collect())) == whole
    got = {r.signal_id: (r.supersedes_signal_id, r.signal_type) for r in
           reconcile(df).where("supersedes_signal_id is not null").collect()}
    assert got == expected_links(rows)
