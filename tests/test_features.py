"""Point-in-time features against a direct reading of the rules."""

import random
from datetime import timedelta

import pytest

from helpers import ledger_frame, pair_frame, signal, utc
from pitsignal.operators.features import build_features, contributing_signals, eligible_signals

CUTOFF = "2026-02-03T00:00:00"
DAY = timedelta(days=1)


def reference(rows, entity, cutoff):
    """The rules applied to one pair by looking at every signal."""
    vote = lambda r: {"INCREASE": 1, "DECREASE": -1}.get(r["direction"], 0) * (-1 if r["negated"] else 1)
    ok = [r for r in rows if r["forecast_key"] == entity and r["record_status"] == "ACTIVE"
          and r["validation_status"] in ("PASS", "REVIEW") and r["signal_type"] != "NO_SIGNAL"
          and r["available_at"] is not None and r["available_at"] <= cutoff
          and (r.get("effective_start") is None or r["effective_start"] < cutoff + 28 * DAY)
          and (r.get("effective_end") is None or r["effective_end"] > cutoff)]
    recent = [r for r in ok if r["available_at"] > cutoff - 30 * DAY]
    sized = [r for r in recent if r.get("magnitude_value") is not None and r.get("magnitude_basis") != "PERCENT"]
    off = lambda r: r["signal_type"] == "ORDER_LIFECYCLE" and r["direction"] == "DECREASE"
    total = lambda xs: round(sum(xs), 6) if xs else None
    votes = [vote(r) for r in recent]
    up, down = any(v > 0 for v in votes), any(v < 0 for v in votes)
    net = ("UNKNOWN" if not votes else "MIXED" if up and down else "INCREASE" if up else "DECREASE" if down else "STABLE")
    starts = [(r["effective_start"] - cutoff) // DAY for r in ok if r.get("effective_start") and r["effective_start"] >= cutoff]
    since = (cutoff - max(r["available_at"] for r in ok)) // DAY if ok else None
    kinds = {r["signal_type"] for r in recent}
    return dict(
        has_active_signal_30d=bool(recent), signal_count_30d=len(recent), net_demand_direction_30d=net,
        expected_qty_delta_next_horizon=total([r["magnitude_value"] * vote(r) for r in sized]),
        cancelled_qty_30d=total([abs(r["magnitude_value"]) for r in sized if off(r)]),
        committed_qty=total([abs(r["magnitude_value"]) for r in sized
                             if not off(r) and r["business_certainty"] in ("ASSERTED", "EXPECTED")]),
        delay_count_90d=sum(r["signal_type"] == "TIMING_REVISION" and r["direction"] == "DECREASE"
                            and r["available_at"] > cutoff - 90 * DAY for r in ok),
        nearest_effective_start_days=min(starts) if starts else None, days_since_latest_signal=since,
        independent_source_count_30d=len({r["source_id"] for r in recent}),
        active_conflict_count=sum({1, -1} <= {vote(r) for r in recent if r["signal_type"] == k} for k in kinds),
        staleness_status="UNKNOWN" if since is None else "FRESH" if since <= 14 else "STALE",
        contributing_signal_ids=[r["signal_id"] for r in sorted(
            ok, key=lambda r: (r["available_at"], r["source_id"], r["signal_id"]))],
        contributing_signal_count=len(ok))


def random_ledger(seed, n, entities):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # One entity and one source hold about a third of the rows.
        entity = 0 if rng.random() < 0.34 else rng.randrange(entities)
        source = 0 if rng.random() < 0.34 else rng.randrange(n // 2)
        start = utc("2026-01-01T00:00:00") + rng.randrange(-2000, 5000) * timedelta(hours=1)
        rows.append(signal(
            f"s{i:04d}", f"src{source}", None, forecast_key=f"E{entity}",
            signal_type=rng.choice(["ORDER_LIFECYCLE", "TIMING_REVISION", "DEMAND_EXPECTATION", "NO_SIGNAL"]),
            direction=rng.choice(["INCREASE", "DECREASE", "STABLE"]), negated=rng.random() < 0.2,
            business_certainty=rng.choice(["ASSERTED", "EXPECTED", "LIKELY"]),
            magnitude_value=rng.choice([None, 2.5, 10.0, -3.0]), magnitude_basis=rng.choice([None, "DELTA", "PERCENT"]),
            effective_start=start if rng.random() < 0.6 else None,
            effective_end=start + rng.randrange(1, 90) * DAY if rng.random() < 0.6 else None,
            validation_status=rng.choice(["PASS", "PASS", "REVIEW", "FAIL"]),
            record_status="SUPERSEDED" if rng.random() < 0.1 else "ACTIVE"))
    known = {r["source_id"]: utc("2026-01-01T00:00:00") + rng.randrange(0, 2400) * timedelta(hours=1) for r in rows}
    for r in rows:
        r["available_at"] = known[r["source_id"]]
    return rows


def check(spark, rows, pairs, **options):
    got = {(r["entity_key"], r["forecast_cutoff"]): r for r in build_features(
        ledger_frame(spark, rows), pair_frame(spark, pairs), generated_at="2027-01-01 00:00:00", lineage="array", **options,
    ).collect()}
    assert len(got) == len(set(pairs))
    for entity, cutoff in pairs:
        at = utc(cutoff)
        row = got[entity, at.replace(tzinfo=None)].asDict()
        want = reference(rows, entity, at)
        for c in ("expected_qty_delta_next_horizon", "committed_qty", "cancelled_qty_30d"):
            row[c] = None if row[c] is None else round(row[c], 6)
        assert {k: row[k] for k in want} == want, (entity, cutoff)


CALENDARS = {
    "weekly": [f"{(utc('2025-12-29T00:00:00') + i * 7 * DAY):%Y-%m-%dT%H:%M:%S}" for i in range(20)],
    "uneven": ["2026-01-03T00:00:00", "2026-01-03T00:00:00.000001", "2026-01-03T17:30:00", "2026-01-20T00:00:00",
               "2026-02-28T00:00:00", "2026-03-01T00:00:00", "2026-06-01T12:00:00"],
    "single": ["2026-02-15T00:00:00"],
    "two": ["2026-02-15T00:00:00", "2026-04-01T00:00:00"],
}


@pytest.mark.parametrize("calendar", list(CALENDARS))
def test_features_equal_the_direct_reading(spark, calendar):
    rows = random_ledger(len(calendar), 240, 4)
    check(spark, rows, [(f"E{e}", c) for e in range(5) for c in CALENDARS[calendar]])


def test_rows_grow_with_signals_and_pairs_not_with_other_cutoffs(spark):
    from pitsignal.operators import sweep

    claims = spark.range(2000).selectExpr(
        "concat('E', id % 400) as entity_key", "concat('S', id) as source_id", "id * 3600000000 as available_us",
        "cast(null as bigint) as window_start_us", "if(id % 2 = 0, null, (id + 500) * 3600000000) as window_end_us",
        "cast(null as bigint) as closed_us", "cast(null as bigint) as near_us", "1 as vote", "1L as type_bit", "1.0D as qty",
        "false as is_cancelled", "false as is_committed", "false as is_delay")
    pairs = spark.range(400).selectExpr("concat('E', id) as entity_key", "id * 17000000000 + id % 7 as cutoff_us")
    calendar = sweep.calendar_of(pairs)
    days = dict(horizon_days=28, lookback_days=30, long_lookback_days=90)
    spans = sweep.eligibility_intervals(claims, calendar, **days)
    size = sweep._block(calendar)
    dealt = spans.selectExpr(f"explode(sequence(lo div {size}, (hi - 1) div {size}))").count()
    assert dealt <= (sweep.BLOCKS + 2) * 2400
    assert sweep.sweep(claims, pairs, **days).count() == 400


def test_row_order_and_partitioning_do_not_matter(spark):
    rows = random_ledger(5, 150, 3)
    pairs = pair_frame(spark, [(f"E{e}", c) for e in range(3) for c in CALENDARS["weekly"]])
    build = lambda df: sorted(map(tuple, build_features(df, pairs, generated_at="2027-01-01 00:00:00").drop(
        "expected_qty_delta_next_horizon", "committed_qty", "cancelled_qty_30d").collect()))
    assert build(ledger_frame(spark, rows)) == build(ledger_frame(spark, rows[::-1]).repartition(5))


def test_boundaries(spark):
    """One signal per entity, each on one side of a boundary of the rules."""
    cases = {
        "at": dict(available_at=CUTOFF), "after": dict(available_at="2026-02-04T00:00:00"),
        "future_period": dict(effective_start="2026-02-10T00:00:00", effective_end="2026-02-20T00:00:00"),
        "past_period": dict(effective_start="2025-12-01T00:00:00", effective_end="2025-12-15T00:00:00"),
        "ends_at_cutoff": dict(effective_start="2026-01-01T00:00:00", effective_end=CUTOFF),
        "starts_at_horizon": dict(effective_start="2026-03-03T00:00:00"),
        "starts_in_horizon": dict(effective_start="2026-03-02T23:59:59"),
        "lookback_edge": dict(available_at="2026-01-04T00:00:00"), "superseded": dict(record_status="SUPERSEDED"),
        "no_signal": dict(signal_type="NO_SIGNAL", direction="NA"), "failed": dict(validation_status="FAIL"),
        "negated": dict(negated=True),
    }
    rows = [signal(k, f"src-{k}", **({"available_at": "2026-02-01T00:00:00"} | v), forecast_key=k) for k, v in cases.items()]
    frame = ledger_frame(spark, rows)
    got = {r["entity_key"]: r for r in build_features(frame, pair_frame(spark, [(k, CUTOFF) for k in cases])).collect()}
    eligible = {k for k, r in got.items() if r["contributing_signal_count"]}
    assert eligible == {"at", "future_period", "starts_in_horizon", "lookback_edge", "negated"}
    assert got["lookback_edge"]["signal_count_30d"] == 0
    assert got["future_period"]["nearest_effective_start_days"] == 7
    assert got["negated"]["net_demand_direction_30d"] == "DECREASE"
    for k in cases:
        assert bool(eligible_signals(frame, k, CUTOFF.replace("T", " ")).count()) == (k in eligible)


def test_as_of_mode_closes_superseded_signals(spark):
    rows = [signal("old", "a", "2026-01-10T00:00:00"),
            signal("new", "b", "2026-01-20T00:00:00", supersedes_signal_id="old"),
            signal("weak", "c", "2026-01-12T00:00:00", supersedes_signal_id="old", validation_status="REVIEW")]
    pairs = pair_frame(spark, [("CUST-0001", "2026-01-15T00:00:00"), ("CUST-0001", "2026-01-20T00:00:00")])
    ids = lambda mode: {str(r["forecast_cutoff"])[:10]: r["contributing_signal_ids"] for r in build_features(
        ledger_frame(spark, rows), pairs, supersession=mode, lineage="array").collect()}
    assert ids("as_of") == {"2026-01-15": ["old", "weak"], "2026-01-20": ["weak", "new"]}
    assert ids("raw")["2026-01-20"] == ["old", "weak", "new"]


def test_lineage_never_uses_later_evidence(spark):
    rows = random_ledger(9, 200, 3)
    pairs = pair_frame(spark, [(f"E{e}", c) for e in range(3) for c in CALENDARS["uneven"]])
    links = contributing_signals(ledger_frame(spark, rows), pairs)
    assert links.count() and links.where("available_at > forecast_cutoff").count() == 0


def test_lineage_arrays_hold_every_signal(spark):
    rows = [signal(f"s{i:04d}", f"n{i}") for i in range(1500)]
    got = build_features(ledger_frame(spark, rows), pair_frame(spark, [("CUST-0001", CUTOFF)]), lineage="array").first()
    assert sorted(got["contributing_signal_ids"]) == [r["signal_id"] for r in rows]


def test_repeated_sources_count_once_and_two_availabilities_fail(spark):
    from pitsignal.operators.features import with_availability

    signals = ledger_frame(spark, [signal("a", "n1")]).drop("available_at")
    once = spark.createDataFrame([("n1", "2026-02-01"), ("n1", "2026-02-01")], "source_id string, d string").selectExpr(
        "source_id", "cast(d as timestamp) as available_at")
    assert with_availability(signals, once).count() == 1
    twice = once.unionByName(once.selectExpr("source_id", "available_at + interval 1 microsecond as available_at"))
    with pytest.raises(Exception, match="two availabilities"):
        with_availability(signals, twice).collect()


def test_tasks_that_gather_lineage_follow_the_number_of_links(spark, monkeypatch):
    from pitsignal.operators import features

    monkeypatch.setattr(features, "LINKS_PER_TASK", 10)
    rows = [signal(f"s{i:03}", f"n{i}") for i in range(95)]
    got = build_features(ledger_frame(spark, rows), pair_frame(spark, [("CUST-0001", CUTOFF)]), lineage="array")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 4 and ", 10" in plan  # 96 rows, whatever the session's partitions are
    assert sorted(got.first()["contributing_signal_ids"]) == [f"s{i:03}" for i in range(95)]
