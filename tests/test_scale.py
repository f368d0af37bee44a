"""Plans and figures that must hold on larger tables."""

from contextlib import redirect_stdout
from io import StringIO

from pitsignal.plans.registry import all_queries

SF = "/root/testdata/sf0.001"


def plan_of(df):
    out = StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_cutoffs_out_of_an_array_are_not_broadcast(spark):
    """every customer at every month looked as small as the customer file."""
    plan = plan_of(all_queries()["oracle_features"](spark, SF))
    assert "SortMergeJoin [entity_key" in plan and "BroadcastHashJoin [entity_key" not in plan
    assert "BroadcastHashJoin [source_id" not in plan


def test_rows_of_small_entities_go_out_once(spark, monkeypatch):
    """at cutoffs of its own, a claim was repeated for each block of the time axis it spans."""
    from helpers import ledger_frame, pair_frame, signal
    from pitsignal.operators import sweep
    from pitsignal.operators.features import contributing_signals

    rows = [signal(f"s{i}", f"src{i}", f"2026-01-0{1 + i}T00:00:00") for i in range(5)]
    pairs = [("CUST-0001", f"2026-0{m}-1{m}T00:0{m}:00") for m in range(2, 9)]
    met, counted = sweep._meet, []

    def meet(rows, reads, large, calendar, end, how="inner"):
        counted.append(large.count())
        return met(rows, reads, large, calendar, end, how)

    monkeypatch.setattr(sweep, "_meet", meet)
    whole = sorted(contributing_signals(ledger_frame(spark, rows), pair_frame(spark, pairs)).collect())
    monkeypatch.setattr(sweep, "WHOLE", 0)
    cut = sorted(contributing_signals(ledger_frame(spark, rows), pair_frame(spark, pairs)).collect())
    assert counted == [0, 1] and len(whole) == 35 and whole == cut


def test_requested_pairs_are_not_summed_as_rows_of_their_own(spark):
    """F8: the cutoffs, which compress to nothing, met in one task's aggregate."""
    plan = plan_of(all_queries()["pit_features_events"](spark, SF))
    assert "LeftOuter" in plan[plan.index("Union"):]


def test_sizes_the_cluster_names_stay():
    from pitsignal.session import _DEFAULTS, ensure_settings

    class Session:
        def __init__(self, **named):
            self.conf = self
            self.named = {"spark.sql.session.timeZone": "UTC", "spark.sql.codegen.hugeMethodLimit": "8000", **named}

        def get(self, key, *default):
            return self.named.get(key, *default)

        def set(self, key, value):
            self.named[key] = value

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    assert ensure_settings(Session(**{key: "32m"})).get(key) == "32m"
    assert ensure_settings(Session()).get(key) == _DEFAULTS[key]


def test_notes_meet_their_truth_as_numbers(spark):
    """texts, truth and keys of an order were shuffled by a text key, and its note extracted twice."""
    from pitsignal.plans.queries_evaluation import noisy_predictions
    from pitsignal.sources.derived import cases_from_orders

    assert "Join [source_id" not in plan_of(cases_from_orders(spark, SF))
    assert "Union" not in plan_of(noisy_predictions(spark, SF))


def test_only_reversals_are_shuffled_to_their_links(spark):
    """every signal of the ledger was shuffled to meet the links of a few."""
    from pitsignal.operators.reconcile import reconcile
    from pitsignal.plans.queries_ledger import stored_signals

    signals = stored_signals(spark, SF)
    linked = reconcile(signals)
    assert "Union" in plan_of(linked).split("Join")[0]
    assert linked.columns == signals.columns and linked.count() == signals.count()


def test_signals_of_an_experiment_are_shuffled_and_stored_narrow(spark, monkeypatch):
    """whole signals were shuffled to their entities, stored, shuffled to their nations and stored again."""
    from pitsignal.plans import queries_ledger
    from pitsignal.plans.queries_extraction import order_signals

    assert "Join [source_id" not in plan_of(order_signals(spark, SF))
    staged, stage = [], queries_ledger.stage
    monkeypatch.setattr(queries_ledger, "stage", lambda df: staged.append(df) or stage(df))
    signals = queries_ledger.nation_signals(spark, SF, linked=True)
    read = {"extraction_run_id", "supersedes_signal_id", "nation_keys", *queries_ledger.CLAIM_COLUMNS, *queries_ledger.LINK_COLUMNS}
    assert staged and all(set(df.columns) <= read for df in staged)
    assert sum(df.count() for df in staged) < 1.5 * signals.count()
    assert "Join [forecast_key" not in plan_of(signals)


def test_claims_meet_their_superseders_once(spark, monkeypatch):
    """every part of the sweep joined all signals with the superseding ones."""
    from helpers import ledger_frame, pair_frame, signal
    from pitsignal.operators import features

    rows = [signal(f"s{i}", f"src{i}", f"2026-01-0{1 + i}T00:00:00", supersedes_signal_id=f"s{i - 2}" if i > 5 else None)
            for i in range(9)]
    joined, meet = [], features._with_supersession
    monkeypatch.setattr(features, "_with_supersession", lambda *a: joined.append(meet(*a)) or joined[-1])
    pairs = pair_frame(spark, [("CUST-0001", f"2026-01-0{d}T12:00:00") for d in range(1, 10)])
    built = features.build_features(ledger_frame(spark, rows), pairs, supersession="as_of")
    counts = [r["contributing_signal_count"] for r in built.orderBy("forecast_cutoff").collect()]
    assert counts == [1, 2, 3, 4, 5, 6, 6, 6, 6]
    assert "superseded" not in plan_of(built)
    assert sorted(r["signal_id"] for r in joined[0].where("superseded_us is not null").collect()) == ["s4", "s5", "s6"]


def test_rows_without_a_partner_are_told_apart(spark, monkeypatch):
    from pitsignal.operators import possible

    rows, keys = spark.range(2000), spark.range(0, 2000, 40).selectExpr("xxhash64(id) as h")
    for bits in (1 << 24, 1 << 7):
        monkeypatch.setattr(possible, "BITS", bits)
        kept = {r["id"] for r in possible.with_possible(rows, keys, key="h", hashed="xxhash64(id)").where("possible").collect()}
        assert kept >= set(range(0, 2000, 40)) and len(kept) < 1400
    none = possible.with_possible(rows, keys.limit(0), key="h", hashed="xxhash64(id)")
    assert none.count() == 2000 and none.where("possible").count() == 0


def test_truth_meets_its_notes_as_numbers(spark):
    """truth and notes of the oracle arm were shuffled by text keys, once for each part of the sweep."""
    from pitsignal.operators.oracle import claims_from_truth
    from pitsignal.sources.derived import nation_signals_key, notes_from_orders, truth_by_nation, truth_from_orders

    claims = claims_from_truth(truth_by_nation(spark, SF), None)
    assert "Join [source_id" not in plan_of(claims)
    notes, owners = notes_from_orders(spark, SF), nation_signals_key(spark, SF)
    by_nation = notes.join(owners, notes.entity_mentions_raw[0] == owners.customer_key).selectExpr(
        "source_id", "available_at", "array(nation_key) as entity_mentions_raw")
    whole = claims_from_truth(truth_from_orders(spark, SF), by_nation)
    assert claims.columns == whole.columns and claims.count() > 0
    assert claims.exceptAll(whole).count() == whole.exceptAll(claims).count() == 0


def test_reversals_are_linked_before_they_meet_their_nations(spark):
    """the signals of an experiment are those of the whole ledger, linked and keyed by nation."""
    from pitsignal.operators.reconcile import reconcile
    from pitsignal.plans.queries_ledger import nation_signals, stored_signals
    from pitsignal.sources.derived import nation_signals_key

    got, owners = nation_signals(spark, SF, linked=True), nation_signals_key(spark, SF)
    ledger = reconcile(stored_signals(spark, SF)).where("signal_type <> 'NO_SIGNAL'")
    want = ledger.join(owners, ledger.forecast_key == owners.customer_key).selectExpr(
        *("nation_key as forecast_key" if c == "forecast_key" else c for c in got.columns))
    assert got.where("supersedes_signal_id is not null").count() > 0
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
