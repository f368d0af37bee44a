"""Drift profiles, confirmed degradation and lead time against direct readings of the rules."""

import random
import re
from hashlib import md5

from pitsignal.operators import monitor


def _cell(n):
    while n >= 64 and any(n & (1 << k) for k in range(n.bit_length() - 6)):
        n -= 1
    return n


def test_length_cells_are_exact_or_close(spark):
    sizes = [*range(0, 300), 1_000, 4_095, 4_096, 123_457]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    got = {r.n: r.cell for r in df.selectExpr("n", f"{monitor.length_cell('n')} as cell").collect()}
    assert got == {n: _cell(n) for n in sizes}
    assert all(n - c <= n / 32 for n, c in got.items())


def test_profiles_add_up_and_distances_follow(spark):
    draw = random.Random(5)
    rows = [(draw.choice("xyz"), " ".join(draw.choice(["ab", "c\td", "é", "w" * 70]) for _ in range(draw.randrange(40))))
            for _ in range(120)] + [("x", None), ("y", ""), ("z", " ")]
    texts = spark.createDataFrame(rows, "part string, text string")
    profiles = monitor.text_profile(texts).cache()
    halves = [monitor.text_profile(texts.where(f"length(text) % 2 {op}")) for op in ("= 0", "= 1")]
    halves.append(monitor.text_profile(texts.where("text is null")))
    by_half = halves[0].union(halves[1]).union(halves[2]).groupBy("feature", "part", "cell").sum("count")
    assert sorted(map(tuple, by_half.collect())) == sorted(map(tuple, profiles.collect()))

    want = {}
    for part, text in rows:
        text = text or ""
        cells = [("length", _cell(len(text)))]
        cells += [("vocabulary", int(md5(w.encode()).hexdigest()[:3], 16)) for w in re.split(r"[ \t-\r]+", text) if w]
        for feature, cell in cells:
            want.setdefault((feature, part), {}).setdefault(cell, 0)
            want[feature, part][cell] += 1
    got = {(r.feature, r.part): r for r in monitor.profile_shift(profiles, monitor.merged(profiles)).collect()}
    assert set(got) == set(want)
    for (feature, part), mon in want.items():
        ref = {}
        for (other, _), cells in want.items():
            for c, n in cells.items() if other == feature else ():
                ref[c] = ref.get(c, 0) + n
        gaps = [mon.get(c, 0) / sum(mon.values()) - ref[c] / sum(ref.values()) for c in sorted(ref)]
        assert abs(got[feature, part].variation - sum(map(abs, gaps)) / 2) < 1e-12
        assert abs(got[feature, part].steps - max(abs(sum(gaps[:k + 1])) for k in range(len(gaps)))) < 1e-12


def test_empty_profile(spark):
    none = monitor.text_profile(spark.createDataFrame([], "part string, text string"))
    assert none.count() == 0 and monitor.profile_shift(none, monitor.merged(none)).count() == 0


def test_degradation_is_the_reset_sum(spark):
    draw = random.Random(7)
    rows = [(f, p, draw.gauss(0, 1)) for f in "abcdef" for p in range(40) if draw.random() < 0.9]
    rows += [("flat", p, -1.0) for p in range(10)] + [("odd", 1, None), ("odd", 2, float("nan"))]
    losses = spark.createDataFrame(rows, "feature string, part long, loss double")
    for persist in (1, 2, 4):
        want = {}
        for f in "abcdef":
            s, run, last = 0.0, 0, None
            for p, x in sorted((p, x) for g, p, x in rows if g == f):
                s = max(0.0, s + x - 0.1)
                run = (run + 1 if last == p - 1 else 1) if s > 1.5 else 0
                last = p
                if run == persist:
                    want.setdefault(f, p)
        got = {r.feature: r.part for r in monitor.degradation(losses, slack=0.1, threshold=1.5, persist=persist).collect()}
        assert got == want


def test_lead_time(spark):
    alerts = spark.createDataFrame(
        [("a", 3, True), ("a", 2, False), ("a", 5, True), ("b", 4, True), ("c", 1, False)], "feature string, part long, alert boolean")
    degraded = spark.createDataFrame([("a", 7), ("d", 2), ("b", 1)], "feature string, part long")
    got = {r.feature: (r.first_alert, r.confirmed, r.lead) for r in monitor.lead_time(alerts, degraded).collect()}
    assert got == {"a": (3, 7, 4), "b": (4, 1, -3), "d": (None, 2, None)}
