"""The similarity join and the personal-data operator against direct readings."""

import hashlib
import random
import re

import numpy as np
import pytest
from cases import TEXTS, documents, empty, rows_of
from pitsignal.llm import ngram_join, pii, queries


def sets_by_hand(rows, width):
    out = []
    for d, t in rows:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        k = min(width, len(w))
        out.append((d, frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()))
    return out


def components_by_hand(rows, width, percent):
    sets = sets_by_hand(rows, width)
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    best = {}
    for i, (d, s) in enumerate(sets):
        if d is not None:
            best[root(i)] = min(best.get(root(i), d), d)
    return sorted(((d, len(s), best.get(root(i)) if s else d) for i, (d, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_components_of_given_documents(spark, width, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = ngram_join.similar_documents(docs, width=width, percent=percent).select("doc_id", "n_shingles", "component_id")
    assert rows_of(got) == components_by_hand([(r.doc_id, r.text) for r in docs.collect()], width, percent)


def family(seed, n, length, edits):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(500)}" for _ in range(length)]
    rows = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randrange(edits + 1)):
            words[draw.randrange(len(words))] = f"e{draw.randrange(10 ** 6)}"
        rows.append(" ".join(words))
    return rows


def test_large_families_and_small_sets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FULL", 6)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    texts = family(1, 60, 40, 3) + family(2, 40, 12, 1) + family(3, 40, 7, 1) + family(4, 30, 200, 6) + family(5, 25, 400, 20)
    rows = list(enumerate(texts))
    random.Random(9).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((3, 90), (2, 80), (1, 95)):
        got = ngram_join.similar_documents(docs, width=width, percent=percent).select("doc_id", "n_shingles", "component_id")
        assert rows_of(got) == components_by_hand(rows, width, percent), (width, percent)


def test_rows_of_a_family_of_near_copies_grow_with_its_size(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FULL", 6)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "HUBS", 2, raising=False)
    dealt, stage = [], ngram_join.stage

    def counted(df, name="stage"):
        out = stage(df, name)
        if name == "members":
            dealt.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "stage", counted)
    texts = family(7, 320, 200, 1)
    made = []
    for n in (80, 320):
        docs = spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string")
        got = ngram_join.similar_documents(docs, width=2, percent=80).select("doc_id", "n_shingles", "component_id")
        assert rows_of(got) == components_by_hand(list(enumerate(texts[:n])), 2, 80)
        made.append(sum(dealt))
        dealt.clear()
    assert made[0] > 80 and made[1] <= 6 * made[0]


def test_members_of_large_groups_meet_across_components(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    groups = [(1, i) for i in range(60)] + [(2, i) for i in range(40)]
    root = {i: 0 if i < 45 else 45 if i < 50 else i for i in range(60)}
    met = ngram_join.across_components(spark.createDataFrame(groups, "sig long, cid long"),
                                       spark.createDataFrame([(i, r) for i, r in root.items() if i < 50], "node long, root long")).collect()
    assert {r.g1 for r in met} == {1}
    keys = {}
    for r in met:
        keys.setdefault((r.g2, r.g3), []).append((r.cid, r.side))
    pairs = {(a, b) for rows in keys.values() for a, x in rows for b, y in rows if a < b and (x != y or x == -1)}
    assert pairs >= {(a, b) for a in range(60) for b in range(a + 1, 60) if root[a] != root[b]}


def test_join_of_odd_rows(spark):
    docs = documents(spark)
    got = ngram_join.similar_documents(docs, width=3, percent=90).select("doc_id", "n_shingles", "component_id")
    assert rows_of(got) == components_by_hand([(r.doc_id, r.text) for r in docs.collect()], 3, 90)
    assert ngram_join.similar_documents(empty(spark)).count() == 0


def test_linked_sets_always_share_a_signature():
    draw = np.random.default_rng(3)
    missed = checked = 0
    for percent in (80, 90, 95):
        for size in list(range(1, 60)) + [75, 113, 170, 256, 500, 900]:
            for _ in range(12):
                a = np.unique(draw.integers(0, 1 << 63, size).astype(np.uint64))
                room = int(2 * len(a) * (100 - percent) / (100 + percent)) + 1
                out, new = draw.integers(0, room + 1), draw.integers(0, room + 1)
                b = np.unique(np.concatenate([draw.permutation(a)[min(out, len(a) - 1):], draw.integers(0, 1 << 63, new).astype(np.uint64)]))
                if ngram_join.linked(a, b, percent):
                    checked += 1
                    missed += not len(np.intersect1d(ngram_join.signatures(a, percent), ngram_join.signatures(b, percent)))
                    members = [(0, len(a), ngram_join.profile(a), 0, -1), (1, len(b), ngram_join.profile(b), 1, -1)]
                    assert len(ngram_join.likely_pairs(members, percent, False)) == 1
    assert checked > 500 and missed == 0


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 200)]
    got = dict(ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 160)) and got[300] == 200
    assert ngram_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def base_by_hand(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if k == 2 and not (14 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if k == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_and_what_the_field_adds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op7_crf_pii(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        base = base_by_hand(texts[r.doc_id])
        names = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        every = r.spans.split(",") if r.spans else []
        assert set(names) <= set(every) and len(every) == len(names) + r.n_added
        if not re.search("[0-9@+]", texts[r.doc_id] or ""):
            assert not every


ODD = ["a@b@c.d e.f@g.h.i@j.k", "x@y", "@a.b", "1.2.3.4.5.6.7.8 300.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111-1", "+1((((+12 345 678 9012 +1.2",
       "1" * 500 + ".1.1.1", "a.b%c@d-e.f-g.h.", "ü 10.0.0.1 é", "x" * 20000 + "@", "9" * 20000]


def test_personal_data_of_odd_rows(spark):
    assert [pii.base_spans(t) for t in ODD] == [base_by_hand(t) for t in ODD]
    docs = documents(spark, [*TEXTS, *ODD])
    got = pii.detect(docs).collect()
    assert len(got) == docs.count()
    assert all(r.spans == "" for r in got if r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added == 0)
    assert pii.detect(empty(spark)).count() == 0


def test_the_field_learns_forms_beside_the_base():
    field = pii.train(pii.taught())
    text = "please call (555) 201-3344 before noon or +1 (212) 555-0187 4556737586899855 and keep 12 of 40 items"
    base = pii.base_spans(text)
    words = pii.windows(text)
    tags = field.decode([pii.features([text[s:e] for s, e in w]) for w in words])
    added = [text[s:e] for w, t in zip(words, tags) for s, _, e in pii.added_spans(text, w, t, base)]
    assert "(555) 201-3344" in added and not any(x in added for x in ("12", "40"))


def test_the_field_sees_inside_texts_without_blanks():
    field = pii.train(3 * pii.taught())
    text = '{"name":"x","note":"' + "y" * 80 + '","contact":"zoë@mail.example.fr","size":12}' + "&ref=" + "q" * 90
    added = [x for words in pii.windows(text) for tags in field.decode([pii.features([text[s:e] for s, e in words])])
             for x in pii.added_spans(text, words, tags, pii.base_spans(text))]
    assert "zoë@mail.example.fr" in {text[s:e] for s, _, e in added}
    assert all(e - s < 60 for words in pii.windows(text.replace("y" * 80, "").replace("q" * 90, "")) for s, e in words)


def test_viterbi_finds_the_best_path():
    import itertools

    draw = np.random.default_rng(4)
    x, move = draw.normal(size=(3, 4, 9)), draw.normal(size=(9, 9)) + np.where(pii.allowed(), 0, -1e4)
    lengths = np.array([4, 2, 3])
    paths = pii.viterbi(x, move, lengths)
    first = np.array([-1e4 if t[0] == "I" else 0 for t in pii.TAGS])
    for k, n in enumerate(lengths):
        value = lambda p: first[p[0]] + sum(x[k, t, p[t]] for t in range(n)) + sum(move[p[t - 1], p[t]] for t in range(1, n))  # noqa: B023, E731
        best = max(itertools.product(range(9), repeat=int(n)), key=value)
        assert tuple(paths[k, :n]) == best
