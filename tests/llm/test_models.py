"""Nearest neighbours and the quality classifier against brute force and held-out rows."""

import math
import zlib

import numpy as np
import pytest
from cases import documents, empty
from pitsignal.llm import multi_index, quality, queries


def brute(rows, every, k):
    """query_id -> [(vec_id, score)], nearest first, ties to the smaller id."""
    sound = [(i, np.array(v, np.float64)) for i, v in rows
             if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in sound]), np.array([v for _, v in sound])
    out = {}
    for i, v in sound:
        if i % every == 0:
            s = x @ v
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, 20, 20)
    got = queries.op6_multi_index_ann(spark, sf).collect()
    vectors = {i: np.array(v, np.float64) for i, v in rows if v is not None}
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        assert abs(r.score - float(vectors[r.query_id] @ vectors[r.vec_id])) < 1e-9 and r.vec_id != r.query_id
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == set(want)
    for rows_ in found.values():
        assert [r.rank for r in rows_] == list(range(1, len(rows_) + 1))
        assert rows_ == sorted(rows_, key=lambda r: (-r.score, r.vec_id))
    hits = sum(len({i for i, _ in want[q]} & {r.vec_id for r in found[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 0.0]),
            (6, [inf, 0.0, 0.0]), (7, [None, 1.0, 1.0]), (8, []), (20, [0.5, 0.5, 0.0]), (9, [0.0, -1.0, 2.0]), (None, [1.0, 1.0, 1.0]),
            (40, [1.0]), (9, [0.0, -1.0, 2.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, block int")
    got = {}
    for r in multi_index.search(frame, every=20, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [1, 2, 20], 20: [0, 1, 2]}
    assert multi_index.search(frame.where("false")).count() == 0
    line = spark.createDataFrame([(i, [float(i + 1)]) for i in range(50)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in multi_index.search(line, every=50, k=3).orderBy("rank").collect()] == [49, 48, 47]


def test_rows_that_repeat_a_query_have_an_answer_each(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=6).tolist()) for i in range(200)]
    rows += [rows[20], (40, draw.normal(size=6).tolist()), *[(300, rows[7][1])] * 30]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in multi_index.search(frame, every=20, k=5).collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    want = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x[q] * x).cumsum(axis=1)[:, -1]
        order = [j for j in np.lexsort((ids, -s)) if j != q][:5]
        want += [(int(ids[q]), rank, int(ids[j]), round(float(s[j]), 9)) for rank, j in enumerate(order, 1)]
    assert got == sorted(want)


def test_the_walk_orders_pairs_by_summed_score():
    draw = np.random.default_rng(1)
    left, right = draw.normal(size=7), draw.normal(size=5)
    cells = multi_index.walk(left, right, np.ones(35, int), 35)
    sums = [left[c // 5] + right[c % 5] for c in cells]
    assert sorted(cells) == list(range(35)) and sums == sorted(sums, reverse=True)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op10_quality_network(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    apart = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(apart) > 200
    assert np.mean([r.predicted == q for q, r in apart]) > 0.97
    assert np.mean([(r.score - q) ** 2 for q, r in apart]) < 0.03


def test_scores_of_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)] + [(1, 0, "x"), (None, 1, "x"), (3, None, "x"), (2, 7, "x")],
                                   "doc_id long, quality int, score string")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).select("text", "score").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    assert quality.score(empty(spark), model).count() == 0
    none = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.score(docs, none).select("score").collect()} == {0.5}
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.where("quality = 1"))).select("score").collect()} == {1.0}


def test_temperature_calibrates():
    draw = np.random.default_rng(2)
    z = draw.normal(size=4000) * 3
    y = (draw.random(4000) < quality.sigmoid(z)).astype(float)
    assert abs(quality.fit_temperature(4 * z, y) - 4) < 0.5


def test_every_character_of_a_text_without_blanks_counts(spark):
    word = "".join(chr(0x4E00 + i * i % 997) for i in range(5000))
    pieces = quality.words_of(f"a {word} b")
    assert pieces[0] == "a" and pieces[-1] == "b" and max(map(len, pieces)) <= quality.MAX_WORD
    trigrams = [p[i:i + 3] for p in pieces[1:-1] for i in range(len(p) - 2)]
    assert trigrams == [word[i:i + 3] for i in range(len(word) - 2)]
    other = word[:2000] + "base64+/" * 120 + word[2960:]
    docs = spark.createDataFrame([(i, f"plain words {i} here" if i % 2 else f"!! {i} || {i}") for i in range(60)] + [(100, word), (101, other)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).select("doc_id", "score").collect()}
    assert len(word) == len(other) and scores[100] != scores[101]


def test_word_vectors_come_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(quality, "HELD", 50)
    monkeypatch.setattr(quality, "WINDOW", 7)
    texts = [f"left{i % 300} mid{i % 300} right{i % 7} end" for i in range(1800)] + [None, "", "rare rare", "one two three " * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, quality int")
    files = quality.fit(docs, labels).vectors
    table, slot = quality.index_table(quality.SLOTS, quality.LEARNED, 23), lambda w: zlib.crc32(w.encode()) % quality.SLOTS
    want, seen = {}, {}
    for words in ((t or "").split() for t in texts):
        for i, w in enumerate(words):
            seen[w] = seen.get(w, 0) + 1
            near = words[max(0, i - 2):i] + words[i + 1:i + 3]
            want[w] = want.get(w, 0) + sum((table[slot(x)] for x in near), np.zeros(quality.LEARNED))
    names = [*want, "unseen", "left300"]
    got = quality.Vectors(files).of(names)
    assert sum(n for _, n, _ in files) == sum(n >= 5 for n in seen.values()) > 600
    for w, v in zip(names, got):
        unit = want[w] / (np.linalg.norm(want[w]) or 1) if seen.get(w, 0) >= 5 else np.zeros(quality.LEARNED)
        assert np.allclose(v, unit, atol=1e-3), w


def test_recall_above_the_old_floor(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(5000, 32))
    x *= np.exp(0.5 * draw.normal(size=(5000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, v.tolist()) for v in x[:30]]
    want = brute(rows, 100, 20)
    found = {}
    for r in multi_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100, k=20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(found) == set(want)
    del want[100]  # repeats its id
    assert sum(len({i for i, _ in want[q]} & found[q]) for q in want) >= 0.99 * sum(map(len, want.values()))


def test_clustered_vectors_leave_most_cells_unvisited():
    draw = np.random.default_rng(6)
    left, right = draw.normal(size=(2, 12)) * 10
    sizes, slack = draw.integers(0, 9, 144), np.full(144, 0.5)
    entries = np.repeat(np.arange(144), sizes)
    scores = np.add.outer(left, right).ravel()[entries] + draw.uniform(-0.5, 0.5, len(entries))
    cells = multi_index.reachable(left, right, sizes, slack, 20)
    assert cells[entries[np.argsort(-scores)[:20]]].all() and cells.sum() < 30
    assert multi_index.reachable(left, right, sizes, slack, 10_000).sum() == np.count_nonzero(sizes)


def test_word_hashes_are_those_of_their_utf8():
    words = ["", "word", "é", "中", "\ud800x", "a" * 200]
    assert np.array_equal(quality.hashes(words), quality.hashes(quality.coded(words)))


def test_vectors_of_near_blocks_are_read_together(tmp_path, monkeypatch):
    draw = np.random.default_rng(8)
    h = np.unique(draw.integers(-2 ** 63, 2 ** 63 - 1, 64 * 700 + 5))
    rows = np.zeros(len(h), quality.ROW)
    rows["h"], rows["v"] = h, draw.normal(size=(len(h), quality.LEARNED))
    (tmp_path / "vectors-000000").write_bytes(rows.tobytes())
    found = quality.Vectors([(f"file://{tmp_path}/vectors-000000", len(h), h[::quality.ROWS].tobytes())])
    reads, read = [], found._read
    monkeypatch.setattr(found, "_read", lambda path, at, n: reads.append(n) or read(path, at, n))
    some = draw.permutation(np.concatenate([h[::150], h[:3], h[-3:], h[5::64 * 40], draw.integers(-2 ** 63, 2 ** 63 - 1, 50)]))
    want = dict(zip(h.tolist(), rows["v"].astype(np.float32)))
    none = np.zeros(quality.LEARNED, np.float32)
    assert np.array_equal(found.of_hashes(some), np.array([want.get(x, none) for x in some.tolist()]))
    assert len(reads) <= 4 and max(reads) <= quality.SPAN * quality.ROWS
    assert not found.of_hashes(np.zeros(0, np.int64)).size
