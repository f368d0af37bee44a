"""Source divergence, spelling variants and the language model against direct readings."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from cases import TEXTS, documents, empty, rows_of
from pitsignal.llm import divergence, pitman_yor, spelling
from pitsignal.llm.oracle import ORACLE
from pitsignal.llm.queries import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}
SF = "/root/testdata/sf0.001"


def told(value):
    return "" if value is None else value


# Source divergence ---------------------------------------------------------------------------


def audit_by_hand(rows, min_docs, scale, top):
    """(lang, source, part, item, value, rank) from (text, lang, source) rows."""
    counts, docs = {}, {}
    for text, lang, source in rows:
        words = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", told(text).translate(LOWER)))
        counts.setdefault(told(lang), {}).setdefault(told(source), Counter()).update(words)
        docs.setdefault(told(lang), Counter()).update(words.keys())
    out = []
    for lang, sources in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = Counter()
        for c in sources.values():
            whole.update(c)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + scale * (c[t] + 1) // (total + len(kept)) for t in kept}

        all_shares, own = shares(whole), {s: shares(c) for s, c in sources.items()}
        for s, c in sources.items():
            pair = [(sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept), o) for o in sources if o != s]
            term = [((own[s][t] - all_shares[t]) ** 2 // all_shares[t], t) for t in kept if c[t] and own[s][t] > all_shares[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(ranked, 1)]
    return sorted(out, key=repr)


def sourced(seed, n, words, sources):
    draw = random.Random(seed)
    return [(" ".join(f"{draw.choice('abcdefgh')}{'xyz'[draw.randrange(3)] * draw.randrange(4)}" for _ in range(draw.randrange(words))),
             draw.choice(["en", "de", None, ""]), f"s{min(draw.randrange(sources), draw.randrange(sources))}") for _ in range(n)]


@pytest.mark.parametrize("top", [3, 200])
def test_audit_by_hand(spark, top):
    rows = sourced(5, 120, 60, 7) + [(None, "fr", None), ("Ünï ÜNÏ aÜ", "fr", "x"), ("alone", "xx", "only")]
    df = spark.createDataFrame([(*r, "v", "r") for r in rows], "text string, lang string, source string, value string, rank string")
    assert rows_of(divergence.divergence(df, 3, 1_000_000_000, top)) == audit_by_hand(rows, 3, 1_000_000_000, top)


def test_audit_with_many_runs_and_tiles(spark, monkeypatch):
    # Blocks of a few entries spill many runs; tiles smaller than the number of sources.
    monkeypatch.setattr(divergence, "BLOCK", 40)
    monkeypatch.setattr(divergence, "CHUNK", 3)
    monkeypatch.setattr(divergence, "TILE", 30)
    rows = sourced(6, 150, 50, 23)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert rows_of(divergence.divergence(df, 2, 1000, 5)) == audit_by_hand(rows, 2, 1000, 5)


def test_audit_of_odd_rows(spark):
    rows = [(r.text, r.lang, r.source) for r in documents(spark).collect()]
    assert rows_of(divergence.divergence(documents(spark), 2)) == audit_by_hand(rows, 2, 1_000_000_000, 200)
    assert divergence.divergence(empty(spark)).count() == 0
    one = spark.createDataFrame([("a b c", "en", "s")], "text string, lang string, source string")
    assert divergence.divergence(one, 3).count() == 0
    two = spark.createDataFrame([("a b c", "en", "s"), (None, "en", None)], "text string, lang string, source string")
    assert rows_of(divergence.divergence(two, 3)) == [("en", "", "pair", "s", 0, 1), ("en", "s", "pair", "", 0, 1)]


# Spelling variants ---------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_by_hand(rows, min_chars, min_count, ratio, damage):
    words = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", told(text)):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{told(key)}:{run}".encode())
            if damage and h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= min_chars:
                words[run] += 1
    words = {w: n for w, n in words.items() if n >= min_count}
    form, met = {}, {}
    for w, n in words.items():
        found = sorted(((-words[o], o) for o in words if near(w, o)))
        met[w] = len(found)
        form[w] = found[0][1] if found and -found[0][0] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, met[w], words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def misspelt(seed, n):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        words = []
        for _ in range(draw.randrange(40)):
            word = list(draw.choice(["aabbaa", "aaaaaa", "aaaaaaa", "straße", "abcabcabc", "ÿÀÉaaa", "bcdefgh", "zzzzzzzzzz"]))
            for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
                at = draw.randrange(len(word))
                word[at:at + draw.randrange(2)] = draw.choice(["a", "b", "é", "", "X"])
            words.append("".join(word))
        rows.append((i, draw.choice([" ", "-", "×", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("ratio,damage,parts", [(5, 3, 1), (2, 0, 7), (2, 2, 7)])
def test_variants_by_hand(spark, ratio, damage, parts):
    rows = misspelt(ratio, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = rows_of(spelling.spelling_variants(df, 4, 2, ratio, damage))
    assert got == variants_by_hand(rows, 4, 2, ratio, damage)
    assert any(r[1] and r[2] != r[1] for r in got) or ratio == 5


def test_variants_of_odd_rows(spark):
    long_word = "ab" * 3000
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()] + [(100, long_word), (101, long_word), (102, long_word + "c")] * 2
    df = spark.createDataFrame([(*r, "w", 1, "f") for r in rows], "doc_id long, text string, word string, n int, form string")
    assert rows_of(spelling.spelling_variants(df, 3, 1, 2, 5)) == variants_by_hand(rows, 3, 1, 2, 5)
    assert spelling.spelling_variants(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(df, ratio=1)


def test_trie_numbers_each_prefix_once(spark):
    draw = random.Random(1)
    words = sorted({"".join(draw.choice("ab") for _ in range(draw.randrange(1, 9))) for _ in range(200)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long").repartition(5)
    rows = spelling.trie_nodes(df, "word").collect()
    seen = {}
    for r in rows:
        for length, node in enumerate(r.nodes):
            assert seen.setdefault(r.word[:length], node) == node
    assert len(set(seen.values())) == len(seen)
    assert [r.word for r in sorted(rows, key=lambda r: r.number)] == words


# Language model ------------------------------------------------------------------------------


def tokens_by_hand(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", told(text).translate(LOWER)), None]


def base_by_hand(rows):
    count = Counter()
    for key, text in rows:
        if key is None or zlib.crc32(str(key).encode()) % 5 != 1:
            count.update(tokens_by_hand(text))
    total, size = sum(count.values()), len(count)
    return sorted(((key, key is not None and zlib.crc32(str(key).encode()) % 5 == 1, len(t), sum(count[x] > 0 for x in t), total,
                    round(sum(math.log10((count[x] + 0.5) / (total + 0.5 * (size + 1))) for x in t), 6))
                   for key, t in ((k, tokens_by_hand(t)) for k, t in rows)), key=repr)


def test_counts_and_base_scores_by_hand(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = pitman_yor.score_held_out(docs, 1, 1)
    assert rows_of(got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens",
                              got.base_score.cast("decimal(20,6)").cast("double"))) == base_by_hand(rows)
    assert pitman_yor.score_held_out(empty(spark)).count() == 0


def test_untrained_model_gives_certainty_to_the_unknown_token(spark):
    docs = documents(spark)
    scored = pitman_yor.score(docs, pitman_yor.fit(docs.limit(0), 1, 1)).collect()
    assert len(scored) == docs.count() and all(r.score == r.base_score == r.n_known == 0 for r in scored)


def test_tokens_of_slices_equal_tokens_of_texts(monkeypatch):
    texts = [(t or "").encode() for t in TEXTS] + [b"x" * 500, " \x00 é é ".encode() * 40]
    whole = pitman_yor.tokens(texts)
    monkeypatch.setattr(pitman_yor, "SLICE_BYTES", 64)
    for a, b in zip(whole, pitman_yor.tokens(texts)):
        assert np.array_equal(a, b)
    words = [w for t in texts for w in tokens_by_hand(t.decode())]
    code = {}
    for word, h in zip(words, whole[0]):
        assert code.setdefault(word, h) == h
    assert len(set(code.values())) == len(code) and len(words) == len(whole[0])


def fitted(spark, rows, **options):
    return pitman_yor.fit(spark.createDataFrame(rows, "doc_id long, text string"), **options)


def test_probabilities_sum_to_one_in_every_context(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice("the he of cat sat on mat".split()) for _ in range(30))) for i in range(40)]
    model = fitted(spark, rows)
    words = sorted({w for _, t in rows for w in tokens_by_hand(t)}, key=str)
    hashes = [pitman_yor.tokens([(w or "").encode()])[0][0] if w else pitman_yor.END for w in words]
    scorers = [pitman_yor.Scorer(pitman_yor._dishes(r.data), model.samples) for r in model.shards.collect()]
    for before in ("", "cat", "unseen", "the"):
        leaf = pitman_yor.tokens([before.encode()])[1][-1:]
        total = 0.0
        for h in [*hashes, np.uint64(77)]:
            one = np.array([h], np.uint64)
            known = [s for s in scorers if pitman_yor._find(s.words, one)[1][0]]
            total += (known or scorers)[0].ask(one, np.zeros(1, np.int64), leaf)[1][0]
        assert total == pytest.approx(1.0, abs=1e-9)


def asked(model, word, before):
    one = pitman_yor.tokens([word.encode()])[0][:1]
    scorers = [pitman_yor.Scorer(pitman_yor._dishes(r.data), model.samples) for r in model.shards.collect()]
    known = [s for s in scorers if pitman_yor._find(s.words, one)[1][0]]
    return (known or scorers)[0].ask(one, np.zeros(1, np.int64), pitman_yor.tokens([before.encode()])[1][-1:])[1][0]


def test_contexts_are_whole_tokens_before(spark):
    contexts = pitman_yor.tokens([b"redcat bigcat cat Cat", b"same"])[1]
    assert len(set(contexts.tolist())) == 5 and contexts[0] == contexts[5] and contexts[3] == contexts[4]
    model = fitted(spark, [(i, "redcat sings" if i % 2 else "bigcat sleeps") for i in range(40)])
    assert asked(model, "sings", "redcat") > 0.8 > 0.1 > asked(model, "sings", "bigcat")


def test_scores_are_sums_over_tokens_with_pairs_never_seen(spark):
    draw = random.Random(5)
    words = [f"w{n}" for n in range(12)]
    rows = [(i, " ".join(draw.choice(words) for _ in range(8))) for i in range(20)]
    model = fitted(spark, rows, burn=1, samples=2)
    new = [(100, "w3 w3 other w1 thing w1"), (101, "w1 w2"), (102, None), (103, "w5 w4 w3 w2 w1 w0 w5 w4")]
    got = {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(new, "doc_id long, text string").repartition(3), model).collect()}
    scorers = [pitman_yor.Scorer(pitman_yor._dishes(r.data), model.samples) for r in model.shards.collect()]
    for key, text in new:
        hashes, contexts, _ = pitman_yor.tokens([(text or "").encode()])
        want = 0.0
        for h, context in zip(hashes, contexts):
            one = np.array([h], np.uint64)
            known = [s for s in scorers if pitman_yor._find(s.words, one)[1][0]]
            want += math.log10((known or scorers)[0].ask(one, np.zeros(1, np.int64), np.array([context], np.uint64))[1][0])
        assert got[key] == pytest.approx(want, abs=1e-9)


def test_seating_is_the_chinese_restaurant_process():
    rng, n, opening, discount = np.random.default_rng(3), 40, 2.5, 0.4
    got = pitman_yor.seat(np.full(40_000, n), np.full(40_000, opening), discount, rng)
    chance = np.zeros(n + 1)  # of t tables after k customers
    chance[1] = 1
    for k in range(1, n):
        opens = opening / (opening + k - discount * np.arange(n + 1))
        chance = chance * (1 - opens) + np.concatenate([[0], (chance * opens)[:-1]])
    assert np.abs(np.bincount(got, minlength=n + 1) / len(got) - chance).max() < 0.01
    assert pitman_yor.seat(np.array([0, 1]), np.array([1.0, 1.0]), discount, rng).tolist() == [0, 1]


def test_model_beats_the_base_on_held_out_documents(spark):
    rows = QUERIES["op13_pitman_yor"](spark, "/root/testdata/sf0.01").collect()
    for held in (True, False):
        some = [r for r in rows if r.held_out == held]
        assert len(some) > 100
        assert sum(r.score for r in some) > 0.95 * sum(r.base_score for r in some) and all(r.score < 0 for r in some)
        assert sum(r.score > r.base_score for r in some) > 0.9 * len(some)


def test_hot_shards_are_copied(spark):
    rows = [(i, "same word " * 50 + f"other{i}") for i in range(60)]
    model = fitted(spark, rows, burn=0, samples=1)
    assert model.copies
    scored = pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), model).collect()
    assert len(scored) == 60 and {r.n_tokens for r in scored} == {102} and all(r.n_known == 102 for r in scored)


def test_copies_are_dealt_to_more_partitions_than_asked_for(spark, monkeypatch):
    from pyspark import RDD

    rows = [(i, "same word " * 50 + f"other{i}") for i in range(60)]
    model = fitted(spark, rows, burn=0, samples=1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = {r.doc_id: r.score for r in pitman_yor.score(docs, model).collect()}
    deal = RDD.partitionBy
    dealt = pitman_yor._dealt(docs, pitman_yor.F.lit(False), len(model.names))
    monkeypatch.setattr(RDD, "partitionBy", lambda self, n, f: deal(self, max(n, 23), f))
    got = {r.doc_id: r.score for r in pitman_yor.answer(dealt, model, docs).collect()}
    assert model.copies and got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_spelling_variants"])
def test_query_equals_its_statement(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = db.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert rows_of(QUERIES[name](spark, SF).select(columns)) == sorted(want.fetchall(), key=repr)


def test_a_block_is_held_once_while_it_is_cut(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    class Task:
        get = staticmethod(lambda: Task())
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(pitman_yor, "TaskContext", Task)
    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", 400_000)
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in draw.zipf(1.3, 2_000) % 50_000) for _ in range(620)]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array([i % 5 > 0 for i in range(len(texts))])],
                            ["doc_id", "text", "learn"])
    tracemalloc.start()
    try:
        rows = sum(1 for _ in pitman_yor._cut(4)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 15
    assert peak < 160 * 400_000  # 195 bytes a token when blocks were held twice
