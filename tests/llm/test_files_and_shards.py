"""Token files, archives, line bitmaps, windows, mixing and shards against direct readings."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import DOCUMENTS, TEXTS, documents, empty, rows_of
from pitsignal.llm import cube_mixing, decontaminate, kd_shards, line_dedup, queries, seekable_tokens, warc
from pitsignal.llm.common import new_folder

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def expected_tokens(rows):
    start, out = 0, []
    for doc_id, text in rows:
        ids = np.array(ids_of(text), "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_hold_what_the_tokenizer_gives(spark):
    got = [tuple(r) for r in queries.op1_seekable_tokens(spark, SF).orderBy("doc_id").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert got == expected_tokens(docs)


def test_token_files_with_odd_rows_and_special_words(spark):
    odd = [*TEXTS, "a<|endoftext|>b", "It's x... ,. 12.5 Σ É́", "x" * 300]
    docs = documents(spark, odd)
    manifest = seekable_tokens.write_token_files(docs, new_folder(spark, "t"), WORD_BPE, end_id=1, frame_bytes=64)
    got = seekable_tokens.read_token_files(manifest).collect()
    want = Counter((d, n, c) for d, _, n, c in expected_tokens([(r.doc_id, r.text) for r in docs.collect()]))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i))
    some = seekable_tokens.read_token_files(manifest, [5, 9]).collect()
    assert sorted(tuple(r) for r in some) == sorted(tuple(r) for r in got if r.doc_id in (5, 9))
    assert seekable_tokens.encode_and_read_back(empty(spark), WORD_BPE).count() == 0


def test_a_damaged_frame_is_noticed(tmp_path):
    import io

    sink = io.BytesIO()
    writer = seekable_tokens.FrameWriter(sink, 16)
    for i in range(5):
        writer.add(i, np.arange(8, dtype="<u2").tobytes(), 2)
    writer.close()
    data = bytearray(sink.getvalue())
    reader = seekable_tokens.FrameReader(io.BytesIO(data), len(data), 2)
    assert [d for d, _, _ in reader.documents()] == list(range(5))
    other = bytearray(data)
    other[int(reader.starts[1]) + 9] ^= 255
    with pytest.raises(Exception):
        list(seekable_tokens.FrameReader(io.BytesIO(other), len(other), 2).documents({1}))
    assert len(list(seekable_tokens.FrameReader(io.BytesIO(other), len(other), 2).documents({0}))) == 1


def test_archives_round_trip(spark):
    got = rows_of(queries.op3_warc_transactions(spark, SF))
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    last = {}
    for p in pages:
        h = p.html or ""
        last[h] = max(last.get(h, p.page_id), p.page_id)
    want = []
    for p in pages:
        data = (p.html or "").encode()
        first = last[p.html or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((p.page_id, len(data), digest, "response" if first == p.page_id else "revisit",
                     None if first == p.page_id else first))
    assert got == sorted(want, key=repr)


def test_archives_with_odd_rows(spark):
    rows = [(1, "http://a/x y\r\nz", "same"), (2, None, "same"), (None, "http://n", "same"), (3, "", None), (4, "http://b", ""),
            (5, "http://c", "ü" * 10), (2, None, "same"), (6, "http://d", "alone")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, kind int")
    got = warc.captures(pages)
    assert [(r.page_id, r.record_type, r.refers_to) for r in got.orderBy("page_id", "record_type").collect()] == [
        (None, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (3, "revisit", 4),
        (4, "response", None), (5, "response", None), (6, "response", None)]
    long_ones = {r.page_id: r.record_type for r in warc.captures(pages, min_bytes=10).collect()}
    assert set(long_ones.values()) == {"response"}
    nested = warc.assemble(warc.read_records(warc.write_archives(pages, new_folder(spark, "w")), with_payload=True)).collect()
    assert all(r.request and r.metadata for r in nested) and len(nested) == 8
    assert {bytes(r.main.payload).decode() for r in nested if r.main.kind == "response"} == {"same", "", "ü" * 10, "alone"}
    assert warc.captures(pages.where("false")).count() == 0


def test_links_count_in_either_direction_and_may_be_missing(spark):
    record = "kind string, record_id string, concurrent_to array<string>, payload binary"
    records = spark.createDataFrame([
        ("response", "r1", ["q1"], None), ("request", "q1", [], None), ("metadata", "m1", ["r1"], None),
        ("response", "r2", [], None), ("request", "q3", ["gone"], None)], record)
    got = {r.main_id: (r.request and r.request.record_id, r.metadata and r.metadata.record_id) for r in warc.assemble(records).collect()}
    assert got == {"r1": ("q1", "m1"), "r2": (None, None)}


def lines_by_hand(rows, min_docs, min_chars):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    seen = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            seen[key(line)].add((d, t or ""))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(seen[key(x)]) < min_docs]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs,min_chars", [(2, 1), (3, 0), (2, 12)])
def test_common_lines(spark, min_docs, min_chars):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(line_dedup.drop_common_lines(docs, min_docs=min_docs, min_chars=min_chars)) == lines_by_hand(rows, min_docs, min_chars)
    assert line_dedup.drop_common_lines(empty(spark)).count() == 0


def test_long_documents_lose_lines_past_the_first_word_of_the_bitmap(spark):
    long = "\n".join("hit" if i % 70 == 69 else f"line {i}" for i in range(300))
    docs = spark.createDataFrame([(1, long), (2, "hit"), (3, "Hit ")], "doc_id long, text string")
    assert rows_of(line_dedup.drop_common_lines(docs, min_docs=3)) == lines_by_hand([(1, long), (2, "hit"), (3, "Hit ")], 3, 1)
    first = {r.doc_id: r.n_dropped for r in line_dedup.drop_common_lines(docs, min_docs=2, keep_first=True).collect()}
    assert first == {1: 3, 2: 1, 3: 1}


def windows_by_hand(rows, items):
    def words(t):
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    spans = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            spans[tuple(w[s:s + n])].add(str(i))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in spans}:
            for s in range(len(w) - n + 1):
                got = spans.get(tuple(w[s:s + n]))
                if got:
                    hit.update(range(s, s + n))
                    found |= got
        out.append((d, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return sorted(out, key=repr)


def test_windows(spark):
    items = [(1, "Quick brown fox jumps over the lazy dog again and AGAIN today"), (10, "shared line"), (2, ""), (3, None),
             (4, "one"), (5, "a, b; C"), (6, "Ünïcode"), (None, "a b c"), (7, "word " * 12), (8, "none of these words is there")]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, words string")
    docs = documents(spark)
    got = decontaminate.find_contamination(docs, benchmark).selectExpr(
        "doc_id", "n_words", "n_hit", "n_items", "array_join(items, ',')", "contaminated")
    known = [(i, t) for i, t in items if i is not None]
    want = windows_by_hand([(r.doc_id, r.text) for r in docs.collect()], known)
    # A null item has no name; its windows still hit.
    assert [(r[0], r[1], r[2], r[5]) for r in rows_of(got)] == [(r[0], r[1], r[2], r[5]) for r in want]
    assert [r[4] for r in rows_of(got)] == [r[4] for r in want]
    assert decontaminate.find_contamination(empty(spark), benchmark).count() == 0
    assert not decontaminate.find_contamination(docs, benchmark.where("false")).where("contaminated").count()


def test_every_window_of_ten_is_found(spark):
    import random

    random.seed(5)
    pool = [f"w{i}" for i in range(40)]
    item = [random.choice(pool) for _ in range(30)]
    rows = []
    for i in range(120):
        n = random.choice([9, 10, 11, 15])
        s = random.randrange(30 - n)
        rows.append((i, " ".join([random.choice(pool) for _ in range(20)] + item[s:s + n] + [random.choice(pool) for _ in range(7)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontaminate.find_contamination(docs, benchmark).selectExpr(
        "doc_id", "n_words", "n_hit", "n_items", "array_join(items, ',')", "contaminated")
    assert rows_of(got) == windows_by_hand(rows, [(1, " ".join(item))])


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = [s for s in open_ if target[s] >= 3 * sizes[s]]
        if not over:
            return target
        capped |= set(over)
        if len(capped) == len(names):
            return {s: 3 * sizes[s] for s in names}


def test_mixing_meets_its_targets_and_agrees_with_itself(spark):
    got = cube_mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    sizes, taken, docs, longest = Counter(), Counter(), Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        docs[r.source] += r.copies
        longest[r.source] = max(longest[r.source], r["size"])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
    want = targets_by_hand(sizes)
    n = Counter(r.source for r in got)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * longest[s], s
        assert abs(docs[s] - n[s] * want[s] / sizes[s]) <= 3, s
    again = cube_mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mixing_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(cube_mixing, "BUCKET", 20)
    monkeypatch.setattr(cube_mixing, "FAN", 4)
    docs = spark.range(1000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 17 as int)) as text", "if(id % 3 = 0, 'a', 'b') as source")
    got = cube_mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 17 * 2


def test_mixing_odd_rows(spark):
    docs = documents(spark)
    got = cube_mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(r.taken == 0 for r in got if r["size"] == 0)
    counts = {(r.doc_id, r.text): len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert sorted(counts.values()) == sorted({(r.doc_id, r.t1): r["size"] for r in got}.values())
    assert cube_mixing.mix(empty(spark)).count() == 0


def test_the_flight_keeps_probabilities_and_totals():
    sizes, pi = [(7 * i) % 101 + 1 for i in range(400)], [0.3] * 400
    totals, picked = [], np.zeros(400)
    for seed in range(300):
        drawn = cube_mixing.fly(sizes, pi, str(seed), True)
        assert set(drawn) <= {0.0, 1.0}
        picked += drawn
        totals.append(sum(s * d for s, d in zip(sizes, drawn)))
        assert abs(sum(drawn) - 120) <= 1
    assert max(abs(t - 0.3 * sum(sizes)) for t in totals) <= 101
    assert abs(picked / 300 - 0.3).max() < 0.13


def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = kd_shards.assign_shards(docs, 24).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    size, slots, home = Counter(), defaultdict(list), {}
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(data) + 8 and r.text_crc32 == zlib.crc32(data)
        assert home.setdefault(data, r.shard) == r.shard
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(got) == len(texts) and set(size) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 24
    biggest = max(len(t.encode()) for t in texts.values() if t)
    assert max(size.values()) <= mean + biggest + mean * 0.02 and min(size.values()) >= mean - biggest - mean * 0.02


@pytest.mark.parametrize("hot", [(1 / 3,), (0.3, 0.2, 0.1, 0.06)])
def test_hot_texts_get_shards_of_their_own(spark, hot):
    n = 3000
    rows, at = [], 0
    for k, share in enumerate(hot):
        rows += [(at + i, f"{k}" * 3000) for i in range(int(n * share))]
        at = len(rows)
    rows += [(i, f"{i} ".ljust(3000, "x")) for i in range(at, n)]
    got = kd_shards.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    size, alone = Counter(), {}
    for r in got:
        size[r.shard] += r["size"]
        if r.doc_id < at:
            alone.setdefault(rows[r.doc_id][1], set()).add(r.shard)
    assert len(got) == n and set(size) == set(range(24)) and all(len(s) == 1 for s in alone.values())
    heavy = {s for shards in alone.values() for s in shards}
    others = [b for s, b in size.items() if s not in heavy]
    assert len(heavy) == len(hot) and max(others) <= 1.1 * sum(others) / len(others) and min(others) >= 0.9 * sum(others) / len(others)


def test_shards_of_odd_rows(spark):
    docs = documents(spark)
    got = kd_shards.assign_shards(docs, 5).collect()
    assert len(got) == docs.count() and {r.shard for r in got} <= set(range(5))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert kd_shards.assign_shards(empty(spark), 5).count() == 0
    same = spark.createDataFrame([(i, "same") for i in range(50)], "doc_id long, text string")
    assert {r.shard for r in kd_shards.assign_shards(same, 4).collect()} == {kd_shards.assign_shards(same, 4).first().shard}


def test_pieces_met_again_are_encoded_once(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(seekable_tokens, "MEMO_WORDS", 4)
    memo = seekable_tokens.PieceMemo(public_tokenizers.path("word_bpe_49k.json"))
    calls, ids_of = [], memo.tokenizer.encode
    text = "C3 Straße, ABC. abc x1 C3 ÀÉ ſ ıI K ª C3 word, ...  \t\n 日本 é" * 3
    assert memo.encode(text) == np.array(ids_of(text, add_special_tokens=False).ids, memo.kind).tobytes()

    class Counting:
        def encode(self, piece, add_special_tokens):
            calls.append(piece)
            return ids_of(piece, add_special_tokens=add_special_tokens)

    memo.tokenizer = Counting()
    memo.clear()
    memo.older = {}
    for k in range(40):
        assert memo.encode("C3") and memo.encode(f"n{k}")
    assert calls.count("C3") == 1
