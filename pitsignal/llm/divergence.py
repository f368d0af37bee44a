"""Which terms set a source apart from its language, and how far sources lie from each other.

Single-pass in-memory indexing: a task builds the postings of a block of documents (term to
sources and counts, and the number of documents) until ``BLOCK`` entries are held, then
spills the block as a run sorted by language and term.  A run is cut by a hash of its terms
into shards and by ``CHUNK`` terms into rows; Spark shuffles the rows by shard and sorts them
by first term, and one task per shard merges the open chunks of all runs with a heap.  A
chunk is closed before the next one of its run is needed, so a task holds one chunk a run.

A pair of sources is compared over all kept terms without visiting the terms that neither
has: the sum of a source's terms against the other's smoothed zero, both ways, and for terms
that both have a correction, which is streamed over the merged frequencies and summed in
tiles of about ``TILE`` meetings of two sources.

Null text, language and source are the empty string.  Rows that repeat count as often as they
occur; every row is a document.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.llm.common import pack, stage, unpack
from pitsignal.shipping import ship_by_value

BLOCK, CHUNK, TILE = 600_000, 512, 1_000_000
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 97 and b <= 122 or b >= 128 else 32 for b in range(256))
_RUN = "shard int, lang string, first binary, data binary"


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_LETTERS).split()


def _spill(block: dict[str, tuple[Counter, dict[str, Counter]]], shards: int) -> Iterator[pa.RecordBatch]:
    """The run of a block: rows of at most ``CHUNK`` terms, sorted by language and term.

    A row packs the terms, their documents, the length of their postings, and the postings as
    source numbers and counts.
    """
    for lang, (docs, by_source) in sorted(block.items()):
        home, names = zlib.crc32(lang.encode()), list(by_source)
        parts: list[list[bytes]] = [[] for _ in range(shards)]
        for term in docs:
            parts[zlib.crc32(term, home) % shards].append(term)
        placed = [term for part in parts for term in sorted(part)]
        find = dict(zip(placed, range(len(placed)))).__getitem__
        place = np.concatenate([np.fromiter(map(find, c), np.int64, len(c)) for c in by_source.values()])
        counts = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in by_source.values()])
        codes = np.repeat(np.arange(len(names)), [len(c) for c in by_source.values()])
        order = np.argsort(place, kind="stable")
        counts, codes = counts[order], codes[order]
        lengths = np.bincount(place, minlength=len(placed))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        stops = np.cumsum([len(part) for part in parts]).tolist()
        spans = [(shard, at, min(at + CHUNK, stop)) for shard, (part, stop) in enumerate(zip(parts, stops))
                 for at in range(stop - len(part), stop, CHUNK)]
        rows = []
        for shard, a, b in spans:
            of = slice(ends[a], ends[b])
            some, code = np.unique(codes[of], return_inverse=True)
            terms = placed[a:b]
            rows.append((shard, lang, terms[0], pack(
                b"\n".join(terms), np.fromiter(map(docs.__getitem__, terms), np.int64, b - a), lengths[a:b],
                [names[i] for i in some], code.astype(np.int32), counts[of])))
            if len(rows) == 64 or b == len(placed):
                kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["shard", "lang", "first", "data"])
                rows = []


def _runs(shards: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[str, tuple[Counter, dict[str, Counter]]] = {}
        held = 0
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, batch.column("text").cast(pa.binary())):
                words = terms_of(text.as_py())
                docs, by_source = block.setdefault(lang, (Counter(), {}))
                mine = by_source.setdefault(source, Counter())
                held -= len(docs) + len(mine)
                docs.update(set(words))
                mine.update(words)
                held += len(docs) + len(mine)
                if held >= BLOCK:
                    yield from _spill(block, shards)
                    block, held = {}, 0
        yield from _spill(block, shards)
    return build


class _Chunk:
    """A row of a run and the entry it has come to."""

    __slots__ = ("terms", "docs", "ends", "names", "codes", "counts", "at")

    def __init__(self, data: bytes):
        terms, docs, lengths, self.names, codes, counts = unpack(data)
        self.terms, self.docs, self.ends = terms.split(b"\n"), docs.tolist(), [0, *np.cumsum(lengths).tolist()]
        self.codes, self.counts, self.at = codes.tolist(), counts.tolist(), 0


def _merged(rows: Iterator[tuple[bytes, bytes]]) -> Iterator[tuple[bytes, int, dict[str, int]]]:
    """Terms in order with their documents and counts by source, from the rows (first term, chunk) in order of first terms."""
    heap: list[tuple[bytes, int, _Chunk]] = []
    row, number = next(rows, None), 0
    while heap or row:
        term = heap[0][0] if heap and (not row or heap[0][0] <= row[0]) else row[0]
        while row and row[0] == term:
            chunk = _Chunk(row[1])
            heapq.heappush(heap, (term, number, chunk))
            row, number = next(rows, None), number + 1
        docs, sources = 0, {}
        while heap and heap[0][0] == term:
            _, n, chunk = heap[0]
            at = chunk.at
            docs += chunk.docs[at]
            for k in range(chunk.ends[at], chunk.ends[at + 1]):
                name = chunk.names[chunk.codes[k]]
                sources[name] = sources.get(name, 0) + chunk.counts[k]
            at = chunk.at = at + 1
            if at < len(chunk.terms):
                heapq.heapreplace(heap, (chunk.terms[at], n, chunk))
            else:
                heapq.heappop(heap)
        yield term, docs, sources


def _frequencies(min_docs: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(c[at].as_py() for c in batch.columns) for batch in batches for at in range(batch.num_rows))
        for (_, lang), group in groupby(rows, lambda r: r[:2]):
            out: list[tuple[bytes, dict[str, int]]] = []
            for term, docs, sources in _merged(r[2:] for r in group):
                if docs >= min_docs:
                    out.append((term, sources))
                    if len(out) >= 4_000:
                        yield _kept(lang, out)
                        out = []
            if out:
                yield _kept(lang, out)
    return merge


def _kept(lang: str, out: list[tuple[bytes, dict[str, int]]]) -> pa.RecordBatch:
    return pa.record_batch([
        pa.array([lang] * len(out), pa.string()), pa.array([t for t, _ in out], pa.binary()).cast(pa.string()),
        pa.array([list(s) for _, s in out], pa.list_(pa.string())), pa.array([list(s.values()) for _, s in out], pa.list_(pa.int64()))],
        ["lang", "term", "sources", "counts"])


def term_frequencies(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, sources, counts of the terms in at least ``min_docs`` documents of their language."""
    spark = docs.sparkSession
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    runs = docs.select(*blank).mapInArrow(_runs(shards), _RUN)
    shuffled = runs.repartition(shards, "shard").sortWithinPartitions("shard", "lang", "first")
    return shuffled.mapInArrow(_frequencies(min_docs), "lang string, term string, sources array<string>, counts array<long>")


def _share(count: Column, total: Column, terms: Column, scale: int) -> Column:
    """1 + floor(scale * (count + 1) / (total + terms)), exactly; null where there are no terms."""
    whole = (count + 1).cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.when(terms > 0, 1 + F.call_function("div", whole, (total + terms).cast("decimal(19,0)")))


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each length, one after another."""
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(int(lengths.sum()))


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms of two sources add to the sums that take the other source's count as zero.

    Rows come in order of (lang, term).  A term's sources meet each other, at most about
    ``TILE`` meetings at a time; the sums of a tile are all that is kept of them.
    """
    def tiles(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lang, term = rows.column("lang"), rows.column("term")
        new = np.ones(rows.num_rows, bool)
        new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        size = np.diff(np.append(starts, rows.num_rows))[of]
        langs, sources = lang.dictionary_encode(), rows.column("source").dictionary_encode()
        n = len(sources.dictionary)
        codes = np.asarray(langs.indices).astype(np.int64) * n + np.asarray(sources.indices)
        p, zero = np.asarray(rows.column("p")), np.asarray(rows.column("zero"))
        ends = np.cumsum(size)
        at = 0
        while at < rows.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TILE, "right")))
            left = np.repeat(np.arange(at, stop), size[at:stop])
            right = _ragged(starts[of[at:stop]], size[at:stop])
            some = left != right
            left, right = left[some], right[some]
            pair = codes[left] * n + codes[right] % n
            value = _gaps(p[left], p[right]) - _gaps(p[left], zero[right]) - _gaps(zero[left], p[right]) + _gaps(zero[left], zero[right])
            order = np.argsort(pair)
            first = np.flatnonzero(np.diff(pair[order], prepend=-1))
            if len(first):
                group, item = np.divmod(pair[order][first], n)
                where, source = np.divmod(group, n)
                yield pa.record_batch([langs.dictionary.take(pa.array(where)), sources.dictionary.take(pa.array(source)),
                                       sources.dictionary.take(pa.array(item)), pa.array(np.add.reduceat(value[order], first))],
                                      ["lang", "source", "item", "value"])
            at = stop

    rest = None
    for batch in batches:
        rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        last = pc.and_(pc.equal(rows.column("lang"), rows.column("lang")[-1]),
                       pc.equal(rows.column("term"), rows.column("term")[-1])).to_numpy(zero_copy_only=False) if rows.num_rows else []
        whole = int(np.argmax(last)) if len(last) else 0
        if whole:
            yield from tiles(rows.slice(0, whole))
        rest = rows.slice(whole)
    if rest is not None and rest.num_rows:
        yield from tiles(rest)


def divergence(docs: DataFrame, min_docs: int = 3, scale: int = 1_000_000_000, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: the audit of every (language, source) group.

    p is a share of ``scale``, smoothed by one occurrence a kept term; the value of p against
    q is floor((p - q)^2 / q).  ``pair`` rows compare the group with every other source of the
    language over all kept terms, ``term`` rows name its ``top`` terms above the language's share.
    """
    found = stage(term_frequencies(docs, min_docs), "frequencies")
    summed = found.withColumn("total", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    langs = summed.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    counts = summed.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select(
        "lang", "term", "total", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("count").alias("source_total"), F.count("*").alias("has"))
    zero = F.lit(0).cast("long")
    groups = stage(
        docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
        .join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("source_total", "has", "terms", "lang_total")))
        .withColumn("zero", _share(zero, F.col("source_total"), F.col("terms"), scale)), "groups")
    shares = stage(
        counts.join(groups, ["lang", "source"]).select(
            "lang", "term", "source", "zero",
            _share(F.col("count"), F.col("source_total"), F.col("terms"), scale).alias("p"),
            _share(F.col("total"), F.col("lang_total"), F.col("terms"), scale).alias("q")), "shares")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    exact = "decimal(38,0)"
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"), F.col("has").alias("other_has"))
    spread = shares.groupBy("lang", "source", "zero", "p").count()
    meets = spread.join(other, "lang").where("source <> item")
    n = F.col("count").cast("decimal(19,0)")
    own = meets.select("lang", "source", "item", (n * _gap(F.col("p"), F.col("other_zero"))).cast(exact).alias("value"))
    theirs = meets.select("lang", F.col("item").alias("source"), F.col("source").alias("item"),
                          (n * _gap(F.col("other_zero"), F.col("p"))).cast(exact).alias("value"))
    pairs = groups.join(other, "lang").where("source <> item")
    neither = pairs.select("lang", "source", "item", F.coalesce(
        (F.col("terms") - F.col("has") - F.col("other_has")).cast("decimal(19,0)") * _gap(F.col("zero"), F.col("other_zero")),
        F.lit(0)).cast(exact).alias("value"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = shares.select("lang", "term", "source", "p", "zero").repartition(parts, "lang", "term").sortWithinPartitions("lang", "term")
    shared = ordered.mapInArrow(_corrections, "lang string, source string, item string, value long").where("source <> item")
    value = own.unionByName(theirs).unionByName(neither).unionByName(
        shared.withColumn("value", F.col("value").cast(exact))).groupBy("lang", "source", "item").agg(
        F.sum("value").cast("long").alias("value"))
    near = value.withColumn("rank", F.row_number().over(best))
    return near.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(
        terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


ship_by_value(__name__)
