"""Benchmark decontamination by winnowing.

Words are hashed, ``k`` = 5 consecutive hashes make a k-gram, and of the k-grams inside a
window of 10 words the smallest hash is the window's fingerprint.  Equal windows have equal
fingerprints, so joining document and benchmark fingerprints misses no shared window; the
join also compares the window's words, which extends a hit to the whole window exactly.
An item of fewer than 10 words is one window of its own length, with fingerprints of its own.

A bit set over the benchmark's fingerprints (sized by their number, up to a bound)
is tested before a document window leaves its row; beyond that size it lets more windows
through, never fewer.  Documents are read once per window length that the
benchmark has and once for their word counts; no text is shuffled.

A null text has no words; an item without words has no window.  Documents are told apart by
(doc_id, text), so repeated rows get one result each; null ids are values like any other.  The
windows of an item without an id hit words, but the item has no name and is not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.llm.common import ascii_lower, bit_test, join_on, stage, text_key

WINDOW, GRAM = 10, 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DOC = ["doc_id", "t1", "t2"]


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def fingerprints(frame: DataFrame, length: int) -> DataFrame:
    """Add ``prints``: the winnowed fingerprint of every window of ``length`` words.

    ``frame`` has ``words``; a text of fewer words has no window.
    """
    k = min(GRAM, length)
    grams = ", ".join(f"get(hashes, i + {j})" for j in range(k))
    least = ", ".join(f"get(grams, i + {j})" for j in range(length - k + 1))
    least = f"least({least})" if length > k else least
    upto = lambda n: f"if(n_words >= {n}, sequence(0, n_words - {n}), cast(array() as array<int>))"
    return (
        frame.withColumn("hashes", F.expr("transform(words, w -> xxhash64(w))"))
        .withColumn("grams", F.expr(f"transform({upto(k)}, i -> xxhash64({grams}))"))
        .withColumn("prints", F.expr(f"transform({upto(length)}, i -> {least})"))
        .drop("hashes", "grams"))


def _windows(frame: DataFrame, length: int, keep: str, columns: list[str]) -> DataFrame:
    """One row per window whose fingerprint ``h`` passes ``keep``: start, length, fingerprint, words."""
    made = fingerprints(frame, length)
    found = F.expr(
        f"transform(filter(transform(prints, (p, i) -> struct(i as start, p as print)), s -> {keep.format(h='s.print')}), "
        f"s -> struct(s.start as start, s.print as print, array_join(slice(words, s.start + 1, {length}), ' ') as span))")
    return made.select(*columns, F.explode(found).alias("w")).select(
        *columns, "w.start", F.lit(length).alias("length"), "w.print", "w.span")


def benchmark_windows(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (length, print, span, item_id) of the benchmark, staged."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("words")).withColumn(
        "n_words", F.size("words")).where("n_words > 0")
    shorter = items.withColumn("length", F.least(F.lit(WINDOW), "n_words"))
    parts = [_windows(shorter.where(F.col("length") == n), n, "true", ["item_id"]) for n in range(1, WINDOW + 1)]
    frame = parts[0]
    for part in parts[1:]:
        frame = frame.unionByName(part)
    return stage(frame.select("length", "print", "span", "item_id").distinct(), "benchmark")


def shared_windows(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, t1, t2, start, length, span): every document window that the benchmark has, staged."""
    texts = docs.select(F.col(id_col).alias("doc_id"), *text_key(F.col(text_col)), words(F.col(text_col)).alias("words")
                        ).withColumn("n_words", F.size("words"))
    lengths = [r[0] for r in spans.select("length").distinct().collect()]  # ten values at most
    frame = None
    for n in sorted(lengths):
        part = _windows(texts, n, bit_test(spans.where(F.col("length") == n).select("print")), _DOC)
        frame = part if frame is None else frame.unionByName(part)
    if frame is None:
        frame = texts.select(*_DOC, F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("print"),
                             F.lit("").alias("span")).where(F.lit(False))
    known = spans.select("length", "print", "span").distinct()
    return stage(frame.join(known, ["length", "print", "span"]).select(*_DOC, "start", "length", "span").distinct(), "hits")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items (sorted id strings), contaminated; plus the text key."""
    spans = benchmark_windows(benchmark, id_col=item_id_col, text_col=item_text_col)
    hits = shared_windows(docs, spans, id_col=id_col, text_col=text_col)
    in_order = Window.partitionBy(*_DOC).orderBy("start")
    before = F.max(F.col("start") + F.col("length")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    reach = F.col("start") + F.col("length")
    covered = hits.select(*_DOC, F.greatest(F.lit(0), reach - F.greatest(F.coalesce(before, F.lit(0)), "start")).alias("new"))
    hit_words = covered.groupBy(*_DOC).agg(F.sum("new").cast("long").alias("n_hit"))
    items = hits.select(*_DOC, "length", "span").distinct().join(spans, ["length", "span"]).select(
        *_DOC, F.col("item_id").cast("string").alias("item")).distinct()
    named = items.groupBy(*_DOC).agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = join_on(hit_words, named, _DOC, "left")
    every = docs.select(F.col(id_col).alias("doc_id"), *text_key(F.col(text_col)),
                        F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    return join_on(every, found, _DOC, "left").select(
        *_DOC, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))

