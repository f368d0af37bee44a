"""Repeated lines across documents, found by range-partitioned line hashes.

Every line becomes one small row (two 64-bit hashes of its key, document, position).  The
rows are range-partitioned by hash and document and sorted by (hash, document, position),
so first occurrences are flagged in one streaming pass and a line that a third of all
documents share is spread over many ranges.  What comes back is a sparse keep bitmap per
document, not text: only 64-line words that lose a line are stored.

A document is a (doc_id, text) pair, so exact repeats of a row are one document; a null
doc_id is a value like any other.  A null or empty text is one empty line.  Columns other
than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.llm.common import ascii_lower, join_on, stage, text_key

BLANKS = " \t\n\x0b\x0c\r"
_KEY = ["h1", "h2"]
_DOC = ["doc_id", "t1", "t2"]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), *text_key(F.col(text_col)),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_occurrences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """One row per line with a key of at least ``min_chars``: hashes, document, position.

    ``first`` marks the first occurrence of the key in its document.  The table is staged
    in hash order.
    """
    lines = _documents(docs, id_col, text_col).select(*_DOC, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    hashed = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= max(min_chars, 0)).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), *_DOC, "pos")
    dealt = hashed.repartitionByRange(*_KEY, *_DOC).sortWithinPartitions(*_KEY, *_DOC, "pos")
    in_document = Window.partitionBy(*_KEY, *_DOC).orderBy("pos")
    return stage(dealt.withColumn("first", F.row_number().over(in_document) == 1), "lines")


def keep_bitmaps(occurrences: DataFrame, *, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """Sparse keep bitmaps of the documents that lose lines.

    Keys found in at least ``min_docs`` documents lose their lines; with ``keep_first`` the
    first document (smallest id) keeps its first occurrence.  ``keep`` lists
    (word, bits): bit ``i`` of word ``w`` stands for line ``64 w + i``; words not listed
    keep all lines.
    """
    common = occurrences.where("first").groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*_DOC, "pos")).alias("earliest")).where(F.col("n") >= min_docs)
    lost = occurrences.join(common.select(*_KEY, "earliest"), _KEY)
    if keep_first:
        lost = lost.where(~F.struct(*_DOC, "pos").eqNullSafe(F.col("earliest")))
    words = lost.groupBy(*_DOC, F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    return words.groupBy(*_DOC).agg(
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep"))


def kept_texts(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the text of the lines that stay, one row per input row."""
    joined = join_on(_documents(docs, id_col, text_col), bitmaps, _DOC, "left").select(
        "doc_id", "text", F.map_from_entries("keep").alias("keep"))
    lines = joined.withColumn("lines", F.split("text", "\n", -1))
    stays = "filter(lines, (x, i) -> getbit(coalesce(try_element_at(keep, cast(i div 64 as int)), -1L), cast(i % 64 as int)) = 1)"
    kept = lines.withColumn("stay", F.expr(f"if(keep is null, lines, {stays})"))
    return kept.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join("stay", "\n")).alias("kept"))


def drop_common_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """The operator: each document without the lines that ``min_docs`` documents share."""
    occurrences = line_occurrences(docs, min_chars=min_chars)
    return kept_texts(docs, keep_bitmaps(occurrences, min_docs=min_docs, keep_first=keep_first))
