"""Spelling variants: near words by a dictionary of trie-node pairs.

The distinct words are put in order and their trie is numbered: a node is a prefix, and a
word brings the nodes beyond what it shares with the word before it.  Ranges of the order
are numbered by different tasks; the few prefixes that reach across a border of two ranges
are numbered beforehand from the words at the borders.  The reversed words give suffix nodes.

A word then has one pair (prefix node, suffix node) for each position that is skipped and one
for each gap at which a character may be inserted.  Two words that differ in one replaced
character share a skip pair, and a word that lacks one character of another has a gap pair
equal to a skip pair of the longer word; nothing else shares pairs, so the join is exact.
Of a run of equal characters only the first is skipped towards shorter words, so each near
pair meets once.  A pair determines all but one character: its group holds at most one
shorter word and one word per letter (90), whatever the vocabulary.

Null texts have no words; a null id counts as the empty text in the damage rule.  Repeated
rows count again; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.llm.common import LOWER, UPPER, stage
from pitsignal.shipping import ship_by_value

HELD = 500_000  # distinct words a task counts before it passes them on
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _counted(min_chars: int, damage: int):
    """Words and their occurrences; a run that the damage rule picks loses one character."""
    run = re.compile(f"[a-zÀ-ÿ]{{{min_chars},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])
            words.clear()
            return out

        for batch in batches:
            ids = batch.column("id").to_pylist()
            for key, text in zip(ids, batch.column("text").cast(pa.binary())):
                seed = zlib.crc32(f"{key}:".encode())
                for word, n in Counter(run.findall(text.as_py().translate(_LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), seed) if damage else 1
                    if damage and h % damage == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_chars:
                            continue
                    words[word] += n
                if len(words) >= HELD:
                    yield flush()
        if words:
            yield flush()
    return count


def word_counts(docs: DataFrame, min_chars: int, min_count: int, damage: int) -> DataFrame:
    """word, n: lower-cased runs of letters, at least ``min_chars`` long and ``min_count`` times seen."""
    told = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = told.mapInArrow(_counted(min_chars, damage), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    at = 0
    while at < n and a[at] == b[at]:
        at += 1
    return at


def _border_nodes(ends: list[tuple[int, str, str]]) -> tuple[dict[int, tuple[list[int], list[int]]], int]:
    """Nodes of the prefixes that two neighbouring ranges share.

    Returns by range the nodes on the path of its first and of its last word (from the empty
    prefix, node 0, on), and the number of nodes given out.
    """
    nodes: dict[int, tuple[list[int], list[int]]] = {}
    given, path, word = 1, [0], ""
    before = [0]
    for at, (part, _, last) in enumerate(ends):
        after = [0]
        if at + 1 < len(ends):
            border = last[:_shared(last, ends[at + 1][1])]
            keep = _shared(word, border)
            path = path[:keep + 1] + list(range(given, given + len(border) - keep))
            given += len(border) - keep
            word, after = border, path
        nodes[part] = (before, after)
        before = after
    return nodes, given


def _numbered(ends: list[tuple[int, str, str]], keep: list[str]):
    """Number the trie of the sorted column ``key``: its node at every length, and the word's own number."""
    borders, given = _border_nodes(ends)
    edge = {part: (first, last) for part, first, last in ends}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, word, path, counter, rank = None, "", [0], 0, 0
        for batch in batches:
            starts, values, fresh, numbers = [0], [], [], []
            for mine, key in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist()):
                if mine != part:
                    part, word, path, counter, rank = mine, "", [0], 0, 0
                    (first, last), (at_first, at_last) = edge[part], borders[part]
                known = _shared(word, key)
                path = path[:known + 1]
                on_first, on_last = _shared(first, key), _shared(last, key)
                for length in range(known + 1, len(key) + 1):
                    if length <= on_first and length < len(at_first):
                        path.append(at_first[length])
                    elif length <= on_last and length < len(at_last):
                        path.append(at_last[length])
                    else:
                        path.append(given + (part << 40) + counter)
                        counter += 1
                word = key
                values.extend(path)
                fresh.extend([True, *(a != b for a, b in zip(key, key[1:]))])
                starts.append(len(values))
                numbers.append((part << 40) + rank)
                rank += 1
            firsts = pa.array([s - i for i, s in enumerate(starts)], pa.int32())  # a path is one longer than its word
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(numbers, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int64())),
                 pa.ListArray.from_arrays(firsts, pa.array(fresh, pa.bool_()))],
                [*keep, "number", "nodes", "fresh"])
    return number


def trie_nodes(words: DataFrame, key: str) -> DataFrame:
    """``words`` (distinct, not empty) with ``number`` (in the order of ``key``), ``nodes`` (of every prefix of ``key``, by
    length from 0) and ``fresh`` (where a character differs from the one before it)."""
    ranged = words.withColumn("key", F.expr(key)).repartitionByRange("key")
    dealt = stage(ranged.withColumn("part", F.spark_partition_id().cast("long")), "words")
    # One row per range of the shuffle; the tasks get the two border words of each.
    ends = dealt.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy("part").collect()
    keep = words.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return dealt.repartition("part").sortWithinPartitions("part", "key").mapInArrow(
        _numbered([tuple(e) for e in ends], keep), f"{fields}, number long, nodes array<long>, fresh array<boolean>")


# A member of a pair's group: 0 the word itself with a gap, 1 a skipped repeat of the character before, 2 any other skip.
_NEAR = "y.back <> x.back and ((x.kind > 0 and y.kind > 0) or (x.kind = 0 and y.kind = 2) or (x.kind = 2 and y.kind = 0))"


def near_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, word, n) with ids in code-point order, and (id, n_near, best): ``best`` is struct(n, -id)."""
    forward = trie_nodes(words, "word").select("word", "n", F.col("number").alias("id"), F.col("nodes").alias("pre"), "fresh")
    both = stage(trie_nodes(stage(forward, "prefixes").withColumnRenamed("fresh", "new"), "reverse(word)").select(
        "id", "word", "n", "pre", F.col("nodes").alias("suf"), F.col("new").alias("fresh")), "nodes")
    pairs = both.select("id", "n", F.expr(
        "inline(concat(transform(sequence(0, size(pre) - 2), i -> struct(pre[i] as p, suf[size(pre) - 2 - i] as s, "
        "if(fresh[i], 2, 1) as kind)), transform(sequence(0, size(pre) - 1), i -> struct(pre[i] as p, "
        "suf[size(pre) - 1 - i] as s, 0 as kind))))"))
    groups = pairs.groupBy("p", "s").agg(F.sort_array(F.collect_list(F.expr(
        "struct(n, -id as back, kind)")), asc=False).alias("g")).where("size(g) > 1")  # at most 91 members
    met = groups.select(F.expr(
        f"inline(transform(g, x -> struct(-x.back as id, size(filter(g, y -> {_NEAR})) as near, "
        f"get(filter(g, y -> {_NEAR}), 0) as y)))")).where("near > 0")
    best = met.groupBy("id").agg(F.sum("near").cast("long").alias("n_near"), F.max(F.expr("struct(y.n, y.back)")).alias("best"))
    return both.select("id", "word", "n"), best


def spelling_variants(docs: DataFrame, min_chars: int = 6, min_count: int = 5, ratio: int = 5, damage: int = 0) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    The form is the near word of largest ``n`` (ties: the smallest), where that is at least
    ``ratio`` times the word's own; the root ends the chain of forms.  ``damage`` is the
    modulus of the rule that deletes a character of some runs (0: none).
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 at least: chains of forms must end")
    words, near = near_words(stage(word_counts(docs, min_chars, min_count, damage), "counts"))
    known = stage(words.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("best.n") >= ratio * F.col("n"), F.struct((-F.col("best.back")).alias("id"), F.col("best.n").alias("n"))).alias("form")),
        "near")
    # Every step multiplies n by the ratio, so a chain has less than 64 steps: six doublings reach its end.
    links = known.where("form is not null").select("id", F.col("form.id").alias("root"))
    for _ in range(6):
        links = stage(links, "links")
        ahead = links.select(F.col("id").alias("root"), F.col("root").alias("further"))
        if links.join(ahead, "root", "left_semi").isEmpty():
            break
        links = links.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root"))
    names = known.select(F.col("id").alias("form_id"), F.col("word").alias("form_word"))
    roots = known.select(F.col("id").alias("root_id"), F.col("word").alias("root_word"))
    told = known.where("form is not null").join(links, "id").join(names, F.col("form.id") == F.col("form_id")).join(
        roots, F.col("root") == F.col("root_id")).select(
        "word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", F.col("form.n").alias("form_n"))
    return told.unionByName(known.where("form is null").select(
        "word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near",
        F.lit(None).cast("long").alias("form_n")))


ship_by_value(__name__)
