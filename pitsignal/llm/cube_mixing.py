"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size is how often each of its documents is taken: the whole part
for every document, the fraction as inclusion probability of one more copy.  The cube method
draws that extra copy so that per source both the sampled words and the number of sampled
documents stay at their expectation: three undecided documents at a time are moved along
the null space of (size, 1) until one of them is decided.  The flight of a source runs in
buckets of about ``BUCKET`` documents that leave at most two undecided; what is left of up
to ``FAN`` buckets meets in the next round, until one landing per source remains, where the
document total is let go first.  A hot source is thus many groups, and a draw depends only
on the rows, the seed and the bucket, so reruns agree.

Null sources are one source, last in order; null or blank texts have size 0 and are never
taken; repeated rows are documents of their own; an empty table gives no rows.  Columns other
than id, source and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitsignal.llm.common import join_on, number_rows, stage, text_key
from pitsignal.shipping import ship_by_value

WEIGHTS = (5, 2, 1)
BUCKET, FAN = 20_000, 8_192
_ROW = "doc_id long, source string, size long, t1 long, bucket long, buckets long, pi double"


def word_count(text: Column) -> Column:
    """Number of runs of other characters than blank, tab, new line, \\x0B, \\x0C and \\r."""
    plain = F.btrim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, " +"))).cast("long")


def source_targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, *, share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """source, source_size, source_docs, target: shares of all sizes, filled up to the caps.

    The level of the fill is found from two sums a round over the table of sources.
    """
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    ranked = number_rows(totals, [], [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    sources = stage(ranked.select("source", "source_size", "source_docs", weight.alias("weight"),
                                  (F.col("source_size") * max_repeat).alias("cap")), "sources")
    sums = sources.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("weight")).first()
    total, level, capped = share * (sums["all"] or 0), 0.0, -1
    if total and sums["weight"]:
        level = total / sums["weight"]
        while True:
            full = F.col("weight") * F.lit(level) >= F.col("cap")
            at = sources.agg(F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("weight"),
                             F.count_if(full).alias("n")).first()
            if at["n"] == capped or not at["weight"]:
                break
            capped = at["n"]
            level = (total - (at["cap"] or 0)) / at["weight"]
    return sources.select("source", "source_size", "source_docs",
                          F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double")).alias("target"))


def fly(sizes: list[int], pi: list[float], seed: str, land: bool) -> list[float]:
    """Inclusion probabilities moved to 0 or 1; without ``land`` up to two stay between."""
    import random

    draw, eps = random.Random(seed).random, 1e-9
    pi = [0.0 if p < eps else 1.0 if p > 1 - eps else p for p in pi]

    def move(held: list[int], u: list[float]) -> None:
        up = down = float("inf")
        for k, x in zip(held, u):
            if x:
                a, b = (1 - pi[k]) / abs(x), pi[k] / abs(x)
                up, down = min(up, a if x > 0 else b), min(down, b if x > 0 else a)
        step = up if draw() * (up + down) < down else -down
        for k, x in zip(held, u):
            p = pi[k] + step * x
            pi[k] = 0.0 if p < eps else 1.0 if p > 1 - eps else p

    held: list[int] = []
    for k, p in enumerate(pi):
        if not 0 < p < 1:
            continue
        held.append(k)
        if len(held) == 3:
            a, b, c = (float(sizes[i]) for i in held)
            u = [b - c, c - a, a - b]
            top = max(map(abs, u))
            move(held, [x / top for x in u] if top else [1.0, -1.0, 0.0])
            held = [i for i in held if 0 < pi[i] < 1]
    if land:
        if len(held) == 2:
            a, b = (float(sizes[i]) for i in held)
            top = max(a, b)
            move(held, [b / top, -a / top] if a and b else [1.0, 0.0] if not a else [0.0, 1.0])
            held = [i for i in held if 0 < pi[i] < 1]
        for k in held:
            move([k], [1.0])
    return pi


def balanced_sample(rows: DataFrame, seed: str = "mix") -> DataFrame:
    """``rows`` (doc_id, source, size, t1, bucket, buckets, pi) with ``pi`` decided to 0 or 1."""

    def flight(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "t1", "size"], kind="stable", na_position="first", ignore_index=True)
        one = group.iloc[0]
        group["pi"] = fly(group["size"].tolist(), group["pi"].tolist(),
                          f"{seed}|{one['source']}|{one['bucket']}|{one['buckets']}", one["buckets"] == 1)
        return group

    most = rows.agg(F.max("buckets")).first()[0] or 1
    decided, open_rows = None, rows
    while True:
        flown = stage(open_rows.groupBy("source", "bucket").applyInPandas(flight, _ROW), "flight")
        done = flown if most == 1 else flown.where("pi = 0 or pi = 1")
        decided = done if decided is None else decided.unionByName(done)
        if most == 1:
            return decided
        open_rows = flown.where("pi > 0 and pi < 1").withColumns({
            "bucket": F.expr(f"bucket div {FAN}"), "buckets": F.expr(f"(buckets + {FAN - 1}) div {FAN}")})
        most = -(-most // FAN)


def mix(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, share: float = 1.0, max_repeat: int = 3, seed: str = "mix",
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, t1, size, source, source_size, target, copies (0 to ``max_repeat``), taken."""
    rows = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"),
                             word_count(F.col(text_col)).alias("size"), text_key(F.col(text_col))[0]), "sizes")
    targets = source_targets(rows, weights, share=share, max_repeat=max_repeat)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.round(ratio)
    whole = F.when(F.abs(ratio - near) < 1e-9, near).otherwise(F.floor(ratio)).cast("long")
    buckets = F.ceil(F.col("source_docs") / BUCKET)
    targets = stage(targets.select("*", whole.alias("whole"), F.greatest(F.lit(0.0), ratio - whole).alias("pi"),
                                   buckets.cast("long").alias("buckets")), "targets")
    of_source = targets.select("source", "buckets", "pi")
    drawn = join_on(rows, of_source, ["source"]).select(
        "doc_id", "source", "size", "t1", F.pmod(F.xxhash64("doc_id", "t1"), "buckets").alias("bucket"), "buckets", "pi")
    sampled = balanced_sample(drawn, seed).select("doc_id", "source", "size", "t1", F.col("pi").cast("long").alias("extra"))
    known = targets.select("source", "source_size", "target", "whole")
    copies = F.col("whole") + F.col("extra")
    return join_on(sampled, known, ["source"]).select(
        "doc_id", "t1", "size", "source", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


ship_by_value(__name__)
