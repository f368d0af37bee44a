"""Shards of near-equal bytes by k-d tree partitioning over document metadata.

Equal texts form one group and stay together.  A group has three metadata dimensions: bytes
of its text, smallest doc_id, number of copies.  A node that stands for n shards is cut along
its widest dimension (range relative to the whole table) at the weighted quantile that gives
the left child ``n // 2`` shards' share of the bytes; the quantile is found by radix
histograms of 2,048 bins that are summed map-side, at most six small passes a level, so no
node is ever sorted or gathered.  The tree itself has ``shards - 1`` inner nodes and is
applied as one expression.

``slot`` numbers the rows of a shard from 0 in (doc_id, text key) order; a shard is cut into
ranges for that, with offsets from the ranges' counts.

A null text has no bytes and is the group of the empty text; a null doc_id sorts first; repeated
rows get slots of their own.  A group above an even share
cannot be cut: it gets a shard of its own before the tree is grown over the other groups and
shards (at most ``shards - 1`` groups can be so heavy).  Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.llm.common import number_rows, stage, text_key

ROW_BYTES = 8  # what a row costs besides its text
_DIMENSIONS = ("bytes", "first_id", "copies")
_SCALE = (1 << 31) - 1
_BINS = 2_048
_CLOSE = 1_000  # a cut may miss its target by this part of it, where bins are still coarse


def _with_keys(groups: DataFrame) -> DataFrame:
    """A 63-bit key per dimension: 31 bits of the place in the table's range, 32 bits of hash for ties."""
    ends = groups.agg(*(f(F.col(d)).cast("double").alias(f"{n}_{d}") for d in _DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max)))).first()

    def key(d: str) -> str:
        low, high = ends[f"lo_{d}"], ends[f"hi_{d}"]
        place = f"cast(({d} - {low!r}D) / {high - low!r}D * {_SCALE}D as bigint)" if low is not None and high > low else "0L"
        return f"shiftleft({place}, 32) | (xxhash64(t1, t2) & 4294967295L) as key_{d}"

    return groups.selectExpr("t1", "t2", "weight", *map(key, _DIMENSIONS))


def _quantiles(placed: DataFrame, cuts: dict[int, tuple[str, float, int, int]]) -> dict[int, int]:
    """For each node the key at which its running weight comes nearest to the target.

    ``cuts`` maps a node to (key column, target weight, least key, greatest key).  Each pass
    sums the weights of 2,048 equal bins between the ends and goes on inside one bin.
    """
    out, open_nodes = {}, {n: [target, lo, hi] for n, (_, target, lo, hi) in cuts.items()}
    while open_nodes:
        pick = lambda values: "case node " + " ".join(f"when {n} then {values(n)}" for n in sorted(open_nodes)) + " end"  # noqa: B023, E731
        width = {n: max(1, -(-(hi - lo + 1) // _BINS)) for n, (_, lo, hi) in open_nodes.items()}
        inside = (
            placed.where(F.col("node").isin(sorted(open_nodes)))
            .selectExpr("node", "weight", f"{pick(lambda n: cuts[n][0])} as k", f"{pick(lambda n: f'{open_nodes[n][1]}L')} as lo",
                        f"{pick(lambda n: f'{open_nodes[n][2]}L')} as hi", f"{pick(lambda n: f'{width[n]}L')} as width")
            .where("k between lo and hi"))
        bins: dict[int, list] = {n: [] for n in open_nodes}
        for r in inside.groupBy("node", F.expr("(k - lo) div width").alias("bin")).agg(F.sum("weight").alias("weight")).collect():
            bins[r["node"]].append((r["bin"], r["weight"]))  # at most 2,048 a node
        for n, rows in bins.items():
            (target, lo, hi), run = open_nodes[n], 0
            for at, (b, weight) in enumerate(sorted(rows)):
                if run + weight >= target or at + 1 == len(rows):
                    break
                run += weight
            below, above = target - run, run + weight - target
            start = lo + b * width[n]
            if width[n] == 1 or min(below, above) * _CLOSE <= cuts[n][1]:
                out[n] = start + width[n] - 1 if above <= below else start - 1
                del open_nodes[n]
            else:
                open_nodes[n] = [below, start, min(hi, start + width[n] - 1)]
    return out


def grow_tree(groups: DataFrame, shards: int) -> str:
    """The expression over the key columns that gives a group its shard."""
    nodes = {1: (0, shards)}  # node -> (first shard, number of shards)
    split: dict[int, tuple[str, int]] = {}

    def expression(node: int, leaf) -> str:
        if node in split:
            key, cut = split[node]
            return f"if({key} <= {cut}L, {expression(2 * node, leaf)}, {expression(2 * node + 1, leaf)})"
        return str(leaf(node))

    whole: dict[str, int] = {}
    to_cut = [1] if shards > 1 else []
    while to_cut:
        placed = groups.selectExpr("*", f"{expression(1, lambda v: v)} as node")
        stats = {r["node"]: r for r in placed.where(F.col("node").isin(to_cut)).groupBy("node").agg(
            *(f(F.col(f"key_{d}")).alias(f"{n}_{d}") for d in _DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))),
            F.sum("weight").alias("weight")).collect()}
        cuts, following = {}, []
        for v in to_cut:
            first, n = nodes[v]
            nodes[2 * v], nodes[2 * v + 1] = (first, n // 2), (first + n // 2, n - n // 2)
            following += [c for c in (2 * v, 2 * v + 1) if nodes[c][1] > 1 and v in stats]
            if v not in stats:
                continue  # an empty node stays a leaf
            s = stats[v]
            # Whole places only, so that dimensions without spread never win by their ties.
            spread = {d: (s[f"hi_{d}"] >> 32) - (s[f"lo_{d}"] >> 32) for d in _DIMENSIONS}
            whole = whole or spread
            widest = max(_DIMENSIONS, key=lambda d: spread[d] / max(1, whole[d]))
            cuts[v] = (f"key_{widest}", s["weight"] * (n // 2) / n, s[f"lo_{widest}"], s[f"hi_{widest}"])
        for v, cut in _quantiles(placed, cuts).items():
            split[v] = (cuts[v][0], cut)
        to_cut = following
    return expression(1, lambda v: nodes[v][0])


def _alone(groups: DataFrame, shards: int) -> tuple[list[tuple[int, int]], DataFrame, int]:
    """Groups above an even share of what is left get a shard each: their keys, the other groups, the shards for those."""
    rest = groups.agg(F.sum("weight")).first()[0] or 0
    left, heavy = shards, []
    for g in groups.orderBy(F.desc("weight"), "t1", "t2").limit(shards - 1).collect():
        if g["weight"] * left <= rest:
            break
        heavy.append((g["t1"], g["t2"]))
        rest, left = rest - g["weight"], left - 1
    others = groups
    for t1, t2 in heavy:
        others = others.where((F.col("t1") != t1) | (F.col("t2") != t2))
    return heavy, others, left


def assign_shards(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, t1, t2, size, text_crc32, shard, slot), one per input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), *text_key(text), F.octet_length(text).cast("long").alias("bytes"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = stage(rows, "sizes")
    groups = stage(_with_keys(rows.groupBy("t1", "t2").agg(
        F.first("bytes").alias("bytes"), F.coalesce(F.min("doc_id"), F.lit(0)).alias("first_id"), F.count(F.lit(1)).alias("copies"),
        F.sum(F.col("bytes") + ROW_BYTES).alias("weight"))), "groups")
    heavy, others, left = _alone(groups, shards)
    placed = others.selectExpr("t1", "t2", f"cast({grow_tree(others, left)} as int) as shard")
    if heavy:
        whens = " ".join(f"when t1 = {t1}L and t2 = {t2}L then {left + at}" for at, (t1, t2) in enumerate(heavy))
        placed = placed.unionByName(groups.selectExpr("t1", "t2", f"case {whens} end as shard").where("shard is not null"))
    located = rows.join(placed, ["t1", "t2"])
    numbered = number_rows(located, ["shard"], [F.col("doc_id"), F.col("t1"), F.col("t2")], "slot")
    return numbered.select("doc_id", "t1", "t2", (F.col("bytes") + ROW_BYTES).alias("size"), "text_crc32", "shard", "slot")
