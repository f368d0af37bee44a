"""Exact Jaccard self-join of documents on word shingles, and its connected components.

A document is the set of its distinct ``width``-word shingles; equal sets form one class and
only classes are compared.  The universe of shingles is hashed into ``m`` segments, where
``m`` follows from the size band: two linked sets of a band differ in at most ``H``
shingles, so of any ``H + 1`` segments at least one is equal in both.  A set indexes a subset of
its segments, the fullest ``H + 1`` and their ties, as sparse segments match by chance; of
two sets the stricter subset alone holds an equal segment, and that segment is in the other's
subset too.  Bands of small sets, whose segments are nearly empty, index half as many
segments with all one-deletion neighbours instead (a segment with at most one difference
exists there); the cheaper of the two is chosen per band by the expected number of rows and chance matches.

Members of a group (equal segment) meet as rows, not as pairs: groups of up to ``FULL`` sets are
told apart by their members, so a pair that shares fifty segments meets once, and larger
ones are cut into blocks.  There each set's profile (one
xor-ed byte per part of a finer partition; every differing shingle changes one byte at
most) refutes nearly all pairs that are no links.  A first round emits a spanning forest of
the rest, in large groups of each block with a few hubs of the whole group; it is verified exactly on the
shingles of the whole texts and merged into components.  A second round emits every remaining pair
across components and verifies it too: the blocks of a large group's largest component meet the blocks
of its other members, and these meet each other.  So no link
between components is lost and no family of near copies is expanded into all its pairs or blocks.

Links with 100 * |A and B| >= ``percent`` * |A or B| are found.  A text without words is empty and linked
with nothing; null ids and repeated rows are allowed (equal sets are one class).  Shingles
are 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.llm.common import among, discard, join_on, number_rows, small_batches, stage, worker_store
from pitsignal.shipping import ship_by_value

GROWTH = 1.5  # upper end of a size band over its lower end
SLACK = 1.15  # segments over the number that must be indexed
SMALL = 48  # sets above this size always index whole segments
FULL = 48  # groups up to this size are paired completely
BLOCK = 512  # larger groups are compared block by block
HUBS = 16  # members, about, of a larger group that meet all of its blocks in the first round
MEMO, _MASK = 200_000, (1 << 64) - 1
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63,
        0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D)


class WordHashes(dict):
    """64-bit hashes of words; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a public 64-bit mixing function."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, width: int, memo: dict) -> np.ndarray:
    """Sorted distinct shingle hashes: words are lower-cased in A-Z and cut at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total = mix(total * np.uint64(_ODD[i % 8]) + h[i:len(h) - k + 1 + i])
    return np.unique(total)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


@lru_cache(maxsize=None)
def band_plan(band: int, percent: int) -> tuple[int, int, int, bool]:
    """(lower end, H, segments, one-deletion?) of a size band; the ends are powers of GROWTH."""
    low = int(np.ceil(GROWTH ** band))
    high = int(np.ceil(GROWTH ** (band + 1))) - 1
    # |A xor B| <= (|A| + |B|) (1 - j) / (1 + j) with j = percent / 100.
    differ = 2 * high * (100 - percent) // (100 + percent)
    whole, half = int(np.ceil((differ + 1) * SLACK)) if differ else 1, differ // 2 + 1
    typical = (low + high) / 2
    chance = lambda elements: 1e4 * 0.4 ** elements
    cost_whole = (differ + 1) * (1 + chance(typical / (differ + 1)))
    cost_half = (typical + half) * (1 + chance(typical / half - 1))
    if high <= SMALL and cost_half < cost_whole:
        return low, differ, half, True
    return low, differ, whole, False


def bands_of(size: int, percent: int) -> list[int]:
    """The set's own band, and the next one if a linked set may be that large."""
    own = 0
    while int(np.ceil(GROWTH ** (own + 1))) - 1 < size:
        own += 1
    nxt = int(np.ceil(GROWTH ** (own + 1)))
    return [own, own + 1] if 100 * size >= percent * nxt else [own]


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """The indexed segments of a set, as 64-bit values."""
    out = []
    for band in bands_of(len(s), percent):
        _, differ, m, deletion = band_plan(band, percent)
        x = mix(s + np.uint64(band * 2 + 1))
        segment = (x % np.uint64(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        counts = np.bincount(segment, minlength=m)
        value = mix(x ^ np.uint64(0xD6E8FEB86659FD93))[order]
        filled = np.flatnonzero(counts)
        sums = np.zeros(m, np.uint64)
        sums[filled] = np.add.reduceat(value, np.concatenate([[0], np.cumsum(counts[filled])[:-1]]))
        tag = (np.arange(m, dtype=np.uint64) + np.uint64(1)) * np.uint64(_ODD[0]) + np.uint64(band * _ODD[1] & _MASK)
        if deletion:
            out.append(mix(mix(sums + tag) + counts.astype(np.uint64)))
            at = segment[order]
            out.append(mix(mix(sums[at] - value + tag[at]) + (counts[at] - 1).astype(np.uint64)))
        else:
            least = np.sort(counts)[::-1][min(differ, m - 1)]
            keep = np.flatnonzero(counts >= least)
            out.append(mix(mix(sums[keep] + tag[keep]) + counts[keep].astype(np.uint64)))
    return np.unique(np.concatenate(out))


def profile(s: np.ndarray) -> bytes:
    """A byte per part of a power-of-two partition with one to two shingles a part."""
    parts = 1 << max(3, (len(s) - 1).bit_length() - 1)
    x = mix(s ^ np.uint64(0xA24BAED4963EE407))
    at = (x % np.uint64(parts)).astype(np.int64)
    out = np.zeros(parts, np.uint8)
    np.bitwise_xor.at(out, at, (x >> np.uint64(56)).astype(np.uint8))
    return out.tobytes()


class Forest:
    """Union by smallest element."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def likely_pairs(members: list[tuple[int, int, bytes, int, int]], percent: int, spanning: bool) -> list[tuple[int, int]]:
    """Pairs of a group that their sizes and profiles do not refute.

    ``members``: (cid, size, profile, component, side); pairs are across sides where both
    sides occur (-1: no side), and never inside a component.  ``spanning`` leaves out pairs
    that others of the group connect already.
    """
    members = sorted({m[0]: m for m in members}.values(), key=lambda m: (m[1], m[0]))
    ids, sizes = np.array([m[0] for m in members]), np.array([m[1] for m in members])
    component, side = np.array([m[3] for m in members]), np.array([m[4] for m in members])
    exact = [np.frombuffer(m[2], np.uint8) for m in members]
    folded: dict[int, np.ndarray] = {}

    def at_width(width: int) -> np.ndarray:
        if width not in folded:
            rows = np.zeros((len(members), width), np.uint8)
            for i, p in enumerate(exact):
                if len(p) >= width:
                    rows[i] = np.bitwise_xor.reduce(p.reshape(-1, width), axis=0)
            folded[width] = rows
        return folded[width]

    out, forest = [], Forest()
    two_sided = side.max(initial=-1) > 0 and side.min(initial=-1) == 0
    for i in range(len(members) - 1):
        end = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        near = np.arange(i + 1, end)
        near = near[component[near] != component[i]]
        if two_sided:
            near = near[side[near] != side[i]]
        if not len(near):
            continue
        table = at_width(len(exact[i]))
        for at in range(0, len(near), 256):
            part = near[at:at + 256]
            differ = (table[part] != table[i]).sum(axis=1)
            part = part[differ * (100 + percent) <= (sizes[part] + sizes[i]) * (100 - percent)]
            for j in part.tolist():
                if not spanning or forest.join(int(component[i]), int(component[j])):
                    out.append((int(ids[i]), int(ids[j])))
    return out


def _pair_function(percent: int, spanning: bool):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, found = None, [], []

        def batch_of(rows: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([min(r) for r in rows], pa.int64()), pa.array([max(r) for r in rows], pa.int64())], ["a", "b"])

        for batch in batches:
            for key, *member in zip(*(c.to_pylist() for c in batch.columns)):
                if key != group:
                    found += likely_pairs(held, percent, spanning)
                    group, held = key, []
                held.append(tuple(member))
            if len(found) > 10_000:
                yield batch_of(found)
                found = []
        found += likely_pairs(held, percent, spanning)
        yield batch_of(found)

    return pairs


def _describe(width: int, percent: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_store("word hashes", WordHashes)
        for batch in batches:
            n, keys, signs, profiles = [], [], [], []
            for text in batch.column(3):
                s = shingles(text.as_py(), width, memo)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                signs.append(signatures(s, percent).view(np.int64).tobytes() if len(s) else b"")
                profiles.append(profile(s) if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary()), pa.array(profiles, pa.binary())],
                ["doc_id", "t1", "t2", "n", "k", "signs", "profile"])

    return describe


def _explode_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        # Repeated rows of a set come one after the other and count once.
        ids = batch.column(0).to_pylist()
        batch = batch.take(pa.array([i for i, c in enumerate(ids) if c != (ids[i - 1] if i else last)], pa.int64()))
        last = ids[-1] if ids else last
        for at in range(0, batch.num_rows, 500):
            ids, signs = batch.column(0)[at:at + 500].to_numpy(), [np.frombuffer(x, np.int64) for x in batch.column(1)[at:at + 500].to_pylist()]
            if signs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(signs)), pa.array(np.repeat(ids, [len(x) for x in signs]))], ["sig", "cid"])


def _verify(width: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        memo, unpack = worker_store("word hashes", WordHashes), zstandard.ZstdDecompressor().decompress
        last, left = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, left = a, shingles(unpack(x.as_py()).decode("utf-8", "surrogatepass"), width, memo)
                keep.append(linked(left, shingles(unpack(y.as_py()).decode("utf-8", "surrogatepass"), width, memo), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    return verify


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = [pack((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["cid", "packed"])


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component of the edges (a, b).

    Alternating large and small stars until nothing changes; every round is staged, and its
    minima are taken map-side, so a hub of any degree is one row a task.
    """
    e = stage(edges.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = e.unionByName(e.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").where("v <> m").selectExpr("v as u", "m as v").unionByName(own.selectExpr("u", "m as v"))
        e = stage(small.where("u <> v").distinct(), "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            return e.selectExpr("u as node", "v as root")
        mark = now


def across_components(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """g1, g2, g3, cid, side: members of large groups (sig, cid), dealt so that pairs across components (node, root) meet.

    A group inside one component is left out.  In others the members of the largest component do not
    meet each other: their blocks meet the blocks of the others, and those meet among themselves.
    """
    def blocks(n: str, size: int) -> str:
        return f"cast(({n} + {size - 1}) div {size} as int)"

    named = groups.join(roots.selectExpr("node as cid", "root"), "cid", "left").select("sig", "cid", F.coalesce("root", "cid").alias("root"))
    sizes = named.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("sig").agg(
        F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("c")).where("c > m.n").selectExpr(
        "sig", "c", "m.root as most", f"{blocks('m.n', 4 * BLOCK)} as inner", f"{blocks('c - m.n', BLOCK)} as outer")
    rows = named.join(sizes, "sig").withColumn("own", F.expr("cast(pmod(xxhash64(cid), if(root = most, inner, outer)) as int)"))
    met = F.expr(f"""case
        when c <= {BLOCK} then array(struct(0 as g2, 0 as g3, -1 as side))
        when root = most then transform(sequence(0, outer - 1), x -> struct(-2 - own as g2, x as g3, 0 as side))
        else concat(
            transform(sequence(0, inner - 1), x -> struct(-2 - x as g2, own as g3, 1 as side)),
            transform(sequence(0, outer - 1), x -> struct(
                least(own, x) as g2, greatest(own, x) as g3, case when own = x then -1 when own > x then 1 else 0 end as side))) end""")
    return rows.select(F.col("sig").alias("g1"), "cid", F.explode(met).alias("met")).select("g1", "met.g2", "met.g3", "cid", "met.side")


def describe_sets(docs: DataFrame, *, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t1, t2, n, k (digest of the set), signs, profile: one row per input row, staged."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
    return stage(rows.mapInArrow(_describe(width, percent), "doc_id long, t1 long, t2 long, n long, k binary, signs binary, profile binary"), "sets")


def link_classes(docs: DataFrame, sets: DataFrame, *, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(classes, roots): classes (k, cid, doc_id, t1, t2, n) numbered by smallest doc_id, and the linked ones' (node, root).

    ``sets`` is deleted once its signatures and the profiles of the sets that meet others are read.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t1", "t2"))
    slim = sets.where("n > 0").groupBy("k").agg(least.alias("r"), F.first("n").alias("n")).select("k", "r.doc_id", "r.t1", "r.t2", "n")
    classes = stage(number_rows(slim, [], [F.col("doc_id").asc_nulls_last(), F.col("k")], "cid"), "classes")
    key = ["k", "doc_id", "t1", "t2"]
    rows = join_on(sets.select(*key, "signs"), classes.select(*key, "cid"), key).select("cid", "signs").mapInArrow(
        _explode_signatures, "sig long, cid long")
    # The window reads (sig, cid) only and counts; what it keeps is the few rows that meet others.
    met = rows.withColumn("c", F.expr("count(*) over (partition by sig)")).where("c > 1")
    met = stage(met, "groups")
    lists = met.where(F.col("c") <= FULL).groupBy("sig").agg(F.sort_array(F.collect_list("cid")).alias("cids")).select("cids").distinct()
    few = lists.select(F.xxhash64("cids").alias("g1"), F.lit(-1).alias("g2"), F.lit(-1).alias("g3"), F.explode("cids").alias("cid"), F.lit(-1).alias("side"))
    many = met.where(F.col("c") > FULL)
    # At first a member meets its own block and the group's hubs, which all blocks get.
    blocks = many.select("sig", "cid", "c", F.expr(f"cast((c + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks"))
    own = F.pmod(F.xxhash64("cid"), "blocks").cast("int")
    hub = F.pmod(F.xxhash64(F.lit(1), "cid"), "c") < HUBS
    at = F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    linear = blocks.select(F.col("sig").alias("g1"), F.explode(at).alias("g2"), F.lit(-1).alias("g3"), "cid", F.lit(-1).alias("side"))
    groups = stage(few.unionByName(linear), "members")
    wanted = classes.join(groups.select("cid").distinct(), "cid", "left_semi").select(*key, "cid")
    known = stage(join_on(sets.select(*key, "n", "profile"), wanted, key).select("cid", "n", "profile").dropDuplicates(["cid"]), "profiles")
    discard(sets)

    def candidates(groups: DataFrame, component: DataFrame | None, spanning: bool) -> DataFrame:
        rows = groups.join(known, "cid")
        if component is not None:
            rows = rows.join(component.selectExpr("node as cid", "root"), "cid", "left")
        rows = rows.select(F.concat_ws(":", "g1", "g2", "g3").alias("g"), "cid", "n", "profile",
                           (F.coalesce("root", "cid") if component is not None else F.col("cid")).alias("component"), "side")
        dealt = rows.repartition("g").sortWithinPartitions("g", "cid")
        return dealt.mapInArrow(_pair_function(percent, spanning), "a long, b long").distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        named = stage(classes.join(nodes, "cid", "left_semi").select("cid", "doc_id", "t1", "t2"), "named")
        text = F.coalesce(F.col(text_col), F.lit(""))
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
        some = texts.where(among(F.col("t1"), named.select("t1"), 8))
        packed = stage(join_on(some, named, ["doc_id", "t1", "t2"]).select("cid", "text").mapInArrow(_pack, "cid long, packed binary")
                       .dropDuplicates(["cid"]), "texts")
        both = pairs.join(packed.selectExpr("cid as a", "packed as x"), "a").join(packed.selectExpr("cid as b", "packed as y"), "b")
        return stage(both.select("a", "b", "x", "y").mapInArrow(_verify(width, percent), "a long, b long, linked boolean"), "verified")

    first = verified(stage(candidates(groups, None, True), "pairs"))
    roots = components(first.where("linked").select("a", "b"))
    groups = stage(few.unionByName(across_components(many.select("sig", "cid"), roots)), "members")
    rest = stage(candidates(groups, roots, False).join(first.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    second = verified(rest)
    links = first.where("linked").select("a", "b").unionByName(second.where("linked").select("a", "b"))
    return classes, components(links)


def similar_documents(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t1, t2, n_shingles, component_id, one row per input row.

    component_id is the smallest doc_id reachable over links, the document itself included.
    """
    # Whole texts and profiles go to Python here, so batches are kept small.
    with small_batches(docs.sparkSession):
        sets = describe_sets(docs, width=width, percent=percent, id_col=id_col, text_col=text_col)
        rows = stage(sets.select("doc_id", "t1", "t2", "n", "k"), "rows")
        classes, roots = link_classes(docs, sets, width=width, percent=percent, id_col=id_col, text_col=text_col)
    linked_to = classes.join(roots, classes["cid"] == roots["node"], "left").select("k", F.coalesce("root", "cid").alias("cid"))
    smallest = classes.select("cid", F.col("doc_id").alias("component_id"))
    of_class = stage(linked_to.join(smallest, "cid").select("k", "component_id"), "components")
    return rows.join(of_class, "k", "left").select(
        "doc_id", "t1", "t2", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


ship_by_value(__name__)
