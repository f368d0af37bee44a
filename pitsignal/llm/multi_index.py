"""Nearest neighbours by an inverted multi-index.

Each vector is cut into halves and each half is quantised by a codebook of its own, so a pair
of centroids is a cell.  A query orders the centroids of either half by inner product and
walks the pairs by their summed score with a heap (the multi-sequence walk).  The radii of a
cell bound the scores of its entries from both sides, so a query knows a score that ``k``
entries reach; it visits the cells whose upper bound is not below that and stops where no
further cell can be.  Their entries are reranked exactly, in double precision.

The cells of one left centroid form a list, cut into blocks of about ``BLOCK`` / 2 entries by
a hash of the vector id, so a vector that a third of the rows share makes many blocks of
bounded size.  Blocks and the query batches that visit them meet in an equi-join of packed
rows; a query brings the bit mask of the cells it visits, and only its ``k`` best of a block go on.  The codebooks are fitted on at most ``TRAIN`` vectors
(smallest hash of the id) and hold at most
``CENTROIDS`` rows a half (twice the fourth root of the number of entries below that); every vector is indexed.

Vectors that are null, all zero, or hold a null or non-finite component take no part, nor do vectors
of another length than the most frequent one.  Rows with a null id take no part; rows that
repeat an id are entries of their own, and a query skips every entry with its own id.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.llm.common import stage
from pitsignal.shipping import ship_by_value

CENTROIDS, TRAIN, BLOCK, BATCH = 256, 20_000, 8_192, 256


def usable(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row (a number of its own), vec_id, v (array of double): the vectors that take part, staged."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = rows.where("vec_id is not null and v is not null and size(v) > 0"
                       " and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    sizes = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    kept = sound.where(F.size("v") == (sizes["n"] if sizes else 0))
    return stage(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")


def kmeans(x: np.ndarray, k: int, *, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's rounds from distinct starting rows; fewer centroids when there are fewer distinct rows."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(1) - 2 * (x @ centres.T), axis=1)


def fit_codebooks(vectors: DataFrame, centroids: int, train: int = TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """The codebooks of both halves, from a bounded sample."""
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(train).select("v").toPandas()
    if got.empty:
        return np.zeros((1, 1)), np.zeros((1, 1))
    x = np.array(got["v"].tolist(), np.float64)
    cut = max(1, x.shape[1] // 2)
    right = x[:, cut:] if x.shape[1] > 1 else np.zeros((len(x), 1))
    return kmeans(x[:, :cut], centroids), kmeans(right, centroids)


def halves(x: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    return x[:, :cut], x[:, cut:] if x.shape[1] > cut else np.zeros((len(x), 1))


def walk(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, visit: int, least: float = -np.inf) -> list[int]:
    """Cells in descending order of summed scores until they hold ``visit`` entries or score below ``least``.

    The heap holds a pair (i, j) of ranks only after its neighbours of smaller rank, so
    every pair enters once.
    """
    a, b = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    heap, seen, cells, held = [(-(left[a[0]] + right[b[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < visit:
        score, i, j = heapq.heappop(heap)
        if -score < least:
            break
        cell = int(a[i]) * len(right) + int(b[j])
        if sizes[cell]:
            cells.append(cell)
            held += int(sizes[cell])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (-(left[a[p]] + right[b[q]]), p, q))
    return cells


def reachable(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, slack: np.ndarray, need: int) -> np.ndarray:
    """Mask of the cells that may hold one of the ``need`` best entries of a query.

    An entry's score differs from its cell's summed score by at most the cell's ``slack``.
    """
    scores = np.add.outer(left, right).ravel()
    full = np.flatnonzero(sizes)
    low = (scores - slack)[full]
    order = np.argsort(-low)
    at = int(np.searchsorted(np.cumsum(sizes[full][order]), need))
    sure = low[order[at]] if at < len(full) else -np.inf
    seen = np.array(walk(left, right, sizes, int(sizes.sum()), sure - slack[full].max()), np.int64)
    out = np.zeros(len(sizes), bool)
    out[seen[(scores + slack)[seen] >= sure]] = True
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length, none of them null, as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, *, every: int = 20, k: int = 20,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best entries for each row whose id ``every`` divides.

    Every row but the query's own is a candidate, so rows that repeat an id find each other and
    have an answer each.

    The cells a query visits follow from the data alone, and no entry outside them can be
    among its best.  On vectors without structure no index is selective and they are
    nearly all; on clustered vectors they are few.
    """
    entries = usable(vectors, id_col=id_col, vector_col=vector_col)
    books = fit_codebooks(entries, min(CENTROIDS, max(8, round(2 * entries.count() ** 0.25))))
    cut, cells = books[0].shape[1], len(books[0]) * len(books[1])

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = halves(_matrix(batch.column(2)), cut)
                i, j = nearest(a, books[0]), nearest(b, books[1])
                away = [pa.array(np.linalg.norm(x - c, axis=1)) for x, c in ((a, books[0][i]), (b, books[1][j]))]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(i * len(books[1]) + j, pa.int32()), *away], ["row", "vec_id", "v", "cell", "left", "right"])

    placed = stage(entries.mapInArrow(to_cells, "row long, vec_id long, v array<double>, cell int, left double, right double"), "cells")
    wide = len(books[1])
    sizes, radii = np.zeros(cells, np.int64), np.zeros((2, cells))
    held = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("left").alias("left"), F.max("right").alias("right"))
    for r in held.collect():  # CENTROIDS squared rows at most
        sizes[r["cell"]], radii[:, r["cell"]] = r["n"], (r["left"], r["right"])
    total = int(sizes.sum())
    # A list is all cells of one left centroid, hashed into blocks of about half the bound.
    blocks = np.maximum(1, -(-sizes.reshape(-1, wide).sum(axis=1) // (BLOCK // 2)))
    batches_of = max(1, -(-total // (every * BATCH)))

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = halves(_matrix(batch.column(2)), cut)
                left, right = a @ books[0].T, b @ books[1].T
                norms = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
                for at in range(0, batch.num_rows, 256):
                    rows, of, masks = [], [], []
                    for q in range(at, min(at + 256, batch.num_rows)):
                        slack = norms[0][q] * radii[0] + norms[1][q] * radii[1]
                        slack += 1e-9 * (slack + np.abs(np.add.outer(left[q], right[q])).ravel() + norms[0][q] ** 2 + norms[1][q] ** 2)
                        visits = reachable(left[q], right[q], sizes, slack, k + 1).reshape(-1, wide)
                        for i in np.flatnonzero(visits.any(axis=1)).tolist():
                            bits = np.packbits(visits[i]).tobytes()
                            for s in range(int(blocks[i])):
                                rows.append(q)
                                of.append(i * (1 << 32) + s)
                                masks.append(bits)
                    part = batch.take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(masks, pa.binary()), pa.array(of, pa.int64())], ["row", "vec_id", "v", "tag", "block"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, e_ids, q_rows, e_rows = (np.frombuffer(row[c], "<i8") for c in ("q_ids", "e_ids", "q_rows", "e_rows"))
                q, e = (np.frombuffer(row[c]).reshape(len(i), -1) for c, i in (("q_vectors", q_ids), ("e_vectors", e_ids)))
                masks = np.unpackbits(np.frombuffer(row["q_tags"], np.uint8).reshape(len(q_ids), -1), axis=1).astype(bool)
                cell = np.frombuffer(row["e_tags"], ">i4")
                out: list[list] = [[], [], [], []]
                for i in range(len(q_ids)):
                    at = np.flatnonzero(masks[i][cell] & (e_rows != q_rows[i]))
                    rough = e[at] @ q[i]
                    if len(at) > k:
                        at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - 1e-9 * (1 + abs(rough).max())]
                    # Summed component by component: a pair's score does not depend on its block.
                    exact = (q[i] * e[at]).cumsum(axis=1)[:, -1]
                    best = np.lexsort((e_ids[at], -exact))[:k]
                    for held, x in zip(out, (np.full(len(best), q_rows[i]), np.full(len(best), q_ids[i]), e_ids[at][best], exact[best])):
                        held.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query", "query_id", "vec_id", "score"])

    def pack(rows: DataFrame, side: str, groups: list[str]) -> DataFrame:
        """One row per group: ids, vectors and tags as bytes; groups are bounded."""
        names = [f"{side}_{c}" for c in ("rows", "ids", "vectors", "tags")]

        def packed(part: pa.Table) -> pa.Table:
            numbers = [part.column(c).to_numpy().astype("<i8").tobytes() for c in ("row", "vec_id")]
            values = [*numbers, _matrix(part.column("v")).tobytes(), b"".join(part.column("tag").to_pylist())]
            return pa.Table.from_pydict(
                {**{g: [part.column(g)[0].as_py()] for g in groups}, **{n: [x] for n, x in zip(names, values)}},
                schema=pa.schema([*((g, pa.int64()) for g in groups), *((n, pa.binary()) for n in names)]))

        return rows.groupBy(*groups).applyInArrow(packed, ", ".join([*(f"{g} long" for g in groups), *(f"{n} binary" for n in names)]))

    left_of = F.expr(f"cell div {wide}")
    per_list = F.get(F.from_json(F.lit(json.dumps(blocks.tolist())), "array<bigint>"), left_of.cast("int"))
    blocked = placed.select(
        "row", "vec_id", "v", F.unhex(F.lpad(F.hex(F.col("cell") % wide), 8, "0")).alias("tag"),
        (left_of * (1 << 32) + F.pmod(F.xxhash64("row"), per_list)).alias("block"))
    asked = entries.where(F.col("vec_id") % every == 0).mapInArrow(to_blocks, "row long, vec_id long, v array<double>, tag binary, block long")
    spread = asked.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches_of)))
    pairs = pack(spread, "q", ["block", "batch"]).join(pack(blocked, "e", ["block"]), "block")
    found = pairs.drop("block", "batch").mapInArrow(rerank, "query long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ship_by_value(__name__)
