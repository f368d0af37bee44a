"""Document quality: random-indexing word vectors, pooled, and a small calibrated network.

A word's vector has two halves.  The first sums the random index vectors of its contexts
inside the word (character trigrams and trigrams of character classes, hashed to a table of
sparse ternary vectors), so every word has one.  The second is learned: the summed index
vectors of the words next to it in all documents, for every word seen ``SEEN`` times.  A document is the mean and the spread of its words' vectors and the logarithm of
their number; a two-layer numpy network scores it, and a temperature fitted on labelled
rows kept out of training calibrates the score.  Text without blanks is cut into pieces of
``MAX_WORD`` characters that count as words, so each of its characters reaches the score.

The learned halves are a table in the shared folder, files of fixed-width rows ordered by a
64-bit hash of the word; a worker reads the blocks that hold the words of its documents and
remembers a bounded number of words, so the vocabulary has no bound and is never collected.

Only the text enters a score.  The network is fitted on at most ``max_train`` labelled documents
(those with the smallest hash of their id); learning word vectors and scoring read every whole text.  A null text is the
empty text; rows without a usable label are never trained on, and of several labels of one
document the lowest counts.  With no usable label, or one class only, every score is the share
of label 1 (0.5 without any).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pitsignal.llm.common import new_folder, pack, unpack, worker_store
from pitsignal.shipping import ship_by_value

SPELLED, LEARNED, SLOTS, SPARSE = 64, 32, 1 << 13, 4
SEEN, MAX_TRAIN, MEMO = 5, 6_000, 80_000
HELD, WINDOW, ROWS = 300_000, 150_000, 64  # words kept between flushes, words handled at once, rows of a block
GAP, SPAN = 16, 256  # blocks: a read goes over shorter gaps, since a call costs as much as they do, and stays in a span
BITS = 1 << 25  # of the set that tells frequent words; with more words it lets more rare ones through
PIECES = 16  # files of that set
CELLS = BITS // 64 // PIECES  # 64-bit cells of a file
ROW = np.dtype([("h", "<i8"), ("v", "<f2", (LEARNED,))])
MAX_WORD = 48  # characters; a longer word counts as several, see words_of


def index_table(rows: int, size: int, seed: int) -> np.ndarray:
    """Sparse ternary index vectors: ``SPARSE`` entries of +1 or -1 in each row."""
    draw = np.random.default_rng(seed)
    table = np.zeros((rows, size), np.float32)
    for _ in range(SPARSE):
        table[np.arange(rows), draw.integers(0, size, rows)] += draw.choice([-1.0, 1.0], rows)
    return table


def words_of(text: str | None) -> list[str]:
    """The words between blanks; a word above ``MAX_WORD`` characters becomes the pieces it is cut into.

    Neighbouring pieces share two characters, so every trigram of the word lies in exactly one piece.
    """
    words = (text or "").split()
    if max(map(len, words), default=0) <= MAX_WORD:
        return words
    return [p for w in words for p in (
        [w] if len(w) <= MAX_WORD else [w[i:i + MAX_WORD] for i in range(0, len(w) - 2, MAX_WORD - 2)])]


def _classes() -> np.ndarray:
    """Character classes of the code points below 0x250; all others are letters of their own class."""
    out = np.full(0x251, 5, np.int64)
    for c in range(0x250):
        s = chr(c)
        out[c] = 1 if s.islower() else 2 if s.isupper() else 3 if s.isdigit() else 4 if s.isalpha() else 10 + c % 61
    return out


class Speller:
    """Vectors of words from their own characters, many words at a time."""

    def __init__(self) -> None:
        self.table = index_table(SLOTS, SPELLED, 11).astype(np.int16)
        self.classes = _classes()

    def vectors(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), SPELLED), np.float32)
        for at in range(0, len(words), 4_000):
            part = [f"\x02{w}\x03" for w in words[at:at + 4_000]]
            points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            shape = self.classes[np.minimum(points, 0x250)]
            slot = lambda x, mul: (((x[:-2] * mul + x[1:-1]) * mul + x[2:]) * 0x9E3779B1 >> 7) & (SLOTS - 1)
            spelled, shaped = slot(points, 8191), (slot(shape, 131) + 17) & (SLOTS - 1)
            order = np.argsort(-sizes, kind="stable")
            first, n = (np.cumsum(sizes) - sizes)[order], sizes[order] - 2
            total = np.zeros((len(part), SPELLED), np.int16)
            longer = np.searchsorted(-n, -np.arange(int(n[0])))  # words with a trigram at each place
            for k, m in enumerate(longer.tolist()):
                total[:m] += self.table[spelled[first[:m] + k]]
                total[:m] += self.table[shaped[first[:m] + k]]
            out[at + order] = total / np.sqrt(n, dtype=np.float32)[:, None]
        return out


@dataclass
class Model:
    """Everything a score needs."""

    share: float = 0.5
    vectors: list[tuple[str, int, bytes]] = field(default_factory=list)
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple | None = None
    temperature: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.share)
        # Rounded, since the last bits of a product depend on how many rows are scored at once.
        return np.round(sigmoid(logits((x - self.centre) / self.scale, self.layers) / self.temperature), 9)


def coded(words: list[str]) -> list[bytes]:
    return [w.encode("utf-8", "surrogatepass") for w in words]


def hashes(words: list[str] | list[bytes]) -> np.ndarray:
    """64-bit hashes that stand for words, of their UTF-8."""
    try:
        return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
    except UnicodeEncodeError:  # lone surrogates
        return hashes(coded(words))


class Vectors:
    """The learned halves of words, read from the files of ``learned_vectors``."""

    def __init__(self, files: list[tuple[str, int, bytes]]) -> None:
        self.files = sorted(((np.frombuffer(f, "<i8"), path, n) for path, n, f in files), key=lambda x: int(x[0][0]))
        self.starts = np.array([f[0] for f, _, _ in self.files], np.int64)
        self.open: dict[str, object] = {}
        self.bits = read_bits(files[0][0].rpartition("/")[0]) if files else None

    def frequent(self, h: np.ndarray) -> np.ndarray:
        """Whether the words of these hashes may have a learned half; nearly all others are told apart."""
        return holds(self.bits, h) if self.files else np.zeros(len(h), bool)

    def _read(self, path: str, at: int, rows: int) -> np.ndarray:
        if path not in self.open:
            from pyarrow import fs

            store, name = fs.FileSystem.from_uri(path)
            self.open[path] = store.open_input_file(name)
        return np.frombuffer(self.open[path].read_at(rows * ROW.itemsize, at * ROW.itemsize), ROW)

    def of(self, words: list[str]) -> np.ndarray:
        return self.of_hashes(hashes(words))

    def of_hashes(self, asked: np.ndarray) -> np.ndarray:
        out = np.zeros((len(asked), LEARNED), np.float32)
        if not self.files or not len(asked):
            return out
        order = np.argsort(asked)
        asked = asked[order]
        ends = np.append(np.searchsorted(asked, self.starts[1:]), len(asked))
        lo = int(np.searchsorted(asked, self.starts[0]))
        for (firsts, path, n), hi in zip(self.files, ends.tolist()):
            block = np.searchsorted(firsts, asked[lo:hi], side="right") - 1
            # Blocks near each other are read at once, at most SPAN of them.
            apart = (np.diff(block) > GAP) | (np.diff(block // SPAN) > 0)
            runs = [0, *(np.flatnonzero(apart) + 1).tolist(), len(block)] if len(block) else []
            for i, j in zip(runs, runs[1:]):
                part = slice(lo + i, lo + j)
                at, end = int(block[i]) * ROWS, min(n, (int(block[j - 1]) + 1) * ROWS)
                rows = self._read(path, at, end - at)
                h = asked[part]
                keys = np.ascontiguousarray(rows["h"])
                place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[place] == h
                out[order[part][hit]] = rows["v"][place[hit]]
            lo = hi
        return out


class Pooler:
    """Documents to feature rows; remembers the vectors of ``MEMO`` frequent words, others while they are used."""

    def __init__(self, files: list[tuple[str, int, bytes]]) -> None:
        self.speller, self.vectors = Speller(), Vectors(files)
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((4_096, SPELLED + LEARNED), np.float32)

    def _learn(self, fresh: list[str], h: np.ndarray, often: np.ndarray) -> None:
        """Rows for new words, the frequent ones first."""
        order = np.argsort(~often, kind="stable")
        words = [fresh[i] for i in order.tolist()]
        at, need = len(self.rows), len(self.rows) + len(words)
        while need > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        n = int(often.sum())
        self.table[at:need, :SPELLED] = self.speller.vectors(words)
        self.table[at:at + n, SPELLED:] = self.vectors.of_hashes(h[order[:n]])
        self.table[at + n:need, SPELLED:] = 0
        self.rows.update(zip(words, range(at, need)))

    def pool(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), 2 * (SPELLED + LEARNED) + 2), np.float32)
        waiting: dict[int, Counter] = {}
        held = 0
        for k, text in enumerate(texts):
            counts = Counter(words_of(text))
            if counts:
                waiting[k] = counts
                held += len(counts)
            if held > MEMO // 2:
                self._pool(waiting, out)
                waiting, held = {}, 0
        self._pool(waiting, out)
        return out

    def _pool(self, documents: dict[int, Counter], out: np.ndarray) -> None:
        """Rows of ``out`` for some documents, whose new words are looked up together."""
        if len(self.rows) > MEMO:
            self.clear()
        fresh = list(set().union(*documents.values()).difference(self.rows))
        h = hashes(fresh)
        often = self.vectors.frequent(h)
        self._learn(fresh, h, often)
        gathered = np.empty((8_192, SPELLED + LEARNED), np.float32)
        for k, counts in documents.items():
            at = np.fromiter(map(self.rows.__getitem__, counts), np.int64, len(counts))
            weight = np.fromiter(counts.values(), np.float32, len(counts))
            n = float(weight.sum())
            total = np.zeros((2, SPELLED + LEARNED), np.float64)
            for i in range(0, len(at), 8_192):  # bounded memory for very long texts
                w = weight[i:i + 8_192]
                rows = np.take(self.table, at[i:i + 8_192], axis=0, out=gathered[:len(w)], mode="clip")
                total[0] += w @ rows
                total[1] += w @ np.multiply(rows, rows, out=rows)
            mean = total[0] / n
            spread = np.sqrt(np.maximum(total[1] / n - mean * mean, 0))
            out[k] = np.concatenate([mean, spread, [np.log1p(n), len(counts) / n]])
        for i in np.flatnonzero(~often).tolist():
            del self.rows[fresh[i]]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logits(x: np.ndarray, layers: tuple) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.tanh(x @ w1 + b1) @ w2 + b2


def fit_network(x: np.ndarray, y: np.ndarray, *, hidden: int = 32, epochs: int = 30, rate: float = 3e-3, decay: float = 1e-3,
                seed: int = 3) -> tuple:
    """Two-layer network by Adam on the log loss."""
    draw = np.random.default_rng(seed)
    p = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), hidden), 0.0]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for at in range(0, len(x), 256):
            k = order[at:at + 256]
            h = np.tanh(x[k] @ p[0] + p[1])
            e = (sigmoid(h @ p[2] + p[3]) - y[k]) / len(k)
            back = np.outer(e, p[2]) * (1 - h * h)
            grads = [x[k].T @ back + decay * p[0], back.sum(0), h.T @ e + decay * p[2], e.sum()]
            step += 1
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    return tuple(p)


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    loss = lambda t: float(np.mean(np.logaddexp(0, z / np.exp(t)) - y * z / np.exp(t)))
    a, b, g = -2.5, 2.5, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Contexts:
    """Sums of neighbours' index vectors by word; whole numbers, so their order does not matter.

    Only words whose bits are set have sums; the others are neighbours.
    """

    def __init__(self, bits: np.ndarray) -> None:
        # A row of zeros at the end stands between texts.
        self.table = np.vstack([index_table(SLOTS, LEARNED, 23), np.zeros((1, LEARNED))]).astype(np.int8)
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {"": 0}  # no word is empty: the gap between texts
        self.slots, self.owns = np.full(4_096, SLOTS, np.int32), np.full(4_096, -1, np.int32)
        self.known: list[np.ndarray] = []
        self.n_known = 0
        self.sums, self.counts = np.zeros((4_096, LEARNED), np.int64), np.zeros(4_096, np.int64)

    def _meet(self, fresh: list[str]) -> None:
        at, need = len(self.places), len(self.places) + len(fresh)
        while need > len(self.slots):
            self.slots, self.owns = np.concatenate([self.slots, self.slots]), np.concatenate([self.owns, self.owns])
        self.places.update(zip(fresh, range(at, need)))
        words = coded(fresh)
        self.slots[at:need] = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % SLOTS
        h = hashes(words)
        frequent = holds(self.bits, h)
        self.owns[at:need] = np.where(frequent, np.cumsum(frequent) - 1 + self.n_known, -1)
        self.known.append(h[frequent])
        self.n_known += len(self.known[-1])
        while self.n_known > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])

    def add(self, parts: list[tuple[list[str], int, int]]) -> None:
        """Count the words of each part but for its first ``before`` and last ``after``, which are neighbours only."""
        words: list[str] = []
        neighbours: list[int] = []
        for part, before, after in parts:
            neighbours += range(len(words), len(words) + before)
            words += part
            neighbours += range(len(words) - after, len(words))
            words += ("", "")
        fresh = [w for w in set(words) if w not in self.places]
        if fresh:
            self._meet(fresh)
        at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        near = self.table[self.slots[at]]
        around = np.zeros_like(near)  # at most 16 each way: four neighbours of at most 4
        for d in (1, 2):
            around[d:] += near[:-d]
            around[:-d] += near[d:]
        own = self.owns[at]
        own[neighbours] = -1
        order = np.argsort(own, kind="stable")
        order = order[np.searchsorted(own, 0, sorter=order):]
        if not len(order):
            return
        own = own[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        own, n = own[first], np.diff(first, append=len(order))
        by_n = np.argsort(-n, kind="stable")
        own, first, n = own[by_n], first[by_n], n[by_n]
        around = around[order]
        total = np.zeros((len(own), LEARNED), np.int32)
        for k in range(int(min(n[0], 8))):  # the first occurrences of all words together, the rest by word
            m = np.searchsorted(-n, -k)
            total[:m] += around[first[:m] + k]
        for j in range(int(np.searchsorted(-n, -8))):
            total[j] += around[first[j] + 8:first[j] + n[j]].sum(axis=0, dtype=np.int32)
        self.sums[own] += total
        self.counts[own] += n

    def flush(self, shards: int) -> Iterator[pa.RecordBatch]:
        """The sums so far, cut by ranges of the hash: a packed table of sorted words per range."""
        h = np.concatenate([np.zeros(0, np.int64), *self.known])
        order = np.argsort(h)
        h, sums, counts = h[order], self.sums[order], self.counts[order]
        cuts = np.searchsorted(range_of(h, shards), np.arange(shards + 1))
        for shard in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[shard], cuts[shard + 1])
            data = pack(h[part], counts[part], narrow(sums[part]))
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([data], pa.binary())], ["shard", "data"])
        self.clear()


def range_of(h: np.ndarray, shards: int) -> np.ndarray:
    """The number of the equal range that holds each signed hash."""
    return (((h.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def narrow(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest signed type."""
    top = int(np.abs(values).max()) if values.size else 0
    return values.astype(np.int8 if top < 1 << 7 else np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    u = h.astype(np.uint64)
    first, second = u & np.uint64(BITS - 1), (u >> np.uint64(32)) & np.uint64(BITS - 1)
    return ((bits[first >> 6] >> (first & 63)) & (bits[second >> 6] >> (second & 63)) & 1).astype(bool)


def bits_file(folder: str, piece: int) -> tuple:
    """The store and the name of one of the ``PIECES`` files of the bit set, kept beside the vectors."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    return store, f"{root}/bits-{piece:06d}"


def write_bits(folder: str):
    """A task's cells of the bit set, whole pieces, written under the attempt's name and moved when complete."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces: dict[int, np.ndarray] = {}  # BITS / 8 bytes at most
        for batch in batches:
            at, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for piece in np.unique(at // CELLS).tolist():
                mine = at // CELLS == piece
                pieces.setdefault(piece, np.zeros(CELLS, np.uint64))[at[mine] % CELLS] = bits[mine]
        for piece, cells in pieces.items():
            store, name = bits_file(folder, piece)
            root, _, last = name.rpartition("/")
            store.create_dir(root, recursive=True)
            part = f"{root}/.{last}-{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(part, compression=None) as sink:
                sink.write(pack(cells))
            store.move(part, name)
        yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32())], ["piece"])

    return write


def read_bits(folder: str) -> np.ndarray:
    """The whole bit set; a piece without a file has no bit set."""
    from pyarrow import fs

    bits = np.zeros((PIECES, CELLS), np.uint64)
    for piece in range(PIECES):
        store, name = bits_file(folder, piece)
        if store.get_file_info(name).type == fs.FileType.File:
            with store.open_input_stream(name, compression=None) as source:
                bits[piece] = unpack(source.read())[0]
    return bits.ravel()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts by word of the texts of one task; a word comes again after each ``HELD`` words."""
    counts: Counter = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for at in range(0, len(words), 10_000):
            part = words[at:at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(hashes(part)), pa.array([counts[w] for w in part], pa.int64())], ["h", "n"])
        counts.clear()

    for batch in batches:
        for text in batch.column(0):
            counts.update(words_of(text.as_py()))
            if len(counts) > HELD:
                yield from flush()
    yield from flush()


def frequent_words(texts: DataFrame, folder: str) -> None:
    """Write the bit set of the words seen ``SEEN`` times to ``folder``; some rarer words pass it."""
    counts = texts.mapInArrow(_word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)
    slots = counts.select(F.explode(F.expr(f"array(h & {BITS - 1}L, shiftrightunsigned(h, 32) & {BITS - 1}L)")).alias("slot"))
    cells = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    cells.repartition(PIECES, F.expr(f"at div {CELLS}")).mapInArrow(write_bits(folder), "piece int").collect()  # PIECES rows at most


def _context_sums(folder: str, shards: int):
    """Partial sums by word of the texts of one task; a word comes again after each ``HELD`` words."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Contexts(read_bits(folder))
        parts: list[tuple[list[str], int, int]] = []
        held = 0
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                for at in range(0, len(words), WINDOW):
                    lo, end = max(0, at - 2), min(len(words), at + WINDOW)
                    hi = min(len(words), end + 2)
                    parts.append((words[lo:hi], at - lo, hi - end))
                    held += hi - lo
                    if held >= WINDOW:
                        found.add(parts)
                        parts, held = [], 0
                        if len(found.places) > HELD:
                            yield from found.flush(shards)
        if parts:
            found.add(parts)
        yield from found.flush(shards)

    return sums


def learned_vectors(texts: DataFrame) -> list[tuple[str, int, bytes]]:
    """Unit context vectors of all words seen ``SEEN`` times in ``texts``, written to files.

    Returns for each file its path, its rows and the first hash of every block of ``ROWS`` rows.
    A file is written under its attempt's name and moved when complete.
    """
    spark = texts.sparkSession
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = new_folder(spark, "vectors")

    def summed(tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, n, sums = (np.concatenate(x) for x in zip(*tables))
        order = np.argsort(h, kind="stable")
        h, first = np.unique(h[order], return_index=True)
        return h, np.add.reduceat(n[order], first), np.add.reduceat(sums[order], first, axis=0, dtype=np.int64)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        rows = ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()) for batch in batches for i in range(batch.num_rows))
        for shard, parts in groupby(rows, lambda r: r[0]):
            tables, held = [], 0
            for _, data in parts:
                tables.append(unpack(data))
                held += len(tables[-1][0])
                if held > 2 * len(tables[0][0]) + HELD:  # so that partial tables do not pile up
                    tables = [summed(tables)]
                    held = len(tables[0][0])
            h, n, sums = summed(tables)
            h, v = h[n >= SEEN], sums[n >= SEEN].astype(np.float64)
            if not len(h):
                continue
            out = np.zeros(len(h), ROW)
            out["h"] = h
            norms = np.linalg.norm(v, axis=1, keepdims=True)
            out["v"] = v / np.where(norms > 0, norms, 1)
            store, root = fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            name = f"vectors-{shard:06d}"
            part = f"{root}/.{name}-{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(part, compression=None) as sink:
                sink.write(out.tobytes())
            store.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "n": [len(h)], "firsts": [h[::ROWS].tobytes()]},
                                             schema=pa.schema([("file", pa.string()), ("n", pa.int64()), ("firsts", pa.binary())]))

    frequent_words(texts, folder)
    sums = texts.mapInArrow(_context_sums(folder, shards), "shard int, data binary")
    got = sums.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(
        write, "file string, n long, firsts binary").collect()  # 8 bytes for 64 words
    return [(r.file, r.n, bytes(r.firsts)) for r in got]


def held_out(doc_id: Column) -> Column:
    """One in five ids, by crc32 of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _pool_function(files: list[tuple[str, int, bytes]]):
    version = files[0][0] if files else ""

    def pooler() -> Pooler:
        return worker_store("pooler", lambda: Pooler(files), version)

    return pooler


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Word vectors of all documents; the network is fitted on at most ``max_train`` labelled ones that are not held out."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    sample = docs.select("doc_id", "text").join(chosen, "doc_id")
    files = learned_vectors(docs.select("text"))
    get = _pool_function(files)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = get().pool(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    got = sample.select("doc_id", "text", F.col("y").cast("int").alias("y")).mapInArrow(
        pooled, "doc_id long, y int, x binary").toPandas().sort_values("doc_id", kind="stable")
    y = got["y"].to_numpy(np.float64)
    if len(set(y)) < 2:
        return Model(share=float(y.mean()) if len(y) else 0.5, vectors=files)
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), -1).astype(np.float64)
    apart = np.array([zlib.crc32(f"calibrate {i}".encode()) % 6 == 0 for i in got["doc_id"]])
    if len(set(y[~apart])) < 2 or not apart.any():
        apart[:] = False
    centre, scale = x[~apart].mean(0), x[~apart].std(0) + 1e-3
    layers = fit_network((x[~apart] - centre) / scale, y[~apart])
    model = Model(float(y.mean()), files, centre, scale, layers)
    if apart.any():
        model.temperature = fit_temperature(logits((x[apart] - centre) / scale, layers), y[apart])
    return model


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of every whole text in ``column``."""
    get = _pool_function(model.vectors)
    slim = Model(model.share, [], model.centre, model.scale, model.layers, model.temperature)

    @F.pandas_udf("double")
    def of_text(texts: pd.Series) -> pd.Series:
        return pd.Series(slim.score(get().pool([None if t is None else str(t) for t in texts])), dtype="float64")

    return docs.withColumn(column, of_text(F.col("text")))


ship_by_value(__name__)
