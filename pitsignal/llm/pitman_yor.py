"""Text scores by a hierarchical Pitman-Yor language model.

A token is drawn in the restaurant of its context, which is the whole token before it (a text's
first token has one context of its own); there are as many restaurants as tokens that precede
another.  Their parent is the root, which has no context and whose base is uniform over the
vocabulary and one unknown token.  Customers of a restaurant are the tokens seen there, those of
the root the tables of all restaurants.

Seating is sampled by Gibbs.  A sweep takes all customers of one dish in one restaurant
away and seats them again one after another by the Chinese restaurant rule, the other dishes
as the sweep before left them; the waiting time until a customer opens the next table is beta
geometric, so a dish costs a draw per table and not per customer.  The predictive
probabilities of ``samples`` sweeps after ``burn`` are averaged.

Words are 64-bit hashes.  Dishes (a word in a restaurant) are cut by the word's hash into shards,
restaurants by the context's hash into homes.  A shard tells each home its tables, in an order that
the home has kept; the home adds up what all shards tell and answers in the same order.  Only
the root's two totals pass through the driver.

Each block of texts sends its distinct (word, context) pairs, with the places of the documents
that have them, to the shards once: learning counts them and scoring answers them.  Pairs that
are not among the dishes go on from the shard to the context's home, since only there the totals
of any restaurant are found.  A shard with more than an even share of the tokens hands its
requests to several tasks.  State of shards and homes is a row each in staged tables.

Null text is empty (its end token is scored).  A null id is not held out.  Rows that repeat
are scored each and trained on each.  Without training rows every token has probability 1 (the
unknown one).  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.llm.common import new_folder, pack, unpack
from pitsignal.shipping import ship_by_value

BLOCK_TOKENS, SLICE_BYTES, SHARD_BYTES = 2_000_000, 1 << 20, 1 << 25
MERGE_PAIRS, ASK_PAIRS = 4_000_000, 1_000_000
START = 0  # the context of a text's first token
_U = np.uint64
_LOW = _U((1 << 32) - 1)
_WORDS = np.random.default_rng(13).integers(1, 2**63, 257, dtype=np.uint64)  # one number per byte, the last for the end
_ODD, _INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def _small(values: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def _release() -> None:
    """Give the memory of freed arrays back; a worker lives on after its task and other tasks run beside it."""
    import ctypes

    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def _released(function):
    """A function of a partition that gives back its memory when its rows are read."""
    def run(number: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        yield from function(number, rows)
        _release()
    return run


# Tokens -------------------------------------------------------------------------------------


def _powers(of: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


END = _mix(_WORDS[256:])[0]


def _slice_tokens(raw: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of the words in bytes that begin and end between words."""
    solid = np.concatenate([[False], ~_BLANK[raw], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_WORDS[raw] * up[:len(raw)])])
    return starts, _mix((sums[ends] - sums[starts]) * down[starts])


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, contexts (the hash of the token before; ``START`` for a text's first) and text numbers of all tokens with ends."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    raw = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
    borders = np.cumsum([0, *(len(t) + 1 for t in texts)])
    blanks = np.concatenate([np.flatnonzero(_BLANK[raw]), [len(raw)]])
    found, at = [], 0
    up = down = None
    while at < len(raw):
        # To the first blank after a slice's length, or the end of the bytes.
        stop = int(blanks[np.searchsorted(blanks, min(at + SLICE_BYTES, len(raw)))])
        if up is None or len(up) <= stop - at:
            up, down = _powers(_ODD, stop - at + 1), _powers(_INVERSE, stop - at + 1)
        starts, hashes = _slice_tokens(raw[at:stop], up, down)
        found.append((starts + at, hashes))
        at = stop + 1
    starts, hashes = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    place = np.searchsorted(borders, starts, "right") - 1
    per_text = np.bincount(place, minlength=len(texts))
    closes = np.cumsum(per_text + 1) - 1  # where the ends go
    total = len(hashes) + len(texts)
    word = np.ones(total, bool)
    word[closes] = False
    all_hashes, before = np.full(total, END, np.uint64), np.full(total + 1, START, np.uint64)
    all_hashes[word] = hashes
    before[1:][word] = hashes
    return all_hashes, before[:-1], np.repeat(np.arange(len(texts), dtype=np.int32), per_text + 1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Ids, marks of texts to learn from, hashes, contexts, text numbers of about ``BLOCK_TOKENS`` tokens of whole texts."""
    ids, learn, parts, held, count = [], [], [], 0, 0
    for batch in batches:
        keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())
        learn.extend(batch.column("learn").to_pylist())
        some, size = [], 0
        for n, text in enumerate(texts):
            some.append(text.as_py())
            size += len(some[-1])
            if size >= SLICE_BYTES or n + 1 == len(keys):
                found = tokens(some)
                parts.append((found[0], found[1], found[2] + count))
                ids.extend(keys[n + 1 - len(some):n + 1])
                count, held = count + len(some), held + len(found[0])
                some, size = [], 0
                if held >= BLOCK_TOKENS:
                    found = None
                    yield _block(ids, learn[:count], parts)
                    ids, learn, held, count = [], learn[count:], 0, 0
    if parts:
        found = None
        yield _block(ids, learn, parts)


def _block(ids: list, learn: list, parts: list[tuple]) -> list:
    """The block of ``parts``, which are given up.  A list, so that who takes the arrays out holds them alone."""
    out = [ids, np.array(learn, bool), *(np.concatenate(x) for x in zip(*parts))]
    parts.clear()
    return out


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def _home_of(words: np.ndarray, shards: int) -> np.ndarray:
    return ((words >> _U(32)) * _U(shards)) >> _U(32)


def _homes(words: np.ndarray, shards: int) -> np.ndarray:
    """Where the sorted ``words`` of each shard start, and their number."""
    return np.searchsorted(_home_of(words, shards), np.arange(shards + 1, dtype=np.uint64))


# Staged rows --------------------------------------------------------------------------------


def _put(spark: SparkSession, rows: RDD, name: str, more: str = "") -> str:
    """Stage rows of a number, packed data and ``more`` columns as a table cut by the number."""
    folder = new_folder(spark, name)
    kept = spark.createDataFrame(rows, f"shard int, data binary{more}", verifySchema=False)
    kept.write.partitionBy("shard").option("compression", "uncompressed").parquet(folder)
    return folder


def _load(folder: str, number: int) -> tuple | None:
    """The data of one row of a table that ``_put`` staged, None where there is no such row."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    path = f"{root}/shard={number}"
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    return unpack(pq.read_table(path, filesystem=store, columns=["data"], partitioning=None)["data"][0].as_py())


def _discard(folder: str) -> None:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.delete_dir(root)


# Counting -----------------------------------------------------------------------------------


def _cut(shards: int):
    """Per block and shard the distinct pairs and the documents that have them; and a row with the block's ids.

    Documents to learn from come first in their block, so their number marks them.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, held in enumerate(_blocks(batches)):
            ids, learn, hashes, before, place = held
            held.clear()
            block = (task << 24) + number
            order = np.argsort(~learn, kind="stable")
            rank = np.empty(len(ids), np.uint64)
            rank[order] = np.arange(len(ids), dtype=np.uint64)
            words, code = np.unique(hashes, return_inverse=True)
            # A context is the token before: its number there, plus one.
            context = np.zeros(len(code), np.uint64)
            context[1:] = code[:-1]
            context[1:] += _U(1)
            context[before == START] = 0
            # From here on arrays are given up as soon as they are used: a worker holds some twenty times a block's text.
            hashes = before = None
            wide, base = _U(max(1, int(len(ids) - 1).bit_length())), _U(len(words) + 1)
            pair, pairs = code.astype(np.uint64) * base, None
            pair += context
            code = context = None
            if int(base).bit_length() * 2 + int(wide) > 64:  # a text of very many words
                pairs, pair = np.unique(pair, return_inverse=True)
            keys = pair.astype(np.uint64, copy=False)
            keys <<= wide
            keys |= rank[place]
            pair = place = rank = None
            keys.sort()
            at = _runs(keys)
            n, keys = np.diff(np.append(at, len(keys))), keys[at]
            place, keys = (keys & ((_U(1) << wide) - _U(1))).astype(np.int64), keys >> wide
            pair_at = _runs(keys)
            per_pair, keys = np.diff(np.append(pair_at, len(keys))), keys[pair_at]
            keys = keys if pairs is None else pairs[keys]
            code, context = (keys // base).astype(np.int64), (keys % base).astype(np.int64)
            cuts = _homes(words, shards)
            pairs = np.searchsorted(code, cuts)
            posts = np.append(pair_at, len(n))[pairs]
            before_words = np.concatenate([np.array([START], np.uint64), words])
            yield _request([(block % shards, block, 0, pack([ids[i] for i in order]))])
            for shard in np.flatnonzero(np.diff(cuts)).tolist():
                (a, b), (c, d), (e, f) = cuts[shard:shard + 2], pairs[shard:shard + 2], posts[shard:shard + 2]
                seen, at = np.unique(context[c:d], return_inverse=True)
                yield _request([(shard, block, 1, pack(
                    int(learn.sum()), words[a:b], _small(np.bincount(code[c:d] - a)), before_words[seen], _small(at),
                    _small(per_pair[c:d]), _small(place[e:f]), _small(n[e:f])))])
            words = code = context = pairs = place = keys = n = at = pair_at = per_pair = before_words = seen = None
        _release()
    return cut


_REQUEST = "shard int, block long, kind int, data binary"


def _request(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in _REQUEST.split(", ")])


def _shards(docs: DataFrame) -> int:
    """As many as there are shuffled partitions, or more where a shard would hold over ``SHARD_BYTES`` of text."""
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // SHARD_BYTES))


def deal(docs: DataFrame, learn: Column) -> RDD:
    """Requests of all blocks, a partition per shard; every job on it reads the files of one shuffle."""
    return _dealt(docs, learn, _shards(docs))


def _dealt(docs: DataFrame, learn: Column, count: int) -> RDD:
    cut = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), learn.alias("learn")).mapInArrow(_cut(count), _REQUEST)
    return cut.rdd.map(lambda r: (r[0], (r[1], r[2], bytes(r[3])))).partitionBy(count, int)


def _summed(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words and contexts, the pairs of their numbers (word << 32 | context, sorted), their counts."""
    words, contexts, counts = (np.concatenate(x) for x in zip(*parts))
    words, code = np.unique(words, return_inverse=True)
    contexts, at = np.unique(contexts, return_inverse=True)
    keys = (code.astype(np.uint64) << _U(32)) | at.astype(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    at = _runs(keys)
    return words, contexts, keys[at], np.add.reduceat(counts[order], at)


def _merge(shard: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """The shard's dishes with their counts of training tokens; memory goes with the distinct pairs."""
    parts, held, limit = [], 0, MERGE_PAIRS
    for _, (_, kind, data) in rows:
        if kind == 0:
            continue
        learnt, words, per_word, contexts, at, per_pair, place, n = unpack(data)
        times = np.bincount(np.repeat(np.arange(len(at)), per_pair), n * (place < learnt), len(at)).astype(np.int64)
        some = np.flatnonzero(times)
        parts.append((np.repeat(words, per_word)[some], contexts[at[some]], times[some]))
        held += len(some)
        if held > limit:
            words, contexts, keys, counts = _summed(parts)
            parts = [(words[(keys >> _U(32)).astype(np.int64)], contexts[(keys & _LOW).astype(np.int64)], counts)]
            held = len(counts)
            limit = max(MERGE_PAIRS, 2 * held)
    if held:
        model = Dishes(*_summed(parts))
        ones = [int((x == n).sum()) for x in (np.bincount(model.word_of), model.counts) for n in (1, 2)]
        yield shard, model.data(), len(model.words), int(model.counts.sum()), len(model.counts), ones


# Seating ------------------------------------------------------------------------------------


def seat(customers: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating each dish's customers anew.

    With k customers at t tables the next one opens a table with probability
    opening / (opening + k - discount * t).
    """
    tables = np.minimum(customers, 1)
    rows = np.flatnonzero(customers > 1)
    seated = np.ones(len(rows), np.int64)
    while len(rows):
        free = seated - discount * tables[rows]
        chance = np.clip(rng.beta(opening[rows], free), 1e-15, 1.0)
        seated = seated + np.minimum(rng.geometric(chance), customers[rows])
        keep = seated <= customers[rows]
        rows, seated = rows[keep], seated[keep]
        tables[rows] += 1
        keep = seated < customers[rows]
        rows, seated = rows[keep], seated[keep]
    return tables


class Totals:
    """What all shards share after a sweep: the root's totals, the constants, and where the restaurants' totals are staged."""

    def __init__(self, customers: int, tables: int, vocabulary: int, discounts: tuple, strength: float, count: int, homes: str):
        self.customers0, self.tables0 = customers, tables
        self.vocabulary, self.discounts, self.strength = vocabulary, discounts, strength
        self.count, self.homes, self.kept = count, homes, ""  # number of homes, and the tables of a kept sample

    def root(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        s, d = self.strength, self.discounts[0]
        return (c - d * t + (s + d * self.tables0) / (self.vocabulary + 1)) / (s + self.customers0)

    def restaurant(self, customers: np.ndarray, tables: np.ndarray, c: np.ndarray, t: np.ndarray, parent: np.ndarray) -> np.ndarray:
        s, d = self.strength, self.discounts[1]
        return (c - d * t + (s + d * tables) * parent) / (s + customers)


class Dishes:
    """A shard of the model: counts of its words in the restaurants.

    ``keys`` are word number << 32 | context number, sorted.  ``kept`` has the tables of each
    sample (of dishes, of words in the root), ``customers`` and ``tables`` the totals of the
    restaurants over all shards.
    """

    def __init__(self, words: np.ndarray, contexts: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        self.words, self.contexts, self.keys, self.counts = words, contexts, keys, counts
        self.word_of, self.context_of = (keys >> _U(32)).astype(np.int64), (keys & _LOW).astype(np.int64)
        self.word_at = _runs(self.word_of)
        self.kept, self.customers, self.tables = [], None, []

    def data(self) -> bytes:
        return pack(self.words, self.contexts, _small(np.bincount(self.word_of)), _small(self.context_of), _small(self.counts))

    def by_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context_of, values, len(self.contexts)).astype(np.int64)

    def customers_of_root(self, tables: np.ndarray) -> np.ndarray:
        return np.add.reduceat(tables, self.word_at)

    def sweep(self, totals: Totals, restaurants: np.ndarray, tables: tuple, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Tables seated anew; ``restaurants`` are the tables of each context over all shards."""
        s, (d0, d1) = totals.strength, totals.discounts
        t1, t0 = tables
        root = totals.root(self.customers_of_root(t1), t0)
        t1 = seat(self.counts, (s + d1 * (restaurants[self.context_of] - t1)) * root[self.word_of], d1, rng)
        t0 = seat(self.customers_of_root(t1), (s + d0 * (totals.tables0 - t0)) / (totals.vocabulary + 1), d0, rng)
        return t1, t0


def _read_dishes(folder: str, shard: int) -> Dishes | None:
    found = _load(folder, shard)
    if found is None:
        return None
    words, contexts, per_word, at, counts = found
    keys = (np.repeat(np.arange(len(words), dtype=np.uint64), per_word) << _U(32)) | at.astype(np.uint64)
    return Dishes(words, contexts, keys, counts.astype(np.int64))


def _wide(arrays: Iterable[np.ndarray]) -> tuple[np.ndarray, ...]:
    return tuple(x.astype(np.int64) for x in arrays)


def _dishes(data: bytes) -> Dishes | None:
    """A shard with its kept samples; ``data`` names it and the tables it is staged in."""
    shard, dishes, kept, met = unpack(data)
    model = _read_dishes(dishes, shard)
    if model is not None:
        model.kept = [_wide(_load(folder, shard)[:2]) for folder in kept]
        model.customers, *model.tables = _wide(_load(met, shard))
    return model


# Shards and homes ---------------------------------------------------------------------------


def _numbers(spark: SparkSession, count: int) -> RDD:
    """The numbers of all shards, or homes, one to a task."""
    return spark.sparkContext.parallelize(range(count), count)


def _slices(contexts: np.ndarray, count: int, *values: np.ndarray) -> list[tuple[int, bytes]]:
    """The values of the sorted contexts, cut by home."""
    cuts = _homes(contexts, count)
    return [(home, pack(*(v[cuts[home]:cuts[home + 1]] if v.dtype == np.uint64 else _small(v[cuts[home]:cuts[home + 1]]) for v in values)))
            for home in np.flatnonzero(np.diff(cuts)).tolist()]


def _offered(dishes: str, count: int):
    """The contexts of a shard with their customers and dishes, to their homes."""
    def offered(shard: int) -> Iterator[tuple]:
        model = _read_dishes(dishes, shard)
        if model is not None:
            ones = np.ones(len(model.counts), np.int64)
            for home, data in _slices(model.contexts, count, model.contexts, model.by_context(model.counts), model.by_context(ones)):
                yield home, (shard, data)
    return offered


def _settle(home: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """A home's contexts, their customers and first tables, and each shard's places among them."""
    told = sorted(((shard, unpack(data)) for _, (shard, data) in rows), key=lambda r: r[0])
    if told:
        contexts = np.unique(np.concatenate([x[0] for _, x in told]))
        places = {shard: np.searchsorted(contexts, x[0]).astype(np.uint32) for shard, x in told}
        customers, tables = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
        for shard, (_, c, t) in told:
            customers[places[shard]] += c
            tables[places[shard]] += t
        yield home, pack(contexts, _small(customers), _small(tables), places)


def _told(tables: str):
    """A shard's tables by context after a sweep, as that sweep cut them by home."""
    def told(shard: int) -> Iterator[tuple]:
        found = _load(tables, shard)
        for home, data in found[2] if found is not None else ():
            yield home, (shard, data)
    return told


def _added(homes: str, home: int, rows: Iterator[tuple]) -> tuple[np.ndarray, dict] | None:
    """Tables of a home's restaurants over all shards, and the shards' places."""
    found = _load(homes, home)
    if found is None:
        return None
    sums = np.zeros(len(found[0]), np.int64)
    for _, (shard, data) in rows:
        sums[found[3][shard]] += unpack(data)[0]
    return sums, found[3]


def _totals(homes: str):
    def totals(home: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        found = _added(homes, home, rows)
        if found is not None:
            yield home, pack(_small(found[0]))
    return totals


def _back(places: dict, home: int, *values: np.ndarray) -> Iterator[tuple]:
    for shard, place in places.items():
        yield shard, (home, pack(*(_small(v[place]) for v in values)))


def _first(homes: str):
    def first(home: int) -> Iterator[tuple]:
        found = _load(homes, home)
        if found is not None:
            yield from _back(found[3], home, found[2])
    return first


def _returned(homes: str):
    def returned(home: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        found = _added(homes, home, rows)
        if found is not None:
            yield from _back(found[1], home, found[0])
    return returned


def _all_kept(homes: str, kept: list[str]):
    def all_kept(home: int) -> Iterator[tuple]:
        found = _load(homes, home)
        if found is not None:
            yield from _back(found[3], home, found[1], *(_load(folder, home)[0] for folder in kept))
    return all_kept


def _joined(rows: Iterator[tuple]) -> list[np.ndarray]:
    """Answers of all homes in the order of the shard's contexts."""
    found = sorted(((home, unpack(data)) for _, (home, data) in rows), key=lambda r: r[0])
    return [np.concatenate(x) for x in zip(*(values for _, values in found))]


def _seated(dishes: str, tables: str | None, totals: Totals, number: int, count: int):
    def seated(shard: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        restaurants = _joined(rows)
        model = _read_dishes(dishes, shard) if restaurants else None
        if model is None:
            return
        before = _wide(_load(tables, shard)[:2]) if tables else (
            np.ones(len(model.counts), np.int64), np.ones(len(model.words), np.int64))
        t1, t0 = model.sweep(totals, restaurants[0].astype(np.int64), before, np.random.default_rng([number, shard]))
        data = pack(_small(t1), _small(t0), _slices(model.contexts, count, model.by_context(t1)))
        yield shard, data, int(t1.sum()), int(t0.sum())
    return seated


def _meet(shard: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    found = _joined(rows)
    if found:
        yield shard, pack(*(_small(x) for x in found))


class Model:
    """Staged shards with their kept samples, and what all shards share."""

    def __init__(self, shards: DataFrame, names: list[bytes], tokens: int, vocabulary: int, copies: dict[int, int], samples: list[Totals]):
        self.shards, self.names, self.tokens, self.vocabulary = shards, names, tokens, vocabulary
        self.copies, self.samples = copies, samples


def fit(docs: DataFrame, burn: int = 2, samples: int = 3, strength: float = 1.0) -> Model:
    """Learn the model from the whole texts of ``docs``.

    Discounts are n1 / (n1 + 2 n2) of each level's counts of one and two, between 0.05 and 0.95.
    """
    return learn(docs.sparkSession, deal(docs, F.lit(True)), burn, samples, strength)


def learn(spark: SparkSession, dealt: RDD, burn: int = 2, samples: int = 3, strength: float = 1.0) -> Model:
    """Learn the model from the texts that are marked in dealt requests."""
    count = dealt.getNumPartitions()
    more = ", words long, tokens long, dishes long, ones array<long>"
    dishes = _put(spark, dealt.mapPartitionsWithIndex(_released(_merge)), "dishes", more)
    sizes = {r["shard"]: r for r in spark.read.schema(f"shard int, data binary{more}").parquet(dishes).drop("data").collect()}  # one row per shard
    vocabulary, total = sum(r["words"] for r in sizes.values()), sum(r["tokens"] for r in sizes.values())
    ones = np.array([r["ones"] for r in sizes.values()]).reshape(-1, 4).sum(axis=0)
    discounts = tuple(float(np.clip(a / max(1, a + 2 * b), 0.05, 0.95)) for a, b in ones.reshape(2, 2))
    homes = _put(spark, _numbers(spark, count).flatMap(_offered(dishes, count)).partitionBy(count, int).mapPartitionsWithIndex(_released(_settle)), "homes")
    state = Totals(sum(r["dishes"] for r in sizes.values()), vocabulary, vocabulary, discounts, strength, count, homes)
    back, tables, kept, states = _numbers(spark, count).flatMap(_first(homes)), None, [], []
    for number in range(burn + samples):
        swept = _put(spark, back.partitionBy(count, int).mapPartitionsWithIndex(_released(_seated(dishes, tables, state, number, count))), "tables",
                     ", opened long, root long")
        if tables and tables not in kept:
            _discard(tables)
        tables = swept
        opened = spark.read.schema("opened long, root long").parquet(tables).groupBy().sum().first()
        told = _numbers(spark, count).flatMap(_told(tables)).partitionBy(count, int)
        state = Totals(opened[0] or 0, opened[1] or 0, vocabulary, discounts, strength, count, homes)
        if number >= burn:
            kept.append(tables)
            state.kept = _put(spark, told.mapPartitionsWithIndex(_released(_totals(homes))), "totals")
            states.append(state)
        back = told.mapPartitionsWithIndex(_released(_returned(homes)))
    met = _numbers(spark, count).flatMap(_all_kept(homes, [s.kept for s in states])).partitionBy(count, int).mapPartitionsWithIndex(_released(_meet))
    met = _put(spark, met, "met")
    names = [pack(shard, dishes, kept, met) for shard in range(count)]
    copies = {shard: round(r["tokens"] * count / max(1, total)) for shard, r in sizes.items()}
    shards = spark.createDataFrame([(shard, names[shard]) for shard in sorted(sizes)], "shard int, data binary")
    return Model(shards, names, total, vocabulary, {s: n for s, n in copies.items() if n > 1}, states)


# Scoring ------------------------------------------------------------------------------------


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the sorted ``table`` (0 where absent) and whether they are there."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    there = table[at] == wanted
    return np.where(there, at, 0), there


class Restaurants:
    """Totals of the restaurants of one home in all samples; those that are not there are empty."""

    def __init__(self, samples: list[Totals], home: int):
        found = _load(samples[0].homes, home)
        none = np.zeros(0, np.uint64)
        self.contexts, self.customers, self.tables = none, none, [none] * len(samples)
        if found is not None:
            self.contexts, self.customers = found[:2]
            self.tables = [_load(s.kept, home)[0] for s in samples]

    def of(self, contexts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        at, there = _find(self.contexts, contexts)
        if not there.any():
            nothing = np.zeros(len(contexts), np.int64)
            return nothing, [nothing] * len(self.tables)
        customers, *tables = (np.where(there, x[at], 0).astype(np.int64) for x in (self.customers, *self.tables))
        return customers, tables


def unseen(samples: list[Totals], root: list[tuple], customers: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Probability of words that a restaurant never served, from their customers and tables in the root."""
    return sum(s.restaurant(customers, t, 0, 0, s.root(*r)) for s, r, t in zip(samples, root, tables)) / len(samples)


class Scorer:
    """Averaged predictive probabilities of a shard's (word, context) pairs; without a model all words are unknown."""

    def __init__(self, model: Dishes | None, samples: list[Totals], chances: bool = True):
        none = np.zeros(0, np.uint64)
        self.words, self.contexts, self.keys = (model.words, model.contexts, model.keys) if model else (none,) * 3
        # The last number stands for the unknown word.
        self.counts = np.append(np.bincount(model.word_of, model.counts), 0).astype(np.int64) if model else np.zeros(1, np.int64)
        self.samples, self.root, self.chance = samples, [], np.zeros(len(self.keys) if chances else 0)
        for number, totals in enumerate(samples):
            if not model:
                self.root.append((np.zeros(1, np.int64),) * 2)
                continue
            t1, t0 = model.kept[number]
            top = model.customers_of_root(t1)
            self.root.append((np.append(top, 0), np.append(t0, 0)))
            if not chances:
                continue
            self.chance += totals.restaurant(model.customers[model.context_of], model.tables[number][model.context_of], model.counts, t1,
                                             totals.root(top, t0)[model.word_of]) / len(samples)

    def seen(self, words: np.ndarray, of: np.ndarray, contexts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of ``words`` (-1: unknown), and the probability of each pair (numbers ``of`` and ``at``) and whether it is a dish."""
        word, known = _find(self.words, words)
        place, there = _find(self.contexts, contexts)
        pair, has = _find(self.keys, (word.astype(np.uint64) << _U(32))[of] | place.astype(np.uint64)[at])
        has &= known[of] & there[at]
        return np.where(known, word, -1), np.where(has, self.chance[pair], 1.0) if len(self.chance) else np.ones(len(of)), has

    def ask(self, words: np.ndarray, of: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of ``words``, and the probability of each pair (word number ``of``, context)."""
        contexts, at = np.unique(before, return_inverse=True)
        word, chance, has = self.seen(words, of, contexts, at)
        home = _home_of(before, self.samples[0].count)
        for number in np.unique(home[~has]).tolist():
            some = np.flatnonzero(~has & (home == number))
            asked = word[of[some]]
            chance[some] = unseen(self.samples, [(c[asked], t[asked]) for c, t in self.root], *Restaurants(self.samples, number).of(before[some]))
        return self.counts[word], chance


def _answered(names: list[bytes], samples: list[Totals], tokens: int, vocabulary: int, owners: dict[int, int]):
    """Sums per document of a block: base and model log10 probabilities of the shard's dishes, known and all tokens.

    ``owners`` has the shard of each partition, none where other tasks answer.
    """
    def answered(partition: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        scorer = None
        for _, (block, kind, data) in rows:
            if kind == 0:
                yield block, 0, data
            elif partition in owners:
                scorer = scorer or Scorer(_dishes(names[owners[partition]]), samples)
                _, words, per_word, contexts, at, per_pair, place, n = unpack(data)
                of = np.repeat(np.arange(len(words)), per_word)
                word, chance, _ = scorer.seen(words, of, contexts, at)
                counts = scorer.counts[word]
                base = np.log10((counts + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
                pair = np.repeat(np.arange(len(of)), per_pair)
                docs, at = np.unique(place, return_inverse=True)
                sums = [np.bincount(at, n * x) for x in (base[of][pair], np.log10(chance)[pair], (counts > 0)[of][pair], np.ones(len(pair)))]
                yield block, 1, pack(_small(docs), sums[0], sums[1], _small(sums[2].astype(np.int64)), _small(sums[3].astype(np.int64)))
    return answered


def _asked(names: list[bytes], samples: list[Totals], owners: dict[int, int]):
    """Pairs that are no dishes, to the homes of their contexts."""
    def asked(partition: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        scorer, parts, held = None, [], 0
        for _, (block, kind, data) in rows if partition in owners else ():
            if kind == 0:
                continue
            scorer = scorer or Scorer(_dishes(names[owners[partition]]), samples, chances=False)
            _, words, per_word, contexts, at, per_pair, place, n = unpack(data)
            of = np.repeat(np.arange(len(words)), per_word)
            word, _, has = scorer.seen(words, of, contexts, at)
            pair = np.repeat(np.arange(len(of)), per_pair)
            post = np.flatnonzero(~has[pair])
            pair = pair[post]
            parts.append((np.full(len(post), block), place[post], n[post], contexts[at[pair]], word[of[pair]]))
            held += len(post)
            if held >= ASK_PAIRS:
                yield from _to_homes(scorer, parts)
                parts, held = [], 0
        if held:
            yield from _to_homes(scorer, parts)
    return asked


def _to_homes(scorer: Scorer, parts: list[tuple]) -> Iterator[tuple]:
    block, place, n, context, word = (np.concatenate(x) for x in zip(*parts))
    count = scorer.samples[0].count
    home = _home_of(context, count).astype(np.int64)
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(count + 1))
    for number in np.flatnonzero(np.diff(cuts)).tolist():
        rows = order[cuts[number]:cuts[number + 1]]
        contexts, at = np.unique(context[rows], return_inverse=True)
        words, of = np.unique(word[rows], return_inverse=True)
        blocks, within = np.unique(block[rows], return_inverse=True)
        yield number, pack(contexts, _small(at), [(_small(c[words]), _small(t[words])) for c, t in scorer.root], _small(of),
                           blocks, _small(within), _small(place[rows]), _small(n[rows]))


def _replied(samples: list[Totals]):
    """Sums per document of the log10 probabilities of pairs that are no dishes."""
    def replied(home: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        held = None
        for _, data in rows:
            held = held or Restaurants(samples, home)
            contexts, at, root, of, blocks, within, place, n = unpack(data)
            customers, tables = held.of(contexts)
            chance = unseen(samples, [(c[of].astype(np.int64), t[of].astype(np.int64)) for c, t in root], customers[at], [t[at] for t in tables])
            docs, to = np.unique((within.astype(np.uint64) << _U(32)) | place.astype(np.uint64), return_inverse=True)
            sums = np.bincount(to, n * np.log10(chance))
            cuts = np.searchsorted(docs >> _U(32), np.arange(len(blocks) + 1, dtype=np.uint64))
            for block, a, b in zip(blocks.tolist(), cuts[:-1], cuts[1:]):
                yield block, 2, pack(_small(docs[a:b] & _LOW), sums[a:b])
    return replied


def _gather(id_type: pa.DataType):
    """One row per document: ids come first in a block, then the sums of shards and homes."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_each(batches), lambda r: r[0]):
            ids = unpack(next(rows)[2])[0]
            base, score = np.zeros(len(ids)), np.zeros(len(ids))
            known, count = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for _, kind, data in rows:
                if kind == 2:
                    at, s = unpack(data)
                    score[at] += s
                    continue
                at, b, s, k, n = unpack(data)
                base[at] += b
                score[at] += s
                known[at] += k
                count[at] += n
            yield pa.record_batch([pa.array(ids, id_type), pa.array(count), pa.array(known), pa.array(base), pa.array(score)],
                                  ["doc_id", "n_tokens", "n_known", "base_score", "score"])
    return gather


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield tuple(c[0].as_py() for c in batch.slice(at, 1).columns)


def _copied(first: dict[int, int], copies: dict[int, int]):
    """Requests of shards with more than an even share, dealt to the shard's copies by block."""
    def copied(shard: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, request in rows if shard in copies else ():
            if request[1]:
                yield first[shard] + request[0] % copies[shard], request
    return copied


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of ``docs``."""
    return answer(_dealt(docs, F.lit(False), len(model.names)), model, docs)


def answer(dealt: RDD, model: Model, docs: DataFrame) -> DataFrame:
    """Scores of the documents of dealt requests; ``docs`` has their ids' type."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind, count = docs.sparkSession, docs.schema["doc_id"].dataType, dealt.getNumPartitions()
    work = [(dealt, {shard: shard for shard in range(count) if shard not in model.copies})]
    if model.copies:
        owners, first = {}, {}
        for shard, copies in model.copies.items():
            first[shard] = len(owners)
            owners.update({len(owners) + copy: shard for copy in range(copies)})
        work.append((dealt.mapPartitionsWithIndex(_copied(first, model.copies)).partitionBy(len(owners), int), owners))
    union = spark.sparkContext.union
    asked = union([rows.mapPartitionsWithIndex(_released(_asked(model.names, model.samples, owners))) for rows, owners in work]).partitionBy(count, int)
    answers = union([*(rows.mapPartitionsWithIndex(_released(_answered(model.names, model.samples, model.tokens, model.vocabulary, owners))) for rows, owners in work),
                     asked.mapPartitionsWithIndex(_released(_replied(model.samples)))])
    met = spark.createDataFrame(answers, "block long, kind int, data binary", verifySchema=False)
    return met.repartition(count, "block").sortWithinPartitions("block", "kind").mapInArrow(
        _gather(to_arrow_type(kind)),
        f"doc_id {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def score_held_out(docs: DataFrame, burn: int = 2, samples: int = 3) -> DataFrame:
    """Learn from the documents that are not held out, score all."""
    dealt = deal(docs, ~held_out(F.col("doc_id")))
    model = learn(docs.sparkSession, dealt, burn, samples)
    return answer(dealt, model, docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
                                             F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


ship_by_value(__name__)
