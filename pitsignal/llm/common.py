"""What the operators of this package share: shared folders, staging, text expressions."""

from __future__ import annotations

import json
import pickle
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitsignal.shipping import ship_by_value

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Only a local session, whose executors
    live in the driver's process, may go without that setting and gets a scratch folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + _own_folder()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once in the shared folder and return a scan of it; lineage ends there."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Fewer rows per Arrow batch for jobs that run inside; the session's setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(staged: DataFrame) -> None:
    """Delete the folder of a staged table that nothing reads any more."""
    from pyarrow import fs

    for folder in {f.rpartition("/")[0] for f in staged.inputFiles()}:
        store, path = fs.FileSystem.from_uri(folder)
        store.delete_dir(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_on(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, where null equals null; the result has ``a``'s keys once.

    ``how`` is inner, left, left_semi or left_anti.
    """
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    right = b.select(*(F.col(k).alias(n) for k, n in names.items()), *(c for c in b.columns if c not in names))
    same = F.lit(True)
    for k, n in names.items():
        same &= F.col(k).eqNullSafe(F.col(n))
    return a.join(right, same, how).drop(*names.values())


def number_rows(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the row's gapless position from 0 in its group, in the given order.

    The rows are cut into ranges over (groups, order); a position is the count of the
    group's earlier ranges plus the place inside the range, so a group of any size is never
    one task.  Two columns are used on the way; ``df`` must not have them.
    """
    by_name = [F.col(g) for g in groups]
    dealt = stage(df.repartitionByRange(*by_name, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*groups, "_part").count().select(
        *groups, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = dealt.withColumn("_inside", F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order)))
    return join_on(inside, offsets, [*groups, "_part"]).select(
        *df.columns, (F.col("_before") + F.col("_inside") - 1).alias(name))


MAX_BITS = 1 << 23


def _probes(h: str, bits: int) -> tuple[str, str]:
    return f"({h} & {bits - 1}L)", f"(shiftrightunsigned({h}, 32) & {bits - 1}L)"


def _bit_words(hashes: DataFrame, bits_each: int) -> tuple[int, list[int]]:
    """Number of bits and the words of the bit set of the one column of ``hashes``."""
    prints = hashes.toDF("h").distinct()
    wanted = bits_each * max(1, prints.count())
    bits = min(MAX_BITS, max(1 << 12, 1 << (wanted - 1).bit_length()))
    slots = prints.select(F.explode(F.array(*(F.expr(x) for x in _probes("h", bits)))).alias("slot"))
    rows = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).collect()  # bits / 64 rows at most
    values = [0] * (bits // 64)
    for row in rows:
        values[row["word"]] = row["bits"]
    return bits, values


def bit_test(hashes: DataFrame, bits_each: int = 32) -> str:
    """A predicate, to be formatted with ``h``, that is true for every hash of the one column of ``hashes``.

    It tests a bit set of ``bits_each`` bits a distinct hash and at most ``MAX_BITS`` in all,
    so it is false for nearly all other hashes and lets more through beyond that size.  The set
    is part of the predicate's text, so that it can be used inside lambda functions.
    """
    bits, values = _bit_words(hashes, bits_each)
    held = f"from_json('{json.dumps(values)}', 'array<bigint>')"
    return " and ".join(
        f"getbit(get({held}, cast(shiftright({x}, 6) as int)), cast({x} & 63L as int)) = 1" for x in _probes("{h}", bits))


def among(column: Column, hashes: DataFrame, bits_each: int = 32) -> Column:
    """:func:`bit_test` of a column; the set is a staged row that the plan reads, not part of the plan."""
    bits, values = _bit_words(hashes, bits_each)
    held = stage(hashes.sparkSession.createDataFrame([(values,)], "bits array<bigint>"), "bits").scalar()
    tests = [F.getbit(F.get(held, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1 for at in (
        column.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(column, 32).bitwiseAND(F.lit(bits - 1)))]
    return tests[0] & tests[1]


def worker_store(name: str, build: Callable[[], object], version: object = None) -> object:
    """An object built once in a Python worker and kept for its later tasks.

    Functions reach the workers by value, so a module global would be new in each task.  A
    worker keeps one such object: the next one of another name or version takes its place.
    """
    home = sys.modules.setdefault("_pitsignal_worker", types.ModuleType("_pitsignal_worker"))
    kept = getattr(home, "kept", None)
    if kept is None or kept[:2] != (name, version):
        home.kept = None
        home.kept = kept = (name, version, build())
    return kept[2]


def pack(*parts: object) -> bytes:
    """Arrays and lists as one compressed value of a binary column, for the shuffles of numpy code."""
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts, protocol=5))


def unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a text; null and empty are alike."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


ship_by_value(__name__)
