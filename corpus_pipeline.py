"""Corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and returns a
DataFrame: all but the last the columns of ``docs``, the last one the shard of each row.
``run`` applies them to ``documents`` and writes what a stage keeps before the next one
reads it.  Null ids and texts, repeated rows, empty tables and extra columns pass through
every stage; what each does with them is stated by the operator it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitsignal.llm import cube_mixing, decontaminate, kd_shards, ngram_join, quality
from pitsignal.llm.common import join_on, stage, table, text_key

KEEP_FROM = 0.3  # documents scored lower are rejected
WIDTH, PERCENT = 5, 80  # near duplicates: five-word shingles, similarity 0.8
SHARDS = 24
_KEY = ["_id", "_t1", "_t2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows as one struct beside their key, so no column of theirs can clash."""
    t1, t2 = text_key(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("_id"), t1.alias("_t1"), t2.alias("_t2"), F.struct("*").alias("_row"))


def _in_order() -> list:
    """An order of rows that agree in their key; rows that are alike in it are alike in all columns."""
    text = F.to_json("_row")
    return [F.xxhash64(text), text]


def _key_of(found: DataFrame, *more: str) -> DataFrame:
    return found.select(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), *more)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores at least ``KEEP_FROM``."""
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), label="quality")
    scored = quality.score(docs.select("text", F.struct("*").alias("_row")), model, "_score")
    return scored.where(F.col("_score") >= KEEP_FROM).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the smallest id, of its texts the one with the smallest key, once."""
    found = ngram_join.similar_documents(docs.select("doc_id", "text"), width=WIDTH, percent=PERCENT)
    found = stage(_key_of(found, "n_shingles", "component_id"), "found")
    some = found.where("n_shingles > 0")
    rank = F.struct(F.col("_id").isNull().alias("last"), "_id", "_t1", "_t2")
    # A component of null ids only has no smallest id; its texts are told apart by their keys.
    alone = F.when(F.col("component_id").isNull(), F.struct("_t1", "_t2"))
    first = some.groupBy("component_id", alone.alias("alone")).agg(F.min(rank).alias("r")).select("r._id", "r._t1", "r._t2")
    without = found.where("n_shingles = 0").select(*_KEY).distinct()
    kept = join_on(_keyed(docs), first.unionByName(without), _KEY, "left_semi")
    again = F.row_number().over(Window.partitionBy(*_KEY).orderBy(*_in_order()))
    return kept.withColumn("_again", again).where("_again = 1").select("_row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    found = decontaminate.find_contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = stage(_key_of(found.where("contaminated")).distinct(), "contaminated")
    return join_on(_keyed(docs), hit, _KEY, "left_anti").select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: rows not drawn go, rows drawn two or three times are repeated."""
    mixed = cube_mixing.mix(docs.select("doc_id", "text", "source"))
    drawn = mixed.groupBy("doc_id", "t1", F.xxhash64(F.lit(1), "source").alias("s")).agg(F.sum("copies").alias("copies"))
    drawn = drawn.where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("s").alias("_s"), "copies")
    rows = _keyed(docs).withColumn("_s", F.xxhash64(F.lit(1), F.col("_row.source")))
    same = ["_id", "_t1", "_s"]
    # Of rows that repeat (id, text, source) the first ones carry the drawn copies.
    order = F.row_number().over(Window.partitionBy(*same).orderBy(*_in_order()))
    count = F.count(F.lit(1)).over(Window.partitionBy(*same))
    taken = join_on(rows, drawn, same).withColumn("_place", order).withColumn("_of", count)
    times = F.expr("cast(copies div _of + if(_place <= copies % _of, 1, 0) as int)")
    return taken.withColumn("_times", times).where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), "_times"))).select("_row.*")


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    return kd_shards.assign_shards(docs.select("doc_id", "text"), SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality_classifier", keep_quality), ("ngram_jaccard_join", drop_near_duplicates), ("benchmark_decontamination", drop_contaminated),
    ("mixing_sources", mix_sources), ("sharding", place_in_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs


# The quality classifier and the sampling stage are not expressible in SQL.
ORACLE_SQL = None
