"""Every pipeline stage alone and all of them together."""

from collections import Counter, defaultdict

import pytest
from cases import documents, empty
from test_files_and_shards import windows_by_hand
from test_text_operators import components_by_hand

import corpus_pipeline
from pitsignal.llm import queries

SF = "/root/testdata/sf0.001"
LOOSE = ("quality_classifier", "mixing_sources")


def stages():
    return dict(corpus_pipeline.STAGES)


def test_names_and_entry():
    import __spark_entry__ as entry

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "mixing_sources", "sharding"]
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_one_document_of_each_component_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = stages()["ngram_jaccard_join"](spark, docs, SF)
    assert kept.columns == docs.columns
    want = {c for _, _, c in components_by_hand([(r.doc_id, r.text) for r in docs.collect()], 5, 80)}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(want)


def test_contaminated_documents_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = stages()["benchmark_decontamination"](spark, docs, SF)
    want = {r[0] for r in windows_by_hand([(r.doc_id, r.text) for r in docs.collect()], items) if not r[5]}
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(want)


def test_labelled_quality_decides(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in stages()["quality_classifier"](spark, docs, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    right = sum((r.doc_id in kept) == (r.quality == 1) for r in labels)
    assert right >= 0.9 * len(labels)


def test_the_mix_repeats_rows_towards_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = stages()["mixing_sources"](spark, docs, SF).collect()
    assert max(Counter(r.doc_id for r in rows).values()) <= 3
    size, taken = defaultdict(int), defaultdict(int)
    for r in docs.collect():
        size[r.source] += len((r.text or "").split())
    for r in rows:
        taken[r.source] += len(r.text.split())
    assert all(taken[s] <= 3 * size[s] for s in size) and abs(sum(taken.values()) / sum(size.values()) - 1) < 0.1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_pass_through(spark, name):
    docs = documents(spark)
    out = stages()[name](spark, docs, SF)
    rows = out.collect()
    if name == "sharding":
        assert out.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and len(rows) == docs.count()
    else:
        assert out.columns == docs.columns
        given = {tuple(r) for r in docs.collect()}
        assert {tuple(r) for r in rows} <= given
    if name == "ngram_jaccard_join":
        # Of the repeated first row one stays; texts without words are no group.
        assert Counter(r.doc_id for r in rows)[0] == 1 and {2, 3, 4} <= {r.doc_id for r in rows}
    assert stages()[name](spark, empty(spark), SF).count() == 0


def test_the_whole_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert rows and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.doc_id for r in rows} <= {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
