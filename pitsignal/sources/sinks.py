"""Sinks: ledger append, quarantine, feature tables, datasets, evaluation bundles."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pitsignal.operators.contracts import CONTRACTS, MODELS, errors_of
from pitsignal.sources.commits import CommitLog
from pitsignal.sources.readers import committed_ledger
from pitsignal.sources.schemas import SIGNAL


# JSON keeps whole microseconds; the writer's default would cut them to milliseconds.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _as_json(columns: list[str]) -> str:
    options = ", ".join(f'"{k}", "{v}"' for k, v in JSON_TIMES.items())
    return f"to_json(struct({', '.join(columns)}), map({options}))"


class ConflictingContent(ValueError):
    """An identifier is reused for different content."""


def require_valid(df: DataFrame, contract: str) -> None:
    """Raise with a sample when any row breaks the contract (one pass, no shuffle)."""
    rules = [*CONTRACTS[contract], *MODELS[contract]]
    bad = df.selectExpr("*", f"{errors_of(rules)} as errors").where("size(errors) > 0").take(1)
    if bad:
        raise ValueError(f"{contract} contract: {bad[0]['errors'][0]}")


def _fingerprint(df: DataFrame) -> str:
    return f"sha2({_as_json(df.columns)}, 256)"


def append_actions(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """``(signal_id, action)`` for each id of a batch: ``write``, ``skip`` or ``conflict``.

    An id is a conflict when the batch or the ledger holds different content for it.  All
    sides are reduced to one row per id map-side first, so repeated copies of a record
    cost no shuffle.  The run id is part of the content: the same id under another run
    is a conflict in itself, so content is hashed only inside the batch's own runs and
    the other partitions give no more than their id columns.
    """
    runs = batch.select("extraction_run_id").distinct()
    incoming = batch.selectExpr("signal_id", "extraction_run_id as run", f"{_fingerprint(batch)} as fp").groupBy(
        "signal_id").agg(F.min("fp").alias("fp"), F.max("fp").alias("fp_max"), F.min("run").alias("run"))
    same = stored.join(runs, "extraction_run_id", "left_semi").select(*batch.columns)
    same_fp = same.selectExpr("signal_id", f"{_fingerprint(same)} as stored_fp").groupBy("signal_id").agg(
        F.min("stored_fp").alias("stored_fp"), F.max("stored_fp").alias("stored_fp_max"))
    others = stored.select("signal_id", "extraction_run_id").join(runs, "extraction_run_id", "left_anti").select(
        "signal_id", F.lit(True).alias("elsewhere")).distinct()
    action = (
        "case when fp <> fp_max or fp <> stored_fp or stored_fp <> stored_fp_max or elsewhere then 'conflict' "
        "when stored_fp is not null then 'skip' else 'write' end")
    return incoming.join(same_fp, "signal_id", "left").join(others, "signal_id", "left").selectExpr(
        "signal_id", f"{action} as action")


def append_to_ledger(records: DataFrame, path: str, key: str | None = None) -> int:
    """Append a batch; returns the number of rows written.

    The whole batch is checked first: a contract violation or a conflict raises before
    anything is written.  Rows stored already are skipped, so a retry writes nothing; a
    batch whose ``key`` is committed already is skipped without a look at its rows.

    The rows become visible with one commit.  When another writer commits meanwhile, the
    batch is held against its rows too before the next try.
    """
    log = CommitLog(records.sparkSession, path)
    if log.is_plain():
        raise ValueError(f"files without a commit log: {path}")
    batch = records.select(*SIGNAL.names).persist(StorageLevel.MEMORY_AND_DISK)

    def prepare(entries: list[dict]) -> dict | None:
        if key is not None and any(e.get("key") == key for e in entries):
            return None
        actions = append_actions(batch, committed_ledger(log, entries)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            clash = actions.where("action = 'conflict'").take(1)
            if clash:
                raise ConflictingContent(f"Conflicting content for signal_id {clash[0]['signal_id']}")
            pending = batch.dropDuplicates(["signal_id"]).join(actions.where("action = 'write'"), "signal_id", "left_semi")
            written, folder = Observation("ledger"), log.new_folder()
            pending.select(*SIGNAL.names).observe(written, F.count(F.lit(1)).alias("rows")).write.partitionBy(
                "extraction_run_id").parquet(log.full(folder))
        finally:
            actions.unpersist()
        rows = written.get["rows"]
        if not rows and key is None:
            log.remove(folder)
            return None
        return {"folder": folder, "rows": rows} | ({"key": key} if key is not None else {})

    try:
        require_valid(batch, "signal_record")
        entry = log.append(prepare)
        return entry["rows"] if entry else 0
    finally:
        batch.unpersist()


def append_quarantine(rejected: DataFrame, path: str, key: str | None = None) -> None:
    """Append rejected rows with one commit; a batch that is committed already writes nothing.

    A batch is known by its ``key``, or else by its content.
    """
    log = CommitLog(rejected.sparkSession, path)
    if key is None:
        content = content_fingerprint(rejected)
        if not content[0]:
            return
        key = ":".join(map(str, content))

    def prepare(entries: list[dict]) -> dict | None:
        if any(e["key"] == key for e in entries) or rejected.isEmpty():
            return None
        folder = log.new_folder()
        rejected.write.partitionBy("extraction_run_id").parquet(log.full(folder))
        return {"folder": folder, "key": key}

    log.append(prepare)


def write_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").parquet(path)


def write_dataset(demand: DataFrame, notes: DataFrame, truth: DataFrame, directory: str) -> None:
    """Write a corpus; nothing is written when any note breaks the evidence contract.

    The three tables take the place of the corpus before with one commit
    (:func:`pitsignal.sources.readers.dataset_path`).
    """
    require_valid(notes, "source_evidence")
    log = CommitLog(notes.sparkSession, directory)

    def prepare(entries: list[dict]) -> dict:
        folder = log.new_folder()
        demand.write.parquet(f"{log.full(folder)}/demand")
        notes.write.options(**JSON_TIMES).json(f"{log.full(folder)}/notes")
        truth.write.options(**JSON_TIMES).json(f"{log.full(folder)}/ground_truth")
        return {"folder": folder}

    log.append(prepare)


LANES = 8  # of 64 bits each


def multiset_fingerprint(df: DataFrame, row: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Per group: ``n`` and ``fingerprint``, which any change of the multiset of ``row`` texts changes.

    Two SHA-256 digests of a row are cut into ``LANES`` numbers that are added up lane by lane modulo
    2^64.  Sums combine map-side and take rows in any order; a repeated row counts each time.
    """
    half = LANES // 2
    digests = df.selectExpr(*by, f"sha2({row}, 256) as d0", f"sha2(concat('+', {row}), 256) as d1")
    lane = lambda i: f"cast(conv(substr(d{i // half}, {16 * (i % half) + 1}, 16), 16, 10) as decimal(20, 0))"
    sums = digests.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.expr(f"sum({lane(i)}) as l{i}") for i in range(LANES)))
    # A null row has no digest; it shows in the count only.
    texts = ", ".join(f"cast(cast(coalesce(l{i}, 0) as decimal(38, 0)) % 18446744073709551616 as string)" for i in range(LANES))
    return sums.selectExpr(*by, "n", f"sha2(concat_ws(':', cast(n as string), {texts}), 256) as fingerprint")


def content_fingerprint(df: DataFrame) -> tuple[int, str]:
    """Row count and fingerprint of a table's rows, whatever their order."""
    row = multiset_fingerprint(df, _as_json(sorted(df.columns))).first()
    return row["n"], row["fingerprint"]


def write_bundle(artifacts: dict[str, DataFrame], directory: str, run_id: str) -> str:
    """Save an evaluation run under its id, all of it with one commit.

    An identical rerun is accepted; different content never replaces a saved run, and is
    found before anything is written.  A run whose write was cut short is not saved.
    """
    spark: SparkSession = next(iter(artifacts.values())).sparkSession
    log = CommitLog(spark, f"{directory}/{run_id}")
    prints = {name: list(content_fingerprint(df)) for name, df in artifacts.items()}

    def prepare(entries: list[dict]) -> dict | None:
        if entries:
            saved = entries[0]["prints"]
            other = [name for name in prints if saved.get(name) != prints[name]]
            if other:
                raise FileExistsError(f"saved before with other content: {log.path}/{other[0]}")
            return None
        folder = log.new_folder()
        for name, df in artifacts.items():
            df.write.options(**JSON_TIMES).json(f"{log.full(folder)}/{name}")
        return {"folder": folder, "prints": prints}

    log.append(prepare)
    return f"{directory}/{run_id}"
