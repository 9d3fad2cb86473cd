"""Incremental ingest into a stored corpus: documents as a batch run over a complete listing, messages as a file stream.

A run that is repeated writes the same rows again, because an upsert is by uuid.
"""

import time

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from recollect import schemas
from recollect.operators import ingest, maintain
from recollect.session import drop_staged, stage
from recollect.sources import extract
from recollect.sources.store import CorpusStore, next_seq

MESSAGES = "rowid bigint, guid string, text string, date_raw bigint, is_from_me int, handle_rowid bigint"


def store_rows(store: CorpusStore, rows: DataFrame, now: float) -> int:
    """Give new rows their place and time, and upsert them. Staged first: the numbers must not change on a retry."""
    new = rows.where("status = 'new'").withColumn(
        "seq", F.monotonically_increasing_id() + next_seq(store)).withColumn("ingested_at", F.lit(float(now)))
    kept = stage(new.select(*schemas.ENTRY_COLS), "batch")
    n = kept.count()
    if n:
        store.apply(kept)
    drop_staged(kept)
    return n


def stored_entries(store: CorpusStore) -> DataFrame:
    return store.entries() if store.exists() else store.spark.createDataFrame([], schemas.ENTRIES)


def document_batch(store: CorpusStore, files: DataFrame, root: str, force=False, include_audio=False, include_images=False,
                   max_chars: int | None = None, limit: int | None = None, fallback=None) -> DataFrame:
    """A status for each listed file, and the entry rows of those that are read: candidates that changed or are new.

    Only names, times and sizes decide which files are read. ``limit`` reads the first candidates in path order.
    """
    base = extract.file_system(root)[1].rstrip("/")
    marked = ingest.classify_files(files, include_audio, include_images)
    skipped = marked.where("status <> 'candidate'").select("rel_path", "status")
    found = marked.where("status = 'candidate'").drop("status")
    if limit is not None:
        found = found.orderBy("rel_path").limit(limit)
    found = found.withColumn("uuid", ingest.doc_uuid(F.concat(F.lit(base + "/"), "rel_path")))
    found = ingest.split_unchanged(found, stored_entries(store), force)
    read = extract.extract(extract.with_content(root, found.where(~F.col("unchanged"))), fallback)
    rows = ingest.document_rows(read, base, base.rsplit("/", 1)[-1], max_chars)
    same = found.where("unchanged").select("rel_path", F.lit("unchanged").alias("status"))
    return rows.unionByName(skipped.unionByName(same), allowMissingColumns=True)


def ingest_documents(spark: SparkSession, root: str, store: CorpusStore, report: str | None = None, **options) -> dict:
    """One run over all files below ``root``; its counters. With ``report``, they and the skipped files are written there."""
    started = time.time()
    batch, seen = maintain.observed(document_batch(store, extract.walk(spark, root), root, **options), cut_chars=F.coalesce(F.sum("cut_chars"), F.lit(0)))
    rows = stage(batch, "documents")
    store_rows(store, rows, started)
    counts = maintain.document_summary(seen.get) | {"cut_chars": seen.get["cut_chars"]}
    if report:
        ingest.skipped_lists(rows).write.mode("overwrite").json(f"{report.rstrip('/')}/skipped")
        maintain.write_report(spark, f"{report.rstrip('/')}/documents.json", counts, started)
    drop_staged(rows)
    return counts


def ingest_rows(store: CorpusStore, rows: DataFrame, name: str, report: str | None = None) -> dict:
    """Stores message or photo rows that are new; counts of every status."""
    started = time.time()
    rows, seen = maintain.observed(rows)
    rows = stage(rows, name)
    store_rows(store, rows.drop("seq", "ingested_at"), started)
    counts = {k: n for k, n in seen.get.items() if n}
    if report:
        maintain.write_report(store.spark, f"{report.rstrip('/')}/{name}.json", counts, started)
    drop_staged(rows)
    return counts


def stream_messages(spark: SparkSession, path: str, handles: DataFrame, store: CorpusStore, checkpoint: str,
                    force: bool = False) -> StreamingQuery:
    """New Parquet files of chat rows below ``path``, whatever their age."""
    stream = spark.readStream.schema(MESSAGES).option("maxFileAge", "36500d").parquet(path)

    def batch(df: DataFrame, _: int) -> None:
        store_rows(store, ingest.ingest_messages(df, handles, stored_entries(store), force=force), time.time())

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
