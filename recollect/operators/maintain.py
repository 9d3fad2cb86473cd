"""Upserts, pruning, compaction and run metrics."""

import contextlib
import json
import time

from pyspark.sql import Column, DataFrame, Observation, functions as F

from recollect import schemas
from recollect.functions import rules
from recollect.functions.dates import elapsed


def upsert(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with ``new`` put in place of equal uuids.

    ``new`` holds one row per uuid. Only its keys are needed to drop old rows,
    so the whole change is one anti-join.
    """
    cols = schemas.ENTRY_COLS
    return entries.select(*cols).join(new.select("uuid"), "uuid", "left_anti").select(*cols).unionByName(new.select(*cols))


def update_postings(postings: DataFrame, entries: DataFrame, new: DataFrame, new_postings: DataFrame) -> DataFrame:
    """Postings after an upsert: those of replaced entries go, the new ones come."""
    gone = entries.join(new.select("uuid"), "uuid", "left_semi").select("seq")
    cols = schemas.POSTINGS.fieldNames()
    return postings.join(gone, "seq", "left_anti").select(*cols).unionByName(new_postings.select(*cols))


def find_noise(entries: DataFrame) -> DataFrame:
    """uuid, filename of stored rows in vendored or generated directories, whatever their source."""
    return entries.where(rules.is_prunable("filename")).select("uuid", "filename")


def prune(entries: DataFrame) -> DataFrame:
    """The entries that stay: one filter, no join, as the noise condition is a function of the row."""
    return entries.where(~rules.is_prunable("filename"))


def prune_postings(postings: DataFrame, entries: DataFrame) -> DataFrame:
    """The postings that stay."""
    gone = entries.where(rules.is_prunable("filename")).select("seq")
    return postings.join(gone, "seq", "left_anti")


def run_prune(store, dry_run: bool = False, yes: bool = False, compact: bool = False, sample: int = 10) -> dict:
    """Prune a stored corpus, guarded: nothing is deleted without ``yes``, nor while another run
    holds the index. ``code`` is 1 on refusal. What stays isn't written again."""
    entries = store.entries()
    noise = find_noise(entries)
    total = noise.count()
    shown = [tuple(r) for r in noise.orderBy("uuid").limit(max(0, sample)).collect()]
    report = {"matched": total, "sample": shown, "deleted": 0, "code": 0}
    if dry_run:
        return report
    if total and not yes:
        return {**report, "code": 1}
    with index_lock(store.spark, store.root) as held:
        if not held:
            return {**report, "code": 1}
        if total:
            store.delete(rules.is_prunable("filename"))
            report["deleted"] = total
        if compact:
            store.compact()
    return report


# ===== run metrics =======================================================================


def progress_metrics(counts: DataFrame, seconds) -> DataFrame:
    """Counts with rate and elapsed time; ``counts`` has one row per status."""
    return counts.select("status", "n", F.round(F.col("n") / seconds, 3).alias("per_second"),
                         F.round(seconds, 1).alias("elapsed_s"), elapsed(seconds).alias("elapsed_human"))


STATUSES = ["new", "known", "replaced", "unchanged", "empty", "error", "no_path", "video", "media", "hidden", "temp", "noise", "outside", "movie"]


def observed(rows: DataFrame, **more: Column) -> tuple[DataFrame, Observation]:
    """``rows`` counted while they are written: how many of each status, and ``more`` aggregates. The counts are there after the write."""
    counts = Observation("run")
    each = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES]
    other = F.count(F.when(~F.col("status").isin(STATUSES), 1)).alias("other")
    return rows.observe(counts, *each, other, *[c.alias(k) for k, c in more.items()]), counts


def document_summary(n: dict) -> dict:
    """The counters of a document run, from its counts by status."""
    get = lambda k: n.get(k, 0)
    return {"indexed_this_run": get("new"), "skipped_unchanged": get("unchanged"),
            "skipped_empty": get("empty") + get("error"), "errors": get("error"),
            "skip_counts": {"video": get("video"), "hidden": get("hidden"), "image_or_audio": get("media"),
                            "temp_prefix": get("temp"), "noise_dirs": get("noise")}}


def _hadoop(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark, path: str, text: str) -> None:
    """A small file on any file system that Spark reaches, replaced as a whole."""
    fs, target = _hadoop(spark, path)
    _, part = _hadoop(spark, path + ".part")
    fs.mkdirs(target.getParent())
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def write_report(spark, path: str, payload: dict, started: float, finished: bool = True) -> dict:
    """A run report as a small JSON file."""
    now = time.time()
    full = {**payload, "started_at_unix": started, "updated_at_unix": now, "elapsed_s": round(now - started, 3),
            "ingest_finished": finished}
    write_text(spark, path, json.dumps(full, indent=2, ensure_ascii=False))
    return full


# ===== one run at a time ====================================================================


@contextlib.contextmanager
def index_lock(spark, index: str):
    """Yields whether this process holds the index's lock file; never waits.

    The file lies beside the index, on the file system that all users of it share. A run that was killed leaves it
    behind; it is then removed by hand.
    """
    fs, path = _hadoop(spark, index.rstrip("/") + ".lock")
    fs.mkdirs(path.getParent())
    held = fs.createNewFile(path)
    try:
        yield held
    finally:
        if held:
            fs.delete(path, False)
