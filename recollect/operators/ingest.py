"""Ingest of the three sources: classify, skip, extract, normalise. Set-based and lazy."""

from pyspark.sql import Column, DataFrame, functions as F

from recollect import fixed
from recollect.functions import dates, rules
from recollect.functions.text import nz, strip

# --- shared ----------------------------------------------------------------------


def truncate(text: Column, max_chars: int | None = None) -> Column:
    """The whole text, or its start with a mark if it is longer than ``max_chars``."""
    if max_chars is None:
        return text
    keep = max_chars - fixed.TRUNCATE_RESERVE
    return F.when(F.length(text) <= max_chars, text).otherwise(
        F.concat(F.substring(text, 1, keep), F.lit(fixed.TRUNCATE_MARK)))


def index_doc(filename="filename", date_iso="date_iso", ocr="ocr_text", vlm="vlm_text") -> Column:
    """The text that is indexed: the four fields joined by line ends, NULL as empty."""
    return F.concat_ws("\n", *[nz(c) for c in (filename, date_iso, ocr, vlm)])


def already_indexed(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Keys that the index holds (a batch of point lookups)."""
    return keys.join(entries.select("uuid"), "uuid", "left_semi")


def decide(rows: DataFrame, entries: DataFrame | None, order: str, last: bool) -> DataFrame:
    """One ``new`` row per uuid: the first of a batch, or the last when re-indexing; stored and lost rows change status.

    The decision runs on (uuid, order) alone, with partial aggregation before the shuffle, so many copies of one uuid
    cost nothing extra and no text moves for it. Rows then meet their decision in one join.
    """
    pick = F.max(order) if last else F.min(order)
    decisions = rows.where("status = 'new'").groupBy("uuid").agg(pick.alias("_pick"))
    stored = F.lit(False)
    if entries is not None:
        decisions = decisions.join(entries.select("uuid", F.lit(True).alias("_stored")), "uuid", "left")
        stored = F.coalesce("_stored", F.lit(False))
    decisions = decisions.select("uuid", "_pick", stored.alias("_stored"))
    lost = F.col("_stored") | (F.col(order) != F.col("_pick"))
    status = F.when((F.col("status") == "new") & lost, "replaced" if last else "known").otherwise(F.col("status"))
    return rows.join(decisions, "uuid", "left").withColumn("status", status).drop("_pick", "_stored")


# --- messages ----------------------------------------------------------------------

def scan_messages(messages: DataFrame, handles: DataFrame, limit: int | None = None) -> DataFrame:
    """Messages with some text other than spaces, with their handle. In row order when limited."""
    m = messages.where(F.col("text").isNotNull() & (F.trim("text") != ""))
    if limit is not None:
        m = m.orderBy("rowid").limit(limit)
    return m.join(handles, "handle_rowid", "left")


def message_rows(messages: DataFrame, handles: DataFrame, limit: int | None = None) -> DataFrame:
    body = strip("text")
    handle = F.coalesce(F.nullif(strip("handle_id"), F.lit("")), F.lit("unknown"))
    direction = F.when(F.col("is_from_me") == 1, "from_me").otherwise("from_them")
    return scan_messages(messages, handles, limit).select(
        "rowid",
        F.concat(F.lit("imsg:"), F.coalesce(F.nullif("guid", F.lit("")), F.concat(F.lit("rowid:"), "rowid"))).alias("uuid"),
        F.concat(F.lit("message:"), handle).alias("filename"),
        dates.apple_iso("date_raw").alias("date_iso"),
        body.alias("ocr_text"),
        F.concat(F.lit("source=messages direction="), direction, F.lit(" handle="), handle).alias("vlm_text"),
        F.lit("").alias("image_path_used"),
        F.when(body == "", "empty").otherwise("new").alias("status"))


def ingest_messages(messages: DataFrame, handles: DataFrame, entries: DataFrame,
                    limit: int | None = None, force: bool = False) -> DataFrame:
    """Message rows with a status: ``new``, ``known`` or ``empty``."""
    rows = message_rows(messages, handles, limit)
    return decide(rows, None if force else entries, "rowid", last=force)


# --- documents -----------------------------------------------------------------------

def doc_uuid(real_path: Column) -> Column:
    return F.concat(F.lit("doc:"), F.substring(F.sha2(real_path, 256), 1, fixed.DOC_UUID_HEX))


def doc_meta(mtime_ns, size, rel_path, root_name: str, extractor) -> Column:
    return F.concat(F.lit("[docmeta] mtime_ns="), mtime_ns, F.lit(" size="), size,
                    F.lit(f"\nsource={fixed.DOC_SOURCE_TAG} root={root_name}\nrel_path="), rel_path,
                    F.lit("\nextractor="), extractor)


def classify_files(files: DataFrame, include_audio=False, include_images=False) -> DataFrame:
    return files.withColumn("ext", rules.extension("name")).withColumn(
        "status", rules.file_status("name", "rel_path", "outside_root", include_audio, include_images))


def skip_counts(classified: DataFrame) -> DataFrame:
    """Files per status. Files outside the root are dropped uncounted, so they have no row."""
    return classified.where("status <> 'outside'").groupBy("status").agg(F.count("*").alias("n"))


def split_unchanged(candidates: DataFrame, entries: DataFrame, force: bool = False) -> DataFrame:
    """Mark candidates whose stored time and size are the current ones.

    Only keys and the stored metadata of documents enter the join; file content is read after it.
    """
    if force:
        return candidates.withColumn("unchanged", F.lit(False))
    pattern = r"(?U)mtime_ns=(\d+)\s+size=(\d+)"
    stored = entries.where(F.col("uuid").startswith("doc:")).select(
        "uuid", F.regexp_extract(nz("vlm_text"), pattern, 1).alias("_m"),
        F.regexp_extract(nz("vlm_text"), pattern, 2).alias("_s"))
    same = (F.col("_m") == F.col("mtime_ns").cast("string")) & (F.col("_s") == F.col("size").cast("string"))
    return candidates.join(stored, "uuid", "left").withColumn(
        "unchanged", F.coalesce(same, F.lit(False))).drop("_m", "_s")


def plain_text(files: DataFrame) -> DataFrame:
    """Files whose text is already at hand."""
    return files.select("*", F.lit("plaintext").alias("extractor"), F.lit(None).cast("string").alias("error"))


def document_rows(extracted: DataFrame, root: str, root_name: str, max_chars: int | None = None) -> DataFrame:
    """Entry rows of extracted files: ``new``, ``empty`` (nothing in it) or ``error`` (empty after a failure).

    ``cut_chars`` counts what ``max_chars`` cuts off.
    """
    text = strip(nz("text"))
    real = F.concat(F.lit(root + "/"), F.col("rel_path"))
    status = F.when(text != "", "new").when(F.col("error").isNotNull(), "error").otherwise("empty")
    return extracted.withColumns({
        "uuid": doc_uuid(real),
        "filename": F.col("rel_path"),
        "date_iso": dates.mtime_iso("mtime_ns"),
        "ocr_text": truncate(text, max_chars),
        "cut_chars": F.lit(0) if max_chars is None else F.greatest(F.length(text) - max_chars, F.lit(0)),
        "vlm_text": doc_meta(F.col("mtime_ns"), F.col("size"), F.col("rel_path"), root_name, F.col("extractor")),
        "image_path_used": real,
        "status": status,
    }).drop("text")


def skipped_lists(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """The skipped-files report: every file of each kind, or the first ``cap`` in path order."""
    listed = rows.where(F.col("status").isin("empty", "error")).select(F.col("status").alias("kind"), "rel_path", "extractor", "error")
    if cap is None:
        return listed
    kinds = [listed.where(F.col("kind") == k).orderBy("rel_path").limit(cap) for k in ("empty", "error")]
    return kinds[0].unionByName(kinds[1])


def skipped_overflow(rows: DataFrame, cap: int) -> DataFrame:
    """How many files of each kind the report does not list."""
    return (rows.where(F.col("status").isin("empty", "error")).groupBy(F.col("status").alias("kind"))
            .agg(F.count("*").alias("n"), F.greatest(F.count("*") - cap, F.lit(0).cast("bigint")).alias("not_listed")))


# --- photos --------------------------------------------------------------------------

def local_image_path(prefer: str = "derivatives") -> Column:
    """The file to look at: the first preview on disk, or the original; ``prefer`` says which comes first."""
    preview = F.expr("try_element_at(filter(path_derivatives, d -> d.path <> '' AND d.exists), 1).path")
    original = F.when((F.col("path") != "") & F.col("path_exists"), F.col("path"))
    order = [preview, original] if prefer == "derivatives" else [original, preview]
    return F.coalesce(*order)


def ocr_text() -> Column:
    """Recognised strings joined by spaces; confidence plays no part."""
    return F.coalesce(F.expr(
        "array_join(transform(filter(detected_text, p -> p.text <> ''), p -> p.text), ' ')"), F.lit(""))


def photo_rows(photos: DataFrame, prefer: str = "derivatives", limit: int | None = None,
               skip_vlm: bool = False) -> DataFrame:
    """Entry rows of photos: ``new`` or ``no_path``. A missing caption counts as a caption error."""
    stills = photos.where(~F.col("is_movie"))
    if limit is not None:
        stills = stills.orderBy("seq").limit(limit)
    used = local_image_path(prefer)
    caption = F.lit("") if skip_vlm else strip(nz("caption"))
    failed = F.lit(False) if skip_vlm else F.col("caption").isNull()
    return stills.select(
        "seq", "uuid", nz("filename").alias("filename"), F.col("date_iso"),
        ocr_text().alias("ocr_text"), caption.alias("vlm_text"), used.alias("image_path_used"),
        failed.alias("caption_error"),
        F.when(used.isNull(), "no_path").otherwise("new").alias("status"))


def ingest_photos(photos: DataFrame, entries: DataFrame, prefer: str = "derivatives", limit: int | None = None,
                  force: bool = False, skip_vlm: bool = False) -> DataFrame:
    """Photo rows with a status: ``new``, ``known`` or ``no_path``. A stored photo is known even without a file."""
    rows = photo_rows(photos, prefer, limit, skip_vlm)
    if force:
        return rows
    stored = entries.select("uuid", F.lit(True).alias("_stored"))
    return rows.join(stored, "uuid", "left").withColumn(
        "status", F.when(F.col("_stored"), "known").otherwise(F.col("status"))).drop("_stored")


# --- counters --------------------------------------------------------------------------

def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))
