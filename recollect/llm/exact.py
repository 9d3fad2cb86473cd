"""Exact duplicates in DataFrame functions only: two passes over a Bloom filter of text digests.

Texts are equal when they are identical after lower-casing A-Z; their identity is the SHA-256 of that form. The first
pass counts, for every digest, ``HASHES`` cells of one bucket of the filter; the cells that two or more rows have hit
are its set bits. The second pass tests all rows against the filter: a row with an unset cell is certainly single and
passes straight through, the others are possible repeats, and only these shuffle, to be grouped by their whole digest.
A false positive costs a shuffled row and never changes a result.

The filter has ``per_row`` cells a row and is broadcast; it never has more than ``most_cells`` of them (128 MB). More rows
are dealt by their digests into several filters, which are built and tested one after the other. Counts are summed
before they are shuffled, so a text with a third of all rows is one row a task there; in the join of the possible
repeats with their groups Spark splits such a key.

Defined cases: a null text counts as empty; null ids are smaller than all others; of rows equal in text and id one
stays; an empty table gives no rows; other columns are ignored by ``groups`` and kept by ``deduplicate``.
"""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from recollect.llm.frames import drop, stage, stage_narrow

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = 3
#: Bits of a bitmap of bitmap_construct_agg.
BITS = 1 << 15
#: Parts of the digests; a filter takes a range of them.
SLOTS = 1 << 12


def digest_of(text: Column) -> Column:
    return F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), 256)


def _slot(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit("slot")), F.lit(SLOTS)).cast("int")


def _bucket(digest: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit("bucket")), F.lit(buckets))


def _bits(digest: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(BITS)) for i in range(HASHES)]


def repeat_filter(digests: DataFrame, buckets: int) -> DataFrame:
    """(bucket, bitmap): the cells that two or more rows have hit; at most ``buckets`` rows of 4 KB."""
    hit = digests.select(_bucket(F.col("digest"), buckets).alias("bucket"), F.explode(F.array_distinct(F.array(*_bits(F.col("digest"))))).alias("bit"))
    twice = hit.groupBy("bucket", "bit").agg(F.count("*").alias("n")).where("n > 1")
    return twice.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def mark(rows: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """``rows``, which have a digest, with ``possible``: whether the filter has all cells of the row."""
    def set_in(bitmap: Column, bit: Column) -> Column:
        byte = F.ascii(F.decode(F.substring(bitmap, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
        return F.pmod(byte / F.pow(F.lit(2), bit % 8), F.lit(2)) >= 1

    every = F.lit(True)
    for bit in _bits(F.col("digest")):
        every = every & set_in(F.col("bitmap"), bit)
    kept = rows.columns
    return rows.withColumn("bucket", _bucket(F.col("digest"), buckets)).join(F.broadcast(found), "bucket", "left").select(
        *kept, F.coalesce(every, F.lit(False)).alias("possible"))


def _filters(digests: DataFrame, per_row: int, most_cells: int) -> Iterator[tuple[Column, DataFrame, int]]:
    """For each filter the condition of its slots, its bitmaps, staged, and the number of its buckets."""
    rows = digests.count()
    filters = min(SLOTS, max(1, -(-rows * per_row // most_cells)))
    buckets = max(1, -(-min(most_cells, -(-rows // filters) * per_row) // BITS))
    for i in range(filters):
        own = F.col("slot").between(SLOTS * i // filters, SLOTS * (i + 1) // filters - 1)
        yield own, stage_narrow(repeat_filter(digests.where(own), buckets), "repeat-filter"), buckets


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_row: int = 16, most_cells: int = 1 << 30) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row; the row with the largest id stays.

    The text is read once; digests are staged sorted by slot, so that a filter reads its own range of them.
    """
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), digest_of(F.col(text_col)).alias("digest"))
    rows = stage_narrow(narrow.withColumn("slot", _slot(F.col("digest"))).sortWithinPartitions("slot").withColumn("row", F.monotonically_increasing_id()), "digests")
    marked = []
    for own, found, buckets in _filters(rows, per_row, most_cells):
        marked.append(stage_narrow(mark(rows.where(own), found, buckets), "marked"))
        drop(found)
    every = _all(marked)
    possible = every.where("possible")
    same = stage(possible.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size")), "repeats")
    alone = every.where("NOT possible").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    shared = possible.join(same, "digest").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("digest").alias("text_sha256"))
    return alone.unionByName(shared)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_row: int = 16, most_cells: int = 1 << 30) -> DataFrame:
    """The rows that stay, with all columns. Single rows pass straight through; of possible repeats each task sends one row a text.

    Of rows equal in text and id the one with the largest hash of all columns stays. The table is read once for each filter.
    """
    digests = stage_narrow(docs.select(digest_of(F.col(text_col)).alias("digest")).withColumn("slot", _slot(F.col("digest"))).sortWithinPartitions("slot"), "digests")
    whole = docs.select(F.struct("*").alias("whole"), digest_of(F.col(text_col)).alias("digest"))
    whole = whole.withColumn("slot", _slot(F.col("digest")))
    out = []
    for own, found, buckets in _filters(digests, per_row, most_cells):
        marked = mark(whole.where(own), found, buckets)
        order = F.struct(F.col("whole")[id_col].cast("bigint"), F.xxhash64("whole"))
        best = marked.where("possible").groupBy("digest").agg(F.max_by("whole", order).alias("whole"))
        out.append(marked.where("NOT possible").select("whole").unionByName(best.select("whole")))
    return _all(out).select("whole.*")
