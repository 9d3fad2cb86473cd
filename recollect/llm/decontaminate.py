"""Benchmark decontamination: a broadcast hash set of test n-grams, a scan of the documents' word windows, verified hits.

The benchmark is dealt in blocks of at most ``block_words`` words, so each broadcast set has that size at most; every
block is held against every document. One block (the usual case) is one narrow pass without a shuffle. Several blocks are
collected, broadcast, scanned and dropped one after the other, so the driver holds one at a time; findings are staged.

Defined cases: a null text or one without words has no hits; items without words are no items; items of fewer than
``n`` words are one window of all their words; equal items all count; an item without an id hits words, but isn't listed; documents with equal or null ids are separate rows,
each judged by its own text, over any number of blocks; an empty benchmark hits nothing; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from recollect.llm.frames import arrow_filter, arrow_map, doc_bytes, stage
from recollect.llm.hashing import LOWER, byte_class, windows, word_bounds, word_hashes

#: Bytes of words: digits, letters, and everything beyond ASCII.
WORD = byte_class(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
BITS = 20
#: Rows whose findings a task holds at once.
BATCH = 500

RESULT = "doc_id bigint, n_words bigint, n_hit bigint, starts array<bigint>, ends array<bigint>, items array<string>"
#: One block's findings: a row's key, and its hit runs by words (first, behind the last) and by bytes.
FINDINGS = "doc_id bigint, digest binary, n_words bigint, runs array<array<bigint>>, items array<string>"


def words_of(data: bytes | None):
    """Lower-cased bytes of a text, and the bounds and hashes of its words."""
    low = LOWER[np.frombuffer(data or b"", dtype=np.uint8)]
    starts, ends = word_bounds(WORD[low])
    return low, starts, ends, word_hashes(low, starts, ends)


def _plain(low, starts, ends) -> bytes:
    return b" ".join(low[s:e].tobytes() for s, e in zip(starts, ends))


class NgramSet:
    """The windows of some items: sorted hashes by width, a bit table before them, and the words behind each hash."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        found: dict[tuple[int, int], dict[bytes, set[str | None]]] = {}
        for item, data in items:
            low, starts, ends, hashes = words_of(data)
            width = min(n, len(starts))
            if width:
                for i, h in enumerate(windows(hashes, width).tolist()):
                    words = _plain(low, starts[i:i + width], ends[i:i + width])
                    found.setdefault((width, h), {}).setdefault(words, set()).add(item)
        self.found = found
        self.by_width = {}
        for width in sorted({w for w, _ in found}):
            keys = np.array(sorted(h for w, h in found if w == width), dtype=np.uint64)
            bits = np.zeros(1 << BITS, dtype=bool)
            bits[keys >> np.uint64(64 - BITS)] = True
            self.by_width[width] = keys, bits

    def runs(self, data: bytes | None):
        """Words, hit runs as (first word, word behind the last, first byte, byte behind the last), items with occurring windows."""
        low, starts, ends, hashes = words_of(data)
        hit = np.zeros(len(starts) + 1, dtype=np.int64)
        items: set[str] = set()
        for width, (keys, bits) in self.by_width.items():
            seen = windows(hashes, width)
            at = np.flatnonzero(bits[seen >> np.uint64(64 - BITS)])
            at = at[keys[np.minimum(np.searchsorted(keys, seen[at]), len(keys) - 1)] == seen[at]]
            for i in at.tolist():  # verify by the words themselves
                of = self.found[width, int(seen[i])].get(_plain(low, starts[i:i + width], ends[i:i + width]))
                if of:
                    items |= of
                    hit[i] += 1
                    hit[i + width] -= 1
        first, last = word_bounds(np.cumsum(hit[:-1]) > 0)
        runs = np.stack([first, last, starts[first], ends[last - 1] if len(last) else last], axis=1).astype(np.int64)
        return len(starts), runs, sorted(items - {None})

    def scan(self, data: bytes | None):
        """Words, hit words, byte spans of hit runs, items with occurring windows."""
        words, runs, items = self.runs(data)
        return words, int((runs[:, 1] - runs[:, 0]).sum()), runs[:, 2], runs[:, 3], items


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> list[DataFrame]:
    """(item, data) in blocks of at most ``block_words`` words each (one item alone may be longer); none without words.

    Block numbers come from a running sum per hash bucket, so that no task sorts all items.
    """
    size = F.size(F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("data"), size.alias("words")).where("words > 0")
    total = items.agg(F.sum("words")).first()[0] or 0
    buckets = -(-total // block_words)
    if buckets <= 1:
        return [items.select("item", "data")] if total else []
    order = Window.partitionBy("bucket").orderBy("item", "data")
    dealt = stage(items.withColumn("bucket", F.pmod(F.xxhash64("item", "data"), F.lit(buckets)))
                  .withColumn("part", F.floor((F.sum("words").over(order) - 1) / block_words)), "benchmark-blocks")
    keys = dealt.select("bucket", "part").distinct().collect()
    return [dealt.where((F.col("bucket") == k.bucket) & (F.col("part") == k.part)).select("item", "data") for k in keys]


def _broadcast(block: DataFrame | None, spark, n: int):
    """The set of one block, sent to the executors."""
    return spark.sparkContext.broadcast(NgramSet([(r.item, bytes(r.data)) for r in block.collect()] if block is not None else [], n))


def _digest(text_col: str) -> F.Column:
    """With the id, the key of a row: rows that share both have the same findings."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))))


def find(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", block_words: int = 2_000_000) -> DataFrame:
    """Per document: words, hit words, byte spans of the hit runs, and the items whose windows occur."""
    parts = blocks(benchmark, item_col, item_text_col, block_words) or [None]
    return (_one_block if len(parts) == 1 else _keyed)(docs, parts, n, id_col, text_col).select("doc_id", "n_words", "n_hit", "starts", "ends", "items")


def _one_block(docs: DataFrame, parts: list, n: int, id_col: str, text_col: str) -> DataFrame:
    grams = _broadcast(parts[0], docs.sparkSession, n)

    def step(batch: pa.RecordBatch) -> dict:
        rows = [grams.value.scan(x) for x in batch.column(1).to_pylist()]
        words, hits, starts, ends, items = zip(*rows)
        return {"doc_id": batch.column(0), "n_words": words, "n_hit": hits, "starts": [x.tolist() for x in starts],
                "ends": [x.tolist() for x in ends], "items": items}

    return arrow_map(doc_bytes(docs, id_col, text_col), step, RESULT, rows=BATCH)


def _keyed(docs: DataFrame, parts: list, n: int, id_col: str, text_col: str) -> DataFrame:
    """The findings with each row's key (doc_id, digest). Several blocks' findings are joined by it; texts don't move."""
    data = doc_bytes(docs, id_col, text_col, _digest(text_col).alias("digest"))
    passes = []
    for k, block in enumerate(parts):
        grams = _broadcast(block, docs.sparkSession, n)

        def step(batch: pa.RecordBatch, grams=grams) -> dict:
            words, runs, items = zip(*[grams.value.runs(x) for x in batch.column(1).to_pylist()])
            return {"doc_id": batch.column(0), "digest": batch.column(2), "n_words": words, "runs": [x.tolist() for x in runs], "items": items}

        found = arrow_map(data, step, FINDINGS, rows=BATCH)
        passes.append(stage(found.where(F.size("runs") > 0).dropDuplicates(["doc_id", "digest"]) if k else found, "findings"))
        grams.unpersist()
    rows, more = passes[0], passes[1] if len(passes) > 1 else passes[0].where("false")
    for x in passes[2:]:
        more = more.unionByName(x)
    more = more.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(
        F.flatten(F.collect_list("runs")).alias("more_runs"), F.flatten(F.collect_list("items")).alias("more_items"))
    joined = rows.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")

    def merge(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": batch.column("doc_id"), "digest": batch.column("digest"), "n_words": batch.column("n_words"), "n_hit": [], "starts": [], "ends": [], "items": []}
        for a, b, p, q in zip(*(batch.column(c).to_pylist() for c in ("runs", "more_runs", "items", "more_items"))):
            whole: list[list[int]] = []
            for run in sorted(a + (b or [])):
                if whole and run[0] <= whole[-1][1]:
                    whole[-1][1], whole[-1][3] = max(whole[-1][1], run[1]), max(whole[-1][3], run[3])
                else:
                    whole.append(list(run))
            out["n_hit"].append(sum(x[1] - x[0] for x in whole))
            out["starts"].append([x[2] for x in whole])
            out["ends"].append([x[3] for x in whole])
            out["items"].append(sorted({*p, *(q or [])}))
        return out

    return arrow_map(joined, merge, f"digest binary, {RESULT}")


def contaminated(percent: int = 5) -> F.Column:
    """At least ``percent`` of the words are hit, and one at least."""
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", percent: int = 5, n: int = 13, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = 2_000_000) -> DataFrame:
    """The documents without contamination: contaminated ones go ("documents"), or hit spans are cut out ("spans").

    With one block of n-grams, documents are filtered as they are scanned, without a shuffle; with several, the findings
    are joined by id and text. Columns stay as they are; every row is judged by its own text, whatever its id.
    """
    parts = blocks(benchmark, item_col, item_text_col, block_words)
    if remove == "documents" and len(parts) <= 1:
        grams = _broadcast((parts or [None])[0], docs.sparkSession, n)

        def keep(text: str | None) -> bool:
            words, hits, *_ = grams.value.scan((text or "").encode("utf-8", "replace"))
            return not (hits > 0 and 100 * hits >= percent * words)

        return arrow_filter(docs, text_col, keep)
    found = _keyed(docs, parts or [None], n, id_col, text_col)
    own = F.col(id_col).cast("bigint").eqNullSafe(F.col("_id")) & (_digest(text_col) == F.col("_digest"))
    key = [F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")]
    if remove == "documents":
        return docs.join(found.where(contaminated(percent)).select(*key).distinct(), own, "left_anti")
    cut = found.where("n_hit > 0").groupBy(*key).agg(F.first("starts").alias("_starts"), F.first("ends").alias("_ends"))
    joined = docs.join(cut, own, "left")
    data = F.col(text_col).cast("binary")
    bounds = F.arrays_zip(F.concat(F.array(F.lit(0).cast("bigint")), "_ends").alias("a"), F.concat("_starts", F.array(F.octet_length(data).cast("bigint"))).alias("b"))
    kept = F.transform(bounds, lambda x: F.substring(data, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")))
    text = F.decode(F.aggregate(kept, F.lit(b""), lambda s, x: F.concat(s, x)), "utf-8")
    return joined.withColumn(text_col, F.when(F.col("_digest").isNull(), F.col(text_col)).otherwise(text)).drop("_id", "_digest", "_starts", "_ends")


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op8."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))
