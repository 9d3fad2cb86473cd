"""Exact repeated-substring removal: suffixes in most-significant-digit passes, ordered only through the threshold.

Every place of a text starts a suffix; only its first ``width`` bytes (its window) matter. The passes split the windows
into groups by one digit after the other and drop a group as soon as it has one member; groups that are equal through
all digits are exactly the repeated windows. A row for each byte of the corpus would be many times the corpus, so the
windows travel in runs as long as their digits allow:

1. digit: a window's least ``gram``-gram under a hash, its anchor. Consecutive windows with the same anchor are one run,
   some 90 bytes long on average, and travel as one row. Equal windows have equal anchors at equal offsets.
2. digit: all the bytes that a run's windows cover. Runs equal in it are repeated as a whole and are done; one of them
   stays to stand for them all.
3. digit: for runs that are still open, the bytes common to ``block`` windows with neighbouring offsets from the anchor.
4. digit: for blocks that are still open, each window by itself, all of its bytes.

Every digit is a 64-bit hash of the bytes; later digits are only compared within equal first digits, so two windows
count as equal if 128 bits of hashes agree. Each pass counts by a group-by with partial sums and keeps the rows of
groups above one by a join on the digit, which Spark splits where a group is large; no group is gathered.

Defined cases: a null or empty text has no bytes; texts shorter than ``width`` lose nothing; equal rows are copies of
each other and lose all that they share; null ids are kept as ids; an empty table gives an empty result; other columns
are ignored. Memory of a task is some arrays over its longest text.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recollect.llm.frames import arrow_map, doc_bytes, drop, stage
from recollect.llm.hashing import BYTE, windows, word_bounds

LOW = np.uint64(0xFFFFFFFF)
KEY = ["doc_id", "text_hash"]
RUNS = "digit bigint, context bigint, doc_id bigint, text_hash bigint, anchor int, low int, high int"


def fingerprint(data: bytes, place: int = 0) -> int:
    """64 bits of a digest of the bytes, as a signed integer."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=place.to_bytes(8, "big")).digest(), "big", signed=True)


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive keys, by doubling."""
    have = 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    rest = width - have
    return np.minimum(key[:len(key) - rest], key[rest:]) if rest else key


def anchored_runs(data: bytes, width: int, gram: int):
    """(digit, anchor, low, high) of each run of windows with one anchor; window starts low..high, ends included."""
    hashes = windows(BYTE[np.frombuffer(data, dtype=np.uint8)], gram)
    key = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_least(key, width - gram + 1) & LOW).astype(np.int64)
    change = np.flatnonzero(np.diff(anchor))
    low, high = np.concatenate(([0], change + 1)), np.concatenate((change, [len(anchor) - 1]))
    return hashes[anchor[low]].view(np.int64), anchor[low], low, high


def _with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return doc_bytes(docs, id_col, text_col).select("doc_id", F.xxhash64("data").alias("text_hash"), "data")


def runs(keyed: DataFrame, width: int, gram: int) -> DataFrame:
    def step(batch: pa.RecordBatch) -> dict:
        parts = [[] for _ in range(7)]
        for doc, text, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            data = data.as_py() or b""
            if len(data) < width:
                continue
            digit, anchor, low, high = (x.tolist() for x in anchored_runs(data, width, gram))
            context = [fingerprint(data[p:q + width], a - p) for p, q, a in zip(low, high, anchor)]
            for part, values in zip(parts, (digit, context, [doc] * len(low), [text] * len(low), anchor, low, high)):
                part.extend(values)
        return dict(zip(("digit", "context", *KEY, "anchor", "low", "high"), parts))

    return arrow_map(keyed, step, RUNS, rows=1000)


def _repeated(rows: DataFrame, *digits: str) -> DataFrame:
    """The rows whose digits occur more than once. The groups are staged, so that Spark can split a large one in the join."""
    groups = stage(rows.groupBy(*digits).agg(F.count("*").alias("n")).where("n > 1").select(*digits), "groups")
    return rows.join(groups, list(digits), "left_semi")


def _with_text(keyed: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    other = lists.withColumnsRenamed({k: f"_{k}" for k in KEY})
    return keyed.join(other, keyed.doc_id.eqNullSafe(other._doc_id) & (keyed.text_hash == other._text_hash), how).drop("_doc_id", "_text_hash")


def _listed(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per text with its parts as a list, which is no longer than the text."""
    return rows.groupBy(*KEY).agg(F.collect_list(F.struct(*columns)).alias("parts"))


def blocks(keyed: DataFrame, open_runs: DataFrame, width: int, block: int) -> DataFrame:
    """(digit, core, doc_id, text_hash, low, high): window starts low..high whose common bytes have the fingerprint core."""
    texts = _with_text(keyed, _listed(open_runs, "digit", "anchor", "low", "high"))

    def step(batch: pa.RecordBatch) -> dict:
        rows = []
        for doc, text, data, parts in zip(*(batch.column(c).to_pylist() for c in (*KEY, "data", "parts"))):
            seen = set()
            for p in parts:
                a, low, high = p["anchor"], p["low"], p["high"]
                if (a, low) in seen:
                    continue
                seen.add((a, low))
                for j in range((a - high) // block, (a - low) // block + 1):
                    last, first = a - block * j, a - block * j - block + 1
                    rows.append((p["digit"], fingerprint(data[last:first + width], j), doc, text, max(first, low), min(last, high)))
        return dict(zip(("digit", "core", *KEY, "low", "high"), map(list, zip(*rows)) if rows else [[]] * 6))

    return arrow_map(texts, step, "digit bigint, core bigint, doc_id bigint, text_hash bigint, low int, high int", rows=500)


def single_windows(keyed: DataFrame, open_blocks: DataFrame, width: int) -> DataFrame:
    """(digit, bytes, doc_id, text_hash, low): each window of the open blocks with the fingerprint of its bytes."""
    texts = _with_text(keyed, _listed(open_blocks, "digit", "low", "high"))

    def step(batch: pa.RecordBatch) -> dict:
        digits, prints, docs, hashes, lows = [], [], [], [], []
        for doc, text, data, parts in zip(*(batch.column(c).to_pylist() for c in (*KEY, "data", "parts"))):
            starts = {s: p["digit"] for p in parts for s in range(p["low"], p["high"] + 1)}
            lows.extend(starts)
            digits.extend(starts.values())
            prints.extend(fingerprint(data[s:s + width]) for s in starts)
            docs.extend([doc] * len(starts))
            hashes.extend([text] * len(starts))
        return {"digit": digits, "bytes": prints, "doc_id": docs, "text_hash": hashes, "low": lows}

    return arrow_map(texts, step, "digit bigint, bytes bigint, doc_id bigint, text_hash bigint, low int", rows=500)


def repeated_starts(keyed: DataFrame, width: int, gram: int, block: int) -> DataFrame:
    """(doc_id, text_hash, low, high): starts low..high of windows that occur more than once."""
    every = stage(runs(keyed, width, gram), "runs")
    shared = stage(_repeated(every, "digit"), "shared-runs")
    drop(every)
    contexts = shared.groupBy("digit", "context").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "anchor", "low", "high")).alias("one"))
    contexts = stage(contexts, "contexts")
    whole = shared.join(contexts.where("n > 1").select("digit", "context"), ["digit", "context"], "left_semi")
    unsettled = contexts.groupBy("digit").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1")
    unsettled = stage(unsettled.select("digit"), "unsettled")
    open_runs = contexts.join(unsettled, "digit", "left_semi").select("digit", "one.*")
    cores = stage(blocks(keyed, open_runs, width, block), "blocks")
    single = stage(single_windows(keyed, _repeated(cores, "digit", "core"), width), "windows")
    drop(cores)
    same = _repeated(single, "digit", "bytes")
    found = stage(whole.select(*KEY, "low", "high").unionByName(same.select(*KEY, "low", F.col("low").alias("high"))), "repeats")
    drop(shared, contexts, single)
    return found


def remove_repeats(docs: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text", gram: int = 160, block: int = 32) -> DataFrame:
    """doc_id, n_bytes, the maximal removed runs of bytes as starts and ends, and the remaining bytes as kept, of every row.

    ``gram`` and ``block`` (``gram`` + ``block`` <= ``width``) change how much travels, not the result.
    """
    gram = max(1, min(gram, width // 2))
    block = max(1, min(block, width - gram))
    keyed = _with_key(docs, id_col, text_col)
    lists = _listed(repeated_starts(keyed, width, gram, block), "low", "high")

    def step(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": batch.column("doc_id"), "n_bytes": [], "starts": [], "ends": [], "kept": []}
        for data, parts in zip(batch.column("data"), batch.column("parts")):
            data = np.frombuffer(data.as_py() or b"", dtype=np.uint8)
            change = np.zeros(len(data) + 1, dtype=np.int64)
            for p in parts.as_py() or ():
                change[p["low"]] += 1
                change[p["high"] + width] -= 1
            gone = np.cumsum(change[:-1]) > 0
            starts, ends = word_bounds(gone)
            out["n_bytes"].append(len(data))
            out["starts"].append(starts.tolist())
            out["ends"].append(ends.tolist())
            out["kept"].append(data[~gone].tobytes())
        return out

    return arrow_map(_with_text(keyed, lists, "left"), step, "doc_id bigint, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary", rows=1000)


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op1."""
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                        F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
