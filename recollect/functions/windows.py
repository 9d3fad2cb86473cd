"""Windows of texts as hashes: an equi-join on these finds the aliases that a text holds.

The texts of a batch are one array of characters, and the hashes of all windows of one length are differences of its running sums.
Only windows that a filter of the aliases' hashes holds leave the task; a hash that collides only adds a row, and hits are verified.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recollect.functions.struck import MIX, hash_filter, in_filter

BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
#: Characters that are looked at together.
CHARACTERS = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(texts: list[str], lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, which text) of all windows of each length."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    n = len(letters)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * _powers(BASE, n), dtype=np.uint64)])
    back = _powers(UNBASE, n)
    for size in lengths:
        if size <= n:
            h = (sums[size:] - sums[:n - size + 1]) * back[:n - size + 1] * MIX + np.uint64(size)
            whole = row[:n - size + 1] == row[size - 1:]
            yield (h ^ (h >> np.uint64(29)))[whole], row[:n - size + 1][whole]


def _whole(column: pa.Array) -> Iterator[np.ndarray]:
    """The hash of each text as a window of its own."""
    out = np.zeros(len(column), np.uint64)
    texts = column.to_pylist()
    for size in {len(t) for t in texts if t}:
        which = [i for i, t in enumerate(texts) if t and len(t) == size]
        for h, row in window_hashes([texts[i] for i in which], [size]):
            out[np.array(which)[row]] = h
    yield out


def with_hash(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``_hash`` of a column of texts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _hash bigint"
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = next(_whole(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], names=[*batch.schema.names, "_hash"])

    return df.mapInArrow(run, schema)


def held_windows(df: DataFrame, key: str, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """key, _hash: the windows of each text that are, but for collisions, one of the needles; each once a row."""
    lengths = sorted(r[0] for r in needles.selectExpr(f"length(`{needle}`)").distinct().collect() if r[0])
    shared = df.sparkSession.sparkContext.broadcast(hash_filter(needles, needle, _whole, 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bits = np.frombuffer(shared.value[0], np.uint8), shared.value[1]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in _parts(texts):
                found = [(h[ok], row[ok] + start) for h, row in window_hashes(texts[start:end], lengths) for ok in [in_filter(h, held, bits)]]
                if found:
                    h, row = (np.concatenate(x) for x in zip(*found, strict=True))
                    once = np.unique(np.rec.fromarrays([row, h.view(np.int64)], names="row,hash"))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(once["row"])), pa.array(once["hash"])], names=[key, "_hash"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, _hash bigint")


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Texts of about ``CHARACTERS`` together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHARACTERS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
