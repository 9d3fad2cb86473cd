"""Order-preserving packing of token streams: cuts by dynamic programming with a monotone queue.

The documents of a partition, each followed by an end id, form one stream. A stream is cut into sequences of at most
``length`` tokens so that padding plus penalties is least. Cuts may stand at document ends (free), sentence ends, and,
inside stretches without either, at every ``step``-th token. With candidates P[0] < P[1] < ..., the best cost up to j is

    f[j] = penalty[j] + min( min over P[j] - P[i] <= length of f[i] + length - (P[j] - P[i]),
                             min over P[j] - P[i] in exact powers of two of f[i] + extra )

and the inner minimum of f[i] + P[i] over the sliding window comes from a queue kept in rising order: O(1) a candidate.
Streams are handled in chunks of ``chunk`` tokens, so a task's memory is bounded by a chunk and its longest document.

Defined cases: a null or empty text is its end id alone; a document longer than a sequence spans several; each token
lies in exactly one piece; repeated rows and ids are packed row by row; an empty table has no pieces; other columns
are ignored. Sequence ids are unique: partition number times 2^33 plus a running number. Every partition ends its last
sequence, so the padding of that end is at most one sequence for a partition or chunk.
"""

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from recollect.llm.bpe import KEPT_PIECES, Cutter, Merges, merged, worker_table
from recollect.llm.tokens import default_vocabulary

LENGTH = 1024
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, `offset` bigint"


class _Pieces(dict):
    """Piece to ids as bytes; what is missing is encoded and kept, up to a bound."""

    def __init__(self, merges: Merges):
        self.merges, self.quick = merges, ordered_ranks(merges)
        self.bytes = {p: np.uint32(i).tobytes() for p, i in merges.ids.items()}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT_PIECES:
            self.clear()
        if self.quick is not None:
            ids = array("I", self.quick.encode_ordinary(piece)).tobytes()
        else:
            parts, _ = merged(piece.encode("utf-8", "replace"), self.merges.ranks)
            ids = b"".join(self.bytes[p] for p in parts if p is not None)
        self[piece] = ids
        return ids


def ordered_ranks(merges: Merges):
    """A native encoder of single pieces, for vocabularies whose ids follow the order of their merges; else None."""
    order = [merges.ids.get(a + b) for a, b in merges.ranks]
    if None in order or order != sorted(order) or len(set(order)) < len(order) or len(order) + 256 != len(merges.ids):
        return None
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=merges.ids, special_tokens={})


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers; pieces are encoded once while they stay in the table."""

    def __init__(self, merges: Merges, home: dict):
        self.merges, self.cutter = merges, Cutter(merges.special)
        if "pieces" not in home:
            home["pieces"] = _Pieces(merges)
        self.table = home["pieces"]

    def encode(self, text: str) -> np.ndarray:
        out = []
        for run, special in self.cutter.runs(text):
            out.append(b"".join(map(self.table.__getitem__, self.cutter.pieces(run))))
            if special is not None:
                out.append(np.uint32(self.merges.special[special]).tobytes())
        return np.frombuffer(b"".join(out), dtype="<u4")


def sentence_ends(ids: dict[bytes, int]) -> np.ndarray:
    """Which ids end a sentence or line: their bytes hold a newline or end in a full stop, question or exclamation mark."""
    table = np.zeros(max(ids.values(), default=0) + 2, dtype=bool)
    for symbol, i in ids.items():
        table[i] = b"\n" in symbol or symbol[-1:] in (b".", b"!", b"?")
    return table


def candidates(stream: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, sentence: int, inner: int, step: int):
    """Places where a cut may stand, from 0 to the stream's end, with the penalty of each."""
    kind = np.zeros(len(stream) + 1, dtype=np.int8)
    kind[1:][ends[np.minimum(stream, len(ends) - 1)]] = 1
    kind[doc_ends] = 2
    kind[0] = 2
    firm = np.flatnonzero(kind)
    extra = (np.diff(firm) - 1) // step
    before = np.cumsum(extra) - extra
    kind[np.repeat(firm[:-1], extra) + step * (np.arange(extra.sum()) - np.repeat(before, extra) + 1)] = 3
    places = np.flatnonzero(kind)
    return places, np.array([0, sentence, 0, inner])[kind[places]]


def cuts(places: np.ndarray, costs: np.ndarray, length: int, extra: int) -> list[int]:
    """The candidate places chosen as sequence ends, least in total cost; gaps between places are at most ``length``."""
    n = len(places)
    exact: dict[int, list[int]] = {}
    width = length // 2
    while width >= max(1, length // 4):
        found = np.minimum(np.searchsorted(places, places - width), n - 1)
        same = np.flatnonzero(places[found] == places - width)
        for j, i in zip(same.tolist(), found[same].tolist()):
            exact.setdefault(j, []).append(i)
        width //= 2
    at, cost = places.tolist(), costs.tolist()
    best, back = [0] * n, [0] * n
    keys, who, head = [0], [0], 0  # the queue: f[i] + P[i] rising, and i
    for j in range(1, n):
        here = at[j]
        reach = here - length
        while at[who[head]] < reach:
            head += 1
        value, i = keys[head] + length - here, who[head]
        if j in exact:
            for k in exact[j]:
                if best[k] + extra < value:
                    value, i = best[k] + extra, k
        value += cost[j]
        best[j], back[j] = value, i
        key = value + here
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            who.pop()
        keys.append(key)
        who.append(j)
    chosen, j = [], n - 1
    while j > 0:
        chosen.append(at[j])
        j = back[j]
    return chosen[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0,
         length: int = LENGTH, sentence: int = 1, inner: int = 4, step: int = 32, extra: int = 16, chunk: int = 1 << 21) -> DataFrame:
    """Pieces of documents with their sequence and their offset there; ``ids`` as little-endian unsigned 32-bit integers.

    ``sentence`` and ``inner`` are the penalties, in tokens of padding, of a cut at a sentence end and inside a
    sentence; ``extra`` is that of a sequence left at half or a quarter of ``length``, which needs no padding.
    """
    path = vocabulary or default_vocabulary()
    merges = Merges(path)
    shared = docs.sparkSession.sparkContext.broadcast((merges, sentence_ends(merges.ids)))

    def sequences(chunk_docs: list, first: int, ends: np.ndarray) -> tuple[pa.RecordBatch, int]:
        sizes = np.array([len(x) for _, x in chunk_docs])
        doc_ends = np.cumsum(sizes)
        stream = np.concatenate([x for _, x in chunk_docs])
        seq_ends = np.array(cuts(*candidates(stream, doc_ends, ends, sentence, inner, min(step, length)), length, extra))
        piece_ends = np.union1d(doc_ends, seq_ends)
        piece_starts = np.concatenate(([0], piece_ends[:-1]))
        doc = np.searchsorted(doc_ends, piece_starts, side="right")
        seq = np.searchsorted(seq_ends, piece_starts, side="right")
        seq_starts = np.concatenate(([0], seq_ends[:-1]))
        data = stream.tobytes()
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([chunk_docs[i][0] for i in doc.tolist()], pa.int64()), "start": piece_starts - (doc_ends - sizes)[doc],
            "length": piece_ends - piece_starts,
            "ids": pa.array([data[4 * a:4 * b] for a, b in zip(piece_starts.tolist(), piece_ends.tolist())], pa.binary()),
            "doc_tokens": sizes[doc], "sequence_id": first + seq, "offset": piece_starts - seq_starts[seq]}), len(seq_ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ends = shared.value
        encoder = Encoder(known, worker_table(f"ids {path}"))
        closing = np.array([end_id], dtype="<u4")
        first, held, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_py() or b""
                held.append((key, np.concatenate((encoder.encode(data.decode("utf-8", "replace")), closing))))
                size += len(held[-1][1])
                if size >= chunk:
                    out, n = sequences(held, first, ends)
                    first, held, size = first + n, [], 0
                    yield out
        if held:
            yield sequences(held, first, ends)[0]

    data = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("data"))
    return data.mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The columns of query op7."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
