"""Words and tokens by what is left of them when letters are struck out, as hashes: an equi-join on these finds close pairs.

Words of one length are a matrix of letters, so that one way of striking letters out is a few vector operations. Both
sides are ASCII; a hash that collides only adds a pair, and pairs are verified.
"""

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Ways to strike letters out of one word, at most, for one pair of lengths; and the longest words that are tried.
MOST_WAYS, LONGEST = 1000, 64
#: The lowest cutoff: below it so few letters must be left that most words share them.
LOWEST = 0.8
#: Bits of the filter that the words make for the tokens, and bits for each word.
FILTER_BITS, BITS_A_WORD = 27, 800
PRIME, MIX, PAIR = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93


def able(cutoff: float) -> dict[tuple[int, int], int]:
    """(letters of a word, of a token) -> letters that must be left of both, for lengths that can reach the cutoff in few ways."""
    if cutoff < LOWEST:
        return {}
    found = {}
    for la, lb in itertools.product(range(1, LONGEST + 1), repeat=2):
        left = math.ceil(cutoff * (la + lb) / 2 - 1e-9)
        if 1 <= left <= min(la, lb) and max(math.comb(la, left), math.comb(lb, left)) <= MOST_WAYS:
            found[la, lb] = left
    return found


def ways(lengths: dict[tuple[int, int], int], side: int) -> dict[int, dict[int, list[int]]]:
    """Letters of a word (``side`` 0) or token (1) -> how many are struck out -> for which pairs of lengths, as numbers."""
    out: dict[int, dict[int, list[int]]] = {}
    for pair, left in lengths.items():
        out.setdefault(pair[side], {}).setdefault(pair[side] - left, []).append(1000 * pair[0] + pair[1])
    return out


def hashes(words: pa.Array, by: dict[int, dict[int, list[int]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, which word) of what is left of the words and of a pair of lengths, one way of striking letters out after the other."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    letters = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets)
    for n in np.unique(sizes):
        which = np.flatnonzero(sizes == n)
        grid = letters[offsets[which][:, None] + np.arange(n)].T.astype(np.uint64) if n in by else None
        for k, pairs in by.get(int(n), {}).items():
            for gone in itertools.combinations(range(n), k):
                h = np.full(len(which), n - k, np.uint64)
                for c in range(n):
                    if c not in gone:
                        h = h * PRIME + grid[c]
                for pair in pairs:
                    mixed = (h ^ np.uint64(pair * PAIR % (1 << 64))) * MIX
                    yield mixed ^ (mixed >> np.uint64(29)), which


def _spots(h: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of the filter and their bits, twice."""
    for shift in (0, 31):
        at = (h >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        yield (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))


def hash_filter(df: DataFrame, column: str, found: Callable[[pa.Array], Iterator[np.ndarray]], a_row: int = BITS_A_WORD) -> tuple[bytes, int]:
    """A filter of the hashes ``found`` in a column, of 16 MB at most, and its bits as a power of two."""
    bits = min(FILTER_BITS, max(16, (df.count() * a_row).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            for h in found(batch.column(0)):
                for at, bit in _spots(h, bits):
                    np.bitwise_or.at(own, at, bit)
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["f"])

    every = np.zeros(1 << (bits - 3), np.uint8)
    for row in df.select(column).coalesce(4).mapInArrow(run, "f binary").toLocalIterator():
        every |= np.frombuffer(row["f"], np.uint8)
    return every.tobytes(), bits


def in_filter(h: np.ndarray, held: np.ndarray, bits: int) -> np.ndarray:
    return np.logical_and.reduce([(held[at] & bit) != 0 for at, bit in _spots(h, bits)])


def word_filter(words: DataFrame, by: dict[int, dict[int, list[int]]]) -> tuple[bytes, int]:
    """The filter of what is left of ``words`` (word)."""
    return hash_filter(words, "word", lambda column: (h for h, _ in hashes(column, by)))


def struck(df: DataFrame, column: str, by: dict[int, dict[int, list[int]]], wanted: tuple[bytes, int] | None = None) -> DataFrame:
    """hash and ``column``: a row for each way; of those that the filter ``wanted`` holds."""
    shared = df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(shared.value[0], np.uint8) if shared.value else None
        for batch in batches:
            for part in _joined(hashes(batch.column(0), by), held, shared.value[1] if shared.value else 0):
                h, which = (np.concatenate(x) for x in zip(*part, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(which))], names=["hash", column])

    return df.select(column).mapInArrow(run, f"hash bigint, {column} string")


def _joined(found, held: np.ndarray | None, bits: int, rows: int = 1 << 18) -> Iterator[list]:
    """What ``hashes`` gives, as far as the filter holds it, in parts of about ``rows``."""
    part, n = [], 0
    for h, which in found:
        if held is not None:
            ok = in_filter(h, held, bits)
            h, which = h[ok], which[ok]
        if len(h):
            part.append((h, which))
            n += len(h)
        if n >= rows:
            yield part
            part, n = [], 0
    if part:
        yield part
