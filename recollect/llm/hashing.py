"""Vectorised hashing of one text's bytes inside a task: polynomial word hashes, sliding-window hashes, mixing.

All values are unsigned 64-bit and deterministic, so a task run again after a lost executor gives the same rows.
Memory is a fixed number of 8-byte arrays over one text.
"""

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit over all."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); kept between calls up to a million entries."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 20:
            _powers[int(base)] = have
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums S with S[j] - S[i] = sum of values[k] * BASE**k over i <= k < j."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(BASE, len(values)), dtype=np.uint64, out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end) of the values behind ``sums``, wherever it stands."""
    return (sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts]


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values."""
    if len(values) < width:
        return np.zeros(0, dtype=np.uint64)
    sums = prefix(values)
    n = len(values) - width + 1
    return mix((sums[width:] - sums[:n]) * powers(INVERSE, n))


def word_bounds(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs where ``member`` is true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], member.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each word data[start:end]."""
    h = spans(prefix(BYTE[data]), starts, ends)
    return mix(h + (ends - starts).astype(np.uint64))


def byte_class(chars: bytes, invert: bool = False) -> np.ndarray:
    """A table of 256 booleans: which bytes belong to a class."""
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return ~table if invert else table


#: Bytes of a word between spaces and ASCII control spaces; A-Z to a-z.
NOT_SPACE = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d", invert=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
