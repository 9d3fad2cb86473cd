"""Byte-pair encoding inside tasks: cutting a text into pieces, counting a piece's tokens, and ids of pieces.

A vocabulary file is a parameter and is read on the driver; what the tasks need from it travels as one broadcast, whose
size is bounded by the vocabulary.
"""

import json
import re
import sys
import types
from heapq import heapify, heappop, heappush

import regex

#: The pre-tokenisation pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII and Latin letters only, where plain classes say the same and run about three times as fast.
LATIN = r"A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN_PATTERN = rf"'(?:s|t|re|ve|m|ll|d)| ?[{LATIN}]+| ?[0-9]+| ?[^\t\n\r {LATIN}0-9]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"
NOT_PLAIN = rf"[^\t\n\r\x20-\x7e{LATIN}]"

#: Pieces kept by a worker at most; beyond that its table is emptied and filled anew.
KEPT_PIECES = 200_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 bytes stand for themselves, others follow U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Pair ranks of a byte-level BPE vocabulary file: (left, right) byte strings to rank, and byte strings to id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        plain = lambda s: bytes(symbols[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(plain(a), plain(b)): i for i, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {plain(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}


def merged(piece: bytes, ranks: dict) -> tuple[list[bytes | None], int]:
    """Symbols of a piece after all merges (None: merged away), and how many merges were made.

    Adjacent pairs wait in a heap by (rank, place); symbols form a doubly linked list. The lowest pair is popped and
    merged again and again; a popped pair whose symbols have changed meanwhile is passed over. O(n log n).
    """
    parts: list[bytes | None] = [piece[i:i + 1] for i in range(len(piece))]
    n = len(parts)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapify(heap)
    made = 0
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i]
        if parts[i] != left or j >= n or parts[j] != right:
            continue
        parts[i], parts[j] = left + right, None
        made += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((parts[i], parts[k]))) is not None:
                heappush(heap, (r, i, parts[i], parts[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
            heappush(heap, (r, h, parts[h], parts[i]))
    return parts, made


def worker_table(name: str) -> dict:
    """A table that lives as long as this Python worker, so that later tasks find what earlier ones computed."""
    home = sys.modules.setdefault("recollect_worker_tables", types.ModuleType("recollect_worker_tables"))
    return home.__dict__.setdefault(name, {})


class Cutter:
    """Cuts texts into the pieces that BPE works on; special strings inside a text are pieces of their own."""

    def __init__(self, special):
        self.plain, self.full, self.odd = re.compile(PLAIN_PATTERN), regex.compile(PATTERN), re.compile(NOT_PLAIN)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def runs(self, text: str):
        """(text between special strings, special string or None), in order."""
        at = 0
        if self.special is not None:
            for m in self.special.finditer(text):
                yield text[at:m.start()], m.group()
                at = m.end()
        yield text[at:], None

    def pieces(self, text: str) -> list[str]:
        return (self.full if self.odd.search(text) else self.plain).findall(text)
