"""Text helpers as native columns."""

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The characters Python strips: Unicode white space and the four separators 0x1c-0x1f.
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
WS = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

WORD = "[\\p{L}\\p{N}_'.-]+"
# the combining marks that make one-mark letters out of ASCII letters; they continue a token
MARKS = "".join(sorted({n[1] for n in (unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x2000))
                        if len(n) == 2 and n[0].isascii() and n[0].isalpha()}))
RUN = f"[\\p{{L}}\\p{{N}}\\p{{Co}}][\\p{{L}}\\p{{N}}\\p{{Co}}{MARKS}]*"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c) -> Column:
    """NULL as the empty string."""
    return F.coalesce(col(c), F.lit(""))


def ascii_lower(c) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in."""
    c = col(c)
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def search_lower(c) -> Column:
    """``ascii_lower`` as far as an ASCII needle can tell, at the speed of the built-in.

    Only two characters have a lower case that brings in ASCII letters, the
    Kelvin sign and the dotted capital I; texts with one of them take the exact way.
    """
    c = col(c)
    return F.when(c.contains("\u212a") | c.contains("\u0130"), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def ascii_lower_str(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(WS_CHARS))


def normalize(c) -> Column:
    """Lower case with runs of white space made single spaces."""
    return F.btrim(F.regexp_replace(F.lower(nz(c)), f"[{WS}]+", " "))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(c, terms) -> Column:
    c = col(c)
    return any_of([c.contains(t) for t in terms])


def starts_with_any(c, prefixes) -> Column:
    c = col(c)
    return any_of([c.startswith(p) for p in prefixes])


def like_contains(lowered: Column, term: str) -> Column:
    """``lowered LIKE '%term%'`` of an ASCII-case-insensitive LIKE without escapes.

    ``_`` and ``%`` inside a term are wildcards; every other term is a plain ``Contains``.
    """
    term = ascii_lower_str(term)
    if not re.search("[_%]", term):
        return lowered.contains(term)
    pattern = "".join({"_": ".", "%": ".*"}.get(p, _quote(p)) for p in re.split("([_%])", term) if p)
    return lowered.rlike("(?s)" + pattern)


def _quote(s: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", s)


def _fold_maps() -> tuple[str, str]:
    """The tokeniser's character folding, by rule: letters and their images.

    A letter loses its mark when it is an ASCII letter with exactly one
    combining mark; characters that fold to one other letter take it.
    """
    src, dst = [], []
    for ch in map(chr, range(0x80, 0x10000)):
        low = next((x for x in (ch.casefold(), ch.lower()) if len(x) == 1), ch)
        nfd = unicodedata.normalize("NFD", low)
        if len(nfd) == 2 and nfd[0].isascii() and nfd[0].isalpha() and unicodedata.combining(nfd[1]):
            low = nfd[0]
        if ch == "İ":
            low = "i"
        if low != ch and (low.isascii() or low != ch.lower()):
            src.append(ch)
            dst.append(low)
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _fold_maps()
FOLD_TABLE = {**str.maketrans(FOLD_FROM, FOLD_TO), **dict.fromkeys(map(ord, MARKS))}


def fold(token: Column) -> Column:
    """Lower-case and fold one token. ASCII tokens only take ``lower``."""
    return F.when(F.octet_length(token) == F.length(token), F.lower(token)).otherwise(
        F.lower(F.translate(token, FOLD_FROM + MARKS, FOLD_TO)))


def fold_str(token: str) -> str:
    return token.translate(FOLD_TABLE).lower()


def runs(c) -> Column:
    """Maximal runs of letters and digits, as they stand. Pure ASCII text takes a short pattern."""
    c = nz(c)
    return F.when(F.octet_length(c) == F.length(c), F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0))).otherwise(
        F.regexp_extract_all(c, F.lit(RUN), F.lit(0)))


def lower_runs(c) -> Column:
    """``search_lower`` of each of the ``runs``.

    The text is lowered as a whole: no letter becomes anything else by it. Only the capital sigma depends on its
    neighbours, and two more characters bring in ASCII letters; texts with one of these are lowered run by run.
    """
    c = nz(c)
    special = c.contains("\u212a") | c.contains("\u0130") | c.contains("\u03a3")
    return F.when(F.octet_length(c) == F.length(c), F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))).when(
        ~special, F.regexp_extract_all(F.lower(c), F.lit(RUN), F.lit(0))).otherwise(F.transform(runs(c), search_lower))


def json_str(c) -> Column:
    """A JSON string literal, or null."""
    s = F.to_json(F.array(col(c)))
    return F.when(col(c).isNull(), F.lit("null")).otherwise(F.substring(s, F.lit(2), F.length(s) - 2))


def float_repr(c) -> Column:
    """A double written the shortest way without an exponent, with at least one decimal."""
    c = col(c)
    plain = F.regexp_replace(c.cast("string").cast("decimal(38,12)").cast("string"), "0+$", "")
    return F.when(c == F.floor(c), F.concat(c.cast("bigint").cast("string"), F.lit(".0"))).otherwise(plain)


def quote_url(c) -> Column:
    """Percent-encode everything but letters, digits and ``_.-~``."""
    u = F.url_encode(nz(c))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        u = F.replace(u, F.lit(a), F.lit(b))
    return u
