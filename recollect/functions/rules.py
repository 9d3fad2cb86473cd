"""Predicates and classifiers as native columns."""

from pyspark.sql import Column, functions as F

from recollect import fixed
from recollect.functions.text import (WS, any_of, col, contains_any, normalize, nz, search_lower, starts_with_any,
                                      strip)

CURRENCY = f"\\$[{WS}]?\\p{{Nd}}|\\p{{Nd}}\\.\\p{{Nd}}{{2}}"


# --- files -------------------------------------------------------------------

def extension(name) -> Column:
    """Lower-cased last suffix of a file name; names of dots only or ending in a dot have none."""
    return F.lower(F.regexp_extract(col(name), r"^\.*[^.].*?(\.[^.]+)$", 1))


def is_noise_path(rel_path) -> Column:
    """A segment is exactly a vendored or generated directory name (case matters)."""
    return F.exists(F.split(col(rel_path), "/"), lambda s: s.isin(fixed.NOISE_DIR_NAMES)
                    | any_of([s.endswith(x) for x in fixed.NOISE_DIR_SUFFIXES]))


def file_status(name, rel_path, outside_root, include_audio=False, include_images=False) -> Column:
    """First matching class of a file: why it is skipped, or ``candidate``."""
    ext = extension(name)
    c = F.when(starts_with_any(name, fixed.TEMP_PREFIXES), "temp").when(ext.isin(fixed.VIDEO_EXT), "video")
    if not include_audio:
        c = c.when(ext.isin(fixed.AUDIO_EXT), "media")
    if not include_images:
        c = c.when(ext.isin(fixed.RASTER_EXT), "media")
    hidden = F.exists(F.split(col(rel_path), "/"), lambda s: s.startswith("."))
    return (c.when(col(outside_root), "outside").when(hidden, "hidden")
            .when(is_noise_path(rel_path), "noise").otherwise("candidate"))


def is_prunable(filename) -> Column:
    """Noise rows already stored: LIKE patterns, ASCII case-insensitive, ``_`` in a name matches any character.

    One pattern over the ASCII-lowered name instead of one per LIKE; an exact
    name is compared as it stands.
    """
    name, low = col(filename), search_lower(filename)
    dirs = "|".join(n.replace(".", r"\.").replace("_", ".") for n in fixed.NOISE_DIR_NAMES)
    sufs = "|".join(s.replace(".", r"\.") for s in fixed.NOISE_DIR_SUFFIXES)
    return (name.isin(fixed.NOISE_DIR_NAMES)
            | low.rlike(f"(?s)^(?:{dirs})/|/(?:{dirs})(?:/|\\z)|(?:{sufs})(?:/|\\z)"))


# --- finance -----------------------------------------------------------------

def has_money(c) -> Column:
    return col(c).rlike(CURRENCY)


def joined_text(filename="filename", ocr="ocr_text", vlm="vlm_text") -> Column:
    """The three text fields joined by spaces, lower case."""
    return F.lower(F.concat_ws(" ", nz(filename), nz(ocr), nz(vlm)))


def is_bank_text(lowered) -> Column:
    c = col(lowered)
    return has_money(c) & contains_any(c, fixed.BANK_ISSUERS) & contains_any(c, fixed.TRANSACTION_WORDS)


# --- questions and answers -----------------------------------------------------

def word_count(normalized: Column) -> Column:
    return F.when(normalized == "", 0).otherwise(F.size(F.split(normalized, " ")))


def is_short_factual(question) -> Column:
    q = normalize(question)
    return (q != "") & (word_count(q) <= fixed.FACTUAL_MAX_WORDS) & starts_with_any(q, fixed.FACTUAL_PREFIXES)


def is_aggregate_finance(question) -> Column:
    q = normalize(question)
    return contains_any(q, fixed.AGGREGATE_FINANCE_TERMS) & contains_any(q, fixed.AGGREGATE_TERMS)


def is_broad(question) -> Column:
    q = normalize(question)
    return (word_count(q) >= fixed.BROAD_MIN_WORDS) | contains_any(q, fixed.BROAD_TERMS)


def is_finance_query(question) -> Column:
    return contains_any(normalize(question), fixed.FINANCE_QUERY_TERMS)


def is_low_confidence(answer) -> Column:
    t = F.lower(strip(nz(answer)))
    return (t == "") | contains_any(t, fixed.LOW_CONFIDENCE_MARKERS)


def is_refusal(answer) -> Column:
    t = F.lower(strip(nz(answer)))
    return (F.when(t == "", True).when(contains_any(t, fixed.CITATION_MARKERS), False)
            .otherwise(contains_any(t, fixed.REFUSAL_MARKERS)))


def route(question, auto_route: bool = True) -> Column:
    """Which way a question goes to the models."""
    c = F.when(is_aggregate_finance(question), "aggregate_finance->large")
    if not auto_route:
        return c.otherwise("large_direct")
    return (c.when(is_short_factual(question), "small_first_factual")
            .when(is_broad(question), "large_first_broad").otherwise("large_default"))


def first_model(question, large: str, small: str, auto_route: bool = True) -> Column:
    return F.when(route(question, auto_route) == "small_first_factual", small).otherwise(large)
