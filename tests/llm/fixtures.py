"""Small tables with nulls, empty and long texts, ties, repeated rows, and extra columns whose names the operators use too."""

import random

CLASH = ["data", "cls", "sig", "digit", "context", "a", "b", "n", "u", "v", "key", "page", "start", "size", "spans", "items", "bucket", "r", "t", "h", "ids", "parts"]


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    vocabulary = [a + b for a in ("ther", "on", "ing", "ea", "wh", "ti", "bl", "or", "st", "éa") for b in ("an", "ed", "es", "the", "re", "on", "é", "ly")]
    return " ".join(r.choice(vocabulary) + ("." if r.random() < 0.1 else "") for _ in range(words))


def documents(spark, rows):
    """(doc_id, text[, lang]) rows as a table of documents with clashing extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or "")) + ("x",) * len(CLASH) for r in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASH))


def pages(spark, rows):
    return spark.createDataFrame([r + ("x",) * len(CLASH) for r in rows], "page_id bigint, url string, html string, " + ", ".join(f"{c} string" for c in CLASH))
