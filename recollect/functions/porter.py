"""Porter stemming (Porter 1980) as native columns: no Python worker in the index build.

Each step is one guarded rewrite; a guard looks at the last letters only, so
most tokens skip most steps. Lengths are counted in UTF-8 bytes as the lexical
index does, so a non-ASCII character is padded with marker characters while
the steps run.
"""

from pyspark.sql import Column, DataFrame, functions as F

from recollect.functions.text import fold, fold_str

MAX_TOKEN_BYTES = 64
PAD = "\u0001"

# a consonant run and a vowel run; "y" is a vowel after a consonant, so never the first letter
_C = "[^aeiou][^aeiouy]*"
_V = "[aeiouy][aeiou]*"
_FIRST = f"^(?:{_C}{_V}|[aeiou]+)"
M_GT_0 = f"{_FIRST}{_C}"
M_EQ_1 = f"{_FIRST}{_C}(?:{_V})?$"
M_GT_1 = f"{_FIRST}{_C}{_V}{_C}"
HAS_VOWEL = "^(?:[aeiou]|.+[aeiouy])"
# consonant-vowel-consonant at the end, the last one not w, x or y
CVC = "(?:^[^aeiou]|[aeiou]y|[^aeiouy])[aeiouy][^aeiouwxy]$"

# Porter's suffix tables (fixed values)
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou",
         "ism", "ate", "iti", "ous", "ive", "ize"]


def _split(suffixes) -> str:
    return "^(.+?)(" + "|".join(suffixes) + ")$"


def _ends(w: Column, suffixes) -> Column:
    """One of the suffixes, with something before it. The last letter is looked at first: it settles most tokens."""
    last = sorted({x[-1] for x in suffixes})
    return F.substring(w, -1, 1).isin(last) & w.rlike("(?:" + "|".join(suffixes) + ")$") & ~w.isin(list(suffixes))


def _step1a(w: Column) -> Column:
    return F.when(w.endswith("s"),
                  F.when(w.rlike(".sses$|.ies$"), F.substring(w, F.lit(1), F.length(w) - 2))
                  .when(w.endswith("ss"), w)
                  .otherwise(F.substring(w, F.lit(1), F.length(w) - 1))).otherwise(w)


def _repair(stem: Column) -> Column:
    """After a removed -ed or -ing: restore an e, or undouble."""
    return (F.when(stem.rlike(".(?:at|bl|iz)$"), F.concat(stem, F.lit("e")))
            .when(stem.rlike(r"([^aeioulsz])\1$"), F.substring(stem, F.lit(1), F.length(stem) - 1))
            .when(stem.rlike(M_EQ_1) & stem.rlike(CVC), F.concat(stem, F.lit("e")))
            .otherwise(stem))


def _step1b(w: Column) -> Column:
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    return (F.when((w.endswith("eed") & (F.length(w) > 3)), F.when(cut(3).rlike(M_GT_0), cut(1)).otherwise(w))
            .when((w.endswith("ed") & (F.length(w) > 2)), F.when(cut(2).rlike(HAS_VOWEL), _repair(cut(2))).otherwise(w))
            .when((w.endswith("ing") & (F.length(w) > 3)), F.when(cut(3).rlike(HAS_VOWEL), _repair(cut(3))).otherwise(w))
            .otherwise(w))


def _step1c(w: Column) -> Column:
    head = F.substring(w, F.lit(1), F.length(w) - 1)
    return F.when(w.endswith("y") & head.rlike(HAS_VOWEL), F.concat(head, F.lit("i"))).otherwise(w)


def _table_step(w: Column, table: dict) -> Column:
    pattern = _split(table)
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    stem = F.regexp_extract(w, pattern, 1)
    new = F.concat(stem, F.element_at(lookup, F.regexp_extract(w, pattern, 2)))
    return F.when(_ends(w, table), F.when(stem.rlike(M_GT_0), new).otherwise(w)).otherwise(w)


def _step4(w: Column) -> Column:
    stem = F.regexp_extract(w, _split(STEP4), 1)
    ion = F.substring(w, F.lit(1), F.length(w) - 3)
    return (F.when(_ends(w, STEP4), F.when(stem.rlike(M_GT_1), stem).otherwise(w))
            .when(w.endswith("ion") & w.rlike("[st]ion$"), F.when(ion.rlike(M_GT_1), ion).otherwise(w))
            .otherwise(w))


def _step5a(w: Column) -> Column:
    head = F.substring(w, F.lit(1), F.length(w) - 1)
    drop = head.rlike(M_GT_1) | (head.rlike(M_EQ_1) & ~head.rlike(CVC))
    return F.when(w.endswith("e"), F.when(drop, head).otherwise(w)).otherwise(w)


def _step5b(w: Column) -> Column:
    head = F.substring(w, F.lit(1), F.length(w) - 1)
    return F.when(w.endswith("ll") & head.rlike(M_GT_1), head).otherwise(w)


STEPS = [
    _step1a, _step1b, _step1c,
    lambda w: _table_step(w, STEP2),
    lambda w: _table_step(w, STEP3),
    _step4, _step5a, _step5b,
]
#: The step before which the generated code is split.
HALFWAY = 4


def with_term(df: DataFrame, raw: str = "raw", term: str = "term") -> DataFrame:
    """Add the indexed term of each raw token.

    One projection per step, so that Spark evaluates a step once instead of
    nesting it into every reference of the next one. Halfway the word passes
    through an array of one row: all steps in one generated method would be
    over 8000 bytes, which the JVM interprets instead of compiling it.
    """
    folded = fold(F.col(raw))
    df = df.withColumn("_f", folded)
    df = df.withColumn("_w", F.when(F.octet_length("_f") == F.length("_f"), F.col("_f")).otherwise(_pad(F.col("_f"))))
    df = df.withColumn("_stem", (F.length("_w") >= 3) & (F.length("_w") <= MAX_TOKEN_BYTES))
    for i, step in enumerate(STEPS):
        if i == HALFWAY:
            df = df.withColumn("_s", F.explode(F.array("_w"))).withColumn("_w", F.col("_s")).drop("_s")
        df = df.withColumn("_w", F.when(F.col("_stem"), step(F.col("_w"))).otherwise(F.col("_w")))
    return df.withColumn(term, F.replace("_w", F.lit(PAD), F.lit(""))).drop("_f", "_w", "_stem")


def _pad(c: Column) -> Column:
    for lo, hi, n in (("\\x{80}", "\\x{7ff}", 1), ("\\x{800}", "\\x{ffff}", 2), ("\\x{10000}", "\\x{10ffff}", 3)):
        c = F.regexp_replace(c, f"([{lo}-{hi}])", "$1" + PAD * n)
    return c


# --- the same steps for the few words of one question -----------------------

def stem_word(token: str) -> str:
    """Fold and stem one query token on the driver (a question has a handful)."""
    import re
    w = "".join(ch + PAD * (len(ch.encode()) - 1) for ch in fold_str(token))
    if not 3 <= len(w) <= MAX_TOKEN_BYTES:
        return w.replace(PAD, "")

    def has(p, s):
        return re.search(p, s) is not None

    def repair(s):
        if has(".(?:at|bl|iz)$", s):
            return s + "e"
        if has(r"([^aeioulsz])\1$", s):
            return s[:-1]
        return s + "e" if has(M_EQ_1, s) and has(CVC, s) else s

    if w.endswith("s"):
        w = w[:-2] if has(".sses$|.ies$", w) else w if w.endswith("ss") else w[:-1]
    if has(".eed$", w):
        w = w[:-1] if has(M_GT_0, w[:-3]) else w
    elif has(".ed$", w) and has(HAS_VOWEL, w[:-2]):
        w = repair(w[:-2])
    elif not has(".ed$", w) and has(".ing$", w) and has(HAS_VOWEL, w[:-3]):
        w = repair(w[:-3])
    if w.endswith("y") and has(HAS_VOWEL, w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        m = re.match(_split(table), w)
        if m and has(M_GT_0, m[1]):
            w = m[1] + table[m[2]]
    m = re.match(_split(STEP4), w)
    if m:
        w = m[1] if has(M_GT_1, m[1]) else w
    elif has("[st]ion$", w) and has(M_GT_1, w[:-3]):
        w = w[:-3]
    if w.endswith("e") and (has(M_GT_1, w[:-1]) or (has(M_EQ_1, w[:-1]) and not has(CVC, w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and has(M_GT_1, w[:-1]):
        w = w[:-1]
    return w.replace(PAD, "")
