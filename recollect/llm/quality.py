"""Quality rules in DataFrame functions only: base rules, and a log-likelihood ratio of hashed n-grams.

Words and word pairs are hashed to ``buckets``. Two multinomials over the buckets are counted, one over all documents
(raw) and one over the trusted documents (target), both smoothed. A document's score is the mean of
log(target share / raw share) over its n-grams, so its length doesn't matter, and every document with a score of at
least ``least`` that passes the base rules is kept: the verdict depends on counts alone, never on chance.

Counting explodes words in one pass with partial sums, so at most ``buckets`` rows leave a task. The table of ratios has
``buckets`` entries and reaches the scoring pass as one array from a scalar subquery; scoring is a narrow pass without
a shuffle. The ids of trusted documents are broadcast, so that texts never move. If there are more of them than a parameter
allows, the raw counts take one narrow pass, and a second one sends the n-grams of trusted documents to their ids: a Bloom
filter of bounded size keeps nearly all other documents from the shuffle. The texts are then read twice for the counts,
however many ids there are; rows with one id are dealt in turn into several parts, so no id is one task. Both ways count the same.

Defined cases: a null text has no words and fails; rows with equal ids are judged each by itself, and all are trusted if
one label says so; a null label or an empty table of labels trusts nothing, and then every score is 0; a text with one
word has one n-gram; other columns are ignored.
"""

from pyspark.sql import Column, DataFrame, functions as F

from recollect.llm import exact
from recollect.llm.frames import stage_narrow
from recollect.llm.secret_scan import let

SPACE = r"[\x20\x09-\x0D]+"
BUCKETS = 1 << 16
#: Least mean log-likelihood ratio of a document that is kept.
LEAST = -0.12
#: Of the filter of trusted ids: cells an id, and the most rows of 4 KB (128 MB).
CELLS_PER_ID, MOST_CELLS = 16, 1 << 15
#: Parts into which the rows of one id are dealt.
SALTS = 8


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACE), "")


def _places(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of three words that occur twice or more."""
    def covered(prints: Column) -> Column:
        placed = F.sort_array(F.transform(prints, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.filter(F.transform(s, lambda x, j: F.when(
            F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)), x["i"])), lambda i: i.isNotNull()))
        return let(F.sort_array(twice), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), x - F.coalesce(F.get(p, j - 1), F.lit(-3)))), F.lit(0), lambda a, b: a + b))

    def count(w: Column) -> Column:
        prints = F.transform(_places(F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(prints, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    return let(words, count)


def base(text: Column, words: Column) -> dict[str, Column]:
    plain = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(plain, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    return {"n_words": F.size(words), "word_chars": F.length(F.array_join(words, "")), "n_symbols": F.regexp_count(plain, F.lit("[#*$%&|<>]")),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), "n_repeat_words": repeated_words(words)}


def ngram_buckets(text: Column, buckets: int) -> Column:
    """Buckets of the words of the lower-cased text and of the pairs of adjacent ones. A power of two takes the hash's last bits."""
    place = lambda h: (F.pmod(h, F.lit(buckets)) if buckets & (buckets - 1) else h.bitwiseAND(F.lit(buckets - 1))).cast("int")
    single = lambda w: F.transform(w, lambda x: place(F.xxhash64(x)))
    pair = lambda w: F.transform(_places(F.size(w) - 1), lambda i: place(F.xxhash64(F.get(w, i), F.get(w, i + 1))))
    return let(words_of(F.lower(text)), lambda w: F.concat(single(w), pair(w)))


def counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, r, t): n-grams of all texts and of the trusted ones among them."""
    grams = texts.select(F.col("trusted").cast("long").alias("trusted"), F.explode(ngram_buckets(F.col("text"), buckets)).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("r"), F.sum("trusted").alias("t"))


def id_filter(ids: DataFrame, cells: int) -> DataFrame:
    """(bucket, bitmap): the cells that the ids hit, in ``cells`` rows of 4 KB."""
    hit = ids.select(exact._bucket(F.col("doc_id"), cells).alias("bucket"), F.explode(F.array(*exact._bits(F.col("doc_id")))).alias("bit"))
    return hit.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def shuffled_counts(texts: DataFrame, ids: DataFrame, n_ids: int, buckets: int) -> DataFrame:
    """``counts`` for any number of trusted ids: only the n-grams of documents that the filter lets pass are shuffled."""
    raw = counts(texts.select("text", F.lit(False).alias("trusted")), buckets)
    cells = min(MOST_CELLS, -(-n_ids * CELLS_PER_ID // exact.BITS))
    found = stage_narrow(id_filter(ids, cells), "trusted-ids")
    possible = exact.mark(texts.where("doc_id IS NOT NULL").withColumn("digest", F.col("doc_id")), found, cells).where("possible")
    grams = possible.select("doc_id", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"), ngram_buckets(F.col("text"), buckets).alias("grams"))
    salted = ids.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    trusted = grams.join(salted.hint("merge"), ["doc_id", "salt"], "left_semi").select(F.explode("grams").alias("bucket"))
    return raw.unionByName(trusted.groupBy("bucket").agg(F.lit(0).cast("bigint").alias("r"), F.count("*").alias("t")))


def ratios(docs: DataFrame, labels: DataFrame, buckets: int, id_col: str, text_col: str, smooth: float, trusted_rows: int) -> DataFrame:
    """One row with the array of log ratios by bucket; smoothing adds ``smooth`` of the raw shares to the target's counts."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    named = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    n_ids = named.count()
    if n_ids <= trusted_rows:
        marked = texts.join(F.broadcast(named.withColumn("_trusted", F.lit(True))), "doc_id", "left")
        found = counts(marked.select("text", F.coalesce("_trusted", F.lit(False)).alias("trusted")), buckets)
    else:
        found = shuffled_counts(texts, named, n_ids, buckets)
    spare = texts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("r"), F.lit(0).alias("t"))
    both = found.unionByName(spare).groupBy("bucket").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    listed = both.agg(F.array_sort(F.collect_list(F.struct("bucket", "r", "t"))).alias("x"), F.sum("r").alias("rs"), F.sum("t").alias("ts"))
    share = lambda x: (x["r"] + 1) / (F.col("rs") + buckets)
    grown = smooth * buckets
    ratio = lambda x: F.log((x["t"] + grown * share(x)) / ((F.col("ts") + grown) * share(x)))
    return listed.select(F.transform("x", ratio).alias("ratios"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST,
          buckets: int = BUCKETS, smooth: float = 1.0, trusted_rows: int = 200_000) -> DataFrame:
    """doc_id, the base rules' figures, base_failed, score and kept of every row.

    The target is fitted on all labelled documents; their ids are broadcast if there are at most ``trusted_rows`` of them.
    """
    table = ratios(docs, labels, buckets, id_col, text_col, smooth, trusted_rows).scalar()
    score = lambda b: F.aggregate(b["b"], F.lit(0.0), lambda s, i: s + F.get(b["r"], i)) / F.size(b["b"])
    figures = let(words_of(F.col(text_col)), lambda w: F.struct(*[c.cast("bigint").alias(n) for n, c in base(F.col(text_col), w).items()],
                                                                 ngram_buckets(F.col(text_col), buckets).alias("grams")))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), figures.alias("x"))
    rows = rows.select("doc_id", "x", table.alias("ratios"))
    rated = rows.select("doc_id", "x", let(F.struct(F.col("x.grams").alias("b"), F.col("ratios").alias("r")), lambda b: F.when(F.size(b["b"]) > 0, score(b))).alias("score"))
    out = rated.select("doc_id", *[F.col(f"x.{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "score")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(F.col("score") >= least, F.lit(False)))
