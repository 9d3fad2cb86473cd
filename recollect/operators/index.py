"""The lexical index as tables: postings and corpus statistics."""

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from recollect import schemas
from recollect.functions.porter import with_term
from recollect.functions.text import any_of, lower_runs, nz, runs
from recollect.session import stage


@dataclass(frozen=True)
class Corpus:
    """Entries with their lexical index. All are DataFrames; ``stats`` has one row.

    ``buckets`` is not 0 if the entries are partitioned by ``bucket_of("seq", buckets)``. With ``grams`` and ``symbols``
    substring searches find their entries through the vocabulary; without them they scan the entries. Without ``postings``
    ranked searches read the tokens they ask for from the texts.
    """

    entries: DataFrame
    postings: DataFrame | None = None
    stats: DataFrame | None = None
    buckets: int = 0
    grams: DataFrame | None = None
    symbols: DataFrame | None = None
    words: DataFrame | None = None                            # the vocabulary of the spelling help, if it is stored
    places: DataFrame | None = None                           # of tokens, for phrases; without it texts are read
    memo: dict = field(default_factory=dict, compare=False)   # small things read once


def bucket_of(seq, buckets: int) -> Column:
    return F.pmod(F.xxhash64(seq), F.lit(buckets)).cast("int")


def _lowered_fields() -> list[Column]:
    """t, d: the tokens of the texts and those of the date."""
    return [lower_runs(F.concat_ws("\n", nz("filename"), nz("ocr_text"), nz("vlm_text"))).alias("t"), lower_runs("date_iso").alias("d")]


def terms(entries: DataFrame) -> DataFrame:
    """raw, term: every distinct token. Each row gives its distinct ones."""
    raws = entries.select(*_lowered_fields()).select(F.explode(F.array_distinct(F.concat("t", "d"))).alias("raw"))
    return with_term(raws.distinct()).select("raw", "term")


def token_rows(entries: DataFrame) -> DataFrame:
    """seq, doc_len, raw, in_text: one row per token; tokens of the date are not text."""
    fields = entries.select("seq", *_lowered_fields())
    exploded = fields.select(
        "seq", (F.size("t") + F.size("d")).cast("bigint").alias("doc_len"), F.size("t").alias("n_text"),
        F.posexplode(F.concat("t", "d")).alias("pos", "raw"))
    return exploded.select("seq", "doc_len", "raw",
                           (F.col("pos") < F.col("n_text")).cast("bigint").alias("in_text"))


def unique_entries(entries: DataFrame) -> bool:
    """Whether every entry has a ``seq`` of its own; reads that column only."""
    return entries.groupBy("seq").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def count_tokens(entries: DataFrame, unique: bool = False) -> DataFrame:
    """seq, raw, tf, tf_text, doc_len: the distinct tokens of each entry.

    With ``unique`` entries all tokens of a ``seq`` stand in one row: they are sorted and counted there, and no token is
    shuffled. Otherwise the rows of a ``seq`` meet in a shuffle by (entry, token).
    """
    if not unique:
        return token_rows(entries).groupBy("seq", "raw").agg(
            F.count("*").alias("tf"), F.sum("in_text").alias("tf_text"), F.max("doc_len").alias("doc_len"))
    rows = entries.select("seq", *_lowered_fields())
    rows = rows.select("seq", "d", F.sort_array(F.concat("t", "d")).alias("s")).withColumn("n", F.size("s"))
    last = F.filter(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>")),
                    lambda i: (i == F.col("n")) | (F.get(F.col("s"), i - 1) != F.get(F.col("s"), i)))
    runs_of = F.transform(F.col("last"), lambda e, j: F.struct(
        F.get(F.col("s"), e - 1).alias("raw"), (e - F.when(j == 0, F.lit(0)).otherwise(F.get(F.col("last"), j - 1))).cast("bigint").alias("tf")))
    rows = rows.withColumn("last", last).select("seq", "d", F.col("n").cast("bigint").alias("doc_len"), F.explode(runs_of).alias("c"))
    dated = F.when(F.array_contains("d", F.col("c.raw")), F.size(F.filter("d", lambda x: x == F.col("c.raw")))).otherwise(F.lit(0))
    return rows.select("seq", "c.raw", "c.tf", (F.col("c.tf") - dated).alias("tf_text"), "doc_len")


def build_postings(entries: DataFrame, unique: bool = False) -> DataFrame:
    """term, raw, seq, tf, tf_text, doc_len.

    The tokens of one entry are counted in its row or by a shuffle on (entry, token): no task ever holds all entries of
    a frequent term. Stemming runs after counting, once per entry and distinct token.
    """
    return with_term(count_tokens(entries, unique)).select(*schemas.POSTINGS.fieldNames())


#: Letters at the end of a term, at most, in which stemming makes it differ from its token.
CHANGED = 3


def heads(w: str) -> set[str]:
    """How a token begins whose term begins with ``w``.

    Stemming cuts a token and puts nothing, ``e``, ``i`` or ``le`` (later perhaps ``l``) where it cut, so a term is its
    token's start but for these; a token of which nothing else is left than its first letter keeps that.
    """
    return {w} | {w[:max(1, len(w) - n)] for n, ends in ((1, ("e", "i", "l")), (2, ("le",))) if w.endswith(ends)}


def for_phrases(corpus: Corpus, phrases: list[tuple[str, ...]]) -> Corpus:
    """``corpus`` with the postings (a row for each token) and places that the phrases can touch, from one reading of the texts.

    A token is kept if it begins as stemming needs it for a word of a phrase, or isn't ASCII; the distinct ones are stemmed. What is staged is narrow: the lengths of all entries, and the tokens kept.
    """
    from recollect.operators.ingest import index_doc
    starts = sorted({h for p in phrases for w in p for h in heads(w)})
    rows = corpus.entries.select("seq", lower_runs(index_doc()).alias("t"))
    rows = rows.select("seq", F.size("t").cast("bigint").alias("doc_len"), F.posexplode_outer("t").alias("p", "raw"))
    # folding leaves a lower-case ASCII token as it is; others are all kept
    able = any_of([F.col("raw").startswith(h) for h in starts]) | (F.octet_length("raw") != F.length("raw"))
    rows = rows.withColumn("able", F.coalesce(able, F.lit(False)))
    # the first row of an entry tells its length
    kept = stage(rows.where("able OR coalesce(p, 0) = 0").select("seq", "p", "raw", "doc_len", "able"), "phrases")
    stats = kept.where("coalesce(p, 0) = 0").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0).cast("bigint")).alias("total_len"))
    # staged, because a condition on terms would be moved below the steps of stemming and repeat them
    terms = stage(with_term(kept.where("able").select("raw").distinct()), "phrase-terms")
    tokens = kept.where("able").join(terms.where(any_of([F.col("term").startswith(w) for w in sorted({w for p in phrases for w in p})])), "raw")
    return replace(corpus, postings=tokens.select("term", "raw", "seq", F.lit(1).cast("bigint").alias("tf"), "doc_len"), stats=stats,
                   places=tokens.select("term", "seq", "p"), memo={})


def text_stats(entries: DataFrame) -> DataFrame:
    """``corpus_stats`` from the texts alone: one row, number of entries and of tokens."""
    from recollect.operators.ingest import index_doc
    return entries.select(F.size(runs(index_doc())).alias("n")).agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("total_len"))


def place_sums(entries: DataFrame) -> DataFrame:
    """term, n, places: tokens of each term, and the sum of where they stand. Counted by token before anything is shuffled or stemmed."""
    from recollect.operators.ingest import index_doc
    tokens = entries.select(F.posexplode(lower_runs(index_doc())).alias("p", "raw"))
    by_raw = with_term(tokens.groupBy("raw").agg(F.count("*").alias("n"), F.sum("p").alias("places")))
    return by_raw.groupBy("term").agg(F.sum("n").alias("n"), F.sum("places").alias("places"))


def corpus_stats(entries: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: number of entries and of tokens."""
    total = postings.agg(F.coalesce(F.sum("tf"), F.lit(0).cast("bigint")).alias("t")).scalar()
    return entries.agg(F.count("*").alias("n_docs")).select("n_docs", total.alias("total_len"))


def index(entries: DataFrame) -> Corpus:
    """An index computed on the fly."""
    postings = build_postings(entries)
    return Corpus(entries, postings, corpus_stats(entries, postings))


def sort_postings(postings: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range-partition by (term, seq) and sort: a prefix reads a few row groups, and a hot term is split by seq."""
    keys = ["term", "seq"]
    ranged = postings.repartitionByRange(partitions, *keys) if partitions else postings.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def sorted_runs(postings: DataFrame) -> DataFrame:
    """Each task's postings sorted by (term, seq) and not shuffled: a prefix reads few row groups of each file. Merging segments makes one range of them."""
    return postings.sortWithinPartitions("term", "seq")


def staged_postings(entries: DataFrame, name: str = "corpus", partitions: int | None = None) -> DataFrame:
    """The sorted postings of stored entries, each step computed once.

    The counted tokens are written before anything reads them twice (the range sort samples its input), and stemming
    runs once per distinct token. The join back to the counts may be broadcast or shuffled; hot tokens split there.
    """
    counted = stage(count_tokens(entries, unique_entries(entries)), f"{name}-tokens")
    terms = stage(with_term(counted.select("raw").distinct()), f"{name}-terms")
    return sort_postings(counted.join(terms, "raw").select(*schemas.POSTINGS.fieldNames()), partitions)


def token_places(entries: DataFrame, terms: DataFrame, partitions: int | None = None) -> DataFrame:
    """term, seq, p: where each token stands in its entry; sorted, so that places and entries are stored as small differences.

    ``terms`` has the term of every ``raw`` token; a frequent token splits in the join.
    """
    from recollect.operators.ingest import index_doc
    rows = entries.select("seq", F.posexplode(lower_runs(index_doc())).alias("p", "raw"))
    rows = rows.join(terms, "raw").select("term", "seq", "p")
    keys = ["term", "seq", "p"]
    return (rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)


def with_places(corpus: Corpus, name: str = "corpus") -> Corpus:
    """``corpus`` with the places of tokens, staged."""
    terms = stage(corpus.postings.select("raw", "term").distinct(), f"{name}-terms")
    return replace(corpus, places=stage(token_places(corpus.entries, terms), f"{name}-places"))


def staged_index(entries: DataFrame, name: str = "corpus") -> Corpus:
    """An index written to the shared staging folder: entries once, postings sorted by term."""
    kept = stage(entries.select(*schemas.ENTRY_COLS), f"{name}-entries")
    postings = stage(staged_postings(kept, name), f"{name}-postings")
    return Corpus(kept, postings, stage(corpus_stats(kept, postings), f"{name}-stats"))
