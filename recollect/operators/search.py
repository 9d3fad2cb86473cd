"""Lexical search: BM25 over the postings and substring search over the entries."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from recollect import fixed
from recollect.functions.porter import with_term
from recollect.functions.text import any_of, ascii_lower, like_contains, nz, runs, search_lower
from recollect.operators import rewrite
from recollect.operators.index import Corpus, for_phrases
from recollect.operators.ingest import index_doc

BROADCAST_ROWS = rewrite.BROADCAST_ROWS


def keep_first(df: DataFrame, group: str, order: list[Column], n: int, position: str = "pos") -> DataFrame:
    """The first n rows of each group, numbered. Spark cuts each group to n rows before the shuffle, up to the session's threshold."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(position, F.row_number().over(w)).where(F.col(position) <= n)


def sized_join(big: DataFrame, small: DataFrame, key: str | list[str], rows: int, how: str = "inner") -> DataFrame:
    """Join with a side of at most ``rows`` narrow rows: sent around when that is little, shuffled otherwise."""
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, key, how)


# ===== BM25 ========================================================================


def _phrase_occurrences(corpus: Corpus, phrase: tuple[str, ...]) -> DataFrame:
    """seq, tf of a phrase of several terms.

    A term at place p that is the j-th of the phrase votes for a start at p - j; a start with all votes is an
    occurrence. Votes come from the stored places of tokens, or else from the texts of entries that hold every term.
    """
    last = len(phrase) - 1
    match = lambda j: F.col("term").startswith(phrase[j]) if j == last else F.col("term") == phrase[j]
    tokens = corpus.places.where(any_of([match(j) for j in range(last + 1)])) if corpus.places is not None else _read_places(corpus, match, last)
    votes = tokens.select("seq", "p", F.explode(F.filter(F.array(
        *[F.when(match(j), F.lit(j)) for j in range(last + 1)]), lambda j: j.isNotNull())).alias("j"))
    starts = votes.groupBy("seq", (F.col("p") - F.col("j")).alias("start")).agg(F.count("*").alias("v"))
    return starts.where(F.col("v") == last + 1).groupBy("seq").agg(F.count("*").alias("tf"))


def _read_places(corpus: Corpus, match, last: int) -> DataFrame:
    """term, seq, p of all tokens of the entries that hold every term."""
    held = corpus.postings.where(any_of([match(j) for j in range(last + 1)])).groupBy("seq").agg(
        *[F.max(match(j)).alias(f"h{j}") for j in range(last + 1)])
    for j in range(last + 1):
        held = held.where(F.col(f"h{j}"))
    texts = corpus.entries.join(held.select("seq"), "seq", "left_semi")
    return with_term(texts.select("seq", F.posexplode(runs(index_doc())).alias("p", "raw")))


@dataclass(frozen=True)
class Ranked:
    """Which phrases each pass wants; phrases are shared between passes."""

    phrases: list
    passes: dict

    @staticmethod
    def of(queries: dict) -> "Ranked":
        """From pass number -> list of phrases. A pass with an empty phrase can match nothing."""
        able = {n: p for n, p in queries.items() if p and all(p)}
        every = list(dict.fromkeys(x for p in able.values() for x in p))
        return Ranked(every, {n: [every.index(x) for x in p] for n, p in able.items()})


def phrase_counts(corpus: Corpus, phrases: list) -> DataFrame:
    """seq, doc_len and one column of occurrences per phrase, for entries that hold any of them.

    The prefix conditions reach the Parquet scan; only matching postings are shuffled, by entry.
    """
    single = [i for i, p in enumerate(phrases) if len(p) == 1]
    several = [i for i, p in enumerate(phrases) if len(p) > 1]
    parts = []
    if single:
        parts.append(corpus.postings.where(any_of([F.col("term").startswith(phrases[i][0]) for i in single])).select(
            "seq", "doc_len", *[F.when(F.col("term").startswith(phrases[i][0]), F.col("tf")).otherwise(0).alias(f"tf{i}")
                                if i in single else F.lit(0).cast("bigint").alias(f"tf{i}") for i in range(len(phrases))]))
    for k in several:
        found = _phrase_occurrences(corpus, phrases[k])
        lens = corpus.postings.where(F.col("term").startswith(phrases[k][-1])).select("seq", "doc_len").distinct()
        parts.append(found.join(lens, "seq").select("seq", "doc_len", *[
            (F.col("tf") if i == k else F.lit(0).cast("bigint")).alias(f"tf{i}") for i in range(len(phrases))]))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("seq").agg(F.max("doc_len").alias("doc_len"),
                                   *[F.sum(f"tf{i}").alias(f"tf{i}") for i in range(len(phrases))])


def bm25(corpus: Corpus, queries: dict) -> DataFrame:
    """pass_no, seq, rank for every entry that matches all phrases of a pass; lower ranks are better.

    Document frequencies and corpus statistics enter as scalar subqueries. The frequencies read every column that the
    scores read, so that both come from one scan and one exchange.
    """
    ranked = Ranked.of(queries)
    if not ranked.passes:
        return corpus.entries.sparkSession.createDataFrame([], "pass_no int, seq bigint, rank double")
    if corpus.postings is None:
        corpus = for_phrases(corpus, ranked.phrases)
    n = len(ranked.phrases)
    counts = phrase_counts(corpus, ranked.phrases)
    df = counts.agg(F.max("doc_len").alias("longest"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"n{i}") for i in range(n)])
    with_stats = counts.withColumns({
        "df": df.select(F.struct("*")).scalar(), "st": corpus.stats.select(F.struct("n_docs", "total_len")).scalar()})
    docs = F.col("st.n_docs").cast("double")
    average = F.col("st.total_len").cast("double") / docs
    norm = F.lit(fixed.BM25_K1) * (1 - fixed.BM25_B + fixed.BM25_B * F.col("doc_len") / average)

    def part(i: int) -> Column:
        hits = F.col(f"df.n{i}").cast("double")
        idf = F.log((docs - hits + 0.5) / (hits + 0.5))
        idf = F.when(idf <= 0, F.lit(fixed.BM25_MIN_IDF)).otherwise(idf)
        tf = F.col(f"tf{i}").cast("double")
        return idf * (tf * (fixed.BM25_K1 + 1) / (tf + norm))

    scores = with_stats.withColumns({f"s{i}": part(i) for i in range(n)})
    per_pass = []
    for no, wanted in ranked.passes.items():
        total = F.lit(0.0)
        for i in wanted:
            total = total + F.col(f"s{i}")
        all_in = F.lit(True)
        for i in dict.fromkeys(wanted):
            all_in = all_in & (F.col(f"tf{i}") > 0)
        per_pass.append(F.when(all_in, F.struct(F.lit(no).alias("pass_no"), (-total).alias("rank"))))
    return scores.select("seq", F.explode(F.filter(F.array(*per_pass), lambda p: p.isNotNull())).alias("p")).select(
        "p.pass_no", "seq", "p.rank")


def search_hits(corpus: Corpus, queries: dict, limit: int) -> DataFrame:
    """pass_no, seq, rank, pos: the best ``limit`` entries of each pass, ties in insertion order."""
    return keep_first(bm25(corpus, queries), "pass_no", [F.asc("rank"), F.asc("seq")], limit)


def match(corpus: Corpus, question: str) -> DataFrame:
    """seq of every entry in which each word of the question starts a word."""
    return bm25(corpus, {1: rewrite.phrases(rewrite.query_tokens(question))}).select("seq")


def search(corpus: Corpus, question: str, limit: int = 25) -> DataFrame:
    """The entries that match best, with ``rank``, ``pos``. Questions the query language cannot read are an error."""
    tokens = rewrite.query_tokens(question)
    if rewrite.has_syntax_error(tokens):
        raise ValueError(f"not a valid prefix query: {rewrite.prefix_query(question)}")
    hits = search_hits(corpus, {1: rewrite.phrases(tokens)}, limit).drop("pass_no")
    return sized_join(corpus.entries, hits, "seq", limit).orderBy("pos")


# ===== substring search ================================================================

def recency() -> list[Column]:
    """Newest first: dates are ordered as text, NULL last; ties in insertion order."""
    return [F.col("date_iso").desc_nulls_last(), F.desc("ingested_at"), F.asc("seq")]


def lowered(entries: DataFrame, terms=()) -> DataFrame:
    """The three searched fields, A-Z in lower case, as columns of their own.

    They come from an array of one row: a condition on them stays above it. Moved below a plain projection, it would
    lower the text again for each term.
    """
    low = search_lower if all(t.isascii() for t in terms) else ascii_lower
    once = F.struct(low(nz("ocr_text")).alias("_ocr"), low(nz("vlm_text")).alias("_vlm"), low(nz("filename")).alias("_name"))
    return entries.withColumn("_low", F.explode(F.array(once))).select("*", "_low._ocr", "_low._vlm", "_low._name").drop("_low")


def has_term(term: str) -> Column:
    return any_of([like_contains(F.col(c), term) for c in ("_ocr", "_vlm", "_name")])


def is_message(uuid="uuid") -> Column:
    return F.col(uuid).startswith("imsg:")


def substring_search(entries: DataFrame, question: str, limit: int = 25) -> DataFrame:
    """The newest entries that hold any term anywhere, with rank 0."""
    terms = rewrite.fallback_terms(question)
    found = lowered(entries, terms).where(any_of([has_term(t) for t in terms]) if terms else F.lit(False))
    return found.drop("_ocr", "_vlm", "_name").withColumn("rank", F.lit(0.0)).orderBy(*recency()).limit(limit)


def message_ping(entries: DataFrame, question: str, limit: int) -> DataFrame:
    """token, seq, pos: per word of the question, the newest messages that hold it. One scan for all words."""
    tokens = rewrite.ping_tokens(question)
    msgs = lowered(entries.where(is_message()), tokens)
    hit = msgs.select("seq", "date_iso", "ingested_at", F.explode(F.filter(F.array(
        *[F.when(has_term(t), F.lit(t)) for t in tokens]), lambda t: t.isNotNull())).alias("token"))
    return keep_first(hit, "token", recency(), limit).select("token", "seq", "pos")


def sweep_condition() -> Column:
    """Messages that look like money, by substring (A-Z in any case)."""
    return is_message() & any_of([F.col("_ocr").contains(t) for t in fixed.SWEEP_TEXT_TERMS])


def sweep_limit(candidates: int) -> int:
    return max(4 * candidates, 200)


def money_text() -> Column:
    from recollect.functions.rules import has_money
    return has_money(F.concat(nz("ocr_text"), F.lit(" "), nz("vlm_text")))


def finance_sweep(entries: DataFrame, candidates: int = 60) -> DataFrame:
    """The newest money-like messages, and of those the ones with an amount. The limit comes before the amounts."""
    found = lowered(entries).where(sweep_condition()).drop("_ocr", "_vlm", "_name")
    cut = found.orderBy(*recency()).limit(sweep_limit(candidates))
    return cut.where(money_text()).withColumn("rank", F.lit(0.0))
