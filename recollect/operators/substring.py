"""Substring search over the vocabulary: trigrams give tokens, postings give entries, and only their texts are read.

A term's pieces are its runs of three or more ASCII letters and digits. An entry can hold the term only if one of its
tokens holds the piece, so the piece's rarest trigram leads to few tokens, these to postings, and these to entries.
A term without such a piece is found by one of its ASCII symbols; a term with neither (under three letters,
or beyond ASCII) keeps the exact scan. What is found is a superset; the newest candidates are verified on their
texts, in rounds that go further back until every pass has enough entries or no more candidates.
"""

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from recollect.functions.porter import with_term
from recollect.functions.text import any_of, ascii_lower_str, lower_runs, nz
from recollect.operators import rewrite, search
from recollect.operators.index import Corpus, bucket_of, build_postings
from recollect.session import stage

#: Tokens, at most, that are named in a condition on the postings; more of them are joined.
NAMED_TOKENS = 500
#: Candidates verified first, as a multiple of the rows wanted, and how much further each round goes.
FIRST, FURTHER = 4, 8
SYMBOL = "[!-/:-@\\[-`{-~]"


# ===== tables ============================================================================


def vocabulary(postings: DataFrame) -> DataFrame:
    """raw, term, df: the tokens of texts (not of dates alone), and how many entries hold each."""
    return postings.where("tf_text > 0").groupBy("raw", "term").agg(F.count("*").alias("df"))


def text_vocabulary(entries: DataFrame, unique: bool = False) -> DataFrame:
    """``vocabulary`` from the texts: of ``unique`` entries each row gives its distinct tokens, which are counted before the shuffle and stemmed once."""
    if not unique:
        return vocabulary(build_postings(entries))
    text = lower_runs(F.concat_ws("\n", nz("filename"), nz("ocr_text"), nz("vlm_text")))
    tokens = entries.select(F.explode(F.array_distinct(text)).alias("raw"))
    return with_term(tokens.groupBy("raw").agg(F.count("*").alias("df"))).select("raw", "term", "df")


def gram_rows(vocab: DataFrame) -> DataFrame:
    """gram, raw, term, df: the ASCII trigrams of each token."""
    places = F.when(F.length("raw") > 2, F.sequence(F.lit(1), F.length("raw") - 2)).otherwise(F.array().cast("array<int>"))
    rows = vocab.select("raw", "term", "df", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("raw"), i, F.lit(3))))).alias("gram"))
    return rows.where(F.col("gram").rlike("^[a-z0-9]{3}$")).select("gram", "raw", "term", "df")


def grams(vocab: DataFrame, partitions: int | None = None) -> DataFrame:
    """``gram_rows``, range-partitioned and sorted like the postings."""
    rows = gram_rows(vocab)
    keys = ["gram", "raw"]
    return (rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)


def symbols(entries: DataFrame, partitions: int | None = None) -> DataFrame:
    """symbol, seq: the ASCII symbols of each entry, range-partitioned and sorted."""
    text = F.concat(nz("filename"), nz("ocr_text"), nz("vlm_text"))
    rows = entries.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(0)))).alias("symbol"), "seq")
    keys = ["symbol", "seq"]
    return (rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)


def indexed(corpus: Corpus, name: str = "corpus") -> Corpus:
    """``corpus`` with the tables of the substring search, staged."""
    return replace(corpus, grams=stage(grams(vocabulary(corpus.postings)), f"{name}-grams"), symbols=stage(symbols(corpus.entries), f"{name}-symbols"), memo={})


def gram_counts(table: DataFrame) -> dict[str, int]:
    """Tokens of each trigram; there are 36**3 trigrams at most."""
    return {r["gram"]: r["n"] for r in table.groupBy("gram").agg(F.count("*").alias("n")).collect()}


# ===== terms =============================================================================


def handle(term: str) -> tuple[str, str] | None:
    """("piece", the longest run of letters and digits) or ("symbol", one of its symbols); None: only a scan finds the term."""
    plain = re.split("[_%]", ascii_lower_str(term))   # these two are wildcards
    pieces = [p for part in plain for p in re.findall("[a-z0-9]{3,}", part)]
    if pieces:
        return "piece", max(pieces, key=len)
    marks = [c for part in plain for c in part if re.match(SYMBOL, c)]
    return ("symbol", marks[0]) if marks else None


@dataclass(frozen=True)
class Pass:
    """Entries that hold any of ``terms``; ``condition`` is exact, on lowered columns; ``limit`` newest ones are wanted."""

    terms: list
    condition: Callable[[], Column]
    limit: int
    messages: bool = False
    any_term: bool = True   # ``condition`` is that a term is held


@dataclass
class Lookup:
    """Finds candidates in one corpus; the counts of trigrams are read once. Without trigrams every pass scans."""

    corpus: Corpus

    def rarest(self, piece: str) -> str:
        if "gram_counts" not in self.corpus.memo:
            self.corpus.memo["gram_counts"] = gram_counts(self.corpus.grams)
        return min((piece[i:i + 3] for i in range(len(piece) - 2)), key=lambda g: (self.corpus.memo["gram_counts"].get(g, 0), g))

    def tokens(self, pieces: list[str]) -> DataFrame:
        """piece, raw, term, df: the tokens that hold a piece."""
        holds = [(p, (F.col("gram") == self.rarest(p)) & F.col("raw").contains(p)) for p in pieces]
        which = F.filter(F.array(*[F.when(c, F.lit(p)) for p, c in holds]), lambda x: x.isNotNull())
        rows = self.corpus.grams.where(any_of([c for _, c in holds])).select(F.explode(which).alias("handle"), "raw", "term", "df")
        # a stored corpus has a row for each segment, with what it adds or takes away
        return rows.groupBy("handle", "raw", "term").agg(F.sum("df").alias("df")).where("df > 0")

    def candidates(self, handles: set[tuple[str, str]]) -> tuple[DataFrame | None, int | None]:
        """(handle, seq) of all entries that can hold the handles' terms, and a bound of the rows if it is known."""
        pieces, marks = (sorted(h for kind, h in handles if kind == k) for k in ("piece", "symbol"))
        parts, bound = [], 0
        if pieces:
            tokens = self.tokens(pieces)
            few = tokens.limit(NAMED_TOKENS + 1).collect()
            postings = self.corpus.postings.where("tf_text > 0")
            if len(few) <= NAMED_TOKENS:
                bound = sum(r["df"] for r in few)
                terms = sorted({r["term"] for r in few})
                named = self.corpus.entries.sparkSession.createDataFrame([tuple(r) for r in few], tokens.schema)
                found = postings.where(any_of([F.col("term") == t for t in terms]) if terms else F.lit(False)).join(F.broadcast(named), ["raw", "term"])
            else:
                bound, found = None, postings.join(tokens, ["raw", "term"])
            parts.append(found.select("handle", "seq"))
        if marks:
            bound = None
            parts.append(self.corpus.symbols.where(F.col("symbol").isin(marks)).select(F.col("symbol").alias("handle"), "seq"))
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out, bound

    def newest(self, passes: dict[int, Pass]) -> list[tuple[int, int, int]]:
        """(pass, seq, pos): the ``limit`` newest entries of each pass. At most passes x limit rows come to the driver."""
        handles = {no: [handle(t) for t in p.terms] for no, p in passes.items() if p.terms}
        indexed = {no: set(hs) for no, hs in handles.items() if None not in hs}
        if self.corpus.grams is None:
            return self._read(passes, handles, indexed)
        out = self._scanned({no: passes[no] for no in handles if no not in indexed})
        if not indexed:
            return out
        every = set().union(*indexed.values())
        found, bound = self.candidates(every)
        spark = self.corpus.entries.sparkSession
        wanted = spark.createDataFrame([(no, h[1]) for no, hs in indexed.items() for h in hs], "pass_no int, handle string")
        found = found.join(F.broadcast(wanted), "handle").select("pass_no", "seq").distinct()
        keys = self.corpus.entries.select("seq", search.is_message().alias("message"), "date_iso", "ingested_at")
        rows = len(indexed) * bound if bound is not None else search.BROADCAST_ROWS + 1
        messages = [no for no in indexed if passes[no].messages]
        placed = search.sized_join(keys, found, "seq", rows)
        if messages:
            placed = placed.where(F.col("message") | ~F.col("pass_no").isin(messages))
        times, open_ = FIRST, dict(indexed)
        while open_:
            most = {no: times * passes[no].limit for no in open_}
            top = search.keep_first(placed.where(F.col("pass_no").isin(list(open_))), "pass_no", search.recency(), max(most.values()))
            read = self._verified(top.where(_per_pass({no: F.col("pos") <= n for no, n in most.items()})).select("pass_no", "seq", "pos"),
                                  {no: passes[no] for no in open_}, sum(most.values()))
            for no in list(open_):
                own = sorted((pos, seq) for n, seq, pos, ok in read if n == no and ok)[:passes[no].limit]
                if len(own) == passes[no].limit or sum(1 for n, *_ in read if n == no) < most[no]:
                    out += [(no, seq, i) for i, (_, seq) in enumerate(own, 1)]
                    del open_[no]
            times *= FURTHER
        return out

    def _verified(self, top: DataFrame, passes: dict[int, Pass], rows: int) -> list[tuple]:
        """(pass, seq, pos, whether the text holds a term) of the candidates, which are the only texts read."""
        terms = [t for p in passes.values() for t in p.terms]
        texts = search.lowered(fetch(self.corpus, top, rows), terms)
        return [tuple(r) for r in texts.select("pass_no", "seq", "pos", _per_pass({no: p.condition() for no, p in passes.items()}).alias("ok")).collect()]

    def _read(self, passes: dict[int, Pass], handles: dict, indexed: dict) -> list[tuple[int, int, int]]:
        """``newest`` of a corpus without trigrams. Rows that share a ``seq`` count as the verified candidates of an index do."""
        found = self._scanned({no: passes[no] for no in handles}, indexed)
        out, top = [x for x in found if x[0] not in indexed], [x for x in found if x[0] in indexed]
        if len({(no, seq) for no, seq, _ in top}) == len(top):
            return out + top
        held = self._verified(_frame(self.corpus, top), {no: passes[no] for no in indexed}, len(top))
        for no in indexed:
            own = sorted((pos, seq) for n, seq, pos, ok in held if n == no and ok)[:passes[no].limit]
            out += [(no, seq, i) for i, (_, seq) in enumerate(own, 1)]
        return out

    def _scanned(self, passes: dict[int, Pass], keyed=()) -> list[tuple[int, int, int]]:
        """One scan of the entries for all passes that need one; ``keyed`` ones find no entry without a ``seq``.

        What it finds is staged as narrow rows (key, order, which terms are held). The newest ones of each pass come from these by a
        limit, which keeps no more than that in memory; a window by pass would sort every row found, once a pass.
        """
        if not passes:
            return []
        terms = list(dict.fromkeys(t for p in passes.values() if p.any_term for t in p.terms))
        tests = [search.has_term(t) for t in terms] + [p.condition() for p in passes.values() if not p.any_term]
        marks = {no: [terms.index(t) for t in p.terms] for no, p in passes.items() if p.any_term}
        marks |= {no: [len(terms) + i] for i, no in enumerate(no for no, p in passes.items() if not p.any_term)}
        rows = search.lowered(self.corpus.entries, [t for p in passes.values() for t in p.terms])
        kept = stage(rows.where(any_of(tests)).select("seq", "date_iso", "ingested_at", search.is_message().alias("message"), F.array(*tests).alias("held")), "marks")
        found = None
        for no, p in passes.items():
            able = any_of([F.get("held", F.lit(i)) for i in marks[no]])
            able = able & F.col("message") if p.messages else able
            able = able & F.col("seq").isNotNull() if no in keyed else able
            own = kept.where(able).select("seq", "date_iso", "ingested_at").orderBy(*search.recency()).limit(p.limit).withColumn("pass_no", F.lit(no))
            found = own if found is None else found.unionByName(own)
        top = search.keep_first(found, "pass_no", search.recency(), max(p.limit for p in passes.values()))
        return [tuple(r) for r in top.select("pass_no", "seq", "pos").collect()]


def _per_pass(conditions: dict[int, Column]) -> Column:
    out = F.lit(False)
    for no, c in conditions.items():
        out = F.when(F.col("pass_no") == no, c).otherwise(out)
    return out


def fetch(corpus: Corpus, keys: DataFrame, rows: int) -> DataFrame:
    """Entries of the keys (with ``seq``), of which there are at most ``rows``. Of bucketed entries only their buckets are read."""
    if corpus.buckets:
        return search.sized_join(corpus.entries, keys.withColumn("bucket", bucket_of("seq", corpus.buckets)), ["bucket", "seq"], rows)
    return search.sized_join(corpus.entries, keys, "seq", rows)


# ===== searches ============================================================================


def term_pass(terms: list[str], limit: int, messages: bool = False) -> Pass:
    return Pass(terms, lambda: any_of([search.has_term(t) for t in terms]), limit, messages)


def _frame(corpus: Corpus, rows: list[tuple]) -> DataFrame:
    return corpus.entries.sparkSession.createDataFrame(rows, "pass_no int, seq bigint, pos int")


def substring_search(corpus: Corpus, question: str, limit: int = 25) -> DataFrame:
    """The newest entries that hold any term anywhere, with rank 0."""
    terms = rewrite.fallback_terms(question)
    found = Lookup(corpus).newest({1: term_pass(terms, limit)}) if terms else []
    return fetch(corpus, _frame(corpus, found), limit).withColumn("rank", F.lit(0.0)).orderBy("pos").drop("pass_no", "pos", "bucket")


def message_ping(corpus: Corpus, question: str, limit: int) -> DataFrame:
    """token, seq, pos: per word of the question, the newest messages that hold it."""
    tokens = rewrite.ping_tokens(question)
    found = Lookup(corpus).newest({i: term_pass([t], limit, True) for i, t in enumerate(tokens)})
    rows = [(tokens[no], seq, pos) for no, seq, pos in found]
    return corpus.entries.sparkSession.createDataFrame(rows, "token string, seq bigint, pos int")


def sweep_pass(limit: int) -> Pass:
    from recollect import fixed
    return Pass(fixed.SWEEP_TEXT_TERMS, search.sweep_condition, limit, True, False)


def finance_sweep(corpus: Corpus, candidates: int = 60) -> DataFrame:
    """The newest money-like messages, and of those the ones with an amount. The limit comes before the amounts."""
    most = search.sweep_limit(candidates)
    found = Lookup(corpus).newest({1: sweep_pass(most)})
    return fetch(corpus, _frame(corpus, found), most).where(search.money_text()).withColumn("rank", F.lit(0.0)).drop("pass_no", "pos", "bucket")
