"""Retrieval: several passes over the corpus, merged, filtered, scored and cut to the best k.

Passes are numbered in the order a sequential reader would run them; a later
pass overwrites the rank of an entry, the first one fixes its place. All
substring passes share one scan; what leaves the scan is narrow and limited
per pass, so everything after it is small.
"""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from recollect import fixed, schemas
from recollect.functions import rules
from recollect.functions.text import contains_any
from recollect.operators import rewrite, substring
from recollect.operators.index import Corpus, bucket_of
from recollect.operators.search import is_message, money_text, search_hits, sized_join, sweep_limit

RELEVANT, RECENT = "Most Relevant", "Most Recent"


@dataclass
class Plan:
    """The passes of one question. ``stops`` are the passes after which enough entries end the reading."""

    ranked: dict = field(default_factory=dict)      # pass -> phrases
    substring: dict = field(default_factory=dict)   # pass -> terms
    pings: dict = field(default_factory=dict)       # pass -> message word
    sweep: int | None = None
    stops: list = field(default_factory=list)
    limit: int = 60
    enough: int = 90


def plan_question(question: str, top_k: int, user_synonyms=None) -> Plan:
    """Passes of the interactive search."""
    plan = Plan(limit=max(4 * top_k, 40), enough=max(6 * top_k, 80))
    variants = rewrite.expand(question, user_synonyms, fixed.MAX_EXPANSIONS)
    no = _rank_passes(plan, variants)
    for v in variants:
        no += 1
        plan.substring[no] = rewrite.fallback_terms(v)
        plan.stops.append(no)
        for t in rewrite.ping_tokens(v):
            if t not in plan.pings.values():   # a repeated word finds what it found before
                no += 1
                plan.pings[no] = t
    if any(t in (question or "").lower() for t in fixed.SWEEP_TRIGGER_TERMS):
        plan.sweep = no + 1
    return plan


def plan_cli(question: str, top_k: int, user_synonyms=None) -> Plan:
    """Passes of the command-line search: no message words, no sweep, a lower bar."""
    plan = Plan(limit=top_k, enough=2 * top_k)
    variants = rewrite.expand(question, user_synonyms, fixed.MAX_EXPANSIONS)
    no = _rank_passes(plan, variants)
    for v in variants:
        no += 1
        plan.substring[no] = rewrite.fallback_terms(v)
        plan.stops.append(no)
    return plan


def _rank_passes(plan: Plan, variants: list[str]) -> int:
    for no, v in enumerate(variants, 1):
        tokens = rewrite.query_tokens(v)
        if rewrite.has_syntax_error(tokens):
            plan.substring[no] = rewrite.fallback_terms(v)   # the query language cannot read it
        elif tokens:
            plan.ranked[no] = rewrite.phrases(tokens)
    return len(variants)


# ===== passes ==========================================================================


def hits(corpus: Corpus, plan: Plan, features: dict | None = None) -> DataFrame:
    """seq, uuid, date_iso, ingested_at, pass_no, pos, rank and features of every entry a pass finds.

    The passes find their newest entries through the substring index, or without one share a scan; only these entries
    are read further, and the rows have at most *passes x limit* of them.
    """
    passes = {no: substring.term_pass(ts, plan.limit) for no, ts in plan.substring.items() if ts}
    passes |= {no: substring.term_pass([t], plan.limit, True) for no, t in plan.pings.items()}
    if plan.sweep:
        passes[plan.sweep] = substring.sweep_pass(sweep_limit(plan.limit))
    newest = [(no, seq, pos, 0.0) for no, seq, pos in substring.Lookup(corpus).newest(passes)]
    by_text = corpus.entries.sparkSession.createDataFrame(newest, "pass_no int, seq bigint, pos int, rank double")
    found = search_hits(corpus, plan.ranked, plan.limit).select("pass_no", "seq", "pos", "rank").unionByName(by_text)
    rows = substring.fetch(corpus, found, len(newest) + plan.limit * len(plan.ranked))
    if features:
        rows = rows.withColumn("_text", rules.joined_text())
    if plan.sweep:
        rows = rows.where((F.col("pass_no") != plan.sweep) | money_text())
    return rows.select("seq", "uuid", "date_iso", "ingested_at", *[c.alias(k) for k, c in (features or {}).items()], "pass_no", "pos", "rank")


def until_enough(found: DataFrame, plan: Plan) -> DataFrame:
    """Drop what passes find after enough entries are at hand; the sweep always counts.

    The stops cut the passes into blocks. A block is read if the blocks before
    it found fewer than ``enough`` distinct entries. ``found`` holds at most
    ``limit`` narrow rows per pass, so a running count in one task is small.
    """
    sweep = F.col("pass_no") == (plan.sweep or -1)
    block = sum((F.when(F.col("pass_no") > s, 1).otherwise(0) for s in plan.stops), F.lit(0))
    own = Window.partitionBy("seq", "_sweep").orderBy("pass_no")
    before = Window.orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)
    first = (F.row_number().over(own) == 1) & ~F.col("_sweep")
    rows = found.withColumns({"_sweep": sweep, "_block": block}).withColumn("_first", first.cast("int"))
    rows = rows.withColumn("_seen", F.coalesce(F.sum("_first").over(before), F.lit(0)))
    return rows.where(F.col("_sweep") | (F.col("_seen") < plan.enough)).drop("_sweep", "_block", "_first", "_seen")


def merge(found: DataFrame, plan: Plan, payload: list[str]) -> DataFrame:
    """One row per entry: the place of its first pass, the rank of its last one."""
    return until_enough(found, plan).groupBy("seq").agg(
        F.min(F.struct("pass_no", "pos")).alias("first_ord"), F.max_by("rank", "pass_no").alias("rank"),
        *[F.first(c).alias(c) for c in payload])


# ===== scoring =========================================================================


def score_features(question: str) -> dict[str, Column]:
    """What the order depends on, computed where the text is (``_text``, the joined fields in lower case)."""
    q = (question or "").lower()
    has = lambda terms: any(t in q for t in terms)
    text = F.col("_text")
    message = is_message()
    money_asked, nyt_asked = has(fixed.SCORE_FINANCE_TERMS), has(fixed.QUERY_NYT_TERMS)
    words = [t for t in re.findall(r"[a-z0-9'.-]+", q) if len(t) >= 3 and t not in fixed.OVERLAP_STOPWORDS]
    currency = rules.has_money(text) | contains_any(text, fixed.TEXT_CURRENCY_TERMS)
    nyt = contains_any(text, fixed.TEXT_NYT_TERMS)
    bank = rules.is_bank_text(text)
    points = [(text.contains(t), 1) for t in words]
    if nyt_asked:
        points.append((nyt, fixed.BONUS_NYT))
    if "subscription" in q:
        points.append((text.contains("subscription"), fixed.BONUS_SUBSCRIPTION))
    if money_asked:
        points.append((currency, fixed.BONUS_MONEY))
        points.append((message & currency & (nyt if nyt_asked else F.lit(True)), fixed.BONUS_MONEY_MESSAGE))
        points.append((message & bank, fixed.BONUS_BANK))
    total = F.lit(0)
    for condition, value in points:
        total = total + F.when(condition, value).otherwise(0)
    boosted = has(fixed.SCORE_FINANCE_TERMS + fixed.SCORE_MESSAGE_TERMS)
    return {"is_bank": bank, "score": total, "msg_pref": (message & F.lit(boosted)).cast("int")}


def is_finance(question: str) -> bool:
    q = rewrite.norm(question)
    return any(t in q for t in fixed.FINANCE_QUERY_TERMS)


def prefer_bank(rows: DataFrame) -> DataFrame:
    """Bank records only, if there are any; all rows otherwise."""
    any_bank = F.coalesce(F.bool_or("is_bank").over(Window.partitionBy()), F.lit(False))
    return rows.withColumn("_any", any_bank).where(F.col("is_bank") | ~F.col("_any")).drop("_any")


def order_by(sort_by: str) -> list[Column]:
    date = F.desc(F.coalesce("date_iso", F.lit("")))
    if sort_by == RECENT:
        return [date, F.desc("ingested_at"), F.asc("first_ord")]
    return [F.desc("msg_pref"), F.desc("score"), F.asc("rank"), date, F.asc("first_ord")]


def ranked_keys(corpus: Corpus, question: str, top_k: int = fixed.DEFAULT_TOP_K, sort_by: str = RELEVANT,
                restrict_finance: bool = True, user_synonyms=None) -> DataFrame:
    """seq, rank, score columns and place of the best k entries; no texts."""
    plan = plan_question(question, top_k, user_synonyms)
    found = hits(corpus, plan, score_features(question))
    rows = merge(found, plan, ["uuid", "date_iso", "ingested_at", "is_bank", "score", "msg_pref"])
    if restrict_finance and is_finance(question):
        rows = prefer_bank(rows)
    return _place(rows, order_by(sort_by), top_k)


def _place(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows with their place. The rows left are limited per pass, so one sort of narrow keys is enough."""
    top = rows.orderBy(*order).limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def retrieve(corpus: Corpus, question: str, top_k: int = fixed.DEFAULT_TOP_K, sort_by: str = RELEVANT,
             restrict_finance: bool = True, user_synonyms=None) -> DataFrame:
    """The best k entries for a question, best first (``place``)."""
    keys = ranked_keys(corpus, question, top_k, sort_by, restrict_finance, user_synonyms)
    return _fetch(corpus, keys.select("seq", "rank", "score", "msg_pref", "place"), top_k)


def retrieve_cli(corpus: Corpus, question: str, top_k: int = fixed.DEFAULT_TOP_K, user_synonyms=None) -> DataFrame:
    """The first k entries in the order the passes find them."""
    plan = plan_cli(question, top_k, user_synonyms)
    rows = merge(hits(corpus, plan), plan, [])
    return _fetch(corpus, _place(rows, [F.asc("first_ord")], top_k).select("seq", "rank", "place"), top_k)


def _fetch(corpus: Corpus, keys: DataFrame, k: int) -> DataFrame:
    """The full rows of the best k. With bucketed entries only the buckets of these rows are read."""
    entries = corpus.entries
    on = "seq"
    if corpus.buckets:
        keys, on = keys.withColumn("bucket", bucket_of("seq", corpus.buckets)), ["bucket", "seq"]
    else:
        entries = entries.select(*schemas.ENTRY_COLS)
    return sized_join(entries, keys, on, k).drop("bucket").orderBy("place").limit(k)


def effective_k(question: str, top_k: int) -> int:
    """Questions over many charges read more records."""
    q = rewrite.norm(question)
    wide = any(t in q for t in fixed.AGGREGATE_FINANCE_TERMS) and any(t in q for t in fixed.AGGREGATE_TERMS)
    return max(top_k, fixed.AGGREGATE_TOP_K) if wide else top_k
