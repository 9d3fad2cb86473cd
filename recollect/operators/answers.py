"""Answering a question: cache, retrieval, prompt, model routing. Models are plain callables."""

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from recollect import fixed, schemas
from recollect.functions import rules
from recollect.functions.text import normalize, nz
from recollect.operators import present, retrieve, rewrite
from recollect.operators.index import Corpus


def cache_key(question, db, top_k, large, small, auto_route, sort_by, restrict_finance, version) -> Column:
    """The key of a cached answer; every argument is a column."""
    flag = lambda c: c.cast("int").cast("string")
    return F.concat_ws("|", normalize(question), nz(db), top_k.cast("string"), nz(large), nz(small),
                       F.concat(F.lit("auto="), flag(auto_route)), F.concat(F.lit("sort="), sort_by),
                       F.concat(F.lit("rf="), flag(restrict_finance)), F.concat(F.lit("v="), version))


def fresh(cache: DataFrame, now: float) -> DataFrame:
    """Cached answers that are at most a day old. A missing time counts as 0."""
    return cache.where(F.lit(float(now)) - F.coalesce("cached_at_unix", F.lit(0.0)) <= fixed.CACHE_TTL_S)


def put(cache: DataFrame, rows: DataFrame, now: float) -> DataFrame:
    """The cache with new answers, old ones dropped."""
    kept = fresh(cache, now).join(rows.select("key"), "key", "left_anti")
    cols = schemas.ANSWER_CACHE.fieldNames()
    return kept.select(*cols).unionByName(rows.select(*cols))


def recall(cache, key: str, now: float) -> "Answer | None":
    """The answer that the cache holds under ``key``, if it isn't too old."""
    if cache is None:
        return None
    if isinstance(cache, dict):
        for k in [k for k, (at, _) in cache.items() if now - at > fixed.CACHE_TTL_S]:
            del cache[k]
        found = cache[key][1] if key in cache else None
        return found and Answer(found.text, found.rows, found.route, found.model, found.question, found.summary, True)
    row = cache.find(key, now)
    return row and Answer(row["answer"], [tuple(r) for r in row["rows"]], row["route"], row["used_model"], row["question"], row["summary"], True)


def remember(cache, key: str, answer: "Answer", now: float) -> None:
    """Rows are kept as text, as in the stored table."""
    if isinstance(cache, dict):
        cache[key] = (now, answer)
    elif cache is not None:
        rows = [[None if v is None else str(v) for v in r] for r in answer.rows]
        cache.keep((key, now, answer.text, rows, answer.model, answer.route, answer.question, answer.summary), now)


@dataclass
class Answer:
    text: str
    rows: list
    route: str
    model: str = ""
    question: str = ""
    summary: str = fixed.NO_HITS
    cached: bool = False


def _flags(df: DataFrame, **flags: Column) -> dict:
    return df.select(*[c.alias(k) for k, c in flags.items()]).first().asDict()


def answer_question(corpus: Corpus, question: str, chat, top_k: int = fixed.DEFAULT_TOP_K, large: str = "large",
                    small: str = "small", auto_route: bool = True, auto_correct: bool = True,
                    sort_by: str = retrieve.RELEVANT, restrict_finance: bool = True, user_synonyms=None,
                    cache=None, version: str = "1", index: str = "") -> Answer:
    """Answer one question. ``chat(model, prompt)`` returns text or raises; ``cache`` is a stored ``AnswerCache``, or a
    dict of this process. ``index`` names the corpus in the key, so that corpora can share a cache.

    The k records are small and meant for one reader, so they come to the driver; the search does not.
    """
    spark = corpus.entries.sparkSession
    q = (question or "").strip()
    if not q:
        return Answer(fixed.EMPTY_QUESTION, [], "")
    sort_by = sort_by if sort_by in (retrieve.RELEVANT, retrieve.RECENT) else retrieve.RELEVANT
    one = spark.createDataFrame([(q,)], "q string")
    lit = F.lit
    kind = _flags(one, aggregate=rules.is_aggregate_finance("q"), route=rules.route("q", auto_route), key=cache_key(
        F.col("q"), lit(index), lit(top_k), lit(large), lit(small), lit(auto_route), lit(sort_by), lit(restrict_finance), lit(version)))
    key = kind["key"]
    found = recall(cache, key, time.time())
    if found is not None:
        return found
    k = retrieve.effective_k(q, top_k)

    kept: list[DataFrame] = []
    try:
        return _answer(corpus, q, k, kind, kept, chat, key, cache, large, small, auto_route, auto_correct,
                       lambda text: retrieve.retrieve(corpus, text, k, sort_by, restrict_finance, user_synonyms))
    finally:
        for rows in kept:
            rows.unpersist()


def _answer(corpus, q, k, kind, kept, chat, key, cache, large, small, auto_route, auto_correct, search) -> Answer:
    """The flow after the cache; what it persists is listed in ``kept``."""
    spark = corpus.entries.sparkSession

    def read(text):
        kept.append(search(text).persist())
        return kept[-1], kept[-1].count()

    asked = q
    rows, n = read(q)
    if not n and auto_correct:
        other = rewrite.suggest_one(q, corpus.words if corpus.words is not None else rewrite.term_vocab(corpus.entries))
        if other != q:
            again, n = read(other)
            if n:
                rows, asked = again, other
    if not n:
        return Answer(fixed.NO_MATCH, [], "", question=asked)

    prompt = present.prompt(rows, asked, kind["aggregate"]).first()["prompt"]
    route = kind["route"]
    model = small if route == "small_first_factual" else large
    try:
        text = chat(model, prompt)
    except Exception as e:  # noqa: BLE001
        if model == large:
            return Answer(f"Search failed with model `{large}`: {e}", [], route, large)
        try:
            text, model, route = chat(large, prompt), large, f"{route}->large_fallback_on_error"
        except Exception as e2:  # noqa: BLE001
            return Answer(f"Search failed: `{small}`: {e}; `{large}`: {e2}", [], route, small)
    first_small = route == "small_first_factual" and small != large
    text = (text or "").strip() or fixed.NO_TEXT

    def judge(t):
        return _flags(spark.createDataFrame([(t,)], "t string"), low=rules.is_low_confidence("t"), refusal=rules.is_refusal("t"))

    def second(p):
        try:
            return (chat(large, p) or "").strip()
        except Exception:  # noqa: BLE001
            return ""

    if auto_route and first_small and judge(text)["low"]:
        other = second(prompt)
        if other:
            text, model, route = other, large, f"{route}->large_retry"
    if judge(text)["refusal"]:
        other = second(prompt + present.REMINDER + f"Question: {asked}\n")
        if other and not judge(other)["refusal"]:
            text, model, route = other, large, f"{route}->policy_retry_large"
    if asked != q:
        text = f"These are results for **{asked}**.  \nSearch instead for **{q}**.\n\n---\n\n{text}"

    shown = present.preview(rows, "place")
    result = Answer(text, [tuple(r)[1:] for r in shown.orderBy("place").collect()], route, model, asked,
                    present.hit_summary(shown).first()["summary"])
    remember(cache, key, result, time.time())
    return result


def recheck(corpus: Corpus, question: str, chat, **options) -> Answer:
    """Ask again with the large model only, without spelling."""
    return answer_question(corpus, question, chat, **{**options, "auto_route": False, "auto_correct": False})
