"""Steps that grow with the corpus: what they write, how often they read a text, what they send around."""

import difflib
import os
import re

import pytest
from pyspark.sql import functions as F

from recollect import schemas
from recollect.functions.porter import STEP2, STEP3, STEP4, stem_word
from recollect.functions.text import fold_str, lower_runs, runs, search_lower
from recollect.operators import index, rewrite, search, substring
from recollect.sources.store import CorpusStore
from tests.test_search import WORDS, corpus_rows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_texts_are_lowered_as_a_whole(spark):
    texts = ["Plain ASCII-Text 42_x", "Éclair ÀB, Straße", "ΑΣ'Α ΟΔΟΣ. Σ", "İstanbul 300K É", "éÁ Ⅷ Ⓐ ǅ", "", None, "—", "日本語 ÄÖ٣"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(lower_runs("t").alias("a"), F.transform(runs("t"), search_lower).alias("b")).collect():
        assert r.a == r.b


def test_a_scan_lowers_each_field_once(spark):
    entries = spark.createDataFrame(corpus_rows(5, 3), schemas.ENTRIES)
    found = search.lowered(entries, ["one", "two"]).where(search.has_term("one") | search.has_term("two")).select("seq")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\blower\(", plan)) == 3, plan


def test_only_tokens_that_a_phrase_can_touch_are_kept(spark):
    assert index.heads("on") == {"on"} and index.heads("ab") == {"ab"} and index.heads("noble") == {"noble", "nobl", "nob"}
    ends = [*STEP2, *STEP3, *STEP4, "s", "sses", "ies", "ed", "eed", "ing", "y", "ility", "bility", "ency", "ll", "le"]
    for w in WORDS + [b + x + y for b in ("hop", "abl", "nation", "civil", "b") for x in ends for y in ("", *ends)]:
        term = stem_word(w)
        for k in range(1, len(term) + 1):
            assert any(fold_str(w).startswith(h) for h in index.heads(term[:k])), (w, term[:k])


@pytest.mark.parametrize("parts", [(), ("grams",)])
def test_a_store_makes_only_its_tables(spark, tmp_path, parts):
    base = spark.createDataFrame(corpus_rows(40, 7), schemas.ENTRIES)
    store = CorpusStore(spark, str(tmp_path), buckets=2, parts=parts)
    store.apply(base, merge=False)
    store.delete(F.col("seq") % 5 == 0, merge=False)
    for s in store.state()[1]:
        assert set(os.listdir(tmp_path / "segments" / s.name)) == {"entries", "gone", *parts}
    c, left = store.corpus(), base.where("seq % 5 <> 0")
    assert rows(c.entries.select("seq", "uuid")) == rows(left.select("seq", "uuid"))
    assert rows(c.stats) == rows(index.text_stats(left))
    if "grams" in parts:
        live = c.grams.groupBy("gram", "raw", "term").agg(F.sum("df").alias("df")).where("df > 0")
        assert rows(live) == rows(substring.gram_rows(substring.text_vocabulary(left, True))) != []
    with pytest.raises(ValueError):
        store.compact()


def test_spelling_sends_no_table_around(spark):
    words, vocab = ["netflx", "chrage", "postde", "abcd", "relatoinal", "tets"], ["netflix", "charge", "posted", "relational", "test", "abce", "tests"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    v = spark.createDataFrame([(w,) for w in vocab], "token string")
    got = rewrite.close_matches(rewrite.misspelt(df, v), v)
    want = {}
    for w in words:
        best = max((difflib.SequenceMatcher(None, t, w).ratio(), t) for t in vocab)
        if best[0] >= 0.86:
            want[w] = best[1]
    assert {r.word: r.token for r in got.collect()} == want and want
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_marks_of_a_scan(spark):
    entries = spark.createDataFrame(corpus_rows(30, 5), schemas.ENTRIES)
    passes = {1: substring.term_pass([WORDS[0].lower()], 5), 2: substring.sweep_pass(5), 3: substring.term_pass([WORDS[1].lower(), "no such"], 4)}
    plain = substring.Lookup(index.Corpus(entries)).newest(passes)
    indexed = substring.Lookup(substring.indexed(index.staged_index(entries, "m"), "m")).newest(passes)
    assert sorted(plain) == sorted(indexed) != []


def test_quality_figures_are_plain_functions(spark):
    from recollect.llm.quality import base, words_of
    df = spark.createDataFrame([(" a\tbé #x#\n\x0b|🙂 <b> ",), ("",), (None,), (" \r\n",)], "text string")
    c = words_of(F.col("text"))
    assert [(r.w, r.n, r.s) for r in df.select(c.alias("w"), base(F.col("text"), c)["word_chars"].alias("n"), base(F.col("text"), c)["n_symbols"].alias("s")).collect()] == [
        (["a", "bé", "#x#", "|🙂", "<b>"], 11, 5), ([], 0, 0), ([], 0, 0), ([], 0, 0)]
    assert "lambdafunction" not in df.select(c)._jdf.queryExecution().optimizedPlan().toString()
