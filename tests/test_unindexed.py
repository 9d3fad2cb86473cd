"""Searches of entries without an index give what an index gives; nothing of an index is written for them."""

import pytest
from pyspark.sql import functions as F

from recollect import schemas
from recollect.functions.porter import stem_word
from recollect.functions.text import fold_str
from recollect.operators import index, retrieve, search, substring
from recollect.plans import queries
from tests.test_search import WORDS, corpus_rows


@pytest.fixture(scope="module")
def corpora(spark):
    entries = spark.createDataFrame(corpus_rows(120, 11), schemas.ENTRIES)
    return index.Corpus(entries), index.with_places(substring.indexed(index.staged_index(entries, "u"), "u"), "u")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_queries_read_entries_without_an_index(spark):
    c = queries.corpus(spark, "/root/testdata/sf0.001")
    assert c.postings is None and c.grams is None and c.symbols is None and c.places is None


@pytest.mark.parametrize("question", ["foo_bar", "etude happily", "charging netflix", "relational"])
def test_ranked_search_reads_the_tokens_it_asks_for(corpora, question):
    plain, indexed = corpora
    found = lambda c: [(r.uuid, round(r.rank, 9)) for r in search.search(c, question, 20).collect()]
    assert found(plain) == found(indexed) != []


def test_passes_share_a_scan(corpora):
    plain, indexed = corpora
    plan = retrieve.plan_question("netflix charge $12.50 texts", 5)
    found = lambda c: rows(retrieve.hits(c, plan).select("pass_no", "pos", "seq", F.round("rank", 9)))
    assert found(plain) == found(indexed) != []
    assert rows(substring.finance_sweep(plain).select("seq")) == rows(substring.finance_sweep(indexed).select("seq"))


def test_tokens_of_unique_entries_are_counted_in_their_rows(spark, corpora):
    e = corpora[0].entries
    got = index.count_tokens(e, True)
    assert rows(got.select("seq", "raw", "tf", "tf_text", "doc_len")) == rows(index.count_tokens(e).select("seq", "raw", "tf", "tf_text", "doc_len"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert index.unique_entries(e) and not index.unique_entries(e.unionByName(e.limit(1)))


def test_sums_without_an_index(corpora):
    plain, indexed = corpora
    e = plain.entries
    assert rows(index.text_stats(e)) == rows(indexed.stats)
    assert rows(index.place_sums(e)) == rows(indexed.places.groupBy("term").agg(F.count("*"), F.sum("p")))
    assert rows(substring.gram_rows(substring.text_vocabulary(e, True))) == rows(indexed.grams)


def test_stemming_changes_the_last_letters_only():
    words = [*WORDS, "nobility", "sensibility", "digitization", "happily", "skies", "hoping", "vivacity", "relational", "conformably"]
    for w in words:
        term, token = stem_word(w), fold_str(w)
        assert token.startswith(term[:max(1, len(term) - index.CHANGED)]), w
