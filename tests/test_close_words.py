"""Pairs of close words, and aliases in texts: found by hashes, none missed, few too many."""

import difflib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.functions import struck, windows
from recollect.operators import rewrite


def changed(r, word, n):
    for _ in range(n):
        i = r.randrange(len(word) + 1)
        word = r.choice([word[:i] + word[i + 1:], word[:i] + r.choice("abn-") + word[i:], word[:i] + r.choice("abn") + word[i + 1:]])
    return word


@pytest.fixture(scope="module")
def lists():
    r = random.Random(3)
    vocab = {"".join(r.choice(["th", "er", "an", "on", "e"]) for _ in range(r.randrange(2, 12))) for _ in range(150)}
    vocab |= {"".join(r.choice("abcdefgh0123456789") for _ in range(n)) for n in (17, 18, 19, 24, 31, 40, 63, 64, 65, 80) for _ in range(2)}
    vocab = sorted(v for v in vocab if len(v) > 2)
    words = sorted({changed(r, w, r.randrange(1, 2 + len(w) // 9)) for w in vocab for _ in range(2)} - set(vocab))
    return [w for w in words if len(w) > 3], vocab


def test_no_close_word_is_missed(spark, lists):
    words, vocab = lists
    want = {}
    for w in words:
        best = max((difflib.SequenceMatcher(None, t, w).ratio(), t) for t in vocab)
        if best[0] >= 0.86:
            want[w] = best[1]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: r.token for r in rewrite.close_matches(df, spark.createDataFrame([(v,) for v in vocab], "token string")).collect()}
    assert got == want and {len(w) for w in want} & set(range(5, 12)) and max(map(len, want)) > 64


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


def test_pairs_are_those_with_enough_letters_in_common(spark, lists):
    words, vocab = ([w for w in x if len(w) <= 16] for x in lists)
    able = struck.able(0.86)
    want = {(w, t) for w in words for t in vocab if (len(w), len(t)) in able and common(w, t) >= able[len(w), len(t)]}
    w, t = spark.createDataFrame([(x,) for x in words], "word string"), spark.createDataFrame([(x,) for x in vocab], "token string")
    by_word, by_token = struck.ways(able, 0), struck.ways(able, 1)
    kept = struck.word_filter(w, by_word)
    got = struck.struck(w, "word", by_word).join(struck.struck(t, "token", by_token, kept), "hash").select("word", "token").distinct()
    assert {tuple(r) for r in got.collect()} == want != set()
    everything = struck.struck(t, "token", by_token).count()
    assert struck.struck(t.where("token rlike '[0-9]'"), "token", by_token, kept).count() < everything / 10


def test_windows_that_are_aliases_leave_the_task(spark, monkeypatch):
    monkeypatch.setattr(windows, "CHARACTERS", 40)
    texts = ["find max text of user.12 and user.1", "", "x", "user.1", "日本語 🙂 étude user.12🙂", "etude " * 30, "no alias here"]
    needles = ["user.1", "user.12", "🙂", "étude", "etude e", "text of"]
    t = spark.createDataFrame([(10 + i, x) for i, x in enumerate(texts)], "k int, t string").repartition(2)
    n = spark.createDataFrame([(x,) for x in needles], "n string")
    got = windows.held_windows(t, "k", "t", n, "n").join(windows.with_hash(n, "n"), "_hash")
    assert sorted((r.k, r.n) for r in got.collect()) == sorted((10 + i, x) for i, text in enumerate(texts) for x in needles if x in text)
    assert windows.held_windows(t, "k", "t", n.where(F.lit(False)), "n").count() == 0
    left = windows.held_windows(t, "k", "t", n, "n").count()
    assert left == sum(x in text for text in texts for x in needles)   # nothing else is shuffled


def test_hashes_stand_for_texts(spark):
    a = dict(zip(("ab", "ba"), next(windows._whole(pa.array(["ab", "ba"]))), strict=True))
    assert {(int(h), int(r)) for h, r in ((h, r) for hs, rs in windows.window_hashes(["xaba", "b"], [2]) for h, r in zip(hs, rs, strict=True))} >= {
        (int(a["ab"]), 0), (int(a["ba"]), 0)}
