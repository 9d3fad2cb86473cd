"""Small rules, one table each."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from recollect import fixed
from recollect.functions import dates, fuzzy, rules
from recollect.functions.text import ascii_lower, search_lower, strip
from recollect.operators import answers, index, ingest, maintain, rewrite
from recollect.sources import cache as stored_answers, corpus as C
from recollect.sources.cache import AnswerCache


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_apple_time(spark):
    got = column(spark, [None, 0, 700000000, 725760123456789012, -5, 10 ** 12], dates.apple_iso, "bigint")
    assert got == [None, None, "2023-03-08T20:26:40+00:00", "2024-01-01T00:02:03.456789+00:00", "2000-12-31T23:59:55+00:00", None]


def test_local_time_does_not_follow_the_session_zone(spark):
    values = ["2024-03-10T09:59:59+00:00", "2024-03-10T10:00:00Z", "2023-07-01", "nope", "", None, "2023-01-01T00:30:00-08:00"]
    want = ["03/10/2024 1:59 am PST", "03/10/2024 3:00 am PDT", "06/30/2023 5:00 pm PDT", "nope", "", "", "01/01/2023 12:30 am PST"]
    old = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert column(spark, values, dates.local_datetime) == want
    spark.conf.set("spark.sql.session.timeZone", old)


def test_elapsed(spark):
    assert column(spark, [0.5, 59.7, 61.9, 3600.0, 90061.0], dates.elapsed, "double") == ["0s", "60s", "1m 1s", "1h 0m", "25h 1m"]


def test_extension(spark):
    assert column(spark, ["a.txt", ".bashrc", "a.tar.GZ", "foo.", "x", "~$a.doc"], rules.extension) == [".txt", "", ".gz", "", "", ".doc"]


def test_noise_now_and_when_pruning(spark):
    values = ["vendor", "Vendor", "Vendor/x", "a/nodeXmodules/b", "NODE_modules", "q/x.EGG-info/y", "x.egg-info", "a/vendors/"]
    assert column(spark, values, rules.is_noise_path) == [True, False, False, False, False, False, True, False]
    assert column(spark, values, rules.is_prunable) == [True, False, True, True, False, True, True, False]


def test_money_takes_unicode_digits_and_spaces(spark):
    assert column(spark, ["$5", "$ 5", "$ ٣", "v1.23", "1.2", "$x"], rules.has_money) == [True, True, True, True, False, False]


def test_strip_and_lower(spark):
    assert column(spark, ["  a\t\n", "\x1cb　", None], strip) == ["a", "b", None]
    values = ["ÉA", "KK", "İI", "abC"]
    assert column(spark, values, ascii_lower) == ["Éa", "kK", "İi", "abc"]
    assert column(spark, values, search_lower)[1:] == ["kK", "İi", "abc"]


def test_answers(spark):
    values = ["", "I'm not sure", "As an AI I cannot provide that", "cannot provide, see imsg:1", "It was $5", None]
    assert column(spark, values, rules.is_low_confidence) == [True, True, False, False, False, True]
    assert column(spark, values, rules.is_refusal) == [True, False, True, False, False, True]


def test_routes(spark):
    values = ["who called", "wholesale prices", "how much do I spend in total", "why is that", "Valkyries media day 2026", "what is a b c d e f g h"]
    assert column(spark, values, rules.route) == ["small_first_factual", "small_first_factual", "aggregate_finance->large",
                                                  "large_first_broad", "large_default", "large_default"]
    assert column(spark, values, lambda c: rules.route(c, False))[0] == "large_direct"


def test_truncate(spark):
    s = "x" * 10_001
    cut = column(spark, [s[:10_000], s], lambda c: ingest.truncate(c, 10_000))
    assert cut[0] == s[:10_000] and cut[1] == "x" * 9_920 + fixed.TRUNCATE_MARK


def test_expand():
    assert rewrite.expand("  ") == [""]
    assert rewrite.expand("lyft ride") == ["lyft ride"]
    assert rewrite.expand("Netflix") == ["Netflix", "net flix"]
    got = rewrite.expand("NYT bill", limit=fixed.MAX_EXPANSIONS)
    assert got[:5] == ["NYT bill", "nytimes bill", "new york times bill", "ny times bill", "nytimes.com bill"] and len(got) == 6
    assert rewrite.expand("net  flix show") == ["net  flix show"]          # the raw text has two spaces: nothing is replaced
    assert rewrite.expand("cab", {"cab": [r"a\1b"]}) == ["cab", r"a\1b"]   # aliases are taken as they stand


def test_expand_table_equals_expand(spark):
    qs = ["NYT bill", "HBO max texts", "  ", "lyft ride", "apple.com charge", "net  flix show", "uber price of the year", "a $5 fee"]
    user = {"lyft": ["cab (shared)"], "year": ["year", "12$ months"]}
    df = spark.createDataFrame([(i, v) for i, v in enumerate(qs)], "i int, question string")
    got = [r.expansions for r in rewrite.with_expansions(df, user=user).orderBy("i").collect()]
    assert got == [rewrite.expand(v, user) for v in qs]


def test_expand_by_a_table_equals_expand(spark):
    qs = ["NYT bill", "HBO max texts", "  ", "lyft ride", "apple.com charge", "net  flix show", "uber price of the year", "a $5 fee", "x", "", "lyft lyft LYFT café"]
    user = {"lyft": ["cab (shared)", "café"], "year": ["year", "12$ months", r"a\1b"], "a $5 fee": ["_fee_"]}
    pairs = [(i, a, b) for i, (a, b) in enumerate(rewrite.synonym_pairs(user))] + [(999, " ", "x"), (998, "absent", "y")]
    questions = spark.createDataFrame([(i, v, "kept") for i, v in enumerate(qs)] + [(99, None, "kept")], "qid int, question string, ord string")
    aliases = spark.createDataFrame(pairs, "ord bigint, present string, target string")
    rows = rewrite.expand_by(questions, aliases).orderBy("qid").collect()
    assert [r.expansions for r in rows] == [rewrite.expand(v, user) for v in qs] + [[""]] and {r["ord"] for r in rows} == {"kept"}
    none = rewrite.expand_by(questions, aliases.where("false"), limit=1).orderBy("qid").collect()
    assert [r.expansions for r in none] == [[v.strip()] for v in qs] + [[""]]
    assert rewrite.expand_by(questions.where("false"), aliases).collect() == []


def test_synonym_files(tmp_path):
    f = tmp_path / "s.json"
    f.write_text('{"_x": ["A"], "Uber": [" Cab ", "uber", ""], "n": "no", "e": [" "]}')
    user = rewrite.load_synonyms(str(f))
    assert user == {"_x": ["a"], "uber": ["cab", "uber"]}
    assert rewrite.merged_synonyms(user)["uber"] == ["uber", "uber trip", "uber technologies", "cab"]
    f.write_text("[1")
    assert rewrite.load_synonyms(str(f)) == {} and rewrite.load_synonyms(str(tmp_path / "none")) == {}


@pytest.mark.parametrize("cutoff", [0.3, 0.6, fixed.TYPO_CUTOFF])
def test_close_matches_equal_difflib(spark, cutoff):
    r = random.Random(3)
    vocab = list({"".join(r.choice("abcde") for _ in range(r.randint(3, 12))) for _ in range(400)} | {"tide", "subscription", "netflix"})
    words = ["".join(r.choice("abcde") for _ in range(r.randint(4, 12))) for _ in range(80)]
    words += ["diet", "subscripton", "netflxi", "netflix"] + [w[:3] + w[4:] for w in vocab[:60] if len(w) > 5] + [w + "a" for w in vocab[60:120]]
    words = [w for w in dict.fromkeys(words) if len(w) >= 4]
    got = {x.word: x.token for x in rewrite.close_matches(
        spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(v,) for v in vocab], "token string"), cutoff).collect()}
    want = {w: m[0] for w in words if (m := difflib.get_close_matches(w, vocab, n=1, cutoff=cutoff))}
    assert got == want


def test_ratio_equals_difflib(spark):
    r = random.Random(5)
    word = lambda n, letters="abcdeno": "".join(r.choice(letters) for _ in range(n))
    pairs = [("", ""), ("a", ""), ("", "b"), ("tide", "diet"), ("diet", "tide"), ("aaaa", "aa")] + [(word(r.randint(0, 12)), word(r.randint(0, 12))) for _ in range(300)]
    for _ in range(4):   # from 200 letters on, frequent letters begin no block
        a = word(210, "abcdefghijklmnopqrstuvwxyz0123456789")
        b = list(a)
        for _ in range(20):
            b[r.randrange(len(b))] = r.choice("abcxyz")
        pairs += [(a, "".join(b)), (word(30) + "qz" + word(10), word(210) + "qz" + word(3))]
    df = spark.createDataFrame(pairs, "a string, b string")
    for x in df.select("a", "b", fuzzy.ratio(F.col("a"), F.col("b")).alias("r")).collect():
        assert abs(x.r - difflib.SequenceMatcher(None, x.a, x.b).ratio()) < 1e-12


def test_suggest(spark):
    vocab = spark.createDataFrame([("netflix",), ("charge",), ("subscription",)], "token string")
    df = spark.createDataFrame([(1, "my  Netflixx chargee"), (2, "two  words"), (3, "")], "qid int, question string")
    got = {r.qid: r.suggestion for r in rewrite.suggest(df, vocab).collect()}
    assert got == {1: "my netflix charge", 2: "two  words", 3: ""}
    assert rewrite.suggest_one("netflixx", vocab) == "netflix"


def test_messages_once_per_uuid(spark):
    m = spark.createDataFrame([(1, "g", "first", 0, 1, 1), (2, "g", "second", 0, 0, 1), (3, None, "x", None, None, 9), (4, "h", " \t", 0, 0, 1)],
                              "rowid bigint, guid string, text string, date_raw bigint, is_from_me int, handle_rowid bigint")
    h = spark.createDataFrame([(1, " ann ")], "handle_rowid bigint, handle_id string")
    none = spark.createDataFrame([], "uuid string")
    first = {r.rowid: (r.uuid, r.vlm_text, r.status) for r in ingest.ingest_messages(m, h, none).collect()}
    assert first[1] == ("imsg:g", "source=messages direction=from_me handle=ann", "new") and first[2][2] == "known"
    assert first[3] == ("imsg:rowid:3", "source=messages direction=from_them handle=unknown", "new") and first[4][2] == "empty"
    forced = {r.rowid: r.status for r in ingest.ingest_messages(m, h, none, force=True).collect()}
    assert forced == {1: "replaced", 2: "new", 3: "new", 4: "empty"}


def test_upsert_is_idempotent(spark):
    from conftest import SF
    e = C.entries(spark, SF)
    new = e.where(F.col("uuid").startswith("doc:")).withColumn("ocr_text", F.lit("new"))
    once = maintain.upsert(e, new)
    assert sorted(once.collect()) == sorted(maintain.upsert(once, new).collect())
    assert once.count() == e.count()
    assert maintain.prune(maintain.prune(e)).count() == maintain.prune(e).count()


def test_answering(spark, tmp_path):
    from conftest import SF
    c = index.staged_index(C.entries(spark, SF))
    prompts, cache = [], {}

    def chat(model, prompt):
        prompts.append((model, prompt))
        return "I'm not sure" if model == "small" else "It was $5 (imsg:evt-1)"
    a = answers.answer_question(c, "what did netflix charge", chat, cache=cache)
    assert (a.route, a.model, len(a.rows)) == ("small_first_factual->large_retry", "large", 15)
    assert "Question: what did netflix charge" in prompts[0][1] and a.summary.startswith("### Search hits")
    assert answers.answer_question(c, " What did  netflix charge ", chat, cache=cache).cached
    stored = AnswerCache(spark, str(tmp_path / "answers"))
    first = answers.answer_question(c, "what did netflix charge", chat, cache=stored)
    again = answers.answer_question(c, " What did  netflix charge ", chat, cache=AnswerCache(spark, str(tmp_path / "answers")))
    assert not first.cached and again.cached and (again.text, again.route, again.summary, len(again.rows)) == (first.text, first.route, first.summary, len(first.rows))
    assert not answers.answer_question(c, "what did netflix charge", chat, cache=stored, top_k=3).cached
    none = answers.answer_question(c, "", chat)
    assert none.text == fixed.EMPTY_QUESTION

    def refusing(model, prompt):
        return "fine, see filename" if "Your last reply" in prompt else "I am an AI"
    assert answers.recheck(c, "capital one charge", refusing).route == "large_direct->policy_retry_large"

    def failing(model, prompt):
        raise RuntimeError("down")
    assert "failed" in answers.recheck(c, "capital one charge", failing).text


def test_stored_answers_are_rewritten_without_old_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored_answers, "FILES", 4)
    cache = AnswerCache(spark, str(tmp_path / "a"))
    row = lambda key, at, text="t": (key, at, text, [["1", None]], "m", "r", "q", "s")
    assert cache.find("k", 0.0) is None
    for key, at in (("old", 1.0), ("k", 90_000.0), ("k", 90_001.0), ("l", 90_002.0), ("m", 90_003.0)):
        cache.keep(row(key, at), 90_003.0)
    assert cache.find("old", 90_003.0) is None and cache.find("k", 90_003.0)["cached_at_unix"] == 90_001.0
    assert cache.find("m", 90_003.0)["rows"] == [["1", None]] and cache._generations() == [2]
    assert cache.find("k", 90_002.0 + 86_400) is None
