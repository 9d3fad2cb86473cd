"""Index and search against SQLite's FTS5 as an independent second opinion."""

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from recollect import schemas
from recollect.functions.porter import stem_word, with_term
from recollect.operators import index, retrieve, rewrite, search, substring

WORDS = ["charge", "charged", "charging", "running", "runner", "run", "Étude", "élan", "naïve", "foo_bar", "foo bar", "generation",
         "happy", "happily", "ties", "bank's", "what's", "NYTimes", "Netflix", "$12.50", "2024-01-05", "relational", "hopping",
         "max", "maximum", "ÉCOLE", "straße", "a_b_c", "bars", "barking", "under", "sky"]


def corpus_rows(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(r.choice(WORDS) for _ in range(r.randint(0, 30)))
        vlm = " ".join(r.choice(WORDS) for _ in range(r.randint(0, 4)))
        kind = r.choice(["imsg:", "doc:", ""])
        date = r.choice([None, "2024-01-05T10:00:00+00:00", "2023-12-31T23:00:00-08:00", f"2022-01-{r.randint(10, 28)}"])
        rows.append((i, f"{kind}{i}", f"file_{r.choice(WORDS)}.txt", date, text if r.random() > .05 else None, vlm, "", float(1000 + i // 3)))
    return rows


def sqlite_db(rows):
    con = sqlite3.connect(":memory:")
    con.row_factory = sqlite3.Row
    con.execute("CREATE TABLE m (uuid TEXT PRIMARY KEY, filename TEXT, date_iso TEXT, ocr_text TEXT, vlm_text TEXT, ingested_at REAL)")
    con.execute("CREATE VIRTUAL TABLE x USING fts5(uuid UNINDEXED, doc, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(x, 'instance')")
    for _, uuid, name, date, ocr, vlm, _, at in rows:
        con.execute("INSERT INTO m VALUES (?,?,?,?,?,?)", (uuid, name, date, ocr, vlm, at))
        con.execute("INSERT INTO x VALUES (?,?)", (uuid, "\n".join(t or "" for t in (name, date, ocr, vlm))))
    return con


@pytest.fixture(scope="module")
def both(spark):
    rows = corpus_rows(150, 7)
    entries = spark.createDataFrame(rows, schemas.ENTRIES)
    return rows, sqlite_db(rows), index.staged_index(entries, "t")


@pytest.fixture(scope="module")
def quick(both):
    """The same corpus with the tables of the substring search and the places of tokens."""
    return index.with_places(substring.indexed(both[2], "t"), "t")


@pytest.mark.parametrize("question", ["foo_bar", "foo_ba sky", "foo_bar foo_bar a_b", "bar_foo", "2024_01_05"])
def test_phrases_from_places_equal_phrases_from_texts(both, quick, question):
    want = [(r.uuid, r.rank) for r in search.search(both[2], question, 30).collect()]
    assert [(r.uuid, r.rank) for r in search.search(quick, question, 30).collect()] == want
    assert want or question in ("bar_foo", "2024_01_05")


def test_postings_equal_the_lexical_index(both):
    rows, con, c = both
    want = {}
    for term, doc in con.execute("SELECT term, doc FROM v"):
        want[(term, doc - 1)] = want.get((term, doc - 1), 0) + 1
    got = {(r.term, r.seq): r.n for r in c.postings.groupBy("term", "seq").agg(F.sum("tf").alias("n")).collect()}
    assert got == want
    stats = c.stats.first()
    assert (stats.n_docs, stats.total_len) == (len(rows), sum(want.values()))


QUESTIONS = ["charging netflix", "running", "runn", "foo_bar", "a_b_c under", "foo_ba charged", "max happy", "ÉTUDE naive", "étude élan",
             "charge charge max", "generation relational ties", "zzz charge", "NEAR sky", "the of", "___ max", "bars max happily hopping"]


@pytest.mark.parametrize("question", QUESTIONS)
def test_ranked_search_equals_fts5(both, question):
    _, con, c = both
    query = rewrite.prefix_query(question)
    want = list(con.execute("SELECT uuid, bm25(x) AS r FROM x WHERE x MATCH ? ORDER BY r, rowid LIMIT 20", (query,))) if query else []
    got = search.search(c, question, 20).select("uuid", "rank").collect()
    assert [r.uuid for r in got] == [r["uuid"] for r in want]
    assert all(abs(a.rank - b["r"]) < 1e-9 for a, b in zip(got, want))


@pytest.mark.parametrize("question", ["bank's charge", "2024-01-05 charge", "NOT max", "v1.5 sky"])
def test_unreadable_questions(both, question):
    _, con, c = both
    tokens = rewrite.query_tokens(question)
    query = rewrite.prefix_query(question)
    try:
        con.execute("SELECT 1 FROM x WHERE x MATCH ?", (query,)).fetchall()
        readable = True
    except sqlite3.OperationalError:
        readable = False
    assert rewrite.has_syntax_error(tokens) is not readable
    if not readable:
        with pytest.raises(ValueError):
            search.search(c, question)


def like_rows(con, terms, where="1", limit=10):
    cond = " OR ".join("lower(ocr_text) LIKE ? OR lower(vlm_text) LIKE ? OR lower(filename) LIKE ?" for _ in terms)
    args = [f"%{t}%" for t in terms for _ in range(3)]
    return [r["uuid"] for r in con.execute(
        f"SELECT uuid FROM m WHERE {where} AND ({cond}) ORDER BY date_iso DESC, ingested_at DESC, rowid LIMIT {limit}", args)]


@pytest.mark.parametrize("question", ["charge maximum", "what's up", "foo_ba", "école", "ÉCOLE", "$12.50", "the of", "a", "%", "un_er"])
def test_substring_search_equals_like(both, question):
    _, con, c = both
    got = [r.uuid for r in search.substring_search(c.entries, question, 10).collect()]
    assert got == like_rows(con, rewrite.fallback_terms(question))


@pytest.mark.parametrize("question,named", [("charge maximum", 500), ("charge maximum", 0), ("arg", 500), ("what's up", 0), ("école", 500), ("$12.50", 500), ("%", 500), ("un_er", 500), ("zzzz", 0)])
def test_substring_search_through_the_vocabulary_equals_like(both, quick, question, named, monkeypatch):
    _, con, _ = both
    monkeypatch.setattr(substring, "NAMED_TOKENS", named)
    monkeypatch.setattr(substring, "FIRST", 1)
    assert [r.uuid for r in substring.substring_search(quick, question, 10).collect()] == like_rows(con, rewrite.fallback_terms(question))


def test_only_candidates_are_read(quick):
    top = quick.entries.select("seq").limit(3)
    plan = substring.fetch(quick, top, 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert substring.handle("a.b") == ("symbol", ".") and substring.handle("ab_%é") is None and substring.handle("x_Apple.COM") == ("piece", "apple")


def test_blank_question_finds_nothing(both, quick):
    assert search.substring_search(both[2].entries, "  ", 10).count() == 0
    assert substring.substring_search(quick, "  ", 10).count() == 0


def test_message_ping_keeps_stop_words_and_quotes(both, quick):
    _, con, c = both
    for rows in (search.message_ping(c.entries, "The bank's max, foo", 5), substring.message_ping(quick, "The bank's max, foo", 5)):
        got = {}
        for r in rows.orderBy("token", "pos").collect():
            got.setdefault(r.token, []).append(f"{r.seq}")
        for t in ["the", "bank's", "max", "foo"]:
            want = [u.split(":")[1] for u in like_rows(con, [t], "uuid LIKE 'imsg:%'", 5)]
            assert got.get(t, []) == want


def sequential(con, question, k, cli=False):
    """The passes run one after the other over SQLite, into one dictionary."""
    limit, enough = (k, 2 * k) if cli else (max(4 * k, 40), max(6 * k, 80))
    found = {}

    def put(uuids, ranks=None):
        for i, u in enumerate(uuids):
            found[u] = ranks[i] if ranks else 0.0
    variants = rewrite.expand(question)
    for v in variants:
        query = rewrite.prefix_query(v)
        try:
            rows = con.execute("SELECT uuid, bm25(x) AS r FROM x WHERE x MATCH ? ORDER BY r, rowid LIMIT ?", (query, limit)).fetchall() if query else []
            put([r["uuid"] for r in rows], [r["r"] for r in rows])
        except sqlite3.OperationalError:
            put(like_rows(con, rewrite.fallback_terms(v), limit=limit))
    for v in variants:
        terms = rewrite.fallback_terms(v)
        put(like_rows(con, terms, limit=limit) if terms else [])
        if len(found) >= enough:
            break
        if not cli:
            for t in re.findall(r"[a-z0-9'.-]+", v.lower()):
                if len(t) >= 3:
                    put(like_rows(con, [t], "uuid LIKE 'imsg:%'", limit))
    return found


@pytest.mark.parametrize("question,k", [("max happy", 3), ("charge max", 15), ("bank's charge", 5), ("netflix", 12), ("foo_bar sky", 2)])
def test_merge_equals_a_sequential_run(both, quick, question, k):
    rows, con, scanned = both
    for c, cli in ((scanned, True), (scanned, False), (quick, True), (quick, False)):
        want = sequential(con, question, k, cli)
        plan = (retrieve.plan_cli if cli else retrieve.plan_question)(question, k)
        plan.sweep = None
        got = retrieve.merge(retrieve.hits(c, plan), plan, []).orderBy("first_ord").collect()
        assert [rows[r.seq][1] for r in got] == list(want)
        assert all(abs(r.rank - x) < 1e-9 for r, x in zip(got, want.values()))


def test_cli_results_are_the_first_k(both):
    _, con, c = both
    want = list(sequential(con, "charge max", 6, cli=True))[:6]
    assert [r.uuid for r in retrieve.retrieve_cli(c, "charge max", 6).collect()] == want


def test_driver_and_table_stemming_agree(spark):
    words = [w.lower() for w in WORDS if w.isalpha()] + ["nationally", "éducation", "ponies", "caresses", "yelling", "tional", "ii", "élle"]
    got = {r.raw: r.term for r in with_term(spark.createDataFrame([(w,) for w in words], "raw string")).collect()}
    assert got == {w: stem_word(w) for w in words}


def test_keep_first_cuts_before_the_shuffle_at_any_limit(spark):
    wide = spark.range(9000).selectExpr("id AS seq", "IF(id < 8000, 'hot', 'b') AS g", "id AS o")
    first = search.keep_first(wide, "g", [F.asc("o")], 4000)
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString() and first.count() == 5000
    df = spark.range(5000).selectExpr("id AS seq", "IF(id % 3 = 0, 'hot', 'b') AS g", "id * 7919 % 5003 AS o")
    got = sorted((r.g, r.o) for r in search.keep_first(df, "g", [F.asc("o")], 40).collect())
    every = [("hot" if i % 3 == 0 else "b", i * 7919 % 5003) for i in range(5000)]
    want = [x for g in ("b", "hot") for x in sorted(e for e in every if e[0] == g)[:40]]
    assert got == sorted(want)


def test_ranking_scans_the_postings_once(both):
    _, _, c = both
    df = search.search(c, "charge max", 5)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 1
