"""Expected results of the registered queries, as SQL."""

from recollect import fixed
from recollect.plans import oracle as o
from recollect.plans.oracle import any_in, any_prefix, inlist, like_any, lst, normalize, q, sql

ORACLE: dict[str, str] = {}
NL = "chr(10)"
LABEL = ("CASE WHEN starts_with(uuid, 'imsg:') THEN 'Messages' WHEN starts_with(uuid, 'doc:') THEN 'Document' "
         "ELSE 'Photos / Local file' END")
MSG = "starts_with(uuid, 'imsg:')"

# ===== ingest =========================================================================
ORACLE["entries_count_by_source"] = sql(f"SELECT {LABEL} AS source, count(*) AS n FROM entries GROUP BY 1", "entries")
ORACLE["entries_total"] = sql("SELECT count(*) AS n FROM entries", "entries")
ORACLE["index_documents"] = sql(
    f"SELECT seq, uuid, ingested_at, md5(filename || {NL} || coalesce(date_iso, '') || {NL} || coalesce(ocr_text, '') || {NL} "
    "|| coalesce(vlm_text, '')) AS doc_md5 FROM entries", "entries")
ORACLE["scan_messages"] = sql(
    "SELECT rowid, guid, md5(text) AS text_md5, CAST(date_raw AS BIGINT) AS date_raw, CAST(is_from_me AS INT) AS is_from_me, handle_id FROM msg0", "msg0")
ORACLE["scan_messages_first"] = sql(
    "SELECT rowid, guid, md5(text) AS text_md5, handle_id FROM (SELECT * FROM msg0 ORDER BY rowid LIMIT 100)", "msg0")
ORACLE["ingest_messages"] = sql(
    "SELECT rowid, uuid, filename, date_iso, md5(ocr_text) AS ocr_text_md5, vlm_text, image_path_used, status FROM msg_rows", "msg_rows")
STORED_CHAT = "SELECT uuid FROM msg_rows WHERE status = 'new' AND rowid < 1000000000000"
INCREMENTAL = f"""
  SELECT rowid, uuid, CASE WHEN status <> 'new' THEN status WHEN uuid IN ({STORED_CHAT}) THEN 'known'
         WHEN row_number() OVER (PARTITION BY uuid, status ORDER BY rowid) > 1 THEN 'known' ELSE 'new' END AS status FROM msg_rows"""
ORACLE["ingest_messages_incremental"] = sql(INCREMENTAL, "msg_rows")
ORACLE["ingest_messages_counts"] = sql(f"SELECT status, count(*) AS n FROM ({INCREMENTAL}) GROUP BY 1", "msg_rows")
ORACLE["already_indexed"] = sql(f"SELECT uuid FROM msg_rows WHERE uuid IN ({STORED_CHAT})", "msg_rows")
ORACLE["ingest_documents_status"] = sql("SELECT rel_path, ext, status FROM classified", "classified")
ORACLE["ingest_documents_status_all_media"] = sql(
    """SELECT rel_path, CASE WHEN status <> 'media' THEN status WHEN outside_root THEN 'outside'
         WHEN rel_path LIKE '.%' OR rel_path LIKE '%/.%' THEN 'hidden'
         WHEN rel_path SIMILAR TO '(.*/)?(node_modules|vendor|__pycache__|[^/]*\\.egg-info|[^/]*\\.dist-info)/.*' THEN 'noise'
         ELSE 'candidate' END AS status FROM classified""", "classified")
ORACLE["ingest_documents_skip_counts"] = sql(
    "SELECT status, count(*) AS n FROM classified WHERE status <> 'outside' GROUP BY 1", "classified")
ORACLE["ingest_documents_rows"] = sql(
    "SELECT uuid, filename, date_iso, md5(ocr_text) AS ocr_text_md5, vlm_text, image_path_used, status FROM document_rows", "document_rows")
ORACLE["ingest_documents_truncated"] = sql(
    f"SELECT uuid, md5(ocr_text) AS ocr_text_md5, CAST(length(ocr_text) AS INT) AS n_chars FROM ({o.doc_rows(10000)})", "files")
ORACLE["ingest_unchanged_skip"] = sql(
    """SELECT w.uuid, w.rel_path, e.uuid IS NOT NULL AND contains(e.vlm_text, ' mtime_ns=' || w.m || ' size=' || w.s || chr(10)) AS unchanged
       FROM (SELECT 'doc:' || substr(sha256('/corpus/' || rel_path), 1, 24) AS uuid, rel_path,
               CASE WHEN length(name) % 5 = 0 THEN mtime_ns + 1 ELSE mtime_ns END AS m,
               CASE WHEN length(rel_path) % 7 = 0 THEN size + 1 ELSE size END AS s FROM classified WHERE status = 'candidate') w
       LEFT JOIN entries e ON e.uuid = w.uuid""", "classified", "entries")
ORACLE["extract_plain_text"] = sql(
    "SELECT rel_path, md5(text) AS text_md5, CAST(length(text) AS INT) AS n_chars FROM files", "files")
EXTRACTED = f"""
  SELECT rel_path, ext IN {inlist(fixed.TEXT_EXT)} AS ok, ext IN ('.pdf', '.docx') AS failed, ext
  FROM classified WHERE status = 'candidate'"""
REPORT = f"""
  SELECT CASE WHEN failed THEN 'error' ELSE 'empty' END AS kind, rel_path, 'unsupported' AS extractor,
         CASE WHEN failed THEN 'ImportError: no reader for ' || ext END AS error FROM ({EXTRACTED}) WHERE NOT ok"""
ORACLE["skipped_report"] = sql(f"SELECT kind, rel_path, extractor, error FROM ({REPORT})", "classified")
ORACLE["skipped_report_capped"] = sql(
    f"SELECT kind, rel_path, extractor, error FROM ({REPORT}) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY rel_path) <= 100", "classified")
ORACLE["skipped_report_overflow"] = sql(
    f"SELECT kind, count(*) AS n, greatest(count(*) - 100, 0) AS not_listed FROM ({REPORT}) GROUP BY 1", "classified")
ORACLE["ingest_photos_rows"] = sql(
    "SELECT uuid, filename, date_iso, ocr_text, vlm_text, image_path_used, caption_error, status FROM photo_rows", "photo_rows")
ORACLE["ingest_photos_path_first"] = sql(
    """SELECT uuid, '' AS vlm_text, coalesce(original, preview) AS image_path_used,
         CASE WHEN coalesce(original, preview) IS NULL THEN 'no_path' ELSE 'new' END AS status FROM photo WHERE NOT is_movie""", "photo")
ORACLE["ingest_photos_incremental"] = sql(
    "SELECT CASE WHEN status = 'new' AND caption_error THEN 'known' ELSE status END AS status, count(*) AS n FROM photo_rows GROUP BY 1", "photo_rows")
ORACLE["upsert_entries"] = sql(
    f"""SELECT seq, uuid, date_iso, md5(ocr_text) AS ocr_text_md5, ingested_at FROM entries
          WHERE uuid NOT IN (SELECT uuid FROM again WHERE status = 'new')
        UNION ALL
        SELECT seq, uuid, date_iso, md5(ocr_text), CAST(1700000000 + seq % 86400 AS DOUBLE) FROM again WHERE status = 'new'""",
    "entries", touched="SELECT seq + 8000000000000 AS seq, rel_path, name, mtime_ns + 1000000000 AS mtime_ns, size, text FROM doc_files",
    again=o.doc_rows(None, "touched"))

# ===== rewriting ======================================================================
ORACLE["fts_query_builder"] = sql(
    """SELECT qid, array_to_string(list_transform(toks, lambda w: w || '*'), ' AND ') AS fts_query,
         len(list_filter(toks, lambda w: contains(w, '.') OR contains(w, '-') OR w = 'NOT')) > 0 AS syntax_error FROM qtokens""", "qtokens")
TERMS = """(SELECT qid, question, CASE WHEN len(toks) > 0 THEN array_to_string(list_transform(list_filter(low, lambda w, i: list_position(low, w) = i), lambda w: w), '|')
         ELSE {whole} END AS terms FROM (SELECT *, list_transform(toks, lambda w: lower(w)) AS low FROM qtokens))""".format(whole=o.strip("question"))
ORACLE["fallback_terms"] = sql(f"SELECT qid, terms FROM {TERMS}", "qtokens")
ORACLE["normalize_question"] = sql(f"SELECT qid, {normalize('question')} AS normalized FROM questions", "questions")


def expansion(user: dict) -> str:
    groups = {k: [k, *v] for k, v in fixed.SYNONYMS.items()}
    for k, v in user.items():
        groups[k] = groups[k] + v if k in groups else [k, *v]
    values = ", ".join(f"({g}, {i}, {q(t)})" for g, ts in enumerate(groups.values()) for i, t in enumerate(ts))
    return sql(
        f"""SELECT qid, CAST(pos AS INT) AS pos, expansion FROM (
              SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ord) - 1 AS pos, expansion FROM firsts) WHERE pos < 6""",
        "questions",
        syn=f"SELECT * FROM (VALUES {values}) t(g, i, term)",
        base=f"SELECT qid, {o.strip('question')} AS b, {normalize('question')} AS n FROM questions",
        pairs="SELECT a.g, a.i AS i, b.i AS j, a.term AS present, b.term AS target FROM syn a JOIN syn b ON a.g = b.g AND a.term <> b.term",
        every=f"""SELECT qid, 0 AS ord, b AS expansion FROM base
          UNION ALL SELECT qid, 1 + g * 10000 + i * 100 + j,
             regexp_replace(b, regexp_replace(present, '([.])', '\\\\\\1', 'g'), target, 'gi') FROM base JOIN pairs ON contains(n, present) WHERE b <> ''
          UNION ALL SELECT qid, 1000000, b || ' new york times' FROM base
             WHERE len(list_filter(regexp_extract_all(b, '[A-Za-z][A-Za-z0-9''.-]+'), lambda t: lower(t) = 'nyt')) > 0""",
        firsts=f"SELECT qid, min(ord) AS ord, arg_min(expansion, ord) AS expansion FROM every GROUP BY qid, {normalize('expansion')}")


ORACLE["synonym_expand"] = expansion({})
ORACLE["synonym_expand_user"] = expansion({"uber": ["cab ride"], "texts": ["texts", "chat"]})
ORACLE["synonym_expand_table"] = sql(
    """SELECT qid, CAST(pos AS INT) AS pos, expansion FROM (
         SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY kind, ord) - 1 AS pos, expansion FROM firsts) WHERE pos < 6""",
    "questions",
    pairs="""SELECT DISTINCT user_id AS ord, 'user.' || user_id AS present, 'account ' || user_id AS target FROM events
      UNION ALL SELECT -1 - min(event_id), event_type, 'some ' || event_type FROM events GROUP BY event_type""",
    base=f"SELECT qid, {o.strip('question')} AS b, {normalize('question')} AS n FROM questions",
    every="""SELECT qid, 0 AS kind, 0 AS ord, b AS expansion FROM base
      UNION ALL SELECT qid, 1, ord, regexp_replace(b, replace(present, '.', '[.]'), target, 'gi') FROM base JOIN pairs ON contains(n, present) WHERE b <> ''
      UNION ALL SELECT qid, 2, 0, b || ' new york times' FROM base
         WHERE len(list_filter(regexp_extract_all(b, '[A-Za-z][A-Za-z0-9''.-]+'), lambda t: lower(t) = 'nyt')) > 0""",
    firsts=f"SELECT qid, min((kind, ord))[1] AS kind, min((kind, ord))[2] AS ord, arg_min(expansion, (kind, ord)) AS expansion FROM every GROUP BY qid, {normalize('expansion')}")
VOCAB = """SELECT DISTINCT lower(unnest(regexp_extract_all(concat_ws(' ', filename, coalesce(ocr_text, ''), coalesce(vlm_text, '')),
         '[A-Za-z][A-Za-z0-9''-]{2,}'))) AS token FROM entries"""
ORACLE["term_vocab"] = sql(VOCAB, "entries")
NAME = "CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE lower(c_name) END"
ORACLE["term_vocab_newest"] = sql(
    """SELECT DISTINCT lower(unnest(regexp_extract_all(concat_ws(' ', filename, coalesce(ocr_text, ''), coalesce(vlm_text, '')),
         '[A-Za-z][A-Za-z0-9''-]{2,}'))) AS token FROM (SELECT * FROM entries ORDER BY ingested_at DESC, seq LIMIT 5000)""", "entries")
# blocks of a pair, part by part: the longest common block (k, first in the token, then in the word), then what is left of it and right of it
ORACLE["typo_suggest"] = sql(
    """SELECT qid, md5(question) AS question_md5, CASE WHEN bool_or(token IS NOT NULL) THEN string_agg(coalesce(token, w), ' ' ORDER BY i) ELSE any_value(question) END AS suggestion
       FROM split LEFT JOIN best ON best.word = lower(w) GROUP BY qid, question""", "questions", "entries",
    typed="""SELECT qid, regexp_replace(question, '(^| )([A-Za-z]{4})([a-z])([a-z])', '\\1\\2\\4\\3', 'g') AS question FROM questions""",
    split=f"""SELECT qid, question, unnest(l) AS w, unnest(range(len(l))) AS i FROM (
                SELECT qid, question, string_split({o.strip(f"regexp_replace(coalesce(question, ''), {q(o.WS_CLASS + '+')}, ' ', 'g')")}, ' ') AS l FROM typed)""",
    vocab=VOCAB,
    words="""SELECT DISTINCT lower(w) AS word FROM split WHERE length(w) >= 4 AND octet_length(encode(lower(w))) = length(lower(w)) AND lower(w) NOT IN (SELECT token FROM vocab)""",
    pairs="""SELECT word, token, length(word) AS lb, length(token) AS la FROM words JOIN vocab ON length(token) <= 1.33 * length(word) AND length(word) <= 1.33 * length(token)
               AND levenshtein(word, token) <= 0.14 * (length(word) + length(token)) + 1e-9""",
    blocks="""WITH RECURSIVE r AS (
                SELECT word, token, 0 AS k, {'a': 0, 'b': la, 'c': 0, 'd': lb} AS p FROM pairs
                UNION ALL
                SELECT word, token, k, unnest(list_filter([{'a': p.a, 'b': i, 'c': p.c, 'd': j}, {'a': i + k, 'b': p.b, 'c': j + k, 'd': p.d}, {'a': -1, 'b': 0, 'c': 0, 'd': 0}],
                       lambda x: x.a < 0 OR (k > 0 AND x.a < x.b AND x.c < x.d))) FROM (
                  SELECT word, token, p, k, i, p.c + strpos(inner_part, substr(token, i + 1, k)) - 1 AS j FROM (
                    SELECT word, token, p, inner_part, CAST(ceil(best / 1000000.0) AS INT) AS k, CAST(1000000 * ceil(best / 1000000.0) - best AS INT) AS i FROM (
                      SELECT word, token, p, inner_part, coalesce(list_max(flatten(list_transform(range(p.a, p.b), lambda i: list_transform(range(1, least(p.b - i, p.d - p.c) + 1),
                             lambda k: CASE WHEN contains(inner_part, substr(token, CAST(i + 1 AS BIGINT), k)) THEN 1000000 * k - i END)))), 0) AS best
                      FROM (SELECT word, token, p, substr(word, p.c + 1, p.d - p.c) AS inner_part FROM r WHERE p.a >= 0)))))
              SELECT word, token, CAST(sum(k) AS BIGINT) AS matched FROM r WHERE p.a < 0 GROUP BY word, token""",
    best="""SELECT word, token FROM blocks WHERE 2.0::DOUBLE * matched / (length(word) + length(token)) >= 0.86
            QUALIFY row_number() OVER (PARTITION BY word ORDER BY 2.0::DOUBLE * matched / (length(word) + length(token)) DESC, token DESC) = 1""")
NAME = "CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE lower(c_name) END"
ORACLE["alias_upsert"] = f"""
  WITH c AS (SELECT c_custkey, lower(c_mktsegment) AS seg, lower(c_name) AS nm, c_custkey % 2 = 0 AS old, c_name FROM customer)
  SELECT c_custkey, 0 AS pos, seg AS alias_key, CASE WHEN old THEN nm || '|x|new one' ELSE c_name || '| X |' END AS alias_values FROM c
  UNION ALL SELECT c_custkey, 1, '_note', 'Keep Me' FROM c
  UNION ALL SELECT c_custkey, 2, ' Other ', 'B|b |  ' FROM c
  UNION ALL SELECT c_custkey, 3, nm, 'new one|' || nm || '|x' FROM c WHERE NOT old"""
ORACLE["alias_remove"] = """
  SELECT c_custkey, 0 AS pos, '_note' AS alias_key, 'Keep Me' AS alias_values FROM customer
  UNION ALL SELECT c_custkey, 1, ' Other ', 'B|b |  ' FROM customer"""
ORACLE["alias_save"] = """
  SELECT c_custkey, 0 AS pos, lower(c_mktsegment) AS alias_key, lower(c_name) || '|x' AS alias_values FROM customer
  UNION ALL SELECT c_custkey, 1, '_note', 'Keep Me' FROM customer
  UNION ALL SELECT c_custkey, 2, 'other', 'b|b' FROM customer"""

# ===== index and search ===============================================================
ORACLE["index_terms"] = sql("SELECT raw, term FROM stems", "stems")
ORACLE["index_postings"] = sql("SELECT term, raw, seq, tf, tf_text, doc_len FROM postings", "postings")
ORACLE["index_stats"] = sql("SELECT n_docs, total_len FROM stats", "stats")
ORACLE["fts_match_prefix_and"] = sql(
    """SELECT seq FROM postings GROUP BY seq
       HAVING bool_or(starts_with(term, 'charg')) AND bool_or(starts_with(term, 'post'))""", "postings")
ORACLE["bm25_rank"] = sql(f"SELECT seq, round(rank, 6) AS rank FROM ({o.bm25(['netflix', 'charg'])})", "postings", "stats")


def topk(prefixes, k, more="", over=None):
    return sql(f"""SELECT CAST(pos AS INT) AS pos, uuid, {more} round(rank, 6) AS rank
                   FROM ({o.ranked_pass(1, prefixes, k)}) JOIN entries USING (seq)""", "postings", "stats", "entries", over=over)


ORACLE["fts_search_topk"] = topk(["capit", "charg", "nytim"], 25, "filename,")
ORACLE["fts_search_common_words"] = topk(["sourc", "messag", "direct"], 40)
# places of tokens in the whole entry; a phrase stands in for a term
PLACES = f"""SELECT seq, p, term FROM (
    SELECT seq, lower(unnest(l)) AS raw, unnest(range(len(l))) AS p FROM (
      SELECT seq, regexp_extract_all(filename || {NL} || coalesce(date_iso, '') || {NL} || coalesce(ocr_text, '') || {NL} || coalesce(vlm_text, ''), '{o.RUN}') AS l FROM entries))
    JOIN stems USING (raw)"""


def phrases(pairs, k, over=None):
    """The best k for phrases of two terms, each named after its place."""
    rows = " UNION ALL ".join(f"""SELECT 'phrase{i}' AS term, x.seq, count(*) AS tf, max(doc_len) AS doc_len FROM placed x JOIN placed y ON y.seq = x.seq AND y.p = x.p + 1
        JOIN (SELECT seq, max(doc_len) AS doc_len FROM counted GROUP BY seq) n ON n.seq = x.seq WHERE x.term = '{a}' AND starts_with(y.term, '{b}') GROUP BY x.seq"""
                              for i, (a, b) in enumerate(pairs))
    named = [f"phrase{i}" for i in range(len(pairs))]
    return sql(f"""SELECT CAST(pos AS INT) AS pos, uuid, round(rank, 6) AS rank FROM ({o.ranked_pass(1, named, k).replace("FROM postings", f"FROM ({rows})")})
                   JOIN entries USING (seq)""", "stems", "stats", "entries", over=over, placed=PLACES)


ORACLE["fts_phrases"] = phrases([("rel", "path"), ("sourc", "drop")], 40)
ORACLE["token_places"] = sql("SELECT term, count(*) AS n, CAST(sum(p) AS BIGINT) AS places FROM placed GROUP BY term", "stems", "entries", placed=PLACES)
SUBSTRING = f"""SELECT uuid, filename, date_iso, CAST(0 AS DOUBLE) AS rank FROM entries WHERE {like_any(['with', 'zueinen'])}
        ORDER BY {o.RECENCY} LIMIT 25"""
ORACLE["substring_search"] = sql(SUBSTRING, "entries")
ORACLE["message_ping"] = sql(" UNION ALL ".join(
    f"SELECT {q(t)} AS token, seq, CAST(pos AS INT) AS pos FROM ({o.text_pass(1, MSG + ' AND ' + like_any([t]), 60)})"
    for t in ["the", "hbo", "max", "texts", "user's", "apple.com"]), "entries")
ORACLE["finance_sweep"] = sql(
    f"""SELECT seq, uuid, date_iso, ocr_text, CAST(0 AS DOUBLE) AS rank
        FROM (SELECT * FROM entries WHERE {o.SWEEP} ORDER BY {o.RECENCY} LIMIT 240) WHERE {o.MONEY}""", "entries")
_NEWEST40 = f"ORDER BY {o.RECENCY} LIMIT 40"
_ACUTE = " OR ".join(f"contains(coalesce({c}, ''), 'é')" for c in ("ocr_text", "vlm_text", "filename"))
ORACLE["substring_rare"] = sql(
    f"""SELECT * FROM (SELECT uuid, date_iso FROM entries WHERE {like_any(['ordstrom', 'apple.com'])} {_NEWEST40})
        UNION ALL SELECT * FROM (SELECT uuid, date_iso FROM entries WHERE {_ACUTE} {_NEWEST40})""", "entries")
GRAMS = """SELECT gram, count(*) AS tokens, CAST(sum(df) AS BIGINT) AS entries FROM (
         SELECT DISTINCT raw, term, df, substr(raw, i, 3) AS gram FROM (
           SELECT raw, term, df, unnest(range(1, length(raw) - 1)) AS i FROM (
             SELECT raw, term, count(*) AS df FROM postings WHERE tf_text > 0 GROUP BY raw, term)))
       WHERE regexp_matches(gram, '^[a-z0-9]{3}$') GROUP BY gram"""
ORACLE["vocabulary_grams"] = sql(GRAMS, "postings")
ORACLE["money_text"] = sql(f"SELECT {o.MONEY} AS has_money, {LABEL} AS source, count(*) AS n FROM entries GROUP BY 1, 2", "entries")
ORACLE["bank_source_filter"] = sql(f"SELECT uuid, ocr_text FROM entries WHERE {o.BANK}", "entries")
ORACLE["restrict_finance"] = sql(
    f"""SELECT uuid, is_bank FROM cand WHERE is_bank OR NOT (SELECT bool_or(is_bank) FROM cand)""", "entries",
    cand=f"SELECT uuid, {o.BANK} AS is_bank FROM (SELECT * FROM entries WHERE {o.SWEEP} ORDER BY {o.RECENCY} LIMIT 240) WHERE {o.MONEY}")

# The passes of "Capital One charge NYTimes posted", worked out by hand. Its variants replace NYTimes by nyt,
# new york times, ny times and nytimes.com, and the nyt inside it by nytimes. nytimes.com is no prefix query.
RANKED = {1: ["capit", "on", "charg", "nytim", "post"], 2: ["capit", "on", "charg", "nyt", "post"],
          3: ["capit", "on", "charg", "new", "york", "time", "post"], 4: ["capit", "on", "charg", "time", "post"],
          6: ["capit", "on", "charg", "nytimesim", "post"]}
_W = lambda *x: ["capital", "one", "charge", *x, "posted"]
TEXTS = {5: _W("nytimes.com"), 7: _W("nytimes"), 13: _W("nyt"), 15: _W("new", "york", "times"), 19: _W("times"),
         20: _W("nytimes.com"), 22: _W("nytimesimes")}
PINGS = {8: "capital", 9: "one", 10: "charge", 11: "nytimes", 12: "posted", 14: "nyt", 16: "new", 17: "york", 18: "times",
         21: "nytimes.com", 23: "nytimesimes"}
STOPS = [7, 13, 15, 19, 20, 22]
ORACLE["merge_passes"] = sql(
    f"SELECT CAST(pass_no AS INT) AS pass_no, CAST(pos AS INT) AS pos, seq, round(rank, 6) AS rank FROM ({o.passes(RANKED, TEXTS, PINGS, 24, 60, 240)})",
    "entries", "postings", "stats")
ORACLE["early_stop"] = sql(
    """SELECT seq, CAST(first_ord // 1000000 AS INT) AS first_pass, CAST(first_ord % 1000000 AS INT) AS first_pos,
         round(rank, 6) AS rank FROM merged""", "entries", "postings", "stats",
    hits=o.passes(RANKED, TEXTS, PINGS, 24, 60, 240), **o.merged(STOPS, 90, 24))
CHARGES = dict(ranked=RANKED, texts=TEXTS, pings=PINGS, sweep=24, stops=STOPS, k=15,
               words=["capital", "one", "charge", "nytimes", "posted"], money=True, nyt=True, subscription=False,
               boosted=True, restrict=True)
ORACLE["retrieve_relevant"] = o.retrieve(**CHARGES)
ORACLE["retrieve_recent"] = o.retrieve(**CHARGES, recent=True)
# "how much am I paying for netflix per month?": netflix becomes "net flix"; no word of the other groups occurs.
MONTHLY = dict(
    ranked={1: ["much", "pai", "netflix", "per", "month"], 2: ["much", "pai", "net", "flix", "per", "month"]},
    texts={3: ["much", "paying", "netflix", "per", "month"], 9: ["much", "paying", "net", "flix", "per", "month"]},
    pings={4: "how", 5: "much", 6: "paying", 7: "for", 8: "netflix"}, sweep=14, stops=[3, 9],
    words=["paying", "netflix", "per", "month"], money=True, nyt=False, subscription=False, boosted=True)
MONTHLY["pings"] = {4: "how", 5: "much", 6: "paying", 7: "for", 8: "netflix", 9: "per", 10: "month", 12: "net", 13: "flix"}
MONTHLY["texts"] = {3: MONTHLY["texts"][3], 11: MONTHLY["texts"][9]}
MONTHLY["stops"] = [3, 11]
ORACLE["retrieve_monthly"] = o.retrieve(**MONTHLY, k=40, restrict=True)
ORACLE["retrieve_unrestricted"] = o.retrieve(**MONTHLY, k=15, restrict=False)
ORACLE["retrieve_photos"] = o.retrieve(
    ranked={1: ["small", "gizmo", "photo"]}, texts={2: ["small", "gizmo", "photo"]}, pings={3: "small", 4: "gizmo", 5: "photo"},
    sweep=None, stops=[2], k=15, words=["small", "gizmo", "photo"], money=False, nyt=False, subscription=False,
    boosted=False, restrict=False)
ORACLE["retrieve_cli"] = o.retrieve_cli(
    RANKED, {5: TEXTS[5], 7: TEXTS[7], 8: TEXTS[13], 9: TEXTS[15], 10: TEXTS[19], 11: TEXTS[20], 12: TEXTS[22]},
    [7, 8, 9, 10, 11, 12], 15)

# ===== classifiers ====================================================================
QN = f"(SELECT qid, n, CASE WHEN n = '' THEN 0 ELSE len(string_split(n, ' ')) END AS words FROM (SELECT qid, {normalize('question')} AS n FROM questions))"
SHORT = f"(n <> '' AND words <= 8 AND {any_prefix('n', fixed.FACTUAL_PREFIXES)})"
AGG = f"({any_in('n', fixed.AGGREGATE_FINANCE_TERMS)} AND {any_in('n', fixed.AGGREGATE_TERMS)})"
BROAD = f"(words >= 14 OR {any_in('n', fixed.BROAD_TERMS)})"
ORACLE["classify_question"] = sql(
    f"""SELECT qid, {SHORT} AS short_factual, {AGG} AS aggregate_finance, {BROAD} AS broad,
          {any_in('n', fixed.FINANCE_QUERY_TERMS)} AS finance FROM {QN}""", "questions")
ROUTE = (f"CASE WHEN {AGG} THEN 'aggregate_finance->large' WHEN {SHORT} THEN 'small_first_factual' "
         f"WHEN {BROAD} THEN 'large_first_broad' ELSE 'large_default' END")
ORACLE["route_question"] = sql(
    f"""SELECT qid, {ROUTE} AS route, CASE WHEN {ROUTE} = 'small_first_factual' THEN 'small' ELSE 'large' END AS first_model,
          CASE WHEN {AGG} THEN 'aggregate_finance->large' ELSE 'large_direct' END AS route_direct FROM {QN}""", "questions")
ORACLE["classify_answer"] = sql(
    f"""SELECT aid, t = '' OR {any_in('t', fixed.LOW_CONFIDENCE_MARKERS)} AS low_confidence,
          CASE WHEN t = '' THEN true WHEN {any_in('t', fixed.CITATION_MARKERS)} THEN false
               ELSE {any_in('t', fixed.REFUSAL_MARKERS)} END AS refusal
        FROM (SELECT aid, lower({o.strip("coalesce(answer, '')")}) AS t FROM answers)""", "answers")

# ===== presentation ===================================================================


def excerpt(c: str) -> str:
    t = o.strip(f"replace(coalesce({c}, ''), {NL}, ' ')")
    return f"(substr({t}, 1, 180) || CASE WHEN length({t}) > 180 THEN '...' ELSE '' END)"


ORACLE["rows_preview"] = sql(
    f"""SELECT uuid, filename, coalesce(date_iso, '') AS date_iso, coalesce(image_path_used, '') AS image_path_used,
          printf('%.3f', (0 - seq % 1000) / 8.0::DOUBLE) AS rank, {excerpt('ocr_text')} AS ocr_excerpt, {excerpt('vlm_text')} AS vlm_excerpt
        FROM entries""", "entries")
ORACLE["source_labels"] = sql(f"SELECT uuid, {LABEL} AS source FROM entries", "entries")
SHOWN = """CASE WHEN date_iso IS NULL THEN '' ELSE (
    SELECT lpad(CAST(month(la) AS VARCHAR), 2, '0') || '/' || lpad(CAST(day(la) AS VARCHAR), 2, '0') || '/' || year(la) || ' '
      || CASE WHEN hour(la) % 12 = 0 THEN 12 ELSE hour(la) % 12 END || ':' || lpad(CAST(minute(la) AS VARCHAR), 2, '0')
      || CASE WHEN hour(la) < 12 THEN ' am ' ELSE ' pm ' END
      || CASE WHEN date_diff('hour', la, date_trunc('second', utc)) = 7 THEN 'PDT' ELSE 'PST' END
    FROM (SELECT timezone('America/Los_Angeles', CAST(date_iso AS TIMESTAMPTZ)) AS la,
                 timezone('UTC', CAST(date_iso AS TIMESTAMPTZ)) AS utc)) END"""
DATES = f"SELECT date_iso, {SHOWN} AS shown FROM (SELECT DISTINCT date_iso FROM entries)"
ORACLE["format_local_dt"] = sql(
    "SELECT uuid, e.date_iso, shown FROM entries e JOIN dated d ON e.date_iso IS NOT DISTINCT FROM d.date_iso", "entries", dated=DATES)


def line(place: str) -> str:
    ocr, vlm = excerpt("ocr_text"), excerpt("vlm_text")
    return f"""'**' || {place} || '. ' || CASE WHEN filename = '' THEN uuid ELSE filename END || '**  ' || {NL} || '_' || {LABEL} || ' • '
      || CASE WHEN shown = '' THEN 'n/a' ELSE shown END || '_  ' || {NL}
      || CASE WHEN {ocr} <> '' THEN {ocr} WHEN {vlm} <> '' THEN {vlm} ELSE '(without text)' END || '  ' || {NL}
      || CASE WHEN image_path_used <> '' THEN '[file](file://' || url_encode(image_path_used) || ')'
              WHEN {MSG} THEN 'a chat message' ELSE 'no file' END
      || ' — ref: `' || CASE WHEN image_path_used <> '' THEN image_path_used ELSE uuid END || '`'"""


ORACLE["hit_lines"] = sql(
    f"SELECT uuid, {line('seq')} AS line FROM entries e JOIN dated d ON e.date_iso IS NOT DISTINCT FROM d.date_iso", "entries", dated=DATES)
TOP = o.retrieve(**CHARGES)
ORACLE["hit_summary"] = TOP.replace("SELECT place, uuid", "SELECT place, seq, uuid", 1).replace(
    "WITH ", "WITH top AS (WITH ", 1) + f"""), {'entries'} AS MATERIALIZED (SELECT 1) SELECT 1"""
ORACLE["gallery"] = sql(
    f"""SELECT CAST(place AS INT) AS place, image_path_used AS path,
          CASE WHEN shown = '' THEN 'n/a' ELSE shown END || ' | ' || CASE WHEN filename = '' THEN uuid ELSE filename END AS caption
        FROM (SELECT *, row_number() OVER (ORDER BY {o.RECENCY}) AS place FROM entries WHERE {like_any(['small', 'gizmo', 'photo'])}
              QUALIFY place <= 60) e JOIN dated d ON e.date_iso IS NOT DISTINCT FROM d.date_iso
        WHERE image_path_used LIKE '/photos/%' ORDER BY place LIMIT 16""", "entries", dated=DATES)


def js(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'null' ELSE CAST(to_json({c}) AS VARCHAR) END"


BLOCK = "'{' || " + NL + " || " + f" || ',' || {NL} || ".join(
    f"'  \"{c}\": ' || {js(c)}" for c in ("uuid", "filename", "date_iso", "ocr_text", "vlm_text", "image_path_used")
) + f" || ',' || {NL} || '  \"ingested_at\": ' || CAST(CAST(ingested_at AS BIGINT) AS VARCHAR) || '.0' || {NL} || '}}'"
ORACLE["prompt_blocks"] = sql(f"SELECT uuid, md5({BLOCK}) AS block_md5 FROM entries", "entries")


def over_top(body: str, **extra: str) -> str:
    """A query over the retrieved rows (``top``: place, seq) and the entries."""
    cte, select = TOP.rsplit("\nSELECT place, uuid", 1)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({b})" for n, b in
                       {"top": "SELECT place, seq FROM (SELECT place, seq, uuid" + select.split("FROM (SELECT", 1)[0].split("uuid", 1)[0]
                        + " FROM (SELECT" + select.split("FROM (SELECT", 1)[1] + ")", **extra}.items())
    return cte + ",\n" + parts + "\n" + body


ORACLE["hit_summary"] = over_top(
    f"""SELECT '### Search hits' || {NL} || {NL} || string_agg({line('place')}, {NL} || {NL} ORDER BY place) AS summary
        FROM top JOIN entries e USING (seq) JOIN dated d ON e.date_iso IS NOT DISTINCT FROM d.date_iso""", dated=DATES)
CONTEXT = f"string_agg({BLOCK}, {NL} || {NL} || '---' || {NL} || {NL} ORDER BY place)"
ORACLE["prompt_context"] = over_top(f"SELECT {CONTEXT} AS context FROM top JOIN entries USING (seq)")
from recollect.operators.present import AGGREGATE_RULES, POLICY, STRICT_RULES  # noqa: E402

for _name, _rules in (("prompt_text", STRICT_RULES), ("prompt_text_aggregate", AGGREGATE_RULES)):
    ORACLE[_name] = over_top(f"""SELECT {q(POLICY + _rules)} || {NL} || 'Records:' || {NL} || {CONTEXT} || {NL} || {NL}
          || 'Question: Capital One charge NYTimes posted' || {NL} AS prompt FROM top JOIN entries USING (seq)""")

# ===== cache and maintenance ==========================================================
ORACLE["cache_key"] = sql(
    f"""SELECT qid, md5({normalize('question')} || '|/index|15|large|small|auto=' || CASE WHEN qid % 2 = 0 THEN '1' ELSE '0' END
          || '|sort=Most Relevant|rf=' || CASE WHEN qid % 3 = 0 THEN '1' ELSE '0' END || '|v=1') AS key_md5 FROM questions""", "questions")
CACHED = """SELECT 'k' || aid AS key, CASE WHEN aid % 50 = 0 THEN NULL WHEN aid % 50 = 1 THEN CAST(1700100000 - 86400 AS DOUBLE)
              ELSE CAST(1700100000 - aid % 150000 AS DOUBLE) END AS cached_at_unix FROM answers"""
ORACLE["cache_prune"] = sql(
    f"SELECT key, cached_at_unix FROM ({CACHED}) WHERE 1700100000 - coalesce(cached_at_unix, 0) <= 86400", "answers")
ORACLE["cache_put"] = sql(
    f"""SELECT key, cached_at_unix, 'large_default' AS route FROM ({CACHED}) WHERE 1700100000 - cached_at_unix <= 86400
        UNION ALL SELECT key, CAST(1700100000 AS DOUBLE), 'large_direct' FROM ({CACHED}) WHERE cached_at_unix IS NULL""", "answers")
NOISE = "(" + " OR ".join(
    f"filename = {q(n)} OR " + " OR ".join(f"filename ILIKE {q(p)}" for p in (f"{n}/%", f"%/{n}/%", f"%/{n}"))
    for n in fixed.NOISE_DIR_NAMES) + " OR " + " OR ".join(
    f"filename ILIKE {q(p)}" for s in fixed.NOISE_DIR_SUFFIXES for p in (f"%{s}/%", f"%{s}")) + ")"
ORACLE["prune_find"] = sql(f"SELECT uuid, filename FROM entries WHERE {NOISE}", "entries")
ORACLE["prune_apply"] = sql(f"SELECT seq, uuid, filename FROM entries WHERE NOT {NOISE}", "entries")
ORACLE["prune_postings"] = sql(
    f"""SELECT term, count(*) AS n, CAST(sum(tf) AS BIGINT) AS tf FROM postings
        WHERE seq NOT IN (SELECT seq FROM entries WHERE {NOISE}) GROUP BY term""", "postings", "entries")
PHOTO = "uuid LIKE 'photo-%'"
ORACLE["update_postings"] = sql(
    f"""SELECT term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(tf) AS BIGINT) AS tf FROM (
          SELECT term, 1 AS n, tf FROM postings
          UNION ALL SELECT 'recapt', 1, 1 FROM entries WHERE {PHOTO}) GROUP BY term""", "postings", "entries")
SEC = "(CAST(o_totalprice AS DOUBLE) % 20000)"
ORACLE["fmt_elapsed"] = f"""
  SELECT o_orderkey, CASE WHEN s < 60 THEN CAST(CAST(round_even(s, 0) AS BIGINT) AS VARCHAR) || 's'
      WHEN m < 60 THEN m || 'm ' || CAST(floor(s) AS BIGINT) % 60 || 's' ELSE m // 60 || 'h ' || m % 60 || 'm' END AS shown
  FROM (SELECT o_orderkey, {SEC} AS s, CAST(floor({SEC}) AS BIGINT) // 60 AS m FROM orders)"""
ORACLE["progress_metrics"] = sql(
    """SELECT status, count(*) AS n, round(count(*) / 125.0::DOUBLE, 3) AS per_second, 125.0::DOUBLE AS elapsed_s, '2m 5s' AS elapsed_human
       FROM classified WHERE status <> 'outside' GROUP BY 1""", "classified")

# ===== segments: what a fresh build of the entries that are left gives ==================
AGAIN = o.doc_rows(None, """(SELECT seq + 8000000000000 AS seq, rel_path, name, mtime_ns + 1000000000 AS mtime_ns, size, text FROM doc_files)""")
LEFT = {"entries": f"""
  SELECT * FROM (
    SELECT * FROM ({o.CTES["entries"]}) WHERE uuid NOT IN (SELECT uuid FROM ({AGAIN}) WHERE status = 'new')
    UNION ALL SELECT seq, uuid, filename, date_iso, ocr_text, vlm_text, image_path_used, CAST(1700000000 + seq % 86400 AS DOUBLE) AS ingested_at
    FROM ({AGAIN}) WHERE status = 'new') WHERE NOT {NOISE}"""}
ORACLE["segments_entries"] = sql("SELECT seq, uuid, date_iso, md5(ocr_text) AS ocr_text_md5, ingested_at FROM entries", "entries", over=LEFT)
ORACLE["segments_postings"] = sql("SELECT term, count(*) AS n, CAST(sum(tf) AS BIGINT) AS tf FROM postings GROUP BY term", "postings", over=LEFT)
ORACLE["segments_stats"] = sql("SELECT n_docs, total_len FROM stats", "stats", over=LEFT)
ORACLE["segments_vocabulary"] = sql(VOCAB, "entries", over=LEFT)
ORACLE["segments_grams"] = sql(GRAMS, "postings", over=LEFT)
ORACLE["segments_search"] = topk(["capit", "charg", "nytim"], 25, "filename,", LEFT)
ORACLE["segments_substring_search"] = sql(SUBSTRING, "entries", over=LEFT)
ORACLE["segments_phrases"] = phrases([("rel", "path"), ("sourc", "drop")], 40, LEFT)
