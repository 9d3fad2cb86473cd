"""The same results as plain SQL, for checking. Written for DuckDB over the given tables."""

from recollect import fixed
from recollect.functions.text import WS_CHARS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def inlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def any_in(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")"


def any_prefix(text: str, terms) -> str:
    return "(" + " OR ".join(f"starts_with({text}, {q(t)})" for t in terms) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {q(WS_CHARS)})"


WS_CLASS = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
CURRENCY = "\\$" + WS_CLASS + "?\\p{Nd}|\\p{Nd}\\.\\p{Nd}{2}"


def normalize(x: str) -> str:
    return strip(f"regexp_replace(lower(coalesce({x}, '')), {q(WS_CLASS + '+')}, ' ', 'g')")


def iso(us: str) -> str:
    return (f"(strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {us} % 1000000 = 0 THEN '' "
            f"ELSE '.' || lpad(CAST({us} % 1000000 AS VARCHAR), 6, '0') END || '+00:00')")


MERCHANT = ("['NYTimes','Netflix','Uber Trip','Apple.com','Amazon','Lyft','HBO Max','Corner Store']"
            "[CAST(event_id % 8 AS INT) + 1]")
ISSUER = "['Capital One','Chase','Wells Fargo','Amex','Corner Bakery'][CAST(user_id % 5 AS INT) + 1]"
AMOUNT = "CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)"

CTES: dict[str, str] = {}

CTES["message"] = f"""
  SELECT conv_id * 1000 + turn AS rowid,
         CASE turn % 5 WHEN 3 THEN NULL WHEN 4 THEN '' ELSE conv_id || ':' || turn END AS guid, text,
         CASE WHEN conv_id % 13 = 0 THEN 0 WHEN conv_id % 13 = 1 THEN NULL
              WHEN conv_id % 13 = 2 THEN 700000000 + conv_id * 3600 + turn * 60
              ELSE (700000000 + conv_id * 3600 + turn * 60) * 1000000000 + (turn % 3) * 123456789 END AS date_raw,
         CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 0 END AS is_from_me,
         CASE WHEN conv_id % 11 = 0 THEN -1 - conv_id ELSE conv_id END AS handle_rowid
  FROM conversations
  UNION ALL
  SELECT 1000000000000 + event_id, 'evt-' || event_id,
         CASE event_type WHEN 'click' THEN NULL
           WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN '   ' ELSE chr(9) || chr(10) END
           WHEN 'view' THEN 'he was paying $' || {AMOUNT} || ' for ' || {MERCHANT} || ' I think'
           ELSE {ISSUER} || ': a charge of $' || {AMOUNT} || ' at ' || {MERCHANT} || ' posted' END,
         (epoch_us(ts) - 978307200000000) * 1000,
         CASE WHEN event_type = 'view' THEN event_id % 2 ELSE 0 END,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END
  FROM events"""

CTES["msg0"] = f"""
  SELECT m.*, CASE WHEN c_custkey % 9 = 4 THEN '  ' ELSE c_name END AS handle_id, CAST(date_raw AS DOUBLE) AS v
  FROM message m LEFT JOIN customer ON c_custkey = handle_rowid
  WHERE text IS NOT NULL AND trim(text, ' ') <> ''"""

CTES["msg1"] = f"""
  SELECT *, {strip('text')} AS body, coalesce(nullif({strip('handle_id')}, ''), 'unknown') AS handle,
         CAST(round(CASE WHEN abs(v) > 1000000000000 THEN v / CAST(1000000000 AS DOUBLE) ELSE v END
              * CAST(1000000 AS DOUBLE)) AS BIGINT) + 978307200000000 AS us
  FROM msg0"""

CTES["msg_rows"] = f"""
  SELECT rowid, 'imsg:' || coalesce(nullif(guid, ''), 'rowid:' || rowid) AS uuid, 'message:' || handle AS filename,
         CASE WHEN v <> 0 THEN {iso('us')} END AS date_iso, body AS ocr_text,
         'source=messages direction=' || CASE WHEN is_from_me = 1 THEN 'from_me' ELSE 'from_them' END
           || ' handle=' || handle AS vlm_text,
         '' AS image_path_used, CASE WHEN body = '' THEN 'empty' ELSE 'new' END AS status
  FROM msg1"""

CTES["doc_files"] = """
  SELECT doc_id * 4 + 1 AS seq, lang || '/' || source || '/doc_' || doc_id || '.txt' AS rel_path,
         'doc_' || doc_id || '.txt' AS name,
         CASE WHEN doc_id % 50 = 7 THEN 0 ELSE (1500000000 + doc_id * 61) * 1000000000 + (doc_id % 4) * 250000000 END AS mtime_ns,
         n_chars AS size, text FROM documents"""

CTES["page_files"] = """
  SELECT page_id * 4 + 2 AS seq,
         ['web','proj/node_modules/pkg','env/lib/site-packages','Vendor','site','nodeXmodules','old.egg-info','web/archive',
          'src/vendor','notes'][CAST(page_id % 10 AS INT) + 1] || '/page_' || page_id || '.html' AS rel_path,
         'page_' || page_id || '.html' AS name, (1600000000 + page_id * 7) * 1000000000 AS mtime_ns,
         length(html) AS size, html AS text FROM pages"""

CTES["files"] = "SELECT * FROM doc_files UNION ALL SELECT * FROM page_files"


def doc_rows(max_chars: int | None, source: str = "files") -> str:
    t = strip("coalesce(text, '')")
    text = t if max_chars is None else f"""CASE WHEN length({t}) <= {max_chars} THEN {t}
              ELSE substr({t}, 1, {max_chars - 80}) || chr(10) || chr(10) || '… [truncated for index size]' || chr(10) END"""
    return f"""
  SELECT seq, 'doc:' || substr(sha256('/corpus/' || rel_path), 1, 24) AS uuid, rel_path AS filename,
         CASE WHEN mtime_ns > 0 THEN {iso('(mtime_ns // 1000)')} END AS date_iso,
         {text} AS ocr_text,
         '[docmeta] mtime_ns=' || mtime_ns || ' size=' || size || chr(10) || 'source=dropbox_documents root=corpus'
           || chr(10) || 'rel_path=' || rel_path || chr(10) || 'extractor=plaintext' AS vlm_text,
         '/corpus/' || rel_path AS image_path_used,
         CASE WHEN {t} <> '' THEN 'new' ELSE 'empty' END AS status
  FROM {source}"""


CTES["document_rows"] = doc_rows(None)

CTES["photo"] = """
  SELECT p_partkey * 4 + 3 AS seq, 'photo-' || p_partkey AS uuid,
         CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE replace(p_name, ' ', '_') || '_' || p_partkey || '.jpg' END AS filename,
         CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE CAST(DATE '2019-01-01' + CAST(p_partkey % 2000 AS INT) AS VARCHAR)
           || 'T' || lpad(CAST(p_partkey % 24 AS VARCHAR), 2, '0') || ':30:00-08:00' END AS date_iso,
         p_size % 10 = 0 AS is_movie,
         CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 THEN '/photos/originals/' || p_partkey || '.heic' END AS original,
         CASE WHEN p_partkey % 5 IN (0, 1) THEN NULL WHEN p_partkey % 5 = 2 THEN '/photos/derivatives/' || p_partkey || '_b.jpg'
              ELSE '/photos/derivatives/' || p_partkey || '_a.jpg' END AS preview,
         concat_ws(' ', nullif(p_brand, ''), nullif(p_type, ''), nullif(p_name, '')) AS ocr_text,
         CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE 'A photo of a ' || p_name || ' labelled ' || p_brand || '.' END AS caption
  FROM part"""

CTES["photo_rows"] = """
  SELECT seq, uuid, coalesce(filename, '') AS filename, date_iso, ocr_text, coalesce(caption, '') AS vlm_text,
         coalesce(preview, original) AS image_path_used, caption IS NULL AS caption_error,
         CASE WHEN coalesce(preview, original) IS NULL THEN 'no_path' ELSE 'new' END AS status
  FROM photo WHERE NOT is_movie"""

CTES["entries"] = """
  SELECT *, CAST(1700000000 + seq % 86400 AS DOUBLE) AS ingested_at FROM (
    SELECT rowid * 4 AS seq, uuid, filename, date_iso, ocr_text, vlm_text, image_path_used FROM msg_rows WHERE status = 'new'
    UNION ALL
    SELECT seq, uuid, filename, date_iso, ocr_text, vlm_text, image_path_used FROM document_rows WHERE status = 'new'
    UNION ALL
    SELECT seq, uuid, filename, date_iso, ocr_text, vlm_text, image_path_used FROM photo_rows WHERE status = 'new')"""

CTES["listing"] = """
  SELECT rel_path, outside_root, mtime_ns, size, regexp_extract(rel_path, '[^/]*$') AS name FROM (
    SELECT ['docs','a/node_modules/b','x/.git/y','.cache/z','lib/foo.egg-info','Vendor','vendor/k','nodeXmodules','media',
            'src/__pycache__','.hidden','pkg/bar-1.0.dist-info','photos/2023'][CAST(p_partkey % 13 AS INT) + 1] || '/'
           || CASE p_partkey % 17 WHEN 5 THEN '~$' WHEN 9 THEN '._' ELSE '' END || replace(p_name, ' ', '_') || '_' || p_partkey
           || ['.txt','.MP4','.mp3','.jpg','.pdf','.tar.gz','','.HTML','.mov','.heic','.docx','.csv','.wav','.bin','.md']
              [CAST(p_partkey % 15 AS INT) + 1] AS rel_path,
           p_partkey % 31 = 0 AS outside_root, (1550000000 + p_partkey) * 1000000000 AS mtime_ns, CAST(p_size AS BIGINT) AS size
    FROM part
    UNION ALL SELECT rel_path, false, mtime_ns, size FROM files)"""

CTES["classified"] = f"""
  SELECT *, CASE
      WHEN starts_with(name, '~$') OR starts_with(name, '._') THEN 'temp'
      WHEN ext IN {inlist(fixed.VIDEO_EXT)} THEN 'video'
      WHEN ext IN {inlist(fixed.AUDIO_EXT)} OR ext IN {inlist(fixed.RASTER_EXT)} THEN 'media'
      WHEN outside_root THEN 'outside'
      WHEN rel_path LIKE '.%' OR rel_path LIKE '%/.%' THEN 'hidden'
      WHEN len(list_intersect(string_split(rel_path, '/'), {lst(fixed.NOISE_DIR_NAMES)})) > 0
        OR len(list_filter(string_split(rel_path, '/'), lambda s: ends_with(s, '.egg-info') OR ends_with(s, '.dist-info'))) > 0
        THEN 'noise'
      ELSE 'candidate' END AS status
  FROM (SELECT *, lower(CASE WHEN regexp_matches(name, '[^.].*\\.[^.]+$') THEN regexp_extract(name, '(\\.[^.]+)$', 1) ELSE '' END) AS ext
        FROM listing)"""

FORMS = [
    "'How much did ' || {m} || ' charge me for order ' || event_id || '?'",
    "'what''s the latest ' || {m} || ' bill'",
    "'total  ' || {m} || '   subscription fees per month for user ' || user_id",
    "'NOT a ' || {m} || ' receipt'",
    "'show my ' || event_type || ' texts'",
    "'why is ' || event_type || '_count so high, explain the trends across ' || {m} || ' and all other places I went this year'",
    "'  the and of  '",
    "'NYT price ' || {a}",
    "'is ' || {m} || ' ok'",
    "'Find MAX text of user.' || user_id",
    "'how many payments across ' || {m} || ' and google pay'",
    "'   '",
]
CTES["questions"] = (
    "SELECT conv_id * 1000 + turn AS qid, text AS question FROM conversations WHERE role = 'user' UNION ALL "
    "SELECT 1000000000000 + event_id, CASE event_id % 12 "
    + " ".join(f"WHEN {i} THEN " + f.format(m=MERCHANT, a=AMOUNT) for i, f in enumerate(FORMS)) + " END FROM events")

ANSWER_FORMS = [
    "'Your ' || {m} || ' charge was $' || {a} || '.'", "'I''m not sure about that.'",
    "'As an AI language model I cannot provide that.'", "'I do not see it in your indexed data yet.'", "''",
    "'  Unknown merchant near ' || {m} || '. '", "'Contact your doctor about imsg:evt-' || event_id",
    "'You should talk to your doctor about ' || {m}",
]
CTES["answers"] = (
    "SELECT conv_id * 1000 + turn AS aid, text AS answer FROM conversations WHERE role = 'assistant' UNION ALL "
    "SELECT 1000000000000 + event_id, CASE event_id % 8 "
    + " ".join(f"WHEN {i} THEN " + f.format(m=MERCHANT, a=AMOUNT) for i, f in enumerate(ANSWER_FORMS)) + " END FROM events")

CTES["qtokens"] = f"""
  SELECT qid, question, list_filter(list_transform(regexp_extract_all(coalesce(question, ''), '[\\p{{L}}\\p{{N}}_''.-]+'),
           lambda w: replace(w, '''', '')), lambda w: length(w) >= 3 AND lower(w) NOT IN {inlist(fixed.STOPWORDS)}) AS toks
  FROM questions"""

# --- index -------------------------------------------------------------------------
RUN = "[\\p{L}\\p{N}]+"
CTES["tokens"] = f"""
  SELECT seq, raw, in_text, doc_len FROM (
    SELECT seq, len(a) + len(b) AS doc_len, a, b FROM (
      SELECT seq, regexp_extract_all(concat_ws(chr(10), filename, coalesce(ocr_text, ''), coalesce(vlm_text, '')), '{RUN}') AS a,
             regexp_extract_all(coalesce(date_iso, ''), '{RUN}') AS b FROM entries)),
    LATERAL (SELECT lower(unnest(a)) AS raw, 1 AS in_text UNION ALL SELECT lower(unnest(b)), 0)"""
CTES["counted"] = """
  SELECT seq, raw, CAST(count(*) AS BIGINT) AS tf, CAST(sum(in_text) AS BIGINT) AS tf_text, CAST(max(doc_len) AS BIGINT) AS doc_len
  FROM tokens GROUP BY seq, raw"""

_V, _C = "[aeiouy][aeiou]*", "[^aeiou][^aeiouy]*"
_F = f"^(?:{_C}{_V}|[aeiou]+)"
M0, M1, M2 = f"{_F}{_C}", f"{_F}{_C}(?:{_V})?$", f"{_F}{_C}{_V}{_C}"
VOWEL = "^(?:[aeiou]|.+[aeiouy])"
CVC = "(?:^[^aeiou]|[aeiou]y|[^aeiouy])[aeiouy][^aeiouwxy]$"


def m(x, p):
    return f"regexp_matches({x}, '{p}')"


def cut(x, n):
    return f"left({x}, length({x}) - {n})"


def repair(x):
    return (f"CASE WHEN {m(x, '.(?:at|bl|iz)$')} THEN {x} || 'e' "
            f"WHEN length({x}) > 1 AND right({x}, 1) = left(right({x}, 2), 1) AND right({x}, 1) NOT IN ('a','e','i','o','u','l','s','z') THEN {cut(x, 1)} "
            f"WHEN {m(x, M1)} AND {m(x, CVC)} THEN {x} || 'e' ELSE {x} END")


def table_step(pairs):
    pat = "^(.+?)(" + "|".join(a for a, _ in pairs) + ")$"
    stem, suf = f"regexp_extract(w, '{pat}', 1)", f"regexp_extract(w, '{pat}', 2)"
    new = "CASE " + suf + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs) + " END"
    return f"CASE WHEN {stem} <> '' AND {m(stem, M0)} THEN {stem} || {new} ELSE w END"


_S2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"),
       ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
       ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
       ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_S3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_S4 = "^(.+?)(al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ou|ism|ate|iti|ous|ive|ize)$"
_STEM4 = f"regexp_extract(w, '{_S4}', 1)"
_STEPS = [
    f"CASE WHEN NOT ends_with(w, 's') THEN w WHEN {m('w', '.sses$|.ies$')} THEN {cut('w', 2)} WHEN ends_with(w, 'ss') THEN w ELSE {cut('w', 1)} END",
    f"CASE WHEN {m('w', '.eed$')} THEN CASE WHEN {m(cut('w', 3), M0)} THEN {cut('w', 1)} ELSE w END "
    f"WHEN {m('w', '.ed$')} THEN CASE WHEN {m(cut('w', 2), VOWEL)} THEN {repair(cut('w', 2))} ELSE w END "
    f"WHEN {m('w', '.ing$')} THEN CASE WHEN {m(cut('w', 3), VOWEL)} THEN {repair(cut('w', 3))} ELSE w END ELSE w END",
    f"CASE WHEN ends_with(w, 'y') AND {m(cut('w', 1), VOWEL)} THEN {cut('w', 1)} || 'i' ELSE w END",
    table_step(_S2), table_step(_S3),
    f"CASE WHEN {_STEM4} <> '' THEN CASE WHEN {m(_STEM4, M2)} THEN {_STEM4} ELSE w END "
    f"WHEN {m('w', '[st]ion$')} AND {m(cut('w', 3), M2)} THEN {cut('w', 3)} ELSE w END",
    f"CASE WHEN ends_with(w, 'e') AND ({m(cut('w', 1), M2)} OR ({m(cut('w', 1), M1)} AND NOT {m(cut('w', 1), CVC)})) THEN {cut('w', 1)} ELSE w END",
    f"CASE WHEN ends_with(w, 'll') AND {m(cut('w', 1), M2)} THEN {cut('w', 1)} ELSE w END",
]
_FOLDED = "translate(raw, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
CTES["st0"] = (f"SELECT raw, regexp_replace({_FOLDED}, '([^\\x00-\\x7f])', '\\1' || chr(1), 'g') AS w "
               "FROM (SELECT DISTINCT raw FROM counted)")
for _i, _s in enumerate(_STEPS):
    CTES[f"st{_i + 1}"] = f"SELECT raw, CASE WHEN length(w) >= 3 AND length(w) <= 64 THEN {_s} ELSE w END AS w FROM st{_i}"
CTES["stems"] = f"SELECT raw, replace(w, chr(1), '') AS term FROM st{len(_STEPS)}"
CTES["postings"] = "SELECT term, counted.* FROM counted JOIN stems USING (raw)"
CTES["stats"] = """
  SELECT (SELECT count(*) FROM entries) AS n_docs, CAST((SELECT sum(tf) FROM counted) AS BIGINT) AS total_len"""

NEEDS = {
    "msg0": ["message"], "msg1": ["msg0"], "msg_rows": ["msg1"], "files": ["doc_files", "page_files"],
    "document_rows": ["files"], "photo_rows": ["photo"], "entries": ["msg_rows", "document_rows", "photo_rows"],
    "listing": ["files"], "classified": ["listing"], "qtokens": ["questions"], "tokens": ["entries"],
    "counted": ["tokens"], "st0": ["counted"], **{f"st{i + 1}": [f"st{i}"] for i in range(len(_STEPS))},
    "stems": [f"st{len(_STEPS)}"], "postings": ["stems"], "stats": ["entries", "counted"],
}


def sql(body: str, *needs: str, over: dict | None = None, **extra: str) -> str:
    """``body`` with the named parts it stands on; ``over`` puts other bodies in place of some."""
    order: list[str] = []

    def add(n):
        for d in NEEDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)
    for n in needs:
        add(n)
    bodies = CTES | (over or {})
    parts = [f"{n} AS MATERIALIZED ({bodies[n]})" for n in order] + [f"{n} AS MATERIALIZED ({b})" for n, b in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


# --- ranking -----------------------------------------------------------------------
RECENCY = "date_iso DESC NULLS LAST, ingested_at DESC, seq ASC"


def bm25(prefixes: list[str]) -> str:
    """seq, rank of entries that hold every prefix."""
    n = len(prefixes)
    tfs = ", ".join(f"CAST(sum(CASE WHEN starts_with(term, {q(p)}) THEN tf ELSE 0 END) AS DOUBLE) AS t{i}" for i, p in enumerate(prefixes))
    where = " OR ".join(f"starts_with(term, {q(p)})" for p in prefixes)
    dfs = ", ".join(f"CAST(count(*) FILTER (WHERE t{i} > 0) AS DOUBLE) AS n{i}" for i in range(n))
    idf = lambda i: (f"(CASE WHEN ln((nd - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) <= 0 THEN 1e-6 "  # noqa: E731
                     f"ELSE ln((nd - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) END)")
    norm = "(1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avgdl))"
    total = " + ".join(["0.0::DOUBLE"] + [f"{idf(i)} * (t{i} * 2.2::DOUBLE / (t{i} + {norm}))" for i in range(n)])
    return f"""
      SELECT seq, -({total}) AS rank
      FROM (SELECT seq, max(doc_len) AS doc_len, {tfs} FROM postings WHERE {where} GROUP BY seq) c,
           (SELECT {dfs} FROM (SELECT seq, {tfs} FROM postings WHERE {where} GROUP BY seq)) d,
           (SELECT CAST(n_docs AS DOUBLE) AS nd, CAST(total_len AS DOUBLE) / n_docs AS avgdl FROM stats) s
      WHERE {" AND ".join(f"t{i} > 0" for i in range(n))}"""


def like_any(terms) -> str:
    return "(" + " OR ".join(
        f"contains(lower(coalesce({c}, '')), {q(t)})" for t in terms for c in ("ocr_text", "vlm_text", "filename")) + ")"


SWEEP = "(starts_with(uuid, 'imsg:') AND (" + " OR ".join(
    f"ocr_text ILIKE {q('%' + t + '%')}" for t in fixed.SWEEP_TEXT_TERMS) + "))"
MONEY = f"regexp_matches(coalesce(ocr_text, '') || ' ' || coalesce(vlm_text, ''), {q(CURRENCY)})"
TEXT = "lower(concat_ws(' ', coalesce(filename, ''), coalesce(ocr_text, ''), coalesce(vlm_text, '')))"
BANK = (f"(regexp_matches({TEXT}, {q(CURRENCY)}) AND {any_in(TEXT, fixed.BANK_ISSUERS)} "
        f"AND {any_in(TEXT, fixed.TRANSACTION_WORDS)})")


def ranked_pass(no: int, prefixes, limit: int) -> str:
    return (f"SELECT {no} AS pass_no, seq, rank, row_number() OVER (ORDER BY rank, seq) AS pos FROM ({bm25(prefixes)}) "
            f"QUALIFY pos <= {limit}")


def text_pass(no: int, where: str, limit: int, keep: str = "true") -> str:
    return (f"SELECT {no} AS pass_no, seq, CAST(0 AS DOUBLE) AS rank, pos FROM (SELECT *, row_number() OVER (ORDER BY {RECENCY}) AS pos "
            f"FROM entries WHERE {where} QUALIFY pos <= {limit}) WHERE {keep}")


def passes(ranked: dict, texts: dict, pings: dict, sweep, limit: int, sweep_limit: int = 0) -> str:
    parts = [ranked_pass(n, p, limit) for n, p in ranked.items()]
    parts += [text_pass(n, like_any(t), limit) for n, t in texts.items()]
    parts += [text_pass(n, f"starts_with(uuid, 'imsg:') AND {like_any([t])}", limit) for n, t in pings.items()]
    if sweep:
        parts.append(text_pass(sweep, SWEEP, sweep_limit, MONEY))
    return "\nUNION ALL\n".join(parts)


def merged(stops, enough: int, sweep) -> dict:
    s = sweep or -1
    return {
        "first_pass": f"SELECT seq, min(pass_no) AS fp FROM hits WHERE pass_no <> {s} GROUP BY seq",
        "stop": f"SELECT coalesce(min(s), 999999) AS s FROM (SELECT unnest([{', '.join(map(str, stops))}]) AS s) "
                f"WHERE (SELECT count(*) FROM first_pass WHERE fp <= s) >= {enough}",
        "merged": f"SELECT seq, min(pass_no * 1000000 + pos) AS first_ord, arg_max(rank, pass_no) AS rank "
                  f"FROM hits WHERE pass_no <= (SELECT s FROM stop) OR pass_no = {s} GROUP BY seq",
    }


def retrieve(ranked, texts, pings, sweep, stops, k, words, money, nyt, subscription, boosted, restrict, recent=False) -> str:
    limit, enough = max(4 * k, 40), max(6 * k, 80)
    cur = f"(regexp_matches(t, {q(CURRENCY)}) OR {any_in('t', fixed.TEXT_CURRENCY_TERMS)})"
    has_nyt = any_in("t", fixed.TEXT_NYT_TERMS)
    pts = [f"CASE WHEN contains(t, {q(w)}) THEN 1 ELSE 0 END" for w in words]
    if nyt:
        pts.append(f"CASE WHEN {has_nyt} THEN 6 ELSE 0 END")
    if subscription:
        pts.append("CASE WHEN contains(t, 'subscription') THEN 2 ELSE 0 END")
    if money:
        pts.append(f"CASE WHEN {cur} THEN 3 ELSE 0 END")
        pts.append(f"CASE WHEN is_msg AND {cur} AND {has_nyt if nyt else 'true'} THEN 8 ELSE 0 END")
        pts.append("CASE WHEN is_msg AND is_bank THEN 12 ELSE 0 END")
    order = ("coalesce(date_iso, '') DESC, ingested_at DESC, first_ord" if recent
             else "msg_pref DESC, score DESC, rank ASC, coalesce(date_iso, '') DESC, first_ord")
    keep = "is_bank OR NOT (SELECT bool_or(is_bank) FROM scored)" if restrict else "true"
    return sql(
        f"""SELECT place, uuid, filename, date_iso, md5(ocr_text) AS text_md5, round(rank, 6) AS rank,
                   CAST(score AS INT) AS score, CAST(msg_pref AS INT) AS msg_pref
            FROM (SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS INT) AS place FROM scored WHERE {keep}) WHERE place <= {k}""",
        "entries", "postings", "stats",
        hits=passes(ranked, texts, pings, sweep, limit, max(4 * limit, 200)), **merged(stops, enough, sweep),
        wide=f"SELECT m.first_ord, m.rank, e.*, {TEXT} AS t, starts_with(uuid, 'imsg:') AS is_msg, {BANK} AS is_bank "
             "FROM merged m JOIN entries e USING (seq)",
        scored=f"SELECT *, {' + '.join(pts) if pts else '0'} AS score, CASE WHEN is_msg AND {str(boosted).lower()} THEN 1 ELSE 0 END AS msg_pref FROM wide")


def retrieve_cli(ranked, texts, stops, k) -> str:
    return sql(
        f"""SELECT place, uuid, filename, date_iso, md5(ocr_text) AS text_md5, round(rank, 6) AS rank FROM (
              SELECT *, CAST(row_number() OVER (ORDER BY first_ord) AS INT) AS place FROM merged JOIN entries USING (seq)) WHERE place <= {k}""",
        "entries", "postings", "stats", hits=passes(ranked, texts, {}, None, k), **merged(stops, 2 * k, None))
