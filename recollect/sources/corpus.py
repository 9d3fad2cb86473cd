"""The given tables seen as a personal corpus: chat rows, file listings, photos, questions.

Each function is one projection over whole tables, so its size follows theirs.
Row keys of the four sources interleave in ``seq`` (four residues), which keeps
it unique without a global numbering.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F




from recollect.sources.tables import table

ROOT = "/corpus"
ROOT_NAME = "corpus"
ISSUERS = ["Capital One", "Chase", "Wells Fargo", "Amex", "Corner Bakery"]
MERCHANTS = ["NYTimes", "Netflix", "Uber Trip", "Apple.com", "Amazon", "Lyft", "HBO Max", "Corner Store"]


def _pick(values, index: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"element_at(array({listed}), cast({index} as int) + 1)"


MERCHANT = _pick(MERCHANTS, f"event_id % {len(MERCHANTS)}")
ISSUER = _pick(ISSUERS, f"user_id % {len(ISSUERS)}")
AMOUNT = "cast(cast(value as decimal(18,2)) as string)"


# --- chat ----------------------------------------------------------------------

def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rowid, guid, text, date_raw, is_from_me, handle_rowid: conversation turns and event alerts."""
    turns = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 1000 + turn AS rowid",
        "CASE turn % 5 WHEN 3 THEN NULL WHEN 4 THEN '' ELSE concat(conv_id, ':', turn) END AS guid",
        "text",
        """CASE WHEN conv_id % 13 = 0 THEN 0L WHEN conv_id % 13 = 1 THEN NULL
                WHEN conv_id % 13 = 2 THEN 700000000 + conv_id * 3600 + turn * 60
                ELSE (700000000 + conv_id * 3600 + turn * 60) * 1000000000 + (turn % 3) * 123456789 END AS date_raw""",
        "CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 0 END AS is_from_me",
        "CASE WHEN conv_id % 11 = 0 THEN -1 - conv_id ELSE conv_id END AS handle_rowid")
    alerts = table(spark, sf_dir, "events").selectExpr(
        "1000000000000 + event_id AS rowid",
        "concat('evt-', event_id) AS guid",
        f"""CASE event_type
              WHEN 'click' THEN NULL
              WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN '   ' ELSE '\\t\\n' END
              WHEN 'view' THEN concat('he was paying $', {AMOUNT}, ' for ', {MERCHANT}, ' I think')
              ELSE concat({ISSUER}, ': a charge of $', {AMOUNT}, ' at ', {MERCHANT}, ' posted') END AS text""",
        # the table's time stamps carry no zone; whole microseconds since 2001
        "(timestampdiff(MICROSECOND, timestamp_ntz'2001-01-01 00:00:00', ts)) * 1000 AS date_raw",
        "CASE WHEN event_type = 'view' THEN cast(event_id % 2 AS int) ELSE 0 END AS is_from_me",
        "CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END AS handle_rowid")
    return turns.unionByName(alerts)


def handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS handle_rowid", "CASE WHEN c_custkey % 9 = 4 THEN '  ' ELSE c_name END AS handle_id")


# --- files ---------------------------------------------------------------------

PART_DIRS = ["docs", "a/node_modules/b", "x/.git/y", ".cache/z", "lib/foo.egg-info", "Vendor", "vendor/k",
             "nodeXmodules", "media", "src/__pycache__", ".hidden", "pkg/bar-1.0.dist-info", "photos/2023"]
PART_EXTS = [".txt", ".MP4", ".mp3", ".jpg", ".pdf", ".tar.gz", "", ".HTML", ".mov", ".heic", ".docx", ".csv",
             ".wav", ".bin", ".md"]
PAGE_DIRS = ["web", "proj/node_modules/pkg", "env/lib/site-packages", "Vendor", "site", "nodeXmodules",
             "old.egg-info", "web/archive", "src/vendor", "notes"]


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document row: rel_path, name, mtime_ns, size, text."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id * 4 + 1 AS seq",
        "concat(lang, '/', source, '/doc_', doc_id, '.txt') AS rel_path",
        "concat('doc_', doc_id, '.txt') AS name",
        "CASE WHEN doc_id % 50 = 7 THEN 0L ELSE (1500000000 + doc_id * 61) * 1000000000 + (doc_id % 4) * 250000000 END AS mtime_ns",
        "n_chars AS size", "text")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One HTML file per web page; some lie in vendored directories."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id * 4 + 2 AS seq",
        f"concat({_pick(PAGE_DIRS, 'page_id % 10')}, '/page_', page_id, '.html') AS rel_path",
        "concat('page_', page_id, '.html') AS name",
        "(1600000000 + page_id * 7) * 1000000000 AS mtime_ns",
        "cast(length(html) AS bigint) AS size", "html AS text")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file walk without content: documents, pages and a tree of part files of every class."""
    parts = table(spark, sf_dir, "part").selectExpr(
        f"""concat({_pick(PART_DIRS, 'p_partkey % 13')}, '/',
             CASE p_partkey % 17 WHEN 5 THEN '~$' WHEN 9 THEN '._' ELSE '' END,
             replace(p_name, ' ', '_'), '_', p_partkey, {_pick(PART_EXTS, 'p_partkey % 15')}) AS rel_path""",
        "p_partkey % 31 = 0 AS outside_root",
        "(1550000000 + p_partkey) * 1000000000 AS mtime_ns", "cast(p_size AS bigint) AS size")
    inside = [f(spark, sf_dir).select("rel_path", F.lit(False).alias("outside_root"), "mtime_ns", "size")
              for f in (document_files, page_files)]
    return (reduce(DataFrame.unionByName, inside, parts)
            .withColumn("name", F.substring_index("rel_path", "/", -1)))


# --- photos --------------------------------------------------------------------

def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey * 4 + 3 AS seq",
        "concat('photo-', p_partkey) AS uuid",
        "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE concat(replace(p_name, ' ', '_'), '_', p_partkey, '.jpg') END AS filename",
        "CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE concat(cast(date_add(date'2019-01-01', cast(p_partkey % 2000 AS int)) AS string), "
        "'T', lpad(cast(p_partkey % 24 AS string), 2, '0'), ':30:00-08:00') END AS date_iso",
        "p_size % 10 = 0 AS is_movie",
        "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('/photos/originals/', p_partkey, '.heic') END AS path",
        "p_partkey % 3 <> 0 AS path_exists",
        """CASE p_partkey % 5 WHEN 0 THEN array() WHEN 1 THEN NULL ELSE array(
             named_struct('path', concat('/photos/derivatives/', p_partkey, '_a.jpg'), 'exists', p_partkey % 5 <> 2),
             named_struct('path', concat('/photos/derivatives/', p_partkey, '_b.jpg'), 'exists', true)) END AS path_derivatives""",
        """array(named_struct('text', p_brand, 'confidence', 0.9D), named_struct('text', '', 'confidence', 0.1D),
             named_struct('text', p_type, 'confidence', 0.8D), named_struct('text', cast(NULL AS string), 'confidence', 0.2D),
             named_struct('text', p_name, 'confidence', 0.5D)) AS detected_text""",
        "CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE concat('  A photo of a ', p_name, ' labelled ', p_brand, '.\\n') END AS caption")


# --- questions and answers -------------------------------------------------------

QUESTION_FORMS = [
    "concat('How much did ', {m}, ' charge me for order ', event_id, '?')",
    "concat('what''s the latest ', {m}, ' bill')",
    "concat('total  ', {m}, '   subscription fees per month for user ', user_id)",
    "concat('NOT a ', {m}, ' receipt')",
    "concat('show my ', event_type, ' texts')",
    "concat('why is ', event_type, '_count so high, explain the trends across ', {m}, ' and all other places I went this year')",
    "concat('  the and of  ')",
    "concat('NYT price ', {a})",
    "concat('is ', {m}, ' ok')",
    "concat('Find MAX text of user.', user_id)",
    "concat('how many payments across ', {m}, ' and google pay')",
    "'   '",
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, question: every user turn in full, and one question about each event."""
    forms = " ".join(f"WHEN {i} THEN " + q.format(m=MERCHANT, a=AMOUNT) for i, q in enumerate(QUESTION_FORMS))
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").selectExpr(
        "conv_id * 1000 + turn AS qid", "text AS question")
    about = table(spark, sf_dir, "events").selectExpr(
        "1000000000000 + event_id AS qid", f"CASE event_id % {len(QUESTION_FORMS)} {forms} END AS question")
    return asked.unionByName(about)


ANSWER_FORMS = [
    "concat('Your ', {m}, ' charge was $', {a}, '.')",
    "'I''m not sure about that.'",
    "'As an AI language model I cannot provide that.'",
    "'I do not see it in your indexed data yet.'",
    "''",
    "concat('  Unknown merchant near ', {m}, '. ')",
    "concat('Contact your doctor about imsg:evt-', event_id)",
    "concat('You should talk to your doctor about ', {m})",
]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """aid, answer: every assistant turn in full, and one answer about each event."""
    forms = " ".join(f"WHEN {i} THEN " + q.format(m=MERCHANT, a=AMOUNT) for i, q in enumerate(ANSWER_FORMS))
    given = table(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr(
        "conv_id * 1000 + turn AS aid", "text AS answer")
    about = table(spark, sf_dir, "events").selectExpr(
        "1000000000000 + event_id AS aid", f"CASE event_id % {len(ANSWER_FORMS)} {forms} END AS answer")
    return given.unionByName(about)


# --- the stored entry table --------------------------------------------------------

def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index holds after ingesting all four sources. ``ingested_at`` follows ``seq``, never the clock."""
    from recollect.operators import ingest
    chat = ingest.message_rows(chat_messages(spark, sf_dir), handles(spark, sf_dir)).where("status = 'new'")
    docs = [ingest.document_rows(
                ingest.plain_text(f(spark, sf_dir)), ROOT, ROOT_NAME).where("status = 'new'")
            for f in (document_files, page_files)]
    pics = ingest.photo_rows(photos(spark, sf_dir)).where("status = 'new'")
    parts = [chat.withColumn("seq", F.col("rowid") * 4), *docs, pics]
    return reduce(DataFrame.unionByName, [p.select(
        "seq", "uuid", "filename", "date_iso", "ocr_text", "vlm_text", "image_path_used",
        ingested_at(F.col("seq")).alias("ingested_at")) for p in parts])


def ingested_at(seq):
    """A fixed clock: unix seconds as a function of the row key."""
    return (F.lit(1_700_000_000) + seq % 86_400).cast("double")
