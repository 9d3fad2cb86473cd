"""Schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T

ENTRIES = T.StructType([
    T.StructField("seq", T.LongType(), False),            # insertion order, the tie-break of every sort
    T.StructField("uuid", T.StringType(), False),
    T.StructField("filename", T.StringType(), False),
    T.StructField("date_iso", T.StringType()),            # ISO text, ordered as text
    T.StructField("ocr_text", T.StringType()),
    T.StructField("vlm_text", T.StringType()),
    T.StructField("image_path_used", T.StringType()),
    T.StructField("ingested_at", T.DoubleType(), False),
])
ENTRY_COLS = ENTRIES.fieldNames()

POSTINGS = T.StructType([
    T.StructField("term", T.StringType(), False),         # folded and stemmed
    T.StructField("raw", T.StringType(), False),          # the run of letters as it stands, ASCII lower case
    T.StructField("seq", T.LongType(), False),
    T.StructField("tf", T.LongType(), False),
    T.StructField("tf_text", T.LongType(), False),        # occurrences outside date_iso
    T.StructField("doc_len", T.LongType(), False),
])

CORPUS_STATS = T.StructType([
    T.StructField("n_docs", T.LongType(), False),
    T.StructField("total_len", T.LongType(), False),
])

PHOTOS = T.StructType([
    T.StructField("uuid", T.StringType(), False),
    T.StructField("filename", T.StringType()),
    T.StructField("date_iso", T.StringType()),
    T.StructField("is_movie", T.BooleanType()),
    T.StructField("path", T.StringType()),
    T.StructField("path_exists", T.BooleanType()),
    T.StructField("path_derivatives", T.ArrayType(T.StructType([
        T.StructField("path", T.StringType()), T.StructField("exists", T.BooleanType())]))),
    T.StructField("detected_text", T.ArrayType(T.StructType([
        T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())]))),
    T.StructField("caption", T.StringType()),
])

ANSWER_CACHE = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("cached_at_unix", T.DoubleType()),
    T.StructField("answer", T.StringType()),
    T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("used_model", T.StringType()),
    T.StructField("route", T.StringType()),
])

#: What the flow stores: a cached answer with the question it was read as and the summary of its hits.
ANSWERS = T.StructType([*ANSWER_CACHE.fields, T.StructField("question", T.StringType()), T.StructField("summary", T.StringType())])
