"""The operators as queries over whole tables, and the SQL that checks them where SQL can express it."""

from pyspark.sql import DataFrame, SparkSession

from recollect.llm.frames import read

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op8_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    from recollect.llm import decontaminate as m
    return m.digest(m.find(read(spark, d, "documents"), read(spark, d, "benchmark")))


@query
def op3_token_counts(spark: SparkSession, d: str) -> DataFrame:
    from recollect.llm import tokens as m
    return m.digest(m.count_tokens(read(spark, d, "documents")))


@query
def op7_packing(spark: SparkSession, d: str) -> DataFrame:
    from recollect.llm import packing as m
    return m.digest(m.pack(read(spark, d, "documents")))


@query
def op2_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    from recollect.llm import neardup as m
    return m.near_duplicates(read(spark, d, "documents"), words=3, percent=85)


@query
def op1_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    from recollect.llm import repeats as m
    return m.digest(m.remove_repeats(read(spark, d, "documents")))


@query
def op6_language_id(spark: SparkSession, d: str) -> DataFrame:
    from recollect.llm import language as m
    docs = read(spark, d, "documents")
    return m.identify(docs, m.train_on(docs))


@query
def op4_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    from recollect.llm import secret_scan as m
    return m.digest(m.find(read(spark, d, "documents")))


@query
def op10_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    from recollect.llm import quality as m
    return m.judge(read(spark, d, "documents"), read(spark, d, "labels"))


@query
def op5_warc(spark: SparkSession, d: str) -> DataFrame:
    from recollect.llm import warc as m
    pages = read(spark, d, "pages")
    return m.digest(m.lookup(m.write(pages), pages, payloads=False))


@query
def op9_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    from recollect.llm import extraction as m
    pages = read(spark, d, "pages")
    return m.digest(m.extract(pages, m.train(pages)))


@query
def op12_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    from recollect.llm import exact as m
    return m.groups(read(spark, d, "documents"))


@query
def op13_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    from recollect.llm import merkle as m
    return m.digest(read(spark, d, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    from recollect.llm import prefixtrie as m
    return m.digest(read(spark, d, "conversations"))
