"""Generated methods that the JVM compiles: those of over 8000 bytes are interpreted, which takes several times as long."""

import contextlib
import datetime
import io
import re

import pytest
from pyspark.sql import functions as F

from recollect.functions import dates
from recollect.functions.porter import stem_word, with_term
from recollect.operators import index
from recollect.sources import corpus as C
from tests.conftest import SF
from tests.test_search import WORDS

COMPILED = 8000


def largest_method(df) -> int:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("codegen")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue()))


@pytest.fixture
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")    # an adaptive plan shows no code before it ran
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_entries_are_compiled(spark, plain_plans):
    assert 0 < largest_method(C.entries(spark, SF)) <= COMPILED


def test_stemming_is_compiled(spark, plain_plans):
    entries = C.entries(spark, SF)
    assert 0 < largest_method(index.build_postings(entries, True)) <= COMPILED
    assert 0 < largest_method(index.terms(entries)) <= COMPILED


def test_stems_on_both_sides_of_the_split(spark):
    words = [*WORDS, "relational", "hopping", "generalizations", "oscillators", "skies", "controll", "x", "", "Étude", "日本語ational", "y" * 70, None]
    got = with_term(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, raw string"))
    assert got.columns == ["i", "raw", "term"]
    assert {r.i: r.term for r in got.collect()} == {i: None if w is None else stem_word(w) for i, w in enumerate(words)}


def test_iso_text_of_times(spark):
    at = [0, 1, -1, 999_999, 86_399_999_999, -86_400_000_001, 1_700_000_000_123_456, 253_402_300_799_000_000, -62_135_596_800_000_000, 253_402_300_799_999_999, None]
    epoch = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
    got = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "i int, t bigint").select("i", dates.iso_utc("t").alias("s"))
    assert {r.i: r.s for r in got.collect()} == {i: None if t is None else (epoch + datetime.timedelta(microseconds=t)).isoformat() for i, t in enumerate(at)}
