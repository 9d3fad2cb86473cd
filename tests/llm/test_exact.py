import collections
import hashlib

import pytest

from recollect.llm import exact

from .fixtures import documents, prose

LOWER = {i: i + 32 for i in range(65, 91)}
ROWS = ([(1, None), (2, ""), (3, "Same Text"), (4, "same text"), (4, "same text"), (5, "ÉTÉ"), (6, "été"), (7, "x" * 200_000), (8, "X" * 200_000), (None, "same TEXT"), (None, "no id"), (None, "no id"), (9, " same text")]
        + [(100 + i, "hot") for i in range(300)] + [(1000 + i, prose(i, 5)) for i in range(300)])


def brute(rows):
    by = collections.defaultdict(list)
    for i, t in rows:
        by[(t or "").translate(LOWER)].append(i)
    out = []
    for t, ids in by.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("per_row, most", [(16, 1 << 30), (1, 1 << 30), (16, 2000)])
def test_groups_match_brute_force(spark, per_row, most):
    got = exact.groups(documents(spark, ROWS), per_row=per_row, most_cells=most)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ROWS)


@pytest.mark.parametrize("most", [1 << 30, 3000])
def test_whole_rows_stay_once(spark, most):
    docs = documents(spark, ROWS)
    got = exact.deduplicate(docs, most_cells=most)
    assert got.columns == docs.columns
    want = sorted(((i, s) for i, _, _, kept, s in brute(ROWS) if kept), key=repr)
    assert sorted(((r["doc_id"], hashlib.sha256((r["text"] or "").translate(LOWER).encode()).hexdigest()) for r in got.collect()), key=repr) == want


def test_filter_has_every_repeat_and_few_single_rows(spark):
    digests = spark.range(20_000).selectExpr("sha2(cast(if(id < 200, id div 2, id) AS string), 256) AS digest", "id")
    found = exact.repeat_filter(digests, buckets=10)
    marked = exact.mark(digests, found, 10).where("possible")
    assert marked.where("id < 200").count() == 200
    assert 0 < marked.where("id >= 200").count() < 600


def test_empty_table_and_native_plan(spark):
    none = documents(spark, [(1, "x")]).where("doc_id = 0")
    assert exact.groups(none).collect() == [] and exact.deduplicate(none).collect() == []
    assert "Python" not in exact.groups(documents(spark, ROWS[:5]))._jdf.queryExecution().toString()
