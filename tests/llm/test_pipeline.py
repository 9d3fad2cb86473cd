import collections
import re

import corpus_pipeline
from recollect.llm import language

from .fixtures import documents, prose
from .test_text_operators import brute_hits, brute_near, check_pieces, library  # noqa: F401


def test_stages_against_brute_force(spark, tmp_path, library):  # noqa: F811
    passage = prose(900, 30)
    rows = [(i, prose(i, 60), "en") for i in range(40)]
    rows += [(100 + i, rows[i][1] + " tail", "en") for i in range(5)] + [(200, rows[7][1], None), (201, None, "en"), (202, "12 34", "en"), (203, "", None)]
    rows += [(300, prose(301, 20) + " " + passage + " " + prose(302, 20), "en"), (301, prose(303, 30) + ' password = "hunter2xyz" ' + prose(304, 30), "en"), (302, "x" * 3000 + " " + prose(305, 50), "en")]
    sf = str(tmp_path / "tables")
    documents(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), list(rows)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "benchmark_decontamination", "secret_scans", "packing"]
    model = language.train_on(docs)
    for name, step in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        step(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "language_id":
            kept = [r for r in kept if not model.predict(r[1])[2]]
            assert {r[0] for r in rows} - {r[0] for r in kept} == {201, 202, 203}
        elif name == "near_dedup":
            stay = {r[0] for r in brute_near([r[:2] for r in kept], 5, 80) if r[3]}
            kept = [r for r in kept if r[0] in stay]
        elif name == "benchmark_decontamination":
            bad = {r[0] for r in brute_hits([r[:2] for r in kept], [(1, passage)]) if r[5]}
            assert bad == {300}
            kept = [r for r in kept if r[0] not in bad]
        elif name == "secret_scans":
            kept = [(i, re.sub(r'password = "hunter2xyz', "[secret]", t), k) for i, t, k in kept]
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            got = {r["doc_id"]: (r["text"], r["lang"], r["n_chars"]) for r in docs.collect()}
            assert got == {i: (t, k, len(t)) for i, t, k in kept}
    import zlib
    Row = collections.namedtuple("Row", "doc_id start length ids_crc32 doc_tokens sequence_id offset")
    pieces = [Row(r["doc_id"], r["start"], r["length"], zlib.crc32(r["ids"]), r["doc_tokens"], r["sequence_id"], r["offset"])._asdict() for r in docs.collect()]
    check_pieces([r[:2] for r in kept], pieces, library, 1024)


def test_run_equals_the_stages_on_an_empty_table(spark, tmp_path):
    sf = str(tmp_path / "none")
    documents(spark, [(1, "x")]).where("doc_id = 0").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "some text")], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).collect() == []
