"""Files, stored versions and streams."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from recollect import schemas
from recollect.operators import index, maintain, retrieve, rewrite, search, substring
from recollect.sources import corpus as C, extract
from recollect.sources.store import CorpusStore, Segment, due, next_seq
from recollect.streaming import incremental

from conftest import SF


def zipped(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
P = ('xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" '
     'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"')
DOCX = zipped({"word/document.xml": f"<w:document {W}><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t> a </w:t></w:r></w:p></w:tc><w:tc><w:p>"
               f"<w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>netflix</w:t></w:r></w:p></w:body></w:document>"})
XLSX = zipped({"xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One"/></sheets></workbook>',
               "xl/sharedStrings.xml": f"<sst {S}><si><t>rent</t></si></sst>",
               "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>12.5</v></c></row>'
               f'<row r="2"><c r="A2"/></row><row r="5001"><c r="A5001"><v>9</v></c></row></sheetData></worksheet>'})
PPTX = zipped({f"ppt/slides/slide{n}.xml": f"<p:sld {P}><p:txBody><a:p><a:r><a:t>slide {n}</a:t></a:r></a:p></p:txBody></p:sld>" for n in (10, 2)})


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "docs"
    files = {"a.txt": b"plain charge", "sub/b.md": b"\xef\xbb\xbfwith mark", "c.csv": "caf\xe9".encode("latin-1"), "d.log": "wide".encode("utf-16"),
             "e.docx": DOCX, "f.xlsx": XLSX, "g.pptx": PPTX, "bad.docx": b"no zip", "blank.txt": b" \n", "x.bin": b"1", "~$t.txt": b"t",
             "m.MP4": b"v", "s.mp3": b"s", "i.png": b"i", ".h/z.txt": b"h", "node_modules/q.txt": b"n"}
    for name, data in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return root


def test_office_texts():
    assert extract.docx_text(DOCX) == "Hello\tnetflix\na\tb"
    assert extract.xlsx_text(XLSX) == "## Sheet: One\nrent\t\t12.5\n9"
    assert extract.xlsx_text(XLSX, sheet_rows=5000) == "## Sheet: One\nrent\t\t12.5"
    assert extract.pptx_text(PPTX) == "slide 2\nslide 10"
    assert extract.read_one(".docx", b"x")[1:] == ("unsupported", "BadZipFile: File is not a zip file")
    assert extract.read_one(".doc", b"x", lambda e, d: "converted text") == ("converted text", "textutil", None)
    assert extract.read_one(".doc", b"x", lambda e, d: "short")[0] is None


def test_walk(spark, tree):
    (tree / "_notes.md").write_bytes(b"under")
    (tree / "empty_dir").mkdir()
    got = {r.rel_path: (r.size, r.mtime_ns) for r in extract.walk(spark, str(tree)).collect()}
    paths = [os.path.join(d, f) for d, _, fs in os.walk(tree) for f in fs]
    assert got == {os.path.relpath(p, tree): (os.path.getsize(p), os.stat(p).st_mtime_ns) for p in paths}


TEXTS = {"a.txt": "plain charge", "sub/b.md": "with mark", "c.csv": "café", "d.log": "wide", "e.docx": "Hello\tnetflix\na\tb",
         "f.xlsx": "## Sheet: One\nrent\t\t12.5\n9", "g.pptx": "slide 2\nslide 10"}


def test_document_runs(spark, tree, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "index"), buckets=4)
    run = lambda **o: incremental.ingest_documents(spark, str(tree), store, str(tmp_path / "report"), **o)
    texts = lambda: {r.filename: r.ocr_text for r in store.entries().collect()}
    first = run()
    assert texts() == TEXTS and first["indexed_this_run"] == 7 and first["skipped_empty"] == 3 and first["errors"] == 1
    assert first["skip_counts"] == {"video": 1, "hidden": 1, "image_or_audio": 2, "temp_prefix": 1, "noise_dirs": 1}
    assert {r.rel_path for r in spark.read.json(str(tmp_path / "report" / "skipped")).collect()} == {"bad.docx", "blank.txt", "x.bin"}
    second = run()
    assert second["indexed_this_run"] == 0 and second["skipped_unchanged"] == 7 and texts() == TEXTS
    (tree / "_notes.md").write_bytes(b"under netflix")
    (tree / "old.txt").write_bytes(b"synced late")
    os.utime(tree / "old.txt", (10 ** 9, 10 ** 9))
    (tree / "a.txt").write_bytes(b"changed text")
    os.utime(tree / "a.txt", (2 * 10 ** 9, 2 * 10 ** 9))
    assert run()["indexed_this_run"] == 3
    assert texts() == TEXTS | {"a.txt": "changed text", "old.txt": "synced late", "_notes.md": "under netflix"}
    os.utime(tree / "a.txt", (2 * 10 ** 9, 2 * 10 ** 9))
    (tree / "a.txt").write_bytes(b"forced texts")
    os.utime(tree / "a.txt", (2 * 10 ** 9, 2 * 10 ** 9))
    assert run()["indexed_this_run"] == 0 and run(force=True)["indexed_this_run"] == 9 and texts()["a.txt"] == "forced texts"
    assert sorted(r.filename for r in search.search(store.corpus(), "netflix").collect()) == ["_notes.md", "e.docx"]
    assert run(force=True, limit=2)["indexed_this_run"] == 2 and run(force=True, max_chars=10_000)["cut_chars"] == 0


def test_skipped_files_are_not_read_and_unreadable_ones_are_errors(spark, tree, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "index"), buckets=2)
    files = extract.walk(spark, str(tree))
    for name in ("m.MP4", "~$t.txt", "node_modules/q.txt", "a.txt"):
        (tree / name).unlink()
    rows = {r.rel_path: r for r in incremental.document_batch(store, files, str(tree)).collect()}
    assert rows["a.txt"].status == "error" and rows["a.txt"].error.startswith("FileNotFoundError")
    assert (rows["m.MP4"].status, rows["~$t.txt"].status, rows["node_modules/q.txt"].status) == ("video", "temp", "noise")


def test_broken_utf16(spark):
    cases = [b"\xff\xfea\x00b", b"\xff\xfea\x00\x00\xd8b\x00", b"\xfe\xff\x00a\xdc\x00\x00b", b"\xff\xfe", "ok 😀".encode("utf-16"),
             b"\xfe\xff" + "é😀x".encode("utf-16-be"), b"\xff\xfe\x00\xd8\x00\xd8\x00\xdc\x00\xdc"]
    got = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, b binary").select("i", extract.decode_plain("b").alias("t")).collect()
    assert [r.t for r in sorted(got, key=lambda r: r.i)] == [c.decode("utf-16", "replace") for c in cases]


def test_lock(spark, tmp_path):
    with maintain.index_lock(spark, str(tmp_path / "i")) as one, maintain.index_lock(spark, str(tmp_path / "i")) as two:
        assert one and not two
    with maintain.index_lock(spark, str(tmp_path / "i")) as again:
        assert again


def test_command_line_sources(spark, tmp_path):
    from recollect import __main__ as cli
    store = CorpusStore(spark, str(tmp_path / "index"), buckets=2)
    C.chat_messages(spark, SF).write.parquet(str(tmp_path / "chat"))
    C.handles(spark, SF).write.parquet(str(tmp_path / "handles"))
    C.photos(spark, SF).write.parquet(str(tmp_path / "photos"))
    call = lambda *more: cli.run_ingest(spark, store, cli.arguments(["ingest", "--index", store.root, *more]))
    chat = ["--source", "messages", "--root", str(tmp_path / "chat"), "--handles", str(tmp_path / "handles"), "--checkpoint", str(tmp_path / "r")]
    first, again = call(*chat), call(*chat)
    assert first["new"] > 0 and "new" not in again and again["known"] == first["new"] + first.get("known", 0)
    photos = call("--source", "photos", "--root", str(tmp_path / "photos"), "--limit", "20")
    assert photos["new"] > 0 and store.entries().count() == first["new"] + photos["new"]
    assert (tmp_path / "r" / "messages.json").exists()


def test_versions_prune_and_pruned_fetch(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "index"), buckets=4)
    assert not store.exists()
    store.write(C.entries(spark, SF), partitions=2)
    n = store.entries().count()
    assert maintain.run_prune(store, dry_run=True)["code"] == 0 and maintain.run_prune(store)["code"] == 1
    report = maintain.run_prune(store, yes=True, compact=True)
    assert report["deleted"] == report["matched"] == n - store.entries().count() and store.versions() == [3]
    found = retrieve.retrieve(store.corpus(), "netflix charge", 5)
    assert found.count() == 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_message_stream(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "index"), buckets=2)
    src = str(tmp_path / "chat")
    chat = C.chat_messages(spark, SF).select(*[F.expr(c) for c in ("rowid", "guid", "text", "cast(date_raw AS bigint) AS date_raw", "cast(is_from_me AS int) AS is_from_me", "handle_rowid")])
    chat.where("rowid < 1000000000000").coalesce(1).write.mode("append").parquet(src)
    run = lambda: incremental.stream_messages(spark, src, C.handles(spark, SF), store, str(tmp_path / "ck")).awaitTermination()
    run()
    first = store.entries().count()
    chat.coalesce(1).write.mode("append").parquet(src)
    run()
    from recollect.operators import ingest
    want = ingest.message_rows(C.chat_messages(spark, SF), C.handles(spark, SF)).where("status = 'new'")
    assert store.entries().count() == want.select("uuid").distinct().count() > first
    assert store.entries().select("seq").distinct().count() == store.entries().count()


# ===== segments ============================================================================

def model(entries):
    """What a fresh build of these entries gives."""
    c = index.index(entries)
    places = index.token_places(entries, c.postings.select("raw", "term").distinct())
    return (sorted(map(tuple, places.collect())), sorted(map(tuple, c.postings.select("term", "raw", "seq", "tf", "tf_text", "doc_len").collect())), tuple(c.stats.first()),
            sorted(map(tuple, substring.vocabulary(c.postings).collect())), sorted(r.token for r in rewrite.term_vocab(entries).collect()))


def read(store):
    c = store.corpus()
    words = c.grams.groupBy("gram", "raw", "term").agg(F.sum("df").alias("df")).where("df > 0").select("raw", "term", "df").distinct()
    return (sorted(map(tuple, c.places.select("term", "seq", "p").collect())), sorted(map(tuple, c.postings.select("term", "raw", "seq", "tf", "tf_text", "doc_len").collect())), tuple(c.stats.first()),
            sorted(map(tuple, words.collect())), sorted(r.token for r in c.words.collect()))


def batch(spark, ids, seq, text):
    rows = [(seq + i, f"u{u}", f"f{u}.txt", None if u % 3 else "2024-01-05", f"{text} {u} charge apple{u % 5}.com", "", "", 5.0) for i, u in enumerate(ids)]
    return spark.createDataFrame(rows, schemas.ENTRIES)


def long_enough(found):
    """The vocabulary's tokens that have a trigram of ASCII letters and digits."""
    import re
    return [x for x in found if re.search("[a-z0-9]{3}", x[0])]


def test_segments_equal_a_fresh_build(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "index"), buckets=2)
    now = {}
    steps = [(range(20), "first"), (range(5, 9), "second"), ([3, 40], "third"), ([3], "fourth"), (range(41, 44), "fifth"), ([5, 41], "sixth")]
    for k, (ids, text) in enumerate(steps):
        new = batch(spark, ids, next_seq(store), text)
        now |= {r.uuid: r for r in new.collect()}
        store.apply(new, merge=k > 3)
        if k == 2:
            store.delete(F.col("uuid").isin("u1", "u6"))
            now = {u: r for u, r in now.items() if u not in ("u1", "u6")}
    live = spark.createDataFrame(list(now.values()), schemas.ENTRIES)
    assert sorted(store.entries().collect()) == sorted(live.collect())
    want = model(live)
    got = read(store)
    assert got[:3] == want[:3] and got[3] == long_enough(want[3]) and got[4] == want[4]
    assert len(store.state()[1]) == 4   # of seven
    found = lambda c: [r.uuid for r in substring.substring_search(c, "apple1.com cond", 30).collect()]
    before = found(store.corpus())
    assert before == [r.uuid for r in search.substring_search(live, "apple1.com cond", 30).collect()] and before
    store.compact()
    assert len(store.state()[1]) == 1 and store.state()[1][0].gone_rows == 0 and read(store) == got and found(store.corpus()) == before


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    sizes = []
    for n in (50, 2000):
        store = CorpusStore(spark, str(tmp_path / str(n)), buckets=2)
        store.apply(batch(spark, range(n), 0, "base"))
        store.apply(batch(spark, range(5), next_seq(store), "again"), merge=False)
        name = store.state()[1][-1].name
        sizes.append(sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{store.root}/segments/{name}") for f in fs))
    assert sizes[1] < 1.2 * sizes[0]


def test_the_second_of_two_writers_starts_anew(spark, tmp_path, monkeypatch):
    store, other = (CorpusStore(spark, str(tmp_path / "index"), buckets=2) for _ in range(2))
    store.apply(batch(spark, range(4), 0, "base"))
    claim = CorpusStore._claim
    late = []

    def meanwhile(self, no, segments):
        if self is store and not late:
            late.append(other.apply(batch(spark, [2], 10, "other"), merge=False))
        return claim(self, no, segments)

    monkeypatch.setattr(CorpusStore, "_claim", meanwhile)
    store.apply(batch(spark, [2, 3], 20, "mine"), merge=False)
    assert store.versions() == [1, 2, 3]
    assert {r.uuid: r.ocr_text.split()[0] for r in store.entries().collect()} == {"u0": "base", "u1": "base", "u2": "mine", "u3": "mine"}


def test_tiers():
    seg = lambda n, gone=0: Segment("s", 0, n, 0, gone, 0, 0)
    assert due([seg(1000), seg(1), seg(2), seg(1)]) == []
    four = [seg(1000), seg(1), seg(2), seg(0, 1), seg(3)]
    assert due(four) == four[1:]
    assert len(due([seg(5000), seg(70), seg(70), seg(70), seg(80), seg(1)])) == 5
