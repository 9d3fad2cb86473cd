"""WARC archives with a two-level capture index: sorted keys in compressed blocks, a sparse directory, range reads.

Writing: every task writes one archive of gzip members, one record each, and returns where each record lies. Of equal
payloads the record with the largest id is the response and the others are revisits that refer to it; how often a
payload occurs is counted by its digest before payloads move.

Index: rows sorted by reversed-host URL key and id are dealt by ranges; every task writes one index file, blocks of
``lines`` rows compressed with zlib and, at its end, the directory of the blocks' first keys. What the driver holds is
one entry for each index file, so it is bounded by the number of tasks.

Reading: looked-up keys are dealt by ranges in the same order; a task finds the index file and the block by binary
search, reads the block by its range, and then each record by its range. It keeps one directory and one block at a time.

Files go to the folder that the caller names, by default below ``spark.checkpoint.dir``, which all executors share. Each
attempt of a task writes a file of its own name and only the names of attempts that Spark accepted are in the index, so
a lost executor or a repeated task leaves at most a file that nothing refers to.

Defined cases: a null html is an empty payload; a null url is kept as an empty target; with equal payloads and equal
largest ids all rows of that id are responses; a null id is no target of a revisit; equal rows are records of their own;
an empty table gives no records; other columns are ignored.
"""

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recollect.llm.frames import arrow_map, stage, staging_root

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: http://www.a.example.com/x?y becomes com,example,a)/x?y."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return (url or "").lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _filesystem(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One WARC record; the ids and the payload's length stand in extension fields."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda i: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{i}").urn
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Target-URI": _line(url or ""), "WARC-Date": DATE,
              "WARC-Record-ID": f"<{name(page_id)}>", "WARC-Payload-Digest": "sha1:" + payload_digest(payload),
              "X-Page-ID": "" if page_id is None else page_id, "X-Payload-Length": len(payload)}
    if revisit:
        fields |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<{name(refers_to)}>", "X-Refers-To-Page-ID": refers_to}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of a record, and its payload (None for a revisit). A payload that doesn't match its digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    if payload is not None and "sha1:" + payload_digest(payload) != fields["WARC-Payload-Digest"]:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    number = lambda x: int(x) if x else None
    return {"page_id": number(fields["X-Page-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
            "refers_to": number(fields.get("X-Refers-To-Page-ID")), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "payload_bytes": int(fields["X-Payload-Length"]), "payload": payload}


@dataclass
class Archives:
    """Where archives and their index lie: index files in order of their first entries."""

    spark: SparkSession
    root: str
    firsts: list[tuple[str, str]]
    files: list[str]
    records: int


def _parts(spark: SparkSession, records: int) -> int:
    """Ranges of the index: a bounded number of records each, and enough of them for all cores; AQE would go by their few bytes."""
    return max(1, -(-records // 20_000), min(2 * spark.sparkContext.defaultParallelism, -(-records // 500)))


def write_records(pages: DataFrame, root: str, least: int, id_col: str, url_col: str, html_col: str, level: int) -> DataFrame:
    """Writes the archives; (key, page, file, start, size) of every record."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    many = (rows.where(F.octet_length("payload") >= least).select(F.sha1("payload").alias("sha1"), "page_id").groupBy("sha1")
            .agg(F.count("*").alias("n"), F.max("page_id").alias("last")).where("n > 1").select("sha1", "last"))
    many = stage(many, "repeated-payloads")
    marked = rows.withColumn("sha1", F.when(F.octet_length("payload") >= least, F.sha1("payload"))).join(many, "sha1", "left")
    marked = marked.select("page_id", "url", "payload", F.when(F.coalesce(F.col("page_id") != F.col("last"), F.col("last").isNotNull()), F.col("last")).alias("refers_to"))
    target = pa.schema([("key", pa.string()), ("page", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(root)
        name, sink, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            places = []
            for page, url, data, last in zip(*(c for c in batch.columns)):
                page, url, last = page.as_py(), url.as_py(), last.as_py()
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = pack.compress(record(page, url, data.as_py(), last)) + pack.flush()
                if sink is None:
                    files.create_dir(f"{base}/archives", recursive=True)
                    sink = files.open_output_stream(f"{base}/archives/{name}", compression=None)
                sink.write(member)
                places.append((url_key(url), _page(page), name, at, len(member)))
                at += len(member)
            if places:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*places), target)], schema=target)
        if sink is not None:
            sink.close()

    return marked.mapInArrow(run, "key string, page string, file string, start bigint, size bigint")


def _page(page_id) -> str:
    return "" if page_id is None else str(page_id)


def write_index(places: DataFrame, root: str, lines: int, parts: int) -> list:
    """Writes the index files; (first key, first page, file) of each, in order."""
    ordered = places.repartitionByRange(parts, "key", "page").sortWithinPartitions("key", "page", "file", "start")
    target = pa.schema([("key", pa.string()), ("page", pa.string()), ("file", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(root)
        name, sink, at, held, directory = f"{uuid.uuid4().hex}.idx", None, 0, [], []

        def flush():
            nonlocal sink, at
            if sink is None:
                files.create_dir(f"{base}/index", recursive=True)
                sink = files.open_output_stream(f"{base}/index/{name}", compression=None)
            block = zlib.compress(json.dumps(held).encode(), 6)
            directory.append((held[0][0], held[0][1], at, len(block)))
            sink.write(block)
            at += len(block)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) >= lines:
                    flush()
        if held:
            flush()
        if sink is not None:
            tail = zlib.compress(json.dumps(directory).encode(), 6)
            sink.write(tail + len(tail).to_bytes(8, "big"))
            sink.close()
            yield pa.RecordBatch.from_pydict({"key": [directory[0][0]], "page": [directory[0][1]], "file": [name]}, schema=target)

    return stage(ordered.mapInArrow(run, "key string, page string, file string"), "index-files").sort("key", "page").collect()


def write(pages: DataFrame, root: str | None = None, least: int = 0, lines: int = 512, level: int = 1,
          id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Archives:
    """Archives and index of all rows. Payloads of fewer than ``least`` bytes never become revisits."""
    spark = pages.sparkSession
    root = root or f"{staging_root(spark)}/recollect/warc-{uuid.uuid4().hex}"
    places = stage(write_records(pages, root, least, id_col, url_col, html_col, level), "record-places")
    records = places.count()
    index = write_index(places, root, lines, _parts(spark, records))
    return Archives(spark, root, [(r["key"], r["page"]) for r in index], [r["file"] for r in index], records)


class _Index:
    """Binary search through index files in a task; one directory and one block are kept."""

    def __init__(self, files, base: str, firsts: list, names: list):
        self.files, self.base, self.firsts, self.names = files, base, firsts, names
        self.directory, self.block = (None, [], []), (None, [])

    def _read(self, name: str, start: int, size: int) -> bytes:
        with self.files.open_input_file(f"{self.base}/index/{name}") as f:
            return f.read_at(size, start)

    def _open(self, i: int):
        if self.directory[0] != i:
            with self.files.open_input_file(f"{self.base}/index/{self.names[i]}") as f:
                end = f.size() - 8
                size = int.from_bytes(f.read_at(8, end), "big")
                entries = json.loads(zlib.decompress(f.read_at(size, end - size)))
            self.directory = i, entries, [(e[0], e[1]) for e in entries]
        return self.directory[1:]

    def find(self, key: str, page: str) -> Iterator[tuple]:
        """(file, start, size) of each record with this key and id, which may lie across blocks and files."""
        want = (key, page)
        i = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while i < len(self.names) and self.firsts[i] <= want:
            entries, firsts = self._open(i)
            j = max(0, bisect.bisect_left(firsts, want) - 1)
            while j < len(entries) and firsts[j] <= want:
                if self.block[0] != (i, j):
                    self.block = (i, j), json.loads(zlib.decompress(self._read(self.names[i], *entries[j][2:])))
                rows = self.block[1]
                k = bisect.bisect_left(rows, [key, page])
                while k < len(rows) and (rows[k][0], rows[k][1]) == want:
                    yield tuple(rows[k][2:])
                    k += 1
                j += 1
            i += 1


def lookup(archives: Archives, wanted: DataFrame, payloads: bool = True, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The records of the wanted (url, id) rows, read back from the archives through the index."""
    root, firsts, names = archives.root, archives.firsts, archives.files

    def keys(batch: pa.RecordBatch) -> dict:
        return {"key": [url_key(u) for u in batch.column(0).to_pylist()], "page": [_page(p) for p in batch.column(1).to_pylist()]}

    asked = arrow_map(wanted.select(F.col(url_col).cast("string").alias("url"), F.col(id_col).cast("bigint").alias("page_id")), keys, "key string, page string")
    ordered = asked.distinct().repartitionByRange(_parts(archives.spark, archives.records), "key", "page").sortWithinPartitions("key", "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(root)
        index, opened = _Index(files, base, firsts, names), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                for key, page in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                    for name, start, size in index.find(key, page):
                        if name not in opened:
                            if len(opened) >= 64:
                                opened.pop(next(iter(opened))).close()
                            opened[name] = files.open_input_file(f"{base}/archives/{name}")
                        found = parse(zlib.decompress(opened[name].read_at(size, start), 31))
                        rows.append(found if payloads else found | {"payload": None})
                yield pa.RecordBatch.from_pylist(rows, schema=RECORD_SCHEMA)
        for f in opened.values():
            f.close()

    return ordered.mapInArrow(run, RECORDS)


RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                           ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def digest(records: DataFrame) -> DataFrame:
    """The columns of query op5."""
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
