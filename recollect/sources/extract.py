"""Files from disk: the walk, and text out of their bytes."""

import functools
import io
import os
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from recollect import fixed
from recollect.functions.text import col
from recollect.session import stage

EXTRACTED = "rel_path string, name string, ext string, mtime_ns bigint, size bigint, text string, extractor string, error string"


LISTED = "path string, rel_path string, name string, outside_root boolean, mtime_ns bigint, size bigint, is_dir boolean"
#: Bytes of files that travel in one batch; a larger file travels alone.
BATCH_BYTES = 32 << 20
#: A row can't hold more.
ROW_BYTES = (1 << 31) - (1 << 16)


def file_system(root: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", root) else (fs.LocalFileSystem(), os.path.abspath(root))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """path, rel_path, name, outside_root, mtime_ns, size of every file below ``root``, hidden ones too. Content is not read.

    Directories are listed level by level, each level in parallel; linked directories are not entered. A linked file
    counts as outside if it leads there.
    """
    def list_one(files, base: str, path: str) -> list:
        from pyarrow import fs

        real = os.path.realpath(base) if isinstance(files, fs.LocalFileSystem) else None
        out = []
        for info in files.get_file_info(fs.FileSelector(path)):
            is_dir, linked = info.type == fs.FileType.Directory, real is not None and os.path.islink(info.path)
            if info.type == fs.FileType.NotFound or is_dir and linked:
                continue
            outside = linked and not os.path.realpath(info.path).startswith(real + os.sep)
            out.append((info.path, info.path[len(base):].lstrip("/"), info.base_name, outside, info.mtime_ns, info.size, is_dir))
        return out

    def level(frames):
        for pdf in frames:
            files, base = file_system(root)
            rows = [r for p in pdf["path"] for r in list_one(files, base, p)]
            yield pd.DataFrame(rows, columns=["path", "rel_path", "name", "outside_root", "mtime_ns", "size", "is_dir"]).astype({"size": "Int64", "mtime_ns": "Int64"})

    frontier, found = spark.createDataFrame([(file_system(root)[1],)], "path string"), []
    while True:
        listed = stage(frontier.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(level, LISTED), "listing")
        found.append(listed.where("NOT is_dir").drop("is_dir"))
        frontier = listed.where("is_dir").select("path")
        if frontier.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)


def with_content(root: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (with ``path`` and ``size``) with the bytes of its files and, where they can't be read, the error."""
    fields = [f for f in wanted.schema.fields]
    schema = T.StructType([*fields, T.StructField("content", T.BinaryType()), T.StructField("read_error", T.StringType())])

    def read(files, path: str, size: int):
        if size > ROW_BYTES:
            return None, f"OSError: {size} bytes are too many for one row"
        try:
            with files.open_input_stream(path, compression=None) as f:
                return f.read(), None
        except OSError as e:
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        files, _ = file_system(root)
        for batch in batches:
            first, held, total = 0, [], 0
            for i, (path, size) in enumerate(zip(batch.column("path").to_pylist(), batch.column("size").to_pylist())):
                if held and total + size > BATCH_BYTES:
                    yield _joined(batch.slice(first, i - first), held)
                    first, held, total = i, [], 0
                held.append(read(files, path, size))
                total += size
            if held:
                yield _joined(batch.slice(first), held)

    def _joined(rows, found):
        content, errors = zip(*found)
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(content, pa.binary()), pa.array(errors, pa.string())],
                                          names=[*rows.schema.names, "content", "read_error"])

    return wanted.mapInArrow(run, schema)


def _utf16(b: Column, little: bool) -> Column:
    """UTF-16 without its mark; lone surrogates and a last odd byte become the replacement character."""
    body = F.substring(b, F.lit(3), F.floor((F.octet_length(b) - 2) / 2).cast("int") * 2)
    units = F.regexp_replace(F.hex(body), "(....)", "$1 ")
    if little:
        units = F.regexp_replace(units, "..D[89AB] (?!..D[C-F] )", "FDFF ")
        units = F.regexp_replace(units, "(?<!..D[89AB] )..D[C-F] ", "FDFF ")
    else:
        units = F.regexp_replace(units, "(?<![0-9A-F])D[89AB].. (?!D[C-F].. )", "FFFD ")
        units = F.regexp_replace(units, "(?<!D[89AB].. )(?<![0-9A-F])D[C-F].. ", "FFFD ")
    text = F.decode(F.unhex(F.replace(units, F.lit(" "), F.lit(""))), "UTF-16LE" if little else "UTF-16BE")
    return F.concat(text, F.when(F.octet_length(b) % 2 == 1, F.lit("\ufffd")).otherwise(F.lit("")))


def decode_plain(content) -> Column:
    """Text of plain files: UTF-16 by its mark (broken parts replaced), UTF-8 with or without one, else Latin-1."""
    b = col(content)
    start = F.hex(F.substring(b, 1, 3))
    utf8 = F.when(start == "EFBBBF", F.substring(b, F.lit(4), F.octet_length(b))).otherwise(b)
    return (F.when(start.startswith("FFFE"), _utf16(b, True)).when(start.startswith("FEFF"), _utf16(b, False))
            .when(F.is_valid_utf8(utf8.cast("string")), utf8.cast("string"))
            .otherwise(F.decode(b, "ISO-8859-1")))


# --- office formats: one file at a time inside Arrow batches ----------------------------

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_PRES = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _word_text(p) -> str:
    marks = {_WORD + "tab": "\t", _WORD + "br": "\n", _WORD + "cr": "\n"}
    return "".join((n.text or "") if n.tag == _WORD + "t" else marks.get(n.tag, "") for n in p.iter())


def docx_text(data: bytes) -> str:
    """Paragraphs, then table rows with cells separated by tabs."""
    body = ElementTree.parse(zipfile.ZipFile(io.BytesIO(data)).open("word/document.xml")).getroot().find(_WORD + "body")
    lines = [_word_text(p) for p in body.findall(_WORD + "p")]
    for row in (r for t in body.findall(_WORD + "tbl") for r in t.findall(_WORD + "tr")):
        cells = ["\n".join(_word_text(p) for p in c.findall(_WORD + "p")).strip() for c in row.findall(_WORD + "tc")]
        lines.append("\t".join(cells))
    return "\n".join(lines)


def _number(name: str) -> int:
    return int(re.search(r"(\d+)\.xml$", name)[1])


def pptx_text(data: bytes) -> str:
    """Text of the shapes of each slide."""
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)
    bodies = (b for s in slides for b in ElementTree.parse(z.open(s)).getroot().iter(_PRES + "txBody"))
    return "\n".join("\n".join("".join(t.text or "" for t in p.iter(_DRAW + "t")) for p in b.findall(_DRAW + "p"))
                     for b in bodies)


def xlsx_text(data: bytes, sheet_rows: int | None = None) -> str:
    """``## Sheet: name`` and the non-blank rows of each sheet, cells separated by tabs; at most ``sheet_rows`` rows of each."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(_SHEET + "t"))
                  for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot().findall(_SHEET + "si")]
    names = [s.get("name") for s in ElementTree.parse(z.open("xl/workbook.xml")).getroot().iter(_SHEET + "sheet")]
    files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number)
    out = []
    for name, file in zip(names, files):
        out.append(f"## Sheet: {name}")
        rows = ElementTree.parse(z.open(file)).getroot().iter(_SHEET + "row")
        for i, row in enumerate(rows, 1):
            if sheet_rows is not None and int(row.get("r", i)) > sheet_rows:
                break
            cells: list[str] = []
            for c in row.findall(_SHEET + "c"):
                letters = re.match("[A-Z]*", c.get("r") or "")[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                cells += [""] * (at - 1 - len(cells))
                v, inline = c.find(_SHEET + "v"), c.find(_SHEET + "is")
                text = "".join(t.text or "" for t in inline.iter(_SHEET + "t")) if inline is not None else (
                    "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or "")
                cells.append(text.strip())
            if any(cells):
                out.append("\t".join(cells))
    return "\n".join(out)


def pdf_text(data: bytes) -> str:
    from pypdf import PdfReader

    def page_text(page):
        try:
            return page.extract_text() or ""
        except Exception:  # noqa: BLE001
            return None
    return "\n".join(t for t in map(page_text, PdfReader(io.BytesIO(data), strict=False).pages) if t is not None)


def xls_text(data: bytes, sheet_rows: int | None = None) -> str:
    import xlrd
    out = []
    for sheet in xlrd.open_workbook(file_contents=data).sheets():
        rows = ([str(v).strip() for v in sheet.row_values(i)] for i in range(sheet.nrows)[:sheet_rows])
        out += [f"## Sheet: {sheet.name}"] + ["\t".join(r) for r in rows if any(r)]
    return "\n".join(out)


def rtf_text(data: bytes) -> str:
    from striprtf.striprtf import rtf_to_text
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    return rtf_to_text(text)


READERS = {".pdf": ("pypdf", pdf_text), ".docx": ("python-docx", docx_text), ".pptx": ("python-pptx", pptx_text),
           ".xlsx": ("openpyxl", xlsx_text), ".xls": ("xlrd", xls_text), ".rtf": ("striprtf", rtf_text)}


def read_one(ext: str, data: bytes, fallback=None) -> tuple:
    """text, extractor, error. Never raises; ``fallback(ext, data)`` may stand in for a system converter."""
    name, reader = READERS.get(ext, ("unsupported", None))
    error = None
    if reader:
        try:
            return reader(data), name, None
        except ImportError as e:
            error = f"ImportError: {e}"
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
    text = fallback(ext, data) if fallback else None
    if ext == ".rtf":
        return text or None, "striprtf|textutil", error
    if text and len(text.strip()) > 10:
        return text, "textutil", error
    return None, "unsupported", error


def extract(files: DataFrame, fallback=None) -> DataFrame:
    """Files with ``content`` to text. Plain text stays in the JVM; other formats go through Arrow batches.

    A file without content has ``read_error`` as its error.
    """
    if "read_error" not in files.columns:
        files = files.withColumn("read_error", F.lit(None).cast("string"))
    lost = files.where("content IS NULL")
    files = files.where("content IS NOT NULL")
    cols = ["rel_path", "name", "ext", "mtime_ns", "size"]
    is_plain = F.col("ext").isin(fixed.TEXT_EXT)
    plain = files.where(is_plain).select(*cols, decode_plain("content").alias("text"), F.lit("plaintext").alias("extractor"),
                                         F.lit(None).cast("string").alias("error"))

    def batches(frames):
        for pdf in frames:
            found = [read_one(e, bytes(d), fallback) for e, d in zip(pdf["ext"], pdf["content"])]
            out = pd.DataFrame(found, columns=["text", "extractor", "error"], index=pdf.index)
            yield pd.concat([pdf[cols], out], axis=1)
    other = files.where(~is_plain).select(*cols, "content").mapInPandas(batches, EXTRACTED)
    unread = lost.select(*cols, F.lit(None).cast("string").alias("text"), F.lit("unread").alias("extractor"), F.col("read_error").alias("error"))
    return plain.unionByName(other).unionByName(unread)
