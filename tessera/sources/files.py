"""Reading documents from folders, and text from their bytes."""

from __future__ import annotations

import io
import os
import stat
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import paths

MAX_TEXT_BYTES = MAX_DOCUMENT_BYTES = 64 * 1024 * 1024
MAX_PDF_PAGES = 2000
WALK_SCHEMA = "path string, root string, kind string, mime string, size long, mtime double, content_sig string, source_device long"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class ExtractionError(ValueError):
    """A document that can't be read as text; the message is one of a few fixed words."""


def docx_text(content: bytes) -> str:
    """The paragraphs of a DOCX file, with blank lines between them. Documents with a DTD or entities are refused."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            info = z.getinfo("word/document.xml")
            if info.file_size > MAX_DOCUMENT_BYTES:
                raise ExtractionError("too_large")
            xml = z.read(info)
    except (zipfile.BadZipFile, KeyError) as e:
        raise ExtractionError("not_a_docx") from e
    head = xml.lower()
    if b"<!doctype" in head or b"<!entity" in head:
        raise ExtractionError("entities")
    try:
        tree = ElementTree.fromstring(xml)
    except ElementTree.ParseError as e:
        raise ExtractionError("not_a_docx") from e
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in tree.iter(f"{_WORD}p"))
    return "\n\n".join(p for p in paragraphs if p)


def pdf_text(content: bytes) -> str:
    """The pages of a PDF file, if a reader is installed. Encrypted, empty and very long files are refused."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ExtractionError("no_pdf_reader") from e
    reader = PdfReader(io.BytesIO(content))
    if reader.is_encrypted:
        raise ExtractionError("encrypted")
    if len(reader.pages) > MAX_PDF_PAGES:
        raise ExtractionError("too_long")
    text = "\n\n".join(page.extract_text() or "" for page in reader.pages)
    if not text.strip():
        raise ExtractionError("empty")
    return text


def extract(path: str, content: bytes | None) -> str:
    """The text of one file by its extension; other bytes are read as UTF-8, and what isn't valid is left out."""
    if content is None:
        raise ExtractionError("unreadable")
    if len(content) > MAX_TEXT_BYTES:
        raise ExtractionError("too_large")
    low = path.lower()
    if low.endswith(".docx"):
        return docx_text(content)
    if low.endswith(".pdf"):
        return pdf_text(content)
    return content.decode("utf-8", "ignore")


def _walk(root: str, excluded: tuple[str, ...], devices: tuple[int, ...] | None, every: bool) -> Iterator[tuple[str, os.stat_result] | tuple[str, OSError]]:
    """Regular files below a root, in order, without following links; a root that is a file is itself the only one."""
    skipped = set(paths.SKIPPED_NAMES)
    known = (*paths.TEXT_EXTENSIONS, *paths.IMAGE_EXTENSIONS, *paths.DOCUMENT_EXTENSIONS)
    wanted = lambda p: every or p.lower().endswith(known)
    out = lambda p: any(p == e or p.startswith(e.rstrip("/") + "/") for e in excluded)
    todo = [root]
    while todo:
        path = todo.pop()
        try:
            st = os.lstat(path)
            if out(path) or devices is not None and st.st_dev not in devices:
                continue
            if stat.S_ISREG(st.st_mode) and wanted(path):
                yield path, st
            elif stat.S_ISDIR(st.st_mode):
                todo.extend(os.path.join(path, n) for n in sorted(os.listdir(path), reverse=True) if n not in skipped)
        except OSError as e:
            yield path, e


def walk(spark: SparkSession, roots: Iterable[str], *, excluded: Iterable[str] = (), devices: Iterable[int] | None = None, every: bool = False) -> DataFrame:
    """``path, root, kind, mime, size, mtime, content_sig, source_device, error, errno``: all files below the roots.

    The roots' first levels are listed on the driver and walked by the
    executors, which must see the same file system.  Folders that hold
    generated files, excluded prefixes, links and other devices are left out;
    a place that can't be read becomes a row with its error.
    """
    excluded, devices = tuple(excluded), tuple(devices) if devices is not None else None
    starts = []
    for root in map(os.path.abspath, roots):
        names = sorted(os.listdir(root)) if os.path.isdir(root) else []
        starts += [(root, os.path.join(root, n)) for n in names if n not in paths.SKIPPED_NAMES] or [(root, root)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for path, st in _walk(start, excluded, devices, every):
                    if isinstance(st, OSError):
                        rows.append((path, root, None, None, None, None, type(st).__name__, st.errno))
                    else:
                        rows.append((path, root, st.st_size, st.st_mtime, f"{st.st_size}:{st.st_mtime_ns}", st.st_dev, None, None))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 8
                types = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    names = ["path", "root", "size", "mtime", "content_sig", "source_device", "error", "errno"]
    schema = "path string, root string, size long, mtime double, content_sig string, source_device long, error string, errno int"
    begun = spark.createDataFrame(starts, "root string, start string").repartition(max(1, min(len(starts), 1000)))
    found = begun.mapInArrow(run, schema)
    p = F.col("path")
    return found.select("path", "root", paths.kind_of(p).alias("kind"), paths.mime_of(p).alias("mime"), "size", "mtime", "content_sig", "source_device", "error", "errno")


def texts(files: DataFrame) -> DataFrame:
    """``files`` (``path, content_sig``) with ``text, content_hash, error``; each file is read where its row is.

    A file whose signature has changed while it was read gets the error
    ``changed``; what can't be read or extracted gets its error and no text.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, digest, error = [], [], []
            for path, sig in zip(batch.column("path").to_pylist(), batch.column("content_sig").to_pylist(), strict=True):
                t = h = e = None
                try:
                    with open(path, "rb") as f:
                        content = f.read(MAX_TEXT_BYTES + 1)
                        st = os.fstat(f.fileno())
                    if sig is not None and f"{st.st_size}:{st.st_mtime_ns}" != sig:
                        e = "changed"
                    else:
                        h = hashlib.sha256(content).hexdigest()
                        t = extract(path, content)
                except ExtractionError as x:
                    e = str(x)
                except OSError as x:
                    e = type(x).__name__
                text.append(t)
                digest.append(h)
                error.append(e)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string()), pa.array(digest, pa.string()), pa.array(error, pa.string())], names=[*batch.schema.names, "text", "content_hash", "error"])

    rows = files.drop("text", "content_hash", "error")
    schema = StructType([*rows.schema.fields, *(StructField(n, StringType()) for n in ("text", "content_hash", "error"))])
    return rows.mapInArrow(run, schema)


def footprint(spark: SparkSession, path: str) -> DataFrame:
    """One row: number and bytes of the files below a path, without reading them."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return listed.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
