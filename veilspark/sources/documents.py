"""Ingestion of txt, md, docx and odt files, annotated corpora and prediction files.

A file becomes text or is refused with a reason; it never silently becomes an empty text.
"""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_extension

INGESTED = "struct<status:string,text:string,format:string,warnings:array<string>,reason:string>"
_KIND = pa.struct([("status", pa.string()), ("text", pa.string()), ("format", pa.string()), ("warnings", pa.list_(pa.string())), ("reason", pa.string())])
MAX_ENTRY = 50 * 1024 * 1024
MAX_MIMETYPE = 256
ODT_MIMETYPE = b"application/vnd.oasis.opendocument.text"
ZIP = b"PK\x03\x04"
#: Leading bytes of files that aren't text; the first that matches names the reason.
SIGNATURES = ((ZIP, "a ZIP archive"), (b"PK\x05\x06", "an empty ZIP archive"), (b"%PDF", "PDF"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "an old binary office file"), (b"\x89PNG", "a PNG image"), (b"\xff\xd8\xff", "a JPEG image"), (b"GIF8", "a GIF image"))

CORPUS_SCHEMA = "id bigint, text string, entities array<struct<type:string,start:int,end:int>>"


class Refused(Exception):
    pass


def plain_text(data: bytes, kind: str) -> dict:
    for head, name in SIGNATURES:
        if data.startswith(head):
            raise Refused(f"the content is {name}, not text")
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raise Refused("the text is UTF-16; save it as UTF-8")
    try:
        text = data.removeprefix(b"\xef\xbb\xbf").decode("utf-8")
    except UnicodeDecodeError:
        raise Refused("the text is neither UTF-8 nor UTF-16") from None
    return {"text": text, "format": kind, "warnings": [] if text else ["empty"]}


def bounded_entry(archive: zipfile.ZipFile, name: str, most: int, what: str) -> bytes:
    """An entry's bytes; its declared size and what it really inflates to must both be at most `most`."""
    try:
        info = archive.getinfo(name)
    except KeyError:
        raise Refused(f"{name} is missing from the {what} file") from None
    if info.file_size > most:
        raise Refused(f"{name} declares more than {most} bytes")
    info.file_size = most + 1  # a declared size may be false: read on until the bound
    try:
        with archive.open(info) as f:
            data, n = [], 0
            while chunk := f.read(1 << 16):
                n += len(chunk)
                if n > most:
                    raise Refused(f"{name} inflates to more than {most} bytes")
                data.append(chunk)
    except Refused:
        raise
    except Exception:
        raise Refused(f"{name} of the {what} file can't be read") from None
    return b"".join(data)


def office_file(data: bytes, kind: str, most: int) -> dict:
    if not data.startswith(ZIP):
        raise Refused(f"the {kind} file has no ZIP signature")
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except Exception:
        raise Refused(f"the {kind} file's archive is corrupt") from None
    if kind == "odt" and bounded_entry(archive, "mimetype", MAX_MIMETYPE, kind) != ODT_MIMETYPE:
        raise Refused("mimetype isn't that of an OpenDocument text")
    name = "word/document.xml" if kind == "docx" else "content.xml"
    try:
        xml = bounded_entry(archive, name, most, kind).decode("utf-8")
    except UnicodeDecodeError:
        raise Refused(f"{name} isn't UTF-8") from None
    return {"text": docx_text(xml) if kind == "docx" else odt_text(xml), "format": kind, "warnings": []}


_TAG = re.compile(r"<(/?)([^\s/>]*)[^>]*?(/?)>")
_ENTITY = re.compile("&(?:(amp|apos|gt|lt|quot)|#([0-9]+)|#x([0-9A-Fa-f]+));")
_NAMED = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "quot": '"'}


def unescaped(text: str) -> str:
    return _ENTITY.sub(lambda m: _NAMED[m[1]] if m[1] else chr(int(m[2]) if m[2] else int(m[3], 16)), text)


def docx_text(xml: str) -> str:
    """Text of runs; tabs, breaks and ends of paragraphs as characters."""
    out, at, inside = [], 0, False
    for m in _TAG.finditer(xml):
        if inside:
            out.append(unescaped(xml[at : m.start()]))
        close, name, alone = m.groups()
        if name == "w:t":
            inside = not close and not alone if close or not alone else inside
        elif close:
            out.append("\n" if name == "w:p" else "")
        elif name in ("w:tab", "w:br", "w:cr"):
            out.append("\t" if name == "w:tab" else "\n")
        at = m.end()
    return "".join(out)


def odt_text(xml: str) -> str:
    """Text in paragraphs, headings and list items, with a line end after each paragraph or heading."""
    out, at, depth = [], 0, 0
    for m in _TAG.finditer(xml):
        if depth:
            out.append(unescaped(xml[at : m.start()]))
        close, name, alone = m.groups()
        if name in ("text:p", "text:h", "text:list-item"):
            if close:
                depth = max(0, depth - 1)
            elif not alone:
                depth += 1
            if (close or alone) and name != "text:list-item":
                out.append("\n")
        elif depth and alone and not close and name in ("text:tab", "text:line-break"):
            out.append("\t" if name == "text:tab" else "\n")
        at = m.end()
    return "".join(out)


def ingest_bytes(data: bytes | None, extension: str | None, most: int = MAX_ENTRY) -> dict:
    """One file's result; reasons never quote its content."""
    try:
        if data is None:
            raise Refused("there is no content")
        if extension is None:
            raise Refused("the file name has no extension; txt, md, docx and odt are read")
        if extension in ("txt", "md"):
            found = plain_text(data, extension)
        elif extension in ("docx", "odt"):
            found = office_file(data, extension, most)
        else:
            raise Refused(f"files of the format {extension} aren't read; txt, md, docx and odt are")
        return {"status": "text", "reason": None, **found}
    except Refused as e:
        return {"status": "refused", "text": None, "format": None, "warnings": [], "reason": str(e)}


def ingest(files: DataFrame, *, name_col: str = "path", content_col: str = "content", most: int = MAX_ENTRY) -> DataFrame:
    """`files` with the column `ingested`; at most `most` bytes of an archive's entry are ever inflated."""

    @F.arrow_udf(INGESTED)
    def run(content: pa.Array, extension: pa.Array) -> pa.Array:
        return pa.array([ingest_bytes(c.as_py(), e.as_py(), most) for c, e in zip(content, extension, strict=True)], _KIND)

    return files.withColumn("ingested", run.asNondeterministic()(F.col(content_col), file_extension(F.col(name_col))))


def read_files(spark: SparkSession, path: str, most: int = MAX_ENTRY) -> DataFrame:
    """All files under a path, ingested; contents stay in the executors."""
    return ingest(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), most=most).drop("content")


def from_base64(requests: DataFrame, *, name_col: str = "filename", payload_col: str = "bytes") -> DataFrame:
    """Uploads with a base64 payload, ingested; a payload that isn't base64 is refused."""
    return ingest(requests.withColumn("__content", F.try_to_binary(F.col(payload_col), F.lit("base64"))), name_col=name_col, content_col="__content").drop("__content")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Annotated texts or predictions, a JSON object a line; blank lines are skipped."""
    return spark.read.schema(CORPUS_SCHEMA).json(path)


def write_predictions(docs: DataFrame, path: str, *, id_col: str = "doc_id") -> None:
    """Entities of each document as JSON lines, with types and places but no values."""
    docs.select(F.col(id_col).alias("id"), F.transform("entities", lambda e: F.struct(e["type"].alias("type"), e["start"].alias("start"), e["end"].alias("end"))).alias("entities")).write.json(path)
