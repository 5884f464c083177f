"""Fetched bodies: kind by declared type or first bytes, hashes, character sets, DOCX and PDF text."""

from __future__ import annotations

import codecs
import io
import re
import zipfile
import zlib
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

HTML, PDF, DOCX, UNKNOWN = "html", "pdf", "docx", "unknown"
GENERIC = ("application/octet-stream", "application/x-zip-compressed", "application/zip", "text/plain")
HEADS = ("<!doctype html", "<html", "<head", "<body", "<!--")


def declared_kind(content_type: Column) -> Column:
    t = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(F.contains(t, F.lit("pdf")), PDF).when(F.contains(t, F.lit("wordprocessingml")), DOCX).when(t.isin("text/html", "application/xhtml+xml"), HTML).otherwise(UNKNOWN)


def type_welcome(content_type: Column) -> Column:
    """Whether a body of this type may be worth reading: none declared, a known kind, or one that says nothing."""
    bare = F.btrim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1)))
    return (F.coalesce(content_type, F.lit("")) == "") | (declared_kind(bare) != UNKNOWN) | F.lower(bare).isin(*GENERIC)


def _hex(body: Column, n: int) -> Column:
    return F.hex(F.substring(body, 1, n))


def looks_like_html(body: Column) -> Column:
    """Begins with an HTML start, after a byte order mark and white space."""
    starts = "|".join(h.encode().hex() if not h[1].isalpha() else "".join(f"(?:{c:02x}|{ord(chr(c).upper()):02x})" for c in h.encode()) for h in HEADS[1:])
    doctype = "".join(f"(?:{ord(c):02x}|{ord(c.upper()):02x})" for c in HEADS[0])
    return F.regexp_like(F.lower(F.hex(body)), F.lit(f"^(?:efbbbf)?(?:20|09|0a|0d|0c)*(?:{doctype}|{starts})"))


@F.arrow_udf(BooleanType())
def zip_is_word(body: pa.Array) -> pa.Array:
    return pa.array([_is_word(b) for b in body.to_pylist()], pa.bool_())


def _is_word(body: bytes | None) -> bool:
    try:
        with zipfile.ZipFile(io.BytesIO(body or b"")) as z:
            return "word/document.xml" in z.namelist()
    except (zipfile.BadZipFile, ValueError, OSError):
        return False


def sniff(body: Column) -> Column:
    """Kind by the first bytes alone."""
    zipped = _hex(body, 4) == "504B0304"
    return F.when(_hex(body, 5) == "255044462D", PDF).when(zipped & zip_is_word(F.when(zipped, body)), DOCX).when(looks_like_html(F.substring(body, 1, 8192)), HTML).otherwise(UNKNOWN)


def classify(content_type: Column, body: Column) -> Column:
    """The declared kind if it is known, else that of the bytes."""
    told = declared_kind(content_type)
    return F.when(told != UNKNOWN, told).otherwise(F.coalesce(sniff(body), F.lit(UNKNOWN)))


def prefix_supported(body: Column, content_type: Column, url: Column) -> Column:
    """Whether what has been read so far may become a document. A ZIP whose URL names another extension than .docx is none."""
    ext = F.lower(F.regexp_extract(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"(\.[^./]+)$", 1))
    return F.coalesce(
        (declared_kind(content_type) != UNKNOWN) | (_hex(body, 5) == "255044462D") | ((_hex(body, 4) == "504B0304") & F.coalesce(ext, F.lit("")).isin("", ".docx")) | looks_like_html(F.substring(body, 1, 8192)),
        F.lit(False),
    )


def content_hash(body: Column) -> Column:
    return F.upper(F.sha2(body, 256))


META = re.compile(rb"<meta[^>]+?charset\s*=\s*[\"']?\s*([A-Za-z0-9_\-:.]+)", re.I)
BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
#: Names that browsers read as windows-1252.
_WEB = {"iso-8859-1": "cp1252", "latin-1": "cp1252", "latin1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252"}


def _codec(name: str | None) -> str | None:
    name = (name or "").strip().strip("\"'").lower()
    try:
        return codecs.lookup(_WEB.get(name, name)).name if name else None
    except LookupError:
        return None


def decode(body: bytes | None, charset: str | None = None) -> str:
    """Text of a page: by the response's charset, else the byte order mark, else the page's own word (unless that is
    UTF-16 or 32, which it can't be), else UTF-8. Bytes that don't fit become replacement characters."""
    body = body or b""
    bom = next(((b, n) for b, n in BOMS if body.startswith(b)), None)
    name = _codec(charset)
    if name is None and bom:
        name = bom[1]
    if name is None:
        m = META.search(body)
        told = _codec(m[1].decode("ascii")) if m else None
        name = told if told and not told.startswith(("utf-16", "utf-32")) else "utf-8"
    return (body[len(bom[0]) :] if bom and bom[1].startswith(name[:6]) else body).decode(name, "replace")


def collapse(text: str) -> str:
    return " ".join(x for x in re.split("[ \n\r\t]+", text) if x)


def clean_title(title: str | None) -> str | None:
    return collapse(title or "") or None if (title or "").strip() else None


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extract_docx(body: bytes) -> tuple[str | None, str]:
    """Title of the core properties, and the text; raises on what is no DOCX."""
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        title = None
        if "docProps/core.xml" in z.namelist():
            title = ElementTree.fromstring(z.read("docProps/core.xml")).findtext("{http://purl.org/dc/elements/1.1/}title")
    out: list[str] = []
    for e in root.iter():
        if e.tag == _W + "t":
            out.append(e.text or "")
        elif e.tag in (_W + "p", _W + "br", _W + "cr"):
            out.append("\n")
        elif e.tag in (_W + "tab", _W + "tc"):
            out.append("\t")
    return clean_title(title), collapse("".join(out))


_SHOW = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\")|\[(?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\]()<>])*\]\s*TJ|<([0-9A-Fa-f\s]+)>\s*Tj|\bT(?:[dDm]\b|\*)|\bET\b", re.S)
_LITERAL = re.compile(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]*)>", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)


def _pdf_string(raw: bytes) -> str:
    plain = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"\n": b"", b"\r\n": b""}.get(m[1], m[1]), raw)
    return plain[2:].decode("utf-16-be", "replace") if plain.startswith(codecs.BOM_UTF16_BE) else plain.decode("cp1252", "replace")


def extract_pdf(body: bytes) -> tuple[str | None, str]:
    """Title and text of plain PDFs: streams that are bare or deflated, fonts of one byte a character. Others need a PDF
    library: give one to extract() as `pdf`."""
    title = re.search(rb"/Title\s*\(((?:\\.|[^\\()])*)\)", body, re.S)
    out: list[str] = []
    for m in re.finditer(rb"<<(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*>>\s*stream\r?\n(.*?)\r?\n?endstream", body, re.S):
        data = m[1]
        if b"/FlateDecode" in m[0][: m.start(1) - m.start()]:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        if b"BT" not in data:
            continue
        for s in _SHOW.finditer(data):
            if not s[0].endswith((b"Tj", b"TJ", b"'", b'"')):
                out.append(" ")
            else:
                out += [_pdf_string(x[1]) if x[1] is not None else bytes.fromhex((y := re.sub(rb"\s", b"", x[2]).decode()) + "0" * (len(y) % 2)).decode("cp1252", "replace") for x in _LITERAL.finditer(s[0])]
        out.append(" ")
    return clean_title(_pdf_string(title[1])) if title else None, collapse("".join(out))


Extractor = Callable[[bytes], tuple[str | None, str]]
