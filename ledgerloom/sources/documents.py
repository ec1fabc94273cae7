"""Received files to text: media type, status and text segments, one row per file; nothing that is received raises."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.web import decode_bytes, page_text_of, sniff_of
from ledgerloom.sources.datasets import MAX_ENTRIES, MAX_MEMBER_BYTES, MAX_RATIO

SCHEMA = "content_hash string, media_type string, status string, detail string, text string, segments array<struct<locator:string,text:string>>"
OFFICE = {"word/document.xml": "docx", "xl/workbook.xml": "xlsx", "ppt/presentation.xml": "pptx"}


def _archive(raw: bytes) -> zipfile.ZipFile | tuple[str, str]:
    """The archive if it is safe, else (status, why)."""
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile:
        return "corrupt", "bad archive"
    members = z.infolist()
    if any(m.flag_bits & 1 for m in members):
        return "encrypted", "encrypted archive"
    for m in members:
        if m.filename.startswith(("/", "\\")) or ".." in re.split(r"[\\/]", m.filename):
            return "quarantined", "path leads out of the archive"
        if (m.external_attr >> 16) & 0o170000 == 0o120000:
            return "quarantined", "link in the archive"
    if len(members) > MAX_ENTRIES or sum(m.file_size for m in members) > MAX_MEMBER_BYTES:
        return "quarantined", "archive too large"
    if any(m.file_size > MAX_RATIO * max(m.compress_size, 1) and m.file_size > 1 << 20 for m in members):
        return "quarantined", "compression ratio"
    return z


def _texts(xml: bytes, unit: str, leaf: str) -> list[str]:
    """Text of the leaves below each unit, by local tag name."""
    name = lambda e: e.tag.rpartition("}")[2]
    out = ["".join(x.text or "" for x in p.iter() if name(x) == leaf) for p in ElementTree.fromstring(xml).iter() if name(p) == unit]
    return [t for t in out if t.strip()]


def _number(path: str) -> int:
    return int((re.findall(r"\d+", path) or ["0"])[-1])


def _office(z: zipfile.ZipFile, kind: str) -> list[tuple[str, str]]:
    names = z.namelist()
    if kind == "docx":
        return [(f"paragraph {i}", t) for i, t in enumerate(_texts(z.read("word/document.xml"), "p", "t"), 1)]
    if kind == "pptx":
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)
        return [(f"slide {_number(n)}", "\n".join(_texts(z.read(n), "p", "t"))) for n in slides]
    shared = _texts_all(z.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else []
    out = []
    for sheet in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number):
        for row in (e for e in ElementTree.fromstring(z.read(sheet)).iter() if e.tag.endswith("}row")):
            cells = []
            for c in row:
                value = next((x.text for x in c.iter() if x.tag.endswith(("}v", "}t"))), None)
                if value is not None:
                    cells.append(f"{c.get('r')}={shared[int(value)] if c.get('t') == 's' else value}")
            if cells:
                out.append((f"sheet {_number(sheet)} row {row.get('r')}", "\t".join(cells)))
    return out


def _texts_all(xml: bytes) -> list[str]:
    return ["".join(x.text or "" for x in si.iter() if x.tag.endswith("}t")) for si in ElementTree.fromstring(xml).iter() if si.tag.endswith("}si")]


def process(raw: bytes, declared: str | None = None, filename: str | None = None) -> tuple[str, str, str | None, str, list[tuple[str, str]]]:
    """(media type, status, detail, text, segments). Status: succeeded, partial, unsupported, encrypted, corrupt, quarantined."""
    media = sniff_of(raw, declared, filename)
    try:
        if media == "application/zip":
            z = _archive(raw)
            if isinstance(z, tuple):
                return media, z[0], z[1], "", []
            kind = next((k for member, k in OFFICE.items() if member in z.namelist()), None)
            if kind is None:
                return media, "unsupported", "archive", "", []
            media = kind
            segments = _office(z, kind)
        elif media == "application/pdf":
            return media, "encrypted" if b"/Encrypt" in raw else "unsupported", "parser_unavailable", "", []
        elif media.startswith("image/"):
            return media, "unsupported", "parser_unavailable", "", []
        else:
            text, _ = decode_bytes(raw, declared)
            if media == "text/html":
                segments = [("page", page_text_of(text) or "")]
            elif media == "application/json":
                segments = [("document", json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True))]
            elif media == "text/csv":
                segments = [(f"row {i}", "\t".join(r)) for i, r in enumerate(csv.reader(io.StringIO(text)), 1) if r]
            elif media in ("application/xml", "text/xml"):
                segments = [("document", " ".join(" ".join(ElementTree.fromstring(text).itertext()).split()))]
            elif media.startswith("text/") or media == "application/x-ndjson":
                segments = [("document", text)]
            else:
                return media, "unsupported", "media type", "", []
    except (ValueError, KeyError, IndexError, ElementTree.ParseError, zipfile.BadZipFile, csv.Error) as e:
        return media, "corrupt", type(e).__name__, "", []
    text = "\n".join(t for _, t in segments)
    return media, "succeeded", None, text, segments


def processed(files: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """One row per distinct content of ``files`` (content, and content_type and filename if known) that ``done`` lacks."""
    for c in ("content_type", "filename"):
        if c not in files.columns:
            files = files.withColumn(c, F.lit(None).cast("string"))
    todo = files.withColumn("content_hash", F.sha2("content", 256)).dropDuplicates(["content_hash"])
    if done is not None:
        todo = todo.join(done.select("content_hash"), "content_hash", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [(h, *process(bytes(c or b""), t, n)) for h, c, t, n in zip(df["content_hash"], df["content"], df["content_type"], df["filename"])]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return todo.select("content_hash", "content", "content_type", "filename").mapInPandas(run, SCHEMA)


def response_filename(disposition: str | None, url: str | None) -> str | None:
    """File name of a response: from its Content-Disposition, else the last part of the path."""
    m = re.search(r"filename\*=(?:UTF-8'')?([^;]+)|filename=\"?([^\";]+)", disposition or "", re.I)
    name = unquote(m[1]) if m and m[1] else m[2] if m else unquote(urlsplit(url or "").path)
    return posixpath.basename(name.replace("\\", "/").strip().strip('"')) or None


def sitemap_urls(xml: str) -> tuple[list[str], list[str]]:
    """(page URLs, nested sitemaps) of a sitemap; both empty if it cannot be read."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return [], []
    found = [(e.text or "").strip() for e in root.iter() if e.tag.rpartition("}")[2] == "loc"]
    return ([], found) if root.tag.endswith("sitemapindex") else (found, [])
