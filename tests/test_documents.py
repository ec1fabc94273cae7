import io
import zipfile

import pytest

from ledgerloom.sources import documents as docs

W = '<w:document xmlns:w="x"><w:p><w:r><w:t>Hello </w:t><w:t>there</w:t></w:r></w:p><w:p/></w:document>'
SHEET = '<s xmlns="y"><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2.5</v></c></row></s>'
SLIDE = '<p:s xmlns:p="z"><a:p xmlns:a="q"><a:t>Slide</a:t></a:p></p:s>'


def archive(**members) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), data)
    return out.getvalue()


@pytest.mark.parametrize("raw, declared, name, want", [
    (archive(word__document_xml=W), None, None, ("docx", "succeeded", "Hello there")),
    (archive(xl__workbook_xml="<w/>", xl__sharedStrings_xml='<s xmlns="y"><si><t>Key</t></si></s>', xl__worksheets__sheet1_xml=SHEET), None, None, ("xlsx", "succeeded", "A1=Key\tB1=2.5")),
    (archive(ppt__presentation_xml="<w/>", ppt__slides__slide1_xml=SLIDE), None, None, ("pptx", "succeeded", "Slide")),
    (archive(a="x"), None, None, ("application/zip", "unsupported", "")), (archive(**{"..__a": "x"}), None, None, ("application/zip", "quarantined", "")),
    (archive(a=b"0" * (2 << 20)), None, None, ("application/zip", "quarantined", "")), (b"PK\x03\x04nope", None, None, ("application/zip", "corrupt", "")),
    (archive(word__document_xml="<broken"), None, None, ("docx", "corrupt", "")), (b"%PDF-1.4", None, None, ("application/pdf", "unsupported", "")),
    (b"%PDF-1.4 /Encrypt", None, None, ("application/pdf", "encrypted", "")), (b"\x89PNG", None, None, ("image/png", "unsupported", "")), (b"", None, None, ("application/octet-stream", "unsupported", "")),
    (b'{"b": 1, "a": 2}', "application/json", None, ("application/json", "succeeded", '{"a": 2, "b": 1}')), (b"{", "application/json", None, ("application/json", "corrupt", "")),
    (b"a,b\n1,2\n", None, "x.csv", ("text/csv", "succeeded", "a\tb\n1\t2")), (b"<?xml version='1.0'?><a>x <b>y</b></a>", None, None, ("application/xml", "succeeded", "x y")),
    ("é".encode("cp1252"), "text/plain", None, ("text/plain", "succeeded", "é"))])
def test_process(raw, declared, name, want):
    got = docs.process(raw, declared, name)
    assert (got[0], got[1], got[3]) == want


def test_processed(spark):
    files = spark.createDataFrame([(bytearray(b"<html><p>Hi</p>"),), (bytearray(b"<html><p>Hi</p>"),), (bytearray(b"text"),), (None,)], "content binary")
    done = docs.processed(files)
    assert sorted((r["media_type"], r["status"]) for r in done.collect()) == [("application/octet-stream", "unsupported"), ("text/html", "succeeded"), ("text/plain", "succeeded")]
    assert docs.processed(files.where("content is not null"), done).count() == 0


def test_names_and_sitemaps():
    assert docs.response_filename('attachment; filename="a b.pdf"', "https://x/y") == "a b.pdf" and docs.response_filename(None, "https://x/d/f%20g.csv?q") == "f g.csv"
    assert docs.response_filename("attachment; filename*=UTF-8''%C3%A9.txt", None) == "é.txt" and docs.response_filename(None, "https://x/") is None
    assert docs.sitemap_urls('<urlset xmlns="s"><url><loc> https://x/a </loc></url></urlset>') == (["https://x/a"], [])
    assert docs.sitemap_urls('<sitemapindex><sitemap><loc>https://x/s</loc></sitemap></sitemapindex>') == ([], ["https://x/s"]) and docs.sitemap_urls("<") == ([], [])
