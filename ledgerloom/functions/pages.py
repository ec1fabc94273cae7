"""Signals on pages of organisations: addresses, identifiers, phrases, metadata, forms, and what to do with their references."""

from __future__ import annotations

import re
import struct
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import LEGAL_SUFFIXES

# Digits of identifiers, words of streets, states, words of contact forms, media types with text, and the patterns of
# identifiers, addresses and phrases of work done in house.
IDENTIFIER_DIGITS = {"abn": 11, "acn": 9, "nzbn": 13}
STREET_WORDS = ("Street", "St", "Road", "Rd", "Avenue", "Ave", "Drive", "Dr", "Court", "Ct", "Place", "Pl", "Parade", "Pde", "Highway", "Hwy", "Way", "Crescent", "Cres", "Boulevard", "Blvd",
                "Circuit", "Cct", "Lane", "Ln", "Terrace", "Tce")
STATES = ("NSW", "QLD", "VIC", "WA", "SA", "TAS", "NT", "ACT")
IN_HOUSE = r"(?i)(in[\s-]?house\s+(?:scaffold\s+)?(?:design|draft\w*|engineer\w*)|our\s+(?:design|drafting|engineering)\s+(?:team|department|office)|our\s+(?:in[\s-]?house\s+)?(?:designers|drafters|draftsmen|engineers)\b)"
FORM_WORDS = ("contact", "enquir", "quote", "estimate")
TEXT_TYPES = r"(?i)html|xml|text|json|rss|atom"
IDENTIFIER = r"(?i)\b((?:ABN|ACN|NZBN)\s*(?:No\.?\s*)?[:#]?\s*(?:\d[\s.-]?){8,14}\d)\b"
ADDRESS = (rf"(?i)(\d+[\w\-/]*\s+[A-Za-z][A-Za-z\s']{{2,40}}?(?:{'|'.join(STREET_WORDS)}))\.?,?\s+([A-Za-z][A-Za-z\s']{{2,30}}?),?\s+({'|'.join(STATES)})\s*,?\s*(\d{{4}})")
#: Pages by what a profile may lack, as parts of a link's address or text; the more telling first.
SUBPAGES = {"public_contact_route": ("contact", "enquir"), "specific_location": ("contact", "location", "office"), "business_description": ("about", "who-we-are", "company"),
            "evidenced_relevance": ("service", "capabilit", "project")}


def identifiers_in(text: Column) -> Column:
    """(scheme, value) of the identifiers named in a text that have the digits their scheme asks for, distinct and sorted."""
    found = F.regexp_extract_all(text, F.lit(IDENTIFIER), 1)
    pairs = F.transform(found, lambda x: F.struct(F.lower(F.regexp_extract(x, "^([A-Za-z]+)", 1)).alias("scheme"), F.regexp_replace(x, r"\D", "").alias("value")))
    fits = lambda p: F.coalesce(*[F.when(p["scheme"] == s, F.length(p["value"]) == n) for s, n in IDENTIFIER_DIGITS.items()], F.lit(False))
    return F.array_sort(F.array_distinct(F.filter(pairs, fits)))


def addresses_in(text: Column) -> Column:
    """(street, locality, state, postcode) of the postal addresses in a text, one per street and postcode, the first writing kept."""
    part = lambda i: F.regexp_extract_all(text, F.lit(ADDRESS), i)
    rows = F.arrays_zip(part(1).alias("street"), part(2).alias("locality"), part(3).alias("state"), part(4).alias("postcode"))
    clean = F.transform(rows, lambda r: F.struct(F.trim(r["street"]).alias("street"), F.initcap(F.trim(r["locality"])).alias("locality"), F.upper(r["state"]).alias("state"), r["postcode"].alias("postcode")))
    key = lambda r: F.concat_ws("|", F.lower(r["street"]), r["postcode"])
    return F.filter(clean, lambda r, i: (i == 0) | ~F.array_contains(F.transform(F.slice(clean, F.lit(1), i), key), key(r)))


def in_house_phrases(text: Column) -> Column:
    """Phrases that tell of work done in house, one per wording whatever its case, in order."""
    return first_spellings(F.regexp_extract_all(text, F.lit(IN_HOUSE), 1))


def first_spellings(values: Column) -> Column:
    """Distinct values whatever their case, each in its first spelling and place."""
    low = F.transform(values, F.lower)
    return F.filter(values, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def split_urls(value: Column) -> Column:
    """Distinct trimmed parts between pipes and line breaks, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(value, r"[|\r\n]+"), lambda p: F.trim(p)), lambda p: p != ""))


def distillable(content_type: Column) -> Column:
    return F.coalesce(content_type.rlike(TEXT_TYPES), F.lit(False))


def published_time(value: str | None) -> datetime | None:
    """An ISO or mail date with a time zone; without one it tells no time."""
    for read in (lambda v: datetime.fromisoformat(v.strip().replace("Z", "+00:00")), parsedate_to_datetime):
        try:
            at = read(value or "")
        except (ValueError, TypeError, IndexError):
            continue
        return at.astimezone(UTC) if at and at.tzinfo else None
    return None


def legal_name_in(text: str | None, name: str | None) -> str | None:
    """The name as a text writes it with a legal suffix, if its words are those of the known name."""
    words = [w for w in re.findall(r"[a-z0-9]+", (name or "").lower())]
    while len(words) > 1 and words[-1] in LEGAL_SUFFIXES:
        words.pop()
    if not words or not text:
        return None
    m = re.search(r"\b(" + r"[\s&.,'()/-]+".join(map(re.escape, words)) + r"[\s,]*(?:Pty\s+(?:Ltd|Limited)|NZ\s+Limited|Limited|Ltd))\b", text, re.I)
    return " ".join(m[1].split()) if m else None


@F.pandas_udf(T.StringType())
def legal_name_on(text: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([legal_name_in(t, n) for t, n in zip(text, name)])


class _Metadata(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.descriptions: dict[str, str] = {}
        self.links: list[list] = []
        self.form, self.text, self.open, self.skip = False, [], None, 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self.skip += tag in ("script", "style")
        if tag == "meta":
            for kind, name in (("name", "description"), ("property", "og:description")):
                if a.get(kind, "").lower() == name:
                    self.descriptions.setdefault(name, a.get("content", "").strip())
        elif tag == "a" and a.get("href"):
            self.open = [a["href"], ""]
            self.links.append(self.open)
        self.form |= tag == "form"

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag == "a":
            self.open = None

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
            if self.open is not None:
                self.open[1] += data


def page_metadata_of(html: str | None, url: str | None) -> tuple[str | None, str | None, list[tuple[str, str]]]:
    """(description, contact form URL, links): the page's description of 30 to 1000 characters, the page itself if it holds a
    form to get in touch by, and its distinct links with their text."""
    page = _Metadata()
    page.feed(html or "")
    page.close()
    text = next((" ".join(d.split()) for d in (page.descriptions.get(k, "") for k in ("description", "og:description")) if 30 <= len(d) <= 1000), None)
    links: dict[str, str] = {}
    for raw, label in page.links:
        try:
            target = urljoin(url or "", raw).split("#")[0]
            parts = urlsplit(target)
        except ValueError:
            continue
        if parts.scheme in ("http", "https") and parts.netloc:
            links.setdefault(target, " ".join(label.split())[:300])
    about = (urlsplit(url or "").path + " " + "".join(page.text)).casefold()
    return text, url if page.form and any(w in about for w in FORM_WORDS) else None, list(links.items())


_LINK = T.StructType([T.StructField("url", T.StringType()), T.StructField("label", T.StringType())])


@F.pandas_udf(T.StructType([T.StructField("description", T.StringType()), T.StructField("contact_form_url", T.StringType()), T.StructField("links", T.ArrayType(_LINK))]))
def page_metadata(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_metadata_of(h, u) for h, u in zip(html, url)], columns=["description", "contact_form_url", "links"])


def ranked_subpages(links: DataFrame, missing: DataFrame, most: int = 4) -> DataFrame:
    """``(page_id, url, rank)``: of each page's links (page_id, ordinal, url, label) those that may tell what is missing (page_id,
    need), the most telling first, then in the page's order; at most ``most``, a crawl's budget."""
    needs = [(n, w, i) for n, words in SUBPAGES.items() for i, w in enumerate(words)]
    asked = missing.join(F.broadcast(missing.sparkSession.createDataFrame(needs, "need string, word string, weight int")), "need")  # a dozen rows
    rows = links.join(asked, "page_id").where(F.lower(F.concat_ws(" ", "url", "label")).contains(F.col("word"))).groupBy("page_id", "url").agg(F.min("weight").alias("weight"), F.min("ordinal").alias("ordinal"))
    w = Window.partitionBy("page_id").orderBy("weight", "ordinal")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("page_id", "url", "rank")


def reference_decisions(references: DataFrame, known: DataFrame, depth: int = 2, external: bool = False) -> DataFrame:
    """``references`` (source_id, url, kind, host, depth, allowed_hosts) with what a crawl does with each: known, depth_limit, queued,
    or outside its hosts known_external, source_proposed or external_not_fetched; repeats of a URL in a source are known."""
    had = known.select("source_id", "url", F.lit(True).alias("had")).distinct()
    everywhere = known.select("url", F.lit(True).alias("elsewhere")).distinct()
    first = F.row_number().over(Window.partitionBy("source_id", "url").orderBy("depth", "ordinal"))
    rows = references.withColumn("k", first).join(had, ["source_id", "url"], "left").join(everywhere, "url", "left")
    inside = F.exists("allowed_hosts", lambda h: (F.col("host") == h) | F.col("host").endswith(F.concat(F.lit("."), h)))
    decision = (F.when(F.coalesce("had", F.lit(False)) | (F.col("k") > 1), "known").when(inside & (F.col("depth") > depth), "depth_limit").when(inside, "queued")
                .when(F.coalesce("elsewhere", F.lit(False)), "known_external").when(F.lit(external), "source_proposed").otherwise("external_not_fetched"))
    return rows.withColumn("decision", decision).drop("k", "had", "elsewhere")


def proposed_sources(decisions: DataFrame, most: int = 10) -> DataFrame:
    """``(source_id, host, url, found_on, rank)``: external hosts a source points at, once each with its first reference; at most ``most`` per
    source, the crawl's budget of domains."""
    rows = decisions.where("decision = 'source_proposed'").groupBy("source_id", "host").agg(F.min(F.struct("ordinal", "url", "found_on")).alias("f"))
    w = Window.partitionBy("source_id").orderBy("f", "host")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("source_id", "host", "f.url", "f.found_on", "rank")


def child_documents(references: DataFrame, documents: DataFrame) -> DataFrame:
    """References without a child document get that of their source and URL, if it was fetched."""
    one = documents.groupBy("source_id", "url").agg(F.min("document_id").alias("__child"))
    return references.join(one, ["source_id", "url"], "left").withColumn("child_id", F.coalesce("child_id", "__child")).drop("__child")


def image_of(raw: bytes | None, most_pixels: int = 40_000_000) -> tuple[str, str | None, int | None, int | None]:
    """(status, format, width, height) read from an image's header: succeeded, quarantined beyond the pixel limit, corrupt or unsupported."""
    raw = raw or b""
    try:
        if raw.startswith(b"\x89PNG\r\n\x1a\n"):
            kind, size = "png", struct.unpack(">II", raw[16:24])
        elif raw[:6] in (b"GIF87a", b"GIF89a"):
            kind, size = "gif", struct.unpack("<HH", raw[6:10])
        elif raw.startswith(b"BM"):
            kind, size = "bmp", tuple(map(abs, struct.unpack("<ii", raw[18:26])))
        elif raw.startswith(b"\xff\xd8"):
            kind, at, size = "jpeg", 2, None
            while size is None:
                mark, length = struct.unpack(">HH", raw[at:at + 4])
                if 0xFFC0 <= mark <= 0xFFCF and mark not in (0xFFC4, 0xFFC8, 0xFFCC):
                    size = struct.unpack(">HH", raw[at + 5:at + 9])[::-1]
                at += 2 + length
        else:
            return "unsupported", None, None, None
    except struct.error:
        return "corrupt", None, None, None
    width, height = size
    return "corrupt" if not width or not height else "quarantined" if width * height > most_pixels else "succeeded", kind, width, height


@F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("format", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def image_header(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([image_of(bytes(c) if c is not None else None) for c in content], columns=["status", "format", "width", "height"])


