"""URLs, HTML and page text: canonical forms, references, signals, dates, media types. Vectorised Python over Arrow
batches where a parser is needed, built-in expressions elsewhere."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from urllib.parse import parse_qsl, unquote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
DROPPED_TAGS = {"script", "style", "noscript", "template", "svg", "nav", "footer", "header", "aside", "form", "iframe", "button", "select"}
BLOCK_TAGS = {"p", "div", "section", "article", "li", "ul", "ol", "tr", "table", "br", "h1", "h2", "h3", "h4", "h5", "h6", "main", "title"}
DOCUMENT_ENDINGS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".csv", ".zip", ".rtf", ".odt")
PLATFORMS = {
    "facebook": "facebook.com", "instagram": "instagram.com", "linkedin": "linkedin.com", "youtube": "youtube.com", "tiktok": "tiktok.com",
    "x": "x.com", "threads": "threads.net", "pinterest": "pinterest.com", "reddit": "reddit.com"}
OTHER_HOSTS = {"fb.com": "facebook.com", "twitter.com": "x.com"}
RESERVED_HANDLES = {
    "about", "accounts", "ads", "business", "developers", "directory", "events", "explore", "groups", "hashtag", "help", "home", "intent", "login",
    "marketplace", "messages", "notifications", "p", "pages", "privacy", "reel", "search", "share", "sharer", "signup", "status", "terms", "watch"}
#: Paths of an organisation's profile by platform, the first that fits counting, and what they are written as.
PROFILE_PATHS = {
    "linkedin": [(r"/(?P<kind>company|school|showcase)/(?P<name>[^/]+)", "/{kind}/{name}")], "reddit": [(r"/(?P<kind>r)/(?P<name>[^/]+)", "/{kind}/{name}")],
    "youtube": [(r"/@(?P<name>[^/]+)", "/@{name}"), (r"/(?P<kind>channel|c|user)/(?P<raw>[^/]+)", "/{kind}/{raw}")],
    "tiktok": [(r"/@(?P<name>[^/]+)", "/@{name}")], "threads": [(r"/@(?P<name>[^/]+)", "/@{name}")], "": [(r"/@?(?P<name>[^/]+)", "/{name}")]}
#: How the path of a bare handle is made.
HANDLE_PATHS = {"linkedin": "/company/{}", "reddit": "/r/{}", "youtube": "/@{}", "tiktok": "/@{}", "threads": "/@{}"}
DATE_NAMES = {"article:published_time", "datepublished", "dc.date", "dc.date.issued", "pubdate", "date", "parsely-pub-date"}


def canonical_url_of(value: str | None) -> str | None:
    """http(s) URL with lower-case scheme and IDNA host, no default port, fragment or final slash, parameters sorted;
    null for other schemes, credentials, and what cannot be read."""
    if not isinstance(value, str):
        return None
    try:
        parts = urlsplit(value.strip())
        host, port = parts.hostname, parts.port
        if parts.scheme.lower() not in ("http", "https") or not host or parts.username or parts.password:
            return None
        host = host.rstrip(".").encode("idna").decode().lower()
    except (ValueError, UnicodeError):
        return None
    scheme = parts.scheme.lower()
    net = host if port in (None, 80 if scheme == "http" else 443) else f"{host}:{port}"
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return urlunsplit((scheme, net, parts.path.rstrip("/"), query, ""))


def social_profile_of(value: str | None, expected: str | None = None) -> tuple[str, str] | None:
    """(platform, profile URL) of an address of an organisation's profile, else None; where a platform is expected, a bare handle
    will do, and addresses of other platforms are none."""
    if not isinstance(value, str) or not value.strip():
        return None
    raw, platform = value.strip(), (expected or "").strip().lower()
    if platform and platform not in PLATFORMS:
        return None
    if "://" not in raw:
        host = raw.split("/")[0].lower()
        known = re.sub(r"^(www|m)\.", "", host) in {*PLATFORMS.values(), *OTHER_HOSTS}
        bare = re.sub(r"^(@|r/(?=.))", "", raw.strip("/"))
        raw = f"https://{raw}" if known or not platform else f"https://{PLATFORMS[platform]}{HANDLE_PATHS.get(platform, '/{}').format(bare)}"
    try:
        parts = urlsplit(raw)
        host = re.sub(r"^(www|m)\.", "", (parts.hostname or "").lower())
    except ValueError:
        return None
    host = OTHER_HOSTS.get(host, host)
    found = next((p for p, h in PLATFORMS.items() if h == host), None)
    if parts.scheme.lower() not in ("http", "https") or parts.username or parts.password or not found or (platform and platform != found):
        return None
    if found == "facebook" and re.match(r"/profile\.php/?$", parts.path):
        number = dict(parse_qsl(parts.query)).get("id", "").strip()
        return (found, f"https://{host}/profile.php?{urlencode({'id': number})}") if number else None
    for pattern, shape in PROFILE_PATHS.get(found, PROFILE_PATHS[""]):
        m = re.match(pattern, re.sub("/+", "/", parts.path), re.I)
        if m:
            bits = {k: v if k == "raw" else v.lower() for k, v in m.groupdict().items()}
            return None if found not in ("linkedin", "reddit") and bits.get("name") in RESERVED_HANDLES else (found, f"https://{host}{shape.format(**bits)}")
    return None


class _Page(HTMLParser):
    """One walk over a page: text, title, links in order with the heading before them, images, dates, description."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.text, self.title, self.in_title = 0, [], [], False
        self.heading, self.in_heading, self.base = "", None, None
        self.refs: list[tuple[str, str, str]] = []
        self.dates: list[str] = []
        self.description: dict[str, str] = {}
        self.anchor: list | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in DROPPED_TAGS:
            self.skip += tag not in ("button",) or 1
        if tag == "base" and self.base is None:
            self.base = a.get("href")
        elif tag == "title":
            self.in_title = True
        elif re.fullmatch("h[1-6]", tag):
            self.in_heading = []
        elif tag == "a" and a.get("href"):
            self.anchor = [a["href"], []]
        elif tag == "img" and (a.get("src") or a.get("srcset")):
            self.refs.append(("image", best_image(a.get("srcset", "")) or a.get("src", ""), self.heading))
        elif tag == "time" and a.get("datetime"):
            self.dates.append(a["datetime"])
        elif tag == "meta":
            name = (a.get("name") or a.get("property") or a.get("itemprop") or "").lower()
            if name in DATE_NAMES:
                self.dates.append(a.get("content", ""))
            if name in ("description", "og:description"):
                self.description.setdefault(name, a.get("content", ""))
        if tag in BLOCK_TAGS:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in DROPPED_TAGS and self.skip:
            self.skip -= 1
        if tag == "title":
            self.in_title = False
        elif re.fullmatch("h[1-6]", tag) and self.in_heading is not None:
            self.heading, self.in_heading = " ".join("".join(self.in_heading).split()), None
        elif tag == "a" and self.anchor:
            self.refs.append(("link", self.anchor[0], self.heading))
            self.anchor = None
        if tag in BLOCK_TAGS:
            self.text.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            self.text.append(data)
        if self.in_heading is not None:
            self.in_heading.append(data)


def best_image(srcset: str) -> str:
    """The candidate with the greatest width, else density, of a srcset."""
    best, top = "", (-1, 0.0)
    for part in re.split(r",\s+", srcset.strip()):
        bits = part.split()
        if not bits:
            continue
        m = re.fullmatch(r"([\d.]+)([wx])", bits[1]) if len(bits) > 1 else None
        score = (2 if m[2] == "w" else 1, float(m[1])) if m else (0, 1.0)
        if score > top:
            best, top = bits[0], score
    return best


def _parsed(html: str | None) -> _Page:
    page = _Page()
    if isinstance(html, str):
        page.feed(html)
        page.close()
    return page


def page_text_of(html: str | None) -> str | None:
    """Readable text: boilerplate elements dropped, title as a heading, blanks and empty lines folded."""
    if not isinstance(html, str):
        return None
    page = _parsed(html)
    lines = [" ".join(x.split()) for x in "".join(page.text).split("\n")]
    title = " ".join("".join(page.title).split())
    return "\n".join(([f"# {title}"] if title else []) + [x for x in lines if x])


def references_of(base_url: str | None, html: str | None, images: int = 12) -> list[tuple[int, str, str, str]]:
    """(ordinal, kind, URL, heading before it) of the distinct safe references, in order; at most ``images`` images."""
    page, out, seen, pictures = _parsed(html), [], set(), 0
    base = urljoin(base_url or "", page.base or "") or base_url or ""
    for kind, raw, heading in page.refs:
        url = canonical_url_of(urljoin(base, raw.strip()))
        if not url or url in seen:
            continue
        if kind == "link":
            where = [urlsplit(url).path, *[v for _, v in parse_qsl(urlsplit(url).query)]]
            kind = "document" if any(unquote(w).lower().endswith(DOCUMENT_ENDINGS) for w in where) else "navigation"
        elif pictures >= images:
            continue
        pictures += kind == "image"
        seen.add(url)
        out.append((len(out), kind, url, heading))
    return out


def published_of(html: str | None) -> datetime | None:
    """The earliest claimed publication time that names its time zone."""
    found = []
    raw = [*(_parsed(html).dates if isinstance(html, str) else []), *re.findall(r'"(?:datePublished|uploadDate)"\s*:\s*"([^"]+)"', html or "")]
    for value in raw:
        try:
            at = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
        except ValueError:
            try:
                at = parsedate_to_datetime(value)
            except (ValueError, TypeError):
                continue
        if at.tzinfo is not None:
            found.append(at.astimezone(UTC))
    return min(found, default=None)


def sniff_of(raw: bytes | None, declared: str | None = None, filename: str | None = None) -> str:
    """Media type by magic bytes, then markup, then what is declared, the file's ending, and whether it reads as text."""
    raw = raw or b""
    for magic, kind in ((b"%PDF-", "application/pdf"), (b"\x89PNG", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"PK\x03\x04", "application/zip")):
        if raw.startswith(magic):
            return kind
    head = raw[:512].lstrip(b"\xef\xbb\xbf \r\n\t").lower()
    if head.startswith((b"<!doctype html", b"<html")):
        return "text/html"
    if head.startswith(b"<?xml"):
        return "application/xml"
    said = (declared or "").split(";")[0].strip().lower()
    if said and said != "application/octet-stream":
        return said
    for ending, kind in ((".csv", "text/csv"), (".jsonl", "application/x-ndjson"), (".json", "application/json"), (".html", "text/html"), (".txt", "text/plain")):
        if (filename or "").lower().endswith(ending):
            return kind
    try:
        raw[:4096].decode("utf-8")
        return "text/plain" if raw and b"\x00" not in raw[:4096] else "application/octet-stream"
    except UnicodeDecodeError:
        return "application/octet-stream"


def decode_bytes(raw: bytes, declared: str | None = None) -> tuple[str, str]:
    """(text, encoding): byte order mark, declared charset, UTF-8, else Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace"), name
    charset = re.search(r"charset=([\w\-]+)", declared or "")
    for name in ([charset[1]] if charset else []) + ["utf-8"]:
        try:
            return raw.decode(name), name
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("cp1252", "replace"), "cp1252"


@F.pandas_udf(T.StringType())
def canonical_url(value: pd.Series) -> pd.Series:
    return value.map(canonical_url_of)


@F.pandas_udf(T.StructType([T.StructField("platform", T.StringType()), T.StructField("url", T.StringType())]))
def social_profile(value: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([social_profile_of(v) or (None, None) for v in value], columns=["platform", "url"])


@F.pandas_udf(T.StringType())
def page_text(html: pd.Series) -> pd.Series:
    return html.map(page_text_of)


@F.pandas_udf(T.TimestampType())
def published_at(html: pd.Series) -> pd.Series:
    return pd.Series([published_of(h) for h in html], dtype="datetime64[ns, UTC]")


def page_references(pages: DataFrame, key: str, url: str, html: str, images: int = 12) -> DataFrame:
    """One row per reference of each page: ``key``, ordinal, kind, url, heading."""
    kind = pages.schema[key].dataType.simpleString()

    def rows(frames):
        for df in frames:
            out = [(k, *r) for k, u, h in zip(df[key], df[url], df[html]) for r in references_of(u, h, images)]
            yield pd.DataFrame(out, columns=[key, "ordinal", "kind", "url", "heading"])

    return pages.select(key, url, html).mapInPandas(rows, f"{key} {kind}, ordinal int, kind string, url string, heading string")


EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
#: Fixed value: what looks like an address but is none: names of pictures and hosts of examples and trackers.
NO_EMAIL = r"\.(?:png|jpe?g|gif|svg|webp)$|@(?:example|sentry|wixpress|placeholder)\."
PHONE = r"(?:\+61|\(0\d\)|\b0\d)[ .\-]?\d(?:[ .\-]?\d){6,8}\b"


def emails_in(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({EMAIL})"), 1), F.lower)
    return F.array_sort(F.array_distinct(F.filter(found, lambda e: ~e.rlike(NO_EMAIL))))


def phones_in(text: Column) -> Column:
    """Digits of the phone numbers in a text, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({PHONE})"), 1), lambda p: F.regexp_replace(p, "[^0-9]", ""))))


def whole_words(words: list[str]) -> str:
    """Pattern of any of the words between characters that are no letters or digits of any script."""
    edge = r"[^\p{L}\p{N}_]"
    return f"(?i)(?:^|{edge})(?:" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + f")(?:$|{edge})"


def vocabulary_hits(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    """Ids of the vocabulary of which a variant stands in the text as whole words, sorted."""
    found = [F.when(text.rlike(whole_words(words)), F.lit(k)) for k, words in sorted(vocabulary.items())]
    return F.array_compact(F.array(*found))
