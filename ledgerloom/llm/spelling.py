"""Parsing of company names and postal addresses into components, and spelling keys."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Legal forms and joining words of company names.
LEGAL = {"pty", "ltd", "limited", "inc", "incorporated", "pl", "co", "company", "corp", "corporation", "llc", "plc"}
JOINERS = {"and", "the"}
#: Letters from which on a common beginning makes two words of one family, and letters a name's first word must have to stand alone.
FAMILY, ALONE = 4, 3

STATES = {
    "nsw": "nsw", "new south wales": "nsw", "vic": "vic", "victoria": "vic", "qld": "qld", "queensland": "qld", "sa": "sa",
    "south australia": "sa", "wa": "wa", "western australia": "wa", "tas": "tas", "tasmania": "tas", "nt": "nt",
    "northern territory": "nt", "act": "act", "australian capital territory": "act", "wgn": "wgn", "wellington": "wgn"}
STREET_TYPES = {
    "street": "street", "st": "street", "str": "street", "road": "road", "rd": "road", "avenue": "avenue", "ave": "avenue",
    "av": "avenue", "drive": "drive", "dr": "drive", "drv": "drive", "lane": "lane", "ln": "lane", "la": "lane",
    "court": "court", "ct": "court", "crt": "court", "place": "place", "pl": "place", "plc": "place", "parade": "parade",
    "pde": "parade", "crescent": "crescent", "cr": "crescent", "cres": "crescent", "terrace": "terrace", "tce": "terrace",
    "terr": "terrace", "boulevard": "boulevard", "blvd": "boulevard", "bvd": "boulevard", "highway": "highway",
    "hwy": "highway", "hway": "highway", "close": "close", "cl": "close", "way": "way", "square": "square", "sq": "square"}
DIRECTIONS = {
    "north": "north", "n": "north", "nth": "north", "south": "south", "s": "south", "sth": "south", "east": "east",
    "e": "east", "est": "east", "west": "west", "w": "west", "wst": "west"}
DIRECTIONS |= {w[:i] + w[i + 1:]: w for w in ("north", "south") for i in range(5)}  # a letter dropped
DIRECTIONS |= {w[:i] + w[i + 1] + w[i] + w[i + 2:]: w for w in ("north", "south", "east", "west") for i in range(len(w) - 1)}  # or swapped
TOWN_WORDS = {**DIRECTIONS, "mt": "mount", "mount": "mount", "pt": "port", "port": "port", "st": "saint", "saint": "saint"}
BUILDING = {"tower", "house", "depot", "park", "centre", "center", "building", "estate", "plaza", "mall"}


def plain(text: str | None) -> str:
    """Lower case without accents."""
    if not isinstance(text, str):
        return ""
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()


def parse_name(name: str | None) -> tuple[str, str]:
    """(stem, trade) of a company name by the order of its words; '' where absent.

    The stem is the first word (run together with the next while it is shorter than ``ALONE`` letters), the trade the words
    that follow. Legal forms and joining words are left out, ``trade by stem`` is turned round, of ``x t/a y`` y counts. No
    list of trades is used: any word may be one."""
    text = plain(name).replace("'", "")
    text = re.split(r"\bt\s*/\s*a\b", text)[-1] or text
    text = re.sub(r"\bp\W{1,2}l\b", " ", text)
    words = [w for w in re.sub(r"[^a-z0-9 ]+", " ", text.replace("/", "")).split() if w not in LEGAL and w not in JOINERS]
    if "by" in words[1:-1]:
        i = words.index("by", 1)
        words = words[i + 1:] + words[:i]
    n = 1
    while n < len(words) and len("".join(words[:n])) < ALONE:
        n += 1
    return "".join(words[:n]), " ".join(words[n:])


def _near(a: str, b: str) -> bool:
    """One letter added, dropped or changed, or two neighbours swapped."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1:] == b[i:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i + 1:] or (a[i:i + 2] == b[i:i + 2][::-1] and a[i + 2:] == b[i + 2:])


def word_fits(a: str, b: str) -> bool:
    """Two spellings of one descriptive word: equal, of one family (``FAMILY`` letters alike at the start), one an abbreviation
    of the other (its letters in order, the first one the same), or with the same first letter a typing error apart."""
    if a == b:
        return True
    short, long = sorted((a, b), key=len)
    if not short:
        return False
    rest = iter(long)
    return (a[:FAMILY] == b[:FAMILY] and len(short) >= FAMILY) or (short[0] == long[0] and all(c in rest for c in short)) or (short[0] == long[0] and len(short) > FAMILY and _near(a, b))


@lru_cache(1 << 16)
def trades_fit(a: str, b: str) -> bool:
    """Whether two descriptions may be of one trade: their first words fit, apart or run together with the second; a single
    letter only if the next words fit too. A missing description contradicts none."""
    x, y = a.split(), b.split()
    if not x or not y:
        return True
    for p, q in ((x[:1], y[:1]), (x[:2], y[:1]), (x[:1], y[:2])):
        if len(p) == len(q) == 1 and min(len(p[0]), len(q[0])) == 1:
            if word_fits(p[0], q[0]) and len(x) > 1 and len(y) > 1 and word_fits(x[1], y[1]):
                return True
        elif word_fits("".join(p), "".join(q)):
            return True
    return False


def town_key(text: str | None) -> str:
    """A town in one spelling: accents and dots dropped, 'N.', 'Nth' and the like written out and put first."""
    words = re.sub(r"[^a-z0-9 ]+", " ", plain(text)).split()
    if not words:
        return ""
    if len(words) > 1:
        if words[-1] in DIRECTIONS:
            words = [words[-1], *words[:-1]]
        words[0] = TOWN_WORDS.get(words[0], words[0])
    return " ".join(words)


def state_key(text: str | None) -> str:
    return STATES.get(" ".join(re.sub(r"[^a-z ]+", " ", plain(text)).split()), "")


_STATE_TAIL = re.compile(r"^(.*?)[ ,]+(" + "|".join(sorted(map(re.escape, STATES), key=len, reverse=True)) + r")(?: +(\d{4}))?$")
_BOX = re.compile(r"\b(?:g?p ?o ?box|post office box|locked bag)\b *(\d+)\b|\b(?:pobox) *(\d+)\b")
_UNIT = re.compile(r"^(?:unit|u|suite|flat|apartment|apt|shop|lot) *(\d+[a-z]?)\b[ ,]*")
_SLASH = re.compile(r"^(\d+[a-z]?) ?/ ?(\d+[a-z]?)\b")
_NUMBER = re.compile(r"^(\d+) ?([a-z]?)(?= |$)")
_TAIL_NUMBER = re.compile(r"^(.*[a-z].*?) (\d+)([a-z]?)$")


def parse_address(lines, locality, region, postal_code) -> dict[str, str]:
    """Components in one spelling: box, unit, number (with letter), street, type, direction, town, state, postcode."""
    out = dict.fromkeys(PARTS, "")
    out["town"], out["state"] = town_key(locality), state_key(region)
    code = re.sub(r"\D", "", postal_code) if isinstance(postal_code, str) else ""
    out["postcode"] = code
    segments = []
    for line in lines if lines is not None else []:
        clean = re.sub(r"[.']", "", plain(line).replace("p.o", "p o"))
        clean = re.sub(r"\b(?:number|no|nr|num) +(?=\d)|# *(?=\d)", "", clean)
        segments += [" ".join(x.split()) for x in re.split(r"[,;\n]", clean)]
    loose: list[str] = []
    for seg in [s for s in segments if s]:
        box = _BOX.search(seg)
        if box:
            out["box"] = (box[1] or box[2]).lstrip("0")
            seg = (seg[:box.start()] + seg[box.end():]).strip()
            if not seg:
                continue
        tail = _STATE_TAIL.match(seg)
        if tail and (tail[3] or not re.match(r"^\S*\d", tail[1])):
            seg = tail[1]
            out["state"] = out["state"] or STATES[tail[2]]
            out["postcode"] = out["postcode"] or (tail[3] or "")
            if not re.search(r"\d", seg) and not _is_street(seg):
                out["town"] = out["town"] or town_key(seg)
                continue
        head = re.match(r"^(\d{4}) ([a-z][a-z ]*)$", seg)
        if head and not _is_street(head[2]):
            out["postcode"] = out["postcode"] or head[1]
            out["town"] = out["town"] or town_key(head[2])
            continue
        unit = _UNIT.match(seg)
        if unit:
            out["unit"], seg = unit[1], seg[unit.end():].strip()
            if not seg:
                continue
        slash = _SLASH.match(seg)
        if slash:
            out["unit"], seg = slash[1], seg[slash.start(2):]
        number = _NUMBER.match(seg)
        rest = seg[number.end():].strip() if number else ""
        if number and rest and re.search("[a-z]", rest):
            _street(out, rest)
            out["number"] = out["number"] or number[1].lstrip("0") + number[2]
            continue
        last = _TAIL_NUMBER.match(seg)
        if last and _is_street(last[1]):
            _street(out, last[1])
            out["number"] = out["number"] or last[2].lstrip("0") + last[3]
            continue
        loose.append(seg)
    for seg in loose:
        words = seg.split()
        if re.fullmatch(r"\d{4}", seg):
            out["postcode"] = out["postcode"] or seg
        elif words[-1] in BUILDING:
            continue
        elif not out["street"] and not out["box"] and _is_street(seg):
            _street(out, seg)
        elif not out["town"] and not re.search(r"\d", seg):
            out["town"] = town_key(seg)
    return out


def _is_street(text: str) -> bool:
    words = text.split()
    while len(words) > 1 and words[-1] in DIRECTIONS:
        words.pop()
    return len(words) > 1 and words[-1] in STREET_TYPES


def _street(out: dict[str, str], text: str) -> None:
    if out["street"]:
        return
    words = text.split()
    if len(words) > 2 and words[-1] in DIRECTIONS and words[-2] in STREET_TYPES:
        out["direction"] = DIRECTIONS[words.pop()]
    if len(words) > 1 and words[-1] in STREET_TYPES:
        out["type"] = STREET_TYPES[words.pop()]
    if not out["direction"] and len(words) > 1 and words[0] in DIRECTIONS:
        out["direction"] = DIRECTIONS[words.pop(0)]
    out["street"] = " ".join(words)


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


@F.pandas_udf(_strings("stem", "trade"))
def name_parts(name: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_name(x) for x in name], columns=["stem", "trade"])


@F.pandas_udf(T.BooleanType())
def same_trade(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([trades_fit(x or "", y or "") for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.StringType())
def town_of(town: pd.Series) -> pd.Series:
    return town.map(town_key)


@F.pandas_udf(T.StringType())
def state_of(state: pd.Series) -> pd.Series:
    return state.map(state_key)


PARTS = ("box", "unit", "number", "street", "type", "direction", "town", "state", "postcode")


@F.pandas_udf(_strings(*PARTS))
def address_parts(lines: pd.Series, locality: pd.Series, region: pd.Series, postal_code: pd.Series) -> pd.DataFrame:
    rows = [parse_address(*x) for x in zip(lines, locality, region, postal_code)]
    return pd.DataFrame(rows, columns=PARTS)


def shortened(text: Column) -> Column:
    """The text and each way of dropping one letter: two texts one edit or swap apart share one of these."""
    drops = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    return F.array_distinct(F.when(F.length(text) > 0, F.concat(F.array(text), drops)).otherwise(F.array(text)))


def affixes(text: Column) -> Column:
    """First and last letters: two texts of three or more letters one edit or swap apart share one of these."""
    ends = lambda n: [F.concat(F.lit(f"<{n}"), F.substring(text, 1, n)), F.concat(F.lit(f">{n}"), F.right(text, F.lit(n)))]
    few = F.array(F.concat(F.lit("="), text), *ends(1))
    return F.array_distinct(F.when(F.length(text) > 7, F.array(*ends(3))).when(F.length(text) > 5, F.array(*ends(3), *ends(2))).when(
        F.length(text) > 3, F.array(*ends(2), *ends(1))).otherwise(few))


def swapped(a: Column, b: Column) -> Column:
    """Two neighbouring letters changed places. Letters further apart do not count: those are other names."""
    part = lambda i, n: F.substring(a, i, n)
    turned = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(
        F.substring(a, F.lit(1), i - 1), part(i + 1, F.lit(1)), part(i, F.lit(1)), part(i + 2, F.length(a))) == b)
    return (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & turned


def one_edit(a: Column, b: Column) -> Column:
    """Equal, or one letter added, dropped, changed, or two swapped."""
    return (F.levenshtein(a, b) <= 1) | swapped(a, b)
