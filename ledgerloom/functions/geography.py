"""Algebra of hierarchical place codes: ``AU``, ``AU-QLD``, ``AU-VIC-MELBOURNE``, named regions, ``GLOBAL``.

Codes are arrays of strings. Regions are a small parameter, name to member codes, and become literals of the plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

GLOBAL = "GLOBAL"
# Members of some named regions; callers pass their own table for others.
REGIONS: dict[str, tuple[str, ...]] = {
    "ANZ": ("AU", "NZ"),
    "NORTH_AMERICA": ("US", "CA", "MX"),
    "LATAM": ("MX", "BR", "AR", "CL", "CO", "PE", "EC", "UY", "PY", "BO", "VE", "CR", "PA", "GT", "HN", "SV", "NI", "DO", "CU"),
    "APAC": ("AU", "NZ", "JP", "KR", "CN", "TW", "HK", "SG", "MY", "TH", "VN", "PH", "ID", "IN", "PG", "FJ", "BD", "LK", "MM",
             "KH", "LA", "BN", "NP", "PK", "MO", "TL"),
    "EUROPE": ("GB", "IE", "FR", "DE", "NL", "BE", "ES", "PT", "IT", "CH", "AT", "DK", "SE", "NO", "FI", "PL", "CZ", "GR", "RO",
               "HU", "SK", "SI", "HR", "BG", "EE", "LV", "LT", "LU", "IS", "MT", "CY"),
    "MIDDLE_EAST": ("AE", "SA", "QA", "KW", "BH", "OM", "IL", "JO", "LB", "IQ", "IR", "TR", "YE"),
    "AFRICA": ("ZA", "NG", "KE", "EG", "MA", "TN", "DZ", "GH", "ET", "TZ", "UG", "ZM", "ZW", "BW", "NA", "MZ", "SN", "CI", "CM", "RW"),
}
# Written names of regions of a country, and the codes of the regions of Australia and New Zealand.
REGION_NAMES = {
    ("AU", "AUSTRALIAN CAPITAL TERRITORY"): "ACT", ("AU", "NEW SOUTH WALES"): "NSW", ("AU", "NORTHERN TERRITORY"): "NT", ("AU", "QUEENSLAND"): "QLD",
    ("AU", "SOUTH AUSTRALIA"): "SA", ("AU", "TASMANIA"): "TAS", ("AU", "VICTORIA"): "VIC", ("AU", "WESTERN AUSTRALIA"): "WA"}
KNOWN_REGIONS = {"AU": ("ACT", "NSW", "NT", "QLD", "SA", "TAS", "VIC", "WA"), "NZ": ("AUK", "BOP", "CAN", "GIS", "HKB", "MBH", "MWT", "NSN", "NTL", "OTA", "STL", "TAS", "TKI", "WGN", "WKO", "WTC")}
COUNTRY = r"^[A-Z]{2}$"
HIERARCHICAL = r"^[A-Z]{2}(-[A-Z0-9][A-Z0-9_]{0,49})+$"
REGION_CODE = r"^[A-Z][A-Z0-9_]{2,49}$"


def normal_code(code: Column) -> Column:
    return F.replace(F.upper(F.trim(code)), F.lit(" "), F.lit("_"))


def normal_codes(codes: Column) -> Column:
    """Distinct codes in their first order, blank ones dropped; null counts as none."""
    clean = F.filter(F.transform(codes, normal_code), lambda c: c != "")
    return F.coalesce(F.array_distinct(clean), F.array().cast("array<string>"))


def parse_jurisdiction(text: Column) -> Column:
    return normal_codes(F.split(text, "[/,]"))


def valid_code(code: Column, regions: dict[str, Iterable[str]] = REGIONS) -> Column:
    return F.coalesce((F.length(code) <= 100) & (code.isin(GLOBAL, *regions) | code.rlike(COUNTRY) | code.rlike(HIERARCHICAL)), F.lit(False))


def region_problems(code: str, members: Iterable[str], regions: dict[str, Iterable[str]] = REGIONS) -> list[str]:
    """Why a named region cannot be defined so; empty if it can. Regions may not nest."""
    norm = [m.strip().upper().replace(" ", "_") for m in members]
    name, out = code.strip().upper().replace(" ", "_"), []
    if name == GLOBAL or not re.match(REGION_CODE, name):
        out.append(f"{code!r} cannot name a region")
    if not any(norm):
        out.append("a region needs a member")
    for m in filter(None, norm):
        if not re.match(COUNTRY, m) and not re.match(HIERARCHICAL, m):
            out.append(f"member {m!r} is a region" if m in regions or m == GLOBAL else f"member {m!r} is no place code")
    return out


def _members(code: Column, regions: dict[str, Iterable[str]]) -> Column:
    """Members of a region, null for other codes."""
    out = F.lit(None).cast("array<string>")
    for name, members in regions.items():
        out = F.when(code == name, F.array(*[F.lit(m) for m in members])).otherwise(out)
    return out


def expand(codes: Column, regions: dict[str, Iterable[str]] = REGIONS) -> Column:
    """The codes, and the members of those that are regions."""
    return F.array_distinct(F.flatten(F.transform(codes, lambda c: F.concat(F.array(c), F.coalesce(_members(c, regions), F.array().cast("array<string>"))))))


def above(a: Column, b: Column) -> Column:
    """a is b or an ancestor of b."""
    return (a == b) | b.startswith(F.concat(a, F.lit("-")))


def related(a: Column, b: Column) -> Column:
    return above(a, b) | above(b, a)


def _leaves(code: Column, regions: dict[str, Iterable[str]]) -> Column:
    """What a code stands for: a region's members, else itself."""
    return F.coalesce(_members(code, regions), F.array(code))


def covers(a: Column, b: Column, regions: dict[str, Iterable[str]] = REGIONS) -> Column:
    """Code a covers the whole of b: each part of b lies under some part of a."""
    all_in = F.forall(_leaves(b, regions), lambda y: F.exists(_leaves(a, regions), lambda x: above(x, y)))
    return F.when(a == GLOBAL, True).when(b == GLOBAL, False).otherwise(all_in)


def matches(items: Column, wanted: Column, mode: str = "overlaps", unknown: bool = True, regions: dict[str, Iterable[str]] = REGIONS) -> Column:
    """Items against wanted codes: overlaps, covers (an item covers a wanted one), within (the reverse) or exact.

    No wanted codes match everything; no item codes are unknown and count as ``unknown`` says.
    """
    a, b = normal_codes(items), normal_codes(wanted)
    a_all, b_all = F.array_contains(a, GLOBAL), F.array_contains(b, GLOBAL)
    any_pair = lambda x, y, test: F.exists(x, lambda i: F.exists(y, lambda w: test(i, w)))
    if mode == "exact":
        hit = F.arrays_overlap(a, b)
    elif mode == "covers":
        hit = F.when(a_all, True).when(b_all, False).otherwise(any_pair(a, b, lambda i, w: covers(i, w, regions)))
    elif mode == "within":
        hit = F.when(b_all, True).when(a_all, False).otherwise(any_pair(a, b, lambda i, w: covers(w, i, regions)))
    elif mode == "overlaps":
        hit = F.when(a_all | b_all, True).otherwise(any_pair(expand(a, regions), expand(b, regions), related))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.when(F.size(b) == 0, True).when(F.size(a) == 0, F.lit(unknown)).otherwise(hit)


def excluded(items: Column, exclude: Column, regions: dict[str, Iterable[str]] = REGIONS) -> Column:
    """All of the items, and at least one, lie inside some excluded code."""
    a, b = normal_codes(items), normal_codes(exclude)
    inside = F.forall(a, lambda i: F.exists(b, lambda e: covers(e, i, regions)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), False).otherwise(inside)


def ancestor_codes(code: Column) -> Column:
    """The code and all its ancestors, so that related places meet in an equi-join."""
    parts = F.split(code, "-")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))


def row_code(country: Column, region: Column, regions: dict[str, Iterable[str]] = REGIONS, known: dict[str, Iterable[str]] = KNOWN_REGIONS) -> Column:
    """The most specific code of a row, null if it has none: a region that is not known is never broadened to its country."""
    c, r = F.upper(F.trim(F.coalesce(country, F.lit("")))), F.upper(F.trim(F.coalesce(region, F.lit(""))))
    short = r
    for (land, name), code in REGION_NAMES.items():
        short = F.when((c == land) & (r == name), code).otherwise(short)
    full = normal_code(F.concat_ws("-", c, short))
    listed = F.lit(True)
    for land, codes in known.items():
        listed = F.when(c == land, short.isin(*codes)).otherwise(listed)
    return F.when((c != "") & (r != ""), F.when(valid_code(full, regions) & listed, full)).when((c != "") & valid_code(c, regions), c)


def described(code: Column, names: dict[str, str]) -> Column:
    """The name of a code where one is known, else the code."""
    out = code
    for c, name in names.items():
        out = F.when(code == c, name).otherwise(out)
    return out
