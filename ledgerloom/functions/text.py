"""Comparison keys for names, hosts, emails, phones, identifiers and values, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LEGAL_SUFFIXES = ("pty", "ltd", "limited", "inc", "incorporated", "llc", "plc", "corp", "corporation", "gmbh", "bv", "nv")
STOP_WORDS = ("a", "an", "and", "for", "of", "the")
PUBLIC_EMAIL_DOMAINS = ("gmail.com", "hotmail.com", "icloud.com", "live.com", "outlook.com", "proton.me", "protonmail.com", "yahoo.com")
ROLE_WORDS = ("estimating", "tenders", "design", "drafting", "engineering", "projects", "operations", "commercial", "procurement")
HOST_ENDINGS = ("com.au", "net.au", "au", "com")


def _accent_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters and signs outside ASCII and what Unicode's own rule takes them apart to: those that become one ASCII character as a
    pair of strings, those of the Latin blocks, ligatures and letterlike signs that become several as a list."""
    plain = {chr(i): unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode() for r in (range(0xA0, 0xD800), range(0xF900, 0x10000)) for i in r}
    single = [(a, b) for a, b in plain.items() if len(b) == 1]
    several = [(a, b) for a, b in plain.items() if len(b) > 1 and (a < "\u0250" or "\u2000" <= a < "\u2150" or "\ufb00" <= a < "\ufb07")]
    return "".join(a for a, _ in single), "".join(b for _, b in single), several


ACCENTED, PLAIN, SEVERAL = _accent_tables()


def unaccent(text: Column) -> Column:
    """Accents dropped, wide, raised and joined letters written plainly; other characters outside ASCII removed."""
    taken_apart = text
    for a, b in SEVERAL:
        taken_apart = F.replace(taken_apart, F.lit(a), F.lit(b))
    rare = "[" + "".join(a for a, _ in SEVERAL) + "]"
    return F.regexp_replace(F.translate(F.when(text.rlike(rare), taken_apart).otherwise(text), ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def name_key(name: Column) -> Column:
    """Lower-case words without accents and punctuation; legal suffixes dropped from the end while another word is left."""
    spaced = F.trim(F.regexp_replace(F.replace(F.lower(unaccent(name)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
    words = "|".join(LEGAL_SUFFIXES)
    return F.regexp_replace(spaced, rf"(?<=[a-z0-9])( (?:{words}))+$", "")


def tokens(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, " "), lambda t: t != ""))


def blocking_tokens(key: Column) -> Column:
    """Tokens worth blocking on: two letters or more and no joining words."""
    return F.filter(tokens(key), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))


def bare_host(value: Column) -> Column:
    """Host of a URL or domain, lower case, without scheme, user, port, path and leading www."""
    rest = F.regexp_replace(F.lower(F.trim(value)), r"^[a-z][a-z0-9+.\-]*://|^//", "")
    host = F.regexp_replace(F.regexp_replace(rest, r"[/?#].*$", ""), r"^.*@|:\d*$", "")
    return F.regexp_replace(host, r"^www\.", "")


def email_business_domain(email: Column) -> Column:
    """Domain of an email address; null without one or for a public mail provider."""
    host = F.when(email.contains("@"), bare_host(F.substring_index(email, "@", -1)))
    return F.when((host != "") & ~host.isin(*PUBLIC_EMAIL_DOMAINS), host)


def is_role_email(email: Column) -> Column:
    return F.lower(F.substring_index(F.trim(email), "@", 1)).isin(*ROLE_WORDS)


def address_key(parts: Column) -> Column:
    """Name key of the joined parts of an array; null with fewer than two filled ones."""
    filled = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    key = name_key(F.array_join(filled, " "))
    return F.when((F.size(filled) >= 2) & (key != ""), key)


def phone_tail(phone: Column) -> Column:
    """Last eight digits, alike with and without country code; null with fewer."""
    digits = F.regexp_replace(phone, "[^0-9]", "")
    return F.when(F.length(digits) >= 8, F.right(digits, F.lit(8)))


def identifier_key(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, r"[\s\-./]", ""))


def value_key(value: Column) -> Column:
    return F.lower(F.trim(value))


def slug(value: Column, most: int = 80) -> Column:
    text = F.left(F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(most))
    return F.when(text == "", F.lit("source")).otherwise(text)


def split_claims(value: Column) -> Column:
    """Distinct trimmed parts between pipes, semicolons and commas, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(value, r"[|;,]"), lambda p: F.trim(p)), lambda p: p != "")))


def clean_text(value: Column, most: int) -> Column:
    text = F.left(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(most))
    return F.when(text != "", text)


def candidate_hosts(name: Column, most: int = 12, endings: tuple[str, ...] = HOST_ENDINGS) -> Column:
    """Host names a company of that name may use: its words run together, hyphenated, first two, first; each ending."""
    words = tokens(name_key(name))
    stems = F.array_distinct(F.filter(F.array(
        F.array_join(words, ""), F.array_join(words, "-"), F.array_join(F.slice(words, 1, 2), ""), F.element_at(F.concat(words, F.array(F.lit(""))), 1)),
        lambda s: F.length(s) >= 3))
    hosts = F.flatten(F.transform(stems, lambda s: F.array(*[F.concat(s, F.lit("." + e)) for e in endings])))
    return F.slice(hosts, 1, most)
