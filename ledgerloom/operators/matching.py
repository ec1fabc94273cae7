"""Duplicate organisations: features, blocking, pair scores by noisy-or, and review priority."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import text, web
from ledgerloom.session import Stash

# Signal weights, thresholds, the size beyond which a block is not paired out.
WEIGHTS = {"identifier": 1.0, "domain": 0.9, "name_exact": 0.85, "name_fuzzy": 0.6, "phone": 0.15, "email_domain": 0.55,
           "address": 0.65, "social": 0.75, "locality": 0.05}
CONFLICT_PENALTY = 0.3
EXACT, HIGH, REVIEW = 0.98, 0.85, 0.45
RATIO_FLOOR, JACCARD_FLOOR = 0.75, 0.5
BLOCK_LIMIT = 50

SETS = ("names", "identifiers", "domains", "phones", "email_domains", "addresses", "localities", "socials")


def features(organisations: DataFrame, identifiers: DataFrame, locations: DataFrame, observations: DataFrame) -> DataFrame:
    """One row per live organisation with its sets of comparison keys.

    Merged organisations are left out; identifiers count while current; contacts come from observations that were not
    rejected; the address is that of the least location id. Repeated rows fold into the sets.
    """
    live = organisations.where("org_id is not null and (merged_into_id is null or trim(merged_into_id) = '')").groupBy("org_id").agg(
        F.min(F.struct("canonical_name", "legal_name", "trading_names")).alias("o")).select("org_id", "o.*")
    raw = F.array_compact(F.concat(F.array("canonical_name", "legal_name"), F.coalesce("trading_names", F.array().cast("array<string>"))))
    named = live.select("org_id", F.array_sort(F.array_distinct(F.filter(F.transform(raw, text.name_key), lambda n: n != ""))).alias("names"))
    ids = identifiers.where("is_current").groupBy("org_id").agg(F.array_sort(F.collect_set(
        F.concat_ws(":", "scheme", text.identifier_key(F.coalesce("value_normalised", "value"))))).alias("identifiers"))
    said = observations.where("normalisation_status <> 'rejected' and predicate in ('website_domain', 'phone', 'email')")
    pick = lambda p, k: F.array_sort(F.collect_set(F.when(F.col("predicate") == p, k)))
    contacts = said.groupBy("org_id").agg(
        pick("website_domain", text.bare_host(F.col("object_value"))).alias("domains"),
        pick("phone", text.phone_tail(F.col("object_value"))).alias("phones"),
        pick("email", text.email_business_domain(F.col("object_value"))).alias("email_domains"))
    profiles = observations.where("normalisation_status <> 'rejected' and predicate = 'social_profile'").select("org_id", web.social_profile(F.col("object_value"))["url"].alias("url"))
    socials = profiles.groupBy("org_id").agg(F.array_sort(F.collect_set("url")).alias("socials"))
    place = locations.where("location_id is not null").groupBy("org_id").agg(
        F.min(F.struct("location_id", "address_lines", "locality", "region", "postal_code", "country")).alias("l")).select("org_id", "l.*")
    parts = F.concat("address_lines", F.array("postal_code", "locality", "region", "country"))
    where = place.select(
        "org_id", F.array_compact(F.array(F.when(F.size("address_lines") > 0, text.address_key(F.array_compact(parts))))).alias("addresses"),
        F.array_compact(F.array(F.when(F.length(F.trim("locality")) > 0, F.concat_ws("|", F.lower(F.trim("locality")), F.trim("postal_code"))))).alias("localities"))
    out = named.join(ids, "org_id", "left").join(contacts, "org_id", "left").join(where, "org_id", "left").join(socials, "org_id", "left")
    return out.select("org_id", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in SETS])


def blocks(feats: DataFrame) -> DataFrame:
    """``(key, weak, org_id)``: every blocking key of every organisation; ``weak`` marks single name tokens."""
    def prefixed(column: str, prefix: str) -> Column:
        return F.transform(F.col(column), lambda k: F.concat(F.lit(prefix), k))

    strong = F.concat(*[prefixed(c, p) for c, p in (
        ("identifiers", "id:"), ("domains", "dom:"), ("phones", "phone:"), ("email_domains", "email:"), ("addresses", "address:"), ("socials", "social:"), ("names", "name:"))])
    weak = F.array_distinct(F.flatten(F.transform("names", text.blocking_tokens)))
    return feats.select("org_id", F.explode(F.concat(
        F.transform(strong, lambda k: F.struct(k.alias("key"), F.lit(False).alias("weak"))),
        F.transform(weak, lambda k: F.struct(F.concat(F.lit("token:"), k).alias("key"), F.lit(True).alias("weak"))))).alias("b")).select(
        "b.key", "b.weak", "org_id").distinct()


def candidate_pairs(feats: DataFrame, limit: int = BLOCK_LIMIT) -> DataFrame:
    """``(a, b)``, a < b: pairs of blocks of up to ``limit`` members; of larger blocks on a strong key each member with
    the least id, so that a block of any size gives as many pairs as members and still hangs together. Larger blocks on a
    name token are no evidence and give none."""
    keys = blocks(feats)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("org_id").alias("least")).where("n > 1")
    sized = keys.join(sizes, "key")
    small = sized.where(F.col("n") <= limit).select("key", "org_id")
    pairs = small.select("key", F.col("org_id").alias("a")).join(small.select("key", F.col("org_id").alias("b")), "key").where("a < b").select("a", "b")
    star = sized.where((F.col("n") > limit) & ~F.col("weak") & (F.col("org_id") > F.col("least"))).select(F.col("least").alias("a"), F.col("org_id").alias("b"))
    return pairs.unionByName(star).distinct()


@lru_cache(1 << 16)
def similar_names(x: str, y: str) -> float:
    """The greater of sequence ratio and token overlap, each above its floor; the ratio is only worked out where lengths and
    letters leave it a chance."""
    s, t = set(x.split()), set(y.split())
    overlap = len(s & t) / max(len(s | t), 1)
    least, ratio = max(RATIO_FLOOR, overlap), 0.0
    if 2 * min(len(x), len(y)) >= least * (len(x) + len(y)):
        match = SequenceMatcher(None, x, y)
        ratio = match.ratio() if match.quick_ratio() >= least else 0.0
    return max(ratio if ratio >= RATIO_FLOOR else 0.0, overlap if overlap >= JACCARD_FLOOR else 0.0)


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Best over all names of two different sets; nothing to do where one is null."""
    return pd.Series([max((similar_names(x, y) for x in xs for y in ys), default=0.0) if xs is not None and ys is not None else 0.0 for xs, ys in zip(a, b)], dtype=float)


def noisy_or(weights: Column) -> Column:
    return 1.0 - F.aggregate(weights, F.lit(1.0), lambda acc, w: acc * (1.0 - w))


def scored_pairs(feats: DataFrame, pairs: DataFrame, least: float = REVIEW) -> DataFrame:
    """Score, state, conflicts and signals of each pair of at least ``least``."""
    side = lambda p: feats.select(F.col("org_id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in SETS])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = lambda c: F.arrays_overlap(f"a_{c}", f"b_{c}")
    scheme = lambda ids: F.array_distinct(F.transform(ids, lambda i: F.substring_index(i, ":", 1)))
    common = F.array_intersect(scheme(F.col("a_identifiers")), scheme(F.col("b_identifiers")))
    of = lambda ids, s: F.filter(ids, lambda i: i.startswith(F.concat(s, F.lit(":"))))
    clash = F.size(F.filter(common, lambda s: ~F.arrays_overlap(of(F.col("a_identifiers"), s), of(F.col("b_identifiers"), s))))
    same = F.arrays_overlap("a_names", "b_names")
    unlike = lambda c: F.when(~same, F.col(c))
    rated = both.withColumn("similarity", F.when(same, 1.0).otherwise(name_similarity(unlike("a_names"), unlike("b_names")))).withColumn("conflict_count", clash)
    signals = [("shared_identifier", shared("identifiers"), F.lit(WEIGHTS["identifier"])), ("shared_domain", shared("domains"), F.lit(WEIGHTS["domain"])),
               ("name_exact", F.col("similarity") >= 1, F.lit(WEIGHTS["name_exact"])),
               ("name_fuzzy", (F.col("similarity") > 0) & (F.col("similarity") < 1), F.round(WEIGHTS["name_fuzzy"] * F.col("similarity"), 3)),
               ("shared_phone", shared("phones"), F.lit(WEIGHTS["phone"])), ("shared_email_domain", shared("email_domains"), F.lit(WEIGHTS["email_domain"])),
               ("shared_address", shared("addresses"), F.lit(WEIGHTS["address"])), ("shared_social_profile", shared("socials"), F.lit(WEIGHTS["social"])), ("shared_locality", shared("localities"), F.lit(WEIGHTS["locality"]))]
    seen = rated.withColumn("signals", F.array_compact(F.array(*[
        F.when(hit, F.struct(F.lit(name).alias("signal"), weight.cast("double").alias("weight"))) for name, hit, weight in signals])))
    score = F.greatest(F.lit(0.0), F.round(noisy_or(F.transform("signals", lambda s: s["weight"])) - CONFLICT_PENALTY * F.col("conflict_count"), 3))
    state = (F.when(shared("identifiers") & (F.col("conflict_count") == 0) & (F.col("score") >= EXACT), "exact")
             .when((F.col("score") >= HIGH) & (F.col("conflict_count") == 0), "high_confidence_probable")
             .when(F.col("score") >= REVIEW, "possible_review").otherwise("unresolved"))
    return seen.withColumn("score", score).where(F.col("score") >= least).select("a", "b", state.alias("match_state"), "score", "conflict_count", "signals")


def duplicate_candidates(organisations: DataFrame, identifiers: DataFrame, locations: DataFrame, observations: DataFrame) -> DataFrame:
    stash = Stash(organisations.sparkSession)
    feats = stash.put(features(organisations, identifiers, locations, observations))
    return scored_pairs(feats, stash.put(candidate_pairs(feats)))
