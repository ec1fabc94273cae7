"""Components of the confidence in a fact, as column expressions; ``as_of`` is always explicit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half-lives in days by predicate (None: no decay), and source categories preferred for a predicate.
HALF_LIFE_DAYS: dict[str, float | None] = {
    "registration_status": 180.0, "registration_identifier": 3650.0, "canonical_name": 1825.0, "legal_name": 1825.0,
    "trading_name": 1095.0, "phone": 365.0, "email": 365.0, "website_domain": 730.0, "location": 730.0,
    "service_claim": 730.0, "archetype_claim": 730.0, "employee_count_band": 540.0, "description": 540.0,
    "project_participation": None}
DEFAULT_HALF_LIFE_DAYS = 540.0
PREFERRED = {
    "registration_status": ("government_registry", "regulator", "bulk_dataset"),
    "registration_identifier": ("government_registry", "regulator", "bulk_dataset"),
    "service_claim": ("company_website",), "archetype_claim": ("company_website",),
    "phone": ("company_website",), "email": ("company_website",)}
STALE_BELOW = 0.3


def authority(tier: Column, category: Column, predicate: Column) -> Column:
    """1.0 for tier 1, 0.08 less for each further tier, 0.1 more for a category preferred for the predicate, at most 1."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - 0.08 * (F.greatest(F.lit(1), tier) - 1)))
    liked = F.lit(False)
    for p, categories in PREFERRED.items():
        liked = liked | ((predicate == p) & category.isin(*categories))
    return F.round(F.when(F.coalesce(liked, F.lit(False)), F.least(F.lit(1.0), base + 0.1)).otherwise(base), 3)


def half_life(predicate: Column) -> Column:
    """Days, null where nothing decays."""
    out = None
    for p, days in HALF_LIFE_DAYS.items():
        value = F.lit(days).cast("double")
        out = F.when(predicate == p, value) if out is None else out.when(predicate == p, value)
    return out.otherwise(DEFAULT_HALF_LIFE_DAYS)


def freshness(predicate: Column, observed_at: Column, as_of: Column) -> Column:
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(observed_at)) / 86_400_000_000.0)
    return F.coalesce(F.round(F.pow(F.lit(0.5), days / half_life(predicate)), 3), F.when(half_life(predicate).isNull(), 1.0))


def corroboration(origins: Column) -> Column:
    return F.when(origins <= 1, 1.0).otherwise(F.round(F.least(F.lit(1.2), 1.0 + 0.08 * (origins - 1)), 3))


def contradiction(supporting: Column, contradicting: Column) -> Column:
    contested = contradicting / (supporting + contradicting)
    return F.when((contradicting == 0) | (supporting + contradicting == 0), 1.0).otherwise(
        F.round(F.greatest(F.lit(0.4), 1.0 - 0.6 * contested), 3))


def final(*components: Column) -> Column:
    product = F.lit(1.0)
    for c in components:
        product = product * c
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), product)), 3)


def wording(score: Column, conflicted: Column, stale: Column, verified: Column) -> Column:
    return (F.when(conflicted, "conflicted").when(stale, "stale").when(verified, "verified").when(score >= 0.75, "high")
            .when(score >= 0.5, "moderate").when(score >= 0.3, "low").otherwise("speculative"))


def retry_after_seconds(value: Column) -> Column:
    """Seconds asked for, at least 30; 900 if none can be read."""
    seconds = value.try_cast("double")
    return F.when(seconds.isNull(), 900.0).otherwise(F.greatest(seconds, F.lit(30.0)))  # greatest() passes nulls over


def backoff_seconds(attempts: Column) -> Column:
    return F.least(5.0 * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(300.0))
