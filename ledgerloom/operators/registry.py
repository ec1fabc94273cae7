"""The register of sources: identities, targets, scopes, gates, schedules and three-way syncs of desired against recorded rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import geography as geo
from ledgerloom.operators.records import table_diff

# Seconds between collections by the frequency a source is expected to change with; a day otherwise.
INTERVALS = {"hourly": 3600.0, "daily": 86_400.0, "weekly": 604_800.0, "monthly": 2_592_000.0, "quarterly": 7_776_000.0}
DAY = 86_400.0
MODES = ("exact", "hierarchical", "covers", "within")
DIMENSION = r"^[a-z][a-z0-9_]{0,99}$"
KEY = r"^[a-z0-9][a-z0-9_.:]{0,299}$"


# --- hosts, identities, addresses

def domain_matches(host: Column, rule: Column) -> Column:
    """The host is the rule's domain or lies under it."""
    return F.coalesce((host == rule) | host.endswith(F.concat(F.lit("."), rule)), F.lit(False))


def identities(pack: Column, seed: Column, key: Column, url: Column) -> Column:
    """(kind, value) identities a source can be known by: of a pack's seed, of a shared key, of its canonical URL."""
    low = lambda c: F.lower(F.trim(c))
    of = lambda kind, value: F.when(F.length(value) > 0, F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    both = F.when(pack.isNotNull() & seed.isNotNull(), F.lower(F.concat_ws(":", F.trim(pack), F.trim(seed))))
    return F.array_compact(F.array(of("pack_seed", both), of("source_key", low(key)), of("url", url)))


def attached(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(kind, value, source_id, is_primary, outcome)`` of identities to attach: attached, already there, or conflict where
    another source, known or wanted, has the identity. At most one primary a source: the recorded one, else the first attached."""
    both = known.select("kind", "value", "source_id").unionByName(wanted.select("kind", "value", "source_id")).groupBy("kind", "value").agg(F.countDistinct("source_id").alias("owners"))
    mine = known.select("kind", "value", "source_id", F.lit(True).alias("had"))
    rows = wanted.select("kind", "value", "source_id").distinct().join(both, ["kind", "value"]).join(mine, ["kind", "value", "source_id"], "left")
    outcome = F.when(F.col("owners") > 1, "conflict").when(F.col("had"), "already there").otherwise("attached")
    primary = known.where("is_primary").select("source_id", F.lit(True).alias("has")).distinct()
    placed = rows.withColumn("outcome", outcome).join(primary, "source_id", "left")
    first = placed.where("outcome = 'attached' and has is null").groupBy("source_id").agg(F.min(F.struct("kind", "value")).alias("f"))
    return placed.join(first, "source_id", "left").select(
        "kind", "value", "source_id", F.coalesce((F.col("outcome") == "attached") & (F.struct("kind", "value") == F.col("f")), F.lit(False)).alias("is_primary"), "outcome")


def collection_url(coverage_url: Column, source_url: Column, base_url: Column) -> Column:
    filled = lambda c: F.when(F.length(F.trim(c)) > 0, c)
    return F.coalesce(filled(coverage_url), filled(source_url), filled(base_url))


def distinct_endpoint(coverage_url: Column, source_url: Column) -> Column:
    """The coverage has an endpoint of its own: both are canonical URLs."""
    return F.coalesce((F.length(coverage_url) > 0) & (F.length(source_url) > 0) & (coverage_url != source_url), F.lit(False))


# --- gates

def robots_enforced(override: Column, policy: str) -> Column:
    return F.coalesce(override, F.lit(policy == "enforce"))


def activation_blockers(terms: Column, robots: Column, method: Column, enforced: Column) -> Column:
    """Why a source may not be collected, in order; empty if it may. Prohibiting terms always count."""
    asked = enforced & (method != "manual")
    return F.array_compact(F.array(
        F.when(terms == "prohibited", "terms prohibit access"), F.when(asked & (robots == "disallowed"), "robots disallow access"),
        F.when(asked & F.coalesce(robots, F.lit("unknown")).isin("unknown", "unreachable"), "robots not verified")))


def policy_snapshot(robots: Column, enforced: Column, terms: Column, lifecycle: Column, tier: Column, tier_override: Column, url: Column) -> Column:
    """The policy evidence is taken under, as one struct to store with it."""
    return F.struct(robots.alias("robots_status"), enforced.alias("robots_enforced"), (~enforced & (robots == "disallowed")).alias("robots_override_applied"), terms.alias("terms_status"),
                    lifecycle.alias("lifecycle_status"), F.coalesce(tier_override, tier).alias("authority_tier"), tier.alias("source_authority_tier"), url.alias("collection_url"))


# --- listing and schedule

def initial_interval(frequency: Column) -> Column:
    hint, out = F.lower(F.trim(frequency)), F.lit(DAY)
    for name, seconds in INTERVALS.items():
        out = F.when(hint == name, seconds).otherwise(out)
    return out


def listed(sources: DataFrame, status: str | None = None, category: str | None = None) -> DataFrame:
    """Sources of a status and category, the most authoritative first."""
    rows = sources.where(F.col("lifecycle_status") == status) if status else sources
    rows = rows.where(F.col("source_category") == category) if category else rows
    return rows.orderBy("authority_tier", "name", "source_id")


def unpaired(sources: DataFrame, paired: DataFrame) -> DataFrame:
    return sources.join(paired.select("source_id").distinct(), "source_id", "left_anti")


def due(sources: DataFrame, at: Column, most: int) -> DataFrame:
    """The first ``most`` sources to collect: active or degraded, not manual, due and not throttled."""
    ready = lambda c: F.col(c).isNull() | (F.col(c) <= at)
    rows = sources.where(F.col("lifecycle_status").isin("active", "degraded") & (F.coalesce("access_method", F.lit("")) != "manual") & ready("next_collect_at") & ready("retry_after_until"))
    return rows.orderBy("authority_tier", "name", "source_id").limit(most)


def delays(requests: DataFrame, seconds: float = 2.0) -> DataFrame:
    """``requests`` (batch, ordinal, host) with the seconds to wait before each: twice as long after one to the same host, none
    before the first of a batch."""
    before = F.lag("host").over(Window.partitionBy("batch").orderBy("ordinal"))
    return requests.withColumn("delay", F.when(before.isNull(), 0.0).when(before == F.col("host"), 2 * seconds).otherwise(seconds))


def collection_outcomes(fetches: DataFrame, known: DataFrame) -> DataFrame:
    """``fetches`` with the outcome of each: skipped, blocked, throttled, failure, unchanged, duplicate or collected.

    ``fetches``: fetch_id, source_id, url, at, active, blockers (array), status (HTTP, null if none came), content_hash; ``known``:
    (source_id, url, content_hash) on record. Of several fetches of one content the first in time is the one collected.
    """
    key = ["source_id", "url", "content_hash"]
    had = known.select(*key, F.lit(True).alias("had")).distinct()
    first = fetches.where("status between 200 and 299 and content_hash is not null").groupBy(*key).agg(F.min(F.struct("at", "fetch_id")).alias("first"))
    rows = fetches.join(had, key, "left").join(first, key, "left")
    outcome = (F.when(~F.col("active"), "skipped").when(F.size("blockers") > 0, "blocked").when(F.col("status") == 304, "unchanged").when(F.col("status").isin(429, 503), "throttled")
               .when(F.col("status").isNull() | ~F.col("status").between(200, 299), "failure")
               .when(F.coalesce("had", F.lit(False)) | (F.struct("at", "fetch_id") != F.col("first")), "duplicate").otherwise("collected"))
    return rows.withColumn("outcome", outcome).drop("had", "first")


def latest(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The latest row of each key, whole; equal times go by the greatest tie. Combined map-side."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(time, tie)).alias("r")).select(*keys, "r.*")


def backlog(documents: DataFrame, runs: DataFrame, pending: DataFrame, version: str, config: str, most: int | None = None) -> DataFrame:
    """Documents without a run of this version and configuration and without a pending one, newest first."""
    done = runs.where((F.col("pipeline_version") == version) & (F.col("config_hash") == config)).select("document_id").unionByName(pending.select("document_id")).distinct()
    rows = documents.join(done, "document_id", "left_anti").orderBy(F.desc("retrieved_at"), "document_id")
    return rows.limit(most) if most else rows


# --- targets and scopes

def normal_dimension(value: Column) -> Column:
    """Lower case with underscores, geo and geography read as region; null if it is no dimension."""
    d = F.replace(F.replace(F.lower(F.trim(value)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    d = F.when(d.isin("geo", "geography"), "region").otherwise(d)
    return F.when(d.rlike(DIMENSION), d)


def normal_target(dimension: Column, value: Column, regions: Mapping[str, Iterable[str]] = geo.REGIONS) -> Column:
    """A place code for regions, else lower case with underscores; null if it is no key."""
    place = geo.normal_code(value)
    other = F.replace(F.replace(F.lower(F.trim(value)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    return F.when(dimension == "region", F.when(geo.valid_code(place, dict(regions)), place)).otherwise(F.when(other.rlike(KEY), other))


def normal_targets(targets: DataFrame, keys: list[str], regions: Mapping[str, Iterable[str]] = geo.REGIONS) -> DataFrame:
    """One row per key, dimension and target with ``problem``: null, or why it cannot stand (unreadable, a wrong polarity or mode,
    included and excluded, two modes). Regions match hierarchically unless said otherwise, all else exactly."""
    rows = targets.select(*keys, F.col("dimension").alias("raw_dimension"), F.col("target_key").alias("raw_key"), "polarity", "match_mode").withColumn(
        "dimension", normal_dimension(F.col("raw_dimension"))).withColumn("target_key", normal_target(F.col("dimension"), F.col("raw_key"), regions)).withColumn(
        "match_mode", F.coalesce("match_mode", F.when(F.col("dimension") == "region", "hierarchical").otherwise("exact")))
    own = (F.when(F.col("dimension").isNull(), "invalid dimension").when(F.col("target_key").isNull(), "invalid target").when(~F.col("polarity").isin("include", "exclude"), "invalid polarity")
           .when(~F.col("match_mode").isin(*MODES) | ((F.col("dimension") != "region") & (F.col("match_mode") != "exact")), "invalid mode"))
    folded = rows.withColumn("problem", own).groupBy(*keys, F.coalesce("dimension", "raw_dimension").alias("dimension"), F.coalesce("target_key", "raw_key").alias("target_key")).agg(
        F.min("problem").alias("problem"), F.countDistinct("polarity").alias("polarities"), F.countDistinct("match_mode").alias("modes"), F.min("polarity").alias("polarity"), F.min("match_mode").alias("match_mode"))
    return folded.withColumn("problem", F.coalesce("problem", F.when(F.col("polarities") > 1, "included and excluded"), F.when(F.col("modes") > 1, "conflicting modes"))).drop("polarities", "modes")


def query_filters(industries: Iterable[str] = (), places: Iterable[str] = (), filters: Mapping[str, object] | None = None) -> dict[str, dict[str, tuple[str, ...]]]:
    """Dimension to included and excluded keys, normalised and sorted, of the three ways to ask."""
    out: dict[str, dict[str, set[str]]] = {}

    def add(dimension: str, polarity: str, values: Iterable[str]) -> None:
        name = re.sub(r"[-\s]", "_", dimension.strip().lower())
        name = "region" if name in ("geo", "geography") else name
        for v in values:
            if v and v.strip():
                key = re.sub(r"\s", "_", v.strip().upper()) if name == "region" else re.sub(r"[-\s]", "_", v.strip().lower())
                out.setdefault(name, {"include": set(), "exclude": set()})[polarity].add(key)

    add("industry", "include", industries)
    add("region", "include", places)
    for dimension, wanted in (filters or {}).items():
        parts = wanted if isinstance(wanted, Mapping) else {"include": [wanted] if isinstance(wanted, str) else wanted}
        for polarity in ("include", "exclude"):
            add(dimension, polarity, parts.get(polarity) or ())
    return {d: {p: tuple(sorted(v)) for p, v in parts.items()} for d, parts in sorted(out.items())}


def in_scope(places: Column, include: Iterable[str], exclude: Iterable[str], unknown: bool, regions: Mapping[str, Iterable[str]] = geo.REGIONS) -> Column:
    """A footprint of place codes against a scope: out if it lies wholly in what is excluded, else in if it overlaps what is
    included; no footprint counts as ``unknown`` says."""
    codes = lambda x: F.array(*[F.lit(c) for c in x]).cast("array<string>")
    return ~geo.excluded(places, codes(exclude), dict(regions)) & geo.matches(places, codes(include), "overlaps", unknown, dict(regions))


def activated(scopes: DataFrame, scope_id: str) -> DataFrame:
    """Scopes with that one active and no other; an unknown id leaves them as they are."""
    if not scopes.where(F.col("scope_id") == scope_id).limit(1).count():
        return scopes
    return scopes.withColumn("active", F.col("scope_id") == scope_id)


def region_uses(codes: Iterable[str], uses: DataFrame) -> DataFrame:
    """``(code, uses)`` of the regions that something refers to: those that may not be deleted. ``uses``: one row per reference, code."""
    return uses.where(F.col("code").isin(*codes)).groupBy("code").agg(F.count("*").alias("uses"))


def missing_rows(defaults: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Defaults whose key is not on record yet: what a first start inserts."""
    return defaults.join(recorded.select(*keys).distinct(), keys, "left_anti")


def synced(recorded: DataFrame, desired: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``(*keys, change)`` of owned rows against desired ones: created, updated, unchanged, or disabled where no longer desired."""
    return table_diff(recorded, desired, keys, columns).withColumn("change", F.when(F.col("change") == "removed", "disabled").otherwise(F.col("change")))


def merged_snapshots(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """The contexts one document was seen in, from all its snapshots: distinct coverage and scope ids, sorted."""
    rows = snapshots.groupBy(*keys).agg(F.array_sort(F.collect_set("coverage_id")).alias("coverage_ids"), F.array_sort(F.collect_set("scope_id")).alias("scope_ids"))
    return rows.withColumn("mode", F.when(F.size("coverage_ids") > 0, "explicit_coverage").otherwise("unscoped"))


def reinstated(sources: DataFrame, events: DataFrame) -> DataFrame:
    """Deprecated sources with a reinstatement event are candidates again with their failures forgotten; others stay."""
    again = events.select("source_id", F.lit(True).alias("again")).distinct()
    hit = F.coalesce("again", F.lit(False)) & (F.col("lifecycle_status") == "deprecated")
    return sources.join(again, "source_id", "left").withColumn("failures", F.when(hit, 0).otherwise(F.col("failures"))).withColumn(
        "lifecycle_status", F.when(hit, "candidate").otherwise(F.col("lifecycle_status"))).drop("again")


def pack_versions(registrations: DataFrame) -> DataFrame:
    """Latest registration of each pack, and whether its content changed against the one before."""
    w = Window.partitionBy("pack_id").orderBy("at", "version")
    rows = registrations.withColumn("before", F.lag("content_hash").over(w)).withColumn("k", F.row_number().over(Window.partitionBy("pack_id").orderBy(F.desc("at"), F.desc("version"))))
    return rows.where("k = 1").select("pack_id", "version", "content_hash", (~F.col("content_hash").eqNullSafe(F.col("before"))).alias("changed"))


def as_json(rows: DataFrame, columns: list[str], name: str = "json") -> DataFrame:
    """``rows`` with their columns, in alphabetical order, as one JSON text; nulls are left out."""
    return rows.withColumn(name, F.to_json(F.struct(*sorted(columns))))
